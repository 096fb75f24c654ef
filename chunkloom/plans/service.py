"""One request, one document: validated input to a response, without a session."""

from __future__ import annotations

from dataclasses import asdict

from ..functions.embed import embedder
from ..sources.documents import OWN_KEYS
from ..sources.markdown import parse_markdown
from .kernel import Element, Options, chunk_elements

LIMITS = {"max_tokens": (1, 20_000), "overlap_tokens": (0, 10_000)}


class BadRequest(ValueError):
    """Input that can't be chunked; the message says why."""


def _listed(value, what: str) -> list[dict]:
    """A list of objects; none counts as empty."""
    if value is None:
        return []
    if not isinstance(value, list) or not all(isinstance(x, dict) for x in value):
        raise BadRequest(f"{what} are a list of objects")
    return value


def elements_of(document: dict) -> list[Element]:
    """Elements of a parsed document, in the order of its lists."""
    if not isinstance(document, dict):
        raise BadRequest("a document is an object with pages")
    out = []
    for page in _listed(document.get("pages"), "pages"):
        if "page_number" not in page:
            raise BadRequest("a page has no page_number")
        some = page.get("elements")
        for e in _listed(page.get("regions") if some is None else some, "elements"):
            own = {k: e[k] for k in OWN_KEYS if k in e}
            kind, content, metadata = e.get("type") or e.get("element_type") or "text", e.get("content") or "", e.get("metadata") or {}
            if not isinstance(kind, str) or not isinstance(content, str) or not isinstance(metadata, dict):
                raise BadRequest("an element has type and content as text, and metadata as an object")
            out.append(Element(kind, content, e.get("page") or 0, own | metadata))
    return out


def chunk_request(body: dict, model_dir: str | None = None) -> dict:
    """``num_chunks, avg_tokens, chunks`` of a body with ``text`` or ``document``, and
    optional limits. Raises BadRequest for none or both, for what is no text or document,
    and for limits out of bounds."""
    if not isinstance(body, dict):
        raise BadRequest("a request is an object")
    if (body.get("text") is None) == (body.get("document") is None):
        raise BadRequest("give either text or document")
    limits = {}
    for name, (low, high) in LIMITS.items():
        value = body.get(name)
        if value is None:
            continue
        if not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high:
            raise BadRequest(f"{name} is a number from {low} to {high}")
        limits[name] = value
    if body.get("text") is not None:
        if not isinstance(body["text"], str):
            raise BadRequest("text is a string")
        elements = [Element(k, c, 1, m or {}) for k, c, m in parse_markdown(body["text"])]
    else:
        elements = elements_of(body["document"])
    chunks = chunk_elements(elements, Options(**limits), embedder(model_dir))
    mean = sum(c.token_count for c in chunks) / len(chunks) if chunks else 0.0
    return {"num_chunks": len(chunks), "avg_tokens": mean, "chunks": [asdict(c) for c in chunks]}
