"""One document to its chunks: the exact sequential form, for a document in memory.

A document is a list of elements; the stages below turn it into events (headings, prose,
blocks), events into sections, sections into chunks, and chunks into their final order.
The relational operators compute the same stages set-wise; this form needs no shuffle and
runs over whole rows in an Arrow UDF.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import accumulate

from ..functions import text as T
from ..functions import values as V
from ..functions.embed import Embedder, cosine

log = logging.getLogger("chunkloom")


@dataclass(frozen=True)
class Element:
    kind: str
    content: str
    page: int = 0
    metadata: dict = field(default_factory=dict)

    @property
    def stripped(self) -> str:
        return self.content.strip()


@dataclass
class Chunk:
    content: str
    token_count: int
    page_numbers: list[int]
    span_start: int
    span_end: int
    chunking_method: str
    dominant_type: str
    metadata: dict
    block_sequence: int | None = None
    has_code: bool = False
    has_math: bool = False
    has_table: bool = False
    parent_chunk_id: str | None = None
    sequence: int = 0

    @property
    def divided(self) -> bool:
        return bool(self.metadata.get("has_children"))


@dataclass(frozen=True)
class Options:
    max_tokens: int = V.MAX_TOKENS
    overlap_tokens: int = V.OVERLAP_TOKENS
    boundary_threshold: float = V.BOUNDARY_THRESHOLD


# -- elements ---------------------------------------------------------------------------


def without_repeats(elements: list[Element]) -> list[Element]:
    """Elements whose content was kept on this page or a neighbouring one don't stay."""
    kept_on: dict[tuple[str, str], int] = {}
    out = []
    for e in elements:
        key = (e.stripped.lower(), e.kind)
        if key in kept_on and abs(e.page - kept_on[key]) <= 1:
            continue
        kept_on[key] = e.page
        out.append(e)
    return out


def without_bleed(elements: list[Element]) -> list[Element]:
    out, following = [], None
    for e in reversed(elements):
        bled = e.kind == "section_header" and following is not None
        out.append(replace(e, content=T.bled_heading(e.content, following)) if bled else e)
        following = e.stripped or following
    return out[::-1]


_LEVEL, _STYLE, _NUMBERED, _FRAGMENT = map(re.compile, (V.LEVEL_RE, V.STYLE_RE, V.NUMBERED_RE, V.FRAGMENT_RE))
_BACKMATTER = re.compile(V.BACKMATTER_RE, re.IGNORECASE)
_INTRO = re.compile(V.INTRO_RE, re.IGNORECASE)
_CAPTION = re.compile(V.CAPTION_RE, re.IGNORECASE)


def heading_level(e: Element) -> int | None:
    fixed = {"title": 1, "subtitle": 2}.get(e.kind)
    if fixed or not e.kind.startswith("section_header"):
        return fixed
    if m := _LEVEL.match(e.kind):
        return int(m[1])
    try:
        return int(e.metadata["level"])
    except (KeyError, ValueError, TypeError):
        m = _STYLE.search(str(e.metadata.get("style") or ""))
        return int(m[1]) if m else 1


def is_heading(text: str) -> bool:
    if not V.HEADING_CHARS[0] <= len(text) <= V.HEADING_CHARS[1]:
        return False
    return bool(_NUMBERED.match(text)) or not _FRAGMENT.search(text)


@dataclass(frozen=True)
class Event:
    """What an element means in its place: ``heading``, ``prose`` or ``block``; also
    ``cut``, where backmatter begins and prose before it ends."""

    what: str
    element: Element | None = None
    trail: dict = field(default_factory=dict)


def events(elements: Iterable[Element]) -> Iterator[Event]:
    trail: dict[int, str] = {}
    left_out: int | None = None  # depth of the backmatter heading we are below
    for e in elements:
        if e.kind in V.SKIPPED_TYPES:
            continue
        level = heading_level(e)
        if level is not None and not is_heading(e.stripped):
            level = None
        if level is not None:
            trail = {k: v for k, v in trail.items() if k < level} | {level: e.stripped}
            if _BACKMATTER.match(e.stripped):
                if left_out is None:
                    left_out = level
                    yield Event("cut")
                continue
            if left_out is not None and level <= left_out:
                left_out = None
        if left_out is not None:
            continue
        if e.kind in V.ATOMIC_TYPES:
            yield Event("block", e, _trail(trail))
        elif level is not None:
            yield Event("heading", e)
        else:
            yield Event("prose", e, _trail(trail))


def _trail(trail: dict[int, str]) -> dict:
    if not trail:
        return {}
    levels = sorted(trail)
    return {"heading_trail": [trail[k] for k in levels], "heading_level": levels[-1], "nearest_heading": trail[levels[-1]]}


# -- prose ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Sentence:
    text: str
    start: int
    end: int
    element: Element
    trail: dict
    opens: bool


def sentences(run: list[Event]) -> list[Sentence]:
    out, offset = [], 0
    for event in run:
        e, text = event.element, event.element.stripped
        if not text:
            continue
        opens = not e.metadata.get("is_speaker_notes")
        for start, end in T.sentence_spans(text):
            out.append(Sentence(text[start:end].strip(), offset + start, offset + end, e, event.trail, opens))
            opens = False
        offset += len(text) + 1
    return out


HARD, SOFT = 2, 1


def boundaries(said: list[Sentence], embed: Embedder, threshold: float) -> list[int]:
    """HARD, SOFT or 0 before each sentence."""
    vectors = embed.sentences([s.text for s in said]) if len(said) > 1 else []
    out = [HARD]
    for i in range(1, len(said)):
        a, b = said[i - 1].element.kind, said[i].element.kind
        alike = a in V.PROSE_TYPES and b in V.PROSE_TYPES
        if b.startswith("section_header") or (a != b and not alike):
            out.append(HARD)
        elif said[i].opens:
            out.append(SOFT if alike else HARD)
        else:
            out.append(SOFT if cosine(vectors[i - 1], vectors[i]) < threshold else 0)
    return out


def spans(tokens: list[int], before: list[int], max_tokens: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Half-open ranges of sentences, greedily filled; a range begins with what of the one
    before fits the overlap, unless a hard boundary parts them."""
    total = [0, *accumulate(tokens)]
    start, n = 0, len(tokens)
    while start < n:
        end = start + 1
        while end < n and before[end] != HARD and total[end + 1] - total[start] <= max_tokens:
            if before[end] == SOFT and total[end] - total[start] >= V.MIN_TOKENS:
                break
            end += 1
        yield start, end
        back = end
        if end < n and overlap > 0 and before[end] != HARD:
            while back - 1 > start and total[end] - total[back - 1] <= overlap:
                back -= 1
        start = back


def joined(said: list[Sentence]) -> str:
    return said[0].text + "".join(("\n\n" if s.opens else " ") + s.text for s in said[1:])


def _number(x) -> bool:
    return isinstance(x, (int, float))


def prose_metadata(said: list[Sentence]) -> dict:
    out = dict(said[0].trail)
    kinds = {s.element.metadata.get("type") for s in said} - {None, ""}
    if len(kinds) == 1:
        out["section_type"] = kinds.pop()
    times = [(s.element.metadata.get("start_time"), s.element.metadata.get("end_time")) for s in said]
    starts, ends = [float(a) for a, _ in times if _number(a)], [float(b) for _, b in times if _number(b)]
    if starts:
        out["start_time"] = min(starts)
        if ends:
            out["end_time"] = max(ends)
        out["segment_count"] = len({x for x in times if _number(x[0])})
    return out


def prose_chunks(run: list[Event], embed: Embedder, options: Options) -> list[Chunk]:
    said = sentences(run)
    said = [s for s, stays in zip(said, T.surviving([T.squeezed(s.text) for s in said])) if stays]
    if not said:
        return []
    tokens = [embed.count(s.text) for s in said]
    out = []
    for a, b in spans(tokens, boundaries(said, embed, options.boundary_threshold), options.max_tokens, options.overlap_tokens):
        part = said[a:b]
        content = joined(part)
        pages = sorted({s.element.page for s in part})
        out.append(Chunk(content, embed.count(content), pages, part[0].start, part[-1].end, "semantic", "prose", prose_metadata(part)))
    return out


# -- blocks -----------------------------------------------------------------------------


def whole_block(e: Element, embed: Embedder) -> Chunk:
    return Chunk(
        e.content, embed.count(e.content), [e.page], 0, len(e.content), "atomic_block", V.BLOCK_KINDS.get(e.kind, "mixed"),
        {"element_type": e.kind}, None, e.kind == "code", e.kind == "formula", e.kind == "table",
    )


def visual_block(e: Element, embed: Embedder) -> list[Chunk]:
    caption, alt = str(e.metadata.get("caption") or ""), str(e.metadata.get("alt_text") or "")
    content = "\n".join(filter(None, (caption, alt))).strip()
    if not content:
        return []
    metadata = {"element_type": e.kind, "caption": caption, "alt_text": alt, "skip_text_indexing": False}
    return [Chunk(content, embed.count(content), [e.page], 0, len(content), "visual_reference", "visual_block", metadata)]


def block_chunks(e: Element, embed: Embedder) -> list[Chunk]:
    """A block whole, or a parent with its parts where it is large and can be split."""
    if e.kind in V.VISUAL_TYPES:
        return visual_block(e, embed)
    parent = whole_block(e, embed)
    if parent.token_count <= V.LARGE_BLOCK:
        return [parent]
    extra, method = {}, {"code": "ast_split", "table": "row_group", "formula": "env_split"}[e.kind]
    if e.kind == "code":
        language = T.code_language(e.content, e.metadata.get("language"))
        parts = T.split_code(e.content, language)
        whole = len(parts) == 1 and parts[0][1]["type"] == "module"
        made = lambda text, c: (c.get("lineno", 0), c.get("end_lineno", len(text)), {"ast_node": c["type"], "name": c.get("name"), "start_line": c.get("lineno"), "end_line": c.get("end_lineno"), "language": language})
    elif e.kind == "table":
        parts = T.split_table(e.content, count=embed.count)
        whole = len(parts) == 1
        extra = {"row_count": len(e.content.split("\n")) - 2}
        caption = e.metadata.get("caption", "")
        made = lambda text, c: (c["row_start"], c["row_end"], {"row_start": c["row_start"], "row_end": c["row_end"], "column_headers": c.get("column_headers", ""), "table_caption": caption})
    else:
        parts = T.split_formula(e.content)
        whole = len(parts) == 1 and parts[0][1]["split_method"] == "none"
        made = lambda text, c: (c.get("span_start", 0), c.get("span_end", len(text)), {"environment": c.get("env"), "step": c.get("step"), "split_method": c["split_method"], "char_start": c.get("span_start"), "char_end": c.get("span_end")})
    if whole:
        return [parent]
    parent.metadata |= {"has_children": True, "child_count": len(parts)} | extra
    out = [parent]
    for i, (text, context) in enumerate(parts):
        start, end, metadata = made(text, context)
        out.append(replace(parent, content=text, token_count=embed.count(text), span_start=start, span_end=end, chunking_method=method, block_sequence=i, metadata=metadata))
    return out


def introduces(e: Element, embed: Embedder) -> bool:
    """Whether the prose element right before a block belongs to it."""
    text = e.stripped
    return e.kind == "caption" or embed.count(text) <= V.CONTEXT_TOKENS and bool(_INTRO.search(text) or _CAPTION.match(text))


# -- sections to chunks -----------------------------------------------------------------


def with_headings(chunks: list[Chunk], headings: list[str], embed: Embedder) -> list[Chunk]:
    """Headings go before the first chunk, and out of its beginning if they stand there."""
    if chunks and headings:
        body = chunks[0].content.lstrip()
        for h in filter(None, headings):
            if body == h or body.startswith(h + "\n"):
                body = body[len(h) :].lstrip("\n").lstrip(" ").lstrip("\n")
        chunks[0].content = "\n\n".join([*headings, body])
        chunks[0].token_count = embed.count(chunks[0].content)
    return chunks


def raw_chunks(stream: Iterable[Event], embed: Embedder, options: Options) -> list[Chunk]:
    out: list[Chunk] = []
    run: list[Event] = []
    headings: list[str] = []

    def flush() -> None:
        if run:
            out.extend(with_headings(prose_chunks(run, embed, options), headings, embed))
            run.clear()
            headings.clear()

    for event in stream:
        if event.what == "prose":
            run.append(event)
            continue
        context = ""
        if event.what == "block" and run and introduces(run[-1].element, embed):
            context = run.pop().element.stripped
        flush()
        if event.what == "heading":
            headings.append(event.element.stripped)
        elif event.what == "block":
            e = event.element
            made = block_chunks(e, embed)
            if context and made:
                made[0].content = f"{context}\n\n{made[0].content}"
                made[0].token_count = embed.count(made[0].content)
            elif context and e.kind in V.VISUAL_TYPES:
                made = [Chunk(context, embed.count(context), [e.page], 0, len(context), "visual_reference", "visual_block", {"element_type": e.kind})]
            for c in made:
                c.metadata |= event.trail
            out += made
            headings.clear()
    flush()
    if headings and out:
        out[-1].content = "\n\n".join([out[-1].content, *headings])
        out[-1].token_count = embed.count(out[-1].content)
    return out


def _partner(small: Chunk, others: Iterable[Chunk], max_tokens: int) -> Chunk | None:
    """The nearest chunk of the same kind, past other blocks only, if both fit together."""
    for c in others:
        if c.dominant_type == small.dominant_type:
            return c if c.token_count + small.token_count <= max_tokens and not c.divided else None
        if c.dominant_type not in V.PASSABLE_KINDS:
            return None
    return None


def merged(chunks: list[Chunk], embed: Embedder, max_tokens: int) -> list[Chunk]:
    """Small chunks join the nearest of their kind before them, else after them."""
    out: list[Chunk] = []
    for i, c in enumerate(chunks):
        fixed = c.token_count >= V.MERGE_BELOW or c.dominant_type == "visual_block" or c.divided
        if fixed:
            out.append(c)
        elif target := _partner(c, reversed(out), max_tokens):
            _join(target, target.content, c.content, c, embed)
            target.span_end = c.span_end
        elif target := _partner(c, chunks[i + 1 :], max_tokens):
            _join(target, c.content, target.content, c, embed)
            target.span_start = c.span_start
        else:
            out.append(c)
    return out


def _join(target: Chunk, first: str, second: str, other: Chunk, embed: Embedder) -> None:
    target.content = f"{first}\n\n{second}"
    target.token_count = embed.count(target.content)
    target.page_numbers = sorted({*target.page_numbers, *other.page_numbers})


def chunk_elements(elements: list[Element], options: Options = Options(), embed: Embedder | None = None) -> list[Chunk]:
    """All chunks of a document, in order. Empty documents have none."""
    embed = embed or Embedder()
    cleaned = without_bleed(without_repeats(elements))
    out = merged(raw_chunks(events(cleaned), embed, options), embed, options.max_tokens)
    shortened = 0
    for i, c in enumerate(out):
        c.sequence = i
        if c.dominant_type == "prose":
            c.content, removed = T.collapse_spans(c.content)
            shortened += removed > 0
    mean = sum(c.token_count for c in out) / len(out) if out else 0
    log.info("%d chunks of %.0f tokens on average, %d shortened by repeated spans", len(out), mean, shortened)
    return out
