import random

import pytest

from chunkloom.functions.embed import Embedder, cosine
from chunkloom.plans.kernel import HARD, SOFT, Element, Options, chunk_elements, events, heading_level, is_heading, spans


def said(n, words=12):
    more = lambda i: " ".join(f"word{i}x{j}" for j in range(words))
    return " ".join(f"Sentence {i} of the text has words {more(i)}." for i in range(n))


def test_empty():
    assert chunk_elements([]) == []
    assert chunk_elements([Element("text", "  ")]) == []


def test_heading_goes_before_its_text():
    body = said(6)
    out = chunk_elements([Element("section_header", "Intro", 1, {"level": 1}), Element("text", "Intro\n" + body, 1)])
    assert out[0].content == "Intro\n\n" + body
    assert out[0].metadata == {"heading_trail": ["Intro"], "heading_level": 1, "nearest_heading": "Intro"}
    assert [c.sequence for c in out] == [0]


def test_trailing_heading_joins_the_last_chunk():
    out = chunk_elements([Element("text", said(6)), Element("section_header", "Appendix A")])
    assert len(out) == 1 and out[0].content.endswith("\n\nAppendix A")


def test_backmatter_ends_at_a_heading_as_shallow():
    parts = [("title", "A title"), ("text", said(6)), ("section_header", "References"), ("text", "[1] gone"), ("section_header_level_2", "deeper one"), ("text", "gone too"), ("section_header", "Appendix"), ("text", said(7))]
    out = " ".join(c.content for c in chunk_elements([Element(k, c) for k, c in parts]))
    assert "gone" not in out and "References" not in out and "Appendix" in out
    assert [e.what for e in events([Element(k, c) for k, c in parts])] == ["heading", "prose", "cut", "heading", "prose"]


def test_caption_goes_with_its_table():
    table = "| a | b |\n|---|---|\n| 1 | 2 |"
    out = chunk_elements([Element("text", said(6)), Element("caption", "Table 1: things"), Element("table", table)])
    assert [c.dominant_type for c in out] == ["prose", "table_block"]
    assert out[1].content == "Table 1: things\n\n" + table and out[1].has_table


def test_picture_speaks_through_the_text_before():
    out = chunk_elements([Element("text", "The plot below:"), Element("picture", "")])
    assert [(c.content, c.chunking_method) for c in out] == [("The plot below:", "visual_reference")]
    assert chunk_elements([Element("picture", "")]) == []


def test_large_code_has_children():
    code = "\n\n".join(f"def f{i}(x):\n" + "\n".join(f"    y{j} = x + {j}" for j in range(30)) + "\n    return x" for i in range(8))
    out = chunk_elements([Element("code", code, 1, {"language": "python"})])
    assert out[0].metadata["has_children"] and out[0].metadata["child_count"] == 8
    assert [c.block_sequence for c in out[1:]] == list(range(8))
    assert {c.chunking_method for c in out[1:]} == {"ast_split"}


def test_large_table_and_formula():
    table = "| a |\n|---|\n" + "\n".join(f"| {'v' * 40} {i} |" for i in range(120))
    out = chunk_elements([Element("table", table)])
    assert out[0].metadata["row_count"] == 120 and len(out) == out[0].metadata["child_count"] + 1
    formula = "\n".join(rf"\begin{{align}}{'x' * 900}_{i}\end{{align}}" for i in range(5))
    out = chunk_elements([Element("formula", formula)])
    assert [c.metadata.get("environment") for c in out[1:]] == ["align"] * 5 and all(c.has_math for c in out)


def test_small_prose_merges_past_a_block():
    code = Element("code", "def f():\n    return 1\n" * 20)
    out = chunk_elements([Element("text", said(6)), code, Element("text", "A short end.")])
    assert [c.dominant_type for c in out] == ["prose", "code_block"]
    assert out[0].content.endswith("\n\nA short end.")
    out = chunk_elements([Element("text", "A short start."), code, Element("text", said(6))])
    assert [c.dominant_type for c in out] == ["code_block", "prose"]
    assert out[1].content.startswith("A short start.\n\n")


def test_repeats_on_neighbouring_pages():
    text = said(6)
    pages = lambda ps: [p for c in chunk_elements([Element("text", text, p) for p in ps]) for p in c.page_numbers]
    assert pages([1, 2]) == [1]
    assert pages([1, 1, 1]) == [1]


def test_transcript_times():
    parts = [Element("transcript_segment", said(7), 1, {"start_time": 1.0, "end_time": 2.5}), Element("transcript_segment", said(8).replace("Sentence", "Line"), 1, {"start_time": 3})]
    out = chunk_elements(parts)
    assert [(c.metadata["start_time"], c.metadata.get("end_time"), c.metadata["segment_count"]) for c in out] == [(1.0, 2.5, 1), (3.0, None, 1)]


@pytest.mark.parametrize(
    "kind, metadata, level",
    [("title", {}, 1), ("subtitle", {}, 2), ("section_header_level_4", {"level": 2}, 4), ("section_header", {"level": "3"}, 3), ("section_header", {"level": "x", "style": "Heading 2"}, 2), ("section_header", {}, 1), ("text", {"level": 1}, None)],
)
def test_levels(kind, metadata, level):
    assert heading_level(Element(kind, "x", 0, metadata)) == level


def test_headings():
    assert is_heading("3.2.1 Mixed precision works.") and is_heading("A.1 Results") and is_heading("Results")
    assert not is_heading("ab") and not is_heading("x" * 121) and not is_heading("be done.") and not is_heading("One. two")


def plain_spans(tokens, before, most, overlap):
    """A loop that adds a sentence at a time."""
    out, i = [], 0
    while i < len(tokens):
        first, size = i, 0
        while i < len(tokens):
            if i > first and (before[i] == HARD or (before[i] == SOFT and size >= 200)):
                break
            if i > first and size + tokens[i] > most:
                break
            size += tokens[i]
            i += 1
        out.append((first, i))
        if overlap and i < len(tokens) and before[i] != HARD:
            back = size = 0
            for j in range(i - 1, first, -1):
                if size + tokens[j] > overlap:
                    break
                size += tokens[j]
                back += 1
            i -= back
    return out


def test_spans_random():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(0, 60)
        tokens = [rng.choice([5, 20, 60, 210, 700]) for _ in range(n)]
        before = [HARD, *(rng.choice([0, 0, 0, SOFT, HARD]) for _ in range(n - 1))][:n]
        for overlap in (0, 50, 300):
            assert list(spans(tokens, before, 500, overlap)) == plain_spans(tokens, before, 500, overlap)


def test_stand_in_embedder():
    e = Embedder()
    assert e.count("") == 1 and e.count("x" * 9) == 2
    assert e.sentences([]).shape == (1, 384)
    assert cosine(e.sentence("a"), e.sentence("b")) == pytest.approx(1)
    assert cosine(None, [1.0]) == 0.5 and cosine([0.0], [1.0]) == 0.0


def test_options_bound_chunks():
    out = chunk_elements([Element("text", said(60))], Options(max_tokens=200, overlap_tokens=0))
    assert all(c.token_count <= 210 for c in out) and len(out) > 4
