"""Queries that SQL can't say, against plain versions written another way."""

import json
import random

import chunkloom
from chunkloom.functions import values as V
from chunkloom.operators import blocks as B
from chunkloom.operators import chunks as H
from chunkloom.operators import elements as E
from chunkloom.operators import sentences as S
from chunkloom.plans.chunking import markdown_documents
from chunkloom.plans.kernel import Element


def plain_merge(chunks, limit):
    """Small chunks join others: (kind, tokens, content, divided) in a list that shrinks."""
    done, todo = [], [list(c) for c in chunks]
    while todo:
        kind, tokens, content, divided = cur = todo.pop(0)
        if tokens >= V.MERGE_BELOW or kind == "visual_block" or divided:
            done.append(cur)
            continue

        def first_alike(others):
            for other in others:
                if other[0] == kind:
                    return other if other[1] + tokens <= limit and not other[3] else None
                if other[0] not in V.PASSABLE_KINDS:
                    return None
            return None

        if (before := first_alike(done[::-1])) is not None:
            before[2] = before[2] + "\n\n" + content
            before[1] = max(1, len(before[2]) // 4)
        elif (after := first_alike(todo)) is not None:
            after[2] = content + "\n\n" + after[2]
            after[1] = max(1, len(after[2]) // 4)
        else:
            done.append(cur)
    return [(k, n, c) for k, n, c, _ in done]


def test_merging(spark):
    rng = random.Random(3)
    docs = []
    for d in range(120):
        rows = []
        for _ in range(rng.randrange(1, 14)):
            kind = rng.choice(["prose", "prose", "table_block", "code_block", "visual_block", "mixed"])
            text = "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([8, 40, 200, 380, 399, 420, 900, 1700])))
            rows.append((kind, max(1, len(text) // 4), text, kind == "code_block" and rng.random() < 0.4))
        docs.append((d, rows))
    flat = [(d, i, c, n, [1], 0, len(c), k, v) for d, rows in docs for i, (k, n, c, v) in enumerate(rows)]
    frame = spark.createDataFrame(flat, "doc_id long, ord long, content string, token_count long, page_numbers array<int>, span_start int, span_end int, dominant_type string, divided boolean")
    got = {}
    for r in B.number(H.without_small(frame, 500)).orderBy("doc_id", "sequence").collect():
        got.setdefault(r["doc_id"], []).append((r["dominant_type"], r["token_count"], r["content"]))
    assert got == {d: plain_merge(rows, 500) for d, rows in docs}
    assert sum(map(len, got.values())) < len(flat) * 0.9


def plain_collapse(words, low=V.SPAN_WORDS, high=V.SPAN_MAX):
    """The leftmost span that repeats at once loses its second copy, the longest of that
    place; from the beginning again after each."""
    while True:
        n = len(words)
        hit = next(((i, k) for i in range(n) for k in range(min(high, (n - i) // 2), low - 1, -1) if words[i : i + k] == words[i + k : i + 2 * k]), None)
        if not hit:
            return words
        i, k = hit
        words = words[: i + k] + words[i + 2 * k :]


def test_repeated_spans(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        words = [rng.choice("abcdef") for _ in range(rng.randrange(90))]
        for _ in range(rng.randrange(4)):
            i, k = rng.randrange(len(words) + 1), rng.randrange(3, 20)
            words[i:i] = words[i : i + k]
        texts.append(" ".join(words))
    frame = spark.createDataFrame([(t, "prose") for t in texts], "content string, dominant_type string")
    got = [r["content"].split() for r in H.without_repeated_spans(frame).collect()]
    assert sorted(got) == sorted(plain_collapse(t.split()) for t in texts)


def plain_trail(rows):
    """Trail at each row: for each level the last heading not followed by one as shallow."""
    out = []
    for i in range(len(rows)):
        live = []
        for j, (depth, text) in enumerate(rows[: i + 1]):
            if depth and not any(d and d <= depth for d, _ in rows[j + 1 : i + 1]):
                live.append((depth, text))
        out.append([t for _, t in sorted(live)])
    return out


def test_trails_and_backmatter_of_any_depth(spark):
    rng = random.Random(8)
    docs = {d: [(rng.choice([None, None, *range(1, 13)]), rng.choice(["References", "A heading", "Funding", "Another one"]) + ("" if rng.random() < 0.7 else " x")) for _ in range(rng.randrange(1, 40))] for d in range(40)}
    flat = [(d, i, f"section_header_level_{depth}" if depth else "text", text, 1) for d, rows in docs.items() for i, (depth, text) in enumerate(rows)]
    headed = E.with_headings(spark.createDataFrame(flat, "doc_id long, ord long, kind string, content string, page int"))
    got = {(r["doc_id"], r["ord"]): r["trail"] for r in E.with_trail(headed).collect()}
    assert got == {(d, i): t for d, rows in docs.items() for i, t in enumerate(plain_trail(rows))}
    stays = {(r["doc_id"], r["ord"]) for r in E.without_backmatter(headed).collect()}
    want = set()
    for d, rows in docs.items():
        out = None
        for i, (depth, text) in enumerate(rows):
            back = depth and text in ("References", "Funding")
            if depth and out is not None and depth <= out and not back:
                out = None
            if back and out is None:
                out = depth
            if out is None:
                want.add((d, i))
    assert stays == want


#: Markdown made of blocks whose elements are known.
BLOCKS = (
    (["# Title one"], [("section_header", "Title one", {"level": 1})]),
    (["### Deep ##"], [("section_header", "Deep", {"level": 3})]),
    (["Under", "==="], [("section_header", "Under", {"level": 1})]),
    (["Also", "----"], [("section_header", "Also", {"level": 2})]),
    (["some text", "over lines"], [("text", "some text\nover lines", {})]),
    (["```py x", "def f():", "", "# no heading", "```"], [("code", "def f():\n\n# no heading", {"language": "py"})]),
    (["~~~~", "```", "| a | b |", "~~~~~"], [("code", "```\n| a | b |", {})]),
    (["$$ a = b $$"], [("formula", "a = b", {})]),
    (["\\[", "x", "y \\]"], [("formula", "x\ny", {})]),
    (["| a | b |", "|---|---|", "| 1 | 2 |"], [("table", "| a | b |\n|---|---|\n| 1 | 2 |", {})]),
    (["![a cat](cat.png)"], [("picture", "a cat", {"caption": "a cat"})]),
    (["![](x.png)"], [("picture", "", {})]),
    (["- one", "  more", "- two", "", "- three"], [("list_item", "one\nmore", {}), ("list_item", "two", {}), ("list_item", "three", {})]),
    (["> said", "> more"], [("text", "said\nmore", {})]),
    (["* * *"], []),
)


def test_markdown_of_known_blocks(spark):
    """Any blocks one after another, with empty lines between, give the elements of each."""
    rng = random.Random(2)
    docs, want = [], {}
    for d in range(150):
        some = [rng.choice(BLOCKS) for _ in range(rng.randrange(1, 12))]
        # lists side by side are one list, and so are not what is tested here
        some = [b for i, b in enumerate(some) if not (i and b[0][0].startswith("-") and some[i - 1][0][0].startswith("-"))]
        docs.append((d, rng.choice(["\n", "\r\n"]).join(line for lines, _ in some for line in [*lines, *[""] * rng.randrange(1, 3)])))
        want[d] = [e for _, found in some for e in found]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {d: [] for d in want}
    for r in chunkloom.explode_elements(markdown_documents(frame)).orderBy("doc_id", "ord").collect():
        got[r["doc_id"]].append((r["kind"], r["content"], json.loads(r["metadata"] or "{}")))
    assert got == want


def test_whole_documents_equal_the_operators(spark):
    """The kernel, which goes through a document in turn, against the operators one after
    another, for prose below headings."""
    rng = random.Random(4)
    said = lambda: " ".join(f"{rng.choice(['It', 'One', 'Dr. Who'])} {rng.choice('abcdef')}{rng.randrange(99)} is {'so ' * rng.randrange(30)}here." for _ in range(rng.randrange(1, 40)))
    for _ in range(6):
        texts = [said() for _ in range(3)]
        kernel = chunkloom.chunk_elements([Element("text", t, 1) for t in texts[:1]], chunkloom.Options(overlap_tokens=0))
        frame = spark.createDataFrame([(1, texts[0])], "doc_id long, text string")
        chunks = S.text_chunks(frame, overlap_tokens=0).select("doc_id", "nth", "content", "token_count").collect()
        whole = [r["content"] for r in sorted(chunks, key=lambda r: r["nth"])]
        rest = plain_merge([("prose", max(1, len(c) // 4), c, False) for c in whole], 500)
        assert [" ".join(plain_collapse(c.split())) for _, _, c in rest] == [" ".join(c.content.split()) for c in kernel]
