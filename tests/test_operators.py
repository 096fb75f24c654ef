"""Relational operators: odd rows, empty tables, and agreement with the kernel."""

import pytest
from pyspark.sql import functions as F

from chunkloom.operators import blocks as B
from chunkloom.operators import chunks as H
from chunkloom.operators import elements as E
from chunkloom.operators import sentences as S
from chunkloom.plans.kernel import Element, chunk_elements, events, raw_chunks, Options
from chunkloom.functions.embed import Embedder

SHAPE = "doc_id long, ord long, kind string, content string, page int, level string"
ROWS = [
    (1, 0, "title", "A title", 1, None),
    (1, 1, "text", "First words of it. Second ones follow here.", 1, None),
    (1, 2, "text", None, 1, None),
    (1, 3, "text", "", 2, None),
    (1, 4, "caption", "Table 1: all", 2, None),
    (1, 5, "table", "| a |\n|---|\n| 1 |", 2, None),
    (1, 6, "section_header", "References", 3, "1"),
    (1, 7, "text", "left out", 3, None),
    (1, 8, "section_header", "Deeper", 3, "2"),
    (1, 9, "section_header", "Appendix", 3, "1"),
    (1, 10, "text", "Kept again.", 3, None),
    (1, 11, "section_header", "Last heading", 3, "2"),
    (2, 0, "page_footer", "7", 1, None),
    (3, 0, "text", "Twice.", 1, None),
    (3, 1, "text", "Twice.", 2, None),
    (3, 2, "text", "twice. ", 3, None),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SHAPE).cache()


def ords(df, doc=1):
    return sorted(r["ord"] for r in df.where(F.col("doc_id") == doc).collect())


def test_elements(rows):
    assert ords(E.without_repeats(rows), 3) == [0, 2]
    assert ords(E.without_repeats(rows)) == list(range(12))
    assert ords(E.without_skipped(rows), 2) == []
    headed = E.with_headings(rows)
    assert ords(E.without_backmatter(headed)) == [0, 1, 2, 3, 4, 5, 9, 10, 11]
    trail = {r["ord"]: r["trail"] for r in E.with_trail(headed).where("doc_id = 1").collect()}
    assert trail[1] == ["A title"] and trail[8] == ["References", "Deeper"] and trail[11] == ["Appendix", "Last heading"]
    kept = E.with_runs(E.without_backmatter(headed))
    context = {r["ord"]: r["context"] for r in E.with_context(kept).where("doc_id = 1").collect()}
    assert context[5] == "Table 1: all" and 4 not in context
    pending = {r["ord"]: r["pending"] for r in E.with_pending(kept).where("doc_id = 1").collect()}
    assert pending[1] == "A title" and pending[10] == "Appendix" and pending[5] is None
    assert [tuple(r) for r in E.trailing_headings(kept).collect()] == [(1, "Last heading")]


def test_events_agree_with_the_kernel(rows):
    kept = E.without_skipped(rows.where("content is not null"))
    got = E.with_runs(E.without_backmatter(E.with_headings(kept))).where("doc_id = 1").orderBy("ord").collect()
    made = [Element(k, c, p, {"level": lv} if lv else {}) for d, _, k, c, p, lv in ROWS if d == 1 and c is not None]
    want = [(e.what, e.element.content) for e in events(made) if e.what != "cut"]
    assert [(r["role"], r["content"]) for r in got] == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], SHAPE)
    headed = E.with_runs(E.with_headings(none))
    frames = [E.without_repeats(none), E.without_bleed(none), E.with_trail(headed), E.without_backmatter(headed), E.with_context(headed), E.with_pending(headed), E.trailing_headings(headed), B.whole_blocks(none), B.table_parts(none), B.formula_parts(none), B.code_parts(none), B.dispatch(none)]
    said = S.sentence_spans(none.withColumnRenamed("content", "text"), ["doc_id", "ord"])
    assert [f.count() for f in [*frames, said]] == [0] * 13


def test_sentences_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, "  "), (3, "No stop"), (4, " A. B! \n C?  "), (5, "See Fig. 3. Done.")], "doc_id long, text string")
    got = {}
    for r in S.sentence_spans(rows, ["doc_id"]).orderBy("doc_id", "nth").collect():
        got.setdefault(r["doc_id"], []).append((r["begin"], r["end"], r["sentence"]))
    assert got == {3: [(0, 7, "No stop")], 4: [(0, 3, "A."), (3, 8, "B!"), (8, 10, "C?")], 5: [(0, 12, "See Fig. 3."), (12, 17, "Done.")]}


def test_chunks_agree_with_the_kernel(spark):
    text = " ".join(f"Sentence {i} has words a{i} b{i} c{i} d{i} and e{i}." for i in range(150))
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    said = S.sentence_spans(rows, ["doc_id"]).select("doc_id", F.lit(0).alias("run"), F.col("nth").alias("pos"), "sentence", F.col("begin").alias("start_idx"), F.col("end").alias("end_idx"), (F.col("nth") == 0).alias("opens"), F.lit("text").alias("kind"), F.lit(0).alias("page"))
    got = S.chunk_rows(S.with_boundaries(S.surviving(said))).orderBy("nth").collect()
    want = raw_chunks(events([Element("text", text)]), Embedder(), Options())
    assert [(r["content"], r["token_count"], r["span_start"], r["span_end"]) for r in got] == [(c.content, c.token_count, c.span_start, c.span_end) for c in want]


def test_small_chunks(spark):
    shape = "doc_id long, ord long, content string, token_count long, page_numbers array<int>, span_start int, span_end int, dominant_type string, divided boolean"
    rows = [(1, 0, "start", 1, [1], 0, 5, "prose", False), (1, 1, "code", 300, [1], 0, 4, "code_block", False), (1, 2, "x" * 800, 200, [2], 7, 807, "prose", False), (1, 3, "end", 1, [3], 0, 3, "prose", False), (1, 4, "t", 1, [3], 0, 1, "table_block", True)]
    got = H.without_small(spark.createDataFrame(rows, shape), 500).orderBy("ord").collect()
    assert [(r["ord"], r["content"], r["page_numbers"], r["span_start"], r["span_end"]) for r in got] == [
        (1, "code", [1], 0, 4),
        (2, "start\n\n" + "x" * 800 + "\n\nend", [1, 2, 3], 0, 3),
        (4, "t", [3], 0, 1),
    ]


def test_headings_before(spark):
    rows = [(1, 0, "Top\nbody", ["Top"]), (1, 1, "Topic", ["Top"]), (1, 2, " x", None), (1, 3, "A\n\nB\n c", ["A", "B"])]
    got = H.with_headings(spark.createDataFrame(rows, "doc_id long, ord long, content string, pending array<string>")).orderBy("ord").collect()
    assert [r["content"] for r in got] == ["Top\n\nbody", "Top\n\nTopic", " x", "A\n\nB\n\nc"]


def test_whole_document(spark):
    chunks = chunk_elements([Element(k, c or "", p, {"level": lv} if lv else {}) for d, _, k, c, p, lv in ROWS if d == 1])
    # the small first run merges forward, past the table
    assert [c.dominant_type for c in chunks] == ["table_block", "prose"]
    assert chunks[0].content == "Table 1: all\n\n| a |\n|---|\n| 1 |" and chunks[0].metadata["nearest_heading"] == "A title"
    assert chunks[1].content.startswith("A title\n\nFirst") and chunks[1].content.endswith("Appendix\n\nKept again.\n\nLast heading")
