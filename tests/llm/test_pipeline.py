import random
import re

import corpus_pipeline
from chunkloom.llm.common import written
from chunkloom.llm.mixing import mix

from .odd import ROWS


def test_stages(spark, tmp_path):
    """Each stage's decision on rows whose fate is known."""
    rng = random.Random(6)
    near = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(900)) + " "
    rows = [(*r[:4], 1, "own", "kept") for r in ROWS] + [(i, t, "en", "a", 1, "own", None) for i, t in ((50, near + "end"), (51, near + "end."), (52, near.upper() + "END"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, position string")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], ""), "stage"))
    texts = [[r["text"] for r in d.collect()] for d in kept[:-1]]
    assert all(d.columns == docs.columns for d in kept[:-1])
    assert all({r["score"] for r in d.collect()} == {"own"} for d in kept[:-1])
    assert sorted(texts[1]) == sorted(t for _, t, *_ in rows if t and re.search(r"[^\W\d_]", t))
    assert len(texts[2]) == len({re.sub(r"\s+", " ", t) for t in texts[1]})
    assert sum(t.lower().startswith(near[:40]) for t in texts[3]) == 1
    assert set(texts[4]) <= set(texts[3])
    packed = kept[-1].toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert packed.position.nunique() == len(texts[4])


def test_packing_keeps_the_order_of_the_mix(spark):
    """Positions run as the mix wrote its documents, and sequences hold what stands near."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300")
    plan = {(r["doc_id"], p) for r in mix(docs).collect() for p in r["positions"]}
    mixed = written(corpus_pipeline.mix_sources(spark, docs.repartition(6), ""), "mixed")
    got = corpus_pipeline.packing(spark, mixed, "").select("doc_id", "position").distinct().orderBy("position").collect()
    of: dict[int, list[float]] = {}
    for i, p in sorted(plan, key=lambda x: x[1]):
        of.setdefault(i, []).append(p)
    assert len(got) == len(plan)
    seen = [of[r["doc_id"]].pop(0) for r in got]  # documents of equal positions may stand in either order
    assert seen == sorted(seen)


def test_empty_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), "none")
        assert docs.count() == 0


def test_whole_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "packing"]
