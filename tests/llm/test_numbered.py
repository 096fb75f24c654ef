import os

import pytest
from pyspark.sql import functions as F

from chunkloom.llm import common
from chunkloom.llm.common import drop_scratch, file_order, kept, numbered


def test_numbers_stay_when_splits_change(spark, tmp_path):
    """A row keeps its number however the files are dealt over tasks."""
    path, size = str(tmp_path / "docs"), "spark.sql.files.maxPartitionBytes"
    spark.range(6000).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(12).write.parquet(path)
    docs = spark.read.parquet(path)
    before = spark.conf.get(size)
    marked, seen = numbered(docs, "row"), []
    try:
        for limit in (before, "3k"):
            spark.conf.set(size, limit)
            rows = marked.select("doc_id", "row")
            seen.append((rows.rdd.getNumPartitions(), {r["doc_id"]: r["row"] for r in rows.collect()}))
    finally:
        spark.conf.set(size, before)
    assert seen[0][0] != seen[1][0] and seen[0][1] == seen[1][1]
    assert len(set(seen[0][1].values())) == 6000


def test_numbers_of_other_plans(spark, tmp_path):
    """Rows in memory, and files that are named twice, get numbers of their own too."""
    path = str(tmp_path / "docs")
    spark.range(100).write.parquet(path)
    once = spark.read.parquet(path)
    for docs in (spark.range(100).union(spark.range(100)), spark.read.parquet(path, path), once.withColumn("_metadata", F.lit(1))):
        rows = numbered(docs, "row").collect()
        assert len({r["row"] for r in rows}) == len(rows)


def test_file_order_is_the_order_written(spark, tmp_path):
    path = str(tmp_path / "sorted")
    spark.range(5000).selectExpr("id", "repeat('x', int(if(id < 700, 900, 1))) AS pad").repartitionByRange(9, "id").sortWithinPartitions("id").write.parquet(path)
    rows = file_order(spark.read.parquet(path), "at").select("id", "at").collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["at"])] == list(range(5000))
    assert len({r["at"] for r in file_order(spark.range(10), "at").collect()}) == 10


def test_scratch_is_dropped(spark):
    df, path = kept(spark.range(3), "some")
    assert df.count() == 3
    drop_scratch(spark, path)
    assert not os.path.exists(path.removeprefix("file://"))


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Session:
        conf = {}

        class sparkContext:
            master, applicationId, getConf = "spark://far:7077", "app-1", dict

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
    monkeypatch.setattr(Session.sparkContext, "master", "local[4]")
    assert common.shared_dir(Session) == common.shared_dir(Session)
    monkeypatch.setattr(Session, "conf", {"spark.checkpoint.dir": "far://store/"})
    assert common.shared_dir(Session) == "far://store"


@pytest.mark.parametrize("bits", [common.SIEVE_BITS, 64])
def test_sieve(spark, monkeypatch, bits):
    """Rows that may be concerned hold all that are; without_rows is an anti-join."""
    monkeypatch.setattr(common, "SIEVE_BITS", bits)
    docs = spark.range(5000).selectExpr("id AS row", "string(id) AS bits", "id % 7 AS at")
    some = spark.range(0, 5000, 97).toDF("x")
    may, stay = common.sieved(docs, "row", some)
    held = {r["row"] for r in may.collect()}
    assert may.columns == docs.columns and set(range(0, 5000, 97)) <= held
    assert held.isdisjoint(r["row"] for r in stay.collect()) and len(held) + stay.count() == 5000
    assert len(held) < 60 or bits == 64
    assert {r["row"] for r in common.without_rows(docs, "row", some).collect()} == set(range(5000)) - set(range(0, 5000, 97))
    assert common.without_rows(docs, "row", some.limit(0)).count() == 5000
