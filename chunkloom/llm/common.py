"""Shared folder, written tables and tokenizer access for the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts spell it; words are the runs between.
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: ``spark.checkpoint.dir`` if the session has one.

    Only a local session (tests, a laptop) may leave it unset and gets a temporary folder;
    on a cluster that would be another folder on each machine, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="chunkloom-")
    return _own_dir[app]


def _files(spark: SparkSession, path: str):
    """Spark's file system and path of a folder, whatever store it is in."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def scratch_root(spark: SparkSession) -> str:
    """This application's folder for what is cut from lineage; it goes with the application."""
    root = f"{shared_dir(spark)}/chunkloom-{spark.sparkContext.applicationId}"
    fs, there = _files(spark, root)
    if not fs.exists(there):
        fs.mkdirs(there)
        fs.deleteOnExit(there)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Delete folders of ``scratch_path`` that nothing reads any more; without paths all of
    this application's."""
    for path in paths or (scratch_root(spark),):
        fs, there = _files(spark, path)
        fs.delete(there, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: a cut of lineage
    that survives the loss of any executor."""
    return kept(df, name)[0]


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``written``, and the path, for those who know when it can be dropped."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """``written`` for tables of one operator; ``drop`` deletes them all when none is read
    any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        out, path = kept(df, name)
        self.paths.append(path)
        return out

    def drop(self) -> None:
        while self.paths:
            drop_scratch(self.spark, self.paths.pop())


_turn: list = ["", ()]


def takes_turn(operator: str, *memories: dict) -> None:
    """An operator goes on in this Python worker, and what it keeps there is in ``memories``.

    A worker serves all stages, one after another, as long as it lives: what the operator
    before it kept is emptied, and free memory, which the allocators would keep, goes back
    to the machine. So an executor never holds the memories of several operators.
    """
    if _turn[0] != operator:
        for memory in _turn[1]:
            memory.clear()
        _turn[:] = operator, memories
        gc.collect()
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text):
    """Number of runs of non-space bytes; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def crc_of_id(col):
    """crc32 of an id written as decimal text."""
    return F.crc32(F.encode(col.cast("string"), "UTF-8"))


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, in any letter case."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of the hash table that tells rows apart without a shuffle: 8 MB, whatever the data.
SIEVE_BITS = 1 << 26
_BUCKET = 1 << 15  # bits that Spark's bitmap functions hold in one value


def sieved(docs: DataFrame, column: str, some: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose ``column`` may be among the values of ``some`` (one column of
    that type, no nulls), and those where it surely isn't.

    ``some`` sets bits by a hash; the bits, of a fixed size, are broadcast. So rows that
    ``some`` doesn't concern, texts and all, need not be shuffled to be joined to it; where
    it has so many values that all bits are set, all rows are of the first kind.
    """
    where = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE_BITS))
    bucket, bits, at = (fresh_name(docs, x) for x in ("bucket", "bits", "at"))
    hashed = some.select(where(F.col(some.columns[0])).alias("h"))
    table = hashed.groupBy(F.floor(F.col("h") / _BUCKET).alias(bucket)).agg(F.bitmap_construct_agg(F.col("h") % _BUCKET).alias(bits))
    table = F.broadcast(written(table, "sieve"))
    placed = docs.withColumn(at, where(F.col(column))).withColumn(bucket, F.floor(F.col(at) / _BUCKET))
    place = F.col(at) % _BUCKET
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    told = placed.join(table, bucket, "left")
    return told.where(hit).drop(bucket, bits, at), told.where(~hit).drop(bucket, bits, at)


def without_rows(docs: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``column`` is among the values of ``gone``."""
    may, stay = sieved(docs, column, gone)
    return may.join(gone.toDF(column), column, "left_anti").unionByName(stay)


#: Bits of a row's number that tell its place in the file; those above tell the file.
FILE_BITS = 40


def _relation(docs: DataFrame):
    """The one plain Parquet scan that ``docs`` reads, with columns chosen or rows left out
    at most; else None. A file that is named twice is read twice, so that is none."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    node = plan
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    if node.nodeName() != "LogicalRelation" or not plan.deterministic():
        return None
    relation = node.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation" or relation.fileFormat().toString() != "Parquet":
        return None
    files = list(relation.location().inputFiles())
    return relation if len(set(files)) == len(files) else None


def is_scan(docs: DataFrame) -> bool:
    """Whether rows of ``docs`` can be told by their file and their place in it."""
    return _relation(docs) is not None and not any(c.lower().startswith("_metadata") for c in docs.columns)


def numbered(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` with a number for each row that is the same whenever it is read.

    Rows of plain Parquet scans get a number of their file and their place in it, which
    don't depend on how a scan is split; anything else is numbered and written first.
    """
    if is_scan(docs):
        path = F.col("_metadata.file_path")
        paths = sorted(r[0] for r in docs.select(path.alias("path")).distinct().collect())
        for salt in range(64):
            # a hash instead of a table of all files in the plan; one that tells them apart
            tag = F.xxhash64(path, F.lit(salt)).bitwiseAND(F.lit((1 << 63 - FILE_BITS) - 1))
            if len(paths) < 2:
                tag = F.lit(0).cast("long")
            elif docs.select(path.alias("path"), tag.alias("tag")).distinct().agg(F.count_distinct("tag")).first()[0] < len(paths):
                continue
            return docs.withColumn(column, F.shiftleft(tag, FILE_BITS) + F.col("_metadata.row_index"))
    return written(docs.withColumn(column, F.monotonically_increasing_id()), "numbered")


def file_order(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` with each row's place in the order in which it was written.

    Spark names the files of a write by its tasks, ``part-00000`` on, so that a table that
    was written in sorted order has it in these numbers and in the rows' places within a
    file, while a scan deals files out by size. What isn't told by such names, or is no
    scan, is in the order of its partitions.
    """
    if is_scan(docs):
        name = F.col("_metadata.file_name")
        task = F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long")
        told = docs.select(name.alias("name"), task.alias("task")).distinct()
        files, tasks = told.agg(F.count("*"), F.count_distinct("task")).first()
        if files == tasks or files < 2:
            return docs.withColumn(column, F.shiftleft(F.coalesce(task, F.lit(0)), FILE_BITS) + F.col("_metadata.row_index"))
    return docs.withColumn(column, F.monotonically_increasing_id())
