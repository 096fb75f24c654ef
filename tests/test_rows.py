"""Row functions over Arrow columns: few rows at a time, whatever comes at once."""

import json
import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chunkloom.functions import columns as C
from chunkloom.functions import rows as R

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: The largest worker's MB, for each operator over thousands of texts of 60 sentences that come as one batch.
PEAKS = """
import json, os, sys, threading, time
from pyspark.sql import SparkSession, functions as F
from chunkloom.operators import chunks as H, sentences as S
from chunkloom.plans import chunking as P

spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.python.worker.reuse", "false")
    .config("spark.sql.adaptive.enabled", "false").config("spark.sql.shuffle.partitions", "1").config("spark.ui.showConsoleProgress", "false").getOrCreate())
n, most, ended = 9000, [0.0], [False]

def workers():
    for p in filter(str.isdigit, os.listdir("/proc")):
        try:
            if b"pyspark.daemon" in open(f"/proc/{p}/cmdline", "rb").read():
                with open(f"/proc/{p}/smaps_rollup") as f:
                    yield sum(int(x.split()[1]) for x in f if x.startswith("Pss_Anon")) / 1024
        except OSError:
            pass

def watch():
    while not ended[0]:
        most[0] = max([most[0], *workers()])
        time.sleep(0.02)

threading.Thread(target=watch, daemon=True).start()
told = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("Some words of number "), i.cast("string"), F.lit(".")))
docs = spark.range(n, numPartitions=1).select(F.col("id").alias("doc_id"), told.alias("said")).withColumn("text", F.array_join("said", " "))
lines = docs.select("doc_id", F.posexplode("said").alias("ord", "content")).select("doc_id", "ord", "content", F.lit(1).alias("token_count"), F.array(F.lit(1)).alias("page_numbers"),
    F.lit(0).alias("span_start"), F.lit(9).alias("span_end"), F.lit("prose").alias("dominant_type"), F.lit(True).alias("divided"))
out = {}
some = docs.where("doc_id < 1000").withColumn("text", F.array_join("said", "\\n# Part\\n\\n"))
for name, df in (("sentence_spans", S.sentence_spans(docs, ["doc_id"])), ("text_chunks", S.text_chunks(docs, max_tokens=20)),
        ("chunk_markdown", P.chunk_markdown(some, max_tokens=20)), ("without_small", H.without_small(lines.where("doc_id < 3000"), 500))):
    most[0] = 0.0
    df.write.format("noop").mode("overwrite").save()
    out[name] = most[0]
ended[0] = True
print("PEAKS", json.dumps(out))
spark.stop()
"""


@pytest.fixture(scope="module")
def peaks():
    run = subprocess.run([sys.executable, "-c", PEAKS], cwd=TOP, env=os.environ | {"PYTHONPATH": TOP, "PYSPARK_PYTHON": sys.executable}, capture_output=True, text=True, timeout=300)
    assert "PEAKS" in run.stdout, run.stderr[-2000:]
    return json.loads(run.stdout.rpartition("PEAKS")[2])


@pytest.mark.parametrize("name", ["without_small", "chunk_markdown", "text_chunks", "sentence_spans"])
def test_a_worker_holds_few_rows(peaks, name):
    assert 0 < peaks[name] < 120, peaks


def test_pieces_are_small_and_whole():
    texts = ["x" * (i % 7) for i in range(10_000)] + ["y" * 3_000_000, None, "z" * 900_000, "z" * 900_000]
    got = [c for (c,) in R.pieces([pa.array(texts), pa.array([], pa.string())])]
    assert [t for c in got for t in c.to_pylist()] == texts
    assert all(len(c) <= R.ROWS and (c.nbytes <= R.BYTES or len(c) == 1) for c in got)


def test_cosine_of_odd_vectors(spark):
    """As before, without an expression that Spark interprets for each component."""
    some = [([3.0, 4.0], [4.0, 3.0], 0.96), (None, [1.0], 0.5), ([1.0], None, 0.5), ([0.0, 0.0], [1.0, 2.0], 0.0), ([1.0, None], [1.0, 2.0], None), ([1.0], [1.0, 2.0], None), ([], [], 0.0), ([], [1.0], 0.0)]
    alone = [spark.createDataFrame([r[:2]], "a array<float>, b array<float>").select(C.cosine("a", "b").alias("c")) for r in some]
    told = spark.createDataFrame([r[:2] for r in some], "a array<float>, b array<float>").coalesce(1).select(C.cosine("a", "b").alias("c"))
    assert "lambda" not in told._jdf.queryExecution().optimizedPlan().toString()
    for got in ([r["c"] for r in told.collect()], [f.first()["c"] for f in alone]):
        assert got == [w if w is None else pytest.approx(w) for *_, w in some]


def test_cosine_of_many(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(700, 16)), rng.normal(size=(700, 16))
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))], "i long, a array<double>, b array<double>")
    got = np.array([r["c"] for r in df.select("i", C.cosine("a", "b").alias("c")).orderBy("i").collect()])
    assert np.allclose(got, (a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1))
