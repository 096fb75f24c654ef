import json
import subprocess
import sys
import urllib.error
import urllib.request

import pytest

import chunkloom
from chunkloom.functions import models
from chunkloom.functions.registered import register
from chunkloom.plans.kernel import Element
from chunkloom.plans.server import serving
from chunkloom.plans.service import BadRequest, chunk_request
from chunkloom.sources import sinks
from chunkloom.streaming.chunks import chunk_stream, read_texts

TEXT = "# Top\n\n" + " ".join(f"Sentence {i} says a{i} b{i} c{i}." for i in range(120)) + "\n\n## Part\n\n```py\ndef f():\n    return 1\n```\n"
PARSED = {"pages": [{"page_number": 1, "regions": [{"type": "title", "content": "Top", "page": 1, "bbox": {"x_min": 900, "x_max": -5, "extra": 1}}, {"element_type": "text", "content": TEXT[7:2000], "page": 1, "start_time": 1.5, "metadata": {"type": "abstract"}}]}], "metadata": None}


def test_frames_equal_the_kernel(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "  ")], "doc_id long, text string")
    got = chunkloom.make_chunker(max_tokens=200).markdown(docs).orderBy("doc_id", "sequence").collect()
    want = chunkloom.chunk_elements([Element(k, c, 1, m or {}) for k, c, m in chunkloom.parse_markdown(TEXT)], chunkloom.Options(max_tokens=200))
    assert [(r["content"], r["token_count"], r["span_start"], r["dominant_type"], json.loads(r["metadata"])) for r in got] == [(c.content, c.token_count, c.span_start, c.dominant_type, c.metadata) for c in want]
    two_steps = chunkloom.chunk_documents(chunkloom.markdown_documents(docs), max_tokens=200).orderBy("doc_id", "sequence").collect()
    assert [r["content"] for r in two_steps] == [c.content for c in want]


def test_parsed_documents(spark):
    docs = chunkloom.from_dicts(spark, [PARSED, {"pages": []}])
    rows = chunkloom.explode_elements(docs).orderBy("ord").collect()
    assert [(r["kind"], r["bbox"]["x_min"], r["bbox"]["x_max"], r["bbox"]["y_max"]) for r in rows] == [("title", 0, 900, 1000), ("text", 0, 1000, 1000)]
    assert json.loads(rows[1]["metadata"]) == {"type": "abstract", "start_time": 1.5}
    chunks = chunkloom.chunk_documents(docs)
    first = chunks.orderBy("sequence").first()
    metadata = json.loads(first["metadata"])
    assert first["content"].startswith("Top\n\n") and metadata["section_type"] == "abstract" and metadata["start_time"] == 1.5
    assert [r["content"] for r in chunks.orderBy("sequence").collect()] == [c["content"] for c in chunk_request({"document": PARSED})["chunks"]]
    totals = {r["doc_id"]: r for r in sinks.responses(docs, chunks).collect()}
    assert totals[1]["num_chunks"] == 0 and totals[1]["avg_tokens"] == 0 and totals[0]["num_chunks"] == chunks.count()
    again = chunkloom.decode_documents(chunkloom.sources.documents.encode_documents(docs))
    plain = lambda d: [(*r[:-1], json.loads(r["metadata"] or "{}")) for r in chunkloom.explode_elements(d).orderBy("doc_id", "ord").collect()]
    assert plain(again) == plain(docs) and again.select("pages.page_number", "pages.width").collect() == docs.select("pages.page_number", "pages.width").collect()


def test_values_keep_their_types(spark):
    """Fractions of boxes, and numbers, flags and nested values of metadata, there and back."""
    metadata = {"level": 2, "score": 0.25, "flag": False, "none": None, "nested": {"a": [1, "x", {"b": True}]}, "text": 'say "hi", é'}
    some = [
        {"type": "text", "content": "a", "bbox": {"x_min": 10.5, "y_min": 20.2, "x_max": 300.7, "y_max": 400.1}, "metadata": metadata, "end_time": 7, "start_time": "0:01", "words": [{"w": "a", "t": 1.5}]},
        {"type": "text", "content": "b", "bbox": {"x_min": 1200.5, "x_max": -3.5}, "metadata": {}, "end_time": None},
        {"type": "text", "content": "c", "metadata": {"end_time": 3}, "end_time": 4},
    ]
    docs = chunkloom.from_dicts(spark, [{"pages": [{"page_number": 1, "width": 612.5, "elements": some}], "metadata": {"n": 1, "deep": {"x": [True]}}}])
    rows = chunkloom.explode_elements(docs).orderBy("ord").collect()
    assert [tuple(r["bbox"]) for r in rows] == [(10.5, 20.2, 300.7, 400.1), (0.0, 0.0, 1000.0, 1000.0), (0.0, 0.0, 1000.0, 1000.0)]
    assert json.loads(rows[0]["metadata"]) == metadata | {"start_time": "0:01", "end_time": 7, "words": [{"w": "a", "t": 1.5}]}
    assert json.loads(rows[1]["metadata"]) == {"end_time": None} and json.loads(rows[2]["metadata"]) == {"end_time": 3}
    out = json.loads(chunkloom.sources.documents.encode_documents(docs).first()["json"])
    assert out["metadata"] == {"n": 1, "deep": {"x": [True]}} and out["pages"][0]["width"] == 612.5
    assert out["pages"][0]["elements"][0]["metadata"] | {"none": None} == metadata | {"start_time": "0:01", "end_time": 7, "words": [{"w": "a", "t": 1.5}]}
    bare = chunkloom.from_dicts(spark, [{"pages": [{"page_number": 1, "elements": [{"content": "x", "metadata": {}}, {"content": "y", "metadata": [1]}]}]}])
    assert [r["metadata"] for r in chunkloom.explode_elements(bare).collect()] == [None, None]
    assert "metadata" not in json.loads(chunkloom.sources.documents.encode_documents(bare).first()["json"])["pages"][0]["elements"][0]


def test_records_hold_all_keys(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    chunks = chunkloom.chunk_markdown(docs)
    want = [vars(c) for c in chunkloom.chunk_elements([Element(k, c, 1, m or {}) for k, c, m in chunkloom.parse_markdown(TEXT)])]
    got = [json.loads(r["record"]) for r in sinks.records(chunks).orderBy("sequence").collect()]
    assert got == want and all(len(r) == 14 and isinstance(r["metadata"], dict) for r in got)
    assert json.loads(sinks.as_json(chunks).first()["json"]) == want


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(PARSED))
    (tmp_path / "b.md").write_text(TEXT)
    assert chunkloom.read_json(spark, str(tmp_path / "a.json")).first()["doc_id"].endswith("a.json")
    chunks = chunkloom.chunk_markdown(chunkloom.read_markdown(spark, str(tmp_path / "b.md")))
    sinks.write_jsonl(chunks, str(tmp_path / "out"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(x["sequence"] for x in lines) == list(range(chunks.count()))
    assert json.loads(sinks.as_json(chunks).first()["json"])[0]["sequence"] == 0
    assert "tok" in sinks.summary(chunks).first()["line"]


def test_parents(spark):
    code = "\n\n".join(f"def f{i}(x):\n" + "\n".join(f"    y{j} = x + {j}" for j in range(40)) for i in range(9))
    docs = spark.createDataFrame([(1, f"```py\n{code}\n```")], "doc_id long, text string")
    got = sinks.with_parent(chunkloom.chunk_markdown(docs)).orderBy("sequence").collect()
    assert [r["parent_sequence"] for r in got] == [None] + [0] * 9


BAD = (
    [], {}, {"text": "a", "document": PARSED}, {"text": "a", "max_tokens": 0}, {"text": "a", "overlap_tokens": 10_001}, {"text": 5}, {"text": ["a"]},
    {"document": []}, {"document": {"pages": [{}]}}, {"document": {"pages": ["x"]}}, {"document": {"pages": {"a": 1}}}, {"document": {"pages": [{"page_number": 1, "elements": ["x"]}]}},
)


def test_requests():
    assert chunk_request({"text": ""}) == {"num_chunks": 0, "avg_tokens": 0.0, "chunks": []}
    for body in BAD:
        with pytest.raises(BadRequest):
            chunk_request(body)


def test_server():
    with serving(port=0) as url:

        def ask(path, body=None):
            data = None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode()
            try:
                with urllib.request.urlopen(urllib.request.Request(url + path, data=data), timeout=20) as got:
                    return got.status, json.load(got)
            except urllib.error.HTTPError as e:
                return e.code, json.load(e)

        assert ask("/healthz") == (200, {"status": "ok"})
        assert ask("/info") == (200, {"version": chunkloom.__version__, "embeddings_available": False})
        assert ask("/chunk", {"text": TEXT, "max_tokens": 300}) == (200, json.loads(json.dumps(chunk_request({"text": TEXT, "max_tokens": 300}))))
        assert ask("/chunk", {"document": PARSED})[1]["num_chunks"] > 0
        assert [ask("/chunk", body)[0] for body in BAD] == [422] * len(BAD)
        assert ask("/chunk", b"{not json")[0] == 422 and "detail" in ask("/chunk", b"")[1]
        assert ask("/nowhere")[0] == 404 and ask("/chunk")[0] == 405 and ask("/healthz", {})[0] == 405


def test_older_name(caplog):
    assert [(e.kind, e.content, e.page) for e in chunkloom.parse_full_page_output("# A\n\nb", 3)] == [("section_header", "A", 3), ("text", "b", 3)]
    with caplog.at_level("INFO", "chunkloom"):
        chunkloom.chunk_elements(chunkloom.parse_full_page_output(TEXT, 1))
        chunkloom.chunk_elements([])
    assert [r.getMessage().split()[0] for r in caplog.records] == ["3", "0"]


def test_command_line(tmp_path):
    run = lambda *args, text=None: subprocess.run([sys.executable, "-m", "chunkloom", *args], input=text, capture_output=True, text=True, check=False)
    assert "prose" in run("-", text=TEXT).stdout
    (tmp_path / "a.json").write_text(json.dumps(PARSED))
    assert run(str(tmp_path / "a.json"), "--format", "jsonl", "-o", str(tmp_path / "o")).returncode == 0
    assert json.loads((tmp_path / "o").read_text().splitlines()[0])["sequence"] == 0
    assert run("-", "--max-tokens", "0", text=TEXT).returncode == 2
    broken = run("-", "--input-format", "json", text="{")
    assert broken.returncode == 2 and "Traceback" not in broken.stderr
    assert run(str(tmp_path / "none.md")).returncode == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text(TEXT)
    query = chunk_stream(read_texts(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("streamed").start()
    query.processAllAvailable()
    (tmp_path / "in" / "b.md").write_text(TEXT)
    query.processAllAvailable()
    query.stop()
    got = spark.table("streamed").groupBy("doc_id").count().collect()
    assert len(got) == 2 and len({r["count"] for r in got}) == 1


def test_sql_functions(spark):
    assert set(register(spark)) == {"markdown_elements", "sentence_spans", "collapse_spans", "split_code"}
    row = spark.sql("SELECT size(markdown_elements('# a')) AS a, size(sentence_spans('A b. C d.')) AS b, collapse_spans('a b c d a b c d') AS c, split_code('x', 'py')[0].type AS d").first()
    assert tuple(row) == (1, 2, "a b c d", "module")


def test_model_names(tmp_path, monkeypatch):
    assert models.folder_name("org/name") == "org--name" and models.model_id("org--name") == "org/name"
    for bad in ("../x", ".x", "a/../b", ""):
        with pytest.raises(ValueError):
            models.folder_name(bad)
    monkeypatch.setenv("MODEL_CACHE_DIR", str(tmp_path))
    assert models.local_model("org/name") is None
    (tmp_path / "org--name").mkdir()
    (tmp_path / "org--name" / ".download_complete").touch()
    assert models.local_model("org/name") == str(tmp_path / "org--name")
