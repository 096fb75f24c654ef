"""The embedder over a real ONNX file: a table of word vectors, written here byte by byte."""

import json

import numpy as np
import pytest

import chunkloom
from chunkloom.functions import embed
from chunkloom.functions import values as V
from chunkloom.plans.kernel import Element

WORDS = ["[UNK]", "[CLS]", "[SEP]", *(f"cat{i}" for i in range(40)), *(f"law{i}" for i in range(40))]


def field(number, value):
    """A field of a protocol buffer: a number, or anything of a length."""
    size = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + size(n >> 7)
    if isinstance(value, int):
        return size(number << 3) + size(value)
    value = value.encode() if isinstance(value, str) else value
    return size(number << 3 | 2) + size(len(value)) + value


def model_bytes(table):
    axes = lambda *names: b"".join(field(1, field(2, n)) for n in names)
    value = lambda name, kind, shape: field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))
    node = field(1, "words") + field(1, "input_ids") + field(2, "last_hidden_state") + field(4, "Gather")
    words = b"".join(field(1, n) for n in table.shape) + field(2, 1) + field(8, "words") + field(9, table.astype("<f4").tobytes())
    graph = field(1, node) + field(2, "g") + field(5, words)
    graph += field(11, value("input_ids", 7, axes("b", "s"))) + field(11, value("attention_mask", 7, axes("b", "s")))
    graph += field(12, value("last_hidden_state", 1, axes("b", "s", "d")))
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("cache") / "org--words"
    (top / "onnx").mkdir(parents=True)
    rng = np.random.default_rng(0)
    subject = rng.normal(size=(2, V.DIMENSIONS))
    table = np.array([np.zeros(V.DIMENSIONS) if w.startswith("[") else subject[int(w.startswith("law"))] + 0.3 * rng.normal(size=V.DIMENSIONS) for w in WORDS])
    (top / "onnx" / "model.onnx").write_bytes(model_bytes(table))
    piece = {"type": "WordLevel", "vocab": {w: i for i, w in enumerate(WORDS)}, "unk_token": "[UNK]"}
    (top / "tokenizer.json").write_text(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "Whitespace"}, "post_processor": None, "decoder": None, "model": piece}))
    (top / ".download_complete").touch()
    return str(top)


def said(kind, n):
    return " ".join(f"{kind}{i % 40} {kind}{(i * 7 + 1) % 40} {kind}{(i * 3) % 40}." for i in range(n))


def test_vectors_are_means_of_their_words(folder, monkeypatch):
    got = embed.ModelEmbedder(folder)
    assert got.available and got.count("cat1 law2. nothing") == 4
    vectors = got.sentences(["cat1 cat2", "cat3", "law3 law4 law5", "cat1 " * 500])
    assert vectors.shape == (4, V.DIMENSIONS) and np.allclose(np.linalg.norm(vectors, axis=1), 1, atol=1e-5)
    assert embed.cosine(vectors[0], vectors[1]) > 0.5 > embed.cosine(vectors[0], vectors[2])
    assert got.sentences([]).shape == (0, V.DIMENSIONS)
    assert np.allclose(got.sentence("cat3"), vectors[1], atol=1e-6)
    monkeypatch.setenv("MODEL_CACHE_DIR", folder.rsplit("/", 1)[0])
    embed.release()
    assert embed.embedder("org/words").available and not embed.embedder(None).available
    with pytest.raises(FileNotFoundError):
        embed.embedder("org/missing")


def test_subjects_part_chunks(spark, folder):
    """Where the subject changes after enough tokens a chunk ends, in memory and in frames."""
    text = said("cat", 60) + " " + said("law", 60)
    want = chunkloom.chunk_elements([Element("text", text, 1)], chunkloom.Options(overlap_tokens=0), embed.ModelEmbedder(folder))
    assert [("cat" in c.content, "law" in c.content) for c in want] == [(True, False), (False, True)]
    assert len(chunkloom.chunk_elements([Element("text", text, 1)], chunkloom.Options(overlap_tokens=0))) == 1
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = chunkloom.chunk_markdown(docs, overlap_tokens=0, model_dir=folder).orderBy("sequence").collect()
    assert [(r["content"], r["token_count"]) for r in got] == [(c.content, c.token_count) for c in want]
