import random
import zlib

import numpy as np
import pytest

from chunkloom.llm import packing, tokenfile
from chunkloom.llm.tokens import WordEncoder, default_path

from .odd import ROWS, docs


@pytest.fixture(scope="module")
def words():
    return WordEncoder(default_path(), words_held=500)


def ids_of(words, text):
    return words.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_equal_whole_texts(words):
    rng = random.Random(2)
    pieces = ["The", "the.", "word,", "it's", "'s", "É.", "ÀÉ..,", "x.y", "12.", "<|endoftext|>", "<|ENDOFTEXT|>.", "ΣΑΣ", "İI.", "ª.", "e\u0301", "\u0301", "中文。", "\x1c", "\t", "\n", "  ", "don't,", ".,.", "ÿ", "µ.", "𝔘"]
    texts = [r[1] or "" for r in ROWS] + ["".join(rng.choice(pieces) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    got = [np.frombuffer(x, "<u4").tolist() for x in words.encode(texts)]
    assert got == [ids_of(words, t) for t in texts]


def test_other_tokenizers_encode_whole_texts():
    """A file of another kind isn't cut at spaces."""
    import public_tokenizers

    other = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["The same  text here,\nwith words.", "", " it's\t12 345", "Größe 中文"]
    assert [np.frombuffer(x, "<u4").tolist() for x in other.encode(texts)] == [ids_of(other, t) for t in texts]


def as_bytes(ids):
    return np.asarray(ids, "<u4").tobytes()


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK", 1024)


def test_codec_round_trips(small_blocks):
    rng = np.random.default_rng(1)
    cases = [[], [b""], [as_bytes([5])], [b"", as_bytes([1, 2, 3]), b""], [as_bytes(rng.integers(0, 65536, 5000)), as_bytes(np.full(9000, 2**32 - 1))], [as_bytes(rng.zipf(1.3, 10_000) % 49_000)], [as_bytes(np.tile(np.arange(7), 3000))], [as_bytes([9] * n) for n in (1023, 1, 1024, 1025)], [as_bytes(rng.permutation(16384))]]
    for docs_ in cases:
        assert tokenfile.read_chunk(tokenfile.write_chunk(docs_)) == docs_
    assert len(tokenfile.write_chunk(cases[6])) < 2000


def test_blocks_stand_alone(small_blocks):
    """A block is decoded from its own bytes, and is the same whatever comes before it."""
    rng = np.random.default_rng(5)
    ids = (rng.zipf(1.4, 3 * tokenfile.BLOCK + 77) % 3000).astype("<u4")
    blocks = list(tokenfile.write_blocks(ids))
    parts = [ids[i : i + tokenfile.BLOCK] for i in range(0, len(ids), tokenfile.BLOCK)]
    assert [tokenfile.read_block(b)[0] for b in blocks] == [p.tobytes() for p in parts]
    assert list(tokenfile.write_blocks(parts[2])) == [blocks[2]]
    assert tokenfile.read_block(b"".join(blocks), len(blocks[0])) == (parts[1].tobytes(), len(blocks[0]) + len(blocks[1]))


def test_mixing_beats_order_zero(words):
    """On the test's texts the whole file takes clearly less than the entropy of single ids,
    though each block learns from nothing."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    docs_ = WordEncoder(default_path()).encode([t or "" for t in texts[:600]])
    ids = np.frombuffer(b"".join(docs_), "<u4")
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    bits = 8 * len(tokenfile.write_chunk(docs_)) / len(ids)
    assert bits < -(share * np.log2(share)).sum() - 0.25


def test_codec_finds_damage(small_blocks):
    data = bytearray(tokenfile.write_chunk([np.arange(5_000, dtype="<u4").tobytes()]))
    for at in (0, 20, 60, len(data) // 2, len(data) - 300):
        bad = bytearray(data)
        bad[at] ^= 4
        with pytest.raises(tokenfile.Corrupt):
            tokenfile.read_chunk(bytes(bad))
    with pytest.raises(tokenfile.Corrupt):
        tokenfile.read_chunk(bytes(data[:-8]))


def test_token_files_odd_rows(spark, words):
    got = sorted((r["start"], r["doc_id"] is not None, r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.round_trip(docs(spark).repartition(3)).collect())
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for r in rows:
        ids = np.array(ids_of(words, r[1]) + [2], "<u4")
        want.append((at, r[0] is not None, r[0], len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert tokenfile.round_trip(docs(spark, [])).count() == 0


def test_packing_odd_rows(spark, words):
    got = packing.pack(docs(spark)).collect()
    ids = [np.array(ids_of(words, r[1]) + [1], "<u4") for r in ROWS]
    assert sum(r["length"] for r in got) == sum(map(len, ids))
    texts = {}
    for r, x in zip(ROWS, ids):
        texts.setdefault(r[0], []).append(x)
    for r in got:
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in texts[r["doc_id"]])
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in got])
    assert packing.pack(docs(spark, [])).count() == 0


def check_sequences(pieces):
    ends = {}
    for s, o, n in sorted(pieces):
        assert n > 0 and o == ends.get(s, 0)
        ends[s] = o + n
    assert all(n <= 2048 for n in ends.values())
    return sum(2048 - n for n in ends.values() if n & (n - 1))


@pytest.mark.parametrize("seed", range(6))
def test_plans(seed):
    rng = np.random.default_rng(seed)
    lengths = [np.array([], int), np.array([1]), np.full(300, 1024), np.full(7, 2048), rng.integers(1, 9000, 500), np.minimum(rng.zipf(1.2, 3000), 50_000)][seed]
    doc, start, length, seq, offset, n = packing.plan(lengths.astype(np.int64))
    assert check_sequences(zip(seq.tolist(), offset.tolist(), length.tolist())) == 0
    assert sorted(set(seq.tolist())) == list(range(n))
    ends = {}
    for d, s, k in sorted(zip(doc.tolist(), start.tolist(), length.tolist())):
        assert s == ends.get(d, 0)
        ends[d] = s + k
    assert [ends[d] for d in range(len(lengths))] == lengths.tolist()


def test_combinations_fill_windows():
    rng = np.random.default_rng(0)
    counts = np.bincount(rng.integers(1, 2048, 5000), minlength=2048)
    combos = packing.combinations(counts)
    assert (combos.sum(axis=1) == 2048).all() and (counts[combos[combos > 0]] > 0).all()
    x = packing.repeat_counts(combos, counts)
    times = packing.rounded(combos, x, counts)
    used = np.bincount(combos.ravel(), np.repeat(times, 3), 2048)
    assert (x >= 0).all() and (used[1:] <= counts[1:]).all() and used[1:].sum() > 0.6 * counts.sum()


def test_all_combinations_are_found():
    counts = np.bincount(np.random.default_rng(2).integers(1, 40, 60), minlength=40)
    have = [k for k in range(1, 40) if counts[k]]
    want = {(a, b, 0) for a in have for b in have if a <= b and a + b == 40}
    want |= {(a, b, c) for a in have for b in have for c in have if a <= b <= c and a + b + c == 40}
    got = list(map(tuple, packing.combinations(counts).tolist()))
    assert len(got) == len(set(got)) and set(got) == want


def test_most_ids_lie_in_combinations():
    """Of blocks of some thousand documents, what combinations fill grows with the block."""
    rng = np.random.default_rng(4)
    shares = []
    for n in (500, 4000):
        rest = rng.lognormal(6.2, 1, n).astype(int) % 2048
        counts = np.bincount(rest[rest > 0], minlength=2048)
        combos = packing.combinations(counts)
        times = packing.rounded(combos, packing.repeat_counts(combos, counts), counts)
        shares.append(2048 * times.sum() / rest.sum())
    assert shares[0] > 0.8 and shares[1] > 0.85


def test_a_worker_keeps_one_operator_s_memory():
    """Workers live on through all stages: what the operator before kept is let go."""
    from chunkloom.llm import langid, simhash, tokens

    tokens.encoder(default_path()).encode(["some words"])
    assert tokens.encoder(default_path()).held
    langid.predict({"en": "the words of a text", "de": "die Worte"}, ["the words"])
    assert langid._parsers and not tokens._encoders
    langid.predict({"en": "the words of a text", "de": "die Worte"}, ["the words"])
    assert langid._parsers
    list(simhash._fingerprints([]))
    assert not langid._parsers
    tokens.encoder(default_path())
    list(tokenfile._reader([]))
    assert not tokens._encoders


def test_many_blocks_are_coded_at_once(monkeypatch):
    """Some hundred blocks of one width, as a task has, take one run; their bytes don't depend on it."""
    monkeypatch.setattr(tokenfile, "BLOCK", 64)
    rng = np.random.default_rng(3)
    ids = (rng.zipf(1.3, 700 * 64) % 3000).astype("<u4")
    runs, encode = [], tokenfile.encode_places
    monkeypatch.setattr(tokenfile, "encode_places", lambda *a: runs.append(1) or encode(*a))
    once = list(tokenfile.write_blocks(ids))
    assert len(once) == 700 and len(runs) == 1
    monkeypatch.setattr(tokenfile, "LANES", 1024)
    assert list(tokenfile.write_blocks(ids)) == once


def chunk_rows(spark, cases):
    """One row a case, as the writer gives them to the coder."""
    rows = [(i, b"".join(np.array([len(x) // 4], "<i8").tobytes() for x in docs_), b"".join(docs_)) for i, docs_ in enumerate(cases)]
    return spark.createDataFrame(rows, "i int, lengths binary, ids binary")


def test_spark_s_jvm_codes_the_same(spark, words, monkeypatch):
    """The coder that queries run and numpy's write the same code words and read each other's."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(tokenfile, "BLOCK", 4096)
    rng = np.random.default_rng(8)
    wide = rng.permutation(2**16)[:6000]
    cases = [[], [b""], [as_bytes([5])], [b"", as_bytes([1, 2, 2**32 - 1]), b"", as_bytes([2**31, 2**17])], [as_bytes(wide)], [as_bytes(rng.zipf(1.3, 30_000) % 49_000)], [as_bytes(rng.integers(0, 3000, 9000)), as_bytes([7] * 9000)], [as_bytes(np.tile(np.arange(1400), 30))], [as_bytes(rng.zipf(1.1, 20_000) % 2**32)], [as_bytes(np.repeat(rng.permutation(300), 90))]]
    cases.append([x + as_bytes([2]) for x in words.encode(["The words of a text, and the words after."] * 500)])
    write = tokenfile.java_function(spark, "TokenCoder", "Write", "binary")
    read = tokenfile.java_function(spark, "TokenCoder", "Read", "array<struct<start:long,ids:binary>>")
    coded = chunk_rows(spark, cases).repartition(3).withColumn("data", write("lengths", "ids", F.lit(tokenfile.BLOCK)))
    for row in coded.collect():
        docs_, data = cases[row["i"]], bytes(row["data"])
        assert tokenfile.read_chunk(data) == docs_
        flat, at = np.frombuffer(b"".join(docs_), "<u4"), 20 + int.from_bytes(data[16:20], "little")
        for block in tokenfile.write_blocks(flat):
            want, got = tokenfile._parsed(block, 0), tokenfile._parsed(data, at)
            at = got[-1]
            assert got[:2] == want[:2] and got[2].tolist() == want[2].tolist() and got[3].tolist() == want[3].tolist()
        assert at == len(data)
    chunks = spark.createDataFrame([(i, tokenfile.write_chunk(x)) for i, x in enumerate(cases)], "i int, data binary")
    for row in chunks.select("i", read("data", F.lit(tokenfile.BLOCK)).alias("docs")).collect():
        docs_ = cases[row["i"]]
        assert [bytes(d["ids"]) for d in row["docs"]] == docs_
        assert [d["start"] for d in row["docs"]] == [sum(len(y) // 4 for y in docs_[:k]) for k in range(len(docs_))]


def test_spark_s_jvm_codes_the_widest_symbols(spark):
    from pyspark.sql import functions as F

    ids = as_bytes(np.random.default_rng(9).permutation(2**16))  # 2 ** 14 distinct ids a block
    write = tokenfile.java_function(spark, "TokenCoder", "Write", "binary")
    read = tokenfile.java_function(spark, "TokenCoder", "Read", "array<struct<start:long,ids:binary>>")
    coded = chunk_rows(spark, [[ids]]).select(write("lengths", "ids", F.lit(tokenfile.BLOCK)).alias("data"))
    assert bytes(coded.select(read("data", F.lit(tokenfile.BLOCK)).alias("docs")).first()["docs"][0]["ids"]) == ids


def test_spark_s_jvm_finds_damage(spark, small_blocks):
    from pyspark.sql import functions as F

    data = tokenfile.write_chunk([np.arange(5_000, dtype="<u4").tobytes()])
    read = tokenfile.java_function(spark, "TokenCoder", "Read", "array<struct<start:long,ids:binary>>")
    bad = [data[:at] + bytes([data[at] ^ 4]) + data[at + 1 :] for at in (0, 20, 60, len(data) // 2, len(data) - 300)] + [data[:-8], b""]
    for x in bad:
        with pytest.raises(Exception, match="Corrupt"):
            spark.createDataFrame([(x,)], "data binary").select(F.size(read("data", F.lit(tokenfile.BLOCK)))).collect()


def test_files_without_the_jvm(spark):
    """Numpy writes and reads the same files where Java can't be compiled."""
    told = [sorted(tokenfile.round_trip(docs(spark).repartition(3), in_jvm=x).collect(), key=repr) for x in (True, False)]
    assert told[0] == told[1] and len(told[0]) == len(ROWS)
