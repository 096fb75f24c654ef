import random
import re
import textwrap
import unicodedata
import zlib

import numpy as np
import pytest

from chunkloom.llm import langid, licenses, quality
from chunkloom.llm.licenses import compile_rules, normalise, scan_licenses

from .odd import ROWS, docs


def plain_phrases(sample, text):
    """Greedy longest matches by searching substrings."""
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in sample:
            k += 1
        n, i = n + 1, i + k
    return n


def letters_of(text):
    return "".join(map(chr, langid.folded(text)))


def check_phrases(sample, texts):
    parser = langid.CrossParser(sample)
    for text, bits in zip(texts, parser.bits([langid.folded(t) for t in texts])):
        text = letters_of(text)
        for j, lang in enumerate(parser.langs):
            assert round(bits[j] * len(text) / parser.price[j]) == plain_phrases(letters_of(sample[lang]), text)


def test_cross_parsing_counts_phrases():
    """Of whole texts, also those of many segments and those in which two parses that begin
    at different letters never meet."""
    rng = random.Random(4)
    sample = {k: "".join(rng.choice(letters) for _ in range(400)) for k, letters in (("a", "abcd "), ("b", "cdef "), ("c", "aaab "))}
    texts = ["".join(rng.choice("abcdefx ") for _ in range(n)) for n in (1, 7, 90, 700, 1024, 1025, 2048, 5000)]
    check_phrases(sample, [*texts, "a" * 7001, "ab" * 3000, "abcd" * 2000 + "x" * 1500, "x" * 3000])


def test_cross_parsing_of_many_letters():
    """Scripts of thousands of letters: each is a letter of its own."""
    rng = random.Random(9)
    signs = [chr(0x4E00 + i) for i in range(3000)]
    sample = {"zh": "".join(rng.choice(signs) for _ in range(4000)), "ko": "".join(chr(0xAC00 + rng.randrange(900)) for _ in range(2000)), "en": "the quick brown fox"}
    texts = [sample["zh"][100:160] + "fox" + "".join(rng.choice(signs) for _ in range(1500)), "the fox" + sample["ko"][5:1800]]
    check_phrases(sample, texts)
    parser = langid.CrossParser(sample)
    assert parser.owner.nbytes + parser.to.nbytes < 2_000_000


def test_predictions_are_of_the_fewest_bits(spark):
    """The query's rows against a search for substrings, on whole texts."""
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect() if r["text"]][:25]
    samples = {"x": rows[0]["text"][:900], "y": rows[1]["text"][:700], "z": rows[2]["text"][:1100]}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(spark.createDataFrame(rows), samples=samples, lang_col="text").collect()}
    for r in rows:
        text = letters_of(r["text"])
        if not text:
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        bits = sorted((plain_phrases(letters_of(s), text) * np.log2(len(letters_of(s))), k) for k, s in samples.items())
        assert got[r["doc_id"]][0] == bits[0][1]
        assert abs(got[r["doc_id"]][1] - (1 - bits[0][0] / bits[1][0])) < 1e-9


def test_folding():
    assert letters_of("Ab1 2cÉ!!") == "ab cé "
    assert letters_of("12 !") == "" and letters_of("") == ""
    assert letters_of("𝔘x") == "𝔘x"


def test_language_odd_rows(spark):
    samples = {"en": "the same text here with words enough and a text without an id", "de": "ein deutscher satz über größe und maß der dinge"}
    got = langid.identify(docs(spark), samples=samples)
    assert got.columns == ["doc_id", "text", "lang", "source", "keep_id", "lang_pred", "score"]
    rows = {r["text"]: r for r in got.collect()}
    assert [rows[t]["lang_pred"] for t in (None, "", " \t\n ", "12 345 !!")] == ["und"] * 4
    assert rows[ROWS[0][1]]["lang_pred"] == "en" and rows[ROWS[10][1]]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert langid.identify(docs(spark, [])).count() == 0
    unlabelled = [(1, "some text", None, "a", 1, "x")]
    assert langid.identify(docs(spark, unlabelled)).collect()[0]["lang_pred"] == "und"


def test_language_of_long_documents_only(spark):
    """A language whose labelled documents are all long, or short ones have no letter, is learned."""
    english = "the quick brown fox jumps over the lazy dog and then sleeps "
    dutch = "de snelle bruine vos springt over de luie hond en gaat daarna slapen "
    rows = [(i, english, "en", "a", 1, "x") for i in range(1, 9)]
    rows += [(i, "12 345 - " + dutch * 900, "nl", "book", 1, "x") for i in range(11, 19)] + [(i, "12 34", "nl", "a", 1, "x") for i in range(21, 29)]
    sample = langid.training_sample(docs(spark, rows), "doc_id", "text", "lang")
    assert sorted(sample) == ["en", "nl"] and "de snelle" in sample["nl"][:20] and langid.TRAIN_DOC_CHARS <= len(sample["nl"]) <= langid.TRAIN_CHARS
    got = langid.identify(docs(spark, rows)).where("doc_id between 11 and 18").collect()
    assert {r["lang_pred"] for r in got} == {"nl"}
    books = [r for r in rows if r[3] == "book"]
    assert list(langid.training_sample(docs(spark, books), "doc_id", "text", "lang")) == ["nl"]


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in langid.identify(d).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97


def test_quality_held_out(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = [r for r in quality.classify(d, labels).collect() if r["held_out"] and r["doc_id"] in known]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)
    assert np.mean([r["predicted"] == known[r["doc_id"]] for r in got]) > 0.95


def test_quality_columns_equal_the_model(spark):
    rng = np.random.default_rng(3)
    x = rng.random((400, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 4] <= 0.7)).astype(int)
    model = quality.fit_rules(x, y)
    assert np.mean((model.score(x) >= 0.5) == y) > 0.95
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in quality.STATISTICS))
    got = [r[0] for r in rows.select(model.column()).collect()]
    assert np.allclose(sorted(got), sorted(model.score(x)))


def plain_statistics(text):
    """Statistics of a whole text, counted in Python."""
    t = text or ""
    words, lines = re.split(r"[ \t\n\x0b\f\r]+", t.strip(" ")), t.split("\n")
    chars, n = max(1, len(t)), max(1, len(words))
    count = lambda fits: sum(map(fits, t))
    kind = [unicodedata.category(c) for c in t]
    symbols = sum(not (k[0] in "LN" or c in " \t\n\x0b\f\r.,;:'\"()?!|-") for c, k in zip(t, kind))
    same = sum(a == b for a, b in zip(words, words[1:]))
    return [
        np.log1p(n), len(t) / n, len(set(words)) / n, same / n, symbols / chars, sum(k == "Lu" for k in kind) / chars,
        count(lambda c: c in "0123456789") / chars, count(lambda c: c == "!") / n, count(lambda c: c == "|") / n, count(lambda c: c == ".") / n,
        len(lines) / n, 1 - len(set(lines)) / len(lines),
    ]


def test_quality_query_equals_brute_force(spark):
    """Scores of all documents, from statistics counted in Python over whole texts and the
    rules applied one by one."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    rows = [tuple(r) for r in d.select("doc_id", "text").collect()] + [(-1, None), (-2, "")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.train(documents, labels)
    assert model.rules
    want = model.score(np.array([plain_statistics(t) for _, t in rows]))
    got = {r["doc_id"]: r for r in quality.classify(documents, labels).collect()}
    for (i, _), w in zip(rows, want):
        assert abs(got[i]["score"] - w) < 1e-9 and got[i]["predicted"] == (w >= 0.3) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_held_out_labels_never_train(spark):
    """Labels of held-out rows turned round change nothing."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "if(crc32(encode(string(doc_id), 'UTF-8')) % 5 = 0, 1 - quality, quality) AS quality")
    assert quality.train(d, labels) == quality.train(d, turned)


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (8, None), (None, 1)], "doc_id long, quality int")
    got = quality.classify(docs(spark), labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    none = quality.classify(docs(spark), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.classify(docs(spark, []), labels).count() == 0


def wrapped(sentences, mark="", width=74):
    """Paragraphs broken into lines, each behind a comment mark, with empty lines between."""
    lines = []
    for s in sentences:
        lines += [*textwrap.wrap(s, width), ""]
    return "\n".join(f"{mark} {x}".rstrip() if mark else x for x in lines)


NAMED = dict(licenses.NOTICES)
PUBLISHED = {
    "MIT": ("MIT License", "Copyright (c) 2024 Jane Doe", *NAMED["MIT"], 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.'),
    "BSD-2-Clause": ("Copyright (c) 2024, Jane Doe", "All rights reserved.", NAMED["BSD-2-Clause"][0], "1. " + NAMED["BSD-2-Clause"][1], "2. " + NAMED["BSD-2-Clause"][2]),
    "BSD-3-Clause": (NAMED["BSD-3-Clause"][0], *(f"* {s}" for s in NAMED["BSD-3-Clause"][1:])),
    "Apache-2.0": ("Copyright 2024 Jane Doe", " ".join(NAMED["Apache-2.0"]), "http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software is distributed on an \"AS IS\" BASIS."),
    "GPL-3.0-or-later": (NAMED["GPL-3.0-or-later"][0], "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY."),
    "GPL-2.0-or-later": NAMED["GPL-2.0-or-later"],
    "LGPL-2.1-or-later": NAMED["LGPL-2.1-or-later"],
    "AGPL-3.0-or-later": NAMED["AGPL-3.0-or-later"],
    "MPL-2.0": (" ".join(licenses.NOTICES[9][1]),),
    "ISC": ("Copyright (c) 2024, Jane Doe <jane@example.com>", *NAMED["ISC"]),
    "Zlib": (" ".join(NAMED["Zlib"][:2]), NAMED["Zlib"][2]),
}


@pytest.mark.parametrize("mark", ["", "//", "#", " *", "--", ";;", "%", ">"])
def test_published_notices(spark, mark):
    """Notices in their published layout, wrapped and behind comment marks, among code."""
    rows = [(i, f"int x;\n\n{wrapped(some, mark, 60 + i)}\nint main() {{ return 0; }}", name, "a", 1, "x") for i, (name, some) in enumerate(PUBLISHED.items())]
    got = {r["doc_id"]: r["licenses"] for r in scan_licenses(docs(spark, rows)).collect()}
    assert got == {r[0]: r[2] for r in rows}


def test_licenses(spark):
    mit = " ".join(NAMED["MIT"])
    texts = {
        1: ("Intro without a mark\nReleased under the MIT License.\nMore text.", "MIT (named)"),
        2: (f"/* {mit} */".replace("copies of the", "copies\n   of the"), "MIT"),
        3: (NAMED["MIT"][1] + " " + NAMED["MIT"][0], ""),  # out of order
        4: (None, ""),
        5: ("", ""),
        6: ("Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.", "Apache-2.0 (named),CC-BY-NC-4.0 (named)"),
        7: ("The license of a driver.", ""),
        8: ("# SPDX-License-Identifier: BSD-3-Clause\nimport os", "BSD-3-Clause (tagged)"),
        9: ("Licensed under the BSD 3-Clause License.", "BSD-3-Clause (named)"),
        10: (wrapped(PUBLISHED["BSD-3-Clause"]) + "\n\n" + wrapped(PUBLISHED["BSD-2-Clause"]), "BSD-2-Clause,BSD-3-Clause"),
        11: ("A title\nThis work is licensed under the GNU General Public License, version 3\nby its author", "GPL-3.0 (named)"),
        12: (f"x. {mit} y " * 300, "MIT"),
    }
    rows = [(i, t, "en", "a", 1, "x") for i, (t, _) in texts.items()]
    got = {r["doc_id"]: r["licenses"] for r in scan_licenses(docs(spark, rows)).collect()}
    assert got == {i: want for i, (_, want) in texts.items()}
    assert scan_licenses(docs(spark)).count() == len(ROWS)
    assert scan_licenses(docs(spark, [])).count() == 0


def test_licenses_equal_sql(spark):
    """The SQL, which cuts and numbers by itself, on notices of several sentences."""
    import duckdb

    texts = [wrapped(some, mark) for some in PUBLISHED.values() for mark in ("", "//", ";")]
    texts += ["\n\n".join(map(wrapped, PUBLISHED.values())), wrapped(PUBLISHED["BSD-3-Clause"] * 2), None, "", "Released under MIT\nx"]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = duckdb.connect().execute(licenses.oracle().replace("FROM documents", "FROM (SELECT unnest(?) AS doc_id, unnest(?) AS text)"), [list(range(len(texts))), texts]).fetchall()
    assert sorted(map(tuple, scan_licenses(documents).collect())) == sorted(want)
    assert sum(len(r[1]) > 0 for r in want) == len(texts) - 2


def test_license_sentences():
    known, rules = compile_rules(licenses.all_rules())
    assert len(rules) == len(licenses.all_rules()) and all(any(a in s for a in licenses.ANCHORS) for s in known)
    assert normalise("One (two), three! Four v2.0.\nFive\nsix\n\nseven") == ["one two three", "four v2.0", "five six", "seven"]
    with pytest.raises(ValueError):
        compile_rules([("none", ("Nothing here.",))])
