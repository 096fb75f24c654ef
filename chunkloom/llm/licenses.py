"""Licence scan by sentence rules.

Texts are cut into sentences and normalised; sentences known from licences become
identifiers, all others vanish; the sequence of identifiers is then matched against
ordered licence rules. All of it happens within a row: no shuffle, no Python.

A sentence may run over line ends, comment marks before its lines included; it ends at a
mark before white space, at an empty line, or at the text's end. What is no known sentence
so, is looked through line by line, as single lines often stand without a mark.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GNU = (
    "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License"
    " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
)
_OLDER_GNU = (
    "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License"
    " as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
    " disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
    " disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
    " derived from this software without specific prior written permission.",
)

# Wording of public licence notices, in the order of their rules.
NOTICES: tuple[tuple[str, tuple[str, ...]], ...] = (
    (
        "MIT",
        (
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
            " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
            " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of"
            " the Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
            " conditions:",
            "The above copyright notice and this permission notice shall be included in all copies or substantial"
            " portions of the Software.",
        ),
    ),
    ("BSD-2-Clause", _BSD[:3]),
    ("BSD-3-Clause", _BSD),
    (
        "Apache-2.0",
        (
            "Licensed under the Apache License, Version 2.0 (the \"License\");",
            "you may not use this file except in compliance with the License.",
            "You may obtain a copy of the License at",
        ),
    ),
    ("GPL-3.0-or-later", (_GNU.format("program", ""),)),
    ("AGPL-3.0-or-later", (_GNU.format("program", "Affero "),)),
    ("LGPL-3.0-or-later", (_GNU.format("library", "Lesser "),)),
    ("GPL-2.0-or-later", (_OLDER_GNU.format("program", "", "2"),)),
    ("LGPL-2.1-or-later", (_OLDER_GNU.format("library", "Lesser ", "2.1"),)),
    (
        "MPL-2.0",
        (
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ),
    ),
    (
        "MPL-2.0",
        (
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ),
    ),
    (
        "ISC",
        (
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
            " granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ),
    ),
    (
        "Zlib",
        (
            "This software is provided 'as-is', without any express or implied warranty.",
            "In no event will the authors be held liable for any damages arising from the use of this software.",
            "Permission is granted to anyone to use this software for any purpose, including commercial applications, and"
            " to alter it and redistribute it freely, subject to the following restrictions:",
        ),
    ),
    ("Unlicense", ("This is free and unencumbered software released into the public domain.",)),
    ("BSL-1.0", ("Distributed under the Boost Software License, Version 1.0.",)),
)

# Forms in which a text names its licence, and the names.
FORMS = (
    "Licensed under", "Released under", "Distributed under", "Published under",
    "This work is licensed under", "This project is licensed under", "This software is licensed under",
    "This program is licensed under", "This code is licensed under", "This text is licensed under",
)
NAMES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("MIT",)),
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0")),
    ("GPL-3.0", ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPL v3", "GPLv3")),
    ("GPL-2.0", ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPL v2", "GPLv2")),
    ("LGPL-3.0", ("GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL v3", "LGPLv3")),
    ("LGPL-2.1", ("GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPL v2.1", "LGPLv2.1")),
    ("AGPL-3.0", ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL v3", "AGPLv3")),
    ("BSD-3-Clause", ("BSD 3-Clause", "3-Clause BSD", "New BSD")),
    ("BSD-2-Clause", ("BSD 2-Clause", "2-Clause BSD", "Simplified BSD")),
    ("MPL-2.0", ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0")),
    ("ISC", ("ISC",)),
    ("EPL-2.0", ("Eclipse Public License 2.0", "EPL 2.0")),
    ("CC0-1.0", ("CC0 1.0", "Creative Commons Zero v1.0 Universal")),
    *(
        (f"CC-{kind.replace(' ', '-')}-4.0", (f"CC {kind} 4.0", f"Creative Commons {name} 4.0 International"))
        for kind, name in (
            ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
            ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
            ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
    ),
)
#: Identifiers after the tag of the same name.
TAG = "SPDX-License-Identifier"
TAGGED = (
    "MIT", "Apache-2.0", "GPL-3.0-or-later", "GPL-3.0-only", "GPL-2.0-or-later", "GPL-2.0-only", "LGPL-3.0-or-later",
    "LGPL-2.1-or-later", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "Zlib", "Unlicense",
    "BSL-1.0", "EPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
)


def all_rules() -> list[tuple[str, tuple[str, ...]]]:
    """Rules in order: notices, then names in each form with or without article and
    ``License``, then tags. A licence may have several rules."""
    out = list(NOTICES)
    for name, said in NAMES:
        out += [(f"{name} (named)", (f"{form} {the}{n}{tail}.",)) for n in said for form in FORMS for the in ("", "the ") for tail in ("", " License")]
    return out + [(f"{name} (tagged)", (f"{TAG}: {name}",)) for name in TAGGED]


#: Everything but letters, digits, sentence marks and line ends is one space.
NOISE_RE = r"[^a-z0-9.!?;:\n]+"
#: Space at line ends, and what still stands before a line (semicolons that mark comments).
MARGIN_RE = r" *\n[ ;]*"
TAG_RE = r"spdx license identifier *:"
END_RE = r"[.!?;:]+[ \n]+|[.!?;:]+$|\n\n+"
#: Tokens one of which every known sentence holds; only texts with one are cut up.
ANCHORS = ("licens", "permission", "redistribut", "copyright", "warrant", "software", "mpl", "damages", "ed under")


def normalise(text: str) -> list[str]:
    """Normalised sentences of a text, line ends within them as spaces."""
    t = re.sub(MARGIN_RE, "\n", re.sub(NOISE_RE, " ", text.lower()))
    cut = re.sub(END_RE, "\x01", re.sub(TAG_RE, "spdx license identifier", t)).split("\x01")
    return [s for s in (" ".join(x.split()) for x in cut) if s]


def compile_rules(rules: Sequence[tuple[str, Sequence[str]]]) -> tuple[dict[str, int], list[tuple[str, tuple[int, ...]]]]:
    """Known sentences with their identifiers (by alphabet, from 1), and each rule's
    sequence of them.

    Sentences without an anchor are left out of rules, as texts without one aren't looked
    at; ValueError for a rule of which nothing is left.
    """
    said = [(name, [s for x in sentences for s in normalise(x) if any(a in s for a in ANCHORS)]) for name, sentences in rules]
    known = {s: i for i, s in enumerate(sorted({s for _, some in said for s in some}), 1)}
    for name, some in said:
        if not some:
            raise ValueError(f"no sentence of {name} has an anchor")
    return known, [(name, tuple(known[s] for s in some)) for name, some in said]


def sentence_array(text: Column) -> Column:
    """Sentences as they stand, with line ends in them."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), NOISE_RE, " "), MARGIN_RE, "\n")
    t = F.regexp_replace(F.regexp_replace(t, TAG_RE, "spdx license identifier"), END_RE, "\x01")
    return F.split(t, "\x01")


def _sequence(ids: Sequence[int]) -> str:
    return "".join(f" {i} " for i in ids)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: Sequence[tuple[str, Sequence[str]]] | None = None,
) -> DataFrame:
    """A row for every input row: ``doc_id, licenses, sentence_ids, n_sentences``.

    ``sentence_ids`` joins the identifiers of the known sentences in text order
    (repeats included) by spaces; ``licenses`` joins, in rule order by commas, the
    licences one of whose rules has its sentences follow one another in that sequence;
    unknown sentences between are passed over, and a rule is not seen within a longer one
    that holds it. Both are empty strings, and the count 0, for null and
    empty texts and those that name no licence. Repeated rows come repeated; other
    columns are ignored; an empty table gives no rows.
    """
    known, compiled = compile_rules(rules or all_rules())
    names = list(dict.fromkeys(name for name, _ in compiled))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    may = F.col("text").rlike("(?i)" + "|".join(ANCHORS))
    cut = texts.select("doc_id", F.coalesce(F.when(may, sentence_array(F.col("text"))), F.array().cast("array<string>")).alias("cut"))
    # as text, since thousands of literals are slow to make one by one; sentences are
    # letters, digits, dots and spaces alone
    listed = ", ".join(f"'{s}'" for s in known)
    whole = r"btrim(replace(s, '\n', ' '))"
    said = F.expr(
        f"flatten(transform(cut, s -> if({whole} IN ({listed}), array({whole}),"
        rf" filter(transform(split(s, '\n'), x -> btrim(x)), x -> x IN ({listed})))))"
    )
    ids = F.expr(f"map_from_arrays(split('{'|'.join(known)}', '[|]'), sequence(1, {len(known)}))")
    out = cut.select("doc_id", F.transform(said, lambda s: F.element_at(ids, s)).alias("found"))
    out = out.select("doc_id", "found", F.concat_ws("", F.transform("found", lambda i: F.concat(F.lit(" "), i.cast("string"), F.lit(" ")))).alias("seq"))
    longs = {i for _, seq in compiled if len(seq) > 1 for i in seq}
    single = {seq[0]: names.index(name) for name, seq in compiled if len(seq) == 1 and seq[0] not in longs}
    ordinal = F.expr(f"array({', '.join(str(single.get(i, -1)) for i in range(1, len(known) + 1))})")
    hits = [F.filter(F.transform("found", lambda i: F.element_at(ordinal, i)), lambda i: i >= 0)]
    for name, seq in compiled:
        if len(seq) == 1 and seq[0] in single:
            continue
        left = F.col("seq")
        for longer in sorted({r[1] for r in compiled}, key=lambda r: (-len(r), r)):
            if len(longer) > len(seq) and _sequence(seq) in _sequence(longer):
                left = F.replace(left, F.lit(_sequence(longer)), F.lit("|"))
        hits.append(F.when(left.contains(_sequence(seq)), F.array(F.lit(names.index(name)))).otherwise(F.array().cast("array<int>")))
    ordinals = F.array_sort(F.array_distinct(F.concat(*hits)))
    labels = F.array(*map(F.lit, names))
    found = F.array_join(F.transform(ordinals, lambda i: F.element_at(labels, i + 1)), ",")
    licenses = F.when(F.size("found") > 0, found).otherwise("")
    return out.select("doc_id", licenses.alias("licenses"), F.array_join("found", " ").alias("sentence_ids"), F.size("found").cast("long").alias("n_sentences"))


def oracle() -> str:
    """The scan of ``documents`` in DuckDB's SQL, from the wording of the notices on: rules
    and texts are cut, numbered and matched by tables and joins, without anchors for texts."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    notices = ", ".join(f"({i}, {quoted(name)}, {k}, {quoted(s)})" for i, (name, some) in enumerate(NOTICES) for k, s in enumerate(some))
    named = ", ".join(f"({i}, {quoted(name)}, {quoted(s)})" for i, (name, some) in enumerate(NAMES) for s in some)
    forms, tagged = ", ".join(f"({quoted(f)})" for f in FORMS), ", ".join(f"({i}, {quoted(t)})" for i, t in enumerate(TAGGED))
    return f"""
WITH notices(n, licence, k, said) AS (VALUES {notices}),
names(n, licence, said) AS (VALUES {named}), forms(form) AS (VALUES {forms}), tags(n, said) AS (VALUES {tagged}),
rules AS (
  SELECT n AS ord, 'notice ' || n AS rule, licence, k, said FROM notices
  UNION ALL SELECT 1000 + n, concat_ws('/', form, a, said, b), licence || ' (named)', 0, form || ' ' || a || said || b || '.'
    FROM names, forms, (VALUES (''), ('the ')) AS article(a), (VALUES (''), (' License')) AS tail(b)
  UNION ALL SELECT 2000 + n, 'tag ' || n, said || ' (tagged)', 0, '{TAG}: ' || said FROM tags),
numbered AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
texts AS (
  SELECT 'rule' AS what, rule AS key, k, said AS text FROM rules
  UNION ALL SELECT 'text', CAST(row AS VARCHAR), 0, text FROM numbered),
clean AS (
  SELECT what, key, k, regexp_replace(regexp_replace(lower(text), '[^a-z0-9.!?;:\\n]+', ' ', 'g'), ' *\\n[ ;]*', chr(10), 'g') AS text FROM texts),
cut AS (
  SELECT what, key, k, string_split(regexp_replace(regexp_replace(text, 'spdx license identifier *:', 'spdx license identifier', 'g'),
    '[.!?;:]+[ \\n]+|[.!?;:]+$|\\n\\n+', chr(1), 'g'), chr(1)) AS parts FROM clean),
parts AS (SELECT what, key, k, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cut),
said AS (SELECT *, trim(replace(part, chr(10), ' ')) AS s FROM parts),
of_rules AS (SELECT * FROM said WHERE what = 'rule' AND regexp_matches(s, '{"|".join(ANCHORS)}')),
known AS (SELECT s, row_number() OVER (ORDER BY s) AS id FROM (SELECT DISTINCT s FROM of_rules)),
sequences AS (SELECT key, string_agg(' ' || id || ' ', '' ORDER BY k, i) AS seq FROM of_rules JOIN known USING (s) GROUP BY key),
whole AS (SELECT key, i, part, id FROM said LEFT JOIN known USING (s) WHERE what = 'text'),
lines AS (SELECT key, i, unnest(string_split(part, chr(10))) AS line, generate_subscripts(string_split(part, chr(10)), 1) AS j FROM whole WHERE id IS NULL),
found AS (
  SELECT key, i, 0 AS j, id FROM whole WHERE id IS NOT NULL
  UNION ALL SELECT key, i, j, id FROM lines JOIN known ON known.s = trim(line)),
told AS (
  SELECT key, string_agg(' ' || id || ' ', '' ORDER BY i, j) AS seq, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY i, j) AS sentence_ids, count(*) AS n
  FROM found GROUP BY key),
longer AS (
  SELECT a.key, a.seq, list(DISTINCT b.seq) FILTER (b.seq IS NOT NULL) AS over
  FROM sequences a LEFT JOIN sequences b ON contains(b.seq, a.seq) AND length(b.seq) > length(a.seq) GROUP BY a.key, a.seq),
hits AS (
  SELECT DISTINCT t.key, r.ord, r.licence FROM told t JOIN longer l
    ON contains(list_reduce(list_prepend(t.seq, list_sort(coalesce(l.over, []), 'DESC')), lambda x, y: replace(x, y, '|')), l.seq)
  JOIN (SELECT DISTINCT rule, ord, licence FROM rules) r ON r.rule = l.key),
labels AS (SELECT key, string_agg(licence, ',' ORDER BY ord) AS licenses FROM (SELECT key, licence, min(ord) AS ord FROM hits GROUP BY key, licence) GROUP BY key)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(sentence_ids, '') AS sentence_ids, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences
FROM numbered LEFT JOIN told ON told.key = CAST(row AS VARCHAR) LEFT JOIN labels ON labels.key = CAST(row AS VARCHAR)"""
