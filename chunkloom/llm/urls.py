"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` and the literal tokens that any
fitting URL must hold whole. Tokens are counted over all URLs, each rule is filed
under its rarest one, and a URL runs only the expressions filed under its own tokens
(and those of the few rules without a literal).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN_RE = r"[A-Za-z0-9]+"
#: Rules that travel to the executors with the function; beyond, rules are taken in
#: batches of this many, one pass each.
RULES_AT_ONCE = 100_000
#: Literals that are broadcast (some MB).
BROADCAST_LITERALS = 100_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path; ``tokens``, in lower case, are those that a
    fitting URL holds whole, in any case.

    ``rank`` decides between fitting rules: the highest wins, then the smaller name.
    ``name`` is what the result shows (None: not shown).
    """

    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    name: str | None = None


def host_rule(verdict: str, rule: str) -> Rule:
    """A rule ``host/path``: fits the host and its subdomains if the path starts so."""
    host, _, path = rule.partition("/")
    path = "/" + path
    whole = re.findall(TOKEN_RE, host)
    segments = path.split("/")[1:-1]  # the last may go on in the URL
    for x in segments:
        whole += re.findall(TOKEN_RE, x)
    return Rule(verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(dict.fromkeys(map(str.lower, whole))), 1000 + len(rule), rule)


def pattern_rule(verdict: str, pattern: str, *tokens: str) -> Rule:
    """A pattern of the method itself; ranks below every host rule, allowing ones above."""
    return Rule(verdict, pattern, tokens, 1 if verdict == "block" else 2)


#: What no host rule decides: pages that hold no prose are blocked, all else is let through.
FORMS = ("login", "signin", "signup", "register", "logout", "cart", "checkout", "basket", "cgi-bin", "wp-admin", "wp-login")
TOPICS = ("casino", "porn", "xxx", "viagra", "torrent")
HOSTS = ("ad", "ads", "adserver", "tracking", "click", "pixel")
FILES = ("jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "css", "js", "zip", "gz", "exe", "mp3", "mp4", "avi", "mov", "woff", "woff2")
PATTERNS: tuple[Rule, ...] = (
    *(pattern_rule("block", rf"/{w}(?:[/._-]|$)", *w.split("-")) for w in FORMS),
    *(pattern_rule("block", rf"(?:^|[./-]){w}(?:[./-]|$)", w) for w in TOPICS),
    *(pattern_rule("block", rf"^{w}\.", w) for w in HOSTS),
    *(pattern_rule("block", rf"(?i)\.{w}$", w) for w in FILES),
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ``? #`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rarest_first(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str | None, list[Rule]]:
    """Rules by the rarest of their tokens; under None those without any."""
    index: dict[str | None, list[Rule]] = {}
    for r in rules:
        key = min(r.tokens, key=lambda t: (counts.get(t, 0), t)) if r.tokens else None
        index.setdefault(key, []).append(r)
    return index


def token_counts(parts: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """URLs that hold each literal token of the rules; as many numbers as literals, which
    are a table that URLs' tokens are joined to."""
    literals = sorted({t for r in rules for t in r.tokens})
    if not literals:
        return {}
    table = parts.sparkSession.createDataFrame([(t,) for t in literals], "t string")
    tokens = F.transform(F.regexp_extract_all(F.concat("host", "path"), F.lit(TOKEN_RE), F.lit(0)), lambda t: F.lower(t))
    held = parts.select(F.explode(F.array_distinct(tokens)).alias("t"))
    # the literals of RULES_AT_ONCE rules at most; where they are many they are shuffled
    counted = held.join(F.broadcast(table) if len(literals) <= BROADCAST_LITERALS else table, "t").groupBy("t")
    return {r["t"]: r["n"] for r in counted.agg(F.count("*").alias("n")).collect()}


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """A row for every input row: ``page_id, host, path, rule, verdict``.

    The fitting rule of the highest rank gives the verdict, and ``rule`` its name;
    where none fits, ``rule`` is null and the verdict is ``default``. Null URLs and
    those without ``://`` have an empty host and path and are judged like others.
    Null ids and repeated rows are kept; other columns are ignored; an empty table
    gives no rows.
    """
    parts = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    counts: dict[str, int] = {}
    for i in range(0, len(rules), RULES_AT_ONCE):
        counts |= token_counts(parts, rules[i : i + RULES_AT_ONCE])
    out = parts.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("rule", "string"), ("verdict", "string"), ("rank", "int"))])
    for i in range(0, len(rules), RULES_AT_ONCE):
        out = out.mapInPandas(_judge(rarest_first(rules[i : i + RULES_AT_ONCE], counts)), out.schema)
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _judge(index: dict[str | None, list[Rule]]):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens_of = re.compile(TOKEN_RE).findall
        compiled = {k: [(r, re.compile(r.pattern).search) for r in v] for k, v in index.items()}
        always = compiled.pop(None, [])
        for pdf in batches:
            found = []
            for host, path, *best in zip(pdf["host"], pdf["path"], pdf["rule"], pdf["verdict"], pdf["rank"]):
                text = host + path
                best = [None if pd.isna(x) else x for x in best]
                for r, fits in [*always, *(x for t in {t.lower() for t in tokens_of(text)} if t in compiled for x in compiled[t])]:
                    if (best[2] is None or (r.rank, best[0] or "") > (best[2], r.name or "")) and fits(text):
                        best = [r.name, r.verdict, r.rank]
                found.append(best)
            pdf[["rule", "verdict"]] = pd.DataFrame([x[:2] for x in found], index=pdf.index, columns=["rule", "verdict"], dtype=object)
            pdf["rank"] = pd.Series([x[2] for x in found], index=pdf.index, dtype="Int32")
            yield pdf

    return run
