"""Queries of the chunking operators over the driver's tables, and the same in DuckDB's SQL.

The tables hold no parsed documents, so queries derive elements from them by fixed recipes
that both engines follow: lines of a text with types by their place, orders as pipe tables,
events as timed segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import values as V
from ..functions.rows import by_row
from ..functions.text import collapse_spans
from ..operators import blocks as B
from ..operators import chunks as H
from ..operators import elements as E
from ..operators import markdown_lines as M
from ..operators import sentences as S
from ..sources import documents as D
from ..sources import sinks as K
from . import chunking as P

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- recipes ----------------------------------------------------------------------------


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line")).withColumn("ord", F.col("ord").cast("long"))


LINES = """lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS ord
  FROM documents)"""

_KIND = """CASE WHEN ord % 5 = 0 THEN 'section_header' WHEN ord % 7 = 6 THEN 'page_footer'
    WHEN ord % 11 = 3 THEN 'table' WHEN ord % 11 = 2 THEN 'caption' WHEN ord % 4 = 1 THEN 'list_item' ELSE 'text' END"""
_CONTENT = """CASE WHEN ord % 25 = 10 THEN 'References' WHEN ord % 10 = 5 THEN '3.2 ' || line
    WHEN ord % 5 = 0 THEN replace(line, '.', '') ELSE line END"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, whole, as elements: every fifth a heading (some numbered, some of backmatter, the
    long ones none), five to a page, with tables, captions, list items and footers by place."""
    return lines(spark, sf_dir).selectExpr(
        "doc_id", "ord", f"{_KIND} AS kind", f"{_CONTENT} AS content", "CAST(1 + ord div 5 AS INT) AS page", "CAST(1 + ord % 9 AS STRING) AS level"
    )


ELEMENTS = f"""{LINES},
elements AS (
  SELECT doc_id, ord, {_KIND} AS kind, {_CONTENT} AS content,
    CAST(1 + ord // 5 AS INTEGER) AS page, CAST(1 + ord % 9 AS VARCHAR) AS level
  FROM lines)"""

_SQL_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def sql_strip(x: str) -> str:
    return _SQL_STRIP.format(x)


HEADED = f"""{ELEMENTS},
stripped AS (SELECT *, {sql_strip('content')} AS t FROM elements),
headed AS (
  SELECT *, CASE WHEN kind = 'section_header' AND length(t) BETWEEN 3 AND 120
    AND (regexp_matches(t, '^\\s*(?:\\d+(\\.\\d+)*\\.?|[A-Z](\\.\\d+)*\\.?)\\s+\\S')
      OR NOT regexp_matches(t, '[a-z]\\.\\s*$|\\.\\s+[a-z]'))
    THEN CAST(level AS INTEGER) END AS depth
  FROM stripped)"""

# -- sources ----------------------------------------------------------------------------


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elements(spark, sf_dir)
    box = F.struct((F.col("ord") % 7 + 1200.5).alias("x_min"), (F.col("ord") % 1300 - 100.25).alias("x_max"))
    own = F.struct((1 + F.col("ord") % 9).alias("level"), (F.col("ord") % 3 == 0).alias("flag"), ((F.col("ord") % 8) / 4).alias("part"))
    one = F.struct("ord", F.struct(F.when(F.col("ord") % 2 == 0, F.col("kind")).alias("type"), F.col("kind").alias("element_type"), "content", "page", box.alias("bbox"), own.alias("metadata")))
    pages = rows.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(one)), lambda r: r["col2"]).alias("es"))
    page = F.struct(F.col("page").alias("page_number"), F.when(F.col("doc_id") % 2 == 0, F.col("es")).alias("elements"), F.when(F.col("doc_id") % 2 == 1, F.col("es")).alias("regions"))
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    return docs.select("doc_id", F.to_json(F.struct("pages")).alias("json"))


_DECODED = f"""WITH {ELEMENTS} SELECT doc_id, ord, kind, content, page, CAST(greatest(0.0, least(ord % 1300 - 100.25, 1000.0)) AS DOUBLE) AS x_min,
  CAST(1000.0 AS DOUBLE) AS x_max, CAST(1 + ord % 9 AS VARCHAR) AS level, CASE WHEN ord % 3 = 0 THEN 'true' ELSE 'false' END AS flag,
  CAST((ord % 8) / 4.0 AS DOUBLE) AS part FROM elements"""


def _decoded(docs: DataFrame) -> DataFrame:
    own = [F.get_json_object("metadata", f"$.{k}").alias(k) for k in ("level", "flag")]
    part = F.get_json_object("metadata", "$.part").cast("double").alias("part")
    return D.explode_elements(docs).select("doc_id", "ord", "kind", "content", "page", F.col("bbox.x_min").alias("x_min"), F.col("bbox.x_max").alias("x_max"), *own, part)


@query(_DECODED)
def json_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON (pages with ``regions`` for odd ids, boxes with fractions,
    metadata with numbers and flags), decoded and exploded."""
    return _decoded(D.decode_documents(_documents(spark, sf_dir)))


@query(_DECODED)
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents decoded, written as JSON again, and decoded from that."""
    return _decoded(D.decode_documents(D.encode_documents(D.decode_documents(_documents(spark, sf_dir)))))


@query(f"""WITH {LINES}, boxes AS (
  SELECT doc_id, ord, (ord * 37 + doc_id) % 1500 - 200 AS a, CASE WHEN ord % 3 > 0 THEN (ord * 91 + doc_id) % 1500 - 200 END AS b FROM lines)
SELECT doc_id, ord, CAST(greatest(0, least(1000, least(a, coalesce(b, 1000)))) AS BIGINT) AS x_min,
  CAST(greatest(0, least(1000, greatest(a, coalesce(b, 1000)))) AS BIGINT) AS x_max FROM boxes""")
def bbox_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = (F.col("ord") * 37 + F.col("doc_id")) % 1500 - 200
    b = F.when(F.col("ord") % 3 > 0, (F.col("ord") * 91 + F.col("doc_id")) % 1500 - 200)
    low, high = C.bounded(a, b)
    return lines(spark, sf_dir).select("doc_id", "ord", low.cast("long").alias("x_min"), high.cast("long").alias("x_max"))


# -- Markdown lines ---------------------------------------------------------------------

_MARK = """CASE ord % 12 WHEN 0 THEN '## ' || line || ' ##' WHEN 1 THEN '- ' || line WHEN 2 THEN '12) ' || line
  WHEN 3 THEN '> ' || line WHEN 4 THEN '![' || line || '](x.png)' WHEN 5 THEN '* * *' WHEN 6 THEN '| a | b |'
  WHEN 7 THEN '|---|:-:|' WHEN 8 THEN '   ' WHEN 9 THEN '$$ x $$' WHEN 10 THEN CASE WHEN ord % 24 = 10 THEN '```py' ELSE '~~~~' END ELSE line END"""
_MARKED = f"""{LINES}, marked AS (SELECT doc_id, ord, {_MARK} AS line FROM lines),
classed AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY ord) AS below FROM marked),
kinds AS (SELECT doc_id, ord, line, CASE
  WHEN NOT regexp_matches(line, '\\S') THEN 'blank' WHEN regexp_matches(line, '{M.FENCE}') THEN 'fence'
  WHEN regexp_matches(line, '{M.ATX}') THEN 'heading' WHEN regexp_matches(line, '^\\s*(?:\\$\\$|\\\\\\[)') THEN 'math'
  WHEN regexp_matches(line, '{M.IMAGE}') THEN 'image'
  WHEN (contains(line, '|') AND regexp_matches(below, '{M.TABLE_RULE}')) OR (regexp_matches(line, '{M.PIPE_ROW}') AND regexp_matches(below, '{M.PIPE_ROW}')) THEN 'table'
  WHEN regexp_matches(line, '{M.BREAK}') OR regexp_matches(line, '{M.UNDERLINE}') THEN 'break'
  WHEN regexp_matches(line, '{M.ITEM}') THEN 'item' WHEN regexp_matches(line, '{M.QUOTE}') THEN 'quote' ELSE 'text' END AS line_class FROM classed)"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.classified(lines(spark, sf_dir).selectExpr("doc_id", "ord", f"{_MARK} AS line"))


@query(f"""WITH {_MARKED} SELECT doc_id, ord, line_class,
  CASE WHEN line_class = 'heading' THEN CAST(length(regexp_extract(line, '{M.ATX}', 1)) AS INTEGER) ELSE 0 END AS depth,
  CASE line_class WHEN 'heading' THEN regexp_extract(line, '{M.ATX}', 2) WHEN 'item' THEN regexp_extract(line, '{M.ITEM}', 1)
    WHEN 'image' THEN regexp_extract(line, '{M.IMAGE}', 1) WHEN 'quote' THEN regexp_replace(line, '{M.QUOTE}', '') ELSE line END AS body
FROM kinds""")
def markdown_line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("doc_id", "ord", "line_class", F.coalesce("depth", F.lit(0)).alias("depth"), "body")


@query(f"""WITH {_MARKED}, runs AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS para FROM (
  SELECT *, line_class = 'text' AND coalesce(lag(line_class) OVER (PARTITION BY doc_id ORDER BY ord), '') <> 'text' AS begins FROM kinds))
SELECT doc_id, CAST(para AS BIGINT) AS para, {sql_strip("string_agg(line, chr(10) ORDER BY ord)")} AS content FROM runs WHERE line_class = 'text' GROUP BY doc_id, para""")
def markdown_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.paragraphs(_marked(spark, sf_dir))


@query()
def markdown_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanner over whole texts made of the marked lines."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "line")))
    docs = _marked(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))
    return D.explode_elements(P.markdown_documents(docs)).select("doc_id", "ord", "kind", "content", "metadata")


# -- elements ---------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {ELEMENTS}, keyed AS (
  SELECT *, lower({sql_strip('content')}) AS key,
    row_number() OVER (PARTITION BY doc_id, kind, lower({sql_strip('content')}) ORDER BY ord) AS nth FROM elements),
walk AS (
  SELECT doc_id, kind, key, nth, ord, page AS anchor, true AS stays FROM keyed WHERE nth = 1
  UNION ALL
  SELECT k.doc_id, k.kind, k.key, k.nth, k.ord, CASE WHEN abs(k.page - w.anchor) <= 1 THEN w.anchor ELSE k.page END,
    abs(k.page - w.anchor) > 1
  FROM walk w JOIN keyed k ON k.doc_id = w.doc_id AND k.kind = w.kind AND k.key = w.key AND k.nth = w.nth + 1)
SELECT e.doc_id, e.ord, e.kind, e.content, e.page FROM elements e JOIN walk w USING (doc_id, ord) WHERE w.stays""")
def repeats_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.without_repeats(elements(spark, sf_dir)).select("doc_id", "ord", "kind", "content", "page")


_BLED = """CASE WHEN kind <> 'section_header' THEN content WHEN ord % 3 = 1 THEN content || chr(10) || repeat('q', 20)
    ELSE concat_ws(chr(10), content, after) END"""


@query(f"""WITH {ELEMENTS}, near AS (SELECT *, lead(content) OVER (PARTITION BY doc_id ORDER BY ord) AS after FROM elements),
bled AS (SELECT doc_id, ord, kind, content AS head, after, {_BLED} AS content FROM near),
seen AS (SELECT *, {sql_strip('first_value(CASE WHEN ' + sql_strip('content') + " <> '' THEN content END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)")} AS following FROM bled)
SELECT doc_id, ord, kind, CASE WHEN kind = 'section_header' AND ord % 3 <> 1 AND {sql_strip('head')} <> '' AND length({sql_strip('after')}) >= 10 AND length(following) >= 10
  THEN {sql_strip('head')} ELSE content END AS content FROM seen""")
def bleed_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that also hold the next element's text, which goes, or one that none has."""
    rows = elements(spark, sf_dir).withColumn("after", F.lead("content").over(E.by_document()))
    rows = rows.withColumn("content", F.expr(_BLED.replace("chr(10)", r"'\n'"))).drop("after")
    return E.without_bleed(rows).select("doc_id", "ord", "kind", "content")


@query(f"WITH {ELEMENTS} SELECT doc_id, ord, kind FROM elements WHERE kind <> 'page_footer'")
def skipped_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.without_skipped(elements(spark, sf_dir)).select("doc_id", "ord", "kind")


_STYLED = """CASE ord % 6 WHEN 0 THEN 'title' WHEN 1 THEN 'subtitle' WHEN 2 THEN 'section_header_level_' || (1 + ord % 4)
  WHEN 3 THEN 'section_header' WHEN 4 THEN 'section_header' ELSE 'text' END AS kind,
  CASE WHEN ord % 6 = 3 THEN CAST(1 + ord % 5 AS {0}) END AS level, CASE WHEN ord % 12 = 4 THEN 'Heading ' || (1 + ord % 5) END AS style"""


@query(f"""WITH {LINES}, styled AS (SELECT doc_id, ord, line AS content, {_STYLED.format('VARCHAR')} FROM lines)
SELECT doc_id, ord, CASE WHEN kind = 'title' THEN 1 WHEN kind = 'subtitle' THEN 2 WHEN NOT starts_with(kind, 'section_header') THEN 0
  WHEN regexp_matches(kind, 'level_') THEN CAST(regexp_extract(kind, 'level_(\\d+)', 1) AS INTEGER)
  WHEN level IS NOT NULL THEN CAST(level AS INTEGER) WHEN style IS NOT NULL THEN CAST(regexp_extract(style, '(\\d)', 1) AS INTEGER) ELSE 1 END AS depth,
  length({sql_strip('content')}) BETWEEN 3 AND 120 AND (regexp_matches({sql_strip('content')}, '^\\s*(?:\\d+(\\.\\d+)*\\.?|[A-Z](\\.\\d+)*\\.?)\\s+\\S')
    OR NOT regexp_matches({sql_strip('content')}, '[a-z]\\.\\s*$|\\.\\s+[a-z]')) AS valid FROM styled""")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    styled = lines(spark, sf_dir).selectExpr("doc_id", "ord", "line AS content", *_STYLED.format("STRING").split(",\n  ")[0:1], "CASE WHEN ord % 6 = 3 THEN CAST(1 + ord % 5 AS STRING) END AS level", "CASE WHEN ord % 12 = 4 THEN 'Heading ' || (1 + ord % 5) END AS style")
    return styled.select("doc_id", "ord", F.coalesce(C.heading_level("kind", "level", "style"), F.lit(0)).alias("depth"), C.is_heading("content").alias("valid"))


@query(f"""WITH {HEADED}, last AS (SELECT doc_id, ord, {', '.join(f'''
  last_value(CASE WHEN depth = {k} THEN ord END IGNORE NULLS) OVER w AS o{k}, last_value(CASE WHEN depth = {k} THEN t END IGNORE NULLS) OVER w AS t{k},
  max(CASE WHEN depth < {k} THEN ord END) OVER w AS e{k}''' for k in range(1, 10))}
  FROM headed WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, ord, concat_ws(' > ', {', '.join(f'CASE WHEN e{k} IS NULL OR o{k} > e{k} THEN t{k} END' for k in range(1, 10))}) AS trail FROM last""")
def heading_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.with_trail(E.with_headings(elements(spark, sf_dir))).select("doc_id", "ord", F.array_join("trail", " > ").alias("trail"))


_BACK = f"""{HEADED}, heads AS (
  SELECT doc_id, ord, depth, regexp_matches(t, '(?i){V.BACKMATTER_RE}') AS back, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS nth
  FROM headed WHERE depth IS NOT NULL),
walk AS (
  SELECT doc_id, nth, ord, CASE WHEN back THEN depth END AS out FROM heads WHERE nth = 1
  UNION ALL
  SELECT h.doc_id, h.nth, h.ord, CASE WHEN h.back THEN coalesce(w.out, h.depth) WHEN h.depth > w.out THEN w.out END
  FROM walk w JOIN heads h ON h.doc_id = w.doc_id AND h.nth = w.nth + 1),
stays AS (
  SELECT x.doc_id, x.ord, x.kind FROM (
    SELECT h.*, last_value(w.ord IGNORE NULLS) OVER (PARTITION BY h.doc_id ORDER BY h.ord) AS head_ord
    FROM headed h LEFT JOIN walk w USING (doc_id, ord)) x
  LEFT JOIN (SELECT doc_id AS d, ord AS o, out FROM walk) s ON s.d = x.doc_id AND s.o = x.head_ord
  WHERE out IS NULL)"""


@query(f"WITH RECURSIVE {_BACK} SELECT doc_id, ord, kind FROM stays")
def backmatter_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.without_backmatter(E.with_headings(elements(spark, sf_dir))).select("doc_id", "ord", "kind")


_ROLES = f"""{HEADED}, roles AS (
  SELECT *, CASE WHEN kind = 'table' THEN 'block' WHEN depth IS NOT NULL THEN 'heading' ELSE 'prose' END AS role FROM headed),
runs AS (SELECT *, CAST(sum(CASE WHEN role <> 'prose' OR coalesce(before, '') <> 'prose' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) AS run
  FROM (SELECT *, lag(role) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM roles))"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.with_runs(E.with_headings(elements(spark, sf_dir)))


@query(f"WITH {_ROLES} SELECT doc_id, ord, role, run FROM runs")
def prose_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("doc_id", "ord", "role", "run")


@query(f"""WITH {_ROLES}, said AS (SELECT *, role = 'prose' AND (kind = 'caption' OR (greatest(1, length(t) // 4) <= 60
    AND (regexp_matches(t, '(?i){V.INTRO_RE}') OR regexp_matches(t, '(?i){V.CAPTION_RE}')))) AS intro FROM runs),
near AS (SELECT *, lag(CASE WHEN intro THEN t END) OVER w AS above, lead(role) OVER w AS below FROM said WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, ord, role, CASE WHEN role = 'block' AND above <> '' THEN above END AS context FROM near WHERE NOT (intro AND coalesce(below, '') = 'block')""")
def block_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.with_context(_runs(spark, sf_dir)).select("doc_id", "ord", "role", "context")


@query(f"""WITH {_ROLES}, gaps AS (SELECT *, coalesce(sum(CASE WHEN role <> 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM runs),
heads AS (SELECT doc_id, gap, string_agg(t, chr(10) || chr(10) ORDER BY ord) AS pending FROM gaps WHERE role = 'heading' GROUP BY doc_id, gap)
SELECT g.doc_id, g.ord, g.role, CASE WHEN role <> 'heading' AND pending <> '' THEN pending END AS pending FROM gaps g LEFT JOIN heads h ON h.doc_id = g.doc_id AND h.gap = g.gap""")
def pending_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.with_pending(_runs(spark, sf_dir)).select("doc_id", "ord", "role", "pending")


@query(f"""WITH {_ROLES}, ends AS (SELECT doc_id, max(CASE WHEN role <> 'heading' THEN ord END) AS last FROM runs GROUP BY doc_id)
SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY ord) AS headings FROM runs JOIN ends USING (doc_id)
WHERE role = 'heading' AND (last IS NULL OR ord > last) GROUP BY doc_id""")
def trailing_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.trailing_headings(_runs(spark, sf_dir))


# -- sentences --------------------------------------------------------------------------

_NAMES = "|".join(a.replace(".", "\\.") for a in V.ABBREVIATIONS)


def sentence_sql(source: str, keys: str) -> str:
    """CTEs that end in ``sentences`` over ``source`` with ``keys`` and ``text``."""
    return f"""texts AS (SELECT {keys}, {sql_strip('text')} AS t FROM {source}),
pieces AS (SELECT {keys}, unnest(ps) AS p, generate_subscripts(ps, 1) AS i
  FROM (SELECT {keys}, regexp_extract_all(t, '(?s).*?[.!?]+\\s+|.+$') AS ps FROM texts WHERE t <> '')),
stops AS (SELECT *, sum(length(p)) OVER w AS stop, NOT (regexp_matches(p, '[.!?]+\\s+$') AND (
    regexp_matches(lower({sql_strip("right(regexp_replace(p, '[.!?]+\\s+$', ''), 10)")}), '(?:{_NAMES})$')
    OR regexp_matches(right(regexp_replace(p, '([.!?])[.!?]*\\s+$', '\\1'), 21), '\\b(?:[A-Za-z]\\.){{2,}}$'))) AS ends
  FROM pieces WINDOW w AS (PARTITION BY {keys} ORDER BY i)),
numbered AS (SELECT *, coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nth FROM stops),
sentences AS (SELECT {keys}, CAST(nth AS BIGINT) AS nth, CAST(max(stop) - sum(length(p)) AS BIGINT) AS "begin", CAST(max(stop) AS BIGINT) AS "end",
    {sql_strip("string_agg(p, '' ORDER BY i)")} AS sentence FROM numbered GROUP BY {keys}, nth)"""


_DOC_SENTENCES = sentence_sql("documents", "doc_id")


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sentence_spans(P.spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), ["doc_id"])


@query(f'WITH {_DOC_SENTENCES} SELECT doc_id, nth, "begin", "end", sentence FROM sentences')
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir)


@query(f"WITH {_DOC_SENTENCES} SELECT doc_id, nth, CAST(greatest(1, length(sentence) // 4) AS BIGINT) AS tokens FROM sentences")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("doc_id", "nth", C.token_count("sentence").alias("tokens"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each line, the lines of a document being one run."""
    rows = elements(spark, sf_dir).where("kind <> 'page_footer'").withColumn("size", F.length(C.strip("content")))
    said = S.sentence_spans(rows, ["doc_id", "ord"], "content", ["kind", "page", "size"])
    said = said.withColumn("run", F.lit(0)).withColumn("opens", F.col("nth") == 0)
    return S.with_positions(said)


_PLACED = f"""{ELEMENTS}, source AS (SELECT doc_id, ord, kind, page, content AS text FROM elements WHERE kind <> 'page_footer'),
{sentence_sql('source', 'doc_id, ord')},
sizes AS (SELECT doc_id, ord, kind, page, length(t) AS size FROM texts JOIN source USING (doc_id, ord) WHERE t <> ''),
offsets AS (SELECT *, sum(size + 1) OVER (PARTITION BY doc_id ORDER BY ord) - size - 1 AS off FROM sizes),
placed AS (SELECT s.doc_id, s.ord, s.nth, o.kind, o.page, s.nth = 0 AS opens, s.sentence, CAST(s."begin" + off AS BIGINT) AS start_idx, CAST(s."end" + off AS BIGINT) AS end_idx,
  CAST(row_number() OVER (PARTITION BY s.doc_id ORDER BY s.ord, s.nth) - 1 AS INTEGER) AS pos FROM sentences s JOIN offsets o USING (doc_id, ord))"""


@query(f"WITH {_PLACED} SELECT doc_id, pos, start_idx, end_idx, opens, sentence FROM placed")
def sentence_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select("doc_id", "pos", "start_idx", "end_idx", "opens", "sentence")


_NORM = "trim(regexp_replace(lower(sentence), '\\s+', ' ', 'g'))"
_CUT = f"""{_PLACED}, normed AS (SELECT *, {_NORM} AS norm FROM placed),
cut AS (SELECT *, coalesce(length(norm) >= 10 AND starts_with(after, norm) AND length(after) >= length(norm) + 20, false) AS cut_off
  FROM (SELECT *, lead(norm) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM normed))"""


@query(f"WITH {_CUT} SELECT doc_id, pos, cut_off FROM cut")
def prefixes_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.without_prefixes(_placed(spark, sf_dir)).select("doc_id", "pos", "cut_off")


_SURVIVING = f"""{_CUT}, walk AS (
  SELECT doc_id, pos, NOT cut_off AS stays, CASE WHEN cut_off THEN []::VARCHAR[] ELSE [norm] END AS last FROM cut WHERE pos = 0
  UNION ALL
  SELECT c.doc_id, c.pos, NOT c.cut_off AND NOT list_contains(w.last, c.norm),
    CASE WHEN NOT c.cut_off AND NOT list_contains(w.last, c.norm) THEN list_append(w.last, c.norm)[-8:] ELSE w.last END
  FROM walk w JOIN cut c ON c.doc_id = w.doc_id AND c.pos = w.pos + 1),
kept AS (SELECT p.* FROM placed p JOIN walk w USING (doc_id, pos) WHERE w.stays)"""


@query(f"WITH RECURSIVE {_SURVIVING} SELECT doc_id, pos FROM kept")
def repeats_in_window_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.surviving(_placed(spark, sf_dir)).select("doc_id", "pos")


_TYPES = ", ".join(f"'{k}'" for k in V.PROSE_TYPES)
_BOUNDED = f"""{_PLACED}, bounded AS (SELECT *, CASE WHEN before IS NULL OR starts_with(kind, 'section_header') THEN 'hard'
    WHEN kind <> before AND NOT (kind IN ({_TYPES}) AND before IN ({_TYPES})) THEN 'hard'
    WHEN opens THEN CASE WHEN kind IN ({_TYPES}) AND before IN ({_TYPES}) THEN 'soft' ELSE 'hard' END END AS boundary
  FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM placed))"""


@query(f"WITH {_BOUNDED} SELECT doc_id, pos, boundary FROM bounded")
def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_boundaries(_placed(spark, sf_dir)).select("doc_id", "pos", "boundary")


def packing_sql(source: str, max_tokens: int, overlap: int) -> str:
    """CTEs that end in ``packed`` (doc_id, nth, a, e: half-open) over ``source`` with
    doc_id, pos, sentence, boundary."""
    return f"""counted AS (SELECT *, greatest(1, length(sentence) // 4) AS n FROM {source}),
sums AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n AS c, count(*) OVER (PARTITION BY doc_id) AS total FROM counted),
ends AS (SELECT s.doc_id, s.pos AS a, any_value(s.total) AS total, coalesce(min(j.pos), any_value(s.total)) AS e
  FROM sums s LEFT JOIN sums j ON j.doc_id = s.doc_id AND j.pos > s.pos AND j.pos <= s.pos + {max_tokens} + 1 AND (j.boundary = 'hard'
    OR (j.boundary = 'soft' AND j.c - s.c >= 200) OR j.c + j.n - s.c > {max_tokens}) GROUP BY s.doc_id, s.pos),
backs AS (SELECT x.doc_id, x.a, x.e, x.total, x.e - CASE WHEN x.e = x.total OR b.boundary = 'hard' THEN 0 ELSE coalesce((
    SELECT count(*) FROM sums k WHERE k.doc_id = x.doc_id AND k.pos > x.a AND k.pos < x.e AND b.c - k.c <= {overlap}), 0) END AS next
  FROM ends x LEFT JOIN sums b ON b.doc_id = x.doc_id AND b.pos = x.e),
packed AS (
  SELECT doc_id, 0 AS nth, a, e, next, total FROM backs WHERE a = 0
  UNION ALL
  SELECT b.doc_id, p.nth + 1, b.a, b.e, b.next, b.total FROM packed p JOIN backs b ON b.doc_id = p.doc_id AND b.a = p.next AND p.e < p.total)"""


@query(f"WITH RECURSIVE {_BOUNDED}, {packing_sql('bounded', V.MAX_TOKENS, V.OVERLAP_TOKENS)} SELECT doc_id, CAST(nth AS INTEGER) AS nth, CAST(a AS INTEGER) AS first, CAST(e - 1 AS INTEGER) AS last FROM packed")
def packed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = S.with_boundaries(_placed(spark, sf_dir))
    return S.packed(said).select("doc_id", "nth", F.col("first").cast("int"), F.col("last").cast("int"))


@query(f"""WITH RECURSIVE {_BOUNDED}, {packing_sql('bounded', V.MAX_TOKENS, V.OVERLAP_TOKENS)},
texted AS (SELECT p.doc_id, p.nth, string_agg(CASE WHEN b.pos = p.a THEN '' WHEN b.opens THEN chr(10) || chr(10) ELSE ' ' END || b.sentence, '' ORDER BY b.pos) AS content,
  array_to_string(list_sort(list_distinct(list(b.page))), ',') AS pages, min(b.start_idx) AS span_start, max(b.end_idx) AS span_end
  FROM packed p JOIN bounded b ON b.doc_id = p.doc_id AND b.pos >= p.a AND b.pos < p.e GROUP BY p.doc_id, p.nth)
SELECT doc_id, CAST(nth AS INTEGER) AS nth, content, CAST(greatest(1, length(content) // 4) AS BIGINT) AS token_count, pages, span_start, span_end FROM texted""")
def prose_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.chunk_rows(S.with_boundaries(_placed(spark, sf_dir)))
    return out.select("doc_id", "nth", "content", "token_count", F.array_join("page_numbers", ",").alias("pages"), "span_start", "span_end")


@query(f"""WITH RECURSIVE {_SURVIVING}, again AS (SELECT * EXCLUDE (pos), CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos FROM kept),
marked AS (SELECT *, CASE WHEN before IS NULL OR starts_with(kind, 'section_header') THEN 'hard'
    WHEN kind <> before AND NOT (kind IN ({_TYPES}) AND before IN ({_TYPES})) THEN 'hard'
    WHEN opens THEN CASE WHEN kind IN ({_TYPES}) AND before IN ({_TYPES}) THEN 'soft' ELSE 'hard' END END AS boundary
  FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM again)),
{packing_sql('marked', V.MAX_TOKENS, V.OVERLAP_TOKENS)}
SELECT p.doc_id, CAST(p.nth AS INTEGER) AS nth, string_agg(CASE WHEN b.pos = p.a THEN '' WHEN b.opens THEN chr(10) || chr(10) ELSE ' ' END || b.sentence, '' ORDER BY b.pos) AS content
FROM packed p JOIN marked b ON b.doc_id = p.doc_id AND b.pos >= p.a AND b.pos < p.e GROUP BY p.doc_id, p.nth""")
def surviving_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the sentences that stay: where an element's first one went, so did its mark."""
    return S.chunk_rows(S.with_boundaries(S.surviving(_placed(spark, sf_dir)))).select("doc_id", "nth", "content")


_TIMED = "SELECT user_id, epoch(ts) AS start_time, CASE WHEN event_id % 3 > 0 THEN epoch(ts) + value END AS end_time FROM events"


@query(f"""SELECT user_id, min(start_time) AS start_time, max(end_time) AS end_time, count(DISTINCT (start_time, coalesce(CAST(end_time AS VARCHAR), '-'))) AS segment_count
FROM ({_TIMED}) GROUP BY user_id HAVING min(start_time) IS NOT NULL""")
def time_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, sf_dir, "events").select("user_id", start.alias("start_time"), F.when(F.col("event_id") % 3 > 0, start + F.col("value")).alias("end_time"))
    return S.time_range(rows, ["user_id"])


@query("""SELECT conv_id, CASE WHEN count(DISTINCT nullif(role, 'system')) = 1 THEN max(nullif(role, 'system')) END AS section_type FROM conversations GROUP BY conv_id""")
def section_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("role") == "system", "").otherwise(F.col("role")).alias("section"))
    return S.section_type(rows, ["conv_id"])


# -- blocks -----------------------------------------------------------------------------

_TABLES = """rows AS (SELECT l_orderkey // 120 AS doc_id, l_orderkey, l_linenumber, '| ' || l_orderkey || ' | ' || l_linenumber || ' | ' || l_returnflag || ' |' AS row FROM lineitem),
tables AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN '| key | line | flag |' || chr(10) || '|---|---|---|' || chr(10) ELSE '' END || string_agg(row, chr(10) ORDER BY l_orderkey, l_linenumber, row) AS content FROM rows GROUP BY doc_id)"""


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as pipe tables of 120 orders, with a header for two of three."""
    row = F.format_string("| %d | %d | %s |", F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("long"), "l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 120").alias("doc_id"), "l_orderkey", "l_linenumber", row.alias("row"))
    some = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "row")))
    out = rows.groupBy("doc_id").agg(F.array_join(F.transform(some, lambda r: r["row"]), "\n").alias("content"))
    head = F.when(F.col("doc_id") % 3 > 0, F.lit("| key | line | flag |\n|---|---|---|\n")).otherwise("")
    return out.select("doc_id", F.lit(0).cast("long").alias("ord"), F.lit("table").alias("kind"), F.concat(head, F.col("content")).alias("content"))


_GROUPS = f"""{_TABLES}, cut AS (SELECT doc_id, string_split(content, chr(10)) AS l, CASE WHEN doc_id % 3 > 0 THEN 2 ELSE 0 END AS head FROM tables),
sized AS (SELECT *, CASE WHEN head > 0 THEN greatest(1, length(array_to_string(l[1:head], chr(10))) // 4) ELSE 0 END AS fixed, l[head + 1:] AS data FROM cut),
walk AS (
  SELECT doc_id, 1 AS i, 0 AS part, fixed + greatest(1, length(data[1]) // 4) AS size FROM sized
  UNION ALL
  SELECT s.doc_id, w.i + 1, CASE WHEN w.size + greatest(1, length(s.data[w.i + 1]) // 4) > 350 THEN w.part + 1 ELSE w.part END,
    CASE WHEN w.size + greatest(1, length(s.data[w.i + 1]) // 4) > 350 THEN s.fixed + greatest(1, length(s.data[w.i + 1]) // 4) ELSE w.size + greatest(1, length(s.data[w.i + 1]) // 4) END
  FROM walk w JOIN sized s USING (doc_id) WHERE w.i < len(s.data)),
grouped AS (SELECT w.doc_id, part, min(i) - 1 AS row_start, max(i) AS row_end, string_agg(data[i], chr(10) ORDER BY i) AS body, any_value(l) AS l, any_value(head) AS head
  FROM walk w JOIN sized s USING (doc_id) GROUP BY w.doc_id, part)"""


@query(f"""WITH RECURSIVE {_GROUPS} SELECT doc_id, CAST(part AS INTEGER) AS part, CAST(row_start AS INTEGER) AS row_start, CAST(row_end AS INTEGER) AS row_end,
  CASE WHEN head > 0 THEN array_to_string(l[1:head], chr(10)) || chr(10) ELSE '' END || body AS content, CASE WHEN head > 0 THEN l[1] ELSE '' END AS column_headers FROM grouped""")
def table_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table_parts(tables(spark, sf_dir)).drop("ord")


@query(f"WITH RECURSIVE {_GROUPS} SELECT doc_id, count(*) AS child_count, count(*) > 1 AS divided FROM grouped GROUP BY doc_id")
def table_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.parents_and_children(B.table_parts(tables(spark, sf_dir))).drop("ord")


@query(f"""WITH {_TABLES} SELECT doc_id, CAST(greatest(1, length(content) // 4) AS BIGINT) AS token_count, CAST(length(content) AS INTEGER) AS span_end, 'table_block' AS dominant_type, true AS has_table,
  CASE WHEN greatest(1, length(content) // 4) <= 800 THEN 'whole' ELSE 'split' END AS route FROM tables""")
def whole_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables(spark, sf_dir)
    return B.whole_blocks(rows).join(B.dispatch(rows).select("doc_id", "route"), "doc_id").select("doc_id", "token_count", "span_end", "dominant_type", "has_table", "route")


@query(f"""WITH {LINES}, pics AS (SELECT doc_id, ord, CASE ord % 3 WHEN 0 THEN 'picture' WHEN 1 THEN 'chart' ELSE 'figure' END AS kind, CASE WHEN ord % 4 = 1 THEN substr(line, 1, 20) WHEN ord % 4 = 2 THEN '' END AS caption,
  CASE WHEN ord % 5 = 1 THEN substr(line, 5, 9) END AS alt_text, CASE WHEN ord % 6 = 0 THEN substr(line, 9, 9) END AS context FROM lines),
own AS (SELECT *, nullif({sql_strip("concat_ws(chr(10), nullif(caption, ''), nullif(alt_text, ''))")}, '') AS own FROM pics),
said AS (SELECT doc_id, ord, kind, CASE WHEN own IS NOT NULL AND context IS NOT NULL THEN context || chr(10) || chr(10) || own ELSE coalesce(own, context) END AS content FROM own)
SELECT doc_id, ord, kind, content, CAST(greatest(1, length(content) // 4) AS BIGINT) AS token_count FROM said WHERE content IS NOT NULL""")
def visual_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pics = lines(spark, sf_dir).selectExpr(
        "doc_id", "ord", "CASE ord % 3 WHEN 0 THEN 'picture' WHEN 1 THEN 'chart' ELSE 'figure' END AS kind",
        "CASE WHEN ord % 4 = 1 THEN substr(line, 1, 20) WHEN ord % 4 = 2 THEN '' END AS caption",
        "CASE WHEN ord % 5 = 1 THEN substr(line, 5, 9) END AS alt_text", "CASE WHEN ord % 6 = 0 THEN substr(line, 9, 9) END AS context",
    )
    return B.visual_blocks(pics).select("doc_id", "ord", "kind", "content", "token_count")


_CODE = """CASE ord % 5 WHEN 0 THEN 'import os' || chr(10) || 'def f(x):' || chr(10) || '    return x' || chr(10) || chr(10) || 'class A:' || chr(10) || '    y = 1'
  WHEN 1 THEN 'function a() { return 1 }' || chr(10) || 'const b = (x) => { return x }' WHEN 2 THEN 'const n: number = 1' || chr(10) || 'export function g() {}' || chr(10) || 'function h() {}'
  WHEN 3 THEN 'fn main() {' || chr(10) || '}' || chr(10) || chr(10) || chr(10) || 'fn other() {' || chr(10) || '}' ELSE line END AS content, CASE WHEN ord % 15 = 0 THEN 'TS' END AS language"""


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    content, language = _CODE.replace("chr(10)", r"'\n'").split(" AS content, ")
    return lines(spark, sf_dir).selectExpr("doc_id", "ord", "'code' AS kind", f"{content} AS content", language)


def _any(x: str, signs) -> str:
    return "(" + " OR ".join(f"contains({x}, '{s}')".replace("\n", "' || chr(10) || '") for s in signs) + ")"


@query(f"""WITH {LINES}, code AS (SELECT doc_id, ord, {_CODE} FROM lines)
SELECT doc_id, ord, CASE WHEN lower(language) = 'ts' THEN 'typescript' WHEN {_any('content', V.PYTHON_SIGNS)} THEN 'python'
  WHEN {_any('lower(content)', V.SCRIPT_SIGNS)} THEN CASE WHEN {_any('content', V.TYPED_SIGNS)} THEN 'typescript' ELSE 'javascript' END ELSE 'unknown' END AS code_language FROM code""")
def code_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code(spark, sf_dir).select("doc_id", "ord", C.code_language("content", "language").alias("code_language"))


@query(f"""WITH {LINES}, code AS (SELECT doc_id, ord, {_CODE} FROM lines),
cut AS (SELECT doc_id, ord, list_filter(list_transform(string_split(regexp_replace(regexp_replace(content, '\\n\\n+', chr(1), 'g'), '\\n((?:def|function|class|fn)\\s+\\w)', chr(1) || chr(10) || '\\1', 'g'), chr(1)),
  lambda s: {sql_strip('s')}), lambda s: s <> '') AS parts FROM code)
SELECT doc_id, ord, CAST(unnest(range(len(parts))) AS INTEGER) AS part, unnest(parts) AS content FROM cut""")
def code_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.section_parts(_code(spark, sf_dir))


_PARTS = (
    (0, "python", ("import os\n\ndef f(x):\n    return x", "FunctionDef", "f", 2, 3), ("import os\n\nclass A:\n    y = 1", "ClassDef", "A", 5, 6)),
    (1, "javascript", ("function a() { return 1 }", "FunctionDeclaration", "a"), ("const b = (x) => { return x }", "FunctionDeclaration", "b")),
    (2, "typescript", ("export function g() {}", "FunctionDeclaration", "g"), ("function h() {}", "FunctionDeclaration", "h")),
    (3, "unknown", ("fn main() {\n}", "section"), ("fn other() {\n}", "section")),
)


def _parts_sql() -> str:
    text = lambda x: "NULL" if x is None else "'" + str(x).replace("\n", "' || chr(10) || '") + "'"
    number = lambda x: f"CAST({'NULL' if x is None else x} AS INTEGER)"
    rows = []
    for n, language, *parts in _PARTS:
        for i, part in enumerate(parts):
            content, kind, name, a, b = (*part, None, None, None)[:5]
            rows.append(f"({n}, {i}, '{language}', {text(content)}, '{kind}', {text(name)}, {number(a)}, {number(b)})")
    return ", ".join(rows)


@query(f"""WITH {LINES}, code AS (SELECT doc_id, ord, {_CODE} FROM lines),
known(n, part, language, content, type, name, lineno, end_lineno) AS (VALUES {_parts_sql()}),
told AS (SELECT *, CASE WHEN {_any('content', V.PYTHON_SIGNS)} THEN 'python' WHEN {_any('lower(content)', V.SCRIPT_SIGNS)}
  THEN CASE WHEN {_any('content', V.TYPED_SIGNS)} THEN 'typescript' ELSE 'javascript' END ELSE 'unknown' END AS said FROM code)
SELECT doc_id, ord, k.part, k.language, k.content, k.type, k.name, k.lineno, k.end_lineno FROM code JOIN known k ON k.n = ord % 5 AND ord % 15 <> 0
UNION ALL SELECT doc_id, ord, 0, 'typescript', content, 'module', NULL, NULL, NULL FROM code WHERE ord % 15 = 0
UNION ALL SELECT doc_id, ord, 0, said, CASE WHEN said IN ('javascript', 'typescript') OR {sql_strip('content')} = '' THEN content ELSE {sql_strip('content')} END,
  CASE WHEN said IN ('javascript', 'typescript') OR {sql_strip('content')} = '' THEN 'module' ELSE 'section' END, NULL, NULL, NULL FROM told WHERE ord % 5 = 4""")
def code_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions, classes and sections of code in several languages, and of lines of prose."""
    return B.code_parts(_code(spark, sf_dir))


_FORMULA = """CASE ord % 4 WHEN 0 THEN '\\begin{equation}a=' || ord || '\\end{equation} and \\begin{align*}b\\end{align*}' WHEN 1 THEN '\\begin{gather}a \\\\ b \\\\ c \\\\ d' || ord || '\\end{gather}'
  WHEN 2 THEN '\\begin{align}a \\\\ b\\end{align}' ELSE 'x = ' || ord END"""
_ENV_SQL = "|".join(rf"\\begin\{{{n}\*?\}}.*?\\end\{{{n}\*?\}}" for n in V.FORMULA_ENVIRONMENTS)


@query(f"""WITH {LINES}, formulas AS (SELECT doc_id, ord, {_FORMULA} AS content FROM lines),
found AS (SELECT *, regexp_extract_all(content, '(?s){_ENV_SQL}') AS envs FROM formulas),
steps AS (SELECT *, CASE WHEN len(envs) = 1 THEN string_split(envs[1], '\\\\') ELSE [] END AS steps FROM found),
parts AS (
  SELECT doc_id, ord, unnest(envs) AS content, generate_subscripts(envs, 1) - 1 AS part, 'environment' AS split_method FROM steps WHERE len(envs) > 1
  UNION ALL SELECT doc_id, ord, {sql_strip('unnest(steps)')}, generate_subscripts(steps, 1) - 1, 'step_based' FROM steps WHERE len(envs) = 1 AND len(steps) > 3
  UNION ALL SELECT doc_id, ord, content, 0, 'none' FROM steps WHERE len(envs) = 0 OR (len(envs) = 1 AND len(steps) <= 3))
SELECT doc_id, ord, CAST(part AS INTEGER) AS part, content, split_method FROM parts""")
def formula_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("n", F.col("ord").cast("string"))
    content = (
        F.when(F.col("ord") % 4 == 0, F.concat(F.lit(r"\begin{equation}a="), "n", F.lit(r"\end{equation} and \begin{align*}b\end{align*}")))
        .when(F.col("ord") % 4 == 1, F.concat(F.lit(r"\begin{gather}a \\ b \\ c \\ d"), "n", F.lit(r"\end{gather}")))
        .when(F.col("ord") % 4 == 2, F.lit(r"\begin{align}a \\ b\end{align}"))
        .otherwise(F.concat(F.lit("x = "), "n"))
    )
    return B.formula_parts(rows.select("doc_id", "ord", F.lit("formula").alias("kind"), content.alias("content"))).select("doc_id", "ord", "part", "content", "split_method")


# -- vectors ----------------------------------------------------------------------------


@query("""WITH near AS (SELECT vec_id, embedding AS v, lag(embedding) OVER (PARTITION BY vec_id // 100 ORDER BY vec_id) AS u FROM embeddings)
SELECT vec_id, round(CASE WHEN u IS NULL OR v IS NULL THEN 0.5 ELSE list_cosine_similarity(CAST(u AS DOUBLE[]), CAST(v AS DOUBLE[])) END, 6) AS similarity,
  CASE WHEN u IS NULL OR v IS NULL THEN false ELSE list_cosine_similarity(CAST(u AS DOUBLE[]), CAST(v AS DOUBLE[])) < 0.5 END AS drops FROM near""")
def similarity_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    before = F.lag("embedding").over(W.partitionBy(F.expr("vec_id div 100")).orderBy("vec_id"))
    near = table(spark, sf_dir, "embeddings").withColumn("like", C.cosine(before, "embedding"))
    return near.select("vec_id", F.round("like", 6).alias("similarity"), (F.col("like") < V.BOUNDARY_THRESHOLD).alias("drops"))


# -- chunks -----------------------------------------------------------------------------


def _document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as one element each, without overlap."""
    docs = P.spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return S.text_chunks(docs, overlap_tokens=0)


_DOC_CHUNKS = f"""{_DOC_SENTENCES}, said AS (SELECT doc_id, nth AS pos, sentence, CASE WHEN nth = 0 THEN 'hard' END AS boundary FROM sentences),
{packing_sql('said', V.MAX_TOKENS, 0)},
chunks AS (SELECT p.doc_id, CAST(p.nth AS INTEGER) AS sequence, string_agg(s.sentence, ' ' ORDER BY s.pos) AS content FROM packed p JOIN said s ON s.doc_id = p.doc_id AND s.pos >= p.a AND s.pos < p.e GROUP BY p.doc_id, p.nth),
counted_chunks AS (SELECT *, CAST(greatest(1, length(content) // 4) AS BIGINT) AS token_count FROM chunks)"""


@query(f"WITH RECURSIVE {_DOC_CHUNKS} SELECT doc_id, sequence, token_count, content FROM counted_chunks")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_chunks(spark, sf_dir).select("doc_id", F.col("nth").alias("sequence"), "token_count", "content")


@query(f"""WITH RECURSIVE {_DOC_CHUNKS} SELECT d.doc_id, count(c.doc_id) AS num_chunks, round(coalesce(avg(c.token_count), 0), 6) AS avg_tokens
FROM documents d LEFT JOIN counted_chunks c USING (doc_id) GROUP BY d.doc_id""")
def chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = K.responses(table(spark, sf_dir, "documents"), _document_chunks(spark, sf_dir))
    return got.withColumn("avg_tokens", F.round("avg_tokens", 6))


@query()
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over all documents, a row each, without a shuffle."""
    return P.chunk_markdown(table(spark, sf_dir, "documents")).drop("parent_chunk_id")


def _parsed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chunk_documents(D.decode_documents(_documents(spark, sf_dir)))


@query()
def parsed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over parsed documents: headings, backmatter, tables, captions."""
    return _parsed_chunks(spark, sf_dir).drop("parent_chunk_id")


_SHORT = f"""{LINES}, short AS (SELECT doc_id, ord, substr(line, 1, 12) AS head, CASE ord % 4 WHEN 0 THEN substr(line, 1, 12) || chr(10) || line
    WHEN 1 THEN substr(line, 1, 12) || ' ' || line WHEN 2 THEN substr(line, 1, 12) ELSE '  ' || line END AS content FROM lines)"""


@query(f"""WITH {_SHORT}, cut AS (SELECT *, regexp_replace(content, '^\\s+', '') AS body FROM short),
off AS (SELECT *, CASE WHEN head <> '' AND (body = head OR starts_with(body, head || chr(10))) THEN regexp_replace(substr(body, length(head) + 1), '^\\n* *\\n*', '') ELSE body END AS rest FROM cut)
SELECT doc_id, ord, content, CAST(greatest(1, length(content) // 4) AS BIGINT) AS token_count
FROM (SELECT doc_id, ord, head || chr(10) || chr(10) || rest AS content FROM off)""")
def headings_prepended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings before content that begins with them, or does not."""
    head = F.substring("line", 1, 12)
    n = F.col("ord") % 4
    content = F.when(n == 0, F.concat_ws("\n", head, "line")).when(n == 1, F.concat_ws(" ", head, "line")).when(n == 2, head).otherwise(F.concat(F.lit("  "), "line"))
    rows = lines(spark, sf_dir).select("doc_id", "ord", content.alias("content"), F.array(head).alias("pending"))
    return H.with_headings(rows).select("doc_id", "ord", "content", "token_count")


@query(f"""WITH {_ROLES}, ends AS (SELECT doc_id, max(CASE WHEN role <> 'heading' THEN ord END) AS last FROM runs GROUP BY doc_id),
tails AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY ord) AS headings FROM runs JOIN ends USING (doc_id) WHERE role = 'heading' AND (last IS NULL OR ord > last) GROUP BY doc_id),
chunks AS (SELECT doc_id, ord, content, row_number() OVER (PARTITION BY doc_id ORDER BY ord DESC) = 1 AS final FROM runs WHERE role <> 'heading')
SELECT doc_id, ord, CASE WHEN final AND headings IS NOT NULL THEN content || chr(10) || chr(10) || headings ELSE content END AS content FROM chunks LEFT JOIN tails USING (doc_id)""")
def trailing_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _runs(spark, sf_dir)
    chunks = rows.where("role <> 'heading'").withColumn("token_count", C.token_count("content"))
    return H.with_trailing(chunks, E.trailing_headings(rows)).select("doc_id", "ord", "content")


@query()
def small_chunks_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each prose line and table of a document as a chunk; the small ones merge."""
    rows = _runs(spark, sf_dir).where("role <> 'heading'")
    chunks = rows.select(
        "doc_id", "ord", "content", C.token_count("content").alias("token_count"), F.array("page").alias("page_numbers"), F.lit(0).alias("span_start"),
        F.length("content").alias("span_end"), F.when(F.col("role") == "block", C.block_kind("kind")).otherwise("prose").alias("dominant_type"), F.lit(False).alias("divided"),
    )
    out = H.without_repeated_spans(H.without_small(chunks, V.MAX_TOKENS))
    return B.number(out).select("doc_id", "sequence", "content", "token_count", F.array_join("page_numbers", ",").alias("pages"), "span_start", "span_end", "dominant_type")


@query(f"WITH {_DOC_SENTENCES} SELECT doc_id, nth, CAST(greatest(1, length(sentence) // 4) AS BIGINT) AS tokens, 384 AS dimensions, CAST(1.0 AS DOUBLE) AS similarity FROM sentences")
def sentences_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in's vectors: all alike, of length one."""
    out = H.embedded(_said(spark, sf_dir))
    like = F.round(C.cosine("embedding", "embedding"), 6)
    return out.select("doc_id", "nth", "tokens", F.size("embedding").alias("dimensions"), like.alias("similarity"))


@query(f"""WITH RECURSIVE {_DOC_CHUNKS} SELECT doc_id, sequence, '[' || lpad(CAST(sequence AS VARCHAR), 3, ' ') || '] prose         ' || lpad(CAST(token_count AS VARCHAR), 5, ' ')
  || ' tok  ' || repeat(' ', 30) || ' ' || substr(trim(regexp_replace(content, '\\s+', ' ', 'g')), 1, 70) AS line FROM counted_chunks""")
def document_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _document_chunks(spark, sf_dir).select("doc_id", F.col("nth").alias("sequence"), "token_count", "content", F.lit("prose").alias("dominant_type"), F.lit("{}").alias("metadata"))
    return K.summary(chunks)


def _whole_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole texts with all fields; the nearest heading is how the text begins."""
    none, false = F.lit(None), F.lit(False)
    heading = F.to_json(F.struct(F.regexp_replace(F.substring("content", 1, 45), r"\s", "_").alias("nearest_heading")))
    return _document_chunks(spark, sf_dir).select(
        "doc_id", F.col("nth").alias("sequence"), "content", "token_count", "page_numbers", "span_start", "span_end", F.lit("semantic").alias("chunking_method"),
        none.cast("string").alias("parent_chunk_id"), F.lit("prose").alias("dominant_type"), none.cast("int").alias("block_sequence"),
        false.alias("has_code"), false.alias("has_math"), false.alias("has_table"), heading.alias("metadata"),
    )


_RECORDS = f"""{_DOC_CHUNKS},
spanned AS (SELECT p.doc_id, CAST(p.nth AS INTEGER) AS sequence, min(s."begin") AS span_start, max(s."end") AS span_end
  FROM packed p JOIN sentences s ON s.doc_id = p.doc_id AND s.nth >= p.a AND s.nth < p.e GROUP BY p.doc_id, p.nth),
recorded AS (SELECT doc_id, sequence, CAST(json_object('sequence', sequence, 'content', content, 'token_count', token_count, 'page_numbers', [1],
  'span_start', span_start, 'span_end', span_end, 'chunking_method', 'semantic', 'parent_chunk_id', NULL, 'dominant_type', 'prose', 'block_sequence', NULL,
  'has_code', false, 'has_math', false, 'has_table', false,
  'metadata', json_object('nearest_heading', regexp_replace(substr(content, 1, 45), '\\s', '_', 'g'))) AS VARCHAR) AS record
  FROM counted_chunks JOIN spanned USING (doc_id, sequence))"""


@query(f"WITH RECURSIVE {_RECORDS} SELECT doc_id, sequence, record FROM recorded")
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.records(_whole_chunks(spark, sf_dir))


@query(f"""WITH RECURSIVE {_DOC_CHUNKS} SELECT doc_id, sequence, '[' || lpad(CAST(sequence AS VARCHAR), 3, ' ') || '] prose         ' || lpad(CAST(token_count AS VARCHAR), 5, ' ')
  || ' tok  ' || rpad(regexp_replace(substr(content, 1, 30), '\\s', '_', 'g'), 30, ' ') || ' ' || substr(trim(regexp_replace(content, '\\s+', ' ', 'g')), 1, 70) AS line FROM counted_chunks""")
def chunk_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.summary(_whole_chunks(spark, sf_dir))


@query(f"WITH RECURSIVE {_RECORDS} SELECT doc_id, '[' || string_agg(record, ',' ORDER BY sequence) || ']' AS json FROM recorded GROUP BY doc_id")
def chunks_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.as_json(_whole_chunks(spark, sf_dir))


def _code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of blocks: every fourth a divided one, whose parts are the three after it."""
    n = F.col("ord") % 4
    return lines(spark, sf_dir).select(
        "doc_id", F.col("ord").alias("sequence"), F.when(n == 0, '{"has_children": true}').otherwise("{}").alias("metadata"),
        F.when(n > 0, n - 1).cast("int").alias("block_sequence"),
    )


@query(f"WITH {LINES} SELECT doc_id, ord AS sequence, CASE WHEN ord % 4 > 0 THEN ord - ord % 4 ELSE -1 END AS parent_sequence FROM lines")
def parents_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.with_parent(_code_blocks(spark, sf_dir)).select("doc_id", "sequence", F.coalesce("parent_sequence", F.lit(-1)).alias("parent_sequence"))


@query()
def spans_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent repeats of word spans in each line."""

    @by_row("struct<text:string,removed:int>")
    def collapse(text: str | None) -> dict:
        return dict(zip(("text", "removed"), collapse_spans(text)))

    return lines(spark, sf_dir).select("doc_id", "ord", collapse("line").alias("c")).select("doc_id", "ord", "c.text", "c.removed")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_chunks(spark, sf_dir)
