"""Mixing sources to target weights along a time-varying curriculum.

A source's schedule is its rate of tokens over training progress 0..1, piecewise
linear between knots. Its integral, scaled to the source's target, is the
cumulative token demand; documents of a source stand in a fixed pseudo-random
order on that axis, so that inverting the demand at a document's first token gives
its training position. Sorting all occurrences by position is the mixed order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_name, numbered, word_count, written

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: Knots (progress, rate) by rank of the source, repeating: sources of large weight
#: come in rising amounts, those of small weight in falling ones.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)))
#: A source gives its words at most so often.
MAX_EPOCHS = 3


def inverse_demand(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Progress at which ``share`` (0..1) of a schedule's integral is reached.

    On a segment with rates r0 to r1 over dt the demand is quadratic; the root is
    taken in the form that also holds for r0 = r1.
    """
    area = sum((t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(knots, knots[1:]))
    below, out = 0.0, F.lit(float(knots[-1][0]))
    pieces = []
    for (t0, r0), (t1, r1) in zip(knots, knots[1:]):
        r0, r1 = r0 / area, r1 / area
        rest, slope = share - F.lit(below), 2 * (r1 - r0) / (t1 - t0)
        at = F.lit(t0) + (F.lit(2.0) * rest) / (F.lit(r0) + F.sqrt(F.lit(r0 * r0) + F.lit(slope) * rest))
        top = below + (t1 - t0) * (r0 + r1) / 2
        pieces.append((top, F.when(rest > 0, at).otherwise(F.lit(t0))))
        below = top
    for top, at in reversed(pieces):
        out = F.when(share <= F.lit(top), at).otherwise(out)
    return out


def source_targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of sources ``(no_source, source, source_size)``, one row each.

    All targets sum to all sizes. A target stops at ``max_epochs`` times its
    source's size and its excess goes to the others by weight, until none is above:
    in order of cap by weight, the first level at which the remaining words fit the
    remaining weights (levels only fall after it, so it is the largest that fits). The
    windows run over one row a source.
    """
    order = W.orderBy("no_source", "source")
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("nth") % n + 1).cast("int"))
    by_cap = W.orderBy("ratio", "nth")
    ranked = (
        totals.withColumn("nth", F.row_number().over(order) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", (F.lit(max_epochs) * F.col("source_size")).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("all_size", F.sum("source_size").over(W.partitionBy()))
        .withColumn("capped_before", F.sum("cap").over(by_cap) - F.col("cap"))
        .withColumn("weight_left", F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("all_size") - F.col("capped_before")) / F.col("weight_left"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(W.partitionBy()))
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return ranked.select("no_source", "source", "source_size", "nth", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    max_epochs: int = MAX_EPOCHS,
    row_col: str | None = None,
) -> DataFrame:
    """A row for every input row, range-sorted by its first training position.

    Columns: ``doc_id, source, size`` (words), ``source_size, target, taken`` (words
    the mix takes, repeats counted), ``position`` (0..1, null where nothing is
    taken), ``positions`` (one for each begun pass over the document) and ``row_id``
    (``row_col``, else a number). Null text has size 0 and nothing is taken of it; a null
    source is a source of its own, the last; rows without an id stand in the order of their
    numbers' digests; repeated rows count each. An empty table gives no rows.

    Words before a document come from three levels of sums (256 x 256 bins of the
    order within a source), so that no task holds a hot source.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    # rows without an id have one key each, so that they don't all lie in one bin
    sized = docs.withColumn(number := fresh_name(docs, "number"), row)
    key = F.md5(F.encode(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("row "), F.col(number).cast("string"))), "UTF-8"))
    sized = written(
        sized.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).isNull().alias("no_source"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            key.alias("key"),
            F.col(number).alias("row_id"),
        ).select(
            "*",
            F.conv(F.substring("key", 1, 2), 16, 10).cast("int").alias("hi"),
            F.conv(F.substring("key", 3, 2), 16, 10).cast("int").alias("lo"),
        ),
        "sized",
    )
    bins = sized.groupBy("no_source", "source", "hi", "lo").agg(F.sum("size").alias("words"))
    in_hi = W.partitionBy("no_source", "source", "hi").orderBy("lo")
    bins = bins.withColumn("lo_before", F.sum("words").over(in_hi) - F.col("words"))
    his = sized.groupBy("no_source", "source", "hi").agg(F.sum("size").alias("words"))
    in_source = W.partitionBy("no_source", "source")
    his = his.select(
        "no_source",
        "source",
        "hi",
        (F.sum("words").over(in_source.orderBy("hi")) - F.col("words")).alias("hi_before"),
    )
    totals = sized.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, max_epochs)
    source = ["no_source", "source"]
    bins = written(
        bins.join(his, [*source, "hi"])
        .join(targets, source)
        .select(
            *source, "hi", "lo", "nth", "source_size", "target", (F.col("lo_before") + F.col("hi_before")).alias("bin_before")
        ),
        "bins",
    )
    in_bin = W.partitionBy(*source, "hi", "lo").orderBy("key", "doc_id", "row_id")
    before = F.col("bin_before") + F.sum("size").over(in_bin) - F.col("size")
    wanted = F.floor(F.col("target") + 0.5).cast("long")
    n = len(schedules)
    taken, positions = F.lit(0), []
    for e in range(max_epochs):
        start = F.col("before") + e * F.col("source_size")
        taken = taken + F.greatest(F.lit(0), F.least(F.col("size"), wanted - start))
        at = F.lit(None).cast("double")
        for i, knots in enumerate(schedules):
            at = F.when(F.col("nth") % n == i, inverse_demand(start / F.col("target"), knots)).otherwise(at)
        positions.append(F.when((F.col("size") > 0) & (start < wanted), F.round(at, 9)))
    return (
        sized.join(bins, [*source, "hi", "lo"])
        .withColumn("before", before)
        .withColumn("taken", taken.cast("long"))
        .withColumn("positions", F.array_compact(F.array(*positions)))
        .select(
            "doc_id",
            F.when(~F.col("no_source"), F.col("source")).alias("source"),
            "size",
            "source_size",
            "target",
            "taken",
            F.try_element_at("positions", F.lit(1)).alias("position"),
            "positions",
            "row_id",
        )
        .orderBy("position", "doc_id", "row_id")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, range-sorted by training position, with the columns of ``docs``.

    A document comes once for every full or begun pass that the mix makes over it;
    one of which nothing is taken doesn't come.
    """
    row, at = fresh_name(docs, "row"), fresh_name(docs, "position")
    marked = numbered(docs, row)
    plan = mix(marked, id_col, text_col, source_col, row_col=row).where("taken > 0")
    plan = plan.select(F.col("row_id").alias(row), F.explode("positions").alias(at))
    return marked.join(plan, row).orderBy(at, row).select(*[marked[f"`{c}`"] for c in docs.columns])
