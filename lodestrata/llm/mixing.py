"""Mixing sources to target weights by hash-threshold histograms (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, row_of, word_count

#: Bits of a document's hash that one level of the histogram resolves, and the number of levels (48 bits in all).
LEVEL_BITS = 12
LEVELS = 4


def rank_sources(sources: DataFrame) -> DataFrame:
    """Adds rank from 0 by code point, null last: a range sort, counts by partition and their prefix sums."""
    ordered = cut(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    base, starts = 0, {}
    for part, n in sorted((r["part"], r["n"]) for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row a partition
        starts[part], base = base, base + n
    if not starts:
        return ordered.drop("part").withColumn("rank", F.lit(0))
    first = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ordered.withColumn("rank", F.element_at(first, F.col("part")) + within - 1).drop("part")


def targets(sources: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    The sources, ranked by code point with null last, take weights in turn and divide share of all sizes among them;
    a target stops at most times its source's size, and the excess goes to the others by weight until none is above.
    That is min(most * size, level * weight) with one level for all, found by a few sums over the table of sources.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut(rank_sources(sources).withColumn("weight", weight))
    cap = F.col("source_size") * most
    total, all_weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level, capped = share * (total or 0), (share * (total or 0)) / (all_weight or 1), -1
    while True:
        over = cap <= F.lit(level) * F.col("weight")
        n, held, free = ranked.agg(F.count(F.when(over, 1)), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, level = n, (budget - (held or 0)) / free
    if not free:  # every source is at its cap
        level = float("inf")
    return ranked.select("source", "source_size", F.least(cap.cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def thresholds(sizes: DataFrame, aims: DataFrame) -> DataFrame:
    """A row for each (skey, b0) of sizes: whole, the copies every document takes, and below, the hash under which one takes one more.

    Level 0 sums the sizes of each source by the hash's first bits; the running sum finds the bucket in which the
    source's fractional budget ends. Only that bucket is summed anew by the next bits, and so on; all other buckets
    are wholly in or out. The last bucket goes in if that brings the sum nearer the budget.
    """
    per = Window.partitionBy("skey").orderBy("bucket")
    hist = cut(sizes.groupBy("skey", F.col("b0").alias("bucket")).agg(F.sum("size").alias("size")))
    state = aims.select("skey", "whole", "budget", F.lit(0).cast("long").alias("prefix"))
    level = hist
    for depth in range(LEVELS):
        last = depth == LEVELS - 1
        run = level.withColumn("upto", F.sum("size").over(per)).join(state, "skey")
        # the bucket that holds the budget's end; the first whose running sum is above it
        edge = run.where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("size") <= F.col("budget")))
        left = F.col("budget") - (F.col("upto") - F.col("size"))
        take = F.when(F.lit(last) & (left * 2 >= F.col("size")), 1).otherwise(0)
        state = cut(edge.select("skey", "whole", left.alias("budget"), (F.col("prefix") * (1 << LEVEL_BITS) + F.col("bucket") + take).alias("prefix")))
        if not last:
            span = (depth + 1) * LEVEL_BITS
            inside = sizes.join(state.select("skey", F.col("prefix").alias("at"), F.shiftright("prefix", depth * LEVEL_BITS).alias("b0")), ["skey", "b0"])
            inside = inside.where(F.shiftright("h", LEVELS * LEVEL_BITS - span) == F.col("at"))
            bucket = F.shiftright("h", LEVELS * LEVEL_BITS - span - LEVEL_BITS).bitwiseAND((1 << LEVEL_BITS) - 1)
            level = inside.groupBy("skey", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
    edges = state.select("skey", F.col("prefix").alias("below"))
    # a source without an edge takes its whole budget: it is 0, or no bucket holds any words
    return hist.select("skey", F.col("bucket").alias("b0")).join(aims.select("skey", "whole", "source_size", "target"), "skey").join(edges, "skey", "left").withColumn("below", F.coalesce("below", F.lit(0)))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: Sequence[float] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """Sizes and copies: (key, h, size, source, source_size, target, copies), one row for each document.

    Sizes are words. A document takes floor(target / source_size) copies and one more if its hash is under its source's
    threshold, so never more than most. The hash covers key and text: rows alike in both share one fate, copies of a text
    under other keys do not. Null source: a source of its own, ranked last. Null text and empty text: size 0. Null keys
    are told apart by text. An empty table gives no rows. Sources with no words have target 0 and copies 0.
    """
    h = F.shiftrightunsigned(F.xxhash64(F.col(key), F.col(text)), 64 - LEVELS * LEVEL_BITS)
    sizes = docs.select(F.col(key).alias("key"), h.alias("h"), word_count(F.col(text)).alias("size"), F.col(source).alias("source"))
    sizes = sizes.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("b0", F.shiftright("h", (LEVELS - 1) * LEVEL_BITS))
    sizes = cut(sizes)
    aims = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aims = aims.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("whole", whole)
    aims = cut(aims.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")))
    verdict = thresholds(sizes, aims)
    # keyed by source and bucket: a source with a third of all rows is spread over its buckets
    copies = F.when(F.col("source_size") > 0, F.least(F.col("whole") + F.when(F.col("h") < F.col("below"), 1).otherwise(0), F.lit(most))).otherwise(0)
    return sizes.join(verdict, ["skey", "b0"]).select("key", "h", "size", "source", "source_size", "target", copies.cast("long").alias("copies"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """The documents that the mix takes, as many times as it takes them, with docs' own columns."""
    took = mix(docs, text, source, key, **how).where("copies > 0").select(F.struct("key", "h", "copies").alias("took")).distinct()
    hashed = docs.select(row_of(docs), F.shiftrightunsigned(F.xxhash64(F.col(key), F.col(text)), 64 - LEVELS * LEVEL_BITS).alias("hash"))
    out = hashed.join(took, F.col("row")[key].eqNullSafe(F.col("took.key")) & (F.col("hash") == F.col("took.h")))
    out = out.select("row", F.explode(F.sequence(F.lit(1), F.col("took.copies").cast("int"))).alias("nth"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
