"""Decoded blocks by key: lookups, the best coarser level, generations and eviction, and the resolution of misses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.keys import MAX_LODS, pack, unpack
from lodestrata.operators.store import REAL


def hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests with hit."""
    return requests.join(cache.select("key", F.lit(True).alias("hit")), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """The keys asked for that the cache hasn't got, each once."""
    return requests.select("key").distinct().join(cache.select("key"), "key", "left_anti")


def best_level(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """(key, found, lod) for each key with a block in the cache at its level or a coarser one: the finest such.

    A key makes a candidate for each coarser level, and candidates meet the cache by equality.
    """
    k = unpack(F.col("key"))
    up = F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(MAX_LODS - 1)), lambda i: F.struct((k["lod"] + i).alias("lod"), i.alias("i"))), lambda s: s["lod"] < MAX_LODS)).alias("s")
    near = keys.select("key").distinct().select("key", up).select("key", "s.lod", "s.i")
    k = unpack(F.col("key"))
    half = lambda c: F.floor(k[c] / F.pow(F.lit(2.0), F.col("i")))
    near = near.select("key", "lod", pack(F.col("lod"), half("bz"), half("by"), half("bx")).alias("found"))
    hit = near.join(cache.select(F.col("key").alias("found")), "found")
    return hit.groupBy("key").agg(F.min_by("found", "lod").alias("found"), F.min("lod").alias("lod"))


def apply(cache: DataFrame, fresh: DataFrame, touched: DataFrame, tick: int, capacity: int) -> DataFrame:
    """The cache (key, gen) after a tick: keys inserted or touched get the new tick; over capacity, those with the lowest (gen, key) go.

    No key of this tick goes while an older one is left.
    """
    stamped = cache.join(touched.select("key").distinct().withColumn("_t", F.lit(True)), "key", "left").select("key", F.when(F.col("_t"), F.lit(tick)).otherwise(F.col("gen")).cast("int").alias("gen"))
    both = stamped.unionByName(fresh.select("key", F.lit(tick).cast("int").alias("gen"))).groupBy("key").agg(F.max("gen").alias("gen"))
    return kept(both, capacity)


def kept(cache: DataFrame, capacity: int) -> DataFrame:
    """The capacity rows with the highest generation, ties to the larger key: a top-k, which needs no global sort."""
    return cache.orderBy(F.desc("gen"), F.desc("key")).limit(capacity)


def eviction_rank(cache: DataFrame, by: list[str]) -> DataFrame:
    """Adds rank within by: the order in which entries stay."""
    return cache.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("gen"), F.desc("key"))))


def latest(writes: DataFrame) -> DataFrame:
    """Upserts (key, gen, value): the value with the highest generation of each key."""
    return writes.groupBy("key").agg(F.max_by("value", "gen").alias("value"), F.max("gen").alias("gen"))


def gathered(requests: DataFrame) -> DataFrame:
    """Requests of all consumers as distinct keys with how many asked."""
    return requests.groupBy("key").agg(F.count("*").alias("asked"))


def classified(keys: DataFrame, occupancy: DataFrame, present: DataFrame) -> DataFrame:
    """(key, kind): decode, where the chunk is real and holds the block, zero where it is known to hold nothing there, and wait where the chunk isn't known.

    occupancy is (cz, cy, cx, state) and present (key). A block of an unknown chunk is not taken for zero, so a later fetch is seen.
    """
    from lodestrata.functions.keys import address

    a = address(F.col("key"))
    at = keys.select("key", *[a[c].alias(c) for c in ("cz", "cy", "cx")])
    out = at.join(occupancy.select("cz", "cy", "cx", "state"), ["cz", "cy", "cx"], "left").join(present.select("key", F.lit(True).alias("here")), "key", "left")
    known = F.coalesce("state", F.lit(0))
    kind = F.when(known == 0, "wait").when((known == REAL) & F.col("here"), "decode").otherwise("zero")
    return out.select("key", kind.alias("kind"))
