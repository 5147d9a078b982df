"""Queries: chunk tables, occupancy, regions, byte formats, cache, coordination, mirroring and streams."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from lodestrata.functions.keys import Geometry, div, pack
from lodestrata.operators import cache, cells, codec, store
from lodestrata.sources import bytes as sb
from lodestrata.streaming import mirror

from . import fixtures as fx
from .scalars import KEYED, keyed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def folder(spark, what: str) -> str:
    """A new folder below spark.checkpoint.dir, or the warehouse if that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


OFFSETS = f"SELECT CAST(doc_id // 4096 AS BIGINT) AS chunk, k, len, CAST(16404 + coalesce(sum(len) OVER (PARTITION BY doc_id // 4096 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM ({fx.PAYLOAD})"


def payloads(spark, sf_dir):
    return fx.payload(spark, sf_dir).select(F.floor(F.col("doc_id") / 4096).alias("chunk"), "k", "len")


@query("chunk_offsets", OFFSETS)
def chunk_offsets(spark, sf_dir):
    return store.offset_table(payloads(spark, sf_dir), ["chunk"])


@query("chunk_lengths", f"SELECT chunk, CAST(max(off + len) AS BIGINT) AS length FROM ({OFFSETS}) GROUP BY chunk")
def chunk_lengths(spark, sf_dir):
    return store.chunk_lengths(payloads(spark, sf_dir), ["chunk"])


@query("chunk_spans", f"SELECT chunk, k, off, off + len AS \"end\", true AS ok FROM ({OFFSETS})")
def chunk_spans(spark, sf_dir):
    p = payloads(spark, sf_dir)
    return store.spans(store.offset_table(p, ["chunk"]), store.chunk_lengths(p, ["chunk"]), ["chunk"])


@query("chunk_verify", "SELECT page_id, true AS whole, false AS damaged FROM pages")
def chunk_verify(spark, sf_dir):
    @F.arrow_udf("struct<whole boolean, damaged boolean>")
    def of(pages: pa.Array) -> pa.Array:
        out = []
        for p in pages.cast(pa.binary()).to_pylist():
            image = sb.build_chunk({0: p[: len(p) // 2], 2: p[len(p) // 2 :] or b"x"})
            out.append({"whole": sb.Chunk(image).verify(), "damaged": sb.Chunk(image[:-1] + bytes([image[-1] ^ 1])).verify()})
        return pa.array(out, pa.struct([("whole", pa.bool_()), ("damaged", pa.bool_())]))

    return fx.table(spark, sf_dir, "pages").select("page_id", of("html").alias("r")).select("page_id", "r.whole", "r.damaged")


@query("chunk_garbage", "SELECT page_id, false AS verified FROM pages")
def chunk_garbage(spark, sf_dir):
    @F.arrow_udf("boolean")
    def of(pages: pa.Array) -> pa.Array:
        out = []
        for p in pages.cast(pa.binary()).to_pylist():
            view = sb.Chunk(p * (1 + sb.HEADER // max(1, len(p))))
            list(view.blocks())
            out.append(view.verify())
        return pa.array(out)

    return fx.table(spark, sf_dir, "pages").select("page_id", of("html").alias("verified"))


@query("chunk_source", "SELECT CAST(page_id // 100 AS INT) AS cz, CAST(page_id % 100 AS INT) AS k, sha256(html) AS digest FROM pages")
def chunk_source(spark, sf_dir):
    """Pages as blocks of chunk images, written and read by the data source."""
    spark.dataSource.register(sb.ChunkSource)
    at = folder(spark, "chunks")
    rows = fx.table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 100).cast("int").alias("cz"), F.lit(0).alias("cy"), F.lit(0).alias("cx"), (F.col("page_id") % 100).cast("int").alias("k"), F.encode("html", "UTF-8").alias("payload"))
    rows.repartition("cz", "cy", "cx").write.format("lodestrata_chunks").option("path", at).mode("append").save()
    out = spark.read.format("lodestrata_chunks").option("path", at).load()
    return out.select("cz", "k", F.sha2("payload", 256).alias("digest"))


@query("occupancy_state", f"SELECT slot, coalesce(max(state), 0) AS state FROM (SELECT i AS slot FROM range(80) r(i)) LEFT JOIN ({fx.OCC}) o USING (slot) GROUP BY slot")
def occupancy_state(spark, sf_dir):
    return store.state(spark.range(80).withColumnRenamed("id", "slot"), fx.occ(spark, sf_dir), ["slot"])


PACKED = f"SELECT slot // 4 AS byte, CAST(sum(state * pow(4, slot % 4)) AS INT) AS bits FROM ({fx.OCC}) GROUP BY 1"


@query("occupancy_pack", PACKED)
def occupancy_pack(spark, sf_dir):
    return store.packed(fx.occ(spark, sf_dir))


@query("occupancy_unpack", f"SELECT slot, state FROM ({fx.OCC})")
def occupancy_unpack(spark, sf_dir):
    return store.unpacked(store.packed(fx.occ(spark, sf_dir)), 64)


@query("occupancy_counts", f"SELECT state, count(*) AS n FROM ({fx.OCC}) GROUP BY state")
def occupancy_counts(spark, sf_dir):
    return fx.occ(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


@query("chunk_latest", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def chunk_latest(spark, sf_dir):
    return store.latest(fx.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value")


LOW, SIZE = (10, 20, 5), (20, 16, 40)
BOX = f"SELECT z, y, x, v FROM ({fx.VOX}) WHERE z BETWEEN 10 AND 29 AND y BETWEEN 20 AND 35 AND x BETWEEN 5 AND 44"


def stored_voxels(spark, sf_dir):
    """Voxels in a table partitioned by chunk (16 samples a side here), with block columns."""
    at = folder(spark, "voxels")
    rows = fx.vox(spark, sf_dir).select(*[div(F.col(c), 16).alias(f"c{c}") for c in "zyx"], *[div(F.col(c), 16).alias(f"b{c}") for c in "zyx"], "z", "y", "x", "v")
    rows.repartition("cz").write.partitionBy("cz", "cy", "cx").parquet(at)
    return spark.read.parquet(at)


@query("region_read", BOX)
def region_read(spark, sf_dir):
    return store.region(stored_voxels(spark, sf_dir), LOW, SIZE, 16).select("z", "y", "x", "v")


@query("region_chunks", f"SELECT DISTINCT z // 16 AS cz, y // 16 AS cy, x // 16 AS cx FROM ({BOX})")
def region_chunks(spark, sf_dir):
    return store.region(stored_voxels(spark, sf_dir), LOW, SIZE, 16).select("cz", "cy", "cx").distinct()


GRID = "SELECT CAST(10 + i // 640 AS INT) AS z, CAST(20 + i // 40 % 16 AS INT) AS y, CAST(5 + i % 40 AS INT) AS x FROM range(12800) r(i)"


@query("region_dense", f"SELECT g.z, g.y, g.x, coalesce(q.v, 0) AS v FROM ({GRID}) g LEFT JOIN ({fx.VOX}) q USING (z, y, x)")
def region_dense(spark, sf_dir):
    return cells.dense_box(fx.vox(spark, sf_dir), LOW, SIZE)


@query("region_empty", f"SELECT z, y, x, v FROM ({fx.VOX}) WHERE false")
def region_empty(spark, sf_dir):
    return cells.dense_box(fx.vox(spark, sf_dir), LOW, (0, 16, 40))


@query("region_strided", f"SELECT z, y, x, CAST((z - 10) * 2000 + (y - 20) * 50 + (x - 5) AS BIGINT) AS at FROM ({BOX})")
def region_strided(spark, sf_dir):
    box = fx.vox(spark, sf_dir).where("z BETWEEN 10 AND 29 AND y BETWEEN 20 AND 35 AND x BETWEEN 5 AND 44")
    return store.offsets_of(box, LOW, (2000, 50, 1)).select("z", "y", "x", "at")


SIDES = Geometry(fx.SIDE, fx.SIDE, fx.SIDE, 3, 16)


@query("volume_roundtrip", f"SELECT z, y, x FROM ({fx.VOX}) WHERE z BETWEEN 4 AND 23 AND y BETWEEN 2 AND 20 AND x BETWEEN 8 AND 30")
def volume_roundtrip(spark, sf_dir):
    """A volume written as coded blocks and a box of it read back: material is where it was."""
    at = folder(spark, "volume")
    store.write_volume(fx.vox(spark, sf_dir).withColumn("lod", F.lit(0)), at, store.Header(SIDES, 2.0))
    return store.read_region(spark, at, 0, (4, 2, 8), (20, 19, 23)).where("v > 0").select("z", "y", "x")


@query("volume_header", "SELECT 64 AS dz, 64 AS dy, 64 AS dx, 3 AS lods, 16 AS chunk, CAST(2.5 AS DOUBLE) AS q, 'u8' AS dtype, CAST(count(*) AS VARCHAR) AS cells FROM ({})".format(fx.VOX))
def volume_header(spark, sf_dir):
    """A header as a later reader finds it, with the number of cells as metadata."""
    at, vox = folder(spark, "volume"), fx.vox(spark, sf_dir)
    store.write_header(spark, at, store.Header(SIDES, 2.5, "u8", {"cells": str(vox.count())}))
    return store.header_rows(spark, at).select("dz", "dy", "dx", "lods", "chunk", "q", "dtype", F.col("metadata")["cells"].alias("cells"))


@query("volume_ingest", f"SELECT 0 AS lod, z, y, x FROM ({fx.MASKED}) UNION ALL SELECT 1, z // 2, y // 2, x // 2 FROM ({fx.MASKED}) GROUP BY ALL UNION ALL SELECT 2, z // 4, y // 4, x // 4 FROM ({fx.MASKED}) GROUP BY ALL")
def volume_ingest(spark, sf_dir):
    """All levels written in one go and read back: which places have material at each level."""
    at = folder(spark, "volume")
    store.ingest_volume(fx.vox(spark, sf_dir), at, 50, store.Header(SIDES, 2.0))
    level = lambda lod: store.read_region(spark, at, lod, (0, 0, 0), (fx.SIDE >> lod,) * 3).where("v > 0").select(F.lit(lod).alias("lod"), "z", "y", "x")
    return level(0).unionByName(level(1)).unionByName(level(2))


@query("chunk_rewrite", f"SELECT z, y, x FROM ({fx.VOX}) WHERE NOT (z < 16 AND y < 16 AND x < 32) OR (x < 16 AND z % 2 = 0)")
def chunk_rewrite(spark, sf_dir):
    """Two chunks of a stored volume replaced, one by every other layer of itself, one by air."""
    at, vox = folder(spark, "volume"), fx.vox(spark, sf_dir).withColumn("lod", F.lit(0))
    store.write_volume(vox, at, store.Header(SIDES, 2.0))
    named = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 0, 1)], "lod int, cz int, cy int, cx int")
    store.rewrite_chunks(vox.where("z % 2 = 0 AND x < 16"), at, named)
    return store.read_region(spark, at, 0, (0, 0, 0), (fx.SIDE,) * 3).where("v > 0").select("z", "y", "x")


@query("ranged_bytes", "SELECT doc_id, CASE WHEN doc_id % 50 + 20 <= strlen(text) THEN 'ok' ELSE 'out_of_range' END AS status, CASE WHEN doc_id % 50 + 20 <= strlen(text) THEN 20 ELSE -1 END AS got FROM documents")
def ranged_bytes(spark, sf_dir):
    part = sb.ranged(F.encode("text", "UTF-8"), (F.col("doc_id") % 50).cast("int"), F.lit(20))
    out = fx.table(spark, sf_dir, "documents").select("doc_id", part.alias("p"))
    return out.select("doc_id", F.when(F.col("p").isNull(), "out_of_range").otherwise("ok").alias("status"), F.coalesce(F.octet_length("p"), F.lit(-1)).alias("got"))


@query("error_kinds", "SELECT * FROM (VALUES ('ok'), ('io'), ('network'), ('out_of_range'), ('corrupt'), ('unsupported')) t(status)")
def error_kinds(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in ("ok", "io", "network", "out_of_range", "corrupt", "unsupported")], "status string")


def segments(spark):
    i = F.col("id")
    return spark.range(3 * 80 * 70).select(F.floor(i / 5600).cast("int").alias("surface"), (F.floor(i / 70) % 80).cast("int").alias("v"), (i % 70).cast("int").alias("u")).select("surface", "v", "u", (50 + F.col("surface") * 10 + 0.5 * F.col("u") + 0.25 * F.col("v")).alias("z"), (100 + 0.5 * F.col("v")).alias("y"), (200 + 0.5 * F.col("u")).alias("x"))


@query("segments_roundtrip", "SELECT CAST(i AS INT) AS surface, CAST(5600 AS BIGINT) AS points, true AS close FROM range(3) r(i)")
def segments_roundtrip(spark, sf_dir):
    p = segments(spark)
    back = sb.decode_segments(sb.encode_segments(p, 0.05), 0.05, 80, 70)
    both = p.join(back.select("surface", "v", "u", *[F.col(c).alias(f"b{c}") for c in "zyx"]), ["surface", "v", "u"])
    gap = F.greatest(*[F.abs(F.col(c) - F.col(f"b{c}")) for c in "zyx"])
    return both.groupBy("surface").agg(F.count("*").alias("points"), (F.max(gap) <= 1.0).alias("close"))


@query("segments_table", "SELECT CAST(i AS INT) AS surface, true AS ok FROM range(3) r(i)")
def segments_table(spark, sf_dir):
    toc = sb.segment_table(sb.encode_segments(segments(spark), 0.25))
    return toc.select("surface", ((F.col("off") >= sb.TOP + 3 * sb.ROW) & (F.col("len") > 16)).alias("ok"))


HELD = f"SELECT DISTINCT key FROM ({KEYED}) WHERE tick < 10"


@query("cache_hits", f"SELECT r.tick, r.consumer, r.key, h.key IS NOT NULL AS hit FROM ({KEYED}) r LEFT JOIN ({HELD}) h USING (key)")
def cache_hits(spark, sf_dir):
    k = keyed(spark, sf_dir)
    return cache.hits(k, k.where("tick < 10").select("key").distinct())


@query("cache_misses", f"SELECT DISTINCT key FROM ({KEYED}) WHERE key NOT IN (SELECT key FROM ({KEYED}) WHERE tick < 3)")
def cache_misses(spark, sf_dir):
    k = keyed(spark, sf_dir)
    return cache.misses(k, k.where("tick < 3").select("key").distinct())


COARSE = f"SELECT DISTINCT key FROM ({KEYED}) WHERE consumer % 5 = 0"


@query("cache_best_level", f"""WITH k AS (SELECT DISTINCT key FROM ({KEYED})), n AS (SELECT key, (key >> 48 & 7) + i AS lod, (((key >> 48 & 7) + i) << 48) | (CAST((key >> 32 & 65535) // (1 << i) AS BIGINT) << 32) | (CAST((key >> 16 & 65535) // (1 << i) AS BIGINT) << 16) | CAST((key & 65535) // (1 << i) AS BIGINT) AS found FROM k, range(8) r(i) WHERE (key >> 48 & 7) + i < 8)
SELECT n.key, arg_min(found, lod) AS found, CAST(min(lod) AS INT) AS lod FROM n JOIN ({COARSE}) c ON c.key = n.found GROUP BY n.key""")
def cache_best_level(spark, sf_dir):
    k = keyed(spark, sf_dir)
    return cache.best_level(k, k.where("consumer % 5 = 0").select("key").distinct())


GEN = f"SELECT key, CAST(max(tick) AS INT) AS gen FROM ({KEYED}) GROUP BY key"


@query("cache_evict", f"SELECT key, gen FROM ({GEN}) ORDER BY gen DESC, key DESC LIMIT 60")
def cache_evict(spark, sf_dir):
    k = keyed(spark, sf_dir)
    return cache.kept(k.groupBy("key").agg(F.max("tick").cast("int").alias("gen")), 60)


@query("cache_rank", f"SELECT key, gen, CAST(key >> 48 & 7 AS INT) AS lod, CAST(row_number() OVER (PARTITION BY key >> 48 & 7 ORDER BY gen DESC, key DESC) AS INT) AS rank FROM ({GEN})")
def cache_rank(spark, sf_dir):
    from lodestrata.functions.keys import unpack

    k = keyed(spark, sf_dir).groupBy("key").agg(F.max("tick").cast("int").alias("gen"))
    return cache.eviction_rank(k.withColumn("lod", unpack(F.col("key"))["lod"]), ["lod"])


@query("cache_tick", f"WITH c AS (SELECT key, CAST(max(tick) AS INT) AS gen FROM ({KEYED}) WHERE tick < 5 GROUP BY key), q AS (SELECT DISTINCT key FROM ({KEYED}) WHERE tick = 6), u AS (SELECT key, CASE WHEN key IN (SELECT key FROM q) THEN 6 ELSE gen END AS gen FROM c UNION SELECT key, 6 FROM q) SELECT key, CAST(max(gen) AS INT) AS gen FROM u GROUP BY key ORDER BY max(gen) DESC, key DESC LIMIT 100")
def cache_tick(spark, sf_dir):
    k = keyed(spark, sf_dir)
    now = k.where("tick < 5").groupBy("key").agg(F.max("tick").cast("int").alias("gen"))
    asked = k.where("tick = 6").select("key").distinct()
    return cache.apply(now, cache.misses(asked, now), asked, 6, 100)


@query("cache_upsert", "SELECT user_id AS key, arg_max(event_type, event_id) AS value, max(event_id) AS gen FROM events GROUP BY user_id")
def cache_upsert(spark, sf_dir):
    return cache.latest(fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("gen")))


@query("cache_counters", f"SELECT count(DISTINCT key) AS live, CAST(max(tick) AS BIGINT) AS tick FROM ({KEYED})")
def cache_counters(spark, sf_dir):
    return keyed(spark, sf_dir).agg(F.count_distinct("key").alias("live"), F.max("tick").alias("tick"))


@query("resolve_gather", f"SELECT key, count(*) AS asked FROM ({KEYED}) GROUP BY key")
def resolve_gather(spark, sf_dir):
    return cache.gathered(keyed(spark, sf_dir))


BLOCK_KEYS = "SELECT DISTINCT ((o_orderkey % 64) << 32) | ((o_custkey % 64) << 16) | (o_orderkey // 7 % 64) AS key FROM orders"


def block_keys(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return fx.table(spark, sf_dir, "orders").select(pack(F.lit(0), o % 64, c % 64, F.floor(o / 7) % 64).alias("key")).distinct()


CLASSES = f"SELECT k.key, CASE WHEN coalesce(o.state, 0) = 0 THEN 'wait' WHEN o.state = 2 AND k.key % 3 <> 0 THEN 'decode' ELSE 'zero' END AS kind FROM ({BLOCK_KEYS}) k LEFT JOIN ({fx.OCC}) o ON o.cz = (k.key >> 32 & 65535) // 16 AND o.cy = (k.key >> 16 & 65535) // 16 AND o.cx = (k.key & 65535) // 16"


@query("resolve_classify", CLASSES)
def resolve_classify(spark, sf_dir):
    k = block_keys(spark, sf_dir)
    return cache.classified(k, fx.occ(spark, sf_dir), k.where("key % 3 <> 0"))


@query("resolve_counts", f"SELECT kind, count(*) AS n FROM ({CLASSES}) GROUP BY kind")
def resolve_counts(spark, sf_dir):
    return resolve_classify(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@query("resolve_decode", "SELECT true AS mean_close, CAST(count(*) AS BIGINT) AS blocks FROM (SELECT DISTINCT z // 16, y // 16, x // 16 FROM ({}))".format(fx.VOX))
def resolve_decode(spark, sf_dir):
    """Missing blocks decoded: each block's mean is near that of its cells."""
    from .codecs import small_blocks

    rows = small_blocks(spark, sf_dir)
    back = codec.decode_blocks(codec.encode_blocks(rows, ["bz", "by", "bx"], 2.0), 2.0)
    got = back.select("bz", "by", "bx", F.aggregate("vox", F.lit(0.0), lambda a, b: a + b).alias("got"))
    real = rows.groupBy("bz", "by", "bx").agg(F.sum("val").alias("real"))
    both = got.join(real, ["bz", "by", "bx"])
    return both.agg((F.max(F.abs(F.col("got") - F.col("real")) / F.col("real")) < 0.05).alias("mean_close"), F.count("*").alias("blocks"))


@query("mirror_attach", f"SELECT slot, CASE WHEN state = 1 THEN 1 ELSE 0 END AS state FROM ({fx.OCC})")
def mirror_attach(spark, sf_dir):
    remote = fx.occ(spark, sf_dir)
    return mirror.attach(remote.select("slot", F.lit(0).alias("state")), remote)


ASKED = "SELECT DISTINCT user_id % 64 AS slot FROM events"
ENSURED = f"SELECT a.slot, CASE WHEN o.state = 1 THEN 'known' WHEN a.slot % 5 <> 0 THEN 'ok' ELSE 'network' END AS status, CASE WHEN o.state = 1 THEN 1 WHEN a.slot % 5 <> 0 THEN 2 ELSE 0 END AS state FROM ({ASKED}) a JOIN ({fx.OCC}) o USING (slot)"


def asked(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select((F.col("user_id") % 64).alias("slot")).distinct()


def remote(spark, sf_dir, ok="slot % 5 <> 0"):
    return fx.occ(spark, sf_dir).withColumn("ok", F.expr(ok))


@query("mirror_ensure", ENSURED)
def mirror_ensure(spark, sf_dir):
    return mirror.ensure(asked(spark, sf_dir), mirror_attach(spark, sf_dir), remote(spark, sf_dir))


@query("mirror_counters", f"SELECT status, count(*) AS n FROM ({ENSURED}) GROUP BY status")
def mirror_counters(spark, sf_dir):
    return mirror.counters(mirror_ensure(spark, sf_dir))


@query("mirror_retry", f"SELECT o.slot, CASE WHEN o.state = 1 THEN 1 WHEN a.slot IS NOT NULL THEN 2 ELSE 0 END AS state FROM ({fx.OCC}) o LEFT JOIN ({ASKED}) a USING (slot)")
def mirror_retry(spark, sf_dir):
    """What fails at first is fetched at the second try."""
    return mirror.with_retry(asked(spark, sf_dir), mirror_attach(spark, sf_dir), [remote(spark, sf_dir), remote(spark, sf_dir, "true")])


@query("stream_requests", f"SELECT key, tick, tick > min(tick) OVER (PARTITION BY key) AS hit, CAST(sum(n) OVER (PARTITION BY key ORDER BY tick) AS BIGINT) AS asked FROM (SELECT key, tick, count(*) AS n FROM ({KEYED}) GROUP BY key, tick)")
def stream_requests(spark, sf_dir):
    """The request loop as a stateful stream over a day's table of requests."""
    at = folder(spark, "requests")
    keyed(spark, sf_dir).select("tick", "key").write.parquet(f"{at}/in")
    return mirror.run_to_end(mirror.request_loop(spark.readStream.schema("tick long, key long").parquet(f"{at}/in")), "seen", at)


@query("stream_mirror", f"SELECT slot, CASE WHEN slot % 5 <> 0 THEN 2 ELSE 0 END AS state FROM ({ASKED})")
def stream_mirror(spark, sf_dir):
    at = folder(spark, "mirror")
    asked(spark, sf_dir).write.parquet(f"{at}/in")
    return mirror.mirror_batches(spark.readStream.schema("slot long").parquet(f"{at}/in"), at, remote(spark, sf_dir))


@query("key_hash")
def key_hash(spark, sf_dir):
    """The avalanche hash of keys; Spark deals rows by its own, so only formats need this one."""

    @F.arrow_udf("long")
    def of(keys: pa.Array) -> pa.Array:
        x = keys.to_numpy(zero_copy_only=False).astype(np.uint64)
        with np.errstate(over="ignore"):
            for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
            x ^= x >> np.uint64(33)
        return pa.array(x.view(np.int64))

    return keyed(spark, sf_dir).select("key").distinct().select("key", of("key").alias("hash"))
