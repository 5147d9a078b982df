"""Queries: sample types, keys, geometry, vectors, quantisation, colour."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import keys, quant, samples, vectors
from lodestrata.functions.keys import Geometry

from . import fixtures as fx

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


#: Coefficients with numbers of every class in between.
ODD = f"SELECT o, n, CASE (o * 7 + n) % 6 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) WHEN 2 THEN CAST('-Infinity' AS DOUBLE) WHEN 3 THEN CAST('1e-310' AS DOUBLE) WHEN 4 THEN CAST(0 AS DOUBLE) ELSE c + 0.5 END AS c FROM ({fx.COEF})"


def odd(spark, sf_dir):
    at = (F.col("o") * 7 + F.col("n")) % 6
    c = F.when(at == 0, float("nan")).when(at == 1, float("inf")).when(at == 2, float("-inf")).when(at == 3, 1e-310).when(at == 4, 0.0).otherwise(F.col("c") + 0.5)
    return fx.coef(spark, sf_dir).select("o", "n", c.alias("c"))


@query("sc_dtypes", "SELECT * FROM (VALUES ('u8',1,false,false),('s8',1,false,true),('u16',2,false,false),('s16',2,false,true),('u32',4,false,false),('s32',4,false,true),('f16',2,true,true),('f32',4,true,true)) t(name, size, is_float, is_signed)")
def sc_dtypes(spark, sf_dir):
    return spark.createDataFrame([(d.name, d.size, d.is_float, d.is_signed) for d in samples.DTYPES.values()], "name string, size int, is_float boolean, is_signed boolean")


@query("sc_classify", f"SELECT o, n, CASE WHEN isnan(c) THEN 'nan' WHEN isinf(c) THEN 'inf' WHEN c = 0 THEN 'zero' WHEN abs(c) < 2.2250738585072014e-308 THEN 'subnormal' ELSE 'normal' END AS kind FROM ({ODD})")
def sc_classify(spark, sf_dir):
    return odd(spark, sf_dir).select("o", "n", samples.classify(F.col("c")).alias("kind"))


@query("sc_classify_f32", f"SELECT o, n, CASE WHEN isnan(c) THEN 'nan' WHEN isinf(c) THEN 'inf' WHEN c = 0 THEN 'zero' WHEN abs(c) < 1.1754943508222875e-38 THEN 'subnormal' ELSE 'normal' END AS kind FROM (SELECT o, n, CAST(CASE WHEN abs(c) = 1e-310 THEN 1e-40 ELSE c END AS FLOAT) AS c FROM ({ODD}))")
def sc_classify_f32(spark, sf_dir):
    c = F.when(F.abs("c") == 1e-310, 1e-40).otherwise(F.col("c")).cast("float")
    return odd(spark, sf_dir).select("o", "n", samples.classify(c, samples.LEAST_NORMAL_32).alias("kind"))


@query("sc_sanitize", f"SELECT o, n, round(CASE WHEN isfinite(c) THEN c ELSE -1 END, 4) AS c FROM ({ODD})")
def sc_sanitize(spark, sf_dir):
    return odd(spark, sf_dir).select("o", "n", F.round(samples.sanitize(F.col("c"), -1.0), 4).alias("c"))


@query("sc_load", f"SELECT o, n, round(CASE WHEN isfinite(c) THEN c ELSE 0 END, 4) AS c FROM ({ODD})")
def sc_load(spark, sf_dir):
    return odd(spark, sf_dir).select("o", "n", F.round(samples.load(F.col("c")), 4).alias("c"))


def _stored(dtype: str, scale: float) -> None:
    d = samples.DTYPES[dtype]
    sql = f"SELECT o, n, CAST(least(greatest(round_even(c * {scale}, 0), {d.low}), {d.high}) AS BIGINT) AS s FROM ({fx.COEF})"
    query(f"sc_store_{dtype}", sql)(lambda spark, sf_dir: fx.coef(spark, sf_dir).select("o", "n", samples.store(F.col("c") * scale, dtype).cast("long").alias("s")))


for _dtype, _scale in (("u8", 10.0), ("s8", 5.0), ("u16", 2000.0), ("s16", 1500.0), ("u32", 1e8), ("s32", 1e8)):
    _stored(_dtype, _scale)


@query("sc_store_float", f"SELECT o, n, round(least(greatest(c * 5000, -65504), 65504), 1) AS s FROM ({fx.COEF})")
def sc_store_float(spark, sf_dir):
    return fx.coef(spark, sf_dir).select("o", "n", F.round(samples.store(F.col("c") * 5000, "f16").cast("double"), 1).alias("s"))


KEYED = f"SELECT tick, consumer, ((CAST(tick % 8 AS BIGINT) & 7) << 48) | ((bz & 65535) << 32) | ((\"by\" & 65535) << 16) | (bx & 65535) AS key FROM ({fx.REQ})"


def keyed(spark, sf_dir):
    r = fx.req(spark, sf_dir)
    return r.select("tick", "consumer", keys.pack(F.col("tick") % 8, F.col("bz"), F.col("by"), F.col("bx")).alias("key"))


@query("key_pack", KEYED)
def key_pack(spark, sf_dir):
    return keyed(spark, sf_dir)


@query("key_unpack", f"SELECT DISTINCT key, CAST(key >> 48 & 7 AS INT) AS lod, CAST(key >> 32 & 65535 AS INT) AS bz, CAST(key >> 16 & 65535 AS INT) AS \"by\", CAST(key & 65535 AS INT) AS bx FROM ({KEYED})")
def key_unpack(spark, sf_dir):
    return keyed(spark, sf_dir).select("key").distinct().select("key", *[c.alias(n) for n, c in keys.unpack(F.col("key")).items()])


@query("key_order", f"SELECT consumer, min(key) AS first_key, max(key) AS last_key FROM ({KEYED}) GROUP BY consumer")
def key_order(spark, sf_dir):
    return keyed(spark, sf_dir).groupBy("consumer").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"))


@query("key_block_address", "SELECT CAST(k >> 48 & 7 AS INT) AS lod, CAST((k >> 32 & 65535) // 16 AS INT) AS cz, CAST((k >> 16 & 65535) // 16 AS INT) AS cy, CAST((k & 65535) // 16 AS INT) AS cx, CAST(((k >> 32 & 65535) % 16 * 16 + (k >> 16 & 65535) % 16) * 16 + (k & 65535) % 16 AS INT) AS inner_at, k AS key FROM (SELECT DISTINCT (o_orderkey % 5 << 48) | (o_custkey % 1000 << 32) | (o_orderkey % 300 << 16) | (o_orderkey % 70) AS k FROM orders)")
def key_block_address(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    key = keys.pack(o % 5, c % 1000, o % 300, o % 70)
    rows = fx.table(spark, sf_dir, "orders").select(key.alias("key")).distinct()
    a = keys.address(F.col("key"))
    return rows.select("key", *[v.alias("inner_at" if n == "inner" else n) for n, v in a.items()])


@query("voxel_address", f"SELECT z, y, x, z // 16 AS bz, y // 16 AS \"by\", x // 16 AS bx, CAST((z % 16 * 16 + y % 16) * 16 + x % 16 AS INT) AS lin FROM ({fx.VOX})")
def voxel_address(spark, sf_dir):
    a = keys.voxel_address(F.col("z"), F.col("y"), F.col("x"))
    return fx.vox(spark, sf_dir).select("z", "y", "x", *[v.alias(n) for n, v in a.items()])


@query("linear_index", f"SELECT z, y, x, CAST((z * 64 + y) * 64 + x AS BIGINT) AS at, CAST(z * 5000 + y * 70 + x AS BIGINT) AS strided FROM ({fx.VOX})")
def linear_index(spark, sf_dir):
    at = [F.col(c) for c in "zyx"]
    return fx.vox(spark, sf_dir).select("z", "y", "x", keys.linear(at, [64, 64, 64]).alias("at"), keys.strided(at, [5000, 70, 1]).alias("strided"))


@query("ceil_align", "SELECT p_partkey, CAST((p_partkey + 255) // 256 AS BIGINT) AS chunks, CAST((p_partkey + 4095) // 4096 * 4096 AS BIGINT) AS aligned FROM part")
def ceil_align(spark, sf_dir):
    p = F.col("p_partkey")
    return fx.table(spark, sf_dir, "part").select("p_partkey", keys.ceil_div(p, 256).alias("chunks"), keys.align_up(p, 4096).alias("aligned"))


LEVELS = """WITH l AS (SELECT CAST(i AS INT) AS lod, CAST(ceil(1024 / pow(2, i)) AS INT) AS dz, CAST(ceil(515 / pow(2, i)) AS INT) AS dy, CAST(ceil(300 / pow(2, i)) AS INT) AS dx FROM range(4) r(i)),
c AS (SELECT *, CAST((dz + 255) // 256 AS INT) AS ncz, CAST((dy + 255) // 256 AS INT) AS ncy, CAST((dx + 255) // 256 AS INT) AS ncx FROM l),
g AS (SELECT *, CAST(ncz AS BIGINT) * ncy * ncx AS chunks FROM c)
SELECT *, CAST(coalesce(sum(chunks) OVER (ORDER BY lod DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM g"""
GEOMETRY = Geometry(1024, 515, 300, 4)


@query("geometry_levels", LEVELS)
def geometry_levels(spark, sf_dir):
    return GEOMETRY.levels(spark)


CHUNKS = "SELECT DISTINCT CAST(l_orderkey % 4 AS INT) AS lod, CAST(l_partkey % 5 AS INT) AS cz, CAST(l_suppkey % 4 AS INT) AS cy, CAST(l_linenumber % 3 AS INT) AS cx FROM lineitem"


@query("geometry_slots", f"SELECT q.lod, q.cz, q.cy, q.cx, CAST(base + (q.cz * ncy + q.cy) * ncx + q.cx AS BIGINT) AS slot FROM ({CHUNKS}) q JOIN ({LEVELS}) g ON q.lod = g.lod WHERE q.cz < ncz AND q.cy < ncy AND q.cx < ncx")
def geometry_slots(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 4).cast("int").alias("lod"), (F.col("l_partkey") % 5).cast("int").alias("cz"), (F.col("l_suppkey") % 4).cast("int").alias("cy"), (F.col("l_linenumber") % 3).cast("int").alias("cx")).distinct()
    return GEOMETRY.slots(rows)


PAIR = f"SELECT a.id, a.z, a.y, a.x, b.z AS bz, b.y AS \"by\", b.x AS bx FROM ({fx.VEC3}) a JOIN ({fx.VEC3}) b ON b.id = a.id + 1"


def pairs(spark, sf_dir):
    v = fx.vec3(spark, sf_dir)
    return v.join(v.select((F.col("id") - 1).alias("id"), *[F.col(c).alias(f"b{c}") for c in "zyx"]), "id")


@query("vec_arithmetic", f"SELECT id, round(z + bz, 6) AS add_z, round(y + \"by\", 6) AS add_y, round(x + bx, 6) AS add_x, round(z - bz, 6) AS sub_z, round(2.5 * y, 6) AS scaled_y, z = bz AND y = \"by\" AND x = bx AS same FROM ({PAIR})")
def vec_arithmetic(spark, sf_dir):
    a, b = vectors.vec(), vectors.vec("b")
    s, d = vectors.add(a, b), vectors.sub(a, b)
    return pairs(spark, sf_dir).select("id", *[F.round(c, 6).alias(f"add_{n}") for c, n in zip(s, "zyx", strict=True)], F.round(d[0], 6).alias("sub_z"), F.round(vectors.scale(a, 2.5)[1], 6).alias("scaled_y"), vectors.equal(a, b).alias("same"))


@query("vec_dot_cross", f"SELECT id, round(z * bz + y * \"by\" + x * bx, 6) AS dot, round(y * bx - x * \"by\", 6) + 0.0 AS cz, round(x * bz - z * bx, 6) + 0.0 AS cy, round(z * \"by\" - y * bz, 6) + 0.0 AS cx FROM ({PAIR})")
def vec_dot_cross(spark, sf_dir):
    a, b = vectors.vec(), vectors.vec("b")
    return pairs(spark, sf_dir).select("id", F.round(vectors.dot(a, b), 6).alias("dot"), *[(F.round(c, 6) + 0.0).alias(f"c{n}") for c, n in zip(vectors.cross(a, b), "zyx", strict=True)])


@query("vec_normalize", f"SELECT id, round(sqrt(z*z + y*y + x*x), 6) AS len, round(CASE WHEN z*z + y*y + x*x > 0 THEN z / sqrt(z*z + y*y + x*x) ELSE 0 END, 6) AS nz, round(CASE WHEN z*z + y*y + x*x > 0 THEN x / sqrt(z*z + y*y + x*x) ELSE 0 END, 6) AS nx FROM (SELECT id, CASE WHEN id % 9 = 0 THEN 0 ELSE z END AS z, CASE WHEN id % 9 = 0 THEN 0 ELSE y END AS y, CASE WHEN id % 9 = 0 THEN 0 ELSE x END AS x FROM ({fx.VEC3}))")
def vec_normalize(spark, sf_dir):
    zero = lambda c: F.when(F.col("id") % 9 == 0, 0.0).otherwise(F.col(c)).alias(c)
    rows = fx.vec3(spark, sf_dir).select("id", *map(zero, "zyx"))
    n = vectors.normalize(vectors.vec())
    return rows.select("id", F.round(vectors.length(vectors.vec()), 6).alias("len"), F.round(n[0], 6).alias("nz"), F.round(n[2], 6).alias("nx"))


@query("ycocg_forward", f"SELECT p_partkey, (b + (r - b) / 2) + (g - (b + (r - b) / 2)) / 2 AS luma, CAST(r - b AS DOUBLE) AS co, g - (b + (r - b) / 2) AS cg FROM ({fx.RGB})")
def ycocg_forward(spark, sf_dir):
    y, co, cg = quant.ycocg(*[F.col(c).cast("double") for c in "rgb"])
    return fx.rgb(spark, sf_dir).select("p_partkey", y.alias("luma"), co.alias("co"), cg.alias("cg"))


@query("ycocg_inverse", f"SELECT p_partkey, r, g, b FROM ({fx.RGB})")
def ycocg_inverse(spark, sf_dir):
    back = quant.rgb(*[F.col(c) for c in ("luma", "co", "cg")])
    return ycocg_forward(spark, sf_dir).select("p_partkey", *[F.rint(c).cast("int").alias(n) for c, n in zip(back, "rgb", strict=True)])


@query("band_weight", "SELECT CAST(i AS INT) AS band, round(1 + 3.0 * pow(i / 126.0, 0.65), 9) AS weight FROM range(127) r(i)")
def band_weight(spark, sf_dir):
    return spark.range(127).select(F.col("id").cast("int").alias("band"), F.round(quant.band_weight(F.col("id") / 126.0), 9).alias("weight"))


STEP = "(CASE WHEN n % 7 = 0 THEN 0.0 ELSE 0.5 * n END)"
INDEX = f"SELECT o, n, c, {STEP} AS step, CASE WHEN {STEP} <= 0 OR abs(c) / {STEP} < 0.8 THEN 0 ELSE CAST(sign(c) * floor(abs(c) / {STEP} - 0.8 + 1) AS INT) END AS idx FROM ({fx.COEF})"


def indexed(spark, sf_dir):
    step = F.when(F.col("n") % 7 == 0, 0.0).otherwise(F.col("n") * 0.5)
    return fx.coef(spark, sf_dir).withColumn("step", step).withColumn("idx", quant.quantize(F.col("c"), F.col("step")))


@query("quantize", f"SELECT o, n, idx FROM ({INDEX})")
def quantize(spark, sf_dir):
    return indexed(spark, sf_dir).select("o", "n", "idx")


@query("dequantize", f"SELECT o, n, CAST(round(CASE WHEN idx = 0 THEN 0.0 ELSE sign(idx) * (abs(idx) - 1 + 1.2) * step END, 6) AS DOUBLE) AS c FROM ({INDEX})")
def dequantize(spark, sf_dir):
    return indexed(spark, sf_dir).select("o", "n", F.round(quant.dequantize(F.col("idx"), F.col("step")), 6).alias("c"))


@query("quantize_error", f"SELECT CAST(n AS INT) AS n, true AS within FROM ({fx.COEF}) WHERE n % 7 <> 0 GROUP BY n")
def quantize_error(spark, sf_dir):
    rows = indexed(spark, sf_dir).where("step > 0")
    gap = F.abs(F.col("c") - quant.dequantize(F.col("idx"), F.col("step"))) / F.col("step")
    return rows.groupBy(F.col("n").cast("int").alias("n")).agg((F.max(gap) <= quant.DEAD_ZONE + 1e-9).alias("within"))
