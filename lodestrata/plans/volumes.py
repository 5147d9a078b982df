"""Queries: masks, pyramid, sampling, surfaces, rendering, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import samples
from lodestrata.operators import cells, metrics, render, sampling, surfaces

from . import fixtures as fx
from . import rewrites

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@query("mask_build", f"SELECT z, y, x, v <> 0 AS mask FROM (SELECT z, y, x, CASE WHEN v > 100 THEN v ELSE 0 END AS v FROM ({fx.VOX}))")
def mask_build(spark, sf_dir):
    thin = fx.vox(spark, sf_dir).withColumn("v", F.when(F.col("v") > 100, F.col("v")).otherwise(0))
    return cells.mask(thin).select("z", "y", "x", "mask")


@query("air_mask", f"SELECT z, y, x, v FROM ({fx.VOX}) WHERE v > 50")
def air_mask(spark, sf_dir):
    return cells.air_mask(fx.vox(spark, sf_dir), 50)


def _coarser(sql: str) -> str:
    return f"SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, CAST(sum(v) // count(*) AS INT) AS v FROM ({sql}) WHERE v <> 0 GROUP BY 1, 2, 3"


LODS = [fx.VOX]
for _ in range(3):
    LODS.append(_coarser(LODS[-1]))


def _level(lod: int) -> None:
    query(f"pyramid_lod{lod}", LODS[lod])(lambda spark, sf_dir: cells.pyramid(fx.vox(spark, sf_dir), lod + 1).where(F.col("lod") == lod).drop("lod"))


for _lod in (1, 2, 3):
    _level(_lod)

MASKED = fx.MASKED


@query("ingest", f"SELECT 0 AS lod, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM ({MASKED}) UNION ALL SELECT 1, count(*), CAST(sum(v) AS BIGINT) FROM ({_coarser(MASKED)}) UNION ALL SELECT 2, count(*), CAST(sum(v) AS BIGINT) FROM ({_coarser(_coarser(MASKED))})")
def ingest(spark, sf_dir):
    out = cells.ingest(fx.vox(spark, sf_dir), 50, 3)
    return out.groupBy("lod").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


POINTS = "SELECT l_orderkey * 10 + l_linenumber AS id, (l_partkey % 640) / 10.0 AS z, (l_suppkey % 630) / 10.0 - 0.5 AS y, l_quantity * 1.25 AS x FROM lineitem"


def points(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), ((F.col("l_partkey") % 640) / 10.0).alias("z"), ((F.col("l_suppkey") % 630) / 10.0 - 0.5).alias("y"), (F.col("l_quantity") * 1.25).alias("x"))


@query("sample_voxel", f"SELECT p.id, coalesce(q.v, 0) AS v FROM (SELECT id, CAST(floor(z) AS INT) AS z, CAST(floor(y) AS INT) AS y, CAST(floor(x) AS INT) AS x FROM ({POINTS})) p LEFT JOIN ({fx.VOX}) q USING (z, y, x)")
def sample_voxel(spark, sf_dir):
    at = points(spark, sf_dir).select("id", *[F.floor(c).cast("int").alias(c) for c in "zyx"])
    return sampling.voxel(at, fx.vox(spark, sf_dir)).select("id", "v")


@query("sample_nearest", f"SELECT p.id, coalesce(q.v, 0) AS val FROM (SELECT id, CAST(round(z) AS INT) AS z, CAST(round(y) AS INT) AS y, CAST(round(x) AS INT) AS x FROM ({POINTS})) p LEFT JOIN ({fx.VOX}) q USING (z, y, x)")
def sample_nearest(spark, sf_dir):
    return sampling.nearest(points(spark, sf_dir), fx.vox(spark, sf_dir))


def trilinear_sql(points_sql: str, keep: str, cells_sql: str = fx.VOX) -> str:
    """SQL of the trilinear value of points (keep, z, y, x)."""
    return f"""SELECT {keep}, coalesce(sum(w * qv), 0) AS val FROM (
      SELECT {keep}, CAST(floor(z) AS INT) + dz AS cz, CAST(floor(y) AS INT) + dy AS cy, CAST(floor(x) AS INT) + dx AS cx,
        (CASE dz WHEN 1 THEN z - floor(z) ELSE 1 - (z - floor(z)) END) * (CASE dy WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE dx WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w
      FROM ({points_sql}) p, (SELECT CAST(a AS INT) AS dz FROM range(2) r(a)) da, (SELECT CAST(b AS INT) AS dy FROM range(2) r(b)) db, (SELECT CAST(c AS INT) AS dx FROM range(2) r(c)) dc
    ) k LEFT JOIN (SELECT z AS qz, y AS qy, x AS qx, v AS qv FROM ({cells_sql})) q ON qz = cz AND qy = cy AND qx = cx GROUP BY {keep}"""


@query("sample_trilinear", f"SELECT id, round(val, 4) AS val FROM ({trilinear_sql(POINTS, 'id')})")
def sample_trilinear(spark, sf_dir):
    out = sampling.trilinear(points(spark, sf_dir), fx.vox(spark, sf_dir))
    return out.select("id", F.round("val", 4).alias("val"))


def plane(spark):
    return surfaces.plane(spark, (32, 8, 8), (0, 0, 1), (0, 1, 0), (1, 0, 0), 16, 16)


def quad(spark):
    at = surfaces.grid(spark, 32, 32)
    return at.select("v", "u", (20 + 0.5 * F.col("u") + 0.25 * F.col("v")).alias("z"), (8 + F.col("v")).cast("double").alias("y"), (8 + F.col("u")).cast("double").alias("x"))


STACK = "SELECT layer, v, u, z + (-1 + 0.5 * layer) AS z, y, x FROM ({}) s, (SELECT CAST(i AS INT) AS layer FROM range(5) r(i)) l".format(fx.PLANE)


@query("quad_stack", f"SELECT layer, v, u, round(val, 4) AS val FROM ({trilinear_sql(STACK, 'layer, v, u')})")
def quad_stack(spark, sf_dir):
    return sampling.quad_stack(plane(spark), fx.vox(spark, sf_dir), -1.0, 0.5, 5).select("layer", "v", "u", F.round("val", 4).alias("val"))


@query("march_steps", "SELECT CAST(a AS VARCHAR) AS march, n FROM (VALUES ('0,1,0.1', 10), ('0,2,0.2', 10), ('-2,2,0.1', 40), ('-1,1,0.5', 5)) t(a, n)")
def march_steps(spark, sf_dir):
    rows = [(f"{a},{b},{c}", len(render.steps(a, b, c))) for a, b, c in ((0, 1, 0.1), (0, 2, 0.2), (-2, 2, 0.1), (-1, 1, 0.5))]
    return spark.createDataFrame(rows, "march string, n int")


MARCH = f"SELECT v, u, t, z + t AS z, y, x FROM ({fx.PLANE}) s, (SELECT i * 0.5 - 1 AS t FROM range(5) r(i)) l"
MARCHED = trilinear_sql(MARCH, "v, u, t")
REDUCED = {"max": "greatest(0, max(val))", "min": "coalesce(min(val), 0)", "mean": "coalesce(avg(val), 0)"}


def _render(kind: str, sql: str) -> None:
    query(f"render_{kind}", sql)(lambda spark, sf_dir: render.render(plane(spark), fx.vox(spark, sf_dir), -1, 1, 0.5, kind).select("v", "u", F.round("px", 4).alias("px")))


for _kind, _sql in REDUCED.items():
    _render(_kind, f"SELECT v, u, round({_sql}, 4) AS px FROM ({MARCHED}) GROUP BY v, u")
_render("alpha", f"SELECT v, u, round(sum(exp(before) * least(val / 255, 1) * val), 4) AS px FROM (SELECT *, coalesce(sum(ln(1 - least(val / 255, 1))) OVER (PARTITION BY v, u ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({MARCHED})) GROUP BY v, u")


@query("render_band", f"SELECT v, u, round(greatest(0, max(val)), 4) AS px FROM ({MARCHED}) WHERE v >= 4 AND v < 9 GROUP BY v, u")
def render_band(spark, sf_dir):
    return render.render(plane(spark), fx.vox(spark, sf_dir), -1, 1, 0.5, "max", (4, 9)).select("v", "u", F.round("px", 4).alias("px"))


@query("render_blocks", f"SELECT DISTINCT (z + dz) // 16 AS bz, (y // 16) AS \"by\", (x // 16) AS bx FROM (SELECT DISTINCT CAST(floor(z + i * 0.5 - 1) AS INT) AS z, CAST(y AS INT) AS y, CAST(x AS INT) AS x, z + i * 0.5 - 1 - floor(z + i * 0.5 - 1) AS rest FROM ({fx.PLANE}) s, range(5) r(i)), (SELECT CAST(j AS INT) AS dz FROM range(2) q(j)) d WHERE dz = 0 OR rest > 0")
def render_blocks(spark, sf_dir):
    return rewrites.surface_blocks(plane(spark), render.steps(-1, 1, 0.5))


@query("plane_grid", f"SELECT v, u, z, y, x, CAST(1 AS DOUBLE) AS nz, CAST(0 AS DOUBLE) AS ny, CAST(0 AS DOUBLE) AS nx FROM ({fx.PLANE})")
def plane_grid(spark, sf_dir):
    return plane(spark)


BASIS = f"""WITH p AS (SELECT id, z / l AS nz, y / l AS ny, x / l AS nx FROM (SELECT *, sqrt(z*z + y*y + x*x) AS l FROM ({fx.VEC3}))),
c AS (SELECT id, nz, ny, nx, 1 * nx - 0 * ny AS cz, 0 * nz - 0 * nx AS cy, 0 * ny - 1 * nz AS cx FROM p),
b AS (SELECT *, cz / sqrt(cz*cz + cy*cy + cx*cx) AS buz, cy / sqrt(cz*cz + cy*cy + cx*cx) AS buy, cx / sqrt(cz*cz + cy*cy + cx*cx) AS bux FROM c)
SELECT id, round(buz, 6) + 0.0 AS buz, round(buy, 6) + 0.0 AS buy, round(bux, 6) + 0.0 AS bux, round(ny * bux - nx * buy, 6) + 0.0 AS bvz, round(nx * buz - nz * bux, 6) + 0.0 AS bvy FROM b"""


@query("plane_basis", BASIS)
def plane_basis(spark, sf_dir):
    from lodestrata.functions import vectors

    n = vectors.normalize(vectors.vec())
    rows = fx.vec3(spark, sf_dir).select("id", *[c.alias(f"n{a}") for c, a in zip(n, "zyx", strict=True)], F.lit(0.0).alias("uz"), F.lit(1.0).alias("uy"), F.lit(0.0).alias("ux"))
    return surfaces.plane_basis(rows).select("id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("buz", "buy", "bux", "bvz", "bvy")])


@query("quad_coord", f"SELECT id, round(sum(w * q.z), 6) AS z, round(sum(w * q.y), 6) AS y, round(sum(w * q.x), 6) AS x FROM (SELECT id, least(CAST(floor(pv) AS INT) + dv, 31) AS v, least(CAST(floor(pu) AS INT) + du, 31) AS u, (CASE dv WHEN 1 THEN pv - floor(pv) ELSE 1 - (pv - floor(pv)) END) * (CASE du WHEN 1 THEN pu - floor(pu) ELSE 1 - (pu - floor(pu)) END) AS w FROM (SELECT p_partkey AS id, least(p_partkey % 330 / 10.0, 31) AS pv, least(p_size * 0.7, 31) AS pu FROM part) p, (SELECT CAST(a AS INT) AS dv FROM range(2) r(a)) da, (SELECT CAST(b AS INT) AS du FROM range(2) r(b)) db) k JOIN ({fx.QUAD}) q ON q.v = k.v AND q.u = k.u GROUP BY id")
def quad_coord(spark, sf_dir):
    at = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 330 / 10.0).alias("pv"), (F.col("p_size") * 0.7).alias("pu"))
    return surfaces.quad_sample(quad(spark), at).select("id", *[F.round(c, 6).alias(c) for c in "zyx"])


@query("quad_normal", f"""WITH s AS (SELECT v, u, coalesce(lead(z) OVER a - z, 0) AS uz, coalesce(lead(y) OVER a - y, 0) AS uy, coalesce(lead(x) OVER a - x, 0) AS ux, coalesce(lead(z) OVER b - z, 0) AS vz, coalesce(lead(y) OVER b - y, 0) AS vy, coalesce(lead(x) OVER b - x, 0) AS vx FROM ({fx.QUAD}) WINDOW a AS (PARTITION BY v ORDER BY u), b AS (PARTITION BY u ORDER BY v)),
c AS (SELECT v, u, uy * vx - ux * vy AS cz, ux * vz - uz * vx AS cy, uz * vy - uy * vz AS cx FROM s), l AS (SELECT *, sqrt(cz*cz + cy*cy + cx*cx) AS len FROM c)
SELECT v, u, round(CASE WHEN len > 0 THEN cz / len ELSE 0 END, 6) + 0.0 AS nz, round(CASE WHEN len > 0 THEN cy / len ELSE 0 END, 6) + 0.0 AS ny, round(CASE WHEN len > 0 THEN cx / len ELSE 0 END, 6) + 0.0 AS nx FROM l""")
def quad_normal(spark, sf_dir):
    return surfaces.quad_normals(quad(spark)).select("v", "u", *[(F.round(f"n{c}", 6) + 0.0).alias(f"n{c}") for c in "zyx"])


@query("surface_extent", f"SELECT CAST(max(v) + 1 AS INT) AS gh, CAST(max(u) + 1 AS INT) AS gw, count(*) AS points FROM ({fx.QUAD})")
def surface_extent(spark, sf_dir):
    return surfaces.extent(quad(spark))


AB = f"SELECT z // 16 AS bz, y // 16 AS \"by\", x // 16 AS bx, v AS a, least(255, round_even(v / 8.0, 0) * 8) AS b FROM ({fx.VOX})"


def ab(spark, sf_dir):
    from lodestrata.functions.keys import div

    b = F.least(F.lit(255.0), F.rint(F.col("v") / 8.0) * 8)
    return fx.vox(spark, sf_dir).select(*[div(F.col(c), 16).alias(f"b{c}") for c in "zyx"], F.col("v").alias("a"), b.alias("b"))


@query("metric_errors", f"SELECT round(avg(abs(a - b)), 6) AS mae, round(max(abs(a - b)), 6) AS max_abs, round(10 * log10(65025 / avg((a - b) * (a - b))), 4) AS psnr FROM ({AB})")
def metric_errors(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return ab(spark, sf_dir).agg(F.round(metrics.mae(a, b), 6).alias("mae"), F.round(metrics.max_abs_error(a, b), 6).alias("max_abs"), F.round(metrics.psnr(a, b), 4).alias("psnr"))


@query("metric_psnr_same", f"SELECT bz, CASE WHEN avg((a - b) * (a - b)) = 0 THEN 1e9 ELSE round(10 * log10(65025 / avg((a - b) * (a - b))), 4) END AS psnr FROM (SELECT bz, a, CASE WHEN bz = 2 THEN a ELSE b END AS b FROM ({AB})) GROUP BY bz")
def metric_psnr_same(spark, sf_dir):
    b = F.when(F.col("bz") == 2, F.col("a")).otherwise(F.col("b"))
    return ab(spark, sf_dir).withColumn("b", b).groupBy("bz").agg(F.round(metrics.psnr(F.col("a"), F.col("b")), 4).alias("psnr"))


@query("metric_ssim", f"SELECT round(avg((2 * ma * mb + 6.5025) * (2 * cov + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))), 6) AS ssim FROM (SELECT avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS cov FROM ({AB}) GROUP BY bz, \"by\", bx)")
def metric_ssim(spark, sf_dir):
    return metrics.ssim(ab(spark, sf_dir), ["bz", "by", "bx"]).select(F.round("ssim", 6).alias("ssim"))


@query("metric_percentile", f"SELECT bz, e AS err FROM (SELECT bz, abs(a - b) AS e, row_number() OVER (PARTITION BY bz ORDER BY abs(a - b)) - 1 AS i, count(*) OVER (PARTITION BY bz) AS n FROM ({AB})) WHERE i = CAST(floor(0.95 * (n - 1)) AS BIGINT)")
def metric_percentile(spark, sf_dir):
    return metrics.percentile(ab(spark, sf_dir).select("bz", F.abs(F.col("a") - F.col("b")).alias("err")), "err", 0.95, ["bz"])


DENSE = f"SELECT CAST(i // 4096 AS INT) AS z, CAST(i // 64 % 64 AS INT) AS y, CAST(i % 64 AS INT) AS x FROM range(262144) r(i)"


@query("metric_air_fraction", f"SELECT g.z // 16 AS bz, round(avg(CASE WHEN coalesce(q.v, 0) = 0 THEN 1.0 ELSE 0.0 END), 6) AS air FROM ({DENSE}) g LEFT JOIN ({fx.VOX}) q USING (z, y, x) GROUP BY 1")
def metric_air_fraction(spark, sf_dir):
    from lodestrata.functions.keys import div

    dense = cells.dense_box(fx.vox(spark, sf_dir), (0, 0, 0), (64, 64, 64))
    return dense.groupBy(div(F.col("z"), 16).alias("bz")).agg(F.round(metrics.air_fraction(F.col("v")), 6).alias("air"))


@query("metric_ratio", "SELECT source, round(CAST(sum(strlen(text)) AS DOUBLE) / sum(n_chars), 6) AS ratio FROM documents GROUP BY source")
def metric_ratio(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").groupBy("source").agg(F.round(F.sum(F.octet_length("text")) / F.sum("n_chars"), 6).alias("ratio"))


@query("metric_gates", f"SELECT bz, avg(abs(a - b)) <= 2.5 AS mae_ok, max(abs(a - b)) <= 4 AS max_ok FROM ({AB}) GROUP BY bz")
def metric_gates(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return ab(spark, sf_dir).groupBy("bz").agg(metrics.gate(metrics.mae(a, b), high=2.5).alias("mae_ok"), metrics.gate(metrics.max_abs_error(a, b), high=4).alias("max_ok"))


@query("air_fill_seed", f"SELECT z // 16 AS bz, y // 16 AS \"by\", x // 16 AS bx, round(avg(v), 6) AS seed FROM ({fx.VOX}) GROUP BY 1, 2, 3")
def air_fill_seed(spark, sf_dir):
    from lodestrata.functions.keys import div

    return fx.vox(spark, sf_dir).groupBy(*[div(F.col(c), 16).alias(f"b{c}") for c in "zyx"]).agg(F.round(F.avg("v"), 6).alias("seed"))


@query("stored_volume", f"SELECT z, y, x, CAST(least(greatest(round_even(v * 1.02 + 0.5, 0), 0), 255) AS BIGINT) AS s FROM ({fx.VOX})")
def stored_volume(spark, sf_dir):
    return fx.vox(spark, sf_dir).select("z", "y", "x", samples.store(F.col("v") * 1.02 + 0.5, "u8").cast("long").alias("s"))
