"""Queries: cosine transform, quantised coefficients, scans, corrections, priors and rate search."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import metrics, training, transform

from . import fixtures as fx

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def basis_sql(n: int) -> str:
    return f"SELECT CAST(a // {n} AS INT) AS k, CAST(a % {n} AS INT) AS i, CASE WHEN a // {n} = 0 THEN sqrt(1.0 / {n}) ELSE sqrt(2.0 / {n}) END * cos(pi() * (2 * (a % {n}) + 1) * (a // {n}) / (2.0 * {n})) AS c FROM range({n * n}) r(a)"


def forward_sql(source: str, block: list[str], axes: list[str], n: int, inverse: bool = False) -> str:
    here, there = ("k", "i") if inverse else ("i", "k")
    out = source
    for axis in axes:
        keep = ", ".join([f"s.{c}" for c in block + [a for a in axes if a != axis]])
        out = f"SELECT {keep}, m.{there} AS {axis}, sum(m.c * s.val) AS val FROM ({out}) s JOIN ({basis_sql(n)}) m ON s.{axis} = m.{here} GROUP BY {keep}, m.{there}"
    return out


@query("dct_basis", f"SELECT k, i, round(c, 9) + 0.0 AS c FROM ({basis_sql(16)})")
def dct_basis(spark, sf_dir):
    return transform.basis(spark, 16).select("k", "i", (F.round("c", 9) + 0.0).alias("c"))


FWD2 = forward_sql(fx.TILE, ["tile"], ["v", "u"], 64)


@query("dct2_forward", f"SELECT tile, v, u, round(val, 4) + 0.0 AS val FROM ({FWD2})")
def dct2_forward(spark, sf_dir):
    return transform.forward(fx.tile(spark, sf_dir), ["tile"], ["v", "u"], 64).select("tile", "v", "u", (F.round("val", 4) + 0.0).alias("val"))


@query("dct2_roundtrip", f"SELECT tile, v, u, round(val, 4) + 0.0 AS val FROM ({fx.TILE})")
def dct2_roundtrip(spark, sf_dir):
    """Every tile there and back; places that the last tile lacks are left out."""
    back = transform.there_and_back(fx.tile(spark, sf_dir), ["tile"], ["v", "u"], 64)
    return back.select("tile", "v", "u", (F.round("val", 4) + 0.0).alias("val"))


BLOCKS3 = f"SELECT CAST(z // 16 AS INT) AS bz, CAST(y // 16 AS INT) AS b_y, CAST(x // 16 AS INT) AS bx, z % 16 AS z, y % 16 AS y, x % 16 AS x, CAST(v AS DOUBLE) AS val FROM ({fx.VOX})"


def blocks3(spark, sf_dir):
    from lodestrata.functions.keys import div

    rows = fx.vox(spark, sf_dir)
    return rows.select(div(F.col("z"), 16).alias("bz"), div(F.col("y"), 16).alias("b_y"), div(F.col("x"), 16).alias("bx"), *[(F.col(c) % 16).alias(c) for c in "zyx"], F.col("v").cast("double").alias("val"))


FWD3 = forward_sql(BLOCKS3, ["bz", "b_y", "bx"], ["z", "y", "x"], 16)


@query("dct3_forward", f"SELECT bz, b_y, bx, z, y, x, round(val + 1e-6, 4) + 0.0 AS val FROM ({FWD3})")
def dct3_forward(spark, sf_dir):
    out = transform.forward(blocks3(spark, sf_dir), ["bz", "b_y", "bx"], ["z", "y", "x"], 16)
    return out.withColumn("val", F.round(F.col("val") + 1e-6, 4) + 0.0)  # many values are sixteenths: off the ties of rounding


@query("dct3_roundtrip", f"SELECT bz, b_y, bx, z, y, x, round(val, 3) + 0.0 AS val FROM ({BLOCKS3})")
def dct3_roundtrip(spark, sf_dir):
    axes, block = ["z", "y", "x"], ["bz", "b_y", "bx"]
    back = transform.inverse(transform.forward(blocks3(spark, sf_dir), block, axes, 16), block, axes, 16)
    return back.withColumn("val", F.round("val", 3) + 0.0).where("val <> 0")


STEP2 = "1 + 3.0 * pow((v + u) / 126.0, 0.65)"
IDX2 = f"SELECT tile, v, u, v + u AS band, CASE WHEN abs(val) / ({STEP2}) < 0.8 THEN 0 ELSE CAST(sign(val) * floor(abs(val) / ({STEP2}) - 0.8 + 1) AS INT) END AS idx FROM ({FWD2})"


def idx2(spark, sf_dir):
    f = transform.forward(fx.tile(spark, sf_dir), ["tile"], ["v", "u"], 64)
    return transform.quantized(f, ["v", "u"], 64, 1.0).select("tile", "v", "u", "band", "idx")


@query("dct2_quantized", IDX2)
def dct2_quantized(spark, sf_dir):
    return idx2(spark, sf_dir)


@query("energy_compaction", f"SELECT tile, round(sum(CASE WHEN v < 8 AND u < 8 THEN val * val ELSE 0 END) / sum(val * val), 6) AS low, round(sum(val * val), 2) AS total FROM ({FWD2}) GROUP BY tile")
def energy_compaction(spark, sf_dir):
    f = transform.forward(fx.tile(spark, sf_dir), ["tile"], ["v", "u"], 64)
    e = F.col("val") * F.col("val")
    return f.groupBy("tile").agg(F.round(F.sum(F.when((F.col("v") < 8) & (F.col("u") < 8), e).otherwise(0.0)) / F.sum(e), 6).alias("low"), F.round(F.sum(e), 2).alias("total"))


@query("parseval", f"SELECT tile, round(sum(val * val), 2) AS total FROM ({fx.TILE}) GROUP BY tile")
def parseval(spark, sf_dir):
    f = transform.forward(fx.tile(spark, sf_dir), ["tile"], ["v", "u"], 64)
    return f.groupBy("tile").agg(F.round(F.sum(F.col("val") * F.col("val")), 2).alias("total"))


@query("zero_fraction", f"SELECT tile, round(avg(CASE WHEN idx = 0 THEN 1.0 ELSE 0.0 END), 6) AS zeros FROM ({IDX2}) GROUP BY tile")
def zero_fraction(spark, sf_dir):
    return idx2(spark, sf_dir).groupBy("tile").agg(F.round(F.avg(F.when(F.col("idx") == 0, 1.0).otherwise(0.0)), 6).alias("zeros"))


@query("step_table", "SELECT CAST(i AS INT) AS band, round(2.0 * (1 + 3.0 * pow(i / 45.0, 0.65)), 9) AS step, CAST(i * 8 // 46 AS INT) AS bucket FROM range(46) r(i)")
def step_table(spark, sf_dir):
    return transform.steps(spark, 2.0, 16, 3).select("band", F.round("step", 9).alias("step"), "bucket")


SCAN2 = "SELECT CAST(i AS INT) AS lin, CAST(i // 64 + i % 64 AS INT) AS band, CAST(row_number() OVER (ORDER BY i // 64 + i % 64, i) - 1 AS INT) AS scan FROM range(4096) r(i)"
SCAN3 = "SELECT CAST(i AS INT) AS lin, CAST(i // 256 + i // 16 % 16 + i % 16 AS INT) AS band, CAST(row_number() OVER (ORDER BY i // 256 + i // 16 % 16 + i % 16, i) - 1 AS INT) AS scan FROM range(4096) r(i)"


@query("scan_order_2d", SCAN2)
def scan_order_2d(spark, sf_dir):
    return transform.scan(spark, 64, 2)


@query("scan_order_3d", SCAN3)
def scan_order_3d(spark, sf_dir):
    return transform.scan(spark, 16, 3)


@query("band_histogram", f"SELECT band, count(*) AS n, CAST(band * 8 // 46 AS INT) AS bucket FROM ({SCAN3}) GROUP BY band")
def band_histogram(spark, sf_dir):
    return transform.scan(spark, 16, 3).groupBy("band").agg(F.count("*").alias("n")).withColumn("bucket", transform.bucket(F.col("band"), 45))


SCANNED = f"SELECT q.tile, s.scan, CAST(q.band * 8 // 127 AS INT) AS bucket, q.idx FROM ({IDX2}) q JOIN ({SCAN2}) s ON s.lin = q.v * 64 + q.u"


def scanned(spark, sf_dir):
    i = idx2(spark, sf_dir)
    s = transform.scan(spark, 64, 2).select("lin", "scan")
    return i.withColumn("lin", F.col("v") * 64 + F.col("u")).join(F.broadcast(s), "lin").select("tile", "scan", transform.bucket(F.col("band"), 126).alias("bucket"), "idx")


@query("last_nonzero", f"SELECT tile, coalesce(max(CASE WHEN idx <> 0 THEN scan END), -1) AS last FROM ({SCANNED}) GROUP BY tile")
def last_nonzero(spark, sf_dir):
    return transform.last_nonzero(scanned(spark, sf_dir), ["tile"])


TALLY = f"""WITH s AS ({SCANNED}), l AS (SELECT *, max(CASE WHEN idx <> 0 THEN scan END) OVER (PARTITION BY tile) AS last FROM s),
k AS (SELECT *, CASE WHEN abs(idx) <= 1 THEN 0 ELSE length(bin(abs(idx) - 1)) END AS k FROM l WHERE last IS NULL OR scan <= last),
b AS (SELECT bucket AS ctx, CASE WHEN idx = 0 THEN 0 ELSE 1 END AS bit FROM k
UNION ALL SELECT bucket + 8, CASE WHEN scan < last THEN 1 ELSE 0 END FROM k WHERE idx <> 0
UNION ALL SELECT least(i, 15) + 16, CASE WHEN i < k THEN 1 ELSE 0 END FROM k, range(32) r(i) WHERE idx <> 0 AND i <= k)
SELECT CAST(ctx AS INT) AS ctx, CAST(sum(1 - bit) AS BIGINT) AS n0, CAST(sum(bit) AS BIGINT) AS n1 FROM b GROUP BY ctx"""


@query("prior_tally", TALLY)
def prior_tally(spark, sf_dir):
    return training.tally(scanned(spark, sf_dir), ["tile"])


PRIORS = "SELECT CAST(i - 1 AS INT) AS ctx, CAST(p[i] AS INT) AS p0 FROM (SELECT [" + ", ".join(map(str, training.PRIORS)) + "] AS p), range(1, 33) r(i)"


@query("prior_defaults", PRIORS)
def prior_defaults(spark, sf_dir):
    return training.priors(spark)


@query("prior_fitted", f"SELECT p.ctx, CASE WHEN t.n0 + t.n1 > 0 THEN CAST(least(greatest((t.n0 * 2048 + (t.n0 + t.n1) // 2) // (t.n0 + t.n1), 1), 2047) AS INT) ELSE p.p0 END AS p0 FROM ({PRIORS}) p LEFT JOIN ({TALLY}) t ON t.ctx = p.ctx")
def prior_fitted(spark, sf_dir):
    return training.fitted(training.tally(scanned(spark, sf_dir), ["tile"]))


QS = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0)
GRID = f"SELECT g.q, tile, v, u, val, g.q * ({STEP2}) AS step, CASE WHEN abs(val) / (g.q * ({STEP2})) < 0.8 THEN 0 ELSE sign(val) * floor(abs(val) / (g.q * ({STEP2})) - 0.8 + 1) END AS idx FROM ({FWD2}), (SELECT unnest({list(QS)})::DOUBLE AS q) g"
CURVE = f"SELECT q, round(10 * log10(65025 / avg(pow(val - (CASE WHEN idx = 0 THEN 0 ELSE sign(idx) * (abs(idx) + 0.2) * step END), 2))), 4) AS psnr, round(1 / (1.0001 - avg(CASE WHEN idx = 0 THEN 1.0 ELSE 0.0 END)), 6) AS ratio FROM ({GRID}) GROUP BY q"


def curve(spark, sf_dir):
    """Distortion and a proxy of the rate for several qualities; by Parseval the error of coefficients is that of samples."""
    from lodestrata.functions import quant

    f = transform.forward(fx.tile(spark, sf_dir), ["tile"], ["v", "u"], 64)
    rows = f.withColumn("q", F.explode(F.array(*[F.lit(q) for q in QS])))
    step = quant.step(transform.band(["v", "u"]), F.col("q"), 126)
    rows = rows.withColumn("step", step).withColumn("idx", quant.quantize(F.col("val"), F.col("step")))
    back = quant.dequantize(F.col("idx"), F.col("step"))
    zero = F.avg(F.when(F.col("idx") == 0, 1.0).otherwise(0.0))
    return rows.groupBy("q").agg(F.round(metrics.psnr(F.col("val"), back), 4).alias("psnr"), F.round(1 / (F.lit(1.0001) - zero), 6).alias("ratio"))


@query("rate_curve", CURVE)
def rate_curve(spark, sf_dir):
    return curve(spark, sf_dir)


@query("rate_best", f"SELECT q, psnr, ratio FROM ({CURVE}) ORDER BY psnr DESC LIMIT 1")
def rate_best(spark, sf_dir):
    return training.best(curve(spark, sf_dir), "psnr")


RATES = "SELECT 1.0 + i * 0.25 AS rate FROM range(8) r(i)"
POINTS = "SELECT 'a' AS candidate, CAST(i AS DOUBLE) AS ratio, 50 - 4.0 * i AS psnr FROM range(1, 4) r(i) UNION ALL SELECT 'b', 0.5 + i, 52.5 - 3.5 * i - 0.25 * i * i FROM range(1, 4) r(i)"
AT = f"""SELECT candidate, rate, CASE WHEN rate <= lo THEN first_psnr WHEN rate >= hi THEN last_psnr ELSE (SELECT p.psnr + (g.rate - p.ratio) / (n.ratio - p.ratio) * (n.psnr - p.psnr) FROM ({POINTS}) p JOIN ({POINTS}) n ON n.candidate = p.candidate AND n.ratio = p.ratio + 1 WHERE p.candidate = e.candidate AND g.rate >= p.ratio AND g.rate < n.ratio) END AS psnr
FROM (SELECT candidate, min(ratio) AS lo, max(ratio) AS hi, arg_min(psnr, ratio) AS first_psnr, arg_max(psnr, ratio) AS last_psnr FROM ({POINTS}) GROUP BY candidate) e, ({RATES}) g"""


def _curves(spark):
    i = F.col("id")
    a = spark.range(1, 4).select(F.lit("a").alias("candidate"), i.cast("double").alias("ratio"), (50 - 4.0 * i).alias("psnr"))
    b = spark.range(1, 4).select(F.lit("b").alias("candidate"), (0.5 + i).alias("ratio"), (52.5 - 3.5 * i - 0.25 * i * i).alias("psnr"))
    return a.unionByName(b), spark.range(8).select((1.0 + i * 0.25).alias("rate"))


@query("rate_interpolate", f"SELECT candidate, CAST(rate AS DOUBLE) AS rate, CAST(round(psnr, 6) AS DOUBLE) AS psnr FROM ({AT})")
def rate_interpolate(spark, sf_dir):
    curves, rates = _curves(spark)
    return training.psnr_at(curves, rates, ["candidate"]).select("candidate", "rate", F.round("psnr", 6).alias("psnr"))


@query("rate_gain", f"SELECT a.candidate, CAST(round(avg(a.psnr - b.psnr), 6) AS DOUBLE) AS gain FROM ({AT}) a JOIN ({AT}) b ON a.rate = b.rate AND b.candidate = 'a' GROUP BY a.candidate")
def rate_gain(spark, sf_dir):
    curves, rates = _curves(spark)
    return training.gain(curves, rates, "a").select("candidate", F.round("gain", 6).alias("gain"))


@query("strided_blocks", f"SELECT z // 4 AS bz, y // 4 AS b_y, x // 4 AS bx, count(*) AS n FROM ({fx.VOX}) WHERE z // 4 % 4 = 0 AND y // 4 % 4 = 0 AND x // 4 % 4 = 0 GROUP BY 1, 2, 3")
def strided_blocks(spark, sf_dir):
    from lodestrata.functions.keys import div

    rows = fx.vox(spark, sf_dir).select(div(F.col("z"), 4).alias("bz"), div(F.col("y"), 4).alias("b_y"), div(F.col("x"), 4).alias("bx"))
    return training.strided(rows, ["bz", "b_y", "bx"], 4).groupBy("bz", "b_y", "bx").agg(F.count("*").alias("n"))


LOSSY = f"SELECT z, y, x, v AS a, round_even(v / 16.0, 0) * 16 AS b FROM ({fx.VOX})"


def lossy(spark, sf_dir):
    return fx.vox(spark, sf_dir).select("z", "y", "x", F.col("v").alias("a"), (F.rint(F.col("v") / 16.0) * 16).alias("b"))


@query("corrections_build", f"SELECT z, y, x, CAST(a - b AS DOUBLE) AS delta FROM ({LOSSY}) WHERE abs(a - b) > 4")
def corrections_build(spark, sf_dir):
    return transform.corrections(lossy(spark, sf_dir), 4.0).select("z", "y", "x", "delta")


@query("corrections_apply", f"SELECT z, y, x, CAST(CASE WHEN abs(a - b) > 4 THEN a ELSE b END AS DOUBLE) AS b FROM ({LOSSY})")
def corrections_apply(spark, sf_dir):
    rows = lossy(spark, sf_dir)
    return transform.corrected(rows, transform.corrections(rows, 4.0), ["z", "y", "x"]).select("z", "y", "x", "b")
