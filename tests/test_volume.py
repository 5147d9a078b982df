"""Analytic cases: linear fields, slabs, pruning, coders."""

import re

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from lodestrata.functions.keys import Geometry
from lodestrata.operators import cells, codec, entropy, render, sampling, spatial, store, surfaces, training, transform
from lodestrata.sources import bytes as sb


def test_trilinear_is_exact_on_a_linear_field(spark):
    i = F.col("id")
    field = spark.range(12**3).select(F.floor(i / 144).cast("int").alias("z"), (F.floor(i / 12) % 12).cast("int").alias("y"), (i % 12).cast("int").alias("x"))
    field = field.withColumn("v", F.col("z") * 100 + F.col("y") * 10 + F.col("x"))
    at = spark.createDataFrame([(1, 5.5, 6.0, 7.0), (2, 10.25, 3.75, 2.5), (3, 1.5, 1.5, 1.5), (4, -1.0, 0.0, 0.0)], "id int, z double, y double, x double")
    got = dict(sampling.trilinear(at, field).collect())
    assert got[1] == pytest.approx(617) and got[2] == pytest.approx(1065) and got[3] == pytest.approx(166.5) and got[4] == 0


def test_slab_renders_its_value(spark):
    i = F.col("id")
    slab = spark.range(5 * 64 * 64).select((20 + F.floor(i / 4096)).cast("int").alias("z"), (F.floor(i / 64) % 64).cast("int").alias("y"), (i % 64).cast("int").alias("x"), F.lit(200).alias("v"))
    plane = surfaces.plane(spark, (22, 10, 10), (0, 0, 1), (0, 1, 0), (1, 0, 0), 8, 8)
    assert {r.px for r in render.render(plane, slab, -1, 1, 1).collect()} == {200.0}
    far = surfaces.plane(spark, (40, 10, 10), (0, 0, 1), (0, 1, 0), (1, 0, 0), 8, 8)
    assert {r.px for r in render.render(far, slab, -1, 1, 1, "mean").collect()} == {0.0}
    bands = [render.render(plane, slab, -1, 1, 1, rows=b).collect() for b in ((0, 3), (3, 8))]
    assert sorted(bands[0] + bands[1]) == sorted(render.render(plane, slab, -1, 1, 1).collect())


def test_pyramid_means_material_only(spark):
    cell = spark.createDataFrame([(0, 0, 0, 100), (0, 0, 1, 100), (1, 0, 0, 100), (1, 0, 1, 100)], "z int, y int, x int, v int")
    assert cells.downsample(cell).collect() == [(0, 0, 0, 100)]


def test_box_bounds_reach_the_scan(spark, tmp_path):
    rows = spark.range(64).select((F.col("id") % 4).cast("int").alias("cz"), F.lit(0).alias("cy"), F.lit(0).alias("cx"), F.col("id").cast("int").alias("z"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(0).alias("by"), F.lit(0).alias("bx"), F.lit(0).alias("bz"), F.lit(1).alias("v"))
    rows.write.partitionBy("cz", "cy", "cx").parquet(str(tmp_path / "v"))
    plan = store.region(spark.read.parquet(str(tmp_path / "v")), (0, 0, 0), (16, 1, 1), 16)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cz" in plan and "PushedFilters: [IsNotNull(z)" in plan.replace("IsNotNull(bz), ", "").replace("IsNotNull(by), ", "").replace("IsNotNull(bx), ", "") or "LessThanOrEqual(z,15)" in plan


def test_geometry_slots_are_a_bijection(spark):
    g = Geometry(1024, 512, 300, 4)
    levels = g.levels(spark).collect()
    every = spark.createDataFrame([(r.lod, z, y, x) for r in levels for z in range(r.ncz) for y in range(r.ncy) for x in range(r.ncx)], "lod int, cz int, cy int, cx int")
    slots = sorted(r.slot for r in g.slots(every).collect())
    assert slots == list(range(sum(r.chunks for r in levels)))
    with pytest.raises(ValueError):
        Geometry(0, 1, 1)


def test_transform_is_orthonormal():
    for n in (16, 64):
        m = transform.matrix(n)
        assert np.allclose(m @ m.T, np.eye(n), atol=1e-12)
    block = np.random.default_rng(1).random((16, 16, 16)) * 255
    assert np.abs(codec.inverse(codec.forward(block)) - block).max() < 1e-9


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_bits_come_back(share):
    bits = [int(x) for x in np.random.default_rng(3).random(3000) < share]
    assert entropy.decode_bits(entropy.encode_bits(bits), len(bits)) == bits


def test_indices_come_back_and_garbage_decodes():
    rng = np.random.default_rng(5)
    for scale in (0, 1, 40, 5000):
        idx = np.round(rng.standard_normal(4096) * scale * (rng.random(4096) < 0.2)).astype(int)
        assert (entropy.decode_indices(entropy.encode_indices(idx, 16, 3), 16, 3) == idx).all()
    for n in (0, 1, 5, 300):
        assert entropy.decode_indices(rng.bytes(n), 16, 3).shape == (4096,)
        assert codec.decode_masked(rng.bytes(n), 2.0, 16, 3).shape == (16, 16, 16)


def test_many_streams_give_the_bytes_of_one():
    rng = np.random.default_rng(7)
    bits = rng.random((60, 700)) < rng.random((60, 1)) ** 2
    coded = entropy.encode_bit_rows(bits)
    assert coded == [entropy.encode_bits(r.tolist()) for r in bits] and (entropy.decode_bit_rows(coded, 700) == bits).all()
    idx = np.stack([np.round(rng.standard_normal(4096) * s * (rng.random(4096) < d)).astype(int) for s in (0, 1, 40, 5000, 1e8) for d in (0, 0.001, 0.2, 1)])
    coded = entropy.encode_index_rows(idx, 16, 3)
    assert coded == [entropy.encode_indices(r, 16, 3) for r in idx] and (entropy.decode_index_rows(coded, 16, 3) == idx).all()
    junk = [b"", b"\xff" * 900] + [rng.bytes(int(n)) for n in rng.integers(0, 900, 40)]
    assert (entropy.decode_index_rows(junk, 16, 3) == [entropy.decode_indices(d, 16, 3) for d in junk]).all()
    assert (entropy.decode_bit_rows(junk, 300) == [entropy.decode_bits(d, 300) for d in junk]).all()
    assert entropy.encode_bit_rows(np.zeros((0, 5))) == [] and entropy.decode_index_rows([], 16, 3).shape == (0, 4096)


def test_blocks_are_put_together_across_batches(monkeypatch):
    monkeypatch.setattr(codec, "LANES", 4)
    rng = np.random.default_rng(8)
    k = np.sort(rng.integers(0, 30, 300))
    lin = np.concatenate([rng.permutation(40)[:n] for n in np.unique(k, return_counts=True)[1]])
    for size in (1, 3, 7, 300):
        rows = pa.table({"k": k, "lin": lin, "val": np.arange(300.0) + 1})
        seen, want = {}, {}
        for a, b in codec.dense_blocks(iter(rows.to_batches(max_chunksize=size)), ["k"], 40):
            assert len(a) <= 4 and not seen.keys() & set(a[:, 0].tolist())
            seen |= dict(zip(a[:, 0].tolist(), b.copy(), strict=True))
        for i, a in enumerate(k.tolist()):
            want.setdefault(a, np.zeros(40))[lin[i]] = i + 1
        assert seen.keys() == want.keys() and all((seen[a] == want[a]).all() for a in want)


def test_masked_block_keeps_air_and_floor():
    at = np.indices((16, 16, 16)) - 8
    mask = (at**2).sum(axis=0) < 36
    block = np.where(mask, 40 + (at**2).sum(axis=0), 0).astype(float)
    back = codec.decode_masked(codec.encode_masked(block, mask, 2.0), 2.0, 16, 3)
    assert ((back == 0) == ~mask).all() and back[mask].min() >= codec.FLOOR
    assert 10 * np.log10(255**2 / ((back - block)[mask] ** 2).mean()) >= 28


def test_volume_describes_itself_and_keeps_values(spark, tmp_path):
    path, at = str(tmp_path / "v"), F.col("id")
    ball = spark.range(32**3).select(F.lit(0).alias("lod"), F.floor(at / 1024).cast("int").alias("z"), (F.floor(at / 32) % 32).cast("int").alias("y"), (at % 32).cast("int").alias("x"))
    far = F.pow(F.col("z") - 16, 2) + F.pow(F.col("y") - 16, 2) + F.pow(F.col("x") - 16, 2)
    ball = ball.withColumn("v", F.when(far < 150, 60 + far / 2).otherwise(0).cast("int"))
    header = store.Header(Geometry(32, 32, 32, 1, 16), 2.0, "u8", {"of": "a ball"})
    store.write_volume(ball, path, header)
    assert store.read_header(spark, path) == header
    both = ball.join(store.read_region(spark, path, 0, (0, 0, 0), (32, 32, 32)).withColumnRenamed("v", "b"), ["z", "y", "x"])
    air, mse = both.agg(F.sum(((F.col("v") == 0) != (F.col("b") == 0)).cast("int")), F.avg(F.when(F.col("v") > 0, F.pow(F.col("v") - F.col("b"), 2)))).first()
    assert air == 0 and 10 * np.log10(255**2 / mse) >= 30
    with pytest.raises(Exception, match="outside the volume"):
        store.write_volume(ball, str(tmp_path / "w"), store.Header(Geometry(32, 32, 20, 1, 16), 2.0))
    with pytest.raises(ValueError):
        store.Header(header.geometry, 0.0)
    store.header_rows(spark, path).limit(0).write.mode("overwrite").parquet(str(tmp_path / "x" / "header"))
    with pytest.raises(ValueError, match="corrupt"):
        store.read_header(spark, str(tmp_path / "x"))


def test_chunk_images():
    image = sb.build_chunk({0: b"hello", 2: b"abc"})
    view = sb.Chunk(image)
    assert view.verify() and dict(view.blocks()) == {0: b"hello", 2: b"abc"} and view.length() == len(image)
    assert not sb.Chunk(image[:-1] + b"?").verify() and not sb.Chunk(b"").verify() and list(sb.Chunk(b"x" * 50).blocks()) == []


def test_transform_gathers_blocks_once(spark):
    n, rng = 4, np.random.default_rng(3)
    x = {b: rng.standard_normal((n, n)) for b in (0, 7, None)}
    x[7][1:] = 0  # absent samples are 0
    rows = [(b, v, u, float(x[b][v, u])) for b in x for v in range(n if b != 7 else 1) for u in range(n)]
    x[0][2, 3] += 5  # samples at one place add up, nulls don't, places off the block are left out
    rows += [(0, 2, 3, 5.0), (0, 1, 1, None), (0, n, 0, 9.0), (0, None, 0, 9.0), (9, 0, 0, None)]
    table = spark.createDataFrame(rows, "b long, v int, u int, val double").repartition(5)
    m = transform.matrix(n)
    got = transform.forward(table, ["b"], ["v", "u"], n)
    assert got.columns == ["b", "v", "u", "val"]
    found = {(r.b, r.v, r.u): r.val for r in got.collect()}
    assert len(found) == 4 * n * n and all(found[9, v, u] is None for v in range(n) for u in range(n))
    for b in x:
        want = m @ x[b] @ m.T
        assert all(found[b, v, u] == pytest.approx(want[v, u], abs=1e-12) for v in range(n) for u in range(n))
    back = {(r.b, r.v, r.u): r.val for r in transform.there_and_back(table.where("b < 9"), ["b"], ["v", "u"], n).collect()}
    assert back.keys() == {(b, v, u) for b, v, u, _ in rows if b in (0, 7) and v is not None and v < n}
    assert all(back[b, v, u] == pytest.approx(x[b][v, u], abs=1e-12) for b, v, u in back)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and len(set(re.findall(r"hashpartitioning\([^)]*\)", plan))) == 1  # blocks move once


def test_tasks_that_gather_blocks_follow_the_input(spark, tmp_path, monkeypatch):
    i = F.col("id")
    spark.range(4000).select(F.floor(i / 16).alias("b"), (F.floor(i / 4) % 4).cast("int").alias("v"), (i % 4).cast("int").alias("u"), i.cast("double").alias("val")).repartition(7).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    usual = {(r.b, r.v, r.u): r.val for r in transform.forward(table, ["b"], ["v", "u"], 4).collect()}
    monkeypatch.setattr(transform, "TASK_INPUT", sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet")) // 9)
    many = transform.forward(table, ["b"], ["v", "u"], 4)
    assert 9 <= many.rdd.getNumPartitions() <= 11  # 4 are the session's
    assert {(r.b, r.v, r.u): r.val for r in many.collect()} == pytest.approx(usual, abs=1e-9) and len(usual) == 4000


def test_tally_counts_blocks_from_pieces(spark):
    rng = np.random.default_rng(8)
    rows = [(b, s, s % 8, int(rng.choice([0, 0, 0, 1, -1, 2, -5, 70000])) if b % 3 else 0) for b in range(12) for s in range(60)]
    rows += [(None, 4, 2, 3), (None, 9, 1, 0), (None, 2, 7, None), (5, 3, 3, 1)]  # a null block, a null index, a place given twice
    want, last = {}, {b: max((s for c, s, _, v in rows if c == b and v), default=None) for b, *_ in rows}

    def bit(ctx, x):
        want.setdefault(ctx, [0, 0])[x] += 1

    for b, s, bucket, v in rows:
        if last[b] is None or s <= last[b]:
            bit(bucket, int(bool(v)))
            for i in range((k := (abs(v) - 1).bit_length()) + 1) if v else ():
                bit(min(i, 15) + 16, int(i < k))
            if v:
                bit(bucket + 8, int(s < last[b]))
    table = spark.createDataFrame(rows, "b long, scan int, bucket int, idx long").repartition(6)
    got = training.tally(table, ["b"])
    assert {r.ctx: [r.n0, r.n1] for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan  # no sort of all places, no row for each bit
    assert training.tally(table.limit(0), ["b"]).count() == 0


def test_nearest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spatial, "LEAF", 16)  # many leaves
    monkeypatch.setattr(spatial, "within_radius", None)  # pairs within the radius aren't listed
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((700, 3)), 1) * 0.2
    x[:200] = x[0]  # many points at one place, and many ties on the grid
    x[-1] = 9  # one far from all
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(x.tolist())] + [(900, None, 0.0, 0.0), (901, float("nan"), 0.0, 0.0)], "id long, z double, y double, x double")
    got = {(r.id, r["rank"]): r.other for r in spatial.nearest_k(table, table, 0.05, 3).collect()}
    g = x[:, None, :] - x[None, :, :]
    d2, want = g[..., 0] * g[..., 0] + g[..., 1] * g[..., 1] + g[..., 2] * g[..., 2], {}
    for i in range(700):
        some = [j for j in np.lexsort((np.arange(700), d2[i])) if j != i and d2[i, j] <= 0.05 * 0.05][:3]
        want |= {(i, r): j for r, j in enumerate(some, 1)}
    assert got == want
    assert spatial.nearest_k(table.limit(0), table.limit(0), 0.05, 3).count() == 0
