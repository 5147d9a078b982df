"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals, reranked exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .langid import bounded

#: Bounds of the sample that the index is fitted on, and of its cells; codes of a residual's parts; rounds of k-means.
TRAIN_ROWS, MOST_CELLS, PARTS, CODES, ROUNDS = 20_000, 4096, 16, 256, 12
#: Share of a query's neighbours that should lie in the cells it visits, by trial of TRIALS queries on a sample; candidates
#: reranked first in a block for each neighbour asked for; rows of a block.
RECALL, TRIALS, RERANK, BLOCK = 0.98, 400, 5, 4096
#: Queries scored at once against a block.
AT_ONCE = 64


@dataclass
class Index:
    """Coarse centroids (cells, d) and the codebooks (parts, codes, width) of what is left of a vector without its centroid."""

    centres: np.ndarray
    books: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell nearest to each row of x by distance."""
        return np.argmin((self.centres**2).sum(axis=1) - 2 * x @ self.centres.T, axis=1)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A byte for each part of the residual, and how far the vector lies from what the bytes say."""
        parts, _, width = self.books.shape
        rest = (x - self.centres[cell]).reshape(len(x), parts, width)
        out, off = np.empty((len(x), parts), np.uint8), np.zeros(len(x))
        for p in range(parts):
            out[:, p] = np.argmin((self.books[p] ** 2).sum(axis=1) - 2 * rest[:, p] @ self.books[p].T, axis=1)
            off += ((rest[:, p] - self.books[p][out[:, p]]) ** 2).sum(axis=1)
        return out, np.sqrt(off)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, parts, codes): each code's share of the inner product with each query."""
        parts, _, width = self.books.shape
        return np.einsum("qpw,pcw->qpc", q.reshape(len(q), parts, width), self.books)

    def visits(self, ids: np.ndarray, x: np.ndarray, asked: np.ndarray, q: np.ndarray, k: int, recall: float) -> int:
        """How many cells a query has to visit for recall of its k neighbours, tried with the queries q on the rows x."""
        k = min(k, len(x) - 1)
        if k < 1 or not len(q):
            return len(self.centres)
        near = q @ x.T
        near[asked[:, None] == ids[None, :]] = -np.inf
        true = self.cells(x)[np.argpartition(-near, k - 1, axis=1)[:, :k]]
        place = np.argsort(np.argsort(-(q @ self.centres.T), axis=1), axis=1)
        return int(np.sort(np.take_along_axis(place, true, axis=1).ravel())[int(np.ceil(recall * true.size)) - 1]) + 1

    def visited(self, q: np.ndarray, n: int, sizes: np.ndarray, least: int) -> list[list[int]]:
        """For each query the n cells whose centroids have the largest inner product with it, or as many more as hold least rows."""
        order = np.argsort(-(q @ self.centres.T), axis=1, kind="stable")
        need = (np.cumsum(sizes[order], axis=1) < least).sum(axis=1) + 1
        return [row[: max(n, m)].tolist() for row, m in zip(order, need.tolist(), strict=True)]


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """k centroids of the rows of x, from seeded rows of it; an empty cell takes a row anew."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        of = np.concatenate([np.argmin((centres**2).sum(axis=1) - 2 * x[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(x), 4096)])
        n = np.bincount(of, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)])
    return centres


def fit(x: np.ndarray, cells: int, parts: int = PARTS, codes: int = CODES) -> Index:
    """The index of a sample x (rows, d); d is cut into at most parts equal parts."""
    parts = next(p for p in range(min(parts, x.shape[1]), 0, -1) if x.shape[1] % p == 0)
    centres = kmeans(x, cells)
    own = Index(centres, np.zeros((parts, 1, x.shape[1] // parts)))
    rest = (x - centres[own.cells(x)]).reshape(len(x), parts, -1)
    books = [kmeans(rest[:, p], codes, seed=p + 1) for p in range(parts)]
    most = max(map(len, books))
    return Index(centres, np.stack([np.pad(b, ((0, most - len(b)), (0, 0)), mode="edge") for b in books]))


def usable(vector: Column) -> Column:
    """The vector is not null, holds finite numbers only, and one that isn't zero."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _gathered(rows: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and vectors of a bounded number of rows (id, v)."""
    got = rows.select("id", "v").toArrow()
    return got["id"].to_numpy(), _matrix(got["v"].combine_chunks()).reshape(-1, d)


FOUND = "query_id long, vec_id long, score double"


def search(rows: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", recall: float | None = RECALL, rerank: int = RERANK, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner product found for each query, ties to the smaller key.

    Fitted on a bounded sample of train_rows; every usable row is indexed and every usable query is answered; a query's
    own row is no candidate. Rows are held in blocks of about BLOCK rows: several small cells, or a part of a large one, so
    a cell of any size is spread over tasks. A query goes once to each block that holds cells near to it, as many as a
    trial of queries on a sample that the index wasn't fitted on (all rows, if few) shows it needs for recall; there, tables
    of its products with the codes rank all rows, and the best k * rerank are scored exactly, in double precision, on the
    original vectors held in the block; so is then every other row that, as far as it may lie from its codes, could be
    among the k best. So nothing is lost in the cells visited, however coarse the codes are for these rows.
    Vectors that are null, zero or hold null or non-finite components, rows with a null key and vectors of another length
    than most take no part. recall None is exact: every cell is visited and every row reranked. Repeated keys are separate rows. Few rows: all cells are visited. No rows: no results.
    """
    spark = rows.sparkSession
    kind = rows.schema[vector].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return empty
    d, n = lengths
    own, asked = own.where(F.size("v") == d), asked.where(F.size("v") == d)
    sample = _gathered(bounded(own, F.col("id"), train_rows), d)
    cells = int(min(MOST_CELLS, max(1, n**0.5), max(1, len(sample[0]) // 8)))
    model = fit(sample[1], cells)
    n_visit = len(model.centres)
    if recall is not None:
        trial = sample if len(sample[0]) == n else _gathered(bounded(own, F.col("id"), train_rows, seed=1), d)
        n_visit = model.visits(*trial, *_gathered(bounded(asked, F.col("id"), TRIALS, seed=2), d), k, recall)
    sent = spark.sparkContext.broadcast(model)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                x = _matrix(part.column(1))
                cell = sent.value.cells(x)
                codes, off = sent.value.encode(x, cell)
                codes = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell, pa.int32()), codes, pa.array(off)], ["id", "v", "cell", "code", "off"])

    indexed = cut(own.mapInArrow(index, f"id long, v {kind}, cell int, code binary, off double"))
    sizes = {r[0]: r[1] for r in indexed.groupBy("cell").agg(F.count("*")).collect()}  # a row a cell, MOST_CELLS at most
    blocks = spark.sparkContext.broadcast(dealt(sizes))
    held = spark.sparkContext.broadcast(np.array([sizes.get(c, 0) for c in range(len(model.centres))]))
    place = spark.createDataFrame([(c, first, n) for c, (first, n) in blocks.value.items()], "cell int, first long, n long")
    # rows alike are spread too: a key with very many rows is in all blocks of its cell
    dealt_to = F.col("first") + F.pmod(F.xxhash64("id", F.spark_partition_id(), F.monotonically_increasing_id()), F.col("n"))
    indexed = indexed.join(F.broadcast(place), "cell").select("id", "v", "cell", "code", "off", dealt_to.cast("int").alias("block"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                rows, block, near = [], [], []
                for row, visited in enumerate(sent.value.visited(_matrix(part.column(1)), n_visit, held.value, k + 1)):
                    to: dict[int, list[int]] = {}
                    for cell in visited:
                        first, n = blocks.value.get(cell, (0, 0))
                        for j in range(first, first + n):
                            to.setdefault(j, []).append(cell)
                    rows += [row] * len(to)
                    block += to.keys()
                    near += to.values()
                at = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(block, pa.int32()), pa.array(near, pa.list_(pa.int32()))], ["id", "v", "block", "near"])

    routed = asked.mapInArrow(route, f"id long, v {kind}, block int, near array<int>")
    keep = k * rerank if recall is not None else n

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            model, left = sent.value, left.sort_by("id")  # so that ties fall to the smaller key
            ids, x, cell, off = left["id"].to_numpy(), _matrix(left["v"].combine_chunks()), left["cell"].to_numpy(), left["off"].to_numpy()
            size = np.sqrt((x**2).sum(axis=1))
            codes = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
            for i in range(0, right.num_rows, AT_ONCE):
                part = right.slice(i, AT_ONCE)
                asked_ids, q = part["id"].to_numpy(), _matrix(part["v"].combine_chunks())
                table = model.tables(q)
                near = (q @ model.centres.T)[:, cell]
                for p in range(codes.shape[1]):
                    near += table[:, p][:, codes[:, p]]
                whole = None
                for row, visited in enumerate(part["near"].to_pylist()):
                    some = np.flatnonzero(np.isin(cell, visited) & (ids != asked_ids[row]))
                    long = np.sqrt(q[row] @ q[row])
                    slack = 1e-9 * long * size[some]  # rounding of products by another order of sums
                    if len(some) > keep:
                        first = some[np.argpartition(-near[row, some], keep - 1)[:keep]]
                        least = np.partition(x[first] @ q[row], keep - k)[keep - k]
                        ok = near[row, some] + long * off[some] + slack >= least
                        some, slack = some[ok], slack[ok]
                    if len(some) > keep:
                        if whole is None:
                            whole = q @ x.T
                        score = whole[row, some]
                        some = some[score + slack >= np.partition(score - slack, len(some) - k)[len(some) - k]]
                    exact = (x[some] * q[row]).sum(axis=1)  # alike for rows alike, wherever they stand
                    best = np.lexsort((ids[some], -exact))[:k]
                    out[0] += [int(asked_ids[row])] * len(best)
                    out[1] += ids[some[best]].tolist()
                    out[2] += exact[best].tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = indexed.groupBy("block").cogroup(routed.groupBy("block")).applyInArrow(answer, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def dealt(sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Cell to (first block, number of blocks): small cells share blocks of about BLOCK rows, large ones have several."""
    out, block, held = {}, 0, 0
    for cell, n in sorted(sizes.items()):
        parts = -(-n // BLOCK)
        if held and held + n > BLOCK:
            block, held = block + 1, 0
        out[cell] = (block, parts)
        block, held = (block + parts, 0) if parts > 1 else (block, held + n)
    return out
