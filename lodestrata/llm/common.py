"""What several corpus operators share: words, shared storage, row keys, connected components."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009..U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = r"[ \x09-\x0D]+"


#: Rows and bytes that go to a Python worker at once at most.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Holds Arrow batches to BATCH_ROWS and BATCH_BYTES, so that a worker's memory doesn't grow with the length of texts."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.match(r"-?\d+", spark.conf.get(name) or "0")
        if not now or not 0 < int(now.group()) <= most:
            spark.conf.set(name, str(most))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table as Spark's own reader gives it, so that any file system Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset and the session is local (tests), a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestrata-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows from replicated storage: later jobs neither recompute them nor lose them with an executor."""
    shared_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.select("*").checkpoint()  # what select returns is planned anew, so that tidy holds for it


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row even where body is a lambda that uses it for every element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The text's words in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RE), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many words the text has (null: 0)."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, SPACE_RE))).cast("long")


def fold(name: str, taken: list[str]) -> str:
    """name, or name with underscores in front of it if a column of the input has it already (in any case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


#: Edges that are put together on the driver at once (2 MB of them); more are in rounds of joins.
AT_ONCE = 1 << 17


def components_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node that each reaches) of undirected edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root, before = np.arange(len(nodes)), None
    while before is None or (root != before).any():
        before = root
        root = before.copy()
        np.minimum.at(root, np.maximum(before[u], before[v]), np.minimum(before[u], before[v]))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def connected_components(edges: DataFrame, max_rounds: int = 60, at_once: int = AT_ONCE) -> DataFrame:
    """(node, component): the smallest node that the undirected edges (a, b) reach, for every node in an edge.

    Up to at_once edges between longs are put together on the driver: rounds of joins over so few cost mostly their files.
    More of them alternate large stars (each node's larger neighbours move to its smallest neighbour) with small stars (its
    smaller neighbours do). Every step is a min per node, combined before the shuffle, and a join, so that a node with any
    number of neighbours needs no list of them in one place. Ends when an iteration changes no edge; lineage is cut each round.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    if now.schema["hi"].dataType.simpleString() == "bigint" and now.count() <= at_once:
        few = now.toArrow()
        found = components_of(*(few.column(c).to_numpy() for c in ("hi", "lo")))
        return edges.sparkSession.createDataFrame(pa.table(dict(zip(("node", "component"), map(pa.array, found), strict=True))))
    nodes = now.select(F.col("hi").alias("node")).union(now.select("lo")).distinct()
    now, before = now.where("hi <> lo"), None
    for _ in range(max_rounds):
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if sums == before:
            break
        before = sums
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(floor, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        now = cut(small.select("e.hi", "e.lo").where("hi <> lo").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(now, nodes.node == now.hi, "left").select("node", F.coalesce("lo", "node").alias("component"))


#: While this is on, Spark deletes a query's shuffle files when the query ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of queries planned and run in here go when their query ends: even an empty one takes several files a task."""
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before)


def stash(df: DataFrame) -> tuple[DataFrame, str]:
    """(the rows reread from a Parquet table in the shared folder, its path): columns that a later step doesn't use aren't read.

    Once the table is written, the shuffle files that led to it are of no use and go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def row_of(df: DataFrame) -> Column:
    """A row's columns as one struct named row, so that no name of theirs can clash with one of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def single(df: DataFrame, *by: str) -> DataFrame:
    """df with one row of those alike in the columns by. Only rows that have another such row are shuffled."""
    twice = cut(df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by))
    if twice.isEmpty():
        return df
    twice = twice.select(F.struct(*by).alias("twice"))
    same = F.struct(*by).eqNullSafe(F.col("twice"))
    return df.join(twice, same, "left_anti").unionByName(df.join(twice, same, "left_semi").dropDuplicates(list(by)))


def drop_stash(spark: SparkSession, path: str) -> None:
    """Deletes a table that stash wrote, once nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
