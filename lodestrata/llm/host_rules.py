"""Host-level quality rules: failures by host, rates shrunk by an empirical beta prior, verdicts joined back (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, let, words

SYMBOLS = "#*$%&|<>"
#: Words in a window that may repeat, words a document needs, and the percentage of repeated words it may have.
WINDOW, MIN_WORDS, MAX_REPEAT = 5, 10, 20
#: A host goes if its shrunk failure rate is over this; the prior never counts for less than PRIOR_LEAST documents.
MAX_HOST_RATE, PRIOR_LEAST = 0.5, 2.0


def repeated_words(w: Column, width: int = WINDOW) -> Column:
    """How many of the words w stand in a window of width words found twice or more among them.

    Windows are compared by a 64-bit hash. Where all hashes of a text differ, as in most texts, nothing is sorted.
    """

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(at, start, lambda a, p: F.struct((a["n"] + p + width - F.greatest(p, a["end"])).cast("int").alias("n"), (p + width).cast("int").alias("end")))["n"]

    def twice(s: Column) -> Column:
        n = F.size(s)
        same = F.filter(s, lambda e, k: ((k > 0) & (F.get(s, k - 1)["h"] == e["h"])) | ((k < n - 1) & (F.get(s, k + 1)["h"] == e["h"])))
        return covered(F.sort_array(F.transform(same, lambda e: e["i"])))

    def of(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(pairs, twice))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))
    return F.when(F.size(w) < width, 0).otherwise(let(windows, of)).cast("long")


def repeated_lines(text: Column) -> Column:
    """How many \\n-split lines that hold a word equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """(key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed), one row a document; null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.length(F.translate(t, SPACES, ""))
    counts = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    out = docs.select(F.col(key).alias("key"), F.col(host).alias("host"), counts.alias("c"), bare.cast("long").alias("word_chars"), (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"), repeated_lines(t).alias("n_dup_lines"))
    failed = (F.col("c.n_words") < MIN_WORDS) | (F.col("c.n_repeat_words") * 100 > F.col("c.n_words") * MAX_REPEAT)
    return out.select("key", "host", "c.n_words", "word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words", failed.alias("base_failed"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(a, b) of the beta prior on hosts' failure rates, by moments; hosts has n and failed.

    The mean weighs hosts by documents. What the rates vary beyond binomial noise gives the prior's strength a + b;
    with no such excess the prior is as strong as all documents together.
    """
    p = F.col("failed") / F.col("n")
    k, n, failed, square, spread = hosts.agg(F.count("*"), F.sum("n"), F.sum("failed"), F.sum(F.col("n") * p * p), F.sum(F.col("n") * F.col("n"))).first()
    if not k:
        return 1.0, 1.0
    mean = min(max(failed / n, 1e-6), 1 - 1e-6)
    between = square / n - mean * mean  # weighted variance of the rates
    noise, scale = mean * (1 - mean) * k / n, 1 - spread / (n * n)
    excess = (between - noise * (1 - 1 / k)) / scale if scale > 0 else 0.0
    strength = max(PRIOR_LEAST, mean * (1 - mean) / excess - 1) if excess > 0 else float(n)
    return mean * strength, (1 - mean) * strength


def host_verdicts(base: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n, failed, rate, host_kept) for each host that isn't null."""
    hosts = cut(base.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")))
    a, b = beta_prior(hosts)
    rate = (F.col("failed") + a) / (F.col("n") + a + b)
    return hosts.select("host", "n", "failed", rate.alias("rate"), (rate <= max_rate).alias("host_kept"))


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """measure's columns and kept: the document passes its own rules and its host's shrunk failure rate is at most max_rate.

    The texts are read once; what the host level needs is cut to a narrow table. Only hosts that go are joined back.
    A null host has no verdict: its documents stand on their own. Null text: no words, base_failed. Rows alike are
    judged alike. An empty table gives no rows.
    """
    base = cut(measure(docs, text, key, host))
    gone = host_verdicts(base, max_rate).where(~F.col("host_kept")).select("host", F.lit(True).alias("gone"))
    return base.join(gone, "host", "left").withColumn("kept", ~F.col("base_failed") & F.col("gone").isNull()).drop("gone")
