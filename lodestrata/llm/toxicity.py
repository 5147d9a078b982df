"""Toxicity: maximum-scoring segments over token log-odds, judged by extreme-value statistics."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, let, row_of, small_batches, words
from .langid import bounded
from .tokens import slices

#: Bounds of what is learned: labelled documents of each class, and tokens with a score of their own.
TRAIN_DOCS, TOKENS = 10_000, 50_000
#: Strength of the Dirichlet prior in tokens, and its part that all have alike; the significance and size that a token's log-odds need; the most a token scores; the most that a segment may be expected by chance; the least that other tokens cost.
PRIOR, PSEUDO, LEAST_G, LEAST_ODDS, MOST, MAX_E, LEAST_DRIFT = 1000.0, 0.5, 4.5, 1.5, 8.0, 0.1, 0.1
THRESHOLD = 0.7
TOKEN = re.compile(r"\w+")


#: Lengths of the beginnings that stand in for tokens without a score of their own, longest first, and their mark.
STEMS, STEM = (6, 5, 4), "*"
#: Tokens whose scores a worker keeps.
MEMO = 150_000


def features(tokens: Counter) -> Counter:
    """Counts of tokens and of the beginnings of longer ones (in documents; one with two such tokens counts twice)."""
    out = Counter(tokens)
    for t, n in tokens.items():
        for size in STEMS:
            if len(t) > size:
                out[t[:size] + STEM] += n
    return out


def tokens_of(text: bytes | None) -> list[str]:
    return TOKEN.findall(text.decode().lower()) if text else []


def log_odds(toxic: float, clean: float, all_toxic: float, all_clean: float, prior: float = PRIOR) -> tuple[float, float]:
    """(log-odds, significance) of a token's use in toxic against clean documents.

    The odds have a Dirichlet prior, in proportion to the token's use in both with PSEUDO of its own added. The
    significance is the signed root of the likelihood ratio against equal use.
    """
    a = PSEUDO + prior * (toxic + clean) / (all_toxic + all_clean)
    yt, yc = toxic + a, clean + a
    odds = math.log(yt / (all_toxic + prior - yt)) - math.log(yc / (all_clean + prior - yc))
    share, n = all_toxic / (all_toxic + all_clean), toxic + clean
    g = sum(o * math.log(o / e) for o, e in ((toxic, n * share), (clean, n * (1 - share))) if o)
    return odds, math.copysign(math.sqrt(max(0.0, 2 * g)), toxic - n * share)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence, in linear time; end is exclusive.

    Runs through the positive scores alone, keeping candidates with the sums before and after them. A new candidate is
    joined with the nearest earlier one that began lower, if that one also ended lower, and then looks again.
    """
    above = np.flatnonzero(scores > 0)
    if not len(above):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    kept: list[list] = []  # start, end, sum before, sum at the end, place of the nearest earlier that began lower
    for i in above.tolist():
        start, left, right = i, float(sums[i]), float(sums[i + 1])
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= right:
                break
            start, left = kept[j][0], kept[j][2]
            nearest = kept[j][4]
            del kept[j:]
            j = nearest
        kept.append([start, i + 1, left, right, j])
    return [(a, b, right - left) for a, b, left, right, _ in kept]


@dataclass
class Model:
    """Token scores with their drift, the extreme-value parameters and the calibration of a document's sum."""

    tokens: dict[str, float] = field(default_factory=dict)
    other: float = -0.1
    decay: float = 1.0
    k: float = 0.1
    slope: float = 0.0
    offset: float = -20.0
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    def value(self, token: str) -> float:
        """A token's score: its own, else its longest scored beginning's, else the drift."""
        if (own := self.tokens.get(token)) is not None:
            return own
        for size in STEMS:
            if len(token) > size and (stem := self.tokens.get(token[:size] + STEM)) is not None:
                return stem
        return self.other

    def scores(self, tokens: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for t in set(tokens).difference(memo):
            memo[t] = self.value(t)
        return np.array([memo[t] for t in tokens], float)

    def passages(self, tokens: list[str]) -> list[tuple[int, int, float, float]]:
        """(start, end, score, expected by chance) of each significant segment, in words of the text."""
        if not tokens:
            return []
        n = len(tokens)
        found = [(a, b, s, self.k * n * math.exp(-self.decay * s)) for a, b, s in segments(self.scores(tokens))]
        return [x for x in found if x[3] <= MAX_E]

    def total(self, tokens: list[str], found: list[tuple[int, int, float, float]] | None = None) -> float:
        """The sum over significant segments of their scores beyond what chance makes of a text so long, in nats."""
        return sum(-math.log(max(e, 1e-300)) for *_, e in (self.passages(tokens) if found is None else found))

    def probability(self, total: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.offset + self.slope * total))))


def _extreme(clean: list[tuple[int, float]]) -> tuple[float, float]:
    """(k, decay) that make the best segments (n tokens, score, 0 for none) of clean texts likeliest.

    A text of n tokens has its best segment at or under x with probability exp(-k n exp(-decay x)); one without a segment
    is known to be at or under 0 alone. For a given decay the best k has a closed form; the decay is found by trial.
    """
    n, x = (np.array(v, float) for v in zip(*clean, strict=True)) if clean else (np.ones(1), np.zeros(1))
    hit = x > 0
    if not hit.any():
        return 1 / (n.sum() + 1), 1.0

    def k_of(decay: float) -> float:
        return hit.sum() / ((n[hit] * np.exp(-decay * x[hit])).sum() + n[~hit].sum())

    def likelihood(decay: float) -> float:
        k = k_of(decay)
        tail = k * n * np.exp(-decay * x)
        return float((np.log(k * n[hit] * decay) - decay * x[hit]).sum() - tail.sum())

    decay = max(np.geomspace(0.05, 5, 200).tolist(), key=likelihood)
    return float(k_of(decay)), float(decay)


def _weighed(counts: DataFrame, toxic: Column, clean: Column, tokens: int) -> Model | None:
    """A model of the tokens and beginnings with the most certain log-odds; None without tokens of either class."""
    counts = counts.select("token", toxic.alias("toxic"), clean.alias("clean"))
    all_toxic, all_clean = (float(x or 0) for x in counts.where(~F.endswith("token", F.lit(STEM))).agg(F.sum("toxic"), F.sum("clean")).first())
    if not all_toxic or not all_clean:
        return None
    n = F.col("toxic") + F.col("clean")
    a = F.lit(PSEUDO) + F.lit(PRIOR / (all_toxic + all_clean)) * n
    yt, yc, share = F.col("toxic") + a, F.col("clean") + a, F.lit(all_toxic / (all_toxic + all_clean))
    odds = F.log(yt / (F.lit(all_toxic + PRIOR) - yt)) - F.log(yc / (F.lit(all_clean + PRIOR) - yc))
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    g = F.sqrt(F.greatest(F.lit(0.0), 2 * (part(F.col("toxic"), n * share) + part(F.col("clean"), n * (1 - share)))))
    counts = counts.where(n > 0).select("token", yc.alias("yc"), odds.alias("odds"), g.alias("g"))
    told = counts.where((F.col("g") >= LEAST_G) & (F.abs("odds") >= LEAST_ODDS)).orderBy(F.desc("g"), "token").limit(tokens).collect()
    scored = {r["token"]: max(-MOST, min(MOST, r["odds"])) for r in told}
    mean = sum(r["yc"] / (all_clean + PRIOR) * scored[r["token"]] for r in told if not r["token"].endswith(STEM))
    drift = LEAST_DRIFT + max(0.0, mean)  # clean text's mean score lies about so far below zero
    return Model({t: v - drift for t, v in scored.items()}, -drift)


def _unlike(rows: DataFrame) -> DataFrame:
    """The rows less most near copies, whose common words would pass for evidence: of those that share the least hash of
    their three-word shingles, under either of two hashes, the one with the smallest key stays."""
    least = lambda w, seed: F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2), F.lit(seed))))
    now = rows.withColumn("m", let(words(F.lower("text")), lambda w: F.struct(least(w, 1).alias("a"), least(w, 2).alias("b"))))
    for side in ("a", "b"):
        now = now.groupBy(F.col(f"m.{side}").alias("g")).agg(F.min_by(F.struct(*now.columns), "_k").alias("r")).select("r.*")
    return cut(now.select("text", "toxic", "half"))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", toxic: str = "toxic", train_docs: int = TRAIN_DOCS, tokens: int = TOKENS) -> Model:
    """Fits a model on labelled documents: at most train_docs of each class, all for the tokens' log-odds; a model of one half, tried on the other, gives the extreme-value parameters and the calibration.

    Near copies in the sample count once. labels holds key and toxic (0 or 1; other rows don't count, and of several rows for a key the largest does). The
    sample's labels, of bounded number, are sent to the executors; its texts are counted there. With no label of either
    class the model finds nothing and scores every text near 0.
    """
    small_batches(docs.sparkSession)
    marks = labels.where(F.col(toxic).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_label_key")).agg(F.max(toxic).alias("_toxic"))
    sizes = {r[0]: r[1] for r in marks.groupBy("_toxic").agg(F.count("*")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model()
    some = bounded(marks.where("_toxic = 1"), F.col("_label_key"), train_docs).unionByName(bounded(marks.where("_toxic = 0"), F.col("_label_key"), train_docs))
    half = F.pmod(F.xxhash64("_label_key", F.lit(7)), F.lit(2))
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("text")).join(F.broadcast(some), F.col("_k") == F.col("_label_key"))
    rows = _unlike(rows.select("_k", "text", F.col("_toxic").cast("int").alias("toxic"), half.cast("int").alias("half")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], Counter] = {(h, mark): Counter() for h in (0, 1) for mark in (0, 1)}

        def out() -> Iterator[pa.RecordBatch]:
            for h in (0, 1):
                clean, toxic = features(seen[h, 0]), features(seen[h, 1])
                names = sorted(clean.keys() | toxic.keys())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([h] * len(names), pa.int32()), pa.array([toxic[t] for t in names], pa.int64()), pa.array([clean[t] for t in names], pa.int64())], ["token", "half", "toxic", "clean"])
            for x in seen.values():
                x.clear()

        for batch in batches:
            marked, halved = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for at, texts in slices(batch.column(0)):
                for i, t in enumerate(texts, at):
                    seen[halved[i], marked[i]].update(set(tokens_of(t)))
                if sum(map(len, seen.values())) > 200_000:
                    yield from out()
        yield from out()

    sides = [F.sum(F.when(F.col("half") == h, F.col(c))).alias(f"{c}{h}") for h in (0, 1) for c in ("toxic", "clean")]
    counts = cut(rows.select("text", "toxic", "half").mapInArrow(count, "token string, half int, toxic long, clean long").groupBy("token").agg(*sides).na.fill(0))
    halves = [_weighed(counts, F.col("toxic0"), F.col("clean0"), tokens), _weighed(counts, F.col("toxic0") + F.col("toxic1"), F.col("clean0") + F.col("clean1"), tokens)]
    if None in halves:
        return Model()
    trial, model = halves
    fitted = docs.sparkSession.sparkContext.broadcast(trial)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, best, every = [], [], []
            for _, texts in slices(batch.column(0)):
                for t in texts:
                    words = tokens_of(t)
                    scores = [x for *_, x in segments(fitted.value.scores(words))] if words else []
                    n.append(len(words)), best.append(max(scores, default=0.0)), every.append(scores)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), pa.array(best, pa.float64()), pa.array(every, pa.list_(pa.float64()))], ["toxic", "n", "best", "every"])

    seen = rows.where("half = 1").select("text", "toxic").mapInArrow(measure, "toxic int, n long, best double, every array<double>").collect()  # at most 2 * train_docs rows
    fitted.destroy()
    trial.k, trial.decay = model.k, model.decay = _extreme([(r["n"], r["best"]) for r in seen if not r["toxic"] and r["n"]])
    weigh = (sizes[1] / max(1, sum(r["toxic"] for r in seen)), sizes[0] / max(1, sum(1 - r["toxic"] for r in seen)))
    x, y, w = [], [], []
    for r in seen:
        e = [model.k * r["n"] * math.exp(-model.decay * v) for v in r["every"]]
        x.append(sum(-math.log(max(v, 1e-300)) for v in e if v <= MAX_E)), y.append(r["toxic"]), w.append(weigh[0] if r["toxic"] else weigh[1])
    model.offset, model.slope = _logistic(np.array(x), np.array(y, float), np.array(w))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """(offset, slope) of a weighted logistic regression with a slight penalty, by Newton's method."""
    if not len(x) or y.min() == y.max():
        return -20.0, 0.0
    design, b = np.column_stack([np.ones_like(x), x]), np.zeros(2)
    w = w / w.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        grad = design.T @ (w * (y - p)) - 1e-3 * b
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


PASSAGES = "array<struct<start int, end int, score double, expected double>>"


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds toxicity (0 to 1), toxic (1 if that is THRESHOLD or more) and passages: every significant segment, in words (\\w+) of the text.

    Columns that docs has already get underscores before their names. Null text counts as empty: no passage, the
    probability of a text without one. Texts of any length are read whole; rows alike get the same answer.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(f"struct<toxicity double, passages {PASSAGES}>")
    def of(texts: pa.Array) -> pa.Array:
        m = sent.value
        found, p = [], []
        for _, some in slices(texts):
            for t in some:
                x = m.passages(tokens_of(t))
                found.append([{"start": a, "end": b, "score": s, "expected": e} for a, b, s, e in x])
                p.append(m.probability(m.total([], x)))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array(p, pa.float64()), pa.array(found, kind)], ["toxicity", "passages"])

    out = docs.select(row_of(docs), of(F.col(text)).alias("found"))
    made = {"toxicity": F.col("found.toxicity"), "toxic": (F.col("found.toxicity") >= THRESHOLD).cast("int"), "passages": F.col("found.passages")}
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns], *[c.alias(fold(name, docs.columns)) for name, c in made.items()])
