"""Language identification: known words by their frequency in each language, unseen words by ever shorter character n-grams."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, row_of, small_batches
from .tokens import slices

UNKNOWN = "und"
#: Bounds of what is learned: labelled documents, words, n-grams of each length, and the longest n-gram.
TRAIN_DOCS, WORDS, GRAMS, LONGEST = 8_000, 60_000, 20_000, 5
#: Tokens whose vectors a worker keeps; words after which a longer text is no surer.
KEPT, SURE = 400_000, 30
_MODELS: dict[str, Identifier] = {}


def letter_runs(token: str) -> list[str]:
    """The runs of letters in a lower-cased token."""
    return [token] if token.isalpha() else "".join(c if c.isalpha() else " " for c in token).split()


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word between marks of its start and end."""
    w = f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def bounded(rows: DataFrame, key: Column, bound: int, seed: int = 0) -> DataFrame:
    """All rows, or about bound of them with the smallest hash of key if there are more; never more than bound.

    Rows that share the hash at the edge, as a key with very many rows makes them, are taken up to what is left.
    """
    h = F.xxhash64(key, F.lit(seed))
    n = rows.count()
    if n <= bound:
        return rows
    # 1.2 times the share leaves a few more rows than the bound for the exact cut among hashes alone
    share = min(1.0, 1.2 * bound / n + 1e-4)
    near = rows.select(h.alias("h")).where(F.col("h") <= F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))))
    top = cut(near.orderBy("h").limit(bound + 1))
    edge, under = top.agg(F.max("h"), F.count("*")).first()
    if edge is None:  # every row's hash lies beyond: all have a few keys
        return rows.limit(bound)
    if under <= bound:
        return rows.where(h <= F.lit(edge))
    under = top.where(F.col("h") < F.lit(edge)).count()
    some = rows.where(h < F.lit(edge))
    return some if under >= bound // 2 else some.unionByName(rows.where(h == F.lit(edge)).limit(bound - under))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train_docs: int = TRAIN_DOCS, words: int = WORDS, n_grams: int = GRAMS, longest: int = LONGEST) -> dict:
    """Counts of words and n-grams by language in the labelled rows (a bounded sample of train_docs of them).

    Counting is distributed; the commonest words and n-grams, at most words + longest * n_grams, come to the driver.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = bounded(rows, F.col(key), train_docs).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            flat = []
            for language, counts in seen.items():
                made: Counter = Counter()
                for w, n in counts.items():
                    for size in range(1, longest + 1):
                        for g in grams(w, size):
                            made[size, g] += n
                flat += [(language, 0, w, n) for w, n in counts.items()] + [(language, size, g, n) for (size, g), n in made.items()]
            columns = list(zip(*flat, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "size", "gram", "n"])

        for batch in batches:
            languages = batch.column(0).to_pylist()
            for at, texts in slices(batch.column(1)):
                for language, t in zip(islice(languages, at, None), texts, strict=False):
                    own = seen.setdefault(language, Counter())
                    for token, n in Counter(t.decode().lower().split()).items():
                        for w in letter_runs(token):
                            own[w] += n
                if sum(map(len, seen.values())) > 100_000:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    counts = rows.mapInArrow(count, "lang string, size int, gram string, n long").groupBy("size", "gram", "lang").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    total = counts.groupBy("size", "gram").agg(F.sum("n").alias("total"))
    top = total.where("size = 0").orderBy(F.desc("total"), "gram").limit(words)
    for size in range(1, longest + 1):
        top = top.unionByName(total.where(F.col("size") == size).orderBy(F.desc("total"), "gram").limit(n_grams))
    by: dict[tuple[int, str], dict[str, int]] = {}
    for r in counts.join(F.broadcast(top.select("size", "gram")), ["size", "gram"]).collect():  # as many grams at most, by language
        by.setdefault((r["size"], r["gram"]), {})[r["lang"]] = r["n"]
    kept = [(size, gram, counted) for (size, gram), counted in by.items()]
    return {"id": uuid.uuid4().hex, "langs": sorted({x for _, _, c in kept for x in c}), "kept": sorted(kept, key=lambda x: x[:2]), "longest": longest}


class Identifier:
    """Scores texts with what learn gave."""

    def __init__(self, told: dict) -> None:
        self.langs, self.longest = told["langs"], told["longest"]
        place = {x: i for i, x in enumerate(self.langs)}
        sizes = told["longest"] + 1
        counts = np.full((len(told["kept"]), len(self.langs)), 0.5)  # so that no word rules a language out
        size_of = np.array([size for size, _, _ in told["kept"]], int)
        self.index: list[dict[str, int]] = [{} for _ in range(sizes)]
        for row, (size, gram, by) in enumerate(told["kept"]):
            self.index[size][gram] = row
            for x, n in by.items():
                counts[row, place[x]] += n
        for size in range(sizes):
            if len(own := np.flatnonzero(size_of == size)):
                counts[own] /= counts[own].sum(axis=0)
        self.logs = np.log(counts)
        self.memo: dict[str, int] = {}
        self.vectors = np.zeros((1024, len(self.langs)))
        self.letters = np.zeros(1024, np.int64)

    def word(self, w: str) -> np.ndarray:
        """A word's log frequency in each language; of an unseen word, the mean over its longest n-grams that are known."""
        if (row := self.index[0].get(w)) is not None:
            return self.logs[row]
        for n in range(min(self.longest, len(w) + 2), 0, -1):
            index = self.index[n]
            if known := [index[g] for g in grams(w, n) if g in index]:
                return np.add.reduce(self.logs[known]) / len(known)
        return np.zeros(len(self.langs))

    def _place(self, token: str) -> int:
        runs = letter_runs(token)
        at = self.memo[token] = len(self.memo)
        if at == len(self.vectors):
            self.vectors, self.letters = np.vstack([self.vectors, np.zeros_like(self.vectors)]), np.concatenate([self.letters, np.zeros_like(self.letters)])
        self.vectors[at] = self.word(runs[0]) if len(runs) == 1 else sum(map(self.word, runs), np.zeros(len(self.langs)))
        self.letters[at] = len(runs)
        return at

    def tell(self, text: bytes | None) -> tuple[str, float]:
        """(language, its share of the likelihood); und and 0 without letters."""
        tokens = text.decode().lower().split() if text else []
        if len(self.memo) > KEPT:
            self.memo.clear()
        get, place = self.memo.get, self._place
        at = np.array([i if (i := get(t)) is not None else place(t) for t in tokens], np.int64)
        n = int(self.letters[at].sum()) if len(at) else 0
        if not n or not self.langs:
            return UNKNOWN, 0.0
        total = self.vectors[at].sum(axis=0) * (min(n, SURE) / n)
        share = np.exp(total - total.max())
        best = int(share.argmax())
        return self.langs[best], float(share[best] / share.sum())


def identify(docs: DataFrame, told: dict, text: str = "text", prefix: str = "lang_") -> DataFrame:
    """Adds <prefix>pred and score to docs, with underscores before them if docs has such columns.

    Texts of any length are read whole; rows alike get the same answer, and of languages that tie the first by name does.
    Null text and text without a letter: und, score 0. Texts of unknown letters only: the first of the languages, by name.
    With nothing learned every text is und. The model, of bounded size, is sent to each executor once.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(told)

    @F.arrow_udf("struct<pred string, score double>")
    def of(texts: pa.Array) -> pa.Array:
        key = sent.value["id"]
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = Identifier(sent.value)
        found = [_MODELS[key].tell(t) for _, some in slices(texts) for t in some]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["pred", "score"])

    out = docs.select(row_of(docs), of(F.col(text)).alias("told"))
    made = [F.col(f"told.{c}").alias(fold(name, docs.columns)) for c, name in (("pred", f"{prefix}pred"), ("score", "score"))]
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns], *made)
