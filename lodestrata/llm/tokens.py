"""Token ids as flat unsigned integer files with 64-bit document offsets, in key order, and their memory-mapped reader."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .common import small_batches

#: Words whose ids a Python worker keeps at most, and bytes of text that it splits at once.
CACHE_WORDS, SLICE_BYTES = 1_000_000, 1 << 20

_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Encodes texts as their tokenizer does, keeping the ids of the words it has met.

    Only for a tokenizer that drops white space and never joins pieces over it, as its pre-tokenizer's pattern must show:
    a text's ids are then its words' ids in turn. ASCII texts are lower-cased first if the tokenizer's normalizer does.
    """

    PLAIN = re.compile(rb"([a-z]+)([.,;:!?]*)\Z")

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)  # for words that the pattern keeps in one piece
        self.bare.normalizer, self.bare.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        kinds = [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [told["normalizer"] or {"type": ""}])]
        self.lower = "Lowercase" in kinds
        self.by_word = r"[\p{L}]+" in json.dumps(told["pre_tokenizer"]).replace("\\\\", "\\") and told["pre_tokenizer"]["pretokenizers"][0].get("behavior") == "Removed"
        mark = told["model"].get("end_of_word_suffix")
        self.by_word = self.by_word and bool(mark)
        self.ends = np.zeros(self.full.get_vocab_size(), bool)
        self.ends[[i for piece, i in self.full.get_vocab().items() if mark and piece.endswith(mark)]] = True
        self.dtype = np.dtype("<u2") if self.full.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.seen: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: Iterable[bytes]) -> None:
        plain, rest = {}, []
        for w in new:
            if self.lower and (m := self.PLAIN.match(w)):
                plain[w] = m.groups()
            else:
                rest.append(w)
        self.seen.update(zip(rest, self._ids([w.decode() for w in rest]), strict=True))
        if not plain:
            return
        every, ends = {s for s, _ in plain.values()}, sorted({e for _, e in plain.values()})
        end_ids = dict(zip(ends, self._ids([e.decode() for e in ends]), strict=True))
        stem_ids = {s: self.seen[s] for s in every & self.seen.keys()}
        stems = sorted(every.difference(stem_ids))
        for i in range(0, len(stems), 20_000):
            some = stems[i : i + 20_000]
            e = self.bare.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0]
            ids = np.array(e.ids, self.dtype)
            starts = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]  # each word's last piece is marked as such
            raw, size = ids.tobytes(), self.dtype.itemsize
            stem_ids.update((s, raw[starts[k] * size : starts[k + 1] * size]) for k, s in enumerate(some))
        self.seen.update((w, stem_ids[s] + end_ids[e]) for w, (s, e) in plain.items())

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text as little-endian integers; none for null."""
        if not self.by_word:
            return self._ids([(t or b"").decode() for t in texts])
        split = [(t.lower() if self.lower and t.isascii() and b"<|" not in t else t).split() if t else [] for t in texts]
        new = set().union(*split).difference(self.seen)
        if len(self.seen) + len(new) > CACHE_WORDS:
            self.seen.clear()
            new = set().union(*split)
        if new:
            self._learn(new)
        get = self.seen.__getitem__
        return [b"".join(map(get, w)) for w in split]


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def slices(texts: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    """(start, texts as bytes) in runs of about SLICE_BYTES."""
    texts = texts.cast(pa.binary())
    lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(lengths, dtype=np.int64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)] if len(texts) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield a, texts[a:b].to_pylist()


SHARD = "shard int, docs long, null_keys long, tokens long"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int | None = None, text: str = "text", key: str = "doc_id", shards: int | None = None, folder: str | None = None) -> str:
    """Writes the ids of all whole texts in ascending key order and returns the folder's URI.

    Shard s holds s.ids (flat little-endian unsigned integers, 16 bits if the vocabulary fits), s.off (documents + 1
    unsigned 64-bit offsets into it, in ids) and s.key (signed 64-bit keys; those of the first null_keys documents are
    null). manifest.json has each shard's documents and ids and their bases over all shards, from prefix sums over one
    row a shard. Null text: no ids but end_id. Null keys come first; equal keys by the text's hash. Rows alike may stand
    in either order. An empty table gives a manifest without shards. Only key and text are read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or storage.new_folder(spark, "tokens")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("key").asc_nulls_first(), F.col("h"), F.col("row")]
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id()).select("shard", "key", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        enc = encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        shard = first.column(0)[0].as_py()
        at = f"{folder}/{shard:06d}"
        n_docs = n_null = n_ids = 0
        with storage.written(f"{at}.ids") as ids, storage.written(f"{at}.off") as off, storage.written(f"{at}.key") as keys:
            off.write(np.zeros(1, "<u8").tobytes())
            for batch in (b for group in ([first], batches) for b in group):
                k = batch.column(1)
                n_null += k.null_count
                keys.write(k.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                for _, texts in slices(batch.column(2)):
                    coded = [x + end for x in enc.encode(texts)]
                    upto = n_ids + np.cumsum([len(x) // enc.dtype.itemsize for x in coded], dtype=np.int64)
                    off.write(upto.astype("<u8").tobytes())
                    ids.write(b"".join(coded))
                    n_ids = int(upto[-1])
                n_docs += batch.num_rows
        yield pa.RecordBatch.from_pylist([{"shard": shard, "docs": n_docs, "null_keys": n_null, "tokens": n_ids}], schema=pa.schema([("shard", pa.int32()), ("docs", pa.int64()), ("null_keys", pa.int64()), ("tokens", pa.int64())]))

    told = sorted(tuple(r) for r in dealt.mapInArrow(write, SHARD).collect())  # a row a shard
    base_docs = base_ids = 0
    listed = []
    for shard, n_docs, n_null, n_ids in told:
        listed.append({"shard": shard, "docs": n_docs, "null_keys": n_null, "tokens": n_ids, "first_doc": base_docs, "first_token": base_ids})
        base_docs, base_ids = base_docs + n_docs, base_ids + n_ids
    with storage.written(f"{folder}/manifest.json") as out:
        out.write(json.dumps({"id_bytes": encoder(tokenizer).dtype.itemsize, "end_id": end_id, "docs": base_docs, "tokens": base_ids, "shards": listed}).encode())
    return folder


DOCS = "key long, start long, n_tokens long, ids binary"


def manifest(folder: str) -> dict:
    return json.loads(storage.mapped(f"{folder}/manifest.json").to_pybytes())


def read_tokens(spark: SparkSession, folder: str, schema: str = DOCS, row=None) -> DataFrame:
    """A row for each document: key, start (ids before it in all shards), n_tokens, ids (as stored), or what row makes of these.

    row(ids) turns a document's ids, a view of the mapped file, into the values that follow n_tokens in schema.
    """
    told = manifest(folder)
    if not told["shards"]:
        return spark.createDataFrame([], schema)
    kind = f"<u{told['id_bytes']}"
    make = row or (lambda x: (x.tobytes(),))
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    listed = spark.createDataFrame([(s["shard"], s["docs"], s["null_keys"], s["first_token"]) for s in told["shards"]], "shard int, docs long, null_keys long, first_token long").repartition(len(told["shards"]))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in (x for b in batches for x in b.to_pylist()):
            at = f"{folder}/{s['shard']:06d}"
            ids = np.frombuffer(storage.mapped(f"{at}.ids"), kind)
            off = np.frombuffer(storage.mapped(f"{at}.off"), "<u8").astype(np.int64)
            keys = np.frombuffer(storage.mapped(f"{at}.key"), "<i8")
            for a in range(0, s["docs"], 2000):
                b = min(a + 2000, s["docs"])
                more = zip(*[make(ids[off[i] : off[i + 1]]) for i in range(a, b)], strict=True)
                known = np.arange(a, b) < s["null_keys"]
                columns = [pa.array(keys[a:b], pa.int64(), mask=known), pa.array(off[a:b] + s["first_token"]), pa.array(np.diff(off[a : b + 1])), *map(pa.array, map(list, more))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return listed.mapInArrow(load, schema)


def digest(ids: np.ndarray) -> tuple[int]:
    """CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return (zlib.crc32(ids.astype("<u4").tobytes()),)
