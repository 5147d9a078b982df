"""SimHash near-duplicates: fingerprints, deletion-variant signatures, verified links and their components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, drop_stash, row_of, small_batches, stash
from .tokens import slices

WIDTH = 64
#: Words in a shingle, bits that linked fingerprints may differ in, seed of the shingles' hash.
SHINGLE, MAX_BITS, SEED = 3, 2, 42
#: Fingerprints under one signature that are still paired with one another; larger groups are linked by stars.
PAIRED = 64
#: Shingles hashed at once, to bound memory on long texts.
RUN = 1 << 16
#: For links by similarity: words in a shingle, least similarity, 64-bit words of a fingerprint, bits within which texts surely
#: share a signature (9: five segments), and bits in which texts so alike differ at most (about a sixth of all on average).
LIKE_SHINGLE, ALIKE, PARTS, SURE_BITS, APART = 5, 0.8, 2, 9, 40


def fingerprint_of(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The text's fingerprint: bit b is set if over half of the shingles' XXH64 have it. Zero for a text without words."""
    return majority(shingle_hashes(text.lower().split() if text else [], shingle, seed))


def shingle_hashes(w: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole sequence if it is shorter, of none without words."""
    parts: Iterable = zip(*[w[i:] for i in range(shingle)], strict=False) if len(w) >= shingle else [w] if w else []
    join, h = b" ".join, xxhash.xxh64_intdigest
    return np.array([h(join(p), seed) for p in parts], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed integer."""
    ones = np.zeros(WIDTH, np.int64)
    for i in range(0, len(hashes), RUN):
        bits = np.unpackbits(hashes[i : i + RUN].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint as a signed 64-bit integer; A-Z count as a-z; null counts as empty."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t, shingle, seed) for _, some in slices(texts) for t in some], pa.int64())

    return of(text)


def bounds(max_bits: int, width: int = WIDTH) -> list[tuple[int, int]]:
    """(first bit, bits) of the segments: so few that of two fingerprints max_bits apart one segment differs by one bit at most."""
    n = max(2, (max_bits + 2) // 2)
    cuts = [round(i * width / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def segments(words: list[Column], max_bits: int) -> list[tuple[int, int, Column]]:
    """(number, bits, value) of each segment of a fingerprint of 64-bit words."""
    made = []
    for s, (at, width) in enumerate(bounds(max_bits, WIDTH * len(words))):
        word, first = divmod(at, WIDTH)
        part = F.shiftrightunsigned(words[word], first)
        if first + width > WIDTH:
            part = part.bitwiseOR(F.shiftleft(words[word + 1], WIDTH - first))
        made.append((s, width, part.bitwiseAND(F.lit((1 << width) - 1))))
    return made


def signatures(words: list[Column], max_bits: int) -> Column:
    """The one-wildcard variants of each segment of a fingerprint of 64-bit words: segment number, place of the wildcard and the other bits, in a long."""
    return F.array(*[part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << p))).bitwiseOR(F.lit((s << 38) | (p << 32))) for s, width, part in segments(words, max_bits) for p in range(width)])


def marked(rows: DataFrame, words: list[Column], max_bits: int, *columns: str) -> DataFrame:
    """(columns, k, bit): a row for each signature k of each fingerprint, with the bit at k's wildcard."""
    parts = F.array(*[F.struct(F.lit(s << 38).alias("s"), F.lit(width).alias("width"), part.alias("v")) for s, width, part in segments(words, max_bits)])
    rows = rows.select(*columns, F.explode(parts).alias("part")).select(*columns, "part", F.explode(F.sequence(F.lit(0), F.col("part.width") - 1)).alias("p"))
    v, one = F.col("part.v"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p"))
    k = v.bitwiseAND(F.bitwise_not(one)).bitwiseOR(F.col("part.s")).bitwiseOR(F.shiftleft(F.col("p").cast("long"), 32))
    return rows.select(*columns, k.alias("k"), (v.bitwiseAND(one) != 0).alias("bit"))


def contested(rows: DataFrame) -> DataFrame:
    """(k, lo, n): the signatures of rows (c, k, bit) that several components c share and need for it: the least of them and the rows.

    Fingerprints with a whole segment in common share a signature for each of its bits, and the first of these does for
    them; any other is needed only where both values of its bit occur. So it is exact, and a large group of near copies
    has a few signatures for each of its values.
    """
    of = rows.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n"), (F.min("bit") != F.max("bit")).alias("both"))
    first = F.shiftright("k", 32).bitwiseAND(F.lit(63)) == 0
    return of.where((F.col("lo") != F.col("hi")) & (F.col("both") | first)).select("k", "lo", "n")


def _found_here(x: list[Column], k: Column, max_bits: int) -> Column:
    """Whether two fingerprints that differ in the bits x are to be reported under their common signature k: the first segment that differs by one bit at most."""
    segment, place = F.shiftright(k, 38), F.shiftright(k, 32).bitwiseAND(F.lit(63))
    ok, earlier = F.lit(False), F.lit(True)
    for s, _, part in segments(x, max_bits):
        ok = ok | ((segment == s) & earlier & ((part != 0) | (place == 0)))
        earlier = earlier & (F.bit_count(part) > 1)
    return ok


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp that join all within max_bits of one another, directly or by others.

    Signatures with up to PAIRED fingerprints pair them, verify, and report a pair once. Fingerprints under a fuller
    signature, as large groups of near copies make, are linked exactly by stars instead: two of them within 2 bits share
    a value one bit from either, and all that share a value are within 2 bits, so each is joined to the least of them.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits: 0 to 2")
    sigs = fps.select("fp", F.explode(signatures([F.col("fp")], max_bits)).alias("k"))
    full = cut(sigs.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"))
    members = cut(sigs.join(full.where(F.col("n") <= PAIRED).select("k"), "k"))
    pairs = members.select("k", F.col("fp").alias("a")).join(members.select("k", F.col("fp").alias("b")), "k").where("a < b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    pairs = pairs.where((F.bit_count(x) <= max_bits) & _found_here([x], F.col("k"), max_bits)).select("a", "b")
    hot = cut(sigs.join(full.where(F.col("n") > PAIRED).select("k"), "k").select("fp").distinct())
    if max_bits < 2:  # values at one bit would link too much; those that are equal but for one given bit won't
        value = F.array(*[F.col("fp").bitwiseAND(F.lit(~(1 << p) if p < 63 else (1 << 63) - 1)) for p in range(WIDTH)]) if max_bits else F.array("fp")
        ball = hot.select("fp", F.posexplode(value).alias("p", "v"))
    else:
        value = F.array("fp", *[F.col("fp").bitwiseXOR(F.lit(1 << p if p < 63 else -(1 << 63))) for p in range(WIDTH)])
        ball = hot.select("fp", F.lit(0).alias("p"), F.explode(value).alias("v"))
    centre = ball.groupBy("p", "v").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = ball.join(centre, ["p", "v"]).where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(key, text_hash, fp, component, first_hash), one row a document: component is the smallest key reachable over links.

    Equal fingerprints are one node, so copies cost nothing past their fingerprint. Null text counts as empty; texts
    without words all have fingerprint zero and link like any other. Null keys take part but name a component only if
    it has no other; first_hash is the text hash of the component's first row by key (null last) and text hash. Rows
    alike are one. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    t = F.col(text)
    fps = cut(docs.select(F.col(key).alias("key"), F.xxhash64(t).alias("text_hash"), fingerprint(t, shingle).alias("fp")))
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "text_hash")).alias("first")
    nodes = cut(fps.groupBy("fp").agg(first))
    groups = connected_components(links(nodes.select("fp"), max_bits))
    nodes = nodes.join(groups, nodes.fp == groups.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("group"))
    heads = nodes.groupBy("group").agg(F.min("first").alias("head"))
    # cut, so that a fingerprint with very many copies leaves the last join with partitions that Spark may split
    named = cut(nodes.join(heads, "group").select("fp", F.col("head.key").alias("component"), F.col("head.text_hash").alias("first_hash")))
    return fps.join(named, "fp").select("key", "text_hash", "fp", "component", "first_hash")


def similar(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = LIKE_SHINGLE, alike: float = ALIKE, parts: int = PARTS, sure_bits: int = SURE_BITS, apart: int = APART) -> DataFrame:
    """(key, text_hash, node, component, first_hash), one row a document: component is the smallest key reachable over texts
    whose sets of shingles have at least alike of their union in common (Jaccard); first_hash as in near_duplicates.

    Fingerprints have parts times 64 bits, cut into so few segments that texts within sure_bits share a one-wildcard
    signature; of others a share that falls with the distance does. Everything that shares a signature and is
    within apart bits is a candidate, and every link is verified on the whole texts' sets. Texts are first compared with
    the least text that has a whole segment in common with them; then, under each signature, one text of each component
    with one of the least component; of texts that this leaves in different components, every pair under a signature is
    compared then. So a large group of copies that are all alike takes about one comparison and a few rows for each, and
    no link under a signature is lost.

    Texts with the same words in a row (A-Z as a-z) are one node. A text shorter than a shingle is one shingle; null and
    empty texts and those without words are one node without links. Null keys name a component only if it has no other.
    Rows alike in key and text are one. Shingles are compared by 32 bits of their hashes. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    names = ["key", "text_hash", "node", "fp", "sh"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(2)):
                node, fps, sets = [], [], []
                for t in texts:
                    w = t.lower().split() if t else []
                    h = shingle_hashes(w, shingle, SEED)
                    node.append(int(np.uint64(xxhash.xxh64_intdigest(b" ".join(w), SEED)).view(np.int64)))
                    fps.append([majority(h * np.uint64(2 * k + 1) ^ (h * np.uint64(2 * k + 1) >> np.uint64(29)) if k else h) for k in range(parts)])
                    sets.append(np.unique(h.astype(np.uint32)).view(np.int32))
                off = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(sets), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(texts)], batch.column(1)[at : at + len(texts)], pa.array(node, pa.int64()), pa.array(fps, pa.list_(pa.int64())), lists], names)

    tables = []

    def kept(df: DataFrame) -> DataFrame:
        table, at = stash(df)
        tables.append(at)
        return table

    parsed = kept(rows.mapInArrow(parse, f"key {kind}, text_hash long, node long, fp array<long>, sh array<int>"))
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "text_hash")).alias("first")
    nodes = kept(parsed.groupBy("node").agg(first, F.max("fp").alias("fp")))
    fp = [F.col("fp")[k] for k in range(parts)]
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def signed(of: DataFrame, *columns: str) -> DataFrame:
        """A row for each signature k of each node; as that is many, the nodes are dealt anew, so that no task has more of them than its memory holds."""
        return marked(of.repartition(width, "node"), fp, sure_bits, *columns)

    def near(a: Column, b: Column) -> Column:
        return sum(F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(parts)) <= apart

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are alike."""
        pairs = kept(pairs)
        used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        used = used.join(nodes.select("node", "first"), "node").select("node", "first.key", "first.text_hash")
        same = (F.col("p.node") == F.col("u.node")) & F.col("p.key").eqNullSafe(F.col("u.key")) & (F.col("p.text_hash") == F.col("u.text_hash"))
        sets = kept(parsed.alias("p").join(used.alias("u"), same).select("p.node", "p.sh").dropDuplicates(["node"]))
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("sh").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("sh").alias("y")), "b")
        both = both.select("a", "b", F.size("x").alias("m"), F.size("y").alias("n"), F.size(F.array_intersect("x", "y")).alias("c"))
        return kept(both.where((F.col("m") + F.col("n") > F.col("c")) & (F.col("c") >= alike * (F.col("m") + F.col("n") - F.col("c")))).select("a", "b"))

    def grouped(links: DataFrame) -> DataFrame:
        """(node, fp, c): the nodes and the component c of each, its smallest node."""
        return kept(nodes.select("node", "fp").join(connected_components(links).withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("node", "fp", F.coalesce("component", "node").alias("c")))

    def compared(members: DataFrame, links: DataFrame | None) -> DataFrame:
        """links and those between heads and nodes of members that are alike: first with one head a node, then with those still in other components."""
        heads = nodes.select(F.col("node").alias("head"), F.col("fp").alias("head_fp"))
        stars = members.select("head", "node").where("node <> head").distinct().join(heads, "head").join(nodes.select("node", "fp"), "node")
        stars = kept(stars.where(near(F.col("fp"), F.col("head_fp"))).select(F.col("head").alias("a"), F.col("node").alias("b")))
        found = verified(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        found = kept(links.union(found)) if links is not None else found
        of = connected_components(found)
        by_a, by_b = (of.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
        rest = stars.join(by_a, "a", "left").join(by_b, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        return kept(found.union(verified(rest.select("a", "b"))))

    # whole segments: a few rows a node
    whole = nodes.select("node", F.explode(F.array(*[part.bitwiseOR(F.lit(s << 38)) for s, _, part in segments(fp, sure_bits)])).alias("k"))
    heads = whole.groupBy("k").agg(F.min("node").alias("head"), F.max("node").alias("top")).where("head <> top")
    heads = kept(heads.select("k", "head"))  # a table, so that the join below may be split where a segment is very common
    links = compared(kept(whole.join(heads, "k")), None)
    # signatures that several components share: one node of each
    of = grouped(links)
    shared = kept(contested(signed(of, "c")))
    members = kept(signed(of, "node", "c").join(shared, "k").groupBy("k", "c", "lo", "n").agg(F.min("node").alias("node")))
    links = compared(members.where("c <> lo").join(members.where("c = lo").select("k", F.col("node").alias("head")), "k"), links)
    # signatures that several components share still: all nodes, but where both of two have been compared
    of = grouped(links)
    several = members.where("n > 2").join(of.select("node", F.col("c").alias("now")), "node").groupBy("k").agg(F.min("now").alias("lo"), F.max("now").alias("hi"))
    several = kept(several.where("lo <> hi").select("k"))
    apart_still = kept(signed(of, "node", "fp", "c").drop("bit").join(several, "k"))
    x, y = apart_still.select("k", F.struct("node", "fp", "c").alias("x")), apart_still.select("k", F.struct("node", "fp", "c").alias("y"))
    pairs = x.join(y, "k").where((F.col("x.node") < F.col("y.node")) & (F.col("x.c") != F.col("y.c")) & near(F.col("x.fp"), F.col("y.fp")))
    differ = [F.col("x.fp")[k].bitwiseXOR(F.col("y.fp")[k]) for k in range(parts)]
    pairs = pairs.where(_found_here(differ, F.col("k"), sure_bits))
    links = links.union(verified(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))))
    named = nodes.join(connected_components(links), "node", "left").select("node", "first", F.coalesce("component", "node").alias("group"))
    lead = named.groupBy("group").agg(F.min("first").alias("head"))
    named = kept(named.join(lead, "group").select("node", F.col("head.key").alias("component"), F.col("head.text_hash").alias("first_hash")))
    out, _ = stash(parsed.select("key", "text_hash", "node").join(named, "node").select("key", "text_hash", "node", "component", "first_hash"))
    for at in tables:
        drop_stash(spark, at)
    return out


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", found: DataFrame | None = None, **how) -> DataFrame:
    """The documents less all but the first of each component (smallest key, null last, then text hash), with docs' own columns; of rows alike one stays.

    found has the components: near_duplicates(docs, text, key, **how) unless given, as similar gives them.
    """
    found = near_duplicates(docs, text, key, **how) if found is None else found
    first = found.where(F.col("key").eqNullSafe(F.col("component")) & (F.col("text_hash") == F.col("first_hash")))
    first = cut(first.groupBy("key", "text_hash").agg(F.count("*").alias("n")).select(F.struct("*").alias("first")))
    hashed = docs.select(row_of(docs), F.xxhash64(F.col(text)).alias("hash"))
    same = F.col("row")[key].eqNullSafe(F.col("first.key")) & (F.col("hash") == F.col("first.text_hash"))
    out = hashed.join(first.where("first.n = 1"), same).select("row")
    if not first.where("first.n > 1").isEmpty():
        twice = hashed.join(first.where("first.n > 1"), same).select("row", F.col("row")[key].alias("key"), "hash")
        out = out.union(twice.dropDuplicates(["key", "hash"]).select("row"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
