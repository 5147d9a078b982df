"""SentencePiece segmentations sampled by forward filtering and backward sampling over the piece lattice, and lossless decoding."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, small_batches
from .tokens import slices

#: Temperature of the pieces' log-probabilities, seed, and characters whose lattices are built at once (for 2^18, arrays of up to some 70 MB).
ALPHA, SEED, RUN = 1.0, 0, 1 << 18
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Bits of a code point, and what stands where a part has no further character.
POINT, NONE = 21, (1 << 21) - 1
_LATTICES: dict[tuple[str, float], Lattice] = {}


class Lookup:
    """Small integers by 64-bit keys of 0 or more, for whole arrays at once; -1 for a key that isn't there."""

    def __init__(self, items: dict[int, int]) -> None:
        bits = max(4, (4 * len(items)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys, values = np.array(list(items.keys()), np.int64), np.array(list(items.values()), np.int32)
        at = self._place(keys)
        while len(keys):  # one of the keys that want a free place gets it, the others try the next place
            free = self.keys[at] == -1
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            on = self.keys[at] != keys
            self.values[at[~on]] = values[~on]
            keys, values, at = keys[on], values[on], (at[on] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * MIX[0]) >> self.shift).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        found = self.keys[at]
        hit = found == keys
        out = np.where(hit, self.values[at], np.int32(-1))
        on = np.flatnonzero(~hit & (found != -1))
        at = at[on]
        while len(on):
            at = (at + 1) & self.mask
            found = self.keys[at]
            hit = found == keys[on]
            out[on[hit]] = self.values[at[hit]]
            further = ~hit & (found != -1)
            on, at = on[further], at[further]
        return out


class Table(NamedTuple):
    """Filtered lattices, ready to sample: from a node, the first of its edges from first on whose cum is over a random number is taken."""

    ends: np.ndarray  # each part's last node
    begins: int  # nodes below this one begin a part
    first: np.ndarray
    cum: np.ndarray
    ids: np.ndarray
    to: np.ndarray


class Lattice:
    """The piece lattices of texts, built for many texts at once.

    A text is cut wherever no piece holds the two characters at the cut, so its parts have lattices of their own; parts
    that occur more than once share one. A lattice has a node for each place between characters. Filtering forward gives
    each node the log of the summed weight of all paths to it, so that parts of any length neither underflow nor need
    cutting; sampling backward draws, at each node, one of the pieces that end there in proportion to its weight and
    that of the paths to its start.

    A model whose scores are log-probabilities is used as it is; a merge-rank model gives piece r of its normal pieces,
    in order, the log-probability -log(r + 2). Characters without a piece are spelled by byte pieces.
    """

    def __init__(self, path: str, alpha: float = ALPHA) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = [float(model.get_score(i)) for i in normal]
        ranked = all(s.is_integer() for s in scores)
        logs = [alpha * (-np.log(r + 2) if ranked else s) for r, s in enumerate(scores)]
        self.rare = -alpha * np.log(n + 2) if ranked else min(logs) - 10 * alpha  # of each byte of a spelled character
        self.pieces = {model.id_to_piece(i).replace("▁", " "): (i, w) for i, w in zip(normal, logs, strict=True)}
        self.bytes = np.full(256, model.unk_id(), np.int32)
        self.spelling = np.array([b""] * n, object)
        for s, (i, _) in self.pieces.items():
            self.spelling[i] = s.encode()
        for i in range(n):
            if model.is_byte(i):
                b = int(model.id_to_piece(i)[3:5], 16)
                self.bytes[b], self.spelling[i] = i, bytes([b])
        self.dtype = np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")
        state: dict[str, int] = {}
        for s in self.pieces:
            for k in range(1, len(s) + 1):
                state.setdefault(s[:k], len(state))
        self.one = np.full(1 << POINT, -1, np.int32)  # state after a first character
        self.after = Lookup({state[s[:-1]] << POINT | ord(s[-1]): i for s, i in state.items() if len(s) > 1})
        self.joined = Lookup({ord(s[k]) << POINT | ord(s[k + 1]): 1 for s in self.pieces for k in range(len(s) - 1)})
        self.id, self.log = np.full(len(state), -1, np.int32), np.zeros(len(state))
        for s, i in state.items():
            if len(s) == 1:
                self.one[ord(s)] = i
            if s in self.pieces:
                self.id[i], self.log[i] = self.pieces[s]
        self.power = self.inverse = np.ones(1, np.uint64)

    def cuts(self, points: np.ndarray) -> np.ndarray:
        """Whether a part begins at each character but the first."""
        return self.joined(points[:-1].astype(np.int64) << POINT | points[1:]) < 0

    def distinct(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(one of each set of equal parts, the place of each part's in that list). Found by hash, and compared character by character."""
        n = len(points)
        if len(self.power) <= n:
            bases = np.array([[0x9E3779B97F4A7C15], [pow(0x9E3779B97F4A7C15, -1, 1 << 64)]], np.uint64)
            self.power, self.inverse = np.cumprod(np.repeat(bases, n + 1, axis=1), axis=1, dtype=np.uint64) * bases[::-1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * self.power[:n], dtype=np.uint64)])
        hashes = _mixed((sums[starts + sizes] - sums[starts]) * self.inverse[starts])
        _, chosen, which = np.unique(hashes, return_index=True, return_inverse=True)
        moved = np.repeat(starts[chosen[which]] - starts, sizes) + np.arange(n)
        same = points[np.minimum(moved, n - 1)] == points
        odd = np.flatnonzero(~np.logical_and.reduceat(same, starts) | (sizes != sizes[chosen[which]]))
        which[odd] = len(chosen) + np.arange(len(odd))
        return np.concatenate([chosen, odd]), which

    def build(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Table:
        """The lattices of parts, filtered forward. Nodes are numbered by place, then by part, the longest part first."""
        order = np.argsort(-sizes, kind="stable")
        longest = int(sizes[order[0]])
        count = len(sizes) - np.searchsorted(sizes[order[::-1]], np.arange(longest + 2))  # parts with a node at each place
        off = np.concatenate([[0], np.cumsum(count)])
        n, begun = int(off[longest + 1]), starts[order]
        char = np.full(n, NONE, np.int64)
        for k in range(longest):
            char[off[k] : off[k] + count[k + 1]] = points[begun[: count[k + 1]] + k]
        place = np.repeat(np.arange(longest + 1), count[: longest + 1])
        src = np.flatnonzero(char != NONE)
        level = place[src] + 1
        dst = off[level] + src - off[level - 1]
        state = self.one[char[src]]
        bare = np.flatnonzero((state < 0) | (self.id[state] < 0))
        into, out_of, ids, logs = [dst[bare]], [src[bare]], [np.zeros(len(bare), np.int32)], [np.zeros(len(bare))]
        on = state >= 0
        while True:
            src, dst, level, state = src[on], dst[on], level[on], state[on]
            whole = np.flatnonzero(self.id[state] >= 0)
            into.append(dst[whole]), out_of.append(src[whole]), ids.append(self.id[state[whole]]), logs.append(self.log[state[whole]])
            if not len(dst):
                break
            state = self.after(state.astype(np.int64) << POINT | char[dst])
            on = state >= 0
            dst, level = np.where(on, off[np.minimum(level + 1, longest + 1)] + dst - off[level], 0), level + 1
        # spelled characters: their bytes, last to first, lead through nodes of their own
        walk, more_ids, more_to = [x.copy() for x in out_of], [], []
        if len(bare):
            code = char[out_of[0]]
            size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
            logs[0] = self.rare * size
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
            nth = [self.bytes[np.where(size == b + 1, lead | (code >> 6 * b), 0x80 | (code >> 6 * b & 63)) & 255] for b in range(4)]
            ids[0] = nth[0]
            behind, nodes = np.arange(len(bare)), n
            for b in range(1, 4):
                behind = behind[size[behind] > b]
                new = nodes + np.arange(len(behind))
                if b == 1:
                    walk[0][behind] = new
                else:
                    more_to[-1][size[last] > b] = new
                more_ids.append(nth[b][behind]), more_to.append(out_of[0][behind].copy())
                nodes, last = nodes + len(behind), behind
        many = np.bincount(np.concatenate(into), minlength=n)
        first = np.concatenate([[0], np.cumsum(many)])
        size = int(first[-1])
        free, e_src, e_log = first[:-1].copy(), np.empty(size, np.int64), np.empty(size)
        e_ids, e_to, cum = np.empty(size, np.int32), np.empty(size, np.int64), np.empty(size)
        for d, s, w, i, x in zip(into, out_of, walk, ids, logs, strict=True):
            slot = free[d]
            e_src[slot], e_to[slot], e_ids[slot], e_log[slot] = s, w, i, x
            free[d] += 1
        reach = np.zeros(n)
        for k in range(1, longest + 1):
            a, b = off[k], off[k + 1]
            at, edges, m = first[a:b] - first[a], slice(first[a], first[b]), many[a:b]
            x = reach[e_src[edges]] + e_log[edges]
            top = np.maximum.reduceat(x, at)
            x = np.exp(x - np.repeat(top, m))
            total = np.add.reduceat(x, at)
            reach[a:b] = top + np.log(total)
            x /= np.repeat(total, m)
            cum[edges] = np.cumsum(x)
            cum[edges] -= np.repeat(cum[edges][at] - x[at], m)
        cum[first[off[1] + 1 :] - 1] = 2.0
        ends = np.empty(len(sizes), np.int64)
        ends[order] = off[sizes[order]] + np.arange(len(sizes))
        extra = sum(len(x) for x in more_ids)
        return Table(ends, int(count[0]), np.concatenate([first[:-1], size + np.arange(extra)]), np.concatenate([cum, np.full(extra, 2.0)]), np.concatenate([e_ids, *more_ids]), np.concatenate([e_to, *more_to]))

    def draw(self, table: Table, node: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each part) of walks from node back to its part's start, with the random numbers of state."""
        total = len(node)
        part, parts, drawn, step = np.arange(total), [], [], 0
        while len(node):
            u = (_mixed(state + np.array([step], np.uint64) * MIX[1]) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = table.first[node]
            on = np.flatnonzero(u >= table.cum[edge])
            while len(on):
                edge[on] += 1
                on = on[u[on] >= table.cum[edge[on]]]
            parts.append(part), drawn.append(table.ids[edge].astype(self.dtype))
            node = table.to[edge]
            on = np.flatnonzero(node >= table.begins)
            node, part, state, step = node[on], part[on], state[on], step + 1
        many = np.zeros(total, np.int64)
        for p in parts:
            many[p] += 1
        # the steps run from each part's end to its start: later ones come first
        out, last = np.empty(int(many.sum()), self.dtype), np.cumsum(many) - 1
        for s, (p, got) in enumerate(zip(parts, drawn, strict=True)):
            out[last[p] - s] = got
        return out, many

    def sample(self, texts: list[str | None], seeds: list[int]) -> list[np.ndarray]:
        """Backward sampling: a segmentation of each text (ids), drawn with the random numbers of its seed alone."""
        full = [i for i, t in enumerate(texts) if t]
        out = [np.zeros(0, self.dtype) for _ in texts]
        if not full:
            return out
        points = np.frombuffer("".join([f" {texts[i]}" for i in full]).encode("utf-32-le"), np.uint32)
        text_at = np.concatenate([[0], np.cumsum([len(texts[i]) + 1 for i in full])])
        begins = np.concatenate([[True], *[self.cuts(points[i : i + RUN + 1]) for i in range(0, len(points) - 1, RUN)]])
        begins[text_at[:-1]] = True
        starts = np.flatnonzero(begins)
        edges = np.append(starts, len(points))
        of = np.searchsorted(starts, text_at)  # each text's first part
        place = np.arange(len(starts)) - np.repeat(of[:-1], np.diff(of))
        state = _mixed(np.repeat(np.array([seeds[i] for i in full], np.int64).view(np.uint64), np.diff(of)) + (place.astype(np.uint64) + np.uint64(1)) * MIX[0])
        ids, many, a = [], [], 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + RUN)))
            some, at, sizes = points[edges[a] : edges[b]], starts[a:b] - starts[a], np.diff(edges[a : b + 1])
            chosen, which = self.distinct(some, at, sizes)
            table = self.build(some, at[chosen], sizes[chosen])
            got, n = self.draw(table, table.ends[which], state[a:b])
            ids.append(got), many.append(n)
            a = b
        drawn, upto = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(many))])[of]
        for i, a, b in zip(full, upto, upto[1:], strict=False):
            out[i] = drawn[a:b]
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.spelling[ids].tolist())[1:].decode() if len(ids) else ""


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that counters make random numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX[1]
        x = (x ^ (x >> np.uint64(27))) * MIX[2]
        return x ^ (x >> np.uint64(31))


def lattice(path: str, alpha: float) -> Lattice:
    if (path, alpha) not in _LATTICES:
        _LATTICES[path, alpha] = Lattice(path, alpha)
    return _LATTICES[path, alpha]


def sampled(text: Column, key: Column, model: str, alpha: float = ALPHA, seed: int = SEED) -> Column:
    """The text's sampled pieces as packed little-endian ids (16 bits if the vocabulary fits); null for null, none for an empty text.

    The draw depends on key, seed and text only: reruns, other partitions and repeated rows agree.
    """

    small_batches(SparkSession.active())

    @F.arrow_udf("binary")
    def of(texts: pa.Array, keys: pa.Array) -> pa.Array:
        own, seeds, out = lattice(model, alpha), keys.to_pylist(), []
        for at, some in slices(texts):
            made = own.sample([None if t is None else t.decode() for t in some], seeds[at : at + len(some)])
            out += [None if t is None else x.tobytes() for t, x in zip(some, made, strict=True)]
        return pa.array(out, pa.binary())

    return of(text, F.xxhash64(key, F.lit(seed)))


def decoded(ids: Column, model: str) -> Column:
    """The text that packed ids spell; null for null. decoded(sampled(text)) is text, whatever it holds."""

    small_batches(SparkSession.active())

    @F.arrow_udf("string")
    def of(packed: pa.Array) -> pa.Array:
        own = lattice(model, ALPHA)
        return pa.array([None if x is None else own.decode(np.frombuffer(x, own.dtype)) for x in packed.to_pylist()], pa.string())

    return of(ids)


def encode(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id", alpha: float = ALPHA, seed: int = SEED, name: str = "pieces") -> DataFrame:
    """Adds the sampled pieces of each text (binary; see sampled), under name or, if docs has that already, with underscores before it."""
    return docs.withColumn(fold(name, docs.columns), sampled(F.col(text), F.col(key), model, alpha, seed))
