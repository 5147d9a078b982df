"""The adaptive binary range coder and the block coefficient coder over it.

Each block's bits depend on all before them, but blocks don't depend on one another: contexts start anew with each. So
many blocks of a batch are coded side by side inside Arrow functions, a bit of each block in one array step. Encoder and
Decoder code one stream a bit at a time, to the same bytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from lodestrata.operators.training import BUCKETS, EVEN, MAGNITUDES, ONE, PRIORS

#: Fixed values of the format.
PROB_BITS, ADAPT, TOP, MASK32 = 11, 4, 1 << 24, 0xFFFFFFFF
LONGEST_PREFIX = 31


class Encoder:
    """Bits to bytes. A context is a place in a list of chances of 0."""

    def __init__(self) -> None:
        self.low, self.range, self.cache, self.held = 0, MASK32, 0, 1
        self.out = bytearray()

    def bit(self, contexts: list[int], at: int, bit: int) -> None:
        p = contexts[at]
        bound = (self.range >> PROB_BITS) * p
        if bit:
            self.low += bound
            self.range -= bound
            contexts[at] = p - (p >> ADAPT)
        else:
            self.range = bound
            contexts[at] = p + (((1 << PROB_BITS) - p) >> ADAPT)
        self._settle()

    def even(self, bit: int) -> None:
        """A bit that is as likely 0 as 1."""
        self.range >>= 1
        if bit:
            self.low += self.range
        self._settle()

    def _settle(self) -> None:
        while self.range < TOP:
            self._byte()
            self.range = (self.range << 8) & MASK32

    def _byte(self) -> None:
        """Passes on the top byte, held back while a carry could still change it."""
        if self.low > MASK32 or self.low < 0xFF000000:
            carry = self.low >> 32
            self.out.append((self.cache + carry) & 0xFF)
            self.out += bytes([(0xFF + carry) & 0xFF]) * (self.held - 1)
            self.held, self.cache = 0, (self.low >> 24) & 0xFF
        self.held += 1
        self.low = (self.low << 8) & MASK32

    def finish(self) -> bytes:
        for _ in range(5):
            self._byte()
        return bytes(self.out)


class Decoder:
    """Bytes to bits; past the end of the bytes it reads zeros, so any input decodes to something."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.range, self.code = data, 5, MASK32, int.from_bytes(data[1:5].ljust(4, b"\0"), "big")

    def _settle(self) -> None:
        while self.range < TOP:
            byte = self.data[self.at] if self.at < len(self.data) else 0
            self.code, self.range, self.at = ((self.code << 8) | byte) & MASK32, (self.range << 8) & MASK32, self.at + 1

    def bit(self, contexts: list[int], at: int) -> int:
        p = contexts[at]
        bound = (self.range >> PROB_BITS) * p
        if self.code < bound:
            self.range, bit = bound, 0
            contexts[at] = p + (((1 << PROB_BITS) - p) >> ADAPT)
        else:
            self.code, self.range, bit = self.code - bound, self.range - bound, 1
            contexts[at] = p - (p >> ADAPT)
        self._settle()
        return bit

    def even(self) -> int:
        self.range >>= 1
        bit = int(self.code >= self.range)
        if bit:
            self.code -= self.range
        self._settle()
        return bit


def encode_bits(bits: bytes | list[int]) -> bytes:
    """Bits under one context."""
    coder, context = Encoder(), [EVEN]
    for b in bits:
        coder.bit(context, 0, 1 if b else 0)
    return coder.finish()


def decode_bits(data: bytes, n: int) -> list[int]:
    coder, context = Decoder(data), [EVEN]
    return [coder.bit(context, 0) for _ in range(n)]


@lru_cache
def order(n: int, rank: int) -> tuple[np.ndarray, list[int]]:
    """(linear places in scan order, bucket of each scan place) of a block."""
    lin = np.arange(n**rank)
    band = sum((lin // n**a) % n for a in range(rank))
    at = np.lexsort((lin, band))
    return at, (band[at] * BUCKETS // (rank * (n - 1) + 1)).tolist()


def encode_indices(indices: np.ndarray, n: int, rank: int, priors: tuple[int, ...] = PRIORS) -> bytes:
    """A block's quantised coefficients: for each scan place whether it is set, and if so its sign, its size and whether more follow."""
    at, buckets = order(n, rank)
    values = np.asarray(indices).ravel()[at].tolist()
    last = max((i for i, v in enumerate(values) if v), default=-1)
    coder, ctx = Encoder(), list(priors)
    for i, v in enumerate(values):
        coder.bit(ctx, buckets[i], int(v != 0))
        if not v:
            continue
        coder.even(int(v < 0))
        rest = abs(v) - 1
        width = rest.bit_length()
        for k in range(width):
            coder.bit(ctx, 2 * BUCKETS + min(k, MAGNITUDES - 1), 1)
        coder.bit(ctx, 2 * BUCKETS + min(width, MAGNITUDES - 1), 0)
        for k in reversed(range(width)):
            coder.even(rest >> k & 1)
        coder.bit(ctx, BUCKETS + buckets[i], int(i < last))
        if i >= last:
            break
    return coder.finish()


def decode_indices(data: bytes, n: int, rank: int, priors: tuple[int, ...] = PRIORS) -> np.ndarray:
    """The coefficients again; of bytes that no encoder made, some block."""
    at, buckets = order(n, rank)
    out = np.zeros(n**rank, np.int64)
    coder, ctx = Decoder(data), list(priors)
    for i, bucket in enumerate(buckets):
        if not coder.bit(ctx, bucket):
            continue
        negative, width, rest = coder.even(), 0, 0
        while width < LONGEST_PREFIX and coder.bit(ctx, 2 * BUCKETS + min(width, MAGNITUDES - 1)):
            width += 1
        for _ in range(width):
            rest = rest << 1 | coder.even()
        out[at[i]] = -(rest + 1) if negative else rest + 1
        if not coder.bit(ctx, BUCKETS + bucket):
            break
    return np.clip(out, -(1 << 31), (1 << 31) - 1)


def _adapted(p: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Chances of 0 after bits."""
    return np.where(bits, p - (p >> ADAPT), p + ((ONE - p) >> ADAPT))


class Encoders:
    """Many streams at once: each step codes a bit of every stream in lanes, under chances kept in one row for all streams."""

    def __init__(self, n: int) -> None:
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, MASK32, np.uint32)
        self.out, self.at, self.filled = np.zeros((n, 64), np.uint8), np.ones(n, np.int64), 1

    def bit(self, chances: np.ndarray, lanes: np.ndarray, bits: np.ndarray) -> None:
        here = _here(lanes, len(self.low))
        p, r = chances[here], self.range[here]
        bound = (r >> PROB_BITS) * p
        self.low[here] += bound * bits
        chances[here] = _adapted(p, bits)
        self._settle(lanes, np.where(bits, r - bound, bound))

    def even(self, lanes: np.ndarray, bits: np.ndarray) -> None:
        r = self.range[lanes] >> 1
        self.low[lanes] += r * bits
        self._settle(lanes, r)

    def _settle(self, lanes: np.ndarray, r: np.ndarray) -> None:
        while (short := np.flatnonzero(r < TOP)).size:
            r[short] <<= 8
            self._byte(lanes[short])
        self.range[_here(lanes, len(self.low))] = r

    def _byte(self, lanes: np.ndarray) -> None:
        """Writes the top bytes, after carrying into those that stand already."""
        low = self.low[lanes]
        carried = lanes[low > MASK32]
        place = self.at[carried] - 1
        while carried.size:
            self.out[carried, place] += 1
            full = self.out[carried, place] == 0
            carried, place = carried[full], place[full] - 1
        self.filled += 1
        if self.filled > self.out.shape[1]:
            self.filled = int(self.at.max()) + 1
            if self.filled > self.out.shape[1]:
                self.out = np.concatenate([self.out, np.zeros_like(self.out)], axis=1)
        self.out[lanes, self.at[lanes]] = (low >> 24) & 0xFF
        self.at[lanes] += 1
        self.low[lanes] = (low << 8) & MASK32

    def finish(self) -> list[bytes]:
        for _ in range(5):
            self._byte(np.arange(len(self.low)))
        return [row[: n - 1].tobytes() for row, n in zip(self.out, self.at.tolist(), strict=True)]


class Decoders:
    """Many streams at once, of one buffer; past its end a stream reads zeros."""

    def __init__(self, data: list[bytes]) -> None:
        sizes = np.array([len(d) for d in data], np.int64)
        self.end = np.cumsum(sizes)
        self.data = np.frombuffer(b"".join(data) + b"\0", np.uint8)
        self.at = self.end - sizes + 1
        self.range, self.code = np.full(len(data), MASK32, np.uint32), np.zeros(len(data), np.uint32)
        for _ in range(4):
            self.code = self.code << 8 | self._next(np.arange(len(data)))

    def _next(self, lanes: np.ndarray) -> np.ndarray:
        at = self.at[lanes]
        self.at[lanes] += 1
        return self.data[np.where(at < self.end[lanes], at, len(self.data) - 1)].astype(np.uint32)

    def bit(self, chances: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        here = _here(lanes, len(self.code))
        p, r, code = chances[here], self.range[here], self.code[here]
        bound = (r >> PROB_BITS) * p
        bits = code >= bound
        chances[here] = _adapted(p, bits)
        self._settle(lanes, np.where(bits, r - bound, bound), code - bound * bits)
        return bits

    def even(self, lanes: np.ndarray) -> np.ndarray:
        r, code = self.range[lanes] >> 1, self.code[lanes]
        bits = code >= r
        self._settle(lanes, r, code - r * bits)
        return bits

    def _settle(self, lanes: np.ndarray, r: np.ndarray, code: np.ndarray) -> None:
        while (short := np.flatnonzero(r < TOP)).size:
            r[short] <<= 8
            code[short] = code[short] << 8 | self._next(lanes[short])
        here = _here(lanes, len(self.code))
        self.range[here], self.code[here] = r, code


def _here(lanes: np.ndarray, n: int) -> np.ndarray | slice:
    """All lanes as a slice: views cost less than gathering."""
    return slice(None) if len(lanes) == n else lanes


def encode_bit_rows(bits: np.ndarray) -> list[bytes]:
    """encode_bits of each row."""
    coder, lanes = Encoders(len(bits)), np.arange(len(bits))
    chances = np.full(len(bits), EVEN, np.uint32)
    for column in np.ascontiguousarray(np.asarray(bits, bool).T):
        coder.bit(chances, lanes, column)
    return coder.finish()


def decode_bit_rows(data: list[bytes], n: int) -> np.ndarray:
    """decode_bits of each stream, a row each."""
    coder, lanes = Decoders(data), np.arange(len(data))
    chances = np.full(len(data), EVEN, np.uint32)
    out = np.empty((n, len(data)), bool)
    for i in range(n):
        out[i] = coder.bit(chances, lanes)
    return out.T


def encode_index_rows(indices: np.ndarray, n: int, rank: int, priors: tuple[int, ...] = PRIORS) -> list[bytes]:
    """encode_indices of each row: all blocks pass a scan place together, and leave after their last coefficient."""
    at, buckets = order(n, rank)
    values = np.asarray(indices, np.int64).reshape(len(indices), -1)[:, at].T
    coder, ctx = Encoders(values.shape[1]), np.tile(np.array(priors, np.uint32)[:, None], values.shape[1])
    put = values != 0
    last = np.where(put.any(axis=0), len(at) - 1 - np.argmax(put[::-1], axis=0), -1)
    lanes = np.arange(values.shape[1])
    for i, bucket in enumerate(buckets):
        coder.bit(ctx[bucket], lanes, put[i, lanes])
        some = lanes[put[i, lanes]]
        if not some.size:
            continue
        v = values[i, some]
        coder.even(some, v < 0)
        rest = np.abs(v) - 1
        width = np.frexp(rest.astype(float))[1]
        widest = int(width.max())
        for k in range(widest + 1):
            here = width >= k
            coder.bit(ctx[2 * BUCKETS + min(k, MAGNITUDES - 1)], some[here], width[here] > k)
        for k in reversed(range(widest)):
            here = width > k
            coder.even(some[here], (rest[here] >> k & 1).astype(bool))
        more = last[some] > i
        coder.bit(ctx[BUCKETS + bucket], some, more)
        lanes = lanes[last[lanes] != i]
        if not lanes.size:
            break
    return coder.finish()


def decode_index_rows(data: list[bytes], n: int, rank: int, priors: tuple[int, ...] = PRIORS) -> np.ndarray:
    """decode_indices of each stream, a row each."""
    at, buckets = order(n, rank)
    out = np.zeros((len(data), n**rank), np.int64)
    coder, ctx = Decoders(data), np.tile(np.array(priors, np.uint32)[:, None], len(data))
    lanes, going = np.arange(len(data)), np.ones(len(data), bool)
    for i, bucket in enumerate(buckets):
        some = lanes[coder.bit(ctx[bucket], lanes)]
        if not some.size:
            continue
        negative = coder.even(some)
        width, here = np.zeros(len(some), np.int64), np.arange(len(some))
        for k in range(LONGEST_PREFIX):
            here = here[coder.bit(ctx[2 * BUCKETS + min(k, MAGNITUDES - 1)], some[here])]
            if not here.size:
                break
            width[here] += 1
        rest = np.zeros(len(some), np.int64)
        for k in reversed(range(int(width.max()))):
            here = np.flatnonzero(width > k)
            rest[here] = rest[here] << 1 | coder.even(some[here])
        out[some, at[i]] = np.where(negative, -(rest + 1), rest + 1)
        more = coder.bit(ctx[BUCKETS + bucket], some)
        if not more.all():
            going[some] = more
            lanes = lanes[going[lanes]]
            if not lanes.size:
                break
    return np.clip(out, -(1 << 31), (1 << 31) - 1)
