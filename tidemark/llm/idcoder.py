"""Token ids in compressed binary files: an adaptive context-mixing range coder over independent blocks.

Model. Three experts predict the next id of a block. Order 1 and order 2 remember, for the last id and for a hash of the last two, which id followed last and how often in a row
that held (0 to 3); each puts on that id the share of hits that its state of confidence had so far, and the rest where order 0 has it. Order 0 is the frequency of ids: the file's counts at
first, blended with the block's own at the steps of REBUILDS. The experts' weights are Bayesian: multiplied by what each gave the id that came, with a fixed share given back
to all. The mixture splits the coder's interval into the order-2 id, the order-1 id and all ids by order 0.

Blocks. A block has BLOCK ids (the last of a file fewer) and starts from the file's counts with nothing else known, so each can be decoded by itself; its checksum is the crc32 of its ids
as little-endian unsigned 32-bit integers. Up to LANES blocks are coded in step, one lane each: an operation on numpy arrays advances all of them. When encoding, all ids are known: the tables' answers,
the order-0 frequencies and the intervals are worked out for many steps at once, and only shares of hits, weights and the coder's range go step by step. The arithmetic is on
integers and on +, -, *, / of 32-bit floats, which every machine rounds alike.

File. Magic, six counts (part, file of the part, documents, ids, alphabet, ids of a block), then as little-endian arrays: document ids, a byte per document that is 1 where the id is
missing, document lengths, alphabet, its counts; per block its number of 32-bit words and checksum; the crc32 of all that; then the words of the blocks.
Files are written by the text sink, one row each, so that any store Spark can write to will do and lost tasks are written again; the sink's separator ends a file.

Documents are in ascending order of id, missing ids last, equal ids by the hash of their text. A null text has the end id alone. No documents: no files, no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, fields, new_folder, query, small_batches, table
from tidemark.llm.tokens import coder

MAGIC = b"TMIDS02\n"
END = "\nend of ids\n"
BLOCK = 4096
PER_FILE = BLOCK * 1024     # ids of a file, more where a document is longer
TEXT_BYTES = 16 << 20       # texts whose words are looked up together
REBUILDS = frozenset((384, 1536))
PRIOR = 1024.0              # ids that the file's counts are worth in a block
TABLE = 4096                # places of the order-1 and order-2 tables
SHARE = np.float32(0.02)
# arrays without dimensions: operations take them faster than numbers
TOTAL = np.array(24, np.uint64)     # bits of the interval that the experts share
WHOLE, TOP, ONE = np.array(1 << 24, np.float32), np.array((1 << 24) - 1, np.float32), np.array(1, np.float32)
KEPT, GAIN = np.array(0.97, np.float32), np.array(0.0294, np.float32)       # of a share of hits, and what a hit adds
SCALE, BACK = np.array(WHOLE * (ONE - SHARE)), np.array(WHOLE * SHARE / 3)  # what the weights are scaled to, and what each gets back
WORD = np.array(32, np.uint64)      # bits written at once
LEAST = np.array((1 << 32) - 1, np.uint64)
FACTOR1, FACTOR2, SHIFT, MASK, READ = np.array(2_654_435_761), np.array(40_503), np.array(7), np.array(TABLE - 1), np.array(32)
LANES = 1024                # blocks coded in step


def order0_bits(a: int) -> int:
    """Bits of the order-0 interval of an alphabet of `a` ids."""
    return max(14, int(2 * a - 1).bit_length())


def order0(prior: np.ndarray, bits: int, step: int) -> tuple[np.ndarray, np.int32]:
    """Order-0 frequencies, each at least 1 of 1 << bits, before the block's own ids of `step` steps, and what each of these adds. The last id has what is left over."""
    part = ((1 << bits) - len(prior)) / (PRIOR + step)
    return np.floor(prior * (PRIOR * part)).astype(np.int32) + 1, np.int32(part)


class Lanes:
    """State of the model of `k` blocks that are decoded. Tables have a column per lane, so what most lanes look up lies together; of weights, row 0 is that of order 0."""

    def __init__(self, k: int, counts: np.ndarray):
        self.k, self.a = k, len(counts)
        self.bits = order0_bits(self.a)
        self.least = np.array(1 / (1 << self.bits), np.float32)
        self.prior = counts / counts.sum()
        # ids with two bits of confidence; no expected id is one above any alphabet
        self.kind, none = (np.int16, (1 << 13) - 1) if self.a < 1 << 13 else (np.int32, (1 << 29) - 1)
        self.width, self.small = np.array(k), [np.array(x, self.kind) for x in range(4)]
        self.table = np.full(2 * TABLE * k, none << 2, self.kind)
        self.hit = np.tile(np.array([0.0, 0.2, 0.4, 0.6], np.float32), 2 * k)
        self.at = np.arange(k)
        self.at2 = np.stack([self.at, self.at + TABLE * k])
        self.at4 = 4 * np.stack([self.at, self.at + k])
        self.w = np.full((3, k), WHOLE / 3, np.float32)
        self.last = self.before = np.zeros(k, np.int64)
        self.f = np.zeros((4, k), np.float32)       # places of both experts, of order 1, of order 2, none
        self.base, self.ends = self.f[0], self.f[0:3:2]
        self.experts = sliding_window_view(self.f[1:], 2, axis=0).transpose(0, 2, 1)        # width and start of each
        self.unit, self.part = np.empty((2, k), np.float32)
        self.given, self.x = np.empty((3, k), np.float32), np.empty((2, k), np.float32)
        self.rebuild(0, None)

    def rebuild(self, step: int, grid: np.ndarray | None) -> None:
        """Order-0 frequencies of every lane, and the symbol at each place of the order-0 interval; `grid` has a row per step so far. Before a first step all lanes share one column."""
        self.places = self.inverse = None       # those before make room
        k = self.k if step else 1
        self.columns = np.array(k)
        first, each = order0(self.prior, self.bits, step)
        places = np.empty((self.a, k, 2), np.int32)
        freq, below = places[..., 0], places[..., 1]
        freq[:] = first[:, None]
        for i in range(0, step, 64):
            np.add.at(freq.reshape(-1), (np.minimum(grid[i:min(i + 64, step)], self.a - 1).astype(np.int64) * k + self.at).ravel(), each)
        freq[-1] += (1 << self.bits) - freq.sum(0, dtype=np.int32)
        below[0] = 0
        for i in range(1, self.a):
            np.add(below[i - 1], freq[i - 1], out=below[i])
        self.places = places.reshape(-1).view(np.int64)     # both are looked up at once
        inverse = np.empty((k, 1 << self.bits), self.kind if self.kind is np.int16 or self.a >= 1 << 16 else np.uint16)
        symbols = np.arange(self.a, dtype=inverse.dtype)
        for i in range(0, k, 64):
            part = freq[:, i:min(i + 64, k)].T
            inverse[i:i + 64] = np.repeat(np.tile(symbols, len(part)), part.ravel()).reshape(len(part), -1)
        self.inverse = inverse.reshape(-1)
        self.column = self.at if step else 0 * self.at
        self.row = self.column << self.bits

    def predict(self) -> None:
        """The two expected ids, and where the mixture puts them in the interval: at least a place each."""
        i = np.empty((2, self.k), np.int64)
        i[0] = self.last
        np.multiply(self.last, FACTOR1, out=i[1])
        self.before *= FACTOR2
        i[1] += self.before
        i[1] >>= SHIFT
        i &= MASK
        i *= self.width
        i += self.at2
        e = self.table.take(i)
        self.i, self.c = i, e >> self.small[2]
        e &= self.small[3]
        self.sure, self.j = e, e.astype(np.int64)
        self.j += self.at4
        self.p = self.hit.take(self.j)
        f = np.multiply(self.w[1:], self.p, out=self.f[1:3])
        f += ONE
        np.floor(f, out=f)
        np.add(f[0], f[1], out=self.base)
        unit = np.subtract(WHOLE, self.base, out=self.unit)
        unit *= self.least
        np.floor(unit, out=unit)

    def look_up(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at places v of the interval, and their width and start. All are whole numbers up to WHOLE, which a float holds."""
        x = v - self.base
        x /= self.unit
        i = x.astype(np.int64)
        i += self.row
        s = self.inverse.take(i, mode="clip").astype(self.kind, copy=False)
        # by whom; arithmetic is faster than masks that follow no pattern
        by = np.less(v, self.ends)
        by[0] ^= by[1]
        more = self.c - s
        more *= by.astype(self.kind)
        s += more[0]
        s += more[1]
        self.s, out = s, s.astype(np.int64)
        i = out * self.columns
        i += self.column
        x = self.x
        x[:] = self.places.take(i, mode="clip").view(np.int32).reshape(-1, 2).T
        np.multiply(x[0], self.least, out=self.given[0])
        x *= self.unit
        x[1] += self.base
        more = self.experts - x
        more *= by.astype(np.float32)[:, None]
        x += more[0]
        x += more[1]
        return out, x.astype(np.int64).view(np.uint64)

    def update(self, s: np.ndarray) -> None:
        """Learn the ids that came. `look_up` has found them."""
        met = self.c == self.s
        came, w, given, part = met.astype(np.float32), self.w, self.given, self.part
        more = np.subtract(came, given[0], out=given[1:])
        more *= self.p
        more += given[0]
        w *= given
        np.add(w[0], w[1], out=part)
        part += w[2]
        w *= np.divide(SCALE, part, out=part)
        w += BACK
        # without an expected id the share of hits stays 0
        came *= GAIN
        self.p *= KEPT
        self.p += came
        self.hit[self.j] = self.p
        e = np.minimum(self.sure, self.small[2], out=self.sure)
        e *= met.astype(self.kind)
        self.s <<= self.small[2]
        self.s += self.small[1]
        e += self.s
        self.table[self.i] = e
        self.before, self.last = self.last, s


def blocks_of(n: int, block: int) -> tuple[int, int]:
    """Number of blocks of n ids, and the ids of the last one."""
    k = max(1, -(-n // block))
    return k, n - (k - 1) * block


def experience(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What an expert's tables say of the ids of some blocks, a row each, looked up at the given places: 1 where the expected id came, plus 2 for each time in a row (at most 3) that it had come.

    The looks at one place lie together when sorted by place, then step, so that no table is filled step by step."""
    rows, steps = ids.shape
    shift = steps.bit_length()
    v = place.astype(np.int32 if TABLE << shift < 1 << 31 else np.int64)
    v <<= shift
    v += np.arange(steps, dtype=v.dtype)
    v.sort(axis=1)
    known = v[:, 1:] ^ v[:, :-1] < 1 << shift
    v &= (1 << shift) - 1
    at = v + steps * np.arange(rows)[:, None]
    s = ids.take(at)
    said = np.zeros((rows, steps + 1), np.uint8)     # the step before the first has seen nothing
    met = said[:, 1:]
    np.equal(s[:, 1:], s[:, :-1], out=met[:, 1:].view(bool))
    met[:, 1:] &= known.view(np.uint8)
    again = met[:, :-1] & said[:, :-2]
    again += met[:, :-1]
    again += 1
    again *= known.view(np.uint8)
    again <<= 1
    again += met[:, 1:]
    out = np.zeros((rows, steps), np.uint8)
    out.ravel()[at[:, 1:]] = again      # the first place of a block has said nothing
    return out


def look_ahead(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For known ids, a block a row: what both experts' tables say of each (order 1 in the low 3 bits), its order-0 frequency and what lies below that."""
    rows, steps = ids.shape
    a, prior = len(counts), counts / counts.sum()
    bits = order0_bits(a)
    past = np.zeros((2, rows, steps), np.uint32)
    past[0, :, 1:], past[1, :, 2:] = ids[:, :-1], ids[:, :-2]
    said = experience(ids, past[0] & np.uint32(TABLE - 1))
    # bits 7 to 18 are the same in 32 bits
    past *= np.array([2_654_435_761, 40_503], np.uint32)[:, None, None]
    past[0] += past[1]
    said |= experience(ids, past[0] >> np.uint32(7) & np.uint32(TABLE - 1)) << 3
    at = ids + a * np.arange(rows)[:, None]
    freq, below = np.empty((2, rows, steps + 16), np.float32)[..., :steps]      # rows that don't fall on the same lines of a cache
    seen = np.zeros((rows, a), np.int32)
    cuts = [0, *(x for x in sorted(REBUILDS) if x < steps), steps]
    for i, j in zip(cuts, cuts[1:]):
        first, each = order0(prior, bits, i)
        f = first + seen * each
        f[:, -1] += (1 << bits) - f.sum(1, dtype=np.int32)
        freq[:, i:j] = f.take(at[:, i:j])
        up = f.cumsum(1, dtype=np.int32)
        up -= f
        below[:, i:j] = up.take(at[:, i:j])
        if j < steps:
            seen += np.bincount(at[:, i:j].ravel(), minlength=rows * a).reshape(rows, a)
    return said, freq, below


def encode_blocks(symbols: np.ndarray, counts: np.ndarray, block: int = BLOCK) -> list[np.ndarray]:
    """The 32-bit words of each block of a sequence of places in an alphabet with the given counts."""
    out: list[np.ndarray] = []
    for i in range(0, max(1, len(symbols)), LANES * block):
        out += encode_lanes(symbols[i:i + LANES * block], counts, block)
    return out


def encode_lanes(symbols: np.ndarray, counts: np.ndarray, block: int) -> list[np.ndarray]:
    """`encode_blocks` of blocks that are coded in step. As all ids are known, only what an id leaves for the next one goes step by step: shares of hits, weights, the coder's range."""
    n = len(symbols)
    k, tail = blocks_of(n, block)
    steps = block if k > 1 else tail
    grid = np.zeros((k, steps), np.int32)
    grid.ravel()[:n] = symbols
    said, freq, below = np.empty((steps, k), np.uint8), np.empty((steps, k), np.float32), np.empty((steps, k), np.float32)
    few = max(1, min(64, (1 << 18) // len(counts)))
    for i in range(0, k, few):
        for whole, x in zip((said, freq, below), look_ahead(grid[i:i + few], counts)):
            whole[:, i:i + few] = x.T
    del grid
    least = np.array(1 / (1 << order0_bits(len(counts))), np.float32)
    hit = np.tile(np.array([0.0, 0.2, 0.4, 0.6], np.float32), 2 * k)
    at4 = 4 * np.arange(2 * k).reshape(2, k)
    w = np.full((3, k), WHOLE / 3, np.float32)
    part, shift, rng = np.empty(k, np.float32), np.empty(k, np.uint64), np.full(k, (1 << 64) - 1, np.uint64)
    width = block * 3 // 4 + 4
    sums, size, ends = np.zeros(k * width, np.uint64), np.zeros(k, np.int64), np.zeros(k, np.int64)    # of a word, not yet carried
    most = max(1, (1 << 14) // k)
    for at in range(0, steps, most):
        t = min(most, steps - at)
        met, sure = np.empty((t, 2, k), bool), np.empty((t, 2, k), np.int64)
        for order in range(2):
            np.not_equal(said[at:at + t] & (1 << 3 * order), 0, out=met[:, order])
            sure[:, order] = said[at:at + t] >> (3 * order + 1) & 3
        sure += at4
        p, gain = np.empty((t, 2, k), np.float32), met * GAIN
        new = np.empty((2, k), np.float32)
        for i in range(t):
            hit.take(sure[i], out=p[i], mode="clip")
            np.multiply(p[i], KEPT, out=new)
            new += gain[i]
            hit[sure[i]] = new
        f0, start = freq[at:at + t], below[at:at + t]
        given = np.empty((t, 3, k), np.float32)
        p0 = np.multiply(f0, least, out=given[:, 0])[:, None]
        more = np.subtract(met, p0, out=given[:, 1:])
        more *= p
        more += p0
        f = p
        for i in range(t):
            f[i] *= w[1:]
            w *= given[i]
            np.add(w[0], w[1], out=part)
            part += w[2]
            w *= np.divide(SCALE, part, out=part)
            w += BACK
        f += ONE
        np.floor(f, out=f)
        base = f[:, 0] + f[:, 1]
        unit = WHOLE - base
        unit *= least
        np.floor(unit, out=unit)
        start *= unit
        start += base
        unit *= f0
        # what an expert expected; arithmetic is faster than masks that follow no pattern
        for order in range(2):
            came = met[:, order].astype(np.float32)
            for x, here in ((unit, f[:, order]), (start, (f[:, 1], np.float32(0))[order])):
                more = here - x
                more *= came
                x += more
        low, share = start.astype(np.int64).view(np.uint64), unit.astype(np.int64).view(np.uint64)
        full = np.empty((t, k), bool)
        for i in range(t):
            rng >>= TOTAL
            low[i] *= rng
            rng *= share[i]
            np.copyto(shift, np.less_equal(rng, LEAST, out=full[i]))
            shift *= WORD
            rng <<= shift
        if at <= tail - 1 < at + t:
            ends[-1] = size[-1] + full[:tail - at, -1].sum()
        if at + t > tail:
            low[max(0, tail - at):, -1] = 0
        # what goes into the same word is added up: a block's steps lie together
        low, full = np.ascontiguousarray(low.T), np.ascontiguousarray(full.T)
        first = np.empty((k, t), bool)
        first[:, 0], first[:, 1:] = True, full[:, :-1]
        first = np.flatnonzero(first)
        lane = first // t
        word = np.arange(len(first)) - np.searchsorted(first, np.arange(0, k * t, t))[lane] + size[lane] + lane * width
        sums[word] += np.add.reduceat((low >> WORD).ravel(), first)
        low &= LEAST
        sums[word + 1] += np.add.reduceat(low.ravel(), first)
        size += full.sum(1)
    ends[:len(ends) - 1] = size[:-1]
    width, sums = size.max() + 2, sums.reshape(k, width)[:, :size.max() + 2].ravel()
    while len(over := np.flatnonzero(sums > LEAST)):
        carry = sums[over] >> WORD
        sums[over] &= LEAST
        sums[over - 1] += carry
    flat = sums.astype(np.uint32).reshape(k, width)
    return [row[:end + 2] for row, end in zip(flat, ends.tolist())]


def decode_blocks(words: list[np.ndarray], n: int, counts: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The sequence that `encode_blocks` was given; any consecutive blocks of it by themselves as well."""
    most = max(1, min(LANES, (1 << 25) >> order0_bits(len(counts))))
    return np.concatenate([decode_lanes(words[i:i + most], min(n - i * block, most * block), counts, block) for i in range(0, len(words), most)])


def decode_lanes(words: list[np.ndarray], n: int, counts: np.ndarray, block: int) -> np.ndarray:
    """`decode_blocks` of blocks that are decoded in step. What a short last block gives beyond its end is cut off."""
    k, tail = blocks_of(n, block)
    width = max(map(len, words)) + 4
    flat = np.zeros((k, width), np.uint64)
    for i, w in enumerate(words):
        flat[i, :len(w)] = w
    code = flat[:, 0] << WORD | flat[:, 1]
    flat = flat.ravel()
    at = np.arange(k) * width + 2
    rng = np.full(k, (1 << 64) - 1, np.uint64)
    more, full = np.empty(k, np.int64), np.empty(k, bool)
    shift = more.view(np.uint64)
    lanes = Lanes(k, counts)
    grid = np.zeros((block, k), np.int32)
    for step in range(block if k > 1 else tail):
        if step in REBUILDS:
            lanes.rebuild(step, grid)
        lanes.predict()
        rng >>= TOTAL
        v = (code // rng).view(np.int64).astype(np.float32)
        s, (share, start) = lanes.look_up(np.minimum(v, TOP, out=v))
        start *= rng
        code -= start
        rng *= share
        # the lanes whose range has become small read a word
        np.copyto(more, np.less_equal(rng, LEAST, out=full))
        word = flat.take(at, mode="clip")
        word *= shift
        at += more
        more *= READ
        rng <<= shift
        code <<= shift
        code |= word
        lanes.update(s)
        grid[step] = s
    # beyond a block's end, or where it is damaged, anything may have come
    np.minimum(grid, lanes.a - 1, out=grid)
    return grid.T.reshape(-1)[:n]


def in_alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids that occur, ascending, how often, and each id's place among them."""
    if len(ids) and ids.max() >= 1 << 20:
        alphabet, places, counts = np.unique(ids, return_inverse=True, return_counts=True)
        return alphabet, counts, places.astype(np.int32)
    counts = np.bincount(ids)
    alphabet = np.flatnonzero(counts)
    places = np.zeros(len(counts), np.int32)
    places[alphabet] = np.arange(len(alphabet), dtype=np.int32)
    return alphabet, counts[alphabet], places[ids]


def write_file(part: int, seq: int, doc_ids: list[int | None], ids: list[bytes], block: int = BLOCK) -> bytes:
    """The image of a file with these documents, each given as little-endian unsigned 32-bit ids."""
    every = np.frombuffer(b"".join(ids), "<u4")
    alphabet, counts, symbols = in_alphabet(every)
    words = encode_blocks(symbols, counts.astype(float), block)
    sums = [zlib.crc32(every[i:i + block].tobytes()) for i in range(0, len(every), block)]
    head = MAGIC + struct.pack("<6Q", part, seq, len(ids), len(every), len(alphabet), block)
    head += np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes() + np.array([len(x) // 4 for x in ids], "<u4").tobytes()
    head += alphabet.astype("<u4").tobytes() + counts.astype("<u4").tobytes() + np.array([len(w) for w in words], "<u4").tobytes() + np.array(sums, "<u4").tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(w.astype("<u4").tobytes() for w in words)


def read_file(data: bytes) -> tuple[int, int, list[int | None], list[np.ndarray]]:
    """Part, file of the part, document ids and each document's ids; an error where a checksum doesn't hold."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of ids")
    part, seq, docs, n, a, block = struct.unpack_from("<6Q", data, 8)
    at = 56

    def take(kind: str, k: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, k, at)
        at += out.nbytes
        return out

    k = -(-n // block)
    names, lost, lengths, alphabet, counts, sizes, sums = (take(*x) for x in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", a), ("<u4", a), ("<u4", k), ("<u4", k)))
    if struct.unpack_from("<I", data, at)[0] != zlib.crc32(data[:at]):
        raise ValueError(f"the head of file {part}, {seq} is damaged")
    at += 4
    words = [take("<u4", x) for x in sizes.tolist()]
    every = alphabet[decode_blocks(words, n, counts.astype(float), block)].astype("<u4")
    for i, want in enumerate(sums.tolist()):
        if zlib.crc32(every[i * block:(i + 1) * block].tobytes()) != want:
            raise ValueError(f"block {i} of file {part}, {seq} is damaged")
    return part, seq, [None if x else d for d, x in zip(names.tolist(), lost.tolist())], np.split(every, np.cumsum(lengths)[:-1])


def at_least(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches put together until they have so many bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            whole, held = pa.concat_batches(held), []
            yield whole
    if held:
        whole, held = pa.concat_batches(held), []
        yield whole


def write_ids(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 2, per_file: int = PER_FILE) -> None:
    """Encode whole texts and write their ids, with an end id each, below `path` in ascending order of document id."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part = coder(tokenizer), TaskContext.get().partitionId()
        names: list[int | None] = []
        ids: list[bytes] = []
        seq = size = 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([write_file(part, seq, names, ids)], pa.binary())], names=["image"])
        for b in at_least(TEXT_BYTES, batches):
            coded = c.encode_all(b.column(1))[::-1]
            for name in b.column(0).to_pylist():
                x = coded.pop() + end
                if names and size + len(x) // 4 > per_file:
                    yield pack()
                    names, ids, seq, size = [], [], seq + 1, 0
                names.append(name)
                ids.append(x)
                size += len(x) // 4
        if names:
            yield pack()

    ranged.mapInArrow(run, "image binary").select(F.col("image").cast("string").alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", 1).text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, place, doc_id, ids): the documents of all files below `path`, ids as little-endian bytes."""
    kinds = fields(part="bigint", seq="bigint", place="bigint", doc_id="bigint", ids="binary")
    try:
        files = spark.read.format("binaryFile").load(path).select("content")
    except AnalysisException:
        return spark.createDataFrame([], kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                image = data.as_py()
                if not image:       # the sink leaves an empty file where there are no rows
                    continue
                part, seq, names, ids = read_file(image)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(names)), pa.array([seq] * len(names)), pa.array(range(len(names)), pa.int64()), pa.array(names, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                                                 names=["part", "seq", "place", "doc_id", "ids"])
    return files.mapInArrow(run, kinds)


@query("op2_id_range_coder")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), path)
    rows = cut(read_ids(spark, path).select("part", "seq", "place", "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")))
    files = rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n")).select("part", "seq", (F.sum("n").over(Window.orderBy("part", "seq")) - F.col("n")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part", "seq").orderBy("place")) - F.col("n_tokens")
    return rows.withColumn("within", within).join(files, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
