"""Language-model scores by online logistic context mixing, with corpus counts that cover all training texts.

The model codes a text as its lower-cased words, each closed by a space, and one end mark. A byte is a path of a few bits
in a prefix code. Every bit gets predictions from hashed contexts: the last two and the last four bytes of the word, the
whole word so far, and, in the first ``HEAD`` bytes of a word, the previous word with the word so far. A mixer adds their log-odds with
weights picked by a gate: how sure the two longest contexts are, and how often, so far in this text, the previous word told the
next one. An adaptive map refines the mixer's probability. The text's own past is a further predictor, learned while the text
is coded: where the previous word occurred before in the text, one bit says whether the word that followed it then comes again, and its
probability moves with how often that was so in this text and with the run of hits before.

Statistics of contexts come from all training texts, each task counting its share and the shares being added by range of
slots. Weights and maps are learned from all training texts too: these fall into two halves, and each half is predicted from the statistics of
the other, so that what a text teaches is how far a context holds for a text not counted. Each task learns online, one small step after
another; its weights count in the mean by the bits it saw for each gate, and counts of maps are added. The prefix code follows the bytes of all training texts.

Work on words is exchanged in blocks. Documents are read in chunks of about ``CHUNK_BYTES``: a chunk scores its texts,
keeps the documents that each distinct word stands in, and sends its words' hashes and training counts to buckets of the hash range.
Buckets add up the counts and answer each chunk. A frequent word is one entry of each chunk, however often it stands there.

Defined results: null and empty texts are the end mark alone; rows with equal ids are scored separately; without training
rows all counts are 0 and every bit costs one bit; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Words, _power, _R, filled, fold, stored, text_slices, tune

CHUNK_BYTES, COUNT_BYTES, BUCKET_BYTES, MAX_BUCKETS, MAX_CHUNK_DOCS, MERGE_ENTRIES = 6 << 20, 3 << 20, 64 << 20, 16384, 60_000, 4 << 20
TASK_BYTES, LEAST_TASK_BYTES = 128 << 20, 32 << 20  # text that a task counts before its counts are sent
LEAST_BITS, MOST_BITS, SLOT_BYTES = 16, 22, 4  # slots of the largest table: about one for each SLOT_BYTES of text, within bounds
HEAD, BATCH_BYTES, BATCH_PAIRS, BLOCK = 3, 1 << 15, 1 << 11, 1 << 14
STEP_BYTES, STEP_TOKENS = 1 << 13, 1 << 10  # of words and tokens that a step of learning sees
ODDS = 16.0  # log-odds are kept in sixteenths
CELLS, SPREAD, MAP_PRIOR = 64, 8.0, 4.0
LANES = 8  # sums of neighbours in a step of learning are kept apart, so that none waits for the one before
END = b"\n"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)


# ---------------------------------------------------------------- bits of bytes


@dataclass
class Code:
    """A prefix code: the bits of each byte and the inner node that each of them is decided at."""

    length: np.ndarray
    start: np.ndarray  # of each byte's path in the arrays of all paths
    node: np.ndarray
    bit: np.ndarray
    salt: np.ndarray  # what a node adds to the hash of a context


def prefix_code(frequency: np.ndarray) -> Code:
    """Frequent bytes get short paths; every byte has one."""
    heap = [(int(n) + 1, i) for i, n in enumerate(frequency)]
    heapq.heapify(heap)
    parts: dict[int, tuple[int, int]] = {}
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parts[256 + len(parts)] = a[1], b[1]
        heapq.heappush(heap, (a[0] + b[0], 255 + len(parts)))
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    todo: list[tuple[int, list[tuple[int, int]]]] = [(heap[0][1], [])]
    while todo:
        at, path = todo.pop()
        if at < 256:
            paths[at] = path
        else:
            todo += [(part, [*path, (at - 256, b)]) for b, part in enumerate(parts[at])]
    length = np.array([len(path) for path in paths])
    node, bit = (np.array([step[k] for path in paths for step in path], np.uint8) for k in (0, 1))
    return Code(length, np.cumsum(length) - length, node, bit, (node.astype(np.uint64) + np.uint64(1)) * _M3)


def _ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    stop = np.cumsum(lens)
    out = np.repeat(starts - (stop - lens), lens)
    out += np.arange(len(out))
    return out


def _order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned keys. They are sorted with their places in the low bits; of longer keys the low bits give way
    where that leaves the order right."""
    n = len(keys)
    low = n.bit_length()
    drop = max(0, (int(keys.max()).bit_length() if n else 0) + low - 64)
    packed = (keys >> np.uint64(drop)) << np.uint64(low)
    packed |= np.arange(n, dtype=np.uint64)
    packed.sort()
    packed &= np.uint64((1 << low) - 1)
    order = packed.view(np.int64)
    if drop:
        found = keys[order]
        if (found[1:] < found[:-1]).any():
            return np.argsort(keys, kind="stable")
    return order


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct key, in order of keys, and the number of each place's key."""
    order = _order(keys)
    found = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = found[1:] != found[:-1]
    number = np.empty(len(keys), dtype=np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return order[new], number


@dataclass
class Bits:
    """Bits of a batch of words, in order."""

    first: np.ndarray  # of each word
    head: np.ndarray  # how many of each word lie in its first HEAD bytes
    bit: np.ndarray
    node: np.ndarray
    contexts: list[np.ndarray]  # hash of each context and node: two bytes, four bytes, the word so far


def word_bits(lens: np.ndarray, chars: np.ndarray, code: Code, lo: int = 0, hi: int | None = None) -> Bits:
    """Bits of words with a closing space; the end mark, a word of its own, has none. With bounds, only those of the bytes from place
    ``lo`` on and before place ``hi``."""
    n = len(lens)
    closed = np.ones(n, dtype=np.int64)
    size = lens + closed
    stop = np.cumsum(size)
    start = stop - size
    x = np.full(int(stop[-1]) if n else 0, 32, dtype=np.uint8)
    inner = np.ones(len(x), dtype=bool)
    inner[stop - 1] = False
    x[inner] = chars
    place = np.arange(len(x)) - np.repeat(start, size)
    back = np.zeros(len(x), dtype=np.uint64)
    hashes = []
    for k in range(1, 5):
        before = np.zeros(len(x), dtype=np.uint64)
        before[k:] = x[:-k]
        before[place < k] = 0
        back |= before << np.uint64(8 * (k - 1))
        if k in (2, 4):
            hashes.append((back + np.uint64(k << 40)) * _M1)
    run = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _power(_R, int(size.max()) if n else 0)[place], out=run[1:])
    hashes.append((run[:-1] - np.repeat(run[start], size) + np.uint64(1)) * _M2)
    # the end mark is a word of one byte, 10, and nothing after it
    ends = np.flatnonzero(x[start] == 10) if n else np.zeros(0, np.int64)
    keep = np.ones(len(x), dtype=bool)
    keep[start[ends] + 1] = False
    if lo:
        keep &= place >= lo
    if hi is not None:
        keep &= place < hi
    bits_of = code.length[x] * keep
    per_word = np.add.reduceat(bits_of, start) if n else bits_of
    head = np.add.reduceat(bits_of * (place < HEAD), start) if n else bits_of
    asked = np.flatnonzero(keep)
    bits_of = bits_of[asked]
    at = np.repeat(asked, bits_of)
    step = _ragged(code.start[x[asked]], bits_of)
    salt = code.salt.take(step)
    contexts = []
    for h in hashes:
        c = h.take(at)
        c ^= salt
        c *= _M1
        contexts.append(c)
    return Bits(np.cumsum(per_word) - per_word, head, code.bit.take(step), code.node.take(step), contexts)


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).view(np.int64)


def _pair(word: np.ndarray, before: np.ndarray, bits: int) -> np.ndarray:
    """Slots of the previous word with the word so far; ``before``: its hash times _M3."""
    h = word ^ before
    h *= _M1
    return _slots(h, bits)


def _batches(lens: np.ndarray, chars: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    at = np.concatenate([[0], np.cumsum(lens)])
    a = 0
    while a < len(lens):
        b = max(a + 1, int(np.searchsorted(at, at[a] + size, side="right")) - 1)
        yield a, b, chars[at[a] : at[b]]
        a = b


def table_bits(text_bytes: int) -> tuple[int, int, int, int]:
    """Bits of a slot's number in each table: they follow the size of the corpus within bounds."""
    most = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(1, text_bytes / SLOT_BYTES))))))
    return min(most, 18), min(most, 20), min(most, 22), most


# ---------------------------------------------------------------- words of texts


class Texts:
    """Words of texts in order, gathered from slices; every text ends with the end mark."""

    def __init__(self):
        self.doc_ids, self.held, self.n_bytes = [], [], []
        self.parts: list[tuple] = []
        self.bytes = 0

    def add(self, doc_ids: list, held: list, data: np.ndarray, offs: np.ndarray) -> None:
        data = _LOWER[data]
        words = Words(data, offs, lower=False)
        numbers = (words.doc + len(self.doc_ids), words.starts + self.bytes, words.ends - words.starts)
        self.parts.append((words.hash(), *(x.astype(np.int32) for x in numbers), data))
        self.bytes += len(data)
        self.doc_ids += doc_ids
        self.held += held
        self.n_bytes += np.diff(offs).tolist()

    def close(self) -> None:
        h, doc, starts, lens, data = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        first, inverse = _distinct(h)
        self.hash = h[first]
        del h
        n, m = len(self.hash), len(self.doc_ids)
        self.doc, self.word = doc, inverse
        # texts with their end marks, whose word is number n
        self.all_doc = np.repeat(np.arange(m, dtype=np.int32), np.bincount(doc, minlength=m) + 1)
        self.all_word = np.full(len(doc) + m, n, np.int32)
        self.all_word[np.arange(len(doc)) + doc] = inverse
        starts, lens = starts[first].astype(np.int64), lens[first].astype(np.int64)
        self.lens = np.append(lens, 1)
        self.chars = np.append(data[_ragged(starts, lens)], np.uint8(END[0]))
        self.keys = np.append(self.hash, _M1)
        self.fresh = np.concatenate([[True], self.all_doc[1:] != self.all_doc[:-1]]) if m else np.zeros(0, bool)

    def pair(self) -> None:
        """Finds the distinct heads of words, closing spaces included, and the distinct pairs of a previous word and a head, in order of heads: what
        is the same for all tokens of a pair is made once."""
        starts = np.cumsum(self.lens) - self.lens
        key = np.zeros(len(self.lens), dtype=np.uint64)
        for k in range(HEAD):
            byte = np.where(k < self.lens, self.chars[np.minimum(starts + k, len(self.chars) - 1)], np.where(k == self.lens, 32, 0))
            key |= byte.astype(np.uint64) << np.uint64(8 * k)
        first, self.head = _distinct(key)  # number of each word's head
        self.head_lens = np.minimum(self.lens[first], HEAD)
        self.head_chars = self.chars[_ragged(starts[first], self.head_lens)]
        n = len(self.lens)
        before = np.empty(len(self.all_word), dtype=np.uint64)
        before[1:] = self.all_word[:-1]
        before[self.fresh] = n  # a text's first word
        head = self.head[self.all_word]
        key = head.astype(np.uint64)
        key *= np.uint64(n + 1)
        key += before
        first, self.pairs = _distinct(key)  # number of each token's pair
        self.pair_head = head[first]
        self.pair_before = np.append(self.keys, np.uint64(0))[before[first].view(np.int64)] * _M3


def count_bits(texts: Texts, wanted: np.ndarray, code: Code, bits: tuple[int, ...], tables: list[np.ndarray]) -> None:
    """Adds the wanted texts to counts of bits: tables[j][2 * slot + bit]."""
    texts.pair()
    token = wanted[texts.all_doc]
    times = np.bincount(texts.all_word[token], minlength=len(texts.lens))

    def add(w: Bits, weights: np.ndarray) -> None:
        for table, h, k in zip(tables, w.contexts, bits):
            np.add.at(table, 2 * _slots(h, k) + w.bit, weights)

    for a, b, chars in _batches(texts.lens, texts.chars, BATCH_BYTES):
        w = word_bits(texts.lens[a:b], chars, code, HEAD)
        add(w, np.repeat(times[a:b].astype(np.int32), np.diff(np.append(w.first, len(w.bit)))))
    w = word_bits(texts.head_lens, texts.head_chars, code, 0, HEAD)
    add(w, np.repeat(np.bincount(texts.head, weights=times, minlength=len(w.head)).astype(np.int32), w.head))
    times = np.bincount(texts.pairs[token], minlength=len(texts.pair_head)).astype(np.int32)
    met = np.flatnonzero(times)
    for a in range(0, len(met), BATCH_PAIRS):
        pair = met[a : a + BATCH_PAIRS]
        head = texts.pair_head[pair]
        n = w.head[head]
        at = _ragged(w.first[head], n)
        slot = _pair(w.contexts[2][at], np.repeat(texts.pair_before[pair], n), bits[3])
        np.add.at(tables[3], 2 * slot + w.bit[at], np.repeat(times[pair], n))


def log_odds(table: np.ndarray) -> np.ndarray:
    """Of counts (zeros and ones in turn), in sixteenths; a context that was never seen has 0."""
    zero, one = table[0::2].astype(np.float32), table[1::2].astype(np.float32)
    return np.clip(np.rint(ODDS * np.log((one + 0.4) / (zero + 0.4))), -127, 127).astype(np.int8)


# ---------------------------------------------------------------- mixing


_LANES = np.arange(1 << 16) % LANES * 256


def input_rows(odds: list[np.ndarray]) -> np.ndarray:
    """Log-odds in sixteenths as rows of four numbers, which are fetched at once; of three, the last is 0."""
    rows = np.zeros((len(odds[0]), 4), np.float32)
    for j, o in enumerate(odds):
        rows[:, j] = o
    return rows


class Mixer:
    """Gated weights over log-odds (in sixteenths), learned online, and a refining map of what bits came where."""

    def __init__(self, gates: int, inputs: int):
        self.weights = np.full((gates, inputs + 1), 0.4)
        self.weights[:, -1] = 0
        self.mass = np.zeros(gates)  # bits that taught each gate
        self.seen, self.ones = np.zeros(256 * CELLS), np.zeros(256 * CELLS)  # of each cell of the map
        self.shown: list[np.ndarray] = []  # cells and bits not yet in them
        self.freeze()

    def freeze(self) -> None:
        """The map, from what was shown."""
        self._fill()
        level = np.tile((np.arange(CELLS) + 0.5) * (2 * SPREAD / CELLS) - SPREAD, 256)
        self.refine = ((self.ones + MAP_PRIOR / (1 + np.exp(-level))) / (self.seen + MAP_PRIOR)).astype(np.float32)

    def _fill(self) -> None:
        if self.shown:
            self._add(np.bincount(np.concatenate(self.shown), minlength=2 * len(self.seen)))
            self.shown = []

    def _add(self, shown: np.ndarray) -> None:
        zero, one = shown[0::2], shown[1::2]
        self.seen += zero + one
        self.ones += one

    def sums(self) -> list[np.ndarray]:
        """What adds up over tasks."""
        self._fill()
        return [np.concatenate([(self.weights * self.mass[:, None]).reshape(-1), self.mass]), np.concatenate([self.seen, self.ones])]

    def mean_of(self, sums: list[np.ndarray]) -> None:
        """Takes the means of weights by mass, and the map, from added-up sums."""
        total, self.mass = np.split(sums[0], [self.weights.size])
        met = self.mass > 0
        self.weights[met] = total.reshape(self.weights.shape)[met] / self.mass[met, None]
        self.seen, self.ones = np.split(sums[1], 2)
        self.freeze()

    def _cell(self, dot: np.ndarray, node: np.ndarray) -> np.ndarray:
        return node.astype(np.int32) * CELLS + ((dot + np.float32(SPREAD)) * np.float32(CELLS / (2 * SPREAD))).astype(np.int32)

    def _dot(self, rows: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Weighted sums of rows of log-odds, within bounds."""
        inputs = self.weights.shape[1] - 1
        weights = np.zeros((len(self.weights), 8), np.float32)
        weights[:, :inputs] = self.weights[:, :-1] / ODDS
        weights[:, -1] = self.weights[:, -1]
        weights = weights.take(gate, axis=0)
        dot = weights[:, -1].copy()
        for j in range(inputs):
            dot += weights[:, j] * rows[:, j]
        return np.clip(dot, -SPREAD, SPREAD - 1e-3, out=dot)

    def cost(self, odds: list[np.ndarray], gate: np.ndarray, node: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Log of the probability of each bit."""
        return self.cost_of(input_rows(odds), gate, node, bit)

    def cost_of(self, rows: np.ndarray, gate: np.ndarray, node: np.ndarray, bit: np.ndarray) -> np.ndarray:
        dot = self._dot(rows, gate)
        p = self.refine.take(self._cell(dot, node))
        np.negative(dot, out=dot)
        np.exp(dot, out=dot)
        dot += 1
        p += np.reciprocal(dot, out=dot)
        p *= np.float32(0.5)
        # 1 - p where the bit is 0
        p *= bit * np.float32(2) - 1
        p += 1 - bit
        np.maximum(p, np.float32(1e-5), out=p)
        return np.log(p, out=p)

    def learn(self, rows: np.ndarray, gate: np.ndarray, node: np.ndarray, bit: np.ndarray, mass: np.ndarray | None = None, rate: float = 0.02) -> None:
        """One small step on bits that are predicted from what was learned before them."""
        gates = len(self.weights)
        dot = self._dot(rows, gate)
        shown = 2 * self._cell(dot, node) + bit
        np.negative(dot, out=dot)
        np.exp(dot, out=dot)
        dot += 1
        error = bit - np.reciprocal(dot, out=dot)
        if mass is None:
            self.shown.append(shown.astype(np.uint16))
            if len(self.shown) > 100:
                self._fill()
        else:
            error *= mass
            self._add(np.bincount(shown, weights=mass, minlength=2 * len(self.seen)))
        lane = _LANES[: len(gate)] if len(gate) <= len(_LANES) else np.arange(len(gate)) % LANES * 256
        lane = lane + gate

        def total_of(values: np.ndarray | None) -> np.ndarray:
            return np.bincount(lane, weights=values, minlength=LANES * 256).reshape(LANES, 256).sum(axis=0)[:gates]

        total = total_of(mass)
        pace = rate * np.minimum(total, 40.0) / np.maximum(total, 1e-9)
        for j in range(self.weights.shape[1] - 1):
            self.weights[:, j] += pace / ODDS * total_of(error * rows[:, j])
        self.weights[:, -1] += pace * total_of(error)
        self.mass += total


#: how sure log-odds are, 0 to 3, by their byte
_SURE = np.digitize(np.abs(np.arange(256, dtype=np.uint8).view(np.int8).astype(np.int64)), [1, 20, 40])
_SURE4 = 4 * _SURE


RATES, RUNS = 4, 6


@dataclass
class Heads:
    """Head bits of distinct heads, and log-odds of the pair context at the head bits of distinct pairs."""

    bits: Bits
    rows: np.ndarray  # log-odds of the word's contexts; in place of a fourth, in bytes: how sure the whole word is, node, bit
    size: np.ndarray  # bits of each pair
    first: np.ndarray
    pair_odds: np.ndarray
    rate: np.ndarray  # of each token

    def bits_of(self, texts: Texts, pair: np.ndarray, rate: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of pairs at rates: how many bits each has, and inputs, gates, nodes and bits of all of them."""
        n = self.size[pair]
        rows = self.rows.take(_ragged(self.bits.first[texts.pair_head[pair]], n), axis=0)
        packed = rows[:, 3].copy().view(np.uint8).reshape(-1, 4)
        odds = self.pair_odds.take(_ragged(self.first[pair], n)).view(np.uint8)
        gate = _SURE4.take(odds)
        gate += packed[:, 0]
        gate += np.repeat(16 * rate, n)
        rows[:, 3] = odds.view(np.int8)
        return n, rows, gate, packed[:, 1], packed[:, 2]


@dataclass
class Model:
    code: Code
    bits: tuple[int, ...]
    odds: list[np.ndarray]
    head: Mixer
    tail: Mixer
    again: np.ndarray  # run of hits x rate of hits in the text: probability that a follower comes again

    def _odds(self, w: Bits) -> list[np.ndarray]:
        return [t.take(_slots(h, k)) for t, h, k in zip(self.odds, w.contexts, self.bits)]

    def _tails(self, texts: Texts, size: int) -> Iterator[tuple]:
        """For each batch of words: their range, how many bits each has after its head, the first of them, and inputs, gates, nodes and bits of these."""
        for a, b, chars in _batches(texts.lens, texts.chars, size):
            w = word_bits(texts.lens[a:b], chars, self.code, HEAD)
            odds = self._odds(w)
            yield slice(a, b), np.diff(np.append(w.first, len(w.bit))), w.first, odds, _tail_gate(odds, slice(None)), w.node, w.bit

    def tail_costs(self, texts: Texts) -> np.ndarray:
        """Of each distinct word the cost of its bits after the head."""
        out = np.zeros(len(texts.lens))
        for s, n, first, *bits in self._tails(texts, BATCH_BYTES):
            has = n > 0
            if has.any():
                out[s][has] = np.add.reduceat(self.tail.cost(*bits), first[has], dtype=np.float64)
        return out

    def heads(self, texts: Texts) -> Heads:
        """Inputs of the head bits of each distinct pair, and of each token how often, so far in its text, the previous word told the next one."""
        texts.pair()
        w = word_bits(texts.head_lens, texts.head_chars, self.code, 0, HEAD)
        size = w.head[texts.pair_head]
        first = np.cumsum(size) - size
        sign = 2 * w.bit.astype(np.int8) - 1
        # the previous word told it: by log-odds of more than 2 for a byte on average
        enough = 2 * ODDS * np.minimum(HEAD, texts.lens + 1)
        least = np.zeros(len(w.head))
        least[texts.head] = enough
        odds, told = np.empty(int(size.sum()), np.int8), np.empty(len(size), dtype=bool)
        for a in range(0, len(size), BATCH_PAIRS):
            s = slice(a, a + BATCH_PAIRS)
            head, n = texts.pair_head[s], size[s]
            at = _ragged(w.first[head], n)
            found = self.odds[3].take(_pair(w.contexts[2].take(at), np.repeat(texts.pair_before[s], n), self.bits[3]))
            odds[first[a] : first[a] + len(at)] = found
            told[s] = np.add.reduceat(found * sign.take(at).astype(np.int16), first[s] - first[a], dtype=np.int64) > least[head]
        own = self._odds(w)
        rows = input_rows(own)
        rows.view(np.uint8).reshape(-1, 16)[:, 12:15] = np.stack([_SURE[own[2].view(np.uint8)], w.node, w.bit], axis=1)
        return Heads(w, rows, size, first, odds, _rate_so_far(told[texts.pairs], texts.fresh))

    def head_costs(self, texts: Texts) -> np.ndarray:
        """Of each token the cost of its head bits: once for each distinct pair and rate."""
        h = self.heads(texts)
        key = texts.pairs * np.int64(RATES) + h.rate
        met = np.zeros(RATES * len(h.size), dtype=bool)
        met[key] = True
        number = np.flatnonzero(met)
        out = np.zeros(len(met))
        for a in range(0, len(number), BATCH_PAIRS):
            of = number[a : a + BATCH_PAIRS]
            pair, rate = of // RATES, of % RATES
            n, *bits = h.bits_of(texts, pair, rate)
            out[of] = np.add.reduceat(self.head.cost_of(*bits), np.cumsum(n) - n, dtype=np.float64)
        return out[key]

    def token_costs(self, texts: Texts) -> np.ndarray:
        """Log of the probability of each token, in the order of the texts."""
        out = self.head_costs(texts)
        out += self.tail_costs(texts)[texts.all_word]
        asked, hit, run, often = repeats(texts)
        p = self.again[run, often]
        return np.where(asked, np.where(hit, np.log(p), np.log(1 - p) + out), out)

    def costs(self, texts: Texts) -> np.ndarray:
        """log10 probability of each text."""
        return np.bincount(texts.all_doc, weights=self.token_costs(texts), minlength=len(texts.doc_ids)) / np.log(10)


def _tail_gate(odds: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    return _SURE4.take(odds[1][at].view(np.uint8)) + _SURE.take(odds[2][at].view(np.uint8))


def _before(values: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Of each token the sum of values of the tokens before it in its text."""
    total = np.cumsum(values) - values
    return total - np.repeat(total[fresh], np.diff(np.append(np.flatnonzero(fresh), len(values))))


def _rate_so_far(told: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    seen = _before(np.ones(len(told), np.int64), fresh)
    share = (_before(told.astype(np.int64), fresh) + 0.5) / (seen + 2)
    return np.minimum(RATES - 1, (share * RATES).astype(np.int32))


def repeats(texts: Texts) -> tuple[np.ndarray, ...]:
    """Of each token: whether its text has seen the previous word before, whether the word that followed it then comes again,
    and of the tokens before it in the text the run of hits and the rate of hits, in steps."""
    word, fresh = texts.all_word, texts.fresh
    n = len(word)
    key = texts.all_doc.astype(np.uint64) * np.uint64(len(texts.lens) + 1) + word.astype(np.uint64)
    order = _order(key)
    last = np.full(n, -1, dtype=np.int64)  # the place of the word before in its text
    key = key[order]
    same = key[1:] == key[:-1]
    last[order[1:][same]] = order[:-1][same]
    asked, follower = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
    at = np.flatnonzero(~fresh)
    at = at[last[at - 1] >= 0]
    asked[at], follower[at] = True, word[last[at - 1] + 1]
    hit = asked & (follower == word)
    # the run of hits just before a token
    place = np.arange(n)
    miss = np.maximum.accumulate(np.where(~hit | fresh, place, 0))
    run = np.zeros(n, dtype=np.int64)
    run[1:] = (place - miss)[:-1] + (hit & fresh)[:-1]
    run[fresh] = 0
    run = np.minimum(RUNS - 1, np.digitize(run, [1, 2, 4, 8, 16]))
    share = (_before(hit.astype(np.int64), fresh) + 0.2) / (_before(asked.astype(np.int64), fresh) + 2)
    return asked, hit, run, np.minimum(RATES - 1, (share * RATES).astype(np.int64))


def blank(code: Code, bits: tuple[int, ...], odds: list[np.ndarray]) -> Model:
    """A model that has learned nothing but its tables."""
    return Model(code, bits, odds, Mixer(16 * RATES, 4), Mixer(16, 3), again_of(np.zeros((2, RUNS, RATES))))


def again_of(told: np.ndarray) -> np.ndarray:
    """From how often it was asked, and hit, by run and rate. A rate that few texts showed stays near the steps' own meaning."""
    return (told[1] + 2 * (np.arange(RATES) + 0.5) / RATES) / (told[0] + 2)


def teach(model: Model, texts: Texts, told: np.ndarray) -> None:
    """Weights and maps learn from texts that the tables do not hold; adds to told how often a follower was asked for and hit."""
    asked, hit, run, often = repeats(texts)
    for k, which in enumerate((asked, hit)):
        told[k] += np.bincount(run[which] * RATES + often[which], minlength=RUNS * RATES).reshape(RUNS, RATES)
    times = np.minimum(np.bincount(texts.all_word, minlength=len(texts.lens)), 30).astype(np.float64)
    for s, n, _, odds, *bits in model._tails(texts, STEP_BYTES):
        if n.any():
            model.tail.learn(input_rows(odds), *bits, np.repeat(times[s], n))
    h = model.heads(texts)
    for a in range(0, len(h.rate), STEP_TOKENS):
        _, *bits = h.bits_of(texts, texts.pairs[a : a + STEP_TOKENS], h.rate[a : a + STEP_TOKENS])
        model.head.learn(*bits)


def learn(texts: Texts, code: Code, bits: tuple[int, ...], odds: list[np.ndarray]) -> Model:
    """A model whose weights and maps come from these texts, which the tables do not hold."""
    model, told = blank(code, bits, odds), np.zeros((2, RUNS, RATES))
    teach(model, texts, told)
    model.head.freeze(), model.tail.freeze()
    model.again = again_of(told)
    return model


# ---------------------------------------------------------------- tables


def gathered(batches: Iterator[pa.RecordBatch], limit: int, apart: bool = False) -> Iterator[Texts]:
    """Texts of about ``limit`` bytes from batches of doc_id, text and a flag; ``apart``: of one flag each."""
    open_: dict[bool | None, Texts] = {}
    for batch in batches:
        for flag in (False, True) if apart else (None,):
            part = batch if flag is None else batch.filter(pc.equal(batch.column(2), flag))
            ids, held = part.column(0).to_pylist(), part.column(2).to_pylist()
            for lo, hi, data, offs in text_slices(filled(part.column(1))):
                texts = open_.setdefault(flag, Texts())
                if texts.parts and (texts.bytes + len(data) > limit or len(texts.doc_ids) + hi - lo > MAX_CHUNK_DOCS):
                    texts.close()
                    yield texts
                    texts = open_[flag] = Texts()
                texts.add(ids[lo:hi], held[lo:hi], data, offs)
    for texts in open_.values():
        texts.close()
        yield texts


def byte_counts(train: DataFrame) -> np.ndarray:
    """How often each byte is coded: lower-cased, with a space after each word and an end mark after each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256, np.int64)
        for batch in batches:
            n[END[0]] += batch.num_rows
            for _, _, data, offs in text_slices(filled(batch.column(0))):
                shown = np.bincount(_LOWER[data], minlength=256)
                shown[SPACES] = 0
                n += shown
                inside = ~SPACES[data]
                begins = inside.copy()
                begins[1:] &= ~inside[:-1]
                edge = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(data))]
                begins[edge] = inside[edge]
                n[32] += int(begins.sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(n)], names=["byte", "n"])

    out = np.zeros(256, np.int64)
    for r in train.select("text").mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():  # 256 rows
        out[r["byte"]] = r["n"]
    return out


def fit(docs: DataFrame, text_bytes: int) -> Model:
    """Tables from all training texts; mixers and maps from all of them too, each half predicted from tables of the other."""
    spark = docs.sparkSession
    train = docs.where(~fold(7, 2)).select("doc_id", "text", (F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)) == 1).alias("half"))
    code, bits = prefix_code(byte_counts(train)), table_bits(text_bytes)
    starts = np.concatenate([[0], np.cumsum([2 << b for b in bits])])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves = [[np.zeros(2 << b, np.int32) for b in bits] for _ in range(2)]
        for texts in gathered(batches, COUNT_BYTES, apart=True):
            count_bits(texts, np.ones(len(texts.doc_ids), bool), code, bits, halves[texts.held[0]])
            del texts  # before the next ones are gathered
        for half, tables in enumerate(halves):
            for start, table in zip(starts, tables):
                blocks = table.reshape(-1, BLOCK)
                for b in np.flatnonzero(blocks.any(axis=1)):
                    at = np.flatnonzero(blocks[b])  # most slots of a share are empty
                    row = [int(start // BLOCK + b), half, at.astype("<u2").tobytes(), blocks[b][at].astype("<u4").tobytes()]
                    yield _batch([row], ["block", "half", "at", "counts"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None
        for batch in batches:
            for b, half, at, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if b != block:
                    if block is not None:
                        yield _odds_of(block, total)
                    block, total = b, np.zeros((2, BLOCK), np.float64)
                total[half, np.frombuffer(at, "<u2")] += np.frombuffer(counts, "<u4")
        if block is not None:
            yield _odds_of(block, total)

    def _odds_of(block: int, total: np.ndarray) -> pa.RecordBatch:
        odds = [log_odds(t).tobytes() for t in (*total, total.sum(axis=0))]
        return _batch([[block, *odds]], ["block", *names], [pa.int32(), *[pa.binary()] * 3])

    names = ["first", "second", "both"]
    tasks = max(-(-text_bytes // TASK_BYTES), min(spark.sparkContext.defaultParallelism, -(-text_bytes // LEAST_TASK_BYTES)), 1)
    parts = train.coalesce(tasks).mapInArrow(count, "block int, half int, at binary, counts binary")
    partitions = min(int(starts[-1]) // BLOCK, max(8, 4 * tasks))
    summed = parts.repartition(partitions, "block").sortWithinPartitions("block").mapInArrow(add, "block int, first binary, second binary, both binary")
    flat = np.zeros((3, int(starts[-1]) // 2), np.int8)
    for r in stored(summed, "contexts").collect():  # at most 2 ** MOST_BITS * 6 bytes
        for k, name in enumerate(names):
            flat[k, r["block"] * (BLOCK // 2) : (r["block"] + 1) * (BLOCK // 2)] = np.frombuffer(r[name], np.int8)
    first, second, both = ([f[a // 2 : b // 2] for a, b in zip(starts[:-1], starts[1:])] for f in flat)
    model = blank(code, bits, both)
    learned(train, blank(code, bits, first), blank(code, bits, second), model)
    return model


def learned(train: DataFrame, first: Model, second: Model, model: Model) -> None:
    """Gives the model weights and maps that tasks learn from their training texts, each predicted from tables of the half it is not in."""
    shared = train.sparkSession.sparkContext.broadcast((first.code, first.bits, first.odds, second.odds))  # at most 2 ** MOST_BITS * 4 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, bits, first_odds, second_odds = shared.value
        pupil, told = blank(code, bits, first_odds), np.zeros((2, RUNS, RATES))
        for texts in gathered(batches, CHUNK_BYTES, apart=True):
            pupil.odds = first_odds if texts.held[0] else second_odds
            teach(pupil, texts, told)
            del texts
        for kind, values in enumerate((*pupil.head.sums(), *pupil.tail.sums(), told.reshape(-1))):
            yield _batch([[kind, values.astype("<f8").tobytes()]], ["kind", "sums"], [pa.int32(), pa.binary()])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for kind, sums in zip(*(c.to_pylist() for c in batch.columns)):
                total[kind] = total.get(kind, 0) + np.frombuffer(sums, "<f8")
        for kind, values in total.items():
            yield _batch([[kind, values.tobytes()]], ["kind", "sums"], [pa.int32(), pa.binary()])

    schema = "kind int, sums binary"
    sums = {r["kind"]: np.frombuffer(r["sums"], "<f8").copy() for r in train.mapInArrow(run, schema).repartition(8, "kind").mapInArrow(add, schema).collect()}  # 5 rows
    if sums:
        model.head.mean_of([sums[0], sums[1]])
        model.tail.mean_of([sums[2], sums[3]])
        model.again = again_of(sums[4].reshape(2, RUNS, RATES))


# ---------------------------------------------------------------- chunks and buckets

CHUNKS = "chunk long, bucket int, words binary, train binary, doc_ids array<long>, held_out array<boolean>, n_words array<long>, n_bytes array<long>, scores array<double>, per_word binary, docs binary, times binary"
_NAMES = [x.strip().split(" ")[0] for x in CHUNKS.split(",")]
_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.list_(pa.int64())] * 2, pa.list_(pa.float64()), *[pa.binary()] * 3]
_OWN = len(_NAMES) - 4


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """In hash order."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _chunk_rows(texts: Texts, scores: np.ndarray, chunk: int, buckets: int) -> Iterator[list]:
    unique = texts.hash
    key, times = np.unique(texts.word * np.int64(1 << 16) + texts.doc, return_counts=True)
    word, doc = key >> 16, key & 0xFFFF
    training = ~np.array(texts.held, dtype=bool)
    train = np.bincount(word, weights=times * training[doc], minlength=len(unique)).astype("<u4")
    n_words = np.bincount(texts.doc, minlength=len(texts.doc_ids)).tolist()
    postings = [np.bincount(word, minlength=len(unique)).astype("<u2").tobytes(), doc.astype("<u2").tobytes(), times.astype("<u4").tobytes()]
    yield [chunk, None, None, None, texts.doc_ids, texts.held, n_words, texts.n_bytes, scores.tolist(), *postings]
    cut = np.searchsorted(_bucket(unique, buckets), np.arange(buckets + 1))
    for b in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        s = slice(cut[b], cut[b + 1])
        yield [chunk, b, unique[s].tobytes(), train[s].tobytes(), *[None] * _OWN]


def _batch(rows: list[list], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def chunked(docs: DataFrame, model: Model, buckets: int) -> DataFrame:
    """A row of documents, scores and postings for each chunk, and its words by bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of at most 2 ** MOST_BITS * 2 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, texts in enumerate(gathered(batches, CHUNK_BYTES)):
            for row in _chunk_rows(texts, shared.value.costs(texts), (part << 32) + i, buckets):
                yield _batch([row], _NAMES, _TYPES)
            del texts

    return docs.select("doc_id", "text", fold(7, 2).alias("held_out")).mapInArrow(run, CHUNKS)


_LEX = "bucket int, words binary, counts binary, tokens long, distinct long"
_LEX_NAMES = [x.strip().split(" ")[0] for x in _LEX.split(",")]
_LEX_TYPES = [pa.int32(), *[pa.binary()] * 2, pa.int64(), pa.int64()]


def lexicon(chunks: DataFrame, partitions: int) -> DataFrame:
    """For each bucket its distinct words in hash order, with their training counts. A bucket is added up as it comes, so
    that memory follows its distinct words."""

    def merged(h: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        unique, inverse = np.unique(np.concatenate(h), return_inverse=True)
        return unique, np.bincount(inverse, weights=np.concatenate(n), minlength=len(unique)).astype("<i8")

    def row(bucket: int, h: list, n: list) -> pa.RecordBatch:
        unique, counts = merged(h, n)
        return _batch([[bucket, unique.tobytes(), counts.tobytes(), int(counts.sum()), int((counts > 0).sum())]], _LEX_NAMES, _LEX_TYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, h, n, entries = None, [], [], 0
        for batch in batches:
            for b, words, train in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket:
                    if h:
                        yield row(bucket, h, n)
                    bucket, h, n, entries = b, [], [], 0
                h.append(np.frombuffer(words, np.uint64))
                n.append(np.frombuffer(train, "<u4"))
                entries += len(h[-1])
                if entries > max(MERGE_ENTRIES, 2 * len(h[0])):
                    unique, counts = merged(h, n)
                    h, n, entries = [unique], [counts], len(unique)
        if h:
            yield row(bucket, h, n)

    sent = chunks.where("bucket is not null").select("bucket", "words", "train")
    return stored(sent.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _LEX), "lexicon")


def _answers(chunks: DataFrame, lex: DataFrame, partitions: int) -> DataFrame:
    """chunk, bucket and the counts of the chunk's words, in hash order."""
    known = lex.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("chunk"), "words", "counts")
    asked = chunks.where("bucket is not null").select("bucket", F.lit(1).alias("kind"), "chunk", "words", F.lit(None).cast("binary").alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = counts = None
        for batch in batches:
            for b, k, chunk, w, n in zip(*(c.to_pylist() for c in batch.columns)):
                if k == 0:
                    words, counts = np.frombuffer(w, np.uint64), np.frombuffer(n, "<i8")
                    kind = "<i8" if len(counts) and int(counts.max()) >= 1 << 32 else "<u4"  # 8 bytes where a bucket needs them
                else:
                    got = counts[np.searchsorted(words, np.frombuffer(w, np.uint64))].astype(kind)
                    yield _batch([[chunk, b, got.itemsize, got.tobytes()]], ["chunk", "bucket", "width", "counts"], [pa.int64(), pa.int32(), pa.int32(), pa.binary()])

    both = known.union(asked).repartition(partitions, "bucket").sortWithinPartitions("bucket", "kind")
    return both.mapInArrow(run, "chunk long, bucket int, width int, counts binary")


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def language_model_scores(docs: DataFrame) -> DataFrame:
    """The columns of SCORES for each row of ``docs`` (doc_id, text); rows of the fold crc32(doc_id as text) mod 7 = 2 are
    held out, the others train."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"), F.coalesce(F.sum((~fold(7, 2)).cast("long")), F.lit(0)).alias("ends")).first()
    buckets, ends = min(MAX_BUCKETS, max(8, -(-size["n"] // BUCKET_BYTES))), int(size["ends"])
    chunks = stored(chunked(docs, fit(docs, size["n"]), buckets), "chunks")
    partitions = max(buckets, 2 * spark.sparkContext.defaultParallelism)
    lex = lexicon(chunks, partitions)
    total = lex.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    n, v = int(total["n"]) + ends, int(total["v"]) + (ends > 0)
    own_names = ["doc_ids", "held_out", "n_words", "n_bytes", "scores", "per_word", "docs", "times"]
    none = [F.lit(None).cast(t).alias(c) for c, t in zip(own_names, ["array<long>", "array<boolean>", "array<long>", "array<long>", "array<double>", *["binary"] * 3])]
    answers = _answers(chunks, lex, partitions)
    own = chunks.where("bucket is null").select("chunk", F.lit(1 << 30).alias("bucket"), F.lit(4).alias("width"), F.lit(None).cast("binary").alias("counts"), *own_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, at_chunk = [], None
        for batch in batches:
            for chunk, _, width, c, doc_ids, held, n_words, n_bytes, scores, per_word, docs_, times in zip(*(x.to_pylist() for x in batch.columns)):
                if chunk != at_chunk:
                    counts, at_chunk = [], chunk
                if c is not None:
                    counts.append(np.frombuffer(c, f"<u{width}"))
                    continue
                c = np.concatenate(counts or [np.zeros(0, np.uint32)]).astype(np.float64)
                word = np.repeat(np.arange(len(c)), np.frombuffer(per_word, "<u2"))
                doc, t = np.frombuffer(docs_, "<u2"), np.frombuffer(times, "<u4").astype(np.float64)
                m = len(doc_ids)
                known = np.bincount(doc, weights=t * (c[word] > 0), minlength=m) + (ends > 0)
                tokens = np.array(n_words, dtype=np.int64) + 1
                base = np.bincount(doc, weights=t * np.log10(c + 1)[word], minlength=m) + np.log10(ends + 1) - tokens * np.log10(n + v + 1)
                per_byte = -np.array(scores) * np.log2(10) / np.maximum(1, np.array(n_bytes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(tokens), pa.array(known.astype(np.int64)), pa.array(np.full(m, n, np.int64)), pa.array(base), pa.array(scores, pa.float64()), pa.array(per_byte)],
                    names=[x.strip().split(" ")[0] for x in SCORES.split(",")],
                )

    every = answers.select("chunk", "bucket", "width", "counts", *none).union(own)
    return every.repartition(2 * partitions, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(run, SCORES)
