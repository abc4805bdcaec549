"""Benchmark decontamination by pigeonhole edit matching.

A test item of m bytes may differ from a passage by k = floor(``BUDGET`` * m) edits. Cut into k + 1 pieces, at least one
piece must occur unchanged, so a rolling hash finds exact piece hits in the whole text; each hit gives a window, which must
hold enough of the item's 5-grams (an edit spoils at most five). Windows of an item that overlap are verified as one, with Myers'
bit-parallel distance, so a text that repeats a piece all along is gone through once.

Both sides are compared with A-Z lower-cased and any white space as one space each; lengths and edits count UTF-8 bytes.
Items are read in blocks of about ``BLOCK_BYTES``; up to ``PASS_BLOCKS`` blocks are held against all documents in one pass where they
lie, without a shuffle. Pieces are looked up by their first bytes in a few classes of width, and hits are taken a bounded
number at a time.

Defined results: null and empty items match nothing; an item of fewer than ``LEAST_BYTES`` bytes is no evidence within a longer
text, so it matches a text that is nothing else (outer white space aside); null and empty texts have no leaks; repeated items are reported under
each of their ids; equal rows give equal rows; with no items every document is clean; an empty table gives no rows; a
column named like the result, in any case, is replaced.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, byte_values, text_slices, unused, with_columns, without, _power, _R, _RINV

BUDGET, BLOCK_BYTES, PASS_BLOCKS, GRAM = 0.1, 4 << 20, 8, 5
LEAST_BYTES, WIDTHS, MOST_HITS, MOST_KEPT = 8, (8, 5, 3, 2, 1), 1 << 19, 256
_GATE_BITS = 22
LEAKS = T.StructField("leaks", T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType())])), False)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[SPACES] = 32
_VALUES = byte_values(True, seed=11)
_VALUES[SPACES] = _VALUES[32]


def fold_bytes(text: str) -> bytes:
    return _FOLD[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)].tobytes()


def budget(m: int, share: float = BUDGET) -> int:
    return math.floor(share * m + 1e-9)


def piece_cuts(m: int, k: int) -> list[tuple[int, int]]:
    """(first, after the last) of k + 1 pieces of almost equal length."""
    at = [m * i // (k + 1) for i in range(k + 2)]
    return list(zip(at, at[1:]))


class Myers:
    """Smallest edit distance of a pattern to any part of a text."""

    def __init__(self, pattern: bytes):
        self.m, self.masks = len(pattern), defaultdict(int)
        for i, c in enumerate(pattern):
            self.masks[c] |= 1 << i
        self.masks = dict(self.masks)

    def distance(self, text: bytes) -> int:
        full, top = (1 << self.m) - 1, 1 << (self.m - 1)
        pv, mv, score, best = full, 0, self.m, self.m
        get = self.masks.get
        for c in text:
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best = score
            ph = (ph << 1) & full
            mh = (mh << 1) & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
        return best


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * _power(_R, len(data)), out=out[1:])
    return out


def _rolled(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` bytes."""
    n = len(sums) - width
    return (sums[width:] - sums[:n]) * _power(_RINV, len(sums))[:n] if n > 0 else np.zeros(0, np.uint64)


class Pieces:
    """Pieces of at least ``width`` bytes by the hash of their first ones."""

    def __init__(self, width: int, pieces: list[tuple[int, int, int]], texts: list[bytes]):
        self.width = width
        item, at, end = (np.array(x, dtype=np.int64) for x in zip(*pieces))
        head, full = np.zeros(len(item), np.uint64), np.zeros(len(item), np.uint64)
        for j, (i, a, b) in enumerate(pieces):
            s = _sums(np.frombuffer(texts[i], np.uint8)[a:b])
            head[j], full[j] = s[width], s[-1]
        order = np.argsort(head, kind="stable")
        self.item, self.at, self.size, self.full = item[order], at[order], (end - at)[order], full[order]
        self.keys, first = np.unique(head[order], return_index=True)
        self.first = np.append(first, len(head))
        self.gate = np.zeros(1 << _GATE_BITS, dtype=bool)
        self.gate[(self.keys >> np.uint64(64 - _GATE_BITS)).astype(np.int64)] = True

    def hits(self, sums: np.ndarray, offs: np.ndarray):
        """(piece, position, document) of whole pieces inside one document, at most about MOST_HITS candidates at a time."""
        h = _rolled(sums, self.width)
        pos = np.flatnonzero(self.gate[(h >> np.uint64(64 - _GATE_BITS)).astype(np.int64)])
        key = np.minimum(np.searchsorted(self.keys, h[pos]), len(self.keys) - 1)
        true = self.keys[key] == h[pos]
        pos, key = pos[true], key[true]
        n = self.first[key + 1] - self.first[key]
        total = np.cumsum(n)
        a = 0
        while a < len(pos):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + MOST_HITS, side="right")))
            m = n[a:b]
            at, piece = np.repeat(pos[a:b], m), np.repeat(self.first[key[a:b]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            doc = np.searchsorted(offs, at, side="right") - 1
            end = at + self.size[piece]
            inside = end <= offs[doc + 1]
            at, piece, doc, end = at[inside], piece[inside], doc[inside], end[inside]
            true = (sums[end] - sums[at]) * _power(_RINV, len(sums))[at] == self.full[piece]
            if true.any():
                yield piece[true], at[true], doc[true]
            a = b


def _runs(new: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """(first, after the last) of windows that overlap or meet, from windows in order; ``new`` begins another item."""
    first = np.flatnonzero(new | np.concatenate([[True], lo[1:] > hi[:-1]]))
    return list(zip(first.tolist(), np.append(first[1:], len(lo)).tolist()))


class Index:
    """The pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], share: float):
        self.ids, self.texts = [], []
        self.short: dict[bytes, list[int]] = defaultdict(list)
        for item_id, text in items:
            folded = fold_bytes(text or "")
            if len(folded) >= LEAST_BYTES and folded.strip():
                self.ids.append(item_id)
                self.texts.append(folded)
            elif folded.strip():
                self.short[folded.strip()].append(item_id)
        self.k = np.array([budget(len(t), share) for t in self.texts], dtype=np.int64)
        self.m = np.array([len(t) for t in self.texts], dtype=np.int64)
        by_width: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for i, t in enumerate(self.texts):
            for a, b in piece_cuts(len(t), int(self.k[i])):
                by_width[next(w for w in WIDTHS if w <= b - a)].append((i, a, b))
        self.pieces = [Pieces(w, by_width[w], self.texts) for w in sorted(by_width, reverse=True)]
        self._grams: dict[int, np.ndarray] = {}
        self._myers: dict[int, Myers] = {}

    def grams(self, i: int) -> np.ndarray:
        if i not in self._grams:
            if len(self._grams) >= MOST_KEPT:
                self._grams.clear()
            table = np.zeros(1 << 16, dtype=bool)
            table[(_rolled(_sums(np.frombuffer(self.texts[i], np.uint8)), GRAM) >> np.uint64(48)).astype(np.int64)] = True
            self._grams[i] = table
        return self._grams[i]

    def myers(self, i: int) -> Myers:
        if i not in self._myers:
            if len(self._myers) >= MOST_KEPT:
                self._myers.clear()
            self._myers[i] = Myers(self.texts[i])
        return self._myers[i]

    def leaks(self, data: np.ndarray, offs: np.ndarray) -> dict[int, dict[int, int]]:
        """For each document with leaks: item_id and smallest distance."""
        out: dict[int, dict[int, int]] = defaultdict(dict)
        if self.short:
            ink = np.concatenate([[0], np.cumsum(~SPACES[data])])
            for d in np.flatnonzero(ink[offs[1:]] - ink[offs[:-1]] < LEAST_BYTES).tolist():
                for i in self.short.get(_FOLD[data[offs[d] : offs[d + 1]]].tobytes().strip(), ()):
                    out[d][i] = 0
        sums, grams, folded = _sums(data) if self.pieces else None, None, None
        found: dict[tuple[int, int], int] = {}
        for pieces in self.pieces:
            if len(data) < pieces.width:
                continue
            for piece, pos, doc in pieces.hits(sums, offs):
                item = pieces.item[piece]
                lo = np.maximum(offs[doc], pos - pieces.at[piece] - self.k[item])
                hi = np.minimum(offs[doc + 1], pos - pieces.at[piece] + self.m[item] + self.k[item])
                # of windows cut off at a text's ends many begin, or end, at one place
                order = np.lexsort((hi, lo, item, doc))
                doc, item, lo, hi = doc[order], item[order], lo[order], hi[order]
                again = np.zeros(len(doc), bool)
                again[1:] = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1])
                same = again.copy()
                same[1:] &= (lo[1:] == lo[:-1]) & (hi[1:] == hi[:-1])
                doc, item, lo, hi, again = doc[~same], item[~same], lo[~same], hi[~same], again[~same]
                for x, y in _runs(~again, lo, hi):
                    d, i = int(doc[x]), int(item[x])
                    k, m = int(self.k[i]), int(self.m[i])
                    if found.get((d, i)) == 0:
                        continue
                    need = m - GRAM + 1 - k * GRAM
                    if need > 0 and grams is None:
                        grams = (_rolled(sums, GRAM) >> np.uint64(48)).astype(np.uint16)
                    if y - x == 1:
                        a, b = int(lo[x]), int(hi[x])
                        if b - a >= m - k and (need <= 0 or np.count_nonzero(self.grams(i)[grams[a : max(a, b - GRAM + 1)]]) >= need):
                            folded = _FOLD[data] if folded is None else folded
                            distance = self.myers(i).distance(folded[a:b].tobytes())
                            if distance < found.get((d, i), k + 1):
                                found[d, i] = distance
                        continue
                    a, b = lo[x:y], hi[x:y]
                    held = b - a >= m - k
                    if need > 0:
                        first = int(a[0])
                        count = np.concatenate([[0], np.cumsum(self.grams(i)[grams[first : max(first, int(b[-1]) - GRAM + 1)]])])
                        begin, end = (np.minimum(x - first, len(count) - 1) for x in (a, np.maximum(a, b - GRAM + 1)))
                        held &= count[end] - count[begin] >= need
                    if not held.any():
                        continue
                    a, b = a[held], b[held]
                    if folded is None:
                        folded = _FOLD[data]
                    for x, y in _runs(np.arange(len(a)) == 0, a, b):
                        distance = self.myers(i).distance(folded[a[x] : b[y - 1]].tobytes())
                        if distance < found.get((d, i), k + 1):
                            found[d, i] = distance
        for (d, i), distance in found.items():
            out[d][self.ids[i]] = min(distance, out[d].get(self.ids[i], distance))
        return out


def _flag(docs: DataFrame, blocks: list[list[tuple[int, str]]], share: float) -> DataFrame:
    ready: list[Index] = []

    def make(col: pa.Array) -> list[pa.Array]:
        if not ready:
            ready.extend(Index(items, share) for items in blocks)
        found: list[list[dict]] = [[] for _ in range(len(col))]
        for index in ready:
            for lo, _, data, offs in text_slices(col):
                for d, hits in index.leaks(data, offs).items():
                    found[lo + d] += ({"item_id": i, "distance": x} for i, x in hits.items())
        for rows in found:
            rows.sort(key=lambda r: (r["item_id"], r["distance"]))
        return [pa.array(found, pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())])))]

    return with_columns(docs, [LEAKS], make)


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = BUDGET, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` with leaks: the items found in the text and their smallest distances."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    out = without(docs, ["leaks"])
    (earlier,) = unused(out, "__leaks")
    for first in range(0, blocks, PASS_BLOCKS):
        # about PASS_BLOCKS * block_bytes of items at a time
        mine = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
        rows = items.withColumn("block", mine).where(F.col("block").between(first, first + PASS_BLOCKS - 1)).collect()
        held = [sorted((r["item_id"], r["text"]) for r in rows if r["block"] == b) for b in range(first, min(blocks, first + PASS_BLOCKS))]
        flagged = _flag(out.withColumnRenamed("leaks", earlier) if first else out, held, share)
        out = flagged.withColumn("leaks", F.array_sort(F.concat(earlier, "leaks"))).drop(earlier) if first else flagged
    return out
