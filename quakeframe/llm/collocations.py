"""Phrase collocations from a prefix-free parse.

Texts are split at punctuation and line ends into pieces, pieces into words. A window of ``OVERLAP`` words whose hash has a chosen
remainder is a trigger: it ends a chunk and begins the next, so that neighbours overlap by just these words. The same words always
trigger, so copies of a passage fall into the same chunks wherever they begin. Distinct chunks of a language form the dictionary, with
their frequencies in the parse. Phrases are counted inside distinct chunks, weighted by frequency; a phrase belongs to the chunk
that owns its first word, and the overlap's first words belong to the later chunk, so overlaps count once. An overlap of one word
less than the longest phrase leaves every phrase whole in the chunk that owns it.

Counting goes by length. Of phrases of n words only those are counted whose two parts of n - 1 words are frequent, as told by a
bitmap of two positions a frequent part: it may let rare phrases through but never holds a frequent one back. Counts by 64-bit hash come first, dealt by spans of hashes;
phrases in the next bitmap are then spelled out and counted again by their words, so results do not rest on hashes. After pairs are
known, the dictionary shrinks to runs of words all of whose pairs are frequent. All counts are combined in tasks before they move.

Scores are exact: products have 38 decimal digits and the quotient is a whole number.

Defined results: null and empty texts have no words; a null language is `und`, as is a language of that name; A-Z are lower-cased, nothing else; words
hold any character but space, tab and the marks that end pieces; repeated rows count each time; a text without marks is
one piece of any length; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _R, _RINV, SLICE_BYTES, Words, _power, filled, mix, new_folder, read_table, signed, stored, text_slices, tune

LONGEST, MIN_COUNT, TOP, DOMINANCE = 5, 100, 2000, 100
#: one window in TRIGGER ends a chunk
OVERLAP, TRIGGER = LONGEST - 1, 16
NO_LANG = "und"
#: bits of a bitmap for each frequent phrase, and the least and most bits, as powers of two
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 20, 30
#: spans of hashes for each shuffle partition, and phrases that a task spells before it gives them on
SPANS_EACH, MOST_SPELLED = 4, 400_000
#: keys that a task gathers before it combines them, and chunks of a batch (of at most 8 MB)
MOST_KEYS, CHUNKS = 1 << 21, 50_000
_BLANK, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_MARK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    """A 64-bit hash of each row's language."""
    coded = langs.dictionary_encode()
    known = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()]
    return np.array(known, np.uint64)[coded.indices.to_numpy(zero_copy_only=False)] if known else np.zeros(0, np.uint64)


# ---------------------------------------------------------------- parse


def _sections(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows before, bytes, offsets) of a slice; a long text comes in sections that end at marks, as no phrase crosses one."""
    if len(offs) > 2 or len(data) <= 2 * SLICE_BYTES:
        yield 0, data, offs
        return
    at = 0
    while at < len(data):
        end = at + SLICE_BYTES
        while end < len(data) and not (marks := np.flatnonzero(_MARK[data[end : end + SLICE_BYTES]])).size:
            end += SLICE_BYTES
        end = min(len(data), end + int(marks[0]) + 1) if end < len(data) else len(data)
        yield 0, data[at:end], np.array([0, end - at])
        at = end


class Parse:
    """The chunks of a slice of texts: text row, first word, word after the last, and how many first words each owns."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, overlap: int, trigger: int):
        self.data = _LOWER[data]
        self.words = w = Words(self.data, offs, lower=False, sep=_BLANK | _MARK)
        self.h = w.hash()
        n = len(w.starts)
        if not n:
            self.first = self.last = self.own = self.row = np.zeros(0, np.int64)
            return
        marks = np.concatenate([[0], np.cumsum(_MARK[data])])
        begins = np.ones(n + 1, bool)
        begins[1:n] = (w.doc[1:] != w.doc[:-1]) | (marks[w.starts[1:]] != marks[w.ends[:-1]])
        bounds = np.flatnonzero(begins)
        piece = np.cumsum(begins[:n]) - 1
        stop = bounds[1:][piece]
        starts = begins[:n].copy()
        k = n - overlap + 1
        if k > 1:
            acc = self.h[:k].copy()
            for j in range(1, overlap):
                acc = acc * np.uint64(_R) + self.h[j : j + k]
            # a trigger that ends its piece would begin a chunk without words of its own beyond the overlap
            starts[:k] |= (mix(acc) % np.uint64(trigger) == 0) & (np.arange(k) + overlap < stop[:k])
        self.first = np.flatnonzero(starts)
        following = np.append(self.first[1:], n)
        inside = following < stop[self.first]
        self.last = np.where(inside, np.minimum(following + overlap, stop[self.first]), stop[self.first])
        self.own = np.minimum(following, stop[self.first]) - self.first
        self.row = w.doc[self.first]

    def spelled(self, at: np.ndarray) -> pa.Array:
        """Chunks as words with one space between."""
        w = self.words
        first, last = self.first[at], self.last[at]
        count = last - first
        word = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        length = w.ends[word] - w.starts[word]
        place = np.concatenate([[0], np.cumsum(length + 1)])
        out = np.full(place[-1], 0x20, np.uint8)
        inside = np.repeat(place[:-1], length) + (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length))
        out[inside] = self.data[inside - np.repeat(place[:-1] - w.starts[word], length)]
        ends = np.cumsum(count)
        # the space after a chunk's last word goes
        keep = np.ones(len(out), bool)
        keep[place[ends] - 1] = False
        offsets = np.concatenate([[0], place[ends] - np.arange(1, len(ends) + 1)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(out[keep]))

    def keys(self) -> np.ndarray:
        """A 64-bit hash of each chunk's words and share."""
        n = len(self.h)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.h * _power(_R, n), out=sums[1:])
        h = (sums[self.last] - sums[self.first]) * _power(_RINV, n + 1)[self.first]
        return mix(h + (self.last - self.first).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + self.own.astype(np.uint64))


def dictionary(docs: DataFrame, lang: str = "lang", text: str = "text", overlap: int = OVERLAP, trigger: int = TRIGGER) -> DataFrame:
    """lang, chunk (words with single spaces), own (its first words that belong to it) and freq, its frequency in the parse."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = pc.fill_null(batch.column(0), NO_LANG)
            hashes = _lang_hashes(langs)
            for lo, _, data, offs in text_slices(filled(batch.column(1))):
                for _, part, at in _sections(data, offs):
                    parse = Parse(part, at, overlap, trigger)
                    if not len(parse.first):
                        continue
                    keys = mix(parse.keys() ^ hashes[lo + parse.row])
                    _, one, freq = _combined(keys, np.ones(len(keys), np.int64))
                    columns = [langs.take(pa.array(lo + parse.row[one])), parse.spelled(one), pa.array(parse.own[one]), pa.array(freq)]
                    yield pa.RecordBatch.from_arrays([columns[0], columns[1].cast(pa.string()), *columns[2:]], names=["lang", "chunk", "own", "freq"])

    rows = docs.select(lang, text).mapInArrow(run, "lang string, chunk string, own long, freq long")
    return rows.groupBy("lang", "chunk", "own").agg(F.sum("freq").alias("freq"))


# ---------------------------------------------------------------- counting


class Grams:
    """The phrases of a slice of dictionary chunks, by the place of their first word."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, own: np.ndarray, hashes: np.ndarray):
        self.data, self.words = data, Words(data, offs, lower=False, sep=_BLANK)
        self.h, self.doc = self.words.hash(), self.words.doc
        self.owned = np.arange(len(self.h)) - self.words.first[self.doc] < own[self.doc]
        self.hashes = hashes

    def keys(self, n: int) -> np.ndarray:
        """The key of the n words from each word on; those beyond the end of a chunk mean nothing."""
        k = len(self.h) - n + 1
        acc = self.h[:k].copy()
        for j in range(1, n):
            acc = acc * np.uint64(_R) + self.h[j : j + k]
        return mix(acc ^ self.hashes[self.doc[:k]] + np.uint64(n))

    def whole(self, n: int) -> np.ndarray:
        k = len(self.h) - n + 1
        return self.doc[:k] == self.doc[n - 1 :]


class Bitmap:
    """Which phrases may be frequent: never one that is frequent is missed."""

    def __init__(self, path: str, bits: int):
        self.bits = bits
        self.bytes = np.zeros(1 << (bits - 3), np.uint8)
        for row in read_table(path).to_pylist():
            self.bytes[row["bucket"] * 4096 : (row["bucket"] + 1) * 4096] = np.frombuffer(row["bitmap"], np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.bits) - 1)
        out = np.ones(len(keys), bool)
        for at in (keys & mask, (keys >> np.uint64(64 - MOST_BITS)) & mask):
            out &= self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0
        return out


_bitmaps: dict[str, Bitmap] = {}


def _bitmap(found: tuple[str, int] | None) -> Bitmap | None:
    if found and found[0] not in _bitmaps:
        while len(_bitmaps) > 1:
            _bitmaps.pop(next(iter(_bitmaps)))
        _bitmaps[found[0]] = Bitmap(*found)
    return _bitmaps[found[0]] if found else None


def _write_bitmap(keys: DataFrame) -> tuple[str, int]:
    """(folder, power of two of its bits) of the bitmap of the keys."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * max(1, keys.count()) - 1).bit_length()))
    mask = (1 << bits) - 1
    places = (F.col("key").bitwiseAND(mask), F.shiftrightunsigned("key", 64 - MOST_BITS).bitwiseAND(mask))
    at = keys.select(F.explode(F.array(*(x + 1 for x in places))).alias("at"))
    made = at.groupBy((F.bitmap_bucket_number("at") - 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    path = new_folder(keys.sparkSession, "phrase-bits")
    made.write.parquet(path)
    return path, bits


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Grams]]:
    own = batch.column(2).to_numpy(zero_copy_only=False)
    hashes = _lang_hashes(batch.column(0))
    for lo, hi, data, offs in text_slices(filled(batch.column(1))):
        yield lo, hi, Grams(data, offs, own[lo:hi], hashes[lo:hi])


def _combined(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, a place where it stands, and the sum of its weights."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(keys)
    ordered = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[begins], order[begins], np.add.reduceat(weights[order], begins)


class Spelled:
    """Phrases of a task with their sums; each is spelled once."""

    def __init__(self):
        self.known, self.texts, self.parts = np.zeros(0, np.uint64), {}, []

    def add(self, keys: np.ndarray, totals: np.ndarray, spell: Callable[[np.ndarray], Iterator[tuple[str, str]]]) -> None:
        at = np.searchsorted(self.known, keys)
        new = np.flatnonzero(self.known[np.minimum(at, max(0, len(self.known) - 1))] != keys) if len(self.known) else np.arange(len(keys))
        self.texts |= zip(keys[new].tolist(), spell(new))
        self.known = np.insert(self.known, at[new], keys[new])
        self.parts.append((keys, totals))

    def rows(self, spans: int) -> Iterator[pa.RecordBatch]:
        """A row for each span of hashes, with lists of its phrases."""
        if self.parts:
            keys, _, totals = _combined(*(np.concatenate(x) for x in zip(*self.parts)))
            some, edges = _spanned(keys, spans)
            got = [self.texts[k] for k in keys.tolist()]
            lists = {"lang": pa.array([x for x, _ in got], pa.string()), "phrase": pa.array([x for _, x in got], pa.string()), "freq": pa.array(totals)}
            yield _record({"span": some} | {c: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), x) for c, x in lists.items()}, len(some))
        self.__init__()


_COUNTED = {"span": pa.int32(), "lang": pa.list_(pa.string()), "phrase": pa.list_(pa.string()), "freq": pa.list_(pa.int64()), "keys": pa.binary(), "counts": pa.binary()}


def _record(values: dict, n: int) -> pa.RecordBatch:
    arrays = [x if isinstance(x := values.get(c), pa.Array) else pa.nulls(n, t) if x is None else pa.array(x, t) for c, t in _COUNTED.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(_COUNTED))


def _spanned(keys: np.ndarray, spans: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: the spans of hashes that hold some, and where each begins, and the end."""
    edges = np.searchsorted(_span(keys, spans), np.arange(spans + 1))
    some = np.flatnonzero(edges[1:] > edges[:-1])
    return some, np.append(edges[some], len(keys))


def _count(chunks: DataFrame, n: int, parts: tuple[str, int] | None, spell: bool, count: bool, least: int, spans: int) -> DataFrame:
    """One pass over the dictionary. With ``count``, phrases of n words whose parts of n - 1 words are in the bitmap ``parts``, as rows
    (span, keys, counts): about MOST_KEYS of a task's keys at a time, in one of ``spans`` equal spans of hashes, with counts that stop at ``least``, as no more is asked of them.
    With ``spell``, phrases of n - 1 words in the bitmap, spelled out and combined in the task, as rows (span, lists of lang, phrase and freq)."""
    most = np.uint64(least)
    width = "<u2" if least < 1 << 16 else "<u8"

    def counted(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, _, total = _combined(*(np.concatenate(x) for x in zip(*found)))
        some, edges = _spanned(keys, spans)
        total = np.minimum(total.astype(np.uint64), most).astype(width)
        blobs = [(keys[a:b].tobytes(), total[a:b].tobytes()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        return _record({"span": some, "keys": [x for x, _ in blobs], "counts": [x for _, x in blobs]}, len(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, spelled, found = _bitmap(parts), Spelled(), []
        for batch in batches:
            if not batch.num_rows:
                continue
            freq, langs = batch.column(3).to_numpy(zero_copy_only=False), batch.column(0)
            for lo, hi, grams in _slices(batch):
                if not len(grams.h):
                    continue
                inside = None
                if bitmap is not None and len(grams.h) >= n - 1:
                    keys = grams.keys(n - 1)
                    inside = bitmap.has(keys)
                    if spell:
                        at = np.flatnonzero(grams.whole(n - 1) & inside & grams.owned[: len(inside)])
                        got, one, total = _combined(keys[at], freq[lo:hi][grams.doc[at]])
                        w, first = grams.words, at[one]

                        def spell_out(new: np.ndarray, grams=grams, w=w, first=first, lo=lo, langs=langs) -> Iterator[tuple[str, str]]:
                            i = first[new]
                            named = langs.take(pa.array(lo + grams.doc[i])).to_pylist()
                            return ((x, grams.data[a:b].tobytes().decode()) for x, a, b in zip(named, w.starts[i].tolist(), w.ends[i + n - 2].tolist()))

                        spelled.add(got, total, spell_out)
                if count and len(grams.h) >= n:
                    ok = grams.whole(n) & grams.owned[: len(grams.h) - n + 1]
                    if n > 1:
                        ok &= inside[:-1] & inside[1:]
                    at = np.flatnonzero(ok)
                    found.append((grams.keys(n)[at], freq[lo:hi][grams.doc[at]]))
            if sum(len(x) for x, _ in found) >= MOST_KEYS:
                yield counted(found)
                found = []
            if len(spelled.known) >= MOST_SPELLED:
                yield from spelled.rows(spans)
        if found:
            yield counted(found)
        yield from spelled.rows(spans)

    return chunks.mapInArrow(run, "span int, lang array<string>, phrase array<string>, freq array<long>, keys binary, counts binary")


def _span(keys: np.ndarray, spans: int) -> np.ndarray:
    """Which of the equal spans of hashes a key is in; in the order of keys."""
    return ((keys >> np.uint64(32)) * np.uint64(spans) >> np.uint64(32)).astype(np.int64)


def _frequent_keys(counted: DataFrame, least: int) -> DataFrame:
    """The keys that reach ``least`` over all tasks; a span at a time."""
    width = "<u2" if least < 1 << 16 else "<u8"

    def add(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, "<u8") for x in table.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, width) for x in table.column("counts").to_pylist()]).astype(np.int64)
        keys, _, total = _combined(keys, counts)
        return pa.table({"key": pa.array(signed(keys[total >= least]), pa.int64())})

    return counted.where("keys IS NOT NULL").select("span", "keys", "counts").groupBy("span").applyInArrow(add, "key long")


def _frequent_words(counted: DataFrame, words: int, least: int) -> DataFrame:
    """lang, words, phrase and freq of the spelled phrases that reach ``least`` over all tasks, by their words; a span at a time."""

    def add(table: pa.Table) -> pa.Table:
        flat = pa.table({c: table.column(c).combine_chunks().flatten() for c in ("lang", "phrase", "freq")})
        found = flat.group_by(["lang", "phrase"]).aggregate([("freq", "sum")])
        found = found.filter(pc.greater_equal(found.column("freq_sum"), least))
        return pa.table({"lang": found.column("lang"), "phrase": found.column("phrase"), "freq": found.column("freq_sum")})

    spelled = counted.where("phrase IS NOT NULL").select("span", "lang", "phrase", "freq").groupBy("span")
    return spelled.applyInArrow(add, "lang string, phrase string, freq long").select("lang", F.lit(words).alias("words"), "phrase", "freq")


def _runs(chunks: DataFrame, pairs: tuple[str, int]) -> DataFrame:
    """The dictionary cut to runs of two words or more whose pairs are all in the bitmap; a run owns those of its first words that
    its chunk owned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = _bitmap(pairs)
        for batch in batches:
            freq, langs = batch.column(3).to_numpy(zero_copy_only=False), batch.column(0)
            for lo, hi, grams in _slices(batch):
                if len(grams.h) < 2:
                    continue
                on = np.zeros(len(grams.h) + 1, bool)
                on[1:-1] = grams.whole(2) & bitmap.has(grams.keys(2))
                # on[i]: words i - 1 and i are a pair
                first = np.flatnonzero(on[1:] & ~on[:-1])
                last = np.flatnonzero(~on[1:] & on[:-1]) + 1
                doc, w = grams.doc[first], grams.words
                sums = np.concatenate([[0], np.cumsum(grams.owned)])
                own = sums[last] - sums[first]
                some = np.flatnonzero(own > 0)
                text = [grams.data[a:b].tobytes().decode() for a, b in zip(w.starts[first[some]].tolist(), w.ends[last[some] - 1].tolist())]
                columns = [langs.take(pa.array(lo + doc[some])), pa.array(text, pa.string()), pa.array(own[some]), pa.array(freq[lo:hi][doc[some]])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "chunk", "own", "freq"])

    rows = chunks.mapInArrow(run, "lang string, chunk string, own long, freq long")
    return rows.groupBy("lang", "chunk", "own").agg(F.sum("freq").alias("freq"))


def frequent_phrases(chunks: DataFrame, longest: int = LONGEST, least: int = MIN_COUNT) -> DataFrame:
    """lang, words (how many), phrase and freq of all phrases of 1 to ``longest`` words found at least ``least`` times, from a stored dictionary."""
    spark = chunks.sparkSession
    spans = SPANS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = chunks.select("lang", "chunk", "own", "freq")
    spelled, bits = [], None
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(CHUNKS))
    for n in range(1, longest + 2):
        counted = stored(_count(chunks, n, bits, n > 1, n <= longest, least, spans), f"phrases-{n}")
        if n > 1:
            spelled.append(_frequent_words(counted, n - 1, least))
        if n <= longest:
            bits = _write_bitmap(stored(_frequent_keys(counted, least), "phrase-keys"))
        if n == 2:
            chunks = stored(_runs(chunks, bits), "phrase-runs")
    out = spelled[0]
    for more in spelled[1:]:
        out = out.unionByName(more)
    tune(spark)
    return out


# ---------------------------------------------------------------- scores


def _part(first: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice("each", first, length), " ")


def scored(phrases: DataFrame, totals: DataFrame, dominance: int = DOMINANCE) -> DataFrame:
    """lang, phrase, a, l, r, n and score of phrases of two words or more that no longer phrase stands for."""
    phrases = phrases.select("lang", "words", "phrase", F.col("freq").alias("a"))
    found = phrases.where("words > 1").withColumn("each", F.split("phrase", " "))
    # a longer phrase of as many occurrences has parts of all lengths between, so those of one word more tell all
    longer = found.where("words > 2").select("lang", "a", F.explode(F.array(_part(1, F.col("words") - 1), _part(2, F.col("words") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = found.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.lit(100) * F.col("most") < F.lit(dominance) * F.col("a")))
    cuts = kept.select("lang", "phrase", "words", "a", "each", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(1, F.col("k")).alias("head"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    count = lambda name, freq: phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(freq))
    cuts = cuts.join(count("head", "l"), ["lang", "head"]).join(count("tail", "r"), ["lang", "tail"]).join(totals, "lang")
    wide = lambda c: c.cast("decimal(19,0)")
    over, under = wide(F.col("a") * 1000) * wide(F.col("n")), wide(F.col("l")) * wide(F.col("r"))
    cuts = cuts.withColumns({"over": over, "under": under}).withColumn("score", F.expr("over div under"))
    low = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x"))
    return low.select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = MIN_COUNT, top: int = TOP, dominance: int = DOMINANCE, trigger: int = TRIGGER
) -> DataFrame:
    """The ``top`` phrases of each language by score, then count, then phrase: lang, rank, phrase, a, l, r, n, score."""
    chunks = stored(dictionary(docs, overlap=longest - 1, trigger=trigger), "phrase-dictionary")
    totals = stored(chunks.groupBy("lang").agg(F.sum(F.col("freq") * F.col("own")).alias("n")), "phrase-totals")
    phrases = stored(frequent_phrases(chunks, longest, least), "phrases")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(phrases, totals, dominance).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
