"""Quality rules with an isolation forest.

Rule statistics of each whole text (words, symbols, repeated lines and word windows) feed isolation forests: trees of
random splits grown on all rows labelled good and, with a small weight, all unlabelled ones, the mean path
length giving an anomaly score. Many statistics dilute what sets junk apart, so one forest is grown for each of a few
sets of statistics (VIEWS); all labelled rows calibrate the threshold of each, and the forest that separates them best while
rejecting few good rows is used.

Rows are dealt to the trees, so that each teaches as many trees as give a tree ``PER_TREE`` rows, and at least one. All trees grow by a level in a round: tasks
find ranges and weights of their rows at each open node, these are put together, and the driver draws the splits. Thresholds come from
counts by score, ranged over all tasks.

Defined results: a null or empty text has zero counts and fails the base rule (fewer than 10 words); without labels
of both kinds nothing is rejected beyond the base rule; repeated rows get equal verdicts; each row of a repeated id
counts; columns named like the results, in any case, are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, Words, filled, mix, stored, text_slices, tune, with_columns, _R

SAMPLE_ROWS, SAMPLE_LABELS, TREES, PER_TREE = 8192, 20000, 100, 256
STRIDE, SPANS = 37, 32  # between the trees that a row teaches; and parts that the nodes of a level are put together in
MAX_GOOD_REJECTED, UNLABELLED_SHARE, LEAST_UNLABELLED = 0.005, 0.03, 32
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[list(b".,;:!?")] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True


#: columns of ratios()
VIEWS = [[0, 1, 2, 3, 4, 5, 6, 7], [0, 1, 2, 3, 5], [0, 1, 5, 7], [0, 1, 5]]


def _per_doc(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask)])
    return sums[offs[1:]] - sums[offs[:-1]]


def _seen_before(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal to an earlier one of its document, equal to any other one of it)."""
    order = np.lexsort((np.arange(len(key)), key, doc))
    k, d = key[order], doc[order]
    same = np.zeros(len(k), dtype=bool)
    same[1:] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    both = same.copy()
    both[:-1] |= same[1:]
    earlier, other = np.zeros(len(k), bool), np.zeros(len(k), bool)
    earlier[order], other[order] = same, both
    return earlier, other


def statistics(col: pa.Array) -> np.ndarray:
    """Rows of COUNTS followed by lines, distinct words, punctuation, digits, capitals and characters."""
    out = np.zeros((len(col), 11), dtype=np.int64)
    for lo, hi, data, offs in text_slices(col):
        words = Words(data, offs, lower=False)
        n, h = hi - lo, words.hash()
        o = out[lo:hi]
        o[:, 0] = np.diff(words.first)
        first_byte = (data & 0xC0) != 0x80
        o[:, 1] = _per_doc(first_byte & ~SPACES[data], offs)
        o[:, 2] = _per_doc(_SYMBOL[data], offs)
        lines = Words(data, offs, lower=False, sep=_NEWLINE)
        ink = np.concatenate([[0], np.cumsum(~SPACES[data])])
        has_word = ink[lines.ends] > ink[lines.starts]
        line_doc = lines.doc[has_word]
        earlier, _ = _seen_before(lines.hash(lines.starts[has_word], lines.ends[has_word]), line_doc)
        o[:, 3] = np.bincount(line_doc[earlier], minlength=n)
        k = len(h) - 4
        if k > 0:
            whole = np.flatnonzero(words.doc[:k] == words.doc[4:])
            acc = h[:k].copy()
            for j in range(1, 5):
                acc = acc * np.uint64(_R) + h[j : j + k]
            _, again = _seen_before(mix(acc)[whole], words.doc[whole])
            cover = np.zeros(len(h) + 1, dtype=np.int64)
            at = whole[again]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + 5, -1)
            o[:, 4] = np.bincount(words.doc[np.cumsum(cover[:-1]) > 0], minlength=n)
        o[:, 5] = np.bincount(line_doc, minlength=n)
        word_earlier, _ = _seen_before(h, words.doc)
        o[:, 6] = o[:, 0] - np.bincount(words.doc[word_earlier], minlength=n)
        for j, table in ((7, _PUNCT), (8, _DIGIT), (9, _UPPER)):
            o[:, j] = _per_doc(table[data], offs)
        o[:, 10] = _per_doc(first_byte, offs)
    return out


def ratios(s: np.ndarray) -> np.ndarray:
    """What the forest splits on."""
    words, chars, lines = np.maximum(s[:, 0], 1), np.maximum(s[:, 1], 1), np.maximum(s[:, 5], 1)
    return np.stack(
        [s[:, 1] / words, s[:, 2] / words, s[:, 3] / lines, s[:, 4] / words, np.minimum(s[:, 0] / lines, 200.0), s[:, 7] / words, s[:, 8] / chars, s[:, 9] / chars],
        axis=1,
    ).astype(np.float64)


@dataclass
class Forest:
    feature: np.ndarray  # trees x nodes; -1: leaf
    split: np.ndarray
    depth: np.ndarray  # path length at a leaf, with the expected rest
    scale: float
    threshold: float
    view: list[int]


def _expected(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among rows of weight n."""
    n = np.asarray(n, dtype=np.float64)
    more = np.maximum(n, 2.0)
    return np.where(n <= 2, np.maximum(n - 1, 0.0), np.maximum(1.0, 2 * (np.log(more - 1) + np.euler_gamma) - 2 * (more - 1) / more))


class Growth:
    """Trees of all views, grown level by level: a tree's first node is 1, and node i has the children 2 i and 2 i + 1."""

    def __init__(self, height: int, trees: int = TREES, seed: int = 1):
        self.trees, self.height, self.level, self.rng = trees, height, 0, np.random.default_rng(seed)
        shape = (len(VIEWS) * trees, 2 ** (height + 1))
        self.feature, self.split, self.depth = np.full(shape, -1, np.int8), np.zeros(shape), np.zeros(shape)

    def places(self, x: np.ndarray, tree: np.ndarray) -> np.ndarray:
        """The node that each row has come to in its tree."""
        rows, node = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
        while True:
            f = self.feature[tree, node]
            inner = f >= 0
            if not inner.any():
                return node
            node = np.where(inner, 2 * node + (x[rows, np.maximum(f, 0)] > self.split[tree, node]), node)

    def tally(self, x: np.ndarray, weight: np.ndarray, row: np.ndarray, copies: int) -> tuple[np.ndarray, ...]:
        """Open nodes that rows have come to, as tree * nodes of the level + place, with the lowest and highest statistics and the weight of each."""
        width, got = 1 << self.level, []
        for c in range(copies):
            bag = (row % np.uint64(self.trees)).astype(np.int64) + c * STRIDE
            for v in range(len(VIEWS)):
                tree = v * self.trees + bag % self.trees
                node = self.places(x, tree)
                at = np.flatnonzero(node >= width)
                got.append(together(tree[at] * width + node[at] - width, x[at], x[at], weight[at]))
        return together(*(np.concatenate(g) for g in zip(*got)))

    def add_level(self, key: np.ndarray, low: np.ndarray, high: np.ndarray, weight: np.ndarray) -> None:
        """Closes the level's nodes or draws their splits, from what all rows told."""
        width, level = 1 << self.level, self.level
        tree, node = key // width, key % width + width
        self.depth[:, width : 2 * width] = level
        self.depth[tree, node] += _expected(weight)
        if level < self.height:
            shown = np.zeros((len(VIEWS), low.shape[1]), dtype=bool)
            for v, view in enumerate(VIEWS):
                shown[v, view] = True
            chance = np.where((weight[:, None] > 1) & (high > low) & shown[tree // self.trees], self.rng.random(low.shape), -1.0)
            drawn, part = np.argmax(chance, axis=1), self.rng.random(len(key))
            can, i = chance.max(axis=1) >= 0, np.arange(len(key))
            self.feature[tree[can], node[can]] = drawn[can]
            self.split[tree[can], node[can]] = (low[i, drawn] + part * (high[i, drawn] - low[i, drawn]))[can]
        self.level += 1

    def forests(self, mass: float) -> list[Forest]:
        """A forest for each view, whose trees hold rows of so much weight."""
        of_view = [slice(v * self.trees, (v + 1) * self.trees) for v in range(len(VIEWS))]
        return [Forest(self.feature[s], self.split[s], self.depth[s], max(float(_expected(mass)), 1e-9), np.inf, VIEWS[0]) for s in of_view]


def together(key: np.ndarray, low: np.ndarray, high: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry for each key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    if not len(first):
        return key, low, high, weight
    return key[first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first), np.add.reduceat(weight[order], first)


def anomaly(forest: Forest, x: np.ndarray) -> np.ndarray:
    """2 ** (-mean path / expected path): near 1 is anomalous."""
    x = x[:, forest.view]
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, split, depth in zip(forest.feature, forest.split, forest.depth):
        node = np.ones(len(x), dtype=np.int64)
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                break
            node = np.where(inner, 2 * node + (x[rows, np.maximum(f, 0)] > split[node]), node)
        total += depth[node]
    return 2.0 ** (-(total / len(forest.feature)) / forest.scale)


def calibrate(scored: DataFrame, most: float = MAX_GOOD_REJECTED) -> dict[int, tuple[float, float]]:
    """From rows of view, score and whether good: for each view the threshold (scores above it are rejected) with the largest difference of
    rejected shares, bad less good, at which at most ``most`` of the good rows are rejected, and that difference. A view that none helps is left out."""
    levels = scored.groupBy("view", "score").agg(F.count_if(~F.col("good")).alias("bad"), F.count_if("good").alias("fine"))
    # scores are ranged over the tasks, each of which holds few of them; a range's sums follow from the ranges before
    ranged = levels.repartitionByRange("view", "score").withColumn("part", F.spark_partition_id())
    levels = stored(ranged, "levels")
    sums = levels.groupBy("view", "part").agg(F.sum("bad").alias("b"), F.sum("fine").alias("f"))
    view = Window.partitionBy("view")
    before = lambda c: F.coalesce(F.sum(c).over(view.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("view", "part", before("b").alias("bad_before"), before("f").alias("fine_before"), F.sum("b").over(view).alias("n_bad"), F.sum("f").over(view).alias("n_fine"))
    within = Window.partitionBy("view", "part").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    shares = levels.select("view", "part", "score", F.sum("bad").over(within).alias("bad"), F.sum("fine").over(within).alias("fine")).join(F.broadcast(sums), ["view", "part"])  # a row for each range and view
    above = lambda n, before_, total: 1 - (F.col(n) + F.col(before_)) / F.col(total)
    shares = shares.where("n_bad > 0 and n_fine > 0").select("view", "score", above("bad", "bad_before", "n_bad").alias("b"), above("fine", "fine_before", "n_fine").alias("f"))
    best = shares.where((F.col("f") <= most) & (F.col("b") > F.col("f"))).groupBy("view").agg(F.max(F.struct(F.col("b") - F.col("f"), -F.col("score"))).alias("m"))
    return {r["view"]: (-r["m"][1], r["m"][0]) for r in best.collect()}  # a row for each view


def sampled(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_labels: int = SAMPLE_LABELS) -> DataFrame:
    """doc_id, good (null: unlabelled) and text of at most sample_rows + sample_labels rows, for a look at them: forests and thresholds come from all rows."""
    order = F.xxhash64(F.col("doc_id"))
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(order, "doc_id").limit(sample_rows).withColumn("good", F.lit(None).cast("int"))
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    known = known.orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(sample_labels)
    # at most sample_rows + sample_labels ids
    # one text of an id; rows of one id are reduced before a shuffle
    of_ids = docs.select("doc_id", "text").join(F.broadcast(ids.unionByName(known)), "doc_id")
    return of_ids.groupBy("doc_id", "good").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Of each row that passes the base rule a hash, its ratios and good (1, 0; null: unlabelled), stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = statistics(filled(batch.column(1)))
            usual = np.flatnonzero(~_base_failed(s))
            x = ratios(s[usual])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.reshape(-1)))
            at = pa.array(usual)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), lists], names=["doc_id", "row", "x"])

    tune(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row")).mapInArrow(run, f"doc_id {id_type}, row long, x array<double>")
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    return stored(made.join(known, "doc_id", "left").select("row", "x", "good"), "ratios")


def _ratios_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


_TALLY = "span int, key binary, low binary, high binary, weight binary"


def _told(span: int, sums: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([span], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in sums)], names=[c.split(" ")[0] for c in _TALLY.split(", ")])


def _tally_of(row: dict) -> tuple[np.ndarray, ...]:
    key = np.frombuffer(row["key"], np.int64)
    low, high = (np.frombuffer(row[c], np.float64).reshape(len(key), -1) for c in ("low", "high"))
    return key, low, high, np.frombuffer(row["weight"], np.float64)


def grown(rows: DataFrame, good: int, plain: int, trees: int = TREES, per_tree: int = PER_TREE) -> list[Forest]:
    """A forest for each view from all rows labelled good, with all unlabelled ones, or from the latter alone if fewer than two are good."""
    share = min(1.0, max(LEAST_UNLABELLED, UNLABELLED_SHARE * good) / max(1, plain)) if good >= 2 else 1.0
    rows = rows.where("good is null or good = 1") if good >= 2 else rows.where("good is null")
    n, mass = (good + plain, good + share * plain) if good >= 2 else (plain, float(plain))
    copies = max(1, min(trees, -(-per_tree * trees // n)))
    in_tree = mass * copies / trees
    growth = Growth(max(1, int(np.ceil(np.log2(max(2, min(per_tree, in_tree)))))), trees)
    for _ in range(growth.height + 1):
        shared = rows.sparkSession.sparkContext.broadcast(growth)  # trees of a bounded number of nodes

        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            so_far, whole = [], None
            for batch in batches:
                weight = np.where(batch.column("good").is_null().to_numpy(zero_copy_only=False), share, 1.0)
                so_far.append(shared.value.tally(_ratios_of(batch), weight, batch.column("row").to_numpy().view(np.uint64), copies))
                if len(so_far) == 16:
                    so_far = [together(*(np.concatenate(g) for g in zip(*so_far)))]
            if so_far:
                whole = together(*(np.concatenate(g) for g in zip(*so_far)))
                span = whole[0] * SPANS // (len(VIEWS) * trees << shared.value.level)
                cut = np.searchsorted(span, np.arange(SPANS + 1))
                for i in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                    yield _told(i, tuple(a[cut[i] : cut[i + 1]] for a in whole))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, tuple[np.ndarray, ...]] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    parts = [_tally_of(row), *([total[row["span"]]] if row["span"] in total else [])]
                    total[row["span"]] = together(*(np.concatenate(g) for g in zip(*parts)))
            for span, sums in total.items():
                yield _told(span, sums)

        told = rows.select("row", "x", "good").mapInArrow(tell, _TALLY).repartition(SPANS, "span").mapInArrow(add, _TALLY)
        got = sorted(told.collect(), key=lambda r: r["span"])  # an entry for each node of the level
        growth.add_level(*(np.concatenate(g) for g in zip(*map(_tally_of, got))))
    return growth.forests(in_tree)


def fit(docs: DataFrame, labels: DataFrame) -> Forest | None:
    """Grows forests on all rows and calibrates them on all labelled ones."""
    rows = labelled(docs, labels)
    n = rows.agg(F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("good").isNull()).alias("plain")).first()
    if (n["good"] if n["good"] >= 2 else n["plain"]) < 2:
        return None
    forests = grown(rows, n["good"], n["plain"])
    shared = rows.sparkSession.sparkContext.broadcast(forests)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = _ratios_of(batch), pa.array(batch.column("good").to_numpy(zero_copy_only=False) == 1)
            for v, forest in enumerate(shared.value):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), v, np.int32)), pa.array(anomaly(forest, x)), good], names=["view", "score", "good"])

    found = calibrate(rows.where("good is not null").select("x", "good").mapInArrow(score, "view int, score double, good boolean"))
    best = max(sorted(found), key=lambda v: found[v][1], default=0)
    if found:
        forests[best].threshold = float(found[best][0])
    return forests[best]


def _base_failed(s: np.ndarray) -> np.ndarray:
    return (s[:, 0] < 10) | (100 * s[:, 4] > 20 * s[:, 0])


FIELDS = [T.StructField(c, T.LongType(), False) for c in COUNTS] + [
    T.StructField("base_failed", T.BooleanType(), False),
    T.StructField("anomaly", T.DoubleType(), False),
    T.StructField("kept", T.BooleanType(), False),
]


def judge(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """All columns of ``docs`` with COUNTS, base_failed, anomaly and kept."""

    def make(col: pa.Array) -> list[pa.Array]:
        s = statistics(col)
        failed = _base_failed(s)
        score = anomaly(forest, ratios(s)) if forest else np.zeros(len(s))
        kept = ~failed & (score <= (forest.threshold if forest else np.inf))
        return [*(pa.array(s[:, j]) for j in range(5)), pa.array(failed), pa.array(score), pa.array(kept)]

    return with_columns(docs, FIELDS, make)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, fit(docs, labels))
