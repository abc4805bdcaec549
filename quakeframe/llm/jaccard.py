"""N-gram Jaccard join with set-relation skipping.

Sets of 5-word shingles are linked when their Jaccard similarity is at least 0.8; every document gets the smallest
doc_id that links reach. Two relations between sets save work:

* Index level. Tokens are ordered by corpus frequency (rare first), only the prefix of a set that must hold a shared
  token is indexed, and each index list is kept in blocks of equal set size, sorted by token position. Whole blocks are
  skipped by size, the rest of a block from the first position at which the remaining tokens cannot reach the overlap.
* Answer level. Equal sets share one answer. Of highly similar sets, a leader's answers come first: in each list the set
  with the most frequent tokens, which is what many near copies were made from, is compared with the others, and what
  these links connect is never paired again in any list. A member keeps its differences to its leader (tokens gone and
  tokens new). A further set is compared with the leader once; from that overlap and the differences follow the answers of
  all members: most by their numbers alone, the rest by looking the few differing tokens up.

Shingles are 64-bit hashes made from the text's bytes. A class is the rows of one set; it is known by the set's hash, never by a
doc_id. No step holds all pairs of a group: first each list gives one pair for each member and its leader, then pairs between
different components only, a bounded number at a time; a list longer than ``MAX_LIST`` is split into sub-lists which hold every
pair.

Defined results: null or wordless texts have empty sets, link with nothing and are their own component; texts of fewer than
five words are one shingle; a row without a doc_id is linked like any other and named by the ids it reaches; rows with equal
ids are separate documents; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, filled, mix, read_table, shingle_hashes, small, stored, stored_at, text_slices, tune, unused, with_columns

PERCENT, SKETCH_BITS = 80, 1024
COUNT_BITS, BLOCK = 20, 4096
MAX_LIST, LOOKUP_ROWS, LIST_BYTES, MOST_PAIRS = 20_000, 1_000_000, 8 << 20, 1 << 20


def enough(a: int, b: int, common: int) -> bool:
    return 100 * common >= PERCENT * (a + b - common)


def needed(a, b):
    """Least common tokens of sets of a and b tokens."""
    return -((-PERCENT * (a + b)) // (100 + PERCENT))


def prefix(n: int) -> int:
    """Tokens of a set of n that must hold one shared with any similar set."""
    return n - -(-PERCENT * n // 100) + 1


def shingle_sets(col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) of each text."""
    for lo, hi, data, offs in text_slices(col):
        h, doc = shingle_hashes(Words(data, offs, lower=True))
        first = np.searchsorted(doc, np.arange(hi - lo + 1))
        for d in range(hi - lo):
            yield lo + d, np.unique(h[first[d] : first[d + 1]])


def set_id(s: np.ndarray) -> int:
    """The same for equal sets: a sum of mixed hashes."""
    return int(mix(mix(s ^ np.uint64(0x1234567)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


# ---------------------------------------------------------------- first pass: sets and frequencies


def _first_pass(docs: DataFrame) -> DataFrame:
    """A row for each document (n, cid) and, for each task, blocks of token counts (block, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << COUNT_BITS, np.int64), set()
        for batch in batches:
            ids, n, cid, marks, new = batch.column(0), [], [], [], []
            for _, s in shingle_sets(filled(batch.column(1))):
                n.append(len(s))
                cid.append(set_id(s) if len(s) else None)
                marks.append(sketch(s) if len(s) else None)
                if len(s) and cid[-1] not in seen:
                    seen.add(cid[-1])
                    new.append((s >> np.uint64(64 - COUNT_BITS)).astype(np.int64))
            if new:
                counts += np.bincount(np.concatenate(new), minlength=len(counts))
            blank = [None] * len(n)
            yield _rows(ids, n, cid, marks, blank, blank)
        used = counts.reshape(-1, BLOCK)
        at = np.flatnonzero(used.any(axis=1))
        blobs = [np.minimum(used[b], 65535).astype("<u2").tobytes() for b in at]
        blank = [None] * len(at)
        yield _rows(pa.nulls(len(at), pa.int64()), blank, blank, blank, at.tolist(), blobs)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, cid long, sketch array<long>, block int, counts binary")


def _rows(ids, n, cid, marks, block, counts) -> pa.RecordBatch:
    arrays = [ids, pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(marks, pa.list_(pa.int64())), pa.array(block, pa.int32()), pa.array(counts, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "cid", "sketch", "block", "counts"])


def sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parities of a set's tokens, as longs."""
    odd = np.bincount((s & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that sketches do not rule out, with sizes: every parity in which two sets differ is a token of one alone, so
    sets of so few common tokens are never similar. No similar pair is lost."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    total = F.col("n_a") + F.col("n_b")
    most = (total - apart) / 2
    return met.where(most >= F.ceil(F.lit(PERCENT) * total / F.lit(100 + PERCENT))).drop("s_a", "s_b")


def _frequencies(first: DataFrame) -> np.ndarray:
    """Counts of tokens by their first bits: a table of fixed size, summed block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block not in sums:
                    sums[block] = np.zeros(BLOCK, np.int64)
                sums[block] += np.frombuffer(blob, "<u2")
        blobs = [np.minimum(x, (1 << 32) - 1).astype("<u4").tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(blobs, pa.binary())], names=["block", "counts"])

    out = np.zeros((1 << COUNT_BITS) // BLOCK * BLOCK, np.uint32).reshape(-1, BLOCK)
    parts = (1 << COUNT_BITS) // BLOCK // 8
    rows = first.where("block is not null").select("block", "counts").repartition(parts, "block").mapInArrow(run, "block int, counts binary")
    for r in rows.collect():  # 4 MB, whatever the input
        out[r["block"]] = np.frombuffer(r["counts"], "<u4")
    return out.reshape(-1)


# ---------------------------------------------------------------- verification


def _sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """cid and sorted tokens of the wanted classes, each once. Texts are found by the smallest doc_id of a class; rows that share
    it with other sets are left out by their set's own hash."""
    wanted = small(wanted.distinct().join(classes.select("cid", "rep", "rows"), "cid").select(F.col("cid").alias("asked"), "rep", "rows"), LOOKUP_ROWS)
    found = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(set_id(s), s.tobytes()) for _, s in shingle_sets(filled(batch.column(0))) if len(s)]
            ids, blobs = zip(*got) if got else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], names=["cid", "tokens"])

    sets = stored(found.mapInArrow(run, "cid long, tokens binary").join(wanted, F.col("cid") == F.col("asked")).select("cid", "tokens", "rows"), "tokens")
    # only classes of several rows can have come more than once
    again = sets.where("rows > 1").groupBy("cid").agg(F.any_value("tokens").alias("tokens"))
    return sets.where("rows = 1").select("cid", "tokens").union(again)


def _tokens(col: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in col.to_pylist()]


def _star_links(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (leader, cid) those that are similar, with the tokens that the member lacks (gone) and adds (new)."""
    pairs = stars.join(sets, "cid").join(sets.select(F.col("cid").alias("leader"), F.col("tokens").alias("lead_tokens")), "leader")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r, (own, lead) in enumerate(zip(_tokens(batch.column(2)), _tokens(batch.column(3)))):
                shared = _within(own, lead)
                if enough(len(own), len(lead), int(shared.sum())):
                    rows.append((r, lead[~_within(lead, own)].tobytes(), own[~shared].tobytes()))
            at, gone, new = zip(*rows) if rows else ((), (), ())
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(gone, pa.binary()), pa.array(new, pa.binary())], names=["leader", "cid", "gone", "new"])

    return stored(pairs.select("leader", "cid", "tokens", "lead_tokens").mapInArrow(run, "leader long, cid long, gone binary, new binary"), "star-links")


def _within(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which of ``few`` are in the sorted ``many``."""
    if not len(few) or not len(many):
        return np.zeros(len(few), dtype=bool)
    at = np.minimum(np.searchsorted(many, few), len(many) - 1)
    return many[at] == few


def _derived_links(pairs: DataFrame, links: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs (a, b), with sizes n_a and n_b, those that are similar. b meets a's leader once; a's answer follows from that overlap and from what sets
    a apart from its leader."""
    member = links.groupBy("cid").agg(F.min_by(F.struct("leader", "gone", "new"), "leader").alias("m")).select("cid", "m.*")
    member = stored(member, "members")
    apart = member.select(F.col("cid").alias("a"), "leader", (F.octet_length("gone") / 8).cast("long").alias("n_gone"), (F.octet_length("new") / 8).cast("long").alias("n_new"))
    asked = pairs.join(apart, "a", "left").withColumns({"leader": F.coalesce("leader", "a"), "n_gone": F.coalesce("n_gone", F.lit(0)), "n_new": F.coalesce("n_new", F.lit(0))})
    asked = stored(asked, "asked")
    sets = _sets(asked.select(F.col("leader").alias("cid")).union(asked.select("b")), docs, classes)
    named = lambda name: sets.select(F.col("cid").alias(name), F.col("tokens").alias(f"tokens_{name}"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = [int(_within(x, y).sum()) for x, y in zip(_tokens(batch.column(2)), _tokens(batch.column(3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64())], names=["leader", "b", "met"])

    met = asked.select("leader", "b").distinct().join(named("b"), "b").join(named("leader"), "leader")
    met = met.select("leader", "b", "tokens_leader", "tokens_b").mapInArrow(meet, "leader long, b long, met long")
    known = stored(asked.join(met, ["leader", "b"]), "answers")
    need = F.ceil(F.lit(PERCENT) * (F.col("n_a") + F.col("n_b")) / F.lit(100 + PERCENT))
    sure = known.where(F.col("met") - F.col("n_gone") >= need).select("a", "b")
    open_ = known.where((F.col("met") - F.col("n_gone") < need) & (F.col("met") + F.col("n_new") >= need))
    open_ = open_.join(member.select(F.col("cid").alias("a"), "gone", "new"), "a").join(named("b"), "b")

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, met_, *_ = (batch.column(i).to_pylist() for i in (2, 3, 4))
            keep = []
            for r, (gone, new, own) in enumerate(zip(*(_tokens(batch.column(i)) for i in (5, 6, 7)))):
                common = met_[r] - int(_within(gone, own).sum()) + int(_within(new, own).sum())
                keep.append(enough(n_a[r], n_b[r], common))
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    told = open_.select("a", "b", "n_a", "n_b", "met", "gone", "new", "tokens_b").mapInArrow(derive, "a long, b long")
    return stored(sure.union(told), "derived-links")


# ---------------------------------------------------------------- components


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """cid and label of every class with a link: each round joins every node to its smallest neighbour and contracts the
    links, until none is left. Labels are hashes, so the links shrink by a factor each round, whatever the shape."""
    spark = links.sparkSession
    edges = links.select("a", "b").where("a <> b")
    labels = stored(edges.select(F.col("a").alias("cid")).union(edges.select("b")).distinct().withColumn("label", F.col("cid")), "labels")
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        least = stored(least, "least")
        if least.isEmpty():
            break
        m1, m2 = least.select("a", F.col("to").alias("a2")), least.select(F.col("a").alias("b"), F.col("to").alias("b2"))
        edges = edges.join(m1, "a").join(m2, "b").where("a2 <> b2")
        edges = edges.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        edges = stored(edges, "edges")
        labels = labels.join(least.select(F.col("a").alias("label"), "to"), "label", "left")
        labels = stored(labels.select("cid", F.coalesce("to", "label").alias("label")), "labels")
    else:
        raise RuntimeError("components did not settle")
    return labels


# ---------------------------------------------------------------- second pass: index lists


def _entries(docs: DataFrame, counts: np.ndarray, buckets: int) -> DataFrame:
    """Blobs of index entries by bucket. An entry is (token, cid, size, position, weight), the weight being how frequent the
    set's tokens are; a token's entries meet in one bucket, or in each pair of its sub-lists if there are more than
    MAX_LIST. Tokens share the counters of the fixed table, so a token's own count is its counter less a usual one: in
    a large corpus every counter is high, and only those far above it hold a long list."""
    table = docs.sparkSession.sparkContext.broadcast(counts)  # fixed size
    usual = int(np.median(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, seen = table.value, set()
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            token, *rest = (np.concatenate(x) for x in zip(*held))
            bucket = (token % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(buckets + 1))
            used = np.flatnonzero(at[1:] > at[:-1])
            short = (token // np.uint64(buckets)).astype(np.uint32)
            blobs = [_encoded([short, *rest], order[at[b] : at[b + 1]]) for b in used]
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "entries"])

        for batch in batches:
            for _, s in shingle_sets(filled(batch.column(1))):
                if not len(s) or (cid := set_id(s)) in seen:
                    continue
                seen.add(cid)
                f = freq[(s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                p = prefix(len(s))
                # rare first, then by hash
                edge = np.partition(f, p - 1)[p - 1]
                pool = np.flatnonzero(f <= edge)
                order = pool[np.lexsort((s[pool], f[pool]))][:p]
                token, fx, pos = mix(s[order] + np.uint64(77)), f[order].astype(np.int64), np.arange(p)
                common = fx > 1
                token, fx, pos = token[common], fx[common], pos[common]  # a token of one set only pairs nothing
                lists = np.maximum(1, -(-(fx - usual) // MAX_LIST))
                if (lists > 1).any():
                    token, pos = _split(token, pos, lists, cid)
                m, weight = len(token), int(1000 * np.log1p(f).mean())
                held.append([token, np.full(m, cid, np.int64), np.full(m, len(s), np.uint32), pos.astype(np.uint32), np.full(m, weight, np.uint32)])
                size += 24 * m
                if size >= LIST_BYTES:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, "bucket int, entries binary")


_ENTRY = ("<u4", "<i8", "<u4", "<u4", "<u4")  # token, cid, size, position, weight


def _encoded(columns: list[np.ndarray], rows: np.ndarray) -> bytes:
    return b"".join(c[rows].astype(kind).tobytes() for c, kind in zip(columns, _ENTRY))


def _decoded(blobs: list[bytes]) -> list[np.ndarray]:
    parts = []
    for blob in blobs:
        n, at, part = len(blob) // 24, 0, []
        for kind in _ENTRY:
            part.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
        parts.append(part)
    return [np.concatenate(x) for x in zip(*parts)]


def _split(token: np.ndarray, pos: np.ndarray, lists: np.ndarray, cid: int) -> tuple[np.ndarray, np.ndarray]:
    """Entry x of a token with s lists goes to list {own, t} for each t below s: any two entries meet in one."""
    out_t, out_p = [token[lists == 1]], [pos[lists == 1]]
    for t, p, s in zip(token[lists > 1], pos[lists > 1], lists[lists > 1].tolist()):
        own, other = cid % s, np.arange(s)
        low, high = np.minimum(own, other), np.maximum(own, other)
        out_t.append(mix(t + (low * s + high + 1).astype(np.uint64)))
        out_p.append(np.full(s, p))
    return np.concatenate(out_t), np.concatenate(out_p)


def _lists(entries: DataFrame, partitions: int) -> DataFrame:
    """A row for each bucket with its lists of two or more sets, so that later rounds need no shuffle."""

    def merged(bucket: int, blobs: list[bytes]) -> tuple[int, bytes] | None:
        columns = _decoded(blobs)
        order = np.lexsort((columns[1], columns[0]))
        token, cid = columns[0][order], columns[1][order]
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])  # a set met by several tasks is one entry
        order, token = order[new], token[new]
        alone = np.ones(len(token) + 1, dtype=bool)
        alone[1:-1] = token[1:] != token[:-1]
        keep = order[~(alone[:-1] & alone[1:])]
        return (bucket, _encoded(columns, keep)) if len(keep) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []

        def done() -> Iterator[pa.RecordBatch]:
            row = merged(bucket, blobs) if blobs else None
            if row:
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.binary())], names=["bucket", "entries"])

        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b != bucket:
                    yield from done()
                    bucket, blobs = b, []
                blobs.append(blob)
        yield from done()

    moved = entries.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return moved.mapInArrow(run, "bucket int, entries binary")


def _candidates(lists: DataFrame, labels: tuple[DataFrame, str] | None) -> DataFrame:
    """Pairs (a, b) of sets that a list cannot rule out: without labels of a leader (a) and a member, else of sets of different
    components. Labels are only of linked sets; tasks read them from the shared folder while they are counted to be few, else
    they are joined to the lists."""

    def batch_of(found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found[:, i]) for i in range(2)], names=["a", "b"])

    if labels is None:

        def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column(1).to_pylist():
                    yield batch_of(star_pairs(*_decoded([blob])))

        return lists.mapInArrow(lead, "a long, b long")

    table, path = labels

    def pairs(blob: bytes, cids: np.ndarray, comps: np.ndarray) -> Iterator[np.ndarray]:
        token, cid, n, pos, _ = _decoded([blob])
        comp = cid.copy()
        if len(cids):
            at = np.minimum(np.searchsorted(cids, cid), len(cids) - 1)
            comp = np.where(cids[at] == cid, comps[at], cid)
        yield from list_pairs(token, cid, comp, n, pos)

    if table.count() <= LOOKUP_ROWS:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = read_table(path)
            cids, comps = (known[c].to_numpy() for c in ("cid", "label"))
            order = np.argsort(cids)
            for batch in batches:
                for blob in batch.column(1).to_pylist():
                    for found in pairs(blob, cids[order], comps[order]):
                        yield batch_of(found)

        return lists.mapInArrow(run, "a long, b long")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cid = np.unique(_decoded([blob])[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cid), bucket, np.int32)), pa.array(cid)], names=["bucket", "cid"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                known = np.array([(x["cid"], x["label"]) for x in known or []], dtype=np.int64).reshape(-1, 2)
                known = known[np.argsort(known[:, 0])]
                for found in pairs(blob, known[:, 0], known[:, 1]):
                    yield batch_of(found)

    # labels of a bucket's sets: as many as its lists hold
    named = lists.mapInArrow(sets, "bucket int, cid long").join(table.select("cid", "label"), "cid")
    named = named.groupBy("bucket").agg(F.collect_list(F.struct("cid", "label")).alias("known"))
    return lists.join(named, "bucket", "left").select("entries", "known").mapInArrow(joined, "a long, b long")


def list_pairs(token: np.ndarray, cid: np.ndarray, comp: np.ndarray, n: np.ndarray, pos: np.ndarray) -> Iterator[np.ndarray]:
    """Candidate pairs of a bucket's lists between components, about MOST_PAIRS at a time. Entries are sorted by token, size and
    position, so that a list is a row of blocks of equal size; blocks are skipped by size, and the rest of a block by position."""
    if not len(token):
        return
    # lists within one component connect nothing new
    order = np.argsort(token, kind="stable")
    token, cid, comp = token[order], cid[order], comp[order]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    mixed = np.minimum.reduceat(comp, start) != np.maximum.reduceat(comp, start)
    keep = np.repeat(mixed, np.diff(np.append(start, len(token))))
    order, token, cid, comp = order[keep], token[keep], cid[keep], comp[keep]
    n, pos = n[order].astype(np.int64), pos[order].astype(np.int64)
    if not len(token):
        return
    order = np.lexsort((pos, n, token))
    token, cid, comp, n, pos = token[order], cid[order], comp[order], n[order], pos[order]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    stop = np.append(start[1:], len(token))
    held, size = [], 0

    def merged() -> np.ndarray:
        pairs = np.concatenate(held)
        pairs.sort(axis=1)
        return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)

    two = np.flatnonzero(stop - start == 2)
    i, j = start[two], start[two] + 1
    need = needed(n[i], n[j])
    ok = (comp[i] != comp[j]) & (100 * n[i] >= PERCENT * n[j]) & (n[i] - pos[i] >= need) & (n[j] - pos[j] >= need)
    held.append(np.stack([cid[i[ok]], cid[j[ok]]], axis=1))
    for a, b in zip(start[stop - start > 2].tolist(), stop[stop - start > 2].tolist()):
        sizes, first = np.unique(n[a:b], return_index=True)
        first = np.append(first, b - a) + a
        for x, size_x in enumerate(sizes.tolist()):
            last = int(np.searchsorted(sizes, size_x * 100 // PERCENT, side="right"))
            for y in range(x, last):  # the other blocks are skipped by size
                least = needed(size_x, int(sizes[y]))
                # entries from these positions on are skipped
                cut_x = first[x] + int(np.searchsorted(pos[first[x] : first[x + 1]], size_x - least, side="right"))
                cut_y = first[y] + int(np.searchsorted(pos[first[y] : first[y + 1]], int(sizes[y]) - least, side="right"))
                if cut_x == first[x] or cut_y == first[y]:
                    continue
                left, right = slice(first[x], cut_x), slice(first[y], cut_y)
                for i, j in _unlike(comp[left], comp[right], same=x == y):
                    held.append(np.stack([cid[left][i], cid[right][j]], axis=1))
                    size += len(i)
                    if size >= MOST_PAIRS:
                        yield merged()
                        held, size = [], 0
    if held:
        yield merged()


def _unlike(x: np.ndarray, y: np.ndarray, same: bool = False, cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all x[i] != y[j], compared a bounded piece at a time; with ``same``, where y is x, each pair in one order. The commonest
    value of y is not compared with itself: most of a long list is one component."""
    values, n = np.unique(y, return_counts=True)
    most = values[np.argmax(n)]
    others = np.flatnonzero(y != most)
    for rows, columns, ordered in ((np.flatnonzero(x == most), others, False), (np.flatnonzero(x != most), others if same else np.arange(len(y)), same)):
        step = max(1, cells // max(1, len(columns)))
        for a in range(0, len(rows) if len(columns) else 0, step):
            at = rows[a : a + step]
            later = columns[np.searchsorted(columns, at[0], side="right") :] if ordered else columns
            unlike = x[at][:, None] != y[later][None, :]
            if ordered:
                unlike &= at[:, None] < later[None, :]
            i, j = np.nonzero(unlike)
            yield at[i], later[j]


def star_pairs(token: np.ndarray, cid: np.ndarray, n: np.ndarray, pos: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of each list in a bucket the pairs (leader, member) that it cannot rule out; the leader has the most frequent tokens."""
    if not len(token):
        return np.zeros((0, 2), np.int64)
    order = np.lexsort((cid, -weight.astype(np.int64), token))
    token, cid, n, pos = token[order], cid[order], n[order].astype(np.int64), pos[order].astype(np.int64)
    first = np.concatenate([[True], token[1:] != token[:-1]])
    lead = np.maximum.accumulate(np.where(first, np.arange(len(token)), 0))
    need = needed(n, n[lead])
    ok = ~first & (100 * np.minimum(n, n[lead]) >= PERCENT * np.maximum(n, n[lead])) & (n - pos >= need) & (n[lead] - pos[lead] >= need)
    return np.unique(np.stack([cid[lead[ok]], cid[ok]], axis=1), axis=0)


# ---------------------------------------------------------------- operator


def _groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, cid) of each row, and cid, root, component_id and links_found of each class."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select("doc_id", "text")
    first = stored(_first_pass(docs), "sets")
    rows = first.where("block is null").select("doc_id", "n", "cid")
    of_class = first.where("cid is not null").groupBy("cid")
    classes = stored(of_class.agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.any_value("sketch").alias("sketch")), "classes")
    counts = _frequencies(first)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    lists = stored(_lists(_entries(docs, counts, 4 * partitions), partitions), "lists")

    met = stored(_candidates(lists, None).distinct(), "stars")
    stars = stored(_possible(met, classes).select(F.col("a").alias("leader"), F.col("b").alias("cid")), "possible-stars")
    links = _star_links(stars, _sets(stars.select("cid").union(stars.select("leader")), docs, classes))
    labels, path = stored_at(components(links.select(F.col("leader").alias("a"), F.col("cid").alias("b"))), "labels")

    tried = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = stored(_candidates(lists, (labels, path)).distinct().join(tried, ["a", "b"], "left_anti"), "candidates")
    found = stored(_possible(found, classes), "possible")
    more = _derived_links(found, links, docs, classes)
    # the second links join components of the first
    name = {s: labels.select(F.col("cid").alias(s), F.col("label").alias(f"l{s}")) for s in "ab"}
    joined = more.join(name["a"], "a", "left").join(name["b"], "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    upper = components(joined.where("a <> b").distinct())
    top = labels.join(upper.select(F.col("cid").alias("label"), F.col("label").alias("up")), "label", "left").select("cid", F.coalesce("up", "label").alias("root"))
    top = top.union(upper.join(labels.select("cid"), "cid", "left_anti").select("cid", F.col("label").alias("root")))

    roots = classes.join(top, "cid", "left").select("cid", "rep", F.coalesce("root", "cid").alias("root"))
    least = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    every = links.select(F.col("leader").alias("cid")).union(links.select("cid")).union(more.select("a")).union(more.select("b"))
    degree = every.groupBy("cid").agg(F.count(F.lit(1)).alias("links_found"))
    return rows, stored(roots.join(least, "root").join(degree, "cid", "left").select("cid", "root", "component_id", F.coalesce("links_found", F.lit(0)).alias("links_found")), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and links_found of each row of ``docs``. links_found counts the links of its class that were
    met while components were spanned, not all similar classes."""
    rows, groups = _groups(docs)
    return rows.join(groups, "cid", "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("links_found", F.lit(0)).alias("links_found")
    )


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """``docs`` less all but one row of each group of linked documents: the row with the smallest doc_id (none comes last), of rows
    that share it the one with the smallest set hash, of rows equal in both any one. Rows without words stay."""
    rows, groups = _groups(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cid")
    placed = rows.join(groups.select("cid", "root"), "cid")
    best = placed.groupBy("root").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("root", "best")
    # of each class in a group of several rows: the doc_id that stays, if it is the class of the row that stays
    stays = F.col("cid") == F.col("best.cid")
    met, id_, cid, stay, many = unused(docs, "__met", "__id", "__cid", "__stay", "__many")
    hit = (placed["cid"] == F.col("best.cid")) & placed["doc_id"].eqNullSafe(F.col("best.doc_id"))
    told = placed.join(best, "root").groupBy("cid").agg(F.bool_or(stays).alias(stay), F.max("best.doc_id").alias(id_), (F.count_if(hit) > 1).alias(many))
    told = small(told.select(F.col("cid").alias(met), stay, id_, many), LOOKUP_ROWS)

    def made(col: pa.Array) -> list[pa.Array]:
        return [pa.array([set_id(s) if len(s) else None for _, s in shingle_sets(col)], pa.int64())]

    marked = with_columns(docs, [T.StructField(cid, T.LongType())], made).join(told, F.col(cid) == F.col(met), "left")
    kept = marked.where(F.col(met).isNull() | (F.col(stay) & F.col("doc_id").eqNullSafe(F.col(id_))))
    columns = list(docs.columns)
    if told.where(F.col(stay) & F.col(many)).isEmpty():
        return kept.select(columns)
    repeated = F.coalesce(F.col(many), F.lit(False))
    return kept.where(~repeated).select(columns).union(kept.where(repeated).dropDuplicates([cid]).select(columns))
