"""A Merkle manifest of a dataset, kept as a persistent tree that copies paths.

Every row is a leaf, the SHA-256 of its fields. Leaves of a language ascend by doc_id; two consecutive nodes at a time become their
parent until one is left, the subroot; subroots, ordered by language, give the root in the same way.

The tree is built in aligned blocks of 2 ** ``LEVELS`` nodes: the leaves of a block give its top in one task, tops are the nodes of
the next round, and so on, so no task holds more than a block. A change of a leaf makes a version of the tree that shares all
untouched nodes and copies the leaf's ancestors alone: those within its block in the block's task, those above by the path of the
block's top, which is worked out once for each block, from the root down. Versions of a block meet its path alone, so upper levels, which
every version passes, are dealt over tasks by block.

Defined results: null fields are `-`; a language is one group, null languages another, first; rows without a doc_id come first and are never
changed; rows with equal ids are leaves of their own, by the leaf's digest; adding to a null n_chars leaves it null, so that row's
version equals the tree; a lone leaf is its group's subroot; an empty table gives no rows; of further columns, whatever their
names, those in ``keep`` pass through, less those named like the results.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, ranked, small, stored

#: levels of a block of 1024 nodes
LEVELS = 10
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
RESULTS = ["leaf", "subroot", "root", "siblings", "copied", "verified"]


def digest(data: str) -> str:
    return sha256(data.encode()).hexdigest()


def leaf_hash(columns: dict[str, Column] | None = None) -> Column:
    """The leaf of a row: each field as its count of UTF-8 bytes, a colon and its value. ``columns`` stand for fields of those names."""
    parts = []
    for name in FIELDS:
        value = (columns or {}).get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


# ---------------------------------------------------------------- one block


class Block:
    """The nodes of a block by level; position 0 is the block's first leaf. It is never changed: ``version`` gives new nodes."""

    def __init__(self, leaves: list[str], levels: int):
        self.levels = [leaves]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([digest("".join(below[i : i + 2])) for i in range(0, len(below), 2)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def siblings(self, at: int) -> list[str]:
        """For each level the sibling of the node above leaf ``at``: `<` and the hash of a left one, `>` and that of a right one, or ``""``."""
        out = []
        for nodes in self.levels[:-1]:
            other = at ^ 1
            out.append("" if other >= len(nodes) else f"{'<' if other < at else '>'}{nodes[other]}")
            at >>= 1
        return out


def path_copies(node: str, siblings: list[str]) -> list[str]:
    """The ancestors that a version with another ``node`` copies, upwards; all else is shared."""
    out = []
    for other in siblings:
        node = digest(other[1:] + node if other[:1] == "<" else node + other[1:])
        out.append(node)
    return out


def height(rows: int) -> int:
    """Levels above ``rows`` nodes until one is left."""
    return (rows - 1).bit_length()


def _block(table: pa.Table, levels: int) -> tuple[Block, list[int]]:
    """The block of a group's rows (g, pos, group_rows, hash, ...), and the places of its rows."""
    pos, rows, hashes = (table.column(c).to_pylist() for c in ("pos", "group_rows", "hash"))
    order = sorted(range(len(pos)), key=pos.__getitem__)
    return Block([hashes[i] for i in order], min(levels, height(rows[0]))), [p % (1 << levels) for p in pos]


def _block_of(levels: int) -> Column:
    return F.shiftright("pos", levels).alias("block")


def _tops(nodes: DataFrame, levels: int) -> DataFrame:
    """The top of each block of nodes (g, pos, group_rows, hash), as nodes of the next round."""

    def top(table: pa.Table) -> pa.Table:
        block, _ = _block(table, levels)
        g, pos, rows = (table.column(c)[0].as_py() for c in ("g", "pos", "group_rows"))
        return pa.table({"g": pa.array([g], pa.int64()), "pos": pa.array([pos >> levels], pa.int64()), "group_rows": pa.array([-(-rows >> levels)], pa.int64()), "hash": [block.top]})

    keys = nodes.select("g", "pos", "group_rows", "hash").groupBy("g", _block_of(levels))
    return keys.applyInArrow(top, "g long, pos long, group_rows long, hash string")


def _paths(nodes: DataFrame, levels: int) -> DataFrame:
    """g, pos, siblings (upwards to the group's own root) and root of stored nodes (g, pos, group_rows, hash)."""
    tops = stored(_tops(nodes, levels), "merkle-tops")
    most = nodes.agg(F.max("group_rows")).first()[0] or 0
    if most > 1 << levels:
        above = _paths(tops, levels)
    else:
        above = tops.select("g", "pos", F.array().cast("array<string>").alias("siblings"), F.col("hash").alias("root"))

    def join(_, table: pa.Table, up: pa.Table) -> pa.Table:
        names = ["g", "pos", "siblings", "root"]
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()))})
        block, at = _block(table, levels)
        rest, root = up.column("siblings")[0].as_py(), up.column("root")[0].as_py()
        found = pa.array([block.siblings(i) + rest for i in at], pa.list_(pa.string()))
        return pa.table({"g": table.column("g").cast(pa.int64()), "pos": table.column("pos").cast(pa.int64()), "siblings": found, "root": pa.array([root] * len(at), pa.string())})

    mine = nodes.select("g", "pos", "group_rows", "hash", _block_of(levels)).groupBy("g", "block")
    found = mine.cogroup(above.groupBy("g", "pos")).applyInArrow(join, "g long, pos long, siblings array<string>, root string")
    return stored(found, "merkle-paths")


# ---------------------------------------------------------------- operator


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, where: Column | None = None, keep: tuple[str, ...] = ("doc_id", "lang"), levels: int = LEVELS) -> DataFrame:
    """A row for each of ``docs``: the kept columns, leaf, version_leaf, subroot, root, siblings (the proof, upwards), copied (the
    ancestors that the row's version copies) and verified (whether that version has the tree's root).

    A row's version has the leaf of the ``changed`` columns where ``where`` holds, and its own leaf elsewhere. Texts are hashed where
    they are read and go no further unless they are kept.
    """
    keep = tuple(c for c in keep if c.lower() not in RESULTS)
    other = F.when(F.coalesce(where if where is not None else F.lit(False), F.lit(False)), leaf_hash(changed))
    named = [f"kept{i}" for i in range(len(keep))]
    leaves = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("name"), *(quoted(c).alias(n) for c, n in zip(keep, named)), leaf_hash().alias("leaf"), other.alias("other"))
    leaves = ranked(leaves, ["name"], ["id", "leaf"], "pos", "group_rows")
    # a language's number, in order: null first, then by bytes
    langs = stored(ranked(leaves.where("pos = 0").select("name"), [], ["name"], "g", "groups"), "merkle-langs")
    found = leaves.join(small(langs.select(F.col("name").alias("of"), "g")), F.col("name").eqNullSafe(F.col("of"))).drop("of", "id", "name")
    above = _above(found.select("g", "pos", "group_rows", F.col("leaf").alias("hash")), langs, levels)

    made = {"subroot": pa.string(), "root": pa.string(), "siblings": pa.list_(pa.string()), "copied": pa.list_(pa.string()), "verified": pa.bool_()}
    passed = [*named, "leaf", "version_leaf"]

    def versions(_, table: pa.Table, up: pa.Table) -> pa.Table:
        block, at = _block(table.rename_columns(["hash" if c == "leaf" else c for c in table.column_names]), levels)
        rest, subroot, root = (up.column(c)[0].as_py() for c in ("siblings", "subroot", "root"))
        proofs = [block.siblings(i) + rest for i in at]
        leaf = table.column("version_leaf").to_pylist()
        copies = [path_copies(x, proof) for x, proof in zip(leaf, proofs)]
        same = [(copied[-1] if copied else x) == root for x, copied in zip(leaf, copies)]
        values = ([subroot] * len(at), [root] * len(at), proofs, copies, same)
        return pa.table({c: table.column(c) for c in passed} | {c: pa.array(v, t) for (c, t), v in zip(made.items(), values)})

    found = found.select("g", "pos", "group_rows", *named, "leaf", F.coalesce("other", "leaf").alias("version_leaf"), _block_of(levels))
    schema = ", ".join(f"{n} {found.schema[n].dataType.simpleString()}" for n in passed)
    schema += ", subroot string, root string, siblings array<string>, copied array<string>, verified boolean"
    out = found.groupBy("g", "block").cogroup(above.groupBy("g", "pos")).applyInArrow(versions, schema)
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, named)), "leaf", "version_leaf", *made)


def _above(leaves: DataFrame, langs: DataFrame, levels: int) -> DataFrame:
    """For each block of leaves (g, pos): siblings of its top up to the root, its group's subroot, and the root."""
    inner = _paths(stored(_tops(leaves, levels), "merkle-tops"), levels)
    tops = inner.where("pos = 0").select(F.col("g").alias("of"), F.col("root").alias("hash"))
    subroots = tops.join(small(langs.select("g", "groups")), F.col("of") == F.col("g"))
    subroots = stored(subroots.select(F.lit(0).cast("long").alias("g"), F.col("of").alias("pos"), F.col("groups").alias("group_rows"), "hash"), "merkle-subroots")
    outer = _paths(subroots, levels).select(F.col("pos").alias("of"), F.col("siblings").alias("outer"), F.col("root").alias("whole"))
    joined = inner.join(small(outer), F.col("g") == F.col("of"))
    return joined.select("g", "pos", F.concat("siblings", "outer").alias("siblings"), F.col("root").alias("subroot"), F.col("whole").alias("root"))


def proof_digest(siblings: str = "siblings") -> Column:
    """SHA-256 of a proof's hashes, upwards."""
    return F.sha2(F.array_join(F.transform(siblings, lambda x: F.substring(x, 2, 64)), "").cast("binary"), 256)


def version_nodes(manifested: DataFrame) -> DataFrame:
    """A row for each node that a version copies (doc_id, level from 1, hash); what a version shares with the tree has none."""
    changed = manifested.where("version_leaf <> leaf").select("doc_id", F.posexplode("copied").alias("at", "hash"))
    return changed.select("doc_id", (F.col("at") + 1).alias("level"), "hash")
