"""Shards by jump consistent hashing.

A row's shard is a function of its key and of the number of shards: a chain of jumps driven by the key's own sequence of
pseudo-random numbers, with no table of ring positions. With one more shard a row either stays or goes to the new shard, so
1 / (shards + 1) of the rows move, which is the least that keeps shards even.

``assign`` adds the shard to each row without a shuffle; ``slotted`` numbers the rows of each shard from 0 without gaps, by key: rows are
ranged by (shard, key), numbered within their range, and shifted by the counts of the ranges before, so a shard is never one
task. ``write_shards`` puts the shards into folders, and ``moves`` gives the rows that other numbers of shards move.

Defined results: integer keys count as their 64 bits, other keys by a 64-bit hash of their text; a null key is a key of its own
(all such rows share a shard); rows that share a key share its shard and have slots of their own, by crc of the text, then size; a null
text has size 1 (the end mark alone) and the crc of no bytes; an empty table gives no rows; columns named like the results,
in any case, are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, ranked, stored, unused, without

SHARDS = 8
#: Multiplier of the key's sequence of numbers, and the key that stands for null.
MULTIPLIER, NULL_KEY = 2862933555777941757, -1


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, from 0 to ``shards`` - 1, of each 64-bit key. All keys jump at once; those that have landed drop out."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64)
    landed = np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    while len(going):
        state = state * np.uint64(MULTIPLIER) + np.uint64(1)
        share = (np.float64(1 << 31) / ((state >> np.uint64(33)) + np.uint64(1)).astype(np.float64)) * (landed[going] + 1)
        on = share < shards
        going, state = going[on], state[on]
        landed[going] = share[on].astype(np.int64)
    return landed


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a long column."""

    @F.arrow_udf(T.IntegerType())
    def of(keys: pa.Array) -> pa.Array:
        return pa.array(jump(keys.to_numpy(zero_copy_only=False).view(np.uint64), shards).astype(np.int32))

    return of(F.coalesce(key, F.lit(NULL_KEY).cast("long")))


def _key(docs: DataFrame, key: str) -> Column:
    kind = docs.schema[key].dataType
    return F.col(key).cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(F.col(key).cast("string")) if not isinstance(kind, T.BinaryType) else F.xxhash64(key)


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id") -> DataFrame:
    """``docs`` with law (`key`), shard and grown_shard, the shard if there was one more."""
    docs = without(docs, ["law", "shard", "grown_shard"])
    at = _key(docs, key)
    return docs.withColumns({"law": F.lit("key"), "shard": shard_of(at, shards), "grown_shard": shard_of(at, shards + 1)})


def sizes(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with size (UTF-8 bytes of the text and an end mark) and text_crc32."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.select(*keep, (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"))


def slotted(assigned: DataFrame, order: tuple[str, ...] = ("doc_id", "text_crc32", "size")) -> DataFrame:
    """``assigned`` with slot, gapless from 0 in each shard."""
    assigned = without(assigned, ["slot"])
    count, slot = unused(assigned, "shard_rows", "slot")
    return ranked(assigned, ["shard"], list(order), slot, count).drop(count)


def moves(docs: DataFrame, shards: int, to: int, key: str = "doc_id") -> DataFrame:
    """The rows whose shard differs between ``shards`` and ``to`` shards, with from_shard and to_shard. With more shards all of them
    go to new ones; nothing else has to be rewritten."""
    docs = without(docs, ["from_shard", "to_shard"])
    at = _key(docs, key)
    return docs.withColumns({"from_shard": shard_of(at, shards), "to_shard": shard_of(at, to)}).where("from_shard <> to_shard")


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, key: str = "doc_id") -> DataFrame:
    """Writes ``docs`` to one folder a shard (shard=0, shard=1, ...) straight from the input's tasks, and reads them again."""
    columns = docs.columns
    assign(docs, shards, key).drop("law", "grown_shard").write.partitionBy("shard").parquet(folder)
    schema = T.StructType([*without(docs, ["law", "shard", "grown_shard"]).schema.fields, T.StructField("shard", T.IntegerType())])
    found = docs.sparkSession.read.schema(schema).parquet(folder)
    return found.select(*(quoted(c) for c in columns if c in found.columns and c != "shard"), "shard")


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A row for each of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = stored(assign(sizes(docs), shards), "shards")
    return slotted(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
