"""Language identification by compression.

For each language a bounded zstandard raw-content dictionary is cut from training texts. A text is compressed with
every dictionary, in pieces so that a long text does not become its own dictionary; the smallest total wins. A
margin below ``LEAST_MARGIN`` marks the answer as rejected (column ``confident``).

Defined results: null texts and texts without a letter give ``und`` with score 0; ties go to the language with more
training rows, then by name; with no training row every text is ``und``; repeated rows get equal answers; an empty table
gives no rows; columns named like the results, in any case, are replaced. More than ``MAX_LANGUAGES`` languages are an
error, since every task holds a dictionary for each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, with_columns

DICTIONARY_BYTES, SAMPLE_DOCS, SNIPPET_CHARS, MAX_LANGUAGES = 96 << 10, 400, 1500, 200
PIECE_BYTES, SHORT_BYTES, LEAST_MARGIN = 4096, 600, 0.02
UNKNOWN = "und"
FIELDS = [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("confident", T.BooleanType(), False)]
#: ASCII letters lower-cased, other ASCII characters to spaces; other bytes stay
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def plain(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "replace").translate(_PLAIN).split())


@dataclass
class Model:
    languages: list[str]  # more training rows first
    dictionaries: list[bytes]


def fit(docs: DataFrame, lang: str = "lang") -> Model:
    """Learns from the rows outside the held-out fold (crc32(doc_id as text) mod 4 = 2) that have a language."""
    train = docs.where(~fold(4, 2)).where(F.col(lang).isNotNull() & F.col("text").isNotNull())
    counts = train.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(MAX_LANGUAGES + 1).collect()
    if not counts:
        return Model([], [])
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; dictionaries are held by every task")
    # the hash of the id picks about SAMPLE_DOCS texts of each language, and of each a snippet at a random place
    unit = (F.xxhash64(F.col("doc_id"), F.lit(5)).bitwiseAND(0x7FFFFFFF)) / float(1 << 31)
    rate = F.create_map(*[F.lit(v) for r in counts for v in (r[lang], float(min(1.0, SAMPLE_DOCS / r["count"])))])
    at = 1 + (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(6)), F.greatest(F.lit(1), F.length("text") - SNIPPET_CHARS + 1))).cast("int")
    rows = (
        train.where(F.col(lang).isin([r[lang] for r in counts]) & (unit < rate[F.col(lang)]))
        .select(F.col(lang).alias("lang"), F.xxhash64(F.col("doc_id")).alias("o"), F.substring("text", at, F.lit(SNIPPET_CHARS)).alias("t"))
        .orderBy("o")
        .limit(2 * SAMPLE_DOCS * len(counts))
        .collect()
    )
    dictionaries = []
    for r in counts:
        seen: dict[bytes, None] = dict.fromkeys(plain(x["t"]) for x in sorted((x for x in rows if x["lang"] == r[lang]), key=lambda x: (x["o"], x["t"])))
        dictionaries.append(b" ".join(seen)[:DICTIONARY_BYTES])
    return Model([r[lang] for r in counts], dictionaries)


def _compressors(dictionaries: list[bytes]) -> list[list]:
    out = []
    for params in (
        zstd.ZstdCompressionParameters.from_level(5, window_log=18, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False),
        zstd.ZstdCompressionParameters.from_level(15, window_log=18, min_match=3, strategy=zstd.STRATEGY_BTULTRA, write_content_size=False, write_checksum=False, write_dict_id=False),
    ):
        group = []
        for d in dictionaries:
            data = zstd.ZstdCompressionDict(d if len(d) >= 8 else d + b" " * 8, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=params)
            group.append(zstd.ZstdCompressor(dict_data=data, compression_params=params))
        out.append(group)
    return out


def sizes(raw: bytes, compressors: list[list]) -> list[int]:
    """Compressed bytes of the whole text for each dictionary."""
    group = compressors[1] if len(raw) < SHORT_BYTES else compressors[0]
    pieces = [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
    return [sum(len(c.compress(p)) for p in pieces) for c in group]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with lang_pred, score (0 to 1) and confident."""
    languages, dictionaries = model.languages, model.dictionaries  # at most MAX_LANGUAGES * DICTIONARY_BYTES
    ready: list = []

    def make(col: pa.Array) -> list[pa.Array]:
        if not ready:
            ready.append(_compressors(dictionaries))
        pred, score, sure = [], [], []
        for text in col.to_pylist():
            if not languages or not any(map(str.isalpha, text)):
                pred.append(UNKNOWN), score.append(0.0), sure.append(False)
                continue
            raw = plain(text)
            got = np.array(sizes(raw, ready[0]), dtype=np.float64)
            best = int(np.argmin(got))
            rest = np.delete(got, best).min() if len(got) > 1 else got[best] * 2
            margin = max(0.0, 1 - got[best] / max(rest, 1.0))
            pred.append(languages[best]), score.append(1 - 0.5 * float(np.exp(-30 * margin))), sure.append(margin >= LEAST_MARGIN)
        return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.bool_())]

    return with_columns(docs, FIELDS, make)


def language_id(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))
