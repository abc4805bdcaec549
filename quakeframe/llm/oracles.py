"""SQL of the corpus operators that SQL can express over whole tables."""

from __future__ import annotations

from .collocations import LONGEST, MIN_COUNT, NO_LANG, TOP
from .merkle import FIELDS
from .sharding import MULTIPLIER, NULL_KEY, SHARDS

_TWO_64 = 1 << 64
#: CRC-32 of a list of bytes: a table of 256 steps, made from the polynomial, then a byte at a time
_CRC_TABLE = "crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t FROM range(256) r(i))"


def _crc(data: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


OP11_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS pairs FROM documents),
x AS (SELECT doc_id, size, {_crc("list_transform(pairs, lambda p: CAST('0x' || p AS BIGINT))")} AS text_crc32 FROM d, crc),
j(doc_id, n, state, shard, next) AS (
  SELECT doc_id, n, CAST(coalesce(doc_id, {NULL_KEY}) AS HUGEINT) + CASE WHEN coalesce(doc_id, {NULL_KEY}) < 0 THEN {_TWO_64} ELSE 0 END, CAST(-1 AS BIGINT), CAST(0 AS BIGINT)
  FROM (SELECT DISTINCT doc_id FROM documents), (VALUES ({SHARDS}), ({SHARDS + 1})) v(n)
  UNION ALL
  SELECT doc_id, n, s, next, CAST(floor((next + 1) * (CAST(2147483648 AS DOUBLE) / CAST((s // 8589934592) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT doc_id, n, next, CAST((CAST(state AS UHUGEINT) * {MULTIPLIER} + 1) % {_TWO_64} AS HUGEINT) AS s FROM j WHERE next < n)),
h AS (SELECT doc_id, max(shard) FILTER (n = {SHARDS}) AS shard, max(shard) FILTER (n = {SHARDS + 1}) AS grown FROM j WHERE next >= n GROUP BY doc_id)
SELECT x.doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY x.doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown AS INT) AS grown_shard
FROM x JOIN h ON x.doc_id IS NOT DISTINCT FROM h.doc_id
"""


def _leaf(n_chars: str) -> str:
    fields = [n_chars if f == "n_chars" else f"CAST({f} AS VARCHAR)" for f in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


# n: nodes of a language by level; u: nodes above the subroots; f: each version on its way up, through its language and then above
OP12_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
l AS (SELECT doc_id, lang, {_leaf("CAST(n_chars AS VARCHAR)")} AS leaf, {_leaf("CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR)")} AS other,
             doc_id IS NOT NULL AND {_crc("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))")} % 7 = 0 AS changed FROM documents, crc),
g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM documents)),
a AS (SELECT doc_id, leaf, CASE WHEN changed THEN other ELSE leaf END AS version, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p
      FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang),
n(g, level, p, h, m) AS (
  SELECT g, CAST(0 AS BIGINT), p, leaf, count(*) OVER (PARTITION BY g) FROM a
  UNION ALL
  SELECT g, level + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (max(m) + 1) // 2 FROM n WHERE m > 1 GROUP BY g, level, p // 2),
s AS (SELECT g, h AS subroot, level FROM n WHERE m = 1),
u(level, p, h, m) AS (
  SELECT CAST(0 AS BIGINT), g, subroot, count(*) OVER () FROM s
  UNION ALL
  SELECT level + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (max(m) + 1) // 2 FROM u WHERE m > 1 GROUP BY level, p // 2),
f(doc_id, leaf, g, p, q, level, up, h, proof) AS (
  SELECT doc_id, leaf, g, p, p, CAST(0 AS BIGINT), false, version, '' FROM a
  UNION ALL
  SELECT f.doc_id, f.leaf, f.g, f.p, CASE WHEN over THEN f.g ELSE f.q // 2 END, CASE WHEN over THEN 0 ELSE f.level + 1 END, f.up OR over,
         CASE WHEN over THEN f.h WHEN f.q % 2 = 1 THEN sha256(sib || f.h) ELSE sha256(f.h || coalesce(sib, '')) END, f.proof || CASE WHEN over THEN '' ELSE coalesce(sib, '') END
  FROM (SELECT f.*, NOT up AND f.level = s.level AS over, coalesce(x.h, y.h) AS sib FROM f JOIN s ON s.g = f.g
        LEFT JOIN n x ON NOT up AND x.g = f.g AND x.level = f.level AND x.p = xor(f.q, 1) AND f.level < s.level
        LEFT JOIN u y ON up AND y.level = f.level AND y.p = xor(f.q, 1)) f
  WHERE NOT (up AND f.level = (SELECT max(level) FROM u)))
SELECT f.doc_id, f.leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM f JOIN s ON s.g = f.g JOIN u r ON r.m = 1 WHERE f.up AND f.level = r.level
"""

OP13_SQL = f"""
WITH d AS (SELECT coalesce(lang, '{NO_LANG}') AS lang,
                  unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM d),
i AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, {LONGEST + 1}) r(k)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS c FROM i GROUP BY ALL),
n AS (SELECT lang, sum(c) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS p, c AS a FROM f WHERE k > 1 AND c >= {MIN_COUNT}),
o AS (SELECT lang, array_to_string(p[x:x + m - 1], ' ') AS phrase, max(a) AS most FROM c, range(2, {LONGEST}) y(m), range(1, {LONGEST}) z(x) WHERE m < k AND x + m - 1 <= k GROUP BY ALL),
k AS (SELECT c.*, h AS cut, array_to_string(p[1:h], ' ') AS head, array_to_string(p[h + 1:], ' ') AS tail
      FROM c LEFT JOIN o USING (lang, phrase), range(1, {LONGEST}) y(h) WHERE h < k AND NOT coalesce(most >= a, false)),
s AS (SELECT k.lang, k.phrase, a, x.c AS l, y.c AS r, n, 1000 * a * n // (x.c * y.c) AS score, cut
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = head JOIN f y ON y.lang = k.lang AND y.phrase = tail JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM q WHERE rank <= {TOP}
"""
