"""Jump hashing, the Merkle manifest and collocations against SQL and plain Python, with odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

pytest.importorskip("quakeframe.llm")
from pyspark.sql import functions as F  # noqa: E402

from quakeframe.llm import collocations, merkle, queries, sharding  # noqa: E402
from quakeframe.llm.common import ranked, stored  # noqa: E402

RNG = random.Random(5)
SYLLABLES = "ta ri no ke lo mu sha vel or an ein ud".split()
ODD = [None, "", "   ", "\n\n", "one", "One two, three\tfour!", "Ünï cödé ﬁ 語 😀 x", "a  b\t c\r\nd\x0be\x0cf", "same text here for you all", "same text here for you all", "x" * 50_000, "word " * 30_000]


def prose(n):
    return " ".join("".join(RNG.choices(SYLLABLES, k=RNG.randint(1, 2))) + RNG.choice(["", "", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """A folder whose documents have nulls everywhere, repeated rows and ids, odd languages and a clashing column."""
    folder = tmp_path_factory.mktemp("odd")
    rows = []
    for i in range(700):
        text = RNG.choice(ODD[:10]) if i % 3 == 0 else prose(RNG.randint(1, 60))
        rows.append((None if i % 50 == 7 else i // 2, text, RNG.choice(["en", "en", "en", "dé", None, "und", ""]), RNG.choice(["s", None]), RNG.choice([None, -1, 5, (1 << 63) - 1]), "shard"))
    rows += [rows[5]] * 40 + [(9001, t, "long", "s", 1, "x") for t in ODD] + [(1 << 62, "a", "one", None, None, "y"), (-5, "b", "en", "s", 3, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, leaf string")
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def rows_of(frame):
    names = sorted(frame.columns)
    return Counter(tuple(r[n] for n in names) for r in frame.collect())


@pytest.mark.parametrize("name", ["op11_jump_sharding", "op12_merkle_manifest", "op13_collocations"])
@pytest.mark.parametrize("where", ["odd", "given"])
def test_sql(spark, odd_dir, name, where):
    folder = odd_dir if where == "odd" else "/root/testdata/sf0.001"
    got = queries.QUERIES[name](spark, folder)
    duck = duckdb.connect()
    files = f"{folder}/documents.parquet/*.parquet" if where == "odd" else f"{folder}/documents.parquet"
    duck.sql(f"create view documents as select * from '{files}'")
    want = duck.sql(queries.ORACLE_SQL[name])
    order = [want.columns.index(c) for c in sorted(got.columns)]
    assert sorted(want.columns) == sorted(got.columns)
    assert rows_of(got) == Counter(tuple(r[i] for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", ["op11_jump_sharding", "op12_merkle_manifest", "op13_collocations"])
def test_empty_table(spark, odd_dir, tmp_path, name):
    spark.read.parquet(f"{odd_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_ranked_without_hot_tasks(spark):
    rows = spark.range(5000).select((F.col("id") % 5 > 1).alias("hot"), F.lit(1).alias("same"), F.when(F.col("id") < 5, F.col("id")).alias("rare"))
    got = ranked(rows, ["hot"], ["same", "rare"]).collect()
    for hot in (True, False):
        mine = [r for r in got if r["hot"] == hot]
        assert sorted(r["position"] for r in mine) == list(range(len(mine))) and {r["group_rows"] for r in mine} == {len(mine)}
        tail = sorted((r["rare"], r["position"]) for r in mine if r["rare"] is not None)
        assert [p for _, p in tail] == list(range(len(mine) - len(tail), len(mine)))


# ---------------------------------------------------------------- sharding


def plain_jump(key, n):
    b, j = -1, 0
    key &= (1 << 64) - 1
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump():
    keys = [RNG.randrange(-(1 << 63), 1 << 63) for _ in range(3000)] + [0, 1, -1, (1 << 63) - 1, -(1 << 63)]
    array = np.array(keys, np.int64).view(np.uint64)
    before = None
    for n in (1, 2, 7, 8, 9, 1000, 1001):
        got = sharding.jump(array, n)
        assert got.tolist() == [plain_jump(k, n) for k in keys]
        assert got.min() >= 0 and got.max() < n
        if before is not None and n - before[0] == 1:
            moved = got != before[1]
            assert set(got[moved]) <= {n - 1} and moved.mean() < 2.5 / n + 0.01
        before = (n, got)
    with pytest.raises(ValueError):
        sharding.jump(array, 0)


def test_shards_on_disk(spark, docs_of, tmp_path):
    docs = docs_of(ODD + [prose(20) for _ in range(50)], [None, None, *range(60)]).withColumn("Shard", F.lit("clash"))
    got = sharding.write_shards(docs, f"file://{tmp_path}/shards")
    want = {(r["doc_id"], r["text"], plain_jump(-1 if r["doc_id"] is None else r["doc_id"], 8)) for r in docs.collect()}
    assert {(r["doc_id"], r["text"], r["shard"]) for r in got.collect()} == want and got.count() == docs.count()
    moved = sharding.moves(docs, 8, 11).collect()
    assert moved and all(r["to_shard"] >= 8 for r in moved)
    assert len(moved) == sum(plain_jump(-1 if r["doc_id"] is None else r["doc_id"], 8) != plain_jump(-1 if r["doc_id"] is None else r["doc_id"], 11) for r in docs.collect())
    named = sharding.assign(docs.withColumn("name", F.concat(F.lit("k"), "doc_id")), 8, "name")
    assert {r["shard"] for r in named.collect()} <= set(range(8))


# ---------------------------------------------------------------- merkle


def test_tree_versions_over_many_rounds(spark, docs_of):
    """Blocks of four nodes: 300 leaves take several rounds of distributed upper levels."""
    docs = stored(docs_of([f"text {i}" for i in range(300)]), "merkle-test")
    found = merkle.manifest(docs, {"n_chars": F.col("n_chars") + 1}, F.col("doc_id") % 9 == 0, levels=2)
    rows = sorted(found.collect(), key=lambda r: r["doc_id"])
    level, levels = [r["leaf"] for r in rows], []
    while len(level) > 1:
        levels.append(level)
        level = [hashlib.sha256("".join(level[i : i + 2]).encode()).hexdigest() for i in range(0, len(level), 2)]
    assert {r["root"] for r in rows} == {r["subroot"] for r in rows} == {level[0]}
    nodes = defaultdict(list)
    for r in merkle.version_nodes(found).collect():
        nodes[r["doc_id"]].append((r["level"], r["hash"]))
    for r in rows:
        at, want, node, copied = r["doc_id"], [], r["version_leaf"], []
        for nodes_at in levels:
            other = at ^ 1
            sib = nodes_at[other] if other < len(nodes_at) else ""
            want.append(sib and ("<" if other < at else ">") + sib)
            node = hashlib.sha256((sib + node if other < at else node + sib).encode()).hexdigest()
            copied.append(node)
            at >>= 1
        assert r["siblings"] == want and r["copied"] == copied and r["verified"] == (r["doc_id"] % 9 != 0)
        # a version copies its ancestors alone
        assert sorted(nodes[r["doc_id"]]) == (list(enumerate(copied, 1)) if r["doc_id"] % 9 == 0 else [])


def test_block_is_shared():
    leaves = [merkle.digest(str(i)) for i in range(5)]
    block = merkle.Block(leaves, 3)
    before = [list(x) for x in block.levels]
    copies = merkle.path_copies(merkle.digest("other"), block.siblings(4))
    assert block.levels == before and len(copies) == 3
    assert copies[-1] == merkle.Block(leaves[:4] + [merkle.digest("other")], 3).top
    assert merkle.Block(leaves[:1], 0).top == leaves[0] and merkle.Block(leaves[:1], 0).siblings(0) == []


# ---------------------------------------------------------------- collocations


def plain_pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
        words = re.findall(r"[^\x20\x09]+", piece)
        if words:
            yield words


def plain_collocations(rows, least, longest=5, top=2000, dominance=100):
    counts = defaultdict(Counter)
    for lang, text in rows:
        for w in plain_pieces(text):
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    counts["und" if lang is None else lang][tuple(w[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for k, c in f.items() if len(k) == 1)
        found = {k: c for k, c in f.items() if len(k) > 1 and c >= least}
        most = Counter()
        for k, c in found.items():
            for m in range(2, len(k)):
                for i in range(len(k) - m + 1):
                    most[k[i : i + m]] = max(most[k[i : i + m]], c)
        rows = []
        for k, a in found.items():
            if 100 * most[k] < dominance * a or not most[k]:
                score, cut = min((1000 * a * n // (f[k[:j]] * f[k[j:]]), j) for j in range(1, len(k)))
                rows.append((-score, -a, " ".join(k).encode(), a, f[k[:cut]], f[k[cut:]], n, score))
        out += [(lang, i + 1, x[2].decode(), *x[3:]) for i, x in enumerate(sorted(rows)[:top])]
    return Counter(out)


@pytest.mark.parametrize(("least", "longest", "trigger", "dominance", "top"), [(2, 5, 2, 100, 2000), (3, 5, 1, 100, 7), (2, 3, 3, 80, 2000), (2, 5, 1 << 40, 100, 2000)])
def test_collocations(spark, odd_dir, least, longest, trigger, dominance, top):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    got = collocations.collocations(docs, longest, least, top, dominance, trigger)
    want = plain_collocations([(r["lang"], r["text"]) for r in docs.collect()], least, longest, top, dominance)
    assert Counter(map(tuple, got.collect())) == want


def test_parse_covers_each_word_once(spark):
    texts = [prose(400) for _ in range(20)] + ODD + ["deep " * 5000 + "end. " + "b c d e f g " * 60_000]
    docs = spark.createDataFrame([(None, t) for t in texts], "lang string, text string")
    for trigger in (1, 3, 16):
        rows = collocations.dictionary(docs, trigger=trigger).collect()
        want = Counter(w for t in texts for piece in plain_pieces(t) for w in piece)
        got = Counter()
        for r in rows:
            words = r["chunk"].split(" ")
            assert 0 < r["own"] <= len(words)
            for w in words[: r["own"]]:
                got[w] += r["freq"]
        assert got == want
    # copies of a passage share chunks wherever they begin
    passage = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([("x", f"a{i} " * i + passage) for i in range(9)], "lang string, text string")
    freqs = [r["freq"] for r in collocations.dictionary(docs, trigger=4).collect()]
    assert sum(f for f in freqs if f == 9) > 0.8 * sum(freqs)


def test_long_text_in_sections():
    text = ("some words here, and more of them. " * 60_000).encode()
    data = np.frombuffer(text, np.uint8)
    parts = list(collocations._sections(data, np.array([0, len(data)])))
    assert len(parts) > 2 and b"".join(p.tobytes() for _, p, _ in parts) == text
    assert all(collocations._MARK[p[-1]] for _, p, _ in parts[:-1])


def test_bitmap_misses_nothing(spark):
    keys = [RNG.randrange(-(1 << 63), 1 << 63) for _ in range(2000)]
    found = collocations._write_bitmap(spark.createDataFrame([(k,) for k in keys], "key long"))
    bitmap = collocations.Bitmap(*found)
    assert bitmap.has(np.array(keys, np.int64).view(np.uint64)).all()
    other = np.random.default_rng(1).integers(0, 1 << 63, 100_000, dtype=np.uint64)
    assert bitmap.has(other).mean() < 0.001


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000
    phrases = spark.createDataFrame([("x", 1, "a", 2 * big), ("x", 1, "b", 3 * big), ("x", 2, "a b", big)], "lang string, words int, phrase string, freq long")
    totals = spark.createDataFrame([("x", 1_000 * big)], "lang string, n long")
    got = collocations.scored(phrases, totals).first()
    assert got["score"] == 1000 * big * (1_000 * big) // (2 * big * 3 * big)
