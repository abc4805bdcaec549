"""The corpus operators against brute force, exact round trips and held-out accuracy, with odd rows."""

import bisect
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("quakeframe.llm")
from quakeframe.llm import contamination, jaccard, langid, lines, mixing, packing, pii, records, rules, tokens, toxicity  # noqa: E402
from quakeframe.llm.common import Words, filled, shingle_hashes, text_slices  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(11)
SYLLABLES = "ta ri no ke lo mu sha vel or an ein ud".split()
ODD = [None, "", "   ", "\n\n", "one", "one two three four", "Ünï cödé ﬁ 語 😀 x", "a  b\t c\r\nd\x0be", "same text here for you all", "same text here for you all", "x" * 50_000, "word " * 30_000]


def prose(n, rng=RNG):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def words_of(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.default_path())


def ids_of(encoder, t):
    return encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]


def test_words_from_bytes():
    texts = [t or "" for t in ODD] + [prose(40), "A b c"]
    col = filled(pa.array(texts))
    found = [[] for _ in texts]
    seen = {}
    for lo, _, data, offs in text_slices(col, 300):
        w = Words(data, offs, lower=True)
        for a, b, d, h in zip(w.starts, w.ends, w.doc, w.hash().tolist()):
            word = data[a:b].tobytes().decode()
            found[lo + d].append(word)
            assert seen.setdefault(word.lower() if word.isascii() else word, h) == h
    assert found == [WORD.findall(t) for t in texts]
    assert len(set(seen.values())) == len(seen)
    for lo, hi, data, offs in text_slices(col):
        _, doc = shingle_hashes(Words(data, offs, lower=True))
        counts = np.bincount(doc, minlength=hi - lo)
        assert counts.tolist() == [max(1, len(words_of(t)) - 4) if words_of(t) else 0 for t in texts[lo:hi]]


def test_encoder_is_exact(encoder):
    odd = ["a  b", "a \n b\n\nc", "\n\n\nx", " lead", "trail ", "!\x1c! x", "tab\there \tx", "don't we'll I'm 'S", "x\r\ny", "a\n \nb", "  x　", "a_b _x", "² x² ½", "ab, c!? d... (e)", "éte, 語。"] + [t or "" for t in ODD]
    for t, got in zip(odd, encoder.encode(odd)):
        assert np.frombuffer(got, encoder.dtype).tolist() + [0] == ids_of(encoder, t), t


def test_records(spark, docs_of, encoder, tmp_path):
    texts = ODD + [prose(30) for _ in range(20)]
    ids = [5, 5, None, *range(100, 100 + len(texts) - 3)]
    folder = f"file://{tmp_path}/rec"
    index = records.write_records(docs_of(texts, ids), folder)
    got = records.read_records(index, folder).collect()
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ((i, ids_of(encoder, t)) for i, t in zip(ids, texts)))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    data = records.frame(7, b"\x01\x00\x02\x00", 2)
    assert records.parse(data)[0] == 7 and records.parse(data)[1].tolist() == [1, 2]
    for at in range(len(data)):
        with pytest.raises(ValueError):
            records.parse(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    none = records.write_records(docs_of([]), f"file://{tmp_path}/none")
    assert none.count() == 0 and records.read_records(none, f"file://{tmp_path}/none").count() == 0
    assert not [n for n in os.listdir(tmp_path / "rec") if n.startswith(".")]


def test_packing(docs_of, encoder):
    texts = ODD + [prose(RNG.randint(1, 400)) for _ in range(60)]
    got = packing.best_fit_packing(docs_of(texts), capacity=256).toPandas()
    for i, t in enumerate(texts):
        ids, mine = ids_of(encoder, t), got[got.doc_id == i].sort_values("piece")
        assert mine.length.sum() == len(ids) and mine.start.tolist() == [0, *np.cumsum(mine.length)[:-1]] and (mine.length.iloc[1:] == 256).all()
        assert [zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) for a, n in zip(mine.start, mine.length)] == mine.ids_crc32.tolist()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 256
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 256) * 1.1 + 1
    assert packing.best_fit_packing(docs_of([])).count() == 0


def best_fit_decreasing(counts, capacity):
    """Sequences that plain best fit in decreasing order opens, one piece at a time."""
    gaps = []
    n = 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            at = bisect.bisect_left(gaps, length)
            n += at == len(gaps)
            bisect.insort(gaps, (gaps.pop(at) if at < len(gaps) else capacity) - length)
    return n


@pytest.mark.parametrize("kind", ["even", "short", "half", "one"])
def test_rounds_cover_every_rank(spark, kind):
    """Every piece is placed once, no sequence overflows or has a hole, and about as many are opened as by plain best fit."""
    rng = np.random.default_rng(1)
    lengths = {"even": rng.integers(1, 65, 5000), "short": rng.geometric(0.2, 3000).clip(1, 64), "half": rng.integers(30, 36, 500), "one": np.full(3, 64)}[kind]
    counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    runs = packing.rounds(spark, counts, 64)
    inside = defaultdict(list)
    for length in counts:
        mine = np.flatnonzero(runs.length == length)
        starts = [*runs.rank[mine].tolist(), counts[length]]
        assert starts[0] == 0 and starts == sorted(set(starts))
        for r, a, b in zip(mine, starts, starts[1:]):
            for k in range(b - a):
                inside[int(runs.sequence[r]) + k].append((int(runs.offset[r]), length))
    for s in inside.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 64
    assert len(inside) <= best_fit_decreasing(counts, 64) * 1.005 + 1


def components(sets):
    inv, parent = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            inv[x].append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    common = Counter(p for l in inv.values() for p in itertools.combinations(l, 2))
    for (a, b), c in common.items():
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def edited(t, n, rng=RNG):
    w = t.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = prose(1, rng)
    return " ".join(w)


def shingles(t):
    w = words_of(t)
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard, "MAX_LIST", 7)  # long lists split
    base, passage = prose(100), prose(60)
    texts = ODD + [edited(base, RNG.randint(0, 4)) for _ in range(60)] + [passage + " " + prose(RNG.randint(5, 40)) for _ in range(40)] + [prose(RNG.randint(1, 60)) for _ in range(40)]
    for _ in range(3):
        t = texts[-1]
        texts += [t, t.upper(), edited(t, 1)]
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = components(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs_of(texts)).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert jaccard.near_duplicates(docs_of([])).count() == 0
    assert jaccard.near_duplicates(docs_of(["", None, "  "])).count() == 3
    rows = jaccard.near_duplicates(docs_of([base, base, base], [4, None, 4])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in rows) == [(0, 4), (4, 4), (4, 4)]


def test_jaccard_joins_labels_beyond_the_lookup(docs_of, monkeypatch):
    """Components are the same where labels and sides are joined rather than looked up, and where lists yield a few pairs at a time."""
    rng = random.Random(8)
    base = [prose(60, rng) for _ in range(6)]
    texts = [edited(rng.choice(base), rng.randint(0, 5), rng) for _ in range(150)] + [prose(30, rng) for _ in range(20)]
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = components(sets)
    monkeypatch.setattr(jaccard, "LOOKUP_ROWS", 0)
    monkeypatch.setattr(jaccard, "MOST_PAIRS", 10)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs_of(texts)).collect()} == want


def test_sketches_lose_no_similar_pair():
    rng = np.random.default_rng(5)
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 600), dtype=np.uint64))
        y = np.unique(np.concatenate([rng.permutation(x)[: rng.integers(1, len(x) + 1)], rng.integers(0, 1 << 62, rng.integers(1, 80), dtype=np.uint64)]))
        apart = sum(int(v).bit_count() for v in (jaccard.sketch(x) ^ jaccard.sketch(y)).view(np.uint64))
        assert (len(x) + len(y) - apart) / 2 >= len(np.intersect1d(x, y))


def test_one_of_each_group_removes_rows_not_ids(docs_of):
    """A document that shares the id of a near copy stays, and of rows equal in id and set one stays."""
    rng = random.Random(9)
    x, y, z = (prose(60, rng) for _ in range(3))
    w = prose(60, rng)
    texts, ids = [x, f"{x} more", y, z, z, z, None, "", x, w, w, f"{w} a"], [1, 3, 3, 5, 5, 6, 7, None, None, None, None, None]
    rows = [(r["doc_id"], r["text"]) for r in jaccard.one_of_each_group(docs_of(texts, ids)).collect()]
    assert Counter(r for r in rows if r[1] not in (w, f"{w} a")) == Counter([(1, x), (3, y), (5, z), (7, None), (None, "")])
    assert len(rows) == 6  # one of the three without ids
    assert jaccard.one_of_each_group(docs_of([])).count() == 0


def test_a_long_list_of_unlike_sets_takes_little_memory():
    """20,000 sets of one size in one list: pairs come a bounded number at a time."""
    import tracemalloc

    n = 20_000
    tracemalloc.start()
    made = jaccard.list_pairs(np.zeros(n, np.uint32), np.arange(n), np.arange(n), np.full(n, 100, np.uint32), np.zeros(n, np.uint32))
    for some in itertools.islice(made, 5):
        assert len(some) < 4 * jaccard.MOST_PAIRS
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_list_pairs_skip_nothing_needed(monkeypatch):
    rng = np.random.default_rng(3)
    n = rng.integers(5, 40, 300)
    e = dict(token=rng.integers(0, 12, 300).astype(np.uint32), cid=np.arange(300), comp=rng.integers(0, 250, 300), n=n.astype(np.uint32), pos=(rng.random(300) * 0.3 * n).astype(np.uint32))
    monkeypatch.setattr(jaccard, "MOST_PAIRS", 50)
    got = {tuple(p) for some in jaccard.list_pairs(*e.values()) for p in some.tolist()}
    want = set()
    for i, j in itertools.combinations(range(300), 2):
        need = jaccard.needed(int(n[i]), int(n[j]))
        if e["token"][i] == e["token"][j] and e["comp"][i] != e["comp"][j] and n[i] - e["pos"][i] >= need and n[j] - e["pos"][j] >= need and 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j]):
            want.add((i, j))
    assert got == want


def test_unlike_pairs_in_pieces():
    rng = np.random.default_rng(4)
    for x, y in ((rng.integers(0, 3, 50), rng.integers(0, 3, 70)), (np.zeros(9, int), np.zeros(4, int)), (np.arange(5), np.arange(5))):
        got = [(int(a), int(b)) for i, j in jaccard._unlike(x, y, cells=16) for a, b in zip(i, j)]
        assert sorted(got) == [(a, b) for a in range(len(x)) for b in range(len(y)) if x[a] != y[b]]
        own = [(int(a), int(b)) for i, j in jaccard._unlike(x, x, same=True, cells=16) for a, b in zip(i, j)]
        assert sorted(tuple(sorted(p)) for p in own) == [(a, b) for a in range(len(x)) for b in range(a, len(x)) if x[a] != x[b]]


def test_a_block_gives_each_pair_once(monkeypatch):
    """2,000 unlike sets of one size: pairs leave once, even where batches are too small to see both orders."""
    n = 2000
    monkeypatch.setattr(jaccard, "MOST_PAIRS", 1000)
    made = jaccard.list_pairs(np.zeros(n, np.uint32), np.arange(n), np.arange(n) // 2, np.full(n, 100, np.uint32), np.zeros(n, np.uint32))
    assert sum(map(len, made)) == n * (n - 1) // 2 - n // 2


def test_lists_split_by_own_counts(spark, docs_of):
    """A table whose counters are all high splits no list, and one hot token splits only its own."""
    docs = docs_of([prose(8, random.Random(i)) for i in range(6)]).coalesce(1)

    def entries(counts):
        return sum(len(r["entries"]) // 24 for r in jaccard._entries(docs, counts, 4).collect())

    counts = np.full(1 << jaccard.COUNT_BITS, 2, np.uint32)
    few = entries(counts)
    assert entries(counts + np.uint32(50 * jaccard.MAX_LIST)) == few
    assert jaccard._split(np.array([9], np.uint64), np.array([0]), np.array([3]), 5)[0].size == 3


def brute_edit(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        prev, row[0] = row[0], i
        for j, d in enumerate(t, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (c != d))
    return min(row)


def test_decontamination(spark, docs_of):
    items = [prose(25), prose(12), "Short one", prose(40), None, "", "  "]

    def noisy(t, k):
        t = list(t)
        for _ in range(k):
            i, kind = RNG.randrange(len(t) + 1), RNG.randrange(3)
            t[i : i + (kind > 0)] = [] if kind == 1 else RNG.choice("qzj")
        return "".join(t)

    texts = ODD + [f"{prose(10)} {noisy(RNG.choice(items[:4]), RNG.randint(0, 30))} {prose(10)}" for _ in range(80)] + [items[0].upper().replace(" ", "\n"), items[1][: len(items[1]) // 2]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for i, t in enumerate(texts):
        for j, p in enumerate(items):
            p, folded = contamination.fold_bytes(p or ""), contamination.fold_bytes(t or "")
            if p.strip() and len(folded) < 5000:
                d = brute_edit(p, folded)
                if d <= contamination.budget(len(p)):
                    want.add((i, j, d))
    for block in (1 << 20, 60):  # one block, and several
        rows = contamination.leaks(docs_of(texts), bench, block_bytes=block).collect()
        assert {(r["doc_id"], x["item_id"], x["distance"]) for r in rows for x in r["leaks"]} == want and len(rows) == len(texts)
    assert contamination.leaks(docs_of(texts), bench.limit(0)).where("size(leaks) > 0").count() == 0
    assert contamination.leaks(docs_of([]), bench).count() == 0


def test_jaccard_with_rows_of_one_id(docs_of):
    """Rows of one id with different texts: each keeps the link to its near copy."""
    rng = random.Random(3)
    texts, ids, odd = [], [], []
    for g in range(40):
        x, y = (" ".join(f"{prose(1, rng)}{rng.randrange(10**6)}" for _ in range(60)) for _ in range(2))
        texts += [x, y, f"{x} more", f"{y} more"]
        ids += [10 * g + 1, 10 * g + 1, 10 * g + 2, 10 * g + 3]
        odd += ids[-2:]
    got = {r["doc_id"]: (r["component_id"], r["links_found"]) for r in jaccard.near_duplicates(docs_of(texts, ids)).where("doc_id % 10 > 1").collect()}
    assert got == {i: (i - i % 10 + 1, 1) for i in odd}


def test_decontamination_of_short_items(spark, docs_of):
    """Short items beside usual ones: those below LEAST_BYTES match whole texts only, and memory stays bounded."""
    import tracemalloc

    rng = random.Random(12)
    items = [(i, prose(rng.randint(8, 30), rng)) for i in range(2000)] + [(3000, "e"), (3001, "the"), (3002, "an ei "), (3003, "ta re no"), (3004, "eeeeeeee")]
    texts = ["e", " The ", "an ei", "an e i", prose(50, rng), f"{prose(5, rng)} ta re no {prose(5, rng)}", items[7][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r["doc_id"]: [(x["item_id"], x["distance"]) for x in r["leaks"]] for r in contamination.leaks(docs_of(texts), bench).collect()}
    assert rows[0] == [(3000, 0)] and rows[1] == [(3001, 0)] and rows[2] == [(3002, 0)] and (3003, 0) in rows[5] and (7, 0) in rows[6] and not rows[3] and not rows[4]
    long = np.frombuffer((" ".join(prose(2000, rng) for _ in range(380))).encode()[: 5 << 20], np.uint8)
    index = contamination.Index(items, contamination.BUDGET)
    tracemalloc.start()
    index.leaks(long, np.array([0, len(long)]))
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
    texts, few = [prose(30, rng) for _ in range(6)], [(i, prose(10, rng)) for i in range(30)]
    texts.append(f"{texts[0]} {few[3][1]}")
    several = contamination.leaks(docs_of(texts), spark.createDataFrame(few, "item_id long, text string"), block_bytes=100)  # more blocks than one pass takes
    assert [[x["item_id"] for x in r["leaks"]] for r in several.where("doc_id = 6").collect()] == [[3]]


def test_pii():
    cases = {
        "mail bob.x@site.example.com now": ["email:5:27"],
        "ip 10.0.0.255 not 10.0.0.256": ["ip:3:13"],
        "card 4111 1111 1111 1111 ok": ["card:5:24"],
        "call +1 (042) 555-7845 x": ["phone:5:22"],
        "bob [at] site (dot) org": ["email:0:23"],
        "write bob at site dot org today": ["email:6:25"],
        "ｂｏｂ＠site．org": ["email:0:12"],
        "bоb@site.org": ["email:0:12", "email:2:12"],  # the plain span stays as it is, the wider one beside it
        "john@mail.example[dot]com": ["email:0:17", "email:0:25"],
        "call plus four nine one five one two three four five six now": ["phone:5:56"],
        "one two three went home at ten dot": [],
        "a@b.c.@d.e": ["email:0:5", "email:5:10"],
        "9" * 30000 + "." + "1.2.3": [],
    }
    for text, want in cases.items():
        base, every = pii.scan(text, True, True)
        assert set(base) <= set(every)
        got = [f"{k}:{a}:{b}" for k, a, b in every]
        assert got == want, text


def brute_pii(t):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and luhn or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii_base_is_the_plain_patterns(docs_of):
    rng = random.Random(2)
    texts = ["".join(rng.choices("0123456789.@+-() abz_%", k=rng.randint(0, 60))) for _ in range(3000)]
    for t in texts:
        assert pii.find(t) == brute_pii(t), t
    rows = {r["doc_id"]: r for r in pii.personal_data(docs_of(ODD + texts[:50])).collect()}
    for i, t in enumerate(ODD + texts[:50]):
        assert rows[i]["base_spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in brute_pii(t or ""))


def test_pii_gates_lose_nothing(docs_of):
    """Gated spans are those of normalising every text."""
    rewritten = {chr(c).encode()[0] for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000 and pii._glyphs(chr(c))}
    assert rewritten == set(np.flatnonzero(pii._LEADS).tolist())
    cases = {
        "card 4111\u00a01111\u00a01111\u00a01111 ok": "card:5:24",
        "card 4111\u00ad1111\u00ad1111\u00ad1111 ok": "card:5:24",
        "bob@site\u00b7org": "email:0:12",
        "\u0501an@site": "",
        "plus four 9 one 5 two 3 three 4 five 6": "phone:0:38",
        "call plus 49 151 2345678 now": "phone:5:24",
    }
    rng = random.Random(5)
    parts = ["one", "two", "neun", "un", "dos", "9", "4", "12", "plus", "dot", "at", "bob", "site.org", "@", "\u00a0", "\u00b7", "\u0501", "\u0e53", "\ua621", "\U000e0001", "É"]
    texts = [*cases, *("".join(x + rng.choice([" ", " ", ", ", "-", ",", "", "\n"]) for x in rng.choices(parts, k=rng.randint(2, 14))) for _ in range(4000))]
    rows = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        plain = pii.find(t)
        whole = sorted(plain + pii.disguised(t, plain), key=lambda s: (s[1], pii.KINDS.index(s[0])))
        assert rows[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in whole), t
        assert rows[i] == cases.get(t, rows[i])


def test_language_id(spark):
    kinds = {"aa": "ta ri no ke lo".split(), "bb": "sch ung ver lich ein".split(), "cc": "eau oui que tre ais".split()}
    rows = []
    for i in range(400):
        k = RNG.choice(list(kinds))
        rows.append((i, " ".join("".join(RNG.choices(kinds[k], k=RNG.randint(1, 3))) for _ in range(RNG.randint(15, 80))), k))
    rows += [(1000 + i, t, None) for i, t in enumerate(ODD)] + [(None, "ta ri no", "aa"), (7777, "12 34 !!", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r for r in langid.language_id(docs).collect()}
    held = [r for r in rows[:400] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == k for i, _, k in held]) > 0.97
    assert all(got[i]["lang_pred"] == "und" for i in (1000, 1001, 1002, 7777)) and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.language_id(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.Model([], [])).collect()} == {"und"}


def brute_lines(rows, ratio, pages):
    total, seen = Counter(), Counter()
    for _, host, t in rows:
        total[host] += 1
        seen.update((host, x.strip(" ")) for x in {x.strip(" ") for x in (t or "").split("\n")} if x) if t is not None else None
    gone = {k for k, n in seen.items() if n >= pages and n > ratio * total[k[0]]}
    return Counter((i, None if t is None else "\n".join(x for x in t.split("\n") if not x.strip(" ") or (h, x.strip(" ")) not in gone)) for i, h, t in rows)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_lines(spark, broadcast):
    rows = [(i, RNG.choice(["h1", "h1", "h2", None]), "\n".join(RNG.choices(["menu", " menu ", "", "foot", prose(3)], k=RNG.randint(1, 5)))) for i in range(200)] + [(200, "h1", None), (201, "h9", "menu"), (201, "h9", "menu"), (None, "h1", "menu\nmenu"), (202, "h1", "menu\n" * 20_000 + "x" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    got = lines.drop_boilerplate(df, ratio=0.3, broadcast_lines=broadcast)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == brute_lines(rows, 0.3, lines.MIN_PAGES)
    assert lines.drop_boilerplate(df.limit(0)).count() == 0


def test_lines_of_a_large_host(spark):
    """With the registered ratio, a line on 2 % of a host's pages goes and one on 0.6 % stays."""
    rows = [(i, "h", "\n".join([f"own {i}", *["licensed as it is"] * (i < 10), *["said thrice"] * (i < 3)])) for i in range(500)]
    got = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got == {i: "\n".join(x for x in t.split("\n") if x != "licensed as it is") for i, _, t in rows}


def test_mixing(docs_of):
    texts = ODD + [prose(RNG.randint(1, 60)) for _ in range(120)] + [prose(20).upper()]
    ids = [None, *range(1, len(texts) - 1), 5]
    got = defaultdict(list)
    for r in mixing.language_model_scores(docs_of(texts, ids)).collect():
        got[r["doc_id"]].append(r)
    toks = [[*words_of(t), "\n"] for t in texts]
    train = Counter(w for i, ws in zip(ids, toks) if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(train.values()), len(train)
    want = defaultdict(list)
    for i, ws in zip(ids, toks):
        want[i].append((len(ws), sum(train[w] > 0 for w in ws), n, pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws))))
    assert set(got) == set(want)
    for i, rows in got.items():
        assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows) == sorted(want[i], key=lambda x: x[:3])
        assert all(r["score"] < 0 for r in rows)
    assert sum(r["score"] for rows in got.values() for r in rows) / sum(map(len, toks)) > -5  # words of the same syllables are expected
    assert mixing.language_model_scores(docs_of([])).count() == 0


def mixing_texts(texts):
    out = mixing.Texts()
    for lo, hi, data, offs in text_slices(filled(pa.array(texts))):
        out.add(list(range(lo, hi)), [False] * (hi - lo), data, offs)
    out.close()
    return out


def mixing_model(train, tune):
    tune, train = mixing_texts(tune), mixing_texts(train)
    code, bits = mixing.prefix_code(np.bincount(train.chars, minlength=256)), (18, 18, 18, 18)
    tables = [np.zeros(2 << b, np.int32) for b in bits]
    mixing.count_bits(train, np.ones(len(train.doc_ids), bool), code, bits, tables)
    return mixing.learn(tune, code, bits, [mixing.log_odds(t) for t in tables])


def test_mixing_model():
    """Next bytes add up to 1, word order counts, a text's own past is learned from, and a text's score is its own."""
    rng = random.Random(4)
    vocabulary = [prose(1, rng) for _ in range(400)]
    after = {w: rng.choices(vocabulary, k=3) for w in vocabulary}

    def chain(n):
        w = [rng.choice(vocabulary)]
        while len(w) < n:
            w.append(rng.choice(after[w[-1]]))
        return " ".join(w)

    model = mixing_model([chain(80) for _ in range(300)], [chain(80) for _ in range(60)])
    for beginning in ("ta", "", "tarino"):
        # the word "<beginning><byte>" against "<beginning>", bit by bit, at the place of the byte
        total = 0.0
        for b in [*range(9), *range(14, 32), *range(33, 65), *range(91, 256)]:
            w = mixing.word_bits(np.array([len(beginning) + 1]), np.frombuffer(beginning.encode() + bytes([b]), np.uint8), model.code)
            lo = int(model.code.length[list(beginning.encode())].sum()) if beginning else 0
            at = np.arange(lo, lo + model.code.length[b])
            odds = [t[mixing._slots(h, k)] for t, h, k in zip(model.odds, w.contexts, model.bits)]
            total += float(np.exp(model.tail.cost([o[at] for o in odds], mixing._tail_gate(odds, at), w.node[at], w.bit[at]).sum()))
        for b, closed in ((32, True), (10, False)):  # a space closes the word; the rest of the bytes stand for no text
            w = mixing.word_bits(np.array([len(beginning) or 1]), np.frombuffer(beginning.encode() or b"\n", np.uint8), model.code)
            if closed and beginning:
                at = np.arange(len(w.bit) - model.code.length[32], len(w.bit))
                odds = [t[mixing._slots(h, k)] for t, h, k in zip(model.odds, w.contexts, model.bits)]
                total += float(np.exp(model.tail.cost([o[at] for o in odds], mixing._tail_gate(odds, at), w.node[at], w.bit[at]).sum()))
        assert 0.9 < total <= 1 + 1e-3
    tests = [chain(60) for _ in range(40)]
    shuffled = [" ".join(rng.sample(t.split(), 60)) for t in tests]
    costs, mixed = model.costs(mixing_texts(tests)), model.costs(mixing_texts(shuffled))
    assert (mixed < costs).mean() > 0.95
    once = [prose(50, rng) for _ in range(20)]
    alone, twice = model.costs(mixing_texts(once)), model.costs(mixing_texts([f"{t} {t}" for t in once]))
    assert (twice > 1.7 * alone).all()  # the second time costs less
    assert model.costs(mixing_texts(list(reversed(tests))))[::-1] == pytest.approx(costs)
    assert (model.costs(mixing_texts(["", "  ", "a" * 5000])) < 0).all()


def test_mixing_works_once_for_each_pair(monkeypatch):
    """What is counted and charged once for each distinct head, pair and rate equals a plain loop over tokens, at far fewer bits."""
    rng = random.Random(8)
    lines_ = [prose(rng.randint(1, 12), rng) for _ in range(12)] + ["é ab a ééé\x00 a\x00", "", "AB ab abc abcd"]
    texts = mixing_texts([f"{rng.choice(lines_)} {rng.choice(lines_)}" for _ in range(400)])
    model = mixing_model([prose(40, rng) for _ in range(60)], lines_)
    wanted = np.arange(len(texts.doc_ids)) % 3 > 0
    tables, plain = ([np.zeros(2 << b, np.int32) for b in model.bits] for _ in range(2))
    mixing.count_bits(texts, wanted, model.code, model.bits, tables)
    starts = np.cumsum(texts.lens) - texts.lens
    rate, want, bits = model.heads(texts).rate, [], 0
    for i, word in enumerate(texts.all_word):
        w = mixing.word_bits(texts.lens[word : word + 1], texts.chars[starts[word] : starts[word] + texts.lens[word]], model.code)
        before = np.uint64(0) if texts.fresh[i] else texts.keys[texts.all_word[i - 1]]
        own = [mixing._slots(h, k) for h, k in zip(w.contexts, model.bits)]
        n = w.head[0]
        pair = mixing._slots((w.contexts[2][:n] ^ (np.full(n, before) * mixing._M3)) * mixing._M1, model.bits[3])
        if wanted[texts.all_doc[i]]:
            for table, slot in zip(plain, [*own, pair]):
                np.add.at(table, 2 * slot + w.bit[: len(slot)], 1)
        odds = [t[slot] for t, slot in zip(model.odds, [*own, pair])]
        head, tail = [o[:n] for o in odds], [o[n:] for o in odds[:3]]
        gate = mixing._SURE4[head[3].view(np.uint8)] + mixing._SURE[head[2].view(np.uint8)] + 16 * rate[i]
        cost = model.head.cost(head, gate, w.node[:n], w.bit[:n]).sum(dtype=float)
        want.append(cost + model.tail.cost(tail, mixing._tail_gate(tail, slice(None)), w.node[n:], w.bit[n:]).sum(dtype=float))
        bits += n
    assert all((a == b).all() for a, b in zip(tables, plain))
    asked, hit, run, often = mixing.repeats(texts)
    p = model.again[run, often]
    want = np.where(asked, np.where(hit, np.log(p), np.log(1 - p) + want), want)
    done, cell = [], mixing.Mixer._cell
    monkeypatch.setattr(mixing.Mixer, "_cell", lambda self, dot, node: (done.append(len(dot)), cell(self, dot, node))[1])
    assert model.token_costs(texts) == pytest.approx(want, rel=1e-4)
    assert sum(done) < bits / 4
    keys = np.array([rng.choice([5, 5 << 60, (5 << 60) + 1, (1 << 64) - 1]) for _ in range(500)], dtype=np.uint64)
    assert (mixing._order(keys) == np.argsort(keys, kind="stable")).all()


def test_mixing_learns_from_all_training_texts(spark, docs_of):
    """Every training text is counted and teaches the mixers, also long ones, and the prefix code follows all their bytes."""
    texts = [prose(RNG.randint(1, 40)) for _ in range(1200)] + [prose(15_000), "ab\tcd", None, "x"]
    size = sum(len(t or "") for t in texts)
    model = mixing.fit(docs_of(texts), size)
    train = [words_of(t) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    shown = Counter(c for ws in train for w in ws for c in w.encode() + b" ")
    shown[10] = len(train)
    assert dict(enumerate(mixing.byte_counts(docs_of(texts).where(~mixing.fold(7, 2))))) == {b: shown[b] for b in range(256)}
    coded = [w.encode() + b" " for ws in train for w in ws] + [b"\n"] * len(train)
    bits = sum(int(model.code.length[list(w[: mixing.HEAD])].sum()) for w in coded)
    assert model.head.mass.sum() == model.head.seen.sum() == bits


def brute_rules(t):
    t = t or ""
    w = WORD.findall(t)
    g, cover, seen, dup = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), [0] * len(w), set(), 0
    for i in range(len(w) - 4):
        if g[tuple(w[i : i + 5])] > 1:
            cover[i : i + 5] = [1] * 5
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(cover)


def test_rules(spark, docs_of):
    good = [prose(60) + ". " + prose(20) for _ in range(300)]
    junk = [" ".join(w + "###" for w in prose(60).split()) for _ in range(40)]
    texts = ODD + good + junk + ["a b c d e f " * 20, "l1 x\nl1 x\nl2"]
    labels = spark.createDataFrame([(12 + i, int(i < 300)) for i in range(0, 340, 2)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in rules.quality_rules(docs_of(texts), labels).collect()}
    for i, t in enumerate(texts):
        want = brute_rules(t)
        assert tuple(got[i][c] for c in rules.COUNTS) == want
        assert got[i]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])
    kept = lambda a, b: np.mean([got[i]["kept"] for i in range(a, b)])
    assert kept(12, 312) > 0.97 and kept(312, 352) < 0.2
    assert rules.quality_rules(docs_of([]), labels.limit(0)).count() == 0


def test_rules_learn_from_all_rows(spark, docs_of, monkeypatch):
    """More rows than a sample held: all teach the trees, a repeated id with each text, and all labelled rows set the threshold."""
    texts = [prose(12 + i % 9) for i in range(9000)] + ["too short"] * 5
    ids = [*range(8000), *[7999] * 1000, *range(9000, 9005)]
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(0, 8000, 2)], "doc_id long, quality int")
    told, add = [], rules.Growth.add_level
    monkeypatch.setattr(rules.Growth, "add_level", lambda self, key, low, high, weight: (told.append((self.level, weight.sum())), add(self, key, low, high, weight))[1])
    assert rules.fit(docs_of(texts, ids), labels) is not None
    good, plain = 3200, 9000 - 4000
    copies = -(-rules.PER_TREE * rules.TREES // (good + plain))
    assert told[0] == (0, pytest.approx(len(rules.VIEWS) * copies * (good + rules.UNLABELLED_SHARE * good)))
    rng = np.random.default_rng(3)
    rows = [(v, round(float(rng.normal(0 if g else 1 + v)), 2), bool(g)) for v in range(2) for g in (rng.random(3000) < 0.8)] + [(2, 0.5, True)]
    got = rules.calibrate(spark.createDataFrame(rows, "view int, score double, good boolean"), 0.01)
    assert set(got) == {0, 1}
    for v in got:
        score, fine = (np.array([r[k] for r in rows if r[0] == v]) for k in (1, 2))
        gains = {t: (score[~fine] > t).mean() - (score[fine] > t).mean() for t in np.unique(score) if (score[fine] > t).mean() <= 0.01}
        assert got[v] == (max(gains, key=gains.get), pytest.approx(max(gains.values())))


def test_samples_are_bounded_where_an_id_repeats(spark, docs_of):
    """10,000 rows of one id are one row of the sample."""
    docs = docs_of([f"text {i} of many" for i in range(10_000)] + [prose(20) for _ in range(50)], [1] * 10_000 + list(range(10, 60)))
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (10, 1, 0), (11, 0, 1)], "doc_id long, toxic int, quality int")
    assert toxicity._sampled(docs, labels, 40, 40).count() <= 80
    assert rules.fit(docs, labels) is not None
    assert rules.sampled(docs, labels, 40, 40).count() <= 80


def test_clashing_names_in_any_case(spark):
    """Columns named like results or helpers are replaced or kept, whatever their case."""
    rows = [(i, prose(20), "en", "s", 1.0, "x", "y", "z", 3, "q") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, Score double, LEAKS string, __leaks string, __host string, N_lines int, Kept string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)], "doc_id long, toxic int, quality int")
    bench = spark.createDataFrame([(1, prose(12)), (2, prose(12))], "item_id long, text string")
    for got, gone in (
        (toxicity.toxicity(docs, labels), {"score"}), (contamination.leaks(docs, bench, block_bytes=8), {"leaks"}), (lines.drop_boilerplate(docs), {"n_lines"}),
        (langid.language_id(docs), {"score"}), (rules.quality_rules(docs, labels), {"kept"}), (pii.personal_data(docs), set()), (jaccard.one_of_each_group(docs), set()),
    ):
        assert got.count() == 30 and len({c.lower() for c in got.columns}) == len(got.columns)
        assert {c for c in docs.columns if c.lower() not in gone} <= set(got.columns)


def test_toxicity(spark, docs_of):
    rng = random.Random(6)
    toxic = ["vilex", "crudon", "harshy"]

    def doc(bad):
        w = prose(rng.randint(20, 80), rng).split()
        for _ in range(rng.randint(2, 4) * bad):
            w.insert(rng.randrange(len(w)), rng.choice(toxic))
        return " ".join(w)

    marks = [int(rng.random() < 0.2) for _ in range(500)]
    texts = [doc(m) for m in marks] + ODD
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks) if i % 2], "doc_id long, toxic int")
    docs = docs_of(texts)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == marks[i] for i in held]) > 0.95
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got.values()) and got[500]["score"] == got[501]["score"]
    assert set(docs.columns) | {"predicted"} == set(toxicity.toxicity(docs, labels).columns)
    assert {r["predicted"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.toxicity(docs_of([]), labels).count() == 0
