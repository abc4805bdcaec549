"""Texts that are long, periodic or full of identifiers: results as by plain code, in time that grows with their length."""

import random
import time

import numpy as np
import pytest

pytest.importorskip("quakeframe.llm")
from quakeframe.llm import contamination, pii  # noqa: E402

RNG = random.Random(4)


def seconds(f):
    began = time.process_time()
    f()
    return time.process_time() - began


@pytest.mark.parametrize(
    "text",
    ["\u2014" + " " * 1_000_000 + "x", "a at b " + "[ " * 300_000 + "dot ]", " ".join(f"us{i}@ex{i}.org" for i in range(30_000)) + " \u2014 j\u043ee [at] site [dot] org", "one two three " + "\t " * 500_000 + "four", "a at " + "b dot " * 150_000, "plus " * 200_000],
    ids=["spaces", "brackets", "emails", "tabs", "dots", "plus"],
)
def test_pii_of_long_texts(text):
    assert seconds(lambda: pii.scan(text, True, True)) < 8


def every_pair(text, plain):
    """Disguised spans, each held against all others."""
    traced, out = pii.normalise(text), []
    for kind, a, b in pii.find(traced.text) if traced.text != text else ():
        start, end = int(traced.start[a]), int(traced.end[b - 1])
        while end > start and text[end - 1].isspace():
            end -= 1
        apart = all(end <= s or start >= e or (start <= s and e <= end and e - s < end - start) for _, s, e in plain)
        if apart and all(k != kind or end <= s or start >= e for k, s, e in out):
            out.append((kind, start, end))
    return out


def test_pii_spans_as_by_every_pair():
    parts = ["b\u043eb@site.org", "ann [at] mail [dot] de", "joe@x.org", "192.168.0.1", "4111 1111 1111 1111", "4111\u00a01111\u00a01111\u00a01111", "+44 20 7946 0958", "plus four four two zero 7946 0958", "\uff11\uff19\uff12.168.0.2", "sue at home dot org", " ", "  \t", ",", "@", "(at)", "[dot]", "one two three", "\u2014"]
    found = 0
    for _ in range(1500):
        text = RNG.choice(["", " "]).join(RNG.choices(parts, k=RNG.randint(1, 12)))
        plain = pii.find(text)
        want = every_pair(text, plain)
        found += len(want)
        assert pii.disguised(text, plain) == want, text
    assert found > 500


def test_brackets_take_the_space_before():
    assert pii.normalise("a  [at]\n b \t(dot) org").text == "a@b.org"
    assert pii.normalise("[at] [at]x").text == "@@x"


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        last, row[0] = row[0], i + 1
        for j, d in enumerate(text):
            last, row[j + 1] = row[j + 1], min(last + (c != d), row[j] + 1, row[j + 1] + 1)
    return min(row)


def leaks(items, text):
    data = np.frombuffer(text.encode(), np.uint8)
    return contamination.Index(list(enumerate(items)), 0.1).leaks(data, np.array([0, len(data)])).get(0, {})


def test_decontamination_of_periodic_texts():
    near = "ab " * 100 + "ab abxxab"
    assert seconds(lambda: leaks([near, "ab " * 90 + "zz"], "ab " * 330_000 + "end")) < 12
    for _ in range(60):
        unit = "".join(RNG.choices("ab ", k=RNG.randint(1, 4)))
        text = list(unit * RNG.randint(20, 60))
        item = list(unit * RNG.randint(5, 12))
        for some in (text, item):
            for _ in range(RNG.randint(0, 4)):
                some[RNG.randrange(len(some))] = RNG.choice("abc")
        text, item = "".join(text), "".join(item)
        if len(item) < contamination.LEAST_BYTES or not item.strip():
            continue
        want = plain_distance(item.encode(), text.encode())
        assert leaks([item], text) == ({0: want} if want <= contamination.budget(len(item)) else {}), (item, text)


def test_decontamination_at_the_ends_of_texts():
    """Items that texts begin or end with, cut off or with edits, in words of few syllables."""
    prose = lambda n: " ".join("".join(RNG.choices("ta ri no ke".split(), k=RNG.randint(1, 3))) for _ in range(n))
    hits = 0
    for _ in range(250):
        items = [prose(RNG.randint(3, 14)) for _ in range(3)]
        item = list(RNG.choice(items))
        for _ in range(RNG.randint(0, 6)):
            item[RNG.randrange(len(item))] = RNG.choice("taxyz ")
        item = "".join(item)[RNG.randint(0, 3) :]
        text = RNG.choice([item, item + " " + prose(6), prose(6) + " " + item, item + item, prose(2) + item + prose(2) + item[: len(item) // 2]])
        want = {i: d for i, x in enumerate(items) if len(x) >= contamination.LEAST_BYTES and (d := plain_distance(x.encode(), text.encode())) <= contamination.budget(len(x))}
        hits += len(want)
        assert leaks(items, text) == want, (items, text)
    assert hits > 80
