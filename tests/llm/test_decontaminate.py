"""Decontamination against a full edit-distance search of every item in every text."""

import random
import string

import pytest

from plumbline.llm import decontaminate

from . import brute

WORDS = ["the", "of", "map", "river", "contour", "sheet", "printed", "north", "graticule", "a", "is", "scale"]


def edited(text, n, rnd):
    chars = list(text)
    for _ in range(n):
        at, what = rnd.randrange(1, len(chars) - 1), rnd.randrange(3)
        if what == 0:
            chars[at] = rnd.choice("xyz")
        elif what == 1:
            chars.insert(at, rnd.choice("xyz"))
        else:
            del chars[at]
    return "".join(chars)


def expected(items, texts):
    return {(d, i) for d, t in texts.items() for i, x in items.items() if brute.edit_distance_within(decontaminate.fold(x), decontaminate.fold(t)) <= decontaminate.budget(len(x))}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def check(items, texts, got):
    assert {(r[0], r[1]) for r in got} == expected(items, texts)
    for d, i, start, end, edits in got:
        assert distance(decontaminate.fold(items[i]), decontaminate.fold(texts[d])[start:end]) == edits <= decontaminate.budget(len(items[i]))
    for d, i in {(r[0], r[1]) for r in got}:
        spans = sorted((r[2], r[3]) for r in got if (r[0], r[1]) == (d, i))
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def run(items, texts):
    index = decontaminate.Index(list(items.items()))
    keys = list(texts)
    return [(keys[n], i, m[1], m[2], m[3]) for n, ms in enumerate(decontaminate.find(index, list(texts.values()))) for m in ms for i in index.ids[m[0]]]


@pytest.mark.parametrize(("hot", "hits"), [(64, 1 << 20), (1, 7)])
def test_edited_passages(monkeypatch, hot, hits):
    monkeypatch.setattr(decontaminate, "HOT", hot)
    monkeypatch.setattr(decontaminate, "HITS", hits)
    rnd = random.Random(hot)
    text = lambda n: " ".join(rnd.choice(WORDS) + rnd.choice(["", "", rnd.choice(string.ascii_lowercase)]) for _ in range(n))
    items = {k: text(n)[: n * 4] for k, n in enumerate([1, 2, 3, 4, 5, 6, 8, 10, 15, 20, 40])} | {50: "a tiny phrase!", 51: "thirteen char", 52: "fifteen letters"}
    items[60] = items[9]
    texts = {}
    for k, x in items.items():
        for n in (0, decontaminate.budget(len(x)), decontaminate.budget(len(x)) + 1, decontaminate.budget(len(x)) + 4):
            if len(x) > 2 * n + 2:
                texts[100 * k + n] = f"{text(rnd.randrange(30))} {edited(x, n, rnd)} {text(rnd.randrange(30))}"
    texts |= {-1: "", -2: "a", -3: text(300), -4: "A tinY phrasX! and\ta\ntiny phrase! and a tiny phrase!"}
    check(items, texts, run(items, texts))


def test_short_items():
    items = {1: "a tiny phrase!", 2: "tiny"}
    got = run(items, {7: "a tinY phrasX! then a tiny phrase! then a tny phrase!"})
    assert [(i, e) for _, i, _, _, e in got] == [(1, 1), (1, 0), (1, 1), (2, 0), (2, 0)]


def test_repeated_character():
    items = {1: "a" * 100, 2: "ab" * 60, 3: "a" * 12}
    texts = {1: "a" * 5000, 2: "b" + "a" * 150 + "c", 3: "ab" * 400, 4: "a" * 89}
    got = run(items, texts)
    check({1: items[1]}, {2: texts[2], 4: texts[4]}, [r for r in got if r[1] == 1 and r[0] in (2, 4)])
    assert 45 <= sum(r[:2] == (1, 1) for r in got) <= 50 and sum(r[:2] == (1, 3) for r in got) == 5000 // 12 and (3, 2) in {r[:2] for r in got}


def test_blocks(spark, monkeypatch):
    """Several blocks of the benchmark, repeated and null items, a row without an id."""
    monkeypatch.setattr(decontaminate, "BLOCK", 60)
    rnd = random.Random(3)
    items = {k: " ".join(rnd.choice(WORDS) + str(rnd.randrange(99)) for _ in range(6)) for k in range(12)}
    texts = {k: f"before {x.upper()} after" for k, x in items.items()} | {90: "nothing here"}
    bench = spark.createDataFrame([*items.items(), (77, items[3]), (78, None), (79, "")], "item_id long, text string")
    docs = spark.createDataFrame([*texts.items(), (None, items[5]), (91, None)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    assert got == {(k, k) for k in items} | {(3, 77), (None, 5)}
    assert {r.doc_id for r in decontaminate.clean_only(docs, bench).collect()} == {90, 91}
