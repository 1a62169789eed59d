"""The pivot tables against brute force over all pairs, with ordinary and with crowded keys."""

import random
from itertools import combinations

import pytest

from plumbline.llm import simhash

from . import brute


def near(prints, distance):
    return {(a, b) for a, b in combinations(sorted(prints), 2) if (a ^ b).bit_count() <= distance}


def planted(seed):
    """Fingerprints with relatives one to four bits away, and a crowd around one of them."""
    rnd = random.Random(seed)
    found = {0, (1 << 64) - 1, *(rnd.getrandbits(64) for _ in range(60))}
    for x in list(found)[:40]:
        for n in range(1, 5):
            found.add(x ^ sum(1 << i for i in rnd.sample(range(64), n)))
    middle = rnd.getrandbits(64)
    found |= {middle ^ sum(1 << i for i in rnd.sample(range(12), rnd.randint(0, 6))) for _ in range(150)}
    found |= {middle ^ 1 << i for i in range(64)}
    return {simhash._signed(x) for x in found}


@pytest.mark.parametrize(("distance", "bucket"), [(2, 48), (2, 2), (1, 2), (3, 2)])
def test_links(spark, distance, bucket):
    prints = planted(distance)
    found = simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long"), distance, bucket).collect()
    unsigned = lambda x: x & simhash.ALL
    got = {tuple(sorted((unsigned(r.u), unsigned(r.v)))) for r in found}
    assert got == near(map(unsigned, prints), distance)


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_regions(distance):
    """Any fingerprints that close agree in a region of every level, and a region leaves its bits closed."""
    rnd = random.Random(distance)
    for _ in range(200):
        differs = sum(1 << i for i in rnd.sample(range(64), distance))
        open_ = {simhash.ALL}
        for level in simhash.regions(distance):
            open_ = {left for bits, region, left in level if bits in open_ and not region & differs}
            assert open_ and all((differs & left) == differs for left in open_)


def test_groups(spark):
    words = [f"w{i}" for i in range(400)]
    texts = {k: " ".join(words[: 400 - k]) for k in range(6)} | {20: None, 21: "", 22: "one two", 23: "ONE  two", 24: "apart from all others"}
    rows = [(None, "one two"), *texts.items(), (24, "apart from all others")]
    got = simhash.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = {k: brute.simhash(t or "") for k, t in texts.items()}
    expected = brute.groups(prints)
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(expected.items())
    assert [r.component_id for r in got if r.doc_id is None] == [22]


@pytest.mark.parametrize("bucket", [1000, 2])
def test_nearest(spark, bucket):
    """The nearest fingerprint within the distance; under crowded keys fewer, but never one further off."""
    prints = planted(7)
    found = {r.u: r.v for r in simhash.nearest(spark.createDataFrame([(x,) for x in prints], "fp long"), 4, bucket).collect()}
    apart = lambda a, b: ((a ^ b) & simhash.ALL).bit_count()
    best = {u: min(apart(u, v) for v in prints if v != u) for u in prints}
    assert found and all(apart(u, v) <= 4 and v != u for u, v in found.items())
    if bucket == 1000:
        assert {u: apart(u, v) for u, v in found.items()} == {u: d for u, d in best.items() if d <= 4}
