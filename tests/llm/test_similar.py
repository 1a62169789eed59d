"""The near-dedup stage against brute force over all pairs, with and without crowded keys."""

import random
from itertools import combinations

import pytest

import corpus_pipeline
from plumbline.llm import similar

FIELDS = "doc_id long, text string"


def brute(texts):
    """The least id reachable over links of similarity 0.8 or more between sets of five-word shingles."""
    words = {k: (t or "").encode().lower().split() for k, t in texts.items()}
    sets = {k: {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for k, w in words.items()}
    of = {k: k for k in sets}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((find(a), find(b)))
            of[b] = a
    return {k: find(k) for k in sets}


def chain(first, n, name):
    """n texts, each five words on from the last: neighbours are similar, ends are not."""
    words = [f"{name}{i}" for i in range(100 + 5 * n)]
    return {first + k: " ".join(words[5 * k : 5 * k + 100]) for k in range(n)}


@pytest.mark.parametrize("bucket", [similar.BUCKET, 2])
def test_groups(spark, bucket):
    line = " ".join(f"common{i}" for i in range(30))
    texts = chain(1, 12, "a") | {100 + k: f"{line} " + " ".join(f"w{k}x{i}" for i in range(20)) for k in range(8)}
    texts |= {200 + k: f"{line} {k}" for k in range(8)} | {300: None, 301: "", 302: "two words", 303: "Two  words", 304: "two"}
    texts |= {400: " ".join("abcdefghijkl"), 401: " ".join("abcdefghijklm"), 402: " ".join("abcdefghijXl")}
    rows = [(None, "two words"), *texts.items()]
    got = {r.doc_id: r.component_id for r in similar.group(spark.createDataFrame(rows, FIELDS), bucket=bucket).collect()}
    assert got == brute(texts)
    assert got[12] == 1 and got[207] == 200 and got[107] == 107 and got[303] == 302 and got[401] == 400 and got[402] == 402


def test_stage(spark, messy_dir, texts):
    docs = spark.read.parquet(f"{messy_dir}/documents.parquet")
    kept = [r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, messy_dir).collect()]
    expected = {None, *brute({k: t for k, t in texts if k is not None}).values()}
    assert set(kept) == expected and len(kept) == len(expected)


@pytest.mark.parametrize("bucket", [similar.BUCKET, 3])
def test_variants(spark, bucket):
    """A large group of near copies, some further from the original than the limit and from each other, all under the same keys."""
    rnd = random.Random(bucket)
    base = [f"word{i}" for i in range(200)]
    texts = {1: " ".join(base), 2: " ".join(base[:170]), 3: " ".join(base[30:])}
    for k in range(10, 90):
        words = list(base)
        for n in range(rnd.randrange(1, 9)):
            words[rnd.randrange(200)] = f"x{k % 40}y{n}" if rnd.random() < 0.5 else f"z{k}y{n}"
        texts[k] = " ".join(words)
    got = {r.doc_id: r.component_id for r in similar.group(spark.createDataFrame([*texts.items()], FIELDS), bucket=bucket).collect()}
    assert got == brute(texts) and len(set(got.values())) > 5


def letters(n, seed, own):
    """Form letters: 160 to 200 words of one template, and own words."""
    rnd = random.Random(seed)
    return {k: " ".join([f"t{i}" for i in range(rnd.randrange(160, 201))] + [f"own{k}x{i}" for i in range(own)]) for k in range(n)}


def test_form_letters(spark, monkeypatch):
    """Sets of mixed sizes under the same crowded keys: what is verified grows with the letters, not with their pairs."""
    counts, plain = [], similar.verified

    def counted(pairs, *rest):
        counts[-1] += pairs.distinct().count()
        return plain(pairs, *rest)

    monkeypatch.setattr(similar, "verified", counted)
    for own in (24, 6):
        for n in (200, 400, 800):
            texts = letters(n, own, own)
            counts.append(0)
            got = {r.doc_id: r.component_id for r in similar.group(spark.createDataFrame([*texts.items()], FIELDS)).collect()}
            if n < 800:
                assert got == brute(texts)
        assert counts[-1] <= 2.2 * counts[-2] <= 5 * counts[-3] and counts[-1] <= 20 * n, (own, counts)


def test_two_families(spark):
    """Two families of near copies and strays between them, all with one passage under crowded keys."""
    rnd = random.Random(1)
    passage = [f"p{i}" for i in range(40)]
    texts = {}
    for f in range(2):
        body = [f"f{f}w{i}" for i in range(120)]
        for k in range(70):
            words = list(body)
            for n in range(rnd.randrange(0, 6)):
                words[rnd.randrange(120)] = f"z{f}{k}y{n}"
            texts[f * 100 + k] = " ".join(words[: rnd.randrange(90, 121)] + passage)
    for k in range(60):
        texts[300 + k] = " ".join(passage[: rnd.randrange(30, 41)] + [f"s{k % 25}x{i}" for i in range(rnd.randrange(0, 12))])
    for bucket in (3, 20):
        got = {r.doc_id: r.component_id for r in similar.group(spark.createDataFrame([*texts.items()], FIELDS), bucket=bucket).collect()}
        assert got == brute(texts)


def test_pivot_tables_come_first(spark, monkeypatch):
    """Near copies whose fingerprints are few bits apart are linked by the tables, and the exact search sees other pairs alone."""
    rnd = random.Random(5)
    texts = {}
    for k in range(0, 40, 2):
        words = [f"d{k}w{i}" for i in range(1500)]
        texts[k] = " ".join(words)
        words[rnd.randrange(1500)] = "changed"
        texts[k + 1] = " ".join(words)
    texts |= chain(100, 6, "far")
    asked, plain = [], similar.verified

    def seen(pairs, *rest):
        found = plain(pairs, *rest)
        asked.append(({tuple(sorted(r)) for r in pairs.collect()}, {tuple(r) for r in found.collect()}))
        return found

    monkeypatch.setattr(similar, "verified", seen)
    docs = spark.createDataFrame([*texts.items()], FIELDS)
    got = {r.doc_id: r.component_id for r in corpus_pipeline.simhash.group(docs, words_of=5, distance=4, similarity=similar.SIMILARITY).collect()}
    assert got == brute(texts)
    (tried, linked), (rest, _) = asked[:2]
    assert len(linked) >= 10 and linked <= tried and not linked & rest
