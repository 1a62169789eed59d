"""The methods of the URL filter, of hard negatives and of the manifest, beyond their queries' rows."""

import random
from math import log2

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import manifest, negatives, urls

from . import brute

DATA = "/root/testdata/sf0.1"


def test_url_features(spark):
    url = "https://Sub.My-Host.example.com/a/b2//c.html?x=1&y&&z=2#f#"
    host, path = urls.host_and_path(F.col("u"))
    made = {k: v for part in (urls.lexical(F.col("u"), host, path), urls.names(host, path)) for k, v in part.items()}
    r = spark.createDataFrame([(url,)], "u string").select(*(c.alias(k) for k, c in made.items())).first()
    n = len(url)
    bits = -sum(url.count(c) / n * log2(url.count(c) / n) for c in set(url))
    assert (r.length, r.depth, r.parameters, r["values"], r.labels, r.hyphens, r.secure, r.fragment) == (n, 3, 3, 2, 4, 1, 1, 2)
    assert r.digits == pytest.approx(3 / n) and r.entropy == pytest.approx(bits)
    assert (r.top, r.domain, r.segment, r.extension) == ("com", "example.com", "a", "html")


def test_trees_on_hidden_labels(spark):
    """URLs whose labels the trees never saw: a rule on two names at once, and one on the form of the path alone."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    seen = F.pmod(F.xxhash64("url"), F.lit(3)) > 0
    got = urls.judge(pages, learn=seen).join(pages.select("page_id", "url"), "page_id").filter(~seen & F.col("rule").isNotNull())
    right, n = got.select(F.sum(((F.col("score") >= 0.5) == (F.col("verdict") == "block")).cast("int")), F.count("*")).first()
    assert n > 200 and right >= 0.97 * n
    rnd = random.Random(3)
    form = lambda bad: "/".join(rnd.choice(("news", "item", "page")) + (str(rnd.randrange(10**9)) if bad else "") for _ in range(6 if bad else 2))
    rows = [(k, f"http://h{k % 50}.{'bad' if k % 2 else 'good'}/{form(k % 2)}") for k in range(600)]
    rows += [(1000 + k, f"http://x{k}.other/{form(k % 2)}") for k in range(200)]
    rules = [("block", "bad", "/"), ("allow", "good", "/")]
    new = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).filter("rule is null").collect()
    assert sum((r.verdict == "block") == (r.page_id % 2) for r in new) >= 0.95 * len(new) == 190


def test_one_kind_of_label(spark):
    rows = spark.createDataFrame([(1, "http://a.bad/x"), (2, "http://b.good/"), (3, None)], "page_id long, url string")
    verdicts = lambda rules: {r.page_id: (r.verdict, r.score) for r in urls.judge(rows, rules=rules).collect()}
    assert verdicts([]) == {k: ("allow", None) for k in (1, 2, 3)}
    assert verdicts([("block", "bad", "/")]) == {k: ("block", None) for k in (1, 2, 3)}
    assert verdicts([("allow", "bad", "/")]) == {k: ("allow", None) for k in (1, 2, 3)}


@pytest.mark.parametrize("width", [1, 3, 40])
def test_bounds_hold(width):
    """The true score lies within the bounds for rows that the codebooks never saw, far ones included."""
    rnd = np.random.default_rng(width)
    q = negatives.Quantiser.fit(rnd.integers(-90, 90, (300, width)))
    x, a = rnd.integers(-90, 90, (500, width)) * rnd.choice([1, 50, 10**6], (500, 1)), rnd.integers(-90, 90, (20, width))
    search = negatives.Search(q, a, np.zeros(20, np.int64), np.arange(20), 5)
    sums, apart = search.bounds(*q.encode(x))
    assert (np.abs(x @ a.T - sums) <= apart).all()
    assert len(q.books) == min(width, negatives.SUBSPACES)


def test_few_are_scored():
    """The bounds discard all but a small share of the rows."""
    rnd = np.random.default_rng(0)
    x = np.floor(256 * (v := rnd.normal(size=(20000, 64))) / np.linalg.norm(v, axis=1)[:, None]).astype(np.int64)
    q = negatives.Quantiser.fit(x[:4096])
    search = negatives.Search(q, x[:10], np.zeros(10, np.int64), np.arange(10), 5)
    codes, left = q.encode(x)
    search.see(np.arange(2000), np.arange(2000), np.zeros(2000, np.int64), x[:2000], codes[:2000], left[:2000])
    sums, apart = search.bounds(codes[2000:], left[2000:])
    assert (sums + apart >= search.best.last).mean() < 0.06


@pytest.mark.parametrize("bucket", [3, 40])
def test_ranks_of_crowded_prefixes(spark, bucket):
    """Many rows without an id, repeated ids and equal rows: with small buckets every digit is used."""
    rnd = random.Random(bucket)
    rows = [(rnd.choice([None, 5, 5, 6, -1, 1 << 40, rnd.randrange(-(10**12), 10**12)]), rnd.choice([None, "a", "b", "A", ""]), rnd.choice("xyzXYZ")) for _ in range(300)]
    docs = spark.createDataFrame([(k, s, None, 1, t) for k, s, t in rows], "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = manifest.manifest(docs, received=manifest.tampered_field, bucket=bucket)
    folded = manifest.fold(F.col("path"), F.coalesce("received_leaf", "leaf"))
    got = got.select("id", "leaf", "subroot", "root", manifest.proof_hash(F.col("path")), folded, folded == F.col("root"))
    assert sorted(map(tuple, got.collect()), key=str) == brute.merkle([(k, s, None, 1, t) for k, s, t in rows])


def test_many_groups(spark):
    """More groups than a bucket, of names with long common beginnings."""
    rows = [(k, f"http://host/{'p' * (k % 7)}{k % 90}", "en", 1, "T") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = manifest.manifest(docs, received=manifest.tampered_field, bucket=8)
    folded = manifest.fold(F.col("path"), F.coalesce("received_leaf", "leaf"))
    got = got.select("id", "leaf", "subroot", "root", manifest.proof_hash(F.col("path")), folded, folded == F.col("root"))
    assert sorted(map(tuple, got.collect()), key=str) == brute.merkle(rows)
