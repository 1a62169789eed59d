"""Each query's rows over a messy table against a plain version, and over empty tables."""

import json
import math
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import katz, negatives, registry, urls

from . import brute
from .conftest import DATA
from .test_similar import brute as near_copies


def rows_of(spark, name, at):
    return {r.doc_id: r for r in registry.QUERIES[name](spark, at).collect()}


def tokenizer(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_padding()
    t.no_truncation()
    return t


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert registry.QUERIES[name](spark, empty_dir).count() == 0


def test_op1(spark, messy_dir, texts):
    rows = rows_of(spark, "op1_toxicity", messy_dir)
    assert set(rows) == {k for k, _ in texts}
    for k, t in texts:
        r = rows[k]
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (None if k is None else brute.remainder(k, 5) == 0)
        if not any(map(str.isalpha, t)):
            assert r.score == 0
    assert rows[900006].score == rows[900007].score


def test_op2(spark, messy_dir, texts):
    rows = rows_of(spark, "op2_language", messy_dir)
    assert set(rows) == {k for k, _ in texts}
    for k, t in texts:
        r = rows[k]
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, t))) and 0 <= r.score <= 1
        assert r.held_out == (None if k is None else brute.remainder(k, 4) == 2)
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{messy_dir}/documents.parquet").filter("doc_id < 900000").collect()}
    held = [k for k in truth if brute.remainder(k, 4) == 2]
    assert sum(rows[k].lang_pred == truth[k] for k in held) >= 0.95 * len(held)


def test_op3(spark, messy_dir, texts):
    rows, t, at = rows_of(spark, "op3_token_files", messy_dir), tokenizer("word_bpe_49k.json"), 0
    for k, text in sorted(texts, key=lambda x: (x[0] is not None, x[0])):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes())), k
        at += len(ids)


def test_op4(spark, messy_dir, texts):
    rows, t = rows_of(spark, "op4_bpe_codec", messy_dir), tokenizer("word_bpe_49k.json")
    for k, text in texts:
        ids = t.encode(text, add_special_tokens=False).ids
        got = rows[k]
        assert (got.n_tokens, got.ids_sha256, got.decoded_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t.decode(ids, skip_special_tokens=False))), k


def test_op5(spark, messy_dir, texts):
    rows = rows_of(spark, "op5_pii", messy_dir)
    for k, text in texts:
        spans, r = brute.base_spans(text), rows[k]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == i for s in spans) for i in range(4)], k
        assert r.base_sha256 == brute.sha(brute.written(spans))
        got = r.spans.split(",") if r.spans else []
        assert {s for s in brute.written(spans).split(",") if s} <= set(got)
        assert got == sorted(got, key=lambda s: (int(s.split(":")[1]), brute.KINDS.index(s.split(":")[0])))


def test_op6(spark, messy_dir, texts):
    rows = registry.QUERIES["op6_simhash"](spark, messy_dir).collect()
    prints = {k: brute.simhash(t) for k, t in texts if k is not None}
    expected = brute.groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows if r.doc_id is not None}
    assert got == {k: (f"{prints[k]:016x}", expected[k]) for k in prints} and len(rows) == len(texts)


@pytest.mark.parametrize("places", [katz.PLACES, 0, 1])
def test_op7(spark, messy_dir, texts, monkeypatch, places):
    """With places 0 and 1, all bigrams or all repeated ones stay with their block."""
    monkeypatch.setattr(katz, "PLACES", places)
    rows = rows_of(spark, "op7_katz", messy_dir)
    train = [t for k, t in texts if k is not None and brute.remainder(k, 7) != 2]
    model = brute.Katz(train, katz.discounts, katz.K, katz.RESERVE)
    for v in (b"", b"the", b"of"):
        assert sum(model.p(v, w) for w in model.c) + model.weight(v) * model.unknown == pytest.approx(1, abs=1e-9)
    for k, t in texts:
        r, w = rows[k], model.words(t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in model.c for x in w), model.n)
        assert r.held_out == (k is None or brute.remainder(k, 7) == 2)
        assert r.base_score == pytest.approx(model.base(t), rel=1e-9) and r.score == pytest.approx(model.score(t), rel=1e-9), k


def test_op8(spark, messy_dir, texts):
    rows, equal = rows_of(spark, "op8_media", messy_dir), {}
    for k, text in texts:
        raw = text.encode()
        payload = raw + bytes(max(64, math.ceil(len(raw) / 64) * 64) - len(raw))
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), brute.sha(payload), zlib.crc32(payload[-64:]))
        assert r.media_type == "audio/wav" and r.declared != r.media_type and r.media_bytes == len(payload) + 44
        values = (r.media_sha256, r.feature)
        assert equal.setdefault(text, values) == values


def test_op9(spark, messy_dir, texts):
    got = {(r.doc_id, r.item_id) for r in registry.QUERIES["op9_decontaminate"](spark, messy_dir).collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{messy_dir}/benchmark.parquet").collect() if r.text}
    assert {(k, i) for k, t in texts for i, x in items.items() if x in t} <= got
    for k, i in got:
        text = next(t for d, t in texts if d == k).lower().replace("\n", " ")
        assert items[i].lower().replace("\n", " ") in text or brute.edit_distance_within(items[i].lower(), text) <= 0.08 * len(items[i])


def test_op10(spark, messy_dir, texts):
    rows, t = rows_of(spark, "op10_token_counts", messy_dir), tokenizer("byte_bpe_50k.json")
    for k, text in texts:
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (rows[k].n_bytes, rows[k].n_tokens, rows[k].over_limit) == (len(text.encode()), n, n > 512), k


def test_op11(spark, messy_dir):
    rows = registry.QUERIES["op11_url_filter"](spark, messy_dir).collect()
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{messy_dir}/pages.parquet").collect()]
    expected = sorted(((k, *brute.host_and_path(u)) for k, u in pages), key=str)
    assert sorted(((r.page_id, r.host, r.path) for r in rows), key=str) == expected
    for r in rows:
        rule, verdict = brute.rule_of(r.host, r.path, urls.RULES)
        assert r.rule == rule and r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow")) and 0 <= r.score <= 1


@pytest.mark.parametrize("block", [negatives.BLOCK, 3])
def test_op12(spark, messy_dir, block):
    """With blocks of 3 anchors there are several."""
    table = spark.read.parquet(f"{messy_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mine(table, F.col("vec_id") % 100 == 0, label, block=block)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = brute.hard_negatives([(r.vec_id, r.label, r.embedding) for r in table.select("vec_id", "label", "embedding").collect()])
    assert sorted(map(tuple, got.select(names).collect())) == expected and len({e[0] for e in expected}) > 5


def test_op13(spark, messy_dir):
    got = registry.QUERIES["op13_merkle"](spark, messy_dir)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    docs = spark.read.parquet(f"{messy_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    assert sorted(map(tuple, got.select(names).collect()), key=str) == brute.merkle(map(tuple, docs))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    other = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.SQL[name]})").fetchall()
    assert other and sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(other, key=str)


def test_pipeline(spark, messy_dir, texts):
    """Stage by stage against plain versions of the stages' decisions."""
    docs = spark.read.parquet(f"{messy_dir}/documents.parquet").drop("score")
    columns = docs.columns
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, messy_dir).cache()
        assert docs.columns == columns
        kept.append(({r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in docs.collect()}))
    (a, b), (_, c), (_, d), (_, e) = kept
    assert all(any(map(str.isalpha, t)) for t in b.values()) and set(b) >= {k for k, t in a.items() if t and len(t) > 200 and (k or 900000) < 900000}
    assert set(c) == {None, *near_copies({k: t for k, t in b.items() if k is not None}).values()} & set(b)
    items = [r.text for r in spark.read.parquet(f"{messy_dir}/benchmark.parquet").collect() if r.text]
    assert not [k for k, t in d.items() if any(x in t for x in items)]
    assert set(d) == set(e) and not [k for k, t in e.items() if brute.base_spans(t)]
    t = tokenizer("word_bpe_49k.json")
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, messy_dir).collect():
        assert r.n_tokens == len(t.encode(e[r.doc_id], add_special_tokens=False).ids)


def test_empty_pipeline(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_specials():
    """The vocabulary's special tokens are those that the operators assume."""
    spec = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    assert {t["content"] for t in spec["added_tokens"]} == {"<|startoftext|>", "<|endoftext|>"}


def test_other_specials(tmp_path):
    """Special tokens of any form are found as the library finds them, one that begins another included."""
    from tokenizers import Tokenizer

    from plumbline.llm import bpe

    spec = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    names = dict(zip(("<|startoftext|>", "<|endoftext|>"), ("[go]", "[go]on")))
    for t in spec["added_tokens"]:
        t["content"] = names[t["content"]]
    spec["model"]["vocab"] = {names.get(k, k): v for k, v in spec["model"]["vocab"].items()}
    path = str(tmp_path / "other.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    library, codec = Tokenizer.from_file(path), bpe.load(path)
    for text in ("say [go]on now", "[go][go]on", "no mark", "x[go]y"):
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids, text


def test_specials_that_begin_others(tmp_path):
    """Counts of a byte-level vocabulary whose one special token begins another."""
    from plumbline.llm import token_counts

    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    spec["added_tokens"] = [{"id": 50300 + k, "content": c, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for k, c in enumerate(("[go]", "[go]on"))]
    path = str(tmp_path / "other.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    library, counts = Tokenizer.from_file(path), token_counts.Counts(path)
    for text in ("say [go]on now", "[go][go]on", "no mark", "x[go]y [go]"):
        parts = counts.pre_tokens(text)
        assert sum(counts.lengths(parts)) == len(library.encode(text, add_special_tokens=False).ids), text
