"""The methods of the text operators against plain versions of themselves: kernel, Viterbi path, belief propagation."""

import random
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language, pii, toxicity

from . import brute

# ------------------------------------------------------------------------------------------------- toxicity


def plain_kernel(s, t):
    s, t = f"<{s}>", f"<{t}>"
    total = 0.0
    for a in combinations(range(len(s)), toxicity.ORDER):
        for b in combinations(range(len(t)), toxicity.ORDER):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel():
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abc") for _ in range(n)) for n in (1, 2, 3, 5, 7)]
    for s, t in product(words, words):
        got = toxicity.kernel(toxicity.symbols([s]), toxicity.symbols([t]))[0]
        assert got == pytest.approx(plain_kernel(s, t))
        norm = np.sqrt(plain_kernel(s, s) * plain_kernel(t, t))
        assert toxicity.features([s], toxicity.landmark_table([t]))[0, 0] == pytest.approx(plain_kernel(s, t) / norm)


def test_words():
    got = {t: toxicity.letters_of(t) for t in ("s.t.u.p.i.d", "m0r0n", "Stüpid", "²", "½①", "Ⅷ", "привет", "a1", "")}
    assert got == {"s.t.u.p.i.d": "stupid", "m0r0n": "moron", "Stüpid": "stupid", "²": "", "½①": "", "Ⅷ": "", "привет": "привет", "a1": "a", "": ""}


@pytest.fixture(scope="module")
def insults(spark):
    rnd = random.Random(2)
    plain = "the river runs north past old mills and a stone bridge near quiet fields where people gather each summer for music".split()
    docs, labels = [], []
    for k in range(300):
        words = [rnd.choice(plain) for _ in range(15)]
        if k % 3 == 0:
            words[rnd.randrange(15)] = rnd.choice(["stupid", "moron", "idiot"])
        docs.append((k, " ".join(words)))
        labels.append((k, int(k % 3 == 0)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_obfuscated_insults(spark, insults):
    model = toxicity.fit(toxicity.sample(*insults))
    base = "the people near the bridge gather {} for music each summer"
    texts = {k: base.format(w) for k, w in enumerate(["stupid", "s.t.u.p.i.d", "stxupid", "stuupiid", "i d i o t", "m0r0n", "river", "quiet", "music"])}
    texts[9] = "² ½ ①"
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([*texts.items()], "doc_id long, text string"), model).collect()}
    assert min(got[k] for k in range(6)) > 0.5 > max(got[k] for k in (6, 7, 8)) and got[9] == 0


def test_witnesses(spark, insults):
    """The word that stands for a training text is the one of highest value, counted over texts of either label."""
    docs, labels = insults
    model = toxicity.fit(toxicity.sample(docs, labels))
    odd = [(None, 1), ("", 0), ("\u00b2 a b", 0), ("x" * 30, 1), ("s.t.u.p.i.d stupid", 1), ("s.t.u.p.i.d stupid", 1)]
    train = docs.join(labels, "doc_id").select("text", "toxic").union(spark.createDataFrame(odd, "text string, toxic int"))
    want = {}
    for r in train.collect():
        words = sorted({toxicity.letters_of(c) for c in (r.text or "").split()})
        words = [w for w in words if toxicity.ORDER <= len(w) <= toxicity.WINDOW]
        if words:
            key = max(zip(model.values(words), [-k for k in range(len(words))], words))[2], r.toxic
            want[key] = want.get(key, 0) + 1
    got = {(r.word, r.toxic): r.n for r in toxicity.witnesses(train, model).collect()}
    assert got == want and {w for w, y in got if y == 1} == {"stupid", "moron", "idiot"} and len({w for w, y in got if y == 0}) > 1


def test_machine_is_the_least():
    """No step away from the machine's weights lowers its weighted squared hinge loss."""
    rng = np.random.default_rng(5)
    x, y, weight = np.hstack([rng.normal(size=(80, 4)), np.ones((80, 1))]), rng.choice([-1.0, 1.0], 80), rng.random(80)
    loss = lambda w: (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum() + 1e-3 * (w**2).sum()
    best = toxicity.svm(x, y, weight)
    assert all(loss(best) <= loss(best + step) for step in rng.normal(0, 1, (200, 5)) * rng.choice([1e-3, 1e-2, 0.3], (200, 1)))


def test_held_out_labels_do_not_count(spark, messy_dir, tmp_path, monkeypatch):
    """Other labels of held-out rows leave every score alone, with sample bounds that bite."""
    monkeypatch.setattr(toxicity, "MAX_TOXIC", 5)
    monkeypatch.setattr(toxicity, "MAX_CLEAN", 20)
    before = {r.doc_id: r.score for r in toxicity.op1_toxicity(spark, messy_dir).collect()}
    labels = spark.read.parquet(f"{messy_dir}/labels.parquet")
    more = spark.read.parquet(f"{messy_dir}/documents.parquet").select("doc_id").filter("doc_id is not null").distinct().withColumn("toxic", F.lit(1))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels.filter(~held).select("doc_id", "toxic").union(more.filter(held).select("doc_id", F.col("toxic").cast(labels.schema["toxic"].dataType))).write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{messy_dir}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.score for r in toxicity.op1_toxicity(spark, str(tmp_path)).collect()} == before


def test_held_out_quality(spark):
    """Toxic documents that did not train rank above clean ones."""
    at = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{at}/labels.parquet").filter("toxic is not null").select("doc_id", "toxic")
    rows = toxicity.op1_toxicity(spark, at).filter("held_out").join(labels, "doc_id").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert bad and good and np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > 0.9


# ------------------------------------------------------------------------------------------------- language


def model_of(langs, scores=None):
    usual = np.zeros(len(langs))
    return language.Model(langs, scores if scores is not None else np.zeros((language.BUCKETS, len(langs))), np.ones((len(language.NAMES), len(langs)), dtype=bool), usual, usual)


def test_viterbi_by_enumeration():
    rnd = np.random.default_rng(3)
    model = model_of(["a", "b", "c"])
    worth = lambda rows, p: sum(rows[i, k] for i, k in enumerate(p)) - language.SWITCH * sum(x != y for x, y in zip(p, p[1:]))
    for _ in range(60):
        rows = rnd.normal(0, 8, (rnd.integers(1, 7), 3))
        best = max(worth(rows, p) for p in product(range(3), repeat=len(rows)))
        assert worth(rows, model.path(rows)) == pytest.approx(best)


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return language.train(docs.filter(language.training_rows(docs))), {r.lang: r.text for r in docs.filter("n_chars > 500").orderBy("doc_id").collect()}


def test_spans_of_mixed_texts(trained):
    model, by_lang = trained
    model.start()
    a, b = sorted(by_lang)[:2]
    one, two = (" ".join(by_lang[k][:400].split()[:-1]) for k in (a, b))
    text = f"{one} {two} {one}"
    (lang, score, spans), (_, sure, whole) = model.label([text, one])
    assert [s[2] for s in spans] == [a, b, a] and lang == a and 0.5 < score < 0.8
    assert abs(spans[0][1] - len(one)) < 25 and abs(spans[1][1] - len(one) - len(two) - 1) < 25
    assert whole == [(0, len(one), a)] and sure > 0.99


def test_one_span_texts_are_what_viterbi_says(trained):
    model, by_lang = trained
    model.start()
    rnd = random.Random(4)
    words = [w for t in by_lang.values() for w in t.split()[:60]]
    texts = [" ".join(rnd.sample(words, rnd.randrange(1, 12))) for _ in range(200)] + [t[:200] for t in by_lang.values()]
    for text, (lang, _, spans) in zip(texts, model.label(texts)):
        path = model.path(model.rows[[model.known[c] for c in language.chunk_lists([text])[0]]].astype(float))
        assert len(spans) == 1 + sum(x != y for x, y in zip(path, path[1:]))
        if len(spans) == 1:
            assert lang == model.langs[path[0]]


def test_texts_without_letters(trained):
    model, _ = trained
    model.start()
    for text in ("² ½ ①", "12 345", "Ⅷ", "", "?!"):
        assert model.label([text, "the house"])[0] == (language.UND, 0.0, [])


# ------------------------------------------------------------------------------------------------- personal data


def marginals(own, pairs, edge):
    n, k = own.shape
    p = np.zeros((n, k))
    for labels in product(range(k), repeat=n):
        weight = np.exp(sum(own[i, y] for i, y in enumerate(labels)) + sum(e[labels[i], labels[j]] for (i, j), e in zip(pairs, edge)))
        for i, y in enumerate(labels):
            p[i, y] += weight
    return p / p.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("pairs", [[(0, 1), (1, 2), (2, 3)], [(0, 3), (3, 1), (3, 2)], [(0, 1)], []])
def test_beliefs_are_exact_on_trees(pairs):
    rnd = np.random.default_rng(len(pairs))
    own, edge = rnd.normal(0, 1, (4, 3)), rnd.normal(0, 1, (len(pairs), 3, 3))
    pairs = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    assert pii.propagate(own, pairs, edge, 40) == pytest.approx(marginals(own, pairs, edge), abs=1e-6)


def test_beliefs_on_a_loop():
    """A skip edge that closes a loop: near the exact marginals, with the same best labels."""
    rnd = np.random.default_rng(9)
    own, pairs, edge = rnd.normal(0, 1, (4, 3)), np.array([(0, 1), (1, 2), (2, 3), (0, 3)]), rnd.normal(0, 0.5, (4, 3, 3))
    got, exact = pii.propagate(own, pairs, edge, 40), marginals(own, pairs, edge)
    assert got == pytest.approx(exact, abs=0.05) and (got.argmax(axis=1) == exact.argmax(axis=1)).all()


def test_links_carry_labels():
    """A token that the field is unsure of follows its distant repeat, or a token like it, only through their link."""
    text = "call 16095557932 now. " + "nothing here " * 50 + "16-0955-57932 and again, 16095550000 too"
    tokens = pii.Tokens([text])
    assert [len(tokens.links[w]) for w in pii.LINKS] == [0, 1, 1]
    phone = 1 + pii.KINDS.index("phone")
    sure, unsure = [0.0] * len(pii.LABELS), [0.0] * len(pii.LABELS)
    sure[phone], unsure[0], unsure[phone] = 6.0, 4.0, 3.5
    classes = tokens.classes()
    unary = {c: unsure for c in classes} | {classes[0]: sure}
    together = np.full((len(pii.LABELS),) * 2, -1.0) + 4 * np.eye(len(pii.LABELS))
    apart = np.zeros_like(together)
    if len(set(classes)) == 3:
        with_links = pii.Crf(unary, {}, {"chain": apart, "skip": together, "alike": together})
        without = pii.Crf(unary, {}, {"chain": apart, "skip": apart, "alike": apart})
        assert [s[2] for s in with_links.added([text], [[]])[0]] == [phone - 1] * 3
        assert len(without.added([text], [[]])[0]) == 1


def test_labels_by_scan():
    rnd = random.Random(5)
    text = " ".join(rnd.choice(["a@b.co", "1.2.3.4", "x1", "+1 609 555 7932", "4111 1111 1111 1111", "9@"]) for _ in range(200))
    spans, tokens = pii.base_spans(text), pii.Tokens([text])
    assert tokens.labels([spans]) == [1 + min((k for s, e, k in spans if s < b and a < e), default=-1) for a, b in tokens.span]


def test_field_adds_spans(spark):
    """The trained field adds a span whose class is that of an entity, where no base pattern holds, and nothing else."""
    rnd = random.Random(6)
    part = lambda: rnd.randrange(100, 255)
    docs = [(k, f"host {part()}.{part()}.{part()}.{part()} answers, see page {rnd.randrange(100)} of 2024") for k in range(200)]
    model = pii.train(spark.createDataFrame(docs, "doc_id long, text string"))
    texts = {1: "host 130.140.150.160 answers, host 130.140.150.360 does not", 2: "chapter 12 of 300 pages"}
    got = {r.doc_id: (r.base, r.spans) for r in pii.find(spark.createDataFrame([*texts.items()], "doc_id long, text string"), model).collect()}
    written = lambda spans: [(s.start, s.end, s.kind) for s in spans]
    assert written(got[1][0]) == [(a, e, brute.KINDS[k]) for a, k, e in brute.base_spans(texts[1])] == [(5, 20, "ip")]
    assert written(got[1][1]) == [(5, 20, "ip"), (35, 50, "ip")] and got[2] == ([], [])
