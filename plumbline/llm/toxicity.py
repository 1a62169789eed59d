"""Toxicity by a subsequence string kernel SVM with Nyström landmarks.

The kernel of two words sums, over all subsequences of ORDER letters that both contain, DECAY to the power of the
letters they span in each, so that gaps and inserted characters lower a match without breaking it; it is normalised to
1 for equal words. A word is what stands between white space, in lower case, letters only and without accents ("s.t.u.p.i.d"
is "stupid"); digits between letters read as the letters they resemble; runs of single letters are joined ("i d i o t");
words of more than WINDOW letters are scored in overlapping windows, so that a subsequence must lie in one of them. Letters
that are not a to z after that fold to OTHERS symbols by a hash.

Training is a fit on a bounded sample of labelled rows: at most MAX_TOXIC and MAX_CLEAN documents, chosen by a hash of the
id. The machine is trained on labelled texts, each of which is as toxic as its worst word: of every training text the word of
highest value stands for it, with the text's label, in ROUNDS of choosing these words and training anew (a multiple-instance
machine). It starts from words: a word's evidence is the number of distinct words before it in toxic and in clean documents
(copies of a document add nothing); the CARRIERS with most evidence and EXAMPLES clean words, the commonest and others by
hash, then with the clean words that scored highest, train the first machine, and they keep the rest of the weight beside the texts. The
machine is a linear SVM on the Nyström map K_mm^(-1/2) k(x) of LANDMARKS landmark words, each as unlike the others as can be found
among the carriers and the first POOL clean words; words of fewer than ORDER or more than WINDOW letters do not train. A
logistic curve is fitted to the TOP highest decision values of each training document. As the decision is linear in the
kernel values, it folds into one weight per subsequence, and a word is scored by its own subsequences and self-kernel;
values are kept in a bounded worker cache.

Cases: null and empty texts and texts without letters (of str.isalpha) score 0; very long texts are scored whole; equal
words have equal values, and each occurrence counts; words of equal evidence are ordered by name; repeated rows score
alike; rows without an id are scored and never train; without labels of both classes every score is 0; only the id and
text columns (and toxic of the labels) are read, so further columns cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from heapq import nlargest
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import chunk_lists, groups

#: Bounds of the training sample, in documents.
MAX_TOXIC, MAX_CLEAN = 3000, 8000
#: Kernel parameters.
ORDER, DECAY = 3, 0.6
WINDOW = 20
LANDMARKS = 160
#: Highest values of a text that its score follows, and what stands for missing ones.
TOP, LOW = 3, -1.5
#: Words kept as carriers and as clean examples.
CARRIERS, EXAMPLES = 600, 6000
#: Clean words among which landmarks are chosen.
POOL = 1500
#: Log-likelihood ratio that makes a word a carrier.
EVIDENCE = 8.0
#: Rounds over the labelled texts, and their share of either side's weight beside carriers and clean examples.
ROUNDS, SENTENCES = 1, 0.5
#: Words a worker remembers.
CACHE = 400_000
#: Symbols for letters outside a to z, and all symbols: these, the alphabet and both ends of a word.
OTHERS = 20
SYMBOLS = 26 + OTHERS + 2
# Digits and the letters they resemble.
RESEMBLE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
_FOLD = str.maketrans(RESEMBLE)
_NO_LETTER = re.compile(r"[^a-z]+")
_INNER_DIGIT = re.compile(r"(?<=[^\W\d_])[013457](?=[^\W\d_])")


def letters_of(chunk: str) -> str:
    """The word of a chunk: its letters, in lower case and without accents."""
    low = chunk.lower()
    if low.isascii():
        return low if low.isalpha() else _NO_LETTER.sub("", _INNER_DIGIT.sub(lambda m: m[0].translate(_FOLD), low))
    plain = unicodedata.normalize("NFKD", "".join(c for c in low if c.isalpha() or c in RESEMBLE))
    kept = "".join(c for c in plain if c.isalpha() or c in RESEMBLE)
    return "".join(c for c in _INNER_DIGIT.sub(lambda m: m[0].translate(_FOLD), kept) if c.isalpha())


def windows(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def symbols(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of symbols: start, a to z or one of OTHERS for other letters, end."""
    x = np.frombuffer("".join(words).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64).reshape(len(words), -1)
    x = np.where((x >= 97) & (x < 123), x - 97, 26 + (x * 0x9E3779B1 >> 16) % OTHERS)
    edge = np.full((len(words), 1), SYMBOLS - 2)
    return np.hstack([edge, x, edge + 1])


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The unnormalised kernel of s[i] and t[i] for all i, by dynamic programming over both words' positions."""
    rows, n, m = s.shape[0], s.shape[1], t.shape[1]
    total = np.zeros(rows)
    before = [[np.ones(rows) for _ in range(m + 1)]] + [[np.zeros(rows) for _ in range(m + 1)] for _ in range(ORDER - 1)]
    for j in range(n):
        same = [s[:, j] == t[:, k] for k in range(m)]
        after = [before[0]]
        for level in range(1, ORDER):
            open_, line = np.zeros(rows), [np.zeros(rows)]
            for k in range(m):
                open_ = DECAY * open_ + DECAY**2 * same[k] * before[level - 1][k]
                line.append(DECAY * before[level][k + 1] + open_)
            after.append(line)
        for k in range(m):
            total += DECAY**2 * same[k] * before[ORDER - 1][k]
        before = after
    return total


def _spans(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All position tuples of ORDER letters in n, and their weights."""
    at = np.array(list(combinations(range(n), ORDER)), dtype=np.int64).reshape(-1, ORDER)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1.0) if len(at) else np.zeros(0)


_SPANS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The subsequences of each row as numbers, and their weights."""
    n = x.shape[1]
    if n not in _SPANS:
        _SPANS[n] = _spans(n)
    at, weight = _SPANS[n]
    code = np.zeros((len(x), len(at)), dtype=np.int64)
    for k in range(ORDER):
        code = code * SYMBOLS + x[:, at[:, k]]
    return code, weight


def by_length(words: list[str]):
    """(positions, symbol matrix) of the words of each length that has subsequences, in bounded pieces."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    for n in np.unique(lengths):
        if n:
            at = np.nonzero(lengths == n)[0]
            step = max(1, 4_000_000 // comb(int(n) + 2, ORDER))
            for a in range(0, len(at), step):
                own = at[a : a + step]
                yield own, symbols([words[i] for i in own])


def features(words: list[str], table: np.ndarray) -> np.ndarray:
    """Normalised kernel sums of words against a table (subsequences x columns); 0 for words without subsequences."""
    out = np.zeros((len(words), table.shape[1]))
    for at, x in by_length(words):
        code, weight = codes(x)
        norm = np.sqrt(kernel(x, x))
        for c in range(table.shape[1]):
            out[at, c] = table[:, c][code] @ weight / norm
    return out


def landmark_table(words: list[str]) -> np.ndarray:
    """Each landmark's normalised weight of each subsequence."""
    table = np.zeros((SYMBOLS**ORDER, len(words)))
    for at, x in by_length(words):
        code, weight = codes(x)
        norm = np.sqrt(kernel(x, x))
        for row, k in enumerate(at):
            np.add.at(table[:, k], code[row], weight / norm[row])
    return table


class Model:
    """One weight per subsequence, and the curve from the highest value of a text to its score."""

    def __init__(self, weights: np.ndarray, shift: float, curve: np.ndarray | None = None):
        self.weights, self.shift, self.curve = weights, shift, curve

    def start(self) -> None:
        self.known: dict[str, tuple[float, str]] = {}

    def values(self, words: list[str]) -> np.ndarray:
        """Decision values of words: of windows, the highest."""
        parts = [windows(w) for w in words]
        flat = [p for ps in parts for p in ps]
        found = features(flat, self.weights[:, None])[:, 0] + self.shift if flat else np.zeros(0)
        starts = np.cumsum([0] + [len(p) for p in parts])[:-1]
        return np.maximum.reduceat(found, starts) if len(words) else found

    def highest(self, texts: list[str]) -> np.ndarray:
        """The TOP highest decision values in each text, highest first; a row of nan where there is no word."""
        lists = chunk_lists(texts)
        if len(self.known) > CACHE:
            self.known.clear()
        new = list({c for chunks in lists for c in chunks if c not in self.known})
        for a in range(0, len(new), 50_000):
            part = new[a : a + 50_000]
            words = [letters_of(c) for c in part]
            some = [w for w in words if w]
            value = dict(zip(some, self.values(some).tolist()))
            self.known.update((c, (value[w], w if len(w) == 1 else "") if w else (-np.inf, "")) for c, w in zip(part, words))
        out = np.full((len(texts), TOP), np.nan)
        for i, chunks in enumerate(lists):
            found = [self.known[c] for c in chunks]
            values = [f[0] for f in found]
            singles = "".join([f[1] or " " for f in found])
            if len(singles) - singles.count(" ") >= ORDER and (runs := [r for r in singles.split() if len(r) >= ORDER]):
                values += self.values(runs).tolist()
            if values and (best := max(values)) > -np.inf:
                top = nlargest(TOP, values) if len(values) < 64 else np.sort(np.partition(values, -TOP)[-TOP:])[::-1]
                out[i] = LOW
                out[i, : len(top)] = np.maximum(top, LOW)
        return out

    def witness(self, texts: list[str]) -> list[str | None]:
        """The word of ORDER to WINDOW letters of highest value in each text, of equal ones the first by name."""
        lists = [sorted({w for c in chunks if ORDER <= len(w := letters_of(c)) <= WINDOW}) for chunks in chunk_lists(texts)]
        new = sorted({w for words in lists for w in words})
        value = {w: v for a in range(0, len(new), 50_000) for w, v in zip(new[a : a + 50_000], self.values(new[a : a + 50_000]).tolist())}
        return [max(words, key=value.__getitem__) if words else None for words in lists]

    def scores(self, texts: list[str]) -> np.ndarray:
        top = self.highest(texts)
        return np.where(np.isnan(top[:, 0]), 0.0, 1 / (1 + np.exp(-np.clip(bent(top) @ self.curve[:-1] + self.curve[-1], -60, 60))))


def bent(top: np.ndarray) -> np.ndarray:
    """The values, and how far each lies beyond the middle and the edge of the SVM's margin."""
    return np.hstack([top, np.maximum(top - 0.5, 0), np.maximum(top - 0.9, 0)])


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """A linear SVM with squared hinge loss, by Newton steps on the active rows. The last feature is the shift."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa, ya, ca = x[active], y[active], weight[active]
        new = np.linalg.solve((xa * ca[:, None]).T @ xa + penalty * np.eye(x.shape[1]), xa.T @ (ca * ya))
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """A logistic curve over the columns, the offset last, by damped Newton steps; smoothed targets keep it finite."""
    good, bad = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - t) + ridge * w)
        w = w - step * min(1.0, 5.0 / (1e-12 + np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w


def spread(words: list[str], n: int) -> list[str]:
    """n landmarks: the first word, then always the word least like those chosen."""
    if len(words) <= n:
        return words
    chosen = [0]
    like = np.full(len(words), -1.0)
    for _ in range(n - 1):
        like = np.maximum(like, features(words, landmark_table([words[chosen[-1]]]))[:, 0])
        like[chosen[-1]] = 2
        chosen.append(int(like.argmin()))
    return [words[i] for i in chosen]


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The training documents with their label: bounded by MAX_TOXIC and MAX_CLEAN, written once."""
    known = labels.filter(F.col("toxic").isin(0, 1)).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit("train"), F.col(id_col)), F.lit(1 << 30))
    share = {y: int((1 << 30) * min(1, most / max(1, counts.get(y, 0)))) for y, most in ((1, MAX_TOXIC), (0, MAX_CLEAN))}
    chosen = known.filter(draw < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    return common.materialize(docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(text_col, "toxic"), "toxicity-sample")


def evidence(train: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, toxic, clean): distinct words before it in documents of either label."""

    def run(batches):
        for batch in batches:
            word, before, label = [], [], []
            for t, y in zip(common.texts(batch, text_col), batch.column("toxic").to_pylist()):
                last, pairs = "", set()
                for c in chunk_lists([t])[0]:
                    w = letters_of(c)
                    if ORDER <= len(w) <= WINDOW:
                        pairs.add((w, last))
                    last = w
                word += [p[0] for p in pairs]
                before += [p[1] for p in pairs]
                label += [y] * len(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(before, pa.string()), pa.array(label, pa.int32())], ["word", "before", "toxic"])

    pairs = train.mapInArrow(run, "word string, before string, toxic int").distinct()
    return pairs.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))


def witnesses(train: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(word, toxic, n): the word of highest value of each training text, and of how many texts it is that."""

    def run(batches):
        own = Model(model.weights, model.shift)
        own.start()
        for batch in batches:
            word = own.witness(common.texts(batch, text_col))
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), batch.column("toxic").cast(pa.int32())], ["word", "toxic"])

    return train.mapInArrow(run, "word string, toxic int").filter("word is not null").groupBy("word", "toxic").agg(F.count("*").alias("n")).orderBy("word", "toxic")


def fit(train: DataFrame, text_col: str = "text") -> Model | None:
    """Carriers, landmarks, SVM and curve; None without documents of both labels."""
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    found = common.materialize(evidence(train, text_col), "toxicity-words")
    both = found.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    if not both["toxic"] or not both["clean"]:
        return None
    rate = both["toxic"] / (both["toxic"] + both["clean"])
    of, term = F.col("toxic") + F.col("clean"), lambda n, e: F.when(n > 0, n * F.log(n / e)).otherwise(0.0)
    likely = term(F.col("toxic"), of * rate) + term(F.col("clean"), of * (1 - rate))
    more = F.col("toxic") > of * rate
    ratio = F.log((F.col("toxic") + 0.2) / sizes[1]) - F.log((F.col("clean") + 0.2) / sizes[0])
    carriers = [r["word"] for r in found.filter(more & (likely > EVIDENCE) & (ratio > 2.5)).orderBy(F.desc(likely), "word").limit(CARRIERS).collect()]
    clean = found.filter((F.col("clean") >= 1) & ~(more & (likely >= 1)))
    examples = [r["word"] for r in clean.orderBy(F.desc("clean"), "word").limit(EXAMPLES // 3).collect()]
    examples += [r["word"] for r in clean.orderBy(F.xxhash64("word")).limit(EXAMPLES * 2 // 3).collect()]
    examples = list(dict.fromkeys(examples))
    if not carriers or not examples:
        return None
    marks = list(dict.fromkeys(spread(carriers, LANDMARKS * 3 // 5) + spread(examples[:POOL], LANDMARKS * 2 // 5)))
    table = landmark_table(marks)
    value, vector = np.linalg.eigh(features(marks, table))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good]) @ vector[:, good].T

    def machine(words: list[str], y: np.ndarray, weight: np.ndarray) -> Model:
        x = features(words, table) @ root
        w = svm(np.hstack([x, np.ones((len(x), 1))]), y, weight)
        return Model((table @ (root @ w[:-1])).astype(np.float32), float(w[-1]))

    def against(clean_words: list[str]) -> Model:
        y = np.array([1.0] * len(carriers) + [-1.0] * len(clean_words))
        return machine(carriers + clean_words, y, np.where(y > 0, 0.5 / len(carriers), 0.5 / len(clean_words)))

    first = against(examples)

    def rate_words(batches):
        for batch in batches:
            words = batch.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(first.values(words))], ["word", "value"])

    hard = clean.select("word").mapInArrow(rate_words, "word string, value double").orderBy(F.desc("value"), "word").limit(EXAMPLES // 4)
    model = against(list(dict.fromkeys(examples + [r["word"] for r in hard.collect()])))
    for _ in range(ROUNDS):
        found = witnesses(train, model, text_col).toPandas()
        y, n = np.where(found["toxic"] == 1, 1.0, -1.0), found["n"].to_numpy(float)
        if not (y > 0).any() or not (y < 0).any():
            break
        share = SENTENCES / 2 * n / np.where(y > 0, n[y > 0].sum(), n[y < 0].sum())
        beside = [np.full(len(words), (1 - SENTENCES) / 2 / len(words)) for words in (carriers, examples)]
        sides = [np.full(len(carriers), 1.0), np.full(len(examples), -1.0)]
        model = machine(found["word"].tolist() + carriers + examples, np.concatenate([y, *sides]), np.concatenate([share, *beside]))

    def run(batches):
        own = Model(model.weights, model.shift)
        own.start()
        for batch in batches:
            top = own.highest(common.texts(batch, text_col))
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), *(pa.array(top[:, k]) for k in range(TOP))], ["toxic", *(f"t{k}" for k in range(TOP))])

    tops = train.mapInArrow(run, "toxic int, " + ", ".join(f"t{k} double" for k in range(TOP))).toPandas().dropna()
    model.curve = logistic(bent(tops[[f"t{k}" for k in range(TOP)]].to_numpy()), tops["toxic"].to_numpy())
    return model


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: id, score, predicted."""
    spark, name = docs.sparkSession, uuid.uuid4().hex
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model and (model.weights, model.shift, model.curve))

    def run(batches):
        def make() -> Model | None:
            own = Model(*shared.value) if shared.value else None
            if own:
                own.start()
            return own

        own = common.worker_state(name, make)
        for batch in batches:
            text = common.texts(batch, text_col)
            found = np.concatenate([own.scores(text[a:b]) if own else np.zeros(b - a) for a, b in groups(text)]) if text else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    learns = common.remainder("doc_id", 5) != 0
    train = sample(docs.filter(learns), common.table(spark, sf_dir, "labels").filter(learns))
    found = score(docs, fit(train))
    return found.select("doc_id", (common.remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
