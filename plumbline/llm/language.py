"""Language identification of spans: script ranges narrow the candidates, then Viterbi over per-word scores with a
penalty for each switch labels mixed text.

Trained on at most MAX_TRAIN labelled documents (chosen by a hash of the id): counts of letter trigrams per language,
hashed to BUCKETS, and the scripts each language writes. A word scores its trigrams' log-probabilities in each
candidate language, relative to the best and not below FLOOR; scores are kept in a bounded worker cache. A text whose
best language's lead never falls by more than the switching penalties allow is one span, and that is decided for whole
batches at once; any other text gets the full Viterbi pass. A text's score is the share of its letters in spans of the
predicted language, times the logistic of that language's lead over the next one within these spans.

keep_identified also rejects texts in no learned language: those with most letters in scripts that no learned language
writes, and those whose mean trigram score, each word under its best language, lies more than DROP nats, and DEVIATIONS
standard errors for short texts, below the mean of that language's training texts. Chunks with digits (tokens, numbers)
are no evidence there.

Cases: null texts and texts without a letter are `und` with score 0 and have no spans; identify labels every text with a
letter, and where no learned language writes a script all of them are candidates; equal totals go to the language first in name order;
without training rows everything is `und`; very long texts are labelled whole; only the id, text and, in training,
lang columns are read, so further columns cannot clash; a word with equally many letters of two scripts belongs to
the one first in SCRIPTS; rows without an id are labelled and never train, repeated rows are labelled alike; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import chunk_lists, groups

#: Bound of the training sample, in documents.
MAX_TRAIN = 20_000
#: Hashed trigrams.
BUCKETS = 1 << 17
#: Price of a change of language, in nats, and the least score of one word.
SWITCH = 10.0
FLOOR = -9.0
#: How far the mean trigram score of a learned language's text may lie below the usual one: nats, and standard errors.
DROP, DEVIATIONS = 3.0, 4.0
#: Words a worker remembers.
CACHE = 250_000
UND = "und"
# Script ranges of the Unicode standard, first and last code point.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F)],
    "armenian": [(0x531, 0x587)],
    "hebrew": [(0x591, 0x5F4)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7A3)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2A6DF)],
}
NAMES = [*SCRIPTS, "other"]
_STARTS, _ENDS, _OF = (np.array(x) for x in zip(*sorted((a, b, NAMES.index(s)) for s, ranges in SCRIPTS.items() for a, b in ranges)))
#: Share of a language's letters that makes a script its own.
SCRIPT_SHARE = 0.001
_LETTERS = re.compile(r"[a-z]+")
_DIGIT = re.compile(r"\d")
_CHUNK = re.compile(r"[^ \t\n\r\v\f]+")


def scripts_of(points: np.ndarray) -> np.ndarray:
    """The script of each code point, as a position in NAMES."""
    at = np.maximum(np.searchsorted(_STARTS, points, "right") - 1, 0)
    return np.where((points >= _STARTS[at]) & (points <= _ENDS[at]), _OF[at], len(SCRIPTS))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each letter of the joined words: hashed trigram around it, the letter, and the number of its word."""
    points = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    code = ((points[:-2] * np.uint64(0x9E3779B1) + points[1:-1]) * np.uint64(0x85EBCA6B) + points[2:]) * np.uint64(0xC2B2AE3D)
    code = (code >> np.uint64(15)) % np.uint64(BUCKETS)
    middle = points[1:-1]
    letter = middle != 0
    return code[letter].astype(np.int64), middle[letter].astype(np.int64), np.cumsum(~letter)[letter]


def letters_of(chunk: str) -> str:
    """The chunk's letters (of str.isalpha) in lower case; breaks between runs of letters are word ends."""
    low = chunk.lower()
    if low.isalpha():
        return low
    if low.isascii():
        return "\0".join(_LETTERS.findall(low))
    return "\0".join("".join(c if c.isalpha() else " " for c in low).split(" ")).strip("\0")


class Model:
    """Languages, their trigram scores, scripts, and the mean and deviation of a trigram's score in training texts."""

    def __init__(self, langs: list[str], scores: np.ndarray, written: np.ndarray, usual: np.ndarray, spread: np.ndarray):
        self.langs, self.scores, self.written, self.usual, self.spread = langs, scores, written, usual, spread
        self.allowed = written | ~written.any(axis=1, keepdims=True)

    def start(self) -> None:
        """The worker's cache: a row of scores for each known chunk."""
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.langs)), dtype=np.float32)
        self.size = np.zeros(1024, dtype=np.int32)
        # letters of chunks without digits, their score above what is usual in the best language, and the letters of
        # scripts that no learned language writes
        self.plain = np.zeros(1024, dtype=np.int32)
        self.above = np.zeros(1024, dtype=np.float32)
        self.alien = np.zeros(1024, dtype=np.int32)

    def learn(self, lists: list[list[str]]) -> None:
        """Score the chunks that the cache lacks."""
        if len(self.known) > CACHE:
            self.start()
        new = list({c for chunks in lists for c in chunks if c not in self.known})
        if not new:
            return
        first = len(self.known)
        while first + len(new) > len(self.size):
            self.rows, self.size, self.plain, self.above, self.alien = (np.concatenate([x, np.zeros_like(x)]) for x in (self.rows, self.size, self.plain, self.above, self.alien))
        for a in range(0, len(new), 50_000):
            part = new[a : a + 50_000]
            words = [letters_of(c) for c in part]
            # the words of one chunk share its row: count separators inside chunks to find it
            own = np.repeat(np.arange(len(words)), [w.count("\0") + 1 for w in words])
            code, letter, word = trigrams(words)
            chunk = own[word]
            total = np.stack([np.bincount(chunk, self.scores[code, k], len(part)) for k in range(len(self.langs))], axis=1)
            script = np.zeros((len(part), len(NAMES)), dtype=np.int32)
            np.add.at(script, (chunk, scripts_of(letter)), 1)
            mask = self.allowed[script.argmax(axis=1)]
            count = script.sum(axis=1)
            above = (total - count[:, None] * self.usual).max(axis=1)
            total = np.where(mask, total, -np.inf)
            total = np.maximum(total - total.max(axis=1, keepdims=True), FLOOR)
            total[count == 0] = 0
            at = slice(first + a, first + a + len(part))
            self.rows[at], self.size[at] = total, count
            plain = np.array([not _DIGIT.search(c) for c in part])
            self.plain[at], self.above[at], self.alien[at] = count * plain, above * plain, script[:, ~self.written.any(axis=1)].sum(axis=1)
        self.known.update(zip(new, range(first, first + len(new))))

    def path(self, scores: np.ndarray) -> list[int]:
        """Viterbi: the best language of each word under the switching penalty; ties stay, then go to the first."""
        back, best = [], [0.0] * scores.shape[1]
        for row in scores.tolist():
            top = max(range(len(best)), key=best.__getitem__)
            change = best[top] - SWITCH
            came, now = [], []
            for k, s in enumerate(row):
                stay = best[k] >= change
                came.append(k if stay else top)
                now.append(s + (best[k] if stay else change))
            back.append(came)
            best = now
        k = max(range(len(best)), key=best.__getitem__)
        out = []
        for came in reversed(back):
            out.append(k)
            k = came[k]
        return out[::-1]

    def label(self, texts: list[str], learned_only: bool = False) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans) of each text; with learned_only, texts in no learned language are `und`."""
        if not self.langs:
            return [(UND, 0.0, [])] * len(texts)
        lists = chunk_lists(texts)
        self.learn(lists)
        sizes = np.array([len(c) for c in lists])
        out: list[tuple[str, float, list]] = [(UND, 0.0, [])] * len(texts)
        some = np.nonzero(sizes)[0]
        if not some.size:
            return [(self.langs[0], 0.0, [(0, len(t), self.langs[0])]) if has_letter(t) else out[i] for i, t in enumerate(texts)]
        get = self.known.__getitem__
        at = np.array([get(c) for chunks in lists for c in chunks], dtype=np.int64)
        ends = np.cumsum(sizes)[some]
        starts = ends - sizes[some]
        scores, letters = self.rows[at].astype(np.float64), self.size[at]
        totals = np.add.reduceat(scores, starts, axis=0)
        best = totals.argmax(axis=1)
        of = np.repeat(np.arange(some.size), sizes[some])
        own = scores[np.arange(len(at)), best[of]]
        scores_rest = scores.copy()
        scores_rest[np.arange(len(at)), best[of]] = -np.inf
        rest = scores_rest.max(axis=1) if len(self.langs) > 1 else own - 1
        run = np.cumsum(own - rest)
        run -= np.concatenate([[0.0], run[ends[:-1] - 1]])[of]
        last = run[ends - 1]
        big = 2 * np.abs(run).max() + 1
        peak = np.maximum.accumulate(np.maximum(run, 0) + of * big) - of * big
        dip = np.maximum.reduceat(peak - run, starts)
        whole = (dip <= 2 * SWITCH) & (np.minimum.reduceat(run, starts) >= -SWITCH) & (peak[ends - 1] - last <= SWITCH)
        n_letters = np.add.reduceat(letters, starts)
        judged = np.maximum(np.add.reduceat(self.plain[at], starts), 1)
        drop = -np.add.reduceat(self.above[at].astype(np.float64), starts) / judged
        foreign = drop > DROP + DEVIATIONS * self.spread[best] / np.sqrt(judged)
        foreign |= 2 * np.add.reduceat(self.alien[at], starts) > n_letters
        ordered = np.sort(totals, axis=1)
        lead = ordered[:, -1] - ordered[:, -2] if len(self.langs) > 1 else np.full(some.size, np.inf)
        for k, i in enumerate(some):
            if learned_only and foreign[k]:
                continue
            if not n_letters[k]:
                if has_letter(texts[i]):
                    out[i] = (self.langs[0], 0.0, [(0, len(texts[i]), self.langs[0])])
                continue
            if whole[k]:
                lang, share, ahead, spans = int(best[k]), 1.0, lead[k], [(0, len(texts[i]), self.langs[best[k]])]
            else:
                a, b = starts[k], ends[k]
                path = np.array(self.path(scores[a:b]))
                weight = np.bincount(path, letters[a:b], len(self.langs))
                lang = int(weight.argmax())
                share = weight[lang] / weight.sum()
                own_sum = scores[a:b][path == lang].sum(axis=0)
                ahead = own_sum[lang] - np.delete(own_sum, lang).max()
                edges = [0, *(np.nonzero(np.diff(path))[0] + 1).tolist(), len(path)]
                places = [m.span() for m in _CHUNK.finditer(texts[i])]
                spans = [(places[s][0], places[e - 1][1], self.langs[path[s]]) for s, e in zip(edges, edges[1:])]
            sure = 1 / (1 + np.exp(-np.clip(ahead, -50.0, 50.0)))
            out[i] = (self.langs[lang], float(share * sure), spans)
        return out


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows at most, chosen by a hash of the key; all rows where there are no more."""
    n = rows.count()
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < F.lit(int((1 << 30) * most / n)))


def train(rows: DataFrame, key: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MAX_TRAIN) -> Model:
    """Fit on labelled rows; counts are summed by Spark and at most BUCKETS entries a language come to the driver."""

    def run(batches):
        grams: dict[str, np.ndarray] = {}
        script: dict[str, Counter] = {}
        for batch in batches:
            text, langs = common.texts(batch, text_col), batch.column(lang_col).to_pylist()
            for a, b in groups(text, 1 << 18):
                by_lang: dict[str, list[str]] = {}
                for t, lang in zip(text[a:b], langs[a:b]):
                    by_lang.setdefault(lang, []).extend(letters_of(c) for c in chunk_lists([t])[0])
                for lang, words in by_lang.items():
                    code, letter, _ = trigrams(words)
                    grams[lang] = grams.get(lang, 0) + np.bincount(code, minlength=BUCKETS)
                    script.setdefault(lang, Counter()).update(dict(enumerate(np.bincount(scripts_of(letter), minlength=len(NAMES)).tolist())))
        for lang, counts in grams.items():
            some = np.nonzero(counts)[0]
            places = np.concatenate([some, -1 - np.arange(len(NAMES))])
            values = np.concatenate([counts[some], [script[lang][k] for k in range(len(NAMES))]])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(values, pa.int64())], ["lang", "place", "n"])

    chosen = bounded_sample(rows.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(key, text_col, lang_col), key, most)
    counted = chosen.select(text_col, lang_col).mapInArrow(run, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique())
    counts, script = np.zeros((BUCKETS, len(langs))), np.zeros((len(NAMES), len(langs)))
    for k, lang in enumerate(langs):
        own = counted[counted["lang"] == lang]
        place, n = own["place"].to_numpy(), own["n"].to_numpy()
        counts[place[place >= 0], k] = n[place >= 0]
        script[-1 - place[place < 0], k] = n[place < 0]
    used = max(1, int((counts.sum(axis=1) > 0).sum())) if langs else 1
    scores = np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * used)).astype(np.float32)
    written = script >= SCRIPT_SHARE * np.maximum(script.sum(axis=0), 1)
    share = counts / np.maximum(counts.sum(axis=0), 1)
    usual = (share * scores).sum(axis=0)
    spread = np.sqrt(np.maximum((share * scores.astype(np.float64) ** 2).sum(axis=0) - usual**2, 0))
    return Model(langs, scores, written, usual, spread)


def _model(shared) -> Model:
    """The broadcast model with this worker's cache."""

    def make() -> Model:
        model = Model(*shared.value)
        model.start()
        return model

    return common.worker_state(shared.id, make)


class _Shared:
    """A broadcast and a name for it within the worker."""

    def __init__(self, spark: SparkSession, model: Model):
        self.broadcast = spark.sparkContext.broadcast((model.langs, model.scores, model.written, model.usual, model.spread))
        self.id = uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: id, lang_pred, score, spans (start and end in code points, lang)."""
    common.small_batches(docs.sparkSession)
    shared = _Shared(docs.sparkSession, model)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        own = _model(shared)
        for batch in batches:
            text = common.texts(batch, text_col)
            found = [x for a, b in groups(text, 1 << 20) for x in own.label(text[a:b])]
            spans = pa.array([[{"start": s, "end": e, "lang": n} for s, e, n in f[2]] for f in found], spans_type)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), spans], [id_col, "lang_pred", "score", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double, spans array<struct<start int, end int, lang string>>")


def keep_identified(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The documents, all columns, whose text is in a learned language with at least this score."""
    common.small_batches(docs.sparkSession)
    shared = _Shared(docs.sparkSession, model)

    def run(batches):
        own = _model(shared)
        for batch in batches:
            text = common.texts(batch, text_col)
            found = [x for a, b in groups(text, 1 << 20) for x in own.label(text[a:b], learned_only=True)]
            yield batch.filter(pa.array([f[0] != UND and f[1] >= least for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame) -> Column:
    return common.remainder("doc_id", 4) != 2


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = train(docs.filter(training_rows(docs)))
    found = identify(docs, model)
    return found.select("doc_id", (common.remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
