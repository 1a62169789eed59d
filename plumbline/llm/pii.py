"""Personal data by fixed base patterns and a skip-chain conditional random field.

The base patterns find emails, IP addresses, cards and phone numbers and always stay. The field labels tokens, the runs
of characters between white space; a token without a digit or @ is observed to be no entity, so that only cue tokens are
variables. Potentials: the token's class (its shape and the shapes around it), the labels of neighbouring cue tokens
(chain), the labels of consecutive occurrences of the same token in a document, separators and case aside (skip), and
those of consecutive similar tokens (alike: emails of one domain; numbers of equal length and first half), however far
apart. Loopy belief propagation runs over whole batches of documents at once; tokens whose best label is an entity, and
that no base span touches, become further spans, neighbours of one label joined.

Training is piecewise: each potential is fitted on its own from counts over all documents, whose tokens are labelled by
the base patterns; Spark sums the counts, of which there is a bounded number of classes.

Cases: null and empty texts have no spans; very long texts are searched whole, every pattern in linear time; of tokens
touched by several kinds the first listed kind counts; equal beliefs go to no entity; repeated rows give equal spans, rows
without an id are searched like others; without training rows only base spans are returned; only the id and text
columns are read, so further columns cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rounds of belief propagation, and the share of the old message that each keeps.
ROUNDS, DAMPING = 8, 0.2
#: Pseudo-count of the potentials, and the belief that an added span needs.
SMOOTH, SURE = 0.5, 0.6
KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
LINKS = ("chain", "skip", "alike")
# The patterns of the base spans. The left ends of emails are found from their @.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CUE = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_SPACES = " \t\n\r\v\f"
_CHUNK_END = re.compile(r"[ \t\n\r\v\f]|\Z")
_FIRST = re.compile(r"[A-Za-z0-9@+(]")
_LAST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789)")
_PLAIN = re.compile(r"[^a-z0-9@]+")


def luhn(digits: str) -> bool:
    """Whether the check sum of the digits is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48 << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, past, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            past = m.end()
        at = text.find("@", max(at + 1, past))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, ordered by start and kind."""
    found = [(a, b, 0) for a, b in emails(text)]
    if _DIGIT.search(text):
        found += [(*m.span(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((*m.span(), 2))
        if "+" in text:
            found += [(*m.span(), 3) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return in_order(found)


def in_order(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """By start, then kind as listed."""
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


def cue_tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens with a digit or @."""
    found, past = [], 0
    m = _CUE.search(text)
    while m:
        at = m.start()
        start = max(past, *(text.rfind(c, past, at) + 1 for c in _SPACES))
        past = _CHUNK_END.search(text, at).start()
        found.append((start, past))
        m = _CUE.search(text, past)
    return found


def token_class(token: str) -> str:
    """The token's shape: counts of digits, letters and dots in steps, a check sum that fails, and the marks that matter."""
    digits = _NOT_DIGIT.sub("", token)
    n = len(digits)
    letters = sum(map(str.isalpha, token))
    steps = lambda x, cuts: str(sum(x >= c for c in cuts))
    dots = token.count(".")
    return steps(n, (1, 2, 3, 4, 5, 7, 9, 12, 20)) + ("x" if n >= 12 and not luhn(digits) else "") + steps(letters, (1, 3, 8)) + str(min(dots, 4)) + "".join(c if c in token else "_" for c in "@+-()_:/=")


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The token without marks around it, or whole if nothing else is in it."""
    first, last = _FIRST.search(text, start, end), end
    while last > start and text[last - 1] not in _LAST:
        last -= 1
    return (first.start(), last) if first and first.start() < last else (start, end)


def propagate(own: np.ndarray, pairs: np.ndarray, edge: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Loopy belief propagation from log-potentials: the label distribution of each variable, exact on trees no deeper
    than the rounds but for the damping."""
    if len(pairs):
        source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        psi = np.exp(np.concatenate([edge, edge.transpose(0, 2, 1)]))
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        message = np.zeros((len(source), own.shape[1]))
        for _ in range(rounds):
            total = own.copy()
            np.add.at(total, target, message)
            out = total[source] - message[back]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.log(np.einsum("ex,exy->ey", out, psi))
            new -= new.max(axis=1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * new
        own = own.copy()
        np.add.at(own, target, message)
    p = np.exp(own - own.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


class Tokens:
    """The cue tokens of a batch of documents with their links."""

    def __init__(self, texts: list[str]):
        self.doc: list[int] = []
        self.span: list[tuple[int, int]] = []
        self.shape: list[str] = []
        self.links: dict[str, list[tuple[int, int]]] = {what: [] for what in LINKS}
        for d, text in enumerate(texts):
            same, alike, before = {}, {}, None
            for a, b in cue_tokens(text):
                start, end = trimmed(text, a, b)
                i = len(self.span)
                token = text[start:end]
                self.doc.append(d)
                self.span.append((start, end))
                self.shape.append(token_class(token))
                if before is not None and not text[before:a].strip(_SPACES):
                    self.links["chain"].append((i - 1, i))
                before = b
                low = token.lower()
                key = _PLAIN.sub("", low)
                if len(key) < 4:
                    continue
                kin = low[low.index("@") :] if "@" in low else f"{len(key)} {key[: len(key) // 2]}"
                if key in same:
                    self.links["skip"].append((same[key], i))
                elif kin in alike:
                    self.links["alike"].append((alike[kin], i))
                same[key] = alike[kin] = i

    def classes(self) -> list[str]:
        """Each token's class: its shape and those of its chain neighbours."""
        left, right = [""] * len(self.span), [""] * len(self.span)
        for i, j in self.links["chain"]:
            left[j], right[i] = self.shape[i][:3], self.shape[j][:3]
        return [f"{a}<{s}>{b}" for a, s, b in zip(left, self.shape, right)]

    def labels(self, spans: list[list[tuple[int, int, int]]]) -> list[int]:
        """Each token's label by the base spans of its document, ordered by start: 0, or 1 and the first kind that
        touches it."""
        out, doc, waiting = [], -1, []
        for d, (a, b) in zip(self.doc, self.span):
            if d != doc:
                doc, waiting, at = d, [], 0
            while at < len(spans[d]) and spans[d][at][0] < b:
                waiting.append(spans[d][at])
                at += 1
            waiting = [s for s in waiting if s[1] > a]
            out.append(1 + min((s[2] for s in waiting), default=-1))
        return out


class Crf:
    """Log-potentials: of classes, and of each kind of links."""

    def __init__(self, unary: dict[str, list[float]], plain: dict[str, list[float]], pairs: dict[str, np.ndarray]):
        self.unary, self.plain, self.pairs = unary, plain, pairs
        self.unseen = [0.0] + [-8.0] * len(KINDS)

    def potentials(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens' own log-potentials, the linked pairs, and the log-potentials of each pair."""
        own = np.array([self.unary.get(c) or self.plain.get(s) or self.unseen for c, s in zip(tokens.classes(), tokens.shape)])
        pairs = np.array([p for what in LINKS for p in tokens.links[what]], dtype=np.int64).reshape(-1, 2)
        return own, pairs, np.concatenate([np.repeat(self.pairs[what][None], len(tokens.links[what]), 0) for what in LINKS])

    def beliefs(self, tokens: Tokens) -> np.ndarray:
        """The label distribution of each token."""
        return propagate(*self.potentials(tokens))

    def added(self, texts: list[str], spans: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        """Further spans of each text, none of which touches a base span."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        tokens = Tokens(texts)
        if not tokens.span:
            return out
        p = self.beliefs(tokens)
        best, sure = p.argmax(axis=1), p.max(axis=1) >= SURE
        base = tokens.labels(spans)
        chained = {j for _, j in tokens.links["chain"]}
        for i, (d, (a, b)) in enumerate(zip(tokens.doc, tokens.span)):
            if best[i] and sure[i] and not base[i]:
                kind = int(best[i]) - 1
                held = out[d]
                if i in chained and held and held[-1][2] == kind and tokens.span[i - 1][1] == held[-1][1]:
                    held[-1] = (held[-1][0], b, kind)
                else:
                    held.append((a, b, kind))
        return out


def train(docs: DataFrame, text_col: str = "text") -> Crf | None:
    """Piecewise training from counts of classes and linked pairs with the base patterns' labels."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        counts: dict[tuple[str, str], int] = {}

        def add(what: str, label: str) -> None:
            counts[what, label] = counts.get((what, label), 0) + 1

        for batch in batches:
            text = common.texts(batch, text_col)
            tokens = Tokens(text)
            label = tokens.labels([base_spans(t) for t in text])
            for c, s, y in zip(tokens.classes(), tokens.shape, label):
                add(f"class {c}", str(y))
                add(f"shape {s}", str(y))
            for what, pairs in tokens.links.items():
                for i, j in pairs:
                    add(what, f"{label[i]}{label[j]}")
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["what", "label", "n"])

    rows = docs.filter(F.col(text_col).isNotNull()).select(text_col).mapInArrow(run, "what string, label string, n long").groupBy("what", "label").agg(F.sum("n").alias("n")).collect()
    size = len(LABELS)
    tables: dict[str, np.ndarray] = {}
    pairs = {what: np.full((size, size), SMOOTH) for what in LINKS}
    for r in rows:
        if r["what"] in pairs:
            pairs[r["what"]][int(r["label"][0]), int(r["label"][1])] += r["n"]
        else:
            tables.setdefault(r["what"], np.zeros(size))[int(r["label"])] += r["n"]
    if not tables:
        return None
    # a class without an entity gets a prior that leans to none
    prior = np.array([4 * SMOOTH, *[SMOOTH / 4] * len(KINDS)])
    logs = {k: np.log((v + prior) / (v + prior).sum()).tolist() for k, v in tables.items()}
    log_ratio = lambda n: np.log(n / n.sum()) - np.log(n.sum(axis=1, keepdims=True) / n.sum()) - np.log(n.sum(axis=0, keepdims=True) / n.sum())
    both_ways = {what: n if what == "chain" else n + n.T for what, n in pairs.items()}
    pick = lambda what: {k[6:]: v for k, v in logs.items() if k.startswith(what)}
    return Crf(pick("class "), pick("shape "), {what: np.clip(log_ratio(n), -3, 3) for what, n in both_ways.items()})


def spans_of(shared, name: str, texts: list[str]) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """Base and added spans of each text, with the broadcast field."""
    base = [base_spans(t) for t in texts]
    model = common.worker_state(name, lambda: Crf(*shared.value) if shared.value else None)
    return base, model.added(texts, base) if model else [[] for _ in texts]


def _share(spark: SparkSession, model: Crf | None):
    common.small_batches(spark)
    return spark.sparkContext.broadcast(model and (model.unary, model.plain, model.pairs)), uuid.uuid4().hex


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: id, base and all, arrays of spans (start, end in code points, kind), ordered by start and kind."""
    shared, name = _share(docs.sparkSession, model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def rows(spans):
        return pa.array([[{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in s] for s in spans], kind)

    def run(batches):
        for batch in batches:
            base, more = spans_of(shared, name, common.texts(batch, text_col))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), rows(base), rows([in_order(b + m) for b, m in zip(base, more)])], [id_col, "base", "spans"])

    array = "array<struct<start int, end int, kind string>>"
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, base {array}, spans {array}")


def redact(docs: DataFrame, model: Crf | None, text_col: str = "text") -> DataFrame:
    """The documents, all columns, each span (or run of overlapping spans) replaced by its kind in brackets."""
    shared, name = _share(docs.sparkSession, model)
    at = docs.columns.index(text_col)

    def clean(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
        if not spans:
            return text
        out, past = [], 0
        for a, b, k in sorted(spans):
            if a >= past:
                out += [text[past:a], f"[{KINDS[k].upper()}]"]
            past = max(past, b)
        return "".join(out) + text[past:]

    def run(batches):
        for batch in batches:
            raw = batch.column(text_col).to_pylist()
            base, more = spans_of(shared, name, [t or "" for t in raw])
            yield batch.set_column(at, text_col, pa.array([clean(t, b + m) for t, b, m in zip(raw, base, more)], pa.string()))

    return docs.mapInArrow(run, docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    shared, name = _share(spark, train(docs))

    def run(batches):
        for batch in batches:
            base, more = spans_of(shared, name, common.texts(batch, "text"))
            counts = [pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(_written(b).encode()).hexdigest() for b in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digest, pa.array([_written(in_order(b + m)) for b, m in zip(base, more)], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
