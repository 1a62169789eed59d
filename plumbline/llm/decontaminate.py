"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A passage of a document matches a benchmark item of m characters if at most k = RATE m edits turn one into the other.
By the q-gram lemma such a passage shares at least T = m + 1 - Q (k + 1) q-grams with the item, all of them on at most
k + 1 neighbouring diagonals (document position less item position). If u of the item's q-grams are left out, it still
shares T - u of the others: of each item up to T / 2 q-grams that a block repeats more than HOT times are left out, the
most frequent ones first. Steps, all inside the task that reads a document:
1. every position's q-gram is looked up in a bit table of the benchmark's q-grams; stretches with too few hits in every
   window for any item are passed over (the window bound follows from T, so no match is lost);
2. in the other stretches, hits are counted for each item in overlapping bands of 2 (k + 1) diagonals, so that the
   k + 1 diagonals of a match lie whole in one band, HITS hits at a time; bands with at least T - u hits are kept;
3. kept bands are verified by an edit-distance alignment that fills only the band.
Items too short for the lemma (T below 1) are cut into k + 1 pieces, one of which any match holds unchanged; an automaton
finds all pieces of a block in one pass, and their diagonals are verified in the same way. The benchmark is broadcast in
blocks of about BLOCK characters, each of which the driver collects, broadcasts and lets go before the next; the documents
are read once for each block. Items of equal text are compared once.

Letters are compared in lower case and white space characters as equal. Cases: null and empty texts match nothing; null and
empty items are left out; very long texts are matched whole; a band gives its
best match, the first of equals, so that only passages that stand a band apart are counted each; of overlapping matches of one item the one with the fewest
edits stays, then the first; repeated rows are matched alike, and so are repeated items; rows without an id match under
the id null; an empty benchmark or table gives an empty result; only the id and text columns are read, so further
columns cannot clash.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left, insort

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import groups

Q = 8
RATE = 0.08
#: Characters of benchmark text that are broadcast at once.
BLOCK = 8_000_000
#: Characters of a window of the first filter.
WINDOW = 54
#: Places of a q-gram in a block above which items may leave it out, and hits that are counted at once.
HOT, HITS = 64, 1 << 20
_SPACE = re.compile(r"\s")
_BITS = 21


def fold(text: str) -> str:
    """Lower case and plain spaces, position by position."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return _SPACE.sub(" ", low)


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def qgrams(points: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the Q = 8 characters from each position on."""
    two = points[:-1] * np.uint32(0x9E3779B1) + points[1:]
    four = two[:-2] * np.uint32(0x85EBCA6B) + two[2:]
    h = four[:-4] * np.uint32(0xC2B2AE35) + four[4:]
    return h ^ (h >> np.uint32(15))


def budget(m: int) -> int:
    return int(RATE * m)


class Index:
    """The q-grams of one block of the benchmark, and the pieces of its short items."""

    def __init__(self, items: list[tuple[object, str]]):
        same: dict[str, list] = {}
        for i, t in items:
            same.setdefault(fold(t), []).append(i)
        self.text, self.ids = list(same), list(same.values())
        self.points = [points_of(t) for t in self.text]
        self.size = np.array([len(t) for t in self.text], dtype=np.int64)
        self.edits = np.array([budget(len(t)) for t in self.text], dtype=np.int64)
        self.least = self.size + 1 - Q * (self.edits + 1)
        long = [k for k in range(len(self.text)) if self.least[k] >= 1]
        self._pieces([k for k in range(len(self.text)) if self.least[k] < 1])
        grams = [qgrams(self.points[k]) for k in long]
        key = np.concatenate(grams) if grams else np.zeros(0, np.uint32)
        _, of, times = np.unique(key, return_inverse=True, return_counts=True)
        held, at = np.ones(len(key), dtype=bool), 0
        for k, g in zip(long, grams):
            often = times[of[at : at + len(g)]]
            out = np.argsort(-often, kind="stable")[: int(self.least[k]) // 2]
            out = out[often[out] > HOT]
            held[at + out] = False
            self.least[k] -= len(out)
            at += len(g)
        item = np.repeat(np.array(long, dtype=np.int64), [len(g) for g in grams]) if grams else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        key, item, place = key[held], item[held], place[held]
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.place = key[order], item[order], place[order]
        self.bits = np.zeros(1 << _BITS, dtype=bool)
        self.bits[self.key >> np.uint32(32 - _BITS)] = True
        reach = self.size[long] + self.edits[long] if long else np.zeros(0, np.int64)
        self.window_hits = int(min((-(-self.least[long] // -(-reach // WINDOW))), default=0)) if long else 0
        self.reach = int(reach.max()) if long else 0

    def _pieces(self, short: list[int]) -> None:
        """An automaton of the short items' pieces: one of edits + 1 pieces stands unchanged in any match."""
        places: dict[str, list[tuple[int, int]]] = {}
        for k in short:
            cuts = [int(self.size[k]) * j // int(self.edits[k] + 1) for j in range(int(self.edits[k]) + 2)]
            for a, b in zip(cuts, cuts[1:]):
                places.setdefault(self.text[k][a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton() if places else None
        for piece, of in places.items():
            self.automaton.add_word(piece, (len(piece), of))
        if places:
            self.automaton.make_automaton()

    def short_matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the short items in a folded text."""
        if self.automaton is None or not text:
            return []
        found, points, seen = [], None, set()
        for end, (n, of) in self.automaton.iter(text):
            for k, a in of:
                most, diagonal = int(self.edits[k]), end + 1 - n - a
                if not most:
                    found.append((k, diagonal, end + 1, 0))
                elif (k, diagonal) not in seen:
                    seen.add((k, diagonal))
                    points = points_of(text) if points is None else points
                    if got := align(self.points[k], points, diagonal, diagonal, most):
                        found.append((k, got[1], got[2], got[0]))
        return found

    def stretches(self, hit: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of positions that may hold a match."""
        run = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
        dense = np.nonzero(run[np.minimum(np.arange(len(hit)) + WINDOW, len(hit))] - run[:-1] >= self.window_hits)[0]
        if not dense.size:
            return []
        cut = np.nonzero(np.diff(dense) > 2 * self.reach)[0]
        first, last = dense[np.concatenate([[0], cut + 1])], dense[np.concatenate([cut, [dense.size - 1]])]
        return [(max(0, int(a) - self.reach), min(len(hit), int(b) + WINDOW + self.reach)) for a, b in zip(first, last)]

    def bands(self, h: np.ndarray, hit: np.ndarray, a: int, b: int) -> list[tuple[int, int, int]]:
        """(item, first and last diagonal) of the bands with enough hits in positions a to b, by item and diagonal."""
        at = a + np.nonzero(hit[a:b])[0]
        lo, hi = np.searchsorted(self.key, h[at], "left"), np.searchsorted(self.key, h[at], "right")
        at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        width = np.int64(2 * len(h) + 4)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        total = np.cumsum(n)
        first = 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + HITS, "right")))
            own = n[first:last]
            entry = np.repeat(lo[first:last] - np.cumsum(own) + own, own) + np.arange(own.sum())
            item = self.item[entry]
            band = (np.repeat(at[first:last], own) - self.place[entry] + len(h)) // (self.edits[item] + 1)
            new, of = np.unique(np.concatenate([keys, item * width + band, item * width + band - 1]), return_inverse=True)
            counts = np.bincount(of, np.concatenate([counts, np.ones(2 * len(item))]), len(new)).astype(np.int64)
            keys, first = new, last
        out = []
        for key in keys[counts >= self.least[keys // width]] if len(keys) else keys:
            i, band_ = divmod(int(key), int(width))
            low = band_ * int(self.edits[i] + 1) - len(h)
            out.append((i, low, low + 2 * int(self.edits[i] + 1) - 1))
        return out


def align(item: np.ndarray, text: np.ndarray, first: int, last: int, most: int) -> tuple[int, int, int] | None:
    """The least edits between item and a passage of text on diagonals first - most to last + most: (edits, start, end),
    None above `most`."""
    first, last = first - most, last + most
    width = last - first + 1
    padded = np.full(width + len(item) + 1, 0xFFFFFFFF, dtype=np.uint32)
    lo, hi = max(0, first), min(len(text), first + len(padded))
    if hi <= lo:
        return None
    padded[lo - first : hi - first] = text[lo:hi]
    shift, big = np.arange(width), 1 << 20
    # places before the text or after it cannot be passed
    diagonal = first + shift
    cost = np.where((diagonal >= 0) & (diagonal <= len(text)), 0, big)
    start = diagonal.copy()
    for i, c in enumerate(item.tolist()):
        match = cost + (padded[i : i + width] != c)
        skip = np.append(cost[1:] + 1, big)
        better = skip < match
        now, now_start = np.where(better, skip, match), np.where(better, np.append(start[1:], 0), start)
        # an extra character of the text moves one diagonal up
        tag = np.minimum.accumulate(((now - shift) << 24) + shift)
        source = tag & 0xFFFFFF
        spread = (tag >> 24) + shift
        cost, start = spread, now_start[source]
        if cost.min() > most:
            return None
    end = diagonal + len(item)
    cost = np.where((end >= 0) & (end <= len(text)), cost, big)
    best = int(cost.argmin())
    return (int(cost[best]), max(0, int(start[best])), int(end[best])) if cost[best] <= most else None


def apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of overlapping matches of one item the one with the fewest edits, then the first; in order of item and start."""
    kept: dict[int, list[tuple[int, int, int, int]]] = {}
    for m in sorted(set(found), key=lambda m: (m[0], m[3], m[1], m[2])):
        held = kept.setdefault(m[0], [])
        at = bisect_left(held, (m[0], m[1]))
        if not (at and held[at - 1][2] > m[1]) and not (at < len(held) and held[at][1] < m[2]):
            insort(held, m)
    return [m for k in sorted(kept) for m in kept[k]]


def find(index: Index, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
    """For each text, matches (item position, start, end, edits) in order of item and start."""
    folded = [fold(t) for t in texts]
    found = [index.short_matches(t) for t in folded]
    if not len(index.key):
        return [apart(f) for f in found]
    # texts end to end, with a gap that no q-gram matches across
    gap = "\0" * Q
    points = points_of(gap.join(folded) + gap)
    starts = np.cumsum([0] + [len(t) + Q for t in folded])
    h = qgrams(points)
    hit = index.bits[h >> np.uint32(32 - _BITS)]
    for a, b in index.stretches(hit):
        whole = (-1, 0, 0)
        for k, first, last in index.bands(h, hit, a, b):
            most = int(index.edits[k])
            # all matches of this band would begin inside an exact one, which overlaps them and stays
            if whole[0] == k and first - most >= whole[1] and last + most < whole[2]:
                continue
            # the texts under the band, of which at least one character is compared
            one = np.searchsorted(starts, max(0, first), "right") - 1
            two = np.searchsorted(starts, max(0, min(last + int(index.size[k]), int(starts[-1]) - 1)), "right") - 1
            for i in range(int(one), min(int(two) + 1, len(texts))):
                at = int(starts[i])
                text = points[at : at + len(folded[i])]
                if text.size and (got := align(index.points[k], text, first - at, last - at, most)):
                    found[i].append((k, got[1], got[2], got[0]))
                    if not got[0] and (whole[0] != k or at + got[1] >= whole[2]):
                        whole = (k, at + got[1], at + got[2])
    return [apart(f) for f in found]


def _index(shared) -> Index:
    return common.worker_state(shared.id, lambda: Index(shared.value))


class _Block:
    """A broadcast block and a name for it within the worker."""

    def __init__(self, spark: SparkSession, items: list[tuple[int, str]]):
        self.broadcast = spark.sparkContext.broadcast(items)
        self.id = uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """Broadcast blocks of the benchmark, each of about BLOCK characters at most."""
    usable = benchmark.filter(F.length(text_col) > 0).select(id_col, text_col)
    size = usable.agg(F.sum(F.length(text_col))).first()[0] or 0
    n = -(-size // BLOCK)
    for k in range(n):
        rows = usable.filter(F.pmod(F.xxhash64(id_col), F.lit(n)) == k).orderBy(id_col).collect()
        if rows:
            yield _Block(benchmark.sparkSession, [(r[0], r[1]) for r in rows])


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """All matching passages: id, item id, start, end (code points, end exclusive), edits."""
    spark = docs.sparkSession
    common.small_batches(spark)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"{id_col} {kind}, {item_col} {item_kind}, start long, `end` long, edits int"
    found = spark.createDataFrame([], schema)
    for block in blocks(benchmark, item_col, text_col):

        def run(batches, block=block):
            index = _index(block)
            for batch in batches:
                text = common.texts(batch, text_col)
                rows = [(a + i, m, item) for a, b in groups(text, 1 << 19) for i, ms in enumerate(find(index, text[a:b])) for m in ms for item in index.ids[m[0]]]
                columns = [batch.column(id_col).take(pa.array([i for i, _, _ in rows], pa.int64())), pa.array([item for _, _, item in rows], pa.int64() if item_kind == "bigint" else None)]
                columns += [pa.array([m[1] for _, m, _ in rows], pa.int64()), pa.array([m[2] for _, m, _ in rows], pa.int64()), pa.array([m[3] for _, m, _ in rows], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, [id_col, item_col, "start", "end", "edits"])

        found = found.union(docs.select(id_col, text_col).mapInArrow(run, schema))
    return found


def clean_only(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, all columns, that match no benchmark item."""
    common.small_batches(docs.sparkSession)
    for block in blocks(benchmark, "item_id", text_col):

        def run(batches, block=block):
            index = _index(block)
            for batch in batches:
                text = common.texts(batch, text_col)
                yield batch.filter(pa.array([not ms for a, b in groups(text, 1 << 19) for ms in find(index, text[a:b])], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that match: the closest passage and the number of passages."""
    found = matches(common.documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark"))
    best = F.min(F.struct("edits", "start", "end")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best, F.count("*").alias("n_passages")).select("doc_id", "item_id", "best.start", "best.end", "best.edits", "n_passages")
