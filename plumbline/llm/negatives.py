"""Hard-negative mining by product quantisation with stored residual norms.

Steps:
1. codebooks: a bounded sample of vectors is cut into SUBSPACES pieces, and k-means gives each piece CODES centroids. The
   sample decides how tight the bounds are, never what is found;
2. index: every row is written with its code in each subspace and the norm of its residual, the vector less its centroids;
3. search: an anchor's inner products with all centroids are a lookup table. The sum over a row's codes, plus or minus
   the anchor's norm times the row's residual norm, bounds the true score from both sides. Rows whose upper bound is below
   the score of the anchor's last place so far, or whose bounds miss all its windows, are discarded; the others are scored in
   exact integers. First every anchor's positives, then, with their scores, the windows of its negatives;
4. each task keeps the first rows of each anchor or window among its own rows, and a window function picks the first of all.

Anchors are a stated set of queries against all rows: blocks of BLOCK anchors are sent to all tasks, and each block reads the
index once. Rows are dealt as they were read, so that no label, anchor or source decides where work goes.

Cases: rows with a null label, a null vector, or a null or non-finite component take no part, nor do those with a component
beyond 2^30 after scaling; an empty vector has the score 0 with any other; of vectors of different lengths the missing
components count as 0; rows that repeat an id are rows each, and so are anchors that do; ties go by id; an anchor without
positives or a window without rows gives no row; an empty table gives an empty result; only the three columns are read, under
names of this module, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rows of the sample, about, that codebooks are fitted on, rounds of k-means, pieces of a vector and centroids of a piece.
SAMPLE, ROUNDS, SUBSPACES, CODES = 1 << 13, 8, 32, 256
#: Anchors sent to all tasks at once, anchors and rows that a task compares at once, and pairs scored at once.
BLOCK, ANCHORS, ROWS, PAIRS = 4096, 128, 2048, 1 << 16
#: A component becomes floor(SCALE x); components beyond LARGEST take no part.
SCALE, LARGEST = 256, 1 << 30
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is 30 to 90 hundredths of the positive's.
LOW, HIGH, HUNDRED = 30, 90, 100


def vectors(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(row, id, label, x): the rows that take part, with whole components."""
    x = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * SCALE))
    fine = F.forall(F.col(vector_col), lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST / SCALE, F.lit(False)))
    part = rows.filter(F.col(vector_col).isNotNull()).filter(fine).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), x.cast("array<int>").alias("x"))
    return part.filter("label is not null").withColumn("row", F.monotonically_increasing_id())


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of one matrix, shorter ones padded with 0."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))
    if len(flat) == width * len(column):
        return flat.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    for i, piece in enumerate(np.split(flat, ends[:-1])):
        out[i, : len(piece)] = piece
    return out


class Quantiser:
    """Codebooks of the pieces of a vector."""

    def __init__(self, width: int, books: list[np.ndarray]):
        self.width, self.books = width, books
        self.cuts = [len(c) for c in np.array_split(np.arange(width), len(books))]
        self.cuts = np.cumsum([0, *self.cuts])

    @staticmethod
    def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
        return ((book**2).sum(1) - 2 * x @ book.T).argmin(1)

    @classmethod
    def fit(cls, sample: np.ndarray, seed: int = 0) -> Quantiser:
        n, width = sample.shape
        order, books = np.random.default_rng(seed).permutation(n), []
        for piece in np.array_split(sample.astype(np.float64), min(SUBSPACES, max(1, width)), axis=1):
            book = piece[order[:CODES]]
            for _ in range(ROUNDS):
                near = cls.nearest(piece, book)
                size = np.bincount(near, minlength=len(book))
                sums = np.stack([np.bincount(near, piece[:, j], len(book)) for j in range(piece.shape[1])], 1) if piece.shape[1] else book
                book = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], book)
            books.append(book)
        return cls(width, books)

    def pieces(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k, book in enumerate(self.books):
            yield x[:, self.cuts[k] : self.cuts[k + 1]], book

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, a row each, and residual norms rounded up."""
        codes, left = np.zeros((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for k, (piece, book) in enumerate(self.pieces(x.astype(np.float64))):
            codes[:, k] = self.nearest(piece, book)
            left += ((piece - book[codes[:, k]]) ** 2).sum(1)
        return codes, np.sqrt(left) * (1 + 1e-9) + 1e-9

    def table(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products by subspace, code and anchor."""
        return np.stack([np.pad(book @ piece.T, ((0, CODES - len(book)), (0, 0))) for piece, book in self.pieces(anchors.astype(np.float64))])


def index(rows: DataFrame, quantiser: Quantiser) -> DataFrame:
    """(row, id, label, x, codes, left): every row with its codes and its residual norm."""

    def run(batches):
        for batch in batches:
            codes, left = quantiser.encode(matrix(batch.column("x"), quantiser.width))
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "label", "x")), packed, pa.array(left)], ["row", "id", "label", "x", "codes", "left"])

    return rows.select("row", "id", "label", "x").mapInArrow(run, "row long, id long, label long, x array<int>, codes binary, left double")


class Best:
    """The first `places` rows by (score descending, id, row) of each of a number of lists."""

    def __init__(self, lists: int, places: int):
        self.places = places
        self.of = np.zeros(0, np.int64)
        self.score, self.id, self.row = self.of, self.of, self.of
        self.last = np.full(lists, np.iinfo(np.int64).min)  # the score that a row must reach at least

    def add(self, of: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        if not len(of):
            return
        of, score, id_, row = (np.concatenate(p) for p in ((self.of, of), (self.score, score), (self.id, id_), (self.row, row)))
        order = np.lexsort((row, id_, -score, of))
        of = of[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        kept = order[place < self.places]
        full = order[place == self.places - 1]
        self.last[of[place == self.places - 1]] = score[full]
        self.of, self.score, self.id, self.row = of[place < self.places], score[kept], id_[kept], row[kept]


def scored(x: np.ndarray, anchors: np.ndarray, r: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact inner products of rows r with anchors a."""
    parts = [np.einsum("ij,ij->i", x[r[i : i + PAIRS]], anchors[a[i : i + PAIRS]]) for i in range(0, len(r), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class Search:
    """A block of anchors (x, label, row) with windows of scores (low and high, a row each of `anchor`) or none: then the
    rows of the anchor's own label are sought, whatever their score. One search sees all rows of a task."""

    def __init__(self, quantiser: Quantiser, x: np.ndarray, label: np.ndarray, row: np.ndarray, places: int, windows: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.q, self.x, self.label, self.row, self.windows = quantiser, x, label, row, windows
        self.norm, self.table = np.sqrt((x.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9), quantiser.table(x)
        self.best = Best(len(windows[0]) if windows else len(x), places)
        if windows:
            self.best.last = windows[1].copy()
            self.starts = np.searchsorted(windows[0], np.arange(len(x) + 1))

    def bounds(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lookup sums and what the true score may differ from them, rows by anchors."""
        sums = np.zeros((len(codes), len(self.x)))
        for k in range(codes.shape[1]):
            sums += self.table[k][codes[:, k]]
        return sums, left[:, None] * self.norm + (1e-9 * np.abs(sums) + 1e-6)

    def see(self, row: np.ndarray, id_: np.ndarray, label: np.ndarray, x: np.ndarray, codes: np.ndarray, left: np.ndarray) -> None:
        sums, apart = self.bounds(codes, left)
        alike = label[:, None] == self.label
        if self.windows is None:
            least = self.best.last.astype(np.float64)
            r, a = np.nonzero(alike & (row[:, None] != self.row) & (sums + apart >= least))
            self.best.add(a, scored(x, self.x, r, a), id_[r], row[r])
            return
        of, low, high = self.windows
        least, most = np.full(len(self.x), np.inf), np.full(len(self.x), -np.inf)
        np.minimum.at(least, of, np.maximum(self.best.last, low).astype(np.float64))
        np.maximum.at(most, of, high.astype(np.float64))
        r, a = np.nonzero(~alike & (sums + apart >= least) & (sums - apart <= most))
        score, n = scored(x, self.x, r, a), self.starts[a + 1] - self.starts[a]
        pair = np.repeat(np.arange(len(r)), n)
        window = np.repeat(self.starts[a] - (np.cumsum(n) - n), n) + np.arange(len(pair))
        fits = (score[pair] >= np.maximum(low[window], self.best.last[window])) & (score[pair] <= high[window])
        pair, window = pair[fits], window[fits]
        self.best.add(window, score[pair], id_[r[pair]], row[r[pair]])


def _searched(indexed: DataFrame, quantiser: Quantiser, block: dict[str, np.ndarray], places: int) -> DataFrame:
    """(list, score, id, row): the first rows of each anchor, or of each window, in each task."""
    shared = indexed.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        common.free_state()
        b, searches = shared.value, []
        for at in range(0, len(b["row"]), ANCHORS):
            own = slice(at, at + ANCHORS)
            windows, first = None, at
            if "of" in b:
                first, last = np.searchsorted(b["of"], [at, at + ANCHORS])
                windows = (b["of"][first:last] - at, b["low"][first:last], b["high"][first:last])
            searches.append((first, Search(quantiser, b["x"][own], b["label"][own], b["row"][own], places, windows)))
        for batch in batches:
            n = batch.num_rows
            row, id_, label, left = (batch.column(c).to_numpy() for c in ("row", "id", "label", "left"))
            x = matrix(batch.column("x"), quantiser.width)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(n, -1)
            for i in range(0, n, ROWS):
                cut = slice(i, i + ROWS)
                for _, s in searches:
                    s.see(row[cut], id_[cut], label[cut], x[cut], codes[cut], left[cut])
        for first, s in searches:
            yield pa.RecordBatch.from_arrays([pa.array(s.best.of + first), pa.array(s.best.score), pa.array(s.best.id), pa.array(s.best.row)], ["list", "score", "id", "row"])

    return indexed.mapInArrow(run, "list long, score long, id long, row long")


def first_of(found: DataFrame, places: int) -> DataFrame:
    """Adds rank: the first rows of each list among those of all tasks."""
    w = Window.partitionBy("list").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= places)


def _block(anchors: DataFrame, k: int, width: int) -> dict[str, np.ndarray]:
    """At most BLOCK anchors, by row."""
    t = anchors.filter(F.col("block") == k).orderBy("row").select("row", "id", "label", "x").toArrow().combine_chunks()
    columns = {c: t.column(c).to_numpy() for c in ("row", "id", "label")}
    x = t.column("x").combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.int32()))
    return columns | {"x": matrix(x, width)}


def mine(
    rows: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). `anchor` is a condition on the id column."""
    spark = rows.sparkSession
    common.small_batches(spark)
    part = common.materialize(vectors(rows, id_col, vector_col, label), "negatives-rows")
    width = part.agg(F.max(F.size("x"))).first()[0] or 0
    sample = common.bounded_sample(part, SAMPLE, "row").select("x").toArrow().combine_chunks()
    if not sample.num_rows:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    quantiser = Quantiser.fit(matrix(sample.column("x").combine_chunks(), width))
    indexed = common.materialize(index(part, quantiser), "negatives-index")
    anchors = indexed.select("row", F.col("id").alias(id_col), "label", "x").filter(anchor).withColumnRenamed(id_col, "id")
    blocks = -(-anchors.count() // block)
    cut = anchors.stat.approxQuantile("row", [i / blocks for i in range(1, blocks)], 0) if blocks > 1 else []
    number = sum((F.when(F.col("row") >= int(c), 1).otherwise(0) for c in cut), F.lit(0))
    anchors = common.materialize(anchors.withColumn("block", number), "negatives-anchors")

    out = []
    for k in range(blocks):
        b = _block(anchors, k, width)
        near = first_of(_searched(indexed, quantiser, b, positives), positives).orderBy("list", "rank").toArrow()
        of, score, positive = (near.column(c).to_numpy() for c in ("list", "score", "id"))
        b |= {"of": of, "low": -(-low * score // HUNDRED), "high": high * score // HUNDRED}
        found = first_of(_searched(indexed, quantiser, b, negatives), negatives)
        names = spark.createDataFrame(pa.table({"list": np.arange(len(of)), "anchor_id": b["id"][of], "positive_id": positive, "positive_score": score}))
        found = found.join(F.broadcast(names), "list")  # `positives` rows for each anchor of the block
        found = found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.append(common.materialize(found, "negatives"))
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


OP12_SQL = """
WITH part AS (
    SELECT row_number() OVER () AS row_id, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS x
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT a.row_id AS anchor_row, a.vec_id AS anchor_id, b.vec_id AS vec_id, b.row_id, a.label = b.label AS alike, list_inner_product(a.x, b.x)::BIGINT AS score
    FROM part a JOIN part b ON a.vec_id % 100 = 0 AND a.row_id <> b.row_id
), positives AS (
    SELECT anchor_row, row_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_row ORDER BY score DESC, vec_id) <= 5
)
SELECT s.anchor_id, p.positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s USING (anchor_row)
WHERE NOT s.alike AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY anchor_row, p.row_id ORDER BY s.score DESC, s.vec_id)
QUALIFY rank <= 10
"""
