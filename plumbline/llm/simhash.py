"""SimHash near-duplicates through pivot distance tables.

The pivots are PIVOTS reference fingerprints. A fingerprint's coordinates are its Hamming distances to them, over all
bits or over the bits of a region alone. Two fingerprints that agree in a region have equal coordinates there, and two
at most d bits apart have coordinates over all bits that differ by at most d. Steps:
1. the open bits are cut into d + 2 bands. At most d bands differ, so that linked fingerprints agree in the region of
   some two bands: they meet under its coordinates. Every other pair is discarded by the table, unseen;
2. a key that more than `bucket` fingerprints share is refined: its open bits, those outside the region, are cut into
   bands in the same way, and the coordinates of two of these join the key. This is exact at every level, for at most d of
   the open bits differ; at the last level few bits are open, and so few fingerprints share a key;
3. pairs under one key are discarded if any coordinate over all bits differs by more than d, and survivors are
   verified bit by bit.
Only distinct fingerprints are compared, so that exact copies never meet in pairs.

`group` with a `similarity` links documents by the similarity of their sets of shingles. The tables come first (`nearest`):
each fingerprint meets its nearest one at most `distance` bits apart, and such pairs are linked if their sets are similar.
An exact search follows in .similar for all other pairs, since at a similarity of 0.8 two fingerprints differ in ten bits on
average, and 64 bits hold no table that finds pairs so far apart without comparing all.

Cases: null and empty texts and texts without a word have fingerprint zero and link like any other; very long texts are
hashed whole; a bit with exactly half of the hashes is 0; repeated rows share a fingerprint, and rows without an id
count for no component's least id (a component of such rows alone has none); an empty table gives an empty result; only
the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

SEED = 42
WORDS, DISTANCE = 3, 2
#: Reference fingerprints, and the seed that makes them.
PIVOTS = 16
PIVOT_SEED = 7
#: Fingerprints under one key that are paired off; keys of more are refined.
BUCKET = 48
#: Open bits below which a key is not refined any more.
FEW_BITS = 8
#: Regions of a level at most, which bounds the tables of larger distances.
MOST_REGIONS = 1000
ALL = (1 << 64) - 1


def hashes(text: str, words_of: int = WORDS) -> np.ndarray:
    """The unsigned hashes of the text's word shingles, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    if len(words) < words_of:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_of))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], dtype="<u8")


def fingerprint(text: str, words_of: int = WORDS) -> int:
    """SimHash of the text's word shingles as an unsigned 64-bit number."""
    return of_hashes(hashes(text, words_of))


def of_hashes(h: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_of: int = WORDS) -> DataFrame:
    """Per document: id and fp, the fingerprint as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, words_of) for t in common.texts(batch, text_col)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(fp)], [id_col, "fp"])

    common.small_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int = PIVOTS) -> list[int]:
    return [int(x) for x in np.random.default_rng(PIVOT_SEED).integers(-(1 << 63), (1 << 63) - 1, n, dtype=np.int64)]


def coordinates(fp: Column, region: Column) -> Column:
    """Distances to the pivots over the bits of a region."""
    return F.transform(F.array(*map(F.lit, pivots())), lambda p: F.bit_count(fp.bitwiseXOR(p).bitwiseAND(region)).cast("tinyint"))


def regions(distance: int) -> list[list[tuple[int, int, int]]]:
    """For each level, (open bits, region, bits open after it): two of distance + 2 bands of the open bits."""
    levels, open_ = [], [ALL]
    while open_ and min(bits.bit_count() for bits in open_) > FEW_BITS:
        found = []
        for bits in open_:
            places = [i for i in range(64) if bits >> i & 1]
            bands = [sum(1 << int(i) for i in part) for part in np.array_split(places, distance + 2)]
            found += [(bits, a | b, bits & ~(a | b)) for a, b in combinations(bands, 2)]
        if len(found) > MOST_REGIONS:
            break
        levels.append(found)
        open_ = list(dict.fromkeys(left for _, _, left in found))
    return levels


def _under_keys(open_: DataFrame, level: list[tuple[int, int, int]]) -> DataFrame:
    """Each (fp, key, bits) with the keys of its next regions. A clash of two keys only adds candidates."""
    rows = [tuple(map(_signed, r)) for r in level]
    if len({bits for bits, _, _ in rows}) == 1:
        choice = F.explode(F.array(*(F.struct(F.lit(region).alias("region"), F.lit(left).alias("left_")) for _, region, left in rows))).alias("choice")
        met = open_.select("fp", "key", choice).select("fp", "key", "choice.region", "choice.left_")
    else:
        table = open_.sparkSession.createDataFrame(rows, "bits long, region long, left_ long")  # a fixed table of few hundred rows
        met = open_.join(F.broadcast(table), "bits")
    return met.select("fp", F.xxhash64("key", "region", coordinates(F.col("fp"), F.col("region"))).alias("key"), F.col("left_").alias("bits"))


def _tables_allow(distance: int) -> str:
    return f"forall(zip_with(s, t, (a, b) -> abs(a - b)), x -> x <= {distance})"


def _near(keyed: DataFrame, distance: int) -> DataFrame:
    """Links among the fingerprints of each key."""
    table = keyed.select("key", "fp", coordinates(F.col("fp"), F.lit(-1).cast("long")).alias("table"))
    table = common.materialize(table, "simhash-table")
    left, right = table.select("key", F.col("fp").alias("u"), F.col("table").alias("s")), table.select("key", F.col("fp").alias("v"), F.col("table").alias("t"))
    pairs = left.join(right, "key").filter("u < v")
    alike = pairs.filter(_tables_allow(distance))
    return alike.filter(f"bit_count(u ^ v) <= {distance}").select("u", "v").distinct()


def links(distinct: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """All pairs (u, v), u < v, of distinct fingerprints fp at most `distance` bits apart."""
    open_ = distinct.select("fp", F.lit(0).cast("long").alias("key"), F.lit(-1).cast("long").alias("bits"))
    found, levels = [], regions(distance)
    for k, level in enumerate(levels):
        keyed = common.materialize(_under_keys(open_, level), "simhash-keys")
        sizes = common.materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-sizes")
        crowded = F.col("n") > bucket if k + 1 < len(levels) else F.lit(False)
        found.append(_near(keyed.join(sizes.filter(~crowded).select("key"), "key"), distance))
        rest = sizes.filter(crowded).select("key")
        if rest.isEmpty():
            break
        open_ = keyed.join(rest, "key").select("fp", "key", "bits")
    return reduce(DataFrame.union, found)


def nearest(distinct: DataFrame, distance: int, bucket: int = BUCKET) -> DataFrame:
    """(u, v): each distinct fingerprint fp with the nearest one, at most `distance` bits apart, that it meets under the keys of
    the first level; under a key of more than `bucket` it meets the least one alone. The work is linear in the fingerprints
    also where many lie close together, for callers that have an exact way for all other pairs."""
    open_ = distinct.select("fp", F.lit(0).cast("long").alias("key"), F.lit(-1).cast("long").alias("bits"))
    keyed = _under_keys(open_, regions(distance)[0]).select("key", "fp").repartition("key")  # one shuffle for the sum and the join
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("least")).filter("n > 1")
    met = common.materialize(keyed.join(sizes, "key"), "simhash-met")
    few = met.filter(F.col("n") <= bucket)
    pairs = few.select("key", F.col("fp").alias("u")).join(few.select("key", F.col("fp").alias("v")), "key").select("u", "v")
    pairs = pairs.union(met.filter(F.col("n") > bucket).select(F.col("fp").alias("u"), F.col("least").alias("v"))).filter("u <> v")
    table = lambda fp: coordinates(F.col(fp), F.lit(-1).cast("long"))
    alike = pairs.withColumns({"s": table("u"), "t": table("v")}).filter(_tables_allow(distance)).select("u", "v", F.expr("bit_count(u ^ v)").alias("apart"))
    found = alike.filter(F.col("apart") <= distance).groupBy("u").agg(F.min(F.struct("apart", "v")).alias("best")).select("u", "best.v")
    found = common.materialize(found, "simhash-nearest")
    common.discard(met)
    return found


def group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_of: int = WORDS, distance: int = DISTANCE, bucket: int = BUCKET, similarity: Fraction | None = None
) -> DataFrame:
    """Per document: id, fp and component_id, the least id that links reach. With a similarity, links are pairs of sets
    of shingles at least so similar, fingerprints at most `distance` bits apart are tried first, and only documents with an id
    are returned, without fp."""
    if similarity is not None:
        from . import similar

        return similar.group(docs, id_col, text_col, words_of, similarity, bucket, distance)
    prints = common.materialize(fingerprints(docs, id_col, text_col, words_of), "simhash")
    distinct = common.materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct")
    roots = components(links(distinct, distance, bucket)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select(id_col, "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = group(common.documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
