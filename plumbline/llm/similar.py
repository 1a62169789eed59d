"""Near copies by SimHash and pivot tables, then by exact similarity of word shingles.

Two documents are linked if the Jaccard similarity of their sets of shingles is at least SIMILARITY; a group is what
links reach. Sets whose fingerprints are equal, or nearest and at most DISTANCE bits apart by the pivot tables
(simhash.nearest), are verified first. Then a join finds all links that are left; it is exact. A document of n shingles shares at least ceil(s n) of them with any document of
similarity s, so under one order of all shingles two linked documents share one of their first n - ceil(s n) + 1:
1. equal sets are collapsed, and every further step has one row a set;
2. sets meet under the shingles of these prefixes, if their sizes allow the similarity. Beyond the last shingle that two
   prefixes share, two sets share at most what is left of either: pairs that this bound rules out go, where every crowded
   key of step 3 counts as shared. The rest are verified shingle by shingle. Frequent shingles come last in the order, as every
   SHARE-th document shows them: a fixed share, so that keys unknown to it stay as small whatever the input. It decides
   how many sets meet, never which ones are linked;
3. sets under a key of more than BUCKET are first verified against a few of them, the key's hubs: for each class of sizes (5
   per cent wide) the set with most members under its crowded keys, which the others were likely made from. Then sets of other
   components are verified against each other, if they may be similar without an ordinary key in common. Of two similar sets,
   what the prefix that ends first shares, it shares with the other's prefix: at least r shingles, which follows from its size and
   the least size in the other's class. So it shares r of its k crowded keys, and one of its k - r + 1 rarest ones, under which
   alone it is compared, and not at all if r > k or if all prefixes of that class end before. Last, the places of a shared key
   bound what two sets share. Every pair under a key is verified, ruled out by these bounds, or already in one group.

Cases: words are those of simhash; a text of fewer words than a shingle is one shingle; null texts and texts without a
word have the empty set and are copies of each other; rows without an id are in no group; rows of one id belong to each
other's groups; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, simhash
from .components import components

WORDS = 5
SIMILARITY = Fraction(4, 5)
#: Most bits between fingerprints that are tried first: the first level's keys are 21 bits or more.
DISTANCE = 4
#: Sets under one key that are paired off at once, and classes of sizes for each factor of e.
BUCKET, CLASSES = 48, 20
#: One in so many documents orders the shingles; least count in these of a frequent one, and most frequent ones broadcast.
SHARE, FREQUENT, MOST = 16, 3, 1 << 19
#: Ids of documents whose sets are read that are still broadcast; more are joined by a shuffle.
MOST_IDS = 1 << 20


def shingles(text: str, words_of: int = WORDS) -> np.ndarray:
    """The distinct hashes of the text's word shingles, ascending."""
    return np.unique(simhash.hashes(text, words_of).view(np.int64))


def name_of(found: np.ndarray) -> int:
    """One number for a set of shingles."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


def prefix(found: np.ndarray, frequent: np.ndarray, least: Fraction = SIMILARITY) -> tuple[np.ndarray, int]:
    """The first shingles of a set, of which any set of the least similarity shares one, and where the last of them stands in
    the order of all (its number without the last two bits, frequent ones after all others)."""
    if not found.size:
        return found, 0
    common_ = frequent[np.minimum(np.searchsorted(frequent, found), frequent.size - 1)] == found if frequent.size else np.zeros(found.size, dtype=bool)
    needed = -(-least.numerator * found.size // least.denominator)
    keys = np.concatenate([found[~common_], found[common_]])[: found.size - needed + 1]
    return keys, (int(keys[-1]) >> 2) + (int(keys.size > (~common_).sum()) << 62)


def _sets(docs: DataFrame, id_col: str, text_col: str, words_of: int) -> DataFrame:
    """Per row: id, set, and all its shingles."""

    def run(batches):
        common.free_state()
        for batch in batches:
            found = [shingles(t, words_of) for t in common.texts(batch, text_col)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([name_of(f) for f in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], [id_col, "node", "shingles"])

    common.small_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, node long, shingles array<long>")


def frequent_shingles(docs: DataFrame, id_col: str, text_col: str, words_of: int) -> np.ndarray:
    """The most frequent shingles of one document in SHARE, ascending."""
    some = docs.filter(F.pmod(F.xxhash64(F.lit("order"), F.col(id_col)), F.lit(SHARE)) == 0)
    counted = _sets(some, id_col, text_col, words_of).select(F.explode("shingles").alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT)
    return np.sort(counted.orderBy(F.desc("n"), "key").limit(MOST).select("key").toPandas()["key"].to_numpy(dtype=np.int64))


def _prefixes(docs: DataFrame, id_col: str, text_col: str, words_of: int, least: Fraction) -> DataFrame:
    """Per row: id, set, its fingerprint and size, where its prefix ends, and the shingles of its prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, id_col, text_col, words_of))

    def run(batches):
        common.free_state()
        for batch in batches:
            found, prints = [], []
            for t in common.texts(batch, text_col):
                h = simhash.hashes(t, words_of)
                found.append(np.unique(h.view(np.int64)))
                prints.append(simhash.of_hashes(h))
            first = [prefix(f, shared.value, least) for f in found]
            columns = [pa.array([name_of(f) for f in found], pa.int64()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array([f.size for f in found], pa.int32()), pa.array([end for _, end in first], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *columns, pa.array([keys for keys, _ in first], pa.list_(pa.int64()))], [id_col, "node", "fp", "n", "last", "keys"])

    common.small_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, node long, fp long, n int, last long, keys array<long>")


def _sizes_allow(least: Fraction) -> Column:
    return F.least("n", "m").cast("long") * least.denominator >= F.greatest("n", "m").cast("long") * least.numerator


def _places_allow(least: Fraction) -> Column:
    """Whether two sets with a shingle at these places can be similar: what comes before it and what comes after it are
    shared by the lesser part at most."""
    most = F.least("place", "place_v") + F.least(F.col("n") - F.col("place"), F.col("m") - F.col("place_v"))
    return most.cast("long") * (least.numerator + least.denominator) >= (F.col("n") + F.col("m")).cast("long") * least.numerator


def _of_sets(docs: DataFrame, heads: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words_of: int) -> DataFrame:
    """(node, shingles) of some sets, read from the text of one document each."""
    ids = common.materialize(heads.join(nodes, "node", "left_semi").select(F.col("least").alias(id_col)), "similar-ids")
    if ids.count() <= MOST_IDS:
        ids = F.broadcast(ids)
    return _sets(docs.join(ids, id_col, "left_semi"), id_col, text_col, words_of).select("node", "shingles")


def verified(pairs: DataFrame, docs: DataFrame, heads: DataFrame, id_col: str, text_col: str, words_of: int, least: Fraction) -> DataFrame:
    """The pairs (u, v) of sets that are similar."""
    pairs = common.materialize(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "similar-pairs")
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    sets = common.materialize(_of_sets(docs, heads, nodes, id_col, text_col, words_of), "similar-sets")
    met = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("s")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("t")), "v")
    both = met.withColumn("both", F.size(F.array_intersect("s", "t")).cast("long"))
    near = both.filter(F.col("both") * least.denominator >= (F.size("s") + F.size("t") - F.col("both")) * least.numerator)
    found = common.materialize(near.select("u", "v"), "similar-links")
    common.discard(pairs, sets)
    return found


def _by_fingerprints(heads: DataFrame, distance: int, bucket: int) -> DataFrame:
    """(u, v): sets with one fingerprint, the least of them against each other one, and sets with nearest fingerprints."""
    of_print = common.materialize(heads.groupBy("fp").agg(F.min("node").alias("v")), "similar-prints")
    equal = heads.join(of_print, "fp").filter("node <> v").select(F.col("node").alias("u"), "v")
    named = lambda fp, node: of_print.select(F.col("fp").alias(fp), F.col("v").alias(node))
    near = simhash.nearest(of_print.select("fp"), distance, bucket).withColumnsRenamed({"u": "fp_u", "v": "fp_v"})
    return equal.union(near.join(named("fp_u", "u"), "fp_u").join(named("fp_v", "v"), "fp_v").select("u", "v"))


def _crowded(met: DataFrame, heads: DataFrame, bucket: int, least: Fraction) -> DataFrame:
    """The rows of keys of more than `bucket` sets: (key, node, n, place, members), where the set's prefix ends (last), the
    class of its size, its members under all such keys (weight), the number of these keys (k), and the key's number among them
    by place (nth) and by members (rare)."""
    of_node = Window.partitionBy("node")
    return met.filter(F.col("members") > bucket).join(heads.select("node", "last"), "node").select(
        "key", "node", "n", "place", "members", "last", F.floor(F.log(F.col("n") + F.lit(1.0)) * CLASSES).cast("int").alias("class"),
        F.sum("members").over(of_node).alias("weight"), F.count("*").over(of_node).alias("k"),
        (F.row_number().over(of_node.orderBy("place")) - 1).alias("nth"), F.row_number().over(of_node.orderBy("members", "key")).alias("rare"),
    )


def _least_shared(n: str, m: str, least: Fraction) -> str:
    """How many shingles of its prefix a set of n shares with a similar one of m or more, if its prefix ends first."""
    a, b = least.numerator, least.denominator
    own = f"({a}L * {n} + {b - 1}) div {b}"
    return f"greatest(1L, ({a}L * ({n} + greatest({m}, {own})) + {a + b - 1}) div {a + b} - {own} + 1)"


def _classes(crowded: DataFrame) -> DataFrame:
    """(key, of, hub, smallest, largest, latest): the classes of sizes under each key, and where their last prefix ends."""
    hub = F.max(F.struct("weight", "node", "n", "k", "last")).alias("hub")
    return crowded.groupBy("key", F.col("class").alias("of")).agg(hub, F.min("n").alias("smallest"), F.max("n").alias("largest"), F.max("last").alias("latest"))


def _meetings(crowded: DataFrame, classes: DataFrame, least: Fraction) -> DataFrame:
    """Each row of `crowded` with the classes of its key that may hold similar sets."""
    a, b = least.numerator, least.denominator
    return crowded.join(classes, "key").filter(f"{a}L * n <= {b}L * largest and {a}L * smallest <= {b}L * n")


def _stars(crowded: DataFrame, classes: DataFrame, least: Fraction) -> DataFrame:
    """(u, v): sets and hubs that may be similar."""
    first, second = f"k >= {_least_shared('n', 'hub.n', least)}", f"hub.k >= {_least_shared('hub.n', 'n', least)}"
    may = f"(last <= hub.last and {first}) or (hub.last <= last and {second})"
    return _meetings(crowded, classes, least).filter("node <> hub.node").filter(may).select(F.col("node").alias("u"), F.col("hub.node").alias("v")).distinct()


def _rest(crowded: DataFrame, classes: DataFrame, roots: DataFrame, least: Fraction) -> DataFrame:
    """(u, v): pairs under crowded keys in different components that may be similar; the prefix of u ends first. Sets in the
    component of a class's hub meet the class's strays alone."""
    a, b = least.numerator, least.denominator
    root = lambda df, node, name: df.join(roots.select(F.col("node").alias(node), F.col("root").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))
    classes = common.materialize(root(classes.withColumn("hub_node", F.col("hub.node")).drop("hub"), "hub_node", "hub_root").drop("hub_node"), "similar-hubs")
    rooted = common.materialize(root(crowded, "node", "root"), "similar-rooted")
    probes = _meetings(rooted, classes, least).filter(f"last <= latest and rare <= k - {_least_shared('n', 'smallest', least)} + 1")
    kind = F.expr("root = hub_root").alias("to_strays")
    probes = probes.select("key", F.col("of").alias("class"), F.col("node").alias("u"), "n", "place", "nth", "last", F.col("root").alias("root_u"), kind)
    others = rooted.join(classes.select("key", F.col("of").alias("class"), "hub_root"), ["key", "class"])
    kinds = F.explode(F.when(F.col("root") == F.col("hub_root"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("to_strays")
    others = others.select("key", "class", F.col("node").alias("v"), F.col("n").alias("m"), F.col("place").alias("place_v"), F.col("nth").alias("nth_v"), F.col("last").alias("last_v"), "root", kinds)
    pairs = probes.join(others, ["key", "class", "to_strays"]).filter("root <> root_u and last <= last_v")
    most = "least(nth, nth_v) + least(n - place, m - place_v)"
    return pairs.filter(_sizes_allow(least)).filter(f"{a + b}L * ({most}) >= {a}L * (n + m)").select("u", "v")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_of: int = WORDS, least: Fraction = SIMILARITY, bucket: int = BUCKET, distance: int = DISTANCE) -> DataFrame:
    """Per document with an id: id, component_id (the least id that links reach)."""
    docs = docs.filter(F.col(id_col).isNotNull())
    check = lambda pairs: verified(pairs, docs, heads, id_col, text_col, words_of, least)
    prints = common.materialize(_prefixes(docs, id_col, text_col, words_of, least), "similar")
    heads = common.materialize(prints.groupBy("node").agg(F.min(id_col).alias("least"), F.min("last").alias("last"), F.min("fp").alias("fp")), "similar-heads")
    linked = check(_by_fingerprints(heads, distance, bucket))
    other = lambda pairs: pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).join(linked, ["u", "v"], "left_anti")

    # copies are combined before the shuffle; the sum and the join below read the same shuffle
    first = prints.groupBy("node").agg(F.min_by(F.struct("n", "keys"), id_col).alias("set"))
    keyed = first.select("node", "set.n", F.posexplode("set.keys").alias("place", "key"))
    # sums and a join, so that a hot key is combined before its shuffle and split in the join; most keys are of one set
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    met = common.materialize(keyed.join(shared, "key").select("key", "node", "n", "place", "members"), "similar-met")

    ordinary = met.filter(F.col("members") <= bucket)
    one, two = ordinary.select("key", F.col("node").alias("u"), "n", "place"), ordinary.select("key", F.col("node").alias("v"), F.col("n").alias("m"), F.col("place").alias("place_v"))
    pairs = one.join(two, "key").filter("u < v").filter(_sizes_allow(least)).filter(_places_allow(least))
    crowded = common.materialize(_crowded(met, heads, bucket, least), "similar-crowded")
    extra = crowded.filter("nth = 0").select("node", F.col("k").alias("extra"))
    pairs = pairs.groupBy("u", "v", "n", "m").agg(F.count("*").alias("shared"), F.max("place").alias("last"), F.max("place_v").alias("last_v"))
    pairs = pairs.join(extra.withColumnsRenamed({"node": "u", "extra": "of_u"}), "u", "left").join(extra.withColumnsRenamed({"node": "v", "extra": "of_v"}), "v", "left")
    crowded_too = F.least(F.coalesce("of_u", F.lit(0)), F.coalesce("of_v", F.lit(0)))
    most = F.col("shared") + crowded_too + F.least(F.col("n") - F.col("last"), F.col("m") - F.col("last_v")) - 1
    pairs = pairs.filter(most * (least.numerator + least.denominator) >= (F.col("n") + F.col("m")).cast("long") * least.numerator).select("u", "v")

    if crowded.isEmpty():
        links = linked.union(check(other(pairs)))
    else:
        classes = common.materialize(_classes(crowded), "similar-classes")
        links = linked.union(check(other(pairs.union(_stars(crowded, classes, least)))))
        links = links.union(check(_rest(crowded, classes, components(links), least)))

    roots = components(links).select("node", "root")
    rooted = heads.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.select(id_col, "node").join(rooted.join(ids, "root").select("node", "component_id"), "node").select(id_col, "component_id")
