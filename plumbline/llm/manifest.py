"""Merkle manifest of a dataset: one tree a group (source), one tree over the groups, and a proof for each row.

A leaf is the hash of a row's fields. The leaves of a group ascend by id; every FAN consecutive nodes become their hash,
until one is left. Steps:
1. exact ranks by a radix trie, without a global sort: a histogram counts the ids of each prefix (the id without its last
   8 bits) in a group, coarser histograms are sums of finer ones, and the ids before a prefix are the counts of its
   smaller siblings, summed from the coarsest level down, in windows of at most 256 rows. Inside a prefix a window
   numbers the few ids. A prefix that holds more rows than BUCKET (repeated or missing ids) is refined by further digits: the
   rest of the id, the leaf, then the row's number, so that no window holds more than BUCKET rows;
2. a node's key is the prefix of its leaves' rank in digits of base FAN. The longest prefixes are reduced first, one digit
   a level; runs of siblings are written to the shared folder, and the first level's hold the rows themselves;
3. paths come down: each level's runs take the siblings and the path of their parent's run, so that what is joined
   shrinks FAN-fold from level to level, and the rows unfold from their run with the whole path beside it.

Cases: a null field counts as `-`; a null group is the first group, a null id the first of its group; rows of one id are
ordered by leaf, and equal rows are leaves each; very long texts are hashed whole; a group of one row is its leaf; the only
row of the only group has an empty path; an empty table gives an empty result; only the named fields are read, under names of
this module, so further columns cannot clash. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node; a power of two.
FAN = 16
#: Bits of a digit of an id, and rows that one window numbers.
DIGIT, BUCKET = 8, 1 << 16
#: Prefix of rows without an id, below that of any id.
NO_ID = -(1 << (63 - DIGIT)) - 1
#: One id in so many is tampered with by the query.
TAMPERED = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(fields: Iterable[Column]) -> Column:
    """sha256 of the fields, each with its length before it."""

    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return F.sha2(F.concat(*map(part, fields)), 256)


def _before(hist: DataFrame, within: list[str], by: str, n: str) -> DataFrame:
    """Adds `before`, the sum of n over smaller siblings."""
    w = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn("before", F.coalesce(F.sum(n).over(w), F.lit(0)))


def prefix_bases(rows: DataFrame) -> DataFrame:
    """(tree, p, m, base, n): for each prefix its rows, the rows of its tree before it and all rows of the tree."""
    levels = [common.materialize(rows.groupBy("tree", "p").agg(F.count("*").alias("m")), "manifest-histogram")]
    while not levels[-1].groupBy("tree").count().filter(F.col("count") > 1 << DIGIT).isEmpty():
        coarser = levels[-1].groupBy("tree", F.shiftright("p", DIGIT).alias("p")).agg(F.sum("m").alias("m"))
        levels.append(common.materialize(coarser, "manifest-histogram"))
    top = levels.pop()
    bases = _before(top, ["tree"], "p", "m").withColumn("n", F.sum("m").over(Window.partitionBy("tree"))).withColumnRenamed("before", "base")
    while levels:
        finer = _before(levels.pop().withColumn("up", F.shiftright("p", DIGIT)), ["tree", "up"], "p", "m")
        above = bases.select("tree", F.col("p").alias("up"), "base", "n")
        bases = finer.join(above, ["tree", "up"]).select("tree", "p", "m", (F.col("base") + F.col("before")).alias("base"), "n")
    return common.materialize(bases, "manifest-bases")


def refined(rows: DataFrame, digits: Iterable[Column], bucket: int) -> DataFrame:
    """Rows of crowded buckets (tree, p, base and more) after splitting each by further digits until none is crowded; p
    becomes a bucket's whole prefix and base the rows of the tree before it."""
    done, columns = [], rows.columns
    rows = rows.withColumn("p", F.col("p").cast("string"))
    for digit in digits:
        rows = common.materialize(rows.withColumn("d", digit), "manifest-refined")
        hist = _before(rows.groupBy("tree", "p", "d").agg(F.count("*").alias("m_")), ["tree", "p"], "d", "m_")
        rows = rows.join(hist, ["tree", "p", "d"]).withColumn("base", F.col("base") + F.col("before")).withColumn("p", F.concat_ws("/", "p", "d"))
        done.append(rows.filter(F.col("m_") <= bucket).select(columns))
        rows = rows.filter(F.col("m_") > bucket).select(columns)
        if rows.isEmpty():
            break
    else:
        done.append(rows)
    return reduce(DataFrame.union, done)


def _hex_digit(number: Column) -> Column:
    return F.lpad(F.hex(number.bitwiseAND((1 << DIGIT) - 1)), DIGIT // 4, "0")


def _row_digits() -> list[Column]:
    """The order (id, leaf, row) of one prefix's rows as digits; a leaf's first digits tell all but equal ones apart."""
    leaf = [F.substring("h", 1 + 3 * k, 3) for k in range(4)]
    rest = [_hex_digit(F.shiftright("row", s)) for s in range(63 // DIGIT * DIGIT, -1, -DIGIT)]
    return [F.coalesce(_hex_digit(F.col("id")), F.lit("")), *leaf, F.col("h"), *rest]


def ranked(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Adds pos, the rank of each row (tree, id, h, row) in its tree by (id, h), and n, the tree's rows."""
    keyed = rows.withColumn("p", F.coalesce(F.shiftright("id", DIGIT), F.lit(NO_ID)))
    bases = prefix_bases(keyed)
    crowded = bases.filter(F.col("m") > bucket).select("tree", "p", "base", "n")
    place = F.row_number().over(Window.partitionBy("tree", "p").orderBy("id", "h", "row")) - 1
    split = not crowded.isEmpty()
    few = keyed.join(crowded, ["tree", "p"], "left_anti") if split else keyed
    out = few.join(bases.select("tree", "p", "base", "n"), ["tree", "p"]).withColumn("pos", F.col("base") + place)
    if split:
        many = refined(keyed.join(crowded, ["tree", "p"]), _row_digits(), bucket).withColumn("pos", F.col("base") + place)
        out = out.select(*rows.columns, "n", "pos").union(many.select(*rows.columns, "n", "pos"))
    return out.select(*rows.columns, "n", "pos")


def ranked_names(tops: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Adds pos and n to the trees' rows (name, h): their rank by name, bytewise, in one tree of all."""
    n = tops.count()
    rows = tops.select(F.lit("").alias("tree"), "name", "h", F.lit("").alias("p"), F.lit(0).cast("long").alias("base"), F.lit(n).cast("long").alias("n"))
    if n > bucket:
        rows = refined(rows, (F.substring(F.hex("name"), 1 + 4 * k, 4) for k in count()), bucket)
    place = F.row_number().over(Window.partitionBy("tree", "p").orderBy("name")) - 1
    return rows.withColumn("pos", F.col("base") + place).select("tree", "name", "h", "n", "pos")


def climb(leaves: DataFrame, item: Column, fan: int = FAN) -> list[DataFrame]:
    """The runs of siblings by level, leaves (tree, n, pos, h) first: (tree, pos, n, lone, run, h) for the run that becomes
    node pos of n; the first level has the items of its leaves too. Level by level until each tree has one node."""
    digit = fan.bit_length() - 1
    up = [F.shiftright("pos", digit).alias("pos"), F.expr(f"(n + {fan - 1}) div {fan}").alias("n"), (F.col("n") == 1).alias("lone")]

    def runs(nodes: DataFrame, *more: Column) -> DataFrame:
        kept = F.array_sort(F.collect_list(F.struct(F.col("pos").alias("at"), "h", *more)))
        found = nodes.groupBy("tree", *up).agg(kept.alias("members")).withColumn("run", F.transform("members", lambda x: x.h))
        found = found.withColumn("h", F.when(F.col("lone"), F.col("run")[0]).otherwise(F.sha2(F.array_join("run", ""), 256)))
        return common.materialize(found if more else found.drop("members"), "manifest-runs")

    levels = [runs(leaves, item.alias("item"))]
    while not (open_ := levels[-1].filter("n > 1").select("tree", "pos", "n", "h")).isEmpty():
        levels.append(runs(open_))
    return levels


def tops_of(levels: list[DataFrame]) -> DataFrame:
    """(tree, h): the last node of each tree."""
    return reduce(DataFrame.union, (r.filter("n = 1").select("tree", "h") for r in levels))


def _step(run: str, at: Column) -> Column:
    """What stands left and right of member `at` of a run."""
    left = F.array_join(F.slice(run, F.lit(1), at), "")
    right = F.array_join(F.slice(run, at + 2, F.size(run)), "")
    return F.struct(left.alias("left"), right.alias("right"))


def descend(levels: list[DataFrame], above: DataFrame, fan: int = FAN) -> DataFrame:
    """(tree, item, h, path) of each leaf: path is the siblings of all levels, first the leaf's own, last those of the path
    that `above` (tree, path) gives for the whole tree."""
    digit = fan.bit_length() - 1
    with_path: DataFrame | None = None
    for runs in levels[::-1]:
        tops = runs.filter("n = 1").join(above, "tree")
        if with_path is not None:
            parent = with_path.select("tree", F.col("pos").alias("up"), F.col("run").alias("run_up"), F.col("path").alias("path_up"))
            at = F.col("pos").bitwiseAND(fan - 1).cast("int")
            inner = runs.filter("n > 1").withColumn("up", F.shiftright("pos", digit)).join(parent, ["tree", "up"])
            tops = tops.union(inner.withColumn("path", F.concat(F.array(_step("run_up", at)), "path_up")).select(tops.columns))
        with_path = tops
    each = with_path.select("tree", "lone", "run", "path", F.posexplode("members").alias("i", "member"))
    own = F.when(F.col("lone"), F.col("path")).otherwise(F.concat(F.array(_step("run", F.col("i"))), "path"))
    return each.select("tree", "member.item", "member.h", own.alias("path"))


def proof_hash(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s.left, s.right)), ""), 256)


def fold(path: Column, h: Column) -> Column:
    """The root that a leaf of hash h has by this path."""
    return F.aggregate(path, h, lambda acc, s: F.sha2(F.concat(s.left, acc, s.right), 256))


def manifest(
    docs: DataFrame, fields: Iterable[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source",
    received: Callable[[str], Column] | None = None, fan: int = FAN, bucket: int = BUCKET,
) -> DataFrame:
    """Per row: id, group, leaf, subroot (its group's root), root, path (siblings left and right, level by level), and
    received_leaf: the hash of the fields as `received` gives them (by name, a column), or null where that is the leaf."""
    none = F.lit(None).cast("string")
    other = leaf_hash(received(f) for f in fields) if received else none
    group = F.col(group_col).cast("string")
    rows = docs.select(
        F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group)).alias("tree"), F.col(id_col).cast("long").alias("id"),
        leaf_hash(map(F.col, fields)).alias("h"), other.alias("other"),
    )
    rows = rows.withColumn("other", F.when(F.col("other") != F.col("h"), F.col("other"))).withColumn("row", F.monotonically_increasing_id())
    rows = common.materialize(rows, "manifest-leaves")

    levels = climb(ranked(rows, bucket), F.struct("id", "other"), fan)
    subroots = common.materialize(tops_of(levels), "manifest-subroots")
    over = climb(ranked_names(subroots.withColumnRenamed("tree", "name"), bucket), F.col("name"), fan)
    top = tops_of(over).first()
    root = F.lit(top.h if top else None).cast("string")
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    whole = docs.sparkSession.range(1).select(F.lit("").alias("tree"), nothing.alias("path"))
    above = descend(over, whole, fan).select(F.col("item").alias("tree"), F.col("h").alias("subroot"), "path")
    above = common.materialize(above, "manifest-above")

    found = descend(levels, above.select("tree", "path"), fan).join(above.select("tree", "subroot"), "tree")
    group_name = F.when(F.col("tree") != "", F.substring("tree", 2, (1 << 31) - 1))
    return found.select(
        F.col("item.id").cast(docs.schema[id_col].dataType).alias("id"), group_name.alias("group"), F.col("h").alias("leaf"), "subroot",
        root.alias("root"), "path", F.col("item.other").alias("received_leaf"),
    )


def tampered_field(name: str) -> Column:
    """A field as the query receives it: of one id in TAMPERED the text's letters are made small."""
    if name != "text":
        return F.col(name)
    return F.when(common.remainder("doc_id", TAMPERED) == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest(common.documents(spark, sf_dir), received=tampered_field)
    folded = fold(F.col("path"), F.coalesce("received_leaf", "leaf"))
    found = found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same rows by recursion over levels; the ids' crc32 by its table of 256, as the engine has no such function.
OP13_SQL = """
WITH RECURSIVE crc_table AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), docs AS (
    SELECT doc_id, source, row_number() OVER () AS row_id, text,
        concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
            coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
        xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
            lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295) AS crc
    FROM documents CROSS JOIN crc_table
), leaves AS (
    SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        CASE WHEN crc % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other
    FROM docs
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM leaves
), low AS (
    SELECT source, 0 AS lvl, place AS pos, n, leaf AS h FROM placed
    UNION ALL
    SELECT source, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY source, lvl, pos // 16, n
), subroots AS (
    SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
    SELECT 100 AS lvl, place AS pos, n, h FROM subroots
    UNION ALL
    SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lvl, pos // 16, n
), steps AS (
    SELECT source, lvl, pos, n, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
        coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
    FROM low WHERE n > 1 WINDOW w AS (PARTITION BY source, lvl, pos // 16 ORDER BY pos)
), high_steps AS (
    SELECT lvl, pos, n, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
        coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
    FROM high WHERE n > 1 WINDOW w AS (PARTITION BY lvl, pos // 16 ORDER BY pos)
), walk AS (
    SELECT row_id, source, 0 AS lvl, place AS pos, coalesce(other, leaf) AS h, '' AS proof FROM placed
    UNION ALL
    SELECT k.row_id, k.source, k.lvl + 1, k.pos // 16, sha256(s.lft || k.h || s.rgt), k.proof || s.lft || s.rgt
    FROM walk k JOIN steps s ON s.source IS NOT DISTINCT FROM k.source AND s.lvl = k.lvl AND s.pos = k.pos
), at_top AS (
    SELECT k.row_id, 100 AS lvl, t.place AS pos, k.h, k.proof, t.h AS subroot
    FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY lvl DESC) AS last FROM walk) k JOIN subroots t ON t.source IS NOT DISTINCT FROM k.source WHERE last = 1
), finish AS (
    SELECT row_id, lvl, pos, h, proof, subroot FROM at_top
    UNION ALL
    SELECT k.row_id, k.lvl + 1, k.pos // 16, sha256(s.lft || k.h || s.rgt), k.proof || s.lft || s.rgt, k.subroot
    FROM finish k JOIN high_steps s ON s.lvl = k.lvl AND s.pos = k.pos
), ended AS (
    SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY lvl DESC) AS last FROM finish
)
SELECT d.doc_id, d.leaf, e.subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM ended e JOIN leaves d USING (row_id) CROSS JOIN (SELECT h FROM high WHERE n = 1) r WHERE e.last = 1
"""
