"""URL filter: rules first, then gradient-boosted trees on lexical features.

Steps:
1. host and path are cut from each URL; of the rules that fit, the longest gives the verdict. URLs with a rule are the
   labelled ones;
2. suffix statistics: for the host's last label, its last two labels, the path's first segment and its extension, how many
   labelled URLs have it and how many of these are blocked. All labelled URLs are counted, in FOLDS parts of the URLs'
   hashes; names are hashed to BUCKETS numbers, which bounds the table, so that it can be broadcast;
3. boosted trees learn from a sample of about SAMPLE labelled URLs: lengths, depth, digit ratio, entropy, parameter counts and the
   suffix statistics, for a URL in the sample those of the other parts, so that no URL's own label is among its features;
4. URLs without a rule are judged by the trees: score is the probability of `block`, and 0.5 or more blocks.

Cases: a null URL and one without `://` have an empty host and path, fit no rule and are judged by the trees as an empty
text or by what they hold; very long URLs are read whole, in linear time; equal URLs get equal verdicts and repeated rows
stay; a host with a port or user is taken as it stands; without labelled URLs nothing is blocked, and with labels of one
kind alone that kind is the verdict (score null in both cases); an empty table gives an empty result; only the id and URL are
read, under names of this module, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path) of the query's rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
VERDICTS = ("allow", "block")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labelled URLs that the trees learn from, about.
SAMPLE = 20_000
#: Numbers that a kind of name is hashed to, and parts of the labelled URLs.
BUCKETS, FOLDS = 1 << 14, 4
#: Kinds of names with statistics.
KINDS = ("top", "domain", "segment", "extension")
#: Labelled URLs that a name's share is smoothed by.
PRIOR = 2.0
TREES, DEPTH, STEP, PARTITIONS = 20, 4, 0.2, 4
LEXICAL = ("length", "host_length", "path_length", "depth", "digits", "entropy", "parameters", "values", "labels", "hyphens", "secure", "fragment")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.when(at > 0, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(at > 0, path).otherwise("")


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null. A rule fits its host and all subdomains."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of_host, of_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of_host) | host.endswith(f".{of_host}")) & path.startswith(of_path)
        out = F.when(fits, F.struct(F.lit(of_host + of_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits a character; all characters outside printable ASCII count as one."""
    n = F.greatest(F.length(text), F.lit(1))
    counts = F.transform(F.sequence(F.lit(32), F.lit(126)), lambda c: F.length(text) - F.length(F.replace(text, F.chr(c), F.lit(""))))
    rest = F.length(text) - F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    bits = F.transform(F.concat(counts, F.array(rest)), lambda x: F.when(x > 0, -x / n * F.log2(x / n)).otherwise(0.0))
    return F.aggregate(bits, F.lit(0.0), lambda a, x: a + x)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that a URL has by itself."""
    count = lambda text, what: F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    made = {
        "length": F.length(url), "host_length": F.length(host), "path_length": F.length(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")),
        "digits": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)),
        "entropy": entropy(url), "parameters": F.size(F.filter(F.split(query, "&"), lambda s: s != "")),
        "values": count(query, "="), "labels": F.size(F.filter(F.split(host, r"\."), lambda s: s != "")), "hyphens": count(host, "-"),
        "secure": F.translate(F.substring(url, 1, 8), UPPER, LOWER) == "https://", "fragment": count(url, "#"),
    }
    return {k: v.cast("double") for k, v in made.items()}


def names(host: Column, path: Column) -> dict[str, Column]:
    """The names that statistics are kept of."""
    return {
        "top": F.substring_index(host, ".", -1), "domain": F.substring_index(host, ".", -2),
        "segment": F.regexp_extract(path, "^/([^/]*)", 1), "extension": F.regexp_extract(path, r"\.([^./]*)$", 1),
    }


def features(pages: DataFrame, id_col: str, url_col: str, rules: Sequence[tuple[str, str, str]], learn: Column) -> DataFrame:
    """id, url, host, path, rule, given (the rule's verdict), label (1: blocked; null where nothing is to be learned), the
    lexical features and each name's number."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), learn.alias("learn"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("*", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    label = F.when(F.col("found").isNotNull() & F.col("learn"), (F.col("found.verdict") == "block").cast("double"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS)).cast("int")
    text = F.coalesce("url", F.lit(""))
    numbers = [F.pmod(F.xxhash64(F.lit(k), c), F.lit(BUCKETS)).cast("int").alias(k) for k, c in names(F.col("host"), F.col("path")).items()]
    made = [c.alias(k) for k, c in lexical(text, F.col("host"), F.col("path")).items()]
    return rows.select("id", "url", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("given"), label.alias("label"), fold.alias("fold"), *numbers, *made)


def suffix_counts(rows: DataFrame) -> DataFrame:
    """(kind, bucket, fold, n, blocked) over all labelled rows; at most BUCKETS x FOLDS rows a kind."""
    each = rows.filter("label is not null").select("label", "fold", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("bucket")) for k in KINDS))).alias("name"))
    return each.groupBy("name.kind", "name.bucket", "fold").agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))


def with_statistics(rows: DataFrame, counts: DataFrame, others: bool) -> DataFrame:
    """Adds share and size of each name among the labelled URLs; with `others`, among those of other parts than the row's."""
    for kind in KINDS:
        of_kind = counts.filter(F.col("kind") == kind)
        total = of_kind.groupBy(F.col("bucket").alias(kind)).agg(F.sum("n").alias("n_"), F.sum("blocked").alias("blocked_"))
        rows = rows.join(F.broadcast(total), kind, "left").na.fill(0, ["n_", "blocked_"])
        if others:
            own = of_kind.select(F.col("bucket").alias(kind), "fold", F.col("n").alias("own_n"), F.col("blocked").alias("own_blocked"))
            rows = rows.join(F.broadcast(own), [kind, "fold"], "left").na.fill(0, ["own_n", "own_blocked"])
            rows = rows.withColumn("n_", F.col("n_") - F.col("own_n")).withColumn("blocked_", F.col("blocked_") - F.col("own_blocked")).drop("own_n", "own_blocked")
        share = (F.col("blocked_") + PRIOR / 2) / (F.col("n_") + PRIOR)
        rows = rows.withColumn(f"{kind}_share", share).withColumn(f"{kind}_size", F.log2(F.col("n_") + 1.0)).drop("n_", "blocked_")
    return rows


INPUTS = [*LEXICAL, *(f"{k}_{what}" for k in KINDS for what in ("share", "size"))]


def assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=INPUTS, outputCol="inputs").transform(rows)


def train(rows: DataFrame, counts: DataFrame, sample: int = SAMPLE) -> GBTClassificationModel | None:
    """Boosted trees from about `sample` labelled rows, or None where their labels are not of two kinds."""
    known = common.bounded_sample(rows.filter("label is not null"), sample, "id", "url")
    known = assembled(with_statistics(known, counts, others=True)).select("label", "inputs", "url", "id")
    # one order of the rows whatever the files, so that the same tables give the same trees
    known = common.materialize(known.repartition(PARTITIONS, "url").sortWithinPartitions("url", "id").select("label", "inputs"), "urls-sample")
    if known.select("label").distinct().count() < 2:
        return None
    return GBTClassifier(featuresCol="inputs", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1).fit(known)


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", learn: Column | None = None, sample: int = SAMPLE,
) -> DataFrame:
    """Per row: id, host, path, rule, verdict, score (probability of `block` by the trees). `learn` may leave URLs that
    have a rule out of the learning."""
    rows = features(pages, id_col, url_col, rules, F.lit(True) if learn is None else learn)
    counts = common.materialize(suffix_counts(rows), "urls-counts")
    total = counts.filter(F.col("kind") == KINDS[0]).agg(F.sum("n"), F.sum("blocked")).first()
    model = train(rows, counts, sample) if total[0] and 0 < total[1] < total[0] else None
    if model is None:
        usual = VERDICTS[bool(total[0] and total[1] * 2 >= total[0])]
        judged = rows.withColumn("score", F.lit(None).cast("double")).withColumn("usual", F.lit(usual))
    else:
        judged = model.transform(assembled(with_statistics(rows, counts, others=False)))
        judged = judged.withColumn("score", vector_to_array("probability")[1])
        judged = judged.withColumn("usual", F.when(F.col("score") >= 0.5, VERDICTS[1]).otherwise(VERDICTS[0]))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("given", "usual").alias("verdict"), "score")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))
