import pytest
from pyspark.sql import functions as F

from .brute import MESSY, MESSY_URLS, MESSY_VECTORS

DATA = "/root/testdata/sf0.001"
#: Further columns whose names the operators use inside.
CLASH = ("part", "blob", "fp", "score", "component_id", "start", "n_tokens", "file", "train", "held_out", "toxic_", "value", "spans", "media", "row", "rank", "tree", "h", "pos", "n", "host", "verdict", "fold", "x", "codes")


def _clash(df):
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def messy_dir(spark, tmp_path_factory):
    """The smallest tables with further rows: nulls, empty and long texts, repeated rows; and with clashing columns."""
    at = str(tmp_path_factory.mktemp("messy"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(k, t, None if (k or 0) % 2 else "en", None, None) for k, t in MESSY]
    _clash(docs.union(spark.createDataFrame(rows, docs.schema))).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    _clash(labels.union(spark.createDataFrame([(None, 1, 1), (900004, None, None), (900005, 0, 0)], labels.schema))).write.parquet(f"{at}/labels.parquet")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    _clash(bench.union(spark.createDataFrame([(901, None), (902, ""), (903, "tiny"), (904, "a row without")], bench.schema))).write.parquet(f"{at}/benchmark.parquet")
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    _clash(pages.union(spark.createDataFrame([(k, u, None) for k, u in MESSY_URLS], pages.schema))).repartition(3).write.parquet(f"{at}/pages.parquet")
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    more = spark.createDataFrame([(k, v, c) for k, c, v in MESSY_VECTORS], vectors.schema)
    _clash(vectors.union(more)).repartition(3).write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    return at


@pytest.fixture(scope="session")
def texts(spark, messy_dir):
    """(id, text) of the messy table; null is the empty text."""
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{messy_dir}/documents.parquet").select("doc_id", "text").collect()]
