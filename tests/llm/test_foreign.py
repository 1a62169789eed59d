"""The language stage rejects texts in no learned language and keeps the others."""

from pyspark.sql import functions as F

import corpus_pipeline

from .conftest import DATA

FOREIGN = {
    "cyrillic": "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "short cyrillic": "Да",
    "greek": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
    "han": "人人生而自由,在尊嚴和權利上一律平等。",
    "polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "finnish": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "turkish": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    "mostly cyrillic": "The and of. " + "Все люди рождаются свободными и равными в своем достоинстве. " * 3,
}


def test_rejection(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    halves = {r.lang: r.text for r in docs.filter("n_chars > 400").orderBy("doc_id").collect()}
    mixed = " ".join(halves[k][:300] for k in sorted(halves))
    token = f'token = "{"40d78a45c418324758e099eb7cb89bc0f5fa9f62" * 3}" ' + halves["en"][:40]
    rows = [(-1 - k, t, None, None, None) for k, t in enumerate([*FOREIGN.values(), mixed, token])]
    more = docs.union(spark.createDataFrame(rows, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, more, DATA).collect()}
    clean = {r.doc_id for r in docs.filter(F.col("text").rlike("[A-Za-z]")).collect()}
    assert len(halves) == 4 and clean <= kept
    assert [n for k, n in enumerate(FOREIGN) if -1 - k in kept] == [] and {-1 - len(FOREIGN), -2 - len(FOREIGN)} <= kept
