"""Values set by hand and kept answers."""

import pytest
from pyspark.sql import functions as F

from plumbline.plans.commands import anchors_of, assign, decide
from plumbline.sources import answers

from .test_georeference import HEIGHT, WIDTH, sheet


@pytest.fixture(scope="module")
def tables(spark):
    sheets = {1: (sheet(1, 1.3)[0], []), 2: sheet(2), 3: sheet(3, 0.6), 4: sheet(4)}
    maps = spark.createDataFrame([(k, WIDTH, HEIGHT, None) for k in sheets], "map_id long, width int, height int, dpi double")
    items = spark.createDataFrame([i for s in sheets.values() for i in s[1]], "map_id long, seq int, text string, x0 double, y0 double, x1 double, y1 double")
    lines = spark.createDataFrame([x for s in sheets.values() for x in s[0]], "map_id long, axis string, line_no int, slope double, intercept double")
    return maps, items, lines


COMMANDS = [
    # map 1 has no text: two lines of each family define its grid; a later command replaces an earlier one
    (1, 0, "V2", "999"), (1, 1, "V2", "320 000"), (1, 2, "V3", "321000"), (1, 3, "H1", "8651000"), (1, 4, "H4", "8 648 000 m N"), (1, 5, "step y", "1000"),
    # map 2: its labels are overruled on x, a line is excluded on y
    (2, 0, "V1", "519000"), (2, 1, "V2", "520000"), (2, 2, "H2", "none"),
    # map 3: one value by hand is a label more; what cannot be read is passed over
    (3, 0, "V4", "322000"), (3, 1, "V5", "no number"), (3, 2, "Q7", "1"),
]


def test_last_command_counts(spark):
    got = {tuple(r) for r in anchors_of(spark.createDataFrame(COMMANDS, "map_id long, seq int, line string, value string")).collect()}
    assert (1, "x", 2, "utm", 320000.0) in got and (2, "y", 2, None, None) in got and (1, "y", 4, "utm", 8648000.0) in got
    assert len(got) == 8 and not [g for g in got if g[0] == 3 and g[2] != 4]


def test_grid_follows_from_values(spark, tables):
    result = assign(*tables, spark.createDataFrame(COMMANDS, "map_id long, seq int, line string, value string"))
    values = {(r.map_id, r.axis, r.line_no): r.value for r in result.values.collect()}
    numbers = {(k, a): [r.line_no for r in tables[2].filter(f"map_id = {k} and axis = '{a}'").collect()] for k in (1, 2, 3) for a in "xy"}
    for (k, axis), found in numbers.items():
        for n in found:
            want = {(1, "x"): 318000 + 1000 * n, (1, "y"): 8652000 - 1000 * n, (2, "x"): 518000 + 1000 * n, (2, "y"): 8652000 - 1000 * n if n != 2 else None}
            assert values.get((k, axis, n)) == want.get((k, axis), 318000 + 1000 * n if axis == "x" else 8652000 - 1000 * n), (k, axis, n)
    assert {r.map_id for r in result.status.collect()} == {1, 2, 3}
    assert all(r.rmse < 0.5 for r in result.status.filter("map_id in (1, 2, 3)").collect())
    assert result.gcps.filter("map_id = 2 and gcp_id like '%H2'").count() == 0


def test_systems_and_results(spark, tables):
    """The last valid system and result of each map count; an ok needs passed checks; what is refused says why."""
    rows = [
        (2, 0, "set_crs", 32718, "first reading", None, None), (2, 1, "set_crs", 24878, "legend: PSAD56, zone 18", None, None), (2, 2, "submit_result", 24878, None, "needs_review", 1.7),
        (3, 0, "set_crs", 99999, "no such code", None, None), (3, 1, "set_crs", 24878, "  ", None, None), (3, 2, "submit_result", 24878, None, "needs_review", 0.2),
        (4, 0, "set_crs", 4326, "degrees", None, None), (4, 1, "submit_result", 0, None, "ok", None), (4, 2, "submit_result", 0, None, "fine", 0.5), (4, 3, "redraw", None, None, None, None),
        (1, 0, "submit_result", 32718, None, "failed", -3.0), (None, 0, "set_crs", 32718, "no map", None, None),
    ]
    commands = spark.createDataFrame(rows, "map_id long, seq int, command string, epsg int, evidence string, status string, confidence double")
    plain = {r.map_id: r for r in decide(*tables, commands.withColumn("command", F.lit("none")))[0].status.collect()}
    result, refused = decide(*tables, commands)
    got = {r.map_id: r for r in result.status.collect()}
    assert set(got) == set(plain) == {1, 2, 3, 4}
    assert (got[2].epsg, got[2].status, got[2].confidence) == (24878, "needs_review", 1.0) and plain[2].epsg != 24878
    assert tuple(got[3]) == tuple(plain[3]) and plain[3].status == "ok"
    assert got[4].epsg == 4326 and got[4].status == "needs_review"
    assert (got[1].status, got[1].confidence) == ("failed", 0.0)
    assert {(r.map_id, r.seq): r.reason for r in refused.collect()} == {(3, 0): "unknown system", (3, 1): "no evidence", (3, 2): "another system", (4, 2): "unknown result", (4, 3): "unknown command"}
    assert result.gcps.filter("map_id = 2").select("epsg").distinct().collect()[0].epsg == 24878


def test_kept_answers(spark, tmp_path):
    folder, calls = str(tmp_path / "store"), []

    def ask(missing):
        calls.append(sorted(r.key for r in missing.select("key").collect()))
        return missing.select("key", F.concat(F.lit("read "), "what").alias("answer"))

    asked = spark.createDataFrame([("a",), ("b",), ("a",), ("c",)], "what string").withColumn("key", answers.key_of(F.lit("service"), F.col("what")))
    asked = asked.unionByName(spark.createDataFrame([("x", None)], "what string, key string"))
    for _ in range(2):
        got = sorted((r.what, r.answer) for r in answers.answered(asked, folder, ask).collect())
        assert got == [("a", "read a"), ("a", "read a"), ("b", "read b"), ("c", "read c"), ("x", None)]
    assert [len(c) for c in calls] == [3, 0]
    # the same answers again, as a retry gives them: still one row a key
    answers.store(ask(asked.filter("key is not null")), folder)
    assert spark.read.parquet(folder).count() == 3 and answers.stored(spark, folder).count() == 3
    # a spoilt row counts as a miss and is answered anew
    spoilt = str(tmp_path / "spoilt")
    spark.read.parquet(folder).withColumn("answer", F.when(F.col("answer") == "read b", "torn").otherwise(F.col("answer"))).write.parquet(spoilt)
    assert {r.what: r.answer for r in answers.lookup(asked, spoilt).collect()}["b"] is None
    assert {r.what: r.answer for r in answers.answered(asked, spoilt, ask).collect()}["b"] == "read b"
    (next((tmp_path / "store").glob("*.parquet"))).write_bytes(b"not parquet")
    assert {r.what: r.answer for r in answers.answered(asked, folder, ask).collect()}["c"] == "read c"
