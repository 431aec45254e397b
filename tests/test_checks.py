"""Named checks as table functions."""

from prismspark.operators import checks


def test_every_check_gives_a_row(spark):
    checks.register(spark)
    spark.createDataFrame([(1, [1.0, 3.0]), (2, []), (3, None), (4, [None, 2.0])], "id INT, levels ARRAY<DOUBLE>").createOrReplaceTempView("checked")
    rows = spark.sql("SELECT t.id, c.* FROM checked t, LATERAL cross_check(array('mean', 'largest', 'nobody', 'math:fsum', 'math:nothing', 'no.module:f', NULL), t.levels) c").collect()
    found = {(r.id, r.feature): (r.status, r.value) for r in rows}
    assert len(rows) == 18 and found[1, "mean"] == ("success", 2.0) and found[1, "math:fsum"] == ("success", 4.0)
    assert {found[1, f][0] for f in ("math:nothing", "no.module:f")} == {"unavailable"} and found[1, "nobody"] == ("unsupported", None)
    assert found[2, "largest"][0] == "error" and found[2, "mean"] == ("error", None) and found[4, "mean"] == ("error", None)
    assert all(r.reason for r in rows if r.status in ("error", "unavailable"))


def test_status_table(spark):
    found = {r.feature: (r.kind, r.available) for r in checks.status(spark, ["math:fsum", "it's\\:f", "nobody"]).collect()}
    assert found["math:fsum"] == ("external", True) and found["nobody"] == ("external", False) and found["it's\\:f"] == ("external", False)
    assert all(found[name] == ("built_in", True) for name in checks.BUILT_IN) and len(checks.status(spark).collect()) == len(checks.BUILT_IN)
