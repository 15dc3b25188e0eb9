"""Checks of one table are asked together, with the results that they have alone."""

import datetime as dt

import pytest

from seedloom.operators import evaluate
from seedloom.plans import fuse
from seedloom.plans.dialect import translate_sql
from seedloom.sources.rules import Evaluation, Expectation

CHECKS = [
    "SELECT COUNT(*) FROM dbo.t", "SELECT COUNT(*) AS n FROM [dbo].[t] WHERE a IS NULL", "SELECT COUNT(a) - COUNT(DISTINCT a) FROM dbo.t", "SELECT COUNT(DISTINCT b) n FROM DBO.T WHERE a > 2 AND b <> 'x'", "SELECT SUM(a) FROM dbo.t WHERE a > 1000",
    "SELECT CAST(SUM(CASE WHEN a > 1 THEN 1.0 ELSE 0.0 END)/COUNT(*) AS FLOAT) FROM dbo.t WHERE b IN ('x', 'y') OR a IS NULL", "SELECT MAX(b), MIN(a) FROM dbo.t WHERE a / 2 = 1", "SELECT AVG(a) + MAX(a) * 2 FROM dbo.t;", "SELECT MIN(d) FROM dbo.t WHERE d >= '2024-01-02'",
]
OTHERS = [
    "SELECT a FROM dbo.t ORDER BY a", "SELECT COUNT(*) FROM dbo.t x JOIN dbo.t y ON x.a = y.a", "SELECT TOP 1 b FROM dbo.t", "SELECT COUNT(*) FROM (SELECT a FROM dbo.t GROUP BY a) d", "SELECT COUNT(*) FROM dbo.t WHERE a IN (SELECT a FROM dbo.t)", "SELECT 1", "SELECT nope FROM dbo.t",
    "SELECT COUNT(nope) FROM dbo.t", "SELECT COUNT(*) FROM", "SELECT", "",
]


@pytest.fixture(scope="module")
def sql(spark):
    rows = [(k % 5 or None, "xyz"[k % 3] if k % 7 else None, dt.datetime(2024, 1, 1 + k % 9)) for k in range(60)]
    spark.createDataFrame(rows, "a int, b string, d timestamp_ntz").createOrReplaceTempView("fuse__t")
    asked = []

    def run(query):
        asked.append(query)
        return spark.sql(translate_sql(query, {"dbo.t": "fuse__t"}))

    run.asked = asked
    return run


def test_fused_results_are_those_of_each_alone(sql):
    checks = [Evaluation(str(k), q, Expectation(min="0")) for k, q in enumerate(CHECKS + OTHERS)]
    alone = [evaluate.alone(e, sql, 60.0) for e in checks]
    assert [fuse.part(q) is not None for q in CHECKS] == [True] * len(CHECKS) and all(fuse.part(q) is None for q in OTHERS if "nope" not in q or "COUNT" not in q)
    sql.asked.clear()
    good = [e for e in checks if "COUNT(nope)" not in e.query]
    assert evaluate.run(good, sql) == [r for r, e in zip(alone, checks, strict=True) if e in good]
    # One query for all of them, the others one each.
    assert len(sql.asked) == 1 + len(good) - len(CHECKS)
    plan = sql(fuse.fused([fuse.part(q) for q in CHECKS]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("Relation") == 1


def test_a_failing_check_fails_alone(sql):
    checks = [Evaluation(str(k), q, Expectation(min="0")) for k, q in enumerate([*CHECKS, "SELECT COUNT(nope) FROM dbo.t"])]
    got = evaluate.run(checks, sql)
    assert got == [evaluate.alone(e, sql, 60.0) for e in checks] and [bool(r.error and "query failed" in r.error) for r in got] == [False] * len(CHECKS) + [True]


def test_conditions_go_into_aggregates():
    assert fuse.part("SELECT COUNT(*) FROM t WHERE a = 1").expression == "COUNT(CASE WHEN a = 1 THEN 1 END)"
    assert fuse.part("SELECT COUNT(DISTINCT [x y]) FROM t WHERE a = ')'").expression == "COUNT(DISTINCT CASE WHEN a = ')' THEN [x y] END)"
    assert fuse.part("SELECT SUM(a)/COUNT(*) FROM t").expression == "SUM(a)/COUNT(*)"
