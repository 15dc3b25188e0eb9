"""Queries over definitions, rules, warehouses and the artifacts of a run, each with the rows that must come out.

Documents of a run (rules, datasets, plans) are files of the driver; tables are in the shared folder. Parts that read no
table are held against fixed values in tests/test_parts.py."""

from __future__ import annotations

import contextlib
import io
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.catalog import CUSTOMER, SEED, customers, gap_rule, generated, house, query, t
from seedloom.errors import ConfigError, LedgerConflict
from seedloom.functions import generators
from seedloom.operators import audit, corrupt, dashboard, repair
from seedloom.shared import shared_dir
from seedloom.sources import artifacts as A
from seedloom.sources import gaprules
from seedloom.sources.csvsink import CsvSink
from seedloom.sources.datasets import DatasetStore
from seedloom.sources.ddl import parse_single
from seedloom.sources.rules import ColumnRule, Evaluation, Expectation
from seedloom.sources.warehouse import LEDGER_NAME, TableSink, sample

KINDS = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE"}


def expected(schema: str, rows: list[tuple]) -> str:
    literal = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    columns = [c.split() for c in schema.split(", ")]
    head = ", ".join(f'CAST("{c}" AS {KINDS[k]}) AS "{c}"' for c, k in columns)
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT {head} FROM (VALUES {values}) v({', '.join(chr(34) + c + chr(34) for c, _ in columns)})"


def fixed(schema: str, rows: list[tuple]) -> Callable:
    """Registers a function that returns rows; they have to be the given ones."""

    def add(f: Callable[[SparkSession, str], list[tuple]]) -> Callable:
        query(expected(schema, rows), f.__name__)(lambda spark, sf_dir: spark.createDataFrame(f(spark, sf_dir), schema))
        return f

    return add


def refuses(*errors: type[Exception]) -> Callable[[Callable[[], object]], bool]:
    def test(call: Callable[[], object]) -> bool:
        try:
            call()
        except errors:
            return True
        return False

    return test


faulty = refuses(ConfigError)

RULE = "rules:\n  - {id: A, table: dbo.customer, key: c_custkey, column: c_mktsegment, kind: ephemeral, gap: c_acctbal < 0, fix: lorem.word, threshold: 5, reason: because}\n"


# Generation plans -------------------------------------------------------------------------------------------------------


@query("SELECT k, CAST(10 + 5 * (k - 1) AS INTEGER) AS KindId, CAST('x' AS VARCHAR) AS Code, CAST(NULL AS DECIMAL(12,2)) AS Price FROM (SELECT unnest(range(1, (SELECT count(*) FROM nation) + 1)) AS k)")
def gen_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identity counts on from its seed; a column that the database would fill stays null."""
    ddl = "CREATE TABLE dbo.S (KindId INT IDENTITY(10,5) NOT NULL PRIMARY KEY, Code CHAR(3) NOT NULL, Price DECIMAL(12,2) NULL DEFAULT (0), Stamp ROWVERSION)"
    return generated(spark, ddl, t(spark, sf_dir, "nation").count(), {"Code": ColumnRule("constant", value="x"), "Price": ColumnRule("dbDefault")})


# Warehouses and sinks ---------------------------------------------------------------------------------------------------

NATION = "CREATE TABLE dbo.nation (n_nationkey INT NOT NULL PRIMARY KEY, n_name VARCHAR(30), n_regionkey INT)"


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT 'appended' AS step, n_nationkey, n_name FROM nation, range(3) UNION ALL SELECT 'replaced', n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def sink_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink creates its table, appends to it twice, and replaces its rows."""
    w, rows = house(spark, CUSTOMER), nations(spark, sf_dir)
    sink = TableSink(w, parse_single(NATION))
    for _ in range(3):
        sink.load(rows)
    before = w.table("nation").select(F.lit("appended").alias("step"), "n_nationkey", "n_name")
    sink.load(rows.filter("n_regionkey = 1"), truncate=True)
    return before.unionByName(w.table("dbo.NATION").select(F.lit("replaced").alias("step"), "n_nationkey", "n_name"))


@query("""SELECT 'k,name,flag,bytes' AS line UNION ALL
SELECT n_nationkey || ',"a ""' || n_name || '"", b",' || CASE WHEN n_regionkey = 1 THEN '' WHEN n_regionkey > 1 THEN '1' ELSE '0' END || ',0x' || hex(encode(n_name)) FROM nation""")
def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a single CSV file: quotes doubled, bits as 1 and 0, NULL as nothing, bytes in hexadecimal."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.csv"
    frame = nations(spark, sf_dir).select(F.col("n_nationkey").alias("k"), F.concat(F.lit('a "'), "n_name", F.lit('", b')).alias("name"), F.when(F.col("n_regionkey") != 1, F.col("n_regionkey") > 1).alias("flag"), F.col("n_name").cast("binary").alias("bytes"))
    CsvSink(path, single=True).load(frame)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("""SELECT 0 AS place, 'n_nationkey | n_name | zone' AS line UNION ALL
SELECT row_number() OVER (ORDER BY n_nationkey), n_nationkey || ' | ' || n_name || ' | NULL' FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 5)""")
def sample_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows as text: the sample of a dry run."""
    frame = nations(spark, sf_dir).select(F.col("n_nationkey").alias("k"), "n_nationkey", "n_name", F.lit(None).cast("string").alias("zone"))
    return spark.createDataFrame(list(enumerate(sample(frame, "k"))), "place long, line string")


@query("SELECT CAST(c_custkey AS BIGINT) AS k, c_mktsegment || '-' || CAST(c_custkey AS VARCHAR) AS label, CAST(c_custkey * 2 + 1 AS BIGINT) AS twice, CAST(c_custkey // 7 AS BIGINT) AS part FROM customer")
def computed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed columns of a table, as queries see them."""
    ddl = "CREATE TABLE dbo.customer (c_custkey BIGINT NOT NULL PRIMARY KEY, c_mktsegment VARCHAR(20), label AS (c_mktsegment + N'-' + CONVERT(VARCHAR(9), c_custkey)), twice AS (c_custkey * 2 + 1), part AS (c_custkey / 7))"
    return house(spark, ddl, customer=t(spark, sf_dir, "customer")).sql("SELECT c_custkey AS k, label, CAST(twice AS BIGINT) AS twice, part FROM dbo.customer")


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber // 2 AS DOUBLE) AS half, l_quantity / 2 AS quantity, CAST(l_linenumber * 7 // 3 // 2 AS DOUBLE) AS chain, CAST((l_linenumber + 1) // CASE WHEN l_linenumber > 3 THEN 2 ELSE 3 END AS DOUBLE) AS cased FROM lineitem")
def eval_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divisions of whole numbers cut off, others don't."""
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"))
    lines.createOrReplaceTempView("eval__division")
    from seedloom.plans.dialect import translate_sql

    tsql = "SELECT l_orderkey, l_linenumber, l_linenumber / 2 AS half, l_quantity / 2 AS quantity, l_linenumber * 7 / 3 / 2 AS chain, (l_linenumber + 1) / CASE WHEN l_linenumber > 3 THEN 2 ELSE 3 END AS cased FROM dbo.lineitem"
    return spark.sql(translate_sql(tsql, {"dbo.lineitem": "eval__division"}))


@query("SELECT o_orderkey AS k, length(o_orderpriority) + 36 AS n, o_orderdate < CAST(now() AS TIMESTAMP) AS past FROM orders")
def eval_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's priority with a new id behind it, and whether its date has passed."""
    w = house(spark, "CREATE TABLE dbo.orders (o_orderkey BIGINT NOT NULL, o_orderpriority VARCHAR(20), o_orderdate DATETIME2)", orders=t(spark, sf_dir, "orders"))
    return w.sql("SELECT o_orderkey AS k, LEN(o_orderpriority + '' + NEWID()) AS n, o_orderdate < GETDATE() AS past FROM dbo.orders")


# The ledger and damage --------------------------------------------------------------------------------------------------


def entries(frame: DataFrame, value: str) -> DataFrame:
    return frame.select(F.lit("dbo.nation").alias("TargetTable"), F.col("n_nationkey").cast("string").alias("RowKey"), F.lit("code").alias("ColumnName"), F.expr(value).alias("Value"), F.lit("R").alias("RuleId"), F.current_timestamp().alias("CreatedAt"), F.lit("x").alias("CreatedBy"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, 'v' || n_nationkey AS value FROM nation WHERE n_regionkey <> 2")
def ledger_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of entries for all nations those that the ledger doesn't have."""
    w, rows = house(spark, NATION), nations(spark, sf_dir)
    w.publish(w.manifest(), {LEDGER_NAME: [w.stage(LEDGER_NAME, entries(rows.filter("n_regionkey = 2"), "'v' || n_nationkey"))]})
    return w.with_entries(entries(rows, "'v' || n_nationkey")).select(F.col("RowKey").alias("key"), F.col("Value").alias("value"))


@fixed("case string, refused boolean", [("same again", False), ("another value", True), ("a value twice", True)])
def ledger_conflicts(spark: SparkSession, sf_dir: str) -> list[tuple]:
    w, rows = house(spark, NATION), nations(spark, sf_dir)
    w.publish(w.manifest(), {LEDGER_NAME: [w.stage(LEDGER_NAME, entries(rows, "'v' || n_nationkey"))]})
    cases = {"same again": entries(rows, "'v' || n_nationkey"), "another value": entries(rows, "'w' || n_nationkey"), "a value twice": entries(rows.withColumn("n_nationkey", F.col("n_nationkey") + 1000), "'v' || (n_nationkey - 1000)")}
    return [(name, refuses(LedgerConflict)(lambda: w.with_entries(frame))) for name, frame in cases.items()]  # noqa: B023


@query("""SELECT n_nationkey, CASE WHEN k <= 3 THEN NULL ELSE n_name END AS n_name FROM (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation)
UNION ALL SELECT 9999, 'Nowhere'""")
def corrupt_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three names go, a row is added; one that is there already isn't."""
    w = house(spark, NATION, nation=nations(spark, sf_dir))
    keys = corrupt.first_keys(w, "dbo.nation", "n_nationkey", "n_name IS NOT NULL", 3)
    corrupt.corrupt(w, {("dbo.nation", "n_nationkey"): [(k, "n_name", None) for k in keys]}, {"dbo.nation": [{"n_nationkey": 9999, "n_name": "Nowhere"}, {"n_nationkey": keys[0], "n_name": "again"}]})
    return w.table("dbo.nation").select("n_nationkey", "n_name")


# A run and its artifacts ------------------------------------------------------------------------------------------------

_RULES = gaprules.GapRules((gap_rule("S1", "c_acctbal < 0 AND c_mktsegment = 'BUILDING'", fix="finance.currencyCode", invariant="NOT (c_acctbal < 0 AND c_mktsegment = 'BUILDING')"),), DatasetStore())
_CHECKS = [Evaluation("debtors", "SELECT COUNT(*) FROM dbo.customer WHERE c_acctbal < 0 AND c_mktsegment = 'BUILDING'", Expectation(equals="0")), Evaluation("rows", "SELECT COUNT(*) FROM dbo.customer", Expectation(min="0"))]
_N = "(SELECT count(*) FROM customer WHERE c_acctbal < 0 AND c_mktsegment = 'BUILDING')"


@query(f"""SELECT 'invariant' AS layer, 'S1.invariant' AS name, {_N} = 0 AS passed, CASE WHEN {_N} > 0 THEN 'expected 0, got ' || {_N} END AS detail
UNION ALL SELECT 'consumer', 'debtors', {_N} = 0, CASE WHEN {_N} > 0 THEN 'expected 0, got ' || {_N} END UNION ALL SELECT 'consumer', 'rows', true, NULL""")
def baseline_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants and consumer checks before a change."""
    doc = repair.baseline(customers(spark, sf_dir), _RULES, _CHECKS, "r")
    return spark.createDataFrame([("invariant", x["name"], x["passed"], x["detail"]) for x in doc["invariants"]] + [("consumer", x["name"], x["passed"], x["detail"]) for x in doc["consumer"]], "layer string, name string, passed boolean, detail string")


@query(f"""SELECT * FROM (VALUES ('planned', CAST({_N} AS VARCHAR)), ('patched', CAST({_N} AS VARCHAR)), ('bad after', '0'), ('l1', 'true'), ('l2', 'true'), ('l3', 'true'), ('approved hash holds', 'true'),
('facts', CAST({_N} AS VARCHAR)), ('report passes', 'pass'), ('exit', '0'), ('sections', 'Approval,Patches,Plan,Verification')) v(what, value)""")
def run_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan, approve, apply, verify and report in one go."""
    w = customers(spark, sf_dir)
    with tempfile.TemporaryDirectory() as d:
        doc = repair.run(w, _RULES, d, _CHECKS, SEED, "0" * 64, "a@example.test", approved=True)
        text = (Path(d) / "report.md").read_text("utf-8"), (Path(d) / "facts.json").read_text("utf-8")
        held = A.sha256(Path(d) / "plan.json") == doc["approval"]["sha256"]
        page = dashboard.page(d)
    bad = w.table("dbo.customer").filter("c_acctbal < 0 AND c_mktsegment = 'BUILDING'").count()
    found = doc["verify"]
    rows = [("planned", doc["plan"]["rules"][0]["patches"]), ("patched", doc["log"].count()), ("bad after", bad), *[(k, str(found[k]).lower()) for k in ("l1", "l2", "l3")], ("approved hash holds", str(held).lower()), ("facts", doc["facts"]["rules"][0]["patched"]),
            ("report passes", audit.verdict(audit.audit_report(*text, doc["facts"]))["verdict"]), ("exit", repair.exit_code(found)), ("sections", ",".join(sorted(x.split("</h2>")[0] for x in page.split("<h2>")[1:])))]
    return spark.createDataFrame([(k, str(v)) for k, v in rows], "what string, value string")


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_acctbal, c_mktsegment AS before, CASE WHEN c_acctbal < 0 AND c_mktsegment = 'BUILDING' THEN list_extract([" + ", ".join(repr(c) for c in generators.faker.CURRENCIES) + f"], CAST(CAST('0x' || substr(md5('{SEED}|dbo.customer|s1|' || c_custkey || '|1|0'), 1, 8) AS BIGINT) % {len(generators.faker.CURRENCIES)} + 1 AS INTEGER)) ELSE c_mktsegment END AS after FROM customer")
def apply_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer before and after an approved plan, and after it was taken back."""
    w = customers(spark, sf_dir)
    before = w.table("dbo.customer")
    with tempfile.TemporaryDirectory() as d:
        log = repair.run(w, _RULES, d, (), SEED, "", "a@example.test", approved=True)["log"]
    after = w.table("dbo.customer").select("c_custkey", F.col("c_mktsegment").alias("after"))
    repair.revert(w, _RULES, log)
    back = w.table("dbo.customer").select("c_custkey", F.col("c_mktsegment").alias("before"))
    return before.select("c_custkey", "c_acctbal").join(back, "c_custkey").join(after, "c_custkey")


@fixed("case string, refused boolean", [("approved", False), ("changed since", True), ("blocked", True)])
def apply_gates(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """A plan that was changed after its approval isn't applied, one beyond its threshold isn't approved."""
    w, out = customers(spark, sf_dir), []
    blocked = gaprules.GapRules((gap_rule("S2", "c_custkey > 0", threshold=1),), DatasetStore())
    with tempfile.TemporaryDirectory() as d:
        A.write_json(Path(d) / "plan.json", repair.plan(w, _RULES, SEED))
        repair.approve(d, "a@example.test")
        out.append(("approved", faulty(lambda: repair.apply(w, _RULES, d))))
        A.write_json(Path(d) / "plan.json", A.read_json(Path(d) / "plan.json") | {"runId": "other"})
        out.append(("changed since", faulty(lambda: repair.apply(w, _RULES, d))))
        A.write_json(Path(d) / "plan.json", repair.plan(w, blocked, SEED))
        out.append(("blocked", faulty(lambda: repair.approve(d, "a@example.test"))))
    return out


@fixed("case string, finding string", [("drift", "facts-drift"), ("drift", "plan-hash"), ("drift", "rules-drift"), ("missing", "missing-artifact")])
def notary_findings(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """Artifacts that fit, that were changed, and that are gone."""
    w, out = customers(spark, sf_dir), []
    with tempfile.TemporaryDirectory() as d:
        f = Path(d)
        (f / "gaps.yaml").write_text(RULE)
        repair.run(w, _RULES, f, (), SEED, A.sha256(f / "gaps.yaml"), "a@example.test", approved=True)
        out += [("fits", v["kind"]) for v in audit.notary(f, f / "gaps.yaml")["violations"]]
        (f / "gaps.yaml").write_text(RULE + "# changed\n")
        A.write_json(f / "plan.json", A.read_json(f / "plan.json") | {"runId": "other"})
        out += sorted({("drift", v["kind"]) for v in audit.notary(f, f / "gaps.yaml")["violations"]})
        (f / "verify.json").unlink()
        out += [("missing", v["kind"]) for v in audit.notary(f, f / "gaps.yaml")["violations"]]
    return out


@fixed("command string, code int", [("lint of good rules", 0), ("lint of bad rules", 2), ("generators", 0), ("dry run", 0), ("no such rules", 2), ("not on the allowlist", 4), ("failing evaluation", 40)])
def cli_codes(spark: SparkSession, sf_dir: str) -> list[tuple]:
    from seedloom import cli

    root = house(spark, NATION, nation=nations(spark, sf_dir)).root
    with tempfile.TemporaryDirectory() as d:
        f = Path(d)
        (f / "good.yaml").write_text(RULE)
        (f / "bad.yaml").write_text(RULE.replace("ephemeral", "odd"))
        (f / "t.sql").write_text("CREATE TABLE dbo.T (Id INT IDENTITY PRIMARY KEY, Name NVARCHAR(40) NOT NULL)")
        (f / "r.yaml").write_text("rows: 3\ncolumns:\n  Name: {strategy: constant, value: x}\nevaluations:\n  - {name: n, query: SELECT COUNT(*) FROM dbo.nation, expect: {equals: -1}}\n")
        (f / "allow.json").write_text('["/elsewhere"]')
        commands = {
            "lint of good rules": ["patch", "lint", "--rules", f"{f}/good.yaml"], "lint of bad rules": ["patch", "lint", "--rules", f"{f}/bad.yaml"], "generators": ["patch", "generators"],
            "dry run": ["generate", "--ddl", f"{f}/t.sql", "--rules", f"{f}/r.yaml", "--dry-run"], "no such rules": ["evaluate", "--rules", f"{f}/none.yaml", "--warehouse", root],
            "not on the allowlist": ["patch", "survey", "--rules", f"{f}/good.yaml", "--warehouse", root, "--allowlist", f"{f}/allow.json"], "failing evaluation": ["evaluate", "--rules", f"{f}/r.yaml", "--warehouse", root],
        }
        out = []
        for name, argv in commands.items():
            with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
                out.append((name, cli.main(argv)))
    return out


