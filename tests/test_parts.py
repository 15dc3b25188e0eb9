"""Definitions, rules, datasets, predicates and artifacts: parts that read no table, each with what must come out."""

import contextlib
import io
import json
import tempfile
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.catalog import house
from seedloom.catalog_parts import RULE, faulty, refuses
from seedloom.errors import AllowlistError, SeedloomError
from seedloom.functions import generators
from seedloom.operators import audit, evaluate, lint, rest
from seedloom.plans import genplan, infer
from seedloom.plans.dialect import check_predicate
from seedloom.sources import artifacts as A
from seedloom.sources import gaprules
from seedloom.sources import rules as R
from seedloom.sources.datasets import DatasetStore, from_mapping
from seedloom.sources.ddl import parse_script, parse_single
from seedloom.sources.rules import Evaluation, Expectation
from seedloom.sources.warehouse import guard

CASES = {}


def fixed(schema, rows):
    """The rows that a function must return; the schema names their columns."""

    def add(f):
        CASES[f.__name__] = f, rows
        return f

    return add


@pytest.mark.parametrize("name", [
    "ddl_columns",
    "ddl_constraints",
    "ddl_choices",
    "inferred_rules",
    "scaffold_checks",
    "rules_checks",
    "dataset_folder",
    "dataset_checks",
    "gaprule_checks",
    "predicate_checks",
    "only_rules",
    "generator_keys",
    "lint_findings",
    "plan_columns",
    "plan_warnings",
    "warehouse_tables",
    "allowlist_checks",
    "report_audit",
    "rest_calls",
    "eval_time_limit",
])
def test_part(spark, name):
    f, rows = CASES[name]
    assert Counter(map(repr, f(spark, ""))) == Counter(map(repr, rows))


KINDS_DDL = """
CREATE TABLE dbo.Kinds (KindId INT IDENTITY(10,5) NOT NULL PRIMARY KEY, Code CHAR(3) NOT NULL UNIQUE, Price DECIMAL(12,2) NULL DEFAULT (0) CHECK (Price >= 0), Email NVARCHAR(120) NULL, BornOn DATE NOT NULL);
GO
CREATE TABLE [sales].[Item List] (ItemId BIGINT NOT NULL, KindId INT NOT NULL REFERENCES dbo.Kinds(KindId), Note NVARCHAR(MAX) NULL, Total AS (KindId + 1), Stamp ROWVERSION,
    Amount DECIMAL(8,3) NOT NULL, CONSTRAINT PK_I PRIMARY KEY (ItemId), CONSTRAINT CK_A CHECK (Amount < 100));
"""


@fixed("table string, column string, kind string, length int, precision int, scale int, nullable boolean, identity string, computed boolean, key boolean, uniq boolean", [
    ("dbo.Kinds", "KindId", "int", None, None, None, False, "10,5", False, True, False), ("dbo.Kinds", "Code", "char", 3, None, None, False, None, False, False, True), ("dbo.Kinds", "Price", "decimal", None, 12, 2, True, None, False, False, False),
    ("dbo.Kinds", "Email", "nvarchar", 120, None, None, True, None, False, False, False), ("dbo.Kinds", "BornOn", "date", None, None, None, False, None, False, False, False),
    ("sales.Item List", "ItemId", "bigint", None, None, None, False, None, False, True, False), ("sales.Item List", "KindId", "int", None, None, None, False, None, False, False, False), ("sales.Item List", "Note", "nvarchar", -1, None, None, True, None, False, False, False),
    ("sales.Item List", "Total", "", None, None, None, True, None, True, False, False), ("sales.Item List", "Stamp", "rowversion", None, None, None, True, None, False, False, False), ("sales.Item List", "Amount", "decimal", None, 8, 3, False, None, False, False, False),
])
def ddl_columns(spark: SparkSession, sf_dir: str) -> list[tuple]:
    return [(d.full_name, c.name, "" if c.computed else c.sql_type, c.length, c.precision, c.scale, c.nullable, ",".join(map(str, c.identity)) if c.identity else None, c.computed is not None, c.primary_key, c.unique) for d in parse_script(KINDS_DDL) for c in d.columns]


@fixed("table string, what string, detail string", [
    ("dbo.Kinds", "primary key", "KindId"), ("dbo.Kinds", "check", "Price >= 0"), ("sales.Item List", "primary key", "ItemId"), ("sales.Item List", "foreign key", "KindId to dbo.Kinds KindId"), ("sales.Item List", "check", "Amount < 100"),
])
def ddl_constraints(spark: SparkSession, sf_dir: str) -> list[tuple]:
    out = []
    for d in parse_script(KINDS_DDL):
        out.append((d.full_name, "primary key", ",".join(d.primary_key)))
        out += [(d.full_name, "foreign key", f"{','.join(f.columns)} to {f.table.replace('[', '').replace(']', '')} {','.join(f.referenced)}") for f in d.foreign_keys]
        out += [(d.full_name, "check", c.strip("() ")) for c in d.checks]
    return out


@fixed("case string, refused boolean", [("no table", True), ("two tables, none named", True), ("unknown table", True), ("unclosed", True), ("named in brackets", False), ("named in another case", False)])
def ddl_choices(spark: SparkSession, sf_dir: str) -> list[tuple]:
    cases = {
        "no table": ("SELECT 1", None), "two tables, none named": (KINDS_DDL, None), "unknown table": (KINDS_DDL, "Others"), "unclosed": ("CREATE TABLE T (A INT", None),
        "named in brackets": (KINDS_DDL, "[sales].[Item List]"), "named in another case": (KINDS_DDL, "KINDS"),
    }
    return [(name, faulty(lambda: parse_single(ddl, table))) for name, (ddl, table) in cases.items()]  # noqa: B023


@fixed("column string, strategy string, low string, high string, length int, method string, null_rate double, uniq boolean", [
    ("KindId", "skip", None, None, None, None, None, None), ("Code", "string", None, None, 3, None, None, True), ("Price", "decimal", "0", "999999", None, None, 0.1, None), ("Email", "faker", None, None, None, "internet.email", 0.1, None), ("BornOn", "date", "2020-01-01", "2025-12-31", None, None, None, None),
])
def inferred_rules(spark: SparkSession, sf_dir: str) -> list[tuple]:
    table = parse_single(KINDS_DDL, "Kinds")
    return [(c.name, r.strategy, r.min, r.max, r.length, r.method, r.null_rate, r.unique) for c in table.columns for r in [infer.infer(c, table)]]


_COUNT = "SELECT COUNT(*) FROM [dbo].[Kinds]"


@fixed("name string, query string, equals string", [
    ("row-count", _COUNT, "50"), ("KindId-not-null", f"{_COUNT} WHERE [KindId] IS NULL", "0"), ("Code-not-null", f"{_COUNT} WHERE [Code] IS NULL", "0"), ("BornOn-not-null", f"{_COUNT} WHERE [BornOn] IS NULL", "0"),
    ("KindId-unique", "SELECT COUNT([KindId]) - COUNT(DISTINCT [KindId]) FROM [dbo].[Kinds]", "0"), ("Code-unique", "SELECT COUNT([Code]) - COUNT(DISTINCT [Code]) FROM [dbo].[Kinds]", "0"),
])
def scaffold_checks(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """The evaluations of a scaffolded rules file, read back."""
    return [(e.name, e.query, e.expect.equals) for e in R.loads(infer.scaffold(parse_single(KINDS_DDL, "Kinds"), 50, 9)).evaluations]


@fixed("case string, refused boolean", [
    ("rows: 0", True), ("rows: 5", False), ("batchSize: -1", True), ("columns: {A: {strategy: int, nullRate: 1.5}}", True), ("columns: {A: {strategy: pick, values: [a, b], weights: [1]}}", True), ("columns: {A: {strategy: template}}", True),
    ("columns: {A: {strategy: constant, value: 007, other: x}}", False), ("evaluations: [{name: a, query: q}, {name: A, query: q}]", True), ("evaluations: [{name: a, query: q, expect: {equals: 1, min: 2}}]", True),
    ("evaluations: [{name: a, query: q, expect: {between: [1, 2]}}]", False), ("rows: [", True),
])
def rules_checks(spark: SparkSession, sf_dir: str) -> list[tuple]:
    cases = [
        "rows: 0", "rows: 5", "batchSize: -1", "columns: {A: {strategy: int, nullRate: 1.5}}", "columns: {A: {strategy: pick, values: [a, b], weights: [1]}}", "columns: {A: {strategy: template}}", "columns: {A: {strategy: constant, value: 007, other: x}}",
        "evaluations: [{name: a, query: q}, {name: A, query: q}]", "evaluations: [{name: a, query: q, expect: {equals: 1, min: 2}}]", "evaluations: [{name: a, query: q, expect: {between: [1, 2]}}]", "rows: [",
    ]
    return [(text, faulty(lambda: R.loads(text))) for text in cases]  # noqa: B023


@fixed("dataset string, place int, code string, name string", [("alpha", 0, "A", "first"), ("alpha", 1, "B", None), ("beta", 0, "007", "x")])
def dataset_folder(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """Files beside a rules file, by name; values are text as written."""
    with tempfile.TemporaryDirectory() as d:
        (Path(d) / "datasets").mkdir()
        (Path(d) / "datasets/beta.yaml").write_text("columns: [Code, Name]\nrows:\n  - [007, x]\n")
        (Path(d) / "datasets/alpha.yaml").write_text("columns: [Code, Name]\nrows:\n  - [A, first]\n  - [B, null]\nweights: [2, 1]\n")
        store = DatasetStore.beside(Path(d) / "rules.yaml")
    return [(s.name, k, row[s.index("code")], row[s.index("Name")]) for s in store.all for k, row in enumerate(s.rows)]


@fixed("case string, refused boolean", [("fine", False), ("short row", True), ("few weights", True), ("weight zero", True), ("match of no column", True), ("same names", True), ("no rows", True), ("dot in name", True)])
def dataset_checks(spark: SparkSession, sf_dir: str) -> list[tuple]:
    one = {"columns": ["A", "B"], "rows": [["1", "2"]]}
    cases = {"fine": one, "short row": one | {"rows": [["1"]]}, "few weights": one | {"weights": [1, 2]}, "weight zero": one | {"weights": [0]}, "match of no column": one | {"match": {"C": ["x"]}}, "same names": one | {"columns": ["A", "a"]}, "no rows": one | {"rows": []}}
    return [(name, faulty(lambda: from_mapping("d", doc))) for name, doc in cases.items()] + [("dot in name", faulty(lambda: from_mapping("a.b", one)))]  # noqa: B023


@fixed("case string, refused boolean", [("fine", False), ("threshold", True), ("kind", True), ("fix", True), ("derived fix", True), ("two statements", True), ("other table", True), ("no condition", True), ("reason", True), ("inputs", True)])
def gaprule_checks(spark: SparkSession, sf_dir: str) -> list[tuple]:
    cases = {
        "fine": ("", ""), "threshold": ("threshold: 5", "threshold: 0"), "kind": ("ephemeral", "odd"), "fix": ("lorem.word", "nope"), "derived fix": ("lorem.word", "security.bathroomsFromRooms"), "two statements": ("c_acctbal < 0", "'c_acctbal < 0; DROP TABLE x'"),
        "other table": ("c_acctbal < 0", "c_custkey IN (SELECT a FROM dbo.other)"), "no condition": ("c_acctbal < 0", "c_acctbal"), "reason": ("because", "''"), "inputs": ("reason", "inputs: [c_acctbal], reason"),
    }
    return [(name, faulty(lambda: gaprules.loads(RULE.replace(old, new) if old else RULE))) for name, (old, new) in cases.items()]  # noqa: B023


@fixed("case string, refused boolean", [
    ("a = 1 AND b IS NOT NULL", False), ("NOT (a BETWEEN 1 AND 2) OR b IN ('x', 'y')", False), ("a IN (SELECT a FROM dbo.t)", False), ("a IN (SELECT a FROM dbo.u)", True), ("a = 1; DELETE FROM t", True), ("a", True), ("a = 1 b", True), ("c = 1", True), ("xp_cmdshell('x') = 1", True),
])
def predicate_checks(spark: SparkSession, sf_dir: str) -> list[tuple]:
    schema = parse_single("CREATE TABLE dbo.t (a INT, b VARCHAR(9))").struct()
    cases = ["a = 1 AND b IS NOT NULL", "NOT (a BETWEEN 1 AND 2) OR b IN ('x', 'y')", "a IN (SELECT a FROM dbo.t)", "a IN (SELECT a FROM dbo.u)", "a = 1; DELETE FROM t", "a", "a = 1 b", "c = 1", "xp_cmdshell('x') = 1"]
    return [(text, faulty(lambda: check_predicate(text, "dbo.t", schema))) for text in cases]  # noqa: B023


@fixed("ids string, refused boolean", [("a", False), ("A,b", False), ("a,z", True)])
def only_rules(spark: SparkSession, sf_dir: str) -> list[tuple]:
    both = gaprules.loads(RULE + RULE.split("\n", 1)[1].replace("id: A", "id: B"))
    return [(ids, faulty(lambda: both.only(ids.split(",")))) for ids in ("a", "A,b", "a,z")]  # noqa: B023


@fixed("kind string, n long, sample string", [("random", 37, "address.city"), ("derived", 1, "security.bathroomsFromRooms")])
def generator_keys(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """34 vocabularies and three more; the first two keys by name are adventureworks.personId and address.city."""
    keys = generators.random_keys()
    return [("random", len(keys), min(k for k in keys if k.startswith("address"))), ("derived", len(generators.derived_keys()), generators.derived_keys()[0])]


@fixed("rule string, check string", [("A", "schema"), ("B", "threshold")])
def lint_findings(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """An unknown kind, and a threshold below what a survey counted."""
    with tempfile.TemporaryDirectory() as d:
        text = RULE.replace("ephemeral", "odd") + RULE.split("\n", 1)[1].replace("id: A", "id: B").replace("c_acctbal < 0", "c_mktsegment IS NULL")
        (Path(d) / "gaps.yaml").write_text(text)
        found = lint.lint(Path(d) / "gaps.yaml", {"tables": [{"table": "dbo.customer", "columns": [{"name": "c_mktsegment", "nulls": 9}]}]})["findings"]
    return [(f["rule"], f["check"]) for f in found]


@fixed("column string, strategy string, low string, high string, null_rate double, uniq boolean", [("Code", "string", None, None, None, True), ("Price", "decimal", "5", "999999", 0.1, None), ("Email", "constant", None, None, None, None)])
def plan_columns(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """auto takes the inferred rule under what is said; skip and dbDefault leave columns out; null rates of NOT NULL columns go."""
    rules = R.loads("rows: 5\ncolumns:\n  Price: {strategy: auto, min: 5}\n  Email: {strategy: constant, value: x}\n  BornOn: {strategy: dbDefault}\n  Code: {strategy: auto, nullRate: 0.5}\n")
    plan = genplan.build(parse_single(KINDS_DDL, "Kinds"), rules)
    return [(p.column.name, p.rule.strategy, p.rule.min, p.rule.max, p.rule.null_rate or None, p.rule.unique) for p in plan.columns]


@fixed("warning string", [("Code",), ("BornOn",)])
def plan_warnings(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """A null rate on a NOT NULL column, and a NOT NULL column without default that is left out."""
    rules = R.loads("rows: 5\ncolumns:\n  BornOn: {strategy: skip}\n  Code: {strategy: auto, nullRate: 0.5}\n")
    return [(w.split("'")[1],) for w in genplan.build(parse_single(KINDS_DDL, "Kinds"), rules).warnings]


@fixed("table string, column string, kind string, key boolean", [
    ("dbo.Kinds", "KindId", "int", True), ("dbo.Kinds", "Code", "string", False), ("dbo.Kinds", "Price", "decimal(12,2)", False), ("dbo.Kinds", "Email", "string", False), ("dbo.Kinds", "BornOn", "date", False),
    ("sales.Item List", "ItemId", "bigint", True), ("sales.Item List", "KindId", "int", False), ("sales.Item List", "Note", "string", False), ("sales.Item List", "Amount", "decimal(8,3)", False),
])
def warehouse_tables(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """Tables, columns and keys as a warehouse lists them."""
    w = house(spark, KINDS_DDL)
    return [(name, f.name, f.dataType.simpleString(), f.name in w.definition(name).primary_key) for name in w.tables() for f in w.table(name).schema.fields]


@fixed("root string, refused boolean", [("file:///data/w/", False), ("/data/w", False), ("/data/other", True), ("jdbc://u:password@host/x", True)])
def allowlist_checks(spark: SparkSession, sf_dir: str) -> list[tuple]:
    return [(root, refuses(AllowlistError)(lambda: guard(root, ["/data/w"]))) for root in ("file:///data/w/", "/data/w", "/data/other", "jdbc://u:password@host/x")]  # noqa: B023


_FACTS = {"runId": "r1", "planSha": "0" * 64, "rulesSha": "1" * 64, "approver": "a@example.test", "ts": "2026-01-01", "newIdentities": [{"key": {"k": "7"}, "value": "DE123"}], "verify": {"l1": True, "l2": True, "l3": False, "regressions": ["c"], "preexistingReds": []},
          "rules": [{"id": "A1", "column": "c", "kind": "identity", "patched": 12, "samples": [], "reason": "r", "skipped": []}]}


@fixed("report string, finding string", [("left out", "missing-identity"), ("left out", "missing-rule"), ("made up", "unsourced-number")])
def report_audit(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """A fallback report passes; reports that leave something out or have a number of their own don't."""
    whole, text = audit.fallback(_FACTS), json.dumps(_FACTS)
    reports = {"fallback": whole, "left out": "Nothing happened.", "made up": whole + "\nThat took 4711 minutes.", "quoted": whole + "\n```\n4711\n```\n"}
    return sorted((name, f["kind"]) for name, r in reports.items() for f in audit.audit_report(r, text, _FACTS))


def test_artifact_hash(tmp_path):
    """The hash of a written document: indented, without nulls, with a line end."""
    import hashlib

    A.write_json(tmp_path / "x.json", {"runId": "r1", "nothing": None, "n": 3})
    assert A.sha256(tmp_path / "x.json") == hashlib.sha256(b'{\n  "runId": "r1",\n  "n": 3\n}\n').hexdigest()


@fixed("place int, method string, url string, body string", [(0, "GET", "http://localhost/api/Customer/c_custkey/1%2F2", None), (1, "PATCH", "http://localhost/api/Customer/c_custkey/1%2F2", '{"c_mktsegment": "x"}')])
def rest_calls(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """A patch over HTTP: the row is read, then one column set."""
    calls: list[tuple] = []

    def opener(request):
        calls.append((len(calls), request.get_method(), request.full_url, request.data.decode() if request.data else None))
        return contextlib.closing(io.BytesIO(json.dumps({"value": [{"c_mktsegment": "old"}]}).encode()))

    rest.RestSink("http://localhost/api/", {"dbo.customer": "Customer"}, opener=opener).patch("dbo.Customer", "c_custkey", "1/2", "c_mktsegment", "x")
    return calls


@fixed("name string, passed boolean, given_up boolean", [("quick", True, False), ("broken", False, False), ("endless", False, True)])
def eval_time_limit(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """A query that takes too long is given up, and the others go on."""
    slow = spark.range(1 << 40).select(F.sum(F.xxhash64("id") % 7))
    frames = {"quick": spark.range(5).agg(F.count("*")), "endless": slow}

    def sql(name: str) -> DataFrame:
        if name not in frames:
            raise SeedloomError("no such query")
        return frames[name]

    checks = [Evaluation("quick", "quick", Expectation(equals="5")), Evaluation("broken", "broken", Expectation(equals="5")), Evaluation("endless", "endless", Expectation(equals="5"))]
    return [(r.name, r.passed, "given up" in (r.error or "")) for r in evaluate.run(checks, sql, timeout=2.0)]
