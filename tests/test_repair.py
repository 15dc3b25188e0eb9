import json
import random
import subprocess
import threading

import pytest
from pyspark.sql import functions as F

from seedloom.errors import ConfigError, LedgerConflict
from seedloom.functions import generators as G
from seedloom.functions.coerce import canonical
from seedloom.operators import audit, gaps, lint, repair
from seedloom.operators.digest import rows_digest
from seedloom.sources import artifacts as A
from seedloom.sources import gaprules
from seedloom.sources.datasets import Dataset, DatasetStore
from seedloom.sources.ddl import parse_single
from seedloom.sources.gaprules import GapRule
from seedloom.sources.rules import Evaluation, Expectation
from seedloom.sources.warehouse import Warehouse

SECURITY = parse_single("CREATE TABLE dbo.Security (PropertyId INTEGER NOT NULL PRIMARY KEY, SecurityId NVARCHAR(20), PropertyType NVARCHAR(10) NOT NULL, Rooms INTEGER, Bathrooms INTEGER)".replace("INTEGER", "INT"))
ROWS = [
    (101, "DE0001234567", "EFH", 3, None), (102, None, "EFH", 5, None), (103, "DE0007654321", "EFH", 7, None), (104, None, "EFH", None, None),
    (105, "DE0009999999", "EFH", 9, None), (106, "DE0001111111", "MFH", 12, 4), (107, "DE0002222222", "WHG", 2, 1), (108, "DE0003333333", "EFH", 4, 2),
]
RULES = """
rules:
  - id: SEC-001
    table: "[dbo].[Security]"
    key: PropertyId
    column: Bathrooms
    kind: derived
    gap: "PropertyType = 'EFH' AND Bathrooms IS NULL"
    fix: security.bathroomsFromRooms
    inputs: [Rooms]
    invariant: "PropertyType <> 'EFH' OR (Bathrooms IS NOT NULL AND Bathrooms = CASE WHEN Rooms IS NULL OR Rooms < 1 THEN 1 ELSE (Rooms + 2) / 3 END)"
    threshold: 500
    reason: A house has a bathroom for each three rooms begun.
  - id: SEC-002
    table: dbo.Security
    key: PropertyId
    column: SecurityId
    kind: identity
    gap: "SecurityId IS NULL"
    fix: security.securityId
    threshold: 50
    reason: Others refer to a property by this id.
"""
CHECKS = [
    Evaluation("bathrooms", "SELECT COUNT(*) FROM dbo.Security WHERE PropertyType = 'EFH' AND Bathrooms IS NULL", Expectation(equals="0")),
    Evaluation("ids", "SELECT COUNT(*) FROM dbo.Security WHERE SecurityId IS NULL", Expectation(equals="0")),
    Evaluation("unique-ids", "SELECT COUNT(*) FROM (SELECT SecurityId FROM dbo.Security WHERE SecurityId IS NOT NULL GROUP BY SecurityId HAVING COUNT(*) > 1) d", Expectation(equals="0")),
    Evaluation("rows", "SELECT COUNT(*) FROM dbo.Security", Expectation(equals="8")),
]


@pytest.fixture
def w(spark, tmp_path):
    out = Warehouse(spark, str(tmp_path / "w"))
    out.create(SECURITY, spark.createDataFrame(ROWS, SECURITY.struct()))
    return out


def content(w):
    return {r["PropertyId"]: tuple(r)[1:] for r in w.table("dbo.Security").collect()}


def test_whole_run(w, tmp_path):
    folder, rules_path = tmp_path / "run", tmp_path / "gaps.yaml"
    rules_path.write_text(RULES)
    rules = gaprules.load(rules_path)
    doc = repair.plan(w, rules, 1, A.sha256(rules_path))
    assert [r["status"] for r in doc["rules"]] == ["OK", "OK"]
    assert [(r["patches"], r["skipped"], r["newIdentities"]) for r in doc["rules"]] == [(4, 1, 0), (2, 0, 2)]
    one, two = repair.listed(w.spark, doc)["rules"]
    assert [p["key"]["PropertyId"] for p in one["patches"]] == ["101", "102", "103", "105"] and [p["value"] for p in one["patches"]] == ["1", "2", "3", "3"]
    assert [s["key"]["PropertyId"] for s in one["skipped"]] == ["104"] and len(two["newIdentities"]) == 2
    assert (one["coverage"]["uncovered"], one["coverage"]["selectedValid"], one["coverage"]["indeterminate"]) == (0, 0, 0) and two["coverage"] is None
    A.write_json(folder / "plan.json", doc)
    before = repair.baseline(w, rules, CHECKS, doc["runId"])
    A.write_json(folder / "baseline.json", before)
    with pytest.raises(ConfigError):
        repair.apply(w, rules, folder)
    repair.approve(folder, "a@example.test")
    log = repair.apply(w, rules, folder)
    assert log.count() == 6 and w.ledger().count() == 2
    now = content(w)
    assert [now[k][3] for k in (101, 102, 103, 104, 105, 106, 107, 108)] == [1, 2, 3, None, 3, 4, 1, 2] and all(v[0] for v in now.values())
    v = repair.verify(w, rules, doc, before, CHECKS)
    assert v["l1"] and v["l2"] and v["l3"] and not v["regressions"] and v["preexistingReds"] == ["SEC-001.invariant", "bathrooms"] and repair.exit_code(v) == 0
    A.write_json(folder / "verify.json", v)
    facts = audit.facts(folder)
    A.write_json(folder / "facts.json", facts)
    A.write_text(folder / "report.md", audit.fallback(facts))
    assert audit.notary(folder, rules_path)["verdict"] == "pass"
    assert {r["id"]: r["patched"] for r in facts["rules"]} == {"SEC-001": 4, "SEC-002": 2}
    A.write_text(folder / "report.md", "4711 rows of SEC-001 changed.")
    kinds = {x["kind"] for x in audit.notary(folder, rules_path)["violations"]}
    assert kinds == {"missing-rule", "missing-identity", "unsourced-number"}
    rules_path.write_text(RULES + "\n# changed\n")
    assert "rules-drift" in {x["kind"] for x in audit.notary(folder, rules_path)["violations"]}
    # Back again; the ledger stays, and another seed uses its identities.
    assert repair.revert(w, rules, repair.run_log(w, doc["runId"]), ["sec-001"]) == 4 and content(w)[101][3] is None and content(w)[102][0]
    repair.revert(w, rules, log)
    assert content(w) == {r[0]: r[1:] for r in ROWS} and w.ledger().count() == 2
    again = repair.listed(w.spark, repair.plan(w, rules, 99))
    assert again["rules"][1]["patches"] == two["patches"] and again["rules"][1]["newIdentities"] == []


def test_changed_plan_blocked_plan_and_unknown_rules(w, tmp_path):
    rules = gaprules.loads(RULES)
    doc = repair.plan(w, rules)
    A.write_json(tmp_path / "plan.json", doc)
    repair.approve(tmp_path, "a@example.test")
    A.write_json(tmp_path / "plan.json", doc | {"runId": "other"})
    with pytest.raises(ConfigError, match="approved"):
        repair.apply(w, rules, tmp_path)
    blocked = repair.plan(w, gaprules.loads(RULES.replace("threshold: 500", "threshold: 4")))
    assert blocked["rules"][0]["status"] == "BLOCKED" and not blocked["rules"][0]["patches"]
    A.write_json(tmp_path / "plan.json", blocked)
    with pytest.raises(ConfigError, match="blocked"):
        repair.approve(tmp_path)
    with pytest.raises(ConfigError, match="NOPE"):
        rules.only(["NOPE"])
    with pytest.raises(ConfigError, match="SEC-001"):
        repair.verify(w, rules.only(["sec-002"]), doc, {"invariants": [], "consumer": []}, [])


def test_narrow_gap_reports_what_it_misses(w):
    doc = repair.plan(w, gaprules.loads(RULES.replace("AND Bathrooms IS NULL\"", "AND Bathrooms IS NULL AND Rooms IS NOT NULL\"")))
    assert doc["rules"][0]["coverage"]["uncoveredKeys"] == ["104"] and doc["rules"][0]["patches"] == 4 and doc["rules"][0]["status"] == "OK"


def test_floor_dataset_and_ephemeral_fixes(w):
    rows = lambda rules: repair.listed(w.spark, repair.plan(w, rules))["rules"][0]
    floor = rows(gaprules.loads(RULES.replace("inputs: [Rooms]", "inputs: [Rooms]\n    onMissingInput: floor")))
    assert {p["key"]["PropertyId"]: p["value"] for p in floor["patches"]}["104"] == "1" and not floor["skipped"]
    d = DatasetStore([Dataset("baths", ("Rooms", "Bathrooms"), (("3", "1"), ("5", "2")), (1.0, 3.0))])
    text = "rules:\n  - {id: D, table: dbo.Security, key: PropertyId, column: Bathrooms, kind: %s, gap: \"Bathrooms IS NULL\", fix: dataset.baths, threshold: 9, reason: r%s}\n"
    looked = rows(gaprules.loads(text % ("derived", ", inputs: [Rooms]"), d))
    assert [(p["key"]["PropertyId"], p["value"]) for p in looked["patches"]] == [("101", "1"), ("102", "2")] and [s["key"]["PropertyId"] for s in looked["skipped"]] == ["103", "104", "105"]
    picked = rows(gaprules.loads(text % ("ephemeral", ""), d))
    assert len(picked["patches"]) == 5 and {p["value"] for p in picked["patches"]} <= {"1", "2"}
    year = rows(gaprules.loads((text % ("ephemeral", "")).replace("dataset.baths", "property.yearBuilt")))
    assert all(1950 <= int(p["value"]) <= 2020 for p in year["patches"])


def test_verify_sees_regressions(w):
    rules = gaprules.loads(RULES)
    before = {"invariants": [{"name": "sec-001.invariant", "passed": True}], "consumer": [{"name": "bathrooms", "passed": True}]}
    v = repair.verify(w, rules, {"runId": "x", "rules": []}, before, CHECKS)
    assert v["l1"] and not v["l2"] and not v["l3"] and repair.exit_code(v) == 20
    assert repair.exit_code(v | {"l2": True}) == 30 and repair.exit_code(v | {"l1": False}) == 10


def test_a_key_without_its_one_row_changes_nothing(w):
    with pytest.raises(Exception, match="999"):
        repair.patched(w, "dbo.Security", "PropertyId", [("999", "Bathrooms", "1")])


def test_only_files_with_patched_rows_are_written(w):
    w.append("dbo.Security", w.spark.createDataFrame([(201, "X", "EFH", 1, 1)], SECURITY.struct()))
    key = Warehouse.key("dbo.Security")
    before = w.manifest().folders[key]
    entries, old = repair.patched(w, "dbo.Security", "PropertyId", [("201", "Rooms", "5"), ("201", "Bathrooms", None)])
    assert len(before) == 2 and before[0] in entries and before[1] not in entries and sorted(map(tuple, old.collect())) == [("201", "Bathrooms", "1"), ("201", "Rooms", "1")]
    w.publish(w.manifest(), {key: entries})
    assert content(w)[201] == ("X", "EFH", 5, None) and len(content(w)) == 9
    w.publish(w.manifest(), {key: repair.patched(w, "dbo.Security", "PropertyId", [("101", "Rooms", "9")])[0]})
    assert content(w)[101][2] == 9 and content(w)[201][2] == 5 and len(content(w)) == 9


@pytest.mark.parametrize(("kind", "value"), [("BIGINT", "(id * 7919) % 100003"), ("VARCHAR(40)", "md5(cast(id as string))"), ("DECIMAL(12,2)", "cast(id * 7919 % 100003 as decimal(12,2)) / 4")])
def test_few_keys_are_looked_for_where_they_can_be(spark, tmp_path, kind, value):
    """Of 40 files in no order of keys three keys' worth is read, by ranges and Bloom filters; the cells are the same."""
    w = Warehouse(spark, str(tmp_path / "w"))
    table = parse_single(f"CREATE TABLE dbo.K (Id {kind} NOT NULL PRIMARY KEY, V INT)")
    rows = spark.range(0, 40_000, 1, 40).selectExpr(f"cast({value} as {table.struct()[0].dataType.simpleString()}) Id", "cast(id as int) V")
    w.create(table, rows)
    frame = w.table("dbo.K")
    asked = [str(r[0]) for r in rows.filter("V in (5, 17777, 39999)").select(canonical(F.col("Id"), table.struct()[0].dataType)).collect()]
    keys = spark.createDataFrame([(k,) for k in [*asked, "nobody"]], "key string")
    few = w.holding(frame, frame.schema["Id"], keys, 4)
    assert sorted(r["V"] for r in few.collect()) == [5, 17777, 39999]
    few.collect()
    plan, todo, read = few._jdf.queryExecution().executedPlan(), [], 0
    todo.append(plan)
    while todo:
        node = todo.pop()
        if "Scan parquet" in node.nodeName():
            read += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(k) for k in range(node.children().size())]
    assert 0 < read <= 6_000, read
    entries, old = repair.patched(w, "dbo.K", "Id", [(k, "V", "-1") for k in asked])
    assert sorted(x["old"] for x in old.collect()) == ["17777", "39999", "5"] and len([e for e in entries if e.endswith(".parquet")]) == 37
    w.publish(w.manifest(), {Warehouse.key("dbo.K"): entries})
    assert w.table("dbo.K").filter("V = -1").count() == 3 and w.table("dbo.K").count() == 40_000


def test_invariants_of_new_files_only(w, monkeypatch):
    """Counts by file are kept: after any changes the verdict is that of a full pass, and only new files are read."""
    rules = gaprules.loads(RULES.replace('gap: "SecurityId IS NULL"', 'gap: "SecurityId IS NULL"\n    invariant: "Rooms > 2"'))
    for k in range(4):
        w.append("dbo.Security", w.spark.createDataFrame([(300 + 10 * k + j, "X", "EFH", j if j else None, j % 3) for j in range(6)], SECURITY.struct()).coalesce(1))
    found, kept = repair.invariants(w, rules)
    read, plain = [], repair.by_file
    monkeypatch.setattr(repair, "by_file", lambda w_, t, r, frame: read.append(len(frame.inputFiles())) or plain(w_, t, r, frame))
    r, key = random.Random(5), Warehouse.key("dbo.Security")
    for _ in range(4):
        cells = [(str(300 + 10 * r.randrange(4) + r.randrange(6)), r.choice(["Rooms", "Bathrooms"]), r.choice([None, "1", "7"])) for _ in range(2)]
        w.publish(w.manifest(), {key: repair.patched(w, "dbo.Security", "PropertyId", list({c[:2]: c for c in cells}.values()))[0]})
        read.clear()
        found, kept = repair.invariants(w, rules, kept)
        assert read and read[0] < len(w.table("dbo.Security").inputFiles())
        assert found == repair.invariants(w, rules)[0]
    read.clear()
    assert repair.invariants(w, rules, kept)[0] == found and not read
    other = gaprules.loads(RULES.replace('gap: "SecurityId IS NULL"', 'gap: "SecurityId IS NULL"\n    invariant: "Rooms > 3"'))
    assert repair.invariants(w, other, kept)[0] == repair.invariants(w, other)[0]


def test_ledger_is_append_only(w, spark):
    row = lambda k, v: spark.sql(f"SELECT 'dbo.Security' TargetTable, '{k}' RowKey, 'SecurityId' ColumnName, '{v}' Value, 'r' RuleId, current_timestamp() CreatedAt, 'me' CreatedBy")
    w.publish(w.manifest(), {"ledger": [w.stage("ledger", w.with_entries(row("1", "A")))]})
    assert w.with_entries(row("1", "A")).count() == 0 and w.with_entries(row("2", "B")).count() == 1
    for key, value in (("1", "B"), ("2", "A")):
        with pytest.raises(LedgerConflict):
            w.with_entries(row(key, value))


@pytest.mark.parametrize(("gap", "invariant", "found"), [
    ("Size IS NULL AND Status = 'active'", "Size IS NOT NULL AND Size >= 1", (["2", "4"], [], [])),
    ("Status = 'active' OR Size IS NULL", "Size IS NOT NULL AND Size >= 1", ([], ["3"], [])),
    ("Size = 99", "Size >= 1", ([], [], ["1", "2", "4"])),
])
def test_coverage_with_unknowns(spark, gap, invariant, found):
    frame = spark.createDataFrame([(1, None, "active"), (2, None, "archived"), (3, 5, "active"), (4, None, None)], "WidgetId int, Size int, Status string")
    c = gaps.rule_coverage(GapRule(id="W", table="dbo.Widget", key="WidgetId", column="Size", gap=gap, invariant=invariant), frame)
    assert (c.uncovered_keys, c.selected_valid_keys, c.indeterminate_keys) == found and (c.uncovered, c.selected_valid, c.indeterminate) == tuple(map(len, found))


@pytest.mark.parametrize(("rooms", "baths"), [(0, 1), (1, 1), (2, 1), (3, 1), (4, 2), (6, 2), (7, 3), (9, 3), (10, 4)])
def test_bathrooms_from_rooms(spark, rooms, baths):
    from pyspark.sql import functions as F

    assert spark.range(1).select(G.find(G.DERIVED, "security.bathroomsFromRooms").value({"rooms": F.lit(rooms)})).first()[0] == baths


def test_derived_rules_refuse_null_input(w):
    assert [s["why"] for s in repair.plan(w, gaprules.loads(RULES))["rules"][0]["skippedExamples"]] == ["an input is NULL"]


@pytest.mark.parametrize(("old", "new", "message"), [
    ("id: SEC-002", "id: sec-001", "twice"), ("threshold: 50\n", "threshold: 0\n", "positive"), ("fix: security.securityId", "fix: nope", "unknown fix"), ("kind: identity", "kind: odd", "none of"),
    ("    inputs: [Rooms]\n", "", "require 'inputs'"), ("fix: security.securityId", "fix: security.bathroomsFromRooms", "needs kind: derived"), ("SecurityId IS NULL", "SecurityId IS NULL; DROP TABLE x", "terminator"),
    ("SecurityId IS NULL", "PropertyId IN (SELECT a FROM dbo.Other)", "only"), ("SecurityId IS NULL", "SecurityId", "boolean"), ("reason: Others refer to a property by this id.", "reason: ''", "required"),
])
def test_rule_errors(old, new, message):
    with pytest.raises(ConfigError, match=message):
        gaprules.loads(RULES.replace(old, new))


def test_lint_lists_everything(tmp_path):
    p = tmp_path / "gaps.yaml"
    p.write_text(RULES.replace("threshold: 50\n", "threshold: 1\n").replace("kind: derived", "kind: odd"))
    survey = {"tables": [{"table": "dbo.Security", "columns": [{"name": "SecurityId", "nulls": 2}]}]}
    doc = lint.lint(p, survey)
    assert doc["verdict"] == "fail" and {f["check"] for f in doc["findings"]} == {"schema", "threshold"}
    p.write_text(RULES)
    assert {f["check"] for f in lint.lint(p)["findings"]} == {"tests"}
    (tmp_path / "t").mkdir()
    (tmp_path / "t/test_x.py").write_text("# security.bathroomsFromRooms parametrize refuses_null")
    assert lint.lint(p, None, tmp_path / "t")["verdict"] == "pass"


def test_four_eyes(tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@example.test", *a], check=True, capture_output=True)
    (tmp_path / "gaps.yaml").write_text(RULES)
    git("init", "-q"), git("add", "gaps.yaml"), git("commit", "-qm", "rules")
    assert audit.last_author(tmp_path, tmp_path / "gaps.yaml") == "x@example.test"


def test_plans_of_many_rows_are_bound_cell_by_cell(spark, tmp_path):
    """200,000 patches without a row on the driver; a changed cell, a lost row or a copy of one changes the hash."""
    n = 200_000
    table = parse_single("CREATE TABLE dbo.Big (Id BIGINT NOT NULL PRIMARY KEY, Kind VARCHAR(20), Size INT)")
    w = Warehouse(spark, str(tmp_path / "big"))
    w.create(table, spark.range(n).selectExpr("id Id", "cast(null as string) Kind", "cast(id % 9 as int) Size"))
    rules = gaprules.loads("rules:\n  - {id: B, table: dbo.Big, key: Id, column: Kind, kind: ephemeral, gap: Kind IS NULL, fix: lorem.word, threshold: 1000000, reason: r, invariant: Kind IS NOT NULL}\n")
    doc = repair.plan(w, rules, 3)
    assert doc["rules"][0]["patches"] == n and len(json.dumps(doc)) < 5000
    rows = repair.patch_rows(spark, doc)
    root = rows_digest(rows)
    assert rows_digest(rows.repartition(3).orderBy("value")) == root
    other = "CASE WHEN key = '777' THEN {} ELSE {} END"
    for changed in (rows.withColumn("value", F.expr(other.format("concat(value, 'x')", "value"))), rows.withColumn("value", F.expr(other.format("null", "value"))), rows.filter("key <> '777'"), rows.unionByName(rows.filter("key = '777'")), rows.withColumn("minted", F.expr("key = '777'"))):
        assert rows_digest(changed) != root
    A.write_json(tmp_path / "plan.json", doc)
    repair.approve(tmp_path, "a@example.test")
    before = repair.baseline(w, rules, [], doc["runId"])
    log = repair.apply(w, rules, tmp_path)
    assert log.count() == n and w.table("dbo.Big").filter("Kind IS NULL").isEmpty() and w.table("dbo.Big").join(rows, F.col("Id").cast("string") == F.col("key")).filter("Kind = value").count() == n
    v = repair.verify(w, rules, doc, before, [])
    assert v["l1"] and v["remaining"] == 0 and repair.exit_code(v) == 0
    with pytest.raises(ConfigError, match="already"):
        repair.apply(w, rules, tmp_path)
    assert repair.revert(w, rules, log) == n and w.table("dbo.Big").filter("Kind IS NULL").count() == n
    assert repair.verify(w, rules, doc, before, [])["remaining"] == n


def test_rows_changed_after_approval(w, tmp_path):
    rules = gaprules.loads(RULES)
    doc = repair.plan(w, rules)
    A.write_json(tmp_path / "plan.json", doc)
    repair.approve(tmp_path, "a@example.test")
    spark, old = w.spark, repair.patch_rows(w.spark, doc).collect()
    changed = [r if k else (*r[:2], "99", *r[3:]) for k, r in enumerate(map(tuple, old))]
    spark.createDataFrame(changed, repair.PATCHES).write.mode("overwrite").parquet(f"{doc['tables']}/patches")
    with pytest.raises(ConfigError, match="rows"):
        repair.apply(w, rules, tmp_path)


class Server:
    """Entities that fail at random, before or after they have done what they were asked."""

    def __init__(self, rows):
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

        self.rows, self.done, self.random, self.lock, server = rows, {}, random.Random(1), threading.Lock(), self

        class Handler(BaseHTTPRequestHandler):
            def answer(self, code, doc=None):
                self.send_response(code)
                self.end_headers()
                self.wfile.write(json.dumps(doc or {}).encode())

            def do_GET(self):
                with server.lock:
                    self.answer(503) if server.random.random() < 0.2 else self.answer(200, {"value": [server.rows[self.path.rsplit("/", 1)[-1]]]})

            def do_PATCH(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                with server.lock:
                    fate = server.random.random()
                    if fate < 0.2:
                        return self.answer(503)
                    key = self.headers["Idempotency-Key"]
                    if key not in server.done:
                        server.done[key] = 1
                        server.rows[self.path.rsplit("/", 1)[-1]] |= body
                    self.answer(503 if fate < 0.4 else 200)

            def log_message(self, *a):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}/api"


def test_rest_sink_with_failures(w, tmp_path):
    """Each patch is done once and has its old value, also if a run breaks off and starts again."""
    rules = gaprules.loads(RULES)
    doc = repair.plan(w, rules, 5)
    A.write_json(tmp_path / "plan.json", doc)
    repair.approve(tmp_path, "a@example.test")
    server = Server({str(r[0]): {"SecurityId": r[1], "Bathrooms": r[4]} for r in ROWS})
    broken = repair.RestSink(server.url, {"dbo.Security": "Security"}, retries=0, parts=6)
    with pytest.raises(Exception, match="503"):
        repair.apply(w, rules, tmp_path, broken)
    log = repair.apply(w, rules, tmp_path, repair.RestSink(server.url, {"dbo.Security": "Security"}, retries=12, wait=0.001, parts=6))
    server.http.shutdown()
    wanted = {(x["key"], x["rule"]): x["value"] for x in repair.patch_rows(w.spark, doc).collect()}
    assert {(r["id"], r["rule"]): r["new"] for r in log.collect()} == wanted and all(r["old"] is None for r in log.collect()) and len(server.done) == len(wanted) == 6
    assert all(server.rows[k]["Bathrooms" if rule == "SEC-001" else "SecurityId"] == v for (k, rule), v in wanted.items())
    assert w.ledger().count() == 2 and content(w)[101][3] is None


def test_rest_sink():
    class Answer:
        def __init__(self, doc):
            self.doc = doc

        def read(self):
            return json.dumps(self.doc).encode()

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

    calls = []

    def opener(request):
        calls.append((request.get_method(), request.full_url, request.data))
        return Answer({"value": [{"Bathrooms": None}]})

    sink = repair.RestSink("http://localhost/api/", {"dbo.Security": "Security"}, opener=opener)
    assert sink.patch("dbo.security", "PropertyId", "1/2", "Bathrooms", "3") is None
    assert [c[0] for c in calls] == ["GET", "PATCH"] and calls[0][1].endswith("/Security/PropertyId/1%2F2")
    with pytest.raises(ConfigError):
        sink.patch("dbo.Other", "a", "1", "b", "2")
