"""Repair: freeze replacement values in a plan, approve it by its hash, apply it as an overlay, verify, and revert.

A plan's rows (patches and skipped rows) are tables below the warehouse, in _runs/<run id>, and a run's log is a table that
is published together with the tables and ledger entries it is about. What people read and approve is a short document:
counts, examples, and the root of a hash tree over the rows, so that approving the document approves every cell. No row
of a plan or log passes through the driver.
"""

from __future__ import annotations

import getpass
import hashlib
import subprocess
import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedloom.errors import CONSUMER, GAPS_REMAIN, INVARIANT, OK, ConfigError, SeedloomError
from seedloom.functions import generators as G
from seedloom.functions.coerce import canonical
from seedloom.functions.draw import Draw
from seedloom.functions.strategies import chosen
from seedloom.operators import evaluate, gaps
from seedloom.operators.digest import rows_digest
from seedloom.operators.generate import ATTEMPTS, lookup
from seedloom.operators.rest import RestSink
from seedloom.shared import settle
from seedloom.sources import artifacts as A
from seedloom.sources.datasets import DatasetStore
from seedloom.sources.gaprules import GapRule, GapRules
from seedloom.sources.rules import Evaluation
from seedloom.sources.warehouse import LEDGER_NAME, Warehouse

#: Patches that are sent to every task; more of them are joined by a shuffle.
BROADCAST_PATCHES = 100_000
#: Examples in documents.
SHOWN = 5

PATCHES = "rule string, key string, value string, inputs map<string,string>, minted boolean"
SKIPPED = "rule string, key string, why string, policy string"
LOG = "seq int, ts string, rule string, table string, keyColumn string, id string, col string, old string, new string, reason string"

# Planning --------------------------------------------------------------------------------------------------------------


def union(frames: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


def plan(w: Warehouse, rules: GapRules, seed: int = 0, rules_sha: str = "", run_id: str | None = None) -> dict:
    """The plan document: for each rule its status, numbers of patches, skipped rows and new identities, and coverage."""
    run_id = run_id or uuid.uuid4().hex[:12]
    counts: dict[str, int] = {}
    by_table: dict[str, list[GapRule]] = {}
    for r in rules.rules:
        by_table.setdefault(r.table_name, []).append(r)
    for table, own in by_table.items():
        counts |= gaps.gap_counts(own, w.table(table))
    found = [(r, values(w, r, rules.datasets, w.table(r.table_name), seed)) for r in rules.rules if counts[r.id] <= r.threshold]
    named = lambda frame, r: frame.select(F.lit(r.id).alias("rule"), "*")
    folder = f"{w.root}/_runs/{run_id}"
    tables = {"patches": (PATCHES, [named(p, r) for r, (p, _) in found]), "skipped": (SKIPPED, [named(s, r) for r, (_, s) in found if s is not None])}
    for name, (schema, frames) in tables.items():
        union(frames, w.spark, schema).write.parquet(f"{folder}/{name}")
    doc = {"runId": run_id, "rulesSha": rules_sha, "tables": folder}
    patches, skipped = patch_rows(w.spark, doc), skipped_rows(w.spark, doc)
    patched_ = {x["rule"]: x for x in patches.groupBy("rule").agg(F.count("*").alias("n"), F.count_if("minted").alias("minted")).collect()}
    lacking = {x["rule"]: x["n"] for x in skipped.groupBy("rule").agg(F.count("*").alias("n")).collect()}
    examples: dict[str, list[dict]] = {}
    for x in first_rows(skipped).collect():
        examples.setdefault(x["rule"], []).append({"key": {rules.get(x["rule"]).key: x["key"]}, "why": x["why"], "policy": x["policy"]})
    out = []
    for r in rules.rules:
        n = counts[r.id]
        own = {"id": r.id, "table": r.table_name, "key": r.key, "column": r.column, "kind": r.kind, "status": "OK" if n <= r.threshold else "BLOCKED", "count": n, "threshold": r.threshold, "reason": r.reason}
        own |= {"patches": patched_[r.id]["n"] if r.id in patched_ else 0, "skipped": lacking.get(r.id, 0), "newIdentities": patched_[r.id]["minted"] if r.id in patched_ else 0, "skippedExamples": examples.get(r.id, [])}
        c = gaps.rule_coverage(r, w.table(r.table_name))
        own["coverage"] = None if c is None else {"uncovered": c.uncovered, "selectedValid": c.selected_valid, "indeterminate": c.indeterminate, "uncoveredKeys": c.uncovered_keys, "selectedValidKeys": c.selected_valid_keys, "indeterminateKeys": c.indeterminate_keys}
        out.append(own)
    return doc | {"rowsSha": rows_sha(w.spark, doc), "rules": out}


def patch_rows(spark: SparkSession, plan_doc: dict) -> DataFrame:
    return spark.read.schema(PATCHES).parquet(f"{plan_doc['tables']}/patches")


def skipped_rows(spark: SparkSession, plan_doc: dict) -> DataFrame:
    return spark.read.schema(SKIPPED).parquet(f"{plan_doc['tables']}/skipped")


def rows_sha(spark: SparkSession, plan_doc: dict) -> str:
    """One hash for both tables of a plan."""
    return rows_digest(patch_rows(spark, plan_doc), skipped_rows(spark, plan_doc))


def first_rows(rows: DataFrame, n: int = SHOWN, key: str = "key") -> DataFrame:
    """The first rows of each rule by key; short keys first, so that numbers are in order."""
    order = Window.partitionBy("rule").orderBy(F.length(key), key)
    return rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n).drop("r").orderBy("rule", F.length(key), key)


def listed(spark: SparkSession, plan_doc: dict) -> dict:
    """The plan document with its rows in lists, for plans that people read whole."""
    rows = lambda frame, rule: frame.filter(F.col("rule") == rule).orderBy(F.length("key"), "key").collect()
    out = []
    for r in plan_doc["rules"]:
        name = lambda x: {"key": {r["key"]: x["key"]}}  # noqa: B023, E731
        own = rows(patch_rows(spark, plan_doc), r["id"])
        patches = [name(x) | {"value": x["value"]} | ({"inputs": x["inputs"]} if x["inputs"] else {}) for x in own]
        out.append(r | {"patches": patches, "skipped": [name(x) | {"why": x["why"], "policy": x["policy"]} for x in rows(skipped_rows(spark, plan_doc), r["id"])], "newIdentities": [name(x) | {"value": x["value"]} for x in own if x["minted"]]})
    return plan_doc | {"rules": out}


def values(w: Warehouse, r: GapRule, datasets: DatasetStore, frame: DataFrame, seed: int) -> tuple[DataFrame, DataFrame | None]:
    """Patches (key, value, inputs, minted) and skipped rows (key, why, policy)."""
    rows = gaps.gap_rows(r, frame, ordered=False)
    draw = lambda attempt=0: Draw(seed, r.table_name, r.id, F.col("__key"), attempt)
    rows = rows.withColumn("__key", gaps.key_text(r, rows))
    if r.kind == "derived":
        return derived(r, datasets, rows)
    if r.kind == "identity":
        return identities(w, r, rows, draw), None
    if DatasetStore.is_key(r.fix):
        d, column = datasets.resolve(r.fix, r.column)
        at = d.index(column)
        value = F.element_at(F.array(*[F.lit(x[at]) for x in d.rows]), chosen(list(d.rows), list(d.weights) if d.weights else None, draw()) + 1)
    elif (query := G.find(G.CANDIDATES, r.fix)) is not None:
        source = lookup(w.spark, w.sql(query), r.column)
        return replaced(rows.withColumn("pick", draw().below(source.size)).join(source.frame, "pick", "left"), F.col("value")), None
    else:
        value = G.random_value(r.fix, draw())
    return replaced(rows, value), None


def replaced(rows: DataFrame, value: Column, inputs: Iterable[str] = (), minted: bool = False) -> DataFrame:
    kept = [x for n in inputs for x in (F.lit(n), F.col(f"`{n}`").cast("string"))]
    return rows.select(F.col("__key").alias("key"), value.cast("string").alias("value"), (F.create_map(*kept) if kept else F.lit(None)).cast("map<string,string>").alias("inputs"), F.lit(minted).alias("minted"))


def derived(r: GapRule, datasets: DatasetStore, rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    inputs = list(r.inputs or ())
    missing = F.lit(False)
    for name in inputs:
        missing = missing | F.col(f"`{name}`").isNull()
    lacking, whole = rows.filter(missing), rows.filter(~missing)
    skipped = lambda frame, why: frame.select(F.col("__key").alias("key"), F.lit(why).alias("why"), F.lit(r.on_missing_input or "block").alias("policy"))
    if DatasetStore.is_key(r.fix):
        d, column = datasets.resolve(r.fix, r.column)
        table = rows.sparkSession.createDataFrame([tuple([x[d.index(i)] for i in inputs] + [x[d.index(column)]]) for x in d.rows], T.StructType([T.StructField(f"d{k}", T.StringType()) for k in range(len(inputs) + 1)]))
        match = F.lit(True)
        for k, i in enumerate(inputs):
            match = match & (F.lower(F.col(f"`{i}`").cast("string")) == F.lower(f"d{k}"))
        found = whole.join(F.broadcast(table), match, "left")
        value = F.col(f"d{len(inputs)}")
        return replaced(found.filter(value.isNotNull()), value, inputs), skipped(lacking, "an input is NULL").unionByName(skipped(found.filter(value.isNull()), "no dataset row has these inputs"))
    method = G.find(G.DERIVED, r.fix)
    patches = replaced(whole, method.value({i.lower(): F.col(f"`{i}`") for i in inputs}), inputs)
    if r.floor:
        return patches.unionByName(replaced(lacking, F.lit(method.floor), inputs)), None
    return patches, skipped(lacking, "an input is NULL")


def identities(w: Warehouse, r: GapRule, rows: DataFrame, draw: Callable[..., Draw]) -> DataFrame:
    """What the ledger has for a row is used again; other rows get values that neither table, ledger nor plan holds."""
    ledger = w.ledger().filter((F.lower("TargetTable") == r.table_name.lower()) & (F.lower("ColumnName") == r.column.lower()))
    known = settle(rows.select("__key").join(ledger.select(F.col("RowKey").alias("__key"), F.col("Value").alias("v")), "__key", "left"))
    left = known.filter("v is null").select("__key")
    table = w.table(r.table_name)
    column = next(f for f in table.schema.fields if f.name.lower() == r.column.lower())
    taken = table.filter(F.col(f"`{column.name}`").isNotNull()).select(canonical(F.col(f"`{column.name}`"), column.dataType).alias("v")).unionByName(ledger.select(F.col("Value").alias("v")))
    source = lookup(w.spark, w.sql(G.find(G.CANDIDATES, r.fix)), r.column) if G.find(G.CANDIDATES, r.fix) else None
    out = replaced(known.filter("v is not null"), F.col("v"))
    for attempt in range(ATTEMPTS):
        if left.isEmpty():
            return out
        if source is None:
            drawn = left.select("__key", G.random_value(r.fix, draw(attempt)).cast("string").alias("v"))
        else:
            drawn = left.withColumn("pick", draw(attempt).below(source.size)).join(source.frame, "pick").select("__key", F.col("value").cast("string").alias("v"))
        # A value goes to the smallest key that has drawn it.
        fresh = settle(drawn.join(taken, "v", "left_anti").groupBy("v").agg(F.min("__key").alias("__key")))
        out = out.unionByName(replaced(fresh, F.col("v"), minted=True))
        left = settle(left.join(fresh, "__key", "left_anti"))
        taken = taken.unionByName(fresh.select("v"))
    if left.isEmpty():
        return out
    raise SeedloomError(f"rule {r.id!r}: no free identity within {ATTEMPTS} attempts")


# Checks ----------------------------------------------------------------------------------------------------------------


def counted_name(r: GapRule) -> str:
    """The columns in which a rule's invariant is counted: another text is another invariant."""
    return hashlib.sha256(f"{r.table_name.lower()} {r.key.lower()} {r.invariant}".encode()).hexdigest()[:16]


def by_file(w: Warehouse, table: str, rules: list[GapRule], frame: DataFrame) -> DataFrame:
    """For each file of a table the rows that break each rule's invariant, and those that it can't judge."""
    holds = {counted_name(r): gaps.invariant(r, frame) for r in rules}
    counts = [x for name, h in holds.items() for x in (F.count_if(~h).alias(f"bad_{name}"), F.count_if(h.isNull()).alias(f"open_{name}"))]
    return frame.groupBy(F.col("_metadata.file_path").alias("file")).agg(*counts)


def invariants(w: Warehouse, rules: GapRules, before: dict[str, str] | None = None, folder: str | None = None) -> tuple[list[dict], dict[str, str]]:
    """The rules' invariants, and where their counts by file are kept; those of one table come from one pass. With counts of
    an earlier pass only files that are new since then are read; a file never changes."""
    judged = [r for r in rules.rules if (r.invariant or "").strip()]
    counts: dict[str, tuple[int, int]] = {}
    kept: dict[str, str] = {}
    folder = folder or f"{w.root}/_runs/counts-{uuid.uuid4().hex}"
    for k, table in enumerate(dict.fromkeys(r.table_name for r in judged)):
        frame, own = w.table(table), [r for r in judged if r.table_name == table]
        names = [f"{part}_{counted_name(r)}" for r in own for part in ("bad", "open")]
        # As paths: Spark spells local ones in two ways.
        files = {f.rsplit("/", 2)[-2] + "/" + f.rsplit("/", 1)[-1]: f for f in frame.inputFiles()}
        known = w.spark.read.parquet(before[table]) if before and table in before else None
        if known is not None and set(names) <= set(known.columns):
            tail = F.regexp_extract("file", "[^/]+/[^/]+$", 0)
            now = w.spark.createDataFrame([(f,) for f in files], "tail string")  # as many as the manifest names
            old = known.withColumn("tail", tail).join(now, "tail", "left_semi")
            seen = {x["tail"] for x in old.select("tail").collect()}
            new = [f for t, f in files.items() if t not in seen]
            parts = [old.select("file", *names)] + ([by_file(w, table, own, w.spark.read.schema(frame.schema).parquet(*new)).select("file", *names)] if new else [])
            found = reduce(DataFrame.unionByName, parts)
        else:
            found = by_file(w, table, own, frame)
        path = f"{folder}/{k}"
        found.write.parquet(path)
        kept[table] = path
        row = w.spark.read.parquet(path).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first()
        counts |= {r.id: (row[f"bad_{counted_name(r)}"], row[f"open_{counted_name(r)}"]) for r in own}
    out = []
    for r in judged:
        bad, unknown = counts[r.id]
        notes = ([f"expected 0, got {bad}"] if bad else []) + ([f"{unknown} row(s) not evaluated: the invariant is UNKNOWN where a column it references is NULL"] if unknown else [])
        out.append({"name": f"{r.id}.invariant", "passed": bad == 0, "detail": "; ".join(notes) or None})
    return out, kept


def consumer(w: Warehouse, checks: Iterable[Evaluation]) -> list[dict]:
    out = []
    for x in evaluate.run(checks, w.sql):
        detail = None if x.passed else x.error or f"expected {(x.expected or '').removeprefix('= ')}, got {'NULL' if x.value is None else x.value}"
        out.append({"name": x.name, "passed": x.passed, "detail": detail})
    return out


def baseline(w: Warehouse, rules: GapRules, checks: Iterable[Evaluation], run_id: str) -> dict:
    found, kept = invariants(w, rules)
    return {"runId": run_id, "invariants": found, "consumer": consumer(w, checks), "counts": kept}


def regressions(before: list[dict], after: list[dict]) -> tuple[list[str], list[str]]:
    """Checks that fail now: those that passed before, and those that failed already."""
    passed = {b["name"].lower() for b in before if b["passed"]}
    failed = [a["name"] for a in after if not a["passed"]]
    return [n for n in failed if n.lower() in passed], [n for n in failed if n.lower() not in passed]


def remaining_gaps(w: Warehouse, rules: GapRules, plan_doc: dict) -> DataFrame:
    """rule, key of planned rows that are still bad."""
    out = []
    for doc in plan_doc["rules"]:
        r = rules.get(doc["id"])
        if doc["patches"]:
            keys = patch_rows(w.spark, plan_doc).filter(F.col("rule") == r.id).select("key")
            frame = w.table(r.table_name)
            frame = w.holding(frame, next(f for f in frame.schema.fields if f.name.lower() == r.key.lower()), keys, doc["patches"])
            keys = F.broadcast(keys) if doc["patches"] <= BROADCAST_PATCHES else keys
            out.append(gaps.remaining(r, frame, keys).select(F.lit(r.id).alias("rule"), "key"))
    return union(out, w.spark, "rule string, key string")


def verify(w: Warehouse, rules: GapRules, plan_doc: dict, before: dict, checks: Iterable[Evaluation]) -> dict:
    """Three layers: planned gaps are closed, no invariant and no consumer check got worse. Of invariants only files that are
    new since the baseline are counted."""
    left = settle(remaining_gaps(w, rules, plan_doc))
    n = left.count()
    now = {"invariants": invariants(w, rules, before.get("counts"))[0], "consumer": consumer(w, checks)}
    inv, con = (regressions(before[k], now[k]) for k in ("invariants", "consumer"))
    return {"runId": plan_doc["runId"], "l1": not n, "l2": not inv[0], "l3": not con[0], "regressions": inv[0] + con[0], "preexistingReds": inv[1] + con[1], **now, "remaining": n, "remainingPlannedGaps": [f"{x['rule']}:{x['key']}" for x in first_rows(left).collect()]}


def exit_code(doc: dict) -> int:
    return GAPS_REMAIN if not doc["l1"] else INVARIANT if not doc["l2"] else CONSUMER if not doc["l3"] else OK


# Approval, application, return -------------------------------------------------------------------------------------------


def summary(plan_doc: dict) -> list[str]:
    """What an approver sees."""
    out = [f"run {plan_doc['runId']}"]
    for r in plan_doc["rules"]:
        out.append(f"{r['status']} {r['id']} {r['table']}.{r['column']} ({r['kind']}): {r['count']} rows, threshold {r['threshold']}, {r['patches']} patches, {r['skipped']} skipped, {r['newIdentities']} new identities")
        if c := r.get("coverage"):
            out.append(f"  coverage: {c['uncovered']} uncovered, {c['selectedValid']} selected but valid, {c['indeterminate']} not judged")
        out += [f"  skipped {s['key']}: {s['why']}" for s in r["skippedExamples"]]
    return out


def git_email(folder: str | Path = ".") -> str | None:
    got = subprocess.run(["git", "-C", str(folder), "config", "user.email"], capture_output=True, text=True)
    return got.stdout.strip() or None


def refuse_blocked(plan_doc: dict) -> None:
    if blocked := [r["id"] for r in plan_doc["rules"] if r["status"] == "BLOCKED"]:
        raise ConfigError(f"the plan is blocked: more rows than the threshold in {', '.join(blocked)}")


def approve(folder: str | Path, email: str | None = None) -> dict:
    """Bind the plan's bytes, and by the hash in them its rows, to who approves them."""
    path = Path(folder) / "plan.json"
    refuse_blocked(A.read_json(path))
    doc = {"sha256": A.sha256(path), "osUser": getpass.getuser(), "gitEmail": email or git_email(folder), "timestampUtc": A.now()}
    A.write_json(Path(folder) / "plan.approved", doc)
    return doc


def overlay(frame: DataFrame, key: Column, patches: DataFrame, columns: list[str]) -> DataFrame:
    """frame with patched values, the old ones as text (__old_<column>), and __hit. patches: key, and for each column a
    struct of the new text; without one the cell stays. The caller knows the patches' number and hints accordingly."""
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    joined = frame.withColumn("__key", key).join(patches.withColumnRenamed("key", "__key"), "__key", "left")
    new = {c: F.when(F.col(f"__new_{c}").isNotNull(), F.col(f"__new_{c}")["v"].cast(kinds[c])).otherwise(F.col(f"`{c}`")) for c in columns}
    old = [F.when(F.col(f"__new_{c}").isNotNull(), F.struct(F.col(f"`{c}`").cast("string").alias("v"))).alias(f"__old_{c}") for c in columns]
    return joined.select(*[new[f].alias(f) if f in new else F.col(f"`{f}`") for f in kinds], *old, F.col("__key"))


CELLS = "key string, column string, value string, seq int"


def patched(w: Warehouse, table: str, key: str, cells: DataFrame | list[tuple[str, str, str | None]]) -> tuple[list[str], DataFrame]:
    """The table's folders and files with cells (key, column, value, seq; or a list of the first three) set, staged, and the
    old values (key, column, old). Of several values for a cell the one of the highest seq is taken.

    Each key must have exactly one row. One pass over the key and the patched columns finds the rows, of few keys only in
    parts of files that can hold them; only the files that hold them are written anew."""
    if isinstance(cells, list):
        cells = w.spark.createDataFrame([(*c, k) for k, c in enumerate(cells)], CELLS)
    frame = w.table(table)
    kinds = {f.name.lower(): f for f in frame.schema.fields}
    columns = sorted({kinds[x[0]].name for x in cells.select(F.lower("column")).distinct().collect()})
    is_of = lambda c: F.lower("column") == c.lower()
    last = [F.max(F.when(is_of(c), F.struct("seq", F.struct(F.col("value").alias("v")).alias("n"))))["n"].alias(f"__new_{c}") for c in columns]
    patches = settle(cells.groupBy("key").agg(*last))
    n = patches.count()
    sent = F.broadcast(patches) if n <= BROADCAST_PATCHES else patches
    key_text = canonical(F.col(f"`{kinds[key.lower()].name}`"), kinds[key.lower()].dataType)
    cell = [F.col(f"`{c}`").cast("string").alias(f"__old_{k}") for k, c in enumerate(columns)]
    hits = settle(w.holding(frame, kinds[key.lower()], patches, n).select(key_text.alias("key"), F.col("_metadata.file_path").alias("__file"), *cell).join(sent.select("key"), "key"))
    bad = patches.select("key").join(hits.groupBy("key").agg(F.count("*").alias("rows")), "key", "left").filter(F.coalesce("rows", F.lit(0)) != 1)
    if some := bad.limit(SHOWN).collect():
        raise SeedloomError(f"{table}: {bad.count()} keys don't have exactly one row ({', '.join(str(x['key']) for x in some)}); nothing was changed")
    old = F.coalesce(*[F.when(is_of(c), F.col(f"__old_{k}")) for k, c in enumerate(columns)]) if columns else F.lit(None)
    before = cells.select("key", "column").distinct().join(hits, "key").select("key", "column", old.cast("string").alias("old"))
    files = [x[0] for x in hits.select("__file").distinct().collect()]
    entries = w.manifest().folders[Warehouse.key(table)]
    if not files:
        return entries, before
    within = w.spark.read.schema(frame.schema).parquet(*sorted(files))
    new = overlay(within, key_text, sent, columns).select([f"`{f.name}`" for f in frame.schema.fields])
    return [*w.without(entries, {tuple(f.rsplit("/", 2)[-2:]) for f in files}), w.stage(Warehouse.key(table), new, w.definition(table).primary_key)], before


def rule_table(w: Warehouse, rules: Iterable[GapRule]) -> DataFrame:
    """What a patch doesn't say itself; as many rows as rules."""
    rows = [(r.id, k, r.table_name, r.key, r.column, r.kind, r.reason) for k, r in enumerate(rules)]
    return F.broadcast(w.spark.createDataFrame(rows, "rule string, seq int, table string, keyColumn string, column string, kind string, reason string"))


def by_table(rules: Iterable[GapRule]) -> dict[str, str]:
    """The key of each table."""
    keys: dict[str, str] = {}
    for r in rules:
        if keys.setdefault(r.table_name, r.key).lower() != r.key.lower():
            raise ConfigError("rules of one table must name the same key")
    return keys


def log_name(run_id: str) -> str:
    return f"_log/{run_id}"


def apply(w: Warehouse, rules: GapRules, folder: str | Path, sink: RestSink | None = None) -> DataFrame:
    """Apply an approved plan; returns the log. All tables, ledger entries and the log become visible at once or not at all.

    With a sink, the patches go there instead, after the ledger has its identities."""
    folder, spark = Path(folder), w.spark
    doc, approval = A.read_json(folder / "plan.json"), A.read_json(folder / "plan.approved")
    if A.sha256(folder / "plan.json") != approval["sha256"].lower():
        raise ConfigError("plan.json is not what was approved")
    refuse_blocked(doc)
    if rows_sha(spark, doc) != doc["rowsSha"]:
        raise ConfigError("the plan's rows are not what was approved")
    base, stamp, name = w.manifest(), A.now(), log_name(doc["runId"])
    if name in base.folders:
        raise ConfigError(f"run {doc['runId']} was applied already")
    own = [rules.get(r["id"]) for r in doc["rules"] if r["patches"]]
    cells = patch_rows(spark, doc).join(rule_table(w, own), "rule")
    folders = {}
    if any(r["newIdentities"] or r["kind"] == "identity" and r["patches"] for r in doc["rules"]):
        who = approval.get("gitEmail") or approval.get("osUser")
        rows = cells.filter("kind = 'identity'").select(F.col("table").alias("TargetTable"), F.col("key").alias("RowKey"), F.col("column").alias("ColumnName"), F.col("value").alias("Value"), F.col("rule").alias("RuleId"), F.lit(stamp).cast("timestamp").alias("CreatedAt"), F.lit(who).alias("CreatedBy"))
        folders[LEDGER_NAME] = [*base.folders.get(LEDGER_NAME, []), w.stage(LEDGER_NAME, w.with_entries(rows))]
    keys = by_table(own)
    if sink is not None:
        if folders:
            w.publish(base, folders)
            base, folders = w.manifest(), {}
        sent = sink.send(cells, doc["runId"], f"{doc['tables']}/rest")
        before = [sent.select("table", "key", "column", "old")]
    else:
        before = []
        for table, key in keys.items():
            folders[Warehouse.key(table)], old = patched(w, table, key, cells.filter(F.col("table") == table).select("key", "column", "value", "seq"))
            before.append(old.select(F.lit(table).alias("table"), "key", "column", "old"))
    old = union(before, spark, "table string, key string, column string, old string")
    log = cells.join(old, ["table", "key", "column"]).select("seq", F.lit(stamp).alias("ts"), "rule", "table", "keyColumn", F.col("key").alias("id"), F.col("column").alias("col"), "old", F.col("value").alias("new"), "reason")
    folders[name] = [w.stage(name, log)]
    w.publish(base, folders)
    log = run_log(w, doc["runId"])
    counts = {x["rule"]: x["n"] for x in log.groupBy("rule").agg(F.count("*").alias("n")).collect()}
    A.write_json(folder / "patches.json", {"runId": doc["runId"], "ts": stamp, "path": f"{w.root}/{folders[name][0]}", "rowsSha": rows_digest(log), "rules": counts})
    return log


def run_log(w: Warehouse, run_id: str) -> DataFrame:
    entries = w.manifest().folders.get(log_name(run_id))
    if entries is None:
        raise ConfigError(f"run {run_id} was not applied")
    return w.read(entries, LOG)


def log_rows(spark: SparkSession, patches_doc: dict) -> DataFrame:
    """The log that patches.json names."""
    return spark.read.schema(LOG).parquet(patches_doc["path"])


def run(w: Warehouse, rules: GapRules, folder: str | Path, checks: Iterable[Evaluation] = (), seed: int = 0, rules_sha: str = "", email: str | None = None, approved: bool = False) -> dict:
    """Plan, approve, apply, verify and report, each with its artifacts; without an approval it ends after the plan."""
    from seedloom.operators import audit

    folder, checks = Path(folder), list(checks)
    doc = {"plan": plan(w, rules, seed, rules_sha)}
    A.write_json(folder / "plan.json", doc["plan"])
    A.write_json(folder / "baseline.json", before := baseline(w, rules, checks, doc["plan"]["runId"]))
    refuse_blocked(doc["plan"])
    if not approved:
        return doc
    doc["approval"] = approve(folder, email)
    doc["log"] = apply(w, rules, folder)
    A.write_json(folder / "verify.json", found := verify(w, rules, doc["plan"], before, checks))
    A.write_json(folder / "facts.json", facts := audit.facts(folder))
    A.write_text(folder / "report.md", audit.fallback(facts))
    return doc | {"verify": found, "facts": facts}


def revert(w: Warehouse, rules: GapRules, log: DataFrame, only: list[str] | None = None) -> int:
    """Put back the earliest old value of each patched cell (by seq); the ledger keeps its entries. log: rule, id, col, old,
    seq, as apply gives it."""
    if only:
        log = log.filter(F.lower("rule").isin([i.lower() for i in only]))
    own = [rules.get(x[0]) for x in log.select("rule").distinct().collect()]
    of = rule_table(w, own).drop("seq", "reason", "column")
    cells = log.select("rule", F.col("id").alias("key"), F.col("col").alias("column"), "old", "seq").join(of.select(F.lower("rule").alias("name"), F.col("table").alias("to")), F.lower("rule") == F.col("name"))
    cells = settle(cells.groupBy("to", "key", "column").agg(F.min(F.struct("seq", "old"))["old"].alias("value")))
    base, folders = w.manifest(), {}
    for table, key in by_table(own).items():
        folders[Warehouse.key(table)], _ = patched(w, table, key, cells.filter(F.col("to") == table).select("key", "column", "value", F.lit(0).alias("seq")))
    if folders:
        w.publish(base, folders)
    return cells.count()
