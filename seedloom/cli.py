"""Command line: init, generate, evaluate, patch verbs, and damage for demonstrations. One scheme of exit codes (errors.py)."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from pathlib import Path

from seedloom.errors import EVALUATION, OK, ConfigError, SeedloomError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seedloom", description="Synthetic tables, assertions and reviewed repair on Spark.")
    verbs = p.add_subparsers(dest="verb", required=True)

    def add(to, name: str, text: str, *options: str) -> None:
        known = {
            "ddl": dict(required=True, help="CREATE TABLE script"), "table": dict(help="the table, if the script has several"), "rules": dict(required=True, help="rules file"), "out": dict(help="file or folder to write"),
            "warehouse": dict(help="folder of tables"), "csv": dict(help="write CSV here instead: one file if the name ends in .csv, else a folder"), "rows": dict(type=int), "seed": dict(type=int), "truncate": dict(action="store_true", help="replace the table's rows"),
            "dry-run": dict(action="store_true", help="show the first rows only"), "json": dict(action="store_true"), "artifacts": dict(default="artifacts", help="folder of the run"), "consumer": dict(help="file of consumer checks"),
            "only": dict(help="rule ids, by commas"), "survey": dict(help="survey.json"), "tests": dict(help="folder of tests"), "allowlist": dict(help="JSON list of warehouse roots"), "repository": dict(help="git folder"), "email": dict(),
            "jdbc": dict(help="write to the database with this URL instead"), "yes": dict(action="store_true", help="approve what was planned"), "key": dict(required=True, help="key column"), "column": dict(required=True), "value": dict(help="new value; NULL if left out"),
            "keys": dict(help="keys of the rows to damage, by commas"), "first": dict(type=int, help="damage so many rows that have a value, by key"), "insert": dict(help="rows to add, as a JSON list of objects"),
        }
        own = to.add_parser(name, help=text)
        for o in options:
            own.add_argument(f"--{o}", **known[o])

    add(verbs, "init", "a first rules file for a table", "ddl", "table", "rows", "seed", "out")
    add(verbs, "generate", "rows by rules, then their evaluations", "ddl", "table", "rules", "warehouse", "csv", "jdbc", "rows", "seed", "truncate", "dry-run", "json")
    add(verbs, "evaluate", "evaluations only", "rules", "warehouse", "json")
    patch = verbs.add_parser("patch", help="find and repair bad values").add_subparsers(dest="patch", required=True)
    common = ("rules", "warehouse", "artifacts", "only", "allowlist")
    add(patch, "survey", "what columns hold", *common)
    add(patch, "lint", "everything wrong with the rules", "rules", "survey", "tests")
    add(patch, "plan", "freeze replacement values", *common, "consumer", "seed")
    add(patch, "approve", "bind the plan to an approver", "artifacts", "email")
    add(patch, "apply", "write an approved plan", *common)
    add(patch, "verify", "three layers of checks", *common, "consumer")
    add(patch, "report", "facts and a report", "artifacts")
    add(patch, "notary", "check artifacts against each other", "rules", "artifacts", "repository")
    add(patch, "revert", "put old values back", *common)
    add(patch, "run", "plan, approve, apply, verify and report; without --yes it ends with the plan", *common, "consumer", "seed", "email", "yes")
    add(patch, "dashboard", "a page of the run's artifacts", "artifacts", "out")
    add(patch, "generators", "keys that rules can name")
    damage = verbs.add_parser("sample", help="demonstrations").add_subparsers(dest="sample", required=True)
    add(damage, "damage", "set cells of a table and add rows to it", "warehouse", "table", "key", "column", "value", "keys", "first", "insert")
    return p


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("seedloom").getOrCreate()


def warehouse(a):
    from seedloom.sources.warehouse import Warehouse

    if not a.warehouse:
        raise ConfigError("--warehouse is needed")
    allowed = json.loads(Path(a.allowlist).read_text("utf-8")) if getattr(a, "allowlist", None) else None
    return Warehouse(session(), a.warehouse, allowed)


def init(a) -> int:
    from seedloom.plans.infer import scaffold
    from seedloom.sources.datasets import DatasetStore
    from seedloom.sources.ddl import parse_single

    text = scaffold(parse_single(Path(a.ddl).read_text("utf-8"), a.table), a.rows or 100, 12345 if a.seed is None else a.seed, DatasetStore.beside(a.out) if a.out else None)
    if a.out:
        Path(a.out).write_text(text, "utf-8")
    else:
        print(text, end="")
    return OK


def generate(a) -> int:
    from seedloom.operators import evaluate
    from seedloom.operators.generate import ROW, Generator
    from seedloom.plans import genplan
    from seedloom.sources import rules as R
    from seedloom.sources.csvsink import CsvSink
    from seedloom.sources.datasets import DatasetStore
    from seedloom.sources.ddl import parse_single
    from seedloom.sources.warehouse import JdbcSink, TableSink, sample

    rules = R.load(a.rules)
    rules = replace(rules, **{k: v for k, v in (("rows", a.rows), ("seed", a.seed)) if v is not None}, truncate_before_load=a.truncate or rules.truncate_before_load)
    R.validate(rules)
    table = parse_single(Path(a.ddl).read_text("utf-8"), a.table or rules.table)
    datasets = DatasetStore.beside(a.rules)
    lookups = genplan.build(table, rules, datasets).lookups
    w = warehouse(a) if a.warehouse else None
    if lookups and w is None:
        raise ConfigError(f"columns {', '.join(lookups)} look up values: --warehouse is needed")
    if w is None and not a.csv and not a.jdbc and not a.dry_run:
        raise ConfigError("one of --warehouse, --csv, --jdbc and --dry-run is needed")
    g = Generator(session(), table, rules, datasets, {c: w.sql(q) for c, q in lookups.items()})
    for warning in g.plan.warnings:
        print(f"warning: {warning}", file=sys.stderr)
    if a.dry_run:
        print("\n".join(sample(g.frame(with_row=True), ROW)))
        return OK
    frame = g.frame()
    g.check_unique(frame)
    sink = CsvSink(a.csv, single=a.csv.endswith(".csv")) if a.csv else JdbcSink(a.jdbc, table.full_name, rules.batch_size) if a.jdbc else TableSink(w, table)
    n = sink.load(frame, rules.truncate_before_load)
    for column, cut in g.truncations().items():
        print(f"warning: {cut} values of {column!r} were cut to its length", file=sys.stderr)
    results = evaluate.run(rules.evaluations, w.sql) if w is not None and not a.csv and not a.jdbc else []
    return told(results, a.json, {"rows": n})


def told(results, as_json: bool, more: dict) -> int:
    from seedloom.operators import evaluate

    passed = all(r.passed for r in results)
    if as_json:
        print(json.dumps(more | {"passed": passed, "evaluations": [vars(r) for r in results]}, default=str))
    else:
        print("\n".join([f"{k}: {v}" for k, v in more.items()] + evaluate.lines(results)))
    return OK if passed else EVALUATION


def evaluate_(a) -> int:
    from seedloom.operators import evaluate
    from seedloom.sources import rules as R

    return told(evaluate.run(R.load(a.rules).evaluations, warehouse(a).sql), a.json, {})


def patch(a) -> int:
    from seedloom.functions import generators
    from seedloom.operators import audit, lint, repair
    from seedloom.operators.survey import survey
    from seedloom.sources import artifacts as A
    from seedloom.sources import gaprules

    folder = Path(getattr(a, "artifacts", None) or "artifacts")
    verb = a.patch
    if verb == "generators":
        print("\n".join([f"random   {k}" for k in generators.random_keys()] + [f"derived  {k}" for k in generators.derived_keys()] + ["dataset  dataset.<name>[.<column>]"]))
        return OK
    if verb == "lint":
        doc = lint.lint(a.rules, A.read_json(a.survey) if a.survey else None, a.tests)
        print("\n".join(f["message"] for f in doc["findings"]) or "no findings")
        return OK if doc["verdict"] == "pass" else ConfigError.code
    if verb == "approve":
        print("\n".join(repair.summary(A.read_json(folder / "plan.json"))))
        repair.approve(folder, a.email)
        return OK
    if verb == "dashboard":
        from seedloom.operators import dashboard

        A.write_text(Path(a.out or folder / "dashboard.html"), dashboard.page(folder))
        return OK
    if verb == "report":
        A.write_json(folder / "facts.json", doc := audit.facts(folder))
        if not (folder / "report.md").exists():
            A.write_text(folder / "report.md", audit.fallback(doc))
        result = audit.verdict(audit.audit_report((folder / "report.md").read_text("utf-8"), (folder / "facts.json").read_text("utf-8"), doc))
        A.write_json(folder / "report.audit.json", result)
        print(result["verdict"])
        return OK if result["verdict"] == "pass" else ConfigError.code
    if verb == "notary":
        doc = audit.notary(folder, a.rules, a.repository)
        print("\n".join(f"{v['kind']}: {v['detail']}" for v in doc["violations"]) or doc["verdict"])
        return OK if doc["verdict"] == "pass" else ConfigError.code
    everything = gaprules.load(a.rules)
    rules = everything.only(a.only.split(",") if a.only else None)
    w = warehouse(a)
    if verb == "survey":
        doc = survey(w, everything.covering)
        A.write_json(folder / "survey.json", {"ts": A.now(), **doc})
        for t in doc["tables"]:
            print("\n".join(f"{t['table']}.{c['name']}: {'; '.join(c['signals'])}" for c in t["columns"] if c["signals"] and not c["coveredByRule"]))
        return OK
    checks = gaprules.consumer_checks(getattr(a, "consumer", None))
    if verb == "run":
        doc = repair.run(w, rules, folder, checks, a.seed or 0, A.sha256(a.rules), a.email, a.yes)
        print("\n".join(repair.summary(doc["plan"])))
        if "verify" in doc:
            print(json.dumps({k: doc["verify"][k] for k in ("l1", "l2", "l3", "regressions", "preexistingReds", "remainingPlannedGaps")}))
            return repair.exit_code(doc["verify"])
        return OK
    if verb == "plan":
        doc = repair.plan(w, rules, a.seed or 0, A.sha256(a.rules))
        A.write_json(folder / "plan.json", doc)
        A.write_json(folder / "baseline.json", repair.baseline(w, rules, checks, doc["runId"]))
        print("\n".join(repair.summary(doc)))
    elif verb == "apply":
        print(f"{repair.apply(w, rules, folder).count()} patches")
    elif verb == "verify":
        doc = repair.verify(w, rules, A.read_json(folder / "plan.json"), A.read_json(folder / "baseline.json"), checks)
        A.write_json(folder / "verify.json", doc)
        print(json.dumps({k: doc[k] for k in ("l1", "l2", "l3", "regressions", "preexistingReds", "remainingPlannedGaps")}))
        return repair.exit_code(doc)
    elif verb == "revert":
        print(f"{repair.revert(w, rules if a.only else everything, repair.run_log(w, A.read_json(folder / 'plan.json')['runId']), a.only.split(',') if a.only else None)} cells")
    return OK


def damage(a) -> int:
    from seedloom.operators.corrupt import corrupt, first_keys

    w = warehouse(a)
    if not a.table:
        raise ConfigError("--table is needed")
    keys = a.keys.split(",") if a.keys else first_keys(w, a.table, a.key, f"`{a.column}` is not null", a.first) if a.first else []
    rows = json.loads(a.insert) if a.insert else []
    print(f"{corrupt(w, {(a.table, a.key): [(k, a.column, a.value) for k in keys]} if keys else {}, {a.table: rows} if rows else None)} cells and rows")
    return OK


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return {"init": init, "generate": generate, "evaluate": evaluate_, "patch": patch, "sample": damage}[a.verb](a)
    except SeedloomError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.code


if __name__ == "__main__":
    sys.exit(main())
