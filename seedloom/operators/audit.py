"""Facts of a run, reports held against them, and the notary that checks a run's artifacts against each other."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seedloom.operators import repair
from seedloom.operators.digest import rows_digest
from seedloom.sources import artifacts as A

NUMBER = re.compile(r"(?<![\w.])-?\d+(?:\.\d+)?(?![\w.])")
SAMPLES = 3
REQUIRED = ("plan.json", "plan.approved", "patches.json", "verify.json", "facts.json")


def patch_facts(log: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """rule, patched, samples of a patch log with rule, seq and id columns: the count and the first ids of each rule."""
    ranked = log.withColumn("r", F.row_number().over(W.partitionBy("rule").orderBy("seq")))
    first = ranked.filter(F.col("r") <= samples).groupBy("rule").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("samples"))
    return log.groupBy("rule").agg(F.count("*").alias("patched")).join(first, "rule", "left")


def facts(folder: str | Path, spark: SparkSession | None = None) -> dict:
    """What a report may say, from the run's other artifacts and its tables. New identities are listed, since a report must
    name each of them; they come one part of the table at a time."""
    f, spark = Path(folder), spark or SparkSession.builder.getOrCreate()
    plan, verify, approval, done = (A.read_json(f / n) for n in ("plan.json", "verify.json", "plan.approved", "patches.json"))
    log = repair.log_rows(spark, done)
    examples: dict[str, list[dict]] = {}
    for x in repair.first_rows(log, SAMPLES, "id").collect():
        examples.setdefault(x["rule"], []).append({"id": {x["keyColumn"]: x["id"]}, "old": x["old"], "new": x["new"]})
    rules = [{"id": r["id"], "column": r["column"], "kind": r["kind"], "patched": done["rules"].get(r["id"], 0), "samples": examples.get(r["id"], []), "reason": r["reason"], "skipped": r["skipped"], "skippedExamples": r["skippedExamples"]} for r in plan["rules"]]
    key = {r["id"]: r["key"] for r in plan["rules"]}
    minted = repair.patch_rows(spark, plan).filter("minted").orderBy("rule", F.length("key"), "key").select("rule", "key", "value") if any(r["newIdentities"] for r in plan["rules"]) else None
    return A.prune({
        "runId": plan["runId"], "planSha": A.sha256(f / "plan.json"), "rulesSha": plan["rulesSha"], "approver": approval.get("gitEmail") or approval.get("osUser"), "ts": approval["timestampUtc"], "rules": rules,
        "newIdentities": [{"key": {key[x["rule"]]: x["key"]}, "value": x["value"]} for x in minted.toLocalIterator()] if minted is not None else [], "verify": {k: verify[k] for k in ("l1", "l2", "l3", "regressions", "preexistingReds")},
    })


def audit_report(report: str, facts_text: str, doc: dict) -> list[dict]:
    """Rules and identities that a report leaves out, and numbers in it that the facts don't hold. Fenced blocks are quotes."""
    out = [{"kind": "missing-rule", "detail": f"rule {r['id']!r} is not in the report"} for r in doc["rules"] if r["id"].lower() not in report.lower()]
    out += [{"kind": "missing-identity", "detail": f"new identity {i['value']!r} is not in the report"} for i in doc["newIdentities"] if i["value"] not in report]
    known = set(NUMBER.findall(facts_text))
    prose = re.sub(r"```.*?```", "", report, flags=re.S)
    return out + [{"kind": "unsourced-number", "detail": f"the number {n!r} is in the report but not in the facts"} for n in dict.fromkeys(NUMBER.findall(prose)) if n not in known]


def verdict(violations: list[dict]) -> dict:
    return {"verdict": "fail" if violations else "pass", "violations": violations}


def fallback(doc: dict) -> str:
    """A report that only repeats the facts, and so passes its audit. Nothing is counted here."""
    # Whole hashes: of a part of one that has digits only the facts would know nothing.
    spelled = lambda sha: f"`{sha}`" if sha else "(none)"
    key = lambda k: ", ".join(f"{a} {b}" for a, b in k.items())
    lines = ["# Repair run", "", f"Run `{doc['runId']}`, plan {spelled(doc['planSha'])}, rules {spelled(doc['rulesSha'])}, approved by {doc.get('approver', 'nobody known')} at {doc['ts']}.", "", "| rule | column | kind | patched | skipped |", "|---|---|---|---|---|"]
    for r in doc["rules"]:
        lines.append(f"| {r['id']} | {r['column']} | {r['kind']} | {r['patched']} | {'none' if not r['skipped'] else str(r['skipped']) + ', first ' + '; '.join(key(s['key']) for s in r['skippedExamples'])} |")
    lines += ["", "New identities, permanent:", ""] + [f"- {key(i['key'])}: `{i['value']}`" for i in doc["newIdentities"]] + (["- none"] if not doc["newIdentities"] else [])
    v = doc["verify"]
    lines += ["", *[f"- {what}: {'pass' if v[k] else 'FAIL'}" for k, what in (("l1", "planned gaps"), ("l2", "invariants"), ("l3", "consumer checks"))]]
    lines += [f"- regressions: {', '.join(v['regressions']) or 'none'}", f"- failed before as well: {', '.join(v['preexistingReds']) or 'none'}"]
    return "\n".join(lines) + "\n"


def last_author(repository: str | Path, path: str | Path) -> str | None:
    got = subprocess.run(["git", "-C", str(repository), "log", "-1", "--format=%ae", "--", str(path)], capture_output=True, text=True)
    return got.stdout.strip() or None


def notary(folder: str | Path, rules_path: str | Path, repository: str | Path | None = None, spark: SparkSession | None = None) -> dict:
    """Whether a run's artifacts fit each other, its rules and its approval; with a repository also whether the approver
    is somebody else than the last author of the rules or datasets."""
    f, rules_path, spark = Path(folder), Path(rules_path), spark or SparkSession.builder.getOrCreate()
    missing = [{"kind": "missing-artifact", "detail": f"{n} is missing"} for n in REQUIRED if not (f / n).exists()]
    if missing:
        return verdict(missing)
    out = []
    plan, approval = A.read_json(f / "plan.json"), A.read_json(f / "plan.approved")
    if A.sha256(f / "plan.json") != approval["sha256"].lower():
        out.append({"kind": "plan-hash", "detail": "plan.json is not what was approved"})
    done = A.read_json(f / "patches.json")
    for holds, kind, detail in ((lambda: repair.rows_sha(spark, plan) == plan["rowsSha"], "plan-rows", "the plan's rows are not what was approved"), (lambda: rows_digest(repair.log_rows(spark, done)) == done["rowsSha"], "log-rows", "the log is not what was applied")):
        if not holds():
            out.append({"kind": kind, "detail": detail})
    if A.sha256(rules_path) != plan["rulesSha"].lower():
        out.append({"kind": "rules-drift", "detail": f"{rules_path.name} is not what the plan was made from"})
    committed, again = A.read_json(f / "facts.json"), facts(f, spark)
    out += [{"kind": "facts-drift", "detail": f"facts.json differs in {k}"} for k in sorted({*committed, *again}) if committed.get(k) != again.get(k)]
    if (f / "report.md").exists():
        out += audit_report((f / "report.md").read_text("utf-8"), (f / "facts.json").read_text("utf-8"), committed)
    if repository is not None:
        email = (approval.get("gitEmail") or "").lower()
        for source in [rules_path, *sorted((rules_path.parent / "datasets").glob("*.yaml"))]:
            if email and (last_author(repository, source.resolve()) or "").lower() == email:
                out.append({"kind": "four-eyes", "detail": f"{email} approved a run of rules that they changed last ({source.name})"})
    return verdict(out)
