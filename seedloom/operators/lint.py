"""Lint of gap rules: everything that is wrong, at once, without a session."""

from __future__ import annotations

import re
from pathlib import Path

from seedloom.errors import ConfigError
from seedloom.plans.dialect import unbracketed
from seedloom.sources import gaprules
from seedloom.sources.datasets import DatasetStore


def lint(rules_path: str | Path, survey: dict | None = None, tests: str | Path | None = None) -> dict:
    path, out = Path(rules_path), []
    say = lambda rule, check, message: out.append({"rule": rule, "check": check, "message": message})
    datasets = DatasetStore()
    try:
        datasets = DatasetStore.beside(path)
    except ConfigError as e:
        say("", "datasets", str(e))
    rules = []
    try:
        if not path.exists():
            raise ConfigError(f"no such rules file: {path}")
        rules = gaprules.read(path.read_text("utf-8"), str(path))
    except ConfigError as e:
        say("", "schema", str(e))
    for message in gaprules.findings(gaprules.GapRules(tuple(rules), datasets)):
        found = re.match(r"rule '([^']+)'", message)
        say(found[1] if found else "", "schema", message)
    for r in rules:
        if survey is not None:
            threshold(r, survey, say)
        conventions(r, tests, say)
    return {"verdict": "fail" if out else "pass", "findings": out}


def threshold(r: gaprules.GapRule, survey: dict, say) -> None:
    """A NULL-shaped gap with more NULLs than the threshold would be blocked."""
    try:
        name = unbracketed(r.table).lower()
    except ConfigError:
        return
    columns = [c for t in survey["tables"] if unbracketed(t["table"]).lower() == name for c in t["columns"] if c["name"].lower() == r.column.lower()]
    plain = re.sub(r"[\[\]]", "", r.gap).lower()
    if columns and f"{r.column.lower()} is null" in plain and columns[0]["nulls"] > r.threshold:
        say(r.id, "threshold", f"rule {r.id!r}: threshold {r.threshold} is below the {columns[0]['nulls']} NULLs surveyed in {r.table}.{r.column}; the gate would block it")


def conventions(r: gaprules.GapRule, tests: str | Path | None, say) -> None:
    """A derived generator needs an invariant of its own, a parametrized boundary test and one that refuses NULL."""
    if r.kind != "derived" or DatasetStore.is_key(r.fix):
        return
    if not (r.invariant or "").strip():
        say(r.id, "invariant", f"rule {r.id!r}: a derived rule needs an invariant, written apart from the generator")
    if tests is None or not Path(tests).is_dir():
        say(r.id, "tests", f"rule {r.id!r}: there is no test folder {str(tests)!r}")
        return
    texts = [t for p in sorted(Path(tests).rglob("*.py")) if r.fix.lower() in (t := p.read_text("utf-8")).lower()]
    whole = "\n".join(texts)
    if not texts:
        say(r.id, "tests", f"rule {r.id!r}: no test mentions {r.fix!r}")
        return
    if "parametrize" not in whole:
        say(r.id, "tests", f"rule {r.id!r}: no parametrized test covers the boundary values of {r.fix!r}")
    if not re.search(r"(?i)refuse\w*null|null\w*refuse", whole):
        say(r.id, "tests", f"rule {r.id!r}: no test of {r.fix!r} refuses a NULL input")
