"""One HTML page of a repair run's artifacts, for people who approve or look back."""

from __future__ import annotations

from html import escape
from pathlib import Path

from seedloom.sources import artifacts as A

STYLE = "body{font:15px sans-serif;margin:2em;max-width:70em}table{border-collapse:collapse;margin:1em 0}td,th{border:1px solid #bbb;padding:.3em .6em;text-align:left}.bad{background:#fdd}.good{background:#dfd}"


def table(head: list[str], rows: list[list[object]], bad=lambda row: None) -> str:
    """bad(row): true or false colours a row."""
    cells = lambda tag, row: "".join(f"<{tag}>{escape('' if x is None else str(x))}</{tag}>" for x in row)
    colour = {True: " class=bad", False: " class=good", None: ""}
    return f"<table><tr>{cells('th', head)}</tr>" + "".join(f"<tr{colour[bad(r)]}>{cells('td', r)}</tr>" for r in rows) + "</table>"


def page(folder: str | Path) -> str:
    """Sections for those artifacts that there are."""
    f = Path(folder)
    read = lambda name: A.read_json(f / name) if (f / name).exists() else None
    parts = []
    if survey := read("survey.json"):
        rows = [[t["table"], c["name"], c["nulls"], c["distinct"], "; ".join(c["signals"]), c["coveredByRule"]] for t in survey["tables"] for c in t["columns"] if c["signals"]]
        parts.append("<h2>Survey</h2>" + table(["table", "column", "nulls", "distinct", "signals", "rule"], rows, lambda r: None if r[5] else True))
    if plan := read("plan.json"):
        rows = [[r["id"], f"{r['table']}.{r['column']}", r["kind"], r["status"], r["count"], r["threshold"], r["patches"], r["skipped"], r["newIdentities"]] for r in plan["rules"]]
        parts.append("<h2>Plan</h2>" + table(["rule", "column", "kind", "status", "rows", "threshold", "patches", "skipped", "new identities"], rows, lambda r: r[3] == "BLOCKED"))
    if approval := read("plan.approved"):
        parts.append("<h2>Approval</h2>" + table(["by", "at", "plan"], [[approval.get("gitEmail") or approval.get("osUser"), approval["timestampUtc"], approval["sha256"]]]))
    if patches := read("patches.json"):
        parts.append("<h2>Patches</h2>" + table(["rule", "cells"], [[k, n] for k, n in patches["rules"].items()]))
    if verify := read("verify.json"):
        rows = [["planned gaps closed", verify["l1"]], ["invariants", verify["l2"]], ["consumer checks", verify["l3"]]]
        parts.append("<h2>Verification</h2>" + table(["layer", "passed"], rows, lambda r: not r[1]) + table(["regressions", "failed before as well"], [[", ".join(verify["regressions"]), ", ".join(verify["preexistingReds"])]]))
    title = f"Repair run {escape(str((plan or {}).get('runId', '')))}".strip()
    return f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{title}</title><style>{STYLE}</style></head><body><h1>{title}</h1>{''.join(parts) or '<p>No artifacts yet.</p>'}</body></html>"
