"""Tables that depend on each other: generated, damaged, repaired, and repaired again by another seed."""

import pytest

from seedloom.operators import evaluate, repair
from seedloom.operators.corrupt import corrupt, first_keys
from seedloom.operators.generate import Generator
from seedloom.sources import artifacts as A
from seedloom.sources import gaprules
from seedloom.sources import rules as R
from seedloom.sources.datasets import Dataset, DatasetStore
from seedloom.sources.ddl import parse_script
from seedloom.sources.warehouse import TableSink, Warehouse

DDL = """
CREATE TABLE Person.Person (PersonID INT IDENTITY(1,1) PRIMARY KEY, FirstName NVARCHAR(50) NOT NULL, LastName NVARCHAR(50) NOT NULL);
CREATE TABLE Sales.Currency (CurrencyCode NCHAR(3) NOT NULL PRIMARY KEY, Name NVARCHAR(50) NULL, ModifiedDate DATETIME NOT NULL DEFAULT (GETDATE()));
CREATE TABLE Sales.Customer (CustomerID INT IDENTITY(1,1) PRIMARY KEY, PersonID INT NULL REFERENCES Person.Person(PersonID), [Group] NVARCHAR(10) NOT NULL, AccountNumber AS ('AW' + CONVERT(VARCHAR(9), CustomerID)));
"""
CODES = [(c, f"Name of {c}") for c in "AUD BRL CAD CHF CNY CZK DKK EUR GBP HUF INR JPY KRW MXN NOK NZD PLN SEK TRY USD ZAR XAF XOF XPF".split()]
DATASETS = DatasetStore([Dataset("currencies", ("CurrencyCode", "Name"), tuple(CODES), None, {"CurrencyCode": ("*currencycode",)})])
RULES = {
    "Person.Person": "rows: 200\nseed: 100\ncolumns:\n  FirstName: {strategy: faker, method: name.firstName}",
    "Sales.Currency": "rows: 24\nseed: 108\ncolumns:\n  CurrencyCode: {strategy: dataset, dataset: currencies, unique: true}\n  Name: {strategy: dataset, dataset: currencies}\n  ModifiedDate: {strategy: datetime}",
    "Sales.Customer": "rows: 100\nseed: 105\ncolumns:\n  PersonID: {strategy: query, query: 'SELECT PersonID FROM [Person].[Person]', unique: true}\n  Group: {strategy: pick, values: [north, south]}",
}
GAPS = """
rules:
  - {id: CUR-1, table: "[Sales].[Currency]", key: CurrencyCode, column: Name, kind: derived, gap: "Name IS NULL", fix: dataset.currencies, inputs: [CurrencyCode], threshold: 50, reason: names, invariant: "Name IS NOT NULL"}
  - {id: CUS-1, table: Sales.Customer, key: CustomerID, column: PersonID, kind: identity, gap: "PersonID IS NULL", fix: adventureworks.personId, threshold: 10, reason: persons}
"""
CHECKS = R.loads("""
evaluations:
  - {name: customers, query: "SELECT COUNT(*) FROM Sales.Customer", expect: {equals: 100}}
  - {name: orphans, query: "SELECT COUNT(*) FROM [Sales].[Customer] c LEFT JOIN [Person].[Person] p ON c.PersonID = p.PersonID WHERE c.PersonID IS NOT NULL AND p.PersonID IS NULL", expect: {equals: 0}}
  - {name: persons-once, query: "SELECT COUNT(PersonID) - COUNT(DISTINCT PersonID) FROM Sales.Customer", expect: {equals: 0}}
  - {name: groups, query: "SELECT COUNT(DISTINCT [Group]) FROM Sales.Customer", expect: {equals: 2}}
""").evaluations


@pytest.fixture(scope="module")
def w(spark, tmp_path_factory):
    out = Warehouse(spark, str(tmp_path_factory.mktemp("chain")))
    for t in parse_script(DDL):
        r = R.loads(RULES[t.full_name])
        lookups = {"PersonID": out.sql("SELECT PersonID FROM Person.Person")} if t.name == "Customer" else {}
        g = Generator(spark, t, r, DATASETS, lookups)
        assert not g.plan.warnings
        frame = g.frame()
        g.check_unique(frame)
        TableSink(out, t).load(frame)
    return out


def test_chain(w, tmp_path):
    assert all(x.passed for x in evaluate.run(CHECKS, w.sql)) and sorted(r[0] for r in w.table("Person.Person").select("PersonID").collect()) == list(range(1, 201))
    assert {r["CurrencyCode"]: r["Name"] for r in w.table("sales.currency").collect()} == dict(CODES)
    codes = first_keys(w, "Sales.Currency", "CurrencyCode", "Name IS NOT NULL", 14)
    n = corrupt(w, {("Sales.Customer", "CustomerID"): [(k, "PersonID", None) for k in ("1", "2", "3")], ("Sales.Currency", "CurrencyCode"): [(k, "Name", None) for k in codes]}, {"Sales.Currency": [{"CurrencyCode": "ZZZ"}, {"CurrencyCode": "EUR"}]})
    assert n == 18 and w.table("Sales.Currency").count() == 25
    rules = gaprules.loads(GAPS, DATASETS)
    plan = repair.plan(w, rules, 5)
    names, persons = repair.listed(w.spark, plan)["rules"]
    assert len(names["patches"]) == 14 and [s["key"]["CurrencyCode"] for s in names["skipped"]] == ["ZZZ"] and len(persons["newIdentities"]) == 3
    A.write_json(tmp_path / "plan.json", plan)
    before = repair.baseline(w, rules, CHECKS, plan["runId"])
    repair.approve(tmp_path, "a@example.test")
    log = repair.apply(w, rules, tmp_path)
    verified = repair.verify(w, rules, plan, before, CHECKS)
    assert log.count() == 17 and repair.exit_code(verified) == 0 and verified["preexistingReds"] == ["CUR-1.invariant"]
    assert {r["CurrencyCode"]: r["Name"] for r in w.table("Sales.Currency").collect()} == dict(CODES) | {"ZZZ": None}
    corrupt(w, {("Sales.Customer", "CustomerID"): [(k, "PersonID", None) for k in ("1", "2", "3")]})
    again = repair.listed(w.spark, repair.plan(w, rules, 77))["rules"][1]
    assert again["patches"] == persons["patches"] and not again["newIdentities"]
