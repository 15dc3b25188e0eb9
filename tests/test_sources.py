import pytest
import yaml
from pyspark.sql import types as T
from shop import CUSTOMER_RULES, CUSTOMERS

from seedloom import cli
from seedloom.errors import AllowlistError, ConfigError
from seedloom.operators import evaluate
from seedloom.operators.survey import survey
from seedloom.plans import infer as I
from seedloom.plans.dialect import check_predicate, translate_sql
from seedloom.sources import csvsink
from seedloom.sources import rules as R
from seedloom.sources.csvsink import CsvSink
from seedloom.sources.datasets import Dataset, DatasetStore, from_mapping
from seedloom.sources.ddl import parse_script, parse_single
from seedloom.sources.rules import Evaluation, Expectation
from seedloom.sources.warehouse import Files, JdbcSink, Warehouse, guard, sample


def test_ddl():
    countries, customers = parse_script(CUSTOMERS)
    assert [countries.full_name, customers.qualified] == ["dbo.Countries", "[dbo].[Customers]"]
    c = {x.name: x for x in customers.columns}
    assert c["CustomerId"].identity == (1, 1) and c["CustomerId"].primary_key and not c["CustomerId"].nullable
    assert (c["CreditLimit"].precision, c["CreditLimit"].scale, c["CreditLimit"].default) == (12, 2, "(0)") and c["Notes"].length == -1 and c["Email"].unique
    assert c["FullName"].computed == "FirstName + N' ' + Status" and c["FullName"].db_generated and c["RowVer"].db_generated
    assert customers.foreign_keys[0].table == "dbo.Countries" and len(customers.checks) == 2
    assert customers.struct()["CreditLimit"].dataType == T.DecimalType(12, 2) and customers.struct()["CreatedAt"].dataType == T.TimestampNTZType() and "RowVer" not in customers.struct().names
    assert parse_single(CUSTOMERS, "customers").name == "Customers"


def test_ddl_table_constraints_and_odd_names():
    t = parse_single('CREATE TABLE [Sales].[Order]]s] ([Group] NVARCHAR(50) NOT NULL, "b c" decimal, A INT IDENTITY(5,10), CONSTRAINT pk PRIMARY KEY CLUSTERED ([Group] ASC, A), FOREIGN KEY (A) REFERENCES X.Y (Z) ON DELETE CASCADE, UNIQUE ("b c"), CHECK (A > (1)))')
    assert t.name == "Order]s" and t.primary_key == ("Group", "A") and t.columns[1].unique and t.columns[2].identity == (5, 10) and t.checks == ("A > (1)",)
    assert t.columns[1].spark_type() == T.DecimalType(18, 0)


@pytest.mark.parametrize(("ddl", "message"), [("SELECT 1", "no CREATE TABLE"), ("CREATE TABLE T (A INT,\n B INT NOT)", "line 2"), ("CREATE TABLE T (A INT, PRIMARY KEY (B))", "unknown column"), ("CREATE TABLE T (A INT) CREATE TABLE U (A INT)", "name one of")])
def test_ddl_errors(ddl, message):
    with pytest.raises(ConfigError, match=message):
        parse_single(ddl)


@pytest.mark.parametrize(("text", "message"), [
    ("rows: 0", "rows"), ("batchSize: -1", "batchSize"), ("columns: {A: }", "empty"), ("columns: {A: {strategy: int, nullRate: 1.5}}", "nullRate"), ("columns: {A: {strategy: pick}}", "values"),
    ("columns: {A: {strategy: pick, values: [a, b], weights: [1]}}", "weights"), ("columns: {A: {strategy: template}}", "template"), ("columns: {A: {strategy: faker}}", "method"), ("columns: {A: {strategy: dataset}}", "dataset"),
    ("evaluations: [{name: a, query: q}, {name: A, query: q}]", "duplicate"), ("evaluations: [{name: a}]", "query"), ("evaluations: [{name: a, query: q, expect: {equals: 1, min: 2}}]", "only one"),
    ("evaluations: [{name: a, query: q, expect: {between: [1]}}]", "between"), ("rows: [", "line"), ("rows: many", "rows"),
])
def test_rules_errors(text, message):
    with pytest.raises(ConfigError, match=message):
        R.loads(text)


def test_rules_and_unknown_keys():
    r = R.loads("rows: 5\nother: 1\ncolumns:\n  Email: {strategy: constant, value: 007, more: x}\n")
    assert r.rule("EMAIL").value == "007" and r.rule("nope") is None and R.loads(CUSTOMER_RULES).evaluations[3].expect.between == ("0.85", "0.95")


@pytest.mark.parametrize(("doc", "message"), [
    ({"columns": ["A"], "rows": [["1", "2"]]}, "row 1"), ({"columns": ["A"], "rows": [["1"]], "weights": [1, 2]}, "weights"), ({"columns": ["A"], "rows": [["1"]], "weights": [0]}, "positive"),
    ({"columns": ["A"], "rows": [["1"]], "match": {"B": ["x"]}}, "match"), ({"columns": ["A", "a"], "rows": [["1", "2"]]}, "differ"), ({"columns": ["A"], "rows": []}, "no rows"),
])
def test_dataset_errors(doc, message):
    with pytest.raises(ConfigError, match=message):
        from_mapping("d", doc)
    with pytest.raises(ConfigError, match="'.'"):
        Dataset("a.b", ("A",), (("1",),))


def test_inference():
    t = parse_single(CUSTOMERS, "Customers")
    got = {c.name: I.infer(c, t) for c in t.columns}
    assert got["CustomerId"].strategy == got["RowVer"].strategy == "skip" and got["CreditLimit"].strategy == "dbDefault" and got["CountryCode"].query == "SELECT [CountryCode] FROM dbo.Countries"
    assert (got["Email"].method, got["Email"].unique) == ("internet.email", True) and got["Phone"].null_rate == 0.1 and got["BirthDate"].strategy == "date" and got["ExternalId"].strategy == "guid"
    key = lambda ddl: I.infer((t := parse_single(f"CREATE TABLE K (Id {ddl} PRIMARY KEY)")).columns[0], t)
    assert key("CHAR(4)").strategy == "string" and key("VARCHAR(20)").template == "ID-{row}" and key("INT").strategy == "sequence" and key("UNIQUEIDENTIFIER").strategy == "guid"
    d = DatasetStore([Dataset("c", ("Code",), (("x",),), None, {"Code": ("*currency_code",)})])
    t = parse_single("CREATE TABLE K (BaseCurrencyCode CHAR(3) NOT NULL, Price DECIMAL(8,2) NOT NULL)")
    assert I.infer(t.columns[0], t, d).dataset_column == "Code" and I.infer(t.columns[1], t).max == "999999"


def test_scaffold_round_trip():
    t = parse_single(CUSTOMERS, "Customers")
    text = I.scaffold(t, 50, 9)
    r = R.loads(text)
    assert (r.rows, r.seed) == (50, 9) and len(r.columns) == len(t.columns) and "CreditLimit >= 0" in text
    assert all(r.rule(c.name) == I.infer(c, t) for c in t.columns) and yaml.safe_load(text)["table"] == "dbo.Customers"
    assert [e.name for e in r.evaluations][0] == "row-count" and "Email-unique" in [e.name for e in r.evaluations]


def test_translation():
    names = {"dbo.a b": "v"}
    assert translate_sql("SELECT TOP (3) x FROM [dbo].[a b] WHERE y = N'it''s' ORDER BY x;", names).endswith("LIMIT 3") and "`v`" in translate_sql("SELECT [dbo].[a b].[c] FROM [dbo].[a b]", names)
    with pytest.raises(ConfigError):
        translate_sql("SELECT 1; SELECT 2")
    schema = T.StructType([T.StructField("A", T.IntegerType()), T.StructField("B", T.DoubleType()), T.StructField("C", T.StringType()), T.StructField("D", T.BooleanType())])
    assert " div " in check_predicate("A / 2 = 1", "T", schema) and " div " not in check_predicate("B / 2 = 1", "T", schema) and "||" in check_predicate("C + 'x' LIKE 'a%'", "T", schema)
    assert "boolean" in check_predicate("D = 1 AND A NOT IN (1, 2) AND NOT (A BETWEEN 1 AND 2)", "T", schema)


@pytest.mark.parametrize(("value", "expect", "passed"), [
    (5, Expectation(equals="5.0"), True), (0.93, Expectation(equals="0.9", tolerance=0.05), True), (0.96, Expectation(equals="0.9", tolerance=0.05), False), (" Ab ", Expectation(equals="aB"), True),
    (None, Expectation(equals="null"), True), (None, Expectation(equals="0"), False), (5, Expectation(min="5", max="20"), True), (21, Expectation(min="5", max="20"), False), (0.95, Expectation(between=("0.85", "0.95")), True),
    ("x", Expectation(min="1"), False), (None, Expectation(min="1"), False), (3, Expectation(), True),
])
def test_expectations(value, expect, passed):
    r = evaluate.judge(Evaluation("e", "q", expect), value)
    assert r.passed is passed and (r.error is not None) == (value in ("x", None) and expect.min is not None)
    assert evaluate.judge(Evaluation("e", "q"), value).informational


def test_survey(spark, tmp_path):
    t = parse_single("CREATE TABLE dbo.House (HouseId INT NOT NULL PRIMARY KEY, EnergyClass VARCHAR(9), Legacy VARCHAR(9), Note VARCHAR(20), [Group] VARCHAR(9))")
    rows = [(i, None if i % 4 == 0 else "X9" if i % 5 == 0 else "ABC"[i % 3], "0" if i <= 15 else "live", "always here", "Jo" if i % 2 == 0 else None) for i in range(1, 21)]
    w = Warehouse(spark, str(tmp_path / "w"))
    w.create(t, spark.createDataFrame(rows, t.struct()))
    before = w.manifest()
    doc = survey(w, lambda table, column: "R" if column == "Note" else None)
    assert w.manifest() == before
    c = {x["name"]: x for x in doc["tables"][0]["columns"]}
    assert (c["EnergyClass"]["nulls"], c["EnergyClass"]["nullRate"]) == (5, 0.25) and c["EnergyClass"]["signals"] == ["25% of rows NULL"] and sum(v["count"] for v in c["EnergyClass"]["topValues"]) == 15
    assert any("placeholder" in s for s in c["Legacy"]["signals"]) and "NULL allowed, none found" in c["Note"]["signals"] and c["HouseId"]["isKey"] and not c["HouseId"]["signals"] and c["Note"]["coveredByRule"] == "R"
    empty = parse_single("CREATE TABLE dbo.None1 (A INT)")
    w.create(empty)
    assert survey(w, tables=["dbo.None1"])["tables"][0]["columns"][0]["signals"] == ["no rows"]


def test_warehouse_csv_and_guard(spark, tmp_path):
    root = str(tmp_path / "w")
    guard(root, [f"file://{root}/"])
    for bad in ("/elsewhere", "jdbc://u:password@h/x"):
        with pytest.raises(AllowlistError):
            Warehouse(spark, bad, [root])
    with pytest.raises(ConfigError):
        Warehouse(spark, ":memory:")
    frame = spark.createDataFrame([(1, True, 'a"b,c', bytearray(b"\x01\xff"), None), (2, False, "x\ny", None, "z")], "k int, b boolean, s string, r binary, n string")
    assert list(sample(frame, "k", 1)) == ["b | s | r | n", '1 | a"b,c | 0x01FF | NULL']
    assert CsvSink(str(tmp_path / "c.csv"), single=True).load(frame) == 2
    assert (tmp_path / "c.csv").read_text() == 'k,b,s,r,n\n1,1,"a""b,c",0x01FF,\n2,0,"x\ny",,z\n'
    assert CsvSink(str(tmp_path / "c")).load(frame.repartition(2, "k")) == 2
    assert all(f.read_text().startswith("k,b,s,r,n\n") for f in (tmp_path / "c").glob("*.csv"))


def csv_rows(spark, n):
    """Rows of different lengths over 7 tasks, some of them without any; a name and a cell that need quotes."""
    from pyspark.sql import functions as F

    return spark.range(0, n, 1, 7).filter("id not between 280 and 700").select("id", F.expr("repeat('ab', CAST(id % 90 AS INT))").alias('the "text"'), F.expr("IF(id % 3 = 0, NULL, concat('ü,', id))").alias("n"))


def csv_text(n):
    cell = lambda k: "" if k % 3 == 0 else f'"ü,{k}"'
    return 'id,"the ""text""",n\n' + "".join(f"{k},{'ab' * (k % 90)},{cell(k)}\n" for k in range(n) if not 280 <= k <= 700)


def test_single_csv_is_written_by_all_tasks(spark, tmp_path):
    path = tmp_path / "a" / "t.csv"
    sink = CsvSink(str(path), single=True)
    assert sink.load(csv_rows(spark, 2000)) == 1579 and path.read_text() == csv_text(2000)
    with pytest.raises(ConfigError):
        sink.load(csv_rows(spark, 10))
    assert path.read_text() == csv_text(2000)
    assert sink.load(csv_rows(spark, 1000), truncate=True) == 579 and path.read_text() == csv_text(1000)
    assert sink.load(csv_rows(spark, 0), truncate=True) == 0 and path.read_text() == csv_text(0)
    assert [f.name for f in path.parent.iterdir()] == ["t.csv"]  # no parts and no sums of the former file are left


def test_single_csv_by_concatenation(spark, tmp_path, monkeypatch):
    """A file system that can concatenate is asked once, for all parts in the order of tasks; it moves them behind the first."""
    asked = []

    class Fs:
        def __init__(self, files):
            self.files = files

        def concat(self, first, others):
            asked.append(1 + len(others))
            with open(first.toUri().getPath(), "ab") as f:
                for o in others:
                    f.write(open(o.toUri().getPath(), "rb").read())

        def __getattr__(self, name):
            return getattr(self.files.raw, name)

    whole = csvsink.concatenated

    def concatenated(files, parts):
        files.raw = files.fs.getRawFileSystem()  # without sums, as the file grows behind its back
        files.fs = Fs(files)
        return whole(files, parts)

    monkeypatch.setattr(csvsink, "joining", lambda files: "concat")
    monkeypatch.setattr(csvsink, "concatenated", concatenated)
    CsvSink(str(tmp_path / "t.csv"), single=True).load(csv_rows(spark, 2000))
    assert (tmp_path / "t.csv").read_text() == csv_text(2000) and asked == [7]  # the header and 6 parts with rows


def test_single_csv_where_files_cant_be_joined(spark, tmp_path, monkeypatch):
    import json

    monkeypatch.setattr(csvsink, "joining", lambda files: None)
    sink = CsvSink(str(tmp_path / "t"), single=True)
    for n in (1000, 2000):
        sink.load(csv_rows(spark, n), truncate=n == 2000)
        parts = json.loads((tmp_path / "t/parts.json").read_text())
        texts = [(tmp_path / "t" / p["name"]).read_bytes() for p in parts]
        assert b"".join(texts).decode() == csv_text(n) and [len(x) for x in texts] == [p["bytes"] for p in parts]


def test_parts_are_in_the_order_of_tasks(spark, tmp_path):
    for name in ("part-99999-u-c000.csv", "part-100000-u-c000.csv", "part-00002-u-c001.csv", "part-00002-u-c010.csv", "part-00002-u-c002.csv", "_SUCCESS"):
        (tmp_path / name).write_text("x")
    (tmp_path / "part-00001-u-c000.csv").write_text("")
    found = csvsink.parts_of(Files(spark, str(tmp_path.parent)), tmp_path.name)
    assert [p.name.split("/")[1] for p in found] == ["part-00002-u-c001.csv", "part-00002-u-c002.csv", "part-00002-u-c010.csv", "part-99999-u-c000.csv", "part-100000-u-c000.csv"]


def test_cli(spark, tmp_path, capsys):
    ddl, rules = tmp_path / "d.sql", tmp_path / "r.yaml"
    ddl.write_text("CREATE TABLE dbo.T (Id INT IDENTITY PRIMARY KEY, Name NVARCHAR(40) NOT NULL, Age INT NULL)")
    assert cli.main(["init", "--ddl", str(ddl), "--rows", "20", "--out", str(rules)]) == 0
    assert cli.main(["generate", "--ddl", str(ddl), "--rules", str(rules), "--dry-run"]) == 0
    assert cli.main(["generate", "--ddl", str(ddl), "--rules", str(rules), "--warehouse", str(tmp_path / "w"), "--truncate"]) == 0
    assert "PASS row-count" in capsys.readouterr().out
    rules.write_text(rules.read_text().replace("equals: 20", "equals: 21"))
    assert cli.main(["evaluate", "--rules", str(rules), "--warehouse", str(tmp_path / "w"), "--json"]) == 40
    assert cli.main(["generate", "--ddl", str(ddl), "--rules", str(tmp_path / "none.yaml"), "--dry-run"]) == 2
    gaps, run = tmp_path / "gaps.yaml", str(tmp_path / "run")
    gaps.write_text("rules:\n  - {id: A, table: dbo.T, key: Id, column: Age, kind: ephemeral, gap: Age IS NULL, fix: property.yearBuilt, threshold: 20, reason: r}\n")
    base = ["--rules", str(gaps), "--warehouse", str(tmp_path / "w"), "--artifacts", run]
    assert cli.main(["patch", "lint", "--rules", str(gaps)]) == 0 and cli.main(["patch", "generators"]) == 0
    assert cli.main(["patch", "survey", *base]) == 0 and cli.main(["patch", "plan", *base]) == 0
    assert cli.main(["patch", "approve", "--artifacts", run, "--email", "a@example.test"]) == 0 and cli.main(["patch", "apply", *base]) == 0
    assert cli.main(["patch", "verify", *base]) == 0 and cli.main(["patch", "report", "--artifacts", run]) == 0
    assert cli.main(["patch", "notary", "--rules", str(gaps), "--artifacts", run]) == 0 and cli.main(["patch", "revert", *base]) == 0
    capsys.readouterr()
    assert cli.main(["sample", "damage", "--warehouse", str(tmp_path / "w"), "--table", "dbo.T", "--key", "Id", "--column", "Age", "--first", "2", "--insert", '[{"Id": 99, "Name": "New"}, {"Id": 1, "Name": "there"}]']) == 0
    assert "3 cells and rows" in capsys.readouterr().out
    again = [*base[:-1], str(tmp_path / "again")]
    assert cli.main(["patch", "run", *again]) == 0 and not (tmp_path / "again/plan.approved").exists()
    assert cli.main(["patch", "run", *again, "--yes", "--email", "a@example.test"]) == 0 and (tmp_path / "again/report.md").exists()
    assert cli.main(["patch", "dashboard", "--artifacts", str(tmp_path / "again")]) == 0 and "<h2>Verification</h2>" in (tmp_path / "again/dashboard.html").read_text()
    allow = tmp_path / "allow.json"
    allow.write_text('["/elsewhere"]')
    assert cli.main(["patch", "survey", *base, "--allowlist", str(allow)]) == 4


def test_jdbc_sink(spark, tmp_path):
    """Into a database that comes with Spark, by the sink and by the command line."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    frame = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    sink = JdbcSink(url, "T1", batch_size=1)
    assert sink.load(frame) == 2 and sink.load(frame) == 2 and sink.load(frame, truncate=True) == 2
    read = lambda name: spark.read.format("jdbc").options(url=url, dbtable=name).load()
    assert sorted(map(tuple, read("T1").collect())) == [(1, "a"), (2, None)]
    ddl, rules = tmp_path / "d.sql", tmp_path / "r.yaml"
    ddl.write_text("CREATE TABLE App.Names (Id INT NOT NULL PRIMARY KEY, Name NVARCHAR(40) NOT NULL)")
    rules.write_text("rows: 7\ncolumns:\n  Name: {strategy: constant, value: x}\n")
    assert cli.main(["generate", "--ddl", str(ddl), "--rules", str(rules), "--jdbc", url]) == 0
    assert read("App.Names").count() == 7


def test_survey_takes_one_exchange_of_values_and_heavy_hitters_are_exact(spark):
    import random

    from pyspark.sql import functions as F

    from seedloom.operators import survey as S

    r = random.Random(3)
    rows = [(k, r.choice(["a", "a", "a", "b", "c", "d", "e", "f", None]), float(r.choice([0.0, -0.0, 1.5])), r.randrange(400), f"v{min(int(r.paretovariate(0.7)), 10**6)}", None) for k in range(20_000)]
    frame = spark.createDataFrame(rows, "id long, flag string, x double, part int, skewed string, empty int").repartition(5)
    exact, quick = (S.survey_table(frame, ["id"], approximate=a) for a in (False, True))
    columns = ["name", "rows", "nulls", "null_rate", "top_values"]
    assert exact.select(columns).collect() == quick.select(columns).collect()
    assert {r["name"]: r["distinct"] for r in exact.collect()} == {r["name"]: r["d"] for r in frame.select([F.count_distinct(c).alias(c) for c in frame.columns]).unpivot([], frame.columns, "name", "d").collect()}
    asked = S.candidates(frame)
    assert len(asked["id"][1]) <= S.TRACKED and set(asked["flag"][1]) == set("abcdef")
    exact.collect()
    text = exact._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert text.count("Generate explode") == text.count("ReusedExchange") == 1 or text.count("Generate explode") == 1, text
    nothing = frame.filter("id < 0")
    assert all(x["rows"] == 0 and list(x["signals"]) == ["no rows"] for a in (False, True) for x in S.survey_table(nothing, approximate=a).collect())
