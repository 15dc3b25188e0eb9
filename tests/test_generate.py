import pytest
from shop import COUNTRY_RULES, CUSTOMER_RULES, CUSTOMERS

from seedloom.errors import GenerationError
from seedloom.functions import faker
from seedloom.operators import evaluate
from seedloom.operators.generate import Generator
from seedloom.sources import rules as R
from seedloom.sources.datasets import Dataset, DatasetStore
from seedloom.sources.ddl import parse_single
from seedloom.sources.warehouse import TableSink, Warehouse

T = parse_single("""CREATE TABLE T (Id INT IDENTITY PRIMARY KEY, Code VARCHAR(10) NOT NULL, Age INT NOT NULL, Amount DECIMAL(10,2) NOT NULL, Born DATE NULL, Flag BIT NOT NULL,
    Ref UNIQUEIDENTIFIER NOT NULL, Status VARCHAR(8) NOT NULL, Seq BIGINT NOT NULL, Name NVARCHAR(5) NOT NULL, At TIME NOT NULL, Raw VARBINARY(9) NOT NULL)""")


def rules(rows=2000, seed=7, **more):
    columns = {
        "Code": "{strategy: template, template: 'C-{row}', unique: true}", "Age": "{strategy: int, min: 18, max: 65}", "Amount": "{strategy: decimal, min: 10, max: 99.5}",
        "Born": "{strategy: date, min: '1990-01-01', max: '2000-12-31', nullRate: 0.3}", "Flag": "{strategy: bool, trueRate: 0.8}", "Ref": "{strategy: guid, unique: true}",
        "Status": "{strategy: pick, values: [A, B, C], weights: [0.6, 0.3, 0.1]}", "Seq": "{strategy: sequence, start: 1000, step: 5}", "Name": "{strategy: faker, method: name.fullName}",
        "At": "{strategy: time}", "Raw": "{strategy: bytes}",
    } | more
    return R.loads(f"rows: {rows}\nseed: {seed}\ncolumns:\n" + "".join(f"  {k}: {v}\n" for k, v in columns.items()))


def test_values_follow_the_rules(spark):
    g = Generator(spark, T, rules())
    p = g.frame().toPandas()
    assert len(p) == 2000 and sorted(p.Id) == list(range(1, 2001))
    assert p.Age.between(18, 65).all() and p.Age.min() == 18 and p.Age.max() == 65
    assert all(10 <= a <= 99.5 and -a.as_tuple().exponent == 2 for a in p.Amount)
    assert 0.25 <= p.Born.isna().mean() <= 0.35 and 0.75 <= p.Flag.mean() <= 0.85
    counts = p.Status.value_counts()
    assert counts["A"] > 3 * counts["C"]
    assert p.Code.is_unique and p.Ref.is_unique and p.Ref.str.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}").all()
    assert sorted(p.Seq) == list(range(1000, 1000 + 5 * 2000, 5))
    assert (p.Name.str.len() <= 5).all() and g.truncations()["Name"] > 1900
    assert p.At.str.fullmatch(r"[0-2]\d:[0-5]\d:[0-5]\d").all() and (p.Raw.map(len) == 9).all()


def test_same_seed_same_rows_on_any_partitioning(spark):
    a, b, c = (Generator(spark, T, rules(300, seed), partitions=n).frame().toPandas().sort_values("Id").reset_index(drop=True) for seed, n in ((7, 2), (7, 5), (8, 2)))
    assert a.equals(b) and not a.equals(c)
    longer = Generator(spark, T, rules(400)).frame().toPandas().sort_values("Id").reset_index(drop=True)
    assert longer.head(300).equals(a)


@pytest.mark.parametrize("rule", ["{strategy: int, min: 1, max: 60, unique: true}", "{strategy: int, min: 1, max: 100000000, unique: true}"])
def test_unique_numbers(spark, rule):
    p = Generator(spark, T, rules(60, Age=rule)).frame().toPandas()
    assert p.Age.is_unique


def test_unique_from_an_irregular_domain_draws_again(spark):
    """Templates whose numbers run into each other, and decimals, can't be counted."""
    table = parse_single("CREATE TABLE T (A VARCHAR(9) NULL, B DECIMAL(4,1) NULL)")
    g = Generator(spark, table, R.loads("rows: 150\ncolumns:\n  A: {strategy: template, template: '{rand:1-99}{rand:1-9}', unique: true}\n  B: {strategy: decimal, min: 0, max: 40, unique: true}\n"))
    assert all(g.domain(p) is None and g.tries(p) is not None for p in g.plan.columns)
    p = g.frame().toPandas()
    assert p.A.is_unique and p.B.is_unique


@pytest.mark.parametrize(("kind", "rule", "domain"), [
    ("VARCHAR(9)", "strategy: string, length: 2", 62**2), ("CHAR(3)", "strategy: string, length: 30", 62**3), ("VARCHAR(40)", "strategy: string, length: 30", 62**8), ("VARCHAR(20)", "strategy: template, template: 'A-{rand:1-40}-{rand:100-199}'", 4000),
    ("VARCHAR(20)", "strategy: template, template: '{rand:10-99}{rand:1-50}'", 4500), ("VARBINARY(2)", "strategy: bytes, length: 2", 256**2), ("VARBINARY(20)", "strategy: bytes, length: 12", 256**7), ("TIME", "strategy: time", 86_400),
    ("NVARCHAR(200)", "strategy: faker, method: name.fullName", None), ("NVARCHAR(200)", "strategy: faker, method: company.catchPhrase", 1600), ("NVARCHAR(MAX)", "strategy: faker, method: finance.iban", 10**18), ("NVARCHAR(200)", "strategy: faker, method: internet.email", None),
])
def test_unique_by_unranking(spark, kind, rule, domain):
    """Numbered domains: unique without a shuffle, the same for more rows, as many as there are."""
    g = Generator(spark, parse_single(f"CREATE TABLE T (V {kind} NULL)"), R.loads(f"rows: 1000\ncolumns:\n  V: {{{rule}, unique: true}}\n"))
    (p,) = g.plan.columns
    assert g.domain(p) == domain or domain is None and g.domain(p) >= 400
    frame = g.frame(with_row=True)
    assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    values = {r["__row"]: r["V"] for r in frame.collect()}
    assert len(set(map(bytes, values.values()) if "BIN" in kind else values.values())) == 1000
    longer = Generator(spark, g.table, R.loads(f"rows: 1200\ncolumns:\n  V: {{{rule}, unique: true}}\n")).frame(with_row=True).collect()
    assert all(values[r["__row"]] == r["V"] for r in longer if r["__row"] <= 1000)


def test_unranked_vocabularies_are_one_to_one(spark):
    """Every vocabulary that is counted gives different texts for different numbers, none longer than is assumed."""
    from pyspark.sql import functions as F

    from seedloom.functions import faker, strategies, unrank
    from seedloom.functions.draw import Draw
    from seedloom.functions.strategies import Context
    from seedloom.sources.ddl import ColumnDef
    from seedloom.sources.rules import ColumnRule

    counted = 0
    for method in faker.METHODS:
        c = Context(ColumnDef("V", "nvarchar", -1), ColumnRule("faker", method=method), Draw(1, "t", "v", F.col("id")))
        found = unrank.places(c, "faker")
        if found is None:
            continue
        n = min(found.size, 30_000)
        rows = spark.range(n).select(unrank.value_at(c, "faker", found, F.col("id"), strategies.faker_).alias("v")).agg(F.count_distinct("v"), F.max(F.length("v"))).first()
        assert rows[0] == n and rows[1] <= unrank.LONGEST, method
        counted += 1
    assert counted >= 25


def test_rows_as_many_as_the_domain(spark):
    text = "rows: {}\ncolumns:\n  V: {{strategy: template, template: 'a{{rand:1-9}}b{{rand:1-9}}', unique: true, nullRate: 0.3}}\n"
    p = Generator(spark, parse_single("CREATE TABLE T (V VARCHAR(9) NULL)"), R.loads(text.format(100))).frame().toPandas()
    assert p.V.dropna().is_unique and p.V.notna().sum() <= 81
    with pytest.raises(GenerationError, match="enough"):
        Generator(spark, parse_single("CREATE TABLE T (V VARCHAR(9) NULL)"), R.loads(text.format(200))).frame()


def test_nulls_are_exempt_from_unique(spark):
    p = Generator(spark, parse_single("CREATE TABLE N (A INT NULL)"), R.loads("rows: 100\ncolumns:\n  A: {strategy: int, min: 1, max: 70, unique: true, nullRate: 0.5}")).frame().toPandas()
    assert p.A.dropna().is_unique and 30 <= p.A.notna().sum() <= 70


def test_exhausted_domains_say_so(spark):
    with pytest.raises(GenerationError, match="Widen"):
        Generator(spark, T, rules(50, Age="{strategy: int, min: 1, max: 3, unique: true}")).frame()
    g = Generator(spark, parse_single("CREATE TABLE S (Id CHAR(4) NOT NULL)"), R.loads("rows: 500\ncolumns:\n  Id: {strategy: template, template: 'ID-{row}', unique: true}"))
    with pytest.raises(GenerationError, match="not unique|Widen"):
        g.check_unique(g.frame())


def test_plan_errors_and_warnings(spark):
    with pytest.raises(GenerationError, match="Nope"):
        Generator(spark, T, rules(Nope="{strategy: guid}"))
    g = Generator(spark, T, rules(5, Age="{strategy: skip}", Seq="{strategy: sequence, nullRate: 0.5}"))
    assert any("Age" in w for w in g.plan.warnings) and any("Seq" in w for w in g.plan.warnings)
    assert g.frame().toPandas().Seq.notna().all()


@pytest.mark.parametrize("first", ["Code", "Name"])
def test_dataset_columns_belong_together(spark, first):
    d = DatasetStore([Dataset("money", ("Code", "Name"), (("EUR", "Euro"), ("USD", "Dollar"), ("GBP", "Pound")))])
    table = parse_single("CREATE TABLE M (" + ", ".join(f"{c} VARCHAR(9) NOT NULL" for c in ([first] + [c for c in ("Code", "Name") if c != first])) + ")")
    body = "rows: 3\ncolumns:\n  Code: {strategy: dataset, dataset: money, unique: true}\n  Name: {strategy: dataset, dataset: money}\n"
    p = Generator(spark, table, R.loads(body), d).frame().toPandas()
    assert dict(zip(p.Code, p.Name, strict=True)) == {"EUR": "Euro", "USD": "Dollar", "GBP": "Pound"}
    with pytest.raises(GenerationError, match="Widen"):
        Generator(spark, table, R.loads(body.replace("rows: 3", "rows: 4")), d).frame()


def test_all_faker_methods(spark):
    assert len(faker.METHODS) == 34
    columns = ", ".join(f"c{k} VARCHAR(400) NOT NULL" for k in range(len(faker.METHODS)))
    text = "rows: 40\ncolumns:\n" + "".join(f"  c{k}: {{strategy: faker, method: {m.upper()}}}\n" for k, m in enumerate(faker.METHODS))
    p = Generator(spark, parse_single(f"CREATE TABLE F ({columns})"), R.loads(text)).frame().toPandas()
    assert p.notna().all().all() and (p != "").all().all()
    at = {m: p[f"c{k}"] for k, m in enumerate(faker.METHODS)}
    check = lambda s: sum(int(c) * (3 if k % 2 else 1) for k, c in enumerate(s)) % 10 == 0
    assert at["commerce.ean13"].map(check).all() and at["vehicle.vin"].str.fullmatch("[A-HJ-NPR-Z0-9]{17}").all()
    assert at["finance.iban"].map(lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1).all()
    with pytest.raises(GenerationError, match="lorem.word"):
        faker.resolve("no.such")


def test_customers_end_to_end(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    countries = parse_single(CUSTOMERS, "Countries")
    TableSink(w, countries).load(Generator(spark, countries, R.loads(COUNTRY_RULES)).frame())
    table, r = parse_single(CUSTOMERS, "[dbo].[Customers]"), R.loads(CUSTOMER_RULES)
    g = Generator(spark, table, r, lookups={"CountryCode": w.sql("SELECT CountryCode FROM dbo.Countries")})
    frame = g.frame()
    g.check_unique(frame)
    assert not g.plan.warnings and not g.truncations()
    assert TableSink(w, table).load(frame, truncate=True) == 1000
    results = evaluate.run(r.evaluations, w.sql)
    assert all(x.passed for x in results), evaluate.lines(results)
    assert results[-1].informational and evaluate.lines(results)[-1].startswith("INFO")
    broken = evaluate.run(R.loads("evaluations:\n  - {name: x, query: SELECT nope FROM dbo.Customers}").evaluations, w.sql)
    assert not broken[0].passed and "query failed" in broken[0].error


@pytest.mark.parametrize("rule", [
    "{strategy: int, min: 1, max: 60, unique: true, nullRate: 0.5}", "{strategy: int, min: 1, max: 40000000, unique: true}", "{strategy: string, length: 1, unique: true}", "{strategy: date, min: 2020-01-01, max: 2020-03-09, unique: true, nullRate: 0.4}",
])
def test_unique_values_stay_when_rows_are_added(spark, rule):
    kind = "INT" if "int" in rule else "DATE" if "date" in rule else "VARCHAR(9)"
    table = parse_single(f"CREATE TABLE T (V {kind} NULL)")

    def made(rows):
        r = Generator(spark, table, R.loads(f"rows: {rows}\ncolumns:\n  V: {rule}\n")).frame(with_row=True).collect()
        values = [x["V"] for x in r if x["V"] is not None]
        assert len(r) == rows and len(set(values)) == len(values)
        return {x["__row"]: x["V"] for x in r}

    few, many = made(30), made(55 if "string" in rule else 75)
    assert all(many[k] == v for k, v in few.items())


def test_permutations_take_their_own_numbers_only(spark):
    from pyspark.sql import functions as F

    from seedloom.functions.permute import permute, side_of

    n = F.lit(100).cast("long")
    assert sorted(r[0] for r in spark.range(100).select(permute(F.col("id"), n, side_of(n), 42)).collect()) == list(range(100))
    for bad in (-1, 100):
        with pytest.raises(Exception, match="not a number to permute"):
            spark.range(bad, bad + 1).select(permute(F.col("id"), n, side_of(n), 42)).collect()


def test_lookups_with_a_value_very_many_times(spark, monkeypatch):
    from seedloom.operators import generate

    monkeypatch.setattr(generate, "LISTED", 10)
    source = generate.lookup(spark, spark.createDataFrame([("a",)] * 57 + [("b",)] + [(None,)], "v string"), "V")
    rows = source.frame.collect()
    assert source.size == 58 and sorted(r["pick"] for r in rows) == list(range(58)) and sum(r["value"] == "a" for r in rows) == 57


def test_weighted_picks_by_alias_tables(spark):
    """A thousand weights, some zero, in one step each; the shares are right by chi-squared."""
    import random

    from pyspark.sql import functions as F

    from seedloom.functions.draw import Draw
    from seedloom.functions.strategies import alias_table, chosen

    r = random.Random(4)
    for weights in ([1.0], [0.0, 2.0], [r.choice([0, 1, 5, 0.01, r.random() * 30]) for _ in range(1000)]):
        stay, alias = alias_table(weights)
        n, share = len(weights), [0.0] * len(weights)
        for k in range(n):
            share[k] += stay[k] / n
            share[alias[k]] += (1 - stay[k]) / n
        assert all(abs(x - w / sum(weights)) < 1e-12 for x, w in zip(share, weights, strict=True))
    rows = 200_000
    seen = {x["v"]: x["count"] for x in spark.range(rows).select(chosen([None] * n, weights, Draw(3, "t", "c", F.col("id"))).alias("v")).groupBy("v").count().collect()}
    assert all(weights[k] > 0 for k in seen)
    chi = sum((seen.get(k, 0) - rows * x) ** 2 / (rows * x) for k, x in enumerate(share) if rows * x >= 5)
    assert chi < n + 5 * (2 * n) ** 0.5
    with pytest.raises(GenerationError, match="weights"):
        alias_table([0.0, 0.0])
