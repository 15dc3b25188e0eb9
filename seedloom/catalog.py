"""The library's operators as queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedloom.functions import faker, generators
from seedloom.functions.coerce import canonical, coerce, printed, truncated
from seedloom.functions.draw import Draw
from seedloom.functions.permute import ROUNDS, permute, side_of
from seedloom.functions.strategies import ALPHABET, SIMPLE, Context, alias_table
from seedloom.operators import audit, evaluate, gaps, repair
from seedloom.operators import survey as S
from seedloom.operators.generate import NULL_SLOT, PICK_SLOT, Generator, lookup
from seedloom.plans.dialect import translate_sql
from seedloom.shared import shared_dir
from seedloom.sources.datasets import Dataset, DatasetStore
from seedloom.sources.ddl import ColumnDef, parse_script, parse_single
from seedloom.sources.gaprules import GapRule, GapRules
from seedloom.sources.rules import ColumnRule, Evaluation, Expectation, Rules
from seedloom.sources.warehouse import LEDGER_NAME, Warehouse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SEED = 42


def query(sql: str | None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Evaluations: T-SQL through the translator, so that what runs is what a rules file would say --------------------------


def evaluated(name: str, tsql: str, sql: str, tables: tuple[str, ...]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = {}
        for table in tables:
            t(spark, sf_dir, table).createOrReplaceTempView(f"eval__{table}")
            names |= {f"dbo.{table}": f"eval__{table}"}
        return spark.sql(translate_sql(tsql, names))

    query(sql, name)(run)


for _name, _tsql, _sql, _tables in [
    ("eval_row_count", "SELECT COUNT(*) AS n FROM [dbo].[orders]", "SELECT count(*) AS n FROM orders", ("orders",)),
    ("eval_unique_gap", "SELECT COUNT(*) - COUNT(DISTINCT o_custkey) AS gap FROM dbo.orders", "SELECT count(*) - count(DISTINCT o_custkey) AS gap FROM orders", ("orders",)),
    ("eval_share", "SELECT CAST(SUM(IIF(o_orderstatus = N'F', 1.0, 0.0)) / COUNT(*) AS FLOAT) AS share FROM dbo.orders", "SELECT CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / count(*) AS share FROM orders", ("orders",)),
    ("eval_fk_orphans", "SELECT COUNT(*) AS n FROM dbo.documents d LEFT JOIN dbo.labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL", "SELECT count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL", ("documents", "labels")),
    ("eval_fk_multi", "SELECT COUNT(*) AS n FROM dbo.lineitem l LEFT JOIN dbo.orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN dbo.part p ON l.l_partkey = p.p_partkey WHERE l.l_orderkey IS NOT NULL AND (o.o_orderkey IS NULL OR p.p_partkey IS NULL)",
     "SELECT count(*) AS n FROM lineitem l LEFT JOIN orders o ON l_orderkey = o_orderkey LEFT JOIN part p ON l_partkey = p_partkey WHERE o_orderkey IS NULL OR p_partkey IS NULL", ("lineitem", "orders", "part")),
    ("eval_dup_keys", "SELECT COUNT(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM dbo.lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1) d",
     "SELECT count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)", ("lineitem",)),
    ("eval_distinct_ratio", "SELECT CAST(COUNT(DISTINCT o_custkey) AS FLOAT) / 1500.0 AS ratio FROM dbo.orders", "SELECT CAST(count(DISTINCT o_custkey) AS DOUBLE) / 1500.0 AS ratio FROM orders", ("orders",)),
    ("eval_line_revenue", "SELECT SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS revenue, AVG(CAST(l_quantity AS FLOAT)) AS quantity, MIN(l_linenumber) AS low, MAX(l_linenumber) AS high FROM dbo.lineitem",
     "SELECT sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS revenue, avg(l_quantity) AS quantity, min(l_linenumber) AS low, max(l_linenumber) AS high FROM lineitem", ("lineitem",)),
    ("eval_top", "SELECT TOP 5 [o_orderpriority] AS priority, COUNT(*) AS n FROM [dbo].[orders] GROUP BY [o_orderpriority] ORDER BY COUNT(*) DESC, [o_orderpriority]", "SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, priority LIMIT 5", ("orders",)),
    ("eval_dialect", "SELECT ISNULL(NULLIF(n_name, 'FRANCE'), N'none') + '!' AS name, CONVERT(BIGINT, n_nationkey) AS k, LEN(n_name) AS n FROM [dbo].[nation] WHERE n_nationkey NOT IN (1, 2)",
     "SELECT coalesce(nullif(n_name, 'FRANCE'), 'none') || '!' AS name, CAST(n_nationkey AS BIGINT) AS k, CAST(length(n_name) AS INTEGER) AS n FROM nation WHERE n_nationkey NOT IN (1, 2)", ("nation",)),
]:
    evaluated(_name, _tsql, _sql, _tables)


@query("""
SELECT 'rows' AS name, CAST((SELECT count(*) FROM orders) AS VARCHAR) AS value, '>= 1' AS expected, true AS passed, CAST(NULL AS VARCHAR) AS error, false AS informational
UNION ALL SELECT 'unique', CAST((SELECT count(*) - count(DISTINCT o_orderkey) FROM orders) AS VARCHAR), '= 0', (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders), NULL, false
UNION ALL SELECT 'status', (SELECT min(o_orderstatus) FROM orders), '= f', (SELECT min(o_orderstatus) = 'F' FROM orders), NULL, false
UNION ALL SELECT 'lines', CAST((SELECT max(l_linenumber) FROM lineitem) AS VARCHAR), 'in [1, 7]', (SELECT max(l_linenumber) BETWEEN 1 AND 7 FROM lineitem), NULL, false
UNION ALL SELECT 'customers', CAST((SELECT count(DISTINCT o_custkey) FROM orders) AS VARCHAR), NULL, true, NULL, true
""")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    for table in ("orders", "lineitem"):
        t(spark, sf_dir, table).createOrReplaceTempView(f"eval__{table}")
    names = {"dbo.orders": "eval__orders", "dbo.lineitem": "eval__lineitem"}
    checks = [
        Evaluation("rows", "SELECT COUNT(*) FROM dbo.orders", Expectation(min="1")), Evaluation("unique", "SELECT COUNT(*) - COUNT(DISTINCT o_orderkey) FROM dbo.orders", Expectation(equals="0")),
        Evaluation("status", "SELECT MIN(o_orderstatus) FROM dbo.orders", Expectation(equals="f")), Evaluation("lines", "SELECT MAX(l_linenumber) FROM dbo.lineitem", Expectation(between=("1", "7"))),
        Evaluation("customers", "SELECT COUNT(DISTINCT o_custkey) FROM dbo.orders"),
    ]
    return evaluate.report(spark, evaluate.run(checks, lambda q: spark.sql(translate_sql(q, names))))


_FUSED = {
    "rows": ("SELECT COUNT(*) FROM dbo.lineitem", "count(*)"), "cheap": ("SELECT COUNT(*) FROM [dbo].[lineitem] WHERE l_extendedprice < 5000", "count(*) FILTER (WHERE l_extendedprice < 5000)"),
    "parts": ("SELECT COUNT(DISTINCT l_partkey) FROM dbo.lineitem WHERE l_quantity > 25 AND l_linenumber IN (1, 2)", "count(DISTINCT l_partkey) FILTER (WHERE l_quantity > 25 AND l_linenumber IN (1, 2))"),
    "spread": ("SELECT MAX(l_quantity) - MIN(l_quantity) FROM dbo.lineitem WHERE l_linenumber = 3", "max(l_quantity) FILTER (WHERE l_linenumber = 3) - min(l_quantity) FILTER (WHERE l_linenumber = 3)"),
    "none": ("SELECT SUM(l_linenumber) FROM dbo.lineitem WHERE l_quantity < 0", "sum(l_linenumber) FILTER (WHERE l_quantity < 0)"),
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS name, CAST(CAST({s} AS DOUBLE) AS VARCHAR) AS value FROM lineitem" for k, (_, s) in _FUSED.items()))
def eval_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five checks of one table, asked together."""
    t(spark, sf_dir, "lineitem").createOrReplaceTempView("eval__lineitem")
    results = evaluate.run([Evaluation(k, q, None) for k, (q, _) in _FUSED.items()], lambda q: spark.sql(translate_sql(q, {"dbo.lineitem": "eval__lineitem"})))
    rows = [(r.name, r.error if r.error else None if r.value is None else str(float(r.value))) for r in results]
    return spark.createDataFrame(rows, "name string, value string")


# Survey -----------------------------------------------------------------------------------------------------------------

def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with nulls: the tables have none of their own."""
    return t(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") != "click", F.col("event_type")).alias("event_type"))


_EVENTS_SQL = "(SELECT event_id, user_id, nullif(event_type, 'click') AS event_type FROM events)"
_COUNTS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS name, count(*) AS rows, count(*) - count({c}) AS nulls, round(CAST(count(*) - count({c}) AS DOUBLE) / count(*), 4) AS null_rate, count(DISTINCT {c}) AS \"distinct\" FROM {_EVENTS_SQL}" for c in ("event_id", "user_id", "event_type"))
_TOP_SQL = "SELECT name, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS rank FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {_EVENTS_SQL} WHERE {c} IS NOT NULL GROUP BY ALL" for c in ("event_id", "user_id", "event_type")) + ")) WHERE rank <= 5"


@query(_COUNTS_SQL)
def survey_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.column_counts(_events(spark, sf_dir))


@query(_TOP_SQL)
def survey_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_values(_events(spark, sf_dir))


_LINE_COLUMNS = ("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_partkey", "l_suppkey")


@query("SELECT name, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS rank FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY ALL" for c in _LINE_COLUMNS) + ")) WHERE rank <= 5")
def survey_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by heavy hitters: flags come from the sketch's candidates, keys from full counts."""
    return S.top_values(t(spark, sf_dir, "lineitem").select(*_LINE_COLUMNS), approximate=True)


_PCT = "regexp_replace(CAST(CAST(round({} * 100, 1) AS DECIMAL(10,1)) AS VARCHAR), '\\.0$', '') || '%'"


@query(f"""
WITH l AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
c AS ({" UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS rows, count(*) - count({c}) AS nulls, round(CAST(count(*) - count({c}) AS DOUBLE) / count(*), 4) AS rate, count(DISTINCT {c}) AS d FROM l" for c in ("lang", "source", "quality", "toxic"))}),
v AS ({" UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM l WHERE {c} IS NOT NULL GROUP BY ALL" for c in ("lang", "source", "quality", "toxic"))}),
top AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS k FROM v QUALIFY k <= 5),
s AS (SELECT name, 2 AS o, 0 AS k, {_PCT.format("rate")} || ' of rows NULL' AS signal FROM c WHERE nulls > 0 AND rate >= 0.05
      UNION ALL SELECT name, 2, 0, 'NULL allowed, none found' FROM c WHERE nulls = 0
      UNION ALL SELECT name, 1, 0, 'one value throughout' FROM c WHERE d = 1
      UNION ALL SELECT name, 1, k, CASE WHEN value IN ('0', '-1', '', ' ', '?', '-') AND CAST(n AS DOUBLE) / (rows - nulls) >= 0.02 THEN 'placeholder ' ELSE '' END || '''' || value || ''' fills ' || {_PCT.format("CAST(n AS DOUBLE) / (rows - nulls)")}
      FROM top JOIN c USING (name) WHERE d > 1 AND (CAST(n AS DOUBLE) / (rows - nulls) >= 0.4 OR value IN ('0', '-1', '', ' ', '?', '-') AND CAST(n AS DOUBLE) / (rows - nulls) >= 0.02))
SELECT c.name, coalesce(string_agg(signal, '; ' ORDER BY o, k), '') AS signals FROM c LEFT JOIN s USING (name) GROUP BY c.name
""")
def survey_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left").select("lang", "source", "quality", "toxic")
    return S.survey_table(frame).select("name", F.array_join("signals", "; ").alias("signals"))


# Gaps -------------------------------------------------------------------------------------------------------------------

_PRIORITY = GapRule(id="G1", table="dbo.orders", key="o_orderkey", column="o_orderpriority", kind="ephemeral", gap="o_orderpriority = '4-NOT SPECIFIED'", fix="lorem.word", threshold=10**9, reason="-")


@query("SELECT count(*) AS n FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'")
def gap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t(spark, sf_dir, "orders")
    return orders.agg(F.count_if(gaps.gap(_PRIORITY, orders)).alias("n"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED' ORDER BY 1")
def gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.gap_rows(_PRIORITY, t(spark, sf_dir, "orders"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F'")
def gap_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned are all finished orders; those that are still bad remain."""
    orders = t(spark, sf_dir, "orders")
    return gaps.remaining(_PRIORITY, orders, orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("key")))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", "lang").join(t(spark, sf_dir, "labels"), "doc_id", "left")


_JUDGED_SQL = "(SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def _rule(gap: str, invariant: str = "quality = 1") -> GapRule:
    return GapRule(id="G2", table="dbo.judged", key="doc_id", column="quality", kind="ephemeral", gap=gap, invariant=invariant, fix="lorem.word", threshold=10**9, reason="-")


@query(f"SELECT count(*) FILTER (WHERE NOT quality = 1) AS violations, count(*) FILTER (WHERE quality = 1) AS holds FROM {_JUDGED_SQL}")
def inv_violations_and_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _judged(spark, sf_dir)
    holds = gaps.invariant(_rule("quality = 0"), frame)
    return frame.agg(F.count_if(~holds).alias("violations"), F.count_if(holds).alias("holds"))


def covered(name: str, gap: str, invariant: str, sql_gap: str, sql_inv: str) -> None:
    bad, holds = f"coalesce({sql_gap}, false)", f"({sql_inv})"
    keys = lambda c: f"coalesce(array_to_string(list_sort(list(CAST(doc_id AS VARCHAR)) FILTER (WHERE {c}))[1:5], ','), '')"
    kinds = {"uncovered": f"NOT {holds} AND NOT {bad}", "selected_valid": f"{bad} AND {holds}", "indeterminate": f"{holds} IS NULL"}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame, rule = _judged(spark, sf_dir), _rule(gap, invariant)
        row = gaps.coverage(gaps.gap(rule, frame), gaps.invariant(rule, frame), gaps.key_text(rule, frame), frame)
        return row.select(*kinds, *[F.array_join(f"{k}_keys", ",").alias(f"{k}_keys") for k in kinds])

    query("SELECT " + ", ".join([f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in kinds.items()] + [f"{keys(c)} AS {k}_keys" for k, c in kinds.items()]) + f" FROM {_JUDGED_SQL}", name)(run)


covered("cov_uncovered", "quality IS NULL AND lang = 'de'", "quality IS NOT NULL AND quality >= 0", "quality IS NULL AND lang = 'de'", "quality IS NOT NULL AND quality >= 0")
covered("cov_selected_valid", "lang = 'fr' OR quality IS NULL", "quality IS NOT NULL", "lang = 'fr' OR quality IS NULL", "quality IS NOT NULL")
covered("cov_indeterminate", "quality = 0", "quality = 1", "quality = 0", "quality = 1")


def house(spark: SparkSession, ddl: str, **frames: DataFrame) -> Warehouse:
    """A warehouse in the shared folder with the script's tables; frames by table name."""
    w = Warehouse(spark, f"{shared_dir(spark)}/house-{uuid.uuid4().hex}")
    for table in parse_script(ddl):
        w.create(table, frames[table.name].select([F.col(f.name).cast(f.dataType) for f in table.struct().fields]) if table.name in frames else None)
    return w


CUSTOMER = "CREATE TABLE dbo.customer (c_custkey BIGINT NOT NULL PRIMARY KEY, c_acctbal FLOAT, c_mktsegment VARCHAR(20))"


def customers(spark: SparkSession, sf_dir: str) -> Warehouse:
    return house(spark, CUSTOMER, customer=t(spark, sf_dir, "customer"))


def gap_rule(rule_id: str, gap: str, **more: object) -> GapRule:
    given = {"table": "dbo.customer", "key": "c_custkey", "column": "c_mktsegment", "kind": "ephemeral", "fix": "lorem.word", "threshold": 10**9, "reason": "-"}
    return GapRule(**given | {"id": rule_id, "gap": gap} | more)


@query("""
SELECT rule, n, threshold, CASE WHEN n > threshold THEN 'BLOCKED' ELSE 'OK' END AS status, CASE WHEN n > threshold THEN 0 ELSE n END AS patches FROM (
SELECT 'low' AS rule, count(*) FILTER (WHERE c_acctbal < 0) AS n, CAST(10 AS BIGINT) AS threshold FROM customer
UNION ALL SELECT 'segment', count(*) FILTER (WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT c_acctbal BETWEEN 0 AND 5000), CAST(1000000 AS BIGINT) FROM customer)
""")
def plan_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = GapRules((gap_rule("low", "c_acctbal < 0", threshold=10), gap_rule("segment", "c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT c_acctbal BETWEEN 0 AND 5000", threshold=1_000_000)), DatasetStore())
    made = repair.plan(customers(spark, sf_dir), rules, SEED)["rules"]
    return spark.createDataFrame([(r["id"], r["count"], r["threshold"], r["status"], r["patches"]) for r in made], "rule string, n long, threshold long, status string, patches long")


def planned(w: Warehouse, rule: GapRule, datasets: DatasetStore | None = None) -> DataFrame:
    """What a rule plans for a table: patches and skipped rows."""
    patches, skipped = repair.values(w, rule, datasets or DatasetStore(), w.table(rule.table_name), SEED)
    out = patches.select("key", "value", F.lit("patched").alias("what"))
    return out if skipped is None else out.unionByName(skipped.select("key", F.lit(None).cast("string").alias("value"), F.col("why").alias("what")))


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS key, list_extract([{', '.join(repr(w) for w in faker.LOREM)}], CAST(CAST('0x' || substr(md5('{SEED}|dbo.customer|e1|' || c_custkey || '|1|0'), 1, 8) AS BIGINT) % {len(faker.LOREM)} + 1 AS INTEGER)) AS value, 'patched' AS what FROM customer WHERE c_acctbal < 0")
def plan_ephemeral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(customers(spark, sf_dir), gap_rule("E1", "c_acctbal < 0"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, CAST(CASE WHEN rooms IS NULL THEN NULL WHEN rooms < 1 THEN 1 ELSE (rooms + 2) // 3 END AS VARCHAR) AS value, CASE WHEN rooms IS NULL THEN 'an input is NULL' ELSE 'patched' END AS what FROM (SELECT p_partkey, nullif(p_size % 12, 5) AS rooms FROM part)")
def plan_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = house(spark, "CREATE TABLE dbo.part (p_partkey BIGINT NOT NULL PRIMARY KEY, rooms INT, baths INT)", part=t(spark, sf_dir, "part").select("p_partkey", F.expr("nullif(p_size % 12, 5)").alias("rooms"), F.lit(None).alias("baths")))
    rule = gap_rule("D1", "baths IS NULL", table="dbo.part", key="p_partkey", column="baths", kind="derived", fix="security.bathroomsFromRooms", inputs=("rooms",))
    return planned(w, rule)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, CASE n_regionkey WHEN 0 THEN 'south' WHEN 1 THEN 'west' WHEN 2 THEN 'east' END AS value, CASE WHEN n_regionkey > 2 THEN 'no dataset row has these inputs' ELSE 'patched' END AS what FROM nation")
def plan_dataset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = house(spark, "CREATE TABLE dbo.nation (n_nationkey INT NOT NULL PRIMARY KEY, n_regionkey INT, zone VARCHAR(9))", nation=t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.lit(None).alias("zone")))
    zones = DatasetStore([Dataset("zones", ("n_regionkey", "zone"), (("0", "south"), ("1", "west"), ("2", "east")))])
    rule = gap_rule("D2", "zone IS NULL", table="dbo.nation", key="n_nationkey", column="zone", kind="derived", fix="dataset.zones", inputs=("n_regionkey",))
    return planned(w, rule, zones)


# Draws and strategies -----------------------------------------------------------------------------------------------------


def drawn(spark: SparkSession, sf_dir: str, column: str, kind: str, rule: ColumnRule) -> DataFrame:
    base = t(spark, sf_dir, "customer").select("c_custkey")
    d = ColumnDef(column, kind)
    c = Context(d, rule, Draw(SEED, "dbo.customer", column, F.col("c_custkey")))
    fn, given = SIMPLE[rule.strategy]
    value = coerce(fn(c), d, given)
    if rule.null_rate:
        value = F.when(~(c.draw.unit(NULL_SLOT) < F.lit(rule.null_rate)), value)
    return base.select("c_custkey", value.alias("v"))


def bits(column: str, slot: object = 0, key: str = "c_custkey", wide: bool = False, table: str = "dbo.customer") -> str:
    return f"CAST('0x' || substr(md5('{SEED}|{table}|{column}|' || {key} || '|' || {slot} || '|0'), 1, {15 if wide else 8}) AS BIGINT)"


def strategy(name: str, kind: str, rule: ColumnRule, sql: str) -> None:
    query(f"SELECT c_custkey, {sql} AS v FROM customer", name)(lambda spark, sf_dir: drawn(spark, sf_dir, name, kind, rule))


_HEX = f"md5('{SEED}|dbo.customer|gen_guid|' || c_custkey || '|0|0')"
_ALL = f"array_to_string(list_transform(range(0, 12), lambda k: substr('{ALPHABET}', CAST({bits('gen_string', 'k // 8', wide=True)} // CAST(pow(62, k % 8) AS BIGINT) % 62 + 1 AS INTEGER), 1)), '')"
strategy("gen_int", "int", ColumnRule("int", min="18", max="65"), f"CAST({bits('gen_int')} % 48 + 18 AS INTEGER)")
strategy("gen_decimal", "decimal", ColumnRule("decimal", min="10", max="99.5"), f"CAST(floor(10.0::DOUBLE + {bits('gen_decimal')} / 4294967296.0::DOUBLE * 89.5::DOUBLE + 0.5::DOUBLE) AS DECIMAL(18,0))")
strategy("gen_bool", "bit", ColumnRule("bool", true_rate=0.8), f"{bits('gen_bool')} / 4294967296.0::DOUBLE < 0.8::DOUBLE")
strategy("gen_date", "date", ColumnRule("date", min="2020-01-01", max="2025-12-31"), f"DATE '2020-01-01' + CAST({bits('gen_date')} % 2192 AS INTEGER)")
strategy("gen_datetime", "datetime2", ColumnRule("datetime", min="2020-01-01", max="2025-12-31"), f"TIMESTAMP '2020-01-01' + to_seconds({bits('gen_datetime')} % 189302401)")
strategy("gen_guid", "uniqueidentifier", ColumnRule("guid"), f"substr({_HEX}, 1, 8) || '-' || substr({_HEX}, 9, 4) || '-4' || substr({_HEX}, 14, 3) || '-' || substr('89ab', CAST(CAST('0x' || substr({_HEX}, 17, 1) AS INTEGER) % 4 + 1 AS INTEGER), 1) || substr({_HEX}, 18, 3) || '-' || substr({_HEX}, 21, 12)")
strategy("gen_string", "varchar", ColumnRule("string", length=12), _ALL)
_LONG = f"array_to_string(list_transform(range(0, 70), lambda k: substr('{ALPHABET}', CAST({bits('gen_long_string', 'k // 8', wide=True)} // CAST(pow(62, k % 8) AS BIGINT) % 62 + 1 AS INTEGER), 1)), '')"
strategy("gen_long_string", "varchar", ColumnRule("string", length=70), _LONG)
strategy("gen_template", "varchar", ColumnRule("template", template="C{row}-{rand:10-99}-{rand:7}"), f"'C' || c_custkey || '-' || ({bits('gen_template', 2)} % 90 + 10) || '-7'")
strategy("gen_pick", "varchar", ColumnRule("pick", values=("a", "b", "c")), f"list_extract(['a', 'b', 'c'], CAST({bits('gen_pick')} % 3 + 1 AS INTEGER))")
_WEIGHTS = (6.0, 3.0, 1.0, 2.5, 0.25)
_STAY, _ALIAS = alias_table(list(_WEIGHTS))
_SPUN = f"({bits('gen_pick_weighted')} / 4294967296.0::DOUBLE * 5.0::DOUBLE)"
_PLACE = f"CAST(floor({_SPUN}) AS INTEGER)"
strategy("gen_pick_weighted", "varchar", ColumnRule("pick", values=tuple("abcde"), weights=_WEIGHTS),
         f"substr('abcde', 1 + CASE WHEN {_SPUN} - {_PLACE} < list_extract([{', '.join(f'{x!r}::DOUBLE' for x in _STAY)}], {_PLACE} + 1) THEN {_PLACE} ELSE list_extract({_ALIAS}, {_PLACE} + 1) END, 1)")
strategy("gen_sequence", "bigint", ColumnRule("sequence", start=1000, step=5), "CAST(1000 + 5 * (c_custkey - 1) AS BIGINT)")
strategy("gen_constant", "int", ColumnRule("constant", value="7"), "7")
strategy("gen_null_rate", "int", ColumnRule("int", min="0", max="9", null_rate=0.3), f"CASE WHEN {bits('gen_null_rate', NULL_SLOT)} / 4294967296.0::DOUBLE < 0.3::DOUBLE THEN NULL ELSE CAST({bits('gen_null_rate')} % 10 AS INTEGER) END")
strategy("gen_bytes", "varbinary", ColumnRule("bytes", length=9), f"unhex(substr(md5('{SEED}|dbo.customer|gen_bytes|' || c_custkey || '|0|0'), 1, 18))")
_SEC = f"({bits('gen_time')} % 86400)"
strategy("gen_time", "time", ColumnRule("time"), f"lpad(CAST({_SEC} // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST({_SEC} % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({_SEC} % 60 AS VARCHAR), 2, '0')")


@query(f"""
SELECT c_custkey, n_nationkey AS v FROM (SELECT c_custkey, {bits("gen_lookup", 0, wide=True)} % (SELECT count(*) FROM nation) AS pick FROM customer) c
JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY md5(CAST(n_nationkey AS VARCHAR))) - 1 AS p FROM nation) x ON pick = p
""")
def gen_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's pick of a nation; the list is in the order of its values' hashes."""
    source = lookup(spark, t(spark, sf_dir, "nation").select("n_nationkey"), "gen_lookup")
    picks = t(spark, sf_dir, "customer").select("c_custkey", Draw(SEED, "dbo.customer", "gen_lookup", F.col("c_custkey")).below(F.lit(source.size).cast("long")).alias("pick"))
    return picks.join(source.frame, "pick", "left").select("c_custkey", F.col("value").alias("v"))


def generated(spark: SparkSession, ddl: str, rows: int, columns: dict[str, ColumnRule], datasets: DatasetStore | None = None, **lookups: DataFrame) -> DataFrame:
    """A table with its row numbers (k)."""
    g = Generator(spark, parse_single(ddl), Rules(rows=rows, seed=SEED, columns=columns), datasets, lookups)
    return g.frame(with_row=True).withColumnRenamed("__row", "k")


_REGIONS = DatasetStore([Dataset("regions", ("Code", "Name"), (("AF", "Africa"), ("AM", "America"), ("AS", "Asia"), ("EU", "Europe")))])
_ROWS = "(SELECT unnest(range(1, CAST((SELECT count(*) FROM customer) AS BIGINT) + 1)) AS k)"
_PICK = bits("dataset regions", PICK_SLOT, "k", table="dbo.d")


@query(f"SELECT k, list_extract(['AF', 'AM', 'AS', 'EU'], CAST({_PICK} % 4 + 1 AS INTEGER)) AS Code, list_extract(['Africa', 'America', 'Asia', 'Europe'], CAST({_PICK} % 4 + 1 AS INTEGER)) AS Name FROM {_ROWS}")
def gen_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of one dataset: each row has both from the same pick."""
    return generated(spark, "CREATE TABLE dbo.D (Code CHAR(2) NOT NULL, Name VARCHAR(20) NOT NULL)", t(spark, sf_dir, "customer").count(), {"Code": ColumnRule("dataset", dataset="regions"), "Name": ColumnRule("dataset", dataset="regions")}, _REGIONS)


def permuted(n: str, key: str, columns: str, more: str, rows: str = "n") -> str:
    """SQL that permutes 0..n-1 (n: a query), or the first rows of it; a * side + b is the number that p becomes."""
    return f"""
WITH RECURSIVE n AS (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS side FROM ({n})),
walk AS (SELECT p, 0 AS k, p // side AS a, p % side AS b FROM (SELECT unnest(range({rows})) AS p, side FROM n)
         UNION ALL SELECT p, k + 1, b, (a + CAST('0x' || substr(md5('{key}:' || (k % {ROUNDS} + 1) || ':' || b), 1, 8) AS BIGINT)) % side FROM walk, n WHERE k = 0 OR k % {ROUNDS} <> 0 OR a * side + b >= n.n),
done AS (SELECT p, a * side + b AS v FROM walk, n WHERE k > 0 AND k % {ROUNDS} = 0 AND a * side + b < n.n)
SELECT {columns} FROM done {more}
"""


@query(permuted("SELECT count(*) AS n FROM supplier", str(SEED), "s_suppkey, v", "JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS q FROM supplier) ON p = q"))
def gen_unique_perm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A permutation of the suppliers' places in the order of their keys."""
    supplier = t(spark, sf_dir, "supplier").select("s_suppkey")
    n = F.lit(supplier.count()).cast("long")
    placed = lookup_order(supplier, "s_suppkey")
    return placed.select("s_suppkey", permute(F.col("place"), n, side_of(n), SEED).alias("v"))


def lookup_order(frame: DataFrame, key: str) -> DataFrame:
    """frame with each row's place in the order of a distinct whole-number key, counted by ranges."""
    low, high = frame.agg(F.min(key), F.max(key)).first()
    if low is None:
        return frame.withColumn("place", F.lit(0).cast("long"))
    from seedloom.operators.generate import ROW, numbered

    rows = numbered(frame.select((F.col(key) - low + 1).alias(ROW)), high - low + 1, "place")
    return frame.join(rows, F.col(key) - low + 1 == F.col(ROW)).select(*frame.columns, "place")


@query(permuted("SELECT count(*) AS n FROM customer", f"{SEED}|dbo.u|code", "p + 1 AS k, CAST(v + 1 AS BIGINT) AS Code", ""))
def gen_unique_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many unique numbers as the range has."""
    n = t(spark, sf_dir, "customer").count()
    return generated(spark, "CREATE TABLE dbo.U (Code BIGINT NOT NULL)", n, {"Code": ColumnRule("int", min="1", max=str(n), unique=True)})


@query("SELECT c_custkey, substr(c_name, 1, 10) AS v, length(c_name) > 10 AS cut FROM customer")
def coerce_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ColumnDef("c_name", "varchar", length=10)
    return t(spark, sf_dir, "customer").select("c_custkey", coerce(F.col("c_name"), d).alias("v"), truncated(F.col("c_name"), d).alias("cut"))


@query("SELECT p_partkey, CAST(sign(p_retailprice) * floor(abs(CAST(p_retailprice / 7 AS DECIMAL(20,6))) * 100 + 0.5) / 100 AS DECIMAL(10,2)) AS v FROM part")
def coerce_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.expr("cast(p_retailprice / 7 as decimal(20,6))")
    return t(spark, sf_dir, "part").select("p_partkey", coerce(price, ColumnDef("v", "decimal", precision=10, scale=2), T.DecimalType(20, 6)).alias("v"))


# Vocabularies and text forms ------------------------------------------------------------------------------------------------


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_pick(column: str, values: list[str], slot: object) -> str:
    return f"list_extract({sql_list(values)}, CAST({bits(column, slot)} % {len(values)} + 1 AS INTEGER))"


def sql_digits(column: str, n: int, slot: int) -> str:
    return " || ".join(f"lpad(CAST({bits(column, slot + k, wide=10 ** min(12, n - k) > 1 << 32)} % {10 ** min(12, n - k)} AS VARCHAR), {min(12, n - k)}, '0')" for k in range(0, n, 12))


strategy("fake_full_name", "varchar", ColumnRule("faker", method="name.fullName"), sql_pick("fake_full_name", faker.FIRST, 1) + " || ' ' || " + sql_pick("fake_full_name", faker.LAST, 2))
strategy("fake_email", "varchar", ColumnRule("faker", method="internet.email"), f"lower({sql_pick('fake_email', faker.FIRST, 1)}) || '.' || lower({sql_pick('fake_email', faker.LAST, 2)}) || ({bits('fake_email', 3)} % 1000) || '@example.test'")
strategy("fake_ip", "varchar", ColumnRule("faker", method="internet.ip"), " || '.' || ".join(f"({bits('fake_ip', k)} % 256)" for k in range(4)))
strategy("fake_phone", "varchar", ColumnRule("faker", method="phone.phoneNumber"), f"'(' || {sql_digits('fake_phone', 3, 1)} || ') ' || {sql_digits('fake_phone', 3, 20)} || '-' || {sql_digits('fake_phone', 4, 40)}")
strategy("fake_vin", "varchar", ColumnRule("faker", method="vehicle.vin"), f"array_to_string(list_transform(range(1, 18), lambda k: {sql_pick('fake_vin', list('ABCDEFGHJKLMNPRSTUVWXYZ0123456789'), 'k')}), '')")
_BODY = f"({sql_digits('fake_iban', 18, 1)})"
strategy("fake_iban", "varchar", ColumnRule("faker", method="finance.iban"), f"'DE' || lpad(CAST(98 - CAST({_BODY} || '131400' AS HUGEINT) % 97 AS VARCHAR), 2, '0') || {_BODY}")
_EAN = f"({sql_digits('fake_ean13', 12, 1)})"
strategy("fake_ean13", "varchar", ColumnRule("faker", method="commerce.ean13"), f"{_EAN} || ((10 - list_sum(list_transform(range(1, 13), lambda k: CAST(substr({_EAN}, CAST(k AS INTEGER), 1) AS INTEGER) * CASE WHEN k % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10)")




def fake(method: str, sql: Callable[[str], str], kind: str = "varchar") -> None:
    """A vocabulary method; sql gets the column's name."""
    name = "fake_" + "".join("_" + c.lower() if c.isupper() else c for c in method.replace(".", "_"))
    strategy(name, kind, ColumnRule("faker", method=method), sql(name))


def lorem(c: str, slot: int) -> str:
    """Words of a sentence: their number and each of them are draws."""
    word = f"list_extract({sql_list(faker.LOREM)}, CAST({bits(c, f'(k + {slot * 1000})')} % {len(faker.LOREM)} + 1 AS INTEGER))"
    text = f"array_to_string(list_transform(range(1, CAST({bits(c, slot)} % 9 + 5 AS BIGINT)), lambda k: {word}), ' ')"
    return f"(upper(substr({text}, 1, 1)) || substr({text}, 2) || '.')"


def _street(c: str) -> str:
    return f"({bits(c, 11)} % 200 + 1) || ' ' || {sql_pick(c, faker.STREETS, 12)} || ' ' || {sql_pick(c, faker.KINDS, 13)}"


def _domain(c: str) -> str:
    return f"{sql_pick(c, faker.WORDS, 21)} || {sql_pick(c, faker.WORDS, 22)} || '.' || {sql_pick(c, faker.TLDS, 23)}"


def _picks(*lists: list[str], lower: tuple[int, ...] = ()) -> Callable[[str], str]:
    """One of each list, with spaces between."""
    return lambda c: " || ' ' || ".join(f"lower({sql_pick(c, x, k)})" if k in lower else sql_pick(c, x, k) for k, x in enumerate(lists, 1))


for _method, _lists in {
    "name.firstName": (faker.FIRST,), "name.jobTitle": (faker.LEVELS, faker.AREAS, faker.ROLES), "address.city": (faker.CITIES,), "address.state": (faker.STATES,), "address.country": ([c[0] for c in faker.COUNTRIES],), "address.countryCode": ([c[1] for c in faker.COUNTRIES],),
    "company.companyName": (faker.LAST, faker.FORMS), "commerce.productName": (faker.ADJECTIVES, faker.MATERIALS, faker.NOUNS), "commerce.department": (faker.DEPARTMENTS,), "commerce.color": (faker.COLORS,), "lorem.word": (faker.LOREM,),
    "finance.currencyCode": (faker.CURRENCIES,), "vehicle.manufacturer": (faker.MAKERS,), "vehicle.model": (faker.MODELS,),
}.items():
    fake(_method, _picks(*_lists))
fake("name.lastName", lambda c: sql_pick(c, faker.LAST, 2))
fake("internet.userName", lambda c: f"lower({sql_pick(c, faker.FIRST, 1)}) || '.' || lower({sql_pick(c, faker.LAST, 2)}) || ({bits(c, 3)} % 1000)")
fake("internet.domainName", _domain)
fake("internet.url", lambda c: f"'https://' || {_domain(c)} || '/' || {sql_pick(c, faker.WORDS, 24)}")
fake("address.zipCode", lambda c: sql_digits(c, 5, 1))
fake("address.streetAddress", _street)
fake("address.fullAddress", lambda c: f"{_street(c)} || ', ' || {sql_pick(c, faker.CITIES, 1)} || ', ' || {sql_pick(c, faker.STATES, 2)}")
fake("address.latitude", lambda c: f"round({bits(c, 1)} / 4294967296.0::DOUBLE * 180 - 90, 4)", "float")
fake("address.longitude", lambda c: f"round({bits(c, 1)} / 4294967296.0::DOUBLE * 360 - 180, 4)", "float")
fake("company.catchPhrase", _picks(faker.VERBS, faker.AREAS, faker.WORDS, lower=(2,)))
fake("lorem.sentence", lambda c: lorem(c, 1))
fake("lorem.paragraph", lambda c: " || ' ' || ".join(lorem(c, k) for k in range(1, 5)))
fake("finance.accountName", lambda c: f"{sql_pick(c, faker.ACCOUNTS, 1)} || ' Account'")


@query(f"SELECT c_custkey, 'DE' || {sql_digits('fix_security_id', 3, 1)} || {' || '.join(sql_pick('fix_security_id', list(generators.ID_ALPHABET), k) for k in range(20, 26))} AS v FROM customer")
def fix_security_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "customer").select("c_custkey", generators.security_id(Draw(SEED, "dbo.customer", "fix_security_id", F.col("c_custkey"))).alias("v"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS date_cell, CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END AS bit_cell, '0x' || hex(encode(o_orderstatus)) AS bytes_cell, coalesce(nullif(o_orderpriority, '5-LOW'), '') AS text_cell,
strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS key_text FROM orders""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as CSV cells show them, and as keys and plans write them."""
    orders = t(spark, sf_dir, "orders")
    low = F.expr("nullif(o_orderpriority, '5-LOW')")
    return orders.select(
        "o_orderkey", printed(F.col("o_orderdate"), T.TimestampNTZType()).alias("date_cell"), printed(F.col("o_orderstatus") == "F", T.BooleanType()).alias("bit_cell"),
        printed(F.col("o_orderstatus").cast("binary"), T.BinaryType()).alias("bytes_cell"), printed(low, T.StringType()).alias("text_cell"), canonical(F.col("o_orderdate"), T.TimestampNTZType()).alias("key_text"))


def unranked(name: str, domain: int, kind: str, rule: ColumnRule, sql: str) -> None:
    """As many unique values as there are customers; sql gives the value with the number v."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return generated(spark, f"CREATE TABLE dbo.U (Code {kind} NOT NULL)", t(spark, sf_dir, "customer").count(), {"Code": rule})

    query(permuted(f"SELECT CAST({domain} AS BIGINT) AS n", f"{SEED}|dbo.u|code", f"p + 1 AS k, {sql} AS Code", "", "(SELECT count(*) FROM customer)"), name)(run)


_AT = lambda values, v: f"list_extract([{', '.join(repr(x) for x in values)}], CAST({v} % {len(values)} + 1 AS INTEGER))"
unranked("gen_unique_string", 62**4, "VARCHAR(9)", ColumnRule("string", length=4, unique=True), "concat(" + ", ".join(f"substr('{ALPHABET}', CAST(v // {62**k} % 62 + 1 AS INTEGER), 1)" for k in range(4)) + ")")
unranked("gen_unique_template", 900 * 41_000, "VARCHAR(20)", ColumnRule("template", template="A{rand:100-999}-{rand:0-40999}.", unique=True), "'A' || (v % 900 + 100) || '-' || (v // 900 % 41000) || '.'")
unranked("gen_unique_user", len(faker.FIRST) * len(faker.LAST) * 1000, "NVARCHAR(120)", ColumnRule("faker", method="internet.userName", unique=True),
         f"lower({_AT(faker.FIRST, 'v')}) || '.' || lower({_AT(faker.LAST, f'v // {len(faker.FIRST)}')}) || (v // {len(faker.FIRST) * len(faker.LAST)} % 1000)")
unranked("gen_unique_bytes", 256**3, "VARBINARY(3)", ColumnRule("bytes", length=3, unique=True), "unhex(lpad(hex(v), 6, '0'))")


@query(f"""
SELECT k, CASE WHEN {bits("code", NULL_SLOT, "k", table="dbo.w")} / 4294967296.0::DOUBLE < 0.4::DOUBLE THEN NULL ELSE 'v' || (v + 100) END AS Code FROM (
{permuted("SELECT count(*) * 2 AS n FROM customer", f"{SEED}|dbo.w|code", "p + 1 AS k, v", "", "(SELECT count(*) FROM customer)")})
""")
def gen_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of what is done to a value: made unique, then null; a null row's value goes to nobody else."""
    n = t(spark, sf_dir, "customer").count()
    return generated(spark, "CREATE TABLE dbo.W (Code VARCHAR(12) NULL)", n, {"Code": ColumnRule("template", template=f"v{{rand:100-{99 + 2 * n}}}", unique=True, null_rate=0.4)})


@query("""
SELECT k, CAST(list_extract(['AF', 'AM', 'AS', 'EU'], CAST({0} % 4 + 1 AS INTEGER)) AS VARCHAR) AS Region_Code, list_extract(['Africa', 'America', 'Asia', 'Europe'], CAST({0} % 4 + 1 AS INTEGER)) AS NAME_OF_REGION FROM {1}
""".format(bits("dataset regions", PICK_SLOT, "k", table="dbo.m"), _ROWS))
def gen_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that a dataset's patterns infer: of names in any case, without underscores, with * and ?."""
    from seedloom.plans.infer import infer

    matched = DatasetStore([Dataset("regions", ("Code", "Name"), (("AF", "Africa"), ("AM", "America"), ("AS", "Asia"), ("EU", "Europe")), None, {"Code": ("region*",), "Name": ("nam?of*",)})])
    ddl = "CREATE TABLE dbo.M (Region_Code CHAR(2) NOT NULL, NAME_OF_REGION VARCHAR(20) NOT NULL)"
    table = parse_single(ddl)
    return generated(spark, ddl, t(spark, sf_dir, "customer").count(), {c.name: infer(c, table, matched) for c in table.columns}, matched)


@query("""
SELECT 'dbo.customer' AS child, 'c_nationkey' AS col, 'dbo.nation' AS parent, count(*) FILTER (WHERE n_nationkey IS NULL AND c_nationkey IS NOT NULL) AS orphans FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'dbo.nation', 'n_regionkey', 'dbo.region', count(*) FILTER (WHERE r_regionkey IS NULL AND n_regionkey IS NOT NULL) FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
""")
def catalog_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as a warehouse's registry lists them, each with the rows that have no parent; types by analysis alone."""
    ddl = """
    CREATE TABLE dbo.region (r_regionkey INT NOT NULL PRIMARY KEY, r_name VARCHAR(25));
    CREATE TABLE dbo.nation (n_nationkey INT NOT NULL PRIMARY KEY, n_name VARCHAR(30), n_regionkey INT REFERENCES dbo.region(r_regionkey));
    CREATE TABLE dbo.customer (c_custkey BIGINT NOT NULL PRIMARY KEY, c_nationkey INT REFERENCES dbo.nation(n_nationkey));
    """
    w = house(spark, ddl, **{n: t(spark, sf_dir, n) for n in ("region", "nation", "customer")})
    out = []
    for name in w.tables():
        for fk in w.definition(name).foreign_keys:
            child, parent = w.table(name).select(F.col(fk.columns[0]).alias("a")), w.table(fk.table).select(F.col(fk.referenced[0]).alias("b"))
            assert child.schema[0].dataType == parent.schema[0].dataType
            lost = child.filter("a is not null").join(parent, F.col("a") == F.col("b"), "left_anti").agg(F.count("*").alias("orphans"))
            out.append(lost.select(F.lit(name).alias("child"), F.lit(fk.columns[0]).alias("col"), F.lit(Warehouse.key(fk.table)).alias("parent"), "orphans"))
    return reduce(DataFrame.unionByName, out)


_FOUND = f"(SELECT n_nationkey, row_number() OVER (ORDER BY md5(CAST(n_nationkey AS VARCHAR))) - 1 AS p FROM nation)"


@query(f"""
SELECT k, CAST(k AS INTEGER) AS Id, CAST(n_nationkey AS INTEGER) AS Nation, list_extract({"[" + ", ".join(repr(x) for x in faker.LAST) + "]"}, CAST({bits("name", 1, "k", table="dbo.g")} % {len(faker.LAST)} + 1 AS INTEGER)) || ' ' ||
list_extract({"[" + ", ".join(repr(x) for x in faker.FORMS) + "]"}, CAST({bits("name", 2, "k", table="dbo.g")} % {len(faker.FORMS)} + 1 AS INTEGER)) AS Name
FROM {_ROWS} r JOIN {_FOUND} x ON {bits("nation", PICK_SLOT, "k", table="dbo.g")} % (SELECT count(*) FROM nation) = p
""")
def gen_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole table by rules, as many rows as customers, with a foreign key drawn from the nations."""
    n = t(spark, sf_dir, "customer").count()
    ddl = "CREATE TABLE dbo.G (Id INT IDENTITY PRIMARY KEY, Nation INT NOT NULL REFERENCES dbo.nation(n_nationkey), Name NVARCHAR(40) NOT NULL)"
    rules = {"Nation": ColumnRule("query", query="SELECT n_nationkey FROM dbo.nation"), "Name": ColumnRule("faker", method="company.companyName")}
    return generated(spark, ddl, max(n, 1), rules, Nation=t(spark, sf_dir, "nation").select("n_nationkey")).filter(F.col("k") <= n)


# Repair -------------------------------------------------------------------------------------------------------------------


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of the balances below zero."""
    return t(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("key"), F.struct(F.lit("0").alias("v")).alias("__new_c_acctbal"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS c_acctbal, c_acctbal < 0 AS patched FROM customer")
def apply_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    out = repair.overlay(customer, F.col("c_custkey").cast("string"), _patches(spark, sf_dir), ["c_acctbal"])
    return out.select("c_custkey", "c_acctbal", F.col("__old_c_acctbal").isNotNull().alias("patched"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch log: two rules' patches of lines, some cells patched twice."""
    lines = t(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return lines.select(F.lit("R1").alias("rule"), "id", "seq", F.col("l_quantity").alias("old"), F.lit(40.0).alias("new")).unionByName(
        lines.filter("l_quantity > 48").select(F.lit("R2").alias("rule"), "id", (F.col("seq") + 10_000_000_000).alias("seq"), F.lit(40.0).alias("old"), F.lit(39.0).alias("new")))


_LOG_SQL = """(SELECT 'R1' AS rule, l_orderkey || '-' || l_linenumber AS id, l_orderkey * 10 + l_linenumber AS seq, l_quantity AS old, 40.0::DOUBLE AS new FROM lineitem WHERE l_quantity > 40
UNION ALL SELECT 'R2', l_orderkey || '-' || l_linenumber, l_orderkey * 10 + l_linenumber + 10000000000, 40.0::DOUBLE, 39.0::DOUBLE FROM lineitem WHERE l_quantity > 48)"""


@query(f"SELECT rule, count(*) AS patched, array_to_string(list(id ORDER BY seq)[1:3], ',') AS samples FROM {_LOG_SQL} GROUP BY rule")
def facts_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.patch_facts(_log(spark, sf_dir)).select("rule", "patched", F.array_join("samples", ",").alias("samples"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN CAST(CAST(c_custkey AS DOUBLE) / 2 AS DOUBLE) ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def revert_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that patched cells twice is taken back: each gets its earliest old value."""
    w = customers(spark, sf_dir)
    rules = GapRules((gap_rule("B1", "c_acctbal < 0", column="c_acctbal"),), DatasetStore())
    bad = gaps.gap_rows(rules.rules[0], w.table("dbo.customer"), ordered=False)
    entry = lambda seq, old: bad.select(F.lit(seq).alias("seq"), F.lit("B1").alias("rule"), F.col("c_custkey").cast("string").alias("id"), F.lit("c_acctbal").alias("col"), old.cast("string").alias("old"))
    repair.revert(w, rules, entry(1, F.lit("1")).unionByName(entry(0, F.col("c_custkey") / 2)))
    return w.table("dbo.customer")


def plan_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities for all suppliers: what the ledger has is used again, others draw until each has a value of its own. The
    rounds are beyond SQL; a test holds them against a plain version."""
    supplier = t(spark, sf_dir, "supplier").select("s_suppkey", F.lit(None).cast("string").alias("code"), "s_nationkey")
    w = house(spark, "CREATE TABLE dbo.supplier (s_suppkey BIGINT NOT NULL PRIMARY KEY, code VARCHAR(20))", supplier=supplier)
    known = supplier.filter("s_nationkey < 12").select(F.lit("dbo.supplier").alias("TargetTable"), F.col("s_suppkey").cast("string").alias("RowKey"), F.lit("code").alias("ColumnName"), F.concat(F.lit("K"), "s_suppkey").alias("Value"), F.lit("I1").alias("RuleId"), F.current_timestamp().alias("CreatedAt"), F.lit("x").alias("CreatedBy"))
    w.publish(w.manifest(), {LEDGER_NAME: [w.stage(LEDGER_NAME, w.with_entries(known))]})
    rule = gap_rule("I1", "code IS NULL", table="dbo.supplier", key="s_suppkey", column="code", kind="identity", fix="address.zipCode")
    patches, _ = repair.values(w, rule, DatasetStore(), w.table("dbo.supplier"), SEED)
    return patches.select("key", "value", F.when(F.col("minted"), "minted").otherwise("ledger").alias("origin"))


QUERIES["plan_identity"] = plan_identity


@query("""
WITH b AS (SELECT n_name AS name, n_nationkey % 2 = 0 AS was, n_nationkey % 3 = 0 AS now FROM nation)
SELECT name, CASE WHEN was THEN 'regression' ELSE 'pre-existing' END AS what FROM b WHERE NOT now
""")
def verify_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "nation").select("n_name", "n_nationkey").collect()  # checks: one for each nation
    worse, old = repair.regressions([{"name": r[0], "passed": r[1] % 2 == 0} for r in rows], [{"name": r[0], "passed": r[1] % 3 == 0} for r in rows])
    return spark.createDataFrame([(n, "regression") for n in worse] + [(n, "pre-existing") for n in old], "name string, what string")

