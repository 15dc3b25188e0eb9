"""Survey: what each column of each table holds.

An exact survey expands the columns once and counts each (column, value) with one shuffle; row and null counts, distinct
values and frequent values are all read from that. An approximate one shuffles no values: distinct counts come from
merged sketches (5 %), and a frequent-items sketch of each column names the values that can be frequent. These are
counted exactly in a second pass, and where the last of the top values is above what the sketch may have missed, they
are the exact ones; only columns without such values (keys, measures) are counted like in an exact survey.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedloom.functions.coerce import canonical
from seedloom.shared import settle

TOP = 5
#: Shapes that often stand for "missing", as they are or in any case.
SENTINELS = ["0", "-1", "", " ", "?", "-"]
SENTINEL_WORDS = ["unknown", "n/a", "none", "null"]
NULL_SHARE, SENTINEL_SHARE, DOMINANT_SHARE = 0.05, 0.02, 0.40


def surveyable(frame: DataFrame) -> list[T.StructField]:
    return [f for f in frame.schema.fields if not isinstance(f.dataType, (T.BinaryType, T.ArrayType, T.MapType, T.StructType))]


def text_of(f: T.StructField) -> Column:
    """A value as text, null for null; 0.0 and -0.0 are one value."""
    c = F.col(f"`{f.name}`")
    own = c + F.lit(0.0).cast(f.dataType) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c
    return F.when(c.isNotNull(), canonical(own, f.dataType))


def value_counts(frame: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """name, value, n of each value of each column, null among them: one shuffle for all columns."""
    each = F.array(*[F.struct(F.lit(f.name).alias("name"), text_of(f).alias("value")) for f in fields])
    return frame.select(F.explode(each).alias("x")).groupBy("x.name", "x.value").agg(F.count("*").alias("n"))


def named(frame: DataFrame) -> DataFrame:
    rows = [(p, f.name) for p, f in enumerate(surveyable(frame))]
    return F.broadcast(frame.sparkSession.createDataFrame(rows, "position int, name string"))


def counts_of(frame: DataFrame, counted: DataFrame) -> DataFrame:
    """name, rows, nulls, null_rate, distinct of each column, from value_counts()."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    own = counted.groupBy("name").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNull(), F.col("n"))).alias("nulls"), F.count("value").alias("distinct"))
    own = named(frame).join(own, "name", "left").select("name", *[zero(F.col(c)).alias(c) for c in ("rows", "nulls", "distinct")])
    rate = F.when(F.col("rows") == 0, F.lit(0.0)).otherwise(F.round(F.col("nulls").cast("double") / F.col("rows"), 4))
    return own.select("name", "rows", "nulls", rate.alias("null_rate"), "distinct")


def first_values(counted: DataFrame, k: int) -> DataFrame:
    """name, value, n, rank of the k most frequent values of each column, of equal counts the smaller text first. Spark
    keeps only the first rows of each column before it exchanges them."""
    # Null goes last instead of out: a filter would move below the counts, and these would be made twice.
    rank = F.row_number().over(W.partitionBy("name").orderBy(F.col("value").isNull(), F.col("n").desc(), "value"))
    return counted.withColumn("rank", rank).filter((F.col("rank") <= k) & F.col("value").isNotNull()).withColumn("rank", F.col("rank").cast("long"))


def column_counts(frame: DataFrame, approximate: bool = False) -> DataFrame:
    """name, rows, nulls, null_rate, distinct for each column, from one pass."""
    fields = surveyable(frame)
    if not approximate:
        return counts_of(frame, value_counts(frame, fields))
    aggregates = [F.count("*").alias("rows")]
    for k, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggregates += [F.count_if(c.isNull()).alias(f"n{k}"), F.approx_count_distinct(c).alias(f"d{k}")]
    each = F.array(*[F.struct(F.lit(f.name).alias("name"), F.col(f"n{k}").alias("nulls"), F.col(f"d{k}").alias("distinct")) for k, f in enumerate(fields)])
    rate = F.when(F.col("rows") == 0, F.lit(0.0)).otherwise(F.round(F.col("x.nulls").cast("double") / F.col("rows"), 4))
    return frame.agg(*aggregates).select("rows", F.explode(each).alias("x")).select("x.name", "rows", "x.nulls", rate.alias("null_rate"), "x.distinct")


#: Values that a sketch tracks in each column. It keeps them in a table of 2048, and what it reports is off by 3.5 / 2048 of
#: all rows at most; a value that it doesn't report occurs at most twice that often.
TRACKED, MISSED = 1000, 2 * 3.5 / 2048


def candidates(frame: DataFrame) -> dict[str, tuple[int, list[str]]]:
    """Of each column how often the sketch may have missed a value, and the values it reports: TRACKED at most."""
    fields = surveyable(frame)
    texts = frame.select([text_of(f).alias(f"v{k}") for k, f in enumerate(fields)])
    row = texts.agg(*[x for k in range(len(fields)) for x in (F.count(f"v{k}").alias(f"n{k}"), F.expr(f"approx_top_k(v{k}, {TRACKED}, {TRACKED})").alias(f"t{k}"))]).first()
    return {f.name: (math.ceil(row[f"n{k}"] * MISSED), [x["item"] for x in row[f"t{k}"] or [] if x["item"] is not None]) for k, f in enumerate(fields)}


def frequent_values(frame: DataFrame, k: int = TOP) -> DataFrame:
    """The rows of top_values(), by heavy hitters; the others' columns are counted whole."""
    spark, fields = frame.sparkSession, surveyable(frame)
    asked = candidates(frame)
    known = F.broadcast(spark.createDataFrame([(n, v) for n, (_, values) in asked.items() for v in values], "name string, value string"))
    each = F.array(*[F.struct(F.lit(f.name).alias("name"), text_of(f).alias("value")) for f in fields])
    exact = settle(first_values(frame.select(F.explode(each).alias("x")).select("x.name", "x.value").join(known, ["name", "value"]).groupBy("name", "value").agg(F.count("*").alias("n")), k))
    least = {r["name"]: (r["rows"], r["least"]) for r in exact.groupBy("name").agg(F.count("*").alias("rows"), F.min("n").alias("least")).collect()}  # a row for each column
    proven = [f.name for f in fields if f.name in least and least[f.name][0] == k and least[f.name][1] > asked[f.name][0]]
    rest = [f for f in fields if f.name not in proven]
    out = exact.filter(F.col("name").isin(proven))
    return out.unionByName(first_values(value_counts(frame, rest), k).select(out.columns)) if rest else out


def top_values(frame: DataFrame, k: int = TOP, approximate: bool = False) -> DataFrame:
    """name, value, n, rank of the k most frequent values of each column; of equal counts the smaller text is first."""
    return frequent_values(frame, k) if approximate else first_values(value_counts(frame, surveyable(frame)), k)


def percent(share: Column) -> Column:
    text = F.round(share * 100, 1).cast("decimal(10,1)").cast("string")
    return F.concat(F.regexp_replace(text, r"\.0$", ""), F.lit("%"))


def signals(rows: Column, nulls: Column, rate: Column, distinct: Column, nullable: Column, is_key: Column, top: Column) -> Column:
    """What stands out in a column that is no key: values first (placeholders and those that fill much of it), then how
    often it is null. top: an array of (value, n) by falling n."""
    filled = rows - nulls
    none = F.expr("cast(array() as array<string>)")

    def of_value(x: Column) -> Column:
        share = x["n"].cast("double") / filled
        placeholder = (share >= SENTINEL_SHARE) & (x["value"].isin(SENTINELS) | F.lower(x["value"]).isin(SENTINEL_WORDS))
        text = F.concat(F.when(placeholder, "placeholder '").otherwise("'"), x["value"], F.lit("' fills "), percent(share))
        return F.when(placeholder | (share >= DOMINANT_SHARE), text)

    values = F.when(distinct == 1, F.array(F.lit("one value throughout"))).when(distinct > 1, F.transform(top, of_value)).otherwise(none)
    empty = F.when(nulls == 0, F.when(nullable, "NULL allowed, none found")).when(rate >= NULL_SHARE, F.concat(percent(rate), F.lit(" of rows NULL")))
    return F.when(rows == 0, F.array(F.lit("no rows"))).when(is_key, none).otherwise(F.array_compact(F.concat(values, F.array(empty))))


def survey_table(frame: DataFrame, keys: list[str] = (), nullable: dict[str, bool] | None = None, k: int = TOP, approximate: bool = False) -> DataFrame:
    """name, type, nullable, is_key, rows, nulls, null_rate, distinct, top_values, signals: a row for each column."""
    spark = frame.sparkSession
    known = [(p, f.name, f.dataType.simpleString(), bool((nullable or {}).get(f.name, f.nullable)), f.name.lower() in {x.lower() for x in keys}) for p, f in enumerate(surveyable(frame))]
    facts = spark.createDataFrame(known, "position int, name string, type string, nullable boolean, is_key boolean")
    if approximate:
        counts, first = column_counts(frame, True), frequent_values(frame, k)
    else:
        counted = value_counts(frame, surveyable(frame))
        counts, first = counts_of(frame, counted), first_values(counted, k)
    top = first.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("top_values"))
    out = F.broadcast(facts).join(counts, "name").join(top, "name", "left")
    out = out.withColumn("top_values", F.coalesce(F.transform("top_values", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))), F.expr("cast(array() as array<struct<value:string,n:bigint>>)")))
    c = F.col
    return out.withColumn("signals", signals(c("rows"), c("nulls"), c("null_rate"), c("distinct"), c("nullable"), c("is_key"), c("top_values"))).orderBy("position").drop("position")


@dataclass
class ColumnSurvey:
    name: str
    type: str
    nullable: bool
    isKey: bool  # noqa: N815 - names of the artifact
    nulls: int
    nullRate: float  # noqa: N815
    distinct: int
    topValues: list[dict] = field(default_factory=list)  # noqa: N815
    coveredByRule: str | None = None  # noqa: N815
    signals: list[str] = field(default_factory=list)


def survey(warehouse, covered: Callable[[str, str], str | None] = lambda table, column: None, tables: list[str] | None = None) -> dict:
    """The survey of a warehouse as a document. Nothing is written."""
    out = []
    for name in tables or warehouse.tables():
        d = warehouse.definition(name)
        rows = survey_table(warehouse.table(name), list(d.primary_key), {c.name: c.nullable for c in d.columns}).collect()  # a row for each column
        columns = [asdict(ColumnSurvey(r["name"], r["type"], r["nullable"], r["is_key"], r["nulls"], r["null_rate"], r["distinct"], [{"value": v["value"], "count": v["n"]} for v in r["top_values"]], covered(d.full_name, r["name"]), list(r["signals"]))) for r in rows]
        out.append({"table": d.full_name, "rows": rows[0]["rows"] if rows else 0, "columns": columns})
    return {"tables": out}
