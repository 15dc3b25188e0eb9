"""Rows of a table from its generation plan: one select over a range of row numbers.

Values depend on seed, table, column and row number alone; those of a unique column also on the rows before, never on
rows after. Lookups and datasets are joined by pick index; the join is left to Catalyst, which broadcasts them while they
are small. Only lookups and unique columns shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedloom.errors import GenerationError
from seedloom.functions import unrank
from seedloom.functions.coerce import coerce, truncated
from seedloom.functions.draw import Draw
from seedloom.functions.permute import permute, side_of
from seedloom.functions.strategies import SIMPLE, Context, chosen, day_range, int_range
from seedloom.plans import genplan
from seedloom.plans.genplan import GenPlan, Planned
from seedloom.shared import settle
from seedloom.sources.datasets import DatasetStore
from seedloom.sources.ddl import TableDef
from seedloom.sources.rules import Rules

ROW = "__row"
#: Draws for one row before a unique column gives up.
ATTEMPTS = 100
#: Slots beyond those that strategies use.
NULL_SLOT, PICK_SLOT = 1_000_003, 1_000_004
#: Buckets in which the values of a lookup are sorted and numbered, and ranges in which rows are.
LOOKUP_BUCKETS = 256
#: Numbers of one value that are listed at once.
LISTED = 1 << 16


@dataclass(frozen=True)
class Source:
    """A numbered list of picks (a lookup or a dataset), and how many there are."""

    frame: DataFrame
    size: int


def lookup(spark: SparkSession, frame: DataFrame, column: str) -> Source:
    """The first column of a query's result, without nulls, numbered from 0 in the order of its hash; duplicates count.

    Numbers are counted by hash bucket: no partition has to hold or sort the whole list."""
    values = frame.select(F.col(frame.columns[0]).alias("value")).filter("value is not null")
    kind = values.schema[0].dataType
    grouped = values.groupBy("value").agg(F.count("*").alias("n")).withColumn("bucket", F.conv(F.substring(F.md5(F.col("value").cast("string")), 1, 2), 16, 10).cast("int"))
    bucket_sizes = {r["bucket"]: r["n"] for r in grouped.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # as many as buckets
    size = sum(bucket_sizes.values())
    if not size:
        raise GenerationError(f"column {column!r}: the lookup query returned no values; load the referenced table first")
    starts, at = {}, 0
    for b in sorted(bucket_sizes):
        starts[b], at = at, at + bucket_sizes[b]
    start = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("bucket"))
    by = W.partitionBy("bucket").orderBy(F.md5(F.col("value").cast("string")), "value")
    placed = grouped.withColumn("from", start + F.coalesce(F.sum("n").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # A value may occur any number of times: its numbers are listed in two steps, so no array is long.
    first, end = F.col("from").cast("long"), F.col("from").cast("long") + F.col("n") - 1
    parts = placed.select(F.explode(F.sequence(first, end, F.lit(LISTED).cast("long"))).alias("part"), end.alias("end"), "value")
    out = parts.select(F.explode(F.sequence("part", F.least(F.col("part") + (LISTED - 1), F.col("end")))).alias("pick"), F.col("value").cast(kind).alias("value"))
    return Source(out, size)


def numbered(rows: DataFrame, most: int, name: str) -> DataFrame:
    """ROW and a number from 0 in its order, for rows of 1..most; counted by ranges, so no task has to see all rows."""
    ranges = rows.select(ROW, F.floor((F.col(ROW) - 1) * LOOKUP_BUCKETS / F.lit(most)).cast("int").alias("range"))
    sizes = {r["range"]: r["count"] for r in ranges.groupBy("range").count().collect()}  # as many as ranges
    starts, at = {-1: 0}, 0
    for k in sorted(sizes):
        starts[k], at = at, at + sizes[k]
    start = F.element_at(F.create_map(*[F.lit(x).cast("long" if k % 2 else "int") for kv in starts.items() for k, x in enumerate(kv)]), F.col("range"))
    return ranges.select(ROW, (start + F.row_number().over(W.partitionBy("range").orderBy(ROW)) - 1).alias(name))


class Generator:
    def __init__(self, spark: SparkSession, table: TableDef, rules: Rules, datasets: DatasetStore | None = None, lookups: dict[str, DataFrame] | None = None, partitions: int | None = None) -> None:
        self.spark, self.table, self.rules = spark, table, rules
        self.datasets = datasets or DatasetStore()
        self.plan: GenPlan = genplan.build(table, rules, self.datasets)
        missing = [c for c in self.plan.lookups if c not in (lookups or {})]
        if missing:
            raise GenerationError(f"columns {', '.join(missing)} need lookup data, and there is no source for it")
        self.sources = {c: lookup(spark, (lookups or {})[c], c) for c in self.plan.lookups}
        self.partitions = partitions

    def draw(self, column: str, attempt: Column | int = 0) -> Draw:
        return Draw(self.rules.seed, self.table.full_name, column, F.col(ROW), attempt)

    def base(self) -> DataFrame:
        return self.spark.range(1, self.rules.rows + 1, 1, self.partitions).select(F.col("id").alias(ROW))

    def nulls(self, p: Planned) -> Column:
        return self.draw(p.column.name).unit(NULL_SLOT) < F.lit(p.rule.null_rate or 0.0)

    def context(self, p: Planned, attempt: Column | int = 0) -> Context:
        return Context(p.column, p.rule, self.draw(p.column.name, attempt))

    # Unique columns -------------------------------------------------------------------------------------------------

    def exhausted(self, p: Planned, size: int) -> GenerationError:
        return GenerationError(f"column {p.column.name!r}: {size} distinct values are not enough for unique values in {self.rules.rows} rows. Widen the range, add values or lower 'rows'.")

    def domain(self, p: Planned) -> int | None:
        """How many distinct values a strategy has, where they can be numbered."""
        c, s = self.context(p), p.rule.strategy
        if s == "int":
            low, high = int_range(c)
            n = high - low + 1
        elif s in ("date", "datetime"):
            _, days, seconds = day_range(c)
            n = (days if s == "date" else seconds) + 1
        elif s == "pick":
            n = len(dict.fromkeys(p.rule.values or ()))
        elif s == "bool":
            n = 2
        else:
            found = unrank.places(c, s)
            return found.size if found else None
        return n

    def value_at(self, p: Planned, index: Column) -> Column:
        """The value with an index of a domain."""
        c, s = self.context(p), p.rule.strategy
        if s == "int":
            return index + F.lit(int_range(c)[0]).cast("long")
        if s == "date":
            return F.date_add(F.lit(day_range(c)[0].date()), index.cast("int"))
        if s == "datetime":
            return F.lit(day_range(c)[0].isoformat(" ")).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), index.cast("decimal(18,6)"))
        if s == "bool":
            return index == 1
        if s != "pick":
            return unrank.value_at(c, s, unrank.places(c, s), index, SIMPLE[s][0])
        return F.element_at(F.array(*[F.lit(v) for v in dict.fromkeys(p.rule.values or ())]), (index + 1).cast("int"))

    def ranks(self, rows: DataFrame, p: Planned, size: int) -> tuple[DataFrame, Column]:
        """A permutation of the row numbers, as numbers from 0 below size. Rows beyond the size take the numbers that rows
        without a value leave, in order; so no row's number depends on rows after it."""
        key = f"{self.rules.seed}|{self.table.full_name}|{p.column.name}".lower()
        n = F.lit(size).cast("long")
        if self.rules.rows <= size:
            return rows, permute(F.col(ROW) - 1, n, side_of(n), key)
        base, empty, rank = self.base(), self.nulls(p) if p.rule.null_rate else F.lit(False), f"__rank_{p.column.name}"
        free = numbered(base.filter((F.col(ROW) <= size) & empty), self.rules.rows, "k")
        late = numbered(base.filter((F.col(ROW) > size) & ~empty), self.rules.rows, "k")
        if late.count() > free.count():
            raise self.exhausted(p, size)
        taken = late.join(free.select("k", F.col(ROW).alias(rank)), "k").select(ROW, rank)
        at = F.when(F.col(ROW) <= size, F.col(ROW)).otherwise(F.col(rank)) - 1
        return rows.join(taken, ROW, "left"), permute(at, n, side_of(n), key)

    @staticmethod
    def redrawn(p: Planned) -> bool:
        """Whether another attempt can give another value. Where it can't, check_unique() has the say."""
        if p.rule.strategy == "template":
            return "{row}" not in (p.rule.template or "") and "{" in (p.rule.template or "")
        return p.rule.strategy not in ("sequence", "guid", "constant")

    def tries(self, p: Planned) -> DataFrame | None:
        """For an open domain: the rows that need another attempt, with the attempt that gives them a value of their own.

        A row's value is its first draw that no row before it has. Each round, rows that aren't the first with their value
        draw again; a value that a later row holds goes to the earlier one, and the later one draws again. Only rows that
        collide move."""
        value = lambda a: coerce(SIMPLE[p.rule.strategy][0](self.context(p, a)), p.column, SIMPLE[p.rule.strategy][1])
        live = self.base().filter(~self.nulls(p)) if p.rule.null_rate else self.base()
        first = live.select(ROW, value(0).alias("v"))
        twice = first.groupBy("v").agg(F.min(ROW).alias("keep"), F.count("*").alias("n")).filter("n > 1")
        losers = settle(first.join(twice, "v").filter(F.col(ROW) != F.col("keep")).select(ROW, F.lit(1).alias("attempt")))
        moved = self.spark.createDataFrame([], f"{ROW} long, attempt int, v string")
        while not losers.isEmpty():
            if not losers.filter(F.col("attempt") >= ATTEMPTS).isEmpty():
                break
            drawn = settle(losers.select(ROW, "attempt", value(F.col("attempt")).alias("v")))
            # Who holds the values that were drawn: rows of the first draw that didn't move, rows that did, and the new ones.
            asked = drawn.select("v").distinct()
            gone = moved.select(ROW).unionByName(drawn.select(ROW))
            still = first.join(asked, "v", "left_semi").join(gone, ROW, "left_anti").select(ROW, F.lit(0).alias("attempt"), "v")
            moved = settle(moved.select(ROW, "attempt", F.col("v").cast(drawn.schema["v"].dataType).alias("v")).join(drawn.select(ROW), ROW, "left_anti").unionByName(drawn))
            rivals = still.unionByName(moved.join(asked, "v", "left_semi").select(ROW, "attempt", "v"))
            keep = rivals.groupBy("v").agg(F.min(ROW).alias("keep"))
            losers = settle(rivals.join(keep, "v").filter(F.col(ROW) != F.col("keep")).select(ROW, (F.col("attempt") + 1).alias("attempt")))
        else:
            return None if moved.isEmpty() else moved.select(ROW, "attempt")
        raise GenerationError(f"column {p.column.name!r}: no unique value within {ATTEMPTS} attempts. Widen the range or the length, or lower 'rows'.")

    # The table ------------------------------------------------------------------------------------------------------

    def dataset_picks(self, rows: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
        """For each dataset one pick in each row, shared by all columns that name it; unique if one of them has to be."""
        picks: dict[str, Column] = {}
        used: dict[str, list[Planned]] = {}
        for p in self.plan.columns:
            if p.rule.strategy == "dataset":
                used.setdefault(self.datasets.get(p.rule.dataset or "").name, []).append(p)
        for name, columns in used.items():
            d = self.datasets.get(name)
            unique = [p for p in columns if p.rule.unique]
            if not unique:
                picks[name] = chosen(list(d.rows), list(d.weights) if d.weights else None, Draw(self.rules.seed, self.table.full_name, f"dataset {name}", F.col(ROW)), PICK_SLOT)
                continue
            at = [self.dataset_column(p)[1] for p in unique]
            first = {}
            for k, row in enumerate(d.rows):
                if all(row[a] not in {d.rows[i][a] for i in first.values()} for a in at):
                    first[k] = k
            rows, index = self.ranks(rows, unique[0], len(first))
            picks[name] = F.element_at(F.array(*[F.lit(k) for k in first]), (index + 1).cast("int"))
        return rows, picks

    def dataset_column(self, p: Planned) -> tuple[str, int]:
        d = self.datasets.get(p.rule.dataset or "")
        wanted = p.rule.dataset_column or (d.columns[0] if len(d.columns) == 1 else p.column.name)
        if d.index(wanted) < 0:
            raise GenerationError(f"column {p.column.name!r}: dataset {d.name!r} has no column {wanted!r} ({', '.join(d.columns)})")
        return d.name, d.index(wanted)

    def frame(self, with_row: bool = False, with_truncations: bool = False) -> DataFrame:
        """The table's rows. with_row keeps the row number; with_truncations adds an array of the columns cut short."""
        rows = self.base()
        raw: dict[str, tuple[Column, T.DataType]] = {}
        rows, picks = self.dataset_picks(rows)
        for p in self.plan.columns:
            name, s = p.column.name, p.rule.strategy
            if s == "dataset":
                which, at = self.dataset_column(p)
                values = F.array(*[F.lit(r[at]) for r in self.datasets.get(which).rows])
                raw[name] = F.element_at(values, picks[which] + 1), T.StringType()
            elif s == "query":
                source, pick = self.sources[name], f"__pick_{name}"
                if p.rule.unique:
                    distinct = lookup(self.spark, source.frame.select("value").distinct(), name)
                    rows, index = self.ranks(rows, p, distinct.size)
                    source = distinct
                else:
                    index = self.draw(name).below(source.size, PICK_SLOT)
                value = f"__value_{name}"
                rows = rows.withColumn(pick, index).join(source.frame.select(F.col("pick").alias(pick), F.col("value").alias(value)), pick, "left")
                raw[name] = F.col(value), source.frame.schema["value"].dataType
            elif s not in SIMPLE:
                raise GenerationError(f"column {name!r}: unknown strategy {s!r}")
            elif p.rule.unique and (size := self.domain(p)) is not None:
                rows, index = self.ranks(rows, p, size)
                raw[name] = self.value_at(p, index), SIMPLE[s][1]
            else:
                attempt: Column | int = 0
                if p.rule.unique and self.redrawn(p):
                    if (more := self.tries(p)) is not None:
                        attempt = F.coalesce(F.col(f"__try_{name}"), F.lit(0))
                        rows = rows.join(more.withColumnRenamed("attempt", f"__try_{name}"), ROW, "left")
                raw[name] = SIMPLE[s][0](self.context(p, attempt)), SIMPLE[s][1]
        out, cut = [], []
        by_name = {p.column.name: p for p in self.plan.columns}
        for c in self.table.columns:
            if c in self.plan.numbered:
                seed, step = c.identity or (1, 1)
                out.append((F.lit(seed).cast("long") + F.lit(step).cast("long") * (F.col(ROW) - 1)).cast(c.spark_type()).alias(c.name))
            elif c.name in by_name:
                p = by_name[c.name]
                value, kind = raw[c.name]
                cut.append(F.when(truncated(value, c), F.lit(c.name)))
                value = coerce(value, c, kind)
                out.append((F.when(~self.nulls(p), value) if p.rule.null_rate else value).alias(c.name))
            elif not c.db_generated:
                out.append(F.lit(None).cast(c.spark_type()).alias(c.name))
        extra = [F.col(ROW)] if with_row else []
        extra += [F.array_compact(F.array(*cut)).alias("__truncated")] if with_truncations else []
        return rows.select(*extra, *out)

    def truncations(self) -> dict[str, int]:
        """How many values of each column are cut to its length."""
        rows = self.frame(with_truncations=True).select(F.explode("__truncated").alias("c")).groupBy("c").count().collect()  # a row for each column at most
        return {r["c"]: r["count"] for r in rows}

    def check_unique(self, frame: DataFrame) -> None:
        """Values that coercion made equal again (a template cut short) are an error."""
        for p in self.plan.columns:
            if p.rule.unique and not frame.filter(F.col(f"`{p.column.name}`").isNotNull()).groupBy(f"`{p.column.name}`").count().filter("count > 1").isEmpty():
                raise GenerationError(f"column {p.column.name!r}: values are not unique after cutting them to the column's length. Widen the column or change the rule.")
