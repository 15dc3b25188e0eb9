"""A folder of versioned Parquet tables with an append-only ledger, published by numbered manifests.

Every write goes to a new folder; a manifest that names the current folders and files of each table makes it visible. An
append adds a folder; a change of cells writes only the files anew that hold them. Manifests are created under the next
free number by a rename that fails if the number is taken, so of two writers one has to start again, and a reader sees
all of a publication or none of it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedloom.errors import AllowlistError, ConfigError, LedgerConflict, SeedloomError
from seedloom.functions.coerce import printed
from seedloom.plans.dialect import translate_sql, translate_value, unbracketed
from seedloom.shared import settle
from seedloom.sources.ddl import ColumnDef, ForeignKey, TableDef

LEDGER = "TargetTable string, RowKey string, ColumnName string, Value string, RuleId string, CreatedAt timestamp, CreatedBy string"
LEDGER_NAME = "ledger"
#: Keys up to which a scan is asked for them: it then reads only the parts of files whose ranges and Bloom filters allow one
#: of them. More keys are likely in most parts anyway, and are joined.
ASKED_KEYS = 1000


class Files:
    """A folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def paths(self, names: list[str]):
        """An array of paths."""
        out = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Path, len(names))
        for k, name in enumerate(names):
            out[k] = self.path(name)
        return out

    def names(self, name: str = "") -> list[str]:
        p = self.path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a whole new file; false if there is one already."""
        part = self.path(f"{name}.{uuid.uuid4().hex}.part")
        stream = self.fs.create(part, True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        if self.fs.exists(self.path(name)) or not self.fs.rename(part, self.path(name)):
            self.fs.delete(part, False)
            return False
        return True


def canonical_root(root: str) -> str:
    from urllib.parse import urlsplit

    parts = urlsplit(root if "://" in root else f"file://{root}")
    if "@" in parts.netloc or "password" in root.lower():
        raise AllowlistError("a root must not hold credentials")
    return f"{parts.scheme.lower()}://{parts.netloc.lower()}{parts.path.rstrip('/') or '/'}"


def guard(root: str, allowed: list[str]) -> None:
    """Refuse roots that aren't on the list."""
    if canonical_root(root) not in {canonical_root(a) for a in allowed}:
        raise AllowlistError(f"{canonical_root(root)} is not on the allowlist")


@dataclass(frozen=True)
class Manifest:
    number: int
    #: Folders and files below the root, of each table by its lower-case name, and of the ledger.
    folders: dict[str, list[str]]
    tables: dict[str, dict]


class Warehouse:
    def __init__(self, spark: SparkSession, root: str, allowed: list[str] | None = None) -> None:
        if root.strip() in ("", ":memory:"):
            raise ConfigError("a warehouse needs a folder")
        if allowed is not None:
            guard(root, allowed)
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        pushed = "spark.sql.parquet.pushdown.inFilterThreshold"
        if int(spark.conf.get(pushed)) < ASKED_KEYS:
            spark.conf.set(pushed, str(ASKED_KEYS))

    def manifest(self) -> Manifest:
        numbers = [int(n[:-5]) for n in self.files.names("_manifests") if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return Manifest(0, {}, {})
        doc = json.loads(self.files.read(f"_manifests/{max(numbers):08d}.json"))
        return Manifest(max(numbers), doc["folders"], doc["tables"])

    def publish(self, base: Manifest, folders: dict[str, list[str]], tables: dict[str, dict] | None = None) -> None:
        doc = {"folders": base.folders | folders, "tables": base.tables | (tables or {})}
        if not self.files.create(f"_manifests/{base.number + 1:08d}.json", json.dumps(doc, indent=1, sort_keys=True)):
            raise SeedloomError("another writer has published meanwhile; start again")

    def stage(self, name: str, frame: DataFrame, key: tuple[str, ...] | list[str] = ()) -> str:
        """Write a frame to a new folder, not yet visible; of a key of one column with Bloom filters beside the ranges."""
        folder, writer = f"{name}/{uuid.uuid4().hex}", frame.write
        if len(key) == 1:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key[0]}", "true")
        writer.parquet(f"{self.root}/{folder}")
        return folder

    @staticmethod
    def holding(frame: DataFrame, key: T.StructField, keys: DataFrame, n: int) -> DataFrame:
        """The rows of a table that can have one of n keys (text, column 'key'); all rows if these are many."""
        if n > ASKED_KEYS:
            return frame
        # A null among the keys, from text that is no key, would have all of it read.
        asked = [r[0] for r in keys.select("key").filter(F.col("key").try_cast(key.dataType).isNotNull()).limit(ASKED_KEYS).collect()]
        return frame.filter(F.col(f"`{key.name}`").isin([F.lit(k).cast(key.dataType) for k in asked]) if asked else F.lit(False))

    # Tables ---------------------------------------------------------------------------------------------------------

    @staticmethod
    def key(table: str) -> str:
        name = unbracketed(table).lower()
        return name if "." in name else f"dbo.{name}"

    def create(self, table: TableDef, frame: DataFrame | None = None) -> None:
        """Add a table, empty or with rows; computed columns and row versions are not stored."""
        base, key = self.manifest(), self.key(table.full_name)
        rows = frame if frame is not None else self.spark.createDataFrame([], table.struct())
        self.publish(base, {key: [self.stage(key, rows, table.primary_key)]}, {key: asdict(table)})

    def definition(self, table: str) -> TableDef:
        doc = self.manifest().tables.get(self.key(table))
        if doc is None:
            raise ConfigError(f"no table {table!r}; tables: {', '.join(self.tables()) or 'none'}")
        columns = tuple(ColumnDef(**c | {"identity": tuple(c["identity"]) if c["identity"] else None}) for c in doc["columns"])
        foreign = tuple(ForeignKey(tuple(f["columns"]), f["table"], tuple(f["referenced"])) for f in doc["foreign_keys"])
        return TableDef(doc["schema"], doc["name"], columns, tuple(doc["primary_key"]), foreign, tuple(doc["checks"]))

    def tables(self) -> list[str]:
        return sorted(f"{d['schema']}.{d['name']}" for d in self.manifest().tables.values())

    def table(self, name: str) -> DataFrame:
        m, key = self.manifest(), self.key(name)
        if key not in m.folders:
            raise ConfigError(f"no table {name!r}; tables: {', '.join(self.tables()) or 'none'}")
        return self.read(m.folders[key], self.definition(name).struct())

    def whole(self, name: str) -> DataFrame:
        """The table with its computed columns. Those whose expression can't be translated are left out."""
        frame, stored = self.table(name), self.table(name).schema
        for c in self.definition(name).columns:
            if c.computed is not None:
                try:
                    frame = frame.withColumn(c.name, F.expr(translate_value(c.computed, self.key(name), stored)))
                except ConfigError:
                    continue
        return frame

    def read(self, entries: list[str], schema: T.StructType | str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{e}" for e in entries])

    def append(self, name: str, frame: DataFrame, truncate: bool = False) -> None:
        base, key = self.manifest(), self.key(name)
        new = self.stage(key, frame.select(self.definition(name).struct().names), self.definition(name).primary_key)
        self.publish(base, {key: [new] if truncate else [*base.folders[key], new]})

    def without(self, entries: list[str], touched: set[tuple[str, str]]) -> list[str]:
        """entries without some files, each given by the names of its folder and itself."""
        out = []
        for entry in entries:
            if entry.endswith(".parquet"):
                out += [] if tuple(entry.rsplit("/", 2)[-2:]) in touched else [entry]
            elif any(entry.rsplit("/", 1)[-1] == folder for folder, _ in touched):
                folder = entry.rsplit("/", 1)[-1]
                out += [f"{entry}/{n}" for n in self.files.names(entry) if n.endswith(".parquet") and (folder, n) not in touched]
            else:
                out.append(entry)
        return out

    def ledger(self) -> DataFrame:
        entries = self.manifest().folders.get(LEDGER_NAME)
        return self.read(entries, LEDGER) if entries else self.spark.createDataFrame([], LEDGER)

    def with_entries(self, entries: DataFrame) -> DataFrame:
        """Those of the entries that the ledger doesn't have yet. A different value for a cell, or a value that another row
        has in the same column, is a conflict: entries are never changed or removed."""
        old = self.ledger()
        cell, value = ["TargetTable", "RowKey", "ColumnName"], ["TargetTable", "ColumnName", "Value"]
        new = entries.join(old.select(*cell, "Value"), [*cell, "Value"], "left_anti")
        new = settle(new)
        both = old.unionByName(new)
        for keys, what in ((cell, "a cell has two values"), (value, "a value is given to two rows")):
            touched = new.select(keys).distinct()
            bad = both.join(touched, keys, "left_semi").groupBy(keys).agg(F.count("*").alias("n")).filter("n > 1").limit(3).collect()
            if bad:
                raise LedgerConflict(f"{what}: " + "; ".join(", ".join(str(r[k]) for k in keys) for r in bad))
        return new

    # SQL ------------------------------------------------------------------------------------------------------------

    def sql(self, query: str) -> DataFrame:
        """A T-SQL query over the tables with their computed columns. Bits are 0 and 1 there."""
        names = {}
        for name in self.tables():
            view = "seedloom__" + name.lower().replace(".", "__").replace(" ", "_")
            frame = self.whole(name)
            frame = frame.select([F.col(f"`{f.name}`").cast("int").alias(f.name) if isinstance(f.dataType, T.BooleanType) else F.col(f"`{f.name}`") for f in frame.schema.fields])
            frame.createOrReplaceTempView(view)
            names[name.lower()] = view
            if name.lower().startswith("dbo."):
                names[name[4:].lower()] = view
        return self.spark.sql(translate_sql(query, names))


# Sinks: anything with load(frame, truncate) -> rows -----------------------------------------------------------------


class TableSink:
    def __init__(self, warehouse: Warehouse, table: TableDef) -> None:
        self.warehouse, self.table = warehouse, table

    def load(self, frame: DataFrame, truncate: bool = False) -> int:
        if Warehouse.key(self.table.full_name) not in self.warehouse.manifest().folders:
            self.warehouse.create(self.table, frame.select(self.table.struct().names))
        else:
            self.warehouse.append(self.table.full_name, frame, truncate)
        return frame.count()


class JdbcSink:
    """Rows to a database table in batches."""

    def __init__(self, url: str, table: str, batch_size: int = 10_000, **options: str) -> None:
        self.url, self.table, self.options = url, table, {"batchsize": str(batch_size), **options}

    def load(self, frame: DataFrame, truncate: bool = False) -> int:
        options = self.options | ({"truncate": "true"} if truncate else {})
        frame.write.format("jdbc").options(url=self.url, dbtable=self.table, **options).mode("overwrite" if truncate else "append").save()
        return frame.count()


def sample(frame: DataFrame, order: str, n: int = 5) -> Iterator[str]:
    """The first rows as text, NULL spelled out."""
    kinds = [f for f in frame.schema.fields if f.name != order]
    yield " | ".join(f.name for f in kinds)
    cells = [F.when(F.col(f"`{f.name}`").isNull(), "NULL").otherwise(printed(F.col(f"`{f.name}`"), f.dataType)).alias(f.name) for f in kinds]
    for row in frame.orderBy(order).limit(n).select(cells).collect():
        yield " | ".join(row)
