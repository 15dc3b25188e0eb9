"""CREATE TABLE statements of T-SQL as table definitions and Spark schemas."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from seedloom.errors import ConfigError
from seedloom.plans.tokens import Reader

#: Types with one length argument, and those with precision and scale.
SIZED = {"char", "nchar", "varchar", "nvarchar", "binary", "varbinary", "datetime2", "datetimeoffset", "time", "float"}
TEXT_TYPES = {"char", "nchar", "varchar", "nvarchar", "text", "ntext"}


@dataclass(frozen=True)
class ColumnDef:
    name: str
    sql_type: str
    length: int | None = None  # -1: MAX
    precision: int | None = None
    scale: int | None = None
    nullable: bool = True
    identity: tuple[int, int] | None = None
    computed: str | None = None
    default: str | None = None
    primary_key: bool = False
    unique: bool = False

    @property
    def db_generated(self) -> bool:
        return self.computed is not None or self.sql_type in ("rowversion", "timestamp")

    def spark_type(self) -> T.DataType:
        """Spark has no unsigned byte, no time of day and no GUID: tinyint is a short, the others are strings."""
        fixed = {
            "bit": T.BooleanType(), "tinyint": T.ShortType(), "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(), "money": T.DecimalType(19, 4),
            "smallmoney": T.DecimalType(10, 4), "float": T.DoubleType(), "real": T.FloatType(), "date": T.DateType(), "datetime": T.TimestampNTZType(),
            "datetime2": T.TimestampNTZType(), "smalldatetime": T.TimestampNTZType(), "datetimeoffset": T.TimestampType(), "binary": T.BinaryType(),
            "varbinary": T.BinaryType(), "image": T.BinaryType(), "rowversion": T.BinaryType(), "timestamp": T.BinaryType(),
        }
        if self.sql_type in ("decimal", "numeric"):
            return T.DecimalType(18 if self.precision is None else self.precision, self.scale or 0)
        return fixed.get(self.sql_type, T.StringType())


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    table: str
    referenced: tuple[str, ...]


@dataclass(frozen=True)
class TableDef:
    schema: str
    name: str
    columns: tuple[ColumnDef, ...]
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    checks: tuple[str, ...] = ()

    @property
    def qualified(self) -> str:
        return f"[{self.schema}].[{self.name}]"

    @property
    def full_name(self) -> str:
        return f"{self.schema}.{self.name}"

    def column(self, name: str) -> ColumnDef | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)

    def struct(self) -> T.StructType:
        """The stored columns; what the database itself would fill is left out."""
        return T.StructType([
            T.StructField(c.name, c.spark_type(), True, {"sqlType": c.sql_type, "length": c.length or 0, "nullable": c.nullable, "identity": c.identity is not None})
            for c in self.columns if not c.db_generated
        ])


@dataclass
class _Draft:
    columns: list[dict] = field(default_factory=list)
    key: list[str] = field(default_factory=list)
    unique: list[str] = field(default_factory=list)
    foreign: list[ForeignKey] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)


def parse_script(ddl: str) -> list[TableDef]:
    """All CREATE TABLE statements; other statements are passed over."""
    r, out = Reader(ddl), []
    while r.now.kind != "end":
        if r.is_word("CREATE") and r.look().word() == "TABLE":
            r.next(), r.next()
            out.append(_table(r))
        else:
            r.next()
    if not out:
        raise ConfigError("the script has no CREATE TABLE statement")
    return out


def parse_single(ddl: str, table: str | None = None) -> TableDef:
    """The script's only table, or the named one (with or without its schema, in any case and quoting)."""
    tables = parse_script(ddl)
    available = ", ".join(t.full_name for t in tables)
    if table is None:
        if len(tables) > 1:
            raise ConfigError(f"the script has {len(tables)} tables; name one of: {available}")
        return tables[0]
    wanted = ".".join(p.strip('[]" ') for p in table.split(".")).lower()
    for t in tables:
        if wanted in (t.full_name.lower(), t.name.lower()):
            return t
    raise ConfigError(f"no table {table!r}; available: {available}")


def _qualified(r: Reader) -> tuple[str, str]:
    parts = [r.name()]
    while r.take_op("."):
        parts.append(r.name())
    return (parts[-2] if len(parts) > 1 else "dbo"), parts[-1]


def _names(r: Reader) -> list[str]:
    r.need_op("(")
    out = []
    while True:
        out.append(r.name())
        r.take_word("ASC", "DESC")
        if not r.take_op(","):
            break
    r.need_op(")")
    return out


def _options(r: Reader) -> None:
    """Index options that carry no meaning here."""
    while True:
        if r.take_word("CLUSTERED", "NONCLUSTERED"):
            continue
        if r.is_word("WITH") and r.look().text == "(":
            r.next()
            r.group()
            continue
        if r.is_word("ON") and r.look().kind == "name" or r.is_word("ON") and r.look().word() not in ("DELETE", "UPDATE", ""):
            r.next(), r.next()
            continue
        return


def _references(r: Reader, own: list[str], d: _Draft) -> None:
    schema, name = _qualified(r)
    referenced = _names(r) if r.is_op("(") else []
    while r.is_word("ON", "NOT"):
        if r.take_word("NOT"):
            r.need_word("FOR")
            r.need_word("REPLICATION")
            continue
        r.next(), r.next()
        if not r.take_word("CASCADE"):
            r.next()
            r.take_word("ACTION", "NULL", "DEFAULT")
    d.foreign.append(ForeignKey(tuple(own), f"{schema}.{name}", tuple(referenced)))


def _table(r: Reader) -> TableDef:
    schema, name = _qualified(r)
    d = _Draft()
    r.need_op("(")
    while not r.is_op(")"):
        if r.is_word("CONSTRAINT") or r.is_word("PRIMARY", "UNIQUE", "FOREIGN", "CHECK") and (r.look().text == "(" or r.look().word() in ("KEY", "CLUSTERED", "NONCLUSTERED")):
            _constraint(r, d)
        else:
            _column(r, d)
        if not r.take_op(","):
            break
    r.need_op(")")
    _options(r)
    known = {c["name"].lower(): c for c in d.columns}
    for column in [*d.key, *(d.unique)]:
        if column.lower() not in known:
            raise ConfigError(f"table {schema}.{name}: constraint on unknown column {column!r}")
    for column in d.key:
        known[column.lower()] |= {"primary_key": True, "nullable": False}
    for column in d.unique:
        known[column.lower()]["unique"] = True
    return TableDef(schema, name, tuple(ColumnDef(**c) for c in d.columns), tuple(d.key), tuple(d.foreign), tuple(d.checks))


def _constraint(r: Reader, d: _Draft) -> None:
    if r.take_word("CONSTRAINT"):
        r.name()
    if r.take_word("PRIMARY"):
        r.need_word("KEY")
        _options(r)
        d.key = _names(r)
    elif r.take_word("UNIQUE"):
        _options(r)
        names = _names(r)
        if len(names) == 1:  # joint uniqueness is not enforced
            d.unique += names
    elif r.take_word("FOREIGN"):
        r.need_word("KEY")
        own = _names(r)
        r.need_word("REFERENCES")
        _references(r, own, d)
    elif r.take_word("CHECK"):
        d.checks.append(r.group())
    else:
        raise r.fail("PRIMARY KEY, UNIQUE, FOREIGN KEY or CHECK")
    _options(r)


def _column(r: Reader, d: _Draft) -> None:
    c: dict = {"name": r.name(), "sql_type": "", "nullable": True}
    d.columns.append(c)
    if r.take_word("AS"):
        c["computed"] = r.group() if r.is_op("(") else r.name()
        r.take_word("PERSISTED")
        c["sql_type"] = "computed"
    else:
        c["sql_type"] = _qualified(r)[1].lower()
        if r.is_op("("):
            _arguments(r, c)
    while not (r.is_op(",", ")") or r.now.kind == "end"):
        if r.take_word("CONSTRAINT"):
            r.name()
        elif r.take_word("IDENTITY"):
            c["identity"] = (1, 1)
            if r.is_op("("):
                seed, step = (r.group() + ",1").split(",")[:2]
                c["identity"] = (int(seed), int(step))
            c["nullable"] = False
        elif r.take_word("NOT"):
            if not r.take_word("FOR"):
                r.need_word("NULL")
                c["nullable"] = False
            else:
                r.need_word("REPLICATION")
        elif r.take_word("NULL"):
            c["nullable"] = True
        elif r.take_word("PRIMARY"):
            r.need_word("KEY")
            d.key = [c["name"]]
            _options(r)
        elif r.take_word("UNIQUE"):
            d.unique.append(c["name"])
            _options(r)
        elif r.take_word("CHECK"):
            d.checks.append(r.group())
        elif r.take_word("FOREIGN"):
            r.need_word("KEY")
        elif r.take_word("REFERENCES"):
            _references(r, [c["name"]], d)
        elif r.take_word("DEFAULT"):
            start = r.now.at
            if r.is_op("("):
                r.group()
            else:
                r.take_op("-", "+")
                r.next()
                if r.is_op("("):
                    r.group()
            c["default"] = r.sql[start : r.tokens[r.k - 1].end]
        elif r.take_word("COLLATE"):
            r.name()
        elif r.take_word("ROWGUIDCOL", "SPARSE", "PERSISTED"):
            pass
        else:
            raise r.fail("a column option")


def _arguments(r: Reader, c: dict) -> None:
    args = [a.strip() for a in r.group().split(",")]
    try:
        if c["sql_type"] in ("decimal", "numeric"):
            c["precision"], c["scale"] = int(args[0]), int(args[1]) if len(args) > 1 else 0
        elif args[0].upper() == "MAX":
            c["length"] = -1
        elif c["sql_type"] in SIZED:
            c["length"] = int(args[0])
    except ValueError:
        raise ConfigError(f"column {c['name']!r}: bad type arguments ({', '.join(args)})") from None
