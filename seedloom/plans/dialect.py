"""T-SQL as Spark SQL: whole statements by rewriting tokens, predicates by a parser that knows the columns' types."""

from __future__ import annotations

from pyspark.sql import types as T

from seedloom.errors import ConfigError
from seedloom.plans.tokens import Reader, Token, tokenize

#: Functions that only change their name.
RENAMED = {"ISNULL": "coalesce", "IIF": "if", "LEN": "length", "GETDATE": "current_timestamp", "SYSUTCDATETIME": "current_timestamp", "SYSDATETIME": "current_timestamp", "GETUTCDATE": "current_timestamp", "NEWID": "uuid", "CEILING": "ceil", "DATALENGTH": "octet_length"}
TYPES = {"FLOAT": "double", "REAL": "float", "BIT": "boolean", "TINYINT": "smallint", "NVARCHAR": "string", "VARCHAR": "string", "NCHAR": "string", "CHAR": "string", "TEXT": "string", "NTEXT": "string", "DATETIME": "timestamp_ntz", "DATETIME2": "timestamp_ntz", "SMALLDATETIME": "timestamp_ntz", "MONEY": "decimal(19,4)", "UNIQUEIDENTIFIER": "string", "NUMERIC": "decimal", "INTEGER": "int"}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def type_name(tokens: list[Token], k: int) -> tuple[str, int]:
    """The Spark type at token k, and the number of the token after it."""
    name = tokens[k].value.upper()
    k += 1
    args = ""
    if tokens[k].text == "(":
        start = k
        while tokens[k].text != ")":
            k += 1
        args = "".join(t.text for t in tokens[start : k + 1])
        k += 1
    spark = TYPES.get(name, name.lower())
    if spark == "string" or spark.startswith(("double", "timestamp")) or "(" in spark:
        args = ""
    if spark == "decimal" and not args:
        args = "(18,0)"
    return spark + args, k


def translate_sql(sql: str, names: dict[str, str] | None = None, made: dict[str, tuple[str, str]] | None = None) -> str:
    """A query for spark.sql. names: what tables are registered as, by 'schema.table' and 'table' in lower case.

    Handled: quoting, TOP, N'..', renamed functions, CONVERT, type names, + between strings where one side is a
    literal, != and the like. Tokens don't tell the types of what is divided: the result chooses by the operands' types. It
    is a double then, of a whole number where both are whole. NEWID() takes a fixed seed."""
    names = {k.lower(): v for k, v in (names or {}).items()}
    made = {} if made is None else made
    tokens = tokenize(sql)
    out: list[str] = []
    tops: list[tuple[int, str]] = []  # depth of the SELECT, rows
    depth = k = 0
    while tokens[k].kind != "end":
        t = tokens[k]
        nxt = tokens[k + 1]
        if t.text == "(":
            depth += 1
        elif t.text == ")":
            while tops and tops[-1][0] == depth:
                out.append(f" LIMIT {tops.pop()[1]}")
            depth -= 1
        if t.kind in ("name", "word") and (t.kind == "name" or t.word() not in RENAMED and nxt.text != "("):
            # A dotted name; if it starts with a known table, that becomes its registered name.
            parts, j = [t], k
            while tokens[j + 1].text == "." and tokens[j + 2].kind in ("name", "word"):
                parts.append(tokens[j + 2])
                j += 2
            values = [p.value for p in parts]
            hit = next((n for n in (3, 2, 1) if len(values) >= n and ".".join(values[:n]).lower() in names), 0)
            before = tokens[k - 1].word() if k else ""
            if hit and (hit > 1 or before in ("FROM", "JOIN") or len(values) > 1):
                rest = [quoted(v) for v in values[hit:]]
                out.append(" " + ".".join([quoted(names[".".join(values[:hit]).lower()]), *rest]))
                k = j + 1
                continue
            if len(parts) > 1 or t.kind == "name":
                out.append(" " + ".".join(quoted(v) for v in values))
                k = j + 1
                continue
        word = t.word()
        if word == "NEWID" and nxt.text == "(" and tokens[k + 2].text == ")":
            out.append(f" uuid({NEWID_SEED})")
            k += 3
            continue
        if t.text == "/" and out:
            start, end = _chain_start(out), _primary_end(tokens, k + 1)
            left, right = "".join(out[start:]).strip(), translate_sql(sql[nxt.at : tokens[end].at], names, made)
            out[start:] = [f" {divided(left, right, made)}"]
            k = end
            continue
        if word == "TOP" and t.kind == "word" and (nxt.kind == "number" or nxt.text == "("):
            if nxt.text == "(":
                tops.append((depth, tokens[k + 2].text))
                k += 4
            else:
                tops.append((depth, nxt.text))
                k += 2
            continue
        if word == "CONVERT" and nxt.text == "(":
            kind, j = type_name(tokens, k + 2)
            start = j + 1
            level, j = 1, start
            while level:
                level += (tokens[j].text == "(") - (tokens[j].text == ")")
                j += 1
            inner = translate_sql(sql[tokens[start].at : tokens[j - 1].at], names)
            out.append(f" cast({inner} as {kind})")
            k = j
            continue
        if word == "AS" and nxt.word() in TYPES and _in_cast(tokens, k):
            kind, j = type_name(tokens, k + 1)
            out.append(f" as {kind}")
            k = j
            continue
        if word in RENAMED and nxt.text == "(":
            out.append(" " + RENAMED[word])
        elif t.kind == "string":
            out.append(" " + literal(t.value))
        elif t.text == "+" and (tokens[k - 1].kind == "string" or nxt.kind == "string"):
            out.append(" ||")
        elif t.text == ";":
            if tokens[k + 1].kind != "end":
                raise ConfigError("only one statement is allowed")
        else:
            out.append((" " if out and t.text not in ("(", ")", ",", ".") or out and t.text == "(" and tokens[k - 1].kind == "op" else "") + t.text)
        k += 1
    while tops:
        out.append(f" LIMIT {tops.pop()[1]}")
    return "".join(out).strip()


NEWID_SEED = 0
WHOLE = "('tinyint', 'smallint', 'int', 'bigint')"
#: Words before a parenthesis that aren't functions.
KEYWORDS = set("SELECT WHERE AND OR NOT IN ON WHEN THEN ELSE BETWEEN LIKE BY HAVING AS FROM JOIN CASE DISTINCT ALL UNION EXISTS LIMIT".split())


def divided(left: str, right: str, made: dict[str, tuple[str, str]]) -> str:
    """A division that cuts off fractions if both sides are whole numbers; which it is, is known once the query is analysed.

    made: for divisions written before, when they are whole and what they are then; one inside an operand counts as whole."""
    conditions, sides = [], []
    for side in (left, right):
        for text, (condition, whole) in made.items():
            if text in side:
                conditions.append(condition)
                side = side.replace(text, whole)
        sides.append(side)
        conditions.append(f"typeof({side}) IN {WHOLE}")
    condition, whole = " AND ".join(conditions), f"(try_cast({sides[0]} AS bigint) div try_cast({sides[1]} AS bigint))"
    out = f"(CASE WHEN {condition} THEN {whole} ELSE ({left}) / ({right}) END)"
    for text in [t for t in made if t in out]:
        del made[text]
    made[out] = condition, whole
    return out


def _chain_start(out: list[str]) -> int:
    """Where the product begins that the written pieces end in."""
    i = len(out) - 1
    while True:
        if out[i].strip() == ")":
            level = 1
            while level and i:
                i -= 1
                level += (out[i].strip() == ")") - (out[i].strip() == "(")
            before = out[i - 1].strip() if i else ""
            if before and before.replace("_", "").isalnum() and before.upper() not in KEYWORDS:
                i -= 1
        elif out[i].strip().upper() == "END":
            level = 1
            while level and i:
                i -= 1
                level += (out[i].strip().upper() == "END") - (out[i].strip().upper() == "CASE")
        if i > 1 and out[i - 1].strip() in ("*", "%"):
            i -= 2
            continue
        return i


def _primary_end(tokens: list[Token], k: int) -> int:
    """The number of the token after the operand at k."""
    while tokens[k].text in ("-", "+"):
        k += 1
    if tokens[k].word() == "CASE":
        level = 1
        while level:
            k += 1
            level += (tokens[k].word() == "CASE") - (tokens[k].word() == "END")
        return k + 1
    if tokens[k].text != "(":
        k += 1
        while tokens[k].text == ".":
            k += 2
    if tokens[k].text == "(":
        level = 1
        while level:
            k += 1
            level += (tokens[k].text == "(") - (tokens[k].text == ")")
        k += 1
    return k


def _in_cast(tokens: list[Token], k: int) -> bool:
    level = 0
    for j in range(k - 1, -1, -1):
        level += (tokens[j].text == ")") - (tokens[j].text == "(")
        if level < 0:
            return tokens[j - 1].word() in ("CAST", "TRY_CAST")
    return False


#: Fixed results of functions in predicates; others keep an unknown type.
RETURNS = {"LEN": "int", "YEAR": "int", "MONTH": "int", "DAY": "int", "UPPER": "str", "LOWER": "str", "LTRIM": "str", "RTRIM": "str", "TRIM": "str", "SUBSTRING": "str", "LEFT": "str", "RIGHT": "str", "REPLACE": "str", "COUNT": "int", "GETDATE": "date", "ROUND": "num", "FLOOR": "num", "CEILING": "num"}
SAME = {"ABS", "COALESCE", "ISNULL", "NULLIF", "MIN", "MAX", "SUM", "AVG"}
FUNCTIONS = {*RETURNS, *SAME, "IIF"}


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(dtype, (T.DecimalType, T.FloatType, T.DoubleType)):
        return "num"
    return {"StringType": "str", "BooleanType": "bit"}.get(type(dtype).__name__, "date")


class Predicate(Reader):
    """A boolean T-SQL expression over one table's columns, as Spark SQL text.

    Integer division follows the columns' types. A query inside may read the rule's own table only."""

    def __init__(self, text: str, table: str = "", schema: T.StructType | None = None, names: dict[str, str] | None = None) -> None:
        super().__init__(text)
        self.table, self.names = table, names or {}
        self.schema = {f.name.lower(): f for f in schema.fields} if schema is not None else None

    def translated(self) -> str:
        if ";" in self.sql:
            raise ConfigError("contains a statement terminator")
        text, kind = self.either()
        if self.now.kind != "end":
            raise self.fail("the end of the expression")
        if kind != "bool":
            raise ConfigError("is not a boolean expression")
        return text

    def fail(self, what: str) -> ConfigError:
        return ConfigError(f"at character {self.now.at + 1}: expected {what}, found {self.now.text or 'the end'!r}")

    def either(self) -> tuple[str, str]:
        return self.chain("OR", self.both)

    def both(self) -> tuple[str, str]:
        return self.chain("AND", self.inverse)

    def chain(self, word: str, part) -> tuple[str, str]:
        text, kind = part()
        while self.take_word(word):
            if kind != "bool":
                raise self.fail(f"a condition before {word}")
            more, kind = part()
            if kind != "bool":
                raise self.fail(f"a condition after {word}")
            text = f"({text} {word} {more})"
        return text, kind

    def inverse(self) -> tuple[str, str]:
        if self.take_word("NOT"):
            text, kind = self.inverse()
            if kind != "bool":
                raise self.fail("a condition after NOT")
            return f"(NOT {text})", "bool"
        if self.is_word("EXISTS"):
            self.next()
            return f"EXISTS {self.query()}", "bool"
        return self.condition()

    def condition(self) -> tuple[str, str]:
        left, kind = self.sum()
        if kind == "bool":
            return left, kind
        op = self.take_op("=", "<>", "!=", "<", "<=", ">", ">=")
        if op:
            right, other = self.sum()
            if kind == "bit" and other == "int":
                right = f"cast({right} as boolean)"
            elif other == "bit" and kind == "int":
                left = f"cast({left} as boolean)"
            return f"({left} {'<>' if op == '!=' else op} {right})", "bool"
        if self.take_word("IS"):
            no = "NOT " if self.take_word("NOT") else ""
            self.need_word("NULL")
            return f"({left} IS {no}NULL)", "bool"
        no = "NOT " if self.take_word("NOT") else ""
        if self.take_word("IN"):
            if self.look().word() == "SELECT":
                return f"({left} {no}IN {self.query()})", "bool"
            self.need_op("(")
            items = [self.sum()[0]]
            while self.take_op(","):
                items.append(self.sum()[0])
            self.need_op(")")
            return f"({left} {no}IN ({', '.join(items)}))", "bool"
        if self.take_word("BETWEEN"):
            low = self.sum()[0]
            self.need_word("AND")
            return f"({left} {no}BETWEEN {low} AND {self.sum()[0]})", "bool"
        if self.take_word("LIKE"):
            return f"({left} {no}LIKE {self.sum()[0]})", "bool"
        if no:
            raise self.fail("IN, BETWEEN or LIKE after NOT")
        return left, kind

    def sum(self) -> tuple[str, str]:
        left, kind = self.product()
        while op := self.take_op("+", "-"):
            right, other = self.product()
            strings = op == "+" and "str" in (kind, other)
            left, kind = (f"({left} || {right})", "str") if strings else (f"({left} {op} {right})", "int" if kind == other == "int" else "num")
        return left, kind

    def product(self) -> tuple[str, str]:
        left, kind = self.unary()
        while op := self.take_op("*", "/", "%"):
            right, other = self.unary()
            ints = kind == other == "int"
            left = f"({left} {'div' if ints and op == '/' else op} {right})"
            kind = "int" if ints else "num"
        return left, kind

    def unary(self) -> tuple[str, str]:
        if op := self.take_op("-", "+"):
            text, kind = self.unary()
            return f"({op}{text})", kind
        return self.primary()

    def primary(self) -> tuple[str, str]:
        t = self.now
        if t.kind == "number":
            self.next()
            return t.text, "int" if t.text.isdigit() else "num"
        if t.kind == "string":
            self.next()
            return literal(t.value), "str"
        if self.is_op("("):
            if self.look().word() == "SELECT":
                return self.query(), "any"
            self.next()
            text, kind = self.either()
            self.need_op(")")
            return f"({text})", kind
        if self.take_word("NULL"):
            return "NULL", "any"
        if self.take_word("CASE"):
            return self.case()
        if self.is_word("CAST", "TRY_CAST") and self.look().text == "(":
            return self.cast()
        if self.is_word("CONVERT") and self.look().text == "(":
            return self.convert()
        if t.kind == "word" and self.look().text == "(":
            return self.call()
        return self.column()

    def kind_name(self, spark: str) -> str:
        return "int" if spark in ("int", "bigint", "smallint") else "str" if spark == "string" else "num" if spark.startswith(("double", "float", "decimal")) else "bit" if spark == "boolean" else "date"

    def typed(self) -> str:
        spark, k = type_name(self.tokens, self.k)
        self.k = k
        return spark

    def cast(self) -> tuple[str, str]:
        word = self.next().text.lower()
        self.need_op("(")
        text, _ = self.sum()
        self.need_word("AS")
        spark = self.typed()
        self.need_op(")")
        return f"{word}({text} as {spark})", self.kind_name(spark)

    def convert(self) -> tuple[str, str]:
        self.next()
        self.need_op("(")
        spark = self.typed()
        self.need_op(",")
        text, _ = self.sum()
        self.need_op(")")
        return f"cast({text} as {spark})", self.kind_name(spark)

    def case(self) -> tuple[str, str]:
        text, kind = "CASE", "any"
        if not self.is_word("WHEN"):
            text += " " + self.sum()[0]
        while self.take_word("WHEN"):
            text += " WHEN " + self.either()[0]
            self.need_word("THEN")
            part, kind = self.sum()
            text += " THEN " + part
        if self.take_word("ELSE"):
            part, other = self.sum()
            text += " ELSE " + part
            kind = kind if other in (kind, "any") else other if kind == "any" else "num"
        self.need_word("END")
        return f"({text} END)", kind

    def call(self) -> tuple[str, str]:
        name = self.next().text.upper()
        if name not in FUNCTIONS:
            raise ConfigError(f"unknown function {name}")
        self.need_op("(")
        args: list[tuple[str, str]] = []
        if self.take_op("*"):
            args.append(("*", "int"))
        elif not self.is_op(")"):
            args.append(self.either())
            while self.take_op(","):
                args.append(self.either())
        self.need_op(")")
        kind = RETURNS.get(name, args[-1][1] if name == "IIF" else args[0][1] if args else "any")
        return f"{RENAMED.get(name, name.lower())}({', '.join(a for a, _ in args)})", kind

    def column(self) -> tuple[str, str]:
        parts = [self.name()]
        while self.take_op("."):
            parts.append(self.name())
        if len(parts) > 1 and self.table and ".".join(parts[:-1]).lower() not in (self.table.lower(), self.table.split(".")[-1].lower()):
            raise ConfigError(f"references {'.'.join(parts[:-1])}, but only {self.table} may be touched")
        name = parts[-1]
        if self.schema is None:
            return quoted(name), "any"
        if name.lower() not in self.schema:
            raise ConfigError(f"unknown column {name!r}")
        field = self.schema[name.lower()]
        return quoted(field.name), kind_of(field.dataType)

    def query(self) -> str:
        """A query in parentheses over the same table."""
        text = self.group()
        tokens = tokenize(text)
        for a, b in zip(tokens, tokens[1:], strict=False):
            if a.word() in ("FROM", "JOIN"):
                k, parts = tokens.index(b), [b.value]
                while tokens[k + 1].text == ".":
                    parts.append(tokens[k + 2].value)
                    k += 2
                if ".".join(parts).lower() != self.table.lower():
                    raise ConfigError(f"references {'.'.join(parts)}, but only {self.table} may be touched")
            elif a.word() in ("UNION", "INTERSECT", "EXCEPT"):
                raise ConfigError(f"{a.text} is not allowed")
        return f"({translate_sql(text, self.names)})"


def translate_value(text: str, table: str, schema: T.StructType) -> str:
    """An expression over one table's columns as Spark SQL, with types known: + joins strings, / of whole numbers is whole."""
    p = Predicate(text, unbracketed(table), schema)
    out, _ = p.either()
    if p.now.kind != "end":
        raise p.fail("the end of the expression")
    return out


def unbracketed(name: str) -> str:
    return ".".join(t.value for t in tokenize(name) if t.kind in ("name", "word"))


def check_predicate(text: str, table: str, schema: T.StructType | None = None) -> str:
    """The predicate as Spark SQL, or an error if it isn't one boolean expression over the table."""
    return Predicate(text, unbracketed(table), schema).translated()
