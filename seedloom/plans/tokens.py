"""Tokens of T-SQL text, for the DDL reader, the predicate parser and the translator."""

from __future__ import annotations

import re
from dataclasses import dataclass

from seedloom.errors import ConfigError

PATTERN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>[Nn]?'(?:[^']|'')*')|(?P<bracket>\[(?:[^\]]|\]\])*\])|(?P<quoted>"(?:[^"]|"")*")"""
    r"""|(?P<number>(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)|(?P<word>[^\W\d][\w$#@]*)|(?P<op><>|<=|>=|!=|\|\||[-+*/%=<>(),.;])""",
    re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str  # string, name, number, word, op, end
    text: str  # as written
    at: int
    end: int
    value: str  # a name or string without its quotes

    def word(self) -> str:
        return self.value.upper() if self.kind == "word" else ""


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = PATTERN.match(sql, at)
        if m is None:
            raise ConfigError(f"{place(sql, at)}: unexpected character {sql[at]!r}")
        kind, text = m.lastgroup, m[0]
        at = m.end()
        if kind == "space":
            continue
        value = text
        if kind == "string":
            value = text[text.index("'") + 1 : -1].replace("''", "'")
        elif kind == "bracket":
            kind, value = "name", text[1:-1].replace("]]", "]")
        elif kind == "quoted":
            kind, value = "name", text[1:-1].replace('""', '"')
        out.append(Token(kind, text, m.start(), m.end(), value))
    out.append(Token("end", "", len(sql), len(sql), ""))
    return out


def place(sql: str, at: int) -> str:
    before = sql[:at]
    return f"line {before.count(chr(10)) + 1}, column {at - (before.rfind(chr(10)) + 1) + 1}"


class Reader:
    def __init__(self, sql: str) -> None:
        self.sql, self.tokens, self.k = sql, tokenize(sql), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.k]

    def look(self, n: int = 1) -> Token:
        return self.tokens[min(self.k + n, len(self.tokens) - 1)]

    def next(self) -> Token:
        t = self.now
        self.k = min(self.k + 1, len(self.tokens) - 1)
        return t

    def fail(self, what: str) -> ConfigError:
        return ConfigError(f"{place(self.sql, self.now.at)}: expected {what}, found {self.now.text or 'the end'!r}")

    def is_word(self, *words: str) -> bool:
        return self.now.word() in words and self.now.kind == "word"

    def is_op(self, *ops: str) -> bool:
        return self.now.kind == "op" and self.now.text in ops

    def take_word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.next()
            return True
        return False

    def take_op(self, *ops: str) -> str:
        return self.next().text if self.is_op(*ops) else ""

    def need_word(self, *words: str) -> None:
        if not self.take_word(*words):
            raise self.fail(" or ".join(words))

    def need_op(self, op: str) -> None:
        if not self.take_op(op):
            raise self.fail(repr(op))

    def name(self) -> str:
        if self.now.kind in ("word", "name"):
            return self.next().value
        raise self.fail("a name")

    def group(self) -> str:
        """The text of a balanced group in parentheses, without them."""
        self.need_op("(")
        start, depth = self.now.at, 1
        while depth:
            if self.now.kind == "end":
                raise self.fail("')'")
            depth += self.is_op("(") - self.is_op(")")
            last = self.next()
        return self.sql[start : last.at].strip()
