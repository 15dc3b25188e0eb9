"""Personal data: base patterns, and candidates that boosted trees accept or turn down.

Four base kinds are found by patterns with checks (range of address parts, Luhn sum, number of digits) and always stay.
High-recall patterns propose further spans, which may overlap; features of a span's format and of the characters around
it go through boosted trees, and a calibrated threshold for each kind selects. From left to right, a selected span that
overlaps a base span goes, and of two that overlap the one with the higher score stays.

The tables hold no labelled spans. The trees are fitted on the driver on EXAMPLES made-up ones, half of them in contexts
of the documents themselves: personal data where base spans stand, other numbers (versions, orders, figures, parts of
longer tokens, the same formats too) at places of ordinary text. At most CONTEXTS of each are taken, those with the
smallest hashes; the words that tell both sorts apart become a feature. Thresholds come from examples that the fit didn't
see: the lowest at which PRECISION is reached. Trees become Spark columns.

Null text counts as empty. Positions are code points. Repeated rows are scanned each on its own; of spans with equal
scores the first stays. Very long texts are scanned whole. Extra columns are kept; if they clash with added names, the
added ones get a suffix. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.llm import trees
from seedloom.llm.common import MATCHES, fold, fresh, let, match_spans, replaced, settle, table

# A match can start after the end of another one or at the start of a run; within a run, later starts match no better
# than the first, and trying them all would take quadratic time. Possessive loops take what greedy ones take here.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
BASE = ["email", "ip", "card", "phone"]

#: Proposed kinds: the pattern, and what must occur in the text for it to match.
PROPOSED = {
    "masked_email": (r"[A-Za-z0-9._%+-]{1,64} ?[\[({] ?(?:at|AT) ?[\])}] ?[A-Za-z0-9-]{1,63}(?: ?[\[({] ?(?:dot|DOT) ?[\])}] ?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63}){1,5}", r"[\[({] ?(?:at|AT) ?[\])}]"),
    "local_phone": (r"\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}", r"[0-9][ .-][0-9]{3}"),
    "iban": (r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
    "social_number": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]-[0-9]{2}-[0-9]"),
    "hardware_address": (r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}", r"[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]"),
    "ipv6": (r"(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}", r"[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:"),
    "birth_date": (r"[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}", r"[0-9][./-][0-9]{1,2}[./-][0-9]"),
}
KINDS = [*BASE, *PROPOSED]
#: What a text must have for any of them: cheaper than all hints.
ANY_HINT = r"[0-9:\[({]|[A-Fa-f]{2}-[A-Fa-f]{2}-"

#: Made-up spans for the fit and for the thresholds, each; and what share of the selected spans must be right there.
EXAMPLES, PRECISION = 4000, 0.97
#: Contexts of each sort from the documents, and words of them that are told apart, at most.
CONTEXTS, WORDS = 4000, 200
TREES, DEPTH = 20, 3
#: Characters of context on each side.
AROUND = 24
FOR_CONTEXT = r"phone|tel|call|fax|mobile|mail|contact|iban|account|bank|ssn|social|security|mac|device|host|address|born|birth|dob"
AGAINST_CONTEXT = r"version|order|isbn|figure|fig|page|table|section|ticket|build|release|score|ratio|part|model|item|ref"
FEATURES = ["kind", "length", "digits", "letters", "separators", "glued_before", "glued_after", "for", "against", "year", "distinct", "check", "learned"]


WORD = r"[a-z]{2,}"


def iban_check(x: Column) -> Column:
    """Whether letters and digits pass the check of account numbers (ISO 7064, modulo 97)."""
    bare = F.regexp_replace(x, "[^A-Z0-9]", "")
    moved = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda a, c: ((a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97).cast("int"))
    return F.when(x.rlike("^[A-Z0-9 ]{15,}$"), F.when(rest == 1, 1).otherwise(0)).otherwise(0)


def iban_check_of(x: str) -> bool:
    bare = re.sub("[^A-Z0-9]", "", x)
    return bool(re.fullmatch("[A-Z0-9 ]{15,}", x)) and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def features(x: Column, kind: Column, before: Column, after: Column, words: dict[str, float]) -> list[Column]:
    n = F.length(x)
    count = lambda p: F.regexp_count(x, F.lit(p))
    flag = lambda c: F.when(c, 1).otherwise(0)
    low = F.lower(before)
    known = F.from_json(F.lit(json.dumps(words)), "map<string,double>")
    learned = F.aggregate(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.lit(0.0), lambda a, w: a + F.coalesce(F.element_at(known, w), F.lit(0.0)))
    return [
        kind, n, count("[0-9]"), count("[A-Za-z]"), count(r"[\x20().:/\[\]{}-]"), flag(before.rlike(r"[A-Za-z0-9][./:-]?$")), flag(after.rlike(r"^[./:-]?[A-Za-z0-9]")),
        flag(low.rlike(FOR_CONTEXT)), flag(low.rlike(AGAINST_CONTEXT)), flag(x.rlike(r"(?:^|[^0-9])(?:19|20)[0-9]{2}(?:$|[^0-9])")), F.size(F.array_distinct(F.split(x, ""))), iban_check(x), F.round(learned, 6),
    ]


def features_of(x: str, kind: int, before: str, after: str, words: dict[str, float]) -> list[float]:
    """The same on the driver."""
    count = lambda p: len(re.findall(p, x))
    low = before.lower()
    return [
        kind, len(x), count("[0-9]"), count("[A-Za-z]"), count(r"[\x20().:/\[\]{}-]"), bool(re.search(r"[A-Za-z0-9][./:-]?$", before)), bool(re.search(r"^[./:-]?[A-Za-z0-9]", after)),
        bool(re.search(FOR_CONTEXT, low)), bool(re.search(AGAINST_CONTEXT, low)), bool(re.search(r"(?:^|[^0-9])(?:19|20)[0-9]{2}(?:$|[^0-9])", x)), len(set(x)), iban_check_of(x), round(sum(words.get(w, 0.0) for w in re.findall(WORD, low)), 6),
    ]


#: What stands before and after a span.
Context = tuple[str, str]


def contexts(docs: DataFrame, text_col: str = "text") -> tuple[list[Context], list[Context]]:
    """Contexts of base spans, and of places of ordinary text (one in each document); a bounded sample of each."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut = lambda s, e: F.struct(F.substring(text, F.greatest(s - AROUND, F.lit(0)) + 1, F.least(s, F.lit(AROUND))).alias("before"), F.substring(text, e + 1, F.lit(AROUND)).alias("after"))
    place = let(F.pmod(F.xxhash64(text), F.length(text) + 1).cast("int"), lambda at: cut(at, at))
    found = settle(docs.select(F.explode(F.concat(
        F.transform(base_spans(text), lambda x: F.struct(F.lit(True).alias("base"), cut(x["s"], x["e"]).alias("c"))), F.array(F.struct(F.lit(False).alias("base"), place.alias("c"))))).alias("x")).select("x.base", "x.c.before", "x.c.after"))
    sample = lambda base: [(r[0], r[1]) for r in found.filter(F.col("base") == base).select("before", "after").orderBy(F.xxhash64("before", "after"), "before", "after").limit(CONTEXTS).collect()]
    return sample(True), sample(False)


def telling_words(near: list[Context], plain: list[Context]) -> dict[str, float]:
    """Log-odds of words before spans against words at other places, for those seen five times or more."""
    seen = [Counter(w for before, _ in c for w in set(re.findall(WORD, before.lower()))) for c in (near, plain)]
    if not near or not plain:
        return {}
    odds = {w: float(np.log((seen[0][w] + 1) / (len(near) + 2)) - np.log((seen[1][w] + 1) / (len(plain) + 2))) for w in sorted({*seen[0], *seen[1]}) if seen[0][w] + seen[1][w] >= 5}
    return {w: round(odds[w], 6) for w in sorted(odds, key=lambda w: (-abs(odds[w]), w))[:WORDS]}


def account_number(country: str, body: str) -> str:
    """With its check digits."""
    return f"{country}{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02}{body}"


def examples(seed: int, n: int, near: list[Context], plain: list[Context], words: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Made-up spans, half of them personal data, in made-up contexts and in those of the documents."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))
    joint = lambda: r.choice(" .-")
    spaced = lambda t: " ".join(t[k : k + 4] for k in range(0, len(t), 4))
    make = {
        "masked_email": lambda: f"{word()}{r.choice(['', ' '])}{r.choice(['[at]', '(at)', '{at}'])}{r.choice(['', ' '])}{word()}{r.choice([' [dot] ', '(dot)', '.'])}{r.choice(['com', 'org', 'net'])}",
        "local_phone": lambda: f"({digits(3)}) {digits(3)}-{digits(4)}" if r.random() < 0.5 else joint().join([digits(3), digits(3), digits(4)]),
        "iban": lambda: r.choice([str, spaced])(account_number(r.choice(["DE", "FR", "ES", "NL", "IT"]), digits(4 * r.randint(3, 5) + r.choice([0, 2])))),
        "social_number": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "hardware_address": lambda: r.choice(":-").join(hexes(2) for _ in range(6)),
        "ipv6": lambda: r.choice([":".join(hexes(r.randint(1, 4)) for _ in range(8)), f"2001:db8::{hexes(3)}:{hexes(4)}", f"fe80::{hexes(4)}:{hexes(4)}:{hexes(4)}"]),
        "birth_date": lambda: r.choice([f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1920, 2015)}", f"{r.randint(1920, 2015)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"]),
    }
    other = {
        "masked_email": lambda: f"{word()} (at) {word()}.{digits(2)}", "local_phone": lambda: joint().join([digits(r.randint(2, 4)), digits(r.randint(3, 4)), digits(r.randint(3, 4))]),
        "iban": lambda: r.choice(["AB", "XK", "PN", "QZ"]) + digits(2) + "".join(r.choice(["", " "]) + "".join(r.choice("ABCDEFGHXYZ0123456789") for _ in range(4)) for _ in range(2)),
        "social_number": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", "hardware_address": lambda: "-".join(digits(2) for _ in range(6)),
        "ipv6": lambda: r.choice([":".join(digits(2) for _ in range(4)), f"{word()[:1]}{digits(1)}::{hexes(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}:{digits(3)}"]), "birth_date": lambda: r.choice([f"{r.randint(1, 20)}.{r.randint(0, 99)}.{r.randint(0, 999)}", f"{r.randint(2016, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"]),
    }
    for_, against = FOR_CONTEXT.split("|"), AGAINST_CONTEXT.split("|")
    own = near if near and plain else []
    x, y = [], []
    for k in range(n):
        kind = r.choice(list(PROPOSED))
        good = k % 2 == 0
        # Dates and bare numbers are personal only with a word that says so.
        says = r.random() < (1.0 if kind in ("birth_date", "social_number", "local_phone") else 0.6)
        hint = r.choice(for_) if good and says else r.choice(against) if not good and r.random() < 0.5 else word()
        before = f"{word()} {hint}{r.choice([' ', ': ', ' is '])}"
        after = r.choice([" ", ". ", ", ", "\n"]) + word()
        # In the documents' contexts dates and bare numbers need the word as well.
        if own and r.random() < 0.5:
            before, after = r.choice(near if good else plain)
            before = f"{before} {hint} " if good and says and hint in for_ else f"{before} "
        if not good and r.random() < 0.3:
            before, after = r.choice([(before + digits(2) + "-", after), (before, "." + digits(2)), (before + word() + "/", after)])
        span = make[kind]() if good or (r.random() < 0.4 and kind not in ("iban", "masked_email", "hardware_address", "ipv6")) else other[kind]()
        x.append(features_of(span, KINDS.index(kind), before[-AROUND:], after[:AROUND], words))
        y.append(good)
    return np.array(x, dtype=float), np.array(y, dtype=float)


@dataclass(frozen=True)
class Model:
    start: float
    grown: tuple[trees.Tree, ...]
    #: Log-odds from which a kind's spans are selected; none: never.
    least: dict[str, float]
    #: Words of contexts and what they speak for.
    words: dict[str, float]

    def odds(self, x: list[Column]) -> Column:
        total = F.lit(self.start)
        for tree in self.grown:
            total = total + trees.column(tree, x)
        return total


def fit(docs: DataFrame | None = None, text_col: str = "text", seed: int = 11) -> Model:
    """Without documents, on made-up contexts alone."""
    near, plain = contexts(docs, text_col) if docs is not None else ([], [])
    words = telling_words(near, plain)
    x, y = examples(seed, EXAMPLES, near, plain, words)
    start, grown = trees.boost(x, y, TREES, DEPTH)
    x, y = examples(seed + 1, EXAMPLES, near, plain, words)
    z = start + sum(trees.predict(t, x) for t in grown)
    least = {}
    for kind in PROPOSED:
        own = x[:, 0] == KINDS.index(kind)
        order = np.argsort(-z[own], kind="stable")
        right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero((right >= PRECISION) & (np.arange(own.sum()) >= 10))
        if len(good):
            least[kind] = max(0.0, float(z[own][order][good[-1]]))
    return Model(start, tuple(grown), least, words)


def luhn(card: Column) -> Column:
    """Whether 13 to 19 digits pass the Luhn sum."""

    def of(digits: Column) -> Column:
        backward = F.reverse(F.split(digits, ""))

        def value(c: Column, i: Column) -> Column:
            v = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
            return F.when(v > 9, v - 9).otherwise(v)

        return F.length(digits).between(13, 19) & (F.aggregate(F.transform(F.filter(backward, lambda c: c != ""), value), F.lit(0), lambda a, v: a + v) % 10 == 0)

    return let(F.regexp_replace(card, "[^0-9]", ""), of)


SPANS = "array<struct<k:int,s:int,e:int>>"


def base_spans(text: Column) -> Column:
    """Sorted by kind, then start."""
    none = F.expr(f"cast(array() as {MATCHES})")
    guarded = lambda hint, pattern: F.when(hint, match_spans(text, pattern)).otherwise(none)
    n_digits = lambda x: F.length(F.regexp_replace(x, "[^0-9]", ""))
    found = [
        guarded(F.contains(text, F.lit("@")), EMAIL),
        F.filter(guarded(text.rlike(r"[0-9]\.[0-9]"), IP), lambda x: x["m"].rlike(IP_PARTS)),
        F.filter(guarded(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), CARD), lambda x: luhn(x["m"])),
        F.filter(guarded(text.rlike(r"\+[0-9]"), PHONE), lambda x: n_digits(x["m"]).between(9, 15)),
    ]
    tag = lambda k: lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"))
    return F.concat(*[F.transform(x, tag(k)) for k, x in enumerate(found)]).cast(SPANS)


def proposed_spans(text: Column, base: Column, model: Model) -> Column:
    """Selected spans that overlap neither base spans nor each other."""
    kind = "array<struct<s:int,e:int,k:int,z:double>>"
    none = F.expr(f"cast(array() as {kind})")

    def of(name: str) -> Column:
        pattern, hint = PROPOSED[name]
        k = F.lit(KINDS.index(name))

        def scored(x: Column) -> Column:
            before = F.substring(text, F.greatest(x["s"] - AROUND, F.lit(0)) + 1, F.least(x["s"], F.lit(AROUND)))
            z = let(F.array(*[f.cast("double") for f in features(x["m"], k, before, F.substring(text, x["e"] + 1, F.lit(AROUND)), model.words)]), lambda f: model.odds([F.get(f, i) for i in range(len(FEATURES))]))
            return F.struct(x["s"].alias("s"), x["e"].alias("e"), k.alias("k"), z.alias("z"))

        return F.when(text.rlike(hint), F.filter(F.transform(match_spans(text, pattern), scored), lambda x: x["z"] >= model.least[name]).cast(kind)).otherwise(none)

    chosen = F.concat(none, *[of(name) for name in PROPOSED if name in model.least])
    fixed = F.transform(base, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), F.lit(1e9).alias("z"))).cast(kind)

    def resolved(own: Column) -> Column:
        def step(last: Column, x: Column) -> tuple[Column, Column]:
            apart = (x["s"] >= last["e"]) | ((x["z"] == 1e9) & (last["z"] == 1e9))
            stays = ~apart & (x["z"] <= last["z"])
            return F.when(stays, last).otherwise(x), F.when(apart & (last["e"] >= 0), F.array(last).cast(kind)).otherwise(none)

        start = F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"), F.lit(-1).alias("k"), F.lit(0.0).alias("z"))
        left = fold(F.sort_array(F.concat(own, fixed)), start, kind, step, F.array)
        return F.sort_array(F.transform(F.filter(left, lambda x: x["z"] < 1e9), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))).cast(SPANS)

    return let(chosen, lambda own: F.when(F.size(own) == 0, F.expr(f"cast(array() as {SPANS})")).otherwise(resolved(own)))


def scan(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> tuple[DataFrame, str, str]:
    """docs with base spans and the other spans (k: index in KINDS, s, e), and these columns' names."""
    base, more, text = fresh(docs, "base_spans", "more_spans", "scanned_text")
    model = model or fit(docs, text_col)
    rows = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    both = let(base_spans(F.col(text)), lambda b: F.struct(b.alias("b"), F.when(F.col(text).rlike(ANY_HINT), proposed_spans(F.col(text), b, model)).otherwise(F.expr(f"cast(array() as {SPANS})")).alias("m")))
    return rows.withColumn(base, both).withColumn(more, F.col(base)["m"]).withColumn(base, F.col(base)["b"]).drop(text), base, more


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with all spans of text_col replaced by [PRIVATE]."""
    rows, base, more = scan(docs, text_col)
    spans = F.sort_array(F.transform(F.concat(base, more), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    return rows.withColumn(text_col, replaced(F.col(text_col), spans, "[PRIVATE]")).select(docs.columns)


def spelled(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, base, more = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter(base, lambda x: x["k"] == k)).cast("long")
    return rows.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)], F.sha2(spelled(F.col(base)), 256).alias("base_sha256"), spelled(F.concat(base, more)).alias("spans"))
