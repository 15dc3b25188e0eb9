"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Base spans come from three patterns. Further candidates are all tokens of 16 or more characters that aren't inside a base
span. A token's encoding is inferred from its characters, and a battery asks whether it could be uniform random text of
that encoding:

* chi-squared over the alphabet, by the number of pairs of equal letters: its exact distribution up to EXACT letters, the
  Wilson-Hilferty form beyond; and over lower case, upper case and the other letters;
* runs above and below the middle of the alphabet, and runs of lower case, upper case and other letters, of which text has
  few and long ones; and the serial correlation of neighbours.

The smallest p-value, times the number of tests, is the battery's; below ALPHA the token isn't random. Whether it is text
is judged by its local false-discovery rate. Text is a model of pairs of letters, fitted once to made-up identifiers, paths
and words; the exact likelihood ratio of uniform letters against it, times the odds of a secret among tokens of that
length (ODDS: shorter tokens are text more often), says how likely the token is text. It becomes a span of kind "random" if
that is at most FDR, so at most that share of what is reported is expected to be text, however few secrets there are; and
a document's spans don't depend on other documents. Spans may hold or overlap base spans. Shorter tokens are found by
the base patterns alone: in under 16 letters keys can't be told from words.

Null text counts as empty. Positions are code points. Repeated rows are scanned each on its own, equal tokens are judged
alike. Very long texts and tokens are scanned whole. Extra columns are kept; if they clash with added names, the added ones
get a suffix. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import math
import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.llm.common import fold, fresh, let, match_spans, replaced, settle, table

ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN_MIN = 12
#: A maximal run of the characters has the asked length or none of its matches has: filtering after or in the pattern is the same.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
SHORTEST = 16
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}+={{0,2}}"
KINDS = ["assign", "access", "hex", "random"]

FDR = 0.05
#: Least p-value of the battery.
ALPHA = 0.002
#: Secrets for each token of text, by the least length of a token.
ODDS = {16: 1e-7, 24: 1e-6, 40: 1e-5}
#: Made-up text tokens of each length and kind that the model of text is fitted to.
DECOYS = 2000
#: Weights of pairs of letters, single letters, and any letter in the model of text.
MIX = 0.8, 0.15, 0.05
#: A bit of the likelihood ratio, in the units of the model's table.
UNIT = 64
#: Letters up to which the number of equal pairs is tested exactly.
EXACT = 64
TESTS = 5

_LOW, _UP, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings in the order in which they are tried: a pattern for the token and the alphabet in its order. What fits none is base 64.
ENCODINGS = [
    (r"^[0-9a-f]+$", _DIGITS + "abcdef"), (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"), (r"^[a-z]+$", _LOW), (r"^[A-Z]+$", _UP), (r"^[A-Za-z]+$", _UP + _LOW), (r"^[A-Z2-7]+$", _UP + "234567"),
    (r"^[0-9a-z]+$", _DIGITS + _LOW), (r"^[0-9A-Z]+$", _DIGITS + _UP), (r"^[0-9A-Za-z]+$", _DIGITS + _UP + _LOW),
]
BASE64 = _UP + _LOW + _DIGITS + "+/"


@functools.cache
def pair_tails(k: int) -> list[list[int]]:
    """For n = SHORTEST..EXACT uniform letters of k: -10 log2 P(at least c pairs of equal letters), for c = 0, 1, ... until it is above 300.

    Counts of letters are independent Poisson numbers given their sum, so the joint distribution of the number of letters
    and of pairs is a k-fold convolution."""
    rate, most = 40.0 / k, 22
    one = np.zeros((160, 1024))
    weight = np.exp(-rate)
    for c in range(most + 1):
        one[c, c * (c - 1) // 2] = weight
        weight *= rate / (c + 1)
    both = np.fft.irfft2(np.fft.rfft2(one) ** k, s=one.shape)
    out = []
    for n in range(SHORTEST, EXACT + 1):
        tail = np.cumsum(np.maximum(both[n], 0)[::-1])[::-1]
        bits = -10 * np.log2(np.maximum(tail / tail[0], 1e-12))
        out.append([round(b) for b in bits[: int(np.argmax(bits > 300))]])
    return out


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution, by a logistic approximation good to about 0.0002."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(z * 1.5976 + z * z * z * 0.07056))


def encoded(token: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with the token's letters x.t and its alphabet x.a."""
    token = F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")
    alphabet = F.lit(BASE64)
    for pattern, chars in reversed(ENCODINGS):
        alphabet = F.when(token.rlike(pattern), F.lit(chars)).otherwise(alphabet)
    return let(F.struct(token.alias("t"), alphabet.alias("a")), body)


def p_value(token: Column) -> Column:
    """The smallest of the battery's p-values times their number: small if the token isn't uniform in its encoding."""
    return encoded(token, lambda x: battery(x["t"], x["a"]))


def battery(t: Column, a: Column) -> Column:
    n, k = F.length(t).cast("double"), F.length(a).cast("double")
    without = lambda s, part: F.length(F.replace(s, part, F.lit("")))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda u, v: u + v)

    # Over the alphabet.
    equal = F.aggregate(F.transform(F.filter(F.split(a, ""), lambda c: c != ""), lambda c: (F.length(t) - without(t, c)).cast("long")), F.lit(0).cast("long"), lambda u, v: u + v * (v - 1)) / 2
    tails = F.create_map(*[x for size in sorted({len(c) for _, c in ENCODINGS} | {len(BASE64)}) for x in (F.lit(size), F.from_json(F.lit(json.dumps(pair_tails(size))), "array<array<int>>"))])
    bits = F.coalesce(F.get(F.get(F.element_at(tails, F.length(a)), F.length(t) - SHORTEST), equal.cast("int")), F.lit(300))
    chi = (equal * 2 + n) * k / n - n
    spread = F.lit(2.0) / ((k - 1) * 9)
    letters = F.when(n <= EXACT, F.pow(F.lit(2.0), bits / -10.0)).otherwise(upper_tail((F.pow(chi / (k - 1), F.lit(1 / 3)) - 1 + spread) / F.sqrt(spread)))

    # Over lower case, upper case, and others.
    def part(chars: str) -> Column:
        size = F.regexp_count(a, F.lit(chars)).cast("double")
        seen = F.regexp_count(t, F.lit(chars)).cast("double")
        return F.when(size > 0, seen * seen * k / (n * size)).otherwise(0.0)

    parts = ["[a-z]", "[A-Z]", "[0-9+/]"]
    kinds = sum((F.when(a.rlike(p), 1).otherwise(0) for p in parts), F.lit(0))
    mix = let(F.greatest(sum(map(part, parts), F.lit(0.0)) - n, F.lit(0.0)), lambda c: F.when(kinds == 3, F.exp(-c / 2)).when(kinds == 2, upper_tail(F.sqrt(c)) * 2).otherwise(1.0))

    # Runs.
    def of_halves(s: Column) -> Column:
        high = (F.length(s) - without(s, F.lit("H"))).cast("double")
        runs = (F.length(s) - without(s, F.lit("LH")) + F.length(s) - without(s, F.lit("HL"))) / 2 + 1
        mean = high * (n - high) * 2 / n + 1
        var = F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9))
        return upper_tail(F.greatest(F.abs(runs - mean) - 0.5, F.lit(0.0)) / F.sqrt(var)) * 2

    half = F.floor(k / 2).cast("int")
    halves = F.call_function("translate", t, a, F.concat(F.repeat(F.lit("L"), half), F.repeat(F.lit("H"), k.cast("int") - half)))

    # Runs of lower case, upper case and others: changes from one letter to the next, for independent letters.
    def changes(s: Column) -> Column:
        seen = sum((F.length(s) - without(s, F.lit(x + y)) for x in "LUD" for y in "LUD" if x != y), F.lit(0)) / 2
        share = [F.regexp_count(a, F.lit(chars)) / k for chars in parts]
        two, three = (sum((F.pow(x, F.lit(float(e))) for x in share), F.lit(0.0)) for e in (2, 3))
        var = (n - 1) * two * (F.lit(1.0) - two) + (n - 2) * 2 * (three - two * two)
        return F.when(kinds == 1, 1.0).otherwise(upper_tail(F.greatest((n - 1) * (F.lit(1.0) - two) - seen - 0.5, F.lit(0.0)) / F.sqrt(F.greatest(var, F.lit(1e-9)))))

    classes = F.translate(t, _LOW + _UP + _DIGITS + "+/", "L" * 26 + "U" * 26 + "D" * 12)

    # Serial correlation.
    codes = F.filter(F.transform(F.split(t, ""), lambda c: F.position(c, a).cast("double")), lambda v: v > 0)
    centred = let(codes, lambda x: let(total(x) / n, lambda m: F.transform(x, lambda v: v - m)))
    of_codes = lambda d: F.abs(total(F.zip_with(d, F.slice(d, F.lit(2), F.greatest(F.size(d) - 1, F.lit(0))), lambda u, v: u * F.coalesce(v, F.lit(0.0))))) / F.greatest(total(F.transform(d, lambda v: v * v)), F.lit(1e-9)) * F.sqrt(n)
    return F.least(F.lit(1.0), F.least(letters, mix, let(halves, of_halves), let(classes, changes), upper_tail(let(centred, of_codes)) * 2) * TESTS)


#: Parts of made-up identifiers.
WORDS = """account action address admin after array async average backup batch before block browser buffer build button cache
category center channel check child client cluster collection column command comment commit config connection container content
context controller copy count create current customer data database date default delete deploy description detail device dialog
directory document download driver dynamic editor element email enable engine entity error event example export factory feature
field file filter folder format framework function gateway general generator global group handler header height history image
import index input instance integration interface internal international invoice item javascript job language layout length
library license link list loader local logger login manager mapper memory message method migration minimum mobile model module
monitor network node notification number object offset operation option order output package page parent parser partition
password payment percentage performance permission platform plugin pointer policy position preview process product profile
program project property protocol provider public quality query queue random range reader record reference region register
release remote report repository request resource response result return review role route sample schema scheduler script search
section security selection server service session setting shared signature simple snapshot source standard start state static
status storage stream string structure style summary support symbol system table target task template temporary terminal test
text thread timestamp title token tracking transaction transfer translation type update upload user utility validation value
variable vector verification version video view virtual warning width window worker workflow wrapper""".split()


def decoy(r: random.Random, low: int, high: int, letters: bool) -> str:
    """A made-up identifier, path or word of low to high - 1 characters."""
    style = r.choice(["camel", "pascal", "run", "upper"] if letters else ["camel", "snake", "kebab", "path", "constant", "run"])
    joint = {"snake": "_", "kebab": "-", "path": "/", "constant": "_"}.get(style, "")
    while True:
        parts, n = [], r.randint(low, high - 1)
        while len(joint.join(parts)) < n:
            word = r.choice(WORDS)
            word = word.upper() if style in ("upper", "constant") else word.capitalize() if style == "pascal" or (style == "camel" and parts) else word
            parts.append(word)
            if not letters and r.random() < 0.35:
                parts.append(r.choice([str(r.randint(0, 9)), str(r.randint(10, 99)), str(r.randint(1990, 2030)), f"v{r.randint(1, 20)}", f"{r.randint(2000, 2030)}{r.randint(1, 12):02}{r.randint(1, 28):02}", str(r.randint(100, 99999))]))
        out = joint.join(parts)[:n]
        if len(out) >= low and out.isalpha() == letters:
            return out


#: Words of several languages, in which pairs of letters are others than in identifiers.
OTHER_WORDS = """aber acht alles anderen arbeit auch aufgabe auszug beaucoup beispiel besser biblioteca bleu bonheur bruecke buch
cabeza caballo ceux chaque chateau chercher chevaux chose ciudad coche cheveux corazon cuatro danach dessous deutschland dieu
donde doux drei durch eau eaux eigentlich einfach elle encore enfant ensuite entonces entschuldigung escuela espanol etwas europe
faux fenetre feuille fuego fleur gabel gegen geschichte gesundheit glueck gracias haus heureux hijo hoch huevo huit ihr jahre jamais
jeudi jeune joven jugend juego kaufen keit kirche kopf kurz langue leiten leute lieu llamar llave lourd lueur luz maintenant majeure
mensch mieux milieu monde morgen muchacho nacht neuf neuve nieve noche nouveau nouvelle nunca oiseau oui ouvrir pfeffer pferd
pflanze platz pourquoi pouvoir puente pueblo quand quatre que queue quiero quoi raison recht reich rouge rueda ruhig schiff schluss
schnell schreiben schule schwarz sehr siecle soeur soleil sombra sprache stadt strasse stueck suerte tiempo topf toujours travail
trois tzar ueber unterschied veinte verkauf vieux viel viento vogel voix wahrheit wasser weiss werk wichtig wirtschaft woche wunsch
yeux zapato zeit zucker zukunft zurueck zwei zwischen""".split()


@functools.cache
def made_up(seed: int = 7) -> list[str]:
    """Identifiers, paths, and words of several languages put together."""
    r = random.Random(seed)
    lengths = [*ODDS, 2 * max(ODDS)]
    out = [decoy(r, low, high, letters) for low, high in zip(lengths, lengths[1:], strict=False) for letters in (False, True) for _ in range(DECOYS)]
    for _ in range(2 * DECOYS):
        words = [r.choice(OTHER_WORDS) for _ in range(r.randint(3, 6))]
        style = r.randrange(4)
        out.append({0: "".join(words), 1: "_".join(words), 2: "".join(w.capitalize() for w in words), 3: "-".join(words)}[style])
    return out


@functools.cache
def text_bits() -> list[list[int]]:
    """Information of a letter (BASE64, - and _ as + and /) in text after the letter of the row, in UNIT-ths of a bit; the
    last row is for first letters."""
    n = len(BASE64)
    of = {c: k for k, c in enumerate(BASE64)} | {"-": BASE64.index("+"), "_": BASE64.index("/")}
    counts = np.zeros((n + 1, n))
    for token in made_up():
        at = [n, *(of[c] for c in token)]
        np.add.at(counts, (at[:-1], at[1:]), 1)
    single = (counts.sum(axis=0) + 1) / (counts.sum() + n)
    rows = counts.sum(axis=1, keepdims=True)
    pairs = np.where(rows > 0, counts / np.maximum(rows, 1), single)
    return np.rint(-np.log2(MIX[0] * pairs + MIX[1] * single + MIX[2] / n) * UNIT).astype(int).tolist()


def need(n: Column) -> Column:
    """Bits by which letters must be likelier as random than as text, for a token of n letters."""
    out = F.lit(0.0)
    for least in sorted(ODDS):
        out = F.when(n >= least, F.lit(math.log2((1 - FDR) / FDR / ODDS[least]))).otherwise(out)
    return out


def evidence(token: Column) -> Column:
    """Bits of the likelihood ratio of uniform letters in the token's encoding against text."""
    flat = F.from_json(F.lit(json.dumps([x for row in text_bits() for x in row])), "array<int>")
    n = len(BASE64)

    def of(x: Column) -> Column:
        codes = F.transform(F.filter(F.split(x["t"], ""), lambda c: c != ""), lambda c: F.position(c, F.lit(BASE64)) - 1)
        pairs = let(codes, lambda c: F.zip_with(F.concat(F.array(F.lit(n)), F.slice(c, F.lit(1), F.size(c) - 1)), c, lambda p, q: F.get(flat, p * n + q)))
        total = F.aggregate(pairs, F.lit(0).cast("long"), lambda u, v: u + v)
        return total / UNIT - F.length(x["t"]) * F.log2(F.length(x["a"]).cast("double"))

    return encoded(token, of)


def is_random(token: Column) -> Column:
    """Whether a token is a secret: likelier random than text by enough, and random to the battery."""
    n = F.length(F.rtrim(token, F.lit("=")))
    return F.when(evidence(token) >= need(n), p_value(token) >= ALPHA).otherwise(False)


def kind_of(spans: Column, kind: str) -> Column:
    """Spans to be sorted by start, then kind as listed."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))


SPANS = "array<struct<s:int,k:int,e:int>>"


def base_spans(text: Column) -> Column:
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")
    assign = F.when(text.rlike(ASSIGN_HINT), F.filter(match_spans(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= ASSIGN_MIN)).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), match_spans(text, ACCESS)).otherwise(none)
    hexes = F.when(text.rlike(HEX), match_spans(text, HEX)).otherwise(none)
    return F.sort_array(F.concat(*[kind_of(x, kind) for x, kind in zip((assign, access, hexes), KINDS[:3], strict=True)])).cast(SPANS)


def random_spans(text: Column, base: Column) -> Column:
    """array<struct<s, k, e>> of random tokens that aren't inside a base span."""
    kind = "array<struct<s:int,token:boolean,e:int,m:string>>"
    mark = lambda spans, token: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(token).alias("token"), x["e"].alias("e"), (x["m"] if token else F.lit("")).alias("m"))).cast(kind)
    # By start, so that a token is inside a base span if one of those before it ends no earlier.
    step = lambda at, x: (F.when(x["token"], at).otherwise(F.greatest(at, x["e"])), F.filter(F.array(x), lambda y: y["token"] & (y["e"] > at)))
    found = fold(F.sort_array(F.concat(mark(base, False), mark(match_spans(text, CANDIDATE), True))), F.lit(0), kind, step)
    secrets = kind_of(F.filter(found, lambda x: is_random(x["m"])), "random")
    return F.when(text.rlike(rf"[A-Za-z0-9+/_-]{{{SHORTEST}}}"), secrets).otherwise(F.expr(f"cast(array() as {SPANS})")).cast(SPANS)


def scan(docs: DataFrame, keep: list[str], text_col: str = "text") -> tuple[DataFrame, str, str]:
    """The columns keep of docs with base spans and all spans (s, k: index in KINDS, e), and these columns' names."""
    base, more, text = fresh(docs, "base_spans", "spans", "scanned_text")
    rows = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text)).withColumn(base, base_spans(F.col(text)))
    # Written once: what reads the spans would else look for them again for each of its uses.
    rows = settle(rows.withColumn(more, random_spans(F.col(text), F.col(base))).drop(text))
    return rows.withColumn(more, F.sort_array(F.concat(F.col(base), F.col(more)))), base, more


def spelled(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with all spans of text_col replaced by [SECRET]."""
    rows, _, spans = scan(docs, docs.columns, text_col)
    return rows.withColumn(text_col, replaced(F.col(text_col), F.col(spans), "[SECRET]")).select(docs.columns)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, base, spans = scan(table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda k: F.size(F.filter(base, lambda x: x["k"] == k)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spelled(F.col(base)), 256).alias("base_sha256"), spelled(F.col(spans)).alias("spans"))
