"""The Jaccard join, the divergence audit and the lexical search against plain versions."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from cases import LOW, documents
from test_similar import edited

from seedloom.llm import catalog, components, divergence, lexical_search, signature_tree

ROWS = documents()
SIMPLE = "doc_id long, text string"


def collected(df):
    return Counter(tuple(r) for r in df.collect())


def jaccard_set(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def jaccard_rows(rows, percent=90):
    """doc_id, n_shingles, component_id by comparing all pairs."""
    sets, root = [jaccard_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and (x == sets[j] or 100 * min(len(x), len(sets[j])) >= percent * max(len(x), len(sets[j])) and 100 * len(x & sets[j]) >= percent * len(x | sets[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return Counter((doc, len(s), least.get(find(k)) if s else doc) for k, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(seed):
    """Families at all similarities, among them ones whose members are alike only to their source."""
    r = random.Random(seed)
    text = lambda n: " ".join(f"w{r.randrange(4000)}" for _ in range(n))
    texts = []
    for n, k in [(11, 0), (12, 1), (40, 1), (70, 1), (130, 2), (300, 3), (300, 6), (900, 14), (900, 20)] * 6:
        t = text(n)
        texts += [t, edited(r, t, k), t + " one more word" * (n // 60)]
    hub = text(400)
    texts += [hub] * 4 + [edited(r, hub, r.randint(2, 6)) for _ in range(90)]
    tree = [text(200)]
    for _ in range(90):
        tree.append(edited(r, r.choice(tree), r.randint(1, 3)))
    texts += tree
    part = text(150)
    texts += [part + " " + text(12 + k) for k in range(40)]
    for n in range(9, 24):
        w = text(n).split()
        texts += [" ".join(w), " ".join(w[1:]), " ".join([*w, "end"])]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("part", [256, 8])
def test_op11_families(spark, monkeypatch, part):
    """Whole shards, and shards cut into blocks."""
    monkeypatch.setattr(signature_tree, "PART_DOCS", part)
    monkeypatch.setattr(signature_tree, "REPS", 2)
    monkeypatch.setattr(signature_tree, "PART_HASHES", part * 1000)
    rows = near_copies(part)
    got = signature_tree.jaccard_groups(spark.createDataFrame(rows, SIMPLE).repartition(5))
    assert collected(got) == jaccard_rows(rows)


def test_op11_odd_rows(docs, nothing):
    assert collected(signature_tree.jaccard_groups(docs)) == jaccard_rows([r[:2] for r in ROWS])
    assert not signature_tree.jaccard_groups(nothing).collect()


def test_op11_keys_lose_no_link():
    """Sets at the limit share a key, also very small and very large ones."""
    r = np.random.default_rng(5)
    keys = signature_tree.Keys(90)
    for n in [*range(9, 60), 200, 1000, 5000]:
        for _ in range(20 if n < 1000 else 3):
            union = np.sort(r.choice(1 << 62, n, replace=False).astype(np.uint64))
            lost = n // 10
            cut = r.integers(0, lost + 1)
            gone = r.choice(n, lost, replace=False)
            x, y = np.delete(union, gone[:cut]), np.delete(union, gone[cut:])
            assert signature_tree.linked(x, y, 90)
            assert np.intersect1d(keys.of(x), keys.of(y)).size or min(len(x), len(y)) < 9 or np.array_equal(x, y)


def test_op11_trees_prune_and_lose_nothing():
    r = np.random.default_rng(6)
    sets = []
    for _ in range(60):
        s = r.choice(1 << 62, int(r.integers(30, 400)), replace=False).astype(np.uint64)
        sets += [np.sort(s), np.sort(np.concatenate((s[3:], r.choice(1 << 62, 2).astype(np.uint64))))]
    tree = signature_tree.SignatureTree(sets, signature_tree.SignatureTree.width(sets), signature_tree.SignatureTree.shape(len(sets)))
    pairs = {(int(i), int(j)) for a, b in signature_tree.leaf_pairs(tree, tree, 90) for i, j in zip(a, b, strict=True)}
    wanted = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if signature_tree.linked(sets[i], sets[j], 90)}
    assert wanted <= pairs and len(wanted) > 30 and len(pairs) < 2 * len(wanted)


def test_components_of_a_hot_star(spark, monkeypatch):
    """One node with 100,000 neighbours, and chains beside it."""
    star = spark.range(1, 100_001).selectExpr("0L a", "id b")
    chain = spark.range(200_000, 200_060).selectExpr("id a", "id + 1 b")
    for parts in (components.PARTS, 4):
        monkeypatch.setattr(components, "PARTS", parts)
        got = components.components(star.unionByName(chain))
        assert sorted(tuple(r) for r in got.groupBy("label").count().collect()) == [(0, 100_000), (200_000, 60)]


def op12(rows):
    """Plain version: every kept term of every pair, in whole numbers."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))) for lang, source, t in rows]
    df, total, own = Counter(), Counter(), Counter()
    for lang, source, w in docs:
        df.update((lang, t) for t in set(w))
    kept = {x for x, n in df.items() if n >= 3}
    for lang, source, w in docs:
        for t in w:
            if (lang, t) in kept:
                total[lang, t] += 1
                own[lang, source, t] += 1
    out = Counter()
    groups = {(lang, source) for lang, source, _ in docs}
    for lang in {g[0] for g in groups}:
        terms = sorted(t for k, t in kept if k == lang)
        p = lambda count, n: 1 + math.floor(Fraction(10**9 * (count + 1), n + len(terms)))  # noqa: B023, E731
        sums = {s: sum(own[lang, s, t] for t in terms) for k, s in groups if k == lang}
        of = {s: [p(own[lang, s, t], sums[s]) for t in terms] for s in sums}
        whole = [p(total[lang, t], sum(total[lang, x] for x in terms)) for t in terms]
        f = lambda a, b: (a - b) ** 2 // b
        for s in sums:
            pairs = [(-sum(map(f, of[s], of[o])), o.encode(), o) for o in sums if o != s]
            best = [(-f(a, b), t.encode(), t) for t, a, b in zip(terms, of[s], whole, strict=True) if own[lang, s, t] and a > b]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:200])):
                out.update((lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1))
    return out


def test_op12(docs, nothing):
    rows = [(r[2], r[3], r[1]) for r in ROWS]
    wanted = op12(rows)
    assert collected(divergence.divergence(docs)) == wanted
    # A sketch that lets everything through changes nothing.
    assert collected(divergence.divergence(docs, width_bits=3, held=50)) == wanted
    assert not divergence.divergence(nothing).collect()


def test_op12_sketch_discards_and_never_underestimates(docs):
    rows = docs.selectExpr("'' lang", "'' source", "coalesce(text, '') text")
    reached = np.unpackbits(divergence.sketch(rows, 3)).astype(bool)
    df = Counter()
    for r in ROWS:
        df.update(set(re.findall(rb"[a-z\x80-\xff]+", (r[1] or "").encode().lower())))
    terms = list(df)
    let = reached[divergence.slots(b"", terms)].all(axis=1)
    assert all(ok for t, ok in zip(terms, let, strict=True) if df[t] >= 3)
    rare = [bool(ok) for t, ok in zip(terms, let, strict=True) if df[t] < 3]
    assert len(rare) > 50 and sum(rare) < 3


def test_op12_groups_without_terms(spark):
    rows = [("x", "a", "1 2"), ("x", "b", None), (None, None, ""), ("y", "a", "one two"), ("y", "b", "one"), ("y", "a", "ONE one"), ("y", "c", "-")]
    got = divergence.divergence(spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, rank int"))
    assert collected(got) == op12(rows)


def test_op12_large_counts(spark):
    """Quotients beyond 64-bit products."""
    c, n, v = 8_000_000_000_000, 8_999_999_999_000_000, 1000
    got = spark.range(1).select(divergence.p_of(*(spark.range(1).selectExpr(f"{x}L x").first()[0] + divergence.F.lit(0).cast("long") for x in (c, n, v)))).first()[0]
    assert got == 1 + 10**9 * (c + 1) // (n + v)


def op13(rows, items, k=20):
    docs = [(d, Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW)))) for d, t in rows]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n, length = len(docs), sum(s for _, _, s in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = Counter()
    for item, text in items:
        terms = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        found = []
        for d, c, size in docs:
            m = 75 + 25 * size * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, d is None, d))
        out.update((item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(found)[:k], 1))
    return out


ITEMS = [(1, "there on in the"), (1, "There ON in the"), (2, None), (3, ""), (None, "mail jo doe com license"), (4, ROWS[3][1]), (5, "x" * 3000 + " word word"), (6, "no such wordatall")]


def test_op13(spark, docs, nothing, monkeypatch):
    items = spark.createDataFrame([(*i, "q") for i in ITEMS], "item_id long, text string, score string")
    wanted = op13([r[:2] for r in ROWS], ITEMS)
    assert collected(lexical_search.search(docs, items)) == wanted
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 3)
    assert collected(lexical_search.search(docs.repartition(1), items, fan=2)) == wanted
    assert not lexical_search.search(nothing, items).collect() and not lexical_search.search(docs, items.limit(0)).collect()


def test_op13_opens_few_nodes_and_all_ties(spark):
    """Of many equal documents the smallest ids win; bounds leave most blocks closed."""
    rows = [(5000 - k, "same words here") for k in range(3000)] + [(9000 + k, f"filler number{k} text") for k in range(1000)]
    items = [(1, "words"), (2, "number7 filler")]
    got = lexical_search.search(spark.createDataFrame(rows, SIMPLE).repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert collected(got) == op13(rows, items)
    r = np.random.default_rng(3)
    n = lexical_search.FAN**lexical_search.LEVELS
    first = np.arange(0, 5 * n + 1, 5)
    trees = lexical_search.MaxTrees(first, r.integers(0, 400, 5 * n), (1000 / r.random(5 * n)).astype(np.int64), 400)
    best, times = lexical_search.Best(20), np.zeros(400, dtype=np.int64)
    best.ids, own = list(range(n)), np.array([5, 17, 300])
    times[own] = 1
    trees.search(own, np.ones(3, dtype=np.int64), times, best)
    best.trim()
    exact = sorted(((-int(s), (False, k)) for b in range(n // 16) for k, s in enumerate(trees.scores(b, times).tolist(), 16 * b) if s > 0))[:20]
    assert best.found == exact and trees.opened < 100


def test_long_texts_in_pieces(monkeypatch):
    from seedloom.llm import common

    text = b"one two  three" * 50
    monkeypatch.setattr(common, "PIECE", 7)
    assert [w for part in common.word_lists(lexical_search.TERM, text) for w in part] == lexical_search.TERM.findall(text)


@pytest.mark.parametrize("name", ["op11_jaccard_join", "op12_source_divergence", "op13_lexical_search"])
def test_queries_on_tables(spark, tables, empty_tables, name):
    assert catalog.QUERIES[name](spark, tables).count() > 0
    assert catalog.QUERIES[name](spark, empty_tables).count() == 0


def test_terms_of_a_text_are_those_of_its_pattern(monkeypatch):
    """Every byte, runs across the ends of pieces, texts without terms or without anything else."""
    every = bytes(range(256))
    texts = [b"", b" ", b"a", b"\x00A\x7f", every, every[::-1] * 3, "Ünïcode ÄB1c\t\u00a0x\u3000y".encode(), b"ab" * 40, b"  a  bc\n\nD'e" * 30]
    for piece in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(divergence, "PIECE", piece)
        for text in texts:
            assert [w for part in divergence.term_lists(text) for w in part] == re.findall(rb"[a-z\x80-\xff]+", text.lower())
