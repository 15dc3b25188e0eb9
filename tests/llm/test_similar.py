"""Near copies that fingerprints miss, against the similarities of all pairs."""

import random
from collections import Counter

import corpus_pipeline


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def groups(texts):
    """The number of components by similarity 0.8, among texts that no fingerprint joins otherwise."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(texts))]


def edited(r, text, k):
    w = text.split()
    for at in r.sample(range(len(w)), k):
        w[at] = f"new{r.randrange(10**9)}"
    return " ".join(w)


def test_near_dedup_reaches_similarity(spark):
    r = random.Random(4)
    text = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    texts = []
    for n, k in [(200, 1), (200, 2), (200, 4), (500, 3), (500, 10), (60, 1), (200, 9), (200, 20)] * 8:
        t = text(n)
        texts += [t, edited(r, t, k)]
    hub = text(300)
    texts += [hub] * 3 + [edited(r, hub, 2) for _ in range(60)]  # one group: of them some pairs are far apart
    chain = text(200)
    for _ in range(6):
        texts.append(chain)
        chain = edited(r, chain, 3)
    # Passages that texts share without being alike: keys with many texts that aren't joined.
    part = text(120)
    texts += [part + " " + text(60) for _ in range(40)]
    # Edits of edits: most pairs of the group are too far apart.
    tree = [text(150)]
    for _ in range(120):
        tree.append(edited(r, r.choice(tree), r.randint(1, 5)))
    texts += tree
    texts += [None, "", " \n", "one two", "ONE  two", "one three"]
    order = list(range(len(texts)))
    docs = spark.createDataFrame([(k, texts[k], "x") for k in order], "doc_id long, text string, n string").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter(x["doc_id"] for x in kept.collect()) == Counter(set(groups(texts)))


def test_near_dedup_of_a_large_family(spark):
    """3,000 texts around one: groups as by comparing all pairs, although most pairs aren't alike."""
    r = random.Random(9)
    source = [f"w{r.randrange(3000)}" for _ in range(200)]
    texts = []
    for _ in range(1500):
        t = source[:]
        for at in r.sample(range(200), 3):
            t[at] = f"new{r.randrange(10**9)}"
        texts += [" ".join(t), edited(r, " ".join(t), 2)]
    sets = [{hash(x) for x in shingles(t)} for t in texts]
    where = {}
    for k, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, s in enumerate(sets):
        shared = Counter(j for x in s for j in where[x] if j < k)
        for j, n in shared.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    kept = {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {find(k) for k in range(len(texts))}
