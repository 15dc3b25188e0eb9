"""The pipeline against a plain version of all its stages."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import components, crc, op1, op5, op7, op10

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from seedloom.llm import packing, quality_rules as Q

BENCHMARK = [(1, "nine lives of a cat are told in this very short and odd item"), (2, "brief item")]
SECRET = "Zk8xQ2vT9LmR4sW7yB1nC6pH0jD3fG5a"


def corpus():
    r = random.Random(8)
    words = ["".join(r.choice(["th", "er", "an", "on", "in", "re", "st"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = [text(r.randint(12, 250)) for _ in range(260)]
    texts += [texts[1]] * 4 + [texts[2].upper(), "  " + texts[3], texts[4] + " more", texts[5].replace(" ", "# "), " ".join(x + "!!" for x in texts[6].split())]
    texts += [text(30) + " " + BENCHMARK[0][1] + " " + text(30), "A BRIEF ITEM, " + text(40), text(40) + " password=b7db7aa4a5fcc78305 " + text(20), text(9), "ab " * 50, None, "", text(60) + " " + SECRET + " end", text(30) + "\n" + text(30)]
    rows = [(k, t, "en" if k % 5 else None, "big" if k % 7 else "small", None if t is None else len(t)) for k, t in enumerate(texts)]
    return [*rows, rows[9], (None, text(50), "en", "big", 1)]


def bucket(v):
    s = max(v.bit_length() - Q.SKETCH_BITS, 0)
    return v - v % (1 << s)


def quality(rows):
    """The rows that pass, by sorting all values of each group."""
    counts = []
    for r in rows:
        words, chars, symbols, dups, repeats = op10(r[1])
        t = r[1] or ""
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        per = lambda n, of: n * 1000 // max(of, 1)
        rates = {"symbol_rate": per(symbols, chars), "mark_rate": per(t.count("!"), words), "upper_rate": per(len(re.findall("[A-Z]", t)), chars), "dup_line_rate": per(dups, len(lines)), "repeat_rate": per(repeats, words)}
        counts.append((words < 10 or 100 * repeats > 20 * words, rates))
    groups = {}
    for r, (_, rates) in zip(rows, counts, strict=True):
        for g in ((r[2], r[3]), ("lang", r[2]), "all"):
            for k, v in rates.items():
                groups.setdefault(g, {}).setdefault(k, []).append(bucket(v))
    kept = []
    for r, (failed, rates) in zip(rows, counts, strict=True):
        def limit(k, r=r):
            fence = None
            for g in ("all", ("lang", r[2]), (r[2], r[3])):
                v = sorted(groups[g][k])
                mid, high = (v[-(-len(v) * q // 100) - 1] for q in (Q.Q_MID, Q.Q_HIGH))
                own = high + max((high - mid) * Q.SPREAD, Q.RATES[k])
                fence = own if fence is None else (own * len(v) + fence * Q.WEIGHT) // (len(v) + Q.WEIGHT)
            return fence
        if not failed and all(v <= limit(k) for k, v in rates.items()):
            kept.append(r)
    return kept


def one_of_each(rows):
    fps = [op5(r[1], 5) for r in rows]
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    best = {}
    for r, fp, c in zip(rows, fps, components(fps, 3), strict=True):
        order = (r[0] is None, r[0] or 0, signed(fp))
        if c not in best or order < best[c][0]:
            best[c] = (order, r)
    return [r for _, r in best.values()]


def redacted(text):
    spans = [(s, e) for s, _, e in op7(text)] + [m.span() for m in re.finditer(SECRET, text or "")]
    out, at = "", 0
    for s, e in sorted(spans):
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def test_pipeline(spark, tmp_path):
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    wanted = [corpus()]
    wanted.append(quality(wanted[0]))
    wanted.append(one_of_each(wanted[1]))
    wanted.append([r for r in wanted[2] if not op1(r[1], BENCHMARK)[-1]])
    wanted.append([(r[0], redacted(r[1]), r[2], r[3], len(redacted(r[1]))) for r in wanted[3]])
    assert len(wanted[0]) > len(wanted[1]) > len(wanted[2]) > len(wanted[3]) and wanted[3] != wanted[4]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        assert Counter(map(repr, map(tuple, docs.collect()))) == Counter(map(repr, wanted[k + 1])), name
    encode = packing.encoder(packing.ranks_path())
    whole = Counter()
    for r in wanted[4]:
        ids = np.frombuffer(encode(r[1]) + b"\0\0\0\0", dtype="<u4")
        whole.update((r[0], s, len(ids[s : s + 1024]), crc(ids[s : s + 1024].tobytes()), len(ids)) for s in range(0, len(ids), 1024))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == whole
    used = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 1024


def test_pipeline_on_empty_tables(spark, empty_tables):
    assert corpus_pipeline.run(spark, empty_tables).count() == 0
    docs = spark.read.parquet(f"{empty_tables}/documents.parquet")
    assert [name for name, stage in corpus_pipeline.STAGES[:-1] if stage(spark, docs, empty_tables).columns != docs.columns] == []
