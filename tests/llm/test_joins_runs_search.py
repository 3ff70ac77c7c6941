"""The n-gram join, periodic runs and lexical search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from odd import TEXTS, counted, no_documents, odd_documents
from pyspark.sql import functions as F

from promptloom.llm import lexical_search as S
from promptloom.llm import ngram_join as J
from promptloom.llm import periodic_runs as P

UPPER, LOWER = S.UPPER, S.LOWER
low = lambda t: (t or "").translate(str.maketrans(UPPER, LOWER))
words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")


# -- n-gram join


def gram_set(text):
    w = words(low(text))
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def brute_join(rows):
    sets = [gram_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return counted((k, len(s), least.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def families(seed, n=25):
    """Groups of copies with few or many edits, chains, shared passages and small texts."""
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 3000}"
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(n):
        base = [word() for _ in range(rng.choice([3, 4, 5, 9, 40, 150, 400, 900]))]
        if rng.random() < 0.5:
            base = base[:20] + passage + base[20:]
        now = base
        for _ in range(rng.randrange(1, 9)):
            out.append(" ".join(now))
            now = list(now if rng.random() < 0.6 else base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
                at = rng.randrange(len(now))
                now[at : at + rng.randrange(2)] = [word()]
            now = now or ["one"]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("counters", [J.COUNTERS, 64])
def test_join_against_all_pairs(spark, counters, monkeypatch):
    monkeypatch.setattr(J, "_SMALL", 4 if counters == 64 else 32)
    rows = families(counters)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = counted(J.jaccard_components(docs, counters=counters).collect())
    assert got == brute_join(rows) and len({c for _, _, c in got}) < 0.8 * len(rows)


def test_join_of_a_large_group_that_never_links(spark):
    """Copies that differ from each other by a little too much: every pair meets, none links."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for k in range(300):
        t = list(base)
        for at in range(5, 150, 24):
            t[at] = f"v{rng.randrange(40)}"
        rows.append((k, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert counted(J.jaccard_components(docs).collect()) == brute_join(rows)


def test_join_of_odd_rows(spark):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents(spark).select("doc_id", "text").collect()]
    got = J.jaccard_components(odd_documents(spark))
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and counted(got.collect()) == brute_join(rows)
    assert J.jaccard_components(no_documents(spark)).count() == 0
    kept = J.keep_one(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns and kept.where("doc_id = 6").count() == 0


def test_join_against_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{path}'")
    assert counted(J.jaccard_components(spark.read.parquet(path)).collect()) == counted(db.sql(J.SQL).fetchall())


def test_columns_of_long_groups_are_kept_together():
    """Chunks of a sorted stream: a column that fills whole batches goes on in the next."""
    import pyarrow as pa

    col = np.repeat([1, 2, 3, 4], [3, 40000, 1, 5])
    batches = [pa.RecordBatch.from_arrays([pa.array(col[i : i + 512])], names=["col"]) for i in range(0, len(col), 512)]
    chunks = list(J._columns(iter(batches), ["col"]))
    assert np.concatenate([c["col"] for c in chunks]).tolist() == col.tolist()
    for a, b in zip(chunks, chunks[1:]):
        assert b["more"] == (a["col"][-1] == b["col"][0])


# -- periodic runs


def brute_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                found.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_digest(key, text):
    w = words(text)
    n, h = len(w), zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (key, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in drop)), len(w))


def test_runs_of_many_small_sequences():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 8)):
            k, n = rng.choice([1, 2, 3, 5, 50]), rng.choice([0, 1, 5, 11, 12, 13, 30, 100, 300])
            w = [rng.randrange(k) for _ in range(n)]
            if rng.random() < 0.5 and n > 20:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 2 + 1))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        numbers = np.concatenate([np.array(w, np.int64) + 60 * i for i, w in enumerate(texts)])
        found = list(zip(*(x.tolist() for x in P.runs(numbers, np.array(list(map(len, texts)))))))
        for d, w in enumerate(texts):
            assert [r[1:] for r in found if r[0] == d] == brute_runs(w)


def test_extensions_and_minima():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1000, 777)
    minima = P.RangeMinimum(values)
    a, b = rng.integers(0, 777, 500), rng.integers(0, 777, 500)
    a, b = np.minimum(a, b), np.maximum(a, b)
    assert minima.of(a, b).tolist() == [values[i : j + 1].min() for i, j in zip(a, b)]
    w = rng.integers(0, 2, 300)
    i, j = rng.integers(0, 150, 200), rng.integers(150, 300, 200)
    want = [next((k for k in range(300 - y) if w[x + k] != w[y + k]), 300 - y) for x, y in zip(i, j)]
    assert P.Extensions(w).of(i, j).tolist() == want


def test_run_digests_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("a b c dd".split()[: rng.randrange(1, 5)]) for _ in range(rng.randrange(80)))) for i in range(150)]
    rows += [(k, t) for k, t in TEXTS if t is None or len(t) < 10000]
    got = P.run_digests(spark.createDataFrame(rows, "doc_id long, text string"))
    assert counted(got.collect()) == counted(brute_digest(k, t) for k, t in rows)


def test_runs_of_odd_rows_and_general_use(spark):
    assert P.run_digests(odd_documents(spark)).count() == len(TEXTS) and P.run_digests(no_documents(spark)).count() == 0
    found = P.find_runs(odd_documents(spark))
    assert found.columns == [*odd_documents(spark).columns, "n_words", "runs_", "collapsed"]
    row = found.where("doc_id = 4").first()
    assert [(r["start"], r["length"], r["period"]) for r in row["runs_"]] == [(0, 60000, 4)] and row["collapsed"] == "the quick brown fox and one more word."
    clash = odd_documents(spark).withColumnRenamed("rank", "collapsed")
    assert P.find_runs(clash).columns[-1] == "collapsed_"


# -- lexical search


def brute_search(docs, items, k=10):
    terms = [(key, Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t)))) for key, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item in {i for i, _ in items}:
        asked = Counter()
        for i, t in set(items):
            if i == item:
                asked.update(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t)))
        scored = []
        for key, c in terms:
            if n := sum(c.values()):
                m = 25 + 75 * n * n_docs // n_terms
                score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in asked.items() if c[t])
                scored.append((-score, key is None, key))
        out += [(item, rank, key, -s) for rank, (s, _, key) in enumerate(sorted((x for x in scored if x[0] < 0), key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return counted(out)


def searched(spark, docs, items, **more):
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    return counted(S.search(S.index(d), i, **more).collect())


def test_search_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: f"t{int(rng.paretovariate(0.5)) % 300}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(7, docs[7][1]), (None, docs[7][1]), (None, None), (5, "")]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 12)))) for i in range(30)] + [(30, docs[7][1].upper()), (31, "nothing-known"), (32, None), (0, "t1 t1"), (0, "t1 t1"), (None, "t2 É")]
    want = brute_search(docs, items)
    assert searched(spark, docs, items) == want
    assert searched(spark, docs, items, block=20) == want  # several scans
    monkeypatch.setattr(S, "WINDOW", 64)
    monkeypatch.setattr(S, "SEGMENT_POSTINGS", 500)  # the workers read the module anew; the driver's functions are checked below
    segment = S._Segment()
    for k, t in docs:
        segment.add(k, t)
    row = segment.row()
    assert row["keys"] == sorted((k for k, _ in docs if k is not None)) + [None, None]
    best = S._Best(1, 3)
    numbers = {"t1": 0}
    S._score(row, [(np.array([0]), np.array([2]))], numbers, np.array([700]), 400, sum(row["lengths"]), best)
    assert len(best.heaps[0]) == 3


def test_search_odd_rows(spark):
    items = [(1, "plain WORDS text"), (2, "straße 日本語"), (3, None)]
    docs = [(r["doc_id"], r["text"]) for r in odd_documents(spark).select("doc_id", "text").collect()]
    got = S.ranked(odd_documents(spark), spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and counted(got.collect()) == brute_search(docs, items)
    assert S.ranked(no_documents(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert S.ranked(odd_documents(spark), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_search_against_sql(spark):
    db = duckdb.connect()
    tables = {t: f"/root/testdata/sf0.001/{t}.parquet" for t in ("documents", "benchmark")}
    for t, path in tables.items():
        db.sql(f"create view {t} as select * from '{path}'")
    got = S.ranked(*(spark.read.parquet(p) for p in tables.values()))
    assert counted(got.collect()) == counted(db.sql(S.SQL).fetchall()) and got.where(F.col("score") <= 0).count() == 0
