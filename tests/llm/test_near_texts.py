import random

import numpy as np
import pytest
from odd import no_documents, odd_documents

from promptloom.llm import near_texts as N
from promptloom.llm.simhash import fingerprint


def brute_sets(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_kept(rows, least=0.8):
    """The smallest key of each component of all pairs at or above the likeness."""
    sets = [brute_sets(t) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if part[i] != part[j] and brute_likeness(sets[i], sets[j]) >= least:
                part = [part[j] if p == part[i] else p for p in part]
    by = {}
    for p, (k, t) in zip(part, rows):
        by.setdefault(p, []).append((k is None, k, t))
    return sorted((min(v, key=lambda x: (x[0], x[1] or 0))[1] for v in by.values()), key=lambda k: (k is None, k))


def planted(seed, families, copies, length, share):
    """Families of texts, each copy with words changed so that the likeness to its parent is about ``share``."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(families):
        base = [rng.choice(words) for _ in range(length)]
        rows.append(" ".join(base))
        for _ in range(copies):
            t = list(base)
            # a changed word breaks five shingles on either side
            for at in rng.sample(range(5, length - 5), max(1, round(length * (1 - share) / (1 + share) / 5))):
                t[at] = rng.choice(words)
            rows.append(" ".join(t))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_likeness_and_shingles():
    rng = random.Random(3)
    texts = [None, "", "One two", "one TWO", "a b c d e", "a b c d e a b c d e a"] + [" ".join(rng.choice("abcÄ") for _ in range(rng.randrange(30))) for _ in range(60)]
    for a in texts:
        for b in texts:
            assert N.likeness(N.shingles(a), N.shingles(b)) == pytest.approx(brute_likeness(brute_sets(a), brute_sets(b)))
        assert N.majority_bits(N.shingles(a)) == fingerprint(a, 5)


def test_texts_above_the_likeness_share_a_shard():
    for share in (0.8, 0.85, 0.9, 0.95):
        rows = [t for _, t in planted(7, 60, 1, 300, share)]
        keys = [set(N.shard_keys(np.unique(N.shingles(t))).tolist()) for t in rows]
        sets = [brute_sets(t) for t in rows]
        for i in range(len(rows)):
            for j in range(i):
                if brute_likeness(sets[i], sets[j]) >= 0.8:
                    assert keys[i] & keys[j]


def test_part_counts_bound_the_likeness():
    rng = random.Random(11)
    for _ in range(200):
        base = [rng.choice("abcdefgh") for _ in range(rng.randrange(5, 300))]
        a, b = (np.unique(N.shingles(" ".join(c if rng.random() > 0.02 else "x" for c in base))) for _ in range(2))
        most = int(np.minimum(*(np.frombuffer(N.part_counts(x), np.uint16) for x in (a, b))).sum())
        assert most / (len(a) + len(b) - most) >= N.likeness(a, b) - 1e-12
        m = {"node": [0, 1], "fp": [0, 0], "n": [len(a), len(b)], "root": [0, 1], "shared": [len(a), len(b)], "keys": [[3], [3]], "shard": [3, 3], "counts": [N.part_counts(a), N.part_counts(b)]}
        assert N.crossing_links(m, 24, 0.8) or N.likeness(a, b) < 0.8


def test_trees_against_all_pairs():
    rng = random.Random(5)
    n = 300
    fps = [rng.getrandbits(12) for _ in range(n)]
    m = {"node": list(range(n)), "fp": fps, "n": [rng.randrange(1, 12) for _ in range(n)], "root": [rng.randrange(4) for _ in range(n)], "late": [1] * n}
    m["shared"] = [rng.randrange(k + 1) for k in m["n"]]
    m["keys"] = [[1, *rng.sample(range(50), 3)] if rng.random() < 0.7 else [0, 1] for _ in range(n)]
    m["shard"], m["counts"] = [1] * n, [None] * n
    distance = lambda i, j: (fps[i] ^ fps[j]).bit_count()
    fits = lambda i, j: min(m["n"][i], m["n"][j]) >= 0.8 * max(m["n"][i], m["n"][j])

    def possible(i, j):  # were all shared shingles common to both
        both = min(m["shared"][i], m["shared"][j])
        return both / (m["n"][i] + m["n"][j] - both) >= 0.8 if m["n"][i] + m["n"][j] > both else True

    got = [tuple(sorted(p)) for p in N.crossing_links(m, 3, 0.8)]
    assert len(got) == len(set(got))
    first = lambda i, j: min(set(m["keys"][i]) & set(m["keys"][j])) == 1
    assert set(got) == {(i, j) for j in range(n) for i in range(j) if m["root"][i] != m["root"][j] and distance(i, j) <= 3 and possible(i, j) and first(i, j)}
    links = N.first_links(m, 3, 0.8)
    lead = N.pivot(fps)
    assert all(distance(a, b) <= 3 and fits(a, b) for a, b in links)
    order = [lead, *(i for i in range(n) if i != lead)]
    for at, i in enumerate(order):
        before = [distance(i, j) for j in order[:at] if fits(i, j) and distance(i, j) <= 3]
        mine = [distance(a, b) for a, b in links if b == i]
        assert bool(before) == bool(mine) and (not before or min(mine) == min(before))


@pytest.mark.parametrize("limit", [2048, 3])
def test_planted_copies_against_all_pairs(spark, limit):
    for share in (0.8, 0.88, 0.95):
        rows = planted(round(share * 100), 12, 5, 120, share) + [(500 + i, t) for i, t in enumerate(["short one", "Short ONE", "", " ", "short two"])]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted(r["doc_id"] for r in N.keep_one(docs, shard_limit=limit).collect())
        assert got == brute_kept(rows)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((r["doc_id"] for r in kept.collect()), key=lambda k: (k is None, k))
    assert got == brute_kept(rows)
    assert N.keep_one(no_documents(spark)).count() == 0
