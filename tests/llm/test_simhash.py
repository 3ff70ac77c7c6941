import random
import re
import tracemalloc

import numpy as np
import pytest
import xxhash
from odd import TEXTS, counted, no_documents, odd_documents
from pyspark.sql import functions as F

from promptloom.llm import simhash as H
from promptloom.llm.components import stars


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=3):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    values = sorted(fps)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in values}


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def clustered(seed, clusters, size):
    """Fingerprints in chains, balls and alone; some a bit too far off."""
    rng = random.Random(seed)
    out = set()
    for _ in range(clusters):
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(1, size)):
            out.add(f)
            g = f
            for _ in range(rng.choice([1, 2, 3, 3, 4, 5])):
                g ^= 1 << rng.randrange(64)
            f = g if rng.random() < 0.7 else f
    return out | {0, (1 << 64) - 1, 7, 15}


def test_fingerprints():
    rng = random.Random(4)
    texts = [t for _, t in TEXTS] + [" ".join(rng.choice(["A", "b", "Éa", "x\x85y", "cd"]) for _ in range(rng.randrange(12))) for _ in range(100)]
    for t in texts:
        if t is None or len(t) < 10000:
            assert H.fingerprint(t) == brute_fingerprint(t)


@pytest.mark.parametrize("block", [1, 5, 64])
def test_blocks_of_a_text_give_the_whole_fingerprint(monkeypatch, block):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["A", "b", "Éa", "x\x85y", "long" * 9, "", "\n\t"]) for _ in range(rng.randrange(40))) for _ in range(200)] + [" ", "  a", "a  "]
    want = [(H.fingerprint(t), np.concatenate([np.empty(0, np.uint64), *H.shingle_hashes(t, 5)]).tolist()) for t in texts]
    assert all(f == brute_fingerprint(t) for t, (f, _) in zip(texts, want))
    monkeypatch.setattr(H, "BLOCK", block)
    assert [(H.fingerprint(t), np.concatenate([np.empty(0, np.uint64), *H.shingle_hashes(t, 5)]).tolist()) for t in texts] == want


def test_bits_are_counted_in_bounded_memory():
    hashes = np.random.default_rng(6).integers(0, 1 << 63, 1 << 19).astype(np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))
    tracemalloc.start()
    got = H.majority_bits(hashes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want and peak < 12 << 20  # all bits at once would take 32 MB


def test_tree_finds_all_within_the_radius():
    values = list(clustered(1, 40, 12))
    tree = H.BKTree()
    for i, v in enumerate(values):
        assert sorted(tree.near_then_add(v)) == [j for j in range(i) if (values[j] ^ v).bit_count() <= 3]


def test_links_join_every_component_at_any_shard_limit(spark):
    fps = clustered(2, 120, 25)
    want = brute_components(fps)
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(5)
    for limit in (1, 4, 1024):
        rows = stars(H.links(nodes, shard_limit=limit)).collect()
        got = {r["node"]: r["root"] for r in rows}
        # the same parts, whatever their names
        parts, wanted = {}, {}
        for f in fps:
            parts.setdefault(got.get(signed(f), signed(f)), set()).add(f)
            wanted.setdefault(want[f], set()).add(f)
        assert sorted(map(sorted, parts.values())) == sorted(map(sorted, wanted.values()))


def test_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (41, 3), (41, 3)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r["node"]: r["root"] for r in stars(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 42)}, 101: 100, 102: 100, **{200 + i: 200 for i in range(1, 30)}}
    assert stars(spark.createDataFrame([], "u long, v long")).count() == 0


def near_documents(spark):
    rng = random.Random(9)
    words = ["w" + str(i) for i in range(400)]
    base = [rng.choice(words) for _ in range(900)]
    texts = []
    for i in range(30):
        t = list(base)
        if i % 3:
            t[rng.randrange(len(t))] = f"other{i}"
        texts.append((1000 - i, " ".join(t)))
    texts += [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(20)]
    return spark.createDataFrame(texts, "doc_id long, text string")


def test_near_duplicates_against_brute_force(spark):
    for docs in (near_documents(spark), odd_documents(spark)):
        rows = docs.select("doc_id", "text").collect()
        fps = {r["text"]: (brute_fingerprint(r["text"]) if len(r["text"] or "") < 10000 else H.fingerprint(r["text"])) for r in rows}
        part = brute_components(set(fps.values()))
        least = {}
        for r in rows:
            if r["doc_id"] is not None:
                p = part[fps[r["text"]]]
                least[p] = min(least.get(p, r["doc_id"]), r["doc_id"])
        want = counted((r["doc_id"], f"{fps[r['text']]:016x}", least.get(part[fps[r["text"]]])) for r in rows)
        assert counted(H.near_duplicates(docs).collect()) == want
        kept = H.keep_one(docs)
        assert kept.columns == docs.columns
        got = kept.collect()
        assert len(got) == len(set(part.values())) == len({part[fps[r["text"]]] for r in got})
        assert all(r["doc_id"] == least.get(part[fps[r["text"]]]) for r in got)
    assert len(H.near_duplicates(near_documents(spark)).where("doc_id > 900").select("component_id").distinct().collect()) < 15


def test_empty_table(spark):
    assert H.near_duplicates(no_documents(spark)).count() == 0
    assert H.keep_one(no_documents(spark)).count() == 0


def test_copies_of_a_hot_text_cost_one_node(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text for a third of all").otherwise(F.concat(F.lit("text number "), F.col("id").cast("string"))).alias("text"))
    assert H.near_duplicates(docs).where("component_id = 0").count() >= 1000
