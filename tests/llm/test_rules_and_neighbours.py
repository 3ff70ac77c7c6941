import random
import re

import numpy as np
import pytest
from odd import TEXTS, counted, labels, no_documents, odd_documents

from promptloom.llm import neighbour_quality as N
from promptloom.llm import quality_rules as Q


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w in windows if windows.count(w) > 1} if len(windows) < 400 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    hit = set()
    for i, w in enumerate(windows):
        if w in often:
            hit |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_counts_against_brute_force():
    rng = random.Random(3)
    texts = [t for _, t in TEXTS] + ["".join(rng.choice("ab #|\n\t é\x0b\x1c\x85") for _ in range(rng.randrange(300))) for _ in range(200)]
    for t in texts:
        assert Q.count_text(t)[:5] == brute_counts(t)


def test_rules_are_learned_and_readable():
    rng = np.random.default_rng(1)
    x = {n: rng.random(900) for n in Q.NAMES}
    bad = (x["symbols_a_word"] > 0.7) | ((x["richness"] <= 0.2) & (x["words"] > 0.3))
    rules = Q.learn(x, bad)
    found = np.zeros(900, bool)
    for r in rules:
        found |= Q._holds(r.tests, x, 900)
    assert (found == bad).mean() > 0.97
    assert all(str(r).startswith("reject if ") for r in rules)


def test_noise_and_single_class_give_no_rules():
    rng = np.random.default_rng(2)
    x = {n: rng.random(600) for n in Q.NAMES}
    assert len(Q.learn(x, rng.random(600) < 0.1)) <= 1
    assert Q.learn(x, np.zeros(600, bool)) == [] == Q.learn(x, np.ones(600, bool))


def test_odd_rows_rules(spark):
    docs = odd_documents(spark)
    rules = [Q.Rule((Q.Test("symbols_a_word", True, 0.5),)), Q.Rule((Q.Test("words", False, 11.0), Q.Test("upper_case", True, 0.5)))]
    rows = Q.apply_rules(docs, rules).collect()
    assert len(rows) == len(TEXTS)
    want = []
    for k, t in TEXTS:
        b = brute_counts(t)
        failed = b[0] < 10 or 100 * b[4] > 20 * b[0]
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        rule = 1 if b[2] / max(1, b[0]) > 0.5 else 2 if b[0] <= 11 and sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t or "") / max(1, sum(map(len, words))) > 0.5 else 0
        want.append((k, *b, failed, not failed and rule == 0, rule))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"]
    assert counted([r[c] for c in columns] for r in rows) == counted(want)
    kept = Q.keep_good(docs, rules)
    assert kept.columns == docs.columns
    assert counted((r["doc_id"], r["text"]) for r in kept.collect()) == counted((k, t) for (k, t), w in zip(TEXTS, want) if w[-2])
    assert Q.apply_rules(no_documents(spark), rules).count() == Q.keep_good(no_documents(spark), rules).count() == 0


def test_fit_takes_nulls_and_no_labels(spark):
    assert isinstance(Q.fit(odd_documents(spark), labels(spark)), list)
    assert Q.fit(odd_documents(spark), labels(spark).limit(0)) == [] == Q.fit(no_documents(spark), labels(spark))


def test_query_against_brute_force(spark):
    """The learned rules agree with the labels they did not see as well as with those they did."""
    folder = "/root/testdata/sf0.01"
    docs, marks = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rules = Q.fit(docs, marks)
    rows = {r["doc_id"]: r for r in Q.apply_rules(docs, rules).collect()}
    truth = {r["doc_id"]: r["quality"] for r in marks.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, t in texts.items():
        b = brute_counts(t)
        assert tuple(rows[k][c] for c in Q.COUNTS[:5]) == b
        assert rows[k]["base_failed"] == (b[0] < 10 or 100 * b[4] > 20 * b[0])
        assert rows[k]["kept"] == (not rows[k]["base_failed"] and rows[k]["rule"] == 0)
    assert sum((rows[k]["rule"] == 0) == bool(q) for k, q in truth.items()) / len(truth) > 0.98


def test_neighbours_vote_like_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs, marks = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = N.fit(docs, marks)
    rows = {r["doc_id"]: r for r in N.score(docs, model).collect()}
    import zlib

    for r in docs.limit(60).collect():
        v = N.term_vector(r["text"]).astype(np.float64) @ model.projection
        v /= np.linalg.norm(v)
        cos = v @ model.vectors
        near = np.argsort(-cos)[: N.NEIGHBOURS]
        weight = np.maximum(cos[near], 1e-6) ** N.SHARPNESS
        got = rows[r["doc_id"]]
        assert got["score"] == pytest.approx((weight * model.labels[near]).sum() / weight.sum(), abs=0.05)
        assert got["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert got["predicted"] == int(got["score"] >= 0.3)
    truth = {r["doc_id"]: r["quality"] for r in marks.collect()}
    held = [(rows[k]["predicted"] == q) for k, q in truth.items() if rows[k]["held_out"]]
    assert np.mean(held) > 0.95
    assert sum(not rows[k]["held_out"] for k in truth) == len(model.labels)


def test_odd_rows_neighbours(spark):
    docs = odd_documents(spark)
    model = N.fit(docs, labels(spark))
    rows = N.score(docs, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
    assert N.score(no_documents(spark), model).count() == 0
    untaught = N.fit(docs, labels(spark).limit(0))
    assert {r["score"] for r in N.score(docs, untaught).collect()} == {0.5}
