import hashlib
import random
import re
import statistics
import zlib

import pytest
import xxhash
from odd import TEXTS, counted, no_documents, odd_documents
from pyspark.sql import functions as F

from promptloom.llm import hash_ring as R
from promptloom.llm import order_minhash as O
from promptloom.llm import source_mixing as M


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- the ring


def test_ring_rows_law_and_slots(spark):
    docs = spark.range(1003).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    made = R.shard_documents(docs)
    no_python(made)
    rows = made.collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["size"] == len(f"t{r['doc_id']}") + 1 and r["text_crc32"] == zlib.crc32(f"t{r['doc_id']}".encode()) and r["law"] == "rows" and r["grown_shard"] is None
    assert sorted(by) == list(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_ring_odd_rows(spark):
    rows = R.shard_documents(odd_documents(spark)).collect()
    assert counted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == counted((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in TEXTS)
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(TEXTS)
    assert R.shard_documents(no_documents(spark)).count() == 0


def test_settling_is_the_clockwise_walk():
    ring = R.Ring.of(5, 8)
    counts = {s: (s * 7919) % 5 for s in range(0, 1 << R.RING_BITS, 37)}
    counts = {s: n for s, n in counts.items() if n}
    room = R.capacities(sum(counts.values()), 5)
    runs = R.settle(ring, counts, room)
    # key by key: those at home first, then the others one after another
    left, where, over = list(room), {}, []
    for s in sorted(counts):
        for k in range(counts[s]):
            home = ring.owners[ring.home(s)]
            if left[home]:
                left[home] -= 1
                where[s, k] = home
            else:
                over.append((s, k))
    for s, k in over:
        node = ring.home(s)
        while not left[ring.owners[node % len(ring.owners)]]:
            node += 1
        left[ring.owners[node % len(ring.owners)]] -= 1
        where[s, k] = ring.owners[node % len(ring.owners)]
    for s, n in counts.items():
        for k in range(n):
            assert [x for x in runs[s] if x[0] <= k][-1][1] == where[s, k]


def test_growing_moves_few(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"))
    for slack, most in ((0.0, 0.30), (0.25, 0.16)):
        a = {r["doc_id"]: r["shard"] for r in R.assign(docs, ["doc_id"], 8, slack=slack).collect()}
        b = {r["doc_id"]: r["shard"] for r in R.assign(docs, ["doc_id"], 9, slack=slack).collect()}
        assert sum(a[k] != b[k] for k in a) / len(a) < most
    with pytest.raises(ValueError):
        R.settle(R.Ring.of(2), {0: 10}, [3, 3])


# --- order min-hash


def neighbours(rows):
    """(key, text, the next text) by key, nulls first, ties by anything."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return [(k, t or "", order[(i + 1) % len(order)]) for i, (k, t) in enumerate(order)]


def test_fingerprint_properties(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    made = O.compare_edited(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    no_python(made)
    got = {r["doc_id"]: r for r in made.collect()}
    by_text = {}
    for k, t, (nk, nt) in neighbours([(r["doc_id"], r["text"]) for r in rows]):
        r, q = got[k], len(t) // 4
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + nt[:q]).encode()).hexdigest()
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        for other, likeness in ((got[nk]["fingerprint"], r["near_next"]), (r["edited_fingerprint"], r["near_edited"])):
            same = sum(other[i : i + 8] == r["fingerprint"][i : i + 8] for i in range(0, 8 * O.SLOTS, 8)) / O.SLOTS
            assert likeness == pytest.approx(same)
    assert len(set(by_text.values())) == len(by_text)
    assert statistics.mean(r["near_edited"] for r in got.values()) > 0.25 > 0.02 > statistics.mean(r["near_next"] for r in got.values())


def test_likeness_follows_edits_and_order(spark):
    words = [f"word{i * 7919 % 1000}" for i in range(400)]
    texts = [words, words[:390] + ["x"] * 10, words[200:] + words[:200], list(reversed(words)), ["other%d" % i for i in range(400)], words + words]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    f = {r["doc_id"]: r["fingerprint"] for r in O.fingerprints(df).collect()}
    like = [sum(f[0][i : i + 8] == f[k][i : i + 8] for i in range(0, 256, 8)) / 32 for k in range(6)]
    assert like[0] == 1 and like[1] > 0.7 and like[1] > like[2] > like[3] and like[3] < 0.2 and like[4] == 0 and like[5] < 1


def test_order_minhash_odd_rows(spark):
    rows = O.compare_edited(odd_documents(spark)).collect()
    assert counted((r["doc_id"], r["n_chars"]) for r in rows) == counted((k, len(t or "")) for k, t in TEXTS)
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    assert O.compare_edited(no_documents(spark)).count() == 0
    one = O.compare_edited(spark.createDataFrame([(5, "only one text here")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"only one text only").hexdigest()[:0] + hashlib.sha256(("only one text here"[:14] + "only").encode()).hexdigest()


def test_next_row_over_many_stretches(spark):
    keys = [i * i for i in range(500)] + [7, 7, 7, 10**15, -(10**15)]
    df = spark.createDataFrame([(k, f"t{i}") for i, k in enumerate(keys)], "doc_id long, text string").repartition(7)
    got = O.with_next(df, ["doc_id"], stretch_rows=16).collect()
    order = sorted(keys)
    want = counted((k, order[(i + 1) % len(order)]) for i, k in enumerate(order))
    assert counted((r["doc_id"], r["next"]["doc_id"]) for r in got) == want


# --- mixing


def corpus(spark):
    rows = []
    for i in range(300):
        k = i % 10
        text = " ".join(["the cat sat on it"] * (1 + i % 7)) if k < 6 else " ".join(["über größe öfter"] * (1 + i % 5)) if k < 9 else " ".join(["niño año señor"] * 3)
        rows.append((i, text, "en" if k < 6 else "de" if k < 9 else "es"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_mixing_meets_targets_and_brute_force(spark):
    docs = corpus(spark)
    model = M.fit_domains(docs, docs.select("doc_id", F.col("lang").alias("domain")), ["de", "en", "es"])
    profiles = M.profile(docs, model).cache()
    no_python(profiles)
    mix = M.fit_mix(profiles, model, {"de": 0.3, "en": 0.4, "es": 0.3})
    rows = M.rates(profiles, mix).collect()
    total = sum(r["n_tokens"] for r in rows)
    for d, share in (("de", 0.3), ("en", 0.4), ("es", 0.3)):
        assert sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in rows) == pytest.approx(share * total, rel=0.01)
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(max(("de", "en", "es"), key=lambda d: r[f"p_{d}"]) == truth[r["doc_id"]] for r in rows)
    # the same descent on the posteriors, row by row
    p = {r["doc_id"]: [r["p_de"], r["p_en"], r["p_es"]] for r in rows}
    n = {r["doc_id"]: r["n_tokens"] for r in rows}
    rate = dict.fromkeys(p, 1.0)
    have = [sum(n[k] * p[k][j] for k in p) for j in range(3)]
    for _ in mix.gradients:
        now = [sum(rate[k] * n[k] * p[k][j] for k in p) for j in range(3)]
        g = [(now[j] - mix.targets[j]) / have[j] for j in range(3)]
        rate = {k: max(0.0, rate[k] - sum(a * b for a, b in zip(p[k], g))) for k in p}
    assert all(r["rate"] == pytest.approx(rate[r["doc_id"]], abs=1e-6) for r in rows)


def test_floor_keeps_every_document(spark):
    docs = corpus(spark)
    model = M.fit_domains(docs, docs.select("doc_id", F.col("lang").alias("domain")), ["de", "en", "es"])
    mix = M.fit_mix(M.profile(docs, model), model, {"de": 1, "en": 1, "es": 1}, floor=1.0)
    made = M.mixed(docs, mix)
    assert made.columns == docs.columns
    copies = {r["doc_id"]: r["count"] for r in made.groupBy("doc_id").count().collect()}
    assert set(copies) == set(range(300)) and max(copies.values()) > 1
    drawn = {r["doc_id"]: r["copies"] for r in M.rates(M.profile(docs, model), mix).collect()}
    assert drawn == copies


def test_mixing_odd_rows(spark):
    docs = odd_documents(spark)
    model = M.fit_domains(docs, docs.select("doc_id", F.col("lang").alias("domain")), ["de", "en", "es"])
    mix = M.fit_mix(M.profile(docs, model), model, {"de": 1, "en": 1, "es": 1})
    rows = M.rates(M.profile(docs, model), mix).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert counted((r["doc_id"], r["n_tokens"]) for r in rows) == counted((k, words(t)) for k, t in TEXTS)
    assert all(r["rate"] >= 0 and r["p_es"] == 0 and r["p_de"] + r["p_en"] == pytest.approx(1) for r in rows)
    assert M.mixed(docs, mix).columns == docs.columns
    empty = no_documents(spark)
    assert M.rates(M.profile(empty, model), M.fit_mix(M.profile(empty, model), model, {"de": 1, "en": 1, "es": 1})).count() == 0
    lost = M.Mix(model, (), 0.0, (0.0, 5.0, 5.0), (3.0, 4.0, 3.0), (0.0, 5.0, 3.0))
    assert lost.missed() == ["de", "en"] and M.Mix(model, (), 0.0, (3.0, 4.0, 3.0), (3.0, 4.0, 3.0), (3.0, 4.0001, 3.0)).missed() == []
    untaught = M.fit_domains(docs, docs.select("doc_id", F.col("lang").alias("domain")).limit(0), ["de", "en"])
    assert M.rates(M.profile(docs, untaught), M.fit_mix(M.profile(docs, untaught), untaught, {"de": 1, "en": 1})).count() == len(TEXTS)


def test_small_targets_are_met_and_case_does_not_tell(spark):
    docs = corpus(spark)
    model = M.fit_domains(docs, docs.select("doc_id", F.col("lang").alias("domain")), ["de", "en", "es"])
    mix = M.fit_mix(M.profile(docs, model).cache(), model, {"de": 0.003, "en": 0.797, "es": 0.2})
    assert all(got == pytest.approx(want, rel=1.1e-4) for got, want in zip(mix.reached, mix.targets))
    cases = lambda up: M.profile(docs.withColumn("text", F.initcap("text") if up else F.col("text")), model)
    assert {r["doc_id"]: r["p"] for r in cases(True).collect()} == {r["doc_id"]: r["p"] for r in cases(False).collect()}


def test_languages_of_the_given_texts(spark):
    from promptloom.llm.queries import TARGETS, labelled_domains

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = M.fit_domains(docs, labelled_domains(docs, labels), sorted(TARGETS))
    rows = M.profile(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    right = sum(sorted(TARGETS)[max(range(4), key=lambda k: r["p"][k])] == r["lang"] for r in rows) / len(rows)
    assert right >= 0.963


# --- order min-hash over whole texts


def xx(*values):
    """Spark's 64-bit hash of values one after the other: strings, longs (int), and 32-bit integers (in a tuple)."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else (v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True))
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_order_minhash(text):
    """The fingerprint, slot by slot, each with its own order over all numbered k-mers."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    t = [xx(p) for w in words for p in ([w[i : i + 6] for i in range(0, len(w), 6)] if len(w) <= 24 else [w[i : i + 6] for i in range(len(w) - 5)])]
    mers = [xx(*t[i : i + 2]) >> 24 for i in range(max(len(t) - 1, min(len(t), 1)))]
    seen, elements = {}, []
    for at, m in enumerate(mers):
        n = seen[m] = seen.get(m, -1) + 1
        elements.append((xx(m, (n - 1,)) >> 24 if n else m, at))
    out = []
    for h in range(O.HASHES):
        ranks = [((xx(m, (h,)) >> 24 if h else m) << 24 | at, at) for m, at in elements]
        for b in range(O.STARTS):
            start = -(1 << 63) + b * ((1 << 64) // O.STARTS)
            least = sorted(ranks, key=lambda r: (r[0] - start) % (1 << 64))[: O.TUPLE]
            in_order = [(r >> 25) & ((1 << 39) - 1) for r, _ in sorted(least, key=lambda r: r[1])]
            out.append(f"{xx(*in_order) & 0xFFFFFFFF:08x}")
    return "".join(out) if elements else ""


def test_every_slot_ranks_all_kmers(spark):
    rng = random.Random(8)
    texts = [t or "" for _, t in TEXTS if len(t or "") < 10000] + ["a b", "a b c", "a b a b a b a b c a b", " ".join(f"word{i * 7919 % 100003}" for i in range(600))]
    texts += [" ".join(rng.choice("ab cd ef gh ijklmnopq".split()) for _ in range(n)) for n in (3, 5, 8, 20, 50, 200)]
    texts.append(" ".join(f"tok{i}" for i in range(40)) + " " + "".join(chr(0x4E00 + i * 37 % 20000) for i in range(300)))
    rows = O.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: brute_order_minhash(t) for i, t in enumerate(texts)}


def test_a_character_inserted_into_unspaced_text(spark):
    long = "".join(chr(0x4E00 + i * i * 37 % 20000) for i in range(1500))
    texts = [long, "x" + long, long[:700] + "x" + long[700:], "😀" + long]
    f = [r["fingerprint"] for r in O.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    for other in f[1:]:
        assert sum(f[0][i : i + 8] == other[i : i + 8] for i in range(0, 256, 8)) / 32 > 0.8
