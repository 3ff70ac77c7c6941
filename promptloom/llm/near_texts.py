"""Near-duplicate texts of a stated likeness: SimHash and BK-trees in shards of least shingle hashes.

Two texts are near when the sets of their word shingles (five words) have a Jaccard likeness of at least
0.8. Texts of equal words form one class, of which one row goes on. Fingerprints of such texts differ in
nine bits on average and seldom in more than sixteen, which is too wide for blocks of bits; so a class is
dealt to the shards of its least hashes: 24 bands of four, where two texts of likeness j meet with the
probability 1 - (1 - j^4)^24, at 0.8 all but three in a million pairs, at 0.1 two in a thousand. A shard's fingerprints go into a BK-tree;
a search follows the edges within the radius only, and what it finds is checked by the exact likeness of
the two texts.

Links are found in two rounds, so that a group of many different texts never becomes all its pairs. In the
first, each member of a shard is checked against the shard's pivot, the member closest to the bits that most
of the shard agree on, and against the nearest of those before it in the tree; links that hold make
components. The second goes through shards whose members are still of more than one component and checks
all that is near between components, but for what counts exclude: a shingle that no other text of these
shards has is missing in each partner, and two texts share no more of a part of the hashes than the one that has
less there (``part_counts``); where that leaves less than the likeness, there is no link. A shard of
more than ``shard_limit`` members is dealt into chunks that share its pivot; members outside of the pivot's
component meet all chunks in the second round. No candidate is left out, so the second round costs as much as there
are pairs of different components that all of this leaves.

Defined results: a null or empty text has no words; all such texts are one class. A text of fewer words than
a shingle is one shingle. Texts are taken whole. The smallest key of a component stays, null keys last;
rows equal in key and text count as one. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut, map_rows, remove_folder, shared_folder, ship
from .components import stars
from .simhash import SEED, BKTree, majority_bits, one_row_each, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits up to which two texts are checked; at a likeness of 0.8 or more about one pair in 10,000 differs in more.
RADIUS = 24
BANDS, BAND_ROWS = 24, 4
SHARD_LIMIT = 1024
PARTS = 256
#: Odd factors of the hashes that order the shingles, and the hashes of a text that are made at a time.
_FACTORS = np.random.default_rng(20).integers(0, 1 << 63, (BANDS * BAND_ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 2048


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The hashes of the word shingles of a whole text, repeats included."""
    return np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, width)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard likeness of two sets of shingles; that of two empty ones is 1."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def part_counts(distinct: np.ndarray) -> bytes | None:
    """How many of the shingles fall into each of ``PARTS`` parts of the hashes; None where a count might not fit."""
    return np.bincount((distinct >> np.uint64(56)).astype(np.int64), minlength=PARTS).astype(np.uint16).tobytes() if len(distinct) < 1 << 16 else None


def shard_keys(distinct: np.ndarray) -> np.ndarray:
    """The shards of a text: a hash of the least four of each band's hashes."""
    if not len(distinct):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(distinct), _STEP):
        np.minimum(least, (distinct[at : at + _STEP][None, :] * _FACTORS).min(axis=1), out=least)
    bands = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(bands[i].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64)


def profiles(rows: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``rows`` without their texts, with class (two hashes of the words), fingerprint, distinct shingles and shards."""

    def make():
        def run(texts):
            out: dict[str, list] = {"c1": [], "c2": [], "fp": [], "n": [], "keys": []}
            for t in texts:
                words = b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split())
                whole = np.frombuffer(xxhash.xxh3_128_digest(words), np.int64)
                h = shingles(t, width)
                distinct = np.unique(h)
                for name, value in zip(out, (whole[0], whole[1], np.uint64(majority_bits(h)).astype(np.int64), len(distinct), shard_keys(distinct))):
                    out[name].append(value)
            return out

        return run

    long = T.LongType()
    adds = T.StructType([*(T.StructField(c, long) for c in ("c1", "c2", "fp", "n")), T.StructField("keys", T.ArrayType(long))])
    return map_rows(rows, make, "text", adds, [c for c in rows.columns if c != "text"])


class _Tree(BKTree):
    """A BK-tree whose nodes hold the members of equal fingerprints."""

    def __init__(self, radius: int):
        super().__init__(radius)
        self.members: list[list[int]] = []

    def near(self, value: int) -> Iterator[int]:
        """The members within the radius, node by node as the search meets them."""
        todo = [0] if self.values else []
        while todo:
            i = todo.pop()
            d = (value ^ self.values[i]).bit_count()
            if d <= self.radius:
                yield from self.members[i]
            todo += [child for k, child in self.children[i].items() if -self.radius <= k - d <= self.radius]

    def nearest(self, value: int, fits: Callable[[int], bool]) -> int | None:
        """The member that fits and has the least distance, if it is within the radius; edges close in with the search."""
        todo, best, found = [(0, 0)] if self.values else [], self.radius + 1, None
        while todo:
            off, i = todo.pop()
            if off >= best:
                continue
            d = (value ^ self.values[i]).bit_count()
            if d < best and (j := next(filter(fits, self.members[i]), None)) is not None:
                best, found = d, j
            todo += sorted(((abs(k - d), child) for k, child in self.children[i].items() if abs(k - d) < best), reverse=True)
        return found

    def add(self, value: int, member: int) -> None:
        i = 0
        while self.values:
            d = (value ^ self.values[i]).bit_count()
            if not d:
                self.members[i].append(member)
                return
            if d not in self.children[i]:
                self.children[i][d] = len(self.values)
                break
            i = self.children[i][d]
        self.values.append(value)
        self.children.append({})
        self.members.append([member])


def pivot(fps: list[int]) -> int:
    """The place of the fingerprint closest to the bits that most agree on."""
    most = majority_bits(np.array(fps, np.uint64))
    return min(range(len(fps)), key=lambda i: ((fps[i] ^ most).bit_count(), fps[i], i))


def first_links(members: dict[str, list], radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links of each member to the pivot and to the nearest of those before it, where fingerprints and sizes allow them.

    A chunk of a larger shard begins with the pivot of the whole (``late`` 0).
    """
    nodes, fps, sizes = members["node"], members["fp"], members["n"]
    lead = pivot(fps) if members["late"][0] else 0
    tree, out = _Tree(radius), []
    tree.add(fps[lead], lead)
    for i, value in enumerate(fps):
        if i == lead:
            continue
        fits = lambda j: min(sizes[i], sizes[j]) >= similarity * max(sizes[i], sizes[j])  # noqa: B023, E731  used at once
        found = tree.nearest(value, fits)
        pairs = {lead} if (value ^ fps[lead]).bit_count() <= radius and fits(lead) else set()
        out += [(nodes[j], nodes[i]) for j in (pairs if found is None else pairs | {found})]
        tree.add(value, i)
    return out


def crossing_links(members: dict[str, list], radius: int, similarity: float) -> list[tuple[int, int]]:
    """All pairs whose components differ, near by fingerprint, and by ``shared``, the shingles that any other text has, and ``counts``.

    Members of the largest component are asked for, but not put into the tree: they are not compared with
    each other. A pair is given in the least of the shards that hold both (``keys``) only.
    """
    nodes, fps, sizes, roots, shared, keys, shard = (members[c] for c in ("node", "fp", "n", "root", "shared", "keys", "shard"))
    counts = [np.frombuffer(c, np.uint16) if c else None for c in members["counts"]]
    most = Counter(roots).most_common(1)[0][0]
    tree, out = _Tree(radius), []
    held = [set(k) for k in keys]
    share = similarity / (1 + similarity)

    def possible(i: int, j: int) -> bool:
        least = share * (sizes[i] + sizes[j]) - 1e-9
        return min(shared[i], shared[j]) >= least and (counts[i] is None or counts[j] is None or int(np.minimum(counts[i], counts[j]).sum()) >= least)

    for i in sorted(range(len(nodes)), key=lambda i: roots[i] == most):
        for j in tree.near(fps[i]):
            if roots[j] != roots[i] and possible(i, j) and min(held[i] & held[j]) == shard[0]:
                out.append((nodes[j], nodes[i]))
        if roots[i] != most:
            tree.add(fps[i], i)
    return out


def _in_shards(dealt: DataFrame, link: Callable[[dict[str, list]], list[tuple[int, int]]]) -> DataFrame:
    """``a, b``: what ``link`` finds among the members of each ``shard, chunk``, as distinct pairs."""
    ship(dealt.sparkSession)
    ordered = dealt.repartition("shard", "chunk").sortWithinPartitions("shard", "chunk", "late", "fp", "node")
    columns = ordered.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {c: [] for c in columns}

        def close(out: list) -> None:
            if len(held["node"]) > 1:
                out += link(held | {"fp": [f & (1 << 64) - 1 for f in held["fp"]]})

        def made(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f(p) for p in out], pa.int64()) for f in (min, max)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple[int, int]] = []
            shard, chunk = batch.column("shard").to_numpy(), batch.column("chunk").to_numpy()
            values = {c: batch.column(c).to_pylist() for c in columns}
            begins = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (chunk[1:] != chunk[:-1])])).tolist()
            for a, b in zip(begins, [*begins[1:], len(shard)]):
                if (shard[a], chunk[a]) != key:
                    close(out)
                    key, held = (shard[a], chunk[a]), {c: [] for c in columns}
                for c in columns:
                    held[c] += values[c][a:b]
            yield made(out)
        out = []
        close(out)
        yield made(out)

    return ordered.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def _shards(nodes: DataFrame) -> DataFrame:
    """``shard, node, fp, n, members``: the shards of two members or more."""
    posted = nodes.select("node", "fp", "n", F.explode("keys").alias("shard"))
    live = posted.groupBy("shard").agg(F.count("*").alias("members")).where("members > 1").withColumnRenamed("shard", "s")
    return cut(posted.join(live, F.col("shard") == F.col("s")).drop("s"))


def _counts(texts: DataFrame, width: int) -> DataFrame:
    """``node, counts``: the ``part_counts`` of each text."""

    def make():
        return lambda texts: {"counts": [part_counts(np.unique(shingles(t, width))) for t in texts]}

    return map_rows(texts, make, "text", T.StructType([T.StructField("counts", T.BinaryType())]), ["node"])


def _own_shingles(texts: DataFrame, width: int) -> DataFrame:
    """``node, own``: how many of a text's distinct shingles no other text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text")):
                s = np.unique(shingles(text.as_py(), width)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), node)), pa.array(s)], names=["node", "s"])

    bound_batches(texts.sparkSession)
    alone = texts.mapInArrow(run, "node long, s long").groupBy("s").agg(F.count("*").alias("texts"), F.min("node").alias("node")).where("texts = 1")
    return alone.groupBy("node").agg(F.count("*").alias("own"))


def _still_apart(rows: DataFrame, nodes: DataFrame, roots: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Shards whose members are of more than one component: with ``root``, ``keys``, ``counts`` and ``shared``, the shingles that others have.

    Members that have too many of their own to be near to anything are left out.
    """
    rooted = rows.join(roots.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").withColumn("root", F.coalesce("root", "node")).drop("m")
    apart = rooted.groupBy("shard").agg(F.min("root").alias("l"), F.max("root").alias("m")).where("l <> m").select(F.col("shard").alias("s"))
    found = cut(rooted.join(apart, F.col("shard") == F.col("s"), "left_semi"))
    members = found.select(F.col("node").alias("m")).distinct()
    met = texts.join(members, F.col("node") == F.col("m"), "left_semi")
    own = _own_shingles(met, width).withColumnRenamed("node", "m")
    able = nodes.select("node", "keys", "n").join(members, F.col("node") == F.col("m"), "left_semi").join(own, F.col("node") == F.col("m"), "left")
    able = able.select(F.col("node").alias("m"), "keys", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared"), "n").where(F.col("shared") >= similarity * F.col("n") - 1e-9).drop("n")
    able = able.join(_counts(met, width), F.col("node") == F.col("m")).drop("node")
    return cut(found.join(able, F.col("node") == F.col("m")).drop("m"))


def _chunks(rows: DataFrame, shard_limit: int, crossing: bool) -> DataFrame:
    """``shard, chunk, late, ...``: large shards in chunks that begin with the shard's pivot.

    Where links between components are looked for, members outside of the pivot's meet all chunks.
    """
    columns = [c for c in rows.columns if c not in ("shard", "members")]
    small = rows.where(F.col("members") <= shard_limit).select("shard", F.lit(0).alias("chunk"), F.lit(1).alias("late"), *columns)
    hot = rows.where(F.col("members") > shard_limit)
    bit = lambda i: F.when(2 * F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))) > F.count("*"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(0)
    most = hot.groupBy(F.col("shard").alias("s")).agg(functools.reduce(Column.bitwiseOR, map(bit, range(64))).alias("most"))
    off = F.bit_count(F.col("fp").bitwiseXOR(F.col("most"))).alias("off")
    led = hot.join(most, F.col("shard") == F.col("s")).groupBy("shard", "members").agg(F.min(F.struct(off, *columns)).alias("p"))
    led = led.withColumn("chunks", F.ceil(F.col("members") / shard_limit).cast("int"))
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    first = led.select("shard", F.explode(every).alias("chunk"), F.lit(0).alias("late"), *(f"p.{c}" for c in columns))
    named = led.select(F.col("shard").alias("s"), "chunks", F.col("p.root").alias("main"), F.col("p.node").alias("pivot"))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    places = F.when(F.col("root") == F.col("main"), own).otherwise(every) if crossing else own
    rest = hot.join(named, F.col("shard") == F.col("s")).where("node <> pivot").select("shard", F.explode(places).alias("chunk"), F.lit(1).alias("late"), *columns)
    return small.unionByName(first).unionByName(rest)


def _checked(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """``u, v``: the pairs whose texts are alike, exactly."""
    one, other = (texts.select(F.col("node").alias(f"{c}_node"), F.col("text").alias(f"{c}_text")) for c in "ab")
    met = pairs.join(one, F.col("a") == F.col("a_node")).join(other, F.col("b") == F.col("b_node")).select("a", "b", "a_text", "b_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [likeness(shingles(x.as_py(), width), shingles(y.as_py(), width)) >= similarity for x, y in zip(batch.column("a_text"), batch.column("b_text"))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["u", "v"]).filter(pa.array(near, pa.bool_()))

    return cut(met.mapInArrow(run, "u long, v long"))


def components(rows: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """``rep, root``: the row that stands for each class of equal words, and what names its component.

    ``rows`` has ``doc_id`` and ``text``; ``rep`` is a struct of ``k``, the key, and ``h``, the text's hash, in that order
    behind a mark of null keys, so that the least one of a component is that of its smallest key.
    """
    spark = rows.sparkSession
    hashed = rows.select("doc_id", "text", F.xxhash64("text").alias("h"))
    rep = F.struct(F.col("doc_id").isNull().alias("is_null"), F.col("doc_id").alias("k"), "h").alias("rep")
    known = profiles(hashed, width).select("c1", "c2", "fp", "n", "keys", rep)
    classes = known.groupBy("c1", "c2").agg(F.min("rep").alias("rep"), *(F.any_value(c).alias(c) for c in ("fp", "n", "keys")))
    nodes = cut(classes.select(F.xxhash64("rep.k", "rep.h").alias("node"), "rep", "fp", "n", "keys"))
    shards = _shards(nodes)
    folder = shared_folder(spark, "near-texts")
    try:
        # the texts of all that share a shard with another are dealt and stored once
        alive = nodes.join(shards.select(F.col("node").alias("m")).distinct(), F.col("node") == F.col("m"), "left_semi").select(F.col("rep.k").alias("kept_key"), F.col("rep.h").alias("kept_hash"))
        one_row_each(hashed.select("doc_id", "text"), "doc_id", "text", alive).select(F.xxhash64("doc_id", F.xxhash64("text")).alias("node"), "text").write.parquet(folder)
        texts = spark.read.schema("node long, text string").parquet(folder)
        first = functools.partial(first_links, radius=radius, similarity=similarity)
        edges = _checked(_in_shards(_chunks(shards.withColumn("root", F.col("node")), shard_limit, False), first), texts, width, similarity)
        between = functools.partial(crossing_links, radius=radius, similarity=similarity)
        apart = _still_apart(shards, nodes, stars(edges), texts, width, similarity)
        crossing = _checked(_in_shards(_chunks(apart, shard_limit, True), between), texts, width, similarity)
    finally:
        remove_folder(spark, folder)
    found = stars(edges.unionByName(crossing)).withColumnRenamed("node", "m")
    return nodes.select("node", "rep").join(found, F.col("node") == F.col("m"), "left").select("rep", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """The rows of ``docs`` without their near-duplicates: the smallest key of each component stays."""
    found = components(docs.select(docs[key].alias("doc_id"), docs[text].alias("text")), width, similarity, radius, shard_limit)
    least = found.groupBy("root").agg(F.min("rep").alias("rep"))
    return one_row_each(docs, key, text, least.select(F.col("rep.k").alias("kept_key"), F.col("rep.h").alias("kept_hash")))
