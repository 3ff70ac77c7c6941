"""SimHash near-duplicates: Hamming-radius links found in BK-trees of shards.

A fingerprint has 64 bits; with four blocks of 16, two fingerprints that differ in three bits or
fewer agree on a block. So (block, value) makes the shards, and every link lies in one. Each shard's
distinct fingerprints go into a BK-tree, whose children are keyed by their Hamming distance to the
parent; a search follows the edges within the radius only. A shard with more members than
``shard_limit`` is split again on a quarter of the bits that are left, as often as need be, by the same
argument without loss. Trees reach the tasks by their shard's key, not by a broadcast from the
driver: the fingerprints of a whole corpus have no size bound that the driver could hold.

Copies share a fingerprint and meet as one node, so a group of thousands costs as one. A task reports
a spanning forest of the links in its shard; components of the whole are found over those edges.

Defined results: a null or empty text has no words and fingerprint zero, linked like any other. Texts
are taken whole. Repeated rows give a row each. Null keys are carried along; the component is named by
the smallest key that is not null, and is null where a component has none. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, map_rows, ship
from .components import stars

BITS = 64
SHINGLE = 3
SEED = 42
RADIUS = 3
#: Members of a shard beyond which it is split on further bits.
SHARD_LIMIT = 1024
#: Bits of a fingerprint below which a shard is not split: it has a few hundred distinct members at most.
LEAST_BITS = 9
#: Characters of a text whose shingles are hashed at a time.
BLOCK = 1 << 20
_BLANK = re.compile(r"[\x20\x09-\x0D]")


def shingle_hashes(text: str | None, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """The unsigned hashes of a text's shingles, repeats included, in blocks of some ``BLOCK`` characters.

    Blocks end at blanks and carry the words that the next one's first shingles need, so that beside the text no more than
    a block (or a longer word) is held.
    """
    text, digest = text or "", xxhash.xxh64_intdigest
    words: list[bytes] = []
    at, any_yet = 0, False
    while at < len(text):
        blank = _BLANK.search(text, at + BLOCK)
        end = blank.start() if blank else len(text)
        words += text[at:end].encode("utf-8", "surrogatepass").lower().split()
        at = end
        if len(words) < width:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = [0, *(ends[: len(words) - width] + 1).tolist()]
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(begins, ends[width - 1 :].tolist())], np.uint64)
        words, any_yet = words[len(words) - width + 1 :], True
    if words and not any_yet:
        yield np.array([digest(b" ".join(words), SEED)], np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned fingerprint of a whole text."""
    counts, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, width):
        counts += _bit_counts(hashes)
        n += len(hashes)
    return _over_half(counts, n)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # each hash takes 64 bytes there
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def _over_half(counts: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero where there is none."""
    return _over_half(_bit_counts(hashes), len(hashes))


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the fingerprint of each whole text as a signed long."""

    def make():
        def run(texts):
            return {into: np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)}

        return run

    return map_rows(docs, make, text, T.StructType([T.StructField(into, T.LongType())]), keep)


class BKTree:
    """Distinct integers under Hamming distance."""

    def __init__(self, radius: int = RADIUS):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.radius = radius

    def near_then_add(self, value: int) -> list[int]:
        """Positions of all members within the radius; then ``value`` becomes a member."""
        radius, values, children = self.radius, self.values, self.children
        new = len(values)
        values.append(value)
        children.append({})
        if not new:
            return []
        found, todo = [], [0]
        while todo:
            i = todo.pop()
            d = (value ^ values[i]).bit_count()
            if d <= radius:
                found.append(i)
            for k, child in children[i].items():
                if -radius <= k - d <= radius:
                    todo.append(child)
        i = 0
        while True:
            d = (value ^ values[i]).bit_count()
            if d not in children[i]:
                children[i][d] = new
                return found
            i = children[i][d]


def forest(members: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join the members of a shard into its components, without cycles."""
    if len(members) == 2:
        a, b = members
        return [(a, b)] if (a ^ b).bit_count() <= radius else []
    tree, above, out = BKTree(radius), list(range(len(members))), []

    def root(i: int) -> int:
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    for n, value in enumerate(members):
        for i in tree.near_then_add(value):
            a, b = root(i), root(n)
            if a != b:
                above[b] = a
                out.append((members[i], value))
    return out


def _spread(rows: DataFrame, bits: int) -> DataFrame:
    """Each of ``shard, rest, fp`` under its four sub-shards of a quarter of ``rest``'s ``bits``.

    Sub-shards are named by a hash: should two have one name, they are searched as one and no link is lost.
    """
    part = bits // 4
    ones = (1 << part) - 1

    def option(i: int):
        low = F.col("rest").bitwiseAND(F.lit((1 << i * part) - 1)) if i else F.lit(0).cast("long")
        high = F.shiftleft(F.shiftrightunsigned("rest", (i + 1) * part), i * part) if (i + 1) * part < bits else F.lit(0).cast("long")
        value = F.shiftrightunsigned("rest", i * part).bitwiseAND(F.lit(ones))
        return F.struct(F.xxhash64("shard", F.lit(i), value).alias("shard"), low.bitwiseOR(high).alias("rest"))

    return rows.select("fp", F.explode(F.array(*(option(i) for i in range(4)))).alias("o")).select("o.shard", "o.rest", "fp")


def links(nodes: DataFrame, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """``u, v``: links between distinct fingerprints (column ``fp``), enough to join every component.

    Exact for ``radius`` up to 3, the number of blocks less one. A shard is split as long as it is over
    the limit and more than ``LEAST_BITS`` bits are left to its members, which are that few values then.
    """
    if radius > 3:
        raise ValueError("four blocks are exact up to three differing bits")
    ship(nodes.sparkSession)
    rows = _spread(nodes.select(F.lit(0).cast("long").alias("shard"), F.col("fp").alias("rest"), "fp"), BITS)
    parts, bits = [], BITS - BITS // 4
    while bits > LEAST_BITS:
        hot = cut(rows.groupBy("shard").count().where(F.col("count") > shard_limit).select(F.col("shard").alias("hot")))
        if hot.isEmpty():
            break
        parts.append(rows.join(hot, F.col("shard") == F.col("hot"), "left_anti"))
        rows = _spread(rows.join(hot, F.col("shard") == F.col("hot"), "left_semi"), bits)
        bits -= bits // 4
    parts.append(rows)
    keyed = [p.select(F.lit(i).alias("level"), "shard", "fp") for i, p in enumerate(parts)]
    shards = functools.reduce(DataFrame.unionByName, keyed)
    dealt = shards.repartition("level", "shard").sortWithinPartitions("level", "shard", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []

        def close(us: list, vs: list) -> None:
            if len(held) > 1:
                for a, b in forest(held, radius):
                    us.append(a)
                    vs.append(b)

        for batch in batches:
            us: list[int] = []
            vs: list[int] = []
            level, shard = batch.column("level").to_numpy(), batch.column("shard").to_numpy()
            value = batch.column("fp").to_numpy().view(np.uint64)
            if not len(value):
                continue
            new = np.concatenate([[True], (shard[1:] != shard[:-1]) | (level[1:] != level[:-1])])
            begins = np.flatnonzero(new)
            values = value.tolist()
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(values)]):
                key = (level[a], shard[a])
                if key != held_key:
                    close(us, vs)
                    held_key, held = key, []
                held += values[a:b]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (us, vs)], names=["u", "v"])
        us, vs = [], []
        close(us, vs)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (us, vs)], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def _components(keyed: DataFrame, radius: int, shard_limit: int) -> DataFrame:
    """``keyed`` has ``fp`` and ``rep`` (an orderable struct): ``fp, rep`` with the least rep of the component."""
    nodes = cut(keyed.groupBy("fp").agg(F.min("rep").alias("rep")))
    found = stars(links(nodes, radius, shard_limit))
    rooted = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("rep")).withColumnRenamed("root", "r")
    return rooted.select("fp", "root").join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("node"), "rep")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """One row a document: key, fingerprint in hex, and the smallest key that links reach from it."""
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    fps = cut(fingerprints(rows, keep=["doc_id"]))
    # nulls last: a key that is not null names the component
    keyed = fps.select("fp", F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("k")).alias("rep"))
    found = _components(keyed, radius, shard_limit)
    return fps.join(found, F.col("fp") == F.col("node")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("rep.k").alias("component_id")
    )


def one_row_each(docs: DataFrame, key: str, text: str, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``kept`` names by ``kept_key, kept_hash``, one row for each.

    Rows that are equal in key and text count as one; which of them stays is the same at every run as
    far as they are equal in all columns.
    """
    names = [free_name(docs.columns, n) for n in ("kept_key", "kept_hash", "kept_key_hash", "key_hash", "text_key", "copy")]
    kept = kept.select(F.col("kept_key").alias(names[0]), F.col("kept_hash").alias(names[1]), F.xxhash64("kept_key").alias(names[2]))
    hashed = docs.withColumns({names[3]: F.xxhash64(docs[key]), names[4]: F.xxhash64(docs[text])})
    # joined and numbered by the same two hashes, so that the texts move once; the keys themselves decide
    # (spelled out: a null-safe equality would join the hash keys, and the window would need another exchange)
    equal_keys = F.coalesce(hashed[key] == kept[names[0]], hashed[key].isNull() & kept[names[0]].isNull())
    same = (hashed[names[3]] == kept[names[2]]) & (hashed[names[4]] == kept[names[1]]) & equal_keys
    joined = hashed.join(kept, same, "left_semi")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (key, text) and not isinstance(docs.schema[c].dataType, T.MapType)]
    order = W.partitionBy(names[3], names[4], F.col(f"`{key}`")).orderBy(*others, names[4])
    return joined.withColumn(names[5], F.row_number().over(order)).where(F.col(f"`{names[5]}`") == 1).select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """The rows of ``docs`` without their near-duplicates: the smallest key of each component stays."""
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("h"))
    fps = cut(fingerprints(rows, keep=["doc_id", "h"]))
    keyed = fps.select("fp", F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("k"), "h").alias("rep"))
    kept = _components(keyed, radius, shard_limit).select(F.col("rep.k").alias("kept_key"), F.col("rep.h").alias("kept_hash")).distinct()
    return one_row_each(docs, key, text, kept)
