"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has virtual nodes on a ring; a key belongs to the first one clockwise. A shard takes the
keys that are its own up to its bound; what overflows goes on clockwise, to the next virtual node of a
shard with room. The ring consists of 16,384 equal stretches, whatever the size of the data. Only the
number of keys in each stretch decides how many go where, so the driver settles the overflow on those
counts. A row then needs nothing but its rank in its stretch.

The bounds are exact: of n rows each of s shards takes n // s, and the first n % s take one more, so
that counts are at most one apart (law ``rows``). A wider bound moves fewer keys; see ``capacities``.

Defined results: a null text has size 1 and the checksum of an empty text. Repeated rows (equal key
and text) take a slot each. A null key is hashed like any other. An empty table gives no rows. A key
that occurs very often is ranked in one stretch; the key is meant to be unique.
"""

from __future__ import annotations

import bisect
import dataclasses
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name

#: The ring has 2 ** RING_BITS stretches of equal length; virtual nodes lie at their beginnings.
RING_BITS = 14
SHARDS = 8
VIRTUAL = 256


def _mixed(x: int) -> int:
    """A fixed 64-bit mixer for the places of virtual nodes."""
    x &= (1 << 64) - 1
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ x >> shift) * factor) & ((1 << 64) - 1)
    return x ^ x >> 31


@dataclasses.dataclass(frozen=True)
class Ring:
    """Virtual nodes in ring order: the stretch at which each lies, and whose it is."""

    places: tuple[int, ...]
    owners: tuple[int, ...]
    shards: int

    @classmethod
    def of(cls, shards: int, virtual: int = VIRTUAL) -> Ring:
        if shards * virtual > 1 << RING_BITS:
            raise ValueError(f"the ring has room for {1 << RING_BITS} virtual nodes")
        at: dict[int, int] = {}
        for s in range(shards):  # in order of shards, so that a further shard leaves the old places alone
            for v in range(virtual):
                place = _mixed((s + 1) * 0x9E3779B97F4A7C15 + v * 0xD1B54A32D192ED03) >> (64 - RING_BITS)
                while place in at:
                    place = (place + 1) % (1 << RING_BITS)
                at[place] = s
        return cls(tuple(sorted(at)), tuple(at[p] for p in sorted(at)), shards)

    def home(self, stretch: int) -> int:
        """The first virtual node clockwise from a stretch, by its number."""
        return bisect.bisect_left(self.places, stretch) % len(self.places)


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """The bound of each shard: exact shares, or ``1 + slack`` times the mean, rounded up."""
    exact = [rows // shards + (s < rows % shards) for s in range(shards)]
    return [max(e, math.ceil(rows / shards * (1 + slack))) for e in exact] if slack > 0 else exact


def settle(ring: Ring, counts: dict[int, int], room: list[int]) -> dict[int, list[tuple[int, int, int]]]:
    """Stretch -> runs of ranks that stay together: ``(first rank, shard, first slot)``.

    Keys at home go first; then each stretch's overflow moves clockwise, in ring order.
    """
    if sum(room) < sum(counts.values()):
        raise ValueError("the bounds leave no room for all rows")
    left, used = list(room), [0] * ring.shards
    runs: dict[int, list[tuple[int, int, int]]] = {}
    over: list[tuple[int, int, int]] = []

    def take(stretch: int, rank: int, shard: int, n: int) -> None:
        runs.setdefault(stretch, []).append((rank, shard, used[shard]))
        left[shard] -= n
        used[shard] += n

    for stretch in sorted(counts):
        shard = ring.owners[ring.home(stretch)]
        n = min(counts[stretch], left[shard])
        if n:
            take(stretch, 0, shard, n)
        if counts[stretch] > n:
            over.append((stretch, n, counts[stretch] - n))
    for stretch, rank, n in over:
        node = ring.home(stretch)
        while n:
            node = (node + 1) % len(ring.owners)
            shard = ring.owners[node]
            if m := min(n, left[shard]):
                take(stretch, rank, shard, m)
                rank, n = rank + m, n - m
    return runs


def assign(rows: DataFrame, key: list[str], shards: int = SHARDS, virtual: int = VIRTUAL, slack: float = 0.0) -> DataFrame:
    """``rows`` (narrow: no texts) with ``shard`` and ``slot``; the hash of ``key`` is the place on the ring.

    Counting runs over the keys once; the window runs within a stretch.
    """
    ring = Ring.of(shards, virtual)
    names = [free_name(rows.columns, n) for n in ("stretch", "runs", "rank", "place")]
    stretch, runs, rank, place = names
    placed = rows.withColumn(place, F.xxhash64(*key)).withColumn(stretch, F.shiftrightunsigned(place, 64 - RING_BITS).cast("int"))
    counts = {r[0]: r[1] for r in placed.groupBy(stretch).count().collect()}  # a row a stretch at most
    settled = settle(ring, counts, capacities(sum(counts.values()), shards, slack))
    # a run for each stretch, one more where a shard fills up or an overflow passes one: bounded by the ring
    plan = rows.sparkSession.createDataFrame(list(settled.items()), f"{stretch} int, {runs} array<struct<rank:long,shard:int,slot:long>>")
    others = [c for c in rows.columns if c not in key]
    ranked = placed.withColumn(rank, (F.row_number().over(W.partitionBy(stretch).orderBy(place, *key, *others)) - 1).cast("long"))
    run = F.element_at(F.filter(runs, lambda r: r["rank"] <= F.col(rank)), -1)
    found = ranked.join(F.broadcast(plan), stretch).withColumn(runs, F.array(run))
    return found.select(*rows.columns, F.col(runs)[0]["shard"].alias("shard"), (F.col(runs)[0]["slot"] + F.col(rank) - F.col(runs)[0]["rank"]).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: its size and checksum, its shard under the law ``rows`` and its slot there."""
    whole = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(docs[key].alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"))
    return assign(rows, ["doc_id"], shards, virtual).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
