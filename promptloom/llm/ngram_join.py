"""Jaccard join of documents on their word n-grams: a sparse matrix product in blocks of columns.

The incidence matrix has a row for each distinct set of n-grams and a column for each n-gram; its product with
its own transpose holds the overlaps. Columns stand in one order for all rows, rarest first as far as a fixed
table of counts tells them apart (``COUNTERS`` counters over all documents). A row of n n-grams whose likeness with
another reaches the limit shares one of its first ``n - ceil(limit * n) + 1`` columns with it, so the product
is taken over those columns only: each column is one key, columns make the blocks that Spark deals out, and a block adds
one to the overlap of each pair that meets in it. Sizes discard pairs throughout:

* before a product: rows of sizes that cannot reach the limit, and rows of which too much is unshared for certain: what stands
  before the column in the order of one row and is no column of any other row, or has no match in the other for lack of number;
* after the sum over blocks: what both rows have before their last common column and do not share is
  lost to the overlap for good; where that exceeds what the sizes allow, the pair goes.

What is left is counted exactly, over all columns of the two rows. A group of thousands of near copies never becomes
all its pairs: a first product multiplies each column's rows by the two rows of like size that have the fewest rarer n-grams, which
are the least edited of near copies, and makes components of the links that hold; a second one takes all pairs of rows of a column that are still of different
components. So no link between components is lost, and none is looked for inside of one.

Defined results: words are runs of other characters than blanks (U+0020, U+0009 to U+000D); only A-Z are lower-cased. A text of
fewer words than n is one n-gram; null and empty texts have an empty set, which links with nothing, so that each is
its own component. Texts are taken whole. Repeated rows give a row each. A component is named by its smallest key that is
not null, and by null where it has none. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut, map_rows, ship
from .components import stars

WIDTH = 4
#: The limit of the likeness, in hundredths.
LIMIT = 85
#: Counters of the order of columns, a power of two: the only thing broadcast, one byte each.
COUNTERS = 1 << 20
#: First columns of a row, 32 bits of each, that its places in the second product carry, to add up overlaps where two rows meet.
#: Two columns that agree in these bits count as shared, which excludes nothing; what is left is counted exactly later.
WINDOW = 128
_SLICE = 1 << 14
#: Bits of the map that tells which texts may be asked for, a multiple of 2^15.
BITS = 1 << 23
#: Parts of the hashes whose counts bound the overlap of two rows, a power of two.
PARTS = 512
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
_PIECE = 1 << 22


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word of a whole text, in pieces, so that a long text is never a list of all its words."""
    data, at, out = (text or "").encode("utf-8", "surrogatepass").lower(), 0, []
    while at < len(data):
        end = _BLANK.search(data, at + _PIECE)
        words = data[at : (at := end.start() if end else len(data))].split()
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def ngrams(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The hashes of the distinct n-grams of a whole text, ascending."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(width, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        h = (h ^ words[i : i + len(h)]) * _MIX
        h ^= h >> np.uint64(29)
    return np.unique(h * _MIX)


def least_overlap(both: int | np.ndarray, limit: int = LIMIT):
    """The least overlap of two rows of ``both`` n-grams together that reaches the limit."""
    return -(-limit * both // (100 + limit))


def column_weights(docs: DataFrame, width: int, counters: int) -> np.ndarray:
    """How often each counter's n-grams occur in all documents, on a logarithmic scale of one byte."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.int64)
        shift = np.uint64(64 - counters.bit_length() + 1)
        for batch in batches:
            if found := [ngrams(t.as_py(), width) for t in batch.column("text")]:
                total += np.bincount((np.concatenate(found) >> shift).astype(np.int64), minlength=counters)
        slices = total.reshape(-1, min(counters, _SLICE))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(slices)), pa.int32()), pa.array([s.tobytes() for s in slices], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column("slice").to_pylist(), batch.column("counts")):
                sums[k] = sums.get(k, 0) + np.frombuffer(c.as_py(), np.int64)
        scaled = {k: np.minimum(255, 4 * np.log2(s + 1)).astype(np.uint8).tobytes() for k, s in sums.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(scaled), pa.int32()), pa.array(list(scaled.values()), pa.binary())], names=["slice", "counts"])

    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    parts = docs.select("text").mapInArrow(count, "slice int, counts binary").repartition("slice").mapInArrow(add, "slice int, counts binary")
    found = dict(map(tuple, parts.collect()))  # one byte a counter, whatever the input
    return np.frombuffer(b"".join(found[k] for k in sorted(found)) or bytes(counters), np.uint8)


def in_order(grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The columns of a row's n-grams in the common order: rare counters first."""
    shift = np.uint64(64 - len(weights).bit_length() + 1)
    return np.sort(weights[(grams >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56) | grams >> np.uint64(8))


def short(columns: np.ndarray) -> np.ndarray:
    """The upper 32 bits of columns, in the same order."""
    return ((columns.view(np.uint64) >> np.uint64(32)).astype(np.int64) - (1 << 31)).astype(np.int32)


def rows_of(docs: DataFrame, weights: np.ndarray, width: int, limit: int) -> DataFrame:
    """``doc_id, h, c1, c2, n, first, window``: set and first columns of each document."""
    order = docs.sparkSession.sparkContext.broadcast(weights.tobytes())

    def make():
        known = np.frombuffer(order.value, np.uint8)

        def run(texts):
            out: dict[str, list] = {"c1": [], "c2": [], "n": [], "first": [], "window": []}
            for t in texts:
                g = ngrams(t, width)
                whole = np.frombuffer(xxhash.xxh3_128_digest(g.tobytes()), np.int64)
                ordered = in_order(g, known)
                first, window = ordered[: len(g) - -(-limit * len(g) // 100) + 1], short(ordered[:WINDOW])
                for name, value in zip(out, (whole[0], whole[1], len(g), first.view(np.int64), window)):
                    out[name].append(value)
            return out

        return run

    long = T.LongType()
    adds = T.StructType([*(T.StructField(c, long) for c in ("c1", "c2", "n")), T.StructField("first", T.ArrayType(long)), T.StructField("window", T.ArrayType(T.IntegerType()))])
    return map_rows(docs, make, "text", adds, ["doc_id", "h"])


def _padded(lists: pa.ListArray) -> np.ndarray:
    """Lists of ``WINDOW`` values at most as rows of that width, filled up with the largest value."""
    out = np.full((len(lists), WINDOW), np.iinfo(np.int64).max)
    sizes = np.diff(lists.offsets.to_numpy())
    out[np.arange(WINDOW) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Batches of rows sorted by ``col`` as arrays, cut so that a column's rows come together unless it fills whole batches;
    ``more`` says whether the first column goes on from the chunk before."""
    held, key = None, None
    for batch in batches:
        now = {c: _padded(batch.column(c)) if pa.types.is_list(batch.column(c).type) else batch.column(c).to_numpy() for c in names}
        if held is not None:
            now = {c: np.concatenate([held[c], now[c]]) for c in names}
        if not len(now["col"]):
            continue
        at = int(np.searchsorted(now["col"], now["col"][-1]))  # the last column may go on
        if not at and len(now["col"]) < 1 << 14:
            held = now
            continue
        at = at or len(now["col"])
        yield {c: v[:at] for c, v in now.items()} | {"more": now["col"][0] == key}
        key, held = now["col"][at - 1], {c: v[at:] for c, v in now.items()}
    if held is not None and len(held["col"]):
        yield held | {"more": held["col"][0] == key}


def _live(rows: DataFrame) -> DataFrame:
    """The rows of columns that have two or more: ``col, node, at`` (size and place), and ``live``, how many such columns the node has up to this one."""
    names = ["col", "node", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _columns(batches, names):
            new = x["col"][1:] != x["col"][:-1]
            alone = np.concatenate([[not x["more"]], new]) & np.concatenate([new, [True]])
            yield pa.RecordBatch.from_arrays([pa.array(x[c][~alone]) for c in names], names=names)

    met = rows.repartition("col").sortWithinPartitions("col").mapInArrow(run, "col long, node long, at long")
    return met.withColumn("live", F.row_number().over(W.partitionBy("node").orderBy("at"))).select("col", "node", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos"), F.col("live").cast("long").alias("live"))


PAIRS = "a long, b long, na long, nb long, pa long, pb long"


def _pairs(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, limit: int) -> pa.RecordBatch:
    """The pairs of places whose sizes and places in the order allow the limit, the smaller node first."""
    flip = x["node"][i] > x["node"][j]
    i, j = np.where(flip, j, i), np.where(flip, i, j)
    na, nb, pa_, pb = x["n"][i], x["n"][j], x["pos"][i], x["pos"][j]
    unshared = pa_ + pb + 2 - 2 * np.minimum(x["live"][i], x["live"][j])
    able = (x["node"][i] != x["node"][j]) & (100 * np.minimum(na, nb) >= limit * np.maximum(na, nb)) & (unshared <= na + nb - 2 * least_overlap(na + nb, limit))
    return pa.RecordBatch.from_arrays([pa.array(v[able]) for v in (x["node"][i], x["node"][j], na, nb, pa_, pb)], names=["a", "b", "na", "nb", "pa", "pb"])


def _to_pivots(live: DataFrame, limit: int) -> DataFrame:
    """Products of each column's rows with the first two of their class of sizes, and of the first of each class with that of the class before."""
    names = ["col", "size", "n", "node", "pos", "live"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _columns(batches, names):
            same = np.concatenate([[False], x["col"][1:] == x["col"][:-1]])
            begins = ~same | np.concatenate([[True], x["size"][1:] != x["size"][:-1]])
            at = np.arange(len(begins))
            first = np.maximum.accumulate(np.where(begins, at, 0))
            i = at[~begins]
            second = i[i > first[i] + 1]
            j = at[begins & same]
            yield _pairs(x, np.concatenate([first[i], first[second] + 1, first[j - 1]]), np.concatenate([i, second, j]), limit)

    sized = live.withColumn("size", F.floor(F.log(F.col("n")) / F.lit(float(-np.log(limit / 100))) + F.lit(1e-9)))
    return sized.repartition("col").sortWithinPartitions("col", "size", "pos", "node").mapInArrow(run, PAIRS)


def _possible(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
    """Which pairs of places meet in this column for the first time, and may reach the limit by the overlap of their windows.

    Up to the smaller of two ends all columns of both are known, so those without a match are unshared for certain.
    """
    top = np.iinfo(np.int64).max
    ends = np.where(x["n"] > WINDOW, x["window"][:, -1], top)
    end = np.minimum(ends[i], ends[j])[:, None]
    one, other = x["window"][i], x["window"][j]
    line = np.arange(len(i), dtype=np.int64)[:, None] << 33
    inside = other < end
    # each row ascends, and so do the rows one after the other: one search for all
    flat = (line + np.minimum(one, 1 << 31) + (1 << 31)).ravel()
    asked = (line + np.minimum(other, 1 << 31) + (1 << 31)).ravel()
    shared = inside & (flat[np.minimum(np.searchsorted(flat, asked), len(flat) - 1)] == asked).reshape(other.shape)
    known = (one < end).sum(axis=1) + inside.sum(axis=1)
    both = x["n"][i] + x["n"][j]
    here = short(x["col"][i])[:, None]
    return (known - 2 * shared.sum(axis=1) <= both - 2 * least_overlap(both, limit)) & ~(shared & (other < here)).any(axis=1)


def _able(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of places of different roots that sizes and places in the order allow."""
    some = x["root"][i] != x["root"][j]
    i, j = i[some], j[some]
    na, nb = x["n"][i], x["n"][j]
    unshared = x["pos"][i] + x["pos"][j] + 2 - 2 * np.minimum(x["live"][i], x["live"][j])
    some = (100 * np.minimum(na, nb) >= limit * np.maximum(na, nb)) & (unshared <= na + nb - 2 * least_overlap(na + nb, limit))
    return i[some], j[some]


#: Rows of a column up to which its pairs are taken step by step for all columns at once.
_SMALL = 32


def _cross(batches: Iterator[pa.RecordBatch], names: list[str], limit: int) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """Rows of columns, and the places of pairs of different roots that sizes and places in the order allow.

    The rows of a large column's most frequent root are not multiplied by each other.
    """
    tail = None  # rows of the column before that sizes still allow
    for x in _columns(batches, names):
        old = 0
        if tail is not None and x["more"]:
            old = len(tail["col"])
            x = {c: np.concatenate([tail[c], x[c]]) for c in names}
        edges = np.flatnonzero(np.concatenate([[True], x["col"][1:] != x["col"][:-1]]))
        sizes = np.diff(np.append(edges, len(x["col"])))
        mixed = np.minimum.reduceat(x["root"], edges) != np.maximum.reduceat(x["root"], edges)
        within = np.arange(len(x["col"])) - np.repeat(edges, sizes)
        rows = np.flatnonzero(np.repeat(mixed & (sizes <= _SMALL), sizes))
        rows = rows[rows >= old]
        for back in range(1, _SMALL):
            rows = rows[within[rows] >= back]
            if not len(rows):
                break
            i, j = _able(x, rows, rows - back, limit)
            if len(i):
                yield x, i, j
        for begin, size in zip(edges[mixed & (sizes > _SMALL)].tolist(), sizes[mixed & (sizes > _SMALL)].tolist()):
            n, root = x["n"][begin : begin + size], x["root"][begin : begin + size]
            roots, counts = np.unique(root, return_counts=True)
            main = roots[np.argmax(counts)]
            others = np.flatnonzero(root != main)
            lows = np.searchsorted(n, -(-limit * n // 100))
            for i in range(max(0, old - begin), size):
                js = others[np.searchsorted(others, lows[i]) : np.searchsorted(others, i)] if root[i] == main else np.arange(lows[i], i)
                left, right = _able(x, np.full(len(js), begin + i), begin + js, limit)
                if len(left):
                    yield x, left, right
        keep = (x["col"] == x["col"][-1]) & (100 * x["n"] >= limit * x["n"][-1])
        tail = {c: x[c][keep] for c in names}


def _meeting(apart: DataFrame, limit: int) -> DataFrame:
    """The places of ``apart`` that meet another: those whose windows are worth sending."""
    names = ["col", "n", "node", "pos", "live", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, some = None, None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held[c][some]) for c in names], names=names)

        for x, i, j in _cross(batches, names, limit):
            if x is not held:
                if held is not None:
                    yield made()
                held, some = x, np.zeros(len(x["col"]), bool)
            some[i] = some[j] = True
        if held is not None:
            yield made()

    return apart.repartition("col").sortWithinPartitions("col", "n", "node").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _between(places: DataFrame, limit: int) -> DataFrame:
    """``a, b, na, nb``: rows of a column whose ``root`` differs and that may reach the limit by what their windows share."""
    names = ["col", "n", "node", "pos", "live", "root", "window"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, i, j in _cross(batches, names, limit):
            for at in range(0, len(i), 2048):
                left, right = i[at : at + 2048], j[at : at + 2048]
                some = _possible(x, left, right, limit)
                left, right = left[some], right[some]
                flip = x["node"][left] > x["node"][right]
                left, right = np.where(flip, right, left), np.where(flip, left, right)
                if len(left):
                    yield pa.RecordBatch.from_arrays([pa.array(x[c][at]) for c in ("node", "n") for at in (left, right)], names=["a", "b", "na", "nb"])

    return places.repartition("col").sortWithinPartitions("col", "n", "node").mapInArrow(run, "a long, b long, na long, nb long").distinct()


def _summed(pairs: DataFrame, limit: int) -> DataFrame:
    """``a, b, na, nb``: the overlaps of the blocks added up, without the pairs that sizes exclude."""
    of = pairs.groupBy("a", "b").agg(F.count("*").alias("c"), F.min(F.col("pa") + F.col("pb")).alias("before"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    both = F.col("na") + F.col("nb")
    lost = both - 2 * F.ceil(both * F.lit(limit) / F.lit(100.0 + limit) - 1e-9)
    unshared = F.col("pa") + F.col("pb") + 2 - 2 * F.col("c")
    return of.where((unshared <= lost) & (F.col("before") <= lost)).select("a", "b", "na", "nb")


def part_counts(grams: np.ndarray) -> bytes | None:
    """How many n-grams fall into each of ``PARTS`` parts of the hashes; None where a count does not fit one byte."""
    counts = np.bincount((grams >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64), minlength=PARTS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def _maybe(docs: DataFrame, wanted: DataFrame, width: int, counted: bool) -> DataFrame:
    """``k, h, value`` of the rows of ``docs`` whose key and hash may be among ``wanted`` (``k, h``), with their ``part_counts`` or
    the text itself: a bitmap of fixed size tells, so that few others move."""
    place = F.pmod(F.xxhash64("k", "h"), F.lit(BITS))
    maps = wanted.groupBy(F.floor(place / (1 << 15)).alias("part")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(1 << 15))).alias("bits"))
    found = {r["part"]: r["bits"] for r in maps.collect()}  # BITS / 8 bytes, whatever the input
    bits = docs.sparkSession.sparkContext.broadcast(b"".join(bytes(found.get(i, bytes(1 << 12))) for i in range(BITS >> 15)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            at = batch.column("place").to_numpy()
            some = batch.filter(pa.array((known[at >> 3] >> (at & 7) & 1).astype(bool)))
            value = pa.array([part_counts(ngrams(t.as_py(), width)) for t in some.column("text")], pa.binary()) if counted else some.column("text")
            yield pa.RecordBatch.from_arrays([some.column("k"), some.column("h"), value], names=["k", "h", "value"])

    placed = docs.select(F.col("doc_id").alias("k"), "text", "h").withColumn("place", place)
    return placed.mapInArrow(run, T.StructType([placed.schema["k"], placed.schema["h"], T.StructField("value", T.BinaryType() if counted else T.StringType())]))


def _values(docs: DataFrame, nodes: DataFrame, width: int, counted: bool) -> DataFrame:
    """``node, value`` of the documents that stand for ``nodes`` (``node, rep``), each once."""
    named = nodes.select("node", F.col("rep.k").alias("rk"), F.col("rep.h").alias("rh"))
    some = _maybe(docs, named.select(F.col("rk").alias("k"), F.col("rh").alias("h")), width, counted)
    equal = F.coalesce(F.col("k") == F.col("rk"), F.col("k").isNull() & F.col("rk").isNull())
    return some.join(named, (F.col("h") == F.col("rh")) & equal).groupBy("node").agg(F.any_value("value").alias("value"))


def _beside(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, counted: bool) -> DataFrame:
    """``pairs`` (``a, b, na, nb``) with the values of both (``x, y``)."""
    named = nodes.select("node", "rep").join(pairs.select(F.explode(F.array("a", "b")).alias("m")).distinct(), F.col("node") == F.col("m"), "left_semi")
    values = cut(_values(docs, cut(named), width, counted))
    one, other = (values.select(F.col("node").alias(f"{c}_node"), F.col("value").alias(v)) for c, v in ("ax", "by"))
    return pairs.join(one, F.col("a") == F.col("a_node")).join(other, F.col("b") == F.col("b_node")).select("a", "b", "na", "nb", "x", "y")


def _linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, limit: int) -> DataFrame:
    """``u, v``: the pairs whose overlap over all columns reaches the limit.

    Counts of n-grams in parts of the hashes bound the overlap from above; the texts of pairs that pass are compared.
    """
    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = [None if x is None or y is None else int(np.minimum(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)).sum()) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            least = least_overlap(batch.column("na").to_numpy() + batch.column("nb").to_numpy(), limit).tolist()
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array([m is None or m >= n for m, n in zip(most, least)], pa.bool_()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            near = []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("x"), batch.column("y")):
                if a != last:
                    last, held = a, ngrams(x.as_py(), width)
                other = ngrams(y.as_py(), width)
                near.append(len(np.intersect1d(held, other, assume_unique=True)) >= least_overlap(len(held) + len(other), limit))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["u", "v"]).filter(pa.array(near, pa.bool_()))

    met = cut(_beside(cut(pairs), docs, nodes, width, True).mapInArrow(likely, "a long, b long, na long, nb long"))
    return cut(_beside(met, docs, nodes, width, False).mapInArrow(exact, "u long, v long"))


def components(docs: DataFrame, width: int = WIDTH, limit: int = LIMIT, counters: int = COUNTERS) -> DataFrame:
    """``doc_id, n, component``: a row for each of ``docs`` (``doc_id, text``), with the size of its set."""
    spark = docs.sparkSession
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    known = cut(rows_of(hashed, column_weights(hashed, width, counters), width, limit))
    rep = F.struct(F.col("doc_id").isNull().alias("is_null"), F.col("doc_id").alias("k"), "h")
    classes = known.where("n > 0").groupBy("c1", "c2").agg(F.min(rep).alias("rep"), F.any_value("n").alias("n"), F.any_value("first").alias("first"), F.any_value("window").alias("window"))
    nodes = cut(classes).withColumn("node", F.monotonically_increasing_id())  # the same at each reading of the checkpoint
    live = cut(_live(nodes.select("n", "node", F.posexplode("first").alias("pos", "col")).select("col", "node", F.shiftleft("n", 32).bitwiseOR(F.col("pos")).alias("at"))))
    edges = _linked(_summed(_to_pivots(live, limit), limit), hashed, nodes, width, limit)
    roots = stars(edges).withColumnRenamed("node", "m")
    rooted = live.join(roots, F.col("node") == F.col("m"), "left").select("col", "n", "node", "pos", "live", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy(F.col("col").alias("c")).agg(F.min("root").alias("l"), F.max("root").alias("g")).where("l <> g").select("c")
    met = _meeting(rooted.join(mixed, F.col("col") == F.col("c"), "left_semi"), limit)
    met = met.join(nodes.select(F.col("node").alias("m"), "window"), F.col("node") == F.col("m")).drop("m")
    crossing = _linked(_between(met, limit), hashed, nodes, width, limit)
    found = stars(edges.unionByName(crossing)).withColumnRenamed("node", "m")
    rooted = nodes.select("c1", "c2", "node", "rep").join(found, F.col("node") == F.col("m"), "left").select("c1", "c2", "rep", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("rep")).select(F.col("root").alias("r"), F.col("rep.k").alias("component"))
    named = rooted.join(least, F.col("root") == F.col("r")).select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), "component")
    joined = known.select("doc_id", "c1", "c2", "n").join(named, (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")), "left")
    return joined.select("doc_id", "n", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, limit: int = LIMIT, counters: int = COUNTERS) -> DataFrame:
    """One row a document: key, size of its set of n-grams, and the smallest key that links reach from it."""
    found = components(docs.select(docs[key].alias("doc_id"), docs[text].alias("text")), width, limit, counters)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs`` whose key names their component; rows without a key stay where their component has no other."""
    found = jaccard_components(docs, key, text, width, limit).where(F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    keys = found.select(F.col("doc_id").alias("kept_key")).distinct()
    return docs.join(keys, docs[key].eqNullSafe(F.col("kept_key")), "left_semi")


#: The same rows in SQL: n-grams as strings, links by counting, components by closure (for small tables).
SQL = """
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words
), classes AS (
    SELECT min(doc_id) AS id, s, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM sets) WHERE len(s) > 0 GROUP BY s
), grams AS (
    SELECT id, n, unnest(s) AS g FROM classes
), shared AS (
    SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id
    WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.id, b.id
), links AS (
    SELECT a AS u, b AS v FROM shared WHERE 100 * c >= 85 * (na + nb - c) UNION ALL SELECT b, a FROM shared WHERE 100 * c >= 85 * (na + nb - c)
), reach AS (
    SELECT id AS u, id AS v FROM classes UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), named AS (
    SELECT c.s, min(r.v) AS component FROM classes c JOIN reach r ON r.u = c.id GROUP BY c.s
)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, CAST(CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE n.component END AS BIGINT) AS component_id
FROM sets d LEFT JOIN named n ON list_sort(d.s) = n.s
"""
