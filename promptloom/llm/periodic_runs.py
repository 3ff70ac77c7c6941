"""Runs of repeated words: stretches of the smallest period q, at least twice as long, that no neighbour extends.

A run of period p that is 2p long holds two neighbouring points of the grid 0, p, 2p, ...; so for each period p and each j
the words at jp and (j+1)p are the anchors, and the longest common extensions of the two places, forward and backward, give
the whole stretch of period p around them. All periods together have n log n anchors (a harmonic sum). An extension is the minimum
of the longest common prefixes between the two places in the suffix array, answered by range-minimum tables; that of the
reversed words gives the backward ones. Anchors whose words differ have none and are left out first; of the anchors
in one stretch only the first counts; of the periods of one stretch the smallest.

The texts of a batch share one suffix array: each numbers its words by its own alphabet, so that no extension
leaves its text. Work is n log n in the words of a text, and memory some 200 bytes a word of the longest text.

Defined results: words are runs of other characters than blanks (U+0020, U+0009 to U+000D), compared as they are. Null and empty
texts have no words, no runs, and an empty collapsed text. Texts are taken whole. Repeated rows give a row each; other
columns stay as they are. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bound_batches, free_name, ship

#: The least length of a run, in words.
LEAST = 12
#: Words of the texts that share a suffix array, and anchors that are looked at together.
GROUP_WORDS, BLOCK = 1 << 18, 1 << 20
_BITS = 4


def suffix_array(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffixes in order, their ranks, and the ranks by the first 1, 2, 4, ... words (equal where those are).

    Prefix doubling; places whose rank is settled are not sorted again.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    held = words[order]
    begins = np.concatenate([[True], held[1:] != held[:-1]])
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    levels, active, k = [rank.astype(np.int32)], order[~(begins & np.append(begins[1:], True))], 1
    while len(active):
        old, after = rank[active], rank[np.minimum(active + k, n)]
        key = old * (n + 2) + after + 1
        order = np.argsort(key, kind="stable")
        active, old, key = active[order], old[order], key[order]
        group, own = np.concatenate([[True], old[1:] != old[:-1]]), np.concatenate([[True], key[1:] != key[:-1]])
        place = np.arange(len(active))
        rank[active] = old + np.maximum.accumulate(np.where(own, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        levels.append(rank.astype(np.int32))
        active = active[~(own & np.append(own[1:], True))]
        k *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank[:n]] = np.arange(n)
    return suffixes, rank[:n], levels


def neighbours_prefix(suffixes: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The longest common prefix of each suffix in the array and the one before it."""
    out = np.zeros(len(suffixes), np.int64)
    i, j, length = suffixes[:-1], suffixes[1:], np.zeros(max(0, len(suffixes) - 1), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        length += (levels[k][i + length] == levels[k][j + length]).astype(np.int64) << k
    out[1:] = length
    return out


class RangeMinimum:
    """Minima of stretches: running minima within blocks of 16, a sparse table over the blocks."""

    def __init__(self, values: np.ndarray):
        size = 1 << _BITS
        top = np.iinfo(np.int32).max
        self.values = np.full(-(-max(1, len(values)) // size) * size, top, np.int32)
        self.values[: len(values)] = values
        blocks = self.values.reshape(-1, size)
        self.to_here = np.minimum.accumulate(blocks, axis=1).ravel()
        self.from_here = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [blocks.min(axis=1)]
        while len(self.table[-1]) > 1 << len(self.table) - 1 and 1 << len(self.table) <= len(blocks):
            last, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(last[: len(last) - half], last[half:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The minima of the values from ``low`` to ``high``, both included."""
        a, b = low >> _BITS, high >> _BITS
        out = np.minimum(self.from_here[low], self.to_here[high])
        one = np.flatnonzero(a == b)
        if len(one):
            least, at, end = np.full(len(one), np.iinfo(np.int32).max, np.int32), low[one].copy(), high[one]
            for _ in range(1 << _BITS):
                least = np.where(at <= end, np.minimum(least, self.values[np.minimum(at, end)]), least)
                at += 1
            out[one] = least
        far = np.flatnonzero(b - a > 1)
        if len(far):
            x, y = a[far] + 1, b[far]  # blocks from x to before y
            level = np.frexp((y - x).astype(np.float64))[1] - 1
            for k in np.unique(level).tolist():
                at = level == k
                out[far[at]] = np.minimum(out[far[at]], np.minimum(self.table[k][x[at]], self.table[k][y[at] - (1 << k)]))
        return out


class Extensions:
    """Longest common extensions of pairs of places in a sequence."""

    def __init__(self, words: np.ndarray):
        suffixes, self.rank, levels = suffix_array(words)
        self.minima = RangeMinimum(neighbours_prefix(suffixes, levels))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return self.minima.of(np.minimum(a, b) + 1, np.maximum(a, b)).astype(np.int64)


def anchors(words: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places jp and periods p of all pairs of neighbouring grid points, in all texts and periods, whose words are equal."""
    texts = np.repeat(np.arange(len(sizes)), sizes // 2)
    firsts = np.cumsum(sizes // 2) - sizes // 2
    periods = np.arange(len(texts)) - firsts[texts] + 1
    base, counts = begins[texts], (sizes[texts] - 1) // np.maximum(periods, 1)
    ends = np.cumsum(counts)
    places, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for low in range(0, int(ends[-1]) if len(ends) else 0, BLOCK):
        high = min(low + BLOCK, int(ends[-1]))
        a, b = int(np.searchsorted(ends, low, "right")), int(np.searchsorted(ends, high, "left")) + 1
        starts = ends[a:b] - counts[a:b]
        many = np.minimum(ends[a:b], high) - np.maximum(starts, low)
        p = np.repeat(periods[a:b], many)
        i = (np.arange(low, high) - np.repeat(starts, many)) * p + np.repeat(base[a:b], many)
        same = words[i] == words[i + p]
        places.append(i[same])
        found.append(p[same])
    return np.concatenate(places), np.concatenate(found)


def runs(words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, start, length, period`` of all runs of texts that stand one after the other, by text, start and period.

    Numbers of words must not be shared between texts.
    """
    begins = np.cumsum(sizes) - sizes
    i, p = anchors(words, begins, sizes)
    empty = np.empty(0, np.int64)
    if not len(i):
        return empty, empty, empty, empty
    ahead = Extensions(words).of(i, i + p)
    # the first anchor of a stretch has less than p words before it
    able = ahead >= np.maximum(1, np.maximum(least - p, p) - p + 1)
    i, p, ahead = i[able], p[able], ahead[able]
    text = np.searchsorted(begins + sizes, i, "right")
    n, back, inside = len(words), np.zeros(len(i), np.int64), np.flatnonzero(i > begins[text])
    if len(inside):
        back[inside] = Extensions(words[::-1].copy()).of(n - i[inside], n - i[inside] - p[inside])
    good = (back < p) & (ahead + back >= p) & (ahead + back + p >= least)
    text, start, length, p = text[good], (i - back)[good], (ahead + back + p)[good], p[good]
    start -= begins[text]
    order = np.lexsort((p, length, start, text))
    text, start, length, p = text[order], start[order], length[order], p[order]
    same = np.concatenate([[False], (text[1:] == text[:-1]) & (start[1:] == start[:-1]) & (length[1:] == length[:-1])]) if len(text) else empty.astype(bool)
    text, start, length, p = text[~same], start[~same], length[~same], p[~same]
    order = np.lexsort((p, start, text))
    return text[order], start[order], length[order], p[order]


Edit = Callable[[object, int], tuple[int, int] | None]


def _group(rows: list[tuple[object, bytes]], least: int, edit: Edit | None) -> tuple[list[list[dict]], list[str], list[int]]:
    """Runs, collapsed text and number of words of each text."""
    held, numbers, base = [], [], 0
    for key, data in rows:
        words = data.split()
        if edit and words and (found := edit(key, len(words))):
            a, p = found
            at = np.arange(len(words))
            words = [words[k] for k in np.where(at < a, at, a + (at - a) % p).tolist()]
        alphabet = {w: base + k for k, w in enumerate(dict.fromkeys(words))}
        numbers.append(np.fromiter(map(alphabet.__getitem__, words), np.int64, len(words)))
        base += len(alphabet)
        held.append(words)
    sizes = np.array([len(w) for w in held], np.int64)
    text, start, length, period = runs(np.concatenate(numbers), sizes, least)
    edges = np.searchsorted(text, np.arange(len(rows) + 1))
    found, collapsed = [], []
    for k, words in enumerate(held):
        a, b = edges[k], edges[k + 1]
        found.append([{"start": s, "length": n, "period": q} for s, n, q in zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist())])
        if a < b:
            drop = np.zeros(len(words) + 1, np.int64)
            np.add.at(drop, start[a:b] + period[a:b], 1)
            np.add.at(drop, start[a:b] + length[a:b], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
        collapsed.append(b" ".join(words).decode("utf-8", "surrogatepass"))
    return found, collapsed, sizes.tolist()


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, edit: Edit | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or those in ``keep``) with ``n_words``, ``runs`` and ``collapsed``: the text without what runs repeat.

    ``edit(key, words)`` may give ``(a, p)``: from word a on, the text repeats its p words from there, before runs are looked for.
    """
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    kept = docs.columns if keep is None else keep
    names = [free_name(kept, n) for n in ("n_words", "runs", "collapsed")]
    long = T.LongType()
    run_type = T.ArrayType(T.StructType([T.StructField(c, long, False) for c in ("start", "length", "period")]), False)
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(n, t) for n, t in zip(names, (long, run_type, T.StringType())))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, t.encode("utf-8", "surrogatepass") if t else b"") for k, t in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist())]
            made: list[list] = [[], [], []]
            at = 0
            while at < len(rows):
                end, size = at, 0
                while end < len(rows) and (end == at or size + len(rows[end][1]) < 6 * GROUP_WORDS):
                    size += len(rows[end][1])
                    end += 1
                found, collapsed, sizes = _group(rows[at:end], least, edit)
                for column, values in zip(made, (sizes, found, collapsed)):
                    column += values
                at = end
            columns = [batch.column(c) for c in kept] + [pa.array(v, type=arrow.field(n).type) for n, v in zip(names, made)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow)], schema=arrow)

    return docs.mapInArrow(run, schema)


def planted(key: object, n: int) -> tuple[int, int] | None:
    """The rule of the query: a tenth of the documents, by a hash of the key, get a repeated end. A null key has none."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def run_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: number of runs, the longest one, digests of all runs and of the collapsed text."""
    found = find_runs(docs.select(docs[key].alias("doc_id"), docs[text].alias("text")), edit=planted, keep=["doc_id"])
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("q"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.q").alias("period"),
        F.expr("(-1000 * best.l) div best.q").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
