"""Ranked lexical search: an inverted index of segments, scored in windows of buckets.

A segment is what one task has read of the documents, up to a bound: its documents are numbered by ascending key, and its
postings (number, occurrences) stand by term and number. So the index is made in one pass over the texts, without an exchange, and
serves any queries. A query reads each segment in windows of ``WINDOW`` numbers: the postings of its terms in the window are
scattered into an array of scores that stays in the cache, each term's bitset of the window's documents marks which buckets are
occupied, and the occupied ones are harvested into a heap of the best. Heaps of the tasks meet in two steps, salted first.

A term weighs ``floor(1000 * ln((2N + 2) / (2df + 1)))``; a document scores the sum over the terms of the query, repeats included,
of ``weight * (10^9 tf div (1000 tf + 8m))``, ``m = 25 + (75 n N) div L``: N documents with a term, L terms in all, n
in the document, df documents with the term, tf its occurrences in the document. All but the logarithm is in 64-bit integers.

Queries are broadcast in blocks of about ``QUERY_TERMS`` pairs of query and term, each block one scan of the index, so that any number of queries is
served by a bounded broadcast. Every document is scored that shares a term, without cuts.

Defined results: terms are runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased. A null or
empty text has no terms, counts for nothing and is not found. Rows of documents are documents each, also where rows or keys repeat.
Equal scores are ordered by ascending key, null keys last. Scores are above 0; an item without such documents has no rows. Items that are
equal in all is asked count as one; different texts of one item id make one query together. Empty tables give no rows. Texts are taken whole.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bound_batches, cut, ship

BEST = 10
WINDOW = 2048
#: Bounds of a segment: postings before they are summed, and documents (their numbers have 16 bits).
SEGMENT_POSTINGS, SEGMENT_DOCS = 1 << 20, 1 << 16
QUERY_TERMS = 1 << 20
_PIECE = 1 << 22
#: Bytes of terms stay, A-Z in lower case; all others separate.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: The same for columns.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

INDEX = T.StructType([
    T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("terms", T.ArrayType(T.StringType())),
    T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("docs", T.BinaryType()), T.StructField("tfs", T.BinaryType()),
])


class _Segment:
    """Gathers documents and gives their postings by term."""

    def __init__(self) -> None:
        self.keys: list[int | None] = []
        self.lengths: list[int] = []
        self.numbers: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.docs: list[np.ndarray] = []
        self.terms: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.postings = 0

    def add(self, key: int | None, text: str | None) -> None:
        data, at, length = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE), 0, 0
        while at < len(data):  # in pieces, so that a long text is never a list of all its terms
            end = data.find(b" ", at + _PIECE)
            words = data[at : (at := end if end >= 0 else len(data))].split()
            found, times = np.unique(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)), return_counts=True)
            self.docs.append(np.full(len(found), len(self.keys)))
            self.terms.append(found)
            self.times.append(times)
            self.postings += len(found)
            length += len(words)
        self.keys.append(key)
        self.lengths.append(length)

    def full(self) -> bool:
        return self.postings >= SEGMENT_POSTINGS or len(self.keys) >= SEGMENT_DOCS

    def row(self) -> dict:
        order = sorted(range(len(self.keys)), key=lambda i: (self.keys[i] is None, self.keys[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        none = [np.empty(0, np.int64)]
        key = np.concatenate(self.terms or none) << 16 | place[np.concatenate(self.docs or none)]
        by = np.argsort(key, kind="stable")
        key, times = key[by], np.concatenate(self.times or none)[by]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else none[0]
        key, times = key[first], np.add.reduceat(times, first) if len(first) else times
        return {
            "keys": [self.keys[i] for i in order], "lengths": [self.lengths[i] for i in order], "terms": [t.decode("utf-8", "surrogatepass") for t in self.numbers],
            "counts": np.bincount(key >> 16, minlength=len(self.numbers)), "docs": (key & 0xFFFF).astype(np.uint16).tobytes(), "tfs": times.astype(np.int64).tobytes() if len(times) and times.max() >> 32 else times.astype(np.uint32).tobytes(),
        }


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index: a row for each segment, with keys and lengths of its documents, terms, and their postings packed by term."""
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    arrow = to_arrow_schema(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Segment()

        def closed() -> pa.RecordBatch:
            row = now.row()
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], type=f.type) for f in arrow], schema=arrow)

        for batch in batches:
            for k, t in zip(batch.column("k").to_pylist(), batch.column("t")):
                now.add(k, t.as_py())
                if now.full():
                    yield closed()
                    now = _Segment()
        if now.keys:
            yield closed()

    return docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t")).mapInArrow(run, INDEX)


def query_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``item, term, times``: the terms of each item."""
    rows = items.select(items[key].alias("item"), F.translate(items[text], UPPER, LOWER).alias("t")).distinct()
    found = rows.select("item", F.explode(F.regexp_extract_all("t", F.lit(PATTERN), F.lit(0))).alias("term"))
    return found.groupBy("item", "term").agg(F.count("*").alias("times"))


class _Best:
    """The best of each query so far: higher scores first, then smaller keys, null keys last."""

    def __init__(self, queries: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(queries)]

    def harvest(self, q: int, scores: np.ndarray, keys: list) -> None:
        heap = self.heaps[q]
        if len(heap) == self.k:
            at = np.flatnonzero(scores >= heap[0][0])
        else:
            at = np.flatnonzero(scores > 0)
        if len(at) > self.k:  # no more than k of a window can stay, and those of the least score that does by their keys
            at = at[scores[at] >= np.partition(scores[at], len(at) - self.k)[len(at) - self.k]]
        for i in at.tolist():
            entry = (int(scores[i]), -keys[i] if keys[i] is not None else -math.inf)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


def _score(row: dict, queries: list[tuple[np.ndarray, np.ndarray]], numbers: dict[str, int], weights: np.ndarray, n_docs: int, n_terms: int, best: _Best) -> None:
    """Adds what a segment has to the best of all queries (term numbers and repeats of each)."""
    begins = np.concatenate([[0], np.cumsum(row["counts"])])
    docs = np.frombuffer(row["docs"], np.uint16).astype(np.int64)
    tfs = np.frombuffer(row["tfs"], np.uint32 if len(row["tfs"]) == 4 * len(docs) else np.int64).astype(np.int64)
    m = np.array([25 + 75 * n * n_docs // n_terms for n in row["lengths"]], np.int64)
    # the postings of the terms that are asked for: what each adds to a score
    own = {number: k for k, t in enumerate(row["terms"]) if (number := numbers.get(t)) is not None}
    if not own:
        return
    slots, adds = {}, {}
    for number, k in own.items():
        at = docs[begins[k] : begins[k + 1]]
        tf = tfs[begins[k] : begins[k + 1]]
        slots[number], adds[number] = at, weights[number] * (1_000_000_000 * tf // (1000 * tf + 8 * m[at]))
    present = [[(t, r) for t, r in zip(terms.tolist(), repeats.tolist()) if t in own] for terms, repeats in queries]
    edges = np.arange(0, len(m) + WINDOW, WINDOW)
    cuts = {number: np.searchsorted(at, edges).tolist() for number, at in slots.items()}
    line = {number: k for k, number in enumerate(slots)}
    for w in range(len(edges) - 1):
        low, keys = w * WINDOW, row["keys"][w * WINDOW : (w + 1) * WINDOW]
        bits = np.zeros((len(line), WINDOW // 8), np.uint8)  # which buckets of the window each term occupies
        part = {}
        for number, at in slots.items():
            a, b = cuts[number][w], cuts[number][w + 1]
            if a < b:
                here = at[a:b] - low
                part[number] = here, adds[number][a:b]
                mark = np.zeros(WINDOW, np.uint8)
                mark[here] = 1
                bits[line[number]] = np.packbits(mark)
        scores = np.zeros(WINDOW, np.int64)
        for q, terms in enumerate(present):
            terms = [(t, r) for t, r in terms if t in part]
            if not terms:
                continue
            for t, r in terms:
                here, add = part[t]
                scores[here] += add if r == 1 else r * add
            occupied = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits[[line[t] for t, _ in terms]])))
            best.harvest(q, scores[occupied], [keys[i] for i in occupied.tolist()] if len(best.heaps[q]) < best.k else _Lazy(keys, occupied))
            scores[occupied] = 0


class _Lazy:
    """Keys of chosen places, looked up only where asked."""

    def __init__(self, keys: list, places: np.ndarray):
        self.keys, self.places = keys, places

    def __getitem__(self, i: int):
        return self.keys[self.places[i]]


def search(segments: DataFrame, items: DataFrame, k: int = BEST, key: str = "item_id", text: str = "text", block: int = QUERY_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of an ``index`` for each item. The index is read once a block of items, and twice for counts."""
    spark = segments.sparkSession
    asked = cut(query_terms(items, key, text))
    sizes = segments.select(F.sum(F.size(F.filter("lengths", lambda n: n > 0))).alias("docs"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, n: s + n)).alias("terms")).first()
    n_docs, n_terms = sizes["docs"] or 0, sizes["terms"] or 0
    counted = segments.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).select(F.col("p.terms").alias("t"), F.col("p.counts").alias("c"))
    wanted = asked.select(F.col("term").alias("w")).distinct()
    df = counted.join(wanted, F.col("t") == F.col("w"), "left_semi").groupBy("t").agg(F.sum("c").alias("df"))
    rows = cut(asked.join(df, F.col("term") == F.col("t")).select("item", "term", "times", "df"))
    blocks = max(1, -(-rows.count() // block))
    schema = T.StructType([T.StructField("item", rows.schema["item"].dataType), T.StructField("doc", T.LongType()), T.StructField("score", T.LongType())])
    found = [_block(segments, rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect(), schema, k, n_docs, n_terms) for b in range(blocks)]
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    place = F.row_number().over(W.partitionBy("item", "salt").orderBy(*order))
    part = best.withColumn("salt", F.pmod(F.xxhash64("doc", "score"), F.lit(16))).withColumn("place", place).where(F.col("place") <= k)
    ranked = part.drop("place").withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def _block(segments: DataFrame, rows: list, schema: T.StructType, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """``item, doc, score``: each task's best of a block's items (``item, term, times, df``)."""
    items = list(dict.fromkeys(r["item"] for r in rows))
    df = {r["term"]: r["df"] for r in rows}
    numbers = {t: i for i, t in enumerate(df)}
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.values()], np.int64)
    place = {x: i for i, x in enumerate(items)}
    terms: list[list] = [[] for _ in items]
    for r in rows:
        terms[place[r["item"]]].append((numbers[r["term"]], r["times"]))
    queries = [tuple(np.array(x, np.int64) for x in zip(*sorted(t))) for t in terms]
    shared = segments.sparkSession.sparkContext.broadcast((items, numbers, weights, queries))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, numbers, weights, queries = shared.value
        best = _Best(len(queries), k)
        for batch in batches:
            for i in range(batch.num_rows):
                _score(batch.slice(i, 1).to_pylist()[0], queries, numbers, weights, n_docs, n_terms, best)
        rows = [(items[q], None if doc == -math.inf else -doc, score) for q, heap in enumerate(best.heaps) for score, doc in heap if score > 0]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)], schema=arrow)

    return segments.mapInArrow(run, schema)


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``search`` over an index of ``docs`` that is made once and cut."""
    return search(cut(index(docs, key, text)), items, k)


#: The same rows in SQL.
SQL = """
WITH terms AS (
    SELECT doc_id, row_number() OVER () AS place, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents
), sizes AS (
    SELECT doc_id, place, len(w) AS n, w FROM terms WHERE len(w) > 0
), whole AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes
), postings AS (
    SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(w) AS term FROM sizes) GROUP BY place, term
), asked AS (
    SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), whole
), scored AS (
    SELECT a.item_id, p.place, sum(a.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * s.n * whole.docs) // whole.terms)))) AS score
    FROM asked a JOIN postings p ON a.term = p.term JOIN weights w ON w.term = a.term JOIN sizes s ON s.place = p.place, whole GROUP BY a.item_id, p.place
), placed AS (
    SELECT item_id, s.doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, s.doc_id NULLS LAST) AS rank FROM scored JOIN sizes s USING (place) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM placed WHERE rank <= 10
"""
