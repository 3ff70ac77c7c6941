"""Order MinHash: fingerprints that follow edit distance, in DataFrame functions only.

A text is a sequence of tokens: words, cut into pieces of at most six characters. A run without a space
of more than 24 characters gives all its pieces of six, one from each character on, so that an inserted
character changes the pieces around it only. Each k-mer of tokens gets its occurrence number (the third
time the same k-mer is found is another element than the first), so repeats count. Each of 32 slots has an
order of its own over all numbered k-mers of the text; its ``TUPLE`` smallest are taken, put back in text order,
and hashed together. The orders come of ``HASHES`` independent hashes, each read round its values from
``STARTS`` places at equal distances on: one sort serves the slots of a hash, and the 32 agree between two
texts as often, and with as little spread, as 32 independent hashes do (measured; see the README).
The likeness of two fingerprints is the share of slots that agree: it falls both when content changes
and when content moves.

All of it works on arrays within a row: a sort by hash brings equal k-mers together, where their place
in the run is the occurrence number. Cost is n log n in a text's tokens, and no row is exploded.

Defined results: a null text is an empty one. A text of fewer tokens than k is one k-mer; without
tokens the fingerprint is the empty string. Two empty fingerprints are alike (1), an empty one and
another are not (0). Repeated rows have equal fingerprints. In a text of more than 16.7 million tokens the places
are counted in equal steps instead of single tokens; what stands in one step is put in order of its hash. An empty
table gives no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 2
TUPLE = 2
HASHES, STARTS = 2, 16
SLOTS = HASHES * STARTS
#: Characters of a token, and the length up to which a run without spaces is cut at a fixed stride.
PIECE = 6
LONGEST_WORD = 24
#: Places in a text fit in so many bits; the rest of a long holds the hash.
_PLACE_BITS = 24
_PLACE = (1 << _PLACE_BITS) - 1
#: Rows of a stretch of neighbouring keys, and the most stretches; a stretch's bound is found by comparing twice the root.
STRETCH_ROWS = 128
MAX_STRETCHES = 65536
#: Where a null key stands.
LOWEST = -(1 << 63) + 1


def _packed(value: Column, place: Column) -> Column:
    """The upper bits of a hash and a place, ordered by the hash."""
    return value.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place.cast("long"))


def tokens(text: Column) -> Column:
    """The tokens of a text in order: pieces of words, and overlapping pieces of long runs."""
    run = r"[^\x20\x09-\x0D]"
    pieces = F.regexp_extract_all(text, F.lit(f"{run}{{1,{PIECE}}}"), F.lit(0))
    overlapping = lambda w: F.regexp_extract_all(w, F.lit(f"(?s)(?=(.{{{PIECE}}}))."), F.lit(1))
    cut_up = lambda w: F.when(F.length(w) > LONGEST_WORD, overlapping(w)).otherwise(F.regexp_extract_all(w, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    either = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"{run}+"), F.lit(0)), cut_up))
    return F.when(text.rlike(f"{run}{{{LONGEST_WORD + 1}}}"), either).otherwise(pieces)


def with_fingerprint(df: DataFrame, text: Column, into: str, k: int = K, hashes: int = HASHES, starts: int = STARTS, tuple_size: int = TUPLE) -> DataFrame:
    """``df`` with the fingerprint of ``text`` in column ``into``: eight hex digits for each of ``hashes * starts`` slots.

    Each step is a column of its own, so that no array is made twice.
    """
    w = lambda n: f"_{into}_{n}"
    col = lambda n: F.col(w(n))
    out = df.withColumn(w("t"), F.transform(tokens(F.coalesce(text, F.lit(""))), lambda t: F.xxhash64(t)))
    n = F.size(col("t"))
    # k-mers, as hash and place, in order of the hash
    mer = lambda x, i: F.xxhash64(x, *(F.get(col("t"), i + j) for j in range(1, k)))
    begun = F.slice(col("t"), 1, F.greatest(n - (k - 1), F.least(n, F.lit(1))))
    step = F.ceil(n / F.lit(_PLACE + 1)).cast("int")
    kmers = F.when(n <= _PLACE + 1, F.transform(begun, lambda x, i: _packed(mer(x, i), i))).otherwise(F.transform(begun, lambda x, i: _packed(mer(x, i), F.floor(i / step))))
    out = out.withColumn(w("s"), F.sort_array(kmers))
    # the first of each run of equal k-mers keeps its hash, and so its place in the order; the others are numbered
    again = lambda e, i: (i > 0) & (F.shiftright(F.get(e, i - 1), _PLACE_BITS) == F.shiftright(F.get(e, i), _PLACE_BITS))
    out = out.withColumn(w("r"), F.filter(col("s"), lambda x, i: again(col("s"), i)))
    out = out.withColumn(w("b"), F.filter(F.transform(col("r"), lambda x, i: F.when(~again(col("r"), i), i)), lambda i: i.isNotNull()))
    last = lambda j: F.coalesce(F.get(col("b"), j + 1), F.size(col("r")))
    number = lambda x, o: _packed(F.xxhash64(F.shiftright(x, _PLACE_BITS), o), x.bitwiseAND(F.lit(_PLACE)))
    numbered = F.flatten(F.transform(col("b"), lambda b, j: F.transform(F.slice(col("r"), b + 1, last(j) - b), number)))
    out = out.withColumn(w("p"), F.concat(F.filter(col("s"), lambda x, i: ~again(col("s"), i)), numbered))

    # all k-mers in the order of each hash, with a mark at each start: only marks have no bits below those that count the starts
    marks = [-(1 << 63) + b * ((1 << 64) // starts) for b in range(starts)]
    is_mark = lambda x: x.bitwiseAND(F.lit((1 << 64) // starts - 1)) == 0
    for h in range(hashes):
        ranked = F.transform(col("p"), lambda x: _packed(F.xxhash64(F.shiftright(x, _PLACE_BITS), F.lit(h)), x.bitwiseAND(F.lit(_PLACE)))) if h else col("p")  # noqa: B023
        out = out.withColumn(w(f"h{h}"), F.sort_array(F.concat(ranked, F.array(*(F.lit(m) for m in marks)))))
    for h in range(hashes):
        out = out.withColumn(w(f"m{h}"), F.array(*(F.array_position(col(f"h{h}"), F.lit(m)).cast("int") for m in marks)))

    def slot(order: Column, mark: Column) -> Column:
        # the elements that follow the mark; further ones, round the end and over other marks, where a mark is among them
        size = F.size(order)
        next_ = [F.get(order, mark + i) for i in range(tuple_size)]
        after = [F.when(size > i + 1, F.get(order, (mark + i) % size)) for i in range(tuple_size + starts - 1)]
        further = F.slice(F.filter(F.array(*after), lambda x: x.isNotNull() & ~is_mark(x)), 1, tuple_size)
        least = F.when(functools.reduce(Column.__and__, (x.isNotNull() & ~is_mark(x) for x in next_)), F.array(*next_)).otherwise(further)
        # back in text order: the place in the upper bits, 39 bits of the hash below
        turned = F.transform(least, lambda x: F.shiftleft(x.bitwiseAND(F.lit(_PLACE)), 39).bitwiseOR(F.shiftrightunsigned(x, 64 - 39)))
        hashed = F.xxhash64(F.transform(F.sort_array(turned), lambda x: x.bitwiseAND(F.lit((1 << 39) - 1))))
        return F.lpad(F.lower(F.hex(hashed.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")

    slots = [F.array_join(F.transform(col(f"m{h}"), lambda m: slot(col(f"h{h}"), m)), "") for h in range(hashes)]  # noqa: B023
    text_of = F.when(F.size(col("p")) == 0, "").otherwise(F.concat(*slots))
    return out.withColumn(into, text_of).drop(*map(w, "tsrbp"), *(w(f"{x}{h}") for x in "hm" for h in range(hashes)))


def likeness(a: Column, b: Column, slots: int = SLOTS) -> Column:
    """The share of slots in which two fingerprints agree."""
    places = F.sequence(F.lit(0), F.lit(slots - 1))
    agree = F.size(F.filter(places, lambda i: F.substr(a, i * 8 + 1, F.lit(8)) == F.substr(b, i * 8 + 1, F.lit(8))))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(agree / F.lit(float(slots)))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``doc_id, fingerprint``."""
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    return with_fingerprint(rows, F.col("text"), "fingerprint").select("doc_id", "fingerprint")


def _longs(values: list) -> Column:
    if values and isinstance(values[0], list):
        return F.expr("array(" + ", ".join(f"array({', '.join(f'{v}L' for v in x)})" for x in values) + ")")
    return F.expr("array(" + ", ".join("cast(null as bigint)" if v is None else f"{v}L" for v in values) + ")")


def _stretch(bounds: list[int], key: Column) -> Column:
    """How many of the sorted ``bounds`` are below or at the key: first among every m-th, then within m."""
    if not bounds:
        return F.lit(0)
    m = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + m] for i in range(0, len(bounds), m)]
    first = F.size(F.filter(_longs([b[0] for b in blocks]), lambda x: x <= key))
    inner = F.get(_longs(blocks), first - 1)
    return F.when(first == 0, 0).otherwise((first - 1) * m + F.size(F.filter(inner, lambda x: x <= key))).cast("int")


def with_next(rows: DataFrame, columns: list[str], stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """``doc_id, text, ...`` with ``next``: a struct of ``columns`` of the row that follows by doc_id, after the last the first.

    Keys are dealt into stretches of neighbours by bounds taken from all keys; the rows that begin a
    stretch also go, as guests, to the end of the one before. Rows move once and no task needs an order
    over everything. Among equal keys the order is that of the text's hash; null keys come first.
    """
    keys = rows.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("key"))
    n = keys.count()
    if not n:
        return rows.withColumn("next", F.struct(*(F.col(c) for c in columns)))
    wanted = min(MAX_STRETCHES, -(-n // stretch_rows))
    shares = [i / wanted for i in range(1, wanted)]
    bounds = sorted(set(keys.agg(F.percentile_approx("key", shares, 10 * wanted)).first()[0])) if shares else []
    # the least key of each stretch that has rows: MAX_STRETCHES of them at most
    least = keys.groupBy(_stretch(bounds, F.col("key")).alias("at")).agg(F.min("key").alias("key")).orderBy("at").collect()
    firsts: list = [None] * (least[-1]["at"] + 1)
    before: list = list(firsts)
    for i, r in enumerate(least):  # the last row of the stretch before is followed by this one's first
        firsts[r["at"]], before[r["at"]] = r["key"], least[i - 1]["at"]
    at = F.col("_at")
    begins = F.col("_key") == F.get(_longs(firsts), at)
    host = F.struct(F.lit(0).alias("guest"), at.cast("long").alias("at"))
    guest = F.struct(F.lit(1).alias("guest"), F.get(_longs(before), at).alias("at"))
    dealt = rows.withColumn("_key", F.coalesce("doc_id", F.lit(LOWEST))).withColumn("_tie", F.xxhash64("text")).withColumn("_at", _stretch(bounds, F.col("_key")))
    seated = dealt.withColumn("_seat", F.explode(F.when(begins, F.array(host, guest)).otherwise(F.array(host))))
    seated = seated.withColumn("_guest", F.col("_seat.guest")).withColumn("_at", F.col("_seat.at"))
    order = W.partitionBy("_at").orderBy("_guest", "_key", "_tie")
    return seated.withColumn("next", F.lead(F.struct(*(F.col(c) for c in columns))).over(order)).where("_guest = 0").drop("_key", "_tie", "_at", "_seat", "_guest")


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last quarter is the next one's beginning."""
    rows = docs.select(docs[key].alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    own = with_fingerprint(rows, F.col("text"), "fingerprint").select("doc_id", "text", "fingerprint")
    paired = with_next(own, ["text", "fingerprint"])
    n, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - quarter), F.substr(F.col("next.text"), F.lit(1), quarter))
    made = paired.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"))
    both = with_fingerprint(made, F.col("edited"), "edited_fingerprint")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
