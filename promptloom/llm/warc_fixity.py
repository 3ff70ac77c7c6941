"""WARC fixity audit by Merkle trees.

Records are laid into archives in key order; each is hashed where it lies. Over the slots of an archive
stands a tree: a leaf is the digest of a record's bytes; a node hashes, in order, the slots, lengths and digests below
it, so that the offset range of each part within the node is part of its digest. Two replicas are
compared at their roots; only under roots that differ are the next nodes compared, and so on down to
the records that were altered, lost or added, with the bytes of the archive where they belong. Each level is made
once from the one below and kept; what differs at a level is a small table of its own.

A slot is a matter of the key, not of what comes before it, so that one lost record does not shift the
others into differing. Records read from files also have their place there: the root of an archive covers
the order of its slots by place, and an audit ranks the slots that both replicas have by place, so that
a record that is whole but stands elsewhere among the others is found (``moved``). Records of a table
stand in slot order. Records that share a key have the place of their first, their order is not compared.

Defined results: null addresses and bodies are empty ones. A null key is laid into archive -1, slot 0.
Records that share a key share a slot, whose digest is of all of them together; it is made by sums,
so a key that occurs very often is never gathered. Empty tables have no damage; against an empty
replica every record is lost.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, ship

SLOTS = 4096
FANOUT = 8
LEVELS = 4  # FANOUT ** LEVELS is SLOTS
_CRLF = "\r\n"


def record(key: Column, url: Column, body: Column) -> Column:
    """A WARC resource record as text, without the two line ends that close it."""
    parts = [
        "WARC/1.1" + _CRLF + "WARC-Type: resource" + _CRLF + "WARC-Record-ID: <urn:page:", key, ">" + _CRLF + "WARC-Target-URI: ", url,
        _CRLF + "Content-Type: text/html" + _CRLF + "Content-Length: ", F.octet_length(body), _CRLF + _CRLF, body,
    ]
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def records(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """``archive, slot, page_id, record``: where each page is laid, and its record."""
    at = F.coalesce(pages[key], F.lit(-SLOTS)).cast("long")
    text = lambda c: F.coalesce(pages[c].cast("string"), F.lit(""))
    return pages.select(
        F.floor(at / F.lit(SLOTS)).cast("long").alias("archive"), F.pmod(at, F.lit(SLOTS)).cast("int").alias("slot"), pages[key].alias("page_id"),
        record(F.coalesce(pages[key].cast("string"), F.lit("")), text(url), text(body)).alias("record"),
    )


def write_archives(rows: DataFrame, folder: str) -> None:
    """Write ``records()`` as WARC files, one folder an archive, records in slot order."""
    ordered = rows.repartition("archive").sortWithinPartitions("archive", "slot", "record")
    ordered.select("archive", "record").write.option("lineSep", _CRLF * 2).partitionBy("archive").mode("overwrite").text(folder)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``archive, slot, page_id, record, file, start`` from WARC files: the record's own bytes and its place.

    A record whose length or head is broken keeps its bytes, and has the key it names.
    """

    ship(spark)

    def parse(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for archive, file, content in zip(batch["archive"], batch["file"], batch["content"]):
                start = 0
                for body in split_records(bytes(content)):
                    name = body.partition(b"<urn:page:")[2].partition(b">")[0]
                    page = int(name) if name.lstrip(b"-").isdigit() else None
                    at = -SLOTS if page is None else page
                    rows.append((archive, at % SLOTS, page, body, file, start))
                    start += len(body) + 4
            yield pd.DataFrame(rows, columns=["archive", "slot", "page_id", "record", "file", "start"]).astype({"page_id": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt*").load(folder)
    named = files.select(F.regexp_extract("path", r"archive=(-?\d+)", 1).cast("long").alias("archive"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "content")
    schema = T.StructType([T.StructField("archive", T.LongType()), T.StructField("slot", T.IntegerType()), T.StructField("page_id", T.LongType()), T.StructField("record", T.BinaryType()), T.StructField("file", T.StringType()), T.StructField("start", T.LongType())])
    return named.mapInPandas(parse, schema)


def split_records(data: bytes) -> list[bytes]:
    """The records of a WARC file without their closing line ends, by their stated lengths; where a length is broken, up to the next head."""
    out, at, close = [], 0, b"\r\n\r\n"
    while at < len(data):
        head = data.find(close, at)
        length = re.search(rb"\r\nContent-Length: ([0-9]{1,15})(?:\r\n|\Z)", data[at:head]) if head >= 0 else None
        end = head + 4 + int(length[1]) if length else -1
        if end < 0 or data[end : end + 4] != close:
            following = data.find(close + b"WARC/1.1\r\n", at)
            end = following if following >= 0 else len(data.removesuffix(close))
        out.append(data[at:end])
        at = max(end, at) + 4
    return out


def leaves(rows: DataFrame) -> DataFrame:
    """One row a slot: digest, records, bytes, key and offset range, and its place where the rows have one."""
    placed = [c for c in ("file", "start") if c in rows.columns]
    hashed = rows.select("archive", "slot", "page_id", F.sha2("record", 256).alias("sha"), (F.octet_length("record") + 4).cast("long").alias("size"), *placed)
    half = lambda i: F.conv(F.substring("sha", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    slots = hashed.groupBy("archive", "slot").agg(
        F.count("*").alias("records"), F.sum("size").alias("size"), F.min("page_id").alias("page_id"), F.min("sha").alias("sha"),
        *(F.sum(half(i)).alias(f"s{i}") for i in range(4)),
        *([F.min(F.struct("file", "start")).alias("place"), F.max(F.struct("file", F.col("start") + F.col("size"))).alias("until")] if placed else []),
    )
    digest = F.when(F.col("records") == 1, F.col("sha")).otherwise(F.sha2(F.concat_ws(":", "records", *(f"s{i}" for i in range(4))), 256))
    if placed:
        return slots.select("archive", "slot", "page_id", "records", digest.alias("digest"), F.col("place.start").alias("start_offset"), F.col("until.col2").alias("end_offset"), "place")
    end = F.sum("size").over(W.partitionBy("archive").orderBy("slot"))
    return slots.select("archive", "slot", "page_id", "records", digest.alias("digest"), (end - F.col("size")).alias("start_offset"), end.alias("end_offset"))


def levels(leaf: DataFrame) -> list[DataFrame]:
    """The tree from the leaves up: ``archive, node, digest, size`` and the offset range of each level's nodes."""
    rows = leaf.select("archive", F.col("slot").alias("node"), "page_id", "digest", (F.col("end_offset") - F.col("start_offset")).alias("size"), "start_offset", "end_offset")
    out = [rows]
    for _ in range(LEVELS):
        parent = F.shiftright("node", FANOUT.bit_length() - 1)
        below = F.array_sort(F.collect_list(F.struct("node", "size", "digest")))  # FANOUT entries at most
        joined = F.array_join(F.transform(below, lambda x: F.concat_ws(":", x["node"], x["size"], x["digest"])), ",")
        made = rows.groupBy("archive", parent.alias("parent")).agg(
            F.sha2(joined, 256).alias("digest"), F.sum("size").alias("size"), F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"),
        )
        rows = cut(made.withColumnRenamed("parent", "node"))
        out.append(rows)
    return out


def _place(leaf: DataFrame) -> Column:
    """What puts the slots of an archive in order."""
    return F.col("place") if "place" in leaf.columns else F.struct(F.lit("").alias("file"), F.col("slot").cast("long").alias("start"))


def moved(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """``archive, slot`` of leaves that stand elsewhere among those that both sides have; an archive has ``SLOTS`` at most."""
    one, other = (x.select("archive", "slot", _place(x).alias(n)) for n, x in (("p_place", primary), ("r_place", replica)))
    rank = lambda c: F.row_number().over(W.partitionBy("archive").orderBy(c, "slot"))
    return one.join(other, ["archive", "slot"]).withColumn("p", rank("p_place")).withColumn("r", rank("r_place")).where("p <> r").select("archive", "slot")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Compare two sets of ``records()``: one row for each slot that differs.

    Columns: archive, slot, page_id, verdict (altered, lost, added, moved), the offset range in the archive
    that holds it (the primary's, or the replica's for what was added), and both digests.
    """
    sides = [cut(leaves(x)) for x in (primary, replica)]
    trees = [levels(s) for s in sides]
    differing = None
    for up in range(LEVELS, -1, -1):
        one, other = (t[up].drop("size") for t in trees)
        if differing is not None:  # descend below nodes that differ only
            parent = (F.col("archive") == F.col("a")) & (F.shiftright("node", FANOUT.bit_length() - 1) == F.col("n"))
            one, other = (x.join(differing, parent, "left_semi") for x in (one, other))
        p, r = (x.select(F.col("archive").alias(f"{n}_archive"), F.col("node").alias(f"{n}_node"), F.struct(*(c for c in x.columns if c not in ("archive", "node"))).alias(n)) for n, x in (("p", one), ("r", other)))
        met = p.join(r, (F.col("p_archive") == F.col("r_archive")) & (F.col("p_node") == F.col("r_node")), "full_outer")
        met = met.where(~F.col("p.digest").eqNullSafe(F.col("r.digest"))).withColumn("archive", F.coalesce("p_archive", "r_archive")).withColumn("node", F.coalesce("p_node", "r_node"))
        if up:
            differing = cut(met.select(F.col("archive").alias("a"), F.col("node").alias("n")))
    either = lambda c: F.coalesce(F.col(f"p.{c}"), F.col(f"r.{c}")).alias(c)
    verdict = F.when(F.col("r.digest").isNull(), "lost").when(F.col("p.digest").isNull(), "added").otherwise("altered")
    found = met.select(
        "archive", F.col("node").alias("slot"), either("page_id"), verdict.alias("verdict"), either("start_offset"), either("end_offset"),
        F.col("p.digest").alias("primary_sha256"), F.col("r.digest").alias("replica_sha256"),
    )
    if not any("place" in s.columns for s in sides):  # both in slot order
        return found
    same = sides[0].join(moved(*sides), ["archive", "slot"], "left_semi").join(sides[1].select("archive", "slot", F.col("digest").alias("other")), ["archive", "slot"])
    whole = same.where("digest = other").select("archive", "slot", "page_id", F.lit("moved").alias("verdict"), "start_offset", "end_offset", F.col("digest").alias("primary_sha256"), F.col("other").alias("replica_sha256"))
    return found.unionByName(whole)


def roots(rows: DataFrame) -> DataFrame:
    """``archive, digest`` and the bytes of each archive; the digest covers the tree and the order of the slots."""
    leaf = leaves(rows)
    order = F.transform(F.sort_array(F.collect_list(F.struct(_place(leaf).alias("place"), "slot"))), lambda x: x["slot"])  # SLOTS entries at most
    orders = leaf.groupBy("archive").agg(F.array_join(order, ",").alias("order"))
    return levels(leaf)[LEVELS].join(orders, "archive").select("archive", F.sha2(F.concat_ws(";", "digest", "order"), 256).alias("digest"), F.col("end_offset").alias("bytes"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica for trials: some pages lost, some with a byte overwritten, by a rule on the key."""
    k = F.col("page_id")
    middle = F.floor(F.length("html") / 2).cast("int")
    struck = F.concat(F.substr("html", F.lit(1), middle), F.lit("#"), F.substr("html", middle + 2))
    kept = pages.where(~F.coalesce(F.pmod(k * 7919, F.lit(211)) == 5, F.lit(False)))
    return kept.withColumn("html", F.when(F.pmod(k * 7919, F.lit(101)) == 7, struck).otherwise(F.col("html")))


AUDIT_SQL = """
with primary_pages as (
    select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages
), replica_pages as (
    select page_id, url, case when (page_id * 7919) % 101 = 7 and length(html) > 0
        then left(html, length(html) // 2) || '#' || substr(html, length(html) // 2 + 2) else html end as html
    from primary_pages where (page_id * 7919) % 211 <> 5
), both_pages as (
    select 'p' as side, * from primary_pages union all select 'r', * from replica_pages
), laid as (
    select side, page_id, page_id // 4096 as archive, cast(page_id % 4096 as integer) as slot,
        'WARC/1.1' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e
        || 'WARC-Target-URI: ' || url || e || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(html) || e || e || html as record
    from both_pages, (select chr(13) || chr(10) as e)
), hashed as (
    select side, page_id, archive, slot, sha256(record) as digest,
        cast(sum(strlen(record) + 4) over (partition by side, archive order by slot) as bigint) as end_offset, strlen(record) + 4 as size
    from laid
)
select p.archive, p.slot, p.page_id, case when r.digest is null then 'lost' else 'altered' end as verdict,
    p.end_offset - p.size as start_offset, p.end_offset, p.digest as primary_sha256, r.digest as replica_sha256
from (select * from hashed where side = 'p') p
left join (select * from hashed where side = 'r') r on p.page_id = r.page_id
where r.digest is null or r.digest <> p.digest
"""
