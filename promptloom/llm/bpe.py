"""Byte-level BPE by a pair occurrence index, exact to the public tokenizer file that it is given.

A task goes through its partition in blocks. The distinct words of a block are laid out in one array
of symbols; an index maps each pair that has a rank to all its positions there. Active ranks are taken
in ascending order; each merges all its positions at once and puts the pairs that arise into the lists
of their own ranks. Words found before in the task keep their ids, up to a bound.

Defined results: a null text is an empty one, with no ids and an empty decoded text. Texts of any
length are encoded whole. Repeated rows are encoded alike, an empty table gives no rows. Lone
surrogates cannot occur in Spark strings; invalid bytes decode to U+FFFD.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import pre_tokenizers

from .common import BATCH_ROWS, ship

# The white space and the word pattern of byte-level BPE.
_WHITE = "\t-\r \x85\xa0  -     　"
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A word never goes on from a non-space to a space, so a text falls apart there.
_PIECE = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+$")
#: From here on releases of Unicode differ in what is a letter; the library's own splitter decides.
_SETTLED = 0x530
#: Characters of a block, and pieces whose ids a task remembers.
BLOCK_CHARS = 6_000_000
MEMORY_PIECES = 250_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if it is visible Latin-1, else the next from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def unsupported(spec: dict) -> list[str]:
    """What a tokenizer file asks for beyond plain byte-level BPE."""
    model, before, after = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    found = [f"model.{k}" for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    found += ["model.type"] if model.get("type", "BPE") != "BPE" else []
    found += ["normalizer"] if spec.get("normalizer") else []
    found += ["pre_tokenizer"] if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) else []
    found += ["decoder"] if after.get("type") != "ByteLevel" else []
    return found + [f"added_tokens.{k}" for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]


class Codec:
    """A byte-level BPE vocabulary of the ``tokenizers`` JSON format; a file that asks for more is refused."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        if more := unsupported(spec):
            raise ValueError(f"not plain byte-level BPE: {', '.join(more)}")
        vocab, merges = spec["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        symbols = byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.of_byte = np.array([vocab[c] for c in symbols], np.int32)
        self.base = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * self.base
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.parts = np.array([(vocab[a], vocab[b]) for a, b in merges], np.int32).reshape(-1, 2)
        keys = self.parts[:, 0].astype(np.int64) * self.base + self.parts[:, 1]
        # an open-addressing table of pair -> rank
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 4 + 1))))
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, -1, np.int32)
        self.probes = 1
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            step = 1
            while self.slots[at] >= 0 and self.slots[at] != key:
                at = (at + 1) & ((1 << self.bits) - 1)
                step += 1
            if self.slots[at] != key:
                self.slots[at], self.slot_rank[at] = key, rank
                self.probes = max(self.probes, step)
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.word = regex.compile(_WORD)
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none."""
        keys = left.astype(np.int64) * self.base + right
        at = self._slot(keys)
        out = np.full(len(keys), -1, np.int32)
        found = self.slots[at]
        out = np.where(found == keys, self.slot_rank[at], np.int32(-1))
        todo = np.flatnonzero((found != keys) & (found >= 0))
        for _ in range(1, self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.slots[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.slot_rank[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out

    def words(self, piece: str) -> list[bytes]:
        """The words of a piece, in UTF-8."""
        if piece.isascii() or max(piece) < chr(_SETTLED):
            return [w.encode() for w in self.word.findall(piece)]
        return [piece[a:b].encode() for _, (a, b) in self.library.pre_tokenize_str(piece)]

    def merge(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words that begin in ``data`` at ``starts``; how many ids each byte stands for (0 or 1)."""
        n = len(data)
        sym = self.of_byte[np.frombuffer(data, np.uint8)]
        following = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[starts] = -1
        following[starts[1:] - 1] = -1
        following[n - 1] = -1
        at = np.flatnonzero(following >= 0).astype(np.int32)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(ranks: np.ndarray, places: np.ndarray) -> None:
            known = ranks >= 0
            ranks, places = ranks[known], places[known]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            begins = [0, *cuts.tolist()]
            for r, a, b in zip(ranks[begins].tolist(), begins, [*begins[1:], len(ranks)]):
                if r in index:
                    index[r].append(places[a:b])
                else:
                    index[r] = [places[a:b]]
                    heapq.heappush(heap, r)

        enter(self.ranks(sym[at], sym[at + 1]), at)
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            a, b = self.parts[rank]
            p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            p = p[sym[p] == a]
            q = following[p]
            p, q = p[q >= 0], q[q >= 0]
            good = sym[q] == b
            p, q = p[good], q[good]
            if not len(p):
                continue
            if a == b:  # of overlapping positions the left one goes first
                taken: set[int] = set()
                keep = []
                for i, (x, y) in enumerate(zip(p.tolist(), q.tolist())):
                    if x not in taken:
                        taken.add(y)
                        keep.append(i)
                p, q = p[keep], q[keep]
            sym[p] = self.made[rank]
            sym[q] = -1
            after = following[q]
            following[p] = after
            inner = after >= 0
            before[after[inner]] = p[inner]
            left = before[p]
            left = left[left >= 0]
            places = np.concatenate([left, p[inner]])
            if len(places):
                enter(self.ranks(sym[places], sym[following[places]]), places)
        live = sym >= 0
        return sym[live], live

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after another, and where each piece's begin (with the end)."""
        words = [self.words(p) for p in pieces]
        data = b"".join(w for ws in words for w in ws)
        sizes = np.array([len(w) for ws in words for w in ws], np.int64)
        starts = np.cumsum(sizes) - sizes
        ids, live = self.merge(data, starts)
        ends = np.cumsum([sum(map(len, ws)) for ws in words])
        counts = np.concatenate([[0], np.cumsum(live)])
        return ids, np.concatenate([[0], counts[ends]])

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


class _Pieces(dict):
    """Piece -> number, given in order of appearance."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class BlockEncoder:
    """Encodes blocks of texts; what it knows of pieces stays for the blocks that follow."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.forget()

    def forget(self) -> None:
        self.pieces = _Pieces()
        self.ids = np.zeros(0, np.int32)
        self.begins = np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        codec = self.codec
        if len(self.pieces) > MEMORY_PIECES:
            self.forget()
        known = len(self.pieces)
        number = self.pieces.__getitem__
        laid: list[np.ndarray] = []
        for text in texts:
            parts = [text] if codec.split_special is None else codec.split_special.split(text)
            numbers: list[np.ndarray] = []
            for i, part in enumerate(parts):
                if i % 2:  # a special token: below zero
                    numbers.append(np.array([-1 - codec.special[part]], np.int64))
                elif part:
                    found = _PIECE.findall(part)
                    numbers.append(np.fromiter(map(number, found), np.int64, len(found)))
            laid.append(np.concatenate(numbers).astype(np.int32) if numbers else np.zeros(0, np.int32))
        if len(self.pieces) > known:
            fresh = list(self.pieces)[known:]
            ids, begins = codec.encode_pieces(fresh)
            self.begins = np.concatenate([self.begins, begins[1:] + self.begins[-1]])
            self.ids = np.concatenate([self.ids, ids])
        sizes = np.diff(self.begins)
        for numbers in laid:
            special = numbers < 0
            inside = np.where(special, 0, numbers)
            if not len(numbers):
                yield np.zeros(0, np.int32)
                continue
            if not len(sizes):  # special tokens only
                yield (-1 - numbers).astype(np.int32)
                continue
            length = np.where(special, 1, sizes[inside])
            end = np.cumsum(length)
            source = np.arange(end[-1]) + np.repeat(np.where(special, 0, self.begins[inside]) - (end - length), length)
            if special.any():
                owner = np.repeat(special, length)
                source[owner] = 0
                out = self.ids[source]
                out[owner] = -1 - numbers[special]
                yield out
            else:
                yield self.ids[source]


_codecs: dict[str, BlockEncoder] = {}


def _encoder(raw: bytes) -> BlockEncoder:
    """One encoder a worker and vocabulary."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = BlockEncoder(Codec(raw))
    return _codecs[key]


def map_ids(df: DataFrame, vocabulary: str, adds: T.StructType, row: Callable[[str, np.ndarray, Codec], tuple], keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of ``df`` and what ``row(text, ids, codec)`` gives for each whole text.

    ``vocabulary`` is the path of a tokenizer file on the driver. The file (its size is fixed, some
    1.5 MB) is broadcast, so that executors need no such path.
    """
    spark = df.sparkSession
    ship(spark)
    shipped = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    schema = T.StructType([*(df.schema[c] for c in keep), *adds.fields])
    arrow = to_arrow_schema(schema)

    def blocks(batches):
        held, chars = [], 0
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            held.append((batch, texts))
            chars += sum(map(len, texts))
            if chars >= BLOCK_CHARS:
                yield held
                held, chars = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value)
        for held in blocks(batches):
            encoded = encoder.encode([t for _, texts in held for t in texts])
            for batch, texts in held:
                rows = [row(t, next(encoded), encoder.codec) for t in texts]
                made = [pa.array([r[i] for r in rows], type=arrow.field(f.name).type) for i, f in enumerate(adds.fields)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(arrow.field(c).type) for c in keep), *made], schema=arrow)

    return df.mapInArrow(run, schema)


def encode_ids(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The token ids themselves: one row a document, ``doc_id, ids``."""
    rows = df.select(df[key].alias("doc_id"), df[text].alias("text"))
    return map_ids(rows, vocabulary, T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False))]), lambda t, ids, c: (ids.tolist(),), ["doc_id"])


def decode_ids(df: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Texts of id lists: ``doc_id, text``; null lists give empty texts."""
    spark = df.sparkSession
    ship(spark)
    shipped = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())
    rows = df.select(df[key].alias("doc_id"), df[ids].alias("ids"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        codec = _encoder(shipped.value).codec
        for batch in batches:
            texts = [codec.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(arrow.field("doc_id").type), pa.array(texts, pa.string())], schema=arrow)

    return rows.mapInArrow(run, schema)


DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def digest_row(text: str, ids: np.ndarray, codec: Codec) -> tuple:
    return (
        len(ids),
        hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
        hashlib.sha256(codec.decode(ids).encode()).hexdigest(),
    )


def encode_digests(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids again, and return digests of both."""
    rows = df.select(df[key].alias("doc_id"), df[text].alias("text"))
    return map_ids(rows, vocabulary, DIGEST, digest_row, ["doc_id"])
