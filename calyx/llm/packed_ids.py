"""Token ids of documents in a patched frame-of-reference file format.

A segment is a self-contained image of whole documents' ids:

    header   "PFOR", u32 number of blocks, u64 number of ids
    index    for each block: u64 first id's place in the segment, u64 byte offset
    block    u32 minimum, u8 width, u32 ids, u32 exceptions; the ids less the
             minimum, packed at `width` bits; places (u32) and values (u32) of
             the exceptions

The width fits PERCENTILE of a block's ids; those beyond it go to the exception
list.  Segments end with a document, after SEGMENT_IDS ids or more, so that
each is read alone.  They are stored as rows of a Parquet table, because only
Spark's own writers reach every store a cluster may use: shard, segment, start
(in the shard), n_ids, doc_ids, doc_lengths, payload.  Shards are ranges of
ascending doc_id, so shard order and start give the place of every id.

Documents are in ascending doc_id order, null ids first; rows with one id are
ordered by a hash of their text.  A null text counts as empty: its end id alone.
An empty table writes no segment.  Further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calyx.llm.common import row_slices, scratch_path, spread_parts

BLOCK_IDS = 4096
SEGMENT_IDS = 1 << 18
PERCENTILE = 90
END_ID = 0
MAGIC = b"PFOR"
#: Entries after which a worker's memo of encoded units starts anew; a matter of memory, not of results.
MEMO_ENTRIES = 1_000_000
#: Distinct units encoded as one text.
JOINED = 128


# ---- encoding ---------------------------------------------------------------

_LONE = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: White space other than space and line feed, as a character class.
_OTHER = re.compile(r"[^\S \n]")


def is_plain(text: str) -> bool:
    """Whether all white space of a text is lone spaces and line feeds between visible characters."""
    return bool(text) and not (text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text
                               or "\n\n" in text or _OTHER.search(text))


def units_of(text: str) -> list[str]:
    """A text cut before every lone space or line feed between visible characters.

    A byte-level pre-tokenizer always starts a pre-token there, so the ids of a text are those of its units in a row.
    """
    if not is_plain(text):
        return _LONE.split(text)
    first, *rest = text.replace("\n", " \n").split(" ")
    return [first, *(u if u[:1] == "\n" else " " + u for u in rest)]


class UnitEncoder:
    """tokenizers' ids of distinct units, with a memo."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Ids (4 bytes each) of whole units, and of the units of plain texts, there without their leading space.
        self.memo: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splitter = spec.get("pre_tokenizer") or {}
        #: Whether a text's ids are its units' ids; otherwise whole texts are encoded.
        self.by_unit = (spec.get("normalizer") is None and splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True)
                        and not splitter.get("add_prefix_space", True)
                        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])
                                    for t in spec.get("added_tokens", [])))
        gap = {self.tokenizer.encode(c, add_special_tokens=False).tokens[0] for c in " \n"}
        vocab = self.tokenizer.get_vocab()
        #: Whether a token begins with a space or a line feed.
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for t, i in vocab.items() if t[:1] in gap]] = True

    def _learn(self, units: list[str]) -> None:
        found = self.tokenizer.encode_batch_fast(units, add_special_tokens=False)
        self.memo.update((u, np.array(e.ids, "<u4").tobytes()) for u, e in zip(units, found, strict=True))

    def _learn_plain(self, units: list[str]) -> None:
        """Ids of units with one space or line feed, in front: many are encoded as one text, whose tokens that begin with
        such a character are the units' first ones."""
        for lo in range(0, len(units), JOINED):
            part = units[lo:lo + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(u if u[0] == "\n" else " " + u for u in part)], add_special_tokens=False)[0].ids, "<u4")
            edge = np.flatnonzero(self.begins[ids])
            if len(edge) != len(part):
                raise ValueError("a unit's first token doesn't begin with its white space")
            raw, edge = ids.tobytes(), [*(4 * edge).tolist(), 4 * len(ids)]
            self.plain.update(zip(part, (raw[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        easy = [self.by_unit and is_plain(t) for t in texts]
        split = [[] if e else units_of(t) if self.by_unit else [t] for t, e in zip(texts, easy, strict=True)]
        plain = [t for t, e in zip(texts, easy, strict=True) if e]
        words = pc.split_pattern(pc.replace_substring(pa.array(plain, pa.large_string()), "\n", " \n"), " ")
        edges = words.offsets.to_numpy()
        named = pc.dictionary_encode(words.flatten())
        place, later = named.indices.to_numpy().copy(), np.ones(len(named), bool)
        later[edges[:-1]] = False  # a text's first unit has no white space in front
        leads = _strings(named.dictionary.take(named.indices.filter(pa.array(~later))))
        used = np.zeros(len(named.dictionary), bool)
        used[place[later]] = True
        kept = _strings(named.dictionary.filter(pa.array(used)))
        whole = {u for units in split for u in units}.union(leads)
        new, more = whole.difference(self.memo), [u for u in kept if u not in self.plain]
        if len(self.memo) + len(self.plain) + len(new) + len(more) > MEMO_ENTRIES:
            self.memo.clear()
            self.plain.clear()
            new, more = whole, kept
        if new:
            self._learn(list(new))
        if more:
            self._learn_plain(more)
        memo = self.memo
        place[later] = (np.cumsum(used) - 1)[place[later]]
        place[~later] = len(kept) + np.arange(len(leads))
        found = iter(_gathered([*map(self.plain.__getitem__, kept), *map(memo.__getitem__, leads)], place, edges))
        return [next(found) if e else b"".join(map(memo.__getitem__, units)) for units, e in zip(split, easy, strict=True)]


def _strings(column: pa.Array) -> list[str]:
    """As to_pylist, which makes an object of Arrow's for each value first."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _gathered(parts: list[bytes], place: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """For each run edges[i]..edges[i + 1] of `place`: the parts (4 bytes an id) that it names, in a row."""
    ids = np.frombuffer(b"".join(parts), "<u4")
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    start = np.cumsum(size) - size
    n = size[place]
    end = np.cumsum(n)
    at = np.repeat(start[place] - (end - n), n)
    at += np.arange(len(at))
    raw, cut = ids[at].tobytes(), (4 * np.r_[0, end][edges]).tolist()
    return [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


_ENCODERS: dict[str, UnitEncoder] = {}


def unit_encoder(path: str) -> UnitEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


# ---- blocks and segments ----------------------------------------------------

def pack_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    above = (ids - low).astype(np.uint32)
    width = int(np.percentile(above, PERCENTILE, method="higher")).bit_length()
    beyond = np.flatnonzero(above >= (1 << width))
    values = above[beyond]
    above[beyond] = 0
    bits = (above[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    packed = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    return (struct.pack("<IBII", low, width, len(ids), len(beyond)) + packed
            + beyond.astype("<u4").tobytes() + values.astype("<u4").tobytes())


def unpack_block(data: memoryview) -> np.ndarray:
    low, width, n, beyond = struct.unpack_from("<IBII", data)
    at, size = 13, (n * width + 7) // 8
    out = np.zeros(n, np.uint32)
    if width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
        out = bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))
    if beyond:
        out[np.frombuffer(data, "<u4", beyond, at + size)] = np.frombuffer(data, "<u4", beyond, at + size + 4 * beyond)
    return out + np.uint32(low)


def pack_segment(ids: np.ndarray) -> bytes:
    starts = range(0, len(ids), BLOCK_IDS)
    blocks = [pack_block(ids[s:s + BLOCK_IDS]) for s in starts]
    index, offset = [], 16 + 16 * len(blocks)
    for s, b in zip(starts, blocks, strict=True):
        index.append(struct.pack("<QQ", s, offset))
        offset += len(b)
    return b"".join([MAGIC, struct.pack("<IQ", len(blocks), len(ids)), *index, *blocks])


def unpack_segment(data: bytes, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Ids lo..hi of a segment; the index finds the blocks, others stay packed."""
    if data[:4] != MAGIC:
        raise ValueError("not a packed segment")
    blocks, n = struct.unpack_from("<IQ", data, 4)
    hi = n if hi is None else min(hi, n)
    index = np.frombuffer(data, "<u8", 2 * blocks, 16).reshape(blocks, 2)
    if hi <= lo:
        return np.zeros(0, np.uint32)
    first, last = (int(np.searchsorted(index[:, 0], x, "right")) - 1 for x in (lo, hi - 1))
    view = memoryview(data)
    found = np.concatenate([unpack_block(view[int(index[b, 1]):]) for b in range(first, last + 1)])
    begin = int(index[first, 0])
    return found[lo - begin:hi - begin]


# ---- jobs -------------------------------------------------------------------

def write_packed(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append END_ID, and write the ids in ascending id order to a table of segments at `path`."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    arrow_kind = rows.select("id").limit(0).toArrow().schema.field("id").type
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = unit_encoder(tokenizer_path), TaskContext.get().partitionId()
        number, start, size, held, names, lengths = 0, 0, 0, [], [], []

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()),
                 pa.array([len(ids)], pa.int64()), pa.array([names], pa.list_(arrow_kind)),
                 pa.array([lengths], pa.list_(pa.int64())), pa.array([pack_segment(ids)], pa.binary())],
                names=["shard", "segment", "start", "n_ids", "doc_ids", "doc_lengths", "payload"])

        for batch in batches:
            for piece in row_slices(batch, "text"):
                encoded = enc.encode([t or "" for t in piece.column("text").to_pylist()])
                for name, ids in zip(piece.column("id").to_pylist(), encoded, strict=True):
                    held.append(ids + end)
                    names.append(name)
                    lengths.append(len(held[-1]) // 4)
                    size += lengths[-1]
                    if size >= SEGMENT_IDS:
                        yield segment()
                        number, start, size = number + 1, start + size, 0
                        held, names, lengths = [], [], []
        if held:
            yield segment()

    dealt = (rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(spread_parts(docs.sparkSession), "id", "tie")
             .sortWithinPartitions("id", "tie").select("id", "text"))
    dealt.mapInArrow(run, "shard int, segment int, start long, n_ids long, "
                          f"doc_ids array<{kind}>, doc_lengths array<long>, payload binary").write.parquet(path)



def shard_starts(segments: DataFrame) -> DataFrame:
    """Per shard: ids of all shards before it.  One row for each shard, and there are as many shards as partitions written."""
    before = Window.partitionBy().orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (segments.groupBy("shard").agg(F.sum("n_ids").alias("in_shard"))
            .select(F.col("shard"), F.coalesce(F.sum("in_shard").over(before), F.lit(0)).alias("base")))


def read_documents(segments: DataFrame, digests: bool = False) -> DataFrame:
    """Per document: doc_id, start, n_tokens, and its ids, or with `digests` their CRC-32."""
    kind = dict(segments.dtypes)["doc_ids"][len("array<"):-1]
    last = "ids_crc32" if digests else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                raw = unpack_segment(row.column("payload")[0].as_py()).astype("<u4")
                lengths = row.column("doc_lengths").flatten().to_numpy(zero_copy_only=False)
                edges = np.r_[0, np.cumsum(lengths)]
                cut = [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                ids = (pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64()) if digests
                       else pa.array([x.astype("<i4") for x in cut], pa.list_(pa.int32())))
                n = len(cut)
                yield pa.RecordBatch.from_arrays(
                    [row.column("doc_ids").flatten(), pa.array(np.full(n, row.column("shard")[0].as_py()), pa.int32()),
                     pa.array(edges[:-1] + row.column("start")[0].as_py(), pa.int64()), pa.array(lengths, pa.int64()), ids],
                    names=["doc_id", "shard", "start", "n_tokens", last])

    docs = segments.mapInArrow(run, f"doc_id {kind}, shard int, start long, n_tokens long, "
                                    + ("ids_crc32 long" if digests else "ids array<int>"))
    return (docs.join(F.broadcast(shard_starts(segments)), "shard")
            .select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", last))


def read_range(segments: DataFrame, lo: int, hi: int) -> DataFrame:
    """Ids lo..hi of the whole stream as (start, ids) rows: only segments that overlap are decoded, and of them only the blocks."""
    placed = (segments.join(F.broadcast(shard_starts(segments)), "shard").withColumn("first", F.col("base") + F.col("start"))
              .where((F.col("first") < hi) & (F.col("first") + F.col("n_ids") > lo)).select("first", "n_ids", "payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, payload in zip(*(batch.column(k).to_pylist() for k in ("first", "n_ids", "payload")), strict=True):
                a, b = max(lo - first, 0), min(hi - first, n)
                ids = unpack_segment(payload, a, b).astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array([first + a], pa.int64()), pa.array([ids], pa.list_(pa.int32()))],
                                                 names=["start", "ids"])

    return placed.mapInArrow(run, "start long, ids array<int>")


def packed_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write `docs` to a fresh table in the shared folder and read it back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = scratch_path(spark, "packed-ids")
    write_packed(docs, path, tokenizer_path)
    return read_documents(spark.read.parquet(path), digests=True)
