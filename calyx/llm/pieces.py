"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs in score order (ties: the
leftmost pair first) and always merges its head, as the library does.  No piece
of a vocabulary accepted here has the space mark behind another character, or a
line feed beside another one, so no merge crosses those places: a text falls
apart into units, and equal units have equal ids.  The agendas of short units
that a batch brings anew are held in flat arrays and advance together; each
round merges the head of every unit's agenda.  A long unit has a heap of its own
over a linked list of symbols.  The ids of these new units are checked, portion by
portion, against the sentencepiece library, and a difference raises an error.  Ids are decoded by the library's decode().

Null texts count as empty: the begin and the end id alone, decoded to ''.
Repeated rows and null ids are kept; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calyx.llm.common import row_slices

MARK = "▁"
#: Entries after which a worker's memo of units starts anew; a matter of memory, not of results.
MEMO_ENTRIES = 500_000

#: Text handled at once, and characters of new units whose agendas advance together.
SLICE, PORTION = 1 << 20, 1 << 17
#: Characters from which a unit has an agenda of its own.
LONG = 48

_MODELS: dict[str, "MergeModel"] = {}


class MergeModel:
    """Merge table of a BPE sentencepiece model, as sorted arrays."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        normal = {sp.id_to_piece(i): i for i in range(n)
                  if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not sp.is_byte(i) for i in self.bytes):
            raise ValueError(f"{path}: a vocabulary with byte fallback is needed")
        if any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in normal):
            raise ValueError(f"{path}: pieces cross word or line starts")
        if sp.encode("a  b") != sp.encode("a  b ")[:-1] or sp.decode(sp.encode(" ①ﬁé")) != " ①ﬁé":
            raise ValueError(f"{path}: its text normalisation is not the identity")
        self.normal = normal
        # A single character that is no piece still stands as a symbol; such symbols get ids from n up and never merge.
        pairs = {}
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                a, b = normal.get(a), normal.get(b)
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        # Place of a piece in descending order of score: the agenda's order.
        score = np.array([sp.get_score(i) for i in range(n)])
        self.place = np.empty(n, np.int64)
        distinct = np.unique(-score)
        self.place[:] = np.searchsorted(distinct, -score)
        self.pairs = pairs
        # Symbol of each character: its piece, or -1 less its number, which is in no pair.
        self.symbol = -1 - np.arange(0x110000, dtype=np.int64)
        for piece, i in normal.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of the piece that each adjacent pair makes, or -1."""
        if not len(self.keys):
            return np.full(len(a), -1, np.int64)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.made[at], -1)

    def pairs_at(self, symbol: np.ndarray, unit: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Id of the piece made by the symbol at each place and the next one of its unit, or -1."""
        after = np.minimum(at + 1, len(symbol) - 1)
        return np.where((unit[at] == unit[after]) & (after > at), self.pair(symbol[at], symbol[after]), -1)

    def merge(self, units: list[str]) -> list[bytes]:
        """Ids of each unit (already marked, no begin or end id) as little-endian unsigned 32-bit integers."""
        found = [b""] * len(units)
        portion, size = [], 0
        for i, u in enumerate(units):
            if len(u) >= LONG:
                found[i] = np.array(self.merge_long(u), "<u4").tobytes()
                continue
            portion.append(i)
            size += len(u)
            if size >= PORTION:
                for j, ids in zip(portion, self.merge_short([units[j] for j in portion]), strict=True):
                    found[j] = ids
                portion, size = [], 0
        for j, ids in zip(portion, self.merge_short([units[j] for j in portion]), strict=True):
            found[j] = ids
        return found

    def merge_long(self, unit: str) -> list[int]:
        """Ids of one unit: a heap of (place, where) over a linked list of symbols.  Entries whose pair has changed
        meanwhile are passed over."""
        symbol = [self.normal.get(c, -1) for c in unit]
        n, pairs, place = len(unit), self.pairs, self.place
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(at: int) -> None:
            to = after[at]
            if to >= 0 and symbol[at] >= 0 and symbol[to] >= 0:
                made = pairs.get(symbol[at] << 32 | symbol[to])
                if made is not None:
                    heapq.heappush(heap, (int(place[made]), at, made, symbol[at], symbol[to]))

        for at in range(n - 1):
            offer(at)
        gone = bytearray(n)
        while heap:
            _, at, made, left, right = heapq.heappop(heap)
            to = after[at]
            if gone[at] or to < 0 or symbol[at] != left or symbol[to] != right:
                continue
            symbol[at], after[at] = made, after[to]
            gone[to] = 1
            if after[to] >= 0:
                before[after[to]] = at
            offer(at)
            if before[at] >= 0:
                offer(before[at])
        out: list[int] = []
        for at in range(n):
            if not gone[at]:
                out += [symbol[at]] if symbol[at] >= 0 else [self.bytes[b] for b in unit[at].encode()]
        return out

    def merge_short(self, units: list[str]) -> list[bytes]:
        """As merge: all agendas advance together."""
        lengths = np.array([len(u) for u in units], np.int64)
        symbol = self.symbol[np.frombuffer("".join(units).encode("utf-32-le"), "<u4")]
        unit = np.repeat(np.arange(len(units)), lengths)
        last = np.int64(1 << 40)
        done_symbol, done_unit = [], []
        made = self.pairs_at(symbol, unit, np.arange(len(symbol)))
        while len(symbol):
            place = np.where(made >= 0, self.place[made], last)
            starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            counts = np.diff(np.r_[starts, len(symbol)])
            head = np.repeat(np.minimum.reduceat(place, starts), counts)
            rest = head < last
            done_symbol.append(symbol[~rest])
            done_unit.append(unit[~rest])
            # The head of each agenda: the leftmost pair of the best place.
            at = np.flatnonzero(rest & (place == head))
            at = at[np.r_[True, unit[at[1:]] != unit[at[:-1]]]] if len(at) else at
            symbol[at] = made[at]
            rest[at + 1] = False
            moved = (np.cumsum(rest) - 1)[at]
            symbol, unit, made = symbol[rest], unit[rest], made[rest]
            # Only the merged symbol and the one before it form new pairs.
            near = np.unique(np.r_[moved, moved[moved > 0] - 1])
            made[near] = self.pairs_at(symbol, unit, near)
        symbol, unit = np.concatenate(done_symbol or [symbol]), np.concatenate(done_unit or [unit])
        order = np.argsort(unit, kind="stable")
        symbol, unit = symbol[order], unit[order]
        odd = np.flatnonzero(symbol < 0)
        if len(odd):  # characters that are no pieces go byte by byte
            spelled = [[self.bytes[b] for b in chr(-1 - c).encode()] for c in symbol[odd].tolist()]
            size = np.ones(len(symbol), np.int64)
            size[odd] = [len(x) for x in spelled]
            start = (np.cumsum(size) - size)[odd]
            symbol, unit = np.repeat(symbol, size), np.repeat(unit, size)
            for at, ids in zip(start.tolist(), spelled, strict=True):
                symbol[at:at + len(ids)] = ids
        whole, first = symbol.astype("<u4").tobytes(), (4 * np.searchsorted(unit, np.arange(len(units) + 1))).tolist()
        return [whole[lo:hi] for lo, hi in zip(first, first[1:], strict=False)]


def model(path: str) -> MergeModel:
    if path not in _MODELS:
        _MODELS[path] = MergeModel(path)
    return _MODELS[path]


_UNITS = re.compile(rf"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|[^{MARK}\n]+")


def units_of(text: str) -> list[str]:
    """Marked units of a text; their concatenation is the marked text."""
    if not text:
        return []
    marked = MARK + text.replace(" ", MARK)
    return _UNITS.findall(marked)


class Encoder:
    """Unit ids with a memo; ids of new units are checked against the library."""

    def __init__(self, path: str):
        self.model, self.memo = model(path), {}

    def learn(self, units: set[str]) -> None:
        new = [u for u in units if u not in self.memo]
        if not new:
            return
        # Units that begin with the mark first, so that the joined text has its begin where the library puts its own mark.
        new.sort(key=lambda u: not u.startswith(MARK))
        lead = new if new[0].startswith(MARK) and not new[0].startswith(MARK * 2) else [MARK, *new]
        found = self.model.merge(new)
        parts = found if lead is new else [self.model.merge([MARK])[0], *found]
        # A unit of marks alone, or one that begins with marks after such, must not touch another mark: a line feed parts them.
        feed = self.model.normal["\n"] if "\n" in self.model.normal else self.model.bytes[10]
        feed, text, want = feed.to_bytes(4, "little"), [], []
        for u, ids in zip(lead, parts, strict=True):
            if text and u.startswith(MARK):
                text.append("\n")
                want.append(feed)
            text.append(u)
            want.append(ids)
        said = self.model.sp.encode("".join(text).replace(MARK, " ")[1:], num_threads=1)
        if np.array(said, "<u4").tobytes() != b"".join(want):
            raise ValueError("the merge agenda and the sentencepiece library differ on a batch of units")
        if len(self.memo) + len(new) > MEMO_ENTRIES:
            self.memo.clear()
        self.memo.update(zip(new, found, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, with the begin and the end id."""
        split = [units_of(t) for t in texts]
        begin, end = (i.to_bytes(4, "little") for i in (self.model.bos, self.model.eos))
        for attempt in range(2):
            self.learn(set().union(*split))
            try:
                return [b"".join([begin, *map(self.memo.__getitem__, units), end]) for units in split]
            except KeyError:  # the memo was begun anew meanwhile
                if attempt:
                    raise
                self.memo.clear()
        raise AssertionError


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                  digests: bool = False) -> DataFrame:
    """Per row of `docs`: doc_id, n_tokens, ids, decoded; with `digests` the SHA-256 of ids (little-endian
    unsigned 32-bit) and of the decoded text instead of both.  Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for batch in batches:
            for piece in row_slices(batch, "text", SLICE):
                ids = enc.encode([t or "" for t in piece.column("text").to_pylist()])
                decoded = enc.model.sp.decode([np.frombuffer(x, "<u4").tolist() for x in ids], num_threads=1)
                columns = [piece.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if digests:
                    columns += [pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string())]
                else:
                    columns += [pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())),
                                pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, {rest}")
