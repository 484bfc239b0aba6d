"""Token counts under a unigram vocabulary, by dynamic programming shared over a trie.

Pre-tokens are the words of a text, each with the word-start mark in front.
The distinct pre-tokens of a batch go into a trie.  A trie node stands for one
prefix, so its best segmentation (the forward score) is the same for every word
below it and is computed once, when the node is made.  An automaton over the
vocabulary, carried along the trie, names the pieces that end at a node.
Terminal nodes hand their token count to a memo that later batches of the same
Python worker reuse.

Scores: the vocabulary file ranks its pieces; piece r (0-based among the normal
pieces) scores -ln(r + 2), a Zipf unigram model of that ranking.  A character
that no piece covers costs one byte token per UTF-8 byte, each UNKNOWN_BYTE.
Among segmentations of equal score the one with fewer tokens counts.

Null or empty texts, and texts of white space alone, have 0 words and 0 tokens.
Repeated rows and null ids are kept as they are; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calyx.llm.common import row_slices

MARK = "▁"
UNKNOWN_BYTE = -20.0
#: Scores are held as integers (millionths) so that sums, and with them ties, are exact.
SCALE = 1_000_000
#: Entries after which a worker's memo, or its automaton, starts anew; a matter of memory, not of results.
MEMO_ENTRIES = 400_000
#: One unit of score in a weight, whose lower part counts tokens; beyond any word's number of tokens.
TOKEN = 1 << 32

_VOCABULARIES: dict[str, Automaton] = {}
_MEMO: dict[str, dict[str, int]] = {}


def vocabulary(path: str) -> dict[str, int]:
    """Piece -> integer score, from a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(sp.get_piece_size())
              if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return {sp.id_to_piece(i): round(-math.log(r + 2) * SCALE) for r, i in enumerate(normal)}


class Automaton:
    """The vocabulary's pieces that end at a place of a text, found by one look-up a character.

    A state is the longest end of the text read so far that begins some piece.  `move[state + ch]` holds the next state
    and the pieces that end there, each as (characters, weight); made when first met.  A weight holds a piece's score in
    its upper part and one token in its lower part, so sums compare by score, then by fewer tokens.
    """

    def __init__(self, scores: dict[str, int]):
        self.weights = {p: s * TOKEN - 1 for p, s in scores.items()}
        self.begins = {p[:n] for p in scores for n in range(1, len(p) + 1)}
        self.move: dict[str, tuple[str, tuple[tuple[int, int], ...]]] = {}

    def enter(self, seen: str) -> tuple[str, tuple[tuple[int, int], ...]]:
        """Make the entry for a state and the character read after it."""
        if len(self.move) >= MEMO_ENTRIES:
            self.move.clear()
        ends = [(len(seen) - i, w) for i in range(len(seen)) if (w := self.weights.get(seen[i:])) is not None]
        ch = seen[-1]
        if ch not in self.weights:
            width = len(ch.encode("utf-8", "surrogatepass"))
            ends.append((1, width * (round(UNKNOWN_BYTE * SCALE) * TOKEN - 1)))
        state = next((seen[i:] for i in range(len(seen)) if seen[i:] in self.begins), "")
        found = self.move[seen] = state, tuple(ends)
        return found


def count_words(words: set[str], scores: dict[str, int] | Automaton) -> dict[str, int]:
    """Token counts of distinct words: forward scores once for each node of their trie.

    Sorted words meet the trie's nodes depth first, so only the nodes from the root to the current word are held: the
    automaton's state and the best sum at each.  A word goes on where it leaves the path of the one before.
    """
    pieces = scores if isinstance(scores, Automaton) else Automaton(scores)
    move, enter = pieces.move, pieces.enter
    counts: dict[str, int] = {}
    before = ""
    states, forward = [""], [0]
    for word in sorted(words):
        text = MARK + word
        shared = 0
        for a, b in zip(text, before):
            if a != b:
                break
            shared += 1
        del states[shared + 1:], forward[shared + 1:]
        state = states[-1]
        for ch in text[shared:]:
            found = move.get(state + ch)
            state, ends = found if found is not None else enter(state + ch)
            best = None
            for back, weight in ends:
                total = forward[-back] + weight
                if best is None or total > best:
                    best = total
            states.append(state)
            forward.append(best)
        counts[word] = -forward[-1] % TOKEN
        before = text
    return counts


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, n_words, n_tokens.  Map-only: no row leaves its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _VOCABULARIES:
            _VOCABULARIES[model_path] = Automaton(vocabulary(model_path))
        pieces = _VOCABULARIES[model_path]
        memo = _MEMO.setdefault(model_path, {})
        for batch in batches:
            for piece in row_slices(batch, "text"):
                split = [(t or b"").split() for t in piece.column("text").cast(pa.binary()).to_pylist()]
                new = {w for words in split for w in words if w not in memo}
                if len(memo) + len(new) > MEMO_ENTRIES:
                    memo.clear()
                    new = {w for words in split for w in words}
                named = {w: w.decode("utf-8", "replace") for w in new}
                counted = count_words(set(named.values()), pieces)
                memo.update((w, counted[s]) for w, s in named.items())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array([len(words) for words in split], pa.int64()),
                     pa.array([sum(map(memo.__getitem__, words)) for words in split], pa.int64())],
                    names=["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
