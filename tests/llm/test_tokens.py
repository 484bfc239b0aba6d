"""Token counts, sentencepiece agenda and packed ids against the libraries and plain loops."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import SF, collect, docs, rows, words

from calyx.llm import packed_ids, pieces, queries, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def sp():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(BYTE_BPE)


def brute_tokens(word):
    """Best segmentation by plain recursion over every split."""
    scores = token_counts.vocabulary(PIECES)
    text, best = token_counts.MARK + word, [(0, 0)]
    for j in range(1, len(text) + 1):
        found = []
        for i in range(j):
            if text[i:j] in scores:
                found.append((best[i][0] + scores[text[i:j]], best[i][1] - 1))
        if text[j - 1] not in scores:
            n = len(text[j - 1].encode())
            found.append((best[j - 1][0] + n * round(token_counts.UNKNOWN_BYTE * token_counts.SCALE), best[j - 1][1] - n))
        best.append(max(found))
    return -best[-1][1]


def test_token_counts(spark):
    want = sorted(((r[0], len(words(r[1])), sum(brute_tokens(w.decode()) for w in words(r[1]))) for r in rows()), key=repr)
    assert collect(token_counts.token_counts(docs(spark), PIECES), "doc_id", "n_words", "n_tokens") == want


def test_token_counts_empty(spark):
    assert token_counts.token_counts(docs(spark, []), PIECES).count() == 0


def test_trie_shares_prefixes_with_plain_counts():
    scores = token_counts.vocabulary(PIECES)
    some = {"there", "theory", "the", "t", "thé", "日本語", "x" * 500, ""}
    assert token_counts.count_words(some, scores) == {w: brute_tokens(w) for w in some}


def test_memo_restart_keeps_results(spark, monkeypatch):
    enc = pieces.Encoder(PIECES)
    monkeypatch.setattr(pieces, "MEMO_ENTRIES", 3)
    texts = ["a b c d e f", "a b g", "h", "a h b"]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts) + enc.encode(texts)] == enc.model.sp.encode(texts * 2, add_bos=True, add_eos=True)


def expected_pieces(sp, given):
    out = []
    for doc_id, text in given:
        ids = sp.encode(text or "", add_bos=True, add_eos=True)
        out.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_pieces(spark, sp):
    got = pieces.encode_decode(docs(spark), PIECES, digests=True)
    assert collect(got, *got.columns) == expected_pieces(sp, [(r[0], r[1]) for r in rows()])
    assert pieces.encode_decode(docs(spark, []), PIECES).count() == 0


def test_pieces_query(spark, sp):
    given = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op4_pieces(spark, SF)
    assert collect(got, *got.columns) == expected_pieces(sp, given)


def test_pieces_plain_output(spark, sp):
    got = {r["doc_id"]: r for r in pieces.encode_decode(docs(spark).where("doc_id < 30"), PIECES).collect()}
    for r in rows():
        if r[0] is not None and r[0] < 30 and r[0] != 7:
            assert got[r[0]]["ids"] == sp.encode(r[1] or "", add_bos=True, add_eos=True)
            assert got[r[0]]["decoded"] == sp.decode(got[r[0]]["ids"])


def expected_packed(bpe, given):
    at, out = 0, []
    for doc_id, text in given:
        ids = bpe.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=repr)


def test_packed(spark, bpe):
    given = sorted(((r[0], r[1]) for r in rows()), key=lambda x: (x[0] is not None, x[0] or 0))
    got = packed_ids.packed_digests(docs(spark), BYTE_BPE)
    assert collect(got, *got.columns) == expected_packed(bpe, given)
    assert packed_ids.packed_digests(docs(spark, []), BYTE_BPE).count() == 0


def test_packed_query(spark, bpe):
    given = sorted((r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = queries.op10_packed_ids(spark, SF)
    assert collect(got, *got.columns) == expected_packed(bpe, given)


def test_packed_ranges(spark, bpe, tmp_path, monkeypatch):
    path = str(tmp_path / "ids")
    packed_ids.write_packed(docs(spark).where("doc_id is not null"), path, BYTE_BPE)
    whole = [i for r in sorted(((r[0], r[1]) for r in rows() if r[0] is not None), key=lambda x: x[0])
             for i in bpe.encode(r[1] or "", add_special_tokens=False).ids + [0]]
    table = spark.read.parquet(path)
    for lo, hi in ((0, 5), (100, 4500), (4090, 4100), (len(whole) - 3, len(whole) + 9)):
        got = [i for r in packed_ids.read_range(table, lo, hi).orderBy("start").collect() for i in r["ids"]]
        assert got == whole[lo:hi]


@pytest.mark.parametrize("ids", [[5], [7] * 5000, list(range(9000)), [1, 2 ** 32 - 1] * 3000, [0, 0, 0, 4_000_000_000], list(np.random.default_rng(1).zipf(1.3, 20_000) % 2 ** 32)])
def test_segments_round_trip(ids):
    ids = np.array(ids, np.uint64).astype(np.uint32)
    data = packed_ids.pack_segment(ids)
    assert (packed_ids.unpack_segment(data) == ids).all()
    assert (packed_ids.unpack_segment(data, 3, 4200) == ids[3:4200]).all()


def test_outliers_become_exceptions():
    ids = np.full(4096, 9, np.uint32)
    ids[::100] = 2 ** 31
    assert len(packed_ids.pack_segment(ids)) < 4096


@pytest.mark.parametrize("unit", ["ab" * 100_000, "é日x" * 30_000, "the" * 16, "y" * (pieces.LONG - 2), "y" * (pieces.LONG - 1), "\U0001f600" * 100, "ﬁ\x01"])
def test_long_units_have_an_agenda_of_their_own(sp, unit):
    model = pieces.model(PIECES)
    assert np.frombuffer(model.merge([pieces.MARK + unit])[0], "<u4").tolist() == sp.encode(unit)


def test_portions_of_units(sp, monkeypatch):
    monkeypatch.setattr(pieces, "PORTION", 20)
    texts = [r[1] or "" for r in rows()] + ["x" * 60 + " short " + "y" * 70]
    enc = pieces.Encoder(PIECES)
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == sp.encode(texts, add_bos=True, add_eos=True)


def test_ids_of_many_plain_texts_are_looked_up_once_a_unit(monkeypatch):
    """A batch's units are found in the memo once each, however often they come, and ids are those of whole texts."""
    enc = packed_ids.UnitEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["the cat sat", "a cat\nthe cat", "", "  two  gaps ", "cat", "the cat " * 500 + "end", "x\ty z", "\n"]
    want = [np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]

    class Counted(dict):
        asked = 0

        def __getitem__(self, key):
            Counted.asked += 1
            return dict.__getitem__(self, key)

    enc.plain = Counted()
    assert enc.encode(texts) == want and Counted.asked < 20 and enc.encode([]) == []
    monkeypatch.setattr(packed_ids, "MEMO_ENTRIES", 2)
    assert enc.encode(texts) == want == enc.encode(texts)
