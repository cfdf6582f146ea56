import random
import zlib
from functools import lru_cache

import edges
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factfade.llm import packing, simple8b
from factfade.llm.queries import vocabulary
from factfade.llm.tokens import encode_bytes, encoder

WORDS, BYTES = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
HARD = [
    "", " ", "  a  b\n\n c's don't  ", "é é x  y  z 1½2 _a_ 中文 ñ٣", "a\x1cb !\x1c", "x\n", "\n", "\ny",
    "<|endoftext|> hi<|startoftext|>", "Straße ǅ İ ΑΣ Σ", "é ́a", "Hi. Ho! .. a.b. x,", "a \n b",
    "THE!! don't WE'LL Ab's É*** x_! İ! \nThe\nÀB, ǅ.",
]


@lru_cache
def fresh(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def library(path, text):
    return np.asarray(fresh(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_pieces_give_the_ids_of_the_whole_text(path):
    assert encode_bytes(path, HARD) == [library(path, t) for t in HARD]


def test_special_tokens_are_one_id():
    got = [np.frombuffer(encode_bytes(p, ["<|endoftext|> hi"])[0], "<u4").tolist() for p in (WORDS, BYTES)]
    assert got == [[49407, 1883], [50256, 23105]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abdehlnorstzABÀÉßéñöü"), min_size=1, max_size=14), max_size=6))
def test_words_of_letters_give_the_ids_of_the_library(words):
    for path in (WORDS, BYTES):
        assert encoder(path).direct
        text = " ".join(words)
        assert encode_bytes(path, [text]) == [library(path, text)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Z.'\n\t é1_!中́"), max_size=30), max_size=4))
def test_any_text_gives_the_ids_of_the_library(texts):
    for path in (WORDS, BYTES):
        assert encode_bytes(path, texts) == [library(path, t) for t in texts]


def test_a_word_is_kept_once_whatever_signs_follow():
    words = [f"{a}xq{b}" for a in "bdfgh" for b in "klmnp"]
    signs = [".", ",", "!?", "###"]
    text = " ".join(w + s for w in words for s in signs)
    for path in (WORDS, BYTES):
        known = encoder(path)
        known.young = known.old = type(known.young)()
        assert encode_bytes(path, [text]) == [library(path, text)]
        assert len(known.young) <= len(words) + len(signs) + 3  # the first word, no sign


def test_texts_of_all_kinds_come_back_in_their_order():
    rng = random.Random(5)
    bits = ["a", " ", "  ", "\n", "Ab,", "x.", "\t", "<|endoftext|>", "é!", "\x1c", "中", "w" * 300 + "."]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(500)]
    for path in (WORDS, BYTES):
        assert encode_bytes(path, texts) == [library(path, t) for t in texts]


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(0, 3000))
        width = rng.integers(0, 64, size=n) if rng.random() < 0.5 else np.full(n, rng.integers(0, 20))
        ids = rng.integers(0, 2**63, size=n, dtype=np.uint64) * np.uint64(2) >> (63 - width).astype(np.uint64)
        cuts = np.sort(rng.integers(0, n + 1, size=4))
        lengths = np.diff(np.concatenate(([0], cuts, [n])))
        block = int(rng.choice([1, 7, 240, 1024]))
        start, payloads = 0, simple8b.pack(ids, lengths, block)
        assert [u.tolist() for u in simple8b.unpack_many(payloads)] == [simple8b.unpack(p).tolist() for p in payloads]
        for length, payload in zip(lengths, payloads, strict=True):
            own = ids[start : start + length]
            assert (simple8b.unpack(payload) == own).all()
            assert (simple8b.unpack(payload, (1, 3)) == own[block : 3 * block]).all()
            start += length


def test_small_ids_share_words():
    ids = np.ones(1024, np.uint64)
    assert len(simple8b.pack(ids, [1024])[0]) == 16 + 8 + 8 * 18  # 60 to a word


def test_files_give_back_every_document(spark):
    docs = edges.documents(spark)
    found = simple8b.documents_of(simple8b.write_ids(docs, WORDS, 2, block=64)).collect()
    expected = {}
    for r in docs.collect():
        data = library(WORDS, r["text"] or "") + np.array([2], "<u4").tobytes()
        expected.setdefault(r["doc_id"], []).append((len(data) // 4, zlib.crc32(data)))
    got = {}
    for r in found:
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    ordered = sorted(found, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0] + [r["n_tokens"] for r in ordered[:-1]]).tolist()
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert ids == sorted(ids)


def test_no_documents_no_ids(spark):
    assert simple8b.documents_of(simple8b.write_ids(edges.empty(spark), WORDS, 2)).count() == 0
    assert packing.pack_documents(edges.empty(spark), BYTES, 2).count() == 0


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 5, 4)] == [(0, 0), (1, 0), (0, 6)]  # 4 fills the first
    assert bins.place(7) == (2, 0)  # two open: 5 and 3 left
    assert bins.place(8) == (3, 0)  # the one with 3 left closes
    assert bins.place(3) == (1, 5)
    with pytest.raises(ValueError):
        bins.place(11)


def test_bounded_best_fit_is_valid_and_near_the_bound():
    rng = random.Random(3)
    sizes = [rng.randint(1, 1024) for _ in range(20_000)]
    bins, held = packing.BestFit(1024, 256), {}
    for n in sizes:
        number, offset = bins.place(n)
        assert held.get(number, 0) == offset
        held[number] = offset + n
        assert bins.open <= 256
    assert max(held.values()) <= 1024
    assert len(held) <= 1.02 * sum(sizes) / 1024


def test_cut_keeps_all_but_the_first_piece_full():
    assert packing.cut(1, 4) == [(0, 1)]
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(10, 4) == [(0, 2), (2, 4), (6, 4)]


def test_packed_documents(spark):
    docs = edges.documents(spark)
    found = packing.pack_documents(docs, BYTES, 2, room=128, open_bins=8).collect()
    expected = []
    for r in docs.collect():
        data = library(BYTES, r["text"] or "") + np.array([2], "<u4").tobytes()
        for k, (start, n) in enumerate(packing.cut(len(data) // 4, 128)):
            expected.append((r["doc_id"] or -1, k, start, n, zlib.crc32(data[4 * start : 4 * (start + n)])))
    got = [(r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found]
    assert sorted(got) == sorted(expected)
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
