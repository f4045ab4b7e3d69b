"""BPE and token files against the libraries; the word-aligned codec."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from llm_corpus import corpus
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quiver.llm import bpe, simple8b, token_files
from quiver.llm.bpe import RankCodec, bpe_decode, bpe_digest, bpe_encode, read_ranks
from quiver.llm.token_files import PieceEncoder, read_token_files, token_digest, write_token_files
from quiver.llm.tokens import PrefixHash, words
from quiver.session import scratch_path

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  b", "a \n b", " x ", "<|endoftext|> y", "龍 猫 é", "a\x1c b", "it's we'll  x", "a b c", "\x00 x",
       "日本語" * 90, "a" * 3000, "ab" * 400, "!" * 999, "th" * 100 + "eing" * 90, "r,.s., t.\nU, v."]


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(VOCABULARY)
    own.encode_special_tokens = True
    return own


@pytest.fixture(scope="module")
def ranked():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={}
    )


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_codec_matches_library(ranked):
    codec = RankCodec(RANKS, public_tokenizers.PATTERN)
    texts = ODD + [t or "" for _, t, _ in corpus()]
    ids = codec.encode(texts)
    assert ids == [packed(ranked.encode_ordinary(t)) for t in texts]
    assert codec.decode(ids) == [t.encode() for t in texts]
    with pytest.raises(ValueError):
        codec.decode([packed([60_000])])


def test_bpe_digest(docs, none, ranked):
    got = Counter(tuple(r) for r in bpe_digest(docs, RANKS, public_tokenizers.PATTERN).collect())
    expected = Counter()
    for doc_id, text, _ in corpus():
        raw = packed(ranked.encode_ordinary(text or ""))
        shas = hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
        expected[doc_id, len(raw) // 4, *shas] += 1
    assert got == expected
    assert bpe_digest(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_round_trip(docs):
    back = bpe_decode(bpe_encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    got = Counter((r.doc_id, bytes(r.decoded)) for r in back.collect())
    assert got == Counter((d, (t or "").encode()) for d, t, _ in corpus())


def test_piece_encoder(library, monkeypatch):
    monkeypatch.setattr(token_files, "PIECES_PER_CALL", 3)
    own = PieceEncoder(VOCABULARY)
    texts = ODD + [t or "" for _, t, _ in corpus()]
    for _ in range(2):  # with an empty and a filled cache
        assert own.encode(texts) == [packed(library.encode(t, add_special_tokens=False).ids) for t in texts]
    monkeypatch.setattr(token_files, "CACHE_PIECES", 1)
    assert own.encode(texts[-3:]) == [packed(library.encode(t, add_special_tokens=False).ids) for t in texts[-3:]]


def expected_files(library):
    start, out = 0, []
    for doc_id, text, _ in sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(packed(ids))))
        start += len(ids)
    return sorted(out, key=lambda r: r[1])


@pytest.mark.parametrize("block", [1 << 18, 50])
def test_token_files(docs, none, library, monkeypatch, block):
    monkeypatch.setattr(token_files, "BLOCK_IDS", block)
    got = sorted(map(tuple, token_digest(docs, VOCABULARY).collect()), key=lambda r: r[1])
    assert got == expected_files(library)
    assert token_digest(none, VOCABULARY).count() == 0


def test_added_tokens_become_their_ids(spark):
    default = Tokenizer.from_file(VOCABULARY)  # unmodified
    texts = ["see <|endoftext|> here", "<|endoftext|>", "a b<|endoftext|>c d", "one two  three", "<|endoftext| > a b", *ODD]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start, expected = 0, []
    for doc_id, text in enumerate(texts):
        ids = [*default.encode(text, add_special_tokens=False).ids, 2]
        expected.append((doc_id, start, len(ids), zlib.crc32(packed(ids))))
        start += len(ids)
    assert sorted(map(tuple, token_digest(given, VOCABULARY).collect())) == expected
    assert 50256 in default.encode(texts[0], add_special_tokens=False).ids


def test_blocks_are_readable_alone(spark, docs, library):
    path = scratch_path(spark, "test-tokens")
    write_token_files(docs, VOCABULARY, path, shards=3)
    rows = read_token_files(spark, path).where(F.col("doc_id") == 24).collect()
    assert np.frombuffer(rows[0].ids, "<u4").tolist() == [*library.encode("one two  three").ids, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=400))
def test_simple8b_round_trip(values):
    v = np.array(values, dtype=np.uint64)
    coded, escapes = simple8b.encode(v)
    assert len(coded) % 8 == 0
    assert (simple8b.decode(coded, len(v), escapes) == v).all()


def test_simple8b_packs():
    coded, _ = simple8b.encode(np.zeros(480, dtype=np.uint64))
    assert len(coded) == 16
    coded, _ = simple8b.encode(np.full(8, 30_000, dtype=np.uint64))
    assert len(coded) == 16


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n龍", max_size=12), max_size=6))
def test_words_of_a_buffer(texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    starts, ends, first = words(data, offsets)
    found = [
        [data[a:b].tobytes() for a, b in zip(starts[lo:hi], ends[lo:hi], strict=True)]
        for lo, hi in zip(first[:-1], first[1:], strict=True)
    ]
    assert found == [r.split() for r in raw]


def test_prefix_hash():
    data = np.frombuffer(b"abcabcab", dtype=np.uint8)
    h = PrefixHash(data, 3)
    a, b = np.array([0, 1, 0]), np.array([3, 4, 2])
    assert (h.of(a, b) == h.of(a + 3, b + 3)).all()
    assert h.of(np.array([0]), np.array([3])) != h.of(np.array([1]), np.array([4]))


def test_bpe_forgets_and_splits_without_changing_ids(ranked, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 1)
    monkeypatch.setattr(bpe, "ROWS_PER_QUERY", 300)
    rng = random.Random(3)
    texts = ["a b's don't 12 34x, end\n", "x\t", "tail   z", "don't don't", "", " ", "q　 r s\x1c"]
    texts += [" ".join("".join(rng.choice("abé9'.") for _ in range(rng.randint(1, 40))) for _ in range(60)) for _ in range(5)]
    codec = RankCodec(RANKS, public_tokenizers.PATTERN)
    for _ in range(3):
        for text in texts:
            (ids,) = codec.encode([text])
            assert np.frombuffer(ids, dtype="<u4").tolist() == ranked.encode_ordinary(text)
            assert codec.decode([ids]) == [text.encode()]


def test_bpe_parts_keep_all_words():
    words = [("w" * n, b"w" * n) for n in (3, 128, 1, 128, 50)]
    parts = list(bpe._parts(words, False))
    assert sorted(w for part in parts for w in part) == sorted(words)
    many = list(bpe._parts([("w" * 128, b"w" * 128)] * 1000, False))
    assert max(len(part) for part in many) * 128 * 129 // 2 <= bpe.ROWS_PER_QUERY
    assert list(bpe._parts([], True)) == []


class Recorded:
    """An object that notes the arguments of some of its methods."""

    def __init__(self, own, *names):
        self.own, self.names, self.given = own, names, []

    def __getattr__(self, name):
        method = getattr(self.own, name)
        if name not in self.names:
            return method

        def call(argument, **options):
            self.given.append(argument)
            return method(argument, **options)

        return call


def test_letters_pass_the_model_alone(library):
    own = PieceEncoder(VOCABULARY)
    own.library = Recorded(own.library, "encode_batch_fast")
    texts = ["Alpha beta!! gamma\nDelta, épsilon beta", "beta?! Alpha", "Alpha\nbeta.\nx y", "\nAlpha beta", "Alpha beta\n"]
    assert own.encode(texts) == [packed(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [words for words in own.library.given if words] == []
    assert own.known["beta"] and own.known[" Alpha"]


def test_bpe_cuts_no_letters(ranked):
    codec = RankCodec(RANKS, public_tokenizers.PATTERN)
    codec.find, given = (lambda text, find=codec.find: (given.append(text), find(text))[1]), []
    text = "Some letters only, qzxv qzxv's qzxv"
    assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == ranked.encode_ordinary(text)
    assert sorted("".join(given).split()) == ["Some", "only,", "qzxv's"]
    assert set(codec.known.young) >= {"letters", "qzxv", " Some", " ,"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 240), min_size=1, max_size=300))
def test_chain_of_words(steps):
    after = np.arange(len(steps)) + np.array(steps)
    expected, i = [], 0
    while i < len(steps):
        expected.append(i)
        i += steps[i]
    assert simple8b._chain(after).tolist() == expected


def test_space_split():
    texts = ["a b a", "", "x", " a", "b  b "]
    split = token_files.SpaceSplit(pa.array(texts, pa.large_string()))
    values = [*split.distinct, *split.heads]
    assert split.joined([v.encode() for v in values]) == [t.replace(" ", "").encode() for t in texts]
    assert split.joined([None if v == "b" else b"1" for v in values]) == [None, b"1", b"1", b"11", None]
    assert token_files.SpaceSplit(pa.array([], pa.large_string())).joined([]) == []
