"""Exact, near, byte and word dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_corpus import corpus
from pyspark.sql import functions as F

from quiver.llm import repeats, suffix
from quiver.llm.components import components
from quiver.llm.debruijn import substring_dedup
from quiver.llm.exact_dedup import exact_dedup, keep_first
from quiver.llm.near_dup import jaccard_join, matched_depth, one_per_group
from quiver.llm.suffix import suffix_dedup

SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"


def order(doc_id):
    return (doc_id is None, doc_id or 0)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact_expected(rows):
    groups = defaultdict(list)
    for doc_id, text, _ in rows:
        groups[re.sub(SPACE, " ", text or "")].append(doc_id)
    out = Counter()
    for norm, ids in groups.items():
        keep = min(ids, key=order)
        for n, doc_id in enumerate(sorted(ids, key=order)):
            out[doc_id, keep, len(ids), n == 0, sha(norm)] += 1
    return out


def exact_rows(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_exact(docs, none):
    assert exact_rows(exact_dedup(docs)) == exact_expected(corpus())
    assert exact_dedup(none).count() == 0


def test_exact_digest_collisions(docs):
    """Texts that share a state key are still told apart by their bytes."""
    short = exact_dedup(docs, digest=lambda c: F.unhex(F.substring(F.sha2(c.cast("binary"), 256), 1, 2)))
    assert exact_rows(short) == exact_expected(corpus())


def test_keep_first(docs):
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    expected = [x[0] for x, n in exact_expected(corpus()).items() if x[3]]
    assert sorted((r.doc_id for r in kept.collect()), key=order) == sorted(expected, key=order)


def shingles(text, n=5):
    w = re.findall(WORD, text or "")
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near_expected(rows, threshold):
    sets = [(doc_id, shingles(text)) for doc_id, text, _ in rows]
    links = defaultdict(int)
    parent = {doc_id: doc_id for doc_id, _ in sets if doc_id is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for j, (b, t) in enumerate(sets):
            if i != j and a is not None and b is not None and s and t and len(s & t) >= threshold * len(s | t):
                links[i] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return Counter((a, None if a is None else find(a), links[i]) for i, (a, _) in enumerate(sets))


def test_near(docs, none):
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join(docs).collect())
    assert got == near_expected(corpus(), 0.8)
    assert jaccard_join(none).count() == 0
    assert one_per_group(docs).columns == docs.columns


def test_an_id_on_several_texts_loses_only_the_near_copy(spark):
    base = [f"w{i}" for i in range(200)]
    near, other = list(base), [f"v{i}" for i in range(200)]
    near[9] = "x"
    second = list(other)
    second[7] = "y"
    rows = [(3, base), (7, near), (7, [f"u{i}" for i in range(50)]), (5, other), (7, second), (9, second), (None, base)]
    rows = [(d, " ".join(t), "s") for d, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r.doc_id, r.text) for r in one_per_group(docs).collect())
    assert got == Counter((rows[i][0], rows[i][1]) for i in (0, 2, 3, 6))
    joined = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join(docs).collect())
    assert joined == Counter([(3, 3, 1), (7, 3, 1), (7, 7, 0), (5, 5, 2), (7, 5, 2), (9, 5, 2), (None, None, 0)])


def test_near_blocks(spark, monkeypatch):
    """A group larger than a block loses no link between blocks."""
    from quiver.llm import near_dup

    monkeypatch.setattr(near_dup, "BLOCK", 4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(30):
        own = list(base)
        own[5 * i] = f"x{i}"
        rows.append((i, " ".join(own), "s"))
    got = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == near_expected(rows, 0.8)


def test_prefix_is_shortened_to_the_target():
    depth = matched_depth(0.8)
    assert 1 - (1 - 0.8**depth) ** 24 >= 0.999 > 1 - (1 - 0.8 ** (depth + 1)) ** 24


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (200, 200), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100, 200: 200}


def bytes_expected(rows, k):
    raw = [(doc_id, (text or "").encode()) for doc_id, text, _ in rows]
    seen = Counter(b[i : i + k] for _, b in raw for i in range(len(b) - k + 1))
    out = Counter()
    for doc_id, b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - k + 1):
            if seen[b[i : i + k]] > 1:
                gone[i : i + k] = True
        runs = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[doc_id, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("crowd", [1024, 1])
def test_bytes(docs, none, monkeypatch, crowd):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    for k, q in ((400, 128), (60, 16)):
        got = suffix_dedup(docs, window=k, minimizer=q)
        rows = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect())
        assert rows == bytes_expected(corpus(), k)
    assert suffix_dedup(none).count() == 0


def words_expected(rows, k):
    ordered = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (order(r[0]), sha(r[1])))
    first, gone_of = set(), {}
    for doc_id, text in ordered:
        w = re.findall(WORD, text)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            t = tuple(w[i : i + k])
            if t in first:
                gone[i : i + k] = [True] * k
            first.add(t)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        gone_of[doc_id, text] = (doc_id, len(w), sum(gone), sha(kept))
    return Counter(gone_of[r[0], r[1] or ""] for r in rows)


def test_words(docs, none):
    for k, q in ((20, 6), (4, 3)):
        got = substring_dedup(docs, window=k, minimizer=q)
        rows = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect())
        assert rows == words_expected(corpus(), k)
    assert substring_dedup(none).count() == 0


def test_verification_finds_unequal_spans(spark):
    texts = spark.createDataFrame([(1, "a b c d"), (2, "a b\nc x")], "doc long, text string")
    kind = "doc long, start long, n long, source long, source_start long"
    w = repeats.Windows("words", 3, 2, True)
    assert repeats.verified(w, texts, spark.createDataFrame([(2, 0, 1, 1, 0)], kind))
    assert not repeats.verified(w, texts, spark.createDataFrame([(2, 1, 1, 1, 1)], kind))


def test_suffix_order():
    data = np.frombuffer(b"banana bandana banana", dtype=np.uint8)
    own = suffix.Suffixes(data, 5)
    starts = np.arange(len(data) - 4)
    ranked = own.sort(starts, np.zeros(len(starts), dtype=int))
    tails = [data[i : i + 5].tobytes() for i in ranked]
    assert tails == sorted(tails)


def test_unequal_stretches_are_found():
    data = np.frombuffer(b"abcdefabcdxf", dtype=np.uint8)
    same = suffix._same_bytes(data, np.array([0, 1]), np.array([6, 7]), 4)
    assert same.tolist() == [True, False]


def test_super_kmers_cover_each_window_once():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 500).astype(np.uint8)
    offsets = np.array([0, 5, 5, 300, 500])
    w = repeats.Windows("bytes", 20, 7, False)
    _, _, text, pos, n = repeats.super_kmers(w, *w.symbols(data, offsets))
    found = sorted((int(t), int(p) + i) for t, p, m in zip(text, pos, n, strict=True) for i in range(m))
    lengths = np.diff(offsets)
    assert found == [(t, i) for t in range(4) for i in range(max(0, lengths[t] - 19))]
