"""Spelling variants against comparing all words with all words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm_corpus import corpus
from quiver.llm import spelling

LOWER = {c: c + 32 for c in range(65, 91)}
CLASH = ["word", "n", "near", "form", "root", "m", "i", "j", "shared", "h", "r", "d", "c"]


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, min_chars=6, min_count=5, ratio=5, every=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    forms = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, n, len(near[w]), forms[w], words.get(forms[w]), root))
    return sorted(out)


def grouped(spark, rows, **how):
    schema = "doc_id long, text string" + "".join(f", {c} string" for c in CLASH)
    docs = spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], schema).repartition(3)
    found = spelling.spelling_variants(docs, **how)
    assert found.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    return sorted(tuple(r) for r in found.collect())


def misspelt(seed):
    """Words in counts that differ by large factors, so that forms chain."""
    rng = random.Random(seed)
    rows, letters = [], "abéÀ×"
    for base in range(12):
        word = "".join(rng.choices(letters + "cd", k=rng.randint(5, 9)))
        for n in (160, 31, 6, 5, 1):
            rows += [(rng.randint(0, 400), f"{rng.choice(['', '1', '_'])}{word}{rng.choice([' ', '-', '9', chr(10)])}") for _ in range(n)]
            at, c = rng.randint(0, len(word) - 1), rng.choice(letters)
            word = rng.choice([word[:at] + c + word[at:], word[:at] + c + word[at + 1 :], word[:at] + word[at + 1 :], word.upper()])
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_match_brute_force(spark, seed):
    rows = misspelt(seed)
    assert grouped(spark, rows) == brute(rows)
    assert grouped(spark, rows, drop_every=2, min_chars=4, min_count=2, ratio=3) == brute(rows, 4, 2, 3, 2)


def test_chains_are_followed_to_the_end(spark):
    chain = ["kkkkkk", "kkkkkl", "kkkkll", "kkklll", "kkllll", "klllll"]
    rows = [(i, w) for e, w in enumerate(chain) for i in range(2**e)]
    got = {r[0]: r[5] for r in grouped(spark, rows, min_count=1, ratio=2, drop_every=1 << 40)}
    assert set(got.values()) == {"klllll"}


@pytest.mark.parametrize("limit", [1, 3, 10_000])
def test_cells_of_any_size_lose_no_pair(spark, limit):
    rng = random.Random(limit)
    words = {"".join(rng.choices("ab", k=rng.randint(1, 8))) for _ in range(250)} | {"aaaaaaaa" + c for c in "bcdéf龍"} | {"x" * 600, "x" * 601}
    df = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words))], "word string, n long")
    got = {(r["word"], r["near"]) for r in spelling.near_words(df, limit=limit).collect()}
    assert got == {(a, b) for a in words for b in words if is_near(a, b)}


def test_split_cells_are_bounded(spark):
    words = [a + b + c + d for a in "abcde" for b in "abcde" for c in "abcde" for d in "abcde"]
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    assert spelling.cells(df, limit=1).select(F.max(F.size("words"))).first()[0] <= 5 + 5**2


def test_acceptor_is_minimal_and_exact():
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(0, 6))) for _ in range(200)})
    states, first = spelling.acceptor(words)
    assert sorted(spelling._common(states, first, first)) == words
    languages = {tuple(sorted(spelling._common(states, s, s))) for s in range(len(states))}
    assert len(languages) == len(states)  # no two states accept the same strings
    assert spelling.one_edit_pairs([], 3) == set()


def test_messy_corpus(spark):
    rows = [(doc_id, text) for doc_id, text, _ in corpus()] * 3
    assert grouped(spark, rows, min_chars=2, min_count=2, ratio=2, drop_every=7) == brute(rows, 2, 2, 2, 7)


def test_no_words(spark):
    assert grouped(spark, [(1, None), (None, ""), (2, "short words")]) == []
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
