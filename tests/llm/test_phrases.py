"""Phrase collocations against a plain count of every phrase."""

import random
import re
from collections import Counter, defaultdict

import pytest

from llm_corpus import corpus
from quiver.llm import phrases as op

CLASH = ["phrase", "f", "n", "score", "rank", "part", "floor", "bound", "left_1", "place"]
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, limit, least, scale=2_000_000, share=80):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        candidates = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        cover = Counter()
        for p, c in candidates.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        cover[p[i:j]] = max(cover[p[i:j]], c)
        kept = []
        for p, a in candidates.items():
            if 100 * cover[p] >= share * a:
                continue
            score, k = min((scale * a // (counts[p[:i]] + counts[p[i:]]), i) for i in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:limit], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def mined(spark, rows, **how):
    schema = "doc_id long, lang string, text string" + "".join(f", {c} string" for c in CLASH)
    docs = spark.createDataFrame([(i, *r, *["x"] * len(CLASH)) for i, r in enumerate(rows)], schema).repartition(3)
    found = op.phrases(docs, **how)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in found.collect())


def chatter(seed, docs, vocabulary=12):
    rng = random.Random(seed)
    words = [f"w{i}" if i % 3 else f"É{i}" for i in range(vocabulary)]
    fixed = [" ".join(rng.choices(words, k=rng.randint(2, 5))) for _ in range(6)]
    rows = []
    for _ in range(docs):
        said = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words).upper() for _ in range(rng.randint(0, 40))]
        ends = [rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b"]) for _ in said]
        rows.append((rng.choice(["a", "b", None, "und"]), "".join(x for both in zip(said, ends) for x in both)))
    return rows


@pytest.mark.parametrize("limit", [4, 40, 10_000])
def test_phrases_match_brute_force(spark, monkeypatch, limit):
    """Small limits settle above a floor, after one round or several."""
    monkeypatch.setattr(op, "AHEAD", 2)
    rows = chatter(limit, 160)
    assert mined(spark, rows, limit=limit, min_count=3) == brute(rows, limit, 3)


def test_floor_is_lowered_when_phrases_are_covered(spark, monkeypatch):
    """The best pairs all lie in longer phrases, so the first floor leaves too few survivors."""
    monkeypatch.setattr(op, "AHEAD", 1)
    rows = [("a", f"p{i} q{i} r{i} s{i}") for i in range(6)] * 4 + [("a", "the x. the y. the x y")] * 5 + [("b", "the x")] * 2
    for limit in (8, 9):
        assert mined(spark, rows, limit=limit, min_count=2) == brute(rows, limit, 2)


def test_phrases_of_a_messy_corpus(spark):
    rows = [(source, text) for _, text, source in corpus()] * 3
    assert mined(spark, rows, limit=300, min_count=3) == brute(rows, 300, 3)


def test_every_bit_set_changes_nothing(spark, monkeypatch):
    """A full filter lets phrases be counted for nothing, and no more."""
    monkeypatch.setattr(op, "_bits", lambda phrases, k: op.np.full(op.FILTER_BITS >> 3, 255, dtype="uint8"))
    rows = chatter(9, 80)
    assert mined(spark, rows, limit=5, min_count=3) == brute(rows, 5, 3)


def test_counts_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = spark.range(1).select(F.lit(9_000_000_000_000_000).alias("a"), F.lit(18_000_000_000_000_001).alias("t"))
    assert big.select(op._ratio(F.col("a"), F.col("t"), 2_000_000)).first()[0] == 2_000_000 * 9_000_000_000_000_000 // 18_000_000_000_000_001


def test_no_phrases(spark):
    assert mined(spark, [("a", "one two"), (None, None), ("b", "")], limit=5, min_count=30) == []
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert op.phrases(empty).collect() == []
