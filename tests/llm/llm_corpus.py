"""The messy corpus that every operator is tested on."""

import random


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n))


def corpus():
    """(doc_id, text, source): nulls, empty and long texts, ties, repeated rows."""
    rng = random.Random(5)
    base, passage = words(rng, 300), words(rng, 90)
    edited = base.split(" ")
    edited[40] = "edited"
    rows = [(i, words(rng, rng.randint(1, 60)), f"s{i % 4}") for i in range(20)]
    rows += [(20, None, "s0"), (21, "", "s1"), (22, " \t\n ", "s1"), (23, "one", None), (24, "one two  three", "s2")]
    rows += [(30, base, "s0"), (31, base.replace(" ", "\n", 3), "s0"), (32, base, "s1"), (33, " ".join(edited), "s1")]
    rows += [(40, words(rng, 30) + " " + passage + " " + words(rng, 20), "s2"), (41, passage + " " + words(rng, 9), "s3")]
    rows += [(42, f"{passage} x {passage}", "s3"), (43, words(rng, 4000), "s9"), (44, "ab" * 900, "s9"), (45, "a " * 700, "s9")]
    rows += [(50, base, "s5"), (50, base, "s5"), (None, "no id", "s5"), (51, "naïve — 龍 x\x00y", "s5")]
    return rows
