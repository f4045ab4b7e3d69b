"""Toxicity, quality, mixing and nearest neighbours."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_corpus import corpus
from pyspark.sql import functions as F

from quiver.llm import ann, logistic, mixing, quality, toxicity
from quiver.llm.common import documents, labels, training_ids


@pytest.fixture(scope="module")
def sf(spark):
    return "/root/testdata/sf0.01"


def check_scores(df, rows):
    got = df.collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)


def test_training_rows_exclude_the_held_out_fold(spark, sf):
    ids = [r.doc_id for r in training_ids(labels(spark, sf), "toxic", 50).collect()]
    assert len(ids) == 50 and all(zlib.crc32(str(i).encode()) % 5 for i in ids)


def held_out_accuracy(df, spark, sf, label):
    joined = df.where("held_out").join(labels(spark, sf), "doc_id")
    return joined.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]


def test_toxicity(spark, sf, docs, none):
    no_labels = labels(spark, sf).limit(0)
    check_scores(toxicity.toxicity(docs, no_labels), corpus())
    assert toxicity.toxicity(none, no_labels).count() == 0
    scored = toxicity.toxicity(documents(spark, sf), labels(spark, sf)).cache()
    assert held_out_accuracy(scored, spark, sf, "toxic") > 0.95
    again = toxicity.without_toxic(documents(spark, sf), labels(spark, sf))
    assert again.columns == documents(spark, sf).columns
    assert again.count() == scored.where("predicted = 0").count()


def test_grammar():
    m = toxicity.Matcher({"idiot": 2.0, "scum": 2.0})
    plain = m.score("An idiot here.")[0]
    assert plain == 2.0
    assert m.score("You are an idiot.")[0] == pytest.approx(3.0)  # a target
    assert m.score("He is not an idiot.")[0] < plain  # negated
    assert m.score("She wrote idiot on it.")[0] < 3.0  # reported
    assert m.score("They will kill you.")[0] > 0  # a target before the threat
    assert m.score("To kill time.")[0] == 0  # a threat without a target
    assert m.score("idiotic; presscum") == (0.0, 0.0)  # inside other words
    assert m.score("idiot. scum")[0] == 4.0 and m.score("idiot. scum")[1] == 2.0


def test_near_copies_teach_no_insults(spark):
    rng = random.Random(1)
    body = ["".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(60)]
    rows = []
    for i in range(200):  # near copies of one toxic text, each with an edit
        own = list(body)
        own[i % 60] = f"edit{i}"
        rows.append((1, " ".join(own)))
    for i in range(400):
        mine = ["".join(rng.choice("hijklmn") for _ in range(6)) for _ in range(40)]
        if i % 4 == 0:
            mine[rng.randrange(40)] = "grobian"
        rows.append((1 if i % 4 == 0 else 0, " ".join(mine)))
    learned = toxicity.learned_insults(spark.createDataFrame(rows, "label int, text string"))
    assert set(learned) == {"grobian"}


def test_quality(spark, sf, docs, none):
    no_labels = labels(spark, sf).limit(0)
    check_scores(quality.quality(docs, no_labels), corpus())
    assert quality.quality(none, no_labels).count() == 0
    check_scores(quality.quality(docs, labels(spark, sf)), corpus())
    scored = quality.quality(documents(spark, sf), labels(spark, sf))
    assert held_out_accuracy(scored, spark, sf, "quality") > 0.9


def test_logistic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 2))
    y = (rng.random(2000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    w = logistic.fit(x, y)
    assert np.abs(w - [2, -1, 0.5]).max() < 0.3
    assert logistic.predict(logistic.fit(x[:0], y[:0]), x[:1])[0] == 0.5


def mix_expected(rows, weight_of, seed=0):
    import hashlib

    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), n in zip(rows, sizes, strict=True):
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(total.values()))
    while True:  # shares cut at three times the source, the excess reshared
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * total[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3 * total[s]
            left -= target[s]
        open_ -= full
    out = Counter()
    for s in names:
        own = []
        for (d, _, src), n in zip(rows, sizes, strict=True):
            if src == s:
                u = (int(hashlib.md5(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                own.append((-math.log(u) / weight_of(d), (d is not None, d or 0), n, d))
        epochs = int(target[s] + 1e-9) // total[s] if total[s] else 0
        rest = math.floor(target[s] + 1e-9) - epochs * total[s]
        for _, _, n, d in sorted(own):
            part = max(0, min(n, rest))
            rest -= part
            out[d, n, total[s], round(target[s], 6), epochs * n + part] += 1
    return out


def test_mixing(spark, docs, none):
    quality_of = spark.createDataFrame([(i, 2.0 if i % 2 else 0.5) for i in range(30)], "doc_id long, weight double")
    got = mixing.mix_sources(docs, quality_of)
    rows = Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got.collect())
    assert rows == mix_expected(corpus(), lambda d: 1.0 if d is None or d >= 30 else (2.0 if d % 2 else 0.5))
    assert mixing.mix_sources(none).count() == 0


def test_mixed_documents_hold_the_words_taken(docs):
    taken = mixing.mix_sources(docs).agg(F.sum("taken")).first()[0]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] == taken


def test_whole_mix_holds_unchanged_rows_nearest_the_target(spark):
    rng = np.random.default_rng(3)
    given = [(i, "  ".join(f"w{i}x{j}" for j in range(n)) + "\n end", f"s{i % 3}") for i, n in enumerate(rng.integers(1, 90, 60))]
    given += [(100, "\t".join(f"long{j}" for j in range(3000)), "hot"), (101, "one  two", "hot"), (102, None, "hot")]
    docs = spark.createDataFrame(given, "doc_id long, text string, source string")
    plan = mixing.mix_sources(docs).collect()
    got = Counter((r.doc_id, r.text, r.source) for r in mixing.mixed_documents(docs, whole=True).collect())
    text_of_id = {d: (t, s) for d, t, s in given}
    assert all(text_of_id[d] == (t, s) for d, t, s in got)
    expected = Counter()
    for r in plan:
        copies, part = divmod(r.taken, r.size) if r.size else (0, 0)
        copies += 2 * part >= r.size > 0
        if copies:
            expected[r.doc_id, *text_of_id[r.doc_id]] = copies
    assert got == expected
    assert any(r.size and r.taken % r.size for r in plan)  # some target falls into a document


def test_pipeline_mix_keeps_texts_unchanged(spark):
    from corpus_pipeline import mix

    from quiver.llm.common import documents

    docs = documents(spark, "/root/testdata/sf0.001")
    out = mix(spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns
    assert out.join(docs, ["doc_id", "text", "n_chars"], "left_anti").count() == 0


def neighbours(rows, queries, k):
    out = {}
    for q, v in queries:
        scored = sorted((-float(np.dot(v, x)), i) for i, x in rows if i != q)
        out[q] = [i for _, i in scored[:k]]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(600, 16))
    points[100:300] = points[100]  # one common vector
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(points)]
    odd = [(1000, None, "x"), (1001, [0.0] * 16, "x"), (1002, [1.0] * 15 + [float("nan")], "x"), (1003, [1.0] * 3, "x")]
    odd += [(1004, [1.0] * 15 + [None], "x"), (1005, [1.0] * 15 + [float("inf")], "x"), (None, [1.0] * 16, "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score string").repartition(3)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=7).collect()
    expected = neighbours(list(enumerate(points)), [(i, points[i]) for i in range(0, 600, 20)], 7)
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append(r.vec_id)
        assert r.score == pytest.approx(float(np.dot(points[r.query_id], points[r.vec_id])), abs=1e-12)
    assert set(found) == set(expected)
    hits = sum(len(set(found[q]) & set(expected[q])) for q in expected)
    assert hits >= 0.9 * 7 * len(expected)
    common = [i for i in found[200] if 100 <= i < 300]
    assert common and common == [i for i in range(100, 300) if i != 200][: len(common)]  # equal scores: smaller ids


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1, 1, 0.5), (0, 2, 2, 0.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_chi_square_quantile():
    rng = np.random.default_rng(0)
    draws = (rng.normal(size=(200_000, 8)) ** 2).sum(1)
    assert (draws <= ann.chi2_quantile(0.95)).mean() == pytest.approx(0.95, abs=0.003)
