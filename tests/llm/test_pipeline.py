"""The stages in order, each against brute force on the rows it was given."""

import hashlib
import re
import struct
from collections import Counter

import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from tiktoken.load import load_tiktoken_bpe

from quiver.llm.common import documents, keeps_columns, labels, written
from quiver.llm.mixing import label_quality, mix_sources
from quiver.llm.toxicity import toxicity

SF_SMALL = "/root/testdata/sf0.001"


def words(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_stages(spark):
    docs = documents(spark, SF_SMALL)
    columns = docs.columns
    outputs = []
    for _, stage in corpus_pipeline.STAGES:
        given = docs
        docs = written(stage(spark, given, SF_SMALL), "test-stage")
        outputs.append((given, docs))
    for _, out in outputs[:-1]:
        assert out.columns == columns

    given, out = outputs[0]
    clean = {r.doc_id for r in toxicity(given, labels(spark, SF_SMALL)).where("predicted = 0").collect()}
    assert {r.doc_id for r in out.collect()} == clean

    given, out = outputs[1]
    first = {}
    for r in sorted(given.collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert {r.doc_id for r in out.collect()} == set(first.values())

    given, out = outputs[2]
    sets = {r.doc_id: words(r.text) for r in given.collect()}
    group = {d: d for d in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    assert {r.doc_id for r in out.collect()} == {d for d in ids if find(d) == d}

    # the mix: unchanged rows; per source whole epochs, and its words within half a document of the target
    given, out = outputs[3]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    rows = {r.doc_id: r for r in given.collect()}
    times = Counter()
    for r in out.collect():
        assert r == rows[r.doc_id]
        times[r.doc_id] += 1
    targets = {r["source"]: r["target"] for r in mix_sources(given, label_quality(labels(spark, SF_SMALL))).collect()}
    for source, target in targets.items():
        own = [r for r in rows.values() if r.source == source]
        longest = max(size(r) for r in own)
        assert abs(sum(times[r.doc_id] * size(r) for r in own) - target) <= longest / 2 + 1
        epochs = int(target // max(1, sum(size(r) for r in own)))
        assert all(times[r.doc_id] in (epochs, epochs + 1) for r in own if size(r))

    given, out = outputs[4]
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("check", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    wanted = []
    for r in given.collect():
        ids = library.encode_ordinary(r.text or "")
        wanted.append((r.doc_id, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((r.text or "").encode())))
    assert sorted(tuple(r) for r in out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == sorted(wanted)


def test_stages_keep_columns_of_any_name(spark):
    """Names that the stages use themselves come back with their own values."""
    names = ["__id", "__hash", "__sha", "__taken", "__copy", "__copies", "__size", "class_id", "taken", "kept", "n", "s", "node"]
    docs = documents(spark, SF_SMALL)
    docs = docs.select(*docs.columns, *[F.concat(F.lit(f"{c} of "), F.col("doc_id")).alias(c) for c in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns, name
        assert out.count() > 0
        assert out.where(" OR ".join(f"`{c}` <> concat('{c} of ', doc_id) OR `{c}` IS NULL" for c in names)).isEmpty(), name
    plain = keeps_columns(lambda d: d.where("doc_id = 1"))(docs)
    assert plain.columns == docs.columns


def test_run_equals_the_stages(spark):
    assert corpus_pipeline.run(spark, SF_SMALL).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert len(corpus_pipeline.STAGES) == 5
