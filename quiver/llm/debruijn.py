"""Substring dedup by de Bruijn compaction (operator 10).

Windows of 20 words are the edges of a de Bruijn graph over the corpus.  The
graph is never stored edge by edge: a super-k-mer is a stretch of edges under
one minimizer, equal ones collapse to a path with its occurrences, and only
where a minimizer branches into several paths are its edges taken one by one
(see ``repeats``).  Repeated paths that continue each other, in the text and in
what they repeat, are compacted into long spans by a Spark window over each
text's paths; each span is verified against its source coordinates (another
128-bit hash of the words' bytes on either side), and a mismatch repeats the
work under other hashes.

A word goes if a window that covers it also starts earlier: in a document with
a smaller id, or earlier in the same one.

Defined results: a null text has no words; a null id sorts last; rows that
share an id and a text are one document (neither makes the other go); of rows
that share an id and differ in text, the smaller SHA-256 is earlier; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm import repeats
from quiver.llm.common import SPACE, written
from quiver.llm.repeats import OPEN, Windows
from quiver.llm.tokens import text_slices, words

WINDOW_WORDS, MINIMIZER_WORDS = 20, 6


def substring_dedup(docs: DataFrame, window: int = WINDOW_WORDS, minimizer: int = MINIMIZER_WORDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``."""
    w = Windows("words", window, min(minimizer, window), first_stays=True)
    rows = repeats.identified(docs)
    w, (texts, spans) = repeats.checked(w, lambda w: _repeated(w, rows))
    kept = _kept(w, texts, spans)
    norm = F.trim(F.regexp_replace("text", SPACE, " "))
    plain = rows.select(
        "doc",
        "doc_id",
        F.when(norm == "", 0).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "))) + 1).cast("long").alias("n_words"),
        F.sha2(norm, 256).alias("plain"),
    )
    return plain.join(kept.hint("merge"), "doc", "left").select(
        "doc_id", "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("sha", "plain").alias("kept_sha256"),
    )


def _repeated(w: Windows, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts that take part in a repeat or a branch, and the long spans that repeat."""
    settled = written(repeats.settle(w, repeats.paths(w, rows), True), "bruijn-paths")
    opened = settled.where(repeats.kind() == OPEN).groupBy("doc").agg(F.collect_list("at").alias("open"))
    texts = repeats.affected(w, rows, settled, opened)
    singles = repeats.single_windows(w, texts.where("open is not null").select("doc", "text", "open"))
    single = written(singles, "bruijn-singles")
    found = repeats.pieces(settled).unionByName(repeats.pieces(single))
    return texts, written(repeats.compacted(found), "bruijn-spans")


def _kept(w: Windows, texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc``, ``n_removed``, ``sha`` of the texts with repeated spans."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            spans_of = batch.column("spans")
            for at, data, offsets in text_slices(batch.column("text")):
                starts, ends, first = words(data, offsets)
                counts, shas = [], []
                for t in range(len(offsets) - 1):
                    own = np.array(spans_of[at + t].as_py(), dtype=np.int64)
                    a, b = first[t], first[t + 1]
                    gone = repeats.covered(b - a, own >> 32, own & 0xFFFFFFFF, w.k)
                    counts.append(int(gone.sum()))
                    shas.append(hashlib.sha256(repeats.stretch(data, starts[a:b][~gone], ends[a:b][~gone])).hexdigest())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc": pa.array(docs[at : at + len(counts)]),
                        "n_removed": pa.array(counts, pa.int64()),
                        "sha": pa.array(shas, pa.string()),
                    }
                )

    packed = F.shiftleft("start", 32).bitwiseOR(F.col("n"))
    grouped = spans.groupBy("doc").agg(F.collect_list(packed).alias("spans"))
    joined = texts.select("doc", "text").join(grouped.hint("merge"), "doc")
    return joined.mapInArrow(keep, "doc long, n_removed long, sha string")
