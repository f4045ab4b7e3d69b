"""Quality by compression (operator 5).

Two zstandard dictionaries are trained, one on good and one on bad labelled
text.  A text is compressed in pieces under either; the difference of the two
sizes over the plain length says which kind it resembles, and their mean over
the plain length how repetitive it is.  A logistic curve over both,
fitted on labelled rows that no dictionary has seen, gives the score.

Defined results: a null or empty text gets the curve's value at a difference
of 0 and the mean ratio of the fitted rows; a null id is held out; repeated
rows are scored separately; extra columns are ignored; without labels of both
kinds the score is the share of label 1 (one half without any); an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm import logistic
from quiver.llm.common import held_out, training_ids

#: Labelled rows used for fitting, at most; half for the dictionaries, half for the curve.
TRAINING_ROWS = 12_000
#: Bytes of a piece, of a dictionary, and of all pieces a dictionary is trained on, at most.
PIECE, DICTIONARY, TRAINING_BYTES = 8_192, 65_536, 6_000_000
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    curve: tuple[float, ...]
    mean_ratio: float


def _pieces(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return [raw[at : at + PIECE] for at in range(0, len(raw), PIECE)]


def dictionary(texts: list[str]) -> bytes:
    """A zstandard dictionary from pieces of ``texts``; where there is too
    little to train one, the text itself serves."""
    pieces = [p for t in texts for p in _pieces(t)]
    taken = pieces[:: max(1, -(-sum(map(len, pieces)) // TRAINING_BYTES))]
    try:
        return zstandard.train_dictionary(DICTIONARY, taken).as_bytes()
    except zstandard.ZstdError:
        return b"".join(taken)[-DICTIONARY:]


class Sizer:
    def __init__(self, good: bytes, bad: bytes):
        self.compressors = [
            zstandard.ZstdCompressor(
                level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False
            )
            for d in (good, bad)
        ]

    def features(self, text: str) -> tuple[float, float] | None:
        """Difference over length, and log of mean size over length."""
        pieces = _pieces(text)
        if not pieces:
            return None
        good, bad = (sum(len(c.compress(p)) for p in pieces) for c in self.compressors)
        length = sum(map(len, pieces))
        return (good - bad) / length, float(np.log((good + bad) / (2 * length)))


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> Model:
    ids = F.broadcast(training_ids(labels, "quality", limit))  # at most limit rows of 12 bytes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id")
    rows = rows.where(F.length("text") > 0).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # of a very long text, pieces from all over it
            texts = ["".join(_spread(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(texts)], ["label", "text"])

    first = rows.where("half = 0").orderBy("doc_id").mapInArrow(bounded, "label int, text string").toPandas()
    texts = {k: [t for t, own in zip(first["text"], first["label"], strict=True) if own == k] for k in (0, 1)}
    if not texts[0] or not texts[1]:
        shares = rows.select(F.avg("label")).first()[0]
        p = min(max(0.5 if shares is None else shares, 0.01), 0.99)
        return Model(b"", b"", (0.0, 0.0, float(np.log(p / (1 - p)))), 0.0)
    good, bad = dictionary(texts[1]), dictionary(texts[0])
    fitted = sizes(rows.where("half = 1").select("label", "text"), good, bad).dropna().toPandas()
    x = fitted[["difference", "ratio"]].to_numpy(dtype=float)
    curve = logistic.fit(x, fitted["label"].to_numpy())
    return Model(good, bad, tuple(float(w) for w in curve), float(x[:, 1].mean()) if len(x) else 0.0)


def _spread(text: str, count: int = 4) -> list[str]:
    """``text``, or ``count`` pieces spread over it if it is longer."""
    size = PIECE // 4
    if len(text) <= count * size:
        return [text]
    step = (len(text) - size) / (count - 1)
    return [text[int(k * step) : int(k * step) + size] for k in range(count)]


def sizes(docs: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """``docs`` with ``difference`` and ``ratio`` instead of ``text`` (null for empty texts)."""
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(good, bad)
        for batch in batches:
            found = [sizer.features(t.as_py() or "") or (None, None) for t in batch.column("text")]
            columns = [batch.column(f.name) for f in kept]
            columns += [pa.array([x[k] for x in found], pa.float64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, [*[f.name for f in kept], "difference", "ratio"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["difference double", "ratio double"])
    return docs.mapInArrow(measure, schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, limit: int = TRAINING_ROWS) -> DataFrame:
    """Per document ``doc_id``, ``held_out``, ``score``, ``predicted``."""
    model = train(docs, labels, limit)
    measured = sizes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model.good, model.bad)
    a, b, c = model.curve
    line = (
        a * F.coalesce(F.col("difference"), F.lit(0.0)) + b * F.coalesce(F.col("ratio"), F.lit(model.mean_ratio)) + c
    )
    score = 1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(30.0)), F.lit(-30.0))))
    return measured.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
