"""Token-id output in Simple-8b blocks (operator 8).

Documents are range-partitioned by id, encoded with the tokenizers library and
closed with the end id; each task writes its shard as blocks of whole
documents: a Simple-8b payload, escapes, and the offsets a reader needs to
decode any document without touching other blocks.  The container is Parquet
(one row per block), written by Spark, so a lost task is simply written again
and any store Spark reaches will do.

A text is split at single spaces between two other characters, where the
vocabulary's own splitting pattern always splits too; each distinct piece
passes the library once per worker and is then taken from a bounded cache.
The library keeps its defaults, so an added token (``<|endoftext|>``) in a text
becomes its own id; a text that holds one passes the library as a whole.

Defined results: a null text is empty (only the end id); a null id sorts
first; repeated rows are separate documents; extra columns are ignored; an
empty table writes no block.
"""

from __future__ import annotations

import codecs
import os
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiver.llm import simple8b
from quiver.llm.common import text_of
from quiver.session import scratch_path

#: A block is closed by the first document that fills it to so many ids.
BLOCK_IDS = 1 << 18
#: Distinct pieces that a worker remembers at a time.
CACHE_PIECES = 800_000
#: Distinct pieces sent to the library in one string.
PIECES_PER_CALL = 2000

BLOCK_SCHEMA = """shard int, block int, first long, n_ids long, doc_ids array<long>, n_tokens array<int>,
    words binary, escape_at array<long>, escape_value array<decimal(20,0)>"""

#: Marks that are neither letters, digits nor white space.
_MARKS = string.punctuation


def _byte_shown() -> str:
    """The characters by which a byte-level vocabulary shows the bytes: the printable
    ones of Latin-1 as they are, the others in order from U+0100 on.  A newline
    stays, as it parts the words given to the model."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    shown = {b: chr(256 + i) for i, b in enumerate(others) if b != 0x0A}
    return "".join([shown.get(b, chr(b)) for b in range(256)])


_BYTE_SHOWN = _byte_shown()


class SpaceSplit:
    """Texts split at their single spaces: ``heads`` are the first pieces, one a
    text, ``distinct`` the different pieces after them."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern(texts, " ")
        self.bounds = lists.offsets.to_numpy()
        flat, first = lists.values, self.bounds[:-1]
        later = np.ones(len(flat), dtype=bool)
        later[first] = False
        coded = flat.filter(pa.array(later)).dictionary_encode()
        self.heads: list[str] = flat.take(pa.array(first)).to_numpy(zero_copy_only=False).tolist()
        self.distinct: list[str] = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        #: Number of every piece in ``[*distinct, *heads]``, in order.
        self.number = np.empty(len(flat), dtype=np.int64)
        self.number[later] = coded.indices.to_numpy()
        self.number[first] = len(self.distinct) + np.arange(len(first))

    def joined(self, values: list[bytes | None]) -> list[bytes | None]:
        """Per text the values (of ``[*distinct, *heads]``) of its pieces, one
        after the other; None where one of them is None."""
        taken = pa.array(values, pa.large_binary()).take(pa.array(self.number))
        lost = np.zeros(len(self.heads), dtype=bool)
        if taken.null_count:
            nulls = np.flatnonzero(taken.is_null().to_numpy(zero_copy_only=False))
            lost[np.searchsorted(self.bounds, nulls, "right") - 1] = True
        raw = taken.buffers()[2]
        cuts = np.frombuffer(taken.buffers()[1], dtype=np.int64)[self.bounds].tolist()
        view = memoryview(raw) if raw is not None else memoryview(b"")
        return [None if gone else view[a:b].tobytes() for a, b, gone in zip(cuts[:-1], cuts[1:], lost.tolist(), strict=True)]


class PieceEncoder:
    """Texts to packed little-endian 32-bit ids through the tokenizers library.
    ``encode_special_tokens`` is the library's switch (its own default is
    False): with True, special tokens in a text are encoded like other text.

    A piece is remembered by its text if it stands after a space, and by a space
    and its text if it stands after a newline or begins a text; no piece holds a
    space, so the two can't be confused."""

    def __init__(self, path: str, encode_special_tokens: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = encode_special_tokens
        added = self.library.get_added_tokens_decoder().values()
        self.added = [t.content for t in added if not (t.special and encode_special_tokens)]
        self.newline = self.library.encode("\n", add_special_tokens=False).ids[0]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, bytes | None] = {}
        self.tails: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _tail(self, tail: str) -> bytes:
        if tail not in self.tails:
            self.tails[tail] = self.whole(tail)
        return self.tails[tail]

    def _letters(self, keys: list[str]) -> None:
        """Ids of pieces that are letters only, so one word each: the library's
        model gets them as its pre-tokenizer would hand them on (a character
        per byte), without being asked where a word ends."""
        known, merge = self.known, self.library.model.tokenize
        for at in range(0, len(keys), PIECES_PER_CALL):
            part = keys[at : at + PIECES_PER_CALL]
            text = "\n".join([key[1:] if key[0] == " " else " " + key for key in part])
            shown, _ = codecs.charmap_decode(text.encode("utf-8", "surrogatepass"), "strict", _BYTE_SHOWN)
            ids: list[int] = []
            ends = [0]
            for word in shown.split("\n"):
                ids += [token.id for token in merge(word)]
                ends.append(4 * len(ids))
            raw = np.array(ids, dtype="<u4").tobytes()
            known.update(zip(part, [raw[a:b] for a, b in zip(ends, ends[1:])], strict=True))

    def _words(self, keys: list[str]) -> None:
        """Ids of pieces without white space."""
        known = self.known
        for at in range(0, len(keys), PIECES_PER_CALL):
            part = keys[at : at + PIECES_PER_CALL]
            # no white space in them, so the only newline ids are those before pieces
            joined = "".join(["\n" + key[1:] if key[0] == " " else "\n " + key for key in part])
            (encoding,) = self.library.encode_batch_fast([joined], add_special_tokens=False)
            ids = np.array(encoding.ids, dtype="<u4")
            cuts = (4 * np.flatnonzero(ids == self.newline)).tolist()
            raw = ids.tobytes()
            known.update(zip(part, [raw[a + 4 : b] for a, b in zip(cuts, [*cuts[1:], len(raw)])], strict=True))

    def _learn(self, keys: set[str]) -> None:
        """Ids of the pieces, or None where one can't stand alone (it is empty
        or white space stands at one of its ends).  Letters and the marks after
        them are always two words, and so is what single newlines part."""
        known = self.known
        letters = {key for key in keys if key.isalpha()}
        todo = list(keys - letters)
        plain, marked, lines, odd = [], [], [], []
        for key in todo:  # grows by the lines of a piece
            body = key.rstrip(_MARKS)
            if body.isalpha() or body[1:].isalpha() and body[0] == " ":
                letters.add(body)
                if body != key:
                    marked.append((key, body))
                continue
            piece = key[1:] if key[:1] == " " else key
            if not piece or piece[0].isspace() or piece[-1].isspace():
                known[key] = None
            elif len(piece.split()) == 1:
                plain.append(key)
            else:
                parts = key.replace("\n", "\n ").split("\n")
                bare = [parts[0].removeprefix(" "), *[part[1:] for part in parts[1:]]]
                if len(parts) > 1 and all([p and not p[0].isspace() and not p[-1].isspace() for p in bare]):
                    lines.append((key, parts))
                    new = [p for p in parts if p not in known and p not in keys]
                    keys.update(new)
                    todo += new
                else:
                    odd.append(key)
        self._letters([key for key in letters if key not in known])
        self._words(list(dict.fromkeys(plain)))
        for key, body in marked:
            known[key] = known[body] + self._tail(key[len(body) :])
        alone = [key[1:] if key[0] == " " else " " + key for key in odd]
        for key, encoding in zip(odd, self.library.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            known[key] = np.array(encoding.ids, dtype="<u4").tobytes()
        newline = np.array([self.newline], dtype="<u4").tobytes()
        for key, parts in lines:
            known[key] = newline.join([known[part] for part in parts])

    def _head(self, piece: str) -> bytes | None:
        """Ids of what a text begins with, None if it can't stand alone."""
        ids = self.known[" " + piece]
        if ids is None and piece and not piece[-1].isspace():
            return self.whole(piece)
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_PIECES:
            self._forget()
        column = pa.array(texts, pa.large_string())
        marked = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            marked |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        if marked.any():  # a text with an added token passes the library as a whole
            column = pc.if_else(pa.array(marked), "", column)
        split = SpaceSplit(column)
        known = self.known
        heads = [" " + piece for piece in split.heads]
        self._learn({key for key in chain(split.distinct, heads) if key not in known})
        ids = split.joined([*map(known.__getitem__, split.distinct), *map(self._head, split.heads)])
        return [self.whole(t) if m or i is None else i for t, m, i in zip(texts, marked.tolist(), ids, strict=True)]


@lru_cache(maxsize=2)
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path, encode_special_tokens=False)


def slices(texts: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, list[str]]]:
    """Parts of a column with about ``limit`` bytes each: (first row, texts)."""
    offsets = np.frombuffer(texts.cast(pa.large_string()).buffers()[1], dtype=np.int64)[
        texts.offset : texts.offset + len(texts) + 1
    ]
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit)))
        end = min(end, len(texts))
        yield at, texts.slice(at, end - at).to_pylist()
        at = end


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, shards: int | None = None) -> None:
    """Write ``docs`` (``doc_id``, ``text``) as token blocks in ascending id order."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    closing = np.array([end_id], dtype="<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        shard = TaskContext.get().partitionId()
        number, first, ids, lengths, coded, size = 0, 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            words, escapes = simple8b.encode(np.frombuffer(b"".join(coded), dtype="<u4"))
            return pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()),
                    "block": pa.array([number], pa.int32()),
                    "first": pa.array([first], pa.int64()),
                    "n_ids": pa.array([size], pa.int64()),
                    "doc_ids": pa.array([ids], pa.list_(pa.int64())),
                    "n_tokens": pa.array([lengths], pa.list_(pa.int32())),
                    "words": pa.array([words], pa.binary()),
                    "escape_at": pa.array([[a for a, _ in escapes]], pa.list_(pa.int64())),
                    "escape_value": pa.array([[v for _, v in escapes]], pa.list_(pa.decimal128(20, 0))),
                }
            )

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for at, texts in slices(batch.column("text")):
                for k, own in enumerate(encoder.encode(texts)):
                    ids.append(doc_ids[at + k])
                    lengths.append(len(own) // 4 + 1)
                    coded += [own, closing]
                    size += lengths[-1]
                    if size >= BLOCK_IDS:
                        yield close()
                        number, first, ids, lengths, coded, size = number + 1, first + size, [], [], [], 0
        if ids:
            yield close()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
        .repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, decoded from the blocks: ``doc_id``, ``start`` (ids of all
    documents before it), ``n_tokens`` and ``ids`` (packed little-endian
    32-bit)."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                escapes = list(zip(row["escape_at"], map(int, row["escape_value"]), strict=True))
                packed = simple8b.decode(row["words"], row["n_ids"], escapes).astype("<u4").tobytes()
                lengths = np.array(row["n_tokens"], dtype=np.int64)
                ends = np.cumsum(lengths)
                begins = ends - lengths
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([row["shard"]] * len(lengths), pa.int32()),
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "start": pa.array(row["first"] + begins),
                        "n_tokens": pa.array(lengths),
                        "ids": pa.array([packed[4 * a : 4 * b] for a, b in zip(begins, ends, strict=True)], pa.binary()),
                    }
                )

    docs = blocks.mapInArrow(decoded, "shard int, doc_id long, start long, n_tokens long, ids binary")
    # One row per shard: the number of shards bounds both this window and the broadcast.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        blocks.groupBy("shard")
        .agg(F.sum("n_ids").alias("n"))
        .select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    return docs.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")


def token_digest(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write the files, read them back, and return per document ``doc_id``,
    ``start``, ``n_tokens``, ``ids_crc32``."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, vocabulary, path, end_id)
    back = read_token_files(docs.sparkSession, path)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def ids_crc32(ids: list[int]) -> int:
    """The digest of one document's ids (for tests)."""
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
