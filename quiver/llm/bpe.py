"""Byte-level BPE by recursive queries (operator 6).

Texts are cut by the vocabulary's pattern.  In each partition an in-process
DuckDB holds the merge table; a recursive query carries one row per (word,
token position), joins neighbouring tokens with the merge table and contracts
each word's leftmost pair of minimum rank until no pair of any word merges.
Decoding joins ids with the vocabulary and aggregates the pieces in order.

Spark deals out the documents; a worker keeps the merge table and a bounded
cache of words it has already contracted, so memory doesn't grow with the
table.  Words longer than ``LONG_WORD`` bytes contract all occurrences of the
pair of minimum rank in one step where that can't change the outcome (no token
made from the pair has a smaller rank), else the leftmost.

Defined results: a null text is empty and has no tokens; repeated rows are
encoded separately; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import ctypes
import gc
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import text_of
from quiver.llm.token_files import SpaceSplit, slices

#: Distinct pieces and words of a generation; a worker remembers two.
CACHE_PIECES = 160_000
#: Seconds without a task until a worker drops what its codecs remember.
IDLE_SECONDS = 3.0
#: Rows that one recursive query may keep: a word of n bytes has at most n (n + 1) / 2.
ROWS_PER_QUERY = 2_000_000
LONG_WORD = 128
#: Ids decoded by one query, about.
IDS_PER_QUERY = 400_000

#: White space as Python has it, for the regular expressions of Arrow.
_WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_UNSAFE = f"{_WHITE} | {_WHITE}|^ | $"

# A row is a token of a word: its position (of its first byte), the token after
# it, and the key (rank, position) of the pair it begins, if that pair merges.
_CONTRACT = """
    WITH RECURSIVE state AS (
        SELECT word, pos, tok, nxt, npos, m.key + s.pos AS key, 0 AS step
        FROM start s LEFT JOIN merges m ON m.a = s.tok AND m.b = s.nxt
      UNION ALL
        SELECT n.word, n.pos, n.tok, n.nxt, n.npos,
               CASE WHEN n.changed THEN m.key + n.pos ELSE n.key END, n.step + 1
        FROM (
            SELECT s.word, s.pos, s.step, s.key,
                   CASE WHEN s.pos = c.pos THEN c.tok ELSE s.tok END AS tok,
                   CASE WHEN s.pos = c.pos THEN c.nxt WHEN s.npos = c.pos THEN c.tok ELSE s.nxt END AS nxt,
                   CASE WHEN s.pos = c.pos THEN c.npos ELSE s.npos END AS npos,
                   s.pos = c.pos OR coalesce(s.npos = c.pos, false) AS changed
            FROM state s JOIN (
                SELECT b.word, (b.key & 4294967295)::INTEGER AS pos, (b.key >> 32)::INTEGER AS tok,
                       b.gone, r.nxt, r.npos
                FROM (SELECT word, min(key) AS key, arg_min(npos, key) AS gone
                      FROM state WHERE key IS NOT NULL GROUP BY word) b
                JOIN state r ON r.word = b.word AND r.pos = b.gone
            ) c ON c.word = s.word AND s.pos <> c.gone
        ) n LEFT JOIN merges m ON n.changed AND m.a = n.tok AND m.b = n.nxt
    )
    SELECT word, pos, tok FROM state JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) USING (word, step)
    ORDER BY word, pos"""

def _long_step(con: duckdb.DuckDBPyConnection) -> int:
    """One contraction of table ``long`` (word, pos, tok); number of merges.

    All pairs of a word's minimum rank are contracted (of pairs that overlap,
    every other one), or the leftmost alone where the product isn't safe.  A
    recursion would keep every step's rows, so long words go step by step.
    """
    con.execute("""
        CREATE OR REPLACE TEMP TABLE chosen AS
        WITH seen AS (
            SELECT word, pos, tok, row_number() OVER w AS place, lead(tok) OVER w AS nxt, lead(pos) OVER w AS npos
            FROM long WINDOW w AS (PARTITION BY word ORDER BY pos)),
        pairs AS (
            SELECT s.*, (m.key >> 32)::INTEGER AS made, m.safe, min(m.key) OVER (PARTITION BY word) >> 32 AS least
            FROM seen s JOIN merges m ON m.a = s.tok AND m.b = s.nxt),
        hits AS (
            SELECT *, row_number() OVER (PARTITION BY word ORDER BY pos) AS hit FROM pairs WHERE made = least),
        runs AS (
            SELECT *, row_number() OVER (PARTITION BY word, place - hit ORDER BY pos) AS in_run FROM hits)
        SELECT word, pos, npos AS gone, made FROM runs WHERE CASE WHEN safe THEN in_run % 2 = 1 ELSE hit = 1 END""")
    merges = con.execute("SELECT count(*) FROM chosen").fetchall()[0][0]
    if merges:
        con.execute("""
            CREATE OR REPLACE TEMP TABLE long AS
            SELECT l.word, l.pos, coalesce(c.made, l.tok) AS tok
            FROM long l LEFT JOIN chosen c ON c.word = l.word AND c.pos = l.pos
            WHERE NOT EXISTS (SELECT 1 FROM chosen g WHERE g.word = l.word AND g.gone = l.pos)""")
    return merges


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _parts(words: list[tuple[str, bytes]], long: bool) -> Iterator[list[tuple[str, bytes]]]:
    """Words by length (those of one query end after about as many steps), in
    parts whose queries keep ``ROWS_PER_QUERY`` rows at most, or one word."""
    words = sorted(words, key=lambda word: len(word[1]))
    at = rows = 0
    for end, (_, raw) in enumerate(words):
        own = len(raw) if long else len(raw) * (len(raw) + 1) // 2
        if rows + own > ROWS_PER_QUERY and end > at:
            yield words[at:end]
            at, rows = end, 0
        rows += own
    if words:
        yield words[at:]


class _Recent:
    """Values of the keys used lately, in two generations: when the younger is
    full it becomes the older, and what was used in neither is forgotten."""

    def __init__(self, room: int):
        self.room = room
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self.young) > self.room:
            self.old, self.young = self.young, {}

    def missing(self, keys: set[str]) -> set[str]:
        """The keys without a value; all others are in ``young`` afterwards."""
        absent = keys.difference(self.young)
        old = self.old
        known = {key: old[key] for key in absent if key in old}
        self.young.update(known)
        return absent.difference(known)


def _key(word: str) -> str:
    """A word's name among the remembered pieces, which hold no space and stand
    after one: the text after its space, or a space and the word if it has none
    (or white space alone)."""
    return word[1:] if word[0] == " " and word[1:2] not in ("", " ") else " " + word


class RankCodec:
    """Encoder and decoder over one rank file, backed by an in-process DuckDB."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.known = _Recent(CACHE_PIECES)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self.tables: set[str] = set()

    def _need(self, name: str) -> None:
        """Make a table when it is first used: a worker mostly encodes or decodes."""
        if name not in self.tables:
            self.db.register("given", self._merges() if name == "merges" else self._vocabulary())
            self.db.execute(f"CREATE TABLE {name} AS FROM given")
            self.db.unregister("given")
            self.tables.add(name)

    def _merges(self) -> pa.Table:
        pairs = [
            (self.ranks[token[:cut]], self.ranks[token[cut:]], rank)
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in self.ranks and token[cut:] in self.ranks
        ]
        a, b, made = (np.array(x, dtype=np.int32) for x in zip(*pairs, strict=True))
        least_with = np.full(max(self.ranks.values()) + 1, np.iinfo(np.int32).max, dtype=np.int32)
        np.minimum.at(least_with, a, made)
        np.minimum.at(least_with, b, made)
        return pa.table({"a": a, "b": b, "key": made.astype(np.int64) << 32, "safe": least_with[made] > made})

    def _vocabulary(self) -> pa.Table:
        pieces = [token.decode("latin-1") for token in self.ranks]  # a character per byte
        return pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "piece": pa.array(pieces)})

    def _contract(self, words: list[bytes], long: bool) -> list[bytes]:
        """Packed ids of each word."""
        self._need("merges")
        lengths = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = (np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        tok = self.byte[data]
        last = np.append(word[1:] != word[:-1], True)
        start = pa.table(
            {
                "word": word,
                "pos": pos,
                "tok": tok,
                "nxt": pa.array(np.append(tok[1:], 0).astype(np.int32), mask=last),
                "npos": pa.array(pos + 1, mask=last),
            }
        )
        self.db.register("start", start)
        if long:
            self.db.execute("CREATE OR REPLACE TEMP TABLE long AS SELECT word, pos, tok FROM start")
            while _long_step(self.db):
                pass
            rows = self.db.sql("SELECT word, pos, tok FROM long ORDER BY word, pos").to_arrow_table()
        else:
            rows = self.db.sql(_CONTRACT).to_arrow_table()
        self.db.unregister("start")
        ids = rows["tok"].to_numpy().astype("<u4").tobytes()
        cuts = (4 * np.searchsorted(rows["word"].to_numpy(), np.arange(len(words) + 1))).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, keys: set[str]) -> None:
        """Packed ids of the words that have these keys."""
        short, long = [], []
        known = self.known.young
        for key in keys:
            raw = (key[1:] if key[0] == " " else " " + key).encode("utf-8", "surrogatepass")
            rank = self.ranks.get(raw)
            if rank is not None:
                known[key] = rank.to_bytes(4, "little")
            else:
                (long if len(raw) > LONG_WORD else short).append((key, raw))
        for group, is_long in ((short, False), (long, True)):
            for part in _parts(group, is_long):
                for (key, _), ids in zip(part, self._contract([raw for _, raw in part], is_long), strict=True):
                    known[key] = ids

    def _cut(self, pieces: list[str]) -> dict[str, list[str]]:
        """The words of each piece as it stands after a space.

        Pieces hold no space, so in a text of many pieces each word that begins
        with one begins a piece; one that ends in other white space is cut alone,
        because the pattern looks at what follows there."""
        alone = {piece for piece in pieces if piece[-1].isspace()}
        cut = {piece: self.find(" " + piece) for piece in alone}
        joined = [piece for piece in pieces if piece not in alone]
        words = self.find("".join([" " + piece for piece in joined]))
        begins = [i for i, word in enumerate(words) if word[0] == " "]
        begins.append(len(words))
        cut.update((piece, words[a:b]) for piece, a, b in zip(joined, begins[:-1], begins[1:], strict=True))
        return cut

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian 32-bit ids of each text."""
        self.known.turn()
        # A space between two other characters always begins a word, so a
        # text splits there into pieces that are looked up as a whole.
        column = pa.array(texts, pa.large_string())
        unsafe = pc.match_substring_regex(column, _UNSAFE)
        split = SpaceSplit(pc.if_else(unsafe, "", column))
        begins = [text if odd else head for text, odd, head in zip(texts, unsafe.to_pylist(), split.heads, strict=True)]
        heads = [[_key(word) for word in self.find(text)] for text in begins]
        missing = self.known.missing(set(split.distinct))
        cut = self._cut([piece for piece in missing if not piece.isalpha()])  # letters are one word
        several = {piece: [_key(word) for word in words] for piece, words in cut.items() if len(words) > 1}
        needed = missing.difference(several).union(*heads, *several.values())
        self._learn(self.known.missing(needed))
        word = self.known.young.__getitem__
        self.known.young.update([(piece, b"".join(map(word, keys))) for piece, keys in several.items()])
        return split.joined([*map(word, split.distinct), *[b"".join(map(word, keys)) for keys in heads]])

    def decode(self, packed: list[bytes]) -> list[bytes]:
        self._need("vocabulary")
        lengths = np.array([len(p) // 4 for p in packed], dtype=np.int64)
        ids = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32)
        rows = pa.table(
            {
                "doc": np.repeat(np.arange(len(packed), dtype=np.int32), lengths),
                "pos": np.arange(len(ids), dtype=np.int32),
                "id": ids,
            }
        )
        self.db.register("given_ids", rows)
        texts = self.db.sql("""
            SELECT doc, string_agg(piece, '' ORDER BY pos) AS text, count(*) AS n
            FROM given_ids JOIN vocabulary USING (id) GROUP BY doc""").to_arrow_table()
        self.db.unregister("given_ids")
        if sum(texts["n"].to_pylist()) != len(ids):
            raise ValueError("an id is not in the vocabulary")
        out = [b""] * len(packed)
        for doc, text in zip(texts["doc"].to_pylist(), texts["text"].to_pylist(), strict=True):
            out[doc] = text.encode("latin-1")
        return out


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> RankCodec:
    return RankCodec(path, pattern)


class _Lease:
    """Use of a worker's codecs by its tasks.

    Spark's workers outlive a stage, and what a codec remembers (some hundred MB)
    would stay with them; it goes when no task has used it for a while."""

    def __init__(self) -> None:
        self.lock, self.users, self.timer = threading.Lock(), 0, None

    @contextmanager
    def codec(self, path: str, pattern: str) -> Iterator[RankCodec]:
        with self.lock:
            self.users += 1
            if self.timer:
                self.timer.cancel()
        try:
            yield codec(path, pattern)
        finally:
            with self.lock:
                self.users -= 1
                self.timer = threading.Timer(IDLE_SECONDS, self.drop)
                self.timer.daemon = True
                self.timer.start()

    def drop(self) -> None:
        with self.lock:
            if self.users:
                return
            codec.cache_clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:  # gives freed memory back to the system, where the C library can
                trim(0)


_lease = _Lease()


def leased(path: str, pattern: str):
    """The worker's codec for one task (``with``)."""
    return _lease.codec(path, pattern)


def bpe_encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` (packed little-endian 32-bit) per document."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with leased(ranks, pattern) as own:
            for batch in batches:
                for at, texts in slices(batch.column("text"), 2 << 20):
                    ids = pa.array(own.encode(texts), pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), ids], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids binary")


def _decoded(own: RankCodec, doc_ids: pa.Array, packed: list[bytes]) -> Iterator[pa.RecordBatch]:
    """``doc_id``, ``ids``, ``decoded``, about ``IDS_PER_QUERY`` ids at a time."""
    at = 0
    while at < len(packed):
        end, size = at, 0
        while end < len(packed) and size < IDS_PER_QUERY * 4:
            size += len(packed[end])
            end += 1
        part = packed[at:end]
        columns = [doc_ids.slice(at, end - at), pa.array(part, pa.binary()), pa.array(own.decode(part), pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])
        at = end


def bpe_decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``encoded`` (``doc_id``, ``ids``) with the bytes its ids stand for: ``decoded``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with leased(ranks, pattern) as own:
            for batch in batches:
                yield from _decoded(own, batch.column("doc_id"), batch.column("ids").to_pylist())

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids binary, decoded binary")


def bpe_round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` by encoding and decoding in one
    Python worker per task instead of two."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with leased(ranks, pattern) as own:
            for batch in batches:
                for at, texts in slices(batch.column("text"), 2 << 20):
                    yield from _decoded(own, batch.column("doc_id").slice(at, len(texts)), own.encode(texts))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(both, "doc_id long, ids binary, decoded binary")


def bpe_digest(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Encode, decode, and return per document ``doc_id``, ``n_tokens``,
    ``ids_sha256``, ``decoded_sha256``."""
    return bpe_round_trip(docs, ranks, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
