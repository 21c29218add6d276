"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside each partition.

A text is cut into the pattern's matches. Each distinct match that a task has not
met yet becomes rows (word, position, token) of a DuckDB table. One recursive query
joins neighbouring rows with the merge table and contracts, in every unfinished
word, the leftmost pair of least rank, until no word has a pair left. Words of over `LONG` bytes
are contracted turn by turn in a table that holds only their current rows, many pairs
a turn, so that rows stay in proportion to the bytes. A task keeps the ids of what it has
met in a bounded table, so that a word that returns is looked up; beyond the bound, words
that did not return for long are let go.

Decoding starts from a text's ids alone: their rows (text, position, token) join the
vocabulary table, and ordered aggregation puts the bytes together, `SPAN` ids at a time.

Cases: a null or empty text has no ids and decodes to nothing. Equal rows give
equal results, row by row. Very long texts and words pass whole. Extra columns of
the input are left out unless asked for.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wayfold.llm.frames import let_go, text_batches

VOCABULARY = "byte_bpe_50k.tiktoken"

#: White space of the pattern, spelled out: what Unicode calls White_Space.
_SPACE = "\t-\r \x85\xa0  -     　"
#: Pieces on whose borders every match of the pattern also ends: a run of other
#: characters with the blank before it, or white space as the pattern takes it.
_PIECE = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

SCHEMA = "doc_id long, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"

#: A turn keeps, of each word that still had a pair to contract, its rows after the
#: contraction; a word's rows of its last turn are its encoding. A row knows its right
#: neighbour. The pair chosen of a word is the least (rank, position), packed in one number.
_FIXPOINT = """
WITH RECURSIVE step(word, pos, tok, right_tok, right_pos, turn) AS (
    SELECT word, pos, tok, lead(tok) OVER w, lead(pos) OVER w, 0 FROM parts WINDOW w AS (PARTITION BY word ORDER BY pos)
  UNION ALL
    SELECT s.word, s.pos, CASE WHEN s.pos = b.pos THEN b.rank ELSE s.tok END,
           CASE WHEN s.pos = b.pos THEN b.after_tok WHEN s.right_pos = b.pos THEN b.rank ELSE s.right_tok END,
           CASE WHEN s.pos = b.pos THEN b.after_pos ELSE s.right_pos END, s.turn + 1
    FROM step s JOIN (
        SELECT gone.word, (a.best >> 32)::INT AS rank, (a.best & 4294967295)::INT AS pos, gone.pos AS gone, gone.right_tok AS after_tok, gone.right_pos AS after_pos
        FROM (
            SELECT s.word, min((m.rank::BIGINT << 32) | s.pos) AS best, arg_min(s.right_pos, (m.rank::BIGINT << 32) | s.pos) AS gone_pos
            FROM step s JOIN merges m ON m.left_tok = s.tok AND m.right_tok = s.right_tok GROUP BY s.word
        ) a JOIN step gone ON gone.word = a.word AND gone.pos = a.gone_pos
    ) b ON b.word = s.word AND s.pos <> b.gone
)
"""

#: Ids decoded by one query.
SPAN = 400_000

#: Words of more bytes than this are contracted by turns written back to a table. Blocks of
#: shorter ones end at `SQUARES`, as the recursive query's rows grow with a word's square.
LONG, SQUARES = 512, 6_000_000

#: One turn over the current rows of long words. `least` is, over a word's present pairs up to
#: a rank, the least rank of a pair that their contractions can form with what stands beside
#: them, contracted or not. While it is greater, the present pairs up to that rank come
#: before any new one: they are contracted by (rank, position), but for those that overlap a
#: contracted one. So a run of equal ranks that begins beside a greater rank is contracted at every
#: second pair (the last of the run only if no lesser rank follows), all such runs at once.
#: Where the least pair itself could form a lesser one, the leftmost of them goes alone.
_TURN = """
CREATE OR REPLACE TABLE turned AS
WITH n AS (SELECT word, pos, tok, lead(tok) OVER w AS right_tok FROM long WINDOW w AS (PARTITION BY word ORDER BY pos)),
p AS (SELECT n.word, n.pos, n.tok, m.rank FROM n LEFT JOIN merges m ON m.left_tok = n.tok AND m.right_tok = n.right_tok),
q AS (
    SELECT word, pos, tok, rank, row_number() OVER w AS i, lag(tok) OVER w AS tok_before, lead(tok, 2) OVER w AS tok_after, lead(rank, 2) OVER w AS next_rank,
           coalesce(lag(rank) OVER w, 2147483647) AS before, coalesce(lead(rank) OVER w, 2147483647) AS after
    FROM p WINDOW w AS (PARTITION BY word ORDER BY pos)
),
r AS (
    SELECT *, max(CASE WHEN rank IS NULL OR before <> rank THEN 2 * i + (before > rank)::INT END) OVER (PARTITION BY word ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run
    FROM q
),
v AS (
    SELECT r.word, r.pos, r.rank, r.after, r.i, r.run, least(coalesce(x.rank, 2147483647), coalesce(y.rank, 2147483647), coalesce(z.rank, 2147483647)) AS formed
    FROM r LEFT JOIN merges x ON x.left_tok = r.tok_before AND x.right_tok = r.rank LEFT JOIN merges y ON y.left_tok = r.rank AND y.right_tok = r.tok_after
    LEFT JOIN merges z ON z.left_tok = r.rank AND z.right_tok = r.next_rank WHERE r.rank IS NOT NULL
),
l AS (SELECT *, min(formed) OVER (PARTITION BY word ORDER BY rank) AS least, min((rank::BIGINT << 32) | pos) OVER (PARTITION BY word) AS best FROM v),
t AS (SELECT word, pos, rank FROM l WHERE rank < least AND run % 2 = 1 AND (i - run // 2) % 2 = 0 AND after >= rank OR rank >= least AND ((rank::BIGINT << 32) | pos) = best),
open AS (SELECT DISTINCT word FROM t)
SELECT word, pos, tok, done FROM (
    SELECT p.word, p.pos, coalesce(t.rank, p.tok) AS tok, open.word IS NULL AS done, lag(t.rank) OVER (PARTITION BY p.word ORDER BY p.pos) IS NOT NULL AS gone
    FROM p LEFT JOIN t ON t.word = p.word AND t.pos = p.pos LEFT JOIN open ON open.word = p.word
) WHERE NOT gone
"""


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """One DuckDB connection with the merge table, and the words met so far."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, keep: int = 150_000, memory_mb: int = 150):
        ranks = load_ranks(path)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.match, self.keep = regex.compile(pattern), keep
        self.pieces: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        # What one query of a very long word can't hold goes to the task's own scratch files, gone with the connection.
        scratch = os.path.join(tempfile.gettempdir(), f"bpe-{os.getpid()}")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{memory_mb}MB", "temp_directory": scratch})
        left, right, rank = (pa.array(c, pa.int32()) for c in zip(*pairs, strict=True))
        merges = pa.table({"left_tok": left, "right_tok": right, "rank": rank})  # noqa: F841  read by name below
        vocab = pa.table({"tok": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(ranks.keys(), pa.binary())})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE vocab AS SELECT tok, hex(bytes) AS bytes FROM vocab")

    def words(self, raw: list[bytes]) -> list[bytes]:
        """For each word (in UTF-8) its ids as little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(lengths) - lengths
        parts = pa.table({  # noqa: F841
            "word": np.repeat(np.arange(len(raw), dtype=np.int32), lengths),
            "pos": (np.arange(lengths.sum()) - np.repeat(starts, lengths)).astype(np.int32),
            "tok": self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)],
        })
        if lengths.max(initial=0) > LONG:
            every = self.contracted(parts)
        else:
            every = f"""
            {_FIXPOINT}, every AS (
                SELECT s.word, s.pos, s.tok FROM step s
                JOIN (SELECT word, max(turn) AS turn FROM step GROUP BY word) l ON l.word = s.word AND l.turn = s.turn
            )"""
        rows = self.db.sql(f"{every} SELECT word, tok FROM every ORDER BY word, pos").to_arrow_table()
        ends = np.searchsorted(rows["word"].to_numpy(), np.arange(len(raw)), side="right")
        ids, cuts = rows["tok"].to_numpy().astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def contracted(self, parts: pa.Table) -> str:
        """Contracts the words in the table `long`, whose finished words go to `coded`; the SQL that names these `every`."""
        self.db.execute("CREATE OR REPLACE TABLE long AS SELECT word, pos, tok FROM parts")
        self.db.execute("CREATE OR REPLACE TABLE coded (word INT, pos INT, tok INT)")
        while self.db.execute("SELECT count(*) FROM long").fetchone()[0]:
            self.db.execute(_TURN)
            self.db.execute("INSERT INTO coded SELECT word, pos, tok FROM turned WHERE done")
            self.db.execute("CREATE OR REPLACE TABLE long AS SELECT word, pos, tok FROM turned WHERE NOT done")
        self.db.execute("DROP TABLE turned")
        return "WITH every AS (FROM coded)"

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces, all their new words in a few recursive queries."""
        # Plain letters with at most one blank before them are one match of the pattern.
        mixed = [p for p in pieces if not ((q := p[1:] if p[0] == " " else p).isascii() and q.isalpha())]
        cut = {p: ws for p in mixed if len(ws := self.match.findall(p)) > 1}
        known = self.pieces
        new = list(({w for ws in cut.values() for w in ws} | (pieces - cut.keys())) - known.keys())
        raw = [w.encode() for w in new]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        for some in (np.flatnonzero(sizes <= LONG), np.flatnonzero(sizes > LONG)):
            # Blocks of some 300,000 bytes, and of short words some SQUARES, bound the queries' tables.
            own = sizes[some]
            block = np.cumsum(own) // 300_000 + (np.cumsum(own * own) // SQUARES if len(own) and own.max() <= LONG else 0)
            for part in np.split(some, np.flatnonzero(np.diff(block)) + 1) if len(some) else []:
                places = part.tolist()
                known.update(zip([new[k] for k in places], self.words([raw[k] for k in places]), strict=True))
        for p, ws in cut.items():
            known[p] = b"".join([known[w] for w in ws])

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids."""
        cut = [_PIECE.findall(t) for t in texts]
        if len(self.pieces) > self.keep:  # what the last generation didn't use goes
            self.old, self.pieces = self.pieces, {}
        want = set().union(*cut)
        fresh = want - self.pieces.keys()
        again = fresh & self.old.keys()
        self.pieces.update(zip(again, map(self.old.__getitem__, again), strict=True))
        self.learn(fresh - again)
        return [b"".join(map(self.pieces.__getitem__, pieces)) for pieces in cut]

    def decode(self, coded: list[bytes]) -> Iterator[bytes]:
        """The bytes that ids stand for: a join with the vocabulary and an ordered aggregation for each span of at most `SPAN` ids."""
        at = 0
        while at < len(coded):
            to, size = at + 1, len(coded[at]) // 4
            while to < len(coded) and size + len(coded[to]) // 4 <= SPAN:
                size += len(coded[to]) // 4
                to += 1
            sizes = [len(i) // 4 for i in coded[at:to]]
            flat = np.frombuffer(b"".join(coded[at:to]), "<u4").astype(np.int32)
            texts: list[list[bytes]] = [[] for _ in sizes]
            owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            for a in range(0, size, SPAN):
                rows = pa.table({"text": owner[a : a + SPAN], "pos": np.arange(a, min(size, a + SPAN)), "tok": flat[a : a + SPAN]})  # noqa: F841
                for k, joined in self.db.execute("SELECT text, string_agg(bytes, '' ORDER BY pos) FROM rows JOIN vocab USING (tok) GROUP BY text").fetchall():
                    texts[k].append(bytes.fromhex(joined))
            yield from map(b"".join, texts)
            at = to


_CODERS: dict[str, Encoder] = {}


def coder(path: str) -> Encoder:
    """The task's encoder for a vocabulary."""
    if path not in _CODERS:
        _CODERS[path] = Encoder(path)
    return _CODERS[path]


def finish(path: str) -> None:
    """A task's end: its worker lives on and must not hold the tables and words."""
    if (known := _CODERS.pop(path, None)) is not None:
        known.db.close()
        known.pieces, known.old = {}, {}
    let_go()


def encode(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ids (binary, little-endian unsigned 32 bits; null unless with_ids) and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary or public_tokenizers.path(VOCABULARY)
        known = coder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                coded = known.encode([t or "" for t in batch.column(1).to_pylist()])
                decoded = [(hashlib.sha256(d).hexdigest(), len(d)) for d in known.decode(coded)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).cast(pa.int64()), pa.array(coded if with_ids else [None] * len(coded), pa.binary()), pa.array([len(i) // 4 for i in coded], pa.int64()),
                        pa.array([hashlib.sha256(i).hexdigest() for i in coded], pa.string()), pa.array([d for d, _ in decoded], pa.string()), pa.array([n for _, n in decoded], pa.int64()),
                    ],
                    names=["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"],
                )

        finish(path)

    return text_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def decode(tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids) back to (doc_id, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = vocabulary or public_tokenizers.path(VOCABULARY)
        known = coder(path)
        for frame in frames:
            for at in range(0, len(frame), 64):
                part = frame.iloc[at : at + 64]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "text": [d.decode("utf-8", "replace") for d in known.decode([i or b"" for i in part["ids"]])]})
        finish(path)

    return tokens.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")
