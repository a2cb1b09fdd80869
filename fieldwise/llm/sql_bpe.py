"""Byte-level BPE by recursive SQL in each Spark task.

Inside a task DuckDB holds the merge table (in memory) and encodes the distinct pieces of the
task's texts: a table of (piece, position, token) is joined to the merges, every piece
contracts its leftmost minimum-rank pair, and the query recurses until no pair is left.
Decoding joins tokens to their bytes and concatenates them by an ordered aggregate.

The recursion keeps the rows of every step, so lots are sized by rows, and a long piece is
encoded in overlapping windows.  Tokens are the encoding of their bytes whenever every two
neighbours are the encoding of theirs: the first merge across a border between two tokens
would also happen in those two alone.  Two encodings that have a token in common, at the same
place, may therefore be joined at it.  Where windows have none in common, a new one begins at
a token of the part already joined, further back each time.  Such a window may grow long; it
contracts all places of its pair in one step, which is what repeating the step would do, as a
pair made by a merge ranks after it.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .units import Codes, splitter

#: Bytes of text that are encoded at a time: what a process needs for it, it keeps.
TEXT_BYTES = 1 << 19
#: Bytes of pieces that one recursive query takes.
LOT_BYTES = 1 << 19
#: Pieces of more bytes are cut into windows of LONG bytes that share OVERLAP bytes; longer
#: windows contract all places of their pair in a step, at most STEPS steps a query.
LONG, OVERLAP, STEPS = 256, 64, 64
#: Rows that the steps of one recursive query may add up to (16 bytes each, of 300 MB).
LOT_ROWS = 1 << 22
#: Tokens that one decoding query takes.
LOT_TOKENS = 1 << 18

#: One contraction per piece and step: at the smallest (merged token, position).
CONTRACT = """
WITH RECURSIVE steps(piece, pos, token, step) AS (
    SELECT piece, pos, token, 0 FROM start
  UNION ALL (
    WITH best AS (
        SELECT l.piece, min(merged::BIGINT * 4294967296 + l.pos) AS low
        FROM steps l JOIN steps r ON r.piece = l.piece AND r.pos = l.pos + 1
        JOIN merges m ON m.lhs = l.token AND m.rhs = r.token
        GROUP BY l.piece
    ), place AS (
        SELECT piece, (low // 4294967296)::INT AS merged, (low % 4294967296)::INT AS spot FROM best
    )
    SELECT piece, CASE WHEN pos > spot THEN pos - 1 ELSE pos END,
           CASE WHEN pos = spot THEN merged ELSE token END, step + 1
    FROM steps JOIN place USING (piece) WHERE pos != spot + 1
  )
)
SELECT piece, token, step
FROM steps JOIN (SELECT piece, max(step) AS step FROM steps GROUP BY piece) USING (piece, step)
ORDER BY piece, pos
"""

#: For long pieces: all places of the minimum-rank pair, from the left and without overlap.
CONTRACT_ALL = """
WITH RECURSIVE steps(piece, pos, token, step) AS (
    SELECT piece, pos, token, 0 FROM start
  UNION ALL (
    WITH pairs AS (
        SELECT s.*, m.merged
        FROM (SELECT *, lead(token) OVER w AS nxt, row_number() OVER w AS n
              FROM steps WHERE step < $steps WINDOW w AS (PARTITION BY piece ORDER BY pos)) s
        LEFT JOIN merges m ON m.lhs = s.token AND m.rhs = s.nxt
    ), lowest AS (
        SELECT *, coalesce(merged = min(merged) OVER (PARTITION BY piece), false) AS hit,
               min(merged) OVER (PARTITION BY piece) AS low FROM pairs
    ), runs AS (
        SELECT *, n - row_number() OVER (PARTITION BY piece, hit ORDER BY n) AS island
        FROM lowest WHERE low IS NOT NULL
    ), taken AS (
        SELECT *, hit AND row_number() OVER (PARTITION BY piece, hit, island ORDER BY n) % 2 = 1 AS take
        FROM runs
    ), gone AS (
        SELECT *, coalesce(lag(take) OVER (PARTITION BY piece ORDER BY n), false) AS second FROM taken
    )
    SELECT piece, pos, CASE WHEN take THEN low ELSE token END, step + 1 FROM gone WHERE NOT second
  )
)
SELECT piece, token, step
FROM steps JOIN (SELECT piece, max(step) AS step FROM steps GROUP BY piece) USING (piece, step)
ORDER BY piece, pos
"""

DECODE = """
SELECT piece, string_agg(hexed, '' ORDER BY pos) AS hexed
FROM tokens JOIN vocabulary USING (token) GROUP BY piece
"""


class Merges:
    """One in-memory DuckDB with the merge table; every task's process makes its own."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.ids = {token: rank.to_bytes(4, "little") for token, rank in self.ranks.items()}
        self.all_ids = np.array(list(self.ranks.values()))
        self.sizes = np.zeros(self.all_ids.max() + 1, np.int64)
        self.sizes[self.all_ids] = [len(token) for token in self.ranks]
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        lhs, rhs, merged = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    lhs.append(a), rhs.append(b), merged.append(rank)
        self.db = duckdb.connect(":memory:")
        self.db.execute("SET threads = 1; SET memory_limit = '300MB'; SET preserve_insertion_order = false; SET temp_directory = ''")
        self._table("merges", {"lhs": pa.array(lhs, pa.int32()), "rhs": pa.array(rhs, pa.int32()), "merged": pa.array(merged, pa.int32())})
        self._table("vocabulary", {"token": pa.array(list(self.ranks.values()), pa.int32()), "hexed": pa.array([t.hex() for t in self.ranks])})
        self.codes = Codes(splitter(pattern), self._encode_pieces)

    def _table(self, name: str, columns: dict) -> None:
        rows = pa.table(columns)  # noqa: F841  read by name
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")

    def _recurse(self, pieces: list[np.ndarray], query: str, **given) -> Iterator[tuple[bytes, int]]:
        """Ids and last step of each piece."""
        sizes = np.array([len(p) for p in pieces])
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        start = pa.table({
            "piece": pa.array(np.repeat(np.arange(len(pieces)), sizes), pa.int32()),
            "pos": pa.array(np.arange(len(first)) - first, pa.int32()),
            "token": pa.array(np.concatenate(pieces), pa.int32()),
        })
        self.db.register("start", start)
        found = self.db.execute(query, given or None).fetchnumpy()
        flat = found["token"].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(found["piece"], minlength=len(pieces)))).tolist()
        begins = [0, *ends[:-1]]
        steps = found["step"][[e // 4 - 1 for e in ends]].tolist()
        return zip([flat[a:b] for a, b in zip(begins, ends)], steps)

    def _contract(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian, four bytes) of each piece."""
        cut = [range(0, max(1, len(p) - OVERLAP) if len(p) > LONG else 1, LONG - OVERLAP) for p in pieces]
        done = {p[b : b + LONG]: b"" for p, begins in zip(pieces, cut) for b in begins}
        lot, rows = [], 0
        for i, window in enumerate(done, 1):
            lot.append(window)
            rows += len(window) * (len(window) + 1) // 2
            if rows + LONG * LONG > LOT_ROWS or i == len(done):
                tokens = [self.single[np.frombuffer(w, np.uint8)] for w in lot]
                done.update((w, ids) for w, (ids, _) in zip(lot, self._recurse(tokens, CONTRACT)))
                lot, rows = [], 0
        return [done[p] if len(p) <= LONG else self._joined(p, begins, done) for p, begins in zip(pieces, cut)]

    def _joined(self, piece: bytes, begins: range, done: dict[bytes, bytes]) -> bytes:
        """Ids of a long piece from those of its windows."""
        ids, starts = self._placed(done[piece[:LONG]], 0)
        for begin in begins[1:]:
            end, back = begin + LONG, 8
            while True:
                new, places = self._placed(self._window(piece[begin:end], done), begin)
                at = bisect.bisect_left(starts, begin)
                held = dict(zip(zip(starts[at:], ids[at:]), range(at, len(ids))))
                common = next((j for j, token in enumerate(zip(places, new)) if token in held), None)
                if common is not None or begin == 0:
                    break
                back *= 2
                begin = starts[-back] if back < len(starts) else 0
            common = common or 0
            keep = held.get((places[common], new[common]), 0)
            ids[keep:], starts[keep:] = new[common:], places[common:]
        return np.array(ids, "<u4").tobytes()

    def _placed(self, ids: bytes, begin: int) -> tuple[list[int], list[int]]:
        """Ids and the byte at which each begins."""
        flat = np.frombuffer(ids, "<u4")
        sizes = self.sizes[flat]
        return flat.tolist(), (begin + np.cumsum(sizes) - sizes).tolist()

    def _window(self, window: bytes, done: dict[bytes, bytes]) -> bytes:
        """Ids of a window of any length; what short ones gave is remembered."""
        if window not in done:
            tokens = self.single[np.frombuffer(window, np.uint8)]
            most = step = max(1, min(STEPS, LOT_ROWS // len(tokens)))
            while step == most:
                ((ids, step),) = self._recurse([tokens], CONTRACT_ALL, steps=most)
                tokens = np.frombuffer(ids, "<u4").astype(np.int32)
            if len(window) > 4 * LONG:
                return ids
            done[window] = ids
        return done[window]

    def _encode_pieces(self, pieces: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded ids) of each piece; a piece in the vocabulary needs no contraction."""
        raws = [p.encode() for p in pieces]
        ids = [self.ids.get(raw) for raw in raws]
        lot, size = [], 0
        for i, raw in enumerate(raws):
            if ids[i] is None:
                lot.append(i)
                size += len(raw)
            if lot and (size >= LOT_BYTES or i == len(raws) - 1):
                for at, found in zip(lot, self._contract([raws[j] for j in lot])):
                    ids[at] = found
                lot, size = [], 0
        return list(zip(ids, self.decode(ids)))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, those ids decoded) of each text."""
        out = []
        for codes in self.codes.of(texts):
            ids, plain = zip(*codes) if codes else ((), ())
            out.append((b"".join(ids), b"".join(plain)))
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each sequence of ids; an id that is not in the vocabulary is an error."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        if len(flat) and not self._known(flat):
            raise ValueError("an id is not in the vocabulary")
        out = [b""] * len(ids)
        lot, size = [], 0  # (sequence, some of its ids)
        for i, raw in enumerate(ids):
            for at in range(0, len(raw), 4 * LOT_TOKENS):
                part = raw[at : at + 4 * LOT_TOKENS]
                if size + len(part) // 4 > LOT_TOKENS:
                    self._decode_lot(lot, out)
                    lot, size = [], 0
                lot.append((i, part))
                size += len(part) // 4
        if lot:
            self._decode_lot(lot, out)
        return out

    def _decode_lot(self, lot: list[tuple[int, bytes]], out: list[bytes]) -> None:
        """Adds the bytes of each part to its sequence's."""
        flat = np.frombuffer(b"".join(part for _, part in lot), "<u4")
        sizes = np.array([len(part) // 4 for _, part in lot], np.int64)
        tokens = pa.table({
            "piece": pa.array(np.repeat([i for i, _ in lot], sizes), pa.int32()),
            "pos": pa.array(np.arange(len(flat)), pa.int64()),
            "token": pa.array(flat, pa.int32()),
        })
        self.db.register("tokens", tokens)
        found = self.db.execute(DECODE).fetchnumpy()
        for piece, hexed in zip(found["piece"].tolist(), found["hexed"].tolist()):
            out[piece] += bytes.fromhex(hexed)

    def _known(self, ids: np.ndarray) -> bool:
        return bool(np.isin(np.unique(ids), self.all_ids).all())


_ready: dict[tuple[str, str], Merges] = {}


def merges(path: str, pattern: str) -> Merges:
    """The process's merge table: read once, then used by all its tasks."""
    if (path, pattern) not in _ready:
        _ready[path, pattern] = Merges(path, pattern)
    return _ready[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_tokens, ids_sha256, decoded_sha256.

    ``ids_sha256`` is over the ids as little-endian unsigned 32-bit integers, ``decoded_sha256``
    over the decoded bytes; both lowercase hex.  A NULL or empty text has no ids.  ``path`` is a
    rank file that every executor can open, ``pattern`` the split pattern that goes with it.
    Nothing is shuffled: each row is encoded where it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = merges(path, pattern)
        for batch in batches:
            for piece in slices(batch, size=TEXT_BYTES):
                texts = [t or "" for t in piece.column(1).to_pylist()]
                coded = bpe.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([len(i) // 4 for i, _ in coded], pa.int64()),
                     pa.array([hashlib.sha256(i).hexdigest() for i, _ in coded]),
                     pa.array([hashlib.sha256(d).hexdigest() for _, d in coded])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
