"""Token files: ids under one canonical, length-limited Huffman code.

Format, written and read as Parquet so that any store Spark knows will do:
* ``lengths``: (id, length) of every id that occurs.  Canonical codes follow from them: by
  length, then id, counting up.
* ``blocks``: (bucket, number, before, n_tokens, payload).  Buckets are ranges of doc_id in
  ascending order; blocks are numbered in their bucket; ``before`` counts the bucket's tokens in
  earlier blocks.  A payload stands alone.  Little-endian: u32 documents, u32 checkpoints,
  i64 doc_id of each, u8 1 where it is NULL, u32 tokens of each, u32 checkpoints (the bit offset
  of every EVERY-th token of each document, its first included), then the bits, each document
  from a byte boundary on, high bit first, and 16 bytes of zeros.
Decoding looks LIMIT bits up in a table, for all checkpoints of a block in step.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..stages import shared_dir, stage
from .common import slices, text_buffer
from .ordered import range_bounds, range_numbers, ranges_for
from .units import PLAIN, WORD, Memory, latin_pieces

#: Longest code in bits: the decoding table has 2 ** LIMIT entries.
LIMIT = 18
#: Tokens between checkpoints, and tokens from which on a block is closed.
EVERY, BLOCK = 128, 1 << 19
#: Words that the tokenizer gets as one text.
LOT = 500
#: Bytes of text whose pieces are looked up together.
AT_ONCE = 4 << 20
_BLOCKS = "bucket int, number int, before long, n_tokens long, payload binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 where the count is 0."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.int64)
    packages, levels = coins[:0], []
    for _ in range(limit):
        both = np.concatenate([coins, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank >= len(coins))
        both = both[rank][: len(both) // 2 * 2]
        packages = both[0::2] + both[1::2]
    take = 2 * len(coins) - 2
    lengths = np.zeros(len(coins), np.uint8)
    for is_package in reversed(levels):
        inside = int(is_package[:take].sum())
        lengths[: take - inside] += 1
        take = 2 * inside
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id): each is the one before plus one, shifted to its length."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    code, size = 0, 0
    for i in order[lengths[order] > 0].tolist():
        code <<= int(lengths[i]) - size
        size = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for every value of the next LIMIT bits."""
    ids, sizes = np.zeros(1 << LIMIT, np.uint32), np.zeros(1 << LIMIT, np.uint8)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (LIMIT - lengths[order].astype(np.int64))
    ids[: spans.sum()] = np.repeat(order, spans)
    sizes[: spans.sum()] = np.repeat(lengths[order], spans)
    return ids, sizes


def pack(ids: np.ndarray, per_doc: np.ndarray, codes: np.ndarray, lengths: np.ndarray):
    """Bytes of each document's bits, and the bit offsets of its checkpoints."""
    size = lengths[ids].astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(size)])
    first = np.concatenate([[0], np.cumsum(per_doc)])
    n_bytes = (upto[first[1:]] - upto[first[:-1]] + 7) // 8
    begin = np.concatenate([[0], np.cumsum(n_bytes)])
    at = upto[:-1] + np.repeat(8 * begin[:-1] - upto[first[:-1]], per_doc)
    word, room = at >> 6, 64 - (at & 63) - size
    code = codes[ids]
    high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    out = np.zeros(int(begin[-1]) // 8 + 2, np.uint64)
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    if len(starts):
        out[word[starts]] = np.bitwise_or.reduceat(high, starts)
    split = np.flatnonzero(room < 0)
    out[word[split] + 1] |= code[split] << (64 + room[split]).astype(np.uint64)
    raw = out.astype(">u8").tobytes()
    docs = [raw[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
    marks = [(at[a:b:EVERY] - 8 * s).astype("<u4") for a, b, s in zip(first[:-1], first[1:], begin[:-1])]
    return docs, marks


def unpack(payload: bytes, table: tuple[np.ndarray, np.ndarray]):
    """(doc_ids, nulls, tokens per document, all ids) of a block."""
    n, m = np.frombuffer(payload, "<u4", 2).tolist()
    at = 8
    doc_ids = np.frombuffer(payload, "<i8", n, at)
    nulls = np.frombuffer(payload, np.uint8, n, at + 8 * n)
    per_doc = np.frombuffer(payload, "<u4", n, at + 9 * n).astype(np.int64)
    marks = np.frombuffer(payload, "<u4", m, at + 13 * n).astype(np.int64)
    bits = payload[at + 13 * n + 4 * m :]
    words = np.frombuffer(bits[: len(bits) // 8 * 8], ">u8").astype(np.uint64)
    streams = -(-per_doc // EVERY)
    left = np.full(m, EVERY)
    if m:
        left[np.cumsum(streams)[streams > 0] - 1] = (per_doc - (streams - 1) * EVERY)[streams > 0]
    order = np.argsort(-left, kind="stable")
    pos, todo = marks[order], left[order]
    out = np.zeros((m, EVERY), np.uint32)
    ids, sizes = table
    for step in range(int(todo[0]) if m else 0):
        active = int(np.searchsorted(-todo, -step, "left"))
        p = pos[:active]
        word, off = p >> 6, (p & 63).astype(np.uint64)
        seen = words[word] << off | words[word + 1] >> np.uint64(1) >> (np.uint64(63) - off)
        seen = seen >> np.uint64(64 - LIMIT)
        out[order[:active], step] = ids[seen]
        pos[:active] = p + sizes[seen]
    return doc_ids, nulls, per_doc, out[np.arange(EVERY)[None, :] < left[:, None]]


class Encoder:
    """The tokenizers library in one process; what short pieces gave is remembered."""

    def __init__(self, path: str, wide: str = "<u4"):
        from tokenizers import Tokenizer, pre_tokenizers

        self.wide = np.dtype(wide)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            kind = json.load(f)
        pre = kind.get("pre_tokenizer") or {}
        own = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        # where the library itself cuts by the pattern, pieces may be encoded one by one
        self.by_piece = bool(own and not kind.get("normalizer"))
        # the library finds added tokens before it cuts: a text with one is left whole
        self.added = [t["content"] for t in kind.get("added_tokens") or ()]
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)  # ids whose bytes begin with a space
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        # the same model for words of A-Z and a-z, in which the byte-level spelling changes only the space
        self.spelled = Tokenizer(self.tokenizer.model)
        self.spelled.pre_tokenizer = pre_tokenizers.Split("\u0120", "merged_with_next")
        self.codes = Memory(self._encode)

    def _has_added(self, text: str) -> bool:
        return any(token in text for token in self.added)

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece; plain words are encoded as one text, and told apart by word."""
        out = {}
        if self.by_piece:
            plain = [u for u in pieces if PLAIN.fullmatch(u)]
            self._encode_words(plain, self.spelled, "\u0120", out)
            self._encode_words([u for u in pieces if u not in out and WORD.fullmatch(u.decode())], self.tokenizer, " ", out)
        rest = [u for u in pieces if u not in out]
        found = self.tokenizer.encode_batch_fast([u.decode() for u in rest], add_special_tokens=False)
        out.update(zip(rest, [np.array(e.ids, self.wide).tobytes() for e in found]))
        return [out[u] for u in pieces]

    def _encode_words(self, words: list[bytes], tokenizer, space: str, out: dict[bytes, bytes]) -> None:
        """Put ids of words into ``out``, except where words next to each other make an added token."""
        for i in range(0, len(words), LOT):
            lot = words[i : i + LOT]
            text = b"".join(lot).decode()
            if self._has_added(text):
                continue
            (found,) = tokenizer.encode_batch_fast([text.replace(" ", space)], add_special_tokens=False)
            ids = np.array(found.ids, self.wide)
            ends = (np.flatnonzero(self.spaced[ids]) * self.wide.itemsize).tolist()[1:] + [ids.nbytes]
            if len(ends) != len(lot):
                raise ValueError("the tokenizer does not begin each word with a space of its own")
            raw = ids.tobytes()
            out.update(zip(lot, [raw[a:b] for a, b in zip([0, *ends], ends)]))

    def encode(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """The ids of each text, and ``end`` after them.

        A piece is looked up once for all its places in the texts.
        """
        data, at = text_buffer(texts)
        if self.by_piece:
            begins = latin_pieces(data, at, [t.encode() for t in self.added])
        else:
            begins = at[:-1][at[1:] > at[:-1]]
        ends = pa.py_buffer(np.append(begins, len(data)).astype(np.int32))
        pieces = pa.Array.from_buffers(pa.binary(), len(begins), [None, ends, pa.py_buffer(data)]).dictionary_encode()
        _, ends, data = pieces.dictionary.buffers()
        ends = np.frombuffer(ends, np.int32, len(pieces.dictionary) + 1).tolist()
        data = data.to_pybytes() if data else b""
        codes = self.codes.each([data[a:b] for a, b in pairwise(ends)])
        firsts = np.searchsorted(begins, at)
        which = np.insert(pieces.indices.to_numpy(), firsts[1:], len(codes))
        coded = pa.array([*codes, end], pa.binary()).take(pa.array(which))
        _, ends, data = coded.buffers()
        ends = np.frombuffer(ends, np.int32, len(coded) + 1)[firsts + np.arange(len(at))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), data])


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, wide: str) -> Encoder:
    if (path, wide) not in _encoders:
        _encoders[path, wide] = Encoder(path, wide)
    return _encoders[path, wide]


def _encode(path: str, end_id: int, wide: str, bounds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        encoder = _encoder(path, wide)
        end = np.array([end_id], wide).tobytes()
        for batch in batches:
            for piece in slices(batch, size=AT_ONCE):
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), range_numbers(bounds, piece.column(0)), encoder.encode(piece.column(1), end)],
                    ["doc_id", "bucket", "ids"],
                )

    return run


def _count(vocabulary: int, wide: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                raws = [r.as_buffer() for r in batch.column(0).slice(begin, 500)]
                total += np.bincount(np.frombuffer(b"".join(raws), wide), minlength=vocabulary)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit])], ["id", "n"])

    return run


def _pack(lengths: np.ndarray, wide: str):
    codes = canonical_codes(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 100  # few enough for the processor's cache
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                raws = [r.as_buffer() for r in part.column(2)]
                per_doc = np.array([len(r) for r in raws], np.int64) // np.dtype(wide).itemsize
                bits, marks = pack(np.frombuffer(b"".join(raws), wide), per_doc, codes, lengths)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(per_doc),
                     pa.array([m.tobytes() for m in marks], pa.binary()), pa.array(bits, pa.binary())],
                    ["doc_id", "bucket", "n", "marks", "bits"],
                )

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (bucket, doc_id), gathered into payloads."""
    state = {"bucket": None, "number": 0, "before": 0}
    rows: list[tuple] = []

    def close() -> pa.RecordBatch:
        ids, n, marks, bits = zip(*rows)
        begins = 8 * np.concatenate([[0], np.cumsum([len(b) for b in bits])[:-1]])
        marks = [np.frombuffer(m, "<u4") + b for m, b in zip(marks, begins)]
        flat = np.concatenate(marks).astype("<u4")
        payload = b"".join([
            np.array([len(ids), len(flat)], "<u4").tobytes(),
            np.array([i or 0 for i in ids], "<i8").tobytes(), bytes(i is None for i in ids),
            np.array(n, "<u4").tobytes(), flat.tobytes(), *bits, bytes(16),
        ])
        values = [state["bucket"], state["number"], state["before"], sum(n), payload]
        state["number"] += 1
        state["before"] += sum(n)
        rows.clear()
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        names = ["bucket", "number", "before", "n_tokens", "payload"]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    held = 0
    for batch in batches:
        for doc_id, bucket, n, marks, bits in zip(*[batch.column(c).to_pylist() for c in range(5)]):
            if rows and (bucket != state["bucket"] or held >= BLOCK):
                yield close()
                held = 0
            if bucket != state["bucket"]:
                state.update(bucket=bucket, number=0, before=0)
            rows.append((doc_id, n, marks, bits))
            held += n
    if rows:
        yield close()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, vocabulary: int = 65_536) -> None:
    """Write the ids of ``docs`` (doc_id, text) in ascending order of doc_id to ``path``.

    Every text (NULL: empty) is encoded by the tokenizers library from the file ``tokenizer``,
    which all executors can open, and ends with ``end_id``.  NULL doc_ids come first, equal ones
    in the order of their bits.  ``vocabulary`` is an upper bound of all ids; counts of that many ids
    reach the driver.  An empty table gives an empty file set.

    Ids are written once before the code is known; what is shuffled into order are the coded bits.
    """
    wide = "<u2" if vocabulary <= 65_536 else "<u4"
    bounds = range_bounds(docs, ranges_for(docs))
    rows = docs.select("doc_id", "text")
    coded = stage(rows.mapInArrow(_encode(tokenizer, end_id, wide, bounds), "doc_id long, bucket int, ids binary"), "token-ids")
    counts = np.zeros(vocabulary, np.int64)
    parts = coded.select("ids").mapInArrow(_count(vocabulary, wide), "id int, n long")
    for r in parts.groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark = docs.sparkSession
    table = [(int(i), int(lengths[i])) for i in used]
    spark.createDataFrame(table, "id int, length int").coalesce(1).write.parquet(f"{path}/lengths")
    packed = coded.select("doc_id", "bucket", "ids").mapInArrow(
        _pack(lengths, wide), "doc_id long, bucket int, n long, marks binary, bits binary"
    )
    dealt = packed.repartition(ranges_for(docs) // 2, "bucket").sortWithinPartitions("bucket", "doc_id", "n", "bits")
    dealt.mapInArrow(_blocks, _BLOCKS).write.parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files; ids little-endian, four bytes each.

    ``start`` counts the ids of all documents before.  The code table (an entry per id of the
    vocabulary) goes to every task.
    """
    found = spark.read.schema("id int, length int").parquet(f"{path}/lengths").collect()
    lengths = np.zeros(max([r.id for r in found], default=0) + 1, np.uint8)
    for r in found:
        lengths[r.id] = r.length
    shared = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(shared.value)
        for batch in batches:
            for before, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids, nulls, per_doc, ids = unpack(payload.as_py(), table)
                ends = np.cumsum(per_doc)
                raw = pa.py_buffer(ids.astype("<u4").tobytes())
                at = pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64(), mask=nulls == 1), pa.array(before + ends - per_doc),
                     pa.Array.from_buffers(pa.binary(), len(per_doc), [None, at, raw])],
                    ["doc_id", "start", "ids"],
                )

    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    sums = blocks.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))  # a row per range of doc_id
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(bases), F.col("bucket") == F.col("b"))
    placed = placed.select((F.col("before") + F.col("base")).alias("before"), "payload")
    return placed.mapInArrow(run, "doc_id long, start long, ids binary")


def token_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` in the shared folder, read the files, and sum up every document's ids."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer)
    read = read_tokens(spark, path)
    return read.select(
        "doc_id", "start", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
