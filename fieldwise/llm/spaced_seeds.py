"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words: its hash sees the kept positions and ignores
the others, so a changed word breaks only the seeds that look at it.  Hashes of the corpus and
of the benchmark are joined; around each hit the words are compared on the hit's diagonal, and
an overlap counts when it is long enough and most of its words agree.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stages import stage
from .common import U64, digest, free_name, mix, own_columns, random_words, same, slices
from .words import batch_words

#: 1: the word counts; 0: it is ignored.  Any 13 to 25 words of which 80 % agree hold a seed of one
#: of these (enumerated in the tests), and a longer overlap holds such a stretch.
MASKS = ("1111111", "11011011", "110101011", "1100110011", "1111000011")
#: Bits of the filter that spares the corpus the shuffle of hashes the benchmark cannot have.
FILTER_BITS = 1 << 24
#: Least words of an overlap, least share of them that agree, and words kept around a hit.
OVERLAP, AGREE, REACH = 13, 0.8, 48
_STEP = U64(0xD6E8FEB86659FD93)
_SALT = random_words(1, 5)


def whole_masks(size: int) -> list[str]:
    """Masks over a whole item of ``size`` words, below OVERLAP: one for every choice of words that may differ.

    An overlap begins and ends with agreeing words, so only inner words are left out.
    """
    left_out = size - math.ceil(AGREE * size - 1e-9)
    inner = itertools.combinations(range(1, size - 1), left_out)
    return ["".join("0" if i in gone else "1" for i in range(size)) for gone in inner]


def seed_hashes(words: np.ndarray, masks: Sequence[str] = MASKS) -> list[np.ndarray]:
    """Per mask, the hash of the seed that begins at each word."""
    out = []
    for mask in masks:
        n = max(0, len(words) - len(mask) + 1)
        h = np.full(n, mix(_SALT ^ U64(int("1" + mask, 2)))[0], U64)
        for i, bit in enumerate(mask):
            if bit == "1":
                h = h * _STEP + words[i : i + n]
        out.append(mix(h))
    return out


def _benchmark_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch):
            words = batch_words(piece.column(1))
            seeds = [], []
            for d in range(piece.num_rows):
                own = words.of(d)
                masks = [*MASKS, *(whole_masks(len(own)) if 0 < len(own) < OVERLAP else [])]
                found = [(p, h) for hashes in seed_hashes(own, masks) for p, h in enumerate(hashes.view(np.int64).tolist())]
                for out, x in zip(seeds, zip(*found) if found else ((), ())):
                    out.append(list(x))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(2),
                 pa.array([words.of(d).view(np.int64) for d in range(piece.num_rows)], pa.list_(pa.int64())),
                 pa.array(seeds[0], pa.list_(pa.int32())), pa.array(seeds[1], pa.list_(pa.int64()))],
                ["item_id", "item", "item_words", "places", "seeds"],
            )


_BENCHMARK = "item_id long, item binary, item_words array<long>, places array<int>, seeds array<long>"


@dataclass
class SeedFilter:
    """A Bloom filter of fixed size with two bits per hash."""

    words: np.ndarray

    def has(self, h: np.ndarray) -> np.ndarray:
        return self._bit(h & U64(FILTER_BITS - 1)) & self._bit((h >> U64(32)) & U64(FILTER_BITS - 1))

    def _bit(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> U64(6)] >> (at & U64(63)) & U64(1)).astype(bool)


def seed_filter(seeds: DataFrame) -> SeedFilter:
    """Filter of the benchmark's hashes; at most FILTER_BITS / 64 rows reach the driver."""
    mask = FILTER_BITS - 1
    bits = seeds.select(F.explode(F.array(
        F.col("seed").bitwiseAND(mask), F.shiftrightunsigned("seed", 32).bitwiseAND(mask))).alias("bit"))
    packed = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set")
    )
    words = np.zeros(FILTER_BITS // 64, np.int64)
    for r in packed.collect():
        words[r.word] = r.set
    return SeedFilter(words.view(U64))


_SEGMENTS = "row long, doc_id long, node binary, segment int, begin int, words array<long>, places array<int>, seeds array<long>"


def _corpus_segments(filter_, masks: Sequence[str]):
    """Stretches of text around words where seeds pass the filter, with those seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: SeedFilter = filter_.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in slices(batch):
                words = batch_words(piece.column(1))
                found = []
                for hashes, mask in zip(seed_hashes(words.hashes, masks), masks):
                    at = np.flatnonzero(seen.has(hashes))
                    doc = np.searchsorted(words.first, at, "right") - 1
                    inside = at + len(mask) <= words.first[doc + 1]  # no seed runs into the next text
                    found.append((at[inside], hashes[at[inside]], doc[inside]))
                at, seeds, doc = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(at, kind="stable")
                at, seeds, doc = at[order], seeds[order].view(np.int64), doc[order]
                cut = np.ones(len(at), bool)
                cut[1:] = (doc[1:] != doc[:-1]) | (np.diff(at) > REACH)
                begins = np.flatnonzero(cut)
                ends = np.append(begins[1:], len(at))[: len(begins)]
                own = doc[begins]
                lo = np.maximum(at[begins] - REACH, words.first[own])
                hi = np.minimum(at[ends - 1] + REACH, words.first[own + 1])
                lists = pa.array(np.append(begins, len(at)), pa.int32())
                take = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + own, pa.int64()), piece.column(0).take(take), piece.column(2).take(take),
                     pa.array(begins, pa.int32()), pa.array(lo - words.first[own], pa.int32()),
                     pa.array([words.hashes[x:y].view(np.int64) for x, y in zip(lo, hi)], pa.list_(pa.int64())),
                     pa.ListArray.from_arrays(lists, pa.array(at - words.first[doc], pa.int32())),
                     pa.ListArray.from_arrays(lists, pa.array(seeds))],
                    ["row", "doc_id", "node", "segment", "begin", "words", "places", "seeds"],
                )
                row += piece.num_rows

    return run


def best_overlap(agree: np.ndarray) -> tuple[int, int, int]:
    """(first, words, agreeing) of the longest stretch that agrees in at least AGREE of its
    words; it begins and ends with agreeing words."""
    level = np.concatenate([[0], np.cumsum(np.where(agree, 1 - AGREE, -AGREE))]).round(6)
    low = np.minimum.accumulate(np.where(agree, level[:-1], np.inf))  # of possible beginnings
    ends = np.flatnonzero(agree) + 1
    if not len(ends):
        return 0, 0, 0
    first = np.searchsorted(-low, -level[ends], "left")  # the earliest that is not above
    best = int(np.argmax(ends - first))
    begin, end = int(first[best]), int(ends[best])
    if end <= begin:
        return 0, 0, 0
    return begin, end - begin, int(agree[begin:end].sum())


def all_overlaps(agree: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The best overlap of at least ``least`` words, and those left and right of it, in order."""
    found, todo = [], [(0, len(agree))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least:
            continue
        first, size, n = best_overlap(agree[lo:hi])
        if size and size >= least:
            found.append((lo + first, size, n))
            todo += [(lo, lo + first), (lo + first + size, hi)]
    return sorted(found)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            doc_id, node, diagonal, begin, item_id, words, item = (batch.column(c)[i] for c in range(7))
            d, at = diagonal.as_py(), begin.as_py()
            a, b = words.values.to_numpy(), item.values.to_numpy()
            lo, hi = max(at, d), min(at + len(a), d + len(b))
            same_words = a[lo - at : hi - at] == b[lo - d : hi - d]
            for first, size, agree in all_overlaps(same_words, min(OVERLAP, len(b))):
                rows.append((doc_id.as_py(), node.as_py(), item_id.as_py(), lo + first, size, agree))
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        names = ["doc_id", "node", "item_id", "first_word", "n_words", "agreeing"]
        columns = zip(*rows) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Written overlaps of ``docs`` (doc_id, text) with ``benchmark`` (item_id, text).

    One row per row of ``docs``, item and place: doc_id, node (digest of the text), item_id,
    first_word, n_words, agreeing.  An overlap has at least OVERLAP words (the whole item, if
    that is shorter), AGREE of which agree.  Items of fewer than OVERLAP words are found by masks
    over the whole item, which the corpus is hashed with only where the benchmark has items of
    that length.  NULL texts and items without a word have no overlap; repeated rows and
    repeated items are reported each.

    Only stretches of word hashes around places that pass the benchmark's seed filter are
    written; texts do not travel.  A passage that very many documents share adds rows, not
    partners: seeds meet the benchmark's in a join that Spark broadcasts if the benchmark is
    small, and splits by size if it is not.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text", digest().alias("item"))
    items = stage(items.mapInArrow(_benchmark_words, _BENCHMARK), "benchmark-words")
    places = items.select("item", F.explode(F.arrays_zip("places", "seeds")).alias("s")).select(
        "item", F.col("s.places").alias("item_place"), F.col("s.seeds").alias("seed")
    ).distinct()
    filter_ = spark.sparkContext.broadcast(seed_filter(places))
    short = items.select(F.size("item_words").alias("n")).filter((F.col("n") > 0) & (F.col("n") < OVERLAP)).distinct()
    masks = [*MASKS, *(m for r in short.collect() for m in whole_masks(r.n))]  # at most OVERLAP - 1 lengths
    rows = docs.select("doc_id", "text", digest().alias("node"))
    segments = stage(rows.mapInArrow(_corpus_segments(filter_, masks), _SEGMENTS), "segments")
    hits = segments.select("row", "segment", F.explode(F.arrays_zip("places", "seeds")).alias("s"))
    hits = hits.select("row", "segment", F.col("s.places").alias("place"), F.col("s.seeds").alias("seed"))
    met = hits.join(places, "seed").select(
        "row", "segment", "item", (F.col("place") - F.col("item_place")).alias("diagonal")
    ).distinct()
    texts = segments.select("row", "segment", "doc_id", "node", "begin", "words")
    both = met.join(texts, ["row", "segment"]).join(items.select("item", "item_id", "item_words"), "item")
    both = both.select("doc_id", "node", "diagonal", "begin", "item_id", "words", "item_words")
    found = both.mapInArrow(_verify, "doc_id long, node binary, item_id long, first_word int, n_words int, agreeing int")
    return stage(found, "overlaps")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, n_words, agreeing of each overlap."""
    return overlaps(docs, benchmark).drop("node")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` without any overlap, with their own columns; NULL and empty texts stay."""
    own, node = own_columns(docs), free_name(docs, "text_digest")
    bad = overlaps(docs, benchmark).select(F.col("doc_id").alias("bad_id"), F.col("node").alias("bad_text")).distinct()
    bad = stage(bad, "contaminated")
    rows = docs.withColumn(node, digest())
    return rows.join(bad, same(rows, bad, {"doc_id": "bad_id", node: "bad_text"}), "left_anti").select(*own)
