"""Phrase mining by stripes.

A stripe belongs to a prefix (of 0 to 3 words) and counts the words that follow it.  Tasks build
stripes of a stretch of text and send each as one row; stripes of one prefix are merged
elementwise.  A merged stripe gives the counts of all phrases that extend its prefix, its sum
the prefix's extensions, and its maximum the strongest longer phrase (subsumption).

Lengths are counted one after the other: a phrase can only occur MIN_COUNT times if both its
prefix and its rest do, so a filter of the frequent phrases of one length thins the stripes of
the next.  The filter has a fixed size and never drops a frequent phrase; what it lets
through wrongly is dropped by its exact count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stages import stage
from .common import U64, collected_bits, has_bit, mix, random_words, text_buffer

MIN_COUNT, LONGEST, TOP, SUBSUMED = 30, 4, 2000, 80
SCORE = 2_000_000
#: Bits of the filter of frequent phrases (8 MB), two per phrase.
FILTER_BITS = 1 << 26
#: Bytes of text whose stripes are built at a time (up to the next end of a piece).
STRETCH = 8 << 20
#: A prefix with this share of all words has its stripe cut into PARTS by the next word; there
#: are at most 1 / HOT_SHARE of them.  The empty prefix is one.
HOT_SHARE, PARTS = 1e-3, 64
UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_INSIDE = ~_BREAK
_INSIDE[[32, 9]] = False
_BYTE = random_words(256, 17)
_STEP = U64(0xD6E8FEB86659FD93)


def string_hash(strings: pa.Array) -> np.ndarray:
    data, at = text_buffer(strings)
    size = np.diff(at)
    if not len(data):
        return mix(size.astype(U64))
    power = np.cumprod(np.full(int(size.max()) + 1, _STEP, U64))
    values = _BYTE[data] * power[np.arange(len(data)) - np.repeat(at[:-1], size)]
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values)])
    return mix(total[at[1:]] - total[at[:-1]] + size.astype(U64))


def extended(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of its prefix and its last word."""
    return mix(prefix * _STEP + word)


def phrase_hash(langs: pa.Array, phrases: pa.Array, size: int) -> np.ndarray:
    """Hash of (lang, phrase of ``size`` words)."""
    words = string_hash(pc.list_flatten(pc.split_pattern(phrases, " "))).reshape(-1, size)
    out = string_hash(langs)
    for j in range(size):
        out = extended(out, words[:, j])
    return out


@dataclass
class PhraseFilter:
    bits: np.ndarray

    def has(self, h: np.ndarray) -> np.ndarray:
        mask = U64(64 * len(self.bits) - 1)
        a, b = (h & mask).astype(np.int64), (h >> U64(32) & mask).astype(np.int64)
        return has_bit(self.bits, a) & has_bit(self.bits, b)


def hashed(phrases: DataFrame, size: int) -> DataFrame:
    """``phrases`` (lang, phrase) with ``h``, the hash that tasks compute too."""
    def run(langs: pa.Array, words: pa.Array) -> pa.Array:
        return pa.array(phrase_hash(langs, words, size).view(np.int64))

    return phrases.withColumn("h", F.arrow_udf(run, "long")("lang", "phrase"))


def phrase_filter(with_hash: DataFrame) -> PhraseFilter:
    mask = F.lit(FILTER_BITS - 1).cast("long")
    probes = F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))
    return PhraseFilter(collected_bits(with_hash.select(F.explode(probes).alias("slot")), FILTER_BITS))


def stretches(data: np.ndarray, at: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``size`` that end where a piece or a text ends."""
    ends = np.union1d(np.flatnonzero(_BREAK[data]) + 1, at[1:])
    lo = 0
    while lo < len(data):
        i = max(int(np.searchsorted(ends, lo + size, "right")) - 1, int(np.searchsorted(ends, lo, "right")))
        yield lo, int(ends[i])
        lo = int(ends[i])


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1]


class Stretch:
    """Words of a byte range: ``words`` (distinct, lower-case), ``word`` (their numbers, in
    order), ``doc`` and ``piece`` of each; phrases lie within one piece."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lo: int, hi: int):
        part = data[lo:hi]
        inside = _INSIDE[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = at[(at >= lo) & (at < hi)] - lo
        begins[heads] |= inside[heads]
        starts = np.flatnonzero(begins)
        self.doc = np.searchsorted(at, starts + lo, "right") - 1
        self.piece = np.cumsum(_BREAK[part])[starts] + self.doc
        size = np.add.reduceat(inside, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        strings = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(offsets), pa.py_buffer(_LOWER[part[inside]])
        ).dictionary_encode()
        self.words, self.word = strings.dictionary, strings.indices.to_numpy().astype(np.int64)

    def phrases(self, size: int, lang: np.ndarray, lang_hash: np.ndarray, known: PhraseFilter | None) -> np.ndarray:
        """Places where a phrase of ``size`` words begins whose prefix and rest may be frequent."""
        n = max(0, len(self.word) - size + 1)
        keep = self.piece[:n] == self.piece[size - 1 : size - 1 + n]
        if size > 1:
            h, w = lang_hash[lang[self.doc]], string_hash(self.words)[self.word]
            for j in range(size - 1):
                h = extended(h[: len(w) - j], w[j:])
            frequent = known.has(h)
            keep = keep & frequent[:n] & frequent[1 : n + 1]
        return np.flatnonzero(keep)

    def stripes(self, size: int, lang: np.ndarray, langs: pa.Array, known: PhraseFilter | None, hot: np.ndarray) -> pa.RecordBatch:
        """Stripes of all prefixes of ``size`` - 1 words, by (lang, prefix, part)."""
        lang_hash = string_hash(langs)
        at = self.phrases(size, lang, lang_hash, known)
        many = max(len(self.words), 1)
        prefix, h = lang[self.doc[at]], lang_hash[lang[self.doc[at]]]
        word_hash = string_hash(self.words)
        for j in range(size - 1):
            prefix = _dense(prefix * many + self.word[at + j])
            h = extended(h, word_hash[self.word[at + j]])
        last = self.word[at + size - 1]
        pair, first, count = np.unique(prefix * many + last, return_index=True, return_counts=True)
        cut = np.isin(h[first], hot) if size > 1 else np.ones(len(first), bool)
        part = np.where(cut, (word_hash[last[first]] % U64(PARTS)).astype(np.int64), 0)
        order = np.argsort(prefix[first] * PARTS + part, kind="stable")
        first, count, part = first[order], count[order], part[order]
        group = prefix[first] * PARTS + part
        fresh = np.ones(len(group), bool)
        fresh[1:] = group[1:] != group[:-1]
        begin = np.flatnonzero(fresh)
        offsets = pa.array(np.append(begin, len(group)), pa.int32())
        place = at[first[begin]]
        names = [self.words.take(pa.array(self.word[place + j])) for j in range(size - 1)]
        texts = pc.binary_join_element_wise(*names, pa.scalar(" ", pa.large_string())) if names else pa.array([""] * len(begin))
        return pa.RecordBatch.from_arrays(
            [langs.take(pa.array(lang[self.doc[place]])).cast(pa.string()), texts.cast(pa.string()),
             pa.array(part[begin], pa.int32()),
             pa.ListArray.from_arrays(offsets, self.words.take(pa.array(last[first])).cast(pa.string())),
             pa.ListArray.from_arrays(offsets, pa.array(count, pa.int32()))],
            ["lang", "prefix", "part", "nexts", "counts"],
        )


_STRIPES = "lang string, prefix string, part int, nexts array<string>, counts array<int>"


def _stripes_of(size: int, known, hot: np.ndarray, stretch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = known.value if known is not None else None
        for batch in batches:
            data, at = text_buffer(batch.column(0))
            coded = batch.column(1).dictionary_encode()
            lang, langs = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.large_string())
            for lo, hi in stretches(data, at, stretch):
                yield Stretch(data, at, lo, hi).stripes(size, lang, langs, filter_, hot)

    return run


def merged(docs: DataFrame, size: int, known, hot: np.ndarray) -> DataFrame:
    """(lang, prefix, next, f): stripes of all texts of ``docs`` (text, lang), merged elementwise.

    Stripes travel whole, dealt by prefix; the stripe of a very common prefix by parts.
    """
    sent = docs.mapInArrow(_stripes_of(size, known, hot, STRETCH), _STRIPES).repartition("lang", "prefix", "part")
    pairs = sent.select("lang", "prefix", "part", F.explode(F.arrays_zip("nexts", "counts")).alias("e"))
    counts = pairs.groupBy("lang", "prefix", "part", F.col("e.nexts").alias("next")).agg(F.sum("e.counts").alias("f"))
    return counts.select("lang", "prefix", "next", "f")


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Written (lang, phrase, size, prefix, rest, f) of phrases of 1 to ``longest`` words that occur
    ``min_count`` times, and (lang, n), the number of all words.

    ``docs`` has text and lang; a NULL lang counts as UNKNOWN, a NULL text as empty.
    """
    spark = docs.sparkSession
    texts = docs.select("text", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))
    words = stage(merged(texts, 1, None, np.zeros(0, U64)), "stripes")
    totals = stage(words.groupBy("lang").agg(F.sum("f").alias("n")), "words")
    all_words = totals.agg(F.sum("n")).first()[0] or 0
    found, counts = [], words
    for size in range(1, longest + 1):
        phrase = F.col("next") if size == 1 else F.concat_ws(" ", "prefix", "next")
        rows = counts.filter(F.col("f") >= min_count).select(
            "lang", phrase.alias("phrase"), F.lit(size).alias("size"), "prefix", "f"
        )
        rows = rows.withColumn("rest", F.expr("substr(phrase, locate(' ', phrase) + 1)"))
        rows = stage(rows, "phrases")
        found.append(rows)
        if size == longest:
            break
        keyed = hashed(rows, size)
        known = spark.sparkContext.broadcast(phrase_filter(keyed))
        common = keyed.filter(F.col("f") > all_words * HOT_SHARE).select("h").collect()  # at most 1 / HOT_SHARE
        hot = np.array([r.h for r in common], np.int64).view(U64)
        counts = merged(texts, size + 1, known, hot)
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out, totals


def _exact(x) -> F.col:
    return x.cast("decimal(38,0)")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of 2 to LONGEST words of each lang.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and these into words
    at blanks and tabs.  ``a`` counts a phrase, ``l`` and ``r`` the two parts of its lowest-scoring
    cut (ties: the first), ``n`` all words of the lang; score = floor(SCORE * a / (l + r)).  A phrase
    within a longer one that has SUBSUMED % of its count is dropped.  Order: score, a (both
    falling), phrase in UTF-8 order.  NULL texts are empty; a NULL lang is UNKNOWN; texts without
    a word and empty tables give no rows; every row counts, repeated or not.
    """
    phrases, totals = frequent_phrases(docs, min_count)
    sizes = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    longer = phrases.filter("size > 2")
    longer = longer.select("lang", F.col("prefix").alias("inner"), "f").unionByName(
        longer.select("lang", F.col("rest").alias("inner"), "f")
    ).groupBy("lang", "inner").agg(F.max("f").alias("longer_f"))

    wanted = phrases.filter("size > 1").join(
        longer.select(F.col("lang").alias("i_lang"), "inner", "longer_f"),
        (F.col("lang") == F.col("i_lang")) & (F.col("phrase") == F.col("inner")), "left",
    )
    subsumed = _exact(F.col("longer_f")) * 100 >= _exact(F.col("f")) * SUBSUMED
    wanted = wanted.filter(~F.coalesce(subsumed, F.lit(False)))
    cuts = wanted.select(
        "lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size"
    )
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("left"),
        F.expr("substring_index(phrase, ' ', k - size)").alias("right"),
    )
    left = sizes.select(F.col("lang").alias("l_lang"), F.col("part").alias("l_part"), F.col("part_f").alias("l"))
    right = sizes.select(F.col("lang").alias("r_lang"), F.col("part").alias("r_part"), F.col("part_f").alias("r"))
    cuts = cuts.join(left, (F.col("lang") == F.col("l_lang")) & (F.col("left") == F.col("l_part")))
    cuts = cuts.join(right, (F.col("lang") == F.col("r_lang")) & (F.col("right") == F.col("r_part")))
    cuts = cuts.withColumn("score", F.expr(f"(cast({SCORE} as decimal(38,0)) * a) div (cast(l as decimal(38,0)) + r)"))
    key = F.col("score") * (LONGEST + 1) + F.col("k")
    best = cuts.groupBy("lang", "phrase").agg(
        F.min("a").alias("a"), F.min_by("l", key).alias("l"), F.min_by("r", key).alias("r"),
        F.min("score").alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
