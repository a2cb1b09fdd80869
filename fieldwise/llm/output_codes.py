"""Language identification by error-correcting output codes.

Every language has a codeword; each bit has a binary classifier on hashed byte n-grams of the
lower-cased text (log ratio of the two sides' n-gram rates).  Decoding sums the bits' logistic
losses, weighted by how reliable each bit was on training rows left out of its fit, and takes
the codeword with the smallest loss; a runner-up close behind makes the answer ambiguous.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, free_name, own_columns, random_words, slices, text_buffer

FEATURES = 1 << 13
#: Texts counted at once: a dense block of ROWS x FEATURES counts.
ROWS = 256
#: n-grams from which on more text adds no more confidence.
SURE_GRAMS = 60
#: Bits of the codes when there are too many languages for all dichotomies.
LONG_CODE = 63
#: Rows left out from which on they tell how reliable a bit is.
JUDGED_ROWS = 30
#: More languages than this are refused: two sums of FEATURES each go to the driver.
MAX_LANGUAGES = 1_000
UND = "und"
_LETTER = re.compile(r"[^\W\d_]")
_KEEP = np.arange(256, dtype=np.int64)
for _c in range(128):
    if not chr(_c).isalpha():
        _KEEP[_c] = 32


def _lowered(texts: list[str | None]) -> pa.Array:
    return pa.array([(t or "").lower() for t in texts], pa.large_string())


def gram_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of hashed 2- and 3-grams of bytes (non-letters are spaces), one row per text."""
    data, at = text_buffer(_lowered(texts))
    out = np.zeros((len(texts), FEATURES), np.float32)
    if not len(data):
        return out
    byte = _KEEP[data]
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    for k in (2, 3):
        n = len(byte) - k + 1
        if n <= 0:
            continue
        code = byte[:n].copy()
        for i in range(1, k):
            code = code * 256 + byte[i : i + n]
        code = ((code + k) * 0x9E3779B1 >> 15) & (FEATURES - 1)
        whole = row[:n] == row[k - 1 :]
        flat = row[:n][whole] * FEATURES + code[whole]
        out += np.bincount(flat, minlength=out.size).reshape(out.shape).astype(np.float32)
    return out


def codewords(n: int) -> np.ndarray:
    """n x bits of +1 / -1: all dichotomies for up to 6 languages, else fixed random codes.

    Both sides of every bit hold a language, and all codewords differ.
    """
    if n <= 6:
        cuts = [c for c in itertools.product((1, -1), repeat=n) if c[:1] == (1,) and -1 in c]
        return np.array(cuts, np.int8).T.reshape(n, len(cuts))
    code = np.zeros((n, LONG_CODE), np.int8)
    for seed in itertools.count(7):
        again = np.abs(code.sum(axis=0, dtype=np.int64)) == n  # the same for all languages
        if seed == 7 or len(np.unique(code, axis=0)) < n:
            again[:] = True
        if not again.any():
            return code
        bits = random_words(n * LONG_CODE, seed).reshape(n, LONG_CODE)
        code[:, again] = np.where(bits & np.uint64(1 << 20), 1, -1)[:, again]


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # FEATURES x bits
    trust: np.ndarray  # of each bit
    sure: np.ndarray  # largest margin of each bit: it is no surer than its rows left out allow
    close: float  # the runner-up's share of the winner's probability that makes it ambiguous

    def margins(self, texts: list[str | None]) -> np.ndarray:
        counts = gram_counts(texts)
        n = counts.sum(axis=1, keepdims=True)
        return counts @ self.weights / np.maximum(n, 1) * np.minimum(n, SURE_GRAMS)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, ambiguous) of each text; und, 0.0, False without a letter."""
        known = [bool(t) and bool(_LETTER.search(t)) and bool(self.languages) for t in texts]
        m = np.clip(self.margins(texts), -self.sure, self.sure)
        out = []
        for i, ok in enumerate(known):
            if not ok:
                out.append((UND, 0.0, False))
                continue
            loss = np.logaddexp(0, -self.code * m[i]) @ self.trust
            p = np.exp(loss.min() - loss)
            order = np.argsort(-p, kind="stable")
            second = p[order[1]] if len(p) > 1 else 0.0
            out.append((self.languages[order[0]], float(1 / p.sum()), bool(second > self.close)))
        return out


def _blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Up to ROWS texts and about SLICE_BYTES at a time."""
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t or "")
        if len(block) == ROWS or size >= SLICE_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _count_languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[str, bool], np.ndarray] = {}
    for batch in batches:
        for piece in slices(batch):
            texts = piece.column(0).to_pylist()
            by: dict[tuple[str, bool], list] = {}
            for t, key in zip(texts, zip(piece.column(1).to_pylist(), piece.column(2).to_pylist())):
                by.setdefault(key, []).append(t)
            for key, own in by.items():
                sums = total.setdefault(key, np.zeros(FEATURES))
                for block in _blocks(own):
                    sums += gram_counts(block).sum(axis=0)
    for (lang, judges), sums in total.items():
        hit = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(hit), pa.string()), pa.array([judges] * len(hit), pa.bool_()),
             pa.array(hit, pa.int32()), pa.array(sums[hit], pa.float64())],
            ["lang", "judges", "feature", "n"],
        )


def _bit_weights(sums: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Log ratio of the n-gram rates on both sides of every bit, from languages x FEATURES sums."""
    rates = (sums + 0.5) / (sums.sum(axis=1, keepdims=True) + 0.5 * FEATURES)
    weights = np.zeros((FEATURES, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        side = code[:, b] == 1
        weights[:, b] = np.log(rates[side].mean(axis=0) / rates[~side].mean(axis=0))
    return weights


def fit(train: DataFrame, close: float = 0.8, judged: float = 0.2) -> LanguageModel:
    """Fit on all rows of ``train`` (doc_id, text, lang) whose lang is not NULL.

    Tasks add up n-grams per language before anything is shuffled; the driver gets two sums per
    language and feature, so more than MAX_LANGUAGES languages are refused.  The bits'
    reliability is counted on a share ``judged`` of the training rows, picked by a hash of
    doc_id, with weights fitted on the others; the weights that are kept come from all.  A bit
    is as sure, at most, as its error rate there (two standard errors added) allows; with fewer
    than JUDGED_ROWS rows to judge by, all bits count alike.
    """
    judges = F.pmod(F.xxhash64("doc_id"), F.lit(1000)) < int(judged * 1000)
    rows = train.filter("lang is not null").select("text", "lang", judges.alias("judges"))
    languages = sorted(r.lang for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    number = {k: i for i, k in enumerate(languages)}
    parts = rows.mapInArrow(_count_languages, "lang string, judges boolean, feature int, n double")
    sums = np.zeros((2, len(languages), FEATURES))
    for r in parts.groupBy("lang", "judges", "feature").agg(F.sum("n").alias("n")).collect():
        sums[int(r.judges), number[r.lang], r.feature] = r.n
    code = codewords(len(languages))
    trust, sure = np.ones(code.shape[1]), np.full(code.shape[1], np.inf)
    model = LanguageModel(languages, code, _bit_weights(sums.sum(axis=0), code), trust, sure, close)
    if code.shape[1]:
        apart = replace(model, weights=_bit_weights(sums[0], code))
        counts = rows.filter("judges").select("text", "lang").mapInArrow(_bit_errors(apart), "bit int, wrong long, n long")
        for r in counts.groupBy("bit").agg(F.sum("wrong").alias("w"), F.sum("n").alias("n")).collect():
            error = (r.w + 0.5) / (r.n + 1)
            error = min(0.5, error + 2 * math.sqrt(error * (1 - error) / (r.n + 1)))
            if r.n >= JUDGED_ROWS:
                trust[r.bit] = sure[r.bit] = math.log((1 - error) / error)
        trust[:] = trust / trust.mean() if trust.any() else 1
    return model


def _bit_errors(model: LanguageModel):
    number = {k: i for i, k in enumerate(model.languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrong, n = np.zeros(model.code.shape[1], np.int64), 0
        for batch in batches:
            for piece in slices(batch):
                texts, langs = piece.column(0).to_pylist(), piece.column(1).to_pylist()
                at = 0
                for block in _blocks(texts):
                    truth = model.code[[number[k] for k in langs[at : at + len(block)]]]
                    wrong += (model.margins(block) * truth <= 0).sum(axis=0)
                    at += len(block)
                n += len(texts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(wrong)), pa.int32()), pa.array(wrong), pa.array([n] * len(wrong), pa.int64())],
            ["bit", "wrong", "n"],
        )

    return count


def predicted(model: LanguageModel, text: str = "text") -> Column:
    """struct(lang, score, ambiguous) of a text column."""
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def predict(texts: pa.Array) -> pa.Array:
        found = [p for block in _blocks(texts.to_pylist()) for p in model.predict(block)]
        return pa.array([{"lang": k, "score": s, "ambiguous": a} for k, s, a in found], kind)

    return F.arrow_udf(predict, "lang string, score double, ambiguous boolean")(F.col(text))


def held_out() -> Column:
    """Rows kept from training: crc32 of doc_id as text, modulo 5, is 0 (NULL id: as '')."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def identify(docs: DataFrame, train: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of each row of ``docs`` (doc_id, text).

    Learns from the rows of ``train`` that are not held out.  NULL texts and texts without a
    letter are ``und`` with score 0; without training rows all texts are.
    """
    found = predicted(fit(train.filter(~held_out())))
    rows = docs.select("doc_id", held_out().alias("held_out"), found.alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.ambiguous")


def keep_known(docs: DataFrame, train: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose language is found and not ambiguous, with their own columns.

    NULL texts, empty ones and texts without a letter have no language: they go.
    """
    found = predicted(fit(train.filter(~held_out())))
    own, p = own_columns(docs), free_name(docs, "language_found")
    rows = docs.withColumn(p, found)
    return rows.filter((F.col(f"{p}.lang") != UND) & ~F.col(f"{p}.ambiguous")).select(*own)
