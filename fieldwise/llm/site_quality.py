"""Quality classifier: evidence of the text, on top of shrunk rates of its site and path.

The text's evidence is a sum of log-likelihood ratios over a few binned shares (naive Bayes,
counted by one aggregation over all labelled rows).  Site and path rates come from the same
labels, shrunk from path to site to all (shrink.py), so that sparse sites lean on the whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stages import stage
from .common import own_columns, slices, text_buffer
from .shrink import mean, posteriors
from .words import batch_words

SYMBOLS = b"!#$%&*+<=>@\\^_`{|}~"
#: Values of the shares of symbols, capitals and repeated words, which form one joint feature,
#: as bad texts often have just one of them.
JOINT = (7, 7, 6)
#: Bins of each feature; a model holds one ratio per bin.
BINS = (7 * 7 * 6, 7, 21, 32, 8)
#: Added to the count of every bin.
SMOOTH = 0.25
_CLASS = np.zeros(256, np.int8)
for _c in SYMBOLS:
    _CLASS[_c] = 1
_CLASS[65:91], _CLASS[48:58], _CLASS[10], _CLASS[32] = 2, 3, 4, 5


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit length: 0, 1, 2, 2, 3, 3, 3, 3, 4, ..."""
    return np.frexp(x.astype(float))[1].astype(np.int64)


def text_bins(texts: pa.Array) -> pa.Array:
    """Bin numbers of every text: the joint shares of symbols, capitals and words that repeat
    the one before, the share of digits, bytes per word, the length, lines per hundred bytes
    (all but bytes per word by powers of two).  NULL and empty texts have all zero."""
    data, at = text_buffer(texts)
    kind, n = _CLASS[data], np.diff(at)
    counts = np.zeros((6, len(n)), np.int64)
    full = np.flatnonzero(n)
    for c in range(1, 6):
        if len(full):
            counts[c, full] = np.add.reduceat(kind == c, at[:-1][full], dtype=np.int64)
    words = batch_words(texts)
    again = np.zeros(max(2, len(words.hashes) + 1), np.int64)
    again[2:] = np.cumsum(words.hashes[1:] == words.hashes[:-1])
    per_text = np.diff(words.first)
    # words first + 1 .. of a text have one before them in it
    repeats = again[words.first[1:]] - again[np.minimum(words.first[:-1] + 1, words.first[1:])]
    size = np.maximum(n, 1)
    shares = 40 * counts[1] // size, 40 * counts[2] // size, 20 * repeats // np.maximum(per_text, 1)
    joint = np.zeros(len(n), np.int64)
    for share, values in zip(shares, JOINT):
        joint = joint * values + np.minimum(_bits(share), values - 1)
    raw = (
        joint, _bits(40 * counts[3] // size), n // (counts[4] + counts[5] + 1), _bits(n),
        _bits(100 * counts[4] // size),
    )
    bins = np.stack([np.minimum(r, b - 1) for r, b in zip(raw, BINS)], axis=1).astype(np.int32)
    at = pa.array(np.arange(len(n) + 1) * len(BINS), pa.int32())
    return pa.ListArray.from_arrays(at, pa.array(bins.ravel(), pa.int32()))


def bins_of(text: str = "text") -> Column:
    def bins(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [text_bins(piece.column(0)) for piece in slices(batch)]
        return pa.concat_arrays(parts) if parts else text_bins(texts)

    return F.arrow_udf(bins, "array<int>")(F.col(text))


def site_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


@dataclass
class QualityModel:
    ratios: list[list[float]]  # by feature and bin; as many as BINS says, whatever the data
    paths: DataFrame  # q_site, q_path, q_rate of each site and path with rows
    overall: float  # rate where a path has no row


def fit(docs: DataFrame, labels: DataFrame, site: str = "source", path: str = "lang") -> QualityModel:
    """Fit on all rows of ``docs`` (doc_id, text, site and path columns) with a label.

    ``labels`` has doc_id and quality (1 good, 0 bad; NULLs do not count; several labels of a
    document count each).  NULL sites and paths count as ''.  Text is read once, in place:
    only bin numbers and ids are shuffled.
    """
    known = labels.filter("quality is not null").select(
        F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("good")
    )
    rows = docs.select("doc_id", site_of(site).alias("q_site"), site_of(path).alias("q_path"), bins_of().alias("bins"))
    rows = stage(rows.join(known, F.col("doc_id") == F.col("l_id")), "labelled")
    binned = rows.select("good", F.posexplode("bins").alias("feature", "bin"))
    table = binned.groupBy("feature", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good")
    )
    good = [[0.0] * b for b in BINS]
    bad = [[0.0] * b for b in BINS]
    for r in table.collect():  # at most sum(BINS) rows
        good[r.feature][r.bin], bad[r.feature][r.bin] = r.good, r.n - r.good
    ratios = [
        [
            math.log((g + SMOOTH) / (sum(gs) + SMOOTH * len(gs))) - math.log((b + SMOOTH) / (sum(bs) + SMOOTH * len(bs)))
            for g, b in zip(gs, bs)
        ]
        for gs, bs in zip(good, bad)
    ]
    counts = stage(
        rows.groupBy("q_site", "q_path").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("k")),
        "path-counts",
    )
    paths = stage(
        posteriors(counts, ["q_site", "q_path"]).select("q_site", "q_path", mean().alias("q_rate")), "path-rates"
    )
    n, k = counts.agg(F.sum("n"), F.sum("k")).first()
    return QualityModel(ratios, paths, ((k or 0) + 0.5) / ((n or 0) + 1))


def score(docs: DataFrame, model: QualityModel, site: str = "source", path: str = "lang") -> DataFrame:
    """All columns of ``docs`` and q_site, q_path, q_text (log ratio of the text), q_rate
    (shrunk rate of its path) and q_score (probability of good).

    A path without labelled rows has the overall rate; a NULL or empty text is scored by its
    zero bins.  Text stays in place; only the paths' rates are joined.
    """
    out = docs.withColumns({"q_bins": bins_of(), "q_site": site_of(site), "q_path": site_of(path)})
    text = F.lit(0.0)
    for i, rates in enumerate(model.ratios):
        text = text + F.element_at(F.lit(rates), F.col("q_bins")[i] + 1)
    out = out.withColumn("q_text", text).join(model.paths, ["q_site", "q_path"], "left")
    out = out.withColumn("q_rate", F.coalesce("q_rate", F.lit(model.overall)))
    logit = F.col("q_text") + F.log(F.col("q_rate") / (1 - F.col("q_rate")))
    return out.withColumn("q_score", 1 / (1 + F.exp(-logit))).drop("q_bins")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` with a score of at least ``least``, with their own columns.

    Without labels every document is kept.
    """
    own, kept_names = own_columns(docs), [f"d_{i}" if _inner(c) else c for i, c in enumerate(docs.columns)]
    renamed = docs.select(*[c.alias(n) for c, n in zip(own, kept_names)])
    kept = score(renamed, fit(renamed, labels)).filter(F.col("q_score") >= least - 1e-12)
    return kept.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(kept_names, docs.columns)])


def _inner(name: str) -> bool:
    """Whether a column may clash with those added here, or must be quoted."""
    return name not in ("doc_id", "text", "source", "lang")
