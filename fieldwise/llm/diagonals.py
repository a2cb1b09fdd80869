"""License scan by diagonal voting.

The hashes of all runs of K words of the corpus are joined to the runs of the templates; a hit
votes for the diagonal (place in the text less place in the template).  Neighbouring diagonals
(words more or less) are merged and the span is verified by alignment: enough of the template's
runs must be met in the template's order, within a span about as long as the template.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..stages import stage
from .common import slices
from .words import batch_words, grams, word_hash

K = 2
#: Phrases that are looked for literally: every place counts.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Labels of the method: usual wordings of licences and notices, found with small changes too.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this work is licensed under the gnu general public license": "gpl-notice",
    "this program is free software you can redistribute it and or modify it": "gpl-notice",
    "licensed under the gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under a creative commons attribution license": "cc-notice",
    "dedicated to the public domain": "public-domain",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions"
    " of the software": "mit",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the"
    " warranties of merchantability fitness for a particular purpose and noninfringement": "mit",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at":
    "apache-2.0",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed"
    " on an as is basis without warranties or conditions of any kind either express or implied": "apache-2.0",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following"
    " disclaimer": "bsd",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied"
    " warranty of merchantability or fitness for a particular purpose": "gpl-notice",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
    " granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this"
    " work": "cc0",
}
#: Share of a template's runs that a span must meet, and how many words it may be longer or
#: shorter than the template.
SHARE, DRIFT = 0.7, 4
#: Places of a template in one long of its set of places.
BITS = 63


def template_grams(spark: SparkSession, base: Mapping[str, str], templates: Mapping[str, str]) -> DataFrame:
    """(gram, template, label, literal, place, runs, block, bit): as many rows as the templates have words.

    ``bit`` marks the place in the ``block``-th long of a template's set of places.
    """
    rows = []
    for literal, phrases in ((True, base), (False, templates)):
        for phrase, label in phrases.items():
            hashes = grams(word_hash(phrase.split()), K).view(np.int64).tolist()
            if not hashes:
                raise ValueError(f"a template needs {K} words: {phrase!r}")
            rows += [
                (h, phrase, label, literal, p, len(hashes), p // BITS, 1 << p % BITS)
                for p, h in enumerate(hashes)
            ]
    kind = "gram long, template string, label string, literal boolean, place int, runs int, block int, bit long"
    return spark.createDataFrame(rows, kind)


def _corpus_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All runs of K words; a text gives one row more, without a run, that carries it along."""
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        for piece in slices(batch):
            words = batch_words(piece.column(1))
            sizes = np.diff(words.first)
            doc = np.repeat(np.arange(piece.num_rows), sizes)
            runs = grams(words.hashes, K)
            whole = doc[: len(runs)] == doc[K - 1 :][: len(runs)]
            runs, own = runs[whole].view(np.int64), doc[: len(runs)][whole]
            place = np.flatnonzero(whole) - words.first[own]
            bare = np.arange(piece.num_rows)
            every = np.concatenate([own, bare])
            gram = np.concatenate([runs, np.zeros(len(bare), np.int64)])
            at = np.concatenate([place, np.full(len(bare), -1)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + every, pa.int64()), piece.column(0).take(pa.array(every)),
                 pa.array(sizes[every], pa.int64()), pa.array(at, pa.int32()),
                 pa.array(gram, pa.int64(), mask=at < 0)],
                ["row", "doc_id", "n_words", "at", "gram"],
            )
            row += piece.num_rows


def _aligned(
    diagonals: list[int] | None, places: list[list[int]] | None, runs: int | None
) -> tuple[int, int, int] | None:
    """The longest chain of hits in the order of both text and template, the shortest of these.

    ``places`` has the set of the template's places met on each of the few diagonals; None for
    rows that need no alignment.
    """
    if diagonals is None:
        return None
    # best[j][p]: the best chain that ends on diagonal j before place p, as (hits, first, -last)
    best = [[(0, 0, 0)] for _ in diagonals]
    for p in range(runs):
        for j, d in enumerate(diagonals):
            top = best[j][p]
            if places[j][p // BITS] >> p % BITS & 1:
                # an earlier hit q on diagonal e stands before this one: q < p and q + e < p + d
                met, first, _ = max(b[max(min(p, p + d - e), 0)] for b, e in zip(best, diagonals))
                top = max(top, (met + 1, first if met else p + d, -(p + d)))
            best[j].append(top)
    met, first, last = max(b[runs] for b in best)
    return met, first, -last


def spans(docs: DataFrame, base: Mapping[str, str], templates: Mapping[str, str]) -> DataFrame:
    """Verified spans and bare rows of ``docs`` (doc_id, text).

    Columns row, doc_id, n_words, label, literal, first, last (words of the span), share (of the
    template's runs that were met).  Every text has one row with NULL label besides its spans.
    A place of a template counts once in a span, however often its words are repeated there,
    and places out of order do not count together.  Spans of one template may overlap, as
    different alignments that are both good enough.
    Only hits are shuffled, and first counted where they are found; what is aligned are the
    sets of places on at most DRIFT + 1 diagonals.
    """
    known = stage(template_grams(docs.sparkSession, base, templates), "templates")
    blocks = range(max(len(t.split()) for t in (*base, *templates)) // BITS + 1)
    places = [F.bit_or(F.when(F.col("block") == j, F.col("bit"))) for j in blocks]
    rows = docs.select("doc_id", "text").mapInArrow(
        _corpus_grams, "row long, doc_id long, n_words long, at int, gram long"
    )
    met = rows.join(known, "gram", "left").filter("label is not null or at < 0")
    own = ["row", "doc_id", "n_words", "template", "label", "literal", "runs"]
    votes = met.groupBy(*own, (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.count("template").alias("votes"), *[p.alias(f"places{j}") for j, p in zip(blocks, places)]
    )
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, DRIFT)
    sets = F.array(*[F.coalesce(F.col(f"places{j}"), F.lit(0)) for j in blocks])
    merged = votes.withColumns({
        "found": F.collect_list(F.struct("diagonal", sets.alias("places"))).over(near),
        "most": F.max("votes").over(near),
        "all_votes": F.sum("votes").over(near),
    })
    whole = F.col("votes") == F.col("runs")
    # a diagonal that has the whole template speaks for those just before it; literal phrases
    # stand on one diagonal
    maybe = ~F.col("literal") & (F.col("most") < F.col("runs")) & (F.col("all_votes") >= SHARE * F.col("runs"))
    merged = merged.filter(F.col("label").isNull() | whole | maybe)
    align = F.udf(_aligned, "struct<met:int,first:int,last:int>", useArrow=True)
    parts = F.when(maybe, F.col("found"))
    merged = merged.withColumn("partly", align(parts["diagonal"], parts["places"], "runs")).withColumns({
        "met": F.when(whole, F.col("runs")).otherwise(F.col("partly.met")),
        "first": F.when(whole, F.col("diagonal")).otherwise(F.col("partly.first")),
        "end": F.when(whole, F.col("diagonal") + F.col("runs") - 1).otherwise(F.col("partly.last")),
    })
    best = merged.filter(F.col("label").isNull() | (F.col("met") >= SHARE * F.col("runs"))).groupBy(*own, "end").agg(
        F.max("met").alias("met"), F.max_by("first", F.struct("met", "first")).alias("first")
    )
    return best.select(
        "row", "doc_id", "n_words", "label", "literal", "first", (F.col("end") + K - 1).alias("last"),
        (F.col("met") / F.col("runs")).alias("share"),
    )


def scan(docs: DataFrame, base: Mapping[str, str] = BASE, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): what license wording it has.

    doc_id, n_words, n_base (places of base phrases), first_word and last_word (smallest and
    largest start of one, else NULL), base_labels, labels (with those of the templates; both
    distinct, sorted, comma-joined, '' if none) and score (largest share of a template or base
    phrase that was met, 0 if none).  NULL and empty texts have no word and no label.
    """
    literal = F.coalesce(F.col("literal"), F.lit(False))
    return spans(docs, base, templates).groupBy("row", "doc_id", "n_words").agg(
        F.count_if(literal).alias("n_base"),
        F.min(F.when(literal, F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(literal, F.col("first"))).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(literal, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("label").isNotNull(), F.col("share"))), F.lit(0.0)).alias("score"),
    ).drop("row")
