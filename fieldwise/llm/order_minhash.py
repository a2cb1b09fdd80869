"""Near-duplicates by Order MinHash.

A text's shingles (five words) are labelled with their occurrence number, so that all are
different.  Each of SKETCHES sketches takes the PICKS labelled shingles with the smallest
hashes and keeps them in the order of the text: two texts share a sketch with a chance that
falls with lost shingles and with changed order.  Short texts have exact keys instead: of the
labelled shingles that two linked texts have in common in one order, the PICKS with the
smallest hashes are among the first n - ceil(0.8 n) + PICKS of either text, as it has at most
n - ceil(0.8 n) others.  Every PICKS of those, in the order of the text, are a key.
Texts that share a sketch or key are candidates;
the verdict is a banded alignment of their labelled shingles:
    likeness = a / (n1 + n2 - a),  a = longest common subsequence within the band.
A likeness of 0.8 needs a >= (n1 + n2) * 4/9, so aligned shingles are at most (n1 + n2) / 9
positions apart: the band loses nothing.  Labelled shingles are unique in a text, so the
common subsequence is a longest increasing run of positions.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stages import stage
from .common import U64, digest, free_name, mix, own_columns, random_words, same, slices
from .components import components
from .words import batch_words, grams

WORDS = 5
LIKENESS = 0.8
#: A pair with ``a`` of ``u`` different labelled shingles in common shares one sketch with a
#: chance of C(a, 4) / C(u, 4): at likeness 0.8 none of 20 with 6e-5 for u = 25, falling to 3e-5
#: for long texts; a pair of likeness 0.2 shares one of 20 with about 0.03.
SKETCHES = 20
PICKS = 4
#: Texts of up to so many labelled shingles have exact keys (at most 70): no link between two
#: such texts is lost.
EXACT = 24
#: Members of a block: two blocks of a bucket meet in one task.
BLOCK = 256
_SEEDS = random_words(SKETCHES, 3)
_EXACT_SEED = random_words(1, 13)[0]
_STEP = U64(0xD6E8FEB86659FD93)


def labelled_shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, occurrence) in text order; a shorter text is one shingle."""
    if not len(words):
        return words
    s = grams(words, min(WORDS, len(words)))
    order = np.argsort(s, kind="stable")
    sorted_ = s[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = sorted_[1:] != sorted_[:-1]
    if fresh.all():
        return s
    at = np.arange(len(s))
    occurrence = at - np.maximum.accumulate(np.where(fresh, at, 0))
    out = np.empty_like(s)
    out[order] = mix(sorted_ + occurrence.astype(U64) * _STEP)
    return out


def sketches(labelled: np.ndarray) -> np.ndarray:
    """One key per sketch: the smallest labelled shingles in text order, hashed together."""
    picks = min(PICKS, len(labelled))
    out = np.empty(SKETCHES, U64)
    step = max(1, (1 << 20) // max(1, len(labelled)))
    for i in range(0, SKETCHES, step):
        drawn = mix(labelled[None, :] ^ _SEEDS[i : i + step, None])
        least = np.argpartition(drawn, picks - 1, axis=1)[:, :picks]
        least.sort(axis=1)
        key = _SEEDS[i : i + step].copy()
        for j in range(picks):
            key = key * _STEP + labelled[least[:, j]]
        out[i : i + step] = mix(key)
    return out


@lru_cache(maxsize=None)
def _choices(n: int, picks: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), picks)))


def exact_keys(labelled: np.ndarray) -> np.ndarray:
    """Keys of which two texts of likeness LIKENESS or more always share one."""
    n = len(labelled)
    picks = min(PICKS, n)
    some = n - math.ceil(LIKENESS * n - 1e-9) + picks
    first = labelled[np.sort(np.argsort(mix(labelled ^ _EXACT_SEED))[:some])]
    chosen = first[_choices(some, picks)]
    key = np.full(len(chosen), _EXACT_SEED, U64)
    for j in range(picks):
        key = key * _STEP + chosen[:, j]
    return mix(key)


def candidate_keys(labelled: np.ndarray) -> np.ndarray:
    """Exact keys of a short text; sketches where a partner may be too long for exact keys."""
    n = len(labelled)
    exact = [exact_keys(labelled)] if n <= EXACT else []
    return np.concatenate(exact + ([sketches(labelled)] if n > LIKENESS * EXACT else []))


def alignment(a: np.ndarray, b: np.ndarray, least: float = LIKENESS) -> float:
    """Likeness of two arrays of labelled shingles; 0.0 where it cannot reach ``least``."""
    n1, n2 = len(a), len(b)
    need = least / (1 + least) * (n1 + n2) - 1e-9
    if not n1 or not n2 or min(n1, n2) < need:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = n1 + n2 - 2 * need
    near = np.abs(i - j) <= band + 1e-6
    if np.count_nonzero(near) < need:
        return 0.0
    i, j = i[near], j[near]
    j = j[np.argsort(i)]
    if (np.diff(j) > 0).all():
        run = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            at = bisect.bisect_left(tails, x)
            tails[at : at + 1] = [x]
        run = len(tails)
    return run / (n1 + n2 - run)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch):
            texts = piece.column(1)
            words = batch_words(texts)
            keys, at, marks = [], [0], []
            seen: set[bytes] = set()
            for d, text in enumerate(texts.to_pylist()):
                marks.append(hashlib.md5((text or "").encode()).digest())
                labelled = labelled_shingles(words.of(d)) if marks[-1] not in seen else ()
                if len(labelled):
                    seen.add(marks[-1])
                    keys.append(candidate_keys(labelled).view(np.int64))
                at.append(at[-1] + (len(keys[-1]) if len(labelled) else 0))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(marks, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))],
                ["doc_id", "node", "keys"],
            )


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles): the labelled shingles of each text, computed once for all comparisons."""
    for batch in batches:
        for piece in slices(batch):
            words = batch_words(piece.column(1))
            found = [labelled_shingles(words.of(d)).view(np.int64) for d in range(piece.num_rows)]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])


def _sets(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, at = column.flatten().to_numpy().view(U64), column.offsets.to_numpy()
    at = at - at[0] if len(at) else at
    return [flat[x:y] for x, y in zip(at, at[1:])]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        like = [alignment(x, y) for x, y in zip(_sets(batch.column(2)), _sets(batch.column(3)))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(like, pa.float64())], ["a", "b", "likeness"]
        )


def shared_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many elements each two of the sets have in common."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, element, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.cumsum(times > 1) - 1
    keep = times[element] > 1
    owner, element = owner[keep], common[element[keep]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for begin in range(0, int(element.max(initial=-1)) + 1, columns):
        now = (element >= begin) & (element < begin + columns)
        part = np.zeros((len(sets), columns), np.float32)
        part[owner[now], element[now] - begin] = 1
        out += part @ part.T
    return out


def _block_links(table: pa.Table) -> pa.Table:
    """Links that join the classes of two blocks of a bucket: fewer than they have members."""
    nodes, blocks = table["node"].to_pylist(), np.array(table["block"].to_pylist())
    label = np.unique(np.array([x.hex() for x in table["label"].to_pylist()]), return_inverse=True)[1]
    sets = _sets(table["shingles"])
    n = np.array([len(x) for x in sets])
    need = LIKENESS / (1 + LIKENESS) * (n[:, None] + n[None, :]) - 1e-3
    maybe = (shared_counts(sets) >= need) & (label[:, None] != label[None, :])
    if blocks.min() != blocks.max():  # pairs inside a block meet in a task of their own
        maybe &= blocks[:, None] != blocks[None, :]
    root, found = list(range(int(label.max()) + 1)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in zip(*np.nonzero(np.triu(maybe, 1))):
        x, y = find(label[i]), find(label[j])
        if x == y:  # joined by an earlier pair
            continue
        likeness = alignment(sets[i], sets[j])
        if likeness >= LIKENESS:
            root[x] = y
            found.append((nodes[i], nodes[j], likeness))
    a, b, like = zip(*found) if found else ((), (), ())
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "likeness": pa.array(like, pa.float64())})


def _open_links(named: DataFrame, texts: DataFrame) -> DataFrame:
    """Written links between classes inside buckets (bucket, node, label) that hold several classes.

    The members of a bucket's largest class need not meet each other: only the others are
    queries.  Both are dealt into blocks of about BLOCK; every block of queries meets every
    block of the bucket in one task, so that no task sees a whole bucket and no pair is a row.
    """
    kinds = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("size"))
    # min_by of plain columns: the largest class, of equal ones that with the smallest name
    order = F.concat(F.lpad((F.lit(2**40) - F.col("size")).cast("string"), 13, "0"), F.hex("label"))
    sizes = kinds.groupBy("bucket").agg(
        F.min(order).alias("top"), F.sum("size").alias("size"), F.max("size").alias("most")
    ).filter("size > most")
    several = stage(sizes.select(
        "bucket", F.unhex(F.substring("top", 14, 32)).alias("main"),
        F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int").alias("queries"),
        F.ceil(F.col("most") / BLOCK).cast("int").alias("others"),
    ), "open")
    rows = named.join(several, "bucket")
    main, hashed = F.col("label") == F.col("main"), F.xxhash64("node")
    dealt = F.when(main, F.col("queries") + F.pmod(hashed, F.col("others"))).otherwise(F.pmod(hashed, F.col("queries")))
    rows = rows.withColumn("block", dealt.cast("int"))
    last = F.when(main, F.col("queries")).otherwise(F.col("queries") + F.col("others")) - 1
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select(
        "bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "label"
    )
    met = rows.join(texts, "node").groupBy("bucket", "lo", "hi")
    return stage(met.applyInArrow(_block_links, "a binary, b binary, likeness double"), "links")


def _buckets(nodes: DataFrame) -> DataFrame:
    """Written (bucket, node, lead) of buckets with several texts; ``lead`` is the smallest of them.

    The smallest digest is the smallest wherever its text is, so that texts of one group meet few leads.
    """
    rows = nodes.select(F.explode("keys").alias("bucket"), "node").distinct()
    leads = rows.groupBy("bucket").agg(F.min(F.hex("node")).alias("lead"), F.count(F.lit(1)).alias("size"))
    leads = leads.filter("size > 1").select("bucket", F.unhex("lead").alias("lead"))
    return stage(rows.join(leads, "bucket"), "buckets")


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Written (a, b, likeness) of those ``pairs`` that the alignment confirms."""
    x = texts.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = texts.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    found = both.mapInArrow(_verify, "a binary, b binary, likeness double")
    return stage(found.filter(F.col("likeness") >= LIKENESS), "links")


def classes(docs: DataFrame) -> DataFrame:
    """Written (doc_id, node, class_id, first_id, keeper): the class of every row of ``docs``.

    Rows with equal texts (NULL and empty are equal) are one node; ``node`` is the text's md5,
    ``first_id`` the smallest doc_id with it, ``class_id`` the smallest doc_id of the class and
    ``keeper`` the text that has it (the smallest digest of several).
    Classes are the connected components of links between different texts.  Texts without a
    word have only exact copies.

    Buckets of texts with one sketch in common are not expanded into pairs: first every text
    meets its buckets' leads, and texts linked through leads are one class.  What is then left open
    in a bucket is compared in full, in blocks, so no link between classes is lost.  Copies meet in
    one node before any of this.
    """
    made = docs.select("doc_id", "text").mapInArrow(_sketch, "doc_id long, node binary, keys array<long>")
    made = stage(made, "sketches")
    firsts = stage(made.groupBy("node").agg(F.min("doc_id").alias("first_id")), "firsts")
    live = _buckets(made.filter(F.size("keys") > 0))

    wanted = live.select("node").distinct().join(firsts, "node").select(F.col("node").alias("w_node"), "first_id")
    rows = docs.select("doc_id", "text", digest().alias("node"))
    rows = rows.join(wanted, same(rows, wanted, {"node": "w_node", "doc_id": "first_id"}))
    rows = rows.groupBy("node").agg(F.any_value("text").alias("text"))
    texts = stage(rows.mapInArrow(_shingles, "node binary, shingles array<long>"), "shingles")

    pairs = live.filter("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    to_leads = _links(pairs, texts)
    near = components(to_leads).select(F.col("node").alias("n_node"), F.col("label").alias("near"))
    label = F.coalesce("near", "node").alias("label")
    named = stage(live.join(near, F.col("node") == F.col("n_node"), "left").select("bucket", "node", label), "named")
    found = to_leads.unionByName(_open_links(named, texts))
    labels = components(found)
    named = firsts.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = stage(named, "named")
    first = F.min(F.struct(F.col("first_id").isNull(), F.col("first_id"), F.col("node"))).alias("k")
    keepers = named.groupBy("label").agg(first).select(
        F.col("label").alias("k_label"), F.col("k.first_id").alias("class_id"), F.col("k.node").alias("keeper")
    )
    named = named.join(keepers, F.col("label") == F.col("k_label")).select(
        F.col("node").alias("c_node"), "first_id", "class_id", "keeper"
    )
    out = made.select("doc_id", "node").join(named, F.col("node") == F.col("c_node"))
    return stage(out.select("doc_id", "node", "class_id", "first_id", "keeper"), "classes")


#: The row that stays for its class; of rows with equal ids and texts the first.
_STAYS = "node = keeper and doc_id <=> first_id"


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), kept (stays when one row of each class does).

    Rows without a doc_id come last in their class; a class of such rows only has class_id NULL.
    Two texts under one doc_id are two documents: their classes may bear the same class_id.
    """
    rank = Window.partitionBy("node", "doc_id").orderBy(F.lit(1))
    out = classes(docs).withColumn("copy", F.row_number().over(rank))
    return out.select("doc_id", "class_id", F.expr(f"{_STAYS} and copy = 1").alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay when one row of each class does, with their own columns.

    The row with the class's smallest doc_id stays; of rows with equal ids and texts one.
    """
    own, node, copy = own_columns(docs), free_name(docs, "text_digest"), free_name(docs, "copy_number")
    keepers = classes(docs).filter(_STAYS).select(F.col("doc_id").alias("k_id"), F.col("node").alias("keeper"))
    rows = docs.withColumn(node, digest())
    kept = rows.join(keepers, same(rows, keepers, {"doc_id": "k_id", node: "keeper"}), "left_semi")
    rank = Window.partitionBy("doc_id", node).orderBy(F.lit(1))
    return kept.withColumn(copy, F.row_number().over(rank)).filter(F.col(copy) == 1).select(*own)
