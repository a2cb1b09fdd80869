"""Exact dedup, pivot clusters and stripes against brute force."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwise.llm import exact_dedup, order_minhash, output_codes, pivot_clusters, site_quality, spaced_seeds, stripes
from fieldwise.llm.components import components

SCHEMA = "doc_id long, text string, lang string, row string, digest string, Length int, keep_id int, `a.b` int"


def documents(spark, rows, parts=3):
    data = [(i, t, lang, "clash", "clash", 1, 2, 3) for i, t, lang in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def random_rows(seed, n, texts):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        t = texts[int(rng.integers(len(texts)) * rng.random())]
        if t is not None and rng.random() < 0.5:
            at = int(rng.integers(len(t) + 1))
            t = t[:at] + str(rng.choice([" ", "\t", "\n", "\r", "\x0b\x0c", "  "])) + t[at:]
        out.append((None if rng.random() < 0.05 else int(rng.integers(n)), t, "en"))
    return out


def brute_groups(rows):
    """Rows of (doc_id, keep_id, size, sha256), and how many rows stay."""
    groups = defaultdict(list)
    for doc_id, text, _ in rows:
        text = text or ""
        groups[re.sub("[\x20\x09-\x0d]", "", text)].append((-len(text), doc_id is None, doc_id or 0, doc_id))
    out = []
    for text, members in groups.items():
        keep = min(members)[3]
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(m[3], keep, len(members), sha) for m in members]
    return out, len(groups)


def as_sorted(rows):
    return sorted(rows, key=lambda t: tuple((x is not None, x) for x in t))


@pytest.mark.parametrize("share", [1e-4, 0.2, 2.0])
@pytest.mark.parametrize("slots", [64, 1 << 16])
def test_exact_groups(spark, monkeypatch, share, slots):
    """Hot groups by broadcast or join, and a filter that is full: the same rows."""
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", share)
    monkeypatch.setattr(exact_dedup, "SLOTS", (slots, slots))
    texts = [None, "", "the same", "thesame", "é ö🎉", "é ö🎉", *(f"text {i}" for i in range(60)), "long " * 30_000]
    rows = random_rows(5, 300, texts) + [(7, "x y", "en")] * 3
    got = exact_dedup.exact_groups(documents(spark, rows)).collect()
    want, groups = brute_groups(rows)
    assert as_sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == as_sorted(want)
    kept = [r for r in got if r.kept]
    assert len(kept) == groups and len({r.text_sha256 for r in kept}) == groups
    assert all(r.doc_id == r.keep_id for r in kept)


def test_filter_misses_no_copy(spark):
    rows = spark.range(5000).select(F.unhex(F.sha2((F.col("id") % 4000).cast("string"), 256)).alias("digest"))
    bits = exact_dedup.filter_of_repeated(rows, exact_dedup.slots_for(5000))
    again = rows.filter(exact_dedup.possibly_repeated(F.col("digest"), spark, bits)).groupBy("digest").count()
    counts = Counter(r["count"] for r in again.collect())
    assert counts[2] == 1000 and counts[1] < 3000 * 0.05


def test_exact_groups_of_nothing(spark):
    assert exact_dedup.exact_groups(documents(spark, [])).collect() == []


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (sha(r[0]), r[1]))[:k]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        members = defaultdict(list)
        for (_, v), (_, j) in zip(kept, assign()):
            members[j].append(v)
        for j, vs in members.items():
            centroids[j] = [sum(c) // len(vs) for c in zip(*vs)]
    found = assign()
    per = Counter()
    for d, j in found:
        per[j] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, j, d, per[j], sum(per.values()), name[j]) for (i, _), (d, j) in zip(kept, found)]


def vectors(seed, n, spread=0.2):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(0, spread, 64).astype(np.float32)]) for i in range(n)]
    odd = [(None, None), (1, [0.5] * 63), (2, [0.5] * 65), (3, [None] + [0.1] * 63), (4, [math.nan] + [0.1] * 63),
           (5, [math.inf] + [0.1] * 63), (None, [0.25] * 64), (6, rows[0][1]), (0, rows[0][1]), (7, [])] if n else []
    return rows + odd


@pytest.mark.parametrize("n, spread", [(400, 0.2), (60, 0.01), (5, 1000.0), (0, 1.0)])
def test_pivot_clusters(spark, n, spread):
    rows = vectors(2, n, spread)
    frame = spark.createDataFrame([(i, v, 9, "x") for i, v in rows], "vec_id long, embedding array<float>, Cluster int, v string")
    got = pivot_clusters.clusters(frame.repartition(3)).collect()
    assert as_sorted(map(tuple, got)) == as_sorted(brute_clusters(rows))


def test_pivots_spare_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (16, 64))
    x = np.repeat(centres, 50, axis=0) + rng.integers(-5, 6, (800, 64))
    pivots = pivot_clusters.pivots_of(centres)
    best, squared, asked = pivot_clusters.nearest(x, pivot_clusters.roots_to(x, pivots), centres, pivots)
    exact = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (best == exact.argmin(axis=1)).all() and (squared == exact.min(axis=1)).all()
    assert asked < 0.2 * exact.size


def test_ties_go_to_the_smaller_number():
    x, centres = np.zeros((3, 64), np.int64), np.ones((4, 64), np.int64)
    table = pivot_clusters.roots_to(x, centres[:1])
    assert pivot_clusters.nearest(x, table, centres, centres[:1])[0].tolist() == [0, 0, 0]


def test_too_large_components_are_refused(spark):
    frame = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="or more"):
        pivot_clusters.clusters(frame).collect()


def brute_collocations(rows, min_count, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + s]) for s in range(1, 5) for i in range(len(w) - s + 1))
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        longest = Counter()
        for p, a in candidates.items():
            for s in range(2, len(p)):
                for i in range(len(p) - s + 1):
                    longest[p[i : i + s]] = max(longest[p[i : i + s]], a)
        ranked = []
        for p, a in candidates.items():
            if p in longest and 100 * longest[p] >= 80 * a:
                continue
            score, _, left, right = min(
                (2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def phrase_rows():
    rng = np.random.default_rng(4)
    words = ["the", "The", "of", "new", "york", "city", "é", "日本", "x\x1cy", "a b", "-", "'s"]
    marks = [" ", "  ", "\t", " ", " ", ", ", ".", "\n", "\x0b", "\r\n", "? "]
    rows = []
    for i in range(120):
        size = int(rng.integers(0, 60))
        text = "".join(str(rng.choice(words)) + str(rng.choice(marks, p=[0.6] + [0.04] * 10)) for _ in range(size))
        rows.append((i, text, [None, "en", "fr", "und"][int(rng.integers(4))]))
    return rows + [(1, None, None), (2, "", "de"), (3, " ,. ", "de"), (None, "new york city " * 40, "en"), (3, "z " * 50_000, "en")]


@pytest.mark.parametrize("stretch, share", [(8 << 20, 1e-3), (40, 0.05)])
def test_collocations(spark, monkeypatch, stretch, share):
    """Whole batches or short stretches, few or many stripes in parts: the same phrases."""
    monkeypatch.setattr(stripes, "STRETCH", stretch)
    monkeypatch.setattr(stripes, "HOT_SHARE", share)
    rows = phrase_rows() if stretch > 1000 else phrase_rows()[:-1]
    for min_count, top in ((3, 2000), (30, 5)):
        got = stripes.collocations(documents(spark, rows), min_count, top).collect()
        assert sorted(map(tuple, got)) == sorted(brute_collocations(rows, min_count, top))


def test_a_full_phrase_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(stripes, "FILTER_BITS", 64)
    rows = phrase_rows()[:60]
    got = stripes.collocations(documents(spark, rows), 3).collect()
    assert sorted(map(tuple, got)) == sorted(brute_collocations(rows, 3))


def test_stretches_end_with_pieces():
    data = np.frombuffer(b"aa bb,cc dd\nee" + b"ff gg", np.uint8)
    at = np.array([0, 14, 14, 19])
    assert list(stripes.stretches(data, at, 1000)) == [(0, 19)]
    assert list(stripes.stretches(data, at, 1)) == [(0, 6), (6, 12), (12, 14), (14, 19)]
    assert list(stripes.stretches(data, at, 13)) == [(0, 12), (12, 19)]
    assert list(stripes.stretches(data[:0], at[:1], 13)) == []


def test_collocations_of_nothing(spark):
    assert stripes.collocations(documents(spark, [])).collect() == []
    assert stripes.collocations(documents(spark, [(1, None, None), (2, " . ", "en")])).collect() == []


CLASHES = "Q_SCORE int, q_Site int, TEXT_DIGEST int, Copy_Number int, LANGUAGE_FOUND int, `a.b` int, `c``d` int, K_ID int, Bad_Text int"


def test_stages_leave_the_users_columns_alone(spark):
    """Names that differ from inner ones by case, dotted and quoted names."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    extra = CLASHES.split(", ")
    names = [c.rsplit(" ", 1)[0] for c in extra]
    docs = docs.select("*", *[F.lit(i).alias(n.strip("`").replace("``", "`")) for i, n in enumerate(names)])
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    stages = {
        "good": lambda d: site_quality.keep_good(d, labels), "known": lambda d: output_codes.keep_known(d, d),
        "one": order_minhash.keep_one, "clean": lambda d: spaced_seeds.keep_clean(d, bench),
    }
    for name, run in stages.items():
        out = run(docs)
        assert out.columns == docs.columns, name
        found = out.select(*[F.col(n) for n in names]).distinct().collect()
        assert [tuple(r) for r in found] == [tuple(range(len(names)))], name


@pytest.mark.parametrize("in_task", [500_000, 3])
def test_components(spark, in_task):
    rng = np.random.default_rng(3)
    name = lambda i: hashlib.md5(str(i).encode()).digest()
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2)) if a != b]
    links += [(400 + i, 401 + i) for i in range(60)] + [(500, 501 + i) for i in range(40)] + links[:5]
    frame = spark.createDataFrame([(name(a), name(b)) for a, b in links], "a binary, b binary")
    got = {bytes(r.node): bytes(r.label) for r in components(frame, in_task).collect()}
    group = {}
    for a, b in links:
        group.setdefault(a, {a}), group.setdefault(b, {b})
        whole = group[a] | group[b]
        for x in whole:
            group[x] = whole
    assert set(got) == {name(x) for x in group}
    assert all((got[name(x)] == got[name(y)]) == (y in group[x]) for x in group for y in group)
    assert components(frame.limit(0), in_task).collect() == []


def test_every_accepted_overlap_has_a_seed():
    """All places of differing words: items of 1 to 12 words whole, stretches of 13 to 25 words.

    As many words differ as may: where fewer do, the same seed is there.
    """
    for n in range(1, 26):
        whole = n < spaced_seeds.OVERLAP
        masks = spaced_seeds.whole_masks(n) if whole else spaced_seeds.MASKS
        seeds = [int(m, 2) << s for m in masks for s in range(n - len(m) + 1)]
        differ = n - math.ceil(0.8 * n - 1e-9)
        for gone in itertools.combinations(range(1, n - 1) if whole else range(n), differ):
            agree = (1 << n) - 1 - sum(1 << p for p in gone)
            assert any(agree & m == m for m in seeds), (n, gone)


def test_short_items_and_whole_documents_by_brute_force(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words, int(rng.integers(1, 20))))) for i in range(40)] + [(98, ""), (99, None)]
    docs = []
    for d in range(150):
        text = list(rng.choice(words, int(rng.integers(0, 80))))
        item = items[int(rng.integers(40))][1].split()
        if rng.random() < 0.8:
            for p in rng.choice(len(item), int(rng.integers(0, 1 + len(item) // 5)), replace=False):
                item[p] = "other"
            at = int(rng.integers(0, len(text) + 1))
            text[at:at] = item
        docs.append((d, " ".join(text)))
    want = set()
    for d, text in docs:
        a = text.split()
        for i, item in items[:40]:
            b = item.split()
            for diagonal in range(-len(b), len(a)):
                lo, hi = max(0, diagonal), min(len(a), diagonal + len(b))
                agree = np.array([a[p] == b[p - diagonal] for p in range(lo, hi)], bool)
                for first, size, n in spaced_seeds.all_overlaps(agree, min(spaced_seeds.OVERLAP, len(b))):
                    want.add((d, i, lo + first, size, n))
    got = spaced_seeds.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 80
