"""Corpus operators against brute force, exact round trips and held-out labels."""

import hashlib
import itertools
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as vocab
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldwise.llm import chunk_prints, diagonals, host_reputation, order_minhash, output_codes, queries
from fieldwise.llm import sharding, site_quality, spaced_seeds, sql_bpe, token_files, units
from fieldwise.llm.words import batch_words, word_hash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, q_site string, bucket int, node string"
WORDS = [f"w{a}{b}" for a in "bcdfghjklm" for b in "nopqrstuvw"]


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


def odd_rows():
    """NULLs in every column, empty and long texts, ties, repeated rows and ids, clashing names."""
    long = prose(1, 30_000)
    texts = [
        (1, None, None, None), (2, "", "en", "a"), (None, "Some text, here.", "en", "a"), (None, None, "fr", None),
        (3, long, "en", "a"), (4, long + " one more", "en", "b"), (5, "x", "en", "a"), (5, "x", "en", "a"),
        (5, "another text under one id", "fr", "b"), (6, "!!! ... \n\n  \t", "fr", "b"),
        (7, "日本語 🎉 ñandú É½ ² x\x1cy\xa0z", "fr", "a"), (8, "CC BY, cc  by! All rights\nreserved", "en", None),
        (9, "a" * 5000, "en", "a"), (-3, "it's  we'll\r\n\r\n 12 345", "en", "a"),
    ]
    return [(i, t, lang, src, None, "clash", 7, "clash") for i, t, lang, src in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def test_words_are_those_of_the_pattern():
    texts = ["The cat's É9, on\x00 a mat", None, "", "!!!", "a", "zb cat", "x" * 3000 + " y"]
    got = batch_words(pa.array(texts, pa.string()))
    for d, text in enumerate(texts):
        expected = words_of(text)
        assert got.of(d).tolist() == (word_hash(expected).tolist() if expected else [])


# 1 sharding
def test_shards_sizes_slots_and_growth(spark, docs, odd):
    tree = sharding.even_tree(24)
    for source in (docs, odd):
        got = sharding.place(source, tree, sharding.grown(tree, 24)).collect()
        texts = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in source.collect())
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == texts
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
            assert r.grown_shard in (r.shard, 24) and r.law == "key"
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})


def test_shards_follow_weights_and_movement_stays_in_the_subtree(spark):
    def leaf(s, w=1.0):
        return sharding.Node(f"s{s}", s, w)

    def tree(w):
        left = sharding.Node("r0", children=(sharding.Node("k0", children=(leaf(0), leaf(1, w))), sharding.Node("k1", children=(leaf(2),))))
        return sharding.Node("root", children=(left, sharding.Node("r1", children=(leaf(3), leaf(4, 2.0)))))

    ids = spark.range(20_000)
    moved = ids.select(sharding.shard_of(F.col("id"), tree(1.0)).alias("a"), sharding.shard_of(F.col("id"), tree(3.0)).alias("b"))
    pairs = {(r.a, r.b): r["count"] for r in moved.groupBy("a", "b").count().collect()}
    share = Counter()
    for (_, b), n in pairs.items():
        share[b] += n / 20_000
    assert all(abs(share[s] - w / 8) < 0.015 for s, w in {0: 1, 1: 3, 2: 1, 3: 1, 4: 2}.items())
    # rows come into the heavier region from outside it, never the other way
    assert not any(a in (0, 1, 2) and b in (3, 4) for a, b in pairs)
    assert not any({a, b} == {3, 4} for a, b in pairs)


# 2 near-duplicates
def brute_likeness(a, b):
    def labelled(text):
        w = words_of(text)
        seen, out = Counter(), []
        for i in range(max(1, len(w) - 4) if w else 0):
            s = tuple(w[i : i + 5])
            out.append((s, seen[s]))
            seen[s] += 1
        return out

    x, y = labelled(a), labelled(b)
    if not x or not y or min(len(x), len(y)) < 0.5 * max(len(x), len(y)):
        return 0.0
    number = {s: k for k, s in enumerate(dict.fromkeys(x + y))}
    x, y = (np.array([number[s] for s in z]) for z in (x, y))
    row = np.zeros(len(y) + 1, int)
    for s in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], (row[:-1] + 1) * (y == s)))
    return row[-1] / (len(x) + len(y) - row[-1])


def shingles(text):
    return order_minhash.labelled_shingles(batch_words(pa.array([text])).hashes)


def test_alignment_is_the_common_subsequence():
    rng = np.random.default_rng(3)
    for seed in range(60):
        w = prose(seed, int(rng.integers(1, 120))).split()
        v = [x for x in w if rng.random() > 0.02]
        if seed % 3 == 0:
            v = v[len(v) // 4 :] + v[: len(v) // 4]
        if seed % 5 == 0:
            v = v + v[:10] + v[:10]
        expected = brute_likeness(" ".join(w), " ".join(v))
        got = order_minhash.alignment(shingles(" ".join(w)), shingles(" ".join(v)))
        assert got == pytest.approx(expected) or (expected < 0.8 and got < 0.8)


def brute_classes(texts):
    """Rows with the smallest id of their class (equal texts, and links between different
    ones), and the number of classes."""
    own = {}
    for i, t in texts:
        own[t or ""] = min(own.get(t or "", (True, None)), (i is None, i))
    root = {t: t for t in own}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    sets = {t: {tuple(words_of(t)[i : i + 5]) for i in range(max(1, len(words_of(t)) - 4))} for t in own}
    for a, b in itertools.combinations(own, 2):
        if len(sets[a] & sets[b]) >= 0.6 * max(len(sets[a]), len(sets[b])) and brute_likeness(a, b) >= 0.8:
            root[find(a)] = find(b)
    least = {}
    for t, i in own.items():
        least[find(t)] = min(least.get(find(t), (True, None)), i)
    return Counter((i, least[find(t or "")][1]) for i, t in texts), len(least)


def test_near_duplicates_are_those_of_all_pairs(spark, docs, odd):
    base = prose(77, 120).split()
    made = [(9000, " ".join(base))]
    for k in range(1, 40):  # a chain of copies that drift from each other, and a group around a text
        base[(k * 7) % 113] = f"edit{k}"
        made.append((9000 + k, " ".join(base)))
    center = prose(78, 120).split()
    for k in range(40):
        copy = center[:]
        copy[(k * 37) % 120] = copy[(k * 53) % 120] = f"other{k}"
        made.append((9100 + k, " ".join(copy)))
    made += [(9200, "one two three"), (9201, "One, two three!"), (9202, "one two")]
    more = spark.createDataFrame(made + made[:3], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    for source in (both, odd.filter("length(text) < 1000 or text is null")):
        got = order_minhash.near_duplicates(source).collect()
        expected, n_classes = brute_classes([(r.doc_id, r.text) for r in source.select("doc_id", "text").collect()])
        assert Counter((r.doc_id, r.class_id) for r in got) == expected
        assert sum(r.kept for r in got) == n_classes


def test_short_near_duplicates_are_never_lost(spark):
    rng = np.random.default_rng(9)
    linked = 0
    for _ in range(4000):
        n = int(rng.integers(1, 25))
        a = rng.integers(1, 1 << 62, n).astype(np.uint64)
        b = a[rng.random(n) > 0.1]
        for _ in range(int(rng.integers(0, 1 + n // 6))):
            b = np.insert(b, rng.integers(0, len(b) + 1), rng.integers(1, 1 << 62, dtype=np.uint64))
        if 0 < len(b) and order_minhash.alignment(a, b) >= 0.8:
            linked += 1
            assert set(order_minhash.candidate_keys(a).tolist()) & set(order_minhash.candidate_keys(b).tolist())
    assert linked > 1000
    rows = []
    for k in range(800):
        text = prose(1000 + k, 8)
        rows += [(2 * k, text), (2 * k + 1, text + " more")]
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id) for r in got} == {(i, i - i % 2) for i, _ in rows}


def test_shared_counts_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, int(rng.integers(1, 90)))).astype(np.uint64) for _ in range(30)]
    counts = order_minhash.shared_counts(sets, columns=64)
    assert all(i == j or counts[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30))
    # copies of one text that differ too much from each other, but for three pairs
    rows = []
    for k in range(40):
        w = prose(50, 100).split()
        for i in range(6):
            w[(17 * i + 5 * k) % 100] = f"own{k}x{i}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, rows[k][1] + " more") for k in range(3)]
    monkeypatch.setattr(order_minhash, "BLOCK", 8)
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == brute_classes(rows)[0]


def test_keep_one_keeps_whole_rows(odd):
    kept = order_minhash.keep_one(odd)
    assert kept.columns == odd.columns
    got = Counter(r.doc_id for r in kept.collect())
    # 1, 2 and a nameless row are empty; 6 has no word but text; 4 is a near copy of 3
    assert got == Counter({1: 1, None: 1, 3: 1, 5: 2, 6: 1, 7: 1, 8: 1, 9: 1, -3: 1})


# 3 token files
def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 500):
        counts = np.zeros(600, np.int64)
        counts[rng.choice(600, n, replace=False)] = rng.zipf(1.3, n)
        lengths = token_files.code_lengths(counts)
        used = lengths[counts > 0].astype(float)
        assert (lengths[counts == 0] == 0).all() and used.max() <= 18
        assert (2.0**-used).sum() == 1 or n == 1
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    assert token_files.code_lengths(np.array(fib)).max() <= 18
    assert token_files.code_lengths(np.array([5, 1, 1, 2])).tolist() == [1, 3, 3, 2]


def test_bits_round_trip():
    rng = np.random.default_rng(6)
    per_doc = np.array([1, 700, 0, 128, 129, 3])
    ids = np.minimum(rng.zipf(1.2, per_doc.sum()), 50_000).astype("<u2")
    counts = np.bincount(ids, minlength=65_536)
    lengths = token_files.code_lengths(counts)
    bits, marks = token_files.pack(ids, per_doc, token_files.canonical_codes(lengths), lengths)
    begins = 8 * np.concatenate([[0], np.cumsum([len(b) for b in bits])[:-1]])
    flat = np.concatenate([m + b for m, b in zip(marks, begins)]).astype("<u4")
    payload = b"".join([
        np.array([len(bits), len(flat)], "<u4").tobytes(), np.arange(6, dtype="<i8").tobytes(), bytes(6),
        per_doc.astype("<u4").tobytes(), flat.tobytes(), *bits, bytes(16),
    ])
    doc_ids, nulls, sizes, out = token_files.unpack(payload, token_files.decoding_table(lengths))
    assert sizes.tolist() == per_doc.tolist() and out.tolist() == ids.tolist()


def test_token_files_give_back_the_ids(spark, docs, odd):
    from tokenizers import Tokenizer

    path = vocab.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    for source in (docs, odd):
        got = token_files.token_digests(source, path).orderBy("start").collect()
        expected = []
        for r in source.collect():
            ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            expected.append(((r.doc_id is not None, r.doc_id), len(ids), zlib.crc32(ids.tobytes())))
        assert Counter(((r.doc_id is not None, r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == Counter(expected)
        order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
        assert order == sorted(order)
        assert [r.start for r in got] == (np.cumsum([r.n_tokens for r in got]) - [r.n_tokens for r in got]).tolist()


def test_added_tokens_are_the_librarys(spark, tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(vocab.path("byte_bpe_50k.json")) as f:
        kind = json.load(f)
    flags = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False}
    kind["added_tokens"] += [{"id": 50_257, "content": "we go", **flags}, {"id": 50_258, "content": " sun", **flags}]
    (tmp_path / "more.json").write_text(json.dumps(kind))
    texts = [
        "a<|endoftext|>b", "a <|endoftext|> b", "<|endoftext|>", "plain words", "<|endoftext|><|endoftext|> plain words",
        "<|endoftext", "日本<|endoftext|>語", "then we", " go", "here we go on", " sun", "the sun and sunny days", None,
    ]
    source = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for path in (vocab.path("byte_bpe_50k.json"), str(tmp_path / "more.json")):
        tok = Tokenizer.from_file(path)
        coded = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]
        got = token_files.token_digests(source, path).orderBy("doc_id").collect()
        assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(ids), zlib.crc32(ids.tobytes())) for ids in coded]


def test_latin_pieces_are_those_of_the_pattern():
    import regex

    from fieldwise.llm.units import latin_pieces

    full, rng = regex.compile(vocab.PATTERN).findall, np.random.default_rng(9)
    latin = [*" \t\n\r'stmdrevlSZ19.!é\u024fÀ", "'s", "'ll", "'re", "'ve", " '", "  ", "\n ", " x", "|stop|"]
    other = [*"×÷\u0250ß½日\x0b\x1f\xa0", "|stop|"]
    for _ in range(1500):
        texts = ["".join(rng.choice(latin, rng.integers(0, 14))) for _ in range(rng.integers(1, 12))]
        texts += ["".join(rng.choice(latin + other, rng.integers(0, 9)))]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
        ends = [*latin_pieces(data, at, [b"|stop|"]).tolist(), len(data)]
        got = [data[a:b].tobytes().decode() for a, b in itertools.pairwise(ends)]
        expected = []
        for t in texts:
            whole = "|stop|" in t or re.search("[^\t\n\r -~À-ÖØ-öø-\u024f]", t)
            expected += ([t] if t else []) if whole else full(t)
        assert got == expected


def test_token_files_look_a_piece_up_once_for_all_its_places():
    class Counting(dict):
        asked = 0

        def get(self, *args):
            Counting.asked += 1
            return super().get(*args)

    path = vocab.path("byte_bpe_50k.json")
    encoder = token_files.Encoder(path, "<u2")
    encoder.codes.known = Counting()
    texts = [prose(1, 2000), None, "", prose(2, 2000), "日本 w w", "it's \u0120w1b \u0120"]
    coded = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = encoder.encode(pa.array(texts)).to_pylist()
    assert [np.frombuffer(ids, "<u2").tolist() for ids in got] == coded
    # 4,000 words of 100 different ones; a text that does not begin with a space has a first word of its own
    assert Counting.asked <= len(WORDS) + 2 + 1 + 6  # it, 's, \u0120w, 1, b, \u0120


# 4 URL filter
def test_hosts_paths_and_rules(spark):
    urls = [
        "http://A.Example.NET/en/x?q", "http://example.net", "https://b.example.com/de/1#t", "http://x.org/fr/",
        "ftp://net/", "http://notnet/x", "no host", None, "", "http://ÀB.net:80/a?b://c/d", "x://?q", "a\n://h.net/p\nq",
        "http://example.org?x=/fr/",
    ]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    none = spark.createDataFrame([], "url string, bad int")
    for r in host_reputation.judge(pages, none, queries.RULES).collect():
        url = urls[r.page_id] or ""
        host = path = ""
        if "://" in url:
            rest = url.split("://", 1)[1]
            m = re.match(r"(?s)([^/?#]*)([^?#]*)", rest)
            host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
        fits = [
            (len(h + p), h + p, v) for v, h, p in queries.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        rule, verdict = (max(fits)[1:]) if fits else (None, "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_bad_hosts_are_blocked_and_sparse_ones_lean_on_their_domain(spark):
    pages, outcomes = [], []
    for d in range(20):
        bad_domain = d == 0
        for h in range(5):
            url = f"http://h{h}.d{d}.com/x"
            pages.append((len(pages), url))
            for k in range(0 if h == 4 else 40):
                outcomes.append((url, int(k % 10 != 0 if bad_domain else k % 10 == 0)))
    pages += [(900, "http://new.d0.com/"), (901, "http://new.d3.com/"), (902, "http://other.org/"), (903, None)]
    outcomes += [("http://h0.d1.com/x", None)] * 5
    got = host_reputation.judge(
        spark.createDataFrame(pages, "page_id long, url string"),
        spark.createDataFrame(outcomes, "url string, bad int"), [],
    )
    blocked = {r.host for r in got.collect() if r.verdict == "block"}
    assert {f"h{h}.d0.com" for h in range(4)} <= blocked and not {h for h in blocked if ".d0." not in h}
    assert "h4.d0.com" in blocked and "new.d0.com" in blocked  # unseen hosts of a bad domain


def test_ports_users_and_addresses_are_no_suffixes(spark):
    outcomes = [(f"http://h{i}.bad.com:8080/x", 1) for i in range(6) for _ in range(30)]
    outcomes += [(f"http://10.0.0.{i}/", 1) for i in range(6) for _ in range(30)]
    outcomes += [(f"http://ok{i}.org/", 0) for i in range(40) for _ in range(30)]
    outcomes += [(f"http://s{i}.fine.co.uk/", 0) for i in range(6) for _ in range(30)]
    outcomes += [(f"http://s{i}.foul.co.uk/", 1) for i in range(6) for _ in range(30)]
    urls = {
        "http://new.bad.com/": True, "http://u:p@h1.bad.com:1/": True, "http://h1.bad.com./": True,
        "http://10.0.0.1:99/": True, "http://shop.other.org:8080/": False, "http://99.99.0.1/": False,
        "http://[::1]:8080/": False, "http://new.fine.co.uk": False, "http://new.foul.co.uk": True,
    }
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = host_reputation.judge(pages, spark.createDataFrame(outcomes, "url string, bad int"), []).collect()
    for r in got:
        url = list(urls)[r.page_id]
        assert (r.verdict == "block") == urls[url], url
        assert r.host == re.match("http://([^/]*)", url)[1]


def test_posteriors_against_plain_arithmetic(spark):
    from fieldwise.llm.shrink import RHO, posteriors

    rng = np.random.default_rng(2)
    rows = [
        (f"s{d % 3}", f"d{d}", f"h{h}.d{d}", int(n), int(rng.binomial(n, 0.1 + 0.05 * (d % 7))))
        for d in range(20) for h in range(4) for n in [rng.integers(0, 30)]
    ]
    levels = ["suffix", "domain", "host"]
    got = {r.host: (r.a, r.b) for r in posteriors(
        spark.createDataFrame(rows, "suffix string, domain string, host string, n long, k long"), levels
    ).collect()}
    all_n, all_k = sum(r[3] for r in rows), sum(r[4] for r in rows)
    parent = {(): (all_k + 0.5) / (all_n + 1)}
    for i in range(1, 4):
        sums = {}
        for r in rows:
            n, k = sums.get(r[:i], (0, 0))
            sums[r[:i]] = n + r[3], k + r[4]
        spread = {c: parent[c[:-1]] * (1 - parent[c[:-1]]) for c in sums}
        seen = [c for c in sums if sums[c][0]]
        s = sum(sums[c][0] * (sums[c][1] / sums[c][0] - parent[c[:-1]]) ** 2 for c in seen)
        more = sum(spread[c] * (sums[c][0] - 1) for c in seen)
        rho = min(max((s - sum(spread[c] for c in seen)) / more, RHO[0]), RHO[1])
        m = 1 / rho - 1
        ab = {c: (m * parent[c[:-1]] + k, m * (1 - parent[c[:-1]]) + n - k) for c, (n, k) in sums.items()}
        parent = {c: a / (a + b) for c, (a, b) in ab.items()}
    assert len(got) == len(ab)
    for c, want in ab.items():
        assert got[c[-1]] == pytest.approx(want)


# 5 language
def test_bits_are_weighted_by_rows_left_out_and_twins_are_ambiguous(spark):
    rng = np.random.default_rng(3)
    same, other = (["".join(rng.choice(list(s), 4)) for _ in range(40)] for s in ("abcdefgh", "opqrstuv"))
    rows = [
        (i, " ".join(rng.choice(other if i % 3 == 2 else same, 30)), "abc"[i % 3]) for i in range(600)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = output_codes.fit(docs)
    assert model.languages == ["a", "b", "c"]
    alone = {tuple(model.code[:, b]): model.trust[b] for b in range(model.code.shape[1])}
    assert alone[1, 1, -1] > 2 * max(alone[1, -1, 1], alone[1, -1, -1])  # only c can be told
    assert [p[2] for p in model.predict([rows[2][1]])] == [False]
    assert sum(p[2] for p in model.predict([t for _, t, k in rows if k != "c"])) > 100
    # decoding, spelled out
    texts = [t for _, t, _ in rows[:20]]
    inside = np.clip(model.margins(texts), -model.sure, model.sure)
    for m, (lang, score, _) in zip(inside, model.predict(texts)):
        loss = [
            sum(t * math.log1p(math.exp(-c * x)) for c, x, t in zip(word, m, model.trust)) for word in model.code
        ]
        assert lang == model.languages[int(np.argmin(loss))]
        assert score == pytest.approx(1 / sum(math.exp(min(loss) - x) for x in loss))


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(output_codes, "MAX_LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "text", f"l{i}") for i in range(3)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 2"):
        output_codes.fit(docs)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = output_codes.identify(docs, docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark, docs, odd):
    got = {(r.doc_id, r.lang_pred) for r in output_codes.identify(odd, docs).collect()}
    assert {(1, "und"), (2, "und"), (6, "und")} <= got and (3, "und") not in got
    none = output_codes.identify(odd, odd.filter("false")).collect()
    assert {r.lang_pred for r in none} == {"und"} and len(none) == odd.count()
    one = odd.withColumn("lang", F.lit("en"))
    assert {r.lang_pred for r in output_codes.identify(odd, one).collect()} == {"en", "und"}
    assert output_codes.keep_known(odd, docs).columns == odd.columns
    code = output_codes.codewords(8)
    assert len({tuple(c) for c in code}) == 8 and code.shape == (8, output_codes.LONG_CODE)


def test_seven_languages(spark):
    for n in (7, 8, 20, 100):
        code = output_codes.codewords(n)
        assert code.shape == (n, output_codes.LONG_CODE) and len(np.unique(code, axis=0)) == n
        assert (code.min(axis=0) == -1).all() and (code.max(axis=0) == 1).all()
    rng = np.random.default_rng(8)
    rows = []
    for k in range(7):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrst"[2 * k : 2 * k + 8]), 4)) for _ in range(30)]
        rows += [(40 * k + i, " ".join(rng.choice(words, 30)), f"l{k}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = output_codes.identify(docs, docs).filter("held_out").collect()
    truth = {i: lang for i, _, lang in rows}
    assert {r.lang_pred for r in got} == set(truth.values()) and all(np.isfinite(r.score) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) / len(got) > 0.95


# 6 decontamination
def test_planted_passages_are_found(spark, benchmark):
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    rng = np.random.default_rng(8)
    made, truth = [], set()
    for k, (item, text) in enumerate(items):
        w = words_of(text)
        if len(w) < 20:
            continue
        for i in rng.choice(len(w), len(w) // 12, replace=False):
            w[i] = f"changed{k}"
        made.append((k, prose(100 + k, 60) + " " + re.sub("[a-z]", lambda m: m[0].upper(), " ".join(w)) + ". " + prose(200 + k, 60)))
        truth.add((k, item))
        made.append((1000 + k, prose(300 + k, 200) + " " + " ".join(words_of(text)[:7])))
    made += [(5000, None), (5001, ""), (None, items[0][1]), (5002, items[1][1]), (5002, items[1][1])]
    source = spark.createDataFrame(made, "doc_id long, text string")
    got = spaced_seeds.contaminated(source, benchmark).collect()
    assert truth <= {(r.doc_id, r.item_id) for r in got}
    assert {r.doc_id for r in got} <= {k for k, _ in truth} | {None, 5002}
    assert {None, 5002} <= {r.doc_id for r in got}
    assert all(r.agreeing >= 0.8 * r.n_words - 1e-9 for r in got)
    kept = spaced_seeds.keep_clean(source, benchmark).collect()
    assert Counter(r.doc_id for r in kept) == Counter(i for i, _ in made if i in (5000, 5001) or i is not None and 1000 <= i < 5000)


def test_best_overlap_against_all_stretches():
    rng = np.random.default_rng(9)
    for _ in range(200):
        agree = rng.random(int(rng.integers(1, 40))) < 0.75
        best = 0
        for i, j in itertools.combinations(range(len(agree) + 1), 2):
            if agree[i] and agree[j - 1] and agree[i:j].sum() >= 0.8 * (j - i) - 1e-9:
                best = max(best, j - i)
        first, size, hits = spaced_seeds.best_overlap(agree)
        assert size == best and hits == agree[first : first + size].sum()


def test_two_overlaps_on_one_diagonal():
    item = np.arange(60)
    words = np.where((item >= 20) & (item < 40), -1 - item, item)
    kinds = [("doc_id", pa.int64()), ("node", pa.binary()), ("diagonal", pa.int32()), ("begin", pa.int32()),
             ("item_id", pa.int64()), ("words", pa.list_(pa.int64())), ("item_words", pa.list_(pa.int64()))]
    row = (1, b"x", 0, 0, 2, words.tolist(), item.tolist())
    batch = pa.RecordBatch.from_arrays([pa.array([v], k) for v, (_, k) in zip(row, kinds)], [n for n, _ in kinds])
    (got,) = spaced_seeds._verify(iter([batch]))
    assert [(r["first_word"], r["n_words"], r["agreeing"]) for r in got.to_pylist()] == [(0, 20, 20), (40, 20, 20)]


# 7 fingerprints
def test_prints_against_a_walk_in_order(spark, docs, odd):
    for source in (docs, odd):
        rows = sorted(
            [(r.doc_id, r.text or "") for r in source.select("doc_id", "text").collect()],
            key=lambda r: (r[0] is not None, r[0] or 0, r[1]),
        )
        expected = Counter()
        for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
            changed = chunk_prints.edited(text, following)
            own, other, after = (chunk_prints.weights(t.encode()) for t in (text, changed, following))
            expected[
                i, len(text), hashlib.sha256(changed.encode()).hexdigest(), chunk_prints.fingerprint(own),
                chunk_prints.fingerprint(other), chunk_prints.containment(own, other), chunk_prints.containment(own, after),
            ] += 1
        assert Counter(tuple(r) for r in chunk_prints.prints(source).collect()) == expected


def test_chunks_cover_the_text_and_survive_shifts():
    raw = prose(11, 4000).encode()
    ends = chunk_prints.chunk_ends(chunk_prints.gear_hashes(np.frombuffer(raw, np.uint8)))
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(raw) and sizes[:-1].min() >= chunk_prints.LEAST and sizes.max() <= chunk_prints.MOST
    assert 40 < sizes.mean() < 80
    one, two = chunk_prints.weights(raw), chunk_prints.weights(b"some words before " + raw)
    assert chunk_prints.containment(one, two) > 0.97
    # the hash at a byte is that of the SIGHT bytes up to it
    h = chunk_prints.gear_hashes(np.frombuffer(raw, np.uint8))
    tail = chunk_prints.gear_hashes(np.frombuffer(raw[1000:], np.uint8))
    assert (h[1000 + 32 :] == tail[32:]).all()


# 8 quality
def test_quality_separates_the_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, test = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    scored = site_quality.score(docs, site_quality.fit(docs, train)).join(test, "doc_id").collect()
    right = [(r.q_score >= 0.5) == (r.quality == 1) for r in scored]
    assert sum(right) / len(right) > 0.97


def test_quality_bins_and_edge_cases(spark, odd):
    text = "AB! 12\nx y" + "é"
    (bins,) = site_quality.text_bins(pa.array([text, None])).to_pylist()[:1]
    n = len(text.encode())
    symbols, capitals = (40 // n).bit_length(), (80 // n).bit_length()
    assert bins == [(symbols * 7 + capitals) * 6, (80 // n).bit_length(), n // 4, n.bit_length(), (100 // n).bit_length()]
    repeats = site_quality.text_bins(pa.array(["a", "a a", "b B b, b", "", "b a"])).to_pylist()
    assert [b[0] % 6 for b in repeats] == [0, 4, 4, 0, 0]
    assert site_quality.text_bins(pa.array([None, ""], pa.string())).to_pylist() == [[0] * 5] * 2
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Counter(map(tuple, site_quality.keep_good(odd, none).collect())) == Counter(map(tuple, odd_rows()))
    some = spark.createDataFrame([(3, 1), (4, 0), (4, 0), (5, None), (None, 1)], "doc_id long, quality int")
    assert site_quality.keep_good(odd, some).columns == odd.columns


def test_sparse_paths_lean_on_their_site(spark):
    from fieldwise.llm.shrink import posteriors

    rows = [("a", f"p{i}", 50, 45 if i < 8 else 10) for i in range(10)] + [("a", "few", 1, 0), ("a", "no", 0, 0)]
    rows += [("b", f"p{i}", 50, 5) for i in range(10)] + [("b", "no", 0, 0)]
    got = {(r.s, r.p): r.a / (r.a + r.b) for r in posteriors(spark.createDataFrame(rows, "s string, p string, n long, k long"), ["s", "p"]).collect()}
    assert got["a", "no"] > got["b", "no"] + 0.3
    assert abs(got["a", "p0"] - 0.9) < 0.03 and got["a", "no"] > got["a", "few"] > got["b", "no"]


# 9 license scan
def test_base_places_against_a_scan(docs, odd, spark):
    planted = prose(1, 30) + " This work is licensed under the GNU General Public License, version 3. Cc-by cc by by"
    more = spark.createDataFrame([(8001, planted), (8002, "licensed under cc by nc 4.0 all rights reserved all rights")], "doc_id long, text string")
    source = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(more)
    expected = Counter()
    for r in source.collect():
        w = words_of(r.text)
        places, labels = [], set()
        for phrase, label in diagonals.BASE.items():
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        expected[r.doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))] += 1
    got = diagonals.scan(source).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == expected
    for r in got:
        names = r.labels.split(",") if r.labels else []
        assert names == sorted(set(names)) and set(filter(None, r.base_labels.split(","))) <= set(names)
        assert 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert "gpl-notice" in by[8001].labels and "cc-by-nc" in by[8002].labels


def test_changed_wording_is_found_on_neighbouring_diagonals(spark):
    text = "x y permission is hereby given granted free of charge to any one person obtaining a copy of this software z"
    source = spark.createDataFrame([(1, text), (2, "free of charge to any")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in diagonals.scan(source).collect()}
    assert got == {1: "mit", 2: ""}


def test_a_place_of_a_template_votes_once(spark):
    long = " ".join(f"w{i}" for i in range(150))
    texts = ["to the to the to the", long, " ".join(f"w{i}" for i in range(100)), long.replace("w70 ", "")]
    source = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in diagonals.scan(source).collect()}
    assert got[0][0] == "" and got[0][1] == 0
    spelled = diagonals.scan(source, {}, {long: "long"}).collect()
    assert {r.doc_id: r.labels for r in spelled} == {0: "", 1: "long", 2: "", 3: "long"}
    assert {r.doc_id: r.score for r in spelled if r.labels} == {1: 1.0, 3: pytest.approx(147 / 149)}


# 10 BPE
def test_bpe_is_that_of_the_library(docs, odd):
    import tiktoken

    path = vocab.path("byte_bpe_50k.tiktoken")
    ranks = sql_bpe.merges(path, vocab.PATTERN).ranks
    lib = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for source in (docs, odd):
        expected = Counter()
        for r in source.collect():
            ids = np.array(lib.encode_ordinary(r.text or ""), "<u4").tobytes()
            expected[r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
        assert Counter(map(tuple, sql_bpe.encode_decode(source, path, vocab.PATTERN).collect())) == expected


def test_bpe_of_long_pieces_and_the_memory():
    import tiktoken

    bpe = sql_bpe.Merges(vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    bpe.codes.most = 3
    texts = ["a" * 3000, "ab" * 700 + "é" * 300, "".join(chr(97 + i * i % 26) for i in range(2000)), "one two", "one three four"]
    for text in texts * 2:
        ((ids, plain),) = bpe.encode([text])
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(text) and plain == text.encode()
        assert bpe.decode([ids]) == [text.encode()]
    with pytest.raises(ValueError):
        bpe.decode([np.array([50_256], "<u4").tobytes()])


def test_remembered_pieces_are_bounded_by_bytes():
    often = []

    def encode(pieces):
        often.extend(p for p in pieces if p == "often")
        return [code(p) for p in pieces]

    def code(piece):
        return 4 * piece.encode(), piece.encode()

    codes = units.Codes(str.split, encode)
    tracemalloc.start()
    for lot in range(0, 100_000, 1_000):
        texts = [f"often {'𐀀' * 54}{i:06d}" for i in range(lot, lot + 1_000)]
        assert codes.of(texts) == [[code(p) for p in t.split()] for t in texts]
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 100 << 20 and often == ["often"]
    again = "𐀀" * 54 + "000000"
    assert codes.of([again]) == [[code(again)]]


def test_bpe_of_pieces_and_lots_of_a_megabyte():
    import tiktoken

    bpe = sql_bpe.Merges(vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = np.random.default_rng(11)
    many = " ".join("".join(w) for w in rng.choice(list("abcdefghij"), (2_200, 250)))
    for text in ("".join(rng.choice(list("ACGT"), 1_000_000)), "a" * 4_000_000, many):
        ((ids, plain),) = bpe.encode([text])
        assert ids == np.array(lib.encode_ordinary(text), "<u4").tobytes() and plain == text.encode()


def test_bpe_windows_without_a_common_token(monkeypatch):
    import tiktoken

    monkeypatch.setattr(sql_bpe, "LONG", 16)
    monkeypatch.setattr(sql_bpe, "OVERLAP", 2)
    monkeypatch.setattr(sql_bpe, "LOT_TOKENS", 7)
    bpe = sql_bpe.Merges(vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = np.random.default_rng(12)
    parts = ["the", "tion", "inter", "nation", "a", "qu", "é"]
    for text in ("".join(rng.choice(parts, 150)), "".join(rng.choice(list("ab"), 400)), "abc" * 200, "a" * 301):
        ((ids, plain),) = bpe.encode([text])
        assert ids == np.array(lib.encode_ordinary(text), "<u4").tobytes() and plain == text.encode()


# all
@pytest.mark.parametrize("name", [n for n in queries.QUERIES])
def test_empty_tables(spark, name, tmp_path):
    for t in ("documents", "embeddings", "pages", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_pipeline_on_odd_documents(spark, odd, benchmark, tmp_path):
    planted = [(i, r.text, "en", "a", None, "clash", 7, "clash") for i, r in enumerate(benchmark.limit(2).collect(), 50)]
    odd.unionByName(spark.createDataFrame(planted, SCHEMA)).write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").filter("false").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = step(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns and docs.count() <= before, name
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_takes_out_junk_copies_and_passages(spark):
    table = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    out = {r.doc_id for r in corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect()}
    good = {r.doc_id for r in table("labels").filter("quality = 1").collect()}
    junk = {r.doc_id for r in table("labels").filter("quality = 0").collect()}
    assert len(junk & out) <= 0.05 * len(junk)
    texts = Counter(r.text for r in table("documents").collect() if r.doc_id in out)
    assert max(texts.values()) == 1
    leaks = {r.doc_id for r in spaced_seeds.contaminated(table("documents"), table("benchmark")).collect()}
    copies = {r.doc_id for r in order_minhash.near_duplicates(table("documents")).filter("not kept").collect()}
    assert not leaks & out
    assert len(good - leaks - copies - out) <= 0.02 * len(good)
