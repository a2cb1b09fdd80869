"""Host verdicts against their SQL, license spans against an alignment of all words."""

import duckdb
import numpy as np
import pytest

from fieldwise.llm import diagonals, host_reputation, queries
from fieldwise.llm.shrink import overall_rate


def pages_and_labels(seed, bad_domains):
    """Hosts of some bad domains, ports, users, addresses, odd urls, labels that repeat or are NULL."""
    rng = np.random.default_rng(seed)
    hosts = [f"h{h}.d{d}.{s}" for s in ("com", "co.uk", "fr") for d in range(8) for h in range(3)]
    hosts += ["10.0.0.1", "10.0.0.2:80", "u@h1.d0.com:8080", "h2.d0.com.", "co.uk", "[::1]", "a.example.net", "X.org"]
    pages, labels = [], []
    for i in range(1500):
        host = hosts[rng.integers(len(hosts))]
        pages.append((i, f"http://{host}/{['en', 'fr', 'de'][i % 3]}/{i}{['', '.html', '?x=1', '#t'][i % 4]}"))
        if i % 3:
            rate = 0.9 if any(d in host for d in bad_domains) else 0.1
            labels.append((i, None if i % 50 == 0 else int(rng.random() > rate)))
    odd = [None, "", "no host/5", "x://?q", "http://.d0.com/1", "http://new.d0.com/", "http://d0.com/x/7/y"]
    return pages + [(2000 + i, u) for i, u in enumerate(odd)], labels + labels[:20]


@pytest.mark.parametrize("bad_domains", [(), (".d0.com", ".d3.co.uk", "10.0.0.1"), (".",)])
def test_verdicts_are_those_of_the_sql(spark, tmp_path, bad_domains):
    pages, labels = pages_and_labels(3, bad_domains)
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = queries.op4_host_reputation(spark, str(tmp_path))
    expected = con.execute(f"select {', '.join(got.columns)} from ({queries.ORACLES['op4_host_reputation']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(expected) and len(expected) == len(pages)
    blocked = {r[1] for r in expected if r[3] is None and r[4] == "block"}
    if bad_domains == (".d0.com", ".d3.co.uk", "10.0.0.1"):
        assert {"h0.d0.com", "h0.d3.co.uk", "u@h1.d0.com:8080", "new.d0.com", "10.0.0.1"} <= blocked
        assert all(any(d in h + "." for d in (".d0.com", ".d3.co.uk", "10.0.0.1", "d0.com")) for h in blocked)
    else:
        assert not blocked  # hosts like all others are not blocked, however many are bad


def test_the_limit_follows_the_rate_of_all_outcomes(spark):
    none = spark.createDataFrame([], "n long, k long")
    assert overall_rate(none) == 0.5
    for rate in (0.0, 0.15, 0.5, 0.9, 1.0):
        limit = host_reputation.limit_for(rate)
        assert rate <= limit <= 1
        if 0 < rate < 1:
            assert limit / (1 - limit) == pytest.approx(host_reputation.LIFT * rate / (1 - rate))


def chain(text, template):
    """Most pairs of words of the template met in order, and that within a span of nearly its length."""
    w, t = text.split(), template.split()
    best = 0
    for low in range(-len(t), len(w) + 1):  # diagonals low to low + DRIFT
        score = np.zeros((len(w) + 1, len(t) + 1), int)
        for i in range(len(w)):
            for j in range(len(t)):
                score[i + 1, j + 1] = max(score[i, j + 1], score[i + 1, j])
                if w[i : i + 2] == t[j : j + 2] and j < len(t) - 1 and low <= i - j <= low + diagonals.DRIFT:
                    score[i + 1, j + 1] = max(score[i + 1, j + 1], score[i, j] + 1)
        best = max(best, score[-1, -1])
    return best / (len(t) - 1)


def test_spans_are_aligned_in_order(spark):
    rng = np.random.default_rng(8)
    template = "one two three one four two three five six one two seven"
    words = template.split()
    texts = [template, " ".join(words[::-1]), "five six one two seven one two three one four two three", "one two " * 20]
    for _ in range(60):
        w = list(words)
        for _ in range(rng.integers(0, 5)):
            at = rng.integers(len(w))
            kind = rng.integers(4)
            if kind == 0:
                w.pop(at)
            elif kind == 1:
                w.insert(at, "other")
            elif kind == 2:
                w.insert(at, words[rng.integers(len(words))])
            else:
                k = rng.integers(len(w))
                w[at], w[k] = w[k], w[at]
        texts.append(" ".join(["x"] * rng.integers(3) + w + words[: rng.integers(4)]))
    source = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in diagonals.scan(source, {}, {template: "t"}).collect()}
    for i, text in enumerate(texts):
        share = chain(text, template)
        found = share >= diagonals.SHARE
        assert (got[i].labels == "t") == found, text
        assert got[i].score == pytest.approx(share if found else 0), text
    assert 10 < sum(bool(r.labels) for r in got.values()) < len(texts)
    for r in diagonals.spans(source, {}, {template: "t"}).filter("label is not null").collect():
        assert 0 <= r.first <= r.last < len(texts[r.doc_id].split())
        assert r.last - r.first < len(words) + diagonals.DRIFT


def test_whole_notices_and_places_side_by_side(spark):
    notices = list(diagonals.TEMPLATES.items())
    rows = [(i, f"Some text. {t.capitalize()}; and more") for i, (t, _) in enumerate(notices)]
    rows.append((1000, " ".join(["dedicated to the public domain"] * 3)))
    source = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in diagonals.scan(source).collect()}
    for i, (_, label) in enumerate(notices):
        assert label in got[i].labels.split(",") and got[i].score == 1
    found = diagonals.spans(source.filter("doc_id = 1000"), {}, {"dedicated to the public domain": "pd"})
    assert sorted((r.first, r.last) for r in found.filter("share = 1").collect()) == [(0, 4), (5, 9), (10, 14)]
