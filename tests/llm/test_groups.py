"""Joins, vectors, archives, urls, the classifier and the pipeline."""

from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from yieldspark.llm import embed_dedup, quality, setjoin, topk, url_filter, warc
from yieldspark.llm.components import connected_components

SF = "/root/testdata/sf0.001"


class Union(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def test_components(llm):
    random.seed(5)
    edges = [(i, i + 1) for i in range(60)] + [(random.randrange(100, 300), random.randrange(100, 300)) for _ in range(120)] + [(7, 7)]
    want = Union()
    for a, b in edges:
        want.join(a, b)
    got = {r.node: r.component for r in connected_components(llm.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: want.root(n) for e in edges for n in e if e[0] != e[1]}


def jaccard_brute(rows, n, percent):
    sets, union = {}, Union()
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                union.join(a, b)
    return {d: (len(s), union.root(d)) for d, s in sets.items()}


def test_jaccard_join_against_brute_force(llm):
    random.seed(2)
    words = [f"W{i}" for i in range(60)]
    base, rows = [[random.choice(words) for _ in range(random.randint(1, 120))] for _ in range(30)], []
    for i in range(400):
        b = list(random.choice(base))
        for _ in range(random.randint(0, max(1, len(b) // 25))):
            b[random.randrange(len(b))] = random.choice(words)
        rows.append((i, " ".join(b)))
    rows += [(9000, None), (9001, ""), (9002, " \n")]
    docs = llm.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_shingles long")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.jaccard_components(docs).collect()} == jaccard_brute(rows, 3, 90)


def test_jaccard_join_keeps_one_of_each(llm):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, "a"), (3, text, "b"), (8, text + " more", "c"), (9, "other words here now then", "d"), (None, text, "e"), (11, None, "f"), (3, text, "b")]
    docs = llm.createDataFrame(rows, "doc_id long, text string, source string")
    kept = setjoin.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["11", "3", "3", "9", "None"]
    assert setjoin.jaccard_components(docs.limit(0)).count() == 0


def vectors(llm, rows):
    return llm.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def near_rows(n=400, dim=16):
    rng = np.random.default_rng(3)
    out = []
    for i in range(n):
        if i % 3 and i > 3:
            v = np.array(out[rng.integers(len(out))][1]) + rng.standard_normal(dim) * rng.choice([0, 0.03, 0.06])
        else:
            v = rng.standard_normal(dim)
        out.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    return out


def test_near_duplicate_vectors(llm):
    rows = near_rows()
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, rows[0][1], None), (905, rows[0][1][:8], rows[0][2])]
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(vectors(llm, rows + odd)).collect()}
    x = np.array([r[1] for r in rows])
    norm, label = np.linalg.norm(x, axis=1), np.array([r[2] for r in rows])
    link = ((x @ x.T) / np.outer(norm, norm) >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    union = Union()
    for a, b in zip(*np.nonzero(link), strict=True):
        union.join(int(a), int(b))
    exact = sum(got[i].n_links == link[i].sum() and got[i].component_id == union.root(i) for i in range(len(rows)))
    assert exact >= 0.99 * len(rows) and all(got[i].n_links <= link[i].sum() for i in range(len(rows)))
    assert all(got[r[0]].n_links == 0 and got[r[0]].kept for r in odd)
    assert embed_dedup.near_duplicates(vectors(llm, rows).limit(0)).count() == 0


def test_hot_filter_is_split_into_blocks(llm, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 7)
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    rows = [(i, [float(np.float32(x)) for x in base + rng.standard_normal(16) * 0.01], 0) for i in range(60)]
    got = embed_dedup.near_duplicates(vectors(llm, rows)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(59, 0)}


def ranked_by_score(rows, queries, k=5):
    """Brute force over ``(id, whole numbers)``."""
    out = {}
    for i, q in dict(queries).items():
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(q, v, strict=True)), j) for j, v in rows if j != i and len(v) == len(q))
        out[i] = [(j, -s) for s, j in scores[:k]]
    return {i: got for i, got in out.items() if got}


def found_by_query(frame):
    got: dict[int, list] = {}
    for r in frame.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_top_k(llm):
    rows = near_rows(700) + [(701, None, 1), (702, [float("inf")] * 16, 1), (703, [None] + [1.0] * 15, 1)]
    whole = np.floor(256 * np.array([r[1] for r in rows[:700]]))
    best = rows[1 + int(np.argmax((whole @ whole[0])[1:]))][1]
    rows += [(710, best, 1), (711, best, 1), (711, best, 1), (712, [2.0, 3.0], 1), (750, [1.0, 1.0], 1), (800, [], 1)]  # ties, repeats, other dimensions
    q = topk.quantized(vectors(llm, rows))
    want = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows if i < 700 or i > 703]
    for block in (150, 4096):
        got = found_by_query(topk.top_k(q, q.where("vec_id % 50 = 0"), block=block))
        assert got == {i: g for i, g in ranked_by_score([w for w in want if w[1]], [w for w in want if w[0] % 50 == 0 and w[1]]).items()}
    assert len({s for _, s in got[0][:4]}) == 1 and [i for i, _ in got[0]][1:4] == [710, 711, 711]
    clash = q.withColumn("block", F.lit(1)).withColumn("bar", F.lit(2.0)).withColumn("score", F.lit("x"))
    assert found_by_query(topk.top_k(clash, clash.where("vec_id % 50 = 0"))) == got


def test_top_k_of_large_numbers_is_exact_or_an_error(llm):
    big = [(i, [3e12 + i / 256, -2e12, 0.25 * i], 1) for i in range(12)]
    q = topk.quantized(vectors(llm, big))
    with pytest.raises(Exception, match="too large for a long"):
        topk.top_k(q, q.where("vec_id % 50 = 0")).collect()
    large = [(i, [1.1e6 + i / 256, -1e6 + i / 128, 0.25 * i], 1) for i in range(80)]
    q = topk.quantized(llm.createDataFrame(large, "vec_id long, embedding array<double>, label int"))
    want = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in large]
    assert found_by_query(topk.top_k(q, q.where("vec_id % 50 = 0"))) == ranked_by_score(want, [w for w in want if w[0] % 50 == 0])
    with pytest.raises(Exception, match="too large"):
        topk.quantized(llm.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>")).collect()


def test_bounds_decide_before_the_lists_are_read():
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.01/embeddings.parquet")
    x, ids = np.floor(256 * np.array(table["embedding"].to_pylist(), np.float64)).astype(np.int64), np.array(table["vec_id"])
    alone, barred = topk.Block(x, ids), topk.Block(x, ids)
    for i in np.flatnonzero(ids % 50 == 0):
        got = alone.search(x[i], int(ids[i]), 5)
        assert barred.search(x[i], int(ids[i]), 5, float(got[-1][1])) == got
    assert alone.cells_read < 0.75 * alone.cells and barred.cells_read < 0.55 * barred.cells


def test_top_k_of_empty_tables(llm):
    q = topk.quantized(vectors(llm, near_rows(20)))
    assert topk.top_k(q.limit(0), q).count() == 0


def test_archives(llm):
    long = "x" * 1200
    rows = [(1, "http://a/\r\nEvil: 1", long), (2, None, long), (3, "u", "é" * 600), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (7, "u", "é" * 600), (None, "u", long), (2, "u", long)]
    pages = llm.createDataFrame([(*r, "y") for r in rows], "page_id long, url string, html string, payload string")
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect())
    assert got == sorted([
        ("1", 1200, "revisit", 2), ("2", 1200, "response", None), ("2", 1200, "response", None), ("3", 1200, "revisit", 7), ("4", 0, "response", None),
        ("5", 5, "response", None), ("6", 5, "response", None), ("7", 1200, "response", None), ("None", 1200, "revisit", 2),
    ])
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_rejected_blocks_are_stepped_over(tmp_path):
    import io

    row = {"page_id": 1, "url": "u", "refers_to": None, "payload_bytes": 3, "payload_digest": "d", "payload": b"abc"}
    raw = warc.record(row | {"record_type": "response"}) + warc.record(row | {"record_type": "revisit", "refers_to": 9, "payload": None})

    class Stream(io.BytesIO):
        taken = 0

        def read(self, size=-1):
            Stream.taken += size
            return super().read(size)

    got = list(warc.records(Stream(raw), lambda r: r["record_type"] == "revisit", True))
    assert [r["refers_to"] for r in got] == [9] and Stream.taken == 0
    assert [r["payload"] for r in warc.records(Stream(raw), lambda r: True, True)] == [b"abc", None]


def test_cascade_is_exact(llm):
    universe = llm.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("cast(substring(key, 2) as int) % 11 = 0")
    cascade = url_filter.build_cascade(listed, universe)
    assert len(cascade.levels) > 1
    got = universe.where(cascade.listed(F.col("key")))
    assert got.count() == listed.count() and got.join(listed, "key", "left_anti").count() == 0


def test_urls(llm):
    rows = [
        (1, "HTTP://WWW.Example.com/en/x?y"), (2, "http://a.example.com/en/"), (3, "https://x.net/fr/a#b"), (4, "https://xnet/fr/"), (5, None), (6, "no scheme"),
        (7, "http://b.org/en"), (8, "http://example.com"), (9, "ftp://net/es/?q"), (10, "http://m.b.org"), (None, "http://b.com/x"),
    ]
    pages = llm.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.mobile_hosts(pages)).collect()}
    assert got == {
        1: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 2: ("a.example.com", "/en/", "example.com/en/", "block"),
        3: ("x.net", "/fr/a", "net/fr/", "block"), 4: ("xnet", "/fr/", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"),
        7: ("b.org", "/en", None, "allow"), 8: ("example.com", "", None, "allow"), 9: ("net", "/es/", "net/es/", "block"),
        10: ("m.b.org", "", None, "block"), None: ("b.com", "/x", "com/", "allow"),
    }


def test_a_list_beyond_one_constant_is_split_into_shares(llm):
    rows = [(i, f"http://{'m.' if i % 3 == 0 else ''}h{i % 400}.org/{i}", "x") for i in range(1200)] + [(None, None, None), (7, "http://x.net/fr/", "x")]
    pages = llm.createDataFrame(rows, "page_id long, url string, verdict string")
    hosts = url_filter.mobile_hosts(pages)
    judged = lambda **k: sorted(map(repr, url_filter.judge(pages, hosts, **k).collect()))
    whole = judged()
    many = url_filter.build_cascades(hosts, pages.select(url_filter.host_and_path(F.col("url"))[0].alias("key")), 3, most_bits=4096)
    assert len(many) > 1 and judged(most_bits=4096) == whole
    assert sum("verdict='block'" in r for r in whole) == 401
    assert url_filter.judge(pages.limit(0), hosts).count() == 0


def test_ordinal_regression_recovers_order():
    rng = np.random.default_rng(0)
    n, size = 600, 12
    x = (rng.random((n, size)) < 0.4).astype(float)
    score = x @ np.linspace(-3, 3, size)
    grade = np.digitize(score + rng.logistic(size=n) * 0.3, [-1, 1])
    row, at = np.nonzero(x)
    w, cuts = quality.fit_ordinal(grade, row, at, x[row, at], size)
    assert cuts[0] < cuts[1] and np.corrcoef(w, np.linspace(-3, 3, size))[0, 1] > 0.95


def test_scores_equal_the_sum_over_features():
    """The scorer's table of words against the model applied to the features that it was fitted on."""
    rng = np.random.default_rng(4)
    texts = ["One two two, three. 12", "", None, "zz " * 300, "línea\nlínea\nlínea x", "a\tb  c\x85d", "UPPER lower Mixed 1st 2nd!!"]
    features = quality.Features()
    seen = sorted({int(b) for t in texts for b in features.of(t or "")[0]})
    weights = {b: float(w) for b, w in zip(seen, rng.standard_normal(len(seen)), strict=True) if rng.random() < 0.8}
    model = quality.OrdinalModel(weights, [-0.5, 0.75])
    scorer = quality.Scorer(model)
    want = []
    for t in texts:
        at, value = features.of(t or "")
        score = sum(weights.get(int(b), 0.0) * v for b, v in zip(at, value, strict=True))
        want.append([1 - 1 / (1 + np.exp(-(cut - score))) for cut in model.cuts])
    for _ in range(2):  # words new, then from the table
        assert np.allclose(scorer.tails(texts), want, atol=1e-12)
    assert (quality.Scorer(quality.OrdinalModel({}, [])).tails(texts) == 1).all()


def test_quality_of_empty_and_odd_tables(llm):
    docs = llm.createDataFrame([(1, "good text here", 5), (1, "good text here", 6), (None, None, 7)], "doc_id long, text string, kept int")
    none = llm.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.grade_documents(docs.limit(0), none).count() == 0
    assert [r.kept for r in quality.grade_documents(docs, none).collect()] == [True] * 3  # nothing to learn from
    assert quality.keep_good(docs, none).columns == docs.columns and quality.keep_good(docs, none).count() == 3


def test_quality_on_held_out_documents(llm):
    docs, labels = (llm.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rated = quality.grades(labels)
    test = rated.where("pmod(xxhash64(doc_id, 77), 4) = 0")
    model = quality.fit(docs, labels.join(test, "doc_id", "left_anti"))
    r = quality.grade_documents(docs, labels, model=model).join(test, "doc_id").withColumn("good", F.col("grade") == 2)
    assert r.where("kept = good").count() >= 0.85 * r.count()
    assert r.where("p_ge_1 < p_ge_2 or expected_grade < 0 or expected_grade > 2").count() == 0


def test_quality_without_ratings_keeps_all(llm):
    docs = llm.createDataFrame([(1, None, 2), (None, "", 3), (2, "a b c", 4)], "doc_id long, text string, kept int")
    labels = llm.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 3


def test_pipeline_stages(llm):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        last, out = out, stage(llm, out, SF)
        assert out.columns == docs.columns and 0 < out.count() <= last.count()
    pieces = corpus_pipeline.run(llm, SF)
    assert {"doc_id", "sequence_id", "offset"} <= set(pieces.columns)
    assert pieces.select("doc_id").distinct().count() == out.select("doc_id").distinct().count()


def test_size_classes_lose_no_link_at_the_threshold():
    for percent in (10, 50, 80, 90, 99):
        limits = setjoin.size_limits(percent)
        place = lambda n: int(np.searchsorted(limits, n, side="right"))
        for n in [*range(1, 400), 1000, 12_345, 999_999]:
            assert place(100 * n // percent) - place(n) in (0, 1)


def test_sets_at_a_whole_ratio_are_linked(llm):
    few = " ".join(f"w{i}" for i in range(100))
    many = " ".join(f"w{i}" for i in range(1000))
    docs = llm.createDataFrame([(1, few), (2, many), (3, "other words here")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in setjoin.jaccard_components(docs, n=1, percent=10).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_one_of_each_with_clashing_columns(llm):
    rows = [(1, "a b c d e f g h", 1, 2), (2, "a b c d e f g h", 3, 4), (3, "z", 5, 6)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, __gone long, component_id long")
    assert sorted(r.doc_id for r in setjoin.keep_one_of_each(docs).collect()) == [1, 3]


def test_a_fit_drops_the_tables_of_the_operator_before(monkeypatch):
    from yieldspark.llm import common

    dropped = []
    monkeypatch.setattr(common, "_TABLES", [("packing", lambda: dropped.append(True))])
    part = pd.DataFrame({"grade": [0, 2] * 20, "at": [np.array([1, 2]), np.array([3, 2])] * 20, "value": [np.array([1.0, 1.0])] * 40})
    weights = dict(quality._fit_part(5)(part).itertuples(index=False))
    assert dropped and [owner for owner, _ in common._TABLES] == ["quality"]
    assert weights[1] < 0 < weights[3]
    assert "at" not in part and "value" not in part  # not held besides the arrays made of them
