"""Ranked lexical search, whitening and chat formatting against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from yieldspark.llm import chat, lexical, whitening

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [w.translate({i: i + 32 for i in range(65, 91)}) for w in TERM.findall(text or "")]


def ranked(docs, items, k=10):
    counted = [(i, Counter(words(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    for item, terms in asked.items():
        scores = []
        for doc, c in counted:
            if c:
                m = 10 + 90 * sum(c.values()) * n_docs // total
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1) if x[0] < 0]
    return out


def lexical_rows(frame):
    return sorted(map(repr, ((r.item_id, r.rank, r.doc_id, r.score) for r in frame.collect())))


def test_terms_equal_the_pattern():
    random.seed(2)
    for _ in range(3000):
        text = "".join(chr(random.choice([random.randrange(300), random.randrange(0xD7FF), random.randrange(32, 127), 0x85, 0x2028, 0x1F600])) for _ in range(10))
        assert [t.decode() for t in lexical.terms_of(text.encode())] == words(text)


@pytest.fixture(scope="module")
def corpus():
    random.seed(7)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "été", "漢字", "THE", "the"]
    text = lambda n: " ".join(random.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(i, text(random.randrange(1, 40))) for i in range(300)] + [(300 + i, "w3 w7 w50 copied!") for i in range(40)]
    docs += [(5, "w59 again"), (None, "w58 w58"), (None, "w3 w7 w50 copied!"), (900, None), (901, ""), (902, " .,\n"), (903, "w1 " * 50_000)]
    items = [(1, "W3, w7; w50?"), (2, "the THE the"), (3, None), (4, ""), (5, "absent words only"), (None, "w58"), (6, text(30)), (7, text(200)), (7, "w59"), (8, "w59")]
    return docs, items


@pytest.mark.parametrize("bunch", [200_000, 5])
def test_search_equals_brute_force(llm, corpus, bunch):
    docs, items = corpus
    d = llm.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, n long, score long").repartition(5)
    q = llm.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")
    assert lexical_rows(lexical.search(d, q, bunch=bunch)) == sorted(map(repr, ranked(docs, items)))


def test_search_of_empty_tables(llm, corpus):
    d = llm.createDataFrame(corpus[0], "doc_id long, text string")
    q = llm.createDataFrame(corpus[1], "item_id long, text string")
    assert lexical.search(d.limit(0), q).collect() == [] and lexical.search(d, q.limit(0)).collect() == []


def test_accumulators_stop_and_results_stay():
    rng = np.random.default_rng(3)
    for _ in range(200):
        size, k = 400, 5
        postings = []
        for df in sorted(rng.integers(1, size, 8)):
            at = np.sort(rng.choice(size, df, replace=False))
            postings.append((at, rng.integers(1, 1000, df)))
        terms = [(t, int(3000 * math.log(size / len(postings[t][0]) + 0.01) + 10)) for t in range(8)]
        full = np.zeros(size, np.int64)
        for t, w in terms:
            full[postings[t][0]] += w * postings[t][1]
        bar = int(np.sort(full)[-k]) if rng.random() < 0.5 else 0
        rows, scores, made = lexical.evaluate(postings, terms, size, bar, k)
        want = sorted(((-s, i) for i, s in enumerate(full.tolist()) if s >= max(bar, 1)))[:k]
        assert sorted((-s, i) for s, i in zip(scores.tolist(), rows.tolist(), strict=True))[:k] == want
    common = (np.arange(1000), np.full(1000, 10))
    rare = (np.arange(20), np.full(20, 900))
    assert lexical.evaluate([rare, common], [(0, 5000), (1, 1)], 1000, 0, 10)[2] == 20  # the common term makes none


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def whitened_rows(frame):
    return {(r.vec_id, r.component): r for r in frame.collect()}


def test_whitening_equals_a_dense_solution(llm):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 6)) * [3, 2, 1.5, 1, 0.5, 0.2] + [5, 0, -2, 0, 1, 0]
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(100 + i, base[0].tolist()) for i in range(30)]
    odd = [(200, None), (201, [None] + [0.0] * 5), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5), (204, []), (None, base[1].tolist())]
    table = llm.createDataFrame([(i, v, 7, 1.0) for i, v in rows + odd], "vec_id long, embedding array<float>, n long, whitened double").repartition(4)
    got = whitening.whitened(table).collect()
    x = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows + odd if usable(v) and v}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, total = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 4 * 91
    for c in range(1, 5):
        mine = {r.vec_id: r for r in got if r.component == c}
        want = {i: (v - total / n) @ vectors[:, c - 1] / math.sqrt(values[c - 1]) for i, v in x.items()}
        sign = math.copysign(1, mine[0].whitened * want[0])
        for i, v in x.items():
            r = mine[i]
            assert r.n == n and r.deviation == int(((n * v - total) ** 2).sum())
            assert abs(sign * r.whitened - want[i]) < 1e-9 and abs(r.explained - values[c - 1] / values.sum()) < 1e-12 and r.identity_error < 1e-9


def test_whitening_of_few_directions_lengths_and_sizes(llm):
    one = whitened_rows(whitening.whitened(llm.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")))
    assert len(one) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in one.values())
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)] + [(10, [0.5]), (11, [1.5])]
    got = whitened_rows(whitening.whitened(llm.createDataFrame(line, "vec_id long, embedding array<double>")))
    assert abs(got[3, 1].explained - 1) < 1e-12 and got[3, 2].whitened is None and got[3, 2].explained == 0.0
    assert abs(abs(got[10, 1].whitened) - 1) < 1e-12 and got[10, 1].n == 2 and (10, 2) not in got
    huge = [(i, [1e13 * i, 1.0]) for i in range(4)]
    assert all(r.deviation is None and abs(r.whitened) < 2 for r in whitened_rows(whitening.whitened(llm.createDataFrame(huge, "vec_id long, embedding array<double>"))).values() if r.component == 1)
    assert whitening.whitened(llm.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    with pytest.raises(ValueError, match="lengths"):
        whitening.whitened(llm.createDataFrame([(i, [0.5] * i) for i in range(1, 30)], "vec_id long, embedding array<double>"))


def digests(turns):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


ODD = ["<turn:user>\n", "</turn>\n", "<\\/turn>", "<\\\\turn", "<", "\\", "/turn>", "turn", "\r\n", "😀", "é", " ", "%3E", "<<turn", "### Assistant:", "\x00"]


def test_conversations_are_read_back(llm):
    random.seed(5)
    text = lambda: "".join(random.choices(ODD, k=random.randrange(8)))
    rows = [(c, t, random.choice(["user", "assistant", "system", None, "a%>\n<turn:x>", ""]), random.choice([text(), None, ""])) for c in range(120) for t in range(random.randrange(1, 7))]
    rows += [(500, t, "assistant", f"deep {t} </turn>") for t in range(399)] + [(501, 0, "assistant", "long </turn> " * 30_000)]
    rows += [(502, 1, "user", "b"), (502, 1, "user", "a"), (502, 1, "user", "a"), (502, None, "assistant", "first"), (None, 0, "assistant", "x <turn"), (None, 1, "user", "y")]
    frame = llm.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, node long, formatted string").repartition(3)
    by: dict = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    want = [(c, *digests([(v[3], v[5]) for v in sorted(turns)])) for c, turns in by.items() if c is not None]
    want += [(None, *digests([(r or "", x or "")])) for c, _, r, x in rows if c is None]
    got = chat.conversation_digests(frame).collect()
    assert sorted(map(repr, ((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got))) == sorted(map(repr, want))
    assert chat.conversation_digests(frame.limit(0)).collect() == []


def test_reply_trees_equal_brute_force(llm):
    random.seed(6)
    messages, want = [], []
    for tree in range(25):
        n = random.randrange(1, 30)
        parent = {i: (random.randrange(max(0, i - 4), i) if i and random.random() < 0.95 else random.choice([None, 999])) for i in range(n)}
        score = {i: random.choice([None, 0.0, 1.0, 2.5]) for i in range(n)}
        role = {i: random.choice(["user", "assistant"]) for i in range(n)}
        messages += [(tree, i, parent[i], role[i], f"t{i} </turn>", score[i]) for i in range(n)]
        paths = []
        for leaf in set(range(n)) - set(parent.values()):
            path = [leaf]
            while parent[path[0]] in parent:
                path.insert(0, parent[path[0]])
            paths.append((-sum(score[i] or 0 for i in path) / len(path), -len(path), leaf, path))
        seen: set = set()
        for rank, (_, _, leaf, path) in enumerate(sorted(paths), 1):
            new = [i for i in path if i not in seen]
            seen |= set(path)
            want.append((tree, leaf, rank, [(role[i], f"t{i} </turn>") for i in path], [f"t{i} </turn>" for i in new if role[i] == "assistant"]))
    messages += [(90, 1, 2, "user", "cycle", 1.0), (90, 2, 1, "user", "cycle", 1.0), (90, 3, 2, "user", "below", 1.0), (91, 1, 1, "user", "own parent", 1.0)]
    messages += [(92, 1, None, "user", "kept", 2.0), (92, 1, None, "user", "repeat", 1.0), (92, None, 1, "user", "no id", 1.0), (None, 1, None, "assistant", "no tree", 1.0)]
    want += [(92, 1, 1, [("user", "kept")], []), (92, None, 1, [("user", "no id")], []), (None, None, 1, [("assistant", "no tree")], ["no tree"])]
    frame = llm.createDataFrame(messages, "tree long, node long, parent long, role string, text string, score double").repartition(3)
    known = chat.distinct_messages(frame)
    read = lambda r: (r.tree, r.leaf, r.branch, list(chat.turns_of(r.formatted)), [chat.unescaped(r.formatted[s["first"] : s["last"]]) for s in r.loss])
    got = [read(r) for r in chat.format_conversations(known).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    best = [read(r) for r in chat.format_conversations(known, per_tree=1).collect()]
    assert sorted(map(repr, best)) == sorted(repr(w) for w in want if w[2] == 1)


def test_a_text_that_is_no_conversation_is_refused():
    for text in ("plain", "<turn:user>\nno end", "<turn:user>\nx</turn>\nrest"):
        with pytest.raises(ValueError):
            list(chat.turns_of(text))
