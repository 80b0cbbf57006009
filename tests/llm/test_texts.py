"""Tokens, packing and personal data against the libraries and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from yieldspark.llm import bpe, packing, pii, token_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_level():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def plain(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_segment_tree_encoder_equals_library(byte_level):
    random.seed(1)
    model, letters = bpe.model(), "ab  \n\t'strevelmd019é–漢字  ́😀\x1c\x85İſ,.!?<|endoftext|>"
    for _ in range(1500):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 30)))
        assert model.encode(text) == plain(byte_level, text), repr(text)
        assert model.decode(model.encode(text)) == text
    for text in ("a" * 3000 + "xyz" * 500, "<|endoftext|>" * 3, " " * 700):
        assert model.encode(text) == plain(byte_level, text)


def test_row_and_list_trees_merge_alike():
    model = bpe.model()
    words = ["theological", "aaaaaaaaaaaaa", "x", "onomatopoeia!", "漢字漢字"]
    flat, sizes = model.merge_rows([w.encode() for w in words], 32)
    at = 0
    for w, n in zip(words, sizes, strict=True):
        assert flat[at : at + n] == model.merge_one(w.encode())
        at += n


def test_decoded_digests_equal_the_librarys_decode(llm, odd_texts, byte_level):
    def decoded(text):
        return hashlib.sha256(byte_level.decode(plain(byte_level, text), skip_special_tokens=False).encode()).hexdigest()

    assert sorted((str(r.doc_id), r.decoded_sha256) for r in bpe.token_digests(odd_texts).collect()) == sorted((str(r.doc_id), decoded(r.text)) for r in odd_texts.collect())


def test_token_digests(llm, odd_texts, byte_level):
    docs = odd_texts
    want = sorted((str(r.doc_id), len(i := plain(byte_level, r.text)), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest()) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in bpe.token_digests(docs).collect()) == want
    back = {r.doc_id: r.text for r in bpe.decode_texts(bpe.encode_texts(docs)).collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in docs.collect())
    assert bpe.token_digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(32_768, 1024), (600, 150)])
def test_token_counts(llm, odd_texts, byte_level, chunk, overlap):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd_texts, chunk=chunk, overlap=overlap).collect())
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(plain(byte_level, r.text)), n > 1024) for r in odd_texts.collect())
    assert got == want


def test_token_counts_empty(llm, odd_texts):
    assert token_counts.token_counts(odd_texts.limit(0)).count() == 0


def test_packing(llm, odd_texts, word_level):
    pieces = packing.pack_documents(odd_texts.where("doc_id is not null").dropDuplicates(["doc_id"]), window=64, open_windows=3, least_cut=4).collect()
    want = {r.doc_id: [*plain(word_level, r.text), 1] for r in odd_texts.collect()}
    for doc in {p.doc_id for p in pieces}:
        at = 0
        for p in sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start):
            ids = want[doc][p.start : p.start + p.length]
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(want[doc]), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
            at += p.length
        assert at == len(want[doc])
    by_sequence: dict[int, list] = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for group in by_sequence.values():
        at = 0
        for p in sorted(group, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64
    assert sum(p.length for p in pieces) > 0.8 * 64 * len(by_sequence)
    assert packing.pack_documents(odd_texts.limit(0)).count() == 0
    every = packing.pack_documents(odd_texts).groupBy().sum("length").first()[0]
    assert every == sum(len(plain(word_level, r.text)) + 1 for r in odd_texts.collect())


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def good(kind, value):
        d = [int(c) for c in re.sub("[^0-9]", "", value)]
        if kind == "ip":
            return all(int(x) <= 255 for x in value.split("."))
        if kind == "card":
            return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
        return kind != "phone" or 10 <= len(d) <= 15

    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], text or "") if good(k, m.group())]
    return [x[2] for x in sorted(found)]


def test_personal_data_base_spans(llm):
    random.seed(4)
    signs = ["a", "b.", "@", "@x.", "_", "%", "1", "2", "0", "255", ".", "+", "+1", "4111 1111 1111 1111", "4111111111111111", " ", "-", "(", "é", "漢", "😀", "1.2.3.4", " .com", "a@b.c"]
    rows = [(i, "".join(random.choice(signs) for _ in range(random.randint(0, 14)))) for i in range(3000)]
    rows += [(9000, None), (9001, ""), (9002, "1." * 2000), (9003, "a@" + "b." * 2000 + "c"), (None, "a@b.c"), (9004, "4" * 3000)]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    want = {i: base_spans(t) for i, t in rows}
    for r in pii.personal_data(docs).collect():
        spans = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), r
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in PATTERNS]
        assert set(spans) <= set(r.spans.split(",")) | {""}
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_redaction(llm):
    rows = [(1, "Call me (555) 123-4567 or mail bob (at) example (dot) com now", 3), (2, "x a@b.co +1 (367) 555-7441", 4), (3, None, None), (4, "plain text", 10)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(1)
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[1].text == "Call me [PHONE] or mail [EMAIL] now"
    assert out[2].text == "x [EMAIL] [PHONE]" and out[2].n_chars == 17
    assert out[3].text is None and out[4].n_chars == 10


def test_a_wrong_check_digit_speaks_against_a_card(llm):
    random.seed(9)
    base = [(i, f"card 4111 1111 1111 1111 or mail a{i}@b.com from 10.0.0.{i}") for i in range(40)]
    wrong = [(100 + i, f"number {random.choice('45')}{random.randrange(10**14, 10**15)}") for i in range(60)]
    wrong = [(i, t + str((int(t[-1]) + 5) % 10)) for i, t in wrong]
    wrong = [(i, t) for i, t in wrong if base_spans(t) == []]
    docs = llm.createDataFrame(base + wrong, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert all(got[i].spans == "" for i, _ in wrong) and all(got[i].n_card == 1 for i, _ in base)


def test_reliabilities_follow_planted_votes(llm):
    """EM rates a labeler that agrees with the others above one that votes at random."""
    random.seed(3)
    rows = []
    for i in range(400):
        good = i % 2 == 0
        mail = f"mail {'x' * (i % 7 + 1)}@host{i}.{'com' if good else 'qqzz'}"
        rows.append((i, mail if good else f"version {i}@{'y' * (i % 5 + 1)}.qqzz"))
    found = llm.createDataFrame(rows, "doc_id long, text string").select(pii.candidates(F.col("text")).alias("found"))
    model = pii.fit(found)
    ratio = lambda name: model.reliability[name][1][0] / model.reliability[name][1][1]
    assert ratio("gazetteer") > 2 and ratio("context") > 2 and 0.5 < ratio("pattern") < 2
