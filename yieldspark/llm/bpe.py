"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks (operator 1).

A word is a row of symbols.  The tree's leaf ``i`` holds ``rank * width + i``
for the pair that starts at symbol ``i``, its root the least of them: the
leftmost pair of the lowest rank.  A merge changes three leaves, each updated
in a logarithmic number of steps, until no mergeable pair remains.  Words met
for the first time in an Arrow batch are merged together: the trees of words
of like length are the rows of one array.

Splitting a text into words: a blank is the start of a word unless white
space stands on both sides of it (or the text ends after it), whatever stands
further away, so texts are cut at such blanks and the pieces are looked up in
a bounded table; a text where white space surrounds a blank is cut only at
blanks that follow something else.  A special token's
string stands for its id wherever it occurs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_characters, keep_only, text_chunks

VOCABULARY = "byte_bpe_50k.json"
#: Words and pieces of texts that a worker keeps; the table is emptied when it is full.
TABLE_SIZE = 700_000
#: Words up to this many bytes are merged as rows of an array, longer ones one by one.
ROW_WIDTH = 256
_NONE = np.int64(2**62)
#: White space of the word pattern, as the vocabulary's own library reads it.
_SPACE = r"\t\n\x0B\f\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Fixed value: the word pattern of the byte-level vocabulary.
WORDS = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_BETWEEN_SPACE = re.compile(r"\s (?:\s|\Z)")
_AFTER_TEXT = re.compile(r"(?<=\S) ")


def cut_at_blanks(text: str) -> list[str]:
    """Pieces of a text at blanks that start a word whatever stands around them, each blank with what follows."""
    first, *rest = _AFTER_TEXT.split(text) if _BETWEEN_SPACE.search(text) else text.split(" ")
    return [*([first] if first else []), *[" " + x for x in rest]]


class ByteBpe:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], byte_characters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.first = np.array([vocab[chars[b]] for b in range(256)], dtype=np.int64)
        back = {c: b for b, c in chars.items()}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.base = max(vocab.values()) + 1
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        pairs = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.pair_rank = np.append(pairs[order], _NONE), np.append(order, 0).astype(np.int64)
        self.rank_of = {int(p): r for r, p in enumerate(pairs)}
        self.words: dict[str, tuple[int, str, bytes]] = {}

    # -- merging -------------------------------------------------------------------
    def _ranks(self, left: np.ndarray, right: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
        """Leaf values of the pairs (left, right) at positions ``at``; a negative side has no pair."""
        key = left * self.base + right
        i = np.searchsorted(self.pairs, key)
        return np.where((left >= 0) & (right >= 0) & (self.pairs[i] == key), self.pair_rank[i] * width + at, _NONE)

    def merge_rows(self, words: list[bytes], width: int) -> tuple[list[int], list[int]]:
        """Words of at most ``width`` bytes (a power of two), merged side by side: all their ids in turn, and how many each has."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        inside = np.arange(width) < size[:, None]
        symbol = np.full((n, width + 1), -1, dtype=np.int64)  # the last column is the end mark
        symbol[:, :width][inside] = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
        tree[:, width:] = self._ranks(symbol[:, :width], symbol[:, 1:], width, np.arange(width))
        for k in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while rows.size:
            rank, at = np.divmod(tree[rows, 1], width)
            gone = after[rows, at]
            beyond = after[rows, gone]
            symbol[rows, at], symbol[rows, gone] = self.made[rank], -1
            after[rows, at] = beyond
            has = beyond <= width
            before[rows[has], np.minimum(beyond[has], width)] = at[has]
            nxt = np.where(has, symbol[rows, np.minimum(beyond, width)], -1)
            self._set(tree, rows, gone, np.full(rows.size, _NONE), width)
            self._set(tree, rows, at, self._ranks(symbol[rows, at], nxt, width, at), width)
            prev = before[rows, at]
            own = prev >= 0
            r, p = rows[own], prev[own]
            self._set(tree, r, p, self._ranks(symbol[r, p], symbol[r, at[own]], width, p), width)
            rows = rows[tree[rows, 1] < _NONE]
        symbol = symbol[:, :width]
        kept = symbol >= 0
        return symbol[kept].tolist(), kept.sum(axis=1).tolist()

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
        node = at + width
        tree[rows, node] = value
        for _ in range(width.bit_length() - 1):
            node >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def merge_one(self, word: bytes) -> list[int]:
        """The same for one long word, with the tree in a list."""
        n = len(word)
        width = 1 << max(1, (n - 1).bit_length())
        none, rank_of, base = int(_NONE), self.rank_of, self.base
        symbol = [int(self.first[b]) for b in word]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        tree = [none] * (2 * width)

        def pair(i: int, j: int) -> int:
            rank = rank_of.get(symbol[i] * base + symbol[j])
            return none if rank is None else rank * width + i

        def put(i: int, value: int) -> None:
            node = i + width
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        for i in range(n - 1):
            tree[width + i] = pair(i, i + 1)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            symbol[at], symbol[gone] = int(self.made[rank]), -1
            beyond = after[at] = after[gone]
            put(gone, none)
            if beyond < n:
                before[beyond] = at
            put(at, pair(at, beyond) if beyond < n else none)
            if before[at] >= 0:
                put(before[at], pair(before[at], at))
        return [s for s in symbol if s >= 0]

    # -- words and texts -------------------------------------------------------------
    def _entry(self, ids: list[int]) -> tuple[int, str, bytes]:
        if len(ids) == 1:
            return 1, self.text_of[ids[0]], self.bytes_of[ids[0]]
        return len(ids), ",".join([self.text_of[i] for i in ids]), b"".join([self.bytes_of[i] for i in ids])

    def learn(self, words: set[str]) -> None:
        """Merge words that the table doesn't hold."""
        by_width: dict[int, list[str]] = {}
        for w in words:
            n = len(w.encode()) if not w.isascii() else len(w)
            if n > ROW_WIDTH:
                self.words[w] = self._entry(self.merge_one(w.encode()))
            else:
                by_width.setdefault(1 << max(1, (n - 1).bit_length()), []).append(w)
        for width, group in by_width.items():
            step = max(1, 2**20 // width)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                flat, sizes = self.merge_rows([w.encode() for w in part], width)
                at = 0
                for w, n in zip(part, sizes, strict=True):
                    self.words[w] = self._entry(flat[at : at + n])
                    at += n

    def segments(self, text: str) -> list[str]:
        """Pieces of a text between special tokens (which are pieces too), such that no word crosses a cut."""
        found = self.special_at.split(text) if self.special and self.special_at.search(text) else None
        if found is not None:
            marks = self.special_at.findall(text)
            out = self.segments(found[0])
            for mark, part in zip(marks, found[1:], strict=True):
                out.append(mark)
                out.extend(self.segments(part))
            return out
        return cut_at_blanks(text)
    def know(self, texts: list[list[str]]) -> dict[str, tuple[int, str, bytes]]:
        """The table of words and pieces, with the pieces of the given texts in it: count, ids and bytes of each."""
        if len(self.words) > TABLE_SIZE:
            self.words = {}
        table = self.words
        new = set().union(*texts).difference(table)
        split = {p: WORDS.findall(p) for p in new if p not in self.special}
        self.learn({w for ws in split.values() for w in ws if w not in table})
        for p in new:
            if p in table:
                continue
            if p in self.special:
                table[p] = self._entry([self.special[p]])
            else:
                got = [table[w] for w in split[p]]
                table[p] = (sum([g[0] for g in got]), ",".join([g[1] for g in got]), b"".join([g[2] for g in got]))
        return table

    def encode(self, text: str | None) -> list[int]:
        pieces = self.segments(text or "")
        known = self.know([pieces])
        return [int(i) for p in pieces for i in known[p][1].split(",")]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(self.bytes_of[i] for i in ids)

    def decode(self, ids: Iterable[int]) -> str:
        """Special tokens come out as their strings; bytes that are no UTF-8 as replacement characters."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_MODELS: dict[str, ByteBpe] = {}


def model(name: str = VOCABULARY) -> ByteBpe:
    """The vocabulary ``name`` of the installed public tokenizers, loaded once per process."""
    if name not in _MODELS:
        import public_tokenizers

        _MODELS[name] = ByteBpe(public_tokenizers.path(name))
    return _MODELS[name]


def _batches(texts: Iterable[str], limit: int = 2_000_000) -> Iterable[list[str]]:
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t)
        if size > limit:
            yield out
            out, size = [], 0
    if out:
        yield out


def _digests(name: str):
    def run(batches):
        keep_only("bpe", _MODELS.clear)
        bpe = model(name)
        for batch in batches:
            ids, counts, id_sums, text_sums = [], [], [], []
            rows = list(text_chunks(batch, ["doc_id", "text"]))
            ids = [r[0] for r in rows]
            for texts in _batches(r[1] or "" for r in rows):
                cut = [bpe.segments(t) for t in texts]
                known = bpe.know(cut)
                for pieces in cut:
                    got = list(map(known.__getitem__, pieces))
                    counts.append(sum(g[0] for g in got))
                    id_sums.append(hashlib.sha256(",".join([g[1] for g in got]).encode()).hexdigest())
                    raw = b"".join([g[2] for g in got])
                    text_sums.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def token_digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: token count and digests of the ids and of the text decoded from them.

    One pass without a shuffle.  A null text is empty (0 tokens, digests of
    nothing); rows with a null id or repeated ids are returned as they are;
    other columns are ignored; an empty table gives none.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _digests(vocabulary), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def encode_texts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, ids)``: the encoded texts themselves."""

    def run(batches):
        keep_only("bpe", _MODELS.clear)
        bpe = model(vocabulary)
        for batch in batches:
            rows = list(text_chunks(batch, ["doc_id", "text"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([bpe.encode(r[1]) for r in rows], pa.list_(pa.int32()))],
                names=["doc_id", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_texts(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; null ids give an empty text."""

    def run(batches):
        keep_only("bpe", _MODELS.clear)
        bpe = model(vocabulary)
        for batch in batches:
            rows = list(text_chunks(batch, ["doc_id", "ids"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([bpe.decode(r[1] or []) for r in rows], pa.string())],
                names=["doc_id", "text"],
            )

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
