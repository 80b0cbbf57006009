"""Packing documents into sequences: bounded-space online best fit (operator 6).

Each partition keeps a fixed number of open windows.  A document's ids fill
whole windows first; the rest goes to the open window it fits best.  When none
fits and all are open, the fullest is emitted: it is first topped up with ids
of the document (cuts are free) unless so little is left that the cut piece
would be tiny.  What is still open when a partition ends is merged: its pieces
are placed anew, longest first, in groups of partitions of bounded size.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_only, text_chunks, written

VOCABULARY = "word_bpe_49k.json"
WINDOW = 2048
#: Open windows of a partition, the least number of ids worth a cut, and partitions whose leftovers are merged together.
OPEN, LEAST_CUT, MERGED = 16, 32, 64
#: The id that ends a document.
END = 1
#: Bytes that a worker's tables of word ids may hold, each.
TABLE_BYTES = 32 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Characters that str.split() takes for white space and the vocabulary's word pattern doesn't.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_SPACES = re.compile(r"[\t\n\x0b\f\r \x85\xa0  -     　]+")


#: Words of a text in Latin letters, after lowering: the vocabulary's word pattern with its classes written out.
_LETTERS, _NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")


class WordIds:
    """Ids of texts as little-endian bytes, by a bounded table of the words met; the vocabulary's library encodes new words.

    White space never lies inside a token of this vocabulary and is dropped,
    so a text's ids are those of its words in turn.  A text in Latin letters,
    which normalisation only lowers, is cut into the vocabulary's own words,
    and new ones are encoded many at a time: the last token of each carries
    the end mark.  Other texts are cut at white space.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or r"(?!)")
        self.table: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.held = [0, 0]

    def _cut(self, text: str) -> tuple[list[str], bool]:
        """Words of a text, and whether they are the vocabulary's own."""
        if _SEPARATORS.search(text):
            return [w for w in _SPACES.split(text) if w], False
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text.split(), False
        if self.special.search(text):
            return text.split(), False
        return _LATIN.findall(text.lower()), True

    def _learn_parts(self, new: list[str]) -> None:
        lines = [new[i : i + 500] for i in range(0, len(new), 500)]
        for line, e in zip(lines, self.library.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            raw = ids.tobytes()
            self.parts.update(zip(line, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def _learn_words(self, new: list[str]) -> None:
        for i in range(0, len(new), 1000):
            part = new[i : i + 1000]
            for w, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.table[w] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.held[0] > TABLE_BYTES:
            self.parts, self.held[0] = {}, 0
        if self.held[1] > TABLE_BYTES:
            self.table, self.held[1] = {}, 0
        cut = [self._cut(t) for t in texts]
        parts = list(set().union(*[w for w, own in cut if own]).difference(self.parts))
        words = list(set().union(*[w for w, own in cut if not own]).difference(self.table))
        for i, new in enumerate((parts, words)):  # a word, its ids, and what Python adds to both
            self.held[i] += sum(220 + 4 * len(w) for w in new)
        self._learn_parts(parts)
        self._learn_words(words)
        part, word = self.parts.__getitem__, self.table.__getitem__
        return [b"".join(map(part if own else word, words)) for words, own in cut]


_IDS: dict[str, WordIds] = {}


def word_ids(name: str) -> WordIds:
    if name not in _IDS:
        _IDS[name] = WordIds(name)
    return _IDS[name]


class OpenWindows:
    """Windows that pieces still go to, ordered by the room left."""

    def __init__(self, window: int, limit: int | None):
        self.window, self.limit, self.made = window, limit, 0
        self.by_room: list[tuple[int, int]] = []
        self.pieces: dict[int, list[tuple]] = {}

    def best(self, length: int) -> tuple[int, int] | None:
        i = bisect_left(self.by_room, (length, -1))
        return self.by_room[i] if i < len(self.by_room) else None

    def open(self) -> tuple[int, int] | None:
        if self.limit is not None and len(self.by_room) >= self.limit:
            return None
        got = (self.window, self.made)
        self.made += 1
        insort(self.by_room, got)
        self.pieces[got[1]] = []
        return got

    def put(self, at: tuple[int, int], piece: tuple) -> bool:
        """Add a piece ``(…, length)``; True if the window is full now."""
        self.by_room.remove(at)
        self.pieces[at[1]].append(piece)
        left = at[0] - piece[-1]
        if left:
            insort(self.by_room, (left, at[1]))
        return not left

    def close(self, at: int) -> list[tuple]:
        self.by_room = [x for x in self.by_room if x[1] != at]
        return self.pieces.pop(at)


def _placed(pieces: list[tuple], sequence: int) -> list[tuple]:
    out, offset = [], 0
    for doc, start, crc, tokens, length in pieces:
        out.append((doc, start, length, crc, tokens, sequence, offset))
        offset += length
    return out


def _first_pass(vocabulary: str, window: int, limit: int, least: int, columns: list[str]):
    schema = pa.schema([(c, pa.int64()) for c in [*columns, "part"]])

    def run(batches):
        keep_only("packing", _IDS.clear)
        ids, part = word_ids(vocabulary), TaskContext.get().partitionId()
        state, emitted = OpenWindows(window, limit), 0
        base = part << 32

        def batch_of(rows, part=None):
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (*r, part), strict=True)) for r in rows], schema)

        def emit(pieces):
            nonlocal emitted
            got = _placed(pieces, base + emitted)
            emitted += 1
            return got

        for batch in batches:
            rows, out = list(text_chunks(batch, ["doc_id", "text"])), []
            for i in range(0, len(rows), 200):
                chunk = rows[i : i + 200]
                for (doc, _), raw in zip(chunk, ids.encode([r[1] or "" for r in chunk]), strict=True):
                    raw += END.to_bytes(4, "little")
                    view, total, at = memoryview(raw), len(raw) // 4, 0

                    def cut(length, doc=doc, view=view, total=total):
                        nonlocal at
                        piece = (doc, at, zlib.crc32(view[4 * at : 4 * (at + length)]), total, length)
                        at += length
                        return piece

                    while total - at >= window:
                        out += emit([cut(window)])
                    while at < total:
                        if (w := state.best(total - at) or state.open()) is not None:
                            if state.put(w, cut(total - at)):
                                out += emit(state.close(w[1]))
                            continue
                        w = state.by_room[0]  # none fits: the fullest goes
                        if w[0] >= least:
                            state.put(w, cut(w[0]))
                        out += emit(state.close(w[1]))
            yield batch_of(out)
        rest = [x for at in sorted(state.pieces) for x in _placed(state.pieces[at], at)]
        yield batch_of(rest, part)

    return run


def _merge(window: int):
    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        state, base = OpenWindows(window, None), (1 << 61) + (int(key[0]) << 32)
        rows = sorted(
            zip(*(pieces[c].tolist() for c in ("length", "part", "sequence_id", "offset", "doc_id", "start", "ids_crc32", "doc_tokens")), strict=True),
            key=lambda r: (-r[0], r[1], r[2], r[3]),
        )
        for length, _, _, _, doc, start, crc, tokens in rows:
            state.put(state.best(length) or state.open(), (None if pd.isna(doc) else doc, start, crc, tokens, length))
        out = [x for at in sorted(state.pieces) for x in _placed(state.pieces[at], base + at)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pd.DataFrame(out, columns=names).astype({c: "Int64" for c in names})

    return run


def pack_documents(
    docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW, open_windows: int = OPEN, least_cut: int = LEAST_CUT
) -> DataFrame:
    """One row per piece of a document, with its place in a sequence of at most ``window`` ids.

    A null or empty text is the end id alone.  Rows with a null or a repeated
    id are packed like others; other columns are ignored; an empty table gives
    no rows.  The pieces (no texts) are written once, so the leftovers that
    are merged are those of the rows that were emitted, also after a lost
    executor.
    """
    columns = [c.split()[0] for c in PIECES.split(", ")]
    first = written(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
            _first_pass(vocabulary, window, open_windows, least_cut, columns), f"{PIECES}, part long"
        ),
        "packed",
    )
    merged = (
        first.where("part is not null")
        .withColumn("bunch", F.floor(F.col("part") / MERGED).cast("long"))
        .groupBy("bunch")
        .applyInPandas(_merge(window), PIECES)
    )
    return first.where("part is null").select(*columns).unionByName(merged)
