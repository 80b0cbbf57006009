"""Ranked lexical search by accumulator-limited term-at-a-time evaluation (operator 11).

One pass over the texts counts terms and writes, per document, its length and
the counts of those terms that some item may ask for (a fixed-size bitmap of
hashed query terms travels to the tasks; the join by the whole term, which
follows, removes false positives).  The counts over all documents (N, L, df)
come from that table.

Then every task reads its share of the table in blocks of documents and takes
an item's terms one at a time, the rarest first.  A term adds its exact
contribution to the accumulators of the documents that hold it.  Each term's
largest contribution within the block bounds what it can add, so once the sum
of the remaining bounds cannot reach the k-th best score known so far (of this
block's partial scores or of the task's earlier blocks), no more accumulators
are made, and the remaining terms only update those that exist.  The k best
of each task merge on the item.

The items are a stated query set: they are dealt into bunches of a bounded
number of (item, term) rows, each of which is one pass over the small table.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K = 10
#: Bits of the bitmap of query terms; (item, term) rows of a bunch of items; documents and counts of a block.
BITS, BUNCH, BLOCK, COUNTS = 1 << 22, 200_000, 16_384, 4_000_000
#: Length normalisation in hundredths, and the scale of one term's contribution.
B100, SCALE, SATURATION = 90, 1_000_000_000, 8
#: First shards of a merge of ranked rows.
SHARDS = 64

_SEPARATORS = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_LOWER = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))
_COUNTED = "doc_id long, n long, terms array<binary>, tfs array<long>"
_HITS = "item_id long, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats: ASCII letters and digits and every character beyond ASCII; only A-Z is lower-cased."""
    return text.translate(_LOWER).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _bytes(column: pa.Array) -> Iterator[bytes | None]:
    for x in column.cast(pa.binary()):
        yield x.as_py()


def _item_terms(text_column: str, names: list[str]):
    def run(batches):
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            found = [sorted(set(terms_of(t))) for t in _bytes(batch.column(text_column))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, f in zip(ids, found, strict=True) for _ in f], pa.int64()), pa.array([t for f in found for t in f], pa.binary())], names=names
            )

    return run


def item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, term)``, each once; rows that share an item id form one item."""
    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(_item_terms("text", ["item_id", "term"]), "item_id long, term binary").distinct()


def _bitmap(terms: DataFrame) -> bytes:
    """``BITS`` bits of which those of the terms' CRC-32 are set."""
    at = F.crc32("term") % F.lit(BITS)
    words = terms.select((at / 32).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(crc32(term) % {BITS} % 32 as int))").alias("bit"))
    out = np.zeros(BITS // 32, np.uint32)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # at most BITS / 32 rows
        out[r["word"]] = r["bits"]
    return out.tobytes()


def _count(bitmap: bytes):
    def run(batches):
        bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").tobytes()
        crc, top = zlib.crc32, BITS - 1
        for batch in batches:
            ids, n, terms, tfs, ends = [], [], [], [], [0]
            for doc, text in zip(batch.column("doc_id").to_pylist(), _bytes(batch.column("text")), strict=True):
                counts = Counter(words := terms_of(text))
                if not words:
                    continue
                asked = [t for t in counts if bits[crc(t) & top]]
                ids.append(doc)
                n.append(len(words))
                terms += asked
                tfs += [counts[t] for t in asked]
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.binary())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return run


def evaluate(postings: list[tuple[np.ndarray, np.ndarray] | None], terms: list[tuple[int, int]], size: int, bar: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Term-at-a-time over one block for one item.

    ``postings`` holds, by term, the rows of the block and their contributions;
    ``terms`` the item's ``(term, weight)``, the rarest first.  Returns the
    rows whose score may be among the ``k`` best (scores of at least ``bar``
    and above 0), their scores, and the number of accumulators made.
    """
    lists = [(w, *p) for t, w in terms if (p := postings[t]) is not None]
    bounds = np.array([w * int(c.max()) for w, _, c in lists], np.int64)
    rest = np.concatenate([np.cumsum(bounds[::-1])[::-1], [0]]) if lists else np.zeros(1, np.int64)
    if not lists or rest[0] < max(bar, 1):
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    score, made, creating, reached = np.zeros(size, np.int64), np.zeros(size, bool), True, 0
    for j, (w, at, c) in enumerate(lists):
        if creating:
            made[at] = True
            score[at] += w * c
        else:
            held = made[at]
            score[at[held]] += w * c[held]
        reached += int(bounds[j])
        if creating and rest[j + 1] < max(bar, reached):  # else no score known so far can be out of reach of a new document
            best = bar
            if rest[j + 1] < reached and (n := np.count_nonzero(made)) >= k:
                best = max(best, int(np.partition(score[made], n - k)[n - k]))
            creating = rest[j + 1] >= best
    rows = np.flatnonzero(made & (score >= max(bar, 1)))
    if len(rows) > k:
        least = np.partition(score[rows], len(rows) - k)[len(rows) - k]
        rows = rows[score[rows] >= least]
    return rows, score[rows], int(np.count_nonzero(made))


def _search(items: list[tuple[int, list[tuple[int, int]]]], ids: dict[bytes, int], n_docs: int, n_terms: int, k: int):
    """Blocks of counted documents to the task's ``k`` best per item."""

    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        docs, sizes, found, tfs, at = [], [], [], [], []

        def flush():
            size = len(docs)
            doc, term = np.array(docs, object), np.array(found, np.int64)
            row, tf = np.repeat(np.arange(size), at), np.array(tfs, np.int64)
            m = np.array([100 - B100 + B100 * n * n_docs // n_terms for n in sizes], np.int64)
            given = SCALE * tf // (1000 * tf + SATURATION * m[row])
            order = np.argsort(term, kind="stable")
            term, row, given = term[order], row[order], given[order]
            cuts = np.searchsorted(term, np.arange(len(ids) + 1))
            postings = [(row[a:b], given[a:b]) if b > a else None for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            for number, (_, terms) in enumerate(items):
                known = best.get(number)
                bar = int(known[0][-1]) if known is not None and len(known[0]) == k else 0
                rows, scores, _ = evaluate(postings, terms, size, bar, k)
                if not len(rows):
                    continue
                who = doc[rows]
                if known is not None:
                    scores, who = np.concatenate([known[0], scores]), np.concatenate([known[1], who])
                order = sorted(range(len(scores)), key=lambda i: (-scores[i], who[i] is None, who[i] or 0))[:k]
                best[number] = scores[order], who[order]
            for x in (docs, sizes, found, tfs, at):
                x.clear()

        for batch in batches:
            for doc, n, terms, counts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "terms", "tfs")), strict=True):
                mine = [(i, c) for t, c in zip(terms, counts, strict=True) if (i := ids.get(t)) is not None]
                if not mine:
                    continue
                docs.append(doc)
                sizes.append(n)
                at.append(len(mine))
                found += [i for i, _ in mine]
                tfs += [c for _, c in mine]
                if len(docs) >= BLOCK or len(found) >= COUNTS:
                    flush()
        if docs:
            flush()
        out = [(items[number][0], d, int(s)) for number, (scores, who) in best.items() for s, d in zip(scores, who, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 3)], names=["item_id", "doc_id", "score"])

    return run


def _top(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each item: first within shards of an item, then of the item."""
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    shard = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS))).orderBy(*best)
    near = hits.withColumn("r", F.row_number().over(shard)).where(F.col("r") <= k)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*best))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(documents: DataFrame, items: DataFrame, k: int = K, bunch: int = BUNCH) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``k`` best documents with a score above 0, ties to the smaller id.

    A null or empty text has no terms: it counts for nothing and is found by
    nothing.  Rows of ``items`` that share an id, null included, are one item
    with all their terms; an item without terms returns no rows.  Rows of
    ``documents`` that repeat an id are documents each, a null id comes after
    the others among equal scores.  Other columns are ignored.  Without
    documents or items there are no rows.
    """
    spark = documents.sparkSession
    asked = written(item_terms(items), "item-terms")
    counted = written(
        documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_count(_bitmap(asked)), _COUNTED), "term-counts"
    )
    totals = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    known = written(asked.join(df, "term"), "item-term-counts")  # terms that no document holds add nothing
    bunches = max(1, -(-known.count() // bunch))
    hits = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(bunches):
        part = known.where(F.pmod(F.xxhash64("item_id", F.lit(bunches)), F.lit(bunches)) == b).collect()
        ids = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in part}))}
        by_item: dict[int | None, list[tuple[int, bytes]]] = {}
        for r in part:
            by_item.setdefault(r["item_id"], []).append((r["df"], bytes(r["term"])))
        plans = [(item, [(ids[t], weight(totals["docs"], d)) for d, t in sorted(terms)]) for item, terms in by_item.items()]
        if plans:
            found = counted.mapInArrow(_search(plans, ids, totals["docs"], totals["terms"], k), _HITS)
            hits = hits.unionByName(written(_top(found, k), "item-hits"))
    return hits
