"""Exact top-k inner products without random access (operator 2).

Candidates are dealt into blocks of bounded size.  A block has a list of its
rows for every coordinate.  A query reads the lists of a block a few at a time,
those first that can add most, and of each list only the entries of the rows
still alive.  A row's score then lies between what was read plus the least,
and plus the most, that its unread entries can add: at most the extremes of
those lists among the rows alive, and at most the product of the unread parts'
lengths.  A row whose upper bound is below the k-th best lower bound known so
far is an outsider and is read no further.  When few rows are left, or all
lists are read, their scores are resolved.

The k-th best bound is shared: a first pass searches one block for each query,
and its k-th best score is the bar with which the query enters every block.
Each block gives a query's best k; the results merge on the query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K = 5
#: Rows of a block of candidates, and queries of a bunch that meet it together.
BLOCK, QUERIES = 4096, 4096
#: Lists that are read between two looks at the bounds; rows left, as a multiple of k, that are resolved at once.
STEP, RESOLVE = 6, 4
#: Below this, sums of whole numbers are exact as doubles.
EXACT = 2**53
_RESULT = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``(vec_id, v)`` with ``floor(scale * x)`` of every component; unusable vectors are left out, one too large for a long is an error."""
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    v = F.transform(
        "embedding",
        lambda x: F.when(F.abs(scaled(x)) < 2.0**62, F.floor(scaled(x))).otherwise(F.raise_error(F.lit("a component of a vector is too large")).cast("long")),
    )
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").where("vec_id is not null and embedding is not null")
    return rows.where(~F.coalesce(bad, F.lit(False))).select("vec_id", v.alias("v"))


def _scores(rows: np.ndarray, query: np.ndarray) -> list[int]:
    """Inner products as whole numbers; those beyond long are an error."""
    if float(np.abs(rows).max(initial=0)) * float(np.abs(query).sum()) < EXACT:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64).tolist()
    out = (rows.astype(object) @ query.astype(object)).tolist()
    if any(abs(s) >= 2**63 for s in out):
        raise OverflowError("a score is too large for a long")
    return out


class Block:
    """The lists of a block of rows of one dimension."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        self.rows, self.ids = rows, ids
        self.lists = np.ascontiguousarray(rows.T, dtype=np.float64)  # one contiguous list for each coordinate
        self.low, self.high = self.lists.min(axis=1), self.lists.max(axis=1)
        self.energy = (self.lists * self.lists).sum(axis=0)
        self.cells_read = self.cells = 0

    def search(self, query: np.ndarray, own: int, k: int, bar: float = -np.inf) -> list[tuple[int, int]]:
        """``(vec_id, score)`` of the query's ``k`` best rows but its own with a score of at least ``bar``, ties to smaller ids."""
        q = query.astype(np.float64)
        order = np.argsort(-np.abs(q) * (self.high - self.low), kind="stable")
        unread = float(q @ q)
        # Bounds are doubles; this covers their rounding, and is below 1 wherever scores are exact as doubles.
        slack = 1e-12 * float(np.sqrt(unread * self.energy.max(initial=0.0))) + 1e-6
        alive = np.flatnonzero(self.ids != own)
        part, energy = np.zeros(len(alive)), self.energy[alive]
        self.cells += self.lists.size
        for at in range(0, len(order), STEP):
            if len(alive) <= RESOLVE * k:
                break
            now, rest = order[at : at + STEP], order[at + STEP :]
            read = self.lists[np.ix_(now, alive)]
            self.cells_read += read.size
            part += q[now] @ read
            energy = np.maximum(energy - (read * read).sum(axis=0), 0.0)
            unread = max(unread - float(q[now] @ q[now]), 0.0)
            if len(rest):
                # The ends of the unread lists: each row adds at most what its list's best end adds.
                ends = np.sort(np.stack([q[rest] * self.low[rest], q[rest] * self.high[rest]]), axis=0).sum(axis=1)
                by_length = np.sqrt(unread * energy)
                lower, upper = part + np.maximum(ends[0], -by_length), part + np.minimum(ends[1], by_length)
            else:
                lower = upper = part
            if len(alive) > k:
                bar = max(bar, float(np.partition(lower, len(lower) - k)[len(lower) - k]))
            stay = upper + slack >= bar - slack
            alive, part, energy = alive[stay], part[stay], energy[stay]
        found = zip(_scores(self.rows[alive], query), self.ids[alive].tolist(), strict=True)
        best = sorted((-s, i) for s, i in found)[:k]
        self.cells_read += len(alive) * len(order)
        return [(i, -s) for s, i in best]


def _search(k: int):
    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        sizes = rows["v"].map(len).to_numpy()
        q_sizes = queries["v"].map(len).to_numpy()
        for dim in np.intersect1d(sizes, q_sizes):
            if len(rows) and dim:
                own, ask = rows[sizes == dim], queries[q_sizes == dim]
                block = Block(np.array(own["v"].to_list(), np.int64), own["vec_id"].to_numpy(np.int64))
                for query_id, v, bar in zip(ask["vec_id"], ask["v"], ask["bar"], strict=True):
                    bar = -np.inf if bar is None or np.isnan(bar) else float(bar)
                    out += [(query_id, i, s) for i, s in block.search(np.array(v, np.int64), query_id, k, bar)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` best rows of ``vectors`` that have another id.

    Both tables are ``(vec_id, v)`` as :func:`quantized` gives them.  Ties go
    to the smaller id.  Repeated rows of ``vectors`` are candidates each; a
    query id counts once.  Vectors of other dimensions than the query's are no
    candidates, nor are empty ones.  An empty table on either side gives no
    rows.  A score beyond long is an error.
    """
    asked = written(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, -(-vectors.count() // block))
    bunches = max(1, -(-asked.count() // QUERIES))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = vectors.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
    # First pass: one block for each query.  Only with k scores there is a bar.
    first = asked.withColumn("bar", F.lit(None).cast("double")).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)))
    near = first.groupBy("block").cogroup(rows.groupBy("block")).applyInPandas(_search(k), _RESULT)
    bars = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("bar")).where(F.col("n") >= k)
    asked = asked.join(bars.select(F.col("query_id").alias("vec_id"), F.col("bar").cast("double").alias("bar")), "vec_id", "left")
    ask = asked.withColumn("bunch", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(bunches))).withColumn("block", each(blocks))
    dealt = rows.withColumn("bunch", each(bunches))
    found = ask.groupBy("block", "bunch").cogroup(dealt.groupBy("block", "bunch")).applyInPandas(_search(k), _RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
