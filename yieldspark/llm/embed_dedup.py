"""Near-duplicate vectors by spherical-cap filters (operator 5).

A random rotation splits a unit vector into blocks of coordinates; each block
has its own code of random unit vectors.  A filter is one code word of each
block, its direction their concatenation, so the filters are a structured
random product code: a vector's filters with a score of at least ``alpha`` are
decoded from sorted block scores without looking at the others.  Vectors that
share a filter meet there and their cosine is computed in double precision.

Equal vectors of a label are one class and travel once.  The rows of a filter
are read in sorted order, a filter at a time; a filter with many rows is split
into blocks whose pairs are separate groups, so no group grows with the data.
A pair counts in the first filter that both vectors have, so links are counted
without listing them: a group yields one row per vector, with the links it
found and the smallest vector it is connected to there.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_chunks, written
from .components import connected_components

THRESHOLD = 0.98
#: Filters that a vector has on average and at least; vectors per filter that the number of filters follows; rows of a block.
FILTERS, LEAST, PER_FILTER, BLOCK = 10, 6, 8, 512
BLOCKS, SEED = 2, 5


def code_size(vectors: int) -> int:
    """Code words of a block such that a filter gets ``PER_FILTER`` vectors on average, for any number of vectors."""
    return max(8, math.ceil((vectors * FILTERS / PER_FILTER) ** (1 / BLOCKS)))


def product_code(dim: int, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rotation of ``dim`` coordinates and a code of ``size`` unit vectors for each block of them."""
    rng = np.random.default_rng([SEED, dim, size])
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    codes = []
    for part in np.array_split(np.arange(dim), min(BLOCKS, dim)):
        c = rng.standard_normal((size, len(part)))
        codes.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return rotation, codes


def decode(unit: np.ndarray, rotation: np.ndarray, codes: list[np.ndarray]) -> list[np.ndarray]:
    """For each unit vector its filters: all that exceed alpha, the best ``LEAST`` at any rate."""
    dim, size = rotation.shape[0], len(codes[0])
    turned, at, scores = unit @ rotation, 0, []
    for c in codes:
        scores.append(turned[:, at : at + c.shape[1]] @ c.T / math.sqrt(len(codes)))
        at += c.shape[1]
    if len(codes) == 1:
        scores.append(np.zeros((len(unit), 1)))
    total = size * scores[1].shape[1]
    alpha = NormalDist().inv_cdf(1 - min(0.5, FILTERS / total)) / math.sqrt(dim)
    a, b = scores
    order_a, order_b = np.argsort(-a, axis=1), np.argsort(-b, axis=1)
    out = []
    for i in range(len(unit)):
        oa, ob = order_a[i], order_b[i]
        sa, sb = a[i, oa], b[i, ob]
        n = int(np.searchsorted(-sa, -(alpha - sb[0]), side="right"))  # code words that reach alpha with the best partner
        ends = np.searchsorted(-sb, -(alpha - sa[:n]), side="right")
        got = [oa[j] * b.shape[1] + ob[: ends[j]] for j in range(n)]
        found = np.concatenate(got) if got else np.empty(0, np.int64)
        if len(found) < LEAST:  # the best sums lie where both ranks are small
            k, m = min(LEAST, len(sa)), min(LEAST, len(sb))
            sums = (sa[:k, None] + sb[None, :m]).ravel()
            best = np.argsort(-sums, kind="stable")[:LEAST]
            found = np.union1d(found, oa[best // m] * b.shape[1] + ob[best % m])
        out.append(np.sort(found))
    return out


def _filters(size: int):
    def run(batches):
        made: dict[int, tuple] = {}
        for batch in batches:
            rows = list(text_chunks(batch, ["rep", "embedding"]))
            out: dict[int, list[int]] = {}
            for dim in {len(v) for _, v in rows}:
                ids = [i for i, (_, v) in enumerate(rows) if len(v) == dim]
                x = np.array([rows[i][1] for i in ids], np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                if dim not in made:
                    made[dim] = product_code(dim, size)
                out |= dict(zip(ids, decode(x, *made[dim]), strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([out[i] for i in range(len(rows))], pa.list_(pa.int64()))], names=["rep", "filters"]
            )

    return run


def _group_rows(keys: tuple, rows: list[tuple], threshold: float):
    """Links of one group. Rows: rep, n, block, embedding, filters."""
    _, _, own, first, second = keys
    x = np.array([r[3] for r in rows], np.float64)
    block = np.array([r[2] for r in rows])
    norm = np.linalg.norm(x, axis=1)
    link = (x @ x.T) / (norm[:, None] * norm[None, :]) >= threshold
    link &= (block[:, None] != block[None, :]) if first != second else True
    np.fill_diagonal(link, False)
    if not link.any():
        return []
    touched = np.flatnonzero(link.any(axis=1))
    link = link[np.ix_(touched, touched)]
    earlier = [r[4][r[4] < own] for r in (rows[i] for i in touched)]
    names = np.unique(np.concatenate(earlier))
    fresh = link
    if len(names):
        has = np.zeros((len(touched), len(names)), np.float32)
        for i, e in enumerate(earlier):
            has[i, np.searchsorted(names, e)] = 1
        fresh = link & (has @ has.T == 0)
    weight = np.array([rows[i][1] for i in touched], np.int64)
    reps = np.array([rows[i][0] for i in touched], np.int64)
    root = reps.copy()
    while True:
        least = np.minimum(root, np.where(link, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (least == root).all():
            break
        root = least
    counts = (fresh * weight[None, :]).sum(axis=1)
    return zip(reps.tolist(), counts.tolist(), root.tolist(), strict=True)


def _groups(threshold: float):
    names = ["label", "dim", "filter", "first", "second"]

    def run(batches):
        key, rows = None, []
        for batch in batches:
            out = []
            for *k, rep, n, block, vector, filters in text_chunks(batch, [*names, "rep", "n", "block", "embedding", "filters"]):
                if k != key:
                    if len(rows) > 1:
                        out += _group_rows(key, rows, threshold)
                    key, rows = k, []
                rows.append((rep, n, block, vector, np.array(filters, np.int64)))
            yield _found(out)
        yield _found(list(_group_rows(key, rows, threshold)) if len(rows) > 1 else [])

    return run


def _found(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 3)], names=["rep", "n_found", "root"])


def _usable() -> Column:
    """A label and a vector that has only finite components and isn't zero."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & (norm > 0)
    return F.coalesce(good, F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row.

    Vectors with a null label, null, zero, or with a null or non-finite
    component link with nothing and are kept; vectors of different dimensions
    don't link.  Rows that repeat an id are vectors of their own that share
    its component; a null id links with nothing and has a null component.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding").withColumn("good", _usable())
    member = rows.where("good").select("vec_id", "label", F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: (x + 0.0).cast("string"))), 256).alias("digest"), "embedding")
    classes = written(member.groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding")), "vector-classes")
    filters = written(classes.select("rep", "embedding").mapInArrow(_filters(code_size(classes.count())), "rep long, filters array<long>"), "vector-filters")
    alone, rows = rows, classes.join(filters, "rep").select("label", F.size("embedding").alias("dim"), "rep", "n", "embedding", "filters").withColumn("filter", F.explode("filters"))
    full = rows.groupBy("label", "dim", "filter").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK)
    rows = rows.join(full, ["label", "dim", "filter"], "left").withColumn("blocks", F.coalesce(F.ceil(F.col("m") / BLOCK), F.lit(1)).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pair = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least("block", k).alias("first"), F.greatest("block", k).alias("second")),
    )
    dealt = rows.withColumn("p", F.explode(pair)).select("label", "dim", "filter", "p.first", "p.second", "rep", "n", "block", "embedding", "filters")
    keys = ["label", "dim", "filter", "first", "second"]
    found = written(
        dealt.repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(_groups(threshold), "rep long, n_found long, root long"), "vector-links"
    )
    links = found.groupBy("rep").agg(F.sum("n_found").alias("n_found"))
    components = connected_components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per_class = (
        classes.select("label", "digest", "rep", F.col("n").alias("copies"))
        .join(links, "rep", "left")
        .join(components.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("label", "digest", (F.coalesce("n_found", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = member.drop("embedding").join(per_class, ["label", "digest"]).select("vec_id", "n_links", "component_id")
    alone = alone.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

