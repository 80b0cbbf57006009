"""Embedding whitening (operator 12).

Every entry c of a usable vector becomes ``x = floor(256 * c)``.  The fit list
is each distinct x vector once.  Tasks add up its n vectors and their sums S
exactly, then the scatter of the centred vectors ``(n * x - S) / n``, whose
numerators are whole numbers, so centring rounds once.  The partial scatters
are added per entry.

The d x d scatter is factored by a Cholesky decomposition that takes the
largest remaining diagonal entry as its next pivot, and stops at the numerical
rank.  One-sided Jacobi then rotates the columns of that triangular factor
against each other until all are orthogonal: the scatter is the factor times
its transpose, so the squared column norms are its eigenvalues and the
normalised columns its eigenvectors, without forming the scatter again.  The
driver holds numbers of the order of d x d only, never rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Factor of the entries; components that are returned; distinct vector lengths that one table may hold.
QUANTUM, COMPONENTS, LENGTHS = 256, 4, 16
#: Columns whose cosine is at most this are orthogonal; sweeps at most.
ORTHOGONAL, SWEEPS = 1e-15, 60
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def quantized(vectors: DataFrame) -> DataFrame:
    """``(vec_id, x)`` of the usable vectors; an entry whose x is no long raises an error."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = lambda c: F.lit(float(QUANTUM)) * c.cast("double")
    x = F.transform(
        "embedding",
        lambda c: F.when(F.abs(scaled(c)) < 2.0**62, F.floor(scaled(c))).otherwise(F.raise_error(F.lit("an entry of a vector is too large for a long")).cast("long")),
    )
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").where("embedding is not null")
    return rows.where(~F.coalesce(bad, F.lit(False))).select("vec_id", x.alias("x"))


def _matrices(batch: pa.RecordBatch):
    """The x vectors of a batch as one matrix per length, with their places in the batch."""
    column = batch.column("x")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), at, flat[(ends[at] - d)[:, None] + np.arange(d)[None, :]] if d else np.empty((len(at), 0), np.int64)


def _sums(batches):
    """Whole sums per entry, in two parts that can't overflow: ``(dim, entry, rows, high, low)``."""
    total: dict[int, list] = {}
    for batch in batches:
        for d, _, x in _matrices(batch):
            t = total.setdefault(d, [0, np.zeros(d, np.int64), np.zeros(d, np.int64)])
            t[0] += len(x)
            t[1] += (x >> 31).sum(axis=0)
            t[2] += (x & 0x7FFFFFFF).sum(axis=0)
    rows = [(d, j, n, int(h), int(low)) for d, (n, high, lows) in total.items() for j, (h, low) in enumerate(zip(high, lows, strict=True))]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names=["dim", "entry", "rows", "high", "low"])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``: long where that can't overflow, else Python's whole numbers."""
    wide = x.size and int(np.abs(x).max()) * n + max(map(abs, sums), default=0) >= 2**62
    return x.astype(object) * n - np.array(sums, object) if wide else x * np.int64(n) - np.array(sums, np.int64)


def _scatter(fits: dict[int, tuple[int, list[int]]]):
    """The upper triangle of the task's part of the scatter: ``(dim, row, entry, value)``."""

    def run(batches):
        total = {d: np.zeros((d, d)) for d in fits}
        for batch in batches:
            for d, _, x in _matrices(batch):
                if d:
                    n, sums = fits[d]
                    y = _deviations(x, n, sums).astype(np.float64) / n
                    total[d] += y.T @ y
        parts = [(np.full(len(i), d), i, j, s[i, j]) for d, s in total.items() for i, j in [np.triu_indices(d)]]
        columns = [np.concatenate([p[k] for p in parts]) for k in range(4)] if parts else [[]] * 4
        types = [pa.int64()] * 3 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["dim", "row", "entry", "value"])

    return run


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """``L`` of d rows and rank(a) columns with ``L @ L.T == a``: every step takes the largest diagonal entry that is left.

    In the order of the pivots L is lower triangular; its rows are returned in
    the order of ``a``.
    """
    d = len(a)
    left, order = a.diagonal().astype(np.float64).copy(), np.arange(d)
    out = np.zeros((d, d))
    least = d * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(left[order[k:]]))
        if left[order[p]] <= least:
            return out[:, :k]
        order[[k, p]] = order[[p, k]]
        row, rest = order[k], order[k + 1 :]
        out[row, k] = np.sqrt(left[row])
        out[rest, k] = (a[rest, row] - out[rest, :k] @ out[row, :k]) / out[row, k]
        left[rest] -= out[rest, k] ** 2
    return out


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """The factor's columns, rotated in pairs until all are orthogonal, longest first.

    A sweep meets every pair once, in rounds of disjoint pairs (as in a
    tournament), so a round is one rotation of whole arrays.
    """
    d, r = factor.shape
    if r < 2:
        return factor.copy()
    m = np.zeros((d, r + r % 2))  # an odd number of columns gets one of zeros
    m[:, :r] = factor
    half, seats = m.shape[1] // 2, np.arange(m.shape[1])
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(m.shape[1] - 1):
            i, j = seats[:half], seats[half:][::-1]
            x, y = m[:, i], m[:, j]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(a * b)
            off = np.divide(np.abs(c), size, out=np.zeros_like(c), where=size > 0)
            worst = max(worst, float(off.max()))
            turn = off > ORTHOGONAL
            zeta = np.divide(b - a, 2 * c, out=np.zeros_like(c), where=turn)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            cos = 1 / np.hypot(1.0, t)
            m[:, i], m[:, j] = cos * (x - t * y), cos * (t * x + y)
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst <= ORTHOGONAL * 8:
            break
    norms = (m * m).sum(0)
    return m[:, np.argsort(-norms, kind="stable")[:r]]


def principal(scatter: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues of ``scatter / n`` by falling size up to its rank, their unit eigenvectors as columns, and its trace."""
    columns = one_sided_jacobi(pivoted_cholesky(scatter))
    norms = np.sqrt((columns * columns).sum(0))
    return norms**2 / n, columns / norms, float(np.trace(scatter)) / n


def _project(fits: dict[int, tuple[int, list[int]]], models: dict[int, tuple], errors: dict[int, float | None]):
    """Rows ``(vec_id, component, n, deviation, whitened, explained, identity_error)`` of quantized vectors."""

    def run(batches):
        for batch in batches:
            ids, parts = batch.column("vec_id").to_pylist(), []
            for d, at, x in _matrices(batch):
                n, sums = fits[d]
                values, vectors, trace = models[d]
                dev = _deviations(x, n, sums)
                whole = dev if dev.dtype == object or not dev.size or d * float(np.abs(dev).max()) ** 2 < 2**62 else dev.astype(object)
                square = [s if s < 2**63 else None for s in (whole * whole).sum(axis=1).tolist()]
                y = dev.astype(np.float64) / n
                for c in range(min(COMPONENTS, d)):
                    known = c < len(values)
                    w = (y @ vectors[:, c] / np.sqrt(values[c])).tolist() if known else [None] * len(at)
                    share = float(values[c] / trace) if known else 0.0 if trace else None
                    parts += [(ids[i], c + 1, n, s, v, share, errors.get(d)) for i, s, v in zip(at.tolist(), square, w, strict=True)]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in parts], t) for i, t in enumerate(types)], names=[f.split()[0] for f in _OUT.split(", ")])

    return run


def _identity_errors(white: DataFrame, models: dict[int, tuple]) -> dict[int, float | None]:
    """By vector length, the largest distance of the whitened fit list's covariance from the identity.

    ``covar_pop`` centres before it multiplies and merges partial results.
    """
    names = [f"w{c}" for c in range(1, COMPONENTS + 1)]
    pairs = [(i, j) for i in range(COMPONENTS) for j in range(i, COMPONENTS)]
    found = white.groupBy("dim").agg(*[F.covar_pop(names[i], names[j]).alias(f"c{i}{j}") for i, j in pairs])
    out: dict[int, float | None] = {}
    for r in found.collect():  # one row per vector length
        known = len(models[r["dim"]][0])
        off = [abs(r[f"c{i}{j}"] - (i == j)) for i, j in pairs if j < known]
        out[r["dim"]] = max(off, default=None)
    return out


def _white_columns(fits: dict[int, tuple[int, list[int]]], models: dict[int, tuple]):
    def run(batches):
        for batch in batches:
            n_rows = batch.num_rows
            dims, out = np.zeros(n_rows, np.int64), np.zeros((COMPONENTS, n_rows))
            for d, at, x in _matrices(batch):
                n, sums = fits[d]
                values, vectors, _ = models[d]
                dims[at] = d
                k = min(COMPONENTS, len(values))
                out[:k, at] = ((_deviations(x, n, sums).astype(np.float64) / n) @ vectors[:, :k] / np.sqrt(values[:k])).T
            yield pa.RecordBatch.from_arrays([pa.array(dims), *map(pa.array, out)], names=["dim", *[f"w{c}" for c in range(1, COMPONENTS + 1)]])

    return run


def whitened(vectors: DataFrame) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``, up to four components for each usable vector.

    Vectors that are null or hold null or non-finite entries are left out.
    Repeated rows are rows each but count once in the fit list; a null id stays
    null.  Vectors of different lengths are fitted apart, up to ``LENGTHS``
    lengths (more raise a ValueError); an empty vector has no components.
    Where the list has fewer directions than components (one distinct vector,
    say), ``whitened`` of the others is null and ``explained`` 0, or null
    where nothing varies at all; ``identity_error`` covers the components that
    exist, null if none does.  A ``deviation`` beyond long is null.  Other
    columns are ignored; an empty table gives no rows.
    """
    rows = written(quantized(vectors), "quantized")
    fit = written(rows.select("x").distinct(), "fit-list")
    sums = fit.mapInArrow(_sums, "dim long, entry long, rows long, high long, low long").groupBy("dim", "entry")
    parts = sums.agg(F.sum("rows").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    if parts.select("dim").distinct().count() > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    fits: dict[int, tuple[int, list[int]]] = {}
    for r in parts.orderBy("dim", "entry").collect():  # one row per entry of a vector
        fits.setdefault(r["dim"], (r["n"], []))[1].append((int(r["high"]) << 31) + int(r["low"]))
    fits[0] = (0, [])
    cells = fit.mapInArrow(_scatter(fits), "dim long, row long, entry long, value double").groupBy("dim", "row", "entry").agg(F.sum("value").alias("value"))
    scatter = {d: np.zeros((d, d)) for d in fits}
    for r in cells.collect():  # d * (d + 1) / 2 numbers
        scatter[r["dim"]][r["row"], r["entry"]] = scatter[r["dim"]][r["entry"], r["row"]] = r["value"]
    models = {d: principal(s, fits[d][0]) for d, s in scatter.items() if d}
    models[0] = (np.empty(0), np.empty((0, 0)), 0.0)
    columns = "dim long, " + ", ".join(f"w{c} double" for c in range(1, COMPONENTS + 1))
    errors = _identity_errors(fit.mapInArrow(_white_columns(fits, models), columns), models)
    return rows.mapInArrow(_project(fits, models, errors), _OUT)
