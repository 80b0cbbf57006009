"""Quality classifier: ordinal cumulative-link regression on graded ratings (operator 8).

A document has one score, the sum of shared weights of its hashed words
(present or not), of their first characters, the shapes of its words (by frequency) and of a few
binned measures.  Ordered thresholds cut the score into grades:
``P(grade <= j) = logistic(threshold_j - score)``.  The expected grade and the
tail ``P(grade >= j)`` follow; documents are selected by the tail.

The model is fitted on a bounded sample of the rated documents (``SAMPLE``, by
the hash of the id), split into ``SHARDS`` parts that are fitted side by side;
their weights are averaged.  Scoring reads every document whole, in one pass.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hand_back, keep_only, text_chunks

#: Rated documents used for fitting at most; parts fitted side by side; hash buckets; documents of a part that a bucket needs.
SAMPLE, SHARDS, BUCKETS, LEAST_DOCS = 20_000, 2, 2**18, 5
#: A bucket takes part if its mean differs by so many standard errors between the top grade and the others.
SCREEN = 4.0
#: Leading characters of a word that count besides the whole; what the share of a shape is multiplied by.
PREFIX, SHAPE_SCALE = 5, 8.0
GRADES = 3
#: A document stays if it has the top grade with at least this probability.
KEEP = 0.5
#: Bytes that a table of words may hold; it lives as long as its task.
TABLE_BYTES = 32 << 20
_SHAPE = str.maketrans({**dict.fromkeys(map(chr, range(ord("a"), ord("z") + 1)), "a"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"), **dict.fromkeys("0123456789", "9")})
_PUNCTUATION = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def grades(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)``: 0 toxic, 1 low quality, 2 good; rows with both ratings null, or a null where the other is good, are left out."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") <= 0, 1).when((F.col("quality") > 0) & (F.col("toxic") <= 0), 2)
    return labels.select(F.col("doc_id").cast("long"), grade.alias("grade")).where("doc_id is not null and grade is not null")


def _bucket(kind: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}\0{text}") % BUCKETS


def _shape(word: str) -> str:
    """Runs of letters and digits by class, other characters as they are; at most eight signs."""
    out = ""
    for c in word[:64].translate(_SHAPE):
        if c not in "aA9" and c.isalpha():
            c = "A" if c.isupper() else "a"
        if not out or out[-1] != c:
            out += c
    return out[:8]


def _measures(text: str, words: list[str], distinct: int) -> list[str]:
    lines = [x for x in text.split("\n") if x]
    n = max(1, len(words))
    return [
        f"words {min(20, len(words).bit_length())}",
        f"distinct {min(10, 10 * distinct // n)} {min(14, len(words).bit_length())}",
        f"letters {min(20, len(text) // n)}",
        f"lines {10 * len(set(lines)) // max(1, len(lines))} {min(8, len(lines).bit_length())}",
    ]


def _buckets(word: str) -> tuple[int, int, int]:
    """Buckets of a word, of its first characters and of its shape."""
    plain = word.strip(_PUNCTUATION).lower()
    return _bucket("word", plain), _bucket("start", plain[:PREFIX]), _bucket("shape", _shape(word))


class Features:
    """Buckets of words and shapes, kept in a bounded table."""

    def __init__(self):
        self.table: dict[str, tuple[int, int, int]] = {}
        self.held = 0

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and values of a text: distinct words 1, shapes by share of the words, measures 1."""
        words = text.split()
        if self.held > TABLE_BYTES:
            self.table, self.held = {}, 0
        table = self.table
        once = set(words)
        for w in once:
            if w not in table:
                table[w] = _buckets(w)
                self.held += 360 + 4 * len(w)
        present = {table[w][0] for w in once} | {table[w][1] for w in once}
        shapes = np.fromiter((table[w][2] for w in words), np.int64, len(words))
        s, n = np.unique(shapes, return_counts=True)
        marks = [_bucket("measure", m) for m in _measures(text, words, len(once))]
        at = np.concatenate([np.fromiter(present, np.int64, len(present)), s, np.array(marks, np.int64)])
        return at, np.concatenate([np.ones(len(present)), SHAPE_SCALE * n / max(1, len(words)), np.ones(len(marks))])


def _features(batches):
    keep_only("quality", lambda: None)  # another operator's tables go
    features = Features()
    for batch in batches:
        out = [(g, s, *features.of(t or "")) for _, t, g, s in text_chunks(batch, ["doc_id", "text", "grade", "shard"])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()),
                pa.array([r[2] for r in out], pa.list_(pa.int64())), pa.array([r[3] for r in out], pa.list_(pa.float64())),
            ],
            names=["grade", "shard", "at", "value"],
        )


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_ordinal(
    grade: np.ndarray, row: np.ndarray, at: np.ndarray, value: np.ndarray, size: int, grades: int = GRADES, rounds: int = 200, decay: float = 2e-5
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of a proportional-odds model by full-batch Adam.

    The thresholds are a first one and the logarithms of the gaps after it, so they stay ordered.
    """
    n = len(grade)
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / n, 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    w, cut = np.zeros(size), np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros(size + grades - 1), np.zeros(size + grades - 1)
    for step in range(1, rounds + 1):
        edges = np.concatenate([[-np.inf], np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])])), [np.inf]])
        score = np.bincount(row, w[at] * value, n)
        high, low = _logistic(edges[grade + 1] - score), _logistic(edges[grade] - score)
        p = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high), low * (1 - low)
        ds = (dh - dl) / p / n
        g_w = np.bincount(at, ds[row] * value, size) + decay * w
        g_edge = np.array([-(dh / p)[grade == j].sum() + (dl / p)[grade == j + 1].sum() for j in range(grades - 1)]) / n
        g_cut = np.array([g_edge[j:].sum() * (1 if j == 0 else np.exp(cut[j])) for j in range(grades - 1)])
        g = np.concatenate([g_w, g_cut])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, cut = w - move[:size], cut - move[size:]
    return w, np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])]))


def _fit_part(least: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        keep_only("quality", lambda: None)  # another operator's tables go, and what the features of this worker's documents took
        hand_back()
        grade = part["grade"].to_numpy()
        count = len(part)
        # Each column goes as soon as it lies in one array: this task's peak is an executor's peak.
        sizes = part["at"].map(len).to_numpy()
        at = np.concatenate(part.pop("at").to_list()).astype(np.int32)
        value = np.concatenate(part.pop("value").to_list())
        row = np.repeat(np.arange(count, dtype=np.int32), sizes)
        docs = np.bincount(at, minlength=BUCKETS)
        top = grade == GRADES - 1
        a, b = max(1, top.sum()), max(1, (~top).sum())
        mean = [np.bincount(at, np.where(side[row], value, 0), BUCKETS) / n for side, n in ((top, a), (~top, b))]
        square = np.bincount(at, value * value, BUCKETS) / len(part)
        spread = np.sqrt(np.maximum(square - (np.bincount(at, value, BUCKETS) / len(part)) ** 2, 1e-12) * (1 / a + 1 / b))
        kept = np.flatnonzero((docs >= min(least, max(1, len(part) // 20))) & (np.abs(mean[0] - mean[1]) >= SCREEN * spread))
        place = np.full(BUCKETS, -1)
        place[kept] = np.arange(len(kept))
        use = place[at] >= 0
        w, cuts = fit_ordinal(grade, row[use], place[at[use]], value[use], max(1, len(kept)))
        out = [(int(b), float(x)) for b, x in zip(kept, w, strict=False) if abs(x) > 1e-4]
        return pd.DataFrame([*out, *[(-1 - j, float(c)) for j, c in enumerate(cuts)]], columns=["bucket", "weight"])

    return run


@dataclass
class OrdinalModel:
    """``weights`` by bucket (at most ``BUCKETS``), ordered ``cuts``; without cuts there was nothing to learn from."""

    weights: dict[int, float]
    cuts: list[float]

    def tails(self, score: np.ndarray) -> np.ndarray:
        """``P(grade >= j)`` for j from 1, a column each."""
        return 1 - _logistic(np.array(self.cuts)[None, :] - score[:, None])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, shards: int = SHARDS) -> OrdinalModel:
    """Fit on at most ``sample`` rated documents.

    Without a rated document, or with one grade only, the model has no cuts
    and keeps everything.  The driver gets the averaged weights, at most one
    for each bucket.
    """
    rated = grades(labels).dropDuplicates(["doc_id"]).withColumn("order", F.xxhash64("doc_id", F.lit(8)))
    chosen = rated.orderBy("order", "doc_id").limit(sample)
    taken = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    parts = taken.select("doc_id", "text", "grade", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(shards)).cast("int").alias("shard"))
    fitted = parts.mapInArrow(_features, "grade int, shard int, at array<long>, value array<double>")
    weights = fitted.groupBy("shard").applyInPandas(_fit_part(LEAST_DOCS), "bucket long, weight double")
    rows = weights.groupBy("bucket").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
    n = max([r["n"] for r in rows if r["bucket"] < 0], default=1)
    cuts = sorted((-r["bucket"], r["w"] / n) for r in rows if r["bucket"] < 0)
    return OrdinalModel({r["bucket"]: r["w"] / n for r in rows if r["bucket"] >= 0}, [c for _, c in cuts])


class Scorer:
    """Scores of texts under a model, with the parts of the words met kept in a bounded table."""

    def __init__(self, model: OrdinalModel):
        self.model = model
        self.table: dict[str, tuple[tuple, float]] = {}
        self.held = 0

    def tails(self, texts: list[str | None]) -> np.ndarray:
        """``P(grade >= j)`` of each text, a column for each j from 1; all 1 where the model has no cuts."""
        if not self.model.cuts:
            return np.ones((len(texts), GRADES - 1))
        return self.model.tails(np.array([self._score(t or "") for t in texts]))

    def _score(self, text: str) -> float:
        if self.held > TABLE_BYTES:
            self.table, self.held = {}, 0
        table, get = self.table, self.model.weights.get
        words = text.split()
        once = set(words)
        present: dict[int, float] = {}
        for w in once:
            if (got := table.get(w)) is None:
                a, b, c = _buckets(w)
                got = table[w] = (tuple((k, x) for k in (a, b) if (x := get(k))), get(c, 0.0))
                self.held += 360 + 4 * len(w)
            if got[0]:
                present.update(got[0])
        shapes = SHAPE_SCALE * sum([table[w][1] for w in words]) / max(1, len(words))
        marks = sum(get(_bucket("measure", m), 0.0) for m in _measures(text, words, len(once)))
        return sum(present.values()) + shapes + marks


def _grades(model: OrdinalModel, keep: float):
    def run(batches):
        keep_only("quality", lambda: None)  # another operator's tables go
        scorer = Scorer(model)
        for batch in batches:
            tails = scorer.tails(batch.column("text").to_pylist())
            columns = [batch.column("doc_id"), pa.array(tails.sum(axis=1), pa.float64())]
            columns += [pa.array(tails[:, j], pa.float64()) for j in range(GRADES - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(tails[:, -1] >= keep, pa.bool_())], names=["doc_id", "expected_grade", "p_ge_1", "p_ge_2", "kept"])

    return run


def grade_documents(docs: DataFrame, labels: DataFrame, keep: float = KEEP, model: OrdinalModel | None = None) -> DataFrame:
    """``(doc_id, expected_grade, p_ge_1, p_ge_2, kept)`` per row.

    A null text is scored as an empty one.  Null and repeated ids are scored
    row by row; other columns are ignored; an empty table gives no rows.
    """
    model = model or fit(docs, labels)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _grades(model, keep), "doc_id long, expected_grade double, p_ge_1 double, p_ge_2 double, kept boolean"
    )


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns; one pass, no shuffle."""
    model = fit(docs, labels)
    fields, text_at = docs.schema, next(c for c in docs.columns if c.lower() == "text")

    def run(batches: Iterable[pa.RecordBatch]):
        keep_only("quality", lambda: None)  # another operator's tables go
        scorer = Scorer(model)
        for batch in batches:
            tails = scorer.tails(batch.column(batch.schema.get_field_index(text_at)).to_pylist())
            yield batch.filter(pa.array(tails[:, -1] >= keep))

    return docs.mapInArrow(run, fields)
