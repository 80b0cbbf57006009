"""Shared helpers of the operators: table reading, lineage cuts, batches, byte tables."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir, scratch_path

#: Rows and bytes of one Arrow batch, whichever is reached first; one row is never cut.
ROWS_PER_BATCH, BYTES_PER_BATCH = 1000, 16 << 20

_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the operators; ships the package to the Python workers once per application."""
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        target = os.path.join(tempfile.mkdtemp(prefix="yieldspark-py-"), f"{root.name}.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(target)
        _SHIPPED.add(app)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(frame: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared checkpoint folder and read back."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def fresh(taken: list[str], wish: str) -> str:
    """A column name that clashes with none of ``taken`` (names compare without case)."""
    low, name = {t.lower() for t in taken}, wish
    while name.lower() in low:
        name = f"_{name}"
    return name


_TABLES: list[tuple[str, Callable[[], None]]] = []


def hand_back() -> None:
    """Give freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def keep_only(owner: str, drop: Callable[[], None]) -> None:
    """Called in a worker by an operator that keeps tables between tasks: drops those of the operator that ran there before."""
    if _TABLES and _TABLES[0][0] != owner:
        _TABLES.pop()[1]()
        hand_back()
    if not _TABLES:
        _TABLES.append((owner, drop))


def text_chunks(batch, columns: list[str]) -> Iterator[tuple]:
    """Rows of an Arrow batch as Python tuples in the order of ``columns``."""
    return zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


def byte_characters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies.

    A byte that prints as itself in Latin-1 keeps its character; the others
    take the code points from 256 on, in order.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
