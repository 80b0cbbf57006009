"""N-gram Jaccard join with set-relation skipping (operator 7).

Every document is the set of its distinct word shingles, ordered by one order
of all shingles: rare first, by the counts of all documents' shingles in a
fixed number of buckets.  Two sets link when their Jaccard similarity reaches the
threshold; a linked pair shares a shingle of both sets' prefixes.

* Equal sets are one class; only its smallest document takes part.
* The index has a list of ``(set, size, position)`` for every prefix shingle.
  Within a list, of the sets of like size the one with most company in all its
  lists leads; each set is compared with the leader it shares most lists with.
* Sets linked by then are related, so the answers of one are derived from the
  other's.  Lists whose sets are all related are skipped.  The others are read
  by blocks of like size and position; a pair of blocks is skipped when all
  its sets are related or when positions and sizes rule the threshold out.
* A remaining pair is answered from its leaders' distance where the triangle
  inequality decides (the Jaccard distance is a metric); else both sets are
  compared.  No link between different components is lost; pairs inside a
  component need no answer.

Parity bitmaps bound a pair's difference from below and save most comparisons.
Shingles are 64-bit hashes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, keep_only, text_chunks, written
from .components import connected_components

#: Buckets of the shingle counts (fixed, so their size is bounded), slices in which they are added up, 64-bit words of a parity bitmap.
BUCKETS, SLICES, WORDS64 = 2**22, 1024, 16
#: Bits of the map of documents whose sets are compared, which saves reading the others (fixed as well).
WANTED = 2**24
#: Bytes that a worker's table of word hashes may hold.
TABLE_BYTES = 32 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    held = 0

    def __missing__(self, word: bytes) -> int:
        self.held += 180 + len(word)
        if self.held > TABLE_BYTES:
            self.clear()
            self.held = 180 + len(word)
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_TABLE = _Words()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's ``n``-word shingles; of all words as one shingle if there are fewer."""
    words = (text or "").encode().lower().split()  # bytes: lowers A-Z only and splits at the six ASCII blanks
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_TABLE.__getitem__, words), np.uint64, len(words))
    k = min(n, len(w))
    out = np.full(len(w) - k + 1, np.uint64(k))
    for j in range(k):
        out = (out ^ w[j : len(w) - k + 1 + j]) * _M1
        out ^= out >> np.uint64(29)
    out *= _M2
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _count_buckets(n: int):
    def run(batches):
        keep_only("setjoin", _TABLE.clear)
        counts = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for (text,) in text_chunks(batch, ["text"]):
                s = shingles(text, n)
                np.add.at(counts, (s & np.uint64(BUCKETS - 1)).astype(np.int64), np.uint32(1))
        parts = [(i, zlib.compress(x.tobytes(), 1)) for i, x in enumerate(np.split(counts, SLICES)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.binary())], names=["slice", "counts"])

    return run


def _add_slices(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BUCKETS // SLICES, np.uint64)
    for raw in parts["counts"]:
        total += np.frombuffer(zlib.decompress(raw), np.uint32)
    return pd.DataFrame({"slice": [key[0]], "counts": [zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)]})


def bucket_counts(docs: DataFrame, n: int) -> np.ndarray:
    """How many documents' shingles each bucket holds, over all documents: one array of ``BUCKETS`` numbers.

    Every task counts into an array of that size and hands it on in slices.
    """
    parts = docs.select(F.col("text").cast("string")).mapInArrow(_count_buckets(n), "slice long, counts binary")
    counts = np.zeros((SLICES, BUCKETS // SLICES), np.uint32)
    for r in parts.groupBy("slice").applyInPandas(_add_slices, "slice long, counts binary").collect():
        counts[r["slice"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return counts.ravel()


def prefix_size(n: int, percent: int) -> int:
    """Shingles of a set of ``n``, one of which any set with that similarity shares."""
    return n + (-(percent * n) // 100) + 1


def size_limits(percent: int) -> np.ndarray:
    """Least sizes of the size classes: a set links only with sets of its own class and those beside it.

    A class ends where a set that links with its first one still fits, in whole numbers.
    """
    limits = [1]
    while limits[-1] < 2**40:
        limits.append(100 * limits[-1] // percent + 1)
    return np.array(limits, np.int64)


_PROFILE = "uid long, doc_id long, n_shingles long, digest binary, bitmap array<long>, size_class int, prefix array<long>"


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes()) + struct.pack("<I", len(s) & 0xFFFFFFFF)


def _profiles(n: int, percent: int, counts):
    def run(batches):
        keep_only("setjoin", _TABLE.clear)
        level, limits = counts.value, size_limits(percent)
        for batch in batches:
            out = []
            for uid, doc, text in text_chunks(batch, ["uid", "doc_id", "text"]):
                s = shingles(text, n)
                if doc is None or not len(s):
                    out.append((uid, doc, len(s), None, None, None, None))
                    continue
                bits = np.bincount((s >> np.uint64(40)).astype(np.int64) & (64 * WORDS64 - 1), minlength=64 * WORDS64) & 1
                order = np.lexsort((s, level[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]))
                out.append((
                    uid, doc, len(s), _digest(s),
                    np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64),
                    int(np.searchsorted(limits, len(s), side="right")),
                    s[order[: prefix_size(len(s), percent)]].view(np.int64),
                ))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)],
                names=[c.split()[0] for c in _PROFILE.split(", ")],
            )

    return run


def _sets(n: int, wanted):
    """Sets of the rows whose place is in the map, by document and digest; repeated rows once a task."""

    def run(batches):
        keep_only("setjoin", _TABLE.clear)
        places, seen = wanted.value, set()
        for batch in batches:
            out = []
            use = places[batch.column(batch.schema.get_field_index("place")).to_numpy(zero_copy_only=False)]
            for doc, text in text_chunks(batch.filter(pa.array(use)), ["doc_id", "text"]):
                s = shingles(text, n)
                if len(s) and (key := (doc, _digest(s))) not in seen:
                    seen.add(key)
                    out.append((*key, s.view(np.int64)))
            types = [pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["doc_id", "digest", "items"])

    return run


def _place(doc_id):
    return F.pmod(F.xxhash64(doc_id, F.lit(7)), F.lit(WANTED))


class JaccardJoin:
    """One join: ``classes()`` gives each document's component."""

    def __init__(self, docs: DataFrame, n: int, percent: int):
        self.n, self.percent = n, percent
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    # -- conditions on pairs (x, y) --------------------------------------------------
    def _needed(self, x, y):
        """Least intersection of two sets that link, as a double: t / (1 + t) * (|x| + |y|)."""
        return (x + y) * F.lit(self.percent / (100.0 + self.percent)) - F.lit(1e-9)

    def _links(self, inter, x, y):
        return 100 * inter >= self.percent * (x + y - inter)

    def _verified(self, pairs: DataFrame, label: str) -> DataFrame:
        """Pairs ``(a, b)`` of class ids with their sizes and their intersection.

        The texts are read again, but only the wanted documents' sets are made
        and dealt out; those are known by a map of fixed size.  A pair names
        both documents, so the sets move straight to their documents, once for
        both sides, and then one side of each pair to the other.
        """
        who = self.rows.select("uid", "doc_id", "digest")
        ids = pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).distinct()
        ids = written(who.join(ids, "uid", "left_semi"), "pair-ids")
        wanted = np.zeros(WANTED, bool)
        place = _place("doc_id")
        word = F.floor(place / 64).alias("w")
        for r in ids.groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id, 7), {WANTED}) % 64 as int))")).alias("bits")).toLocalIterator():
            bits = r["bits"] & (2**64 - 1)
            wanted[64 * r["w"] + np.flatnonzero([bits >> i & 1 for i in range(64)])] = True
        sets = self.docs.select("doc_id", "text", place.alias("place")).mapInArrow(
            _sets(self.n, self.spark.sparkContext.broadcast(wanted)), "doc_id long, digest binary, items array<long>"
        )
        end = lambda k: ids.select(F.col("uid").alias(k), F.col("doc_id").alias(f"doc_{k}"), F.col("digest").alias(f"digest_{k}"))
        side = lambda k: sets.select(F.col("doc_id").alias(f"doc_{k}"), F.col("digest").alias(f"digest_{k}"), F.col("items").alias(f"items_{k}"))
        named = written(pairs.join(end("a"), "a").join(end("b"), "b"), "named-pairs")
        got = (
            named.join(side("a"), ["doc_a", "digest_a"])
            .join(side("b"), ["doc_b", "digest_b"])
            .select("a", "b", F.size("items_a").alias("na"), F.size("items_b").alias("nb"), F.size(F.array_intersect("items_a", "items_b")).alias("inter"))
        )
        return written(got.dropDuplicates(["a", "b"]), label)  # rows repeated in several tasks give a pair several times

    def _plausible(self, pairs: DataFrame) -> DataFrame:
        """Pairs that their parity bitmaps don't rule out."""
        side = lambda k: self.rows.select(F.col("uid").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("bitmap").alias(f"m_{k}"))
        differ = F.aggregate(F.zip_with("m_a", "m_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return both.where(F.col("n_a") + F.col("n_b") - 2 * self._needed(F.col("n_a"), F.col("n_b")) >= differ).select("a", "b")

    # -- the join --------------------------------------------------------------------
    def profiles(self) -> DataFrame:
        counts = self.spark.sparkContext.broadcast(bucket_counts(self.docs, self.n))
        rows = self.docs.withColumn("uid", F.monotonically_increasing_id())
        return written(rows.mapInArrow(_profiles(self.n, self.percent, counts), _PROFILE), "shingle-profiles")

    def _lists(self, classes: DataFrame) -> DataFrame:
        """Index entries of prefix shingles that several rows have, one row of each set taking part.

        The entries of all rows move once, to their shingle, where they are
        counted with their repetitions and those without company are left out;
        only what is left is joined with the rows that take part.  A list left
        with one set gives no pair.
        """
        entries = self.rows.where("digest is not null").select(
            F.col("uid").alias("id"), F.col("n_shingles").cast("int").alias("n"), "size_class", F.posexplode("prefix").alias("pos", "token")
        )
        counted = entries.withColumn("m", F.count("*").over(Window.partitionBy("token"))).where("m > 1")
        return written(counted.join(classes.select(F.col("uid").alias("id")), "id", "left_semi"), "index-lists")

    def run(self) -> tuple[DataFrame, DataFrame]:
        """Profiles of all rows with their class's ``uid`` and ``rep`` (its smallest document), and components of the classes that link."""
        profiles = self.profiles()
        reps = profiles.where("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "uid")).alias("r"))
        classes = written(reps.select("digest", F.col("r.doc_id").alias("rep"), F.col("r.uid").alias("uid")), "set-classes")
        self.rows = profiles  # joined by uid only, so a column is read without the other rows of its set being taken out
        lists = self._lists(classes)

        # Related sets: each compared with one leader of its lists, a set that many others share lists with.
        degree = lists.groupBy("id").agg(F.sum("m").alias("degree"))
        leaders = (
            lists.join(degree, "id")
            .groupBy("token", "size_class")
            .agg(F.max(F.struct("degree", (-F.col("n")).alias("less"), (-F.col("id")).alias("first"))).alias("lead"), F.count("*").alias("k"))
            .where("k > 1")
            .select("token", "size_class", (-F.col("lead.first")).alias("a"), (-F.col("lead.less")).alias("n_a"))
        )
        stars = (
            lists.join(leaders, ["token", "size_class"])
            .where((F.col("a") != F.col("id")) & (100 * F.least("n_a", "n") >= self.percent * F.greatest("n_a", "n")))
            .groupBy(F.col("id").alias("b"), "a").agg(F.count("*").alias("shared"))
            .groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"))  # the leader it shares most with
        )
        checked = self._verified(written(self._plausible(stars), "star-pairs"), "star-answers")
        linked = checked.where(self._links(F.col("inter"), F.col("na"), F.col("nb")))
        related = written(connected_components(linked.select("a", "b")), "related")
        distance = 1 - F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))
        leader = linked.groupBy("b").agg(F.min(F.struct(distance.alias("d"), F.col("a").alias("lead"))).alias("l"))
        leader = written(leader.select(F.col("b").alias("id"), "l.lead", "l.d"), "leaders")

        pairs = written(self._plausible(self._block_pairs(lists, related)), "block-pairs")
        more = self._answers(pairs, leader)
        edges = linked.select("a", "b").unionByName(more)
        found = connected_components(edges).select(F.col("node").alias("uid"), F.col("component").alias("root"))
        least = found.join(classes, "uid").groupBy("root").agg(F.min("rep").alias("component"))
        named = found.join(least, "root").select("uid", "component")
        return profiles.drop("uid").join(classes, "digest", "left"), named

    def _block_pairs(self, lists: DataFrame, related: DataFrame) -> DataFrame:
        """Pairs of unrelated sets that share a prefix shingle and that sizes and positions allow, block by block."""
        named = lists.join(related.select(F.col("node").alias("id"), F.col("component").alias("c")), "id", "left").withColumn("c", F.coalesce("c", "id"))
        several = named.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
        # A position is told apart as far as it rules pairs out: by sixteenths of the prefix.
        live = written(
            named.join(several, "token").withColumn("step", F.floor(F.lit(1600.0 / (100 - self.percent)) * F.col("pos") / (F.col("n") + 1)).cast("int")),
            "live-lists",
        )
        blocks = live.groupBy("token", "size_class", "step").agg(
            F.max(F.col("n") - F.col("pos")).alias("left"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("c").alias("lo"), F.max("c").alias("hi")
        )
        side = lambda k: blocks.select("token", *[F.col(c).alias(f"{c}_{k}") for c in ("size_class", "step", "left", "least", "most", "lo", "hi")])
        first = side("a").withColumn("size_class_b", F.explode(F.array(F.col("size_class_a"), F.col("size_class_a") + 1)))
        kept = (
            first.join(side("b"), ["token", "size_class_b"])
            .where((F.col("size_class_a") < F.col("size_class_b")) | (F.col("step_a") <= F.col("step_b")))
            .where(~((F.col("lo_a") == F.col("hi_a")) & (F.col("lo_b") == F.col("hi_b")) & (F.col("lo_a") == F.col("lo_b"))))
            .where(F.least("left_a", "left_b") >= self._needed(F.col("least_a"), F.col("least_b")))
            .where(100 * F.least("most_a", "most_b") >= self.percent * F.greatest("least_a", "least_b"))
            .select("token", "size_class_a", "step_a", "size_class_b", "step_b")
        )
        entry = lambda k: live.select("token", *[F.col(c).alias(f"{c}_{k}") for c in ("size_class", "step", "id", "n", "pos", "c")])
        return (
            kept.join(entry("a"), ["token", "size_class_a", "step_a"])
            .join(entry("b"), ["token", "size_class_b", "step_b"])
            .where("id_a <> id_b and c_a <> c_b")
            .where(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
            .where(F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= self._needed(F.col("n_a"), F.col("n_b")))
            .select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
            .distinct()
        )

    def _answers(self, pairs: DataFrame, leader: DataFrame) -> DataFrame:
        """Linked pairs among ``pairs``, by the leaders' distances where these decide."""
        side = lambda k: leader.select(F.col("id").alias(k), F.col("lead").alias(f"l_{k}"), F.col("d").alias(f"d_{k}"))
        led = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
        led = led.select(
            "a", "b", F.coalesce("d_a", F.lit(0.0)).alias("d_a"), F.coalesce("d_b", F.lit(0.0)).alias("d_b"),
            F.coalesce("l_a", "a").alias("l_a"), F.coalesce("l_b", "b").alias("l_b"),
        )
        led = written(led.withColumn("p", F.least("l_a", "l_b")).withColumn("q", F.greatest("l_a", "l_b")), "led-pairs")
        between = self._verified(led.where("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct(), "leader-answers")
        distance = 1 - F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))
        known = led.join(between.select(F.col("a").alias("p"), F.col("b").alias("q"), distance.alias("d"), self._links(F.col("inter"), F.col("na"), F.col("nb")).alias("ok")), ["p", "q"], "left")
        limit, slack = 1 - self.percent / 100.0, F.col("d_a") + F.col("d_b")
        known = written(
            known.withColumn(
                "answer",
                F.when((F.col("a") == F.col("l_a")) & (F.col("b") == F.col("l_b")), F.col("ok"))
                .when(F.col("d") + slack <= limit - 1e-9, True)
                .when(F.col("d") - slack > limit + 1e-9, False),
            ),
            "derived-answers",
        )
        open_pairs = known.where("answer is null").select("a", "b").distinct()
        if open_pairs.isEmpty():
            return known.where("answer").select("a", "b")
        rest = self._verified(open_pairs, "pair-answers")
        found = rest.where(self._links(F.col("inter"), F.col("na"), F.col("nb"))).select("a", "b")
        return known.where("answer").select("a", "b").unionByName(found)


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row.

    Rows without words (also null or empty texts) have no shingles and are
    their own component; a row with a null id links with nothing and has a
    null component.  Repeated ids are rows of their own with the component of
    their text.  Other columns are ignored; an empty table gives no rows.
    """
    rows, components = JaccardJoin(docs, n, percent).run()
    return rows.join(components, "uid", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents whose component holds a smaller id; of rows with one id and text, all go or stay."""
    gone = fresh(docs.columns, "__gone")
    found = jaccard_components(docs, n, percent).where("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
    id_at = next(c for c in docs.columns if c.lower() == "doc_id")
    return docs.join(found, docs[id_at].cast("long") == F.col(gone), "left_anti")
