"""Token counts with overlap resynchronisation for huge documents (operator 3).

Texts up to ``CHUNK`` characters are encoded where they are read.  Longer ones
are cut into chunks that overlap and are dealt out over all tasks.  Every
chunk is encoded with offsets.  Two neighbours are spliced at a boundary that
both found inside their overlap and that is stable: a blank after something
other than white space starts a new word whatever stands elsewhere, as no word
and no special token holds a blank after its first character.  Boundaries
near a chunk's own cut ends are not used.  Where the overlap holds no common
boundary, it is widened: the neighbours become one chunk, which is encoded
again, until every junction is aligned.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import cut_at_blanks
from .common import keep_only, text_chunks, written

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Characters of a chunk and of the overlap of two, and how near to a cut end a boundary isn't used (more than a special token has).
CHUNK, OVERLAP, MARGIN = 32_768, 1024, 64
TABLE_SIZE = 1_000_000


class Counter:
    """Token counts of pieces, each encoded by the vocabulary's library when it is first met."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers

        path = public_tokenizers.path(name)
        self.cut = cut_at_blanks
        if name.endswith(".model"):
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.sizes = lambda texts: [len(x) for x in library.encode(texts, num_threads=1)]
            self.cut = lambda text: [text] if text else []  # words depend on what stands around them
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self.sizes = lambda texts: [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        self.table: dict[str, int] = {}

    def learn(self, cuts: list[list[str]]) -> dict[str, int]:
        if len(self.table) > TABLE_SIZE:
            self.table = {}
        table = self.table
        new = list(set().union(*cuts).difference(table))
        for i in range(0, len(new), 20_000):
            table.update(zip(new[i : i + 20_000], self.sizes(new[i : i + 20_000]), strict=True))
        return table

    def counts(self, texts: list[str]) -> list[int]:
        cuts = [self.cut(t) for t in texts]
        table = self.learn(cuts)
        return [sum(map(table.__getitem__, pieces)) for pieces in cuts]

    def boundaries(self, text: str, start: int) -> tuple[int, list[int], list[int]]:
        """Tokens of a chunk; its stable boundaries (offsets in the document) and the tokens before each."""
        pieces = self.cut(text)
        table, at, n, places, before = self.learn([pieces]), 0, 0, [], []
        for p in pieces:
            if at and p[0] == " " and not text[at - 1].isspace():
                places.append(start + at)
                before.append(n)
            at += len(p)
            n += table[p]
        return n, places, before


_COUNTERS: dict[str, Counter] = {}


def counter(name: str) -> Counter:
    if name not in _COUNTERS:
        _COUNTERS[name] = Counter(name)
    return _COUNTERS[name]


_READ = "uid long, doc_id long, n_bytes long, n_tokens long, chunk long, start long, last boolean, text string"
_ENCODED = "uid long, chunk long, n_tokens long, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>"


def _read(name: str, size: int, overlap: int):
    """Short texts counted; long ones cut into chunks."""
    schema = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]]) for c in _READ.split(", ")])
    whole = name.endswith(".model")

    def run(batches):
        keep_only("token_counts", _COUNTERS.clear)
        count = counter(name)
        for batch in batches:
            rows = [(u, d, t or "") for u, d, t in text_chunks(batch, ["uid", "doc_id", "text"])]
            short = [r for r in rows if whole or len(r[2]) <= size]
            out = [(u, d, len(t.encode()), n, None, None, None, None) for (u, d, t), n in zip(short, count.counts([r[2] for r in short]), strict=True)]
            for u, d, t in rows:
                if not whole and len(t) > size:
                    starts = range(0, len(t) - overlap, size - overlap)
                    out += [(u, d, len(t.encode()) if k == 0 else None, None, k, s, s + size >= len(t), t[s : s + size]) for k, s in enumerate(starts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)

    return run


def _encode(name: str, overlap: int):
    types = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 4
    names = [c.split()[0] for c in _ENCODED.split(", ")]

    def run(batches):
        keep_only("token_counts", _COUNTERS.clear)
        count = counter(name)
        for batch in batches:
            out = []
            for uid, chunk, start, last, text, left, right in text_chunks(batch, ["uid", "chunk", "start", "last", "text", "left_to", "right_from"]):
                n, places, before = count.boundaries(text, start)
                end = start + len(text)
                near = [(p, b) for p, b in zip(places, before, strict=True) if start + MARGIN <= p <= left] if start else []
                far = [] if last else [(p, b) for p, b in zip(places, before, strict=True) if right <= p <= end - MARGIN]
                out.append((uid, chunk, n, [p for p, _ in near], [b for _, b in near], [p for p, _ in far], [b for _, b in far]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], names=names)

    return run


def _junctions(chunks: DataFrame, name: str, overlap: int) -> DataFrame:
    """Encoded chunks with the count to take off for the junction with the next one; null where none is common."""
    encoded = (
        chunks.withColumn("left_to", F.col("start") + overlap)
        .withColumn("right_from", F.col("start") + F.length("text") - overlap)
        .repartition("uid", "chunk")
        .mapInArrow(_encode(name, overlap), _ENCODED)
    )
    w = Window.partitionBy("uid").orderBy("chunk")
    nxt = encoded.select(
        "uid", "chunk", "n_tokens", "right_at", "right_n",
        F.lead("chunk").over(w).isNotNull().alias("joined"),
        F.lead("left_at").over(w).alias("next_at"), F.lead("left_n").over(w).alias("next_n"),
    )
    at = nxt.withColumn("at", F.array_min(F.array_intersect("right_at", "next_at")))
    off = F.col("n_tokens") - F.element_at("right_n", F.array_position("right_at", F.col("at")).cast("int")) + F.element_at(
        "next_n", F.array_position("next_at", F.col("at")).cast("int")
    )
    return at.select("uid", "chunk", "n_tokens", "joined", F.when(F.col("joined") & F.col("at").isNotNull(), off).alias("off"))


def _widened(chunks: DataFrame, junctions: DataFrame) -> DataFrame:
    """Neighbours without a common boundary as one chunk."""
    w = Window.partitionBy("uid").orderBy("chunk")
    ok = F.coalesce(F.lag(F.col("off").isNotNull().cast("int")).over(w), F.lit(0))
    runs = junctions.select("uid", "chunk", ok.alias("ok")).select("uid", "chunk", F.sum("ok").over(w).alias("run"))
    grouped = (
        chunks.join(runs, ["uid", "chunk"])
        .groupBy("uid", "run")
        .agg(F.sort_array(F.collect_list(F.struct("start", "text", "last"))).alias("parts"))
    )
    text = F.aggregate(
        "parts",
        F.struct(F.lit("").alias("t"), F.col("parts")[0]["start"].alias("end")),
        lambda acc, x: F.struct(
            F.concat(acc["t"], F.substring(x["text"], (acc["end"] - x["start"] + 1).cast("int"), F.lit(2**31 - 1))).alias("t"),
            (x["start"] + F.length(x["text"])).alias("end"),
        ),
        lambda acc: acc["t"],
    )
    return grouped.select(
        "uid", F.col("run").alias("chunk"), F.col("parts")[0]["start"].alias("start"),
        F.element_at("parts", -1)["last"].alias("last"), text.alias("text"),
    )


def token_counts(
    docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` per row.

    A null text is empty: 0 bytes, 0 tokens.  Null and repeated ids are kept
    row by row; other columns are ignored; an empty table gives no rows.
    Files of the sentencepiece kind are encoded whole.
    """
    read = written(
        docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
            _read(vocabulary, chunk, overlap), _READ
        ),
        "token-counts",
    )
    short = read.where("chunk is null").select("doc_id", "n_bytes", "n_tokens")
    chunks, total = read.where("chunk is not null").select("uid", "chunk", "start", "last", "text"), None
    while True:
        junctions = written(_junctions(chunks, vocabulary, overlap), "token-junctions")
        if junctions.where("joined and off is null").isEmpty():
            break
        chunks = written(_widened(chunks, junctions), "token-chunks")
    total = junctions.groupBy("uid").agg((F.sum("n_tokens") - F.coalesce(F.sum("off"), F.lit(0))).alias("n_tokens"))
    long = read.where("chunk = 0").select("uid", "doc_id", "n_bytes").join(total, "uid").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)
