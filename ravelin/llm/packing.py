"""Best-fit packing of token pieces into sequences of a fixed capacity."""

from __future__ import annotations

import base64
import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import Scratch, map_texts, slots

CAPACITY, END = 2048, 0
VOCABULARY = "byte_bpe_50k"
#: The added tokens of the vocabulary's file, which ``tokenizers`` finds inside a text.
SPECIAL = {"<|endoftext|>": 50256}


def tokenizer(name: str = VOCABULARY, library: str = "tiktoken"):
    """texts -> lists of ids. Both libraries read the same published vocabulary and give the same ids.

    ``tokenizers`` needs three to four times the CPU seconds of ``tiktoken`` (see README).
    """
    import public_tokenizers as public

    if library == "tokenizers":
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(public.path(f"{name}.json"))
        return lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    import tiktoken

    with open(public.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL).encode
    return lambda texts: [encode(t, allowed_special="all") for t in texts]


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but the first, which holds the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, *, capacity: int = CAPACITY, end: int = END, name: str = VOCABULARY, library: str = "tiktoken") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and one end id; a null text is empty."""

    def make():
        encode = tokenizer(name, library)

        def find(texts: list[str]):
            rows, found = [], []
            for row, ids in enumerate(encode(texts)):
                a = np.asarray([*ids, end], "<u4")
                for i, (s, n) in enumerate(cuts(len(a), capacity)):
                    rows.append(row)
                    found.append((i, s, n, zlib.crc32(a[s : s + n].tobytes())))
            return rows, [pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]

        return find

    return map_texts(docs, ["doc_id"], make, "piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, first rank, number, first sequence, pieces a sequence, offset).

    Pieces sorted by length, longest first, and gaps sorted by size are held as runs of equal values, so
    their number is bounded by the capacity and not by the data. Each superstep takes the run of one
    length: it sweeps to the successor gap (the smallest that holds it), the i-th piece by rank takes the
    i-th gap of the run, the gaps shrink and move to their new place in the order; what found no gap opens
    new sequences. The outcome is that of best fit, decreasing.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, number)
    order: list[int] = []
    out, opened = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                bisect.insort(order, gap)
                gaps[gap] = []
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                gap = order[at]
                first, bins = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            else:
                gap, first, bins = capacity, opened, -(-left // (capacity // length))
                opened += bins
            each = gap // length
            full = min(bins, left // each)
            put(gap - each * length, first, full)
            took = full * each
            if full < bins and left > took:  # the last pieces share one sequence
                put(gap - (left - took) * length, first + full, 1)
                put(gap, first + full + 1, bins - full - 1)
                took = left
            else:
                put(gap, first + full, bins - full)
            out.append((length, rank, took, first, each, capacity - gap))
            rank, left = rank + took, left - took
    return out


def pack(parts: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to ``parts`` (doc_id, piece, length, ... with 1 <= length <= capacity).

    Ranks within a length are counted in salted chunks, so a length that most pieces have is dealt over all
    tasks. Only the counts by length (at most capacity rows) come to the driver; the placements that go
    back are a few thousand rows at most, for any input. An empty table gives no rows.
    """
    spark = parts.sparkSession
    held = Scratch(spark).keep(parts)
    chunks = slots(spark, 12)
    d = held.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)))
    sizes = d.groupBy("length", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    counts = {int(r[0]): int(r[1]) for r in sizes.groupBy("length").agg(F.sum("_n")).collect()}
    placed = best_fit(counts, capacity)
    before = W.partitionBy("length").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    d = d.withColumn("_in", F.row_number().over(W.partitionBy("length", "_chunk").orderBy("doc_id", "piece")) - 1)
    d = d.join(sizes, ["length", "_chunk"]).withColumn("_rank", F.col("_before") + F.col("_in"))
    plan = spark.createDataFrame(placed, "length long, _a long, _took long, _first long, _each long, _at long")
    d = d.join(F.broadcast(plan), (d["length"] == plan["length"]) & (F.col("_rank") >= F.col("_a")) & (F.col("_rank") < F.col("_a") + F.col("_took"))).drop(plan["length"])
    i = F.col("_rank") - F.col("_a")
    d = d.withColumn("sequence_id", (F.col("_first") + F.floor(i / F.col("_each"))).cast("long")).withColumn("offset", (F.col("_at") + F.pmod(i, F.col("_each")) * F.col("length")).cast("long"))
    return d.select(*parts.columns, "sequence_id", "offset")


def packed(docs: DataFrame, *, capacity: int = CAPACITY, **options) -> DataFrame:
    """All documents as pieces in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece with the end id alone; repeated rows and null ids are packed like
    others; further columns are not read.
    """
    return pack(pieces(docs, capacity=capacity, **options), capacity=capacity)
