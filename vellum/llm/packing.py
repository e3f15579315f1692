"""Harmonic packing of token sequences.

Documents are cut so that nearly every piece has a length of capacity / 2^i, a reciprocal class whose bins hold exactly
2^i pieces and no padding; what is left of a document below `grain` tokens is one more piece, whose class holds
floor(capacity / length) pieces a bin. A piece's place in its class is its number within its own task plus the sum of the
counts of the tasks before; bin and offset follow by arithmetic, so workers fill their bins independently, and only
(task, class) counts are shuffled. What is left of the classes behind their last full bins, less than a bin each, is packed
together by first fit, longest first, so at most one bin of all is mostly padding.

Rows: null and empty texts hold only the end id. Repeated rows and repeated or null doc_ids are packed like any other row.
An empty table gives an empty result. Other columns are not read. Very long texts are cut into as many pieces as they need; a
worker holds one text's ids at a time.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import local_table, materialize
from vellum.llm.tokens import encoded_batches

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, place long"


def cut(n: int, capacity: int, grain: int) -> list[int]:
    """Piece lengths of a document of n tokens, longest first: full bins, powers of two down to grain, the rest."""
    out = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity // 2
    while size >= grain and rest >= grain:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


def _cutter(path: str, end_id: int, capacity: int, grain: int, keep_ids: bool):
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        task, met = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for doc_ids, texts in encoded_batches(batches, path):
            cols: list[list] = [[] for _ in range(7 + keep_ids)]
            for doc_id, ids in zip(doc_ids, texts):
                ids += end
                n, at = len(ids) // 4, 0
                for length in cut(n, capacity, grain):
                    some = ids[4 * at : 4 * (at + length)]
                    for col, v in zip(cols, (doc_id, at, length, zlib.crc32(some), n, task, met[length], some)):
                        col.append(v)
                    met[length] += 1
                    at += length
            kinds = [pa.int64()] * 7 + [pa.binary()] * keep_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "place", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names[: len(cols)])

    return run


def last_bins(totals: dict[int, int], capacity: int) -> tuple[list[tuple], list[tuple]]:
    """(classes: length, pieces a bin, full bins, number of the first; what is left: length, its number there, bin, offset) of how
    many pieces there are of each length. Each class leaves less than a bin, so this is small whatever the corpus."""
    classes, at = [], 0
    for length in sorted(totals, reverse=True):
        classes.append((length, capacity // length, totals[length] // (capacity // length), at))
        at += classes[-1][2]
    spots, fill = [], []
    for length, per_bin, full, _ in classes:
        bin_ = 0
        for r in range(totals[length] - full * per_bin):
            # Bins that were too full for one piece are for the next of its length.
            while bin_ < len(fill) and fill[bin_] + length > capacity:
                bin_ += 1
            if bin_ == len(fill):
                fill.append(0)
            spots.append((length, r, at + bin_, fill[bin_]))
            fill[bin_] += length
    return classes, spots


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 1, capacity: int = 2048, grain: int = 64, keep_ids: bool = False) -> DataFrame:
    """Pieces of docs (doc_id, text) with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    capacity and grain are powers of two. keep_ids adds the piece's ids as little-endian 32-bit integers.
    """
    if capacity & (capacity - 1) or grain & (grain - 1) or not 1 <= grain <= capacity:
        raise ValueError("capacity and grain must be powers of two, grain at most capacity")
    schema = PIECES + ", ids binary" * keep_ids
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = materialize(rows.mapInArrow(_cutter(tokenizer, end_id, capacity, grain, keep_ids), schema), "pieces")

    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    by_task = Window.partitionBy("length").orderBy("task")
    before = counts.withColumn("before", F.sum("n").over(by_task) - F.col("n"))
    # One row for each of at most capacity lengths.
    found = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    classes, spots = last_bins(found, capacity)
    spark = docs.sparkSession
    totals = local_table(spark, classes, "length long, per_bin long, full long, first_bin long")
    rest = local_table(spark, spots, "length long, r long, last_bin long, last_offset long")
    placed = pieces.join(F.broadcast(totals), "length").join(before.drop("n"), ["length", "task"])
    nth = F.col("place") + F.col("before")
    placed = placed.withColumn("nth", nth).withColumn("r", F.col("nth") - F.col("full") * F.col("per_bin")).join(F.broadcast(rest), ["length", "r"], "left")
    in_full = F.col("r") < 0
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.when(in_full, F.col("first_bin") + F.floor(F.col("nth") / F.col("per_bin"))).otherwise(F.col("last_bin")).cast("long").alias("sequence_id"),
        F.when(in_full, F.col("nth") % F.col("per_bin") * F.col("length")).otherwise(F.col("last_offset")).cast("long").alias("offset"),
        *["ids"] * keep_ids,
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """Packed sequences from pack(..., keep_ids=True): sequence_id, ids (bytes), n_tokens. A group is at most one capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_tokens"))
