"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments: of two fingerprints that differ in at most two bits, one segment differs
in at most one. So each fingerprint is indexed by both segments as they are and by the 32 variants of each segment that leave
one bit open; fingerprints that share a key are compared whole. Under a key with an open bit only those with the bit unset
meet those with it set, so that a pair that agrees in a segment meets once by that segment.

Copies are one fingerprint before the index. Keys of more than `most` fingerprints are not paired: each fingerprint under them
names all fingerprints one bit away and itself. Two that name the same one are at most two bits apart, two that are at most
two bits apart name one in common, and no more than 65 can name one, so these groups are bounded and complete.

Rows: a null, empty or blank text has no words: fingerprint zero, linked like any other. Very long texts are read in slices of
words and count whole. A null doc_id keeps its row and never names a component (null where no row of a component has one);
repeated doc_ids and repeated rows keep a row each. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import filtered, id_filter, keep, materialize, scratch
from vellum.llm.components import components

#: Words of a shingle, and the seed of its hash.
WORDS, SEED = 3, 42
#: Bits that linked fingerprints may differ in.
BITS = 2
#: Fingerprints under a key that are compared by pairs; those under fuller keys link by the values that they name.
MOST = 16
#: Bytes of a text whose words are held at once.
SLICE = 1 << 20
_BREAK = re.compile(rb"[ \t-\r]")


def word_slices(data: bytes, size: int = SLICE):
    """Lists of words of a text, cut at white space."""
    at = 0
    while at < len(data):
        found = _BREAK.search(data, at + size)
        end = found.start() if found else len(data)
        yield data[at:end].split()
        at = end


def shingle_hashes(data: bytes, size: int = SLICE):
    """Arrays of the hashes of all shingles of a text, repeats included."""
    import numpy as np
    import xxhash

    digest, held, any_shingle = xxhash.xxh64_intdigest, [], False
    for words in word_slices(data.translate(_LOWER), size):
        held += words
        if len(held) < WORDS:
            continue
        text = b" ".join(held)
        ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = len(held) - WORDS + 1
        yield np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[WORDS - 1 :].tolist())), np.uint64, n)
        any_shingle, held = True, held[1 - WORDS :]
    if held and not any_shingle:
        yield np.array([digest(b" ".join(held), SEED)], np.uint64)


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(data: bytes, size: int = SLICE) -> int:
    """The fingerprint of a text in UTF-8 as a signed integer: bits set in over half the hashes."""
    import numpy as np

    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(data, size):
        for lo in range(0, len(hashes), 65536):
            some = hashes[lo : lo + 65536]
            counts += np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructField, StructType

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            found = [fingerprint(t.as_py().encode()) if t.is_valid else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("fp", LongType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _bit(p: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), p)


def index_keys(prints: DataFrame) -> DataFrame:
    """key, side (0 and 1: the open bit's value; 2: no open bit), fp: 66 rows a fingerprint."""

    def of(segment: int) -> list[Column]:
        value = F.col("fp").bitwiseAND(0xFFFFFFFF) if segment == 0 else F.shiftrightunsigned("fp", 32)
        whole = F.struct((F.lit((segment << 38) | (63 << 32)).cast("long") + value).alias("key"), F.lit(2).alias("side"))
        places = F.sequence(F.lit(0), F.lit(31))
        name = lambda p: F.lit(segment << 38).cast("long") + p.cast("long") * F.lit(1 << 32) + value.bitwiseAND(F.bitwise_not(_bit(p)))
        opened = F.transform(places, lambda p: F.struct(name(p).alias("key"), F.when(value.bitwiseAND(_bit(p)) == 0, 0).otherwise(1).alias("side")))
        return [F.array(whole), opened]

    return prints.select("fp", F.explode(F.concat(*of(0), *of(1))).alias("x")).select("x.key", "x.side", "fp")


def near(a: Column | str, b: Column | str) -> Column:
    return F.bit_count((F.col(a) if isinstance(a, str) else a).bitwiseXOR(F.col(b) if isinstance(b, str) else b)) <= BITS


def named_in_common(prints: DataFrame) -> DataFrame:
    """a, b: links of fingerprints that name the same value, as a star of each value's fingerprints (65 at most)."""
    flips = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.col("fp").bitwiseXOR(_bit(p))))
    named = prints.select("fp", F.explode(flips).alias("value")).groupBy("value").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return named.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()


def links(prints: DataFrame, most: int = MOST) -> DataFrame:
    """a, b: enough links of distinct fingerprints (column fp) at most two bits apart to join all that are linked by chains."""
    keys = index_keys(prints)
    # Under most keys stands one fingerprint, which needs no partner; under two the ends are the pair.
    low, high = F.min(F.when(F.col("side") != 1, F.col("fp"))), F.max(F.when(F.col("side") != 0, F.col("fp")))
    counted = materialize(keys.groupBy("key").agg(F.count("*").alias("n"), low.alias("a"), high.alias("b")).where("n > 1 and a is not null and b is not null"), "keys")
    out = counted.where("n = 2").select("a", "b").where(near("a", "b"))
    some, full = counted.where(f"n between 3 and {most}").select("key", "n"), counted.where(f"n > {most} and n > 2").select("key")
    context = prints.sparkSession.sparkContext
    if not some.isEmpty():
        met = filtered(keys, "key", context.broadcast(id_filter(some.select("key"))), True).join(some, "key")
        sides = met.groupBy("key").agg(*[F.collect_list(F.when(F.col("side") != other, F.col("fp"))).alias(c) for c, other in (("unset", 1), ("set", 0))])
        pairs = sides.select(F.explode("unset").alias("a"), "set").select("a", F.explode("set").alias("b"))
        out = out.union(pairs.where((F.col("a") != F.col("b")) & near("a", "b")))
    if not full.isEmpty():
        # The filter lets others pass, each fingerprint by 66 keys, so the join asks again.
        crowded = filtered(keys, "key", context.broadcast(id_filter(full)), True).join(full, "key", "left_semi").select("fp").distinct()
        out = out.union(named_in_common(crowded))
    return out


def near_duplicates(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: the smallest doc_id reachable by links, its own included."""
    with scratch(docs.sparkSession):
        marked = keep(fingerprints(docs), "prints")
        prints = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
        classes = components(links(prints.select("fp"), most))
        joined = prints.join(classes.withColumnRenamed("node", "fp"), "fp")
        least = joined.groupBy("comp").agg(F.min("least").alias("component_id"))
        named = prints.join(joined.join(least, "comp").select("fp", "component_id"), "fp", "left")
        named = keep(named.select("fp", F.coalesce("component_id", "least").alias("component_id")), "named")
    # A hot fingerprint's rows are split by the adaptive join.
    return marked.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
