"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes if it lies in a string of `least` bytes that also starts anywhere else in the corpus, in the same document too.
With `words`, the symbols are words instead of bytes (lower-cased, split by ASCII white space, each one hash), and `least`,
`gram` and `window` count words: `passages` has their values for runs of 51 words.

Positions are thinned first, without losing a string: of each `window` consecutive k-grams the one with the least hash
(leftmost of ties) is an anchor, so equal strings have the same anchors at the same places. The text between two anchors is
a phrase. Ranks of single phrases are counted, and anchors whose rank is unique leave; ranks of 2, 4, 8 ... phrases are
named from rank pairs at offsets 1, 2, 4 ... (Spark sorts the pairs to join each with its count), until an anchor is unique
or its phrases reach past what all strings assigned to it share (its core: named from two overlapping ranks). What is left
of a string beside the core is at most a window on either side. Anchors that agree on the core and on both sides stand for
repeated strings; where a core has several sides, every string around it is named by the hash of its sides and counted.

Groups of equal names are only counted and joined, never gathered; a text's own ranks are one list, as its bytes are one
value, and ranks outside any core that is longer still are not named again. Names are 64-bit; a string is removed only if the core's name and the
independent hash of its sides agree.

Rows: null and empty texts have no bytes; texts below `least` bytes lose none. Repeated rows of at least `least` bytes go
whole. Null or repeated doc_ids don't matter: results are found by a digest of the text. An empty table gives an empty
result. Other columns are not read. Texts are up to 2^31 bytes, as in Spark.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import delete, filtered, id_filter, keep, materialize, new_path, scratch, words_of

LEAST, GRAM, WINDOW = 400, 32, 96
#: The same in words: passages of over 50 words.
PASSAGE = {"least": 51, "gram": 11, "window": 20}
BASE = 0x9E3779B97F4A7C15


class _Hashed:
    """Hashes of substrings of a text's bytes (or words) in constant time each, vectorised: polynomials modulo 2^64."""

    POWERS: list = []

    @classmethod
    def powers(cls, n: int):
        import numpy as np

        if not cls.POWERS or len(cls.POWERS[0]) <= n:
            size = max(2 * n, 1 << 16)
            for b in (BASE, pow(BASE, -1, 1 << 64)):
                p = np.full(size, np.uint64(b), np.uint64)
                p[0] = 1
                cls.POWERS.append(np.multiply.accumulate(p))
            cls.POWERS = cls.POWERS[-2:]
            rng = np.random.Generator(np.random.PCG64(1))
            cls.BYTES = rng.integers(1, 1 << 63, 256, np.uint64)
        return cls.POWERS

    def __init__(self, text: str, words: bool = False):
        import numpy as np

        if words:
            lower = text.lower()
            codes = _Hashed(lower).of(*word_bounds(lower.encode("utf-8")))
        else:
            self.powers(0)
            codes = self.BYTES[np.frombuffer(text.encode("utf-8"), np.uint8)]
        up, self.down = self.powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[: len(codes)], out=self.sums[1:])

    def of(self, lo, hi):
        """Hashes of data[lo:hi] for arrays lo and hi."""
        import numpy as np

        h = (self.sums[hi] - self.sums[lo]) * self.down[lo]
        h ^= h >> np.uint64(32)
        h = (h + (hi - lo).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def word_bounds(data: bytes):
    """Arrays of where each word of a text begins and ends."""
    import numpy as np

    b = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], (b != 32) & ((b < 9) | (b > 13)), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _mix(*parts):
    import numpy as np

    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def window_minima(keys, w: int):
    """Least of each w consecutive keys, from running minima of blocks in both directions."""
    import numpy as np

    n = len(keys)
    padded = np.full(-(-n // w) * w, np.uint64(2**64 - 1), np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(text: str, least: int, gram: int, window: int, words: bool = False):
    """Arrays over a text's anchors: place, end of the core, phrases in the core, first and last distance of a string's
    start before the anchor (-1: none), and the hashed text."""
    import numpy as np

    h, reach = _Hashed(text, words), gram + window - 1
    n = len(h.sums) - 1
    at = np.arange(n - gram + 1)
    grams = h.of(at, at + gram)
    keys = (grams >> np.uint64(31) << np.uint64(31)) | at.astype(np.uint64)
    chosen = (window_minima(keys, window) & np.uint64(2**31 - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    place = chosen[first]
    last = np.append(first[1:], len(chosen)) - 1
    high = place - first
    low = place - np.minimum(last, n - least)
    has = first <= n - least
    low, high = np.where(has, low, -1), np.where(has, high, -1)
    ahead = np.minimum(place + least - reach - window + 1, len(chosen) - 1)
    end = np.where(has, chosen[ahead], place)
    phrases = np.searchsorted(place, end) - np.arange(len(place))
    return h, place, end, phrases, low, high


def _slices(batches, rows: int = 256):
    """Batches of few rows, so that what a task makes of them at a time stays small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


ANCHORS = "doc long, d1 long, d2 long, phrase array<long>, side array<long>, packed array<long>"


def _scan(least: int, gram: int, window: int, words: bool):
    def run(batches):
        import numpy as np

        task, nth, met = TaskContext.get().partitionId() << 36, 0, set()
        for batch in _slices(batches):
            cols: list[list] = [[] for _ in range(6)]
            for d1, d2, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                nth += 1
                # A task scans a text once; copies are removed whole by their count.
                if (d1, d2) in met:
                    continue
                if len(met) < 100_000:
                    met.add((d1, d2))
                h, place, end, phrases, low, high = anchors(text, least, gram, window, words)
                phrase = _mix(h.of(place[:-1], place[1:]))
                has = high >= 0
                lo, hi = np.maximum(low, 0), np.maximum(high, 0)
                side = np.where(has, _mix(h.of(place - hi, place), h.of(end, np.maximum(end, np.minimum(place - lo + least, len(h.sums) - 1))), lo, hi), 0)
                # place 31 bits, phrases 16, low 8 and high 8; 0 phrases: no string is assigned to the anchor.
                packed = place << 32 | np.where(has, phrases, 0) << 16 | lo << 8 | hi
                for c, v in zip(cols, (task + nth, d1, d2, phrase.view(np.int64), side.astype(np.uint64).view(np.int64), packed)):
                    c.append(v)
            if cols[0]:
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in c])]).astype(np.int32)), pa.array(np.concatenate(c))) for c in cols[3:]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), *lists], ["doc", "d1", "d2", "phrase", "side", "packed"])

    return run


PAIRS = "doc long, at int, phrases int, name long, core boolean"


def _doubled(reach: int):
    """From ranks of `reach` phrases (doc, held): names of the cores that two of them cover, and ranks of twice as many
    phrases where an anchor's core still needs them."""

    def run(batches):
        import numpy as np

        for batch in batches:
            rows = batch.column(1).flatten()
            doc = np.repeat(np.arange(batch.num_rows, dtype=np.int64), batch.column(1).value_lengths().to_numpy())
            at, phrases, name = (rows.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            some = np.flatnonzero(~rows.field(3).to_numpy(zero_copy_only=False))
            key = doc[some] << 32 | at[some]
            some, key = some[np.argsort(key)], np.sort(key)
            if not len(key):
                continue
            n, rank = phrases[some], name[some].view(np.uint64)

            def beyond(which, steps):
                """Of the anchors numbered `which`: those with a rank that many phrases on, and its number."""
                to = key[which] + steps
                found = np.minimum(np.searchsorted(key, to), len(key) - 1)
                hit = key[found] == to
                return which[hit], found[hit]

            ready = np.flatnonzero((n >= reach) & (n < 2 * reach))
            a, b = beyond(ready, n[ready] - reach)
            core = _mix(rank[a], rank[b], n[a])
            # Only ranks inside a core that is longer still.
            longer = np.flatnonzero(n >= 2 * reach)
            bounds = np.zeros(len(key) + 1, np.int64)
            np.add.at(bounds, longer, 1)
            np.add.at(bounds, np.searchsorted(key, key[longer] + n[longer] - 2 * reach, "right"), -1)
            inside = np.flatnonzero(np.cumsum(bounds[:-1]) > 0)
            c, d = beyond(inside, reach)
            out = np.concatenate([a, c])
            names = np.concatenate([core, _mix(rank[c], rank[d])]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(key[out] >> 32)), pa.array((key[out] & 0xFFFFFFFF).astype(np.int32)), pa.array(n[out].astype(np.int32)), pa.array(names), pa.array(np.arange(len(out)) < len(a))], ["doc", "at", "phrases", "name", "core"])

    return run


WINDOWS = "doc long, start long, core long, distance int, name long, weight long, alone boolean"


def _strings(least: int, words: bool):
    """Every string around the anchors of a text: rows of d1, d2, text, anchors (doc, core, packed, end, weight)."""

    def run(batches):
        import numpy as np

        for batch in _slices(batches):
            cols: list[list] = [[] for _ in range(7)]
            rows, first = batch.column(1).flatten(), 0
            doc, core, packed, end, weight = (rows.field(c).to_numpy() for c in ("doc", "core", "packed", "end", "weight"))
            for text, n in zip(batch.column(0).to_pylist(), batch.column(1).value_lengths().to_pylist()):
                h = _Hashed(text, words)
                # All anchors of the text at once, one row a distance.
                some = np.arange(first, first + n)
                first += n
                lo = packed[some] >> 8 & 255
                many = (packed[some] & 255) - lo + 1
                which = np.repeat(some, many)
                d = np.arange(len(which)) - np.repeat(np.cumsum(many) - many - lo, many)
                p = packed[which] >> 32
                name = _mix(h.of(p - d, p), h.of(end[which], p - d + least))
                for c, v in zip(cols, (doc[which], p - d, core[which], d, name.view(np.int64), weight[which], weight[which] == 1)):
                    c.append(v)
            if cols[0]:
                kinds = [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(cols, kinds)], ["doc", "start", "core", "distance", "name", "weight", "alone"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def repeated(docs: DataFrame, *, least: int = LEAST, gram: int = GRAM, window: int = WINDOW, words: bool = False) -> tuple[DataFrame, DataFrame]:
    """(docs as row (a struct of the other columns), text and digests d1 and d2; spans): spans has d1, d2 and an array of
    (lo, hi) byte (or word) ranges to remove, unmerged."""
    if least < gram + 2 * window or window > 255:
        raise ValueError("least must be at least gram + 2 * window, window at most 255")
    spark = docs.sparkSession
    t = F.coalesce(F.col("text"), F.lit(""))
    # Other columns travel in one struct, so that none can clash.
    other = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    docs = docs.select(F.struct(F.lit(0).alias("__none"), *other).alias("row"), "text", F.xxhash64(t).alias("d1"), F.xxhash64(F.lit(1), t).alias("d2"))
    size = lambda c: (F.size(words_of(c)) if words else F.octet_length(c)).cast("long")
    long_docs = docs.where(size(t) >= least).select("d1", "d2", F.col("text"))
    copies = long_docs.select("d1", "d2", size(F.col("text")).alias("hi")).groupBy("d1", "d2", "hi").count().where("count > 1").select("d1", "d2", F.lit(0).cast("long").alias("lo"), "hi")
    with scratch(spark):
        scanned = materialize(long_docs.mapInArrow(_scan(least, gram, window, words), ANCHORS), "anchors")
        written: list[str] = []

        def several(rows: DataFrame, name: str) -> DataFrame:
            """Rows (doc, at, phrases, name, core) whose name occurs more than once, as one list a text. Tables of the round
            before go once this one's are written."""
            before, written[:] = list(written), [new_path(spark, f"ranks_{name}")]
            # Written first: a join of two plain shuffles can split the rows of a hot name over tasks, one with an aggregate can't.
            names = new_path(spark, f"several_{name}")
            counted = materialize(rows.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), path=names)
            held = rows.join(counted, "name", "left_semi")
            held = materialize(held.groupBy("doc").agg(F.collect_list(F.struct("at", "phrases", "name", "core")).alias("held")), path=written[0])
            for path in (names, *before):
                delete(spark, path)
            return held

        exploded = scanned.select("doc", F.posexplode("phrase").alias("at", "name"), "packed")
        phrases = F.shiftright(F.element_at("packed", F.col("at") + 1), 16).bitwiseAND(0xFFFF).cast("int")
        ranks, reach = several(exploded.select("doc", "at", phrases.alias("phrases"), "name", F.lit(False).alias("core")), "1"), 1
        cores = scanned.select("doc", F.lit(None).cast("array<struct<at:int,phrases:int,name:bigint,core:boolean>>").alias("held")).limit(0)
        while not ranks.where(F.exists("held", lambda x: ~x["core"] & (x["phrases"] >= reach))).isEmpty():
            ranks = several(ranks.mapInArrow(_doubled(reach), PAIRS), str(2 * reach))
            found = ranks.select("doc", F.filter("held", lambda x: x["core"]).alias("held")).where(F.size("held") > 0)
            cores, reach = cores.union(materialize(found, f"cores_{reach}")), 2 * reach
        for path in written:
            delete(spark, path)
        # A text's sides and places join its cores.
        with_side = F.transform("held", lambda x: F.struct(x["at"].alias("at"), x["name"].alias("core"), F.element_at("side", x["at"] + 1).alias("side"), F.element_at("packed", x["at"] + 1).alias("packed")))
        cores = materialize(cores.join(scanned.select("doc", "side", "packed"), "doc").select("doc", F.explode(with_side).alias("x")).select("doc", "x.*"), "cores")

        groups = materialize(cores.groupBy("core", "side").agg(F.count("*").alias("weight"), F.min(F.struct("doc", "at", "packed")).alias("first")), "groups")
        whole = groups.where("weight > 1").select("core", "side")
        place, low, high = F.shiftright("packed", 32), F.shiftright("packed", 8).bitwiseAND(255), F.col("packed").bitwiseAND(255)
        spans = cores.join(whole, ["core", "side"], "left_semi").select("doc", (place - high).alias("lo"), (place - low + least).alias("hi"))

        mixed = groups.groupBy("core").agg(F.count("*").alias("sides")).where("sides > 1").select("core")
        firsts = groups.join(mixed, "core", "left_semi").select("core", "weight", "first.*")
        docs_of = scanned.select("doc", "d1", "d2")
        # The core's end is where its last phrase ends: the place of the anchor that many phrases on.
        with_places = scanned.select("doc", "d1", "d2", F.col("packed").alias("all_packed"))
        asked = firsts.groupBy("doc").agg(F.collect_list(F.struct("core", "at", "packed", "weight")).alias("asked"))
        end_of = lambda x: F.shiftright(F.element_at("all_packed", x["at"] + 1 + F.shiftright(x["packed"], 16).bitwiseAND(0xFFFF).cast("int")), 32)
        asked = asked.join(with_places, "doc").select("d1", "d2", F.transform("asked", lambda x: F.struct(F.col("doc").alias("doc"), x["core"].alias("core"), x["packed"].alias("packed"), end_of(x).alias("end"), x["weight"].alias("weight"))).alias("asked"))
        asked = materialize(asked.groupBy("d1", "d2").agg(F.flatten(F.collect_list("asked")).alias("asked")), "asked")

        # Only texts that may be asked for are shuffled.
        some = filtered(long_docs, "d1", spark.sparkContext.broadcast(id_filter(asked.select("d1"))), True)
        texts = some.groupBy("d1", "d2").agg(F.first("text").alias("text"))
        strings = materialize(texts.join(asked, ["d1", "d2"]).select("text", "asked").mapInArrow(_strings(least, words), WINDOWS), "strings")
        again = strings.groupBy("core", "distance", "name").agg(F.sum("weight").alias("n")).where("n > 1").select("core", "distance", "name")
        found = strings.where("alone").join(again, ["core", "distance", "name"], "left_semi").select("doc", F.col("start").alias("lo"), (F.col("start") + least).alias("hi"))

        by_text = spans.union(found).join(docs_of, "doc").select("d1", "d2", "lo", "hi").union(copies)
        return docs, keep(by_text.groupBy("d1", "d2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


def cut(text: str | None, spans: list[dict] | None) -> tuple[bytes, bytes, list[tuple[int, int]]]:
    """(all bytes, bytes that stay, merged spans)."""
    data = (text or "").encode("utf-8")
    runs = merged([(s["lo"], s["hi"]) for s in (spans if spans is not None else [])])
    kept, at = [], 0
    for lo, hi in runs:
        kept.append(data[at:lo])
        at = hi
    return data, b"".join([*kept, data[at:]]), runs


def with_spans(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (d1, d2 and others) in two tables: those that surely lose nothing, and the others with their spans (or null).
    Only the others are shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(id_filter(spans.select("d1")))
    clean, other = (filtered(docs, "d1", held, inside) for inside in (False, True))
    return clean, other.join(spans, ["d1", "d2"], "left")


def digests(docs: DataFrame, **how) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_bytes, n_removed, n_spans, kept_sha256, text (what stays; a character that a cut
    splits goes)."""
    docs, spans = repeated(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), **how)

    def run(batches):
        for batch in _slices(batches):
            rows = [(i, *cut(t, s)) for i, t, s in zip(*(batch.column(k).to_pylist() for k in range(3)))]
            out = [[r[0] for r in rows], [len(r[1]) for r in rows], [len(r[1]) - len(r[2]) for r in rows], [len(r[3]) for r in rows], [hashlib.sha256(r[2]).hexdigest() for r in rows], [r[2].decode("utf-8", "ignore") for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, [pa.int64()] * 4 + [pa.string()] * 2)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    clean, other = with_spans(docs, spans)
    zero, t = F.lit(0).cast("long"), F.coalesce(F.col("text"), F.lit(""))
    same = clean.select("row.doc_id", F.octet_length(t).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(t, 256).alias("kept_sha256"), t.alias("text"))
    return same.union(other.select("row.doc_id", "text", "spans").mapInArrow(run, DIGEST))


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """docs with repeated strings cut out of text; n_chars, where present, follows. A character that a cut splits goes."""
    columns = docs.columns
    docs, spans = repeated(docs, **how)
    return _without(docs, spans, columns)


def passages(docs: DataFrame) -> DataFrame:
    """docs without the passages of over 50 words that occur more than once, whatever their case and white space, and
    without repeated strings of LEAST bytes, which may have fewer words; both are found in the texts as they come. White
    space behind a passage goes with it."""
    columns = docs.columns
    both, of_bytes = repeated(docs)
    _, of_words = repeated(docs, words=True, **PASSAGE)
    none = F.lit(None).cast(of_words.schema["spans"].dataType)
    rows = of_bytes.withColumn("words", none).union(of_words.select("d1", "d2", none, F.col("spans")))
    spans = rows.groupBy("d1", "d2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("words")).alias("words"))
    return _without(both, spans, columns)


def _in_bytes(text: str, words) -> list[dict]:
    """Ranges of words as ranges of bytes; white space behind a range goes with it."""
    starts = [*word_bounds(text.encode("utf-8"))[0].tolist(), len(text.encode("utf-8"))] if len(words) else []
    return [{"lo": starts[x["lo"]], "hi": starts[x["hi"]]} for x in words]


def _without(docs: DataFrame, spans: DataFrame, columns: list[str]) -> DataFrame:
    """docs (with digests) without their spans (and words, where there are any), in the given columns."""
    if "words" not in spans.columns:
        spans = spans.withColumn("words", F.slice("spans", 1, 0))
    clean, other = with_spans(docs, spans)

    # One function: each that feeds another has a Python worker of its own, and those stay with what later stages load. It takes
    # Arrow, so that the workers don't load pandas.
    @F.arrow_udf("string")
    def kept(texts: pa.Array, spans: pa.Array, words: pa.Array) -> pa.Array:
        rows = zip(*(x.to_pylist() for x in (texts, spans, words)))
        return pa.array([t if s is None or t is None else cut(t, [*s, *_in_bytes(t, w)])[1].decode("utf-8", "ignore") for t, s, w in rows], pa.string())

    def named(df: DataFrame, text: F.Column, n_chars: F.Column) -> DataFrame:
        return df.select(*[text.alias("text") if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in columns])

    n_chars = F.col("row.n_chars") if "n_chars" in columns else F.lit(0)
    changed = other.withColumn("kept", F.when(F.col("spans").isNotNull(), kept("text", "spans", "words")).otherwise(F.col("text")))
    length = F.when(F.col("spans").isNotNull(), F.length("kept")).otherwise(n_chars)
    if "n_chars" in columns:
        length = length.cast(docs.schema["row"].dataType["n_chars"].dataType)
    return named(clean, F.col("text"), n_chars).union(named(changed, F.col("kept"), length))
