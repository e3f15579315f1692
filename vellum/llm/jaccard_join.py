"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct k-word shingles. Sets are ordered by an estimate of their shingles' frequency, rarest
first: the corpus's most frequent shingles (a fixed number) have a level, all others come before them by their hash. Two
sets whose Jaccard similarity reaches the threshold share at least l shingles among their first |set| - t + l, for every l
up to t = ceil(threshold * |set|).

Each document has its own l. It grows with the estimated candidates (the lengths of the lists that its prefix stands in), and
until fewer than l of its prefix shingles have long lists: then any partner shares a shingle with a short list too, so long
lists need not be read for it. Pairs that share as many prefix shingles as the smaller l asks are verified on whole sets.
Short lists are paired whole, rows bounded by their length, so candidates grow in proportion to the documents.

Documents with long lists throughout their longest prefix are dense: members of large groups of near copies. Among them
alone long lists are read, of each document those that most others are in, as many as any partner must share one of.

Lists of many documents are read by stars: each has a hub, and the others of the list are told apart by their differences from
it (shingles of one that the other lacks). Two documents that are not both linked with the hub and are linked share a part of
their differences that grows with them, so these have short prefixes too, rarest first; what all members of a group have is no
longer among them, and members just under the threshold do not meet each other. A document far from the hub stays in the list
for the next hub, and a list of differences that is long itself is read by a star in the next round.

What is left are short lists, and those that stars did not divide: a growing number of hubs is paired with the members of other
components found so far; a hub is then done and leaves the list, and lists inside one component are dropped, so no link that
joins two components is lost. Pairs of them are verified if their whole prefixes share as many shingles as the smaller l asks,
so that documents with a few paragraphs in common are not.

Copies of one set are one class, represented by its smallest doc_id.

Rows: null texts and texts without words have an empty set and are linked with nothing. Fewer words than k are one shingle.
Rows with one doc_id are one document for linking. A null doc_id is returned with a null component and not linked. Very long
texts are one row's array of 64-bit hashes. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import bit_test, delete, filtered, id_filter, keep, materialize, new_path, scratch, where_computed
from vellum.llm.components import components

#: Shingles that have a frequency level, at most (1.2 MB).
FREQUENT = 1 << 17
#: Shingles counted at a time in a task; those met once among them are not passed on.
CHUNK = 2_000_000
#: Bytes of text whose words are hashed at a time.
SEGMENT = 1 << 18
#: Lists up to this length are paired whole.
SHORT = 12
LEAST_MATCHES, MOST_MATCHES = 3, 6
#: Lists of dense documents over this length are read by stars, so often at most.
LONG, ROUNDS = 32, 3
#: Lists of differences up to this length are paired.
PAIRED = 256


def most_matches(n):
    """The largest l of a set of n shingles: chance matches grow with the prefix, so long sets may ask for more."""
    return MOST_MATCHES + n // 32


def least_overlap(n, percent: int):
    return (n * percent + 99) // 100


def listed(n, percent: int):
    """The l up to which a set's prefix is listed: the largest of any set that it can be linked with."""
    return most_matches(100 * n // percent)


def _mixed(h):
    import numpy as np

    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


class _Words:
    """64-bit hashes of the words of a piece of text, all at once: polynomials of their bytes, from running sums."""

    BASE = 0x9E3779B97F4A7C15
    powers: list = []

    @classmethod
    def hashes(cls, data: bytes):
        """(hashes, where each word begins), words being runs of bytes other than ASCII white space."""
        import numpy as np

        b = np.frombuffer(data, np.uint8)
        inside = np.zeros(len(b) + 2, bool)
        np.logical_and(b != 32, (b < 9) | (b > 13), out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        lo, hi = edges[::2], edges[1::2]
        if not cls.powers or len(cls.powers[0]) <= len(b):
            size = max(2 * SEGMENT, len(b) + 1)
            ups = [np.full(size, np.uint64(x), np.uint64) for x in (cls.BASE, pow(cls.BASE, -1, 1 << 64))]
            for up in ups:
                up[0] = 1
                np.multiply.accumulate(up, out=up)
            # A very long text's tables are not held.
            if size == 2 * SEGMENT:
                cls.powers = ups
        else:
            ups = cls.powers
        codes = np.random.Generator(np.random.PCG64(1)).integers(1, 1 << 63, 256, np.uint64)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(codes[b] * ups[0][: len(b)], out=sums[1:])
        return _mixed((sums[hi] - sums[lo]) * ups[1][lo] + (hi - lo).astype(np.uint64)), lo


def shingle_sets(texts: list[str | None], k: int) -> list:
    """Sorted distinct 64-bit hashes of each text's k-word shingles."""
    import numpy as np

    out: list = []
    held: list[bytes] = []
    size = 0

    def put():
        nonlocal held, size
        ends = np.cumsum([len(t) + 1 for t in held])
        w, at = _Words.hashes(b"\n".join(held))
        upto = np.searchsorted(at, ends)
        rolled = np.full(len(w), k, np.uint64)
        for i in range(k):
            rolled[: len(w) - i] = _mixed((rolled[: len(w) - i] ^ w[i:]) * np.uint64(_Words.BASE))
        first = 0
        for last in upto.tolist():
            n = last - first
            if n >= k:
                s = np.sort(rolled[first : last - k + 1])
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            else:
                # The whole sequence, with its length.
                s = np.zeros(min(n, 1), np.uint64)
                for x in w[first:last]:
                    s = _mixed((s ^ x ^ np.uint64(n)) * np.uint64(_Words.BASE))
            out.append(s)
            first = last
        held, size = [], 0

    for t in texts:
        data = t.encode("utf-8").lower() if t else b""
        if held and size + len(data) > SEGMENT:
            put()
        held.append(data)
        size += len(data) + 1
    if held:
        put()
    return out


def _each(batches, k: int, rows: int = 256):
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            some = batch.slice(lo, rows)
            yield some, shingle_sets(some.column(1).to_pylist(), k)


def _count(k: int):
    def run(batches):
        import numpy as np

        met: set = set()
        held, size = [], 0

        def several():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            some = n > 1
            return pa.RecordBatch.from_arrays([pa.array(values[some].view(np.int64)), pa.array(n[some])], ["shingle", "n"])

        for _, sets in _each(batches, k):
            for s in sets:
                d = _digest(s)
                if d not in met:  # copies count once in a task
                    if len(met) < 50_000:
                        met.add(d)
                    held.append(s)
                    size += len(s)
            if size >= CHUNK:
                yield several()
                held, size = [], 0
        if held:
            yield several()

    return run


def frequency_levels(docs: DataFrame, k: int):
    """The most frequent shingles, sorted, and their levels: 1 + log2 of their counts over the whole corpus."""
    import numpy as np

    counts = docs.mapInArrow(_count(k), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = materialize(counts.withColumn("level", F.floor(F.log2("n")).cast("int")), "counts")
    cut, room = 64, FREQUENT
    for level, n in sorted(counts.groupBy("level").count().collect(), reverse=True):
        room -= n
        if room < 0:
            break
        cut = level
    found = counts.where(F.col("level") >= cut).select("shingle", "level").toArrow()
    shingles = found["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], (1 + found["level"].to_numpy()[order]).astype(np.uint8)


def _levels_of(s, frequent, levels, filled):
    """The level of each shingle, 0 for those that are not frequent."""
    import numpy as np

    out = np.zeros(len(s), np.uint8)
    at = np.flatnonzero(filled[(s >> np.uint64(44)).astype(np.int64)])
    if len(at):
        place = np.minimum(np.searchsorted(frequent, s[at]), len(frequent) - 1)
        out[at] = np.where(frequent[place] == s[at], levels[place], 0)
    return out


FEATURES = "row long, doc_id long, n long, d1 long, d2 long, plain int, prefix array<long>"


def _features(k: int, percent: int, levels):
    """plain: how many of the prefix, its first ones, have no level."""

    def run(batches):
        import numpy as np

        frequent, level = levels.value
        filled = np.zeros(1 << 20, bool)
        filled[(frequent >> np.uint64(44)).astype(np.int64)] = True
        nth = TaskContext.get().partitionId() << 36
        for batch, sets in _each(batches, k):
            rows = pa.array(range(nth, nth + len(sets)), pa.int64())
            nth += len(sets)
            n = [len(s) for s in sets]
            digests = [_digest(s) for s in sets]
            prefixes, plain = [], []
            for s in sets:
                lev = _levels_of(s, frequent, level, filled)
                size = len(s) - least_overlap(len(s), percent) + listed(len(s), percent)
                first = s[lev == 0][:size]
                plain.append(len(first))
                if len(first) < size:
                    first = s[np.argsort(lev, kind="stable")[:size]]
                prefixes.append(first.view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes)))
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), pa.array(n, pa.int64()), pa.array([_signed(d >> 64) for d in digests], pa.int64()), pa.array([_signed(d) for d in digests], pa.int64()), pa.array(plain, pa.int32()), prefix], ["row", "doc_id", "n", "d1", "d2", "plain", "prefix"])

    return run


def _digest(shingles) -> int:
    import xxhash

    return xxhash.xxh3_128_intdigest(shingles.tobytes())


def _signed(v: int) -> int:
    return (v & (2**64 - 1)) - ((v >> 63 & 1) << 64)


def _sets(k: int, held):
    """Sets of the texts (hash of doc_id, text) that a filter of ids may hold."""

    def run(batches):
        import numpy as np

        for batch in batches:
            batch = batch.filter(pa.array(bit_test(held.value, batch.column(0))))
            for _, sets in _each([batch], k):
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                d = [_digest(x) for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array([_signed(x >> 64) for x in d], pa.int64()), pa.array([_signed(x) for x in d], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], ["d1", "d2", "shingles"])

    return run


def link(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_shingles, component_id: components of links with 100 * common >= percent * union."""
    if not 1 <= percent <= 100 or k < 1:
        raise ValueError("percent must be from 1 to 100, k at least 1")
    with scratch(docs.sparkSession):
        return _link(docs, k, percent)


def _matches(percent: int) -> tuple[F.Column, F.Column]:
    """(l, prefix shingles with long lists) of a set with n, plain and entries (at, shingle, df); l is null if none will do."""
    n, plain = F.col("n"), F.col("plain")
    t = F.floor((n * percent + 99) / 100).cast("int")
    short = (n - t).cast("int")
    most = F.least(F.lit(MOST_MATCHES) + F.floor(n / 32).cast("int"), t)
    entries = F.coalesce("entries", F.array().cast("array<struct<at:int,shingle:bigint,df:bigint>>"))
    far = F.transform(F.filter(entries, lambda x: x["df"] > SHORT), lambda x: x["at"])
    n_long = lambda l: F.size(F.filter(far, lambda x: x < short + l)) + F.greatest(short + l - plain, F.lit(0))
    cost = F.aggregate(F.filter(entries, lambda x: (x["at"] < short + LEAST_MATCHES) & (x["df"] <= SHORT)), F.lit(0).cast("long"), lambda s, x: s + x["df"] - 1)
    wanted = F.least(most, F.lit(LEAST_MATCHES) + F.floor(cost / 4).cast("int"))
    first = lambda lo, spare: F.get(F.filter(F.sequence(lo, most), lambda l: n_long(l) + spare <= l), F.lit(0))
    # Two short lists are better than one: fewer pairs meet by chance.
    l = F.coalesce(first(wanted, 2), first(F.least(most, F.lit(LEAST_MATCHES)), 2), first(F.lit(1), 1))
    return l, n_long


def _joined(found: DataFrame, more: DataFrame) -> DataFrame:
    """Components with more links (a, b); those found before need one link a node."""
    return components(found.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more))


def _longest_lists(of_dense: DataFrame, percent: int) -> DataFrame:
    """Entries (shingle, node, n) of each document in its longest lists. Two linked documents share as many prefix shingles as
    the smaller l asks, so they share one of all but that many lists less one, in any order."""
    least = F.floor((F.col("n") * percent + 99) / 100).cast("int")
    shared = F.least(F.lit(MOST_MATCHES) + F.floor(least / 32).cast("int"), F.floor((least * percent + 99) / 100).cast("int"))
    length = of_dense.groupBy("shingle").agg(F.count("*").alias("docs"))
    lists = of_dense.join(length, "shingle").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("docs", "shingle")), False).alias("xs"))
    lists = lists.select("node", "n", F.explode(F.slice("xs", F.lit(1), F.greatest(F.size("xs") - shared + 1, F.lit(0)))).alias("x"))
    return materialize(lists.where("x.docs > 1").select("x.shingle", "node", "n"), "longest_lists")


def _stars(lists: DataFrame, sets: DataFrame, found: DataFrame, percent: int, verified) -> tuple[DataFrame, DataFrame]:
    """Entries (shingle, node, n) of the lists that are not settled, and components of all links.

    D is the size of the difference of a document and its hub. |x ^ y| = Dx + Dy - 2 |common part of their differences|, and
    it is at most (100 - percent) / (100 + percent) * (nx + ny) if x and y are linked; that is `apart` for x at most."""
    hubs_before = short = None
    # Documents up to `done` from a hub have all their partners up to `near` from it.
    done = F.floor(F.col("h_n") / 3)
    near = done + F.floor((100 - percent) * (F.col("h_n") + done) / percent)
    apart = F.floor((100 - percent) * F.col("n") / percent)
    for _ in range(ROUNDS):
        known = lists.join(found, "node", "left").select("shingle", "node", "n", F.coalesce("comp", "node").alias("comp"))
        open_lists = known.groupBy("shingle").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("docs")).where("x <> y").select("shingle", "docs")
        known = materialize(known.join(open_lists, "shingle").select("shingle", "node", "n", "docs"), "open_lists")
        few, many = known.where(F.col("docs") <= LONG).select("shingle", "node", "n"), known.where(F.col("docs") > LONG)
        short = few if short is None else short.union(few)
        lists = many.select("shingle", "node", "n")
        if many.isEmpty():
            break
        # The document that meets most others, so that the lists of a group have one hub.
        score = many.groupBy("node").agg(F.sum("docs").alias("score"))
        if hubs_before is not None:
            score = score.join(hubs_before.withColumn("before", F.lit(True)), "node", "left").select("node", F.when(F.col("before"), 0).otherwise(F.col("score")).alias("score"))
        hub = many.join(score, "node").groupBy("shingle").agg(F.max(F.struct("score", "node", "n")).alias("hub"))
        hub = materialize(hub.select("shingle", F.col("hub.node").alias("h"), F.col("hub.n").alias("h_n")), "hubs")
        of_hub = materialize(lists.join(hub, "shingle").where("node <> h"), "of_hub")
        pairs = of_hub.where(F.abs(F.col("n") - F.col("h_n")) <= near).select("node", "n", "h", "h_n").distinct()
        both = pairs.join(sets.select(F.col("node").alias("h"), F.col("shingles").alias("h_shingles")), "h").join(sets, "node")
        differ = F.concat(F.array_except("shingles", "h_shingles"), F.array_except("h_shingles", "shingles"))
        stars = where_computed(both.select("h", "h_n", "node", "n", differ.alias("differ")), F.size("differ") <= near)
        stars = materialize(stars.withColumn("d", F.size("differ")), "stars")
        total = F.col("n") + F.col("h_n")
        new = stars.where(100 * (total - F.col("d")) >= percent * (total + F.col("d")))
        found = _joined(found, new.select(F.col("node").alias("a"), F.col("h").alias("b")))

        # Documents of other components than their hub's are `out`; of two in different components, one is.
        named = stars.join(found, "node", "left").join(found.select(F.col("node").alias("h"), F.col("comp").alias("h_comp")), "h", "left")
        named = named.withColumn("comp", F.coalesce("comp", "node")).withColumn("out", F.col("comp") != F.coalesce("h_comp", "h"))
        named = materialize(named.select("h", "node", "n", "d", "comp", "out", F.explode("differ").alias("el")), "differences")
        # The others' differences come first in the order, since no document out has them; so do those of one document.
        several = named.groupBy("h", "el").agg(F.count("*").alias("docs"), F.max("out").alias("out")).where("docs > 1 and out").select("h", "el", "docs")
        kept = named.join(several, ["h", "el"]).groupBy("h", "node", "n", "d", "comp", "out").agg(F.array_sort(F.collect_list(F.struct("docs", "el"))).alias("els"))
        kept = kept.select("h", "node", "n", "d", "comp", "out", F.size("els").alias("size"), F.posexplode("els").alias("at", "x")).withColumn("at", F.col("at") + F.col("d") - F.col("size"))
        # most: the largest difference of a partner that has none in common before this one.
        most = 2 * (F.col("d") - F.col("at")) + apart - F.col("d")
        kept = kept.where(F.col("at") <= F.col("d") - F.greatest(F.lit(1), F.col("d") - apart))
        kept = materialize(kept.select("h", "x.el", "node", "n", "d", "comp", "out", most.alias("most")), "kept_differences")
        least = kept.groupBy("h", "el").agg(F.min(F.when(F.col("out"), F.col("d"))).alias("least_out"), F.min("d").alias("least"))
        kept = kept.join(least, ["h", "el"]).where(F.col("most") >= F.when(F.col("out"), F.col("least")).otherwise(F.col("least_out")))
        kept = materialize(kept.drop("least", "least_out"), "met_differences")
        length = kept.groupBy("h", "el").agg(F.count("*").alias("docs"), F.max("out").alias("some_out")).where("docs > 1 and some_out").select("h", "el", "docs")
        kept = materialize(kept.join(length, ["h", "el"]), "lists_of_differences")
        paired = kept.where(F.col("docs") <= PAIRED)
        y = paired.select("h", "el", *[F.col(c).alias(f"y_{c}") for c in ("node", "n", "d", "comp", "out", "most")])
        pairs = paired.where("out").join(y, ["h", "el"]).where("comp <> y_comp and (not y_out or node < y_node) and d <= y_most and y_d <= most")
        pairs = pairs.where(100 * F.least("n", "y_n") >= percent * F.greatest("n", "y_n"))
        more = verified(materialize(pairs.select(F.least("node", "y_node").alias("a"), F.greatest("node", "y_node").alias("b")).distinct(), "hub_pairs"))
        if not more.isEmpty():
            found = _joined(found, more)

        settled = stars.where(F.col("d") <= done).select("node", "h")
        lists = of_hub.join(settled, ["node", "h"], "left_anti").select("shingle", "node", "n")
        lists = materialize(lists.union(kept.where(F.col("docs") > PAIRED).select(F.xxhash64("h", "el").alias("shingle"), "node", "n")), "lists")
        before = hub.select(F.col("h").alias("node")).distinct()
        hubs_before = before if hubs_before is None else hubs_before.union(before).distinct()
    return short.union(lists), found


def _link(docs: DataFrame, k: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    levels = spark.sparkContext.broadcast(frequency_levels(docs, k))
    # Tables with prefixes or their entries are the largest; each goes once what is made of it is written.
    at = {name: new_path(spark, name) for name in ("features", "classes", "entries")}
    feats = materialize(docs.mapInArrow(_features(k, percent, levels), FEATURES), path=at["features"])
    own = materialize(feats.select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("d1")).alias("d1"), "d2"), "own")

    # A class is named by one of its rows; its smallest doc_id stands for it in the result. Only rows that may have copies
    # are shuffled to find them.
    real = feats.where("n > 0 and doc_id is not null")
    copied = real.groupBy("d1", "d2").agg(F.count("*").alias("copies"), F.min("row").alias("first"), F.min("doc_id").alias("least")).where("copies > 1")
    copied = materialize(copied, "copied")
    held = spark.sparkContext.broadcast(id_filter(copied.select("d1")))
    names = ["row", "d1", "d2", "rep", "n", "plain", "prefix"]
    single = filtered(real, "d1", held, False).withColumn("rep", F.col("doc_id"))
    chosen = filtered(real, "d1", held, True).join(copied, ["d1", "d2"], "left").where("first is null or row = first").withColumn("rep", F.coalesce("least", "doc_id"))
    classes = materialize(single.select(*names).union(chosen.select(*names)).withColumnRenamed("row", "node"), path=at["classes"])
    delete(spark, at["features"])
    named = materialize(classes.select("node", "d1", "d2", "rep"), "named")

    # One shuffle by shingle serves the counts and their join. Shingles with a level are long without being counted.
    members = classes.select("node", F.posexplode(F.slice("prefix", 1, F.col("plain"))).alias("at", "shingle")).repartition("shingle")
    length = members.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    entries = members.join(length.hint("shuffle_hash"), "shingle").groupBy("node").agg(F.collect_list(F.struct("at", "shingle", "df")).alias("entries"))
    l, n_long = _matches(percent)
    largest = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + MOST_MATCHES + F.floor(F.floor(100 * F.col("n") / percent) / 32)
    asked = classes.select("node", "n", "plain").join(entries, "node", "left").where(F.col("entries").isNotNull() | (F.col("plain") < F.least(F.col("n"), largest)))
    asked = materialize(asked.withColumn("own", l), path=at["entries"])
    listed_l = (F.lit(MOST_MATCHES) + F.floor(F.floor(100 * F.col("n") / percent) / 32)).cast("int")
    asked = asked.withColumn("l", F.coalesce("own", listed_l)).withColumn("n_long", n_long(F.col("l")))
    short = F.col("n") - F.floor((F.col("n") * percent + 99) / 100)
    near = F.filter("entries", lambda x: (x["df"] <= SHORT) & (x["at"] < short + F.col("l")))
    one = asked.select(F.struct(F.col("n").cast("int").alias("n"), "node", F.col("l").cast("int").alias("l"), F.col("n_long").cast("int").alias("n_long")).alias("x"), F.explode(F.transform(near, lambda x: x["shingle"])).alias("shingle"))

    sized = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    # A list holds SHORT documents at most.
    lists = one.groupBy("shingle").agg(F.array_sort(F.collect_list("x")).alias("xs")).where(F.size("xs") > 1)
    pairs = F.flatten(F.transform("xs", lambda x, i: F.transform(F.filter(F.slice("xs", i + 2, SHORT), lambda y: sized(x["n"], y["n"])), lambda y: F.struct(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b"), (F.least(x["l"], y["l"]) - F.least(x["n_long"], y["n_long"])).alias("asked")))))
    met = lists.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("met"), F.min("p.asked").alias("asked")).where("met >= asked")
    met = materialize(met.select("a", "b"), "met")

    # Dense documents: their whole prefixes, in lists among themselves.
    dense = materialize(asked.where("own is null").select("node"), "dense")
    delete(spark, at["entries"])
    of_dense = materialize(classes.join(dense, "node", "left_semi").select("node", "n", F.explode("prefix").alias("shingle")), "of_dense")

    # Sets of all documents that may be compared, made in one scan.
    nodes = met.select(F.explode(F.array("a", "b")).alias("node")).union(dense).distinct()
    ids = materialize(named.join(nodes, "node", "left_semi"), "ids")
    held = spark.sparkContext.broadcast(id_filter(ids.select("rep")))
    rows = docs.where("doc_id is not null and text is not null").select(F.xxhash64("doc_id"), "text")
    sets = rows.mapInArrow(_sets(k, held), "d1 long, d2 long, shingles array<long>").groupBy("d1", "d2").agg(F.first("shingles").alias("shingles"))
    sets = materialize(sets.join(ids, ["d1", "d2"]).select("node", "shingles"), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs whose whole sets reach the threshold."""
        some = sets.join(materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "compared"), "node", "left_semi")
        of = lambda x: some.select(F.col("node").alias(x), F.col("shingles").alias(f"{x}_shingles"))
        both = pairs.join(of("b"), "b").join(of("a"), "a")
        n_a, n_b, common = F.size("a_shingles"), F.size("b_shingles"), F.size(F.array_intersect("a_shingles", "b_shingles"))
        return materialize(both.where(100 * common >= percent * (n_a + n_b - common)).select("a", "b"), "links")

    # Dense pairs, too, must share as many shingles of their whole prefixes as the smaller l asks.
    t = F.floor((F.col("n") * percent + 99) / 100).cast("int")
    prefixes = materialize(classes.join(dense, "node", "left_semi").select("node", "prefix", F.least(F.lit(MOST_MATCHES) + F.floor(F.col("n") / 32).cast("int"), t).alias("l")), "prefixes")
    delete(spark, at["classes"])

    def multi_matched(pairs: DataFrame) -> DataFrame:
        of = lambda x: prefixes.select(F.col("node").alias(x), F.col("prefix").alias(f"{x}_prefix"), F.col("l").alias(f"{x}_l"))
        both = pairs.join(of("b"), "b").join(of("a"), "a")
        return both.where(F.size(F.array_intersect("a_prefix", "b_prefix")) >= F.least("a_l", "b_l")).select("a", "b")

    links = verified(met)
    # Several texts under one doc_id are linked by it.
    real = own.where("n > 0 and doc_id is not null")
    several = real.groupBy("doc_id").agg(F.min("d1").alias("x"), F.max("d1").alias("y"), F.min("d2").alias("z"), F.max("d2").alias("w")).where("x <> y or z <> w").select("doc_id")
    same = real.join(several, "doc_id", "left_semi").select("doc_id", "d1", "d2").join(named, ["d1", "d2"]).select("doc_id", "node")
    same = same.join(same.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")).where("a <> b")
    links = links.union(materialize(same, "same_ids"))
    long_lists, found = _stars(_longest_lists(of_dense, percent), sets, components(links), percent, verified)
    hubs, first = 1, True
    while True:
        known = long_lists.join(found, "node", "left").select("shingle", "node", "n", F.coalesce("comp", "node").alias("comp"))
        known = known.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(hubs)) if hubs > 1 else F.lit(0))
        open_lists = known.groupBy("shingle").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("shingle")
        known = materialize(known.join(open_lists, "shingle", "left_semi"), "open_lists")
        if known.isEmpty():
            break
        hub = known.groupBy("shingle", "salt").agg(F.min(F.struct("node", "n", "comp")).alias("hub")).select("shingle", "hub.*").toDF("shingle", "h_node", "h_n", "h_comp")
        pairs = known.join(hub, "shingle").where((F.col("comp") != F.col("h_comp")) & sized(F.col("n"), F.col("h_n")))
        pairs = pairs.groupBy("node", "h_node").agg(F.count("*").alias("lists"))
        if first:
            # Each document with the hub that it shares most lists with: that joins most of a group at once.
            pairs = pairs.groupBy("node").agg(F.max_by("h_node", F.struct("lists", "h_node")).alias("h_node"))
        more = verified(materialize(multi_matched(pairs.select(F.least("h_node", "node").alias("a"), F.greatest("h_node", "node").alias("b")).distinct()), "hub_pairs"))
        if not more.isEmpty():
            found = _joined(found, more)
        if first:
            first = False
            continue
        # A hub has met every member of its list.
        long_lists = materialize(known.select("shingle", "node", "n").join(hub.select("shingle", F.col("h_node").alias("node")), ["shingle", "node"], "left_anti"), "long_lists")
        hubs *= 8

    comps = named.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    comps = comps.join(comps.groupBy("comp").agg(F.min("rep").alias("component_id")), "comp").select("d1", "d2", "component_id")
    out = own.join(comps, ["d1", "d2"], "left")
    return keep(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), "linked")
