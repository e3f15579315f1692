"""Joins of the values of documents with the entries of their packages, over all packages at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import lexical as L
from vellum.sources.shared import written


KINDS = ("name", "part", "folded")


def _ways(value: Column, part: Column, after: int = 0) -> list[tuple[int, str, Column]]:
    """How a value is looked up, as (precedence, kind, key). part: the part that it names once white space around it is gone."""
    without = lambda c: F.regexp_replace(c, "^/+", "")
    bare = L.stripped(value)
    ways = [("name", value), ("name", without(value)), ("name", bare), ("name", without(bare)), ("name", part), ("part", part), ("folded", L.ascii_folded(part))]
    return [(after + n, kind, key) for n, (kind, key) in enumerate(ways)]


def _asked(df: DataFrame, keys: list[str], ways: list[tuple[int, str, Column]]) -> DataFrame:
    """keys, key and a column a kind: the first precedence with which the key is looked up so, null where it isn't. Ways that spell
    a key alike are one row."""
    named = [f"__{n}" for n, _, _ in ways]
    rows = df.select(*keys, *[key.alias(name) for name, (_, _, key) in zip(named, ways)])
    # A spelling that an earlier way has is no row of its own.
    once = [F.when(~F.coalesce(F.col(name).isin(*map(F.col, named[:i])), F.lit(False)), F.col(name)) if i else F.col(name) for i, name in enumerate(named)]
    rows = rows.select("*", F.explode(F.array(*once)).alias("key")).where("key is not null")
    first = lambda kind: F.coalesce(*[F.when(F.col(name) == F.col("key"), F.lit(n)) for name, (n, k, _) in zip(named, ways) if k == kind])
    return rows.select(*keys, "key", *[first(kind).alias(kind) for kind in KINDS])


def _held(entries: DataFrame, doc: str) -> DataFrame:
    """doc, key and a column a kind: the first entry (nth, name) that has the key as its name, as its resolved name, or as that with
    ASCII letters in lower case; null where none has."""
    own = entries.select(doc, "nth", "name", L.part_of(F.col("name")).alias("part"))
    own = own.withColumn("folded", L.ascii_folded(F.col("part")))
    other = lambda a, *b: F.when(~F.coalesce(F.col(a).isin(*map(F.col, b)), F.lit(False)), F.col(a))
    each = own.select("*", F.explode(F.array(F.col("name"), other("part", "name"), other("folded", "name", "part"))).alias("key")).where("key is not null")
    return each.groupBy(doc, "key").agg(*[F.min(F.when(F.col("key") == F.col(kind), F.struct("nth", F.col("name").alias("entry")))).alias(f"of_{kind}") for kind in KINDS])


def _met(asked: DataFrame, held: DataFrame, doc: str, keys: list[str]) -> DataFrame:
    """keys, entry: what the first way that finds an entry finds."""
    found = F.least(*[F.when(F.col(kind).isNotNull() & F.col(f"of_{kind}").isNotNull(), F.struct(F.col(kind).alias("precedence"), F.col(f"of_{kind}").alias("entry"))) for kind in KINDS])
    met = asked.join(held, [doc, "key"]).select(*keys, found.alias("x")).where("x is not null")
    return met.groupBy(*keys).agg(F.min("x").alias("x")).select(*keys, F.col("x.entry.entry").alias("entry"))


def resolved(values: DataFrame, entries: DataFrame, doc: str = "doc") -> DataFrame:
    """Which entry each value names, null if none: doc, value, entry.

    values: doc, value. entries: doc, nth (order in the package), name. A value is looked up as it is written, without leading
    slashes, without white space around it, then without both, then resolved: among names, among resolved names, among those
    with ASCII letters in lower case. The first way that finds an entry decides, and of its entries the first in the package.
    A null value, or one that names no part, has a null entry. All ways are keys of one join."""
    asked = values.select(doc, "value").distinct()
    ways = asked.where("value is not null").withColumn("__part", L.part_of(L.stripped(F.col("value"))))
    best = _met(_asked(ways, [doc, "value"], _ways(F.col("value"), F.col("__part"))), _held(entries, doc), doc, [doc, "value"])
    best = best.select(F.col(doc).alias("__doc"), F.col("value").alias("__value"), "entry")
    return asked.join(best, F.col(doc).eqNullSafe(F.col("__doc")) & F.col("value").eqNullSafe(F.col("__value")), "left").select(doc, "value", "entry")


def carrying(values: DataFrame, entries: DataFrame, doc: str = "doc") -> DataFrame:
    """What a value that names no entry may mean: the entries with its file name. doc, value, n (how many), alike (all of one
    size and checksum), first (in the package's order); values without any are absent.

    entries: doc, nth, name, size, crc. Entries are counted before they are joined, so a name that many share is one row."""
    held = entries.withColumn("file", L.file_name(F.col("name"))).where("file <> ''")
    same = F.struct("size", "crc")
    held = held.groupBy(doc, "file").agg(F.count("*").alias("n"), F.min(same).eqNullSafe(F.max(same)).alias("alike"), F.min(F.struct("nth", "name")).alias("x"))
    asked = values.select(doc, "value").distinct().withColumn("file", L.file_name(F.col("value")))
    return asked.join(held, [doc, "file"]).select(doc, "value", "n", "alike", F.col("x.name").alias("first"))


#: Where relationship types are named, and the types of the chain.
TYPES = ("http://admin-shell.io/aasx/relationships/", "http://www.admin-shell.io/aasx/relationships/")


def _is(kind: str) -> Column:
    return F.col("type").isin(*[t + kind for t in TYPES])


def targets(relationships: DataFrame, entries: DataFrame, doc: str = "doc") -> DataFrame:
    """relationships (doc, source: '' for the package, nth, type, target, external) with `to`, the part that a target names, read from
    its source's folder (an entry as it is written in the package; without one the resolved name, or the target itself if it names
    no part), `inside` (is it neither external nor an address with a scheme?) and `held` (is there such an entry?)."""
    return _targets(relationships, _held(entries, doc), doc)


def _targets(relationships: DataFrame, held: DataFrame, doc: str) -> DataFrame:
    inside = ~F.coalesce("external", F.lit(False)) & L.scheme(F.col("target")).isNull()
    folder = F.regexp_extract("source", "(?s)^(.*)/[^/]*$", 1)
    put = lambda t: F.when(t.startswith("/"), F.substring(t, 2, 1 << 30)).when(folder == "", t).otherwise(F.concat(folder, F.lit("/"), t))
    bare = L.stripped(F.col("target"))
    asked = relationships.withColumn("inside", inside).withColumn("value", F.when(F.col("inside"), put(F.col("target")))).withColumn("settled", F.when(F.col("inside") & (bare != F.col("target")), put(bare)))
    # Each way that a target may be meant meets the package's entries once: as it is written, then without white space around it.
    keys = [doc, "value", "settled"]
    parts = asked.select(*keys).where("value is not null").distinct().select(*keys, L.part_of(L.stripped(F.col("value"))).alias("__first"), L.part_of(L.stripped(F.col("settled"))).alias("__second"))
    first, second = _ways(F.col("value"), F.col("__first")), _ways(F.col("settled"), F.col("__second"), after=100)
    found = _met(_asked(parts, keys, first + second), held, doc, keys)
    found = found.select(F.col(doc).alias("__doc"), F.col("value").alias("__value"), F.col("settled").alias("__settled"), "entry")
    same = (F.col(doc) == F.col("__doc")) & (F.col("value") == F.col("__value")) & F.col("settled").eqNullSafe(F.col("__settled"))
    met = asked.join(found, same, "left")
    to = F.coalesce("entry", F.when(F.col("inside"), L.part_of(F.col("value"))), "target")
    return met.select(*relationships.columns, to.alias("to"), "inside", F.col("entry").isNotNull().alias("held"))


def chain(relationships: DataFrame, entries: DataFrame, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(steps, refusals): from the package to its first origin, from that to its distinct spec parts in first-seen order, from those to
    what they hold beside. steps: doc, step (origin, spec, suppl), nth, source, to, inside, held. refusals: doc, why (no origin,
    foreign origin: one of another vocabulary, no spec). Packages without any relationship of their own are no rows of either."""
    # Only relationships of the chain are resolved: the origins and specs once for all that follows, what lies beside as it is asked.
    held = written(_held(entries, doc))
    origin = (F.col("source") == "") & _is("aasx-origin")
    near = written(_targets(relationships.where(origin | _is("aas-spec")), held, doc))
    own = near.where(origin).groupBy(doc).agg(F.min_by(F.struct("nth", "source", "to", "inside", "held"), "nth").alias("x")).select(doc, F.lit("origin").alias("step"), "x.*")
    foreign = relationships.where("source = ''").groupBy(doc).agg(F.bool_or(F.regexp_like("type", F.lit("(^|/)aasx-origin$"))).alias("foreign"))
    none = foreign.join(own.select(doc), doc, "left_anti").select(doc, F.when(F.col("foreign"), "foreign origin").otherwise("no origin").alias("why"))
    at = own.select(doc, F.col("to").alias("source"))
    specs = near.where(_is("aas-spec")).join(at, [doc, "source"]).groupBy(doc, "source", "to").agg(F.min("nth").alias("nth"), F.first("inside").alias("inside"), F.first("held").alias("held"))
    specs = specs.select(doc, F.lit("spec").alias("step"), "nth", "source", "to", "inside", "held")
    empty = at.select(doc).join(specs.select(doc).distinct(), doc, "left_anti").select(doc, F.lit("no spec").alias("why"))
    # Those of sources that are no spec have no step, so they are left out before they meet the entries.
    beside = relationships.where(_is("aas-suppl")).join(specs.select(doc, F.col("to").alias("source")), [doc, "source"], "left_semi")
    beside = _targets(beside, held, doc).select(doc, F.lit("suppl").alias("step"), "nth", "source", "to", "inside", "held")
    return own.select(doc, "step", "nth", "source", "to", "inside", "held").union(specs).union(beside), none.union(empty)
