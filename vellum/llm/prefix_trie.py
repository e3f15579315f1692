"""Prefix trie of conversations by partition refinement.

All conversations are one class at first: the root. Each round reads a block of turns of the conversations that still share
their class (2, 8, 32, then 128 turns, so that long copies need few rounds), splits the classes turn by turn and retires those
that hold one conversation: the rest of such a conversation is a unary chain, which is written down without another look.
What rounds shared is folded back, the deepest block first: leaves and saved tokens of each node go to its ancestors in the
block, those of the block's tops to the block above.

A class is named by a hash of its turns (MD5 over the parent's name and the turn), so a conversation names its classes by
itself; Spark counts classes with partial sums, so a class may hold any share of the conversations. Turns are numbered by a
range partition, so one conversation may hold any share of the turns.

Rows: a row without conv_id belongs to no conversation and is left out. Null roles and texts count as empty. Turns of a
conversation are ordered by turn (null first), equal ones by a hash of role and text; repeated rows are several turns. An
empty table has no nodes. Very long texts are hashed and counted whole. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vellum.llm.common import keep, materialize, new_path, scratch

#: Turns of the rounds' blocks; the last size repeats.
BLOCKS = (2, 8, 32, 128)
#: conv_ids, by ranges of as many, that are joined to one piece of a list of ends before the piece is hashed.
PIECE = 256
#: Turns that a conversation borrows at most.
HEAD = 3


def block_of(at: Column) -> Column:
    """The block that holds turn number `at` (from 0)."""
    out = F.lit(len(BLOCKS)) + F.floor((at - sum(BLOCKS)) / BLOCKS[-1])
    for i in reversed(range(len(BLOCKS))):
        out = F.when(at < sum(BLOCKS[: i + 1]), i).otherwise(out)
    return out.cast("int")


def block_bounds(i: int) -> tuple[int, int]:
    start = sum(BLOCKS[: min(i, len(BLOCKS))]) + max(0, i - len(BLOCKS)) * BLOCKS[-1]
    return start, start + (BLOCKS[i] if i < len(BLOCKS) else BLOCKS[-1])


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, part, mid, key, words; parts: conv_id, part, first, before, n): a turn's number in its conversation is
    mid - first + before. Turns are sorted over range partitions, and only one row a conversation and partition is summed."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")]
    mid = F.monotonically_increasing_id()
    turns = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", mid.alias("mid"), F.shiftright(mid, 33).alias("part"), "key", "words"), "turns")
    parts = turns.groupBy("conv_id", "part").agg(F.min("mid").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return turns, materialize(parts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))), "parts")


def borrowed_heads(turns: DataFrame, parts: DataFrame, donor: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, at, key, words; lengths: conv_id, length) of conversations whose first `head` turns (a column of
    conv_id, HEAD at most) are those of conversation `donor`, followed by their own turns after as many."""
    own = parts.groupBy("conv_id").agg(F.sum("n").alias("n")).select("conv_id", "n", head.alias("head"), donor.alias("donor"))
    lent = own.select(F.col("conv_id").alias("donor"), F.col("n").alias("lent"))
    info = own.join(lent, "donor", "left").withColumn("lent", F.least("head", F.coalesce("lent", F.lit(0))))
    lengths = info.select("conv_id", "donor", "head", "lent", (F.col("lent") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("length"))
    lengths = materialize(lengths, "lengths")
    placed = parts.join(lengths.select("conv_id", "head", "lent"), "conv_id").select("conv_id", "part", (F.col("before") - F.col("first")).alias("shift"), "head", "lent")
    each = turns.join(placed, ["conv_id", "part"]).select("conv_id", (F.col("mid") + F.col("shift")).alias("pos"), "head", "lent", "key", "words")
    each = materialize(each, "each")
    after = each.where("pos >= head").select("conv_id", (F.col("pos") - F.col("head") + F.col("lent")).alias("at"), "key", "words")
    heads = each.where(F.col("pos") < HEAD).select(F.col("conv_id").alias("donor"), F.col("pos").alias("at"), "key", "words")
    before = lengths.where("lent > 0").select("conv_id", "donor", "lent").join(heads, "donor").where("at < lent").select("conv_id", "at", "key", "words")
    return after.union(before), lengths.select("conv_id", "length")


def _steps(start: int) -> Column:
    """A conversation's turns of a block (`turns`, sorted) as its classes: depth, class, words of the last turn; the first is the
    class that it comes from."""
    first = F.array(F.struct(F.lit(start).cast("long").alias("depth"), F.col("class").alias("class"), F.lit(0).cast("long").alias("words")))
    name = lambda done, t: F.unhex(F.md5(F.concat(F.element_at(done, -1)["class"], t["key"])))
    return F.aggregate("turns", first, lambda done, t: F.concat(done, F.array(F.struct((t["at"] + 1).alias("depth"), name(done, t).alias("class"), t["words"].alias("words")))))


def refine(turns: DataFrame, lengths: DataFrame) -> dict:
    """Rounds over turns (conv_id, at from 0, key, words). Gives tables: shared (block, depth, class, above: the classes of its
    ancestors in the block; conv, n, words) without the root, retired (block, conv, depth, above, length: conversations alone in
    their class from depth on), ends (class, conv_id: conversations that end in a shared class); and the root's class, smallest
    conversation and count."""
    spark = turns.sparkSession
    path = new_path(spark, "blocks")
    turns.withColumn("block", block_of(F.col("at"))).write.partitionBy("block").option("compression", "zstd").parquet(path)
    blocks = spark.read.schema("conv_id long, at long, key binary, words long, block int").parquet(path)
    root, top = bytes(16), lengths.agg(F.min("conv_id"), F.count("*")).first()
    active = lengths.withColumn("class", F.lit(root))
    out: dict = {"shared": [], "retired": [], "ends": [active.where("length = 0").select("class", "conv_id")], "root": (root, top[0], top[1])}
    active, i = active.where("length > 0"), 0
    while not active.isEmpty():
        start, end = block_bounds(i)
        here = blocks.where(F.col("block") == i).join(active, "conv_id")
        here = here.groupBy("conv_id", "class", "length").agg(F.array_sort(F.collect_list(F.struct("at", "key", "words"))).alias("turns"))
        stepped = materialize(here.select("conv_id", "length", _steps(start).alias("steps")), "stepped")
        each = stepped.select("conv_id", "length", "steps", F.explode(F.sequence(F.lit(2), F.size("steps"))).alias("k"))
        step = F.element_at("steps", F.col("k"))
        each = each.select("conv_id", "length", step["depth"].alias("depth"), step["class"].alias("class"), step["words"].alias("words"), F.transform(F.slice("steps", F.lit(1), F.col("k") - 1), lambda s: s["class"]).alias("above"))
        found = each.groupBy("class").agg(F.min("conv_id").alias("conv"), F.count("*").alias("n"), F.min("depth").alias("depth"), F.min("words").alias("words"), F.first("above").alias("above"), F.max("length").alias("length"))
        found = materialize(found.select(F.lit(i).alias("block"), "depth", "class", "above", "conv", "n", "words", "length"), "classes")
        out["shared"].append(found.where("n > 1").drop("length"))
        alone = found.where("n = 1").groupBy("block", "conv", "length").agg(F.min_by(F.struct("depth", "above"), "depth").alias("x"))
        alone = materialize(alone.select("block", "conv", "x.depth", "x.above", "length"), "retired")
        out["retired"].append(alone)
        last = F.element_at("steps", -1)["class"].alias("class")
        still = materialize(stepped.join(alone.select(F.col("conv").alias("conv_id")), "conv_id", "left_anti").select("conv_id", "length", last), "still")
        out["ends"].append(still.where(f"length <= {end}").select("class", "conv_id"))
        active, i = still.where(f"length > {end}"), i + 1
    return out


def list_digests(ends: DataFrame) -> DataFrame:
    """class, ends_sha256 of its conv_ids, ascending, joined by commas. Pieces of lists are joined by many tasks; only the hash
    itself, which has to read a list from its start, is one stream a class."""
    import hashlib

    import pyarrow as pa

    piece = F.floor(F.col("conv_id") / PIECE)
    pieces = ends.groupBy("class", piece.alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches):
        held, digest = None, None
        for batch in batches:
            done = []
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name == held:
                    digest.update(b",")
                else:
                    if held is not None:
                        done.append((held, digest.hexdigest()))
                    held, digest = name, hashlib.sha256()
                digest.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], ["class", "ends_sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([digest.hexdigest()])], ["class", "ends_sha256"])

    schema = StructType([StructField("class", ends.schema["class"].dataType), StructField("ends_sha256", StringType())])
    return pieces.repartition("class").sortWithinPartitions("class", "piece").select("class", "ids").mapInArrow(run, schema)


def _union(tables: list[DataFrame], empty: str, spark) -> DataFrame:
    out = None
    for t in tables:
        out = t if out is None else out.union(t)
    return out if out is not None else spark.createDataFrame([], empty)


def fold(spark, found: dict) -> DataFrame:
    """All shared nodes and the root: class, depth, conv, n, n_children, n_leaves, saved."""
    root, conv, n = found["root"]
    ancestors = "block int, depth long, class binary, above array<binary>, conv long, n long, words long"
    shared = _union(found["shared"], ancestors, spark)
    parents = _union([t.select(F.element_at("above", -1).alias("class")) for t in [*found["shared"], *found["retired"]]], "class binary", spark)
    children = materialize(parents.groupBy("class").agg(F.count("*").alias("n_children")), "children")
    top = spark.range(1).select(F.lit(-1).alias("block"), F.lit(0).cast("long").alias("depth"), F.lit(root).alias("class"), F.array().cast("array<binary>").alias("above"), F.lit(conv).cast("long").alias("conv"), F.lit(n).cast("long").alias("n"), F.lit(0).cast("long").alias("words"))
    nodes = shared.union(top).join(children, "class", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(nodes, "nodes")
    sums, below = [], None
    for i in reversed(range(-1, len(found["shared"]))):
        here = nodes.where(F.col("block") == i)
        saved, leaf = (F.col("n") - 1) * F.col("words"), F.when(F.col("n_children") == 0, 1).otherwise(0)
        path = F.concat("above", F.array("class"))
        given = here.select(path.alias("path"), leaf.cast("long").alias("n_leaves"), saved.alias("saved"))
        if i >= 0:
            given = given.union(found["retired"][i].select("above", F.lit(1).cast("long"), F.lit(0).cast("long")))
        if below is not None:
            given = given.union(here.select("class", path.alias("path")).join(below, "class").select("path", "n_leaves", "saved"))
        # Sums come first, so that a class with very many children is one row of each task when its path is taken apart.
        given = given.groupBy("path").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
        below = materialize(given.select(F.explode("path").alias("class"), "n_leaves", "saved").groupBy("class").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")), "sums")
        sums.append(below.join(here.select("class"), "class", "left_semi"))
    return nodes.join(_union(sums, "class binary, n_leaves long, saved long", spark), "class").select("class", "above", "depth", "conv", "n", "n_children", "n_leaves", "saved")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations given by turns (conv_id, at from 0, key, words) and lengths (conv_id, length): conv_id
    (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    found = refine(turns, lengths)
    nothing = F.sha2(F.lit(""), 256)
    shared = materialize(fold(spark, found), "folded")
    names = shared.select(F.col("class").alias("parent"), F.col("conv").alias("parent_conv"))
    digests = list_digests(_union(found["ends"], "class binary, conv_id long", spark))
    inner = shared.withColumn("parent", F.element_at(F.when(F.size("above") > 0, F.col("above")), -1)).join(names, "parent", "left").join(digests, "class", "left")
    inner = inner.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    retired = _union(found["retired"], "block int, conv long, depth long, above array<binary>, length long", spark)
    tails = retired.withColumn("parent", F.element_at("above", -1)).join(names, "parent", "left").select("conv", "parent_conv", F.col("depth").alias("from"), "length", F.explode(F.sequence("depth", "length")).alias("depth"))
    ends = F.col("depth") == F.col("length")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    tails = tails.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("from"), F.col("parent_conv")).otherwise(F.col("conv")).alias("parent_conv_id"), one.alias("n_convs"), F.when(ends, none).otherwise(one).alias("n_children"),
        one.alias("n_leaves"), none.alias("saved_tokens"), F.when(ends, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(nothing).alias("ends_sha256"),
    )
    return inner.union(tails).where("conv_id is not null")


def rebuilt_trie(conversations: DataFrame, donor: Column, head: Column) -> DataFrame:
    """trie() of conversations (conv_id, turn, role, text) that borrow their first turns; see borrowed_heads."""
    with scratch(conversations.sparkSession):
        turns, parts = numbered(conversations)
        return keep(trie(*borrowed_heads(turns, parts, donor, head)), "trie")
