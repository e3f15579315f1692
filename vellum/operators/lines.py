"""A state machine over the lines of texts: blocks, lettered points and their unlettered sub-items, as composed transitions.

Lines are cut into slices. What a slice does to the machine is worked out for each way in which it can be entered, all slices
at once; these effects are then composed in order, one small step a slice; and each slice, now that its entry is known, names
its lines. So a text of any length is many tasks.

A heading (`1. PUBLICLY ACCESSIBLE`) opens a block; lines before the first are nothing. `(a)` lends its letter to the next line.
Behind a dash every line is a sub-item, of the last lettered line of the block or of the block. A block's first opening
sentence is no item. Amendment marks hold until the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.sources.shared import written

#: Lines of a slice.
SLICE = 500
#: What lines are.
HEADING, POINT, MARK, DASH = r"^([1-4])\.\s+([A-Z][A-Z ,\-']+)$", r"^\(([a-z])\)$", "^[▲▼]([A-Z][0-9]*)?$", "—"
OPENING = "a battery passport shall include"
#: What stands for a state that a slice is entered with, and its pending letter; no block yet.
ENTRY, LETTER, OUTSIDE = "=", "=p", "!"


def _state(block, heading, mark, pending, last, sub, anew, opened) -> Column:
    values = {"block": block, "heading": heading, "mark": mark, "pending": pending, "last": last, "sub": sub, "anew": anew, "opened": opened}
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()])


def _step(s: Column, line: Column) -> Column:
    """The state behind a line: block and its heading, mark, pending (a letter, a dash, '' or OUTSIDE), last (letter of the block's
    last lettered line), sub (sub-items since), anew (was sub set since the entry?), opened (has the block had its opening?)."""
    same = {k: s[k] for k in ("block", "heading", "mark", "pending", "last", "sub", "anew", "opened")}
    to = lambda **new: _state(**{**same, **new})
    is_ = lambda pattern: F.regexp_like(line, F.lit(pattern))
    return (
        F.when(is_(MARK), to(mark=F.regexp_extract(line, MARK, 1)))
        .when(is_(HEADING), to(block=F.regexp_extract(line, HEADING, 1), heading=F.regexp_extract(line, HEADING, 2), pending="", last="", sub=0, anew=True, opened=False))
        .when(s["pending"] == OUTSIDE, to())
        .when(is_(POINT), to(pending=F.regexp_extract(line, POINT, 1), sub=0, anew=True))
        .when(line == DASH, to(pending=F.when(s["pending"] == "", DASH).otherwise(s["pending"])))
        .when(~s["opened"] & F.lower(line).startswith(OPENING), to(opened=True))
        .when(s["pending"] == "", to())
        .when(s["pending"] == DASH, to(sub=s["sub"] + 1))
        .otherwise(to(last=F.when(s["pending"] == ENTRY, LETTER).otherwise(s["pending"]), sub=0, anew=True, pending=""))
    )


def _is_item(s: Column, line: Column) -> Column:
    """Is a line named, in the state before it?"""
    other = F.regexp_like(line, F.lit(MARK)) | F.regexp_like(line, F.lit(HEADING)) | F.regexp_like(line, F.lit(POINT)) | (line == DASH)
    return ~other & ~s["pending"].isin(OUTSIDE, "") & ~(~s["opened"] & F.lower(line).startswith(OPENING))


#: The ways to enter a slice: what is pending, and whether the block has had its opening.
ENTRIES = [(OUTSIDE, False), *[(p, o) for p in ("", ENTRY, DASH) for o in (False, True)]]


def _after(s: Column, effects: Column) -> Column:
    """The state behind a slice that is entered in state s."""
    kind = F.when(s["pending"].isin(OUTSIDE, "", DASH), s["pending"]).otherwise(ENTRY)
    e = F.coalesce(*[F.when((kind == p) & ((s["opened"] == o) if p != OUTSIDE else F.lit(True)), F.get(effects, F.lit(i))) for i, (p, o) in enumerate(ENTRIES)])
    keep = lambda name: F.when(e[name] == ENTRY, s[name]).otherwise(e[name])
    last = F.when(e["last"] == LETTER, s["pending"]).otherwise(keep("last"))
    return _state(keep("block"), keep("heading"), keep("mark"), keep("pending"), last, F.when(e["anew"], e["sub"]).otherwise(s["sub"] + e["sub"]), False, e["opened"])


def points(lines: DataFrame, size: int = SLICE) -> DataFrame:
    """Named lines of lines (doc_id, at, line; null lines are nothing): doc_id, at, point (block.letter, block.letter.n or block.n),
    heading, mark, line."""
    rows = lines.where("line is not null").select("doc_id", F.col("at").cast("long").alias("at"), "line")
    cut = rows.groupBy("doc_id", F.floor(F.col("at") / size).alias("slice")).agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    cut = written(cut)
    run = lambda start: F.aggregate("lines", start, lambda s, x: _step(s, x["line"]))
    entered = [run(_state(ENTRY, ENTRY, ENTRY, p, ENTRY, 0, False, o)) for p, o in ENTRIES]
    effects = written(cut.select("doc_id", "slice", F.array(*entered).alias("effects")))
    begin = _state("", "", "", OUTSIDE, "", 0, False, False)
    chain = lambda done, x: F.concat(done, F.array(_after(F.element_at(done, -1), x["effects"])))
    all_ = effects.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("slice", "effects"))).alias("all"))
    states = all_.select("doc_id", "all", F.aggregate("all", F.array(begin), chain).alias("states"))
    states = states.select("doc_id", F.posexplode("all").alias("i", "x"), "states").select("doc_id", "x.slice", F.get("states", F.col("i")).alias("state"))
    out = F.array().cast("array<struct<at:bigint,line:string,block:string,heading:string,mark:string,pending:string,last:string,sub:int>>")

    def named(done: Column, x: Column) -> Column:
        s, line = done["state"], x["line"]
        item = F.struct(x["at"].alias("at"), line.alias("line"), *[s[c].alias(c) for c in ("block", "heading", "mark", "pending", "last", "sub")])
        return F.struct(_step(s, line).alias("state"), F.when(_is_item(s, line), F.concat(done["out"], F.array(item))).otherwise(done["out"]).alias("out"))

    found = cut.join(states, ["doc_id", "slice"]).select("doc_id", F.explode(F.aggregate("lines", F.struct(F.col("state").alias("state"), out.alias("out")), named)["out"]).alias("x"))
    last = F.when(F.col("x.last") == "", F.col("x.block")).otherwise(F.concat("x.block", F.lit("."), "x.last"))
    point = F.when(F.col("x.pending") == DASH, F.concat(last, F.lit("."), (F.col("x.sub") + 1).cast("string"))).otherwise(F.concat("x.block", F.lit("."), "x.pending"))
    return found.select("doc_id", "x.at", point.alias("point"), "x.heading", "x.mark", "x.line")
