"""The line machine in slices of any size, and citations' reach, against plain Python."""

import random
import re

import pytest

from vellum.operators import citations, lines


def by_hand(rows):
    out, block, heading, mark, pending, last, sub, opened = [], "", "", "", None, "", 0, False
    for at, line in rows:
        if m := re.match(r"^[▲▼]([A-Z]\d*)?$", line):
            mark = m.group(1) or ""
        elif m := re.match(r"^([1-4])\.\s+([A-Z][A-Z ,\-']+)$", line):
            block, heading, pending, last, sub, opened = m.group(1), m.group(2), None, "", 0, False
        elif not block:
            continue
        elif m := re.match(r"^\(([a-z])\)$", line):
            pending, sub = m.group(1), 0
        elif line == "—":
            pending = pending or "—"
        elif not opened and line.lower().startswith("a battery passport shall include"):
            opened = True
        elif pending == "—":
            sub += 1
            out.append((at, ".".join(x for x in (block, last, str(sub)) if x), heading, mark, line))
        elif pending:
            last, sub = pending, 0
            out.append((at, f"{block}.{pending}", heading, mark, line))
            pending = None
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 7, 500])
def test_points_in_slices(spark, size):
    rng = random.Random(7)
    kinds = ["1. PUBLICLY ACCESSIBLE", "2. NOTIFIED BODIES", "(a)", "(b)", "—", "—", "text", "more text", "A battery passport shall include this", "▼M1", "▲", "", "3. not a heading"]
    texts = {i: [(at, rng.choice(kinds)) for at in range(rng.randrange(0, 60))] for i in range(40)}
    texts[99] = [(0, "1. PUBLICLY ACCESSIBLE"), (5, "(a)"), (40, "far"), (41, "—"), (700, "farther"), (2000, "farthest")]
    rows = [(i, at, line) for i, some in texts.items() for at, line in some] + [(1, 999, None)]
    got = {}
    for r in lines.points(spark.createDataFrame(rows, "doc_id int, at int, line string"), size).collect():
        got.setdefault(r.doc_id, []).append((r.at, r.point, r.heading, r.mark, r.line))
    assert {i: sorted(v) for i, v in got.items()} == {i: w for i, w in ((i, by_hand(v)) for i, v in texts.items()) if w}


def test_reach(spark):
    points = ["1.a", "1.a.1", "1.a.2", "1.b", "2.c.1", "3", "3.x.1", "4.q.1", "4.q.2", "4.r.1"]
    cited = ["1", "1.a", "1.b", "2", "2.c", "3", "3.x", "4", "4.q", "4.r", "5", "1.", "1.a.1"]
    got = citations.reached(spark.createDataFrame([("s", str(i), c) for i, c in enumerate(cited)], "source string, record string, place string"), spark.createDataFrame([(p,) for p in points + points], "point string"))
    want = set()
    for i, c in enumerate(cited):
        beneath = [p for p in points if p.startswith(c + ".")]
        named = [c] if c in points else beneath if len(beneath) == 1 else []
        other = [p for p in beneath if p not in named]
        want |= {(str(i), p, True) for p in named} | {(str(i), p, False) for p in other}
        if not beneath and not named:
            want.add((str(i), None, None))
    assert {(r.record, r.point, r.named) for r in got.collect()} == want and got.count() == len(want)
