"""Parts that names mean, and targets of relationships, looked up in one pass."""

import random

from pyspark.sql import functions as F

from vellum.functions import lexical as L
from vellum.operators import packages as P


def test_part_of_is_part_names_name(spark):
    rng = random.Random(4)
    bits = ["a", "B", "/", "/", "\\", ".", "..", "%20", "%2F", "%", "+", " ", "\x00", "é", "\n", "~", "%2e"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 9)))) for i in range(3000)] + [(3000, None)]
    df = spark.createDataFrame(rows, "id int, v string").select("id", "v", L.part_of(F.col("v")).alias("one"), L.part_name(F.col("v"))["name"].alias("two"))
    assert [r for r in df.collect() if r.one != r.two] == []


def test_lookups_that_spell_a_key_alike_are_one_row(spark):
    entries = spark.createDataFrame([(1, 1, "a/b.json"), (1, 2, "A/c.json"), (1, 3, "a/c.json")], "doc int, nth long, name string")
    held = P._held(entries, "doc")
    # a/b.json is its own part and its own lower case: one row, not three; a/c.json is what entry 2 is in lower case.
    assert sorted(r.key for r in held.collect()) == ["A/c.json", "a/b.json", "a/c.json"]
    values = spark.createDataFrame([(1, " a/b.json"), (1, "/a/./b.json"), (1, "A/C.json"), (1, "x"), (1, None)], "doc int, value string")
    assert {r.value: r.entry for r in P.resolved(values, entries).collect()} == {" a/b.json": "a/b.json", "/a/./b.json": "a/b.json", "A/C.json": "A/c.json", "x": None, None: None}
