"""Near misses against every pair, edits at both ends too."""

import random

from vellum.operators import conformance


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_near_misses(spark):
    rnd = random.Random(6)
    words = ["AUTOMOBIL", "MACHINRY", "ab", "", *{"".join(rnd.choice("abcd") for _ in range(rnd.randint(3, 18))) for _ in range(20)}]
    values = ["UTOMOBILE", "XMACHINRYX", "zzz", "q", "ab", None, *("".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 20))) for _ in range(60))]
    found = conformance.near_misses(spark.createDataFrame([(v,) for v in values], "v string"), "v", spark.createDataFrame([(w,) for w in [*words, None]], "w string"), "w")
    want = set()
    for v in {*values} - {*words, None}:
        near = [(distance(v, w), w) for w in words if distance(v, w) <= max(3, len(w) // 4)]
        if near:
            want.add((v, *min(near)[::-1]))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and ("UTOMOBILE", "AUTOMOBIL", 2) in want
    none = conformance.near_misses(spark.createDataFrame([("a",)], "v string"), "v", spark.createDataFrame([], "w string"), "w")
    assert none.count() == 0
