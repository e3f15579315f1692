"""Learned verdicts on rows that were not trained on, and decontamination against a plain edit distance."""

import random

from pyspark.sql import functions as F

from vellum.llm import decontaminate, quality_rules, url_filters

DATA = "/root/testdata/sf0.1"


def test_quality_rules_on_unseen_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    rules = quality_rules.learn(quality_rules.labelled_sample(docs, labels.where("doc_id % 2 = 0")))
    unseen = labels.where("doc_id % 2 = 1").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    judged = quality_rules.judge(docs.select("doc_id", "text").join(F.broadcast(unseen), "doc_id"), rules)
    # The base is fixed, and fails some documents labelled good; what is learned is judged where the base passes.
    n = judged.groupBy("bad", "base_failed", "kept").count().collect()
    n = {(r["bad"], r["kept"]): r["count"] for r in n if not r["base_failed"]}
    bad, good = n.get((True, False), 0) + n.get((True, True), 0), n.get((False, False), 0) + n.get((False, True), 0)
    assert bad > 50 and good > 500
    assert n.get((True, False), 0) >= 0.9 * bad and n.get((False, True), 0) >= 0.98 * good


def test_url_trees_on_hosts_without_a_rule(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(4, 8)))
    fine = lambda host: f"https://{host}/{word()}/{word()}"
    spam = lambda host: f"http://{host}/{word()}/{rnd.randint(10**6, 10**9)}?id={rnd.randint(10**5, 10**8)}&s={word()}&ref={rnd.randint(1000, 9999)}"
    rows = [(fine(f"{word()}.good.example"), "allow", True) for _ in range(400)] + [(spam(f"{word()}.bad.example"), "block", True) for _ in range(400)]
    rows += [(fine(f"{word()}.{word()}.test"), "allow", False) for _ in range(200)] + [(spam(f"{word()}.{word()}.test"), "block", False) for _ in range(200)]
    rnd.shuffle(rows)
    pages = spark.createDataFrame(rows, "url string, wanted string, ruled boolean")
    judged = url_filters.judge(pages, [("good.example/", "allow"), ("bad.example/", "block")]).collect()
    assert all((r.rule is not None) == r.ruled for r in judged)
    unseen = [r for r in judged if not r.ruled]
    assert sum(r.verdict == r.wanted for r in unseen) >= 0.9 * len(unseen)


def least_edits(item, text):
    """Edits of the best place of an item in a text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontamination_finds_what_an_edit_distance_finds(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(2, 8))) for _ in range(60)]
    fresh = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, fresh(rnd.randint(5, 16))) for i in range(8)]

    def edited(text, edits):
        for _ in range(edits):
            at, c = rnd.randrange(len(text)), rnd.choice("abcxyz")
            text = rnd.choice((text[:at] + text[at + 1 :], text[:at] + c + text[at + 1 :], text[:at] + c + text[at:]))
        return text

    docs = []
    for d in range(40):
        _, text = items[d % 8]
        docs.append((d, f"{fresh(8)} {edited(text, rnd.randint(0, 9))} {fresh(8)}"))
    docs += [(100, f"{items[0][1]} {fresh(6)} {items[0][1]} {fresh(3)} {edited(items[0][1], 1)}"), (101, fresh(60)), (102, None)]
    found = decontaminate.occurrences(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    best = {}
    for r in found:
        best[r.doc_id, r.item_id] = min(r.edits, best.get((r.doc_id, r.item_id), 99))
    wanted = {}
    for d, text in docs:
        for i, item in items:
            item, most = decontaminate.normal(item), decontaminate.budget(len(decontaminate.normal(item)), 10, 7)
            edits = least_edits(item, decontaminate.normal(text))
            if edits <= most:
                wanted[d, i] = edits
    assert best == wanted and len(wanted) > 15
    assert sorted(r.start for r in found if (r.doc_id, r.item_id) == (100, 0))[0] == 0
    assert sum((r.doc_id, r.item_id) == (100, 0) for r in found) == 3
