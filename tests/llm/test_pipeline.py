"""Stages of the corpus pipeline on small tables."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_passages(texts, n=51):
    """Texts without words of runs of n that also start elsewhere; white space behind a passage goes with it."""
    seen = defaultdict(list)
    words = [[m.group() for m in WORD.finditer(t.lower())] for t in texts]
    for i, w in enumerate(words):
        for p in range(len(w) - n + 1):
            seen[tuple(w[p : p + n])].append((i, p))
    gone = [[False] * len(w) for w in words]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + n] = [True] * n
    for t, g in zip(texts, gone):
        starts = [m.start() for m in WORD.finditer(t)] + [len(t)]
        yield t[: starts[0]] + "".join(t[starts[j] : starts[j + 1]] for j in range(len(g)) if not g[j])


def test_repeated_passages(spark):
    rnd = random.Random(8)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice(["", "é", "Σ", "x"])
    fresh = lambda n: " ".join(word() for _ in range(n))
    passage, spare = fresh(51).split(" "), fresh(50)
    texts = [
        "one " + " ".join(passage) + " end", "two\n" + "\n ".join(passage).upper() + "\tlast", "three " + " ".join(passage[:50]) + " other",
        "four " + spare, "five " + spare + " six", "", "short", fresh(80) + " " + " ".join(passage[:30]),
    ]
    for _ in range(60):
        w = fresh(rnd.randint(0, 90)).split(" ")
        other = WORD.findall(rnd.choice(texts[5:]))
        a, at = rnd.randint(0, len(other)), rnd.randint(0, len(w))
        texts.append(rnd.choice([" ", "  ", "\n"]).join(w[:at] + other[a : a + rnd.randint(20, 90)] + w[at:]))
    texts += [texts[20], texts[20]]
    assert max(len(m.encode()) for m in (" ".join(passage), spare)) < 400
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate([*texts, None])], "doc_id long, text string, n_chars long").repartition(3)
    rows = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert len(rows) == len(texts) + 1 and rows[len(texts)].text is None
    want = list(brute_passages(texts))
    # Longer repeats are also cut by bytes, at any place in a word.
    for i, (t, w) in enumerate(zip(texts, want)):
        assert len(WORD.findall(rows[i].text)) <= len(WORD.findall(w)) and rows[i].n_chars == len(rows[i].text)
        if i < 8:
            assert rows[i].text == w
    assert [rows[i].text for i in range(2)] == ["one end", "two\nlast"]
    assert sum(rows[i].text == w for i, w in enumerate(want)) > 0.9 * len(want)


def test_passages_are_cut_by_one_python_worker_a_task(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 60))) for i in (0, 3, 500)], "doc_id long, text string")
    found = corpus_pipeline.repeated_passages(spark, docs, "")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert {r.doc_id: len(r.text.split()) for r in found.collect()} == {0: 3, 3: 3, 500: 60}


def test_texts_of_one_hash_are_told_apart(spark, tmp_path, monkeypatch):
    """With a first hash of three values, near copies and leaks go and clean texts stay, as by hand."""
    rnd = random.Random(2)
    fresh = lambda n: " ".join(f"w{rnd.randrange(500)}" for _ in range(n))
    item = "Which of the following statements about the migration of arctic terns is correct?"
    texts = [fresh(60) for _ in range(20)]
    near = [t + " tail" for t in texts[:6]] + [texts[3]]
    leaks = [fresh(8) + " " + item + " " + fresh(8) for _ in range(3)]
    every = [*texts, *near, *leaks]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "first_hash", lambda text: F.pmod(F.xxhash64(text), F.lit(3)))
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t in every]
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert kept == {i for i in range(len(every)) if not any(alike(i, j) for j in range(i))}
    clean = {r.doc_id for r in corpus_pipeline.benchmark_passages(spark, docs, str(tmp_path)).collect()}
    assert clean == set(range(27))
