"""Handling of hard inputs: special spellings, clashing names, empty tables, null and repeated ids, large groups."""

import json
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from vellum.llm import decontaminate, jaccard_join, packing, quality_rules, suffix_dedup, token_counts, token_output
from vellum.llm.entry import word_vocabulary
from vellum.llm.tokens import WordEncoder, encoder


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_vocabulary())
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_tokens_are_the_library_s(encode):
    rnd = random.Random(1)
    pieces = ["<|ENDOFTEXT|>", "<|endoftext|>", "<|EndOfText|>", "İ", "İ,", "ß!", "É?", "Word", "word,", "it's", "I'M", "'S", "<|", "|>", "a", "Σ", ".", ",", "!", "3", "4.5", "\x1c", "é", "ＡＢ", "\u0301", "  ", "\n", "\u00a0"]
    texts = ["".join(rnd.choice(pieces) + rnd.choice(["", " ", ""]) for _ in range(rnd.randint(0, 7))) for _ in range(20_000)]
    found = encoder(word_vocabulary()).encode(texts)
    assert [t for t, ids in zip(texts, found) if np.frombuffer(ids, "<u4").tolist() != encode(t)] == []


def test_new_words_are_encoded_together(encode):
    """Cut words have the library's ids for any neighbours of Latin characters and marks, and few strings are encoded for many."""
    rnd = random.Random(2)
    letters = [chr(c) for c in range(0x21, 0x250)] + ["don't", "'LL", "ªº", "1²", "a\u0338", "=\u0338", "Ǆ", "ŉ"]
    texts = [" ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 4))) for _ in range(30)) for _ in range(2000)] + ["", None, " ", "\t a\x0b"]
    new = WordEncoder(word_vocabulary())
    found = [np.frombuffer(ids, "<u4").tolist() for ids in new.encode(texts)]
    assert [t for t, ids in zip(texts, found) if ids != encode(t or "")] == []

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.n = tokenizer, 0

        def encode_batch_fast(self, some, **how):
            self.n += len(some)
            return self.tokenizer.encode_batch_fast(some, **how)

    new.tokenizer = Counted(new.tokenizer)
    words = ["".join(rnd.choice("abcdefghé") for _ in range(12)) + rnd.choice(["", ".", ",%%"]) for _ in range(5000)]
    assert np.frombuffer(new.encode([" ".join(words)])[0], "<u4").tolist() == encode(" ".join(words))
    assert new.tokenizer.n <= 20


def test_cut_pieces(spark, encode):
    docs = [(i, " ".join(f"word{i} {j} and" for j in range(n))) for i, n in enumerate((0, 3, 40, 200, 77))]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), word_vocabulary(), end_id=1, capacity=64, grain=8, keep_ids=True).collect()
    for i, text in docs:
        some = sorted((r.start, r.ids) for r in rows if r.doc_id == i)
        assert np.frombuffer(b"".join(x for _, x in some), "<u4").tolist() == encode(text) + [1]
        assert [at for at, _ in some] == [sum(len(x) // 4 for _, x in some[:k]) for k in range(len(some))]


def test_random_access(spark, encode):
    docs = [(i, f"text {i} " * (i % 50)) for i in range(80)]
    manifest, folder = token_output.write(spark.createDataFrame(docs, "doc_id long, text string"), word_vocabulary(), width=16)
    from vellum.llm.files import filesystem

    system, _ = filesystem(folder)
    flat = [x for _, t in docs for x in encode(t) + [2]]
    for f in manifest.collect():
        for i in range(-(-f.n_tokens // 16)):
            ids, mask = token_output.sequence(system, f.path, i)
            want = flat[f.start + 16 * i : f.start + min(16 * i + 16, f.n_tokens)]
            assert ids.to_pylist()[: len(want)] == want and mask.to_pylist() == [True] * len(want) + [False] * (16 - len(want))


def test_file_without_a_last_separator(spark, tmp_path):
    np.array([5, 9, 9, 1, 2, 3], "<u2").tofile(tmp_path / "x.bin")
    files = spark.createDataFrame([(0, str(tmp_path / "x.bin"), 6)], "file_id long, path string, n_tokens long")
    for block in (1, 2, 100):
        rows = token_counts.count_tokens(files, f"file://{tmp_path}", end_id=9, block=block).collect()
        assert sorted((r.nth, r.start, r.n_tokens, r.ended) for r in rows) == [(0, 0, 2, True), (1, 2, 1, True), (2, 3, 3, False)]


def test_clashing_names(spark):
    text = "some words that stand in both of the texts " * 20
    rows = spark.createDataFrame([(1, text, 7, 8, 9, 10, 11), (2, text, 7, 8, 9, 10, 11), (3, "else", 7, 8, 9, 10, 11)], "doc_id long, text string, d1 long, d2 long, spans long, __words long, row long")
    cut = suffix_dedup.deduplicate(rows).collect()
    assert sorted(tuple(r) for r in cut) == [(1, "", 7, 8, 9, 10, 11), (2, "", 7, 8, 9, 10, 11), (3, "else", 7, 8, 9, 10, 11)]
    judged = quality_rules.judge(rows.withColumnRenamed("d1", "n_words").withColumnRenamed("d2", "__n"), [])
    assert {(r.doc_id, r.n_words, r["__n"], r["__words"]) for r in judged.collect()} == {(1, 180, 8, 10), (2, 180, 8, 10), (3, 1, 8, 10)}


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "foo X =  42 bar"), (2, "foo x = 421 bar"), (3, "X = 42"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(5, "x = 42"), (6, ""), (7, "bar")], "item_id long, text string")
    rows = decontaminate.occurrences(docs, items).collect()
    assert {(r.doc_id, r.item_id, r.start, r.length, r.edits) for r in rows} == {(1, 5, 4, 6, 0), (1, 7, 11, 3, 0), (2, 7, 12, 3, 0), (3, 5, 0, 6, 0)}


def test_low_thresholds_and_large_groups(spark):
    # Sets of ten that share two shingles; and a group of near copies longer than any short list.
    low = [(i, f"a b {' '.join(f'w{i}x{j}' for j in range(8))}") for i in range(40)]
    found = jaccard_join.link(spark.createDataFrame(low, "doc_id long, text string"), k=1, percent=10).collect()
    assert {r.component_id for r in found} == {0}
    words = [f"v{j}" for j in range(200)]
    near = [(i, " ".join([*words[:100], f"own{i}", *words[101:]])) for i in range(60)] + [(100 + i, " ".join([*words[: 40 + i], *[f"p{i}q{j}" for j in range(100)]])) for i in range(60)]
    got = {r.doc_id: r.component_id for r in jaccard_join.link(spark.createDataFrame(near, "doc_id long, text string"), k=3, percent=90).collect()}
    assert all(got[i] == 0 for i in range(60)) and all(got[100 + i] == 100 + i for i in range(60))


def test_pipeline(spark, tmp_path):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 9)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    good, item, passage = fresh(120), fresh(30), fresh(60)
    texts = {"good": good, "near": good + " tail", "leak": f"{fresh(40)} {item} {fresh(40)}", "one": f"{fresh(50)} {passage} {fresh(50)}", "two": f"{fresh(50)} {passage} {fresh(50)}", "clean": fresh(100), "short": "two words", "null": None}
    rows = [(1, texts["near"], "near"), (0, texts["good"], "good"), (None, texts["leak"], "leak"), (5, texts["one"], "one"), (5, texts["two"], "two"), (5, texts["clean"], "clean"), (5, texts["clean"], "clean"), (7, texts["short"], "short"), (8, texts["null"], "null"), (None, texts["good"], "copy")]
    frame = spark.createDataFrame([(i, t, n, 0, len(t or ""), 1) for i, t, n in rows], "doc_id long, text string, source string, key long, n_chars long, row long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for data, want in ((frame, ["good", "one", "two", "clean"]), (frame.limit(0), [])):
        folder = f"{tmp_path}/{len(want)}"
        for name in ("benchmark", "labels"):
            spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
        data.write.parquet(f"{folder}/documents.parquet")
        docs = data
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k < 4:
                assert docs.columns == data.columns, name
            if k == 3:
                kept = docs.collect()
        assert Counter(r.source for r in kept) == Counter(want)
        for r in kept:
            assert r.key == 0 and r.row == 1
            if r.source in ("one", "two"):
                assert passage not in r.text and 98 <= len(r.text.split()) <= 100 and r.n_chars == len(r.text)
        assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in kept}
        json.dumps([r.asDict() for r in docs.limit(3).collect()])


def test_jaccard_tables_go_when_they_are_used_up(spark, monkeypatch):
    from pathlib import Path

    from vellum.llm import common

    seen, components = [], jaccard_join.components

    def watched(links):
        seen.append({p.name for p in Path(common._FOLDERS[-1].removeprefix("file:").replace("//", "/")).glob("*/*")})
        return components(links)

    monkeypatch.setattr(jaccard_join, "components", watched)
    base = " ".join(f"w{i}" for i in range(60))
    docs = [(i, f"{base} x{i}") for i in range(20)] + [(100 + i, f"only here {i} and there {i}") for i in range(5)] + [(7, "two texts"), (200, None)]
    rows = jaccard_join.link(spark.createDataFrame(docs, "doc_id long, text string"), k=3, percent=90).collect()
    assert "links" in seen[0] and not seen[0] & {"features", "classes", "entries"}
    assert {r.component_id for r in rows if r.doc_id < 20} == {0} and all(r.component_id == r.doc_id for r in rows if r.doc_id >= 100)
