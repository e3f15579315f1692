"""The numbered operators against brute force on small tables: nulls, empty texts, ties, repeated rows, empty tables, extra
columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import decontaminate, jaccard_join, license_scan, packing, quality_rules, suffix_dedup, token_counts, token_output, url_filters, warc
from vellum.llm.entry import URL_RULES, word_vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, row string, path string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_vocabulary())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


TEXTS = [(5, None), (3, ""), (9, "Hello, wörld! It's 3.5 ΑΣ ÉCOLE é <|endoftext|> x"), (1, "a b " * 4000), (1, "again\x1cand again"), (None, "no id"), (9, "Hello, wörld!")]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark, encode):
    rows = packing.pack(table(spark, TEXTS), word_vocabulary(), end_id=1, capacity=256, grain=16).collect()
    want = Counter((i, crc(encode(t) + [1])) for i, t in TEXTS)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r)
    assert sum(r.length for r in rows) == sum(len(encode(t)) + 1 for _, t in TEXTS)
    assert sorted(bins) == list(range(len(bins)))
    for some in bins.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    whole = Counter((r.doc_id, r.ids_crc32) for r in rows if r.length == r.doc_tokens)
    assert not whole - want
    kept = packing.pack(table(spark, TEXTS), word_vocabulary(), end_id=1, capacity=256, grain=16, keep_ids=True)
    assert sum(len(r.ids) // 4 for r in packing.sequences(kept).collect()) == sum(r.length for r in rows)
    assert packing.pack(table(spark, []), word_vocabulary()).count() == 0


def test_token_files(spark, encode):
    manifest, folder = token_output.write(table(spark, TEXTS), word_vocabulary(), end_id=2, width=64)
    rows = sorted(token_output.read(manifest, folder).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((i, len(encode(t)) + 1, crc(encode(t) + [2])) for i, t in TEXTS)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in TEXTS), key=lambda i: -1 if i is None else i)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens


def test_token_counts(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_vocabulary())
    tokenizer.encode_special_tokens = True
    encode = lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids
    docs = TEXTS
    files, order, folder = token_counts.write_flat(table(spark, docs), word_vocabulary())
    for block in (7, 1000, 1 << 20):
        found = token_counts.count_tokens(files, folder, block=block)
        rows = order.join(found, ["file_id", "nth"]).collect()
        assert Counter((r.doc_id, r.n_tokens, r.ended) for r in rows) == Counter((i, len(encode(t)) + 1, True) for i, t in docs)


def test_jaccard_components(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("abcdefghij") + str(rnd.randint(0, 60)) for _ in range(60)) for _ in range(12)]
    docs = []
    for i in range(150):
        w = rnd.choice(base).split()
        for _ in range(rnd.choice((0, 1, 2, 6))):
            w[rnd.randrange(len(w))] = rnd.choice(("new", "other", "x" + str(rnd.randint(0, 9))))
        docs.append((i, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    docs += [(200, None), (201, ""), (202, "one two"), (203, "One TWO"), (204, "one"), (None, docs[0][1]), (300, docs[1][1]), (300, docs[9][1]), (300, docs[9][1])]
    sets = []
    for _, t in docs:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    for percent in (60, 80, 90):
        parent = {i: i for i, _ in docs if i is not None}

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in range(len(docs)):
            for b in range(a):
                if docs[a][0] is not None and docs[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    x, y = top(docs[a][0]), top(docs[b][0])
                    parent[max(x, y)] = min(x, y)
        got = Counter(tuple(r) for r in jaccard_join.link(table(spark, docs), k=3, percent=percent).collect())
        assert got == Counter((i, len(s), None if i is None else top(i)) for (i, _), s in zip(docs, sets))


def brute_repeats(docs, least):
    seen = defaultdict(list)
    data = [(t or "").encode() for _, t in docs]
    for i, b in enumerate(data):
        for p in range(len(b) - least + 1):
            seen[b[p : p + least]].append((i, p))
    gone = [bytearray(len(b)) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + least] = b"\1" * least
    for (i, _), b, g in zip(docs, data, gone):
        kept = bytes(x for x, y in zip(b, g) if not y)
        yield i, len(b), sum(g), sum(g[j] and not (j and g[j - 1]) for j in range(len(g))), hashlib.sha256(kept).hexdigest()


def test_suffix_dedup(spark):
    rnd = random.Random(5)
    docs = []
    for i in range(50):
        t = "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(0, 150)))
        for _ in range(rnd.randint(0, 3)):
            other = rnd.choice(docs)[1] if docs else ""
            if len(other) > 5:
                a = rnd.randrange(len(other))
                t = t[: len(t) // 2] + other[a : a + rnd.randint(5, 80)] + t[len(t) // 2 :]
        docs.append((i, t))
    docs += [(60, None), (61, ""), (62, "a" * 100), (63, "ab" * 60), (64, docs[3][1]), (65, docs[3][1]), (66, "x" * 19 + "a" * 50), (None, "abc" * 40)]
    rows = suffix_dedup.digests(table(spark, docs).repartition(3), least=20, gram=4, window=6).collect()
    assert Counter(tuple(r)[:5] for r in rows) == Counter(brute_repeats(docs, 20))
    cut = suffix_dedup.deduplicate(table(spark, docs), least=20, gram=4, window=6)
    assert cut.columns == ["doc_id", "text", "row", "path"] and cut.count() == len(docs)


def test_url_filters(spark):
    urls = ["http://A.example.org/es/1?x#y", "https://example.org/en/12", "ftp://b.com/fr/", "no scheme", None, "http://notorg/", "http://x.net", "https://q.com/de/9", "http://u@w.com/zz?a=1&b=2"] * 3
    rows = url_filters.judge(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string"), URL_RULES).collect()
    assert [(r.host, r.path, r.rule) for r in sorted(rows, key=lambda r: r.page_id)][:9] == [
        ("a.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("b.com", "/fr/", "com/fr/"), ("", "", None), ("", "", None), ("notorg", "/", None), ("x.net", "", None), ("q.com", "/de/9", "com/de/"), ("u@w.com", "/zz", None)]
    assert {r.verdict for r in rows} <= {"allow", "block"}


def test_quality_counts(spark):
    texts = [None, "", "a", "one two three four five " * 3, "x\ty\x0bz # $\n\nx\n x\nx", "a b c d e f a b c d e q a b c d e", "é ü <> |" * 9, " \n \n"]

    def brute(t):
        w = WORD.findall(t or "")
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)

    rows = quality_rules.judge(table(spark, list(enumerate(texts))), []).collect()
    assert {r.doc_id: tuple(r[c] for c in quality_rules.BASE) for r in rows} == {i: brute(t) for i, t in enumerate(texts)}


def test_quality_learning(spark):
    rnd = random.Random(1)
    rows = [(i, i % 3 == 0, rnd.random() * 0.4 + (0.5 if i % 3 == 0 else 0), rnd.random()) for i in range(600)]
    sample = spark.createDataFrame(rows, "doc_id long, bad boolean, signal double, noise double")
    rules = quality_rules.learn(sample)
    assert rules and rules[0][0].feature == "signal"
    of = {"signal": F.col("signal"), "noise": F.col("noise")}
    assert sample.where((quality_rules.verdict(rules, of) > 0) != F.col("bad")).count() <= 12
    assert quality_rules.learn(sample.where("not bad")) == []


def test_decontaminate(spark):
    rnd = random.Random(2)
    passage = " ".join("".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(2, 9))) for _ in range(40))
    edited = passage[:60] + "Z" + passage[61:120] + passage[122:]
    other = " ".join("".join(rnd.choice("nopqrstuvwxyz") for _ in range(6)) for _ in range(50))
    docs = [(1, other + " " + passage.upper().replace(" ", "\n  ") + " " + other), (2, edited), (3, other), (4, None), (5, ""), (6, passage[: len(passage) // 2])]
    items = spark.createDataFrame([(7, passage), (8, None), (9, "tiny")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.edits for r in decontaminate.occurrences(table(spark, docs), items).collect()}
    assert set(found) == {(1, 7), (2, 7)} and found[(1, 7)] == 0 and 1 <= found[(2, 7)] <= 3
    assert decontaminate.occurrences(table(spark, docs), items.limit(0)).count() == 0


def test_license_scan(spark):
    rnd = random.Random(4)
    docs = [(i, "\n".join(" ".join(rnd.choice(("the", "code", "and", "public", "version", "of", "terms")) for _ in range(9)) for _ in range(4))) for i in range(60)]
    docs += [(100, "x\nReleased under the MIT License.\ny"), (101, "Licensed under the Apache License, Version 2.0."), (102, "the license of the public"), (103, None)]
    found = {(r.doc_id, r.line, r.family) for r in license_scan.scan(table(spark, docs)).collect()}
    assert found == {(100, 1, "mit"), (101, 0, "apache-2.0")}


def test_warc(spark):
    rows = [
        (1, "http://A.com/x/", 10, "response", {"etag": "a", "content-type": "t"}, "d"),
        (2, "https://www.a.com/x?utm_q=1#f", 20, "revisit", {"etag": "W/a", "date": "20", "set-cookie": "n"}, None),
        (3, "http://a.com/x", 30, "response", {"etag": "b"}, "e"),
        (4, "http://a.com/x", 40, "revisit", {"etag": "a"}, None),
        (5, "http://b.com", 5, "revisit", None, None),
        (6, None, None, "revisit", None, None),
        (7, "http://a.com/x", 25, "revisit", None, "d"),
    ]
    found = {r.record_id: (r.response_id, r.status) for r in warc.resolve(spark.createDataFrame(rows, "record_id long, url string, time long, type string, headers map<string,string>, digest string")).collect()}
    assert found == {2: (1, "resolved"), 4: (3, "changed"), 5: (None, "orphan"), 6: (None, "orphan"), 7: (1, "resolved")}


def test_warc_repeated_ids(spark):
    rows = [(1, f"http://{h}.com/", 10 * i, "response", {"etag": h}, None) for i, h in enumerate("ab")] + [(2, f"http://{h}.com/", 50, "revisit", {"etag": h}, None) for h in "aab"]
    found = warc.resolve(spark.createDataFrame(rows, "record_id long, url string, time long, type string, headers map<string,string>, digest string")).collect()
    assert Counter((r.record_id, r.canonical, r.response_id, r.status, r.headers["etag"]) for r in found) == {(2, "a.com/", 1, "resolved", "a"): 2, (2, "b.com/", 1, "resolved", "b"): 1}
