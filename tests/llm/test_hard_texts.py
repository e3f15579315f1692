"""Texts that repeat themselves or share paragraphs: bounded memory, bounded verification, little padding, learned cuts."""

import random
import subprocess
import sys
import textwrap

import pyarrow as pa
import pytest

from vellum.llm import decontaminate, jaccard_join, packing, quality_rules, suffix_dedup


def test_low_entropy_in_bounded_memory():
    """100,000 dashes against an item that holds 200: the q-grams meet 19 million times."""
    code = textwrap.dedent("""
        import resource, sys
        from vellum.llm import decontaminate as D
        items = [(1, "something before " + "-" * 200 + " something after"), (2, "=" * 60)]
        b = D.compiled(items, 10, 7)
        base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        texts = ["-" * 100_000, "x " + "-" * 50_000 + " something before " + "-" * 195 + " something after and " + "=" * 58]
        found = D.scan([7, 8], texts, b, 10)
        assert [(d, i) for d, i, *_ in found] == [(8, 1), (8, 2)], found
        print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
    """)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 500


def test_slices_change_nothing(monkeypatch):
    rng = random.Random(6)
    words = "the quick brown fox jumps over lazy dogs again -- -- -- ......".split()
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 30)))) for i in range(40)]
    texts = []
    for _ in range(60):
        t = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 80)))
        if rng.random() < 0.5:
            part = list(rng.choice(items)[1])
            part[rng.randrange(len(part))] = "#"
            t += " " + "".join(part) + " " + t[:40]
        texts.append(decontaminate.normal(t))
    b = decontaminate.compiled(items, 10, 7)
    want = decontaminate.scan(list(range(60)), texts, b, 10)
    for hits in (1, 50, 3000):
        monkeypatch.setattr(decontaminate, "HITS", hits)
        assert decontaminate.scan(list(range(60)), texts, b, 10) == want
    assert len(want) > 20


def test_shared_paragraphs_are_not_verified(spark, monkeypatch):
    """Documents of 5 of 40 paragraphs share much and are no near copies: of 21,945 pairs a seventh is compared whole (without
    the multi-match every pair that shares one long list is), and the links are right."""
    rng = random.Random(1)
    paragraphs = [" ".join(f"w{rng.randrange(3000)}" for _ in range(40)) for _ in range(40)]
    docs = [(i, "\n".join(rng.sample(paragraphs, 5))) for i in range(200)]
    docs += [(1000 + i, docs[i][1] + " tail") for i in range(10)]
    compared, plain = [], jaccard_join.materialize

    def counted(df, name="", path=None):
        out = plain(df, name, path)
        if name == "hub_pairs":
            compared.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    got = {r.doc_id: r.component_id for r in jaccard_join.link(spark.createDataFrame(docs, "doc_id long, text string"), k=5, percent=80).collect()}
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in docs}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    assert got == {i: find(i) for i in sets}
    assert sum(compared) < 3300, compared


@pytest.mark.parametrize(("percent", "paired", "most"), [(90, 256, 2500), (80, 6, 12000)])
def test_near_copies_under_the_threshold_do_not_meet(spark, monkeypatch, percent, paired, most):
    """Two templates that share half, each with copies of up to nine changed words: most pairs are just under the threshold.
    Without the differences from a hub 10,000 pairs and more are compared at 90 percent. With short lists of differences
    only, the others go on to the next hub, and links stay whole."""
    rng = random.Random(4)
    one = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(360):
        words = one[:75] + [f"v{j}" for j in range(75)] if i % 3 == 0 else list(one)
        for _ in range(rng.randrange(10)):
            words[rng.randrange(150)] = f"x{rng.randrange(400)}"
        docs.append((i, " ".join(words)))
    compared, plain = [], jaccard_join.materialize

    def counted(df, name="", path=None):
        out = plain(df, name, path)
        if name in ("hub_pairs", "stars"):
            compared.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    monkeypatch.setattr(jaccard_join, "PAIRED", paired, raising=False)
    got = {r.doc_id: r.component_id for r in jaccard_join.link(spark.createDataFrame(docs, "doc_id long, text string"), k=3, percent=percent).collect()}
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t in docs}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    assert got == {i: find(i) for i in sets}
    assert sum(compared) < most, compared


def test_last_bins_are_shared():
    rng = random.Random(2)
    totals = {n: rng.randrange(0, 5000) for n in [*range(1, 64), 64, 128, 256, 512, 1024, 2048]}
    classes, spots = packing.last_bins(totals, 2048)
    bins: dict = {}
    for length, _, at, offset in spots:
        bins.setdefault(at, []).append((offset, length))
    for some in bins.values():
        end = 0
        for offset, length in sorted(some):
            assert offset == end
            end += length
        assert end <= 2048
    full = sum(c[2] for c in classes)
    assert sorted(bins) == list(range(full, full + len(bins)))
    assert {n: sum(1 for s in spots if s[0] == n) + c for n, c in ((c[0], c[1] * c[2]) for c in classes)} == totals
    # All but one bin are nearly full.
    assert sum(2048 - sum(n for _, n in some) for some in bins.values()) < 2 * 2048


def test_one_symbol_is_no_reason(spark):
    """Bad documents hold many symbols, good ones none but a few with a single one."""
    rng = random.Random(3)
    rows = [(i, i % 3 == 0, rng.uniform(0.05, 0.3) if i % 3 == 0 else 0.0) for i in range(600)]
    rules = quality_rules.learn(spark.createDataFrame(rows, "doc_id long, bad boolean, symbols_a_word double"))
    assert len(rules) == 1 and rules[0][0].above and 0.02 < rules[0][0].cut < 0.05


def test_strings_are_named_all_at_once(monkeypatch):
    """Every string around the anchors of 300 texts, in batches of more than one slice; hashes are asked twice a text, not
    twice an anchor."""
    rng = random.Random(5)
    texts, asked = ["".join(rng.choice("abcd ") for _ in range(900)) for _ in range(300)], []
    for _ in texts:
        lows = [rng.randrange(40) for _ in range(rng.randrange(6))]
        asked.append([{"doc": rng.randrange(99), "core": rng.randrange(99), "packed": (p := rng.randrange(100, 400)) << 32 | 3 << 16 | lo << 8 | lo + rng.randrange(50), "end": p + rng.randrange(200), "weight": rng.randrange(1, 3)} for lo in lows])
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("doc", "core", "packed", "end", "weight")]))
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(asked, kind)], ["text", "asked"])
    calls, plain = [], suffix_dedup._Hashed.of
    monkeypatch.setattr(suffix_dedup._Hashed, "of", lambda self, lo, hi: calls.append(1) or plain(self, lo, hi))
    got = [r for b in suffix_dedup._strings(400, False)([batch]) for r in b.to_pylist()]
    assert len(calls) == 2 * len(texts)
    want, names = [], {}
    for text, some in zip(texts, asked):
        for a in some:
            place = a["packed"] >> 32
            for d in range(a["packed"] >> 8 & 255, (a["packed"] & 255) + 1):
                want.append((a["doc"], place - d, a["core"], d, a["weight"], a["weight"] == 1))
                names.setdefault((text[place - d : place], text[a["end"] : place - d + 400]), set()).add(got[len(want) - 1]["name"])
    assert [(r["doc"], r["start"], r["core"], r["distance"], r["weight"], r["alone"]) for r in got] == want
    assert all(len(x) == 1 for x in names.values())
    assert len({n for x in names.values() for n in x}) == len(names)
