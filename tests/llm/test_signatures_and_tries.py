"""Prefix trie, SimHash and tokenizer alignment against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from vellum.llm import prefix_trie, simhash_dedup, tokenizer_alignment

CONV = "conv_id long, turn long, role string, text string"


def trie_by_hand(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: x[0])] for c, v in turns.items()}
    members, built = defaultdict(list), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    out = []
    for node, cs in members.items():
        d, below = len(node), [m for m in members if m[: len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == d)))
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode().split()) for m in below if m)
        leaf = lambda m: not any(len(x) == len(m) + 1 and x[:-1] == m for x in members)
        out.append((min(cs), d, min(members[node[:-1]]) if d else None, len(cs), sum(len(m) == d + 1 for m in below), sum(map(leaf, below)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def op11(spark, rows):
    c = F.col("conv_id")
    got = prefix_trie.rebuilt_trie(spark.createDataFrame(rows, CONV), donor=c - c % 20, head=F.crc32(c.cast("string").cast("binary")) % 4)
    return sorted(map(tuple, got.collect()), key=lambda r: (r[1], r[0]))


def test_trie_equals_a_trie_by_hand(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a b", "a\tb c", "", None, "d"])) for c in range(45) for t in range(rng.randrange(1, 7)) if c not in (20, 33)]
    # Copies that are longer than several blocks, one that leaves them, null turns and ids, a conversation of one turn.
    rows += [(c, t, "user", f"w {t % 3}") for c in (60, 61, 62, 63) for t in range(70 if c != 62 else 50)]
    rows += [(70, None, "user", "first"), (70, 0, None, "x"), (None, 1, "user", "lost"), (81, 0, "user", "only")]
    rng.shuffle(rows)
    assert op11(spark, rows) == trie_by_hand(rows)


def test_trie_of_nothing_and_of_one(spark):
    assert op11(spark, []) == []
    assert op11(spark, [(None, 1, "user", "x")]) == []
    one = [(7, 0, "user", "x"), (7, 1, "bot", "y"), (7, 2, "bot", "z"), (7, 3, "bot", "z"), (7, 4, "bot", "z")]
    assert op11(spark, one) == trie_by_hand(one)


def test_repeated_turns_and_extra_columns(spark):
    rows = [(1, 0, "u", "x"), (1, 0, "u", "x"), (2, 0, "u", "x"), (2, 0, "u", "x")]
    df = spark.createDataFrame(rows, CONV).withColumn("class", F.lit("clash")).withColumn("mid", F.lit(1))
    got = prefix_trie.rebuilt_trie(df, donor=F.col("conv_id"), head=F.lit(0)).collect()
    assert sorted((r.depth, r.conv_id, r.n_convs, r.saved_tokens) for r in got) == [(0, 1, 2, 2), (1, 1, 2, 2), (2, 1, 2, 1)]


def fingerprint_by_hand(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = lower.encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_by_hand(prints):
    ids = list(prints)
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: find(i) for i in ids}


def test_fingerprints_and_components(spark):
    rng = random.Random(3)
    words = "Aa bb CC dd é ff".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) for _ in range(150)] + [None, "", " \n", "x\x85y Ünï z"]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {i: fingerprint_by_hand(t) for i, t in rows}
    classes = classes_by_hand(prints)
    assert got == {i: (f"{prints[i]:016x}", classes[i]) for i, _ in rows}


def test_long_texts_are_read_in_slices():
    text = " ".join(f"Word{i % 977}\n" for i in range(5000)).encode()
    want = fingerprint_by_hand(text.decode())
    assert all(simhash_dedup.fingerprint(text, size) % (1 << 64) == want for size in (1, 7, 1000, 1 << 20))


@pytest.mark.parametrize("most", [2, 4, 16])
def test_links_of_crowded_fingerprints(spark, most):
    """Clouds of fingerprints around a few centres: keys from two fingerprints to hundreds, above and below `most`."""
    rng = random.Random(8)
    prints = {0, 1 << 63, (1 << 64) - 1}
    for _ in range(4):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))) for _ in range(60)}
        prints |= {(centre & ~0xFFFFFFFF) | rng.getrandbits(32) for _ in range(30)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash_dedup.links(spark.createDataFrame([(p,) for p in signed], "fp long"), most)
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in found.distinct().collect()]
    assert all(bin(a ^ b).count("1") <= 2 for a, b in pairs)
    want = classes_by_hand({p: p for p in sorted(prints)})
    top = {p: p for p in prints}

    def find(p):
        while top[p] != p:
            p = top[p]
        return p

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    assert {p: find(p) for p in prints} == want


def test_simhash_of_odd_rows(spark):
    rows = [(None, "one two three four"), (3, "one two three four"), (3, "one two three four"), (5, "else")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("key", F.lit("k"))
    got = Counter((r.doc_id, r.component_id) for r in simhash_dedup.near_duplicates(df).collect())
    assert got == {(None, 3): 1, (3, 3): 2, (5, 5): 1}
    assert simhash_dedup.near_duplicates(df.limit(0)).collect() == []


def paths():
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def aligned_by_hand(rows):
    """Token pairs by comparing every pair of intervals; bytes through the libraries' own tables."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = paths()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    symbols = tokenizer_alignment.byte_of_symbol()
    found, counts = {}, Counter()
    for i, text in rows:
        found[i] = ([], [], "", [])
        if not text:
            continue
        raw = (" " + text).encode()
        ta = [(t, bytes(symbols[c] for c in a.id_to_token(t))) for t in a.encode(" " + text, add_special_tokens=False).ids]
        tb = [(t, bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode()) for t in b.encode(text)]
        if b"".join(x for _, x in ta) != raw or b"".join(x for _, x in tb) != raw:
            continue
        spans = []
        for tokens in (ta, tb):
            at, out = 0, []
            for t, x in tokens:
                out.append((at, at + len(x), t))
                at += len(x)
            spans.append(out)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(x[2]) for x in s if low <= x[0] < cut) for s in spans))
            low = cut
        counts.update(links)
        found[i] = (ta, tb, ";".join(groups), links)
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return {
        i: (len(ta), len(tb), len(g.split(";")) if g else 0, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for i, (ta, tb, g, links) in found.items()
    }


ODD = ["", None, " ", "  two  spaces\n\n", "<|endoftext|> <s> </s> <0x41> <unk>", "naïve café ☃ 🙂🙂 日本語", "a▁b", "x" * 300, "tab\tand\r\nlines", "\x00\x01", "ﬁ ligature é", "don't it's WE'LL"]


@pytest.mark.parametrize("most", [0, 5, 40, 1 << 19])
def test_alignment_equals_comparing_all_pairs(spark, most):
    rng = random.Random(2)
    words = "the Tokenizer aligns unalignable subwords, 1234567 supercalifragilistic and don't über-lang <|endoftext|>".split()
    rows = list(enumerate(ODD + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(25)]))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(7)).withColumn("pairs", F.lit("x"))
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in tokenizer_alignment.align_corpus(df, *paths(), most=most).collect()}
    assert got == aligned_by_hand(rows)


def test_alignment_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "twice"), (1, "twice"), (1, "twice")], "doc_id long, text string")
    got = tokenizer_alignment.align_corpus(df, *paths()).collect()
    assert Counter(r.doc_id for r in got) == {None: 1, 1: 2} and len({r.groups_sha256 for r in got}) == 1
    assert all(r.n_best == r.n_links for r in got)
    assert tokenizer_alignment.align_corpus(df.limit(0), *paths()).collect() == []
