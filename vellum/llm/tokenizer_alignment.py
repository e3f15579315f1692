"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

B's tokens are a static index of intervals (their ends are sorted as they come). Each of A's tokens stabs it with two binary
searches, which give the run of B's tokens that it overlaps: its links. A gap between two of B's tokens that no token of A
spans is a boundary of groups.

A text is cut before single spaces and line ends between other characters, where both tokenizers always begin a token
(byte-level ones by their pattern, piece ones as no piece holds a space after another character, or a line end; for
vocabularies that don't, texts stay whole). What lies between two cuts is aligned on its own, and each worker keeps what it has
found for short ones.

How often a pair of ids is linked in the whole corpus is counted by Spark. The most frequent pairs, `FREQUENT` at most, and
the best count of each of B's ids (as many as its vocabulary) are sent to all tasks; the other pairs, none of which can be
hot, meet their counts in a join.

Rows: a null or empty text, and one whose tokens don't spell a space and the text, has zeros and an empty groups_sha256. Very
long texts are aligned whole; a worker holds one text's links at a time beside a megabyte of texts. Null and repeated
doc_ids and repeated rows keep a row each. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain
from operator import sub

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from vellum.llm.common import keep, materialize, scratch

#: Pairs of ids, with their counts, that are sent to all tasks: 16 bytes each, 8 MB.
FREQUENT = 1 << 19
#: Characters of texts that are tokenized at once.
SLICE = 1 << 20
#: Alignments that a worker keeps, and the longest text between cuts that it keeps one for: some 350 bytes each.
KEPT, SHORT = 300_000, 40
DIGEST = ["n_a", "n_b", "n_groups", "n_links"]
_VOCABULARIES: dict = {}


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable Latin-1 bytes are their own symbols, the
    others follow from U+0100 in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """One tokenizer: encode(texts) gives lists of ids of texts that begin with a space or, cut from others, with a line end;
    spelt[id] is a token's bytes; cuts says whether it begins a token at each cut."""

    def __init__(self, path: str):
        import numpy as np

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.encode_special_tokens = True
            symbols, entries = byte_of_symbol(), self.tokenizer.get_vocab(with_added_tokens=True)
            self.spelt = [b""] * (max(entries.values()) + 1)
            for entry, i in entries.items():
                self.spelt[i] = bytes(symbols[c] for c in entry) if all(c in symbols for c in entry) else entry.encode()
            self.encode = lambda texts: [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            steps = json.loads(self.tokenizer.to_str())
            self.cuts = steps["normalizer"] is None and (steps["pre_tokenizer"] or {}).get("type") == "ByteLevel" and bool(steps["pre_tokenizer"].get("use_regex", True))
        else:
            import sentencepiece

            model = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [(model.id_to_piece(i), model.is_byte(i)) for i in range(model.get_piece_size())]
            self.spelt = [bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces]
            # The model puts a space first: instead of the text's own, or as a token that is taken off again.
            self.encode = lambda texts: [ids if t[0] == " " else ids[1:] for t, ids in zip(texts, model.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1))]
            self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p for p, _ in pieces)
        self.lengths = np.array(list(map(len, self.spelt)), np.int64)
        self.shown = list(map(str, range(len(self.spelt))))


def vocabulary(path: str) -> Vocabulary:
    """The worker's own copy."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def overlaps(a_lengths, b_lengths):
    """(first, after, gaps) of tokens given by their lengths over the same bytes: A's token i overlaps B's tokens first[i] to
    after[i] - 1; gaps are the j where no token of A spans the place between B's tokens j - 1 and j."""
    import numpy as np

    a_end, b_end = np.cumsum(a_lengths), np.cumsum(b_lengths)
    first = np.searchsorted(b_end, a_end - a_lengths, "right")
    after = np.searchsorted(b_end - b_lengths, a_end, "left")
    # A token spans the gaps within its run.
    spans = np.zeros(len(b_end) + 1, np.int64)
    wide = after - first > 1
    np.add.at(spans, first[wide] + 1, 1)
    np.add.at(spans, after[wide], -1)
    gaps = np.flatnonzero(np.cumsum(spans[:-1]) == 0)
    return first, after, gaps[gaps > 0]


def align(texts: list[str], a_ids: list[list[int]], b_ids: list[list[int]], a: Vocabulary, b: Vocabulary) -> list:
    """For each text (counts: n_a, n_b, n_groups, n_links; groups; links), or None where the tokens don't spell it. groups is the text
    `a1,a2|b1;a3|b2,b3`; links are the linked ids as a << 32 | b, as bytes. Texts are laid end to end and aligned at once: where one
    ends, tokens of both end."""
    import numpy as np

    spells = lambda v, ids, text: b"".join(map(v.spelt.__getitem__, ids)) == text.encode()
    good = [bool(t) and spells(a, x, t) and spells(b, y, t) for t, x, y in zip(texts, a_ids, b_ids)]
    out = [None] * len(texts)
    if not any(good):
        return out
    a_lists, b_lists = ([x for x, g in zip(lists, good) if g] for lists in (a_ids, b_ids))
    a_all, b_all = (np.fromiter(chain.from_iterable(lists), np.int64) for lists in (a_lists, b_lists))
    a_lengths, b_lengths = a.lengths[a_all], b.lengths[b_all]
    first, after, gaps = overlaps(a_lengths, b_lengths)
    n = after - first
    # The j-th link of a token is the j-th of its run.
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    links = ((np.repeat(a_all, n) << 32) | b_all[at]).astype("<i8").tobytes()
    a_cuts = np.searchsorted(np.cumsum(a_lengths), np.cumsum(b_lengths)[gaps - 1], "right")
    a_shown, b_shown = list(map(a.shown.__getitem__, a_all.tolist())), list(map(b.shown.__getitem__, b_all.tolist()))
    a_from, b_from = [0, *a_cuts.tolist(), len(a_all)], [0, *gaps.tolist(), len(b_all)]
    groups = [f"{a_shown[i]}|{b_shown[k]}" if j - i == m - k == 1 else ",".join(a_shown[i:j]) + "|" + ",".join(b_shown[k:m]) for i, j, k, m in zip(a_from, a_from[1:], b_from, b_from[1:])]
    ends = [np.cumsum(np.fromiter(map(len, lists), np.int64)) for lists in (a_lists, b_lists)]
    last = [*(e.tolist() for e in ends), np.searchsorted(gaps, ends[1], "left").tolist(), np.cumsum(n)[ends[0] - 1].tolist()]
    last[2] = [x + 1 for x in last[2]]
    now = (0, 0, 0, 0)
    for i, then in zip((i for i, g in enumerate(good) if g), zip(*last)):
        out[i] = tuple(map(sub, then, now)), ";".join(groups[now[2] : then[2]]), links[8 * now[3] : 8 * then[3]]
        now = then
    return out


#: Where texts are cut, what keeps a plain search from finding the same, and that search.
_OPEN = r"\s\u180e\u200b\ufeff"
_CUT = re.compile(rf"(?<=[^{_OPEN}])(?=[ \n][^{_OPEN}])")
_UNCLEAR = re.compile(rf"[ \n](?:[{_OPEN}]|$)|[{_OPEN}][ \n]")
_PIECE = re.compile(r"[ \n][^ \n]+")


class Aligner:
    """Aligns texts in order, and keeps what it finds between cuts."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.a, self.b, self.kept = a, b, {}

    def pieces(self, text: str) -> list[str]:
        text = " " + text
        if not (self.a.cuts and self.b.cuts):
            return [text]
        return _CUT.split(text) if _UNCLEAR.search(text) else _PIECE.findall(text)

    def found(self, wanted: set[str]) -> dict:
        some = list(wanted)
        return dict(zip(some, align(some, self.a.encode(some), self.b.encode(some), self.a, self.b))) if some else {}

    def texts(self, texts: list):
        """(counts: n_a, n_b, n_groups, n_links; groups; pairs; times) of each text, None where it has no tokens; pairs are distinct and
        sorted, times how many links have them. About SLICE characters are tokenized at once."""
        import numpy as np

        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= SLICE):
                size += len(texts[hi] or "")
                hi += 1
            split = [self.pieces(t) if t else [] for t in texts[lo:hi]]
            new = self.found({p for pieces in split for p in pieces if p not in self.kept})
            if len(self.kept) < KEPT:
                self.kept.update({p: x for p, x in new.items() if len(p) <= SHORT})
            kept = self.kept
            for pieces in split:
                each = [new[p] if p in new else kept[p] for p in pieces]
                if not each or None in each:
                    yield None
                    continue
                counts, groups, links = zip(*each)
                pairs, times = np.unique(np.frombuffer(b"".join(links), "<i8"), return_counts=True)
                yield list(map(sum, zip(*counts))), ";".join(groups), pairs, times
            lo = hi


def _aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """row, doc_id, the digest columns, pairs and times (binary)."""
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType
    schema = StructType([StructField("row", LongType()), StructField("doc_id", kind), *[StructField(c, LongType()) for c in DIGEST], StructField("groups_sha256", StringType()), StructField("pairs", BinaryType()), StructField("times", BinaryType())])

    def run(batches):
        aligner = Aligner(vocabulary(a_path), vocabulary(b_path))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for x in aligner.texts(part.column(2).to_pylist()):
                    rows.append((*x[0], hashlib.sha256(x[1].encode()).hexdigest(), x[2].tobytes(), x[3].astype("<u4").tobytes()) if x else (0, 0, 0, 0, "", b"", b""))
                kinds = [*[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]], schema.names)

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n: how many links of the corpus have it; each task adds up its own first."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                pairs = np.frombuffer(b"".join(part.column(0).to_pylist()), "<i8")
                times = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u4")
                each, at = np.unique(pairs, return_inverse=True)
                n = np.zeros(len(each), np.int64)
                np.add.at(n, at, times)
                yield pa.RecordBatch.from_arrays([pa.array(each, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

    return aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def frequent_from(counts: DataFrame, most: int) -> int:
    """A count that at most `most` pairs reach."""
    level = F.floor(F.log2("n") * 8).cast("int")
    total, least = 0, None
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).orderBy(F.desc("level")).collect():
        total += r["pairs"]
        if total > most:
            break
        least = r["least"]
    return least if least is not None else 1 << 62


def align_corpus(docs: DataFrame, a_path: str, b_path: str, most: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is linked as often as any of its B id), count_sum (of the
    links' counts), groups_sha256."""
    import pyarrow as pa

    spark = docs.sparkSession
    with scratch(spark):
        aligned = materialize(_aligned(docs, a_path, b_path), "aligned")
        counts = pair_counts(aligned)
        counts = materialize(counts.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "counts")
        # One row an id of B's vocabulary.
        best = materialize(counts.groupBy("b").agg(F.max("n").alias("best")), "best")
        least = frequent_from(counts, most)
        often = counts.where(F.col("n") >= least).join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("best")).alias("top")).toArrow().sort_by("pair")
        held = spark.sparkContext.broadcast([often.column(c).to_numpy() for c in often.column_names])

        def run(batches):
            import numpy as np

            pair, n, top = held.value
            for batch in batches:
                rows = []
                for pairs, times in zip(batch.column("pairs"), batch.column("times")):
                    pairs, times = np.frombuffer(pairs.as_py(), "<i8"), np.frombuffer(times.as_py(), "<u4").astype(np.int64)
                    at = np.minimum(np.searchsorted(pair, pairs), max(len(pair) - 1, 0))
                    known = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
                    here = at[known]
                    rows.append((int((times[known] * n[here]).sum()), int(times[known][top[here]].sum()), pairs[~known], times[~known]))
                sums, tops, rare, rare_times = zip(*rows) if rows else ((), (), (), ())
                lists = [pa.array(list(c), pa.list_(pa.int64())) for c in (rare, rare_times)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sums, pa.int64()), pa.array(tops, pa.int64()), *lists], [*names, "count_sum", "n_best", "rare", "rare_times"])

        names = ["row", "doc_id", *DIGEST, "groups_sha256"]
        schema = StructType([*[f for f in aligned.schema.fields if f.name in names], StructField("count_sum", LongType()), StructField("n_best", LongType()), *[StructField(c, ArrayType(LongType())) for c in ("rare", "rare_times")]])
        summed = materialize(aligned.mapInArrow(run, schema), "summed")
        few = counts.where(F.col("n") < least).join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("best")).alias("top"))
        each = summed.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.rare_times").alias("times"))
        rest = each.join(few, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("rare_sum"), F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("rare_best"))
        whole = summed.drop("rare", "rare_times").join(rest, "row", "left")
        add = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
        return keep(whole.select("doc_id", *DIGEST, add("n_best", "rare_best"), add("count_sum", "rare_sum"), "groups_sha256"), "alignment")
