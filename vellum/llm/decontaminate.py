"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared lower-cased with runs of white space as one space. A benchmark item of m characters occurs in a text with
at most e edits only if the two share at least m + 1 - q - q * e of its q-grams on diagonals (text position minus item
position) within e of each other. Diagonals are counted in bands of width 2 w that overlap by half (w > e), so each such
occurrence lies in one band; bands that reach the bound are verified by an alignment inside the band, which gives the edits
and the place.

Benchmark items are few beside texts: they are compiled in blocks of at most `block_chars` characters, each broadcast and
scanned against all texts, so a larger benchmark means more passes, never a larger broadcast.

Rows: null and empty texts contain nothing; null and empty items are not searched. Items of fewer than q characters
(normalised) hold no q-gram: they are looked up as whole words without edits. Repeated rows and items are each judged. Empty tables give an empty result. Other columns are not read. Texts of any length are
scanned whole, and hits are counted in slices of `HITS`, so that texts and items that repeat one character or phrase cost
time, not memory.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import local_table

Q, PERCENT = 10, 7
BLOCK_CHARS = 4_000_000
FOUND = "doc_id long, item_id long, start long, length long, edits int"
BASE = 0x9E3779B97F4A7C15
FILTER_BITS = 22
#: Pairs of a text's q-gram and an item's place that are held at once, whatever the texts repeat.
HITS = 500_000


def normal(text: str | None) -> str:
    return " ".join(text.lower().replace("\0", " ").split()) if text else ""


def budget(m: int, q: int, percent: int) -> int:
    """Edits allowed for an item of m characters: percent of m, and few enough for the bound to ask for a q-gram."""
    return max(0, min(m * percent // 100, (m - q) // q))


def _codes(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes, q: int):
    """Hashes of all q-grams of an array of characters."""
    import numpy as np

    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, c = np.zeros(n, np.uint64), codes.astype(np.uint64)
    for i in range(q):
        h *= np.uint64(BASE)
        h += c[i : i + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def compiled(items: list[tuple[int, str]], q: int, percent: int) -> dict:
    """Sorted q-gram hashes of all items with (item, position) of each, a bit filter and each item's bound."""
    import numpy as np

    texts = [normal(t) for _, t in items]
    hashes = [grams(_codes(t), q) for t in texts]
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(items)), [len(x) for x in hashes])
    place = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else item
    order = np.argsort(h, kind="stable")
    filled = np.zeros(1 << FILTER_BITS, bool)
    filled[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    edits = np.array([budget(len(t), q, percent) for t in texts], np.int64)
    least = np.array([max(1, len(t) + 1 - q - q * e) for t, e in zip(texts, edits)], np.int64)
    short: dict[int, dict[str, list[int]]] = {}
    for i, t in enumerate(texts):
        if 0 < len(t) < q:
            short.setdefault(t.count(" ") + 1, {}).setdefault(t, []).append(i)
    return {"short": short, "ids": [i for i, _ in items], "texts": texts, "h": h[order], "item": item[order], "place": place[order], "filled": filled, "edits": edits, "least": least, "width": edits + 1}


def align(pattern: str, text: str, most: int) -> tuple[int, int, int] | None:
    """(edits, start, length) of the best occurrence of pattern in a text little longer than it, if it has at most `most`
    edits; ties go to the first end. The text is a band's: every column is within reach."""
    import numpy as np

    at = text.find(pattern)
    if at >= 0:
        return 0, at, len(pattern)
    t = _codes(text)
    n = len(t)
    cost, start = np.zeros(n + 1, np.int32), np.arange(n + 1, dtype=np.int32)
    ramp = np.arange(n + 1, dtype=np.int32)
    for i, c in enumerate(_codes(pattern), 1):
        sub = cost[:-1] + (t != c)
        gap = cost + 1
        new = gap.copy()
        better = sub <= new[1:]
        new[1:] = np.where(better, sub, new[1:])
        begin = start.copy()
        begin[1:] = np.where(better, start[:-1], begin[1:])
        # Characters of the text left out: the least over all columns before, plus the way.
        low = new - ramp
        best = np.minimum.accumulate(low)
        first = np.maximum.accumulate(np.where(low == best, ramp, 0))
        cost, start = best + ramp, begin[first]
        if cost.min() > most:
            return None
    end = int(cost.argmin())
    return (int(cost[end]), int(start[end]), end - int(start[end])) if cost[end] <= most else None


def whole_words(texts: list[str], b: dict) -> list[tuple]:
    """The first place of each item of fewer than q characters, as whole words: (document, item, start, length, edits)."""
    out = []
    for d, text in enumerate(texts):
        words, starts = text.split(" "), [0]
        for w in words:
            starts.append(starts[-1] + len(w) + 1)
        for n, known in b["short"].items():
            met: set = set()
            for at in range(len(words) - n + 1):
                run = words[at] if n == 1 else " ".join(words[at : at + n])
                if run in known and run not in met:
                    met.add(run)
                    out += [(d, i, starts[at], len(run), 0) for i in known[run]]
    return out


def apart(places: set) -> list[tuple[int, int, int]]:
    """Of places (start, length, edits) those that don't overlap a better one, in order: fewer edits, then an earlier start.
    Neighbouring bands find one occurrence twice."""
    taken: list = []
    for place in sorted(places, key=lambda x: (x[2], x[0], x[1])):
        at = bisect.bisect(taken, place)
        before, after = taken[at - 1 : at] if at else [], taken[at : at + 1]
        if not any(x[0] < place[0] + max(1, place[1]) and place[0] < x[0] + max(1, x[1]) for x in (*before, *after)):
            taken.insert(at, place)
    return taken


def scan(doc_ids: list, texts: list[str], b: dict, q: int) -> list[tuple]:
    """Occurrences of a block's items in texts: (doc_id, item_id, start, length, edits) on normalised characters."""
    found = {(d, i): [x] for d, i, *x in whole_words(texts, b)} if b["short"] else {}
    if len(b["h"]):
        found |= banded(texts, b, q)
    return [(doc_ids[d], b["ids"][i], *x) for (d, i), places in sorted(found.items()) for x in places]


def banded(texts: list[str], b: dict, q: int) -> dict:
    """The occurrences of each longer item in each text, none overlapping another of it: (document, item) to a list of (start,
    length, edits)."""
    import numpy as np

    whole = "\0".join(texts)
    h = grams(_codes(whole), q)
    at = np.flatnonzero(b["filled"][(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    lo = np.searchsorted(b["h"], h[at], "left")
    n = np.searchsorted(b["h"], h[at], "right") - lo
    at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
    ends = np.cumsum([len(t) + 1 for t in texts])
    out: dict = {}
    # Item places lie at most this far before a hit; it also keeps bands from being negative.
    shift = int(b["place"].max()) + 1
    held = tuple(np.zeros(0, np.int64) for _ in range(4))
    upto = np.cumsum(n)
    first = 0
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + HITS, "right")))
        new = _bands(at[first:last], lo[first:last], n[first:last], ends, shift, b)
        doc, item, band, size = _added(*(np.concatenate(x) for x in zip(held, new)))
        # Bands that begin far enough before the next hit are complete.
        ended = (band + 2) * b["width"][item] + shift < at[last] if last < len(at) else np.ones(len(doc), bool)
        for i in np.flatnonzero(ended & (size >= b["least"][item])):
            _verify(int(doc[i]), int(item[i]), int(band[i]), shift, ends, texts, b, out)
        held, first = tuple(x[~ended] for x in (doc, item, band, size)), last
    return {key: apart(places) for key, places in out.items()}


def _added(doc, item, band, size):
    """Equal (document, item, band) once, with their sizes added up."""
    import numpy as np

    if not len(doc):
        return doc, item, band, size
    order = np.lexsort((band, item, doc))
    doc, item, band, size = doc[order], item[order], band[order], size[order]
    new = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])]))
    return doc[new], item[new], band[new], np.add.reduceat(size, new)


def _bands(at, lo, n, ends, shift: int, b: dict):
    """(document, item, band, size) of some hits: size counts the item places that a band holds, each once."""
    import numpy as np

    which = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    item, place, pos = b["item"][which], b["place"][which], np.repeat(at, n)
    doc = np.searchsorted(ends, pos, "right")
    # Place of the item's begin, shifted so that it isn't negative; a hit counts in its band and the one before.
    band = (pos - place + shift) // b["width"][item]
    band, doc, item, place = np.concatenate([band, band - 1]), np.tile(doc, 2), np.tile(item, 2), np.tile(place, 2)
    order = np.lexsort((place, band, item, doc))
    band, doc, item, place = band[order], doc[order], item[order], place[order]
    same = (band[1:] == band[:-1]) & (item[1:] == item[:-1]) & (doc[1:] == doc[:-1])
    once = np.concatenate([[True], ~(same & (place[1:] == place[:-1]))])
    new = np.flatnonzero(np.concatenate([[True], ~same]))
    return doc[new], item[new], band[new], np.add.reduceat(once.astype(np.int64), new)


def _verify(d: int, i: int, band: int, shift: int, ends, texts: list[str], b: dict, out: dict) -> None:
    """Align an item inside a band of a text."""
    e, w, begin = int(b["edits"][i]), int(b["width"][i]), int(ends[d]) - len(texts[d]) - 1
    lo = max(0, band * w - shift - e - begin)
    window = texts[d][lo : max(0, band * w - shift + 2 * w + len(b["texts"][i]) + e - begin)]
    found = align(b["texts"][i], window, e)
    if found:
        out.setdefault((d, i), set()).add((lo + found[1], found[2], found[0]))


def _scanner(block, q: int, chars: int = 1_000_000):
    def run(batches):
        b, kind = block.value, pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("edits", pa.int32())])

        def put(ids, texts):
            return pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in scan(ids, texts, b, q)], schema=kind)

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                texts.append(normal(text))
                size += len(texts[-1])
                if size >= chars:
                    yield put(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield put(ids, texts)

    return run


def occurrences(docs: DataFrame, benchmark: DataFrame, *, q: int = Q, percent: int = PERCENT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Approximate occurrences of benchmark (item_id, text) in docs (doc_id, text): doc_id, item_id, start, length, edits on
    normalised characters. Those of one item in one text don't overlap: of two that do, the one with fewer edits stays, then
    the earlier. An item of fewer than q characters is reported once a text, at its first place. Only whole items count: a
    text that lacks more of an item than `percent` edits does not hold it."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    out = local_table(spark, [], FOUND)
    items, size = [], 0

    def passed() -> DataFrame:
        return out.union(rows.mapInArrow(_scanner(spark.sparkContext.broadcast(compiled(items, q, percent)), q), FOUND))

    # One block at a time is on the driver.
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        if normal(r["text"]):
            items.append((r["item_id"], r["text"]))
            size += len(r["text"])
            if size >= block_chars:
                out, items, size = passed(), [], 0
    return passed() if items else out
