"""Tokenization inside Spark tasks with the `tokenizers` library.

The tokenizer's rules never join text over ASCII white space, so a text's ids are its words' ids one after another; each
worker keeps the ids of words that it has met (a bounded cache) and encodes only new ones. New words are cut where the rules
cut them anyway and encoded many in one string: an id that ends a piece tells where the next one begins.
"""

from __future__ import annotations

import os
import re
import threading

#: Words kept by one Python worker, about 150 bytes each; words beyond are encoded each time they come.
CACHE_WORDS = 200_000
#: Bytes of text whose words are looked up at a time.
SLICE = 1 << 22
#: Pieces encoded in one string.
JOINED = 500
#: Words whose pieces are known: printable ASCII without apostrophes (some of which begin a suffix) and Latin-1 letters. No other
#: character composes with these, and their lower case is one of them.
_SIMPLE = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_ENCODERS: dict = {}
#: A worker that encodes nothing for so many seconds lets its encoders go: Spark keeps idle workers for a minute and gives them to
#: other queries' stages.
IDLE_SECONDS = 3.0
_IDLE: list[threading.Timer] = []


class WordEncoder:
    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.cache: dict[str, bytes] = {}
        # Which ids end a piece, where the vocabulary tells.
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool) if suffix else None
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _encode(self, words: list[str]) -> list[bytes]:
        import numpy as np

        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without white space, joined by it. None gives less than one run of ids, so as many runs as pieces are
        one each; if there are more, the pieces are encoded one by one."""
        import numpy as np

        out: list[bytes] = []
        for lo in range(0, len(pieces), JOINED):
            some = pieces[lo : lo + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            last = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(last) != len(some) or last[-1] != 4 * len(ids):
                out += self._encode(some)
                continue
            data, last = ids.tobytes(), last.tolist()
            out += [data[a:b] for a, b in zip([0, *last], last)]
        return out

    def _pieces(self, word: str) -> list[str] | tuple[str] | None:
        """A word as pieces that the tokenizer separates anyway: letters, digits, runs of marks; None: it stays whole, as
        lower-casing or composing may change its letters, or as it may spell a special token, which is matched as it is."""
        if self.ends is None:
            return None
        if word.isascii() and word.isalpha():
            return (word.lower(),)
        if "<|" in word or not _SIMPLE.fullmatch(word):
            return None
        return _PIECES.findall(word.lower())

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words without white space."""
        cache = self.cache
        out = list(map(cache.get, words))
        missing = [i for i, ids in enumerate(out) if ids is None]
        if not missing:
            return out
        pieces = [self._pieces(words[i]) for i in missing]
        whole = [words[i] for i, ps in zip(missing, pieces) if ps is None]
        new = list({p for ps in pieces if ps for p in ps if p not in cache})
        of = dict(zip(new, self._encode_pieces(new)))
        for lo in range(0, len(whole), 20_000):
            of.update(zip(whole[lo : lo + 20_000], self._encode(whole[lo : lo + 20_000])))
        get = lambda p: of[p] if p in of else cache[p]
        for i, ps in zip(missing, pieces):
            out[i] = get(words[i]) if ps is None else get(ps[0]) if len(ps) == 1 else b"".join(map(get, ps))
        if len(cache) < CACHE_WORDS:
            cache.update(of)
            cache.update((words[i], out[i]) for i in missing)
        return out

    def encode_column(self, texts) -> list[bytes]:
        """Ids of each text of an Arrow array of strings; see `encode`. Arrow splits the texts, numbers their distinct words and
        puts the words' ids in a row again."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = lists.flatten().dictionary_encode()
        ids = pa.array(self._ids_of(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
        ends = np.cumsum(lists.value_lengths().to_numpy())
        if not len(ids):
            return [b""] * len(texts)
        _, offsets, data = ids.buffers()
        at = np.frombuffer(offsets, np.int64)[ids.offset :][np.concatenate([[0], ends])].tolist()
        data = memoryview(data) if data is not None else b""
        return [bytes(data[a:b]) for a, b in zip(at, at[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; null and empty texts have none."""
        import pyarrow as pa

        return self.encode_column(pa.array(texts, pa.large_string()))


def encoder(path: str, special_as_text: bool = False) -> WordEncoder:
    """The worker's own encoder for a vocabulary file."""
    _keep_encoders()
    key = (path, special_as_text)
    found = _ENCODERS.get(key)
    if found is None:
        found = _ENCODERS[key] = WordEncoder(path, special_as_text)
    return found


def _keep_encoders() -> None:
    while _IDLE:
        _IDLE.pop().cancel()


def _release_later() -> None:
    """Let the encoders go if none is asked for within IDLE_SECONDS. A task that has one by then keeps it to its end."""
    _keep_encoders()
    _IDLE.append(threading.Timer(IDLE_SECONDS, _release))
    _IDLE[-1].daemon = True
    _IDLE[-1].start()


def _release() -> None:
    import ctypes

    _ENCODERS.clear()
    # What is free stays with the process otherwise; only glibc has this.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim:
        trim(0)


def _slices(batch):
    """A batch in slices of about SLICE bytes of text."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
    nth = np.cumsum(sizes) // SLICE
    cuts = [0, *(np.flatnonzero(nth[1:] != nth[:-1]) + 1).tolist(), batch.num_rows]
    return [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]


def encoded_batches(batches, path: str, special_as_text: bool = False):
    """(ids of a few documents, their texts' ids) from record batches of (doc_id, text)."""
    import pyarrow as pa

    enc = encoder(path, special_as_text)
    try:
        for batch in batches:
            for some in _slices(batch):
                yield some.column(0).to_pylist(), enc.encode_column(some.column(1))
    finally:
        # The worker stays; what Arrow holds in reserve needn't.
        pa.default_memory_pool().release_unused()
        _release_later()
