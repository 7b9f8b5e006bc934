"""Token ids of texts, by the tokenizers library, with a bounded cache of the words that lie between blanks.

In a byte-level vocabulary with this pre-tokeniser a blank that comes before a visible character always starts a new
pre-token, so the ids of a text are those of its words in a row, each with the blank before it. A batch's distinct
words are found in Arrow, those not met before are encoded by the library in one string (an id that begins with a blank
begins a word), and each text's ids are gathered by numpy. Letters followed by ASCII punctuation are encoded apart from
it, as a pre-token ends there. Texts with other blanks (doubled, at the end, before a line break) are encoded whole.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CACHE_WORDS, CACHE_TAILS = 250_000, 20_000
# a character that no definition of white space includes
_VISIBLE = "^[!-~¡-ᙿ가-퟿]"
# letters, then something that ends their pre-token: no letter, no apostrophe
_STEM = r"(?s)^(?P<head>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-&(-/:-@\[-`{-~\n].*)$"
_AT_ONCE = 2000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs data[start : start + size], one after the other."""
    ends = np.cumsum(size)
    return data[np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist()


class _Store:
    """Runs of ids by place. The first run is empty."""

    def __init__(self):
        self.data, self.start, self.size = np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def add(self, data: np.ndarray, size: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.data) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.data = np.concatenate([self.data, data])

    def cut(self, places: int) -> None:
        self.start, self.size = self.start[:places].copy(), self.size[:places].copy()
        self.data = self.data[: int(self.start[-1] + self.size[-1])].copy()


class TokenEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str | None = None, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path or default_vocabulary())
        self.size = self._tokenizer.get_vocab_size()
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._blank = np.zeros(self.size, bool)  # ids that begin with a blank
        self._blank[[k for t, k in self._tokenizer.get_vocab().items() if t.startswith("Ġ")]] = True
        # a word's place in the store, 0 if it can't be told apart; young: of this batch
        self._words: dict[str, int] = {}
        self._young: dict[str, int] = {}
        self._store, self._kept = _Store(), 1
        self._tails: dict[str, np.ndarray] = {}
        self._limit = cache_words

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text by itself."""
        return [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, texts: list[str]) -> list[bytes]:
        return [x.astype("<u4").tobytes() for x in self._ids(texts)]

    def _run(self, words: list[str]) -> None:
        """Puts words, each with a blank before it, in the store."""
        if not words:
            return
        data, sizes = [], []
        for k in range(0, len(words), _AT_ONCE):
            part = [" " + w for w in words[k : k + _AT_ONCE]]
            ids = self._ids(["".join(part)])[0]
            starts = np.flatnonzero(self._blank[ids])
            if len(starts) == len(part) and starts[0] == 0:
                data.append(ids)
                sizes.append(np.diff(starts, append=len(ids)))
            else:
                own = self._ids(part)
                data += own
                sizes.append(np.array([len(x) for x in own], np.int64))
        self._young.update(zip(words, range(len(self._store.start), len(self._store.start) + len(words))))
        self._store.add(np.concatenate(data), np.concatenate(sizes))

    @staticmethod
    def _places(known: dict[str, int], words: list[str]) -> np.ndarray:
        return np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))

    def _learn(self, words: pa.Array) -> None:
        """Puts words that were not met before in the store."""
        good = pc.match_substring_regex(words, _VISIBLE)
        for token in self._special:
            good = pc.and_not(good, pc.match_substring(words, token))
        self._young.update(dict.fromkeys(_strings(words.filter(pc.invert(good))), 0))
        words = words.filter(good)
        parts = pc.extract_regex(words, _STEM)
        tailed = pc.is_valid(parts)
        plain, parts, words = words.filter(pc.invert(tailed)), parts.filter(tailed), words.filter(tailed)
        heads = parts.field("head")
        new = _strings(pa.concat_arrays([plain, heads]).unique())
        self._run([w for w, k in zip(new, self._places(self._words, new).tolist()) if k < 0])
        if not len(words):
            return
        tails = parts.field("tail").dictionary_encode()
        names = _strings(tails.dictionary)
        unknown = [t for t in names if t not in self._tails]
        self._tails.update(zip(unknown, self._ids(unknown)))
        ends = [self._tails[t] for t in names]
        # runs of head and tail by turns
        data, at = np.concatenate([self._store.data, *ends]), np.array([len(x) for x in ends], np.int64)
        first = len(self._store.data) + np.cumsum(at) - at
        stems = _strings(heads)
        head = self._places(self._words, stems)
        head = np.where(head < 0, self._places(self._young, stems), head)
        tail = tails.indices.to_numpy()
        start = np.stack([self._store.start[head], first[tail]], 1).ravel()
        size = np.stack([self._store.size[head], at[tail]], 1)
        names = _strings(words)
        self._young.update(zip(names, range(len(self._store.start), len(self._store.start) + len(names))))
        self._store.add(_gather(data, start, size.ravel()), size.sum(1))

    def _settle(self) -> None:
        """Keeps the batch's new words while there is room: the words met first hold the frequent ones."""
        if len(self._words) < self._limit:
            self._words.update(self._young)
            self._kept = len(self._store.start)
        else:
            self._store.cut(self._kept)
        self._young.clear()
        if len(self._tails) > CACHE_TAILS:
            self._tails.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets = split.offsets.to_numpy()
        flat = split.values.dictionary_encode()
        names = flat.dictionary
        place = self._places(self._words, _strings(names))
        new = np.flatnonzero(place < 0)
        if len(new):
            unknown = names.take(pa.array(new))
            self._learn(unknown)
            place[new] = self._places(self._young, _strings(unknown))
        places = place[flat.indices.to_numpy()]
        head = offsets[:-1]
        places[head] = -1
        odd = np.add.reduceat((places == 0).astype(np.int64), head) > 0
        # first words have no blank before them: runs of their own, at the end
        whole = np.flatnonzero(odd).tolist()
        firsts = _strings(split.values.take(pa.array(head)))
        for k in whole:
            firsts[k] = texts[k]
        own = self._ids(firsts)
        for k in whole:
            places[offsets[k] : offsets[k + 1]] = 0
        places[head] = len(self._store.start) + np.arange(len(texts))
        sizes = np.array([len(x) for x in own], np.int64)
        data = np.concatenate([self._store.data, *own])
        start = np.concatenate([self._store.start, len(self._store.data) + np.cumsum(sizes) - sizes])
        size = np.concatenate([self._store.size, sizes])[places]
        ids = _gather(data, start[places], size).astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.add.reduceat(size, head))).tolist()
        self._settle()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]


_ENCODERS: dict = {}


def encoder(path: str | None = None) -> TokenEncoder:
    """This worker's encoder."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TokenEncoder(path)
    return _ENCODERS[path]
