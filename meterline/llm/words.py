"""Pre-tokens and their ids for the word-level BPE vocabulary, exactly as its library gives them.

Pre-tokens never span white space, so a text is made of units that can be looked up one by one: the pre-tokens of its plain
stretches (characters up to U+024F and common punctuation), found by a regular expression, and, in whatever script, the words
between blanks that hold other characters, which the library encodes whole. Only texts with a special string go through the
library as they are.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: Characters at which NFC changes nothing and lower-casing and classes are the same in every Unicode version in use.
_SAFE = "\t-\r -~\xa0-ɏ‐-‧€"
_UNSAFE = re.compile(f"[^{_SAFE}]")
#: A word, between blanks, with a character that isn't safe.
_ODD = re.compile(f"[^ \t\n\r]*[^{_SAFE}][^ \t\n\r]*")
BLANKS = " \t\n\r"


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in [*range(0x20, 0x250), *range(0x2010, 0x2028), 0x20AC] if unicodedata.category(chr(c))[0] == kind)


_L, _N = _class("L"), _class("N")
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")
#: Units a worker keeps; beyond it the cache starts anew, so memory stays bounded.
CACHE = 600_000
#: And their characters.
CACHE_CHARS = 16 << 20
CHUNK = 1 << 19


def chunks(text: str):
    """A long text in parts that end before white space, which no pre-token spans."""
    if len(text) <= CHUNK:
        yield text
        return
    at = 0
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and text[end] not in BLANKS:
            end += 1
        yield text[at:end]
        at = end


def special(text: str) -> bool:
    return "<|" in text and any(s in text for s in SPECIAL)


def odd(unit: str) -> bool:
    return _UNSAFE.search(unit) is not None


def split(text: str) -> list[str]:
    """The units of a text without special strings, in order."""
    if not odd(text):
        return _SPLIT.findall(text.lower())
    units, at = [], 0
    for m in _ODD.finditer(text):
        units += _SPLIT.findall(text[at : m.start()].lower())
        units.append(m[0])
        at = m.end()
    return units + _SPLIT.findall(text[at:].lower())


class Table(dict):
    """The first tier: frequent units. What it lacks is looked up in the second, the worker's cache."""

    def __init__(self, frequent: dict, cache: dict):
        super().__init__(frequent)
        self.cache = cache

    def __missing__(self, unit: str):
        return self.cache[unit]


class Encoder:
    """The library's tokenizer behind a cache of units, which holds their ids (little-endian, 32 bits) or only their number.

    Missing pre-tokens are encoded many at once, blanks between them; a token that ends a word says where each one's ids end.
    """

    def __init__(self, path: str, counts: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.counts, self.cache, self.base = Tokenizer.from_file(path), counts, {}, {}
        self.get, self.held = self.cache.__getitem__, 0
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def start_from(self, base: dict) -> None:
        self.base = Table(base, self.cache)
        self.get = self.base.__getitem__

    def learn(self, units: set[str]) -> None:
        new = [w for w in units if w not in self.base and w not in self.cache]
        if not new:
            return
        self.held += sum(map(len, new))
        if len(self.cache) + len(new) > CACHE or self.held > CACHE_CHARS:
            self.cache.clear()
            new = [w for w in units if w not in self.base]
            self.held = sum(map(len, new))
        strange = [w for w in new if odd(w)]
        for at in range(0, len(strange), 1024):
            part = strange[at : at + 1024]
            ids = [x.ids for x in self.library.encode_batch_fast(part, add_special_tokens=False)]
            self.cache.update(zip(part, map(len, ids) if self.counts else (np.array(x, "<u4").tobytes() for x in ids)))
        new = [w for w in new if not odd(w)] if strange else new
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            ids = np.array(self.whole(" ".join(part)), "<u4")
            end = np.flatnonzero(self.ends[ids]) + 1
            if len(end) != len(part):
                raise ValueError("the vocabulary doesn't mark word ends")
            start = np.concatenate([[0], end[:-1]])
            if self.counts:
                self.cache.update(zip(part, (end - start).tolist()))
            else:
                raw = ids.tobytes()
                self.cache.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(part, start.tolist(), end.tolist()))

    def whole(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def batch(self, texts: list[str | None]) -> list:
        """For each text the number of its ids, or the ids' bytes; null and empty texts have none."""
        out: list = [0 if self.counts else b""] * len(texts)
        held, size = [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if special(text):
                ids = self.whole(text)
                out[i] = len(ids) if self.counts else np.array(ids, "<u4").tobytes()
                continue
            for part in chunks(text):
                held.append((i, split(part)))
                size += len(part)
                if size > 2 * CHUNK:
                    self._flush(held, out)
                    held, size = [], 0
        self._flush(held, out)
        return out

    def _flush(self, held: list[tuple[int, list[str]]], out: list) -> None:
        self.learn(set().union(*(words for _, words in held)))
        get = self.get
        for i, words in held:
            out[i] += sum(map(get, words)) if self.counts else b"".join(map(get, words))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, counts: bool, use: str = "") -> Encoder:
    """This worker's encoder for a vocabulary and use, kept over tasks; the last few uses only."""
    key = path, counts, use
    if key not in _ENCODERS:
        while len(_ENCODERS) > 2:
            del _ENCODERS[next(iter(_ENCODERS))]
        _ENCODERS[key] = Encoder(path, counts)
    return _ENCODERS[key]
