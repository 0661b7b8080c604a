"""Features of plain texts, many texts at once, in numpy.

A text is plain if none of the costlier rules of extraction can apply to it: its characters
are those that NFKC leaves alone, and it holds nothing like a link, a mail address, a tag, a
character reference or a character that takes no room. What is left are words, word pairs,
numbers, capitals, marks and signs. A feature is a number here: of a word, or of a pair of them.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

try:
    from _md5 import md5  # half the time of hashlib's for short inputs
except ImportError:
    from hashlib import md5

from .text import CLAUSE_ENDS, CURRENCY, INVISIBLE, STABLE

_STABLE_TEXT = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04X}", STABLE) + r"*+\Z")
# the last one has a capital that only newer tables of characters know
_ABSENT = ("@", "://", *INVISIBLE, "\u019b")
_REFERENCE = re.compile("&[#A-Za-z][A-Za-z0-9]*;")
_HOST = re.compile(r"[wW]{3}\.|\.[a-z][a-z]")
#: Texts beyond the bounds of the grammar have a dot beside a run of this, or many runs of it with dots between.
_RUN_AFTER_DOT, _LONG_RUN = re.compile(r"\.[A-Za-z0-9-]"), re.compile(r"[A-Za-z0-9-]{64}")
_TOKEN = re.compile(rf"[^\W_]+|[{re.escape(CLAUSE_ENDS)}]")
_SIGN = re.compile(f"[{CURRENCY}]")
_MARK, _NUMBER, _SHORT, _WORD, _CAPS = 0, 1, 2, 4, 8
#: Characters handled at once, and words remembered.
CHUNK, MOST_WORDS = 1 << 20, 500_000
_LOW = (1 << 32) - 1
#: Weights that differ by less may be equal, or change places, once rounded to six digits.
NEAR = 4e-6


def is_plain(text: str) -> bool:
    if any(c in text for c in _ABSENT) or ("<" in text and ">" in text) or _HOST.search(text) or ("&" in text and _REFERENCE.search(text)):
        return False
    if not (text.isascii() or _STABLE_TEXT.match(text)):
        return False
    return len(_RUN_AFTER_DOT.findall(text)) < 64 and not any(len(part) >= 64 and _LONG_RUN.search(part) for part in text.split())


def _md5_32(features: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([md5(f, usedforsecurity=False).digest() for f in features]), ">u4")[::4].astype(np.uint64)


def _xxh3_32(features: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(f) >> 32 for f in features), np.uint64, len(features))


_HASHES: dict[str, Callable[[list[bytes]], np.ndarray]] = {"md5": _md5_32, "xxh3": _xxh3_32}


class Words(dict):
    """Numbers of tokens, with the kind of each and the number of its feature."""

    def __init__(self, least: int, most: int, pairs: bool) -> None:
        super().__init__()
        self.least, self.most, self.pairs = least, most, pairs
        self.kinds, self.features = array("b"), array("q")
        self.names: list[bytes] = []
        self.number: dict[bytes, int] = {}
        self.caps, self.bang = self.named(b"caps:"), self.named(b"punct:!")

    def named(self, name: bytes) -> int:
        n = self.number.get(name)
        if n is None:
            n = self.number[name] = len(self.names)
            self.names.append(name)
        return n

    def __missing__(self, token: str) -> int:
        if token in CLAUSE_ENDS:
            kind, feature = _MARK, 0
        elif token.isnumeric():
            kind, feature = _NUMBER, self.named(b"num:%d" % min(len(token), 12))
        else:
            low = token.lower()
            kind = (_WORD if self.least <= len(token) <= self.most else _SHORT) | (_CAPS if len(token) >= 3 and token != low and token == token.upper() else 0)
            feature = self.named(b"w:" + low.encode()) if kind & _WORD else 0
        n = self[token] = len(self.kinds)
        self.kinds.append(kind)
        self.features.append(feature)
        return n

    def met(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each time a feature is met: the text's number, the feature's, and a place that rises in the order of the text. By kind, not in order."""
        flat: list[str] = []
        ends, marks = np.empty(len(texts), np.int64), []
        for i, t in enumerate(texts):
            flat += _TOKEN.findall(t)
            ends[i] = len(flat)
            marks += [(i, self.bang)] * t.count("!")
            marks += [(i, self.named(b"sym:" + s.encode())) for s in _SIGN.findall(t)]
        at = np.fromiter(map(self.__getitem__, flat), np.int64, len(flat))
        kind, feature = np.array(self.kinds, np.int8)[at], np.array(self.features, np.int64)[at]
        text = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        place = np.arange(1, len(flat) + 1) << 2
        word, number, caps = (kind & _WORD) > 0, kind == _NUMBER, (kind & _CAPS) > 0
        pair = np.flatnonzero(word[1:] & word[:-1] & (text[1:] == text[:-1])) + 1 if self.pairs else np.empty(0, np.int64)
        before = np.array(marks, np.int64).reshape(-1, 2)
        texts_ = [before[:, 0], text[number], text[caps], text[word], text[pair]]
        codes = [before[:, 1], feature[number], np.full(int(caps.sum()), self.caps), feature[word], feature[pair] | (feature[pair - 1] + 1) << 32]
        places = [np.zeros(len(before), np.int64), place[number], place[caps], place[word] + 1, place[pair] + 2]
        return np.concatenate(texts_), np.concatenate(codes), np.concatenate(places)

    def named_all(self, codes: np.ndarray) -> list[bytes]:
        """The features of numbers."""
        names = self.names
        return [b"w2:%b_%b" % (names[(c >> 32) - 1][2:], names[c & _LOW][2:]) if c > _LOW else names[c] for c in codes.tolist()]


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK characters."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


class Extractor:
    """Extraction in one task; words met before are remembered."""

    def __init__(self, least: int, most: int, pairs: bool) -> None:
        self._args = (least, most, pairs)
        self.words = Words(*self._args)

    def met(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """By chunk: first and last text, and the arrays of ``Words.met``; numbers of features hold until the next chunk."""
        for first, last in chunks(texts):
            if len(self.words) > MOST_WORDS:
                self.words = Words(*self._args)
            yield first, last, *self.words.met(texts[first:last])

    def hashed(self, texts: list[str], mode: str, each: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the texts' bags, and all bags, one after the other: the hash in the upper and the count in the lower 32 bits.

        Features that share a hash are added up, or with ``each`` stand apart.
        """
        ends, bags = [np.zeros(1, np.int64)], [np.empty(0, np.int64)]
        for first, last, text, code, _ in self.met(texts):
            inverse, codes = pd.factorize(code)
            h = _HASHES[mode](self.words.named_all(codes)) if len(codes) else np.empty(0, np.uint64)
            keys, n = np.unique(text.astype(np.uint64) << np.uint64(32) | (inverse.astype(np.uint64) if each else h[inverse]), return_counts=True)
            low = keys & np.uint64(_LOW)
            ends.append(ends[-1][-1] + np.searchsorted(keys >> np.uint64(32), np.arange(last - first, dtype=np.uint64), "right"))
            bags.append(((h[low.astype(np.int64)] if each else low) << np.uint64(32) | n.astype(np.uint64)).view(np.int64))
        return np.concatenate(ends), np.concatenate(bags)

    def strongest(self, texts: list[str], mode: str, rates: np.ndarray, k: int, logs: bool) -> tuple[np.ndarray, list[bytes], list[int]]:
        """Ends of the texts' parts, features and counts: of each text those that may be among the ``k`` that weigh most.

        What weighs less than the k-th by more than rounding to six digits can hide is left
        out, and of features of one count and ratio all but the first k by name.
        """
        ends, names, counts = [0], [], []
        for first, last, text, code, _ in self.met(texts):
            inverse, codes = pd.factorize(code)
            if not len(codes):
                ends += [ends[-1]] * (last - first)
                continue
            r = rates[(_HASHES[mode](self.words.named_all(codes)) & np.uint64(len(rates) - 1)).astype(np.int64)]
            keys, n = np.unique(text * len(codes) + inverse, return_counts=True)
            of, which = keys // len(codes), keys % len(codes)
            size = np.abs((1.0 + np.log(n) if logs else n) * r[which])
            order = np.lexsort((-size, of))
            starts, stops = (np.searchsorted(of, np.arange(last - first), side) for side in ("left", "right"))
            some = stops > starts
            least = np.full(last - first, np.inf)
            least[some] = size[order][np.minimum(starts + k, stops)[some] - 1] - NEAR
            for a, b, bound in zip(starts, stops, least, strict=True):
                near = a + np.flatnonzero(size[a:b] >= bound)
                found = list(zip(self.words.named_all(codes[which[near]]), n[near].tolist(), size[near].tolist(), strict=True))
                if len(found) > k:
                    seen: dict[float, int] = {}
                    kept = []
                    for one in sorted(found):
                        seen[one[2]] = seen.get(one[2], 0) + 1
                        if seen[one[2]] <= k:
                            kept.append(one)
                    found = kept
                names += [f for f, _, _ in found]
                counts += [c for _, c, _ in found]
                ends.append(len(names))
        return np.array(ends), names, counts

    def sizes(self, texts: list[str]) -> np.ndarray:
        """(features, occurrences, most) of each text's bag."""
        out = [np.empty((0, 3), np.int64)]
        for first, last, text, code, _ in self.met(texts):
            inverse, codes = pd.factorize(code)
            keys, n = np.unique(text * max(1, len(codes)) + inverse, return_counts=True)
            of, size = keys // max(1, len(codes)), last - first
            part = np.zeros((size, 3), np.int64)
            part[:, 0] = np.bincount(of, minlength=size)
            part[:, 1] = np.bincount(text, minlength=size)
            np.maximum.at(part[:, 2], of, n)
            out.append(part)
        return np.concatenate(out)
