"""Words of texts as 64-bit hashes, whole batches at a time."""

from __future__ import annotations

import functools
import html
import re
import sys
import unicodedata

import numpy as np

#: Words of a shingle.
SHINGLE = 5
#: Characters that are worked on at a time; longer texts are taken in parts that end between words.
PART_CHARS = 1 << 21

_EAST_ASIAN = "぀-ヿ㐀-鿿가-힯"
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,100}>")
#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = str.maketrans({"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "һ": "h", "ѕ": "s", "ԁ": "d", "α": "a", "ο": "o", "ι": "i", "ν": "v"})
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


@functools.cache
def _every_char() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))


@functools.cache
def _visible() -> np.ndarray:
    """Which code points are no combining mark and no invisible format character."""
    table = np.ones(sys.maxunicode + 1, bool)
    table[[ord(ch) for ch in _every_char() if unicodedata.category(ch) in ("Cf", "Mn")]] = False
    return table


@functools.cache
def _classes() -> np.ndarray:
    """For each code point: 0 between words, 1 part of a word, 2 a word of its own (East Asian)."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for value, pattern in ((1, r"[^\W_]"), (2, f"[{_EAST_ASIAN}]")):
        table[np.frombuffer("".join(re.findall(pattern, _every_char())).encode("utf-32-le"), np.uint32)] = value
    return table


def normal(text: str) -> str:
    """Text for comparison: entities, escapes and tags resolved, marks and invisible characters dropped, look-alikes unified, lower case."""
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text).replace("\\n", "\n").replace("\\t", " ").replace('\\"', '"')
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        codes = np.frombuffer(unicodedata.normalize("NFKD", text).encode("utf-32-le", "surrogatepass"), np.uint32)
        text = codes[_visible()[codes]].tobytes().decode("utf-32-le", "surrogatepass")
        return unicodedata.normalize("NFC", text).casefold().translate(LOOKALIKES)
    return text.lower()


@functools.lru_cache(maxsize=1)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    up, down = np.full(length, _BASE, np.uint64), np.full(length, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _hashed(codes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in an array of code points, and where they start."""
    inside, single = classes == 1, classes == 2
    before = np.r_[False, inside[:-1]]
    starts = np.flatnonzero((inside & ~before) | single)
    after = np.r_[inside[1:], False]
    ends = np.flatnonzero((inside & ~after) | single) + 1
    up, down = _powers(PART_CHARS if len(codes) <= PART_CHARS else 1 << int(np.ceil(np.log2(len(codes)))))
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes.astype(np.uint64) * up[: len(codes)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= _MULTIPLIER
    h ^= h >> np.uint64(29)
    return h, starts


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all ``texts``, in order, and the bounds of each text's words among them."""
    plain = [normal(t) for t in texts]
    lengths = np.array([len(t) + 1 for t in plain], np.int64)
    codes = np.frombuffer("".join(t + "\n" for t in plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    classes, hashes, starts, at = _classes()[codes], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(codes):
        end = min(len(codes), at + PART_CHARS)
        if end < len(codes):
            gaps = np.flatnonzero(classes[at:end] != 1)
            end = at + int(gaps[-1]) + 1 if len(gaps) else end + int(np.argmax(classes[end:] != 1))
        h, s = _hashed(codes[at:end], classes[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), np.r_[0, np.cumsum(lengths)])


def shingles(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of the word five-grams, in order; none for shorter texts."""
    n = max(0, len(words) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for i in range(SHINGLE if n else 0):
        h = (h ^ words[i : i + n]) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    return h
