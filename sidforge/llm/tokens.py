"""Exact encoding of whole texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a leaf of the concatenation tree; longer texts are halved until they fit.
LEAF_CHARS = 4_096
#: Texts above this many characters have their leaves encoded by different tasks.
SPREAD_CHARS = 1_000_000


class Codec:
    """Encoder of one vocabulary; results equal those of encoding every text in one go."""

    def __init__(self, path: str = VOCABULARY, leaf_chars: int = LEAF_CHARS):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.pieces[rank] = token
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.leaf_chars = leaf_chars

    def direct(self, text: str) -> list[int]:
        """Ids of ``text`` in one go; strings of special tokens are ordinary text."""
        return self._encoding.encode_ordinary(text)

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``, by tree concatenation when it is longer than a leaf; [] for null and empty texts."""
        if not text:
            return []
        if len(text) <= self.leaf_chars:
            return self.direct(text)
        half = len(text) // 2
        return self.concat(self.encode(text[:half]), self.encode(text[half:]))

    def concat_all(self, parts: list[list[int]]) -> list[int]:
        """Ids of the concatenated texts of ``parts``, joined pairwise as a balanced tree."""
        while len(parts) > 1:
            parts = [self.concat(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def concat(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the joined text of two encodings.

        A window around the join is encoded again. It is grown until each of its ends is a place where encoding can be cut
        (:func:`cuttable`) and its first and last token are the ones the two sides have there. Then every neighbouring pair
        of the result occurs in some valid encoding, which is what makes a sequence of byte-pair tokens the encoding of its
        text. At worst the window becomes the whole text.
        """
        if not left or not right:
            return left or right
        take_left, take_right = min(8, len(left)), min(8, len(right))
        while True:
            head, tail = left[: len(left) - take_left], right[take_right:]
            window = self.decode_bytes(left[len(head) :]) + self.decode_bytes(right[:take_right])
            before, after = self._context(head[-8:], window), self._context(None, window, tail[:8])
            left_ok, right_ok = not head or cuttable(*before), not tail or cuttable(*after)
            if left_ok and right_ok:
                middle = self.direct(window.decode())
                left_ok = not head or middle[0] == left[len(head)]
                right_ok = not tail or middle[-1] == right[take_right - 1]
                if left_ok and right_ok:
                    return head + middle + tail
            if not left_ok:
                take_left = min(2 * take_left, len(left))
            if not right_ok:
                take_right = min(2 * take_right, len(right))

    def _context(self, head: list[int] | None, window: bytes, tail: list[int] | None = None) -> tuple[str, str]:
        if tail is None:
            return last_char(self.decode_bytes(head)), first_char(window)
        return last_char(window), first_char(self.decode_bytes(tail))


def last_char(data: bytes) -> str:
    """Last whole character of ``data``, '' when it ends within one."""
    for n in range(1, min(4, len(data)) + 1):
        if data[-n] & 0xC0 != 0x80:
            try:
                return data[-n:].decode()
            except UnicodeDecodeError:
                return ""
    return ""


def first_char(data: bytes) -> str:
    """First whole character of ``data``, '' when it starts within one."""
    if not data or data[0] & 0xC0 == 0x80:
        return ""
    n = 1 if data[0] < 0x80 else 2 if data[0] < 0xE0 else 3 if data[0] < 0xF0 else 4
    try:
        return data[:n].decode()
    except UnicodeDecodeError:
        return ""


def kind(char: str) -> str:
    """'L' letter, 'N' number, ' ' white space of the split pattern, else 'P'."""
    category = unicodedata.category(char)[0]
    return category if category in "LN" else " " if char.isspace() or category == "Z" else "P"


def cuttable(before: str, after: str) -> bool:
    """Whether a text may be encoded on either side of this place independently (given agreeing tokens).

    True between a visible character and plain white space, which the split pattern always separates, and within a run of
    letters or numbers, where only the merges matter.
    """
    if not before or not after:
        return False
    a = kind(before)
    return (a in "LNP" and after in " \n\t\r") or (a in "LN" and kind(after) == a)


@functools.lru_cache(maxsize=4)
def codec(path: str = VOCABULARY, leaf_chars: int = LEAF_CHARS) -> Codec:
    """The worker's codec of ``path``."""
    return Codec(path, leaf_chars)


def encode_texts(
    df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, leaf_chars: int = LEAF_CHARS, spread_chars: int = SPREAD_CHARS
) -> DataFrame:
    """Token ids of every text: ``<key>, ids array<int>``, one row per input row.

    Null and empty texts give an empty list, blank texts the ids of their white space. Texts longer than ``leaf_chars`` are
    encoded by tree concatenation within their task; the leaves of texts above ``spread_chars`` are spread over the cluster,
    and only their ids come together again. Repeated rows are kept, also those with equal key. Extra columns are ignored. An
    empty table gives an empty result.
    """
    rows = df.select(F.col(key), F.col(text).cast("string").alias("text"))
    kind_of_key = rows.schema[0].dataType.simpleString()
    name = rows.columns[0]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, leaf_chars)
        for batch in batches:
            ids = [c.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[name, "ids"])

    short = rows.where(F.col("text").isNull() | (F.length("text") <= spread_chars)).mapInArrow(whole, f"`{name}` {kind_of_key}, ids array<int>")

    def leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, t in zip(frame[name], frame["text"]):
                n = -(-len(t) // leaf_chars)
                digest = f"{pd.util.hash_array(np.array([t], dtype=object), categorize=False)[0]:x}-{len(t)}"
                for at in range(0, n, 256):
                    part = range(at, min(n, at + 256))
                    yield pd.DataFrame({name: [k] * len(part), "digest": digest, "leaf": list(part), "text": [t[i * leaf_chars : (i + 1) * leaf_chars] for i in part]})

    def encode_leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(vocabulary, leaf_chars)
        for frame in frames:
            yield frame.drop(columns="text").assign(ids=[c.direct(t) for t in frame["text"]])

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        copies = int((frame["leaf"] == 0).sum())
        parts = frame.drop_duplicates("leaf").sort_values("leaf")["ids"]
        ids = codec(vocabulary, leaf_chars).concat_all([list(p) for p in parts])
        return pd.DataFrame({name: [frame[name].iloc[0]] * copies, "ids": [ids] * copies})

    long = (
        rows.where(F.length("text") > spread_chars)
        .mapInPandas(leaves, f"`{name}` {kind_of_key}, digest string, leaf int, text string")
        .repartition(name, "digest", "leaf")
        .mapInPandas(encode_leaves, f"`{name}` {kind_of_key}, digest string, leaf int, ids array<int>")
        .groupBy(name, "digest")
        .applyInPandas(grow, f"`{name}` {kind_of_key}, ids array<int>")
    )
    return short.unionByName(long)
