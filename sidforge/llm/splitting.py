"""Cutting oversized texts at natural boundaries."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidforge.llm.tokens import VOCABULARY, Codec, codec, kind

MAX_TOKENS = 1_024
OVERLAP_TOKENS = 64
#: A run without any natural boundary gets an emergency boundary after so many tokens.
RUN_TOKENS = 16

#: Strength of a boundary.
FORCED, SPACE, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
_SENTENCE_ENDS = set(".!?…。！？")
_CLAUSE_ENDS = set(",;:、，；：)]}»”")
_EAST_ASIAN_ENDS = set("。！？、，；：")


@functools.cache
def _character(code: int) -> tuple[bool, bool, bool, bool, int, bool]:
    """Of a character: plain white, line break, letter, white, strength of a boundary after it, East Asian punctuation."""
    x = chr(code)
    return x in " \n\t\r", x in "\n\r", kind(x) == "L", kind(x) == " ", SENTENCE if x in _SENTENCE_ENDS else CLAUSE if x in _CLAUSE_ENDS else SPACE, x in _EAST_ASIAN_ENDS


def natural_boundaries(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """Strength of the natural boundary before each token but the first: FORCED where there is none, -1 within a character.

    ``offsets`` are the positions in the UTF-8 ``data`` at which tokens begin.
    """
    codes, starts = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32), (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    at = offsets[1:-1]
    out = np.full(len(at), -1, np.int64)
    whole = np.flatnonzero(starts[at])
    nth = np.cumsum(starts)[at[whole]] - 1
    unique, inverse = np.unique(codes, return_inverse=True)
    white, newline, letter, blank, strength, east_asian = (np.array(column) for column in zip(*map(_character, unique.tolist())))
    before, after = inverse[nth - 1], inverse[nth]
    spaced = ~blank[before] & white[after]
    out[whole] = np.where(spaced & newline[after], LINE, np.where(spaced | (east_asian[before] & letter[after]), strength[before], FORCED))
    for i in np.flatnonzero(out == LINE).tolist():
        if data[offsets[i + 1] : offsets[min(i + 5, len(offsets) - 1)]].lstrip(b" \t\r").startswith((b"\n\n", b"\n\r\n")):
            out[i] = PARAGRAPH
    return out


def atoms(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token positions where a text may be cut (first 0, last the number of tokens) and the strength of each."""
    n = len(offsets) - 1
    strength = natural_boundaries(data, offsets)
    cuts = np.flatnonzero(strength > FORCED) + 1
    bounds, possible = np.r_[0, cuts, n], np.flatnonzero(strength >= FORCED) + 1
    long, forced = np.diff(bounds) > RUN_TOKENS, []
    for start, end in zip(bounds[:-1][long].tolist(), bounds[1:][long].tolist()):
        while True:
            at = int(np.searchsorted(possible, start + RUN_TOKENS))
            if at == len(possible) or possible[at] >= end:
                break
            start = int(possible[at])
            forced.append(start)
    cuts = np.sort(np.r_[cuts, np.array(forced, np.int64)])
    return np.r_[0, cuts, n], np.r_[PARAGRAPH, strength[cuts - 1], PARAGRAPH]


def settled_runs(cuts: np.ndarray, strengths: np.ndarray, limit: int) -> np.ndarray:
    """Cuts that the heap has to decide about: those within a run that fits ``limit`` as a whole, between stronger boundaries, go first anyway.

    All boundaries of a run that are weaker than those around it are merged before any stronger one, and if the run fits,
    every merge within it does, so the run is one segment whatever the order.
    """
    kept = np.arange(len(cuts))
    for level in range(LINE, FORCED - 1, -1):
        walls = np.flatnonzero(np.r_[True, strengths[kept[1:-1]] > level, True]) if len(kept) > 2 else np.arange(len(kept))
        fits = np.diff(cuts[kept[walls]]) <= limit
        inside = np.repeat(fits, np.diff(walls))
        inside[walls[:-1]] = False
        kept = kept[np.r_[~inside, True]]
    return kept


def merge_atoms(cuts: np.ndarray, strengths: np.ndarray, limit: int) -> list[int]:
    """Positions in ``cuts`` that remain after merging neighbours, weakest boundary first, while both together fit ``limit``."""
    kept = settled_runs(cuts, strengths, limit)
    return kept[merge_pairs(cuts[kept].tolist(), strengths[kept].tolist(), limit)].tolist()


def merge_pairs(cuts: list[int], strengths: list[int], limit: int) -> list[int]:
    """As :func:`merge_atoms`, by a heap of all neighbouring pairs.

    Among equal strengths the earliest pair goes first, so pieces fill up in order. A pair that doesn't fit never will, so it
    leaves the heap.
    """
    n = len(cuts) - 1
    start, end, alive = list(range(n)), list(range(1, n + 1)), [True] * n
    previous, following = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(strengths[i], i - 1, i, cuts[i + 1] - cuts[i - 1]) for i in range(1, n)]
    heapq.heapify(heap)
    while heap:
        strength, a, b, size = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or following[a] != b or size > limit:
            continue
        now = cuts[end[b]] - cuts[start[a]]
        if now != size:
            if now <= limit:
                heapq.heappush(heap, (strength, a, b, now))
            continue
        end[a], alive[b], following[a] = end[b], False, following[b]
        if following[b] >= 0:
            previous[following[b]] = a
            heapq.heappush(heap, (strengths[end[a]], a, following[a], cuts[end[following[a]]] - cuts[start[a]]))
        if previous[a] >= 0:
            p = previous[a]
            heapq.heappush(heap, (strengths[start[a]], p, a, cuts[end[a]] - cuts[start[p]]))
    return [start[i] for i in range(n) if alive[i]]


def split_text(text: str, c: Codec, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """Pieces of ``text``: (first char, end char, tokens, tokens shared with the piece before, strength of its first boundary)."""
    ids = c.encode(text)
    if len(ids) <= max_tokens:
        return [(0, len(text), len(ids), 0, PARAGRAPH)] if ids else []
    data = text.encode()
    offsets = np.r_[0, np.cumsum(c.lengths[ids])]
    cuts, strengths = atoms(data, offsets)
    firsts = merge_atoms(cuts, strengths, max_tokens - overlap)
    out = []
    chars = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    char_at = lambda token: int(chars[offsets[token] - 1]) if token else 0
    for k, f in enumerate(firsts):
        core, end = int(cuts[f]), int(cuts[firsts[k + 1]]) if k + 1 < len(firsts) else len(ids)
        begin = core if not k else int(cuts[np.searchsorted(cuts, max(0, core - overlap))])
        while True:  # a cut within a run may, rarely, cost a token; then the overlap gives way
            size = len(c.encode(data[offsets[begin] : offsets[end]].decode()))
            if size <= max_tokens or begin >= core:
                break
            begin = int(cuts[np.searchsorted(cuts, begin, side="right")])
        out.append((char_at(begin), char_at(end), size, core - begin, int(strengths[f])))
    return out


def split_oversized(
    df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS
) -> DataFrame:
    """Pieces of every text of more than ``max_tokens`` tokens: ``<key>, piece_no, text, start_char, end_char, n_tokens, n_shared, boundary``.

    Atomic segments end where white space follows a visible character, after East Asian punctuation, and in runs without
    either after :data:`RUN_TOKENS` tokens. Neighbours are merged across their weakest boundary first as long as both and the
    overlap fit. Each piece but the first begins up to ``overlap`` tokens early, at a segment start. Pieces in order cover
    the text without a gap; none has more than ``max_tokens`` tokens when encoded by itself.

    Null, empty and blank texts and texts within the limit give no row. Repeated rows are split alike. Extra columns are
    ignored. The work is row-local; no shuffle.
    """
    if not 0 <= overlap < max_tokens - RUN_TOKENS:
        raise ValueError("overlap must leave room for a segment")
    rows = df.select(F.col(key), F.col(text).cast("string").alias("text")).where(F.octet_length("text") > max_tokens)
    name, kind_of_key = rows.columns[0], rows.schema[0].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(vocabulary)
        for frame in frames:
            for k, t in zip(frame[name], frame["text"]):
                pieces = split_text(t, c, max_tokens, overlap)
                if len(pieces) > 1:
                    a = list(zip(*pieces))
                    yield pd.DataFrame({name: [k] * len(pieces), "piece_no": range(len(pieces)), "text": [t[x:y] for x, y in zip(a[0], a[1])], "start_char": a[0], "end_char": a[1], "n_tokens": a[2], "n_shared": a[3], "boundary": a[4]})

    return rows.mapInPandas(run, f"`{name}` {kind_of_key}, piece_no int, text string, start_char bigint, end_char bigint, n_tokens int, n_shared int, boundary int")
