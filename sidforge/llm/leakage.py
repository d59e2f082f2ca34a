"""Evaluation passages leaking into a corpus, by size-partitioned MinHash containment search."""

from __future__ import annotations

import difflib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from sidforge.llm.graph import connected_components
from sidforge.llm.words import SHINGLE, normal, shingles, word_hashes
from sidforge.session import materialize

#: Minima of a sketch: the hashes are dealt out to so many bins by their top bits, and each bin has its least one (one-permutation MinHash).
BIN_BITS = 7
BINS = 1 << BIN_BITS
#: Shingles of a base block; the windows of each size class are unions of neighbouring blocks.
BLOCK = 16
#: A window is a candidate for a passage when at least so many minima agree.
MIN_AGREEING = 2
#: Passages sent to one pass over the corpus, so what is broadcast has this bound; what is known about them comes from all of them.
ITEMS_PER_PASS = 16_384
MIN_SHARE = 0.5
#: A sentence is held when its words align this well with one place of the document.
MIN_ALIGNED = 0.8
#: Exact containment of the passage's shingles in the whole document, below which alignments are put down to shared phrasing.
MIN_CONTAINMENT = 0.25
#: Characters of documents whose words are hashed together.
SLICE_CHARS = 1 << 20

_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+|(?<=[。！？])|\n+")
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SLOT_BITS = 22


def _digest(words: np.ndarray) -> int:
    """Signed 64-bit hash of a sequence of words."""
    import xxhash

    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(words.tobytes())).astype(np.int64)))


def sentence_words(text: str) -> list[np.ndarray]:
    """Word hashes of each sentence that has words."""
    parts = [s for s in _SENTENCE.split(normal(text)) if s]
    words, bounds = word_hashes(parts)
    return [words[a:b] for a, b in zip(bounds, bounds[1:]) if b > a]


def described_passages(items: DataFrame, item_key: str, passage: str) -> DataFrame:
    """``uid, item, sentences array<struct<nth, words, standard>>, telling``: what the search needs of each passage, by all of them.

    Passages with two successive sentences in common, or equal ones, are one family. ``standard`` are the sentences that
    passages of several families have (standard openings and the like); ``telling`` the shingles, of other sentences, that
    one family alone has. Both are counted over all items. Repeated rows count once.
    """
    rows = items.select(F.col(item_key).alias("item"), F.col(passage).cast("string").alias("passage")).where("item is not null and passage is not null").distinct()
    rows = rows.withColumn("uid", F.concat_ws(":", F.col("item").cast("string"), F.hex(F.xxhash64("passage"))))
    kind = rows.schema["item"].dataType.simpleString()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for uid, item, text in zip(frame["uid"], frame["item"], frame["passage"]):
                parts = sentence_words(text)
                digests = [_digest(p) for p in parts]
                whole = _digest(np.array(digests, np.int64))
                for i, p in enumerate(parts):
                    pair = _digest(np.array(digests[i : i + 2], np.int64)) if i + 1 < len(parts) else whole
                    out.append((uid, item, i, p.tobytes(), digests[i], pair))
            yield pd.DataFrame(out, columns=["uid", "item", "nth", "words", "digest", "link"])

    sentences = materialize(rows.mapInPandas(cut, f"uid string, item {kind}, nth int, words binary, digest bigint, link bigint"), "sentences")
    first = sentences.groupBy("link").agg(F.min("uid").alias("first"))
    related = connected_components(sentences.join(first, "link").where("uid != first").select(F.col("uid").alias("a"), F.col("first").alias("b")))
    placed = sentences.join(related.withColumnRenamed("node", "uid"), "uid", "left").withColumn("family", F.coalesce("component", "uid")).drop("component", "link")
    several = F.min("family") != F.max("family")
    shared = placed.groupBy("digest").agg(several.alias("standard"))
    known = materialize(placed.join(shared, "digest").select("uid", "item", "nth", "words", "family", "standard"), "known")

    def cut_shingles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [shingles(np.frombuffer(w, np.uint64)).view(np.int64) for w in frame["words"]]
            at = np.repeat(np.arange(len(frame)), [len(h) for h in found])
            yield frame.iloc[at].drop(columns="words").assign(h=np.concatenate([np.zeros(0, np.int64), *found]))

    pieces = known.select("uid", "family", "standard", "words").mapInPandas(cut_shingles, "uid string, family string, standard boolean, h bigint")
    own = pieces.groupBy("h").agg(several.alias("several")).where("not several").select("h")
    telling = pieces.where("not standard").select("uid", "h").distinct().join(own, "h").groupBy("uid").agg(F.sort_array(F.collect_list("h")).alias("telling"))
    whole = known.groupBy("uid").agg(F.first("item").alias("item"), F.array_sort(F.collect_list(F.struct("nth", "words", "standard"))).alias("sentences"))
    return materialize(whole.join(telling, "uid"), "passages")


class Passages:
    """The passages of one pass: sketches by size class and what the exact check needs."""

    def __init__(self, rows: list[Row]):
        self.ids = [r["item"] for r in rows]
        self.sentences = [[np.frombuffer(s["words"], np.uint64) for s in r["sentences"]] for r in rows]
        self.standard = [[s["standard"] for s in r["sentences"]] for r in rows]
        self.total = [sum(map(len, parts)) for parts in self.sentences]
        self.hashes = [[shingles(p) for p in parts] for parts in self.sentences]
        self.flat = [np.concatenate([np.zeros(0, np.uint64), *parts]) for parts in self.hashes]
        self.need, tables = [], defaultdict(list)
        for i, r in enumerate(rows):
            minima = sketch(np.array(r["telling"], np.int64).view(np.uint64))
            self.need.append(min(MIN_AGREEING, len(minima)))
            # blocks per window of the class: the smallest power of two whose window holds the passage
            tables[max(1, 1 << max(0, int(np.ceil(np.log2(max(1, len(r["telling"])) / BLOCK)))))].append((i, minima))
        self.need = np.array(self.need, np.int64)
        self.tables = {}
        for width, members in tables.items():
            keys, owner = np.concatenate([m for _, m in members]), np.repeat([i for i, _ in members], [len(m) for _, m in members])
            order = np.argsort(keys, kind="stable")
            self.tables[width] = keys[order], owner[order].astype(np.int64)
        self.marks = np.zeros(1 << _SLOT_BITS, bool)
        for keys, _ in self.tables.values():
            self.marks[_slots(keys)] = True

    def worth(self, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Documents with enough shingles that are some passage's minimum; the sketches of others can't agree with any."""
        hit = np.r_[0, np.cumsum(self.marks[_slots(_keys(h))])]
        return np.flatnonzero(hit[bounds[1:]] - hit[bounds[:-1]] >= (self.need.min() if len(self.need) else 1))

    def candidates(self, h: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        """Document and passage whose sketches agree in some window, in order; document d has the shingles ``h[bounds[d]:bounds[d + 1]]``."""
        sizes = np.diff(bounds)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        block = np.repeat(np.cumsum(blocks) - blocks, sizes) + (np.arange(len(h)) - np.repeat(bounds[:-1], sizes)) // BLOCK
        keys = _keys(h)
        current = np.full((len(owner), BINS), _NONE)
        np.minimum.at(current.reshape(-1), block * BINS + (keys >> np.uint64(32)).astype(np.int64), keys)
        out, width = [np.zeros(0, np.int64)], 1
        while True:
            if width in self.tables:
                pick = np.flatnonzero(nth % max(1, width // 2) == 0)
                windows, passages = self._agreeing(current[pick], *self.tables[width])
                out.append(owner[pick[windows]] * np.int64(len(self.ids)) + passages)
            if width >= max(self.tables, default=1):
                return [divmod(x, len(self.ids)) for x in np.unique(np.concatenate(out)).tolist()]
            # the window twice as wide: the minimum with its neighbour in the same document
            joined = np.flatnonzero(owner[width:] == owner[:-width]) if width < len(owner) else np.zeros(0, np.int64)
            current[joined] = np.minimum(current[joined], current[joined + width])
            width *= 2

    def _agreeing(self, windows: np.ndarray, keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and the passages that agree with them in enough minima."""
        flat = windows.reshape(-1)
        at = np.flatnonzero(self.marks[_slots(flat)] & (flat != _NONE))
        key = flat[at]
        lo = np.searchsorted(keys, key, "left")
        n = np.searchsorted(keys, key, "right") - lo
        entry = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        pairs, agreeing = np.unique(np.repeat(at // BINS, n) * np.int64(len(self.ids)) + owner[entry], return_counts=True)
        window, passage = np.divmod(pairs, max(1, len(self.ids)))
        enough = agreeing >= self.need[passage]
        return window[enough], passage[enough]

    def held(self, i: int, words: np.ndarray, sorted_h: np.ndarray, order: np.ndarray) -> tuple[float, int, float]:
        """Exact check of passage ``i``: share of its words in held sentences, number of its own among them, and its shingle containment.

        Held sentences that other families share count towards the words where two of its own are held, never to the number.
        """
        words_held = standard_held = sentences = 0
        every = self.flat[i]
        first = np.searchsorted(sorted_h, every, "left")
        containment = float((sorted_h[np.minimum(first, len(sorted_h) - 1)] == every).mean()) if len(every) and len(sorted_h) else 0.0
        if containment < MIN_CONTAINMENT:  # whatever aligns, this is no case
            return 0.0, 0, containment
        counts, at_shingle = np.searchsorted(sorted_h, every, "right") - first, 0
        for sentence, hashes, standard in zip(self.sentences[i], self.hashes[i], self.standard[i]):
            n = len(hashes)
            lo, count = first[at_shingle : at_shingle + n], counts[at_shingle : at_shingle + n]
            at_shingle += n
            found = int((count > 0).sum())
            if not found:
                continue
            which = np.repeat(np.arange(n), count)
            places = order[np.repeat(lo, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)] - which
            # the place that most of the sentence's shingles point to
            places = np.sort(places)
            slack = 4
            reach = np.searchsorted(places, places + slack, "right") - np.arange(len(places))
            at = int(places[int(np.argmax(reach))])
            if found == n and reach.max() >= n:
                ratio = 1.0
            else:
                there = words[max(0, at - slack) : at + len(sentence) + 2 * slack].tolist()
                match = sum(b.size for b in difflib.SequenceMatcher(None, sentence.tolist(), there, autojunk=False).get_matching_blocks())
                ratio = match / len(sentence)
            if ratio >= MIN_ALIGNED and standard:
                standard_held += len(sentence)
            elif ratio >= MIN_ALIGNED:
                words_held += len(sentence)
                sentences += 1
        if sentences >= 2:
            words_held += standard_held
        return words_held / max(1, self.total[i]), sentences, containment


def _keys(h: np.ndarray) -> np.ndarray:
    """Bin (above) and value (the lower 32 bits) of each shingle."""
    return h >> np.uint64(64 - BIN_BITS - 32)


def _slots(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def sketch(h: np.ndarray) -> np.ndarray:
    """The least key of each bin that has one, in order."""
    keys = np.sort(_keys(h))
    bins = keys >> np.uint64(32)
    return keys[np.r_[True, bins[1:] != bins[:-1]]] if len(keys) else keys


def _slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about SLICE_CHARS characters, of one document at least."""
    at, total = 0, np.cumsum(lengths)
    while at < len(lengths):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_CHARS, "right")))
        yield at, end
        at = end


def leaked_passages(
    documents: DataFrame,
    doc_key: str,
    text: str,
    items: DataFrame,
    item_key: str,
    passage: str,
    min_share: float = MIN_SHARE,
    items_per_pass: int = ITEMS_PER_PASS,
) -> DataFrame:
    """Documents that carry a passage: ``<doc_key>, <item_key>, share, n_sentences, containment``.

    Every document is cut into windows of 16, 32, 64, ... shingles of five words, overlapping by half; a passage is looked up
    among the windows of its own size class, where containment and similarity are close, by agreeing MinHash values. Shingles
    that unrelated passages share are left out of the sketches. Each candidate is checked on the whole document with exact
    shingles: a sentence counts as held when shingles point to one place and at least 80 % of its words align there, and the
    pair is reported when two or more sentences of its own are held, held ones make up ``min_share`` of the passage's words and the document contains a
    quarter of the passage's shingles.

    A passage without two sentences of five words (also null and empty) matches nothing, as does a null or short document.
    Sentences that unrelated passages share (standard openings) count only beside two held ones of the passage's own. Repeated
    documents each give their rows, repeated passages count once. ``items`` is the stated query set: what is known about its
    passages is worked out over all of them, so results don't depend on ``items_per_pass``, the number sent to one pass over
    the corpus. With more than one pass the documents' words are hashed once and written. Documents stay where they are;
    nothing about them is shuffled but the result.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(doc_key), F.col(text).cast("string").alias("text")).where(F.length("text") >= 2 * SHINGLE)
    name, kind = rows.columns[0], rows.schema[0].dataType.simpleString()
    item_name, item_kind = items.select(item_key).columns[0], items.select(item_key).schema[0].dataType.simpleString()
    schema = f"`{name}` {kind}, `{item_name}` {item_kind}, share double, n_sentences int, containment double"
    passages = described_passages(items, item_key, passage)
    several = passages.count() > items_per_pass

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(np.fromiter(map(len, texts), np.int64, len(texts))):
                yield (batch.column(0).slice(a, b - a), *word_hashes(texts[a:b]))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, words, bounds in hashed(batches):
            yield pa.record_batch([keys, pa.array([words[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], names=[name, "words"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = [np.frombuffer(w, np.uint64) for w in batch.column(1).slice(at, 256).to_pylist()]
                yield batch.column(0).slice(at, 256), np.concatenate(part), np.r_[0, np.cumsum([len(w) for w in part])]

    source: Callable = read if several else hashed
    if several:
        rows = materialize(rows.mapInArrow(written, f"`{name}` {kind}, words binary"), "words")

    def one_pass(block: list[Row]) -> DataFrame:
        sent = spark.sparkContext.broadcast(Passages(block))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = sent.value
            for keys, words, bounds in source(batches):
                h = shingles(words)
                starts, ends = np.minimum(bounds[:-1], len(h)), np.minimum(np.maximum(bounds[1:] - SHINGLE + 1, bounds[:-1]), len(h))
                # shingles across two documents are no shingles
                inside = np.zeros(len(h) + 1, np.int32)
                np.add.at(inside, starts, 1)
                np.add.at(inside, ends, -1)
                kept = h[np.cumsum(inside[:-1]) > 0]
                edges = np.r_[0, np.cumsum(ends - starts)]
                out, worth = [], p.worth(kept, edges)
                parts = [kept[edges[d] : edges[d + 1]] for d in worth.tolist()]
                last = -1
                for nth, i in p.candidates(np.concatenate(parts), np.r_[0, np.cumsum([len(x) for x in parts])]) if parts else []:
                    d = int(worth[nth])
                    if nth != last:
                        order, last = np.argsort(parts[nth], kind="stable"), nth
                        ranked = parts[nth][order]
                    share, n, containment = p.held(i, words[bounds[d] : bounds[d + 1]], ranked, order)
                    if n >= 2 and share >= min_share and containment >= MIN_CONTAINMENT:
                        out.append((d, i, share, n, containment))
                if out:
                    d, i, share, n, containment = zip(*out)
                    yield pa.record_batch(
                        [keys.take(pa.array(d)), pa.array([p.ids[x] for x in i], item_type), pa.array(share, pa.float64()), pa.array(n, pa.int32()), pa.array(containment, pa.float64())], names=[name, item_name, "share", "n_sentences", "containment"]
                    )

        return rows.mapInArrow(search, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(items.select(item_key).schema[0].dataType)
    result, block = None, []
    for row in passages.orderBy("uid").toLocalIterator() if several else passages.collect():  # at most items_per_pass rows at a time
        block.append(row)
        if len(block) == items_per_pass:
            part, block = one_pass(block), []
            result = part if result is None else result.unionByName(part)
    if block:
        part = one_pass(block)
        result = part if result is None else result.unionByName(part)
    return spark.createDataFrame([], schema) if result is None else result
