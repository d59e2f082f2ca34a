"""Product listings that describe the same item."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sidforge.llm.graph import connected_components
from sidforge.llm.tiles import directed_tiles
from sidforge.session import materialize

#: Factors to millilitres, millimetres and grams.
UNITS = {
    "ml": ("v", 1.0), "millilitre": ("v", 1.0), "milliliter": ("v", 1.0), "cl": ("v", 10.0), "l": ("v", 1000.0), "litre": ("v", 1000.0), "liter": ("v", 1000.0),
    "gal": ("v", 3785.41), "gallon": ("v", 3785.41), "fl oz": ("v", 29.5735), "fl ounce": ("v", 29.5735), "qt": ("v", 946.353), "quart": ("v", 946.353), "pint": ("v", 473.176),
    "mm": ("d", 1.0), "cm": ("d", 10.0), "m": ("d", 1000.0), "metre": ("d", 1000.0), "meter": ("d", 1000.0), "in": ("d", 25.4), "inch": ("d", 25.4), "inche": ("d", 25.4), '"': ("d", 25.4), "ft": ("d", 304.8),
    "g": ("w", 1.0), "gram": ("w", 1.0), "kg": ("w", 1000.0), "kilogram": ("w", 1000.0), "lb": ("w", 453.592), "pound": ("w", 453.592), "oz": ("w", 28.3495), "ounce": ("w", 28.3495),
}
#: Names that sellers use for one colour.
COLOURS = {
    "black": ("black", "jet black", "matte black"),
    "white": ("white", "pure white", "snow white"),
    "grey": ("grey", "gray", "slate grey", "slate gray"),
    "red": ("red", "bright red", "poppy red"),
    "pink": ("pink", "rose pink", "blush pink"),
    "purple": ("purple", "deep purple", "violet"),
    "navy": ("navy", "navy blue", "dark blue"),
    "blue": ("blue", "light blue", "sky blue"),
    "teal": ("teal", "dark teal", "blue-green", "blue green"),
    "green": ("green", "leaf green", "fern green"),
    "yellow": ("yellow", "sunny yellow", "lemon yellow"),
    "orange": ("orange", "bright orange"),
    "cream": ("cream", "ivory", "off-white", "off white"),
    "brown": ("brown", "chestnut", "chestnut brown"),
}
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "twelve": 12}
_PART = re.compile(r"\b(?:replacement|spare) (?:part|lid|cap|cover|piece|insert|set)s?\b|\b(?:replacement|spare part) for\b")
_CODE = re.compile(r"\b([a-z]{2,3}-\d{3,5})\b")
_N = "(" + "|".join(NUMBERS) + r"|\d{1,3})"
_PACK = re.compile(rf"\b(?:pack|set|box) of {_N}\b|\b{_N}[ -]?(?:pack|pcs|pieces|piece|pc|count)\b|(?<![\w.])x ?(\d{{1,3}})\b(?! ?(?:mm|cm|m|in)\b)")
_SIZE = re.compile(
    r"(?<![\w.-])(\d+(?:[.,]\d+)?) ?(fl\.? ?oz\b|fl\.? ?ounces?\b|millilit(?:re|er)s?\b|lit(?:re|er)s?\b|gallons?\b|kilograms?\b|grams?\b|inch(?:es)?\b|met(?:re|er)s?\b|pounds?\b|ounces?\b|quarts?\b|pints?\b|ml\b|cl\b|gal\b|mm\b|cm\b|kg\b|lbs?\b|oz\b|in\b|ft\b|qt\b|[lmg]\b|\")"
)
_COLOUR_OF = {name: colour for colour, names in COLOURS.items() for name in names}
_COLOUR = re.compile(r"\b(" + "|".join(sorted(map(re.escape, _COLOUR_OF), key=len, reverse=True)) + r")\b")
_WORD = re.compile(r"[^\W\d_]+(?:[-'][^\W\d_]+)*")
_VISIT = re.compile(r"^visit the (.+) store$")

DIM = 64
BUCKETS = 1 << 14
#: Hash slots in which the texts with a word are counted.
RARITY_SLOTS = 1 << 16
TRAINING_ROWS = 4_096
STEPS = 80
BATCH = 256
TEMPERATURE, RATE = 0.2, 0.03
#: Bounds of the rarity that weights a word, as logarithms of one in how many texts.
COMMON, RARE = 4.0, 7.0
#: Nearest neighbours of a listing, without a veto, that count.
NEIGHBOURS = 24
#: Stands for the similarity of a listing to the least id of those that agree with it, where these outnumber NEIGHBOURS.
HUB = 2.0
#: Difference of two log sizes that rounding in another unit explains.
SIZE_SLACK = 0.03
#: The rows whose exact nearest neighbours tune the number of probes, how many neighbours, and the share that must be found.
TUNING_ROWS = 512
EXACT = 16
TUNING_RECALL = 0.995
LIST_ROWS = 512
#: Nearest lists that an entry is a member of; as a query it looks into the probed ones, which are as many at least.
MEMBER_LISTS = 6
#: Lists at most (of a million entries and more); longer lists are searched in tiles.
MAX_LISTS = 4_096
#: Rows per list that its centroid is fitted to.
CENTROID_ROWS = 20
TILE_ROWS = 8_192
LANES = 32


def plain(text: str) -> str:
    """Lower-case text with compatibility characters, white space and quotes unified."""
    text = unicodedata.normalize("NFKC", text).casefold().replace("″", '"').replace("''", '"').replace("’", "'")
    return " ".join("".join(ch for ch in text if unicodedata.category(ch) != "Cf").split())


def size_of(text: str) -> tuple[str, float] | None:
    """Kind (volume, distance, weight) and amount in base units of the first measure in a plain text."""
    found = _SIZE.search(text)
    if not found:
        return None
    unit = found[2].replace(".", "")
    unit = re.sub(r"^fl ?", "fl ", unit) if unit.startswith("fl") else unit
    unit = unit if unit in UNITS else unit.rstrip("s")
    if unit not in UNITS:
        return None
    kind, factor = UNITS[unit]
    amount = float(found[1].replace(",", ".")) * factor
    return (kind, amount) if amount > 0 else None


def pack_of(text: str) -> int | None:
    """Number of pieces of the first pack phrase in a plain text."""
    found = _PACK.search(text)
    if not found:
        return None
    word = next(g for g in found.groups() if g)
    return NUMBERS.get(word) or int(word)


def colour_of(text: str) -> str | None:
    """Colour of the first colour name in a plain text; longer names count before their parts."""
    found = _COLOUR.search(text)
    return _COLOUR_OF[found[1]] if found else None


def facts_of(text: str, colour_too: bool = True) -> str:
    """``text`` without measures, packs, codes and colours."""
    for pattern in (_SIZE, _PACK, _CODE, *((_COLOUR,) if colour_too else ())):
        text = pattern.sub(" | ", text)
    return text


def statements(description: list[str | None] | None) -> list[str]:
    """Sentences of a description, case kept."""
    out = []
    for element in description if description is not None else []:
        if element:
            out += [s for s in re.split(r"(?<=[.!?])\s+(?=[A-Z(\"'])", " ".join(unicodedata.normalize("NFKC", element).split())) if s]
    return out


#: How descriptions state a colour; other colour words in them may be about something else.
_SAYS_COLOUR = re.compile(r"\b(?:colou?r:?|shade is|finished in|offered here in|comes in)\s+([\w -]+)", re.I)
#: How descriptions name the maker and the line.
_SAYS_NAME = [
    (re.compile(r"\bmade by (\S+), series (\S+?)\.?$", re.I), (1, 2)),
    (re.compile(r"\bfrom the (\S+) line by (\S+?)\.?$", re.I), (2, 1)),
    (re.compile(r"\bmodel family (\S+) \((\S+?)\)", re.I), (2, 1)),
    (re.compile(r"^(\S+) (\S+) series\.?$", re.I), (1, 2)),
]


class Words:
    """What the whole catalogue tells about words: makers, kinds of things, common words."""

    def __init__(self, brands: set[str], kinds: dict[str, int], common: set[str]):
        self.brands, self.kinds, self.common = brands, kinds, common
        self.longest = max((k.count(" ") + 1 for k in kinds), default=1)
        self.known = sorted({w for k in kinds for w in k.split() if len(w) > 3} | {w for w in common if len(w) > 4})
        self.misspelt: dict[str, bool] = {}

    def is_slip(self, word: str) -> bool:
        """Whether ``word`` is a slip of a kind's or a common word."""
        if word not in self.misspelt:
            if len(self.misspelt) > 100_000:
                self.misspelt.clear()
            self.misspelt[word] = any(abs(len(k) - len(word)) < 2 and slips_between(word, k, 1) for k in self.known)
        return self.misspelt[word]

    def kind_in(self, words: list[str]) -> tuple[int | None, tuple[int, int] | None]:
        """Kind of the longest kind phrase in ``words`` and where it stands; of equally long ones the last."""
        for n in range(self.longest, 0, -1):
            for i in range(len(words) - n, -1, -1):
                kind = self.kinds.get(" ".join(words[i : i + n]))
                if kind is not None:
                    return kind, (i, i + n)
        return None, None


def describe(title: str | None, store: str | None, description: list[str | None] | None, leaf: str | None, words: Words) -> dict | None:
    """What a listing says about its product; None when nothing tells which one it is."""
    said = statements(description)
    head = plain(title or "")
    if not head and not said:
        return None
    body = [plain(s) for s in said]
    whole_title = head or (body[0] if body else "")
    size = size_of(head) or next(filter(None, map(size_of, body)), None)
    pack = pack_of(head) or next(filter(None, map(pack_of, body)), None) or 1
    colour = colour_of(head) or next((c for s in body for m in [_SAYS_COLOUR.search(s)] if m for c in [colour_of(m[1])] if c), None)
    code = next((m[1] for s in (head, *body) for m in [_CODE.search(s)] if m), None)
    part = bool(_PART.search(head) or any(_PART.search(s) for s in body))
    brand = series = None
    for s in said:
        for pattern, (b, r) in _SAYS_NAME:
            m = pattern.search(s)
            if m:
                brand, series = plain(m[b]).strip(".,"), plain(m[r]).strip(".,")
                break
        if series:
            break
    title_words = _WORD.findall(facts_of(whole_title))
    kind, where = words.kind_in(title_words)
    if where:
        title_words = title_words[: where[0]] + ["|"] + title_words[where[1] :]
    if kind is None and leaf:
        kind = words.kinds.get(plain(leaf))
    if kind is None:
        kind = next((k for s in body for k in [words.kind_in(_WORD.findall(s))[0]] if k is not None), None)
    names = [w for w in title_words if w != "|" and w not in words.common]
    in_title = next((w for w in names if w in words.brands), None)
    shop = plain(store or "")
    visit = _VISIT.match(shop)
    shop = visit[1] if visit else shop.removesuffix(" official")
    brand = in_title or brand or (shop if shop in words.brands else None)
    rest = [w for w in names if w != brand and w not in words.brands and len(w) > 2]
    if series is None and rest:
        series = rest[0] if len(rest) == 1 else max([w for w in rest if not words.is_slip(w)] or rest, key=len)
    if series is None and code is None:
        return None
    series = (series or "").replace("-", "").replace("'", "")
    return {"brand": brand or "", "series": series, "kind": -1 if kind is None else kind, "code": code or "", "part": part, "size_kind": size[0] if size else "", "size": float(np.log(size[1])) if size else 0.0, "colour": colour or "", "pack": int(pack)}


# ---------------------------------------------------------------------------------------------------------------------
# the title encoder


@functools.lru_cache(maxsize=1 << 17)
def subwords(word: str) -> tuple[int, ...]:
    """Hashed character two- and three-grams of ``word``; a slip leaves most of them."""
    import xxhash

    padded = f"<{word}>"
    grams = [padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1)]
    return tuple(xxhash.xxh32_intdigest(g) % BUCKETS for g in grams)


@functools.lru_cache(maxsize=1 << 17)
def word_slot(word: str) -> int:
    """Place of ``word`` among the RARITY_SLOTS counts of texts by hashed word."""
    import xxhash

    return xxhash.xxh32_intdigest(word, seed=5) % RARITY_SLOTS


def slip(word: str, rng: np.random.Generator) -> str:
    """``word`` with one slip of the keyboard; short ones stay as they are."""
    if len(word) < 4:
        return word
    at = int(rng.integers(1, len(word) - 1))
    return [word[:at] + word[at + 1 :], word[:at] + word[at] + word[at:], word[:at] + word[at + 1] + word[at] + word[at + 2 :], word[:at] + chr(97 + int(rng.integers(26))) + word[at + 1 :]][int(rng.integers(4))]


def view(words: list[str], rng: np.random.Generator) -> list[str]:
    """Another wording of a listing: some words left out, now and then a slip."""
    kept = [w for w in words if rng.random() > 0.3] or words
    return [slip(w, rng) if rng.random() < 0.3 else w for w in kept]


class Encoder:
    """Unit vectors of texts: the sum of their words' vectors, each the mean of its subwords' vectors, weighted by how rare the word is.

    A word that more than one of some 55 texts has hardly counts (COMMON, in natural logarithms), and beyond RARE rarity adds
    nothing: a word seen once is as likely a slip as a name. Trained so that two wordings of one listing are closer than
    those of others.
    """

    def __init__(self, texts_with: np.ndarray, texts: int, seed: int = 17):
        self.table = np.random.default_rng(seed).normal(0, 1 / np.sqrt(DIM), (BUCKETS, DIM)).astype(np.float32)
        rarity = np.minimum(np.log((texts + 1) / (texts_with + 0.5)), RARE) - COMMON
        self.rarity = np.square(np.maximum(rarity, 0.02)).astype(np.float32)
        self.known: dict[str, np.ndarray] = {}

    def word(self, word: str) -> np.ndarray:
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = self.table[list(subwords(word))].mean(axis=0) * self.rarity[word_slot(word)]
        return self.known[word]

    def __call__(self, texts: list[list[str]]) -> np.ndarray:
        if not texts:
            return np.zeros((0, DIM), np.float32)
        words = [w for t in texts for w in (t or [""])]
        starts = np.r_[0, np.cumsum([max(1, len(t)) for t in texts])[:-1]]
        sums = np.add.reduceat(np.stack([self.word(w) for w in words]), starts, axis=0)
        return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)

    def train(self, texts: list[list[str]], steps: int = STEPS, batch: int = BATCH, temperature: float = TEMPERATURE, rate: float = RATE) -> Encoder:
        """Contrastive training: two wordings of a listing belong together, the other listings of a batch are the negatives."""
        rng = np.random.default_rng(23)
        for _ in range(min(steps, len(texts) // 8)):
            chosen = [texts[i] for i in rng.choice(len(texts), min(batch, len(texts)), replace=False)]
            n = len(chosen)
            views = [*(view(t, rng) or [""] for t in chosen), *(view(t, rng) or [""] for t in chosen)]
            words = sorted({w for t in views for w in t})
            place = {w: i for i, w in enumerate(words)}
            of_text = np.array([place[w] for t in views for w in t])
            owner = np.repeat(np.arange(2 * n), [len(t) for t in views])
            grams = [subwords(w) for w in words]
            flat, sizes = np.concatenate([np.asarray(g) for g in grams]), np.array([len(g) for g in grams])
            weight = self.rarity[[word_slot(w) for w in words]][:, None]
            vectors = np.add.reduceat(self.table[flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None] * weight
            sums = np.add.reduceat(vectors[of_text], np.flatnonzero(np.r_[True, np.diff(owner) > 0]), axis=0)
            norm = np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
            v = sums / norm
            logits = v[:n] @ v[n:].T / temperature
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), np.arange(n)] -= 1
            g = np.vstack([p @ v[n:], p.T @ v[:n]]) / temperature
            g = (g - v * (g * v).sum(axis=1, keepdims=True)) / norm
            order = np.argsort(of_text, kind="stable")
            by_word = np.add.reduceat(g[owner[order]], np.flatnonzero(np.r_[True, np.diff(of_text[order]) > 0]), axis=0) * weight / sizes[:, None]
            # every subword moves by at most the rate, against its gradient
            order = np.argsort(flat, kind="stable")
            moved, starts = np.unique(flat[order], return_index=True)
            total = np.add.reduceat(np.repeat(by_word, sizes, axis=0)[order], starts, axis=0)
            length = np.linalg.norm(total, axis=1, keepdims=True)
            self.table[moved] -= rate * total / np.maximum(length, max(float(np.median(length)), 1e-9))
        self.known.clear()
        return self


def slips_between(a: str, b: str, most: int = 2) -> bool:
    """Whether ``a`` becomes ``b`` by at most ``most`` insertions, deletions, replacements or swaps of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return False
        before, last = last, row
    return last[-1] <= most


def same_line(a: str, b: str) -> bool:
    """Whether two line names are spellings of one: one slip, or two in names of seven letters or more."""
    shorter = min(len(a), len(b))
    return a == b or (shorter >= 4 and slips_between(a, b, 2 if shorter >= 7 else 1))


# ---------------------------------------------------------------------------------------------------------------------
# the operator


def learn_words(rows: DataFrame) -> Words:
    """Makers, kinds and common words from counts over the whole catalogue.

    A maker is a shop name of one word that occurs twice and in one of a million listings. A kind is a last category that occurs at least twice and in one of
    2,000 listings; kinds that listings use side by side in at least a tenth of the rarer one's listings mean the same. A
    word is common when descriptions twice use it in lower case, or when it is in one of 250 titles (in small catalogues: in
    30, or one of 50), with more than half as many kinds as it could be, and descriptions don't state it as the name of a line. What comes to the driver is vocabulary, whose size these shares bound, not rows.
    """
    n = rows.count()

    def tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts: dict[tuple[str, str, str], int] = defaultdict(int)
            for title, store, description, leaf in zip(frame["title"], frame["store"], frame["description"], frame["leaf"]):
                shop = plain(store or "")
                visit = _VISIT.match(shop)
                shop = visit[1] if visit else shop.removesuffix(" official")
                if shop and " " not in shop:
                    counts["brand", shop, ""] += 1
                kind = plain(leaf or "")
                if kind:
                    counts["kind", kind, ""] += 1
                for w in set(_WORD.findall(plain(title or ""))):
                    counts["title", w, kind] += 1
                said = statements(description)
                for w in {w for s in said for w in _WORD.findall(s) if w.islower()}:
                    counts["lower", w, ""] += 1
                for w in {plain(m[r]).strip(".,") for s in said for pattern, (_, r) in _SAYS_NAME for m in [pattern.search(s)] if m}:
                    counts["line", w, ""] += 1
            yield pd.DataFrame([(*k, c) for k, c in counts.items()], columns=["what", "word", "kind", "n"])

    often = max(2, 0.004 * n, min(30, 0.02 * n))
    least = {"brand": max(2, 0.000001 * n), "kind": max(2, 0.0005 * n), "title": often, "lower": max(2, 0.00001 * n)}
    counted = rows.mapInPandas(tokens, "what string, word string, kind string, n bigint").groupBy("what", "word", "kind").agg(F.sum("n").alias("n"))
    of = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0))
    kinds_of_word = F.count(F.when((F.col("what") == "title") & (F.col("kind") != ""), 1))
    words = counted.groupBy("word").agg(*(of(k).alias(k) for k in (*least, "line")), kinds_of_word.alias("kinds"))
    by: dict[str, set[str]] = defaultdict(set)
    often_in_titles = []
    for r in words.where(" or ".join(f"`{k}` >= {v}" for k, v in least.items())).collect():
        for k in ("brand", "kind", "lower"):
            if r[k] >= least[k]:
                by[k].add(r["word"])
        if r["title"] >= often and r["line"] * 20 < r["title"]:
            often_in_titles.append(r)
    # talk is used with all kinds of things, the name of a line, however often listed, with few
    by["title"] = {r["word"] for r in often_in_titles if r["kinds"] > 0.5 * min(r["title"], max(1, len(by["kind"])))}
    names = sorted(by["kind"])
    first = Words(by["brand"], {k: i for i, k in enumerate(names)}, set())

    def together(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts: dict[tuple[int, int], int] = defaultdict(int)
            for title, description, leaf in zip(frame["title"], frame["description"], frame["leaf"]):
                phrases = {first.kind_in(_WORD.findall(plain(s)))[0] for s in [title or "", *statements(description)]} | {first.kinds.get(plain(leaf or ""))}
                phrases = sorted(p for p in phrases if p is not None)
                for i, a in enumerate(phrases):
                    for b in phrases[i:]:
                        counts[a, b] += 1
            yield pd.DataFrame([(a, b, c) for (a, b), c in counts.items()], columns=["a", "b", "n"])

    pairs = {(r["a"], r["b"]): r["n"] for r in rows.mapInPandas(together, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}
    parent = list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), c in sorted(pairs.items()):
        if a != b and c >= 2 and c >= 0.1 * min(pairs[a, a], pairs[b, b]):
            parent[root(a)] = root(b)
    return Words(by["brand"], {k: root(i) for i, k in enumerate(names)}, (by["title"] - by["brand"]) | by["lower"] | {w for k in names for w in k.split()})


_FIELDS = "brand string, series string, kind int, code string, part boolean, size_kind string, size double, colour string, pack int"


def product_groups(df: DataFrame, key: str, line_no: str, title: str, store: str, description: str, categories: str, k: int = NEIGHBOURS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Listings grouped by product: ``id, product``, the product being the smallest id of its group.

    Of several lines of an id the one with the highest ``line_no`` counts; null ids are dropped (trim them before). Every
    distinct listing text (title, store, description) is encoded by a contrastively trained subword encoder and kept in an
    inverted file; the number of probed lists is raised until the exact neighbours of a sample are found. A neighbour is
    vetoed when the two listings differ in what they say of size (3 %, converted to base units), pack count, colour, model
    code, being a part for the thing, kind of thing, maker, or when their line names are more than slips apart. Listings that
    are among each other's ``k`` nearest without a veto are linked, and linked listings are one product. Where more than ``k`` listings
    of a list agree with one, it is also linked to the least id of them, so a product with any number of listings stays whole.

    Lines that tell no line and no code (also those with nothing but the id) are no product and get no row. Listings of equal
    text are one entry of the index. Equal inputs give equal groups; ties are settled by id. An empty table gives an empty
    result. Extra columns are ignored.
    """
    spark = df.sparkSession
    leaf = F.when(F.size(categories) >= 2, F.element_at(categories, -1)).alias("leaf")
    rows = df.select(F.col(key).alias("id"), F.col(line_no).alias("line_no"), F.col(title).alias("title"), F.col(store).alias("store"), F.col(description).alias("description"), leaf)
    latest = rows.where("id is not null").groupBy("id").agg(F.max_by(F.struct("title", "store", "description", "leaf"), "line_no").alias("r")).select("id", "r.*")
    latest = materialize(latest, "listings")
    words = spark.sparkContext.broadcast(learn_words(latest))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = words.value
        for frame in frames:
            out = []
            for i, t, s, d, c in zip(frame["id"], frame["title"], frame["store"], frame["description"], frame["leaf"]):
                facts = describe(t, s, d, c, w)
                if facts:
                    said = " ".join([t or "", s or "", *(x for x in (d if d is not None else []) if x)])
                    out.append({"id": i, "text": " ".join(_WORD.findall(plain(said))), **facts})
            yield pd.DataFrame(out, columns=["id", "text", *(x.split()[0] for x in _FIELDS.split(", "))])

    told = materialize(latest.mapInPandas(read, f"id string, text string, {_FIELDS}"), "told")
    signature = ["text", "brand", "series", "kind", "code", "part", "size_kind", "size", "colour", "pack"]
    entries = materialize(told.groupBy(*signature).agg(F.min("id").alias("id")), "entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], "id string, product string")
    links = mutual_neighbours(entries, n, k, tile_rows)
    components = connected_components(links)
    named = entries.join(components.withColumnRenamed("node", "id"), "id", "left").select(*signature, F.coalesce("component", "id").alias("product"))
    # the entry's smallest id stands for it, so a product's name is the smallest id of all its listings
    return told.join(named, signature).select("id", "product")


def texts_by_word(texts: DataFrame) -> np.ndarray:
    """Number of texts with a word of each hash slot, over all rows of ``texts(text)``: arrays per split, summed in lanes and here."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(RARITY_SLOTS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total[list({word_slot(w) for w in text.split()})] += 1
        yield pa.record_batch([pa.array([TaskContext.get().partitionId() % LANES], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["lane", "total"])

    def lane(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(b, np.int64) for b in group.column("total").to_pylist()], axis=0)
        return pa.table([group.column("lane").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["lane", "total"])

    rows = texts.select("text").mapInArrow(split, "lane int, total binary").groupBy("lane").applyInArrow(lane, "lane int, total binary").collect()  # at most LANES rows
    return np.sum([np.frombuffer(r["total"], np.int64) for r in rows], axis=0) if rows else np.zeros(RARITY_SLOTS, np.int64)


def _centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(own, kind="stable")
        filled, starts = np.unique(own[order], return_index=True)
        c[filled] = np.add.reduceat(x[order], starts, axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def _nearest(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` greatest values of each row, greatest first."""
    k = min(k, s.shape[1])
    near = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.broadcast_to(np.arange(k), s.shape)
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)


def _packed(v: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in v.astype(np.float16)]


def _unpacked(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float16).reshape(-1, DIM).astype(np.float32)


def agreeing(g: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows i, j no veto parts."""
    ok = (g["facts"][i] == g["facts"][j]) & (np.abs(g["size"][i] - g["size"][j]) <= SIZE_SLACK)
    ok &= (g["kind"][i] == g["kind"][j]) | (g["kind"][i] < 0) | (g["kind"][j] < 0)
    for name in ("brand", "code"):
        ok &= (g[name][i] == g[name][j]) | (g[name][i] == "") | (g[name][j] == "")
    one, two = g["series"][i], g["series"][j]
    both = (one != "") & (two != "")
    same = np.where(both, one == two, (g["code"][i] == g["code"][j]) & (g["code"][i] != ""))
    for at in np.flatnonzero(ok & both & ~same).tolist():
        same[at] = same_line(one[at], two[at])
    return ok & same


def mutual_neighbours(entries: DataFrame, n: int, k: int, tile_rows: int) -> DataFrame:
    """``a, b``: entries that are among each other's ``k`` nearest that no veto parts."""
    spark = entries.sparkSession
    texts = sorted({r[0] for r in hashed_rows(entries.select("text"), n, TRAINING_ROWS).collect()})  # about TRAINING_ROWS rows
    encoder = spark.sparkContext.broadcast(Encoder(texts_by_word(entries), n).train([t.split() for t in texts]))

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.drop(columns="text").assign(vec=_packed(encoder.value([t.split() for t in frame["text"]])))

    facts = F.xxhash64("part", "pack", "colour", "size_kind").alias("facts")
    fields = "id string, brand string, series string, kind int, code string, size double, facts bigint, vec binary"
    coded = entries.select("id", "text", "brand", "series", "kind", "code", "size", facts)
    coded = materialize(coded.mapInPandas(encode, fields), "coded")
    lists = int(max(1, min(MAX_LISTS, n / LIST_ROWS)))
    sample = sorted(r[0] for r in hashed_rows(coded.select("vec"), n, CENTROID_ROWS * lists).collect())  # about CENTROID_ROWS rows a list
    centroids = _centroids(_unpacked(sample), min(lists, len(sample)))
    sent = spark.sparkContext.broadcast(centroids)
    probes = tuned_probes(coded, centroids, n)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        for frame in frames:
            s = _unpacked(frame["vec"]) @ c.T
            yield frame.assign(probed=list(_nearest(s, max(probes, MEMBER_LISTS)).astype(np.int32)))

    posted = coded.mapInPandas(assign, f"{fields}, probed array<int>").select("*", F.posexplode("probed").alias("nth", "list")).drop("probed")
    # an entry is a member of its first lists and a query in those it probes; long lists are cut into tiles of members
    posted = posted.withColumn("member", F.col("nth") < MEMBER_LISTS).withColumn("query", F.col("nth") < probes)
    lengths = {r[0]: r[1] for r in posted.where("member").groupBy("list").count().collect()}  # one row per list
    long = {key: -(-v // tile_rows) for key, v in lengths.items() if v > tile_rows}
    posted = directed_tiles(posted.drop("nth"), "list", long, "member", "id")

    def search(group: pa.Table) -> pa.Table:
        strings = ("id", "brand", "series", "code")
        g = {c: np.array(group.column(c).to_pylist(), dtype=object if c in strings else None) for c in group.column_names if c != "vec"}
        x = _unpacked(group.column("vec").to_pylist())
        from_side, to_side = divmod(int(g["tile"][0]), 65536)
        queries, members = np.flatnonzero(g["query"] & (g["side"] == from_side)), np.flatnonzero(g["member"] & (g["side"] == to_side))
        members = members[np.argsort(g["facts"][members], kind="stable")]
        of = g["facts"][members]
        a, b, sims = [], [], []
        # only members whose plain facts are the query's are compared: runs of the sorted members
        lo, hi = np.searchsorted(of, g["facts"][queries], "left"), np.searchsorted(of, g["facts"][queries], "right")
        size = hi - lo
        for at in range(0, len(queries), 4096):
            m = size[at : at + 4096]
            i = np.repeat(queries[at : at + 4096], m)
            j = members[np.repeat(lo[at : at + 4096], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)]
            i, j = i[i != j], j[i != j]
            ok = agreeing(g, i, j)
            i, j = i[ok], j[ok]
            a.append(g["id"][i])
            b.append(g["id"][j])
            sims.append(np.einsum("ij,ij->i", x[i], x[j]))
            # agreement goes both ways; where it outnumbers the neighbours that count, the least id holds the group together
            starts = np.flatnonzero(np.r_[True, np.diff(i) != 0]) if len(i) else np.zeros(0, np.int64)
            for start, end in zip(starts.tolist(), np.r_[starts[1:], len(i)].tolist()):
                if end - start > k:
                    a.append(g["id"][i[start : start + 1]])
                    b.append(np.array([min(g["id"][j[start:end]])], dtype=object))
                    sims.append(np.array([HUB], np.float32))
        flat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        return pa.table([pa.array(flat(a, object), pa.string()), pa.array(flat(b, object), pa.string()), pa.array(flat(sims, np.float32), pa.float32())], names=["a", "b", "s"])

    found = posted.groupBy("list", "tile").applyInArrow(search, "a string, b string, s float")
    # a pair that shares several lists is found in each
    nearest = F.slice(F.array_sort(F.array_distinct(F.collect_list(F.struct((-F.round("s", 5)).alias("minus"), "b")))), 1, k)
    directed = found.groupBy("a").agg(nearest.alias("e")).select("a", F.explode("e").alias("e")).select("a", F.col("e.b").alias("b"), (F.col("e.minus") <= -HUB).alias("hub"))
    directed = directed.groupBy("a", "b").agg(F.max("hub").alias("hub"))
    both = directed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "hub").groupBy("a", "b").agg(F.count("*").alias("n"), F.max("hub").alias("hub"))
    return both.where("n = 2 or hub").select("a", "b")


def hashed_rows(rows: DataFrame, n: int, want: int) -> DataFrame:
    """About ``want`` of ``n`` rows, by the hash of their first column; filtered where they are."""
    return rows if n <= want else rows.where(F.xxhash64(rows.columns[0]) < F.lit(int(want / n * 2**64) - 2**63))


def tuned_probes(coded: DataFrame, centroids: np.ndarray, n: int) -> int:
    """The least number of probed lists with which the exact nearest neighbours of a sample are found."""
    sample = [r[0] for r in hashed_rows(coded.select("vec"), n, TUNING_ROWS).collect()]
    queries = _unpacked(sample) if sample else np.zeros((0, DIM), np.float32)
    rank = np.argsort(np.argsort(-(queries @ centroids.T), axis=1, kind="stable"), axis=1)

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = _unpacked(frame["vec"])
            s = queries @ x.T
            take = min(EXACT + 1, len(x))
            near = np.argpartition(-s, take - 1, axis=1)[:, :take]
            own = _nearest(x @ centroids.T, MEMBER_LISTS)
            q = np.repeat(np.arange(len(queries)), take)
            near = near.ravel()
            yield pd.DataFrame({"q": q, "s": s[q, near], "place": rank[q[:, None], own[near]].min(axis=1)})

    order = W.partitionBy("q").orderBy(F.desc("s"), "place")
    best = coded.select("vec").mapInPandas(exact, "q int, s float, place int").withColumn("nth", F.row_number().over(order)).where(F.col("nth").between(2, EXACT + 1))  # the first is the query itself
    counts = {r[0]: r[1] for r in best.groupBy("place").count().collect()}  # one row per list
    total, probes = sum(counts.values()), 1
    while probes < len(centroids) and sum(v for place, v in counts.items() if place < probes) < TUNING_RECALL * total:
        probes += 1
    return min(max(probes, MEMBER_LISTS), len(centroids))
