"""Evaluation passages leaking into training texts.

The n-grams of normalised words that hold one of an item's own facts form a hash set with all the items that own each of them, so that items which share a passage, hold one
another or continue one another are all found. Each training text is read once, whole: windows of
words that hit the set nominate (text, item) pairs, and each pair is verified by aligning the item's
words with the words around the hits. A leak is one stretch that carries enough of the item's words,
mostly in order, and enough of the facts in it; shared wording and the same kind of question about
other facts fail on the last two. Whether a word is a fact follows from the item alone, so results
don't depend on how many items there are.

The set is broadcast below ``MAX_WORDS`` words of test material; beyond that the same n-grams meet
in a shuffled join and the same verification follows.

Defined results
  null or empty text, null item             → no leak
  items with the same words                 → all of them leak where one does
  an item within another one                → leaks with it
  items shorter than ``n`` words            → compared as one whole n-gram of their length
  items without a fact                      → all their n-grams count, and nearly all words must match
  very long texts                           → read whole, in tiles of three times an item's length
  repeated rows                             → one result each; callers make them distinct
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.strings import edits, is_slip
from tidemark.session import cut

#: Words in an n-gram of the hash set.
N = 3
#: Share of the item's words that one stretch must carry, and the share of them that must match.
PART, MATCHING = 0.36, 0.55
#: More than this share of the item's own facts within the stretch must match; of all words, this share at least where it has none.
FACTS, FACTLESS = 0.5, 0.9
#: Words that may stand between two matches of one stretch.
GAP = 8
#: Test words are broadcast only up to this many.
MAX_WORDS = 20_000_000
#: Letters from which a name may have a slip of typing.
TYPED = 5
_WORD = re.compile(r"[\w\u0300-\u036f]+")
_OPENS = re.compile(r"(?:^|[.!?:;\n•])[\s\"'“‘(\[*_-]*$")


def _plain(word: str) -> str:
    word = word.lower()
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower()) if text.isascii() else [_plain(w) for w in _WORD.findall(text)]


FIGURE, NAME = 1, 2


#: A word is rare in this share of the items at most, and in two of them whatever their number.
RARE_SHARE, RARE_ITEMS = 0.01, 2


def facts_of(text: str, rare: frozenset[str] = frozenset()) -> list[int]:
    """For each word 0, or FIGURE, or NAME where it is rare or capitalised elsewhere than at the start of a sentence."""

    def kind(m: re.Match) -> int:
        if any(c.isdigit() for c in m[0]):
            return FIGURE
        return NAME if _plain(m[0]) in rare or (m[0][0].isupper() and not _OPENS.search(text[max(0, m.start() - 8) : m.start()])) else 0

    return [kind(m) for m in _WORD.finditer(text)]


def gram_hash(words: tuple[str, ...] | list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words)) - 2**63


class Item:
    """The words of one test item, which of them are facts, and the n-grams that nominate it."""

    def __init__(self, text: str, rare: frozenset[str], n: int = N):
        self.words, self.facts = words_of(text), facts_of(text, rare)
        size = min(n, len(self.words))
        places = range(len(self.words) - size + 1) if size else ()
        own = [k for k in places if any(self.facts[k : k + size])] or list(places)
        self.size = size
        self.grams = {gram_hash(self.words[k : k + size]) for k in own}
        # any stretch that may count holds at least so many facts
        part = max(1, int(PART * len(self.words)))
        sums = np.cumsum([0, *map(bool, self.facts)])
        fewest = min((int(sums[k + part] - sums[k]) for k in range(len(self.words) - part + 1)), default=0)
        self.least_facts = int(FACTS * fewest) + 1 if fewest else 0
        self.fact_counts = Counter(w for w, f in zip(self.words, self.facts) if f)
        self.counts = Counter(self.words)

    def may_be(self, tile: list[str]) -> bool:
        """Whether a tile has as many of the item's facts and words as any leak must have."""
        met = Counter(filter(self.counts.__contains__, tile))
        if sum(min(n, met[w]) for w, n in self.fact_counts.items()) < self.least_facts:
            return False
        return sum(min(n, self.counts[w]) for w, n in met.items()) >= PART * MATCHING * len(self.words)

    def stretch(self, tile: list[str]) -> tuple[int, int] | None:
        """The first and last word of the tile's stretch that carries the item, if one does."""
        blocks = [b for b in SequenceMatcher(None, self.words, tile, autojunk=False).get_matching_blocks() if b.size]
        chain: list = []
        for b in [*blocks, None]:
            if b is not None and (not chain or (b.a - chain[-1].a - chain[-1].size <= GAP and b.b - chain[-1].b - chain[-1].size <= GAP)):
                chain.append(b)
                continue
            if chain and (found := self._carried(chain, tile)):
                return found
            chain = [b] if b is not None else []
        return None

    def _carried(self, chain: list, tile: list[str]) -> tuple[int, int] | None:
        # loose single words at either end don't make the stretch longer
        while len(chain) > 1 and chain[0].size < 2:
            chain = chain[1:]
        while len(chain) > 1 and chain[-1].size < 2:
            chain = chain[:-1]
        first, last = chain[0].a, chain[-1].a + chain[-1].size
        matched = sum(b.size for b in chain)
        if last - first < PART * len(self.words) or matched < MATCHING * (last - first):
            return None
        met = {k for b in chain for k in range(b.a, b.a + b.size)}
        told = [k for k in range(first, last) if self.facts[k]]
        names = [k for k in told if self.facts[k] == NAME]
        around = set(tile[chain[0].b : chain[-1].b + chain[-1].size])
        met |= {k for k in names if k not in met and len(self.words[k]) >= TYPED and any(edits(self.words[k], w, 1) == 1 and is_slip(self.words[k], w) for w in around)}
        enough = sum(k in met for k in told) > FACTS * len(told) if told else matched >= FACTLESS * (last - first)
        # figures may agree by chance, names don't
        enough = enough and sum(k in met for k in names) >= FACTS * len(names)
        return (chain[0].b, chain[-1].b + chain[-1].size) if enough else None

    def in_words(self, words: list[str], hits: Iterable[int]) -> tuple[int, int] | None:
        """The stretch of words around any of the hits that carries the item.

        Tiles are three items long and start one item apart, so each stretch lies within one of them
        and the time grows with the text only, however often it hits.
        """
        step = max(len(self.words), 1)
        for at in sorted({max(h // step + d, 0) for h in hits for d in (-1, 0)}):
            low = max(at * step - step // 2, 0)
            tile = words[low : low + 3 * step]
            if self.may_be(tile) and (found := self.stretch(tile)):
                return low + found[0], low + found[1]
        return None


class LeakFinder:
    """The hash set of all items' n-grams as one sorted array, with the owners of each."""

    def __init__(self, items: Iterable[tuple[int, str]], n: int = N):
        by_words: dict[tuple[str, ...], list[int]] = defaultdict(list)
        texts: dict[tuple[str, ...], str] = {}
        for item_id, text in items:
            if item_id is not None and text and (words := tuple(words_of(text))):
                by_words[words].append(item_id)
                texts.setdefault(words, text)
        self.ids = [sorted(ids) for ids in by_words.values()]
        common = Counter(w for words in by_words for w in set(words))
        rare = frozenset(w for w, k in common.items() if k <= max(RARE_ITEMS, RARE_SHARE * len(by_words)))
        self.items = [Item(texts[words], rare, n) for words in by_words]
        pairs = sorted((g, k) for k, item in enumerate(self.items) for g in item.grams)
        grams = np.array([g for g, _ in pairs], dtype=np.int64)
        self.owners = np.array([k for _, k in pairs], dtype=np.int64)
        self.grams, self.starts = np.unique(grams, return_index=True)
        self.ends = np.append(self.starts[1:], len(pairs))
        self.sizes = sorted({item.size for item in self.items})
        self.vocabulary = frozenset(w for item in self.items for w in item.counts)

    def nominate(self, words: list[str]) -> dict[int, list[int]]:
        """Index of each nominated item → where its n-grams stand."""
        hits: dict[int, list[int]] = defaultdict(list)
        known = np.fromiter((w in self.vocabulary for w in words), dtype=bool, count=len(words))
        for size in self.sizes:
            if len(words) < size:
                continue
            whole = known[: len(words) - size + 1].copy()
            for j in range(1, size):
                whole &= known[j : len(words) - size + 1 + j]
            places = np.flatnonzero(whole)
            if not len(places):
                continue
            hashes = np.array([gram_hash(words[k : k + size]) for k in places.tolist()], dtype=np.int64)
            at = np.minimum(np.searchsorted(self.grams, hashes), len(self.grams) - 1)
            for k, g in zip(places[self.grams[at] == hashes].tolist(), at[self.grams[at] == hashes].tolist()):
                for owner in self.owners[self.starts[g] : self.ends[g]].tolist():
                    if self.items[owner].size == size:
                        hits[owner].append(k)
        return hits

    def stretches(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(item id, first word, last word + 1) of every leak."""
        found = []
        for k, hits in self.nominate(words).items():
            if (at := self.items[k].in_words(words, hits)) is not None:
                found += [(i, *at) for i in self.ids[k]]
        return sorted(found)

    def find(self, text: str | None) -> list[int]:
        return [i for i, _, _ in self.stretches(words_of(text))] if text else []

    def without(self, text: str | None) -> str | None:
        """The text without the stretches that carry an item, searched again until none is left."""
        while text and (found := self.stretches(words_of(text))):
            places = [m.span() for m in _WORD.finditer(text)]
            keep, at = [], 0
            for low, high in sorted((low, high) for _, low, high in found):
                keep.append(text[at : max(at, places[low][0])])
                at = max(at, places[high - 1][1])
            text = "".join(keep) + text[at:]
        return text


def test_items(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, item_text: the distinct test items."""
    return items.select(F.col(f"`{item_id}`").cast("bigint").alias("item_id"), F.col(f"`{text}`").cast("string").alias("item_text")).where("item_id IS NOT NULL AND item_text IS NOT NULL").distinct()


def broadcast_finder(spark: SparkSession, items: DataFrame, most: int = MAX_WORDS):
    """The broadcast hash set, or None where the test material has more words than may be broadcast."""
    size = items.agg(F.sum(F.size(F.split("item_text", r"\W+")))).first()[0] or 0
    return None if size > most else spark.sparkContext.broadcast(LeakFinder([(r.item_id, r.item_text) for r in items.collect()]))


def _rows(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """doc_id, item_id: one row per document row and leaked item. items: as test_items() gives them."""
    rows = _rows(documents, doc_id, text)
    shared = broadcast_finder(documents.sparkSession, items, most)
    if shared is None:
        return _leaks_by_join(rows, items)

    @F.pandas_udf("array<bigint>")
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(shared.value.find)

    return rows.select("doc_id", F.explode(scan("text")).alias("item_id"))


def _leaks_by_join(rows: DataFrame, items: DataFrame) -> DataFrame:
    """As leaks(), with the n-grams in a shuffled join; each pair that shares one is verified on its own."""

    @F.pandas_udf("array<string>")
    def distinct_words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(set(words_of(t))))

    @F.pandas_udf("array<bigint>")
    def owned(texts: pd.Series, rare: pd.Series) -> pd.Series:
        return pd.Series([sorted(Item(t, frozenset(r)).grams) for t, r in zip(texts, rare)], dtype=object)

    @F.pandas_udf("array<bigint>")
    def windows(texts: pd.Series) -> pd.Series:
        def all_of(text: str) -> list[int]:
            words = words_of(text)
            return sorted({gram_hash(words[k : k + size]) for size in range(1, N + 1) for k in range(len(words) - size + 1)})

        return texts.map(all_of)

    @F.pandas_udf("boolean")
    def carries(texts: pd.Series, passages: pd.Series, rare: pd.Series) -> pd.Series:
        known: dict[str, Item] = {}

        def one(text: str, passage: str, r: list[str]) -> bool:
            if passage not in known:
                known[passage] = Item(passage, frozenset(r))
            item, words = known[passage], words_of(text)
            return item.in_words(words, [k for k in range(len(words) - item.size + 1) if gram_hash(words[k : k + item.size]) in item.grams]) is not None

        return pd.Series([one(*row) for row in zip(texts, passages, rare)], dtype=bool)

    passages = cut(items.select("item_text").distinct().withColumn("words", distinct_words("item_text")))
    most = F.greatest(F.lit(RARE_ITEMS), F.lit(RARE_SHARE) * F.lit(passages.select("words").distinct().count()))
    seen = passages.select("words").distinct().select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") <= most)
    own = passages.select("item_text", F.explode("words").alias("word")).join(seen, "word", "left_semi").groupBy("item_text").agg(F.collect_set("word").alias("rare"))
    told = cut(passages.select("item_text").join(own, "item_text", "left").select("item_text", F.coalesce("rare", F.array().cast("array<string>")).alias("rare")))
    texts = rows.where("text IS NOT NULL").select("text").distinct()
    grams = told.select("item_text", F.explode(owned("item_text", "rare")).alias("gram"))
    pairs = texts.select("text", F.explode(windows("text")).alias("gram")).join(grams, "gram").select("text", "item_text").distinct()
    found = pairs.join(told, "item_text").where(carries("text", "item_text", "rare")).select("text", "item_text")
    return rows.join(found, "text").join(items, "item_text").select("doc_id", "item_id")


def cleaned(documents: DataFrame, doc_id: str, text: str, items: DataFrame) -> DataFrame:
    """doc_id, text of every document row, without the spans that carry an item; the rest of the text stays as it is."""
    shared = broadcast_finder(documents.sparkSession, items)
    if shared is None:
        raise ValueError("spans are removed only with test material that fits a broadcast; use without_leaks")

    @F.pandas_udf("string")
    def remove(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: t if t is None else shared.value.without(t))

    return _rows(documents, doc_id, text).select("doc_id", remove("text").alias("text"))


def without_leaks(documents: DataFrame, doc_id: str, found: DataFrame) -> DataFrame:
    """The documents that carry no item."""
    return documents.join(found.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")
