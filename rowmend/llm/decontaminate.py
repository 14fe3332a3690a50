"""Benchmark decontamination: spaced seeds over word positions, verified by a substitution-tolerant overlap."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_udf, text_bytes, with_result
from .licenses import _word_bytes
from .mixing import word_count

# 1 is a position that must agree, 0 one that is ignored.  Together they meet every stretch of 10 words or more of which 80 %
# agree: such a stretch holds one of 10 words with 2 substitutions at most, six equal words in a row or one of 15 words with 3.
MASKS = ("111111", "11011011", "11100111", "110101011", "1100011011")
SPAN = max(map(len, MASKS))
TOLERANCE = 1e-9
SHORTEST_ITEM = 5  # words; shorter items would name ordinary phrases
BLOCK_WORDS = 500_000  # words of benchmark text that one function carries
PIECE_WORDS, PIECE_STEP = 1024, 960

SCHEMA = "contaminated boolean, item_ids array<bigint>, overlap_words int, identity double"


def passing_stretches(same: np.ndarray, least_words: int, identity: float) -> tuple[list[tuple[int, int]], float]:
    """(start, end) of what the stretches of at least `least_words` words of which `identity` agree cover, each taken from its
    first to its last equal word, and the best identity of such a stretch; nothing and 0 if there is none."""
    n = len(same)
    hits = np.concatenate([[0], np.cumsum(same)])
    lengths = range(least_words, min(2 * least_words - 1, n) + 1)  # a longer stretch is two, one of them no worse
    best = max((float((hits[k:] - hits[:-k]).max()) / k for k in lengths), default=0.0)
    if best < identity - TOLERANCE:
        return [], 0.0
    total = hits - (identity - TOLERANCE) * np.arange(n + 1)
    later = np.maximum.accumulate(total[::-1])  # the best total at or after each place, from the last place on
    ends = n - np.searchsorted(later, total, "left")  # the farthest end that passes, for every start
    equal = np.flatnonzero(same)
    spans: list[tuple[int, int]] = []
    for start in np.flatnonzero(ends - np.arange(n + 1) >= least_words).tolist():
        first, last = equal[hits[start]], equal[hits[ends[start]] - 1] + 1
        if spans and first <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], int(last)))
        else:
            spans.append((int(first), int(last)))
    return spans, best


class Index:
    """Seeds of benchmark items: for each mask the sorted hashes of all positions."""

    def __init__(self, items: list[tuple[int | None, bytes]], masks: tuple[str, ...] = MASKS):
        words = _word_bytes()
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int | None, np.ndarray, bool]] = []  # id, words, whole (matched without gaps)
        for item_id, text in items:
            tokens = text.decode().lower().encode().translate(words).split()
            ids = np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens], np.int64)
            if len(ids) >= SPAN:
                for a in range(0, max(1, len(ids) - (PIECE_WORDS - PIECE_STEP)), PIECE_STEP):
                    self.items.append((item_id, ids[a : a + PIECE_WORDS], False))
            elif len(ids) >= SHORTEST_ITEM:
                self.items.append((item_id, ids, True))
        self.masks = [m for m in masks] + sorted({"1" * len(ids) for _, ids, whole in self.items if whole})
        self.tables = []
        for number, mask in enumerate(self.masks):
            of, at, hashes = [], [], []
            for k, (_, ids, whole) in enumerate(self.items):
                if whole == (number >= len(masks)) and (not whole or len(ids) == len(mask)):
                    h = self.hashed(ids, mask)
                    hashes.append(h)
                    of.append(np.full(len(h), k))
                    at.append(np.arange(len(h)))
            flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (hashes, of, at)]
            order = np.argsort(flat[0], kind="stable")
            self.tables.append(tuple(x[order] for x in flat))

    @staticmethod
    def hashed(ids: np.ndarray, mask: str) -> np.ndarray:
        """A hash of the words under the mask, for every window; windows may hold words outside the vocabulary."""
        n = len(ids) - len(mask) + 1
        if n <= 0:
            return np.empty(0, np.int64)
        total = np.zeros(n, np.int64)
        with np.errstate(over="ignore"):
            for offset, bit in enumerate(mask):
                if bit == "1":
                    total = (total ^ ids[offset : offset + n]) * np.int64(-7046029254386353131)
                    total ^= (total >> 29) & np.int64(0x7FFFFFFFF)
        return total

    def seeds(self, ids: np.ndarray) -> set[tuple[int, int]]:
        """(item, diagonal) of every seed that a text shares with an item; words outside the vocabulary agree with none."""
        found: set[tuple[int, int]] = set()
        unknown = ids == 0
        for mask, (hashes, of, at) in zip(self.masks, self.tables):
            n = len(ids) - len(mask) + 1
            if n <= 0 or not len(hashes):
                continue
            bad = np.zeros(n, bool)
            for offset, bit in enumerate(mask):
                if bit == "1":
                    bad |= unknown[offset : offset + n]
            windows = np.flatnonzero(~bad)
            if not len(windows):
                continue
            h = self.hashed(ids, mask)[windows]
            low = np.searchsorted(hashes, h, "left")
            hit = np.flatnonzero((low < len(hashes)) & (hashes[np.minimum(low, len(hashes) - 1)] == h))
            high = np.searchsorted(hashes, h[hit], "right")
            for w, a, b in zip(windows[hit].tolist(), low[hit].tolist(), high.tolist()):
                found.update(zip(of[a:b].tolist(), (w - at[a:b]).tolist()))
        return found

    def overlaps(self, ids: np.ndarray, least_words: int, identity: float) -> list[tuple[int, list[tuple[int, int]], float]]:
        """(item, spans, best identity) of verified overlaps: long enough, or the whole of a short item, and alike enough."""
        out = []
        for k, diagonal in self.seeds(ids):
            item = self.items[k][1]
            a, b = max(diagonal, 0), min(diagonal + len(item), len(ids))
            spans, best = passing_stretches(ids[a:b] == item[a - diagonal : b - diagonal], min(least_words, len(item)), identity)
            if spans:
                out.append((k, [(a + start, a + end) for start, end in spans], best))
        return out


def finder(index: Index, least_words: int, identity: float):
    words, get = _word_bytes(), index.vocabulary.get

    def find(texts: list[bytes]) -> dict:
        out: dict = {"contaminated": [], "item_ids": [], "overlap_words": [], "identity": []}
        for data in texts:
            ids = np.array([get(t, 0) for t in data.decode().lower().encode().translate(words).split()], np.int64)
            found = index.overlaps(ids, least_words, identity)
            covered = set().union(*(range(a, b) for _, spans, _ in found for a, b in spans))
            out["contaminated"].append(bool(found))
            out["item_ids"].append(sorted({index.items[k][0] for k, *_ in found if index.items[k][0] is not None}))
            out["overlap_words"].append(len(covered))
            out["identity"].append(max((x for *_, x in found), default=None))
        return out

    return find


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                       least_words: int = 10, identity: float = 0.8, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` with `contaminated`, the ids of the items found (`item_ids`, sorted), the number of words in overlaps and the
    best identity.

    Words are runs of letters in lower case, ASCII digits and other characters beyond ASCII.  A text is contaminated if it shares
    with an item a stretch of at least `least_words` words, word for word in place, of which `identity` agree (the seeds find all
    of them from 10 words and 0.8 on); `overlap_words` counts such stretches from their first to their last equal word.  Items of
    5 to 9 words must occur whole, shorter ones are ignored.  The benchmark is cut into blocks of about `block_words` words; every
    block is sent with one function, and all functions run in the same pass over the documents, so a benchmark of any size
    is held against every text.  Null texts are clean, null benchmark texts are ignored, an item without an id marks texts but
    is not listed; repeated items count once, an empty benchmark marks nothing; columns named like an output are replaced.
    """
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).distinct()
    items = items.withColumn("n", word_count("t"))
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // block_words) or 1
    parts: list[Column] = []
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).orderBy("i", "t").collect()  # about block_words words
        index = Index([(r["i"], r["t"].encode()) for r in own])
        parts.append(row_udf(finder(index, least_words, identity), SCHEMA)(text_bytes(text_col)))
    fields = [f.split()[0] for f in SCHEMA.split(", ")]
    if blocks == 1:
        return with_result(docs, parts[0], fields)
    all_parts = F.array(*parts)
    merged = F.struct(
        F.exists(all_parts, lambda p: p["contaminated"]).alias("contaminated"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(all_parts, lambda p: p["item_ids"])))).alias("item_ids"),
        F.aggregate(all_parts, F.lit(0), lambda t, p: t + p["overlap_words"]).alias("overlap_words"),
        F.array_max(F.transform(all_parts, lambda p: p["identity"])).alias("identity"),
    )
    return with_result(docs, merged, fields)
