"""Quality rules from repeated substrings: a suffix array over the words of each text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import byte_table, code_points, row_udf, segment_sums, text_bytes, with_result

WINDOW_LEVEL = 3  # 2 ** 3 words: the window of the base columns and the shortest repeat that counts
WINDOW = 2**WINDOW_LEVEL
MIN_WORDS = 20
BASE_PERCENT = 30
CHUNK_WORDS = 200_000  # words that one suffix array covers; a longer text has an array of its own

_NOT_SYMBOL = byte_table(lambda b: b in b"#*$%&|<>")

SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "kept boolean, covered_fraction double, longest_repeat bigint"
)


def suffix_ranks(keys: np.ndarray) -> list[np.ndarray]:
    """Prefix doubling.  Level j ranks the suffixes by their first 2 ** j keys: equal ranks mean equal prefixes.

    Only suffixes that still share their prefix are sorted again, so after a few levels the work is that of the repeats
    alone.  Keys of different texts must differ; then no prefix that reaches into the next text equals another.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if n else np.empty(0, int)
    sizes = np.diff(np.append(starts, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, sizes)
    levels, active, step = [rank], order[np.repeat(sizes > 1, sizes)], 1
    while len(active):
        rank = levels[-1]
        follow = np.where(active + step < n, rank[np.minimum(active + step, n - 1)] + 1, 0)
        old = rank[active]
        again = np.lexsort((follow, old))
        active, old, follow = active[again], old[again], follow[again]
        at = np.arange(len(active))
        group = np.concatenate([[True], old[1:] != old[:-1]])
        part = group | np.concatenate([[True], follow[1:] != follow[:-1]])
        starts = np.flatnonzero(part)
        sizes = np.diff(np.append(starts, len(active)))
        offset = starts - np.maximum.accumulate(np.where(group, at, 0))[starts]
        rank = rank.copy()
        rank[active] = old + np.repeat(offset, sizes)
        levels.append(rank)
        active = active[np.repeat(sizes > 1, sizes)]
        step *= 2
    return levels


def shared_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common prefix, in keys, of the suffixes at a and at b."""
    n = len(levels[0])
    length = np.zeros(len(a), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        inside = (x < n) & (y < n)
        same = inside & (levels[j][np.minimum(x, n - 1)] == levels[j][np.minimum(y, n - 1)])
        length += same * 2**j
    return length


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """0 or 1 for each position: whether some span [start, start + length) holds it."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)[: n + 1]
    return (np.cumsum(edge[:n]) > 0).astype(np.int64)


def repeats(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text [bounds[i], bounds[i + 1]): words in repeated windows, words in maximal repeats, longest repeat.

    Neighbours in suffix order bound the intervals of the common-prefix table; the longest repeat that starts at a word is
    the longer of its two common prefixes, and the union of those spans is the union of all maximal repeats.
    """
    n, texts = len(keys), len(bounds) - 1
    zero = np.zeros(texts, np.int64)
    levels = suffix_ranks(keys)
    if len(levels) <= WINDOW_LEVEL:
        return zero, zero, zero
    window = levels[WINDOW_LEVEL]
    shared = np.flatnonzero(np.bincount(window, minlength=n)[window] > 1)
    if not len(shared):
        return zero, zero, zero
    in_window = covered(shared, np.full(len(shared), WINDOW), n)
    order = shared[np.argsort(levels[-1][shared])]
    same = window[order][1:] == window[order][:-1]
    common = np.where(same, shared_prefix(levels, order[:-1], order[1:]), 0)
    longest = np.maximum(np.concatenate([[0], common]), np.concatenate([common, [0]]))
    in_repeat = covered(order, longest, n)
    most = zero.copy()
    np.maximum.at(most, np.searchsorted(bounds, order, "right") - 1, longest)
    return segment_sums(in_window, bounds), segment_sums(in_repeat, bounds), most


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = data.split(b"\n")
    if len(lines) == 1:
        return 0
    lines = [x for x in lines if x and not x.isspace()]
    return len(lines) - len(set(lines))


def statistics(texts: list[bytes], max_fraction: float, max_longest: float, min_longest: int) -> dict:
    out: dict = {f.split()[0]: [] for f in SCHEMA.split(", ")}
    repeat_words, in_repeat, longest = [], [], []
    keys: list[int] = []
    bounds = [0]

    def flush():
        text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        width = max(keys, default=0) + 1
        for total, part in zip((repeat_words, in_repeat, longest), repeats(text_of * width + np.asarray(keys, np.int64), np.asarray(bounds))):
            total.extend(part.tolist())

    seen: dict = {}
    for data in texts:
        words = data.split()
        if keys and len(keys) + len(words) > CHUNK_WORDS:
            flush()
            keys, bounds, seen = [], [0], {}
        keys.extend([seen.setdefault(w, len(seen)) for w in words])
        bounds.append(len(keys))
        out["n_words"].append(len(words))
        out["word_chars"].append(code_points(b"".join(words)))
        out["n_symbols"].append(len(data.translate(None, _NOT_SYMBOL)))
        out["n_dup_lines"].append(duplicate_lines(data))
    if len(bounds) > 1:
        flush()
    for n, window_words, words_in, most in zip(out["n_words"], repeat_words, in_repeat, longest):
        failed = n < MIN_WORDS or 100 * window_words > BASE_PERCENT * n
        fraction = words_in / n if n else 0.0
        out["n_repeat_words"].append(window_words)
        out["base_failed"].append(failed)
        out["covered_fraction"].append(fraction)
        out["longest_repeat"].append(most)
        out["kept"].append(not failed and fraction <= max_fraction and most <= max(min_longest, max_longest * n))
    return out


def apply_rules(docs: DataFrame, text_col: str = "text", max_fraction: float = 0.3, max_longest: float = 0.2, min_longest: int = 40) -> DataFrame:
    """`docs` with word statistics, repeats of whole texts, and whether a text is kept.

    A text fails if it has fewer than 20 words, if repeated 8-word windows hold over 30 % of its words, if maximal repeats
    hold more than `max_fraction` of them, or if the longest repeat is longer than both `min_longest` words and
    `max_longest` of the text.  A null text has no words and fails.  Words are separated by ASCII white space; a NUL or any
    other character belongs to a word.  Each row stands for itself, so repeated rows give equal results; input columns
    named like output columns are replaced; an empty table gives an empty table.  A text is held whole by one task, whose
    arrays take about 100 bytes a word.
    """
    fields = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(texts):
        return statistics(texts, max_fraction, max_longest, min_longest)

    return with_result(docs, row_udf(run, SCHEMA)(text_bytes(text_col)), fields)
