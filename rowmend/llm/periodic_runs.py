"""Runs of words that repeat with a period, found by splitting at rare words and then comparing at every lag.

In a run of period q that is at least 4 q and at least 6 words long every word occurs four times.  So a word that occurs fewer
times in the stretch at hand lies in no run and splits it; the pieces are split again by their own, smaller counts
until nothing changes.  Only what survives is compared with itself at a distance of q words, for every q that fits.
A run's words all equal those q further on, so three neighbouring multiples of q lie in it: looking at every q-th word
finds each run, and the whole scan takes n log n steps.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_udf, small_batches, text_bytes, with_result

LEAST_LENGTH = 6  # words in the shortest run
LEAST_POWER = 4  # periods in the shortest run
CHUNK_WORDS = 500_000  # words of several texts that are searched together

SCHEMA = ("n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
          "runs_sha256 string, collapsed_sha256 string")


def surviving(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that splitting at rare words leaves, and the number of the segment each is in.

    `keys` are word numbers, `owner` the text of each word; both in the order of the texts.
    """
    place = np.arange(len(keys))
    segment = owner.astype(np.int64)
    while len(place):
        _, word = np.unique(segment * (int(keys.max()) + 1) + keys[place], return_inverse=True)
        often = np.bincount(word)[word] >= LEAST_POWER
        size = np.bincount(segment)[segment]
        stays = often & (size >= LEAST_LENGTH)
        if stays.all():
            break
        gone = np.cumsum(~stays)
        # a segment goes on as long as no word between has gone
        border = gone[stays] * (int(segment.max()) + 1) + segment[stays]
        place = place[stays]
        segment = np.cumsum(np.append(0, border[1:] != border[:-1])) if len(place) else border
    return place, segment


def _stretch(words: np.ndarray, q: int, at: int, low: int, high: int) -> tuple[int, int]:
    """Borders of the longest stretch around `at`, inside [low, high), whose words equal those q further on."""
    left, step = at, 64
    while left > low:
        from_ = max(low, left - step)
        differs = np.flatnonzero(words[from_:left] != words[from_ + q : left + q])
        if len(differs):
            left = from_ + int(differs[-1]) + 1
            break
        left, step = from_, step * 4
    right, step, end = at, 64, high - q
    while right < end:
        to = min(end, right + step)
        differs = np.flatnonzero(words[right:to] != words[right + q : to + q])
        if len(differs):
            right += int(differs[0])
            break
        right, step = to, step * 4
    return left, right + q


def find_runs(keys: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, start, period, length) of every run, ordered; text i has the words bounds[i] to bounds[i + 1]."""
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place, segment = surviving(keys, owner)
    if not len(place):
        return []
    size = np.bincount(segment)
    order = np.argsort(-size, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    by_size = np.argsort(rank[segment], kind="stable")
    place = place[by_size]
    words = keys[place]
    size = size[order]
    high = np.cumsum(size)
    low = high - size
    inside = np.repeat(np.arange(len(size)), size)
    reach = np.zeros(len(place), np.int64)  # end of the run that covers a word and goes furthest
    found = []
    longest = int(size[0])
    for q in range(1, longest // LEAST_POWER + 1):
        n = int(high[np.searchsorted(-size, -max(LEAST_LENGTH, LEAST_POWER * q), side="right") - 1])
        grid = words[:n:q]
        if len(grid) < 4:
            break
        same = grid[1:] == grid[:-1]
        hits = np.flatnonzero(same[2:] & same[1:-1] & same[:-2]) * q
        if not len(hits):
            continue
        hits = hits[(inside[hits] == inside[hits + 3 * q]) & (reach[hits] <= hits + 3 * q)]
        done = 0
        for at in hits.tolist():
            if at + 2 * q < done or reach[at] > at + 3 * q or not np.array_equal(words[at : at + 2 * q + 1], words[at + q : at + 3 * q + 1]):
                continue
            left, end = _stretch(words, q, at, int(low[inside[at]]), int(high[inside[at]]))
            done = end - q
            if end - left >= max(LEAST_LENGTH, LEAST_POWER * q):
                np.maximum(reach[left:end], end, out=reach[left:end])
                text = int(owner[place[left]])
                found.append((text, int(place[left] - bounds[text]), q, end - left))
    return sorted(found)


def describe(texts: list[bytes]) -> dict[str, list]:
    """The columns of SCHEMA for a list of texts."""
    out: dict[str, list] = {f.split()[0]: [] for f in SCHEMA.split(", ")}
    split: list[list[bytes]] = []
    keys: list[int] = []
    seen: dict[bytes, int] = {}

    def flush():
        bounds = np.cumsum([0, *map(len, split)])
        runs: list[list[tuple[int, int, int]]] = [[] for _ in split]
        for text, start, period, length in find_runs(np.array(keys, np.int64), bounds):
            runs[text].append((start, period, length))
        for words, own in zip(split, runs):
            kept = words
            if own:
                drop = np.zeros(len(words) + 1, np.int64)
                for start, period, length in own:
                    drop[start + period] += 1
                    drop[start + length] -= 1
                kept = [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]
            start, period, length = min(own, key=lambda r: (-r[2], r[0], r[1])) if own else (None, None, None)
            listed = "".join(f"{s},{n},{p}\n" for s, p, n in own)
            row = (len(words), len(own), start, length, period, 1000 * length // period if own else None,
                   hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())
            for name, value in zip(out, row):
                out[name].append(value)

    for data in texts:
        words = data.split()
        if keys and len(keys) + len(words) > CHUNK_WORDS:
            flush()
            split, keys, seen = [], [], {}
        keys.extend([seen.setdefault(w, len(seen)) for w in words])
        split.append(words)
    if split:
        flush()
    return out


def mark_runs(docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """`docs` with the number of runs of each text, its longest run, and digests of all runs and of the text without repeats.

    Words are separated by ASCII white space.  A run is a stretch of words with smallest period q, at least 6 and 4 q long,
    that no neighbouring word extends.  The longest run (ties: smallest start, then period) is null if there is none.  A word is
    dropped from the collapsed text if any run holds it after that run's first q words.  A null or empty text has no words.
    Each row stands for itself; input columns named like output columns are replaced; an empty table gives an empty table.
    A text is held whole by one task, whose arrays take about 100 bytes a word.
    """
    small_batches(docs.sparkSession)
    data = text_bytes(text) if isinstance(text, str) else F.coalesce(text, F.lit("")).cast("binary")
    return with_result(docs, row_udf(describe, SCHEMA)(data), [f.split()[0] for f in SCHEMA.split(", ")])


def with_planted_runs(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text; for a tenth of the ids, chosen by checksum, its words from a place on repeat with a period that depends on the checksum.

    A null id has the checksum of the empty text, a null text no words.
    """
    checksum = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g, n = F.floor(checksum / 10), F.size(words).cast("bigint")
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    times = F.ceil((n - a) / p)
    front, period = F.slice(words, F.lit(1), a.cast("int")), F.slice(words, (a + 1).cast("int"), p.cast("int"))
    repeated = F.slice(F.concat(front, F.flatten(F.array_repeat(period, times.cast("int")))), F.lit(1), n.cast("int"))
    return F.when((checksum % 10 == 0) & (n > 0), F.array_join(repeated, " ")).otherwise(F.col(text))
