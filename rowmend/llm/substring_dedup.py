"""Substring dedup: runs of consecutive sentences that occur more than once, removed everywhere but at their first place."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import row_udf, stored, text_bytes

RUN = 3  # sentences
LEAST_WORDS = 12
LONG = 12  # words; a longer sentence is cut further

# A sentence ends at a mark before white space or at a line end.  Clause marks count too: a passage put into the middle of a
# text shares its first and last sentence with its surroundings, but not its clauses.
_END = re.compile(rb"[.!?,;:]+[ \t\r\n\x0b\x0c]+|\n+")

# Where a sentence of over LONG words is cut again: after words whose last byte has the remainder 5 modulo 8.  The same words
# are cut at the same places wherever they stand, so a passage within one long sentence is found too.
_CUT = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in range(33, 256) if b % 8 == 5) + b"][ \t\r\n\x0b\x0c]+")
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\r\n\x0b\x0c")] = True


def sentence_ends(data: bytes) -> list[int]:
    """Offsets at which the sentences of a text end; the last is its length."""
    out, start = [], 0
    for stop in [*(m.end() for m in _END.finditer(data)), len(data)]:
        if stop > start:
            if data.count(b" ", start, stop) > LONG:
                out.extend([m.end() for m in _CUT.finditer(data, start, stop) if m.end() < stop])
            out.append(stop)
            start = stop
    return out


def words_before(data: bytes, ends: list[int]) -> np.ndarray:
    """Number of words before each sentence, and of all words at the end."""
    space = _SPACE[np.frombuffer(data, np.uint8)]
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    return np.concatenate([[0], np.searchsorted(first, ends)])


def run_spans(before: np.ndarray, run: int = RUN, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) sentence of each run: from every sentence with a word on, the fewest sentences that are at
    least `run` and hold `least_words` words."""
    starts = np.flatnonzero(np.diff(before) > 0)
    stops = np.maximum(starts + run, np.searchsorted(before, before[starts] + least_words))
    whole = stops < len(before)
    return starts[whole], stops[whole]


def run_keys(data: bytes, run: int = RUN, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, list[bytes]]:
    """First sentence of each run, and its words: A-Z in lower case, joined by single spaces."""
    before = words_before(data, sentence_ends(data))
    starts, stops = run_spans(before, run, least_words)
    words = data.lower().split()
    text = b" ".join(words)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    return starts, [text[a : b - 1] for a, b in zip(at[before[starts]].tolist(), at[before[stops]].tolist())]


def _places(docs: DataFrame, id_col: str, text_col: str, run: int, least_words: int) -> DataFrame:
    """(hash, id, place) of every run; `place` holds the crc32 of the text above the number of the first sentence, so rows
    that share an id but not a text are told apart."""
    rows = docs.select(F.col(id_col).alias("id"), F.crc32(text_bytes(text_col)).alias("crc"), text_bytes(text_col).alias("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            hashes: list[int] = []
            first: list[np.ndarray] = []
            counts = []
            for data in batch.column(2).to_pylist():
                starts, keys = run_keys(data, run, least_words)
                hashes.extend([digest(k, 1) for k in keys])
                first.append(starts)
                counts.append(len(starts))
            at = np.repeat(np.arange(len(counts)), counts)
            place = (batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[at] << 31) | np.concatenate([*first, np.empty(0, np.int64)])
            for a in range(0, len(at), 200_000):
                part = slice(a, a + 200_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(hashes[part], np.uint64).view(np.int64)), batch.column(0).take(pa.array(at[part])), pa.array(place[part])],
                    ["hash", "id", "place"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(emit, f"hash bigint, id {kind}, place bigint")


def repeated_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, crc, starts): for each text the first sentences of its runs that also occur at an earlier place.

    Places are ordered by id (null first), then text, then position.  Counting sends one number per run; only runs whose
    hash repeats are looked at again.  Equal rows (same id and text) are the same place, so neither is earlier.
    """
    places = _places(docs, id_col, text_col, run, least_words)
    # both tables are stored before they are joined, so that the join shuffles its sides anew and can split a hot hash
    repeated = cut_lineage(places.groupBy("hash").count().where("count > 1").select("hash"))
    shared = stored(places.join(repeated, "hash"), "repeats")
    first = cut_lineage(shared.groupBy("hash").agg(F.min(F.struct("id", "place")).alias("first")))
    later = shared.join(first, "hash").where(~(F.struct("id", "place").eqNullSafe(F.col("first"))))
    by_text = later.groupBy("id", F.shiftright("place", 31).alias("crc"))
    return by_text.agg(F.collect_set(F.col("place").bitwiseAND(F.lit(2**31 - 1)).cast("int")).alias("starts"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """`docs` with repeated passages removed from the text, and `n_removed` (sentences) and `words_removed`.

    A sentence goes if a run that covers it occurs at an earlier place, in this text or in another; the other sentences stay
    as they are, byte for byte.  Runs are whole sentences (cut at clauses), at least `run` of them with `least_words` words,
    so shorter repeats stay.  A null text stays null, a text that loses every sentence becomes empty, a text without words
    has no runs.  Runs are compared by 64-bit hashes.  Columns named like an output are replaced; an empty table gives an
    empty table.
    """
    lost = cut_lineage(repeated_places(docs, id_col, text_col, run, least_words))
    outputs = ("n_removed", "words_removed")
    kept = [c for c in docs.columns if c.lower() not in outputs]
    lost = lost.select(F.col("id").alias("__id"), F.col("crc").alias("__crc"), F.col("starts").alias("__starts"))
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.crc32(text_bytes(text_col)).alias("__key"))
    joined = rows.join(lost, (F.col("__key") == F.col("__crc")) & F.col(f"`{id_col}`").eqNullSafe(F.col("__id")), "left")

    def cut(texts: list, starts: list) -> dict:
        out: dict = {"text": [], "removed": [], "words": []}
        for data, chosen in zip(texts, starts):
            if not chosen:
                row = (None, 0, 0)
            else:
                ends = sentence_ends(data)
                before = words_before(data, ends)
                firsts, stops = run_spans(before, run, least_words)
                hit = np.isin(firsts, chosen)
                gone = np.zeros(len(ends) + 1, np.int64)
                np.add.at(gone, firsts[hit], 1)
                np.add.at(gone, stops[hit], -1)
                covered = np.cumsum(gone[:-1]) > 0
                kept = [data[a:b] for a, b, c in zip([0, *ends], ends, covered) if not c]
                row = (b"".join(kept).decode(), int(covered.sum()), int(np.diff(before)[covered].sum()))
            for f, v in zip(out, row):
                out[f].append(v)
        return out

    touched = F.when(F.col("__starts").isNotNull(), text_bytes(text_col))
    result = row_udf(cut, "text string, removed int, words bigint")(touched, F.col("__starts"))
    done = joined.select(*[F.col(f"`{c}`") for c in kept], result.alias("__r"))
    text = F.when(F.col(text_col).isNotNull(), F.coalesce(F.col("__r.text"), F.col(text_col))).alias(text_col)
    return done.select(*[text if c == text_col else F.col(f"`{c}`") for c in kept], F.col("__r.removed").alias("n_removed"), F.col("__r.words").alias("words_removed"))
