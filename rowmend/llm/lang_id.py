"""Language identification: nearest centroid by cosine over normalised TF-IDF vectors of character n-grams."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import row_udf, with_result

BITS = 14
FEATURES = 1 << BITS
ORDERS = 3
PARTS = 64  # into which the labelled rows of a language are dealt before the least hashes are taken
UNKNOWN = "und"
SCHEMA = "lang_pred string, nearest string, score double, similarity double, rejected boolean"
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917], np.uint32)


def letter_table() -> np.ndarray:
    """Code point of each letter, a space for everything else."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32)


def ngram_counts(text: str | None, letters: np.ndarray) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams of lower-case letters with single spaces between words; None without a letter."""
    if not text:
        return None
    codes = letters[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = codes == 32
    if gap.all():
        return None
    codes = np.concatenate([[32], codes[~(gap & np.concatenate([[True], gap[:-1]]))], [32]]).astype(np.uint32)
    total = np.zeros(FEATURES, np.int64)
    mixed = np.zeros(len(codes), np.uint32)
    for order in range(ORDERS):
        if len(codes) <= order:
            break
        mixed = (mixed[: len(codes) - order] ^ codes[order:]) * _MULTIPLIERS[order]
        mixed ^= mixed >> np.uint32(15)
        total += np.bincount((mixed * np.uint32(2654435769)) >> np.uint32(32 - BITS), minlength=FEATURES)
    return total


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and their weights of a unit vector: damped counts times inverse document frequency."""
    at = np.flatnonzero(counts)
    value = (1 + np.log(counts[at])) * idf[at]
    return at, value / np.linalg.norm(value)


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)  # of each centroid
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, 0), np.float32))
    least: np.ndarray = field(default_factory=lambda: np.zeros(0))  # similarity below which a text is rejected
    idf: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))


def cluster(vectors: np.ndarray, k: int, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; the first centre is the mean, each next one the vector least like the centres so far."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    centres = unit(vectors.mean(0, keepdims=True))
    while len(centres) < min(k, len(vectors)):
        centres = np.vstack([centres, vectors[np.argmin((vectors @ centres.T).max(1))]])
    of = np.full(len(vectors), -1)
    for _ in range(rounds):
        now = np.argmax(vectors @ centres.T, 1)
        if (now == of).all():
            break
        of = now
        sums = np.vstack([vectors[of == j].sum(0) if (of == j).any() else centres[j] for j in range(len(centres))])
        centres = unit(sums)
    return centres, np.argmax(vectors @ centres.T, 1)


def fit(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id",
        clusters: int = 3, per_language: int = 400, max_rows: int = 2000, tail: float = 0.005, slack: float = 0.6) -> Model:
    """Centroids from a bounded sample: per language the `per_language` rows with the smallest hash of their key (of their text if
    the key is null), `max_rows` in all (languages in order of their name).  Rows of a language with one key, or without a key and with one text, count as one, the
    least text.  Only n-gram counts, at most 16,384 numbers a row, reach the driver.

    Each centroid rejects texts whose similarity is below `slack` times the `tail` quantile of its own members.  Rows with a
    null language, a null text or no letter teach nothing.  Columns other than the three named are not read.
    """
    known = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    key = F.col(key_col)
    hashed = F.when(key.isNull(), F.xxhash64(F.lit(5), F.col(text_col))).otherwise(F.xxhash64(F.lit(5), key))
    keyed = known.select(F.col(lang_col).alias("l"), hashed.alias("h"))
    place = lambda *of: F.row_number().over(W.partitionBy(*of).orderBy("h"))
    part = F.pmod("h", F.lit(PARTS)).alias("part")
    least = keyed.select("l", "h", part).distinct().withColumn("r", place("l", "part")).where(F.col("r") <= per_language)
    picked = least.withColumn("r", place("l")).where(F.col("r") <= per_language).orderBy("r", "l").limit(max_rows).select("h", "l")
    rows = known.select(key.alias("k"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"), hashed.alias("h"))
    rows = rows.join(F.broadcast(picked), ["h", "l"], "left_semi")  # at most max_rows
    rows = rows.groupBy("l", "h").agg(F.min(F.struct("k", "t")).alias("row")).select("l", "h", "row.*")

    def counts(texts):
        letters = cache.setdefault("letters", letter_table()) if "letters" not in cache else cache["letters"]
        out: dict = {"at": [], "n": []}
        for t in texts:
            c = ngram_counts(t, letters)
            at = np.flatnonzero(c) if c is not None else np.empty(0, np.int64)
            out["at"].append(at.astype(np.int32))
            out["n"].append(c[at].astype(np.int32) if c is not None else at.astype(np.int32))
        return out

    cache: dict = {}
    found = with_result(rows, row_udf(counts, "at array<int>, n array<int>")(F.col("t")), ["at", "n"])
    first = found.where(F.size("at") > 0).select("l", "k", "h", "at", "n").orderBy("k", "l", "h").collect()
    if not first:
        return Model()
    df = np.zeros(FEATURES)
    for r in first:
        df[r["at"]] += 1
    idf = np.log((1 + len(first)) / (1 + df)) + 1
    model = Model(idf=idf)
    parts, least = [], []
    for language in sorted({r["l"] for r in first}):
        own = [r for r in first if r["l"] == language]
        vectors = np.zeros((len(own), FEATURES), np.float32)
        for i, r in enumerate(own):
            c = np.zeros(FEATURES)
            c[r["at"]] = r["n"]
            at, value = weighted(c, idf)
            vectors[i, at] = value
        centres, of = cluster(vectors, clusters)
        near = (vectors * centres[of]).sum(1)
        for j in range(len(centres)):
            if (of == j).any():
                parts.append(centres[j])
                least.append(slack * float(np.quantile(near[of == j], tail)))
                model.languages.append(language)
    model.centroids = np.ascontiguousarray(np.vstack(parts).T.astype(np.float32))
    model.least = np.array(least)
    return model


def predictor(model: Model):
    names, cache = np.array(model.languages, object), {}

    def predict(texts: list[str | None]) -> dict:
        if "letters" not in cache:
            cache["letters"] = letter_table()
        out: dict = {f.split()[0]: [] for f in SCHEMA.split(", ")}
        for text in texts:
            counts = ngram_counts(text, cache["letters"])
            if counts is None or not len(names):
                row = (UNKNOWN, UNKNOWN, 0.0, 0.0, True)
            else:
                at, value = weighted(counts, model.idf)
                near = value @ model.centroids[at]
                best = int(np.argmax(near))
                other = near[names != names[best]]
                similar = float(np.clip(near[best], 0, 1))
                share = 1.0 if not len(other) else float(np.clip(0.5 + 2.5 * (near[best] - other.max()), 0, 1))
                refused = bool(near[best] < model.least[best])
                row = (UNKNOWN if refused else names[best], names[best], share, similar, refused)
            for f, v in zip(out, row):
                out[f].append(v)
        return out

    return predict


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with `lang_pred` (`und` if the text is too far from every centroid), `nearest` (the closest language whatever
    the distance), `score` (margin over the next language, 0 to 1), `similarity` (cosine) and `rejected`.

    A null text, a text without a letter, or an empty model gives `und`, score 0, rejected.  Equal similarities go to the
    language that sorts first.  Repeated rows get equal results, columns named like an output are replaced, an empty table
    gives an empty table; the text is read whole.  The model is sent with the tasks: 16,384 numbers per centroid.
    """
    return with_result(docs, row_udf(predictor(model), SCHEMA)(F.col(text_col)), [f.split()[0] for f in SCHEMA.split(", ")])
