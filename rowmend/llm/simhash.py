"""Near duplicates: SimHash fingerprints, searched with BK-trees over the integer Hamming distance, and shingle sets by their
first members.

A tree of all fingerprints would grow with the corpus and could not be broadcast.  Fingerprints are therefore dealt to
shards: the 64 bits are cut into radius + 2 blocks, and a shard holds the fingerprints that agree in two given blocks.
Two fingerprints within the radius differ in at most `radius` blocks, so they share a shard of some pair of blocks and no
link is lost.  A shard's tree has at most `SHARD` nodes; a larger shard is cut into parts, and the tree of each part is
sent to the tasks that search it with the other parts, which is the broadcast of a shard tree to its queries alone.

Fingerprints that are near name candidates but not all pairs of similar texts.  `near_duplicates` therefore compares all texts
that share one of their first shingles in a common order, which every pair with the wanted Jaccard similarity does.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage
from .common import broadcast_up_to, cut_and_count, row_udf, text_bytes
from .components import components

BITS = 64
SHARD = 4096  # fingerprints of one tree
PARITY = 1024  # bits that bound how far two sets of shingles are apart
FOLDED = 4  # 64-bit numbers that those bits are laid over each other to, for a first look at a pair
RECENT = 3  # earlier shared shingles of a text that tell whether a pair has met before
FIRST = 4  # first shingles of a text whose lists are compared neighbour by neighbour
SAMPLE_TEXTS, FREQUENT = 10_000, 100_000  # texts that tell the frequent shingles, and how many of those are told
KNOWN_WORDS = 500_000  # hashes of words that a task remembers


def majority_bits(digests: bytes, width: int, n: int) -> bytes:
    """A bit is 1 where over half of n hashes of `width` bytes have it."""
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(n, width), axis=1)
    return np.packbits(2 * bits.sum(0, dtype=np.int64) > n).tobytes()


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """Runs of `width` words, repeats included; the whole sequence if it is shorter, nothing without words."""
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(width)))]


def fingerprint(text_col: str = "text", width: int = 3, seed: int = 42) -> Column:
    """64 bits (as a signed long) over the word shingles of the whole text with A-Z in lower case; zero without words."""

    def run(texts: list[bytes]) -> dict:
        import xxhash

        digest, out = xxhash.xxh64_digest, []
        for data in texts:
            parts = shingles(data.lower().split(), width)
            out.append(int.from_bytes(majority_bits(b"".join([digest(s, seed) for s in parts]), 8, len(parts)), "big", signed=True) if parts else 0)
        return {"fp": out}

    return row_udf(run, "fp bigint")(text_bytes(text_col)).getField("fp")


def word_fingerprints(text_col: str = "text", pairs: int = 5, least_bytes: int = 4) -> Column:
    """2 * `pairs` independent fingerprints over the distinct words of `least_bytes` bytes or more (all words if there is
    none).  A changed word moves them far less than it moves shingles, so small radii find texts that are 80 % alike."""

    def run(texts: list[bytes]) -> dict:
        import xxhash

        digest, out = xxhash.xxh3_128_digest, []
        for data in texts:
            words = set(data.lower().split())
            words = sorted({w for w in words if len(w) >= least_bytes} or words)
            if not words:
                out.append([0] * (2 * pairs))
                continue
            bits = b"".join(majority_bits(b"".join([digest(w, s) for w in words]), 16, len(words)) for s in range(pairs))
            out.append(np.frombuffer(bits, ">i8").astype(np.int64))
        return {"fps": out}

    return row_udf(run, "fps array<bigint>")(text_bytes(text_col)).getField("fps")


class BKTree:
    """Integers below 2 ** 64; a child hangs on its parent by their Hamming distance."""

    def __init__(self):
        self.root = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while True:
            distance = (node[0] ^ value).bit_count()
            following = node[1].get(distance)
            if following is None:
                node[1][distance] = (value, {})
                return
            node = following

    def within(self, value: int, radius: int) -> list[tuple[int, int]]:
        """(distance, value) of the nodes within the radius: only edges between distance - radius and distance + radius are
        followed, since the distance is a metric."""
        found, open_nodes = [], [self.root] if self.root else []
        while open_nodes:
            node_value, children = open_nodes.pop()
            distance = (node_value ^ value).bit_count()
            if distance <= radius:
                found.append((distance, node_value))
            for edge, child in children.items():
                if distance - radius <= edge <= distance + radius:
                    open_nodes.append(child)
        return found


def _root(parent: dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def search_shard(tree_part: list[int], query_part: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links that join what the radius joins: each fingerprint is linked to its nearest match in every group of matches that
    is not yet linked to it.  Fewer links than fingerprints, not all pairs.  Without a query part the tree part is searched
    with itself."""
    tree, parent, links = BKTree(), {}, []

    def join(value: int) -> None:
        parent.setdefault(value, value)
        for _, other in sorted(tree.within(value, radius)):
            x, y = _root(parent, value), _root(parent, other)
            if x != y:
                parent[x] = y
                links.append((other, value))

    for value in tree_part:
        if query_part is None:
            join(value)
        tree.add(value)
        parent.setdefault(value, value)
    for value in query_part or ():
        join(value)
    return links


def shard_keys(fp: str, family: str, radius: int) -> Column:
    """One key for every pair of blocks: family and number of the pair above the bits of both blocks."""
    n = radius + 2
    edges = [round(BITS * i / n) for i in range(n + 1)]
    keys = []
    for number, (i, j) in enumerate(combinations(range(n), 2)):
        part = [F.shiftrightunsigned(fp, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1)) for k in (i, j)]
        width = edges[j + 1] - edges[j]
        above = F.shiftleft((F.col(family) * (n * n) + number).cast("bigint"), 2 * (BITS // n + 1))
        keys.append(above.bitwiseOR(F.shiftleft(part[0], width)).bitwiseOR(part[1]))
    return F.array(*keys)


def link_fingerprints(prints: DataFrame, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """(family, a, b): links between distinct fingerprints of a family that differ in at most `radius` bits.

    `prints` has distinct rows (family int, fp bigint).  Links are not all pairs, but what can be reached over pairs
    within the radius can be reached over them.  Work in a shard part is bounded by `shard` fingerprints on either side; a
    shard of g parts is searched in g (g + 1) / 2 tasks.
    """
    keyed = prints.select("family", "fp", F.explode(shard_keys("fp", "family", radius)).alias("key"))
    # Most keys are single; the shared ones are few enough to be sent to the fingerprints, or else both sides meet in a shuffle.
    sizes, n = cut_and_count(keyed.groupBy("key").count().where("count > 1"))
    shared = keyed.join(broadcast_up_to(sizes, n), "key")
    parts = F.ceil(F.col("count") / shard).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    dealt = shared.select("family", "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    dealt = dealt.select("family", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own", F.xxhash64("key", "fp"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def links():
            family, _, i, j = group
            tree_part = [v & (2**64 - 1) for o, v in rows if o == i]
            query_part = None if i == j else [v & (2**64 - 1) for o, v in rows if o == j]
            signed = lambda v: v - 2**64 if v >> 63 else v
            return [(family, signed(a), signed(b)) for a, b in search_shard(tree_part, query_part, radius)]

        def batch(found):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), *(pa.array([x[k] for x in found], pa.int64()) for k in (1, 2))], ["family", "a", "b"])

        for b in batches:
            found = []
            for family, key, i, j, own_part, fp in zip(*(c.to_pylist() for c in b.columns)):
                if (family, key, i, j) != group:
                    if len(rows) > 1:
                        found += links()
                    group, rows = (family, key, i, j), []
                rows.append((own_part, fp))
            yield batch(found)
        if len(rows) > 1:
            yield batch(links())

    return dealt.mapInArrow(search, "family int, a bigint, b bigint")


def group_fingerprints(prints: DataFrame, id_col: str, fp_col: str, radius: int = 3) -> DataFrame:
    """`prints` with `component_id`: the smallest id reachable over fingerprints that differ in at most `radius` bits.

    Equal fingerprints are one node, so exact copies cost one row.  Null ids are smaller than none: they get the smallest
    non-null id of their component, or null if there is none.  Rows may repeat; an input column named `component_id` is
    replaced; an empty table gives an empty table.
    """
    first = cut_lineage(prints.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("first")))
    links = link_fingerprints(first.select(F.lit(0).alias("family"), "fp"), radius)
    found = components(links)
    known = first.join(found, first.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("first").alias("__least"))
    classes = cut_lineage(known.join(least, "root").select(F.col("fp").alias("__fp"), "__least"))
    kept = [F.col(f"`{c}`") for c in prints.columns if c.lower() != "component_id"]
    return prints.join(classes, F.col(fp_col) == F.col("__fp")).select(*kept, F.col("__least").alias("component_id"))


def jaccard(a: str, b: str, width: int = 5) -> Column:
    """Share of distinct word shingles that two texts have in common; 1 for two texts without words."""

    def run(left: list[bytes], right: list[bytes]) -> dict:
        out = []
        for x, y in zip(left, right):
            s, t = set(shingles(x.lower().split(), width)), set(shingles(y.lower().split(), width))
            both = len(s & t)
            out.append(both / (len(s) + len(t) - both) if s or t else 1.0)
        return {"j": out}

    return row_udf(run, "j double")(text_bytes(a), text_bytes(b)).getField("j")


def shingle_hashes(words: list[bytes], width: int, known: dict[bytes, int]) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles; `known` keeps the hashes of words between calls."""
    import xxhash

    if len(known) > KNOWN_WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w, 5)
    at = np.array([known[w] for w in words], np.uint64)
    size = min(width, len(at))
    total = np.full(len(at) - size + 1 if size else 0, size, np.uint64)
    for k in range(size):
        total = (total ^ at[k : k + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return np.unique(total.view(np.int64))


def frequent_shingles(docs: DataFrame, text_col: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, levels) of shingles that are frequent in a bounded sample of texts.  They only say which shingles come
    last in the order of all shingles; any order finds the same pairs."""
    share = min(1.0, SAMPLE_TEXTS / max(1, docs.count()))
    picked = docs.select(text_bytes(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).distinct()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            parts = [shingle_hashes(t.lower().split(), width, known) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*parts, np.empty(0, np.int64)]))], ["key"])

    counts = picked.mapInArrow(emit, "key bigint").groupBy("key").count().where("count > 2")
    found = counts.orderBy(F.desc("count"), "key").limit(FREQUENT).toPandas().sort_values("key")
    return found["key"].to_numpy(np.int64), np.floor(np.log2(found["count"].to_numpy(float))).astype(np.int64)


def shingle_sets(text_col: str, width: int, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> Column:
    """`n` distinct shingles of a text; `whole`, the same for equal sets; `parity`, PARITY bits, of which two sets differ in no
    more than the members they do not share; `prefix`, the first shingles in an order common to all texts, so many that sets
    with the similarity have one of them in common."""
    hot, levels = frequent

    def run(texts: list[bytes]) -> dict:
        out: dict = {"n": [], "whole": [], "parity": [], "prefix": []}
        known: dict[bytes, int] = {}
        for data in texts:
            keys = shingle_hashes(data.lower().split(), width, known)
            n = len(keys)
            odd = np.bincount((keys & (PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
            level = np.zeros(n, np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
                level = np.where(hot[at] == keys, levels[at], 0)
            first = keys[np.argsort(level, kind="stable")][: n - math.ceil(similarity * n - 1e-9) + 1] if n else keys
            out["n"].append(n)
            out["whole"].append(hashlib.md5(keys.tobytes()).digest())
            out["parity"].append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            out["prefix"].append(first)
        return out

    return row_udf(run, "n int, whole binary, parity array<bigint>, prefix array<bigint>")(text_bytes(text_col))


def folded(parity: str) -> Column:
    """FOLDED numbers of the parity bits, laid over each other: two sets differ in no more of these bits than of all."""
    words = PARITY // 64
    return F.array(*[reduce(lambda a, b: a.bitwiseXOR(b), [F.get(parity, F.lit(i)) for i in range(k, words, FOLDED)]) for k in range(FOLDED)])


def prefix_pairs(shared: DataFrame, classes: DataFrame, similarity: float, part_rows: int = SHARD, marks: DataFrame | None = None) -> DataFrame:
    """(u, v), u < v: texts of different classes with a shingle in common that can be the first common one of two sets with
    the similarity, judged by their sizes, the places of the shingle and their marks, before a pair is written anywhere.
    `shared` has (key, no, n, pos), `classes` (no, root), `marks` (no, m), m the `folded` parity; without marks these are not judged.

    Every two texts of a list of equal shingles meet; a list of over `part_rows` rows is cut into g parts and searched in
    g (g + 1) / 2 tasks.  Lists within one class are left out.  A pair with several shingles in common is not written for one
    that has another common one among the RECENT shared shingles before it in both texts: the pair met in that list, where
    its places were smaller still.
    """
    before = [F.coalesce(F.lag("key", k).over(W.partitionBy("no").orderBy("pos")), F.lit(0).cast("bigint")).alias(f"before{k}") for k in range(1, RECENT + 1)]
    earlier = [f"before{k}" for k in range(1, RECENT + 1)]
    keyed = shared.join(classes, "no", "left").select("key", "no", "n", "pos", F.coalesce("root", "no").alias("root"), *before)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key", "rows")
    parts = F.ceil(F.col("rows") / part_rows).cast("int")
    own = F.pmod(F.xxhash64("no"), parts).cast("int")
    mark = [(F.get("m", F.lit(k)) if marks is not None else F.lit(0).cast("bigint")).alias(f"m{k}") for k in range(FOLDED)]
    listed = keyed.join(sizes, "key")
    listed = listed.join(marks, "no") if marks is not None else listed
    dealt = listed.select("key", "no", "n", "pos", "root", *earlier, *mark, own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "no", "n", "pos", "root", *earlier, *[f"m{k}" for k in range(FOLDED)])
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    weight = similarity / (1 + similarity)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(i, j, rows):
            own, no, n, pos, root, *more = np.array(rows, np.int64).T
            met, bits = np.column_stack(more[:RECENT]), more[RECENT:]
            bits = np.ascontiguousarray(np.column_stack(bits)).view(np.uint64)
            queries, others = np.flatnonzero(own == i), np.flatnonzero(own == j)
            for k, a in enumerate(queries.tolist()):
                b = others[k + 1 :] if i == j else others
                common = np.ceil(weight * (n[a] + n[b]) - 1e-9)
                fits = (root[b] != root[a]) & (pos[a] <= n[a] - common) & (pos[b] <= n[b] - common)
                b, common = b[fits], common[fits]
                known = ((met[b][:, :, None] == met[a]) & (met[a] != 0)).any(axis=(1, 2))
                b, common = b[~known], common[~known]
                apart = np.bitwise_count(bits[b] ^ bits[a]).sum(axis=1)
                b = b[apart <= n[a] + n[b] - 2 * common]
                if len(b):
                    yield np.minimum(no[a], no[b]), np.maximum(no[a], no[b])

        group, rows, found, size = None, [], [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], ["u", "v"])

        for b in itertools.chain(batches, [None]):
            for key, i, j, *row in zip(*(c.to_pylist() for c in b.columns)) if b is not None else [(None, 0, 0)]:
                if (key, i, j) != group:
                    if len(rows) > 1:
                        for f in pairs(*group[1:], rows):
                            found.append(f)
                            size += len(f[0])
                            if size > 100_000:
                                yield batch()
                                found, size = [], 0
                    group, rows = (key, i, j), []
                rows.append(row)
        if found:
            yield batch()

    return dealt.mapInArrow(search, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, width: int = 5,
                    radius: int = 3, pairs: int = 5) -> DataFrame:
    """(id, component_id) for every row: texts whose `width`-word shingles have a Jaccard similarity of `similarity` or more,
    linked transitively; a component is named by its smallest id.

    Every pair with the similarity is linked or lies within one component.  First, texts with fingerprints over words
    (2 * `pairs` families) within `radius` in one family, texts with equal sets of shingles and neighbours in lists of rare
    shingles are compared, which joins most copies at a cost linear in the size of a group.  Then all pairs that are not yet
    joined and share one of the first shingles of both texts, in an order from rare to frequent, are compared: sets with the
    similarity always share one.  Each candidate is checked exactly.  Equal texts are one node.  Texts without words are alike.
    A null text counts as empty, a null id as larger than every id; each distinct pair of id and text gives one row.
    """
    ids, classes = _classes(docs, id_col, text_col, similarity, width, radius, pairs)
    return ids.join(classes, "node").select("id", "component_id")


def _text_key(text_col: str) -> Column:
    """128 bits for each text, the same for texts with the same words."""
    return F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def _classes(docs, id_col, text_col, similarity, width, radius, pairs) -> tuple[DataFrame, DataFrame]:
    """(id, node, n) for each distinct id and text, and (node, component_id, keeper) for each distinct text."""
    rows = docs.select(F.col(id_col).alias("id"), _text_key(text_col).alias("node"), F.col(text_col).alias("text"))
    sets = shingle_sets("text", width, similarity, frequent_shingles(docs, text_col, width))
    prints = cut_lineage(rows.select("id", "node", word_fingerprints("text", pairs).alias("fps"), sets.alias("set")).select("id", "node", "fps", "set.*"))
    ids = cut_lineage(prints.groupBy("id", "node").agg(F.count("*").alias("n")))
    held = F.any_value(F.struct("fps", "n", "whole", "parity")).alias("held")
    nodes = prints.groupBy("node").agg(F.min("id").alias("first"), held).select("node", "first", "held.*", F.monotonically_increasing_id().alias("no"))
    nodes = cut_lineage(nodes)
    families = nodes.select("no", F.posexplode("fps").alias("family", "fp"))
    named = cut_lineage(families.groupBy("family", "fp").agg(F.min("no").alias("name")))
    links = link_fingerprints(named.select("family", "fp"), radius)
    a = named.select("family", F.col("fp").alias("a"), F.col("name").alias("u"))
    b = named.select("family", F.col("fp").alias("b"), F.col("name").alias("v"))
    between = links.join(a, ["family", "a"]).join(b, ["family", "b"]).select("u", "v")
    within = families.join(named, ["family", "fp"]).where("no <> name").select(F.col("name").alias("u"), F.col("no").alias("v"))
    # One text stands for all with its set of shingles.
    wholes, n_wholes = cut_and_count(nodes.groupBy("whole").agg(F.min("no").alias("name"), F.min_by("node", "no").alias("node"), F.min_by("first", "no").alias("id")))
    equal = nodes.join(wholes.select("whole", "name"), "whole").where("no <> name").select(F.col("name").alias("u"), F.col("no").alias("v"))
    standing = wholes.select("node", "id", F.col("name").alias("no"))
    on = (prints.node == standing.node) & prints.id.eqNullSafe(standing.id)
    posted = prints.join(broadcast_up_to(standing, n_wholes), on).select("no", "n", F.posexplode("prefix").alias("pos", "key"))
    # One sort of each list: the first shingles of the texts stand before the others, each beside the next longer text.
    listed = W.partitionBy("key").orderBy(F.col("pos") >= FIRST, "n", "no")
    following = F.lead(F.struct("no", "pos")).over(listed)
    shared = posted.withColumn("rows", F.count("*").over(W.partitionBy("key"))).withColumn("next", following).where("rows > 1")
    beside = F.when((F.col("pos") < FIRST) & (F.col("next.pos") < FIRST), F.col("next.no"))
    shared = cut_lineage(shared.select("key", "no", "n", "pos", beside.alias("beside")))
    chained = shared.where("beside is not null").select(F.col("no").alias("u"), F.col("beside").alias("v"))
    near, alike = _compared(between.union(within).union(equal).union(chained), nodes, rows, similarity, width)
    found = components(alike, "u", "v")
    rest = prefix_pairs(shared, found.select(F.col("node").alias("no"), "root"), similarity, marks=nodes.select("no", folded("parity").alias("m")))
    _, more = _compared(rest.join(near, ["u", "v"], "left_anti"), nodes, rows, similarity, width)
    if not more.isEmpty():
        found = components(alike.union(more), "u", "v")
    known = nodes.join(found.select(F.col("node").alias("no"), "root"), "no", "left").select("node", "first", F.coalesce("root", "no").alias("root"))
    best = known.groupBy("root").agg(F.min("first").alias("component_id"), F.min(F.struct(F.col("first").isNull(), "first", "node")).getField("node").alias("keeper"))
    return ids, cut_lineage(known.join(best, "root").select("node", "component_id", "keeper"))


def _compared(candidates: DataFrame, nodes: DataFrame, rows: DataFrame, similarity: float, width: int) -> tuple[DataFrame, DataFrame]:
    """(u, v) of the candidates whose sizes and parities allow the similarity, and those of them whose texts have it."""
    candidates = candidates.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    u = nodes.select(F.col("no").alias("u"), F.col("n").alias("nu"), F.col("parity").alias("pu"))
    v = nodes.select(F.col("no").alias("v"), F.col("n").alias("nv"), F.col("parity").alias("pv"))
    apart = F.aggregate(F.zip_with("pu", "pv", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    both = F.col("nu") + F.col("nv")
    allowed = both - 2 * F.ceil(both * (similarity / (1 + similarity)) - 1e-9)
    near = cut_lineage(candidates.join(u, "u").join(v, "v").where((F.abs(F.col("nu") - F.col("nv")) <= allowed) & (apart <= allowed)).select("u", "v"))
    ends, n = cut_and_count(near.select(F.col("u").alias("no")).union(near.select(F.col("v").alias("no"))).distinct())
    wanted = cut_lineage(broadcast_up_to(ends, n).join(nodes, "no").select("no", F.col("node").alias("wanted"), F.col("first").alias("wanted_id")))
    same = (rows.node == wanted.wanted) & rows.id.eqNullSafe(wanted.wanted_id)
    texts = rows.join(broadcast_up_to(wanted, n), same).select("no", "text").dropDuplicates(["no"])
    x = texts.select(F.col("no").alias("u"), F.col("text").alias("tu"))
    y = texts.select(F.col("no").alias("v"), F.col("text").alias("tv"))
    alike = near.join(x, "u").join(y, "v").select("u", "v", jaccard("tu", "tv", width).alias("j")).where(F.col("j") >= similarity)
    return near, cut_lineage(alike.select("u", "v"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, width: int = 5,
                         radius: int = 3, pairs: int = 5) -> DataFrame:
    """One row of each class of `near_duplicates`, with all its columns: the one with the smallest id (a null id last)."""
    ids, classes = _classes(docs, id_col, text_col, similarity, width, radius, pairs)
    keepers = classes.where("node = keeper").select(F.col("node").alias("__node"))
    kept_id = ids.join(keepers, ids.node == keepers["__node"]).groupBy("node").agg(
        F.min(F.struct(F.col("id").isNull().alias("last"), "id", "n")).alias("m"))
    kept_id = cut_lineage(kept_id.select(F.col("node").alias("__node"), F.col("m.id").alias("__id"), F.col("m.n").alias("__n")))
    lost, n_lost = cut_and_count(ids.join(kept_id, (ids.node == kept_id["__node"]) & ids.id.eqNullSafe(kept_id["__id"]), "left_anti").select(
        F.col("node").alias("__node"), F.col("id").alias("__id")))
    keyed = docs.withColumn("__key", _text_key(text_col))
    on = lambda small: (F.col("__key") == small["__node"]) & F.col(id_col).eqNullSafe(small["__id"])
    kept = keyed.join(broadcast_up_to(lost, n_lost), on(lost), "left_anti")
    again, n_again = cut_and_count(kept_id.where("__n > 1"))  # rows that repeat an id and its text
    if n_again:
        marked = broadcast_up_to(again, n_again)
        single = kept.join(marked, on(again), "left_anti")
        kept = single.unionByName(kept.join(marked, on(again), "left_semi").dropDuplicates([id_col, "__key"]))
    return kept.drop("__key")
