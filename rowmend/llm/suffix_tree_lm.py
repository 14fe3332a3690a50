"""Language-model scoring with a probabilistic suffix tree, and the token counts of a unigram model beside it.

The tree's symbols are the bytes of a text (words in order, joined by single spaces, then an end symbol), so it gives every
text a probability.  A context is a run of up to `depth` preceding symbols.  It becomes a state if its next-symbol
distribution diverges from that of its longest proper suffix, on enough evidence; a symbol is scored in the state of the
longest suffix of what precedes it.

Counts, states and distributions are Spark tables that grow with the corpus; no task and no driver holds the tree.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import result_folder
from .common import stored, text_bytes

BOUNDARY = 255  # never part of UTF-8: stands before the first symbol and after the last
END = b"\xff"  # the end of a text, counted as a token
CHUNK = 2_000_000  # symbols that a task holds as grams before it reduces them
SHORT = 2  # symbols of a context that is short
TASK_GRAMS = 300_000  # grams that a task works on at once, beside those of one shard
HOT_KEYS = 1_000_000  # tokens and grams that most blocks ask for: their answers are sent to all tasks instead of once a block
BLOCK_TOKENS, BLOCK_SYMBOLS = 3_000_000, 20_000_000  # a block of texts that asks once for what its texts share ends with one of these


def words_of(data: bytes) -> list[bytes]:
    return data.lower().split()


def symbols(words: list[bytes], depth: int) -> np.ndarray:
    """`depth` boundary symbols, the bytes of the text, one boundary symbol."""
    edge = bytes([BOUNDARY])
    return np.frombuffer(edge * depth + b" ".join(words) + edge, np.uint8)


def grams(seq: np.ndarray, depth: int) -> Iterator[np.ndarray]:
    """Each symbol with the `depth` before it as one integer, the symbol itself in the lowest byte; CHUNK symbols at a time."""
    for a in range(0, len(seq) - depth, CHUNK):
        n = min(CHUNK, len(seq) - depth - a)
        out = np.zeros(n, np.int64)
        for k in range(a, a + depth + 1):
            out = (out << 8) | seq[k : k + n]
        yield out


def token_keys(words: list[bytes]) -> np.ndarray:
    """63-bit hashes of tokens as negative numbers; grams are never negative."""
    import xxhash

    return (np.array([xxhash.xxh64_intdigest(w, 3) for w in words], np.uint64) | np.uint64(1 << 63)).view(np.int64)


class GramCounts:
    """Distinct grams of the texts of a block with their number in training texts."""

    def __init__(self):
        self.keys, self.n = np.empty(0, np.int64), np.empty(0, np.int64)
        self.fresh: tuple[list, list] = ([], [])  # of held-out and of training texts
        self.size = 0

    def add(self, part: np.ndarray, training: bool) -> None:
        self.fresh[training].append(part)
        self.size += len(part)
        if self.size >= CHUNK:
            self.reduce()

    def reduce(self) -> None:
        keys, n = [self.keys], [self.n]
        for training, parts in enumerate(self.fresh):
            if parts:
                seen, times = np.unique(np.concatenate(parts), return_counts=True)
                keys.append(seen)
                n.append(times * training)
        self.keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        self.n = np.bincount(at, np.concatenate(n).astype(float), len(self.keys)).astype(np.int64)
        self.fresh, self.size = ([], []), 0


def _blocks(docs: DataFrame, id_col: str, held: Column, text_col: str, depth: int) -> DataFrame:
    """One row per text (`text`: its words in lower case, joined by spaces) and one per distinct key of a block, a token or a
    gram, with its number in training texts.  A block is what a task reads until it has BLOCK_TOKENS tokens or BLOCK_SYMBOLS
    symbols; its number is stored with the rows, so later stages need not cut the texts in the same way again."""
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held"), text_bytes(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId() << 24, 0
        names, types = ["block", "id", "held", "text", "key", "n"], [pa.int64(), None, pa.bool_(), pa.binary(), pa.int64(), pa.int64()]
        tokens: Counter = Counter()
        counts = GramCounts()
        size = length = 0

        def batch_of(size: int, /, **columns) -> pa.RecordBatch:
            columns["block"] = np.full(size, task + number)
            arrays = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in zip(names, types)]
            return pa.RecordBatch.from_arrays(arrays, names)

        def keys_of_block() -> Iterator[pa.RecordBatch]:
            counts.reduce()
            hashed = token_keys(list(tokens))
            order = np.argsort(hashed)
            keys = np.concatenate([hashed[order], counts.keys])
            n = np.concatenate([np.fromiter(tokens.values(), np.int64, len(tokens))[order], counts.n])
            for a in range(0, len(keys), 100_000):
                yield batch_of(len(keys[a : a + 100_000]), key=keys[a : a + 100_000], n=n[a : a + 100_000])

        for batch in batches:
            types[1] = batch.schema.field(0).type
            ids, helds, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            start, normal = 0, []
            for k, data in enumerate(texts):
                words, training = words_of(data), not helds[k].as_py()
                seq = symbols(words, depth)
                for part in grams(seq, depth):
                    counts.add(part, training)
                normal.append(b" ".join(words))
                words.append(END)
                if training:
                    tokens.update(words)
                else:
                    for w in set(words):
                        tokens.setdefault(w, 0)
                size, length = size + len(words), length + len(seq)
                if size >= BLOCK_TOKENS or length >= BLOCK_SYMBOLS:
                    yield batch_of(k + 1 - start, id=ids.slice(start, k + 1 - start), held=helds.slice(start, k + 1 - start), text=normal)
                    yield from keys_of_block()
                    start, normal, tokens, counts, size, length, number = k + 1, [], Counter(), GramCounts(), 0, 0, number + 1
            if normal:
                yield batch_of(len(normal), id=ids.slice(start), held=helds.slice(start), text=normal)
        if tokens:
            yield from keys_of_block()

    return rows.mapInArrow(emit, f"block bigint, id {kind}, held boolean, text binary, key bigint, n bigint")


def long_contexts(rows: DataFrame, depth: int, least_count: int, least_divergence: float, least_gain: float, prior: float) -> DataFrame:
    """(gram, a, b, deep): the probability of a gram is a + b times that of the same symbol after its last SHORT symbols; `deep`
    if the context of SHORT + 1 symbols is a state.  `rows` has (gram, n, m, whole), m and whole the counts of the gram's last
    SHORT + 1 symbols and of the SHORT before the last.

    Contexts with the same last SHORT + 1 symbols and their suffixes down to these stand in one task, so one shuffle does for
    all lengths; that are at most 256^3 grams of depth 5, whatever the corpus.
    """

    def learn(gram: np.ndarray, n: np.ndarray, m: np.ndarray, whole: np.ndarray) -> tuple:
        low = lambda x, k: x & np.int64((1 << 8 * k) - 1)
        keys, count, at = {depth: gram}, {depth: n}, {}
        for k in range(depth, SHORT + 1, -1):
            keys[k - 1], at[k] = np.unique(low(keys[k], k), return_inverse=True)
            count[k - 1] = np.bincount(at[k], count[k].astype(float), len(keys[k - 1]))
        first = np.unique(low(gram, SHORT + 2), return_index=True)[1]
        run, total, chosen, contexts = {}, {}, {}, {}
        for k in range(SHORT + 1, depth + 1):
            contexts[k], run[k] = np.unique(keys[k] >> 8, return_inverse=True)
            sums = np.bincount(run[k], count[k], len(contexts[k]))
            total[k] = sums[run[k]]
            up, above = (m[first], whole[first]) if k == SHORT + 1 else (count[k - 1][at[k]], total[k - 1][at[k]])
            seen = count[k] > 0
            ratio = np.log(count[k][seen] / total[k][seen] * above[seen] / up[seen])
            gain = np.bincount(run[k][seen], count[k][seen] * ratio, len(contexts[k]))
            chosen[k] = (sums > 0) & (sums >= least_count) & (gain >= least_gain) & (gain >= sums * least_divergence)
        for k in range(depth, SHORT + 1, -1):
            chosen[k - 1][np.searchsorted(contexts[k - 1], low(contexts[k][chosen[k]], k - 1))] = True
        a, b = np.zeros(len(keys[SHORT + 1])), np.ones(len(keys[SHORT + 1]))
        deep = chosen[SHORT + 1][run[SHORT + 1]]
        for k in range(SHORT + 1, depth + 1):
            if k > SHORT + 1:
                a, b, deep = a[at[k]], b[at[k]], deep[at[k]]
            state = chosen[k][run[k]]
            a = np.where(state, (count[k] + prior * a) / (total[k] + prior), a)
            b = np.where(state, prior * b / (total[k] + prior), b)
        return gram, a, b, deep

    def in_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table) -> pa.RecordBatch:
            gram, n, m, whole = (table.column(c).to_numpy() for c in ("gram", "n", "m", "whole"))
            order = np.argsort(gram)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in learn(*(x[order] for x in (gram, n.astype(float), m, whole)))], ["gram", "a", "b", "deep"])

        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size >= TASK_GRAMS:  # all but the last shard are whole
                table = pa.Table.from_batches(waiting)
                shard = table.column("shard").to_numpy()
                cut = int(np.searchsorted(shard, shard[-1]))
                if cut:
                    yield done(table.slice(0, cut))
                waiting = table.slice(cut).to_batches()
                size = size - cut if cut else 0
        if waiting:
            yield done(pa.Table.from_batches(waiting))

    shard = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * (SHORT + 1)) - 1))
    dealt = rows.select(shard.alias("shard"), "gram", "n", "m", "whole").repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(in_tasks, "gram bigint, a double, b double, deep boolean")


def gram_scores(counts: DataFrame, depth: int = 5, least_count: int = 50, least_divergence: float = 0.01, least_gain: float = 10.0,
                prior: float = 20.0) -> DataFrame:
    """(gram, value) for every row of `counts` (gram, n): log10 of the probability of a gram's last symbol after the others.

    `n` is the number of the gram in training texts; grams to be scored that these lack have n = 0.  A context becomes a state if
    it precedes at least `least_count` symbols and the divergence of its distribution from that of its longest proper suffix
    is at least `least_divergence` nats and, times its count, at least `least_gain`; suffixes of states are states too.  None of
    these tests depends on the size of the corpus.  Distributions are smoothed towards the suffix with the weight of
    `prior` symbols, the root's by one count for each of 256 symbols.

    A gram without its first symbol is the key of the same symbol after the suffix.  Contexts of up to SHORT symbols have
    few grams, and every step is an equi-join of two lengths; `long_contexts` does the others.
    """
    if not SHORT < depth <= 6:
        raise ValueError(f"depth must be {SHORT + 1} to 6")
    context = F.shiftright("gram", 8)
    suffix = lambda k: F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
    levels = {}
    for k in range(SHORT, -1, -1):
        own = (counts if k == SHORT else levels[k + 1]).groupBy(suffix(k + 1).alias("gram")).agg(F.sum("n").alias("n"))
        levels[k] = stored(own.withColumn("all", F.sum("n").over(W.partitionBy(context))), f"grams-{k}")
    of = levels[SHORT].select(F.col("gram").alias("tail"), F.col("n").cast("double").alias("m"), F.col("all").cast("double").alias("whole"))
    rows = counts.select("gram", "n", suffix(SHORT + 1).alias("tail")).join(of, "tail")
    linear = stored(long_contexts(rows, depth, least_count, least_divergence, least_gain, prior), "long-contexts")
    longer = linear.where("deep").select(context.bitwiseAND(F.lit((1 << 8 * SHORT) - 1)).alias("context"))
    states: dict[int, DataFrame] = {}
    for k in range(SHORT, 0, -1):
        own = levels[k].where((F.col("n") > 0) & (F.col("all") >= least_count)).withColumn("suffix", suffix(k))
        below = levels[k - 1].select(F.col("gram").alias("suffix"), F.col("n").alias("m"), F.col("all").alias("whole"))
        ratio = (F.col("n") / F.col("all")) / (F.col("m") / F.col("whole"))
        gain = own.join(below, "suffix").groupBy(context.alias("context")).agg(F.sum(F.col("n") * F.ln(ratio)).alias("gain"), F.first("all").alias("all"))
        chosen = gain.where((F.col("gain") >= least_gain) & (F.col("gain") >= F.col("all") * least_divergence)).select("context")
        states[k] = stored(chosen.union(longer).distinct(), f"states-{k}")
        longer = states[k].select(F.col("context").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)).alias("context"))
    chance = levels[0].select("gram", ((F.col("n") + 1) / (F.col("all") + 256)).alias("p"))
    for k in range(1, SHORT + 1):
        own = levels[k].select("gram", "n", "all", suffix(k).alias("suffix"), context.alias("context"))
        own = own.join(chance.withColumnRenamed("gram", "suffix"), "suffix").join(states[k].withColumn("state", F.lit(True)), "context", "left")
        chance = own.select("gram", F.when(F.col("state"), (F.col("n") + prior * F.col("p")) / (F.col("all") + prior)).otherwise(F.col("p")).alias("p"))
    chance = stored(chance.withColumnRenamed("gram", "tail"), "short-contexts")
    return linear.select("gram", "a", "b", suffix(SHORT + 1).alias("tail")).join(chance, "tail").select("gram", F.log10(F.col("a") + F.col("b") * F.col("p")).alias("value"))


def score_texts(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = 5, **tree_options) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs`.

    The model learns from the rows where `held` is false (or null).  Tokens are the words (separated by ASCII white space, A-Z in lower
    case) and one end per text.  `base_score` sums log10((c + 1) / (N + V + 1)) over the tokens, with c the training count of
    a token, N of all tokens, V the number of distinct ones; `n_known` counts tokens with c > 0.  `score` is the log10
    probability of the text under the suffix tree (`gram_scores`; `depth` is 6 at most).  A null text is empty: one token, the end.
    Rows may repeat; only the named columns are read; without training rows N and V are 0.  An empty table gives an empty table.

    Texts are cut into blocks.  A block asks once for each distinct token and gram of its texts; the requests, summed over
    the blocks, are the counts that the model learns from; they are joined with what it says, and the answers meet the block's texts.
    Answers that most blocks want, at most HOT_KEYS, are sent to all tasks; that changes only the cost.
    """
    spark = docs.sparkSession
    folder = result_folder(spark, "blocks")
    _blocks(docs, id_col, F.coalesce(held, F.lit(False)), text_col, depth).write.option("compression", "zstd").parquet(folder)
    asked = spark.read.parquet(folder).where(F.col("key").isNotNull()).select("block", "key", "n")
    counts = stored(asked.groupBy("key").agg(F.sum("n").alias("n"), F.floor(F.log2(F.count("*")) * 16).cast("int").alias("often")), "counts")
    tokens = counts.where(F.col("key") < 0)
    n, v = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    scored = gram_scores(counts.where(F.col("key") >= 0).select(F.col("key").alias("gram"), "n"), depth, **tree_options)
    values = stored(tokens.select("key", F.col("n").cast("double").alias("value")).union(scored.select(F.col("gram").alias("key"), "value")), "values")
    hot, least = 0, 1 << 30
    for often, keys in counts.where("often > 0").groupBy("often").count().orderBy(F.desc("often")).collect():  # 16 rows for each doubling of the blocks
        if hot + keys > HOT_KEYS:
            break
        hot, least = hot + keys, often
    hot_keys = F.broadcast(counts.where(F.col("often") >= least).select("key"))  # at most HOT_KEYS rows
    known = values.join(hot_keys, "key", "left_semi").sort("key").toArrow()
    sent = spark.sparkContext.broadcast((known.column("key").to_numpy(), known.column("value").to_numpy()))
    answers = asked.select("block", "key").join(hot_keys, "key", "left_anti").join(values, "key").select("block", "key", "value")
    texts = spark.read.parquet(folder).where(F.col("key").isNull()).select("block", "id", "held", "text")
    kind = texts.schema["id"].dataType.simpleString()

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, value = (np.concatenate([a, right.column(c).to_numpy()]) for a, c in zip(sent.value, ("key", "value")))
        order = np.argsort(keys)
        keys, value = keys[order], value[order]
        vocabulary: dict[bytes, int] = {}
        numbers, score = [], []
        for data in left.column("text").to_pylist():
            words = words_of(data)
            total = 0.0
            for part in grams(symbols(words, depth), depth):
                seen, times = np.unique(part, return_counts=True)
                total += float(times @ value[np.searchsorted(keys, seen)])
            score.append(total)
            words.append(END)
            numbers.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int32))
        count = value[np.searchsorted(keys, token_keys(list(vocabulary)))]
        weight, seen = np.log10(count + 1), count > 0
        return pa.table({
            "id": left.column("id"), "held": left.column("held"), "n_tokens": pa.array([len(t) for t in numbers], pa.int64()),
            "n_known": pa.array([int(seen[t].sum()) for t in numbers], pa.int64()), "total": pa.array([float(weight[t].sum()) for t in numbers], pa.float64()),
            "score": pa.array(score, pa.float64())})

    done = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        look_up, f"id {kind}, held boolean, n_tokens bigint, n_known bigint, total double, score double")
    base = F.col("total") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    return done.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("bigint").alias("train_tokens"),
                       base.alias("base_score"), "score")
