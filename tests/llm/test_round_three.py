"""Exact duplicates, conversation repair and periodic runs against plain versions."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowmend.llm import conversation_repair, exact_dedup, mixing, periodic_runs, queries
from rowmend.llm.common import table
from tests.llm.helpers import odd_docs, rows_of, words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def same(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


# exact duplicates


def plain_copies(rows):
    """Sorted (id, keep_id, size, sha) of (id, text) rows, and the kept ones."""
    groups = {}
    for i, t in rows:
        groups.setdefault(same(t), []).append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(((i, keep[same(t)], len(groups[same(t)]), sha(same(t))) for i, t in rows), key=key), sorted(((keep[t], sha(t)) for t in groups), key=key)


def check_copies(docs, rows):
    got = exact_dedup.mark_copies(docs).collect()
    want, kept = plain_copies(rows)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == want
    assert sorted(((r.doc_id, r.text_sha256) for r in got if r.kept), key=key) == kept


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_copies_equal_plain_version_under_any_ranges(spark, parts):
    rng = random.Random(5)
    texts = ["hot text " * 30, "hot text " * 30 + "x", "hot  text\t" * 30, "", None, " ", "\n", "a b", "a\tb", "ab"]
    rows = [(i if rng.random() < 0.97 else None, rng.choice(texts if rng.random() < 0.6 else [f"own {i}", "hot text " * 30])) for i in range(600)]
    rows += rows[:40]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
        check_copies(docs, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_copies_of_odd_tables(spark):
    docs = odd_docs(spark).withColumn("kept", F.lit("x")).withColumn("Run", F.lit(1)).withColumn("part", F.lit(2)).withColumn("a.b", F.lit(3))
    check_copies(docs, [(r.doc_id, r.text) for r in docs.collect()])
    got = exact_dedup.mark_copies(docs)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "score", "size", "Run", "part", "a.b", "keep_id", "group_size", "kept", "text_sha256"]
    assert {(r.n_chars, r.text_sha256) for r in got.collect()} == {(r.n_chars, sha(same(r.text))) for r in docs.collect()}
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(sha(same(r.text)) for r in left.collect()) == sorted({sha(same(r.text)) for r in docs.collect()})
    assert exact_dedup.mark_copies(docs.limit(0)).collect() == [] and exact_dedup.drop_copies(docs.limit(0)).collect() == []


def test_copies_query(spark, sf):
    got = queries.op11_exact_dedup(spark, sf)
    check_copies(table(spark, sf, "documents"), [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()])
    assert got.where("kept").count() == got.select("text_sha256").distinct().count()


# conversation repair


def cheapest(rows):
    """Cost, audit and lines of the cheapest repair, by search over whole strings of edits."""
    heap, best = [(0, "", 0, "", ())], None
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, lines)
        if len(roles) > len(rows) + 3:
            continue
        steps = [(3, "I", i, x, (f"{'user' if x == 'u' else 'assistant'}:",)) for x in "ua"]
        if i < len(rows):
            role, text, fault = rows[i]
            extra = 3 if fault == "truncated" else 0
            steps.append((4, "D", i + 1, "", ()))
            if fault not in ("blank", "duplicate"):
                steps += [(3 + extra, "R", i + 1, x, (f"{'user' if x == 'u' else 'assistant'}:{text}",)) for x in "ua"]
                steps.append((extra, "K", i + 1, role[:1] or "-", (f"{role}:{text}",)))
        for add, letter, j, x, said in steps:
            if re.fullmatch("s?(ua)*u?", roles + x):
                heapq.heappush(heap, (cost + add, audit + letter, j, roles + x, lines + said))
    return best


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_repair(rows):
    """One tuple for every conversation of (conv, turn, role, text) rows."""
    hurt = damage(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in hurt if r[0] == conv and (r[0] is None) == (conv is None)]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(f"{r[2]}\0{r[3]}".encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest([(r[2], r[3], f) for r, f in zip(own, faults)])
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                     faults.count("truncated"), illegal, cost, audit, sha("\n".join(lines)))
    return out


def repaired(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_repair_query_equals_plain_search(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, sf, "conversations").collect()]
    assert repaired(queries.op12_conversation_repair(spark, sf)) == plain_repair(rows)


def test_repair_of_odd_tables(spark):
    rng = random.Random(8)
    said = ["", " \n", "Hi.", "Why?", "so", "And so\t", None, "x! \n", "é.", "end。"]
    rows = [(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, None]), rng.choice([0, 1, 2, 3, 5, 9, None]), rng.choice(["user", "assistant", "system", "tool", "", None, "ux"]), rng.choice(said))
            for _ in range(36)]
    rows += rows[:3] + [(100, None, None, None)] + [(c, 0, "user", "All alone.") for c in range(200, 260)]
    table_ = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, line int, conv int")
    got = repaired(conversation_repair.repair_damaged(table_.repartition(3)))
    assert got == plain_repair(rows)
    assert (0, 0, 0, 0, 0, 0, "", sha("")) in got.values()
    assert conversation_repair.repair_damaged(table_.limit(0)).collect() == []


@pytest.mark.parametrize("parts", ["1", "9"])
def test_a_long_conversation_is_cut_into_pieces(spark, monkeypatch, parts):
    monkeypatch.setattr(conversation_repair, "PIECE_ROWS", 4)
    rng = random.Random(11)
    rows = [(7, i, rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[i % 2], f"Line {i if rng.random() < 0.8 else i % 5}" + rng.choice([".", ".", ""]))
            for i in range(400)]
    rows += [(c, t, "user", f"u{c}.") for c in range(20, 40) for t in range(2)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = repaired(conversation_repair.repair_damaged(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    own = damage([r for r in rows if r[0] == 7])
    seen, coded, faults = set(), "", []
    for _, _, role, text in own:
        fault = "d" if not text or (role, text) in seen else "k" if text[-1:] in (".", "!", "?") else "t"
        seen.add((role, text))
        faults.append(fault)
        coded += role[0] + fault
    whole = conversation_repair.Ending()
    whole.add(conversation_repair.packed_weights(coded), len(own))
    assert got[7][5:7] == whole.result()
    assert got[7][2] == faults.count("d") - sum(not r[3].strip() for r in own)
    assert {k: v for k, v in got.items() if k != 7} == plain_repair([r for r in rows if r[0] != 7])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from("kkdt")), max_size=5), st.integers(1, 6))
def test_weights_give_the_cheapest_edits_in_pieces_of_any_size(rows, size):
    names = {"s": "system", "u": "user", "a": "assistant", "x": "x"}
    want = cheapest([(names[i], "", {"d": "blank", "t": "truncated", "k": ""}[f]) for i, f in rows])
    end = conversation_repair.Ending()
    for at in reversed(range(0, len(rows), size)):
        part = rows[at : at + size]
        end.add(conversation_repair.packed_weights("".join(i + f for i, f in part)), len(part))
    assert end.result() == want[:2]


# periodic runs


def plain_runs(x):
    out = []
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q) and not any(all(x[k] == x[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(w):
    runs = plain_runs(w)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (len(runs), best[0], best[1], best[2], 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def run_row(r):
    return r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_runs_query_equals_plain_version(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = queries.op13_periodic_runs(spark, sf).collect()
    assert len(got) == len(docs) and sum(r.n_runs > 0 for r in got) > 10
    for r in got:
        w = planted(r.doc_id, words(docs[r.doc_id]))
        if len(w) <= 1500:
            assert run_row(r) == plain_row(w)


def test_runs_of_odd_tables(spark):
    docs = odd_docs(spark)
    more = spark.createDataFrame([(50 + i, t) for i, t in enumerate(["a " * 7, "a b " * 3 + "a", "a b " * 4, "x " + "ab c d " * 9 + "ab y", "z " * 3000])], "doc_id bigint, text string")
    got = periodic_runs.mark_runs(docs.unionByName(more, allowMissingColumns=True).withColumn("n_runs", F.lit("x")).withColumn("START", F.lit("y")))
    for r in got.collect():
        w = words(r.text)
        if len(w) < 1000:
            assert run_row(r) == plain_row(w)
        else:
            assert (r.n_runs, r.start, r.length) == (1, 0, len(w) if w[0] == "z" else r.length)
    assert periodic_runs.mark_runs(docs.limit(0)).collect() == []
    assert len(rows_of(docs.select(periodic_runs.with_planted_runs().alias("t")))) == docs.count()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 70), st.sampled_from([1, 2, 3, 6, 30]), st.integers(0, 10**6)), max_size=5))
def test_runs_of_many_texts_at_once(shapes):
    texts = []
    for n, k, seed in shapes:
        rng = random.Random(seed)
        x = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n else 0):
            a, p = rng.randrange(n), rng.randint(1, 8)
            for i in range(a + p, min(n, a + p * rng.randint(3, 9) + rng.randint(0, 3))):
                x[i] = x[i - p]
        texts.append(x)
    got = periodic_runs.find_runs(np.array([w for x in texts for w in x], np.int64), np.cumsum([0, *map(len, texts)]))
    assert [(t, s, n, q) for t, s, q, n in got] == [(t, s, n, q) for t, x in enumerate(texts) for s, n, q in plain_runs(x)]


# names of columns


def test_a_mix_keeps_columns_named_like_its_own_steps(spark):
    docs = odd_docs(spark).withColumn("picked", F.lit(1)).withColumn("repeats", F.lit(2)).withColumn("n", F.lit(3))
    mixed = mixing.mix(docs, mixing.word_count("text"), key_cols=("doc_id", "text"))
    assert mixed.count() == docs.count()
    assert {(r.picked, r.repeats, r.n) for r in mixing.expand(mixed).collect()} == {(1, 2, 3)}
