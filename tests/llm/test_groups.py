"""Operators over groups of texts, against plain versions."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from rowmend.llm import chat, common, mixing, queries, simhash, substring_dedup, suffix_tree_lm
from rowmend.llm.common import table
from rowmend.llm.components import components
from tests.llm.helpers import ODD_TEXTS, crc, lower, odd_docs, words
from tools.check_queries import compare, connect


def documents(spark, sf):
    return {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}


# fingerprints and near duplicates

def plain_fingerprint(text):
    w = words(lower(text))
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids_of):
    """Smallest id reachable, for {fingerprint: ids}."""
    prints = sorted(ids_of)
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for p in prints:
        least[root(p)] = min([least.get(root(p), math.inf), *ids_of[p]])
    return {p: least[root(p)] for p in prints}


def test_simhash_query_equals_plain_version(spark, sf):
    ids_of = collections.defaultdict(list)
    prints = {i: plain_fingerprint(t) for i, t in documents(spark, sf).items()}
    for i, p in prints.items():
        ids_of[p].append(i)
    expected = plain_components(ids_of)
    for r in queries.op3_simhash(spark, sf).collect():
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == expected[prints[r.doc_id]]


@pytest.mark.parametrize("shard", [4096, 8])
def test_planted_chains_of_fingerprints(spark, shard):
    rng = random.Random(4)
    prints = []
    for _ in range(60):
        p = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 30)):
            prints.append(p)
            for bit in rng.sample(range(64), rng.randrange(0, 5)):
                p ^= 1 << bit
    ids_of = collections.defaultdict(list)
    for i, p in enumerate(prints):
        ids_of[p].append(i)
    signed = lambda v: v - 2**64 if v >> 63 else v
    df = spark.createDataFrame([(signed(p),) for p in ids_of], "fp bigint").select(F.lit(0).alias("family"), "fp")
    links = simhash.link_fingerprints(df, 3, shard)
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in links.collect())
    root = {r.node: r.root for r in components(links).collect()}
    expected = plain_components(ids_of)
    pairs = [(p, root.get(signed(p), signed(p))) for p in ids_of]
    groups = collections.defaultdict(set)
    for p, r in pairs:
        groups[r].add(expected[p])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(expected.values()))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40), st.integers(0, 2**64 - 1), st.integers(0, 40))
def test_bk_tree_finds_what_a_scan_finds(values, query, radius):
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    expected = sorted(((v ^ query).bit_count(), v) for v in values if (v ^ query).bit_count() <= radius)
    assert sorted(tree.within(query, radius)) == expected


def test_components_of_a_long_chain(spark):
    links = spark.range(1500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.sql("select 5000L a, 5001L b union all select 7L, 7L union all select null, 3L"))
    found = {r.node: r.root for r in components(links).collect()}
    assert len(found) == 1503 and len({found[i] for i in range(1501)}) == 1 and found[5000] == found[5001] != found[0]
    assert components(links.limit(0)).count() == 0


def test_components_and_links_are_the_same_without_broadcasts(spark, monkeypatch):
    """Sides above the bound on broadcasts are shuffled; both ways give the classes of a plain search."""
    rng = random.Random(3)
    links = spark.createDataFrame([(rng.randrange(400), rng.randrange(400)) for _ in range(300)], "a bigint, b bigint")
    prints = [0, 1, 7, 15, 2**63 - 1] + [rng.getrandbits(63) for _ in range(40)]
    table = spark.createDataFrame([(i, p) for i, p in enumerate(prints + prints[:3])], "doc_id bigint, fp bigint")
    found = []
    for bound in (500_000, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
        groups = {r.doc_id: r.component_id for r in simhash.group_fingerprints(table, "doc_id", "fp").collect()}
        found.append(({r.node: r.root for r in components(links).collect()}, groups))
    assert found[0] == found[1] and found[0][1][3] == 0 and found[0][1][4] == 4
    for a, b in links.where("a <> b").collect():
        assert found[0][0][a] == found[0][0][b]


def near_docs():
    rng = random.Random(9)
    base = [f"word{rng.randrange(5000)}" for _ in range(300)]
    out = [(1, base), (2, base), (3, [w if i != 100 else "changed" for i, w in enumerate(base)]), (4, [w if i not in (30, 150, 222) else "other" for i, w in enumerate(base)])]
    out += [(10 + k, [f"word{rng.randrange(5000)}" for _ in range(300)]) for k in range(20)]
    return [(i, " ".join(w)) for i, w in out]


def test_near_copies_go_and_clean_texts_stay(spark):
    df = spark.createDataFrame(near_docs() + [(1, near_docs()[0][1]), (None, near_docs()[0][1]), (50, None), (51, "")], "doc_id bigint, text string")
    left = [r.doc_id for r in simhash.drop_near_duplicates(df).collect()]
    assert sorted(left) == [1, *range(10, 30), 50]
    found = {r.id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert {found[i] for i in (1, 2, 3, 4, None)} == {1} and found[50] == found[51] == 50 and found[12] == 12


def plain_classes(texts):
    """Smallest id reachable over all pairs with a Jaccard similarity of 0.8 or more."""
    sets = {i: set(simhash.shingles((t or "").lower().encode().split(), 5)) for i, t in texts.items()}
    least = {i: i for i in texts}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_truncated_and_extended_copies_are_found(spark):
    rng = random.Random(21)
    word = lambda: f"word{rng.randrange(3000)}"
    texts = {}
    for k in range(60):
        base = [word() for _ in range(rng.randrange(30, 600))]
        n = len(base)
        cut = base[: math.ceil(n * rng.choice([0.82, 0.86, 0.9]))]
        at, more = rng.randrange(n), [word() for _ in range(int(n * rng.choice([0.05, 0.15, 0.24])))]
        texts |= {10 * k + i: " ".join(w) for i, w in enumerate([base, cut, base[:at] + more + base[at:], base + more, base[: n // 2]])}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {r.id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert found == plain_classes(texts) and sum(i != c for i, c in found.items()) > 120


def test_copies_among_shuffled_texts_of_one_word_set_are_found(spark):
    rng = random.Random(22)
    vocabulary = [f"word{k}" for k in range(200)]
    texts = {}
    for k in range(40):
        base = rng.sample(vocabulary, 200)
        texts |= {100 + k: " ".join(base), 200 + k: " ".join(base[:100] + base[103:] + base[100:103])}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert df.select(simhash.word_fingerprints("text").alias("fps")).distinct().count() == 1
    found = {r.id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert found == plain_classes(texts) and len(set(found.values())) == 40


def test_lists_cut_into_parts_meet_all_pairs(spark):
    lists = [(7, no, 100, no % 3) for no in range(60)] + [(8, no, 100, 0) for no in range(5)] + [(9, 1, 10, 0), (9, 70, 100, 0)]
    shared = spark.createDataFrame(lists, "key bigint, no bigint, n int, pos int")
    classes = spark.createDataFrame([(no, 0) for no in range(10)], "no bigint, root bigint")
    expected = {(a, b) for a in range(60) for b in range(a + 1, 60) if b >= 10}
    for part_rows in (4096, 7):
        assert {tuple(r) for r in simhash.prefix_pairs(shared, classes, 0.8, part_rows).collect()} == expected


# repeated passages

def plain_sentences(text):
    out = []
    for part in re.findall(r"(?s)(?:(?![.!?,;:]+[ \t\r\n\x0b\x0c]|\n).)*(?:[.!?,;:]+[ \t\r\n\x0b\x0c]+|\n+|$)", text):
        if part.count(" ") > 12:
            words_ = re.findall(r"[^ \t\r\n\x0b\x0c]+[ \t\r\n\x0b\x0c]*|[ \t\r\n\x0b\x0c]+", part)
            start = 0
            for k, w in enumerate(words_):
                bare = w.strip(" \t\r\n\x0b\x0c").encode()
                if bare and bare[-1] % 8 == 5 and len(w.encode()) > len(bare):
                    out.append("".join(words_[start : k + 1]))
                    start = k + 1
            part = "".join(words_[start:])
        if part:
            out.append(part)
    return out


def plain_runs(parts, run, least):
    sizes = [len(words(p)) for p in parts]
    for a in range(len(parts)):
        for b in range(a + run, len(parts) + 1):
            if sizes[a] and sum(sizes[a:b]) >= least:
                yield a, b, " ".join(words(lower("".join(parts[a:b]))))
                break


def plain_remove(docs):
    """docs: [(id, text)] in order; the same runs, kept at their first place only."""
    seen, out = {}, {}
    for i, text in docs:
        parts = plain_sentences(text)
        gone = set()
        for a, b, key in plain_runs(parts, 3, 12):
            if seen.setdefault(key, (i, a)) != (i, a):
                gone.update(range(a, b))
        out[i] = "".join(p for k, p in enumerate(parts) if k not in gone)
    return out


def test_substring_query_equals_plain_version(spark, sf):
    expected = plain_remove(sorted(documents(spark, sf).items()))
    for r in queries.op1_substring_dedup(spark, sf).collect():
        assert r.text == expected[r.doc_id]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab m.,\n!É\t", max_size=300))
def test_sentences_and_runs_equal_the_plain_version(text):
    data = text.encode()
    ends = substring_dedup.sentence_ends(data)
    parts = [data[a:b].decode() for a, b in zip([0, *ends], ends)]
    assert "".join(parts) == text and parts == plain_sentences(text)
    starts, keys = substring_dedup.run_keys(data, 3, 5)
    assert list(zip(starts.tolist(), [k.decode() for k in keys])) == [(a, k) for a, _, k in plain_runs(parts, 3, 5)]


def test_a_passage_inside_other_texts_is_cut(spark):
    rng = random.Random(5)
    make = lambda n: [f"t{rng.randrange(10**6)}" + rng.choice(["", "", "", ",", "."]) for _ in range(n)]
    passage = make(60)
    docs = [(i, " ".join(make(40) + passage + make(40))) for i in range(5)] + [(9, " ".join(make(120)))]
    df = spark.createDataFrame(docs + [(20, None), (21, "")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in substring_dedup.remove_repeats(df).collect()}
    assert rows[0].n_removed == 0 and rows[9].text == docs[5][1] and rows[20].text is None and rows[21].text == ""
    assert all(rows[i].words_removed >= 40 and " ".join(passage) not in rows[i].text for i in range(1, 5))


# mixing

@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), min_size=1, max_size=8), st.floats(0, 1))
def test_budget_fit_is_exact_where_a_subset_is(counts, share):
    sizes, n = np.array(sorted(counts)), np.array([counts[k] for k in sorted(counts)])
    capacity = int(share * (sizes * n).sum())
    taken = mixing.reachable(sizes, n, capacity)
    sums = {0}
    for s, c in zip(sizes.tolist(), n.tolist()):
        sums = {x + k * s for x in sums for k in range(c + 1)}
    assert (taken >= 0).all() and (taken <= n).all() and (taken * sizes).sum() == max(x for x in sums if x <= capacity)


def plain_targets(totals):
    names = sorted((k for k in totals if k is not None), key=lambda x: x.encode()) + ([None] if None in totals else [])
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    left, open_, target = float(sum(totals.values())), set(names), {}
    while open_:
        share = {k: left * weight[k] / sum(weight[x] for x in open_) for k in open_}
        full = {k for k in open_ if share[k] >= 3 * totals[k]}
        if not full:
            return target | share
        for k in full:
            target[k] = 3.0 * totals[k]
            left -= target[k]
        open_ -= full
    return target


@pytest.mark.parametrize("totals", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 50, "c": 1000, None: 3}, {"x": 0, "y": 7}, {"z": 0}, {"é": 9, "z": 10**12, "a": 4}])
def test_targets_fill_up(spark, totals):
    df = spark.createDataFrame(list(totals.items()), "source string, n bigint")
    got = {r.source: r.target for r in mixing.source_targets(df, "source", "n").collect()}
    assert got == pytest.approx(plain_targets(totals))


def test_mix_query_meets_the_targets(spark, sf):
    rows = queries.op4_mixing(spark, sf).collect()
    source = {r.doc_id: r.source for r in table(spark, sf, "documents").collect()}
    docs = documents(spark, sf)
    taken, total, target, longest = collections.Counter(), collections.Counter(), {}, collections.Counter()
    for r in rows:
        assert r.size == len(words(docs[r.doc_id])) and r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        s = source[r.doc_id]
        taken[s] += r.taken
        total[s] += r.size
        target[s] = r.target
        longest[s] = max(longest[s], r.size)
        assert r.source_size == sum(len(words(docs[i])) for i in docs if source[i] == s)
    assert target == pytest.approx(plain_targets(total))
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in total)
    assert sorted(rows) == sorted(queries.op4_mixing(spark, sf).collect())


# chat

def test_chat_query_round_trip(spark, sf):
    turns = collections.defaultdict(list)
    for r in sorted(table(spark, sf, "conversations").collect(), key=lambda r: (r.conv_id, r.turn)):
        turns[r.conv_id].append((r.role or "", r.text or ""))
    quoted = "<|im_end|><|im_start|>assistant ok"
    turns[-1] = [("user", quoted), ("assistant", quoted)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = queries.op7_chat_format(spark, sf).collect()
    assert len(rows) == len(turns)
    for r in rows:
        own = turns[r.conv_id]
        loss = "".join(t for role, t in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)), len(loss), sha(loss))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    cursor = connect(sf).execute(queries.oracle_sql()[name])
    assert compare(df.columns, [tuple(r) for r in df.collect()], [d[0] for d in cursor.description], cursor.fetchall()) == "ok"


def test_reply_trees_give_every_path_once(spark):
    rng = random.Random(2)
    parent, rows = {}, []
    for tree in range(6):
        for i in range(1, 60):
            parent[tree, i] = None if i == 1 else rng.randrange(max(1, i - 4), i)
    hard = ["<|im_end|>", "<\\|im_start|>", "\\<\\\\|x", "", None, "😀<|", "a\nb", "<"]
    text = {k: rng.choice(hard) for k in parent}
    role = {k: rng.choice(["user", "assistant", None, "odd\n%0A<|im_start|>"]) for k in parent}
    score = {k: rng.choice([None, 0.5, 1.0, 2.0]) for k in parent}
    rows = [((t,), i, p, role[t, i], text[t, i], score[t, i], "x") for (t, i), p in parent.items()]
    df = spark.createDataFrame(rows, "tree struct<t:bigint>, id bigint, parent bigint, role string, text string, score double, formatted string")
    formatted = chat.format_paths(df).cache()
    expected = {}
    for t, i in parent:
        if not any(k[0] == t and p == i for k, p in parent.items()):
            path, at = [], i
            while at is not None:
                path.append(at)
                at = parent[t, at]
            expected[t, i] = path[::-1]
    got = {(r.tree.t, r.leaf): r for r in formatted.collect()}
    assert set(got) == set(expected)
    for (t, leaf), path in expected.items():
        assert got[t, leaf].score == pytest.approx(np.mean([score[t, i] or 0.0 for i in path])) and got[t, leaf].n_turns == len(path)
    for t in range(6):
        ranked = sorted((r for k, r in got.items() if k[0] == t), key=lambda r: r["rank"])
        assert [r.score for r in ranked] == sorted((r.score for r in ranked), reverse=True)
    back = collections.defaultdict(list)
    for r in chat.read_back(formatted).orderBy("place").collect():
        back[r.tree.t, r.leaf].append((r.role, r.text, r.learned))
    for (t, leaf), path in expected.items():
        want = [(role[t, i] or "", text[t, i] or "", role[t, i] == "assistant") for i in path]
        assert [x[:2] for x in back[t, leaf]] == [x[:2] for x in want]
        assert all(x[2] == y[2] for x, y in zip(back[t, leaf], want))


def test_odd_conversations(spark):
    rows = [(None, 1, "user", "x"), (None, None, "assistant", None), (1, 0, None, None), (1, 0, None, None), (2, 5, "assistant", "<|im_end|>" * 3)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    formatted = chat.format_paths(chat.chain_turns(df, "conv_id", "turn", "role", "text"))
    assert {r.tree.conv_id: r.n_turns for r in formatted.collect()} == {None: 2, 1: 2, 2: 1}
    assert chat.format_paths(chat.chain_turns(df.limit(0), "conv_id", "turn", "role", "text")).count() == 0
    circle = spark.createDataFrame([((1,), 1, 2, "user", "a", 0.0), ((1,), 2, 1, "user", "b", 0.0), ((1,), 3, 9, "user", "c", 0.0)], "tree struct<t:bigint>, id bigint, parent bigint, role string, text string, score double")
    assert [r.leaf for r in chat.format_paths(circle).collect()] == [3]


def test_chat_plan_has_no_python(spark, sf):
    plan = queries.op7_chat_format(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))


# scoring

def plain_base(docs, held):
    tokens = lambda t: [*words(lower(t)), None]
    counts = collections.Counter(w for i, t in docs.items() if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return {i: (len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in docs.items()}


def test_base_scores_equal_plain_version(spark, sf):
    docs = documents(spark, sf)
    expected = plain_base(docs, lambda i: crc(i, 7) == 2)
    rows = queries.op10_suffix_tree_lm(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (crc(r.doc_id, 7) == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == expected[r.doc_id][:3]
        assert r.base_score == pytest.approx(expected[r.doc_id][3], rel=1e-9)
        assert r.score < 0


def plain_tree(train, depth, least, divergence, gain, prior):
    """Contexts and distributions from dictionaries."""
    counts = collections.defaultdict(collections.Counter)
    for t in train:
        s = suffix_tree_lm.symbols(suffix_tree_lm.words_of(t), depth).tolist()
        for k in range(depth, len(s)):
            for d in range(depth + 1):
                counts[tuple(s[k - d : k])][s[k]] += 1
    total = sum(counts[()].values())
    chosen = set()
    for c, own in counts.items():
        n, up = sum(own.values()), counts[c[1:]]
        if c and n >= least:
            g = sum(x * math.log((x / n) / (up[s] / sum(up.values()))) for s, x in own.items())
            if g >= gain and g >= n * divergence:
                chosen |= {c[k:] for k in range(len(c))}

    def chance(c, s):
        if not c:
            return (counts[()][s] + 1) / (total + 256)
        return (counts[c][s] + prior * chance(c[1:], s)) / (sum(counts[c].values()) + prior)

    def score(t):
        s, out = suffix_tree_lm.symbols(suffix_tree_lm.words_of(t), depth).tolist(), 0.0
        for k in range(depth, len(s)):
            d = 0
            while d < depth and tuple(s[k - d - 1 : k]) in chosen:
                d += 1
            out += math.log10(chance(tuple(s[k - d : k]), s[k]))
        return out

    return score


def test_suffix_tree_equals_plain_version(spark):
    rng = random.Random(8)
    syllables = ["ba", "be", "na", "no", "ti", "ß", "É"]
    texts = [" ".join("".join(rng.choice(syllables[: 3 + k % 5]) for _ in range(rng.randrange(1, 4))) for _ in range(40)) for k in range(30)] + ["", None, "Q"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    options = dict(depth=4, least_count=10, least_divergence=0.01, least_gain=3.0, prior=5.0)
    score = plain_tree([(t or "").encode() for i, t in enumerate(texts) if i % 3], 4, 10, 0.01, 3.0, 5.0)
    rows = suffix_tree_lm.score_texts(df, F.col("doc_id") % 3 == 0, **options).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.score == pytest.approx(score((texts[r.doc_id] or "").encode()), rel=1e-5)


def test_tree_probabilities_sum_to_one(spark):
    seq = suffix_tree_lm.symbols(b"abracadabra".split() * 50, 3)
    seen = collections.Counter(np.concatenate(list(suffix_tree_lm.grams(seq, 3))).tolist())
    contexts = {g >> 8 for g in seen} | {0x787878}  # one that no text has
    rows = [(c << 8 | s, seen[c << 8 | s]) for c in contexts for s in range(256)]
    scored = suffix_tree_lm.gram_scores(spark.createDataFrame(rows, "gram bigint, n bigint"), depth=3, least_count=5).collect()
    assert len(scored) == len(rows)
    total = collections.Counter()
    for r in scored:
        total[r.gram >> 8] += 10**r.value
    assert all(t == pytest.approx(1) for t in total.values()) and len({round(r.value, 6) for r in scored}) > 10


def test_a_small_language_keeps_its_scores_as_the_rest_grows(spark):
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(4))
    own = [" ".join(rng.choice([word("abc") for _ in range(9)]) for _ in range(60)) for _ in range(8)]
    other = [" ".join(word("vwxyz") for _ in range(60)) for _ in range(8)]
    scores = []
    for copies in (1, 4, 16):
        df = spark.createDataFrame(list(enumerate(own + other * copies)), "doc_id bigint, text string")
        rows = suffix_tree_lm.score_texts(df, F.lit(False), least_count=20).where("doc_id < 8").agg(F.sum("score")).first()
        scores.append(rows[0])
    assert scores[2] > 1.1 * scores[0]  # log probabilities: at most a tenth worse


def test_blocks_of_any_size_give_the_same_scores(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents").limit(200)
    whole = {r.doc_id: r for r in suffix_tree_lm.score_texts(docs, F.col("doc_id") % 7 == 2).collect()}
    monkeypatch.setattr(suffix_tree_lm, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(suffix_tree_lm, "CHUNK", 700)
    monkeypatch.setattr(suffix_tree_lm, "TASK_GRAMS", 100)
    monkeypatch.setattr(suffix_tree_lm, "HOT_KEYS", 1000)
    for r in suffix_tree_lm.score_texts(docs, F.col("doc_id") % 7 == 2).collect():
        assert r[:5] == whole[r.doc_id][:5] and r.score == pytest.approx(whole[r.doc_id].score) and r.base_score == pytest.approx(whole[r.doc_id].base_score)


# odd tables, and the pipeline

def test_odd_tables_do_not_break_group_operators(spark):
    docs = odd_docs(spark)
    n = docs.count()
    assert substring_dedup.remove_repeats(docs).count() == n
    assert mixing.mix(docs, F.col("n_chars")).count() == n
    assert suffix_tree_lm.score_texts(docs, F.col("doc_id") == 1).count() == n
    prints = docs.select("doc_id", simhash.fingerprint("text").alias("fp"), "score")
    assert simhash.group_fingerprints(prints, "doc_id", "fp").count() == n
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len({t for t in ODD_TEXTS if t and t.strip()}) + 1
    empty = docs.limit(0)
    for run in (substring_dedup.remove_repeats, simhash.drop_near_duplicates, lambda d: mixing.mix(d, F.col("n_chars")), lambda d: suffix_tree_lm.score_texts(d, F.lit(False))):
        assert run(empty).count() == 0
    assert suffix_tree_lm.score_texts(docs, F.lit(True)).where("train_tokens = 0 and n_known = 0").count() == n


def test_pipeline_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    assert [s[0] for s in corpus_pipeline.STAGES][1] == "simhash near-dedup" and len(corpus_pipeline.STAGES) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
        after = collections.Counter(r.doc_id for r in docs.collect())
        assert set(after) <= set(before)
        if k < 4:
            assert docs.columns == columns and max(after.values()) == 1
        if k == 0:
            assert sum(i not in after for i in labels if labels[i] == 0) >= 0.6 * sum(v == 0 for v in labels.values())
            assert sum(i in after for i in labels if labels[i] == 1) >= 0.98 * sum(v == 1 for v in labels.values())
        if k == 1:
            assert len({" ".join(words(before[i])) for i in after}) == len(after)
        if k == 2:
            expected = plain_remove(sorted(before.items()))
            assert {r.doc_id: r.text for r in docs.collect()} == {i: t for i, t in expected.items() if words(t) or t == before[i]}
    assert set(after.values()) <= {1, 2, 3}


def test_pipeline_on_empty_documents(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
