"""Operators that judge each text by itself, against plain versions."""

import collections
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowmend.llm import decontaminate, lang_id, licenses, quality_classifier, quality_rules, queries
from rowmend.llm.common import crc_mod, table
from tests.llm.helpers import LONG, crc, lower, odd_docs, rows_of, words


def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").select("doc_id", "text").collect()}


def plain_rules(text):
    w = words(text)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def plain_longest(w):
    best = 0
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            k = 0
            while j + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k if k >= 8 else 0)
    return best


def test_quality_rules_query_equals_plain_version(spark, sf):
    docs = texts(spark, sf)
    for r in queries.op8_quality_rules(spark, sf).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == plain_rules(docs[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), max_size=6))
def test_suffix_array_finds_the_longest_repeat_of_every_text(lists):
    keys = [100 * k + ord(c) for k, part in enumerate(lists) for c in part]
    bounds = np.cumsum([0, *map(len, lists)])
    in_window, in_repeat, longest = quality_rules.repeats(np.array(keys, np.int64), bounds)
    assert longest.tolist() == [plain_longest(x) for x in lists]
    assert in_window.tolist() == in_repeat.tolist() == [plain_rules(" ".join(x))[4] for x in lists]


BASE = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def plain_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places, labels = [], set()
    for phrase, label in BASE.items():
        for k in range(len(w) - len(phrase) + 1):
            if tuple(w[k : k + len(phrase)]) == phrase:
                places.append(k)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_query_equals_plain_version(spark, sf):
    docs = texts(spark, sf)
    for r in queries.op6_license_scan(spark, sf).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_places(docs[r.doc_id])
        assert not r.base_labels or set(r.base_labels.split(",")) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_license_scan_of_hard_texts(spark):
    cases = ["CC-BY cc by CC BY", "all  rights\nreserved. All rights, reserved", "acc by", "cc by é", None, ""]
    got = licenses.scanner()([(x or "").encode() for x in cases])
    for k, text in enumerate(cases):
        assert tuple(got[f][k] for f in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == plain_places(text)


@pytest.mark.parametrize("expression,verdict,ids", [
    ("MIT", True, ["mit"]), ("GPL-3.0-only", False, ["gpl-3.0-only"]), ("MIT OR GPL-2.0", True, ["mit", "gpl-2.0"]),
    ("MIT AND GPL-2.0 OR ISC", True, ["mit", "gpl-2.0", "isc"]), ("MIT AND (GPL-2.0 OR Apache-2.0)", True, ["mit", "gpl-2.0", "apache-2.0"]),
    ("GPL-2.0 WITH Classpath-exception-2.0 OR GPL-3.0", False, ["gpl-2.0", "gpl-3.0"]),
])
def test_license_expressions(expression, verdict, ids):
    assert licenses.evaluate(licenses.to_postfix(expression)) == (verdict, ids)


@pytest.mark.parametrize("expression", ["", "MIT OR", "AND MIT", "(MIT", "MIT)", "MIT ISC", "()"])
def test_malformed_license_expressions(expression):
    assert licenses.to_postfix(expression) is None


def test_license_tags_are_read_to_the_end_of_their_line():
    got = licenses.scanner()([b"// SPDX-License-Identifier: MIT OR GPL-2.0 */\nx", b"SPDX-License-Identifier: MIT ISC"])
    assert got["labels"] == ["spdx:gpl-2.0,spdx:mit", "spdx:unparsed"] and got["permissive"] == [True, False]


def test_languages_are_found_on_held_out_texts(spark, sf):
    known = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").collect()}
    rows = queries.op2_language_id(spark, sf).collect()
    assert len(rows) == len(known) and all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.97 * len(held)


def test_far_texts_are_rejected(spark, sf):
    docs = table(spark, sf, "documents")
    model = lang_id.fit(docs, crc_mod("doc_id", 4) != 2)
    odd = spark.createDataFrame([("зима пришла рано в этом году и снег лежал на полях",), ("12 34",), (None,)], "text string")
    rows = lang_id.identify(odd, model).collect()
    assert [r.lang_pred for r in rows] == ["und"] * 3 and all(r.rejected for r in rows) and rows[1].score == rows[2].score == 0
    assert lang_id.identify(odd, lang_id.Model()).where("lang_pred = 'und'").count() == 3
    assert lang_id.fit(docs.limit(0), F.lit(True)).languages == []


def test_rows_without_ids_displace_no_language(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    languages = set(lang_id.fit(docs, F.lit(True)).languages)
    text = docs.where("lang = 'en'").first()["text"]
    many = spark.range(5000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit(text), F.col("id").cast("string")).alias("text"))
    again = spark.range(5000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("en").alias("lang"), F.lit(text).alias("text"))
    for more in (many, again):
        assert set(lang_id.fit(docs.union(more), F.lit(True)).languages) == languages and len(languages) > 1


def test_quality_is_found_on_held_out_labels(spark, sf):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    rows = queries.op9_quality_classifier(spark, sf).collect()
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == table(spark, sf, "documents").count()
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.85 * len(held)


def test_compiled_rules_equal_the_matrix_form(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality_classifier.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    model = quality_classifier.fit_ensemble(x, y, trees=8)
    z = quality_classifier.rule_matrix(x, [r.conditions for r in model.rules])
    expected = 1 / (1 + np.exp(-(model.intercept + z @ [r.weight for r in model.rules])))
    assert ((expected > 0.5) == y).mean() > 0.95 and len(model.rules) < 60
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i bigint, " + quality_classifier.SCHEMA)
    got = [r.s for r in df.select("i", quality_classifier.compile_score(model).alias("s")).orderBy("i").collect()]
    assert np.allclose(got, expected)


def test_classifier_without_labels_gives_the_prior(spark, sf):
    docs, labels = odd_docs(spark), table(spark, sf, "labels").limit(0)
    rows = rows_of(quality_classifier.classify(docs, labels))
    assert {r["score"] for r in rows} == {0.5} and len(rows) == docs.count()


def replaced(words_, k):
    return [w if i % k else "substitute" for i, w in enumerate(words_)]


def test_contamination_equals_plain_search(spark, sf):
    docs = texts(spark, sf)
    items = {r["item_id"]: decontaminate_words(r["text"]) for r in table(spark, sf, "benchmark").collect()}
    grams = collections.defaultdict(set)
    for i, w in items.items():
        for k in range(len(w) - 9):
            grams[tuple(w[k : k + 10])].add(i)
    for r in queries.op5_decontaminate(spark, sf).collect():
        w = decontaminate_words(docs[r.doc_id])
        expected = set().union(*(grams.get(tuple(w[k : k + 10]), set()) for k in range(max(0, len(w) - 9))))
        assert expected <= set(r.item_ids) and r.contaminated == bool(r.item_ids)


def decontaminate_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def test_contamination_survives_substitutions(spark):
    rng = random.Random(3)
    item = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    filler = [f"f{rng.randrange(10**6)}" for _ in range(60)]
    docs = [filler, filler + item + filler, filler + replaced(item, 7), filler + replaced(item, 2), item[:6] + filler, filler + item[15:30], []]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)] + [(9, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(5, " ".join(item)), (6, "alpha beta gamma delta epsilon zeta"), (7, None), (None, "")], "item_id bigint, text string")
    for block_words in (500_000, 10):
        rows = {r.doc_id: r for r in decontaminate.find_contamination(df, bench, block_words=block_words).collect()}
        assert {k for k, r in rows.items() if r.contaminated} == {1, 2, 5}
        assert rows[1].item_ids == [5] and rows[1].identity == 1.0 and rows[2].identity < 1
    short = spark.createDataFrame([(1, "say Alpha, beta gamma delta epsilon zeta now"), (2, "alpha beta gamma delta")], "doc_id bigint, text string")
    assert [r.item_ids for r in decontaminate.find_contamination(short, bench).orderBy("doc_id").collect()] == [[6], []]
    assert decontaminate.find_contamination(df, bench.limit(0)).where("contaminated").count() == 0


def plain_overlap(doc, item):
    """Contaminated, words covered, best identity over all windows of 10 words or more of which 80 % agree."""
    covered, best = set(), 0.0
    for diagonal in range(-len(item), len(doc)):
        same = [(k, doc[k] == item[k - diagonal]) for k in range(max(0, diagonal), min(len(doc), diagonal + len(item)))]
        for a in range(len(same)):
            hits = 0
            for b in range(a, len(same)):
                hits += same[b][1]
                if b - a >= 9 and 5 * hits >= 4 * (b - a + 1):
                    equal = [k for k, e in same[a : b + 1] if e]
                    covered |= set(range(equal[0], equal[-1] + 1))
                    best = max(best, hits / (b - a + 1))
    return bool(covered), len(covered), best or None


def test_contamination_equals_all_windows(spark):
    rng = random.Random(5)
    item = [f"w{k}" for k in range(120)]
    kept = [i % 44 < 30 for i in range(120)]
    docs = [[w if k else "other" for w, k in zip(item, kept)], item[:30], [], item[:8] + ["x"] * 9 + item[17:25]]
    docs += [[w if k else "other" for w, k in zip(item, kind)] for kind in ([i not in (0, 1, 7, 11, 14) and i < 15 for i in range(120)], [i < 5 or i == 6 or i == 8 or 9 < i < 15 for i in range(120)])]
    for share in (0.15, 0.2, 0.25, 0.3, 0.4):
        for _ in range(12):
            a, n = rng.randrange(90), rng.choice([12, 20, 30, 60])
            docs.append(["pre"] * rng.randrange(4) + [w if rng.random() >= share else "other" for w in item[a : a + n]] + ["post"] * rng.randrange(4))
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    item_ = decontaminate_words(" ".join(item))
    for r in decontaminate.find_contamination(df, bench).collect():
        flagged, covered, best = plain_overlap(decontaminate_words(" ".join(docs[r.doc_id])), item_)
        assert (r.contaminated, r.overlap_words) == (flagged, covered) and r.identity == (best if best is None else pytest.approx(best)), r.doc_id


def test_odd_tables_do_not_break_row_operators(spark, sf):
    model = lang_id.fit(table(spark, sf, "documents"), F.lit(True))
    bench = table(spark, sf, "benchmark")
    for run in (quality_rules.apply_rules, licenses.scan_licenses, lambda d: lang_id.identify(d, model), lambda d: decontaminate.find_contamination(d, bench), quality_classifier.add_statistics):
        docs = odd_docs(spark)
        out = run(docs)
        assert out.count() == docs.count() and {"doc_id", "text", "source", "size"} <= set(out.columns) and len(set(out.columns)) == len(out.columns)
        assert run(docs.limit(0)).count() == 0
    long = quality_rules.apply_rules(spark.createDataFrame([(LONG,)], "text string")).first()
    assert long.n_words == 20_000 and long.longest_repeat == 19_995 and not long.kept
