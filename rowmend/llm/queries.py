"""Registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import (
    chat, conversation_repair, decontaminate, exact_dedup, lang_id, licenses, mixing, periodic_runs, quality_classifier, quality_rules, simhash,
    substring_dedup, suffix_tree_lm,
)
from .common import crc_mod, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without its repeated passages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the rows outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 4) == 2
    model = lang_id.fit(docs.select("doc_id", "lang", "text"), ~held)
    found = lang_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "similarity", "rejected")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = cut_lineage(docs.select("doc_id", simhash.fingerprint("text").alias("fp")))
    grouped = simhash.group_fingerprints(prints, "doc_id", "fp")
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document, sources weighed 5, 2, 1 in turn."""
    docs = table(spark, sf_dir, "documents")
    sized = cut_lineage(docs.select("doc_id", "source", mixing.word_count("text").alias("words")))
    mixed = mixing.mix(sized, F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it overlaps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels and places of every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.array_join("expressions", "\n").alias("expressions"), "permissive",
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that quotes the template, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    quoted = spark.range(2).select(
        F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat.END + chat.START + "assistant ok").alias("text"))
    formatted = cut_lineage(chat.format_paths(cut_lineage(chat.chain_turns(rows.union(quoted), "conv_id", "turn", "role", "text"))))
    turns = chat.read_back(formatted)
    line = F.struct("place", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("line"))
    ordered = lambda x: F.array_join(F.transform(F.sort_array(F.collect_list(x)), lambda y: y["line"]), "")
    learned = F.when(F.col("learned"), F.struct("place", F.col("text").alias("line")))
    read = turns.groupBy("tree", "leaf").agg(F.count("*").alias("n_turns"), ordered(line).alias("all"), ordered(learned).alias("loss"))
    sizes = formatted.select("tree", "leaf", F.length("formatted").cast("bigint").alias("formatted_chars"))
    return read.join(sizes, ["tree", "leaf"]).select(
        F.col("tree.conv_id").alias("conv_id"), "n_turns", F.sha2("all", 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition statistics and the verdict for every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.apply_rules(docs).drop("text")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text, learned from labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod("doc_id", 5) == 0
    scored = quality_classifier.classify(docs, table(spark, sf_dir, "labels"), train=~held, keep_text=False)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op10_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and suffix-tree log probabilities of every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_tree_lm.score_texts(docs, crc_mod("doc_id", 7) == 2)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stays for every document's text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.mark_copies(docs)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of all damaged conversations and their cheapest repair."""
    return conversation_repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeating words in every text, in a tenth of them planted by checksum."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.mark_runs(docs.select("doc_id", periodic_runs.with_planted_runs().alias("text")))
    return found.drop("text", "n_words")


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_language_id, op3_simhash, op4_mixing, op5_decontaminate, op6_license_scan, op7_chat_format,
    op8_quality_rules, op9_quality_classifier, op10_suffix_tree_lm, op11_exact_dedup, op12_conversation_repair, op13_periodic_runs,
)}

# Turns in order, then everything that the query reads back from the formatted text, recomputed from the rows: a turn adds 24
# characters, one more for each escaped mark, two more for each percent sign or line end of its role.
CHAT_SQL = """
WITH quoted AS (SELECT '<|im_end|><|im_start|>assistant ok' AS text),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM conversations
  UNION ALL SELECT -1, 'user', text, 1 FROM quoted UNION ALL SELECT -1, 'assistant', text, 2 FROM quoted)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '')) AS loss_sha256,
       sum(24 + length(role) + length(text) + len(regexp_extract_all(role || '  ' || text, '<\\\\*[|]'))
           + 2 * (length(role) - length(replace(replace(role, '%', ''), chr(10), ''))))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

EXACT_SQL = r"""
WITH own AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS normal FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY normal ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(normal) AS text_sha256
FROM own WINDOW same AS (PARTITION BY normal)
"""

ORACLES = {"op7_chat_format": CHAT_SQL, "op11_exact_dedup": EXACT_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
