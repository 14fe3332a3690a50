"""Licence scan: Aho-Corasick over the words of a text, and a shunting-yard evaluator for licence expressions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import row_udf, text_bytes, with_result

# Phrases that the base columns count, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Further notice phrases of this operator, and their labels.
NOTICE_PHRASES = {
    "affero general public license": "agpl",
    "apache license": "apache",
    "boost software license": "boost",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "bsd license": "bsd",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "eclipse public license": "epl",
    "european union public license": "eupl",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "mit license": "mit",
    "mozilla public license": "mpl",
    "no rights reserved": "public-domain",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
}

TAG_PHRASE = "spdx license identifier"

# Identifiers (lower case) that allow reuse without copyleft, for evaluating expressions.
PERMISSIVE = frozenset(["0bsd", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsl-1.0", "cc-by-4.0", "cc0-1.0", "isc", "mit", "unlicense", "zlib"])

# How far one kind of evidence alone settles that a text carries a licence.
TAG_WEIGHT, NOTICE_WEIGHT, RESERVED_WEIGHT = 0.9, 0.6, 0.5

SCHEMA = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "expressions array<string>, permissive boolean"
)

LEVEL = {"or": 1, "and": 2, "with": 3}


def _word_bytes() -> bytes:
    """Translation to words and single separators: A-Z lowered, a-z, 0-9 and bytes of other scripts kept, the rest spaces."""
    out = bytearray(b" " * 256)
    for b in range(256):
        if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128:
            out[b] = b
        elif 65 <= b <= 90:
            out[b] = b + 32
    return bytes(out)


def tokens_of(expression: str) -> list[str]:
    """Identifiers, operators and parentheses of a licence expression, in lower case."""
    return re.findall(r"[()]|[a-z0-9][a-z0-9.+:_-]*", expression.lower())


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: operands go out at once, operators wait on a stack until a weaker one comes.  None if malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in tokens_of(expression):
        if token == "(":
            if not operand_next:
                return None
            stack.append(token)
        elif token == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif token in LEVEL:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and LEVEL[stack[-1]] >= LEVEL[token]:
                out.append(stack.pop())
            stack.append(token)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(token)
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str], allowed: frozenset[str] = PERMISSIVE) -> tuple[bool, list[str]]:
    """Whether some choice among `or` satisfies every `and`, and the licence identifiers.  An exception named after
    `with` only adds rights, so the licence before it decides."""
    stack: list[tuple[bool, list[str]]] = []
    for token in postfix:
        if token not in LEVEL:
            stack.append((token in allowed, [token]))
            continue
        (right, right_ids), (left, left_ids) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left, left_ids))
        else:
            stack.append((left and right if token == "and" else left or right, left_ids + right_ids))
    return stack[0]


def expressions_of(text: str) -> list[str]:
    """What follows each identifier tag up to the end of its line, without closing comment marks."""
    found = re.findall(r"spdx[^a-z0-9\n]license[^a-z0-9\n]identifier[ \t]*:?[ \t]*([^\r\n]*)", text.lower())
    return [re.sub(r"(\*/|-->|#+|;|[\"'`,.])*\s*$", "", x.strip()).strip() for x in found]


def scanner():
    """Function from a list of UTF-8 texts to the columns of SCHEMA."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *NOTICE_PHRASES, TAG_PHRASE}:
        automaton.add_word(f" {phrase} ", phrase)
    automaton.make_automaton()
    words = _word_bytes()

    def scan(texts: list[bytes]) -> dict:
        out: dict = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "permissive")}
        for raw in texts:
            parts = raw.translate(words).split()
            line = " " + b" ".join(parts).decode() + " "
            base: list[int] = []
            base_labels: set[str] = set()
            notices: set[str] = set()
            tagged = False
            for end, phrase in automaton.iter(line):
                if phrase in BASE_PHRASES:
                    base.append(end - len(phrase) - 1)
                    base_labels.add(BASE_PHRASES[phrase])
                if phrase in NOTICE_PHRASES:
                    notices.add(NOTICE_PHRASES[phrase])
                tagged |= phrase == TAG_PHRASE
            found = expressions_of(raw.decode()) if tagged else []
            tags: set[str] = set()
            verdicts = []
            for expression in found:
                postfix = to_postfix(expression)
                if postfix is None:
                    tags.add("spdx:unparsed")
                    verdicts.append(False)
                else:
                    allowed, ids = evaluate(postfix)
                    verdicts.append(allowed)
                    tags.update(f"spdx:{x}" for x in ids)
            doubt = 1.0
            for label in base_labels | notices:
                doubt *= 1 - (RESERVED_WEIGHT if label == "reserved" else NOTICE_WEIGHT)
            doubt *= (1 - TAG_WEIGHT) ** len(found)
            out["n_words"].append(len(parts))
            out["n_base"].append(len(base))
            out["first_word"].append(line.count(" ", 0, min(base)) if base else None)
            out["last_word"].append(line.count(" ", 0, max(base)) if base else None)
            out["base_labels"].append(",".join(sorted(base_labels)))
            out["labels"].append(",".join(sorted(base_labels | notices | tags)))
            out["score"].append(round(1 - doubt, 12))
            out["expressions"].append(found)
            out["permissive"].append(all(verdicts) if verdicts else None)
        return out

    return scan


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the places, labels, score and evaluated expressions of every text.

    Words are runs of ASCII letters (lowered), digits and characters beyond ASCII.  A null text is empty: no words, no
    labels (empty strings), null places, score 0.  `permissive` is null without an identifier tag, false if one of the
    expressions is malformed or not permissive.  An input column named like an output column is replaced.  Each row is
    scanned by itself: repeated rows and ties need no rule, an empty table gives an empty table.
    """
    fields = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(texts):
        if "scan" not in state:
            state["scan"] = scanner()
        return state["scan"](texts)

    state: dict = {}
    return with_result(docs, row_udf(run, SCHEMA)(text_bytes(text_col)), fields)
