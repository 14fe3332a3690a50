import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(text or "")


def crc(value, modulus):
    return zlib.crc32(str(value).encode()) % modulus


LONG = "lorem ipsum dolor sit amet, " * 4000
ODD_TEXTS = [None, "", " \n\t ", "a", "É", "the end", "the end", LONG, "x" * 30_000, "null\x00byte and space", "😀 emoji. MIT License!", "a b c\na b c\n\na b c"]


def odd_docs(spark, extra="int"):
    """Nulls in every column, empty and long texts, repeated rows, and columns that clash with outputs and helpers."""
    rows = [(i % 9 if i != 4 else None, t, "en" if i % 2 else None, None if i % 3 == 0 else "s", i, i, i) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[5]]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, score {extra}, size {extra}")


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]
