"""Column builders for terms: the tokenizer, query terms, buckets and relevance. All are built-in functions."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = "[A-Za-z0-9]+"
#: Buckets in the order in which shards are scanned; as strings, so `num` stands between n and o.
BUCKETS = sorted([*"abcdefghijklmnopqrstuvwxyz", "num", "other"])


def _lowered(text: Column) -> Column:
    """Only A-Z are lower-cased, as lower() would make ASCII letters of others."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def tokenize(text: Column) -> Column:
    """ASCII letter and digit runs, lower-cased."""
    return F.array_remove(F.split(_lowered(text), "[^a-z0-9]+"), "")


def occurrences(text: Column, terms: list[str]) -> Column:
    """The words of tokenize() that are among the terms, each as often as it comes, without an array of all words."""
    words = "|".join(t for t in terms if re.fullmatch("[a-z0-9]+", t))
    if not words:
        return F.array().cast("array<string>")
    return F.regexp_extract_all(_lowered(text), F.lit(f"(?<![a-z0-9])(?:{words})(?![a-z0-9])"), F.lit(0))


def parse_query(text: Column) -> Column:
    """The distinct terms, in order of first occurrence."""
    return F.array_distinct(tokenize(text))


def query_terms(query: str) -> list[str]:
    return list(dict.fromkeys(t.lower() for t in re.findall(TERM, query or "")))


def bucket(word: Column) -> Column:
    first = F.lower(F.substring(word, 1, 1))
    # lower() may make two characters of one.
    one = F.char_length(first) == 1
    return F.when(one & first.between("a", "z"), first).when(one & first.between("0", "9"), "num").otherwise("other")


def bucket_of(word: str) -> str:
    first = word[:1].lower()
    return first if "a" <= first <= "z" and first.isascii() else "num" if first in set("0123456789") - {""} else "other"


def relevance(frequency: Column, depth: Column) -> Column:
    return frequency * 10 + 1000 - depth * 5
