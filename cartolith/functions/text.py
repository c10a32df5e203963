"""String and list functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def humanize(s: Column) -> Column:
    """Separators to spaces and the first letter of each word in upper case; other letters stay."""
    words = F.split(F.translate(s, "_/-.", "    "), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100000))), " ")


def split_camel(s: Column) -> Column:
    return F.regexp_replace(s, r"([a-z0-9])([A-Z])", "$1 $2")


def collapse_spaces(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def clip(s: Column, limit: int) -> Column:
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.substring(s, 1, limit - 3), F.lit("...")))


def compact_identifier(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9A-Za-z_]", "")


def identifier_tokens(s: Column) -> Column:
    """Distinct lower-case words of three letters or more, in order."""
    words = F.split(F.lower(F.regexp_replace(split_camel(s), "[^0-9A-Za-z]+", " ")), " ")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))


def first_k(values: Column, k: int) -> Column:
    """'a, b, +2 more', 'none' for an empty list."""
    head = F.array_join(F.slice(values, 1, k), ", ")
    return F.when(F.size(values) == 0, "none").when(F.size(values) > k, F.concat(head, F.lit(", +"), (F.size(values) - k).cast("string"), F.lit(" more"))).otherwise(head)


def sorted_distinct(values: Column, k: int = 0) -> Column:
    out = F.array_sort(F.array_distinct(values))
    return F.slice(out, 1, k) if k else out


def union_distinct(a: Column, b: Column, k: int = 0) -> Column:
    out = F.array_distinct(F.concat(a, b))
    return F.slice(out, 1, k) if k else out


def ratio(part: Column, whole: Column) -> Column:
    """Percent with one decimal; 0.0% of nothing."""
    return F.format_string("%.1f%%", F.coalesce(part * F.lit(100.0) / F.nullif(whole, F.lit(0)), F.lit(0.0)))


def polynomial_hash(s: Column) -> Column:
    """h * 131 + code modulo 2^31 - 1 over the characters."""
    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda h, c: F.pmod(h * 131 + F.ascii(c), F.lit(2147483647)))


def strip_code_fence(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(s), r"^```[A-Za-z0-9_-]*[ \t]*\r?\n?", ""), r"\r?\n?```$", ""))


def escape_dot(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def any_token(s: Column, tokens: list[str]) -> Column:
    """Whether the lower-case text holds one of the tokens (letters, digits, / . _ only)."""
    return F.lower(s).rlike("|".join(t.replace(".", r"\.") for t in tokens))
