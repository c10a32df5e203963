"""JSON replies of assistants: fences, balanced objects, message contents, annotations."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.functions.text import strip_code_fence


_OUTSIDE, _IN_STRING = re.compile('["{}]'), re.compile(r'\\.|"', re.S)


def first_object(text: str | None) -> str | None:
    """The first balanced JSON object of a text, mindful of strings and escapes; the text from its first brace if it
    never closes; None without one."""
    at = (text or "").find("{")
    if at < 0:
        return None
    depth, quoted, pos = 0, False, at
    while m := (_IN_STRING if quoted else _OUTSIDE).search(text, pos):
        pos = m.end()
        if m[0] == '"':
            quoted = not quoted
        elif not quoted:
            depth += 1 if m[0] == "{" else -1
            if depth == 0:
                return text[at:pos]
    return text[at:].strip()


def _objects(text: pd.Series) -> pd.Series:
    return text.map(first_object)


def first_json_object(text: Column) -> Column:
    """Balanced braces are no regular language, so this is an Arrow function."""
    return F.pandas_udf(_objects, "string")(text)


def message_content(reply: Column) -> Column:
    """The text of a reply in any of the usual shapes; a list of parts gives its texts, one a line."""
    v = F.try_parse_json(reply)
    paths = ["$.choices[0].message.content", "$.choices[0].text", "$.output_text", "$.candidates[0].content.parts[0].text", "$.content", "$.message", "$.text", "$.data.content", "$.data.data.content"]
    parts = F.array_join(F.transform(F.try_variant_get(v, "$.choices[0].message.content", "array<struct<type: string, text: string>>"), lambda p: p["text"]), "\n")
    plain = [F.when(~F.startswith(x := F.try_variant_get(v, p, "string"), F.lit("[")) & ~F.startswith(x, F.lit("{")), x) for p in paths]
    return F.coalesce(plain[0], F.nullif(parts, F.lit("")), *plain[1:])


INSIGHT = "summary string, responsibility string, confidence string, steps array<string>, risks array<string>"


def insight(text: Column) -> Column:
    """A typed record of an insight object; lists trimmed, without blanks and repeats."""
    r = F.from_json(strip_code_fence(text), INSIGHT)
    clean = lambda a: F.array_distinct(F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != ""))
    return F.struct(r["summary"].alias("summary"), r["responsibility"].alias("responsibility"), r["confidence"].alias("confidence"), clean(r["steps"]).alias("steps"), clean(r["risks"]).alias("risks"))


def annotations(df: DataFrame, text: str) -> DataFrame:
    """(id, label, summary) of batch replies: a list under `nodes` or `annotations`, ids as numbers or strings; items
    without an id or without any text are dropped."""
    item = "array<struct<id: string, label: string, summary: string>>"
    r = F.from_json(strip_code_fence(F.col(text)), f"nodes {item}, annotations {item}")
    rows = df.select(F.explode(F.coalesce(r["nodes"], r["annotations"])).alias("a"))
    out = rows.select(F.try_to_number("a.id", F.lit("9999999999999999999")).cast("bigint").alias("id"), F.coalesce(F.trim("a.label"), F.lit("")).alias("label"), F.coalesce(F.trim("a.summary"), F.lit("")).alias("summary"))
    return out.where("id IS NOT NULL AND (label <> '' OR summary <> '')")


def annotate(nodes: DataFrame, notes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """nodes with non-empty values of the notes in place of their own."""
    n = notes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = nodes.join(n, key, "left")
    return joined.select(*[F.coalesce(F.when(F.col(f"__{c}") != "", F.col(f"__{c}")), F.col(c)).alias(c) if c in columns else F.col(c) for c in nodes.columns])
