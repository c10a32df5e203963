"""Files that do not parse as the language of their extension.

Every file is lexed into the symbols of its bracket groups, inner groups reduced to one symbol; the distinct groups of a
file are a row of a table. Their neighbouring symbols are anti-joined with the pairs that the language's grammar permits,
and every group is matched against the grammar's productions. A pair or group that fails makes its file invalid. Python
and JSON files are parsed by the language's own parser too, whose word is final.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm import grammar
from cartolith.llm.lexing import LANGUAGES, lex
from cartolith.runtime import Staged, balanced

_LANGS = sorted(set(LANGUAGES.values()))


def language(path) -> F.Column:
    """The language of a path's extension, null if it is none of those checked."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    out = F.lit(None).cast("string")
    for name in _LANGS:
        out = F.when(ext.isin([e for e, lang in LANGUAGES.items() if lang == name]), F.lit(name)).otherwise(out)
    return out


_COMMA = grammar.symbol(",")
_REPEATED = re.compile(f"((?:[^{_COMMA}]){{1,12}}{_COMMA})(?:\\1){{2,}}")


def groups(tokens: list[tuple[str, int]]) -> set[str]:
    """The distinct bracket groups of a file's tokens, the top level between ^ and $. A group that is not closed is cut
    short, and a bracket too many stands for itself. An element repeated three times or more in a list stands twice:
    lists of two and of more elements have the same form."""
    found: set[str] = set()
    stack: list[list[str]] = [["^"]]
    for kind, step in tokens:
        stack[-1].append(grammar.symbol(grammar.GROUPS[kind] if step > 0 else kind))
        if step > 0:
            stack.append([grammar.symbol(kind)])
        elif step < 0:
            found.add(_REPEATED.sub(r"\1\1", "".join(stack.pop())))
            if not stack:
                return found
    stack[-1].append("$")
    return found | {_REPEATED.sub(r"\1\1", "".join(s)) for s in stack}


def _constant(name: str):
    raise ValueError(name)


def parses(text: str, lang: str) -> bool | None:
    """The verdict of the language's own parser; None if it has none or the text is too deep for it."""
    if lang not in ("python", "json"):
        return None
    try:
        text = text.removeprefix("\ufeff")
        ast.parse(text) if lang == "python" else json.loads(text, parse_constant=_constant)
        return True
    except (SyntaxError, ValueError):
        return False
    except (RecursionError, MemoryError):
        return None


_LEXED = "project_id string, path string, modification_time timestamp, scanned_at timestamp, language string, digest binary, groups array<string>, parsed boolean"


def _lex(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    warnings.simplefilter("ignore")
    for pdf in batches:
        digests, all_groups, parsed = [], [], []
        for lang, text in zip(pdf["language"], pdf["content"]):
            if text is None:
                digests.append(None)
                all_groups.append(None)
                parsed.append(None)
                continue
            digests.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
            tokens = lex(text, lang)
            all_groups.append(sorted(groups(tokens)) if tokens or lang != "json" else ["^" + grammar.symbol("ERR") + "$"])
            parsed.append(parses(text, lang))
        out = pdf[["project_id", "path", "modification_time", "scanned_at", "language"]].copy()
        out["digest"], out["groups"], out["parsed"] = digests, all_groups, pd.Series(parsed, dtype="object", index=pdf.index)
        yield out


def lexed(files: DataFrame) -> DataFrame:
    """One row per row of files with a language: its times, language, the groups of its tokens and what its own parser
    says; null for null content."""
    body = files.where(F.col("path").isNotNull()).select("project_id", "path", "modification_time", "scanned_at", language(F.col("path")).alias("language"), "content").where("language IS NOT NULL")
    return balanced(body, "project_id", "path", "modification_time").mapInPandas(_lex, _LEXED)


def _permitted(spark: SparkSession) -> DataFrame:
    """Some thousand rows, by the size of the grammars."""
    return spark.createDataFrame([(lang, p) for lang in _LANGS for p in sorted(grammar.pairs(lang))], "language string, pair string")


def _well_formed(lang: pd.Series, all_groups: pd.Series) -> pd.Series:
    return pd.Series([all(grammar.valid_group(n, g) for g in found) for n, found in zip(lang, all_groups)], dtype=bool)


def faulty(rows: DataFrame) -> DataFrame:
    """(row) of those with a pair of neighbours that no production allows, or a group that matches none.
    rows: row, language, groups."""
    pairs_of = lambda g: F.transform(F.sequence(F.lit(1), F.length(g) - 1), lambda i: F.substring(g, i, F.lit(2)))
    neighbours = F.array_distinct(F.flatten(F.transform(F.filter("groups", lambda g: F.length(g) > 1), pairs_of)))
    pairs = rows.select("row", "language", F.explode(neighbours).alias("pair")).where(~F.col("pair").rlike(r"^\^|\$$"))
    well_formed = F.pandas_udf(_well_formed, "boolean")
    strange = pairs.join(F.broadcast(_permitted(rows.sparkSession)), ["language", "pair"], "left_anti").select("row")
    return strange.unionByName(rows.where(F.col("groups").isNotNull() & ~well_formed("language", "groups")).select("row")).distinct()


def judged_files(files: DataFrame) -> DataFrame:
    """(project_id, path, language, valid): the newest state of each file; valid is null for null content.

    Of equal times the state with the greatest scan time and SHA-256 of its content counts. Texts are lexed where they
    are read; what is moved to find the newest state are verdicts."""
    rows = Staged(lexed(files).withColumn("row", F.monotonically_increasing_id()), "lexed").df
    last = rows.groupBy("project_id", "path", "language").agg(F.max(F.struct("modification_time", "scanned_at", "digest", "row", "parsed")).alias("s"))
    last = last.select("project_id", "path", "language", "s.row", "s.parsed", F.col("s.digest").isNotNull().alias("held"))
    marked = last.join(faulty(rows.select("row", "language", "groups")).withColumn("bad", F.lit(True)), "row", "left")
    return marked.select("project_id", "path", "language", F.when(F.col("held"), F.coalesce("parsed", F.col("bad").isNull())).alias("valid"))


def invalid_files(files: DataFrame) -> DataFrame:
    """(project_id, path) of the files whose newest content is not valid in the language of the extension.

    An empty file is valid except in JSON, a leading byte-order mark is allowed, null content is no case. Rows with a
    null path are ignored, a null project is a project of its own, repeated rows count once. Other extensions give no
    row. Extra columns are ignored."""
    return judged_files(files).where("NOT valid").select("project_id", "path")


def file_status(files: DataFrame, parse_results: DataFrame) -> DataFrame:
    """(project_id, path, language, valid, attempts, reported): each file's own verdict beside the number of its parse
    attempts and what the last of them reported (null if there is none). valid is null where there is no content."""
    states = judged_files(files)
    last = parse_results.groupBy(F.col("project_id").alias("p"), F.col("file_path").alias("q")).agg(F.countDistinct("attempt").alias("attempts"), F.max_by("succeeded", F.struct("attempt", "parsed_at")).alias("reported"))
    out = states.join(last, F.col("project_id").eqNullSafe(F.col("p")) & (F.col("path") == F.col("q")), "left")
    return out.select("project_id", "path", "language", "valid", F.coalesce("attempts", F.lit(0)).alias("attempts"), "reported")


def invalid_rates(files: DataFrame, parse_results: DataFrame) -> DataFrame:
    """(project_id, language, files, invalid, rate) over files with content."""
    status = file_status(files, parse_results).where("valid IS NOT NULL")
    return status.groupBy("project_id", "language").agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("valid")).alias("invalid")).withColumn("rate", F.col("invalid") / F.col("files"))
