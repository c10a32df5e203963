"""Facts from source lines: imports, includes, symbols, clues. One row per line in, one row per fact out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.functions.paths import CPP, extension, language


def _kept(name: Column) -> Column:
    return F.when(name != "", name)


def cpp_includes(lines: DataFrame) -> DataFrame:
    """(…, target, is_system): #include with quotes or angle brackets, the closing sign matching the opening one."""
    hit = r'^\s*#\s*include\s*(?:"([^"]*)"|<([^>]*)>)'
    quoted, angled = F.regexp_extract("line", hit, 1), F.regexp_extract("line", hit, 2)
    rows = lines.where(extension(F.col("path")).isin(*CPP) & F.col("line").rlike(hit))
    return rows.select("project_id", "path", "line_no", F.when(quoted != "", quoted).otherwise(angled).alias("target"), (quoted == "").alias("is_system")).where("target <> ''")


def imports(lines: DataFrame) -> DataFrame:
    """(…, language, name, specifier) of Python, Java and script lines; the first name of a line only.

    Python keeps the first segment of the module without relative dots; Java the last segment as name; scripts what
    follows the last `from ` or the first `require(`, even in prose, with the package root as name."""
    line, lang = F.regexp_replace("line", r"^\s+", ""), language(F.col("path"))
    plain = F.regexp_extract(line, r"^import ([^ ,.]*)", 1)
    module = F.regexp_replace(F.regexp_extract(line, r"^from (.*?) import ", 1), r"^\.+", "")
    python = F.coalesce(_kept(plain), _kept(F.substring_index(module, ".", 1)))
    java = _kept(F.trim(F.substring_index(F.regexp_extract(line, r"^import (?:static )?(.*)$", 1), ";", 1)))
    last_from = F.when(F.instr(line, "from ") > 0, F.regexp_replace(F.substring_index(line, "from ", -1), "^['\" ]+", ""))
    required = F.when(F.instr(line, "require(") > 0, F.regexp_replace(F.regexp_extract(line, r"require\((.*)$", 1), "^['\"]+", ""))
    script = F.coalesce(_kept(F.regexp_extract(last_from, "^[^'\"]*", 0)), _kept(F.regexp_extract(required, "^[^'\")]*", 0)))
    root = F.when(F.startswith(script, F.lit("@")), F.substring_index(script, "/", 2)).otherwise(F.substring_index(script, "/", 1))
    is_script = lang.isin("javascript", "typescript")
    spec = F.when(lang == "python", python).when(lang == "java", java).when(is_script, script)
    name = F.when(lang == "python", python).when(lang == "java", F.substring_index(java, ".", -1)).when(is_script, root)
    return lines.select("project_id", "path", "line_no", lang.alias("language"), name.alias("name"), spec.alias("specifier")).where("specifier IS NOT NULL")


def symbols(lines: DataFrame) -> DataFrame:
    """(…, kind, name): class and function declarations; the first rule that a line meets."""
    line, lang = F.regexp_replace("line", r"^\s+", ""), language(F.col("path"))
    part = lambda pattern: F.regexp_extract(line, pattern, 1)
    py_class, py_def = _kept(part(r"^class ([^(:. \t]*)")), _kept(part(r"^def ([^(]*)"))
    any_class, function = _kept(part(r"class ([^ {<]*)")), _kept(part(r"function ([^(]*)"))
    arrow = F.when(F.instr(line, "=>") > 0, _kept(F.rtrim(part(r"^(?:export const |const |let |var )([^=]*)="))))
    script = lang.isin("javascript", "typescript")
    kind = (
        F.when((lang == "python") & py_class.isNotNull(), "class").when((lang == "python") & py_def.isNotNull(), "function").when((lang == "java") & any_class.isNotNull(), "class")
        .when(script & any_class.isNotNull(), "class").when(script & function.isNotNull(), "function").when(script & arrow.isNotNull(), "function")
    )
    name = F.when(lang == "python", F.coalesce(py_class, py_def)).when(lang == "java", any_class).when(script, F.coalesce(any_class, function, arrow))
    return lines.select("project_id", "path", "line_no", kind.alias("kind"), name.alias("name")).where("kind IS NOT NULL")


#: Labels of what a file does and the words that tell it.
SIGNALS = {
    "network": "http|socket|request|client|fetch", "storage": "sqlite|database|query|cache|open(", "logging": "log.|logger|qdebug|console.log",
    "error handling": "try|catch|except|throw", "concurrency": "async|await|thread|mutex", "collection work": "filter|sort|map(|push_back",
}


def behaviour_signals(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(_any(low, words), F.lit(label)) for label, words in SIGNALS.items()]))


def _any(text: Column, words: str) -> Column:
    out = F.lit(False)
    for w in words.split("|"):
        out = out | F.contains(text, F.lit(w))
    return out


def import_clues(lines: DataFrame, k: int = 6) -> DataFrame:
    """(project_id, path, clues): the first k distinct trimmed import or include lines of each file."""
    hit = lines.where(F.col("line").rlike(r"^\s*(#\s*include|import |from |using |package )")).withColumn("t", F.trim("line"))
    first = hit.groupBy("project_id", "path", "t").agg(F.min("line_no").alias("n"))
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("project_id", "path").orderBy("n"))).where(F.col("r") <= k)
    return ranked.groupBy("project_id", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]), " | ").alias("clues"))


_COMPLEX = r"\b(?:if|for|while|switch|case|catch|except|elif)\b|&&|\|\|"


def line_scores(lines: DataFrame, ahead: int = 16) -> DataFrame:
    """(…, score, block): branch signs of a line, and of it with the `ahead` lines after it."""
    scored = lines.withColumn("score", F.regexp_count("line", F.lit(_COMPLEX)))
    w = Window.partitionBy("project_id", "path").orderBy("line_no").rowsBetween(0, ahead)
    return scored.withColumn("block", F.sum("score").over(w)).select("project_id", "path", "line_no", "score", "block")


def brace_depth(lines: DataFrame) -> DataFrame:
    """(…, depth, scope): braces open after each line, and the number of times that the depth has returned to 0."""
    step = F.length("line") - F.length(F.replace("line", F.lit("{"), F.lit(""))) - F.length("line") + F.length(F.replace("line", F.lit("}"), F.lit("")))
    w = Window.partitionBy("project_id", "path").orderBy("line_no")
    deep = lines.withColumn("step", step).withColumn("depth", F.sum("step").over(w))
    closed = F.when((F.col("depth") == 0) & (F.col("step") < 0), 1).otherwise(0)
    return deep.withColumn("scope", F.sum(closed).over(w)).select("project_id", "path", "line_no", "depth", "scope")


def anchors(scored: DataFrame, least: int = 3, apart: int = 6) -> DataFrame:
    """(project_id, path, line_no): lines by falling block score, each at least `apart` lines from those taken before.

    Greedy suppression is sequential in a file: a fold over the file's sorted candidates."""
    cand = scored.where(F.col("block") >= least).groupBy("project_id", "path").agg(F.array_sort(F.collect_list(F.struct((-F.col("block")).alias("s"), "line_no"))).alias("c"))
    empty = F.array().cast("array<int>")
    taken = F.aggregate("c", empty, lambda acc, x: F.when(F.exists(acc, lambda y: F.abs(y - x["line_no"]) < apart), acc).otherwise(F.concat(acc, F.array(x["line_no"].cast("int")))))
    return cand.select("project_id", "path", F.explode(taken).alias("line_no"))
