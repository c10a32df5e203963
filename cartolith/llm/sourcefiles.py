"""Source files that nobody wrote by hand: tool output, minified code, third-party copies, data saved as code.

Four kinds of evidence, all over whole tables:

* the path: folders and names that tools, package managers and build systems use;
* statements in full-line comments that a tool made the file, or that it came from elsewhere;
* an inverted index of line hashes: the rarest lines of a file lead to every file of any project that may hold the
  rest, and exact containment over all lines decides;
* the composition of the tokens: line lengths, white space, numbers and encoded text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.runtime import Staged, small_side

#: Share of a file's lines that its source must hold, and the least number of lines that count.
CONTAINED, LEAST_LINES = 0.8, 6
#: Equal content in so many projects (with LEAST_COPIED lines) comes from outside.
COPY_PROJECTS, LEAST_COPIED = 3, 10
#: Of the shared lines so many must be uncommon: in at most this share of the groups of copies that are not third-party (or so many).
LEAST_RARE, RARE_SHARE, RARE_FILES = 3, 0.001, 3
#: Unmarked holders of a line that are compared first, and holders of a line that one task takes.
FIRST_HOLDERS, HOLDERS_A_PART = 8, 1000
#: Pairs for each content whose lines are compared at a time; each moves the lines of a file.
PAIRS_AT_ONCE = 2
#: Shorter lines say nothing about origin.
LINE_CHARS = 12

# Names that tools, package managers and build systems give to folders and files.
THIRD_PARTY_DIRS = r"(?:^|/)(?:node_modules|bower_components|jspm_packages|vendor|vendored|third[_-]?party|3rd[_-]?party|external|externals|extern|deps|site-packages|dist-packages|pods|carthage|libs/contrib|godeps)/"
OUTPUT_DIRS = r"(?:^|/)(?:__generated__|generated|generated-sources|generated-src|autogen|[a-z0-9_]*_autogen|cmakefiles|cmake-build-[a-z]+|\.next|\.nuxt|\.svelte-kit|\.gradle|__pycache__)/|^(?:build|dist|out|target|obj|bazel-(?:out|bin))/|(?:^|/)build/gen/"
OUTPUT_NAMES = (
    r"(?:^|/)(?:(?:moc|ui|qrc)_[^/]+\.(?:cpp|cc|cxx|h|hpp)|[^/]+\.pb\.(?:cc|h|go)|[^/]+_pb2(?:_grpc)?\.pyi?|[^/]+\.(?:min|bundle|chunk)\.(?:js|ts|css|mjs)|"
    r"[^/]+\.(?:generated|gen|g|designer|autogen)\.[a-z]+|(?:package-lock|npm-shrinkwrap|composer\.lock|pipfile\.lock)(?:\.json)?|yarn\.lock|[^/]+-[0-9a-f]{8,}\.(?:js|css|mjs))$"
)
_COMMENT = r"(?im)^[ \t]*(?://+[!/]?|#+|/\*+!?|\*+|<!--|--|;+|%+)[ \t]*"
GENERATED = (
    _COMMENT + r"[^\n]*?(?:(?<!the )(?<!the auto)(?:@generated\b|<auto-?generated|\bauto-?generated (?:file|code|by|from)|automatically generated (?:by|from|file|code)|generated automatically|"
    r"(?:code|file|source) (?:is |was )?generated (?:by|from|with)\b|generated (?:by|from|with) [^\n]*do not (?:edit|modify)|(?:hand|manual) edits (?:are|will be) (?:overwritten|lost)|changes (?:\w+ )*will be (?:lost|overwritten)|"
    r"do not edit (?:this file )?(?:by hand|manually)[^\n]*generated)|自动生成|自動生成|wurde von [^\n]* (?:erzeugt|generiert)|automatisch (?:erzeugt|generiert)|généré automatiquement|generado automáticamente|gerado automaticamente|сгенерирован)"
)
#: A foreign name with a version beside a licence, an origin or other authors.
_VERSION = r"\bv?\d+\.\d+(?:\.\d+)?\b"
FOREIGN = (
    _COMMENT + r"(?:[^\n]*(?:local|vendored|verbatim|modified) copy of \S+[^\n]*" + _VERSION + r"|[^\n]*\b(?:imported|copied|taken|vendored|adapted|derived) (?:unchanged |verbatim )?from [^\n]*(?:release|version|upstream|" + _VERSION + r")|"
    r"[^\n]*" + _VERSION + r"[^\n]*(?:\(c\)|©|copyright|licen[sc]ed?\b)[^\n]*|[^\n]*licen[sc]e[^\n]*(?:of the|see the|from) upstream|[^\n]*copyright [^\n]*\bcontributors\b)"
)
#: Java marks what annotation processors write.
GENERATED_ANNOTATION = r"(?m)^[ \t]*@(?:javax?\.|jakarta\.)?(?:annotation\.)?(?:processing\.)?Generated\b"


def path_evidence(path: Column) -> Column:
    """'third-party', 'output' or null."""
    p = F.lower(F.regexp_replace(path, r"\\", "/"))
    return F.when(p.rlike(THIRD_PARTY_DIRS), "third-party").when(p.rlike(OUTPUT_DIRS) | p.rlike(OUTPUT_NAMES), "output")


def statement_evidence(content: Column) -> Column:
    return F.when(content.rlike(FOREIGN), "third-party").when(content.rlike(GENERATED) | content.rlike(GENERATED_ANNOTATION), "output")


def composition_evidence(path: Column, content: Column) -> Column:
    """'minified' for long lines nearly without space, 'data' for numbers or encoded text in place of code."""
    chars, lines = F.length(content), F.regexp_count(content, F.lit("\n")) + 1
    spaces = F.regexp_count(content, F.lit(r"\s"))
    numbers, words = F.regexp_count(content, F.lit(r"(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?!\w)")), F.regexp_count(content, F.lit(r"[A-Za-z_]\w*"))
    encoded = chars - F.length(F.regexp_replace(content, r"[A-Za-z0-9+/=]{40,}|(?:\\x[0-9a-fA-F]{2}){10,}", ""))
    minified = (chars >= 400) & (chars / lines >= 200) & (spaces / chars <= 0.1) & ~F.lower(path).endswith(".json")
    data = ((numbers >= 80) & (numbers >= 3 * (words - F.regexp_count(content, F.lit(r"0[xX][0-9a-fA-F]+"))))) | ((encoded >= 400) & (encoded >= 0.6 * chars))
    return F.when(data, "data").when(minified, "minified")


def line_hashes(content: Column) -> Column:
    """Distinct hashes of the lines without white space that are long enough to say something."""
    squeezed = F.transform(F.split(content, "\n"), lambda x: F.regexp_replace(x, r"\s+", ""))
    return F.array_distinct(F.transform(F.filter(squeezed, lambda x: F.length(x) >= LINE_CHARS), lambda x: F.xxhash64(x)))


def contained_pairs(pairs: DataFrame, lined: DataFrame) -> DataFrame:
    """The (class_id, source) of pairs where the source holds CONTAINED of all lines of the class, with the columns of
    both and the shared lines."""
    mine = lined.select("class_id", "n", "lo", "hi", F.col("hashes").alias("own"))
    theirs = lined.select(F.col("class_id").alias("source"), F.col("n").alias("m"), F.col("foreign").alias("marked"), "projects", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("hashes").alias("held"))
    both = pairs.join(mine, "class_id").join(theirs, "source").withColumn("shared", F.array_intersect("own", "held"))
    return both.where(F.size("shared") >= CONTAINED * F.col("n") - 1e-9).drop("own", "held")


def compared(pairs: Staged, classes: Staged) -> list[Staged]:
    """contained_pairs of all pairs, in as many turns as keep to PAIRS_AT_ONCE what is moved at a time."""
    turns = max(1, -(-pairs.count() // (PAIRS_AT_ONCE * max(1, classes.count()))))
    own = lambda k: pairs.df.where(F.pmod(F.xxhash64("class_id"), F.lit(turns)) == k) if turns > 1 else pairs.df
    return [Staged(contained_pairs(own(k), classes.df), "contained") for k in range(turns)]


def settled_classes(contained: DataFrame, telling: DataFrame) -> DataFrame:
    """class_id of those contained in a marked file, or whose content and its containers stand in COPY_PROJECTS projects.
    telling: class_id, rare (its lines that say something about origin)."""
    sure = contained.join(telling, "class_id").where(F.size(F.array_intersect("shared", "rare")) >= LEAST_RARE)
    wide = sure.where(F.col("marked") | ((F.col("n") >= LEAST_COPIED) & (F.col("projects") >= COPY_PROJECTS))).select("class_id")
    stood = sure.where(~F.col("marked") & (F.col("n") >= LEAST_COPIED)).select("class_id", F.explode(F.array("lo", "hi", "lo2", "hi2")).alias("p"))
    return wide.unionByName(stood.groupBy("class_id").agg(F.count_distinct("p").alias("k")).where(F.col("k") >= COPY_PROJECTS).select("class_id")).distinct()


def _needed(n: Column) -> Column:
    """Lines that the source of a file of n lines must hold."""
    return F.ceil(CONTAINED * n - 1e-9)


def line_bits(hashes: Column) -> Column:
    """A bit for each line, perhaps the same for several. Bits of a file that its source lacks are lines that it lacks."""
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda bits, x: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(x, F.lit(64)).cast("int"))))


def likely(leading: DataFrame, holders: DataFrame, on: list[str]) -> DataFrame:
    """Distinct (class_id, source) that share a line and of which the bits permit that the source holds CONTAINED of the
    lines. leading: class_id, n, bits, on; holders: source, m, held_bits, on. What is dropped here is never moved."""
    lacking = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not("held_bits")))
    fits = (F.col("class_id") != F.col("source")) & (F.col("m") >= _needed(F.col("n"))) & (lacking <= F.col("n") - _needed(F.col("n")))
    return leading.join(holders, on).where(fits).select("class_id", "source").distinct()


def line_groups(counts: DataFrame, heads: DataFrame, lined: DataFrame) -> DataFrame:
    """(line, df, groups): counts with the groups of copies that hold a line: its holders that are not third-party, where those
    of one head count once, and with the head. Only lines of copies and heads are moved for it."""
    under = heads.join(lined.select("class_id", "hashes"), "class_id").select(F.col("head").alias("group"), F.explode("hashes").alias("line"), F.lit(1).alias("copies"))
    own = lined.where(~F.col("foreign")).join(heads.select(F.col("head").alias("class_id")).distinct(), "class_id", "left_semi").join(heads, "class_id", "left_anti")
    own = own.select(F.col("class_id").alias("group"), F.explode("hashes").alias("line"), F.lit(0).alias("copies"))
    each = under.unionByName(own).groupBy("line", "group").agg(F.sum("copies").alias("copies"), F.bool_or(F.col("copies") == 0).alias("head_holds"))
    fewer = each.groupBy("line").agg(F.sum(F.col("copies") - F.when((F.col("copies") > 0) & ~F.col("head_holds"), 1).otherwise(0)).alias("fewer"))
    return counts.join(fewer, "line", "left").select("line", "df", (F.col("plain") - F.coalesce("fewer", F.lit(0))).alias("groups"))


def copied_classes(states: DataFrame, held: Staged) -> DataFrame:
    """class_id of contents (equal but for white space) that equal or are contained in third-party files or stand, each
    perhaps with its own edits, in many projects. states: project_id, class_id, foreign (third-party by path or
    statement), hashes (of its lines); they are read once, then `held`, where they are staged, is dropped.

    A file of n lines whose source holds CONTAINED of them has one of its n - CONTAINED n + 1 rarest lines in the source,
    whatever the others; so these lines lead to every source, and all lines of the pair are compared. Lines that stand
    in many files that are no copies of each other (boilerplate) do not make a copy by themselves: LEAST_RARE others must
    be shared. Copies of one file count once there, however many they are.

    Lines of a growing corpus grow more holders, so pairs that share one grow faster than it; they are judged by their
    bits where they meet, and only those that may be copies are moved. What is staged is dropped when it is not needed."""
    of_class = states.groupBy(F.col("class_id").alias("content_id")).agg(F.max("foreign").alias("foreign"), F.count_distinct("project_id").alias("projects"), F.min("project_id").alias("lo"), F.max("project_id").alias("hi"), F.min("hashes").alias("hashes"))
    # lines are moved several times, so they carry a number of their class and what is asked of it, and nothing else
    bucket = F.when(~F.col("foreign"), F.pmod(F.xxhash64("lo"), F.lit(FIRST_HOLDERS))).cast("tinyint")
    classes = Staged(of_class.withColumn("n", F.size("hashes")).withColumn("class_id", F.monotonically_increasing_id()).withColumn("bucket", bucket).withColumn("bits", line_bits(F.col("hashes"))), "lined")
    held.drop()
    lined = classes.df
    many = lined.where(~F.col("foreign") & (F.col("projects") >= COPY_PROJECTS) & (F.col("n") >= LEAST_COPIED)).select("class_id")
    same = lined.where(F.col("foreign") & (F.col("n") >= LEAST_LINES)).select("class_id")
    line = F.explode("hashes").alias("line")
    own = lined.where(~F.col("foreign") & (F.col("n") >= LEAST_LINES))
    holding = lined.where(F.col("foreign") | (F.col("projects") > 0))
    counted = Staged(lined.select("foreign", line).groupBy("line").agg(F.count(F.lit(1)).alias("df"), F.count_if(~F.col("foreign")).alias("plain")).where("df > 1"), "counts")
    counts = counted.df
    # lines that no other file holds come first, and lead nowhere
    of_file = Window.partitionBy("class_id")
    placed = own.select("class_id", "n", line).join(counts.select("line", "df"), "line").withColumn("place", F.row_number().over(of_file.orderBy("df", "line")) + F.col("n") - F.count(F.lit(1)).over(of_file))
    leads = Staged(placed.where(F.col("place") <= F.col("n") - _needed(F.col("n")) + 1).select("class_id", "line"), "leads")
    leading = leads.df.join(own.select("class_id", "n", "bits"), "class_id")
    # few holders of each line settle most copies; the rest are compared with all holders
    few = holding.select("class_id", "n", "bucket", line).join(leads.df.select("line").distinct(), "line", "left_semi").groupBy("line", "bucket").agg(F.min_by("class_id", F.struct(-F.col("n"), F.col("class_id"))).alias("source"))
    some = Staged(few.select("line", "source").distinct(), "few")
    named = lined.select(F.col("class_id").alias("source"), F.col("n").alias("m"), F.col("bits").alias("held_bits"))
    first = Staged(likely(leading, some.df.join(named, "source"), ["line"]), "first")
    for done in (leads, some):
        done.drop()
    nearest = compared(first, classes)
    first.drop()
    near = reduce(DataFrame.unionByName, [x.df for x in nearest])
    # files whose first container is the same are one group of copies
    heads = near.groupBy("class_id").agg(F.min(F.struct((-F.col("m")).alias("size"), F.col("source").alias("id"))).alias("head"), (-F.first("n")).alias("size"))
    headed = Staged(heads.where(F.col("head") < F.struct("size", F.col("class_id").alias("id"))).select("class_id", F.col("head.id").alias("head")), "heads")
    limit = F.greatest(F.lit(RARE_FILES), lined.where(~F.col("foreign")).agg(F.count(F.lit(1)) * RARE_SHARE).scalar())
    uncommon = Staged(line_groups(counts, headed.df, lined).where(F.col("groups") <= limit).select("line", "df"), "uncommon")
    mine = own.select("class_id", "n", line).join(uncommon.df, "line").groupBy("class_id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "line"))).alias("rare")).where(F.size("rare") >= LEAST_RARE)
    # LEAST_RARE of these lines are shared, so all but LEAST_RARE - 1 of them lead to every source as well
    lead = F.slice("rare", 1, F.least(F.size("rare") - (LEAST_RARE - 1), F.col("n") - _needed(F.col("n")) + 1).cast("int"))
    known = Staged(mine.select("class_id", F.col("rare.line").alias("rare"), lead.alias("lead")), "telling")
    telling = known.df.select("class_id", "rare")
    early = Staged(settled_classes(near, telling), "early")
    heavy = Staged(counts.where(F.col("df") > HOLDERS_A_PART).select("line", F.ceil(F.col("df") / HOLDERS_A_PART).alias("parts")), "heavy")
    for done in (*nearest, headed, uncommon, counted):
        done.drop()
    parts = F.coalesce("parts", F.lit(1).cast("bigint"))  # lines held by many are spread
    spread = holding.select(F.col("class_id").alias("source"), F.col("n").alias("m"), F.col("bits").alias("held_bits"), line).join(small_side(heavy), "line", "left").withColumn("part", F.pmod(F.xxhash64("source"), parts)).drop("parts")
    rest = known.df.select("class_id", F.inline("lead")).join(early.df, "class_id", "left_anti").join(own.select("class_id", "n", "bits"), "class_id")
    rest = rest.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("df") / HOLDERS_A_PART) - 1))).drop("df")
    every = Staged(likely(rest, spread, ["line", "part"]), "every")
    others = compared(every, classes)
    every.drop()
    late = Staged(settled_classes(reduce(DataFrame.unionByName, [x.df for x in others]), telling), "late")
    found = early.df.unionByName(late.df).unionByName(many).unionByName(same).distinct()
    copied = Staged(lined.select("class_id", "content_id").join(found, "class_id", "left_semi").select(F.col("content_id").alias("class_id")), "copied")
    for done in (*others, late, early, known, heavy, classes):
        done.drop()
    return copied.df


def judged_states(files: DataFrame) -> DataFrame:
    """(project_id, path, by_path, by_text, foreign, class_id, hashes) of each file's newest state.

    Texts are searched where they are read; what is moved to find the newest state are the verdicts and line hashes."""
    body = F.col("content")
    rows = files.where(F.col("path").isNotNull()).select(
        "project_id", "path", "modification_time", "scanned_at", F.unhex(F.md5(body)).alias("digest"), F.when(F.length(body) > 0, F.coalesce(statement_evidence(body), composition_evidence(F.col("path"), body))).alias("by_text"),
        F.when(F.length(body) > 0, F.unhex(F.md5(F.regexp_replace(body, r"[\s﻿]+", "")))).alias("class_id"), line_hashes(body).alias("hashes"))
    last = rows.groupBy("project_id", "path").agg(F.max(F.struct("modification_time", "scanned_at", "digest", "by_text", "class_id", "hashes")).alias("s"))
    states = last.select("project_id", "path", path_evidence(F.col("path")).alias("by_path"), "s.by_text", "s.class_id", "s.hashes")
    foreign = F.coalesce((F.col("by_path") == "third-party") | (F.col("by_text") == "third-party"), F.lit(False))
    return states.withColumn("foreign", foreign)


def machine_files(files: DataFrame) -> DataFrame:
    """(project_id, path, reason, evidence): files that are tool output, minified, third-party or data, and whether the
    path, a statement or composition of the text, or lines shared with other files told so.

    The newest state of a path counts; of equal times the one with the greatest scan time and MD5 of its content. Files
    with null or empty content are judged by path alone. Rows with a null path are ignored, repeated rows count once, a
    null project is a project of its own (but none of those that COPY_PROJECTS counts)."""
    judged = Staged(judged_states(files), "judged")
    verdicts = Staged(judged.df.drop("hashes", "foreign"), "verdicts").df
    copied = copied_classes(judged.df.where("class_id IS NOT NULL"), judged)
    marked = verdicts.join(copied.withColumn("copied", F.lit("third-party")), "class_id", "left")
    evidence = F.when(F.col("by_path").isNotNull(), "path").when(F.col("by_text").isNotNull(), "text").otherwise("lines")
    return marked.withColumn("reason", F.coalesce("by_path", "by_text", "copied")).where("reason IS NOT NULL").select("project_id", "path", "reason", evidence.alias("evidence"))


def normal_path(path: Column, root: Column) -> Column:
    """A path as files spells it: forward slashes, without root, leading ./ and doubled separators."""
    p, r = F.regexp_replace(path, r"\\", "/"), F.regexp_replace(F.regexp_replace(root, r"\\", "/"), "/+$", "")
    p = F.when(r.isNotNull() & (r != "") & F.startswith(p, F.concat(r, F.lit("/"))), F.substring(p, F.length(r) + 2, F.length(p))).otherwise(p)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"/(?:\./)+", "/"), "//+", "/"), r"^(?:\./)+", "")


def hand_written(files: DataFrame, nodes: DataFrame, report: DataFrame) -> DataFrame:
    """Distinct (project_id, path) of the files that nodes and the analysis report name and that remain as source.
    A named path without a row in files is judged by the path."""
    named = nodes.select("project_id", F.col("file_path").alias("path")).unionByName(report.select("project_id", normal_path(F.col("file_path"), F.col("root_path")).alias("path")))
    named = named.where(F.col("path").isNotNull() & path_evidence(F.col("path")).isNull()).distinct()
    machine = machine_files(files).select(F.col("project_id").alias("p"), F.col("path").alias("q"))
    return named.join(machine, F.col("project_id").eqNullSafe(F.col("p")) & (F.col("path") == F.col("q")), "left_anti")
