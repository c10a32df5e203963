"""Path and name functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions, folder names and file names that the analysis distinguishes.
CPP = ".h .hh .hpp .hxx .h++ .c .cc .cpp .cxx .cp .c++ .ipp .inl .tpp .tcc .txx .ixx .cppm .ii .cu .cuh .mm".split()
SCRIPT = ".py .js .mjs .cjs .ts .tsx .mts .cts".split()
WEB = ".html .htm .css".split()
OTHER_RELEVANT = ".qml .json .java .ui .qrc .rc .pro .pri .qbs .qmldir .cmake .s .asm .def".split()
DEPENDENCY_DIRS = "third_party thirdparty 3rdparty external vendor vendors deps dependency dependencies".split()
BUILD_DIRS = "cmake-build-debug cmake-build-release cmake-build-relwithdebinfo cmake-build-minsizerel cmakefiles _deps autogen .cmake testing ctesttestfile x64 x86 debug release relwithdebinfo minsizerel __pycache__ .mypy_cache node_modules .m2 .mvn target .gradle dist out .next .nuxt build .qt .git .idea .vscode .qtc_clangd .cache cache".split()
BRIDGE_DIRS = "src source sources include includes inc impl implementation lib libs code".split()
GROUPED_ROOTS = "apps src tests samples docs include".split()
MANIFESTS = "cmakelists.txt package.json pom.xml build.gradle build.gradle.kts settings.gradle settings.gradle.kts gradlew".split()
BOOTSTRAPS = "main.cpp main.cc main.cxx main.cp main.c++ main.cppm main.ixx main.mm main.c main.js main.mjs main.cjs index.js index.mjs index.cjs app.js app.mjs app.cjs server.js server.mjs server.cjs".split()


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def file_name(path: Column) -> Column:
    return F.lower(F.coalesce(F.try_element_at(segments(path), F.lit(-1)), F.lit("")))


def extension(path: Column) -> Column:
    """From the last dot, lower case, '' without one; the dot may stand in a folder's name."""
    return F.lower(F.when(F.instr(path, ".") > 0, F.concat(F.lit("."), F.substring_index(path, ".", -1))).otherwise(""))


def stem(name: Column) -> Column:
    """A file name without its last extension; a leading dot alone is part of the stem."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def folder_key(name: Column) -> Column:
    return F.substring_index(name, "/", 1)


def parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def normalize(path: Column) -> Column:
    """Forward slashes, without . segments and with every a/../ folded; .. that leads out of the root stays."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"(^|/)(?:\./)+", "$1")
    parts = F.split(p, "/")
    real = lambda acc: (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != "..") & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != "")
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when((x == "..") & real(acc), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.when(F.contains(p, F.lit("..")), F.array_join(folded, "/")).otherwise(p)


def extension_class(path: Column) -> Column:
    e = extension(path)
    return F.when(e == ".qml", "qml").when(e.isin(*WEB), "web").when(e.isin(*SCRIPT), "script").when(e == ".json", "data").when(e.isin(*CPP), "cpp").otherwise("none")


def language(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin(*CPP), "cpp").when(e == ".py", "python").when(e == ".java", "java").when(e.isin(".js", ".mjs", ".cjs"), "javascript").when(e.isin(".ts", ".tsx", ".mts", ".cts"), "typescript").when(e == ".qml", "qml").when(e == ".json", "json").otherwise("other")


def is_manifest(name: Column) -> Column:
    return name.isin(*MANIFESTS) | name.rlike(r"\.(pro|pri)$")


def is_bootstrap(name: Column) -> Column:
    return name.isin(*BOOTSTRAPS) | is_manifest(name) | name.rlike(r"\.(qrc|rc)$")


def is_relevant(path: Column) -> Column:
    return extension(path).isin(*CPP, *SCRIPT, *WEB, *OTHER_RELEVANT) | is_manifest(file_name(path))


def is_generated_name(path: Column) -> Column:
    n = file_name(path)
    return (
        n.isin("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb") | n.rlike("^(moc_|qrc_|ui_|cmake)")
        | n.rlike(r"qmltyperegistrations|qmlcache_loader|compilerid|featuretest|feature_tests") | n.rlike(r"(\.pb\.h|\.pb\.cc|\.generated\.h|\.designer\.cs|_p\.h|\.pyc|\.pyo)$")
    )


def is_dependency_segment(segment: Column) -> Column:
    s = F.lower(segment)
    return s.isin(*DEPENDENCY_DIRS) | s.rlike("qxlsx|vendor|dependency")


def pruned_at(path: Column, third_party: bool = False) -> Column:
    """The first folder of a path that a scan does not enter, null if it enters all. Third-party folders are left out
    at the root only, and not at all if third_party is set."""
    dirs = F.slice(segments(path), 1, F.greatest(F.size(segments(path)) - 1, F.lit(0)))
    low = F.transform(dirs, lambda s, i: F.struct(F.lower(s).alias("s"), i.alias("i")))
    hit = F.filter(low, lambda d: d["s"].isin(*BUILD_DIRS) | d["s"].rlike(r"^(cmake-build-|qtcreator-|msvc|\.qt)") | (F.lit(not third_party) & (d["i"] == 0) & is_dependency_segment(d["s"])))
    return F.try_element_at(hit, F.lit(1))["s"]


def directory_like(segment: Column) -> Column:
    return F.instr(segment, ".") == 0
