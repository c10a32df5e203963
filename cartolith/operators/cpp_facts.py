"""Scoped symbols and call sites of C and C++ files.

A file is scanned token by token with a stack of open braces; what opens a brace is told by the tokens since the last
statement: a namespace, a type, a function (its parameter list stands before the brace) or a mere block. A scan is
sequential in a file and apart between files, so it runs in Arrow batches without a shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.functions.paths import CPP, extension
from cartolith.operators import resolve
from cartolith.runtime import Staged

_TOKEN = re.compile(
    r"(?P<skip>\s+|//(?:[^\n\\]|\\.)*|/\*.*?\*/|(?<![^\n])[ \t]*#(?:[^\n\\]|\\(?:\r?\n|.))*)|(?P<str>(?:u8|[uUL])?R\"(?P<d>[^()\\\s]{0,16})\(.*?\)(?P=d)\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'(?!\w))|"
    r"(?P<num>\d(?:[\w.]|'\w)*)|(?P<name>operator\s*(?:\(\s*\)|\[\s*\]|[-+*/%^&|~!=<>]+)|~?[A-Za-z_]\w*(?:\s*::\s*~?[A-Za-z_]\w*)*)|(?P<op>::|->|[{}()\[\];,:<>=]|.)", re.S)
_NOT_CALLED = frozenset("if for while switch catch return sizeof alignof decltype noexcept static_assert throw new delete defined alignas explicit operator requires typeid static_cast dynamic_cast const_cast reinterpret_cast".split())
_BEFORE_CALL = frozenset("return throw else do co_return co_await co_yield case and or not".split())
_TYPES = {"class": "class", "struct": "struct", "union": "struct", "enum": "enum"}


def _opened(pending: list[tuple[str, str]], inside: str) -> tuple[str, str]:
    """(kind, name) of the brace that follows the pending tokens."""
    words = [t for k, t in pending if k == "name"]
    if "namespace" in words:
        at = words.index("namespace")
        return "namespace", words[at + 1] if at + 1 < len(words) else ""
    depth, first, angle = 0, None, 0
    for i, (k, t) in enumerate(pending):
        if t == "(":
            if depth == 0 and first is None and i and pending[i - 1][0] == "name" and angle == 0:
                first = i
            depth += 1
        elif t == ")":
            depth -= 1
        elif t == "=" and depth == 0:
            return "block", ""
        elif t == "<" and depth == 0 and i and pending[i - 1][1] == "template":
            angle += 1
        elif t == ">" and depth == 0 and angle:
            angle -= 1
    kind = next((w for w in words if w in _TYPES), None)
    if kind and first is None and inside != "function":
        head = words[words.index(kind) + 1 :]
        colon = next((i for i, (_, t) in enumerate(pending) if t == ":"), len(pending))
        head = [t for k, t in pending[:colon] if k == "name"]
        head = [w for w in head[head.index(kind) + 1 :] if w not in ("final", "class", "struct", "alignas")] if kind in head else head
        return _TYPES[kind], head[-1] if head else ""
    if first is not None and inside != "function":
        name = pending[first - 1][1]
        if name not in _NOT_CALLED or name.startswith("operator"):
            return "function", name
    return "block", ""


def _member_value(pending: list[tuple[str, str]]) -> bool:
    """Whether a brace gives a member its value in a constructor's list: `A(int a) : b_{a}`."""
    if not pending or pending[-1][0] != "name":
        return False
    depth, closed = 0, False
    for k, t in pending:
        depth += (t == "(") - (t == ")")
        if t == ")" and depth == 0:
            closed = True
        elif closed and t == ":" and depth == 0:
            return True
    return False


def scan(text: str) -> tuple[list[tuple], list[tuple]]:
    """(symbols, calls): (kind, name, qualified name, line) and (caller, callee, type, namespace, line)."""
    return _scanned(text, [])


def tree(text: str) -> list[tuple]:
    """(number, parent, kind, name, first line, last line, depth) of the file, its scopes and the calls in them."""
    events: list[tuple] = []
    _scanned(text, events)
    rows, open_ = [[0, None, "file", "", 1, text.count("\n") + 1, 0]], [0]
    for what, kind, name, line in events:
        if what == "close":
            if len(open_) > 1:
                rows[open_.pop()][5] = line
            continue
        rows.append([len(rows), open_[-1], kind, name, line, line, len(open_)])
        if what == "open":
            open_.append(len(rows) - 1)
    for k in open_[1:]:
        rows[k][5] = rows[0][5]  # not closed
    return [tuple(r) for r in rows]


def _scanned(text: str, events: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    symbols, calls, scopes, pending, held, line, at = [], [], [], [], [], 1, 0
    for m in _TOKEN.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        kind, token = m.lastgroup, m[0]
        if kind == "d":
            kind = "str"
        if kind == "skip":
            continue
        if kind == "name":
            token = re.sub(r"\s+", "", token) if not token.startswith("operator") else re.sub(r"\s+", "", token)
        if token == "{" and kind == "op":
            if _member_value(pending):
                scopes.append(("block", ""))
                events.append(("open", "block", "", line))
                held.append((len(scopes), pending))
                pending = []
                continue
            inside = next((k for k, _ in reversed(scopes) if k != "block"), "")
            opened, name = _opened(pending, inside)
            names = [n for k, n in scopes if k != "block" and n]
            qualified = "::".join([*names, name]) if name else "::".join(names)
            if opened != "block" and name:
                typed = inside in ("class", "struct") or "::" in name
                symbols.append(("method" if opened == "function" and typed else opened, name.rpartition("::")[2], qualified, line))
            scopes.append((opened, name))
            typed = opened == "function" and (inside in ("class", "struct") or "::" in name)
            events.append(("open", "method" if typed else opened, name.rpartition("::")[2], line))
            pending = []
        elif token == "}" and kind == "op":
            pending = []
            if scopes:
                if held and held[-1][0] == len(scopes):
                    pending = [*held.pop()[1], ("op", "}")]
                scopes.pop()
                events.append(("close", "", "", line))
        elif token == ";" and kind == "op":
            pending = []
        else:
            if token == "(" and kind == "op" and pending and pending[-1][0] == "name" and any(k == "function" for k, _ in scopes):
                callee = pending[-1][1]
                before = pending[-2] if len(pending) > 1 else ("", "")
                declared = before[0] == "name" and before[1] not in _BEFORE_CALL or before[1] in (">", "*", "&") and len(pending) > 2 and pending[-3][0] == "name" and pending[-3][1] in ("auto", "const")
                if callee not in _NOT_CALLED and not declared:
                    names = [(k, n) for k, n in scopes if k != "block" and n]
                    spaces = "::".join(n for k, n in names if k == "namespace")
                    owner = [n for k, n in names if k in ("class", "struct")]
                    func = next((n for k, n in reversed(names) if k == "function"), "")
                    outer = "::".join([*([spaces] if spaces else []), *owner, *([func.rpartition("::")[0]] if "::" in func else [])])
                    events.append(("leaf", "call", callee, line))
                    calls.append(("::".join(n for _, n in names), callee, outer if owner or "::" in func else "", spaces, line))
            pending.append((kind, token))
    return symbols, calls


def _cpp(files: DataFrame) -> DataFrame:
    return files.where(extension(F.col("path")).isin(*CPP) & F.col("content").isNotNull()).select("project_id", "path", "content")


_FACTS = "project_id string, path string, line_no int, kind string, name string, qualified_name string, caller string, callee string, type_prefix string, namespace_prefix string"


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for p, path, text in zip(pdf["project_id"], pdf["path"], pdf["content"]):
            symbols, calls = scan(text)
            out += [(p, path, line, kind, name, qualified, None, None, None, None) for kind, name, qualified, line in symbols]
            out += [(p, path, line, "call", None, None, caller, callee, owner, space) for caller, callee, owner, space, line in calls]
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in _FACTS.split(", ")])


def cpp_facts(files: DataFrame) -> DataFrame:
    """Symbols and calls of C and C++ files from one pass; rows of kind `call` have caller, callee and the scopes, the
    others name and qualified_name."""
    return _cpp(files).mapInPandas(_facts, _FACTS)


def symbols_of(facts: DataFrame) -> DataFrame:
    return facts.where("kind <> 'call'").select("project_id", "path", "line_no", "kind", "name", "qualified_name")


def calls_of(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'call'").select("project_id", "path", "line_no", "caller", "callee", "type_prefix", "namespace_prefix")


def cpp_symbols(files: DataFrame) -> DataFrame:
    """Namespaces, types and functions with bodies, by scope."""
    return symbols_of(cpp_facts(files))


def cpp_calls(files: DataFrame) -> DataFrame:
    """Calls in function bodies with the scope they stand in."""
    return calls_of(cpp_facts(files))


def resolved_calls(files: DataFrame) -> DataFrame:
    """cpp_calls resolved against cpp_symbols of the project: target is the symbol's qualified name, null if none is
    the only one."""
    return resolved(Staged(cpp_facts(files), "cpp").df)


def resolved(facts: DataFrame) -> DataFrame:
    """resolved_calls of cpp_facts, with the caller."""
    symbols = symbols_of(facts).where("kind IN ('function', 'method')")
    nodes = symbols.select("project_id", F.concat_ws("|", "qualified_name", "path", F.col("line_no").cast("string")).alias("id"), F.col("name").alias("display_name"), "qualified_name")
    calls = calls_of(facts).distinct()
    calls = calls.withColumn("call_id", F.concat_ws("|", "project_id", "path", F.col("line_no").cast("string"), "caller", "callee", "type_prefix", "namespace_prefix"))
    return resolve.resolve_calls(calls, nodes).select("call_id", "project_id", "callee", F.substring_index("target", "|", 1).alias("target"), "rung")
