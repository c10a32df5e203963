"""Lexers of the languages whose syntax is checked: text to (class, bracket step) pairs.

A class is a short word: I name, N number, S string, T template, E empty [ ] (where that cannot be a subscript), a keyword or operator by itself, ERR what cannot be a
token. Brackets step one level in or out; in Python so do INDENT and DEDENT. In JavaScript and TypeScript a ; is put
where a line ends that the next token cannot continue.
"""

from __future__ import annotations

import re

LANGUAGES = {"cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "cpp", "hpp": "cpp", "hh": "cpp", "c": "cpp", "py": "python", "java": "java", "js": "javascript", "mjs": "javascript", "ts": "typescript", "json": "json"}

# Reserved and contextual words that have a class of their own.
KEYWORDS = {
    "javascript": "if else for while do return throw break continue switch case default try catch finally function class extends new typeof void delete await yield in instanceof of var let const import export from as async static get set this super debugger with".split(),
    "java": "yield if else for while do return throw break continue switch case default try catch finally class interface enum extends implements throws new instanceof package import static public private protected final abstract synchronized native transient volatile strictfp assert this super void".split(),
    "cpp": "if else for while do return throw break continue switch case default try catch class struct union enum namespace using typedef template typename operator new delete sizeof public private protected virtual static const constexpr inline extern mutable volatile explicit friend noexcept override final goto co_return co_await co_yield static_assert decltype alignas auto this requires concept thread_local consteval constinit".split(),
    "python": "if elif else for while return raise break continue try except finally def class with import from as global nonlocal pass del assert lambda and or not in is async await yield".split(),
}
KEYWORDS["typescript"] = [*KEYWORDS["javascript"], *"interface type enum namespace module declare abstract implements public private protected readonly override keyof is satisfies infer".split()]
BUILTIN_TYPES = frozenset("unsigned signed long short int char double float bool void".split())
PRIMITIVES = frozenset("int long short byte char double float boolean void".split())
OPEN, CLOSE = "([{", ")]}"

_NUM = r"0[xX][0-9a-fA-F_']+[uUlLnN]*|0[bB][01_']+[uUlLnN]*|0[oO][0-7_]+n?|(?:[0-9][0-9_']*\.?[0-9_']*|\.[0-9][0-9_']*)(?:[eEpP][+-]?[0-9_]+)?[uUlLfFdDnjJ]*"
_WORD = r"[^\W\d][\w$]*|\$[\w$]*"
_MASTER = {
    "javascript": re.compile(rf"(?P<skip>[ \t\f\v\xa0﻿]+|//[^\n]*|/\*.*?\*/)|(?P<nl>\r?\n|\r)|(?P<str>\"(?:[^\"\\\r\n]|\\(?:\r\n|.))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|.))*')|(?P<num>{_NUM})|(?P<word>#?(?:{_WORD}))|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|[-+*/%=<>!~&|^?:;,.@(){{}}\[\]])", re.S),
    "java": re.compile(rf"(?P<skip>[ \t\f\r\n﻿]+|//[^\n]*|/\*.*?\*/)|(?P<str>\"\"\"[ \t]*\r?\n(?:[^\\]|\\.)*?\"\"\"|(?!\"\"\")\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\(?:[btnfrs0-7'\"\\]|u+[0-9a-fA-F]{{4}})[0-7]*)')|(?P<num>{_NUM})|(?P<word>{_WORD})|(?P<op>\.\.\.|<<=|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%=<>!~&|^?:;,.@(){{}}\[\]])", re.S),
    "cpp": re.compile(rf"(?P<skip>[ \t\f\v\r\n﻿]+|\\\r?\n|//(?:[^\n\\]|\\.)*|/\*.*?\*/)|(?P<str>(?:u8|[uUL])?R\"(?P<d>[^()\\\s]{{0,16}})\(.*?\)(?P=d)\"|(?:u8|[uUL])?\"(?:[^\"\\\r\n]|\\(?:\r\n|.))*\"|(?:u8|[uUL])?'(?:[^'\\\r\n]|\\.)+')|(?P<num>{_NUM})|(?P<word>{_WORD})|(?P<op><=>|<<=|>>=|->\*|\.\.\.|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|##|[-+*/%=<>!~&|^?:;,.(){{}}\[\]])", re.S),
    "python": re.compile(rf"(?P<skip>[ \t\f]+|\\\r?\n|#[^\n]*)|(?P<nl>\r?\n|\r)|(?P<str>(?i:[rbu]|br|rb|f|fr|rf|t|tr|rt)?(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|(?!\"\"\"|''')(?:\"(?:[^\"\\\r\n]|\\(?:\r\n|.))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|.))*')))|(?P<num>{_NUM})|(?P<word>{_WORD})|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|:=|->|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\*\*|//|<<|>>|[-+*/%=<>~&|^:;,.@(){{}}\[\]])", re.S),
    "json": re.compile(r"(?P<skip>[ \t\r\n]+)|(?P<str>\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\")|(?P<num>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![\w.]))|(?P<word>(?:true|false|null)\b)|(?P<op>[{}\[\]:,])"),
}
_MASTER["typescript"] = _MASTER["javascript"]
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/[A-Za-z]*")
_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(?:(include|define|undef|if|ifdef|ifndef|elif|elifdef|elifndef|else|endif|pragma|error|warning|line|import)\b(?:[^\n\\/]|\\(?:\r?\n|.)|/(?!\*)|/\*.*?\*/)*)?", re.S)
_MARKER = re.compile(r"(?m)^(?:<{7}|={7}|>{7}|\|{7})(?= |\r?$)")
_GROUPED = {
    "javascript": {"=": "= += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??=", "b": "/ % == != === !== <= >= && || ?? << ** & | ^", "u": "~", "x": "++ --"},
    "java": {"=": "+= -= *= /= %= &= |= ^= <<=", "b": "/ % == != <= >= && || << ^", "u": "! ~", "x": "++ --"},
    "cpp": {"=": "+= -= *= /= %= &= |= ^= <<= >>=", "b": "/ % == != <= >= <=> || << | ^ ->* ##", "u": "!", "x": "++ --"},
    "python": {"op=": "+= -= *= /= //= %= &= |= ^= <<= >>= **= @=", "b": "/ // % == != <= >= < > << >> & | ^"},
    "json": {},
}
_CLASS = {lang: {op: c for c, ops in groups.items() for op in ops.split()} for lang, groups in _GROUPED.items()}
_CLASS["typescript"] = {k: v for k, v in _CLASS["javascript"].items() if k not in ("&", "|")}
#: JavaScript: classes after which an expression can end, and with which the next line then begins a statement.
_ENDS = frozenset("I N S T ) ] } x this super break continue return debugger of from as async get set static let type yield".split())
_BEGINS = frozenset(
    "I N S { } this super if for while do return throw break continue switch try function class new typeof void delete await var let const import export async static get set case default "
    "debugger interface type enum namespace declare abstract public private protected readonly x ! u @ yield of from as override".split()
)


def _template(text: str, at: int) -> int:
    """The end of the template literal that begins at `at`, or -1."""
    depth, i, n = [], at + 1, len(text)
    while i < n:
        c = text[i]
        if depth:  # inside ${ }
            if c == "`":
                i = _template(text, i)
                if i < 0:
                    return -1
                continue
            if c in "\"'":
                m = _MASTER["javascript"].match(text, i)
                if not m or m.lastgroup != "str":
                    return -1
                i = m.end()
                continue
            if c == "{":
                depth.append(c)
            elif c == "}":
                depth.pop()
        elif c == "\\":
            i += 1
        elif c == "`":
            return i + 1
        elif text.startswith("${", i):
            depth.append("{")
            i += 1
        i += 1
    return -1


def _indents(text: str, at: int, stack: list[int], out: list[tuple[str, int]]) -> None:
    """Python: the steps of a line whose first token is at `at`."""
    line = text.rfind("\n", 0, at) + 1
    width = 0
    for c in text[line:at]:
        width = width + 8 - width % 8 if c == "\t" else 0 if c == "\f" else width + 1
    if width > stack[-1]:
        stack.append(width)
        out.append(("INDENT", 1))
    while width < stack[-1]:
        stack.pop()
        out.append(("DEDENT", -1))
    if width != stack[-1]:
        out.append(("ERR", 0))


def lex(text: str, lang: str) -> list[tuple[str, int]]:
    """The tokens of a text; a text that is no sequence of tokens has an ERR where that shows, and ends there."""
    text = text.removeprefix("﻿")
    marked = lang in ("python", "javascript")
    script, python, cpp = lang in ("javascript", "typescript"), lang == "python", lang == "cpp"
    master, classes, words = _MASTER[lang], _CLASS[lang], frozenset(KEYWORDS.get(lang, ()))
    out: list[tuple[str, int]] = []
    stack: list[str] = []
    indents, fresh, newline, builtin = [0], python, False, False
    at, n, prev = 0, len(text), ""
    if script and text.startswith("#!"):
        at = text.find("\n") if "\n" in text else n
    while at < n:
        c = text[at]
        if c in "<>=|" and _MARKER.match(text, at):
            out.append(("ERR", 0))
            return out
        if cpp and c == "#" and not text[text.rfind("\n", 0, at) + 1 : at].strip():
            m = _DIRECTIVE.match(text, at)
            if not m or (m.end() < n and text[m.end()] not in "\r\n"):
                out.append(("ERR", 0))
                return out
            at = m.end()
            continue
        if script and c == "`":
            end = _template(text, at)
            if end < 0:
                out.append(("ERR", 0))
                return out
            kind, at0, at = "T", at, end
        elif script and c == "/" and (prev not in _ENDS or prev in ("return", "of", "yield")) and (m := _REGEX.match(text, at)):
            kind, at0, at = "S", at, m.end()
        else:
            m = master.match(text, at)
            if not m or m.end() == at:
                out.append(("ERR", 0))
                return out
            group, at0, at = m.lastgroup, at, m.end()
            if group == "d":
                group = "str"
            if group == "skip":
                newline = newline or (script and "\n" in m[0])
                continue
            if group == "nl":
                newline = True
                if python and not stack and not fresh:
                    out.append(("NL", 0))
                    fresh = True
                continue
            if group == "str":
                kind = "S"
            elif group == "num":
                kind = "N"
            elif group == "word":
                w = m[0]
                kind = w if w in words else "I"
                if kind != "I" and script and (prev in (".", "?.") or (w not in ("case", "default") and re.match(r"\s*(?::(?!:)|\?:)", text[at : at + 20]) and prev in ("{", ",", ";"))):
                    kind = "I"
                if cpp and w in BUILTIN_TYPES:  # one type of several words is one name
                    if builtin:
                        continue
                    builtin, prev = True, "void"
                    out.append(("void", 0))
                    continue
                if lang == "java" and w in PRIMITIVES:
                    kind = "void"
            else:
                kind = classes.get(m[0], m[0])
        builtin = False
        if python and fresh and not stack:
            _indents(text, at0, indents, out)
            fresh = False
        if script and newline and prev in _ENDS and kind in _BEGINS and (not stack or stack[-1] == "{") and not (prev in (")", "}", "]") and kind in ("{", "}")) and kind != "}":
            if not (prev in ("of", "from", "as", "async", "static", "get", "set", "let", "type") and kind in ("{", "I")):
                out.append((";", 0))
        newline = False
        if kind in OPEN and len(kind) == 1:
            stack.append(kind)
            out.append((kind, 1))
        elif kind in CLOSE and len(kind) == 1:
            if stack:
                stack.pop()
            if kind == "]" and marked and out[-1] == ("[", 1):
                out[-1] = ("E", 0)  # an empty list, which is no subscript
            else:
                out.append((kind, -1))
        else:
            out.append((kind, 0))
        prev = kind
    if python:
        if not fresh:
            out.append(("NL", 0))
        if not stack:
            out += [("DEDENT", -1)] * (len(indents) - 1)
    return out
