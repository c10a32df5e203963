"""Credentials in source and configuration text: search through encoding layers, and redaction.

The search runs per text, in Arrow batches, on whole texts. It knows five kinds of evidence: private-key containers,
self-describing tokens, credentials in a grammar (URL user info, connection strings, command lines, authorization
schemes), values bound to a telling name, and literals split over several pieces. Every stretch that is base64, hex,
percent or escape encoding of text (or of a key container), quoted or not, in one line or several, is decoded and
searched again, and if the decoded layer holds a credential, the enclosing literal of one line, else the stretch, is
the credential's span in the text.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = "[REDACTED]"

# Words of names that stand for a secret, words that make such a name stand for something else,
# and words of names of hashes and identifiers.
SECRET_WORDS = frozenset("password passwd pass pwd pw passphrase passcode secret secrets token apikey credential credentials cred creds signing authorization auth".split())
KEY_OWNERS = frozenset("api secret access private signing encryption auth client shared master account store storage session service deploy".split())
NOT_SECRET_WORDS = frozenset(
    "hint label id ids kind url uri path file name names type field count limit length len size ttl expiry expires expiration prefix suffix env var regex pattern "
    "format status title message policy enabled min max index version mode header placeholder reset endpoint scope provider algorithm bucket parser handler class".split()
)
HASH_WORDS = frozenset("sha sha1 sha256 sha512 md5 hash digest checksum commit revision rev integrity etag trace span run request uuid guid nonce fingerprint icon image public pub cert certificate".split())

_B64 = r"[A-Za-z0-9+/_-]"
_TOKENS = re.compile(
    r"(?<![A-Za-z0-9_])(?:"
    r"(?P<aws>(?:AKIA|ASIA)[0-9A-Z]{16})(?::(?P<awssec>[A-Za-z0-9/+=]{40}))?"
    r"|gh[opusr]_[A-Za-z0-9]{30,}|github_pat_\w{40,}|glpat-[\w-]{16,}|xox[abeprs]-[A-Za-z0-9-]{20,}"
    r"|sk-(?:[a-z]+-)?[A-Za-z0-9_-]{20,}|[a-z]{2,6}_(?:live|prod|test)_[A-Za-z0-9]{16,}"
    r"|AIza[\w-]{35}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,}|pypi-[\w-]{40,}|SG\.[\w-]{16,}\.[\w-]{16,}"
    r"|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,})(?![A-Za-z0-9])"
)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_USERINFO = re.compile(r"\b[a-z][a-z0-9+.-]*://[^\s/:@\"'`<>]*:([^\s/@\"'`<>]+)@[A-Za-z0-9\[]")
_CONN = re.compile(r"(?i)(?:^|[;,\"'`\s?&])(?:password|passwd|pwd|accountkey|sharedaccesskey|access[_ ]?key|secret|token)\s?=\s?([^;,&\"'`\s]{4,})(?=[;&\"'`])")
_FLAG = re.compile(r"(?<![\w-])--?(?:[a-z]+-)*(?:password|passwd|pass|pwd|token|secret|api-?key|key)[= ](?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\s\"'`]+))")
_USERPASS = re.compile(r"(?<![\w-])(?:-u|--user)[= ](?:\"|')?[\w.@-]+:([^\s\"'`]{4,})")
_SCHEME = re.compile(r"(?i)\b(bearer|basic|token)[ ]+([A-Za-z0-9!-/:;=?@\[\]^_~]{6,})")
_LITERAL = re.compile(r"\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
#: What stands before a literal, read backwards: a name, perhaps with a type, a call or an index; a name that is defined;
#: a name that is the literal before.
_NAME_BEFORE = re.compile(r"[bBrRuUfFL@]{0,2}\s*(?:\([\w:.]*[A-Za-z_])?(?:\s*\()?\s*(?:=\s*[\w<>\[\] ]*?[A-Za-z_]\s*:|=:|>=|[:={(,])\s*(?:\]\s*\w*\s*\[)?\s*\]?\s*(?:[\"'`]\\?)?([\w.-]*[A-Za-z_])")
_DEFINED = re.compile(r"[ \t]+(\w*[A-Za-z_])[ \t]+(?:enifed[ \t]*#|vnetes\b|VNE\b)")
_ARGUMENT = re.compile(r"\s*,\s*[\"'`]([\w.-]+)[\"'`]")
_GLUE = re.compile(r"\s*(?:\\\r?\n|\+|\.\.?)?\s*")
_CONFIG_LINE = re.compile(r"(?m)^[ \t]*(?:export[ \t]+|set[ \t]+|ENV[ \t]+|ARG[ \t]+|-[ \t]+)?([A-Za-z_][\w.-]*)[ \t]*[=:][ \t]*([^\s\"'`()<>{}\[\];,]+)[ \t]*\\?\r?$")
_XML = re.compile(r"<([A-Za-z_][\w.-]*)>\s*([^<>\s]+)\s*</\1>")
_COMMENT = re.compile(r"(?im)^.*?(?://|#|/\*|--|;)[^\n]*?(?:\b(?:pass(?:word|wd|phrase)?|pw|pwd|key|token|secret|login|cred(?:ential)?s?)\b|密码|密钥|口令|令牌)[^\n:=：]*[:=：][ \t]*(\S{6,})[ \t]*(?:\*/)?\r?$")
_PLACEHOLDER = re.compile(
    r"(?i)^<.*>$|^&lt;.*&gt;$|^\[.*\]$|^\{\{.*\}\}$|(?<![a-z0-9])(?:your|example|placeholder|change[-_ ]?me|change[-_ ]?it|replace|insert|put[-_ ]|to[-_]?do(?![a-z])|dummy|sample|redacted|masked|hidden|"
    r"fixme|not[-_ ]?set)|[-_]placeholder|^(?:none|null|undefined|test)$|示例|占位|你的|替换|^(?:[a-z]{1,6}[-_])*x{4,}$|x{6,}|\*{3,}|•{3,}|\.{3,}|#{3,}|_{4,}|[-_ ]here$"
)
_REFERENCE = re.compile(r"(?i)^\$|^%\w+%$|^@\w+@?$|^#\{|^(?:env|vault|file|secret|secrets|ssm|arn|kms|ref|cmake|keyring|op|aws|gcp|azure)[:/]|^[a-z][a-z0-9+.-]*://|^(?:os\.|process\.|system\.|getenv|config\.|settings\.|self\.|this\.)|^enc\[")
_HASHISH = re.compile(r"^(?:sha(?:1|256|384|512)[-:]|data:|md5[-:])|^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
#: Text that may be encoded, quoted or not: over several lines, or in one.
_WRAPPED = re.compile(r"(?<![\w+/-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*\\?\r?\n[ \t]*[A-Za-z0-9+/_-]{4,}+)+={0,2}(?=[ \t]*(?:\r?\n|[\"'`),;<\]}]|\Z))")
_RUN = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{16,}+={0,2}")
_URL_RUN = re.compile(r"(?<![\w-])[\w-]{16,}+={0,2}", re.A)
_PLAIN = re.compile(r"[^\s\"'`<>]{8,}+")
_ESCAPED = re.compile(r"%[0-9a-fA-F]{2}|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|[0-7]{3}|[\"'\\])")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def _same(value: str) -> bool:
    return len(set(value.lower())) <= 2


def no_secret(value: str) -> bool:
    """Blank, placeholder, masked, reference, hash or identifier."""
    body = re.sub(r"^(?:sk|pk|ghp|glpat|xox[a-z])[-_]", "", value)
    return not value.strip() or _same(body) or bool(_PLACEHOLDER.search(value) or _REFERENCE.match(value) or _HASHISH.match(value))


def strong(value: str, quoted: bool = True) -> bool:
    """A value that, under a telling name, is a credential: no words, no expression."""
    if len(value) < 5 or no_secret(value) or re.search(r"\s", value):
        return False
    letters, digits = len(re.findall("[A-Za-z]", value)), len(re.findall("[0-9]", value))
    if not quoted and re.fullmatch(r"[A-Za-z_][\w]*(?:(?:\.|->|::)[A-Za-z_]\w*)*", value) and (len(value) < 16 or digits < 3):
        return False  # an identifier
    if letters and digits:
        return True
    if re.search(r"[^\w\s./-]", value) and letters >= 4 and len(value) >= 8:
        return True
    return letters >= 20 and bool(re.search("[a-z]", value)) and bool(re.search("[A-Z]", value)) and not re.search("[a-z]{6}", value)


def random_like(value: str) -> bool:
    """A long literal of mixed case and digits, without words or structure."""
    return (
        len(value) >= 24 and bool(re.fullmatch(r"[A-Za-z0-9+/=_-]+", value)) and not no_secret(value)
        and len(re.findall("[0-9]", value)) >= 2 and len(re.findall("[A-Z]", value)) >= 3 and len(re.findall("[a-z]", value)) >= 3
        and not re.search("[a-z]{7}", value) and len(set(value)) >= 14
    )


def name_kind(name: str) -> str:
    """'secret', 'hash' or '' for an identifier, by the words that it is made of."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words:
        return ""
    if words[-1] == "value" and len(words) > 1:
        words.pop()
    if any(w in HASH_WORDS for w in words):
        return "hash"
    if words[-1] in NOT_SECRET_WORDS or (len(words) > 1 and words[-2:] == ["field", "id"]):
        return "hash" if words[-1] in ("id", "ids") else ""
    for i, w in enumerate(words):
        if w in SECRET_WORDS or (w in ("key", "keys") and (i and words[i - 1] in KEY_OWNERS)):
            return "secret"
    return "secret" if "".join(words[-2:]) in ("apikey", "secretkey", "privatekey", "accesskey") or words[-2:] == ["secret", "access"] else ""


def _der(data: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER element at `at`, if its length is well-formed."""
    if at + 2 > len(data):
        return None
    tag, n, start = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or start + k > len(data):
            return None
        n, start = int.from_bytes(data[start : start + k], "big"), start + k
    return (tag, start, start + n) if start + n <= len(data) else None


def _children(data: bytes, start: int, end: int, most: int = 10) -> list[tuple[int, int, int]] | None:
    """The first DER elements of a stretch, None if one is not well-formed."""
    parts, at = [], start
    while at < end and len(parts) < most:
        one = _der(data, at)
        if not one:
            return None
        parts.append(one)
        at = one[2]
    return parts


# Object identifiers of password-based encryption and of PKCS#12, and the marks of key stores.
_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_PKCS7 = bytes.fromhex("2a864886f70d0107")
_OPENSSH, _KEY_STORES = b"openssh-key-v1\0", (bytes.fromhex("feedfeed00000002"), bytes.fromhex("cececece00000002"))


def _openssh(data: bytes) -> bool:
    """The binary of an OpenSSH key, perhaps cut short: cipher, key derivation and its options, the number of keys."""
    at = len(_OPENSSH)
    for field in range(3):
        if at + 4 > len(data):
            return True
        n = int.from_bytes(data[at : at + 4], "big")
        if n > 1024:
            return False
        at += 4 + n
    return at + 4 > len(data) or 1 <= int.from_bytes(data[at : at + 4], "big") <= 64


def private_container(data: bytes) -> bool:
    """A private key by the grammar of its container: OpenSSH, PKCS#8 (encrypted too), PKCS#1, DSA, SEC 1, PKCS#12 or a
    Java key store."""
    if data.startswith(_OPENSSH):
        return _openssh(data)
    if data.startswith(_KEY_STORES):
        return len(data) >= 12
    outer = _der(data)
    if not outer or outer[0] != 0x30:
        return False
    parts = _children(data, outer[1], outer[2])
    if not parts:
        return False
    tags = [p[0] for p in parts]
    value = lambda k: data[parts[k][1] : parts[k][2]]
    named = lambda k, oids: any(value(k)[2:].startswith(o) for o in oids) and value(k)[0] == 0x06
    if tags[:3] == [0x02, 0x30, 0x04] and value(0) in (b"\0", b"\1"):
        return True  # PKCS#8
    if tags == [0x30, 0x04] and named(0, _PBE):
        return True  # encrypted PKCS#8
    if tags[:2] == [0x02, 0x30] and value(0) == b"\3" and named(1, (_PKCS7,)):
        return True  # PKCS#12
    if set(tags) == {0x02} and value(0) in (b"\0", b"\1") and (len(tags) >= 9 or (len(tags) == 6 and len(value(1)) >= 64)):
        return True  # PKCS#1, DSA
    return tags[:2] == [0x02, 0x04] and value(0) == b"\1"  # SEC 1


def _text(data: bytes) -> str | None:
    try:
        s = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return s if s and all(c.isprintable() or c in "\r\n\t" for c in s) else None


def _decoded(value: str) -> Iterator[str | bytes]:
    """What the value stands for in each encoding that it is well-formed in."""
    if re.fullmatch(r"[A-Za-z0-9+/]{12,}={0,2}|[A-Za-z0-9_-]{12,}={0,2}", value) and len(value.rstrip("=")) % 4 != 1:
        body = value.rstrip("=").translate(str.maketrans("-_", "+/"))
        try:
            yield base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
        except (binascii.Error, ValueError):
            pass
    if len(value) % 2 == 0 and re.fullmatch(r"(?:0x)?[0-9a-fA-F]{16,}", value):
        yield bytes.fromhex(value.removeprefix("0x"))
    if re.search("%[0-9a-fA-F]{2}", value):
        yield unquote(re.sub("%(?:25)+(?=[0-9a-fA-F]{2})", "%", value))  # layers of the percent sign alone at once
    if re.search(r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|[0-7]{3})", value):
        yield re.sub(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|([0-7]{3}))", lambda m: chr(int(m[1] or m[2], 16) if m[1] or m[2] else int(m[3], 8)), value)
    if re.search(r"\\[\"'\\]", value):
        yield re.sub(r"\\([\"'\\nrt])", lambda m: {"n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1]), value)


#: Values whose layers are being opened; they are not opened again inside themselves.
_OPEN: set[str] = set()


def _opened(value: str, named: bool) -> bool:
    waiting, mine = [value], {value}
    _OPEN.add(value)
    try:
        while waiting:
            for inner in _decoded(waiting.pop()):
                if isinstance(inner, bytes):
                    if private_container(inner):
                        return True
                    inner = _text(inner)
                if inner is None or inner in mine or inner in _OPEN:
                    continue
                pair = re.fullmatch(r"[\w.@-]{1,64}:(\S{4,})", inner)
                if named and pair and strong(pair[1]):
                    return True
                mine.add(inner)
                _OPEN.add(inner)
                if find(inner):
                    return True
                waiting.append(inner)
        return False
    finally:
        _OPEN.difference_update(mine)


_opened_once = lru_cache(4096)(_opened)


def _hidden(value: str, named: bool) -> bool:
    """Whether a decoded layer of the value, however deep, holds a credential. A layer is shorter than what encodes it
    and is opened once."""
    if value in _OPEN:
        return False
    return _opened(value, named) if _OPEN else _opened_once(value, named)


_KEY_LINE = re.compile(r"[ \t]*(?:[\"'`+#*;>/|\\,.]|//|\\[nrt]|[ \t])*(?:(?P<head>[A-Z][\w-]*: [^\n]*)|(?P<body>[A-Za-z0-9+/]{8,}={0,2}))?(?P<rest>(?:\\[nrt]|[\"'`+\\,;) \t\r])*)(?:\n|\Z)")


def _key_end(text: str, at: int) -> int:
    """Where the lines of a key end whose END line is missing: behind the last line of base64."""
    stop, headers = at, True
    while at < len(text) and (m := _KEY_LINE.match(text, at)):
        body = m["body"]
        if body:
            if not (len(body) >= 40 or body.endswith("=") or (re.search("[0-9+/]", body) and re.search("[a-z]", body) and re.search("[A-Z]", body))):
                break
            stop, headers = m.end("body"), False
        elif not headers or m.end() == at:
            break
        at = m.end()
    return stop


_KEY_RUN = re.compile(r"(?:\\[nrt]|[A-Za-z0-9+/=])+")


def _keys(text: str) -> list[tuple[int, int]]:
    """Stretches of text keys: from BEGIN to END, or without an END to the end of the key's own lines."""
    out = []
    begins = list(_PEM.finditer(text))
    for k, m in enumerate(begins):
        end = _PEM_END.search(text, m.end(), begins[k + 1].start() if k + 1 < len(begins) else len(text))
        stop = end.end() if end else _key_end(text, m.end())
        if not end and stop <= m.end() and (run := _KEY_RUN.match(text, m.end())):
            stop = run.end()
        body = re.sub(r"\\[nrt]|[^A-Za-z0-9+/=*.<>]", "", text[m.end() : end.start() if end else stop])
        if len(re.findall("[A-Za-z0-9+/]", body)) >= 16 and not _same(body) and not re.search(r"\.{3}|\*{3}|<", body):
            out.append((m.start(), stop))
    if "Private-Lines:" in text:
        out += [m.span(1) for m in _PUTTY.finditer(text)]
    return out


_PUTTY = re.compile(r"Private-Lines: *\d+[ \t]*\r?\n((?:[ \t]*[A-Za-z0-9+/]+={0,2}[ \t]*\r?\n?)+?)(?=[ \t]*Private-(?:MAC|Hash)|\Z|[ \t]*\r?\n)")
_BYTES = re.compile(r"(?<=[{\[(])\s*((?:0[xX][0-9a-fA-F]{1,2}|[0-9]{1,3})(?:\s*,\s*(?:0[xX][0-9a-fA-F]{1,2}|[0-9]{1,3})){15,})\s*,?\s*(?=[}\])])")


def _byte_arrays(text: str) -> list[tuple[int, int]]:
    """Lists of numbers that are the bytes of a text with a credential or of a key's container."""
    out = []
    for m in _BYTES.finditer(text):
        numbers = [int(x, 0) if x[:2] in ("0x", "0X") else int(x) for x in re.findall(r"\w+", m[1])]
        if max(numbers) < 256:
            data = bytes(numbers)
            inner = _text(data.rstrip(b"\0"))
            if private_container(data) or (inner and inner not in _OPEN and (find(inner) or _hidden(inner, False))):
                out.append(m.span(1))
    return out


# What a text must hold in lower case for a pattern to be tried.
_SIGNS = {
    "url": ("://",), "connection": ("password", "passwd", "pwd", "accountkey", "sharedaccesskey", "access", "secret", "token"), "flag": ("pass", "pwd", "token", "secret", "key"),
    "user": ("-u", "--user"), "scheme": ("bearer", "basic", "token"), "comment": ("pass", "pw", "key", "token", "secret", "login", "cred", "密码", "密钥", "口令", "令牌"),
}


def find(text: str) -> list[tuple[list[tuple[int, int]], str]]:
    """Credentials of a text as (pieces, kind); pieces are the spans to mask, in order. Spans do not overlap."""
    hits: list[tuple[list[tuple[int, int]], str]] = []
    taken: list[tuple[int, int]] = []  # spans of the hits, sorted
    low = text.lower()
    may_hold = lambda kind: any(sign in low for sign in _SIGNS[kind])

    def free(a: int, b: int) -> bool:
        k = bisect_right(taken, (a, len(text) + 1))
        return not (k and taken[k - 1][1] > a) and not (k < len(taken) and taken[k][0] < b)

    def add(pieces: list[tuple[int, int]], kind: str) -> None:
        if all(free(a, b) for a, b in pieces):
            hits.append((pieces, kind))
            for piece in pieces:
                insort(taken, piece)

    for span in _keys(text):
        add([span], "private_key")
    for span in _byte_arrays(text):
        add([span], "bytes")
    literals = [(m.start(), m.end()) for m in _LITERAL.finditer(text)]
    for m in _TOKENS.finditer(text):
        if not no_secret(m[0]):
            add([m.span()], "token")
    for pattern, kind in ((_USERINFO, "url"), (_CONN, "connection"), (_FLAG, "flag"), (_USERPASS, "user")):
        for m in pattern.finditer(text) if may_hold(kind) else ():
            group = next(g for g in range(1, (m.lastindex or 1) + 1) if m[g] is not None)
            if strong(unquote(m[group])) and strong(m[group]) and not m[group].endswith("("):
                add([m.span(group)], kind)
    for m in _SCHEME.finditer(text) if may_hold("scheme") else ():
        value = m[2].rstrip("\"'`);,")
        scheme, at = m[1].lower(), m.start(2)
        if scheme == "basic":
            if _hidden(value, True):
                add([(at, at + len(value))], "basic")
        elif strong(value) and (scheme == "bearer" or random_like(value) or re.fullmatch(r"[0-9a-f]{32,}", value)):
            add([(at, at + len(value))], scheme)
    backwards, i = text[::-1], 0
    while i < len(literals):
        j = i
        while j + 1 < len(literals) and (g := _GLUE.fullmatch(text, literals[j][1], literals[j + 1][0])) is not None and ("+" in g[0] or ("\n" in g[0] and not any(text[a : a + 3] in ('"""', "'''") for a, _ in literals[j : j + 2]))):
            j += 1
        pieces = [(a + w, b - w) for a, b in literals[i : j + 1] for w in [3 if b - a >= 6 and text[a : a + 3] in ('"""', "'''") else 1]]
        value, start = "".join(text[a:b] for a, b in pieces), literals[i][0]
        i = j + 1
        if not value.strip():
            continue
        back = len(text) - start
        name = _NAME_BEFORE.match(backwards, back) or _DEFINED.match(backwards, back)
        kind = name_kind(name[1][::-1]) if name else ""
        if kind == "" and (prior := _ARGUMENT.match(backwards, back)):
            kind = name_kind(prior[1][::-1])  # a call with the name as its first literal, set("client.secret", "…")
        bare = value.strip()
        if kind == "secret" and strong(bare):
            add(pieces, "named")
        elif len(pieces) > 1 and kind != "hash" and (random_like(bare) or any(not no_secret(m[0]) for m in _TOKENS.finditer(bare))):
            add(pieces, "split")
        elif len(bare) >= 12 and (_ESCAPED.search(bare) or not re.search(r"\s", bare)) and _hidden(bare, kind == "secret"):
            add(pieces, "encoded")
    spans = sorted(literals)
    starts = [a for a, _ in spans]
    outside = lambda at: not ((k := bisect_right(starts, at) - 1) >= 0 and spans[k][1] > at)
    for pattern, kind in ((_CONFIG_LINE, "config"), (_XML, "element")):
        for m in pattern.finditer(text):
            named = name_kind(m[1])
            if named == "secret" and outside(m.start(2)) and (strong(m[2], quoted=kind == "element") or _hidden(m[2], True)):
                add([m.span(2)], kind)
    for m in _COMMENT.finditer(text) if may_hold("comment") else ():
        value = m[1].strip("\"'`.,")
        if strong(value, quoted=False) and outside(m.start(1)):
            at = m.start(1) + m[1].find(value)
            add([(at, at + len(value))], "comment")
    for pattern in (_WRAPPED, _RUN, _URL_RUN, _PLAIN):
        for m in pattern.finditer(text):
            run = m[0]
            if pattern is _PLAIN and not _ESCAPED.search(run):
                continue
            if pattern is _WRAPPED:
                lines = re.split(r"[ \t]*\\?\r?\n[ \t]*", run)
                hidden = _hidden("".join(lines), False) or _hidden("".join(lines[:-1]), False)  # a word may follow
            else:
                hidden = _hidden(run, False)
            if hidden:
                k = bisect_right(starts, m.start()) - 1
                inside = k >= 0 and spans[k][1] > m.start() and "\n" not in text[spans[k][0] : spans[k][1]]
                add([(spans[k][0] + 1, spans[k][1] - 1) if inside else m.span()], "encoded")
    return sorted(hits, key=lambda h: h[0][0])


def find_in_key(value: str) -> list[tuple[list[tuple[int, int]], str]]:
    """Like find, for a field that is itself a key: the bare value, padded, quoted, after a scheme or encoded."""
    m = re.fullmatch(r"\s*([\"'`]?)\s*(?:(?i:bearer|basic|token|key|apikey)\s+)?(.*?)\s*\1\s*", value, re.S)
    inner = m[2] if m else value.strip()
    if not inner or no_secret(inner):
        return []
    at = value.find(inner)
    if strong(inner) or random_like(inner) or _hidden(inner, True):
        return [([(at, at + len(inner))], "key")]
    return find(value)


def redact(text: str, hits: list[tuple[list[tuple[int, int]], str]]) -> str:
    """The text with the first piece of each credential replaced by MASK (a list of bytes by one 0) and further pieces
    emptied."""
    spans = sorted((a, b, "" if k else "0" if kind == "bytes" else MASK) for pieces, kind in hits for k, (a, b) in enumerate(pieces))
    out, at = [], 0
    for a, b, mask in spans:
        out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def _rows(key_field: bool):
    search = find_in_key if key_field else find

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, lines, kinds, masked = [], [], [], []
            for rid, text in zip(pdf["record_id"], pdf["body"]):
                hits = search(text)
                if hits:
                    ids.append(rid)
                    lines.append([text.count("\n", 0, p[0][0]) + 1 if not key_field else 1 for p, _ in hits])
                    kinds.append([k for _, k in hits])
                    masked.append(redact(text, hits))
            yield pd.DataFrame({"record_id": pd.Series(ids, dtype="int64"), "line_nos": pd.Series(lines, dtype="object"), "kinds": pd.Series(kinds, dtype="object"), "redacted": pd.Series(masked, dtype="object")})

    return run


def scan(df: DataFrame, record_id: str, text: str, key_field: bool = False) -> DataFrame:
    """(record_id, line_nos, kinds, redacted): one row per record that holds a credential.

    line_nos and kinds list the credentials in order of position; redacted is the text with only these masked. Null
    and empty texts and null ids give no row; repeated rows give repeated rows; other columns are ignored. A private
    key begins on its BEGIN line, a value in several pieces on the line of the first.
    """
    body = df.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(text).alias("body")).where("record_id IS NOT NULL AND length(body) > 0")
    return body.mapInPandas(_rows(key_field), "record_id bigint, line_nos array<int>, kinds array<string>, redacted string")


def found(requests: DataFrame, config: DataFrame) -> DataFrame:
    """Distinct (source_table, record_id, line_no) of the credentials in both tables."""
    a = scan(requests, "request_id", "code_excerpt").select(F.lit("ai_requests").alias("source_table"), "record_id", F.explode("line_nos").alias("line_no"))
    b = scan(config, "config_id", "api_key", key_field=True).select(F.lit("ai_config").alias("source_table"), "record_id", F.explode("line_nos").alias("line_no"))
    return a.unionByName(b).distinct()
