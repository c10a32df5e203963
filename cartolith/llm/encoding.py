"""Text decoded with a wrong encoding: detection and best-first restoration.

A state is a text; its neighbours are what it becomes when it is encoded with one code page and decoded with another,
or unescaped. Each state has a plausibility cost, summed over its characters: what script a character belongs to, how
common it is there (by its place in the national character sets, which order characters by use), and whether it fits
its neighbours. A queue ordered by cost and path length, with the hashes of visited states, leads to the cheapest text
that can be reached. Lines, and within them sentences, are searched apart, for a text may be garbled in part.
"""

from __future__ import annotations

import codecs
import heapq
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.runtime import balanced

#: Characters from a wrong decoding that make a text a case.
LEAST_GARBLED = 3
#: What a character costs that no text of its script has there, and the changed characters that two quoted words make up
#: in a script without blanks.
GARBLED_COST, QUOTED_CHARS = 5.0, 16
#: Characters whose costs are computed at once.
COST_CHARS = 1 << 18
#: What a step must save to be taken, beside its own cost.
STEP_COST, MARGIN = 1.0, 2.0
#: A step between two code pages without the evidence of UTF-8 counts as so many more, and needs a text this implausible.
LEGACY_STEPS, LEGACY_LEAST = 3, 6.0

# Code pages a text may have been read with, and those it may have been written in.
READ_AS = "latin-1 cp1252 cp1250 iso8859-2 iso8859-15 cp1254 mac_roman cp437 cp850 cp852 cp1251 cp866 koi8-r".split()
READ_AS_WIDE = "gbk big5 cp932 euc_kr".split()
WRITTEN_IN = {
    "latin-1": "gbk cp932 euc_jp big5 euc_kr cp1251 koi8-r cp1252".split(), "cp1252": "gbk cp932 euc_jp big5 euc_kr cp1251 koi8-r mac_roman cp850".split(),
    "mac_roman": ["cp1252", "cp1251", "gbk", "cp932"], "cp437": ["cp1252", "gbk", "cp932"], "cp850": ["cp1252"], "cp1250": ["cp1252"],
    "cp1251": ["koi8-r", "cp1252", "cp866", "gbk"], "koi8-r": ["cp1251"], "cp866": ["cp1251"], "gbk": ["big5", "cp932", "euc_kr", "cp1252", "euc_jp"],
    "big5": ["gbk", "cp932"], "cp932": ["gbk", "cp1252", "euc_jp"], "euc_kr": ["gbk", "cp932"],
}

(CONTROL, LOST, SPACE, LOWER, UPPER, DIGIT, ASCII, ACC_LOW, ACC_UP, ODD, MARK, QUOTE, HAN, HAN2, HAN3, KANA, HALF, CYR, CYR_UP, CYR2, GREEK, BOX, MATH, WIDE, HANGUL, OTHER) = range(26)
_BASE = np.zeros(26, np.float32)
for _c, _v in {CONTROL: 8, LOST: 6, ACC_LOW: 0.6, ACC_UP: 1, ODD: 3, MARK: 0.8, QUOTE: 0.6, HAN: 0.7, HAN2: 2.4, HAN3: 4, KANA: 0.6, HALF: 2.6, CYR: 0.5, CYR_UP: 0.8, CYR2: 3, GREEK: 1.5, BOX: 0.3, MATH: 0.8, WIDE: 0.5, HANGUL: 0.8, OTHER: 4}.items():
    _BASE[_c] = _v
_LETTER = np.zeros(26, bool)
_LETTER[[LOWER, UPPER, ACC_LOW, ACC_UP]] = True
_SIGN = np.zeros(26, bool)
_SIGN[[ODD, MARK, CONTROL, MATH, LOST, BOX]] = True
_FOREIGN = np.zeros(26, bool)
_FOREIGN[[ACC_LOW, ACC_UP, GREEK, CYR, CYR_UP, CYR2, ODD, HALF]] = True


def _rank(ch: str, codec: str, low: int, high: int) -> int:
    """1 if the character lies in the first (most used) plane rows of a national set, 2 if elsewhere in it, else 3."""
    try:
        lead = ch.encode(codec)[0]
    except UnicodeEncodeError:
        return 3
    return 1 if low <= lead <= high else 2


def _classify(cp: int) -> int:
    ch = chr(cp)
    if cp < 128:
        return SPACE if ch in " \t\r\n" else LOWER if ch.islower() else UPPER if ch.isupper() else DIGIT if ch.isdigit() else ASCII if cp >= 32 else CONTROL
    if cp == 0xFFFD:
        return LOST
    kind = unicodedata.category(ch)
    if kind in ("Cc", "Co", "Cn", "Cs"):
        return CONTROL
    if 0x3040 <= cp <= 0x30FF:
        return KANA
    if 0xFF61 <= cp <= 0xFF9F or 0x3100 <= cp <= 0x312F or 0xFE30 <= cp <= 0xFE6F:
        return HALF
    if 0x3400 <= cp <= 0x9FFF or 0xF900 <= cp <= 0xFAFF:
        return {1: HAN, 2: HAN2, 3: HAN3}[min(_rank(ch, "gb2312", 0xB0, 0xD7), _rank(ch, "shift_jis", 0x88, 0x97), _rank(ch, "big5", 0xA4, 0xC6) + 1, 3)]
    if 0xAC00 <= cp <= 0xD7A3:
        return HANGUL
    if 0x3000 <= cp <= 0x303F or 0xFF01 <= cp <= 0xFF60:
        return WIDE
    if 0x400 <= cp <= 0x4FF:
        return CYR2 if not (0x410 <= cp <= 0x44F or cp in (0x401, 0x451)) else CYR if ch.islower() else CYR_UP
    if 0x370 <= cp <= 0x3FF:
        return GREEK
    if 0x2500 <= cp <= 0x25FF:
        return BOX if ch in "─│┌┐└┘├┤┬┴┼═║╔╗╚╝━┃■□▲△▶▷▼▽◀◁◆◇○●" else ODD
    if ch in "–—‘’“”„…«»‚‐‑•":
        return QUOTE
    if ch in "§°±€£©®™·¿¡²³µ×÷½¼¥¢№†‡":
        return MARK
    if 0x2190 <= cp <= 0x22FF or 0x2600 <= cp <= 0x27BF or 0x1F300 <= cp <= 0x1FAFF:
        return MATH
    if cp in (0xA0, 0x2009, 0x202F, 0x2002, 0x2003, 0x200A):
        return SPACE
    if cp in (0xAA, 0xBA) or (0x80 <= cp <= 0xBF) or ch in "ˆ˜‰‹›ˇ˘˙˛˝◊":
        return ODD
    if cp < 0x100 or ch in "œŒšŠžŽŸłŁńśźżąęćčďěňřťůőűğşıİ":
        return ACC_LOW if kind == "Ll" else ACC_UP if kind == "Lu" else ODD
    return OTHER


@lru_cache(1)
def _classes() -> np.ndarray:
    return np.array([_classify(c) for c in range(0x10000)], np.uint8)


@lru_cache(1)
def _extra() -> tuple[np.ndarray, np.ndarray]:
    """Per character: what a rarer Russian letter costs beside its class, and what a Han character costs in Japanese."""
    letters, japanese = np.zeros(0x10000, np.float32), np.zeros(0x10000, np.float32)
    for group, more in (("яыьгзбчйхжшю", 0.4), ("цщэфъё", 0.9)):
        for ch in group + group.upper():
            letters[ord(ch)] = more
    for cp in [*range(0x3400, 0xA000), *range(0xF900, 0xFB00)]:
        japanese[cp] = {1: 0.7, 2: 1.6, 3: 4.0}[_rank(chr(cp), "shift_jis", 0x88, 0x97)]
    return letters, japanese


def char_costs(text: str, starts: np.ndarray | None = None) -> np.ndarray:
    """The plausibility cost of each character, given its neighbours. starts: where the texts begin that text consists
    of, each with a line end behind it."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.minimum(cps, 0xFFFF)
    cls = np.where(cps < 0x10000, _classes()[small], np.uint8(MATH))
    cost = _BASE[cls]
    if not len(cls):
        return cost
    letters, japanese = _extra()
    cost = cost + letters[small]
    kana = cls == KANA
    if kana.any():
        han = (cls == HAN) | (cls == HAN2) | (cls == HAN3)
        if starts is not None:
            han &= np.repeat(np.logical_or.reduceat(kana, starts), np.diff(np.append(starts, len(cls))))
        cost = np.where(han, japanese[small], cost).astype(np.float32)
    prev, nxt = np.concatenate(([SPACE], cls[:-1])).astype(np.uint8), np.concatenate((cls[1:], [SPACE])).astype(np.uint8)
    letter_near, sign_near = _LETTER[prev] | _LETTER[nxt], _SIGN[prev] | _SIGN[nxt]
    low, up = cls == ACC_LOW, cls == ACC_UP
    alone = ~letter_near & ~((prev == SPACE) & (nxt == SPACE))
    cost += 2.0 * (low & alone) + 0.8 * (low & ((prev == ACC_LOW) | (nxt == ACC_LOW))) + 2.0 * (low & sign_near)
    capitals = (prev == UPPER) | (prev == ACC_UP)
    cost += 4.0 * (up & ((prev == LOWER) | (prev == ACC_LOW))) + 4.0 * (up & (_SIGN[nxt] | (nxt == QUOTE))) + 2.0 * (up & ~_LETTER[nxt] & ~capitals)
    cost += 2.0 * ((cls == ODD) & (letter_near | (prev == QUOTE) | (nxt == QUOTE))) - 1.6 * ((cls == ODD) & ~letter_near & ~_SIGN[prev] & ~_SIGN[nxt])
    mark = cls == MARK
    cost += 2.5 * (mark & (_LETTER[prev] & (prev != LOWER) & (prev != UPPER))) + 1.5 * (mark & sign_near & ~((prev == BOX) | (nxt == BOX))) + 1.5 * (mark & (cps == 0x20AC) & _LETTER[prev])
    quote = cls == QUOTE
    cost += 2.0 * (quote & ((prev == MARK) | (prev == ODD) | (prev == ACC_UP) | (prev == CONTROL)))
    han = (cls == HAN) | (cls == HAN2) | (cls == HAN3)
    inside = ((prev == LOWER) | (prev == UPPER)) & ((nxt == LOWER) | (nxt == UPPER))
    cost += 3.0 * (han & inside) + 2.0 * ((han | (cls == KANA)) & (_FOREIGN[prev] | _FOREIGN[nxt]))
    cyr = (cls == CYR) | (cls == CYR_UP) | (cls == CYR2)
    cost += 2.5 * (cyr & (letter_near | sign_near)) + 3.0 * ((cls == CYR_UP) & ((prev == CYR) | (prev == CYR2))) + 1.0 * ((cls == CYR_UP) & (nxt == CYR_UP))
    cost += 2.5 * ((cls == GREEK) & (letter_near | sign_near | (prev == HAN) | (nxt == HAN)))
    cost += 3.0 * ((cls == BOX) & (letter_near | (prev == GREEK) | (nxt == GREEK) | (prev == ODD) | (nxt == ODD) | (prev == MARK) | (nxt == MARK)))
    cost += 3.0 * ((cls == MATH) & letter_near)
    return cost


_SUSPECT = np.zeros(26, bool)
_SUSPECT[[ACC_LOW, ACC_UP, ODD, MARK, BOX]] = True


def implausible(text: str) -> int:
    """Characters of the kinds that a wrong decoding leaves, where no text has them, such as a capital with an accent
    after a small letter at the end of a word."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return int((_SUSPECT[_classes()[np.minimum(cps, 0xFFFF)]] & (char_costs(text) >= GARBLED_COST)).sum())


_ESCAPES = re.compile(r"&#(?:1[2-9]\d|2[0-4]\d|25[0-5]|\d{4,5}|x[0-9a-fA-F]{2,4});|&[A-Za-z]{2,8};|\\x[89a-fA-F][0-9a-fA-F]|\\u00[89a-fA-F][0-9a-fA-F]|=[89A-F][0-9A-F](?==)|%[89a-fA-F][0-9a-fA-F]")


#: A character this costly is out of place.
ODD_COST = 2.4


def costs(texts: list[str]) -> list[tuple[float, bool, int]]:
    """(cost, whether a character is out of place, number of characters that cost anything) of each text."""
    out: list[tuple[float, bool, int]] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < COST_CHARS):
            size += len(texts[end]) + 1
            end += 1
        part = texts[at:end]
        ends = np.cumsum([len(t) + 1 for t in part])
        starts = np.concatenate(([0], ends[:-1]))
        c = char_costs("\n".join(part) + "\n", starts)
        sums, odd, some = np.add.reduceat(c, starts, dtype=np.float64), np.maximum.reduceat(c, starts) >= ODD_COST, np.add.reduceat((c > 0).astype(np.int64), starts)
        escapes = [2.5 * len(_ESCAPES.findall(t)) if "&" in t or "\\" in t or "=" in t or "%" in t else 0.0 for t in part]
        out += zip((sums + escapes).tolist(), odd.tolist(), some.tolist())
        at = end
    return out


def cost(text: str) -> float:
    return costs([text])[0][0]


@lru_cache(64)
def _to_bytes(codec: str) -> dict[int, int]:
    """For str.translate: characters of a one-byte code page to the code of their byte; others above 0xFF stay."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            out[b] = b  # an undefined byte passes as the control of its number
    for b in range(0x80, 0x100):
        out.setdefault(b, 0xE000 + b)  # a character that the page lacks is no byte
    return out


_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _as_utf8(text: str, codec: str) -> str:
    """Sequences of characters whose bytes in the code page are UTF-8 replaced by what they encode, all else kept."""
    seen = text.translate(_to_bytes(codec))
    out, at = [], 0
    for m in _UTF8.finditer(seen):
        try:
            ch = m[0].encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += [text[at : m.start()], ch]
        at = m.end()
    return "".join([*out, text[at:]]) if at else text


_KEPT: list[str] = []


def _mark(bad: UnicodeEncodeError) -> tuple[bytes, int]:
    """Private-use characters that the national standard gives two-byte codes; of what else has no code the place is
    marked and the text kept."""
    part = bad.object[bad.start : bad.end]
    if bad.encoding == "gbk" and "\ue000" <= part[0] <= "\ue864" and len(code := part[0].encode("gb18030")) == 2:
        return code, bad.start + 1
    _KEPT.append(part)
    return b"\0", bad.end


codecs.register_error("mark_unknown", _mark)


_BYTES = re.compile("[\x00-\xff]*[\x80-\xff][\x00-\xff]*")


def _recode(text: str, read: str, written: str) -> str:
    """Stretches that the code page `read` can encode, decoded with `written`; what cannot be is kept."""
    if read not in READ_AS_WIDE:
        seen, out, at = text.translate(_to_bytes(read)), [], 0
        for m in _BYTES.finditer(seen):
            out += [text[at : m.start()], m[0].encode("latin-1").decode(written, "replace")]
            at = m.end()
        return "".join([*out, text[at:]])
    if "\0" in text:
        return "\0".join(_recode(t, read, written) for t in text.split("\0"))
    _KEPT.clear()
    known, kept = text.encode(read, "mark_unknown").split(b"\0"), [*_KEPT, ""]
    return "".join(x for k, data in enumerate(known) for x in (data.decode("ascii" if data.isascii() else written, "replace"), kept[k]))


def _unescape(text: str) -> str:
    t = html.unescape(text)
    t = re.sub(r"\\x([0-9a-fA-F]{2})|\\u00([0-9a-fA-F]{2})|%([89a-fA-F][0-9a-fA-F])|=([89A-F][0-9A-F])", lambda m: chr(int(m[1] or m[2] or m[3] or m[4], 16)), t)
    return t


def _near(text: str) -> list[tuple[tuple[str, ...], str]]:
    """(steps, text) of what the text becomes when it is unescaped, or when UTF-8 that was read with a one-byte code page
    is read as such: once, or up to three times, as texts are garbled by a fault that repeats."""
    out = [(("unescape",), _unescape(text))] if _ESCAPES.search(text) else []
    for codec in READ_AS if not text.isascii() else ():
        t, step = text, f"{codec}>utf-8"
        for times in (1, 2, 3):
            again = _as_utf8(t, codec)
            if again == t:
                break
            t = again
            out.append(((step,) * times, t))
    return out


_WIDE = re.compile("[\u2e80-\uffff]")


def _far(text: str) -> list[tuple[tuple[str, ...], str]]:
    """Like _near, for the other pairs of code pages."""
    wide = bool(_WIDE.search(text))
    out = [((f"{codec}>utf-8",), _recode(text, codec, "utf-8")) for codec in READ_AS_WIDE] if wide else []
    for read, all_written in WRITTEN_IN.items():
        if wide or read not in READ_AS_WIDE:
            out += [((f"{read}>{written}",), _recode(text, read, written)) for written in all_written]
    return out


def _shrunk(before: str, after: str) -> float:
    """By which share the characters beyond ASCII became fewer; UTF-8 read byte by byte shrinks by a half or more."""
    high = sum(c > "\x7f" for c in before)
    return (high - sum(c > "\x7f" for c in after)) / max(1, high)


def _legacy(steps: tuple[str, ...]) -> bool:
    return any(s != "unescape" and not s.endswith(">utf-8") for s in steps)


@lru_cache(4096)
def restore(text: str, hint: tuple[str, ...] = ()) -> tuple[str, tuple[str, ...]]:
    """The cheapest text that can be reached and the path to it; the text itself and () if nothing is cheaper.
    hint: a path that is tried first and taken if nothing implausible is left after it.

    Until a cheaper text is known, all states below 1.2 times the cost of the text (and 4) are expanded; then those that
    cost no more than the cheapest one and MARGIN. Every step costs something, so either end is reached."""
    start = max(c for c, _, _ in costs([text, _unescape(text)] if _ESCAPES.search(text) else [text]))
    if hint:
        t = text
        for step in hint:
            t = apply(t, step)
        if t != text:
            c, odd, _ = costs([t])[0]
            if not odd and c + MARGIN <= start:
                return t, hint
    best, path = (start, text), ()
    queue, visited = [(start, 0, text, ())], {text}
    while queue:
        here, steps, t, so_far = heapq.heappop(queue)
        if path and here > best[0] + MARGIN:
            break
        here -= STEP_COST * steps
        strong = clean = False  # UTF-8 that was read as something else is well-formed by no accident
        for neighbours in (_near, _far):
            if neighbours is _far and (strong or (here < LEGACY_LEAST and not _WIDE.search(t))):
                break
            fresh = {t2: taken for taken, t2 in reversed(neighbours(t)) if t2 not in visited}
            visited.update(fresh)
            texts = list(fresh)[::-1]
            for t2, (there, odd, _) in zip(texts, costs(texts)):
                taken = fresh[t2]
                legacy = _legacy(taken)
                strong = strong or (neighbours is _near and taken[-1] != "unescape" and ((there <= 0.65 * here and _shrunk(t, t2) >= 0.4) or (not odd and there + MARGIN <= here)))
                if legacy and (there > 0.6 * here or here < LEGACY_LEAST):
                    continue
                far = steps + len(taken) + LEGACY_STEPS * legacy
                c = there + STEP_COST * far
                if c < best[0] - (MARGIN if not path else 0):
                    best, path = (c, t2), (*so_far, *taken)
                    clean = not odd
                if c < start * 1.2 + 4:
                    heapq.heappush(queue, (c, far, t2, (*so_far, *taken)))
        if clean and not _legacy(path) and not _ESCAPES.search(best[1]):
            break
    return best[1], path


def apply(text: str, step: str) -> str:
    if step == "unescape":
        return _unescape(text)
    read, written = step.split(">")
    return _as_utf8(text, read) if written == "utf-8" and read in READ_AS else _recode(text, read, written)


_SENTENCES = re.compile(r"[^.!?。！？]*(?:[.!?。！？]+[”’\"')）」]*\s*|$)")
#: Words of a sentence that speaks about its own odd characters.
_META = re.compile(
    r"(?i)\b(?:sample|example|quoted?|quotes|broken|wrong(?:ly)?|decod\w*|encod\w*|mojibake|garbled|utf-?8|latin-?1|fixture|literal|beispiel|falsch\w*|exemple|ejemplo|exemplo|kodier\w*|"
    r"пример\w*|кодировк\w*)\b|乱码|示例|例如|编码|文字化け|例として|エンコード"
)
_QUICK = re.compile("[^\x00-\x7f]|" + _ESCAPES.pattern)
_LOST_FORMS = re.compile("ï¿½|锟斤拷")


def _quoted_example(original: str, changed: str) -> bool:
    """A sentence about odd characters that shows them in one word and is otherwise sound."""
    ours, theirs = original.split(" "), changed.split(" ")
    odd = [a for a, b in zip(ours, theirs) if a != b] if len(ours) == len(theirs) else None
    words = len(odd) if odd is not None else sum((Counter(ours) - Counter(theirs)).values())
    if any(c >= "\u2e80" for w in odd or [original] for c in w):  # words are not told apart
        return sum((Counter(original) - Counter(changed)).values()) <= QUOTED_CHARS and bool(_META.search(original))
    return words <= 1 and bool(_META.search(original))


def _parts(text: str) -> list[str]:
    """The sentences of the lines of a text; joined they are the text."""
    out = []
    for line in text.split("\n"):
        out += [*(p for p in _SENTENCES.findall(line) if p), "\n"] if _QUICK.search(line) else [line, "\n"]
    return out[:-1]


def _repaired(part: str, hint: tuple[str, ...]) -> tuple[int, str, tuple[str, ...]]:
    """(garbled characters, restored sentence, path)"""
    marked = _LOST_FORMS.sub("\ufffd", part)
    t, path = restore(marked, hint)
    decoded = any(s != "unescape" for s in path)
    n = 0
    if decoded:
        before, after = Counter(c for c in _unescape(marked) if c > "\x7f"), Counter(c for c in t if c > "\x7f")
        n = sum((before - after).values())
    else:
        t = marked
    n += sum(1 for c in t if c == "\ufffd" or "\x80" <= c <= "\x9f")
    n += implausible(t)  # also what could not be restored
    if not n or _quoted_example(part, t):
        return 0, part, ()
    return n, t if decoded else part, path if decoded else ()


def repair_all(texts: list[str]) -> list[tuple[int, str, str]]:
    """repair() of each text; the costs of all their sentences are computed together."""
    split = [_parts(t) if _QUICK.search(t) else None for t in texts]
    asked = [p for parts in split if parts for p in parts if _QUICK.search(p)]
    odd = set()
    for p, (c, out_of_place, some) in zip(asked, costs([_LOST_FORMS.sub("\ufffd", p) for p in asked])):
        if out_of_place or c >= 0.85 * max(1, some) + 3 or _ESCAPES.search(p):
            odd.add(p)
    out = []
    for text, parts in zip(texts, split):
        if not parts or odd.isdisjoint(parts):
            out.append((0, text, ""))
            continue
        garbled, first, hint, fixed = 0, "", (), []
        for p in parts:
            if p in odd:
                n, p, path = _repaired(p, hint)
                garbled += n
                hint, first = path or hint, first or " ".join(path)
            fixed.append(p)
        out.append((garbled, "".join(fixed), first))
    return out


def repair(text: str) -> tuple[int, str, str]:
    """(garbled characters, restored text, path of the first stretch). Examples that a sentence quotes do not count."""
    return repair_all([text])[0]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(d, *r) for d, r in zip(pdf["doc_id"], repair_all(list(pdf["text"])))]
        rows = [r for r in rows if r[1] >= LEAST_GARBLED]
        yield pd.DataFrame(rows, columns=["doc_id", "garbled", "restored", "path"]).astype({"doc_id": "int64", "garbled": "int64"})


def garbled_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, garbled, restored, path) of documents with LEAST_GARBLED or more characters from a wrong decoding.

    restored is the whole text with what could be had back; path names the first steps taken. Null and empty texts
    and null ids give no row; repeated rows give repeated rows; other columns are ignored. One pass; texts are shuffled only
    if their partitions are too few for the cores."""
    body = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND length(text) > 0")
    return balanced(body, "doc_id").mapInPandas(_scan, "doc_id bigint, garbled bigint, restored string, path string")
