"""Passages of held-out items in documents: pigeonhole piece search, verified with Myers' bit-parallel distance.

A passage of `length` units (words, or characters of Chinese and Japanese items) may hold length // ERROR_UNITS errors.
Every item is cut into pieces of PIECE units that do not overlap; each window of a passage's length holds at least one
whole piece more than it may hold errors, and an error spoils one piece, so an exact piece of the item stands in every
document that leaks it.

The pieces of all items are one table. Documents are read once: their grams are looked up in a bitmap of the pieces'
hashes, whose size is fixed whatever the number of items, and only the grams it does not rule out are joined with the
pieces. Pairs of a document and an item that share a piece are verified around the shared pieces.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.runtime import BROADCAST_ROWS, Staged, balanced, small_side

WORDS, CHARS = 24, 30
ERROR_UNITS = 9
#: Units of a piece, counted in words and in characters: the largest that leave one more whole piece than errors in
#: every window of 24, 27, 36, ... words and of 30, 36, 45, ... characters.
PIECE = {False: 5, True: 6}
#: Units of the grams that a window is asked for before it is verified.
SHORT = 3
#: Bits of the bitmap of piece hashes (8 MB), and copies of a piece that spread the documents holding it.
BITMAP_BITS, SALTS = 1 << 26, 16
#: Words of items up to which their texts are broadcast (about 10 MB).
BROADCAST_UNITS = 1_000_000
#: Words whose hashes a task keeps.
KEPT_WORDS = 1 << 18

_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_BLOCK_TAG = re.compile(r"</?(?:p|br|li|ul|ol|div|td|th|tr|table|h[1-6]|pre|blockquote|hr)\b[^<>]{0,200}/?>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93], np.uint64)


def normal_text(text: str) -> str:
    """The text without case, markup, escapes, line marks, line-end hyphenation and marks inside words."""
    if "\\" in text:
        text = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text)
        text = re.sub(r"\\[nrt]", "\n", text).replace("\\", "")
    if "%20" in text:
        text = unquote(text, errors="replace")
    if "=\n" in text or "=\r\n" in text:
        text = re.sub(r"=\r?\n", "", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    if "](" in text:
        text = re.sub(r"\]\([^()\s]*\)", " ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).casefold()
        text = re.sub(r"(?<=\w)[-‐‑][ \t]*\r?\n[\s>#*/|;-]*(?=\w)", "", text)
        return re.sub(r"(?<=\w)[-‐‑'’](?=\w)", "", text)
    text = text.lower()
    if "-" in text:
        text = re.sub(r"(?<=\w)-[ \t]*\r?\n[\s>#*/|;-]*(?=\w)", "", text)
    return re.sub(r"(?<=\w)[-'](?=\w)", "", text) if "-" in text or "'" in text else text


_WORD = re.compile(r"[^\W_]+")


def units(text: str, chars: bool) -> list[str]:
    """The words of a text, or its letters and digits. A word with inner hyphens or apostrophes is one word."""
    words = _WORD.findall(normal_text(text))
    return list("".join(words)) if chars else words


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hashes()


def grams(u: list[str], chars: bool, q: int) -> np.ndarray:
    """A 64-bit hash of the q units from each place on."""
    if len(u) < q:
        return np.empty(0, np.int64)
    h = np.frombuffer("".join(u).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) if chars else np.fromiter(map(_HASHES.__getitem__, u), np.uint64, len(u))
    h = (h ^ (h >> np.uint64(29))) * _MIX[0]
    n = len(u) - q + 1
    out = np.zeros(n, np.uint64)
    for k in range(q):
        out = (out ^ (out >> np.uint64(31))) * _MIX[1] + h[k : k + n] * _MIX[k]
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def myers(pattern: list[str], text: list[str], most: int) -> bool:
    """Whether some stretch of text is within `most` edits of the pattern (Myers 1999, on unit symbols)."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for k, u in enumerate(pattern):
        masks[u] = masks.get(u, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for u in text:
        eq = masks.get(u, 0)
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (~(diag | plus) & full)
        down = plus & diag
        score += bool(up & top) - bool(down & top)
        if score <= most:
            return True
        up, down = (up << 1) & full, (down << 1) & full  # a match may begin anywhere in the text
        plus = down | (~(diag | up) & full)
        minus = up & diag
    return False


def holds(doc: list[str], item: list[str], hits: list[tuple[int, int]], chars: bool) -> bool:
    """Whether doc holds WORDS (CHARS) or more successive units of the item within the error rate. hits: the places
    (in doc, in item) of all shared pieces.

    Hits of one window lie on diagonals that differ by its errors at most, so they fall into clusters, and the work
    grows with the text around the hits and not with pairs of them. A window is verified if it shares enough pieces
    and, an error spoiling at most SHORT of them, enough grams of SHORT units with the cluster's stretch of doc."""
    least, q, n = CHARS if chars else WORDS, PIECE[chars], len(item)
    most = n // ERROR_UNITS
    ordered = np.array(sorted((at - i, i) for at, i in hits), np.int64)
    breaks = np.flatnonzero(np.diff(ordered[:, 0]) > most) + 1
    short = grams(item, chars, SHORT)
    lengths = [least, *range(-(-(least + 1) // ERROR_UNITS) * ERROR_UNITS, n + 1, ERROR_UNITS)]
    for cluster in np.split(ordered, breaks):
        low, high = int(cluster[0, 0]), int(cluster[-1, 0])
        pieces = np.zeros(n // q + 2, np.int64)
        pieces[1 + np.unique(cluster[:, 1] // q)] = 1
        pieces = np.cumsum(pieces)
        stretch = doc[max(0, low - most) : max(0, high + n + most)]
        common = np.concatenate(([0], np.cumsum(np.isin(short, grams(stretch, chars, SHORT)))))
        if common[-1] < min(k - SHORT + 1 - SHORT * (k // ERROR_UNITS) for k in lengths):
            continue
        for length in lengths:
            errors, start = length // ERROR_UNITS, np.arange(n - length + 1)
            first, last = -(-start // q), (start + length) // q
            fit = pieces[last] - pieces[first] >= np.maximum(1, last - first - errors)
            fit &= common[start + length - SHORT + 1] - common[start] >= length - SHORT + 1 - SHORT * errors
            for at in np.flatnonzero(fit).tolist():
                if myers(item[at : at + length], doc[max(0, low + at - errors) : max(0, high + at + length + errors)], errors):
                    return True
    return False


def _passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for item_id, body in zip(pdf["item_id"], pdf["body"]):
            chars = 3 * len(_CJK.findall(body)) > len(re.findall(r"\w", body))
            u = units(body, chars)
            if len(u) >= (CHARS if chars else WORDS):
                rows.append((item_id, chars, u))
        yield pd.DataFrame(rows, columns=["item_id", "chars", "units"])


def passages(items: DataFrame) -> DataFrame:
    """(item_id, passage, chars, units): each item without the opening line that several items share; chars if it is
    counted in characters. Opening lines are compared over all items."""
    held = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("text")).where("item_id IS NOT NULL AND length(text) > 0").distinct()
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    held = Staged(held.withColumn("head", F.when(F.contains("text", F.lit("\n")), bare(F.substring_index("text", "\n", 1)))), "items").df
    shared = Staged(held.where("head IS NOT NULL").groupBy("head").agg(F.count_distinct("item_id").alias("k")).where("k > 1").select("head", F.lit(True).alias("shared")), "heads")
    body = F.when(F.col("shared"), F.substring(F.col("text"), F.instr("text", "\n") + 1, F.length("text"))).otherwise(F.col("text"))
    cut = held.join(small_side(shared), "head", "left").select("item_id", body.alias("body")).distinct()
    return cut.mapInPandas(_passages, "item_id bigint, chars boolean, units array<string>").withColumn("passage", F.xxhash64("item_id", "units"))


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for passage, chars, u in zip(pdf["passage"], pdf["chars"], pdf["item"]):
            q = PIECE[chars]
            g = grams(list(u), chars, q)
            rows += [(passage, chars, int(g[at]), at) for at in range(0, len(u) - q + 1, q)]
        yield pd.DataFrame(rows, columns=["passage", "chars", "h", "off"]).astype({"passage": "int64", "h": "int64", "off": "int32"})


def _bitmaps(pieces: DataFrame) -> dict[bool, tuple[np.ndarray, np.ndarray]]:
    """Of each way of counting the words (places and bits) of the bitmap that are not empty: 1 M words at most."""
    slots = pieces.select("chars", F.pmod("h", F.lit(BITMAP_BITS)).alias("slot")).distinct()
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("slot") % 64).cast("int"))
    rows = slots.groupBy("chars", F.floor(F.col("slot") / 64).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    out = {}
    for chars in (False, True):
        mine = sorted((r.word, r.bits) for r in rows if r.chars is chars)
        if mine:
            out[chars] = (np.array([w for w, _ in mine], np.int64), np.array([b for _, b in mine], np.int64).view(np.uint64))
    return out


_SUSPECTS = "doc_id bigint, copy bigint, chars boolean, units array<string>, hits array<struct<at: int, h: bigint>>"


def _scan(sparse: dict[bool, tuple[np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmaps = {}
        for chars, (words, bits) in sparse.items():
            bitmaps[chars] = np.zeros(BITMAP_BITS // 64, np.uint64)
            bitmaps[chars][words] = bits
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                words = _WORD.findall(normal_text(text))
                for chars, bitmap in bitmaps.items():
                    if chars and not _CJK.search(text):
                        continue
                    u = list("".join(words)) if chars else words
                    g = grams(u, chars, PIECE[chars])
                    slot = g.view(np.uint64) & np.uint64(BITMAP_BITS - 1)
                    at = np.flatnonzero((bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
                    if len(at):
                        copy = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
                        rows.append((doc_id, copy - (copy >> 63 << 64), chars, u, [{"at": int(a), "h": int(g[a])} for a in at]))
            yield pd.DataFrame(rows, columns=["doc_id", "copy", "chars", "units", "hits"])

    return run


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep = [holds(list(u), list(i), [(h["at"], h["off"]) for h in hits], chars) for u, i, hits, chars in zip(pdf["units"], pdf["item"], pdf["places"], pdf["chars"])]
        yield pdf.loc[np.array(keep, bool), ["doc_id", "item_id"]]


def _spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, small: bool) -> DataFrame:
    """Joins rows of documents with a table of items: by broadcast if that is small, else with SALTS copies of it, so
    that the documents of a frequent key go to as many tasks."""
    if small:
        return left.join(F.broadcast(right), keys)
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    return left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS))).join(right.withColumn("salt", copies), [*keys, "salt"]).drop("salt")


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct (doc_id, item_id): the document holds WORDS successive words (CHARS characters) of the item.

    Null and empty texts and ids give no row, items shorter than a passage cannot leak, repeated rows count once, equal
    documents under several ids give a row each. Other columns are ignored. Documents are read once, whatever the number
    of items; what is kept of them are those that hold a gram of the bitmap."""
    held = Staged(passages(items).withColumnRenamed("units", "item"), "passages")
    pieces = Staged(held.df.mapInPandas(_pieces, "passage bigint, chars boolean, h bigint, off int"), "pieces")
    item_units = held.df.agg(F.coalesce(F.sum(F.size("item")), F.lit(0))).first()[0]
    docs = balanced(documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND length(text) > 0"), "doc_id")
    suspects = Staged(docs.mapInPandas(_scan(_bitmaps(pieces.df)), _SUSPECTS), "suspects").df
    one, tasks = ["doc_id", "copy", "chars"], 2 * documents.sparkSession.sparkContext.defaultParallelism
    rows = suspects.select(*one, F.inline("hits"))
    shared = _spread_join(rows, pieces.df, ["chars", "h"], "doc_id", pieces.count() <= BROADCAST_ROWS)
    # numbers of partitions that adaptive execution keeps, for the rows are small and the work on them is not
    pairs = shared.repartition(tasks, *one).groupBy(*one, "passage").agg(F.collect_set(F.struct("at", "off")).alias("places"))
    texts = suspects.select(*one, "units").repartition(tasks, *one).dropDuplicates(one)
    both = _spread_join(pairs.join(texts.hint("shuffle_merge"), one), held.df.drop("chars"), ["passage"], "doc_id", item_units <= BROADCAST_UNITS)
    return both.select("doc_id", "item_id", "chars", "units", "item", "places").mapInPandas(_verified, "doc_id bigint, item_id bigint").distinct()
