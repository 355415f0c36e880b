"""Evaluation texts that leak into training text: pigeonhole edit matching.

A passage leaks if a stretch of ``n`` of its consecutive words stands in a document with at most ``n / rate`` words changed, added
or left out, and at least ``min_words`` of its words are there, in order.  With 12 words and a rate of six, every such stretch holds
one of these windows: 12 to 14 words with two edits, 18 with three or 24 with four (``WINDOWS``).  For between edits stand runs of
unchanged words; without a window of 14, three neighbouring runs have at most 11 of them, and five edits or more would need
more than that.  Cut a window with ``e`` edits into ``e + 1`` pieces: one of them, of four words or more, stands in the document
unchanged.  So every run of four words of each item is looked up in each document, and each hit is verified with Myers'
bit-parallel distance over words; windows under 14 words are then aligned, to see that 12 of their words are there.

Defined results: case, punctuation, markup, quotes, spacing and invisible characters are ignored; null and empty
texts and items of fewer than ``min_words`` words yield nothing; repeated rows yield one pair; extra columns are
ignored.
"""

from __future__ import annotations

import itertools
import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_WORDS, RATE = 12, 6
#: Bytes of items whose pieces are sent to the executors at once; more items are handled in as many passes.
BYTES_A_PASS = 4 << 20

_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")


def words(text: str | None) -> list[str]:
    """The words of a text, without case and all that isn't a letter or digit."""
    if not text:
        return []
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.casefold())


def within(pattern: list, text: list, most: int) -> bool:
    """Whether some stretch of ``text`` is within ``most`` edits of ``pattern`` (Myers 1999, words as symbols)."""
    m = len(pattern)
    at: dict = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for w in text:
        eq = at.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        if score <= most:
            return True
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
    return False


def kept(pattern: list, text: list, edits: int) -> int:
    """The most words of ``pattern`` that stand unchanged, in order, in a stretch of ``text`` within ``edits`` edits of it."""
    low = -len(pattern)  # no such stretch
    # best[e] at a place of the text: words kept of the pattern's words so far, at e edits
    before = [[0] + [low] * edits for _ in range(len(text) + 1)]
    for w in pattern:
        now = [[low] * (edits + 1) for _ in before]
        for j, cell in enumerate(now):
            for e in range(edits + 1):
                cell[e] = before[j][e - 1] if e else low  # left out
                if j:
                    if text[j - 1] == w:
                        cell[e] = max(cell[e], before[j - 1][e] + 1)
                    if e:
                        cell[e] = max(cell[e], before[j - 1][e - 1], now[j - 1][e - 1])  # changed, added
        before = now
    return max(max(cell) for cell in before)


def windows(min_words: int = MIN_WORDS, rate: int = RATE) -> list[tuple[int, int]]:
    """(words, edits) of the windows of which every leaking stretch holds one; see the module's text for the proof."""
    few = min_words // rate
    short = [(n, n // rate) for n in range(min_words, min_words + few + 1)]
    return short + [(e * rate, e) for e in range(few + 1, 2 * few + 1)]


class Pieces:
    """All runs of a piece's length of a block of items, by their words."""

    def __init__(self, items: list[tuple[int, str]], min_words: int = MIN_WORDS, rate: int = RATE):
        self.min_words, self.windows = min_words, windows(min_words, rate)
        self.size = min(n // (e + 1) for n, e in self.windows)
        self.items = [(k, w) for k, t in items if len(w := words(t)) >= min_words]
        self.at: dict[tuple, list[tuple[int, int]]] = {}
        for n, (_, w) in enumerate(self.items):
            for i in range(len(w) - self.size + 1):
                self.at.setdefault(tuple(w[i : i + self.size]), []).append((n, i))

    def found(self, text: str | None) -> list[int]:
        """The items that leak into a text."""
        doc = words(text)
        hits = [(n, i, j) for j, g in enumerate(zip(*(doc[k:] for k in range(self.size)))) if g in self.at for n, i in self.at[g]]
        done: set[int] = set()
        tried: set[tuple] = set()  # hits in one line share their windows
        for n, i, j in hits:
            if n not in done and self.verified(n, doc, i, j, tried):
                done.add(n)
        return [self.items[n][0] for n in done]

    def verified(self, n: int, doc: list[str], i: int, j: int, tried: set[tuple]) -> bool:
        """Whether a window of item ``n`` around its piece at ``i`` stands around place ``j`` of the document."""
        item = self.items[n][1]
        longest, most = self.windows[-1]
        reach = longest - self.size
        first, last = max(0, i - reach), min(len(item), i + longest)
        there = set(doc[max(0, j - reach - most) : j + longest + most])
        # held[k]: how many of the item's words from ``first`` up to k stand near
        held = [0, *itertools.accumulate(w in there for w in item[first:last])]
        for window, edits in self.windows:
            least = max(self.min_words, window - edits)
            for s in range(max(0, i - window + self.size), min(i, len(item) - window) + 1):
                if held[s + window - first] - held[s - first] < least or (test := (n, window, s, j - i)) in tried:
                    continue
                tried.add(test)
                at = s + j - i
                pattern, near = item[s : s + window], doc[max(0, at - edits) : at + window + edits]
                if within(pattern, near, edits) and (window - edits >= self.min_words or kept(pattern, near, edits) >= self.min_words):
                    return True
        return False


def leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, *, min_words: int = MIN_WORDS, rate: int = RATE, bytes_a_pass: int = BYTES_A_PASS) -> DataFrame:
    """(item_id, doc_id), each pair once.  The documents are scanned in place; only the pieces of about ``bytes_a_pass`` bytes
    of items travel to the executors, and only found pairs are shuffled."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // bytes_a_pass))
    key = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for number in range(passes):
        block = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number).select("item_id", "text")
        sent = spark.sparkContext.broadcast([(r.item_id, r.text) for r in block.collect() if r.item_id is not None])

        def scan(batches, sent=sent):
            import pandas as pd

            pieces = Pieces(sent.value, min_words, rate)
            for pdf in batches:
                pairs = [(item, doc) for doc, text in zip(pdf["doc_id"], pdf["text"]) for item in pieces.found(text)]
                yield pd.DataFrame(pairs, columns=["item_id", "doc_id"])

        part = docs.select("doc_id", "text").filter(F.length("text") > 0).mapInPandas(scan, f"item_id bigint, doc_id {key}")
        out = part if out is None else out.unionByName(part)
    return out.distinct()
