"""Evaluation texts that leak into documents, found by template windows.

Both sides are brought to plain words (no case, punctuation, markup, escapes, line prefixes). Words become typed words:
numbers, names and units turn into placeholders, all others stand for themselves. Windows of six typed words are
hashed; a document window that hash-joins an item window proposes an alignment (item, diagonal). The join's smaller
side, the windows of the items, is broadcast in blocks of bounded size, so the documents are never shuffled.

An alignment counts as *literal* if at least ``least`` consecutive item words stand there with at most one in ten
replaced. Why six: of any 18 or more words with at most one in ten replaced, six neighbours are untouched. In literal windows the words that
items use as names and units are typed, and all numbers; a window of four placeholders or more joins by the words themselves, so that a
table of numbers is not everywhere alike, and one of six equal words only at the edges of their run.

An alignment counts as *re-parameterised* if ``least_template`` typed words, and half of the item's, agree (one in ten may differ), some slot has another value,
and the replacement is consistent: a value is always replaced by the same value, and different values by different ones. Here the types are told
by the words themselves, so that values no item has ever held still fit a slot: a number (of whatever form) is a number, the word after it
is its unit, and a word capitalised within a sentence, or one that begins a sentence and that items never use in lower case, is a name.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import compress, repeat
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 6
LEAST = 18
LEAST_TEMPLATE = 13  # typed words, a number with its fractions and groups being one: eight windows in a row
LEAST_FIXED = 6  # of which so many stand for themselves
COVER = 0.5  # of an item's typed words: a shorter stretch is a sentence in the same style, not the question again
BLOCK_WORDS = 2_000_000

_WORD = re.compile(r"[^\W_]+")
_MARKED = re.compile(r"[^\W_]+|[.?!:](?=\s|$)|\n(?=\s*\n)")
_ENDS = frozenset((".", "?", "!", ":", "\n"))
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,300}>")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_ESCAPED = re.compile(r"\\(?:u00[0-9a-fA-F]{2}|x[0-9a-fA-F]{2}|[nrtbf\"'/\\])")
_PERCENT = re.compile(r"%(?:20|0[9AaDd]|2[0-9A-Fa-f]|3[A-Fa-f])")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t>#*/;|-]*(?=[^\W\d_])")
_PREFIX = re.compile(r"^[ \t]*(?:(?:[>#*+|%;!:]+|-+|//+|/\*+|\(?\d{1,4}[.):|\]](?=\s)|\[\d+\]|[A-Za-z]{1,12}>(?=\s))[ \t]*)+", re.M)


def plain(text: str | None) -> str:
    """A text without markup, escapes, broken words and line prefixes; '' for a null text."""
    if not text:
        return ""
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPED.sub(" ", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "%" in text:
        text = _PERCENT.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    if "-\n" in text or "-\r" in text:
        text = _BROKEN.sub("", text)
    return _PREFIX.sub("", text)


def words(text: str | None) -> list[str]:
    """The plain words of a text; none of a null text."""
    return _WORD.findall(plain(text).casefold())


def split(text: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(plain words without case, which are capitalised within a sentence, which begin one capitalised)."""
    tokens = _MARKED.findall(plain(text))
    if not tokens:
        return [], np.zeros(0, bool), np.zeros(0, bool)
    folded = "\0".join(tokens).casefold().split("\0")
    high = np.fromiter(map(ne, tokens, folded), bool, len(tokens))
    ends = np.fromiter(map(_ENDS.__contains__, folded), bool, len(tokens))
    begins = np.concatenate([[True], ends[:-1]])
    for _ in range(3):  # a break after a full stop still begins a sentence
        begins[1:] |= begins[:-1] & ends[:-1]
    words_ = ~ends
    return list(compress(folded, words_.tolist())) if ends.any() else folded, (high & ~begins)[words_], (high & begins)[words_]


def _lexicons(texts: list[str]) -> tuple[set[str], set[str]]:
    """Names and units of the items: capitalised inside a sentence; up to two words after a number."""
    names = {m[1].casefold() for t in texts for m in re.finditer(r"(?<=[\w,;] )([A-Z][^\W_]+)", t)}
    units = {m[1].casefold() for t in texts for m in re.finditer(r"\b\d+ (?:[^\W\d_]+ )?([^\W\d_]{4,}s)\b", t)}
    return names, units - names


NUMBER, NAME, UNIT = 1, 2, 3


def hashed(codes: np.ndarray) -> np.ndarray:
    """A hash of each window of ``WIDTH`` codes."""
    n = len(codes) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(WIDTH):
        h = (h ^ codes[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.astype(np.int64)


def _in_windows(marks: np.ndarray) -> np.ndarray:
    """How many words of each window are marked."""
    return np.convolve(marks, np.ones(WIDTH, np.int64), "valid") if len(marks) >= WIDTH else np.empty(0, np.int64)


class Index:
    """Windows of the items of a block by hash."""

    def __init__(self, windows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """``windows`` are the places and hashes of each item's windows."""
        self.hashes = np.concatenate([h for _, h in windows]) if windows else np.empty(0, np.int64)
        where = [np.stack([np.full(len(at), i), at], axis=1) for i, (at, _) in enumerate(windows)]
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.where = self.hashes[order], (np.concatenate(where)[order] if where else np.empty((0, 2), np.int64))

    def diagonals(self, at: np.ndarray, h: np.ndarray, most: int = 1 << 20) -> np.ndarray:
        """The different (item, shift) that windows ``h`` at places ``at`` propose; joined ``most`` pairs at a time."""
        low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        found = high > low
        if not found.any():
            return np.empty((0, 2), np.int64)
        at, low, count = at[found], low[found], (high - low)[found]
        part = np.cumsum(count) // most
        out = []
        for p in np.unique(part):
            own = part == p
            n = count[own]
            begin = np.repeat(low[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            out.append(np.unique(np.stack([self.where[begin, 0], np.repeat(at[own], n) - self.where[begin, 1]], axis=1), axis=0))
        return out[0] if len(out) == 1 else np.unique(np.concatenate(out), axis=0)


class Templates:
    """The windows of a block of items, ready to be joined with documents."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        names, units = _lexicons([t for _, t in items if t])
        self.ids: dict[str, int] = {}
        own = [(item, *split(text)) for item, text in items]
        for _, low, _, _ in own:
            for w in low:
                self.ids.setdefault(w, len(self.ids) + 10)
        # by id: the type in literal windows, and the code in templates of words that items use in lower case, which stand for themselves
        self.typed, self.fixed = np.zeros(len(self.ids) + 10, np.int64), np.zeros(len(self.ids) + 10, np.int64)
        for w, i in self.ids.items():
            self.typed[i] = NUMBER if w.isdigit() else NAME if w in names else UNIT if w in units else i
        for _, low, inner, first in own:
            plain_ids = np.array([self.ids[w] for w in low], np.int64)[~(inner | first)]
            self.fixed[plain_ids] = plain_ids
        self.items, self.templates = [], []
        for item, low, inner, first in own:
            if len(low) >= WIDTH:
                ids = np.array([self.ids[w] for w in low], np.int64)
                self.items.append((item, ids, self.typed[ids]))
                codes, begins = self.template(low, ids, self.numbers(low), inner, first)
                self.templates.append((codes, self.values(low, begins, 0, len(begins), codes)))
        self.literal_windows = Index([self._literal(own, typed) for _, own, typed in self.items])
        self.template_windows = Index([self._template(codes) for codes, _ in self.templates])

    @staticmethod
    def _literal(own: np.ndarray, typed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the windows that are known and tell something."""
        known = _in_windows((typed == 0).astype(np.int64)) == 0
        if not known.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        slots = _in_windows((typed < 10).astype(np.int64))
        words_ = _in_windows((own == 0).astype(np.int64)) == 0  # all words are the items' own
        by_words = slots >= 4
        change = np.concatenate([[True], own[1:] != own[:-1]]).astype(np.int64) if len(own) else np.empty(0, np.int64)
        inner = np.convolve(change[1:], np.ones(WIDTH - 1, np.int64), "valid") == 0 if len(own) >= WIDTH else np.empty(0, bool)  # six equal words
        edge = (change[: len(inner)] == 1) | np.concatenate([change[WIDTH:] == 1, [True]])[: len(inner)] if len(inner) else inner
        use = np.where(by_words, words_, known) & (~inner | edge)
        at = np.flatnonzero(use)
        if not len(at):
            return at, at
        h = hashed(typed)
        return at, (np.where(by_words, hashed(own), h) if by_words[at].any() else h)[at]

    @staticmethod
    def _template(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        use = (_in_windows((codes == 0).astype(np.int64)) == 0) & (_in_windows((codes >= 10).astype(np.int64)) >= 3)
        at = np.flatnonzero(use)
        return at, hashed(codes)[at] if len(at) else at

    @staticmethod
    def numbers(low: list[str]) -> np.ndarray:
        return np.fromiter(map(str.isdigit, low), bool, len(low))

    def template(self, low: list[str], ids: np.ndarray, number: np.ndarray, inner: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, places of their first words) of a text's words as a template: a run of digits is one number; 0 is a word that no item knows."""
        after = np.concatenate([[False], number[:-1]])
        codes = np.where(inner, NAME, self.fixed[ids])
        codes = np.where((codes == 0) & first, NAME, codes)
        codes = np.where(number, NUMBER, np.where(after, UNIT, codes))
        begins = np.flatnonzero(~(number & after))
        return codes[begins], begins

    @staticmethod
    def values(low: list[str], begins: np.ndarray, first: int, last: int, codes: np.ndarray) -> np.ndarray:
        """What stands in the slots ``first`` to ``last`` of a template, as numbers; words that stand for themselves give their code."""
        until = np.append(begins, len(low))
        return np.array([zlib.crc32(" ".join(low[until[i] : until[i + 1]]).encode()) if codes[i] < 10 else codes[i] for i in range(first, last)], np.int64)

    def alignments(self, text: str | None, least: int, least_template: int) -> Iterator[tuple[int, int, int, bool]]:
        """(item, words, replaced words, literal?) of the best alignment with each item."""
        low, inner, first = split(text)
        if len(low) < WIDTH:
            return
        literal = np.fromiter(map(self.ids.get, low, repeat(0)), np.int64, len(low))
        if np.count_nonzero(literal) < 3:
            return
        number = self.numbers(low)
        best: dict[int, tuple[int, int, bool]] = {}
        for place, found in self._quoted(literal, number, least):
            item = self.items[place][0]
            if found > best.get(item, (0, 0))[:2]:
                best[item] = (*found, True)
        for place, found in self._rewritten(low, self.template(low, literal, number, inner, first), least_template):
            item = self.items[place][0]
            if item not in best or (not best[item][2] and found > best[item][:2]):
                best[item] = (*found, False)
        for item, (n, replaced, is_literal) in best.items():
            yield item, n, replaced, is_literal

    def _quoted(self, literal: np.ndarray, number: np.ndarray, least: int) -> Iterator[tuple[int, tuple[int, int]]]:
        typed = np.where(number, NUMBER, self.typed[literal])
        for place, shift in self.literal_windows.diagonals(*self._literal(literal, typed)).tolist():
            _, own, _ = self.items[place]
            first, last = max(0, -shift), min(len(own), len(literal) - shift)
            if last - first >= least:
                n, replaced, _ = longest(own[first:last] == literal[first + shift : last + shift], least)
                if n:
                    yield place, (n, replaced)

    def _rewritten(self, low: list[str], own_template: tuple[np.ndarray, np.ndarray], least: int) -> Iterator[tuple[int, tuple[int, int]]]:
        codes, begins = own_template
        for place, shift in self.template_windows.diagonals(*self._template(codes)).tolist():
            own, own_values = self.templates[place]
            first, last = max(0, -shift), min(len(own), len(codes) - shift)
            long_enough = max(least, int(np.ceil(COVER * len(own))))
            if last - first < long_enough:
                continue
            a, b = slice(first, last), slice(first + shift, last + shift)
            n, _, begin = longest(own[a] == codes[b], long_enough)
            if not n:
                continue
            part = slice(begin, begin + n)
            x, y, kinds = own_values[a][part], self.values(low, begins, first + shift + begin, first + shift + begin + n, codes), own[a][part]
            alike = kinds == codes[b][part]
            slots, changed = alike & (kinds < 10), x != y
            if (alike & (kinds >= 10)).sum() >= LEAST_FIXED and (slots & changed).any() and consistent(x[slots], y[slots]):
                yield place, (n, int(changed.sum()))


def longest(same: np.ndarray, least: int) -> tuple[int, int, int]:
    """(length, mismatches, begin) of the longest stretch of at least ``least``, with equal ends and at most one in ten unequal; else (0, 0, 0)."""
    n = len(same)
    if n < least or same.sum() < 0.9 * least:
        return 0, 0, 0
    debt = np.concatenate([[0], np.cumsum(np.where(same, -1, 9))])  # falls by 1 a word, rises by 10 a mismatch
    starts, ends = np.flatnonzero(same), np.flatnonzero(same) + 1
    highest = np.maximum.accumulate(debt[starts])
    best = (0, 0, 0)
    first = np.searchsorted(highest, debt[ends], "left")  # the first start whose debt is no lower than the end's
    ok = first < len(starts)
    if ok.any():
        length = np.where(ok, ends - starts[np.minimum(first, len(starts) - 1)], 0)
        top = int(length.argmax())
        if length[top] >= least:
            begin = starts[first[top]]
            best = (int(length[top]), int((~same[begin : ends[top]]).sum()), int(begin))
    return best


def consistent(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether equal values of ``a`` always meet equal values of ``b``, and different ones different ones."""
    pairs = set(zip(a.tolist(), b.tolist(), strict=True))
    return len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs})


def _scan(templates, least: int, least_template: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = templates.value
        for batch in batches:
            rows = [(item, doc, n, replaced, is_literal) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for item, n, replaced, is_literal in own.alignments(text, least, least_template)]
            if rows:
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["item_id", "doc_id", "words", "replaced", "literal"])

    return run


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = LEAST, least_template: int = LEAST_TEMPLATE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item_id, doc_id, words, replaced, literal): every document that holds a passage of an item.

    Null or empty texts leak nothing; items shorter than ``least`` words cannot be found; repeated rows of one id give
    one row. The items are taken in blocks of about ``block_words`` words, each broadcast and joined with all
    documents: the broadcast is bounded, and a large test set costs more passes, not more memory.
    """
    spark = documents.sparkSession
    own = items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    size = own.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * block_words)))
    docs = documents.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    found = None
    for b in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).orderBy("i", "t").collect()
        templates = spark.sparkContext.broadcast(Templates([(r.i, r.t) for r in rows]))
        part = docs.mapInArrow(_scan(templates, least, least_template), "item_id long, doc_id long, words long, replaced long, literal boolean")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("item_id", "doc_id").agg(F.max(F.struct("literal", "words", "replaced")).alias("b")).select("item_id", "doc_id", "b.words", "b.replaced", "b.literal")
