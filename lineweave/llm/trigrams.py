"""A trigram index over blocks of lines, and the trigrams that a regular expression cannot match without.

A block is a batch of rows of a split. Its index has, for each key that some expression asks for, the sorted numbers of the
rows that hold it; a key is a trigram of bytes in lower case, folded as ``(?i)`` compares, or a feature such as "a long run of token characters"
for expressions that contain no fixed text. A query is a set of alternatives, each a set of keys that must all be
there; intersecting the postings of an alternative gives the candidate rows, and the expression is tried on those
alone. Blocks are indexed where they are read, so nothing is shuffled, and an index is never larger than its block.
"""

from __future__ import annotations

import re
from re import _casefix as casefix
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONG_RUN = 1 << 24  # feature: a run of at least RUN characters of [A-Za-z0-9+/_-] with both letters and digits
RUN = 16
JOINED = LONG_RUN + 1  # feature: two quotes with a joining sign between them, and white space (here: nothing printable in ASCII) around it
_JOINED = r"""["'][^!-~]*(?:\+|\.\.?|&|\|\|)[^!-~]*["']"""
START = " "  # indexed texts have it before their first character, so that a short word at the start has a trigram
_MOST_ALTERNATIVES = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), 43, 47, 45, 95]] = True


# letters that (?i) takes for another although their lower case differs, such as the long s
_ALIKE = {other: chr(min(c, *others)) for c, others in casefix._EXTRA_CASES.items() for other in (c, *others)} | {0x130: "i"}


def fold(text: str) -> str:
    return text.translate(_ALIKE).lower().translate(_ALIKE)


def _folded(column: pa.Array) -> pa.Array:
    """Texts as large binaries, those with characters beyond ASCII folded; ASCII is folded byte by byte."""
    raw = column.cast(pa.large_binary())
    beyond = pc.invert(pc.fill_null(pc.string_is_ascii(column), True))
    if not pc.any(beyond).as_py():
        return raw
    return pc.replace_with_mask(raw, beyond, pa.array([fold(x.decode("utf-8", "replace")).encode("utf-8", "replace") for x in raw.filter(beyond).to_pylist()], pa.large_binary()))


def _of(text: str) -> frozenset[int]:
    """The keys of a text, but for long runs."""
    raw = bytes(_LOWER[np.frombuffer(fold(text).encode("utf-8", "replace"), np.uint8)])
    return frozenset(raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2)) | ({JOINED} if re.search(_JOINED, text) else frozenset())


def _cross(a: set[frozenset], b: set[frozenset]) -> set[frozenset]:
    if frozenset() in a or frozenset() in b:  # one side is certain of nothing
        return b if frozenset() in a else a
    both = {x | y for x in a for y in b}
    return both if len(both) <= _MOST_ALTERNATIVES else a if len(a) <= len(b) else b


def required(pattern: str) -> set[frozenset[int]]:
    """Alternatives of trigram sets, one of which every match holds; {empty set} if nothing is certain."""
    return _sequence(list(parser.parse(pattern)))


def _sequence(nodes: list) -> set[frozenset[int]]:
    need: set[frozenset[int]] = {frozenset()}
    texts = [""]  # the fixed texts that end at this place

    def close() -> None:
        nonlocal need, texts
        if any(texts):
            need = _cross(need, {_of(t) for t in texts})
        texts = [""]

    for op, arg in nodes:
        if op is sre.LITERAL:
            texts = [t + chr(arg) for t in texts]
        elif op is sre.IN and (chars := _few(arg)) and len(texts) * len(chars) <= 16:
            texts = [t + c for t in texts for c in chars]
        elif op is sre.AT and arg in (sre.AT_BEGINNING, sre.AT_BEGINNING_STRING):
            texts = [t + START for t in texts]
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        elif op is sre.SUBPATTERN:
            inner = list(arg[3])
            fixed = _fixed(inner)
            if fixed is not None and len(texts) * len(fixed) <= 32:
                texts = [t + f for t in texts for f in fixed]
            else:
                close()
                need = _cross(need, _sequence(inner))
        elif op is sre.BRANCH:
            fixed = _fixed([(op, arg)])
            if fixed is not None and len(texts) * len(fixed) <= 32:
                texts = [t + f for t in texts for f in fixed]
            else:
                close()
                some = set().union(*(_sequence(list(b)) for b in arg[1]))
                need = _cross(need, {frozenset()} if frozenset() in some else some)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] >= 1:
            close()
            need = _cross(need, _sequence(list(arg[2])))
        else:
            close()
    close()
    return {frozenset()} if frozenset() in need else need


def _few(items: list) -> list[str] | None:
    chars = []
    for op, arg in items:
        if op is not sre.LITERAL:
            return None
        chars.append(chr(arg).lower())
    return sorted(set(chars)) if len(chars) <= 4 else None


def _fixed(nodes: list) -> list[str] | None:
    """All texts that nodes can match, if they are few and plain."""
    out = [""]
    for op, arg in nodes:
        if op is sre.LITERAL:
            more = [chr(arg)]
        elif op is sre.IN:
            more = _few(arg)
        elif op is sre.SUBPATTERN:
            more = _fixed(list(arg[3]))
        elif op is sre.BRANCH:
            parts = [_fixed(list(b)) for b in arg[1]]
            more = None if any(p is None for p in parts) else [t for p in parts for t in p]
        elif op is sre.AT and arg in (sre.AT_BEGINNING, sre.AT_BEGINNING_STRING):
            more = [START]
        elif op is sre.AT:
            more = [""]
        else:
            return None
        if more is None or len(out) * len(more) > 32:
            return None
        out = [a + b for a in out for b in more]
    return out


class Block:
    """The index of a block: postings of keys over columns of texts that share row numbers."""

    def __init__(self, columns: list[pa.Array], keys: np.ndarray) -> None:
        """``keys`` is the table of wanted trigrams (``wanted``)."""
        found, rows = [], []
        for column in columns:
            f, r = self._scan(column, keys)
            found.append(f)
            rows.append(r)
        pairs = np.unique(np.concatenate(found).astype(np.int64) << 32 | np.concatenate(rows))
        key, row = pairs >> 32, (pairs & 0xFFFFFFFF).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]) if len(key) else np.array([0])
        self.postings = {int(key[a]): row[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)}
        self._known: dict[frozenset[int], np.ndarray] = {}

    @staticmethod
    def _scan(column: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nothing = np.empty(0, np.int64), np.empty(0, np.int64)
        texts = _folded(column)
        data = texts.buffers()[2]
        if data is None or not len(texts):
            return nothing
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw, offsets = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
        if len(raw) < 3:
            return nothing
        low = _LOWER[raw].astype(np.uint32)
        tri = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
        at = np.flatnonzero(keys[tri])
        begin = offsets[:-1][np.diff(offsets) >= 2]
        first = np.uint32(ord(START)) << 16 | low[begin] << 8 | low[begin + 1]
        some = keys[first]
        runs = np.concatenate([[False], _TOKEN[raw], [False]])
        edges = np.flatnonzero(runs[1:] != runs[:-1])
        long_ = edges[::2][(edges[1::2] - edges[::2]) >= RUN]
        joined = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(column, _JOINED), False)).to_numpy().astype(np.int64)
        places = np.concatenate([at, begin[some], long_])
        found = np.concatenate([tri[at], first[some], np.full(len(long_), LONG_RUN), np.full(len(joined), JOINED)]).astype(np.int64)
        return found, np.concatenate([np.searchsorted(offsets, places, "right") - 1, joined])

    def _all(self, alternative: frozenset[int]) -> np.ndarray:
        rows = self._known.get(alternative)
        if rows is None:
            lists = sorted((self.postings.get(k, _NONE) for k in alternative), key=len)
            rows = lists[0] if lists else _NONE
            for more in lists[1:]:
                if not len(rows):
                    break
                rows = rows[np.isin(rows, more, assume_unique=True)]
            self._known[alternative] = rows
        return rows

    def candidates(self, query: set[frozenset[int]]) -> np.ndarray:
        """The rows that hold all keys of some alternative."""
        return np.unique(np.concatenate([self._all(a) for a in query]))


_NONE = np.empty(0, np.int64)


def wanted(queries: dict[str, set[frozenset[int]]]) -> np.ndarray:
    table = np.zeros(1 << 24, bool)
    table[[k for q in queries.values() for a in q for k in a if k < LONG_RUN]] = True
    return table


def check(pattern: re.Pattern, text: str) -> bool:
    """For tests: a match implies one of the required alternatives."""
    return not pattern.search(text) or any(a <= _of(START + text) for a in required(pattern.pattern))
