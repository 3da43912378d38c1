"""Python regular expressions over columns of lines.

Rules and searches are written for Python's ``re``. Over a column they run on Arrow's engine (RE2), which looks at each byte
once: ``translated`` walks a pattern's syntax tree and writes down what RE2 can say of it. For lines within ASCII the translation
finds what Python finds, or more where the pattern looks around or back; such finds are tried again by Python. Lines beyond
ASCII, where word characters and white space differ, are always tried by Python, and so is a pattern that cannot be translated.
"""

from __future__ import annotations

import functools
import re
import warnings
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CLASSES = {sre.CATEGORY_DIGIT: "0-9", sre.CATEGORY_SPACE: r"\t-\r\x1c-\x20", sre.CATEGORY_WORD: "0-9A-Za-z_"}
_OTHERS = {sre.CATEGORY_NOT_DIGIT: r"\x00-/:-\x7f", sre.CATEGORY_NOT_SPACE: r"\x00-\x08\x0e-\x1b!-\x7f", sre.CATEGORY_NOT_WORD: r"\x00-/:-@\[-\^`{-\x7f"}
_MOST_REPEATS = 1000  # of RE2


class _Untranslatable(Exception):
    """The pattern has something that RE2 cannot even bound."""


def _char(code: int) -> str:
    c = chr(code)
    return c if c.isalnum() or code > 127 else f"\\x{{{code:x}}}"


class _Translation:
    def __init__(self) -> None:
        self.exact = True

    def nodes(self, nodes: list, last: bool) -> str:
        return "".join(self.node(op, arg, last and i == len(nodes) - 1) for i, (op, arg) in enumerate(nodes))

    def node(self, op, arg, last: bool) -> str:
        if op is sre.LITERAL:
            return _char(arg)
        if op is sre.NOT_LITERAL:
            return f"[^{_char(arg)}]"
        if op is sre.ANY:
            return "."
        if op is sre.IN:
            return self.members(arg)
        if op is sre.BRANCH:
            return "(?:" + "|".join(self.nodes(list(b), last) for b in arg[1]) + ")"
        if op is sre.SUBPATTERN:
            _, added, removed, inner = arg
            flags = "".join(letter for letter, bit in (("i", re.I), ("m", re.M), ("s", re.S)) if added & bit) + ("-i" if removed & re.I else "")
            if (added | removed) & re.M or (added | removed) & re.S or removed & ~re.I:
                raise _Untranslatable
            return f"(?{flags}:" + self.nodes(list(inner), last) + ")"
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            if op is sre.POSSESSIVE_REPEAT:
                self.exact = False
            low, high, inner = arg
            if low > _MOST_REPEATS or (high is not sre.MAXREPEAT and high > _MOST_REPEATS):
                raise _Untranslatable
            body = "(?:" + self.nodes(list(inner), False) + ")"
            return body + ("*" if (low, high) == (0, sre.MAXREPEAT) else "+" if (low, high) == (1, sre.MAXREPEAT) else "?" if (low, high) == (0, 1) else f"{{{low},}}" if high is sre.MAXREPEAT else f"{{{low},{high}}}")
        if op is sre.ATOMIC_GROUP:
            self.exact = False
            return "(?:" + self.nodes(list(arg), last) + ")"
        if op is sre.AT:
            return self.place(arg, last)
        if op in (sre.ASSERT, sre.ASSERT_NOT):
            self.exact = False
            return ""
        if op is sre.GROUPREF:
            self.exact = False
            return "(?s:.*)"
        raise _Untranslatable

    def place(self, where, last: bool) -> str:
        if where in (sre.AT_BEGINNING, sre.AT_BEGINNING_STRING):
            return r"\A"
        if where is sre.AT_BOUNDARY:
            return r"\b"
        if where is sre.AT_END_STRING:
            return r"\z"
        if where is sre.AT_END and last:
            return r"(?:\n?\z)"
        self.exact = False
        return ""

    @staticmethod
    def members(items: list) -> str:
        out, negated = [], False
        for op, arg in items:
            if op is sre.NEGATE:
                negated = True
            elif op is sre.LITERAL:
                out.append(_char(arg))
            elif op is sre.RANGE:
                out.append(f"{_char(arg[0])}-{_char(arg[1])}")
            elif op is sre.CATEGORY:
                out.append(_CLASSES.get(arg) or _OTHERS[arg])
            else:
                raise _Untranslatable
        return f"[{'^' if negated else ''}{''.join(out)}]"


def translated(source: str, flags: int = 0, start: bool = False) -> tuple[str | None, bool]:
    """(RE2 pattern, whether it is exact over ASCII); None where RE2 has no word for it."""
    tree = parser.parse(source, flags)
    if tree.state.flags & (re.M | re.S | re.L | re.A):
        return None, False
    out = _Translation()
    try:
        body = out.nodes(list(tree), True)
    except _Untranslatable:
        return None, False
    return ("(?i)" if tree.state.flags & re.I else "") + (r"\A" if start else "") + f"(?:{body})", out.exact


class Pattern:
    """A compiled pattern that can be tried on a line or on a column of lines; with ``start`` only at a line's beginning."""

    def __init__(self, source: str, flags: int = 0, start: bool = False) -> None:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)
            self.compiled = re.compile(source, flags)
            self.re2, self.exact = translated(source, flags, start)
        self.find = self.compiled.match if start else self.compiled.search
        if self.re2 is not None:
            try:
                pc.match_substring_regex(pa.array([""]), self.re2)
            except pa.ArrowInvalid:
                self.re2 = None

    def mask(self, lines: pa.Array, beyond: np.ndarray) -> np.ndarray:
        """Which lines match; ``beyond`` marks those beyond ASCII. No line may be null."""
        if not len(lines):
            return np.zeros(0, bool)
        if self.re2 is None:
            return np.fromiter((self.find(x) is not None for x in lines.to_pylist()), bool, len(lines))
        hit = np.array(pc.match_substring_regex(lines, self.re2))
        again = np.flatnonzero(beyond if self.exact else beyond | hit)
        if len(again):
            hit[again] = [self.find(x) is not None for x in lines.take(pa.array(again)).to_pylist()]
        return hit


@functools.lru_cache(4096)
def pattern(source: str, flags: int = 0, start: bool = False) -> Pattern:
    return Pattern(source, flags, start)


@functools.lru_cache(256)
def either(sources: tuple[str, ...]) -> Pattern | None:
    """One pattern for several, to find the lines worth trying each on; None if they cannot be put together."""
    own = [pattern(s) for s in sources]
    if not own or any(p.re2 is None or p.compiled.flags & re.I != own[0].compiled.flags & re.I for p in own):
        return None
    both = Pattern("")
    both.re2, both.exact, both.find = "|".join(f"(?:{p.re2})" for p in own), True, lambda x: next((m for p in own if (m := p.find(x))), None)
    return both


def beyond_ascii(lines: pa.Array) -> np.ndarray:
    return ~np.array(pc.string_is_ascii(lines))


def first_group(m: re.Match) -> str:
    """The first capture group with something in it, stripped; '' if there is none."""
    return next((str(g).strip() for g in m.groups() if g), "")


class Searches:
    """Positive and negative searches: the first positive that matches wins, any negative vetoes.

    ``params`` are rows (positive, raw, regex). As in the rule language, regular expressions are verbose and ignore case
    unless ``case_sensitive``.
    """

    def __init__(self, params, case_sensitive: bool = False) -> None:
        flags = re.X if case_sensitive else re.X | re.I
        self.positive = [(raw, regex, pattern(regex, flags)) for positive, raw, regex in params if positive]
        self.negative = [pattern(regex, flags) for positive, _, regex in params if not positive]

    def index(self, lines: pa.Array, beyond: np.ndarray) -> np.ndarray:
        """Number of the winning positive search of each line, -1 if none or vetoed."""
        out = np.full(len(lines), -1, np.int32)
        for i, (_, _, p) in enumerate(self.positive):
            out[(out < 0) & p.mask(lines, beyond)] = i
        hit = np.flatnonzero(out >= 0)
        if len(hit) and self.negative:
            some, far = lines.take(pa.array(hit)), beyond[hit]
            veto = np.zeros(len(hit), bool)
            for p in self.negative:
                veto |= p.mask(some, far)
            out[hit[veto]] = -1
        return out

    def match(self, at: int, line: str) -> str:
        m = self.positive[at][2].find(line)
        return first_group(m) if m else ""


@functools.lru_cache(1024)
def searches(params: tuple, case_sensitive: bool = False) -> Searches:
    return Searches(params, case_sensitive)
