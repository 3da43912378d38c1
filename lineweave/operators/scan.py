"""The line scan: every line of a file classified by block and comment state, without a shuffle.

A file is a row. An Arrow function lays the lines of a batch of files flat, keeps each different line once, and matches
the patterns of a rule set on those columns of lines (``functions.match``). The automata then run over the flags of all lines of
the batch with array arithmetic, and what an operator wants of a file (counts, hits, routines) comes back as one value per
file. Lines never leave their file's row, so nothing is shuffled or sorted; text crosses into Python once, whatever the
number of patterns. Patterns that only matter on code lines or on comment lines are matched on those alone.

Comments: over the lines of one block, a line sets, resets, toggles or keeps the state "inside a comment". The state before
a line is the value of the last set or reset, flipped once for every toggle since. Blocks: only lines that
match a start or end pattern are visited, and only in files that have a start.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.functions import match as M
from lineweave.plans import rules as R
from lineweave.plans.rules import Rules

(TRUE_BLANK, BLANK, SINGLE, OPEN, CLOSED_AGAIN, CLOSE, CODE_AROUND, DEAD, TEMPLATE, IMPORT, CLASS, PREPROCESSOR, ROUTINE, DECISION, INLINE, ESCAPE, CASE, BOOLEAN, START, IGNORED) = (1 << i for i in range(20))
# code of a line: bits 0-1 block, then:
COMMENT, LIVE, CHANGE, MEASURED = 4, 8, 16, 32
_BLOCK = 3
SLICE = 1 << 23  # bytes of text whose lines are looked at together

# the string pattern of the rules without its look-ahead: what it finds is the same
_STRINGS = "\"[^\"\n]+\"|'[^'\n]+'"


# -- lines ---------------------------------------------------------------------------------------------------------


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """(begin, end) of stretches of about ``most`` bytes; at least one."""
    sizes = np.array(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)] if len(texts) else [0, 0]
    return zip(cuts[:-1], cuts[1:], strict=True)


def normal_ends(texts: pa.Array) -> pa.Array:
    """Texts with line feeds for all line ends, none of them null."""
    texts = pc.fill_null(texts, "")
    return pc.replace_substring_regex(texts, "\r\n?", "\n") if pc.any(pc.match_substring(texts, "\r")).as_py() else texts


def split_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(lines with their line feeds, number of lines of each text); the text after the last line feed counts only if there is any."""
    parts = pc.split_pattern(texts, "\n")
    flat, sizes = parts.flatten(), np.array(pc.list_value_length(parts), np.int64)
    ends = np.cumsum(sizes) - 1
    last = np.zeros(len(flat), bool)
    last[ends] = True
    empty = np.array(pc.binary_length(flat), np.int64)[ends] == 0 if len(flat) else np.zeros(0, bool)
    keep = np.ones(len(flat), bool)
    keep[ends[empty]] = False
    feeds = pa.array(["", "\n"], flat.type).take(pa.array((~last[keep]).astype(np.int8)))
    return pc.binary_join_element_wise(flat.filter(pa.array(keep)), feeds, pa.scalar("", flat.type)), sizes - empty


def offsets_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def numbers_of(offsets: np.ndarray) -> np.ndarray:
    """1, 2, ... within each stretch."""
    return np.arange(1, offsets[-1] + 1) - np.repeat(offsets[:-1], np.diff(offsets))


def without_nul(lines: pa.Array) -> pa.Array:
    return pc.replace_substring(lines, "\0", "")


def distinct(lines: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(different lines, the number of each line among them)."""
    coded = lines.dictionary_encode()
    return coded.dictionary, np.array(coded.indices, np.int64)


def lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def chosen(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places where ``keep``, offsets of what is left of each stretch)."""
    return np.flatnonzero(keep), np.concatenate([[0], np.cumsum(keep)])[offsets].astype(np.int64)


# -- Spark ---------------------------------------------------------------------------------------------------------

Kernel = Callable[..., pa.Array]  # (texts, library flags or None) -> one value per text


def sliced(kernel: Kernel, texts: pa.Array, library: pa.Array | None = None) -> pa.Array:
    return pa.concat_arrays([kernel(texts.slice(a, b - a), None if library is None else library.slice(a, b - a)) for a, b in slices(texts)])


def per_file(kernel: Kernel, ddl: str, text: Column, library: Column | None = None) -> Column:
    """What ``kernel`` says of each text."""

    @F.arrow_udf(ddl)
    def run(texts: pa.Array, flags: pa.Array) -> pa.Array:
        return sliced(kernel, texts, flags)

    return run(text, F.lit(False) if library is None else library)


def per_entry(kernels: dict[int, Kernel], ddl: str, text: Column, wanted: Column, closed: Column, library: Column) -> Column:
    """An array of (entry, what the entry's kernel says of the text) for all ``wanted`` entries of a file.

    A file's text is read, decoded and sent once for all of them; kernels that are equal run once. For ``closed`` entries
    the file was not to be opened, and its text counts as null.
    """
    alike: dict = {}
    for number, kernel in kernels.items():
        key = (kernel.func, kernel.args, tuple(sorted(kernel.keywords.items()))) if isinstance(kernel, functools.partial) else kernel
        alike.setdefault(key, (kernel, []))[1].append(number)
    groups = list(alike.values())

    @F.arrow_udf(f"array<struct<entry:int,r:{ddl}>>")
    def run(texts: pa.Array, entries: pa.Array, shut: pa.Array, flags: pa.Array) -> pa.Array:
        def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            return np.repeat(np.arange(len(column)), np.array(pc.fill_null(pc.list_value_length(column), 0), np.int64)), np.array(column.flatten(), np.int64)

        file, entry = flat(entries)
        shut_file, shut_entry = flat(shut)
        most = max(kernels) + 1
        closed_pair = np.isin(file * most + entry, shut_file * most + shut_entry)
        found, files, numbers = [], [], []
        for kernel, own in groups:
            here = np.flatnonzero(np.isin(entry, own))
            if not len(here):
                continue
            states, at = np.unique(file[here] * 2 + closed_pair[here], return_inverse=True)
            rows = pa.array(states // 2)
            own_texts = pc.if_else(pa.array(states % 2 == 1), pa.scalar(None, texts.type), texts.take(rows))
            found.append(sliced(kernel, own_texts, flags.take(rows)).take(pa.array(at)))
            files.append(file[here])
            numbers.append(entry[here])
        counts = np.bincount(file, minlength=len(texts)) if len(file) else np.zeros(len(texts), np.int64)
        if not found:
            empty = groups[0][0](texts.slice(0, 0), flags.slice(0, 0))
            return lists(offsets_of(counts), pa.StructArray.from_arrays([pa.array([], pa.int32()), empty], names=["entry", "r"]))
        file, number = np.concatenate(files), np.concatenate(numbers)
        order = pa.array(np.lexsort((number, file)))
        both = pa.StructArray.from_arrays([pa.array(number, pa.int32()), pa.concat_arrays(found)], names=["entry", "r"])
        return lists(offsets_of(counts), both.take(order))

    return run(text, wanted, closed, library)


def items(df: DataFrame, keep: list, array: Column, name: str) -> DataFrame:
    """(keep..., ``name``): a row per element of an array that an Arrow function made.

    Spark would infer from a plain explode that the array must hold something, and run the function once more to see whether it does.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


# -- the scan ------------------------------------------------------------------------------------------------------


class Scanner:
    """The patterns of a rule set, compiled."""

    def __init__(self, rules: Rules) -> None:
        p = M.pattern
        self.rules, self.searches = rules, rules.searches
        self.string = None if rules.string == R.STRING else p(rules.string)
        self.blank = [p(x, 0, True) for x in (rules.blank, R.BLANK_XML if rules.blank_xml else None, rules.blank_add) if x]
        self.single, self.open, self.close = p(rules.single, 0, True), p(rules.open), p(rules.close)
        self.ignore = p(rules.ignore_line) if rules.ignore_line else None
        self.dead = p(rules.dead) if rules.dead else None
        self.code = {IMPORT: p(rules.imports), CLASS: p(rules.classes), PREPROCESSOR: p(rules.preprocessor)}
        self.decision, self.escape, self.case, self.boolean, self.routine = (p(x) for x in (rules.decision, rules.escape, rules.case, rules.boolean, rules.routine))
        # (bit of the start, bit of the end or 0, number of the block) and the patterns of the bits
        self.detectors, self.starts, self.ends, k = [], [], [], 0
        for number, block in enumerate(rules.detectors, 1):
            for start, end in block:
                self.detectors.append((1 << k, 0 if end is None else 1 << (k + 1), number))
                self.starts.append((1 << k, p(start)))
                if end is not None:
                    self.ends.append((1 << (k + 1), p(end)))
                k += 2
        self.any_start = M.either(tuple(s for block in rules.detectors for s, _ in block))

    def edges(self, lines: pa.Array, beyond: np.ndarray) -> np.ndarray | None:
        """Which starts and ends each line matches; None if there is no start."""
        some = np.flatnonzero(self.any_start.mask(lines, beyond)) if self.any_start else np.arange(len(lines))
        if not len(some):
            return None
        out, own, far = np.zeros(len(lines), np.int64), lines.take(pa.array(some)), beyond[some]
        for bit, p in self.starts:
            out[some[p.mask(own, far)]] |= bit
        if not out.any():
            return None
        for bit, p in self.ends:
            out[p.mask(lines, beyond)] |= bit
        return out

    def without_strings(self, lines: pa.Array, beyond: np.ndarray) -> pa.Array:
        if self.string is None:
            out = pc.replace_substring_regex(lines, _STRINGS, "")
        else:
            hit = self.string.mask(lines, beyond)
            out = lines
            if hit.any():
                out = pc.replace_with_mask(lines, pa.array(hit), pa.array([self.string.compiled.sub("", x) for x in lines.filter(pa.array(hit)).to_pylist()], lines.type))
        return pc.utf8_trim_whitespace(out)

    def without_inline(self, lines: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(lines cut at their first inline comment mark unless they start with '#', which lines hold a mark)."""
        marked = np.zeros(len(lines), bool)
        for mark in self.rules.inline:
            marked |= np.array(pc.match_substring(lines, mark))
        if not marked.any():
            return lines, marked
        cut = []
        for line in lines.filter(pa.array(marked)).to_pylist():
            for mark in self.rules.inline:
                if line[:1] != "#":
                    line = line.split(mark, 1)[0]
            cut.append(line)
        return pc.replace_with_mask(lines, pa.array(marked), pa.array(cut, lines.type)), marked

    def scan(self, texts: pa.Array, library: pa.Array | None = None) -> Scanned:
        return Scanned(self, texts, library)


@functools.lru_cache(256)
def scanner(rules: Rules) -> Scanner:
    return Scanner(rules)


class Scanned:
    """The lines of some files, classified.

    Per file: ``offsets`` into the lines and ``raw_counts`` (lines before a separator splits them). Per line: ``number`` (of its
    raw line), ``ids`` (its place in ``lines``), ``flags`` (comment marks, blanks) and ``codes`` (block and state). ``lines`` are the
    different lines as cut, ``bare`` the same without strings.
    """

    def __init__(self, own: Scanner, texts: pa.Array, library: pa.Array | None) -> None:
        rules = own.rules
        self.own, self.rules, self.texts = own, rules, normal_ends(texts)
        raw, self.raw_counts = split_lines(self.texts)
        counts, number = self.raw_counts, numbers_of(offsets_of(self.raw_counts))
        far = M.beyond_ascii(raw) if own.ignore or rules.hooks else None
        ignored = own.ignore.mask(raw, far) if own.ignore else np.zeros(len(raw), bool)
        skipped = np.zeros(len(raw), bool)
        if rules.hooks and rules.hooks.skip:
            skipped |= np.asarray(rules.hooks.skip(raw), bool)
        if rules.module == "customPowerBuilder":
            from lineweave.operators import powerbuilder

            self.binary, self.generated = powerbuilder.left_out(raw, np.repeat(np.array(library) if library is not None else np.zeros(len(texts), bool), counts))
            skipped |= self.binary | self.generated
            self.raw_offsets = offsets_of(counts)
        if rules.separator:
            parts = pc.split_pattern(raw, rules.separator)
            sizes = np.array(pc.list_value_length(parts), np.int64)
            kept = ignored | skipped
            first = np.zeros(int(sizes.sum()), bool)
            first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
            keep = first | ~np.repeat(kept, sizes)
            raw = parts.flatten().filter(pa.array(keep))
            sizes = np.where(kept, 1, sizes)
            number, ignored, skipped = (np.repeat(x, sizes) for x in (number, ignored, skipped))
            whole = np.concatenate([[0], np.cumsum(sizes)])
            counts = np.diff(whole[offsets_of(self.raw_counts)])
        self.skipped, self.number, self.offsets = skipped, number, offsets_of(counts)
        cut = without_nul(pc.utf8_slice_codeunits(raw, 0, rules.width))
        if rules.hooks and rules.hooks.preprocess:
            cut = rules.hooks.preprocess(cut)
        self.lines, self.ids = distinct(cut)
        self.beyond = M.beyond_ascii(self.lines)
        self.bare = own.without_strings(self.lines, self.beyond)
        marks = self._marks()
        edges = own.edges(self.lines, self.beyond) if own.detectors else None
        self.flags = np.where(ignored | skipped, IGNORED, marks[self.ids])
        self.codes = line_codes(self.flags, None if edges is None else edges[self.ids], self.offsets, own.detectors, sum(d[0] for d in own.detectors), rules.same_line_is_comment, rules.measure_block)
        measured = (self.codes & MEASURED) != 0
        self.is_comment, self.is_code = measured & ((self.codes & COMMENT) != 0), measured & ((self.codes & COMMENT) == 0)

    def _marks(self) -> np.ndarray:
        """Flags that decide on blanks and comments, of the different lines."""
        own, lines, beyond, rules = self.own, self.lines, self.beyond, self.rules
        plain = pc.utf8_trim_whitespace(lines)
        empty = np.array(pc.binary_length(plain), np.int64) == 0
        state = plain if rules.python else self.bare
        blank = np.zeros(len(lines), bool)
        for p in own.blank:
            blank |= p.mask(lines, beyond)
        if rules.hooks and rules.hooks.blank:
            blank |= np.asarray(rules.hooks.blank(lines), bool)
        opens = own.open.mask(state, beyond)
        out = np.where(blank, BLANK, 0) | np.where(own.single.mask(state, beyond), SINGLE, 0) | np.where(opens, OPEN, 0) | np.where(own.close.mask(state, beyond), CLOSE, 0)
        at = np.flatnonzero(opens)
        for i, text in zip(at.tolist(), state.take(pa.array(at)).to_pylist(), strict=True):
            rest = text[own.open.compiled.search(text).end() :]
            if closed := own.close.compiled.search(rest):
                out[i] |= CLOSED_AGAIN
                if not rules.same_line_is_comment and (not own.open.compiled.match(text) or rest[closed.end() :].strip()):
                    out[i] |= CODE_AROUND
        return np.where(empty, TRUE_BLANK, out)

    def some(self, lines: np.ndarray) -> np.ndarray:
        """The different lines among those that ``lines`` marks, as places in ``self.lines``."""
        used = np.zeros(len(self.lines), bool)
        used[self.ids[lines]] = True
        return np.flatnonzero(used)

    def marks(self, lines: np.ndarray, kinds: dict[int, Callable]) -> np.ndarray:
        """Flags of all lines: for each bit the kind's mask over the different ones among those marked; 0 for all others."""
        at, out = self.some(lines), np.zeros(len(self.lines), np.int64)
        for bit, mask in kinds.items():
            out[at[mask(at)]] |= bit
        return np.where(lines, out[self.ids], 0)

    @functools.cached_property
    def code(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(places of the different code lines, their code without strings and inline comments, which held a comment)."""
        at = self.some(self.is_code)
        return at, *self.own.without_inline(self.bare.take(pa.array(at)))

    def code_marks(self, routines: bool = False) -> np.ndarray:
        """Flags of code lines."""
        own, rules = self.own, self.rules
        at, code, inline = self.code
        far = self.beyond[at]
        decisive = self.lines.take(pa.array(at)) if rules.strings else code
        kinds = {INLINE: lambda _: inline, DECISION: lambda _: own.decision.mask(decisive, far)} | {bit: (lambda _, p=p: p.mask(code, far)) for bit, p in own.code.items()}
        if routines:
            whole = self.lines.take(pa.array(at))
            start = (lambda _: own.searches.index(whole, far) >= 0) if own.searches else (lambda _: own.routine.mask(whole, far))
            kinds |= {START: start, ESCAPE: lambda _: own.escape.mask(decisive, far), CASE: lambda _: own.case.mask(decisive, far), BOOLEAN: lambda _: own.boolean.mask(decisive, far)}
        else:
            kinds[ROUTINE] = lambda _: own.routine.mask(code, far)
        return self.marks(self.is_code, kinds)

    def comment_marks(self, templates: bool = True) -> np.ndarray:
        """Flags of comment lines: template, dead code."""
        own = self.own
        of = lambda at: (self.lines.take(pa.array(at)), self.beyond[at])
        kinds = {}
        if own.dead:
            kinds[DEAD] = lambda at: own.dead.mask(*of(at))
        if own.searches and templates:
            kinds[TEMPLATE] = lambda at: own.searches.index(*of(at)) >= 0
        return self.marks(self.is_comment, kinds)

    def sums(self, lines: np.ndarray) -> np.ndarray:
        """How many lines of each file are marked."""
        total = np.concatenate([[0], np.cumsum(lines)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


# -- the automata --------------------------------------------------------------------------------------------------


def line_codes(f: np.ndarray, e: np.ndarray | None, offsets: np.ndarray, detectors: list, starts: int, keep_same_line: bool, measure_block: int) -> np.ndarray:
    """Codes of all lines of a batch of files."""
    n = len(f)
    live = (f & (TRUE_BLANK | IGNORED)) == 0
    block, change = np.zeros(n, np.int64), np.zeros(n, bool)
    first = np.zeros(n, bool)
    begin = offsets[:-1][np.diff(offsets) > 0]
    first[begin] = True
    if e is not None and n:
        touched = np.flatnonzero(live & ((e & starts) != 0))
        for file in np.unique(np.searchsorted(offsets, touched, "right") - 1):
            _blocks(e, live, offsets[file], offsets[file + 1], detectors, block, change)
    # comments: an automaton over live lines that starts anew with each file and each block change
    at = np.flatnonzero(live)
    g = f[at]
    single, opens, again, close = ((g & b) != 0 for b in (SINGLE, OPEN, CLOSED_AGAIN, CLOSE))
    sets_ = ~single & opens & ~again
    runs = np.cumsum(first)[at] * (n + 1) + np.cumsum(change)[at]
    new_run = np.concatenate([[True], runs[1:] != runs[:-1]]) if len(at) else np.empty(0, bool)
    index = np.arange(len(at))
    run_start = np.maximum.accumulate(np.where(new_run, index, 0)) if len(at) else index
    decided = sets_ != close  # set or reset; both: toggle; none: keep
    toggles = np.cumsum(sets_ & close)
    last = np.maximum.accumulate(np.where(decided, index, -1)) if len(at) else index
    before = np.concatenate([[-1], last[:-1]]) if len(at) else last
    valid = before >= run_start
    base = np.where(valid, sets_[np.maximum(before, 0)], False)
    toggles_before = np.concatenate([[0], toggles[:-1]]) if len(at) else toggles
    at_base = np.where(valid, toggles[np.maximum(before, 0)], np.where(run_start > 0, toggles[np.maximum(run_start - 1, 0)], 0))
    inside = base ^ (((toggles_before - at_base) & 1) != 0)
    comment = inside | single | opens
    if not keep_same_line:
        comment &= ~(~inside & ~single & opens & again & ((g & CODE_AROUND) != 0))
    codes = block | np.where(change, CHANGE, 0)
    codes[at] |= LIVE | np.where(comment, COMMENT, 0)
    codes[at] |= np.where(((g & BLANK) == 0) & (block[at] == measure_block), MEASURED, 0)
    return codes


def _blocks(e: np.ndarray, live: np.ndarray, low: int, high: int, detectors: list, block: np.ndarray, change: np.ndarray) -> None:
    """Block of each line of one file. Only lines with an edge are visited, and the line after a block of one line."""
    active, end, single, since = 0, 0, False, low
    places = np.flatnonzero(live[low:high] & (e[low:high] != 0)) + low
    queue, k = places.tolist(), 0
    following = None  # the live line after a block of one line
    while k < len(queue) or following is not None:
        if following is not None and (k >= len(queue) or following <= queue[k]):
            i = following
            if k < len(queue) and queue[k] == i:
                k += 1
        else:
            i, k = queue[k], k + 1
        following, old, bits = None, active, int(e[i])
        compare = old
        if active and single:
            block[since:i] = active
            active, single, end, since, compare = 0, False, 0, i, 0
        elif active:
            if bits & end:
                block[since:i] = active
                active, end, since = 0, 0, i
                change[i] = True
            continue
        for start, stop, number in detectors:
            if bits & start:
                block[since:i] = 0
                active, end, since = number, stop, i
                single = bool(stop and bits & stop)
                if single:
                    later = np.flatnonzero(live[i + 1 : high])
                    following = int(later[0]) + i + 1 if len(later) else None
                break
        if active != compare:
            change[i] = True
    block[since:high] = active
