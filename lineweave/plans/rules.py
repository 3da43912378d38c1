"""Rule sets: what a line of a language looks like, as Python regular expressions, and the options that change them."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from lineweave.functions.match import Searches, searches

HUMAN, MACHINE, CONTENT = 0, 1, 2

# The patterns of the measured language.
_I = "(?i)"
TRUE_BLANK = _I + r"^\s*$"
BLANK = _I + r"^[\s\\+.,;=\-/*'`\"#!%{}()\[\]<>|]*$"
BLANK_XML = _I + r"^\s*<[\w/\\]*?>\s*$"
SINGLE = _I + r"(?://|#(?!\||def|inc|if|else|region)|;|--(?!\[)|'(?![^']+?')|rem|!|%)"
OPEN = _I + r"(?:/\*|--\[\[|=(?:begin|head)|#\||\{-|<!--|<%--)"
CLOSE = _I + r"(?:\*/|\]\]|=(?:cut|end)|\|#|-\}|-->|--%>)"
QUOTES = "\"\"\"|'''"
STRING = r"\"(?!\").+?\"|'(?!').+?'"
MACHINE_DETECTORS = (
    (_I + r"region\b.*?\bgenerated", _I + r"end\s*region"),
    (_I + r"\bdo\s+not\s+(?:edit|modify)\b", None),
    (_I + r"generated\b[^.]*?\b(?:by|with|date|time|code|file|class|script|source)\b.*$", None),
    (_I + r"\bcreated\b.*?\b(?:tool|auto|code|script)\b.*$", None),
)
SCRIPT_DETECTORS = ((_I + r"[<{]%", _I + r"%[>}]"), (_I + "<script", _I + "</script>"), (_I + r"<\?php", _I + r"\?>"), (_I + "<[fm]x:script", _I + "</[fm]x:script>"))
DECISION = _I + r"\b(?:if|elseif|elif|else|for|foreach|while|until|when|from|where|join|find)\b"
CASE = _I + r"\bcase\b"
ESCAPE = _I + r"\b(?:return|continue|break|goto|except|catch|finally)\b"
BOOLEAN = _I + r"(?:\s+and\s+|\s+or\s+|\|\||&&)"
DEAD = _I + r"[;{}\[\](]+\s*$|[A-Za-z]\.[A-Za-z]|[=&+\[\]|]+"
PREPROCESSOR = _I + r"^\s*#(?:def|if|else|end)"
IMPORT = _I + r"\b(?:using|import|#*include)\b"
CLASS = _I + r"\b(?:class|type|interface)\b"
ROUTINE = _I + r"\b(def|public|private|protected|static|void|sub|func|function|prop|property|proc|procedure)\s*[( \[{]+"
NO_ROUTINE = "(lines of a file without routine)"
INLINE = ("//", "/*")
DELPHI_BLANK = _I + r"^\s*(?:\bbegin\b|\bend;)?\s*$"
DELPHI_SINGLE = _I + r"\s*//"
DELPHI_OPEN = _I + r"\(\*|\{(?![/$])"
DELPHI_CLOSE = _I + r"\*\)|\}"
DELPHI_DEAD = _I + r"[;\[\]]+\s*$|[A-Za-z]\.[A-Za-z]|[=&+\[\]|]+"
COBOL_BLANK = BLANK
POWERBUILDER_BLANK = _I + r"^\s*(?:end\s+type|end\s+event|end\s+on|//|[ *'#;!%{}()\[\]<>|]?)\s*$"


@dataclass(frozen=True)
class Hooks:
    """Code of one's own for a rule set; each hook is called with Arrow arrays of a batch of lines, never with single lines.

    ``preprocess`` changes the lines (as cut) before anything looks at them; ``skip`` tells which raw lines are left out of everything
    but the raw count; ``blank`` which lines count as blank besides those of the pattern; ``measures`` gives further counts per file
    (name -> numbers) from the scanned lines, and ``items`` further rows (file, number, name, text) for the verb analyze.
    """

    preprocess: Callable | None = None
    skip: Callable | None = None
    blank: Callable | None = None
    measures: Callable | None = None
    items: Callable | None = None


@dataclass(frozen=True)
class Rules:
    """One immutable set of rules."""

    module: str = "Code"
    blank: str = BLANK
    blank_add: str | None = None
    blank_xml: bool = False
    single: str = SINGLE
    open: str = OPEN
    close: str = CLOSE
    string: str = STRING
    python: bool = False
    same_line_is_comment: bool = True
    separator: str | None = None
    ignore_line: str | None = None
    width: int = 255
    detectors: tuple = (MACHINE_DETECTORS, ())
    measure_block: int = HUMAN
    content_block: int = CONTENT
    dead: str | None = DEAD
    inline: tuple = INLINE
    inline_is_comment: bool = True
    decision: str = DECISION
    case: str = CASE
    escape: str = ESCAPE
    boolean: str = BOOLEAN
    preprocessor: str = PREPROCESSOR
    imports: str = IMPORT
    classes: str = CLASS
    routine: str = ROUTINE
    no_routine: str = NO_ROUTINE
    strings: bool = False
    comments: bool = False
    only_comments: bool = False
    nesting_indent: int = 4
    nesting_bias: int = 2
    with_booleans: bool = False
    with_escapes: bool = True
    with_cases: bool = True
    file_lines: bool = False
    empties: bool = False
    case_sensitive: bool = False
    search_case_sensitive: bool = False
    params: tuple = ()
    base: dict = field(default_factory=dict, hash=False, compare=False)

    hooks: Hooks | None = None

    @property
    def searches(self) -> Searches | None:
        return searches(tuple(tuple(p) for p in self.params), self.search_case_sensitive) if self.params else None


CODE = Rules()
NBNC = Rules(module="NBNC", detectors=((), ()), dead=None)
WEB = Rules(module="Web", detectors=(MACHINE_DETECTORS, SCRIPT_DETECTORS), measure_block=2, content_block=0, file_lines=True)  # what is outside scripts is content
DELPHI = Rules(module="customDelphi", blank=DELPHI_BLANK, single=DELPHI_SINGLE, open=DELPHI_OPEN, close=DELPHI_CLOSE, dead=DELPHI_DEAD)
COBOL = Rules(module="customCobol", blank=COBOL_BLANK)
POWERBUILDER = Rules(module="customPowerBuilder", blank=POWERBUILDER_BLANK)
PROLOG = Rules(module="customProlog")  # its own comment rules were never in force
MODULES: dict[str, Rules] = {r.module: r for r in (CODE, NBNC, WEB, DELPHI, COBOL, PROLOG, POWERBUILDER)} | {m: replace(CODE, module=m) for m in ("DupeLines", "Depends")} | {"Search": replace(NBNC, module="Search"), "Document": replace(NBNC, module="Document")}


def register(rules: Rules) -> Rules:
    """Make a rule set of one's own known under its module's name, for entries of a config to use."""
    MODULES[rules.module] = rules
    return rules


BASE_OPTIONS = ("MEASURE_FILTER", "METADATA", "METADATA_ALL", "METADATA_DEBUG", "METADATA_ONLY", "IGNORE_NONCODE", "IGNORE_SIZE", "IGNORE_BINARY", "IGNORE_PATH", "DELTA_INCL_DELETED")


class OptionError(ValueError):
    """An option that no rule set knows, or a value it cannot take."""


def spelt(source: str, verbose: bool = True, ignore_case: bool = True) -> str:
    """A pattern with its flags written in front."""
    flags = ("i" if ignore_case else "") + ("x" if verbose else "")
    return (f"(?{flags})" if flags else "") + source


def _checked(source: str) -> str:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", FutureWarning)
        re.compile(source)
    return source


def parse_detectors(value: str) -> tuple:
    """[[re.compile(r'start',re.I), re.compile(r'end') or None], ...] as data; nothing is evaluated."""

    def regex(node: ast.expr) -> str | None:
        if isinstance(node, ast.Constant) and node.value is None:
            return None
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            return _checked(node.value)
        if isinstance(node, ast.Call) and ast.unparse(node.func) == "re.compile" and node.args and isinstance(node.args[0], ast.Constant):
            flags = ast.unparse(node.args[1]) if len(node.args) > 1 else ""
            if flags and not re.fullmatch(r"re\.[A-Z]+(?:\s*\|\s*re\.[A-Z]+)*", flags):
                raise OptionError(f"flags {flags}")
            return _checked(spelt(node.args[0].value, bool(re.search(r"re\.(?:X|VERBOSE)\b", flags)), bool(re.search(r"re\.I(?:GNORECASE)?\b", flags))))
        raise OptionError(f"no regular expression: {ast.unparse(node)}")

    try:
        tree = ast.parse(value.strip(), mode="eval").body
    except SyntaxError as e:
        raise OptionError(f"detectors {value!r}") from e
    rows = tree.elts if isinstance(tree, (ast.List, ast.Tuple)) else None
    if rows is None:
        raise OptionError(f"detectors {value!r}")
    if rows and not isinstance(rows[0], (ast.List, ast.Tuple)):
        rows = [tree]
    return tuple((regex(r.elts[0]), regex(r.elts[1])) for r in rows)


def with_option(rules: Rules, name: str, value: str | None) -> Rules:
    """The rules with one option applied. Unknown options raise ``OptionError``."""
    v = value if value is not None else ""
    ignore = not rules.case_sensitive
    spell = lambda: _checked(spelt(v, True, ignore))
    machine, content = rules.detectors
    changes = {
        "MEASURE_EMPTIES": lambda: {"empties": True},
        "CASE_SENSITIVE": lambda: {"case_sensitive": True},
        "SEARCH_CASE_SENSITIVE": lambda: {"search_case_sensitive": True},
        "ADD_LINE_SEP": lambda: {"separator": v},
        "BLANK_LINE": lambda: {"blank": spell()},
        "BLANK_LINE_ADD": lambda: {"blank_add": spell()},
        "BLANK_LINE_XML": lambda: {"blank_xml": True},
        "COMMENT_LINE": lambda: {"single": spell()},
        "COMMENT_OPEN": lambda: {"open": spell()},
        "COMMENT_CLOSE": lambda: {"close": spell()},
        "COMMENT_CLOSE_CODE": lambda: {"same_line_is_comment": False},
        "IGNORE_LINE": lambda: {"ignore_line": spell()},
        "MAX_LINE_LENGTH": lambda: {"width": int(v)},
        "PYTHON": lambda: {"python": True, "single": "#", "open": QUOTES, "close": QUOTES},
        "RUBY": lambda: {"single": "#", "open": "=begin", "close": "=end"},
        "STRINGS": lambda: {"string": spell()},
        "MACHINE_NONE": lambda: {"detectors": ((), content)},
        "MACHINE_ALL": lambda: {"detectors": (((_I + ".*", None),), content)},
        "MACHINE_MEASURE": lambda: {"measure_block": MACHINE},
        "MACHINE_ADD_DETECT": lambda: {"detectors": ((*machine, *parse_detectors(v)), content)},
        "MACHINE_DETECTORS": lambda: {"detectors": (parse_detectors(v), content)},
        "CONTENT_ADD_DETECTOR": lambda: {"detectors": (machine, (*content, *parse_detectors(v)))},
        "CONTENT_DETECTORS": lambda: {"detectors": (machine, parse_detectors(v))},
        "SCRIPT_ADD_DETECTOR": lambda: {"detectors": (machine, (*content, *parse_detectors(v)))},
        "SCRIPT_DETECTORS": lambda: {"detectors": (machine, parse_detectors(v))},
        "BOOLEANS": lambda: {"boolean": spell()},
        "INCLUDE_STRINGS": lambda: {"strings": True},
        "INCLUDE_COMMENTS": lambda: {"comments": True},
        "ONLY_COMMENTS": lambda: {"only_comments": True},
        "INLINE_EXCLUDE": lambda: {"inline_is_comment": False},
        "INLINE_INCL_QUOTE": lambda: {"inline": (*rules.inline, "'")},
        "INLINE": lambda: {"inline": (v,)},
        "NESTING_INDENT": lambda: {"nesting_indent": int(v)},
        "NESTING_BIAS": lambda: {"nesting_bias": int(v)},
        "COMP_INCL_BOOLEAN": lambda: {"with_booleans": True},
        "COMP_EXCL_ESCAPES": lambda: {"with_escapes": False},
        "COMP_EXCL_CASES": lambda: {"with_cases": False},
        "DECISIONS": lambda: {"decision": spell()},
        "DEADCODE_NONE": lambda: {"dead": None},
        "DEADCODE": lambda: {"dead": spell()},
        "IMPORTS": lambda: {"imports": spell()},
        "PREPROCESSOR": lambda: {"preprocessor": spell()},
        "ROUTINES": lambda: {"routine": spell()},
        "ROUTINE_FILE_LINES": lambda: {"file_lines": True},
        "CLASSES": lambda: {"classes": spell()},
        "ESCAPES": lambda: {"escape": spell()},
        "CASES": lambda: {"case": spell()},
        "PB_OUTFILES": lambda: {"base": rules.base | {"PB_OUTFILES": v}},
    }
    if name in changes:
        try:
            return replace(rules, **changes[name]())
        except (re.error, ValueError) as e:
            raise OptionError(f"{name}: {e}") from e
    if name in BASE_OPTIONS:
        return replace(rules, base=rules.base | {name: value})
    raise OptionError(f"unknown option {name}")


def rules_for(module: str, options: list[tuple[str, str | None]] = (), params: list[tuple[bool, str, str]] = ()) -> Rules:
    """The rules of a module with options applied in order."""
    if module not in MODULES:
        raise OptionError(f"unknown module {module}")
    rules = replace(MODULES[module], params=tuple(tuple(p) for p in params))
    for name, value in options:
        rules = with_option(rules, name, value)
    return rules
