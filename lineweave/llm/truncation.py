"""Texts cut off by field limits or in transfer.

Evidence is gathered from the whole corpus and then held against the end of every text:

* A vocabulary trie, kept as a table of its nodes: in how many texts known words go on from there. A final token that is no known
  word but a proper prefix of known words was cut in mid-word.
* Context counts: how often the last five (three) typed words before a place are followed by the end of a line and how
  often by another word. Typed: frequent words stand for themselves, others become a class (name, identifier, number ...).
  An end where the corpus nearly always goes on was cut in mid-sentence or in mid-code.
* Lengths: for each source, lengths (in characters and bytes) at which far more texts end than at the neighbouring
  lengths are limits of the field.
* Formulas: last lines that end a share of all different texts. Copies of one text count once, so a cut text that is
  delivered many times stays cut.
* Marks and structure: an ellipsis mark, a code fence or tag that is never closed, a line of many documents.

All statistics are tables; only the frequent words (at most 1/share times the words of an average text) are broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.operators.joins import left_by_key
from lineweave.session import checkpointed

SHARE = 0.18  # of a language's texts: a word that occurs in so many is frequent
FORMULA = 0.001  # of all different texts: a last line that ends so many is a habit of ending, as long as LEAST_FORMULA do
LEAST_FORMULA = 4
LONGEST_KEY = 200
TRIE_DEPTH = 40  # words beyond it hang together from their first so many characters
WIDTHS = (3, 5)
FLUSH = 400_000
BLOCKS = (256, 500, 512, 1000, 1024, 2000, 2048, 4000, 4096, 8192)

_WORDS = re.compile(r"https?://[^\s<>\"')\]]+|\w+")
_MARK = re.compile(r"(?:\[(?:\.\.\.|…|more|truncated|cut|snip)\]|\((?:more|truncated|continued|cont\.?|\.\.\.|…)\)|(?:read|see) more\W{0,3}|<(?:snip|cut|truncated)>)\s*$", re.I)
_DOTS = re.compile(r"(?:\.\.\.|…)\s*$")
_CLOSED = re.compile(r"(?:[.?!。！？](?:[\"'”’»)\]*_]|</\w+>)*|^\([^()\n]*\)|```|~~~|</\w+>)\Z")
_FENCE = re.compile(r"^[ \t>]*(```|~~~)", re.M)
_URL_END = re.compile(r"https?://\S*$")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])|[\d_]+")
_IDENT = re.compile(r"[\d_]|[a-z][A-Z]")


def _class(word: str, frequent: frozenset[str]) -> str:
    low = word.lower()
    if low in frequent:
        return low
    if word.startswith("http"):
        return "U"
    if not (word[0].isalnum() or word[0] == "_"):
        return word
    if word.isdigit():
        return "0"
    if _IDENT.search(word):
        return "I"
    return "N" if word[0].isupper() else "w"


_BREAKS = "\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
_PARTS = re.compile(rf"https?://[^\s<>\"')\]]+|\w+|[^\w\s]|[{_BREAKS}]|(?<=[.?!])\s(?=\s*\S)")


def segments(text: str) -> Iterator[list[str]]:
    """The token lists of a text's lines, prose lines by sentence."""
    own: list[str] = []
    for token in _PARTS.findall(text):
        if token.isspace():
            if own:
                yield own
                own = []
        else:
            own.append(token)
    if own:
        yield own


def subwords(token: str) -> list[str]:
    """The words of a token in lower case: those an identifier is put together from, or the word itself."""
    return [w.lower() for w in _HUMP.split(token) if w]


def _key(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class _Remembered(dict):
    """A function of tokens with its answers kept, up to a bound."""

    def __init__(self, function, most: int = 300_000) -> None:
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, token: str):
        if len(self) > self.most:
            self.clear()
        answer = self[token] = self.function(token)
        return answer


def _language(lang: str | None) -> str:
    return (lang or "und").strip().lower()[:2] or "un"


def _words_of(token: str) -> tuple[str, ...]:
    return tuple(subwords(token)) if (token[0].isalpha() or token[0] == "_") and not token.startswith("http") else ()


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, texts): in how many texts of a split a word occurs before the final token; word '' counts the texts."""
    counts: dict[str, Counter] = {}
    words = _Remembered(_words_of)

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([k for k, c in counts.items() for _ in c], pa.string()), pa.array([w for c in counts.values() for w in c], pa.string()), pa.array([n for c in counts.values() for n in c.values()], pa.int64())], names=["lang", "word", "texts"])
        counts.clear()
        return batch

    for batch in batches:
        for text, lang in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            tokens = _WORDS.findall(text)
            if tokens and (text.rstrip()[-1].isalnum() or text.rstrip()[-1] == "_"):
                tokens.pop()  # the final token, which may be cut
            own = set(chain.from_iterable(map(words.__getitem__, set(tokens))))
            own.add("")
            counts.setdefault(_language(lang), Counter()).update(own)
        if sum(map(len, counts.values())) > FLUSH:
            yield out()
    yield out()


# -- contexts ------------------------------------------------------------------------------------------------------

_BREAK, _START = np.uint64(0), np.uint64(0x5BD1E995)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _coder(frequent: frozenset[str]) -> _Remembered:
    """Codes of tokens: a hash of a token's class, 0 for white space, which ends a segment."""
    of_class = _Remembered(lambda name: (_key(name) & 0x7FFFFFFFFFFFFFFF) | 1)
    return _Remembered(lambda t: 0 if t.isspace() else of_class[_class(t, frequent)])


def _hashes(codes: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """A hash of the last ``width`` codes at each place of a segment (of fewer at its start)."""
    h = np.full(len(codes), np.uint64(width), np.uint64)
    for back in range(width):
        earlier = np.concatenate([np.zeros(back, np.uint64), codes[: len(codes) - back]]) if back else codes
        h = np.where(places >= back, (h ^ earlier) * _MIX, h)
        h ^= h >> np.uint64(31)
    return h.astype(np.int64)


def _flat(codes: list[int], sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of texts laid out, ``codes`` having a break before each of the texts, which have ``sizes`` codes with it: (codes, place in the segment,
    whether it ends there, number of the text)."""
    codes, text = np.array(codes, np.uint64), np.repeat(np.arange(len(sizes)), sizes)
    gap = codes == _BREAK
    keep = ~gap | np.concatenate([~gap[1:], [False]]) if len(gap) else gap  # a break before a token starts its segment
    codes, text, gap = codes[keep], text[keep], gap[keep]
    index = np.arange(len(codes))
    start = np.maximum.accumulate(np.where(gap, index, 0)) if len(codes) else index
    ends = np.concatenate([gap[1:], [True]]) if len(codes) else gap
    return np.where(gap, _START, codes), index - start, ends, text


def _contexts(frequent: dict[str, frozenset[str]]):
    """(ctx, ends, goes_on) over all places but the end of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _Remembered(lambda lang: _coder(frequent.get(lang, frozenset())))
        for batch in batches:
            coded, sizes = [], []
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                before = len(coded)
                coded.append(0)
                coded += map(coders[_language(lang)].__getitem__, _PARTS.findall(text))
                sizes.append(len(coded) - before)
            codes, places, ends, text = _flat(coded, sizes)
            last = np.concatenate([text[1:] != text[:-1], [True]]) if len(text) else np.empty(0, bool)
            use = np.flatnonzero((places > 0) & ~last)  # how the text itself ends is not evidence
            keys = np.concatenate([_hashes(codes, places, k)[use] for k in WIDTHS])
            at_end = np.tile(ends[use], len(WIDTHS))
            coded_keys = pa.array(keys).dictionary_encode()
            found, where = coded_keys.dictionary, np.array(coded_keys.indices, np.int64)
            stops = np.bincount(where, weights=at_end, minlength=len(found)).astype(np.int64)
            both = np.bincount(where, minlength=len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([found, pa.array(stops, pa.int64()), pa.array(both - stops, pa.int64())], names=["ctx", "ends", "goes_on"])

    return run


_FINAL = "id long, source string, copy long, chars long, bytes long, stated long, token string, line string, mark boolean, dots boolean, open boolean, closed boolean, url boolean, unbalanced boolean, ctx3 long, ctx5 long"


def _finals(frequent: dict[str, frozenset[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _Remembered(lambda lang: _coder(frequent.get(lang, frozenset())))
        schema = pa.schema([("id", pa.int64()), ("source", pa.string()), ("copy", pa.int64()), *((n, pa.int64()) for n in ("chars", "bytes", "stated")), ("token", pa.string()), ("line", pa.string()), *((n, pa.bool_()) for n in ("mark", "dots", "open", "closed", "url", "unbalanced")), ("ctx3", pa.int64()), ("ctx5", pa.int64())])
        for batch in batches:
            rows, coded, sizes = [], [], []
            for key, text, source, lang, stated in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                *shown, last = _end(text)
                rows.append((key, source, _key(text.strip()), len(text), len(text.encode("utf-8", "surrogatepass")), stated, *shown))
                coded.append(0)
                coded += map(coders[_language(lang)].__getitem__, last)
                sizes.append(1 + len(last))
            codes, places, _, number = _flat(coded, sizes)
            final = np.flatnonzero(np.concatenate([number[1:] != number[:-1], [True]])) if len(number) else np.empty(0, np.int64)
            contexts = []
            for k in WIDTHS:
                of = np.full(len(rows), _key(str(k)), np.int64)  # a text that ends in nothing but marks
                of[number[final]] = _hashes(codes, places, k)[final]
                contexts.append(pa.array(of, pa.int64()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * (len(schema) - len(WIDTHS))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)), *contexts], schema=schema)

    return run


def line_key(line: str) -> str:
    """A line, numbers aside; a long one as its end, where a cut shows, and a hash of all of it."""
    shape = re.sub(r"\d+", "0", line)
    return shape if len(shape) <= LONGEST_KEY else f"{_key(shape):x} {shape[-LONGEST_KEY:]}"


def _end(text: str) -> tuple:
    """What the end of a text shows: (token, line, mark, dots, open, closed, url, unbalanced, tokens of its last segment)."""
    own = text.rstrip()
    # marks and dots stand at the very end and are short, so they are looked for there
    mark, dots = (_MARK.search(own, max(0, len(own) - 100)), None)
    if mark:
        own = own[: mark.start()].rstrip()
    if dots := _DOTS.search(own, max(0, len(own) - 3)):
        own = own[: dots.start()].rstrip()
    last_line = own.rfind("\n") + 1
    line = own[last_line:].strip()
    fences = len(_FENCE.findall(own))
    opened, ended = own.count("<pre"), own.count("</pre>")
    is_open = fences % 2 == 1 or opened > ended
    last: list[str] = []
    for last in segments(line):  # noqa: B007
        pass
    parts = subwords(last[-1]) if last and last[-1][0].isalpha() and not last[-1].startswith("http") else []
    token = parts[-1] if parts else None
    opens = sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}")
    unbalanced = line.count('"') % 2 == 1 or (opens > 0 and not line.endswith(("{", "(", "[", ":", ","))) or bool(re.search(r"[\w)\]]\s*(?:=|==|\+|,|&&|\|\||<|->|=>|\.)$", line))
    return token, line_key(line), bool(mark), bool(dots), is_open, bool(_CLOSED.search(own, last_line) or _CLOSED.search(line)), bool(_URL_END.search(line)), unbalanced, last


def ends(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", stated: str = "n_chars", share: float = SHARE) -> DataFrame:
    """One row per non-empty text with all evidence on its end and the verdict ``cut``."""
    spark = documents.sparkSession
    rows = documents.where(F.col(key).isNotNull() & F.col(text).rlike(r"\S")).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(stated).cast("long").alias("stated"))
    words = checkpointed(rows.mapInArrow(_vocabulary, "lang string, word string, texts long").groupBy("lang", "word").agg(F.sum("texts").alias("texts")))
    total = words.where("word = ''").select("lang", F.col("texts").alias("all"))
    often = words.where("word <> ''").join(F.broadcast(total), "lang").where((F.col("texts") >= share * F.col("all")) & (F.col("all") >= 20))
    frequent: dict[str, set[str]] = {}
    for r in often.select("lang", "word").collect():  # bounded: at most 1/share times the mean number of words of a text, per language
        frequent.setdefault(r.lang, set()).add(r.word)
    lists = {k: frozenset(v) for k, v in frequent.items()}

    finals = rows.mapInArrow(_finals(lists), _FINAL)
    counts = rows.mapInArrow(_contexts(lists), "ctx long, ends long, goes_on long").groupBy("ctx").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))
    f = checkpointed(finals)
    limits = field_limits(f)
    # how texts end that show no other trace of a cut: formulas of an end are seen here, as the places above leave ends out
    by_chars = limits.where("unit = 'chars'").select(F.col("source").alias("s"), "size")
    sound = f.where(~F.col("mark") & ~F.col("open") & ~F.col("dots")).join(by_chars, (F.col("chars") == F.col("size")) & F.col("source").eqNullSafe(F.col("s")), "left_anti").groupBy("ctx5", "copy").agg(F.first("id")).groupBy("ctx5").agg(F.count("*").alias("final5"))
    # copies of one text are one text: many of them do not make its end a formula
    lines = f.groupBy("line", "copy").agg(F.count("*").alias("n")).groupBy("line").agg(F.count("*").alias("line_texts"), F.sum("n").alias("line_rows"))
    texts = f.agg(F.count_distinct("copy")).first()[0]
    # what is known of each different end, one row per end; then the texts, of which many may share one
    of = lambda column: f.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(column + "_rows"))
    known_tokens = of("token").join(trie(words, f), "token", "left")
    after = {k: of(f"ctx{k}").join(counts.select(F.col("ctx").alias(f"ctx{k}"), F.col("ends").alias(f"ends{k}"), F.col("goes_on").alias(f"on{k}")), f"ctx{k}", "left") for k in WIDTHS}
    joined = f.withColumn("texts", F.lit(texts))
    for column, table, count in (("line", lines, "line_rows"), ("token", known_tokens, "token_rows"), ("ctx5", after[5].join(sound, "ctx5", "left"), "ctx5_rows"), ("ctx3", after[3], "ctx3_rows")):
        joined = left_by_key(joined, table.withColumnRenamed(column, "_own_key"), F.col(column), "_own_key", count, F.col("id"))
    for unit, column in (("chars", "c"), ("bytes", "b")):  # one row per limit of a source, no more than there are sources times sizes that spike
        own = limits.where(F.col("unit") == unit).select(F.col("source").alias("_source"), F.col("size").alias(column))
        joined = joined.join(own, F.col("source").eqNullSafe(F.col("_source")) & (F.col(unit) == F.col(column)), "left").drop("_source")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = joined.select(
        F.col("id").alias(key), F.col("source").alias(source), "chars", "bytes", "stated", "token", "line", "mark", "dots", "open", "closed", "url", "unbalanced",
        zero("longer").alias("longer"), zero("whole").alias("whole"), zero("line_texts").alias("line_texts"), "texts", zero("ends5").alias("ends5"), zero("on5").alias("on5"), zero("ends3").alias("ends3"), zero("on3").alias("on3"), zero("final5").alias("final5"),
        (F.col("c").isNotNull() | F.col("b").isNotNull()).alias("at_limit"),
    )
    return out.withColumn("cut", _verdict()).withColumn("evidence", F.when(F.col("cut"), _evidence()))


def trie(words: DataFrame, finals: DataFrame) -> DataFrame:
    """(token, longer, whole): the vocabulary trie at the final tokens, in how many texts words go on from there and how often it is a word itself.

    The trie is a table of its nodes, prefix by prefix, down to ``TRIE_DEPTH`` characters; deeper down words hang in one bundle from the node of
    their first ``TRIE_DEPTH`` characters, and a final token that long is held against the words of its bundle.
    """
    known = words.where("word <> ''").groupBy("word").agg(F.sum("texts").alias("texts")).where("texts >= 2")
    depth = F.least(F.length("word"), F.lit(TRIE_DEPTH))
    nodes = (
        known.select(F.explode(F.transform(F.sequence(F.lit(1), depth), lambda i: F.struct(F.left("word", i).alias("p"), (i < F.length("word")).alias("proper")))).alias("n"), "texts")
        .groupBy(F.col("n.p").alias("token"))
        .agg(F.sum(F.when(F.col("n.proper"), F.col("texts")).otherwise(0)).alias("longer"), F.sum(F.when(~F.col("n.proper"), F.col("texts")).otherwise(0)).alias("whole"))
    )
    bundles = known.where(F.length("word") > TRIE_DEPTH).select(F.left("word", F.lit(TRIE_DEPTH)).alias("stem"), "word", "texts")
    deep = finals.where(F.length("token") > TRIE_DEPTH).select("token", F.left("token", F.lit(TRIE_DEPTH)).alias("stem")).distinct().join(bundles, "stem").where(F.startswith(F.col("word"), F.col("token")))
    same = F.col("word") == F.col("token")
    return nodes.unionByName(deep.groupBy("token").agg(F.sum(F.when(~same, F.col("texts")).otherwise(0)).alias("longer"), F.sum(F.when(same, F.col("texts")).otherwise(0)).alias("whole")))


def field_limits(finals: DataFrame, least: int = 5, times: float = 6.0, reach: int = 12) -> DataFrame:
    """(source, unit, size): sizes at which texts of a source stop in ``least`` ways or more, ``times`` as many as around it.

    Ways, not texts: one answer that many people give word for word has a size, but makes no limit. Sources that store
    texts in blocks stop at multiples of a block size; where multiples of one are ``times`` as common as chance
    has it, every multiple that occurs is a limit. Only histograms per source are looked at.
    """
    units = F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("size")) for u in ("chars", "bytes")))
    by = finals.select("source", "line", F.explode(units).alias("x")).groupBy("source", "x.unit", "x.size").agg(F.approx_count_distinct("line", 0.02).alias("n"))
    sizes = Window.partitionBy("source", "unit").orderBy("size")
    around = [(F.sum("n").over(sizes.rangeBetween(-r, r)) - F.col("n")) / (2 * r) for r in (reach, 10 * reach)]
    spikes = by.withColumn("around", F.greatest(*around, F.lit(0.3))).where((F.col("n") >= least) & (F.col("n") >= times * F.col("around"))).select("source", "unit", "size")
    blocks = F.array(*(F.lit(b) for b in BLOCKS))
    per_block = by.select("source", "unit", "n", "size", F.explode(blocks).alias("block")).groupBy("source", "unit", "block").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("size") % F.col("block") == 0, F.col("n")).otherwise(0)).alias("at"), F.count_if((F.col("size") % F.col("block") == 0) & (F.col("size") > F.col("block"))).alias("several"))
    used = per_block.where((F.col("at") >= least) & (F.col("several") >= 3) & (F.col("at") >= times * F.col("all") / F.col("block"))).select(F.col("source").alias("s"), F.col("unit").alias("u"), "block")
    multiples = by.join(used, F.col("unit").eqNullSafe(F.col("u")) & F.col("source").eqNullSafe(F.col("s"))).where(F.col("size") % F.col("block") == 0).select("source", "unit", "size")
    return spikes.unionByName(multiples).distinct()


def _middle_word() -> Column:
    return F.col("token").isNotNull() & (F.col("whole") == 0) & (F.col("longer") > 0)


def _at_limit() -> Column:
    return F.col("at_limit") | (F.col("stated") > F.col("chars") + 4)


def _evidence() -> Column:
    """What shows most directly that a text was cut: the vocabulary, lengths, a mark, open structure or the context."""
    return F.when(_middle_word(), "vocabulary").when(_at_limit(), "length").when(F.col("mark"), "mark").when(F.col("open"), "open structure").otherwise("context")


def _verdict() -> Column:
    """Whether the text was cut."""
    c = F.col
    middle_word, at_limit = _middle_word(), _at_limit()
    # the same last line, numbers aside, ends a share of all different texts; no habit ends in mid-word
    formula = (c("line_texts") >= F.greatest(F.lit(LEAST_FORMULA), FORMULA * c("texts"))) & ~middle_word
    much = c("ends5") + c("on5") >= 8  # else the shorter context must agree
    usual = (c("final5") >= 3) & (c("final5") >= 2 * c("on5"))  # many sound texts end like this
    on5, on3 = (c("on5") >= 1) & (c("ends5") <= 0.03 * c("on5")), (c("on3") >= 3) & (c("ends3") <= 0.03 * c("on3"))
    goes_on = ~usual & F.when(much, on5).otherwise(on3 & (c("ends5") == 0))
    may_go_on = ~usual & F.when(much, c("ends5") < 3 * c("on5")).otherwise(c("ends3") <= 3 * c("on3"))
    odd_word = c("token").isNotNull() & (c("longer") > 3 * c("whole"))
    return (
        F.when(c("mark"), True)
        .when(c("open"), ~c("closed") | at_limit)
        .when(formula & ~(c("at_limit") & goes_on), False)
        .when(c("dots"), goes_on | middle_word | may_go_on | at_limit)
        .when(c("url"), c("at_limit"))
        .when(c("closed"), False)
        .when(middle_word | goes_on, True)
        .when(at_limit, c("unbalanced") | may_go_on | odd_word)
        .otherwise(F.lit(False))
    )


def truncated(documents: DataFrame, **columns: str) -> DataFrame:
    """(doc_id): texts that stop before their author's text did. Null, empty and blank texts are none."""
    key = columns.get("key", "doc_id")
    return ends(documents, **columns).where("cut").select(key).distinct()


def share_by_source(documents: DataFrame, **columns: str) -> DataFrame:
    """(source, texts, cut, share) over the non-empty texts; a null source is a source of its own."""
    source = columns.get("source", "source")
    return ends(documents, **columns).groupBy(source).agg(F.count("*").alias("texts"), F.sum(F.col("cut").cast("long")).alias("cut")).withColumn("share", F.col("cut") / F.col("texts"))
