"""Text decoded with the wrong character encoding: found, and restored where possible.

A best-first search walks over re-encode, decode and unescape operations from a token as it stands. States are visited
once (by hash); the cost that guides the search and picks the answer is the implausibility of the characters under a
model of the corpus: the negative log of the joint probability of neighbouring characters, counted over all tokens without
a replacement or control character, and a price on characters that the corpus does not know. Tokens that are UTF-8 once encoded
again are not counted, or one in every row would teach the model that it is plausible. A token whose cheapest reachable
text is clearly cheaper than itself was garbled; foreign or odd text has no cheaper text to go to.

Text garbled and then escaped within ASCII (``caf&Atilde;&copy;``, ``caf\\u00c3\\u00a9``) is searched from what it unescapes to, and counts as garbled
only where that reads as UTF-8 beyond chance: escapes by themselves are no garbling, nor are percent signs and quoted-printable, which
stand for bytes and are read as UTF-8 at once.

Spark side: the distinct tokens with characters beyond ASCII or escapes of such are searched once each, however often they occur.
"""

from __future__ import annotations

import codecs
import heapq
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.operators.joins import left_by_key
from lineweave.session import checkpointed

# Encodings in common use, as names of codecs: those text was wrongly read in, and those it was written in.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "cp1254", "koi8_r", "cp866", "cp932", "iso8859_2", "iso8859_15", "gbk")
WRITTEN_IN = ("utf-8", "cp1252", "cp1251", "koi8_r", "cp866", "mac_roman", "cp1250", "cp1253", "cp1254", "cp437", "cp850", "cp932", "euc_jp", "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_9", "gbk", "euc_kr", "big5")

DEPTH = 3
REACH = 10.0  # how much dearer than the best text a state may be and still be expanded
MARGIN = 1.4
PER_STEP = 0.3
CHAIN = 25.0
UNKNOWN = 12.0
MOST_GRAMS = 1_000_000
_FLOOR_COUNT = 0.02

_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|%([0-9A-F]{2})|=([0-9A-F]{2})")
_BYTES = re.compile(r"(?:[%=][89A-Fa-f][0-9A-Fa-f]){2,}|(?:\\x[89a-fA-F][0-9a-fA-F]){2,}")
# what escapes of characters beyond ASCII look like, at least two next to each other, as garbling leaves them
ESCAPED = r"(?:&(?:[A-Za-z]{2,8}|#1[2-9]\d|#2\d\d|#8\d{3}|#x[89a-fA-F][0-9a-fA-F]);){2}|(?:\\u00[89a-fA-F][0-9a-fA-F]){2}|(?:[%=]C[23][%=][89AB][0-9A-F]){2}"


def _bytes_of_c1(error: UnicodeError):
    """Keep code points below 256 that a codec has no byte for (and bytes it has no character for) as they are."""
    if isinstance(error, UnicodeEncodeError):
        part = error.object[error.start : error.end]
        if all(ord(c) < 256 for c in part):
            return bytes(ord(c) for c in part), error.end
    elif isinstance(error, UnicodeDecodeError):
        part = error.object[error.start : error.end]
        return "".join(map(chr, part)), error.end
    raise error


codecs.register_error("keep_c1", _bytes_of_c1)


def _encode(text: str, name: str) -> bytes | None:
    try:
        return text.encode(name, "keep_c1" if name.startswith("cp125") else "strict")
    except UnicodeError:
        return None


def _decode(raw: bytes, name: str) -> str | None:
    try:
        return raw.decode(name)
    except UnicodeError:
        return None


_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf4][\x80-\xbf]{3}")
_BY_CHARACTER = tuple(n for n in READ_AS if n not in ("cp932", "gbk"))
_WESTERN = ("cp1252", "latin-1")  # one sequence is enough: their accented letters are not followed by signs in words


def _utf8_within(text: str, name: str) -> str:
    """Decode those stretches of a text that are whole UTF-8 sequences read as ``name``; the rest stays."""
    raw = text.encode(name, "keep_c1_or_mark")
    out, last = [], 0
    for m in _UTF8.finditer(raw):
        try:
            inner = m[0].decode("utf-8")
        except UnicodeError:
            continue
        out += [text[last : m.start()], inner]
        last = m.end()
    return "".join(out) + text[last:] if out else text


def reads_as_utf8(token: str) -> bool:
    """Whether the characters beyond ASCII are UTF-8 sequences read in another encoding, too many or too plain for chance."""
    for name in _BY_CHARACTER:
        raw = _encode(token, name)
        inner = raw and _decode(raw, "utf-8")
        if inner:
            beyond = [c for c in inner if c > "\x7f"]
            if beyond and (name in _WESTERN or len(beyond) > 1 or beyond[0] < "\u0100"):
                return True
    return False


def _mark(error: UnicodeError):
    part = error.object[error.start : error.end]
    return bytes(ord(c) if 0x80 <= ord(c) < 0xA0 else 63 for c in part), error.end


codecs.register_error("keep_c1_or_mark", _mark)


def _unescape(text: str) -> str:
    text = html.unescape(text) if "&" in text else text
    return _ESCAPE.sub(lambda m: chr(int(next(g for g in m.groups() if g), 16)), text)


def unescaped(token: str) -> str | None:
    """What a token within ASCII stands for, if it holds escapes; runs of escaped bytes are read as UTF-8 if they are it, else they stay."""

    def whole(m: re.Match) -> str:
        raw = bytes(int(x, 16) for x in re.findall(r"[0-9A-Fa-f]{2}", m[0]))
        return _decode(raw, "utf-8") or m[0]

    text = _BYTES.sub(whole, token)
    if "&" in text:
        text = html.unescape(text)
    text = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: c if not 0xD800 <= ord(c := chr(int(m[1], 16))) < 0xE000 else m[0], text)
    return text if not text.isascii() else None


def _fold(c: str) -> str:
    """Characters as the model sees them: letters beyond ASCII as they are, ASCII letters by case, the rest by kind."""
    if c > "\x7f":
        return c
    if c.islower():
        return c
    return "A" if c.isupper() else "0" if c.isdigit() else "."


def grams(token: str) -> list[str]:
    """Two and three neighbouring characters of which at least one is beyond ASCII."""
    folded = "." + "".join(map(_fold, token)) + "."
    return [g for n in (2, 3) for i in range(len(folded) - n + 1) if not (g := folded[i : i + n]).isascii()]


class Plausibility:
    """Cost of a text from counts of neighbouring characters."""

    def __init__(self, counts: dict[str, int], total: int) -> None:
        self.costs = {k: math.log(total / n) for k, n in counts.items()}
        self.floor = math.log(max(total, 2) / _FLOOR_COUNT)
        self.known = frozenset(c for k in counts for c in k)

    def cost(self, text: str) -> float:
        floor, costs = self.floor, self.costs
        return sum(costs.get(g, floor) for g in grams(text)) / 2 + sum(30 if c < "\xa0" or c == "�" else UNKNOWN for c in text if c > "\x7f" and (c < "\xa0" or c == "�" or c not in self.known))


def restore(token: str, model: Plausibility, depth: int = DEPTH, reach: float = REACH) -> tuple[str, float, str]:
    """(cheapest reachable text, cost saved, operations) by best-first search; the token itself if none is cheaper.

    States are expanded in order of cost until the cheapest that is left is dearer than the best text by ``reach``; the start always is.
    """
    start = model.cost(token)
    best = (start, token, "")
    queue = [(start, 0, token, "")]
    visited = {token}
    while queue and queue[0][0] <= max(best[0] + reach, start if not queue[0][1] else 0):
        cost, level, text, path = heapq.heappop(queue)
        if level == depth:
            continue
        nexts = [("unescape", _unescape(text))]
        nexts += [(f"{name}>utf-8", _utf8_within(text, name)) for name in _BY_CHARACTER]
        raws: dict[bytes, str] = {}
        for name in READ_AS:
            raw = _encode(text, name)
            if raw is not None and raw not in raws:
                raws[raw] = name
        for raw, name in raws.items():
            for target in WRITTEN_IN:
                if target != name and (inner := _decode(raw, target)) is not None:
                    nexts.append((f"{name}>{target}", inner))
        straight_so_far = all(x.endswith("utf-8") or x == "unescape" for x in path.split())
        so_far = cost - model.cost(text) if path else 0
        for step, found in nexts:
            if found in visited or not found:
                continue
            visited.add(found)
            # wrong readings that stack up went through UTF-8 each time; other chains are worth a try, but at a price
            straight = not path or step == "unescape" or (step.endswith("utf-8") and straight_so_far)
            new = model.cost(found) + PER_STEP + so_far + (0 if straight else CHAIN)
            way = f"{path} {step}".strip()
            if new < best[0]:
                best = (new, found, way)
            if new <= best[0] + reach and level + 1 < depth:
                heapq.heappush(queue, (new, level + 1, found, way))
    return best[1], start - best[0], best[2]


def restore_escaped(token: str, model: Plausibility) -> tuple[str, float, str] | None:
    """``restore`` of what a token within ASCII stands for; None unless that was garbled before it was escaped."""
    inner = unescaped(token)
    if inner is None or not reads_as_utf8(inner):
        return None
    found, gain, path = restore(inner, model)
    return (found, gain, f"unescape {path}") if path else None


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, int] = {}
    for batch in batches:
        for token, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if "�" in token or any("\x7f" < c < "\xa0" for c in token) or reads_as_utf8(token):
                continue
            for g in grams(token):
                counts[g] = counts.get(g, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])


def _search(model, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            rows = []
            for token, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if token.isascii():
                    if (got := restore_escaped(token, own)) and got[1] >= margin:
                        rows.append((token, got[0], float(got[1]), got[2], False, n))
                    continue
                found, gain, path = restore(token, own)
                lost = "�" in token
                if lost or gain >= margin:
                    rows.append((token, found if gain >= margin else None, float(gain), path, lost, n))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, (pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.int64()), strict=True)], names=["token", "restored", "gain", "path", "lost", "n"])

    return run


def garbled_tokens(texts: DataFrame, text: str, margin: float = MARGIN) -> DataFrame:
    """(token, restored, gain, path, lost, n) for each distinct garbled token of ``text``, which occurs n times; restored is null where nothing plausible is reachable."""
    spark = texts.sparkSession
    tokens = texts.where(_worth(F.col(text))).select(F.explode(_tokens(F.col(text))).alias("token"))
    distinct = checkpointed(tokens.groupBy("token").agg(F.count("*").alias("n")))
    counted = distinct.mapInArrow(_count_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    # a model of bounded size; the most frequent are found by the executors, the driver gets these alone
    rows = checkpointed(counted.orderBy(F.col("n").desc(), "gram").limit(MOST_GRAMS)).collect()
    model = spark.sparkContext.broadcast(Plausibility({r.gram: r.n for r in rows}, sum(r.n for r in rows) or 1))
    # as many tasks as keep all cores at work; a stated number is not put together again for being small in bytes
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return distinct.repartition(tasks, "token").mapInArrow(_search(model, margin), "token string, restored string, gain double, path string, lost boolean, n long")


def _worth(text: Column) -> Column:
    """Whether a text holds characters beyond ASCII or escapes of such. Escapes begin with one of four signs, which are looked for first."""
    signs = F.contains(text, F.lit("&")) | F.contains(text, F.lit("\\u00")) | F.contains(text, F.lit("%C")) | F.contains(text, F.lit("=C"))
    return text.rlike(r"[^\x00-\x7F]") | (signs & text.rlike(ESCAPED))


def _tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(r"[^\x00-\x20]+"), F.lit(0)), _worth)


def garbled_rows(fields: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(table_name, row_id, original, restored, whole) of the rows of (table_name, row_id, text) that hold a garbled token.

    ``restored`` has each garbled token replaced by its restoration; tokens that cannot be restored stay, and ``whole``
    tells whether any did. Null texts and empty texts are never garbled, nor are texts within ASCII without escapes. Rows with a null id take
    no part. Repeated deliveries of one row give one row per different text.
    """
    texts = fields.where(F.col("row_id").isNotNull()).select("table_name", F.col("row_id").cast("long").alias("row_id"), "text").where(_worth(F.col("text"))).distinct()
    bad = checkpointed(garbled_tokens(fields, "text", margin))
    # a token may stand in a great part of all rows
    found = bad.select(F.col("token").alias("_token"), "restored", "lost", "n")
    hits = left_by_key(texts.withColumn("token", F.explode(F.array_distinct(_tokens(F.col("text"))))), found, F.col("token"), "_token", "n", F.col("row_id")).where("n is not null")
    fixes = F.map_from_entries(F.collect_list(F.struct("token", F.coalesce("restored", "token").alias("restored"))))
    per_row = hits.groupBy("table_name", "row_id", "text").agg(fixes.alias("fixes"), F.bool_and(F.col("restored").isNotNull() & ~F.col("lost")).alias("whole"))
    # token by token, so that a token that is part of another does not change it
    parts = F.regexp_extract_all("text", F.lit(r"[\x00-\x20]+|[^\x00-\x20]+"), F.lit(0))
    fixed = F.array_join(F.transform(parts, lambda x: F.coalesce(F.element_at("fixes", x), x)), "")
    return per_row.select("table_name", "row_id", F.col("text").alias("original"), fixed.alias("restored"), "whole")
