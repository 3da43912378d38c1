"""Files not written by hand for their project: generated, minified, third-party, or data saved as code.

What the head of a file shows:

* Identifier models: character trigrams of identifiers, counted per language over all files. Names for which the model of
  their language needs more bits a character than for the files of the language, and which are used again and again, are mangled, and so
  is the code, however long its lines are. This alone decides heads with names enough; lines of hundreds of characters only decide the others.
* Diversity: few different names for so many uses are a template's, or data. Where names are too few to tell, each line is
  reduced to its skeleton (names, numbers and strings by kind): one that keeps coming back at a fixed distance is no human writing.
* Foreign origin: hashes of three consecutive lines that also occur in another project. Their share among all of a
  head's hashes is the share of it that came from elsewhere. Names alone do not give a style away when projects
  share their words, so the order of whole lines takes the place of naming style.
* Banners above the first line of code, of tools and of third parties.

Files whose head was not read, or is too short to tell, are judged by what files with a readable head teach about
their traits: directory names, name patterns, detector counts, bytes a line (naive Bayes over counts of all files).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from operator import eq

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.operators.joins import inner_by_key
from lineweave.session import checkpointed

PERIODIC = 0.72
FOREIGN = 0.5
LONG_LINE = 300.0
LEAST_LINES = 6
MOST_GRAMS = 400_000  # trigrams that are broadcast; costs of all others are joined
UNKNOWN = -math.log2(0.1 / 6.4)  # bits of a trigram that no file teaches
HARDER, MUCH_HARDER = 0.5, 1.0  # bits a character above the lower quartile of a language; the first with MANGLED only
MANGLED = 0.5  # different names among all uses: mangled code uses its few names again and again
LEAST_NAMES = 8  # different names that a model needs to judge a head; diversity needs as many uses of names
MANY_NAMES = 20  # different names for which being much harder is enough
UNIFORM = 0.5  # of the median diversity of a language: less is a template's
MANGLED_SHARE = 0.5

_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_STRING = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'")
_NUMBER = re.compile(r"-?\b(?:0x[0-9a-fA-F]+|\d[\d.]*)\b|\d+")
_COMMENT = re.compile(r"^\s*(?://|#(?!include|define|if|endif|pragma|!)|/\*|\*|--|;|<!--|%|'|\{-|\(\*|\"\"\")")
_TOOL = re.compile(
    r"(?i)auto[- ]?generated|machine[- ]made|\bgenerated\s+(?:by|from|with|using)\b|code generated|\berzeugt von\b|\bgeneriert\b|\bproduit par\b|\bgénéré par\b|\bgenerado por\b|\bgerado por\b|сгенерирован|自動生成"
    r"|created with the .{2,60}\b(?:tool|generator|compiler)\b|changes? (?:here|made here|to this file)?.{0,20}\b(?:is|are|will be) lost|@?\w*compiler \d+\.\d|:: ?source=|\bdo not (?:edit|modify) by hand\b|\bmachine.{0,20}do not edit"
)
_THIRD = re.compile(r"(?i)/\*!.*\b(?:v?\d+\.\d+)|upstream:|\bvendored from\b|(?:\(c\)|copyright|©).{0,80}(?:authors|foundation|project|labs|contributors|licen[cs]e)|permission to use, alter|permission is hereby|\brelease \d+\.\d+|\d{4} .{3,40}\b(?:authors|foundation|labs|project)\b")
_OWN_BUNDLE = re.compile(r"^\s*/\*!\s*[\w\-]+\s+\d+\.\d+\.\d+\s*\*/")


_TOOL_WORDS = ("generated", "machine", "erzeugt", "generiert", "produit", "généré", "generado", "gerado", "сгенерирован", "自動生成", "created", "lost", "compiler", "source=", "by hand")


def by_tool(text: str) -> bool:
    """Whether a text says that a tool wrote the file. The words that every pattern needs are looked for first."""
    low = text.lower()
    return any(w in low for w in _TOOL_WORDS) and bool(_TOOL.search(text))


def decode(raw: bytes) -> str:
    for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError as e:
        return raw.decode("utf-8", "ignore") if e.start >= len(raw) - 4 else raw.decode("latin-1")


def skeletons(plain: str) -> list[str]:
    """The lines of a text whose strings are empty, with names and numbers reduced to their kind."""
    return _NAME.sub("w", _NUMBER.sub("0", plain)).split("\n")


def periodicity(shapes: list[str]) -> float:
    """The largest share, over distances of 1 to 6 lines, of lines whose shape is that of the line so far above."""
    n = len(shapes)
    return max((sum(map(eq, shapes[p:], shapes)) / (n - p) for p in range(1, 7) if n - p >= 4), default=0.0)


def shingles(lines: list[str]) -> list[int]:
    """The hashes of three consecutive lines, together of 24 characters or more."""
    hashes = {xxhash.xxh3_64_intdigest(a + "\n" + b + "\n" + c) for a, b, c in zip(lines, lines[1:], lines[2:], strict=False) if len(a) + len(b) + len(c) >= 24}
    return [h - (1 << 63) for h in sorted(hashes)]


def names_of(lines: list[str]) -> list[str]:
    return _NAME.findall(_STRING.sub(" ", "\n".join(lines)))


def _grams(name: str) -> list[str]:
    padded = f"^{name}$"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def head(raw: bytes | None, cut: bool) -> dict:
    """The traits of a file's head; an empty dict if it was not read or is empty."""
    if not raw:
        return {}
    text = decode(raw)
    every = [x.strip() for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    if cut and len(every) > 1:
        every.pop()
    lines = [x for x in every if x]
    if not lines:
        return {}
    first = next((i for i, x in enumerate(lines) if not _COMMENT.match(x) and x != "*/" and not x.startswith(("<?", "* "))), len(lines))
    banner = "\n".join(lines[: max(first, 0)])
    rest = lines[first:]
    body = [x for x in rest[:3] if not by_tool(x)] + rest[3:]
    plain = _STRING.sub("''", "\n".join(body))
    names = _NAME.findall(plain)
    long_ = sum(map(len, lines)) / len(lines)
    return {
        "lines": len(body),
        "periodic": periodicity(skeletons(plain)),
        "mean_line": long_,
        "tool": by_tool(banner),
        "third": bool(_THIRD.search(banner)) and not _OWN_BUNDLE.match(banner),
        "names": names,
        "diversity": len(set(names)) / len(names) if len(names) >= LEAST_NAMES else None,
        "shingles": shingles(body),
    }


_HEAD = "file_id long, project long, path string, ext string, size long, read boolean, lines int, periodic double, mean_line double, tool boolean, third boolean, diversity double, distinct_names int, bits double, shingles array<long>, others map<string, double>"
_FIELDS = [("file_id", pa.int64()), ("project", pa.int64()), ("path", pa.string()), ("ext", pa.string()), ("size", pa.int64()), ("read", pa.bool_()), ("lines", pa.int32()), ("periodic", pa.float64()), ("mean_line", pa.float64()), ("tool", pa.bool_()), ("third", pa.bool_()), ("diversity", pa.float64()), ("distinct_names", pa.int32()), ("bits", pa.float64()), ("shingles", pa.list_(pa.int64())), ("others", pa.map_(pa.string(), pa.float64()))]


def project_of(path: str | None) -> int:
    """A number for the project a path belongs to: its first two parts."""
    parts = [p for p in (path or "").replace("\\", "/").split("/") if p][:2]
    return int.from_bytes(blake2b("/".join(parts).lower().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _count_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ext, gram, n): trigrams of the names in a split's files, a name once a file."""
    names: dict[str, Counter] = {}
    for batch in batches:
        for ext, raw in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
            lines = decode(raw).splitlines() if raw else []
            if lines and len(raw) / len(lines) < LONG_LINE:
                own = names_of(lines)
                if sum(len(n) <= 2 for n in own) < MANGLED_SHARE * len(own):  # mangled names teach nothing about a language
                    names.setdefault((ext or "").lower(), Counter()).update(set(own))
    grams: dict[tuple[str, str], int] = {}
    for ext, own in names.items():
        for name, n in own.items():
            for g in _grams(name):
                grams[ext, g] = grams.get((ext, g), 0) + n
    keys = list(grams)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(grams.values()), pa.int64())], names=["ext", "gram", "n"])


class Names:
    """Bits a character that a language's model needs for names, from rows of (language, trigram, count, count of its first two characters).

    ``whole`` says that there are no more trigrams than those of the rows.
    """

    def __init__(self, rows: list[tuple[str, str, int, int]], whole: bool) -> None:
        self.costs: dict[str, dict[str, float]] = {}
        for ext, gram, n, start in rows:
            self.costs.setdefault(ext, {})[gram] = -math.log2((n + 0.1) / (start + 6.4))
        self.whole = whole
        self.seen: dict[str, dict[str, tuple[float, tuple[str, ...]]]] = {}

    def bits(self, ext: str, names: list[str]) -> tuple[float, dict[str, float]]:
        """Mean bits a character over the distinct names, and how often a character the trigrams occur that the rows lack.

        Those count as unknown here. They are named by trigram and language; ``whole`` models name none.
        """
        seen, costs = self.seen.setdefault(ext, {}), self.costs.get(ext, {})
        if len(seen) > 300_000:
            seen.clear()
        total, chars, others = 0.0, 0, Counter()
        for name in set(names):
            one = seen.get(name)
            if one is None:
                grams = _grams(name)
                one = seen[name] = sum(costs.get(g, UNKNOWN) for g in grams), () if self.whole else tuple(g + ext for g in grams if g not in costs)
            total += one[0]
            chars += len(name)
            if one[1]:
                others.update(one[1])
        return total / max(1, chars), {g: n / chars for g, n in others.items()}


def _traits(names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = names.value
        for batch in batches:
            rows = []
            for key, path, ext, size, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                got = head(raw, bool(raw) and size is not None and size > len(raw))
                if got:
                    bits, others = model.bits((ext or "").lower(), got["names"])
                    rows.append((key, project_of(path), path, ext, size, True, got["lines"], got["periodic"], got["mean_line"], got["tool"], got["third"], got["diversity"], len(set(got["names"])), bits, got["shingles"], list(others.items()) or None))
                else:
                    rows.append((key, project_of(path), path, ext, size, False, 0, 0.0, 0.0, False, False, None, 0, 0.0, [], None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [()] * len(_FIELDS), _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])

    return run


def _by_others(heads: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, more): what the trigrams that are not broadcast add to the bits a character of a head, where they counted as unknown.

    Heads that teach nothing may hold one of them in a great part of all rows, so those of many heads are broadcast, known or not.
    """
    asked = heads.where("others is not null").select("row", F.explode("others").alias("gram", "times"))
    known = counts.select(F.concat("gram", "ext").alias("_gram"), (-F.log2((F.col("n") + 0.1) / (F.col("start") + 6.4)) - UNKNOWN).alias("more"))
    table = asked.groupBy(F.col("gram").alias("_gram")).agg(F.count("*").alias("heads")).join(known, "_gram", "left")
    return inner_by_key(asked, checkpointed(table), "gram", "_gram", "heads").groupBy("row").agg(F.sum(F.col("times") * F.col("more")).alias("more"))


def judged(tree: DataFrame, measures: DataFrame) -> DataFrame:
    """One row per file id: all traits, ``kind`` (generated, minified, third_party, data or null), the ``evidence`` that decided and ``machine_made``."""
    spark = tree.sparkSession
    files = tree.where(F.col("file_id").isNotNull()).select(F.col("file_id").cast("long").alias("file_id"), "path", "ext", F.col("size").cast("long").alias("size"), "content")
    grams = files.mapInArrow(_count_names, "ext string, gram string, n long").groupBy("ext", "gram").agg(F.sum("n").alias("n"))
    counts = checkpointed(grams.withColumn("start", F.sum("n").over(Window.partitionBy("ext", F.substring("gram", 1, 2)))))
    # the most frequent ones are broadcast, a bound that does not grow with the data; the executors find them, the driver gets these alone
    rows = checkpointed(counts.orderBy(F.col("n").desc(), "ext", "gram").limit(MOST_GRAMS)).collect()
    whole = counts.count() == len(rows)
    names = spark.sparkContext.broadcast(Names([tuple(r) for r in rows], whole))
    heads = files.mapInArrow(_traits(names), _HEAD)
    heads = checkpointed(heads.drop("others") if whole else heads.withColumn("row", F.monotonically_increasing_id()))
    told = heads.withColumn("triples", F.size("shingles")).drop("shingles")
    if not whole:
        told = checkpointed(told.drop("others").join(_by_others(heads, counts), "row", "left").withColumn("bits", F.col("bits") + F.coalesce("more", F.lit(0.0))).drop("row", "more"))

    some = heads.where(F.size("shingles") > 0).select("file_id", "project", F.explode("shingles").alias("shingle"))
    # lines of a licence may stand in a great part of all files
    spread = some.groupBy(F.col("shingle").alias("_shingle")).agg(F.min("project").alias("a"), F.max("project").alias("b"), F.count("*").alias("n")).where("a <> b").select("_shingle", "n")
    foreign = inner_by_key(some.select("file_id", "shingle"), spread, "shingle", "_shingle", "n").groupBy("file_id").agg(F.count("*").alias("shared"))

    counted = measures.where(F.col("file_id").isNotNull()).groupBy(F.col("file_id").cast("long").alias("file_id")).agg(F.max("file_full_name").alias("full_name"), F.max("file_type").alias("file_type"), F.max("file_machine").alias("machine"), F.max("file_nbnc").alias("nbnc"), F.max("file_total").alias("total"), F.max("file_bytes").alias("bytes"))
    # what is usual in a language; one row per extension
    usual = told.where((F.col("distinct_names") >= LEAST_NAMES) & (F.col("mean_line") < LONG_LINE)).groupBy(F.lower(F.coalesce("ext", F.lit(""))).alias("language")).agg(F.percentile_approx("bits", 0.25, 1000).alias("usual_bits"), F.percentile_approx("diversity", 0.5, 1000).alias("usual_diversity"))
    both = told.withColumn("language", F.lower(F.coalesce("ext", F.lit("")))).join(F.broadcast(usual), "language", "left").drop("language").join(foreign, "file_id", "left").join(counted, "file_id", "full")
    path = F.coalesce("path", F.translate("full_name", "\\", "/"))
    both = both.select(
        "file_id", path.alias("path"), F.lower(F.coalesce("ext", F.ltrim("file_type", F.lit(".")))).alias("ext"), F.coalesce("size", "bytes").alias("size"), F.coalesce("read", F.lit(False)).alias("read"),
        F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("periodic", F.lit(0.0)).alias("periodic"), F.coalesce("mean_line", F.lit(0.0)).alias("mean_line"), F.coalesce("tool", F.lit(False)).alias("tool"), F.coalesce("third", F.lit(False)).alias("third"),
        "diversity", F.coalesce("bits", F.lit(0.0)).alias("bits"), F.coalesce("distinct_names", F.lit(0)).alias("distinct_names"), "usual_bits", "usual_diversity",
        F.coalesce(F.col("shared") / F.col("triples"), F.lit(0.0)).alias("foreign"), F.coalesce("triples", F.lit(0)).alias("triples"), "machine", "nbnc", "total",
        (F.coalesce("size", "bytes") / F.greatest("total", F.lit(1))).alias("per_line"),
    )
    c = F.col
    named = c("read") & (c("distinct_names") >= LEAST_NAMES)
    above = c("bits") - c("usual_bits")
    hard_names = named & (((above >= HARDER) & (c("diversity") < MANGLED)) | ((above >= MUCH_HARDER) & (c("distinct_names") >= MANY_NAMES)))
    few_names = c("read") & (c("diversity") < UNIFORM * c("usual_diversity"))
    long_lines = ~named & (F.greatest(c("mean_line"), F.coalesce(c("per_line"), F.lit(0.0))) >= LONG_LINE)
    template = (c("lines") >= LEAST_LINES) & (c("periodic") >= F.when(c("lines") >= 2 * LEAST_LINES, PERIODIC).otherwise(0.9))
    by_template = F.when(c("tool"), "generated").otherwise("data")
    # what decides, in this order: (evidence, whether it speaks, kind)
    decisions = (
        ("banner", c("read") & c("third"), F.lit("third_party")),
        ("shared lines", c("read") & (c("triples") >= 4) & (c("foreign") >= FOREIGN), F.lit("third_party")),
        ("hard names", hard_names, F.lit("minified")),
        ("few names", few_names, by_template),
        ("long lines", long_lines, F.lit("minified")),
        ("repeated lines", template, by_template),
        ("banner", c("read") & c("tool") & (c("lines") < LEAST_LINES), F.lit("generated")),
    )
    own, evidence = F, F
    for name, speaks, kind in decisions:
        own, evidence = own.when(speaks, kind), evidence.when(speaks, name)
    both = both.withColumn("evidence", evidence)
    sure = own.isNotNull() | (c("read") & (c("lines") >= LEAST_LINES))
    seen = checkpointed(both.withColumn("kind", own).withColumn("sure", sure).withColumn("traits", _trait_list()))
    return _by_traits(seen)


def _trait_list():
    """Names of the traits that a file has whether or not its head was read."""
    c = F.col
    parts = F.filter(F.split(F.regexp_replace(F.lower("path"), r"^/+", ""), "/"), lambda x, i: i >= 2)
    folders = F.transform(F.filter(parts, lambda x, i: i < F.size(parts) - 1), lambda x: F.concat(F.lit("dir:"), F.regexp_replace(x, r"\d+", "0")))
    versioned = F.when(F.exists(parts, lambda x: x.rlike(r"[-_]v?\d+[._]\d+[._]\d+$")), "dir:with version")
    name = F.element_at(F.split("path", "/"), -1)
    pattern = F.concat(F.lit("ends:"), F.regexp_replace(F.regexp_extract(name, r"((?:[._]\w{1,12}){1,3})$", 1), r"\d+|[0-9a-f]{8}", "0"))
    tail = F.concat(F.lit("tail:"), F.regexp_extract(name, r"[a-z0-9]((?:[_.](?:pb2?|grpc|gen|generated|min|tab|designer|g|d|bundle|chunk))+\.\w+)$", 1))
    lead = F.concat(F.lit("lead:"), F.regexp_extract(name, r"^([A-Za-z]{1,12}?)[-_.]", 1))
    full = F.concat(F.lit("name:"), F.lower(name))
    share = c("machine") / F.greatest("total", F.lit(1))
    detector = F.concat(F.lit("machine:"), F.when(c("machine").isNull() | (c("machine") == 0), "none").when(share > 0.5, F.concat(F.lit("most,"), F.when(c("nbnc") <= 1, "all").otherwise("not all"))).otherwise("some"))
    width = F.concat(F.lit("width:"), F.when(c("per_line") >= 1000, "1000").when(c("per_line") >= LONG_LINE, "300").when(c("per_line") >= 80, "80").otherwise("0"))
    return F.array_distinct(F.filter(F.concat(F.coalesce(folders, F.array().cast("array<string>")), F.array(versioned, pattern, tail, lead, full, detector, width)), lambda x: x.isNotNull() & ~x.endswith(":")))


def _by_traits(seen: DataFrame) -> DataFrame:
    """Judge the files whose head cannot tell by naive Bayes over the traits of those whose head can."""
    sure = seen.where("sure").select(F.col("kind").isNotNull().alias("made"), "traits")
    total = sure.agg(F.count("*").alias("all"), F.count_if("made").alias("made")).first()
    stats = sure.select("made", F.explode("traits").alias("trait")).groupBy("trait").agg(F.count("*").alias("n"), F.count_if("made").alias("made_n"))
    # log odds of a trait, held back by a pseudo-count and so by rarity
    prior = (total["made"] + 1) / (total["all"] - total["made"] + 1)
    odds = stats.select(F.col("trait").alias("_trait"), "n", F.log(((F.col("made_n") + prior / 2) / (total["made"] + 1)) / ((F.col("n") - F.col("made_n") + 0.5) / (total["all"] - total["made"] + 1))).alias("odds"))
    unsure = seen.where("not sure").select("file_id", F.explode("traits").alias("trait"))
    # directories of one file tell the same thing more than once: the strongest two traits on either side count
    scored = inner_by_key(unsure, odds, "trait", "_trait", "n").groupBy("file_id").agg(F.slice(F.sort_array(F.collect_list("odds"), False), 1, 2).alias("up"), F.slice(F.sort_array(F.collect_list("odds")), 1, 2).alias("down"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    scored = scored.select("file_id", (F.lit(math.log(prior)) + add(F.filter("up", lambda x: x > 0)) + add(F.filter("down", lambda x: x < 0))).alias("score"))
    out = seen.join(scored, "file_id", "left")
    made = F.when(F.col("sure"), F.col("kind").isNotNull()).otherwise((F.coalesce("score", F.lit(-1.0)) > F.when(F.col("read"), 4.0).otherwise(1.5)) & (F.coalesce("size", F.lit(1)) > 0))
    return out.withColumn("machine_made", made).withColumns({"kind": F.when(F.col("sure"), F.col("kind")).when(F.col("machine_made"), "by traits"), "evidence": F.coalesce("evidence", F.when(F.col("machine_made"), "traits"))})


def not_hand_written(tree: DataFrame, measures: DataFrame) -> DataFrame:
    """(file_id): files whose greater part was not written by hand for their project.

    A file id in either table counts once, repeated deliveries of measures included; rows with a null id take no part.
    Files that are empty are none; a file without a path or content is judged by whatever else is known of it.
    """
    return judged(tree, measures).where("machine_made").select("file_id").distinct()
