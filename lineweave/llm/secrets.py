"""Credentials in lines of source code and configuration: found through a trigram index, verified, masked.

Every rule is a regular expression whose groups mark the secret value. The trigrams it cannot do without are derived
from the expression itself; the index of a block of lines gives each rule's candidates, and only those are read by
the rule. A match counts if its value is a literal secret: not a placeholder, a reference
to a vault or variable, a call, a hash, a sample or a sentence.

Lines within a private key block hold nothing but key material; they are found by joining lines of base64 with
the blocks that the markers of their file open and close.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm import trigrams

BUCKET = 512  # line numbers
# how far a key block can reach whose other end was not delivered: a key of 512 lines has 24 KB, more than any in use; without a file id, lines
# of other files of the same name lie between, and 64 lines are a key of 3 KB
OPEN_REACH, BLIND_REACH = 512, 64
CUT = 245  # lines are stored up to 255 characters, less what was trimmed
MASK = "[MASKED]"

# Words for a secret in names, in several languages.
_WORDS = r"pass(?:word|wd|phrase|wort|code)?|pwd|(?:^|[ \"'.])pw\b|_pw\b|kennwort|senha|contrase(?:na|ñ)|mot_?de_?passe|secret|token|api_?key|access_?key|private_?key|master_?key|hmac_?key|encryption_?key|signing_?key|client_?key|auth_?key|credential|credencia|geheim|haslo|losenord|wachtwoord|salasana|parol[ae]?\b|пароль"
_NAME = rf"(?<![\w.\-$\[\]])[\w.\-$\[\]]*(?:{_WORDS})[\w\-]*"
_AFTER_NAME = re.compile(r"^[_\-.]?(?:hash|digest|checksum|fingerprint|id|name|len|length|hint|label|policy|url|uri|file|path|type|expir\w*|ttl|count|ref|field|regex|pattern|error|message|valid\w*)(?:es|s)?(?![a-z])", re.I)

# Public formats of tokens.
TOKENS = (
    r"\bAKIA[0-9A-Z]{16}\b", r"\bASIA[0-9A-Z]{16}\b", r"\bgh[pousr]_[A-Za-z0-9]{20,}", r"\bgithub_pat_\w{20,}", r"\bglpat-[\w\-]{16,}", r"\bxox[abeoprs]-[\w\-]{10,}",
    r"\b[sr]k_(?:live|prod)_[A-Za-z0-9]{10,}", r"\bAIza[\w\-]{20,}", r"\bnpm_[A-Za-z0-9]{20,}", r"\bSG\.[\w\-]{10,}\.[\w\-]{10,}", r"\beyJ[\w\-]{8,}\.eyJ[\w\-]{8,}(?:\.[\w\-]+)?", r"\bpypi-[\w\-]{20,}", r"\bhvs\.[\w\-]{20,}", r"\bdop_v1_[a-f0-9]{32,}",
)
_KNOWN = re.compile("|".join(TOKENS))
_VENDOR = re.compile(r"\b[a-z]{3,6}_[A-Za-z0-9]{20,}\b")

RULES: dict[str, str] = {
    **{f"token{i}": rf"({t})" for i, t in enumerate(TOKENS)},
    "quoted": rf"(?i)({_NAME})[\"']?\]?\s*(?:=>|:=|=|:|,)\s*[bru]?([\"'])((?:(?!\2).)+)\2",
    "attribute": rf"(?i)\b(?:key|name|id)\s*=\s*([\"'])({_NAME})\1\s+value\s*=\s*([\"'])([^\"']+)\3",
    "element": rf"(?i)<({_NAME})>([^<>]+)</",
    "plain": rf"(?i)^\s*(?:-\s+)?[\"']?({_NAME})[\"']?:\s+([^\s\"'][^\s]*)\s*(?:$|\s[#;/])",
    "exported": rf"(?i)(?:^|\bexport\s+|\bset\s+|\bsetenv\s+|;\s*|\bENV\s+|&|\?)({_NAME}|sig|signature)=([^\s;&\"'<>]+)",
    "option": rf"(?i)\s(?=-)({_NAME})(?:=|\s+)[\"']?([^\s\"']+)",
    "mysql": r"(?i)\b(?:mysql|mysqldump|mysqladmin|mariadb)\b.*?\s-p([^\s\"']+)",
    "curl": r"(?i)\b(?:curl|wget|http)\b.*?\s(?:-u|--user)\s*[\"']?[^\s:\"']+:([^\s\"']+)",
    "url": r"\b[a-z][\w+.\-]*://[^\s/:@\"'<>]*:([^\s@\"'<>]+)@[\w.\-\[]",
    "basic": r"(?i)\bbasic\s+([A-Za-z0-9+/_\-]{8,}={0,2})",
    "bearer": r"(?i)\bbearer\s+([\w.\-+/=~]{12,})",
    "login": r"(?i)\b(?:login|log_in|signin|sign_in|authenticate|connect)\s*\(\s*[\"'][^\"']*[\"']\s*,\s*[\"']([^\"']+)[\"']",
    "identified": r"(?i)\bidentified\s+by\s+(?:password\s+)?[\"']([^\"']+)[\"']",
    "note": r"(?i)(?:[ \"']pw|\b(?:pwd|password|passwd|login|log\s?in|creds?|credentials|account))\b[^/:>]*?[:>\s]\s*[\w.@\-]+\s+/\s+(\S+)",
    "connection": r"(?i)\b(?:password|pwd)\s*=\s*([^;\"'\s]+)",
    "decoded": rf"(?i)({_NAME})\s*(?::=|=|:)\s*[\w.:]*(?:base64|b64|unhex|fromhex|atob|decode)\w*[\w.:]*\(\s*[bru]?[\"']([^\"']+)[\"']",
    "bytes": rf"(?i)(?:byte|char|uint8|u8|int)\w*\s*(?:\[\w*\])?\s*(\w*(?:key|{_WORDS})\w*)(?:\[\w*\])?\s*=\s*(?:new\s+byte\[\]\s*)?\{{?\[?\s*((?:(?:\(byte\)\s*)?0x[0-9a-f]{{1,2}}\s*,\s*){{7,}}[^}};\]]*)",
    "pem": r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:\\r)?(?:\\n|\s)+([A-Za-z0-9+/=\\\s]+)",
    "pieces": r"([\"'])([^\"'\s]{4,})\1\s*(?:\+|\.|&|\.\.|\|\|)\s*([\"'])([^\"'\s]{2,})\3",
    "opaque": r"(?:=|:)\s*([\"'])([A-Za-z0-9+/_\-]{16,}={0,2})\1",
}
_COMPILED = {k: re.compile(v) for k, v in RULES.items()}
_NEXT_PIECE = re.compile(r"\s*(?:\+|\.|&|\.\.|\|\|)\s*([\"'])([^\"'\s]+)\1")
_ANY_WORD = re.compile(_WORDS, re.I)
_MARKER = r"^\W*-----(BEGIN|END) ([A-Z0-9 ]+)-----\W*$"
_BODY = r"^\s*[A-Za-z0-9+/]{20,}={0,2}\s*$"
# within a block whose both ends are there: any base64, quoted, commented, joined or ended by an escape, whatever its length
_ANY_BODY = r"^[\s\"'`#*;>|+.,()\-]*(?://)?\s*[\"']?[A-Za-z0-9+/]+={0,2}(?:\\+[nr])*[\s\"'`+.,;)\\]*$"


def queries() -> dict[str, set[frozenset[int]]]:
    """Index queries of all rules. Rules without fixed text ask for a long run of token characters instead."""
    out = {}
    for name, pattern in RULES.items():
        need = trigrams.required(pattern)
        if need == {frozenset()}:
            need = {frozenset({trigrams.LONG_RUN})}
            if name == "pieces":  # shorter than a run, but joined
                need = {frozenset({trigrams.JOINED})}
        out[name] = need
    return out


def _is_name(name: str) -> bool:
    """Whether the thing named is the secret itself, not its hash, id or length, nor a public key."""
    last = None
    for last in _ANY_WORD.finditer(name):  # noqa: B007
        pass
    if last is None:
        return bool(re.search(r"(?i)key|sig", name)) and not re.search(r"(?i)public", name)
    return not _AFTER_NAME.match(name[last.end() :]) and not re.search(r"(?i)public[_\-.]?$", name[: last.start()])


# -- values --------------------------------------------------------------------------------------------------------

_PLACEHOLDER = re.compile(
    r"""(?ix) ^ (?: \W* | (.)\1{3,} | x{4,} | [*.•]+ | <[^>]*> | \{\{.*\}\} | \$\{?.* | %\(.*\)s | %\w+% | @\w+@ | \#\{.*\}
      | (?:none|null|nil|true|false|undefined|empty|todo|tbd|n/?a|password|passwd|secret|token|changeit|string|str|int|bool|text|bytes|value|redacted|masked|hidden|required|optional)
      | .*(?:replace_?me|change_?me|your[_\- ]?\w*|placeholder|insert_?\w*here|redacted|goes_?here).*
      | (?:my|some|a|the)?[_\-]?(?:example|sample|dummy|fake|test)[_\-]?(?:key|token|secret|password|value|only)?\d{0,2} ) $"""
)
_REFERENCE = re.compile(r"""(?ix) ^ (?: (?:vault|aws|gcp|ssm|azurekeyvault|op|keyring|file|env|secretsmanager|ref|arn)[:/] | ENC\[ | ENC\( | \$ANSIBLE_VAULT | os\.environ | process\.env | getenv | System\.getenv | ENV\[ | !\w+ | \{ )""")
_HASH = re.compile(r"^(?:\$(?:2[abxy]?|1|5|6|argon2\w*|pbkdf2[\w\-]*|scrypt|y)\$|(?:sha|md)\d+[-:$]|\{(?:SSHA|SHA|MD5|CRYPT)\}|pbkdf2)", re.I)
_CODE = re.compile(r"^[\w.$>\-]*(?:\w\(.*\)?|\[[^\]]*\];?)$|^[A-Za-z_]\w*(?:\.\w+)+;?$|^[a-z]+\)?:?,?$")
_UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)
_SAMPLE_NOTE = re.compile(r"(?:^|\s)(?:#|//|/\*|--|;)\s[^\n]*\b(?:from the (?:manual|docs?|documentation|readme)|example|sample|dummy|fake|placeholder|not (?:a )?real|test vector)\b", re.I)
_CONTEXT_NOT = re.compile(r"(?i)\b(?:md5(?:sum)?|sha\d*(?:sum)?|checksum|etag|integrity|commit|public_?key|ssh-(?:rsa|ed25519|dss)|ecdsa-sha2|fingerprint|crc|digest|revision|uuid|guid|hash)\b")


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def literal_secret(value: str) -> bool:
    """Whether the value given to a secret's name is a literal: no placeholder, reference, call, hash or sentence."""
    value = value.strip()
    if len(value) < 4 or _PLACEHOLDER.match(value) or _REFERENCE.match(value) or _HASH.match(value):
        return False
    if " " in value or value.startswith(("http://", "https://", "./", "~/")) or re.fullmatch(r"(?:/[\w.\-]{1,24})+/?", value):
        return False
    return "EXAMPLE" not in value


def opaque(value: str) -> bool:
    """Whether a value of 16 characters or more looks drawn at random, whatever it is given to."""
    if _UUID.match(value) or _HASH.match(value) or not literal_secret(value) or re.fullmatch(r"[0-9a-fA-F]+", value):
        return False
    if _KNOWN.search(value) or (_VENDOR.fullmatch(value) and re.search(r"\d", value) and re.search(r"_.*[A-Z].*[a-z]|_.*[a-z].*[A-Z]", value)):
        return True
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", r"\d"))
    return len(value) >= 20 and classes == 3 and entropy(value) >= 3.6 and not re.fullmatch(r"(?:[A-Z]?[a-z]+[._\-/]?)+\d*", value) and value.count("/") + value.count(".") <= 3 and not value.endswith("=")


def code_like(value: str) -> bool:
    """A call, an index, an attribute or a plain word; not a random text that happens to have such a form."""
    random = len(value) >= 16 and all(re.search(p, value) for p in ("[a-z]", "[A-Z]", r"\d")) and "(" not in value
    return bool(_CODE.match(value)) and not random


def strong(value: str) -> bool:
    """Whether a value that stands alone, its name cut off, has the look of a password or token."""
    if not literal_secret(value) or len(value) < 7 or re.search(r"[\s\"'()<>{}\[\];,]", value) or code_like(value):
        return False
    if _KNOWN.search(value):
        return True
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", r"\d", r"[^\w]|_"))
    return bool(re.search("[A-Za-z]", value)) and (kinds >= 2 and bool(re.search(r"\d|[!@#$%^&*]", value)) or kinds >= 3 and len(value) >= 16)


def _b64(value: str) -> str | None:
    try:
        raw = base64.b64decode(value.replace("-", "+").replace("_", "/") + "=" * (-len(value) % 4), validate=True)
        text = raw.decode("ascii")
    except (binascii.Error, ValueError):
        return None
    return text if text.isprintable() else None


def spans(line: str, rules: list[str] | None = None) -> list[tuple[int, int]]:
    """(begin, end) of the secret values in a line, by the given rules or all."""
    found: list[tuple[int, int]] = []
    sample = bool(_SAMPLE_NOTE.search(line))

    def take(m: re.Match, group: int) -> None:
        found.append(m.span(group))

    for name in RULES if rules is None else rules:
        for m in _COMPILED[name].finditer(line):
            if name.startswith("token"):
                if literal_secret(m[1]) and not sample:
                    take(m, 1)
            elif name in ("quoted", "attribute", "element", "plain", "exported", "option", "connection"):
                key, group = {"quoted": (m[1], 3), "attribute": (m[2] if name == "attribute" else "", 4), "element": (m[1], 2), "connection": ("password", 1)}.get(name, (m[1], 2))
                value = m[group]
                if sample or not _is_name(key) or not literal_secret(value):
                    continue
                if name in ("plain", "exported", "option", "element", "connection") and code_like(value):
                    continue
                if name == "quoted" and (value.endswith("]") or re.search(r"\bdef |\bclass |\.value\.|\bshow\(", line)):
                    continue
                take(m, group)
            elif name in ("mysql", "curl", "url", "bearer", "login", "identified", "note"):
                if literal_secret(m[1]) and not sample and not (name in ("bearer", "note") and code_like(m[1])):
                    take(m, 1)
            elif name == "basic":
                text = _b64(m[1])
                if text and ":" in text and literal_secret(text.split(":", 1)[1]) and not sample:
                    take(m, 1)
            elif name == "decoded":
                if _is_name(m[1]) and not sample and len(m[2]) >= 4 and ((text := _b64(m[2])) is None or literal_secret(text)):
                    take(m, 2)
            elif name == "bytes":
                if _is_name(m[1]) and not sample:
                    take(m, 2)
            elif name == "pem":
                take(m, 1)
            elif name == "pieces":
                parts, end = [m.span(2), m.span(4)], m.end()
                while more := _NEXT_PIECE.match(line, end):
                    parts.append(more.span(2))
                    end = more.end()
                whole = "".join(line[b:e] for b, e in parts)
                hexed = re.fullmatch(r"[0-9a-f]{28,}|[0-9A-F]{28,}", whole)
                named = (n := re.match(rf"(?i)[^\w]*({_NAME})", line)) and _is_name(n[1])
                if sample or not literal_secret(whole) or _CONTEXT_NOT.search(line[: m.start()]):
                    continue
                if named and strong(whole) or hexed or _KNOWN.search(whole) or (len(whole) >= 14 and (opaque(whole) or _mixed(whole))):
                    found.extend(parts)
            elif name == "opaque" and not sample and not _CONTEXT_NOT.search(line[: m.start(2)]) and opaque(m[2]):
                take(m, 2)
    return sorted(set(found))


def _mixed(value: str) -> bool:
    """Letters of both cases and digits, turned over often."""
    turns = sum((a.isdigit(), a.isupper(), a.islower()) != (b.isdigit(), b.isupper(), b.islower()) for a, b in zip(value, value[1:], strict=False))
    return bool(re.search(r"\d", value) and re.search("[A-Z]", value) and re.search("[a-z]", value)) and turns >= len(value) // 3


def mask(line: str | None, match: str | None, rules: list[str] | None = None) -> tuple[str | None, str | None] | None:
    """Line and match with the secret values masked; None if neither holds one."""
    text, own = line or "", match or ""
    found = spans(text, rules)
    values = sorted({text[b:e] for b, e in found} | set(), key=len, reverse=True)
    if own and not found and len(text) >= CUT and own not in text and (strong(own) or spans(own, rules)):
        values = [own]
    if not found and not values and own and own not in text and (inner := spans(own, rules)):
        values = [own[b:e] for b, e in inner]
    if not values:
        return None
    out, last = [], 0
    for b, e in found:
        if b >= last:
            out += [text[last:b], MASK]
            last = e
        elif e > last:
            last = e
    masked = "".join(out) + text[last:]
    for v in values:
        if v in own:
            own = own.replace(v, MASK)
        elif len(own) >= 4 and own in v:
            own = MASK
    return (masked if line is not None else None), (own if match is not None else None)


# -- Spark ---------------------------------------------------------------------------------------------------------


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    asked = queries()
    keys = trigrams.wanted(asked)
    for batch in batches:
        lines, matches = batch.column(1), batch.column(2)
        block = trigrams.Block([lines, matches], keys)
        rules: dict[int, list[str]] = {}
        for name, query in asked.items():
            for row in block.candidates(query).tolist():
                rules.setdefault(row, []).append(name)
        # a match that lies beyond the cut has lost its name, and with it its trigrams: it is judged by its looks
        long_ = pc.greater_equal(pc.fill_null(pc.utf8_length(lines), 0), CUT)
        for row in pc.indices_nonzero(pc.and_(long_, pc.greater(pc.fill_null(pc.utf8_length(matches), 0), 0))).to_pylist():
            rules.setdefault(row, [])
        rows = []
        for row in sorted(rules):
            if hit := mask(lines[row].as_py(), matches[row].as_py(), rules[row]):
                rows.append((batch.column(0)[row].as_py(), *hit))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 3, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["id", "line", "match"])


def key_material(lines: DataFrame) -> DataFrame:
    """(id, match) of lines inside private key blocks; input (id, file, file_id, number, line, match).

    A block whose both ends were delivered holds all base64 between them, however far they are apart. One of which only an end was holds full
    lines of base64 within the reach of a key. Markers are few; they are ordered per file, and block ranges are joined by buckets of line numbers.
    """
    found = F.regexp_extract("line", _MARKER, 1)
    marks = lines.where(F.col("line").rlike(_MARKER)).select("file", "file_id", "number", found.alias("edge"), F.regexp_extract("line", _MARKER, 2).alias("kind")).distinct()
    # files of one name are told apart by their id, which also keeps a common name from being one group;
    # markers that were delivered without an id have only each other
    order = Window.partitionBy("file", "file_id").orderBy("number", F.col("edge").desc())
    reach = F.when(F.col("file_id").isNull(), BLIND_REACH).otherwise(OPEN_REACH)
    near = marks.select("*", F.lead("edge").over(order).alias("next_edge"), F.lead("number").over(order).alias("next"), F.lag("edge").over(order).alias("last_edge"), F.lag("number").over(order).alias("last"))
    private = near.where(F.col("kind").endswith("PRIVATE KEY"))
    whole = (F.col("next_edge") == "END") & (F.col("file_id").isNotNull() | (F.col("next") <= F.col("number") + reach))
    opened = private.where("edge = 'BEGIN'").select("file", "file_id", F.col("number").alias("low"), F.when(whole, F.col("next")).otherwise(F.least(F.coalesce("next", F.col("number") + reach), F.col("number") + reach)).alias("high"), F.coalesce(whole, F.lit(False)).alias("whole"))
    closed = private.where("edge = 'END' and (last_edge is null or last_edge = 'END')").select("file", "file_id", F.greatest(F.coalesce("last", F.col("number") - reach), F.col("number") - reach).alias("low"), F.col("number").alias("high"), F.lit(False).alias("whole"))
    blocks = opened.unionByName(closed)
    body = lines.where(F.col("line").rlike(_ANY_BODY)).withColumn("full", F.col("line").rlike(_BODY))
    # lines and blocks of known files meet by file, id and bucket
    known = blocks.where("file_id is not null").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / BUCKET), F.floor(F.col("high") / BUCKET))))
    inside = (F.col("number") > F.col("low")) & (F.col("number") < F.col("high")) & (F.col("full") | F.col("whole"))
    own = body.where("file_id is not null").withColumn("bucket", F.floor(F.col("number") / BUCKET)).join(known, ["file", "file_id", "bucket"]).where(inside)
    # where either has no id, a line meets the line numbers that blocks of its file name cover, each once however many blocks there are
    near_ = F.sequence(F.greatest(F.col("low"), F.col("high") - OPEN_REACH) + 1, F.least(F.col("high"), F.col("low") + OPEN_REACH) - 1)
    short = blocks.where("high > low + 1").select("file", "file_id", F.explode(F.when(F.col("high") - F.col("low") <= OPEN_REACH, F.sequence(F.col("low") + 1, F.col("high") - 1)).otherwise(near_)).alias("number"))
    full = body.where("full")
    blind = full.where("file_id is null").join(short.select("file", "number").distinct(), ["file", "number"])
    unnamed = full.where("file_id is not null").join(short.where("file_id is null").select("file", "number").distinct(), ["file", "number"])
    return own.select("id", "match").unionByName(blind.select("id", "match")).unionByName(unnamed.select("id", "match")).distinct()


def exposed(hits: DataFrame, key: str = "hit_id", file: str = "file_name", file_id: str = "file_id", number: str = "search_linenum", line: str = "search_line", match: str = "search_match") -> DataFrame:
    """(``key``, ``line``, ``match``): the rows that hold a live credential, with only its value masked.

    Null lines and matches stay null and hold nothing; rows with a null key take no part. Repeated deliveries of a key give
    one row. A row without a file name can still hold a credential, but not be part of a key block.
    """
    rows = hits.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(file).alias("file"), F.col(file_id).cast("long").alias("file_id"), F.col(number).cast("long").alias("number"), F.col(line).alias("line"), F.col(match).alias("match"))
    found = rows.select("id", "line", "match").mapInArrow(_search, "id long, line string, match string")
    hidden = F.when(F.length("match") > 0, F.lit(MASK)).otherwise(F.col("match"))
    material = key_material(rows).select("id", F.lit(MASK).alias("line"), hidden.alias("match"))
    checked = found.unionByName(material)
    return checked.groupBy("id").agg(F.min_by(F.struct("line", "match"), F.coalesce("line", F.lit(""))).alias("m")).select(F.col("id").alias(key), F.col("m.line").alias(line), F.col("m.match").alias(match))
