"""Secrets in texts: fixed patterns, and literals judged by the names they are given to.

The patterns find credentials by shape.  The lexer reads assignments of source and
configuration syntax (``name = "literal"``, ``name: literal``, ``"name": "literal"``,
``export NAME=literal``, ``name: type = literal``, ``var name type = literal``) into names
and literals, prefixed, raw and triple-quoted ones too, adds up joined literals, and
carries constants from name to name, in both directions of the text.  A literal is
reported if the score of the most sensitive name that it reaches, plus points for
looking random, attains ``LEAST_SCORE``.

Each text is scanned alone, so nothing is shuffled.  Documents are read in Arrow
batches.

Nulls and edge cases: a null or empty text has no spans; texts of any length are
scanned whole in one pass; a null id is returned as it came; repeated rows are
scanned one by one; an empty table gives no rows.  Only the id and text columns are
read by ``scan``; ``redact`` returns all columns and changes the text alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: The order of kinds that start at one place.
KINDS = {"assign": 0, "access": 1, "hex": 2, "literal": 3}
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Points of the words in a name.
SENSITIVE = {"password": 5, "passwd": 5, "passphrase": 5, "pwd": 4, "secret": 5, "token": 4, "apikey": 5, "credential": 5,
             "credentials": 5, "privatekey": 5, "accesskey": 5, "secretkey": 5, "auth": 3, "bearer": 4, "signature": 2,
             "session": 2, "cookie": 2, "salt": 2, "key": 2, "access": 1, "private": 2, "client": 1, "api": 1}
#: Words that say that a name holds something about a secret and not the secret itself.
HARMLESS = {"length", "len", "count", "size", "name", "type", "url", "uri", "path", "file", "field", "label", "min", "max",
            "expiry", "expires", "ttl", "policy", "regex", "pattern", "limit", "id", "header"}
LEAST_SCORE = 6.0
LEAST_LENGTH = 6
_DUMMIES = re.compile(r"(?i)^(?:x+|\*+|\.+|changeme|example|placeholder|none|null|true|false|undefined|todo|your.*|<.*>|\$\{.*\}|%\(?.*)$")

#: The type of a declaration: a name with its parameters, also a reference, an array, or several joined by ``|``.
_PLAIN_TYPE = r"""(?:[^\W\d]\w{0,63}(?:(?:\.|::)\w{1,63}){0,6}(?:[<\[][^\n=;"`(){}]{0,80}[>\]])?|\[[^\n="'`(){}]{0,40}\])[?!]?"""
_TYPE = rf"""[&*]{{0,2}}(?:'\w{{1,32}}\x20)?(?:(?:mut|const|dyn)\x20)?{_PLAIN_TYPE}(?:\x20?\|\x20?{_PLAIN_TYPE}){{0,4}}"""
#: What may stand before the opening quote of a literal: Python, C, C#, Rust and Scala have such letters.
_PREFIX = r"""(?:(?:[rRbBuUfFtT]{1,2}|u8R?|LR?|[uU]R|[sc]|raw|[@$]{1,2})(?=["'])|[bc]?r\#{0,3}(?="))?"""
_QUOTE = r"""\"{3}|'{3}|["'`]"""
#: One token of an assignment: a name, a type, an operator, a quoted or a bare literal.
_SITE = re.compile(
    rf"""(?:(?<![\w.-])(?P<var>var|const)[\x20\t]+)?"""
    r"""(?P<quote>["']?)(?P<name>[^\W\d][\w.-]{0,127})(?P=quote)(?:\[["']?(?P<part>\w{1,64})["']?\])?"""
    rf"""[\x20\t]*(?P<op>:[\x20\t]*(?P<type>{_TYPE})[\x20\t]*=(?![=>~])|:=|=>|[:=](?![=:/])"""
    rf"""|(?(var)(?<=[\x20\t])[*\[\]]{{0,4}}[^\W\d][\w.]{{0,63}}[\x20\t]*=(?![=>~])|(?!)))"""
    rf"""[\x20\t]*{_PREFIX}(?P<rest>{_QUOTE}|[^\W\d][\w.]*|[^\s"'`,;(){{}}\[\]]+)?""")
_JOIN = re.compile(rf"""[\x20\t]*\+[\x20\t]*(?:{_PREFIX}(?P<quote>{_QUOTE})|(?P<name>[^\W\d][\w.]*))""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_score(name: str) -> float:
    """How sensitive a name is, by its words in any spelling (camel case, dashes, dots)."""
    parts = [x.lower() for x in _WORD.findall(name)]
    pairs = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    points = max((SENSITIVE.get(x, 0) for x in parts + pairs), default=0)
    return points - 4 if parts and parts[-1] in HARMLESS else points


def literal_score(value: str) -> float:
    """Up to 4 points for length, mixed character classes and entropy; far below 0 for stand-ins."""
    if len(value) < LEAST_LENGTH or _DUMMIES.match(value):
        return -10.0
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    classes = sum(map(bool, (re.search("[a-z]", value), re.search("[A-Z]", value), re.search(r"\d", value),
                             re.search(r"[^\w\s]", value))))
    blanks = 2.0 if re.search(r"\s", value.strip()) else 0.0
    return min(1.0, len(value) / 16) + 0.5 * (classes - 1) + max(0.0, entropy - 2.0) * 0.75 - blanks


def _quoted(text: str, at: int, quote: str) -> int:
    """The end of the literal whose opening ``quote`` is at ``at``; -1 if the line ends first, or a long literal never."""
    i, n = at + len(quote), len(text)
    if len(quote) == 3 and text.find(quote, i) < 0:
        return -1
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if c == quote[0] and text.startswith(quote, i):
            return i
        if c == "\n" and len(quote) == 1 and quote != "`":
            return -1
        i += 1
    return -1


def assignments(text: str) -> list[tuple[str, list[tuple[int, int]], list[str]]]:
    """(name, literal spans, names it is made of) of each assignment, in order."""
    found, at = [], 0
    while m := _SITE.search(text, at):
        at = m.end()
        rest, name = m["rest"], m["part"] or m["name"]
        if not rest:
            continue
        spans: list[tuple[int, int]] = []
        names: list[str] = []
        begin = m.start("rest")
        kind = m["type"] or ""
        if len(kind) >= 8 and re.search(r"\d", kind) and re.fullmatch(r"\w+", kind):
            # It may be a value with a sign of equality behind it.
            found.append((name, [m.span("type")], []))
        if rest[0] in "\"'`":
            end = _quoted(text, begin, rest)
            if end < 0:
                # Three quotes that nothing closes: an empty literal and another quote.
                at = begin + (1 if len(rest) == 1 else 2)
                continue
            spans.append((begin + len(rest), end))
            at = end + len(rest)
        elif re.fullmatch(r"[^\W\d][\w.]*", rest) and m["op"] != ":":
            names.append(rest.rpartition(".")[2] or rest)
            # A bare word is a literal in configuration files.
            spans.append((begin, m.end("rest")))
            # What follows may belong to the word: api-key style values.
            more = re.compile(r"[^\s\"'`,;(){}\[\]]+").match(text, m.end("rest"))
            if more:
                names, spans, at = [], [(begin, more.end())], more.end()
        else:
            more = re.compile(r"[^\s\"'`,;(){}\[\]]+").match(text, m.end("rest"))
            end = more.end() if more else m.end("rest")
            spans.append((begin, end))
            at = end
        while j := _JOIN.match(text, at):
            if j["quote"]:
                end = _quoted(text, j.start("quote"), j["quote"])
                if end < 0:
                    break
                spans.append((j.end("quote"), end))
                at = end + len(j["quote"])
            else:
                names.append(j["name"].rpartition(".")[2] or j["name"])
                at = j.end()
        found.append((name, spans, names))
    return found


def sensitive_literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name."""
    sites = assignments(text)
    if not sites:
        return []
    # Points flow from a name to the names it is made of, until nothing changes.
    points: dict[str, float] = {}
    uses: dict[str, set[str]] = {}
    known = {name for name, _, _ in sites}
    for name, _, names in sites:
        points[name] = name_score(name)
        for x in names:
            if x in known and x != name:
                uses.setdefault(name, set()).add(x)
    work = list(uses)
    while work:
        name = work.pop()
        for x in uses.get(name, ()):
            if points[name] > points[x]:
                points[x] = points[name]
                work.append(x)
    out = set()
    for name, spans, names in sites:
        if points[name] <= 0:
            continue
        # A bare name that is a constant of this text is no literal itself.
        own = [s for s in spans if text[s[0]:s[1]].rpartition(".")[2] not in known or s[0] and text[s[0] - 1] in "\"'`"]
        value = "".join(text[a:b] for a, b in own)
        if value and points[name] + literal_score(value) >= LEAST_SCORE:
            out.update(own)
    return sorted(s for s in out if s[1] > s[0])


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind as listed; code points, end exclusive."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(x in low for x in _HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "=" in text or ":" in text:
        found += [(a, b, "literal") for a, b in sensitive_literals(text)]
    return sorted(found, key=lambda x: (x[0], KINDS[x[2]], x[1]))


def _joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and spans of what was found."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                found = spans(text)
                base = [x for x in found if x[2] != "literal"]
                n = Counter(x[2] for x in found)
                rows.append((n["assign"], n["access"], n["hex"], n["literal"],
                             hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in columns[:4]],
                 *[pa.array(x, pa.string()) for x in columns[4:]]], names=schema.names)

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind)] + [T.StructField(x, T.LongType()) for x in (
        "n_assign", "n_access", "n_hex", "n_literal")] + [T.StructField(x, T.StringType()) for x in ("base_sha256", "spans")])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, schema)


def redacted(text: str | None, mask: str = "[secret]") -> str | None:
    """The text with each stretch of overlapping spans replaced by ``mask``."""
    out, at = [], 0
    ends: list[list[int]] = []
    for a, b, _ in spans(text):
        if ends and a <= ends[-1][1]:
            ends[-1][1] = max(ends[-1][1], b)
        else:
            ends.append([a, b])
    for a, b in ends:
        out += [text[at:a], mask]
        at = b
    return text if not ends else "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with all secrets masked in the text; a column ``n_chars`` follows the text."""
    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return pd.Series([redacted(x, mask) if isinstance(x, str) else None for x in texts], dtype=object)

    out = docs.withColumn(text_col, masked(F.col(f"`{text_col}`")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new = F.length(F.col(f"`{text_col}`")).cast(kind)
        # Counted anew only where the text is; a null text keeps what it came with.
        out = out.withColumn("n_chars", F.coalesce(new, F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
