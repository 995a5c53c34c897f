"""Phrase collocations by Toivonen mining.

A phrase of 2 to ``MOST_WORDS`` words can only be frequent if the two phrases it has with
one word less, in front and behind, are.  Mining level by level would read the texts once
a length; Toivonen's method reads them once in the usual case:

1. **Sample.**  One in ``SAMPLE`` documents, picked by hash, is mined with half the
   threshold its share would ask for.  What is frequent there is proposed.
2. **Full pass.**  Over all documents every word is counted, and every phrase both of
   whose shorter phrases are proposed: the proposed ones and their *negative border*.
   They are counted by 64-bit fingerprint, 16 bytes a phrase; a count can only be too
   high by that, where two fingerprints meet.
3. **Expansion.**  A frequent phrase of the border that was not proposed is a failure of
   the sample: longer phrases around it were not counted.  A second pass over all
   documents counts the phrases that failures bring in, and those that these bring in at
   every further length, frequent or not, so that the set is closed after it: a phrase
   without a count has a shorter one that was counted and is not frequent.  The same pass
   counts the frequent phrases of the full pass again, now by their words.  What is
   found is exactly what is frequent, whatever the sample held.

Proposals are held as a Bloom filter of ``FILTER_BITS`` bits, a bound that does not grow
with the data, so it may be broadcast.  A phrase it holds by mistake is counted like any
other; a filter too small costs time, never a result.

Scale.  Texts are read in chunks of some MB; words and phrases are numbered and counted
in arrays there, so that what leaves a task are counts, added up before the shuffle.
Proposals of the sample leave it as 64-bit hashes only.  Where a row looks up a count,
the total of its language or its rank, rows are dealt by key and salt, or by ranges of
the order: a language or a word may hold any share of them.

Defined cases.  Null text is empty, null language is ``und``.  Words that contain other
white space than blanks and tabs keep it.  Rows that repeat count as often as they stand
there.  Texts of any length are read whole.  Only the named columns are read, so others
cannot clash.  A language without a candidate, and an empty table, have no rows.  Ties in
score and count go by the bytes of the phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scan import numbered
from .common import look_up, materialise

MOST_WORDS = 5
LEAST = 100
TOP = 2000
SAMPLE = 8
FILTER_BITS = 1 << 26
CHUNK_BYTES = 2 << 20

_WORDS = FILTER_BITS // 64
_SHIFT = 64 - (_WORDS.bit_length() - 1)


# ----------------------------------------------------------------- filter

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter holds: three bits of the 64 that the hash's first bits pick."""
    one, low = np.uint64(1), np.uint64(63)
    mask = (one << (hashes & low)) | (one << ((hashes >> np.uint64(6)) & low)) | (one << ((hashes >> np.uint64(12)) & low))
    return (bits[(hashes >> np.uint64(_SHIFT)).astype(np.int64)] & mask) == mask


def _with(bits: np.ndarray, hashes: DataFrame) -> np.ndarray:
    """The filter with the column ``h`` added; at most one row for each 64 bits of it comes back."""
    mask = "shiftleft(1L, cast(h & 63 AS INT)) | shiftleft(1L, cast(shiftrightunsigned(h, 6) & 63 AS INT)) | " \
           "shiftleft(1L, cast(shiftrightunsigned(h, 12) & 63 AS INT))"
    found = hashes.groupBy(F.expr(f"cast(shiftrightunsigned(h, {_SHIFT}) AS INT)").alias("at")) \
        .agg(F.bit_or(F.expr(mask)).alias("mask")).toArrow()
    out = bits.copy()
    at = found.column("at").to_numpy()
    out[at] |= found.column("mask").to_numpy().view(np.uint64)
    return out


# ------------------------------------------------------------------ chunks

WORD, BLANK, MARK = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = BLANK
KIND[list(b".,;:!?\n\x0b\x0c\r")] = MARK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_SEEDS = _mixed(np.arange(1, 257 + 4096, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_OF_BYTE, _OF_PLACE = _SEEDS[:256], _SEEDS[256:] | np.uint64(1)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts without nulls, one behind another, and where each ends."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0]:at[-1]], at[1:] - at[0]


def _hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash a word: its bytes weighted by where they stand."""
    if not len(words):
        return np.zeros(0, np.uint64)
    data, ends = _bytes(words)
    starts = np.concatenate(([0], ends[:-1]))
    sizes = ends - starts
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_OF_BYTE[data] * _OF_PLACE[place & (len(_OF_PLACE) - 1)] + place.astype(np.uint64))))
    return _mixed(sums[starts + sizes] - sums[starts] + sizes.astype(np.uint64))


class Chunk:
    """The words of some texts as numbers, with what phrases need to be named and hashed."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        data, ends = _bytes(texts)
        kind, starts_text = KIND[data], np.zeros(len(data) + 1, bool)
        starts_text[0] = True
        starts_text[ends] = True
        inside = kind == WORD
        before = np.concatenate(([False], inside[:-1])) & ~starts_text[:-1] if len(data) else inside
        start = np.flatnonzero(inside & ~before)
        # A word ends where the next character is none, or is another text's.
        end = np.flatnonzero(inside & ~(np.concatenate((inside[1:], [False])) & ~starts_text[1:])) + 1 if len(data) else start
        offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
        letters = LOWER[data[inside]]
        coded = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        of_text = np.searchsorted(ends, start, "right")
        # Pieces are parted by their marks and by the texts.
        self.piece = np.cumsum(kind == MARK)[start] + of_text if len(start) else start
        spoken = langs.dictionary_encode()
        self.langs, self.lang = spoken.dictionary, spoken.indices.to_numpy().astype(np.int64)[of_text]
        self.base = max(len(self.words), 1)
        # A word is told apart by its language too.
        self.id = self.lang * self.base + self.code
        self.kinds = max(len(self.langs) * self.base, 1)
        self.hash = _mixed(_hashes(self.words)[self.code] + _hashes(self.langs)[self.lang] * np.uint64(0x9E3779B97F4A7C15))

    def longer(self, m: int, ids: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and hashes of the phrases of ``m`` words at ``at``, from those of one word less."""
        last = at + m - 1
        key = ids[at] * self.kinds + self.id[last]
        return key, _mixed(hashes[at] * np.uint64(0xD6E8FEB86659FD93) + self.hash[last])

    def whole(self, m: int, at: np.ndarray) -> np.ndarray:
        at = at[at + m <= len(self.piece)]
        return at[self.piece[at] == self.piece[at + m - 1]]

    def phrases(self, at: np.ndarray, m: int) -> tuple[pa.Array, pa.Array]:
        parts = [self.words.take(pa.array(self.code[at + j])) for j in range(m)]
        text = parts[0] if m == 1 else pc.binary_join_element_wise(*parts, " ")
        return self.langs.take(pa.array(self.lang[at])), text


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Chunks of about ``CHUNK_BYTES`` of text; a longer text is a chunk of its own."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(int(np.searchsorted(ends, before + CHUNK_BYTES, "right")), at + 1)
            part = batch.slice(at, to - at)
            yield Chunk(part.column("text"), part.column("lang"))
            at = to


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key's number, and for each number how often it stands there and where first."""
    number, distinct = pd.factorize(keys)
    first = np.empty(len(distinct), np.int64)
    first[number[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return number, np.bincount(number, minlength=len(distinct)), first


class Levels:
    """The phrases of a chunk, one length after another: where they stand, their numbers and their hashes."""

    def __init__(self, chunk: Chunk) -> None:
        self.chunk, self.m, size = chunk, 1, len(chunk.id)
        self.at, self.ids, self.hashes = np.arange(size), chunk.id, chunk.hash

    def flags(self, at: np.ndarray) -> np.ndarray:
        """Whether a phrase of this length that is among ``at`` begins at a word."""
        out = np.zeros(len(self.chunk.id) + 1, bool)
        out[at] = True
        return out

    def longer(self, inside: np.ndarray) -> None:
        """On to the phrases both of whose shorter ones are ``inside``."""
        self.m += 1
        at = self.chunk.whole(self.m, self.at)
        self.at = at[inside[at] & inside[at + 1]]
        key, value = self.chunk.longer(self.m, self.ids, self.hashes, self.at)
        size = len(self.chunk.id)
        self.ids, self.hashes = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        self.ids[self.at], self.hashes[self.at] = pd.factorize(key)[0], value

    def counted(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, n, first = _counted(self.ids[at])
        return at[first], n.astype(np.int64)


def _sampled(batches: Iterator[pa.RecordBatch], lengths: range, proposed) -> Iterator[pa.RecordBatch]:
    """Fingerprints and counts of phrases of the sample: words and pairs, or longer phrases all of whose pairs are proposed."""
    for chunk in _chunks(batches):
        level = Levels(chunk)
        while level.m <= max(lengths) and len(level.at):
            if level.m in lengths:
                where, n = level.counted(level.at)
                yield pa.RecordBatch.from_pydict({"h": level.hashes[where].view(np.int64), "n": n})
            at = level.at
            if level.m == 2 and proposed is not None:
                at = at[_holds(proposed.value, level.hashes[at])]
            level.longer(level.flags(at))


def _full(batches: Iterator[pa.RecordBatch], proposed) -> Iterator[pa.RecordBatch]:
    """Fingerprints and counts of all words and of the phrases whose two shorter ones are proposed."""
    for chunk in _chunks(batches):
        level = Levels(chunk)
        while level.m <= MOST_WORDS and len(level.at):
            where, n = level.counted(level.at)
            yield pa.RecordBatch.from_pydict({"h": level.hashes[where].view(np.int64), "n": n})
            level.longer(level.flags(level.at[_holds(proposed.value, level.hashes[level.at])]))


def _named(batches: Iterator[pa.RecordBatch], proposed, frequent) -> Iterator[pa.RecordBatch]:
    """Words and counts of the ``frequent`` phrases, and of all that the full pass left out by what was ``proposed``
    though both shorter ones are frequent or left out themselves; and how many words each language has (length 0)."""
    for chunk in _chunks(batches):
        if not len(chunk.id):
            continue
        n = np.bincount(chunk.lang, minlength=len(chunk.langs)).astype(np.int64)
        yield _rows(chunk.langs, pa.array([""] * len(n)), 0, n)
        level, left_out = Levels(chunk), np.zeros(len(chunk.id), bool)
        while level.m <= MOST_WORDS and len(level.at):
            at = level.at
            held = _holds(frequent.value, level.hashes[at]) | left_out
            if held.any():
                where, n = level.counted(at[held])
                yield _rows(*chunk.phrases(where, level.m), level.m, n)
            was = level.flags(at[_holds(proposed.value, level.hashes[at])])
            level.longer(level.flags(at[held]))
            left_out = ~(was[level.at] & was[level.at + 1])


def _rows(lang: pa.Array, text: pa.Array, m: int, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"lang": lang, "phrase": text, "m": pa.array(np.full(len(n), m, np.int32)), "a": n})


# ------------------------------------------------------------------ passes

def frequent_phrases(docs: DataFrame, least: int = LEAST, sample: int = SAMPLE, sample_by: tuple[str, ...] = ("text",)) -> DataFrame:
    """``lang, phrase, m, a``: every phrase of up to ``MOST_WORDS`` words that stands ``least`` times in its language,
    and one row of length 0 a language with the number of its words.  ``sample_by`` names the columns that pick the sample."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    picked = docs.filter(F.pmod(F.xxhash64(*sample_by), F.lit(sample)) == 0).select(
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    share = max(2, least // sample // 2)

    bits = np.zeros(_WORDS, np.uint64)
    for lengths in (range(1, 3), range(3, MOST_WORDS + 1)):
        held = context.broadcast(bits) if lengths[0] > 1 else None
        mined = picked.mapInArrow(lambda b, r=lengths, k=held: _sampled(b, r, k), "h long, n long")
        bits = _with(bits, mined.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= share))

    proposed = context.broadcast(bits)
    counts = texts.mapInArrow(lambda b: _full(b, proposed), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    frequent = context.broadcast(_with(np.zeros(_WORDS, np.uint64), counts.filter(F.col("n") >= least)))
    named = texts.mapInArrow(lambda b: _named(b, proposed, frequent), "lang string, phrase string, m int, a long")
    return named.groupBy("lang", "phrase").agg(F.max("m").alias("m"), F.sum("a").alias("a")) \
        .filter((F.col("a") >= least) | (F.col("m") == 0))


def _words_of(phrase: str, n: str) -> Column:
    """The first ``n`` words of a phrase, or the last ``-n``."""
    return F.expr(f"substring_index({phrase}, ' ', {n})")


def collocations(frequent: DataFrame, top: int = TOP, cover: int = 100) -> DataFrame:
    """The ``top`` phrases of each language by their weakest cut: ``lang, rank, phrase, a, l, r, n, score``.

    ``frequent`` is a written result of ``frequent_phrases``.  A phrase goes where a longer one that
    contains it stands ``cover`` percent as often; it is enough to look one word further, since a
    phrase stands at least as often as any around it.
    """
    counts = frequent.filter("m > 0").select("lang", "phrase", "a")
    candidates = frequent.filter("m > 1")
    parts = F.array(_words_of("phrase", "m - 1"), _words_of("phrase", "1 - m"))
    around = frequent.filter("m > 2").select("lang", F.explode(parts).alias("phrase"), F.col("a").alias("longer")) \
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    own = candidates.join(around, ["lang", "phrase"], "left") \
        .filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover)).drop("longer")
    cuts = own.withColumn("k", F.explode(F.expr("sequence(1, m - 1)"))) \
        .withColumns({"left": _words_of("phrase", "k"), "right": _words_of("phrase", "k - m")})
    spread = ["phrase", "k"]
    cuts = look_up(cuts, ["lang", "left"], spread, counts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")))
    cuts = look_up(cuts, ["lang", "right"], spread, counts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")))
    cuts = materialise(cuts, "cuts")
    totals = frequent.filter("m = 0").select("lang", F.col("a").alias("n"))
    cuts = look_up(cuts, ["lang"], spread, totals)
    # Whole numbers of up to 38 digits: the product may pass 64 bits.
    exact = "(CAST(a AS DECIMAL(18,0)) * CAST(n AS DECIMAL(18,0)) * 1000BD) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))"
    scored = cuts.withColumn("score", F.expr(exact)).groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), F.max("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("weakest"))
    listed = materialise(scored.select("lang", "phrase", "a", "weakest.l", "weakest.r", "n", "weakest.score"), "collocations")
    ranked = numbered(listed, ["lang"], [-F.col("score"), -F.col("a"), "phrase"], "rank")
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, sample_by: tuple[str, ...] = ("text",)) -> DataFrame:
    """Collocations of the documents of each language."""
    return collocations(materialise(frequent_phrases(docs, least, sample_by=sample_by), "frequent"), top)


def oracle(least: int = LEAST, top: int = TOP) -> str:
    """The same phrases in DuckDB SQL, by counting every phrase."""
    return f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
ws AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM ws),
grams AS (SELECT lang, w, i, unnest(range(1, least({MOST_WORDS}, len(w) - i + 1) + 1)) AS m FROM starts),
f AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m, count(*) AS a FROM grams GROUP BY ALL),
ns AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE m > 1 AND a >= {least}),
cw AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS w FROM c),
sub AS (SELECT lang, unnest([array_to_string(w[:m - 1], ' '), array_to_string(w[2:], ' ')]) AS phrase, a FROM cw WHERE m > 2),
gone AS (SELECT lang, phrase, max(a) AS longer FROM sub GROUP BY 1, 2),
kept AS (SELECT cw.* FROM cw LEFT JOIN gone USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * cw.a),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM kept),
parts AS (SELECT cuts.*, fl.a AS l, fr.a AS r, ns.n,
  (1000::HUGEINT * cuts.a * ns.n) // (fl.a::HUGEINT * fr.a) AS score FROM cuts JOIN ns USING (lang)
  JOIN f fl ON fl.lang = cuts.lang AND fl.phrase = array_to_string(w[:k], ' ')
  JOIN f fr ON fr.lang = cuts.lang AND fr.phrase = array_to_string(w[k + 1:], ' ')),
weakest AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= {top}"""
