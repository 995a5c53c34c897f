"""Passages that occur more than once, found with a compressed FM-index per shard.

Two equal windows of words lie in the same shard by their content: the least hash of
the ``GRAM``-word runs inside a window (rightmost on ties) is the same for both, and
names the shard.  Neighbouring windows mostly share that run, so a document falls
into stretches of windows, each owned by one run:

1. Runs that own windows are counted over all documents; those that occur once
   cannot belong to a repeated window and go.
2. Equal stretches are counted by hash.  A stretch with copies is repeated throughout;
   where its run owns no other stretch, that settles the run.  Of the rest one of each
   is written in words, by one pass over the texts whatever its run, and sent to its shard.
3. A shard indexes its stretches and streams those without copies through the index: backward search
   over the wavelet matrix gives the matching statistics, and every window of full
   length that occurs twice is reported.
4. The reported windows go back to the documents, which drop the words they cover.

A run with more than ``most`` different stretches would burden one shard.  All places of
a window have the same run, so its windows need no index: they are counted by a hash of
128 bits, added up before they are shuffled, and those that occur twice go back to their
stretches.

Hashes compare runs and rows (64 and 96 bits), whole stretches (128 bits with the run's)
and the windows of crowded runs (128 bits); all other windows are compared by their words.

Nulls and edge cases: a null or blank text has no words and nothing is removed;
texts shorter than a window keep all; long texts are handled whole; rows that repeat
count as further occurrences, so their windows go; a null id is returned as it came;
an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, slices
from .fm_index import FMIndex, repeated_windows
from .minhash import _WORDS, _mixed

WINDOW, GRAM = 35, 10
#: Words that one shard indexes.
SHARD_WORDS = 1_000_000
#: Different stretches of one run that go to one shard.
MOST = 4096


#: Low bits that hold a place while least hashes are looked for.
_PLACE = np.uint64((1 << 28) - 1)


def _owners(runs: np.ndarray, inside: int) -> np.ndarray:
    """The place of the least of each ``inside`` neighbours, the rightmost on ties."""
    if len(runs) > int(_PLACE):
        raise ValueError("a text has more words than a place can hold")
    # Of equal hashes the later has the smaller value; minima of 1, 2, 4 ... neighbours, then two that overlap.
    least, width = (runs & ~_PLACE) | (_PLACE - np.arange(len(runs), dtype=np.uint64)), 1
    while 2 * width <= inside:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = inside - width
    least = np.minimum(least[:-rest], least[rest:]) if rest else least
    return (_PLACE - (least & _PLACE)).astype(np.int64)


def stretches(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(run hash, hash of all words, first window, windows) of each stretch of windows owned by one run."""
    n = len(words)
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    runs = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + len(runs)]
    runs = _mixed(runs)
    inside = window - gram + 1
    owner = _owners(runs, inside)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    count = np.diff(np.append(first, len(owner)))
    raw = hashes.tobytes()
    content = [xxhash.xxh3_64_intdigest(raw[8 * a:8 * (a + c + window - 1)]) for a, c in zip(first.tolist(), count.tolist(), strict=True)]
    return (runs[owner[first]].view(np.int64), np.array(content, np.uint64).view(np.int64), first.astype(np.int32),
            count.astype(np.int32))


def _split(column: pa.Array) -> list[list[bytes]]:
    return [x.encode().split() if x else [] for x in column.to_pylist()]


def _runs(window: int, gram: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [stretches(x, window, gram) for x in _split(batch.column("text"))]
            if not found:
                continue
            owner = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))
            run, content, first, n = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(run), pa.array(content), batch.column("key").take(owner), batch.column("check").take(owner),
                 pa.array(first), pa.array(n)], names=["run", "content", "key", "check", "first", "n"])
    return each


def _texts(window: int):
    """The words of the wanted stretches."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for words, own in zip(_split(batch.column("text")), batch.column("own").to_pylist(), strict=True):
                for x in own:
                    a, n = x["first"], x["n"]
                    rows.append((x["run"], x["content"], b" ".join(words[a:a + n + window - 1]).decode(), x["copies"], x["crowded"]))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)],
                                             names=["run", "content", "words", "copies", "crowded"])
    return each


def _windows(window: int, places: bool):
    """The windows of stretches one by one, by hash, with their copies or their places."""
    names = ["low", "high", *(["run", "content", "at"] if places else ["copies"])]
    kinds = [pa.int64()] * 4 + [pa.int32()] if places else [pa.int64()] * 3

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for x in batch.to_pylist():
                words = x["words"].encode().split()
                for at in range(len(words) - window + 1):
                    pair = struct.unpack("<qq", xxhash.xxh3_128_digest(b" ".join(words[at:at + window])))
                    rows.append((*pair, x["run"], x["content"], at) if places else (*pair, x["copies"]))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)
    return each


def _search(window: int):
    def search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids: dict[str, int] = {}
        # 0 ends the text, 1 stands between stretches.
        flat, begin, end = [], [], []
        # Stretches with copies are known to repeat: they are searched in, not searched for.
        asked = table.filter(pc.equal(table["copies"], 1))
        for part, copied in ((asked, False), (table.filter(pc.greater(table["copies"], 1)), True)):
            for text in part["words"].to_pylist():
                if not copied:
                    begin.append(len(flat))
                flat += [ids.setdefault(x, len(ids) + 2) for x in text.split(" ")]
                if not copied:
                    end.append(len(flat))
                flat.append(1)
        if not begin:
            return pa.table([asked["run"], asked["content"], pa.array([], pa.int64())], names=["run", "content", "mask"])
        flat.append(0)
        text, begin, end = np.array(flat, np.int64), np.array(begin), np.array(end)
        found = repeated_windows(FMIndex(text), text, begin, end, window)
        masks = [sum(1 << int(i) for i in np.flatnonzero(found[a:b - window + 1])) for a, b in zip(begin, end, strict=True)]
        return pa.table([asked["run"], asked["content"], pa.array(masks, pa.int64())], names=["run", "content", "mask"])
    return search


def _kept(window: int, names: list[str], text_col: str):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            total, removed, texts = [], [], []
            # The text is read off the row, so the join before sends it once.
            text = batch.column("row").field(text_col)
            for words, own in zip(_split(text), batch.column("own").to_pylist(), strict=True):
                change = np.zeros(len(words) + 1, np.int64)
                for x in own or ():
                    mask, at = x["mask"], x["first"]
                    while mask:
                        low = (mask & -mask).bit_length() - 1
                        change[at + low] += 1
                        change[at + low + window] -= 1
                        mask &= mask - 1
                stays = np.cumsum(change)[:-1] == 0
                total.append(len(words))
                removed.append(len(words) - int(stays.sum()))
                texts.append(b" ".join(words if stays.all() else [words[i] for i in np.flatnonzero(stays)]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(texts, pa.string())], names=names)
    return each


def _cleaned(docs: DataFrame, text_col: str, window: int, gram: int, shard_words: int, most: int) -> DataFrame:
    """(row, n_words, n_removed, kept_text); ``row`` holds the columns of ``docs``."""
    if not 0 <= window - gram < 60:
        raise ValueError("a stretch's windows must fit the bits of a long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    whole = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    ids = [F.col(f"row.`{f.name}`").cast("long") if f.dataType.typeName() in ("long", "integer") else
           F.xxhash64(F.when(F.col(f"row.`{f.name}`").isNotNull(), F.col(f"row.`{f.name}`").cast("string")))
           for f in docs.schema.fields if f.name == "doc_id"]
    # Rows are told apart by id and text; rows alike in both are alike in all that matters here.
    keyed = rows.select("row", whole.alias("text"), F.coalesce(*ids, F.xxhash64(whole)).alias("key"),
                        F.crc32(whole.cast("binary")).alias("check"))
    texts = keyed.select("key", "check", "text")

    runs = materialise(texts.mapInArrow(_runs(window, gram), "run long, content long, key long, check long, first int, n int"),
                       "stretches")
    # What is counted by a key is written before the join by that key: adaptive execution splits a frequent key
    # only in a join of two shuffles.
    often = materialise(runs.groupBy("run").agg(F.count("*").alias("times")).filter("times > 1").select("run"), "often")
    # The same plan at every size: the runs are not broadcast while they are few.
    candidates = materialise(runs.join(often.hint("merge"), "run"), "runs")

    contents = materialise(candidates.groupBy("run", "content").agg(
        F.count("*").alias("copies"), F.min(F.struct("key", "check", "first", "n")).alias("x"))
        .select("run", "content", "copies", "x.*"), "contents")
    mixed = materialise(contents.groupBy("run").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "mixed-runs")
    asked = materialise(contents.join(mixed, "run").withColumn("crowded", F.col("kinds") > most).drop("kinds"), "asked")
    size, any_crowded = asked.agg(F.sum(F.when(~F.col("crowded"), F.col("n") + window)), F.max("crowded")).first()
    shards = max(1, -(-(size or 0) // shard_words))

    # Stretches of one text: as many as it is long.
    own = asked.groupBy("key", "check").agg(F.collect_list(F.struct("first", "n", "run", "content", "copies", "crowded")).alias("own"))
    # Rows that repeat an id and text send their stretches once.
    worded = materialise(
        texts.join(own, ["key", "check"]).groupBy("key", "check").agg(F.first("text").alias("text"), F.first("own").alias("own"))
        .select("text", "own").mapInArrow(_texts(window), "run long, content long, words string, copies long, crowded boolean"),
        "words")

    copied = contents.filter("copies > 1").select("run", "content", F.expr("shiftleft(1L, n) - 1").alias("mask"))
    verdict = worded.filter("NOT crowded").drop("crowded") \
        .withColumn("shard", F.pmod(F.xxhash64("run"), F.lit(shards)).cast("int")).groupBy("shard") \
        .applyInArrow(_search(window), "run long, content long, mask long").filter("mask <> 0")
    verdict = verdict.unionByName(copied)
    if any_crowded:
        wide = worded.filter("crowded")
        often = materialise(
            wide.mapInArrow(_windows(window, False), "low long, high long, copies long")
            .groupBy("low", "high").agg(F.sum("copies").alias("copies")).filter("copies > 1").select("low", "high"),
            "often-windows")
        places = wide.mapInArrow(_windows(window, True), "low long, high long, run long, content long, at int")
        found = places.join(often, ["low", "high"], "left_semi").select("run", "content", F.expr("shiftleft(1L, at)").alias("mask"))
        verdict = verdict.unionByName(found)
    verdict = materialise(verdict.groupBy("run", "content").agg(F.bit_or("mask").alias("mask")), "verdict")

    marks = candidates.select("key", "check", "first", "run", "content").join(verdict, ["run", "content"]) \
        .groupBy("key", "check").agg(F.collect_set(F.struct("first", "mask")).alias("own"))
    names = ["row", "n_words", "n_removed", "kept_text"]
    kinds = [keyed.schema["row"].dataType, T.LongType(), T.LongType(), T.StringType()]
    return keyed.join(marks, ["key", "check"], "left").select("row", "own").mapInArrow(
        _kept(window, names, text_col), T.StructType([T.StructField(n, t) for n, t in zip(names, kinds, strict=True)]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   gram: int = GRAM, shard_words: int = SHARD_WORDS, most: int = MOST) -> DataFrame:
    """One row per document: its words, how many of them repeated windows cover, and the rest joined by one space."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _cleaned(docs, "text", window, gram, shard_words, most) \
        .select("row.doc_id", "n_words", "n_removed", "kept_text")


def strip_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated passages taken out; documents of which no word is left go, all others stay.

    Texts without a repeat are unchanged to the letter; ``n_chars``, if there, is counted anew for the others.
    """
    cleaned = _cleaned(docs, text_col, window, gram, SHARD_WORDS, MOST).filter("n_removed = 0 OR n_removed < n_words")
    changed = F.col("n_removed") > 0
    out = []
    for field in docs.schema.fields:
        old = F.col(f"row.`{field.name}`")
        if field.name == text_col:
            old = F.when(changed, F.col("kept_text")).otherwise(old)
        elif field.name == "n_chars":
            old = F.when(changed, F.length("kept_text").cast(field.dataType)).otherwise(old)
        out.append(old.alias(field.name))
    return cleaned.select(*out)
