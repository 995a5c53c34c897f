"""Packing token sequences: bounded-space online best-fit.

Documents become token ids; only those longer than a sequence are cut.  Pieces are
dealt to groups by hash, each of some thousand sequences, so groups are even
whatever the input looks like.  In a group pieces arrive one by one.  The open bins
are kept by free space, and a bitset has a bit for each free space that occurs: the
best fit is the lowest bit at or above the piece's length, found by one shift.  If
nothing fits, a bin is opened; beyond ``open_bins`` the fullest open bin closes.

A tokenizer cuts at white space, so the ids of a text are those of its chunks
between white space; each task remembers the chunks it has met, and the runs of
letters, digits or marks that they consist of.

Nulls and edge cases: a null or empty text is the closing id alone; repeated rows
are packed one by one; a null id is carried along; an empty table gives no rows.
Only the id and text columns are read.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, slices

CAPACITY = 4096
OPEN_BINS = 1024
#: Tokens dealt to one group: some thousand sequences.
GROUP_TOKENS = 4096 * CAPACITY
END_ID = 1
#: Chunks that a worker remembers.
REMEMBERED = 500_000
#: Chunks coded at a time.
CODED = 2_000

#: Letters that end in a mark once composed and lowered, as U+0130 does; it belongs to the marks that follow.
_OPEN = "".join(x for x in map(chr, range(sys.maxunicode + 1))
                if x.isalnum() and not unicodedata.normalize("NFC", x.lower())[-1].isalnum())
#: Marks at the end of a chunk, behind any other letter or digit: a token of their own wherever they stand.
_MARKS = re.compile(rf"(?<=[^\W_{_OPEN}])[.,;:!?]+(?=\s|$)")
_LAST = frozenset(".,;:!?")
#: Controls that splitting takes for white space and tokenizers do not.
_SEPARATORS = r"[\x1c-\x1f]"

_CODERS: dict[str, "Coder"] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Coder:
    """Ids of texts as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.runs: dict[str, bytes] = {}
        # The pattern by which the tokenizer itself cuts, if that is all it does before merging bytes.
        match json.loads(self.tokenizer.to_str()):
            case {"model": {"type": "BPE"}, "normalizer": {}, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
                    {"type": "Split", "pattern": {"Regex": str(pattern)}, "behavior": "Removed", "invert": True},
                    {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]}}:
                self.pattern = regex.compile(pattern)
            case _:
                self.pattern = None
        # Special tokens may hold white space or span it; texts with one, in any case, are coded whole.
        added = self.tokenizer.get_added_tokens_decoder()
        special = [t.content.encode().lower().decode() for t in added.values()]
        self.odd = "|".join([_SEPARATORS, *map(re.escape, special)])
        # A token cut out of the text as it stands parts chunks that are coded in one call.
        self.between = next(((i, t.content) for i, t in added.items() if t.special and not (
            t.normalized or t.lstrip or t.rstrip or t.single_word)), None)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def code(self, chunks: list[str]) -> list[bytes]:
        if self.between is None:
            return [self.whole(x) for x in chunks]
        token, content = self.between
        joined = self.tokenizer.encode_batch_fast([content.join(chunks)], add_special_tokens=False)[0]
        ids = np.array(joined.ids, "<u4")
        ends = [*(4 * np.flatnonzero(ids == token)).tolist(), 4 * len(ids)]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends[:-1])], ends, strict=True)]

    def learn(self, stems: set[str]) -> None:
        new = [x for x in stems if x not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {"": b""}
            new = list(stems)
        plain = [x for x in new if x.isascii()] if self.pattern else []
        # Where normalising changes nothing, a chunk's ids are those of the runs it is cut into.
        joined = "\0".join(plain)
        if plain and self.tokenizer.normalizer.normalize_str(joined) == joined:
            runs = [self.pattern.findall(x) for x in plain]
            if len(self.runs) > REMEMBERED:
                self.runs = {}
            self.meet({y for x in runs for y in x}, self.runs)
            get = self.runs.__getitem__
            self.known.update((x, b"".join(map(get, y))) for x, y in zip(plain, runs, strict=True))
            new = [x for x in new if not x.isascii()]
        self.meet(new, self.known)

    def meet(self, texts: Iterable[str], known: dict[str, bytes]) -> None:
        new = [x for x in texts if x not in known]
        for at in range(0, len(new), CODED):
            part = new[at:at + CODED]
            known.update(zip(part, self.code(part), strict=True))

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text.  Arrow cuts the texts and tells the chunks apart, so each
        distinct chunk is looked up once and its ids are copied by position."""
        # The tokenizer lowers A-Z itself; done before, fewer chunks differ.
        # A fresh array: the splitting below misreads slices that start inside their buffer.
        texts = pa.array(texts if isinstance(texts, list) else texts.to_pylist(), pa.large_string())
        low = pc.ascii_lower(pc.fill_null(texts, ""))
        odd = pc.match_substring_regex(low, self.odd)
        split = pc.utf8_split_whitespace(pc.if_else(odd, "", low))
        met = split.flatten().dictionary_encode()
        chunks = met.dictionary.to_numpy(zero_copy_only=False).tolist()
        # Marks are few, so chunks that end in some are put together of two.
        tails = {i: m[0] for i, x in enumerate(chunks) if x[-1:] in _LAST and (m := _MARKS.search(x))}
        for i, x in tails.items():
            chunks[i] = chunks[i][:-len(x)]
        self.learn({*chunks, *tails.values()})
        coded = list(map(self.known.__getitem__, chunks))
        for i, x in tails.items():
            coded[i] += self.known[x]
        length = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        ids = np.frombuffer(b"".join(coded), "<u4")
        chunk = met.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(length[chunk])])
        starts = (np.cumsum(length) - length)[chunk]
        raw = ids[np.repeat(starts - ends[:-1], length[chunk]) + np.arange(ends[-1])].tobytes()
        bounds = (4 * ends[split.offsets.to_numpy() - split.offsets[0].as_py()]).tolist()
        return [self.whole(texts[i].as_py()) if strange else raw[a:b] for i, (strange, a, b) in enumerate(
            zip(odd.to_pylist(), bounds[:-1], bounds[1:], strict=True))]


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked, the ids."""
    path = path or tokenizer_path()
    end, step = end_id.to_bytes(4, "little"), 4 * capacity

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in slices(batches, 1024):
            rows = []
            for i, ids in enumerate(code.encode(batch.column("text"))):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            i, k, start, length, crc, parts = list(zip(*rows, strict=True)) or [()] * 6
            columns = [batch.column("doc_id").take(pa.array(i, pa.int64())), pa.array(k, pa.int32()),
                       *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            if with_ids:
                columns.append(pa.array([memoryview(x).cast("I").tolist() for x in parts], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()),
              T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
              T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, T.StructType(fields))


def best_fit(lengths, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, in the order given."""
    by_free: dict[int, list[int]] = defaultdict(list)
    bits, n_open, n_bins, placed = 0, 0, 0, []
    for length in lengths:
        fits = bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            stack = by_free[free]
            b = stack.pop()
            if not stack:
                bits &= ~(1 << free)
        else:
            if n_open == open_bins:
                full = (bits & -bits).bit_length() - 1
                stack = by_free[full]
                stack.pop()
                if not stack:
                    bits &= ~(1 << full)
                n_open -= 1
            free, b = capacity, n_bins
            n_bins += 1
            n_open += 1
        placed.append((b, capacity - free))
        free -= length
        if free:
            by_free[free].append(b)
            bits |= 1 << free
        else:
            n_open -= 1
    return placed


def pack(cut: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
         group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """``cut`` (see ``pieces``) with ``sequence_id`` and ``offset``, the place in that sequence."""
    tokens = cut.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-tokens // group_tokens))
    # Rows that repeat differ in nothing, so any order among them is the same.
    dealt = cut.withColumn("deal", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "piece", "ids_crc32"))

    def fill(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("deal", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        at = best_fit(table["length"].to_pylist(), capacity, open_bins)
        first = key[0].as_py() << 32
        return table.drop_columns(["deal", "group"]) \
            .append_column("sequence_id", pa.array([first + b for b, _ in at], pa.int64())) \
            .append_column("offset", pa.array([o for _, o in at], pa.int64()))

    schema = T.StructType(cut.schema.fields + [T.StructField("sequence_id", T.LongType()),
                                               T.StructField("offset", T.LongType())])
    return dealt.withColumn("group", F.pmod(F.xxhash64("deal"), F.lit(groups)).cast("int")) \
        .groupBy("group").applyInArrow(fill, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                   capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Cut and packed documents, one row per piece; ids are computed once."""
    return pack(materialise(pieces(docs, id_col, text_col, path, capacity), "pieces"), capacity, open_bins)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the sequences themselves, from pieces that hold their ids.

    At most ``capacity`` ids come together in one row.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
