"""SentencePiece encoding and decoding: Aho-Corasick over the pieces, Viterbi in one pass.

The automaton reads a text once.  At each position it follows its output links, and
every piece that ends there relaxes the best score of a segmentation up to that
position.  A character that no piece covers costs a byte piece for each of its UTF-8
bytes.

Pieces hold the sign for a blank only at their front, so every best segmentation has a
cut before each run of blanks; a text is coded run by run and a worker remembers the
runs it has met.  If a vocabulary has a piece with a blank further in, texts are coded
whole.

A text that itself contains the sign for a blank has it spelled in bytes, so decoding
gives back every text exactly.

Nulls and edge cases: a null text has no ids and decodes to null; an empty text has no
ids and decodes to itself; texts of any length are coded whole; repeated rows are coded
one by one; a null id is returned as it came; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = "▁"
#: Runs that a worker remembers.
REMEMBERED = 100_000
#: Added for each character spelled in bytes, below the least score of a piece.
PENALTY = 10.0

_MODELS: dict[str, "Model"] = {}


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Model:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown = sp.unk_id()
        self.plain = {p: (i, sp.get_score(i)) for i, p in enumerate(self.pieces)
                      if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.automaton = ahocorasick.Automaton()
        for p, (i, score) in self.plain.items():
            self.automaton.add_word(p, (i, score, len(p)))
        self.automaton.make_automaton()
        self.least = min(score for _, score in self.plain.values()) - PENALTY
        self.whole = any(BLANK in p.lstrip(BLANK) for p in self.plain)
        self.known: dict[str, bytes] = {}

    def segment(self, run: str, literal: set[int] = frozenset()) -> list[int]:
        """Ids of the best segmentation; ``literal`` are places of signs that stand for themselves."""
        n = len(run)
        best, back = [0.0] + [-1e300] * n, [None] * (n + 1)
        settled = 0
        for end, (i, score, length) in self.automaton.iter(run):
            # Places behind this one get no better any more; what no piece reached is spelled.
            while settled < end:
                settled += 1
                if back[settled] is None:
                    self._spell(run, settled, best, back)
            total = best[end + 1 - length] + score
            if total > best[end + 1] and not (literal and any(k in literal for k in range(end + 1 - length, end + 1))):
                best[end + 1], back[end + 1] = total, (end + 1 - length, i)
        while settled < n:
            settled += 1
            if back[settled] is None:
                self._spell(run, settled, best, back)
        ids, at = [], n
        while at:
            start, i = back[at]
            if i is None:
                spelled = [self.byte_ids.get(b, self.unknown) for b in run[start:at].encode()]
                ids += spelled[::-1]
            else:
                ids.append(i)
            at = start
        return ids[::-1]

    def _spell(self, run: str, end: int, best: list, back: list) -> None:
        best[end] = best[end - 1] + self.least * len(run[end - 1].encode())
        back[end] = (end - 1, None)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit bytes."""
        if not text:
            return b""
        if BLANK in text:
            signs = {i + 1 for i, c in enumerate(text) if c == BLANK}
            return np.array(self.segment(BLANK + text.replace(" ", BLANK), signs), "<u4").tobytes()
        marked = BLANK + text.replace(" ", BLANK)
        runs = [marked] if self.whole else _RUNS.findall(marked)
        known, out = self.known, []
        for run in runs:
            ids = known.get(run)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = known[run] = np.array(self.segment(run), "<u4").tobytes()
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        out: list[str] = []
        spelled = bytearray()
        for i in np.frombuffer(ids, "<u4").tolist():
            b = self.byte_of.get(i)
            if b is not None:
                spelled.append(b)
                continue
            if spelled:
                out.append(spelled.decode("utf-8", "replace"))
                spelled = bytearray()
            out.append(self.pieces[i].replace(BLANK, " "))
        if spelled:
            out.append(spelled.decode("utf-8", "replace"))
        return "".join(out)[1:]


_RUNS = re.compile(f"{BLANK}+[^{BLANK}]*")


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids): the piece ids of each text; null for a null text."""
    path = path or model_path()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = model(path)
        for batch in batches:
            ids = [None if x is None else np.frombuffer(code.encode(x), "<u4").astype(np.int32)
                   for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))],
                                             names=["doc_id", "ids"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType),
                           T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, schema)


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    path = path or model_path()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = model(path)
        for batch in batches:
            texts = [None if x is None else code.decode(np.array(x, "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    schema = T.StructType([coded.schema["doc_id"], T.StructField("text", T.StringType())])
    return coded.select("doc_id", "ids").mapInArrow(each, schema)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: how many ids, how many of them bytes, their crc32, and whether decoding gives the text."""
    path = path or model_path()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = model(path)
        is_byte = np.zeros(len(code.pieces), bool)
        is_byte[list(code.byte_of)] = True
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                if text is None:
                    rows.append((0, 0, 0, None))
                    continue
                ids = code.encode(text)
                rows.append((len(ids) // 4, int(is_byte[np.frombuffer(ids, "<u4")].sum()), zlib.crc32(ids),
                             code.decode(ids) == text))
            n, spelled, crc, same = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n, spelled, crc)], pa.array(same, pa.bool_())],
                names=["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "decodes"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)] + [
        T.StructField(x, T.LongType()) for x in ("n_ids", "n_byte_ids", "ids_crc32")] + [T.StructField("decodes", T.BooleanType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, schema)
