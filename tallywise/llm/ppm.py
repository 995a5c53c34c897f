"""Scoring by prediction by partial matching: a trie of byte contexts with escapes.

The model predicts each byte of a text from the ``order`` bytes before it.  Where
the context has not been followed by that byte, it escapes to the next shorter
one; the escape is estimated by method C (as many escapes as the context has
distinct successors), and symbols already refused by a longer context are excluded
from the shorter one.  Below the empty context every remaining symbol is equally
likely.  Texts are read as UTF-8 with A-Z lower-cased; they start with ``order``
bytes 0xFF and end with 0xFE, neither of which UTF-8 contains, so the scores of
all texts form one distribution.

The trie is a table of grams (context and byte packed into one number), so it may
outgrow any machine:

1. Documents are dealt into blocks by hash.  Each block counts its distinct grams
   and tokens: far fewer rows than the text has positions.
2. Counts are summed per gram.  From the empty context up, each order is joined
   with the order below; windows run over the successors of one context, 256 at
   most.  A gram's cost includes all its escapes, as the excluded symbols depend on
   its context alone.
3. Each block gets the costs of its own grams and tokens and adds them up per text.

Nulls and edge cases: a null text is an empty one and still scores its end; a null
id is held out or not as crc32 of the empty string says; repeated rows are scored
one by one and count in training as often as they occur; an empty table gives no
rows.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialise

ORDER = 4
#: Symbols that can follow: the bytes of UTF-8 (no 0xFE, 0xFF) and the end.
SYMBOLS = 255
START, END = 0xFF, 0xFE
#: UTF-8 bytes of text dealt to one block.
BLOCK_BYTES = 16 << 20
LEAST_BLOCKS = 24
#: Positions packed at a time.
STEP = 1 << 21

BLOCK_SCHEMA = "block int, kind int, gram long, token string, n long"
SCORED = T.StructType([T.StructField(x, t) for x, t in (
    ("doc_id", T.LongType()), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()),
    ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("n_bytes", T.LongType()))])
_LN10 = float(np.log(10.0))


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _grams(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed grams of whole texts, a step at a time, with the index of each gram's text."""
    pad, held, size, first = bytes([START]) * order, [], 0, 0
    for i, text in enumerate(texts):
        held.append(text)
        size += len(text) + 1
        if size >= STEP or i == len(texts) - 1:
            flat = np.frombuffer(b"".join(pad + x + bytes([END]) for x in held), np.uint8)
            sizes = np.array([len(x) + 1 for x in held])
            owner = np.repeat(np.arange(first, first + len(held), dtype=np.int32), sizes)
            # Where each text's own bytes lie between the paddings.
            at = np.arange(len(owner)) + order * (owner - first + 1)
            for a in range(0, len(at), STEP):
                here = at[a:a + STEP]
                low = here[0] - order
                part = flat[low:here[-1] + 1].astype(np.int64)
                packed = np.zeros(len(part) - order, np.int64)
                for k in range(order + 1):
                    packed = (packed << 8) | part[k:k + len(packed)]
                yield packed[here - order - low], owner[a:a + STEP]
            held, size, first = [], 0, i + 1


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams = np.sort(grams)
    edge = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    return grams[edge], np.diff(np.append(edge, len(grams)))


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
    return keys, np.bincount(at, np.concatenate((a[1], b[1]))).astype(np.int64)


def _block_counts(order: int):
    none = (np.empty(0, np.int64), np.empty(0, np.int64))

    def count(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        held = frame["held_out"].to_numpy(bool)
        grams, tokens = none, Counter()
        for train in (True, False):
            texts = [x.encode().lower() for x in frame["text"][held != train]]
            for text in texts:
                words = text.split()
                tokens.update(words if train else dict.fromkeys(words, 0))
            for packed, _ in _grams(texts, order):
                found, n = _counted(packed)
                grams = _merged(grams, (found, n if train else np.zeros_like(n)))
        out = pd.DataFrame({"gram": np.concatenate((grams[0], np.zeros(len(tokens), np.int64))),
                            "token": [None] * len(grams[0]) + [x.decode() for x in tokens],
                            "n": np.concatenate((grams[1], np.fromiter(tokens.values(), np.int64, len(tokens))))})
        out["kind"] = (np.arange(len(out)) >= len(grams[0])).astype(np.int32)
        out["block"] = np.int32(key[0])
        return out[["block", "kind", "gram", "token", "n"]]

    return count


def costs(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, cost): log10 of the probability of each gram's last byte in its context.

    ``grams`` is (gram, n), distinct, n the count in training; 0 for grams that
    only need a cost.
    """
    levels = [grams]
    for k in range(order - 1, -1, -1):
        mask = (1 << 8 * (k + 1)) - 1
        low = levels[-1].groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.sum("n").alias("n"))
        levels.append(materialise(low, f"grams{k}"))
    log = lambda c: F.log(F.when(c > 0, c))
    lower = None
    for k, level in enumerate(reversed(levels)):
        context = Window.partitionBy(F.shiftright("gram", 8))
        if lower is None:
            # Below the empty context: one of the symbols that it has not refused.
            level = level.withColumns({"low_n": F.lit(0), "low_total": F.lit(0), "low_kinds": F.lit(0),
                                       "low_tail": F.lit(None).cast("double"), "low_cost": F.lit(None).cast("double")})
        else:
            mask = (1 << 8 * k) - 1
            level = level.withColumn("low", F.col("gram").bitwiseAND(F.lit(mask))) \
                .join(lower, "low").drop("low")
        seen = F.when(F.col("n") > 0, 1).otherwise(0)
        level = level.withColumns({"total": F.sum("n").over(context), "kinds": F.sum(seen).over(context),
                                   "refused": F.sum(seen * F.col("low_n")).over(context)})
        if lower is None:
            tail = -F.log(F.lit(float(SYMBOLS)) - F.col("kinds"))
            plain = F.lit(-float(np.log(SYMBOLS)))
        else:
            # What the shorter context has left after this one's successors are excluded.
            left_kinds = F.col("low_kinds") - F.col("kinds")
            room = F.col("low_total") - F.col("refused") + left_kinds
            tail = F.when(F.col("low_n") > 0, log(F.col("low_n")) - log(room)) \
                .when(left_kinds > 0, log(left_kinds) - log(room) + F.col("low_tail")) \
                .otherwise(F.col("low_tail"))
            plain = F.col("low_cost")
        level = level.withColumn("tail", tail)
        whole = F.col("total") + F.col("kinds")
        cost = F.when(F.col("total") == 0, plain) \
            .when(F.col("n") > 0, log(F.col("n")) - log(whole)) \
            .otherwise(log(F.col("kinds")) - log(whole) + F.col("tail"))
        level = level.withColumn("cost", cost)
        lower = level.select(F.col("gram").alias("low"), F.col("n").alias("low_n"), F.col("total").alias("low_total"),
                             F.col("kinds").alias("low_kinds"), F.col("tail").alias("low_tail"),
                             F.col("cost").alias("low_cost"))
    return level.select("gram", (F.col("cost") / _LN10).alias("cost"))


class _Lookup:
    """Costs of grams by open addressing over arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]
            placed = self.keys[at[left]] == keys[left]
            self.values[at[left[placed]]] = values[left[placed]]
            left = left[~placed]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = self.values[at]
        left = np.flatnonzero(self.keys[at] != keys)
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            hit = self.keys[at[left]] == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit]
        return out


def _block_scores(order: int, rest: float):
    """``rest``: log10 of the count and vocabulary that every token's share is divided by."""
    def score(docs: pa.Table, table: pa.Table) -> pa.Table:
        texts = [x.encode().lower() for x in docs["text"].to_pylist()]
        total = np.zeros(len(texts))
        grams = table.filter(pc.equal(table["kind"], 0))
        if texts:
            find = _Lookup(grams["gram"].to_numpy(), grams["cost"].to_numpy())
            for packed, owner in _grams(texts, order):
                total += np.bincount(owner, find(packed), len(texts))
        tokens = table.filter(pc.equal(table["kind"], 1))
        known = dict(zip((x.encode() for x in tokens["token"].to_pylist()), tokens["cost"].to_pylist(), strict=True))
        end = known.get(b"", 0.0)
        rows = []
        for text in texts:
            shares = [*map(known.__getitem__, text.split()), end]
            rows.append((len(shares), sum(map(bool, shares)), sum(shares) - rest * len(shares), len(text)))
        tokens, hits, base, sizes = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table([docs["doc_id"], docs["held_out"], pa.array(tokens, pa.int64()), pa.array(hits, pa.int64()),
                         pa.array(base, pa.float64()), pa.array(total), pa.array(sizes, pa.int64())], names=SCORED.names)

    return score


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: the base score by token counts and the trie's ``score``, log10 of the text.

    Documents whose id is held out take no part in training.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"))
    size, trained = docs.agg(F.sum(F.octet_length("text")), F.count(F.when(~F.col("held_out"), 1))).first()
    blocks = max(LEAST_BLOCKS, -(-(size or 0) // block_bytes))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    counts = materialise(docs.groupBy("block").applyInPandas(_block_counts(order), BLOCK_SCHEMA), "blocks")
    grams = materialise(counts.filter("kind = 0").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    tokens = materialise(counts.filter("kind = 1").groupBy("token").agg(F.sum("n").alias("n")), "tokens")
    total, kinds = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    # Each training text has one end, which is a token.
    total, kinds = total + trained, kinds + (trained > 0)
    rest = float(np.log10(total + kinds + 1))

    gram_costs = counts.filter("kind = 0").select("block", "gram").join(costs(grams, order), "gram") \
        .select("block", F.lit(0).alias("kind"), "gram", F.lit(None).cast("string").alias("token"), "cost")
    token_costs = counts.filter("kind = 1").select("block", "token").join(tokens, "token") \
        .select("block", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("gram"), "token",
                F.log10(F.col("n") + 1.0).alias("cost"))
    # The end is known to every block.
    ends = docs.sparkSession.range(blocks).select(
        F.col("id").cast("int").alias("block"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("gram"),
        F.lit("").alias("token"), F.lit(float(np.log10(trained + 1))).alias("cost"))
    table = gram_costs.unionByName(token_costs).unionByName(ends)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)] + SCORED.fields[1:])
    scored = docs.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(_block_scores(order, rest), schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                         "base_score", "score", "n_bytes")
