"""Document fingerprints by winnowing.

A text is cut into tokens: stretches without white space, at most ``LONGEST`` code
points each, and single characters of scripts that leave no blanks.  Every run of
``GRAM`` tokens has a hash; of each ``WINDOW`` neighbouring runs the least hash is
chosen, the rightmost on ties, and kept with its position.  Two texts that share
``GRAM + WINDOW - 1`` tokens in a row share a fingerprint.

The least hash of all windows comes from doubling: of two, four, eight neighbours,
each step on the array before.  Hash and position travel as one number.

The next document in order is found without ordering all rows in one place: edges
taken from the data split the ids into ranges, and the row at an edge is also sent to
the range above, where it ends the order.

Nulls and edge cases: a null text is an empty one; a text without tokens has an empty
fingerprint, and two empty ones are alike; texts with fewer runs than a window keep
one; rows without an id stand outside the order and their next text is empty; rows that
repeat an id follow each other by hash of the text; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let

GRAM, WINDOW = 5, 16
LONGEST = 32
#: Bits for a position; windows are shorter than that, so it is known from its low bits.
PLACE_BITS = 20
#: UTF-8 bytes of text meant for one range of ids, and the most ranges.
RANGE_BYTES, MOST_RANGES = 4 << 20, 10_000

_DENSE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
TOKEN = rf"[{_DENSE}]|[^\s{_DENSE}]{{1,{LONGEST}}}"


def _fingerprint(text: str) -> str:
    """SQL: struct of positions and hashes of the fingerprint of ``text``."""
    mask = (1 << PLACE_BITS) - 1
    run = ", ".join(f"get(t, i + {j})" for j in range(GRAM))
    packed = (f"transform(sequence(0, greatest(size(t) - {GRAM}, 0)), i -> "
              f"shiftleft(shiftrightunsigned(xxhash64({run}), {PLACE_BITS + 1}), {PLACE_BITS}) | (i & {mask}))")
    # Of two neighbours the smaller hash, the right one on ties.
    pick = f"IF(shiftright(b, {PLACE_BITS}) <= shiftright(a, {PLACE_BITS}), b, a)"
    least, width = "x", 1
    while width < WINDOW:
        least = let(least, "y", f"zip_with(slice(y, 1, size(y) - {width}), slice(y, {width + 1}, size(y) - {width}), "
                                f"(a, b) -> {pick})")
        width *= 2
    own = (f"transform(m, (v, s) -> IF(s > 0 AND v = get(m, s - 1), -1L, "
           f"s + pmod((v & {mask}) - s, {mask + 1}L)))")
    wide = let(least, "m", f"array_remove({own}, -1L)")
    # Fewer runs than a window: one window holds them all, shorter than a position's bits.
    short = f"array(aggregate(x, x[0], (a, b) -> {pick}) & {mask}L)"
    chosen = f"IF(size(x) < {WINDOW}, {short}, {wide})"
    found = let(packed, "x", let(chosen, "p", "named_struct('places', p, 'hashes', "
                                              f"transform(p, k -> shiftright(x[int(k)], {PLACE_BITS})))"))
    none = "named_struct('places', array_remove(array(0L), 0L), 'hashes', array_remove(array(0L), 0L))"
    tokens = f"regexp_extract_all({text}, '{TOKEN}', 0)".replace("\\", "\\\\")
    return let(tokens, "t", f"IF(size(t) = 0, {none}, {found})")


def fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with ``name``: struct of positions (``places``, in tokens) and ``hashes``."""
    return docs.withColumn("_t", F.coalesce(F.col(f"`{text_col}`"), F.lit(""))) \
        .withColumn(name, F.expr(_fingerprint("_t"))).drop("_t")


def printed(name: str) -> Column:
    """A fingerprint as text: hash@position, comma-joined."""
    return F.expr(f"array_join(zip_with({name}.hashes, {name}.places, (h, p) -> concat(lower(hex(h)), '@', p)), ',')")


def likeness(a: str, b: str) -> Column:
    """Shared share of the distinct hashes of two fingerprints, 0 to 1."""
    union = F.size(F.array_union(f"{a}.hashes", f"{b}.hashes"))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(f"{a}.hashes", f"{b}.hashes")) / union)


def _ranges(docs: DataFrame) -> list[int]:
    """Upper edges of ranges of ids, values that occur; the last is the largest id."""
    size, top = docs.agg(F.sum(F.octet_length("text")), F.max("doc_id")).first()
    if top is None:
        return []
    n = min(MOST_RANGES, max(2, -(-(size or 0) // RANGE_BYTES)))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0]
    return sorted({*cuts, top})


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fingerprint) with the text and fingerprint of the next document, by descending id, in a ring."""
    edges = _ranges(docs)
    if edges:
        # The first edge at or above an id, searched in two steps.
        step = math.isqrt(len(edges)) + 1
        coarse, fine = F.array(*map(F.lit, edges[step - 1::step])), F.array(*map(F.lit, edges))
        low = F.size(F.filter(coarse, lambda e: e < F.col("doc_id"))) * step
        at = low + F.size(F.filter(F.slice(fine, low + 1, F.lit(step)), lambda e: e < F.col("doc_id")))
    else:
        fine, at = F.array(F.lit(0)), F.lit(0)
    # Rows without an id have no place in the order; they are spread by their text.
    apart = -1 - F.pmod(F.xxhash64("text"), F.lit(max(2, len(edges))))
    docs = docs.withColumn("at", F.when(F.col("doc_id").isNull(), apart).otherwise(at).cast("int"))
    is_edge = F.coalesce(F.col("doc_id") == F.get(fine, F.col("at")), F.lit(False))
    above = F.pmod(F.col("at") + 1, F.lit(max(1, len(edges)))).cast("int")
    copies = F.array(F.struct(F.col("at").alias("range"), F.lit(False).alias("guest")),
                     F.struct(above.alias("range"), F.lit(True).alias("guest")))
    sent = docs.withColumn("to", F.explode(F.when(is_edge, copies).otherwise(F.slice(copies, 1, 1)))) \
        .select("doc_id", "text", "to.range", "to.guest")
    order = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    known = F.col("doc_id").isNotNull()
    placed = sent.withColumn("next_text", F.when(known, F.lead("text").over(order)))
    placed = fingerprints(placed).withColumn("next_fingerprint", F.when(known, F.lead("fingerprint").over(order)))
    return placed.filter(~F.col("guest")).drop("range", "guest")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last third comes from the next document."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none = F.expr(_fingerprint("''"))
    rows = in_order(docs).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third),
                                              F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third)))
    rows = fingerprints(rows, "edited", "edited_print").withColumn("next_print", F.coalesce("next_fingerprint", none))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printed("fingerprint").alias("fingerprint"),
        printed("edited_print").alias("edited_fingerprint"), likeness("fingerprint", "edited_print").alias("near_edited"),
        likeness("fingerprint", "next_print").alias("near_next"))
