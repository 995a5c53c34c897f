"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

A document's set holds hashes of its distinct runs of ``shingle`` words, A-Z
lower-cased.  Of ``bands * rows`` minima, bands of ``rows`` give bucket keys, and the
low ``BITS`` bits of every minimum are packed into a signature.  Two unequal minima
agree in their low bits by chance, so the share of equal fields is corrected for
that when it stands for the similarity.

Candidates come from buckets without listing the pairs of a bucket:

1. Documents with equal sets are one node, known by its smallest id.
2. Each node of a bucket is held against the bucket's leaders, ``LEADERS`` nodes.  Pairs
   whose signatures are too unlike for the wanted similarity go; for each node the
   likeliest pair is confirmed on full sets first, the others only if still unconnected.
3. Buckets whose nodes are then in more than one component are searched for pairs
   across components.  A large bucket is dealt into blocks, so one task sees two blocks
   at a time.  Nodes that meet one alike enough by signature come again with their full
   sets; all pairs of them are confirmed there, and only links leave that connect what
   was still apart, fewer than the nodes seen.

With 40 bands of 5 rows a pair at similarity 0.8 is missed with probability 1.2e-7;
the signature bar lies five standard deviations below the similarity.

Nulls and edge cases: a text with fewer words than a shingle is one shingle; a
text without words, or null, has an empty set and is linked with nothing.  A row
with a null id links no others; it has the component of an equal set, if there is
one, and is kept only if there is none.  Rows that repeat an id and text have one
verdict.  An empty table gives no rows.  Only the id and text columns are read.

``keep_one`` judges rows, not ids: of every group one row stays, the least by id (null
ids last) and hash of the text; rows without an id link others there, an id that stands
on two texts is two rows, and of rows that repeat an id and text one stays.  Rows without
words all stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

BANDS, ROWS, BITS = 40, 5, 4
#: Standard deviations between the wanted similarity and the bar for signatures.
MARGIN = 5.0
#: Nodes of a bucket that all others are held against: the smallest, and some by hash.
LEADERS = 4
#: Nodes of a bucket that are dealt to one block, and shingles for each of them on average.
BLOCK, BLOCK_SHINGLES = 512, 1024
_REMEMBERED = 200_000
_RNG = np.random.default_rng(20260101)
_XOR = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)[:, None]
_ODD = (_RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1))[:, None]
_MIX = _RNG.integers(0, 1 << 63, 64, np.uint64) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word runs of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - size + 1)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    run = np.full(n, min(len(words), size), np.uint64)
    for k in range(min(size, len(words))):
        run = _mixed(run * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + n])
    return np.unique(run)


def minima(found: np.ndarray) -> np.ndarray:
    low = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), 4096):
        values = low[a:a + 4096][None, :] ^ _XOR
        values *= _ODD
        np.minimum(out, values.min(axis=1), out=out)
    return out


def bucket_keys(mins: np.ndarray) -> np.ndarray:
    """One key per band; keys of different bands differ."""
    parts = mins.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = _mixed(key * _MIX[r] + parts[:, r])
    return key.view(np.int64)


def packed(mins: np.ndarray) -> bytes:
    fields = ((mins ^ (mins >> np.uint32(16))) & np.uint32((1 << BITS) - 1)).astype(np.uint8)
    return ((fields[0::2] << BITS) | fields[1::2]).tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity estimated from packed signatures, rows of bytes, corrected for chance."""
    x = a ^ b
    equal = ((x & 0x0F) == 0).sum(axis=-1, dtype=np.int32) + ((x >> BITS) == 0).sum(axis=-1, dtype=np.int32)
    chance = 1.0 / (1 << BITS)
    return (equal / (BANDS * ROWS) - chance) / (1.0 - chance)


def signature_bar(percent: int) -> float:
    chance, s = 1.0 / (1 << BITS), percent / 100
    p = chance + (1 - chance) * s
    return s - MARGIN * float(np.sqrt(p * (1 - p) / (BANDS * ROWS))) / (1 - chance)


def _bytes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _features(size: int, schema: T.StructType):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                found = shingles(text, size)
                digest = xxhash.xxh3_128_digest(found.tobytes())
                a, b = np.frombuffer(digest, np.int64)
                mins = minima(found)
                rows.append((len(found), int(a), int(b), packed(mins), bucket_keys(mins)))
            n, a, b, sig, keys = list(zip(*rows, strict=True)) or [()] * 5
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64), pa.int64())
            at = pa.array(np.arange(0, BANDS * len(keys) + 1, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                 pa.array(sig, pa.binary()), pa.ListArray.from_arrays(at, flat)], names=schema.names)
    return each


def _alike(percent: int, bar: float):
    """Of pairs (a, b, sig_a, sig_b) those that may be similar, with their likeness."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                like = likeness(_bytes(batch.column("sig_a")), _bytes(batch.column("sig_b")))
                keep = pa.array(like >= bar)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(like).filter(keep)],
                    names=["a", "b", "like"])
    return each


def _near(percent: int, bar: float):
    """Of rows of (tile, nodes) the nodes that are alike enough, by signature, to one of another component."""
    names = ["key", "i", "j", "node", "component", "side"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes = row["nodes"]
                ids, comp, n, side = (np.array([x[k] for x in nodes], np.int64) for k in ("node", "component", "n", "side"))
                sig = np.frombuffer(b"".join(x["sig"] for x in nodes), np.uint8).reshape(len(nodes), -1)
                right = np.flatnonzero(side != 0)
                near = np.zeros(len(nodes), bool)
                for i in np.flatnonzero(side != 1):
                    ok = right[i + 1:] if row["i"] == row["j"] else right
                    ok = ok[(comp[ok] != comp[i]) & (100 * np.minimum(n[ok], n[i]) >= percent * np.maximum(n[ok], n[i]))]
                    ok = ok[likeness(sig[ok], sig[i][None, :]) >= bar]
                    near[ok] = True
                    near[i] |= len(ok) > 0
                if near.any():
                    # An id that stands on two texts is one node here; all its sets come back.
                    node, first = np.unique(ids[near], return_index=True)
                    columns = [np.full(len(node), row[k]) for k in names[:3]] + [node, comp[near][first], side[near][first]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)
    return each


def _spanning(percent: int):
    """Links within a tile, confirmed on full sets, that connect what its components leave apart."""
    def span(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, side = table["node"].to_numpy(), table["side"].to_numpy()
        label = np.unique(table["component"].to_numpy(), return_inverse=True)[1]
        items = table["items"].combine_chunks()
        kinds, flat = np.unique(items.flatten().to_numpy(), return_inverse=True)
        begin = np.concatenate(([0], np.cumsum(np.diff(items.offsets.to_numpy()))))
        n = np.diff(begin)
        # The rows of the right side together: all of them in the tile of one block.
        same = key[1].as_py() == key[2].as_py()
        right = np.flatnonzero(side != 0)
        theirs = flat[np.repeat(side != 0, n)]
        starts = np.concatenate(([0], np.cumsum(n[right])))
        out: list[tuple[int, int]] = []
        for i in np.flatnonzero(side != 1):
            skip = i + 1 if same else 0
            other = right[skip:]
            if (label[other] == label[i]).all():
                continue
            held = np.zeros(len(kinds), np.int32)
            held[flat[begin[i]:begin[i + 1]]] = 1
            both = np.add.reduceat(held[theirs[starts[skip]:]], starts[skip:-1] - starts[skip], dtype=np.int64)
            for j in other[100 * both >= percent * (n[other] + n[i] - both)]:
                if label[j] != label[i]:
                    out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
                    label[label == label[j]] = label[i]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return span


def _confirmed(percent: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            sets = [(x.values.to_numpy(), x.offsets.to_numpy()) for x in (batch.column("items_a"), batch.column("items_b"))]
            for i in range(batch.num_rows):
                x, y = (v[o[i]:o[i + 1]] for v, o in sets)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"])
    return each


def _sets(size: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x, size).view(np.int64) for x in batch.column("text").to_pylist()]
            at = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["node", "items"])
    return each


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for the ends of ``edges`` (a, b); a component's name is its smallest node.

    Alternates two steps until nothing changes: every node sends its larger, then
    its smaller, neighbours to the smallest.  A node's neighbours are never gathered.
    """
    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .filter("a <> b").distinct(), "edges")
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                              F.col("m").alias("b")).distinct()
        edges = materialise(small, "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _labelled(nodes: DataFrame, components: DataFrame, on: str, name: str) -> DataFrame:
    """``nodes`` with column ``name``: the component of ``on``, or itself."""
    label = components.select(F.col("node").alias(on), F.col("component").alias("_c"))
    return nodes.join(label, on, "left").withColumn(name, F.coalesce("_c", on)).drop("_c")


def _pairs_with(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(table.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80,
               block: int = BLOCK) -> DataFrame:
    """One row per document: set size, component (its smallest id) and whether it is the one kept."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    features = _featured(docs, shingle)
    nodes = features.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_x", "set_y").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"),
        F.first("keys").alias("keys"))
    nodes = materialise(nodes, "nodes")

    def texts_of(ids: DataFrame) -> DataFrame:
        # The same plan at every size: the ids are not broadcast while they are few.  Rows that repeat an id and text come once.
        return docs.filter("doc_id IS NOT NULL").withColumnRenamed("doc_id", "node") \
            .join(ids.distinct().hint("merge"), "node", "left_semi") \
            .groupBy("node", F.xxhash64("text")).agg(F.first("text").alias("text")).select("node", "text")

    found = _linked(nodes, texts_of, shingle, percent, block)
    verdict = _labelled(nodes.select("set_x", "set_y", "node"), found, "node", "component_id").drop("node")
    judged = features.select("doc_id", "n_shingles", "set_x", "set_y").join(verdict, ["set_x", "set_y"], "left")
    own_id = F.coalesce("component_id", "doc_id")
    return judged.select("doc_id", "n_shingles", own_id.alias("component_id"),
                         F.coalesce(F.col("doc_id") == own_id, F.col("component_id").isNull()).alias("kept"))


def _featured(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n_shingles, set_x, set_y, sig, keys) of each row of (doc_id, text)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_shingles", T.LongType()),
                           T.StructField("set_x", T.LongType()), T.StructField("set_y", T.LongType()),
                           T.StructField("sig", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    return materialise(docs.mapInArrow(_features(shingle, schema), schema), "features")


def _linked(nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], shingle: int, percent: int, block: int) -> DataFrame:
    """(node, component) of the linked ones of ``nodes``; ``texts_of`` gives (node, text) for a table of nodes."""
    pair_schema, bar = "a long, b long, like double", signature_bar(percent)

    rows = nodes.select("node", F.explode("keys").alias("key"))
    leaders = [F.min("node")] + [F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(1, LEADERS)]
    buckets = rows.groupBy("key").agg(F.count("*").alias("size"), *[x.alias(f"leader{i}") for i, x in enumerate(leaders)]) \
        .select("key", "size", F.array_distinct(F.array(*[f"leader{i}" for i in range(LEADERS)])).alias("leaders"))
    shared = materialise(rows.join(buckets.filter("size > 1"), "key"), "shared")

    star = shared.select("node", F.explode("leaders").alias("leader")).filter("node <> leader") \
        .select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct()
    sized = _pairs_with(star, nodes, "n", "sig") \
        .filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b", "sig_a", "sig_b")
    star = materialise(sized.mapInArrow(_alike(percent, bar), pair_schema), "star")

    def sets_of(ids: DataFrame) -> DataFrame:
        return materialise(texts_of(ids).mapInArrow(_sets(shingle), "node long, items array<long>"), "sets")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))

    def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        with_sets = _pairs_with(pairs.select("a", "b"), sets, "items")
        return materialise(with_sets.mapInArrow(_confirmed(percent), "a long, b long"),
                           "links")

    sets = sets_of(ends(star))

    def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
        return _labelled(_labelled(pairs, found, "a", "of_a"), found, "b", "of_b").filter("of_a <> of_b")

    # The likeliest pair of each node, then what is still apart.
    best = star.groupBy("a").agg(F.max_by("b", F.struct("like", -F.col("b"))).alias("b"))
    links = confirm(best, sets)
    found = connected(links)
    links = links.unionByName(confirm(apart(star.join(best, ["a", "b"], "left_anti"), found), sets))
    found = connected(links)

    # Buckets of two are settled: their one pair has been judged.
    wide = materialise(_labelled(shared.filter("size > 2").select("key", "node", "size"), found, "node", "component")
                       .join(nodes.select("node", "n", "sig"), "node"), "wide")
    mixed = wide.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.sum("n").alias("shingles")) \
        .filter("x <> y")
    wide = wide.join(mixed.select("key", "shingles"), "key")
    blocks = F.ceil(F.greatest(F.col("size") / block, F.col("shingles") / (block * BLOCK_SHINGLES))).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = wide.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), blocks - 1))}).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.struct("node", "component", "n", "sig",
                 F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))
        .alias("x"))
    # Two blocks of one bucket: at most about 2 * block nodes.
    tiles = dealt.groupBy("key", "i", "j").agg(F.collect_list("x").alias("nodes"))
    near = materialise(tiles.mapInArrow(_near(percent, bar), "key long, i int, j int, node long, component long, side int"), "near")
    if not near.take(1):
        return found
    rest = near.select("node").distinct().join(sets.select("node"), "node", "left_anti")
    more = near.join(sets.unionByName(sets_of(rest)), "node").groupBy("key", "i", "j") \
        .applyInArrow(_spanning(percent), "a long, b long")
    more = materialise(more, "more")
    return connected(links.unionByName(more)) if more.take(1) else found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
             percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, the least by id and text; rows without words all stay."""
    text, doc_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    # A row is known by its id and two hashes of its text; a struct without nulls, so null ids are joined too.
    key = F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("id"), F.xxhash64(text).alias("x"),
                   F.xxhash64(F.lit(1), text).alias("y"))
    keyed = docs.withColumn("_key", key)
    features = _featured(keyed.select(F.col("_key").alias("doc_id"), text.alias("text")), shingle).withColumnRenamed("doc_id", "_key")
    wordy = features.filter("n_shingles > 0")
    # Numbered when written: the numbers are read back from there.
    nodes = materialise(wordy.groupBy("set_x", "set_y").agg(
        F.min("_key").alias("_key"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = nodes.select("node", "_key").join(ids.distinct(), "node", "left_semi")
        # Rows that repeat an id and text are one node's text once.
        return keyed.select("_key", text.alias("text")).join(wanted.hint("merge"), "_key") \
            .groupBy("_key", "node").agg(F.first("text").alias("text")).select("node", "text")

    found = _linked(nodes.drop("_key"), texts_of, shingle, percent, BLOCK)
    least = _labelled(nodes.select("node", "_key"), found, "node", "component").groupBy("component") \
        .agg(F.min("_key").alias("_key"))
    # Of the keys with words: how often they stand, and whether they are the least of their group.
    rows = wordy.groupBy("_key").agg(F.count("*").alias("times")) \
        .join(least.select("_key", F.lit(True).alias("stays")), "_key", "left")
    # Those that go as they are, and those of which one comes back.
    gone = materialise(rows.filter("stays IS NULL OR times > 1").select("_key", F.coalesce("stays", F.lit(False)).alias("back")),
                       "gone")
    out = [F.col(f"`{c}`") for c in docs.columns]
    kept = keyed.join(gone, "_key", "left_anti").select(*out)
    again = gone.filter("back").select("_key")
    if not again.take(1):
        return kept
    row = F.struct(*out)
    once = keyed.join(again, "_key", "left_semi").select("_key", row.alias("_row")) \
        .groupBy("_key").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    return kept.unionByName(once.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns]))
