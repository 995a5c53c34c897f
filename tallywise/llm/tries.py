"""The trie of conversation prefixes, built by van Emde Boas recursion.

Each distinct sequence of first d turns is a node of depth d.  Going down turn by turn
would take as many rounds as the longest conversation has turns; here sequences are cut
at half depth instead, again and again, and all pieces of one size are handled at once:

1. **Names of pieces** (up): a turn is named by its content, a piece of 2h turns by the
   names of its halves.  Pieces start at multiples of their length, so each round has
   half the rows of the one before.
2. **Names of prefixes** (down): at each cut the upper part's prefix is known; the name
   of the prefix at the cut is made of it and of the piece up to the cut.  Sequences
   that share that name go on as one lower forest.  After the last round every depth of
   every conversation has its name, and equal names are equal prefixes.
3. **Totals** (up): in a piece of 2h depths the roots of the lower forests hold the totals
   of what lies below them in the piece; they are grafted onto the h ancestors that
   they have in the upper trie.  After the last round every node has its whole subtree.

There are as many rounds as the longest sequence has binary digits.

Scale.  Rows are dealt by (conversation, piece) or by node name, never by conversation
alone, so one conversation may hold any share of the turns and one prefix may be shared
by any share of the conversations.  Nodes are counted by partial aggregation, and what
children read from a parent is looked up by name and salt.  The members that end at a
node are joined to text per block of 8192 ids first; the digest is one running hash by
definition, so a node's blocks pass one task in order, a stream of which only the hash's
state is held.  Every round is written to the shared folder.

Names are 128-bit digests; two different prefixes would have to collide in MD5.

Defined cases.  Turns are taken in order of ``turn`` (null first), then role, then the
digest of the text; rows that repeat are turns of their own.  Null role or text is empty.
Rows without a conversation id belong to no conversation.  A conversation that is
rebuilt without turns is a member of the root and ends there.  Texts of any length count
whole.  Only the four named columns are read, so others cannot clash.  An empty table
has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scan import numbered
from .common import look_up, materialise

ID_BLOCK = 8192


def _named(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 1) ``, role, text``, nulls emptied."""
    empty = F.lit("")
    rows = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    return numbered(rows.withColumn("digest", F.md5(F.encode("text", "UTF-8"))), ["conv_id"], ["turn", "role", "digest"], "pos") \
        .select("conv_id", "pos", "role", "text")


def symbols(turns: DataFrame) -> DataFrame:
    """Turns by what is compared and counted: ``conv_id, pos, name, chars``."""
    size = F.char_length("role").cast("string")
    return turns.select("conv_id", F.col("pos").cast("bigint").alias("pos"), _named(
        F.encode(F.concat(size, F.lit(":"), "role", "text"), "UTF-8")).alias("name"),
        F.char_length("text").cast("bigint").alias("chars"))


def rebuilt(rows: DataFrame, group: int = 100, kinds: int = 6) -> tuple[DataFrame, DataFrame]:
    """The symbols of each conversation behind the first turns of its group's first one; and all conversations.

    Conversation c takes the first h turns of c - c % group, h = crc32(c) % kinds, and
    goes on with its own turns behind its first h.  A group has few members by what ids
    are, and at most ``kinds - 1`` turns of its first are handed out.
    """
    head = F.pmod(F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")), F.lit(kinds))
    convs = rows.select("conv_id").distinct().withColumns({"h": head, "first": F.col("conv_id") - F.col("conv_id") % group})
    firsts = rows.filter((F.col("conv_id") % group == 0) & (F.col("pos") < kinds)).withColumnRenamed("conv_id", "first")
    taken = convs.join(firsts, "first").filter("pos <= h").select("conv_id", "pos", "name", "chars")
    held = firsts.groupBy("first").agg(F.max("pos").alias("held"))
    shift = convs.join(held, "first", "left").select(
        "conv_id", "h", (F.least("h", F.coalesce("held", F.lit(0))) - F.col("h")).alias("by"))
    # Conversations are one row each here, so a long one is met by its own rows only through a salt.
    own = look_up(rows, ["conv_id"], ["pos"], shift).filter("pos > h").select(
        "conv_id", (F.col("pos") + F.col("by")).alias("pos"), "name", "chars")
    return taken.unionByName(own), convs.select("conv_id")


def prefixes(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, int]:
    """``conv_id, depth, name, chars, ends`` for each prefix of each conversation, the empty one included; and
    how many rounds it took.

    ``rows`` holds ``conv_id, pos, name, chars`` with ``pos`` from 1 without gaps.
    """
    rows = materialise(rows, "trie-turns")
    lengths = rows.groupBy("conv_id").agg(F.max("pos").alias("length"))
    convs = materialise(convs.join(lengths, "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0)).alias("length")), "trie-convs")
    rounds = (convs.agg(F.max("length")).first()[0] or 0).bit_length()

    # Pieces of 1, 2, 4 ... turns, numbered from 0; only whole pieces get a name.
    pieces = [rows.select("conv_id", (F.col("pos") - 1).alias("i"), "name")]
    half = lambda bit: F.max(F.when(F.col("i") % 2 == bit, F.col("name")))
    for _ in range(1, rounds):
        pairs = pieces[-1].groupBy("conv_id", F.floor(F.col("i") / 2).alias("i2")).agg(half(0).alias("a"), half(1).alias("b"))
        pieces.append(materialise(pairs.filter("b IS NOT NULL").select(
            "conv_id", F.col("i2").alias("i"), _named("a", "b").alias("name")), "trie-pieces"))

    known = convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), _named(F.lit("root")).alias("name"))
    for k in reversed(range(rounds)):
        h = 1 << k
        cut = pieces[k].filter("i % 2 = 0").select("conv_id", (F.col("i") * h).alias("depth"), F.col("name").alias("piece"))
        below = known.join(cut, ["conv_id", "depth"]).select(
            "conv_id", (F.col("depth") + h).alias("depth"), _named("name", "piece").alias("name"))
        known = materialise(known.unionByName(below), "trie-prefixes")
    sized = known.join(rows.select("conv_id", F.col("pos").alias("depth"), "chars"), ["conv_id", "depth"], "left") \
        .join(convs.select("conv_id", F.col("length").alias("depth"), F.lit(True).alias("ends")), ["conv_id", "depth"], "left")
    return sized.select("conv_id", "depth", "name", F.coalesce("chars", F.lit(0)).alias("chars"),
                        F.coalesce("ends", F.lit(False)).alias("ends")), rounds


def graft(nodes: DataFrame, paths: DataFrame, figures: list[str], rounds: int) -> DataFrame:
    """``nodes`` with each of ``figures`` summed over the node's subtree.

    ``nodes`` holds ``name, conv_id, depth`` and the figures of the node alone; ``paths``
    holds ``conv_id, depth, name``.
    """
    for k in range(rounds):
        h = 1 << k
        roots = nodes.filter(F.col("depth") % (2 * h) == h).select(
            "conv_id", (F.col("depth") / h - 1).cast("bigint").alias("piece"), *[F.col(f).alias(f"_{f}") for f in figures])
        upper = paths.withColumn("piece", F.floor(F.col("depth") / h)).filter("piece % 2 = 0")
        grafts = look_up(upper, ["conv_id", "piece"], ["depth"], roots).filter(F.col(f"_{figures[0]}").isNotNull()) \
            .groupBy("name").agg(*[F.sum(f"_{f}").alias(f"_{f}") for f in figures])
        total = {f: F.col(f) + F.coalesce(F.col(f"_{f}"), F.lit(0)) for f in figures}
        nodes = materialise(nodes.join(grafts, "name", "left").withColumns(total).select(nodes.columns), "trie-totals")
    return nodes


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One running hash a node over its blocks of ids, which come in order."""
    name, running, out = None, None, []
    for pdf in batches:
        for node, ids in zip(pdf["name"], pdf["ids"]):
            if node != name:
                if name is not None:
                    out.append((name, running.hexdigest()))
                name, running = node, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["name", "ends_sha256"])
        out = []
    if name is not None:
        yield pd.DataFrame([(name, running.hexdigest())], columns=["name", "ends_sha256"])


def ends_of(paths: DataFrame) -> DataFrame:
    """``name, ends_sha256``: the ids of the conversations that end at a node, ascending and joined by commas."""
    ends = paths.filter("ends").groupBy("name", F.floor(F.col("conv_id") / ID_BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list("conv_id")).alias("ids"))
    blocks = ends.select("name", "block", F.concat_ws(",", F.transform("ids", lambda i: i.cast("string"))).alias("ids"))
    return blocks.repartition("name").sortWithinPartitions("name", "block").select("name", "ids") \
        .mapInPandas(_digests, "name binary, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node: ``name, parent`` (names), ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``."""
    found, rounds = prefixes(rows, convs)
    paths = materialise(found, "trie-paths")
    nodes = paths.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
                                      F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"))
    above = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    nodes = materialise(nodes.join(above, ["conv_id", "depth"], "left"), "trie-nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    own = nodes.join(children, "name", "left").select(
        "name", "parent", "conv_id", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    whole = graft(materialise(own, "trie-own"), paths.select("conv_id", "depth", "name"), ["n_leaves", "saved_tokens"], rounds)
    parents = whole.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return look_up(whole, ["parent"], ["name"], parents).join(ends_of(paths), "name", "left").select(
        "name", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def with_last_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes beside the role and text of their last turn; ``turns`` are those that the trie was built of."""
    last = turns.select("conv_id", F.col("pos").alias("depth"), "role", "text")
    return nodes.join(last, ["conv_id", "depth"], "left")


def shared_prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table ``conv_id, turn, role, text``."""
    return trie(*rebuilt(materialise(symbols(turns_in_order(conversations)), "trie-symbols"))).drop("name", "parent")


def oracle() -> str:
    """The same nodes in DuckDB SQL: prefixes as lists, each node met by all its ancestors."""
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(c::VARCHAR) + 1),
      lambda i: [ord(substr(c::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, o: CASE WHEN o >= 0 THEN xor(a, o) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"""
    return f"""
WITH o AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
  ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT c, ts, {crc} % 6 AS h FROM o),
b AS (SELECT h.c, list_concat(coalesce(f.ts, [])[1:h.h], h.ts[h.h + 1:]) AS s FROM h LEFT JOIN o f ON f.c = h.c - h.c % 100),
p AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM b),
n AS (SELECT s[1:d] AS k, d, min(c) AS conv_id, count(*) AS n_convs,
  coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(s) = d), '') AS ends FROM p GROUP BY 1, 2),
w AS (SELECT n.*, n.k[1:n.d - 1] AS up, coalesce((n_convs - 1) * length(k[d].t), 0) AS own,
  (SELECT count(*) FROM n m WHERE m.d = n.d + 1 AND m.k[1:n.d] = n.k) AS n_children FROM n),
a AS (SELECT k[1:i] AS k, i AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM w) GROUP BY 1, 2)
SELECT w.conv_id, w.d AS depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, a.n_leaves, a.saved_tokens,
  sha256(w.ends) AS ends_sha256
FROM w JOIN a ON a.d = w.d AND a.k = w.k LEFT JOIN n q ON w.d > 0 AND q.d = w.d - 1 AND q.k = w.up"""
