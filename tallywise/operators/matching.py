"""Deciding which lines of a file the ledger already holds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import swapped
from ..functions.keys import content_signature, copy_key
from ..functions.text import is_narrative, squeeze, supplier_key, voucher_of
from ..plans.scan import Measure, cut_lineage, position, scan, walk
from ..schema import MONEY_SUM, TOLERANCE


def cents(col: Column) -> Column:
    return F.round(F.abs(col) * 100).cast("bigint")


def keep_known(rows: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key exists on the other side, each once."""
    return rows.join(known.select(*on).distinct(), list(on), "left_semi")


def only_new(candidates: DataFrame, held: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not held yet (nulls compare as values)."""
    h = held.select(*[F.col(c).alias(f"_h_{c}") for c in on]).distinct()
    cond = [candidates[c].eqNullSafe(h[f"_h_{c}"]) for c in on]
    return candidates.join(h, cond, "left_anti")


def match_suppliers(rows: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Dimension lookup where a missing country matches a missing country.

    ``rows`` carries ``supplier, supplier_country``; adds ``supplier_id``.
    """
    s = suppliers.select(F.col("supplier_id"), F.col("name").alias("_name"), F.col("country_code").alias("_cc"))
    return rows.join(s, (F.col("supplier") == F.col("_name"))
                     & F.col("supplier_country").eqNullSafe(F.col("_cc")), "left").drop("_name", "_cc")


def upsert_suppliers(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Supplier pairs to add: named, distinct, and not stored yet."""
    pairs = wanted.filter(F.col("supplier").isNotNull()).select(
        F.col("supplier").alias("name"), F.col("supplier_country").alias("country_code")).distinct()
    return only_new(pairs, stored, ["name", "country_code"])


def canonical_suppliers(suppliers: DataFrame) -> DataFrame:
    """Each supplier beside the first one entered under the same name and country."""
    cc = F.coalesce("country_code", F.lit(""))
    first = suppliers.groupBy("name", cc.alias("_cc")).agg(
        F.min_by("supplier_id", F.struct("created_at", "supplier_id")).alias("keep_id"))
    return suppliers.withColumn("_cc", cc).join(first, ["name", "_cc"]).drop("_cc")


def repoint_suppliers(txn: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Transactions moved from a duplicate supplier to the one that is kept."""
    moved = canonical_suppliers(suppliers).filter("supplier_id <> keep_id").select("supplier_id", "keep_id")
    return txn.join(moved, "supplier_id", "left") \
        .withColumn("supplier_id", F.coalesce("keep_id", "supplier_id")).drop("keep_id")


def counted_match(lines: DataFrame, ledger: DataFrame, keys: Sequence[str], line: str = "line",
                  row_id: str = "transaction_id") -> DataFrame:
    """The k-th copy in the file meets the k-th copy in the ledger.

    Adds ``copy`` (which copy of its key the line is), ``held`` (copies in the
    ledger), ``repeat_of`` (the first line it repeats) and ``held_id``.  One scan
    walks the ledger's copies of a key and then the file's, so a line finds all
    held copies counted; joining on key *and* copy number spreads a charge listed
    a million times over a million keys.

    The scan reads both sides three times.  The lines are written first, so their keys
    are worked out once; hand in a written ledger where its keys are dear.
    """
    keys, lines = list(keys), cut_lineage(lines)
    both = lines.select(*keys, F.lit(1).alias("_side"), F.col(line).alias("_id")).unionByName(
        ledger.select(*keys, F.lit(0).alias("_side"), F.col(row_id).alias("_id")))
    ours, one = F.col("_side") == 1, F.lit(1)
    met = cut_lineage(scan(both, keys, ["_side", "_id"], [
        Measure("held", "sum", F.when(~ours, one), "bigint"), Measure("copy", "sum", F.when(ours, one), "bigint"),
        Measure("_first", "max", F.when(ours, -F.col("_id")), "bigint")]))
    theirs = met.filter(~ours).select(*keys, F.col("held").alias("copy"), F.col("_id").alias("held_id"))
    # A key with a part missing meets nothing.
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    paired = met.filter(ours).join(theirs, keys + ["copy"], "left").select(
        F.col("_id").alias(line), "copy", F.when(known, F.col("held")).otherwise(0).cast("bigint").alias("held"),
        F.when(-F.col("_first") != F.col("_id"), -F.col("_first")).alias("repeat_of"), "held_id")
    return lines.join(paired, line)


WINDOW_DAYS = 7


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of one island after another, in file order, behind the island's rows.

    What is handed from batch to batch is the island being swept: the days whose row is
    still unclaimed, and what fitted each asked day last.  Returns one line for each
    change of ``fits``: it holds for lines of that day from the line ``run`` on.
    """
    island, left, known, out = None, {}, {}, []
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            here = (r.card_id, r.cents, r.money_out, r.skey, r.island)
            if here != island:
                island, left, known = here, {}, {}
            if not r.asks:
                left[r.at] = r.held_id
                continue
            near = [d for d in range(r.at - WINDOW_DAYS, r.at + WINDOW_DAYS + 1) if d in left]
            claimed = left.pop(near[0]) if len(near) == 1 else None
            if known.get(r.at) != len(near):
                out.append((*here[:4], r.at, r.run, len(near), claimed))
                known[r.at] = 0 if claimed is not None else len(near)
                if claimed is not None:
                    out.append((*here[:4], r.at, r.run + 1, 0, None))
        cols = ["card_id", "cents", "money_out", "skey", "at", "run", "fits", "claimed_id"]
        yield pd.DataFrame(out, columns=cols).astype({"claimed_id": "Int64"})
        out = []


def match_other_date(lines: DataFrame, pool: DataFrame) -> DataFrame:
    """Bank narratives dated up to a week apart from the row the ledger holds.

    ``lines`` holds ``line, card_id, cents, money_out, skey, day``; ``pool`` the
    same without ``line`` and with ``held_id``.  A line takes a row only if it
    is the one unclaimed row that fits, lines going in file order.

    Both sides are folded by day before they meet, so a narrative copied many
    times costs its days and not its pairs.  A day holding two rows can never
    be claimed: any line near it always fits both.  Lines near such a day, and
    lines near nothing, are settled without looking at the order.  The days of
    the rest fall into islands, cut wherever more than a week lies between two
    days: no claim reaches over such a gap.  Where all lines of an island bear one
    day, its first line decides.  Other islands are swept in file order, lines of
    one day in a row as one run, in batches that hand on the unclaimed days; an
    island is never held whole, and what the sweep returns are the few runs at
    which the rows left near a day change.

    Adds ``fits`` (0, 1, or more) and ``claimed_id``.
    """
    key = ["card_id", "cents", "money_out", "skey"]
    days = pool.groupBy(*key, "day").agg(F.count(F.lit(1)).alias("n"), F.min("held_id").alias("held_id"))
    asked = lines.groupBy(*key, "day").agg(F.min("line").alias("first_line"))
    offsets = F.explode(F.sequence(F.lit(-WINDOW_DAYS), F.lit(WINDOW_DAYS)))
    around = asked.select(*key, F.col("day").alias("asked_day"), offsets.alias("_off")) \
        .select(*key, "asked_day", F.date_add("asked_day", F.col("_off")).alias("day"))
    reach = around.join(days, key + ["day"]).groupBy(*key, F.col("asked_day").alias("day")).agg(
        F.sum("n").alias("near"), F.max("n").alias("most"), F.min("held_id").alias("held_id"))

    # The days of one key are few by what they are: a plain window orders them.
    at = F.unix_date("day").cast("int")
    contested = asked.join(reach.filter("most = 1"), key + ["day"]).select(
        *key, at.alias("at"), "first_line", "near", "held_id", F.lit(1).alias("asks"))
    usable = days.filter("n = 1").join(contested.select(*key).distinct(), key, "left_semi").select(
        *key, at.alias("at"), F.lit(None).cast("bigint").alias("first_line"), F.lit(None).cast("bigint").alias("near"),
        "held_id", F.lit(0).alias("asks"))
    along = walk(contested.unionByName(usable), key, ["at", "asks"], [Measure("_last", "prev", F.col("at"), "int")])
    cut = F.when(F.col("at") - F.col("_last") > WINDOW_DAYS, 1).otherwise(0)
    isles = walk(along.withColumn("_cut", cut), key, ["at", "asks"], [Measure("island", "sum", F.col("_cut"), "bigint")])
    isles = isles.drop("_last", "_cut")
    sizes = isles.groupBy(*key, "island").agg(F.sum("asks").alias("_asking"))
    sized = cut_lineage(isles.join(sizes, key + ["island"]))
    first = F.when((F.col("near") == 1), F.col("held_id"))
    alone = sized.filter("_asking = 1 AND asks = 1").select(
        *key, "at", F.col("near").alias("_near"), F.col("first_line").alias("_first"), first.alias("_claim"))

    crossing = sized.filter("_asking > 1").drop("_asking", "first_line", "near")
    met = lines.withColumn("at", at)
    swept = cut_lineage(met.join(crossing.filter("asks = 1").select(*key, "at", "island"), key + ["at"]))
    stepped = scan(swept, key, ["line"], [Measure("_before", "prev", F.col("at"), "int")])
    events = stepped.filter("_before IS NULL OR _before <> at").select(
        *key, "island", F.lit(1).alias("asks"), F.col("line").alias("run"), "at", F.lit(None).cast("bigint").alias("held_id")) \
        .unionByName(crossing.filter("asks = 0").select(*key, "island", "asks", F.lit(None).cast("bigint").alias("run"), "at", "held_id"))
    changes = events.repartition(*key, "island").sortWithinPartitions(*key, "island", "asks", "run", "at").mapInPandas(
        _sweep, "card_id bigint, cents bigint, money_out boolean, skey string, at int, run bigint, fits bigint, claimed_id bigint")
    steps = changes.groupBy(*key, "at").agg(F.sort_array(F.collect_list(F.struct("run", "fits", "claimed_id"))).alias("_steps"))
    # A day has 15 days near it, so at most 17 changes.
    walked = swept.join(steps, key + ["at"]).withColumn("_now", F.element_at(F.filter(
        "_steps", lambda s: s["run"] <= F.col("line")), -1))
    decided = walked.select(*lines.columns, F.col("_now")["fits"].alias("fits"),
                            F.when(F.col("_now")["run"] == F.col("line"), F.col("_now")["claimed_id"]).alias("claimed_id"))

    seen = met.join(reach.select(*key, at.alias("at"), "near", "most"), key + ["at"], "left") \
        .join(alone, key + ["at"], "left").filter("most IS NULL OR most > 1 OR _near IS NOT NULL")
    later = (F.col("_claim").isNotNull()) & (F.col("line") != F.col("_first"))
    settled = seen.select(*lines.columns, F.when(later, 0).otherwise(F.coalesce("near", F.lit(0))).cast("bigint").alias("fits"),
                          F.when(F.col("line") == F.col("_first"), F.col("_claim")).alias("claimed_id"))
    return settled.unionByName(decided)


def classify_duplicates(lines: DataFrame, ledger: DataFrame, with_reference: bool = False) -> DataFrame:
    """Which lines of a file are already in the ledger, and how they were recognised.

    ``lines`` holds ``line, card_id, txn_date, amount_aed, supplier_raw``;
    ``ledger`` is the transactions.  Adds

    * ``outcome``: ``held`` (this copy is there), ``held_swapped`` (there with
      day and month exchanged), ``held_other_date`` (a bank line dated up to a
      week apart), ``several_near`` (more than one such line, left out),
      ``missing_copy`` (the file lists more copies than the ledger holds),
      ``new``, or ``unreadable`` (no date or amount);
    * ``duplicate_of`` the ledger row, ``copy``, ``held`` and ``repeat_of``.
    """
    key = ["card_id", "day", "cents", "skey"] + (["ref"] if with_reference else [])
    ref = F.upper(F.trim(F.coalesce(F.col("req_number"), F.lit("")))) if with_reference else None

    def keyed(df: DataFrame, skey: Column) -> DataFrame:
        cols = {"day": F.col("txn_date"), "cents": cents(F.col("amount_aed")), "skey": skey}
        return df.withColumns({**cols, "ref": ref} if with_reference else cols)

    whole = lines.filter(F.col("txn_date").isNotNull() & F.col("amount_aed").isNotNull())
    odd = lines.filter(F.col("txn_date").isNull() | F.col("amount_aed").isNull())
    # Several steps read the ledger's keys: computing them once and keeping them in the shared folder is cheaper.
    held_rows = keyed(ledger, copy_key()).select(
        *key, "transaction_id", "status", (F.col("amount_aed") < 0).alias("money_out"),
        is_narrative(F.coalesce("supplier_raw", "description")).alias("narrative")) \
        .filter(F.col("day").isNotNull())
    held_rows = cut_lineage(held_rows)
    ours = keyed(whole, supplier_key(F.col("supplier_raw"))).withColumn("_narrative", is_narrative(F.col("supplier_raw")))

    first = counted_match(ours, held_rows, key)
    turned = held_rows.groupBy(*key).agg(F.min("transaction_id").alias("swapped_id"))
    rest = [k for k in key if k != "day"]
    asked = first.withColumn("_turned", F.when((F.col("held") == 0) & (swapped(F.col("day")) != F.col("day")),
                                               swapped(F.col("day"))))
    # Three later steps read this; computing it once and keeping it in the
    # shared folder is cheaper than three times the joins above.
    second = cut_lineage(asked.join(turned.withColumnRenamed("day", "_turned"), rest + ["_turned"], "left"))

    matched = F.coalesce("held_id", "swapped_id")
    spoken_for = second.filter(matched.isNotNull()).select(matched.alias("transaction_id")).distinct()
    pool = held_rows.filter("status <> 'voided' AND narrative").join(spoken_for, "transaction_id", "left_anti") \
        .select("card_id", "cents", "money_out", "skey", "day", F.col("transaction_id").alias("held_id"))
    open_lines = second.filter(matched.isNull() & F.col("_narrative")).select(
        "line", "card_id", "cents", (F.col("amount_aed") < 0).alias("money_out"), "skey", "day")
    near = match_other_date(open_lines, pool).select("line", "fits", "claimed_id")

    third = second.join(near, "line", "left")
    outcome = (F.when(F.col("held_id").isNotNull(), "held").when(F.col("swapped_id").isNotNull(), "held_swapped")
               .when(F.col("claimed_id").isNotNull(), "held_other_date").when(F.col("fits") > 1, "several_near")
               .when(F.col("held") > 0, "missing_copy").otherwise("new"))
    done = third.select(*lines.columns, outcome.alias("outcome"),
                        F.coalesce("held_id", "swapped_id", "claimed_id").alias("duplicate_of"),
                        "copy", "held", "repeat_of")
    bare = odd.select(*lines.columns, F.lit("unreadable").alias("outcome"),
                      *[F.lit(None).cast("bigint").alias(c) for c in ("duplicate_of", "copy", "held", "repeat_of")])
    return done.unionByName(bare)


def match_by_balance(lines: DataFrame, ledger: DataFrame) -> DataFrame:
    """Name a ledger row by the balance printed beside the line.

    ``lines`` holds ``line, card_id, balance``.  A balance two rows share names
    neither.  Adds ``balance_rows`` and, where that is one, ``held_id``.
    """
    to_cents = lambda c: F.round(c * 100).cast("bigint")
    stated = ledger.filter("status <> 'voided' AND statement_balance IS NOT NULL").groupBy(
        "card_id", to_cents(F.col("statement_balance")).alias("_b")).agg(
        F.count(F.lit(1)).alias("balance_rows"), F.min("transaction_id").alias("_id"))
    return lines.withColumn("_b", to_cents(F.col("balance"))).join(stated, ["card_id", "_b"], "left") \
        .withColumns({"balance_rows": F.coalesce("balance_rows", F.lit(0)).cast("bigint"),
                      "held_id": F.when(F.col("balance_rows") == 1, F.col("_id"))}).drop("_b", "_id")


def match_by_id(lines: DataFrame, ledger: DataFrame) -> DataFrame:
    """Name a ledger row by the id the export wrote.

    ``lines`` holds ``line, card_id, ledger_id`` (text).  Adds ``held_id`` and
    ``error`` saying why a line names no row it may touch.
    """
    given = squeeze(F.coalesce("ledger_id", F.lit("")))
    blank = lines.filter(given == "").withColumns({
        "held_id": F.lit(None).cast("bigint"), "error": F.lit("The line gives no id.")})
    named = lines.filter(given != "").withColumn("_gid", given)
    numbered_ = scan(named, ["_gid"], ["line"],
                     [Measure("_first", "max", -F.col("line"), "bigint")])
    rows = ledger.select(F.col("transaction_id").cast("string").alias("_gid"),
                         F.col("transaction_id").alias("_id"), F.col("card_id").alias("_card"))
    met = numbered_.join(rows, "_gid", "left")
    repeat = -F.col("_first") != F.col("line")
    error = (F.when(repeat, F.concat(F.lit("Given before, in line "), (-F.col("_first")).cast("string")))
             .when(F.col("_id").isNull(), "The ledger has no row of this id.")
             .when(F.col("_card") != F.col("card_id"), "The row of this id is in another account."))
    return met.select(*lines.columns, F.when(error.isNull(), F.col("_id")).alias("held_id"), error.alias("error")) \
        .unionByName(blank)


def match_by_voucher(ledger: DataFrame, statement: DataFrame) -> DataFrame:
    """Ledger rows met by a statement line on the bank's voucher and the signed amount.

    ``statement`` holds ``line, card_id, bank_date, amount_aed, supplier_raw``.
    The date takes no part in the match; ledger rows within a week of the
    statement are considered, copies one to one.
    """
    stated = statement.withColumns({"voucher": voucher_of(F.col("supplier_raw")),
                                    "amount": F.col("amount_aed").cast("decimal(18,2)")}).filter("voucher IS NOT NULL")
    span = statement.groupBy("card_id").agg(F.min("bank_date").alias("_from"), F.max("bank_date").alias("_to"))
    near = ledger.filter("status <> 'voided'").join(span, "card_id").filter(
        (F.col("txn_date") >= F.date_sub("_from", 7)) & (F.col("txn_date") <= F.date_add("_to", 7)))
    rows = near.select("card_id", "transaction_id", "txn_date", voucher_of(F.col("supplier_raw")).alias("voucher"),
                       F.col("amount_aed").cast("decimal(18,2)").alias("amount"))
    keys = ["card_id", "voucher", "amount"]
    named = rows.filter("voucher IS NOT NULL")
    a = scan(named, keys, ["transaction_id"], [position("copy")])
    b = scan(stated.select(*keys, "line", "bank_date"), keys, ["line"], [position("copy")])
    met = a.join(b, keys + ["copy"], "left")
    outcome = (F.when(F.col("line").isNull(), "unmatched").when(F.col("bank_date") == F.col("txn_date"), "agrees")
               .otherwise("date_differs"))
    plain = rows.filter("voucher IS NULL").select(
        "card_id", "transaction_id", "txn_date", "voucher", F.lit(None).cast("date").alias("bank_date"),
        F.lit("unmatched").alias("outcome"))
    return met.select("card_id", "transaction_id", "txn_date", "voucher", "bank_date",
                      outcome.alias("outcome")).unionByName(plain)


def resolve_accounts(statements: DataFrame, acct: DataFrame) -> DataFrame:
    """The account a statement is for: its name, else the reference its number
    ends on, else the one active account of that issuer and currency.  A name or
    reference that two accounts share names neither.

    ``statements`` holds ``statement_id, account_name, account_number,
    bank_issuer, currency``.  Adds ``card_id`` and ``resolved_by``.
    """
    # Two accounts of one name or reference: neither is taken.
    only = F.when(F.count(F.lit(1)) == 1, F.min("card_id"))
    by_name = acct.groupBy(F.col("card_name").alias("account_name")).agg(only.alias("_by_name"), F.lit(True).alias("_named"))
    tails = statements.filter("length(account_number) > 0") \
        .select("statement_id", "account_number", F.explode(F.expr("sequence(1, length(account_number))")).alias("_n")) \
        .select("statement_id", F.expr("right(account_number, _n)").alias("account_reference"), "_n")
    refs = acct.filter("account_reference <> ''").groupBy("account_reference").agg(only.alias("_id"))
    by_ref = tails.join(refs, "account_reference").groupBy("statement_id").agg(
        F.max_by(F.struct("_id"), "_n")["_id"].alias("_by_ref"), F.lit(True).alias("_ended"))
    lone = acct.filter("status = 'active'").groupBy("bank_issuer", F.col("settlement_currency").alias("currency")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("card_id").alias("_by_issuer")).filter("_n = 1").drop("_n")
    found = statements.join(by_name, "account_name", "left").join(by_ref, "statement_id", "left") \
        .join(lone, ["bank_issuer", "currency"], "left")
    named, ended = F.col("_named").isNotNull(), F.col("_ended").isNotNull()
    return found.withColumns({
        "card_id": F.when(named, F.col("_by_name")).when(ended, F.col("_by_ref")).otherwise(F.col("_by_issuer")),
        "resolved_by": F.when(named & F.col("_by_name").isNull(), "ambiguous name").when(named, "name")
        .when(ended & F.col("_by_ref").isNull(), "ambiguous reference").when(ended, "reference")
        .when(F.col("_by_issuer").isNotNull(), "issuer and currency")}) \
        .drop("_by_name", "_by_ref", "_by_issuer", "_named", "_ended")


def match_sheet_accounts(sheets: DataFrame, acct: DataFrame) -> DataFrame:
    """The account whose name (without its bracket) is the longest one found in
    a sheet's or file's name.

    Stretches of the name are looked up by equality, so no account is compared with
    a sheet it has nothing in common with.  A key is met by its head, the first 1, 2,
    4 … 64 characters, as many as it has: only where the head of some key begins is a
    stretch of that key's length cut out.
    """
    name = F.upper(F.trim(F.regexp_replace("card_name", r"\s*\(.*$", "")))
    keys = acct.select(name.alias("_key"), "card_id").filter("_key <> ''").groupBy("_key").agg(
        F.min("card_id").alias("card_id"))
    steps = F.array(*[F.lit(1 << i) for i in range(7)])
    head = F.array_max(F.filter(steps, lambda n: n <= F.length("_key")))
    heads = keys.select(F.substring("_key", F.lit(1), head).alias("_head"), head.alias("_n"), F.length("_key").alias("_len")).distinct()
    hay = F.upper(F.concat_ws(" ", "sheet", "file"))
    # Seven head lengths at most.
    named = sheets.select("file", "sheet", hay.alias("_hay")).distinct().join(
        F.broadcast(heads.select("_n").distinct()), F.col("_n") <= F.length("_hay"))
    starts = named.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("_hay") - F.col("_n") + 1))) \
        .withColumn("_head", F.substring("_hay", F.col("_at"), F.col("_n")))
    parts = starts.join(heads.drop("_n"), "_head").filter(F.col("_at") + F.col("_len") <= F.length("_hay") + 1) \
        .select("file", "sheet", F.substring("_hay", F.col("_at"), F.col("_len")).alias("_key"))
    best = parts.join(keys, "_key").groupBy("file", "sheet").agg(
        F.max_by("card_id", F.struct(F.length("_key"), -F.col("card_id"))).alias("card_id"))
    return sheets.join(best, ["file", "sheet"], "left")


def cross_check(left: DataFrame, right: DataFrame, key: str, figures: Sequence[str]) -> DataFrame:
    """Two independently derived summaries side by side, figure by figure."""
    l = left.select(key, *[F.col(f).cast(MONEY_SUM).alias(f"l_{f}") for f in figures], F.lit(True).alias("_l"))
    r = right.select(key, *[F.col(f).cast(MONEY_SUM).alias(f"r_{f}") for f in figures], F.lit(True).alias("_r"))
    both = l.join(r, key, "full_outer")
    rows = F.array(*[F.struct(F.lit(f).alias("figure"), F.col(f"l_{f}").alias("left_value"),
                              F.col(f"r_{f}").alias("right_value")) for f in figures])
    out = both.select(key, "_l", "_r", F.explode(rows).alias("x")).select(key, "_l", "_r", "x.*")
    apart = F.abs(F.coalesce("left_value", F.lit(0)) - F.coalesce("right_value", F.lit(0)))
    return out.select(key, "figure", "left_value", "right_value",
                      F.when(F.col("_l").isNull(), "missing on the left").when(F.col("_r").isNull(), "missing on the right")
                      .when(apart < F.lit(TOLERANCE).cast("decimal(4,3)"), "agrees").otherwise("differs").alias("verdict"))


def find_duplicates_of(txn: DataFrame, candidates: DataFrame) -> DataFrame:
    """Recorded rows whose signature equals a candidate's; each row once."""
    asked = candidates.select(content_signature().alias("signature")).distinct()
    return txn.withColumn("signature", content_signature()).join(asked, "signature", "left_semi")


def set_difference(expected: DataFrame, found: DataFrame, on: Sequence[str]) -> DataFrame:
    """Expected keys the ledger has lost."""
    return only_new(expected.select(*on).distinct(), found, on)
