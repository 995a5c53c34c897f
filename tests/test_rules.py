"""Ledger rules on hand-made frames, checked against plain loops."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallywise.operators import balances as B
from tallywise.operators import chains as C
from tallywise.operators import checks as Q
from tallywise.operators import edits as E
from tallywise.operators import imports as I
from tallywise.operators import matching as M
from tallywise.session import state_on_disk
from tallywise.streaming import streams as ST

D0 = dt.date(2026, 1, 1)
TXN = ("transaction_id long, card_id long, txn_date date, amount_aed decimal(18,2), direction string, entry_type string, status string, "
       "included_in_source_balance boolean, supplier_raw string, description string, payment_ref string, req_number string, currency string, "
       "original_amount decimal(18,4), exchange_rate decimal(20,10), source_sheet string, source_row long, created_at timestamp_ntz, review_reason string")
ACCT = ("card_id long, card_name string, card_type string, settlement_currency string, opening_balance decimal(18,2), opening_date date, "
        "balance_sign int, tracks_balance boolean")


def txn(spark, rows):
    out = []
    for i, r in enumerate(rows, 1):
        amount = Decimal(str(r["amount"]))
        out.append((r.get("id", i), r.get("card", 1), r.get("day", D0), amount,
                    r.get("direction", "spend" if amount < 0 else "funding"), r.get("entry", "source_transaction"),
                    r.get("status", "confirmed"), r.get("included", True), r.get("supplier", "HOTEL"), None, r.get("pay"), r.get("req"),
                    r.get("currency"), r.get("original"), r.get("rate"), r.get("sheet", "S"), r.get("row", i),
                    r.get("at", dt.datetime(2026, 1, 1, 9, 0, 0)), r.get("reason")))
    return spark.createDataFrame(out, TXN)


def editable(df):
    return df.withColumns({c: F.lit(None).cast("string") for c in ("lpo_number", "notes", "invoice", "crm", "client", "sales_operation")})


def acct(spark, *rows):
    base = dict(id=1, name="CARD 1", kind="card", ccy="AED", opening="0", opened=None, sign=1, tracks=True)
    return spark.createDataFrame([tuple((lambda r: (r["id"], r["name"], r["kind"], r["ccy"], Decimal(r["opening"]), r["opened"], r["sign"],
                                                    r["tracks"]))({**base, **x})) for x in rows or [{}]], ACCT)


def test_a_drawn_balance_rises_with_spending(spark):
    row = B.account_balances(txn(spark, [{"amount": -277.67}]), acct(spark, {"opening": "-859.01", "sign": -1})).first()
    assert row.ledger_balance == Decimal("-581.34") and row.total_spend == Decimal("-277.67")


def test_an_excluded_row_is_deducted_once(spark):
    t = txn(spark, [{"amount": -8745.78, "included": False, "status": "excluded_from_source_balance"}])
    row = B.account_balances(t, acct(spark, {"opening": "25474.74"})).first()
    assert (row.source_balance, row.ledger_balance, row.reconciliation_difference) == (
        Decimal("25474.74"), Decimal("16728.96"), Decimal("8745.78"))


def test_rows_before_the_opening_are_stored_and_not_counted(spark):
    t = txn(spark, [{"amount": -5, "day": dt.date(2025, 12, 31)}, {"amount": -7}])
    a = acct(spark, {"opened": D0})
    assert B.account_balances(t, a).first().ledger_balance == Decimal("-7")
    assert [r.days_before for r in Q.rows_before_opening(t, a).collect()] == [1]


def test_accounts_without_rows_and_without_balance(spark):
    b = B.account_balances(txn(spark, [{"amount": -5}]), acct(spark, {}, {"id": 2, "name": "NBD", "tracks": False}, {"id": 3, "ccy": "SAR", "name": "B"}))
    assert b.count() == 3
    assert {r.settlement_currency: r.card_count for r in B.ledger_totals(b).collect()} == {"AED": 1, "SAR": 1}


def test_opposite_differences_never_cancel(spark):
    t = txn(spark, [{"amount": -5, "included": False}, {"amount": 5, "included": False, "card": 2}])
    b = B.account_balances(t, acct(spark, {}, {"id": 2, "ccy": "SAR", "name": "B"}))
    assert B.ledger_counts(b).first().cards_with_difference == 2


def test_a_refunded_booking_nets_to_zero_with_both_sides(spark):
    t = txn(spark, [{"amount": -5000, "req": "REQ 1"}, {"amount": 5000, "req": "req 1 "}])
    row = B.totals_by_reference(t, acct(spark)).first()
    assert (row.spent, row.received, row.net) == (5000, 5000, 0)


def test_one_break_is_one_finding(spark):
    rows = [{"amount": -10}, {"amount": -10}, {"amount": -10}, {"amount": -10}]
    printed = [90, 85, 75, None]
    t = txn(spark, rows).withColumn("statement_balance", F.element_at(F.array(*[F.lit(p).cast("decimal(18,2)") for p in printed]), F.col("transaction_id").cast("int")))
    got = C.chain_breaks_resync(t, acct(spark, {"opening": "100"}), ["transaction_id"])
    assert [(r.transaction_id, r.kind) for r in got.orderBy("transaction_id").collect()] == [(1, "ok"), (2, "mismatch"), (3, "ok")]


def test_an_overwritten_balance_becomes_a_labelled_adjustment(spark):
    rows = spark.createDataFrame([
        (0, None, None, None, None, None, None, "-1552.30"), (1, "01/01/2026", "A", None, "10", None, "=F1-D2+E2", "-1562.30"),
        (2, "02/01/2026", "B", None, None, "10", None, "165.72")],
        "row long, date_text string, supplier string, currency_text string, decrease string, increase string, balance_formula string, balance_value string")
    rows = rows.select(F.lit("S").alias("sheet"), "row", "date_text", "supplier", "currency_text", F.col("decrease").cast("decimal(18,2)"),
                       F.col("increase").cast("decimal(18,2)"), "balance_formula", F.col("balance_value").cast("decimal(18,2)"),
                       F.lit(None).cast("string").alias("rate_formula"), F.lit(None).cast("decimal(20,10)").alias("rate_value"))
    x = I.extract_rows(rows)
    chain = C.chain_breaks_resync(x, I.opening_balances(rows), ["row"], [F.col("row")], keys=["sheet"])
    added = I.inject_adjustments(x, chain).filter("entry_type = 'reconciliation_adjustment'").first()
    assert added.amount_aed == Decimal("1718.02") and added.direction is None and added.supplier_raw is None


def test_a_sheet_keeps_its_own_key_with_and_without_blocks(spark):
    t = txn(spark, [{"amount": -10}, {"amount": -10}]).withColumn("statement_balance", F.lit(90).cast("decimal(18,2)"))
    opening = acct(spark, {"opening": "100"}).withColumnRenamed("card_id", "sheet")
    t = t.withColumnRenamed("card_id", "sheet")
    kinds = lambda df: [r.kind for r in df.orderBy("transaction_id").collect()]
    plain = C.chain_breaks_resync(t, opening, ["transaction_id"], keys=["sheet"])
    assert kinds(plain) == kinds(C.chain_breaks_resync(t, opening, ["transaction_id"], [F.col("transaction_id")], keys=["sheet"])) == ["ok", "mismatch"]


# --------------------------------------------------------------- matching

def lines(spark, rows):
    return spark.createDataFrame([(i, r.get("card", 1), r.get("day", D0), Decimal(str(r["amount"])), r.get("supplier", "HOTEL"))
                                  for i, r in enumerate(rows, 1)], "line long, card_id long, txn_date date, amount_aed decimal(18,2), supplier_raw string")


def outcomes(spark, file, ledger):
    return [r.outcome for r in M.classify_duplicates(lines(spark, file), txn(spark, ledger)).orderBy("line").collect()]


def test_copies_are_matched_by_count(spark):
    charge = {"amount": -48890}
    assert outcomes(spark, [charge] * 5, []) == ["new"] * 5
    assert outcomes(spark, [charge] * 3, [charge]) == ["held", "missing_copy", "missing_copy"]
    assert outcomes(spark, [charge] * 2, [charge] * 2) == ["held", "held"]


def test_a_swapped_date_is_recognised(spark):
    assert outcomes(spark, [{"amount": -5, "day": dt.date(2026, 9, 1)}], [{"amount": -5, "day": dt.date(2026, 1, 9)}]) == ["held_swapped"]


NARRATIVE = "TRANSFER\nfor rent"


def test_a_bank_line_dated_days_apart_is_recognised_only_when_alone(spark):
    day = lambda n: D0 + dt.timedelta(days=n)
    line = {"amount": 9, "supplier": NARRATIVE, "day": day(13)}
    assert outcomes(spark, [line], [{"amount": 9, "supplier": NARRATIVE, "day": day(15)}]) == ["held_other_date"]
    two = [{"amount": 9, "supplier": NARRATIVE, "day": day(15)}, {"amount": 9, "supplier": NARRATIVE, "day": day(12)}]
    assert outcomes(spark, [line], two) == ["several_near"]
    assert outcomes(spark, [line], [{"amount": 9, "supplier": NARRATIVE, "day": day(21)}]) == ["new"]
    assert outcomes(spark, [{"amount": 9, "day": day(13)}], [{"amount": 9, "day": day(15)}]) == ["new"]


def greedy(file, pool):
    left, out = dict(enumerate(pool)), {}
    for line, key, day in sorted(file):
        near = [i for i, (k, d) in left.items() if k == key and abs((d - day).days) <= 7]
        if len(near) == 1:
            out[line] = ("claimed", near[0])
            del left[near[0]]
        else:
            out[line] = ("several" if near else "none", None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_claims_in_file_order_equal_the_plain_loop(spark, seed):
    rnd = random.Random(seed)
    spread = rnd.choice([20, 60, 120])
    file = [(i, rnd.choice("ab"), D0 + dt.timedelta(days=rnd.randrange(spread))) for i in range(120)]
    pool = [(rnd.choice("ab"), D0 + dt.timedelta(days=rnd.randrange(spread))) for _ in range(spread // 5)]
    cols = "card_id long, cents long, money_out boolean, skey string, day date"
    a = spark.createDataFrame([(i, 1, 100, True, k, d) for i, k, d in file], "line long, " + cols)
    b = spark.createDataFrame([(1, 100, True, k, d, i) for i, (k, d) in enumerate(pool)], cols + ", held_id long")
    got = {r.line: ("claimed" if r.claimed_id is not None else "several" if r.fits > 1 else "none", r.claimed_id)
           for r in M.match_other_date(a, b).collect()}
    assert got == greedy(file, pool)


def test_decimal_slips_equal_the_plain_loop(spark):
    rnd = random.Random(5)
    base = [rnd.randrange(5000, 60000) / 100 for _ in range(8)]
    rows = []
    for _ in range(150):
        amount = round(rnd.choice(base) * rnd.choice([1, 1, 10, 100, 1000, 10.004, 9.996, 11]), 2)
        rows.append({"amount": -amount, "day": D0 + dt.timedelta(days=rnd.randrange(40)), "supplier": rnd.choice(["X", "Y"])})
    t = txn(spark, rows)
    want = {}
    data = [(i, r["supplier"], round(abs(r["amount"]) * 100), r["day"]) for i, r in enumerate(rows, 1)]
    for i, s, a, d in data:
        best = []
        for j, s2, p, d2 in data:
            f = round(a / p)
            if i != j and s == s2 and a > p and a >= 50000 and f in (10, 100, 1000) and abs(a - f * p) * 1000 < 5 * p:
                best.append((d2 != d, abs((d2 - d).days), j, f))
        if best:
            want[i] = min(best)[2:]
    got = {r.transaction_id: (r.compare_with_id, r.factor) for r in Q.suspect_amounts(t, acct(spark)).collect()}
    assert got == want
    assert want


def test_double_submits_equal_the_plain_loop(spark):
    rnd = random.Random(11)
    t0 = dt.datetime(2026, 1, 1, 9)
    rows = [(i, rnd.choice([1, 1, 1, 2]), D0, "purchase", Decimal("5"), "X", t0 + dt.timedelta(seconds=rnd.randrange(6000)), rnd.random() < 0.1)
            for i in range(200)]
    df = spark.createDataFrame(rows, "submission_id long, card_id long, txn_date date, kind string, amount decimal(18,2), supplier string, "
                                     "submitted_at timestamp_ntz, allow_duplicate boolean")
    last, want = {}, set()
    for r in sorted(rows, key=lambda r: (r[6], r[0])):
        seen = last.get(r[1])
        if r[7] or seen is None or (r[6] - seen).total_seconds() >= 120:
            want.add(r[0])
            last[r[1]] = r[6]
    # Rows of one moment: a guarded one goes first if any may, whatever its id.
    moments = {}
    for r in rows:
        moments.setdefault((r[1], r[6]), []).append(r)
    got = {r.submission_id for r in ST.suppress_double_submits(df, 120).collect()}
    odd = {i for m in moments.values() if len(m) > 1 for i in (x[0] for x in m)}
    assert got - odd == want - odd


def streamed(spark, df, parts, tmp_path):
    """The ids accepted when the rows of ``parts`` arrive one list after another."""
    for ids in parts:
        df.filter(F.col("submission_id").isin(ids)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with state_on_disk(spark):
        ST.judge_submissions_stream(live).writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append") \
            .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    return {r.submission_id for r in ST.accepted_submissions(df, spark.read.parquet(f"{tmp_path}/out")).collect()}


def test_stream_and_batch_suppress_the_same_in_any_order(spark, tmp_path):
    rnd = random.Random(2)
    t0 = dt.datetime(2026, 1, 1, 9)
    rows = [(i, rnd.randrange(3), D0, "purchase", Decimal("5"), "X", t0 + dt.timedelta(seconds=rnd.randrange(150) * 17), i % 13 == 0) for i in range(150)]
    df = spark.createDataFrame(rows, "submission_id long, card_id long, txn_date date, kind string, amount decimal(18,2), supplier string, "
                                     "submitted_at timestamp, allow_duplicate boolean")
    ids = rnd.sample(range(150), 150)
    assert streamed(spark, df, [ids[k::3] for k in range(3)], tmp_path) == \
        {r.submission_id for r in ST.suppress_double_submits(df).collect()}


def test_a_late_submission_is_judged_by_all_accepted_ones(spark, tmp_path):
    moments = ["2026-01-05 10:00:00", "2026-01-05 11:00:00", "2026-01-05 10:00:30", "2026-01-01 10:00:00", "2026-01-05 09:59:00"]
    df = spark.createDataFrame([(k, "X", False, d) for k, d in enumerate(moments)],
                               "submission_id long, supplier string, allow_duplicate boolean, at string") \
        .select("submission_id", "supplier", "allow_duplicate", F.col("at").cast("timestamp").alias("submitted_at"))
    assert streamed(spark, df, [[0], [1], [2], [3], [4]], tmp_path) == {1, 3, 4}


# ---------------------------------------------------------------- changes

def test_bank_rows_cannot_be_voided_and_reasons_are_required(spark):
    t = txn(spark, [{"amount": -5}, {"amount": -6, "card": 2}])
    a = acct(spark, {}, {"id": 2, "kind": "bank_account", "name": "BANK"})
    d = spark.createDataFrame([(1, 1, "void", "wrong"), (2, 2, "void", "wrong"), (3, 1, "confirm", " "), (4, 2, "reopen", "hm")],
                              "decision_id long, transaction_id long, action string, rationale string") \
        .withColumns({"review_reason": F.lit(None).cast("string"), "decided_at": F.lit("2026-01-01").cast("timestamp_ntz")})
    judged = E.judge_decisions(t, a, d)
    errors = {r.decision_id: r.error for r in judged.collect()}
    assert errors[1] is None and "voided" in errors[2] and "reason written" in errors[3] and "question" in errors[4]
    assert {r.transaction_id: r.status for r in E.apply_decisions(t, judged).collect()} == {1: "voided", 2: "confirmed"}


def test_a_reference_can_be_removed_and_nothing_changed_is_refused(spark):
    t = editable(txn(spark, [{"amount": -5, "pay": "P1"}, {"amount": -5, "pay": "P1"}]))
    e = spark.createDataFrame([(1, 1, " "), (2, 2, "P1"), (3, 9, "x")], "edit_id long, transaction_id long, payment_ref string")
    assert {r.transaction_id: r.payment_ref for r in E.apply_edits(t, e).collect()} == {1: None, 2: "P1"}
    assert {r.transaction_id: r.error for r in E.refused_edits(t, e).collect()} == {2: "The edit changes no value", 9: "No entry has this id"}
    log = E.edit_log(t, e).collect()
    assert [(r.field, r.was, r.became) for r in log] == [("payment_ref", "P1", None)]


def test_a_bad_edit_refuses_only_itself(spark):
    t = editable(txn(spark, [{"amount": -5, "pay": "P1"}]))
    e = spark.createDataFrame([(1, 1, "P2", None), (2, 1, None, "gift"), (3, 1, "P3", None), (4, 1, "P3", None), (5, 1, None, "refund")],
                              "edit_id long, transaction_id long, payment_ref string, kind string")
    row = E.apply_edits(t, e).first()
    assert (row.payment_ref, row.amount_aed, row.direction) == ("P3", 5, "funding")
    assert {r.edit_id: r.error for r in E.refused_edits(t, e).collect()} == {2: "Not a kind of entry: gift", 4: "The edit changes no value"}
    log = {(r.edit_id, r.field): (r.was, r.became) for r in E.edit_log(t, e).collect()}
    assert log == {(1, "payment_ref"): ("P1", "P2"), (3, "payment_ref"): ("P2", "P3"),
                   (5, "amount_aed"): ("-5.00", "5.00"), (5, "direction"): ("spend", "funding")}


def test_a_kind_change_turns_the_sign(spark):
    t = editable(txn(spark, [{"amount": -5}]))
    e = spark.createDataFrame([(1, 1, "refund")], "edit_id long, transaction_id long, kind string")
    row = E.apply_edits(t, e).first()
    assert (row.amount_aed, row.direction) == (5, "funding")


def test_a_second_entry_takes_the_next_occurrence(spark):
    t = txn(spark, [{"amount": -5}])
    b = spark.createDataFrame([(10, 1, D0, "purchase", Decimal("5"), "HOTEL"), (11, 1, D0, "purchase", Decimal("5"), "HOTEL")],
                              "submission_id long, card_id long, txn_date date, kind string, amount decimal(18,2), supplier string") \
        .withColumn("submitted_at", F.lit("2026-01-01").cast("timestamp_ntz"))
    assert sorted(r.occurrence for r in E.apply_submissions(t, b).collect()) == [2, 3]


def test_european_numbers_and_words_in_an_imported_sheet(spark):
    rows = spark.createDataFrame([(1, 1, True, "28/01/2026", "A", "1.234,56", None), (2, 1, True, "03/04/2026", "B", None, "see note"),
                                  (3, 1, True, None, "SECTION", None, None), (4, 1, True, "01/02/2026", "REFUND X", None, "(500)")],
                                 "line long, card_id long, day_first boolean, date string, supplier string, decrease string, increase string")
    got = {r.line: r for r in I.build_rows(rows, acct(spark)).collect()}
    assert got[1].amount_aed == Decimal("-1234.56") and got[1].include
    assert got[2].errors == ["Neither money in nor money out is known."] and not got[2].include
    assert 3 not in got and (got[4].kind, got[4].amount_aed) == ("refund", 500)


def test_repeats_are_numbered_the_same_on_every_import(spark):
    t = txn(spark, [{"amount": -5}] * 4 + [{"amount": 5, "pay": "R"}])
    a = {(r.transaction_id, r.dedup_key) for r in Q.assign_occurrence(t).collect()}
    b = {(r.transaction_id, r.dedup_key) for r in Q.assign_occurrence(t.orderBy(F.desc("transaction_id"))).collect()}
    assert a == b and len({k for _, k in a}) == 5


def test_bank_order_reads_a_sheet_that_lists_the_newest_line_first(spark):
    t = txn(spark, [{"amount": -1, "row": 3}, {"amount": -2, "row": 2}, {"amount": -4, "row": 1}, {"amount": -8, "row": None, "sheet": None}])
    printed = F.element_at(F.array(*[F.lit(x).cast("decimal(18,2)") for x in (99, 97, 93, None)]), F.col("transaction_id").cast("int"))
    got = C.bank_order(t.withColumn("statement_balance", printed)).orderBy("line_no")
    assert [r.transaction_id for r in got.collect()] == [1, 2, 3, 4]


def test_export_keeps_the_order(spark, tmp_path):
    from tallywise.fixtures import accounts, transactions
    from tallywise.operators.reports import export_transactions
    d = "/root/testdata/sf0.001"
    path = str(tmp_path / "out")
    export_transactions(transactions(spark, d), accounts(spark, d), path)
    days = [r.Date for r in spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
            .select("Date").collect()]
    assert days == sorted(days, reverse=True) and len(days) > 100


def test_header_far_down(spark):
    from tallywise.operators.sheets import detect_header
    cells = [("f", "S", 1, c, "note") for c in (1, 2)] + [("f", "S", 33, c, t) for c, t in enumerate(
        ("Date", "Description", "Debit", "Credit", "Balance"), 1)]
    found = detect_header(spark.createDataFrame(cells, "file string, sheet string, row int, col int, text string"))
    assert [r.header_row for r in found.collect()] == [33]


def test_long_and_shared_references(spark):
    from tallywise.operators.matching import resolve_accounts
    accounts = spark.createDataFrame(
        [(1, "A", "123456789", "active", "B", "AED"), (2, "C", "77", "active", "B", "AED"), (3, "D", "77", "active", "B", "AED")],
        "card_id long, card_name string, account_reference string, status string, bank_issuer string, settlement_currency string")
    asked = spark.createDataFrame([(1, "?", "00123456789", "X", "USD"), (2, "?", "0077", "X", "USD"), (3, "?", "", "X", "USD")],
                                  "statement_id long, account_name string, account_number string, bank_issuer string, currency string")
    out = {r.statement_id: (r.card_id, r.resolved_by) for r in resolve_accounts(asked, accounts).collect()}
    assert out == {1: (1, "reference"), 2: (None, "ambiguous reference"), 3: (None, None)}


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace
    from tallywise.session import shared_dir
    conf = SimpleNamespace(get=lambda *a: None)
    far = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://x:7077", getConf=lambda: conf))
    with pytest.raises(ValueError):
        shared_dir(far, "x")


def test_payments_are_recognised_by_count(spark):
    from tallywise.operators.imports import recognise_payments
    day = dt.date(2024, 5, 6)
    paid = spark.createDataFrame([(1, day, "Acme Ltd", Decimal("-10.00"), "REQ 1"), (2, day, "ACME  ltd", Decimal("-10.00"), "req 1"),
                                  (3, day, "Acme Ltd", Decimal("-10.00"), "REQ 1"), (4, None, "Acme Ltd", Decimal("-10.00"), "REQ 1")],
                                 "line bigint, txn_date date, supplier_raw string, amount_aed decimal(18,2), req_number string")
    held = spark.createDataFrame([(7, day, "acme ltd", Decimal("-10.00"), "REQ 1", "confirmed"), (8, day, "Acme Ltd", Decimal("-10.00"), "REQ 1", "voided"),
                                  (9, day, "Acme Ltd", Decimal("-10.00"), "REQ 1", "needs_review")],
                                 "transaction_id bigint, txn_date date, supplier_raw string, amount_aed decimal(18,2), req_number string, status string")
    assert sorted((r.line, r.held_id) for r in recognise_payments(paid, held).collect()) == [(1, 7), (2, 9), (3, None), (4, None)]


def test_a_date_moved_across_the_opening_moves_the_balance(spark):
    from tallywise.operators.edits import moved_balances
    a, b, c = dt.date(2024, 1, 31), dt.date(2024, 2, 1), dt.date(2024, 2, 2)
    cols = "transaction_id bigint, card_id bigint, txn_date date, amount_aed decimal(18,2), status string"
    was = [(1, 1, a, Decimal("-5.00"), "confirmed"), (2, 1, b, Decimal("7.00"), "confirmed"), (3, 1, b, Decimal("9.00"), "confirmed"),
           (4, 1, a, Decimal("-5.00"), "voided"), (5, 2, a, Decimal("3.00"), "confirmed")]
    now = [(1, 1, b), (2, 1, a), (3, 1, c), (4, 1, b), (5, 2, c)]
    acct = spark.createDataFrame([(1, b), (2, None)], "card_id bigint, opening_date date")
    moved = moved_balances(spark.createDataFrame(was, cols), spark.createDataFrame(now, "transaction_id bigint, card_id bigint, txn_date date"), acct)
    assert sorted((r.transaction_id, r.effect) for r in moved.collect()) == [(1, Decimal("-5.00")), (2, Decimal("-7.00"))]


def test_rows_of_unknown_accounts(spark):
    from tallywise.operators.checks import rows_of_unknown_accounts
    t = spark.createDataFrame([(1, 1), (2, 5), (3, None)], "transaction_id bigint, card_id bigint")
    acct = spark.createDataFrame([(1,)], "card_id bigint")
    assert sorted(r.transaction_id for r in rows_of_unknown_accounts(t, acct).collect()) == [2, 3]
    assert rows_of_unknown_accounts(t.limit(0), acct).count() == 0


def test_the_longest_account_name_in_a_sheet_is_found_among_many_stretches(spark):
    names = ["A", "AB", "ABC (AED)", "ABCDEFGHI", "X" * 70, "X" * 69 + "Y", "", "( only a bracket)"]
    a = spark.createDataFrame(list(enumerate(names, 1)) + [(9, "abc")], "card_id long, card_name string")
    sheets = spark.createDataFrame([("f", "zz abcd"), ("f", "abcdefghi"), ("f", "-" * 3000 + "x" * 69 + "y"), ("f", "Q"), ("", "")], "file string, sheet string")
    got = {r.sheet[-9:]: r.card_id for r in M.match_sheet_accounts(sheets, a).collect()}
    assert got == {"zz abcd": 3, "abcdefghi": 4, "xxxxxxxxy": 6, "Q": None, "": None}
    # A name of 3000 characters has 4.5 million stretches; those looked at are as many as its characters.
    plan = M.match_sheet_accounts(sheets, a)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode") == 1


def test_a_line_in_conflict_is_not_also_unchanged(spark):
    t = txn(spark, [{"amount": -10, "pay": "PAY 9"}, {"amount": -10, "pay": "PAY 9"}])
    lines = spark.createDataFrame([(1, 1, "1", "PAY 9", Decimal("-9")), (2, 1, "2", "PAY 9", Decimal("-10"))],
                                  "line long, card_id long, ledger_id string, value string, sheet_amount decimal(18,2)")
    got = {r.line: (r.error is None, r.unchanged) for r in E.build_update_rows(lines, t, "payment_ref").collect()}
    assert got == {1: (False, False), 2: (True, True)}


def test_counting_copies_works_out_the_keys_of_a_line_once(spark):
    from pyspark.sql.functions import udf
    from tallywise.operators.matching import counted_match
    seen = spark.sparkContext.accumulator(0)

    def key(x):
        seen.add(1)
        return x // 2

    lines = spark.range(0, 10, 1, 1).select(F.col("id").alias("line"), udf(key, "bigint")("id").alias("k"))
    ledger = spark.createDataFrame([(100, 0), (101, 0), (102, 3)], "transaction_id bigint, k bigint")
    got = {r.line: (r.copy, r.held, r.held_id) for r in counted_match(lines, ledger, ["k"]).collect()}
    assert got[0] == (1, 2, 100) and got[1] == (2, 2, 101) and got[6] == (1, 1, 102) and got[7] == (2, 1, None) and got[9] == (2, 0, None)
    assert seen.value == 10


def test_submissions_are_judged_once(spark):
    from pyspark.sql.functions import udf
    from tallywise.operators.edits import apply_submissions
    seen = spark.sparkContext.accumulator(0)

    def named(x):
        seen.add(1)
        return f"SUPPLIER {x % 2}"

    batch = spark.range(0, 10, 1, 1).select(
        F.col("id").alias("submission_id"), F.lit(1).cast("long").alias("card_id"), F.lit(D0).alias("txn_date"), F.lit("purchase").alias("kind"),
        F.lit(5).cast("decimal(18,2)").alias("amount"), udf(named, "string")("id").alias("supplier"),
        F.lit("2026-01-01 09:00:00").cast("timestamp_ntz").alias("submitted_at"))
    got = apply_submissions(txn(spark, [{"amount": -1, "day": D0}]), batch).collect()
    assert sorted(r.occurrence for r in got) == sorted([1, 2, 3, 4, 5] * 2)
    # Once for the judgement and once for the row.
    assert seen.value <= 20


def test_the_moments_of_a_signature_are_kept_packed():
    import pandas as pd

    class Kept:
        values = []

        def get(self):
            return iter(self.values)

        def put(self, values):
            self.values = values

    verdicts = ST._Verdicts(10, None)
    verdicts.held = Kept()
    give = lambda at: pd.concat(verdicts.handleInputRows(("s",), iter([pd.DataFrame(
        {"at": at, "submission_id": at, "allow": [a == 25 for a in at]})]), None))
    told = give(list(range(2, 1000, 2)) + [25])
    assert len(verdicts.held.values) == 1
    assert set(told.submission_id[told.accepted][told.submission_id < 40]) == {2, 12, 22, 25, 36}
    # A late one turns the verdicts behind it, and only those are given again.
    again = give([1])
    assert {(i, a) for i, a in zip(again.submission_id, again.accepted) if i < 30} == {(1, True), (2, False)}
    assert set(again.change) == {2}


def test_every_part_of_the_extract_is_named(spark):
    from tallywise.operators import reports as R
    t, a = txn(spark, [{"amount": -1, "day": D0, "currency": "EUR", "original_amount": 2}]), acct(spark)
    for c in ("date_repaired",):
        t = t.withColumn(c, F.lit(False))
    parts = {r.part for r in R.sample_extract(t, B.account_balances(t, a), B.spend_by_currency(t, a)).select("part").distinct().collect()}
    assert parts == set(R.EXTRACT_PARTS)


def test_amounts_without_a_slip_in_reach_are_not_dealt_into_cells(spark):
    amounts = spark.createDataFrame([(1, "X", 100_000), (1, "X", 800_000), (2, "X", 60_000), (2, "X", 600_000), (2, "X", 250_000)],
                                    "card_id long, supplier string, cents long")
    big, small = Q._amount_cells(amounts)
    assert {tuple(r) for r in big.select("card_id", "big", "factor").collect()} == {(2, 600_000, 10)}
    assert {tuple(r) for r in small.select("card_id", "small", "factor").collect()} == {(2, 60_000, 10)}
    assert [tuple(r) for r in Q._amount_pairs(amounts).collect()] == [(2, "X", 600_000, 60_000, 10)]
