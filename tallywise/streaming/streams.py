"""Submissions, statements and decisions as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.dates import month_key
from ..operators.balances import _sum_if
from ..operators.edits import apply_submissions, decision_log, judge_decisions
from ..operators.matching import classify_duplicates
from ..plans.scan import Measure, place, scan, unplaced
from ..schema import SOURCE

SIGNATURE = ["card_id", "txn_date", "kind", "amount", "supplier", "payment_ref", "req_number"]


def _signed(batch: DataFrame) -> DataFrame:
    """One text per submission that equal submissions share."""
    have = [c for c in SIGNATURE if c in batch.columns]
    return batch.withColumn("_sig", F.concat_ws("|", *[
        F.upper(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in have]))


def suppress_double_submits(batch: DataFrame, seconds: int = 120) -> DataFrame:
    """Drop a submission equal to one accepted less than ``seconds`` before it.

    A dropped submission does not extend the window; ``allow_duplicate`` is
    always accepted.  Equal moments are folded first, then a signature is cut
    wherever nothing came in for the whole window: what follows such a pause is
    accepted whatever came before.  Only the moments inside one uninterrupted
    stretch are walked in order.
    """
    rows = _signed(batch)
    allow = F.coalesce(F.col("allow_duplicate"), F.lit(False))
    micros = F.unix_micros(F.col("submitted_at").cast("timestamp"))
    rows = rows.withColumns({"_at": micros, "_allow": allow})
    moments = rows.groupBy("_sig", "_at").agg(F.max("_allow").alias("_any"), F.min(
        F.when(~F.col("_allow"), F.col("submission_id"))).alias("_first"))
    window = seconds * 1_000_000
    spaced = scan(place(moments, ["_sig"], ["_at"]), ["_sig"], ["_at"], [Measure("_before", "prev", F.col("_at"), "bigint")])
    spaced = spaced.withColumn("_cut", F.when(F.coalesce(F.col("_at") - F.col("_before") >= window, F.lit(True)), 1).otherwise(0))
    stretches = scan(spaced, ["_sig"], ["_at"], [Measure("_stretch", "sum", F.col("_cut"), "bigint")])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        last, open_ = None, []
        for at, any_allow in zip(pdf["_at"], pdf["_any"]):
            free = last is None or at - last >= window
            open_.append(free)
            if free or any_allow:
                last = at
        return pdf[["_sig", "_at", "_first"]].assign(_open=open_)

    lone = F.count(F.lit(1)).alias("_n")
    sizes = stretches.groupBy("_sig", "_stretch").agg(lone)
    sized = stretches.join(sizes, ["_sig", "_stretch"])
    # A moment with no neighbour inside the window needs no walking.
    single = sized.filter("_n = 1").select("_sig", "_at", "_first", F.lit(True).alias("_open"))
    walked = sized.filter("_n > 1").select("_sig", "_stretch", "_at", "_any", "_first") \
        .groupBy("_sig", "_stretch").applyInPandas(walk, "_sig string, _at bigint, _first bigint, _open boolean")
    judged = rows.join(single.unionByName(walked), ["_sig", "_at"])
    kept = F.col("_allow") | (F.col("_open") & (F.col("submission_id") == F.col("_first")))
    return judged.filter(kept).select(*batch.columns)


#: A moment as it is kept; ``accepted`` is -1 before the first verdict.
_MOMENT = np.dtype([("at", "<i8"), ("id", "<i8"), ("change", "<i8"), ("allow", "?"), ("accepted", "i1")])
#: Moments packed into one value of state.
_PACKED = 65_536


class _Verdicts(StatefulProcessor):
    """All submissions of one signature in order of their moments, judged anew where a late one comes between."""

    def __init__(self, window: int, remember: int | None) -> None:
        self.window, self.remember = window, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Read and written for each batch: packed, a signature costs a few values instead of one for each moment.
        self.held = handle.getListState("held", "moments binary", self.remember)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        parts = [np.frombuffer(r[0], _MOMENT) for r in self.held.get()]
        for pdf in rows:
            new = np.empty(len(pdf), _MOMENT)
            new["at"], new["id"] = pdf["at"].astype("int64"), pdf["submission_id"].astype("int64")
            new["allow"], new["accepted"], new["change"] = pdf["allow"].astype("bool"), -1, 0
            parts.append(new)
        held = np.concatenate(parts)
        held = held[np.lexsort((held["id"], held["at"]))]
        moments, starts, of = np.unique(held["at"], return_index=True, return_inverse=True)
        allowed = np.logical_or.reduceat(held["allow"], starts)
        first = np.minimum.reduceat(np.where(held["allow"], np.iinfo(np.int64).max, held["id"]), starts)
        last, open_ = None, []
        for at, any_allow in zip(moments.tolist(), allowed.tolist()):
            free = last is None or at - last >= self.window
            open_.append(free)
            if free or any_allow:
                last = at
        accepted = held["allow"] | (np.array(open_)[of] & (held["id"] == first[of]))
        changed, change = accepted != held["accepted"], int(held["change"].max()) + 1
        held["accepted"] = accepted
        held["change"][changed] = change
        self.held.put([(held[i:i + _PACKED].tobytes(),) for i in range(0, len(held), _PACKED)])
        yield pd.DataFrame({"submission_id": held["id"][changed], "accepted": accepted[changed], "change": change})

    def close(self) -> None:
        pass


def judge_submissions_stream(stream: DataFrame, seconds: int = 120, remember_ms: int | None = None) -> DataFrame:
    """The rule of ``suppress_double_submits`` on a stream, as a log of verdicts: ``submission_id, accepted, change``.

    A verdict is given as soon as a submission arrives.  One that arrives late may turn
    verdicts behind it, and those are then given again with a higher ``change``: the last
    verdict of each submission (``accepted_submissions``) is what the batch says, in
    whatever order the submissions came.  None is discarded for being late.

    State lives in RocksDB (the session must name that provider): the moments of a
    signature, for ``remember_ms`` after it was last written, or for good.  A signature is
    judged in one task, and each batch walks those that it touches.
    """
    allow = F.coalesce(F.col("allow_duplicate"), F.lit(False))
    # The names reach Python as fields of a tuple, which cannot begin with an underscore.
    rows = _signed(stream).select(F.col("_sig").alias("sig"), "submission_id", allow.alias("allow"),
                                  F.unix_micros(F.col("submitted_at").cast("timestamp")).alias("at"))
    return rows.groupBy("sig").transformWithStateInPandas(
        _Verdicts(seconds * 1_000_000, remember_ms), "submission_id long, accepted boolean, change long", "Append",
        "None" if remember_ms is None else "ProcessingTime")


def accepted_submissions(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The submissions whose last verdict accepts them."""
    last = verdicts.groupBy("submission_id").agg(F.max_by("accepted", "change").alias("_accepted"))
    return rows.join(last.filter("_accepted").select("submission_id"), "submission_id", "left_semi")


# ------------------------------------------------------------- foreachBatch

def _parts(spark: SparkSession, path: str, schema: Any) -> DataFrame:
    """A table kept as one folder per batch; empty before the first one."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def incremental_import(ledger_path: str, to_batch: Callable[[DataFrame], DataFrame], ledger_schema) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: only the copies the ledger lacks are appended.

    ``to_batch`` turns import rows into submissions.  Each micro-batch writes its
    own folder, so a repeated one replaces what it wrote before and the ledger
    read for the comparison leaves that folder out.
    """
    def step(lines: DataFrame, batch_id: int) -> None:
        spark = lines.sparkSession
        # Micro-batches run one after another; later folders do not exist yet.
        ledger = _parts(spark, ledger_path, ledger_schema).filter(
            ~F.contains(F.col("_metadata.file_path"), F.lit(f"/batch={batch_id:010d}/")))
        known = classify_duplicates(lines, ledger)
        fresh = known.filter(F.col("outcome").isin("new", "missing_copy"))
        added = apply_submissions(ledger, to_batch(fresh))
        keep = [f.name for f in ledger_schema.fields]
        out = added.select(*[F.col(c) if c in added.columns else F.lit(None).alias(c) for c in keep])
        typed = out.select(*[F.col(f.name).cast(f.dataType) for f in ledger_schema.fields])
        typed.write.mode("overwrite").parquet(f"{ledger_path}/batch={batch_id:010d}")
    return step


def ledger_events(log_path: str, ledger: Callable[[SparkSession], DataFrame],
                  acct: Callable[[SparkSession], DataFrame], log_schema: Any) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function folding review decisions into an append-only log.

    Each batch sees the status that the decisions of earlier batches left, so
    ``from_status`` is right from the second batch on.  Only the rows it decides on are
    looked up, in the ledger and in the log.  A repeated batch replaces its own folder
    and does not see what it wrote before.
    """
    def step(decisions: DataFrame, batch_id: int) -> None:
        spark = decisions.sparkSession
        named = decisions.select("transaction_id").distinct()
        log = _parts(spark, log_path, log_schema).filter(
            ~F.contains(F.col("_metadata.file_path"), F.lit(f"/batch={batch_id:010d}/")))
        asked = lambda df: df.join(named, "transaction_id", "left_semi")
        now = current_status(asked(ledger(spark)), asked(log))
        judged = judge_decisions(now, acct(spark), decisions)
        decision_log(judged).write.mode("overwrite").parquet(f"{log_path}/batch={batch_id:010d}")
    return step


def current_status(ledger: DataFrame, log: DataFrame) -> DataFrame:
    """Each row's status after the last decision on record."""
    last = log.groupBy("transaction_id").agg(F.max_by("to_status", "decision_id").alias("_to"))
    return ledger.join(last, "transaction_id", "left").withColumn("status", F.coalesce("_to", "status")).drop("_to")


def monthly_activity_stream(stream: DataFrame, acct: DataFrame) -> DataFrame:
    """Spend and funding per settlement currency and month, for update mode.

    No watermark: a row dated long ago belongs to its month and is never dropped.
    State holds one line per currency and month.
    """
    rows = stream.filter((F.col("entry_type") == SOURCE) & F.col("txn_date").isNotNull() & (F.col("status") != "voided"))
    return rows.join(acct.select("card_id", "settlement_currency"), "card_id").groupBy(
        "settlement_currency", month_key(F.col("txn_date")).alias("month")).agg(
        _sum_if(F.col("direction") == "spend").alias("spend"), _sum_if(F.col("direction") == "funding").alias("funding"))
