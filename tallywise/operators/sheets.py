"""Understanding raw sheets, many files at once.

``cells`` is the long form every reader gives: ``file, sheet, row, col, text``
and, where the file has formulas, ``formula``.  Rows and columns count from 1.
All operators group by ``(file, sheet)``; a sheet's facts are aggregates with a
partial step, so a sheet with a third of all rows costs no more per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import parse_amount
from ..functions.dates import parse_date, proves_day_first, proves_month_first
from ..functions.text import let, one_line, squeeze

SHEET = ["file", "sheet"]

# Words that mark a header row.
HEADER_HINTS = [
    r"\bdate\b", r"\bdetails?\b", r"\bsupplier\b", r"\bdebit\b", r"\bcredit\b", r"\bbalance\b",
    r"\bcurrency\b", r"\bdescription\b", r"\bamount\b", r"\breq", r"\blpo\b", r"\binvoice\b",
    r"\bpayment\b", r"\bconversion\b", r"\bsr\.?\s*no\b", r"\bparticulars?\b",
    r"\btransaction\s*type\b", r"\bvalue\s*date\b", r"\bnarration\b",
]

# Which heading means which field; the first that fits wins.
FIELD_NAMES = [
    ("date", r"^payment\s*date$"),
    ("supplier", r"^beneficiary(\s*name)?$"),
    ("currency", r"^payment\s*currency$"),
    ("original_amount", r"^payment\s*amount$"),
    ("req_number", r"^customer\s*reference$"),
    ("settlement_currency", r"^local\s*currency$"),
    ("decrease", r"^amount\s*in\s*local\s*currency$"),
    ("date", r"^(transaction\s*date|date|txn\s*date|value\s*date)$"),
    ("supplier", r"^(details?|supplier\s*name|supplier|description|narration|merchant"
                 r"|transaction\s*particulars?|describtion)$"),
    ("currency", r"^(original\s*currency|currency|ccy|fx\s*currency)$"),
    ("original_amount", r"^(amount|original\s*amount|foreign\s*amount)$"),
    ("rate", r"^(conversion(\s*rate)?|exchange\s*rate(\s*\(source\))?|rate|fx\s*rate)$"),
    ("crm", r"^crm$"),
    ("account", r"^account$"),
    ("req_number", r"^(req(uest)?\s*(number|no\.?|#)?|reference\s*number)$"),
    ("lpo_number", r"^(lpo.*number.*|lpo|je\s*number)$"),
    ("invoice", r"^(invoice|supplier\s*invoice.*)$"),
    ("payment_ref", r"^(payment\s*reference.*|payment\s*ref\.?|payment\s*made)$"),
    ("client", r"^client$"),
    ("sales_operation", r"^sales\s*operation$"),
    ("notes", r"^(notes?|debit\s*notes|comments?|remarks?|commissionable.*)$"),
    ("amount_abs", r"^transaction\s*amount$"),
    ("txn_type", r"^(transaction\s*type|dr\s*/?\s*cr)$"),
    ("ledger_id", r"^(ledger\s*id|transaction\s*id|id)$"),
    ("signed_amount", r"^(amount\s*\(aed\)|aed|aed\s*amount|signed\s*amount|aed\s*settlement)$"),
]


#: For each hint, letters that every text it fits contains; looking for those is much cheaper.
HINT_CORES = ["date", "detail", "supplier", "debit", "credit", "balance", "currency", "description", "amount", "req", "lpo", "invoice",
              "payment", "conversion", "sr", "particular", "transaction", "date", "narration"]


def _plain_first(text: Column) -> Column:
    return F.ascii(text).between(33, 126)


def _filled(cells: DataFrame) -> DataFrame:
    text = F.col("text")
    # Most cells begin and end in plain characters and have nothing to trim.
    trimmed = F.when(_plain_first(text) & _plain_first(F.right(text, F.lit(1))), text).otherwise(squeeze(F.coalesce(text, F.lit(""))))
    return cells.withColumn("_t", trimmed).filter("_t <> ''")


def detect_header(cells: DataFrame) -> DataFrame:
    """The row with the most header words, less its numbers.

    A header has at least three cells and a score of three; the earliest wins a
    tie.  All rows are scored, so a header may stand anywhere.
    """
    t = F.col("_t")
    low = F.lower(t)
    words = F.lit(0)
    for hint, core in zip(HEADER_HINTS, HINT_CORES):
        words = words + F.when(low.contains(core) & t.rlike("(?i)" + hint), 1).otherwise(0)
    # A row full of numbers is data, whatever words it holds.
    number = t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    # A number has no letters for a hint to fit.
    points = F.when(number, -1).when(t.rlike("[A-Za-z]{2}"), words).otherwise(0)

    scored = _filled(cells).groupBy(*SHEET, "row").agg(F.count(F.lit(1)).alias("n"), F.sum(points).alias("score"))
    good = scored.filter("n >= 3 AND score >= 3")
    return good.groupBy(*SHEET).agg(
        F.max_by("row", F.struct(F.col("score"), -F.col("row"))).alias("header_row"), F.max("score").alias("score"))


def header_cells(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """The headings: ``file, sheet, col, heading`` with white space flattened."""
    top = cells.join(headers.select(*SHEET, F.col("header_row").alias("row")), SHEET + ["row"])
    heading = one_line(F.col("text"))
    # Spark tests this on all cells before it looks for the header's, so the cheap half comes first.
    return top.filter(_plain_first(F.col("text")) | heading.isNotNull()).select(*SHEET, "col", heading.alias("heading"))


def map_columns(headings: DataFrame) -> DataFrame:
    """What each column means: ``field``, first column first.

    DEBIT, CREDIT and BALANCE are kept as what they say; which of the first two
    lowers the balance is decided by ``bind_direction``.
    """
    def meaning(h: Column) -> Column:
        alias = F.lit(None).cast("string")
        for name, pattern in reversed(FIELD_NAMES):
            alias = F.when(h.rlike("(?i)" + pattern), F.lit(name)).otherwise(alias)
        return (F.when(h.rlike(r"(?i)\bbalance\b"), "statement_balance")
                .when(h.rlike(r"(?i)\bdebit\b") & ~h.rlike("(?i)notes?"), "debit")
                .when(h.rlike(r"(?i)\bcredit\b"), "credit").otherwise(alias))

    # As an aggregate, or Spark would work it out for every cell to filter on it before the header is looked up.
    field = F.min(let(F.col("heading"), meaning))
    named = headings.groupBy(*SHEET, "col", "heading").agg(field.alias("field")).filter("field IS NOT NULL")
    return named.groupBy(*SHEET, "field").agg(F.min("col").alias("col"), F.min_by("heading", "col").alias("heading"))


def _body(cells: DataFrame, headers: DataFrame) -> DataFrame:
    return _filled(cells).join(headers.select(*SHEET, "header_row"), SHEET).filter(F.col("row") > F.col("header_row"))


def find_date_column(cells: DataFrame, headers: DataFrame, taken: DataFrame) -> DataFrame:
    """A column that is dates by its contents: four in five of its cells, three at least.

    ``taken`` holds ``file, sheet, col`` already understood.
    """
    rows = _body(cells, headers)
    free = rows.join(taken.select(*SHEET, "col").distinct(), SHEET + ["col"], "left_anti")
    hit = parse_date(F.col("_t"), F.lit(True))["iso"].isNotNull()
    per = free.groupBy(*SHEET, "col").agg(F.count(F.lit(1)).alias("filled"), F.count_if(hit).alias("hits"))
    good = per.filter((F.col("filled") >= 3) & (F.col("hits") >= F.col("filled") * 0.8))
    return good.groupBy(*SHEET).agg(F.max_by("col", F.struct(F.col("hits"), -F.col("col"))).alias("col"))


def bind_direction(mapping: DataFrame, sheet_accounts: DataFrame) -> DataFrame:
    """DEBIT and CREDIT turned into ``decrease`` and ``increase``.

    ``sheet_accounts`` holds ``file, sheet, decreasing_header``: the account's own
    word for the column that lowers its balance.  Where none is recorded, DEBIT
    is money out, as on a bank statement.
    """
    m = mapping.join(sheet_accounts.select(*SHEET, "decreasing_header"), SHEET, "left")
    recorded = squeeze(F.coalesce("decreasing_header", F.lit("")))
    debit_lowers = (recorded == "") | recorded.rlike(r"(?i)\bdebit\b")
    field = (F.when(F.col("field") == "debit", F.when(debit_lowers, "decrease").otherwise("increase"))
             .when(F.col("field") == "credit", F.when(debit_lowers, "increase").otherwise("decrease"))
             .otherwise(F.col("field")))
    return m.select(*SHEET, field.alias("field"), "col", "heading")


def overrule_direction(mapping: DataFrame, raw_mapping: DataFrame, votes: DataFrame) -> DataFrame:
    """The sheet's own balance column has the last word on direction.

    ``votes`` is ``balance_voting``'s result, ``raw_mapping`` is ``map_columns``'s.
    """
    settled = votes.filter("lowers IS NOT NULL").select(*SHEET, "lowers")
    two = raw_mapping.filter("field IN ('debit', 'credit')").join(settled, SHEET)
    said = two.select(*SHEET, F.when(F.col("field") == F.col("lowers"), "decrease").otherwise("increase").alias("field"),
                      "col", "heading")
    rest = mapping.join(said.select(*SHEET, "field").distinct(), SHEET + ["field"], "left_anti")
    return rest.unionByName(said)


def direction_from_formula(formulas: DataFrame) -> DataFrame:
    """Which money column a sheet's balance formula subtracts.

    ``formulas`` holds ``file, sheet, row, formula, first_col, second_col`` (the
    letters of the two money columns).  A sheet with more than one sign pattern
    is reported as ``mixed``; the most frequent pattern decides.
    """
    sign = lambda c: F.call_function("regexp_extract", F.col("formula"), F.concat(
        F.lit(r"([+-])\s*"), F.col(c), F.lit(r"\d+")), F.lit(1))
    signed = formulas.filter(F.col("formula").startswith("=")).withColumns(
        {"_a": sign("first_col"), "_b": sign("second_col")}).filter("_a <> '' AND _b <> ''")
    shapes = signed.groupBy(*SHEET, "first_col", "second_col", "_a", "_b").agg(F.count(F.lit(1)).alias("n"),
                                                                              F.min("row").alias("first_row"))
    best = shapes.groupBy(*SHEET, "first_col", "second_col").agg(
        F.max_by(F.struct("_a", "_b"), F.struct(F.col("n"), -F.col("first_row"))).alias("s"),
        F.count(F.lit(1)).alias("patterns"), F.sum("n").alias("formulas"))
    down = (F.when((F.col("s._a") == "-") & (F.col("s._b") == "+"), F.col("first_col"))
            .when((F.col("s._a") == "+") & (F.col("s._b") == "-"), F.col("second_col")))
    up = F.when(down == F.col("first_col"), F.col("second_col")).when(down.isNotNull(), F.col("first_col"))
    return best.select(
        *SHEET, down.alias("decreasing_column"), up.alias("increasing_column"), "formulas",
        F.when(F.col("patterns") > 1, "mixed_balance_formula").when(down.isNull(), "unreadable_direction").alias("anomaly"))


def reference_column(cells: DataFrame, headers: DataFrame, mapping: DataFrame, headings: DataFrame) -> DataFrame:
    """The request column: the mapped one if it holds anything, else a filled one with a fitting name."""
    filled = _body(cells, headers).groupBy(*SHEET, "col").agg(F.count(F.lit(1)).alias("filled"))
    mapped = mapping.filter("field = 'req_number'").select(*SHEET, "col").join(filled, SHEET + ["col"], "left")
    kept = mapped.filter("filled > 0").select(*SHEET, "col", F.lit("named").alias("chosen_by"))
    others = headings.filter(F.col("heading").rlike(r"(?i)^(customer|reference|ref\.?)$")) \
        .join(mapping.select(*SHEET, "col").distinct(), SHEET + ["col"], "left_anti").join(filled, SHEET + ["col"])
    instead = others.join(kept.select(*SHEET), SHEET, "left_anti").groupBy(*SHEET).agg(F.min("col").alias("col")) \
        .withColumn("chosen_by", F.lit("content"))
    return kept.unionByName(instead)


def column_letters(col: Column) -> Column:
    """1 → A, 27 → AA (three letters at most, as spreadsheets have)."""
    letter = lambda n: F.char(n + 65)
    one = letter((col - 1) % 26)
    two = letter((F.floor((col - 1) / 26) - 1) % 26)
    three = letter((F.floor((col - 27) / 676) - 1) % 26)
    return F.when(col <= 26, one).when(col <= 702, F.concat(two, one)).otherwise(F.concat(three, two, one))


def find_balance_column(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Columns that carry a running balance, the account's own marked ``chosen``.

    A running balance refers to the cell above it, or opens with a literal.  A
    column headed BALANCE beats one with more formulas; a further chain with
    three formulas or more is reported as ``secondary``.
    """
    letter = column_letters(F.col("col"))
    f = F.col("formula")
    body = cells.filter(f.startswith("=")).join(headers.select(*SHEET, "header_row"), SHEET) \
        .filter(F.col("row") > F.col("header_row"))
    above = F.concat(F.lit(r"(?<![A-Z0-9])"), letter, (F.col("row") - 1).cast("string"), F.lit(r"(?![0-9])"))
    refers = F.regexp_like(f, above)
    seeded = ~refers & f.rlike(r"^=\s*[\d.]+\s*[-+]") & f.rlike(r"[A-Z]+\d+")
    per = body.groupBy(*SHEET, "col").agg(F.count_if(refers).alias("refers"), F.count_if(seeded).alias("seeded")) \
        .withColumn("formulas", F.when(F.col("refers") > 0, F.col("refers")).otherwise(F.col("seeded"))).filter("formulas > 0")
    top = cells.join(headers.select(*SHEET, F.col("header_row").alias("row")), SHEET + ["row"]) \
        .select(*SHEET, "col", F.lower(F.coalesce("text", F.lit(""))).contains("balance").alias("headed"))
    ranked = per.join(top, SHEET + ["col"], "left").withColumn("headed", F.coalesce("headed", F.lit(False)))
    rank = F.struct(F.col("headed"), F.col("formulas"), -F.col("col"))
    best = ranked.groupBy(*SHEET).agg(F.max_by("col", rank).alias("_best"))
    out = ranked.join(best, SHEET)
    return out.select(*SHEET, "col", column_letters(F.col("col")).alias("letter"), "formulas", "headed",
                      F.when(F.col("col") == F.col("_best"), "chosen").when(F.col("formulas") >= 3, "secondary")
                      .otherwise("ignored").alias("role"), (F.col("refers") == 0).alias("opening_in_formula"))


def money_columns(cells: DataFrame, balance: DataFrame) -> DataFrame:
    """The two columns of its own row a balance formula refers to most."""
    chosen = balance.filter("role = 'chosen'").select(*SHEET, "col", F.col("letter").alias("_bal"))
    f = cells.filter(F.col("formula").startswith("=")).join(chosen, SHEET + ["col"])
    refs = f.select(*SHEET, "row", "_bal", F.explode(F.regexp_extract_all("formula", F.lit(r"([A-Z]+\d+)"), 1)).alias("ref"))
    own = refs.withColumns({"letter": F.regexp_extract("ref", "^([A-Z]+)", 1),
                            "_at": F.regexp_extract("ref", r"(\d+)$", 1).cast("bigint")}) \
        .filter((F.col("_at") == F.col("row")) & (F.col("letter") != F.col("_bal")))
    counted = own.groupBy(*SHEET, "letter").agg(F.count(F.lit(1)).alias("n"))
    # As many rows per sheet as it has columns: a small top-2.
    from pyspark.sql import Window
    w = Window.partitionBy(*SHEET).orderBy(F.desc("n"), "letter")
    return counted.withColumn("place", F.row_number().over(w)).filter("place <= 2")


def statement_header(cells: DataFrame) -> DataFrame:
    """A statement's labelled facts and its summary line, and whether the line adds up.

    Labels are read by what they say: the value of a fact stands one cell to the
    right, the value of a summary figure one cell below.
    """
    t = _filled(cells).select(*SHEET, "row", "col", "_t")
    low = F.lower(F.col("_t"))
    fact = (F.when(low.startswith("account number"), "account_number").when(low.startswith("currency"), "currency"))
    figure = (F.when(low.isin("number of transaction", "number of transactions"), "transactions").when(low == "credit value", "credit_value")
              .when(low == "debit value", "debit_value").when(low == "opening balance", "opening")
              .when(low == "closing balance", "closing"))
    # One look at how a cell begins spares all others the comparisons.
    begins = F.col("_t").rlike("(?i)^(account number|currency|number of|credit value|debit value|opening balance|closing balance)")
    labels = t.filter(begins).withColumns({"fact": fact, "figure": figure}).filter("fact IS NOT NULL OR figure IS NOT NULL")
    value = t.select(*SHEET, F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("_t").alias("value"))
    at_row = F.when(F.col("fact").isNotNull(), F.col("row")).otherwise(F.col("row") + 1)
    at_col = F.when(F.col("fact").isNotNull(), F.col("col") + 1).otherwise(F.col("col"))
    met = labels.withColumns({"_r": at_row, "_c": at_col}).join(value, SHEET + ["_r", "_c"])
    first = lambda col, name: F.min_by(F.when(F.col(col) == name, F.col("value")), F.when(F.col(col) == name, F.struct("row", "col")))
    out = met.groupBy(*SHEET).agg(
        first("fact", "account_number").alias("account_number"), first("fact", "currency").alias("currency"),
        *[parse_amount(first("figure", n)).cast("decimal(18,2)").alias(n)
          for n in ("transactions", "credit_value", "debit_value", "opening", "closing")])
    from_re = r"From:\s*(\d{2})/(\d{2})/(\d{4})"
    began = t.filter(F.col("_t").contains("From:") & F.col("_t").rlike(from_re)).groupBy(*SHEET).agg(F.min_by(
        F.concat_ws("-", F.regexp_extract("_t", from_re, 3), F.regexp_extract("_t", from_re, 2), F.regexp_extract("_t", from_re, 1)),
        F.struct("row", "col")).alias("_from"))
    gap = F.col("opening") + F.col("credit_value") - F.col("debit_value") - F.col("closing")
    return out.join(began, SHEET, "left").withColumns({
        "period_start": F.col("_from").try_cast("date"),
        "adds_up": F.coalesce(F.abs(gap) < F.lit(0.005).cast("decimal(4,3)"), F.lit(False))}).drop("_from")


def infer_day_first(rows: DataFrame, keys: Sequence[str], text: str = "date_text") -> DataFrame:
    """One value above 12 settles a whole column; two that disagree are a conflict."""
    d, m = proves_day_first(F.col(text)), proves_month_first(F.col(text))
    per = rows.groupBy(*keys).agg(F.bool_or(d).alias("_d"), F.bool_or(m).alias("_m"))
    return per.select(*keys, (~(F.col("_m") & ~F.col("_d"))).alias("day_first"), (F.col("_d") & F.col("_m")).alias("conflict"),
                      (F.col("_d") | F.col("_m")).alias("proven"))


def sheet_rows(cells: DataFrame, headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """The body of each sheet with its fields by name: ``file, sheet, row`` and one
    text column per field (null where the sheet has no such column)."""
    named = _body(cells, headers).join(mapping.select(*SHEET, "col", "field"), SHEET + ["col"])
    fields = sorted({n for n, _ in FIELD_NAMES} | {"statement_balance", "increase"})
    return named.groupBy(*SHEET, "row").agg(*[F.min(F.when(F.col("field") == f, F.col("_t"))).alias(f) for f in fields])
