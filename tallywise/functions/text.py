"""Text rules: blanks, suppliers, narratives, references, searching."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space in the pasted sheets includes non-breaking spaces.
WS = r"(?U)\s"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often it is named.

    Deep text rules name their input many times over; spelled out, the expression
    outgrows what one compiled method may hold.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(col: Column) -> Column:
    """Trim, counting every Unicode white space."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def text_or_empty(col: Column) -> Column:
    return F.coalesce(squeeze(col.cast("string")), F.lit(""))


def is_blank(col: Column) -> Column:
    return text_or_empty(col) == ""


def edited_text(new: Column, old: Column) -> Column:
    """Null keeps the old value, blank clears it, anything else replaces it."""
    return (F.when(new.isNull(), old)
            .when(F.trim(new) == "", F.lit(None).cast("string"))
            .otherwise(F.trim(new)))


def one_line(col: Column) -> Column:
    """White space runs collapsed to one space; null where nothing is left."""
    flat = squeeze(F.regexp_replace(col, WS + "+", " "))
    return F.when(flat == "", None).otherwise(flat)


def country_code(col: Column) -> Column:
    """The three digits a card network appends to a merchant name."""
    code = F.regexp_extract(col, r"(?U)\s(\d{3})\s*$", 1)
    return F.when(code == "", None).otherwise(code)


def without_country(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)\s\d{3}\s*$", "")


def split_supplier(col: Column) -> Column:
    """struct(name, country, raw) of a merchant cell."""
    raw = one_line(col)
    return F.struct(
        squeeze(without_country(raw)).alias("name"),
        country_code(raw).alias("country"),
        raw.alias("raw"),
    )


def _lines(col: Column) -> Column:
    return F.filter(F.transform(F.split(col, r"\r?\n"), squeeze), lambda x: x != "")


def voucher_of(col: Column) -> Column:
    """The bank's own reference: the last line that is letters then digits."""
    hits = F.filter(_lines(col), lambda x: x.rlike(r"^[A-Z]{3,5}\d{4,6}$"))
    return F.get(F.reverse(hits), F.lit(0))


# Lines a bank prints about the statement, not the transaction.
STATEMENT_NOISE = (r"(?i)^value date\s*:|^incoming instant payment$"
                   r"|^system generated$|^sab icorp$")


def is_narrative(col: Column) -> Column:
    """A bank narrative has several lines; a merchant name has one."""
    return squeeze(F.coalesce(col, F.lit(""))).contains("\n")


def _flatten(col: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(col, r"[^\p{L}\p{N}]+", " ")))


def supplier_key(col: Column) -> Column:
    """The spelling two rows are compared by.

    A narrative is named by its voucher, or else by what remains without the
    noise lines.  A merchant name loses its country code and punctuation.
    """
    def narrative(raw: Column) -> Column:
        told = lambda lines: _flatten(F.array_join(F.filter(lines, lambda x: ~x.rlike(STATEMENT_NOISE)), " "))
        named = lambda lines: F.get(F.reverse(F.filter(lines, lambda x: x.rlike(r"^[A-Z]{3,5}\d{4,6}$"))), F.lit(0))
        return let(_lines(raw), lambda lines: F.coalesce(
            F.concat(F.lit("voucher:"), F.lower(named(lines))), told(lines)))

    return let(F.coalesce(col, F.lit("")), lambda raw: F.when(raw.contains("\n"), narrative(raw)).otherwise(
        _flatten(F.regexp_replace(raw, r"(?U)\s+\d{3}\s*$", ""))))


def bank_charge_line(narrative: Column) -> Column:
    """The bank's own first line says this is a charge (its C may be lost)."""
    first = F.get(F.split(F.coalesce(narrative, F.lit("")), r"\r?\n"), F.lit(0))
    return first.rlike(r"(?i)^\s*c?harges(\s+and\s+fees)?\s*$")


def bank_charge_reference(narrative: Column, reference: Column, account_type: Column) -> Column:
    """``BAC`` on an unreferenced charge line of a bank account, else unchanged."""
    return F.when(
        is_blank(reference) & F.coalesce(account_type == "bank_account", F.lit(False))
        & bank_charge_line(narrative), F.lit("BAC")).otherwise(reference)


def is_bac(reference: Column) -> Column:
    return F.upper(text_or_empty(reference)) == "BAC"


def reference_from(customer: Column, workflow: Column) -> Column:
    """struct(reference, note): the reference column, or a workflow that says bac."""
    customer, workflow = text_or_empty(customer), text_or_empty(workflow)
    bac = workflow.rlike("(?i)^bac$")
    return F.struct(
        F.when(customer != "", customer).when(bac, workflow).alias("reference"),
        F.when((workflow != "") & ~bac, workflow).alias("note"),
    )


def workflow_note(notes: Column) -> Column:
    """The text kept behind ``sheet note:``, up to the next part of the note."""
    return F.trim(F.regexp_extract(F.coalesce(notes, F.lit("")), r"sheet note: (.*?)(?: — |$)", 1))


def is_placeholder(narrative: Column) -> Column:
    """The words written when a sheet had no description at all."""
    return F.coalesce(narrative, F.lit("")).rlike(r"^\(no description on the .* sheet, row \d+\)$")


def is_settled_line(amount: Column, reference: Column) -> Column:
    """Money in, or money out against a real reference."""
    return (amount > 0) | (~is_blank(reference) & ~is_bac(reference))


def money_in_kind(text: Column) -> Column:
    refund = (r"(?i)\b(refund(ed|s)?|reversal|reversed|charge\s*back|chargeback"
              r"|credit\s*note|cancell?ation)\b")
    return F.when(F.coalesce(text, F.lit("")).rlike(refund), F.lit("refund")).otherwise(F.lit("funding"))


def query_terms(query: str) -> list[str]:
    """Terms of a search box: white-space separated, quoted phrases whole."""
    found = re.findall(r'"[^"]+"|\S+', query.strip().lower())
    return [re.sub(r'^"|"$', "", t) for t in found]


def matches_query(haystack: Column, query: str) -> Column:
    """Every term of the query occurs in the (lower-case) haystack."""
    terms = query_terms(query)
    if not terms:
        return F.lit(True)
    # Bound once: apart, each term's condition would put the haystack together anew.
    return let(haystack, lambda h: F.forall(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(h, t)))
