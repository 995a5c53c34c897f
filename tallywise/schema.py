"""Value sets, types and tolerances shared by every operator."""

from __future__ import annotations

# Two money figures closer than this are the same figure.
TOLERANCE = 0.005

MONEY = "decimal(18,2)"
MONEY_SUM = "decimal(28,2)"
ORIGINAL = "decimal(18,4)"
RATE = "decimal(20,10)"
PARSED_NUMBER = "decimal(38,18)"

SOURCE = "source_transaction"
ADJUSTMENT = "reconciliation_adjustment"
ENTRY_TYPES = [SOURCE, ADJUSTMENT]

STATUSES = ["confirmed", "needs_review", "excluded_from_source_balance", "voided"]
DIRECTIONS = ["spend", "funding"]

BASE_CURRENCY = "AED"

# The codes in use by ISO 4217.  A ``currencies`` table passed by a
# caller replaces them.
ISO_CURRENCIES = (
    "AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL BSD BTN BWP BYN BZD CAD CDF CHF "
    "CLP CNY COP CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HTG "
    "HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA "
    "MKD MMK MNT MOP MRU MUR MVR MWK MXN MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD "
    "RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX "
    "USD UYU UZS VES VND VUV WST XAF XCD XOF XPF YER ZAR ZMW ZWG").split()

# The codes the audited workbook contained, for reading that
# workbook, and the number of decimals of a code when it is not two.
WORKBOOK_CURRENCIES = [
    "AED", "USD", "EUR", "GBP", "SAR", "JPY", "EGP", "CHF", "TRY", "OMR",
    "QAR", "BHD", "KRW", "MYR", "SGD", "KWD", "VND", "HKD", "MOP", "JOD",
    "INR", "ZAR", "MAD", "SEK", "CZK", "MUR", "CAD", "NZD",
]
NO_MINOR_UNIT = ["BIF", "CLP", "DJF", "GNF", "ISK", "KMF", "KRW", "PYG", "RWF",
                 "UGX", "VND", "VUV", "XAF", "XOF", "XPF", "JPY"]
THREE_DECIMALS = ["BHD", "IQD", "JOD", "KWD", "LYD", "OMR", "TND"]

# Anomaly kinds that send a row to review.
REVIEW_KINDS = [
    "currency_unrecognised", "currency_unparseable", "currency_amount_unparseable",
    "rate_denominator_mismatch", "rate_formula_unexpected",
    "date_unparseable", "date_invalid", "date_swap_invalid",
    "date_unexpected_type", "both_money_columns", "no_amount",
    "rate_without_currency",
]

# Fields a person may edit as text; blank clears them.
TEXT_FIELDS = ["req_number", "payment_ref", "lpo_number", "notes", "invoice",
               "crm", "client", "sales_operation", "description"]


def minor_units(code: str) -> int:
    """Decimals a currency is written with; an unknown code is written with two."""
    if code in NO_MINOR_UNIT:
        return 0
    return 3 if code in THREE_DECIMALS else 2
