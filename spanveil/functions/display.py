"""Severity, labels, placeholders and display text of findings, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH = 0.85
MEDIUM = 0.6
DISPLAY_MINIMUM = 0.5

# --- fixed values: display label of each type ----------------------------------------------
DISPLAY_LABELS = {
    "nhs_number": "NHS Number",
    "ni_number": "NI Number",
    "uk_postcode": "UK Postcode",
    "uk_vat": "UK VAT Number",
    "sortcode_account": "Bank Details",
    "sortcode": "Sort Code",
    "account_number": "Account Number",
    "card_number": "Card Number",
    "uk_phone": "Phone Number",
    "email": "Email Address",
    "ip_address": "IP Address",
    "driving_licence": "Driving Licence",
    "passport": "Passport Number",
    "date_of_birth": "Date of Birth",
    "iban": "IBAN",
    "name": "Name",
    "address": "Physical Address",
}

# --- fixed values: placeholder word of each type, aliases included --------------------------
PLACEHOLDER_WORDS = {
    "nhs_number": "NHS_NUMBER",
    "ni_number": "NI_NUMBER",
    "uk_postcode": "POSTAL_CODE",
    "postal_code": "POSTAL_CODE",
    "postcode": "POSTAL_CODE",
    "uk_vat": "VAT",
    "vat": "VAT",
    "sortcode_account": "BANK",
    "sortcode": "SORT_CODE",
    "account_number": "ACCOUNT",
    "card_number": "CARD",
    "uk_phone": "PHONE",
    "phone": "PHONE",
    "email": "EMAIL",
    "ip_address": "IP",
    "driving_licence": "DRIVING_LICENCE",
    "passport": "PASSPORT",
    "date_of_birth": "DOB",
    "iban": "IBAN",
    "name": "NAME",
    "address": "ADDRESS",
}


def lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.create_map(*pairs)[key]


def display_label(type_: Column) -> Column:
    return F.coalesce(lookup(DISPLAY_LABELS, type_), type_)


def placeholder(type_: Column, number: Column) -> Column:
    word = F.coalesce(lookup(PLACEHOLDER_WORDS, type_), F.lit("PII"))
    return F.concat(F.lit("["), word, F.lit("_"), number.cast("string"), F.lit("]"))


def severity(confidence: Column) -> Column:
    return F.when(confidence >= HIGH, "HIGH").otherwise("MEDIUM")


def severity3(confidence: Column) -> Column:
    return F.when(confidence >= HIGH, "high").when(confidence >= MEDIUM, "medium").otherwise("low")


def log_severity(risks: Column) -> Column:
    return F.when(F.exists(risks, lambda r: r["confidence"] >= HIGH), "high").otherwise("medium")


def risk_level(findings: Column) -> Column:
    """Level of one scanned text; null when nothing was found."""
    return F.when(F.exists(findings, lambda f: f["severity"] == "HIGH"), "HIGH").when(
        F.size(findings) > 0, "MEDIUM"
    )


def normalise_confidence(raw: Column) -> Column:
    """Bring a second source's confidence, given as text, to a number.

    ``true``/``false`` are 0.9/0.5, values above 1 are percentages, 0 and anything that is
    not a number are 0.5, and the rest is held inside 0..1.
    """
    number = raw.try_cast("double")
    return (
        F.when(raw == "true", 0.9)
        .when(raw == "false", 0.5)
        .when(number.isNull() | F.isnan(number) | (number == 0), 0.5)
        .when(number > 1, number / 100)
        .otherwise(F.greatest(number, F.lit(0.0)))
    )


def mask_snippet(text: Column) -> Column:
    n = F.length(text)
    return F.when(n <= 6, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.substring(text, 1, 2), F.lit("•••"), F.right(text, F.lit(2)))
    )


def preview(text: Column) -> Column:
    return F.when(F.length(text) > 40, F.concat(F.substring(text, 1, 40), F.lit("…"))).otherwise(text)


def distinct_types(risks: Column) -> Column:
    """Types of a risk array in first-seen order."""
    return F.array_distinct(F.transform(risks, lambda r: r["type"]))


def type_badges(risks: Column, shown: int = 4) -> Column:
    """First types with blanks for underscores, then ``+N`` for the rest."""
    types = distinct_types(risks)
    tags = F.transform(F.slice(types, 1, shown), lambda t: F.translate(t, "_", " "))
    more = F.concat(F.lit("+"), (F.size(types) - shown).cast("string"))
    return F.when(F.size(types) > shown, F.concat(tags, F.array(more))).otherwise(tags)


def risk_count_text(risks: Column) -> Column:
    n = F.size(risks)
    return F.concat(n.cast("string"), F.when(n == 1, " item").otherwise(" items"), F.lit(" detected"))


def scan_signature(findings: Column) -> Column:
    """Sorted ``type:text`` pairs of a scan, joined by ``|``."""
    pairs = F.transform(findings, lambda f: F.concat(f["type"], F.lit(":"), f["text"]))
    return F.array_join(F.array_sort(pairs), "|")
