"""Findings written by a language model, read from its raw output."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.spans import quoted, with_computed
from ..operators.merge import SECONDARY_TYPE

# --- fixed values: entity names of the model and the types they stand for ---------------------
ENTITY_TYPES = {
    "PERSON": "name",
    "PHONE": "phone",
    "EMAIL": "email",
    "ADDRESS": "address",
    "UK_VAT": "vat",
    "UK_SORTCODE": "sortcode",
    "NHS_NUMBER": "nhs_number",
    "NI_NUMBER": "ni_number",
    "POSTCODE": "postcode",
}
DEFAULT_CONFIDENCE = 0.9
_FENCE = r"(?i)```(?:json)?\s*([\s\S]*?)```"


def model_findings(df: DataFrame, json_col: str, out: str = "secondary") -> DataFrame:
    """Parse model output into an array of findings.

    The JSON is a fenced block if there is one, else the stretch from the first ``{`` to the
    last ``}``, else the whole output.  Output that is not JSON, or has no ``entities`` array,
    gives an empty array.  An entity needs a text, a start and an end.
    """
    fence = quoted(_FENCE)
    raw = f"coalesce({json_col}, '')"
    braces = quoted(r"\{[\s\S]*\}")
    found = f"regexp_extract({raw}, {braces}, 0)"
    body = f"""CASE WHEN {raw} RLIKE {fence} THEN trim(regexp_extract({raw}, {fence}, 1))
        WHEN {found} <> '' THEN {found} ELSE trim({raw}) END"""
    types = ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in ENTITY_TYPES.items())
    number = "schema_of_variant({0}) RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT)'"
    start, end, conf = (f"variant_get(e, '$.{n}', 'variant')" for n in ("start", "end", "confidence"))
    kind, text = (f"try_variant_get(e, '$.{n}', 'string')" for n in ("type", "text"))
    mapped = f"coalesce(map({types})[{kind}], nullif(lower({kind}), ''), 'pii')"
    entity = f"""named_struct('type', {mapped}, 'text', {text},
        'start', CASE WHEN {number.format(start)} THEN CAST(try_variant_get(e, '$.start', 'double') AS int) ELSE 0 END,
        'end', CASE WHEN {number.format(end)} THEN CAST(try_variant_get(e, '$.end', 'double') AS int) ELSE length({text}) END,
        'confidence', CASE WHEN {number.format(conf)} THEN try_variant_get(e, '$.confidence', 'double')
                      ELSE {DEFAULT_CONFIDENCE}D END)"""
    entities = "coalesce(try_variant_get(j, '$.entities', 'array<variant>'), array())"
    usable = f"{text} <> '' AND {start} IS NOT NULL AND {end} IS NOT NULL"
    # Inside brackets, anything that follows the JSON value makes the whole malformed.
    parsed = f"""transform(CAST(try_parse_json('[' || {body} || ']') AS array<variant>), j ->
        transform(filter({entities}, e -> {usable}), e -> {entity}))"""
    parsed = f"transform(array({parsed}), found -> CASE WHEN size(found) = 1 THEN found[0] END)[0]"
    return with_computed(df, out, f"CAST(coalesce({parsed}, array()) AS {SECONDARY_TYPE})")
