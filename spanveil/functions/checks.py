"""Check digits and format rules.

Every rule is a SQL expression over one argument, so that detectors can inline it into
their lambdas and a session can register it as a SQL function (``register_functions``).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .patterns import SP
from .spans import one_of, quoted

# --- fixed values --------------------------------------------------------------------------
NI_BARRED_FIRST = "DFIQUV"
NI_BARRED_SECOND = "DFIOQUV"
NI_BARRED_PAIRS = ("BG", "GB", "NK", "KN", "TN", "NT", "ZZ")
MAESTRO_PREFIXES = ("6304", "6759", "6761", "6762", "6763")
BIRTH_YEARS = (1900, 2015)


def digits_only(x: str) -> str:
    return f"regexp_replace({x}, {quoted(f'[{SP}{chr(92)}-]')}, '')"


def _int(x: str, start: int, length: int) -> str:
    return f"TRY_CAST(substring({x}, {start}, {length}) AS int)"


def nhs_check(x: str, d: str | None = None) -> str:
    """Modulus-11 check of a ten-digit health number; remainders 0 and 1 are invalid.

    Here and below ``d`` names the bare digits where a caller already has them.
    """
    d = d or digits_only(x)
    total = " + ".join(f"{_int(d, i, 1)} * {11 - i}" for i in range(1, 10))
    # The check digit makes the whole sum, itself included, a multiple of 11; a remainder of
    # 0 or 1 would need the check digits 11 and 10, and the first of these shows as 0.
    return f"(length({d}) = 10 AND (({total}) + {_int(d, 10, 1)}) % 11 = 0 AND ({total}) % 11 > 1)"


def ni_prefix_check(x: str) -> str:
    pair = f"upper(substring({x}, 1, 2))"
    return (
        f"(NOT {pair} RLIKE '^[{NI_BARRED_FIRST}]|^.[{NI_BARRED_SECOND}]'"
        f" AND NOT {one_of(pair, NI_BARRED_PAIRS)})"
    )


def licence_date_check(x: str) -> str:
    """Month 1-12, or 51-62, and day 1-31 inside a 16-character licence number."""
    month, day = _int(x, 7, 2), _int(x, 9, 2)
    return f"(({month} BETWEEN 1 AND 12 OR {month} BETWEEN 51 AND 62) AND {day} BETWEEN 1 AND 31)"


def iban_check(x: str) -> str:
    """Modulus-97 check of a 22-character GB account number."""
    s = f"upper(regexp_replace({x}, {quoted(f'[{SP}]')}, ''))"
    letters = " || ".join(f"CAST(ascii(substring({s}, {i}, 1)) - 55 AS string)" for i in range(5, 9))
    number = f"{letters} || substring({s}, 9, 14) || '1611' || substring({s}, 3, 2)"
    return f"(length({s}) = 22 AND TRY_CAST({number} AS decimal(38,0)) % 97 = 1)"


def card_network(x: str, d: str | None = None) -> str:
    """Network of a card number by length and prefix; null when none fits."""
    d = d or digits_only(x)
    size = f"length({d})"
    return f"""CASE
        WHEN {size} BETWEEN 13 AND 16 AND startswith({d}, '4') THEN 'visa'
        WHEN {size} = 16 AND ({_int(d, 1, 2)} BETWEEN 51 AND 55
                              OR {_int(d, 1, 4)} BETWEEN 2221 AND 2720) THEN 'mastercard'
        WHEN {size} = 15 AND {_int(d, 1, 2)} IN (34, 37) THEN 'amex'
        WHEN {size} = 16 AND ({_int(d, 1, 4)} = 6011 OR {_int(d, 1, 3)} BETWEEN 622 AND 629
                              OR {_int(d, 1, 2)} IN (64, 65)) THEN 'discover'
        WHEN {size} BETWEEN 12 AND 19 AND {one_of(f'substring({d}, 1, 4)', MAESTRO_PREFIXES)} THEN 'maestro'
        END"""


def card_check(x: str, d: str | None = None) -> str:
    d = d or digits_only(x)
    return f"(luhn_check({d}) AND ({card_network(x, d)}) IS NOT NULL)"


def ip_class(x: str) -> str:
    """loopback, reserved, private or public."""
    a, b = (f"TRY_CAST(split_part({x}, '.', {i}) AS int)" for i in (1, 2))
    return f"""CASE
        WHEN {a} = 127 THEN 'loopback'
        WHEN {x} IN ('0.0.0.0', '255.255.255.255') THEN 'reserved'
        WHEN {a} = 10 OR ({a} = 172 AND {b} BETWEEN 16 AND 31) OR ({a} = 192 AND {b} = 168)
             OR ({a} = 100 AND {b} BETWEEN 64 AND 127) OR ({a} = 169 AND {b} = 254) THEN 'private'
        ELSE 'public' END"""


def plausible_birth_year(x: str) -> str:
    return f"(TRY_CAST({x} AS int) BETWEEN {BIRTH_YEARS[0]} AND {BIRTH_YEARS[1]})"


def phone_national(x: str) -> str:
    """National form of a phone number: separators dropped, country code turned into 0."""
    bare = f"regexp_replace({x}, {quoted(f'[{SP}{chr(92)}-+]')}, '')"
    return f"regexp_replace(regexp_replace({bare}, '^44', '0'), '^0044', '0')"


def collapse_whitespace(x: str) -> str:
    return f"trim(regexp_replace({x}, {quoted(f'[{SP}]+')}, ' '))"


FUNCTIONS = {
    "nhs_check": (nhs_check, "BOOLEAN"),
    "ni_prefix_check": (ni_prefix_check, "BOOLEAN"),
    "licence_date_check": (licence_date_check, "BOOLEAN"),
    "iban_check": (iban_check, "BOOLEAN"),
    "card_network": (card_network, "STRING"),
    "card_check": (card_check, "BOOLEAN"),
    "ip_class": (ip_class, "STRING"),
    "plausible_birth_year": (plausible_birth_year, "BOOLEAN"),
    "phone_national": (phone_national, "STRING"),
    "collapse_whitespace": (collapse_whitespace, "STRING"),
}


def register_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Register every rule as a temporary SQL function of one string argument."""
    names = []
    for name, (rule, returns) in FUNCTIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(x STRING) "
            f"RETURNS {returns} RETURN {rule('x')}"
        )
        names.append(prefix + name)
    return names
