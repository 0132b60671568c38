"""The registered queries: each maps (session, table folder) to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import detect, find_pii, spread
from ..operators.detectors import default_detectors
from . import derived
from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; times without a zone are read in the session's zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema if f.dataType.simpleString() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def wall_time(column: str):
    """A time as it reads in the session's zone, as the given tables hold it."""
    return F.col(column).cast("timestamp_ntz").alias(column)


def register(name: str, oracle: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return query

    return add


def derived_text(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Texts of one kind; only the keys are moved, the texts are made where they are used."""
    keys = spread(table(spark, sf_dir, "orders").select(derived.KEY))
    return keys.selectExpr(f"{derived.KEY} AS id", f"{derived.TEXTS[kind]} AS text")


FINDING_COLUMNS = "id, type, t AS text, s AS start, e AS \"end\", conf AS confidence"

# Passes that each derived-text query runs; later ones meet the claims of earlier ones.
DETECTOR_QUERIES = {
    "pii_nhs": ("nhs", (1,)),
    "pii_ni": ("ni", (2,)),
    "pii_passport": ("passport", (3, 4)),
    "pii_driving_licence": ("driving_licence", (5, 6)),
    "pii_vat": ("vat", (7,)),
    "pii_bank": ("bank", (8, 9, 10)),
    "pii_iban": ("iban", (11,)),
    "pii_card_rules": ("card", (12, 13, 14)),
    "pii_dob": ("dob", (15, 16, 17)),
    "pii_phone": ("phone", (18,)),
    "pii_email_rules": ("email", (19,)),
    "pii_ip_rules": ("ip", (20,)),
    "pii_address": ("address", (21, 22)),
    "pii_postcode": ("postcode", (22,)),
    "pii_names": ("names", (23, 24, 25)),
}


def _detector_query(kind: str, ranks: tuple[int, ...]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        chosen = [d for d in default_detectors() if d.rank in ranks]
        found = find_pii(derived_text(spark, sf_dir, kind), ["id"], detectors=chosen)
        return found.drop("severity")

    return query


def _src(kind: str) -> str:
    return f"src AS MATERIALIZED (SELECT {derived.KEY} AS id, {derived.TEXTS[kind]} AS text FROM orders)"


for _name, (_kind, _ranks) in DETECTOR_QUERIES.items():
    register(_name, f"WITH {_src(_kind)},\n{O.finding_ctes('src', _ranks)}\nSELECT {FINDING_COLUMNS} FROM f")(
        _detector_query(_kind, _ranks)
    )
