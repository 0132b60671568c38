"""One scan per text: findings with everything the log and the statistics need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.display import risk_level, scan_signature
from .detect import detect
from .merge import merge_findings
from .risklog import scan_id
from .stats import scan_counts


def scan_corpus(
    df: DataFrame, identity: Sequence[str], text_col: str = "text", *, secondary: str | None = None, **options
) -> DataFrame:
    """Detect, merge a second source if there is one, and describe each scan.

    ``identity`` names the columns that identify a scan.  Added are findings, scan_id,
    risk_level, signature and the three counts; there is no shuffle.
    """
    found = detect(df, text_col, **options)
    if secondary:
        found = merge_findings(found, secondary=secondary, text_col=text_col)
    return found.withColumns(
        {"scan_id": scan_id(*[F.col(c) for c in identity]), "risk_level": risk_level(F.col("findings")),
         "signature": scan_signature(F.col("findings"))}
    ).select("*", *scan_counts("findings"))
