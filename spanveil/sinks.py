"""Writing findings and redacted texts."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_findings(findings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A findings table partitioned by type, so that readers of one type skip the rest."""
    findings.write.mode(mode).partitionBy("type").parquet(path)


def write_redacted(texts: DataFrame, path: str, redacted: str = "redacted", text_col: str = "text", mode: str = "overwrite") -> None:
    """The corpus with its text replaced; neither the old text nor the findings are kept."""
    columns = [c for c in texts.columns if c not in (text_col, redacted, "findings")]
    texts.selectExpr(*[f"`{c}`" for c in columns], f"`{redacted}` AS `{text_col}`").write.mode(mode).parquet(path)
