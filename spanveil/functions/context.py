"""How far the surroundings of a text (channel, domain, wording) speak for a safe context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------------------------
# ``^`` binds to the first arm only, so the other three match anywhere in the channel.
SAFE_CHANNEL = r"(?i)^/client-|/project-|/team-|/internal-"
MENTION = r"@[A-Za-z0-9_]+"
SAFE_WORDS = r"(?i)internal|team|discuss|meeting|internal discussion|team chat"
SAFE_DOMAIN = r"(?i)(?:\A|\.)(?:intercom|zendesk|hubspot|slack)\.com\z"


def context_score(channel: Column, domain: Column, text: Column) -> Column:
    def part(column: Column, pattern: str, weight: float) -> Column:
        return F.when(F.coalesce(column, F.lit("")).rlike(pattern), weight).otherwise(0.0)

    score = (
        part(channel, SAFE_CHANNEL, 0.4)
        + part(text, MENTION, 0.2)
        + part(text, SAFE_WORDS, 0.2)
        + part(domain, SAFE_DOMAIN, 0.1)
    )
    return F.least(score, F.lit(1.0))
