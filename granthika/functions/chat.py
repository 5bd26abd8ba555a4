"""Roles and times of chat rows as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of the speaker roles.
USER, ASSISTANT = ("user", "human", "citizen", "customer"), ("assistant", "bot", "ai", "model")
# A user's words that ask about what was said before, and the words of a question that stands alone.
FOLLOW_UPS = ("what if", "is it", "can they", "how about", "in this case", "punishment", "bail", "arrest", "penalty", "liable")
LEAST_WORDS = 7


def is_user(role: Column) -> Column:
    return F.coalesce(F.lower(F.trim(role)).isin(*USER), F.lit(False))


def is_assistant(role: Column) -> Column:
    return F.coalesce(F.lower(F.trim(role)).isin(*ASSISTANT), F.lit(False))


def seconds(created_at: Column) -> Column:
    """Seconds since 1970, whatever the unit; 0 where there is no usable time, so that such rows come first."""
    t = F.when(created_at > 1e17, created_at / 1e9).when(created_at > 1e14, created_at / 1e6).when(created_at > 1e11, created_at / 1e3).otherwise(created_at)
    return F.when((t > 0) & (t < 1e11), t).otherwise(0.0)
