"""Clean-up of generated answers as Column expressions: reasoning, fences and lead-ins that aren't for the reader."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from granthika.functions.text import replace_all

# Phrases that lead in to an answer; one of them is followed by a colon, comma or stop.
LEAD_INS = (
    "verified answer", "verified information", "verified punishment information", "relevant provision identified", "the relevant provision is", "according to the evidence provided", "based on the retrieved facts",
    "use provided legal context", "we have legal context", "according to the provided legal context", "based on the verified legal context", "so the answer is",
)
#: Lead-ins that may follow one another.
PASSES = 8


def sanitised(answer: Column) -> Column:
    """The answer without reasoning blocks, an outer fence and outer white space; null is empty."""
    return replace_all(
        F.coalesce(answer, F.lit("")), (r"(?is)<think>.*?</think>", ""), (r"^\s+|\s+$", ""), (r"(?i)^```(?:text|markdown)?\s*", ""), (r"\s*```$", ""), (r"^\s+|\s+$", "")
    )


def plain_answer(answer: Column) -> Column:
    """The sanitised answer without its lead-ins, up to PASSES of them."""
    pattern = r"(?i)^\s*(?:" + "|".join(LEAD_INS) + r")\s*[:.,-]\s*"
    return reduce(lambda x, _: F.regexp_replace(x, pattern, ""), range(PASSES), sanitised(answer))


def table_rules(answer: Column) -> Column:
    """The answer without the rules of tables: lines of dashes, bars and colons only."""
    return F.regexp_replace(answer, r"(?m)^[ \t]*[|:+=_-]*(?:-{2,}|={2,}|_{2,})[|:+=_ -]*$\n?", "")
