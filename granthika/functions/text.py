"""Text rules as Column expressions, so that they stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What separates words of a question, and the words that show what it asks for.
PUNISHMENT_WORDS = ("punishment", "punishable", "punishment for", "penalty", "sentence", "fine", "how many years", "how long imprisonment", "सजा", "दंड", "सज़ा", "ಶಿಕ್ಷೆ", "ದಂಡ")
DEFINITION_WORDS = ("what is", "what does", "define", "definition", "meaning of", "means", "क्या है", "क्या होता है", "परिभाषा", "ಎಂದರೇನು", "ಅರ್ಥವೇನು", "ವ್ಯಾಖ್ಯಾನ")
AMENDMENT_NOTE = r"subs\. by|ins\. by|omitted by|w\.e\.f\."


def replace_all(col: Column, *rules: tuple[str, str]) -> Column:
    """The rewrites in order."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, col)


def normalise(col: Column) -> Column:
    """Lower case, one space between words; null is the empty string."""
    return F.regexp_replace(F.trim(F.lower(F.coalesce(col, F.lit("")))), r"\s+", " ")


def tokens(col: Column) -> Column:
    """Lower-case words of ASCII letters and digits, with one inner hyphen or apostrophe."""
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(r"([a-z0-9]+(?:[-'][a-z0-9]+)?)"), F.lit(1))


def _apart(mark: str, *sizes: tuple[int, int], written: str = "") -> tuple[str, str]:
    """A number in groups of the given least and most digits that stand apart around a mark, and the same written close."""
    groups = [rf"([0-9]{{{least},{most}}})" for least, most in sizes]
    return r"\b" + rf"\s*{mark}\s*".join(groups) + r"\b", (written or mark).join(f"${i + 1}" for i in range(len(groups)))


def _before(word: str, follows: str, sign: str) -> tuple[str, str]:
    """A misread sign that stands alone before a number, and the sign that was printed."""
    return rf"(?i)(^|[^A-Za-z0-9_]){word}\s*({follows})", rf"$1{sign}$2"


# The grammar of numbers in scanned text. A number has an optional sign of currency, groups of digits parted by
# a mark, and an optional unit; each line says how one of these is misprinted and how it is written.
_GROUP, _PAIR, _YEAR = (1, 3), (2, 3), (2, 4)
SIGNS = (
    _before("[trz]", r"[0-9]{1,3}(?:,[0-9]{2,3})+", "₹"), _before("t", "[0-9]{3,}", "₹"),
    (r"(?i)\bRs\s*[.,]\s*", "Rs. "), (r"(?i)\bINR\s*[.:]?\s*", "INR "), (r"₹\s+", "₹"),
)
GROUPS = (_apart(",", _GROUP, _PAIR, (3, 3)), _apart(",", _GROUP, _PAIR), *(_apart(mark, (1, 2), (1, 2), _YEAR, written=mark[-1 if len(mark) == 1 else 1]) for mark in ("/", "-", "[.]")))
UNITS = ((r"(?i)(\d+(?:\.\d+)?)\s*%\s*(?:p\s*[.]?\s*a\s*[.]?|per\s+annum)", "$1% p.a."), (r"(\d+)\s*%", "$1%"), (r"\s*/\s*-\s*", "/- "))
#: Groups and units; with the signs they are all of the number rules. None looks around, so DuckDB states them too.
SPACED_NUMBERS = (*GROUPS, *UNITS)
NUMBERS = (*SIGNS, *SPACED_NUMBERS)


def fix_scanned_numbers(col: Column) -> Column:
    """Sums, dates and rates as they were printed."""
    return replace_all(col, *NUMBERS)


SPACING = ((r"[ \t]+", " "), (r" *\n *", "\n"), (r"\s+([,.;:!?])", "$1"), (r"\n{3,}", "\n\n"))


def one_line_end(col: Column) -> Column:
    return replace_all(F.coalesce(col, F.lit("")), (r"\r\n?", "\n"), (r"\x00", ""))


def clean(col: Column, scanned: bool = True) -> Column:
    """The text with one kind of line end, repaired numbers and plain spacing."""
    lines = one_line_end(col)
    return F.regexp_replace(replace_all(fix_scanned_numbers(lines) if scanned else lines, *SPACING), r"^\s+|\s+$", "")


def script_counts(col: Column) -> tuple[Column, Column]:
    """Devanagari and Kannada characters."""
    text = F.coalesce(col, F.lit(""))
    return F.length(F.regexp_replace(text, r"[^ऀ-ॿ]", "")), F.length(F.regexp_replace(text, r"[^ಀ-೿]", ""))


def script_language(col: Column, mode: str = "compare", least: int = 15) -> Column:
    """The language by script. Modes: `compare` (the larger count), `hindi_first`, `least` (more than `least`)."""
    hi, kn = script_counts(col)
    if mode == "compare":
        return F.when((kn > hi) & (kn > 0), "kannada").when(hi > 0, "hindi").otherwise("english")
    if mode == "hindi_first":
        return F.when(hi > 0, "hindi").when(kn > 0, "kannada").otherwise("english")
    return F.when((kn > least) | (kn > hi), "kannada").when(hi > least, "hindi").otherwise("english")


def any_of(col: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(w)) for w in words])


def intent(col: Column) -> Column:
    text = normalise(col)
    return F.when(any_of(text, PUNISHMENT_WORDS), "punishment").when(any_of(text, DEFINITION_WORDS), "definition").otherwise("general")


def section_numbers(col: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(r"(?i)(?:section|sec|u/s|धारा|ಸೆಕ್ಷನ್)\s*([0-9]+[A-Za-z]*)"), F.lit(1)))


SUM = r"((?:₹|Rs\.|INR) ?[0-9]{1,2}(?:,[0-9]{2})*,[0-9]{3})"
DATE = r"([0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})"
RATE = r"([0-9]+(?:\.[0-9]+)?%)"


def found_all(col: Column, pattern: str) -> Column:
    """The distinct matches in order of their first place."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(pattern), F.lit(1)))
