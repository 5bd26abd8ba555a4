"""Visually identical text in one consistent form (problem 5).

Strings and code points that look alike are linked: canonical decompositions, full- and half-width forms,
no-break forms, ligatures, look-alike letters of Latin, Greek and Cyrillic, sequences that a script draws
like a single letter, spaces, and characters that show nothing. Union-find makes the links transitive. The
representative of a class is its most frequent member in the corpus, counted by Spark over all texts. A
multi-pattern automaton rewrites every other member, leftmost and longest first, until nothing changes.

Defined results: null stays null; texts that show nothing have an empty look and make no pairs; messages without a
session or a usable role have a look but make no pairs; white space at
the ends of a text and of its lines isn't seen; case, accents, punctuation and runs of spaces are seen;
equal counts choose the shorter, then the smaller string; texts of any length are rewritten whole;
repeated rows pair like others if their ids differ; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granthika.llm.conversations import clean_role
from granthika.sources.tables import cut

# Letters of other scripts that look like the Latin letter at the same place.
LATIN = "ABCEHIJKMNOPSTXYZ" + "aceijopsxyhdqwgvou"
CYRILLIC = "АВСЕНІЈКМ ОРЅТХУ " + "асеіјорѕхуһԁԛԝ ѵ  "
GREEK = "ΑΒ ΕΗΙ ΚΜΝΟΡ ΤΧΥΖ" + "     ο         νο "
# Other single look-alikes, and sequences that are drawn like one letter.
PAIRS = (
    ("ϲ", "c"), ("ϳ", "j"), ("ɡ", "g"), ("ɑ", "a"), ("ı̇", "i"), ("‐", "-"), ("‑", "-"), ("﹣", "-"), ("।।", "॥"),
    ("अा", "आ"), ("अो", "ओ"), ("अौ", "औ"), ("अॉ", "ऑ"), ("एे", "ऐ"), ("आे", "ओ"), ("आै", "औ"), ("ाे", "ो"), ("ाै", "ौ"),
    ("ಉಾ", "ಊ"), ("ಒೌ", "ಔ"), ("ಒೕ", "ಓ"), ("಼ಫ", "಼ಫ"),
)
#: What shows nothing; variation selectors and format characters are added by rule.
UNSEEN = "­͏᠎ᅟᅠㅤ"
_KINDS = ("", "<wide>", "<narrow>", "<noBreak>", "<compat>")

_LINE_END = re.compile(r"[ \t\r\f\v]+(?=\n|$)|^[ \t]+(?=\S)", re.M)


def links() -> Iterator[tuple[str, str]]:
    """Pairs of strings that look alike."""
    for other in (CYRILLIC, GREEK):
        yield from ((a, b) for a, b in zip(other, LATIN, strict=True) if a != " ")
    yield from PAIRS
    yield from ((c, "") for c in UNSEEN)
    for cp in range(0x80, sys.maxunicode + 1):
        if 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xE000 or 0x20000 <= cp < 0xE0000:
            continue
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Zs":
            yield c, " "
        elif kind == "Cf" and not 0x600 <= cp < 0x800 or 0xFE00 <= cp <= 0xFE0F:
            yield c, ""
        else:
            tag, _, rest = f" {unicodedata.decomposition(c)}".rpartition("> ")
            tag = (tag + ">").strip() if tag else ""
            if unicodedata.decomposition(c) and tag in _KINDS:
                to = "".join(chr(int(x, 16)) for x in (rest or unicodedata.decomposition(c)).split())
                if not to.startswith(" ") and (tag != "<compat>" or kind.startswith("L")):
                    yield c, to
                    if not tag and (full := unicodedata.normalize("NFD", c)) != to:
                        yield c, full


class Classes:
    """Union-find over strings."""

    def __init__(self, pairs: Iterable[tuple[str, str]]) -> None:
        self._up: dict[str, str] = {}
        for a, b in pairs:
            self.union(a, b)

    def find(self, a: str) -> str:
        root = a
        while (up := self._up.get(root, root)) != root:
            root = up
        while (up := self._up.get(a, a)) != root:
            self._up[a], a = root, up
        return root

    def union(self, a: str, b: str) -> None:
        self._up.setdefault(a, a), self._up.setdefault(b, b)
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self._up[max(ra, rb)] = min(ra, rb)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for a in self._up:
            out.setdefault(self.find(a), []).append(a)
        return out


@lru_cache(maxsize=1)
def classes() -> dict[str, tuple[str, ...]]:
    return {k: tuple(sorted(v)) for k, v in Classes(links()).members().items() if len(v) > 1}


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """For each member that isn't its class's representative, the representative."""
    out = {}
    for members in classes().values():
        best = "" if "" in members else min(members, key=lambda m: (-counts.get(m, 0), len(m), m))
        out.update({m: best for m in members if m != best and m})
    return out


class Rewriter:
    def __init__(self, to: dict[str, str]) -> None:
        import ahocorasick

        self._to = to
        self._find = ahocorasick.Automaton()
        for pattern in to:
            self._find.add_word(pattern, pattern)
        self._find.make_automaton()
        # Texts without any of these have no pattern: every pattern has a character beyond this set.
        self._plain = all(not p.isascii() for p in to)

    def once(self, text: str) -> str:
        out, at = [], 0
        for end, pattern in self._find.iter_long(text):
            start = end + 1 - len(pattern)
            out += (text[at:start], self._to[pattern])
            at = end + 1
        return "".join((*out, text[at:])) if out else text

    def look(self, text: str) -> str:
        """The one form of a text, without the white space that isn't seen."""
        if not (self._plain and text.isascii()):
            while True:
                # Marks of one letter can be typed in any order; the canonical order is the one rewritten.
                new = self.once(text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text))
                if new == text or unicodedata.normalize("NFC", new) == text:
                    break
                text = new
            text = new
        return _LINE_END.sub("", text).strip()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of class members in each batch: code points by one array count, strings by an automaton."""
    import ahocorasick

    known = [m for members in classes().values() for m in members if m]
    several = ahocorasick.Automaton()
    for m in known:
        if len(m) > 1:
            several.add_word(m, m)
    several.make_automaton()
    single = {m for m in known if len(m) == 1}
    for batch in batches:
        texts = [t for t in batch.column(0).to_pylist() if t]
        found: Counter[str] = Counter()
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if len(points):
            n = np.bincount(points)
            found.update({chr(cp): int(n[cp]) for cp in np.flatnonzero(n) if chr(cp) in single})
        for t in texts:
            if not t.isascii():
                found.update(m for _, m in several.iter(t))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["member", "n"])


def member_counts(texts: list[DataFrame]) -> dict[str, int]:
    """Occurrences of the class members in all texts, each a one-column table.

    What reaches the driver is at most one row for each member of a class, a few thousand whatever the input.
    """
    total = None
    for df in texts:
        part = df.where(F.col(df.columns[0]).isNotNull()).mapInArrow(_counts, "member string, n bigint")
        total = part if total is None else total.unionAll(part)
    return {r.member: r.n for r in total.groupBy("member").agg(F.sum("n").alias("n")).collect()}


def _looks(to: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewriter = Rewriter(to)
        for batch in batches:
            looks = [None if t is None else rewriter.look(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(looks, pa.string())], [*batch.schema.names, "look"])

    return run


def with_look(df: DataFrame, to: dict[str, str]) -> DataFrame:
    """The rows (src, id, part, text) with `look`, the consistent form of the text."""
    picked = df.select("src", "id", "part", "text")
    return picked.mapInArrow(_looks(to), "src string, id bigint, part string, text string, look string")


def rows_of(df: DataFrame, src: str, id_: str, part: Column | None = None) -> DataFrame:
    return df.select(F.lit(src).alias("src"), df[id_].cast("bigint").alias("id"), (F.lit("") if part is None else part).alias("part"), df["text"].alias("text"))


def all_rows(datasets: DataFrame, messages: DataFrame) -> DataFrame:
    """All texts with what they are compared within: datasets with one another, messages within a session and speaker role.

    A message without a session or a usable role has no part; it is rewritten, but pairs with none.
    """
    known = messages["session_id"].isNotNull() & clean_role(messages["role"]).isNotNull()
    part = F.when(known, F.concat_ws("\x1f", messages["session_id"], clean_role(messages["role"])))
    return rows_of(datasets, "datasets", "dataset_id").unionAll(rows_of(messages, "chat_messages", "id", part))


def _keyed(looks: DataFrame) -> DataFrame:
    """src, id, k (part and look) and raw (characters) of the rows that can be paired."""
    return looks.where((F.col("look") != "") & F.col("part").isNotNull()).select("src", "id", F.sha1(F.concat_ws("\x1e", "part", "look")).alias("k"), F.xxhash64("text", F.length("text")).alias("raw"))


#: Parts into which the rows of one look are spread for a join.
SALTS = 16


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def _every_salt(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def pairs(looks: DataFrame) -> DataFrame:
    """src, a_id < b_id of rows that look the same but differ in their characters.

    Looks with more than one spelling are found by the smallest and largest of their spellings, which are partial
    on the map side, and only their rows go on. Spellings are paired first and meet their rows afterwards, with a
    salt, so that a look with very many identical copies costs no more than the pairs that come out.
    """
    rows = cut(_keyed(looks))  # read twice below; texts are rewritten once
    several = rows.groupBy("src", "k").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("src", "k")
    some = cut(rows.withColumn("salt", _salt("id")).join(_every_salt(several), ["src", "k", "salt"], "left_semi").select("src", "k", "raw", "id"))
    spellings = some.groupBy("src", "k", "raw").agg(F.lit(1).alias("one")).drop("one")
    a, b = spellings.withColumnRenamed("raw", "raw_a"), spellings.withColumnRenamed("raw", "raw_b")
    both = _every_salt(a.join(b, ["src", "k"]).where("raw_a < raw_b"))
    first = some.select("src", "k", F.col("raw").alias("raw_a"), F.col("id").alias("x"), _salt("id").alias("salt"))
    x = both.join(first, ["src", "k", "raw_a", "salt"]).select("src", "k", "raw_b", "x", _salt("x").alias("salt"))
    y = x.join(_every_salt(some.select("src", "k", F.col("raw").alias("raw_b"), F.col("id").alias("y"))), ["src", "k", "raw_b", "salt"])
    return y.where("x <> y").select("src", F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"))


def classes_of(looks: DataFrame) -> DataFrame:
    """src, id, class_id and n_links of every row that has a look and a part.

    class_id is the smallest id of the rows that look the same; n_links is how many of them differ in their
    characters. Rows with equal characters are counted before they meet, and every count is carried back with
    a salt, so that a look that a third of all rows have is neither paired nor collected.
    """
    rows = cut(_keyed(looks))
    spelt = rows.groupBy("src", "k", "raw").agg(F.count("*").alias("same"), F.min("id").alias("first"))
    whole = spelt.groupBy("src", "k").agg(F.sum("same").alias("all"), F.min("first").alias("class_id"))
    facts = spelt.join(whole, ["src", "k"]).select("src", "k", "raw", "class_id", (F.col("all") - F.col("same")).alias("n_links"))
    met = rows.withColumn("salt", _salt("id")).join(_every_salt(facts), ["src", "k", "raw", "salt"])
    return met.select("src", "id", "class_id", "n_links")


def classed(datasets: DataFrame, messages: DataFrame) -> DataFrame:
    return classes_of(looks(datasets, messages, paired=True))


def looks(datasets: DataFrame, messages: DataFrame, paired: bool = False) -> DataFrame:
    """The look of every text, or only of the rows that can be `paired`."""
    to = representatives(member_counts([datasets.select("text"), messages.select("text")]))
    rows = all_rows(datasets, messages)
    return with_look(rows.where(F.col("part").isNotNull()) if paired else rows, to)


def found(datasets: DataFrame, messages: DataFrame) -> DataFrame:
    return pairs(looks(datasets, messages, paired=True))
