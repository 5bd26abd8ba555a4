"""Texts that stop before they are complete (problem 9).

A stack automaton reads each text and reports what is open at its end: quotes, brackets, markup, a broken
multibyte sequence or escape. Texts that end without a terminator are compared with how sentences of this
corpus end: the last four words of every terminated sentence, digits masked one by one, form a table that
Spark gathers from all texts; an unfinished last sentence with such an ending merely lacks its full stop.
Closing lines (signature, list entry, heading, date, sum, seal) are known by their form, or by the share
of different texts that close with the same masked line. What remains is weighed against the source: where more
than half of a source's texts lack a terminator, a text of it counts as cut only if its last word is
unknown to the corpus' endings as well.

Defined results: null, empty, blank and invisible texts are no cases; an ellipsis counts as no terminator;
repeated documents are judged alike; a missing source is a source of its own; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granthika.sources.tables import cut

#: Words of an ending, and the least distinct texts by which a closing line is known.
ENDING_WORDS, KNOWN_CLOSINGS = 4, 3
#: A closing line is short; a longer last line is text.
CLOSING_WORDS = 8
#: Share of all distinct texts from which a line counts as a closing; chance repeats of cut lines stay below it.
CLOSING_SHARE = 0.0005
#: From this share of unterminated texts on, a source's missing terminators say little.
HABIT = 0.5
#: A field limit: at least so many texts, and this share of the source's undecided texts, have one length.
LIMIT_TEXTS, LIMIT_SHARE = 3, 0.1
#: Parts into which the rows of one source are spread for a join.
SALTS = 16

TERMINATORS = ".?!।॥"
_DIGITS = {ord(d): "0" for d in "0123456789०१२३४५६७८९೦೧೨೩೪೫೬೭೮೯"}
_UNSEEN_TAIL = re.compile(r"[\s­​-‏⁠﻿]+$")
_SENTENCE_END = re.compile(r"[.?!।॥]+[\"”’)\]]*(?=\s|$)")
_ELLIPSIS = re.compile(r"(?:\.{2,}|…)$")
_STRUCTURE = re.compile(r"[\"“”()\[\]{}]|</?[A-Za-z][^<>\n]*>|<\|?[a-z_]+\|?>|\n")
_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“"}
_BROKEN = re.compile(r"(?:�|\\u?[0-9A-Fa-f]{0,3}|&#?[A-Za-z0-9]{1,8}|<[A-Za-z/!|][^<>\s]*|%[0-9A-F]?)$")
# Abbreviations whose dot ends no sentence.
_ABBREVIATION = re.compile(r"(?:^|[\s(])(?:Rs|No|Nos|INR|Smt|Shri|Dr|Mr|Mrs|Ms|Sri|St|H\.No|O\.S|Crl|Crl\.P|W\.P|C\.C|Art|Sec|vs?|viz|i\.e|e\.g|p\.a|p|O|S|M/s|C/o|[A-Z](?:\.[A-Z])*|\d{1,2}[./-]\d{1,2}|(?:of|on|dated|from|since|by) \d{1,2})\.$")
_DATE = r"\d{1,2}[./-]\d{1,2}[./-]\d{4}"
_CLOSING = re.compile(
    r"^(?:\[[^\[\]]+\]|\((?:[a-z]|[ivx]{1,4})\) \S.*|[^\s:]+(?: [^\s:]+){0,3}: ?(?:(?:₹|Rs\.?|INR) ?[\d,]*\d{3}(?:/-)?|.*\bsection \d+[A-Z]?|" + _DATE + r")"
    r"|(?:\S+ ){0,6}?" + _DATE + r"|[A-Z][A-Z ]+[A-Z]|(?:Sd|Signed|हस्ता|ಸಹಿ)[^ ]*.*)$"
)
_SIGNED = re.compile(r"^(?:Sd|Signed|हस्ता|ಸಹಿ)[./-]*\s*$")

_TAIL = "doc_id bigint, source string, terminated boolean, evidence string, ending string, closing string, last_word string, n int, h bigint"
_TAIL_ARROW = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("terminated", pa.bool_()), ("evidence", pa.string()), ("ending", pa.string()), ("closing", pa.string()), ("last_word", pa.string()), ("n", pa.int32()), ("h", pa.int64())])


def mask(text: str) -> str:
    return text.translate(_DIGITS)


def ending(sentence: str) -> str:
    """The last words of a sentence, digits masked; shorter sentences keep a mark of their beginning."""
    words = sentence.split()
    return mask(" ".join(words[-ENDING_WORDS:] if len(words) >= ENDING_WORDS else ["^", *words]))


def open_at_end(text: str) -> str:
    """What the stack automaton has open at the end of the last paragraph: opening marks, outermost first."""
    stack: list[str] = []
    for m in _STRUCTURE.finditer(text):
        c = m.group()
        if c == "\n":
            stack.clear()
        elif c == '"':
            if '"' in stack:
                del stack[stack.index('"') :]
            else:
                stack.append(c)
        elif c in _PAIRS:
            if stack and stack[-1] == _PAIRS[c]:
                stack.pop()
        elif len(c) == 1:
            stack.append(c)
        elif c[:2] == "</":
            name = c[2:-1].strip().lower()
            if name in stack:
                del stack[stack.index(name) :]
        elif c[1] != "|" and not c.endswith("/>") and re.match(r"<(?:b|i|p|div|span|a|ul|ol|li|table|tr|td|em|strong)\b", c, re.I):
            stack.append(re.match(r"<(\w+)", c).group(1).lower())
    return "".join(x if len(x) == 1 else f"<{x}>" for x in stack)


def _last_words(text: str) -> str:
    """The last two words: no abbreviation has more."""
    return " ".join(text.rsplit(None, 2)[-2:])


def _signed(body: str) -> bool:
    """Whether the last line is what stands below a signature."""
    lines = body.rsplit("\n", 2)
    return len(lines) > 1 and bool(_SIGNED.match(lines[-2]))


def judge(text: str) -> tuple[bool, str, str, str, str] | None:
    """(terminated, evidence, ending, closing line, last word) of a text that shows something.

    evidence: `cut` and `whole` decide; an empty string leaves it to the corpus.
    """
    body = _UNSEEN_TAIL.sub("", text)
    if not body:
        return None
    end = body.rsplit(None, 1)[-1]
    if _BROKEN.search(end):
        return False, "cut", "", "", ""
    bare = _ELLIPSIS.sub("", body)
    dotted = len(bare) < len(body)
    unquoted = body.rstrip("\"”’)]")
    terminated = not dotted and unquoted[-1:] in TERMINATORS and unquoted != ""
    line = bare[bare.rfind("\n") + 1 :].strip()
    if terminated:
        short = _ABBREVIATION.search(_last_words(unquoted))
        return True, "cut" if short or open_at_end(body) else "whole", "", "", ""
    if not dotted and (_CLOSING.match(line) and not open_at_end(body) or _signed(body)):
        return False, "whole", "", "", ""
    if open_at_end(body):
        return False, "cut", "", "", ""
    at = 0
    for m in _SENTENCE_END.finditer(bare, max(0, bare.rfind("\n"))):
        if not _ABBREVIATION.search(_last_words(bare[bare.rfind("\n", 0, m.start()) + 1 : m.start() + 1])):
            at = m.end()
    last = bare[max(at, bare.rfind("\n") + 1) :]
    words = last.split()
    return False, "", ending(last), mask(line) if len(line.split()) <= CLOSING_WORDS else "", mask(words[-1]) if words else ""


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, source, text, h in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (found := judge(text)) is not None:
                rows.append((doc_id, source, *found, len(text), h))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _TAIL_ARROW, strict=True)], schema=_TAIL_ARROW)


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct endings of the terminated sentences of each batch."""
    for batch in batches:
        seen: set[str] = set()
        for text in batch.column(0).to_pylist():
            at = 0
            for m in _SENTENCE_END.finditer(text):
                if m.group().startswith(".."):  # an ellipsis may itself mark a cut
                    at = m.end()
                    continue
                words = text[at : m.start()].rsplit(None, ENDING_WORDS)
                if len(words) > ENDING_WORDS:
                    words = words[1:]
                elif len(words) < ENDING_WORDS:
                    words = ["^", *words]
                if len(words) > 2:  # a mark and a single word are no sentence
                    seen.add(" ".join(words))
                at = m.end()
        kept = {mask(x) for x in seen if not _ABBREVIATION.search(_last_words(x) + ".")}
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string())], ["ending"])


def endings(documents: DataFrame, text: str = "text") -> DataFrame:
    """The distinct endings of all terminated sentences; distinct per batch before the shuffle."""
    return documents.select(documents[text].alias("text")).where(F.col("text").isNotNull()).mapInArrow(_endings, "ending string").distinct()


def tails(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    picked = documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[source].alias("source"), documents[text].alias("text"), F.xxhash64(documents[text]).alias("h"))
    return picked.where(F.col("text").isNotNull()).mapInArrow(_tails, _TAIL)


def judged(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source and `cut` of every text that shows something.

    Only undecided tails are joined with the endings of the corpus, on equal strings, so both sides are
    partitioned by ending; the closing lines and sources are counted with partial aggregation.
    """
    # Both are read several times below; a checkpoint keeps the texts from being read as often.
    t = cut(tails(documents, doc_id, text, source))
    ends = cut(endings(documents, text))
    open_ = t.where(F.col("evidence") == "")
    habits = t.groupBy("source").agg(F.avg((~F.col("terminated")).cast("double")).alias("unterminated"))
    # Copies under another doc_id are one text.
    lines = open_.where(F.col("closing") != "").select("closing", "h").distinct().groupBy("closing").agg(F.count("*").alias("closers"))
    all_texts = t.select("h").distinct().agg(F.count("*").alias("all_texts"))
    lines = lines.where(F.col("closers") >= KNOWN_CLOSINGS).crossJoin(F.broadcast(all_texts))
    known = lines.where(F.col("closers") >= CLOSING_SHARE * F.col("all_texts")).select("closing", F.lit(True).alias("closes"))
    # Only endings that open tails have are carried back, and only words; all of them with a salt, as one tail may be a third of all.
    ended = open_.select("ending").distinct().join(ends, "ending").select("ending", F.lit(True).alias("ends"))
    words = ends.select(F.element_at(F.split("ending", " "), -1).alias("last_word")).distinct()
    worded = open_.select("last_word").distinct().join(words, "last_word").select("last_word", F.lit(True).alias("worded"))
    x = _salted(_salted(open_, ended, ["ending"]), worded, ["last_word"])
    x = _salted(x.where(F.col("closing") != ""), known, ["closing"]).unionByName(x.where(F.col("closing") == "").withColumn("closes", F.lit(None).cast("boolean")))
    per = open_.select("source", "n", "h").distinct().groupBy("source", "n").agg(F.count("*").alias("texts"))
    of = per.groupBy("source").agg(F.sum("texts").alias("all_texts"))
    limits = per.where(F.col("texts") >= LIMIT_TEXTS).join(of.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    limits = limits.where(F.col("texts") >= LIMIT_SHARE * F.col("all_texts")).select("source", "n", F.lit(True).alias("limited"))
    x = _salted(_salted(x, habits, ["source"]), limits, ["source", "n"])
    whole = F.col("ends").isNotNull() | F.col("closes").isNotNull() | ((F.col("unterminated") > HABIT) & F.col("worded").isNotNull())
    undecided = x.select("doc_id", "source", (F.col("limited").isNotNull() | ~whole).alias("cut"))
    return t.where(F.col("evidence") != "").select("doc_id", "source", (F.col("evidence") == "cut").alias("cut")).unionAll(undecided)


def _salted(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the facts of their keys, null keys too. One key may hold a third of all rows, so both sides carry a salt."""
    right = facts.select(*[F.col(c).alias(f"of_{c}") if c in keys else F.col(c) for c in facts.columns])
    right = right.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int") == F.col("of_salt")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return rows.join(right, on, "left").drop("of_salt", *[f"of_{k}" for k in keys])


def found(documents: DataFrame) -> DataFrame:
    return judged(documents).where("cut").select("doc_id")


def per_source(documents: DataFrame) -> DataFrame:
    """How often each source truncates: texts that show something, cut ones, and their share."""
    n: Column = F.count("*")
    short = F.sum(F.col("cut").cast("bigint"))
    return judged(documents).groupBy("source").agg(n.alias("n_texts"), short.alias("n_truncated"), F.round(short / n, 6).alias("share"))
