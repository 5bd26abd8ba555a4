"""Sections and chunks of documents."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granthika.functions.text import one_line_end

# The header of a numbered section, and where a long body may be cut.
HEADER = r"^\s*(\d{1,4}[A-Z]?)\.\s+(.+?)\s*$"
STOPS = (". ", "; ", ": ", "\n", "।")
SIZE, OVERLAP = 1000, 200


def _numbered(text: str) -> Column:
    """The lines of a text as structs: line, number and title of a section header, and the number of headers so far.

    The running count is made inside the row, so that a long document costs no shuffle and no window.
    """
    each = F.transform(
        F.split(one_line_end(F.col(text)), "\n", -1),
        lambda x: F.struct(F.trim(x).alias("line"), F.regexp_extract(x, HEADER, 1).alias("number"), F.regexp_extract(x, HEADER, 2).alias("title")),
    )
    return each


def _heads(lines: Column) -> Column:
    """The places of the headers among the lines, from 0."""
    return F.filter(F.transform(lines, lambda x, i: F.when(x["number"] != "", i)), lambda i: i.isNotNull())


def _with_runs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per document and run of lines: doc_id, section, from (place of its first line) and run, its lines; the first run may be empty."""
    x = docs.select(F.col(doc_id).alias("doc_id"), _numbered(text).alias("lines"))
    x = x.select("doc_id", "lines", F.concat(F.array(F.lit(0)), _heads(F.col("lines")), F.array(F.size("lines"))).alias("edges"))
    starts = F.slice("edges", 1, F.size("edges") - 1)
    runs = F.transform(starts, lambda a, i: F.struct(i.alias("section"), a.alias("from"), F.slice("lines", a + 1, F.element_at("edges", i + 2) - a).alias("run")))
    return x.select("doc_id", F.explode(runs).alias("r")).select("doc_id", "r.section", "r.from", "r.run")


def section_runs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, section, section_number, title, n_lines, n_chars: runs of lines from one header to the next; map-side only."""
    first = F.col("run")[0]
    return _with_runs(docs, doc_id, text).where(F.size("run") > 0).select(
        "doc_id", F.col("section").cast("bigint").alias("section"), first["number"].alias("section_number"), first["title"].alias("title"),
        F.size("run").cast("bigint").alias("n_lines"), F.aggregate("run", F.lit(0).cast("bigint"), lambda n, x: n + F.length(x["line"])).alias("n_chars"),
    )


def filled_sections(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, pos and the number of the last header at or before each line; empty before the first. Map-side only."""
    x = _with_runs(docs, doc_id, text)
    return x.select("doc_id", "from", F.col("run")[0]["number"].alias("section_number"), F.posexplode("run").alias("n", "_")).select("doc_id", (F.col("from") + F.col("n")).alias("pos"), "section_number")


# Forms of a section's number at the beginning of a line, and the most characters of its title.
HEADINGS, TITLE_CHARS = (r"(?i)^Section\s+(\d+[A-Za-z]?)", r"^(\d+[A-Za-z]?)\.\s+", r"^(\d+[A-Za-z]?)\s*[–—:-]\s*"), 300


def heading(text: Column) -> tuple[Column, Column]:
    """section_number and section_title of the first line that begins with a section's number; empty without one.

    The title is what follows on the line, or else the next line that shows something, if that isn't too long.
    """
    lines = F.filter(F.transform(F.split(one_line_end(text), "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    number = lambda x: F.coalesce(*[F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for p in HEADINGS])
    at = F.array_position(F.transform(lines, lambda x: number(x).isNotNull()), F.lit(True)).cast("int")
    line, after = F.try_element_at(lines, F.nullif(at, F.lit(0))), F.try_element_at(lines, F.nullif(at, F.lit(0)) + 1)
    bare = F.regexp_replace(F.regexp_replace(line, r"(?i)^Section\s+\d+[A-Za-z]?\s*[.)\-–—:]?\s*", ""), r"^\d+[A-Za-z]?\s*[.)\-–—:]?\s*", "")
    bare = F.regexp_replace(bare, r"^\s+|\s+$", "")
    title = F.when(bare != "", F.substring(bare, 1, TITLE_CHARS)).when(F.length(after) <= TITLE_CHARS, after)
    return F.coalesce(number(line), F.lit("")).alias("section_number"), F.coalesce(title, F.lit("")).alias("section_title")


_HEAD = re.compile(HEADER)
_STOP = re.compile("|".join(re.escape(x) for x in STOPS))
_BLANK_LINES = re.compile(r"\n\s*\n")
#: A window may end at a stop of its last so many characters.
REACH = 200


def windows(body: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Places of the windows of a body. They end at stops, whose places are listed once and searched by bisection.

    A window takes up to `size` characters and ends behind the first character of the last stop within its
    last REACH characters, or after `size` where there is none. The next one begins `overlap` before that
    end, or at the end where this would not lead on.
    """
    found = [m.span() for m in _STOP.finditer(body)]
    behind = [b for _, b in found]
    at, last = 0, len(body)
    while last - at > size:
        full = at + size
        n = bisect_right(behind, full) - 1
        stop = found[n][0] if n >= 0 else -1
        end = stop + 1 if stop > at and stop >= full - REACH else full
        yield at, end
        at = end - overlap if at < end - overlap else end
    if at < last:
        yield at, last


def cut_body(body: str, size: int, overlap: int) -> list[str]:
    """The texts of the windows, without outer white space; blank ones are left out."""
    return [piece for a, b in windows(body, size, overlap) if (piece := body[a:b].strip())]


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[str, str, str]]:
    """(section number, title, chunk): the heading is repeated on each chunk of its section; text without
    headers is packed by paragraphs. Raises ValueError for a size that isn't above the overlap."""
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("size must be positive and above overlap")
    sections: list[tuple[str, str, list[str]]] = [("", "", [])]
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if m := _HEAD.match(line):
            sections.append((m.group(1), m.group(2), []))
        else:
            sections[-1][2].append(line.strip())
    if len(sections) == 1:
        return [("", "", c) for c in pack_paragraphs(text, size, overlap)]
    out = []
    for number, title, body_lines in sections:
        body = "\n".join(body_lines).strip()
        if not number:
            out += [("", "", c) for c in cut_body(body, size, overlap)]
            continue
        heading = f"{number}. {title}"
        room = max(200, size - len(heading) - 2)
        pieces = cut_body(body, room, min(overlap, room // 3))
        out += [(number, title, f"{heading}\n\n{p}") for p in pieces] or [(number, title, heading)]
    return out


def pack_paragraphs(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs between blank lines, packed as long as they fit.

    A full chunk hands its last `overlap` characters to the next one; what grows beyond `size` by that, or is
    longer by itself, is cut into windows, of which the last stays open for the next paragraph only in the
    first case.
    """
    done: list[str] = []
    held = ""
    for paragraph in filter(None, map(str.strip, _BLANK_LINES.split(text.replace("\r\n", "\n").replace("\r", "\n")))):
        joined = f"{held}\n\n{paragraph}" if held else paragraph
        if len(joined) <= size:
            held = joined
        elif not held:
            done += cut_body(paragraph, size, overlap)
        else:
            done.append(held.strip())
            carried = f"{held[-overlap:]}\n\n{paragraph}" if overlap else paragraph
            *more, held = [carried] if len(carried) <= size else cut_body(carried, size, overlap) or [""]
            done += more
    return [*done, held.strip()] if held.strip() else done


_OUT = "doc_id bigint, chunk_index int, section_number string, section_title string, chunk string"
_ARROW = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())


def chunk_rows(docs: DataFrame, doc_id: str, text: str, size: int = SIZE, overlap: int = OVERLAP, kept: list[str] = ()) -> DataFrame:
    """One row for each chunk, map-side; the cut depends on the cut before, which expressions can't state.

    The columns `kept` of the document come along.
    """
    names = _OUT.replace(" bigint", "").replace(" int", "").replace(" string", "").split(", ")
    split_text("", size, overlap)  # refuses sizes that can't be cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of = [], []
            for n, (i, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                found = split_text(t, size, overlap) if t else ()
                rows += [(i, k, *c) for k, c in enumerate(found)]
                of += [n] * len(found)
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            more = [c.take(pa.array(of, pa.int64())) for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([*(pa.array(list(c), t) for c, t in zip(columns, _ARROW, strict=True)), *more], [*names, *batch.schema.names[2:]])

    picked = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), *kept)
    return picked.mapInArrow(run, ", ".join([_OUT, *(f"`{c}` {t}" for c, t in picked.dtypes[2:])]))
