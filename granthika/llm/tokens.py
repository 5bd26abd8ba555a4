"""Encoding of a corpus with a public byte-level tokenizer (problem 7).

Text is cut where the tokenizer's own split can't depend on the neighbourhood: before a single space
between two characters that show. The cut words repeat, so each Python worker keeps their ids in a bounded
table and the merges run once per distinct word.

Long texts become pieces that are encoded in parallel by tree concatenation. A piece ends at such a safe
cut where there is one; inside a long unsplit run it ends in the middle of the run, and the two halves of
the run are joined later: growing windows of ids around the join are encoded again until the window's first
and last ids agree with those of both sides. Every adjacent pair of ids then occurs in a valid encoding,
which makes the joined ids exactly those of the whole run.

Defined results: null and empty texts have an empty list of ids; blank texts are encoded as they are; the
strings of special tokens are ordinary text; lone surrogates count as the replacement character; repeated
rows give repeated rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The folder of the vocabularies; a parameter of every function that needs one.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"

# Fixed value: the pattern by which this tokenizer splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts longer than this many characters are cut into pieces of this size.
PIECE_CHARS = 16_384
#: Distinct words kept per Python worker; beyond this the table starts afresh, which changes no result.
CACHE_WORDS = 200_000
#: Pieces of one text that a task joins on the first level of the tree.
FAN_IN = 32

_BESIDE_SPACE = re.compile(r" \s|\s ")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """The tokenizer with a table of the ids of words that follow a space."""

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._enc = tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self._bytes = {i: b for b, i in ranks.items()}
        self._split = regex.compile(SPLIT)
        self._known: dict[str, array] = {}

    def plain(self, text: str) -> list[int]:
        try:
            return self._enc.encode_ordinary(text)
        except UnicodeEncodeError:
            return self._enc.encode_ordinary(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))

    def words(self, text: str) -> list[str]:
        return text.split(" ") if not _BESIDE_SPACE.search(text) else _SAFE_CUT.split(text)

    def extend(self, ids: array, text: str) -> None:
        """Append the ids of the text."""
        first, *rest = self.words(text)
        ids.extend(self.plain(first))
        known = self._known
        if len(known) > CACHE_WORDS:
            known.clear()
        for word in rest:
            found = known.get(word)
            if found is None:
                found = known[word] = array("i", self.plain(" " + word))
            ids.extend(found)

    def count(self, text: str) -> int:
        ids = array("i")
        self.extend(ids, text)
        return len(ids)

    def run(self, data: bytes) -> list[int]:
        """Ids of bytes that the pattern doesn't split."""
        return self._enc._encode_single_piece(data)

    def join(self, left: list[int], right: list[int], window: int = 8) -> list[int]:
        """Ids of an unsplit run from the ids of its two parts."""
        text = self._bytes
        while True:
            a, b = left[-window:], right[:window]
            mid = self.run(b"".join([text[i] for i in a] + [text[i] for i in b]))
            agrees_left = window >= len(left) or mid[0] == a[0]
            agrees_right = window >= len(right) or mid[-1] == b[-1]
            if agrees_left and agrees_right:
                return left[: max(0, len(left) - window)] + mid + right[window:]
            window *= 2

    def piece(self, text: str) -> tuple[list[int], int, int]:
        """Ids of a piece, and how many of them the first and the last run of the piece have."""
        ids = array("i")
        self.extend(ids, text)
        head = self._split.match(text).group()
        for m in self._split.finditer(text):
            last = m.group()
        return list(ids), len(self.run(head.encode())), len(self.run(last.encode()))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(text: str, size: int) -> list[tuple[int, bool]]:
    """Where a long text is cut: (position, whether the cut is inside an unsplit run).

    Each cut is the last safe one of the coming `size` characters. Where there is none, the cut falls
    between two characters of one class, neither of them an apostrophe, at or before the end of the window.
    """
    out, start = [], 0
    while len(text) - start > size:
        at = 0
        p = text.rfind(" ", start + 1, start + size)
        while p > start:
            if not text[p - 1].isspace() and not text[p + 1].isspace():
                at = p
                break
            p = text.rfind(" ", start + 1, p)
        if at:
            out.append((at, False))
        else:
            at = start + size
            while at > start + 1 and not _same_class(text, at):
                at -= 1
            if at <= start + 1:  # no such place in the window: look beyond it
                at = start + size
                while at < len(text) and not _same_class(text, at):
                    at += 1
                if at >= len(text):
                    break
            out.append((at, True))
        start = at
    return out


def _kind(c: str) -> int:
    import unicodedata

    if c.isspace():
        return 0
    k = unicodedata.category(c)[0]
    return {"L": 1, "N": 2}.get(k, 3)


def _same_class(text: str, at: int) -> bool:
    """Whether the pattern keeps text[at - 1] and text[at] in one run, with room on both sides."""
    near = text[max(0, at - 4) : at + 4]
    if "'" in near:
        return False
    return len({_kind(c) for c in near}) == 1


def _encode(path: str, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            flat, ends = array("i"), [0]
            for text in batch.column(1).to_pylist():
                if text:
                    enc.extend(flat, text)
                ends.append(len(flat))
            if counts:
                n = pa.array(np.diff(np.asarray(ends, dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), n], ["doc_id", "n_tokens"])
            else:
                values = pa.array(np.frombuffer(flat, dtype=np.int32) if len(flat) else np.empty(0, np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    return run


def _pieces(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(batch.column(2).to_pylist(), batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                marks = cuts(text, size)
                edges = [0, *(p for p, _ in marks), len(text)]
                parts = [text[a:b] for a, b in zip(edges, edges[1:])]
                glued = [g for _, g in marks] + [False]
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * n, pa.int64()), pa.array([doc_id] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(glued), pa.array(parts, pa.string())],
                    ["row", "doc_id", "piece", "glued", "part"],
                )

    return run


_PIECE = "row bigint, doc_id bigint, piece int, last_piece int, glued boolean, ids array<int>, head int, tail int"
_PIECE_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("last_piece", pa.int32()), ("glued", pa.bool_()), ("ids", pa.list_(pa.int32())), ("head", pa.int32()), ("tail", pa.int32())])


def _encode_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids, heads, tails = [], [], []
            for text in batch.column(4).to_pylist():
                a, head, tail = enc.piece(text)
                ids.append(a), heads.append(head), tails.append(tail)
            row, doc, piece, glued = (batch.column(i) for i in range(4))
            yield pa.RecordBatch.from_arrays([row, doc, piece, piece, glued, pa.array(ids, pa.list_(pa.int32())), pa.array(heads, pa.int32()), pa.array(tails, pa.int32())], schema=_PIECE_ARROW)

    return run


def merge(enc: Encoder, a: dict, b: dict) -> dict:
    """Two neighbouring pieces as one; `a` comes first."""
    if not a["glued"]:
        return b | {"piece": a["piece"], "ids": a["ids"] + b["ids"], "head": a["head"]}
    left, right = a["ids"], b["ids"]
    mid = enc.join(left[len(left) - a["tail"] :], right[: b["head"]])
    ids = left[: len(left) - a["tail"]] + mid + right[b["head"] :]
    one_a, one_b = a["tail"] == len(left), b["head"] == len(right)  # a single run each
    head = len(mid) if one_a else a["head"]
    tail = len(mid) if one_b else b["tail"]
    return b | {"piece": a["piece"], "ids": ids, "head": head, "tail": tail}


def concatenate(enc: Encoder, parts: list[dict]) -> dict:
    """The pieces of a text joined as a balanced tree."""
    while len(parts) > 1:
        parts = [merge(enc, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _join(path: str):
    def run(part: pa.Table) -> pa.Table:
        rows = sorted(part.select(_PIECE_ARROW.names).to_pylist(), key=lambda r: r["piece"])
        return pa.Table.from_pylist([concatenate(encoder(path), rows)], schema=_PIECE_ARROW)

    return run


def _split_long(documents: DataFrame, doc_id: str, text: str, piece_chars: int) -> tuple[DataFrame, DataFrame]:
    docs = documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[text].alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0))
    return docs.where(size <= piece_chars), docs.where(size > piece_chars)


def _long_ids(long: DataFrame, path: str, piece_chars: int) -> DataFrame:
    # A row number of the task and row tells repeated documents apart; it is set before the only shuffle.
    cut = long.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_pieces(piece_chars), "row bigint, doc_id bigint, piece int, glued boolean, part string")
    done = cut.repartition("doc_id", "row", "piece").mapInArrow(_encode_pieces(path), _PIECE)
    near = done.groupBy("row", "doc_id", F.floor(F.col("piece") / FAN_IN).alias("branch")).applyInArrow(_join(path), _PIECE)
    return near.groupBy("row", "doc_id").applyInArrow(_join(path), _PIECE).select("doc_id", "ids")


def encode(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = BYTE_BPE_50K, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """doc_id and ids of every row. Texts of up to `piece_chars` are encoded where they are read, without a
    shuffle; only the pieces of longer ones are shuffled, so that one long text is encoded by many tasks."""
    path = os.path.join(folder, vocabulary)
    short, long = _split_long(documents, doc_id, text, piece_chars)
    return short.mapInArrow(_encode(path, False), "doc_id bigint, ids array<int>").unionAll(_long_ids(long, path, piece_chars))


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = BYTE_BPE_50K, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """doc_id and n_tokens of every row."""
    path = os.path.join(folder, vocabulary)
    short, long = _split_long(documents, doc_id, text, piece_chars)
    counted = _long_ids(long, path, piece_chars).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"))
    return short.mapInArrow(_encode(path, True), "doc_id bigint, n_tokens bigint").unionAll(counted)
