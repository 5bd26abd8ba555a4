"""Inverted index and ranked retrieval for batches of questions.

Questions with the same words are scored once. The asked words, a checked number of questions at a time, are handed to
every task, and the corpus is read where it lies: an Arrow map counts those words inside each row, which is all that is
written down. It serves document frequencies, length statistics and scores; each task keeps the k best documents of each
different question, so that neither postings nor scores are shuffled by question. More different questions than one
pass takes are answered in further passes, with the same rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granthika.functions.text import tokens
from granthika.sources.tables import cut

# Fixed values of the ranking.
K1, B, RRF_K = 1.5, 0.75, 60

#: Different questions that are answered in one pass over the corpus, and the words of them together.
ASKED, ASKED_WORDS = 20_000, 1_000_000

_WORD = re.compile(r"[a-z0-9]+(?:[-'][a-z0-9]+)?")
_POSTINGS = pa.schema([("doc_id", pa.int64()), ("dl", pa.int32()), ("token", pa.string()), ("tf", pa.int32())])
_COUNTS = pa.schema([("doc_id", pa.int64()), ("dl", pa.int32()), ("words", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])
_HITS = pa.schema([("bag", pa.string()), ("doc_id", pa.int64()), ("score", pa.float64())])


def _table(columns: tuple, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, lengths, words, times = [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = Counter(_WORD.findall(text.lower())) if text else {}
            ids += [doc_id] * len(found)
            lengths += [sum(found.values())] * len(found)
            words += found
            times += found.values()
        yield _table((ids, lengths, words, times), _POSTINGS)


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, dl, token, tf; made inside each row, without a shuffle. Documents without a token have no posting."""
    return docs.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(_post, "doc_id bigint, dl int, token string, tf int")


def _counted(docs: DataFrame, doc_id: str, text: str, words: list[str]) -> DataFrame:
    """doc_id, dls, words, times: of each id the lengths of its rows, and by number the given words that they have."""
    known = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in batches:
            lengths, held, times = [], [], []
            for text in batch.column(1).to_pylist():
                found = _WORD.findall(text.lower()) if text else []
                few = Counter(number[w] for w in found if w in number)
                lengths.append(len(found))
                held.append(list(few))
                times.append(list(few.values()))
            yield _table((batch.column(0), lengths, held, times), _COUNTS)

    rows = docs.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(count, "doc_id bigint, dl int, words array<int>, times array<int>")
    of_id = rows.groupBy("doc_id").agg(F.collect_list(F.struct("dl", "words", "times")).alias("r"))
    return of_id.select("doc_id", F.col("r.dl").alias("dls"), F.flatten("r.words").alias("words"), F.flatten("r.times").alias("times"))


def _weights(batch: pa.RecordBatch, avgdl: float, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and weight of each posting of a batch, by word; a weight is summed over the rows that an id has."""
    n_dl, n_words_of = (np.diff(batch.column(c).offsets.to_numpy()) for c in (1, 2))
    dls, words, times = (batch.column(c).flatten().to_numpy() for c in (1, 2, 3))
    key, at = np.unique(np.repeat(np.arange(batch.num_rows) * n_words, n_words_of) + words, return_inverse=True)
    row, word, tf = key // n_words, key % n_words, np.bincount(at, times, len(key))
    each = np.repeat(np.arange(len(key)), n_dl[row])
    nth = np.arange(len(each)) - np.repeat(np.cumsum(n_dl[row]) - n_dl[row], n_dl[row])
    dl = dls[(np.cumsum(n_dl) - n_dl)[row[each]] + nth]
    norm = np.maximum(tf[each] + K1 * (1 - B + B * dl / max(avgdl, 1.0)), 1e-9)
    weight = np.bincount(each, tf[each] * (K1 + 1) / norm, len(key))
    order = np.argsort(word, kind="stable")
    return row[order], word[order], weight[order]


def _scorer(bags: list[str], number: dict[str, int], idf: dict[int, float], avgdl: float, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores batches for every bag of words and hands on the k best documents of each."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [[(number[w], n * idf.get(number[w], 0.0)) for w, n in sorted(Counter(bag.split(" ")).items())] for bag in bags]
        best, ids_of, edge = [np.empty(0)] * len(bags), [np.empty(0, np.int64)] * len(bags), np.zeros(len(bags))
        for batch in batches:
            ids = batch.column(0).to_numpy()
            row, word, weight = _weights(batch, avgdl, len(number))
            there, starts = np.unique(word, return_index=True)
            held = {}
            for w, a, z in zip(there.tolist(), starts, np.append(starts, len(word))[1:], strict=True):
                rows, values = row[a:z], weight[a:z]
                if z - a > len(ids) // 8:  # words of many documents are added as whole columns
                    whole = np.zeros(len(ids))
                    whole[rows] = values
                    rows, values = slice(None), whole
                held[w] = rows, values, values.max()
            for b, words in enumerate(asked):
                some = [(*held[w], n) for w, n in words if w in held]
                if not some or sum(n * most for *_, most, n in some) < edge[b] - 1e-6:  # no document can come in
                    continue
                total = np.zeros(len(ids))
                for rows, values, _, n in some:
                    total[rows] += n * values
                new = np.flatnonzero(total >= max(edge[b] - 1e-6, 1e-7))
                near, near_ids = np.floor(total[new] * 1e6 + 0.5) / 1e6, ids[new]
                near, near_ids = np.concatenate([best[b], near[near > 0]]), np.concatenate([ids_of[b], near_ids[near > 0]])
                if len(near) > 4 * k:  # all that are as good as the k-th, so that ties stay exact
                    kept = near >= np.partition(near, len(near) - k)[len(near) - k]
                    near, near_ids = near[kept], near_ids[kept]
                top = np.lexsort((near_ids, -near))[:k]
                best[b], ids_of[b] = near[top], near_ids[top]
                edge[b] = near[top[-1]] if len(top) == k else 0.0
        for a in range(0, len(bags), 1000):
            part = slice(a, a + 1000)
            names = [bag for bag, found in zip(bags[part], best[part], strict=True) for _ in range(len(found))]
            yield _table((names, np.concatenate(ids_of[part]), np.concatenate(best[part])), _HITS)

    return score


def _answered(bags: list[str], docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """bag, doc_id, score, rank of the k best documents of each bag of words, in one pass over the corpus."""
    words = sorted({w for bag in bags for w in bag.split(" ")})
    index = cut(_counted(docs, doc_id, text, words))
    one = index.agg(F.sum(F.size("dls")).alias("n"), F.sum(F.aggregate("dls", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("words")).first()
    df = index.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").count().collect()
    idf = {r.w: math.log(1 + (one.n - r["count"] + 0.5) / (r["count"] + 0.5)) for r in df}
    handed = index.sparkSession.sparkContext.broadcast((bags, {w: i for i, w in enumerate(words)}, idf, one.words / one.n if one.n else 1.0))
    hits = index.where(F.col("doc_id").isNotNull()).mapInArrow(lambda batches: _scorer(*handed.value, k)(batches), "bag string, doc_id bigint, score double")
    return cut(ranked(hits, F.col("score").desc(), k, "bag"))


def asked(questions: DataFrame) -> DataFrame:
    """qid, bag: the sorted words of each question (qid, question); questions with the same bag have the same documents."""
    words = questions.groupBy("qid").agg(F.array_sort(F.flatten(F.collect_list(tokens(F.col("question"))))).alias("words"))
    return words.where(F.size("words") > 0).select("qid", F.array_join("words", " ").alias("bag"))


def best(questions: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int, most: int = ASKED) -> DataFrame:
    """bag, doc_id, score, rank of the k best documents of each different bag of words of asked questions (qid, bag).

    A token that a question repeats counts as often as it occurs. Ties go to the smaller doc_id.
    """
    bags = questions.select("bag").distinct()
    size = bags.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(F.split("bag", " "))), F.lit(0)).alias("words")).first()
    passes = max(1, -(-size.n // most), -(-size.words // ASKED_WORDS))
    of_pass = lambda i: sorted(r.bag for r in bags.where(F.pmod(F.xxhash64("bag"), F.lit(passes)) == i).collect())
    return reduce(DataFrame.unionAll, [_answered(of_pass(i), docs, doc_id, text, k) for i in range(passes)])


def bm25(questions: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """qid, doc_id, score, rank of the k best documents of each question (qid, question)."""
    of = asked(questions)
    return of.join(best(of, docs, doc_id, text, k), "bag").select("qid", "doc_id", "score", "rank")


def ranked(scored: DataFrame, order: Column, k: int, by: str = "qid") -> DataFrame:
    w = Window.partitionBy(by).orderBy(order, F.col("doc_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(ranks: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of rows (qid, doc_id, method, rank, weight): rrf and the sorted methods."""
    return ranks.groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("weight") / (RRF_K + F.col("rank"))), 8).alias("rrf"), F.array_join(F.array_sort(F.collect_set("method")), "+").alias("methods"))


def min_max(col: Column, by: str = "qid") -> Column:
    """Scaled to 0..1 among the rows of a question; missing values and constant sets are 0."""
    w = Window.partitionBy(by)
    lo, hi = F.min(col).over(w), F.max(col).over(w)
    return F.coalesce(F.when(hi > lo, (col - lo) / (hi - lo)), F.lit(0.0))
