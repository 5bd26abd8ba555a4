"""Retrieval: statistics of the index, lexical and vector search, fusion, knowledge-base search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granthika.functions.text import AMENDMENT_NOTE, normalise, script_language, tokens
from granthika.operators import facts, index, vectors
from granthika.operators.names import holding
from granthika.operators.store import latest_n
from granthika.sources.tables import table

CANDIDATES, FINAL = 30, 8

#: Ids that are handed to every task.
HELD_IDS = 1_000_000


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: the titles of the documents whose id is divisible by 100."""
    return table(spark, d, "documents").where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("qid"), F.col("title").alias("question"), F.col("route").alias("q_route"))


def token_df_top(spark: SparkSession, d: str) -> DataFrame:
    """AGG-02, AGG-03: the hundred most frequent tokens by documents."""
    posts = index.postings(table(spark, d, "documents"), "doc_id", "text")
    return posts.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).orderBy(F.desc("df"), "token").limit(100)


def doc_length_stats(spark: SparkSession, d: str) -> DataFrame:
    """AGG-02: token lengths by source."""
    n = F.size(tokens(F.col("text")))
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_tokens"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("avgdl"))


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return index.bm25(_questions(spark, d), table(spark, d, "documents"), "doc_id", "text", CANDIDATES)


def _found(spark: SparkSession, d: str, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """qid, bag of the questions and bag, doc_id, score, rank of their candidates: what depends on the words alone is done once for all questions that share them."""
    asked = index.asked(questions)
    return asked, index.best(asked, table(spark, d, "documents"), "doc_id", "text", CANDIDATES)


def _docs_of(spark: SparkSession, d: str, hits: DataFrame, **columns: Column) -> DataFrame:
    """doc_id and the columns of the documents among hits; texts of others are dropped where they are read."""
    ids = hits.select("doc_id").distinct()
    docs = table(spark, d, "documents").select("doc_id", *[c.alias(name) for name, c in columns.items()])
    return docs.join(F.broadcast(ids) if ids.count() <= HELD_IDS else ids, "doc_id", "left_semi")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """RET-02..05, JOIN-04, TOP-01."""
    return _bm25(spark, d).select("qid", "doc_id", "score", "rank")


def _knn(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return vectors.nearest(v, v.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding", CANDIDATES)


def knn_l2_topk(spark: SparkSession, d: str) -> DataFrame:
    """RET-09, TOP-02: squared distance and 1 / (1 + d)."""
    return _knn(spark, d).select("qid", "doc_id", "distance", "similarity", "rank")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    one = lambda df, name, score: df.select("qid", "doc_id", F.lit(name).alias("method"), "rank", F.lit(1.0).alias("weight"), F.col(score).alias("score"))
    return one(_bm25(spark, d), "bm25", "score").unionAll(one(_knn(spark, d), "semantic", "similarity"))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """RET-12, JOIN-03, AGG-04, WIN-01: a document's vector is the one of its id."""
    return index.fuse(_fused(spark, d))


def minmax_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """RET-13, RET-16, FLT-04, FLT-05, TOP-03, TOP-04: fused, scaled, weighted, routed and cut to the final list."""
    rows = _fused(spark, d)
    fused = rows.groupBy("qid", "doc_id").agg(
        F.sum(F.col("weight") / (index.RRF_K + F.col("rank"))).alias("rrf"),
        F.max(F.when(F.col("method") == "bm25", F.col("score"))).alias("bm25"), F.max(F.when(F.col("method") == "semantic", F.col("score"))).alias("semantic"),
    )
    docs = table(spark, d, "documents").select("doc_id", "route", F.col("title"))
    x = fused.join(_questions(spark, d).select("qid", "q_route"), "qid").join(docs, "doc_id")
    x = x.withColumn("bm25n", index.min_max(F.col("bm25"))).withColumn("semn", index.min_max(F.col("semantic")))
    same = F.when(F.col("route") == F.col("q_route"), 3.0).when(F.coalesce(F.col("route"), F.lit("")) != "", -6.0).otherwise(0.0)
    noise = F.when(F.lower("title").rlike(AMENDMENT_NOTE), 25.0).otherwise(0.0)
    scored = x.withColumn("score", F.round(F.col("rrf") + 0.25 * F.col("bm25n") + 0.35 * F.col("semn") + same - noise, 6))
    passed = scored.where((F.coalesce("route", F.lit("")) == "") | (F.coalesce("q_route", F.lit("")) == "") | (F.col("route") == F.col("q_route")))
    return index.ranked(passed, F.col("score").desc(), FINAL).select("qid", "doc_id", "score", "rank")


def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    """SET-02: the share of a title's words that its text has."""
    x = table(spark, d, "documents").select("doc_id", F.array_distinct(tokens(F.col("title"))).alias("a"), F.array_distinct(tokens(F.col("text"))).alias("b"))
    return x.select("doc_id", F.round(F.coalesce(F.try_divide(F.size(F.array_intersect("a", "b")), F.size("a")), F.lit(0.0)), 6).alias("overlap"))


def section_expansion(spark: SparkSession, d: str) -> DataFrame:
    """RET-17, JOIN-05, FLT-10: for each question all documents of the first three different sections among its candidates, same route."""
    docs = table(spark, d, "documents").where(F.coalesce("section_number", F.lit("")) != "").select("doc_id", "section_number", "route")
    asked, hits = _found(spark, d, _questions(spark, d))
    first = hits.join(docs, "doc_id").groupBy("bag", "section_number", "route").agg(F.min("rank").alias("first"))
    chosen = latest_n(first, "bag", [F.col("first")], 3).select("bag", "section_number", "route")
    return asked.join(chosen, "bag").join(docs, ["section_number", "route"]).select("qid", "doc_id", "section_number", F.lit(0.15).alias("score"))


def _searches(spark: SparkSession, d: str) -> DataFrame:
    """Sub-queries of each question: its title, its act, and section and act; qid, hop, question."""
    docs = table(spark, d, "documents").where(F.col("doc_id") % 100 == 0)
    section = F.when(F.coalesce("section_number", F.lit("")) != "", F.concat_ws(" ", F.lit("section"), "section_number", "act_name"))
    each = F.filter(F.array(F.col("title"), F.col("act_name"), section), lambda q: F.coalesce(q, F.lit("")) != "")
    return docs.select(F.col("doc_id").alias("qid"), F.posexplode(F.array_distinct(each)).alias("hop", "question"))


def _hops(spark: SparkSession, d: str, *alike: Column) -> DataFrame:
    """qid, hop, doc_id, rank, alike of the candidates of every sub-query, all retrieved in one batch; alike is the least id of a candidate of any question that equals it in the given columns."""
    asked, hits = _found(spark, d, _searches(spark, d).select((F.col("qid") * MOST_HOPS + F.col("hop")).alias("qid"), "question"))
    docs = _docs_of(spark, d, hits, **{f"c{i}": c for i, c in enumerate(alike)})
    same = docs.select("doc_id", F.min("doc_id").over(Window.partitionBy(docs.columns[1:])).alias("alike"))
    x = asked.join(hits.join(same, "doc_id"), "bag")
    return x.select(F.floor(F.col("qid") / MOST_HOPS).cast("bigint").alias("qid"), F.pmod("qid", F.lit(MOST_HOPS)).cast("int").alias("hop"), "doc_id", "rank", "alike")


#: Sub-queries of a question, weight of the first, characters by which equal texts are known, and texts that are verified.
MOST_HOPS, FIRST_WEIGHT, PREFIX, SOURCES, EXCERPT, CARDS = 4, 1.2, 120, 8, 350, 5
# Authority of an act of the catalogue, and of any other source.
CATALOGUED, OTHER = 1.0, 0.85


def multi_query_union(spark: SparkSession, d: str) -> DataFrame:
    """RET-10, SET-04: candidates of all sub-queries one after the other, the first of those that begin alike, by position."""
    hops = _hops(spark, d, F.substring(F.coalesce("text", F.lit("")), 1, PREFIX))
    x = hops.groupBy("qid", "alike").agg(F.min(F.struct("hop", "rank", "doc_id")).alias("m")).select("qid", "m.*")
    w = Window.partitionBy("qid").orderBy("hop", "rank")
    return x.select("qid", "doc_id", F.row_number().over(w).alias("place"))


def multi_hop_fusion(spark: SparkSession, d: str) -> DataFrame:
    """HOP-01, TOP-05, TOP-09, DOC-13: ranks of all sub-queries fused, the first one's counting more; the best of each title and section, ten each."""
    hops = _hops(spark, d, F.coalesce("title", F.lit("")), F.coalesce("section_number", F.lit("")))
    weight = F.when(F.col("hop") == 0, FIRST_WEIGHT).otherwise(1.0)
    fused = hops.groupBy("qid", "doc_id", "alike").agg(F.round(F.sum(weight / (index.RRF_K + F.col("rank"))), 8).alias("rrf"))
    best = fused.groupBy("qid", "alike").agg(F.max_by(F.struct("doc_id", "rrf"), F.struct(F.col("rrf"), -F.col("doc_id"))).alias("b"))
    return index.ranked(best.select("qid", "b.*"), F.col("rrf").desc(), 10).select("qid", "doc_id", F.round("rrf", 4).alias("score"), "rank")


def section_dedup(spark: SparkSession, d: str) -> DataFrame:
    """RET-18: of the candidates of a question the first of each act, source and section, or of each beginning where there is no section."""
    section = F.coalesce("section_number", F.lit(""))
    key = F.when(section != "", section).otherwise(F.concat(F.lit("\x01"), F.substring(F.coalesce("text", F.lit("")), 1, PREFIX)))
    asked, hits = _found(spark, d, _questions(spark, d))
    docs = _docs_of(spark, d, hits, act=F.coalesce("title", "act_name", F.lit("")), source=F.coalesce("source", F.lit("")), key=key)
    first = hits.join(docs, "doc_id").groupBy("bag", "act", "source", "key").agg(F.min(F.struct("rank", "doc_id")).alias("m"))
    return asked.join(first.select("bag", "m.doc_id", "m.rank"), "bag").drop("bag")


def section_accessor(spark: SparkSession, d: str) -> DataFrame:
    """RET-21: the section of each document, from its number or else from the beginning of its title."""
    of_title = F.regexp_extract(F.coalesce("title", F.lit("")), r"^(?:Section\s*)?([0-9]+[A-Za-z]?)\b", 1)
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(F.trim("section_number"), F.lit("")), of_title).alias("section"))


def rerank_threshold(spark: SparkSession, d: str) -> DataFrame:
    """FLT-06: candidates with a fused score above 0.05 or a similarity above 0.4, or else the first three of the question."""
    x = _fused(spark, d).groupBy("qid", "doc_id").agg(F.sum(F.col("weight") / (index.RRF_K + F.col("rank"))).alias("rrf"), F.max(F.when(F.col("method") == "semantic", F.col("score"))).alias("semantic"))
    x = x.withColumn("good", (F.round("rrf", 8) > 0.05) | (F.coalesce("semantic", F.lit(0.0)) > 0.4))
    w = Window.partitionBy("qid")
    x = x.withColumn("any", F.bool_or("good").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.round("rrf", 8).desc(), "doc_id")))
    return x.where(F.col("good") | ~F.col("any") & (F.col("place") <= 3)).select("qid", "doc_id")


def source_cards(spark: SparkSession, d: str) -> DataFrame:
    """CIT-04: the final list of each question as cards, five each."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("act_name", "title", F.lit("Statutory Act")).alias("act_name"), F.coalesce(F.nullif("section_number", F.lit("")), F.lit("General")).alias("section"), F.coalesce("authority", F.lit("Government of India")).alias("authority"), F.col("act_year").alias("year"), "source", F.coalesce(F.nullif("route", F.lit("")), F.lit("general")).alias("route"))
    return minmax_hybrid(spark, d).where(F.col("rank") <= CARDS).join(docs, "doc_id").select("qid", "rank", "act_name", "section", "authority", "year", "source", F.when(F.col("score") > 0.3, "high").otherwise("verified").alias("confidence"), "route")


def source_list(spark: SparkSession, d: str) -> DataFrame:
    """CIT-05: the first five different sources and sections among the candidates of a question."""
    asked, hits = _found(spark, d, _questions(spark, d))
    docs = _docs_of(spark, d, hits, source=F.coalesce("source", F.lit("")), section=F.coalesce("section_number", F.lit("")))
    first = hits.join(docs, "doc_id").groupBy("bag", "source", "section").agg(F.min("rank").alias("first"))
    return asked.join(latest_n(first, "bag", [F.col("first")], 5), "bag").select("qid", "source", "section", "place")


def _verified(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """qid, bag of the questions, and by bag the sources with their rank."""
    asked, hits = _found(spark, d, _questions(spark, d))
    acts = table(spark, d, "acts").select("act_name", F.lit(CATALOGUED).alias("known")).distinct()
    bare, title, section = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""), F.coalesce("title", F.lit("")), F.coalesce("section_number", F.lit(""))
    excerpt = F.concat(F.substring(bare, 1, EXCERPT), F.when(F.length(bare) > EXCERPT, "...").otherwise(""))
    docs = _docs_of(spark, d, hits, title=title, section=section, act_name=F.col("act_name"), is_verified=(section != "") | (title != "") | (F.length(bare) > 40), excerpt=excerpt)
    first = hits.join(docs, "doc_id").groupBy("bag", "title", "section").agg(F.min(F.struct("rank", "doc_id", "act_name", "is_verified", "excerpt")).alias("m"))
    kept = latest_n(first.select("bag", "title", "section", "m.*"), "bag", [F.col("rank")], SOURCES).join(acts, "act_name", "left")
    return asked, kept.select("bag", "doc_id", "rank", "title", "section", "is_verified", "excerpt", F.coalesce("known", F.lit(OTHER)).alias("authority_score"))


def verified_sources(spark: SparkSession, d: str) -> DataFrame:
    """CIT-02, CIT-03, TOP-06: the first eight different titles and sections of a question, verified, by authority."""
    asked, sources = _verified(spark, d)
    w = Window.partitionBy("bag").orderBy(F.desc("authority_score"), "rank")
    return asked.join(sources.withColumn("place", F.row_number().over(w)).drop("rank"), "bag").drop("bag")


def source_authority(spark: SparkSession, d: str) -> DataFrame:
    """AGG-09: sources and average authority of each question."""
    asked, sources = _verified(spark, d)
    return asked.join(sources.groupBy("bag").agg(F.count("*").alias("n_sources"), F.round(F.avg("authority_score"), 6).alias("avg_authority")), "bag").drop("bag")


def evidence_graph(spark: SparkSession, d: str) -> DataFrame:
    """GPH-01: the edges from each question over its text's first sums and deadlines to the issue, and on to provisions and their sources."""
    docs = table(spark, d, "documents").where(F.col("doc_id") % 100 == 0)
    text = F.coalesce("text", F.lit(""))
    few = lambda items: F.least(F.size(items), F.lit(2))
    sums = F.filter(F.array_distinct(F.transform(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in facts.AMOUNTS]), lambda v: F.lower(F.regexp_replace(v, r"[^0-9A-Za-z_]", "")))), lambda v: v != "")
    counted = docs.select(F.col("doc_id").alias("qid"), few(sums).alias("sums"), few(facts.values(F.col("text"), "notice_deadline")).alias("days"))
    named = lambda n, name, how: F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)")), lambda i: F.struct(F.concat(F.lit(name), i.cast("string")).alias("id"), F.lit(how).alias("how")))
    claims = F.concat(named(F.col("sums"), "node_claim_amt_", "references_claim"), named(F.col("days"), "node_claim_dl_", "stipulates_timeline"))
    inquiry = F.array(F.struct(F.lit("node_fact_inquiry").alias("id"), F.lit("formulates_inquiry").alias("how")))
    claim = counted.select("qid", F.explode(F.when(F.col("sums") + F.col("days") > 0, claims).otherwise(inquiry)).alias("c"))
    edge = lambda a, b, how: F.struct(a.alias("source_id"), b.alias("target_id"), how.alias("relationship"))
    above = claim.select("qid", F.explode(F.array(edge(F.lit("node_question"), F.col("c.id"), F.col("c.how")), edge(F.col("c.id"), F.lit("node_legal_issue"), F.lit("raises_issue")))).alias("e"))
    found = verified_sources(spark, d).where("place <= 4").select("qid", (F.col("place") - 1).cast("string").alias("i"))
    prov, src = F.concat(F.lit("node_prov_"), "i"), F.concat(F.lit("node_src_"), "i")
    below = found.select("qid", F.explode(F.array(edge(F.lit("node_legal_issue"), prov, F.lit("governed_by")), edge(prov, src, F.lit("codified_in")))).alias("e"))
    return above.unionAll(below).select("qid", "e.*")


def kb_filtered(spark: SparkSession, d: str) -> DataFrame:
    """FLT-01: documents by parts of domain, section and authority; `all` leaves one out."""
    return kb_filter(table(spark, d, "documents"), domain="tenancy", section="1", authority="all").select("doc_id", "route", "act_name", "section_number")


def kb_filter(docs: DataFrame, domain: str = "all", section: str = "all", authority: str = "all") -> DataFrame:
    has = lambda c, part: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(part.lower()))
    for wanted, test in ((domain, lambda p: has("route", p) | has("act_name", p)), (section, lambda p: has("section_number", p)), (authority, lambda p: has("authority", p))):
        if wanted.lower() not in ("", "all"):
            docs = docs.where(test(wanted))
    return docs


def label_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """AGG-10: how many labelled documents have the language of their script, in percent by label."""
    x = table(spark, d, "documents").where(F.coalesce("lang", F.lit("")) != "").select("lang", F.substring(script_language(F.col("text")), 1, 2).alias("found"))
    same = (F.when(F.col("found") == "ka", "kn").otherwise(F.col("found")) == F.col("lang")).cast("int")
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(same) * 100, 4).alias("accuracy"))


def kb_search(spark: SparkSession, d: str) -> DataFrame:
    """FLT-01..03, TOP-07: each act's name searched over the dataset sections, five best."""
    acts = table(spark, d, "acts").select(F.col("act_id").cast("bigint").alias("act_id"), F.lower("act_name").alias("q"))
    rows = table(spark, d, "datasets").select("dataset_id", "act_name", "section_number", "section_title", "text")
    met = holding(rows, ["lower(text)", "lower(act_name)"], acts, "act_id", "q")
    x = met.where(F.size("held") > 0).withColumn("act_id", F.explode("held")).join(acts, "act_id").withColumn("act_id", F.col("act_id").cast("int"))
    body = F.lower(F.concat_ws(" ", F.col("act_name"), F.col("section_title"), F.col("text")))
    words = F.split("q", " ")
    hits = F.size(F.filter(words, lambda w: F.contains(body, w)))
    score = F.when(F.lower(F.coalesce("act_name", F.lit(""))).contains(F.col("q")), 30.0).otherwise(0.0) + F.when(F.lower(F.coalesce("section_title", F.lit(""))).contains(F.col("q")), 25.0).otherwise(0.0) + hits / F.size(words) * 20
    flat = normalise(F.col("text"))
    snippet = F.when(F.length(flat) > 280, F.concat(F.rtrim(F.substring(flat, 1, 280)), F.lit("..."))).otherwise(flat)
    scored = x.select("act_id", "dataset_id", F.round(F.least(score, F.lit(100.0)), 1).alias("relevance"), snippet.alias("snippet"))
    return latest_n(scored, "act_id", [F.desc("relevance"), F.col("dataset_id")], 5)


def kb_stats(spark: SparkSession, d: str) -> DataFrame:
    """AGG-01: counts by route, document type and authority in one pass."""
    docs = table(spark, d, "documents")
    facet = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("general")).alias("value")) for c in ("route", "document_type", "authority")]))
    return docs.select("doc_id", "act_name", facet.alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n_docs"), F.countDistinct("act_name").alias("n_acts"))


def kb_acts_catalog(spark: SparkSession, d: str) -> DataFrame:
    """AGG-01, TOP-11, JOIN-07: documents per act with the attributes of the first one, and the act's own year."""
    docs = table(spark, d, "documents").groupBy("act_name").agg(F.count("*").alias("n_docs"), F.min_by("authority", "doc_id").alias("authority"), F.min("doc_id").alias("first_doc"))
    return table(spark, d, "acts").join(docs, "act_name", "left").select("act_name", "act_year", "route", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "authority", "first_doc")


def statute_resolve(spark: SparkSession, d: str) -> DataFrame:
    """CIT-01, JOIN-08: the first act, in table order, that each request's text names; each text is read once for all acts."""
    acts = table(spark, d, "acts").select("act_id", F.lower("act_name").alias("q"))
    texts = table(spark, d, "analyze_text_requests").select("request_id", normalise(F.col("text")).alias("t"))
    met = holding(texts, ["t"], acts, "act_id", "q").where(F.size("held") > 0)
    return met.groupBy("request_id").agg(F.min(F.array_min("held")).cast("int").alias("act_id"), F.sum(F.size("held")).alias("n_acts"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (token_df_top, doc_length_stats, bm25_topk, knn_l2_topk, rrf_fusion, minmax_hybrid, token_overlap, section_expansion, kb_search, kb_stats, kb_acts_catalog, statute_resolve, multi_query_union, multi_hop_fusion, section_dedup, section_accessor, rerank_threshold, source_cards, source_list, verified_sources, source_authority, evidence_graph, kb_filtered, label_accuracy)}


_TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '([a-z0-9]+(?:[-''][a-z0-9]+)?)', 1)"
_BM25 = rf"""
WITH toks AS (SELECT doc_id, {_TOKENS.format('text')} AS ts FROM documents),
lens AS (SELECT doc_id, len(ts) AS dl FROM toks),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM lens),
post AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS token FROM toks) GROUP BY 1, 2),
dfs AS (SELECT token, count(*) AS df FROM post GROUP BY 1),
q AS (SELECT doc_id AS qid, route AS q_route, unnest({_TOKENS.format('title')}) AS token FROM documents WHERE doc_id % 100 = 0),
scored AS (
  SELECT qid, post.doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / greatest(tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1)), 1e-9)), 6) AS score
  FROM q JOIN post USING (token) JOIN dfs USING (token) JOIN lens ON lens.doc_id = post.doc_id, st GROUP BY 1, 2),
bm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 30)
"""
_KNN = r"""
knn0 AS (
  SELECT q.vec_id AS qid, v.vec_id AS doc_id, round(greatest(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), 0), 6) AS distance
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
knn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, doc_id) AS rank, round(1 / (1 + distance), 6) AS similarity FROM knn0 QUALIFY rank <= 30)
"""
_FUSED = _BM25.rstrip() + "," + _KNN + r""",
fr AS (SELECT qid, doc_id, 'bm25' AS method, rank, score FROM bm UNION ALL SELECT qid, doc_id, 'semantic', rank, similarity FROM knn)
"""


def _bm25_of(questions: str) -> str:
    """The same for any questions, a query with qid and token."""
    head, tail = _BM25.split("q AS (")[0], _BM25.split("scored AS (")[1]
    return head + f"q AS ({questions}),\nscored AS (" + tail


_SEARCHES = f"""SELECT qid * 4 + hop AS qid, unnest({_TOKENS.format('question')}) AS token FROM (SELECT qid, unnest(qs) AS question, generate_subscripts(qs, 1) - 1 AS hop FROM (
  SELECT doc_id AS qid, list_filter(qs, lambda x, i: list_position(qs, x) = i) AS qs FROM (SELECT doc_id, list_filter([title, act_name, CASE WHEN coalesce(section_number, '') <> '' THEN concat_ws(' ', 'section', section_number, act_name) END], lambda x: coalesce(x, '') <> '') AS qs FROM documents WHERE doc_id % 100 = 0)))"""
_HOPS = _bm25_of(_SEARCHES).rstrip() + ",\nhops AS (SELECT qid // 4 AS qid, qid % 4 AS hop, doc_id, rank FROM bm)"
_VERIFIED = _BM25.rstrip() + f""",
vf AS (SELECT bm.qid, bm.doc_id, rank, coalesce(title, '') AS title, coalesce(section_number, '') AS section, d.act_name, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM bm JOIN documents d ON d.doc_id = bm.doc_id
  QUALIFY row_number() OVER (PARTITION BY bm.qid, coalesce(title, ''), coalesce(section_number, '') ORDER BY rank) = 1),
v8 AS (SELECT * FROM vf QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) <= {SOURCES}),
vs AS (SELECT qid, doc_id, rank, title, section, section <> '' OR title <> '' OR length(t) > 40 AS is_verified, substr(t, 1, {EXCERPT}) || CASE WHEN length(t) > {EXCERPT} THEN '...' ELSE '' END AS excerpt,
  CASE WHEN act_name IN (SELECT act_name FROM acts) THEN {CATALOGUED} ELSE {OTHER} END::DOUBLE AS authority_score FROM v8)
"""


def _more_sql(hybrid: str) -> dict[str, str]:
    sums = "list_filter(list_distinct(list_transform(list_concat(" + ", ".join(f"regexp_extract_all(coalesce(text, ''), '{p}', 0)" for p in facts.AMOUNTS) + "), lambda x: lower(regexp_replace(x, '[^0-9A-Za-z_]', '', 'g')))), lambda x: x <> '')"
    days = f"list_distinct(regexp_extract_all(coalesce(text, ''), '{facts.FACTS['notice_deadline'][0]}', 0))"
    place = "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY authority_score DESC, rank) AS place FROM vs"
    return {
        "multi_query_union": _HOPS + f""" SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY hop, rank) AS place FROM (SELECT hops.*, substr(coalesce(text, ''), 1, {PREFIX}) AS head FROM hops JOIN documents USING (doc_id)
  QUALIFY row_number() OVER (PARTITION BY qid, head ORDER BY hop, rank, doc_id) = 1)""",
        "multi_hop_fusion": _HOPS + f""", f AS (SELECT qid, doc_id, round(sum(CASE WHEN hop = 0 THEN {FIRST_WEIGHT}::DOUBLE ELSE 1.0 END / (60 + rank)), 8) AS rrf FROM hops GROUP BY 1, 2),
b AS (SELECT qid, f.doc_id, rrf FROM f JOIN documents d ON d.doc_id = f.doc_id QUALIFY row_number() OVER (PARTITION BY qid, coalesce(title, ''), coalesce(section_number, '') ORDER BY rrf DESC, f.doc_id) = 1)
SELECT qid, doc_id, round(rrf, 4) AS score, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, doc_id) AS rank FROM b QUALIFY rank <= 10""",
        "section_dedup": _BM25 + f"""SELECT qid, bm.doc_id, rank FROM bm JOIN documents d ON d.doc_id = bm.doc_id QUALIFY row_number() OVER (PARTITION BY qid, coalesce(title, act_name, ''), coalesce(source, ''),
  CASE WHEN coalesce(section_number, '') <> '' THEN section_number ELSE chr(1) || substr(coalesce(text, ''), 1, {PREFIX}) END ORDER BY rank) = 1""",
        "section_accessor": r"SELECT doc_id, coalesce(nullif(trim(section_number, ' '), ''), regexp_extract(coalesce(title, ''), '^(?:Section\s*)?([0-9]+[A-Za-z]?)\b', 1)) AS section FROM documents",
        "rerank_threshold": _FUSED + """, x AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS rrf, max(CASE WHEN method = 'semantic' THEN score END) AS s FROM fr GROUP BY 1, 2),
y AS (SELECT *, rrf > 0.05 OR coalesce(s, 0) > 0.4 AS good, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, doc_id) AS place FROM x),
z AS (SELECT *, bool_or(good) OVER (PARTITION BY qid) AS hit FROM y) SELECT qid, doc_id FROM z WHERE good OR (NOT hit AND place <= 3)""",
        "source_cards": f"""WITH h AS ({hybrid}) SELECT qid, rank, coalesce(act_name, title, 'Statutory Act') AS act_name, coalesce(nullif(section_number, ''), 'General') AS section, coalesce(authority, 'Government of India') AS authority, act_year AS year, source,
  CASE WHEN score > 0.3 THEN 'high' ELSE 'verified' END AS confidence, coalesce(nullif(route, ''), 'general') AS route FROM h JOIN documents d ON d.doc_id = h.doc_id WHERE rank <= {CARDS}""",
        "source_list": _BM25 + """SELECT qid, source, section, row_number() OVER (PARTITION BY qid ORDER BY first) AS place FROM (SELECT qid, coalesce(source, '') AS source, coalesce(section_number, '') AS section, min(rank) AS first FROM bm JOIN documents d ON d.doc_id = bm.doc_id GROUP BY 1, 2, 3) QUALIFY place <= 5""",
        "verified_sources": _VERIFIED + f"SELECT * EXCLUDE (rank) FROM ({place})",
        "source_authority": _VERIFIED + "SELECT qid, count(*) AS n_sources, round(avg(authority_score), 6) AS avg_authority FROM vs GROUP BY 1",
        "evidence_graph": _VERIFIED.rstrip() + f""",
n AS (SELECT doc_id AS qid, least(len({sums}), 2) AS a, least(len({days}), 2) AS b FROM documents WHERE doc_id % 100 = 0),
c AS (SELECT qid, 'node_claim_amt_' || unnest(range(a)) AS id, 'references_claim' AS how FROM n UNION ALL SELECT qid, 'node_claim_dl_' || unnest(range(b)), 'stipulates_timeline' FROM n UNION ALL SELECT qid, 'node_fact_inquiry', 'formulates_inquiry' FROM n WHERE a + b = 0),
p AS (SELECT qid, (place - 1)::VARCHAR AS i FROM ({place}) WHERE place <= 4)
SELECT qid, 'node_question' AS source_id, id AS target_id, how AS relationship FROM c UNION ALL SELECT qid, id, 'node_legal_issue', 'raises_issue' FROM c
UNION ALL SELECT qid, 'node_legal_issue', 'node_prov_' || i, 'governed_by' FROM p UNION ALL SELECT qid, 'node_prov_' || i, 'node_src_' || i, 'codified_in' FROM p""",
        "kb_filtered": "SELECT doc_id, route, act_name, section_number FROM documents WHERE (contains(lower(coalesce(route, '')), 'tenancy') OR contains(lower(coalesce(act_name, '')), 'tenancy')) AND contains(lower(coalesce(section_number, '')), '1')",
        "label_accuracy": r"""SELECT lang, count(*) AS n, round(avg(CASE WHEN found = lang THEN 1 ELSE 0 END) * 100, 4) AS accuracy FROM (SELECT lang, CASE WHEN kn > hi AND kn > 0 THEN 'kn' WHEN hi > 0 THEN 'hi' ELSE 'en' END AS found FROM
  (SELECT lang, length(regexp_replace(coalesce(text, ''), '[^\x{0900}-\x{097F}]', '', 'g')) AS hi, length(regexp_replace(coalesce(text, ''), '[^\x{0C80}-\x{0CFF}]', '', 'g')) AS kn FROM documents WHERE coalesce(lang, '') <> '')) GROUP BY 1""",
    }


def oracle_sql() -> dict[str, str]:
    own = {
        "token_df_top": f"SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents) GROUP BY 1 ORDER BY df DESC, token LIMIT 100",
        "doc_length_stats": f"SELECT source, count(*) AS n_docs, sum(len({_TOKENS.format('text')}))::BIGINT AS n_tokens, max(len({_TOKENS.format('text')})) AS longest, round(avg(len({_TOKENS.format('text')})), 6) AS avgdl FROM documents GROUP BY 1",
        "bm25_topk": _BM25 + "SELECT qid, doc_id, score, rank FROM bm",
        "knn_l2_topk": "WITH" + _KNN + "SELECT qid, doc_id, distance, similarity, rank FROM knn",
        "rrf_fusion": _FUSED + "SELECT qid, doc_id, round(sum(1.0 / (60 + rank)), 8) AS rrf, string_agg(DISTINCT method, '+' ORDER BY method) AS methods FROM fr GROUP BY 1, 2",
        "minmax_hybrid": _FUSED + r""",
f AS (SELECT qid, doc_id, sum(1.0 / (60 + rank)) AS rrf, max(CASE WHEN method = 'bm25' THEN score END) AS b, max(CASE WHEN method = 'semantic' THEN score END) AS s FROM fr GROUP BY 1, 2),
j AS (SELECT f.*, dq.route AS q_route, dd.route, dd.title FROM f JOIN documents dq ON dq.doc_id = f.qid JOIN documents dd ON dd.doc_id = f.doc_id),
n AS (SELECT *,
  coalesce(CASE WHEN max(b) OVER w > min(b) OVER w THEN (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) END, 0) AS bn,
  coalesce(CASE WHEN max(s) OVER w > min(s) OVER w THEN (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END, 0) AS sn FROM j WINDOW w AS (PARTITION BY qid)),
sc AS (SELECT qid, doc_id, route, q_route, round(rrf + 0.25 * bn + 0.35 * sn + CASE WHEN route = q_route THEN 3 WHEN coalesce(route, '') <> '' THEN -6 ELSE 0 END
  - CASE WHEN regexp_matches(lower(title), 'subs\. by|ins\. by|omitted by|w\.e\.f\.') THEN 25 ELSE 0 END, 6) AS score FROM n)
SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc
WHERE coalesce(route, '') = '' OR coalesce(q_route, '') = '' OR route = q_route QUALIFY rank <= 8""",
        "token_overlap": f"SELECT doc_id, round(coalesce(len(list_intersect(list_distinct(a), b)) / nullif(len(list_distinct(a)), 0), 0), 6) AS overlap FROM (SELECT doc_id, {_TOKENS.format('title')} AS a, {_TOKENS.format('text')} AS b FROM documents)",
        "section_expansion": _BM25 + """, h0 AS (SELECT qid, d.section_number, d.route, min(rank) AS first FROM bm JOIN documents d USING (doc_id) WHERE coalesce(d.section_number, '') <> '' GROUP BY 1, 2, 3),
h AS (SELECT * FROM h0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY first) <= 3)
SELECT qid, d.doc_id, d.section_number, 0.15::DOUBLE AS score FROM h JOIN documents d ON d.section_number = h.section_number AND d.route = h.route""",
        "kb_search": r"""WITH x AS (
  SELECT act_id, lower(a.act_name) AS q, dataset_id, lower(coalesce(d.act_name, '')) AS an, lower(coalesce(section_title, '')) AS st, lower(concat_ws(' ', d.act_name, section_title, text)) AS body,
    regexp_replace(trim(lower(coalesce(text, ''))), '\s+', ' ', 'g') AS flat FROM datasets d, acts a
  WHERE contains(lower(coalesce(text, '')), lower(a.act_name)) OR contains(lower(coalesce(d.act_name, '')), lower(a.act_name))),
s AS (SELECT act_id, dataset_id, round(least(CASE WHEN contains(an, q) THEN 30.0 ELSE 0 END + CASE WHEN contains(st, q) THEN 25.0 ELSE 0 END + len(list_filter(string_split(q, ' '), lambda w: contains(body, w))) / len(string_split(q, ' ')) * 20, 100), 1) AS relevance,
  CASE WHEN length(flat) > 280 THEN rtrim(substr(flat, 1, 280)) || '...' ELSE flat END AS snippet FROM x)
SELECT *, row_number() OVER (PARTITION BY act_id ORDER BY relevance DESC, dataset_id) AS place FROM s QUALIFY place <= 5""",
        "kb_stats": "SELECT facet, value, count(*) AS n_docs, count(DISTINCT act_name) AS n_acts FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS facet, coalesce(nullif({c}, ''), 'general') AS value, act_name FROM documents" for c in ("route", "document_type", "authority")) + ") GROUP BY 1, 2",
        "kb_acts_catalog": "SELECT a.act_name, a.act_year, a.route, count(d.doc_id) AS n_docs, arg_min_null(d.authority, d.doc_id) AS authority, min(d.doc_id) AS first_doc FROM acts a LEFT JOIN documents d USING (act_name) GROUP BY 1, 2, 3",
        "statute_resolve": r"SELECT request_id, min(act_id) AS act_id, count(*) AS n_acts FROM analyze_text_requests, acts WHERE contains(regexp_replace(trim(lower(coalesce(text, ''))), '\s+', ' ', 'g'), lower(act_name)) GROUP BY 1",
    }
    return own | _more_sql(own["minmax_hybrid"])
