"""Documents: cleaning, sections and chunks, keeping the store, facts, timelines, conflicts, quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granthika.functions import text as T
from granthika.operators import chunks, facts, store
from granthika.sources import files
from granthika.sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def script_language(spark: SparkSession, d: str) -> DataFrame:
    """PLN-01, DOC-20: languages by script, in the three ways of counting."""
    modes = [T.script_language(F.col("text"), m).alias(m) for m in ("compare", "hindi_first", "least")]
    return _docs(spark, d).select("doc_id", *modes)


def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    """ING-02: spacing rules, as length and hash of the cleaned text."""
    x = _docs(spark, d).select("doc_id", T.clean(F.col("text"), scanned=False).alias("t"))
    return x.select("doc_id", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("h"))


def scanned_numbers(spark: SparkSession, d: str) -> DataFrame:
    """ING-01: all the number rules, over the requests."""
    x = table(spark, d, "analyze_text_requests").select("request_id", T.fix_scanned_numbers(F.coalesce("text", F.lit(""))).alias("t"))
    return x.select("request_id", F.sha2("t", 256).alias("h"))


def cleaned_requests(spark: SparkSession, d: str) -> DataFrame:
    """ING-01..03: raw and cleaned text of the requests, with every rule."""
    return table(spark, d, "analyze_text_requests").select("request_id", F.col("text").alias("raw"), T.clean(F.col("text")).alias("cleaned"))


def line_section_runs(spark: SparkSession, d: str) -> DataFrame:
    """ING-05, WIN-04."""
    return chunks.section_runs(_docs(spark, d), "doc_id", "text")


def section_ffill(spark: SparkSession, d: str) -> DataFrame:
    """ING-11, WIN-03."""
    return chunks.filled_sections(_docs(spark, d), "doc_id", "text")


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """ING-06..09: chunks with their ids (SNK-01)."""
    rows = chunks.chunk_rows(_docs(spark, d), "doc_id", "text")
    return rows.withColumn("chunk_id", store.chunk_id(F.col("doc_id"), F.col("chunk_index")))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """SNK-01: the id of each document as its first chunk."""
    return _docs(spark, d).select("doc_id", store.chunk_id(F.col("doc_id"), F.lit(0)).alias("chunk_id"))


def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    """ING-16, WIN-05: the first of documents with equal act, year, section and text."""
    docs = _docs(spark, d).select("doc_id", "act_name", "act_year", "section_number", "text")
    keys = [F.coalesce("act_name", F.lit("")), F.coalesce(F.col("act_year").cast("string"), F.lit("")), F.coalesce("section_number", F.lit("")), store.text_key(F.col("text"))]
    kept = docs.select("doc_id", *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    return kept.groupBy("k0", "k1", "k2", "k3").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


def newest_copies(spark: SparkSession, d: str) -> DataFrame:
    """SNK-01, upsert: documents as two deliveries by month; of each text the newest fetch is kept."""
    x = _docs(spark, d).select(store.text_key(F.col("text")).alias("key"), "doc_id", "fetched_at", "source")
    late = F.month("fetched_at") > 6
    return store.upsert(x.where(~F.coalesce(late, F.lit(False))), x.where(late), "key", "fetched_at").select("key", F.unix_micros("fetched_at").alias("fetched_us"))


def incremental_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-06, ING-19: documents whose text the dataset sections don't hold yet; every row of both tables is compared."""
    stored = table(spark, d, "datasets").select("text")
    return store.only_new(_docs(spark, d).select("doc_id", "act_name", "text"), stored, store.text_key(F.col("text"))).select("doc_id", "act_name")


def new_sections(spark: SparkSession, d: str) -> DataFrame:
    """ING-19, JOIN-06: dataset sections whose text isn't among those of earlier sections (smaller ids) of the same act."""
    x = table(spark, d, "datasets").select("dataset_id", "act_name", store.text_key(F.col("text")).alias("key"))
    return x.groupBy("act_name", "key").agg(F.min("dataset_id").alias("dataset_id")).select("dataset_id", "act_name")


def extracted_facts(spark: SparkSession, d: str) -> DataFrame:
    """DOC-01..03, PLN-02: sums, dates, rates and sections of each text in long form, in the order of their place."""
    kinds = {"amount": T.found_all(F.col("text"), T.SUM), "date": T.found_all(F.col("text"), T.DATE), "rate": T.found_all(F.col("text"), T.RATE), "section": T.section_numbers(F.col("text"))}
    named = lambda k: lambda x, i: F.struct(F.lit(k).alias("kind"), (i + 1).alias("place"), x.alias("value"))
    each = F.flatten(F.array(*[F.transform(v, named(k)) for k, v in kinds.items()]))
    return _docs(spark, d).select("doc_id", F.explode(each).alias("f")).select("doc_id", "f.kind", "f.place", "f.value")


def timeline(spark: SparkSession, d: str) -> DataFrame:
    """DOC-16: (date, event) of each sentence with a date, in the order of the document, the first of equals."""
    parts = F.split(F.coalesce("text", F.lit("")), r"[\r\n।]+|\.(?=\s|$)")
    x = _docs(spark, d).select("doc_id", F.posexplode(parts).alias("pos", "part")).select("doc_id", "pos", F.trim("part").alias("event"), F.regexp_extract("part", T.DATE, 1).alias("date"))
    x = x.where((F.col("date") != "") & (F.length("event") > 15)).withColumn("head", F.substring("event", 1, 50))
    return x.groupBy("doc_id", "date", "head").agg(F.min(F.struct("pos", "event")).alias("m")).select("doc_id", "date", "m.pos", "m.event")


def document_amounts(spark: SparkSession, d: str) -> DataFrame:
    """DOC-01: sums with place, kind by what stands near them, and confidence."""
    return facts.amounts(_docs(spark, d), "doc_id", "text")


def document_dates(spark: SparkSession, d: str) -> DataFrame:
    """DOC-02: dates with place and kind."""
    return facts.dates(_docs(spark, d), "doc_id", "text")


def document_facts(spark: SparkSession, d: str) -> DataFrame:
    """DOC-03: rates, instalments, deadlines, references to acts, case numbers."""
    return facts.facts(_docs(spark, d), "doc_id", "text")


def evidence_lines(spark: SparkSession, d: str) -> DataFrame:
    """DOC-04: lines that give evidence, at most fifteen of a document."""
    return facts.evidence_lines(_docs(spark, d), "doc_id", "text")


def document_sentences(spark: SparkSession, d: str) -> DataFrame:
    """DOC-07: sentences of at least twenty characters by document: how many, and the hash of all of them."""
    ends = F.regexp_replace(F.coalesce("text", F.lit("")), r"([.!?])\s+", "$1\n")
    parts = F.filter(F.transform(F.split(ends, r"\n+", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) >= 20)
    return _docs(spark, d).select("doc_id", F.size(parts).alias("n_sentences"), F.sha2(F.array_join(parts, "\n"), 256).alias("h"))


def document_timeline(spark: SparkSession, d: str) -> DataFrame:
    """DOC-16: every date of every sentence with its event, in the order of the document."""
    return facts.timeline(_docs(spark, d), "doc_id", "text")


CASE = ["act_name", "section_number"]


def document_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """DOC-14: documents of an act and section whose sums, dates, deadline or rates differ from the first one's."""
    return facts.conflicts(_docs(spark, d), "doc_id", "text", CASE)


def document_contradictions(spark: SparkSession, d: str) -> DataFrame:
    """DOC-15: acts and sections whose first two documents claim different sums, or that name two forums."""
    return facts.contradictions(_docs(spark, d), "doc_id", "text", CASE)


def section_metadata(spark: SparkSession, d: str) -> DataFrame:
    """ING-10: number and title of the first section heading of each text; empty where there is none."""
    return _docs(spark, d).select("doc_id", *chunks.heading(F.col("text")))


def document_ids(spark: SparkSession, d: str) -> DataFrame:
    """ING-13: the id of each act, made of the letters and digits of its name and its year."""
    return table(spark, d, "acts").select("act_id", store.document_id(F.col("act_name"), F.col("act_year")).alias("document_id"))


def dataset_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-02, SNK-06: what the path of each dataset's file tells, and the file's name made safe."""
    path = F.concat_ws("/", "category", "folder", "filename")
    return table(spark, d, "datasets").select("dataset_id", *files.path_facts(path), files.sanitised_name(path).alias("safe_name"))


def discovered_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-01: the files of the data folder with their sizes; contents aren't read."""
    return files.discover(spark, d, "*.parquet").select("name", "length")


def kept_documents(spark: SparkSession, d: str) -> DataFrame:
    """SNK-02, SQL-08: the documents that stay when those that the ingest refuses are deleted by their ids."""
    return store.delete(_docs(spark, d).select("doc_id", "source"), store.refused(_docs(spark, d)), "doc_id")


def ingest_records(spark: SparkSession, d: str) -> DataFrame:
    """ING-15, ING-17, ING-20: chunks of the cleaned texts with ids, section and text key, the first of equal ones."""
    return store.records(_docs(spark, d))


def ingest_errors(spark: SparkSession, d: str) -> DataFrame:
    """ING-17, ING-18: documents that an ingest refuses, with the first reason."""
    return store.refused(_docs(spark, d))


# Weights of readable words and of ordinary characters, the tiers of the score, the least characters of a
# text that is scored, the characters of readable words, and those that scans leave behind.
READABLE, ORDINARY, TIERS, LEAST_CHARS = 85.0, 15.0, ((90, "high"), (75, "good"), (50, "moderate")), 10
READABLE_WORD, SCAN_TRACES = r"^[A-Za-z0-9ऀ-ॿಀ-೿,.'\"₹()-]+$", "�§¤¥¦©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾¿"


def ocr_quality(spark: SparkSession, d: str) -> DataFrame:
    """DOC-17: a score of 0 to 100 from the share of readable words and of ordinary characters, and its tier."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    x = table(spark, d, "analyze_text_requests").select("request_id", text.alias("text"), words.alias("words"))
    share = lambda part, whole: part / F.greatest(whole, F.lit(1))
    readable = share(F.size(F.filter("words", lambda w: w.rlike(READABLE_WORD))), F.size("words"))
    odd = share(F.length("text") - F.length(F.translate("text", SCAN_TRACES, "")), F.length("text"))
    score = F.least(F.greatest(F.floor(READABLE * readable + ORDINARY * (1 - odd)), F.lit(0)), F.lit(100))
    x = x.select("request_id", F.size("words").alias("n_words"), F.when(F.length(F.trim("text")) < LEAST_CHARS, 0).otherwise(score).cast("int").alias("quality"))
    tier = F.when(F.lit(False), "")
    for least, name in TIERS:
        tier = tier.when(F.col("quality") >= least, name)
    return x.withColumn("tier", tier.otherwise("degraded"))


def conflict_sets(spark: SparkSession, d: str) -> DataFrame:
    """DOC-14, SET-03, JOIN-09: documents of an act and section whose sums differ from those of its first document."""
    x = _docs(spark, d).where(F.coalesce("act_name", F.lit("")) != "").select("doc_id", "act_name", F.coalesce("section_number", F.lit("")).alias("section_number"), F.array_sort(T.found_all(F.col("text"), T.SUM)).alias("sums"))
    x = x.where(F.size("sums") > 0)
    first = x.groupBy("act_name", "section_number").agg(F.min(F.struct("doc_id", "sums")).alias("f"), F.count("*").alias("n")).where("n > 1")
    both = x.join(first.select("act_name", "section_number", F.col("f.doc_id").alias("first_doc"), F.col("f.sums").alias("first_sums")), ["act_name", "section_number"])
    return both.where((F.col("doc_id") != F.col("first_doc")) & (F.col("sums") != F.col("first_sums"))).select("act_name", "section_number", "first_doc", "doc_id", F.size(F.array_except("sums", "first_sums")).alias("n_new"))


def route_vote(spark: SparkSession, d: str) -> DataFrame:
    """AGG-07: the route most documents of a source have, other than the empty one; the one seen first wins ties."""
    x = _docs(spark, d).where(F.coalesce("route", F.lit("")) != "").groupBy("source", "route").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    best = x.groupBy("source").agg(F.max_by(F.struct("route", "n"), F.struct(F.col("n"), -F.col("first_doc"))).alias("b"))
    return best.select("source", "b.route", "b.n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (script_language, clean_texts, scanned_numbers, cleaned_requests, line_section_runs, section_ffill, chunk_documents, chunk_ids, exact_dedup, newest_copies, incremental_antijoin, new_sections, extracted_facts, timeline, document_amounts, document_dates, document_facts, evidence_lines, document_sentences, document_timeline, document_conflicts, document_contradictions, section_metadata, document_ids, dataset_files, discovered_files, kept_documents, ingest_records, ingest_errors, ocr_quality, conflict_sets, route_vote)}


def _chain(col: str, rules: tuple[tuple[str, str], ...]) -> str:
    for pattern, to in rules:
        to = to.replace("$", "\\").replace("\n", "' || chr(10) || '")
        p = pattern.replace("'", "''")
        col = f"regexp_replace({col}, '{p}', '{to}', 'g')"
    return col


_NORM = r"regexp_replace(trim(lower(coalesce({0}, ''))), '\s+', ' ', 'g')"
_LINES = r"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)), 1) - 1 AS pos FROM documents),
h AS (SELECT doc_id, pos, trim(line) AS line, regexp_extract(line, '^\s*(\d{1,4}[A-Z]?)\.\s+(.+?)\s*$', 1) AS number, regexp_extract(line, '^\s*(\d{1,4}[A-Z]?)\.\s+(.+?)\s*$', 2) AS title FROM l)
"""
_HI, _KN = "length(regexp_replace(coalesce(text, ''), '[^\\x{0900}-\\x{097F}]', '', 'g'))", "length(regexp_replace(coalesce(text, ''), '[^\\x{0C80}-\\x{0CFF}]', '', 'g'))"


def _places_sql(patterns: tuple[str, ...]) -> str:
    """CTEs that end in f: doc_id, t, pat, raw, start of every match."""
    each = " UNION ALL ".join(f"SELECT doc_id, t, {k} AS pat, regexp_extract_all(t, '{p}', 0) AS m, string_split_regex(t, '{p}') AS p FROM s" for k, p in enumerate(patterns))
    return f"""WITH s AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a AS ({each}),
e AS (SELECT doc_id, t, pat, m, p, unnest(range(1, len(m) + 1)) AS i FROM a),
f AS (SELECT doc_id, t, pat, m[i] AS raw, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM e)"""


def _any_sql(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _type_sql(types: tuple, other: str) -> str:
    near = f"substr(lower(t), (greatest(start - {facts.CONTEXT}, 0) + 1)::BIGINT, (start + length(raw) + {facts.CONTEXT} - greatest(start - {facts.CONTEXT}, 0))::BIGINT)"
    return "CASE " + " ".join(f"WHEN {_any_sql(near, w)} THEN '{k}'" for k, w in types) + f" ELSE '{other}' END AS type"


_PLAIN = r"trim(regexp_replace({0}, '\s+', ' ', 'g'), ' ')"


def _all_sql(patterns: tuple[str, ...], text: str = "coalesce(text, '')") -> str:
    return "list_concat(" + ", ".join(f"regexp_extract_all({text}, '{p}', 0)" for p in patterns) + ")" if len(patterns) > 1 else f"regexp_extract_all({text}, '{patterns[0]}', 0)"


def _rates_sql(text: str = "coalesce(text, '')") -> str:
    """Rates end at the edge of a word of any script; RE2 knows ASCII words only, so a letter beyond is read and cut off again."""
    pattern = facts.FACTS["interest_rate"][0].removesuffix(r"\b") + r"(?:\b|\p{L})"
    return f"list_transform(regexp_extract_all({text}, '{pattern}', 0), lambda x: regexp_replace(regexp_replace(x, '[^\\x00-\\x7f]$', ''), '^\\s+|\\s+$', '', 'g'))"


def _facts_sql() -> dict[str, str]:
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS kind, v FROM (SELECT doc_id, {_rates_sql() if k == 'interest_rate' else f"list_transform({_all_sql(p)}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))"} AS v FROM documents)" for k, p in facts.FACTS.items()
    )
    found = f"SELECT doc_id, kind, unnest(v) AS value, generate_subscripts(v, 1) AS i FROM ({kinds})"
    lines = "regexp_split_to_array(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10))"
    days = "CASE " + " ".join(f"WHEN {_any_sql('lower(t)', w)} THEN '{k}'" for k, w in facts.DEADLINES) + " END"
    held = {
        "amount_conflict": f"list_transform({_all_sql(facts.AMOUNTS, 't')}, lambda x: {_PLAIN.format('x')})", "date_conflict": _all_sql(facts.DATES, "t"), "deadline_conflict": f"list_filter([{days}], lambda x: x IS NOT NULL)",
        "interest_rate_conflict": _rates_sql("t"),
    }
    docs = "WITH s AS (SELECT doc_id, act_name, section_number, coalesce(text, '') AS t FROM documents WHERE act_name IS NOT NULL AND section_number IS NOT NULL)"
    number = r"try_cast(replace(regexp_extract(replace({0}, ' ', ''), '([0-9,]+(?:\.[0-9]{{2}})?)', 1), ',', '') AS DOUBLE)"
    parts = "list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[\\r\\n.]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 15)"
    each = " UNION ALL ".join(f"SELECT doc_id, n, {k} AS pat, part, unnest(m) AS date, generate_subscripts(m, 1) AS i FROM (SELECT *, regexp_extract_all(part, '{p}', 0) AS m FROM parts)" for k, p in enumerate(facts.TIMELINE_DATES))
    rest = f"trim(substr(part, length(date) + 1), '{facts.EVENT_EDGE}')"
    return {
        "document_amounts": _places_sql(facts.AMOUNTS) + f""", g AS (SELECT *, {_PLAIN.format('raw')} AS value FROM f WHERE length({_PLAIN.format('raw')}) >= 3
  QUALIFY row_number() OVER (PARTITION BY doc_id, lower(regexp_replace(raw, '[^0-9A-Za-z_]', '', 'g')) ORDER BY pat, start) = 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pat, start) AS place, value, start, {_type_sql(facts.AMOUNT_TYPES, 'monetary_amount')}, CASE WHEN contains(raw, '₹') OR contains(lower(raw), 'rs.') THEN 'high' ELSE 'medium' END AS confidence FROM g""",
        "document_dates": _places_sql(facts.DATES) + f""", g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, lower(raw) ORDER BY pat, start) = 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pat, start) AS place, raw AS value, start, {_type_sql(facts.DATE_TYPES, 'general_date')} FROM g""",
        "document_facts": f"WITH f AS ({found}), g AS (SELECT doc_id, kind, value, min(i) AS i FROM f GROUP BY 1, 2, 3) SELECT doc_id, kind, row_number() OVER (PARTITION BY doc_id, kind ORDER BY i) AS place, value FROM g",
        "evidence_lines": f"""WITH l AS (SELECT doc_id, regexp_replace(unnest({lines}), '^\\s+|\\s+$', '', 'g') AS line, generate_subscripts({lines}, 1) AS i FROM documents)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place, line FROM l WHERE length(line) BETWEEN {facts.EVIDENCE_CHARS[0]} AND {facts.EVIDENCE_CHARS[1]} AND {_any_sql('lower(line)', facts.EVIDENCE)} QUALIFY place <= {facts.EVIDENCE_LINES}""",
        "document_sentences": r"SELECT doc_id, len(v)::INT AS n_sentences, sha256(coalesce(array_to_string(v, chr(10)), '')) AS h FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 20) AS v FROM documents)",
        "document_timeline": f"""WITH parts AS (SELECT doc_id, unnest(v) AS part, generate_subscripts(v, 1) AS n FROM (SELECT doc_id, {parts} AS v FROM documents)), e AS ({each}),
g AS (SELECT doc_id, n, pat, i, date, CASE WHEN starts_with(part, date) AND {rest} <> '' THEN {rest} ELSE part END AS event FROM e),
h AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, lower(date), lower(substr(event, 1, 50)) ORDER BY n, pat, i) = 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, pat, i) AS place, date, event FROM h""",
        "document_conflicts": docs + ", k AS (" + " UNION ALL ".join(f"SELECT act_name, section_number, doc_id, '{k}' AS kind, list_sort(list_distinct({v})) AS held FROM s" for k, v in held.items()) + """),
y AS (SELECT *, first_value(doc_id) OVER w AS first_doc, first_value(held) OVER w AS first_held FROM k WHERE len(held) > 0 WINDOW w AS (PARTITION BY act_name, section_number, kind ORDER BY doc_id))
SELECT act_name, section_number, kind, first_doc, doc_id, len(list_filter(held, lambda x: NOT list_contains(first_held, x)))::INT AS n_new FROM y WHERE doc_id <> first_doc AND held <> first_held""",
        "document_contradictions": docs + f""", m AS (SELECT *, list_max(list_filter(list_transform({_all_sql(facts.AMOUNTS, 't')}, lambda x: {number.format('x')}), lambda v: v > {facts.LEAST_SUM})) AS largest FROM s),
two AS (SELECT act_name, section_number, largest, row_number() OVER (PARTITION BY act_name, section_number ORDER BY doc_id) AS n FROM m WHERE largest IS NOT NULL QUALIFY n <= 2)
SELECT a.act_name, a.section_number, 'amount_conflict' AS kind, a.largest AS first_sum, b.largest AS second_sum FROM two a JOIN two b USING (act_name, section_number) WHERE a.n = 1 AND b.n = 2 AND abs(a.largest - b.largest) > 1
UNION ALL SELECT act_name, section_number, 'forum_conflict', NULL, NULL FROM m GROUP BY 1, 2 HAVING count(*) > 1 AND bool_or({_any_sql('lower(t)', facts.ARBITRATION)}) AND bool_or({_any_sql('lower(t)', facts.COURT)})""",
        "document_ids": "SELECT act_id, trim(regexp_replace(act_name, '[^A-Za-z0-9]+', '_', 'g'), '_') || CASE WHEN act_year IS NOT NULL THEN '_' || act_year ELSE '' END AS document_id FROM acts",
        "dataset_files": r"""WITH x AS (SELECT dataset_id, string_split(concat_ws('/', category, folder, filename), '/') AS p FROM datasets)
SELECT dataset_id, CASE WHEN len(p) > 1 THEN lower(p[1]) ELSE 'general' END AS route, CASE WHEN len(p) > 2 THEN replace(p[2], '_', ' ') ELSE '' END AS folder,
  try_cast(regexp_extract(replace(p[len(p)], '_', ' '), '\b((?:18|19|20)\d{2})\b', 1) AS INT) AS year, coalesce(nullif(regexp_replace(p[len(p)], '[^\p{L}\p{M}\p{N}_.\-]', '_', 'g'), ''), 'uploaded_document') AS safe_name FROM x""",
        "kept_documents": r"SELECT doc_id, source FROM documents WHERE length(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) > 0 AND coalesce(act_name, '') <> '' AND coalesce(source, '') <> ''",
        "ingest_errors": r"SELECT doc_id, CASE WHEN text IS NULL THEN 'no text' WHEN length(regexp_replace(text, '\s+', '', 'g')) = 0 THEN 'blank text' WHEN coalesce(act_name, '') = '' THEN 'no act' WHEN coalesce(source, '') = '' THEN 'no source' END AS reason FROM documents WHERE reason IS NOT NULL",
    }


def oracle_sql() -> dict[str, str]:
    distinct = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
    kinds = {
        "amount": f"regexp_extract_all(coalesce(text, ''), '{T.SUM}', 1)", "date": f"regexp_extract_all(coalesce(text, ''), '{T.DATE}', 1)", "rate": f"regexp_extract_all(coalesce(text, ''), '{T.RATE}', 1)",
        "section": r"regexp_extract_all(coalesce(text, ''), '(?i)(?:section|sec|u/s|धारा|ಸೆಕ್ಷನ್)\s*([0-9]+[A-Za-z]*)', 1)",
    }
    facts = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(range(1, len(v) + 1)) AS place, unnest(v) AS value FROM (SELECT doc_id, {distinct.format('a')} AS v FROM (SELECT doc_id, {x} AS a FROM documents))" for k, x in kinds.items())
    one_end = r"replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(0), '')"
    clean = _chain(r"replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(0), '')", (*T.SPACING, (r"^\s+|\s+$", "")))
    return {
        "script_language": f"""SELECT doc_id, CASE WHEN kn > hi AND kn > 0 THEN 'kannada' WHEN hi > 0 THEN 'hindi' ELSE 'english' END AS "compare", CASE WHEN hi > 0 THEN 'hindi' WHEN kn > 0 THEN 'kannada' ELSE 'english' END AS hindi_first,
CASE WHEN kn > 15 OR kn > hi THEN 'kannada' WHEN hi > 15 THEN 'hindi' ELSE 'english' END AS "least" FROM (SELECT doc_id, {_HI} AS hi, {_KN} AS kn FROM documents)""",
        "cleaned_requests": f"SELECT request_id, text AS raw, {_chain(one_end, (*T.NUMBERS, *T.SPACING, (r'^\s+|\s+$', '')))} AS cleaned FROM analyze_text_requests",
        "clean_texts": f"SELECT doc_id, length(t) AS n_chars, sha256(t) AS h FROM (SELECT doc_id, {clean} AS t FROM documents)",
        "scanned_numbers": f"SELECT request_id, sha256({_chain("coalesce(text, '')", T.NUMBERS)}) AS h FROM analyze_text_requests",
        "line_section_runs": _LINES + "SELECT doc_id, section::BIGINT AS section, max(number) AS section_number, max(title) AS title, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM (SELECT *, sum(CASE WHEN number <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h) GROUP BY 1, 2",
        "section_ffill": _LINES + "SELECT doc_id, pos, coalesce(last_value(nullif(number, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), '') AS section_number FROM h",
        "chunk_ids": "SELECT doc_id, sha256(doc_id || '_0') AS chunk_id FROM documents",
        "exact_dedup": f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY coalesce(act_name, ''), coalesce(act_year::VARCHAR, ''), coalesce(section_number, ''), {_NORM.format('text')}",
        "newest_copies": f"SELECT sha1({_NORM.format('text')}) AS key, epoch_us(max(fetched_at)) AS fetched_us FROM documents GROUP BY 1",
        "incremental_antijoin": f"SELECT doc_id, act_name FROM documents WHERE {_NORM.format('text')} NOT IN (SELECT {_NORM.format('text')} FROM datasets)",
        "new_sections": f"SELECT dataset_id, act_name FROM datasets QUALIFY row_number() OVER (PARTITION BY act_name, {_NORM.format('text')} ORDER BY dataset_id) = 1",
        **_facts_sql(),
        "extracted_facts": facts,
        "timeline": rf"""WITH p AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(coalesce(text, ''), '\.(\s|$)', chr(1) || '\1', 'g'), '[\r\n।]+|\x01') AS parts FROM documents)),
e AS (SELECT doc_id, pos, trim(part) AS event, regexp_extract(part, '{T.DATE}', 1) AS date FROM p)
SELECT doc_id, date, min(pos) AS pos, arg_min(event, pos) AS event FROM e WHERE date <> '' AND length(event) > 15 GROUP BY doc_id, date, substr(event, 1, 50)""",
        "ocr_quality": r"""WITH x AS (SELECT request_id, length(trim(coalesce(text, ''), ' ')) AS n, length(coalesce(text, '')) AS total, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '') AS words,
  length(regexp_replace(coalesce(text, ''), '[^\x{fffd}§¤¥¦©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾¿]', '', 'g')) AS odd FROM analyze_text_requests),
q AS (SELECT request_id, len(words)::INT AS n_words, CASE WHEN n < 10 THEN 0 ELSE floor(greatest(0, least(100, 85.0::DOUBLE * len(list_filter(words, lambda w: regexp_matches(w, '^[A-Za-z0-9\x{0900}-\x{097F}\x{0C80}-\x{0CFF},.''"₹()-]+$'))) / greatest(len(words), 1) + 15.0::DOUBLE * (1 - odd / greatest(total, 1))))) END::INT AS quality FROM x)
SELECT *, CASE WHEN quality >= 90 THEN 'high' WHEN quality >= 75 THEN 'good' WHEN quality >= 50 THEN 'moderate' ELSE 'degraded' END AS tier FROM q""",
        "conflict_sets": f"""WITH x AS (SELECT doc_id, act_name, coalesce(section_number, '') AS section_number, list_sort(list_distinct({kinds['amount']})) AS sums FROM documents WHERE coalesce(act_name, '') <> ''),
y AS (SELECT *, first_value(doc_id) OVER w AS first_doc, first_value(sums) OVER w AS first_sums FROM x WHERE len(sums) > 0 WINDOW w AS (PARTITION BY act_name, section_number ORDER BY doc_id))
SELECT act_name, section_number, first_doc, doc_id, len(list_filter(sums, lambda s: NOT list_contains(first_sums, s)))::INT AS n_new FROM y WHERE doc_id <> first_doc AND sums <> first_sums""",
        "route_vote": "SELECT source, route, n FROM (SELECT source, route, count(*) AS n, min(doc_id) AS f FROM documents WHERE coalesce(route, '') <> '' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, f) = 1",
    }
