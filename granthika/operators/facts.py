"""Facts of documents with their places: sums, dates, rates, deadlines, references, and where documents disagree.

All of it is Column expressions over the text of one row, so nothing is shuffled until documents are compared.
Spark gives the matches of a pattern without their places; splitting the text at the same pattern gives what
lies between, and both together give the places.

Defined results: null and empty texts have no facts; a value found twice counts once, at its first place, where
the patterns of a kind come one after the other; places count characters from 0; `\\d` and word edges are those
of ASCII.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granthika.functions.text import one_line_end

# Patterns of sums, in the order in which they are tried.
AMOUNTS = (
    r"(?i)(?:₹|Rs\.?|INR)\s*[0-9]{1,3}(?:,[0-9]{2,3})*(?:\.[0-9]{2})?\s*(?:/-)?",
    r"(?i)\b[0-9]{1,3}(?:,[0-9]{2,3})+\s*/-",
    r"(?i)(?:Rupees|Rs\.)\s+[A-Za-z\s]+(?:Lakhs?|Crores?|Thousand|Hundred)[A-Za-z\s]*",
)
# Month names, and patterns of dates in the order in which they are tried.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DATES = (
    r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b", r"\b[0-9]{1,2}-[0-9]{1,2}-[0-9]{2,4}\b", r"\b[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2,4}\b",
    rf"(?i)\b[0-9]{{1,2}}\s+(?:{MONTHS})[a-z]*\s+[0-9]{{2,4}}\b", rf"(?i)\b(?:{MONTHS})[a-z]*\s+[0-9]{{1,2}},?\s+[0-9]{{2,4}}\b",
)
# Patterns of the other kinds of facts.
FACTS = {
    "interest_rate": (r"(?i)\b[0-9]+(?:\.[0-9]+)?\s*%\s*(?:p\.?a\.?|per\s+annum)?\b",),
    "instalment_schedule": (r"(?i)\b(?:[0-9]+\s+monthly\s+instalments|[0-9]+\s+monthly\s+installments|[0-9]+\s+emis|[0-9]+\s+equal\s+monthly\s+installments)\b",),
    "notice_deadline": (r"(?i)\b(?:within\s+)?(?:[0-9]+|\b(?:fifteen|thirty|seven|fourteen|twenty|sixty)\b)\s+days(?:\s+from\s+receipt|\s+from\s+the\s+date)?\b",),
    "statutory_reference": (
        r"(?i)Order\s+[0-9IVXLCDM]+\s+Rule\s+[0-9]+[^,\n)]*(?:Code of Civil Procedure|CPC)?", r"(?i)Section\s+[0-9]+[A-Za-z]?(?:\s*\([^)]+\))?(?:\s+of\s+[A-Za-z\s,0-9]+Act)?",
        r"(?i)IPC\s+Section\s+[0-9]+[A-Za-z]?", r"(?i)BNS\s+Section\s+[0-9]+[A-Za-z]?", r"(?i)Section\s+138(?:\s+Negotiable\s+Instruments\s+Act)?", r"(?i)Code of Civil Procedure,\s*1908",
        r"(?i)Indian Contract Act,\s*1872", r"(?i)Bharatiya Nyaya Sanhita,\s*2023", r"(?i)Limitation Act,\s*1963", r"(?i)Consumer Protection Act,\s*2019", r"(?i)Negotiable Instruments Act,\s*1881",
    ),
    "case_number": (r"(?i)\b(?:Case\s+No|O\.?S\.?|C\.?C\.?|Crime\s+No|FIR\s+No|Petition\s+No|Complaint\s+No)\.?\s*[:\s]?\s*[A-Za-z0-9/\-]+\b",),
}
# Words near a sum or a date that tell what it is, in the order of precedence.
AMOUNT_TYPES = (
    ("loan_amount", ("loan amount", "advanced a loan", "sanctioned loan", "principal loan")), ("outstanding_amount", ("outstanding", "dues", "balance amount", "due and payable", "arrears")),
    ("instalment_amount", ("monthly instalment", "monthly installment", "emi", "per month")), ("claimed_amount", ("claim", "demanded", "called upon to pay", "seek recovery")), ("interest_amount", ("interest",)),
)
DATE_TYPES = (
    ("document_date", ("dated", "date:", "notice date", "legal notice")), ("loan_date", ("loan on", "advanced", "availed on", "borrowed on", "disbursed")), ("agreement_date", ("agreement date", "contract dated", "deed dated", "executed on")),
    ("hearing_date", ("hearing", "listed on", "appear on")), ("incident_date", ("incident", "occurred on", "alleged on")), ("deadline", ("deadline", "due date", "within", "pay before")),
)
# Words of a line that gives evidence, the line's least and most characters, and lines of a document.
EVIDENCE = ("loan amount", "advanced a loan", "outstanding amount", "repay", "monthly instalments", "interest at", "called upon to pay", "notice is hereby given", "failed to pay", "dishonestly took", "caused the death", "stolen", "breached", "employment", "deficiency")
EVIDENCE_CHARS, EVIDENCE_LINES = (20, 300), 15
# Characters on each side that show what a value is.
CONTEXT = 80
# Deadlines that are compared, the first that a text names.
DEADLINES = (("15 days", ("15 days", "fifteen days")), ("30 days", ("30 days", "thirty days")), ("7 days", ("7 days", "seven days")))
# Words of an agreed and of another forum, and the least sum that is compared.
ARBITRATION, COURT, LEAST_SUM = ("arbitrat",), ("police complaint", "fir", "civil court"), 100.0
# Patterns of dates in a timeline, and the characters that part a date from its event.
TIMELINE_DATES = (r"\b[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\b", DATES[3])
EVENT_EDGE = " :-"

#: Parts into which the documents of one case are spread for a join.
SALTS = 16


def let(value: Column, body) -> Column:
    """The body with the value worked out once, which an expression inside a lambda wouldn't do by itself."""
    return F.transform(F.array(value), body)[0]


def placed(text: Column, pattern: str) -> Column:
    """The matches of a pattern: array of value and start."""
    none = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<value:string,start:int>>)").alias("out"))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["skip"] + F.length(x["value"])).alias("at"), F.array_append(acc["out"], F.struct(x["value"].alias("value"), (acc["at"] + x["skip"]).alias("start"))).alias("out")
    )

    def with_places(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        both = F.zip_with(between, found, lambda p, m: F.struct(F.length(p).alias("skip"), m.alias("value")))
        return F.aggregate(both, none, step, lambda acc: acc["out"])

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), with_places)


def first_of_equals(items: Column, key) -> Column:
    """An array without the items whose key an earlier one has."""
    return let(items, lambda it: let(F.transform(it, key), lambda keys: F.filter(it, lambda x, i: F.array_position(keys, key(x)) == i + 1)))


def _plain(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"\s+", " "), "^ | $", "")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _typed(text: Column, x: Column, types: tuple, other: str) -> Column:
    begin = F.greatest(x["start"] - CONTEXT, F.lit(0))
    near = F.lower(F.substring(text, begin + 1, x["start"] + F.length(x["value"]) + CONTEXT - begin))
    return let(near, lambda n: reduce(lambda case, t: case.when(_any(n, t[1]), t[0]), types, F.when(F.lit(False), "")).otherwise(other))


def _exploded(docs: DataFrame, doc_id: str, items: Column) -> DataFrame:
    x = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(items).alias("n", "x"))
    return x.select("doc_id", (F.col("n") + 1).alias("place"), "x.*")


def amounts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, place, value, start, type and confidence of the sums of each text."""
    t = F.coalesce(F.col(text), F.lit(""))
    raw = F.filter(F.concat(*[placed(t, p) for p in AMOUNTS]), lambda x: F.length(_plain(x["value"])) >= 3)
    once = first_of_equals(raw, lambda x: F.lower(F.regexp_replace(x["value"], r"[^0-9A-Za-z_]", "")))
    sure = lambda v: F.contains(v, F.lit("₹")) | F.contains(F.lower(v), F.lit("rs."))
    typed = lambda x: F.struct(_plain(x["value"]).alias("value"), x["start"].alias("start"), _typed(t, x, AMOUNT_TYPES, "monetary_amount").alias("type"), F.when(sure(x["value"]), "high").otherwise("medium").alias("confidence"))
    return _exploded(docs, doc_id, F.transform(once, typed))


def dates(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, place, value, start and type of the dates of each text."""
    t = F.coalesce(F.col(text), F.lit(""))
    once = first_of_equals(F.concat(*[placed(t, p) for p in DATES]), lambda x: F.lower(x["value"]))
    typed = lambda x: F.struct(x["value"].alias("value"), x["start"].alias("start"), _typed(t, x, DATE_TYPES, "general_date").alias("type"))
    return _exploded(docs, doc_id, F.transform(once, typed))


def values(text: Column, kind: str) -> Column:
    """The distinct values of one kind of FACTS, in the order of patterns and places."""
    t = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.transform(F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in FACTS[kind]]), lambda v: F.regexp_replace(v, r"^\s+|\s+$", "")))


def facts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, kind, place and value of rates, instalments, deadlines, references and case numbers."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), values(F.col(text), k).alias("found")) for k in FACTS])
    x = docs.select(F.col(doc_id).alias("doc_id"), F.explode(each).alias("k"))
    return x.select("doc_id", "k.kind", F.posexplode("k.found").alias("n", "value")).select("doc_id", "kind", (F.col("n") + 1).alias("place"), "value")


def evidence_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, place and line of the lines that give evidence."""
    lines = F.transform(F.split(one_line_end(F.col(text)), "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    kept = F.filter(lines, lambda x: F.length(x).between(*EVIDENCE_CHARS) & _any(F.lower(x), EVIDENCE))
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.slice(kept, 1, EVIDENCE_LINES)).alias("n", "line")).select("doc_id", (F.col("n") + 1).alias("place"), "line")


def timeline(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, place, date and event of every date of every sentence, in the order of the document, the first of equals.

    A date at the beginning of its sentence is left out of the event.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"[\r\n.]+", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) > 15)
    dated = lambda part: F.transform(F.concat(*[F.regexp_extract_all(part, F.lit(p), F.lit(0)) for p in TIMELINE_DATES]), lambda d: F.struct(d.alias("date"), part.alias("part")))
    rest = lambda x: F.btrim(F.substring(x["part"], F.length(x["date"]) + 1, F.length(x["part"])), F.lit(EVENT_EDGE))
    event = lambda x: F.when(F.startswith(x["part"], x["date"]) & (rest(x) != ""), rest(x)).otherwise(x["part"])
    items = F.transform(F.flatten(F.transform(parts, dated)), lambda x: F.struct(x["date"].alias("date"), event(x).alias("event")))
    once = first_of_equals(items, lambda x: F.struct(F.lower(x["date"]).alias("d"), F.lower(F.substring(x["event"], 1, 50)).alias("e")))
    return _exploded(docs, doc_id, once)


def compared(docs: DataFrame, doc_id: str, text: str, case: list[str]) -> DataFrame:
    """One row per document and kind with the sorted values that documents of a case are compared by."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(t)
    deadline = reduce(lambda c, d: c.when(_any(low, d[1]), d[0]), DEADLINES, F.when(F.lit(False), ""))
    sums = F.array_distinct(F.transform(F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in AMOUNTS]), _plain))
    days = F.array_distinct(F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in DATES]))
    kinds = {"amount_conflict": sums, "date_conflict": days, "deadline_conflict": F.filter(F.array(deadline), lambda d: d.isNotNull()), "interest_rate_conflict": values(F.col(text), "interest_rate")}
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_sort(v).alias("held")) for k, v in kinds.items()])
    x = docs.select(*case, F.col(doc_id).alias("doc_id"), F.explode(each).alias("_k"))
    return x.select(*case, "doc_id", "_k.kind", "_k.held").where(F.size("held") > 0)


def conflicts(docs: DataFrame, doc_id: str, text: str, case: list[str]) -> DataFrame:
    """The documents whose sums, dates, deadline or rates differ from those of the first document of their case that has any.

    A case may hold a third of all documents: its first document is found by a partial minimum, and meets the others
    spread by a salt. Documents without a case aren't compared.
    """
    x = compared(docs, doc_id, text, case).dropna(subset=case)
    first = x.groupBy(*case, "kind").agg(F.min(F.struct("doc_id", "held")).alias("_f"))
    salted = first.select(*case, "kind", F.col("_f.doc_id").alias("first_doc"), F.col("_f.held").alias("first_held"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    both = x.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*case, "kind", "_salt"])
    return both.where((F.col("doc_id") != F.col("first_doc")) & (F.col("held") != F.col("first_held"))).select(*case, "kind", "first_doc", "doc_id", F.size(F.array_except("held", "first_held")).alias("n_new"))


def contradictions(docs: DataFrame, doc_id: str, text: str, case: list[str]) -> DataFrame:
    """Cases whose first two documents with sums name different largest ones, or that name both arbitration and a court."""
    t = F.coalesce(F.col(text), F.lit(""))
    number = lambda v: F.regexp_replace(F.regexp_extract(F.regexp_replace(v, " ", ""), r"([0-9,]+(?:\.[0-9]{2})?)", 1), ",", "").try_cast("double")
    sums = F.filter(F.transform(F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in AMOUNTS]), number), lambda v: v > LEAST_SUM)
    x = docs.select(*case, F.col(doc_id).alias("doc_id"), F.array_max(sums).alias("_largest"), _any(F.lower(t), ARBITRATION).alias("_arb"), _any(F.lower(t), COURT).alias("_court")).dropna(subset=case)
    two = x.where(F.col("_largest").isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(*case).orderBy("doc_id"))).where("_n <= 2")
    apart = two.groupBy(*case).agg(F.count("*").alias("_n"), F.min_by("_largest", "_n").alias("first_sum"), F.max_by("_largest", "_n").alias("second_sum"))
    apart = apart.where((F.col("_n") == 2) & (F.abs(F.col("first_sum") - F.col("second_sum")) > 1)).select(*case, F.lit("amount_conflict").alias("kind"), "first_sum", "second_sum")
    forum = x.groupBy(*case).agg(F.count("*").alias("_n"), F.bool_or("_arb").alias("_arb"), F.bool_or("_court").alias("_court")).where("_n > 1 and _arb and _court")
    return apart.unionAll(forum.select(*case, F.lit("forum_conflict"), F.lit(None).cast("double"), F.lit(None).cast("double")))
