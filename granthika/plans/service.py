"""Users, sessions and conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granthika.functions import answers, chat
from granthika.functions.text import any_of, intent, section_numbers
from granthika.operators import nested
from granthika.operators.store import latest_n
from granthika.sources.tables import table


def conv_counts(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-02, SQL-05, AGG-06: all sessions with their number of messages. Counted before the join, so a long session costs one row."""
    n = table(spark, d, "chat_messages").groupBy("session_id").agg(F.count("*").alias("n_messages"))
    s = table(spark, d, "chat_sessions")
    return s.join(n, s["id"] == n["session_id"], "left").select(s["id"], "user_id", F.coalesce("n_messages", F.lit(0)).alias("n_messages"))


def user_stats(spark: SparkSession, d: str) -> DataFrame:
    """AGG-05, SQL-04: conversations, questions, documents and distinct topics of each user."""
    c = table(spark, d, "conversations").groupBy("user_id").agg(
        F.count("*").alias("n_conversations"), F.sum("question_count").alias("n_questions"), F.sum("documents_count").alias("n_documents"),
        F.count_if(F.col("status") == "active").alias("n_active"), F.countDistinct("legal_topic").alias("n_topics"),
    )
    u = table(spark, d, "users").select("id")
    zero = [F.coalesce(x, F.lit(0)).alias(x) for x in ("n_conversations", "n_questions", "n_documents", "n_active", "n_topics")]
    return u.join(c, u["id"] == c["user_id"], "left").select("id", *zero)


def _said(spark: SparkSession, d: str) -> DataFrame:
    """Chat rows with the time they were said at, by which, then by id, they are ordered."""
    return table(spark, d, "chat_messages").withColumn("said_at", chat.seconds(F.col("created_at")))


def conv_last_turns(spark: SparkSession, d: str) -> DataFrame:
    """WIN-06: the last six messages of each session by time, then id."""
    return latest_n(_said(spark, d).select("session_id", "id", "role", "said_at"), "session_id", [F.desc("said_at"), F.desc("id")], 6).drop("said_at")


#: Seconds of one part of a session; parts are windowed in parallel.
PART = 3_600.0


def history_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """WIN-07, RAG-01: user messages that are short or ask on, with the user's message before them put in front.

    A session may hold a third of all rows: rows are windowed by session and hour, and only the first row of an
    hour takes its message from the hour before, of which one row each is left.
    """
    m = _said(spark, d).where(chat.is_user(F.col("role")) & F.col("text").isNotNull()).withColumn("part", F.floor(F.col("said_at") / PART))
    w = Window.partitionBy("session_id", "part").orderBy("said_at", "id")
    x = m.select("session_id", "part", "id", "said_at", "text", F.lag("text").over(w).alias("within"))
    last = x.groupBy("session_id", "part").agg(F.max_by("text", F.struct("said_at", "id")).alias("last"))
    ahead = last.select("session_id", "part", F.lag("last").over(Window.partitionBy("session_id").orderBy("part")).alias("earlier"))
    x = x.where(F.col("within").isNotNull()).withColumn("earlier", F.lit(None).cast("string")).unionByName(x.where(F.col("within").isNull()).join(ahead, ["session_id", "part"]))
    n_words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    low, before = F.lower("text"), F.coalesce("within", "earlier")
    on = any_of(low, chat.FOLLOW_UPS)
    return x.where(((n_words < chat.LEAST_WORDS) | on) & before.isNotNull()).select("id", F.concat_ws(" ", before, "text").alias("question"))


def conv_titles(spark: SparkSession, d: str) -> DataFrame:
    """SQL-07: the title a session gets from its first user message, sixty characters and an ellipsis."""
    m = _said(spark, d).where(chat.is_user(F.col("role")) & (F.length(F.trim("text")) > 0))
    first = m.groupBy("session_id").agg(F.min_by("text", F.struct("said_at", "id")).alias("text"))
    return first.select("session_id", F.when(F.length("text") > 60, F.concat(F.substring("text", 1, 60), F.lit("..."))).otherwise(F.col("text")).alias("title"))


def conv_search(spark: SparkSession, d: str) -> DataFrame:
    """FLT-07, FLT-08, TOP-10: conversations of known users that mention a deposit, newest first within the user, ten each."""
    c = table(spark, d, "conversations").where(F.col("user_id") > 0)
    hit = F.col("title").ilike("%deposit%") | F.col("last_question").ilike("%deposit%") | F.col("last_answer").ilike("%deposit%")
    return latest_n(c.where(hit).select("user_id", "id", "updated_at"), "user_id", [F.desc("updated_at"), F.col("id")], 10)


def conv_recomputed(spark: SparkSession, d: str) -> DataFrame:
    """SQL-10: question count and last texts of each conversation from its messages."""
    m = _said(spark, d).where(F.col("text").isNotNull())
    user, bot, at = chat.is_user(F.col("role")), chat.is_assistant(F.col("role")), F.struct("said_at", "id")
    return m.groupBy("session_id").agg(
        F.count_if(user).alias("n_questions"), F.max_by(F.when(user, F.col("text")), F.when(user, at)).alias("last_question"),
        F.substring(F.max_by(F.when(bot, F.col("text")), F.when(bot, at)), 1, 160).alias("last_answer"),
    )


def all_conversations(spark: SparkSession, d: str) -> DataFrame:
    """SET-06: conversations with the sessions that have none; a conversation goes before a session of its id."""
    c = table(spark, d, "conversations").select("id", "user_id", F.lit(0).alias("legacy")).unionAll(table(spark, d, "chat_sessions").select("id", "user_id", F.lit(1)))
    return c.groupBy("id").agg(F.min(F.struct("legacy", "user_id")).alias("m")).select("id", "m.user_id", "m.legacy")


def sanitised_answers(spark: SparkSession, d: str) -> DataFrame:
    """Post-processing: assistant messages without reasoning, fences and lead-ins, as length and hash."""
    m = table(spark, d, "chat_messages").where(chat.is_assistant(F.col("role"))).select("id", answers.plain_answer(F.col("text")).alias("t"))
    return m.select("id", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("h"))


def claim_support(spark: SparkSession, d: str) -> DataFrame:
    """SET-05: sections that an answer names, parted by whether its citations have them."""
    m = table(spark, d, "chat_messages").where(chat.is_assistant(F.col("role")))
    named = m.select(F.col("id").cast("bigint").alias("id"), section_numbers(F.col("text")).alias("named")).where(F.size("named") > 0)
    nodes = nested.json_objects(table(spark, d, "chat_messages"), "chat_messages", "id", "sources_json").where(F.col("kind").isin("$", "$[]"))
    cited = nodes.select("row_id", F.trim(F.col("fields")["section"]).alias("s")).where(F.col("s") != "").groupBy("row_id").agg(F.collect_set("s").alias("cited"))
    x = named.join(cited, named["id"] == cited["row_id"], "left").withColumn("cited", F.coalesce("cited", F.expr("cast(array() as array<string>)")))
    return x.select("id", F.size(F.array_intersect("named", "cited")).alias("n_supported"), F.size(F.array_except("named", "cited")).alias("n_unsupported"))


def session_owners(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-01, SQL-02: sessions with the name of their user; visitors have none."""
    u = table(spark, d, "users").select(F.col("id").alias("user_id"), "username", F.initcap(F.trim("full_name")).alias("name"))
    return table(spark, d, "chat_sessions").select("id", "user_id").join(u, "user_id")


def profile_update(spark: SparkSession, d: str) -> DataFrame:
    """SQL-03: users with missing fields filled by the defaults, given values kept."""
    keep = lambda c, to: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(to)).alias(c)
    return table(spark, d, "users").select("id", keep("email", "none"), keep("theme", "light"), keep("default_explanation_lang", "english"))


def history_by_type(spark: SparkSession, d: str) -> DataFrame:
    """SQL-09: entries of each user by type with the newest time."""
    return table(spark, d, "case_history").groupBy("user_id", "item_type").agg(F.count("*").alias("n"), F.max("timestamp").alias("newest"), F.max_by("id", F.struct("timestamp", "id")).alias("newest_id"))


def message_intents(spark: SparkSession, d: str) -> DataFrame:
    """RET-06: intent of each user message."""
    m = table(spark, d, "chat_messages").where(chat.is_user(F.col("role")))
    return m.select("id", intent(F.col("text")).alias("intent"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (conv_counts, user_stats, conv_last_turns, history_rewrite, conv_titles, conv_search, conv_recomputed, session_owners, profile_update, history_by_type, message_intents, all_conversations, sanitised_answers, claim_support)}


def _contains(words: tuple[str, ...], col: str) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def oracle_sql() -> dict[str, str]:
    from granthika.functions.text import DEFINITION_WORDS, PUNISHMENT_WORDS

    user, bot = (f"coalesce(lower(trim(role, ' ')) IN {words}, false)" for words in (chat.USER, chat.ASSISTANT))
    said = "(SELECT *, CASE WHEN u > 0 AND u < 1e11 THEN u ELSE 0 END AS said_at FROM (SELECT *, CASE WHEN created_at > 1e17 THEN created_at / 1e9 WHEN created_at > 1e14 THEN created_at / 1e6 WHEN created_at > 1e11 THEN created_at / 1e3 ELSE created_at END AS u FROM chat_messages))"
    lead = r"^\s*(?:" + "|".join(answers.LEAD_INS) + r")\s*[:.,-]\s*"
    answer = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<think>.*?</think>', '', 'gis'), '^\s+|\s+$', '', 'g'), '^```(?:text|markdown)?\s*', '', 'i'), '\s*```$', ''), '^\s+|\s+$', '', 'g')"
    for _ in range(answers.PASSES):
        answer = f"regexp_replace({answer}, '{lead}', '', 'i')"
    return {
        "conv_counts": "SELECT s.id, s.user_id, count(m.id) AS n_messages FROM chat_sessions s LEFT JOIN chat_messages m ON m.session_id = s.id GROUP BY 1, 2",
        "user_stats": "SELECT u.id, count(c.id) AS n_conversations, coalesce(sum(question_count), 0)::BIGINT AS n_questions, coalesce(sum(documents_count), 0)::BIGINT AS n_documents, count(*) FILTER (WHERE status = 'active') AS n_active, count(DISTINCT legal_topic) AS n_topics FROM users u LEFT JOIN conversations c ON c.user_id = u.id GROUP BY 1",
        "conv_last_turns": f"SELECT session_id, id, role, row_number() OVER (PARTITION BY session_id ORDER BY said_at DESC, id DESC) AS place FROM {said} QUALIFY place <= 6",
        "history_rewrite": rf"SELECT id, before || ' ' || text AS question FROM (SELECT id, text, lag(text) OVER (PARTITION BY session_id ORDER BY said_at, id) AS before FROM {said} WHERE {user} AND text IS NOT NULL) WHERE before IS NOT NULL AND (len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) < 7 OR {_contains(chat.FOLLOW_UPS, 'lower(text)')})",
        "conv_titles": f"SELECT session_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || '...' ELSE t END AS title FROM (SELECT session_id, arg_min(text, struct_pack(a := said_at, b := id)) AS t FROM {said} WHERE {user} AND length(trim(text, ' ')) > 0 GROUP BY 1)",
        "conv_search": "SELECT user_id, id, updated_at, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id) AS place FROM conversations WHERE user_id > 0 AND (title ILIKE '%deposit%' OR last_question ILIKE '%deposit%' OR last_answer ILIKE '%deposit%') QUALIFY place <= 10",
        "conv_recomputed": f"SELECT session_id, count(*) FILTER (WHERE {user}) AS n_questions, arg_max(text, struct_pack(a := said_at, b := id)) FILTER (WHERE {user}) AS last_question, substr(arg_max(text, struct_pack(a := said_at, b := id)) FILTER (WHERE {bot}), 1, 160) AS last_answer FROM {said} WHERE text IS NOT NULL GROUP BY 1",
        "all_conversations": "SELECT id, user_id, 0 AS legacy FROM conversations UNION ALL SELECT id, user_id, 1 FROM chat_sessions WHERE id NOT IN (SELECT id FROM conversations)",
        "sanitised_answers": f"SELECT id, length(t) AS n_chars, sha256(t) AS h FROM (SELECT id, {answer} AS t FROM chat_messages WHERE {bot})",
        "claim_support": rf"""WITH once AS (SELECT id, CASE WHEN json_valid(sources_json) THEN sources_json END AS j FROM chat_messages),
twice AS (SELECT id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN j ->> '$' END ELSE j END AS j FROM once WHERE j IS NOT NULL),
cited AS (SELECT twice.id AS id, list(DISTINCT trim(json_extract_string(t.value, '$'), ' ')) AS cited FROM twice, json_tree(twice.j) t WHERE twice.j IS NOT NULL AND t.key = 'section' AND t.type NOT IN ('NULL', 'OBJECT', 'ARRAY') AND regexp_matches(t.fullkey, '^\$(\[\d+\])?\."?section"?$') AND trim(json_extract_string(t.value, '$'), ' ') <> '' GROUP BY 1),
named AS (SELECT id, list_distinct(regexp_extract_all(coalesce(text, ''), '(?i)(?:section|sec|u/s|धारा|ಸೆಕ್ಷನ್)\s*([0-9]+[A-Za-z]*)', 1)) AS named FROM chat_messages WHERE {bot})
SELECT id, len(list_filter(named, lambda x: list_contains(coalesce(cited, []), x)))::INT AS n_supported, len(list_filter(named, lambda x: NOT list_contains(coalesce(cited, []), x)))::INT AS n_unsupported FROM named LEFT JOIN cited USING (id) WHERE len(named) > 0""",
        "session_owners": "SELECT s.id, s.user_id, u.username, array_to_string(list_transform(string_split(lower(trim(full_name, ' ')), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS name FROM chat_sessions s JOIN users u ON u.id = s.user_id",
        "profile_update": "SELECT id, coalesce(nullif(trim(email, ' '), ''), 'none') AS email, coalesce(nullif(trim(theme, ' '), ''), 'light') AS theme, coalesce(nullif(trim(default_explanation_lang, ' '), ''), 'english') AS default_explanation_lang FROM users",
        "history_by_type": "SELECT user_id, item_type, count(*) AS n, max(timestamp) AS newest, arg_max(id, struct_pack(t := timestamp, i := id)) AS newest_id FROM case_history GROUP BY 1, 2",
        "message_intents": rf"SELECT id, CASE WHEN {_contains(PUNISHMENT_WORDS, 't')} THEN 'punishment' WHEN {_contains(DEFINITION_WORDS, 't')} THEN 'definition' ELSE 'general' END AS intent FROM (SELECT id, regexp_replace(trim(lower(coalesce(text, ''))), '\s+', ' ', 'g') AS t FROM chat_messages WHERE {user})",
    }
