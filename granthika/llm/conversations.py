"""Conversations rebuilt from message rows (problem 4).

Message rows are an event log. Each row is one event of a turn of its session: `create` (the turn is said),
`retry` (the row repeats role and text of the row before within four seconds: a later version of the same
turn), `delete` (the row shows nothing), `notice` (an assistant row with only a server error notice) or
`system`. Turns are numbered within their part of the session, versions within their turn, and
`fold_versions` folds the log to the last version of each turn; where a log has edits and deletes of its own,
the same fold reduces them. Folded turns are ordered by time, then id, and their sessions are validated.

A session may hold a third of all rows, so no window runs over a whole session: rows are windowed by
(session, hour), each hour is reduced to at most three markers (its first turn, and the first and last of its
other turns), and only markers are windowed by session. Sizes follow hours, never rows.

Defined results: null, blank and invisible texts show nothing; created_at null, not positive or not finite
is no usable time; milliseconds, microseconds and nanoseconds are read as seconds; a role is usable if its
trimmed lower case is one of the spellings below; equal times are ordered by id; rows repeated with all
their columns are one event; a null session_id belongs to no session; an empty table gives an empty
result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Spellings of the speaker roles.
USER_ROLES = ("user", "human", "citizen", "customer")
ASSISTANT_ROLES = ("assistant", "bot", "ai", "model")
SYSTEM_ROLES = ("system",)

RETRY_SECONDS = 4.0
#: Seconds of one part of a session; parts are windowed in parallel.
PART = 3_600.0
#: Events after which a turn stands.
SAID = ("create", "retry")

#: Characters that show nothing: white space, controls, and format characters such as zero-width spaces.
_UNSEEN = r"[\s\p{Z}\p{C}ᅟᅠㅤ⠀︀-️]+"
# A notice by form: an apology, then a status or what failed and how, then an advice; nothing else.
_SORRY = r"(?:(?:we are |we're |i'm |i am )?(?:very |so )?sorry|apologies|oops|whoops|we apologi[sz]e(?: for the inconvenience)?)[^\p{L}\p{M}\p{N}]+(?:but )?"
_STATUS = r"(?:(?:http|error|status|code)[^\p{L}\p{M}\p{N}]*)+[45]\d\d"
_PART = r"(?:the |our |this |an? )?(?:(?:answer|chat|internal|remote|upstream|bad|text|response|language|application|unexpected|unknown|api) )*(?:server|service|gateway|model|request|response|connection|connect|network|backend|generation|upstream|system|assistant)"
_FAILED = r"(?:(?:has |is |are |was |be |could )*(?:currently |temporarily |still )?(?:not (?:be )?(?:available|reached|responding)|unavailable|overloaded|down|failed|aborted|refused|reset|closed|lost|unreachable|timed[ -]?out)|error|failure|fault|time-?out|crashed)"
_WRONG = r"(?:something|everything) (?:went|has gone) wrong|an? (?:(?:unexpected|internal|unknown|server) )*(?:error|problem) (?:has )?(?:occurred|happened)|too many requests"
_WHERE = r"(?: (?:on|at) (?:our|the server'?s?|my) (?:side|end|part)| here)?"
_ADVICE = r"(?:(?:please |kindly |you (?:can|may) )?(?:try|retry)(?: (?:it|this))?(?: again)?(?: (?:later|shortly|soon|in (?:a|some|a few) (?:moments?|minutes?|while|time)))?)"
_CLAUSE = rf"(?:{_PART} {_FAILED}|{_WRONG}){_WHERE}"
_NOTICE = rf"(?i)^[^\p{{L}}\p{{M}}\p{{N}}]*(?:{_SORRY})?(?:(?:{_STATUS})(?:[^\p{{L}}\p{{M}}\p{{N}}]+{_CLAUSE})?|{_CLAUSE})(?:[^\p{{L}}\p{{M}}\p{{N}}]+{_CLAUSE})*(?:[^\p{{L}}\p{{M}}\p{{N}}]+{_ADVICE})?[^\p{{L}}\p{{M}}\p{{N}}]*$"


def shows(text: Column) -> Column:
    """Whether a text shows anything to a reader."""
    return F.coalesce(F.length(F.regexp_replace(text, _UNSEEN, "")) > 0, F.lit(False))


def clean_role(role: Column) -> Column:
    r = F.lower(F.regexp_replace(role, _UNSEEN, ""))
    return F.when(r.isin(*USER_ROLES), "user").when(r.isin(*ASSISTANT_ROLES), "assistant").when(r.isin(*SYSTEM_ROLES), "system")


def clean_time(created_at: Column) -> Column:
    """Seconds since 1970; null where the value is no usable time."""
    t = created_at.cast("double")
    t = F.when(t > 1e17, t / 1e9).when(t > 1e14, t / 1e6).when(t > 1e11, t / 1e3).otherwise(t)
    return F.when((t > 0) & (t < 1e11), t)


def is_notice(text: Column) -> Column:
    """Whether a text is only a server error notice; invisible characters don't hide one."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\p{Cf}]", ""), r"[\s\p{Z}]+", " "))
    return F.coalesce(plain.rlike(_NOTICE), F.lit(False))


def fold_versions(log: DataFrame, keys: list[str], version: str, op: str, deletes: tuple[str, ...] = ("delete", "deleted")) -> DataFrame:
    """The last version of each turn of a log with explicit edits and deletes; deleted turns are gone.

    `keys` name one turn, e.g. (session_id, turn_id). A partial max on the map side, then one shuffle by
    turn; a turn has few versions even where a session has many turns. Equal versions: the row that is
    larger as a whole wins, so that the result doesn't depend on the order of arrival.
    """
    rest = [c for c in log.columns if c not in (*keys, version)]
    last = log.groupBy(*keys).agg(F.max(F.struct(F.col(version), F.struct(*rest).alias("_rest"))).alias("_last"))
    flat = last.select(*keys, F.col(f"_last.{version}").alias(version), *[F.col(f"_last._rest.{c}").alias(c) for c in rest])
    return flat.where(~F.coalesce(F.lower(F.col(op)).isin(*deletes), F.lit(False)))


def events(messages: DataFrame) -> DataFrame:
    """The rows of the log with session, id, user, clean role and time, hash of the text, and their part."""
    m = messages.select("session_id", "id", "user_id", "role", "text", "created_at").where(F.col("session_id").isNotNull())
    t = clean_time(F.col("created_at"))
    return m.select(
        "session_id", "id", "user_id", clean_role(F.col("role")).alias("speaker"), t.alias("t"), "text",
        shows(F.col("text")).alias("seen"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.floor(t / PART).alias("part"),
    )


def _log(ev: DataFrame, *kept: str) -> DataFrame:
    """The log of events of usable time: number of the turn in its part, version, op, and when the turn was first said."""
    w = Window.partitionBy("session_id", "part").orderBy("t", "id")
    op = F.when(~F.col("seen"), "delete").when(F.col("speaker") == "system", "system").when((F.col("speaker") == "assistant") & is_notice(F.col("text")), "notice")
    same = (F.lag("speaker").over(w) == F.col("speaker")) & (F.lag("h").over(w) == F.col("h")) & (F.col("t") - F.lag("t").over(w) <= RETRY_SECONDS)
    ok = ev.where(F.col("t").isNotNull()).select("session_id", "part", "t", "id", "speaker", "h", *kept, op.alias("none"))
    ok = ok.withColumn("pos", F.row_number().over(w)).withColumn("again", F.coalesce(same, F.lit(False)))
    began = F.last(F.when(~F.col("again"), F.struct("pos", "t", "id")), ignorenulls=True).over(w)
    ok = ok.withColumn("began", began)
    op = F.coalesce("none", F.when(F.col("speaker").isNull(), "unknown"), F.when(F.col("again"), "retry"), F.lit("create"))
    return ok.select("session_id", "part", F.col("began.pos").alias("turn"), (F.col("pos") - F.col("began.pos")).alias("version"), op.alias("op"), "t", "speaker", "h", F.col("began.t").alias("said_at"), F.col("began.id").alias("id"), *kept)


def _folded(ev: DataFrame, *kept: str) -> DataFrame:
    """The last version of each turn. Turns that show nothing stay as marks, as the next part may repeat them."""
    return fold_versions(_log(ev, *kept), ["session_id", "part", "turn"], "version", "op", deletes=())


def _parts(folded: DataFrame) -> DataFrame:
    """One row per session and part: first turn, last event, and the chain of the turns after the first."""
    w = Window.partitionBy("session_id", "part").orderBy("turn")
    # The next turn of the same part, for the turns after the first.
    role = F.when(F.col("op").isin(*SAID) & (F.col("turn") > 1), F.col("speaker"))
    ahead = F.first(F.col("role_in"), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    x = folded.withColumn("role_in", role).withColumn("ahead", ahead)
    return x.groupBy("session_id", "part").agg(
        F.min(F.when(F.col("turn") == 1, F.struct("speaker", "h", F.col("said_at").alias("t"), F.col("op").isin(*SAID).alias("said")))).alias("head"),
        F.max_by(F.struct("speaker", "h", "t"), "turn").alias("tail"),
        F.min_by("role_in", F.when(F.col("role_in").isNotNull(), F.col("turn"))).alias("rest_first"),
        F.max_by("role_in", F.when(F.col("role_in").isNotNull(), F.col("turn"))).alias("rest_last"),
        F.count("role_in").alias("rest_n"),
        F.max((F.col("role_in") == "user") & (F.col("ahead") == "user")).alias("inner_gap"),
    )


def _chained(parts: DataFrame) -> DataFrame:
    """Parts with whether their first turn is said there, now that the part before is known."""
    w = Window.partitionBy("session_id").orderBy("part")
    before = F.lag("tail").over(w)
    same = (before["speaker"] == F.col("head.speaker")) & (before["h"] == F.col("head.h")) & (F.col("head.t") - before["t"] <= RETRY_SECONDS)
    return parts.withColumn("head_turn", F.col("head.said") & ~F.coalesce(same, F.lit(False)))


def verdicts(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """session_id and the first reason to drop it (empty, broken, no_reply), or null for a sound session.

    Sessions are the ids of both tables. Shuffles: rows by (session, part), then one row per part by session.
    """
    ev = events(messages)
    per = ev.groupBy("session_id").agg(
        F.max("seen").alias("any_seen"),
        F.max(F.col("speaker").isNull() | F.col("t").isNull()).alias("bad_row"),
        (F.coalesce(F.min("user_id"), F.lit(-1)) != F.coalesce(F.max("user_id"), F.lit(-1))).alias("many_users"),
    )
    parts = _chained(_parts(_folded(ev)))
    w = Window.partitionBy("session_id").orderBy("part", "k")
    marks = F.array(
        F.when(F.col("head_turn"), F.struct(F.lit(0).alias("k"), F.col("head.speaker").alias("r"))),
        F.when(F.col("rest_n") > 0, F.struct(F.lit(1).alias("k"), F.col("rest_first").alias("r"))),
        F.when(F.col("rest_n") > 1, F.struct(F.lit(2).alias("k"), F.col("rest_last").alias("r"))),
    )
    flat = parts.select("session_id", "part", "inner_gap", F.explode(F.filter(marks, lambda x: x.isNotNull())).alias("m"))
    flat = flat.select("session_id", "part", "inner_gap", "m.k", "m.r")
    nxt, nxt_k, nxt_part = F.lead("r").over(w), F.lead("k").over(w), F.lead("part").over(w)
    within = (F.col("k") == 1) & (nxt_k == 2) & (nxt_part == F.col("part"))  # its gaps are in inner_gap
    gap = (F.col("r") == "user") & (nxt.isNull() | (nxt == "user")) & ~F.coalesce(within, F.lit(False))
    chain = flat.withColumn("gap", gap).groupBy("session_id").agg(
        F.min_by("r", F.struct("part", "k")).alias("first_role"),
        F.max(F.col("gap") | F.coalesce("inner_gap", F.lit(False))).alias("no_reply"),
    )
    ids = sessions.select(F.col("id").alias("session_id")).where(F.col("id").isNotNull()).distinct()
    all_ids = ids.join(per, "session_id", "full_outer").join(chain, "session_id", "left")
    reason = (
        F.when(~F.coalesce("any_seen", F.lit(False)), "empty")
        .when(F.col("bad_row") | F.col("many_users") | ~F.coalesce(F.col("first_role") == "user", F.lit(False)), "broken")
        .when(F.col("no_reply"), "no_reply")
    )
    return all_ids.select("session_id", reason.alias("reason"))


def found(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    return verdicts(sessions, messages).where(F.col("reason").isNotNull())


def turns(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """The turns of the sound sessions: session_id, turn_no from 1, role, id, said_at, text.

    turn_no is the turn's number within its part plus the turns of the parts before, so that a session of any
    size is numbered in parallel.
    """
    folded = _folded(events(messages), "text")
    parts = _chained(_parts(folded))
    w = Window.partitionBy("session_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    n = F.col("rest_n") + F.col("head_turn").cast("int")
    offsets = parts.select("session_id", "part", "head_turn", F.coalesce(F.sum(n).over(w), F.lit(0)).alias("offset"))
    sound = verdicts(sessions, messages).where(F.col("reason").isNull()).select("session_id")
    kept = F.col("op").isin(*SAID) & ((F.col("turn") > 1) | F.col("head_turn"))
    rows = folded.join(offsets, ["session_id", "part"]).where(kept).join(sound, "session_id", "left_semi")
    within = F.row_number().over(Window.partitionBy("session_id", "part").orderBy("turn"))
    return rows.select("session_id", (F.col("offset") + within).cast("bigint").alias("turn_no"), F.col("speaker").alias("role"), "id", "said_at", "text")
