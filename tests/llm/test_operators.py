import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granthika.llm import conversations as C
from granthika.llm import language, lookalike, packing, pii, scans, tokens, truncation
from granthika.llm.pii_samples import held_out, labelled_table

VOCABULARY = f"{tokens.TOKENIZERS}/{tokens.BYTE_BPE_50K}"
MESSAGE = "session_id string, id long, user_id long, role string, text string, sources_json string, created_at double, speaker string, day int"


# 4: conversations


def log(spark, *rows):
    return spark.createDataFrame([(s, i, u, r, t, None, at, "clash", 0) for s, i, u, r, t, at in rows], MESSAGE)


def verdict(spark, rows, sessions=()):
    ids = spark.createDataFrame([(s,) for s in sessions], "id string")
    return {r.session_id: r.reason for r in C.verdicts(ids, log(spark, *rows)).collect()}


DAY = 86_400.0


def test_reasons(spark):
    q, a = ("user", "a question"), ("assistant", "an answer")
    rows = [
        ("ok", 1, 1, *q, 10.0), ("ok", 2, 1, *a, 12.0),
        ("retry", 1, 1, *q, 10.0), ("retry", 2, 1, *q, 13.5), ("retry", 3, 1, *a, 20.0),
        ("again", 1, 1, *q, 10.0), ("again", 2, 1, *q, 15.0), ("again", 3, 1, *a, 20.0),
        ("midnight", 1, 1, *q, DAY - 1), ("midnight", 2, 1, *q, DAY + 1), ("midnight", 3, 1, *a, DAY + 9),
        ("days", 1, 1, *q, DAY - 1), ("days", 2, 1, *q, DAY + 60), ("days", 3, 1, *a, DAY + 90),
        ("blank", 1, 1, "user", " ​", 10.0), ("blank", 2, 1, "user", None, 11.0),
        ("notice", 1, 1, *q, 10.0), ("notice", 2, 1, "bot", "HTTP 500 Internal Server Error", 12.0),
        ("late", 2, 1, *q, 10.0), ("late", 1, 1, *a, 10.0),
        ("ms", 1, 1, *q, 1.6e12), ("ms", 2, 1, *a, 1.6e12 + 5000),
        ("role", 1, 1, *q, 10.0), ("role", 2, 1, "?", "x", 12.0),
        ("time", 1, 1, *q, None), ("time", 2, 1, *a, 12.0),
        ("users", 1, 1, *q, 10.0), ("users", 2, 2, *a, 12.0),
        ("open", 1, 1, *q, 10.0), ("open", 2, 1, *a, 12.0), ("open", 3, 1, *q, 30.0),
        (None, 1, 1, *q, 10.0),
    ]
    got = verdict(spark, rows, ["ok", "nothing", None])
    assert got == {
        "ok": None, "retry": None, "again": "no_reply", "midnight": None, "days": "no_reply", "blank": "empty", "notice": "no_reply", "late": "broken",
        "ms": None, "role": "broken", "time": "broken", "users": "broken", "open": "no_reply", "nothing": "empty",
    }


def plain_reason(rows):
    """Brute force over one session: (id, role, time) of rows that all show something."""
    turns, before = [], None
    for i, r, t, x in sorted(rows, key=lambda m: (m[2], m[0])):
        if not (before and before[0] == r and before[1] == x and t - before[2] <= 4):
            turns.append(r)
        before = (r, x, t)
    if turns[0] != "user":
        return "broken"
    return "no_reply" if any(a == "user" and b != "assistant" for a, b in zip(turns, [*turns[1:], None])) else None


def test_random_sessions_against_brute_force(spark):
    r = random.Random(3)
    rows, want = [], {}
    for s in range(150):
        mine = [(i, r.choice(["user", "assistant"]) if r.random() < 0.3 else ["user", "assistant"][i % 2], float(DAY - 20 + r.randrange(0, 40) + DAY * r.randrange(2)), r.choice("xy")) for i in range(r.randrange(1, 9))]
        rows += [(f"s{s}", i, 1, role, x, t) for i, role, t, x in mine]
        want[f"s{s}"] = plain_reason(mine)
    assert verdict(spark, rows) == want


def test_notices_by_form(spark):
    yes = ["HTTP 500 Internal Server Error", "Error 503: the answer service is not available.", "Request timed out, please try again.", "upstream connect error: connection refused", "[generation failed]", "Sorry, something went wrong on our side.", "Oops! An unexpected error occurred. Please try again later.", "The server is temporarily unavailable", "ser\u200bver error"]
    no = ["Section 500 deals with the server of the summons.", "Sorry, the request must name the section.", "The connection was refused by the water board, so you may appeal.", "ಲಿಖಿತ ಬೇಡಿಕೆಯಲ್ಲಿ ₹450 ಮೊತ್ತ", "", None, "Error 503 is what the meter shows; ask the inspector."]
    got = spark.createDataFrame([(x,) for x in yes + no], "x string").select(C.is_notice(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == [True] * len(yes) + [False] * len(no)


def test_retries_fold_to_their_turn(spark):
    rows = [("s", 1, 1, "user", "q", 10.0), ("s", 2, 1, "user", "q", 13.0), ("s", 3, 1, "user", "q", 16.9), ("s", 4, 1, "bot", "a", 3598.0), ("s", 5, 1, "bot", "a", 3601.0), ("s", 6, 1, "bot", "a", 3604.5)]
    got = C.turns(spark.createDataFrame([], "id string"), log(spark, *rows)).orderBy("turn_no").collect()
    assert [(x.turn_no, x.role, x.id, x.said_at) for x in got] == [(1, "user", 1, 10.0), (2, "assistant", 4, 3598.0)]


def test_turns_are_numbered_across_days(spark):
    rows = [("s", i, 1, ["user", "assistant"][i % 2], f"t{i}", 10.0 + i * DAY / 2) for i in range(6)]
    got = C.turns(spark.createDataFrame([], "id string"), log(spark, *rows)).orderBy("turn_no").collect()
    assert [(x.turn_no, x.text) for x in got] == [(i + 1, f"t{i}") for i in range(6)]


def test_versions_fold(spark):
    df = spark.createDataFrame([("s", 1, 1, "create", "a"), ("s", 1, 2, "edit", "b"), ("s", 2, 1, "create", "c"), ("s", 2, 2, "delete", None), ("s", 3, 1, "create", "d"), ("s", 3, 1, "create", "d")], "s string, turn int, v int, op string, text string")
    assert {(x.turn, x.text) for x in C.fold_versions(df, ["s", "turn"], "v", "op").collect()} == {(1, "b"), (3, "d")}


# 5: look-alikes


def test_looks():
    r = lookalike.Rewriter(lookalike.representatives({"fi": 9, "é": 5}))
    same = ["fine café fee", "ﬁne café fee", "ｆｉｎｅ café fee", "finе café f​ee", "fine café fee  "]
    assert {r.look(x) for x in same} == {"fine café fee"}
    assert r.look("Fine cafe fee") != r.look("fine café fee") and r.look("") == "" and r.look("​  ") == ""
    assert r.look("क़") == r.look("क़") and r.look("अा") == r.look("आ")
    assert all(r.look(r.look(x)) == r.look(x) for x in same)


def test_classes_are_transitive():
    c = lookalike.Classes([("a", "b"), ("c", "d"), ("b", "c"), ("x", "y")])
    assert c.find("a") == c.find("d") and c.find("a") != c.find("x")


def test_pairs_against_brute_force(spark):
    r = random.Random(5)
    texts = [r.choice(["pay", "pаy", "pa​y", "Pay", None, " "]) for _ in range(60)]
    data = spark.createDataFrame(list(enumerate(texts)), "dataset_id long, text string")
    chat = spark.createDataFrame([(1, "s", "user", "ok"), (2, "s", "Human", "o​k"), (3, "s", "bot", "ok"), (4, "t", "user", "ok"), (5, None, "user", "ok"), (6, "s", "user", "ok")], "id long, session_id string, role string, text string")
    got = {(x.src, x.a_id, x.b_id) for x in lookalike.found(data, chat).collect()}
    look = lambda t: t.replace("а", "a").replace("​", "")
    want = {("datasets", i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a and b and a.strip() and b.strip() and a != b and look(a) == look(b)}
    assert got == want | {("chat_messages", 1, 2), ("chat_messages", 2, 6)}


def test_classes_count_their_links(spark):
    r = random.Random(9)
    texts = [r.choice(["pay", "p\u0430y", "pa\u200by", "Pay", "other", None, " "]) for _ in range(80)]
    data = spark.createDataFrame(list(enumerate(texts)), "dataset_id long, text string")
    chat = spark.createDataFrame([(1, "s", "user", "ok"), (2, "s", "Human", "o\u200bk"), (3, None, "user", "ok")], "id long, session_id string, role string, text string")
    got = {(x.src, x.id): (x.class_id, x.n_links) for x in lookalike.classed(data, chat).collect()}
    look = lambda t: t.replace("\u0430", "a").replace("\u200b", "")
    shown = {i: t for i, t in enumerate(texts) if t and t.strip()}
    want = {("datasets", i): (min(j for j, u in shown.items() if look(u) == look(t)), sum(look(u) == look(t) and u != t for u in shown.values())) for i, t in shown.items()}
    assert got == want | {("chat_messages", 1): (1, 1), ("chat_messages", 2): (1, 1)}
    links = lookalike.found(data, chat).count()
    assert sum(n for _, n in got.values()) == 2 * links


def test_every_text_has_a_look(spark):
    data = spark.createDataFrame([(1, "p\u0430y"), (2, None)], "dataset_id long, text string")
    chat = spark.createDataFrame([(1, "s", "user", "pay"), (2, None, "user", "p\u0430y"), (3, "s", "?", "p\u200bay"), (4, "s", None, "pay"), (5, None, None, None)], "id long, session_id string, role string, text string")
    got = {(x.src, x.id): x.look for x in lookalike.looks(data, chat).collect()}
    assert got == {("datasets", 1): "pay", ("datasets", 2): None, ("chat_messages", 5): None} | {("chat_messages", i): "pay" for i in (1, 2, 3, 4)}
    assert lookalike.pairs(lookalike.looks(data, chat)).count() == lookalike.found(data, chat).count() == 0


# 7 and 8: tokens and packing


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "ab '", "a1 \n", "कखि ", "!-", "the and in er", " a"])
def test_tree_concatenation_is_exact(alphabet):
    enc, r = tokens.encoder(VOCABULARY), random.Random(alphabet)
    for _ in range(60):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(1, 500)))
        marks = tokens.cuts(text, r.choice([16, 50]))
        edges = [0, *(p for p, _ in marks), len(text)]
        parts = []
        for n, (a, b) in enumerate(zip(edges, edges[1:])):
            ids, head, tail = enc.piece(text[a:b])
            parts.append({"piece": n, "glued": n < len(marks) and marks[n][1], "ids": ids, "head": head, "tail": tail})
        assert tokens.concatenate(enc, parts)["ids"] == enc.plain(text)


def test_encode(spark):
    texts = [None, "", " ", "a b  c\n\nd", "<|endoftext|> 's", "x" * 3000 + " y", "क" * 500, "dup", "dup"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encode(df, piece_chars=256).collect()}
    enc = tokens.encoder(VOCABULARY)
    assert got == {i: enc.plain(t) if t else [] for i, t in enumerate(texts)}
    counts = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, piece_chars=256).collect()}
    assert counts == {i: len(v) for i, v in got.items()}


def test_packing(spark):
    r = random.Random(2)
    sizes = [(i if i % 7 else None, r.choice([0, 1, 5, 60, 99, 100, 101, 250])) for i in range(500)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long")
    w = spark.createDataFrame([("w", 100), ("none", 0)], "window_name string, capacity int")
    rows = packing.pack(df, w, 500, shard_items=100).collect()
    used = {}
    for x in rows:
        used[x.shard, x.container] = used.get((x.shard, x.container), 0) + x.n_tokens
    assert max(used.values()) <= 100 and sum(used.values()) == sum(n for _, n in sizes)
    assert {x.doc_id for x in rows} == {i for i, _ in sizes}
    whole = {i for i, n in sizes if i is not None and n <= 100}
    assert all(x.part == 0 and x.first_token == 0 for x in rows if x.doc_id in whole)
    assert len(used) <= math.ceil(sum(used.values()) / 100) * 1.1 + 5


def test_assign_prefers_the_lowest_cost():
    out = packing.assign(np.array([60, 50, 40, 30, 10]), 100)
    loads = np.bincount(out, weights=[60, 50, 40, 30, 10])
    assert sorted(loads) == [90, 100]  # 40 joins the 50, which costs less than the 60


# 9: truncation


@pytest.mark.parametrize(("text", "evidence"), [
    (None, None), ("", None), (" ​\n", None), ("It is done.", "whole"), ("It is do�", "cut"), ("The sum of Rs.", "cut"), ("He said, \"come", "cut"), ("He said, \"Come.\"", "whole"),
    ("Text.\nTotal claimed: ₹1,20,000", "whole"), ("Text.\n[seal of the office]", "whole"), ("Text.\nGiven under seal at X, 12/03/2020", "whole"), ("Text.\nNOTE ON FEES", "whole"),
    ("Text.\n(c) the register of boats", "whole"), ("Text &am", "cut"), ("Text <di", "cut"), ("within 10 days of 3.", "cut"), ("and he went on", ""),
])
def test_structure(text, evidence):
    found = truncation.judge(text) if text is not None else None
    assert (found and found[1]) == evidence


def test_tails_of_any_length():
    long = "x" * 500
    assert truncation.judge(f"Text. See <{long}")[1] == "cut" and truncation.judge(f"Text.\nSd/-\n{long} {long}")[1] == "whole" and truncation.judge(f"Text.\n{long} No.")[1] == "cut"
    assert truncation.judge("a " * 9 + "end")[3] == "" and truncation.judge(f"Text.\nCopy: {long}")[3] == f"Copy: {long}"


def test_messages_have_languages(spark):
    rows = spark.createDataFrame([(1, "s", 1, "user", "Which papers should I bring for the hearing?"), (2, None, None, None, None), (3, "s", 1, "?", "12")], "id long, session_id string, user_id long, role string, text string")
    assert {r.id: r.lang for r in language.labelled(rows).collect()} == {1: "english", 2: None, 3: None}


def test_truncation_learns_endings(spark):
    docs = [(i, f"The clerk keeps a book of {w} for all. The office is open on every day.", "s", "x") for i, w in enumerate(["maps", "laws", "fees", "boats"])]
    docs += [(10, "The clerk keeps a book. The office is open on every day", "s", "x"), (11, "The clerk keeps a book. The office is open on ev", "s", "x"), (12, None, None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, cut string")
    assert {r.doc_id for r in truncation.found(df).collect()} == {11}


def test_copies_and_chance_repeats_are_no_closings(spark):
    docs = [(i, f"The office holds the {'a' * (i + 1)} book.", "s") for i in range(100)]
    docs += [(200 + i, "The clerk keeps a book.\nThe matter was reg", "s") for i in range(5)]
    docs += [(300 + i, f"The clerk keeps {w}.\nCopy to: the record room", "s") for i, w in enumerate(["maps", "rules", "petitions"])]
    few = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert {r.doc_id for r in truncation.found(few).collect()} == {200, 201, 202, 203, 204}
    more = few.unionAll(spark.range(1000, 11_000).select("id", F.concat(F.lit("The register has the entry of number "), "id", F.lit(".")), F.lit("s")))
    more = more.unionAll(spark.createDataFrame([(400 + i, f"The clerk keeps {w}.\nThe keeper of t", "s") for i, w in enumerate(["maps", "rules", "petitions"])], few.schema))
    assert {r.doc_id for r in truncation.found(more).collect()} >= {200, 201, 202, 203, 204, 400, 401, 402}


# 3: scans


def test_scan_repair():
    words = dict.fromkeys("the clerk shall record petition in register and inform parties until surety remains bound".split(), 100) | {"cross-examination": 50, "demand": 60}
    v = scans.Vocabulary(words, {("remains", "bound"): 9})
    body = ["The clerk shall rec-", "ord the petition in the regisfer.", "The cross-", "examination unfil t2,50,000 the", "parties inform the clerk and the", "surety remains bound until the", "clerk shall record."]
    other = [["petition", "surety", "clerk", "register"][n % 4] + f" shall inform the parties {w} the clerk." for n, w in enumerate(["until", "and", "in", "bound", "record", "shall", "inform", "remains", "the", "surety", "petition", "parties", "register", "clerk"])]
    pages = [body, other[:7], other[7:]]
    text = "\n".join(line for n, p in enumerate(pages) for line in ["Lease deed, schedule B", *p, f"Page {n + 1} of 3"])
    found, repaired = scans.read(text, v, set())
    kinds = {k: {i for kk, _, i in found if kk == k} for k, _, _ in found}
    assert kinds == {"page_no": {"Page 1 of 3", "Page 2 of 3", "Page 3 of 3"}, "header": {"Lease deed, schedule B"}, "hyphen": {"record"}, "misread": {"register", "until", "₹2,50,000"}}
    assert ("hyphen", 2, "record") in found and "cross-examination until ₹2,50,000 the parties" in repaired and "Page" not in repaired


def brute_cost(a, b):
    """The weighted edit cost of the automaton by plain dynamic programming."""
    d = {(0, 0): 0.0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i == j == 0:
                continue
            best = math.inf
            if i:
                best = min(best, d[i - 1, j] + scans.EDIT)
            if j:
                best = min(best, d[i, j - 1] + scans.EDIT)
            if i and j:
                x, y = a[i - 1], b[j - 1]
                best = min(best, d[i - 1, j - 1] + (0 if x == y else scans.CONFUSION if (x, y) in scans.CONFUSIONS else scans.EDIT))
                if i > 1 and (a[i - 2 : i], y) in scans.CONFUSIONS:
                    best = min(best, d[i - 2, j - 1] + scans.CONFUSION)
                if j > 1 and (x, b[j - 2 : j]) in scans.CONFUSIONS:
                    best = min(best, d[i - 1, j - 2] + scans.CONFUSION)
            d[i, j] = best
    return d[len(a), len(b)]


def test_automaton_finds_every_candidate():
    r = random.Random(4)
    words = {"".join(r.choice("mrnclduiwvehb") for _ in range(r.randrange(2, 7))) for _ in range(300)}
    v = scans.Vocabulary(dict.fromkeys(words, 10), {})
    for word in r.sample(sorted(words), 40):
        noisy = word.replace("m", "rn", 1) if r.random() < 0.5 else word.replace("c", "e", 1)
        want = {w for w in words if brute_cost(noisy, w) <= scans.BUDGET + 1e-9}
        assert {w for _, w in v.candidates(noisy)} == want


def test_counts_by_joins_give_the_same(spark):
    """However many counts there are: handed to every task, or met by joins, the results are equal."""
    good = ["The clerk shall record the petition", "in the register and inform the parties", "until the surety remains bound by it", "and the tribunal hears the complaint"]
    texts, r = [], random.Random(8)
    for n in range(60):
        body = [r.choice(good) + ("." if r.random() < 0.3 else "") for _ in range(14)]
        body[r.randrange(14)] = r.choice(["the cIerk shall recond the petifion", "in the neqister and inforrn the par-", "ties of the surefy t2,50,000 and bound", "and the tribunal heans the com- ", "plaint of the co-", "owner until then"])
        texts.append((n, "\n".join(x for i in range(3) for x in ["Lease deed, schedule B", *body[i * 4 : i * 4 + 6], f"- {i + 1} -"])))
    df = spark.createDataFrame([*texts, (90, None), (91, " \n"), (92, texts[0][1]), (92, texts[0][1])], "request_id long, text string")
    for one in (scans.found, scans.repaired):
        a, b = (sorted(map(tuple, one(df, *held).collect()), key=repr) for held in ((), (0,)))
        assert a == b and len(a) > 60


def test_partitioned_tries_find_every_candidate(spark):
    r = random.Random(6)
    words = {"".join(r.choice("mrnclduiwvehb") for _ in range(r.randrange(1, 7))): r.randrange(1, 90) for _ in range(300)}
    asked = {"".join(r.choice("mrnclduiwvehb1") for _ in range(r.randrange(2, 7))): r.randrange(0, 3) for _ in range(60)}
    got: dict = {}
    w = spark.createDataFrame(list(words.items()), "item string, n long")
    for x in scans.candidates(spark.createDataFrame(list(asked.items()), "word string, own long"), w).collect():
        if x.n >= scans.RATIO * max(x.own, 1) and x.c != x.word:
            got.setdefault(x.word, {})[x.c] = round(x.cost, 6)
    for word, own in asked.items():
        want = {c: round(k, 6) for c, n in words.items() if n >= scans.RATIO * max(own, 1) and c != word and (k := brute_cost(word, c)) <= scans.BUDGET + 1e-9}
        assert got.get(word, {}) == want


@pytest.mark.parametrize("times", [1, 10, 100])
def test_readings_are_alike_at_every_size(times):
    counts = {"shall": 8601, "sball": 28, "clerk": 900, "certified": 1201, "ccrtified": 12, "old": 130, "aid": 1926, "copy": 700}
    v = scans.Vocabulary({w: n * times for w, n in counts.items()}, {})
    found, repaired = scans.read("the clerk sball keep a ccrtified copy of the old deed and the copy sb-\nall remain", v, set())
    assert sorted(found) == [("hyphen", 1, "shall"), ("misread", 1, "certified"), ("misread", 1, "shall")]
    assert repaired == "the clerk shall keep a certified copy of the old deed and the copy shall remain"


def test_page_numbers_are_not_readings():
    lines = ["text"] * 9 + ["Meter readings", "366", "383", "397"] + ["text"] * 9
    assert not any(ok for ok in scans.page_marks(lines).values())
    marked = [x for n in "56789" for x in [*["text"] * 10, n]]
    assert sum(scans.page_marks(marked).values()) == 5


# 2: language


@pytest.mark.parametrize(("text", "lang", "whole"), [
    ("Which papers should I bring for the hearing?", "english", ["english"]), ("padosi ne mere do patron ka uttar nahin diya", "hindi", ["hindi"]), ("nereyavaru nanna patragalige uttarisilla, naanu enu maadabeku", "kannada", ["kannada"]),
    ("पड़ोसी ने मेरे दो पत्रों का उत्तर नहीं दिया।", "hindi", ["hindi"]), ("ನೆರೆಯವರು ನನ್ನ ಪತ್ರಗಳಿಗೆ ಉತ್ತರಿಸಿಲ್ಲ.", "kannada", ["kannada"]), ("PDF में दी गई रसीद काफ़ी है क्या?", "hindi", ["hindi"]),
    ("dhara ka matlab aasan shabdon mein samjhaiye Which papers should I bring for the hearing?", "hindi", ["english", "hindi"]), ("12345 67", None, []), ("", None, []), (" ​", None, []),
])
def test_languages(text, lang, whole):
    found = language.languages(text)
    assert (found[0], found[2]) == (lang, whole) and 0 <= found[1] <= 1


def test_labels(spark):
    df = spark.createDataFrame([("EN ",), ("हिन्दी",), ("kan",), ("auto",), (None,), ("",)], "x string")
    assert [r.y for r in df.select(language.clean_label(F.col("x")).alias("y")).collect()] == ["english", "hindi", "kannada", None, None, None]


def test_wrong_labels(spark):
    en, hi = "Which papers should I bring for the hearing?", "padosi ne mere do patron ka uttar nahin diya"
    rows = [("a", 1, 5, "user", en, 1.0), ("a", 2, 5, "Human", en, 2.0), ("a", 3, 5, "user", hi, 3.0), ("b", 4, 6, "user", hi, 1.0), ("b", 5, 6, "user", en, 2.0), ("c", 6, 7, "bot", f"{en} {hi}", 1.0)]
    users = spark.createDataFrame([(5, "hindi"), (6, None), (7, "en")], "id long, language string")
    conv = spark.createDataFrame([("a", "english"), ("b", "kn"), ("d", "en")], "id string, language string")
    got = {tuple(r) for r in language.found(users, conv, log(spark, *rows)).collect()}
    assert got == {("users", "5", "english"), ("chat_messages", "6", "english"), ("chat_messages", "6", "hindi")}


# 1: personal data


def accuracy(field, rows):
    """Recall and precision of the items of labelled rows."""
    pii._known.clear()
    right, found, wanted = 0, 0, 0
    for parts in rows:
        text = "".join(t for t, _ in parts)
        gold = {(k, pii.value(k, t)) for t, k in parts if k}
        got = {(k, v) for k, v, _, _ in pii.find(field, [text], False)[0][1]}
        right, found, wanted = right + len(gold & got), found + len(got), wanted + len(gold)
    pii._known.clear()
    return right / wanted, right / found


def test_held_out_accuracy():
    recall, precision = accuracy(pii.train(), labelled_table(2, seed=1234))
    assert precision > 0.97 and recall > 0.96


def test_held_out_forms():
    """A field that never saw a sentence form finds the items of its sentences."""
    kept, other = held_out()
    assert not set(kept) & set(other) and len(other) > 40
    recall, precision = accuracy(pii.train(labelled_table(of=kept)), labelled_table(3, seed=99, of=other))
    assert recall >= 0.9 and precision >= 0.9


def test_viterbi_against_brute_force():
    from itertools import product

    field = pii.train()
    words = ["Regards", ",", "Ravi", "K."]
    emit = np.zeros((len(words), len(pii.TAGS)))
    for p, w in enumerate(words):
        for o, by in enumerate(pii.NEAR):
            if 0 <= p - by < len(words):
                emit[p - by] += field.scores(w)[o]
    score = lambda t: field.first[t[0]] + sum(emit[i, k] for i, k in enumerate(t)) + sum(field.between[a, b] for a, b in zip(t, t[1:]))
    best = max(product(range(len(pii.TAGS)), repeat=len(words)), key=score)
    assert tuple(field.decode([words])[0]) == best


def test_values():
    assert pii.value("email", "<A_B at mail dot orchard dot test>") == "a_b@mail.orchard.test" and pii.value("email", "at home") is None
    assert pii.value("phone", "(+91) 98765.43210") == "9876543210" and pii.value("phone", "1800 123 4567") is None
    assert pii.value("phone", "nine eight seven six five four three two one zero") == "9876543210" and pii.value("phone", "೯೮೭೬೫೪೩೨೧೦") == "9876543210"
    assert pii.value("id_number", "abcde-1234-f") == "ABCDE1234F" and pii.value("id_number", "1234") is None
    assert pii.value("name", "Shri  Ravi\nKumar ") == "ravi kumar"


def test_redaction(spark):
    chat = spark.createDataFrame([(1, "My name is Ravinath Kumarpatil and you can reach me on 98765 43210."), (2, None), (3, " "), (4, "The meter number 9876543210 on the bill is wrong, who corrects it?")], "id long, text string")
    req = spark.createDataFrame([], "request_id long, text string")
    got = {r.row_id: r.text for r in pii.redacted(chat, req).collect()}
    assert got == {1: "My name is [NAME] and you can reach me on [PHONE].", 2: None, 3: " ", 4: "The meter number 9876543210 on the bill is wrong, who corrects it?"}


def test_redaction_changes_nothing_else(spark):
    own = "The p\u0430ge is \u00bd done. ｍｙ ｎａｍｅ ｉｓ Ravinath Kumar\u200bpatil, call me on ９８７６５ 43210 to\u00ad\u00admorrow e\u0301."
    chat = spark.createDataFrame([(1, own)], "id long, text string")
    req = spark.createDataFrame([(2, "Some words be-\nfore it stand here. Please call me on 98765\n43210 and noth-\ning else.")], "request_id long, text string")
    got = {r.row_id: r.text for r in pii.redacted(chat, req).collect()}
    assert got[1] == own.replace("Ravinath Kumar\u200bpatil", "[NAME]").replace("９８７６５ 43210", "[PHONE]")
    assert got[2] == "Some words be-\nfore it stand here. Please call me on [PHONE] and noth-\ning else."


def test_labelled_forms_are_not_of_the_tables():
    """No form's literal part of five words or more occurs in the texts that the queries read."""
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("needs the test tables")
    texts = [t for n in ("chat_messages", "analyze_text_requests") for t in pq.read_table(f"{d}/{n}.parquet", columns=["text"])["text"].to_pylist() if t]
    seen = " \n ".join(" ".join(t.split()) for t in texts)
    parts = {" ".join("".join(x for x, k in [p] if not k).split()) for row in labelled_table(4)[:] for p in row if not p[1]}
    long = [p for p in parts if len(p.split()) >= 5]
    assert len(long) > 200 and not [p for p in long if p in seen]
