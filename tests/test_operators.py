import json

import pytest
from pyspark.sql import functions as F

from granthika.functions import text as T
from granthika.operators import chunks, index, nested, store


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("raw", "part"), [("t2,50,000/-", "₹2,50,000"), ("15 / 06 / 2022", "15/06/2022"), ("12 % p . a .", "12% p.a."), ("10, 20", "10,20"), ("Rs . 2, 50, 000", "Rs. 2,50,000")])
def test_scanned_numbers(spark, raw, part):
    assert part in one(spark, raw, T.clean)


def test_clean_spacing(spark):
    assert one(spark, " a \t b \r\n\r\n\r\n\r\nc , d ", lambda c: T.clean(c, scanned=False)) == "a b\n\nc, d"
    assert one(spark, None, T.clean) == ""


def test_intents(spark):
    assert one(spark, "What is the definition of theft?", T.intent) == "definition"
    assert one(spark, "please DEFINE it", T.intent) == "punishment"  # the word holds "fine"
    assert one(spark, None, T.intent) == "general"


def test_sections_repeat_their_heading():
    text = "preamble\n101. Murder.—\n" + "Whoever does it. " * 30 + "\n102. Punishment.—\nshort"
    out = chunks.split_text(text, 300, 60)
    assert out[0] == ("", "", "preamble") and out[-1] == ("102", "Punishment.—", "102. Punishment.—\n\nshort")
    assert all(c.startswith("101. Murder.—\n\n") and len(c) <= 300 for n, _, c in out if n == "101")


def test_cut_body_covers_and_progresses():
    body = "abcdefghij" * 100
    pieces = chunks.cut_body(body, 100, 20)
    assert pieces[0] == body[:100] and pieces[-1].endswith(body[-10:]) and all(len(p) <= 100 for p in pieces)
    with pytest.raises(ValueError):
        chunks.split_text("x", 10, 10)


def test_bm25_against_brute_force(spark):
    import math

    docs = spark.createDataFrame([(1, "red ferry red"), (2, "blue ferry"), (3, None), (4, "red")], "id long, text string")
    got = {r.doc_id: r.score for r in index.bm25(spark.createDataFrame([(9, "red red sea")], "qid long, question string"), docs, "id", "text", 5).collect()}
    avg = 6 / 4
    want = {}
    for i, tf, dl in ((1, 2, 3), (4, 1, 1)):
        idf = math.log(1 + (4 - 2 + 0.5) / 2.5)
        want[i] = round(2 * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg)), 6)
    assert got == want


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, t string")
    new = spark.createDataFrame([("a", 1, "z"), ("c", 0, "w")], "k string, v int, t string")
    both = store.upsert(old, new, "k", "v")
    assert {tuple(r) for r in both.collect()} == {("a", 1, "z"), ("b", 1, "y"), ("c", 0, "w")}
    assert {r.k for r in store.delete(both, new, "k").collect()} == {"b"}
    assert store.upsert(both, new, "k", "v").exceptAll(both).count() == 0


def paths(value):
    return [(p, above) for p, above, *_ in nested.walk(nested.read_json(value) if isinstance(value, str) else value)]


def test_nested_paths():
    v = json.dumps({"plan": {"entities": [{"a": 1}, {}]}, "x": [[{"b": None}]]})
    want = [("$", ""), ("$.plan", "$"), ("$.plan.entities[0]", "$.plan"), ("$.plan.entities[1]", "$.plan"), ("$.x[0][0]", "$")]
    assert paths(v) == want
    assert paths(json.dumps(v)) == want and paths(json.dumps(json.dumps(v))) == want
    assert paths('[{"a": 1}]') == [("$[0]", "")]
    assert paths("[" * 100 + "{}" + "]" * 100) == [("$" + "[0]" * 100, "")]


@pytest.mark.parametrize("bad", [None, "", "  ", "null", "3", '"x"', '{"a": ', "[{", "NaN", "not json"])
def test_unreadable_gives_nothing(bad):
    assert paths(bad) == []


def test_shapes_are_bottom_up_states():
    shapes = {n[3] for n in nested.walk({"a": [{"b": 1}, {"b": "x"}]})}
    assert shapes == {"{a:[{b:number}|{b:string}]}", "{b:number}", "{b:string}"}


def test_nested_tables(spark):
    df = spark.createDataFrame([(1, '[{"act": "A", "page": 3}, {"act": "B", "page": "x", "more": {"z": 1}}]', "q"), (2, None, "q"), (1, '{"act": "A"}', "q"), (3, "{}", "q")], "id long, j string, path string")
    nodes = nested.json_objects(df, "t", "id", "j")
    assert nodes.count() == 5
    table = nested.subtype_table(nodes, "$[]", {"act": "string", "page": "int"})
    assert sorted((r.path, r.act, r.page) for r in table.collect()) == [("$[0]", "A", 3), ("$[1]", "B", None)]
    common = {r.kind: r.common_keys for r in nested.shapes(nodes).collect()}
    assert common["$[]"] == "act,page"
    assert nested.json_objects(df.limit(0), "t", "id", "j").count() == 0


def test_every_scalar_reaches_a_typed_table(spark):
    one = '{"act": "A", "page": 3, "ok": true, "excerpts": [{"lines": [4, 7], "tags": [["x"], null]}]}'
    df = spark.createDataFrame([(1, one), (2, f'[{one}, {{"act": "B", "page": "x"}}]')], "id long, j string")
    nodes = nested.json_objects(df, "t", "id", "j")
    cited = nested.subtype_table(nodes, ["$", "$[]"])
    assert dict(cited.dtypes) | {"act": "string", "page": "string", "ok": "boolean"} == dict(cited.dtypes) and "excerpts" not in cited.columns
    assert sorted((r.row_id, r.path, r.act, r.page, r.ok) for r in cited.collect()) == [(1, "$", "A", "3", True), (2, "$[0]", "A", "3", True), (2, "$[1]", "B", "x", None)]
    shape = cited.where("path = '$[1]'").first().shape_id
    assert [r.path for r in nested.subtype_table(nodes, "$[]", shape_id=shape).collect()] == ["$[1]"]
    values = nested.array_values(nested.json_scalars(df, "t", "id", "j")).where("row_id = 1").collect()
    at = "$.excerpts[0]"
    assert sorted((r.path, r.parent_path, r["index"], r.type, r.value) for r in values) == [(f"{at}.lines", at, 0, "number", "4"), (f"{at}.lines", at, 1, "number", "7"), (f"{at}.tags", at, 1, "null", None), (f"{at}.tags[0]", at, 0, "string", "x")]


def test_lone_citation_and_every_kind_have_a_table(spark, tmp_path):
    from granthika.plans import core

    deep = "[" * 9 + '{"z": 1}' + "]" * 9
    spark.createDataFrame([(1, '{"act_name": "A", "page": 2, "note": "n"}'), (2, '[{"act_name": "B"}]')], "id long, sources_json string").write.parquet(str(tmp_path / "chat_messages.parquet"))
    spark.createDataFrame([(7, f'{{"facts": {{"amounts": [{{"value": "5", "page": 1}}]}}, "deep": {deep}, "odd": {{"k": 1.5}}}}')], "id long, data_json string").write.parquet(str(tmp_path / "case_history.parquet"))
    q = {n: f for n, f in core.queries().items() if n.startswith("p6_")}
    assert sorted((r.path, r.act_name, r.page, r.note) for r in q["p6_citations"](spark, str(tmp_path)).collect()) == [("$", "A", 2, "n"), ("$[0]", "B", None, None)]
    assert [(r.path, r.parent_path, r.value, r.page) for r in q["p6_amounts"](spark, str(tmp_path)).collect()] == [("$.facts.amounts[0]", "$.facts", "5", 1.0)]
    assert [(r.path, r.as_number) for r in q["p6_fields"](spark, str(tmp_path)).where("key = 'k'").collect()] == [("$.odd", 1.5)]
    assert {r.kind: r.common_keys for r in q["p6_shapes"](spark, str(tmp_path)).collect()}["$"] in ("act_name,note,page", "deep,facts,odd")


def test_new_sections_tests_every_row(spark, tmp_path):
    from granthika.plans import documents

    rows = [(2, "A", "One  rule."), (3, "A", "one rule."), (4, "A", "Two."), (5, "B", "One rule."), (7, "B", "Three."), (9, "B", "three."), (6, None, None), (8, None, "")]
    spark.createDataFrame(rows, "dataset_id long, act_name string, text string").write.parquet(str(tmp_path / "datasets.parquet"))
    assert sorted(r.dataset_id for r in documents.queries()["new_sections"](spark, str(tmp_path)).collect()) == [2, 4, 5, 6, 7]


def rebuilt(objects, fields, values):
    """The JSON value of one row from the three tables."""
    import re as _re

    root = {}
    put = {}

    def steps(path):
        return [int(x[1:-1]) if x[0] == "[" else x[1:] for x in _re.findall(r"\.[^.\[]+|\[\d+\]", path)]

    def at(path, make):
        node, key = root, "$"
        for step in steps(path):
            node.setdefault(key, {})
            node, key = node[key], step
        node.setdefault(key, make)
        return node[key]

    for path in sorted(objects, key=lambda p: len(steps(p))):
        put[path] = at(path, {})
    for path, key, value in fields:
        at(path, {})[key] = value
    for path, index, value in values:
        at(path, {})[index] = value

    def lists(x):
        if isinstance(x, dict):
            if x and all(isinstance(k, int) for k in x):
                return [lists(x[i]) for i in range(len(x))]
            return {k: lists(v) for k, v in x.items()}
        return x

    return lists(root["$"])


def test_records_are_rebuilt_from_the_tables(spark):
    docs = [
        {"a": {"b": [{"c": 1}, {"c": None, "d": [True, "x", 2.5]}], "e": {}}, "f": [[1, 2], [3]], "g": "text"},
        [{"act": "A", "related": [{"r": {"s": ["t"]}}]}, {"act": "B"}],
        {"k:1,{x}|y": {"z": 1}, "deep": {"c1": {"c2": {"c3": {"c4": {"c5": {"c6": {"c7": {"c8": {"n": 1}}}}}}}}}},
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id long, j string")
    nodes, scalars = nested.json_objects(df, "t", "id", "j"), nested.json_scalars(df, "t", "id", "j")
    read = lambda r: None if r.type == "null" else r.value if r.type == "string" else json.loads(r.value)
    for i, d in enumerate(docs[:2]):
        objects = [r.path for r in nested.found(nodes).where(f"row_id = {i}").collect()]
        fields = [(r.path, r.key, read(r)) for r in scalars.where(f"row_id = {i} and key is not null").collect()]
        values = [(r.path, r["index"], read(r)) for r in nested.array_values(scalars).where(f"row_id = {i}").collect()]
        assert rebuilt(objects, fields, values) == d
    keys = {k for (shape,) in nodes.where("row_id = 2").select("shape").collect() for k, _ in nested.shape_states(shape)}
    assert keys == {"k:1,{x}|y", "z", "deep", *(f"c{i}" for i in range(1, 9)), "n"}


def slow_windows(body, size, overlap):
    """What ING-06 says, character by character."""
    out, start = [], 0
    while start < len(body):
        end = min(start + size, len(body))
        if end < len(body):
            stops = [i for i in range(max(start, end - 200), end) for s in chunks.STOPS if body[i : i + len(s)] == s and i + len(s) <= end]
            if stops and max(stops) > start:
                end = max(stops) + 1
        if body[start:end].strip():
            out.append(body[start:end].strip())
        if end == len(body):
            break
        start = max(end - overlap, start + 1) if end - overlap > start else end
    return out


def test_windows_against_brute_force():
    import random

    r = random.Random(1)
    for _ in range(300):
        body = "".join(r.choice(["word", " ", ". ", "; ", ": ", "\n", "।", ".", "x" * 40]) for _ in range(r.randrange(0, 120)))
        size = r.randrange(5, 400)
        overlap = r.randrange(0, size)
        assert chunks.cut_body(body, size, overlap) == slow_windows(body, size, overlap)


def test_paragraphs_carry_their_overlap():
    assert chunks.pack_paragraphs("aa\n \nbb\n\n\ncc", 6, 2) == ["aa\n\nbb", "bb\n\ncc"]
    assert chunks.pack_paragraphs("a" * 12 + "\n\nb", 6, 2) == ["aaaaaa", "aaaaaa", "aaaa", "b"] or len(chunks.pack_paragraphs("a" * 12 + "\n\nb", 6, 2)) >= 3
    assert chunks.pack_paragraphs(" \n\n ", 6, 2) == [] and chunks.pack_paragraphs("", 6, 2) == []


@pytest.mark.parametrize(("text", "want"), [
    ("t 2,50,000 and z1,000 at 3,4", "₹2,50,000 and ₹1,000 at 3,4"), ("t2500", "₹2500"), ("bt2,500", "bt2,500"), ("Rs , 50", "Rs. 50"), ("INR: 50", "INR 50"), ("₹  5", "₹5"), ("1 , 23 , 456", "1,23,456"),
    ("3 - 4 - 2020", "3-4-2020"), ("3 . 4 . 20", "3.4.20"), ("12 % per annum", "12% p.a."), ("12 %", "12%"), ("5 / - only", "5/- only"), ("1 / 2", "1 / 2"),
])
def test_number_rules(spark, text, want):
    assert one(spark, text, T.fix_scanned_numbers) == want


def test_nearest_by_blocks_is_the_same(spark):
    import random

    from granthika.operators import vectors

    r = random.Random(3)
    v = spark.createDataFrame([(i, [float(r.randrange(3)) for _ in range(4)]) for i in range(300)] + [(900, None)], "id long, v array<float>")
    q = v.where("id % 50 = 0")
    a, b = (sorted(map(tuple, vectors.nearest(v, q, "id", "v", 5, held).collect())) for held in (10_000, 0))
    assert a == b and len(a) == 30
    data = {x.id: x.v for x in v.where("v is not null").collect()}
    want = {i: sorted((round(sum((s - t) ** 2 for s, t in zip(data[i], w)), 6), j) for j, w in data.items())[:5] for i in (0, 50, 100, 150, 200, 250)}
    assert {i: [(x[2], x[1]) for x in sorted(a, key=lambda x: x[3]) if x[0] == i] for i in want} == want
    assert vectors.nearest(v, v.where("false"), "id", "v", 5).count() == 0


def test_names_are_held_by_texts(spark):
    from granthika.operators import names

    rows = spark.createDataFrame([(1, "the rent act and the rent"), (2, None), (3, "nothing")], "id long, t string")
    known = spark.createDataFrame([(7, "rent"), (8, "rent act"), (9, ""), (10, None), (11, "rent")], "n long, name string")
    assert {r.id: r.held for r in names.holding(rows, ["t"], known, "n", "name").collect()} == {1: [7, 8, 11], 2: [], 3: []}
    assert [r.held for r in names.holding(rows, ["t"], known.limit(0), "n", "name").collect()] == [[], [], []]
    try:
        names.MOST_NAMES, before = 2, names.MOST_NAMES
        with pytest.raises(ValueError):
            names.holding(rows, ["t"], known, "n", "name")
    finally:
        names.MOST_NAMES = before


NOTICE = "LEGAL NOTICE dated 15/06/2022.\nMy client advanced a loan of Rs. 2,50,000/- on 10 May 2021 at 12% p.a. for his shop.\nAn outstanding sum of ₹1,87,560 is due. You are called upon to pay within 15 days from receipt, failing which Case No. 12/2023 follows under Section 138."


def test_facts_of_a_notice(spark):
    from granthika.operators import facts

    df = spark.createDataFrame([(1, NOTICE), (2, None), (3, "")], "id long, t string")
    got = [(r.value, r.start, r.type, r.confidence) for r in facts.amounts(df, "id", "t").orderBy("place").collect()]
    assert [(v, k, c) for v, _, k, c in got] == [("Rs. 2,50,000/-", "loan_amount", "high"), ("₹1,87,560", "outstanding_amount", "high"), ("2,50,000/-", "loan_amount", "medium")] and all(NOTICE[s:].startswith(v) for v, s, _, _ in got)
    assert [(r.value, r.type) for r in facts.dates(df, "id", "t").orderBy("place").collect()] == [("15/06/2022", "document_date"), ("10 May 2021", "document_date")]
    kinds = {(r.kind, r.value) for r in facts.facts(df, "id", "t").collect()}
    assert {("interest_rate", "12% p.a"), ("notice_deadline", "within 15 days from receipt"), ("case_number", "Case No. 12/2023"), ("statutory_reference", "Section 138")} <= kinds
    assert facts.evidence_lines(df, "id", "t").count() == 2
    assert [(r.date, r.event[:9]) for r in facts.timeline(spark.createDataFrame([(1, "12/03/2020: the deed was signed. Short 1/1/20.")], "id long, t string"), "id", "t").collect()] == [("12/03/2020", "the deed ")]


def test_conflicts_and_contradictions(spark):
    from granthika.operators import facts

    rows = [(1, "c", "Pay ₹2,50,000 by 15/06/2022 within 15 days at 18% interest, or arbitration."), (2, "c", "Pay ₹3,50,000 by 20/08/2022 within 30 days at 12% interest, or a civil court."), (3, "d", "Pay ₹5,000."), (4, None, "Pay ₹6,000.")]
    df = spark.createDataFrame(rows, "id long, k string, t string")
    assert {(r.kind, r.first_doc, r.doc_id) for r in facts.conflicts(df, "id", "t", ["k"]).collect()} == {(k, 1, 2) for k in ("amount_conflict", "date_conflict", "deadline_conflict", "interest_rate_conflict")}
    assert {(r.k, r.kind, r.first_sum, r.second_sum) for r in facts.contradictions(df, "id", "t", ["k"]).collect()} == {("c", "amount_conflict", 250000.0, 350000.0), ("c", "forum_conflict", None, None)}


def test_files(spark, tmp_path):
    from granthika.sources import files

    made = {"Acts/Rent_Act/rent_1999.pdf": b"%PDF-1.4" + b"x" * 20, "Acts/page.pdf": b"<!DOCTYPE html><html>404</html>", "n.txt": "ನಮಸ್ಕಾರ and more text".encode(), "bad.txt": b"\xff\xfe\x00" * 9, "p.png": b"\x89PNG\r\n\x1a\n" + b"0" * 20, "w.webp": b"RIFF1234WEBPVP8 0000", "s.pdf": b"%PDF"}
    for name, content in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r.name: (r.is_valid, r.file_type) for r in files.checked(files.contents(spark, str(tmp_path))).collect()}
    assert got == {"rent_1999.pdf": (True, "pdf"), "page.pdf": (False, "html_error"), "n.txt": (True, "txt"), "bad.txt": (False, "unsupported"), "p.png": (True, "png"), "w.webp": (True, "webp"), "s.pdf": (False, "unknown")}
    assert {r.name for r in files.discover(spark, str(tmp_path)).collect()} == {"rent_1999.pdf", "page.pdf", "s.pdf"}
    paths = spark.createDataFrame([("Acts/Rent_Act/rent_1999.pdf",), ("x.pdf",)], "p string")
    assert [tuple(r) for r in paths.select(*files.path_facts(F.col("p"))).collect()] == [("acts", "Rent Act", 1999), ("general", "", None)]
    assert {r.text for r in files.texts(spark, str(tmp_path / "n.txt")).collect()} == {"ನಮಸ್ಕಾರ and more text"}
    assert {r.doc_type for r in files.intake(files.contents(spark, str(tmp_path), "*.p*")).collect()} == {"pdf", "image"}


def test_file_names_and_pages(spark):
    from granthika.sources import files

    assert one(spark, "../../dangerous/path/Legal_Notice (1).pdf", files.sanitised_name) == "Legal_Notice__1_.pdf" and one(spark, "", files.sanitised_name) == "uploaded_document"
    assert one(spark, "a b.PDF", lambda c: files.saved_name(c, F.lit("t"))).startswith("a_b_") and one(spark, "a b.PDF", lambda c: files.saved_name(c, F.lit("t"))).endswith(".pdf")
    pages = spark.createDataFrame([("d", 2, "two "), ("d", 1, "one"), ("d", 3, " "), ("e", 1, None)], "d string, p int, t string")
    assert [tuple(r) for r in files.joined_pages(pages, "d", "p", "t").collect()] == [("d", "--- Page 1 ---\none\n\n--- Page 2 ---\ntwo")]


def test_answers_are_sanitised(spark):
    from granthika.functions import answers

    raw = "<think>why\nso</think>```markdown\nVerified answer: So the answer is: pay it.\n|---|---|\nDone.\n```"
    assert one(spark, raw, answers.plain_answer) == "pay it.\n|---|---|\nDone." and one(spark, raw, lambda c: answers.table_rules(answers.plain_answer(c))) == "pay it.\nDone."
    assert one(spark, None, answers.plain_answer) == ""


def test_checkpoints_need_a_shared_folder(spark, monkeypatch):
    from granthika.sources import tables

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError):
        tables.checkpoint_dir(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs:///shared"
    assert tables.checkpoint_dir(Session()) == "hdfs:///shared"


def test_records_and_refusals_cover_every_document(spark):
    rows = [(1, "101. Murder. -\nWhoever does it. " * 3, "A", 1999, "s"), (2, None, "A", 1999, "s"), (3, "  ", "A", 1999, "s"), (4, "text", None, 1999, "s"), (5, "text", "A", None, ""), (6, "Some  text.", "A", None, "s"), (7, "some text.", "A", None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, act_name string, act_year int, source string")
    refused = {r.doc_id: r.reason for r in store.refused(docs).collect()}
    assert refused == {2: "no text", 3: "blank text", 4: "no act", 5: "no source"}
    kept = store.records(docs).collect()
    assert {r.doc_id for r in kept} == {1, 6} and {r.copies for r in kept if r.doc_id == 6} == {2} and {r.document_id for r in kept} == {"A_1999", "A"}


def test_heading(spark):
    got = [one(spark, t, lambda c: F.concat_ws("|", *chunks.heading(c))) for t in ("x\nSection 12A. Theft\nmore", "Section 7\n\nTitle here", "5 - Fees", "nothing", None)]
    assert got == ["12A|Theft", "7|Title here", "5|Fees", "|", "|"]


def written(spark, run):
    """The rows that the shuffles of a run write."""
    sc = spark.sparkContext
    empty = sc._gateway.new_array(sc._jvm.double, 0)

    def rows():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, empty, sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = rows()
    run()
    return rows() - before


def bm25_by_sql(questions, docs, k):
    """The ranking of the queries' SQL, for any rows of (qid, question) and (doc_id, text)."""
    import duckdb
    import pandas as pd

    from granthika.plans import retrieval

    documents = pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    asked = pd.DataFrame(questions, columns=["qid", "question"])  # noqa: F841
    sql = retrieval._bm25_of(f"SELECT qid, unnest({retrieval._TOKENS.format('question')}) AS token FROM asked").replace("rank <= 30", f"rank <= {k}")
    return sorted(duckdb.sql(sql + "SELECT qid, doc_id, score, rank FROM bm").fetchall())


def test_questions_with_equal_words_are_scored_once(spark):
    docs = [(i, f"red ferry w{i % 7} " + "sea " * (i % 5)) for i in range(600)]
    questions = [(q, ("Red sea", "sea, RED!", "ferry w3 w3")[q % 3]) for q in range(300)]
    d, q = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(questions, "qid long, question string")
    got = []
    n = written(spark, lambda: got.extend(map(tuple, index.bm25(q, d, "id", "text", 5).collect())))
    assert sorted(got) == bm25_by_sql(questions, docs, 5) and len(got) == 1500
    assert n < 10_000  # not 300 x 600 scores


def test_bm25_of_repeated_and_missing_ids(spark):
    docs = [(1, "red ferry red"), (1, "red sea"), (2, "blue ferry"), (None, "red"), (None, "blue"), (3, None), (4, ""), (5, "red"), (6, "red")]
    questions = [(1, "red red ferry"), (2, "blue"), (2, "sea"), (3, "nothing"), (4, None), (5, "ಕನ್ನಡ")]
    d, q = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(questions, "qid long, question string")
    assert sorted(map(tuple, index.bm25(q, d, "id", "text", 3).collect())) == bm25_by_sql(questions, docs, 3)
    assert index.bm25(q, d.where("false"), "id", "text", 3).count() == 0 == index.bm25(q.where("false"), d, "id", "text", 3).count()


def test_more_questions_than_a_pass_takes(spark):
    d = spark.createDataFrame([(i, f"a{i % 3} b{i % 4} c{i % 5}") for i in range(100)], "id long, text string")
    q = index.asked(spark.createDataFrame([(i, f"a{i % 4} c{i % 7} b1") for i in range(30)], "qid long, question string"))
    one, many = (sorted(map(tuple, index.best(q, d, "id", "text", 4, most).collect())) for most in (1000, 7))
    assert one == many and len({r[0] for r in one}) == 28
