"""Expected values of the domain rules, on literal inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import jsonx, number, text, udf
from tallyforge.operators import core, fuzzy
from tallyforge.plans import ingest, learning
from tallyforge.sources import documents, model_calls, scheduling
from tallyforge.streaming import attempts

NOW = dt.datetime(2024, 5, 1, 12)


def value(spark, column, data=None, schema=None):
    df = spark.createDataFrame(data or [(0,)], schema or "x int")
    return [r[0] for r in df.select(column).collect()]


def column(spark, f, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r["v"] for r in df.select("k", f(F.col("t")).alias("v")).orderBy("k").collect()]


@pytest.mark.parametrize(
    "count,daily,chapter,mistake",
    [(1, (1, 0, 0), (1, 0, 0), (0, 1, 0)), (3, (2, 0, 1), (3, 0, 0), (0, 3, 0)), (4, (2, 1, 1), (3, 0, 1), (0, 3, 1)), (6, (3, 1, 2), (5, 0, 1), (0, 5, 1)), (8, (4, 2, 2), (6, 0, 2), (0, 6, 2)), (10, (4, 3, 3), (7, 1, 2), (1, 7, 2)), (12, (5, 3, 4), (9, 1, 2), (1, 9, 2)), (15, (7, 4, 4), (11, 1, 3), (1, 11, 3))],
)
def test_mode_budgets(count, daily, chapter, mistake):
    for mode, want in (("daily_mixed", daily), ("chapter_focus", chapter), ("mistake_focus", mistake)):
        got = number.mode_budgets(count, mode)
        assert (got["progress"], got["mistake_variant"], got["spaced_review"]) == want


def test_custom_budgets():
    assert number.custom_budgets(8, {"new_knowledge": 25, "mistake_variant": 50, "spaced_review": 25, "feynman_check": 0}) == {"new_knowledge": 2, "mistake_variant": 4, "spaced_review": 2}
    assert number.custom_budgets(8, {"new_knowledge": 0}) is None


def planner(spark, due=(), mistakes=(), bank=range(1, 9), unlocked=range(1, 9), budgets=None, count=8, scores=()):
    points = spark.createDataFrame([(k, "s", f"2.{1 + (k > 4)}") for k in range(1, 9)], "kp_id int, subject_id string, chapter_no string")
    questions = spark.createDataFrame([(q, q, [q], 2 if q <= 4 else 1) for q in bank] or [(99, 99, [99], 1)], "question_id int, primary_kp int, kp_ids array<int>, difficulty int")
    students = spark.createDataFrame([(1, "s")], "student_id int, subject_id string")
    open_rows = spark.createDataFrame([(1, q, n, "open") for q, n in mistakes], "student_id int, question_id int, error_count int, status string")
    reviews = spark.createDataFrame([(1, k, NOW - dt.timedelta(days=n)) for k, n in due], "student_id int, kp_id int, next_review_at timestamp")
    mastery = spark.createDataFrame([(1, k, s) for k, s in scores], "student_id int, kp_id int, mastery_score double")
    allowed = learning.allowed_points(students, spark.createDataFrame([(1, k) for k in unlocked], "student_id int, kp_id int"), points)
    all_questions = spark.createDataFrame([(q, q) for q in range(1, 9)], "question_id int, primary_kp int")
    pools = learning.candidates(allowed, mastery, open_rows, reviews, all_questions, F.lit(NOW))
    slots = learning.plan_slots(pools, budgets or learning.budgets(count), count)
    return learning.choose_questions(slots, mastery, questions, allowed).orderBy("slot").collect()


def test_planner_mixes_pools(spark):
    got = planner(spark, due=[(1, 2), (2, 1)], mistakes=[(3, 1), (4, 2)])
    assert [r["pool"] for r in got] == ["spaced_review"] * 2 + ["mistake_variant"] * 2 + ["new_knowledge"] * 4
    assert all(r["source"] == "question_bank" for r in got) and len({r["kp_id"] for r in got}) == 8


def test_planner_custom_weights(spark):
    budgets = number.custom_budgets(8, {"new_knowledge": 25, "mistake_variant": 50, "spaced_review": 25})
    got = planner(spark, due=[(1, 1), (2, 1)], mistakes=[(3, 1), (4, 1), (5, 1), (6, 1)], budgets=budgets)
    assert [r["pool"] for r in got].count("mistake_variant") == 4


def test_planner_keeps_review_first(spark):
    got = planner(spark, due=[(1, 3)], mistakes=[(1, 2)], unlocked=[1], count=4)
    assert [(r["pool"], r["secondary"]) for r in got] == [("spaced_review", ["mistake_variant", "new_knowledge"])]


def test_planner_scope_and_empty_bank(spark):
    assert [r["kp_id"] for r in planner(spark, unlocked=[1])] == [1]
    assert {r["source"] for r in planner(spark, bank=[])} == {"ai_generated"}
    assert planner(spark, unlocked=[]) == []


def test_planner_takes_one_check(spark):
    got = planner(spark, scores=[(k, 0.6) for k in range(1, 9)])
    assert [r["pool"] for r in got] == ["feynman_check"]


def test_progress(spark):
    scope = spark.createDataFrame([(1, k, f"p{k}", "1.1") for k in range(1, 6)], "student_id int, kp_id int, name string, chapter_no string")
    scores = spark.createDataFrame([(1, 1, 0.9, 0.9), (1, 2, 0.62, 0.7), (1, 3, 0.3, 0.4), (1, 4, 0.1, 0.6)], "student_id int, kp_id int, mastery_score double, peak_mastery_score double").withColumns({"attempts": F.lit(1), "last_at": F.lit(NOW)})
    book = spark.createDataFrame([(1, 2, "open")], "student_id int, question_id int, status string")
    due = spark.createDataFrame([(1, 1, NOW)], "student_id int, kp_id int, next_review_at timestamp")
    questions = spark.createDataFrame([(2, 2)], "question_id int, primary_kp int")
    items = learning.progress_items(scope, scores, book, due, questions, F.lit(NOW))
    rows = {r["kp_id"]: r for r in items.collect()}
    assert [rows[k]["status"] for k in range(1, 6)] == ["mastered", "learning", "needs_work", "regressed", "not_started"]
    assert [rows[k]["progress_percent"] for k in range(1, 6)] == [90, 62, 30, 10, 0]
    assert tuple(learning.progress_summary(items).first()) == (1, 5, 4, 1, 3)
    order = items.withColumn("p", learning.progress_priority()).orderBy("p", "kp_id").collect()
    assert [r["kp_id"] for r in order] == [4, 3, 1, 2, 5]


def test_answers_and_deltas(spark):
    assert column(spark, text.choice_answer, " b a ", "AC") == ["AB", "AC"]
    assert column(spark, text.fill_in_answer, " １，２ ", "1;3") == ["1,2", "1,3"]
    pairs = [(1, True, 5), (2, False, -15), (3, True, 10), (3, False, -8), (5, True, 15), (4, False, -3)]
    df = spark.createDataFrame(pairs, "d int, c boolean, w int")
    assert df.where(number.mastery_delta(F.col("d"), F.col("c")) != F.col("w")).count() == 0
    rows = [(1, 1, k, 5, NOW + dt.timedelta(hours=k), ok) for k, ok in enumerate([True] * 8 + [False])]
    graded = spark.createDataFrame(rows, "student_id int, primary_kp int, attempt_id int, difficulty int, answered_at timestamp, is_correct boolean")
    r = learning.mastery(graded).first()
    assert (r["mastery_score"], r["peak_mastery_score"]) == (0.97, 1.0)


def walk(answers):
    errors = streak = 0
    for right in answers:
        if not right:
            errors, streak = errors + 1, 0
        elif errors and streak < 2:
            streak += 1
    return errors, streak


def test_mistake_book_equals_a_walk(spark):
    import random

    r = random.Random(1)
    log = [(s, q, k, r.random() < 0.6, NOW + dt.timedelta(minutes=k)) for s in range(12) for q in range(3) for k in range(r.randint(1, 9))]
    df = spark.createDataFrame(log, "student_id int, question_id int, attempt_id int, is_correct boolean, answered_at timestamp")
    got = {(x["student_id"], x["question_id"]): (x["error_count"], x["streak"]) for x in learning.mistakes(df.repartition(3)).collect()}
    want = {}
    for s, q, _, ok, _ in log:
        want.setdefault((s, q), []).append(ok)
    want = {k: walk(v) for k, v in want.items()}
    assert got == {k: v for k, v in want.items() if v[0]}


def test_textbook_scope_and_titles(spark):
    points = spark.createDataFrame([("t", 1, None), ("t", 2, "2.1"), ("t", 3, "1.1"), ("t", 4, "1.1"), ("t", 5, "第四章")], "book string, kp_id int, chapter_no string")
    rows = learning.textbook_scope(points, "book").orderBy("sort_order").collect()
    assert [r["kp_id"] for r in rows] == [3, 4, 2, 5, 1] and [r["chapter_order"] for r in rows] == [1, 1, 2, 3, 4]
    assert column(spark, text.chapter_number, "第 4 章", "第十一章", "4.1", "4.4*", None) == ["4", "11", "4.1", "4.4*", "unassigned"]
    title = column(spark, text.file_title, "高中数学 选择性必修第二册.pdf")
    assert column(spark, text.volume, *title) == ["选择性必修 第二册"]
    pages = value(spark, number.page_list(F.array(*map(F.lit, ("3", "2", "2", "0", "-1", "NaN", "3"))), F.lit(None).cast("int"), F.lit(None).cast("int")))
    assert pages == [[2, 3]]


def question(**change):
    base = {"content": "What is it?", "question_type": "choice", "options": [("A", "x"), ("B", "y")], "answer": "A", "solution_text": "", "difficulty": 2.0, "kp_hints": ["h"]}
    return tuple((base | change).values())


@pytest.mark.parametrize(
    "change,problem",
    [({}, None), ({"options": [("A", "x")]}, "too_few_options"), ({"answer": "D"}, "answer_not_an_option"), ({"answer": "12"}, "answer_not_an_option"), ({"question_type": "fill_in"}, "unexpected_options"), ({"question_type": "essay"}, "question_type"), ({"kp_hints": []}, "no_hints"), ({"kp_hints": ["h", "h"]}, "repeated_hints"), ({"difficulty": 0.0}, "difficulty"), ({"difficulty": 6.0}, "difficulty"), ({"difficulty": 2.5}, "difficulty"), ({"content": "x"}, "content_length"), ({"content": "x" * 2001}, "content_length"), ({"options": [("A", "x"), ("Z", "y")]}, "option_label")],
)
def test_question_problems(spark, change, problem):
    schema = "q struct<content:string,question_type:string,options:array<struct<label:string,text:string>>,answer:string,solution_text:string,difficulty:double,kp_hints:array<string>>"
    got = spark.createDataFrame([(question(**change),)], schema).select(jsonx.question_problems(F.col("q"))).first()[0]
    assert got == [] if problem is None else problem in got


def test_numbers_from_json(spark):
    df = spark.createDataFrame([('{"y":null}',), ('{"y":""}',), ('{"z":1}',), ('{"y":"7"}',), ('{"y":"x"}',), ('{"y":3}',)], "j string")
    got = [r[0] for r in df.select(jsonx.coerce_number(F.parse_json("j"), "y")).collect()]
    assert got == [0.0, 0.0, None, 7.0, None, 3.0]


def test_retry_delays(spark):
    df = spark.createDataFrame([("7", "", 0), ("", "please retry after 2", 0), ("", "", 1), ("", "", 5)], "h string, t string, n int")
    assert [r[0] for r in df.select(number.retry_delay_ms(F.col("h"), F.col("t"), F.col("n"))).collect()] == [7000, 2000, 20000, 60000]


def test_calls_retry_only_where_it_helps(spark):
    rows = spark.createDataFrame([("ok",), ("429",), ("400",)], "p string")

    def client(prompt):
        client.seen = getattr(client, "seen", {})
        client.seen[prompt] = client.seen.get(prompt, 0) + 1
        if prompt == "429" and client.seen[prompt] < 3:
            return {"ok": False, "http_status": 429, "text": ""}
        return {"ok": prompt != "400", "http_status": 200 if prompt != "400" else 400, "text": str(client.seen[prompt])}

    got = {r["p"]: (r["ok"], r["text"]) for r in model_calls.call(rows, "p", client, scheduling.Schedule(sleep=scheduling.no_wait)).collect()}
    assert got == {"ok": (True, "1"), "429": (True, "3"), "400": (False, "1")}


def test_blobs_round_trip(spark, tmp_path):
    (tmp_path / "in" / "a").mkdir(parents=True)
    for name, data in (("x.pdf", b"one"), ("a/y.PNG", b"two"), ("z.docx", b"one")):
        (tmp_path / "in" / name).write_bytes(data)
    files = documents.read_binary(spark, f"file://{tmp_path}/in")
    assert {r["kind"] for r in files.collect()} == {"pdf", "word", "image"}
    for _ in range(2):
        documents.write_blobs(files, f"file://{tmp_path}/blobs")
    back = spark.read.parquet(f"file://{tmp_path}/blobs")
    assert sorted(bytes(r["content"]) for r in back.collect()) == [b"one", b"two"]
    pages = documents.page_rows(files, lambda _, data: (data[i : i + 1] for i in range(len(data))))
    assert pages.count() == 9 and pages.agg(F.max("page")).first()[0] == 3
    with pytest.raises(NotImplementedError):
        documents.store_root("s3", "x")


def test_upsert_keeps_one_row_per_key(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (None, "m"), (2, "c")], "k int, v string")
    assert sorted(core.upsert(old, new, ["k"]).collect(), key=str) == sorted([(1, "b"), (2, "c"), (None, "m")], key=str)


def test_fuzzy_tiers(spark):
    points = spark.createDataFrame([(1, "s", "集合的并集"), (2, "s", "函数单调性"), (3, "s", "集合的表示")], "kp_id int, subject_id string, name string")
    hints = ["集合的并集", "并集", "集合的并集运算", "并集及其运算", "集合论", "无", " "]
    df = spark.createDataFrame([(k, "s", h) for k, h in enumerate(hints)], "hint_id int, subject_id string, hint string")
    got = {r["hint_id"]: (r["kp_id"], r["tier"]) for r in fuzzy.match_hints(df, points).collect()}
    assert got[0] == (1, 1) and got[1] == (1, 2) and got[2] == (1, 2) and got[3] == (1, 4) and got[4] == (None, None) and got[5] == (None, None) and got[6] == (None, None)


@pytest.mark.parametrize(
    "raw,shown",
    [("$\\frac{a+1}{2}$", "(a+1)/2"), ("\\sqrt[3]{8}", "∛8"), ("x_{12}^2", "x₁₂^2"), ("$A\\subseteq B$", "A⊆ B"), ("\\leqslant\\leq\\le", "≤≤≤"), ("card(A(1))", "|A(1)|"), ("card(A", "card(A"), ("a\r\nb", "a\nb"), ("30^\\circ", "30°"), ("\\vec{AB}", "→AB"), ("\\mathbb{N}", "ℕ"), ("$\\left\\ x \\right\\ $", "x"), ("\\left\\{ x \\right.", "{ x"), ("\\overleftarrow{AB}", "←AB"), ("\\rm kg", "kg"), ("5\\mathrm{km}", "5km"), ("\\frac12", "1/2"), ("\\frac√32", "√3/2"), ("\\frac{1}{\\sqrt[n]{b}}", "1/ⁿ√b"),
     ("\\frac{\\frac{a}{b}}{c+d}", "a/b/(c+d)"), ("\\begin{cases} x & 1 \\\\ y & 2 \\end{cases}", "{ x，1； y，2 }"), ("$\\sqrt[3]{8}$ costs $5", "∛8 costs $5"), ("\\unknown x", "\\unknown x"), ("\\times2", "×2"), ("a_1^2 x^{n+1}", "a₁^2 xⁿ⁺¹"), ("\\textbf", "bf"), ("\\not\\Rightarrow", "⇏"), ("m^{a,b}", "m^{a,b}"), ("", "")],
)
def test_display_text(raw, shown):
    assert udf.show_latex(raw) == shown


def test_page_fallback_and_parse(spark):
    answers = spark.createDataFrame([(1, '```json\n{"materials":[{"title":"易错"}]}\n```'), (2, "nothing"), (3, "x {bad} y")], "doc int, text string")
    parsed = ingest.parse_batch(answers)
    assert [r["error"] for r in parsed.orderBy("doc").collect()] == [None, "no JSON object found", "JSON does not parse"]
    assert [tuple(r) for r in ingest.materials_of(parsed, "doc").select("doc", "material_type").collect()] == [(1, "common_mistake")]


def test_stream_equals_batch_and_stale_jobs_fail(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    base = dt.datetime(2024, 1, 1)
    rows = [("a", base, "queued"), ("b", base, "running"), ("b", base + dt.timedelta(minutes=1), "parsed"), ("c", base + dt.timedelta(hours=2), "queued")]
    df = spark.createDataFrame(rows, "job_id string, ts timestamp, status string")
    df.where("job_id <> 'c'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/jobs")
    df.where("job_id = 'c'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/jobs")
    seen = []
    stream = attempts.reap_jobs(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/jobs"))
    run = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend((r["job_id"], r["status"]) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert ("a", "failed") in seen and ("b", "parsed") in seen and ("b", "failed") not in seen


def test_entry_without_llm(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'p1_session_planner' in q and 'pipeline' not in q and not [k for k in q if k.startswith('op')]; print(len(q), len(o))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "r")})
    assert out.returncode == 0, out.stderr


@pytest.mark.parametrize(
    "function,cases",
    [
        (text.choice_answer, {" b a ": "AB", "Ｃ": "C", "D,a;b": "ABD", "12": ""}),
        (text.fill_in_answer, {" １，２ ": "1,2", "1; 2": "1,2", "x + 1": "X+1"}),
        (text.chapter_number, {"第十一章 集合": "11", "第 4 章": "4", "4.1": "4.1", "4.4*": "4.4*", "": "unassigned", "第一百零二章": "第一百零二章", "第〇章": "0", "第二十章": "20", "第百章": "100"}),
        (text.chapter_label, {"4.1": "第 4 章", "011": "第 11 章", "附录": "附录", "": "未分章"}),
        (text.knowledge_text, {" A,b (C) ": "abc", "A【集合】　": "a集合"}),
        (text.slug, {" A b--C! ": "a-b-c", "集合": "unknown", "X1": "x1"}),
        (text.content_type, {"a.PNG": "image/png", "b.jpg": "image/jpeg", "c.webp": "image/webp", "d": "application/octet-stream"}),
        (text.strip_data_url, {"data:image/png;base64,QUJD": "QUJD", "plain": "plain"}),
        (udf.string_hash, {"abc": "22ci", "hello": "1n1e4y", "": "0"}),
    ],
)
def test_text_functions_on_fixed_cases(spark, function, cases):
    rows = spark.createDataFrame([(k,) for k in cases], "raw string")
    assert {r["raw"]: r["out"] for r in rows.select("raw", function(F.col("raw")).alias("out")).collect()} == cases


def test_pairs_of_texts_on_fixed_cases(spark):
    rows = spark.createDataFrame([("aabc", "abcd", 1.0, "abc"), ("ab", "bcc", 0.5, "b"), ("", "x", 0.0, ""), ("并集及其运算", "集合的并集", 0.4, "并集"), ("xabcy", "zabc", 0.75, "abc"), ("abXbc", "bcab", 1.0, "ab")], "a string, b string, overlap double, common string")
    got = rows.select("overlap", text.character_overlap(F.col("a"), F.col("b")).alias("o"), "common", udf.common_substring(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r["c"] for r in got] == [r["common"] for r in got]
    assert [round(r["o"], 6) for r in got[:3]] == [r["overlap"] for r in got[:3]]


def test_questions_are_told_from_instructions(spark):
    kind = "type string, stem string, answer_area string, answer string, analysis string, figure_description string, raw_text string, options array<string>, sub_questions array<struct<number:string,stem:string,answer:string,analysis:string>>, figures array<struct<description:string,labels:array<string>>>"
    make = lambda stem, options=None, subs=None, figures=None: (None, stem, None, None, None, None, None, options, subs, figures)
    cases = [
        (make("已知集合 A，求 A 的子集个数"), True), (make("扫码关注公众号"), False), (make("题型一 讲解"), False), (make("例题：求 x"), True), (make("例题：要求 x"), False), (make(" "), False), (make(None, ["A", "B"]), True),
        (make("知识点", ["A"]), False), (make("知识点", ["A", "B"]), True), (make("方法总结", None, [("1", "x", None, None)]), True), (make("选择题 技巧"), False), (make("plain text"), True), (make("看图", None, None, [("视频讲解", ["a"])]), False), (make("look at me"), False), (make("look at me ?"), True),
    ]
    rows = spark.createDataFrame([q for q, _ in cases], kind)
    got = [r["ok"] for r in rows.select(text.is_question(F.struct(*[F.col(c) for c in rows.columns])).alias("ok")).collect()]
    assert got == [ok for _, ok in cases]


def test_functions_on_fixed_rows(spark):
    """Cases by hand of functions that the queries feed with columns of the tables."""
    one = spark.range(1)
    s, array = F.lit, lambda *x: F.array(*map(F.lit, x))
    cases = [
        (text.answers_equal(s("b a"), s("AB"), s("choice")), True), (text.answers_equal(s("x"), s("AB"), s("choice")), False), (text.answers_equal(s("b a"), s("AB"), s("fill_in")), False),
        (text.strip_suffixes(s("集合的并集运算方法")), "集合的并集"), (text.strip_suffixes(s("运算")), "运算"), (text.strip_suffixes(s("函数性质")), "函数"),
        (F.to_json(text.parse_options(array("A. one", "b、two"))), '[{"label":"A","text":"one"},{"label":"B","text":"two"}]'), (F.to_json(text.parse_options(array("B: x", "plain"))), '[{"label":"B","text":"x"},{"label":"B","text":"plain"}]'),
        (text.material_kind(s("x"), s("易错点"), s("")), "common_mistake"), (text.material_kind(s("method_card"), s("t"), s("")), "method_card"), (text.material_kind(s("y"), s("高频考点"), s("")), "exam_trend"), (text.material_kind(s("z"), s("无"), s("")), "concept_explanation"),
        (text.question_kind(s("单选题")), "choice"), (text.question_kind(s("Fill-in")), "fill_in"), (text.question_kind(s("证明")), "proof"), (text.question_kind(s("?")), "unknown"),
        (text.unit_kind(s("PPT")), "slide"), (text.unit_kind(s("题目")), "question_region"), (text.unit_kind(s("page 3")), "page"), (text.unit_kind(s("?")), "text_block"),
        (text.quality(s(""), s(" "), s("a"), s("s")), "incomplete_stem"), (text.quality(s(""), s("c"), s(""), s("s")), "missing_answer"), (text.quality(s(""), s("c"), s("a"), s(" ")), "missing_solution"), (text.quality(s("needs_review"), s("c"), s("a"), s("s")), "needs_review"), (text.quality(s("?"), s("c"), s("a"), s("s")), "publishable"),
        (F.to_json(text.figure_parts(s("a [[figure:f1]] b"))), '[{"kind":"text","value":"a "},{"kind":"figure","value":"f1"},{"kind":"text","value":" b"}]'), (F.array_join(text.non_learning(s("扫码加群")), ","), "qr_code"), (F.array_join(text.non_learning(s("公众号福利")), ","), "non_subject_content"), (F.array_join(text.non_learning(s("plain")), ","), ""),
        (number.retry_delay_ms(s("3"), s(""), s(0)), 3000), (number.retry_delay_ms(s("soon"), s("Retry after 2.5 s"), s(0)), 3000), (number.retry_delay_ms(s(""), s("x"), s(0)), 10000), (number.retry_delay_ms(s(""), s(""), s(2)), 40000),
        (number.weight(s("40.9"), 25), 40), (number.weight(s("250"), 25), 100), (number.weight(s("-3"), 25), 0), (number.weight(s("abc"), 25), 25),
        (number.clamp_int(s(99.0), 1, 15), 15), (number.clamp_int(s(-4.0), 1, 15), 1), (number.clamp_int(s(8.9), 1, 15), 8), (number.clamp_int(s(float("nan")), 1, 15), 1),
        (number.bounded_int(s("4"), 1, 6, 1), 4), (number.bounded_int(s("99"), 1, 6, 1), 1), (number.bounded_int(s("x"), 1, 6, 1), 1),
        (F.to_json(jsonx.box(F.parse_json(s('{"left":-5,"top":0,"width":150,"height":10}')))), '{"x":0.0,"y":0.0,"w":100.0,"h":10.0}'), (F.array_join(number.page_list(array("3", "2", "2", "0", "-1", "NaN", "3"), s(None).cast("int"), s(None).cast("int")).cast("array<string>"), ","), "2,3"), (F.array_join(number.page_list(F.array().cast("array<string>"), s(4), s(6)).cast("array<string>"), ","), "4,5,6"),
        (udf.json_text(s('{"x":1,"content":{"text":" hi "}}')), "hi"), (udf.json_text(s('["a",2,null]')), "a\n2"), (udf.json_text(s("true")), "true"),
        (documents.safe_key(s("derived/a.png")), True), (documents.safe_key(s("derived/../a")), False), (documents.safe_key(s("/derived/a")), False), (documents.safe_key(s("uploads/a")), False),
        (number.is_expired(s(99), F.timestamp_seconds(s(100))), True), (number.is_expired(s(100), F.timestamp_seconds(s(100))), False), (number.is_expired(s(None).cast("long"), F.timestamp_seconds(s(100))), False),
    ]
    got = one.select(*[c.alias(f"c{k}") for k, (c, _) in enumerate(cases)]).first()
    assert [got[k] for k in range(len(cases))] == [want for _, want in cases]
