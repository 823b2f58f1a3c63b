"""Hints and items against points over the index, held to all pairs in plain Python."""

import random
import re

from tallyforge.functions import text, udf
from tallyforge.operators import fuzzy
from tallyforge.plans import learning


def plain_hint(hint, points):
    """(kp_id, tier) by all pairs."""
    h = hint.strip().lower()
    if not h:
        return None, None
    bare = re.sub(f"^(.+?)(?:{'|'.join(text.SUFFIXES)})+$", r"\1", h)
    found = []
    for kp, name in points:
        n = name.strip().lower()
        if h == n:
            found.append((1, 0, kp))
        elif n in h or h in n:
            found.append((2, 0, kp))
        elif bare != h and (n in bare or bare in n):
            found.append((3, 0, kp))
    if not found:
        for kp, name in points:
            c = udf.longest_common(h, name.strip().lower())
            if len(c) > 2 or (len(c) == 2 and c not in fuzzy.STOP_WORDS):
                found.append((4, -len(c), kp))
    return (min(found)[2], min(found)[0]) if found else (None, None)


def words(r, most):
    parts = ["集合", "函数", "数列", "列", "图", "性质", "的概念", "专题", "a", "B", "ab", "x", " ", "交", "补集", *text.SUFFIXES[:3]]
    return "".join(r.choice(parts) for _ in range(r.randint(1, most)))


def test_hints_equal_all_pairs(spark):
    r = random.Random(12)
    points = [(k, k % 3, words(r, 4)) for k in range(160)] + [(500, 2, "函"), (501, 1, "q")]
    hints = [(k, k % 3, words(r, 5)) for k in range(500)] + [(900, 1, "q"), (901, 2, "函"), (902, 0, " "), (903, 9, "集合"), (904, 1, "xq1")]
    got = {x["hint_id"]: (x["kp_id"], x["tier"]) for x in fuzzy.match_hints(spark.createDataFrame(hints, "hint_id int, subject_id int, hint string"), spark.createDataFrame(points, "kp_id int, subject_id int, name string")).collect()}
    assert got == {i: plain_hint(h, [(k, n) for k, s, n in points if s == g]) for i, g, h in hints}
    assert {t for _, t in got.values()} >= {1, 2, 4, None}


def test_a_point_without_a_name_is_held_by_every_hint(spark):
    points = spark.createDataFrame([(7, 0, " "), (3, 0, "xyz"), (1, 0, None), (2, 0, None)], "kp_id int, subject_id int, name string")
    hints = spark.createDataFrame([(1, 0, "xyz"), (2, 0, "other"), (3, 1, "other"), (4, 0, None)], "hint_id int, subject_id int, hint string")
    assert {x["hint_id"]: (x["kp_id"], x["tier"]) for x in fuzzy.match_hints(hints, points).collect()} == {1: (3, 1), 2: (7, 2), 3: (None, None), 4: (None, None)}


def test_items_equal_all_pairs(spark):
    r = random.Random(5)
    line = lambda most: " ".join([words(r, most), *(["子集个数"] if r.random() < 0.1 else []), *(["参数"] if r.random() < 0.1 else [])])
    items = [(k, k % 2, line(9), words(r, 2) if k % 3 else "") for k in range(150)]
    points = [(k, k % 2, words(r, 3), line(6)) for k in range(60)] + [(90, 1, "", "")]
    a = spark.createDataFrame(items, "item_id int, grp int, item_text string, hint string")
    b = spark.createDataFrame(points, "kp_id int, grp int, name string, search_text string")
    from pyspark.sql import functions as F

    every = a.join(b, "grp").withColumn("score", fuzzy.match_score(F.col("item_text"), F.col("hint"), F.col("name"), F.col("search_text"))).where("score >= 0.45")
    want = {}
    for x in every.collect():
        key = (-x["score"], x["kp_id"])
        want[x["item_id"]] = min(want.get(x["item_id"], key), key)
    got = {x["item_id"]: (-x["score"], x["kp_id"]) for x in fuzzy.best_match(a, b, "grp").collect()}
    assert got == want and len(got) > 50


def test_few_pairs_are_made(spark):
    r = random.Random(3)
    word = lambda n: "".join(chr(0x4E00 + r.randint(0, 2000)) for _ in range(n))
    points = [(k, 0, word(6)) for k in range(2000)]
    hints = [(k, 0, points[k][2][:3] + word(3)) for k in range(1000)]
    texts = spark.createDataFrame([(0, n) for _, _, n in points], "g int, t string")
    probes = spark.createDataFrame([(0, h) for _, _, h in hints], "g int, p string")
    assert fuzzy.sharing(probes, texts, 3).count() < 1200
    assert fuzzy.held_in(probes, texts).count() == 0
    plan = fuzzy.match_hints(spark.createDataFrame(hints, "hint_id int, subject_id int, hint string"), spark.createDataFrame(points, "kp_id int, subject_id int, name string"))
    assert plan.where("tier = 4").count() == 1000


def test_questions_of_any_id_are_chosen(spark):
    large = (1 << 40) + 5
    slots = spark.createDataFrame([(1, 3, "chapter_practice", None, 1), (2, 3, "chapter_practice", None, 1)], "student_id long, kp_id int, pool string, source_question long, slot int")
    scores = spark.createDataFrame([(1, 3, 0.2)], "student_id long, kp_id int, mastery_score double")
    allowed = spark.createDataFrame([(1, 3), (2, 3)], "student_id long, kp_id int")
    for ids, first in (([large], large), ([-7, large], -7), ([(1 << 62), (1 << 62) + 1], 1 << 62)):
        bank = spark.createDataFrame([(q, 3, [3], 2) for q in ids], "question_id long, primary_kp int, kp_ids array<int>, difficulty int")
        assert {x["question_id"] for x in learning.choose_questions(slots, scores, bank, allowed).collect()} == {first}


def test_points_are_resolved_by_id_and_else_by_name(spark):
    points = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (3, 0, "b"), (4, 1, "b")], "kp_id int, subject_id int, name string")
    rows = [(1, 0, [2, 1, 2, None], ["b"]), (2, 0, [4, 9], [" b ", None, ""]), (3, 1, None, ["b", "b"]), (4, 0, [], ["c"]), (5, 0, None, None), (6, 9, [1], ["a"])]
    items = spark.createDataFrame(rows, "item_id int, subject_id int, ids array<int>, hints array<string>")
    got = {x["item_id"]: (x["kp_ids"], x["tier"]) for x in fuzzy.resolve_points(items, points).collect()}
    assert got == {1: ([1, 2], 1), 2: ([2, 3], 2), 3: ([4], 2), 4: (None, None), 5: (None, None), 6: (None, None)}


def test_chinese_names_sort_by_sound(spark):
    names = ["集合", "函数", "一元", "数列", "安全", "第2章", "abc"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r["n"] for r in df.orderBy(text.in_locale(df["n"]), "n").collect()] == ["安全", "第2章", "函数", "集合", "数列", "一元", "abc"]


def test_plain_searches_find_what_the_patterns_find(spark):
    r = random.Random(7)
    patterns = [p for p, _ in text.NON_LEARNING] + ["ab*c|x.y|(?i)z", "(?i)Ab|文*字|字|[0-9]页"]
    patterns = [p for p in patterns if "|(?i)" not in p]
    words = ["扫码", "QR", "qr  Code", "code", "关注", "资料", "\n", "第 3 页 / 9", "第", "页", "Copyright", "copyright", "©", "名师", "文文字", "文", "字", "aB", "9页", "x", "优惠", "目录", " "]
    texts = ["".join(r.choice(words) for _ in range(r.randint(0, 5))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in patterns:
        assert df.where(text.finds(df["t"], p) != df["t"].rlike(p)).count() == 0, p


def test_rows_of_a_large_upload_never_meet_in_pairs(spark):
    r = random.Random(9)
    text = lambda: r.choice(["short", "a start of more than ten", " ", "another  start that is long enough to be cut " + r.choice("xy"), None])
    number = lambda: r.choice([None, *range(40)])
    old = [(r.choice([1, 1, 1, 2, 3]), k, number(), text()) for k in range(1500)]
    new = [(r.choice([1, 1, 1, 2]), 5000 - k, number() if k % 3 else None, text()) for k in range(1500)]
    kind = "upload_id long, {} long, number long, content string"
    got = fuzzy.rerun_match(spark.createDataFrame(old, kind.format("old_id")), spark.createDataFrame(new, kind.format("new_id")))
    # each side of old rows meets a table of one row a key
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 3 and "Join Inner" not in plan
    start = lambda c: None if c is None else "".join(c.split())[:30]
    want = {}
    for upload, old_id, n, c in old:
        found = [(1 if n is not None and n == n2 else 2 if c and c2 and len(start(c)) > 10 and start(c) == start(c2) else 3, new_id) for u2, new_id, n2, c2 in new if u2 == upload]
        if found:
            want[old_id] = min(found)
    assert {x["old_id"]: (x["tier"], x["new_id"]) for x in got.collect()} == want


def test_a_rerun_sends_no_old_payload_to_the_new_rows(spark):
    from tallyforge.plans import ingest

    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "old_id long, payload string")
    new = spark.createDataFrame([(8, "n"), (9, None)], "new_id long, new_payload string")
    found = spark.createDataFrame([(1, 8, 1), (2, 9, 3)], "old_id long, new_id long, tier int")
    rows = ingest.take_rerun(old, new, found)
    assert sorted(map(tuple, rows.select("old_id", "payload", "lineage", "tier").collect())) == [(1, "n", 8, 1), (2, "b", 9, 3), (3, None, None, None)]
    first_join = rows._jdf.queryExecution().analyzed().toString().split("Join")[-1]
    assert "new_payload" in first_join and "LogicalRDD [old_id" in first_join and ", payload" not in first_join
