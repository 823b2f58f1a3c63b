"""Queries: composite operators, streams and the function surface (P, T and X rows)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import number, text
from tallyforge.operators import core, fuzzy
from tallyforge.sources import model_calls, scheduling, shared
from tallyforge.streaming import attempts, sink

from . import ingest, ingest_run, learning
from .q_aggregate import ITEMS_SQL, STATS_SQL, items
from .q_join import HINTS_SQL, RERUN_SQL, name_hints, rerun_rows
from .q_scan import _ASKS as ASKS_SQL
from .q_scan import _SAID as SAID_SQL
from .q_scan import _TELLS as TELLS_SQL
from .registry import query

PLAN_SQL = """allowed AS (SELECT u.student_id, u.kp_id, row_number() OVER (PARTITION BY u.student_id ORDER BY u.kp_id) - 1 AS place FROM unlocked u JOIN kp USING (kp_id) JOIN student s ON s.student_id = u.student_id WHERE kp.subject_id = s.subject_id),
am AS (SELECT a.*, coalesce(m.mastery_score, 0) AS m FROM allowed a LEFT JOIN mastery m USING (student_id, kp_id)),
cand AS (SELECT r.student_id, r.kp_id, 'spaced_review' AS pool, greatest(0, (epoch_us(now) - epoch_us(next_review_at)) / 8.64e10) AS score, CAST(NULL AS BIGINT) AS source_question FROM review r JOIN allowed USING (student_id, kp_id), now_at WHERE next_review_at <= now
 UNION ALL SELECT mi.student_id, q.primary_kp, 'mistake_variant', error_count, mi.question_id FROM mistake mi JOIN question q USING (question_id) JOIN allowed a ON a.student_id = mi.student_id AND a.kp_id = q.primary_kp WHERE mi.status = 'open'
 UNION ALL SELECT student_id, kp_id, 'new_knowledge', (1 - m) * 100 - place / 100, NULL FROM am WHERE m < 0.5
 UNION ALL SELECT student_id, kp_id, 'feynman_check', m, NULL FROM am WHERE m >= 0.5 AND m < 0.85),
ranked AS (SELECT *, CASE pool WHEN 'spaced_review' THEN 100 WHEN 'mistake_variant' THEN 90 WHEN 'new_knowledge' THEN 60 ELSE 50 END AS rank FROM cand),
one AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY student_id, kp_id ORDER BY rank DESC, score DESC, source_question NULLS FIRST) AS n FROM ranked) WHERE n = 1),
ks AS (SELECT *, row_number() OVER (PARTITION BY student_id, pool ORDER BY score DESC, kp_id) AS k FROM one),
ts AS (SELECT *, CASE WHEN k <= CASE pool WHEN 'new_knowledge' THEN 4 WHEN 'mistake_variant' THEN 2 WHEN 'spaced_review' THEN 2 ELSE 0 END THEN 1 ELSE 2 END AS turn FROM ks WHERE pool <> 'feynman_check' OR k = 1),
slots AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY turn, rank DESC, k) AS slot FROM ts) WHERE slot <= 8),
mine AS (SELECT student_id, list(kp_id) AS mine FROM allowed GROUP BY student_id),
fits AS (SELECT s.student_id, s.kp_id, q.question_id, row_number() OVER (PARTITION BY s.student_id, s.kp_id ORDER BY CASE WHEN s.source_question = q.question_id THEN 0 ELSE 1 END, CASE WHEN q.difficulty BETWEEN lo AND lo + 1 THEN 0 ELSE 1 END, abs(q.difficulty - (lo + 0.5)), q.question_id) AS n
 FROM (SELECT s.*, CASE WHEN am.m < 0.2 THEN 1 WHEN am.m < 0.5 THEN 2 WHEN am.m < 0.85 THEN 3 ELSE 4 END AS lo FROM slots s JOIN am USING (student_id, kp_id) WHERE pool <> 'feynman_check') s JOIN mine USING (student_id) JOIN question q ON q.primary_kp = s.kp_id AND list_has_all(mine, q.kp_ids)),
planned AS (SELECT s.student_id, s.slot, s.kp_id, s.pool, f.question_id, CASE WHEN f.question_id IS NULL THEN 'ai_generated' ELSE 'question_bank' END AS source FROM slots s LEFT JOIN fits f ON f.student_id = s.student_id AND f.kp_id = s.kp_id AND f.n = 1)"""


def pools(v):
    allowed = learning.allowed_points(v.student, v.unlocked, v.kp)
    return allowed, learning.candidates(allowed, learning.mastery(v.graded), learning.mistakes(v.attempt), learning.reviews(v.graded), v.question, v.now)


def planned(v):
    allowed, found = pools(v)
    slots = learning.plan_slots(found, learning.budgets())
    return learning.choose_questions(slots, learning.mastery(v.graded), v.question, allowed)


@query("p1_session_planner", f"WITH {PLAN_SQL} SELECT student_id, slot, kp_id, pool, question_id, source FROM planned")
def _(v):
    return planned(v).select("student_id", "slot", "kp_id", "pool", "question_id", "source")


@query("p2_candidate_pools", f"WITH {PLAN_SQL} SELECT student_id, kp_id, pool, round(score, 6) AS score, source_question FROM cand")
def _(v):
    return pools(v)[1].select("student_id", "kp_id", "pool", F.round("score", 6).alias("score"), "source_question")


@query("p3_session_plan", f"WITH {PLAN_SQL} SELECT student_id, array_to_string(list(question_id ORDER BY slot), ',') AS questions, array_to_string(list(CASE pool WHEN 'mistake_variant' THEN 'error_review' WHEN 'spaced_review' THEN 'spaced_repetition' ELSE 'new_knowledge' END ORDER BY slot), ',') AS sources, count(*) >= 3 AS is_enough FROM planned WHERE source = 'question_bank' GROUP BY student_id")
def _(v):
    plan = learning.session_plan(planned(v))
    return plan.select("student_id", F.array_join(F.transform("question_ids", lambda x: x.cast("string")), ",").alias("questions"), F.array_join("pool_sources", ",").alias("sources"), "is_enough")


#: The planner's six scans; points, bank and the rest narrowed to points that a learner can be asked on.
P4_SQL = """WITH asked AS (SELECT primary_kp AS kp_id, kp_ids, created_at, question_id FROM question WHERE question_type IN ('choice', 'fill_in')),
placed AS (SELECT u.student_id, u.kp_id, a.question_id, a.kp_ids, row_number() OVER (PARTITION BY u.student_id ORDER BY u.kp_id, a.created_at, a.question_id) AS n FROM unlocked u JOIN asked a USING (kp_id)),
sets AS (SELECT student_id, list(kp_id) AS allowed FROM unlocked GROUP BY student_id),
broad AS (SELECT p.* FROM placed p JOIN sets USING (student_id) WHERE n <= 500 AND list_has_all(allowed, kp_ids)),
narrow AS (SELECT DISTINCT student_id, kp_id FROM broad),
narrowed AS (SELECT student_id, list(kp_id) AS allowed FROM narrow GROUP BY student_id),
book AS (SELECT student_id, q.primary_kp AS kp_id, question_id, error_count, row_number() OVER (PARTITION BY student_id ORDER BY error_count DESC, mi.created_at, question_id) AS n FROM mistake mi JOIN question q USING (question_id) WHERE status = 'open' AND EXISTS (SELECT 1 FROM unlocked u WHERE u.student_id = mi.student_id AND u.kp_id = q.primary_kp)),
due AS (SELECT student_id, kp_id, next_review_at, row_number() OVER (PARTITION BY student_id ORDER BY next_review_at, kp_id) AS n FROM review JOIN unlocked USING (student_id, kp_id), now_at WHERE next_review_at <= now)
SELECT student_id, 'preference' AS scan, CAST(NULL AS INTEGER) AS kp_id, CAST(NULL AS BIGINT) AS question_id, CASE WHEN student_id % 3 = 0 THEN 'custom' ELSE 'auto' END AS value FROM student
UNION ALL SELECT n.student_id, 'point', n.kp_id, NULL, kp.chapter_no FROM narrow n JOIN student s ON s.student_id = n.student_id JOIN kp ON kp.kp_id = n.kp_id WHERE kp.subject_id = s.subject_id
UNION ALL SELECT student_id, 'bank', kp_id, question_id, NULL FROM broad JOIN narrowed USING (student_id) WHERE list_has_all(narrowed.allowed, kp_ids)
UNION ALL SELECT student_id, 'mastery', kp_id, NULL, CAST(CAST(round(mastery_score * 100) AS INTEGER) AS VARCHAR) FROM mastery JOIN narrow USING (student_id, kp_id)
UNION ALL SELECT student_id, 'mistake', kp_id, question_id, CAST(error_count AS VARCHAR) FROM book JOIN narrow USING (student_id, kp_id) WHERE n <= 100
UNION ALL SELECT student_id, 'due', kp_id, NULL, CAST(epoch_us(next_review_at) AS VARCHAR) FROM due JOIN narrow USING (student_id, kp_id) WHERE n <= 100"""


def planner_bank(v, most=500):
    """(student_id, kp_id, question_id, kp_ids): the first questions of each learner's unlocked points, by point and age.

    A point's questions are ranked once; a learner's points add up to where each of them begins.
    """
    asked = v.question.where(F.col("question_type").isin("choice", "fill_in")).select(F.col("primary_kp").alias("kp_id"), "kp_ids", "created_at", "question_id")
    ranked = core.top_k(asked.withColumn("n", F.row_number().over(Window.partitionBy("kp_id").orderBy("created_at", "question_id"))), ["kp_id"], ["n"], most)
    before = Window.partitionBy("student_id").orderBy("kp_id").rowsBetween(Window.unboundedPreceding, -1)
    counts = asked.groupBy("kp_id").agg(F.count(F.lit(1)).alias("all"))
    starts = v.unlocked.join(counts, "kp_id").withColumn("start", F.coalesce(F.sum("all").over(before), F.lit(0))).where(F.col("start") < most)
    return starts.join(ranked, "kp_id").where(F.col("start") + F.col("n") <= most).select("student_id", "kp_id", "question_id", "kp_ids")


def within(bank, points):
    """The bank's questions whose points are all among the learner's points (student_id, kp_id)."""
    sets = points.groupBy("student_id").agg(F.collect_set(F.col("kp_id").cast("int")).alias("allowed"))
    return bank.join(sets, "student_id").where(F.size(F.array_except("kp_ids", "allowed")) == 0).drop("allowed")


@query("p4_planner_input", P4_SQL)
def _(v):
    """(student_id, scan, kp_id, question_id, value) of the planner's six scans, on answerable points only."""
    broad = within(planner_bank(v), v.unlocked)
    narrow = broad.select("student_id", "kp_id").distinct()
    bank = within(broad, narrow)
    scan = lambda df, name, question, value: df.select("student_id", F.lit(name).alias("scan"), F.col("kp_id").cast("int").alias("kp_id"), question.cast("long").alias("question_id"), value.cast("string").alias("value"))
    none = F.lit(None)
    asked = v.question.select("question_id", F.col("primary_kp").alias("kp_id"))
    book = learning.mistakes(v.attempt).where("status = 'open'").join(asked, "question_id").join(v.unlocked, ["student_id", "kp_id"], "left_semi")
    book = core.top_k(book, ["student_id"], [F.col("error_count").desc(), "created_at", "question_id"], 100)
    due = core.top_k(learning.reviews(v.graded).where(F.col("next_review_at") <= v.now).join(v.unlocked, ["student_id", "kp_id"], "left_semi"), ["student_id"], ["next_review_at", "kp_id"], 100)
    mode = F.when(F.col("student_id") % 3 == 0, "custom").otherwise("auto")
    points = v.unlocked.join(v.student, "student_id").join(v.kp.select("kp_id", F.col("subject_id").alias("own"), "chapter_no"), "kp_id").where("own = subject_id")
    inside = lambda df: df.join(narrow, ["student_id", "kp_id"], "left_semi")
    parts = [
        scan(v.student.withColumn("kp_id", none), "preference", none, mode),
        scan(inside(points), "point", none, F.col("chapter_no")),
        scan(bank, "bank", F.col("question_id"), none),
        scan(inside(learning.mastery(v.graded)), "mastery", none, F.round(F.col("mastery_score") * 100).cast("int")),
        scan(inside(book), "mistake", F.col("question_id"), F.col("error_count")),
        scan(inside(due), "due", none, F.unix_micros("next_review_at")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


P5_SQL = """WITH live AS (SELECT session_id FROM session WHERE session_id % 100 >= 20 AND session_id % 4 > 0),
counted AS (SELECT * FROM step WHERE day(answered_at) < 20 OR session_id IN (SELECT session_id FROM live)),
folded AS (SELECT student_id, primary_kp AS kp_id, list_reduce(list({'c': CAST(delta AS INTEGER), 'p': 0} ORDER BY answered_at, attempt_id), lambda a, x: {'c': greatest(0, least(100, a.c + x.c)), 'p': greatest(a.p, greatest(0, least(100, a.c + x.c)))}, {'c': 0, 'p': 0}) AS s FROM counted GROUP BY ALL),
due AS (SELECT student_id, primary_kp AS kp_id, greatest(min(answered_at), max(CASE WHEN NOT is_correct THEN answered_at END)) + INTERVAL 24 HOUR AS due_at FROM counted GROUP BY ALL),
bad AS (SELECT student_id, question_id, max(CASE WHEN NOT is_correct THEN attempt_id END) AS last_wrong, count(*) FILTER (WHERE NOT is_correct) AS errors FROM counted GROUP BY ALL HAVING count(*) FILTER (WHERE NOT is_correct) > 0),
book AS (SELECT b.student_id, b.question_id, b.errors, least(2, count(c.attempt_id)) AS streak FROM bad b LEFT JOIN counted c ON c.student_id = b.student_id AND c.question_id = b.question_id AND c.is_correct AND c.attempt_id > b.last_wrong GROUP BY ALL)
SELECT 'mastery' AS part, student_id, CAST(kp_id AS BIGINT) AS key, CAST(s.c AS VARCHAR) || '/' || CAST(s.p AS VARCHAR) AS value FROM folded
UNION ALL SELECT 'review', student_id, kp_id, CAST(epoch_us(due_at) AS VARCHAR) FROM due
UNION ALL SELECT 'mistake', student_id, question_id, errors || '/' || streak || '/' || CASE WHEN streak = 2 THEN 'resolved' ELSE 'open' END FROM book
UNION ALL SELECT 'session', student_id, session_id, CASE WHEN session_id % 4 > 0 THEN 'completed' ELSE 'abandoned' END FROM session WHERE session_id % 100 >= 20"""


@query("p5_submission", P5_SQL)
def _(v):
    """The sessions from the 20th on are handed in upon the state before; those that are no longer in progress change nothing."""
    before = v.graded.where("day(answered_at) < 20")
    old = {"scores": learning.mastery(before).select("student_id", "kp_id", "mastery_score", "peak_mastery_score"), "due": learning.reviews(before), "book": learning.mistakes(before).select("student_id", "question_id", "error_count", "streak", "status")}
    sessions = v.session.where("session_id % 100 >= 20").select("session_id", "student_id", F.when(F.col("session_id") % 4 > 0, "in_progress").otherwise("abandoned").alias("status"))
    answers = v.graded.select("session_id", "question_id", F.col("primary_kp").alias("kp_id"), "difficulty", "is_correct", F.col("attempt_id").alias("pos"), "answered_at")
    new = learning.submit(sessions, answers, **old)
    part = lambda name, rows, key, value: rows.select(F.lit(name).alias("part"), "student_id", F.col(key).cast("long").alias("key"), value.alias("value"))
    hundredths = lambda c: F.round(F.col(c) * 100).cast("int").cast("string")
    parts = [
        part("mastery", new["mastery"], "kp_id", F.concat_ws("/", hundredths("mastery_score"), hundredths("peak_mastery_score"))),
        part("review", new["reviews"], "kp_id", F.unix_micros("next_review_at").cast("string")),
        part("mistake", new["mistakes"], "question_id", F.concat_ws("/", F.col("error_count").cast("string"), F.col("streak").cast("string"), "status")),
        part("session", new["sessions"], "session_id", F.col("status")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


_REDO = "redone AS (SELECT m.student_id, m.question_id, m.error_count + CASE WHEN r.ok THEN 0 ELSE 1 END AS error_count, CASE WHEN r.ok THEN least(2, m.streak + 1) ELSE 0 END AS streak FROM mistake m JOIN (SELECT student_id, question_id, min_by(is_correct, redo_id) AS ok FROM redo GROUP BY ALL) r USING (student_id, question_id) WHERE m.status = 'open')"


@query("p6_mistake_redo", f"WITH {_REDO} SELECT *, CASE WHEN streak >= 2 THEN 'resolved' ELSE 'open' END AS status FROM redone")
def _(v):
    return learning.redo(learning.mistakes(v.attempt), v.redo)


@query("p7_progress_report", f"WITH {ITEMS_SQL} SELECT student_id, kp_id, name, chapter_no, status, progress_percent, practice_count, has_open_mistake, needs_review FROM items")
def _(v):
    return items(v).drop("last_practiced_at")


def _ranked(order, limit, status):
    return f"SELECT kp_id, '{status}' AS status, list(material_id ORDER BY n) AS materials FROM (SELECT *, row_number() OVER (PARTITION BY kp_id ORDER BY list_position({list(order)}, material_type), created_at DESC, material_id) AS n FROM material) WHERE n <= {limit} GROUP BY kp_id"


GROUPS_SQL = f"""{STATS_SQL}, lists AS ({_ranked(learning.WORK_ORDER, 5, "needs_work")} UNION ALL {_ranked(learning.REVIEW_ORDER, 3, "review")}),
grouped AS (SELECT s.*, l.materials, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN s.status = 'needs_work' THEN 0 ELSE 1 END, total_count - correct_count DESC, total_count DESC, first_seen, s.kp_id) AS place
 FROM (SELECT *, CASE WHEN correct_count < total_count THEN 'needs_work' ELSE 'review' END AS status FROM stats) s JOIN lists l ON l.kp_id = s.kp_id AND l.status = s.status)"""


def groups(v):
    return learning.result_groups(learning.point_stats(v.graded, v.unlocked), v.material)


@query("p8_result_groups", f"WITH {GROUPS_SQL} SELECT session_id, kp_id, status, correct_count, total_count, place, array_to_string(materials, ',') AS materials FROM grouped")
def _(v):
    ids = F.array_join(F.transform("materials", lambda m: m["material_id"].cast("string")), ",")
    return groups(v).select("session_id", "kp_id", "status", "correct_count", "total_count", "place", ids.alias("materials"))


_PLAN = f"{GROUPS_SQL}, rp AS (SELECT session_id, count(*) FILTER (WHERE status = 'needs_work') AS weak, min_by(kp.name, place) AS first_name, list(kp.name ORDER BY place) FILTER (WHERE place <= 3) AS focus FROM grouped JOIN kp USING (kp_id) GROUP BY session_id)"


@query("p9_review_plan", f"WITH {_PLAN} SELECT session_id, weak, CASE WHEN weak > 0 THEN '先把“' || first_name || '”补牢' ELSE '这次整体不错，顺手复习“' || first_name || '”' END AS headline, array_to_string(focus, ',') AS focus FROM rp")
def _(v):
    return learning.review_plan(groups(v), v.kp).select("session_id", "weak", "headline", F.array_join("focus_names", ",").alias("focus"))


@query("p10_plan_selection", f"WITH {_PLAN} SELECT session_id, CASE WHEN session_id % 4 = 0 THEN 'advice' ELSE first_name END AS plan FROM rp")
def _(v):
    plan = learning.review_plan(groups(v), v.kp).select("session_id", F.get("focus_names", F.lit(0)).alias("own"))
    advice = v.session.where("session_id % 4 = 0").select("session_id", F.lit("advice").alias("advice"))
    return plan.join(advice, "session_id", "left").select("session_id", F.coalesce("advice", "own").alias("plan"))


@query("p11_advice_input", f"WITH {GROUPS_SQL} SELECT session_id, array_to_string(list(kp_id || ':' || len(list_slice(materials, 1, 4)) ORDER BY place), ',') AS snapshot FROM grouped GROUP BY session_id")
def _(v):
    part = F.concat(F.col("kp_id").cast("string"), F.lit(":"), F.size(F.slice("materials", 1, 4)).cast("string"))
    return groups(v).groupBy("session_id").agg(F.array_join(core.ordered_list(["place"], part), ",").alias("snapshot"))


@query("p12_advice_lifecycle", "SELECT session_id, CASE WHEN session_id % 5 = 0 THEN 'generated' WHEN session_id % 5 = 1 THEN 'failed' ELSE 'ok' END AS status FROM session")
def _(v):
    k = F.col("session_id") % 5
    known = v.session.where(k == 0).select("session_id", F.lit("generated").alias("status"))
    asked = v.session.where(k != 0).select("session_id", F.col("session_id").cast("string").alias("prompt"))
    client = lambda p: {"ok": int(p) % 5 != 1, "http_status": 400 if int(p) % 5 == 1 else 200, "text": "{}"}
    called = model_calls.call(asked, "prompt", client).select("session_id", F.when(F.col("ok"), "ok").otherwise("failed").alias("status"))
    return known.unionByName(called)


@query("p13_textbook_scope", "SELECT subject_id, coalesce(chapter_no, 'unassigned') AS chapter_no, count(*) AS points FROM kp GROUP BY ALL")
def _(v):
    return learning.textbook_scope(v.kp).groupBy("subject_id", "chapter_no").agg(F.count(F.lit(1)).alias("points"))


@query("p14_textbook_backfill", "SELECT upload_id, kp_id, row_number() OVER (PARTITION BY upload_id ORDER BY CASE WHEN chapter_no IS NULL THEN 'zzzz' ELSE lpad(split_part(chapter_no, '.', 1), 10, '0') || '.' || lpad(split_part(chapter_no, '.', 2), 10, '0') END, kp_id) AS sort_order FROM (SELECT DISTINCT upload_id, published_id AS kp_id FROM staging WHERE published_id IS NOT NULL) JOIN kp USING (kp_id)")
def _(v):
    published = v.staging.where("published_id IS NOT NULL").select("upload_id", F.col("published_id").alias("kp_id")).distinct()
    return learning.textbook_scope(published.join(v.kp, "kp_id"), "upload_id").select("upload_id", "kp_id", "sort_order")


def _organised(v):
    s = F.col("staging_id")
    points = v.spark.createDataFrame([(1, 0, "alpha", "alpha beta"), (2, 0, "gamma", "gamma delta")], "kp_id int, grp int, name string, search_text string")
    kind = F.when(F.col("entity_kind") == "question", "question").otherwise("method_card")
    said = F.when(s % 4 == 0, "about alpha").when(s % 4 == 1, "gamma rays").when(s % 4 == 2, "扫码加群 alpha").otherwise("qqq")
    rows = v.staging.select(s.alias("item_id"), F.lit(0).alias("grp"), kind.alias("kind"), said.alias("item_text"), F.lit("").alias("hint"))
    return ingest.organise(rows, points, "grp")


@query("p15_organise", "SELECT CAST(CASE WHEN staging_id % 4 = 0 THEN 1 ELSE 2 END AS INTEGER) AS kp_id, count(*) FILTER (WHERE entity_kind <> 'question') AS cards, count(*) FILTER (WHERE entity_kind = 'question') AS questions FROM staging WHERE staging_id % 4 < 2 GROUP BY 1")
def _(v):
    threads, _, _ = _organised(v)
    return threads.select("kp_id", F.size("method_cards").cast("long").alias("cards"), F.size("questions").cast("long").alias("questions"))


@query("p15b_filtered_summary", "SELECT 'filtered' AS part, count(*) AS n FROM staging WHERE staging_id % 4 = 2 UNION ALL SELECT 'unmapped', count(*) FROM staging WHERE staging_id % 4 = 3")
def _(v):
    _, unmapped, filtered = _organised(v)
    return filtered.select(F.lit("filtered").alias("part"), "n").unionByName(unmapped.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("unmapped")).select("part", "n"))


#: A page's fate by the stand-in client: cached, failed to the end after two waits of two seconds, or answered.
_PAGES_SQL = """paged AS (SELECT upload_id, staging_id, payload, payload IN (SELECT payload FROM staging WHERE staging_id % 3 = 0) AS cached, sha256(payload) AS d FROM staging WHERE payload IS NOT NULL),
fate AS (SELECT *, NOT cached AND ((instr('0123456789abcdef', substr(d, 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(d, 2, 1)) - 1) % 10 = 0 AS failed, row_number() OVER (PARTITION BY upload_id ORDER BY staging_id) - 1 AS n FROM paged)"""


@query("p16_page_map_reduce", f"WITH {_PAGES_SQL} SELECT upload_id, CAST(n // 64 AS INTEGER) AS part, coalesce(string_agg(CASE WHEN cached THEN 'known' ELSE '{{\"answer\": \"' || substr(d, 1, 8) || '\"}}' END, '|' ORDER BY n) FILTER (WHERE NOT failed), '') AS text, count(*) AS pages, count(*) FILTER (WHERE failed) AS failed, count(*) FILTER (WHERE cached) AS cached, CAST(sum(CASE WHEN cached THEN 0 WHEN failed THEN 3 ELSE 1 END) AS BIGINT) AS tries, CAST(sum(CASE WHEN failed THEN 4000 ELSE 0 END) AS BIGINT) AS waited_ms FROM fate GROUP BY upload_id, n // 64")
def _(v):
    """Pages are asked by a bounded number of calls, tried again as the answers say, and put together in order, 64 to a row."""
    pages = v.staging.select("upload_id", "staging_id", F.col("payload").alias("prompt"))
    cache = pages.where("staging_id % 3 = 0").select(F.sha2("prompt", 256).alias("key"), F.lit("known").alias("text"))
    asked, _ = model_calls.page_map(pages.where("prompt IS NOT NULL"), cache, model_calls.stub_client, scheduling.Schedule(sleep=scheduling.no_wait))
    sums = [F.count_if(~F.col("ok")).alias("failed"), F.count_if("cached").alias("cached"), F.sum("tries").alias("tries"), F.sum("waited_ms").alias("waited_ms")]
    return ingest.ordered_parts(asked, "upload_id", "staging_id", F.col("text"), "|", ingest.PART_PAGES, *sums)


@query("p17_read_through", "SELECT CAST(staging_id AS VARCHAR) AS key, staging_id % 3 = 0 AS cached FROM staging")
def _(v):
    key = F.col("staging_id").cast("string")
    cache = v.staging.where("staging_id % 3 = 0").select(key.alias("key"), F.lit("known").alias("text"))
    client = lambda p: {"ok": True, "http_status": 200, "text": "new"}
    answers, _ = model_calls.read_through(v.staging.select(key.alias("key"), key.alias("prompt")), cache, lambda misses: model_calls.call(misses, "prompt", client))
    return answers.select("key", "cached")


@query("p18_publish", "SELECT staging_id, CASE WHEN review_status = 'pending' AND staging_id % 9 > 0 THEN 'accepted' ELSE review_status END AS review_status, CASE WHEN staging_id % 9 = 0 THEN 'page' ELSE '' END AS problems FROM staging")
def _(v):
    problems = core.violations((F.get_json_object("payload", "$.page").cast("int") < 1, "page"))
    return ingest.publish(v.staging, F.col("review_status") == "pending", problems)[1]


@query("p19_bulk_publish", f"WITH {HINTS_SQL} SELECT staging_id, kp_id, CASE WHEN kp_id IS NULL THEN 'no_knowledge_point' ELSE '' END AS skip, greatest(1, least(5, CASE WHEN staging_id % 5 = 0 THEN 0 ELSE staging_id % 6 END)) AS difficulty FROM staging LEFT JOIN (SELECT h.hint_id, m.kp_id FROM hints h JOIN matched m USING (subject_id, h) WHERE hint_id % 3 > 0) ON hint_id = staging_id")
def _(v):
    """Two thirds of the staged rows come with a hint; the others, and those without a match, are left out for a reason."""
    found = fuzzy.match_hints(name_hints(v).where("hint_id % 3 > 0"), v.kp).select("hint_id", "kp_id")
    rows = v.staging.join(found, F.col("staging_id") == F.col("hint_id"), "left")
    level = F.coalesce(F.get_json_object("payload", "$.difficulty").try_cast("int"), F.lit(0))
    return rows.select("staging_id", "kp_id", F.when(F.col("kp_id").isNull(), "no_knowledge_point").otherwise("").alias("skip"), F.greatest(F.lit(1), F.least(F.lit(5), level)).alias("difficulty"))


@query("p20_job_outcome", "SELECT upload_id, CASE WHEN bool_or(staging_id % 7 = 0) AND sum(CASE WHEN review_status = 'accepted' THEN 1 ELSE 0 END) = 0 THEN 'failed' ELSE 'parsed' END AS job_status, CASE WHEN NOT bool_or(staging_id % 7 = 0) THEN 'ok' WHEN sum(CASE WHEN review_status = 'accepted' THEN 1 ELSE 0 END) = 0 THEN 'failed' ELSE 'partial' END AS analysis_status FROM staging GROUP BY upload_id")
def _(v):
    rows = v.staging.select("upload_id", F.when(F.col("review_status") == "accepted", 1).otherwise(0).alias("staged"), F.when(F.col("staging_id") % 7 == 0, "bad page").alias("reason"))
    return ingest.outcome(rows, "upload_id")


@query("p21_session_history", "SELECT student_id, session_id, started_at, ended_at, answers, right_answers, CAST(floor(100.0 * right_answers / answers + 0.5) AS INTEGER) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY ended_at DESC, session_id) AS n FROM (SELECT student_id, session_id, min(answered_at) AS started_at, max(answered_at) AS ended_at, count(*) AS answers, count(*) FILTER (WHERE is_correct) AS right_answers FROM attempt GROUP BY student_id, session_id)) WHERE n <= 20")
def _(v):
    """A learner's last 20 sessions, which is the feature's own limit."""
    answers = F.count(F.lit(1)).alias("answers")
    right = F.count_if("is_correct").alias("right_answers")
    rows = v.attempt.groupBy("student_id", "session_id").agg(F.min("answered_at").alias("started_at"), F.max("answered_at").alias("ended_at"), answers, right)
    share = F.floor(F.col("right_answers") / F.col("answers") * 100 + 0.5).cast("int").alias("accuracy")
    return core.top_k(rows, ["student_id"], [F.col("ended_at").desc(), "session_id"], 20).select("student_id", "session_id", "started_at", "ended_at", "answers", "right_answers", share)


@query("p22_upload_history", "SELECT u.upload_id, max_by(s.review_status, s.staging_id) AS last_status, count(s.staging_id) AS staged FROM (SELECT upload_id FROM upload ORDER BY upload_id DESC LIMIT 10) u LEFT JOIN staging s USING (upload_id) GROUP BY u.upload_id")
def _(v):
    return ingest.latest_job(v.upload, v.staging, "upload_id")


@query("p23_phase_mix", """WITH n AS (SELECT student_id, count(a.attempt_id) AS n FROM student LEFT JOIN attempt a USING (student_id) GROUP BY student_id),
p AS (SELECT student_id, CASE WHEN n < 5 THEN 'cold_start' WHEN days <= 14 THEN 'before_exam' WHEN days <= 45 THEN 'consolidation' ELSE 'learning' END AS phase FROM n, (SELECT date_diff('day', CAST(now AS DATE), DATE '2024-03-01') AS days FROM now_at)),
slots(phase, pool, slots) AS (VALUES ('cold_start', 'new_knowledge', 8), ('cold_start', 'mistake_variant', 0), ('cold_start', 'spaced_review', 0), ('learning', 'new_knowledge', 4), ('learning', 'mistake_variant', 2), ('learning', 'spaced_review', 2),
 ('consolidation', 'new_knowledge', 2), ('consolidation', 'mistake_variant', 3), ('consolidation', 'spaced_review', 3), ('before_exam', 'new_knowledge', 0), ('before_exam', 'mistake_variant', 5), ('before_exam', 'spaced_review', 3))
SELECT student_id, phase, pool, slots FROM p JOIN slots USING (phase)""")
def _(v):
    return learning.phases(v.student, v.attempt, v.now, F.lit("2024-03-01").cast("timestamp"))


@query("p24_cause_routing", """WITH c AS (SELECT m.student_id, m.question_id, CASE WHEN coalesce(s.mastery_score, 0) >= 0.85 THEN 'slip' WHEN coalesce(s.peak_mastery_score, 0) >= 0.5 AND coalesce(s.mastery_score, 0) < 0.2 THEN 'relapse' WHEN coalesce(s.peak_mastery_score, 0) < 0.2 THEN 'gap' WHEN m.error_count >= 3 THEN 'stubborn' ELSE 'weak' END AS cause
 FROM mistake m JOIN question q USING (question_id) LEFT JOIN mastery s ON s.student_id = m.student_id AND s.kp_id = q.primary_kp)
SELECT *, CASE cause WHEN 'slip' THEN 'slow_down' WHEN 'relapse' THEN 'recall' WHEN 'gap' THEN 'relearn' WHEN 'stubborn' THEN 'explain_back' ELSE 'practise' END AS action FROM c""")
def _(v):
    scores = learning.mastery(v.graded).select("student_id", "kp_id", "mastery_score", "peak_mastery_score")
    return learning.causes(v.graded, learning.mistakes(v.attempt).select("student_id", "question_id", "error_count"), scores)


def _ingested(uploads):
    body = lambda p: {"ok": True, "http_status": 200, "text": 'x {"learning_materials":[{"title":"易错 ' + p + '","content":"c"},{"name":"n"}]} y'}
    called = model_calls.call(uploads.select("upload_id", F.col("upload_id").cast("string").alias("prompt")), "prompt", body)
    return ingest.materials_of(ingest.parse_batch(called), "upload_id")


def _point_run(v):
    """A run over all documents: their lines are pages, a stand-in client names points. It is killed once and taken up again."""
    uploads = v.table("documents").select(F.col("doc_id").alias("upload_id"), "text")
    jobs = uploads.select(F.col("upload_id").alias("job_id"), "upload_id")
    none = v.spark.createDataFrame([], "key string, text string")
    path = shared.fresh_folder(v.spark)
    make = lambda: ingest_run.Run(jobs, ingest_run.text_pages(uploads, F.col("text")), none, ingest_run.stub_points, path, scheduling.Schedule(retries=1, sleep=scheduling.no_wait))
    make().run("parsed")
    again = make()
    again.run("done")
    return again


@query("p25_analysis_result", f"WITH {ingest_run.RUN_SQL}, seen AS (SELECT upload_id, count(*) AS pages, 2 * count(*) FILTER (WHERE reason IS NULL) AS candidates, count(*) FILTER (WHERE reason = 'call') AS call_failures, count(*) FILTER (WHERE reason = 'parse') AS parse_failures, min(page) FILTER (WHERE reason = 'call') AS first_call_failure, min(page) FILTER (WHERE reason = 'parse') AS first_parse_failure FROM fate GROUP BY upload_id), found AS (SELECT upload_id, count(*) AS points FROM named GROUP BY upload_id) SELECT u.upload_id AS job_id, CASE WHEN points IS NULL THEN 'failed' WHEN call_failures + parse_failures > 0 THEN 'partial' ELSE 'ok' END AS status, CASE upload_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'word' ELSE 'image' END AS source_type, source || ['.pdf', '.DOCX', '.png'][CAST(upload_id % 3 + 1 AS INTEGER)] AS source_name, coalesce(pages, 0) AS page_count, coalesce(candidates, 0) AS candidates, coalesce(points, 0) AS output_points, coalesce(call_failures, 0) AS call_failures, coalesce(parse_failures, 0) AS parse_failures, CAST(first_call_failure AS INTEGER) AS first_call_failure, CAST(first_parse_failure AS INTEGER) AS first_parse_failure, CASE WHEN points IS NULL THEN CASE WHEN pages IS NULL THEN 'no pages' WHEN call_failures + parse_failures = pages THEN 'all pages failed' ELSE 'no knowledge points' END END AS parse_error FROM (SELECT doc_id AS upload_id, source FROM documents) u LEFT JOIN seen USING (upload_id) LEFT JOIN found USING (upload_id)")
def _(v):
    """Results of a run over all documents, whose files are of three kinds."""
    suffix = F.element_at(F.array(F.lit(".pdf"), F.lit(".DOCX"), F.lit(".png")), (F.col("doc_id") % 3 + 1).cast("int"))
    files = v.table("documents").select(F.col("doc_id").alias("upload_id"), F.concat("source", suffix).alias("name"))
    return ingest_run.analysis_results(_point_run(v), files)


@query("p26_point_ingestion", f"WITH {ingest_run.RUN_SQL}, seen AS (SELECT upload_id, count(*) AS pages, count(*) FILTER (WHERE reason IS NULL) AS pages_done, count(*) FILTER (WHERE reason IS NOT NULL) AS pages_failed FROM fate GROUP BY upload_id), found AS (SELECT upload_id, count(*) AS points FROM named GROUP BY upload_id) SELECT doc_id AS job_id, CASE WHEN points IS NULL THEN 'failed' ELSE 'succeeded' END AS status, coalesce(pages, 0) AS pages, coalesce(pages_done, 0) AS pages_done, coalesce(pages_failed, 0) AS pages_failed, coalesce(points, 0) AS points, CASE WHEN points IS NULL THEN CASE WHEN pages IS NULL THEN 'no pages' WHEN pages_failed = pages THEN 'all pages failed' ELSE 'no knowledge points' END END AS error FROM documents LEFT JOIN seen ON seen.upload_id = doc_id LEFT JOIN found ON found.upload_id = doc_id")
def _(v):
    return _point_run(v).table("done").select("job_id", "status", "pages", "pages_done", "pages_failed", "points", "error")


@query("p26_staged_points", f"WITH {ingest_run.RUN_SQL} SELECT upload_id, CAST(row_number() OVER (PARTITION BY upload_id ORDER BY spot, name) AS INTEGER) AS place, name, CAST(spot // 2 AS INTEGER) AS page FROM named")
def _(v):
    return _point_run(v).table("staged").select("upload_id", F.col("position").alias("place"), "name", "page")


@query("p27_resource_ingestion", "SELECT upload_id, CASE WHEN i = 0 THEN 'common_mistake' ELSE 'concept_explanation' END AS material_type FROM upload, (SELECT unnest([0, 1]) AS i)")
def _(v):
    return _ingested(v.upload).select("upload_id", "material_type")


@query("p28_rerun", f"WITH {RERUN_SQL} SELECT s.staging_id, sha256(coalesce(n.content, s.payload)) AS payload, f.new_id AS lineage, CAST(f.tier AS INTEGER) AS tier FROM staging s LEFT JOIN found f ON f.old_id = s.staging_id LEFT JOIN n ON n.new_id = f.new_id WHERE s.staging_id % 96 < 48")
def _(v):
    """Each old row takes the payload of the new row that its rerun matches, and keeps which one that was and how it was found."""
    old, new = rerun_rows(v)
    # what is asked for is the payloads' digests: rows are digested where they are read
    kept = v.staging.select(F.col("staging_id").alias("old_id"), F.sha2("payload", 256).alias("payload")).where("old_id % 96 < 48")
    rows = ingest.take_rerun(kept, new.select("new_id", F.sha2("content", 256).alias("new_payload")), fuzzy.rerun_match(old, new))
    return rows.select(F.col("old_id").alias("staging_id"), "payload", "lineage", "tier")


@query("p29_reject", "SELECT staging_id, CASE WHEN review_status = 'pending' AND upload_id = 7 THEN 'rejected' ELSE review_status END AS review_status FROM staging")
def _(v):
    return core.update_where(v.staging, (F.col("review_status") == "pending") & (F.col("upload_id") == 7), {"review_status": F.lit("rejected")}).select("staging_id", "review_status")


@query("p30_source_once", "SELECT upload_id, min(staging_id) AS staging_id FROM staging s WHERE entity_kind = 'source_document' AND upload_id NOT IN (SELECT upload_id FROM staging WHERE entity_kind = 'source_document' AND published_id IS NOT NULL) GROUP BY upload_id")
def _(v):
    return ingest.once_per_upload(v.staging)


@query("p31_provenance", "SELECT published_id AS question_id, upload_id, max(staging_id) AS staging_id FROM staging WHERE published_id IS NOT NULL GROUP BY ALL")
def _(v):
    return v.staging.where("published_id IS NOT NULL").groupBy(F.col("published_id").alias("question_id"), "upload_id").agg(F.max("staging_id").alias("staging_id"))


@query("p32_point_publish", "SELECT subject_id, name FROM kp UNION SELECT upload_id % 2, 'new ' || (upload_id % 3) FROM upload")
def _(v):
    wanted = v.upload.select((F.col("upload_id") % 2).cast("int").alias("subject_id"), F.concat(F.lit("new "), (F.col("upload_id") % 3).cast("string")).alias("name")).distinct()
    known = v.kp.select(F.col("subject_id").cast("int"), "name")
    return known.unionByName(wanted.join(known, ["subject_id", "name"], "left_anti"))


def _told(v):
    """Sessions with a state: every fourth is in progress."""
    return v.session.withColumn("status", F.when(F.col("session_id") % 4 == 1, "in_progress").otherwise("completed"))


@query("p33_answer_view", "SELECT session_id, CAST(i - 1 AS INTEGER) AS pos, question_id, stem, difficulty, CASE WHEN question_id % 5 = 0 THEN 'A=' || stem || '|B=none' WHEN question_type = 'choice' THEN 'A=A|B=B|C=C|D=D' ELSE '' END AS options, CASE WHEN question_id % 5 = 0 THEN 'f' || question_id ELSE '' END AS figures FROM (SELECT *, unnest(range(1, len(question_ids) + 1)) AS i FROM session WHERE session_id % 4 = 1) s JOIN question q ON q.question_id = s.question_ids[i] WHERE (primary_kp + student_id) % 3 <> 0")
def _(v):
    """Questions of running sessions with options and figures; every fifth question has its own."""
    options = F.array(F.struct(F.lit("A").alias("label"), F.col("stem").alias("text")), F.struct(F.lit("B").alias("label"), F.lit("none").alias("text")))
    metadata = v.question.where("question_id % 5 = 0").select("question_id", options.alias("options"), F.array(F.concat(F.lit("f"), F.col("question_id").cast("string"))).alias("figures"))
    rows = learning.answer_view(_told(v), v.question, v.unlocked, metadata)
    shown = F.array_join(F.transform("options", lambda o: F.concat(o["label"], F.lit("="), o["text"])), "|")
    return rows.select("session_id", "pos", "question_id", "stem", "difficulty", shown.alias("options"), F.array_join("figures", ",").alias("figures"))


@query("p34_result_view", f"WITH {_PLAN}, a AS (SELECT a.*, EXISTS (SELECT 1 FROM mistake m WHERE m.student_id = a.student_id AND m.question_id = a.question_id AND m.resolved_at BETWEEN s.started_at AND s.ended_at) AS solved FROM attempt a JOIN session s USING (session_id, student_id) JOIN question q ON q.question_id = a.question_id WHERE session_id % 4 <> 1 AND (q.primary_kp + a.student_id) % 3 <> 0), d AS (SELECT *, solved AND bool_or(is_correct) OVER (PARTITION BY session_id, question_id) AS done FROM a), t AS (SELECT session_id, string_agg(question_id || ':' || CAST(is_correct AS INTEGER) || ':' || CAST(done AS INTEGER), ',' ORDER BY answered_at, attempt_id) AS attempts, count(*) FILTER (WHERE is_correct) AS right_answers, count(DISTINCT CASE WHEN done THEN question_id END) AS resolved FROM d GROUP BY session_id) SELECT session_id, attempts, right_answers, resolved, CASE WHEN resolved > 0 THEN '本次攻克 ' || resolved || ' 道历史错题' END AS headline, CASE WHEN weak > 0 THEN '先把“' || first_name || '”补牢' WHEN weak = 0 THEN '这次整体不错，顺手复习“' || first_name || '”' END AS plan FROM t LEFT JOIN rp USING (session_id)")
def _(v):
    """Completed sessions: answers in order, mistakes resolved in them, and the plan that follows."""
    found = learning.result_view(_told(v), v.attempt, v.question, v.unlocked, learning.mistakes(v.attempt), learning.review_plan(groups(v), v.kp))
    mark = lambda c: c.cast("int").cast("string")
    shown = F.array_join(F.transform("attempts", lambda x: F.concat_ws(":", x["question_id"].cast("string"), mark(x["is_correct"]), mark(x["resolved"]))), ",")
    return found.select("session_id", shown.alias("attempts"), "right_answers", "resolved", "headline", "plan")


@query("p35_advice_context", "SELECT a.session_id, a.attempt_id, epoch_us(s.started_at) AS started_us, q.stem, kp.name, m.error_count, round(coalesce(my.mastery_score, 0), 6) AS mastery, coalesce(c.n, 0) AS materials FROM attempt a JOIN session s USING (session_id) JOIN question q USING (question_id) JOIN kp ON kp.kp_id = q.primary_kp LEFT JOIN mistake m ON m.student_id = a.student_id AND m.question_id = a.question_id LEFT JOIN mastery my ON my.student_id = a.student_id AND my.kp_id = kp.kp_id LEFT JOIN (SELECT kp_id, count(*) AS n FROM material GROUP BY kp_id) c ON c.kp_id = kp.kp_id")
def _(v):
    """Each answer of a session with its question, point, mistake, mastery and number of materials: one join a relation, for all sessions."""
    rows = v.attempt.select("attempt_id", "session_id", "student_id", "question_id").join(v.session.select("session_id", "started_at"), "session_id")
    rows = rows.join(v.question.select("question_id", "stem", F.col("primary_kp").alias("kp_id")), "question_id").join(v.kp.select("kp_id", "name"), "kp_id")
    rows = rows.join(learning.mistakes(v.attempt).select("student_id", "question_id", "error_count"), ["student_id", "question_id"], "left")
    rows = rows.join(learning.mastery(v.graded).select("student_id", "kp_id", "mastery_score"), ["student_id", "kp_id"], "left")
    rows = rows.join(v.material.groupBy("kp_id").agg(F.count(F.lit(1)).alias("n")), "kp_id", "left")
    return rows.select("session_id", "attempt_id", F.unix_micros("started_at").alias("started_us"), "stem", "name", "error_count", F.round(F.coalesce("mastery_score", F.lit(0.0)), 6).alias("mastery"), F.coalesce("n", F.lit(0)).alias("materials"))


@query("p36_mistake_book", "SELECT m.student_id, m.question_id, kp.name, epoch_us(m.last_at) AS last_us, substr(q.stem, 1, 57) AS preview FROM mistake m JOIN question q USING (question_id) JOIN kp ON kp.kp_id = q.primary_kp JOIN unlocked u ON u.student_id = m.student_id AND u.kp_id = kp.kp_id WHERE m.status = 'open'")
def _(v):
    rows = learning.mistakes(v.attempt).where("status = 'open'").join(v.question.select("question_id", F.col("primary_kp").alias("kp_id"), "stem"), "question_id")
    rows = rows.join(v.kp.select("kp_id", "name"), "kp_id").join(v.unlocked, ["student_id", "kp_id"], "left_semi")
    return rows.select("student_id", "question_id", "name", F.unix_micros("last_at").alias("last_us"), text.truncate(F.col("stem"), 57).alias("preview"))


@query("p37_redo_view", "SELECT m.student_id, m.question_id, q.stem FROM mistake m JOIN question q USING (question_id) WHERE m.status = 'open' AND m.student_id = 8")
def _(v):
    return learning.mistakes(v.attempt).where("status = 'open' AND student_id = 8").join(v.question, "question_id").select("student_id", "question_id", "stem")


def question_list(v, subject=None, most=500):
    """The first questions by point, newest first, with their point and options; a subject is kept of those, not looked for beyond."""
    rows = v.question.orderBy("primary_kp", F.col("created_at").desc(), "question_id").limit(most)
    rows = rows.join(v.kp.withColumnRenamed("kp_id", "primary_kp"), "primary_kp", "left")
    options = F.get_json_object("payload", "$.options")
    staged = v.staging.where("entity_kind = 'question'").select(F.col("published_id").alias("question_id"), options.alias("options"), "staging_id").where("question_id IS NOT NULL AND startswith(options, '[') AND options <> '[]'")
    rows = rows.join(staged.groupBy("question_id").agg(F.max_by("options", "staging_id").alias("options")), "question_id", "left")
    rows = rows if subject is None else rows.where(F.col("subject_id") == subject)
    return rows.select(F.col("primary_kp").alias("kp_id"), "name", "subject_id", "chapter_no", "question_id", "stem", "question_type", "difficulty", "created_at", "options")


@query("p38_question_list", "SELECT q.primary_kp AS kp_id, kp.name, kp.subject_id, kp.chapter_no, q.question_id, q.stem, q.question_type, q.difficulty, q.created_at, o.options FROM (SELECT * FROM question ORDER BY primary_kp, created_at DESC, question_id LIMIT 500) q LEFT JOIN kp ON kp.kp_id = q.primary_kp LEFT JOIN (SELECT published_id AS question_id, max_by(json_extract(payload, '$.options')::VARCHAR, staging_id) AS options FROM staging WHERE entity_kind = 'question' AND published_id IS NOT NULL AND json_extract(payload, '$.options')::VARCHAR LIKE '[_%]' GROUP BY published_id) o USING (question_id)")
def _(v):
    return question_list(v)


@query("p39_point_list", "SELECT kp.kp_id, coalesce(q.n, 0) AS questions, coalesce(s.n, 0) AS students FROM kp LEFT JOIN (SELECT kp_id, count(*) AS n FROM (SELECT unnest(kp_ids) AS kp_id FROM question) GROUP BY kp_id) q USING (kp_id) LEFT JOIN (SELECT kp_id, count(*) AS n FROM unlocked GROUP BY kp_id) s USING (kp_id)")
def _(v):
    q = v.question.select(F.explode("kp_ids").alias("kp_id")).groupBy("kp_id").agg(F.count(F.lit(1)).alias("q"))
    s = v.unlocked.groupBy("kp_id").agg(F.count(F.lit(1)).alias("s"))
    return v.kp.join(q, "kp_id", "left").join(s, "kp_id", "left").select("kp_id", F.coalesce("q", F.lit(0)).alias("questions"), F.coalesce("s", F.lit(0)).alias("students"))


@query("p40_student_list", "SELECT student_id, count(*) AS unlocked FROM unlocked GROUP BY student_id")
def _(v):
    return v.unlocked.groupBy("student_id").agg(F.count(F.lit(1)).alias("unlocked"))


@query("p41_active_textbook", "SELECT student_id, CASE student_id % 4 WHEN 1 THEN 1 ELSE 0 END AS place FROM student")
def _(v):
    raw = F.element_at(F.array(*map(F.lit, ("0", "1", "9", "x"))), (F.col("student_id") % 4 + 1).cast("int")).try_cast("int")
    return v.student.select("student_id", F.when(raw.between(0, 1), raw).otherwise(0).alias("place"))


@query("p42_default_scope", "SELECT kp_id, 'default' AS textbook FROM kp WHERE subject_id = 0")
def _(v):
    return learning.textbook_scope(v.kp.where("subject_id = 0")).select("kp_id", F.lit("default").alias("textbook"))


@query("p43_analysis_entry", "SELECT upload_id, count(*) AS materials FROM upload, (SELECT unnest([0, 1]) AS i) GROUP BY upload_id")
def _(v):
    return _ingested(v.upload).groupBy("upload_id").agg(F.count(F.lit(1)).alias("materials"))


@query("p44_question_entry", f"SELECT material_id, pos, CASE pos WHEN 0 THEN 'choice' ELSE 'solution' END AS kind, CASE WHEN pos = 0 AND opts THEN 'A:first,B:' ELSE '' END AS options FROM (SELECT material_id, trim(coalesce({SAID_SQL}, '')) <> '' AS filled, regexp_matches(lower({SAID_SQL}), '{TELLS_SQL}') AS tells, regexp_matches(replace({SAID_SQL}, '选择题', ''), '{ASKS_SQL}') AS asks, material_id % 7 = 0 AS opts FROM material WHERE title IS NOT NULL), (SELECT unnest([0, 1, 2]) AS pos) WHERE CASE pos WHEN 0 THEN (filled OR opts) AND (NOT tells OR asks OR opts) WHEN 1 THEN material_id % 3 = 0 ELSE material_id % 5 = 0 END")
def _(v):
    """Answers of a model over whole texts: a question or what looks like one, a heading unless it asks, and a sub-question."""
    k, title = F.col("material_id") % 6, F.col("title")
    said = F.when(k == 0, F.concat(title, F.lit(" 扫码加群"))).when(k == 1, F.concat(F.lit("例题：要求 "), title)).when(k == 2, F.concat(F.lit("题型一 "), title, F.lit(" ?"))).when(k == 3, "选择题 知识点").when(k == 4, "").otherwise(title)
    options = F.when(F.col("material_id") % 7 == 0, F.array(F.lit("A. first"), F.lit("B")))
    sub = F.array(F.struct(F.lit("1").alias("number"), F.lit("s").alias("stem")))
    one = F.to_json(F.struct(said.alias("stem"), F.lit("单选").alias("type"), options.alias("options")))
    two = F.to_json(F.struct(F.when(F.col("material_id") % 3 == 0, "方法总结：求和").otherwise("方法总结").alias("content"), F.lit("解答").alias("type")))
    three = F.to_json(F.struct(F.lit("知识点").alias("stem"), F.lit("计算").alias("question_type"), F.when(F.col("material_id") % 5 == 0, sub).alias("sub_questions")))
    body = F.concat(F.lit('{"questions":['), one, F.lit(","), two, F.lit(","), three, F.lit("]}"))
    answers = v.material.where("title IS NOT NULL").select("material_id", body.alias("text"))
    found = ingest.questions_of(ingest.parse_batch(answers), "material_id")
    return found.select("material_id", "pos", "kind", F.array_join(F.transform("options", lambda o: F.concat(o["label"], F.lit(":"), o["text"])), ",").alias("options"))


@query("p45_review_queue", "SELECT upload_id, entity_kind, count(*) FILTER (WHERE review_status = 'pending') AS pending, count(*) FILTER (WHERE review_status = 'accepted') AS accepted, count(*) FILTER (WHERE review_status = 'rejected') AS rejected FROM staging GROUP BY ALL")
def _(v):
    return ingest.review_queue(v.staging)


@query("p46_advice_call", "SELECT session_id, CASE WHEN session_id % 3 = 0 THEN 'failed' WHEN session_id % 3 = 1 THEN 'partial' ELSE 'ok' END AS status FROM session")
def _(v):
    client = lambda p: {"ok": int(p) % 3 > 0, "http_status": 200 if int(p) % 3 else 400, "text": '{"headline":"h"}' if int(p) % 3 == 2 else "plain"}
    called = model_calls.call(v.session.select("session_id", F.col("session_id").cast("string").alias("prompt")), "prompt", client)
    parsed = ingest.parse_batch(called)
    return parsed.select("session_id", F.when(~F.col("ok"), "failed").when(F.col("error").isNotNull(), "partial").otherwise("ok").alias("status"))


def _stream(v, frames, start, mode="update"):
    """Run a stream over written copies of frames, one after another, and return what it wrote.

    After each frame the stream ends; the next one starts again from the
    checkpoint, with the state and the watermark that the last one left.
    """
    key = "spark.sql.streaming.stateStore.providerClass"
    before = v.spark.conf.get(key, None)
    v.spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = shared.fresh_folder(v.spark)
    out, schema = sink.BatchSink(v.spark, f"{path}/out"), None
    try:
        for frame in frames:
            frame.write.mode("append").parquet(f"{path}/in")
            started = start(v.spark.readStream.schema(frames[0].schema).parquet(f"{path}/in"))
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in started.schema.fields)
            writer = started.writeStream.foreachBatch(out.write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
            writer.outputMode(mode).start().awaitTermination()
    finally:
        v.spark.conf.set(key, before) if before else v.spark.conf.unset(key)
    for part in ("in", "state"):
        shared.drop(v.spark, f"{path}/{part}")
    return out.read(schema)


def _halves(frame, column):
    """The rows of even and of odd columns as two frames of a stream."""
    return [frame.where(F.col(column) % 2 == k) for k in (0, 1)]


@query("t1_learner_stream", "SELECT student_id, primary_kp AS kp_id, CAST(round(mastery_score * 100) AS INTEGER) AS score FROM (SELECT DISTINCT student_id, primary_kp FROM graded) JOIN mastery m USING (student_id) WHERE m.kp_id = primary_kp")
def _(v):
    rows = v.graded.select("student_id", "attempt_id", "answered_at", F.col("primary_kp").cast("int").alias("primary_kp"), F.col("question_id").cast("long").alias("question_id"), F.col("difficulty").cast("int").alias("difficulty"), "is_correct")
    out = _stream(v, [rows.where("answered_at < '2024-01-15'"), rows.where("answered_at >= '2024-01-15'")], attempts.learner_states)
    return out.groupBy("student_id", "kp_id").agg(F.max_by("score", "batch").alias("score"))


@query("t2_replay_guard", "SELECT session_id, 1 AS times FROM attempt GROUP BY session_id")
def _(v):
    """Every session is handed in by each of its answers, and a second time after a restart; one stays."""
    rows = v.attempt.select("session_id", F.col("answered_at").alias("ts"))
    out = _stream(v, [rows, rows], lambda s: attempts.once(s, late="60 days"))
    return out.groupBy("session_id").agg(F.count(F.lit(1)).cast("int").alias("times"))


@query("t3_serial_writes", "SELECT student_id AS key, attempt_id AS write_id, row_number() OVER (PARTITION BY student_id ORDER BY answered_at < TIMESTAMP '2024-01-15' DESC, answered_at, attempt_id) AS number FROM attempt")
def _(v):
    rows = v.attempt.select(F.col("student_id").cast("long").alias("key"), F.col("attempt_id").cast("long").alias("write_id"), F.col("answered_at").alias("ts"))
    return _stream(v, [rows.where("ts < '2024-01-15'"), rows.where("ts >= '2024-01-15'")], attempts.serial_writes, "append").select("key", "write_id", "number")


@query("t4_job_snapshot", "SELECT upload_id AS job_id, max_by(review_status, staging_id) AS phase, max_by(staging_id % 100, staging_id) AS progress FROM staging GROUP BY upload_id")
def _(v):
    events = v.staging.select(F.col("upload_id").alias("job_id"), F.col("staging_id").alias("event_id"), F.col("review_status").alias("phase"), (F.col("staging_id") % 100).alias("progress"), F.col("staging_id").cast("timestamp").alias("ts"))
    out = _stream(v, _halves(events, "event_id"), attempts.job_snapshot)
    return out.groupBy("job_id").agg(F.max_by("phase", "batch").alias("phase"), F.max_by("progress", "batch").alias("progress"))


@query("t5_polling", "SELECT upload_id, count(*) AS staged FROM staging GROUP BY upload_id")
def _(v):
    out = _stream(v, _halves(v.staging.select("upload_id", "staging_id"), "staging_id"), lambda s: s.groupBy("upload_id").agg(F.count(F.lit(1)).alias("staged")))
    return out.groupBy("upload_id").agg(F.max_by("staged", "batch").alias("staged"))


@query("t6_stale_jobs", "SELECT job_id, CASE WHEN status IN ('queued', 'running') AND said < most - 1200 THEN 'failed' ELSE status END AS status FROM (SELECT upload_id % 97 AS job_id, max_by(status, upload_id) AS status, max(upload_id) * 20 AS said FROM upload GROUP BY 1), (SELECT max(upload_id) * 20 AS most FROM upload)")
def _(v):
    """Jobs that say nothing for ten minutes fail; the event clock is ten minutes behind the newest event."""
    events = v.upload.select((F.col("upload_id") % 97).alias("job_id"), (F.col("upload_id") * 20).cast("timestamp").alias("ts"), "status")
    clock = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("job_id"), "ts", F.lit("parsed").alias("status"))
    out = _stream(v, [events, clock], attempts.reap_jobs)
    return out.where("job_id >= 0").groupBy("job_id").agg(F.max_by("status", F.struct("batch", (F.col("status") == "failed").alias("f"))).alias("status"))


@query("t7_due_timer", "SELECT student_id, kp_id, epoch_us(next_review_at) AS due_us FROM review, now_at WHERE next_review_at <= now")
def _(v):
    """Reviews fall due by timers as the event clock runs; at the end it stands at now."""
    learners = v.attempt.agg(F.approx_count_distinct("student_id")).first()[0]
    pages = learners // attempts.LEARNERS + 1
    rows = v.graded.select("student_id", F.col("primary_kp").alias("kp_id"), F.col("answered_at").alias("ts"), "is_correct")
    key = rows.schema["student_id"].dataType
    clock = rows.limit(1).select(F.lit(-1).cast(key).alias("student_id"), F.lit(-1).cast(rows.schema["kp_id"].dataType).alias("kp_id"), (v.now + F.expr("INTERVAL 1 HOUR")).alias("ts"), F.lit(True).alias("is_correct"))
    out = _stream(v, [rows.where("ts < '2024-01-15'"), rows.where("ts >= '2024-01-15'"), clock], lambda s: attempts.due_reviews(s.where(F.col("ts") <= v.now + F.expr("INTERVAL 1 HOUR")), late="1 hour", pages=pages))
    # a batch may fire an old timer and set a new one: what was set stands against what was due before
    last = out.where("student_id >= 0").groupBy("student_id", "kp_id").agg(F.max_by(F.struct("status", "due_us"), F.struct("due_us", "batch", (F.col("status") == "due").alias("f"))).alias("r"))
    return last.where("r.status = 'due'").select("student_id", "kp_id", "r.due_us")


@query("t8_session_timeout", "WITH g AS (SELECT *, CASE WHEN answered_at - lag(answered_at) OVER w >= INTERVAL 25 MINUTE OR lag(answered_at) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM attempt WINDOW w AS (PARTITION BY student_id ORDER BY answered_at, attempt_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY student_id ORDER BY answered_at, attempt_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT student_id, epoch_us(min(answered_at)) AS start_us, count(*) AS answers FROM s GROUP BY student_id, k")
def _(v):
    """A session is written when the watermark passes its end; a last event far ahead ends them all."""
    rows = v.attempt.select("student_id", F.col("answered_at").alias("ts"))
    last = rows.limit(1).select(F.lit(-1).cast(rows.schema["student_id"].dataType).alias("student_id"), F.lit("2100-01-01").cast("timestamp").alias("ts"))
    out = _stream(v, [rows, last], attempts.session_timeouts, "append")
    return out.where("student_id >= 0").select("student_id", F.unix_micros("session_window.start").alias("start_us"), "answers")


@query("t9_windows", "SELECT epoch_us(CAST(d AS TIMESTAMP)) AS start_us, count(*) AS answers, count(*) FILTER (WHERE is_correct) AS \"right\" FROM attempt, (SELECT unnest(range(DATE '2023-12-20', DATE '2024-02-05', INTERVAL 1 DAY)) AS d) WHERE answered_at >= d AND answered_at < d + INTERVAL 7 DAY GROUP BY d")
def _(v):
    rows = v.attempt.select("attempt_id", "is_correct", F.col("answered_at").alias("ts"))
    out = _stream(v, _halves(rows, "attempt_id"), lambda s: attempts.activity(s, late="90 days"))
    last = out.groupBy("window").agg(F.max_by(F.struct("answers", "right"), "batch").alias("r"))
    return last.select(F.unix_micros("window.start").alias("start_us"), "r.answers", "r.right")


@query("t10_watermark", "WITH mark AS (SELECT max(answered_at) - INTERVAL 2 HOUR AS closed FROM attempt WHERE attempt_id % 10 < 9) SELECT epoch_us(CAST(date_trunc('day', answered_at) AS TIMESTAMP)) AS start_us, count(*) AS answers FROM attempt, mark WHERE attempt_id % 10 < 9 OR date_trunc('day', answered_at) + INTERVAL 1 DAY > closed GROUP BY 1")
def _(v):
    """A tenth of the answers comes after the others; those of days that the watermark has closed are too late."""
    rows = v.attempt.select("is_correct", F.col("answered_at").alias("ts"), (F.col("attempt_id") % 10).alias("k"))
    out = _stream(v, [rows.where("k < 9"), rows.where("k = 9")], lambda s: attempts.activity(s, "1 day", "1 day", "2 hours"))
    last = out.groupBy("window").agg(F.max_by("answers", "batch").alias("answers"))
    return last.select(F.unix_micros("window.start").alias("start_us"), "answers")


@query("t11_artifact_ttl", "SELECT material_id FROM material, now_at WHERE created_at < now - INTERVAL 20 DAY")
def _(v):
    return attempts.expired(v.material, v.now, 20).select("material_id")


@query("x1_injected_call", "SELECT kp_id, upper(name) AS text FROM kp")
def _(v):
    client = lambda p: {"ok": True, "http_status": 200, "text": p.upper()}
    return model_calls.call(v.kp.select("kp_id", F.lower("name").alias("prompt")), "prompt", client).select("kp_id", "text")


@query("x2_prompt_callback", "SELECT kp_id, 'point ' || name AS prompt FROM kp")
def _(v):
    builder = lambda row: F.concat(F.lit("point "), row["name"])
    return v.kp.select("kp_id", builder(v.kp).alias("prompt"))


@query("x3_keyed_dedupe", "SELECT min(material_id) AS material_id FROM material GROUP BY title")
def _(v):
    return core.dedupe(v.material, ["title"], ["material_id"]).select("material_id")


@query("x4_parallel_map", "SELECT kp_id, length(name) AS n FROM kp")
def _(v):
    client = lambda p: {"ok": True, "http_status": 200, "text": str(len(p))}
    return model_calls.call(v.kp.select("kp_id", F.col("name").alias("prompt")), "prompt", client, width=2).select("kp_id", F.col("text").cast("int").alias("n"))


@query("x5_cache_rows", "SELECT count(*) AS n FROM kp WHERE kp_id % 2 = 1")
def _(v):
    key = F.col("kp_id").cast("string")
    cache = v.kp.where("kp_id % 2 = 0").select(key.alias("key"), F.lit("c").alias("text"))
    client = lambda p: {"ok": True, "http_status": 200, "text": "t"}
    _, fresh = model_calls.read_through(v.kp.select(key.alias("key"), key.alias("prompt")), cache, lambda m: model_calls.call(m, "prompt", client))
    return fresh.agg(F.count(F.lit(1)).alias("n"))


@query("x6_output_rules", "SELECT kp_id, CASE kp_id % 2 WHEN 0 THEN '§1.2,a' ELSE '§3.4 b' END AS t FROM kp")
def _(v):
    raw = F.when(F.col("kp_id") % 2 == 0, "1-2，a").otherwise("3 - 4 b")
    steps = ["zh_punct_to_ascii", "normalize_chapter_subsection", "prefix_chapter_with_section_sign"]
    return v.kp.select("kp_id", text.normalise_output(raw, steps).alias("t"))


def chained(df, *steps):
    return reduce(lambda d, f: f(d), steps, df)


@query("x7_composition", "SELECT kp_id FROM kp WHERE subject_id = 1 AND chapter_no IS NOT NULL ORDER BY kp_id LIMIT 5")
def _(v):
    return chained(v.kp, lambda d: d.where("subject_id = 1"), lambda d: d.where("chapter_no IS NOT NULL"), lambda d: d.orderBy("kp_id").limit(5)).select("kp_id")


@query("w12_due_by_band", "SELECT CASE WHEN m.mastery_score < 0.2 THEN 'not_started' WHEN m.mastery_score < 0.5 THEN 'needs_work' WHEN m.mastery_score < 0.85 THEN 'learning' ELSE 'mastered' END AS band, count(*) AS n FROM mastery m JOIN review r USING (student_id, kp_id), now_at WHERE next_review_at <= now GROUP BY 1")
def _(v):
    rows = learning.mastery(v.graded).join(attempts.due(learning.reviews(v.graded), v.now), ["student_id", "kp_id"])
    return rows.groupBy(number.mastery_band(F.col("mastery_score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("w13_rank_in_session", "SELECT session_id, question_id, rank() OVER (PARTITION BY session_id ORDER BY n DESC) AS place FROM (SELECT session_id, question_id, count(*) AS n FROM attempt GROUP BY ALL)")
def _(v):
    counted = v.attempt.groupBy("session_id", "question_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("session_id", "question_id", F.rank().over(Window.partitionBy("session_id").orderBy(F.col("n").desc())).alias("place"))
