"""Learner state as folds of the answer log: mastery, mistakes, reviews, planning, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import number, text

#: Material order after a session, for points to work on and for points to review.
WORK_ORDER = ("common_mistake", "method_card", "solution_summary", "question_type_summary", "concept_explanation", "textbook_deep_dive", "exam_trend", "study_advice")
REVIEW_ORDER = ("concept_explanation", "question_type_summary", "method_card", "solution_summary", "common_mistake", "textbook_deep_dive", "exam_trend", "study_advice")
WORK_LIMIT, REVIEW_LIMIT = 5, 3
POOL_SOURCES = {"mistake_variant": "error_review", "spaced_review": "spaced_repetition", "chapter_practice": "new_knowledge", "new_knowledge": "new_knowledge", "feynman_check": "new_knowledge"}


#: Answers that one partial fold takes at most.
FOLD_WIDTH = 1024


def _moved(f: Column, x: Column) -> Column:
    """Score after the answers of a fold that begin at score x."""
    return F.least(f["high"], F.greatest(f["low"], x + f["shift"]))


def then(f: Column, g: Column) -> Column:
    """The fold of f's answers and then g's.

    A fold maps the score x before its answers to that after them, x + shift
    kept within low and high, and to the peak on the way, the greater of top and
    x + rise (at most 100). Both maps are closed under composition, because a
    sum that is the highest so far has lost nothing at the upper end.
    """
    on_the_way = F.greatest(g["top"], F.least(F.lit(100), f["low"] + g["rise"]))
    return F.struct(
        (f["shift"] + g["shift"]).alias("shift"), _moved(g, f["low"]).alias("low"), _moved(g, f["high"]).alias("high"),
        F.greatest(f["rise"], f["shift"] + g["rise"]).alias("rise"), F.greatest(f["top"], on_the_way).alias("top"),
    )


def _one(change: Column) -> Column:
    """The fold of one answer, from its change in hundredths."""
    low = F.greatest(F.lit(0), F.least(F.lit(100), change))
    return F.struct(change.alias("shift"), low.alias("low"), F.greatest(F.lit(0), F.least(F.lit(100), change + 100)).alias("high"), change.alias("rise"), low.alias("top"))


def folded(rows: DataFrame, key: list[str], order: list[str], slot: Column, change: Column, width: int = FOLD_WIDTH) -> DataFrame:
    """(key, fold, n, last) of rows in order: the fold of all changes of a key, their number, the greatest first column of order.

    Rows are dealt by key and slot (a range of the order), numbered there by a
    sort that can spill, and folded in parts of width rows at most; then the
    parts of a key are folded in their order. So no list holds more than width
    answers, or more than a key's slots and its share of parts.
    """
    nothing = F.struct(*[F.lit(v).cast("int").alias(c) for c, v in (("shift", 0), ("low", 0), ("high", 100), ("rise", -1_000_000), ("top", 0))])
    chain = lambda items: F.aggregate(F.transform(F.array_sort(items), lambda x: x["f"]), nothing, then)
    own = rows.select(*key, *order, slot.alias("slot"), _one(change.cast("int")).alias("f"))
    number_ = F.row_number().over(Window.partitionBy(*key, "slot").orderBy(*order))
    parts = own.withColumn("n", number_).withColumn("part", F.floor((F.col("n") - 1) / width)).groupBy(*key, "slot", "part").agg(chain(F.collect_list(F.struct("n", "f"))).alias("f"), F.count(F.lit(1)).alias("n"), F.max(order[0]).alias("last"))
    return parts.groupBy(*key).agg(chain(F.collect_list(F.struct("slot", "part", "f"))).alias("fold"), F.sum("n").alias("n"), F.max("last").alias("last"))


def mastery(graded: DataFrame) -> DataFrame:
    """(student_id, kp_id, mastery_score, peak_mastery_score, attempts, last_at) after all answers in order.

    Scores are folded in whole hundredths, days first and then a learner's days
    at a point, so that a hot learner and point is never one list or one sort.
    """
    key, day = ["student_id", "kp_id"], F.date_trunc("day", "answered_at")
    rows = graded.withColumn("kp_id", F.col("primary_kp"))
    found = folded(rows, key, ["answered_at", "attempt_id"], day, number.mastery_delta(F.col("difficulty"), F.col("is_correct")))
    # learners begin at 0, where the peak on the way is top
    return found.select(*key, (_moved(F.col("fold"), F.lit(0)) / 100.0).alias("mastery_score"), (F.col("fold.top") / 100.0).alias("peak_mastery_score"), F.col("n").alias("attempts"), F.col("last").alias("last_at"))


def mistakes(attempts: DataFrame) -> DataFrame:
    """The mistake book: one row per question a learner got wrong, in closed form.

    A wrong answer opens the row and ends the streak; two right answers after the
    last wrong one resolve it, later right ones change nothing.
    """
    key = ["student_id", "question_id"]
    after = Window.partitionBy(*key).orderBy("attempt_id").rowsBetween(1, Window.unboundedFollowing)
    wrong = ~F.col("is_correct")
    rows = attempts.withColumn("later_wrong", F.coalesce(F.max(wrong.cast("int")).over(after), F.lit(0)))
    tail = F.col("is_correct") & (F.col("later_wrong") == 0)
    out = rows.groupBy(*key).agg(
        F.count_if(wrong).alias("error_count"), F.least(F.lit(2), F.count_if(tail)).alias("streak"), F.array_sort(F.collect_list(F.when(tail, F.col("answered_at")))).alias("right_at"),
        F.min(F.when(wrong, F.col("answered_at"))).alias("created_at"), F.max("answered_at").alias("last_at"),
    ).where("error_count > 0")
    return out.select(*key, "error_count", "streak", F.when(F.col("streak") == 2, "resolved").otherwise("open").alias("status"), F.get("right_at", F.lit(1)).alias("resolved_at"), "created_at", "last_at")


def submit(sessions: DataFrame, answers: DataFrame, scores: DataFrame, due: DataFrame, book: DataFrame) -> dict[str, DataFrame]:
    """The state after sessions are handed in: attempts, mastery, reviews, mistakes and sessions.

    sessions (session_id, student_id, status), answers (session_id, question_id,
    kp_id, difficulty, is_correct, pos, answered_at), and the state before: scores
    (student_id, kp_id, mastery_score, peak_mastery_score), due (student_id,
    kp_id, next_review_at), book (student_id, question_id, error_count, streak,
    status). Only sessions in progress count, so a replay changes nothing.
    Answers move a point's score in their order; a wrong one, or the first
    contact with a point, is due again a day later; a wrong one opens its row of
    the book, two right ones after another resolve an open row.
    """
    point, question = ["student_id", "kp_id"], ["student_id", "question_id"]
    attempts = answers.join(sessions.where("status = 'in_progress'").select("session_id", "student_id"), "session_id")
    in_order = lambda *c: F.array_sort(F.collect_list(F.struct("answered_at", "session_id", "pos", *c)))
    change = number.mastery_delta(F.col("difficulty"), F.col("is_correct")).alias("change")
    moves = attempts.groupBy(*point).agg(in_order(change).alias("moves"), F.max("answered_at").alias("at"), F.max(F.when(~F.col("is_correct"), F.col("answered_at"))).alias("wrong_at"), F.min("answered_at").alias("first_at"))
    moved = moves.join(scores.withColumn("known", F.lit(True)), point, "left")
    whole = lambda c: F.round(F.coalesce(c, F.lit(0.0)) * 100).cast("int")
    start = F.struct(whole("mastery_score").alias("now"), whole("peak_mastery_score").alias("peak"))

    def step(s: Column, x: Column) -> Column:
        now = F.greatest(F.lit(0), F.least(F.lit(100), s["now"] + x["change"]))
        return F.struct(now.alias("now"), F.greatest(s["peak"], now).alias("peak"))

    moved = moved.withColumn("s", F.aggregate("moves", start, step))
    fresh = moved.select(*point, (F.col("s.now") / 100.0).alias("mastery_score"), (F.col("s.peak") / 100.0).alias("peak_mastery_score"))
    again = F.greatest(F.col("wrong_at"), F.when(F.col("known").isNull(), F.col("first_at")))
    asked = moved.where(again.isNotNull()).select(*point, (again + F.expr("INTERVAL 24 HOURS")).alias("next_review_at"))
    before = book.select(*question, F.struct(F.col("error_count").cast("long").alias("errors"), F.col("streak").cast("int").alias("streak"), "status").alias("b"))
    tried = attempts.groupBy(*question).agg(in_order("is_correct").alias("tries")).join(before, question, "left")
    none = F.struct(F.lit(0).cast("long").alias("errors"), F.lit(0).alias("streak"), F.lit("none").alias("status"))

    def marked(s: Column, x: Column) -> Column:
        streak = F.when(s["status"] == "open", s["streak"] + 1).otherwise(s["streak"])
        right = F.struct(s["errors"].alias("errors"), streak.cast("int").alias("streak"), F.when((s["status"] == "open") & (streak >= 2), "resolved").otherwise(s["status"]).alias("status"))
        wrong = F.struct((s["errors"] + 1).alias("errors"), F.lit(0).alias("streak"), F.lit("open").alias("status"))
        return F.when(x["is_correct"], right).otherwise(wrong)

    tried = tried.withColumn("s", F.aggregate("tries", F.coalesce("b", none), marked)).where("s.status <> 'none'")
    touched = tried.select(*question, F.col("s.errors").alias("error_count"), F.col("s.streak").alias("streak"), F.col("s.status").alias("status"))
    merged = lambda old, new, keys: old.join(new.select(*keys), keys, "left_anti").select(*new.columns).unionByName(new)
    return {
        "attempts": attempts,
        "mastery": merged(scores, fresh, point),
        "reviews": merged(due, asked, point),
        "mistakes": merged(book.withColumn("error_count", F.col("error_count").cast("long")).withColumn("streak", F.col("streak").cast("int")), touched, question),
        "sessions": sessions.withColumn("status", F.when(F.col("status") == "in_progress", "completed").otherwise(F.col("status"))),
    }


def reviews(graded: DataFrame) -> DataFrame:
    """(student_id, kp_id, next_review_at): a day after the first contact or the last wrong answer."""
    wrong = F.max(F.when(~F.col("is_correct"), F.col("answered_at")))
    return graded.groupBy("student_id", F.col("primary_kp").alias("kp_id")).agg((F.greatest(F.min("answered_at"), wrong) + F.expr("INTERVAL 24 HOURS")).alias("next_review_at"))


def redo(book: DataFrame, redos: DataFrame) -> DataFrame:
    """The open rows of a mistake book after each learner's first redo of it; nothing else changes."""
    first = redos.groupBy("student_id", "question_id").agg(F.min_by("is_correct", "redo_id").alias("right"))
    rows = book.where("status = 'open'").join(first, ["student_id", "question_id"])
    streak = F.when(F.col("right"), F.col("streak") + 1).otherwise(0)
    return rows.select("student_id", "question_id", (F.col("error_count") + F.when(F.col("right"), 0).otherwise(1)).alias("error_count"), F.least(F.lit(2), streak).alias("streak"), F.when(streak >= 2, "resolved").otherwise("open").alias("status"))


def allowed_points(students: DataFrame, unlocked: DataFrame, points: DataFrame) -> DataFrame:
    """(student_id, kp_id, chapter_no, place): unlocked points of the learner's subject, in point order."""
    rows = unlocked.join(points, "kp_id").join(students.select("student_id", F.col("subject_id").alias("own")), "student_id").where("subject_id = own")
    place = F.row_number().over(Window.partitionBy("student_id").orderBy("kp_id")) - 1
    return rows.select("student_id", "kp_id", "chapter_no", place.alias("place"))


def candidates(allowed: DataFrame, scores: DataFrame, book: DataFrame, due: DataFrame, questions: DataFrame, now: Column, chapter: str | None = None) -> DataFrame:
    """(student_id, kp_id, pool, score, source_question): the pools of every learner."""
    known = allowed.join(scores.select("student_id", "kp_id", "mastery_score"), ["student_id", "kp_id"], "left").withColumn("m", F.coalesce("mastery_score", F.lit(0.0)))
    late = due.where(F.col("next_review_at") <= now).join(allowed.select("student_id", "kp_id"), ["student_id", "kp_id"])
    late = late.select("student_id", "kp_id", F.lit("spaced_review").alias("pool"), number.overdue_days(F.col("next_review_at"), now).alias("score"), F.lit(None).cast("bigint").alias("source_question"))
    wrong = book.where("status = 'open'").join(questions.select("question_id", F.col("primary_kp").alias("kp_id")), "question_id").join(allowed.select("student_id", "kp_id"), ["student_id", "kp_id"])
    wrong = wrong.select("student_id", "kp_id", F.lit("mistake_variant").alias("pool"), F.col("error_count").cast("double").alias("score"), F.col("question_id").cast("bigint").alias("source_question"))
    progress = (1 - F.col("m")) * 100 - F.col("place") / 100
    pools = [F.when(F.col("m") < 0.5, F.struct(F.lit("new_knowledge").alias("pool"), progress.alias("score"))), F.when(F.col("m").between(0.5, 0.85) & (F.col("m") < 0.85), F.struct(F.lit("feynman_check").alias("pool"), F.col("m").alias("score")))]
    if chapter is not None:
        pools.append(F.when((F.col("chapter_no") == chapter) & (F.col("m") < 0.85), F.struct(F.lit("chapter_practice").alias("pool"), progress.alias("score"))))
    fresh = known.select("student_id", "kp_id", F.explode(F.array_compact(F.array(*pools))).alias("c")).select("student_id", "kp_id", "c.pool", "c.score", F.lit(None).cast("bigint").alias("source_question"))
    return late.unionByName(wrong).unionByName(fresh)


def priority(pool: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in number.PRIORITY.items() for x in p]), pool)


def one_per_point(pools: DataFrame) -> DataFrame:
    """Each learner's best candidate of a point, with the other pools that hold it by priority."""
    best = Window.partitionBy("student_id", "kp_id").orderBy(F.col("rank").desc(), F.col("score").desc(), F.col("source_question").asc_nulls_first())
    every = Window.partitionBy("student_id", "kp_id")
    rows = pools.withColumn("rank", priority(F.col("pool"))).withColumn("pools", F.collect_set("pool").over(every)).withColumn("n", F.row_number().over(best)).where("n = 1")
    others = F.filter(F.transform(F.sort_array(F.transform("pools", lambda p: F.struct(priority(p).alias("r"), p.alias("p"))), False), lambda x: x["p"]), lambda p: p != F.col("pool"))
    return rows.select("student_id", "kp_id", "pool", "score", "source_question", "rank", others.alias("secondary"))


def plan_slots(pools: DataFrame, budgets: dict[str, int], count: int = 8) -> DataFrame:
    """Each learner's slots: every pool up to its budget, then the rest by priority; one check at most."""
    in_pool = Window.partitionBy("student_id", "pool").orderBy(F.col("score").desc(), "kp_id")
    budget = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in budgets.items() for x in p]), F.col("pool")), F.lit(0))
    check = F.col("pool") == "feynman_check"
    rows = one_per_point(pools).withColumn("k", F.row_number().over(in_pool))
    rows = rows.where(~check | (F.col("k") == 1)).withColumn("turn", F.when(F.col("k") <= F.when(check, F.least(budget, F.lit(1))).otherwise(budget), 1).otherwise(2))
    order = Window.partitionBy("student_id").orderBy("turn", F.col("rank").desc(), "k")
    return rows.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= count).drop("turn", "k", "rank")


def choose_questions(slots: DataFrame, scores: DataFrame, questions: DataFrame, allowed: DataFrame) -> DataFrame:
    """Slots with their bank question: the mistaken one, else the nearest difficulty in the bank's order.

    A question counts if all its points are the learner's to practise.
    """
    sets = allowed.groupBy("student_id").agg(F.collect_set(F.col("kp_id").cast("int")).alias("mine"))
    rows = slots.where("pool <> 'feynman_check'").join(scores.select("student_id", "kp_id", "mastery_score"), ["student_id", "kp_id"], "left").join(sets, "student_id")
    low = number.difficulty_range(F.coalesce("mastery_score", F.lit(0.0)))["low"]
    rows = rows.select("student_id", "kp_id", "source_question", "mine", low.alias("low"))
    mine = F.size(F.array_except("qs", "mine")) == 0
    bank = questions.select(F.col("primary_kp").alias("qk"), "question_id", F.col("kp_ids").alias("qs"), "difficulty")
    # of questions that are alike to every learner the first one alone can be chosen
    kinds = bank.groupBy("qk", "qs", "difficulty").agg(F.min("question_id").alias("question_id"))
    fits = rows.join(kinds, F.col("kp_id") == F.col("qk")).where(mine)
    outside = F.when(F.col("difficulty").between(F.col("low"), F.col("low") + 1), 0).otherwise(1)
    away = F.abs(F.col("difficulty") * 2 - F.col("low") * 2 - 1)
    best = fits.groupBy("student_id", "kp_id").agg(F.min(F.struct(outside.alias("outside"), away.alias("away"), "question_id")).alias("first")).select("student_id", "kp_id", F.col("first.question_id").alias("nearest"))
    own = rows.join(bank, (F.col("source_question") == F.col("question_id")) & (F.col("kp_id") == F.col("qk"))).where(mine).select("student_id", "kp_id", F.col("question_id").alias("own"))
    found = slots.join(best, ["student_id", "kp_id"], "left").join(own, ["student_id", "kp_id"], "left").withColumn("question_id", F.coalesce("own", "nearest")).drop("own", "nearest")
    return found.withColumn("source", F.when(F.col("question_id").isNotNull(), "question_bank").otherwise("ai_generated"))


def session_plan(slots: DataFrame, minimum: int = 3) -> DataFrame:
    """Ordered bank questions of each learner with their pool sources, and whether they are enough."""
    bank = slots.where("source = 'question_bank'")
    items = F.array_sort(F.collect_list(F.struct("slot", "question_id", text.mapped(POOL_SOURCES, F.col("pool")).alias("pool_source"))))
    plan = bank.groupBy("student_id").agg(items.alias("items"))
    return plan.select("student_id", F.transform("items", lambda x: x["question_id"]).alias("question_ids"), F.transform("items", lambda x: x["pool_source"]).alias("pool_sources"), (F.size("items") >= minimum).alias("is_enough"))


def progress_items(scope: DataFrame, scores: DataFrame, book: DataFrame, due: DataFrame, questions: DataFrame, now: Column) -> DataFrame:
    """One row per learner and point in scope: status, percent, practice, open mistake, due review."""
    open_points = book.where("status = 'open'").join(questions.select("question_id", F.col("primary_kp").alias("kp_id")), "question_id").select("student_id", "kp_id").distinct().withColumn("open", F.lit(True))
    due_points = due.where(F.col("next_review_at") <= now).select("student_id", "kp_id", F.lit(True).alias("due"))
    key = ["student_id", "kp_id"]
    rows = scope.join(scores, key, "left").join(open_points, key, "left").join(due_points, key, "left")
    return rows.select(
        *key, "name", "chapter_no", number.progress_status(F.col("mastery_score"), F.col("peak_mastery_score")).alias("status"), number.percent(F.coalesce("mastery_score", F.lit(0.0))).alias("progress_percent"),
        F.coalesce("attempts", F.lit(0)).alias("practice_count"), F.col("last_at").alias("last_practiced_at"), F.coalesce("open", F.lit(False)).alias("has_open_mistake"), F.coalesce("due", F.lit(False)).alias("needs_review"),
    )


def needs_work() -> Column:
    return F.col("status").isin("needs_work", "regressed")


def progress_priority() -> Column:
    return F.when(F.col("status") == "regressed", 0).when(F.col("status") == "needs_work", 1).when(F.col("needs_review"), 2).when(F.col("has_open_mistake"), 3).when(F.col("status") == "learning", 4).when(F.col("status") == "not_started", 5).otherwise(6)


def progress_summary(items: DataFrame) -> DataFrame:
    return items.groupBy("student_id").agg(
        F.count(F.lit(1)).alias("unlocked_count"), F.count_if((F.col("status") != "not_started") | (F.col("practice_count") > 0)).alias("started_count"),
        F.count_if(F.col("status") == "mastered").alias("mastered_count"), F.count_if(needs_work() | F.col("has_open_mistake")).alias("needs_work_count"),
    )


def progress_groups(items: DataFrame, by: Column) -> DataFrame:
    """Counts of each learner's chapters or sections, and whether the group opens by itself."""
    work = needs_work() | F.col("has_open_mistake")
    return items.groupBy("student_id", by.alias("label")).agg(F.count(F.lit(1)).alias("item_count"), F.count_if(work).alias("needs_work_count"), F.count_if(F.col("status") == "mastered").alias("mastered_count"), F.bool_or(work | F.col("needs_review")).alias("default_open"))


def point_stats(graded: DataFrame, unlocked: DataFrame) -> DataFrame:
    """Per session and practised point: right and all answers, and where it first came."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("attempt_id")) - 1
    rows = graded.withColumn("place", place).select("session_id", "student_id", "place", "is_correct", F.explode("kp_ids").alias("kp_id")).join(unlocked, ["student_id", "kp_id"], "left_semi")
    return rows.groupBy("session_id", "student_id", "kp_id").agg(F.count_if("is_correct").alias("correct_count"), F.count(F.lit(1)).alias("total_count"), F.min("place").alias("first_seen"))


def result_groups(stats: DataFrame, materials: DataFrame) -> DataFrame:
    """Session points with their ranked materials; points without any are left out.

    Every point keeps few materials per status, so those are ranked once a point
    and the sessions meet short lists.
    """
    place = lambda order: F.array_position(F.array(*map(F.lit, order)), F.col("material_type"))
    newest = [F.col("created_at").desc(), F.col("material_id")]
    ranked = lambda order, limit, status: materials.withColumn("n", F.row_number().over(Window.partitionBy("kp_id").orderBy(place(order), *newest))).where(F.col("n") <= limit).groupBy("kp_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "material_id", "material_type"))), lambda x: F.struct(x["material_id"].alias("material_id"), x["material_type"].alias("material_type"))).alias("materials")
    ).withColumn("status", F.lit(status))
    lists = ranked(WORK_ORDER, WORK_LIMIT, "needs_work").unionByName(ranked(REVIEW_ORDER, REVIEW_LIMIT, "review"))
    rows = stats.withColumn("status", F.when(F.col("correct_count") < F.col("total_count"), "needs_work").otherwise("review")).join(lists, ["kp_id", "status"])
    wrong = F.col("total_count") - F.col("correct_count")
    order = Window.partitionBy("session_id").orderBy((F.col("status") != "needs_work"), wrong.desc(), F.col("total_count").desc(), "first_seen", "kp_id")
    return rows.withColumn("place", F.row_number().over(order))


def review_plan(groups: DataFrame, points: DataFrame) -> DataFrame:
    """Each session's headline, number of weak points and up to three points in focus."""
    named = groups.join(points.select("kp_id", "name"), "kp_id")
    rows = named.groupBy("session_id").agg(F.count_if(F.col("status") == "needs_work").alias("weak"), F.min_by("name", "place").alias("first_name"), F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "name", "status")))).alias("focus"))
    headline = F.when(F.col("weak") > 0, F.format_string("先把“%s”补牢", "first_name")).otherwise(F.format_string("这次整体不错，顺手复习“%s”", "first_name"))
    return rows.select("session_id", "weak", headline.alias("headline"), F.transform("focus", lambda x: x["name"]).alias("focus_names"))


def textbook_scope(points: DataFrame, key: str = "subject_id") -> DataFrame:
    """Chapters and points of a textbook in chapter order, points in their order inside a chapter."""
    rows = points.withColumn("chapter", text.chapter_number(F.col("chapter_no"))).withColumn("natural", text.natural_key(F.col("chapter")))
    order = Window.partitionBy(key).orderBy("natural", "kp_id")
    return rows.withColumn("chapter_order", F.dense_rank().over(Window.partitionBy(key).orderBy("natural"))).withColumn("sort_order", F.row_number().over(order)).select(key, "kp_id", F.col("chapter").alias("chapter_no"), "chapter_order", "sort_order")


def budgets(count: int = 8, mode: str = "daily_mixed", chapter: bool = False) -> dict[str, int]:
    shares = number.mode_budgets(count, mode)
    shares["chapter_practice" if chapter else "new_knowledge"] = shares.pop("progress")
    return shares


#: Slots of a session by phase of the term, pool by pool; a learner without answers starts cold.
PHASE_SLOTS = {
    "cold_start": {"new_knowledge": 8, "mistake_variant": 0, "spaced_review": 0},
    "learning": {"new_knowledge": 4, "mistake_variant": 2, "spaced_review": 2},
    "consolidation": {"new_knowledge": 2, "mistake_variant": 3, "spaced_review": 3},
    "before_exam": {"new_knowledge": 0, "mistake_variant": 5, "spaced_review": 3},
}


def phases(students: DataFrame, attempts: DataFrame, now: Column, exam: Column, cold: int = 5) -> DataFrame:
    """(student_id, phase, pool, slots): cold below so many answers, then by the days that are left until the exam."""
    counts = attempts.groupBy("student_id").agg(F.count(F.lit(1)).alias("n"))
    left = F.datediff(exam, now)
    phase = F.when(F.coalesce("n", F.lit(0)) < cold, "cold_start").when(left <= 14, "before_exam").when(left <= 45, "consolidation").otherwise("learning")
    slots = F.create_map(*[F.lit(x) for name, pools in PHASE_SLOTS.items() for pool, n in pools.items() for x in (f"{name}:{pool}", n)])
    rows = students.select("student_id").join(counts, "student_id", "left").select("student_id", phase.alias("phase"), F.explode(F.array(*map(F.lit, PHASE_SLOTS["learning"]))).alias("pool"))
    return rows.withColumn("slots", F.element_at(slots, F.concat_ws(":", "phase", "pool")))


def causes(graded: DataFrame, book: DataFrame, scores: DataFrame) -> DataFrame:
    """(student_id, question_id, cause, action) of each mistake, read off its answers and its point's mastery.

    A slip on a mastered point, a relapse after a peak, a gap on a point never
    learnt, a stubborn error of three or more, else a weak point.
    """
    rows = book.join(graded.select("question_id", F.col("primary_kp").alias("kp_id")).distinct(), "question_id").join(scores, ["student_id", "kp_id"], "left")
    score, peak = F.coalesce("mastery_score", F.lit(0.0)), F.coalesce("peak_mastery_score", F.lit(0.0))
    cause = F.when(score >= 0.85, "slip").when((peak >= 0.5) & (score < 0.2), "relapse").when(peak < 0.2, "gap").when(F.col("error_count") >= 3, "stubborn").otherwise("weak")
    actions = {"slip": "slow_down", "relapse": "recall", "gap": "relearn", "stubborn": "explain_back", "weak": "practise"}
    return rows.select("student_id", "question_id", cause.alias("cause")).withColumn("action", text.mapped(actions, F.col("cause")))


def answer_view(sessions: DataFrame, questions: DataFrame, unlocked: DataFrame, metadata: DataFrame) -> DataFrame:
    """(session_id, pos, question_id, stem, difficulty, options, figures): what a learner in a running session answers.

    Only sessions in progress and questions of unlocked points count; their
    order is the session's. metadata (question_id, options, figures) may lack a
    question or its options: a choice then has the bare labels A to D, other
    questions none. Questions are looked up by what sessions ask, so a learner's
    points and the bank never meet as a whole.
    """
    asked = sessions.where("status = 'in_progress'").select("session_id", "student_id", F.posexplode("question_ids").alias("pos", "question_id"))
    known = asked.join(questions, "question_id").join(unlocked.select("student_id", F.col("kp_id").alias("primary_kp")), ["student_id", "primary_kp"], "left_semi")
    bare = F.when(F.col("question_type") == "choice", F.array(*[F.struct(F.lit(x).alias("label"), F.lit(x).alias("text")) for x in "ABCD"])).otherwise(F.array().cast("array<struct<label:string,text:string>>"))
    shown = known.join(metadata.select("question_id", "options", "figures"), "question_id", "left")
    return shown.select("session_id", "pos", "question_id", "stem", "difficulty", F.coalesce("options", bare).alias("options"), F.coalesce("figures", F.array().cast("array<string>")).alias("figures"))


def result_view(sessions: DataFrame, attempts: DataFrame, questions: DataFrame, unlocked: DataFrame, book: DataFrame, plans: DataFrame) -> DataFrame:
    """(session_id, attempts, right_answers, resolved, headline, plan): completed sessions as their learners see them.

    attempts is the session's list of (question_id, is_correct, resolved) in the
    order of answering. A question counts as resolved if its mistake was
    resolved while the session ran and the session has a right answer to it.
    plans (session_id, headline) come along as plan.
    """
    done = sessions.where("status = 'completed'").select("session_id", "student_id", "started_at", "ended_at")
    mine = attempts.join(done, ["session_id", "student_id"]).join(questions.select("question_id", "primary_kp"), "question_id").join(unlocked.select("student_id", F.col("kp_id").alias("primary_kp")), ["student_id", "primary_kp"], "left_semi")
    solved = book.where("resolved_at IS NOT NULL").select("student_id", "question_id", "resolved_at")
    marked = mine.join(solved, ["student_id", "question_id"], "left").withColumn("in_time", F.coalesce(F.col("resolved_at").between(F.col("started_at"), F.col("ended_at")), F.lit(False)))
    right = F.max("is_correct").over(Window.partitionBy("session_id", "question_id"))
    marked = marked.withColumn("resolved", F.col("in_time") & right)
    row = F.struct("answered_at", "attempt_id", "question_id", "is_correct", "resolved")
    told = marked.groupBy("session_id").agg(F.array_sort(F.collect_list(row)).alias("a"), F.count_if("is_correct").alias("right_answers"), F.count_distinct(F.when(F.col("resolved"), F.col("question_id"))).alias("resolved"))
    headline = F.when(F.col("resolved") > 0, F.format_string("本次攻克 %d 道历史错题", "resolved"))
    listed = F.transform("a", lambda x: F.struct(x["question_id"].alias("question_id"), x["is_correct"].alias("is_correct"), x["resolved"].alias("resolved")))
    return told.join(plans.select("session_id", F.col("headline").alias("plan")), "session_id", "left").select("session_id", listed.alias("attempts"), "right_answers", "resolved", headline.alias("headline"), "plan")
