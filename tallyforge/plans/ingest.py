"""From model output to published entities: parse, organise by knowledge, stage, review, publish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import jsonx, text
from tallyforge.operators import core, fuzzy

#: The list of a thread that holds the materials of a type.
THREAD_KEYS = {
    "method_card": "method_cards",
    "common_mistake": "common_mistakes",
    "question_type_summary": "question_type_summaries",
    "solution_summary": "solution_summaries",
    "concept_explanation": "concept_explanations",
    "textbook_deep_dive": "textbook_deep_dives",
    "exam_trend": "exam_trends",
    "study_advice": "study_advice",
}


#: Pages whose text stands in one row.
PART_PAGES = 64


def ordered_parts(rows: DataFrame, doc: str, order: str, per_row: Column, separator: str = "\n\n", width: int = PART_PAGES, *more: Column) -> DataFrame:
    """(doc, part, text, pages, ...) of rows in order, width rows to a part; parts of a document follow each other by number.

    Rows are numbered by a sort that can spill, so a document of any length is
    never one list or one text; rows without a text count but add nothing.
    """
    place = F.row_number().over(Window.partitionBy(doc).orderBy(order)) - 1
    cut = rows.withColumn("_text", per_row).withColumn("_n", place).withColumn("part", F.floor(F.col("_n") / width).cast("int"))
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("_text").isNotNull(), F.struct("_n", "_text")))), lambda x: x["_text"])
    return cut.groupBy(doc, "part").agg(F.array_join(texts, separator).alias("text"), F.count(F.lit(1)).alias("pages"), *more)


def parse_batch(answers: DataFrame, body: str = "text") -> DataFrame:
    """answers with value (VARIANT) and error, one parse a row."""
    parsed = answers.withColumn("_p", jsonx.tolerant(F.col(body)))
    return parsed.withColumn("value", F.col("_p.value")).withColumn("error", F.col("_p.error")).drop("_p")


def materials_of(parsed: DataFrame, key: str) -> DataFrame:
    """(key, pos, title, content, material_type, hints) of each parsed batch."""
    rows = parsed.select(key, F.posexplode(jsonx.elements(F.col("value"), "learning_materials", "learningMaterials", "materials")).alias("pos", "m"))
    title, content = jsonx.text_field(F.col("m"), "title", "name", default=""), jsonx.text_field(F.col("m"), "content", "text", "body", default="")
    kind = text.material_kind(jsonx.text_field(F.col("m"), "material_type", "materialType", "type"), title, content)
    hints = F.coalesce(F.try_variant_get("m", "$.kp_hints", "array<string>"), F.try_variant_get("m", "$.kpHints", "array<string>"), F.array().cast("array<string>"))
    return rows.select(key, "pos", title.alias("title"), content.alias("content"), kind.alias("material_type"), hints.alias("hints")).where((F.col("title") != "") | (F.col("content") != ""))


def first_filled(final: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Rows of the final answer, or those of the pages for documents that have no final row."""
    both = final.withColumn("tier", F.lit(0)).unionByName(pages.withColumn("tier", F.lit(1)), allowMissingColumns=True)
    return core.first_tier(both, [key], F.col("tier")).drop("tier")


def organise(items: DataFrame, points: DataFrame, group: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(threads, unmapped, filtered) of items (item_id, group, kind, item_text, hint) against points.

    Items without teaching text are counted and dropped; the others go to their
    best point's thread, or to the unmapped rows.
    """
    marked = items.withColumn("categories", text.non_learning(F.col("item_text")))
    kept = marked.where(F.size("categories") == 0)
    best = fuzzy.best_match(kept, points, group)
    matched = kept.join(best, "item_id", "left")
    lists = [F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("item_id")))).alias(THREAD_KEYS.get(k, f"{k}s")) for k in (*text.MATERIAL_LABELS, "question")]
    threads = matched.where("kp_id IS NOT NULL").groupBy(group, "kp_id").agg(*lists, F.max("score").alias("match_confidence"))
    unmapped = matched.where("kp_id IS NULL").select("item_id", group, F.lit("no_matching_knowledge_point").alias("reason"))
    dropped = marked.where(F.size("categories") > 0)
    filtered = dropped.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("categories")))).alias("categories"))
    return threads, unmapped, filtered


def questions_of(parsed: DataFrame, key: str) -> DataFrame:
    """(key, pos, kind, stem, options, sub_questions, figures, answer, analysis) of the questions that parsed batches hold.

    What only reads like a question (a heading, an advertisement, a method) is
    left out; pos is the place in the answer, so gaps show what went.
    """
    rows = parsed.select(key, F.posexplode(jsonx.elements(F.col("value"), "questions", "items")).alias("pos", "m"))
    m = F.col("m")
    said = {c: jsonx.text_field(m, *names).alias(c) for c, names in {"type": ("type", "question_type", "questionType"), "stem": ("stem", "content", "question"), "answer_area": ("answer_area",), "answer": ("answer",), "analysis": ("analysis", "solution"), "figure_description": ("figure_description",), "raw_text": ("raw_text",)}.items()}
    options = F.coalesce(F.try_variant_get(m, "$.options", "array<string>"), F.array().cast("array<string>"))
    subs = F.transform(jsonx.elements(m, "sub_questions", "subQuestions"), lambda x: F.struct(*[jsonx.text_field(x, c).alias(c) for c in ("number", "stem", "answer", "analysis")]))
    figures = F.transform(jsonx.elements(m, "figures"), lambda x: F.struct(jsonx.text_field(x, "description").alias("description"), F.try_variant_get(x, "$.labels", "array<string>").alias("labels")))
    q = F.struct(*said.values(), options.alias("options"), subs.alias("sub_questions"), figures.alias("figures"))
    kept = rows.select(key, "pos", q.alias("q")).where(text.is_question(F.col("q")))
    return kept.select(key, "pos", text.question_kind(F.col("q.type")).alias("kind"), "q.stem", text.parse_options(F.col("q.options")).alias("options"), "q.sub_questions", "q.figures", "q.answer", "q.analysis")


#: Items of a thread that stand in one row.
PART_ITEMS = 256


def assemble_threads(items: DataFrame, width: int = PART_ITEMS) -> DataFrame:
    """Threads of points from items (kp_id, kind, item_id, source_ref, score), mapped ones only.

    A thread has a list of items for each of the eight material types, its
    questions, the distinct source references, and the best score as
    match_confidence. Items of a type that isn't known are explanations. They
    are numbered by type and id and a thread is cut into parts of width items,
    so a point of any size is no one row.
    """
    known = F.when(F.col("kind").isin(*THREAD_KEYS, "question"), F.col("kind")).otherwise("concept_explanation")
    rows = items.where("kp_id IS NOT NULL").withColumn("kind", known)
    place = F.array_position(F.array(*map(F.lit, (*THREAD_KEYS, "question"))), F.col("kind"))
    number_ = F.row_number().over(Window.partitionBy("kp_id").orderBy(place, "item_id")) - 1
    cut = rows.withColumn("part", F.floor(number_ / width).cast("int"))
    lists = [F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("item_id")))).alias(name) for k, name in {**THREAD_KEYS, "question": "questions"}.items()]
    return cut.groupBy("kp_id", "part").agg(*lists, F.array_sort(F.collect_set("source_ref")).alias("source_refs"), F.max("score").alias("match_confidence"))


def flatten_threads(threads: DataFrame, unmapped: DataFrame) -> DataFrame:
    """(entity_kind, kp_id, material_type, item_id) for review: the items of threads, and unmapped points.

    Materials come back under the type of their list; of unmapped items (item_id,
    item_type) points alone are kept, as points to be reviewed.
    """
    pairs = [F.struct(F.lit("learning_material").alias("entity_kind"), F.lit(k).alias("material_type"), F.col(name).alias("ids")) for k, name in THREAD_KEYS.items()]
    pairs.append(F.struct(F.lit("question").alias("entity_kind"), F.lit(None).cast("string").alias("material_type"), F.col("questions").alias("ids")))
    flat = threads.select("kp_id", F.explode(F.array(*pairs)).alias("p")).select("p.entity_kind", "kp_id", "p.material_type", F.explode("p.ids").alias("item_id"))
    points = unmapped.where("item_type = 'knowledge_point'").select(F.lit("knowledge_point").alias("entity_kind"), F.lit(None).cast(threads.schema["kp_id"].dataType).alias("kp_id"), F.lit(None).cast("string").alias("material_type"), "item_id")
    return flat.unionByName(points)


def outcome(rows: DataFrame, key: str) -> DataFrame:
    """Job state per key: failed only with a reason and nothing staged; analysis ok, partial or failed."""
    got = rows.groupBy(key).agg(F.sum("staged").alias("staged"), F.max("reason").alias("reason"))
    none = F.col("staged") == 0
    return got.select(key, F.when(F.col("reason").isNotNull() & none, "failed").otherwise("parsed").alias("job_status"), F.when(F.col("reason").isNull(), "ok").when(none, "failed").otherwise("partial").alias("analysis_status"))


def publish(staging: DataFrame, accepted: Column, problems: Column) -> tuple[DataFrame, DataFrame]:
    """(entities, staging after): sound accepted rows become entities and are marked; others keep their state."""
    rows = staging.withColumn("problems", problems).withColumn("go", accepted & (F.size("problems") == 0))
    entities = rows.where("go").select("staging_id", "upload_id", "entity_kind", "payload")
    after = rows.select("staging_id", F.when(F.col("go"), "accepted").otherwise(F.col("review_status")).alias("review_status"), F.array_join("problems", ",").alias("problems"))
    return entities, after


def once_per_upload(staging: DataFrame) -> DataFrame:
    """The first source document of each upload, unless one is published already."""
    source = staging.where("entity_kind = 'source_document'")
    done = source.where("published_id IS NOT NULL").select("upload_id").distinct()
    return source.join(done, "upload_id", "left_anti").groupBy("upload_id").agg(F.min("staging_id").alias("staging_id"))


def review_queue(staging: DataFrame) -> DataFrame:
    """Per upload and kind: pending, accepted and rejected counts."""
    return staging.groupBy("upload_id", "entity_kind").pivot("review_status", ["pending", "accepted", "rejected"]).agg(F.count(F.lit(1))).fillna(0)


def latest_job(uploads: DataFrame, jobs: DataFrame, key: str, most: int = 10) -> DataFrame:
    """The newest uploads with their last job's state and number of staged rows."""
    top = uploads.orderBy(F.col(key).desc()).limit(most)
    last = jobs.groupBy(key).agg(F.max_by("review_status", "staging_id").alias("last_status"), F.count(F.lit(1)).alias("staged"))
    return top.join(last, key, "left").select(key, "last_status", F.coalesce("staged", F.lit(0)).alias("staged"))


def in_order(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def take_rerun(old: DataFrame, new: DataFrame, found: DataFrame) -> DataFrame:
    """old (old_id, payload, ...) with the payload of the new row (new_id, new_payload) that was found for it, its id as lineage, and the tier.

    New payloads meet the pairs of ids, so that old ones aren't sent to the new
    rows' places, where many may take one row.
    """
    taken = found.join(new, "new_id", "left")
    rows = old.join(taken, "old_id", "left")
    return rows.withColumn("payload", F.coalesce("new_payload", "payload")).withColumn("lineage", F.col("new_id")).drop("new_id", "new_payload")


#: Fixed value: the range of points that a textbook is expected to give.
EXPECTED_RANGE = "100-180"


def coverage(summary: Column, points: Column) -> Column:
    """What went in and came out of a parse: the model's own counts and notes by their aliases, the points that were read, the expected range."""
    first = lambda kind, *names: F.coalesce(*[F.try_variant_get(summary, f"$.{n}", kind) for n in names])
    notes = F.coalesce(first("array<string>", "coverage_notes", "coverageNotes"), F.array().cast("array<string>"))
    return F.struct(
        first("int", "input_candidate_count", "inputCandidateCount").alias("input_candidate_count"), points.alias("output_knowledge_point_count"),
        F.coalesce(first("string", "expected_range", "expectedRange"), F.lit(EXPECTED_RANGE)).alias("expected_range"), F.filter(F.transform(notes, lambda x: F.trim(x)), lambda x: x != "").alias("coverage_notes"),
    )


def verification(tables: dict[str, DataFrame], checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """(name, passed, detail): a row for each check on a table (rows that break it), for each table (rows), and 'ok' for all together.

    checks maps a name to a table and the condition that every row has to meet;
    each table is read once.
    """
    parts = []
    for table, df in tables.items():
        own = {name: c for name, (t, c) in checks.items() if t == table}
        counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in own.items()])
        rows = [F.struct(F.lit(f"{table}_found").alias("name"), (F.col("n") > 0).alias("passed"), F.col("n").alias("detail"))]
        rows += [F.struct(F.lit(name).alias("name"), (F.col(name) == 0).alias("passed"), F.col(name).alias("detail")) for name in own]
        parts.append(counts.select(F.inline(F.array(*rows))))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.unionByName(every.agg(F.lit("ok").alias("name"), F.bool_and("passed").alias("passed"), F.count_if(~F.col("passed")).alias("detail")))
