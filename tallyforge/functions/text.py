"""String column functions: answers, chapters, titles, labels, payload text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import udf

#: White space as the source system trims it: also no-break and ideographic spaces.
_WS = "[\\s\\u00a0\\u3000\\ufeff]"
UNASSIGNED = "unassigned"
#: Domain suffixes that a hint may carry.
SUFFIXES = ("运算", "方法", "性质", "概念", "定义", "表示", "关系", "判定")
#: Display labels.
STATUS_LABELS = {"not_started": "未开始", "needs_work": "需要加强", "learning": "学习中", "mastered": "已掌握", "regressed": "曾掌握后回落"}
MATERIAL_LABELS = {
    "common_mistake": "易错提醒",
    "method_card": "解题方法",
    "question_type_summary": "题型总结",
    "solution_summary": "解析总结",
    "concept_explanation": "概念回顾",
    "textbook_deep_dive": "教材深挖",
    "exam_trend": "考情提示",
    "study_advice": "学习建议",
}


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_WS}+|{_WS}+$", "")


def collapse(c: Column) -> Column:
    return trim_all(F.regexp_replace(c, f"{_WS}+", " "))


def truncate(c: Column, n: int) -> Column:
    """Collapsed text of n characters at most, with '...' when it was longer."""
    t = collapse(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def blank_to_null(c: Column) -> Column:
    t = trim_all(c)
    return F.when(t != "", t)


def choice_answer(c: Column) -> Column:
    letters = F.regexp_replace(F.upper(udf.nfkc(trim_all(c))), "[^A-Z]", "")
    return F.array_join(F.array_sort(F.filter(F.split(letters, ""), lambda x: x != "")), "")


def fill_in_answer(c: Column) -> Column:
    t = F.translate(F.upper(udf.nfkc(trim_all(c))), "，、；;", ",,,,")
    return F.regexp_replace(t, f"{_WS}+", "")


def answers_equal(given: Column, right: Column, question_type: Column) -> Column:
    return F.when(question_type == "choice", choice_answer(given) == choice_answer(right)).otherwise(fill_in_answer(given) == fill_in_answer(right))


def option_markers(labels: Column, picked: Column, right: Column) -> Column:
    """Per option label: whether it was picked and whether it is right.

    picked and right are normalised answers in columns of their own, since a
    lambda can't hold a Python function.
    """
    return F.transform(labels, lambda x: F.struct(x.alias("label"), F.contains(picked, F.upper(x)).alias("picked"), F.contains(right, F.upper(x)).alias("correct")))


def chinese_number(c: Column) -> Column:
    """Numerals up to hundreds, or null: each of hundreds, tens and ones is one digit at most."""
    t = F.regexp_replace(c, "〇", "零")
    digit = lambda x: F.when(F.length(x) == 1, F.instr(F.lit("零一二三四五六七八九"), x) - 1)
    hundreds_part, has_hundred = F.split_part(t, F.lit("百"), F.lit(1)), t.contains("百")
    rest = F.when(has_hundred, F.split_part(t, F.lit("百"), F.lit(2))).otherwise(t)
    hundreds = F.when(has_hundred, F.when(hundreds_part == "", 1).otherwise(digit(hundreds_part))).otherwise(0)
    has_ten = rest.contains("十")
    tens_part, ones_part = F.split_part(rest, F.lit("十"), F.lit(1)), F.split_part(rest, F.lit("十"), F.lit(2))
    tens = F.when(tens_part == "", 1).otherwise(digit(tens_part))
    ones = F.when(ones_part == "", 0).otherwise(digit(ones_part))
    low = F.when(has_ten, tens * 10 + ones).otherwise(digit(rest))
    total = F.when(rest == "", hundreds * 100).otherwise(hundreds * 100 + low)
    once = (F.length(t) - F.length(F.regexp_replace(t, "百", "")) <= 1) & (F.length(rest) - F.length(F.regexp_replace(rest, "十", "")) <= 1)
    return F.when(t.rlike("^[一二三四五六七八九十百零]+$") & once, total)


def chapter_number(c: Column) -> Column:
    """'第十一章 ...' and '第 4 章' as whole numbers, other text trimmed, blank as unassigned."""
    t = trim_all(c)
    inner = F.regexp_extract(t, "^第\\s*([一二三四五六七八九十百〇零\\d]+)\\s*章(?:\\s+.*)?$", 1)
    number = F.when(inner.rlike("^\\d+$"), F.regexp_replace(inner, "^0+(?=\\d)", "")).when(inner != "", chinese_number(inner).cast("string"))
    return F.when(t.isNull() | (t == ""), F.lit(UNASSIGNED)).otherwise(F.coalesce(number, t))


def natural_key(c: Column) -> Column:
    """A key that sorts digit runs by value; unassigned and null last."""
    parts = F.regexp_extract_all(c, F.lit("(\\d+|\\D+)"))
    padded = F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^\\d"), F.lpad(x, 10, "0")).otherwise(x)), "")
    return F.when(c.isNull() | (c == UNASSIGNED), F.lit("\uffff")).otherwise(padded)


def chapter_label(c: Column) -> Column:
    number = F.regexp_extract(c, "^(\\d+)(?:\\.|$)", 1)
    return F.when(c.isNull() | (c == ""), "未分章").when(number != "", F.concat(F.lit("第 "), F.regexp_replace(number, "^0+(?=\\d)", ""), F.lit(" 章"))).otherwise(c)


def file_title(c: Column) -> Column:
    t = trim_all(c)
    bare = trim_all(F.regexp_replace(t, "(?i)\\.(pdf|docx?|png|jpe?g)$", ""))
    return F.when(t != "", F.when(bare != "", bare).otherwise(t))


def volume(c: Column) -> Column:
    pattern = "(选择性\\s*必修|选择性\\s*选修|必修|选修)\\s*(第\\s*[一二三四五六七八九十\\d]+\\s*册)"
    strip = lambda k: F.regexp_replace(F.regexp_extract(c, pattern, k), "\\s+", "")
    return F.when(F.regexp_extract(c, pattern, 0) != "", F.concat_ws(" ", strip(1), strip(2)))


def heading(c: Column) -> Column:
    """struct(number, title) of 'chapter' and 'n.m title' headings; full-width digits count."""
    t = F.translate(trim_all(c), "０１２３４５６７８９．", "0123456789.")
    pattern = "^(第\\s*[一二三四五六七八九十百零\\d]+\\s*[章节]|\\d+(?:\\.\\d+)*)\\s*(.*)$"
    number = F.regexp_extract(t, pattern, 1)
    return F.struct(F.when(number != "", number).alias("number"), F.when(number != "", F.regexp_extract(t, pattern, 2)).otherwise(t).alias("title"))


def strip_suffixes(c: Column) -> Column:
    return F.regexp_replace(c, f"^(.+?)(?:{'|'.join(SUFFIXES)})+$", "$1")


def in_locale(c: Column, locale: str = "zh") -> Column:
    """A text as a key of the locale's order (Chinese by sound); its value stays as it is, so results show what they showed."""
    return F.collate(c, locale)


def knowledge_text(c: Column) -> Column:
    spaces = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"{_WS}+", "")
    return F.regexp_replace(spaces, "[，。、“”‘’；：:,.()\\[\\]{}<>《》【】|_—-]", "")


def character_overlap(a: Column, b: Column) -> Column:
    """Shared distinct characters over those of the poorer text; 0 if either is empty."""
    x, y = (F.array_distinct(F.filter(F.split(t, ""), lambda k: k != "")) for t in (a, b))
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def slug(c: Column, empty: str = "unknown") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(trim_all(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s.isNull() | (s == ""), F.lit(empty)).otherwise(s)


def join_labels(*parts: Column, sep: str = " · ") -> Column:
    return F.concat_ws(sep, *[blank_to_null(p) for p in parts])


def mapped(values: dict[str, str], key: Column, other: str | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    found = F.try_element_at(table, key)
    return F.coalesce(found, F.lit(other)) if other is not None else found


def content_type(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.endswith(".png"), "image/png").when(p.endswith(".jpg") | p.endswith(".jpeg"), "image/jpeg").when(p.endswith(".webp"), "image/webp").otherwise("application/octet-stream")


def strip_data_url(c: Column) -> Column:
    return F.regexp_replace(c, "^data:[^,]*;base64,", "")


def figure_parts(c: Column) -> Column:
    """Text and figure parts of content with [[figure:id]] tokens, in order; empty text is dropped."""
    ids = F.regexp_extract_all(c, F.lit("\\[\\[figure:([^\\]]+)\\]\\]"), F.lit(1))
    texts = F.split(c, "\\[\\[figure:[^\\]]+\\]\\]")
    part = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    pairs = F.zip_with(texts, ids, lambda t, i: F.array(part("text", t), part("figure", i)))
    return F.filter(F.flatten(pairs), lambda p: p["value"].isNotNull() & (p["value"] != ""))


def task_summary(titles: Column) -> Column:
    names = F.array_distinct(F.filter(F.transform(titles, trim_all), lambda x: x.isNotNull() & (x != "")))
    short = F.array_join(F.slice(names, 1, 3), "、")
    return F.when(F.size(names) <= 3, short).otherwise(F.concat(short, F.lit(" 等 "), F.size(names).cast("string"), F.lit(" 个知识点")))


def first_match(c: Column, cascade: list[tuple[str, str]], other: str | None) -> Column:
    """The name of the first pattern that c has."""
    out = None
    for pattern, name in cascade:
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out.otherwise(F.lit(other))


#: Ordered patterns that tell kinds from text.
MATERIAL_KINDS = [
    ("易错|误区|避坑|注意", "common_mistake"),
    ("题型|类型|套路|总结", "question_type_summary"),
    ("考情|高频|命题|趋势|考点", "exam_trend"),
    ("解析|答案|手写|步骤", "solution_summary"),
    ("方法|大招|技巧|口诀|检验|分类讨论|公式", "method_card"),
    ("教材|定义|性质|概念", "concept_explanation"),
    ("建议|复习|学习|审题", "study_advice"),
]
QUESTION_KINDS = [("选择|choice|单选|多选", "choice"), ("填空|fill", "fill_in"), ("证明|proof", "proof"), ("解答|计算|solution", "solution"), ("简答|short", "short_answer")]
UNIT_KINDS = [("(?i)slide|页内|PPT|幻灯", "slide"), ("question|题", "question_region"), ("explanation|解析|答案", "explanation_region"), ("page|页", "page")]
SOURCE_KINDS = [
    ("(?i)答案|解析册|answer", "answer_book"),
    ("(?i)试卷|高考|联考|模拟卷|exam|paper", "exam_paper"),
    ("(?i)教材|必修|选择性必修|textbook", "textbook"),
    ("(?i)讲义|PPT|打印版|课件|第\\d+讲|第[一二三四五六七八九十]+讲|handout|lesson", "lesson_handout"),
    ("(?i)题集|习题|练习|workbook", "workbook"),
    ("(?i)题包|question_pack", "question_pack"),
]
STAGES = [("小学", "primary"), ("初中", "junior"), ("高中|高一|高二|高三", "senior")]
GRADES = [("(?i)高一|g10|10年级", "g10"), ("(?i)高二|g11|11年级", "g11"), ("(?i)高三|g12|12年级", "g12")]
NON_LEARNING = [
    ("(?i)扫码|二维码|QR\\s*code|关注.*资料|加群|客服|课程顾问", "qr_code"),
    ("(?i)优惠|报名|续班|领取|课程顾问|招生|广告|低至|限时", "advertisement"),
    ("老师介绍|教师介绍|主讲老师|授课老师|名师|教龄", "teacher_intro"),
    ("版权|©|Copyright|禁止翻印|内部资料", "copyright"),
    ("页脚|页码|第\\s*\\d+\\s*页\\s*/\\s*\\d+", "page_footer"),
    ("目录|导航|上一页|下一页|返回首页", "duplicate_navigation"),
]


def material_kind(requested: Column, title: Column, content: Column) -> Column:
    search = F.concat_ws("\n", requested, title, content)
    return F.when(requested.isin(*MATERIAL_LABELS), requested).otherwise(first_match(search, MATERIAL_KINDS, "concept_explanation"))


def question_kind(c: Column) -> Column:
    raw = F.lower(trim_all(F.coalesce(c, F.lit(""))))
    known = ("choice", "fill_in", "proof", "solution", "short_answer", "unknown")
    return F.when(raw.isin(*known), raw).otherwise(first_match(raw, QUESTION_KINDS, "unknown"))


def unit_kind(c: Column) -> Column:
    raw = trim_all(F.coalesce(c, F.lit("")))
    known = ("page", "slide", "question_region", "explanation_region", "text_block")
    return F.when(raw.isin(*known), raw).otherwise(first_match(raw, UNIT_KINDS, "text_block"))


def source_facts(title: Column) -> Column:
    """Type, stage, grade, year, season and lesson read off a title."""
    lesson = F.regexp_extract(title, "第\\s*([0-9一二三四五六七八九十百]+)\\s*讲", 1)
    year = F.regexp_extract(title, "(20\\d{2})", 1)
    return F.struct(
        first_match(title, SOURCE_KINDS, "mixed_material").alias("source_type"),
        first_match(title, STAGES, "senior").alias("stage"),
        first_match(title, GRADES, "").alias("grade"),
        F.when(year != "", year.cast("int")).alias("year"),
        F.regexp_extract(title, "(春季|暑假|暑期|秋季|寒假|冬季)", 1).alias("season"),
        F.when(lesson != "", F.concat(F.lit("第"), lesson, F.lit("讲"))).otherwise("").alias("lesson_no"),
    )


def finds(c: Column, pattern: str) -> Column:
    """c.rlike(pattern) for a pattern of alternatives without groups, by plain searches wherever words will do.

    A search for a word is several times cheaper than a pattern that tries all
    words at every place; a pattern that begins with a word is tried only on
    texts that hold it.
    """
    fold = pattern.startswith("(?i)")
    tests = []
    for part in pattern.removeprefix("(?i)").split("|"):
        lead = re.match(r"[^\\.^$*+?()\[\]{}]*", part)[0]
        # a word in front of a repeat may lose its last letter
        lead = lead[:-1] if part[len(lead) : len(lead) + 1] in ("*", "+", "?", "{") and lead else lead
        cased = fold and part.lower() != part.upper()
        if lead == part and not cased:
            tests.append(F.contains(c, F.lit(part)))
        elif lead and not cased:
            tests.append(F.contains(c, F.lit(lead)) & c.rlike(part))
        else:
            tests.append(c.rlike(f"(?i){part}" if fold else part))
    return reduce(lambda a, b: a | b, tests)


def non_learning(c: Column) -> Column:
    """Categories of text that teaches nothing; empty for learning text."""
    text = F.coalesce(c, F.lit(""))
    hits = [F.when(finds(text, p), F.lit(name)) for p, name in NON_LEARNING]
    outside = finds(text, "班主任|公众号|小程序|讲座|福利") & ~finds(text, "集合|函数|数学|物理|化学|语文|英语")
    return F.array_compact(F.array(*hits, F.when(outside, F.lit("non_subject_content"))))


def quality(requested: Column, content: Column, answer: Column, solution: Column) -> Column:
    empty = lambda c: F.coalesce(trim_all(c), F.lit("")) == ""
    known = ("publishable", "needs_review", "missing_answer", "missing_solution", "incomplete_stem")
    return F.when(empty(content), "incomplete_stem").when(empty(answer), "missing_answer").when(empty(solution), "missing_solution").when(requested.isin(*known), requested).otherwise("publishable")


def parse_options(options: Column) -> Column:
    """'A. text' strings as struct(label, text); the place gives a missing label."""
    pattern = "^\\s*([A-Ha-h])[\\s.．、:：]*(.*)$"

    def one(x: Column, k: Column) -> Column:
        label = F.upper(F.regexp_extract(x, pattern, 1))
        return F.struct(F.when(label != "", label).otherwise(F.chr(k + 65)).alias("label"), F.when(label != "", trim_all(F.regexp_extract(x, pattern, 2))).otherwise(x).alias("text"))

    return F.transform(options, one)


def stage_rank(c: Column) -> Column:
    return F.when(c == "primary", 0).when(c == "junior", 1).when(c == "senior", 2).otherwise(99)


def grade_number(c: Column) -> Column:
    return F.when(c.rlike("^g([1-9]|1[0-2])$"), F.substring(c, 2, 2).cast("int"))


def normalise_output(c: Column, steps: list[str]) -> Column:
    """Provider-declared output rules in their order."""
    rules = {
        "zh_punct_to_ascii": lambda x: F.translate(x, "，。；：（）", ",.;:()"),
        "prefix_chapter_with_section_sign": lambda x: F.regexp_replace(x, "^(\\d+(?:\\.\\d+)*)", "§$1"),
        "normalize_chapter_subsection": lambda x: F.regexp_replace(x, "(\\d)\\s*[-－]\\s*(\\d)", "$1.$2"),
    }
    for step in steps:
        c = rules[step](c)
    return c


#: What asks for an action, what introduces or advertises, and kinds of question that are no action.
ACTION = "(?<!要)求|计算|证明|选择|选出|填空|填写|回答|解答|完成|补全|写出|列出|判断|化简|解方程|作图|画出|说明理由|请说明|问[:：]|多少|哪(?:个|项|一项)|下列|正确|错误|_{2,}|____|（\\s*）|\\(\\s*\\)|\\?|？"
INSTRUCTION = "(?i)题型\\s*[一二三四五六七八九十\\d]+|题型讲解|知识点|方法总结|考点|技巧|口诀|扫码|二维码|公众号|课程|视频|讲解|例题|广告|LOOK AT ME|看成一个整体|插空法|捆绑法"
KINDS = "(?:选择|填空|解答|判断|材料|计算|证明)题"


def is_question(q: Column) -> Column:
    """Whether a parsed question is one: it has content, and asks for something if it reads like an instruction.

    q is a struct of type, stem, answer_area, answer, analysis, figure_description,
    raw_text, options (strings), sub_questions (number, stem, answer, analysis) and
    figures (description, labels). Two options or a sub-question ask by themselves.
    """
    given = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    size = lambda c: F.greatest(F.size(c), F.lit(0))
    options, subs, figures = q["options"], q["sub_questions"], q["figures"]
    content = given(q["stem"]) | (size(options) > 0) | (size(subs) > 0) | given(q["answer_area"]) | given(q["answer"]) | given(q["analysis"])
    parts = [q[c] for c in ("stem", "answer_area", "answer", "analysis", "raw_text")]
    inner = lambda *names: F.array_join(F.transform(subs, lambda s: F.concat_ws("\n", *[s[n] for n in names])), "\n")
    action = F.regexp_replace(F.concat_ws("\n", *parts, F.array_join(options, "\n"), inner("stem", "answer", "analysis")), KINDS, "")
    drawn = F.array_join(F.transform(figures, lambda f: F.concat_ws("\n", f["description"], F.array_join(f["labels"], "\n"))), "\n")
    every = F.concat_ws("\n", q["type"], *parts, q["figure_description"], F.array_join(options, "\n"), inner("number", "stem", "answer", "analysis"), drawn)
    asks = (size(options) >= 2) | (size(subs) > 0) | action.rlike(ACTION)
    return content & (~every.rlike(INSTRUCTION) | asks)
