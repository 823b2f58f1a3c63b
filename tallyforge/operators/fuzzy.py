"""Matching of hints to knowledge points: tiers, scores, generated candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text, udf

#: Shared words of two characters that are no match by themselves.
STOP_WORDS = ("集合", "函数", "方程", "不等", "命题", "数列", "向量", "直线", "平面", "导数", "概率", "统计", "复数", "空间", "图象", "关系", "运算", "思想", "方法", "应用", "问题")
#: Item pattern, knowledge pattern, score.
RULES = (
    ("互异|回代|含参|参数", "互异|元素.*重复|元素.*不同|含参|参数", 0.86),
    ("子集|真子集|包含关系|A\\s*⊆|\\\\subset|包含于", "子集|真子集|集合间|基本关系|包含", 0.84),
    ("交集|并集|补集|集合运算|A\\s*[∩∪]|\\\\cap|\\\\cup", "交集|并集|补集|集合运算|交并补|运算", 0.84),
    ("子集个数|真子集个数|2\\^n|2\\\\\\^\\{?n\\}?|非空子集", "子集个数|真子集|子集|集合子集", 0.84),
    ("空集|∅|分类讨论|分情况", "空集|分类讨论|集合关系", 0.84),
)


def _pieces(c: Column, n: int) -> Column:
    """Distinct stretches of n characters of a text."""
    cut = F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda k: F.substr(c, k, F.lit(n)))
    return F.when(F.length(c) >= n, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def held_in(probes: DataFrame, texts: DataFrame) -> DataFrame:
    """(g, p, t) of all probes (g, p) that a text (g, t) of their group holds; both are distinct and not empty.

    A text is indexed by its pairs of characters and its characters. A probe is
    looked up by the rarest of its pairs alone (a probe of one character by
    that), and not at all if the index lacks one of them.
    """
    t, p = F.col("t"), F.col("p")
    index = texts.select("g", "t", F.explode(F.concat(_pieces(t, 2), _pieces(t, 1))).alias("key"))
    often = index.groupBy("g", "key").agg(F.count(F.lit(1)).alias("often"))
    own = probes.select("g", "p", F.explode(F.when(F.length(p) > 1, _pieces(p, 2)).otherwise(_pieces(p, 1))).alias("key"))
    rarest = own.join(often, ["g", "key"], "left").groupBy("g", "p").agg(F.min_by("key", F.struct("often", "key")).alias("key"), F.count_if(F.col("often").isNull()).alias("lacking"))
    return rarest.where("lacking = 0").select("g", "p", "key").join(index, ["g", "key"]).where(F.contains(t, p)).select("g", "p", "t")


def sharing(left: DataFrame, right: DataFrame, n: int) -> DataFrame:
    """(g, p, t) of pairs of texts (g, p) and (g, t) that share n characters in a row, but for pairs that share only a stop word."""
    keys = lambda c: F.filter(_pieces(F.col(c), n), lambda k: ~k.isin(*STOP_WORDS))
    a = left.select("g", "p", F.explode(keys("p")).alias("key"))
    return a.join(right.select("g", "t", F.explode(keys("t")).alias("key")), ["g", "key"]).select("g", "p", "t").distinct()


def match_hints(hints: DataFrame, points: DataFrame) -> DataFrame:
    """(hint_id, kp_id, tier) of hints (hint_id, subject_id, hint) against points (kp_id, subject_id, name).

    Tiers: equal, one holds the other, the same without domain suffixes, longest
    common substring (three characters, or two that are no stop word). The
    smallest kp_id wins a tie. Distinct hints and names meet over an index of
    their characters, never over the subject alone; only hints that no tier in
    front matches go on to the next one.
    """
    norm = lambda c: F.lower(text.trim_all(F.col(c)))
    own = hints.select("hint_id", F.col("subject_id").alias("g"), norm("hint").alias("h"))
    asked = own.where("h <> ''").select("g", "h").distinct()
    # of points with one name the first one alone can be chosen
    names = points.select(F.col("subject_id").alias("g"), norm("name").alias("n"), "kp_id").where("n IS NOT NULL").groupBy("g", "n").agg(F.min("kp_id").alias("kp_id"))
    named, as_probes, as_texts = names.where("n <> ''"), asked.select("g", F.col("h").alias("p")), asked.select("g", F.col("h").alias("t"))
    tier = F.when(F.col("h") == F.col("n"), 1).otherwise(2)
    holding = held_in(named.select("g", F.col("n").alias("p")), as_texts).select("g", F.col("t").alias("h"), F.col("p").alias("n"))
    held = held_in(as_probes, named.select("g", F.col("n").alias("t"))).select("g", F.col("p").alias("h"), F.col("t").alias("n"))
    bare = asked.withColumn("bare", text.strip_suffixes(F.col("h"))).where("bare <> h")
    stripped = held_in(bare.select("g", F.col("bare").alias("p")).distinct(), named.select("g", F.col("n").alias("t"))).join(bare.select("g", "h", F.col("bare").alias("p")), ["g", "p"]).select("g", "h", F.col("t").alias("n"), F.lit(3).alias("tier"))
    # a name of nothing is held by every hint; there is one such row a subject
    blank = asked.join(names.where("n = ''"), "g").select("g", "h", F.lit(2).alias("tier"), "kp_id")
    pairs = holding.unionByName(held).withColumn("tier", tier).unionByName(stripped).join(named, ["g", "n"]).select("g", "h", "tier", "kp_id").unionByName(blank)
    best = lambda df, *order: df.groupBy("g", "h").agg(F.min(F.struct(*order, "kp_id")).alias("best"))
    direct = best(pairs, "tier").select("g", "h", F.col("best.tier").alias("tier"), F.col("best.kp_id").alias("kp_id"))

    def fuzzy(left: DataFrame, n: int) -> DataFrame:
        met = sharing(left.select("g", F.col("h").alias("p")), named.select("g", F.col("n").alias("t")), n).withColumn("common", udf.common_substring(F.col("p"), F.col("t")))
        shared = F.length("common")
        met = met.where((shared > 2) | ((shared == 2) & ~F.col("common").isin(*STOP_WORDS))).select("g", F.col("p").alias("h"), F.col("t").alias("n"), F.negative(shared).alias("a"))
        return best(met.join(named, ["g", "n"]), "a").select("g", "h", F.lit(4).alias("tier"), F.col("best.kp_id").alias("kp_id"))

    rest = asked.join(direct, ["g", "h"], "left_anti")
    three = fuzzy(rest, 3)
    two = fuzzy(rest.join(three, ["g", "h"], "left_anti"), 2)
    found = direct.unionByName(three).unionByName(two)
    return own.join(found, ["g", "h"], "left").select("hint_id", "kp_id", "tier")


def match_score(item: Column, hint: Column, name: Column, search: Column) -> Column:
    """Score of an item (its text and a hint) against a point (its name and search text)."""
    i, h, n, s = (text.knowledge_text(c) for c in (item, hint, name, search))
    given = h != ""
    scores = [
        F.when(given & (h == n), 0.98),
        F.when(given & (F.contains(s, h) | F.contains(h, n)), 0.88),
        F.when((n != "") & F.contains(i, n), 0.82),
        *[F.when(item.rlike(a) & search.rlike(b), score) for a, b, score in RULES],
    ]
    overlap = text.character_overlap(i, s)
    return F.greatest(*scores, F.when(overlap >= 0.55, 0.62).when(overlap >= 0.35, 0.48).otherwise(0.0))


def _overlapping(items: DataFrame, points: DataFrame, least: float = 0.35) -> DataFrame:
    """(item_id, kp_id) of items (g, item_id, i) and points (g, kp_id, s) whose character overlap can reach least.

    Of the poorer text's m distinct characters least * m are shared, so one of
    its rarest m - least * m + 1 is: those alone are looked up in the other text.
    """
    chars = lambda c: _pieces(F.col(c), 1)
    point = points.select("g", "kp_id", chars("s").alias("all")).withColumn("m", F.size("all")).where("m > 0")
    item = items.select("g", "item_id", chars("i").alias("all")).withColumn("m", F.size("all")).where("m > 0")
    often = point.select("g", F.explode("all").alias("key")).groupBy("g", "key").agg(F.count(F.lit(1)).alias("often"))

    def ranked(df: DataFrame, own: str) -> DataFrame:
        """Each character of a text with its place among them, the rarest first."""
        each = df.select("g", own, "m", F.explode("all").alias("key")).join(often, ["g", "key"], "left")
        return each.withColumn("place", F.row_number().over(Window.partitionBy("g", own).orderBy(F.coalesce("often", F.lit(0)), "key")))

    prefix = F.col("place") <= F.col("m") - F.ceil(F.col("m") * least) + 1
    a, b = ranked(item, "item_id"), ranked(point, "kp_id")
    pick = lambda df, own, size: df.select("g", "key", own, F.col("m").alias(size))
    poorer_item = pick(a.where(prefix), "item_id", "x").join(pick(b, "kp_id", "y"), ["g", "key"]).where("x <= y")
    poorer_point = pick(a, "item_id", "x").join(pick(b.where(prefix), "kp_id", "y"), ["g", "key"]).where("y < x")
    return poorer_item.unionByName(poorer_point).select("g", "item_id", "kp_id").distinct()


def best_match(items: DataFrame, points: DataFrame, on: str, least: float = 0.45) -> DataFrame:
    """Each item's best point of its group by score, the smallest kp_id first; below least there is none.

    Items (item_id, on, item_text, hint) and points (kp_id, on, name,
    search_text) meet where one text holds the other, where both sides of a rule
    match (the rule's first point stands for all), and, for items that neither
    gives a point, where enough characters are shared; pairs that can't reach
    least are never made.
    """
    known = lambda c: text.knowledge_text(F.col(c))
    item = items.select(F.col(on).alias("g"), "item_id", "item_text", "hint", known("item_text").alias("i"), known("hint").alias("h"))
    point = points.select(F.col(on).alias("g"), "kp_id", "name", "search_text", known("name").alias("n"), known("search_text").alias("s"))
    strings = lambda df, c, to: df.where(F.col(c) != "").select("g", F.col(c).alias(to)).distinct()
    in_hint = held_in(strings(point, "n", "p"), strings(item, "h", "t")).select("g", F.col("t").alias("h"), F.col("p").alias("n"))
    in_item = held_in(strings(point, "n", "p"), strings(item, "i", "t")).select("g", F.col("t").alias("i"), F.col("p").alias("n"))
    in_search = held_in(strings(item, "h", "p"), strings(point, "s", "t")).select("g", F.col("p").alias("h"), F.col("t").alias("s"))
    ids, kps = item.select("g", "item_id", "h", "i"), point.select("g", "kp_id", "n", "s")
    made = [in_hint.join(ids, ["g", "h"]).join(kps, ["g", "n"]), in_item.join(ids, ["g", "i"]).join(kps, ["g", "n"]), in_search.join(ids, ["g", "h"]).join(kps, ["g", "s"])]
    blank = point.where("n = ''").groupBy("g").agg(F.min("kp_id").alias("kp_id"))
    made.append(item.where("h <> ''").join(blank, "g"))
    for a, b, _ in RULES:
        first = point.where(F.col("search_text").rlike(b)).groupBy("g").agg(F.min("kp_id").alias("kp_id"))
        made.append(item.where(F.col("item_text").rlike(a)).join(first, "g"))

    def scored(pairs: DataFrame) -> DataFrame:
        score = match_score(F.col("item_text"), F.col("hint"), F.col("name"), F.col("search_text"))
        full = pairs.join(item.select("g", "item_id", "item_text", "hint"), ["g", "item_id"]).join(point.select("g", "kp_id", "name", "search_text"), ["g", "kp_id"]).withColumn("score", score)
        best = full.where(F.col("score") >= least).groupBy("item_id").agg(F.min(F.struct(F.negative("score").alias("a"), "kp_id")).alias("best"))
        return best.select("item_id", F.col("best.kp_id").alias("kp_id"), F.negative("best.a").alias("score"))

    pairs = made[0].select("g", "item_id", "kp_id")
    for more in made[1:]:
        pairs = pairs.unionByName(more.select("g", "item_id", "kp_id"))
    strong = scored(pairs.distinct())
    rest = item.join(strong, "item_id", "left_anti")
    return strong.unionByName(scored(_overlapping(rest, point)))


def generated_points(items: DataFrame) -> DataFrame:
    """Distinct hints as candidate points, named by a hash of their normal form; the first spelling stays."""
    rows = items.withColumn("key", text.knowledge_text(F.col("hint"))).where("key <> ''")
    first = rows.groupBy("key").agg(F.min_by("hint", "item_id").alias("name"))
    return first.select(F.concat(F.lit("kp-generated-hint-"), udf.string_hash(F.col("key"))).alias("kp_key"), "name")


def resolve_points(items: DataFrame, points: DataFrame) -> DataFrame:
    """(item_id, kp_ids, tier) of items (item_id, subject_id, ids, hints): ids that the subject has, else points named by a hint.

    ids and hints are arrays, in which nulls, blanks and repeats don't count;
    names are compared as they are. Items that neither resolves have no points.
    """
    own = points.select(F.col("subject_id").alias("g"), "kp_id", F.col("name").alias("n"))
    asked = items.select("item_id", F.col("subject_id").alias("g"), F.explode(F.array_distinct("ids")).alias("kp_id"))
    by_id = asked.join(own.select("g", "kp_id"), ["g", "kp_id"]).groupBy("item_id").agg(F.array_sort(F.collect_set("kp_id")).alias("kp_ids"))
    hinted = items.join(by_id, "item_id", "left_anti").select("item_id", F.col("subject_id").alias("g"), F.explode(F.array_distinct(F.transform("hints", text.trim_all))).alias("n"))
    by_name = hinted.where("n <> ''").join(own, ["g", "n"]).groupBy("item_id").agg(F.array_sort(F.collect_set("kp_id")).alias("kp_ids"))
    found = by_id.withColumn("tier", F.lit(1)).unionByName(by_name.withColumn("tier", F.lit(2)))
    return items.select("item_id").join(found, "item_id", "left")


def rerun_match(old: DataFrame, new: DataFrame) -> DataFrame:
    """For each old row of an upload the new row to take: same number, same 30-character start, else the first.

    Of the new rows the first one of each number, of each start and of each
    upload is kept before old rows meet them, so an old row meets three at
    most, and no content is sent but the starts.
    """
    start = lambda c: F.substring(F.regexp_replace(c, "\\s+", ""), 1, 30)
    long_start = lambda c: F.when(F.length(c) > 10, c)
    o = old.select("upload_id", "old_id", "number", long_start(start(F.col("content"))).alias("c"))
    n = new.select("upload_id", "new_id", "number", long_start(start(F.col("content"))).alias("c"))
    rows = o
    for tier, on in enumerate((["upload_id", "number"], ["upload_id", "c"], ["upload_id"]), 1):
        first = n.dropna(subset=on).groupBy(*on).agg(F.min("new_id").alias(f"n{tier}"))
        rows = rows.join(first, on, "left")
    tiers = [F.when(F.col(f"n{k}").isNotNull(), F.struct(F.lit(k).alias("tier"), F.col(f"n{k}").alias("new_id"))) for k in (1, 2, 3)]
    best = rows.select("old_id", F.coalesce(*tiers).alias("b")).where("b IS NOT NULL").groupBy("old_id").agg(F.min("b").alias("b"))
    return best.select("old_id", F.col("b.new_id").alias("new_id"), F.col("b.tier").alias("tier"))
