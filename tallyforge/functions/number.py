"""Numbers, dates, weights and boxes as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pool order, mode weights (progress, mistake, review), band limits, review steps in days.
PRIORITY = {"spaced_review": 100, "mistake_variant": 90, "chapter_practice": 70, "new_knowledge": 60, "feynman_check": 50}
MODE_WEIGHTS = {"daily_mixed": (0.4, 0.3, 0.3), "chapter_focus": (0.7, 0.1, 0.2), "mistake_focus": (0.1, 0.7, 0.2)}
REVIEW_DAYS = (1, 3, 7, 15, 30, 60)


def half_up(c: Column, digits: int = 0) -> Column:
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def percent(score: Column) -> Column:
    return F.floor(clamp(score, 0.0, 1.0) * 100 + 0.5).cast("int")


def mastery_delta(difficulty: Column, correct: Column) -> Column:
    """Change of mastery in hundredths."""
    return F.when(difficulty <= 2, F.when(correct, 5).otherwise(-15)).when(difficulty == 3, F.when(correct, 10).otherwise(-8)).otherwise(F.when(correct, 15).otherwise(-3))


def mastery_band(score: Column) -> Column:
    return F.when(score < 0.2, "not_started").when(score < 0.5, "needs_work").when(score < 0.85, "learning").otherwise("mastered")


def progress_status(score: Column, peak: Column) -> Column:
    """Status of a learner's knowledge point; a null score is one without a row."""
    return F.when(score.isNull(), "not_started").when((score < 0.2) & (peak >= 0.5), "regressed").when(score < 0.5, "needs_work").when(score < 0.85, "learning").otherwise("mastered")


def difficulty_range(mastery: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """struct(low, high) for a mastery; with a request, their overlap or else the request."""
    base_low = F.when(mastery < 0.2, 1).when(mastery < 0.5, 2).when(mastery < 0.85, 3).otherwise(4)
    if low is None:
        return F.struct(base_low.alias("low"), (base_low + 1).alias("high"))
    a, b = F.least(low, high), F.greatest(low, high)
    x, y = F.greatest(base_low, a), F.least(base_low + 1, b)
    return F.struct(F.when(x <= y, x).otherwise(a).alias("low"), F.when(x <= y, y).otherwise(b).alias("high"))


def weight(c: Column, default: int) -> Column:
    """A weight as an integer from 0 to 100; text that is no number gives the default."""
    n = c.try_cast("double")
    return F.when(n.isNull() | F.isnan(n), default).otherwise(clamp(F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("double"), 0, 100)).cast("int")


def bounded_int(c: Column, low: int, high: int, default: int) -> Column:
    n = c.try_cast("int")
    return F.when(n.between(low, high), n).otherwise(default)


def clamp_int(c: Column, low: int, high: int) -> Column:
    """Truncated and bounded; null, NaN and infinities give low."""
    good = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    cut = F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))
    return F.when(good, F.greatest(F.lit(low), F.least(F.lit(high), cut)).cast("int")).otherwise(low)


def overdue_days(due: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(due)) / F.lit(8.64e10))


def review_interval(index: Column, near_exam: Column) -> Column:
    days = F.element_at(F.array(*map(F.lit, REVIEW_DAYS)), F.least(F.lit(len(REVIEW_DAYS)), index + 1))
    return F.when(near_exam, days * 0.5).otherwise(days * 1.0)


def retry_delay_ms(retry_after: Column, text: Column, attempt: Column, now: Column | None = None) -> Column:
    """Retry-After seconds or HTTP date, else 'retry after N' in the text (whole seconds upwards), else doubling from 10 s to 60 s."""
    said = F.regexp_extract(F.lower(F.coalesce(text, F.lit(""))), "retry after\\s+([\\d.]+)", 1)
    backoff = F.least(F.lit(60000.0), F.lit(10000.0) * F.pow(F.lit(2.0), attempt))
    seconds = retry_after.try_cast("double")
    date = F.regexp_extract(retry_after, "^[A-Za-z]{3}, (\\d{1,2} [A-Z][a-z]{2} \\d{4} \\d{2}:\\d{2}:\\d{2} GMT)$", 1)
    until = F.try_to_timestamp(F.when(date != "", date), F.lit("d MMM yyyy HH:mm:ss z"))
    away = F.when(until.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(until) - F.unix_micros(F.current_timestamp() if now is None else now)) / 1000.0))
    hint = F.when(said != "", said).try_cast("double")
    return F.coalesce(F.when((seconds >= 0) & (seconds < 1e12), F.ceil(seconds * 1000).cast("double")), away, F.ceil(hint).cast("double") * 1000, backoff).cast("long")


def page_progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(30 + done / total * 55 + 0.5)).otherwise(30).cast("int")


def page_list(values: Column, start: Column, stop: Column) -> Column:
    """Positive pages of a list and of a range, distinct and ascending."""
    single = F.filter(F.transform(values, lambda x: x.try_cast("double")), lambda x: x.isNotNull() & ~F.isnan(x) & (x > 0) & (x == F.floor(x)))
    spread = F.when((start > 0) & (stop >= start), F.sequence(start.cast("long"), stop.cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.array_sort(F.array_distinct(F.concat(F.transform(single, lambda x: x.cast("long")), spread)))


def pixel_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A percent box in pixels: outward rounding, at least one pixel, inside the image."""
    low = lambda c, size: F.floor(clamp(c, 0.0, 100.0) / 100 * size).cast("int")
    high = lambda c, size: F.ceil(clamp(c, 0.0, 100.0) / 100 * size).cast("int")
    left, top = low(x, width), low(y, height)
    return F.struct(left.alias("left"), top.alias("top"), F.greatest(F.lit(1), high(x + w, width) - left).alias("width"), F.greatest(F.lit(1), high(y + h, height) - top).alias("height"))


def mode_budgets(count: int, mode: str) -> dict[str, int]:
    """Slots per weighted pool: whole shares, then one each by weight and priority until all are out."""
    pools = ("progress", "mistake_variant", "spaced_review")
    rank = {"progress": 0, "mistake_variant": 1, "spaced_review": 2}
    weights = dict(zip(pools, MODE_WEIGHTS[mode]))
    out = {p: int(count * w) for p, w in weights.items()}
    order = sorted(pools, key=lambda p: (-weights[p], -rank[p]))
    for k in range(count - sum(out.values())):
        out[order[k % len(order)]] += 1
    return out


def mode_slots(count: Column, mode: Column) -> Column:
    """mode_budgets of columns: struct(progress, mistake_variant, spaced_review); an unknown mode has none."""
    pools = ("progress", "mistake_variant", "spaced_review")

    def one(weights: tuple) -> Column:
        whole = [F.floor(count * F.lit(float(w))).cast("int") for w in weights]
        left = count.cast("int") - sum(whole[1:], whole[0])
        order = sorted(range(3), key=lambda p: (-weights[p], -p))
        # what is left goes round in that order
        more = [F.floor((left + 2 - order.index(p)) / 3).cast("int") for p in range(3)]
        return F.struct(*[(w + m).alias(name) for w, m, name in zip(whole, more, pools)])

    cases = [(mode == name, one(weights)) for name, weights in MODE_WEIGHTS.items()]
    out = F.when(*cases[0])
    for case in cases[1:]:
        out = out.when(*case)
    return out


def custom_budgets(count: int, weights: dict[str, int]) -> dict[str, int] | None:
    """Slots per pool by custom weights, largest remainders first; None when all weights are 0."""
    known = {p: w for p, w in weights.items() if w > 0}
    total = sum(known.values())
    if not total:
        return None
    exact = {p: count * w / total for p, w in known.items()}
    out = {p: int(x) for p, x in exact.items()}
    order = sorted(known, key=lambda p: (-(exact[p] - out[p]), -known[p], -PRIORITY[p]))
    for p in order[: count - sum(out.values())]:
        out[p] += 1
    return out


def apportion(shares: Column, count: Column) -> Column:
    """Largest-remainder shares of count for an array of struct(key, weight, rank), in their order."""
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x["weight"])
    exact = F.transform(shares, lambda x: F.struct(x["key"].alias("key"), x["weight"].alias("weight"), x["rank"].alias("rank"), (count * x["weight"] / total).alias("exact")))
    left = count - F.aggregate(exact, F.lit(0).cast("long"), lambda a, x: a + F.floor(x["exact"]))
    key = lambda x: F.struct(F.negative(x["exact"] - F.floor(x["exact"])).alias("a"), F.negative(x["weight"]).alias("b"), F.negative(x["rank"]).alias("c"))
    order = F.array_sort(F.transform(exact, key))
    return F.transform(exact, lambda x: F.struct(x["key"].alias("key"), (F.floor(x["exact"]) + F.when(F.array_position(order, key(x)) <= left, 1).otherwise(0)).cast("int").alias("slots")))


def is_expired(expires: Column, now: Column) -> Column:
    """Whether a token's expiry, in whole seconds, is before now; one without an expiry never expires."""
    return F.coalesce(expires < F.unix_seconds(now), F.lit(False))
