"""JSON that models write: extraction, tolerant parsing, aliases, numbers, checks (on VARIANT)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_all


def candidate(c: Column) -> Column:
    """The first fenced block, else the text from the first '{' to the last '}', else null."""
    fenced = F.regexp_extract(c, "(?s)```(?:json)?\\s*(.*?)```", 1)
    start, back = F.instr(c, "{"), F.instr(F.reverse(c), "}")
    stop = F.length(c) - back + 1
    braces = F.when((start > 0) & (back > 0) & (stop >= start), F.substr(c, start, stop - start + 1))
    return F.when(trim_all(fenced) != "", trim_all(fenced)).otherwise(braces)


def tolerant(c: Column) -> Column:
    """struct(value VARIANT, error): error says why there is no value."""
    found = candidate(c)
    value = F.try_parse_json(found)
    error = F.when(found.isNull(), "no JSON object found").when(value.isNull(), "JSON does not parse")
    return F.struct(value.alias("value"), error.alias("error"))


def field(v: Column, kind: str, *names: str) -> Column:
    """The first of the named members that is there and not null."""
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", kind) for n in names])


def text_field(v: Column, *names: str, default: str | None = None) -> Column:
    found = F.coalesce(*[F.when(trim_all(F.try_variant_get(v, f"$.{n}", "string")) != "", trim_all(F.try_variant_get(v, f"$.{n}", "string"))) for n in names])
    return F.coalesce(found, F.lit(default)) if default is not None else found


def coerce_number(v: Column, name: str) -> Column:
    """A member as a number the way scripts take it: null and '' are 0, absent or other text is null."""
    member = F.try_variant_get(v, f"$.{name}", "variant")
    said = trim_all(F.try_variant_get(v, f"$.{name}", "string"))
    flag = F.try_variant_get(v, f"$.{name}", "boolean")
    return F.when(member.isNull(), F.lit(None).cast("double")).when(F.is_variant_null(member) | (said == ""), 0.0).when(said.isin("true", "false"), flag.cast("double")).otherwise(said.try_cast("double"))


def elements(v: Column, *names: str) -> Column:
    """An array member as array<variant>; anything else is an empty array."""
    found = F.coalesce(*[F.try_variant_get(v, f"$.{n}", "array<variant>") for n in names])
    return F.coalesce(found, F.array().cast("array<variant>"))


def positive_page(v: Column, *names: str) -> Column:
    n = F.coalesce(*[F.try_variant_get(v, f"$.{x}", "string").try_cast("double") for x in names])
    return F.when((n > 0) & (n == F.floor(n)), n.cast("int"))


def box(v: Column) -> Column:
    """A box as struct(x, y, w, h), from an array or either object form, clamped to 0..100; null if incomplete."""
    at = lambda k, *names: F.coalesce(F.try_variant_get(v, f"$[{k}]", "double"), *[F.try_variant_get(v, f"$.{n}", "double") for n in names])
    parts = [at(0, "x", "left"), at(1, "y", "top"), at(2, "w", "width"), at(3, "h", "height")]
    clamped = [F.greatest(F.lit(0.0), F.least(F.lit(100.0), p)) for p in parts]
    whole = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull() & parts[3].isNotNull()
    return F.when(whole, F.struct(*[c.alias(n) for c, n in zip(clamped, ("x", "y", "w", "h"))]))


def table_matrix(v: Column) -> Column:
    """struct(columns, rows) of a table member: columns from its headers or else its first row's keys.

    Rows may be lists or objects; cells become text and missing ones are empty.
    """
    rows = elements(v, "rows", "data")
    headers = F.try_variant_get(v, "$.headers", "array<string>")
    keys = F.map_keys(F.try_variant_get(F.get(rows, F.lit(0)), "$", "map<string,variant>"))
    columns = F.coalesce(headers, F.array_sort(keys), F.array().cast("array<string>"))

    def line(r: Column) -> Column:
        listed = F.try_variant_get(r, "$", "array<string>")
        named = F.try_variant_get(r, "$", "map<string,string>")
        return F.coalesce(F.transform(listed, lambda x: F.coalesce(x, F.lit(""))), F.transform(columns, lambda c: F.coalesce(F.try_element_at(named, c), F.lit(""))))

    return F.struct(columns.alias("columns"), F.transform(rows, line).alias("rows"))


def question_problems(q: Column) -> Column:
    """Violations of a parsed question (struct of content, question_type, options, answer, solution_text, difficulty, kp_hints)."""
    labels = F.transform(q["options"], lambda o: o["label"])
    letters = F.filter(F.split(F.regexp_replace(F.upper(q["answer"]), "[^A-Z]", ""), ""), lambda x: x != "")
    choice = q["question_type"] == "choice"
    hints = F.coalesce(q["kp_hints"], F.array().cast("array<string>"))
    size = F.coalesce(F.size(q["options"]), F.lit(0))
    rules = (
        (~F.length(q["content"]).between(5, 2000), "content_length"),
        (~q["question_type"].isin("choice", "fill_in"), "question_type"),
        (choice & (size < 2), "too_few_options"),
        (choice & ((F.size(letters) == 0) | (F.size(F.array_except(letters, labels)) > 0)), "answer_not_an_option"),
        ((q["question_type"] == "fill_in") & (size > 0), "unexpected_options"),
        (F.exists(labels, lambda x: ~x.rlike("^[A-H]$")), "option_label"),
        (~F.length(q["answer"]).between(1, 500), "answer_length"),
        (F.length(q["solution_text"]) > 3000, "solution_length"),
        (~q["difficulty"].between(1, 5) | (q["difficulty"] != F.floor(q["difficulty"])), "difficulty"),
        (F.size(hints) == 0, "no_hints"),
        (F.size(F.array_distinct(hints)) < F.size(hints), "repeated_hints"),
    )
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in rules]))


def batch_size_ok(n: Column, most: int = 300) -> Column:
    return n.between(1, most)
