"""Functions that Spark's built-ins can't express, as Arrow-batched UDFs."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .latex import show_latex


def _text_udf(f: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """A column function of f; the UDF is made on use, so that workers can import this module."""

    def over(c: Column) -> Column:
        def run(s: pd.Series) -> pd.Series:
            return s.map(f, na_action="ignore").astype(object)

        return F.pandas_udf(run, "string")(c)

    return over


nfkc = _text_udf(lambda x: x if x.isascii() else unicodedata.normalize("NFKC", x))


def longest_common(a: str, b: str) -> str:
    """The longest common substring; of equal ones that which ends first in a.

    Whether one of n characters exists is a question of two sets of substrings,
    and falls with n, so the length is found by halving.
    """
    found, low, high = "", 1, min(len(a), len(b))
    while low <= high:
        n = (low + high) // 2
        there = {b[k : k + n] for k in range(len(b) - n + 1)}
        hit = next((a[k : k + n] for k in range(len(a) - n + 1) if a[k : k + n] in there), None)
        if hit is None:
            high = n - 1
        else:
            found, low = hit, n + 1
    return found


def common_substring(a: Column, b: Column) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([longest_common(p, q) if isinstance(p, str) and isinstance(q, str) else None for p, q in zip(x, y)], dtype=object)

    return F.pandas_udf(run, "string")(a, b)


def _canonical(text: str) -> str | None:
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return None


canonical_json = _text_udf(_canonical)


def hash_name(text: str) -> str:
    """32-bit rolling hash over UTF-16 units, its absolute value in base 36."""
    h = 0
    for ch in text:
        # the first unit of a character alone counts
        unit = int.from_bytes(ch.encode("utf-16-be")[:2], "big")
        h = (31 * h + unit) & 0xFFFFFFFF
    h = abs(h - (1 << 32) if h >> 31 else h)
    digits = ""
    while h:
        h, d = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    return digits or "0"


string_hash = _text_udf(hash_name)

#: Object keys that hold text, in their order of preference.
TEXT_KEYS = ("text", "content", "value", "answer", "stem", "question", "title", "name", "description", "label")


def deep_text(value: object) -> str:
    """First text in a JSON value: scalars as they are, lists by line, objects by their text keys."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else repr(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, list):
        return "\n".join(t for t in map(deep_text, value) if t)
    for key in TEXT_KEYS:
        if found := deep_text(value.get(key)):
            return found
    return ""


def _deep(text: str) -> str | None:
    try:
        return deep_text(json.loads(text)) or None
    except ValueError:
        return text.strip() or None


json_text = _text_udf(_deep)

_HIDDEN = re.compile(r"(^_)|((^|_)id$)|ids$|Id$|uuid|token", re.IGNORECASE)


def redact(value: object) -> object:
    if isinstance(value, dict):
        return {k: redact(v) for k, v in value.items() if not _HIDDEN.search(k)}
    return [redact(v) for v in value] if isinstance(value, list) else value


redact_json = _text_udf(lambda x: json.dumps(redact(json.loads(x)), separators=(",", ":"), ensure_ascii=False, sort_keys=True))

display_text = _text_udf(show_latex)
