"""Source mixing by iterative proportional fitting, in DataFrame operations only."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Share of the input's tokens that occur in the sample at all, and exponent of the default targets.
RATE, TEMPER = 0.9, 0.7
#: Raking ends when no factor moves by more than SETTLED, or after SWEEPS.
SWEEPS, SETTLED = 16, 1e-13
SEED = "mix-1"
DIMENSIONS = ("source", "lang", "topic")


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def topic_of(text: str = "text", words: str = "n_tokens") -> Column:
    """A coarse topic read off a text's form: tables, code-like text, long and short prose."""
    has = lambda part: F.instr(F.col(text), part) > 0
    return F.when(has(" | "), "table").when(has("{") | has(' = "'), "code").when(F.col(words) >= 1000, "long").when(F.col(words) >= 100, "prose").otherwise("short")


def describe(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, lang, topic and n_tokens (words) of each document; nulls get '(none)' and 0.

    The columns in keep follow as _0, _1, ...
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in ("source", "lang")], *[F.col(c).alias(f"_{k}") for k, c in enumerate(keep)])
    return own.withColumn("n_tokens", word_count()).withColumn("topic", topic_of()).drop("text")


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER, sweeps: int = SWEEPS) -> DataFrame:
    """cells (source, lang, topic, tokens) with the raked factor f of each cell.

    After the sweeps the cells' tokens * f have each dimension's target shares,
    as far as the cells allow; a warning tells of shares that are missed. targets
    maps a dimension to (its name, share); without one, shares are the observed
    shares raised to temper. A value that given targets leave out gets share 0.
    Every sweep is written out.
    """
    goals = cells
    for dim in DIMENSIONS:
        if targets and dim in targets:
            share = targets[dim].select(F.col(dim).alias(f"_{dim}"), F.col("share").cast("double").alias(f"goal_{dim}"))
            goals = goals.join(share, F.col(dim) == F.col(f"_{dim}"), "left").drop(f"_{dim}").fillna(0.0, [f"goal_{dim}"])
        else:
            mass = cells.groupBy(F.col(dim).alias(f"_{dim}")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias(f"goal_{dim}"))
            whole = mass.agg(F.sum(f"goal_{dim}")).first()[0] or 1.0
            goals = goals.join(mass.withColumn(f"goal_{dim}", F.col(f"goal_{dim}") / F.lit(float(whole))), F.col(dim) == F.col(f"_{dim}")).drop(f"_{dim}")
    total = float(goals.agg(F.sum("tokens")).first()[0] or 0)
    now = materialize(goals.withColumn("f", F.lit(1.0)))
    for _ in range(sweeps):
        now = now.withColumn("was", F.col("f"))
        for dim in DIMENSIONS:
            mass = F.sum(F.col("tokens") * F.col("f")).over(Window.partitionBy(dim))
            now = now.withColumn("f", F.when(mass > 0, F.col("f") * F.col(f"goal_{dim}") * F.lit(total) / mass).otherwise(0.0))
        now = materialize(now)
        moved = now.agg(F.max(F.abs(F.col("f") - F.col("was")) / F.greatest("f", "was", F.lit(1e-300)))).first()[0]
        now = now.drop("was")
        if (moved or 0.0) <= SETTLED:
            break
    for dim in DIMENSIONS:
        missed = now.groupBy(dim).agg(F.abs(F.sum(F.col("tokens") * F.col("f")) / F.lit(total or 1.0) - F.max(f"goal_{dim}")).alias("gap"), F.sum("tokens").alias("t")).where("t > 0").agg(F.max("gap")).first()[0]
        if (missed or 0.0) > 1e-3:
            warnings.warn(f"the targets of {dim} are missed by up to {missed:.4f} after {sweeps} sweeps", stacklevel=2)
    return now.select(*DIMENSIONS, "tokens", "f")


def expected_copies(cells: DataFrame, rate: float = RATE) -> DataFrame:
    """cells with e, the expected number of copies of a document, and p = min(1, e), the probability that it occurs.

    e is f times one scale for all cells, so e keeps the raked shares; the scale
    is such that the documents that occur are expected to hold rate of all
    tokens. With the cells at p = 1 known, the scale of the others is a quotient;
    it only grows from step to step and is exact when no cell changes sides.
    """
    scale, before = rate, -1.0
    while scale != before:
        before = scale
        at_one = F.col("f") * F.lit(scale) >= 1
        row = cells.agg(F.sum("tokens").alias("t"), F.sum(F.when(at_one, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(~at_one, F.col("tokens") * F.col("f")).otherwise(0.0)).alias("rest")).first()
        if not row["rest"] or row["rest"] <= 0:
            break
        scale = max(scale, (rate * row["t"] - row["full"]) / row["rest"])
    return cells.withColumn("e", F.col("f") * F.lit(scale)).withColumn("p", F.least(F.lit(1.0), F.col("e")))


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) fixed by key and seed: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rate: float = RATE, seed: str = SEED, temper: float = TEMPER, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, p, sampled, copies) of every document, and the columns in keep as _0, _1, ...

    weight is the raked factor. copies says how often a document stands in the
    sample: the whole part of its expected copies, and once more with the rest
    as probability, so that the copies' tokens have the target shares even where
    a scarce cell is asked for more than it holds. sampled is copies > 0, which
    has probability p; rate is the share of the input's tokens that occur.

    Documents are pre-aggregated to cells before any shuffle, so a source with a
    third of all rows is one row of each task's output. Rows with one doc_id are
    drawn together. Documents without words weigh nothing and keep their cell's
    probability; a cell without any words has weight 0 and is not sampled. Texts
    are read once: what they are counted to is written out.
    """
    own = materialize(describe(docs, keep))
    cells = own.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    fitted = expected_copies(rake(materialize(cells), targets, temper), rate)
    named = fitted.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], "f", "e", "p")
    rounded = lambda c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6
    joined = own.join(named, [own[d] == named[f"_{d}"] for d in DIMENSIONS])
    draw = uniform(F.col("doc_id"), seed)
    copies = (F.floor("e") + (draw < F.col("e") - F.floor("e")).cast("long")).alias("copies")
    return joined.select("doc_id", *DIMENSIONS, "n_tokens", rounded("f").alias("weight"), rounded("p").alias("p"), ((F.col("e") >= 1) | (draw < F.col("e"))).alias("sampled"), copies, *[f"_{k}" for k in range(len(keep))])


def _oracle() -> str:
    """DuckDB SQL of mix() over the documents table, its sweeps written out and its scale in closed form."""
    text = "coalesce(text, '')"
    has = lambda part: f"contains({text}, '{part}')"
    sql = f"""WITH own AS (SELECT *, CASE WHEN {has(" | ")} THEN 'table' WHEN {has("{")} OR {has(' = "')} THEN 'code' WHEN n_tokens >= 1000 THEN 'long' WHEN n_tokens >= 100 THEN 'prose' ELSE 'short' END AS topic
 FROM (SELECT doc_id, text, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, CAST(len(regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents)),
 cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM own GROUP BY ALL)"""
    for dim in DIMENSIONS:
        sql += f",\n goal_{dim} AS MATERIALIZED (SELECT {dim}, m / sum(m) OVER () AS goal FROM (SELECT {dim}, pow(CAST(sum(tokens) AS DOUBLE), {TEMPER}) AS m FROM cells GROUP BY {dim}))"
    sql += ",\n s0 AS MATERIALIZED (SELECT *, CAST(1.0 AS DOUBLE) AS f FROM cells)"
    n = 0
    for _ in range(SWEEPS):
        for dim in DIMENSIONS:
            sql += f",\n s{n + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, CASE WHEN m.mass > 0 THEN f * goal * CAST((SELECT sum(tokens) FROM cells) AS DOUBLE) / m.mass ELSE 0.0 END AS f FROM s{n} c JOIN goal_{dim} USING ({dim}) JOIN (SELECT {dim}, sum(tokens * f) AS mass FROM s{n} GROUP BY {dim}) m USING ({dim}))"
            n += 1
    sql += f""",
 ranked AS (SELECT *, row_number() OVER (ORDER BY f DESC, source, lang, topic) AS k FROM s{n}),
 sums AS (SELECT 0 AS k, 0.0 AS full_tokens, CAST(1e300 AS DOUBLE) AS last_f, sum(tokens * f) AS rest FROM ranked
  UNION ALL SELECT k, sum(tokens) OVER (ORDER BY k), f, sum(tokens * f) OVER () - sum(tokens * f) OVER (ORDER BY k) FROM ranked),
 scales AS (SELECT k, ({RATE} * (SELECT sum(tokens) FROM cells) - full_tokens) / rest AS scale FROM sums WHERE rest > 0),
 -- the first split of the cells by f whose scale leaves all others below 1
 chosen AS (SELECT scale FROM scales s LEFT JOIN ranked r ON r.k = s.k + 1 WHERE r.f IS NULL OR r.f * s.scale < 1 ORDER BY s.k LIMIT 1),
 fitted AS (SELECT source, lang, topic, f, f * scale AS e FROM s{n}, chosen),
 drawn AS (SELECT doc_id, source, lang, topic, n_tokens, f, e, CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / {1 << 52}.0 AS draw FROM own JOIN fitted USING (source, lang, topic))
 SELECT doc_id, source, lang, topic, n_tokens, floor(f * 1e6 + 0.5) / 1e6 AS weight, floor(least(1.0, e) * 1e6 + 0.5) / 1e6 AS p, e >= 1 OR draw < e AS sampled,
 CAST(floor(e) AS BIGINT) + CAST(draw < e - floor(e) AS BIGINT) AS copies FROM drawn"""
    return sql


ORACLE_SQL = _oracle()
