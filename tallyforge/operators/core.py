"""Relational building blocks: keyed dedupe, upserts, top-k, ordered collections, deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by the order."""
    return top_k(df, keys, order, 1)


def top_k(df: DataFrame, keys: list[Column | str], order: list[Column | str], k: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], merge: dict[str, Column] | None = None) -> DataFrame:
    """old with new's rows put in by key: new values win unless merge gives an expression.

    Expressions name the sides as old.<column> and new.<column>. Both sides have
    one row a key. Written tables take the result by write and swap.
    """
    o, n = old.alias("old"), new.alias("new")
    on = reduce(lambda a, b: a & b, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys])
    there, fresh = o.withColumn("_o", F.lit(True)).alias("old"), n.withColumn("_n", F.lit(True)).alias("new")
    joined = there.join(fresh, on, "full")
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.coalesce(f"old.{c}", f"new.{c}").alias(c))
            continue
        both = (merge or {}).get(c, F.col(f"new.{c}"))
        out.append(F.when(F.col("old._o").isNull(), F.col(f"new.{c}")).when(F.col("new._n").isNull(), F.col(f"old.{c}")).otherwise(both).alias(c))
    return joined.select(*out)


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def rename_keys(df: DataFrame, mapping: DataFrame, column: str, default: Column | None = None) -> DataFrame:
    """column through a (old_key, new_key) map; keys outside it keep their value or get default."""
    other = F.col(column) if default is None else default
    return df.join(mapping, F.col(column) == F.col("old_key"), "left").withColumn(column, F.coalesce("new_key", other)).drop("old_key", "new_key")


def ordered_list(order: list[str], value: Column) -> Column:
    """Aggregate: values of a group by the order columns."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("_value")))), lambda x: x["_value"])


def first_by(value: Column, *order: Column) -> Column:
    """Aggregate: the first non-null value by the order, combined before the shuffle."""
    return F.min_by(value, F.when(value.isNotNull(), F.struct(*order)))


def first_tier(df: DataFrame, keys: list[str], tier: Column) -> DataFrame:
    """Rows of each key's lowest tier."""
    return df.withColumn("_t", tier).withColumn("_m", F.min("_t").over(Window.partitionBy(*keys))).where("_t = _m").drop("_t", "_m")


def missing_references(children: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    return children.join(parents.select(*on), on, "left_anti")


def violations(*rules: tuple[Column, str]) -> Column:
    """Messages of the rules whose condition holds."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(message)) for condition, message in rules]))


def search(df: DataFrame, column: str, query: str) -> DataFrame:
    """Rows whose column holds the query, any case; the query's signs are plain text."""
    return df.where(F.contains(F.lower(column), F.lit(query.lower())))


def maybe(df: DataFrame, condition: Column | None) -> DataFrame:
    return df if condition is None else df.where(condition)


def sound_preferences(rows: DataFrame) -> DataFrame:
    """Rows (mode, weights) whose mode is known and whose own weights are 0 to 100 and add up to 100."""
    total = F.aggregate("weights", F.lit(0), lambda a, w: a + w)
    fine = F.forall("weights", lambda w: w.between(0, 100)) & (total == 100)
    return rows.where((F.col("mode") != "custom") | fine)


def enqueue(uploads: DataFrame, content: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(uploads to keep, queued jobs): the first upload of each content, with a job of its own."""
    first = uploads.groupBy(content).agg(F.min(key).alias(key), (F.count(F.lit(1)) - 1).alias("repeats"))
    kept = uploads.join(first.select(key), key, "left_semi")
    return kept, first.select(content, key, F.concat(F.lit("job-"), F.col(key).cast("string")).alias("job_id"), F.lit("queued").alias("status"), "repeats")
