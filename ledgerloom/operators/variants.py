"""Semi-structured columns as VARIANT: a source's other fields, and messages, as they came.

A raw record keeps its question and answer as text and all else in one ``aux`` value whose
fields keep their JSON types, so sources with different fields share a table and none needs a
schema. Tables of such values are written shredded: a field that most rows have in one type
gets a Parquet column, and a query for some fields reads those columns only, its filters included.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import FIELD_MAP

MESSAGES = "array<struct<role:string,content:string>>"


def parse_raw_variant(lines: DataFrame, source: str, field_map: Mapping[str, tuple[str, str]] = FIELD_MAP, value: str = "value") -> DataFrame:
    """(…, source, question, answer, aux) of JSON objects; the other columns of the lines stay.

    aux holds all fields but the two. Questions and answers that are no text are null, and so
    are all four fields but source for a line that is no JSON object, or null. An unknown source has
    neither question nor answer, and all its fields in aux. A field given twice counts as its last.
    """
    own = {"source", "question", "answer", "aux"}
    keep = [F.col(f"`{c}`") for c in lines.columns if c != value and c not in own]
    pair = field_map.get(source)
    # Behind a generator: each field of a row would else parse its line again.
    parsed = lines.select("*", F.inline(F.array(F.struct(F.from_json(F.col(value), "map<string,variant>").alias("__fields")))))
    fields = F.col("__fields")
    once = F.map_from_entries(F.filter(F.map_entries(fields), lambda e, k: ~F.exists(F.slice(F.map_keys(fields), k + 2, F.size(fields)), lambda later: later == e["key"])))
    text = lambda name: F.when(F.schema_of_variant(_last(fields, name)) == "STRING", F.try_variant_get(_last(fields, name), "$", "string"))
    rest = F.map_filter(once, lambda k, v: ~k.isin(*pair)) if pair else once
    return parsed.select(
        *keep, F.lit(source).alias("source"), (text(pair[0]) if pair else F.lit(None).cast("string")).alias("question"),
        (text(pair[1]) if pair else F.lit(None).cast("string")).alias("answer"), F.to_variant_object(rest).alias("aux"))


def _last(fields: Column, name: str) -> Column:
    return F.try_element_at(F.filter(F.map_entries(fields), lambda e: e["key"] == name), F.lit(-1))["value"]


def with_fields(df: DataFrame, variant: str, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Adds columns from (path, type) of a VARIANT; null where the path is missing or of another kind."""
    return df.withColumns({name: F.try_variant_get(F.col(variant), path, kind) for name, (path, kind) in fields.items()})


def field_kinds(df: DataFrame, variant: str = "aux", by: str = "source") -> DataFrame:
    """(by, n, kinds): the merged schema of all values of a group, from partial aggregates."""
    return df.groupBy(by).agg(F.count(variant).alias("n"), F.schema_of_variant_agg(F.col(variant)).alias("kinds"))


def messages_as_variant(df: DataFrame, messages: str = "messages") -> DataFrame:
    """Typed messages, or their JSON text, as a VARIANT in place; text that is no JSON gives null."""
    kind = dict(df.dtypes)[messages]
    return df.withColumn(messages, F.try_parse_json(F.col(messages)) if kind == "string" else F.to_variant_object(F.col(messages)))


def messages_of(variant: Column) -> Column:
    """The typed messages of a VARIANT; null if it holds no list of messages. Other fields go."""
    return F.try_variant_get(variant, "$", MESSAGES)


def messages_as_json(variant: Column) -> Column:
    """The JSON text of a VARIANT, keys in the order of their names."""
    return F.to_json(variant)


def write_variants(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as Parquet with shredded VARIANT columns; the kinds of a file's columns follow from its first rows.

    What does not fit a column stays in the file as it came, so every value reads back.
    """
    conf = rows.sparkSession.conf
    names = ("spark.sql.variant.writeShredding.enabled", "spark.sql.variant.inferShreddingSchema")
    before = {n: conf.get(n) for n in names}
    try:
        for n in names:
            conf.set(n, "true")
        rows.write.mode(mode).parquet(path)
    finally:
        for n, v in before.items():
            conf.set(n, v)
