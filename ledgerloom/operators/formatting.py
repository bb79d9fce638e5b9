"""Chat records: building, checking, and splitting them by exact stratified counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import strip

SPLITS = ("train", "val", "test")
MESSAGES = "array<struct<role:string,content:string>>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_records(records: DataFrame, schema: str = "chat-v1", system_prompt: str | None = None) -> DataFrame:
    """(id, source, messages); records without a question or an answer go."""
    if schema != "chat-v1":
        raise ValueError(f"unsupported format schema: {schema!r}")
    q, a = strip(F.coalesce("question", F.lit(""))), strip(F.coalesce("answer", F.lit("")))
    turns = [message("user", q), message("assistant", a)]
    if system_prompt:
        turns.insert(0, message("system", F.lit(system_prompt)))
    return records.where((q != "") & (a != "")).select("id", "source", F.array(*turns).alias("messages"))


def violations(messages: Column) -> Column:
    """What is wrong with a messages array, in order; empty if nothing.

    Fixed values: the wording of the violations.
    """
    def of(m: Column, k: Column) -> Column:
        where = F.concat(F.lit("messages["), k.cast("string"), F.lit("]"))
        return F.array(
            F.when(m.isNull(), F.concat(where, F.lit(" is not a dict"))),
            F.when(m.isNotNull() & ~F.coalesce(m["role"].isin(*K.ROLES), F.lit(False)), F.concat(where, F.lit(" has invalid role "), F.coalesce(m["role"], F.lit("None")))),
            F.when(m.isNotNull() & (strip(F.coalesce(m["content"], F.lit(""))) == ""), F.concat(where, F.lit(" has empty content"))))

    last = F.try_element_at(messages, F.lit(-1))["role"]
    whole = F.concat(F.flatten(F.transform(messages, of)), F.array(
        F.when(~F.coalesce(last == "assistant", F.lit(False)), "last message role must be 'assistant'"),
        F.when(~F.coalesce(F.exists(messages, lambda m: m["role"] == "user"), F.lit(False)), "messages must contain a 'user' turn")))
    empty = F.array(F.lit("'messages' must be a non-empty list"))
    return F.array_compact(F.when(F.coalesce(F.size(messages), F.lit(0)) <= 0, empty).otherwise(whole))


def validation_summary(checked: DataFrame, sample: int = 5) -> DataFrame:
    """(n_valid, n_invalid, sample): the sample holds the first invalid ids with what is wrong."""
    bad = F.size("errors") > 0
    counts = checked.agg(F.count_if(~bad).alias("n_valid"), F.count_if(bad).alias("n_invalid"))
    first = checked.where(bad).orderBy("id").limit(sample).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", F.array_join("errors", "; ").alias("e")))), lambda s: F.concat(s["id"].cast("string"), F.lit(": "), s["e"])), "\n").alias("sample"))
    return counts.crossJoin(first)  # one row each


def split(records: DataFrame, seed: int = 42, shares: tuple[float, float] = K.SPLIT, key: str = "id", by: str = "source") -> DataFrame:
    """Adds ``split``; each stratum has exactly its share, rounded half to even.

    Order within a stratum is that of md5(seed | key). Ranks go through hash chunks whose sizes
    are summed first, so the largest stratum still sorts in pieces.
    """
    p_train, p_val = shares
    hashed = records.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))).withColumn("__s", F.coalesce(F.col(by).cast("string"), F.lit("\0")))
    hashed = hashed.withColumn("__c", F.left("__h", F.lit(3)))
    sizes = hashed.groupBy("__s", "__c").agg(F.count("*").alias("__k"))
    ahead = Window.partitionBy("__s").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__k").over(ahead), F.lit(0))).withColumn("__n", F.sum("__k").over(Window.partitionBy("__s"))).drop("__k")
    rank = F.col("__before") + F.row_number().over(Window.partitionBy("__s", "__c").orderBy("__h", key))
    n_train = F.bround(F.col("__n") * p_train)
    denom = (1 - p_train) or 1.0
    n_val = F.bround((F.col("__n") - n_train) * p_val / denom)
    out = hashed.join(sizes, ["__s", "__c"]).withColumn("__r", rank)
    name = F.when(F.col("__r") <= n_train, "train").when(F.col("__r") <= n_train + n_val, "val").otherwise("test")
    return out.withColumn("split", name).select(*records.columns, "split")


def split_table(rows: DataFrame) -> DataFrame:
    """(source, train, val, test), with a TOTAL row."""
    out = rows.rollup("source").agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS], F.grouping("source").alias("g"))
    return out.withColumn("source", F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("source"))).drop("g")


def as_messages(messages: Column, system_prompt: str) -> Column:
    """The system prompt first, unless a system turn leads already."""
    return F.when(F.try_element_at(messages, F.lit(1))["role"] == "system", messages).otherwise(F.concat(F.array(message("system", F.lit(system_prompt))), messages))


def trainable(messages: Column) -> Column:
    """At least two messages, the last of the assistant."""
    return F.coalesce((F.size(messages) >= 2) & (F.try_element_at(messages, F.lit(-1))["role"] == "assistant"), F.lit(False))


def dialogue(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["role"].isin("user", "assistant"))


def last_messages(messages: Column, n: int) -> Column:
    return F.when(F.size(messages) <= n, messages).otherwise(F.slice(messages, F.lit(-n), F.lit(n)))


def render(messages: Column) -> Column:
    """Plain text: one ``role: content`` line for each message."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def sft_labels(prompt_ids: Column, answer_ids: Column, most: int, pad_to: int = 8, pad_id: int = 0) -> Column:
    """Struct (input_ids, attention_mask, labels): prompt masked by -100, cut right, padded."""
    ids = F.slice(F.concat(prompt_ids, answer_ids), F.lit(1), F.lit(most))
    masked = F.slice(F.concat(F.transform(prompt_ids, lambda _: F.lit(-100).cast("bigint")), answer_ids), F.lit(1), F.lit(most))
    pad = F.pmod(-F.size(ids), F.lit(pad_to))
    fill = lambda v: F.array_repeat(F.lit(v).cast("bigint"), pad)
    return F.struct(
        F.concat(ids, fill(pad_id)).alias("input_ids"),
        F.concat(F.transform(ids, lambda _: F.lit(1).cast("bigint")), fill(0)).alias("attention_mask"), F.concat(masked, fill(-100)).alias("labels"))


def turns_to_messages(turns: DataFrame) -> DataFrame:
    """(id, messages) of each conversation, in order of turn."""
    packed = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy(F.col("conv_id").alias("id")).agg(F.transform(packed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
