"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations.

The tokens of a source form a stream: its documents in a hashed order, one after another,
from the start again when used up. Streams are cut into blocks of B tokens. There are about
total / B slots; slot i has the van der Corput point of i, and the cumulated slots of the
sources map that point to a source. A source has as many slots as hold its target. They are
ranked in slot order, and the slot of rank k takes block k of the stream, the last one only
what is left of the target, so sources interleave evenly in any stretch of the schedule.

B = total / 2^20, at least 1 and at most 4096. A source's tokens are its target, rounded.
Prefix sums and ranks go through chunks of about ``CHUNK`` rows, whose totals
are summed first: no window spans a source, however large it is.

Sizes, places and pieces are narrow rows; a text moves once at most, when it meets its spans,
and every partition of the mix goes in the order of the schedule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import contained, contained_lazy, discard, free_names, stored

CHUNK = 4096
SLOTS = 1 << 20
LARGEST_BLOCK = 4096
MOST_EPOCHS = 3
WEIGHTS = (1.0, 2.0, 3.0)
_SPACE = "\\x20\\x09-\\x0D"


def word_count(text: str) -> Column:
    """The number of maximal runs of characters other than space and U+0009..U+000D."""
    flat = F.translate(F.col(text), "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.regexp_count(flat, F.lit("[^ ]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Adds sid, weight and target to rows (no_source, source, source_size).

    Sources in code-point order, null last, take the weights in turn and share all tokens; a
    target stops at ``most`` times its source, and what is over is shared anew by weight.
    The limits are reached in the order of size / weight, so one cumulative pass finds them.
    """
    order = Window.orderBy("no_source", "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("sid", F.row_number().over(order) - 1).withColumn("weight", w)
    ranked = ranked.withColumn("limit", F.col("source_size") * F.lit(float(most))).withColumn("level", F.col("limit") / F.col("weight"))
    by_level = Window.orderBy("level", "sid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    # Spread over the sources not below this one in level: what each weight unit would get.
    unit = (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(by_level), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_level), F.lit(0.0)))
    ranked = ranked.withColumn("unit", unit)
    share = F.min_by(F.when(F.col("level") >= F.col("unit"), F.col("unit")), F.when(F.col("level") >= F.col("unit"), F.struct("level", "sid"))).over(whole)
    target = F.when(F.col("level") < F.col("share"), F.col("limit")).otherwise(F.col("share") * F.col("weight"))
    return ranked.withColumn("share", F.coalesce(share, F.lit(0.0))).withColumn("target", target).select(
        "no_source", "source", "source_size", "sid", "weight", "target")


def _running(df: DataFrame, key: list[str], chunk: str, order: list[str], amount: Column) -> DataFrame:
    """Adds ``before``: the sum of ``amount`` over earlier rows of the same key.

    Rows go by chunk, then by ``order``; chunks are summed first.
    """
    sums = df.groupBy(*key, chunk).agg(F.sum(amount).alias("chunk_sum"))
    ahead = Window.partitionBy(*key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("chunk_before", F.coalesce(F.sum("chunk_sum").over(ahead), F.lit(0))).drop("chunk_sum")
    within = Window.partitionBy(*key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(sums, [*key, chunk]).withColumn(
        "before", F.col("chunk_before") + F.coalesce(F.sum(amount).over(within), F.lit(0))).drop("chunk_before")


def row_key(documents: DataFrame) -> tuple[Column, Column]:
    """128 bits of hash of all columns: rows that share them are the same row.

    A hash passes over nulls, so each column brings a mark of its own; nested ones, maps too,
    go by their JSON with the nulls inside.
    """
    columns = []
    for field in documents.schema.fields:
        c = F.col(f"`{field.name}`")
        nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
        columns += [c.isNull(), F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}) if nested else c]
    return F.xxhash64(F.lit(5), *columns), F.xxhash64(F.lit(-7), *reversed(columns))


def streams(documents: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(rows with their place in their source's stream, sources with targets, block size).

    Rows are doc_id, the row's key and the size of its text; no text moves.
    """
    key, check = row_key(documents)
    rows = stored(documents.select(
        "doc_id", word_count("text").alias("mix_size"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("mix_source"),
        key.alias("mix_hash"), check.alias("mix_check")), "sizes")
    totals = rows.groupBy("no_source", F.col("mix_source").alias("source")).agg(F.sum("mix_size").alias("source_size"), F.count("*").alias("n_docs"))
    totals = stored(totals, "totals", 16)
    sources = stored(source_targets(totals).join(totals.select("no_source", "source", "n_docs"), ["no_source", "source"]), "sources", 16)
    total = sources.select(F.sum("source_size")).first()[0] or 0
    block = min(LARGEST_BLOCK, max(1, -(-total // SLOTS)))
    keyed = rows.join(sources.select("no_source", F.col("source").alias("mix_source"), "sid", "source_size", "target", "n_docs"), ["no_source", "mix_source"])
    # The hash is uniform, so its upper part deals a source's rows into chunks of like size.
    chunk = F.floor((F.col("mix_hash") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("n_docs") / CHUNK)).cast("long")
    placed = _running(keyed.withColumn("mix_chunk", chunk), ["sid"], "mix_chunk", ["mix_hash", "mix_check"], F.col("mix_size"))
    return placed, sources, block


def wanted() -> Column:
    """The whole words that a source gives: its target, rounded."""
    return F.round("target").cast("long")


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """Slots (slot, sid, rank) of the van der Corput points, ranked within each source."""
    need = F.ceil(wanted() / block)
    ends = sources.withColumn("hi", F.sum(need).over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("lo", F.col("hi") - need).where("hi > lo").select("sid", "lo", "hi")
    parts = ends.select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / CHUNK), F.floor((F.col("hi") - 1) / CHUNK))).alias("part"))
    points = parts.repartition("sid", "part").select(
        "sid", F.explode(F.sequence(F.greatest("lo", F.col("part") * CHUNK), F.least("hi", (F.col("part") + 1) * CHUNK) - 1)).alias("point"))
    last = sources.select(F.sum(need)).first()[0] or 1
    bits = max(1, int(last).bit_length())
    # The point of slot i is i with its bits reversed, and the other way round.
    slot = F.conv(F.reverse(F.lpad(F.bin("point"), bits, "0")), 2, 10).cast("long")
    slots = points.select("sid", slot.alias("slot")).withColumn("slot_chunk", F.floor(F.col("slot") / CHUNK))
    return _running(slots, ["sid"], "slot_chunk", ["slot"], F.lit(1)).select("slot", "sid", F.col("before").alias("rank"))


def pieces(placed: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """The schedule joined to the stream: rows (sid, before, slot, epoch, start, length)."""
    begin, size = F.col("before"), F.col("mix_size")
    spans = placed.where("mix_size > 0").select("sid", "before", "mix_size", "source_size", wanted().alias("wanted"), F.explode(F.sequence(F.lit(0), F.lit(MOST_EPOCHS - 1))).alias("epoch"))
    spans = spans.withColumn("at", F.col("epoch") * F.col("source_size") + begin).where("at < wanted").withColumn(
        "mix_size", F.least("mix_size", F.col("wanted") - F.col("at")))
    cut = spans.select("sid", "before", "epoch", "at", "mix_size", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + size - 1) / block))).alias("rank"))
    start = F.greatest(F.col("rank") * block, F.col("at"))
    end = F.least((F.col("rank") + 1) * block, F.col("at") + size)
    return cut.select("sid", "before", "epoch", "rank", (start - F.col("at")).alias("start"), (end - start).alias("length")).join(
        schedule(sources, block), ["sid", "rank"]).drop("rank")


def mix(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with sid, before, mix_hash, mix_size, source_size, target; their pieces).

    A null text has no tokens, null sources form one source, a null doc_id is an id like any
    other, and repeated rows are rows of their own. An empty table gives no rows.
    """
    placed, sources, block = streams(documents)
    placed = stored(placed, "streams", 4)
    return placed, pieces(placed, sources, block)


@contained
def mixed_sizes(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken), one for each document."""
    placed, cut = mix(documents)
    taken = cut.groupBy("sid", "before").agg(F.sum("length").alias("taken"))
    some, none = placed.where("mix_size > 0"), placed.where("mix_size = 0")
    columns = ["doc_id", F.col("mix_size").alias("size"), "source_size", "target"]
    return some.join(taken, ["sid", "before"], "left").select(*columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken")).union(
        none.select(*columns, F.lit(0).cast("long").alias("taken")))


@contained_lazy
def mixed_documents(documents: DataFrame) -> DataFrame:
    """The mix as documents: each row once for every time that it is taken, cut where the
    mix stops within it. Columns as in ``documents``, whatever their names; n_chars, if
    there, fits the text. Partitions go in the order of the schedule's slots."""
    columns = documents.columns
    key, check, slot, length, size = free_names(documents, "mix_hash", "mix_check", "mix_slot", "mix_length", "mix_size")
    placed, cut = mix(documents)
    spans = cut.groupBy("sid", "before", "epoch").agg(F.min("slot").alias(slot), F.sum("length").alias(length))
    spans = stored(placed.where("mix_size > 0").select("sid", "before", F.col("mix_hash").alias(key), F.col("mix_check").alias(check), F.col("mix_size").alias(size)).join(
        spans, ["sid", "before"]).select(key, check, slot, length, size), "spans", 4)
    again = stored(placed.groupBy(F.col("mix_hash").alias(key), F.col("mix_check").alias(check)).agg(F.count("*").alias("n")).where("n > 1").select(key, check), "repeated", 16)
    discard(placed)
    hashed = dict(zip((key, check), row_key(documents)))
    rows = documents.withColumns(hashed)
    if again.limit(1).count():
        # Rows that are the same in all columns meet the spans of all of them, once.
        same = rows.join(again, [key, check], "left_semi").dropDuplicates([key, check])
        rows = rows.join(again, [key, check], "left_anti").unionByName(same)
    rows = rows.join(spans, [key, check]).sortWithinPartitions(slot)
    words = F.slice(F.filter(F.split("text", f"[{_SPACE}]+"), lambda w: w != ""), F.lit(1), F.col(length).cast("int"))
    rows = rows.withColumn("text", F.when(F.col(length) == F.col(size), F.col("text")).otherwise(F.array_join(words, " ")))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"`{c}`") for c in columns])
