"""Registered queries on the JSON-lines source and sink and on VARIANT columns, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import cut
from ..operators import variants as V
from ..operators.formatting import turns_to_messages
from ..sources import epochs as E
from ..sources.records import read_records, write_records
from ..streaming.runs import new_folder
from .inputs import DOCS_AS_QA_SQL, docs_as_qa, table

_KIND = T.StructType([T.StructField(c, T.LongType() if c in ("doc_id", "n_chars") else T.StringType()) for c in ("doc_id", "text", "lang", "source", "n_chars")])


def _written(spark: SparkSession, sf_dir: str) -> str:
    """The documents as JSON lines, in order of doc_id over files and lines."""
    at = new_folder(spark, "records")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    write_records(docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), at)
    return at


def records_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_records(spark, _written(spark, sf_dir), _KIND, size=1 << 20)
    return rows.select("ord", "doc_id", "lang", "source", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred records of the files, whose other ranges are not read."""
    return cut(read_records(spark, _written(spark, sf_dir), _KIND, first=100, size=1 << 18)).select("ord", "doc_id", "source")


def resumed_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third epoch of the records, broken off after two fifths and taken up again by two shards."""
    order = E.EpochOrder(spark, _written(spark, sf_dir), _KIND, _SEED, _GROUP, 1 << 18)
    some, token = order.take(E.Token(_EPOCH), order.n * 2 // 5)
    rest = [order.take(token, shard=k, shards=2)[0] for k in (0, 1)]
    rows = some.withColumn("take", F.lit(0)).union(rest[0].withColumn("take", F.lit(1))).union(rest[1].withColumn("take", F.lit(2)))
    return rows.select("take", "position", "ord", "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def _raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw records: lengths now a number, now text, a field that some lack, a nested one."""
    rows = docs_as_qa(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "lang", "n_chars"), "ord")
    odd = F.col("ord") % 3
    common = [F.col("question").alias("input"), F.col("answer").alias("output"), F.col("ord").alias("id"), F.when(odd != 1, F.col("lang")).alias("lang")]
    line = lambda n: F.to_json(F.struct(*common, F.struct(n.alias("n"), F.array("source", "lang").alias("tags")).alias("about")))
    return rows.select(F.when(odd == 0, line(F.col("n_chars").cast("string"))).otherwise(line(F.col("n_chars").cast("long"))).alias("value"))


def aux_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some fields of raw records, out of their stored VARIANT."""
    at = new_folder(spark, "variants")
    V.write_variants(V.parse_raw_variant(_raw_lines(spark, sf_dir), "fingpt-fiqa-qa"), at)
    rows = V.with_fields(spark.read.parquet(at), "aux", {"doc_id": ("$.id", "bigint"), "lang": ("$.lang", "string"), "n_chars": ("$.about.n", "bigint"), "tag": ("$.about.tags[0]", "string")})
    return rows.select("doc_id", F.md5("question").alias("question_md5"), F.length("answer").alias("n_answer"), "lang", "n_chars", "tag")


def stored_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations stored as JSON messages in a VARIANT column, and read back."""
    at = new_folder(spark, "variants")
    texts = turns_to_messages(table(spark, sf_dir, "conversations")).select("id", F.to_json("messages").alias("messages"))
    V.write_variants(V.messages_as_variant(texts), at)
    rows = V.with_fields(spark.read.parquet(at), "messages", {"first_role": ("$[0].role", "string"), "second": ("$[1].content", "string")}).withColumn("m", V.messages_of(F.col("messages")))
    return rows.select("id", "first_role", F.md5("second").alias("second_md5"), F.size("m").alias("n"), F.md5(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")).alias("whole_md5"))


_SEED, _EPOCH, _GROUP = 17, 2, 64


def _rounds_sql(name: str, n: str, lane: str) -> str:
    """CTEs that permute x of ``name``_0 below n, a round each."""
    out = []
    for k, (shift, step, a, b, c) in enumerate(E.round_keys(_SEED, _EPOCH)):
        u = f"((greatest(x, y) + {lane} * {step} + {b}) % {E.PRIME})"
        out.append(
            f"{name}_{k + 1} AS (SELECT * EXCLUDE y REPLACE (CASE WHEN ({u} * {u} % {E.PRIME} * {a} + {c}) % {E.PRIME} < {E.PRIME // 2} THEN y ELSE x END AS x) "
            f"FROM (SELECT *, (({shift} + {lane} * {step}) % {n} + {n} - x) % {n} AS y FROM {name}_{k}))")
    return ", ".join(out)


_EPOCH_SQL = f"""WITH o AS (SELECT doc_id, md5(coalesce(text, '')) AS text_md5, row_number() OVER (ORDER BY doc_id) - 1 AS ord, count(*) OVER () AS n FROM documents),
g_0 AS (SELECT ord // {_GROUP} AS grp, count(*) AS size, any_value((n + {_GROUP - 1}) // {_GROUP}) AS groups, ord // {_GROUP} AS x FROM o GROUP BY ord // {_GROUP}),
{_rounds_sql('g', 'groups', '0')},
dealt AS (SELECT grp, size, x AS place, coalesce(sum(size) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM g_{E.ROUNDS}),
r_0 AS (SELECT o.*, d.*, ord - grp * {_GROUP} AS x FROM o JOIN dealt d ON d.grp = o.ord // {_GROUP}),
{_rounds_sql('r', 'size', '(grp + 1)')}
SELECT CASE WHEN before + x < n * 2 // 5 THEN 0 ELSE 1 + place % 2 END::INTEGER AS take, before + x AS position, ord, doc_id, text_md5 FROM r_{E.ROUNDS}"""

QUERIES = {"records_round_trip": records_round_trip, "first_records": first_records, "resumed_epoch": resumed_epoch, "aux_fields": aux_fields, "stored_messages": stored_messages}
ORACLES = {
    "records_round_trip": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, doc_id, lang, source, n_chars::BIGINT AS n_chars, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "first_records": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, doc_id, source FROM documents ORDER BY doc_id LIMIT 100",
    "resumed_epoch": _EPOCH_SQL,
    "aux_fields": f"""WITH {DOCS_AS_QA_SQL.strip()} SELECT d.doc_id::BIGINT AS doc_id, md5(q.question) AS question_md5, length(q.answer)::INTEGER AS n_answer, CASE WHEN d.doc_id % 3 != 1 THEN d.lang END AS lang,
        d.n_chars::BIGINT AS n_chars, d.source AS tag FROM documents d JOIN qa q ON q.ord = d.doc_id""",
    "stored_messages": """SELECT conv_id AS id, arg_min(role, turn) AS first_role, md5(max(CASE WHEN k = 2 THEN text END)) AS second_md5, count(*)::INTEGER AS n, md5(string_agg(concat(role, ': ', text), chr(10) ORDER BY turn)) AS whole_md5
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY conv_id""",
}
