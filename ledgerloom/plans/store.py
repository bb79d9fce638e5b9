"""Registered queries on listings, the change log and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import listings as L
from ..operators.finance import line_key
from ..operators.latest import LatestTable
from ..operators.store import delete_cascade as cascade
from ..operators.store import latest_view, patched
from ..streaming.events import sessions, tumbling
from ..streaming.runs import new_folder
from .inputs import ADVICE_SQL, advice_log, table
from .sql_text import WS


def conversation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.conversation_list(table(spark, sf_dir, "conversations"))


def conversation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.search(L.conversation_list(table(spark, sf_dir, "conversations")), "  THING ").select("id")


def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.latest_turns(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "nth")


def advice_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.advice_list(advice_log(spark, sf_dir), "debt").select("id", "category", "ts", "saved")


def advice_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page(advice_log(spark, sf_dir), 3).select("id", "ts")


def advice_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_count(advice_log(spark, sf_dir))


def recent_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.advice_list(advice_log(spark, sf_dir)).limit(L.RECENT).select("id", L.shown_date(F.col("ts").cast("string")).alias("shown"))


def dashboard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.groups(advice_log(spark, sf_dir))


def dashboard_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.topic_weights(advice_log(spark, sf_dir))


def dashboard_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.chips(advice_log(spark, sf_dir))


def saved_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.saved_only(advice_log(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("n"))


def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", L.valid_request(F.col("text")).alias("message_ok"), L.valid_title(F.col("source")).alias("title_ok"), L.valid_role(F.col("lang")).alias("role_ok"))


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their orders; those of one nation are deleted by their owner."""
    parents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("user_id"))
    children = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id"))
    left, kept = cascade(parents, children, parents.where("user_id = 3").withColumn("user_id", F.when(F.col("id") % 2 == 0, 3).otherwise(4)), "id")
    return left.agg(F.count("*").alias("n")).withColumn("what", F.lit("parents")).union(kept.agg(F.count("*").alias("n")).withColumn("what", F.lit("children")))


def _event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log of users."""
    op = F.when(F.col("event_id") % 50 == 0, "D").when(F.col("event_id") % 7 == 0, "I").otherwise("U")
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("version"), op.alias("op"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"), "event_type")


def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_view(_event_log(spark, sf_dir), "user_id")


def latest_by_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same view, kept up to date over three batches that do not come in order of versions."""
    log = _event_log(spark, sf_dir)
    kept = LatestTable(spark, new_folder(spark, "latest"), log.schema, "user_id", buckets=16)
    for batch, part in enumerate((1, 2, 0)):
        kept.apply(log.where(F.col("version") % 3 == part), batch)
    return kept.view()


def patched_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    patch = rows.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "Brand#0").alias("p_brand"), F.when(F.col("p_partkey") % 3 == 0, 0).alias("p_size"))
    return patched(rows, patch, ["p_partkey"])


def echoed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines that a document of another source has as well, counted by source."""
    # Each line's key is made once, and from then on a key goes about once for each of its sources.
    keys = F.filter(F.transform(F.split("text", "\n"), line_key), lambda k: F.length(k) >= 4)
    lines = table(spark, sf_dir, "documents").select("source", F.explode(keys).alias("key")).groupBy("key", "source").agg(F.count("*").alias("n"))
    of_key = Window.partitionBy("key")
    wide = lines.withColumns({"lo": F.min("source").over(of_key), "hi": F.max("source").over(of_key)}).where("lo != hi")
    return wide.groupBy("source").agg(F.sum("n").alias("n"))


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tumbling(table(spark, sf_dir, "events"))
    return out.withColumn("total", F.round("total", 4))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"))


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    conversation_list, conversation_search, history_window, advice_list, advice_page, advice_pages, recent_advice, dashboard_groups, dashboard_topics, dashboard_chips, saved_advice,
    request_checks, delete_cascade, latest_versions, latest_by_batches, patched_parts, echoed_lines, hourly_events, user_sessions, event_props)}

_A = f"WITH {ADVICE_SQL}"
_LIST = """WITH f AS (SELECT conv_id AS id, trim(coalesce(arg_min(text, turn) FILTER (role = 'user'), ''), chr(10) || ' ' || chr(9) || chr(13)) AS first, arg_max(text, turn) AS last_message, count(*) AS n_turns FROM conversations GROUP BY conv_id),
list AS (SELECT id, CASE WHEN first = '' THEN 'New conversation' WHEN length(first) > 48 THEN concat(rtrim(left(replace(first, chr(10), ' '), 48)), '…') ELSE replace(first, chr(10), ' ') END AS title, last_message, n_turns FROM f)"""
ORACLES = {
    "conversation_list": f"{_LIST} SELECT * FROM list",
    "conversation_search": f"{_LIST} SELECT id FROM list WHERE contains(lower(title), 'thing') OR contains(lower(last_message), 'thing')",
    "history_window": "SELECT * FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::INTEGER AS nth FROM conversations WHERE role != 'system') WHERE nth <= 3",
    "advice_list": f"{_A} SELECT id, category, ts, saved FROM advice WHERE lower(category) = 'debt'",
    "advice_page": f"{_A} SELECT id, ts FROM advice ORDER BY ts DESC, id DESC LIMIT 8 OFFSET 16",
    "advice_pages": f"{_A} SELECT greatest(1, ceil(count(*) / 8.0))::BIGINT AS pages FROM advice",
    "recent_advice": f"{_A} SELECT id, strftime(ts, '%-m/%-d/%Y') AS shown FROM advice ORDER BY ts DESC, id DESC LIMIT 4",
    "dashboard_groups": f"{_A} SELECT category, n, newest, row_number() OVER (ORDER BY n DESC, ts DESC, newest DESC)::INTEGER AS place FROM (SELECT category, count(*) AS n, max(struct_pack(ts := ts, id := id)).id AS newest, max(ts) AS ts FROM advice GROUP BY category)",
    "dashboard_topics": f"{_A} SELECT category, n, round(0.75::DOUBLE + 0.85::DOUBLE * n / max(n) OVER (), 6) AS weight FROM (SELECT category, count(*) AS n FROM advice GROUP BY category)",
    "dashboard_chips": f"{_A} SELECT count(*) AS items, count(DISTINCT category) AS categories, count_if(saved) AS saved FROM advice",
    "saved_advice": f"{_A} SELECT category, count(*) AS n FROM advice WHERE saved GROUP BY category",
    "request_checks": "SELECT doc_id, length(text) BETWEEN 1 AND 4000 AS message_ok, length(source) BETWEEN 1 AND 100 AND trim(source) != '' AS title_ok, lang IN ('user', 'assistant') AS role_ok FROM documents",
    "delete_cascade": """WITH gone AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_custkey % 2 = 0)
      SELECT 'parents' AS what, count(*) AS n FROM customer WHERE c_custkey NOT IN (FROM gone) UNION ALL SELECT 'children', count(*) FROM orders WHERE o_custkey NOT IN (FROM gone)""",
    "latest_versions": """WITH l AS (SELECT user_id, event_id AS version, CASE WHEN event_id % 50 = 0 THEN 'D' WHEN event_id % 7 = 0 THEN 'I' ELSE 'U' END AS op, CASE WHEN event_id % 3 = 0 THEN value END AS value, event_type FROM events),
      b AS (SELECT user_id, max(version) AS born, arg_max(op, version) AS op FROM l WHERE op != 'U' GROUP BY user_id)
      SELECT user_id, max(version) AS version, arg_max(value, version) FILTER (value IS NOT NULL) AS value, arg_max(event_type, version) AS event_type FROM l JOIN b USING (user_id) WHERE b.op = 'I' AND version >= born GROUP BY user_id""",
    "patched_parts": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Brand#0' ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END AS p_size FROM part",
    "echoed_lines": f"""WITH l AS (SELECT source, trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(line), '{WS}+', ' ', 'g')), '(^|[^a-z0-9_])[0-9]{{1,2}} *$', '\\1'), '^[-*•·0-9.) ]+', ''), ' .:') AS key
      FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents))
      SELECT source, count(*) AS n FROM l WHERE length(key) >= 4 AND key IN (SELECT key FROM l GROUP BY key HAVING min(source) != max(source)) GROUP BY source""",
    "hourly_events": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "user_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
      SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS finish, count(*) AS n FROM s GROUP BY user_id, k""",
    "event_props": "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS k, count(*) AS n FROM events GROUP BY event_type",
}
ORACLES["latest_by_batches"] = ORACLES["latest_versions"]
