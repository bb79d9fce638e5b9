"""Registered queries on conversation quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import METRICS, quality_share, summarise
from ..operators import evaluation as ev
from .inputs import PAIRS_SQL, table
from .sql_text import METRICS_SQL


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.scored(ev.answered_questions(table(spark, sf_dir, "conversations")))


def conv_quality_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.by_category(_rows(spark, sf_dir))


def response_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("conv_id", "turn", "category", *METRICS)


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.describe(_rows(spark, sf_dir))


def quality_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_share(_rows(spark, sf_dir), ["category"])


def rubric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.histogram(_rows(spark, sf_dir))


def rubric_box_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.box_plot(_rows(spark, sf_dir))


def rubric_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.scatter(_rows(spark, sf_dir))


def rubric_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.extremes(_rows(spark, sf_dir))


def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge replies parsed to two scores, null unless both are there."""
    reply = F.concat(F.lit("RELEVANCE: "), F.col("event_id") % 7, F.lit(" / HELPFULNESS= "), F.col("user_id") % 6)
    events = table(spark, sf_dir, "events").select("event_id", reply.alias("reply"))
    return ev.parse_judge(events, "reply").select("event_id", "judge_relevance", "judge_helpfulness")


_WITH = f"WITH {PAIRS_SQL.strip()}, {METRICS_SQL.strip()}"
_LONG = "(UNPIVOT scored ON " + ", ".join(METRICS) + " INTO NAME metric VALUE value)"
_STATS = "count(value) AS n, round(avg(value), 3) AS mean, round(median(value), 3) AS median, round(stddev_pop(value), 3) AS stdev, round(min(value), 3) AS min, round(max(value), 3) AS max"
_SHARE = "count(*) AS n, count_if(rubric >= 3.5) AS n_good, round(count_if(rubric >= 3.5)::DOUBLE / count(*), 3) AS share"

QUERIES = {f.__name__: f for f in (
    conv_quality_by_category, response_metrics, metric_summary, quality_shares, rubric_histogram, rubric_box_plot, rubric_scatter, rubric_extremes, judge_scores)}
ORACLES = {
    "conv_quality_by_category": f"{_WITH}, s AS (SELECT category, {_SHARE} FROM scored GROUP BY category) "
    f"SELECT m.*, s.n_good, s.share FROM (SELECT category, metric, {_STATS} FROM {_LONG} GROUP BY category, metric) m JOIN s USING (category)",
    "response_metrics": f"{_WITH} SELECT conv_id, turn, category, {', '.join(METRICS)} FROM scored",
    "metric_summary": f"{_WITH} SELECT metric, {_STATS} FROM {_LONG} GROUP BY metric",
    "quality_shares": f"{_WITH} SELECT category, {_SHARE} FROM scored GROUP BY category",
    "rubric_histogram": f"{_WITH} SELECT least(floor((rubric - 1.0) / 0.5), 7)::INTEGER AS bin, count(*) AS n FROM scored GROUP BY 1",
    "rubric_box_plot": f"{_WITH} SELECT category, round(quantile_cont(rubric, 0.25), 3) AS q1, round(quantile_cont(rubric, 0.5), 3) AS median, round(quantile_cont(rubric, 0.75), 3) AS q3 FROM scored GROUP BY category",
    "rubric_scatter": f"{_WITH} SELECT conv_id, turn, word_count, rubric FROM scored",
    "rubric_extremes": f"{_WITH} SELECT * FROM (SELECT 'best' AS side, conv_id, turn, rubric FROM scored ORDER BY rubric DESC, conv_id, turn LIMIT 3) "
    "UNION ALL SELECT * FROM (SELECT 'weakest' AS side, conv_id, turn, rubric FROM scored ORDER BY rubric, conv_id, turn LIMIT 3)",
    "judge_scores": "SELECT event_id, CASE WHEN event_id % 7 BETWEEN 1 AND 5 AND user_id % 6 BETWEEN 1 AND 5 THEN (event_id % 7)::INTEGER END AS judge_relevance, "
    "CASE WHEN event_id % 7 BETWEEN 1 AND 5 AND user_id % 6 BETWEEN 1 AND 5 THEN (user_id % 6)::INTEGER END AS judge_helpfulness FROM events",
}
