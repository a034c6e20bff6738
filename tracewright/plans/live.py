"""Queries that run as streams, held against batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import evaluate, traces
from tracewright.plans import evaluation
from tracewright.storage import stash
from tracewright.streaming import live, truths


def _observations(spark: SparkSession, d: str) -> DataFrame:
    rows = live.read_stream(spark, f"{d}/events.parquet")
    return rows.select(F.col("user_id").alias("conversation_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("token"), F.col("ts").cast("timestamp").alias("ts"))


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    return live.live_counts(_observations(spark, d))


def stream_transitions(spark: SparkSession, d: str) -> DataFrame:
    return live.live_transitions(_observations(spark, d))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily windows that a watermark of one day has closed: how many of which tokens."""
    found = live.late_counts(_observations(spark, d), "ts", "1 day", "1 day")
    return found.select(F.date_format("starts", "yyyy-MM-dd").alias("day"), "token", "n")


def stream_session_silence(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users that two days of silence have closed."""
    found = live.closed_sessions(_observations(spark, d), "ts", "2 days", "1 day")
    return found.select("conversation_id", F.date_format("starts", "yyyy-MM-dd HH:mm:ss").alias("starts"), F.date_format("ends", "yyyy-MM-dd HH:mm:ss").alias("ends"), "n")


def stream_truths(spark: SparkSession, d: str) -> DataFrame:
    """All days of all users, placed and with their contracts, as a stream."""
    triples, entities, assertions = evaluation.graph(spark)
    rows = evaluate.sought(evaluation.observations(live.read_stream(spark, f"{d}/events.parquet")), "checkpoint")
    bound = traces.bind(rows, *[stash(df, "names") for df in evaluate.names(triples, entities)])
    found = truths.live_truths(bound, triples, evaluate.inverse_index(triples, entities), assertions)
    return found.select("conversation_id", "turn", F.array_join("states", "|").alias("states"), "method", F.array_join("assertions", "|").alias("assertions"), "certain")


QUERIES = {
    "stream_truths": (
        stream_truths,
        evaluation.PLACED + f""", {evaluation.PAIRS}, scope AS (SELECT p.conversation_id, p.turn, method, states, list_concat(states, coalesce(m.tools, []), coalesce(m.outcomes, []), coalesce(m.rules, []), coalesce(x.nexts, [])) AS inside
    FROM placed p LEFT JOIN may m USING (conversation_id, turn) LEFT JOIN facts x ON x.state = p.exit_state)
SELECT conversation_id, turn, array_to_string(states, '|') AS states, method, coalesce(string_agg(assertion_id, '|' ORDER BY assertion_id) FILTER (len(states) > 0 AND (a.scope = 'journey' OR list_has_any(inside, about))), '') AS assertions, method = 'checkpoint' AS certain
FROM scope, a GROUP BY conversation_id, turn, states, method""",
    ),
    "stream_session_silence": (
        stream_session_silence,
        """WITH e AS (SELECT user_id, ts, event_id, coalesce(ts - lag(ts) OVER w >= INTERVAL 2 DAYS, true) AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, count(*) FILTER (begins) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM e)
SELECT user_id AS conversation_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS starts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ends, count(*) AS n FROM s GROUP BY user_id, no HAVING max(ts) + INTERVAL 2 DAYS <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
    ),
    "stream_counts": (stream_counts, "SELECT user_id AS conversation_id, event_type AS token, count(*) AS n, max(event_id) AS last_seq FROM events GROUP BY 1, 2"),
    "stream_transitions": (stream_transitions, "WITH m AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS source, event_type AS target FROM events) SELECT source, target, count(*) AS n FROM m WHERE source <> target GROUP BY 1, 2"),
    "stream_windows": (stream_windows, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS token, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2"),
}
