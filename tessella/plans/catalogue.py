"""Named queries over the test tables, and DuckDB SQL that gives the same rows.

Values are rounded to six places on both sides. The SQL builds the panel of events again, on its own terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.dsl import formula
from tessella.sources import panel as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BARS = """t AS (SELECT user_id AS security_id, ts, value + 1 AS price, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS size, date_trunc('hour', ts) AS datetime FROM events),
b AS (SELECT security_id, datetime, arg_min(price, ts) AS open_trade_px, max(price) AS high_trade_px, min(price) AS low_trade_px, arg_max(price, ts) AS close_trade_px,
  CAST(count(*) AS DOUBLE) AS trade_count, sum(size) AS volume, sum(price * size) AS dvolume, CASE WHEN sum(size) > 0 THEN sum(price * size) / sum(size) END AS vwap FROM t GROUP BY 1, 2)"""
PANEL = f"""{BARS},
g AS (SELECT s.security_id, d.datetime, d.bar_idx FROM (SELECT DISTINCT security_id FROM b) s, (SELECT datetime, row_number() OVER (ORDER BY datetime) AS bar_idx FROM (SELECT DISTINCT datetime FROM b)) d),
p AS (SELECT g.security_id, g.datetime, CAST(g.datetime AS DATE) AS date, g.bar_idx, open_trade_px, high_trade_px, low_trade_px, close_trade_px, trade_count, volume, dvolume, vwap FROM g LEFT JOIN b USING (security_id, datetime))"""
#: The dense monthly panel of parts, with the label.
PARTS = """m0 AS (SELECT CAST(l_partkey AS BIGINT) AS security_id, date_trunc('month', l_shipdate) AS datetime, CAST(sum(l_quantity) AS DOUBLE) AS volume, CAST(max(l_extendedprice / l_quantity) AS DOUBLE) AS high_trade_px,
  CAST(min(l_extendedprice / l_quantity) AS DOUBLE) AS low_trade_px, CAST(count(*) AS DOUBLE) AS trade_count FROM lineitem GROUP BY 1, 2),
p AS (SELECT s.security_id, d.datetime, CAST(d.datetime AS DATE) AS date, d.bar_idx, volume, high_trade_px, low_trade_px, trade_count, avg(volume) OVER (e ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) / nullif(avg(volume) OVER (e ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0) - 1 AS resp
  FROM (SELECT DISTINCT security_id FROM m0) s CROSS JOIN (SELECT datetime, row_number() OVER (ORDER BY datetime) AS bar_idx FROM (SELECT DISTINCT datetime FROM m0)) d LEFT JOIN m0 USING (security_id, datetime) WINDOW e AS (PARTITION BY s.security_id ORDER BY d.bar_idx))"""
RANK = "CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {k} ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY {k}, {x}) - 1) / 2.0 END"
#: A research panel: alpha is the centred rank of the reversal against vwap.
RESEARCH = f"""{PANEL},
q AS (SELECT *, -(close_trade_px / vwap - 1) AS x, lead(close_trade_px, 24) OVER (PARTITION BY security_id ORDER BY bar_idx) / nullif(close_trade_px, 0) - 1 AS resp,
  CASE WHEN (security_id * 7 + hour(datetime) * 3 + day(datetime)) % 11 IN (1, 2, 3) THEN (security_id * 7 + hour(datetime) * 3 + day(datetime)) % 11 ELSE 0 END AS trading_restriction FROM p),
r AS (SELECT security_id, datetime, date, bar_idx, resp, trading_restriction, close_trade_px, volume, vwap, ({RANK.format(x="x", k="bar_idx")}) / count(x) OVER (PARTITION BY bar_idx) - 0.5 AS alpha FROM q)"""
ALPHA = "pct_rank(-(close_trade_px / vwap - 1))"


def W(n: int) -> str:
    return f"OVER (PARTITION BY security_id ORDER BY bar_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


E = "OVER (PARTITION BY security_id ORDER BY bar_idx)"
C = "OVER (PARTITION BY bar_idx)"
DIV = lambda a, b: f"({a}) / (CASE WHEN ({b}) = 0 THEN 1e-8 ELSE ({b}) END)"


def six(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles rounded to six places; minus zero as zero."""
    return df.select(*((F.round(c, 6) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes if not keep or c in keep))


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def round_sql(columns: dict[str, str]) -> str:
    return ", ".join(f"round({sql}, 6) + 0.0 AS {name}" for name, sql in columns.items())


def formulas(name: str, given: dict[str, tuple[str, str]], stage: str = "p") -> None:
    """A query of formulas over the event panel; the SQL of each value is over `stage`, which may be a subquery over p."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = formula.evaluate(P.event_panel(spark, sf_dir), {k: f for k, (f, _) in given.items()}, ("security_id", "bar_idx"))
        return six(out.select("security_id", "bar_idx", *given))

    add(name, query, f"WITH {PANEL} SELECT security_id, bar_idx, {round_sql({k: s for k, (_, s) in given.items()})} FROM {stage}")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The research panel with alpha."""
    return formula.evaluate(P.research_panel(spark, sf_dir).drop("resp_raw"), {"alpha": ALPHA})


from tessella.plans import combination, evaluation, expressions, ideas, library, memory, models, relations, research, spans, texts  # noqa: E402, F401  they fill the tables above
