"""Registry of runnable queries and the SQL each one must agree with."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES = {}
ORACLES = {}

HISTORY = """history AS (
  SELECT CAST(o_orderdate AS DATE) AS date, 'P' || l_partkey AS part_number,
         s_name AS vendor, n_name AS country, l_extendedprice / l_quantity AS price,
         CAST(((gap % 54) + 54) % 54 + 7 AS DOUBLE) AS lead_time, l_quantity AS quantity,
         gap, l_orderkey, l_linenumber
  FROM (SELECT *, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS gap
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""

DIRTY = HISTORY + """, dirty AS (
  SELECT date, part_number, vendor, country,
         CASE WHEN (l_orderkey * 31 + l_linenumber) % 17 = 0 THEN NULL
              WHEN (l_orderkey * 7 + l_linenumber) % 97 = 0 THEN price * 20
              ELSE price END AS price,
         CAST(gap AS DOUBLE) AS lead_time, quantity
  FROM history)"""


def query(name, sql=None):
    """Register a function (spark, folder) -> DataFrame under a name."""

    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


# Prices are cents over a quantity and often end in a 5 at any digit. Cutting off
# center keeps such values away from the edge, where the last bit of a sum would
# decide, and is the same arithmetic in every engine.
OFF_CENTER = 0.4321


def rounded(df, digits=4):
    """Doubles cut to a number of digits for comparison, as the last step only."""
    unit = float(10**digits)
    return df.withColumns({
        f.name: F.floor(F.col(f.name) * unit + OFF_CENTER) / unit
        for f in df.schema
        if isinstance(f.dataType, T.DoubleType)
    })


def select(ctes, columns, source, digits=4):
    """SQL text: ``name`` as is, ``name~`` rounded, ``name=expr`` or ``name~=expr`` computed."""
    shown = []
    for c in columns if isinstance(columns, list) else columns.split():
        name, _, expr = c.partition("=")
        near = name.endswith("~")
        name = name.rstrip("~")
        expr = expr or name
        if near:
            expr = f"floor(CAST({expr} AS DOUBLE) * 1e{digits} + {OFF_CENTER}) / 1e{digits}"
        shown.append(f"{expr} AS {name}")
    head = f"WITH RECURSIVE {ctes} " if ctes else ""
    return f"{head}SELECT {', '.join(shown)} FROM {source}"


def series_sql(value="price", keys="country", freq="month", source="history", base=HISTORY):
    """CTE text ending in ``series`` (keys, date, value) for a mean per bucket."""
    day = {
        "day": "date",
        "week": "CAST(date_trunc('week', date) AS DATE) + 6",
        "month": "CAST(date_trunc('month', date) AS DATE)",
        "quarter": "CAST(date_trunc('quarter', date) AS DATE)",
    }[freq]
    by = f"{keys}, " if keys else ""
    return f"""{base}, series AS (
      SELECT {by}{day} AS date, avg({value}) AS value FROM {source}
      WHERE {value} IS NOT NULL GROUP BY ALL)"""


def placed_sql(keys="country", source="series"):
    """CTE text for ``placed``: series with pos (from 0) and n."""
    part = f"PARTITION BY {keys} " if keys else ""
    return f""", placed AS (
      SELECT *, row_number() OVER ({part}ORDER BY date) - 1 AS pos,
             count(*) OVER ({part}) AS n FROM {source})"""


def calendar_sql(keys="country", horizon=12, source="series"):
    """CTE text for ``ahead`` (keys, i, date): dates after a month-bucketed series."""
    by = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    return f""", gaps AS (
      SELECT *, date_diff('day', lag(date) OVER w, date) AS dg,
             date_diff('month', lag(date) OVER w, date) AS mg
      FROM {source} WINDOW w AS ({part}ORDER BY date)),
    cal AS (SELECT {by}count(*) AS cnt, max(date) AS final, min(mg) AS mn, max(mg) AS mx,
                   arg_max(dg, date) AS lg FROM gaps GROUP BY ALL),
    rule AS (SELECT *, CASE WHEN cnt < 2 THEN 'm' WHEN cnt >= 3 AND mn = mx THEN 'r'
                            WHEN lg BETWEEN 28 AND 31 THEN 'm' WHEN lg BETWEEN 89 AND 92 THEN 'q'
                            ELSE 'd' END AS kind,
                    CASE WHEN mx % 12 = 0 THEN 12 WHEN mx % 3 = 0 THEN 3 ELSE 1 END AS base
             FROM cal),
    ahead AS (
      SELECT {by}i, CAST(CASE kind
          WHEN 'r' THEN final + to_months(CAST(base + mx * i AS INTEGER))
          WHEN 'm' THEN final + to_months(CAST(1 + i AS INTEGER))
          WHEN 'q' THEN date_trunc('quarter', final) + to_months(CAST(3 + 3 * i AS INTEGER))
          ELSE final + CAST(i + 1 AS INTEGER) END AS DATE) AS date
      FROM rule, generate_series(0, {horizon - 1}) AS t(i))"""
