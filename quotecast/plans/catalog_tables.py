"""Queries over raw history rows: sources, filters, validation, cleaning, statistics."""

from pyspark.sql import functions as F

from quotecast.operators import anomaly, clean, compare, explore, filters, scale, validate
from quotecast.plans.registry import DIRTY, HISTORY, query, rounded, select
from quotecast.sources import files, profile, synthetic
from quotecast.sources.history import dirty_history, history, table

ORDER = ["date", "part_number", "vendor", "quantity", "lead_time"]
# The filled column comes last, so the order is total up to identical rows.
FULL_ORDER = [*ORDER, "price"]
SQL_ORDER = "date, part_number, vendor, quantity, lead_time, price NULLS FIRST"
ROW = "date part_number vendor country price~ lead_time~ quantity~"


@query("history", select(HISTORY, ROW, "history"))
def _(spark, d):
    return rounded(history(spark, d))


@query("dirty_history", select(DIRTY, ROW, "dirty"))
def _(spark, d):
    return rounded(dirty_history(spark, d))


@query("normalize_names", "SELECT p_partkey AS part_key, p_brand AS brand_name, p_size AS size FROM part")
def _(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return files.normalize_names(part.toDF("Part Key ", " Brand Name", "SIZE"))


@query(
    "parse_dates",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date,
              'lot ' || o_orderkey AS date_note FROM orders""",
)
def _(spark, d):
    texts = table(spark, d, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("order_date"),
        F.concat(F.lit("lot "), F.col("o_orderkey").cast("string")).alias("date_note"),
    )
    return files.parse_dates(texts)


@query(
    "map_roles",
    """SELECT CAST(o_orderdate AS DATE) AS date, floor(o_totalprice * 1e4 + 0.4321) / 1e4 AS price,
              o_custkey AS lead_time, o_orderstatus FROM orders""",
)
def _(spark, d):
    texts = table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        F.col("o_totalprice").cast("string").alias("unit_price"),
        F.col("o_custkey").alias("lead_days"),
        "o_orderstatus",
    )
    return rounded(files.map_roles(texts)[0])


def _uniform_sql(tag, key, start=1):
    digits = f"('0x' || substr(md5('42|{tag}|' || {key}), {start}, 13))"
    return f"(CAST(CAST({digits} AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE)"


def _between_sql(lo, hi, tag, key):
    return f"({lo}::DOUBLE + {_uniform_sql(tag, key)} * ({hi}::DOUBLE - {lo}::DOUBLE))"


def _normal_sql(tag, key):
    first = _uniform_sql(tag, key)
    return (
        f"(sqrt(ln({first} + 1.0::DOUBLE / 4503599627370496.0::DOUBLE) * -2) "
        f"* cos({_uniform_sql(tag, key, 14)} * (2 * pi())))"
    )


_PAIR = "part_number || '|' || vendor"
_TRIPLE = _PAIR + " || '|' || country"
_STAMP = _TRIPLE + " || '|' || CAST(date AS VARCHAR)"
_SYNTHETIC = f"""combos AS (
  SELECT DISTINCT p_brand AS part_number, s_name AS vendor, n_name AS country
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey),
factors AS (
  SELECT *, {_between_sql(10, 100, "price", "part_number")} AS p,
         {_between_sql(7, 60, "lead", "part_number")} AS l,
         {_between_sql(0.002, 0.01, "trend", "part_number")}
           * CASE WHEN {_uniform_sql("sign", "part_number")} < 0.5 THEN -1 ELSE 1 END AS drift,
         {_between_sql(0.05, 0.15, "swing price", "part_number")} AS sp,
         {_between_sql(0.05, 0.15, "swing lead", "part_number")} AS sl,
         {_uniform_sql("phase", "part_number")} * (2 * pi()) AS phase,
         {_between_sql(0.8, 1.2, "vendor", _PAIR)} AS fv,
         {_between_sql(0.8, 1.2, "country", _TRIPLE)} AS fc FROM combos),
dated AS (
  SELECT *, CAST(DATE '2023-01-01' + to_months(CAST(i AS INTEGER)) AS DATE) AS date
  FROM factors, generate_series(0, 11) AS t(i)),
waved AS (SELECT *, month(date) * (2 * pi() / 12) + phase AS angle FROM dated),
made AS (
  SELECT date, part_number, vendor, country,
         p * fv * (1 + drift * i + sp * sin(angle)) + p * 0.03 * {_normal_sql("noise price", _STAMP)} AS price,
         l * fc * (1 + drift * i + sl * sin(angle + pi() / 2))
           + l * 0.03 * {_normal_sql("noise lead", _STAMP)} AS lead_time,
         CAST(floor(50 + {_uniform_sql("quantity", _STAMP)} * 450) AS BIGINT) AS quantity FROM waved)"""


@query(
    "synthetic_history",
    f"""WITH {_SYNTHETIC} SELECT date, part_number, vendor, country,
        round(greatest(10.0::DOUBLE, least(100.0::DOUBLE, price)), 2) AS price,
        round(greatest(7.0::DOUBLE, least(60.0::DOUBLE, lead_time)), 1) AS lead_time, quantity FROM made""",
)
def _(spark, d):
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    supplier, nation = table(spark, d, "supplier"), table(spark, d, "nation")
    combos = (
        line.join(part, line.l_partkey == part.p_partkey)
        .join(supplier, line.l_suppkey == supplier.s_suppkey)
        .join(nation, supplier.s_nationkey == nation.n_nationkey)
        .select(
            F.col("p_brand").alias("part_number"),
            F.col("s_name").alias("vendor"),
            F.col("n_name").alias("country"),
        )
        .distinct()
    )
    return synthetic.history_for(combos, "2023-01-01", "2023-12-31", "MS")


@query(
    "table_profile",
    f"""WITH {DIRTY} SELECT count(*) AS row_count, CAST(7 AS INTEGER) AS column_count,
        'date, part_number, vendor, country, price, lead_time, quantity' AS column_names,
        count(*) FILTER (price IS NULL) AS missing_values,
        min(date) AS date_start, max(date) AS date_end FROM dirty""",
)
def _(spark, d):
    return profile.profile(dirty_history(spark, d))


@query(
    "group_candidates",
    f"""WITH {HISTORY}, counts AS (
          SELECT 'part_number' AS c, count(DISTINCT part_number) AS n FROM history
          UNION ALL SELECT 'vendor', count(DISTINCT vendor) FROM history
          UNION ALL SELECT 'country', count(DISTINCT country) FROM history)
        SELECT 'upload' AS rule, c AS "column", n AS groups,
               CAST(NULL AS BOOLEAN) AS many_groups FROM counts
        UNION ALL SELECT 'upload', 'quantity', count(DISTINCT quantity), NULL FROM history
          HAVING count(DISTINCT quantity) < count(*) * 0.2
        UNION ALL SELECT 'forecast', c, n, n > 20 FROM counts WHERE n <= 50""",
)
def _(spark, d):
    return profile.group_candidates(history(spark, d))


@query(
    "group_count",
    f"""WITH {HISTORY} SELECT count(*) AS groups, count(*) > 20 AS many_groups
        FROM (SELECT DISTINCT vendor, country FROM history)""",
)
def _(spark, d):
    return profile.group_count(history(spark, d), ["vendor", "country"])


@query(
    "category_candidates",
    f"""WITH {HISTORY}, counts AS (
          SELECT 'part_number' AS c, count(DISTINCT part_number) AS n FROM history
          UNION ALL SELECT 'vendor', count(DISTINCT vendor) FROM history
          UNION ALL SELECT 'country', count(DISTINCT country) FROM history
          UNION ALL SELECT 'price', count(DISTINCT price) FROM history
          UNION ALL SELECT 'lead_time', count(DISTINCT lead_time) FROM history
          UNION ALL SELECT 'quantity', count(DISTINCT quantity) FROM history)
        SELECT c AS "column", n AS distinct_values FROM counts WHERE n < 30""",
)
def _(spark, d):
    return profile.category_candidates(history(spark, d))


COUNTRIES = ["NATION_1", "NATION_7", "NATION_12"]


@query(
    "filter_in",
    select(
        HISTORY, ROW,
        "history WHERE country IN ('NATION_1', 'NATION_7', 'NATION_12') AND quantity IN (1, 2, 3, 4, 5)",
    ),
)
def _(spark, d):
    chosen = {"country": COUNTRIES, "quantity": [1.0, 2.0, 3.0, 4.0, 5.0]}
    return rounded(filters.filter_in(history(spark, d), chosen))


@query("filter_eq", select(HISTORY, ROW, "history WHERE country = 'NATION_3'"))
def _(spark, d):
    chosen = {"country": "NATION_3", "vendor": "All"}
    return rounded(filters.filter_eq(history(spark, d), chosen))


@query(
    "filter_dates",
    select(HISTORY, ROW, "history WHERE date BETWEEN DATE '1997-03-01' AND DATE '1997-08-31'"),
)
def _(spark, d):
    return rounded(filters.filter_dates(history(spark, d), "1997-03-01", "1997-08-31"))


@query(
    "filter_semi_join",
    select(HISTORY, ROW, "history WHERE vendor IN (SELECT s_name FROM supplier WHERE s_acctbal > 5000)"),
)
def _(spark, d):
    rich = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_name").alias("vendor"))
    return rounded(filters.filter_in_table(history(spark, d), rich, ["vendor"]))


@query(
    "top_values",
    f"""WITH {HISTORY} SELECT part_number, count(*) AS occurrences FROM history
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""",
)
def _(spark, d):
    return filters.top_values(history(spark, d), "part_number", 50)


@query("distinct_dates", f"WITH {HISTORY} SELECT DISTINCT date FROM history")
def _(spark, d):
    return filters.distinct_values(history(spark, d), "date")


@query("select_columns", select(HISTORY, "price~ date country", "history"))
def _(spark, d):
    return rounded(
        filters.select_columns(history(spark, d), ["price", "date", "price", "absent", "country"])
    )


@query("preview", select(HISTORY, ROW, f"history ORDER BY {SQL_ORDER} LIMIT 10"))
def _(spark, d):
    return rounded(filters.preview(history(spark, d), 10, FULL_ORDER))


@query("drop_incomplete", select(DIRTY, ROW, "dirty WHERE price IS NOT NULL"))
def _(spark, d):
    return rounded(filters.drop_incomplete(dirty_history(spark, d)))


_VALID = """SELECT 'clean' AS source, true AS valid, 'Data validation successful' AS message
UNION ALL SELECT 'dirty', {price} = 0, CASE WHEN {price} > 0
  THEN 'Invalid price column format or values in ''price''' ELSE 'Data validation successful' END
UNION ALL SELECT 'lead', {lead} = 0, CASE WHEN {lead} > 0
  THEN 'Invalid lead_time column format or values in ''lead_time''' ELSE 'Data validation successful' END
UNION ALL SELECT 'orders', false, 'Missing required columns: date, price, lead_time'"""


@query(
    "validate",
    f"WITH {DIRTY} "
    + _VALID.format(
        price="(SELECT count(*) FROM dirty WHERE price IS NULL)",
        lead="(SELECT count(*) FROM dirty WHERE lead_time < 0)",
    ),
)
def _(spark, d):
    dirty = dirty_history(spark, d)
    cases = {
        "clean": history(spark, d),
        "dirty": dirty,
        "lead": dirty.withColumn("price", F.coalesce("price", F.lit(1.0))),
        "orders": table(spark, d, "orders"),
    }
    out = None
    for name, df in cases.items():
        row = validate.validate(df, "forecasting").select(F.lit(name).alias("source"), "valid", "message")
        out = row if out is None else out.unionByName(row)
    return out


_REPORT = DIRTY + """, sized AS (
  SELECT 'part_number' AS c, count(*) FILTER (n < 12) AS small FROM
    (SELECT part_number, count(*) AS n FROM dirty GROUP BY 1)
  UNION ALL SELECT 'vendor', count(*) FILTER (n < 12) FROM (SELECT vendor, count(*) AS n FROM dirty GROUP BY 1)
  UNION ALL SELECT 'country', count(*) FILTER (n < 12) FROM (SELECT country, count(*) AS n FROM dirty GROUP BY 1)),
found AS (
  SELECT 'missing_values' AS m, c, n, 'Column ''' || c || ''' has ' || n || ' missing values' AS t FROM (
    SELECT unnest(['date', 'part_number', 'vendor', 'country', 'price', 'lead_time', 'quantity']) AS c,
           unnest([count(*) - count(date), count(*) - count(part_number), count(*) - count(vendor),
                   count(*) - count(country), count(*) - count(price), count(*) - count(lead_time),
                   count(*) - count(quantity)]) AS n FROM dirty)
  UNION ALL
  SELECT 'negative_values', c, n, 'Column ''' || c || ''' has ' || n || ' negative values' FROM (
    SELECT unnest(['price', 'lead_time']) AS c,
           unnest([count(*) FILTER (price < 0), count(*) FILTER (lead_time < 0)]) AS n FROM dirty)
  UNION ALL
  SELECT 'duplicates', NULL, (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)),
         'Data contains ' || ((SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)))
         || ' duplicate rows'
  UNION ALL
  SELECT 'small_groups', c, small, small || ' values in ''' || c || ''' have fewer than 12 data points' FROM sized),
report AS (
  SELECT m AS metric, c AS "column", CAST(n AS VARCHAR) AS value, CASE WHEN n > 0 THEN t END AS issue FROM found
  UNION ALL SELECT 'row_count', NULL, CAST(count(*) AS VARCHAR), NULL FROM dirty
  UNION ALL SELECT 'column_count', NULL, '7', NULL
  UNION ALL SELECT 'date_start', 'date', CAST(min(date) AS VARCHAR), NULL FROM dirty
  UNION ALL SELECT 'date_end', 'date', CAST(max(date) AS VARCHAR), NULL FROM dirty
  UNION ALL SELECT 'date_periods', 'date', CAST(count(DISTINCT date) AS VARCHAR), NULL FROM dirty)"""


@query("quality_report", f"WITH {_REPORT} SELECT * FROM report")
def _(spark, d):
    return validate.quality_report(dirty_history(spark, d))


@query(
    "suggest_fixes",
    f"""WITH {_REPORT} SELECT metric AS issue, "column", CASE
          WHEN metric = 'negative_values' THEN 'Replace with absolute values or remove rows'
          WHEN metric = 'duplicates' THEN 'Remove duplicate rows'
          WHEN "column" IN ('price', 'lead_time') THEN
            CASE WHEN CAST(value AS DOUBLE) / (SELECT count(*) FROM dirty) < 0.1
                 THEN 'Replace with mean or median'
                 ELSE 'Consider removing rows or using more advanced imputation' END
          WHEN "column" = 'date' THEN 'Remove rows with missing dates'
          ELSE 'Fill with mode or remove rows' END AS suggestion
        FROM report WHERE metric IN ('missing_values', 'negative_values', 'duplicates') AND issue IS NOT NULL
        UNION ALL SELECT 'grouping', NULL,
          'Consider grouping by one or more of: part_number, vendor, country'""",
)
def _(spark, d):
    return validate.suggest_fixes(dirty_history(spark, d))


def _bounds_sql(column, low, high, source):
    return f"""SELECT quantile_cont({column}, {low}::DOUBLE) AS lo,
               quantile_cont({column}, {high}::DOUBLE) AS hi FROM {source}"""


def _clamp_sql(c, lo, hi):
    return f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {lo}), {hi}) END"


_FILLED = DIRTY + """, filled AS (
  SELECT date, part_number, vendor, country, quantity,
         coalesce(price, (SELECT median(price) FROM dirty)) AS price,
         coalesce(lead_time, (SELECT median(lead_time) FROM dirty)) AS lead_time FROM dirty)"""


@query(
    "clean_default",
    select(
        _FILLED + """, tails AS (
          SELECT quantile_cont(price, [0.05::DOUBLE, 0.95::DOUBLE]) AS p,
                 quantile_cont(lead_time, [0.05::DOUBLE, 0.95::DOUBLE]) AS l,
                 quantile_cont(quantity, [0.25::DOUBLE, 0.75::DOUBLE]) AS q FROM filled)""",
        [
            "date", "part_number", "vendor", "country",
            "price~=least(greatest(price, greatest(0, p[1])), p[2])",
            "lead_time~=least(greatest(lead_time, greatest(0, l[1])), l[2])",
            "quantity~=least(greatest(quantity, q[1] - 1.5 * (q[2] - q[1])), q[2] + 1.5 * (q[2] - q[1]))",
        ],
        "filled, tails",
    ),
)
def _(spark, d):
    return rounded(clean.clean(dirty_history(spark, d)))


_FENCE = """, fence AS (
  SELECT greatest(0, q[1] - 1.5 * (q[2] - q[1])) AS lo, q[2] + 1.5 * (q[2] - q[1]) AS hi
  FROM (SELECT quantile_cont(price, [0.25::DOUBLE, 0.75::DOUBLE]) AS q FROM {0}))"""


def _price_case(name, fill, source, strategy):
    """Clean only the price: how gaps are filled, and the SQL for the same."""
    ctes = DIRTY + f", filled AS (SELECT * REPLACE ({fill} AS price) FROM dirty)"
    if strategy.get("outlier"):
        ctes += _FENCE.format("filled")

    @query(name, select(ctes, source[0], source[1]))
    def _(spark, d):
        return rounded(clean.clean(dirty_history(spark, d), {"price": strategy}))


CLIPPED = "date part_number vendor country price~=least(greatest(price,lo),hi) lead_time~ quantity~"
_price_case(
    "clean_mean_clip",
    "coalesce(price, (SELECT avg(price) FROM dirty))",
    (CLIPPED, "filled, fence"),
    {"missing": "mean", "outlier": "clip"},
)
_price_case(
    "clean_zero_remove",
    "coalesce(price, 0)",
    (ROW, "filled, fence WHERE price BETWEEN lo AND hi"),
    {"missing": "zero", "outlier": "remove"},
)
_price_case(
    "clean_mode",
    """coalesce(price, (SELECT price FROM dirty WHERE price IS NOT NULL
                        GROUP BY price ORDER BY count(*) DESC, price LIMIT 1))""",
    (ROW, "filled"),
    {"missing": "mode"},
)
_price_case(
    "clean_drop_iqr",
    "price",
    (ROW, "filled, fence WHERE price BETWEEN lo AND hi"),
    {"missing": "drop", "outlier": "iqr"},
)

_CARRY = DIRTY + f""", carried AS (
  SELECT *, last_value(price IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS back,
         first_value(price IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead,
         row_number() OVER w AS pos FROM dirty
  WINDOW w AS (PARTITION BY vendor ORDER BY {SQL_ORDER})),
marked AS (
  SELECT *, max(CASE WHEN price IS NOT NULL THEN pos END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p0,
         min(CASE WHEN price IS NOT NULL THEN pos END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1
  FROM carried WINDOW w AS (PARTITION BY vendor ORDER BY pos))"""

for _name, _expr in (
    ("ffill", "coalesce(back,ahead)"),
    ("bfill", "coalesce(ahead,back)"),
    (
        "interpolate",
        "CASE WHEN p1 > p0 THEN back + (ahead - back) / (p1 - p0) * (pos - p0) ELSE coalesce(back, ahead) END",
    ),
):
    _columns = ["date", "part_number", "vendor", "country", f"price~={_expr}", "lead_time~", "quantity~"]

    @query(f"clean_{_name}", select(_CARRY, _columns, "marked"))
    def _(spark, d, how=_name):
        return rounded(
            clean.clean(dirty_history(spark, d), {"price": {"missing": how}}, ["vendor"], FULL_ORDER)
        )


# Vendors without any price: what the ordered fill leaves open takes the median.
_BLANK = _CARRY.replace("), carried AS", """), blank AS (
  SELECT * REPLACE (CASE WHEN vendor NOT LIKE '%1' THEN price END AS price) FROM dirty), carried AS""")
_BLANK = _BLANK.replace("AS pos FROM dirty", "AS pos FROM blank") + """, filled AS (
  SELECT *, CASE WHEN p1 > p0 THEN back + (ahead - back) / (p1 - p0) * (pos - p0)
            ELSE coalesce(back, ahead) END AS fill FROM marked)"""


@query(
    "clean_residual",
    select(
        _BLANK,
        [
            "date", "part_number", "vendor", "country",
            "price~=coalesce(fill, (SELECT quantile_cont(fill, 0.5::DOUBLE) FROM filled))",
            "lead_time~", "quantity~",
        ],
        "filled",
    ),
)
def _(spark, d):
    priced = F.when(~F.col("vendor").like("%1"), F.col("price"))
    rows = dirty_history(spark, d).withColumn("price", priced)
    return rounded(clean.clean(rows, {"price": {"missing": "interpolate"}}, ["vendor"], FULL_ORDER))


@query(
    "cleaning_summary",
    f"""WITH {DIRTY} SELECT r.c AS "column", r.rows AS raw_rows, r.n AS raw_missing,
          k.rows AS clean_rows, k.n AS clean_missing FROM
        (SELECT (SELECT count(*) FROM dirty) AS rows,
          unnest(['date', 'part_number', 'vendor', 'country', 'price', 'lead_time', 'quantity']) AS c,
          unnest([0, 0, 0, 0, (SELECT count(*) FROM dirty WHERE price IS NULL), 0, 0]) AS n) r
        JOIN (SELECT (SELECT count(*) FROM dirty WHERE price IS NOT NULL) AS rows,
          unnest(['date', 'part_number', 'vendor', 'country', 'price', 'lead_time', 'quantity']) AS c,
          CAST(0 AS BIGINT) AS n) k ON r.c = k.c""",
)
def _(spark, d):
    raw = dirty_history(spark, d)
    return clean.cleaning_summary(raw, filters.drop_incomplete(raw))


for _name, _expr in (
    ("minmax", "({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())"),
    ("zscore", "({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()"),
    ("robust", "({c} - {q}[2]) / ({q}[3] - {q}[1])"),
):

    @query(
        f"normalize_{_name}",
        select(
            HISTORY + """, q AS (
              SELECT quantile_cont(price, [0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS qp,
                     quantile_cont(lead_time, [0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS ql FROM history)""",
            [
                "part_number", "vendor", "date",
                "price~=" + _expr.format(c="price", q="qp"),
                "lead_time~=" + _expr.format(c="lead_time", q="ql"),
            ],
            "history, q",
            6,
        ),
    )
    def _(spark, d, how=_name):
        scaled = scale.normalize(history(spark, d), ["price", "lead_time"], how)
        return rounded(scaled.select("part_number", "vendor", "date", "price", "lead_time"), 6)


for _name, _expr in (
    ("zscore", "abs((price - avg(price) OVER ()) / stddev_samp(price) OVER ()) > 3"),
    ("iqr", "price < q[1] - 3 * (q[2] - q[1]) OR price > q[2] + 3 * (q[2] - q[1])"),
):

    @query(
        f"anomalies_{_name}",
        f"""WITH {DIRTY}, q AS (SELECT quantile_cont(price, [0.25::DOUBLE, 0.75::DOUBLE]) AS q FROM dirty)
            SELECT part_number, vendor, date, floor(price * 1e4 + 0.4321) / 1e4 AS price,
              coalesce({_expr}, false) AS anomaly FROM dirty, q""",
    )
    def _(spark, d, how=_name):
        flagged = anomaly.flag_anomalies(dirty_history(spark, d), "price", how)
        return rounded(flagged.select("part_number", "vendor", "date", "price", "anomaly"))


_FOREST = f"""{DIRTY}, src AS (SELECT price AS v, row_number() OVER (ORDER BY price) - 1 AS place FROM dirty WHERE price IS NOT NULL),
    dealt AS (SELECT v, place, row_number() OVER (ORDER BY md5('42:' || place)) - 1 AS i, count(*) OVER () AS n FROM src),
    drawn AS (
      SELECT t AS tree, v, row_number() OVER (PARTITION BY t ORDER BY md5('42:' || t || ':' || place)) AS turn
      FROM dealt, range(0, 100) AS x(t) WHERE n < 25600),
    planted AS (SELECT i // 256 AS tree, v, n FROM dealt WHERE n >= 25600 AND i < 25600
                UNION ALL SELECT tree, v, (SELECT count(*) FROM src) FROM drawn WHERE turn <= 256),
    grown AS (
      SELECT tree, v, 1 AS node, '-inf'::DOUBLE AS low, 0 AS depth, ceil(log2(greatest(least(n, 256), 2))) AS levels FROM planted
      UNION ALL
      SELECT tree, v, 2 * node + (v > split)::INT, CASE WHEN v > split THEN split ELSE low END, depth + 1, levels
      FROM (SELECT *, least_v + ('0x' || md5('42:split:' || tree || ':' || node)[1:13])::BIGINT / 4503599627370496::DOUBLE * (most_v - least_v) AS split
            FROM (SELECT *, min(v) OVER w AS least_v, max(v) OVER w AS most_v FROM grown WHERE depth < levels WINDOW w AS (PARTITION BY tree, node)))
      WHERE least_v < most_v),
    leaves AS (
      SELECT tree, any_value(low) AS edge, depth + CASE count(*) WHEN 1 THEN 0 WHEN 2 THEN 1
             ELSE 2 * (ln(count(*) - 1) + 0.5772156649015329::DOUBLE) - 2 * (count(*) - 1) / count(*) END AS d
      FROM grown GROUP BY tree, node, depth, levels HAVING depth = levels OR min(v) = max(v)),
    steps AS (SELECT edge, sum(gain) / 100 AS gain FROM (
      SELECT edge, d - coalesce(lag(d) OVER (PARTITION BY tree ORDER BY edge), 0) AS gain FROM leaves) GROUP BY edge),
    curve AS (SELECT edge, round(sum(gain) OVER (ORDER BY edge), 9) AS path FROM steps),
    scored AS (SELECT dirty.*, path FROM dirty ASOF LEFT JOIN curve ON price > edge),
    cut AS (SELECT quantile_cont(path, 0.05::DOUBLE) AS cut FROM scored)"""


@query(
    "anomalies_isolation_forest",
    select(_FOREST, "part_number vendor date price~ anomaly=coalesce(path<cut,false)", "scored, cut"),
)
def _(spark, d):
    flagged = anomaly.flag_anomalies(dirty_history(spark, d), "price", "isolation_forest")
    return rounded(flagged.select("part_number", "vendor", "date", "price", "anomaly"))


def _describe_sql(c):
    return f"""SELECT '{c}' AS "column", count({c}) AS count, floor(avg({c}) * 1e4 + 0.4321) / 1e4 AS mean,
      floor(stddev_samp({c}) * 1e4 + 0.4321) / 1e4 AS std, floor(min({c}) * 1e4 + 0.4321) / 1e4 AS min, floor(quantile_cont({c}, 0.25::DOUBLE) * 1e4 + 0.4321) / 1e4 AS q25,
      floor(quantile_cont({c}, 0.5::DOUBLE) * 1e4 + 0.4321) / 1e4 AS q50, floor(quantile_cont({c}, 0.75::DOUBLE) * 1e4 + 0.4321) / 1e4 AS q75,
      floor(max({c}) * 1e4 + 0.4321) / 1e4 AS max FROM dirty"""


@query(
    "describe",
    f"WITH {DIRTY} " + " UNION ALL ".join(_describe_sql(c) for c in ("price", "lead_time", "quantity")),
)
def _(spark, d):
    return rounded(explore.describe(dirty_history(spark, d)))


@query(
    "missing_table",
    f"""WITH {DIRTY} SELECT 'price' AS "column", count(*) FILTER (price IS NULL) AS missing,
        floor((count(*) FILTER (price IS NULL) / count(*) * 100) * 1e4 + 0.4321) / 1e4 AS percent FROM dirty""",
)
def _(spark, d):
    return rounded(explore.missing_table(dirty_history(spark, d)))


@query(
    "histogram",
    f"""WITH {HISTORY}, e AS (SELECT min(price) AS lo, (max(price) - min(price)) / 20 AS w,
          avg(price) AS m, quantile_cont(price, 0.5::DOUBLE) AS md, count(*) AS n FROM history)
        SELECT b AS bin, floor((b * w + lo) * 1e4 + 0.4321) / 1e4 AS lower, floor(((b + 1) * w + lo) * 1e4 + 0.4321) / 1e4 AS upper, c AS count,
               floor((c / n / w) * 1e9 + 0.4321) / 1e9 AS density, floor(m * 1e4 + 0.4321) / 1e4 AS mean, floor(md * 1e4 + 0.4321) / 1e4 AS median FROM
        (SELECT CAST(least(floor((price - lo) / w), 19) AS INTEGER) AS b, count(*) AS c
         FROM history, e GROUP BY 1), e""",
)
def _(spark, d):
    found = explore.histogram(history(spark, d), "price", 20)
    return rounded(found.drop("density")).join(
        rounded(found.select("bin", "density"), 9), "bin"
    )


@query(
    "box_stats",
    f"""WITH {HISTORY}, q AS (SELECT country, quantile_cont(price, 0.25::DOUBLE) AS q1,
          quantile_cont(price, 0.5::DOUBLE) AS median, quantile_cont(price, 0.75::DOUBLE) AS q3
          FROM history GROUP BY 1)
        SELECT country, floor(q1 * 1e4 + 0.4321) / 1e4 AS q1, floor(median * 1e4 + 0.4321) / 1e4 AS median, floor(q3 * 1e4 + 0.4321) / 1e4 AS q3,
          floor((min(price) FILTER (price >= q1 - 1.5 * (q3 - q1))) * 1e4 + 0.4321) / 1e4 AS lower_whisker,
          floor((max(price) FILTER (price <= q3 + 1.5 * (q3 - q1))) * 1e4 + 0.4321) / 1e4 AS upper_whisker,
          count(*) FILTER (price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM history JOIN q USING (country) GROUP BY country, q1, median, q3""",
)
def _(spark, d):
    return rounded(explore.box_stats(history(spark, d), "price", ["country"]))


_NUMBERS = ("price", "lead_time", "quantity")


@query(
    "correlation_matrix",
    f"WITH {DIRTY} " + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, floor(corr({a}, {b}) * 1e6 + 0.4321) / 1e6 AS correlation FROM dirty"
        for a in _NUMBERS for b in _NUMBERS
    ),
)
def _(spark, d):
    return rounded(explore.correlation_matrix(dirty_history(spark, d)), 6)


@query(
    "correlation_strength",
    f"""WITH {HISTORY} SELECT country, floor(r * 1e6 + 0.4321) / 1e6 AS correlation, CASE WHEN abs(r) < 0.3 THEN 'weak'
        WHEN abs(r) < 0.7 THEN 'moderate' ELSE 'strong' END AS strength
        FROM (SELECT country, corr(quantity, price) AS r FROM history GROUP BY 1)""",
)
def _(spark, d):
    return rounded(explore.correlation(history(spark, d), "quantity", "price", ["country"]), 6)


@query(
    "ols_trend",
    f"""WITH {HISTORY} SELECT country, count(*) AS points, floor(regr_slope(price, quantity) * 1e6 + 0.4321) / 1e6 AS slope,
        floor(regr_intercept(price, quantity) * 1e6 + 0.4321) / 1e6 AS intercept, floor(regr_r2(price, quantity) * 1e6 + 0.4321) / 1e6 AS r2
        FROM history GROUP BY 1""",
)
def _(spark, d):
    return rounded(explore.ols_trend(history(spark, d), "quantity", "price", ["country"]), 6)


STATS = """floor(min({0}) * 1e4 + 0.4321) / 1e4 AS min, floor(max({0}) * 1e4 + 0.4321) / 1e4 AS max, floor(avg({0}) * 1e4 + 0.4321) / 1e4 AS mean,
  floor(stddev_samp({0}) * 1e4 + 0.4321) / 1e4 AS std, floor((max({0}) - min({0})) * 1e4 + 0.4321) / 1e4 AS "range", count({0}) AS count,
  floor(quantile_cont({0}, 0.5::DOUBLE) * 1e4 + 0.4321) / 1e4 AS median"""


@query("stats_overall", f"WITH {HISTORY} SELECT {STATS.format('price')} FROM history")
def _(spark, d):
    return rounded(explore.stats(history(spark, d), "price"))


@query(
    "stats_by_groups",
    f"WITH {HISTORY} SELECT country, vendor, {STATS.format('lead_time')} FROM history GROUP BY 1, 2",
)
def _(spark, d):
    return rounded(explore.stats(history(spark, d), "lead_time", ["country", "vendor"]))


@query(
    "stats_by_each_group",
    f"""WITH {HISTORY} SELECT 'all' AS "group", '' AS key, {STATS.format('price')} FROM history
        UNION ALL SELECT 'country', country, {STATS.format('price')} FROM history GROUP BY country
        UNION ALL SELECT 'vendor', vendor, {STATS.format('price')} FROM history GROUP BY vendor""",
)
def _(spark, d):
    return rounded(explore.stats_by_each(history(spark, d), "price", ["country", "vendor"]))


@query(
    "monthly_mean",
    f"""WITH {HISTORY} SELECT strftime(date, '%Y-%m') AS month, country, floor(avg(price) * 1e4 + 0.4321) / 1e4 AS mean
        FROM history GROUP BY 1, 2""",
)
def _(spark, d):
    return rounded(explore.monthly_mean(history(spark, d), "price", ["country"]))


for _name, _expr in (
    ("count", "count(price)"),
    ("std", "floor((coalesce(stddev_samp(price), 0)) * 1e4 + 0.4321) / 1e4"),
    ("range", "floor((max(price) - min(price)) * 1e4 + 0.4321) / 1e4"),
):

    @query(
        f"bubble_{_name}",
        f"""WITH {HISTORY} SELECT vendor, floor(avg(price) * 1e4 + 0.4321) / 1e4 AS y, {_expr} AS size
            FROM history GROUP BY 1""",
    )
    def _(spark, d, how=_name):
        return rounded(explore.bubble(history(spark, d), "price", "vendor", how))


@query(
    "bubble_by_month",
    f"""WITH {HISTORY} SELECT strftime(date, '%Y-%m') AS month, floor(avg(price) * 1e4 + 0.4321) / 1e4 AS y,
        count(price) AS size FROM history GROUP BY 1""",
)
def _(spark, d):
    return rounded(explore.bubble(history(spark, d), "price"))


_MEANS = """, means AS (SELECT vendor, avg(price) AS p, avg(lead_time) AS l FROM history GROUP BY 1),
top AS (SELECT vendor, p AS mean FROM means ORDER BY p DESC, vendor LIMIT 5)"""


@query("top_groups", select(HISTORY + _MEANS, "vendor mean~", "top"))
def _(spark, d):
    return rounded(compare.top_groups(history(spark, d), "price", "vendor", 5))


@query(
    "top_groups_merged",
    f"""WITH {HISTORY}{_MEANS}, ranked AS (
          SELECT vendor, row_number() OVER (ORDER BY p DESC, vendor) AS r FROM means
          UNION ALL SELECT vendor, row_number() OVER (ORDER BY l DESC, vendor) FROM means)
        SELECT vendor, CAST(min(r) AS INTEGER) AS rank FROM ranked WHERE r <= 5 GROUP BY 1
        ORDER BY 2, 1 LIMIT 5""",
)
def _(spark, d):
    rows = history(spark, d)
    return compare.top_groups_merged(rows, rows, "vendor", 5)


@query(
    "compare_at_date",
    select(HISTORY + _MEANS, ROW, "history WHERE date = DATE '1998-05-01' AND vendor IN (SELECT vendor FROM top)"),
)
def _(spark, d):
    rows = history(spark, d)
    top = compare.top_groups(rows, "price", "vendor", 5)
    return rounded(compare.compare_at(rows, "1998-05-01", "price", "vendor", top))


@query(
    "compare_over_time",
    select(HISTORY + _MEANS, ROW, "history WHERE vendor IN (SELECT vendor FROM top)"),
)
def _(spark, d):
    rows = history(spark, d)
    top = compare.top_groups(rows, "price", "vendor", 5)
    return rounded(compare.compare_over_time(rows, top, "vendor"))


@query(
    "pivot_groups",
    f"""SELECT * FROM (PIVOT (
          WITH {HISTORY} SELECT country, CAST(year(date) AS VARCHAR) AS year, floor(avg(price) * 1e4 + 0.4321) / 1e4 AS m
          FROM history GROUP BY ALL) ON year USING any_value(m) GROUP BY country)""",
)
def _(spark, d):
    rows = history(spark, d).withColumn("year", F.year("date").cast("string"))
    return rounded(compare.pivot_mean(rows, "country", "year", "price"))


_MONTHS = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13)][:80]


@query(
    "pivot_months",
    f"WITH {HISTORY} SELECT country, " + ", ".join(
        f"""floor((avg(price) FILTER (strftime(date, '%Y-%m') = '{m}')) * 1e4 + 0.4321) / 1e4 AS "{m}\"""" for m in _MONTHS
    ) + " FROM history GROUP BY 1",
)
def _(spark, d):
    return rounded(compare.pivot_mean(history(spark, d), "country", "month", "price"))
