"""Reproducible synthetic purchase history as a distributed table.

Every number comes from a hash of the seed and the row's own key, so any
partitioning, retry or cluster size yields the same table.
"""

from math import pi

from pyspark.sql import functions as F

# Country names used before numbered ones.
COUNTRIES = (
    "USA", "China", "Germany", "Japan", "UK", "France", "Italy", "Canada", "Mexico",
    "Brazil", "India", "South Korea", "Spain", "Australia", "Netherlands",
)
STEPS = {"D": "1 day", "W": "7 days", "MS": "1 month"}
HEX_DIGITS = 13


def synthetic_history(
    spark, start, end, frequency="MS", num_parts=5, num_vendors=3, num_countries=3, **options
):
    """parts x vendors x countries x dates; the ids come from one spark.range."""
    vendors = num_vendors
    country = F.get(F.array(*[F.lit(c) for c in COUNTRIES]), F.col("c"))
    combos = spark.range(num_parts * vendors * num_countries).select(
        F.floor(F.col("id") / (vendors * num_countries)).cast("int").alias("p"),
        F.floor(F.col("id") / num_countries).cast("int").alias("vc"),
        F.pmod(F.col("id"), F.lit(num_countries)).cast("int").alias("c"),
    )
    keys = combos.select(
        F.format_string("PART%05d", F.col("p") + 1).alias("part_number"),
        F.concat(F.lit("Vendor"), _letters(F.pmod("vc", F.lit(vendors)), vendors)).alias("vendor"),
        F.coalesce(
            country, F.concat(F.lit("Country"), (F.col("c") - len(COUNTRIES) + 1).cast("string"))
        ).alias("country"),
    )
    return history_for(keys, start, end, frequency, **options)


def _letters(number, count):
    """A, B, ..., Z, AA, AB, ... for 0, 1, ..., count - 1."""
    name, size, rest = F.char(F.pmod(number, F.lit(26)) + 65), 26, F.floor(number / 26) - 1
    while size < count:
        name = F.concat(F.when(rest >= 0, F.char(F.pmod(rest, F.lit(26)) + 65)).otherwise(""), name)
        size, rest = size * 26 + 26, F.floor(rest / 26) - 1
    return name


def history_for(
    combos,
    start,
    end,
    frequency="MS",
    seed=42,
    min_price=10.0,
    max_price=100.0,
    min_lead_time=7.0,
    max_lead_time=60.0,
    include_trend=True,
    include_seasonality=True,
):
    """Synthetic history for given (part_number, vendor, country) combinations."""
    first, last = _date(start), _date(end)
    if frequency == "MS":
        first = F.add_months(F.trunc(F.date_sub(first, 1), "MM"), 1)
    elif frequency == "W":
        first = F.next_day(F.date_sub(first, 1), "SUN")
    elif frequency != "D":
        raise ValueError(f"unknown frequency {frequency!r}: use D, W or MS")
    dates = F.when(
        first <= last, F.sequence(first, last, F.expr(f"interval {STEPS[frequency]}"))
    )

    part = F.col("part_number")
    pair = F.concat_ws("|", "part_number", "vendor")
    triple = F.concat_ws("|", "part_number", "vendor", "country")

    def between(lo, hi, tag, key):
        return F.lit(float(lo)) + _uniform(seed, tag, key) * (hi - lo)

    season = 1.0 if include_seasonality else 0.0
    slope = F.when(_uniform(seed, "sign", part) < 0.5, -1.0).otherwise(1.0)
    drift = between(0.002, 0.01, "trend", part) * slope * (1.0 if include_trend else 0.0)
    factors = combos.select(
        "part_number",
        "vendor",
        "country",
        between(min_price, max_price, "price", part).alias("_price"),
        between(min_lead_time, max_lead_time, "lead", part).alias("_lead"),
        drift.alias("_drift"),
        (between(0.05, 0.15, "swing price", part) * season).alias("_swing_price"),
        (between(0.05, 0.15, "swing lead", part) * season).alias("_swing_lead"),
        between(0, 2 * pi, "phase", part).alias("_phase"),
        between(0.8, 1.2, "vendor", pair).alias("_vendor"),
        between(0.8, 1.2, "country", triple).alias("_country"),
    )
    rows = factors.select("*", F.posexplode(dates).alias("_i", "date"))
    stamp = F.concat_ws("|", triple, F.col("date").cast("string"))
    angle = F.month("date") * F.lit(2 * pi / 12) + F.col("_phase")
    price_wave = F.col("_swing_price") * F.sin(angle)
    lead_wave = F.col("_swing_lead") * F.sin(angle + pi / 2)
    drifted = 1 + F.col("_drift") * F.col("_i")
    price = F.col("_price") * F.col("_vendor") * (drifted + price_wave)
    lead = F.col("_lead") * F.col("_country") * (drifted + lead_wave)
    price += F.col("_price") * 0.03 * _normal(seed, "noise price", stamp)
    lead += F.col("_lead") * 0.03 * _normal(seed, "noise lead", stamp)
    quantity = F.floor(F.lit(50) + _uniform(seed, "quantity", stamp) * 450)
    return rows.select(
        "date",
        "part_number",
        "vendor",
        "country",
        F.round(_within(price, min_price, max_price), 2).alias("price"),
        F.round(_within(lead, min_lead_time, max_lead_time), 1).alias("lead_time"),
        quantity.cast("long").alias("quantity"),
    )


def _date(value):
    return F.lit(value).cast("date")


def _within(c, lo, hi):
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c))


def _digits(seed, tag, key, start):
    text = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), key))
    return F.conv(F.substring(text, start, HEX_DIGITS), 16, 10).cast("double")


def _uniform(seed, tag, key, start=1):
    """Uniform in [0, 1) from 52 hash bits."""
    return _digits(seed, tag, key, start) / float(16**HEX_DIGITS)


def _normal(seed, tag, key):
    """Standard normal from two independent pieces of one hash (Box-Muller)."""
    u1 = (_digits(seed, tag, key, 1) + 1) / float(16**HEX_DIGITS)
    u2 = _uniform(seed, tag, key, HEX_DIGITS + 1)
    return F.sqrt(F.log(u1) * -2) * F.cos(u2 * (2 * pi))
