"""Delimited files to a typed history table."""

import csv
from urllib.parse import unquote

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotecast.functions.columns import nan_to_null
from quotecast.schema import is_numeric, is_temporal, numeric_columns, string_columns

# Separators and encodings the reader accepts, texts that mean a
# missing value, date layouts tried.
SEPARATORS = (",", ";", "\t", "|")
ENCODINGS = {
    "utf-8": "UTF-8",
    "iso-8859-1": "ISO-8859-1",
    "latin1": "ISO-8859-1",
    "cp1252": "ISO-8859-1",
}
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
DATE_FORMATS = (
    None,
    "MM/dd/yyyy",
    "M/d/yyyy",
    "dd.MM.yyyy",
    "yyyy/MM/dd",
    "yyyyMMdd",
    "dd-MMM-yyyy",
    "MMM d, yyyy",
    "d/M/yyyy",
)


SURPLUS = 8  # fields after the last one of a header that are looked at


def read_history(spark, path, format="csv", sep=",", encoding="utf-8", schema=None, multi_line=False):
    """Read one file, a folder or a glob; names normalized, dates parsed.

    Quotes inside quoted text are doubled. Files whose header differs from the
    first one's raise rather than mix up columns. ``multi_line`` allows line
    breaks inside quotes, at the price of one task per file. Give ``schema`` for large
    inputs: without it the types are found by one more read of the whole input.
    """
    if format != "csv":
        raise ValueError(f"unknown format {format!r}: only 'csv'; export workbooks to it")
    df = _with_nulls(_read_delimited(spark, path, sep, encoding, multi_line))
    df = _typed(df) if schema is None else _cast(df, schema)
    return parse_dates(nulls_for_nan(normalize_names(df)))


def read_layouts(spark, path, sep=",", encoding="utf-8", schema=None):
    """(rows, bad): delimited files of any layouts in one table, and the lines that do not fit theirs.

    Every file's own header says what its columns are; files of one header are read
    together and all layouts are matched by normalized name, with NULL where a file lacks
    a column. Rows that end early are filled with NULL. Rows with more values than their
    header go to ``bad`` (file, line). ``schema`` picks and types columns by name; without
    it types are found as in ``read_history``. The driver holds one header and one path a
    file; headers are found in a pass over the lines. Empty files have no header
    and no rows; a header that names a column twice raises.
    """
    if sep not in SEPARATORS or encoding.lower() not in ENCODINGS:
        raise ValueError(f"unknown separator {sep!r} or encoding {encoding!r}")
    layouts = {}
    for file, header in _headers(spark, path, sep, encoding):
        layouts.setdefault(header, []).append(file)
    rows = bad = None
    for header, paths in sorted(layouts.items()):
        told, surplus = _read_layout(spark, paths, header, sep, encoding)
        rows = told if rows is None else rows.unionByName(told, allowMissingColumns=True)
        bad = surplus if bad is None else bad.unionByName(surplus)
    if rows is None:
        rows = spark.createDataFrame([], schema or "date date")
        return rows, spark.createDataFrame([], "file string, line string")
    rows = _with_nulls(rows)
    if schema is None:
        rows = _typed(rows)
    else:
        rows = rows.select(*[
            (F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
        ])
    return parse_dates(nulls_for_nan(rows)), bad


def _headers(spark, path, sep, encoding):
    """(path, normalized names) of every file that holds a line."""
    lines = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary").alias("line"))
    first = (
        lines.where("file_block_start = 0").withColumn("at", F.monotonically_increasing_id())
        .groupBy("file_path").agg(F.min_by("line", "at").alias("line"))
    )
    for row in first.collect():
        text = bytes(row["line"]).decode("cp1252" if encoding.lower() == "cp1252" else ENCODINGS[encoding.lower()], "replace")
        names = [name.strip() or f"_c{i}" for i, name in enumerate(next(csv.reader([text.lstrip("\ufeff")], delimiter=sep)))]
        names = normalize_names(spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in names]))).columns
        if len(set(names)) < len(names):
            raise ValueError(f"{row['file_path']}: a column name stands twice in {names}")
        yield unquote(row["file_path"]), tuple(names)


def _read_layout(spark, paths, names, sep, encoding):
    """Rows of files with one header as text, and their lines with surplus values."""
    surplus = [f"_surplus{i}" for i in range(SURPLUS)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, *surplus, "_line")])
    df = spark.read.schema(schema).options(
        header=True, sep=sep, encoding=ENCODINGS[encoding.lower()], ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
        mode="PERMISSIVE", columnNameOfCorruptRecord="_line", escape='"', enforceSchema=True,
    ).csv(paths).withColumn("_file", F.col("_metadata.file_path"))
    df = _windows_1252(df) if encoding.lower() == "cp1252" else df
    over = F.coalesce(*surplus).isNotNull()
    line = F.coalesce("_line", F.concat_ws(sep, *[F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in (*names, *surplus)]))
    return df.where(~over).select(*[F.col(f"`{n}`") for n in names]), df.where(over).select(F.col("_file").alias("file"), line.alias("line"))


def _read_delimited(spark, path, sep, encoding, multi_line=False):
    """All columns as text; a row with too few or too many fields raises."""
    if sep not in SEPARATORS:
        raise ValueError(f"unknown separator {sep!r}")
    name = encoding.lower()
    if name not in ENCODINGS:
        raise ValueError(f"unknown encoding {encoding!r}")
    df = spark.read.options(
        header=True,
        sep=sep,
        encoding=ENCODINGS[name],
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
        mode="FAILFAST",
        escape='"',
        enforceSchema=False,
        multiLine=multi_line,
    ).csv(path)
    return _windows_1252(df) if name == "cp1252" else df


def _with_nulls(df):
    return df.select(*[
        F.when(~F.col(f"`{c}`").isin(*MISSING_TEXTS), F.col(f"`{c}`")).alias(c) for c in df.columns
    ])


def _cast(df, schema):
    """Columns by position; a value that does not fit its type raises."""
    if len(df.columns) != len(schema.names):
        raise ValueError(f"{len(df.columns)} columns read, {len(schema.names)} in the schema")
    named = df.toDF(*schema.names)
    return named.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def _typed(df):
    """Whole numbers, numbers or booleans where every value is one; text otherwise.

    Columns with "date" in their name stay text for the date parser. One aggregate
    decides for all columns.
    """
    columns = [c for c in df.columns if "date" not in c.lower()]
    kinds = ("bigint", "double", "boolean")

    def misfits(c, kind):
        text = F.col(f"`{c}`")
        fits = text.try_cast(kind).isNotNull()
        if kind == "boolean":
            fits = F.lower(text).isin("true", "false")
        return F.count_if(text.isNotNull() & ~fits)

    counts = [
        misfits(c, k).alias(f"{i}_{k}") for i, c in enumerate(columns) for k in kinds
    ]
    if not counts:
        return df
    bad = df.agg(*counts).first()
    chosen = {}
    for i, c in enumerate(columns):
        for k in kinds:
            if bad[f"{i}_{k}"] == 0:
                chosen[c] = k
                break
    return df.select(*[
        F.col(f"`{c}`").cast(chosen.get(c, "string")).alias(c) for c in df.columns
    ])


def _windows_1252(df):
    """cp1252 is ISO-8859-1 but for bytes 0x80-0x9F, which Spark cannot decode itself."""
    codes = [c for c in range(0x80, 0xA0) if bytes([c]).decode("cp1252", "ignore")]
    raw = "".join(map(chr, codes))
    text = bytes(codes).decode("cp1252")
    strings = set(string_columns(df))
    return df.select(*[
        F.translate(c, raw, text).alias(c.translate(str.maketrans(raw, text)))
        if c in strings
        else F.col(f"`{c}`")
        for c in df.columns
    ])


def normalize_names(df):
    """Trimmed, lower case, spaces as underscores."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def nulls_for_nan(df):
    floats = {
        f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floats}) if floats else df


def parse_dates(df, formats=DATE_FORMATS):
    """Turn each text column with "date" in its name into a date.

    All or nothing per column: the first layout under which every value parses
    is taken; if none fits, the column stays text. One aggregate decides for all
    columns.
    """
    texts = [c for c in string_columns(df) if "date" in c.lower()]
    if not texts:
        return df
    tries = [(c, f) for c in texts for f in formats]
    bad = df.agg(*[
        F.count_if(F.col(c).isNotNull() & as_timestamp(c, f).isNull()).alias(str(i))
        for i, (c, f) in enumerate(tries)
    ]).first()
    chosen = {}
    for i, (c, f) in enumerate(tries):
        if bad[str(i)] == 0:
            chosen.setdefault(c, as_timestamp(c, f).cast("date"))
    return df.withColumns(chosen) if chosen else df


def as_timestamp(column, layout=None):
    if layout is None:
        return F.try_to_timestamp(F.col(column))
    return F.try_to_timestamp(F.col(column), F.lit(layout))


def role_columns(df):
    """Guess {role: column} from names, else from types."""
    cols, numbers = df.columns, numeric_columns(df)

    def pick(role, named, otherwise):
        if role in named:
            return role
        return (named or otherwise or [None])[0]

    date = pick("date", [c for c in cols if "date" in c.lower() or is_temporal(df, c)], cols)
    price = pick("price", [c for c in cols if "price" in c.lower()], numbers or cols)
    rest = [c for c in numbers or cols if c != price]
    lead = [c for c in cols if "lead" in c.lower() or "time" in c.lower()]
    return {"date": date, "price": price, "lead_time": pick("lead_time", lead, rest)}


def map_roles(df, date=None, price=None, lead_time=None, groups=()):
    """Cast and rename the role columns; returns (table, group columns renamed alike).

    A cast is applied only if every value survives it, decided by one aggregate.
    """
    roles = role_columns(df)
    roles.update({
        r: c
        for r, c in (("date", date), ("price", price), ("lead_time", lead_time))
        if c is not None
    })
    casts = {}
    for role, c in roles.items():
        if role == "date" and not is_temporal(df, c):
            casts[c] = as_timestamp(c).cast("date")
        elif role != "date" and not is_numeric(df, c):
            casts[c] = F.col(c).try_cast("double")
    if casts:
        lost = df.agg(*[
            F.count_if(F.col(c).isNotNull() & new.isNull()).alias(c)
            for c, new in casts.items()
        ]).first()
        df = df.withColumns({c: new for c, new in casts.items() if lost[c] == 0})
    renames = {c: role for role, c in roles.items() if c != role}
    clash = [new for new in renames.values() if new in df.columns and new not in renames]
    if clash:
        raise ValueError(f"columns already named like a role: {clash}")
    return df.withColumnsRenamed(renames), [renames.get(g, g) for g in groups]
