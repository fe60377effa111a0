"""Quality rules whose thresholds adapt to each language and source.

DataFrame functions only.
"""

from pyspark.sql import functions as F

from quotecast.llm.tables import SPACES, words, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
ACCURACY = 10_000
# A metric's fence lies at least so far above the upper (below the lower) quartile, and
# at least so many quartile distances.
SLACK = {"symbol_share": 0.05, "dup_line_share": 0.5, "repeat_share": 0.35, "word_chars_mean": 1.5}
REACH = 4.0


def let(value, use):
    """Compute a column once and use it several times, also inside other lambdas."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(numbers):
    """Words inside 3-word windows that occur twice or more, from the word numbers of a text."""
    windows = F.transform(
        F.slice(numbers, 1, F.greatest(F.size(numbers) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(numbers, i + 1), F.get(numbers, i + 2)),
    )

    def covered(w):
        placed = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(placed, lambda s: F.transform(
            s, lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"])))
        starts = F.array_sort(F.filter(twice, lambda x: x.isNotNull()))
        gaps = let(starts, lambda p: F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))


def measures(text):
    """Struct column of a text's counts; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")
    return let(F.transform(words(text), lambda w: F.xxhash64(w)), lambda numbers: let(lines, lambda told: F.struct(
        F.size(numbers).cast("long").alias("n_words"),
        F.char_length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(told) - F.size(F.array_distinct(told))).cast("long").alias("n_dup_lines"),
        _repeat_words(numbers).alias("n_repeat_words"),
        F.size(told).cast("long").alias("n_lines"),
    )))


def _share(part, whole):
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def fences(rated, groups=("lang", "source"), reach=REACH, slack=None, accuracy=ACCURACY):
    """Per group the range that each metric may take: columns low_<metric> and high_<metric>.

    One mergeable quantile sketch per group and metric gives the quartiles of the
    rows that passed the base rules. The fence lies ``reach`` quartile distances
    outside of them, at least ``slack``. Sketches merge map-side, so a group with
    most rows moves a few numbers from each task.
    """
    slack = SLACK if slack is None else slack
    quart = [F.percentile_approx(m, [0.25, 0.75], accuracy).alias(m) for m in slack]
    sketched = rated.where("not base_failed").groupBy(*groups).agg(*quart)
    out = [F.col(g) for g in groups]
    for metric, least in slack.items():
        low, high = F.col(metric)[0], F.col(metric)[1]
        width = F.greatest(F.lit(float(least)), F.lit(float(reach)) * (high - low))
        out += [(low - width).alias(f"low_{metric}"), (high + width).alias(f"high_{metric}")]
    return sketched.select(*out)


def rate(docs, id_col="doc_id", text_col="text", lang_col="lang", source_col="source", carry=False, **options):
    """A row for each row of docs: doc_id, lang, source, the counts and shares, base_failed, kept.

    Base rules reject under ``MIN_WORDS`` words, or more than ``REPEAT_PERCENT`` percent
    of words in repeated 3-word windows. Of the rest, a row is rejected where the
    share of symbols, repeated lines or repeated words lies above its language's and
    source's fence, or the mean word length outside of it (see ``fences``). Null
    languages and sources are groups of their own; null and empty texts have no
    words and fail. Counts are those of the whole text; 3-word windows are compared
    by 64-bit hashes within one text. With ``carry`` the rows keep the input's
    columns in a struct ``_doc``. The counts are computed once, into a table.
    """
    held = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
        measures(F.col(text_col)).alias("m"), *([F.struct("*").alias("_doc")] if carry else []),
    )
    counted = written(held).select("*", "m.*").drop("m")
    rated = counted.select(
        "*",
        _share("n_symbols", "word_chars").alias("symbol_share"),
        _share("n_dup_lines", "n_lines").alias("dup_line_share"),
        _share("n_repeat_words", "n_words").alias("repeat_share"),
        _share("word_chars", "n_words").alias("word_chars_mean"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
    )
    slack = options.get("slack") or SLACK
    limits = fences(rated, **options).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = rated.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    within = F.lit(True)
    for metric in slack:
        within &= F.col(metric).between(F.col(f"low_{metric}"), F.col(f"high_{metric}"))
    return joined.select(*rated.columns, (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"))


def keep_good(docs, id_col="doc_id", text_col="text", lang_col="lang", source_col="source", **options):
    """The rows of docs that the rules keep, all columns."""
    rated = rate(docs, id_col, text_col, lang_col, source_col, carry=True, **options)
    return rated.where("kept").select("_doc.*")
