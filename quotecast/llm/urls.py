"""URL filters: host and path rules, and a list of URLs behind a blocked Bloom filter.

DataFrame functions only.
"""

import string

from pyspark.sql import functions as F

from quotecast.llm.tables import written

KEYS_PER_BLOCK = 32
WORDS = 8
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "ref")


def lower_ascii(text):
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def parts(url):
    """Columns host and path of a URL: after the first ``://`` up to ``/ ? #`` or the end,
    A-Z lower-cased, and then up to ``? #`` or the end; both empty without ``://`` or URL."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def canonical(url):
    """One spelling of a URL: no scheme, ``www.``, fragment, closing slash or tracking parameters; null without a host."""
    host, path = parts(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    told = F.filter(F.split(query, "&"), lambda p: ~F.substring_index(p, "=", 1).isin("", *TRACKING))
    query = F.when(F.size(told) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(told), "&"))).otherwise("")
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/\z", ""), query))


def ruled(host, path, rules):
    """Struct (rule, verdict) of the longest rule that fits, or null.

    ``rules`` are (verdict, host, path) and few: they become literals. A rule fits
    its host and all subdomains where the path starts with the rule's.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _spots(key):
    """Eight bit places (0 to 63) from one hash."""
    h = F.xxhash64(F.lit("bits"), key)
    return [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int") for i in range(WORDS)]


def _block(key, n_blocks):
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def bloom_blocks(listed, key, n_blocks):
    """A blocked Bloom filter as a table: per block eight 64-bit words, a bit of each for every key.

    Only filled blocks have a row. It grows with the list (``KEYS_PER_BLOCK`` keys
    to 512 bits), so it is joined by its block number, not held in the driver.
    """
    bits = [F.bit_or(F.expr(f"shiftleft(1L, s{i})")).alias(f"w{i}") for i in range(WORDS)]
    spots = listed.select(_block(F.col(key), n_blocks).alias("block"), *(s.alias(f"s{i}") for i, s in enumerate(_spots(F.col(key)))))
    return spots.groupBy("block").agg(*bits)


def judge(pages, rules, listed, id_col="page_id", url_col="url", listed_verdict="block", other_verdict="allow"):
    """A row for each row of pages: id, host, path, rule, verdict, listed.

    The longest fitting rule decides; else a URL whose canonical form is among
    ``listed`` (a DataFrame whose ``url`` column holds URLs in any spelling) gets
    ``listed_verdict``, any other ``other_verdict``. The list's blocked Bloom filter
    is joined by block number; only URLs whose eight bits are all set go on to the
    exact hash join on the canonical URL, which removes false positives. Null URLs
    and URLs without ``://`` have an empty host and path, fit no rule and are not
    listed. Repeated rows are each judged; only the url column of other columns is
    read. The keys, the filter and the tested pages are tables, so pages are parsed once,
    and the size of the filter is known when its join is planned: a small one needs no shuffle of the pages.
    """
    keys = written(listed.select(canonical(F.col("url")).alias("_listed")).where("_listed is not null").distinct())
    n_blocks = max(1, -(-keys.count() // KEYS_PER_BLOCK))
    bloom = written(bloom_blocks(keys, "_listed", n_blocks))
    host, path = parts(F.col(url_col))
    told = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"), canonical(F.col(url_col)).alias("_url"))
    told = told.select("*", ruled(F.col("host"), F.col("path"), rules).alias("_ruled"), _block(F.col("_url"), n_blocks).alias("block"),
                       F.array(*_spots(F.col("_url"))).alias("_spots"))
    tested = told.join(bloom, "block", "left")
    hit = F.coalesce(F.col("w0"), F.lit(0)) != 0
    for i in range(WORDS):
        hit &= F.getbit(F.coalesce(F.col(f"w{i}"), F.lit(0).cast("long")), F.col("_spots")[i]) == 1
    hit = F.coalesce(F.col("_url").isNotNull() & hit, F.lit(False))
    tested = written(tested.select(id_col, "host", "path", F.when(hit, F.col("_url")).alias("_url"), "_ruled", hit.alias("_hit")))
    exact = tested.where("_hit").join(keys, F.col("_url") == F.col("_listed"), "left").withColumn("listed", F.col("_listed").isNotNull())
    out = exact.drop("_listed").unionByName(tested.where("not _hit").withColumn("listed", F.lit(False)))
    verdict = F.coalesce("_ruled.verdict", F.when(F.col("listed"), listed_verdict).otherwise(other_verdict))
    return out.select(id_col, "host", "path", F.col("_ruled.rule").alias("rule"), verdict.alias("verdict"), "listed")
