"""The operators over their whole tables, with production parameters."""

import uuid

from pyspark.sql import functions as F

from quotecast.llm import licenses, middle, warc
from quotecast.llm.audit import audit
from quotecast.llm.exact import exact_groups
from quotecast.llm.licenses import scan
from quotecast.llm.lines import RUN_WORDS, line_dedup
from quotecast.llm.lm import score
from quotecast.llm.minhash import near_groups
from quotecast.llm.mixing import mix
from quotecast.llm.packing import pieces
from quotecast.llm.quality import rate
from quotecast.llm.registry import ORACLES, QUERIES, documents, hex_lower, query
from quotecast.llm.substrings import substring_dedup
from quotecast.llm.tables import folder as shared_folder
from quotecast.llm.tables import words, written
from quotecast.llm.urls import judge, parts

__all__ = ["ORACLES", "QUERIES"]

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MEASURED_SQL = rf"""
base AS (SELECT row_number() OVER () AS r, *, {WORDS_SQL} AS ws,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
wins AS (SELECT r, i, ws[i : i + 2] AS w FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM base)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS c FROM wins) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(0, 3) t(k) GROUP BY r),
measured AS (
  SELECT doc_id, lang, source, base.r, len(ws) AS n_words,
         length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines
  FROM base LEFT JOIN cov USING (r))"""


@query("op1_line_dedup", r"""
WITH l AS (
  SELECT doc_id, i, line, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3, count(*) OVER (PARTITION BY doc_id) AS n
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT *, l3 IS NOT NULL AND row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, i) > 1 AS again FROM l),
g AS (SELECT *, coalesce(again OR lag(again, 1) OVER w OR lag(again, 2) OVER w, again) AS gone
      FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT d.doc_id, count(g.i) AS n_lines, count(g.i) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id""")
def line_runs(spark, folder):
    found = line_dedup(documents(spark, folder))
    return found.select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"),
        F.sha2(F.array_join("kept_lines", "\n").cast("binary"), 256).alias("kept_sha256"),
    )


@query("op1_line_copies", rf"""
WITH t AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
c AS (SELECT doc_id, len(ls) > 0 AND row_number() OVER (PARTITION BY ls ORDER BY doc_id) > 1 AS copy FROM t),
l AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n1 FROM (
    SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM t)),
r AS (
  SELECT *, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3, n1 + lead(n1, 1) OVER w AS n2
  FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
f AS (
  SELECT *, n1 >= {RUN_WORDS} AND row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AS one,
         coalesce(n2 >= {RUN_WORDS}, false) AND row_number() OVER (PARTITION BY line, l2 ORDER BY doc_id, i) > 1 AS two,
         l3 IS NOT NULL AND row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, i) > 1 AS three
  FROM r),
g AS (
  SELECT doc_id, i, line, copy OR one OR two OR three OR coalesce(lag(two OR three, 1) OVER w, false) OR coalesce(lag(three, 2) OVER w, false) AS gone
  FROM f JOIN c USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT d.doc_id, count(g.i) AS n_lines, count(g.i) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id""")
def line_copies(spark, folder):
    found = line_dedup(documents(spark, folder), words=RUN_WORDS, whole=True)
    return found.select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"),
        F.sha2(F.array_join("kept_lines", "\n").cast("binary"), 256).alias("kept_sha256"),
    )


@query("op2_quality", f"""
WITH {MEASURED_SQL},
rated AS (
  SELECT *, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
         CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share,
         CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS word_chars_mean,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM measured),
q AS (
  SELECT lang, source, quantile_disc(symbol_share, [0.25, 0.75]) AS a, quantile_disc(dup_line_share, [0.25, 0.75]) AS b,
         quantile_disc(repeat_share, [0.25, 0.75]) AS c, quantile_disc(word_chars_mean, [0.25, 0.75]) AS d
  FROM rated WHERE NOT base_failed GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(
         symbol_share BETWEEN a[1] - greatest(0.05, 4 * (a[2] - a[1])) AND a[2] + greatest(0.05, 4 * (a[2] - a[1]))
         AND dup_line_share BETWEEN b[1] - greatest(0.5, 4 * (b[2] - b[1])) AND b[2] + greatest(0.5, 4 * (b[2] - b[1]))
         AND repeat_share BETWEEN c[1] - greatest(0.35, 4 * (c[2] - c[1])) AND c[2] + greatest(0.35, 4 * (c[2] - c[1]))
         AND word_chars_mean BETWEEN d[1] - greatest(1.5, 4 * (d[2] - d[1])) AND d[2] + greatest(1.5, 4 * (d[2] - d[1])),
         false) AS kept
FROM rated LEFT JOIN q ON rated.lang IS NOT DISTINCT FROM q.lang AND rated.source IS NOT DISTINCT FROM q.source""")
def quality(spark, folder):
    return rate(documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op3_exact_dedup", r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents),
g AS (
  SELECT *, count(*) OVER (PARTITION BY body) AS group_size,
         first_value(doc_id) OVER w AS keep_id, first_value(r) OVER w AS keep_r
  FROM d WINDOW w AS (PARTITION BY body ORDER BY chars DESC, doc_id NULLS LAST, r))
SELECT doc_id, keep_id, group_size, r = keep_r AS kept, sha256(body) AS text_sha256 FROM g""")
def exact_dedup(spark, folder):
    return exact_groups(documents(spark, folder)).select(
        "doc_id", "keep_id", "group_size", "kept", hex_lower("sha256").alias("text_sha256")
    )


@query("op4_licenses")
def license_scan(spark, folder):
    found = scan(documents(spark, folder))
    label = F.create_map(*(F.lit(x) for item in licenses.PHRASES.items() for x in item))
    base = F.transform("base", lambda b: label[b["phrase"]])
    near = F.transform("hits", lambda h: h["label"])
    closeness = F.transform("hits", lambda h: 1 - h["edits"] / F.char_length(h["notice"]))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, near)).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(closeness), F.lit(0.0))).alias("score"),
        "hits",
    )


@query("op5_minhash", r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT r, s FROM (
    SELECT r, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
                     ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s FROM d)),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
walk AS (SELECT r AS x, r AS y FROM d UNION SELECT walk.x, links.y FROM walk JOIN links ON walk.y = links.x),
comp AS (SELECT x, min(d.doc_id) AS component_id FROM walk JOIN d ON d.r = walk.y GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d LEFT JOIN n USING (r) JOIN comp ON comp.x = d.r""")
def minhash(spark, folder):
    return near_groups(documents(spark, folder), size=2, share=80).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


@query("op6_packing")
def packing(spark, folder):
    import public_tokenizers

    packed = pieces(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


URL_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
# A host with one of these in its name gets its pages on the list of blocked URLs.
LISTED_HOSTS = "spam|pills|casino|adult|bets"


@query("op7_lm_score", rf"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
t AS (SELECT doc_id, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS p
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
x AS (
  SELECT *, count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n,
         count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS cw,
         count(*) OVER (PARTITION BY p, w) - count(*) OVER (PARTITION BY doc_id, p, w) AS cpw
  FROM t),
u AS (SELECT w AS p, count(*) AS c FROM t GROUP BY w),
o AS (SELECT doc_id, w AS p, count(*) AS c FROM t GROUP BY doc_id, w),
s AS (
  SELECT x.doc_id, CASE WHEN p IS NOT NULL AND cpw > 0 THEN cpw / (u.c - o.c)
                        ELSE (CASE WHEN p IS NULL THEN 1 ELSE 0.4 END) * greatest(cw, 1) / greatest(n, 1) END AS v
  FROM x LEFT JOIN u USING (p) LEFT JOIN o USING (doc_id, p)),
g AS (SELECT doc_id, count(*) AS n_words, avg(log10(v)) AS score FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, floor(score * 1e6 + 0.4321) / 1e6 AS score FROM documents LEFT JOIN g USING (doc_id)""")
def lm_score(spark, folder):
    return score(documents(spark, folder)).select(
        "doc_id", "n_words", (F.floor(F.col("score") * 1e6 + 0.4321) / 1e6).alias("score")
    )


@query("op8_url_filter", rf"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1), '&'),
                   lambda x: split_part(x, '=', 1) NOT IN ('', 'utm_source', 'utm_medium', 'utm_campaign', 'ref'))) AS told
  FROM (SELECT *, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages)),
c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '')
                 || CASE WHEN len(told) > 0 THEN '?' || array_to_string(told, '&') ELSE '' END END AS canon,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p),
l AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(host, '{LISTED_HOSTS}') AND canon IS NOT NULL)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       l.canon IS NOT NULL AS listed
FROM c LEFT JOIN l ON l.canon = c.canon""")
def url_filter(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    listed = pages.select("url").where(parts(F.col("url"))[0].rlike(LISTED_HOSTS))
    return judge(pages, URL_RULES, listed)


@query("op9_substrings", rf"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS s
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM w) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM f, range(0, 20) t(k)),
t AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
k AS (SELECT t.doc_id, count(*) AS n_words, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY t.i) FILTER (gone.i IS NULL) AS kept
      FROM t LEFT JOIN gone ON t.doc_id = gone.doc_id AND t.i = gone.i GROUP BY t.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""")
def substrings(spark, folder):
    return substring_dedup(documents(spark, folder)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


@query("op10_mixing", r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS draw
  FROM documents),
s AS (
  SELECT *, 3 * source_size AS lim, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
o AS (
  SELECT *, row_number() OVER w AS nth,
         sum(source_size) OVER () - sum(lim) OVER w + lim AS rest, sum(weight) OVER () - sum(weight) OVER w + weight AS weights
  FROM s WINDOW w AS (ORDER BY lim::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT * FROM o WHERE lim * weights > rest * weight ORDER BY nth LIMIT 1),
t AS (
  SELECT o.*, CASE WHEN o.nth >= f.nth THEN (f.rest * o.weight)::DOUBLE / f.weights::DOUBLE ELSE o.lim::DOUBLE END AS target
  FROM o LEFT JOIN f ON true),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM r)
SELECT doc_id, size, source_size, target, whole * size + greatest(0, least(size, budget - whole * source_size - before))::BIGINT AS taken FROM e""")
def mixing(spark, folder):
    return mix(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")


@query("op11_warc", r"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS u, coalesce(html, '') AS h, url IS NOT NULL AS told FROM pages),
q AS (
  SELECT *, first_value(r) OVER w AS best, first_value(page_id) OVER w AS best_id, strlen(h) AS bytes, sha1(h) AS x
  FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id DESC NULLS LAST, told DESC, u DESC, r))
SELECT page_id, bytes AS payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda i: translate(to_base(('0x' || x[5 * i + 1 : 5 * i + 5])::BIGINT, 32, 4),
         '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), '') AS payload_digest,
       CASE WHEN r = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r <> best THEN best_id END AS refers_to
FROM q""")
def archives(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    warc.write_archives(pages, path)
    found = warc.captures(written(warc.read_records(spark, path, payloads=("metadata",))))
    kind = pages.schema["page_id"].dataType.simpleString()
    page_id = F.from_json(F.get("metadata", F.lit(0))["payload"].cast("string"), f"id {kind}")["id"]
    told = written(found.select("record_id", page_id.alias("page_id"), "capture.type", "capture.refers_to",
                                "capture.payload_bytes", "capture.payload_digest"))
    seen = told.where("type = 'response'").select(
        F.col("record_id").alias("_id"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    again = F.col("type") == "revisit"
    return told.join(seen, F.col("refers_to") == F.col("_id"), "left").select(
        "page_id", F.when(again, F.col("_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.col("_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(again, F.col("_page")).alias("refers_to"))


@query("op12_filter_audit", rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {WORDS_SQL} AS ws FROM documents),
m AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
         + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
         + 16 * coalesce(d.doc_id > least OR (d.doc_id IS NULL AND least IS NOT NULL), false)::INT AS mask
  FROM d JOIN m USING (text) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM f GROUP BY ALL),
o AS (SELECT '' AS o UNION ALL SELECT o || x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS u(x) WHERE NOT contains(o, x)),
s AS (
  SELECT o AS filter_order, i::INT AS step, 1 << (ascii(o[i]) - 65) AS own,
         list_sum(list_transform(range(1, i + 1), lambda k: CASE WHEN k = i THEN 0 ELSE 1 << (ascii(o[k]) - 65) END))::INT AS prior
  FROM o, range(1, 6) AS t(i) WHERE length(o) = 5),
r AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN mask & (prior | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & prior = 0 AND mask & own <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & prior <> 0 AND mask & own <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & prior = 0 AND mask & own <> 0 THEN g ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & prior = 0 AND mask & own <> 0 THEN t ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r""")
def filter_audit(spark, folder):
    text = F.coalesce("text", F.lit(""))
    told = words(text)
    filters = {
        "A": F.size(told) < 200,
        "B": 100 * F.size(F.array_distinct(told)) < 50 * F.size(told),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }
    return audit(documents(spark, folder), filters, spark.read.parquet(f"{folder}/labels.parquet"))


@query("op13_fill_middle", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, list_transform([1, 9, 17, 25], lambda i: ('0x' || x[i : i + 7])::BIGINT) AS h FROM d),
c AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
              WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p""")
def fill_middle(spark, folder):
    return middle.digests(middle.fill_in_middle(documents(spark, folder)))
