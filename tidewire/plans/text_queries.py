"""Queries over texts, addresses, times, chunks and model responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.functions import times as D
from tidewire.functions import urls as U
from tidewire.functions.arrays import unfold
from tidewire.operators import chunking as C
from tidewire.operators import responses as M
from tidewire.operators.registry import with_site_rule
from tidewire.params import Params
from tidewire.plans import views as V
from tidewire.plans.catalog import query
from tidewire.plans.views import edge
from tidewire.sources import pages as G

WS_SQL = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(@u, '#.*$', '', 's'),
  '^((?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?]*)?)([^?]*?)/*((?:;[^?/]*)?)(\?.*)?$', '\1\2\3\4'), '\?$', ''),
  '^(?i:https?)://', 'https://')"""
DOMAIN_SQL = r"""CASE WHEN regexp_extract(url, 'https?://([^/]+)', 1) = '' THEN url
  ELSE regexp_replace(split_part(regexp_extract(url, 'https?://([^/]+)', 1), ':', 1), '^www\.', '') END"""
EXCLUDED_SQL = "'#|javascript:|mailto:|\\.jpg|\\.png|\\.gif|\\.pdf|\\.xml|/tag/|/category/|/author/|/page/|/search|/feed'"
_STRIP = f"regexp_replace(regexp_replace(@t, '^[{WS_SQL}]+', ''), '[{WS_SQL}]+$', '')"



def normal_sql(u: str) -> str:
    return _NORMAL.replace("@u", u)


def strip_sql(t: str) -> str:
    return _STRIP.replace("@t", t)


@query("url_normalized", f"SELECT page_id, {normal_sql('url')} AS normalized FROM pages")
def url_normalized(spark, d):
    return V.read(spark, d, "pages").select("page_id", U.normalize_url(F.col("url")).alias("normalized"))


@query("url_domain_class", f"""WITH p AS (SELECT page_id, {DOMAIN_SQL} AS domain FROM
  (SELECT page_id, unnest([url, concat('http://www.finance.qq.com:8080/', page_id), concat('https://www.bbc.co.uk/', page_id)]) AS url FROM pages))
SELECT page_id, domain, CASE WHEN domain LIKE '%finance.qq.com' THEN 'domestic' WHEN domain LIKE '%bbc.co.uk' THEN 'foreign'
       ELSE 'unknown' END AS kind FROM p""")
def url_domain_class(spark, d):
    urls = F.array(F.col("url"), F.concat(F.lit("http://www.finance.qq.com:8080/"), "page_id"), F.concat(F.lit("https://www.bbc.co.uk/"), "page_id"))
    pages = V.read(spark, d, "pages").select("page_id", F.explode(urls).alias("url")).select("page_id", U.domain_of(F.col("url")).alias("domain"))
    return pages.withColumn("kind", U.domain_class(F.col("domain")))


@query("url_valid", f"""SELECT page_id, NOT regexp_matches(lower(url), {EXCLUDED_SQL})
       AND regexp_matches(lower(url), '/news|/blog|/press|/story|/article')
       AND regexp_matches(url, '^https?://') AS static_default,
       NOT regexp_matches(lower(url), {EXCLUDED_SQL}) AND contains(lower(url), '/en/')
       AND regexp_matches(regexp_extract(url, '//([^/?#]*)', 1), '(example\\.com|example\\.net)$') AS static_rule,
       NOT regexp_matches(lower(url), '/tag/|/category/|/author/|/search|/login|/register|\\.pdf|\\.jpg|\\.png|\\.gif') AS dynamic_default
FROM pages""")
def url_valid(spark, d):
    url = F.col("url")
    return V.read(spark, d, "pages").select(
        "page_id", U.valid_static(url).alias("static_default"),
        U.valid_static(url, F.array(F.lit("/en/")), None, F.array(F.lit("example.com"), F.lit("example.net"))).alias("static_rule"),
        U.valid_dynamic(url, url).alias("dynamic_default"))


@query("url_resolved", r"""WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin,
  regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '[^/]*$', '') AS folder FROM pages)
SELECT page_id, regexp_replace(concat(origin, '/a/b'), '^http://', 'https://') AS rooted,
       regexp_replace(concat(origin, folder, 'c'), '^http://', 'https://') AS relative,
       regexp_replace(concat(origin, regexp_replace(folder, '[^/]+/$', ''), 'd'), '^http://', 'https://') AS parent,
       'https://other.example/x' AS absolute, 'https://cdn.example/y' AS schemeless, CAST(NULL AS VARCHAR) AS empty FROM p""")
def url_resolved(spark, d):
    base = F.col("url")
    return V.read(spark, d, "pages").select("page_id", *[
        U.resolve_static(base, F.lit(href)).alias(name) for name, href in (
            ("rooted", "/a/b"), ("relative", "c"), ("parent", "../d"), ("absolute", "http://other.example/x/"),
            ("schemeless", "//cdn.example/y#f"), ("empty", " "))])


@query("site_rule", f"""WITH {V.REGISTRY_SQL}, k AS (SELECT *, regexp_replace(lower(regexp_extract(url, '//([^/?#]*)', 1)), '^www\\.', '') AS domain FROM registry),
r AS (SELECT *, CASE WHEN trim(coalesce(parser, '')) = 'x.ai' THEN 'x.ai' WHEN domain IN ('openai.com', 'blog.google', 'idc.com') THEN domain END AS rule_site FROM k)
SELECT source_id, domain, rule_site, CASE WHEN rule_site = 'idc.com' THEN 'rss' ELSE 'html' END AS mode,
       CASE rule_site WHEN 'openai.com' THEN 'openai.com,www.openai.com' WHEN 'blog.google' THEN 'blog.google'
            WHEN 'x.ai' THEN 'x.ai,www.x.ai' ELSE concat(domain, ',www.', domain) END AS domains FROM r""")
def site_rule(spark, d):
    return with_site_rule(V.registry(spark, d)).select(
        "source_id", "domain", "rule_site", "mode", F.array_join("allowed_domains", ",").alias("domains"))


@query("dedup_key", f"""WITH {V.BODIES_SQL} SELECT seq, md5(concat(url, '|', title, '|',
  CASE WHEN seq % 4 = 0 THEN 'None' ELSE strftime(published_at, '%Y-%m-%d %H:%M:%S') END)) AS dedup_key FROM bodies""")
def dedup_key(spark, d):
    rows = V.bodies(spark, d).withColumn("published_at", F.expr("CASE WHEN seq % 4 <> 0 THEN published_at END"))
    return rows.select("seq", U.dedup_key(F.col("canonical_url"), F.col("url"), F.col("title"), F.col("published_at")).alias("dedup_key"))


@query("text_clean", f"""SELECT doc_id, md5({strip_sql(f"regexp_replace(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), '[{WS_SQL}]*' || chr(10) || '[{WS_SQL}]*', chr(10), 'g')")}) AS cleaned_md5 FROM documents""")
def text_clean(spark, d):
    return V.read(spark, d, "documents").select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("cleaned_md5"))


PLAIN_SQL = r"""plain AS (SELECT page_id, url, html, array_to_string(list_filter(list_transform(
    string_split(regexp_replace(regexp_replace(html,
      '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!doctype[^>]*>', chr(1), 'g'),
      '</?[A-Za-z][^>]*>', chr(1), 'g'), chr(1)),
    lambda x: regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'),
      '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&amp;', '&'), '^\s+', ''), '\s+$', '')),
    lambda x: x <> ''), ' ') AS txt FROM pages)"""
ARTICLE_SQL = PLAIN_SQL.replace("FROM pages)", "FROM (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS html FROM pages))")


@query("text_plain", f"WITH {PLAIN_SQL} SELECT page_id, md5(txt) AS plain_md5, length(txt) AS chars FROM plain")
def text_plain(spark, d):
    plain = V.read(spark, d, "pages").select("page_id", T.plain_text(F.col("html")).alias("p"))
    return plain.select("page_id", F.md5("p").alias("plain_md5"), F.length("p").alias("chars"))


@query("noise_ratio", f"""WITH {PLAIN_SQL} SELECT page_id, round(greatest(0, least(1,
  (length(html) - length(txt))::DOUBLE / length(html))), 6) AS noise FROM plain""")
def noise_ratio(spark, d):
    pages = V.read(spark, d, "pages").withColumn("p", T.plain_text(F.col("html")))
    return pages.select("page_id", F.round(T.noise_ratio(F.col("p"), F.col("html")), 6).alias("noise"))


@query("previews", """SELECT doc_id, md5(CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '...') ELSE text END) AS fact_md5,
  length(CASE WHEN length(text) > 150 THEN concat(substr(text, 1, 150), '...') ELSE text END) AS opinion_chars,
  concat(CAST(doc_id % 101 AS VARCHAR), '%') AS share, printf('%.4f', doc_id / 8) AS amount FROM documents""")
def previews(spark, d):
    text = F.col("text")
    return V.read(spark, d, "documents").select(
        "doc_id", F.md5(T.preview(text, 200)).alias("fact_md5"), F.length(T.preview(text, 150)).alias("opinion_chars"),
        T.percent((F.col("doc_id") % 101) / 100).alias("share"), T.money(F.col("doc_id") / 8, 4).alias("amount"))


@query("lang_tokens", f"""WITH m AS (SELECT doc_id, text, lang, length({strip_sql('text')}) AS shown,
    len(regexp_extract_all(text, '[一-鿿]')) AS cjk, len(regexp_extract_all(text, '[^{WS_SQL}]+')) AS words,
    len(regexp_extract_all(regexp_replace(text, '[一-鿿]', '', 'g'), '[^{WS_SQL}]+')) AS other FROM (
      SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN concat(text, repeat('金融市场新闻', 10 + doc_id % 7 * 200)) ELSE text END AS text FROM documents)),
  l AS (SELECT *, CASE WHEN shown = 0 OR cjk / shown > 0.7 THEN 'zh' WHEN cjk / shown < 0.3 THEN 'en' ELSE 'mixed' END AS hint FROM m)
SELECT doc_id, hint, CAST(CASE hint WHEN 'zh' THEN length(text) WHEN 'en' THEN floor(words * 1.3::DOUBLE)
  ELSE cjk + floor(other * 1.3::DOUBLE) END AS BIGINT) AS tokens FROM l""")
def lang_tokens(spark, d):
    text = F.expr("CASE WHEN doc_id % 5 = 0 THEN concat(text, repeat('金融市场新闻', 10 + doc_id % 7 * 200)) ELSE text END")
    docs = V.read(spark, d, "documents").select("doc_id", text.alias("t")).withColumn("hint", T.detect_language(F.col("t")))
    return docs.select("doc_id", "hint", T.estimate_tokens(F.col("t"), F.col("hint")).alias("tokens"))


@query("sentence_split", f"WITH {V.SENTENCES_SQL} SELECT doc_id, idx AS at, md5(fact) AS sentence_md5 FROM sentences")
def sentence_split(spark, d):
    rows = unfold(V.read(spark, d, "documents"), ["doc_id"], T.split_semantic(F.col("text")), "at", "s")
    return rows.select("doc_id", "at", F.md5("s").alias("sentence_md5"))


NORM_FACT_SQL = f"""regexp_replace(replace(translate(regexp_replace(translate({strip_sql('x')},
   '。，！？：；“”‘’（）', '.,!?:;""''''()'), '[{WS_SQL}]+', ' ', 'g'), '一二三四五六七八九零〇', '12345678900'), '十', '10'),
   '([1-9])\\s+1(0)|(0)\\s+10', '\\1\\2\\3', 'g')"""


@query("fact_normalized", f"""WITH f AS (SELECT doc_id, concat(text, '，三 十（二〇 ', doc_id % 10, '）！') AS x FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace({NORM_FACT_SQL}, '(\\d)\\s+(\\d)', '\\1\\2', 'g'), '(\\d)\\s+(\\d)', '\\1\\2', 'g')) AS norm_md5 FROM f""")
def fact_normalized(spark, d):
    fact = F.concat("text", F.lit("，三 十（二〇 "), F.col("doc_id") % 10, F.lit("）！"))
    return V.read(spark, d, "documents").select("doc_id", F.md5(T.normalize_fact(fact)).alias("norm_md5"))


@query("edit_similarity", """SELECT p_partkey, levenshtein(p_name, lower(p_type)) AS distance,
  1.0::DOUBLE - levenshtein(p_name, lower(p_type)) / greatest(length(p_name), length(p_type))::DOUBLE > 0.25 AS similar FROM part""")
def edit_similarity(spark, d):
    a, b = F.col("p_name"), F.lower("p_type")
    return V.read(spark, d, "part").select("p_partkey", F.levenshtein(a, b).alias("distance"),
                                           T.edit_similar(a, b, above=0.25).alias("similar"))


# ---- times ----

@query("local_time", """SELECT event_id, ts + INTERVAL 8 HOUR AS local_ts, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS shown,
  CASE WHEN event_id % 7 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS plain FROM events""")
def local_time(spark, d):
    local = D.to_local(F.col("ts"), source_zone=F.lit("UTC"))
    return edge(V.read(spark, d, "events").select(
        "event_id", local.alias("local_ts"), D.format_or_empty(local).alias("shown"),
        D.format_or_empty(F.expr("CASE WHEN event_id % 7 <> 0 THEN ts END"), "yyyy-MM-dd HH:mm:ss").alias("plain")))


@query("dates_parsed", """WITH e AS (SELECT event_id, date_trunc('second', ts) AS t FROM events)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN t + INTERVAL 8 HOUR WHEN 1 THEN t WHEN 2 THEN date_trunc('day', t)
  WHEN 3 THEN t + INTERVAL 8 HOUR WHEN 4 THEN NULL ELSE t + INTERVAL 13 HOUR END AS parsed FROM e""")
def dates_parsed(spark, d):
    def shown(pattern):
        return F.date_format("ts", pattern)

    written = (F.when(F.col("event_id") % 6 == 0, F.concat(shown("E, d MMM yyyy HH:mm:ss"), F.lit(" GMT")))
               .when(F.col("event_id") % 6 == 1, shown("yyyy-MM-dd HH:mm:ss"))
               .when(F.col("event_id") % 6 == 2, shown("yyyy年M月d日"))
               .when(F.col("event_id") % 6 == 3, F.concat(shown("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
               .when(F.col("event_id") % 6 == 4, F.lit("yesterday"))
               .otherwise(F.concat(shown("EEE, d MMM yyyy HH:mm:ss"), F.lit(" -0500"))))
    return edge(V.read(spark, d, "events").select("event_id", D.parse_local(written).alias("parsed")))


@query("time_window", """SELECT event_id, CAST(ts AS TIME) BETWEEN TIME '06:05' AND TIME '06:20' AS morning,
  (CAST(ts AS TIME) >= TIME '23:00' OR CAST(ts AS TIME) <= TIME '01:00') AS overnight FROM events""")
def time_window(spark, d):
    ts = F.col("ts")
    return V.read(spark, d, "events").select("event_id", D.in_time_window(ts, "06:05", "06:20").alias("morning"),
                                             D.in_time_window(ts, "23:00", "01:00").alias("overnight"))


@query("lookback", """SELECT event_id FROM events WHERE TIMESTAMP '2024-01-15 12:00:00' - ts <= INTERVAL 24 HOUR""")
def lookback(spark, d):
    as_of = F.expr("timestamp_ntz'2024-01-15 12:00:00'")
    return V.read(spark, d, "events").where(D.within_hours(F.col("ts"), as_of)).select("event_id")


@query("day_filter", """SELECT 'on_day' AS rule, event_id FROM events WHERE ts >= DATE '2024-01-10' AND ts < DATE '2024-01-11'
UNION ALL SELECT 'week', event_id FROM events WHERE ts >= DATE '2024-01-14' AND ts < DATE '2024-01-21'
UNION ALL SELECT 'month', event_id FROM events WHERE ts >= DATE '2023-12-22' AND ts < DATE '2024-01-21'""")
def day_filter(spark, d):
    events, ts, base = V.read(spark, d, "events"), F.col("ts"), F.lit("2024-01-20").cast("date")
    parts = [events.where(D.on_day(ts, F.lit("2024-01-10"))).select(F.lit("on_day").alias("rule"), "event_id")]
    for scope in ("week", "month"):
        parts.append(events.where(D.in_scope(ts, F.lit(scope), base)).select(F.lit(scope).alias("rule"), "event_id"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- pages ----

@query("page_article", "WITH " + ARTICLE_SQL + r""", h AS (SELECT page_id, url, txt, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h FROM plain)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'),
  '^\s+', ''), '\s+$', '') AS title, url AS canonical_url FROM h WHERE length(txt) >= 100""")
def page_article(spark, d):
    pages = V.read(spark, d, "pages")
    return G.page_articles(pages).select("page_id", "title", "canonical_url")


@query("page_text")
def page_text(spark, d):
    return G.page_articles(V.read(spark, d, "pages")).select(
        "page_id", "method", F.length("content_text").alias("chars"), F.md5("content_text").alias("text_md5"))


@query("page_article_dynamic")
def page_article_dynamic(spark, d):
    rows = G.page_articles(V.read(spark, d, "pages"), dynamic=True, as_of=F.expr("timestamp_ntz'2024-01-31 06:00:00'"))
    return edge(rows.select("page_id", "title", "published_at", F.length("content_text").alias("chars")))


@query("page_links", rf"""WITH a AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin,
    unnest(h) AS href, generate_subscripts(h, 1) AS pos FROM (SELECT page_id, url,
      list_prepend('/news/top', regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)) AS h FROM pages)),
  u AS (SELECT page_id, pos, {normal_sql("concat(origin, trim(href))")} AS link FROM a WHERE trim(href) LIKE '/%'),
  v AS (SELECT page_id, link, min(pos) AS pos FROM u WHERE NOT regexp_matches(lower(link), {EXCLUDED_SQL.replace(chr(92)*2, chr(92))})
        AND regexp_matches(lower(link), '/news|/blog|/press|/story|/article') GROUP BY ALL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS at, link FROM v
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 50""")
def page_links(spark, d):
    linked = V.read(spark, d, "pages").withColumn("html", F.concat(F.lit("<div class='post-list'><h2><a href='/news/top'>t</a></h2>"), "html", F.lit("</div>")))
    return G.page_links(linked)


@query("page_links_dynamic", r"""WITH a AS (SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) AS pos FROM (
    SELECT page_id, url, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="([^"]*)"', 1) AS h FROM pages)),
  l AS (SELECT page_id, concat(regexp_extract(url, '^(https?://[^/?#]*)', 1), href) AS link, min(pos) AS pos FROM a GROUP BY ALL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS at, link FROM l
WHERE NOT regexp_matches(lower(link), '/tag/|/category/|/author/|/search|/login|/register|\.pdf|\.jpg|\.png|\.gif')
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 20""")
def page_links_dynamic(spark, d):
    return G.page_links_dynamic(V.read(spark, d, "pages"), ["nav a[href]", "li a[href]"])


@query("page_anchors", rf"""WITH a AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin,
    unnest(h) AS href, generate_subscripts(h, 1) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1) AS h FROM pages)),
  u AS (SELECT page_id, pos, {normal_sql("concat(origin, trim(href))")} AS link FROM a WHERE trim(href) LIKE '/%'),
  v AS (SELECT page_id, link, min(pos) AS pos FROM u WHERE NOT regexp_matches(lower(link), {EXCLUDED_SQL.replace(chr(92)*2, chr(92))}) GROUP BY ALL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS at, link FROM v
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 50""")
def page_anchors(spark, d):
    return G.page_anchors(V.read(spark, d, "pages"), allow=[])


# ---- chunks ----

PACK_SQL = rf"""{V.SENTENCES_SQL}, s AS (
    SELECT doc_id, list(fact ORDER BY idx) AS parts,
           list(CAST(floor(len(regexp_extract_all(fact, '[^{WS_SQL}]+')) * 1.3::DOUBLE) AS BIGINT) ORDER BY idx) AS toks
    FROM sentences GROUP BY doc_id),
  w AS (SELECT doc_id, list_reduce(list_prepend({{'s': '', 't': 0::BIGINT, 'open': '', 'n': 0::BIGINT, 'done': []::VARCHAR[]}},
      list_transform(list_zip(parts, toks), lambda z: {{'s': z[1], 't': z[2], 'open': '', 'n': 0::BIGINT, 'done': []::VARCHAR[]}})),
      lambda a, x: CASE
        WHEN x.t > @target THEN {{'s': '', 't': 0::BIGINT, 'open': '', 'n': 0::BIGINT,
          'done': list_append(CASE WHEN a.open = '' THEN a.done ELSE list_append(a.done, a.open) END, x.s)}}
        WHEN a.n + x.t > @target THEN {{'s': '', 't': 0::BIGINT, 'open': concat(a.open[-20:], x.s),
          'n': CASE WHEN a.open = '' THEN x.t ELSE CAST(floor(len(regexp_extract_all(concat(a.open[-20:], x.s), '[^{WS_SQL}]+')) * 1.3::DOUBLE) AS BIGINT) END,
          'done': CASE WHEN a.open = '' THEN a.done ELSE list_append(a.done, a.open) END}}
        ELSE {{'s': '', 't': 0::BIGINT, 'open': concat(a.open, x.s), 'n': a.n + x.t, 'done': a.done}} END) AS r FROM s),
  c AS (SELECT doc_id, CASE WHEN r.open = '' THEN r.done ELSE list_append(r.done, r.open) END AS chunks FROM w)"""
PLAN_SQL = PACK_SQL.replace("@target", "200") + rf""", e AS (
    SELECT doc_id, text, CAST(floor(len(regexp_extract_all(text, '[^{WS_SQL}]+')) * 1.3::DOUBLE) AS BIGINT) AS tokens FROM documents WHERE text <> ''),
  p AS (SELECT e.doc_id, tokens, CASE WHEN tokens <= 200 THEN [text] ELSE c.chunks END AS chunks FROM e LEFT JOIN c USING (doc_id))"""


SMALL = Params(model_limit=400, budget=0.5, overlap_chars=20, max_chunks=3)


@query("chunk_plan", f"""WITH {PLAN_SQL} SELECT doc_id AS seq, 'en' AS lang_hint, tokens, len(chunks) AS total_chunks, len(chunks) > 3 AS degraded,
  CASE WHEN len(chunks) > 3 THEN 'summary_then_extract' END AS strategy, greatest(len(chunks) - 3, 0) AS overflow,
  least(len(chunks), 3) AS kept FROM p""")
def chunk_plan(spark, d):
    planned = C.plan_chunks(V.bodies(spark, d), params=SMALL)
    return planned.select("seq", "lang_hint", "tokens", "total_chunks", "degraded", "strategy", "overflow",
                          F.size("chunks").alias("kept"))


@query("chunk_rows", f"""WITH {PLAN_SQL}, q AS (SELECT doc_id, CASE WHEN len(chunks) > 3 THEN list_append(chunks[1:2],
    concat('[全文概括]', chr(10), '前2段详细内容已处理，剩余', len(chunks) - 2, '段需要概括处理。')) ELSE chunks END AS l FROM p),
  u AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS chunk_index, unnest(l) AS chunk FROM q)
SELECT doc_id AS seq, chunk_index, length(chunk) AS chars, md5(chunk) AS chunk_md5 FROM u""")
def chunk_rows(spark, d):
    planned = C.plan_chunks(V.bodies(spark, d), params=Params(model_limit=400, budget=0.5, overlap_chars=20, max_chunks=3,
                                                              long_text_strategy="headN_plus_overall"))
    return C.chunk_rows(planned, ["seq"]).select("seq", "chunk_index", F.length("chunk").alias("chars"), F.md5("chunk").alias("chunk_md5"))


@query("deferred_chunks", f"""WITH {PLAN_SQL}
SELECT * FROM (SELECT doc_id AS seq, generate_subscripts(chunks, 1) - 1 AS chunk_index, md5(unnest(chunks)) AS chunk_md5 FROM p)
WHERE chunk_index >= 3""")
def deferred_chunks(spark, d):
    """The chunks that a degraded plan puts off; with those of the plan they are the whole text."""
    rows = C.deferred_rows(C.plan_chunks(V.bodies(spark, d), params=SMALL), ["seq"])
    return rows.select("seq", "chunk_index", F.md5("chunk").alias("chunk_md5"))


@query("chunk_pack", f"""WITH {PACK_SQL.replace("@target", "120")}
SELECT doc_id, generate_subscripts(chunks, 1) - 1 AS chunk_index, md5(unnest(chunks)) AS chunk_md5 FROM c""")
def chunk_pack(spark, d):
    packed = C.pack_sentences(T.split_semantic(F.col("text")), 120, 20, F.lit("en"))
    rows = unfold(V.read(spark, d, "documents"), ["doc_id"], packed, "chunk_index", "chunk")
    return rows.select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"))


# ---- model responses ----

@query("response_parse", f"""WITH {V.ANSWERED_SQL}
SELECT doc_id, CASE WHEN good THEN 'success' ELSE 'failed' END AS status,
       (SELECT count(*) FROM answered n WHERE n.doc_id = answers.doc_id) AS item_count,
       CASE WHEN good THEN concat('k', doc_id, ',', lang) ELSE '' END AS keywords FROM answers""")
def response_parse(spark, d):
    parsed = M.parse_responses(V.responses(spark, d))
    return parsed.select("doc_id", "status", F.size("items").alias("item_count"), F.array_join("keywords", ",").alias("keywords"))


@query("response_items", f"""WITH {V.ANSWERED_SQL}
SELECT article_id, chunk_index, i AS at, md5(fact) AS fact_md5, '金融科技' AS layer,
       round((doc_id + i) % 10 / 10::DOUBLE, 6) AS confidence FROM answered""")
def response_items(spark, d):
    return M.response_items(M.parse_responses(V.responses(spark, d))).select(
        "article_id", "chunk_index", "at", F.md5("fact").alias("fact_md5"), "layer", F.round("confidence", 6).alias("confidence"))


@query("response_keywords", f"""WITH {V.RESPONSES_SQL}
SELECT article_id, concat('k', doc_id, ',', lang) AS keywords FROM answers WHERE good AND chunk_index = 0""")
def response_keywords(spark, d):
    return M.article_keywords(M.parse_responses(V.responses(spark, d))).select(
        "article_id", F.array_join("keywords", ",").alias("keywords"))


@query("items_stored", f"""WITH {V.ANSWERED_SQL},
  f AS (SELECT article_id, fact, (doc_id + i) % 10 / 10::DOUBLE AS confidence FROM answered)
SELECT article_id, '国内' AS region, '金融科技应用' AS layer, md5(fact) AS fact_md5, round(confidence, 6) AS confidence
FROM f WHERE confidence >= 0.6 AND length(fact) >= 30""")
def items_stored(spark, d):
    from tidewire.operators.facts import drop_low_quality, to_stored_items

    items = M.response_items(M.parse_responses(V.responses(spark, d)))
    return to_stored_items(drop_low_quality(items, 0.6, 30)).select(
        "article_id", "region", "layer", F.md5("fact").alias("fact_md5"), F.round("confidence", 6).alias("confidence"))


@query("article_rollup", f"""WITH {V.RESPONSES_SQL}, r AS (
  SELECT article_id, count(*) AS total_chunks, count(*) FILTER (WHERE NOT good) AS failed_chunks,
         CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
         min(chunk_index) FILTER (WHERE good) AS f FROM answers GROUP BY article_id)
SELECT r.article_id, total_chunks, failed_chunks, r.prompt_tokens, r.completion_tokens,
       CASE WHEN failed_chunks = 0 THEN 'success' WHEN failed_chunks < total_chunks THEN 'partial' ELSE 'failed' END AS status,
       coalesce(a.provider, 'deepseek') AS provider,
       coalesce(a.model, CASE coalesce(a.provider, 'deepseek') WHEN 'qwen' THEN 'qwen-plus' ELSE 'deepseek-chat' END) AS model
FROM r LEFT JOIN answers a ON a.article_id = r.article_id AND a.chunk_index = r.f""")
def article_rollup(spark, d):
    return M.article_rollup(M.parse_responses(V.responses(spark, d)))


ATTEMPTS_SQL = r"""attempts AS (SELECT user_id * 1000 + (CAST(ts AS DATE) - DATE '2024-01-01') AS request_id, event_type = 'purchase' AS ok,
  CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) % 3 AS priority, event_id % 4 + 1 AS attempt, event_id,
  concat('p', CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) % 3) AS provider_name, concat('m', event_id % 2) AS model_name,
  concat('e', event_id) AS error FROM events)"""


@query("first_success", f"""WITH {ATTEMPTS_SQL}, t AS (SELECT * FROM attempts WHERE attempt <= 3),
w AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY priority, attempt, provider_name, model_name) AS k FROM t WHERE ok)
SELECT t.request_id, CASE WHEN any_value(w.priority) IS NULL THEN 'failed' ELSE 'success' END AS status,
       any_value(w.provider_name) AS provider_name, any_value(w.model_name) AS model_name, count(*) AS attempts
FROM t LEFT JOIN w ON w.request_id = t.request_id AND w.k = 1 GROUP BY t.request_id""")
def first_success(spark, d):
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint") % 3
    attempts = V.read(spark, d, "events").select(
        F.expr("user_id * 1000 + datediff(ts, DATE'2024-01-01')").alias("request_id"), (F.col("event_type") == "purchase").alias("ok"),
        k.alias("priority"), (F.col("event_id") % 4 + 1).alias("attempt"), F.concat(F.lit("p"), k).alias("provider_name"),
        F.concat(F.lit("m"), F.col("event_id") % 2).alias("model_name"), F.concat(F.lit("e"), "event_id").alias("error"))
    return M.first_success(attempts).drop("last_error")
