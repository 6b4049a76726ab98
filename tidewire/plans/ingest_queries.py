"""Queries over feeds, registry, deduplication and article storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions.simhash import simhash64
from tidewire.operators import dedup as D
from tidewire.operators import ingest as I
from tidewire.operators import registry as R
from tidewire.operators.admin import seed_missing, upsert
from tidewire.operators.similar import near_pairs
from tidewire.plans import views as V
from tidewire.plans.catalog import query
from tidewire.plans.views import edge
from tidewire.runtime import cut, scratch_path
from tidewire.sources.feeds import feed_articles, read_rss
from tidewire.sources.registry import read_registry
from tidewire.sources.tables import append, replace_partitions

AS_OF = "timestamp_ntz'2024-01-31 06:00:00'"


def _xml(text):
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


@query("feed_items", r"""WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '/+(\?|$)', '\1'), '^http://', 'https://') AS clean FROM pages)
SELECT page_id AS source_id, concat('Page ', page_id) AS title, clean AS url, concat('Body of page ', page_id, '.') AS content_text,
  CASE page_id % 3 WHEN 0 THEN TIMESTAMP '2024-01-05 18:30:00' + to_seconds(CAST(page_id AS INTEGER))
       WHEN 1 THEN TIMESTAMP '2024-01-05 10:30:00' ELSE TIMESTAMP '2024-01-31 06:00:00' END AS published_at
FROM p WHERE page_id % 11 <> 5""")
def feed_items(spark, d):
    pages = V.read(spark, d, "pages")
    stamp = F.date_format(F.expr("timestamp'2024-01-05 10:30:00' + make_dt_interval(0, 0, 0, page_id)"), "EEE, dd MMM yyyy HH:mm:ss")
    date = (F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<pubDate>"), stamp, F.lit(" GMT</pubDate>")))
            .when(F.col("page_id") % 3 == 1, F.lit("<pubDate>2024-01-05 10:30:00</pubDate>")).otherwise(""))
    title = F.when(F.col("page_id") % 11 == 5, "").otherwise(F.concat(F.lit("<title> Page "), "page_id", F.lit(" </title>")))
    body = F.concat(F.lit("&lt;p&gt;Body of &lt;b&gt;page&lt;/b&gt; "), "page_id", F.lit(".&lt;/p&gt;"))
    item = F.concat(F.lit("<item>"), title, F.lit("<link>"), _xml(F.col("url")), F.lit("</link>"), date,
                    F.lit("<description>"), body, F.lit("</description><source_id>"), "page_id", F.lit("</source_id></item>"))
    folder = scratch_path(spark, "feeds")
    # documents of at most 50 entries, one file each
    feeds = pages.select(F.expr("page_id DIV 50").alias("feed"), item.alias("item")).groupBy("feed").agg(F.concat(
        F.lit("<rss><channel>"), F.array_join(F.collect_list("item"), ""), F.lit("</channel></rss>")).alias("value"))
    feeds.write.partitionBy("feed").text(folder)
    return edge(feed_articles(read_rss(spark, folder), F.expr(AS_OF)).drop("source_name"))


@query("registry_load", f"""WITH {V.REGISTRY_SQL} SELECT name, type, trim(url) AS url, enabled, greatest(1, concurrency) AS concurrency,
  timeout_sec FROM registry""")
def registry_load(spark, d):
    rows = V.registry(spark, d).withColumn("concurrency", F.greatest("concurrency", F.lit(1)))
    folder = scratch_path(spark, "registry")
    # one document per source keeps the writer parallel
    rows.select(F.array(F.struct("name", "type", "url", "enabled", "concurrency", "timeout_sec", "parser")).alias("sources"),
                F.array(F.concat("name", F.lit("@Example.com"))).alias("recipients")).write.json(folder)
    sources, _ = read_registry(spark, folder, multi_line=False)
    return sources.select("name", "type", "url", "enabled", "concurrency", "timeout_sec")


@query("registry_route", f"""WITH {V.REGISTRY_SQL} SELECT source_id, type, CASE WHEN type IN ('rss', 'static') THEN 'scheduled' ELSE 'rejected' END AS route
FROM registry WHERE enabled""")
def registry_route(spark, d):
    good, rest = R.route_sources(V.registry(spark, d))
    return (good.select("source_id", "type", F.lit("scheduled").alias("route"))
            .unionByName(rest.select("source_id", "type", F.lit("rejected").alias("route"))))


@query("source_lookup", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey = 7")
def source_lookup(spark, d):
    return R.lookup(V.read(spark, d, "supplier"), "s_suppkey", 7).select("s_suppkey", "s_name")


@query("seed_counts", f"""WITH {V.RECIPIENTS_SQL}, have AS (SELECT DISTINCT lower(trim(email)) AS email FROM recipients WHERE seq % 2 = 0)
SELECT count(DISTINCT email) FILTER (WHERE email NOT IN (SELECT email FROM have)) AS inserted,
       count(*) - count(DISTINCT email) FILTER (WHERE email NOT IN (SELECT email FROM have)) AS skipped FROM recipients""")
def seed_counts(spark, d):
    people = V.recipients(spark, d).withColumn("email", F.lower(F.trim("email")))
    stored = people.where("seq % 2 = 0").select("email").distinct()
    return seed_missing(stored, people, "email", "seq")[1]


# ---- deduplication ----

@query("dedup_url", f"""WITH {V.BODIES_SQL} SELECT min(seq) AS seq, url FROM bodies
WHERE url NOT IN (SELECT url FROM bodies WHERE seq % 20 = 0) GROUP BY url""")
def dedup_url(spark, d):
    items = V.bodies(spark, d)
    known = items.where("seq % 20 = 0").select("url").distinct()
    return D.dedup_by_url(items, "seq", known).select("seq", "url")


GRAMS_SQL = r"""w AS (SELECT doc_id, coalesce(array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+'), ''), '') AS b FROM documents WHERE text <> ''),
  g AS (SELECT doc_id, substr(b, i, 4) AS gram, count(*) AS n FROM (SELECT doc_id, b, unnest(range(1, greatest(length(b) - 3, 1) + 1)) AS i FROM w) GROUP BY ALL),
  u AS (SELECT gram, substr(md5(gram), 17, 16) AS h FROM (SELECT DISTINCT gram FROM g)),
  ub AS (SELECT gram, CAST(concat('0x', substr(h, 1, 8)) AS UBIGINT) AS hi, CAST(concat('0x', substr(h, 9, 8)) AS UBIGINT) AS lo FROM u),
  votes AS (SELECT doc_id, k, sum(CASE WHEN ((CASE WHEN k >= 32 THEN hi ELSE lo END) >> CAST(k % 32 AS UBIGINT)) & 1 = 1 THEN n ELSE -n END) AS v
            FROM g JOIN ub USING (gram), range(0, 64) r(k) GROUP BY ALL),
  hashes AS (SELECT doc_id, CAST(sum(CASE WHEN v > 0 THEN CASE WHEN k = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << CAST(k AS HUGEINT)) END ELSE 0 END) AS BIGINT) AS simhash
             FROM votes GROUP BY doc_id)"""


REFERENCES_SQL = GRAMS_SQL + """, refs AS (SELECT d.doc_id, CASE WHEN d.doc_id % 3 <> 0 THEN concat('https://news.example.com/', d.doc_id // 2) END AS url,
  CASE WHEN d.doc_id % 2 = 0 THEN h.simhash END AS simhash FROM documents d LEFT JOIN hashes h USING (doc_id))"""


def _references(spark, d):
    """Stored articles of which some have no address and some no hash yet.

    Only bodies that have a hash go to the worker; no filter on the hash moves below the explode, where it would
    hash every body once more, in a second worker.
    """
    has = (F.col("doc_id") % 2 == 0) & (F.col("text") != "")
    hashed = V.read(spark, d, "documents").select("doc_id", has.alias("_has"), simhash64(F.when(has, F.col("text"))).alias("_h"))
    return hashed.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.concat(
        F.lit("https://news.example.com/"), F.expr("doc_id DIV 2"))).alias("url"),
        F.explode_outer(F.array(F.when(F.col("_has"), F.col("_h")))).alias("simhash"))


@query("known_references", f"WITH {REFERENCES_SQL} SELECT doc_id, url, simhash FROM refs WHERE url IS NOT NULL OR simhash IS NOT NULL")
def known_references(spark, d):
    return D.known_references(_references(spark, d), ["doc_id"])


@query("known_matches", f"""WITH {REFERENCES_SQL}, fresh AS (SELECT doc_id AS seq, concat('https://news.example.com/', doc_id * 3) AS url, simhash
  FROM documents JOIN hashes USING (doc_id))
SELECT f.seq, EXISTS (SELECT 1 FROM refs r WHERE r.url = f.url) AS url_known, EXISTS (SELECT 1 FROM refs r WHERE r.simhash = f.simhash) AS body_known FROM fresh f""")
def known_matches(spark, d):
    """Which fresh rows the store has already, by address or by body."""
    fresh = cut(V.read(spark, d, "documents").where("text <> ''").select(
        F.col("doc_id").alias("seq"), F.concat(F.lit("https://news.example.com/"), F.col("doc_id") * 3).alias("url"),
        simhash64(F.col("text")).alias("simhash")))
    known = cut(D.known_references(_references(spark, d), fresh=fresh))
    flag = lambda c: known.where(F.col(c).isNotNull()).select(c).distinct().withColumn(f"_{c}", F.lit(True))     # noqa: E731
    return fresh.join(flag("url"), "url", "left").join(flag("simhash"), "simhash", "left").select(
        "seq", F.coalesce("_url", F.lit(False)).alias("url_known"), F.coalesce("_simhash", F.lit(False)).alias("body_known"))


@query("simhash_docs", f"WITH {GRAMS_SQL} SELECT doc_id, simhash FROM hashes")
def simhash_docs(spark, d):
    docs = V.read(spark, d, "documents").where("text <> ''")
    return docs.select("doc_id", simhash64(F.col("text")).alias("simhash"))


PAIRS_SQL = GRAMS_SQL + """, nodes AS (SELECT simhash, min(doc_id) AS seq FROM hashes WHERE simhash <> 0 GROUP BY simhash),
  pairs AS (SELECT a.seq AS a, b.seq AS b FROM nodes a JOIN nodes b ON a.seq < b.seq AND bit_count(xor(a.simhash, b.simhash)) <= 3)"""


@query("near_dup_pairs", f"WITH {PAIRS_SQL} SELECT a, b FROM pairs")
def near_dup_pairs(spark, d):
    hashes = D.body_hashes(V.bodies(spark, d), "seq", "content_text")
    nodes = cut(D.hash_nodes(hashes))
    return near_pairs(nodes, "simhash", "_order").select("a", "b")


# lexicographically first kept set, found by walking the nodes in order
GREEDY_SQL = """, ordered AS (SELECT seq, row_number() OVER (ORDER BY seq) AS pos FROM nodes),
  linked AS (SELECT o.seq, o.pos, list(p.a) AS before FROM ordered o LEFT JOIN pairs p ON p.b = o.seq GROUP BY ALL),
  listed AS (SELECT list({'s': seq, 'b': before} ORDER BY pos) AS l FROM linked WHERE len(list_filter(before, lambda x: x IS NOT NULL)) > 0
             OR seq IN (SELECT a FROM pairs)),
  walked AS (SELECT list_reduce(list_prepend({'s': 0::BIGINT, 'b': []::BIGINT[], 'kept': []::BIGINT[], 'lost': []::BIGINT[]},
      list_transform(l, lambda n: {'s': n.s, 'b': n.b, 'kept': []::BIGINT[], 'lost': []::BIGINT[]})),
      lambda acc, n: CASE WHEN list_has_any(acc.kept, n.b) THEN {'s': 0::BIGINT, 'b': []::BIGINT[], 'kept': acc.kept, 'lost': list_append(acc.lost, n.s)}
                          ELSE {'s': 0::BIGINT, 'b': []::BIGINT[], 'kept': list_append(acc.kept, n.s), 'lost': acc.lost} END) AS r FROM listed),
  kept AS (SELECT seq FROM nodes WHERE seq NOT IN (SELECT unnest(r.lost) FROM walked)
           UNION ALL SELECT doc_id FROM hashes WHERE simhash = 0)"""


@query("dedup_body", f"WITH {PAIRS_SQL}{GREEDY_SQL} SELECT seq FROM kept")
def dedup_body(spark, d):
    return D.dedup_by_body(V.bodies(spark, d), "seq").select("seq")


FULL_SQL = GRAMS_SQL + f""", {V.BODIES_SQL}, fresh AS (SELECT url, min(seq) AS seq FROM bodies WHERE seq % 50 <> 0
    AND url NOT IN (SELECT url FROM bodies WHERE seq % 20 = 0) GROUP BY url),
  old AS (SELECT DISTINCT simhash FROM hashes WHERE doc_id % 50 = 0 AND simhash <> 0),
  every AS (SELECT simhash, min(doc_id) AS seq FROM hashes JOIN fresh ON fresh.seq = doc_id WHERE simhash <> 0
    AND simhash NOT IN (SELECT simhash FROM old) GROUP BY simhash),
  nodes AS (SELECT * FROM every WHERE NOT EXISTS (SELECT 1 FROM old WHERE bit_count(xor(old.simhash, every.simhash)) <= 3)),
  pairs AS (SELECT a.seq AS a, b.seq AS b FROM nodes a JOIN nodes b ON a.seq < b.seq AND bit_count(xor(a.simhash, b.simhash)) <= 3)""" + GREEDY_SQL


@query("dedup_full", f"""WITH {FULL_SQL} SELECT b.seq, b.url, h.simhash,
  md5(concat(b.url, '|', b.title, '|', strftime(b.published_at, '%Y-%m-%d %H:%M:%S'))) AS dedup_key
FROM kept JOIN bodies b USING (seq) JOIN hashes h ON h.doc_id = b.seq""")
def dedup_full(spark, d):
    items = V.bodies(spark, d)
    known = D.body_hashes(items.where("seq % 50 = 0"), "seq", "content_text").select("simhash")
    urls = items.where("seq % 20 = 0").select("url").distinct()
    return D.dedup(items.where("seq % 50 <> 0"), "seq", urls, known).select("seq", "url", "simhash", "dedup_key")


# ---- storage ----

@query("article_store", f"""WITH {V.BODIES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS r FROM bodies)
SELECT seq, source_id, substr(regexp_replace(regexp_replace(title, '^\\s+', ''), '\\s+$', ''), 1, 500) AS title, url, published_at, length(content_text) AS content_len, url AS canonical_url,
       'raw' AS processing_status FROM n WHERE r = 1 AND url NOT IN (SELECT url FROM bodies WHERE seq % 20 = 0)""")
def article_store(spark, d):
    items = V.bodies(spark, d)
    stored = items.where("seq % 20 = 0").select("url").distinct()
    return edge(I.new_articles(items, stored, "seq").drop("content_text"))


@query("article_enqueue", """SELECT DISTINCT (doc_id // 2) * 2 AS article_id, 'queued' AS status, 0 AS priority, 0 AS attempts FROM documents""")
def article_enqueue(spark, d):
    items = V.bodies(spark, d)
    fresh = I.new_articles(items, items.limit(0), "seq")
    return I.queue_rows(fresh, "seq")


@query("content_gate", r"""SELECT doc_id AS seq, CASE WHEN length(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) >= 120 THEN 'ok' ELSE 'content_too_short' END AS reason FROM documents""")
def content_gate(spark, d):
    good, short = I.content_gate(V.bodies(spark, d))
    return good.select("seq", F.lit("ok").alias("reason")).unionByName(short.select("seq", "reason"))


@query("items_normalized", """SELECT doc_id AS seq, 'kept' AS side, CASE WHEN doc_id % 4 = 0 THEN concat('name ', regexp_extract(source, '(\\d+)', 1)) ELSE source END AS source_name,
  concat('https://news.example.com/', doc_id // 2) AS canonical_url FROM documents WHERE doc_id % 13 <> 0
UNION ALL SELECT doc_id, 'aside', NULL, NULL FROM documents WHERE doc_id % 13 = 0""")
def items_normalized(spark, d):
    items = V.bodies(spark, d)
    raw = items.select("seq", "source_id", F.expr("CASE WHEN seq % 4 <> 0 THEN source_name END").alias("source_name"), "canonical_url",
                       *[F.expr(f"CASE WHEN seq % 13 <> 0 THEN {c} END").alias(c) for c in ("url", "title", "content_text")])
    names = items.select("source_id").distinct().select("source_id", F.concat(F.lit("name "), "source_id").alias("source_name"))
    good, aside = I.normalize_items(raw, names)
    none = F.lit(None).cast("string")
    return good.select("seq", F.lit("kept").alias("side"), "source_name", "canonical_url").unionByName(
        aside.select("seq", F.lit("aside").alias("side"), none.alias("source_name"), none.alias("canonical_url")))


@query("crawl_funnel", f"""WITH {V.BODIES_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) = 1 AS first_url FROM bodies)
SELECT source_id, count(*) AS fetched, count(*) FILTER (WHERE content_text <> '') AS after_normalize,
  count(*) FILTER (WHERE content_text <> '' AND first_url) AS after_dedup,
  count(*) FILTER (WHERE content_text <> '' AND first_url AND length(content_text) >= 120) AS saved FROM f GROUP BY source_id""")
def crawl_funnel(spark, d):
    items = V.bodies(spark, d)
    firsts = items.groupBy("url").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("_first"))
    flagged = items.select("seq", "source_id", F.length("content_text").alias("chars")).join(firsts, "seq", "left")
    body, first = F.col("chars") > 0, F.coalesce("_first", F.lit(False))
    return I.crawl_funnel(flagged, {"after_normalize": body, "after_dedup": body & first, "saved": body & first & (F.col("chars") >= 120)})


@query("recent_items", f"""WITH {V.BODIES_SQL} SELECT seq, published_at FROM bodies WHERE published_at >= TIMESTAMP '2024-01-20 12:00:00'""")
def recent_items(spark, d):
    return edge(I.recent_items(V.bodies(spark, d), F.expr(AS_OF), since=F.expr("timestamp_ntz'2024-01-20 12:00:00'")).select("seq", "published_at"))


# ---- writes ----

@query("report_upsert", """WITH o AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS report_date, count(*) AS n FROM orders GROUP BY 1)
SELECT report_date, CASE WHEN report_date >= DATE '1998-01-01' THEN 2 ELSE 1 END AS version, n FROM o""")
def report_upsert(spark, d):
    months = V.read(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("report_date")).agg(F.count("*").alias("n"))
    path = scratch_path(spark, "reports")
    replace_partitions(months.withColumn("version", F.lit(1)), path, ["report_date"])
    replace_partitions(months.where("report_date >= DATE'1998-01-01'").withColumn("version", F.lit(2)), path, ["report_date"])
    return spark.read.schema("n BIGINT, version INT, report_date DATE").parquet(path)


@query("usage_append", f"""WITH {V.COSTED_SQL} SELECT provider_name, count(*) AS calls, round(sum(cost), 6)::DOUBLE AS cost FROM costed GROUP BY 1""")
def usage_append(spark, d):
    from tidewire.operators.usage import with_cost

    rows = with_cost(V.usage(spark, d)).select("usage_id", "provider_name", "model_name", "total_tokens", "cost", "created_at")
    path = scratch_path(spark, "usage")
    append(rows.where("usage_id % 2 = 0"), path)
    append(rows.where("usage_id % 2 = 1"), path)
    stored = spark.read.parquet(path)
    return edge(stored.groupBy("provider_name").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost")))


@query("history_union", f"""WITH {V.BODIES_SQL} SELECT url, count(*) AS n FROM (
  SELECT url FROM bodies WHERE seq % 2 = 0 UNION SELECT url FROM bodies WHERE seq % 3 = 0) GROUP BY url""")
def history_union(spark, d):
    items = V.bodies(spark, d)
    merged = upsert(items.where("seq % 2 = 0").select("url").distinct(), items.where("seq % 3 = 0").select("url").distinct(), "url")
    return merged.groupBy("url").agg(F.count("*").alias("n"))
