"""The engine's tables as views over the provided test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.runtime import spread

LAYERS = ["金融政策监管", "金融经济", "金融大模型技术", "金融科技应用", "未知"]


_SCHEMAS: dict[str, T.StructType] = {}
TEXT_TABLES = {"documents", "pages"}   # processed by CPU-heavy steps


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Provided table; its schema is looked up once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    table = spark.read.schema(_SCHEMAS[path]).parquet(path)
    return spread(table) if name in TEXT_TABLES else table


def edge(df: DataFrame) -> DataFrame:
    """Plain timestamps and doubles at the output."""
    casts = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.TimestampNTZType):
            casts[field.name] = F.col(field.name).cast("timestamp")
        elif isinstance(field.dataType, T.DecimalType):
            casts[field.name] = F.col(field.name).cast("double")
    return df.withColumns(casts) if casts else df


# ---- articles, items, sources ----

def articles(spark, d):
    return read(spark, d, "orders").select(
        F.col("o_orderkey").alias("article_id"), F.col("o_orderdate").alias("fetched_at"),
        F.expr("o_orderdate - make_dt_interval(0, (7 * o_orderkey) % 30)").alias("published_at"),
        F.floor(F.col("o_totalprice") / 100).alias("content_len"),
        F.expr("CASE WHEN o_orderstatus = 'O' THEN 'failed' ELSE 'done' END").alias("processing_status"))


ARTICLES_SQL = """articles AS (
  SELECT o_orderkey AS article_id, o_orderdate AS fetched_at,
         o_orderdate - to_hours(CAST((7 * o_orderkey) % 30 AS INTEGER)) AS published_at,
         CAST(floor(o_totalprice / 100) AS BIGINT) AS content_len,
         CASE WHEN o_orderstatus = 'O' THEN 'failed' ELSE 'done' END AS processing_status
  FROM orders)"""


ITEM_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]


def item_texts() -> dict[str, Column]:
    """The texts of an item, all made of its `ITEM_KEYS`."""
    return {"item_id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
            "fact": F.concat_ws(" ", F.lit("Order"), "l_orderkey", F.lit("moved part"), "l_partkey",
                                F.lit("by supplier"), "l_suppkey"),
            "opinion": F.expr("CASE WHEN l_returnflag = 'R' THEN concat('returned, line ', l_linenumber) ELSE '' END")}


def item_rows(spark, d):
    """Items with their keys in place of their texts, for plans that move every row."""
    region = (read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
              .join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
              .select("s_suppkey", "r_name"))
    layer = F.element_at(F.array(*[F.lit(x) for x in LAYERS]), (F.col("l_partkey") % 5 + 1).cast("int"))
    return (read(spark, d, "lineitem").join(region, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(*ITEM_KEYS, F.col("l_orderkey").alias("article_id"), F.col("l_suppkey").alias("source_id"),
                    F.col("r_name").alias("region"), layer.alias("layer"),
                    (1 - 5 * F.col("l_discount")).alias("confidence"),
                    (1 - 5 * F.col("l_tax")).alias("finance_relevance")))


def items(spark, d):
    return item_rows(spark, d).withColumns(item_texts()).select(
        "item_id", "article_id", "source_id", "fact", "opinion", "region", "layer", "confidence", "finance_relevance")


ITEMS_SQL = """items AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS item_id,
         l_orderkey AS article_id, l_suppkey AS source_id,
         concat_ws(' ', 'Order', l_orderkey, 'moved part', l_partkey, 'by supplier', l_suppkey) AS fact,
         CASE WHEN l_returnflag = 'R' THEN concat('returned, line ', l_linenumber) ELSE '' END AS opinion,
         r_name AS region,
         ['金融政策监管', '金融经济', '金融大模型技术', '金融科技应用', '未知'][CAST(l_partkey % 5 AS INTEGER) + 1] AS layer,
         1 - 5 * l_discount AS confidence, 1 - 5 * l_tax AS finance_relevance
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def sources(spark, d):
    return read(spark, d, "supplier").select(
        F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source_name"),
        F.expr("1.0D - (s_suppkey % 4) * 0.125D").alias("weight"))


SOURCES_SQL = """sources AS (
  SELECT s_suppkey AS source_id, s_name AS source_name, 1.0::DOUBLE - (s_suppkey % 4) * 0.125::DOUBLE AS weight
  FROM supplier)"""

SCORED_SQL = f"""{ARTICLES_SQL}, {ITEMS_SQL}, {SOURCES_SQL}, scored AS (
  SELECT i.item_id, i.article_id, i.source_id, i.fact, i.opinion, i.region, i.layer, i.confidence,
         i.finance_relevance, a.fetched_at, a.published_at, a.content_len, s.source_name, s.weight AS source_weight,
         0.4::DOUBLE * i.confidence
         + 0.1::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE
             - (epoch_us(a.fetched_at + INTERVAL 6 HOUR) - epoch_us(a.published_at)) / 3600000000.0::DOUBLE / 24.0::DOUBLE)
         + 0.2::DOUBLE * least(1.0::DOUBLE, s.weight) + 0.3::DOUBLE * i.finance_relevance AS score
  FROM items i JOIN articles a USING (article_id) JOIN sources s ON i.source_id = s.source_id
  WHERE a.processing_status = 'done' AND a.content_len >= 120 AND i.confidence >= 0.6)"""


# ---- documents as article bodies ----

def bodies(spark, d):
    return read(spark, d, "documents").select(
        F.col("doc_id").alias("seq"), F.concat(F.lit("https://news.example.com/"), F.expr("doc_id DIV 2")).alias("url"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content_text"),
        F.lit(None).cast("string").alias("canonical_url"),
        F.regexp_extract("source", r"(\d+)", 1).cast("bigint").alias("source_id"), F.col("source").alias("source_name"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(doc_id % 30, doc_id % 24)").alias("published_at"))


BODIES_SQL = """bodies AS (
  SELECT doc_id AS seq, concat('https://news.example.com/', doc_id // 2) AS url, split_part(text, chr(10), 1) AS title,
         text AS content_text, CAST(NULL AS VARCHAR) AS canonical_url,
         CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) AS source_id, source AS source_name,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 30 AS INTEGER))
           + to_hours(CAST(doc_id % 24 AS INTEGER)) AS published_at
  FROM documents)"""


# ---- facts: sentences of documents, several documents to an article ----

def facts(spark, d):
    from tidewire.functions.arrays import unfold
    from tidewire.functions.text import split_semantic

    regions = F.array(F.lit("国内"), F.lit("国外"), F.lit("未知"), F.lit("国内"))
    layers = F.array(*[F.lit(x) for x in LAYERS])
    return (unfold(read(spark, d, "documents"), ["doc_id"], split_semantic(F.col("text")), "at", "fact")
            .select(F.expr("doc_id DIV 5").alias("article_id"), (F.col("doc_id") % 5).alias("chunk_index"),
                    (F.shiftleft(F.col("doc_id"), 31) + F.col("at")).alias("position"), "fact",
                    F.expr("((doc_id * 7 + at * 13) % 50 + 50) / 100.0D").alias("confidence"),
                    F.element_at(regions, ((F.col("doc_id") + F.col("at")) % 4 + 1).cast("int")).alias("region"),
                    F.element_at(layers, ((F.col("doc_id") * 3 + F.col("at")) % 5 + 1).cast("int")).alias("layer")))


SENTENCES_SQL = r"""sentences AS (
  SELECT doc_id, unnest(s) AS fact, generate_subscripts(s, 1) - 1 AS idx FROM (
    SELECT doc_id, list_filter(regexp_extract_all(text,
      '[^。！？!?.]*[。！？!?.][\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*|[^。！？!?.]+$', 0),
      lambda x: regexp_matches(x, '[^\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')) AS s
    FROM documents))"""

FACTS_SQL = f"""{SENTENCES_SQL}, facts AS (
  SELECT doc_id // 5 AS article_id, doc_id % 5 AS chunk_index, doc_id * 2147483648 + idx AS position, fact,
         ((doc_id * 7 + idx * 13) % 50 + 50) / 100.0::DOUBLE AS confidence,
         ['国内', '国外', '未知', '国内'][CAST((doc_id + idx) % 4 AS INTEGER) + 1] AS region,
         ['金融政策监管', '金融经济', '金融大模型技术', '金融科技应用', '未知'][CAST((doc_id * 3 + idx) % 5 AS INTEGER) + 1] AS layer
  FROM sentences)"""


# ---- keywords ----

def keyword_articles(spark, d):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-öø-ÿ]{4,}"), F.lit(0)))
    return read(spark, d, "documents").select(
        F.col("doc_id").alias("article_id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(doc_id % 30, doc_id % 24)").alias("published_at"),
        F.when(F.col("doc_id") % 9 != 0, words).alias("keywords"))


KEYWORDS_SQL = """keyword_articles AS (
  SELECT doc_id AS article_id, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 30 AS INTEGER))
           + to_hours(CAST(doc_id % 24 AS INTEGER)) AS published_at,
         CASE WHEN doc_id % 9 <> 0 THEN list_transform(list_filter(list_transform(w,
             lambda x, i: {'x': x, 'i': i}), lambda t: list_position(w, t.x) = t.i), lambda t: t.x) END AS keywords
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-zà-öø-ÿ]{4,}', 0) AS w FROM documents))"""


# ---- usage ----

def usage(spark, d):
    return read(spark, d, "events").select(
        F.expr("CASE event_type WHEN 'view' THEN 'deepseek' WHEN 'click' THEN 'Qwen' WHEN 'purchase' THEN 'qwen'"
               " WHEN 'signup' THEN 'other' ELSE 'DeepSeek' END").alias("provider_name"),
        F.expr("CASE user_id % 3 WHEN 0 THEN 'deepseek-chat' WHEN 1 THEN 'qwen-plus' ELSE 'qwen-max' END").alias("model_name"),
        F.col("event_id").alias("usage_id"), F.col("user_id").alias("article_id"),
        F.floor(F.col("value") * 100).alias("prompt_tokens"),
        F.regexp_extract("props", r"(\d+)", 1).cast("bigint").alias("completion_tokens"), F.col("ts").alias("created_at"))


USAGE_SQL = r"""usage AS (
  SELECT CASE event_type WHEN 'view' THEN 'deepseek' WHEN 'click' THEN 'Qwen' WHEN 'purchase' THEN 'qwen'
              WHEN 'signup' THEN 'other' ELSE 'DeepSeek' END AS provider_name,
         CASE user_id % 3 WHEN 0 THEN 'deepseek-chat' WHEN 1 THEN 'qwen-plus' ELSE 'qwen-max' END AS model_name,
         event_id AS usage_id, user_id AS article_id, CAST(floor(value * 100) AS BIGINT) AS prompt_tokens,
         CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS completion_tokens, ts AS created_at
  FROM events)"""

COSTED_SQL = USAGE_SQL + """, prices(provider, model, price_in, price_out) AS (VALUES
    ('deepseek', 'deepseek-chat', 2.0, 3.0), ('deepseek', 'deepseek-reasoner', 2.0, 3.0), ('deepseek', 'default', 2.0, 3.0),
    ('qwen', 'qwen-max', 6.0, 24.0), ('qwen', 'qwen-plus', 0.8, 2.0), ('qwen', 'qwen-turbo', 0.3, 0.6),
    ('qwen', 'default', 6.0, 24.0)),
  priced AS (
    SELECT u.*, coalesce(e.price_in, f.price_in, 1.0) AS price_in, coalesce(e.price_out, f.price_out, 2.0) AS price_out,
           CASE WHEN e.price_in IS NOT NULL THEN 'exact' WHEN f.price_in IS NOT NULL THEN 'default' ELSE 'fallback' END AS price_source
    FROM usage u LEFT JOIN prices e ON lower(u.provider_name) = e.provider AND u.model_name = e.model
    LEFT JOIN prices f ON lower(u.provider_name) = f.provider AND f.model = 'default'),
  costed AS (
    SELECT *, prompt_tokens + completion_tokens AS total_tokens,
           round_even(CAST(prompt_tokens * price_in + completion_tokens * price_out AS DECIMAL(30, 4)), 0)
             / 1000000 AS cost
    FROM priced)"""


# ---- recipients ----

def recipients(spark, d):
    base = "CASE WHEN c_custkey % 7 = 5 THEN c_custkey - 5 ELSE c_custkey END"
    return read(spark, d, "customer").select(
        F.col("c_custkey").alias("seq"),
        F.expr(f"concat('user', {base}, CASE WHEN c_custkey % 10 = 3 THEN '.' ELSE '@' END, 'n', ({base}) % 25, '.example.com')").alias("email"),
        F.expr("CASE WHEN c_custkey % 11 = 4 THEN 'whitelist' ELSE 'recipient' END").alias("type"),
        F.col("c_name").alias("display_name"), F.expr("c_acctbal > 0").alias("enabled"))


RECIPIENTS_SQL = """recipients AS (
  SELECT c_custkey AS seq, concat('user', b, CASE WHEN c_custkey % 10 = 3 THEN '.' ELSE '@' END, 'n', b % 25, '.example.com') AS email,
         CASE WHEN c_custkey % 11 = 4 THEN 'whitelist' ELSE 'recipient' END AS type, c_name AS display_name,
         c_acctbal > 0 AS enabled
  FROM (SELECT *, CASE WHEN c_custkey % 7 = 5 THEN c_custkey - 5 ELSE c_custkey END AS b FROM customer))"""


# ---- delivery results ----

ERRORS = ["550 mailbox unavailable", "User not found here", "connection timed out", "rate limited, try later",
          "Permanent failure"]


def delivery(spark, d):
    message = F.element_at(F.array(*[F.lit(e) for e in ERRORS]), (F.col("event_id") % 5 + 1).cast("int"))
    failed = F.col("event_type") == "error"
    who = F.expr("concat('user', (event_id * 7) % 1500, '@n', ((event_id * 7) % 1500) % 25, '.example.com')")
    also = F.expr("concat('user', (event_id * 11) % 1500, '@n', ((event_id * 11) % 1500) % 25, '.example.com')")
    return read(spark, d, "events").select(
        F.col("user_id").alias("report_id"), F.col("event_id").alias("batch_no"), F.array(who).alias("to"),
        F.array(also).alias("bcc"), F.concat(F.lit("m"), F.col("event_id")).alias("message_id"),
        F.when(failed, "failed").otherwise("ok").alias("status"), F.when(failed, message).alias("error"),
        F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("sent_at"), F.col("ts"))


DELIVERY_SQL = """delivery AS (
  SELECT user_id AS report_id, event_id AS batch_no,
         concat('user', (event_id * 7) % 1500, '@n', ((event_id * 7) % 1500) % 25, '.example.com') AS to_1,
         concat('user', (event_id * 11) % 1500, '@n', ((event_id * 11) % 1500) % 25, '.example.com') AS bcc_1,
         concat('m', event_id) AS message_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status,
         CASE WHEN event_type = 'error' THEN ['550 mailbox unavailable', 'User not found here', 'connection timed out',
              'rate limited, try later', 'Permanent failure'][CAST(event_id % 5 AS INTEGER) + 1] END AS error,
         CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) END AS sent, ts
  FROM events)"""


# ---- queue events ----

def queue_events(spark, d, events=None):
    return (read(spark, d, "events") if events is None else events).select(
        F.col("user_id").alias("article_id"), F.col("event_id").alias("seq"), F.col("ts"),
        F.expr("CASE event_type WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END").alias("status"),
        F.expr("CASE WHEN event_type = 'error' THEN concat('error ', event_id) END").alias("error"),
        F.expr("CASE WHEN event_type = 'view' THEN CAST(event_id % 3 AS INT) END").alias("priority"))


QUEUE_SQL = """queue_events AS (
  SELECT user_id AS article_id, event_id AS seq, ts,
         CASE event_type WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS status,
         CASE WHEN event_type = 'error' THEN concat('error ', event_id) END AS error,
         CASE WHEN event_type = 'view' THEN CAST(event_id % 3 AS INTEGER) END AS priority
  FROM events),
  marks AS (
    SELECT article_id, max(seq) AS last_seq, coalesce(max(CASE WHEN status = 'queued' THEN seq END), -1) AS reset_seq,
           max(CASE WHEN status = 'running' THEN seq END) AS run_seq,
           max(CASE WHEN status IN ('done', 'failed') THEN seq END) AS end_seq,
           count(*) FILTER (WHERE status = 'running') AS attempts,
           coalesce(max(CASE WHEN status = 'queued' THEN coalesce(priority, 0) END), 0) AS priority
    FROM queue_events GROUP BY article_id),
  queue AS (
    SELECT m.article_id, l.status, m.priority, m.attempts,
           CASE WHEN l.status = 'failed' THEN l.error END AS last_error,
           CASE WHEN m.run_seq > m.reset_seq THEN r.ts END AS started_at,
           CASE WHEN m.end_seq > m.reset_seq AND m.end_seq > coalesce(m.run_seq, -1) THEN e.ts END AS finished_at
    FROM marks m JOIN queue_events l ON l.seq = m.last_seq LEFT JOIN queue_events r ON r.seq = m.run_seq
    LEFT JOIN queue_events e ON e.seq = m.end_seq)"""


def fetches(spark, d):
    return read(spark, d, "events").select(
        F.concat(F.lit("site"), F.col("user_id") % 40, F.lit(".example.com")).alias("domain"),
        F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        (~F.col("event_type").isin("error", "signup", "view")).alias("ok"),
        (F.col("user_id") % 40 % 2 == 0).alias("default_proxy"))


# ---- model responses: documents written as JSON answers ----

def responses(spark, d):
    """One item per sentence of the text; the explodes keep text and sentences from being made again at every use."""
    from tidewire.functions.text import split_semantic

    docs = read(spark, d, "documents").withColumn(
        "_body", F.explode_outer(F.array(F.translate("text", "“”‘’`﻿\u0000", "")))).withColumn(
        "_said", F.explode_outer(F.array(split_semantic(F.col("_body")))))
    part = F.transform("_said", lambda s, i: F.struct(
        s.alias("fact"), F.lit("").alias("opinion"), F.lit("国内").alias("region"),
        F.lit("金融科技").alias("layer"), F.lit("").alias("evidence_span"),
        ((F.col("doc_id") + i) % 10 / 10).alias("confidence"), F.lit(1.0).alias("finance_relevance")))
    answer = F.to_json(F.struct(part.alias("items"), F.array(F.concat(F.lit("k"), F.col("doc_id")), F.col("lang")).alias("keywords")))
    fenced = (F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Here it is:\n```json\n"), answer, F.lit("\n```\n")))
              .when(F.col("doc_id") % 3 == 2, F.concat(F.lit("```\n"), answer, F.lit("\n```"))).otherwise(answer))
    broken = F.when(F.col("doc_id") % 17 == 0, F.substring(fenced, F.lit(1), F.length(fenced) - 12)).otherwise(fenced)
    return docs.select(
        F.expr("doc_id DIV 3").alias("article_id"), (F.col("doc_id") % 3).alias("chunk_index"), F.col("doc_id"),
        broken.alias("content"), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'deepseek' ELSE 'qwen' END").alias("provider"),
        F.expr("CASE WHEN doc_id % 4 = 0 THEN 'deepseek-chat' WHEN doc_id % 4 = 1 THEN 'qwen-max' END").alias("model"),
        F.col("n_chars").alias("prompt_tokens"), (F.col("doc_id") % 100).alias("completion_tokens"))


RESPONSES_SQL = """answers AS (
  SELECT doc_id // 3 AS article_id, doc_id % 3 AS chunk_index, doc_id, lang,
         translate(text, '“”‘’`' || chr(65279), '') AS body, doc_id % 17 <> 0 AS good,
         CASE WHEN doc_id % 2 = 0 THEN 'deepseek' ELSE 'qwen' END AS provider,
         CASE WHEN doc_id % 4 = 0 THEN 'deepseek-chat' WHEN doc_id % 4 = 1 THEN 'qwen-max' END AS model,
         n_chars AS prompt_tokens, doc_id % 100 AS completion_tokens
  FROM documents)"""

ANSWERED_SQL = RESPONSES_SQL + ", " + SENTENCES_SQL.replace("sentences AS", "said AS").replace(
    "FROM documents", "FROM (SELECT doc_id, body AS text FROM answers)") + """, answered AS (
  SELECT a.*, s.idx AS i, s.fact FROM answers a JOIN said s USING (doc_id) WHERE good)"""


# ---- source registry, settings and logs derived from suppliers, customers, events ----

def registry(spark, d):
    return read(spark, d, "supplier").select(
        F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"),
        F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'static' WHEN 2 THEN 'dynamic' ELSE 'static' END").alias("type"),
        F.expr("concat('http://', CASE s_suppkey % 5 WHEN 0 THEN 'www.openai.com' WHEN 1 THEN 'blog.google' WHEN 2 THEN 'idc.com'"
               " ELSE concat('s', s_suppkey, '.example.com') END, '/list/', s_suppkey, '/')").alias("url"),
        F.expr("s_acctbal > 1000").alias("enabled"), F.expr("CAST(s_suppkey % 70 AS INT)").alias("concurrency"),
        F.expr("CAST(s_suppkey * 7 % 400 AS INT)").alias("timeout_sec"),
        F.expr("CASE s_suppkey % 6 WHEN 0 THEN 'x.ai' WHEN 1 THEN '  ' WHEN 2 THEN '' END").alias("parser"))


REGISTRY_SQL = """registry AS (
  SELECT s_suppkey AS source_id, s_name AS name,
         CASE s_suppkey % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'static' WHEN 2 THEN 'dynamic' ELSE 'static' END AS type,
         concat('http://', CASE s_suppkey % 5 WHEN 0 THEN 'www.openai.com' WHEN 1 THEN 'blog.google' WHEN 2 THEN 'idc.com'
           ELSE concat('s', s_suppkey, '.example.com') END, '/list/', s_suppkey, '/') AS url,
         s_acctbal > 1000 AS enabled, CAST(s_suppkey % 70 AS INTEGER) AS concurrency,
         CAST(s_suppkey * 7 % 400 AS INTEGER) AS timeout_sec,
         CASE s_suppkey % 6 WHEN 0 THEN 'x.ai' WHEN 1 THEN '  ' WHEN 2 THEN '' END AS parser
  FROM supplier)"""


def audit_log(spark, d):
    return read(spark, d, "events").select(
        F.col("event_id").alias("log_id"), F.concat(F.lit("admin"), F.col("user_id") % 5).alias("admin_email"),
        F.col("event_type").alias("action"), F.col("user_id").alias("resource_id"), F.col("ts").alias("created_at"))
