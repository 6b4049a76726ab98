"""Queries over settings, preferences, rules, logs, queue and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import admin as A
from tidewire.operators import queue as Q
from tidewire.operators import routes as R
from tidewire.operators import rules as L
from tidewire.operators.delivery import latest
from tidewire.plans import views as V
from tidewire.plans.catalog import query
from tidewire.plans.daily import daily_run as run_daily
from tidewire.plans.daily import run_stored
from tidewire.plans.ingest_queries import GRAMS_SQL, GREEDY_SQL
from tidewire.plans.views import edge
from tidewire.runtime import scratch_path
from tidewire.sources.tables import drop_before, write_months
from tidewire.streaming import jobs as S

AS_OF = "timestamp_ntz'2024-01-31 00:00:00'"


# ---- queue ----

@query("queue_state", f"WITH {V.QUEUE_SQL} SELECT article_id, status, priority, attempts, last_error, started_at, finished_at FROM queue")
def queue_state(spark, d):
    return edge(Q.queue_state(V.queue_events(spark, d)))


@query("queue_select", f"""WITH {V.QUEUE_SQL} SELECT article_id, status, priority FROM queue WHERE status = 'queued'
  AND article_id IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1995-01-01')""")
def queue_select(spark, d):
    queue = Q.queue_state(V.queue_events(spark, d))
    made = V.read(spark, d, "orders").where("o_orderdate >= DATE'1995-01-01'").select(F.col("o_orderkey").alias("article_id"))
    return Q.select_queued(queue.join(made, "article_id", "left_semi")).select("article_id", "status", "priority")


@query("queue_select_day", f"""WITH {V.QUEUE_SQL}, c AS (SELECT article_id, min(ts) AS created_at FROM queue_events GROUP BY 1)
SELECT article_id, priority FROM queue JOIN c USING (article_id) WHERE status = 'queued' AND created_at >= DATE '2024-01-01' AND created_at < DATE '2024-01-02'""")
def queue_select_day(spark, d):
    events = V.queue_events(spark, d)
    created = events.groupBy("article_id").agg(F.min("ts").alias("created_at"))
    return Q.select_queued(Q.queue_state(events), created, F.lit("2024-01-01")).select("article_id", "priority")


@query("failed_of_day", f"""WITH {V.ARTICLES_SQL} SELECT article_id, 'queued' AS status FROM articles WHERE processing_status = 'failed'
  AND ((published_at >= DATE '1996-06-01' AND published_at < DATE '1996-06-02') OR (fetched_at >= DATE '1996-06-01' AND fetched_at < DATE '1996-06-02'))""")
def failed_of_day(spark, d):
    rows = V.articles(spark, d).withColumnRenamed("processing_status", "status")
    return Q.retried(Q.failed_on(rows, F.lit("1996-06-01"))).select("article_id", "status")


@query("queue_retried", f"""WITH {V.QUEUE_SQL} SELECT coalesce(q.article_id, w.id) AS article_id, CASE WHEN w.id IS NOT NULL THEN 'queued' ELSE q.status END AS status,
  coalesce(q.priority, 100) AS priority, coalesce(q.attempts, 0) AS attempts, CASE WHEN w.id IS NULL THEN q.last_error END AS last_error
FROM queue q FULL JOIN (SELECT s_suppkey * 3 AS id FROM supplier) w ON w.id = q.article_id""")
def queue_retried(spark, d):
    wanted = V.read(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("article_id"))
    return Q.retry_articles(Q.queue_state(V.queue_events(spark, d)), wanted).select(
        "article_id", "status", "priority", "attempts", "last_error")


@query("queue_health", f"""WITH {V.QUEUE_SQL} SELECT count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'running') AS running,
  count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE started_at >= TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR) AS last_day,
  round(count(*) FILTER (WHERE status = 'failed') / count(*) FILTER (WHERE status IN ('done', 'failed')), 6) AS failure_rate,
  round(avg(CASE WHEN status IN ('done', 'failed') THEN epoch_us(finished_at) - epoch_us(started_at) END) / 1e6, 3) AS mean_seconds FROM queue""")
def queue_health(spark, d):
    health = Q.queue_health(Q.queue_state(V.queue_events(spark, d)), F.expr(AS_OF))
    return health.withColumn("failure_rate", F.round("failure_rate", 6)).withColumn("mean_seconds", F.round("mean_seconds", 3))


@query("queue_done_today", f"""WITH {V.QUEUE_SQL} SELECT count(*) AS done FROM queue WHERE status = 'done' AND finished_at >= DATE '2024-01-30' AND finished_at < DATE '2024-01-31'""")
def queue_done_today(spark, d):
    return Q.done_on(Q.queue_state(V.queue_events(spark, d)), F.lit("2024-01-30"))


# ---- fetch routes ----

ROUTES_SQL = """fetches AS (SELECT concat('site', user_id % 40, '.example.com') AS domain, event_id AS seq, epoch_us(ts) AS ts_us,
    event_type NOT IN ('error', 'signup', 'view') AS ok, user_id % 40 % 2 = 0 AS dflt FROM events),
  grouped AS (SELECT domain, any_value(dflt) AS dflt, list({'seq': seq, 'at': ts_us, 'ok': ok} ORDER BY seq) AS l FROM fetches GROUP BY domain),
  walked AS (SELECT domain, list_reduce(list_prepend(
      {'x': {'seq': 0::BIGINT, 'at': 0::BIGINT, 'ok': true}, 'n': 0::BIGINT, 'route': false, 'held': false, 'since': -9000000000000000::BIGINT,
       'all': []::STRUCT(seq BIGINT, p BOOLEAN, f BIGINT, s BOOLEAN)[]},
      list_transform(l, lambda e: {'x': e, 'n': 0::BIGINT, 'route': false, 'held': false, 'since': 0::BIGINT,
       'all': []::STRUCT(seq BIGINT, p BOOLEAN, f BIGINT, s BOOLEAN)[]})),
      lambda a, y: CASE
        WHEN y.x.ok THEN {'x': y.x, 'n': 0::BIGINT, 'route': a.route, 'held': a.held, 'since': a.since, 'all': list_append(a.all,
          {'seq': y.x.seq, 'p': CASE WHEN y.x.at - a.since < 3600000000 THEN a.held ELSE dflt END, 'f': 0::BIGINT, 's': false})}
        WHEN (CASE WHEN a.n > 0 AND a.route = (CASE WHEN y.x.at - a.since < 3600000000 THEN a.held ELSE dflt END) THEN a.n + 1 ELSE 1 END) >= 3
        THEN {'x': y.x, 'n': 0::BIGINT, 'route': a.route, 'held': NOT (CASE WHEN y.x.at - a.since < 3600000000 THEN a.held ELSE dflt END),
          'since': y.x.at, 'all': list_append(a.all, {'seq': y.x.seq,
            'p': CASE WHEN y.x.at - a.since < 3600000000 THEN a.held ELSE dflt END, 'f': 3::BIGINT, 's': true})}
        ELSE {'x': y.x, 'n': CASE WHEN a.n > 0 AND a.route = (CASE WHEN y.x.at - a.since < 3600000000 THEN a.held ELSE dflt END) THEN a.n + 1 ELSE 1 END,
          'route': CASE WHEN y.x.at - a.since < 3600000000 THEN a.held ELSE dflt END, 'held': a.held, 'since': a.since,
          'all': list_append(a.all, {'seq': y.x.seq, 'p': CASE WHEN y.x.at - a.since < 3600000000 THEN a.held ELSE dflt END,
            'f': CASE WHEN a.n > 0 AND a.route = (CASE WHEN y.x.at - a.since < 3600000000 THEN a.held ELSE dflt END) THEN a.n + 1 ELSE 1 END, 's': false})} END).all AS r FROM grouped),
  routes AS (SELECT domain, unnest(r) AS e FROM walked)"""


@query("route_switches", f"""WITH {ROUTES_SQL} SELECT domain, e.seq AS seq, f.ts_us, e.p AS via_proxy, e.f AS failures, e.s AS switched
FROM routes JOIN fetches f USING (domain) WHERE f.seq = e.seq""")
def route_switches(spark, d):
    return R.route_switches(V.fetches(spark, d))


@query("route_stats", f"""WITH {ROUTES_SQL} SELECT domain, count(*) AS fetches, count(*) FILTER (WHERE e.s) AS switches,
  max_by(CASE WHEN e.s THEN 0 ELSE e.f END, e.seq) AS open_failures FROM routes GROUP BY domain""")
def route_stats(spark, d):
    return R.route_stats(R.route_switches(V.fetches(spark, d)))


@query("domain_failures", """WITH f AS (SELECT concat('site', user_id % 40, '.example.com') AS domain, event_id, event_type NOT IN ('error', 'signup', 'view') AS ok FROM events),
  l AS (SELECT domain, max(event_id) FILTER (WHERE ok) AS last_ok FROM f GROUP BY 1)
SELECT domain, count(*) AS fetches, count(*) FILTER (WHERE NOT ok) AS failures,
       count(*) FILTER (WHERE NOT ok AND event_id > coalesce(last_ok, -1)) AS since_success FROM f JOIN l USING (domain) GROUP BY domain""")
def domain_failures(spark, d):
    fetches = V.fetches(spark, d)
    last = fetches.groupBy("domain").agg(F.max(F.when(F.col("ok"), F.col("seq"))).alias("last_ok"))
    return fetches.join(last, "domain").groupBy("domain").agg(
        F.count("*").alias("fetches"), F.count_if(~F.col("ok")).alias("failures"),
        F.count_if(~F.col("ok") & (F.col("seq") > F.coalesce("last_ok", F.lit(-1)))).alias("since_success"))


# ---- streams ----

def _event_stream(spark, d):
    return S.landed(spark, d, "events.parquet", V.read(spark, d, "events").schema)


@query("stream_dedup", "SELECT min(event_id) AS event_id, concat('https://e.example.com/', event_id // 2) AS url FROM events GROUP BY 2")
def stream_dedup(spark, d):
    stream = _event_stream(spark, d).select("event_id", F.concat(F.lit("https://e.example.com/"), F.expr("event_id DIV 2")).alias("url"))
    target = S.run_available(stream, "stream-dedup", for_each=lambda path: S.append_unseen(path, "url", "event_id"))
    return spark.read.parquet(target).select("event_id", "url")


@query("stream_dedup_watermark", "SELECT count(*) AS urls FROM (SELECT DISTINCT event_id // 2 FROM events)")
def stream_dedup_watermark(spark, d):
    stream = _event_stream(spark, d).select("ts", F.concat(F.lit("https://e.example.com/"), F.expr("event_id DIV 2")).alias("url"))
    target = S.run_available(S.first_seen(stream.withColumn("ts", F.col("ts").cast("timestamp")), ["url"], "ts"), "stream-seen")
    return spark.read.parquet(target).agg(F.count("*").alias("urls"))


@query("stream_lookback", """SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-29 00:00:00'""")
def stream_lookback(spark, d):
    stream = _event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts")
    target = S.run_available(S.recent(stream, "ts", F.expr("timestamp'2024-01-30 00:00:00'")), "stream-lookback")
    return spark.read.parquet(target)


@query("stream_late_rows", """SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN event_id % 50 = 0 THEN 'no_time'
    WHEN ts >= TIMESTAMP '2024-01-29 00:00:00' THEN 'kept' ELSE 'too_old' END AS outcome FROM events) GROUP BY outcome
UNION ALL SELECT 'stored', count(*) FROM events WHERE event_id % 50 <> 0 AND ts >= TIMESTAMP '2024-01-29 00:00:00'""")
def stream_late_rows(spark, d):
    at = F.when(F.col("event_id") % 50 != 0, F.col("ts").cast("timestamp"))
    stream = _event_stream(spark, d).select("event_id", at.alias("ts"))
    target = S.run_available(stream, "stream-late", for_each=S.count_recent("ts", F.expr("timestamp'2024-01-30 00:00:00'")))
    counts = spark.read.parquet(f"{target}-counts").groupBy("outcome").agg(F.sum("n").alias("n"))
    return counts.unionByName(spark.read.parquet(target).agg(F.lit("stored").alias("outcome"), F.count("*").alias("n")))


@query("stream_route_switches", f"""WITH {ROUTES_SQL} SELECT domain, e.seq AS seq, f.ts_us, e.p AS via_proxy, e.f AS failures, e.s AS switched
FROM routes JOIN fetches f USING (domain) WHERE f.seq = e.seq""")
def stream_route_switches(spark, d):
    raw = _event_stream(spark, d)
    fetches = raw.select(
        F.concat(F.lit("site"), F.col("user_id") % 40, F.lit(".example.com")).alias("domain"), F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), (~F.col("event_type").isin("error", "signup", "view")).alias("ok"),
        (F.col("user_id") % 40 % 2 == 0).alias("default_proxy"))
    return spark.read.parquet(S.run_available(S.route_switch_stream(fetches), "stream-routes", timers=True))


@query("stream_queue_state", f"""WITH {V.QUEUE_SQL} SELECT article_id, max_by(status, seq) AS status,
  count(*) FILTER (WHERE status = 'running') AS attempts, max(ts) AS changed_at FROM queue_events GROUP BY article_id""")
def stream_queue_state(spark, d):
    raw = _event_stream(spark, d)
    events = raw.select(
        F.col("user_id").alias("article_id"), F.col("event_id").alias("seq"), F.col("ts"),
        F.expr("CASE event_type WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END").alias("status"))
    target = S.run_available(S.queue_state_stream(events), "stream-queue", for_each=S.replace_result, mode="complete")
    return edge(spark.read.parquet(target))


@query("stream_queue_rows", f"WITH {V.QUEUE_SQL} SELECT article_id, status, priority, attempts, last_error, started_at, finished_at FROM queue")
def stream_queue_rows(spark, d):
    """The whole queue row from a stream: its parts are aggregates that need no order, so the batch form runs as it is."""
    rows = Q.queue_state(V.queue_events(spark, d, _event_stream(spark, d)))
    target = S.run_available(rows, "stream-queue-rows", for_each=S.replace_result, mode="complete")
    return edge(spark.read.parquet(target))


# ---- rules ----

RULES_SQL = """watch AS (SELECT s_suppkey AS rule_id, CASE WHEN s_suppkey % 2 = 0 THEN 'keyword' ELSE 'source' END AS type,
    CASE WHEN s_suppkey % 2 = 0 THEN chr(CAST(97 + s_suppkey % 26 AS INTEGER)) || 'T' || chr(CAST(97 + s_suppkey % 7 AS INTEGER)) ELSE concat('SRC', s_suppkey) END AS pattern,
    s_acctbal > 0 AS is_enabled, CAST(s_suppkey % 10 AS INTEGER) AS priority FROM supplier),
  block AS (SELECT s_suppkey AS rule_id, CASE WHEN s_suppkey % 3 = 0 THEN 'source' ELSE 'keyword' END AS type,
    CASE WHEN s_suppkey % 3 = 0 THEN concat('src', s_suppkey) ELSE concat('zz', s_suppkey) END AS pattern, s_suppkey % 5 = 0 AS is_enabled FROM supplier)"""


@query("rules_applied", f"""WITH {RULES_SQL}, hit AS (
    SELECT doc_id, max(priority) AS p FROM documents JOIN watch ON is_enabled AND
      CASE WHEN type = 'keyword' THEN contains(lower(text), lower(pattern)) ELSE contains(lower(source), lower(pattern)) END GROUP BY doc_id),
  gone AS (SELECT DISTINCT doc_id FROM documents JOIN block ON is_enabled AND
      CASE WHEN type = 'keyword' THEN contains(lower(text), lower(pattern)) ELSE contains(lower(source), lower(pattern)) END)
SELECT d.doc_id, coalesce(h.p, 0) AS watch_priority, h.p IS NOT NULL AS pinned FROM documents d LEFT JOIN hit h USING (doc_id)
WHERE d.doc_id NOT IN (SELECT doc_id FROM gone)""")
def rules_applied(spark, d):
    suppliers = V.read(spark, d, "supplier")
    watch = suppliers.select(
        F.col("s_suppkey").alias("rule_id"), F.expr("CASE WHEN s_suppkey % 2 = 0 THEN 'keyword' ELSE 'source' END").alias("type"),
        F.expr("CASE WHEN s_suppkey % 2 = 0 THEN concat(chr(97 + s_suppkey % 26), 'T', chr(97 + s_suppkey % 7)) ELSE concat('SRC', s_suppkey) END").alias("pattern"),
        F.expr("s_acctbal > 0").alias("is_enabled"), F.expr("CAST(s_suppkey % 10 AS INT)").alias("priority"))
    block = suppliers.select(
        F.col("s_suppkey").alias("rule_id"), F.expr("CASE WHEN s_suppkey % 3 = 0 THEN 'source' ELSE 'keyword' END").alias("type"),
        F.expr("CASE WHEN s_suppkey % 3 = 0 THEN concat('src', s_suppkey) ELSE concat('zz', s_suppkey) END").alias("pattern"),
        F.expr("s_suppkey % 5 = 0").alias("is_enabled"))
    return L.apply_rules(V.read(spark, d, "documents"), watch, block, "doc_id", "text", "source").select("doc_id", "watch_priority", "pinned")


# ---- settings, preferences, change sets ----

@query("settings_diff", """WITH n AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN s_name || '!' ELSE s_name END AS name FROM supplier WHERE s_suppkey % 10 <> 1),
  o AS (SELECT s_suppkey AS k, s_name AS name FROM supplier WHERE s_suppkey % 10 <> 2)
SELECT coalesce(o.k, n.k) AS key, CASE WHEN o.k IS NULL THEN 'create' WHEN n.k IS NULL THEN 'delete' ELSE 'update' END AS action,
  CASE WHEN o.k IS NOT NULL THEN concat('{"name":"', o.name, '"}') END AS before_json, CASE WHEN n.k IS NOT NULL THEN concat('{"name":"', n.name, '"}') END AS after_json
FROM o FULL JOIN n ON o.k = n.k WHERE o.name IS DISTINCT FROM n.name""")
def settings_diff(spark, d):
    rows = V.read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    after = rows.where("key % 10 <> 1").withColumn("name", F.expr("CASE WHEN key % 3 = 0 THEN concat(name, '!') ELSE name END"))
    return A.snapshot_diff(rows.where("key % 10 <> 2"), after, "key", ["name"])


@query("settings_defaults", """WITH stored AS (SELECT concat('report_topn') AS key, CAST(count(*) AS VARCHAR) AS value FROM supplier
    UNION ALL SELECT concat('custom_', s_nationkey), CAST(count(*) AS VARCHAR) FROM supplier GROUP BY s_nationkey),
  defaults(key, value) AS (VALUES ('report_topn', '5'), ('confidence_threshold', '0.6'), ('min_content_len', '120'), ('crawl_concurrency_rss', '10'),
    ('crawl_concurrency_web', '2'), ('llm_timeout_sec', '90'), ('llm_retries', '2'), ('smtp_host', 'smtp.163.com'), ('smtp_port', '465'),
    ('mail_batch_limit', '50'), ('mail_rate_limit_per_sec', '1'), ('wordcloud_cache_ttl', '86400'), ('primary_color', '#2563eb'),
    ('secondary_color', '#1e4976'), ('accent_color', '#f59e0b'), ('provider_deepseek', 'deepseek'), ('provider_qwen', 'qwen'))
SELECT coalesce(s.key, d.key) AS key, coalesce(s.value, d.value) AS value, CASE WHEN s.value IS NULL THEN 'default' ELSE 'stored' END AS origin
FROM stored s FULL JOIN defaults d ON s.key = d.key""")
def settings_defaults(spark, d):
    suppliers = V.read(spark, d, "supplier")
    stored = suppliers.agg(F.count("*").cast("string").alias("value")).select(F.lit("report_topn").alias("key"), "value").unionByName(
        suppliers.groupBy("s_nationkey").agg(F.count("*").cast("string").alias("value")).select(
            F.concat(F.lit("custom_"), "s_nationkey").alias("key"), "value"))
    return A.with_default_settings(stored)


@query("config_clamped", f"""WITH {V.REGISTRY_SQL} SELECT source_id, greatest(1, least(50, concurrency)) AS concurrency,
  greatest(5, least(300, timeout_sec)) AS timeout_sec, nullif(trim(parser), '') AS parser FROM registry""")
def config_clamped(spark, d):
    return A.clean_source_config(V.registry(spark, d)).select("source_id", "concurrency", "timeout_sec", "parser")


@query("prefs_upsert", """WITH e AS (SELECT event_id AS seq, concat('u', user_id) AS user_email, concat('t', event_id % 7) AS name,
    concat('prompt ', event_id) AS prompt_text, event_type = 'purchase' AS flag FROM events),
  n AS (SELECT user_email, name, min(seq) AS first_seq, max(seq) AS seq, max(seq) FILTER (WHERE flag) AS f FROM e GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY user_email ORDER BY first_seq) AS r FROM n QUALIFY r <= 5),
  m AS (SELECT user_email, max(f) AS d FROM k GROUP BY 1)
SELECT k.user_email, k.name, e.prompt_text, coalesce(k.seq = m.d, false) AS is_default FROM k JOIN m USING (user_email) JOIN e ON e.seq = k.seq""")
def prefs_upsert(spark, d):
    saves = V.read(spark, d, "events").select(
        F.concat(F.lit("u"), "user_id").alias("user_email"), F.concat(F.lit("t"), F.col("event_id") % 7, F.lit(" ")).alias("name"),
        F.lit("global").alias("scope"), F.concat(F.lit("prompt "), "event_id").alias("prompt_text"),
        (F.col("event_type") == "purchase").alias("is_default"), F.col("event_id").alias("seq"))
    return A.save_preferences(saves.where("seq % 2 = 0"), saves.where("seq % 2 = 1")).select("user_email", "name", "prompt_text", "is_default")


@query("rows_deleted", "SELECT c_custkey, c_name FROM customer WHERE NOT (c_custkey % 4 = 1 AND c_nationkey = c_custkey % 25)")
def rows_deleted(spark, d):
    people = V.read(spark, d, "customer")
    keys = people.where("c_custkey % 4 = 1").select("c_custkey", F.expr("CAST(c_custkey % 25 AS INT)").alias("c_nationkey"))
    return A.delete_rows(people, keys, ["c_custkey", "c_nationkey"]).select("c_custkey", "c_name")


@query("rows_retained", """SELECT 'articles' AS kind, o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 180 DAY
UNION ALL SELECT 'delivery', event_id FROM events WHERE ts >= TIMESTAMP '2024-04-10' - INTERVAL 90 DAY""")
def rows_retained(spark, d):
    old = A.retained(V.read(spark, d, "orders"), "o_orderdate", F.expr("timestamp_ntz'2001-08-01'"), 180)
    log = A.retained(V.read(spark, d, "events"), "ts", F.expr("timestamp_ntz'2024-04-10'"), 90)
    return old.select(F.lit("articles").alias("kind"), F.col("o_orderkey").alias("id")).unionByName(
        log.select(F.lit("delivery").alias("kind"), F.col("event_id").alias("id")))


@query("months_retained", """SELECT 'articles' AS kind, o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 180 DAY
UNION ALL SELECT 'delivery', event_id FROM events WHERE ts >= TIMESTAMP '2024-04-10' - INTERVAL 90 DAY""")
def months_retained(spark, d):
    """The same rows from tables that are partitioned by month and lose whole months."""
    parts = []
    for kind, name, key, at, as_of, days in (("articles", "orders", "o_orderkey", "o_orderdate", "timestamp_ntz'2001-08-01'", 180),
                                             ("delivery", "events", "event_id", "ts", "timestamp_ntz'2024-04-10'", 90)):
        path = scratch_path(spark, f"months-{kind}")
        write_months(V.read(spark, d, name).select(key, at), path, at)
        drop_before(spark, path, at, F.expr(as_of), days)
        parts.append(spark.read.parquet(path).select(F.lit(kind).alias("kind"), F.col(key).alias("id")))
    return parts[0].unionByName(parts[1])


@query("rows_toggled", f"""WITH {V.REGISTRY_SQL} SELECT source_id, CASE WHEN source_id % 3 = 0 THEN NOT enabled ELSE enabled END AS flipped,
  CASE WHEN source_id % 3 = 0 THEN false ELSE enabled END AS disabled FROM registry""")
def rows_toggled(spark, d):
    rows = V.registry(spark, d)
    keys = rows.where("source_id % 3 = 0")
    return A.toggle(rows, keys, "source_id").select("source_id", F.col("enabled").alias("flipped")).join(
        A.toggle(rows, keys, "source_id", False).select("source_id", F.col("enabled").alias("disabled")), "source_id")


@query("create_conflicts", f"""WITH {V.RECIPIENTS_SQL} SELECT seq, CASE WHEN EXISTS (SELECT 1 FROM recipients o WHERE o.seq % 2 = 0 AND o.email = r.email AND o.type = r.type)
  THEN 'conflict' ELSE 'insert' END AS outcome FROM recipients r WHERE seq % 2 = 1""")
def create_conflicts(spark, d):
    people = V.recipients(spark, d)
    good, taken = A.split_conflicts(people.where("seq % 2 = 1"), people.where("seq % 2 = 0"), ["email", "type"])
    return good.select("seq", F.lit("insert").alias("outcome")).unionByName(taken.select("seq", F.lit("conflict").alias("outcome")))


# ---- logs and counts ----

@query("audit_list", """SELECT event_id AS log_id, event_type AS action, ts AS created_at FROM events
WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AND event_type = 'click' ORDER BY ts DESC, event_id LIMIT 200""")
def audit_list(spark, d):
    return edge(A.filtered_log(V.audit_log(spark, d), F.expr(AS_OF), 7, "click").select("log_id", "action", "created_at"))


@query("latest_rows", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30")
def latest_rows(spark, d):
    return edge(latest(V.read(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 30, "o_orderkey"))


@query("action_types", "SELECT DISTINCT event_type AS action FROM events")
def action_types(spark, d):
    return A.action_types(V.audit_log(spark, d))


@query("table_counts", """SELECT 'articles' AS name, count(*) AS n FROM orders UNION ALL SELECT 'items', count(*) FROM lineitem
UNION ALL SELECT 'sources', count(*) FROM supplier UNION ALL SELECT 'usage', count(*) FROM events""")
def table_counts(spark, d):
    return A.table_counts({name: V.read(spark, d, t) for name, t in (
        ("articles", "orders"), ("items", "lineitem"), ("sources", "supplier"), ("usage", "events"))})


DAILY_SQL = GRAMS_SQL + f""", {V.BODIES_SQL}, fresh AS (SELECT url, min(seq) AS seq FROM bodies GROUP BY url),
  nodes AS (SELECT simhash, min(doc_id) AS seq FROM hashes JOIN fresh ON fresh.seq = doc_id WHERE simhash <> 0 GROUP BY simhash),
  pairs AS (SELECT a.seq AS a, b.seq AS b FROM nodes a JOIN nodes b ON a.seq < b.seq AND bit_count(xor(a.simhash, b.simhash)) <= 3)""" + GREEDY_SQL


@query("daily_run")
def daily_run(spark, d):
    return run_daily(spark, V.bodies(spark, d), V.responses(spark, d), V.recipients(spark, d))


@query("daily_tables", f"""WITH {DAILY_SQL}, ready AS (SELECT seq FROM kept JOIN bodies USING (seq)
    WHERE length(regexp_replace(regexp_replace(content_text, '^\\s+', ''), '\\s+$', '')) >= 120)
SELECT 'articles' AS name, seq AS id FROM kept UNION ALL SELECT 'extraction_queue', seq FROM ready""")
def daily_tables(spark, d):
    """Articles and queue as two runs of one day have left them: the second finds the day in the manifest."""
    root = scratch_path(spark, "daily")
    for _ in range(2):
        run_stored(spark, root, "2024-01-31", V.bodies(spark, d), V.responses(spark, d), V.recipients(spark, d),
                   F.expr("timestamp'2024-02-01 06:00:00'"))
    table = lambda name, key: spark.read.parquet(f"{root}/{name}").select(F.lit(name).alias("name"), F.col(key).alias("id"))
    return table("articles", "seq").unionByName(table("extraction_queue", "article_id"))
