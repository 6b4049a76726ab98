"""Queries over recipients, batches, bounces and the delivery log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import delivery as D
from tidewire.plans import views as V
from tidewire.plans.catalog import query
from tidewire.plans.views import edge

EMAIL_SQL = r"'^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$'"
HARD_SQL = ("'user (not found|unknown|does not exist)|no such (user|recipient|mailbox)|recipient (rejected|not found)"
            "|mailbox (unavailable|disabled|does not exist)|invalid (recipient|mailbox|address)|domain (not found|does not exist)"
            "|undeliverable|permanent (error|failure)|5[0-9]{2}'")
BATCH_SQL = f"""{V.RECIPIENTS_SQL}, good AS (
    SELECT email, min(seq) AS seq FROM recipients WHERE type = 'recipient' AND enabled AND regexp_matches(email, {EMAIL_SQL}) GROUP BY email),
  n AS (SELECT email, row_number() OVER (ORDER BY seq) AS n FROM good),
  batches AS (SELECT (n - 1) // 50 + 1 AS batch_no, min_by(email, n) AS to_1,
     coalesce(string_agg(email, ',' ORDER BY n) FILTER (WHERE (n - 1) % 50 > 0), '') AS bcc, count(*) AS recipients FROM n GROUP BY 1)"""


def _batches(spark, d):
    valid, _ = D.split_valid(D.active_recipients(V.recipients(spark, d)))
    return D.batches(D.distinct_in_order(valid, "seq"), "seq")


@query("recipients_valid", f"WITH {V.RECIPIENTS_SQL} SELECT seq, email, regexp_matches(email, {EMAIL_SQL}) AS ok FROM recipients WHERE type = 'recipient' AND enabled")
def recipients_valid(spark, d):
    return D.active_recipients(V.recipients(spark, d)).select("seq", "email", D.is_email(F.col("email")).alias("ok"))


@query("recipients_disabled", f"WITH {V.RECIPIENTS_SQL} SELECT DISTINCT email FROM recipients WHERE NOT enabled")
def recipients_disabled(spark, d):
    return D.disabled_recipients(V.recipients(spark, d)).select("email").distinct()


@query("recipients_distinct", f"WITH {V.RECIPIENTS_SQL} SELECT email, min(seq) AS seq FROM recipients GROUP BY email")
def recipients_distinct(spark, d):
    return D.distinct_in_order(V.recipients(spark, d), "seq")


@query("recipients_batched", f"WITH {BATCH_SQL} SELECT batch_no, to_1, md5(bcc) AS bcc_md5, recipients FROM batches")
def recipients_batched(spark, d):
    return _batches(spark, d).select("batch_no", F.element_at("to", 1).alias("to_1"),
                                     F.md5(F.array_join("bcc", ",")).alias("bcc_md5"), "recipients")


@query("send_plan", f"""WITH {BATCH_SQL} SELECT batch_no, recipients,
  TIMESTAMP '2024-01-31 06:05:00' + to_milliseconds((batch_no - 1) * 500) AS planned_at FROM batches""")
def send_plan(spark, d):
    planned = D.send_plan(_batches(spark, d), F.expr("timestamp'2024-01-31 06:05:00'"), rate=2.0)
    return planned.select("batch_no", "recipients", "planned_at")


@query("retry_plan", """SELECT event_id, retry, wait AS wait_sec, ts + to_seconds(total) AS retry_at
FROM events, (VALUES (1, 2.0::DOUBLE, 2), (2, 4.0::DOUBLE, 6)) r(retry, wait, total) WHERE event_type = 'error'""")
def retry_plan(spark, d):
    failed = V.read(spark, d, "events").where("event_type = 'error'").select("event_id", "ts")
    return D.retry_plan(failed, "ts").select("event_id", "retry", "wait_sec", "retry_at")


@query("bounce_class", f"""WITH {V.DELIVERY_SQL} SELECT batch_no, regexp_matches(lower(error), {HARD_SQL}) AS hard,
  regexp_extract(lower(error), {HARD_SQL}, 0) AS reason FROM delivery WHERE status = 'failed'""")
def bounce_class(spark, d):
    failed = V.delivery(spark, d).where("status = 'failed'")
    return failed.select("batch_no", D.is_hard_bounce(F.col("error")).alias("hard"), D.bounce_text(F.col("error")).alias("reason"))


@query("recipients_bounced", f"""WITH {V.RECIPIENTS_SQL}, {V.DELIVERY_SQL}, hit AS (
  SELECT unnest([to_1, bcc_1]) AS email FROM delivery WHERE status = 'failed' AND regexp_matches(lower(error), {HARD_SQL}))
SELECT seq, email, type, CASE WHEN type = 'recipient' AND email IN (SELECT email FROM hit) THEN false ELSE enabled END AS enabled FROM recipients""")
def recipients_bounced(spark, d):
    log = V.delivery(spark, d).withColumnRenamed("error", "error_message")
    return D.disable_bounced(V.recipients(spark, d), log).select("seq", "email", "type", "enabled")


@query("recipients_reenabled", f"""WITH {V.RECIPIENTS_SQL}, chosen AS (SELECT DISTINCT email FROM recipients WHERE seq % 3 = 0)
SELECT seq, email, CASE WHEN type = 'recipient' AND email IN (SELECT email FROM chosen) THEN true ELSE enabled END AS enabled FROM recipients""")
def recipients_reenabled(spark, d):
    people = V.recipients(spark, d)
    return D.set_enabled(people, people.where("seq % 3 = 0"), True).select("seq", "email", "enabled")


@query("delivery_log", f"""WITH {V.DELIVERY_SQL} SELECT report_id, batch_no,
  concat('{{"to":["', to_1, '"],"bcc":["', bcc_1, '"]}}') AS recipients_snapshot, message_id, status, error AS error_message,
  coalesce(sent + INTERVAL 8 HOUR, TIMESTAMP '2024-02-01 06:00:00') AS sent_at FROM delivery""")
def delivery_log(spark, d):
    return edge(D.delivery_rows(V.delivery(spark, d), F.expr("timestamp_ntz'2024-02-01 06:00:00'")))


@query("delivery_outcome", f"""WITH {V.DELIVERY_SQL} SELECT report_id, CAST(count(*) * 2 AS BIGINT) AS total_recipients, count(*) AS total_batches,
  count(*) FILTER (WHERE status = 'ok') AS success_batches, count(*) FILTER (WHERE status <> 'ok') AS failed_batches
FROM delivery GROUP BY report_id""")
def delivery_outcome(spark, d):
    log = V.delivery(spark, d).withColumn("recipients", F.size("to") + F.size("bcc"))
    return D.delivery_outcome(log)
