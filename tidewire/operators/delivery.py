"""Recipients, batches, send plan, bounces and delivery outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.functions.scoring import planned_send_time, retry_delay
from tidewire.functions.times import to_local
from tidewire.operators.numbering import number_rows
from tidewire.params import DEFAULTS

# ---- fixed values -----------------------------------------------------------
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
HARD_BOUNCES = [
    r"user (not found|unknown|does not exist)",
    r"no such (user|recipient|mailbox)",
    r"recipient (rejected|not found)",
    r"mailbox (unavailable|disabled|does not exist)",
    r"invalid (recipient|mailbox|address)",
    r"domain (not found|does not exist)",
    r"undeliverable",
    r"permanent (error|failure)",
    r"5[0-9]{2}",
]
# ---- end of fixed values ----------------------------------------------------


def is_email(email: Column) -> Column:
    return F.coalesce(email.rlike(EMAIL), F.lit(False))


def is_hard_bounce(message: Column) -> Column:
    return F.coalesce(F.lower(message).rlike("|".join(HARD_BOUNCES)), F.lit(False))


def bounce_text(message: Column) -> Column:
    """The part of the message that makes it a hard bounce; empty for a soft one."""
    return F.coalesce(F.regexp_extract(F.lower(message), "(" + "|".join(HARD_BOUNCES) + ")", 1), F.lit(""))


def active_recipients(recipients: DataFrame) -> DataFrame:
    return recipients.where((F.col("type") == "recipient") & F.col("enabled"))


def disabled_recipients(recipients: DataFrame) -> DataFrame:
    return recipients.where(~F.col("enabled"))


def split_valid(recipients: DataFrame, email: str = "email") -> tuple[DataFrame, DataFrame]:
    ok = is_email(F.col(email))
    return recipients.where(ok), recipients.where(~ok)


def distinct_in_order(recipients: DataFrame, order: str, email: str = "email") -> DataFrame:
    """First place of each address; combined before the shuffle."""
    return recipients.groupBy(email).agg(F.min(order).alias(order))


def batches(recipients: DataFrame, order: str, size: int = DEFAULTS.mail_batch, email: str = "email") -> DataFrame:
    """Batches of `size` in order: the first address is `to`, the others `bcc`."""
    placed = number_rows(recipients.select(email, order), [order], (), "_n").withColumn(
        "batch_no", (F.floor((F.col("_n") - 1) / size) + 1).cast("bigint"))
    members = F.sort_array(F.collect_list(F.struct("_n", email)))
    return (placed.groupBy("batch_no").agg(F.transform(members, lambda x: x[email]).alias("_all"))
            .select("batch_no", F.slice("_all", 1, 1).alias("to"),
                    F.slice("_all", 2, size).alias("bcc"), F.size("_all").alias("recipients")))


def send_plan(made: DataFrame, start: Column, rate: float = DEFAULTS.mail_rate) -> DataFrame:
    return made.withColumn("planned_at", planned_send_time(start, F.col("batch_no"), rate))


def retry_plan(failed: DataFrame, at: str, retries: int = DEFAULTS.retry_max,
               base_sec: float = DEFAULTS.retry_base_sec) -> DataFrame:
    """One row per planned retry: the wait doubles each time and adds up."""
    tries = failed.withColumn("retry", F.explode(F.sequence(F.lit(1), F.lit(retries))))
    waited = F.aggregate(F.sequence(F.lit(0), F.col("retry") - 1), F.lit(0.0),
                         lambda total, k: total + retry_delay(k, base_sec))
    return (tries.withColumn("wait_sec", retry_delay(F.col("retry") - 1, base_sec))
            .withColumn("retry_at", F.timestamp_micros(
                F.unix_micros(F.col(at).cast("timestamp")) + (waited * 1_000_000).cast("bigint"))))


def bounced_addresses(log: DataFrame) -> DataFrame:
    """Every address of every batch that failed with a hard bounce."""
    hit = log.where((F.col("status") == "failed") & is_hard_bounce(F.col("error_message")))
    return hit.select(F.explode(F.concat("to", "bcc")).alias("email")).distinct()


def set_enabled(recipients: DataFrame, emails: DataFrame, enabled: bool) -> DataFrame:
    """Switch the recipients whose address is listed; other types stay as they are."""
    marked = emails.select("email").distinct().withColumn("_hit", F.lit(True))
    mine = F.col("_hit") & (F.col("type") == "recipient")
    return (recipients.join(marked, "email", "left")
            .withColumn("enabled", F.when(F.coalesce(mine, F.lit(False)), F.lit(enabled)).otherwise(F.col("enabled")))
            .select(*recipients.columns))


def disable_bounced(recipients: DataFrame, log: DataFrame) -> DataFrame:
    return set_enabled(recipients, bounced_addresses(log), False)


def delivery_rows(results: DataFrame, as_of: Column) -> DataFrame:
    """Log rows: recipients as one snapshot, send time local or `as_of`."""
    sent = to_local(F.try_to_timestamp("sent_at"))
    return results.select(
        "report_id", "batch_no", F.to_json(F.struct("to", "bcc")).alias("recipients_snapshot"), "message_id",
        F.coalesce("status", F.lit("failed")).alias("status"), F.col("error").alias("error_message"),
        F.coalesce(sent, as_of.cast("timestamp_ntz")).alias("sent_at"))


def delivery_outcome(log: DataFrame) -> DataFrame:
    ok = F.count_if(F.col("status") == "ok")
    return log.groupBy("report_id").agg(
        F.sum("recipients").alias("total_recipients"), F.count("*").alias("total_batches"),
        ok.alias("success_batches"), (F.count("*") - ok).alias("failed_batches"))


def latest(df: DataFrame, order: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.col(order).desc(), tie).limit(n)
