"""Rate limits per domain: a fold over each domain's fetch events in order, and the counters of a crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab

STATE = "struct<delay:double,extra:double,cooldown:double,status:string,ok:bigint,e429:bigint,e503:bigint,other:bigint>"


def _next(s: Column, ts: Column, status: Column) -> Column:
    ok, refused = status == 200, status.isin(429, 503)
    successes = s["ok"] + F.when(ok, 1).otherwise(0)
    faster = F.greatest(F.lit(vocab.MIN_DELAY), s["delay"] * vocab.SPEED_UP)
    slower = F.least(F.lit(vocab.MAX_DELAY), s["delay"] * vocab.SLOW_DOWN)
    over = (s["status"] == "cooling_down") & (ts >= s["cooldown"])
    return F.struct(
        F.when(ok & (successes >= vocab.SUCCESSES), faster).when(~ok & ~refused, slower).otherwise(s["delay"]).alias("delay"),
        F.when(refused, s["extra"] + vocab.COOLDOWN_DELAY).otherwise(s["extra"]).alias("extra"),
        F.when(refused, ts + vocab.COOLDOWN_SECONDS).otherwise(s["cooldown"]).alias("cooldown"),
        F.when(refused, "cooling_down").when(ok & over & (s["extra"] > 0), "slowed").when(ok & over, "active").otherwise(s["status"]).alias("status"),
        successes.alias("ok"),
        (s["e429"] + F.when(status == 429, 1).otherwise(0)).alias("e429"),
        (s["e503"] + F.when(status == 503, 1).otherwise(0)).alias("e503"),
        (s["other"] + F.when(~ok & ~refused, 1).otherwise(0)).alias("other"),
    ).cast(STATE)


def initial_state() -> Column:
    zero = F.lit(0).cast("bigint")
    return F.struct(
        F.lit(vocab.START_DELAY).alias("delay"), F.lit(0.0).alias("extra"), F.lit(0.0).alias("cooldown"), F.lit("active").alias("status"), zero.alias("ok"), zero.alias("e429"), zero.alias("e503"), zero.alias("other")
    ).cast(STATE)


def rate_limit_fold(events: DataFrame, domain: str, ts: str, status: str, order: str) -> DataFrame:
    """Per domain the state after its last event. events: ts in seconds; status 200, 429, 503 or another error.

    A domain's events are what one domain served in a session (domain_cap bounds them); the streaming form keeps the
    same state without gathering events.
    """
    log = events.groupBy(F.col(domain).alias("domain")).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(ts).cast("double").alias("ts"), F.col(status).alias("status")))).alias("log"))
    folded = log.select("domain", F.aggregate("log", initial_state(), lambda s, e: _next(s, e["ts"], e["status"])).alias("s"))
    return folded.select(
        "domain", F.col("s.status").alias("status"), F.col("s.delay").alias("adaptive_delay"), F.col("s.extra").alias("extra_delay"), (F.col("s.delay") + F.col("s.extra")).alias("current_delay"),
        F.col("s.cooldown").alias("cooldown_until"), F.col("s.ok").alias("successes"), F.col("s.e429").alias("errors_429"), F.col("s.e503").alias("errors_503"), F.col("s.other").alias("other_errors"),
    )


def domain_report(state: DataFrame, now: Column) -> DataFrame:
    """status, remaining cooldown and whether a domain is cooling or slowed at a time."""
    return state.select("domain", "status", "extra_delay", "errors_429", "errors_503", (now < F.col("cooldown_until")).alias("cooling_down"), (F.col("extra_delay") > 0).alias("slowed"), F.greatest(F.lit(0.0), F.col("cooldown_until") - now).alias("cooldown_remaining"))


def crawl_metrics(counters: DataFrame, elapsed: Column, before: Column) -> DataFrame:
    """Derived figures of one row of counters (sites, sentences, failed, duplicates, queue)."""
    c = F.col
    done = c("sites") + c("failed") + c("duplicates")
    rate = F.when(elapsed > 0, c("sites") / elapsed).otherwise(0.0)
    left = F.when((rate > 0) & (c("queue") > 0), c("queue") / rate).otherwise(0.0)
    return counters.select(
        "sites", "sentences", (before + elapsed).alias("total_elapsed"), (rate * 60).alias("urls_per_minute"), rate.alias("urls_per_second"), left.alias("remaining_seconds"), (elapsed + left).alias("estimated_total_seconds"),
        F.when(done + c("queue") > 0, done / (done + c("queue")) * 100).otherwise(0.0).alias("progress_percent"),
    )
