"""State machines of crawl results and soft bounces: folds over a key's events in order, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Results that settle a pair at once, and the texts that count its errors.
DONE = ("OK", "NO DETAIL ITEMS", "SPELL SUGGESTION")
NOT_FOUND, HTTP, PARSE = "SEARCH HTTP 404", "HTTP ERROR", "FAILED TO PARSE"


def retry_fold(events: DataFrame) -> DataFrame:
    """events (cb_id, seq, result) folded in order of seq: cb_id, error, collected, seen (results until it was collected).

    Final results collect at once (without error text if all is well), as does a search page that isn't there; an HTTP or
    parse error collects at the third in a row. The count is in the error text, and errors of the other kind start it anew; other
    results leave the pair waiting as it was. No list of a pair's results is gathered: each looks back at two, and the first that
    collects is a minimum."""
    starts = lambda t: F.startswith("result", F.lit(t))
    final = F.col("result").isin(*DONE, NOT_FOUND) | starts("SKIPPED")
    kind = F.when(starts("SEARCH HTTP") | starts("DETAIL HTTP") | F.contains("result", F.lit("AJAX HTTP")), HTTP).when(starts(PARSE), PARSE)
    w = Window.partitionBy("cb_id").orderBy("seq", "result")
    told = events.select("cb_id", "seq", "result", final.alias("_final"), F.when(~final, kind).alias("_kind")).filter("_final or _kind is not null")
    told = told.withColumn("_again", F.col("_kind").eqNullSafe(F.lag("_kind").over(w)) & F.col("_kind").isNotNull())
    third = F.col("_again") & F.col("_kind").eqNullSafe(F.lag("_kind", 2).over(w))
    told = told.withColumn("_settles", F.col("_final") | third)
    row = F.struct("seq", "result", "_final", "_kind", "_again")
    ends = told.groupBy("cb_id").agg(F.min(F.when(F.col("_settles"), row)).alias("end"), F.max(row).alias("last"))
    rows = events.join(ends, "cb_id", "left")
    before = F.col("end").isNull() | (F.struct("seq", "result") <= F.struct("end.seq", "end.result"))
    found = rows.groupBy("cb_id").agg(F.count_if(before).cast("int").alias("seen"), F.first("end").alias("end"), F.first("last").alias("last"))
    last = F.when(F.col("end._final"), F.nullif("end.result", F.lit("OK"))).when(F.col("end._kind") == PARSE, PARSE).otherwise(F.col("end.result"))
    waiting = F.concat("last._kind", F.when(F.col("last._again"), " 2").otherwise(" 1"))
    return found.select("cb_id", F.when(F.col("end").isNotNull(), last).otherwise(waiting).alias("error"), F.col("end").isNotNull().alias("collected"), "seen")


def soft_bounces(events: DataFrame, most: int = 3, days: int = 7) -> DataFrame:
    """Contacts with so many soft bounces (code 451) in a row, each within so many days of the one before; a success
    between clears them. events: contact_id, time, seq, code (null for a success)."""
    w = Window.partitionBy("contact_id").orderBy("time", "seq")
    late = F.col("time").cast("timestamp") - F.lag(F.col("time").cast("timestamp")).over(w) > F.make_dt_interval(F.lit(days))
    rows = events.withColumn("_new", (F.col("code").isNull() | F.coalesce(late, F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    runs = rows.filter("code = 451").groupBy("contact_id", "_run").agg(F.count("*").alias("n"))
    return runs.filter(F.col("n") >= most).select("contact_id").distinct()


def soft_bounce_stream(events: DataFrame, most: int = 3, days: int = 7) -> DataFrame:
    """soft_bounces as a stream of contacts at the moment they are blocked; the state of a contact is its count and the time of
    its last bounce, and times out after so many days of event time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last = state.get if state.exists else (0, 0)
        for b in batches:
            for t, code in zip(b.sort_values(["time", "seq"])["time"], b.sort_values(["time", "seq"])["code"]):
                at = int(t.timestamp())
                if pd.isna(code):
                    n = 0
                elif code == 451:
                    n, last = (n + 1 if n and at - last <= days * 86400 else 1), at
                    if n == most:
                        yield pd.DataFrame({"contact_id": [key[0]], "time": [t]})
        state.update((n, last))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, last * 1000 + days * 86_400_000))

    return events.withWatermark("time", "1 hour").groupBy("contact_id").applyInPandasWithState(step, "contact_id long, time timestamp", "n int, last long", "append", GroupStateTimeout.EventTimeTimeout)


def retry_stream(events: DataFrame, remember_days: int = 7) -> DataFrame:
    """retry_fold as a stream of updates: results (cb_id, seq, result) arrive in order of seq for each pair. A pair that is collected is
    remembered for so many days, to leave out results that come late, and then forgotten."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        error, collected, seen = state.get if state.exists else (None, False, 0)
        for b in batches:
            for result in b.sort_values("seq")["result"]:
                if collected:
                    break
                seen += 1
                kind = HTTP if result.startswith(("SEARCH HTTP", "DETAIL HTTP")) or "AJAX HTTP" in result else PARSE if result.startswith(PARSE) else None
                if result in (*DONE, NOT_FOUND) or result.startswith("SKIPPED"):
                    error, collected = None if result == "OK" else result, True
                elif kind:
                    n = {f"{kind} 1": 2, f"{kind} 2": 3}.get(error, 1)
                    collected = n >= 3
                    error = (PARSE if kind == PARSE else result) if collected else f"{kind} {n}"
        state.update((error, collected, seen))
        if collected:
            state.setTimeoutDuration(remember_days * 86_400_000)
        yield pd.DataFrame({"cb_id": [key[0]], "error": [error], "collected": [collected], "seen": [seen]})

    return events.groupBy("cb_id").applyInPandasWithState(step, "cb_id long, error string, collected boolean, seen int", "error string, collected boolean, seen int", "update", GroupStateTimeout.ProcessingTimeTimeout)
