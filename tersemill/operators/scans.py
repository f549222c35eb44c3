"""What depends on all that came before, without a task that goes through it all.

A phrase's exclusion, the last minute of a provider's requests and its days are sequences by nature. Here each is put
together from ranges of time: what a range does is summed up so that the summaries of neighbours combine, or a
range gets the end of the one before it, or the next step is looked up for all rows at once and steps are doubled.
No task has more than one range of one phrase or provider, and what is combined has a row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import materialize, scratch

#: Uses, and reverts of so many uses, from which a phrase excludes itself.
LEAST_USES, REVERTS, OF_USES = 5, 3, 5
MINUTE, DAY = 60_000, 86_400_000
#: Milliseconds of a range of requests.
RANGE = 600_000


def phrase_summaries(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """events(seq, ts, phrase, action: apply, revert, toggle_on, toggle_off) -> (phrase, part, a, r, ts, last): of each
    phrase and range of time the uses and reverts, the last toggle, and of what came after that the largest balance
    of reverts against uses at or after the k-th use, for each k that the uses before the range may leave to be reached."""
    n = ranges or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = events.withColumn("phrase", F.lower(F.trim("phrase"))).repartitionByRange(n, "ts", "seq").withColumn("part", F.spark_partition_id().cast("long"))
    w = Window.partitionBy("phrase", "part").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    is_ = lambda *a: F.col("action").isin(*a).cast("long")
    e = e.withColumns({"a": F.sum(is_("apply")).over(w), "r": F.sum(is_("revert")).over(w), "toggles": F.sum(is_("toggle_on", "toggle_off")).over(w)})
    balance = (OF_USES - REVERTS) * F.col("r") - REVERTS * F.col("a")
    use = F.col("action").isin("apply", "revert")
    best = [F.max(F.when(use & (F.col("a") + F.col("r") >= k), balance)) for k in range(1, LEAST_USES + 1)]
    since = e.groupBy("phrase", "part", "toggles").agg(F.max("a").alias("a"), F.max("r").alias("r"), F.max("ts").alias("ts"), F.max((F.col("action") == "toggle_on").cast("int")).alias("on"), F.array(*best).alias("best"))
    return since.groupBy("phrase", "part").agg(F.max("a").alias("a"), F.max("r").alias("r"), F.max("ts").alias("ts"), F.max_by(F.struct("toggles", "on", "best"), "toggles").alias("last"))


def folded(summaries: DataFrame, *order: str) -> DataFrame:
    """The phrase log of summaries, taken in order: what the events one by one would give. A phrase has as many as ranges."""
    out = summaries.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct(*order, "a", "r", "last"))).alias("parts"), F.max("ts").alias("last_updated"))

    def fold(x: Column, part: Column) -> Column:
        short = F.greatest(F.lit(1).cast("long"), LEAST_USES - x["a"] - x["r"]).cast("int")
        top = F.element_at(part["last"]["best"], short)
        hit = F.coalesce(top + (OF_USES - REVERTS) * x["r"] - REVERTS * x["a"] >= 0, F.lit(False))
        start = F.when(part["last"]["toggles"] > 0, part["last"]["on"] == 1).otherwise(x["x"])
        return F.struct((x["a"] + part["a"]).alias("a"), (x["r"] + part["r"]).alias("r"), (start | hit).alias("x"))

    zero = F.lit(0).cast("long")
    out = out.withColumn("s", F.aggregate("parts", F.struct(zero.alias("a"), zero.alias("r"), F.lit(False).alias("x")), fold))
    uses = F.col("s.a") + F.col("s.r")
    return out.select("phrase", F.col("s.a").alias("applied"), F.col("s.r").alias("reverted"), F.when(uses > 0, F.col("s.a") / uses).otherwise(0.5).alias("confidence"), F.col("s.x").alias("excluded"), "last_updated")


def phrase_log(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """events(seq, ts, phrase, action) -> one row per phrase. Exclusion holds from any event at which the uses and
    reverts so far suffice, until a toggle sets it otherwise."""
    return folded(phrase_summaries(events, ranges), "part")


def window_usage(requests: DataFrame, width: int = RANGE) -> DataFrame:
    """requests(provider, ts_ms, tokens): requests and tokens of the minute up to each. A range of time gets the last
    minute of the one before it as well, so ranges need nothing from each other."""
    if width < MINUTE:
        raise ValueError("a range must be a minute at least")
    own = F.floor(F.col("ts_ms") / width)
    again = F.col("ts_ms") > (own + 1) * width - MINUTE
    rows = requests.select("provider", "ts_ms", "tokens", F.explode(F.when(again, F.array(own, own + 1)).otherwise(F.array(own))).alias("_range"))
    # what is up to each, less what is a minute before it: a frame that moves at both ends is summed anew for each row
    w = Window.partitionBy("provider", "_range").orderBy("ts_ms")
    upto, past = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(Window.unboundedPreceding, -MINUTE)
    n, valued, zero = F.count(F.lit(1)), F.count("tokens"), F.lit(0).cast("long")
    total = F.sum("tokens").over(upto) - F.coalesce(F.sum("tokens").over(past), zero)
    minute_tokens = F.when(valued.over(upto) > valued.over(past), total)
    out = rows.select("*", (n.over(upto) - n.over(past)).alias("minute_requests"), minute_tokens.alias("minute_tokens"))
    return out.filter(own == F.col("_range")).drop("_range")


def next_days(times: DataFrame, width: int) -> DataFrame:
    """times(provider, ts_ms), each once -> (provider, at, next): the first time more than a day after each, if any. It
    is looked for in its own range; where that has none, the next range that has any begins with it."""
    range_ = lambda c: F.floor(c / width)
    ask = F.col("ts_ms") + DAY + 1
    asked = times.select("provider", range_(ask).alias("_range"), ask.alias("t"), F.col("ts_ms").alias("at"))
    there = times.select("provider", range_(F.col("ts_ms")).alias("_range"), F.col("ts_ms").alias("t"), F.lit(None).cast("long").alias("at"))
    # from the last time to the first: a frame up to the end is read anew for each row, one from the start isn't
    later = Window.partitionBy("provider", "_range").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0)
    found = asked.unionByName(there).withColumn("next", F.min(F.when(F.col("at").isNull(), F.col("t"))).over(later)).filter("at is not null")
    # ranges: those with times, and those asked for in vain
    firsts = there.groupBy("provider", "_range").agg(F.min("t").alias("first"))
    vain = found.filter("next is null").select("provider", "_range").distinct().withColumn("first", F.lit(None).cast("long"))
    beyond = Window.partitionBy("provider").orderBy(F.desc("_range")).rangeBetween(Window.unboundedPreceding, -1)
    onward = firsts.unionByName(vain).withColumn("_onward", F.min("first").over(beyond)).filter("first is null").select("provider", "_range", "_onward")
    out = found.join(onward, ["provider", "_range"], "left")
    return out.select("provider", "at", F.coalesce("next", "_onward").alias("next")).filter("next is not null")


def day_starts(times: DataFrame, width: int) -> DataFrame:
    """(provider, day): a day starts at the first request more than a day after the last one's start. Steps are doubled
    in each round, so rounds number as the logarithm of the days."""
    first = times.groupBy("provider").agg(F.min("ts_ms").alias("at"))
    step = next_days(times, width)
    # only what is the next of something, or first, can start a day
    step = materialize(step, "step")
    step = materialize(step.join(step.select("provider", F.col("next").alias("at")).union(first).distinct(), ["provider", "at"], "left_semi"), "step")
    days, rows = materialize(first, "days"), 0
    while (now := days.count()) > rows:
        rows = now
        days = materialize(days.union(days.join(step, ["provider", "at"]).select("provider", "next")).distinct(), "days")
        step = materialize(step.join(step.select("provider", F.col("at").alias("next"), F.col("next").alias("then")), ["provider", "next"]).select("provider", "at", F.col("then").alias("next")), "step")
    return days.select("provider", F.col("at").alias("day"))


def anchored_days(requests: DataFrame, width: int = RANGE) -> DataFrame:
    """requests(id, provider, ts_ms, tokens) -> with day, day_requests, day_tokens: of the provider's day, up to each."""
    with scratch() as keep:
        days = day_starts(requests.select("provider", "ts_ms").distinct(), width)
        starts = materialize(days, "starts")
        keep(starts)
    range_ = lambda c: F.floor(F.col(c) / width)
    rows = requests.select("id", "provider", "ts_ms", "tokens").withColumn("_range", range_("ts_ms"))
    # each range begins with the last start before it
    marks = starts.withColumn("_range", range_("day")).groupBy("provider", "_range").agg(F.max("day").alias("last"))
    every = rows.select("provider", "_range").distinct().join(marks, ["provider", "_range"], "left")
    before = Window.partitionBy("provider").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("provider", "_range", F.max("last").over(before).alias("day")).filter("day is not null")
    none = F.lit(None)
    marked = starts.withColumn("_range", range_("day")).unionByName(carried)
    marked = marked.select(none.cast("long").alias("id"), "provider", F.greatest("day", F.col("_range") * width).alias("ts_ms"), none.cast("long").alias("tokens"), "_range", "day")
    sofar = Window.partitionBy("provider", "_range").orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, 0)
    dated = rows.withColumn("day", none.cast("long")).withColumn("own", F.lit(True)).unionByName(marked.withColumn("own", F.lit(False)))
    dated = dated.withColumn("day", F.max("day").over(sofar)).filter("own")
    inside = Window.partitionBy("provider", "_range", "day").orderBy("ts_ms", "id").rowsBetween(Window.unboundedPreceding, 0)
    sums = dated.groupBy("provider", "_range", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("sum"))
    earlier = Window.partitionBy("provider", "day").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("provider", "_range", "day", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("sum"))
    out = dated.withColumns({"k": F.count(F.lit(1)).over(inside), "s": F.sum("tokens").over(inside)}).join(sums, ["provider", "_range", "day"])
    return out.select("id", "provider", "ts_ms", "tokens", "day", (F.col("k") + F.col("n")).alias("day_requests"), (F.col("s") + F.col("sum")).alias("day_tokens"))
