"""Windowed views of message logs."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hippospark.functions.storage import saved


def numbered(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """rows with their place in an order, from 0, without a window over all of them: partitions of ranges are numbered each, from the
    counts of those before."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the lower 33 bits of Spark's id count within a partition
    held = saved(parts.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    counts = held.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return held.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def running(rows: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """rows with the sum of a value up to each, in an order, without a window over all of them: ranges are summed each, from the sums of
    those before."""
    held = saved(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "running")
    sums = held.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_within", "_before")


def incremental(rows: DataFrame, at: str, seq: str, after: int, after_seq: int, limit: int) -> DataFrame:
    """Rows past a composite cursor, oldest first."""
    return rows.where((F.col(at) > after) | ((F.col(at) == after) & (F.col(seq) > after_seq))).orderBy(at, seq).limit(limit)


def next_cursor(rows: DataFrame, at: str, seq: str) -> DataFrame:
    """The composite cursor after these rows: their latest time and the largest number at it; nulls without rows."""
    return rows.agg(F.max(F.struct(at, seq)).alias("c")).select(F.col(f"c.{at}").alias(at), F.col(f"c.{seq}").alias(seq))


def context_tokens(messages: DataFrame, session: str, tokens: str, system: int = 0, prompt: int = 0) -> DataFrame:
    """What a context holds: its messages' tokens, half a token a message for their frames, the system's and the prompt's."""
    return messages.groupBy(session).agg((F.sum(tokens) + F.ceil(0.5 * F.count("*")) + system + prompt).cast("long").alias("tokens"))


def keyset(rows: DataFrame, key: str, after: object, limit: int) -> DataFrame:
    """S4, S5."""
    return rows.where(F.col(key) > after).orderBy(key).limit(limit)


def rounds(rows: DataFrame, session: str, order: str, role: str = "role") -> DataFrame:
    """A round begins where a user follows an assistant."""
    w = Window.partitionBy(session).orderBy(order)
    begins = (F.lag(role).over(w) == "assistant") & (F.col(role) == "user")
    return rows.withColumn("round", F.sum(F.when(begins, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def message_windows(rows: DataFrame, session: str, order: str, size: int = 10, background: int = 5) -> DataFrame:
    """Tumbling windows of messages with how many earlier ones serve as background."""
    place = F.row_number().over(Window.partitionBy(session).orderBy(order)) - 1
    rows = rows.withColumn("window", F.floor(place / size).cast("long"))
    g = rows.groupBy(session, "window").agg(F.count("*").alias("messages"), F.min(order).alias("first"), F.max(order).alias("last"))
    return g.withColumn("background", F.least(F.lit(background), F.col("window") * size).cast("long"))


def windows_with_background(rows: DataFrame, session: str, order: str, size: int = 10, background: int = 5) -> DataFrame:
    """Each message in its window, and as background in the next one if it is among the last before it: window, part."""
    place = F.row_number().over(Window.partitionBy(session).orderBy(order)) - 1
    total = F.count("*").over(Window.partitionBy(session))
    rows = rows.withColumns({"_at": place, "_last": F.floor((total - 1) / size)})
    window = F.floor(F.col("_at") / size).cast("long")
    own = F.struct(window.alias("window"), F.lit("new").alias("part"))
    later = F.struct((window + 1).alias("window"), F.lit("background").alias("part"))
    also = (F.col("_at") % size >= size - background) & (window < F.col("_last"))
    return rows.withColumn("w", F.explode(F.when(also, F.array(own, later)).otherwise(F.array(own)))).select(*[c for c in rows.columns if not c.startswith("_")], "w.window", "w.part")


def last_with_background(rows: DataFrame, session: str, order: str, size: int = 10, background: int = 5) -> DataFrame:
    """The last messages of each session and a few before them as background: part."""
    back = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return rows.withColumn("_back", back).where(F.col("_back") <= size + background).withColumn("part", F.when(F.col("_back") <= size, "new").otherwise("background")).drop("_back")


def recent_unique(rows: DataFrame, session: str, order: str, text: str, most: int) -> DataFrame:
    """The newest distinct texts at their last place."""
    g = rows.groupBy(session, text).agg(F.max(order).alias(order))
    return g.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))).where(F.col("place") <= most)


def prefix_budget(rows: DataFrame, session: str, order: str, tokens: str, ratio: float) -> DataFrame:
    """How many leading messages must go until they hold `ratio` of all tokens."""
    w = Window.partitionBy(session).orderBy(order)
    rows = rows.withColumn("upto", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum(tokens).over(Window.partitionBy(session)))
    before = F.col("upto") - F.col(tokens) < F.col("total") * ratio
    return rows.groupBy(session).agg(F.count_if(before).alias("drop"), F.max("total").alias("total"))


def cascade_candidates(messages: DataFrame, entries: DataFrame, session: str, order: str, ratio: float = 0.7) -> DataFrame:
    """O2: tool results among the first 70 % of a session's messages that have an entry (score, 5 where it has none) and are not yet replaced.
    messages: session, order, tool_call_id, replaced, length; entries: tool_call_id, score, summary_length."""
    total = F.count("*").over(Window.partitionBy(session))
    place = F.row_number().over(Window.partitionBy(session).orderBy(order))
    early = messages.withColumns({"_place": place, "_scan": F.floor(total * F.lit(Decimal(str(ratio))))}).where((F.col("_place") <= F.col("_scan")) & ~F.col("replaced") & F.col("tool_call_id").isNotNull())
    return early.drop("_place", "_scan").join(entries.select("tool_call_id", F.coalesce("score", F.lit(5)).alias("score"), "summary_length"), "tool_call_id")


def replaced_by_cascade(candidates: DataFrame, session: str, score: str = "score", need: int = 10, high: int = 7, low: int = 1) -> DataFrame:
    """The candidates that their session's threshold takes: it falls from 7 until ten messages are replaced; where a summary is
    longer than its message, the message stays and does not count."""
    fit = candidates.where("summary_length <= length")
    t = score_cascade(fit, session, score, need, high, low)
    return fit.join(t.select(session, "threshold"), session).where(F.col(score) >= F.col("threshold"))


def score_cascade(rows: DataFrame, session: str, score: str, need: int = 10, high: int = 7, low: int = 1) -> DataFrame:
    """The highest threshold at which enough rows score that much; the lowest where none does."""
    n = rows.where(F.col(score) >= low).groupBy(session, F.least(F.col(score), F.lit(high)).alias("step")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(session).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0))
    g = n.withColumn("upto", upto).groupBy(session).agg(F.max(F.when(F.col("upto") >= need, F.col("step"))).alias("step"), F.sum("n").alias("n"))
    return g.select(session, F.coalesce("step", F.lit(low)).alias("threshold"), "n")


def health(messages: DataFrame, events: DataFrame, session: str, now: int) -> DataFrame:
    """A2: sessions of the last three days whose extraction lags by more than 36 hours. Times in seconds."""
    m = messages.groupBy(session).agg(F.max("at").alias("last_message"), F.min("at").alias("first_message"))
    e = events.groupBy(session).agg(F.max("at").alias("last_event"))
    j = m.join(e, session, "left").withColumn("lag", F.col("last_message") - F.coalesce("last_event", "first_message"))
    recent = F.col("last_message") >= now - 3 * 86_400
    return j.select(session, "last_message", F.round(F.col("lag") / 3600).cast("long").alias("lag_hours"), (recent & (F.col("lag") > 36 * 3600)).alias("stale"))


def accuracy(answers: DataFrame, kind: str = "question_type") -> DataFrame:
    """Share of correct answers of each kind and of all."""
    every = answers.select(F.explode(F.array(F.col(kind), F.lit("overall"))).alias(kind), "correct")
    return every.groupBy(kind).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("correct"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


def trigger_totals(runs: DataFrame, session: str, order: str, stage: str, tokens: str, cost: int = 80) -> DataFrame:
    """With each run what its session has saved so far, net of a run's cost, and how often the stage has run."""
    upto = lambda *keys: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    saved_ = F.greatest(F.col(tokens) - cost, F.lit(0))
    return runs.select(session, order, stage, F.sum(saved_).over(upto(session)).alias("saved_so_far"), F.count("*").over(upto(session, stage)).alias("runs_so_far"))


def stepped(rows: DataFrame, session: str, order: str, base_ms: int, step: int = 1000) -> DataFrame:
    """Times of one step from message to message of a session."""
    at = F.row_number().over(Window.partitionBy(session).orderBy(order)) - 1
    return rows.withColumn("ts_ms", (F.lit(base_ms) + step * at).cast("long"))


def by_session(messages: DataFrame, session: str = "session_key", ts: str = "ts_ms", id_col: str = "record_id") -> DataFrame:
    """A3: per session the number of its messages, their ids in the order of time, and the first time."""
    g = messages.groupBy(session).agg(F.count("*").alias("messages"), F.array_sort(F.collect_list(F.struct(ts, id_col))).alias("_m"), F.min(ts).alias("first_ts"))
    return g.select(session, "messages", F.transform("_m", lambda x: x[id_col]).alias("ids"), "first_ts")


def last_of_role(messages: DataFrame, session: str, order: str, role: str = "user") -> DataFrame:
    """The place of each session's last message of a role; sessions without one have none."""
    return messages.where(F.col("role") == role).groupBy(session).agg(F.max(order).alias("last"))


def last_boundary(rows: DataFrame, session: str, order: Sequence[str | Column], mark: Column) -> DataFrame:
    """With each row the latest boundary of its session up to it: the last value of mark that is not null. No join, one sort."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("boundary", F.last(mark, ignorenulls=True).over(w))


def score_histogram(rows: DataFrame, score: str, step: float = 1.0, *by: str) -> DataFrame:
    """How many scores lie in each step (its lower end), and in it or above. As many rows as steps pass a window."""
    n = rows.where(F.col(score).isNotNull()).groupBy(*by, (F.floor(F.col(score) / step) * step).alias("step")).agg(F.count("*").alias("n"))
    return n.withColumn("or_above", F.sum("n").over(Window.partitionBy(*by).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)))
