"""Compression of long contexts."""

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hippospark.operators.clusters import mode_of


def route(used: Column, window: int) -> Column:
    """O1."""
    return F.when(used >= 0.95 * window, "emergency").when(used >= 0.85 * window, "aggressive").when(used >= 0.5 * window, "mild").otherwise("none")


def plain_id(tool_call_id: Column) -> Column:
    """O5."""
    return F.regexp_replace(tool_call_id, "_", "")


def known_ids(entries: DataFrame, state: str) -> DataFrame:
    """Tool-call ids whose entry is in a state (confirmed, deleted), as they are and without underscores."""
    e = entries.where((F.col("offloaded") == state) & (F.coalesce("tool_call_id", F.lit("")) != ""))
    return e.select(F.explode(F.array_distinct(F.array("tool_call_id", plain_id(F.col("tool_call_id"))))).alias("tool_call_id")).distinct()


def backfill_nodes(entries: DataFrame, mapping: DataFrame, canvas: str = "session_key") -> DataFrame:
    """A mapped node wins; waiting entries get the commonest mapped node of their canvas, ties to the smallest, else one derived
    from the canvas."""
    j = entries.join(mapping.withColumnRenamed("node_id", "_mapped"), "tool_call_id", "left")
    common = mode_of(j, canvas, "_mapped").select(canvas, F.col("_mapped").alias("_common"))
    j = j.join(common, canvas, "left")
    waits = F.col("node_id") == "wait"
    return j.withColumn("node_id", F.coalesce("_mapped", F.when(waits, F.coalesce("_common", F.concat(F.col(canvas), F.lit("-N1")))), "node_id")).drop("_mapped", "_common")


def without_heartbeats(messages: DataFrame, marker: str = "heartbeat") -> DataFrame:
    """Without the calls of heartbeats and their results; an assistant's message that has nothing else goes. messages: session_key,
    idx, role, blocks (array of type, tool_call_id, text)."""
    b = messages.select("session_key", "idx", "role", F.posexplode("blocks").alias("at", "b"))
    beats = b.where((F.col("b.type") == "tool_use") & F.lower("b.text").contains(marker)).select("session_key", F.col("b.tool_call_id").alias("_id")).distinct()
    kept = b.join(beats, (b["session_key"] == beats["session_key"]) & (F.col("b.tool_call_id") == F.col("_id")), "left_anti")
    out = kept.groupBy("session_key", "idx", "role").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "b"))), lambda x: x["b"]).alias("blocks"))
    return out


def canvas_triggers(entries: DataFrame, now: int, least: int = 4, elapsed: int = 300, retry: int = 120) -> DataFrame:
    """Per session whether its canvases are to be drawn: entries without a node, or waiting for so long, that belong to a long
    task's canvas, once per tool call; by their number or by the time since the last drawing.

    entries: session_key, idx, canvas (null outside long tasks), node_id, tool_call_id, at, last_drawn (both in seconds)."""
    open_ = F.col("node_id").isNull() | ((F.col("node_id") == "wait") & (now - F.col("at") >= retry))
    e = entries.where(open_ & F.col("canvas").isNotNull())
    once = e.groupBy("session_key", "canvas", F.coalesce("tool_call_id", F.concat(F.lit("#"), "idx")).alias("call")).agg(F.min("idx").alias("idx"))
    g = e.groupBy("session_key").agg(F.count_if(F.col("node_id").isNull()).alias("nulls"), F.max("last_drawn").alias("last_drawn"), F.min(F.when(F.col("node_id").isNull(), F.col("at"))).alias("oldest"), F.count_if(F.col("node_id") == "wait").alias("waits"))
    g = g.join(once.groupBy("session_key").agg(F.count("*").alias("entries"), F.count_distinct("canvas").alias("canvases")), "session_key")
    first = F.col("last_drawn").isNull() & ((F.col("waits") > 0) | (now - F.col("oldest") >= elapsed))
    fire = (F.col("nulls") >= least) | F.coalesce(now - F.col("last_drawn") >= elapsed, F.lit(False)) | F.coalesce(first, F.lit(False))
    return g.select("session_key", "nulls", "entries", "canvases", fire.alias("fire"))


def history_canvases(canvases: DataFrame, deleted: DataFrame, window: int, ratio: float = 0.2) -> DataFrame:
    """Per session the canvases of deleted nodes, newest first, each in full while it fits into what is left of the budget, else
    its short form, else not at all. canvases: session_key, name, active, full_tokens, meta_tokens; deleted: session_key, node_id."""
    prefix = lambda c: F.regexp_extract(c, "^([^-]*)", 1)
    d = deleted.where("node_id is not null").select("session_key", prefix(F.col("node_id")).alias("_p")).where("_p <> ''").distinct()
    c = canvases.where(~F.col("active")).withColumn("_p", prefix(F.col("name"))).join(d, ["session_key", "_p"], "left_semi")
    g = c.groupBy("session_key").agg(F.reverse(F.array_sort(F.collect_list(F.struct("name", "full_tokens", "meta_tokens")))).alias("all"))
    budget = int(window * ratio)
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<name:string,form:string,tokens:bigint>>").alias("picked"))

    def step(acc: Column, x: Column) -> Column:
        full, meta = x["full_tokens"].cast("long"), x["meta_tokens"].cast("long")
        take = lambda form, n: F.struct((acc["used"] + n).alias("used"), F.concat(acc["picked"], F.array(F.struct(x["name"].alias("name"), F.lit(form).alias("form"), n.alias("tokens")))).alias("picked"))
        return F.when(acc["used"] + full <= budget, take("full", full)).when(acc["used"] + meta <= budget, take("meta", meta)).otherwise(acc)

    picked = g.select("session_key", F.aggregate("all", start, step, lambda a: a["picked"]).alias("p"))
    return picked.select("session_key", F.explode("p").alias("p")).select("session_key", "p.*")


def reclaim(logs: DataFrame, refs: DataFrame, canvases: DataFrame, registry: DataFrame, now: int, days: int) -> DataFrame | None:
    """What a retention of some days removes: kind and name; None below three days, which are refused. logs: name, changed; refs: name,
    changed, used (by an entry); canvases: folder, name, changed, active; registry: name, updated, here."""
    from hippospark.sources import sinks

    if days < 3:
        return None
    cutoff = now - days * 86_400
    out = sinks.expired(logs, "changed", cutoff).select(F.lit("log").alias("kind"), "name")
    out = out.unionByName(sinks.orphans(refs, refs.where("used"), "name", "changed", cutoff).select(F.lit("ref").alias("kind"), "name"))
    gone = sinks.canvases_to_delete(canvases.drop("active"), "folder", "changed", "name", canvases.where("active").select("folder", "name"), cutoff)
    out = out.unionByName(gone.select(F.lit("canvas").alias("kind"), "name"))
    stays = sinks.pruned(registry, "updated", cutoff, registry.where("here"), "name")
    return out.unionByName(registry.join(stays.select("name"), "name", "left_anti").select(F.lit("registry").alias("kind"), "name"))


def recent_turns(messages: DataFrame, turns: int = 5, answers: int = 3, clip: int = 400) -> DataFrame:
    """The last turns, each a user text of over 5 characters with its first answers of over 10."""
    w = Window.partitionBy("session_key").orderBy("idx")
    user = (F.col("role") == "user") & (F.char_length("text") > 5)
    t = messages.withColumn("turn", F.sum(F.when(user, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("turn > 0")
    t = t.withColumn("last", F.max("turn").over(Window.partitionBy("session_key"))).where(F.col("turn") > F.col("last") - turns)
    answer = (F.col("role") == "assistant") & (F.char_length("text") > 10)
    t = t.where(user | answer).withColumn("place", F.sum(F.when(answer, 1).otherwise(0)).over(Window.partitionBy("session_key", "turn").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)))
    return t.where((F.col("role") == "user") | (F.col("place") <= answers)).select("session_key", "turn", "idx", "role", F.substring("text", 1, clip).alias("text"))


def aggressive(messages: DataFrame, budget: int, ratio: float = 0.4, keep: int = 2) -> DataFrame:
    """O3: per session delete leading messages with a share of all tokens, again and again until the budget is met: at least two stay, a
    tool's results go with its call, and nothing from the last user message on goes.

    messages: session_key, idx, role, tool_call_id (of results), tokens. Sequential by nature; a session's messages are one group.
    """

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx").reset_index(drop=True)
        tokens, n = rows.tokens.tolist(), len(rows)
        result = (rows.role == "tool").tolist()
        users = rows.index[rows.role == "user"]
        last, gone, total = int(users[-1]) if len(users) else n, 0, sum(tokens)
        while total >= budget and n - gone > keep:
            most, want, got, cut = n - gone - keep, total * ratio, 0, 0
            while cut < most and got < want:
                got += tokens[gone + cut]
                cut += 1
            if got < want and cut:
                cut = max(cut, min(max(1, -(-int((n - gone) * ratio * 50) // 100)), most))
            while cut and gone + cut < n and result[gone + cut]:
                cut += 1
            cut = min(cut, last - gone)
            if cut <= 0:
                break
            total -= sum(tokens[gone : gone + cut])
            gone += cut
        rows["deleted"] = rows.index < gone
        return rows[["session_key", "idx", "deleted"]]

    return messages.groupBy("session_key").applyInPandas(each, "session_key string, idx long, deleted boolean")


def tool_groups(rows: pd.DataFrame) -> list[list[int]]:
    """What may go from a context whose head must stay, as lists of places: calls with their results, results without a call, other
    answers. The first message, the last user's and, but for calls, the last one stay."""
    n, role, call = len(rows), rows.role.tolist(), rows.tool_call_id.tolist()
    users = [i for i in range(n) if role[i] == "user"]
    free = [i for i in range(1, n) if not users or i != users[-1]]
    groups, taken = [], set()
    for i in free:
        if role[i] == "assistant" and isinstance(call[i], str):
            result = next((j for j in free if j > i and j not in taken and role[j] == "tool" and call[j] == call[i]), None)
            groups.append([i] if result is None else [i, result])
            taken.update(groups[-1])
    for kind in ("tool", "assistant"):
        groups += [[i] for i in free if i not in taken and i < n - 1 and role[i] == kind]
    return groups


def emergency(messages: DataFrame, budget: int, keep: int = 4) -> DataFrame:
    """Per session the front goes in cuts of the excess's share (half at most), past tool results and never past the last user's
    message; once that message leads, the largest tool groups go. messages: session_key, idx, role, tool_call_id, tokens.

    Sequential by nature; a session's messages, one context, are one group.
    """

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx").reset_index(drop=True)
        left = rows
        while len(left) > keep and (total := int(left.tokens.sum())) > budget:
            n, role = len(left), left.role.tolist()
            cut = min(max(1, math.ceil(n * min(0.5, (total - budget) / total))), n - keep)
            while cut < n - keep and role[cut] == "tool":
                cut += 1
            users = [i for i in range(n) if role[i] == "user"]
            cut = min(cut, users[-1]) if users else cut
            if cut:
                left = left.iloc[cut:]
                continue
            groups = tool_groups(left)
            tokens = [int(left.tokens.iloc[g].sum()) for g in groups]
            if not groups or max(tokens) <= 0 or n - len(best := groups[tokens.index(max(tokens))]) < keep:
                break
            left = left.drop(left.index[best])
        rows["deleted"] = ~rows.index.isin(left.index)
        return rows[["session_key", "idx", "deleted"]]

    return messages.groupBy("session_key").applyInPandas(each, "session_key string, idx long, deleted boolean")


def repaired_json(rows: DataFrame, col: str) -> DataFrame:
    """Control characters inside strings are escaped, others dropped, so that the text parses.

    Strings are found by one expression and their control characters replaced by another; both run once per text."""
    literal, control, other = re.compile(r'"(?:[^"\\]|\\.)*"?', re.DOTALL), re.compile(r"[\x00-\x1f]"), re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
    short = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}

    def fix(text: str) -> str:
        out, at = [], 0
        for m in literal.finditer(text):
            out += [other.sub("", text[at : m.start()]), control.sub(lambda c: short.get(c.group(), ""), m.group())]
            at = m.end()
        return "".join(out) + other.sub("", text[at:])

    @F.pandas_udf("string")
    def repair(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: None if x is None else fix(x))

    return rows.withColumn(col, repair(col))
