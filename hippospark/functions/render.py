"""Blocks of text that a host shows or injects, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hippospark.functions import text as X
from hippospark.functions.parsing import short_time

# Markers, labels and sizes of the blocks.
TIME_LABEL = "active"
TRIMMED = "\n\n[…reference context trimmed — memory pressure…]"
BUDGET = 10_000
RECAP_TEXT, RECAP_LINES, BANNER_EVENT, CORNERSTONE_TEXT = 240, 6, 120, 300


def memory_line(kind: Column, scene: Column, content: Column, start: Column, end: Column, point: Column) -> Column:
    """One memory with its scene and the time of what it tells."""
    a, b, p = short_time(start), short_time(end), short_time(point)
    tag = F.when(F.coalesce(scene, F.lit("")) != "", F.concat(kind, F.lit("|"), scene)).otherwise(kind)
    at = lambda *parts: F.concat(F.lit(f" ({TIME_LABEL}: "), *parts, F.lit(")"))
    when = F.when(a.isNotNull() & b.isNotNull(), at(a, F.lit(" ~ "), b)).when(a.isNotNull(), at(F.lit("from "), a)).when(b.isNotNull(), at(F.lit("until "), b)).when(p.isNotNull(), at(p))
    return F.concat(F.lit("- ["), tag, F.lit("] "), content, F.coalesce(when, F.lit("")))


def recall_line(kind: Column, text: Column, score: Column, point: Column, associative: Column) -> Column:
    """One recalled fact or event; what came by association is marked."""
    p = short_time(point)
    number = F.format_string("%.2f", score)
    line = F.when(associative, F.concat(F.lit("- ↳ ["), kind, F.lit("·associato] "), text, F.lit(" (associazione: "), number, F.lit(")"))).otherwise(F.concat(F.lit("- ["), kind, F.lit("] "), text, F.lit(" (relevance: "), number, F.lit(")")))
    return F.concat(line, F.when(p.isNotNull(), F.concat(F.lit(f" ({TIME_LABEL}: "), p, F.lit(")"))).otherwise(""))


def cut_tail(text: Column, most: Column) -> Column:
    """At most so many characters, the marker among them."""
    keep = F.greatest(F.lit(0), most - len(TRIMMED))
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substr(text, F.lit(1), keep), F.lit(TRIMMED)))


def composed(stable: Column, dynamic: Column, budget: int = BUDGET) -> Column:
    """Both parts within the budget; the stable one gives way, the dynamic one only where it is too long by itself."""
    a, b, most = F.coalesce(stable, F.lit("")), F.coalesce(dynamic, F.lit("")), F.lit(budget)
    full = F.concat(a, F.lit("\n\n"), b)
    room = most - F.char_length(b) - 2
    both = F.when(F.char_length(full) <= most, full).when(room <= 0, cut_tail(b, most)).otherwise(F.concat(cut_tail(a, room), F.lit("\n\n"), b))
    return F.when(b == "", F.when(a == "", "").otherwise(cut_tail(a, most))).when(a == "", cut_tail(b, most)).otherwise(both)


def _anchored(item: Column) -> Column:
    """A line of an item (type, text, source_message_ids), null without text or anchor."""
    ids = F.filter(item["source_message_ids"], lambda x: F.char_length(x) > 0)
    text = F.substring(F.trim(item["text"]), 1, RECAP_TEXT)
    return F.when((F.size(ids) > 0) & (text != ""), F.concat(F.lit("- ("), item["type"], F.lit(") "), text, F.lit("   [anchor: msg "), F.array_join(ids, ","), F.lit("]")))


def recap(project: Column, day: Column, thread: Column, next_step: Column) -> Column:
    """What a session was about: its last anchored lines and the next step; empty where nothing is anchored."""
    lines = F.filter(F.transform(thread, _anchored), lambda x: x.isNotNull())
    last = F.when(F.size(lines) > RECAP_LINES, F.slice(lines, -RECAP_LINES, RECAP_LINES)).otherwise(lines)
    step = F.regexp_replace(_anchored(next_step), r"^- \([^)]*\) ", "- Prossimo passo: ")
    date = F.substring(day, 1, 10)
    head = F.when(F.coalesce(project, F.lit("")) != "", F.concat(F.lit("DOVE ERAVAMO — "), project, F.lit(" ("), date, F.lit(")"))).otherwise(F.concat(F.lit("DOVE ERAVAMO ("), date, F.lit(")")))
    parts = F.concat(F.array(head, F.lit("")), F.when(step.isNotNull(), F.array(F.lit("PROSSIMO PASSO:"), step, F.lit(""))).otherwise(F.array().cast("array<string>")), F.when(F.size(last) > 0, F.concat(F.array(F.lit("FILO (ricostruito dalle nostre parole reali):")), last)).otherwise(F.array().cast("array<string>")))
    return F.when(step.isNull() & (F.size(last) == 0), "").otherwise(F.regexp_replace(F.array_join(parts, "\n"), r"\s+$", ""))


def banner(project: Column, persona: Column, scenes: Column, event: Column, warning: Column) -> Column:
    """The first line of a session's first reply; a warning comes first, what is missing is left out."""
    some = lambda x: F.coalesce(x, F.lit("")) != ""
    short = lambda x, n: F.substring(X.escaped_tags(x), 1, n)
    memory = F.array_join(F.filter(F.array(F.when(persona, "persona ✓"), F.when(scenes > 0, F.concat(scenes.cast("string"), F.lit(" scene")))), lambda x: x.isNotNull()), " · ")
    parts = F.array(
        F.when(some(warning), F.concat(F.lit("⚠️ "), short(warning, 90))), F.lit("Sul pezzo"), F.when(some(project), short(project, 80)), F.lit("ricordo chi sei"),
        F.when(some(event), F.concat(F.lit("ultimo: "), short(event, BANNER_EVENT))), F.when(memory != "", F.concat(F.lit("memoria: "), memory)),
    )
    line = F.concat(F.lit("🧠 "), F.array_join(F.filter(parts, lambda x: x.isNotNull()), " · "))
    return F.concat(F.lit("<session-open-banner>\nFIRST TURN OF THIS SESSION — begin your very first reply with this exact one-line banner, then answer normally:\n"), line, F.lit("\n</session-open-banner>"))


def cornerstone_block(contents: Column) -> Column:
    """Distinctive memories as a block; empty without any."""
    lines = F.transform(contents, lambda c: F.concat(F.lit("- "), X.escaped_tags(F.substring(F.trim(c), 1, CORNERSTONE_TEXT))))
    head = "Distinctive peak memories — rare, isolated events that human memory resurfaces unbidden (von Restorff effect). Reference for context; these are NOT current tasks:"
    block = F.array_join(F.concat(F.array(F.lit("<cornerstone-memories>"), F.lit(head)), lines, F.array(F.lit("</cornerstone-memories>"))), "\n")
    return F.when(F.size(contents) == 0, "").otherwise(block)


def scene_entry(file: Column, heat: Column, updated: Column, summary: Column) -> Column:
    """One scene of the navigation; flames by heat."""
    flames = F.when(heat >= 1000, " 🔥🔥🔥🔥🔥").when(heat >= 500, " 🔥🔥🔥🔥").when(heat >= 200, " 🔥🔥🔥").when(heat >= 100, " 🔥🔥").when(heat >= 50, " 🔥").otherwise("")
    changed = F.when(F.coalesce(updated, F.lit("")) != "", F.concat(F.lit(" | **updated**: "), updated)).otherwise("")
    return F.concat(F.lit("### Path: scene_blocks/"), file, F.lit("\n**heat**: "), heat.cast("string"), flames, changed, F.lit("\nSummary: "), summary)
