"""Parsers and normalisers of hosts' strings as Column builders: keys, versions, stamps, canvases, model answers, query texts."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from hippospark.functions import scalar as S
from hippospark.functions.text import ascii_bounds

# Synonyms of fact attributes, by the attribute that they stand for.
ATTRIBUTE_SYNONYMS = {
    "status": ("stato", "stato_attuale", "current_status"),
    "value": ("valore", "valore_attuale", "valore_corrente", "current_value"),
    "description": ("descrizione", "significato"),
    "definition": ("definizione",),
    "issue": ("problema", "problem", "problematica", "issues", "ha_problema"),
    "role": ("ruolo",),
    "usage": ("uso", "utilizzo", "use", "usa"),
    "type": ("tipo",),
    "function": ("funzione", "funzionamento", "funziona"),
    "functionality": ("funzionalita", "funzionalità", "funzionalit"),
    "version": ("versione", "versione_corrente", "versione_attuale", "current_version"),
    "solution": ("soluzione", "soluzione_proposta"),
    "resolution": ("risoluzione",),
    "behavior": ("comportamento", "current_behavior"),
    "action": ("azione",),
    "update": ("aggiornamento", "aggiornato", "updated"),
    "decision": ("decisione",),
    "content": ("contenuto",),
    "language": ("lingua", "lingue", "languages"),
    "location": ("ubicazione",),
    "address": ("indirizzo",),
    "integration": ("integrazione",),
    "size": ("dimensione", "dimensioni"),
    "duration": ("durata",),
    "importance": ("importanza", "importancia", "rilevanza"),
    "creation": ("creazione",),
    "cause": ("causa",),
    "requirement": ("requisito", "requisiti", "requirements", "richiesto"),
    "error": ("errore",),
    "verification": ("verifica",),
    "tool": ("strumento", "strumenti", "tools"),
    "architecture": ("architettura",),
    "configuration": ("configurazione",),
    "implementation": ("implementazione",),
    "existence": ("esistenza", "exists"),
    "availability": ("disponibilita", "disponibilità", "disponibilit"),
    "result": ("risultato",),
    "request": ("richiesta",),
    "objective": ("obiettivo", "obiettivi"),
    "phase": ("fase",),
    "approach": ("approccio",),
    "category": ("categoria",),
    "command": ("comando",),
    "rule": ("regola", "rules"),
    "procedure": ("procedura",),
    "environment": ("ambiente",),
    "level": ("livello",),
    "cost": ("costo", "prezzo", "price", "costo_reale", "importo"),
    "change": ("changes",),
    "commit": ("commits",),
    "feature": ("features",),
    "test": ("tests",),
    "component": ("components",),
}
# Attributes that a persona may show, by section; prefixes and suffixes that belong to one.
PERSONA_SECTIONS = {
    "identity": ("role", "occupation", "job_title", "title", "identity", "location", "timezone"),
    "languages": ("language", "languages", "spoken_language"),
    "preferences": ("os", "operating_system", "platform", "stack", "tech_stack", "framework", "tooling", "tool", "editor", "preference", "language_preference"),
    "process": ("process", "workflow", "working_style", "rule", "convention", "communication_style"),
}
PROCESS_PREFIXES = ("rule_", "process_", "workflow_", "convention_", "working_style_", "communication_style_")
LOCATION_SUFFIXES = ("_location", "_path", "_file", "_dir")
# Tools that name a file, triggers and session keys that are no conversation, patterns of credentials.
FILE_TOOLS = ("Read", "Edit", "Write", "MultiEdit", "NotebookEdit")
SKIPPED_TRIGGERS = ("cron", "heartbeat", "automation", "schedule")
SECRET_WORDS = r"(?i)\b(secret|segreto|password|api[_\s-]?key|apikey|token|credential|credenziali)\b"
CREDENTIAL_TOKEN = r"\b[A-Z][A-Z0-9]{2,}-[A-Z0-9]{2,}(?:-[A-Z0-9]+)*-?\d{1,}\b"
# Origins of a memory that are trusted, and all that a stamp may hold.
TRUSTED_ORIGINS = ("user_confirmed", "authoritative_source")
ORIGINS = ("conversation", "tool_output", "user_confirmed", "authoritative_source")
STAMP = "struct<origin:string,trust:string,confirmed_by:string,confirmed_at:string,source_message_ids:array<string>,stakes:string,stakes_domain:string,gate_state:string,rejected_at:string,schema:int>"
#: Words that do not tell entities apart.
NAME_STOP_WORDS = ("the", "and", "for", "del", "dei", "della", "delle", "degli", "gli", "con", "per", "una", "uno", "che")


def canonical_attribute(name: Column) -> Column:
    """Trimmed, lower case, a synonym's canonical attribute; unknown ones stay."""
    key = F.lower(S.stripped(name))
    known = F.create_map(*(F.lit(x) for canonical, words in ATTRIBUTE_SYNONYMS.items() for word in words for x in (word, canonical)))
    return F.coalesce(F.try_element_at(known, key), key)


def persona_section(name: Column) -> Column:
    """The section of an attribute, null where it must not be shown: exact, then by prefix, then by suffix."""
    key = F.regexp_replace(S.stripped(F.lower(S.nfkc(name))), f"{S.SPACE}+", "_")
    known = F.create_map(*(F.lit(x) for section, words in PERSONA_SECTIONS.items() for word in words for x in (word, section)))
    prefix = key.rlike("^(" + "|".join(PROCESS_PREFIXES) + ")")
    return F.coalesce(F.try_element_at(known, key), F.when(prefix, "process").when(key.rlike("(" + "|".join(LOCATION_SUFFIXES) + ")$"), "credentials"))


def file_touched(tool: Column, path: Column) -> Column:
    """The file of a tool event, with forward slashes; null for tools that name none."""
    return F.when(tool.isin(*FILE_TOOLS) & (F.char_length(path) > 0), F.translate(path, "\\", "/"))


def looks_secret(text: Column) -> Column:
    """A word for secrets, or a token shaped like a credential."""
    return F.coalesce(text.rlike(ascii_bounds(SECRET_WORDS)) | text.rlike(ascii_bounds(CREDENTIAL_TOKEN)), F.lit(False))


def skipped_session(key: Column, trigger: Column, patterns: Sequence[str] = ()) -> Column:
    """Sessions of the host itself, of triggers that no one talks to, or of a glob pattern (* only, found anywhere)."""
    own = key.contains(":memory-scene-extract-") | key.contains(":subagent:") | key.startswith("temp:")
    idle = F.coalesce(F.lower(trigger).isin(*SKIPPED_TRIGGERS), F.lit(False)) | key.rlike("(?i):(cron|heartbeat):")
    out = own | idle
    for glob in patterns:
        out = out | key.rlike(".*".join(re.escape(x) for x in glob.split("*")))
    return F.coalesce(out, F.lit(False))


def session_parts(key: Column) -> Column:
    """Struct of agent and session of `agent:<name>:<id>`, null for others; a worker's number joins the agent; signs that no
    path may hold become underscores."""
    plain = lambda x: F.regexp_replace(F.regexp_replace(x, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"\.{2,}", "_")
    agent, session = F.regexp_extract(key, r"(?s)^agent:([^:]+):(.+)$", 1), F.regexp_extract(key, r"(?s)^agent:([^:]+):(.+)$", 2)
    worker = F.regexp_extract(session, r"swebench-w(\d+)", 1)
    named = F.when(worker != "", F.concat(agent, F.lit("-w"), worker)).otherwise(agent)
    return F.when(session != "", F.struct(plain(named).alias("agent"), plain(session).alias("session")))


def version_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the three numbers of x.y.z."""
    numbers = lambda v: F.transform(F.slice(F.split(v, r"\."), 1, 3), lambda x: x.cast("int"))
    return F.when(numbers(a) < numbers(b), -1).when(numbers(a) > numbers(b), 1).otherwise(0)


def millis_or(text: Column, now_ms: int) -> Column:
    """Epoch milliseconds of a time, now where it is unreadable or not after 1970."""
    ms = F.unix_millis(F.try_to_timestamp(text))
    return F.when(ms > 0, ms).otherwise(F.lit(now_ms)).cast("long")


def short_time(text: Column) -> Column:
    """Date, or date and minutes unless they are 00:00; null where there is none."""
    pattern = r"^(\d{4}-\d{2}-\d{2})(?:T(\d{2}:\d{2})(?::\d{2})?)?"
    day, minute = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(day != "", F.when(minute.isin("", "00:00"), day).otherwise(F.concat(day, F.lit(" "), minute)))


def trust_of(origin: Column) -> Column:
    """M43."""
    return F.when(origin.isin(*TRUSTED_ORIGINS), "trusted").otherwise("unverified")


def provenance(json: Column, stored: dict[str, str] | None = None) -> Column:
    """The stamp of a JSON text with its trust derived again from its origin; the default stamp where it does not hold. stored: what
    the texts call an origin, and its name here (for a user's confirmation, whatever word a store has for it)."""
    x = F.from_json(json, STAMP, {"mode": "PERMISSIVE"})
    for word, own in (stored or {}).items():
        x = x.withField("origin", F.when(x["origin"] == word, own).otherwise(x["origin"]))
    fine = F.coalesce(x["origin"].isin(*ORIGINS) & x["trust"].isin("unverified", "trusted") & F.coalesce(x["schema"], F.lit(1)).isin(1, 2) & F.coalesce(x["gate_state"], F.lit("clear")).isin("clear", "pending_confirmation", "rejected"), F.lit(False))
    ids = F.when(fine, F.coalesce(x["source_message_ids"], F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    keep = lambda name: F.when(fine, x[name])
    return F.struct(
        F.when(fine, x["origin"]).otherwise("conversation").alias("origin"), F.when(fine, trust_of(x["origin"])).otherwise("unverified").alias("trust"), keep("confirmed_by").alias("confirmed_by"), keep("confirmed_at").alias("confirmed_at"), ids.alias("source_message_ids"),
        keep("stakes").alias("stakes"), keep("stakes_domain").alias("stakes_domain"), keep("gate_state").alias("gate_state"), keep("rejected_at").alias("rejected_at"), F.when(fine, F.coalesce(x["schema"], F.lit(1))).otherwise(1).alias("schema"),
    )


def gate_state(stamp: Column) -> Column:
    """Clear where a stamp has none."""
    return F.coalesce(stamp["gate_state"], F.lit("clear"))


class ChunkOptions(NamedTuple):
    size: int
    overlap: int
    most: int


def chunk_options(size: float | None = None, overlap: float | None = None, most: float | None = None, largest: int = 8000) -> ChunkOptions:
    """Sizes from 1 to `largest`, an overlap below the size, one chunk at least."""
    whole = lambda x, other: other if x is None or x != x or x in (float("inf"), float("-inf")) else int(x // 1)
    n = min(largest, max(1, whole(size, 2000)))
    return ChunkOptions(n, min(max(0, whole(overlap, 200)), n - 1), max(1, whole(most, 50)))


def fts_query(text: Column) -> Column:
    """An OR of quoted words; null without any."""
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.when(F.size(words) > 0, F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR "))


def extract_words(text: Column) -> Column:
    """Latin words of two characters or more, and single East Asian characters with their neighbours' pairs."""
    latin = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))
    signs = F.regexp_extract_all(text, F.lit(r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"), F.lit(0))
    pairs = F.when(F.size(signs) > 1, F.zip_with(F.slice(signs, F.lit(1), F.size(signs) - 1), F.slice(signs, F.lit(2), F.size(signs) - 1), lambda x, y: F.concat(x, y))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(latin, signs, pairs))


def utf16_length(text: Column) -> Column:
    return F.char_length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10ffff}]"))


def token_count(text: Column, vocabulary: str | None = None, pattern: str | None = None) -> Column:
    """Tokens by a byte-pair vocabulary (a file of ranks, read by each worker); without one a quarter of the UTF-16 length."""
    if vocabulary is None:
        return F.coalesce(F.ceil(utf16_length(text) / 4), F.lit(0)).cast("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coding = tiktoken.Encoding("own", pat_str=pattern or r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=ranks, special_tokens={})
        for t in texts:
            yield t.map(lambda x: 0 if x is None else len(coding.encode_ordinary(x)))

    return F.pandas_udf(count, "long")(text)


def name_tokens(name: Column) -> Column:
    """Distinct lower-case tokens of three characters or more, and all numbers, without stop words."""
    raw = F.regexp_extract_all(F.lower(name), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.filter(raw, lambda t: ((F.char_length(t) >= 3) & ~t.isin(*NAME_STOP_WORDS)) | t.rlike("^[0-9]+$")))


def name_similarity(a: Column, b: Column) -> Column:
    """1 for names that are equal in normal form, else Jaccard of their tokens."""
    plain = lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain(a) == plain(b), F.lit(1.0)).otherwise(S.jaccard(name_tokens(a), name_tokens(b)))


def trigger_key(files: Column, signatures: Column, task: Column) -> Column:
    """One text for equal triggers."""
    return F.to_json(F.struct(F.array_sort(files).alias("files"), F.array_sort(signatures).alias("error_signatures"), task.alias("task_type")))


def canvas_meta(content: Column) -> Column:
    """Goal and times of a canvas's header, counts by status, and its last two nodes."""
    head = F.from_json(F.concat(F.lit("{"), F.regexp_extract(content, r"^%%\{\s*(.*?)\s*\}%%", 1), F.lit("}")), "struct<taskGoal:string,createdTime:string,updatedTime:string>")
    count = lambda word: F.regexp_count(content, F.lit(rf"(?i)status:\s*{word}"))
    ids, texts = F.regexp_extract_all(content, F.lit(r'(\d{3}-N\d+)\["([^"]*?)"\]'), F.lit(1)), F.regexp_extract_all(content, F.lit(r'(\d{3}-N\d+)\["([^"]*?)"\]'), F.lit(2))
    summary = lambda t: F.regexp_extract(t, r"(?i)summary:\s*(.+?)(?:<br/>|$)", 1)
    status = lambda t: F.regexp_extract(t, r"(?i)status:\s*(\w+)", 1)
    node = lambda i, t: F.struct(i.alias("node_id"), F.when(status(t) == "", "unknown").otherwise(status(t)).alias("status"), F.substring(F.trim(summary(t)), 1, 100).alias("summary"))
    nodes = F.filter(F.zip_with(ids, texts, node), lambda n: n["summary"] != "")
    last = F.when(F.size(nodes) > 2, F.slice(nodes, -2, 2)).otherwise(nodes)
    return F.struct(F.coalesce(head["taskGoal"], F.lit("")).alias("goal"), head["createdTime"].alias("created"), head["updatedTime"].alias("updated"), count("done").alias("done"), count("doing").alias("doing"), count("todo").alias("todo"), last.alias("nodes"))


def first_json_object(text: Column) -> Column:
    """The first balanced object of a model's answer, strings respected; null where none closes."""
    signs = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}]', re.DOTALL)

    def one(raw: str | None) -> str | None:
        start = raw.find("{") if raw else -1
        depth = 0
        for m in signs.finditer(raw, start) if start >= 0 else ():
            depth += {"{": 1, "}": -1}.get(m.group(), 0)
            if not depth:
                return raw[start : m.end()]
        return None

    def each(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(one)

    return F.pandas_udf(each, "string")(text)


def distilled(answer: Column, kind: str) -> Column:
    """Struct of a lesson's, principle's or usage's fields out of a model's JSON object (see `first_json_object`), null where a
    required one is missing. Confidence is clamped to [0, 1], 0.5 where it is no number."""
    text = lambda name: F.coalesce(F.trim(F.get_json_object(answer, f"$.{name}")), F.lit(""))
    number = F.get_json_object(answer, "$.confidence").try_cast("double")
    confidence = F.when(number.isNull() | F.isnan(number), F.lit(0.5)).otherwise(S.clamp(number)).alias("confidence")
    if kind == "usage":
        tends = F.coalesce(F.get_json_object(answer, "$.is_tendency") == "true", F.lit(False))
        said = text("tendency_text")
        return F.when(F.try_parse_json(answer).isNotNull() & ~(tends & (said == "")), F.struct(tends.alias("is_tendency"), said.alias("text"), confidence))
    domain, said = text("domain"), text("lesson_text" if kind == "lesson" else "principle_text")
    return F.when((domain != "") & (said != ""), F.struct(domain.alias("domain"), said.alias("text"), confidence))
