"""Text hygiene: sanitising, capture predicates, redaction, directive and error detection. Java regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hippospark.functions.scalar import SPACE, stripped

# Markers that hosts put into messages.
INJECTED = (
    r"<relevant-memories>[\s\S]*?</relevant-memories>",
    r"<user-persona>[\s\S]*?</user-persona>",
    r"<relevant-scenes>[\s\S]*?</relevant-scenes>",
    r"<scene-navigation>[\s\S]*?</scene-navigation>",
    r"<current_task_context>[\s\S]*?</current_task_context>",
    r"<history_task_context[\s\S]*?</history_task_context>",
    r"(?:Conversation info|Sender|Thread starter|Replied message|Forwarded message context|Chat history since last reply)\s*\(untrusted[\s\S]*?\):\s*```json\s*[\s\S]*?```",
    r"```json\s*\{[\s\S]*?\"session[\s\S]*?\}\s*```",
    r"\[\[reply_to[^\]]*\]\]\s*",
    r"¥¥\[[\s\S]*?\]¥¥",
    r"(?m)^\[[\w\d\-:+ ]+\]\s*",
    r"\[media attached:[^\]]*\]\s*",
    r"To send an image back,[\s\S]*?(?:Keep caption in the text body\.)\s*",
    r"(?m)^System:\s*\[[\s\S]*?$",
    r"(?i)data:image/[a-z+]+;base64,[A-Za-z0-9+/=]+",
    r"\x00",
)
# Injection phrases.
INJECTION = (
    r"(?i)ignore\b.{0,30}\b(instructions|rules|guidelines)",
    r"(?i)disregard\b.{0,30}\b(instructions|rules|guidelines)",
    r"(?i)forget\b.{0,30}\b(instructions|rules|context)",
    r"(?i)override\b.{0,30}\b(instructions|rules|guidelines|safety)",
    r"(?i)you are now (?!going|about|ready)",
    r"(?i)act as (?:if you are |if you were )?(?:a |an )?(?:root|admin|unrestricted|unfiltered|jailbroken)",
    r"(?i)enter (?:DAN|jailbreak|god|sudo|developer|dev|debug|unrestricted|unfiltered) mode",
    r"(?i)switch to (?:DAN|jailbreak|god|sudo|developer|dev|debug|unrestricted|unfiltered) mode",
    r"(?i)(?:show|reveal|print|output|display|repeat|leak|dump|give)\b.{0,20}\bsystem prompt",
    r"(?i)reveal (?:your |the )?(system|hidden|secret|internal) (?:prompt|instructions|rules)",
    r"(?i)what (?:are|is) your (?:system|hidden|original|initial) (?:prompt|instructions|rules)",
    r"(?i)<\s*(system|assistant|developer|tool|function|relevant-memories)\b",
    r"(?i)\b(run|execute|call|invoke)\b.{0,40}\b(tool|command|function|shell)\b",
    r"忽略(?:所有|之前|以上|先前)?(?:的)?(?:指令|规则|指示|说明)",
    r"无视(?:所有|之前|以上)?(?:的)?(?:指令|规则|限制)",
    r"(?:显示|输出|告诉我|给我看)(?:你的)?(?:系统|初始|隐藏)?(?:提示词|指令|规则|prompt)",
    r"你(?:现在|从现在开始)是",
)
# Domains of high stakes, by severity.
STAKES = (
    ("payment", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"),
    ("credential", r"(?i)\[REDACTED:[a-z-]+\]"),
    ("destructive", r"(?i)\brm\s+-rf?\b|\bDROP\s+(?:TABLE|DATABASE|SCHEMA)\b|\bTRUNCATE\s+TABLE\b|\bDELETE\s+FROM\b"),
    ("prod", r"(?i)\bgit\s+push\b[\s\S]{0,40}\b(?:--force|-f)\b|\bgit\s+push\b[\s\S]{0,40}\b(?:main|master|prod|production|upstream)\b|\bdeploy(?:ing|ment)?\b[\s\S]{0,20}\bprod(?:uction)?\b"),
    ("exfil", r"(?i)\b(?:curl|wget|fetch)\b[\s\S]{0,60}\bhttps?://"),
)
# Directive markers with their weights, and words after "non" that make no prohibition.
CORRECTION = ((r"\bsbagliat[oaie]\b", 0.5), (r"\bnon va bene\b", 0.5), (r"\bnon è (quello|cosa|come)\b", 0.5), (r"\bti (avevo|ho) (detto|corretto)\b", 0.5), (r"\bsmettila di\b", 0.5), (r"\bun['’ ]altra volta\b", 0.4))
PROHIBITION = ((r"\bmai\b", 0.4), (r"\bnever\b", 0.5), (r"\b(don['’]t|do not)\b", 0.5))
PRESCRIPTION = (
    (r"\bd['’ ]?ora in poi\b", 0.4), (r"\bda (ora|adesso) in poi\b", 0.4), (r"\bfrom now on\b", 0.5), (r"\bsempre\b", 0.35), (r"\balways\b", 0.35), (r"\b(devi|dovrai|dovresti)\b", 0.35), (r"\byou must\b", 0.35),
    (r"\bmake sure\b", 0.35), (r"\bvoglio che (tu )?", 0.35), (r"\bricord(a|ati|atevi|ate)\b", 0.3), (r"\b(aspetta|verifica|controlla|fermati|assicurati|evita|procedi|chiedi(mi)?)\b", 0.35),
)
AFTER_NON = (
    "ho", "hai", "ha", "hanno", "abbiamo", "avete", "avevo", "avevi", "aveva", "avevano", "è", "e'", "sono", "sei", "siamo", "siete", "era", "eri", "erano", "fu", "sarà", "sara", "ci", "c'", "mi", "ti", "si", "vi", "lo", "la",
    "li", "le", "ne", "gli", "un", "uno", "una", "il", "i", "di", "del", "della", "che", "più", "piu", "ancora", "solo", "molto", "tanto", "so", "vedo", "credo", "penso",
)
# Tags that are escaped, and names of attributes that are noise.
TAGS = (
    "user-persona", "relevant-memories", "scene-navigation", "relevant-scenes", "memory-tools-guide", "system", "assistant", "session-open-banner", "cornerstone-memories", "session-recap",
    "grounded-trust-interrupt",
)
NOISE_ATTRIBUTE = r"(?i)_(count|phase|size|index|offset)$|^(line|char|byte|token)_|^action_phase$|^rowid$"
#: Kinds of secrets that are redacted.
SECRETS = (
    ("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("aws-key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("github-token", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b"),
    ("api-key", r"\bsk-[A-Za-z0-9_-]{16,}\b"),
    ("bearer", r"(?i)\bbearer\s+[A-Za-z0-9._~+/-]{16,}=*"),
    ("password", r"(?i)\b(?:password|passwd|secret|api[_-]?key|token)\s*[:=]\s*\S{6,}"),
)


def ascii_bounds(pattern: str) -> str:
    """The pattern with its word boundaries by ASCII letters, digits and underscores, as they are meant; Java's know all scripts."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""))


def sanitized(text: Column) -> Column:
    """P1."""
    for pattern in INJECTED:
        text = F.regexp_replace(text, pattern, "")
    return _squeezed(text)


def without_code(text: Column) -> Column:
    """P2."""
    return _squeezed(F.regexp_replace(text, r"```[^\n]*\n[\s\S]*?```", ""))


def is_noise(text: Column) -> Column:
    """P6."""
    t = stripped(text)
    return (t == "(session bootstrap)") | t.startswith("A new session was started via") | t.rlike(r"^✅\s*New session started") | t.startswith("Pre-compaction memory flush") | t.rlike(r"^NO_REPLY\s*$")


def capturable(text: Column) -> Column:
    """P3."""
    return F.coalesce((stripped(text) != "") & ~is_noise(text) & ~text.startswith("/"), F.lit(False))


def injected(text: Column) -> Column:
    """P5: on text with white space collapsed."""
    plain = F.trim(F.regexp_replace(text, f"{SPACE}+", " "))
    out = F.lit(False)
    for pattern in INJECTION:
        out = out | plain.rlike(ascii_bounds(pattern))
    return out


def extractable(text: Column) -> Column:
    """P4. Signs are counted in UTF-16 units."""
    units = F.char_length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10ffff}]"))
    signs = text.rlike(f"^(?!.*{SPACE})[^\\w\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}]+$") & (units <= 5)
    return capturable(text) & ~signs & ~text.rlike(r"^[?？]+$") & ~injected(text)


def escaped_tags(text: Column) -> Column:
    """P7."""
    return F.regexp_replace(text, f"(?i)<(/?(?:{'|'.join(TAGS)}))>", "&lt;$1&gt;")


def without_unsafe(text: Column) -> Column:
    """Replacement characters, controls, zero-width signs and byte order marks."""
    return F.regexp_replace(text, r"[\x{fffd}\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}\x{200b}-\x{200f}\x{2028}-\x{202f}\x{2060}\x{feff}]", "")


def redacted(text: Column) -> Column:
    """P12."""
    for kind, pattern in SECRETS:
        text = F.regexp_replace(text, ascii_bounds(pattern), f"[REDACTED:{kind}]")
    return text


def has_secret(text: Column) -> Column:
    out = F.lit(False)
    for _, pattern in SECRETS:
        out = out | text.rlike(ascii_bounds(pattern))
    return out


def noise_attribute(name: Column) -> Column:
    """P13."""
    return name.rlike(NOISE_ATTRIBUTE)


def has_cjk(text: Column) -> Column:
    """P14."""
    return text.rlike(r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}]")


def stakes(text: Column) -> Column:
    """The first domain that matches, by severity."""
    out = None
    for domain, pattern in STAKES:
        hit = text.rlike(ascii_bounds(pattern)) | (has_secret(text) if domain == "credential" else F.lit(False))
        out = F.when(hit, domain) if out is None else out.when(hit, domain)
    return out.otherwise("none")


def vision(event_type: Column, distinctiveness: Column, operative: Column) -> Column:
    """P16."""
    return (operative == "none") & (event_type == "decision") & (distinctiveness >= 0.7)


def should_gate(trust: Column, level: Column, gate: Column) -> Column:
    """P17."""
    return (trust == "unverified") & (level == "high") & (gate == "clear")


def directive(text: Column) -> Column:
    """Struct of kind and strength, null where nothing fires."""
    low = F.lower(F.trim(text))
    weigh = lambda marks: sum((F.when(low.rlike(ascii_bounds(p)), w).otherwise(0.0) for p, w in marks), F.lit(0.0))
    non = F.exists(F.regexp_extract_all(low, F.lit(ascii_bounds(r"\bnon\s+([a-zàèéìòù']+)")), F.lit(1)), lambda x: ~x.isin(*AFTER_NON))
    wrong, forbid, do = weigh(CORRECTION), weigh(PROHIBITION) + F.when(non, 0.4).otherwise(0.0), weigh(PRESCRIPTION)
    kind = F.when(wrong > 0, "correction").when(forbid > 0, "prohibition").when(do > 0, "prescription")
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.least(F.lit(1.0), wrong + forbid + do).alias("strength")))


def error_signatures(text: Column) -> Column:
    """P20: sorted, distinct."""
    every = lambda pattern, group=0: F.regexp_extract_all(text, F.lit(ascii_bounds(pattern)), F.lit(group))
    quoted = F.concat(every("\"([^\"]{1,60})\"", 1), every("'([^']{1,60})'", 1))
    quoted = F.transform(F.filter(F.transform(quoted, F.trim), lambda x: x.rlike("(?i)error|fail|refused|denied|timeout|not found")), lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    http = F.transform(every(r"\b(?:HTTP[/ ]?)?([45]\d{2})\b", 1), lambda x: F.concat(F.lit("HTTP_"), x))
    return F.array_sort(F.array_distinct(F.concat(every(r"\b([A-Z][a-z]+[A-Za-z]*(?:Error|Exception))\b", 1), every(r"\bERR_[A-Z0-9_]+\b"), every(r"\bE[A-Z]{2,}\b"), http, quoted)))


def memory_type(kind: Column) -> Column:
    """Null where the type is unknown and the memory is dropped."""
    k = F.lower(F.trim(kind))
    return F.when(k.isin("episodic", "episode"), "episodic").when(k.isin("instruction", "instruct"), "instruction").when(k.isin("persona", "preference"), "persona")


def task_type(errors: Column, tools: Column) -> Column:
    """P29."""
    return F.when(F.size(errors) > 0, "debug").when(F.arrays_overlap(tools, F.array(*map(F.lit, ("Edit", "Write", "MultiEdit", "NotebookEdit")))), "implement").when(F.size(tools) > 0, "explore").otherwise("")


def session_pattern(globs: list[str]) -> str:
    """Unanchored regular expression of glob patterns."""
    import re

    return "|".join(".*".join(re.escape(x) for x in g.split("*")) for g in globs)
