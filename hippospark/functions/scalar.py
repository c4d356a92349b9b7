"""Scoring, similarity and text expressions as Column builders; all stay in the JVM."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as white space in the texts' own rules, beyond the ASCII of Java's \\s.
SPACE = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
RRF_K = 60
HALF_LIFE_DAYS, RECENCY_WEIGHT = 30.0, 0.15


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def doubles(v: str | Column) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """M1: 0 where lengths differ or a norm is 0; clamped to [-1, 1]."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), F.lit(0.0)).otherwise(clamp(dot(a, b) / n, -1.0, 1.0))


def rounded(x: Column, digits: int = 6) -> Column:
    """Half away from zero in binary, as SQL engines round doubles: ties are those of x * 10^digits, and what vanishes keeps its sign."""
    y = x * float(10**digits)
    whole = F.rint(y)
    return F.when(F.abs(y - whole) == 0.5, y + F.signum(y) * 0.5).otherwise(whole) / float(10**digits)


def l2_normalized(a: Column) -> Column:
    """Non-finite components count 0; a tiny norm leaves the vector as it is."""
    fine = F.transform(a, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x))
    # one row of the vector and its norm, so that the norm is not summed again for each component
    both = F.array(F.struct(fine.alias("v"), norm(fine).alias("n")))
    return F.transform(both, lambda s: F.when(s["n"] < 1e-10, s["v"]).otherwise(F.transform(s["v"], lambda x: x / s["n"])))[0]


def jaccard(a: Column, b: Column) -> Column:
    """M2: two empty sets are not alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def rrf(rank: Column, k: int = RRF_K) -> Column:
    """M4: reciprocal rank, ranks from 0."""
    return F.lit(1.0) / (F.lit(k + 1) + rank)


def recency_decay(age_days: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    """M3: halves every half-life; a missing age gives 0, the future counts as now."""
    return F.when(age_days.isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life))


def recency_boosted(score: Column, age_days: Column, weight: float = RECENCY_WEIGHT) -> Column:
    return score * (1 + weight * recency_decay(age_days))


def bm25_rank_score(rank: Column) -> Column:
    """M5: a ranking value where less is better becomes a score in (0, 1)."""
    r = -rank
    return F.when(rank.isNull() | F.isnan(rank), F.lit(1 / 1000)).when(rank > 0, 1 / (1 + rank)).otherwise(r / (1 + r))


def calibrated(cosine_: Column, fused: Column) -> Column:
    """M6: the cosine where there is one, else n / (n + 1) with n the fused score over that of a single first place."""
    n = fused * (RRF_K + 1)
    return F.coalesce(cosine_, n / (n + 1))


def fact_importance(entity: Column, confidence: Column, support: Column) -> Column:
    """M7: the mean of an entity's importance (0 to 100, 50 where unknown), a confidence and a support, each clamped."""
    known = F.when(support > 0, 1 - 1 / support).otherwise(0.0)
    return clamp((clamp(F.coalesce(entity, F.lit(50)) / 100) + clamp(confidence) + known) / 3)


def word_tokens(text: Column, least: int = 2) -> Column:
    """M9: distinct lower-case words of letters, digits and underscores."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda x: F.char_length(x) >= least))


def token_list(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def similarity_tokens(text: Column) -> Column:
    """M8: lower case, cut at other than letters and digits, longer than one."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: F.char_length(x) > 1))


def idf(n: Column, df: Column) -> Column:
    """M10."""
    return F.ln((n + 1) / (df + 1))


def injection_decay(age_hours: Column, half_life: float = 48.0) -> Column:
    """M14."""
    return F.exp(-F.ln(F.lit(2.0)) * age_hours / half_life)


def permanence(count: Column, salience: Column) -> Column:
    """M15."""
    return 0.5 * count + salience


def confidence_after(c: Column, avoided: bool) -> Column:
    """M16."""
    return clamp(c + 0.25 * (0.99 - c) if avoided else 0.8 * c, 0.1, 0.99)


def willingness_after(w: Column, confirmed: bool) -> Column:
    """M17."""
    return clamp(w + 0.25 * (0.99 - w) if confirmed else 0.65 * w, 0.05, 0.99)


def willingness_tier(w: Column) -> Column:
    return F.when(w < 0.25, "suppressed").when(w < 0.45, "demoted").otherwise("trusted")


def sha1_id(prefix: str, *parts: Column) -> Column:
    """M28."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16))


def profile_id(scope: Column, kind: Column, name: Column) -> Column:
    """Stable over renderings of a profile's file."""
    return F.concat(F.lit("profile:v1:"), F.sha2(F.concat(scope, F.lit("\0"), kind, F.lit("\0"), name), 256))


def distinctiveness(rarity: Column, isolation: Column, affect: Column | None = None, weights: tuple[float, float, float] = (0.5, 0.5, 0.0)) -> Column:
    """Rarity, isolation and, where it has a weight, affect."""
    return weights[0] * rarity + weights[1] * isolation + weights[2] * (F.lit(0.0) if affect is None else F.coalesce(affect, F.lit(0.0)))


def canonical_key(kind: Column, name: Column) -> Column:
    """M23."""
    plain = F.regexp_replace(stripped(F.lower(nfkc(name))), f"{SPACE}+", " ")
    path = F.regexp_replace(F.regexp_replace(plain, r"\\", "/"), "/+$", "")
    key = F.when(kind == "file", path).when(kind == "library", F.regexp_replace(plain, r"@[^@/]*$", "")).otherwise(plain)
    return F.concat(F.lower(F.trim(kind)), F.lit(":"), key)


def nfkc(text: Column) -> Column:
    """Compatibility form, by the library that Spark ships for collations. Not for lambdas, nor inside an aggregate."""
    form = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    return F.when(text.isNotNull(), form)


def stripped(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def fact_value(value: Column) -> Column:
    """Compatibility form, white space trimmed and collapsed, case kept. Printable ASCII with single spaces inside is that already."""
    plain = ~F.rlike(value, F.lit(r"[^ -~]|\A | \z|  "))
    return F.when(plain, value).otherwise(stripped(F.regexp_replace(nfkc(value), f"{SPACE}+", " ")))


def snake_attribute(name: Column, ascii_only: bool = False) -> Column:
    """M26. ascii_only: for lambdas, where the compatibility form cannot be had."""
    x = F.lower(F.regexp_replace(name if ascii_only else nfkc(name), "([a-z0-9])([A-Z])", "$1_$2"))
    x = F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(x == "", "value").otherwise(F.substring(F.when(x.rlike("^[a-z]"), x).otherwise(F.concat(F.lit("v_"), x)), 1, 64))


def slug(text: Column, joint: str = "_") -> Column:
    """M27."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", joint), f"^{joint}+|{joint}+$", "")


def rule_slug(text: Column, most: int = 48) -> Column:
    """M27 of the whole text: normalised, slugged, cut to `most` characters; a blank one is "law"."""
    cut = F.regexp_replace(F.substring(slug(nfkc(text)), 1, most), "_$", "")
    return F.when(cut == "", "law").otherwise(cut)


def cjk_count(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}]", ""))


def token_estimate(text: Column, quick: bool = False) -> Column:
    """Characters of East Asian scripts cost more tokens."""
    cjk = cjk_count(text)
    rest = F.char_length(text) - cjk
    return F.ceil(cjk * 1.5 + rest / 4 if quick else cjk / 1.7 + rest / 4).cast("long")


def heat_bucket(heat: Column, steps: Sequence[int] = (50, 100, 200, 500, 1000)) -> Column:
    """How many steps the heat has reached."""
    return sum((F.when(heat >= s, 1).otherwise(0) for s in steps), F.lit(0))


def chunks(text: Column, size: int = 2000, overlap: int = 200, most: int = 50) -> Column:
    """Array of (ix, chunk); blank text has none, at most `most` chunks."""
    stride = size - overlap
    n = F.least(F.lit(most), F.when(F.char_length(text) <= size, F.lit(1)).otherwise(F.ceil((F.char_length(text) - overlap) / stride).cast("int")))
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("ix"), F.substr(text, i * stride + 1, F.lit(size)).alias("chunk")))
    return F.when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", F.array().cast("array<struct<ix:int,chunk:string>>")).otherwise(cut)


def chunks_truncated(text: Column, size: int = 2000, overlap: int = 200, most: int = 50) -> Column:
    return F.char_length(text) > (size - overlap) * (most - 1) + size


def severity(confidence: Column, evidence: Column, tier: Column, stakes: Column) -> Column:
    """A stance is silent, soft or hard; without a record (null tier) it is trusted."""
    silent = (confidence < 0.6) | (evidence < 2) | (F.coalesce(tier, F.lit("trusted")) == "suppressed")
    return F.when(silent, "silent").when((stakes == "high") & (F.coalesce(tier, F.lit("trusted")) == "trusted"), "hard").otherwise("soft")


def fingerprint_score(files: tuple[Column, Column], errors: tuple[Column, Column], task: tuple[Column, Column]) -> Column:
    """Weighted likeness over the axes on which either side has something."""
    wf = F.when((F.size(files[0]) > 0) | (F.size(files[1]) > 0), 0.6).otherwise(0.0)
    we = F.when((F.size(errors[0]) > 0) | (F.size(errors[1]) > 0), 0.25).otherwise(0.0)
    wt = F.when((task[0] != "") & (task[1] != ""), 0.15).otherwise(0.0)
    total = wf + we + wt
    same = F.when(task[0] == task[1], 1.0).otherwise(0.0)
    return F.when(total == 0, F.lit(0.0)).otherwise((wf * jaccard(*files) + we * jaccard(*errors) + wt * same) / total)


def fingerprint_score_of_counts(files: tuple[Column, Column, Column], errors: tuple[Column, Column], task: tuple[Column, Column]) -> Column:
    """fingerprint_score where of the files the numbers of both sides and of those that they share are known."""
    a, b, both = files
    union = a + b - both
    wf = F.when(union > 0, 0.6).otherwise(0.0)
    we = F.when((F.size(errors[0]) > 0) | (F.size(errors[1]) > 0), 0.25).otherwise(0.0)
    wt = F.when((task[0] != "") & (task[1] != ""), 0.15).otherwise(0.0)
    total = wf + we + wt
    same = F.when(task[0] == task[1], 1.0).otherwise(0.0)
    alike = F.when(union == 0, F.lit(0.0)).otherwise(both / F.when(union > 0, union))
    return F.when(total == 0, F.lit(0.0)).otherwise((wf * alike + we * jaccard(*errors) + wt * same) / total)


def match_tier(score: Column) -> Column:
    return F.when(score >= 0.6, "strong").when(score >= 0.3, "medium").otherwise("none")
