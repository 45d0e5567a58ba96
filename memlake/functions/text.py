"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions.fixed_values import (  # noqa: F401  also read as attributes of this module
    ABSTENTIONS, ACKNOWLEDGEMENT, CONTROL_TAG, DURABLE_HINTS, FEEDBACK_MARKS, FILE_PATH, GATE_STOP_WORDS, LOREM, NEEDS_REDACTION, OVERRIDE, PREMISE_ABSTENTIONS, PROXY_STOP_WORDS, RAW_LOG, SECRET_RULES, SENSITIVE, SHUTDOWN_COMMANDS, STRICT_ABSTENTIONS, TRANSIENT, TRANSIENT_ERRORS, TRANSIENT_PHRASES,
)

_WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space at either end; looks at the ends alone."""
    return F.btrim(c, F.lit(_WHITE))


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def query_tokens(c: Column) -> Column:
    """Distinct content words of a query, lower-cased."""
    words = F.transform(all_matches(c, r"(?U)\b[A-Za-z0-9_.\-]+\b"), F.lower)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(GATE_STOP_WORDS)))


def cjk_characters(c: Column) -> Column:
    return F.array_distinct(all_matches(c, r"[\x{4e00}-\x{9fff}]"))


def identity_subjects(c: Column) -> Column:
    """Names that a query labels as user, project or repository."""
    return F.array_distinct(F.transform(all_matches(c, r"(?iU)\b(?:user|project|repo|repository)\s+([A-Za-z0-9_.-]{2,})\b", 1), F.lower))


def proxy_terms(c: Column) -> Column:
    """Tokens of the lexical proxy, repeats and all: words, and CJK characters with their bigrams."""
    words = F.filter(all_matches(F.lower(c), r"[a-zA-Z0-9_\-]+"), lambda w: (F.length(w) >= 2) & ~w.isin(PROXY_STOP_WORDS))
    chars = F.filter(all_matches(c, r"[\x{4e00}-\x{9fff}]"), lambda w: ~w.isin(PROXY_STOP_WORDS))
    pairs = F.when(F.size(chars) > 1, F.zip_with(F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars)), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
    # most texts have none of these characters: one look instead of several extractions
    cjk = F.when(c.rlike(r"[\x{4e00}-\x{9fff}]"), F.concat(chars, F.filter(pairs, lambda w: ~w.isin(PROXY_STOP_WORDS)))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, cjk)


def proxy_tokens(c: Column) -> Column:
    """Distinct tokens of the lexical proxy."""
    return F.array_distinct(proxy_terms(c))


def _full(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def is_raw_log(c: Column, stripped: bool = False) -> Column:
    return F.coalesce(_full(c) & (c if stripped else strip(c)).rlike(RAW_LOG), F.lit(False))


def is_control_tag(c: Column, stripped: bool = False) -> Column:
    return F.coalesce(_full(c) & (c if stripped else strip(c)).rlike(CONTROL_TAG), F.lit(False))


def is_override(c: Column, stripped: bool = False) -> Column:
    return F.coalesce(_full(c) & (c if stripped else strip(c)).rlike(OVERRIDE), F.lit(False))


def is_transient(c: Column, stripped: bool = False) -> Column:
    return F.coalesce(_full(c) & (c if stripped else strip(c)).rlike(TRANSIENT), F.lit(False))


def is_hazard(c: Column) -> Column:
    """Any structural hazard: log, control tag, override, acknowledgement."""
    return is_raw_log(c) | is_control_tag(c) | is_override(c) | is_transient(c)


_WRAP = r"\s*_`\x22'“”‘’「」『』()（）\[\]【】#~～"


def clean_transient(c: Column) -> Column:
    """Without wrappers at the start and anything but letters and digits at the end."""
    return F.regexp_replace(c, rf"^[{_WRAP}]+|[^\p{{L}}\p{{N}}]+$", "")


def is_acknowledgement(c: Column, stripped: bool = False) -> Column:
    """Nothing but acknowledgements; empty text counts, feedback marks don't."""
    s = F.coalesce(c, F.lit("")) if stripped else strip(F.coalesce(c, F.lit("")))
    marked = F.lit(False)
    for mark in FEEDBACK_MARKS:
        marked = marked | s.contains(mark)
    cleaned = F.lower(clean_transient(s))
    known = lambda p: p.isin(TRANSIENT_PHRASES)
    part = lambda p: F.lower(clean_transient(p))
    parts = F.split(s, r"[，,。.!！；;]+")
    # a text whose first part is no phrase isn't split at all
    first = part(F.regexp_extract(s, r"^[^，,。.!！；;]*", 0))
    every = F.forall(parts, lambda p: (part(p) == "") | known(part(p))) & F.exists(parts, lambda p: part(p) != "")
    short = F.length(s) < 60
    phrase = s.rlike(TRANSIENT) | s.rlike(ACKNOWLEDGEMENT) | F.when(short, known(cleaned)).otherwise(F.lit(False)) | F.when((first == "") | known(first), every).otherwise(F.lit(False))
    return (F.coalesce(c, F.lit("")) == "") | (~marked & phrase)


def is_placeholder(c: Column) -> Column:
    return F.coalesce(_full(c) & c.rlike(LOREM), F.lit(False))


def has_durable_hint(c: Column) -> Column:
    return F.lower(c).rlike("|".join(DURABLE_HINTS))


def scrub_secrets(c: Column) -> Column:
    for pattern, to in SECRET_RULES:
        c = F.regexp_replace(c, pattern, to)
    return c


def has_secret(c: Column) -> Column:
    return matches_any(c, [p for p, _ in SECRET_RULES])


def matches_any(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for pattern in patterns:
        out = out | c.rlike(pattern)
    return F.coalesce(out, F.lit(False))


def holds_any(c: Column, phrases: list[str]) -> Column:
    """Whether the lower-cased text holds one of the phrases."""
    low = F.lower(c)
    return F.coalesce(F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p)), F.lit(False))


def xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def normalised(c: Column) -> Column:
    """White space collapsed, lower case."""
    return F.lower(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"\s+", " "))


def answer_words(c: Column) -> Column:
    """Words of an answer without commas, punctuation and articles."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(c, ",", "")), r"[!-/:-@\[-`{-~]", "")
    return F.filter(F.split(F.regexp_replace(bare, r"\b(a|an|the|and)\b", " "), r"\s+"), lambda w: w != "")


def touched_files(c: Column) -> Column:
    """File paths in a text; a diff's a/ and b/ paths also without the prefix."""
    found = all_matches(c, FILE_PATH)
    more = F.transform(F.filter(found, lambda p: p.startswith("a/") | p.startswith("b/")), lambda p: F.substring(p, 3, 1_000_000))
    return F.array_sort(F.array_distinct(F.concat(found, more)))
