"""Column functions over names and texts of execution logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A hand-off suffix such as "Planner (-> Worker)".
HANDOFF = r"\(\s*->\s*(.*?)\)"
HANDOFF_TAIL = r"\s*\(\s*->.*?\)\s*$"
#: Characters of a lexical token and of a term.
TOKEN = r"[a-z0-9_./:-]{2,}"
CJK = "[\u4e00-\u9fff]+"
TERM = r"[\p{L}\p{N}\p{M}_./:-]{3,}"
#: Words that are no evidence, and words of a repair.
STOPWORDS = "the a an to of for is are was be and or in on it this that with from as by not".split()
REPAIR = r"(?iu)fix|repair|correct|test|verify|validat|pass|fail|修复|验证|测试|失败"
#: Common forms of credentials.
SECRET = r"(?i)(sk-[a-z0-9]{16,}|AKIA[0-9A-Z]{16}|ghp_[a-z0-9]{20,}|api[_-]?key\s*[:=]\s*\S{8,}|password\s*[:=]\s*\S{4,})"


def normalize_role(name: Column) -> Column:
    """Without a hand-off suffix, lower case, single spaces; null is empty."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), HANDOFF_TAIL, ""), r"\s+", " ")))


def recipient(name: Column) -> Column:
    """Whom a hand-off addresses, normalised; empty if none."""
    return normalize_role(F.regexp_extract(F.coalesce(name, F.lit("")), HANDOFF, 1))


def tokens(text: Column) -> Column:
    """Lexical tokens, then the bigrams of each CJK run; a run of one character is a token itself."""
    low = F.lower(F.coalesce(text, F.lit("")))
    runs = F.regexp_extract_all(low, F.lit(CJK), F.lit(0))
    pairs = F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))
    return F.concat(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)), F.flatten(pairs))


def terms(text: Column) -> Column:
    """The distinct terms."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0)))


def evidence_terms(text: Column) -> Column:
    """The distinct terms without stop words."""
    return F.array_except(terms(text), F.array(*[F.lit(w) for w in STOPWORDS]))


def wilson(p: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The 95 % interval of a share."""
    mid, den = p + z * z / (2 * n), 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / den, (mid + half) / den


def redact(text: Column) -> Column:
    """text with every credential replaced."""
    return F.regexp_replace(text, SECRET, "[REDACTED]")


def percent(share: Column, digits: int = 1) -> Column:
    """A share as a percentage with a fixed number of digits, halves to even as a report's formatting rounds; a null share is a dash."""
    return F.when(share.isNull(), F.lit("—")).otherwise(F.concat(F.format_string(f"%.{digits}f", F.bround(share * 100, digits)), F.lit("%")))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def iso_utc(seconds: Column) -> Column:
    """Unix seconds as an ISO time in UTC, whatever the session's time zone is."""
    local = F.timestamp_seconds(seconds)
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), local.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)).cast("double")
