"""Line-oriented text jobs: secret/PII scans, forbidden-grant scans, redaction.

Every document is split into all of its lines (``posexplode`` of the whole
text) and each line is tested with JVM regexes; the matched value itself is
never emitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Literal-secret / personal-data patterns and their reasons.
SECRET_PATTERNS = [
    (r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", "private key material"),
    (r"AIza[0-9A-Za-z_\-]{35}", "GCP API key"),
    (r'"type"\s*:\s*"service_account"', "service-account JSON"),
    (r"https://hooks\.slack\.com/services/[A-Za-z0-9/_-]+", "Slack webhook URL"),
    (r"xox[baprs]-[A-Za-z0-9-]{10,}", "Slack token"),
    (r"Bearer\s+[A-Za-z0-9]{20,}", "literal bearer token"),
    (r"[a-zA-Z0-9._%+-]+@(?:gmail|yahoo|hotmail|outlook)\.com", "personal email address"),
]
# Roles that must never be granted, and key-creation markers.
PROHIBITED_ROLES = ["roles/owner", "roles/editor", "roles/resourcemanager.projectIamAdmin"]
KEY_MARKERS = ["iam service-accounts keys create", "--key-file"]
# Redaction patterns applied in order (case-insensitive where marked).
REDACTION_PATTERNS = [
    (r"BEGIN PRIVATE KEY", False),
    (r"private_key(_id)?\"?\s*[:=]\s*\"?[^\",}\s]*", True),
    (r"private_key(_id)?", True),
    (r"client_email\"?\s*[:=]\s*\"?[^\",}\s]*", True),
    (r"client_email", True),
    (r"AIza[0-9A-Za-z\-_]{35}", False),
    (r"Bearer\s+[A-Za-z0-9\-._~+/]+=*", True),
]
REDACTED = "[REDACTED]"


# What ends a line (any of Unicode's line ends; a pair of CR LF is one).
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def text_lines(df: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """One row per line of every text: (ids..., line_no 1-based, line). A line end
    that closes the text starts no further line; an empty text has none."""
    split = df.select(*id_cols, F.split(F.col(text_col), LINE_END).alias("_lines"))  # once, in a projection of its own
    lines = split.select(*id_cols, F.size("_lines").alias("_n"), F.posexplode("_lines").alias("pos", "line"))
    closing = (F.col("pos") == F.col("_n") - 1) & (F.col("line") == "")
    return lines.where(~closing).select(*id_cols, (F.col("pos") + 1).alias("line_no"), "line")


def secret_scan(lines: DataFrame, id_cols: list[str]) -> DataFrame:
    """(ids..., line_no, reason) for every pattern hit; the value is not kept."""
    hits = F.filter(
        F.array(*[F.when(F.col("line").rlike(p), F.lit(r)) for p, r in SECRET_PATTERNS]), lambda x: x.isNotNull()
    )
    return lines.select(*id_cols, "line_no", F.explode(hits).alias("reason"))


def grant_scan(lines: DataFrame, id_cols: list[str]) -> DataFrame:
    """Non-comment lines granting a prohibited role, or creating/using a key."""
    line = F.col("line")
    not_comment = ~line.rlike(r"(?U)^\s*#")
    binds = line.contains("add-iam-policy-binding") | F.lower(line).contains("role")
    reasons = [F.when(line.contains(r) & binds, F.lit(f"grants prohibited {r}")) for r in PROHIBITED_ROLES]
    reasons.append(
        F.when(
            line.contains(KEY_MARKERS[0]) | line.contains(KEY_MARKERS[1]), F.lit("creates/uses a service-account key")
        )
    )
    hits = F.filter(F.array(*reasons), lambda x: x.isNotNull())
    return lines.filter(not_comment).select(*id_cols, "line_no", F.explode(hits).alias("reason"))


def redact(c: Column, max_length: int = 2000) -> Column:
    """Replace secrets with [REDACTED], strip whitespace, cap at max_length
    (ending in '...'); empty -> NULL."""
    out = c
    for pattern, icase in REDACTION_PATTERNS:
        out = F.regexp_replace(out, ("(?i)" if icase else "") + pattern, REDACTED)
    out = F.regexp_replace(out, r"^\s+|\s+$", "")
    capped = F.when(F.length(out) > max_length, F.concat(F.substring(out, 1, max_length - 3), F.lit("..."))).otherwise(out)
    return F.when(c.isNull() | (c == "") | (out == ""), F.lit(None).cast("string")).otherwise(capped)
