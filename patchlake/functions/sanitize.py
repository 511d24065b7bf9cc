"""Removal of personal data, secrets and internal names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ids import repository_id
from .text import basename, first_filled

# fixed values: patterns and labels of the redactors
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
UUID = r"\{?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\}?"
TAG = r"<[^>]*>"
SENSITIVE_FILE = r"(?i)\A\.env(\..+)?\z|\Aappsettings.*\.json\z|\Asecrets.*\.json\z|\Acredentials.*\z|\.(pem|key|pfx|p12)\z|\Aid_rsa.*\z|connectionstrings\.json\z"
QUERY_SECRET = r"(?i)([?&](?:access_token|token|key|secret|password|auth|api_key)=)[^&]*"
URL_LOGIN = r"(?i)https?://([^:]+):([^@]+)@"
JSON_SECRET = r"(?i)\"(app_password|token|password|secret|authorization)\"\s*:\s*\"([^\"]+)\""
AUTH_HEADER = r"(?i)(Authorization:\s*)([^\r\n]+)"
LOG_BEARER = r"(?i)Bearer\s+[A-Za-z0-9\-._~+/]+=*"
LOG_BASIC = r"(?i)Basic\s+[A-Za-z0-9+/]+=*"
LOG_VENDOR_TOKEN = r"ATBB[a-zA-Z0-9_\-]+"
HIDDEN_KEYS = ("token", "authorization", "password", "secret", "email", "uuid", "author")
# our own conservative patterns; the labels are fixed
SECRETS = (
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)", "PRIVATE_KEY"),
    (r"(?i)\bBearer\s+[A-Za-z0-9\-._~+/]{8,}=*", "BEARER_TOKEN"),
    (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "AWS_KEY"),
    (r"(?i)\b(?:Server|Data Source|Host)\s*=[^;\r\n]+;[^\r\n\"']*?(?:Password|Pwd)\s*=[^;\r\n\"']+;?|\b[a-z][a-z0-9+]*://[^\s:/@]+:[^\s@/]+@[^\s\"']+", "CONNECTION_STRING"),
)


def sanitize_text(c: Column) -> Column:
    """Emails, then UUIDs, then tags; null gives an empty string."""
    out = F.coalesce(c, F.lit(""))
    out = F.regexp_replace(out, EMAIL, "[REDACTED:EMAIL]")
    out = F.regexp_replace(out, UUID, "[REDACTED:UUID]")
    return F.regexp_replace(out, TAG, "")


def pii_hits(c: Column) -> Column:
    """Categories found in a text: each counts once, and UUIDs are looked for where emails are already gone."""
    t = F.coalesce(c, F.lit(""))
    rest = F.regexp_replace(t, EMAIL, "[REDACTED:EMAIL]")
    return F.array_compact(F.array(F.when(t.rlike(EMAIL), F.lit("pii_email")), F.when(rest.rlike(UUID), F.lit("pii_uuid"))))


def author(display_name: Column, username: Column, remove: bool = True) -> Column:
    if remove:
        return F.lit(None).cast("string")
    name = first_filled(display_name, username)
    return F.when(name.isNotNull(), sanitize_text(name))


def scan_secrets(c: Column) -> Column:
    out = c
    for pattern, label in SECRETS:
        out = F.regexp_replace(out, pattern, f"[REDACTED:{label}]")
    return out


def secret_labels(c: Column) -> Column:
    return F.array_compact(F.array(*(F.when(c.rlike(p), F.lit(label)) for p, label in SECRETS)))


def mask_token(c: Column) -> Column:
    """Four characters at either end; eight or fewer are hidden wholly."""
    t = F.trim(c)
    return F.when(F.coalesce(c, F.lit("")) == "", "").when(F.length(t) <= 8, "****").otherwise(F.concat(F.substring(t, 1, 4), F.lit("****"), F.right(t, F.lit(4))))


def redact_auth(c: Column) -> Column:
    """JSON secrets, authorization headers, then vendor tokens masked to four characters at either end."""
    out = F.coalesce(c, F.lit(""))
    out = F.regexp_replace(out, JSON_SECRET, '"$1": "[REDACTED]"')
    out = F.regexp_replace(out, AUTH_HEADER, "$1[REDACTED]")
    return F.regexp_replace(out, r"(?i)(ATBB)[A-Za-z0-9_-]{6,}([A-Za-z0-9_-]{4})", "$1****$2")


def redact_log(c: Column, workspace: str | None = None, repo: str | None = None, salt: str = "") -> Column:
    """A log line without tokens, emails, UUIDs and, where given, the repository's name."""
    out = F.regexp_replace(c, LOG_BEARER, "Bearer [REDACTED_TOKEN]")
    out = F.regexp_replace(out, LOG_BASIC, "Basic [REDACTED_BASIC_AUTH]")
    out = F.regexp_replace(out, LOG_VENDOR_TOKEN, "[REDACTED_TOKEN]")
    out = F.regexp_replace(out, EMAIL, "[REDACTED_EMAIL]")
    out = F.regexp_replace(out, UUID, "[REDACTED_UUID]")
    if workspace and repo:
        out = F.regexp_replace(out, F.lit(rf"(?i)\Q{workspace}\E/\Q{repo}\E"), repository_id(F.lit(workspace), F.lit(repo), salt))
    return out


def redact_columns(df: DataFrame, workspace: str | None = None, repo: str | None = None, salt: str = "") -> DataFrame:
    """Every string of ``df`` redacted, fields whose name tells a secret or a person replaced; decided from the schema."""

    def hidden(name: str) -> bool:
        return any(k in name.lower() for k in HIDDEN_KEYS)

    def walk(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return redact_log(c, workspace, repo, salt)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: walk(x, kind.elementType))
        if isinstance(kind, T.StructType):
            parts = [(F.lit("[REDACTED]") if hidden(f.name) else walk(c[f.name], f.dataType)).alias(f.name) for f in kind.fields]
            return F.when(c.isNotNull(), F.struct(*parts))
        if isinstance(kind, T.MapType):
            secret = F.lit("(?i)" + "|".join(HIDDEN_KEYS))
            # a value that is no string has no room for the mark and becomes null
            mark = F.lit("[REDACTED]") if isinstance(kind.valueType, T.StringType) else F.lit(None)
            named = isinstance(kind.keyType, T.StringType)
            return F.transform_values(c, lambda k, v: F.when(F.regexp_like(k, secret), mark).otherwise(walk(v, kind.valueType)) if named else walk(v, kind.valueType))
        return c

    return df.select(*((F.lit("[REDACTED]") if hidden(f.name) else walk(F.col(f"`{f.name}`"), f.dataType)).alias(f.name) for f in df.schema.fields))


def sanitize_path(path: Column, file_id: Column, mode: str = "sanitized") -> Column:
    """Modes full, basename, opaque and sanitized: of more than three segments the first and the last two stay."""
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(flat, "/"), lambda x: x != "")
    short = F.when(F.size(parts) <= 3, F.array_join(parts, "/")).otherwise(F.concat(F.get(parts, F.lit(0)), F.lit("/.../"), F.array_join(F.slice(parts, -2, 2), "/")))
    shown = {"full": flat, "basename": basename(flat), "opaque": file_id}.get(mode, short)
    return F.when(F.coalesce(path, F.lit("")) == "", file_id).otherwise(shown)


def sanitize_url(url: Column) -> Column:
    out = F.regexp_replace(F.coalesce(url, F.lit("")), URL_LOGIN, "https://")
    out = F.regexp_replace(out, QUERY_SECRET, "$1[REDACTED]")
    acts = out.contains("/pull-requests/") & (out.contains("/approve") | out.contains("/merge") | out.contains("/decline"))
    return F.when(acts, "[REDACTED:PROVIDER_ENDPOINT]").otherwise(out)


def is_sensitive_file(path: Column) -> Column:
    return F.coalesce(basename(path).rlike(SENSITIVE_FILE), F.lit(False))


def normalize_text(c: Column) -> Column:
    """Struct (text, is_normalized): escaped parentheses and CRLF are undone outside code spans and fences."""
    code = r"```[\s\S]*?```|`[^`]+`"
    text = F.coalesce(c, F.lit(""))
    clean = lambda x: F.replace(F.regexp_replace(x, r"\\([()])", "$1"), F.lit("\r\n"), F.lit("\n"))
    codes = F.regexp_extract_all(text, F.lit(f"({code})"), F.lit(1))
    plains = F.split(text, code, -1)
    out = F.array_join(F.zip_with(plains, codes, lambda p, k: F.concat(F.coalesce(clean(p), F.lit("")), F.coalesce(k, F.lit("")))), "")
    return F.struct(out.alias("text"), (out != text).alias("is_normalized"))


def normalize_uuid(c: Column) -> Column:
    return F.lower(F.trim(F.translate(F.coalesce(c, F.lit("")), "{}", "")))
