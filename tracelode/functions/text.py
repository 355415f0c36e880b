"""Scalar functions over texts, as native column expressions."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelode import schema

GAP = r"[^\p{L}\p{N}]*"


def tokens(query: str) -> list[str]:
    """The words of a query, split at white space, hyphens and underscores."""
    return [t for t in re.split(r"[\s\-_]+", query.strip()) if t]


class Reading:
    """What a query's words say: ``content`` are those that name something, without punctuation around them."""

    def __init__(self, query: str):
        self.words = tokens(query)
        bare = [w.strip(string.punctuation) for w in self.words]
        self.content = [b for b in bare if len(b) > 1 and b.lower() not in schema.STOP_WORDS]
        #: shaped like language: several words, of which some name something and others don't, or carry punctuation
        self.sentence = bool(self.content) and len(query.split()) > 1 and (len(self.content) < len(self.words) or bare != self.words)


def quoted(literal: str) -> str:
    """A literal as a pattern that Java and RE2 read alike."""
    return "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c for c in literal)


def phrase_pattern(query: str) -> str:
    """All words in order with nothing but non-letters between them."""
    return GAP.join(quoted(t) for t in tokens(query))


def ci(pattern: str) -> str:
    return f"(?iu){pattern}"


def folded(text: Column) -> Column:
    """Lower case, with the letters whose case folding differs from lower case."""
    return F.translate(F.lower(text), "ıſK", "isk")


def has(text: Column, term: str) -> Column:
    """Case-insensitive substring test."""
    return F.contains(folded(text), folded(F.lit(term)))


def word_pattern(literal: str) -> str:
    return rf"(?<![\p{{L}}\p{{N}}_]){quoted(literal)}(?![\p{{L}}\p{{N}}_])"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def snippet_at(text: Column, start: Column, length: Column, pad: int = schema.SNIPPET_PAD) -> Column:
    """The text around a 1-based span on one line, with an ellipsis at each end that was cut."""
    first = F.greatest(start - pad, F.lit(1))
    last = F.least(start + length - 1 + pad, F.length(text))
    inner = one_line(F.substring(text, first, last - first + 1))
    return F.concat(F.when(first > 1, "…").otherwise(""), inner, F.when(last < F.length(text), "…").otherwise(""))


def snippet_of(text: Column, spans: Column, pad: int = schema.SNIPPET_PAD) -> Column:
    """One line with the windows of several spans (array of struct start, length); windows that meet are merged."""
    windows = F.array_sort(F.transform(spans, lambda s: F.struct(F.greatest(s["start"] - pad, F.lit(1)).cast("int").alias("a"), F.least(s["start"] + s["length"] - 1 + pad, F.length(text)).cast("int").alias("b"))))
    kind = "array<struct<a:int,b:int>>"

    def add(done: Column, w: Column) -> Column:
        prior = F.element_at(done, -1)
        merged = F.struct(prior["a"].alias("a"), F.greatest(prior["b"], w["b"]).alias("b"))
        return F.when((F.size(done) > 0) & (w["a"] <= F.coalesce(F.get(done, F.size(done) - 1)["b"], F.lit(0)) + 1), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(merged))).otherwise(F.concat(done, F.array(w)))

    empty = F.array().cast(kind)
    # element_at on an empty array is null under try semantics, so the first window just starts the list
    runs = F.aggregate(windows, empty, lambda done, w: F.when(F.size(done) == 0, F.array(w)).otherwise(add(done, w)))
    parts = F.transform(runs, lambda w: one_line(F.substring(text, w["a"], w["b"] - w["a"] + 1)))
    head = F.when(F.element_at(runs, 1)["a"] > 1, "…").otherwise("")
    tail = F.when(F.element_at(runs, -1)["b"] < F.length(text), "…").otherwise("")
    return F.when(F.size(spans) > 0, F.concat(head, F.array_join(parts, "…"), tail))


def digest(text: Column) -> Column:
    """The 16-bit FNV-1a digest of the UTF-8 bytes as four hex digits."""
    data = F.encode(text, "UTF-8")
    octets = F.transform(F.sequence(F.lit(1), F.length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int"))
    octets = F.when(F.length(data) > 0, octets).otherwise(F.array().cast("array<int>"))
    # the low 16 bits of 64-bit FNV-1a: its offset and prime modulo 2^16
    low = F.aggregate(octets, F.lit(0x2325), lambda d, b: F.pmod(d.bitwiseXOR(b) * 0x01B3, F.lit(65536)).cast("int"))
    return F.when(text.isNotNull(), F.lower(F.lpad(F.hex(low), 4, "0")))


def project_name(cwd: Column) -> Column:
    """A short name of a working directory: its last part, or the last two where that part is generic; ~ for a home."""
    parts = F.filter(F.transform(F.split(cwd, r"[/\\]"), lambda p: F.regexp_replace(p, "^[\"' ]+|[\"' ]+$", "")), lambda p: p != "")
    n, leaf, parent = F.size(parts), F.element_at(parts, -1), F.get(parts, F.size(parts) - 2)
    generic = F.lower(leaf).isin("src", "web", "mobile", "app", "lib", "client", "server", "desktop", "documents", "downloads")
    return (
        F.when(cwd.isNull() | (n == 0), "unknown")
        .when((n >= 2) & (n <= 3) & F.lower(parent).isin("users", "home"), "~")
        .when(generic & (n >= 2), F.concat(parent, F.lit("/"), leaf))
        .otherwise(leaf)
    )


def capped(text: Column, cap: int) -> Column:
    return F.when(F.length(text) > cap, F.concat(F.substring(text, 1, cap), F.lit("…"))).otherwise(text)


def in_blob(text: Column, term: str) -> Column:
    """Whether a term stands within a long run of encoded data rather than in words."""
    return F.coalesce(text.rlike(rf"(?i)[A-Za-z0-9+/=_\-]{{0,400}}{quoted(term)}[A-Za-z0-9+/=_\-]{{0,400}}") & text.rlike(rf"(?i)(?:[A-Za-z0-9+/=]{{40,}}{quoted(term)}|{quoted(term)}[A-Za-z0-9+/=]{{40,}})"), F.lit(False))


# Openings of machine messages that nobody typed.
_WRAPPERS = (
    "<command-name>", "<command-message>", "<command-args>", "<local-command", "<bash-input>", "<bash-stdout>", "<user-prompt-submit-hook>", "Caveat:",
    "<system-reminder>", "<teammate-message", "<task-notification", "[SYSTEM NOTIFICATION", "<system-notification",
)
_WRAPPER_JSON = ('"idle_notification"', '"task_completed"', '"shutdown_request"', '"type":"idle"')


def is_wrapper(text: Column) -> Column:
    """Command and system chatter rather than something a person typed."""
    t = F.regexp_replace(text, r"^(?U)\s+", "")
    starts = t.rlike("^(?:" + "|".join(quoted(w) for w in _WRAPPERS) + ")")
    return starts | (t.contains("<command-name>") & t.contains("</command-name>")) | (t.startswith("{") & t.rlike("|".join(quoted(w) for w in _WRAPPER_JSON)))


def parse_timestamp(value: Column) -> Column:
    """RFC 3339 text or a number as text to epoch milliseconds; small numbers are seconds; failure is 0."""
    number = F.try_cast(F.trim(value), "double") if hasattr(F, "try_cast") else F.trim(value).try_cast("double")
    moment = F.when(value.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)$"), F.unix_millis(F.try_to_timestamp(F.upper(value))))
    scaled = F.when((number > 0) & (number < 1e11), number * 1000).otherwise(number)
    return F.coalesce(moment, scaled.cast("bigint"), F.lit(0).cast("bigint"))


def age_label(ts: Column, now_ms: int = schema.NOW_MS) -> Column:
    """A short age such as 5m, 3h, 2d, 4mo; ? for an unknown time."""
    s = F.floor((F.lit(now_ms) - ts) / 1000)
    return (
        F.when(ts <= 0, "?").when(s < 60, "now").when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h"))).when(s < 86400 * 60, F.concat(F.floor(s / 86400).cast("string"), F.lit("d")))
        .otherwise(F.concat(F.floor(s / (86400 * 30)).cast("string"), F.lit("mo")))
    )


def parse_when(value: str, now_ms: int = schema.NOW_MS) -> int:
    """An age such as 7d, 24h, 2w, 30m, 90s or a date to epoch milliseconds."""
    import datetime

    m = re.fullmatch(r"\s*(\d+)\s*([smhdw])\s*", value.lower())
    if m:
        return now_ms - int(m[1]) * {"s": 1000, "m": 60_000, "h": 3_600_000, "d": schema.DAY_MS, "w": 7 * schema.DAY_MS}[m[2]]
    moment = datetime.datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    return int((moment if moment.tzinfo else moment.replace(tzinfo=datetime.UTC)).timestamp() * 1000)


# What the name of a secret ends in, and words that stand for a type rather than a secret.
SECRET_NAMES = (r"token", r"passwo?r?d", r"passphrase", r"secret", r"(?:api|access|private|signing|encryption)[-_]?key", r"(?:database|connection)[-_]?(?:url|string)", r"bootstrap")
PLAIN_VALUES = ("bool", "boolean", "bytes", "float", "int", "integer", "none", "null", "number", "optional", "required", "str", "string", "true", "false")

_SECRET = rf"(?:[a-z0-9]+[-_])*(?:{'|'.join(SECRET_NAMES)})"
_VALUE = r"""(?:"[^"\n]*"|'[^'\n]*'|[^\s"',;&#}\])]+)"""
#: what is masked, in this order; the first group stays
MASKS = (
    ("key blocks", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)[^-]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"),
    ("authorization headers", rf"(\bauthorization[\"']?\s*[:=]\s*[\"']?[a-z]+[ \t]+){_VALUE}"),
    ("bearer values", r"(\bbearer[ \t]+)(?!\[)[\w.~+/=-]{8,}"),
    ("cookies", r"(\b(?:set-)?cookie[ \t]*:[ \t]*[\w.-]+=)[^;\s]+"),
    ("users in addresses", r"(\b[a-z][\w+.-]*://)[^\s/?#@]+(?=@)"),
    ("signed and prefixed tokens", r"()\b(?:eyJ[\w-]{8,}\.[\w-]+\.[\w-]*|(?:sk|pk|rk|gh[a-z]|xox[a-z])[-_][A-Za-z0-9_-]{16,})"),
    ("flags", rf"(-{{1,2}}{_SECRET}(?:[ \t]*=[ \t]*|[ \t]+))(?!-|\[redacted){_VALUE}"),
    ("fields", rf"(\b{_SECRET}[\"']?[ \t]*[:=][ \t]*)(?!\[redacted|(?:{'|'.join(PLAIN_VALUES)})\b){_VALUE}"),
)


def redacted(text: Column) -> Column:
    """Secrets masked: what ``MASKS`` names, each value by [redacted]."""
    for _, pattern in MASKS:
        text = F.regexp_replace(text, f"(?i){pattern}", "$1[redacted]")
    return text


def terminal_safe(text: Column) -> Column:
    """Characters that steer a terminal or its writing direction become visible: an escape as such, others as a replacement sign.

    Tab and line feed stay; all other control, format, surrogate, private and unassigned characters and the line and paragraph
    separators go.
    """
    safe = F.regexp_replace(text, r"\x1B", r"\\x1b")
    return F.regexp_replace(safe, r"[\p{C}\x{2028}\x{2029}&&[^\t\n]]", "�")


def handle(session: Column, turn: Column, content_digest: Column) -> Column:
    """The address of a turn: @session:turn.digest."""
    return F.concat(F.lit("@"), session, F.lit(":"), turn.cast("string"), F.when(content_digest.isNotNull(), F.concat(F.lit("."), content_digest)).otherwise(""))


def parse_handle(value: Column) -> Column:
    """Struct session, turn, digest of an address; nulls where a part is missing."""
    pattern = r"^@([^:]+):(\d+)(?:\.([0-9a-f]{4}))?"
    part = lambda i: F.when(F.regexp_extract(value, pattern, i) != "", F.regexp_extract(value, pattern, i))
    return F.struct(part(1).alias("session"), part(2).cast("int").alias("turn"), part(3).alias("digest"))


def summarized_input(payload: Column, cap: int = schema.EVENT_CAP) -> Column:
    """What a person would look for in a tool call's JSON input, by order of interest; else the JSON."""
    keys = ("command", "file_path", "notebook_path", "path", "pattern", "query", "url", "prompt", "description", "cmd")

    def part(k: str) -> Column:
        v = F.get_json_object(payload, f"$.{k}")
        joined = F.array_join(F.from_json(v, "array<string>"), " ")
        text = F.when(v.startswith("["), joined).otherwise(F.trim(v))
        return F.when(text != "", text)

    found = F.concat_ws(" · ", *(part(k) for k in keys))
    return capped(F.when(found != "", found).otherwise(F.when(payload == "null", "").otherwise(payload)), cap)


def row_kind(who: Column, model: Column, text: Column, project: Column, side: Column) -> Column:
    """The role of a human-side row: recap, synthetic, control, harness, subagent or user, in this order."""
    t = F.trim(text)
    control = (F.lower(t) == "continue") | (t == "Request interrupted by user") | t.startswith("[Request interrupted by user")
    # Projects and openings of test harnesses.
    harness_project = F.exists(F.split(F.lower(project), r"[/\\]"), lambda s: (s == "vo-exp") | s.rlike("^(?:_probe|control_|run_control|haiku-control|haiku-treatment)"))
    openings = (
        "Return only valid JSON that matches the schema below.", "You are a workflow planner for OpenCode.", "You are an independent verifier.", '"Create a file named ok.txt',
        '"You are working in the current directory.', '"Stay in this directory. STEP 1:', '"STEP 1: run ', "Follow the README in this directory to run the analysis",
    )
    head = F.ltrim(text)
    harness = harness_project | head.rlike("^(?:" + "|".join(quoted(o) for o in openings) + ")")
    sub = F.coalesce(side, F.lit(False)) | head.startswith("[subagent task]") | head.startswith("[subagent message]")
    no = F.lit(False)
    return (
        F.when(F.coalesce(who == "recap", no), "recap").when(F.coalesce(F.trim(model) == "<synthetic>", no), "synthetic").when(F.coalesce(control, no), "control")
        .when(F.coalesce(harness, no), "harness").when(F.coalesce(sub, no), "subagent").otherwise("user")
    )
