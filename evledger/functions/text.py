"""Column functions on text, all evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as Python strings see it: Java's White_Space property
# plus the four information separators.
SPACE = r"[\s\x1c-\x1f]"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def is_blank(col: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return ~F.coalesce(col.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def summarize(col: Column, limit: int = 120) -> Column:
    """One line of text; longer than ``limit`` keeps limit-1 characters and dots."""
    clean = F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), rf"(?U){SPACE}+", " "))
    return F.when(F.length(clean) <= limit, clean).otherwise(
        F.concat(F.substring(clean, 1, limit - 1), F.lit("..."))
    )


def optional_text(col: Column) -> Column:
    return F.nullif(strip(col), F.lit(""))


def _digest(prefix: str, col: Column) -> Column:
    return F.concat(F.lit(prefix), F.sha2(col, 256))


def safe_identifier(col: Column) -> Column:
    """Identifiers that are safe to print; anything else becomes its digest."""
    text = optional_text(col)
    printable = (F.length(text) <= 128) & text.rlike(r"\A[\p{L}\p{N}_.:\-]+\z")
    return F.when(printable, text).otherwise(_digest("invalid_identifier_sha256:", text))


def safe_hash(col: Column) -> Column:
    text = optional_text(col)
    return F.when(text.rlike(r"\A[0-9a-fA-F]{64}\z"), F.lower(text)).otherwise(
        _digest("invalid_hash_sha256:", text)
    )


_DIGEST = r"\A[0-9a-f]{64}\z"


def short_hash(col: Column) -> Column:
    """A digest in hex as its bytes, half as long where it shuffles; other text as it is."""
    hexed = col.rlike(_DIGEST)
    return F.struct(F.when(hexed, F.unhex(col)).alias("digest"), F.when(~hexed, col).alias("text"))


def long_hash(col: Column) -> Column:
    """The text that `short_hash` took."""
    return F.coalesce(F.lower(F.hex(col["digest"])), col["text"])


def derived_ledger_id(path: Column, snapshot_sha256: Column) -> Column:
    seed = F.concat(path, F.lit("\0"), snapshot_sha256)
    return F.concat(F.lit("ledger_"), F.left(F.sha2(seed, 256), F.lit(32)))


def truncate_text(col: Column, limit: int) -> Column:
    return F.left(col, F.lit(limit))


def is_truncated(col: Column, limit: int) -> Column:
    return F.length(col) > limit


def tail_text(col: Column, limit: int = 4000) -> Column:
    return F.right(col, F.lit(limit))


def basename(col: Column) -> Column:
    """Last path component under either separator, '' when there is none."""
    return F.regexp_extract(col, r"([^/\\]+)[/\\]*\z", 1)


def basename_project(col: Column) -> Column:
    return F.coalesce(F.nullif(basename(col), F.lit("")), F.lit("unknown"))


def utc_iso(ts: Column) -> Column:
    return F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_utc(text: Column) -> Column:
    """ISO text to a timestamp; missing text is an error, never a silent null."""
    return F.when(
        F.coalesce(text, F.lit("")) == "", F.raise_error(F.lit("missing timestamp"))
    ).otherwise(F.to_timestamp(text))


def event_id(*parts: Column) -> Column:
    """Deterministic id from the source position, so a replay mints the same id.

    The parts must tell apart all events of a source: a file that was cut and
    written anew needs its generation, a line split in pieces the piece's number.
    """
    seed = F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit("evt_"), F.left(F.sha2(seed, 256), F.lit(32)))


def position_parts(columns: list[str]) -> list[Column]:
    """Path and offset of a line, with generation and part where the reader gives them."""
    return [F.col(c) for c in ("path", "byte_offset", "generation", "part") if c in columns]


def parse_key_values(pairs: Column) -> Column:
    """``array<'KEY=VALUE'>`` to a map; the last value of a repeated key wins."""
    index = F.transform(
        pairs,
        lambda p: F.when(
            F.instr(p, "=") == 0,
            F.raise_error(F.concat(F.lit("Expected KEY=VALUE, got: "), p)),
        )
        .when(
            strip(F.split_part(p, F.lit("="), F.lit(1))) == "",
            F.raise_error(F.concat(F.lit("Empty key in field: "), p)),
        )
        .otherwise(
            F.struct(
                strip(F.substring_index(p, "=", 1)).alias("key"),
                F.element_at(F.split(p, "=", 2), 2).alias("value"),
            )
        ),
    )
    last = F.filter(
        index,
        lambda kv, i: ~F.exists(
            F.slice(index, i + 2, F.size(index)), lambda later: later["key"] == kv["key"]
        ),
    )
    return F.map_from_entries(last)


def extract_text_blocks(content: Column) -> Column:
    """Message text from a VARIANT: a string, or the text blocks of an array."""
    kind = F.schema_of_variant(content)
    blocks = F.try_variant_get(content, "$", "array<variant>")
    texts = F.transform(
        F.filter(
            blocks,
            lambda b: (F.try_variant_get(b, "$.type", "string") == "text")
            & (F.schema_of_variant(F.try_variant_get(b, "$.text", "variant")) == "STRING")
            & ~is_blank(F.try_variant_get(b, "$.text", "string")),
        ),
        lambda b: F.try_variant_get(b, "$.text", "string"),
    )
    return (
        F.when(kind == "STRING", F.try_variant_get(content, "$", "string"))
        .when(kind.startswith("ARRAY"), F.array_join(texts, "\n\n"))
        .otherwise(F.lit(""))
    )


def truthy(value: Column) -> Column:
    """Python truth of a VARIANT value."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    return (
        F.when(kind == "VOID", F.lit(False))
        .when(kind == "STRING", text != "")
        .when(kind == "BOOLEAN", text == "true")
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~F.to_json(value).isin("[]", "{}"))
        .otherwise(number != 0)
    )


def truthy_text(value: Column) -> Column:
    """Text of a VARIANT value, or null where Python's ``or`` would skip it."""
    return F.when(truthy(value), F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)))


def source_path(payload: Column, cwd: Column) -> Column:
    """Where an event came from: transcript, else path, else working directory."""
    doc = F.try_parse_json(payload)
    return F.coalesce(
        truthy_text(F.try_variant_get(doc, "$.transcript", "variant")),
        truthy_text(F.try_variant_get(doc, "$.path", "variant")),
        F.nullif(cwd, F.lit("")),
        F.lit(""),
    )


_REGEX_SPECIAL = set("\\.^$|()[]{}*+?-&~#")


def glob_regex(pattern: str) -> str:
    """Shell glob to an anchored Java regex; ``*`` also crosses ``/``."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) > 0:
            body, i = pattern[i:end], end + 1
            negate, body = body.startswith("!"), body.removeprefix("!")
            quoted = "".join("\\" + c if c in _REGEX_SPECIAL - {"-"} else c for c in body)
            out.append(f"[{'^' if negate else ''}{quoted}]")
        else:
            out.append("\\" + ch if ch in _REGEX_SPECIAL else ch)
    return r"(?s)\A(?:" + "".join(out) + r")\z"


def glob_match(col: Column, patterns: Iterable[str]) -> Column:
    """Case-insensitive match against any glob; no patterns match nothing."""
    value = F.lower(F.replace(col, F.lit("\\"), F.lit("/")))
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | value.rlike(glob_regex(pattern.replace("\\", "/").lower()))
    return hit


def path_ignored(col: Column, ignore_globs: Iterable[str]) -> Column:
    """Ignore rules of the file watcher: glob, ``dir/**`` prefix, or a path part."""
    path = F.replace(col, F.lit("\\"), F.lit("/"))
    parts = F.split(path, "/")
    hit = F.lit(False)
    for pattern in (g.replace("\\", "/") for g in ignore_globs):
        hit = hit | path.rlike(glob_regex(pattern)) | F.array_contains(parts, pattern)
        if pattern.endswith("/**"):
            prefix = pattern[:-3]
            hit = hit | (path == prefix) | path.startswith(prefix + "/")
    return hit
