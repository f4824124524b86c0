"""Scalar text functions as Columns; null in, null out unless stated otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.common import blank_trim

#: Fixed value: one alternative per kind of token (digits, acronym before a capitalised word, acronym, word).
TOKEN = r"[0-9]+|[A-Z]+(?=[A-Z][a-z])|[A-Z]{2,}|[A-Z][a-z0-9]*|[a-z][a-z0-9]*"

#: Test and story files count less.
PENALTY = r"\.(stories\.(tsx|ts|js|jsx)|spec\.(ts|tsx)|test\.(ts|tsx))$"

#: Escape sequences of terminals, and the bell.
ANSI = r"\x1b\[[0-9;]*[A-Za-z]|\x1b[()][AB012]|\x1b[=>]|\x07|\x1b\].*?\x07"

#: Fixed values, in order: what differs between repeated log lines.
LOG_TOKENS = [
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<ts>"),
    (r"\d{1,2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}(?:\s[+-]\d{4})?", "<ts>"),
    (r"[A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}", "<ts>"),
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?\b", "<ip>"),
    (r"\b[0-9a-fA-F]{8,40}\b", "<hex>"),
    (r"/[A-Za-z0-9_./-]+/[A-Za-z0-9_.-]+", "<path>"),
    (r"\b\d{5,}\b", "<n>"),
]


def raw_tokens(text: Column) -> Column:
    """Lower-case pieces of identifiers and words, of any length."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def tokenize(text: Column | str) -> Column:
    """Tokens of more than two characters, in order, repetitions kept. Letters outside
    a-z separate; camel case and acronyms are split. Null gives null, '' an empty array."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(raw_tokens(text), lambda t: F.octet_length(t) > 2)


def sorted_tokens(text: Column | str) -> Column:
    """The tokens of :func:`tokenize` in alphabetical order, without a function call per token."""
    text = F.col(text) if isinstance(text, str) else text
    joined = F.lower(F.array_join(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), " "))
    return F.sort_array(F.filter(F.split(joined, " "), lambda t: F.octet_length(t) > 2))


#: Runs of equal words in a line of sorted words.
RUNS = r"(?<![^ ])([^ ]++)(?: \1(?![^ ]))*+"


def clean_query(query: Column) -> Column:
    """Without one leading [tag], trimmed."""
    return blank_trim(F.regexp_replace(query, r"^\[[^\]]+\]\s*", ""))


def penalty(path: Column) -> Column:
    """0.3 for test and story files, else 1."""
    return F.when(path.rlike(PENALTY), F.lit(0.3)).otherwise(F.lit(1.0))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """Name without its last extension; a name that only starts with a dot is kept."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def doc_title(path: Column) -> Column:
    """File stem with blanks for hyphens and underscores."""
    return F.translate(file_stem(path), "-_", "  ")


def embed_input(title: Column, chunk: Column) -> Column:
    """What is embedded: title, an empty line, the chunk; the chunk alone without title."""
    return F.when(F.coalesce(title, F.lit("")) == "", chunk).otherwise(F.concat(title, F.lit("\n\n"), chunk))


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def short_hash(text: Column, digits: int = 32) -> Column:
    """First hex digits of the content hash."""
    return F.substring(content_hash(text), 1, digits)


def search_mode(query: Column) -> Column:
    """exact, conceptual or expanded after the query's prefix, else auto."""
    prefix = F.lower(F.regexp_extract(blank_trim(query), r"(?i)^(exact|conceptual|expanded):", 1))
    return F.when(prefix == "", "auto").otherwise(prefix)


def search_text(query: Column) -> Column:
    """The query behind the prefix, in lower case if there is one; trimmed."""
    trimmed = blank_trim(query)
    rest = F.lower(blank_trim(F.regexp_replace(trimmed, r"(?i)^(exact|conceptual|expanded):", "")))
    return F.when(search_mode(query) == "auto", trimmed).otherwise(rest)


def normalize_log(line: Column) -> Column:
    """Timestamps, ids, addresses, paths and long numbers of one log line as place holders."""
    for pattern, name in LOG_TOKENS:
        line = F.regexp_replace(line, pattern, name)
    return line


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def approx_tokens(text: Column) -> Column:
    """A quarter of the bytes."""
    return F.floor(F.octet_length(text) / 4).cast("long")


def savings_percent(before: Column, after: Column) -> Column:
    saved = F.greatest(before - after, F.lit(0))
    return F.when(before > 0, saved / before * 100.0).otherwise(F.lit(0.0))


def relative_path(path: Column, bases: list[str]) -> Column:
    """Path below the first of ``bases`` that holds it, else the path."""
    out = path
    for base in reversed(bases):
        stem = base.rstrip("/") + "/"
        out = F.when(path.startswith(stem), path.substr(F.lit(len(stem) + 1), F.length(path))).otherwise(out)
    return out


def last_segment(name: Column) -> Column:
    """Simple name of a qualified one."""
    return F.element_at(F.split(name, "::"), -1)


def setting(*values: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def lines(text: Column) -> Column:
    """Lines without their ends; a closing line end doesn't start another line."""
    parts = F.split(text, "\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
