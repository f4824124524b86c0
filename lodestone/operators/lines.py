"""Line filters for command output, as Column expressions over arrays of lines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.common import blank_trim
from lodestone.functions.text import lines, normalize_log, strip_ansi

WINDOW = 4  #: entries that a repeated line is looked for in


@dataclass(frozen=True)
class Filter:
    """Stages in order: preprocess, ANSI strip, replacements, short circuit, strip/keep,
    width, head/tail, most lines, message for nothing."""

    strip_ansi: bool = True
    preprocess: str | None = None
    replacements: tuple[tuple[str, str], ...] = ()
    match: tuple[tuple[str, ...], ...] = ()  #: pattern, message and, if any, the pattern of an exception to it
    strip: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()
    width: int | None = None
    head: int | None = None
    tail: int | None = None
    most: int | None = None
    on_empty: str | None = None


def any_of(patterns: tuple[str, ...]) -> str:
    """One alternation, so that every line is matched once."""
    return "|".join(f"(?:{p})" for p in patterns)


def select_lines(rows: Column, strip: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> Column:
    """Lines that match no ``strip`` pattern and, if there are any, a ``keep`` pattern."""
    if strip:
        rows = F.filter(rows, lambda x: ~x.rlike(any_of(strip)))
    return F.filter(rows, lambda x: x.rlike(any_of(keep))) if keep else rows


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def head_tail(rows: Column, head: int | None, tail: int | None) -> Column:
    """First and last lines; lines in both stand twice."""
    if not head and not tail:
        return rows

    def cut(x: Column) -> Column:
        first = F.slice(x, F.lit(1), F.lit(head or 0))
        last = F.slice(x, F.greatest(F.size(x) - (tail or 0) + 1, F.lit(1)), F.lit(tail or 0))
        return F.concat(first, last) if head and tail else first if head else last

    return let(rows, cut)


def at_most(rows: Column, most: int | None) -> Column:
    """At most so many lines, and a line that says how many there were."""
    if not most:
        return rows

    def cut(x: Column) -> Column:
        note = F.concat(F.lit(f"[... truncado: mostrando {most} de "), F.size(x).cast("string"), F.lit(" linhas]"))
        return F.when(F.size(x) > most, F.concat(F.slice(x, 1, most), F.array(note))).otherwise(x)

    return let(rows, cut)


def group_repeated(rows: Column) -> Column:
    """Lines equal but for numbers, times and ids to one of the last four entries count
    with it: ``line (×N)``. A fold over the array, within the JVM; only the last four
    entries are looked at and changed."""
    entry = "struct<raw:string,norm:string,n:int>"
    state = f"struct<done:array<{entry}>,last:array<{entry}>>"

    def add(s: Column, line: Column) -> Column:
        def with_norm(pair: Column) -> Column:
            last, norm = s["last"], pair["norm"]
            back = F.array_position(F.transform(F.reverse(last), lambda e: e["norm"]), norm)
            at = F.size(last) - back
            more = F.transform(last, lambda e, i: F.struct(e["raw"].alias("raw"), e["norm"].alias("norm"), (e["n"] + F.when(i == at, 1).otherwise(0)).alias("n")))
            new = F.array(F.struct(pair["raw"].alias("raw"), norm.alias("norm"), F.lit(1).alias("n")))
            full = F.size(last) == WINDOW
            done = F.when((back == 0) & full, F.concat(s["done"], F.slice(last, 1, 1))).otherwise(s["done"])
            kept = F.when(back > 0, more).when(full, F.concat(F.slice(last, 2, WINDOW - 1), new)).otherwise(F.concat(last, new))
            return F.struct(done.alias("done"), kept.alias("last")).cast(state)

        return let(F.struct(line.alias("raw"), normalize_log(line).alias("norm")), with_norm)

    nothing = F.array().cast(f"array<{entry}>")
    entries = F.aggregate(rows, F.struct(nothing.alias("done"), nothing.alias("last")).cast(state), add, lambda s: F.concat(s["done"], s["last"]))
    return F.transform(entries, lambda e: F.when(e["n"] > 1, F.concat(e["raw"], F.lit(" (×"), e["n"].cast("string"), F.lit(")"))).otherwise(e["raw"]))


def git_log(text: Column, most: int = 50) -> Column:
    """Commits without merges, at most 50. Only lines that begin with Merge make a merge; an
    indented one belongs to the message."""
    blocks = F.split(text, r"(?md)(?=^commit )", -1)
    kept = F.filter(blocks, lambda b: ~b.rlike(r"(?md)^Merge(:| branch)") & (b != ""))
    return F.array_join(F.slice(kept, 1, most), "")


def push_to_ok(text: Column) -> Column:
    """The first line with an arrow that is no list item, after ``ok``; else the text."""
    found = F.get(F.filter(F.transform(lines(text), blank_trim), lambda x: x.contains("->") & ~x.startswith("*")), 0)
    return F.coalesce(F.concat(F.lit("ok "), found), text)


def commit_to_ok(text: Column) -> Column:
    """The first line ``[branch sha] message`` as ``ok sha branch: message``; else the text."""
    #: Fixed value: how a commit is reported; the hash has at least seven digits.
    pattern = r"^\[([^\s\]]+)\s+([0-9a-f]{7,})\]\s+(.+)$"
    found = F.get(F.filter(F.transform(lines(text), blank_trim), lambda x: x.rlike(pattern)), 0)
    return F.coalesce(F.regexp_replace(found, pattern, "ok $2 $1: $3"), text)


#: How typed values of a document store are written, and what is left of them.
TYPED = [
    (r'\{\s*"S"\s*:\s*("(?:[^"\\]|\\.)*")\s*\}', "$1"),
    (r'\{\s*"N"\s*:\s*"(-?[0-9.]+)"\s*\}', "$1"),
    (r'\{\s*"BOOL"\s*:\s*(true|false)\s*\}', "$1"),
    (r'\{\s*"NULL"\s*:\s*true\s*\}', "null"),
]


def unwrap_types(text: Column) -> Column:
    """{"S": "x"} as "x", {"N": "4"} as 4, and so for BOOL and NULL."""
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), TYPED, text)


def strip_policies(text: Column) -> Column:
    """Policy documents as a placeholder: braces are counted line by line from the line that begins one."""
    state = "struct<inside:boolean,depth:int,out:array<string>>"

    def braces(x: Column) -> Column:
        return F.length(F.regexp_replace(x, r"[^{]", "")) - F.length(F.regexp_replace(x, r"[^}]", ""))

    def step(s: Column, x: Column) -> Column:
        starts = ~s["inside"] & x.rlike(r'^\s*"PolicyDocument"')
        depth = F.when(s["inside"], s["depth"]).otherwise(0) + braces(x)
        mark = F.concat(F.regexp_extract(x, r'^[^"]*', 0), F.lit('"PolicyDocument": "<policy>",'))
        shown = F.concat(s["out"], F.array(F.when(starts, mark).otherwise(x)))
        still = F.when(s["inside"], depth > 0).when(starts, depth != 0).otherwise(False)
        return F.struct(still.alias("inside"), depth.cast("int").alias("depth"), F.when(s["inside"], s["out"]).otherwise(shown).alias("out")).cast(state)

    first = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out")).cast(state)
    return F.array_join(F.aggregate(lines(text), first, step, lambda s: s["out"]), "\n")


PREPROCESS = {
    "group_repeated": lambda text: F.array_join(group_repeated(lines(text)), "\n"),
    "preprocess_git_log": git_log,
    "reduce_push_to_ok": push_to_ok,
    "reduce_commit_to_ok": commit_to_ok,
    "strip_policy_documents": strip_policies,
    "unwrap_dynamodb_types": unwrap_types,
}


def apply(spec: Filter, text: Column) -> Column:
    """The filtered text; null stays null."""

    def rest(clean: Column) -> Column:
        rows = select_lines(lines(clean), spec.strip, spec.keep)
        if spec.width:
            rows = F.transform(rows, lambda x: F.left(x, F.lit(spec.width)))
        out = F.array_join(at_most(head_tail(rows, spec.head, spec.tail), spec.most), "\n")
        if spec.on_empty is not None:
            out = let(out, lambda o: F.when(blank_trim(o) == "", spec.on_empty).otherwise(o))
        for pattern, message, *exception in reversed(spec.match):
            hit = clean.rlike(pattern)
            for e in exception:
                hit = hit & ~clean.rlike(e)
            out = F.when(hit, message).otherwise(out)
        return F.when(clean.isNotNull(), out)

    clean = PREPROCESS[spec.preprocess](text) if spec.preprocess else text
    clean = strip_ansi(clean) if spec.strip_ansi else clean
    for pattern, by in spec.replacements:
        clean = F.regexp_replace(clean, pattern, by)
    return let(clean, rest)


def filter_key(command: Column, keys: dict[str, str], generic: dict[str, str]) -> Column:
    """Filter of a command line: by its first two words, else by its first, else null."""
    words = F.split(F.trim(command), r"\s+")
    first = F.get(words, 0)
    pair = F.concat_ws(" ", first, F.coalesce(F.get(words, 1), F.lit("")))
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(F.try_element_at(table(keys), pair), F.try_element_at(table(generic), first))


#: Commands by how their output begins.
BANNERS = {
    r"(?i)^\s*(compiling|finished|checking) ": "cargo build",
    r"(?i)^running (the test|\d+ tests?)": "cargo test",
    r"(?i)^collecting the commit|^commit [0-9a-f]{7,40}\b": "git log",
    r"(?i)^starting deployment": "docker logs",
    r"^On branch ": "git status",
    r"^diff --git ": "git diff",
}


def command_of(path: Column, text: Column) -> Column:
    """Command line of a log: after a prompt in its first line, else by how it begins, else its
    folder and the first word of its name, as in git/push-1.log."""
    first = F.substring_index(strip_ansi(text), "\n", 1)
    prompt = F.nullif(F.regexp_extract(first, r"^\s*[$>] +(\S.*?)\s*$", 1), F.lit(""))
    banner = reduce(lambda c, kv: c.when(first.rlike(kv[0]), kv[1]), BANNERS.items(), F.when(F.lit(False), ""))
    named = F.nullif(F.concat_ws(" ", F.regexp_extract(path, r"([^/]+)/[^/]*$", 1), F.regexp_extract(path, r"([^/.-]+)[^/]*$", 1)), F.lit(""))
    return F.coalesce(prompt, banner, named)


def compress(df: DataFrame, command: str, text: str) -> DataFrame:
    """``df`` with filter and filtered: each row's output by the filter of its command.

    The filters in use are few per table; rows choose theirs by a CASE, so a scan and no join does it.
    """
    from lodestone.operators.filters import FILTERS, GENERIC, KEYS

    named = df.withColumn("filter", filter_key(F.col(command), KEYS, GENERIC))
    out = F.when(F.lit(False), F.lit(""))
    for name, spec in FILTERS.items():
        out = out.when(F.col("filter") == name, apply(spec, F.col(text)))
    return named.withColumn("filtered", out.otherwise(F.col(text)))
