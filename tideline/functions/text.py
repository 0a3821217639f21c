"""Time strings, titles, markup and line breaking, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A decimal number as times are written: digits with an optional fraction or exponent.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Markup of a line: what an angle bracket or a brace opens, until both are closed or the line ends.
_BOTH_OPEN = r"(?:[^>}]*+(?:\}[^>{]*+\{|>[^}<]*+<))*+[^>}]*+(?:\z|\}[^>{]*+(?:>|\z)|>[^}<]*+(?:\}|\z))"
MARKUP = rf"<[^>{{]*+(?:>|\z|\{{{_BOTH_OPEN})|\{{[^}}<]*+(?:\}}|\z|<{_BOTH_OPEN})"
#: White space of lines.
BLANK = r"[\s\u0085   -     　]+"

#: ASCII characters that file names don't keep, without the null character.
OTHERS = "".join(c for c in map(chr, range(1, 128)) if not c.isalnum() and c != "-")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once though it is used more often, also in lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(s: Column) -> Column:
    """Without the white space at either end, of whatever kind."""
    return F.regexp_replace(s, rf"\A{BLANK}+|(?<!{BLANK[:-1]}){BLANK}+\z", "")


def parse_time(s: Column) -> Column:
    """Seconds of `S`, `M:S` or `H:M:S`; only the last part may have a fraction, later parts are below 60; else null."""
    parts = F.split(stripped(s), ":", -1)
    n = F.size(parts)
    ok = F.forall(parts, lambda p: p.rlike(NUMBER)) & (n <= 3)
    numbers = F.when(ok, F.transform(parts, lambda p: p.try_cast("double")))
    fine = F.forall(F.transform(numbers, lambda v, i: (v >= 0) & (v < float("inf")) & ((i == 0) | (v < 60)) & ((i == n - 1) | (v == F.floor(v)))), lambda x: x)
    return F.when(fine, F.aggregate(numbers, F.lit(0.0), lambda acc, v: acc * 60 + v))


def parse_timestamp(s: Column) -> Column:
    """Seconds of `H:M:S,mmm` or `M:S.mmm`; minutes and seconds are below 60, hours are not limited; else null."""
    part = [F.regexp_extract(stripped(s), r"^(?:(\d+):)?(\d+):(\d+)[,.](\d{3})$", i).try_cast("long") for i in range(1, 5)]
    h, m, sec, ms = part
    return F.when((m < 60) & (sec < 60), F.coalesce(h, F.lit(0)) * 3600 + m * 60 + sec + ms / 1000.0)


def clean_markup(line: Column) -> Column:
    """A line without `<...>` and `{...}` (one that isn't closed runs to the end), its white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, MARKUP, ""), BLANK, " "))  # only blanks are left


def wrapped(text: Column, width: int, most: int) -> Column:
    """At most `most` lines of `width` characters, greedy by words; longer words are split, a cut end becomes `...`.

    For ASCII text (see ascii_title). What is kept while folding is bounded by most + 1 lines."""
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    pieces = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / width).cast("int")), lambda i: F.struct(F.substring(w, i * width + 1, width).alias("p"), ((i > 0) | (F.length(w) > width)).alias("part"), (i * width + width < F.length(w)).alias("full")))))

    def step(acc: Column, x: Column) -> Column:
        cur, p = acc["cur"], x["p"]
        joins = (cur != "") & ~x["part"] & (F.length(cur) + 1 + F.length(p) <= width)
        # a part of a split word starts a line, and a full part ends it
        done = F.when((cur == "") | joins, acc["lines"]).otherwise(_push(acc["lines"], cur, most))
        after = F.when(x["full"], _push(done, p, most)).otherwise(done)
        return F.struct(after.alias("lines"), F.when(x["full"], F.lit("")).when(joins, F.concat(cur, F.lit(" "), p)).otherwise(p).alias("cur"))

    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("cur"))
    lines = F.aggregate(pieces, start, step, lambda acc: F.when(acc["cur"] == "", acc["lines"]).otherwise(_push(acc["lines"], acc["cur"], most)))
    return F.when(F.size(lines) > most, F.concat(F.slice(lines, 1, most - 1), F.array(F.concat(F.substring(F.get(lines, F.lit(most - 1)), 1, width - 3), F.lit("..."))))).otherwise(lines)


def _push(lines: Column, line: Column, most: int) -> Column:
    return F.when(F.size(lines) > most, lines).otherwise(F.array_append(lines, line))


def ascii_title(s: Column) -> Column:
    """Trimmed; every character outside printable ASCII becomes `?`."""
    return F.regexp_replace(stripped(s), "[^ -~]", "?")


def header_title(s: Column) -> Column:
    """The first 12 letters, digits and blanks, as capitals."""
    start = F.regexp_extract(s, r"\A(?:[^A-Za-z0-9 ]*+[A-Za-z0-9 ]){0,12}+", 0)  # no more of a long text is replaced
    return F.upper(F.regexp_replace(start, "[^A-Za-z0-9 ]", ""))


def stem(name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def output_name(title: Column, collapse: bool = False) -> Column:
    """A file name of a title: other characters than letters, digits and `-` become `_` (collapse: one for a run), none at the ends."""
    # ASCII is mapped in one walk, as a regular expression costs far more for each of many matches
    plain = F.regexp_replace(F.translate(title, OTHERS, "_" * len(OTHERS)), r"[^\x01-\x7F]", "_")
    if collapse:
        for old, new in (("_", "<>"), ("><", ""), ("<>", "_")):
            plain = F.replace(plain, F.lit(old), F.lit(new))
    return let(F.btrim(plain, F.lit("_")), lambda bare: F.when(bare == "", "video").otherwise(bare))


def clock(seconds: Column) -> Column:
    """MM:SS of rounded seconds; minutes stop at 99."""
    whole = F.round(seconds).cast("long")
    return F.concat(F.lpad(F.least(F.floor(whole / 60), F.lit(99)).cast("string"), 2, "0"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def clock_floor(seconds: Column) -> Column:
    """MM:SS of whole seconds passed; minutes stop at 99."""
    return clock(F.floor(seconds))


def clock_tenths(seconds: Column) -> Column:
    """M:SS.s, rounded to tenths before it is split."""
    tenths = F.round(seconds * 10).cast("long")
    return F.concat(F.floor(tenths / 600).cast("string"), F.lit(":"), F.lpad(F.floor(tenths % 600 / 10).cast("string"), 2, "0"), F.lit("."), (tenths % 10).cast("string"))


def mib(size: Column) -> Column:
    """A size in MiB with one decimal; halves go to the even digit."""
    return F.format_string("%.1f MiB", F.rint(size / 1048576.0 * 10) / 10)
