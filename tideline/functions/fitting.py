"""Fitting lines of text into a few rows of a box, as column expressions.

A row holds as many characters as fit its width at a size (characters are `advance` of the size wide). What is needed
of a word is where it lands: the row it begins in and how far that row is then filled follow from the word's length, so
a fold over lengths counts the rows at every size, and a second one, at the size chosen, gathers the text of the rows
that are shown. State is bounded by those rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANK, let

# Widest row, sizes to try, rows shown.
WIDTH, SIZES, MOST = 232.0, (12, 11, 10, 9), 2


def capacity(size: int, advance: float) -> int:
    """Characters of a row; one that is too wide alone still gets a row."""
    return max(1, int(WIDTH // (size * advance)))


def placed_words(lines: Column) -> Column:
    """An array of struct(word, first): the words of all lines, and whether each begins a line. Null lines are left out."""

    def of_line(line: Column) -> Column:
        words = F.filter(F.split(line, BLANK), lambda w: w != "")
        return F.transform(words, lambda w, i: F.struct(w.alias("word"), (i == 0).alias("first")))

    return F.flatten(F.transform(F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: x.isNotNull()), of_line))


def _landing(acc: Column, word: Column, room: Column | int) -> tuple[Column, Column, Column, Column]:
    """Whether a word continues the current row, the row it begins in, the last row it reaches, and how far that is filled."""
    n = F.length(word["word"])
    joins = ~word["first"] & (acc["used"] + 1 + n <= room)
    more = F.floor((n - 1) / room).cast("int")  # further rows that a word wider than a row takes
    begins = F.when(joins, acc["row"]).otherwise(acc["row"] + 1)
    return joins, begins, F.when(joins, acc["row"]).otherwise(acc["row"] + 1 + more), F.when(joins, acc["used"] + 1 + n).otherwise(n - more * room)


def rows_needed(words: Column, room: int) -> Column:
    """How many rows of `room` characters the words take."""

    def step(acc: Column, w: Column) -> Column:
        _, _, last, used = _landing(acc, w, F.lit(room))
        return F.struct(last.cast("int").alias("row"), used.cast("int").alias("used"))

    start = F.struct(F.lit(-1).alias("row"), F.lit(0).alias("used"))
    return F.aggregate(words, start, step, lambda acc: acc["row"] + 1)


def first_rows(words: Column, room: Column) -> Column:
    """The first MOST rows of `room` characters; rows there are none of are empty."""

    def step(acc: Column, w: Column) -> Column:
        joins, begins, last, used = _landing(acc, w, room)

        def shown(text: Column, i: Column) -> Column:
            part = F.substring(w["word"], ((i - begins) * room + 1).cast("int"), room.cast("int"))
            return F.when(joins & (i == begins), F.concat(text, F.lit(" "), w["word"])).when(~joins & (begins <= i) & (i <= last), part).otherwise(text)

        return F.struct(last.cast("int").alias("row"), used.cast("int").alias("used"), F.transform(acc["shown"], shown).alias("shown"))

    start = F.struct(F.lit(-1).alias("row"), F.lit(0).alias("used"), F.array_repeat(F.lit(""), MOST).alias("shown"))
    return F.aggregate(words, start, step, lambda acc: acc["shown"])


def fitted(lines: Column, advance: float = 0.5) -> Column:
    """struct(size, lines): the largest size at which MOST rows suffice; else the smallest, the last row ending in an ellipsis.

    Words wider than a row are broken; nothing else is. Null and blank lines have no rows."""
    rooms = [capacity(size, advance) for size in SIZES]

    def chosen(words: Column) -> Column:
        size, room, needed = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("int")
        last = rows_needed(words, rooms[-1])
        for s, r in zip(reversed(SIZES), reversed(rooms), strict=True):
            n = last if s == SIZES[-1] else rows_needed(words, r)
            enough = (n <= MOST) if s != SIZES[-1] else F.lit(True)
            size, room, needed = (F.when(enough, F.lit(s)).otherwise(size), F.when(enough, F.lit(r)).otherwise(room), F.when(enough, n).otherwise(needed))
        return F.struct(words.alias("words"), size.alias("size"), room.alias("room"), needed.alias("needed"))

    def written(x: Column) -> Column:
        whole = F.slice(x["shown"], 1, F.least(x["needed"], F.lit(MOST)))
        cut = F.concat(F.rtrim(F.substring(F.get(x["shown"], F.lit(MOST - 1)), F.lit(1), x["room"] - 1)), F.lit("…"))
        rows = F.when(x["needed"] <= MOST, whole).otherwise(F.concat(F.slice(x["shown"], 1, MOST - 1), F.array(cut)))
        return F.struct(x["size"].alias("size"), rows.alias("lines"))

    def gathered(x: Column) -> Column:
        return F.struct(x["size"].alias("size"), x["room"].alias("room"), x["needed"].alias("needed"), first_rows(x["words"], x["room"]).alias("shown"))

    return let(let(let(placed_words(lines), chosen), gathered), written)
