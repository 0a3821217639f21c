"""Layouts, colours, sample clocks and little-endian bytes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import parse_time, stripped

# Screen size, audio rate, samples of an audio block, samples of a clock tick.
SCREEN_W, SCREEN_H, RATE, BLOCK_SAMPLES, TICK = 240, 160, 13379, 2048, 224
# Tone curve, luma weights and saturation of the small screen.
GAMMA, LUMA, SATURATION = 0.6, (0.299, 0.587, 0.114), 1.2
#: Mean difference of samples from which a frame starts a scene.
SCENE_CUT = 40


def _even(x: Column) -> Column:
    return x - x % 2


def layout(w: Column, h: Column, half_res: Column) -> Column:
    """struct(w, h, x_off, y_off): a picture's largest even size inside the screen (or its half), centred."""
    box_w, box_h = (F.when(half_res, n // 2).otherwise(n).cast("long") for n in (SCREEN_W, SCREEN_H))
    w, h = w.cast("long"), h.cast("long")
    wide = w * box_h >= h * box_w  # the width decides
    fit_w = F.when((w <= 0) | (h <= 0) | wide, box_w).otherwise(F.floor(w * box_h / h))
    fit_h = F.when((w <= 0) | (h <= 0) | ~wide, box_h).otherwise(F.floor(h * box_w / w))
    out_w, out_h = (F.greatest(_even(x.cast("long")), F.lit(2)) for x in (fit_w, fit_h))
    return F.struct(out_w.alias("w"), out_h.alias("h"), _even(F.floor((box_w - out_w) / 2)).alias("x_off"), F.floor((box_h - out_h) / 2).cast("long").alias("y_off"))


def fill_scale(w: Column, h: Column) -> Column:
    """Scale (of 256) that fills the screen with a picture of this size."""
    return F.floor(F.least(w / float(SCREEN_W), h / float(SCREEN_H)) * 256).cast("int")


def tone(r: Column, g: Column, b: Column) -> Column:
    """struct(r, g, b) for a dim screen: brighter by a power curve, then more saturated."""
    lit = [F.pow(c / 255.0, F.lit(GAMMA)) * 255.0 for c in (r, g, b)]
    luma = lit[0] * LUMA[0] + lit[1] * LUMA[1] + lit[2] * LUMA[2]
    out = [F.least(F.greatest(F.round(luma + (v - luma) * SATURATION), F.lit(0.0)), F.lit(255.0)).cast("int") for v in lit]
    return F.struct(*[v.alias(n) for v, n in zip(out, "rgb", strict=True)])


def to_555(r: Column, g: Column, b: Column) -> Column:
    """15-bit colour, red lowest."""
    return F.shiftright(r, 3).bitwiseOR(F.shiftleft(F.shiftright(g, 3), 5)).bitwiseOR(F.shiftleft(F.shiftright(b, 3), 10))


def from_555(c: Column) -> Column:
    """struct(r, g, b): each five bits, their high three repeated below."""
    five = [F.shiftright(c, 5 * i).bitwiseAND(31) for i in range(3)]
    return F.struct(*[F.shiftleft(v, 3).bitwiseOR(F.shiftright(v, 2)).alias(n) for v, n in zip(five, "rgb", strict=True)])


def blend(a: Column, b: Column, t: Column) -> Column:
    """From a to b as t goes from 0 to 1."""
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return a + (b - a) * t


def to_samples(seconds: Column) -> Column:
    return F.greatest(F.round(seconds * RATE), F.lit(0)).cast("long")


def frame_step(fps: Column) -> Column:
    """Samples of a frame in 16.16 fixed point."""
    return F.floor(F.lit(RATE << 16) / fps).cast("long")


def total_samples(frames: Column, fps: Column) -> Column:
    return F.shiftright(frames * frame_step(fps), 16)


def due_tick(frame: Column, fps: Column) -> Column:
    """The first clock tick at which a frame is due."""
    return F.ceil(frame * frame_step(fps) / float(TICK << 16)).cast("long")


def block_start(sample: Column) -> Column:
    """The sample at which the audio block of a sample begins."""
    return sample - sample % BLOCK_SAMPLES


def clip_seconds(start: Column, end: Column, whole: Column) -> Column:
    return F.greatest(F.least(F.coalesce(end, whole), whole) - F.coalesce(start, F.lit(0.0)), F.lit(0.0))


def range_error(start: Column, end: Column, whole: Column) -> Column:
    """What is wrong with a range, or null; an end beyond the clip is allowed."""
    begin = F.coalesce(start, F.lit(0.0))
    return F.when(end <= begin, "end must be after start").when(begin >= whole, "start is beyond the end of the clip")


def checksum(data: Column, first: int, last: int, less: int = 0x19) -> Column:
    """A header's check byte: minus the sum of bytes first..last, minus a constant, modulo 256."""
    at = F.sequence(F.lit(first + 1), F.lit(last + 1))
    total = F.aggregate(at, F.lit(0).cast("long"), lambda acc, i: acc + F.conv(F.hex(F.substring(data, i, 1)), 16, 10).cast("long"))
    return F.pmod(-total - less, F.lit(256))


def little_endian(data: Column, at: Column | int, size: int) -> Column:
    """The unsigned number in `size` bytes from byte `at` (from 0) on."""
    at = at if isinstance(at, Column) else F.lit(at)
    parts = [F.conv(F.hex(F.substring(data, at + 1 + i, F.lit(1))), 16, 10).cast("long") * (1 << 8 * i) for i in range(size)]
    return sum(parts[1:], parts[0])


def aligned(size: Column, to: int = 4) -> Column:
    return (F.floor((size + to - 1) / to) * to).cast("long")


def bytes_of(number: Column, size: int = 4) -> Column:
    """An unsigned number as `size` little-endian bytes."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.floor(number / (1 << 8 * i)).cast("long") % 256), 2, "0")) for i in range(size)])


def packed(records: Column) -> Column:
    """An array of binaries as one: how many there are, then each with its length before it."""
    body = F.transform(records, lambda r: F.concat(bytes_of(F.octet_length(r)), r))
    return F.unhex(F.concat(F.hex(bytes_of(F.size(records))), F.array_join(F.transform(body, F.hex), "")))


def unpacked(data: Column) -> Column:
    """The records of packed(), or null where a length points beyond the data or bytes remain."""
    n, size = little_endian(data, 0, 4), F.octet_length(data)

    def step(acc: Column, _: Column) -> Column:
        length = F.when(acc["at"] + 4 <= size, little_endian(data, acc["at"], 4))
        end = acc["at"] + 4 + length
        fits = acc["fits"] & F.coalesce(end <= size, F.lit(False))
        record = F.substring(data, acc["at"] + 5, length.cast("int"))
        return F.struct(F.when(fits, end).otherwise(acc["at"]).cast("int").alias("at"), fits.alias("fits"), F.when(fits, F.array_append(acc["out"], record)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(4).alias("at"), F.lit(True).alias("fits"), F.array().cast("array<binary>").alias("out"))
    counted = F.when((size >= 4) & (n <= size), F.sequence(F.lit(1).cast("long"), n, F.lit(1).cast("long")))
    return F.when((size == 4) & (n == 0), F.array().cast("array<binary>")).otherwise(F.aggregate(F.when(n > 0, counted), start, step, lambda acc: F.when(acc["fits"] & (acc["at"] == size), acc["out"])))


def trimmed(start: Column, end: Column, whole: Column) -> Column:
    """start and end in seconds of two time strings, of which either may be blank, within a clip of `whole` seconds; or what is wrong with them."""
    blank = [stripped(s) == "" for s in (start, end)]
    low, high = (F.when(~b, parse_time(s)) for b, s in zip(blank, (start, end), strict=True))
    error = F.when(~blank[0] & low.isNull(), "start is no time").when(~blank[1] & high.isNull(), "end is no time").when(low >= high, "end must be after start").when(low >= whole, "start is beyond the end of the clip")
    return F.struct(F.when(error.isNull(), F.coalesce(low, F.lit(0.0))).alias("start"), F.when(error.isNull(), F.least(F.coalesce(high, whole), whole)).alias("end"), error.alias("error"))


def usable(text: Column, error: Column) -> Column:
    """Subtitles that are there and have no error, else null."""
    return F.when(error.isNull(), text)
