"""Secret scans in DataFrame functions alone: fixed rules, and character Markov models for the rest.

Rules give spans of three kinds (a value assigned to a telling name, an access key id, a long hex string). Two
first-order Markov models over characters, one of random strings and one of ordinary identifiers, are trained on
labelled samples. Random is what the rules find. Ordinary are long runs of letters elsewhere, and identifiers with
digits made by rule from the sample's words and from row numbers: slugs, paths, dates, UUIDs and decimal numbers. Every
run of token characters outside the rules' spans that holds a digit and is long enough is scored by the log-likelihood
ratio of the two models; a ratio above the threshold adds a span of kind `model`. Spans count code points, ends are exclusive.

Positions come from the lengths of the texts between matches, inside each row: no shuffle but the one that counts
character pairs of the sample (at most 2 * 67 * 67 groups), which is also all that reaches the driver. Prefix sums are
taken in two levels, so a text with very many spans stays nearly linear; no pattern looks ahead.

Null texts count as empty and have no span; repeated rows repeat; an empty table trains models from the made
identifiers alone and gives an empty result; a table without findings adds no span. Column names of the
input other than id and text are kept out of all expressions. Very long texts are scanned whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "model")

#: Least characters of an assigned value; of a string that the models judge.
VALUE_MIN, RUN_MIN = 6, 20
#: Token characters, in the order of the models' states.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: A run of token characters; it is judged if it holds a digit.
RUN = rf"[A-Za-z0-9+/_=-]{{{RUN_MIN},}}"
#: Letters that stand for ordinary identifiers in training, and words from which ordinary ones with digits are made.
ORDINARY, PLAIN_WORD = r"[A-Za-z_-]{12,}", r"[A-Za-z]{2,12}"
#: Documents of the training sample, at most about so many; nats by which a random string must be likelier; pseudo-count of a pair; made identifiers of each sort.
SAMPLE_DOCS, LEAST_RATIO, PSEUDO, MADE = 10_000, 16.0, 0.5, 1_000
#: Elements, and characters, of a block where positions are summed, and text is cut, in two levels.
STRIDE, PIECE = 256, 8_192

#: Columns that find() adds.
BASE, ALL = "_secret_base", "_secret_spans"
SPANS = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once though it is used in lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(values: Column, use: Callable[[Column, Callable[[Column], Column]], Column], step: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """use(values, before), where before(i) is the fold of the values ahead of place i, from 0."""

    def folded(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), step)

    def inner(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / STRIDE).cast("int")), lambda b: folded(F.slice(v, b * STRIDE + 1, STRIDE)))
        starts = _let(blocks, lambda sums: F.transform(F.sequence(F.lit(1), F.size(sums)), lambda b: folded(F.slice(sums, 1, b - 1))))
        return _let(starts, lambda s: use(v, lambda i: step(F.get(s, F.floor(i / STRIDE).cast("int")), folded(F.slice(v, i - i % STRIDE + 1, i % STRIDE)))))

    return _let(values, inner)


def _parts(text: Column, pattern: str, value_group: int = 0) -> Column:
    """gap, hit and value of each leftmost match that doesn't overlap; the last gap has no hit."""
    return F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("value")
    )


def _spans(text: Column, pattern: str, kind: int, value_group: int = 0, fine: Callable[[Column], Column] = lambda v: v.isNotNull()) -> Column:
    """The spans of the matches whose group is fine."""

    def placed(parts: Column) -> Column:
        lengths = F.transform(parts, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0)))

        def spans(_: Column, before: Callable[[Column], Column]) -> Column:
            def span(x: Column, i: Column) -> Column:
                start = before(i) + F.length(x["gap"])
                return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["hit"])).alias("end"), F.coalesce(fine(x["value"]), F.lit(False)).alias("fine"))

            found = F.filter(F.transform(parts, span), lambda s: s["fine"])
            return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

        return _before(lengths, spans)

    return F.when(text.rlike(pattern), _let(_parts(text, pattern, value_group), placed)).otherwise(F.array().cast(SPANS))


def base_spans(text: Column) -> Column:
    access = F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, 1)).otherwise(F.array().cast(SPANS))
    return F.array_sort(F.concat(_spans(text, ASSIGN, 0, 2, lambda v: F.length(v) >= VALUE_MIN), access, _spans(text, HEX, 2)))


def _pairs(run: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, 2))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """Log-likelihood ratio (random to ordinary) of each pair of ALPHABET's characters, row by row."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    text = F.coalesce(F.col("text"), F.lit(""))
    sample = docs.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select(text.alias("text"))
    sample = sample.select("text", F.regexp_extract_all("text", F.lit(PLAIN_WORD), F.lit(0)).alias("words"))  # read more than once
    random = F.concat(F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= RUN_MIN // 2), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    ordinary = F.concat(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0)), _slugs(F.col("words")))
    runs = sample.select(F.explode(F.array(F.struct(F.lit(1).alias("random"), random.alias("runs")), F.struct(F.lit(0).alias("random"), ordinary.alias("runs")))).alias("x"))
    made = docs.sparkSession.range(MADE).select(F.struct(F.lit(0).alias("random"), _made(F.col("id")).alias("runs")).alias("x"))
    runs = runs.union(made)
    pairs = runs.select("x.random", F.explode(F.flatten(F.transform("x.runs", _pairs))).alias("pair")).groupBy("random", "pair").count()
    n = len(ALPHABET)
    seen = [[[0.0] * n for _ in range(n)] for _ in range(2)]
    for r in pairs.where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).collect():  # at most 2 * 67 * 67 rows
        seen[r["random"]][ALPHABET.index(r["pair"][0])][ALPHABET.index(r["pair"][1])] += r["count"]

    def log_share(rows: list[list[float]], a: int, b: int) -> float:
        return math.log((rows[a][b] + PSEUDO) / (sum(rows[a]) + PSEUDO * n))

    return [log_share(seen[1], a, b) - log_share(seen[0], a, b) for a in range(n) for b in range(n)]


def _slugs(words: Column) -> Column:
    """Ordinary identifiers with digits of a text's first words, joined in four ways."""
    some, number = F.slice(words, 1, 4), F.pmod(F.xxhash64(F.get(words, F.lit(0))), F.lit(1_000)).cast("string")
    return F.when(F.size(words) >= 4, F.array(F.concat(F.array_join(some, "_"), F.lit("_"), number), F.concat(F.array_join(some, "-"), F.lit("-"), number), F.concat(F.lit("/"), F.array_join(some, "/"), F.lit("/"), number), F.concat(F.array_join(F.transform(some, F.initcap), ""), number))).otherwise(F.array().cast("array<string>"))


def _made(n: Column) -> Column:
    """Ordinary identifiers of a row number: a UUID, a decimal number, a path with a date, a dated name."""
    h = F.md5(n.cast("string"))
    uuid = F.concat_ws("-", *[F.substring(h, a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    number = F.concat(*[F.lpad(F.pmod(F.xxhash64(n, F.lit(i)), F.lit(10**8)).cast("string"), 8, "0") for i in range(3)])
    date = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), n.cast("int")), "yyyy-MM-dd")
    return F.array(uuid, number, F.concat(F.lit("/home/data/"), F.translate(date, "-", "/"), F.lit("/part-"), F.lpad(n.cast("string"), 5, "0")), F.concat(F.lit("report_"), date, F.lit("_v"), (n % 30).cast("string")))


def _ratio(run: Column, table: Column) -> Column:
    """The log-likelihood ratio of a string of ALPHABET's characters."""

    def summed(state: Column) -> Column:
        n = F.size(state) - 1
        pairs = F.zip_with(F.slice(state, 1, n), F.slice(state, 2, n), lambda a, b: F.get(table, a * len(ALPHABET) + b))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)

    return _let(F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), summed)


def _blanked(text: Column, pattern: str, value_group: int = 0, least: int = 1) -> Column:
    """The text with blanks for the characters of each match whose group isn't shorter than `least`."""

    def filled(x: Column) -> Column:
        return F.concat(x["gap"], F.when(F.length(x["value"]) >= least, F.repeat(F.lit(" "), F.length(x["hit"]))).otherwise(F.coalesce(x["hit"], F.lit(""))))

    return F.array_join(F.transform(_parts(text, pattern, value_group), filled), "")


def find(docs: DataFrame, table: list[float], threshold: float = LEAST_RATIO) -> DataFrame:
    """docs with two more columns: BASE (spans of the rules) and ALL (all spans), each sorted by start, then kind."""
    ratios = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")  # one literal, folded before the run
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.withColumn(BASE, base_spans(text))
    rest = F.when(F.size(BASE) > 0, _blanked(_blanked(_blanked(text, ASSIGN, 2, VALUE_MIN), ACCESS), HEX)).otherwise(text)
    judged = base.withColumn("_secret_rest", rest)
    random = _spans(F.col("_secret_rest"), RUN, 3, 0, lambda run: F.when(run.rlike("[0-9]"), _ratio(run, ratios) >= threshold))
    added = judged.withColumn("_secret_added", random)
    spans = F.when(F.size("_secret_added") > 0, F.array_sort(F.concat(BASE, "_secret_added"))).otherwise(F.col(BASE))
    return added.withColumn(ALL, spans).drop("_secret_rest", "_secret_added")


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = find(rows, train(rows))

    def count(kind: int) -> Column:
        return F.size(F.filter(BASE, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", *map(count, range(3)), F.sha2(joined(F.col(BASE)), 256).alias("base_sha256"), joined(F.col(ALL)).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs (with doc_id, text and n_chars) with every span replaced by the mask; overlapping spans share one."""
    found = find(docs, train(docs.select("doc_id", "text")))
    text = F.col("text")

    def cleaned(pieces: Column) -> Column:
        def cut(start: Column, n: Column) -> Column:
            first = F.floor(start / PIECE).cast("int")
            last = F.floor((start + n - 1) / PIECE).cast("int")
            return F.when(n > 0, F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), start - first * PIECE + 1, n)).otherwise(F.lit(""))

        def out(ends: Column, before: Callable[[Column], Column]) -> Column:
            masked = F.transform(ALL, lambda s, i: _let(before(i), lambda at: F.when(s["start"] >= at, F.concat(cut(at, s["start"] - at), F.lit(mask))).otherwise(F.lit(""))))
            return F.concat(F.array_join(masked, ""), _let(F.array_max(ends), lambda at: cut(at, F.length(text) - at)))

        return _before(F.transform(ALL, lambda s: s["end"]), out, lambda a, b: F.greatest(a, b))

    clean = _let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)), cleaned)
    new = F.when(F.size(ALL) > 0, clean).otherwise(text)
    changed = found.withColumn("text", new)
    n_chars = F.when(F.size(ALL) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return changed.withColumn("n_chars", n_chars).select(docs.columns)
