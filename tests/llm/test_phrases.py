"""op11 against brute force, by either way of encoding and over many ranges; the sort and the run lengths."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tideline.llm import phrases, queries


def brute(rows, least, top=2000, longest=5):
    out = []
    langs = {}
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        langs.setdefault(lang if lang is not None else "und", []).extend(w for w in (re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n-\r]", low)) if w)
    for lang, pieces in langs.items():
        n = sum(map(len, pieces))
        f = Counter(tuple(w[i : i + k]) for w in pieces for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(25)] + ["É", "naïve", "x-1", "O'k"]
    rows = []
    for i in range(400):
        text = []
        for _ in range(rng.choice([0, 3, 20, 60])):
            text.append(rng.choices(words, weights=[40, 30, 20, 10, *[3] * 25])[0] if rng.random() > 0.1 else rng.choice(["New York City", "in the end of the day", "a b a b a b", f"rare{i} {rng.random()}"]))
            text.append(rng.choices([" ", "\t", ", ", ".", "\n", " ! ", "  "], weights=[60, 5, 3, 3, 2, 1, 5])[0])
        rows.append((i, "".join(text) if text else rng.choice([None, "", " \n"]), rng.choice(["en", "en", "de", None])))
    rows += [(1000 + i, "one very common line, that all copies share", "en") for i in range(150)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


@pytest.mark.parametrize(("most_words", "per_range", "slice_bytes"), [(1_000_000, 1_000_000, 1 << 22), (0, 1_000_000, 3_000), (1_000_000, 400, 2_000), (0, 150, 1_000)])
def test_equals_brute_force(made, monkeypatch, most_words, per_range, slice_bytes):
    rows, df = made
    monkeypatch.setattr(phrases, "SLICE", slice_bytes)
    want = brute([(lang, t) for _, t, lang in rows], 12)
    assert len(want) > 100 and {len(p.split()) for _, _, p, *_ in want} == {2, 3, 4, 5}
    assert got(phrases.collocations(df, least=12, most_words=most_words, per_range=per_range)) == want


def test_a_short_report_keeps_the_order_of_ties(made):
    rows, df = made
    assert got(phrases.collocations(df, least=12, top=7)) == brute([(lang, t) for _, t, lang in rows], 12, 7)


def test_odd_and_empty_tables(spark, odd_dir, empty_dir, odd_texts):
    odd = spark.read.parquet(f"{odd_dir}/documents.parquet")
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert got(queries.op11_phrases(spark, odd_dir)) == brute(rows, 100)
    assert got(phrases.collocations(odd, least=1)) == brute(rows, 1)
    assert queries.op11_phrases(spark, empty_dir).columns == phrases.collocations(odd, least=1).columns
    assert queries.op11_phrases(spark, empty_dir).count() == 0


def test_radix_order_ranges_and_runs():
    rng = np.random.default_rng(2)
    columns = [rng.choice(np.array([1, 2, 70_000, 4_000_000_000], np.uint32), 3000) for _ in range(phrases.LONGEST)]
    keys = list(zip(*[c.tolist() for c in columns], strict=True))
    order = phrases.radix_order(columns)
    assert [keys[i] for i in order] == sorted(keys)
    unique, n = phrases.combined(columns, np.ones(3000, np.int64))
    assert dict(zip(zip(*[c.tolist() for c in unique], strict=True), n.tolist(), strict=True)) == Counter(keys)
    rows = list(zip(*[c.tolist() for c in unique], strict=True))
    edges = sorted(rng.choice(len(rows), 9, replace=False).tolist())
    at = phrases._ranges(unique, [c[edges] for c in unique])
    assert at.tolist() == edges
    data = phrases._squeezed(unique, n)
    back, m = phrases._loosened(data, len(n))
    assert all((a == b).all() for a, b in zip(back, unique, strict=True)) and (m == n).all()
    for ids, a in phrases.phrase_runs(unique, n, 20):
        want = Counter(k[: len(ids)] for k in keys)
        told = dict(zip(zip(*[c.tolist() for c in ids], strict=True), a.tolist(), strict=True))
        assert all(want[k] == v for k, v in told.items()) and {k for k, v in want.items() if v >= 20} <= set(told)


def test_scores_beyond_64_bits_are_exact(spark):
    spark.range(1).selectExpr("CAST(1000 AS DECIMAL(4,0)) * CAST(9000000000000000 AS DECIMAL(19,0)) * CAST(8000000000000000007 AS DECIMAL(19,0)) DIV (CAST(9000000000000001 AS DECIMAL(19,0)) * CAST(9000000000000000 AS DECIMAL(19,0))) AS s").createOrReplaceTempView("big")
    assert spark.table("big").first()["s"] == 1000 * 9000000000000000 * 8000000000000000007 // (9000000000000001 * 9000000000000000)
