"""op12 against brute force, and the search of a shard against full sums."""

import math
import random
import re

import numpy as np
import pytest

from tideline.llm import lexical, queries

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    docs = [(d, terms(t)) for d, t in docs]
    docs = [(d, t) for d, t in docs if t]
    n, total = len(docs), sum(len(t) for _, t in docs)
    holds = {}
    for _, t in docs:
        for x in set(t):
            holds[x] = holds.get(x, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        found = []
        for d, t in docs:
            m = 50 + 50 * len(t) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * holds[x] + 1))) * (1_000_000_000 * t.count(x) // (1000 * t.count(x) + 20 * m)) for x in wanted if x in t)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def items_of(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]


def test_equals_brute_force(spark, sf, documents):
    assert got(queries.op12_lexical(spark, sf)) == brute(list(documents.items()), items_of(spark, sf))


def test_odd_and_empty_tables(spark, odd_dir, empty_dir, odd_texts, sf):
    assert got(queries.op12_lexical(spark, odd_dir)) == brute(odd_texts, items_of(spark, odd_dir))
    assert queries.op12_lexical(spark, empty_dir).count() == 0
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    assert lexical.search(docs, items.limit(0)).count() == 0 and lexical.search(docs.limit(0), items).count() == 0


def test_blocks_of_items_and_small_shards_change_nothing(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"t{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights=range(1, 61), k=rng.choice([0, 1, 5, 30])))) for i in range(300)]
    docs += [(1000 + i, "t1 t2 t2") for i in range(30)]  # many equal scores
    items = [(i, " ".join(rng.sample(words, 6))) for i in range(12)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 7)
    monkeypatch.setattr(lexical, "SHARD", 600)
    monkeypatch.setattr(lexical, "SLICE", 300)
    assert got(lexical.search(a, b, 7, pairs=20)) == want


@pytest.mark.parametrize("seed", range(4))
def test_search_stops_early_with_the_right_documents(seed):
    rng = np.random.default_rng(seed)
    n_docs, n_terms, k = 4000, 8, 10
    term = rng.integers(0, n_terms, 12_000)
    doc = rng.integers(0, n_docs, 12_000)
    pair = np.unique(doc * n_terms + term)
    doc, term = pair // n_terms, pair % n_terms
    impact = np.floor(10 ** rng.uniform(0, 6, len(pair)) / (1 + 40 * term)).astype(np.int64) + 1
    index = lexical.Shard(term, doc, impact, n_terms)
    asked = np.arange(n_terms)
    full = np.bincount(doc, weights=impact, minlength=n_docs).astype(np.int64)
    docs, scores, read = index.search(asked, k, step=16)
    assert (full[docs] == scores).all() and read < len(pair)
    least = np.sort(full)[-k]
    assert set(np.flatnonzero(full >= least)) <= set(docs.tolist())
    again, _, _ = index.search(asked, k)
    assert set(again.tolist()) >= set(np.flatnonzero(full >= least).tolist())


def test_lengths_beyond_64_bits_stay_exact():
    lengths = np.array([1, 10**6, 10**9], np.int64)
    assert lexical.spread(lengths, 10**12, 10**15).tolist() == [50 + 50 * x * 10**12 // 10**15 for x in lengths.tolist()]
