"""op13 against brute force over all pairs, and what its samples and sketches tell."""

import random
import re
from collections import Counter

import numpy as np

from tideline.llm import jaccard, oddsketch, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        t = top(i)
        least[t] = d if least.get(t) is None else least[t] if d is None else min(least[t], d)
    of = [least[top(i)] for i in range(len(rows))]
    return Counter((d, len(s), c, None if d is None or c is None else d == c) for (d, _), s, c in zip(rows, sets, of, strict=True))


def got(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def test_equals_brute_force(spark, sf, documents):
    assert got(queries.op13_odd_sketch(spark, sf)) == brute(list(documents.items()))


def test_odd_and_empty_tables(spark, odd_dir, empty_dir, odd_texts):
    assert got(queries.op13_odd_sketch(spark, odd_dir)) == brute(odd_texts)
    assert queries.op13_odd_sketch(spark, empty_dir).count() == 0


def test_near_the_limit_and_a_large_group(spark):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(90):  # from copies to similarities well below the limit
        t = list(base)
        for _ in range(i % 9):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 40])))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(oddsketch.classes(df)) == brute(rows)


def test_samples_and_sketches_tell_the_similarity():
    rng = np.random.default_rng(3)
    for similarity in (0.95, 0.85, 0.6):
        told, sampled = [], []
        for _ in range(30):
            both = int(similarity * 800)
            u = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
            cut = both + (800 - both) // 2
            a, b = np.unique(u[:cut]), np.unique(np.concatenate([u[:both], u[cut:]]))
            told.append(oddsketch.estimate(oddsketch.sketch(a), oddsketch.sketch(b)))
            sampled.append((oddsketch.samples(a) == oddsketch.samples(b)).mean())
        assert abs(np.mean(sampled) - similarity) < 0.025 and abs(np.mean(told) - similarity) < 0.03
    assert oddsketch.estimate(oddsketch.sketch(a), oddsketch.sketch(a)) == 1.0


def test_limit_of_differing_bits_follows_from_its_loss():
    assert oddsketch.most_bits(loss=1e-3) < oddsketch.most_bits() < oddsketch.most_bits(percent=70)
    rng = np.random.default_rng(4)
    most = oddsketch.most_bits(loss=0.05)
    beyond = 0
    for _ in range(2000):
        differ = rng.binomial(oddsketch.SAMPLES, 0.15)
        beyond += (np.bincount(rng.integers(0, oddsketch.BITS, 2 * differ), minlength=oddsketch.BITS) & 1).sum() > most
    assert 0.02 < beyond / 2000 < 0.08
    assert (1 - 0.85**oddsketch.ROWS) ** oddsketch.BANDS < 1e-10


def test_long_sets_are_hashed_in_parts():
    s = np.unique(np.random.default_rng(5).integers(0, 1 << 63, 3 * oddsketch.AT_ONCE + 7, dtype=np.uint64))
    parts = np.minimum.reduce([oddsketch.samples(x) for x in np.array_split(s, 5)])
    assert (parts == oddsketch.samples(s)).all()
    assert len(jaccard.set_id(s).to_bytes(8, "little", signed=True)) == 8
