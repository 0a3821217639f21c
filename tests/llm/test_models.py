"""op2, op6 and op8: held-out accuracy, exact base scores, probabilities that sum to one."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tideline.llm import attention, langid, lm, quality, queries

from .conftest import folded

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def test_op2_held_out_accuracy(spark, sf, documents):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op2_language(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    assert all(r["held_out"] == (folded(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]] and documents[r["doc_id"]] and len(documents[r["doc_id"]]) > 40]
    assert len(held) > 20 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_op2_odd_and_empty_tables(spark, odd_dir, empty_dir, odd_texts):
    rows = queries.op2_language(spark, odd_dir).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in odd_texts)
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} >= {1, 2, 3, 4}
    assert queries.op2_language(spark, empty_dir).count() == 0


def test_filters_hold_what_they_got_in_any_number_of_languages():
    rng = np.random.default_rng(4)
    grams = {f"l{i:03d}": rng.integers(1, 1 << 63, 300, dtype=np.uint64) for i in range(70)}
    filters = langid.build(grams)
    for i, name in enumerate(filters.languages):
        words = filters.masks(grams[name])
        assert (words[i // 64] >> words[i // 64].dtype.type(i % 64) & words[i // 64].dtype.type(1) == 1).all()


def test_op6_counts_and_base_scores(spark, sf, documents):
    tokens = {d: [*WORD.findall(lower(t or "")), None] for d, t in documents.items()}
    count = Counter(w for d, ws in tokens.items() if folded(d, 7) != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    rows = queries.op6_lm(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        ws = tokens[r["doc_id"]]
        assert r["train_tokens"] == n and r["n_tokens"] == len(ws) and r["n_known"] == sum(count[w] > 0 for w in ws)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r["held_out"] == (folded(r["doc_id"], 7) == 2) and math.isfinite(r["score"]) and r["score"] < 0
    # the base gives every unknown word 1 / (n + v + 1) and so isn't normalised; the model is, and still better on held-out texts
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op6_a_hot_word_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(lm, "SLICE", 64)
    monkeypatch.setattr(lm, "FEWEST", 4)
    texts = [f"hot hot w{i} hot x{i % 5}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    count = Counter(w for i, t in enumerate(texts) if i % 7 != 2 for w in [*t.split(), None])
    n, v = sum(count.values()), len(count)
    for r in lm.score(df, queries.BYTE_BPE, lm.F.col("doc_id") % 7 != 2).collect():
        ws = [*texts[r["doc_id"]].split(), None]
        assert r["train_tokens"] == n and r["n_known"] == sum(count[w] > 0 for w in ws)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)


def test_op6_odd_and_empty_tables(spark, odd_dir, empty_dir, odd_texts):
    rows = queries.op6_lm(spark, odd_dir).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == Counter((d, len(WORD.findall(t or "")) + 1) for d, t in odd_texts)
    assert all(math.isfinite(r["score"]) for r in rows)
    assert queries.op6_lm(spark, empty_dir).count() == 0


def windows_of(texts):
    b, out = attention.BLOCK, []
    for t in texts:
        ids = [*[attention.OUTSIDE] * 2 * b, 20, *t.tolist(), 21, *[attention.OUTSIDE] * 2 * b]
        out += [ids[i : i + 2 * b + 1] for i in range(b, len(t) + b, 5)]
    return np.array(out)


def forward(model, x, y, text, i):
    """Log probability of y[i], position by position and without batches."""
    d, b = attention.D, attention.BLOCK
    own, q, k, v = (model.table[:, n * d : (n + 1) * d].astype(float) for n in range(4))
    seen = [j for j in range(max(0, (i // b - 1) * b), i + 1) if text[j] == text[i]]
    s = np.array([q[x[i]] @ k[x[j]] + float(model.near[i % b, j - (i // b - 1) * b]) for j in seen])
    a = np.exp(s - s.max())
    state = np.tanh(own[x[i]] + sum(w * v[x[j]] for w, j in zip(a / a.sum(), seen, strict=True)))
    logits = state @ model.out.astype(float) + model.bias
    c = model.cls[y[i]]
    return logits[c] - logits.max() - np.log(np.exp(logits - logits.max()).sum()) + model.share[y[i]]


def test_attention_equals_an_unbatched_forward_pass(monkeypatch):
    monkeypatch.setattr(attention, "ROUND", 4 * attention.BLOCK)
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 20, n) for n in (1, 3, 150, 40, 0, 77)]
    model = attention.train(windows_of(texts), 22, steps=40)
    x = np.concatenate([[20, *t] for t in texts]).astype(int)
    y = np.concatenate([[*t, 21] for t in texts]).astype(int)
    text = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    got = model.log_prob(x, y, text)
    assert np.allclose(got, [forward(model, x, y, text, i) for i in range(len(x))], atol=1e-3)


def test_op6_scores_equal_a_word_by_word_sum():
    """One slice of text, its counts from plain dictionaries: the mixture of attention, shares and remembered continuations."""
    rng = np.random.default_rng(3)
    pool = [f"w{i}" for i in range(30)]
    passage = [pool[i] for i in rng.integers(0, 30, 60)]
    docs = [" ".join([*(pool[i] for i in rng.integers(0, 30, n)), *(passage if n % 2 else [])]) for n in (5, 9, 20, 31, 2, 0)]
    learn = np.array([True, False, True, True, False, True])
    tokens = [[*d.split(), None] for d in docs]
    count = Counter(w for ws, own in zip(tokens, learn, strict=True) if own for w in ws)
    pair, context, low = Counter(), Counter(), 64 - int(lm.CONTEXT_BITS)
    hashed = [words_of(d) for d in docs]
    spots = [dict(zip(*(a.tolist() for a in lm.continuations(h, np.array([0, len(h)]))), strict=True)) for h in hashed]
    for spot, own in zip(spots, learn, strict=True):
        for key in spot.values():
            pair[key] += own
            context[key >> low] += own
    sub = lm.Subwords(queries.BYTE_BPE)
    model = attention.train(np.zeros((0, 2 * attention.BLOCK + 1), int), sub.size, steps=0)
    every = np.unique(np.concatenate(hashed))
    names = {h: w for hs, ws in zip(hashed, tokens, strict=True) for h, w in zip(hs.tolist(), ws, strict=False)}
    totals = np.array([*(count[names[h]] for h in every.tolist()), count[None]])
    keys = sorted({k for spot in spots for k in spot.values()})
    known = np.array([[pair[k] for k in keys], [context[k >> low] for k in keys]])
    n = sum(count.values())
    _, _, _, score, apart = lm.score_slice(docs, learn, totals, known, n, len(count), sub, model, left_out=True)
    assert np.array_equal(lm.score_slice(docs, learn, totals, known, n, len(count), sub, model)[3], score)
    # the subwords of all texts in one row, as blocks of the attention begin at multiples of their length
    subs = [[[sub.end] if w is None else lm_ids(sub, w) for w in ws] for ws in tokens]
    ys = [[i for one in parts for i in one] for parts in subs]
    x = np.array([i for y in ys for i in [sub.start, *y[:-1]]])
    logs = np.split(model.log_prob(x, np.concatenate(ys), np.repeat(np.arange(len(ys)), [len(y) for y in ys])).astype(float), np.cumsum([len(y) for y in ys])[:-1])
    for d, (ws, own, spot) in enumerate(zip(tokens, learn, spots, strict=True)):
        owner, by_model = np.repeat(np.arange(len(ws)), [len(one) for one in subs[d]]), logs[d]
        for got, out in ((score[d], False), (apart[d], own)):
            others = n - (len(ws) if out else 0)
            want = 0.0
            for i, w in enumerate(ws):
                p = lm.ATTENTION * math.exp(by_model[owner == i].sum()) + (1 - lm.ATTENTION) * (count[w] - (ws.count(w) if out else 0)) / others
                if i in spot:
                    hits = pair[spot[i]] - (sum(k == spot[i] for k in spot.values()) if out else 0)
                    seen = context[spot[i] >> low] - (sum(k >> low == spot[i] >> low for k in spot.values()) if out else 0)
                    if seen:
                        p = (1 - seen / (seen + lm.HALF)) * p + hits / (seen + lm.HALF)
                want += math.log10(p)
            assert math.isclose(got, want, rel_tol=1e-4, abs_tol=1e-3)
    assert set(spots[2]) == set(range(lm.CONTEXT, 20))  # every word with a whole context


def words_of(text):
    raw, _ = lm.joined([text])
    return lm.words(raw)[2]


def lm_ids(sub, word):
    raw, _ = lm.joined([word])
    start, end, hashes = lm.words(raw)
    at, n = sub.of(hashes, raw, start, end)
    return sub.ids[at[0] : at[0] + n[0]].tolist()


def test_op6_sets_documents_apart_that_occur_twice(spark):
    rng = np.random.default_rng(8)
    pool = [f"w{i}" for i in range(3000)]
    texts = [" ".join(pool[i] for i in rng.zipf(1.3, 150) % 3000) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate([*texts, *texts[:20]])), "doc_id long, text string")
    got = lm.score(df, queries.BYTE_BPE, lm.F.col("doc_id") % 7 != 2, left_out=True).collect()
    rows = {r["doc_id"]: r["score_left_out"] / r["n_tokens"] for r in got}
    assert all(r["score"] > r["score_left_out"] if r["learnt"] else r["score"] == r["score_left_out"] for r in got)
    once = sorted(rows[i] for i in range(20, 300))
    twice = [i for i in range(20) if (i + 300) % 7 != 2]  # the other copy is learned from
    assert sum(rows[i] > once[-6] for i in twice) >= 0.9 * len(twice)


def test_a_pass_of_tasks_moves_the_model_towards_the_text(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = [np.repeat(rng.integers(0, 10, 12), 2) for _ in range(60)]
    rows = windows_of(texts)
    table = spark.createDataFrame([(i < 40, w.astype("<i4").tobytes()) for i, w in enumerate(rows)], "first boolean, window binary").repartition(3)
    monkeypatch.setattr(attention, "STEPS", 30)
    first = sorted(w.astype("<i4").tobytes() for w in rows[:40])
    state = attention.fitted(np.frombuffer(b"".join(first), "<i4").reshape(-1, rows.shape[1]), 22)
    assert np.array_equal(state.of_rows(state.rows()).p["out"], state.p["out"])
    before, after = state.model(), lm._model(table, 22)
    x, y = np.concatenate([[20, *t] for t in texts]), np.concatenate([[*t, 21] for t in texts])
    text = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    assert after.log_prob(x, y, text).sum() > before.log_prob(x, y, text).sum() + 1
    assert np.allclose(lm._model(table, 22).table, after.table)


def test_windows_learn_every_token_of_every_text_once():
    rng = np.random.default_rng(4)
    per = np.array([0, 1, 63, 64, 65, 400])
    ids = rng.integers(0, 20, per.sum())
    b, learnt = attention.BLOCK, Counter()
    for batch in attention.covered(ids, per, 20, 21, rng):
        there = (batch[:, b:-1] != attention.OUTSIDE) & (batch[:, b + 1 :] != attention.OUTSIDE)
        for x, y, ok in zip(batch[:, b:-1], batch[:, b + 1 :], there, strict=True):
            learnt.update(zip(x[ok].tolist(), y[ok].tolist(), strict=True))
    texts = np.split(ids, np.cumsum(per)[:-1])
    assert learnt == Counter(p for t in texts for p in zip([20, *t.tolist()], [*t.tolist(), 21], strict=True))


def test_longer_windows_move_a_model_as_their_parts_do():
    rng = np.random.default_rng(6)
    b = attention.BLOCK
    batch = next(attention.covered(rng.integers(0, 20, 900), np.array([500, 90, 0, 310]), 20, 21, rng))
    parts = np.concatenate([batch[:, i : i + 2 * b + 1] for i in range(0, attention.LEARNT * b, b)])
    state = attention.start(parts, 22, rng)
    one, other = (attention.Adam(state.of_rows(state.rows())) for _ in range(2))
    one.update(batch, 0.01)
    other.update(parts, 0.01)
    assert all(np.allclose(one.m1[k], other.m1[k], atol=1e-6) for k in attention.ORDER)


def test_a_range_of_keys_is_sorted_once(monkeypatch):
    """Counts of continuations and of their contexts, against plain dictionaries; contexts are in order as soon as the keys are."""
    rng, low = np.random.default_rng(12), 64 - int(lm.CONTEXT_BITS)
    slices_ = [np.unique((rng.integers(0, 5, 60) << 40 | rng.integers(0, 9, 60)).astype(np.uint64)) for _ in range(4)]
    counts = [rng.integers(0, 4, len(s)) for s in slices_]
    table = pa.table({
        "slice": list(range(4)), "range": pa.array([1 << 8] * 4, pa.int32()),
        "hashes": [lm.planes(np.diff(s, prepend=np.uint64(0))) for s in slices_], "counts": [lm.planes(c.astype("<u4")) for c in counts],
    })

    class Grouped:
        def groupBy(self, *_):  # noqa: N802
            return self

        def applyInArrow(self, work, _):  # noqa: N802
            return work(table)

    calls, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda *a, **k: calls.append(1) or unique(*a, **k))
    got = lm._answers(Grouped(), 8)
    assert len(calls) == 1
    pair, context = Counter(), Counter()
    for s, c in zip(slices_, counts, strict=True):
        for key, n in zip(s.tolist(), c.tolist(), strict=True):
            pair[key] += n
            context[key >> low] += n
    for s, row in zip(slices_, got["totals"], strict=True):
        hits, seen = lm.from_planes(row.as_py(), "<u4").reshape(2, -1).tolist()
        assert hits == [pair[k] for k in s.tolist()] and seen == [context[k >> low] for k in s.tolist()]


def test_op6_learns_from_all_training_text(spark, monkeypatch):
    monkeypatch.setattr(lm, "SLICE", 2_000)
    monkeypatch.setattr(attention, "STEPS", 5)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 50, n)) + (" zebra" if n == 33 else "") for n in rng.integers(0, 80, 200)]
    docs = spark.createDataFrame([(i, i % 7 != 2, t) for i, t in enumerate(texts)], "doc_id long, learn boolean, text string")
    sub, sliced = lm.Subwords(queries.BYTE_BPE), lm.kept(lm._slices(docs), "slices")
    windows = lm.kept(lm._windows(sliced, queries.BYTE_BPE, 40), "windows")  # what is drawn is a small part of the text
    start, model = lm._model(windows, sub.size), lm._model(windows, sub.size, sliced, queries.BYTE_BPE)
    ids, per = lm._ids([t for i, t in enumerate(texts) if i % 7 != 2], sub)
    count = np.bincount(ids, minlength=sub.size)
    count[sub.end] += len(per)
    assert np.array_equal(model.share, attention.shares(model.cls, count + attention.UNSEEN))
    text = np.repeat(np.arange(len(per)), per)
    assert model.log_prob(np.roll(ids, 1), ids, text).sum() > start.log_prob(np.roll(ids, 1), ids, text).sum() + 1
    assert (model.table[ids] != start.table[ids]).any(1).all()  # every subword that occurs has been learned


def test_attention_gives_probabilities_and_windows_score_alike():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 20, rng.integers(1, 90)) for _ in range(40)]
    model = attention.train(windows_of(texts), 22, steps=60)
    x = np.concatenate([[20], texts[3]])
    total = np.zeros(len(x))
    for y in range(22):
        total += np.exp(model.log_prob(x, np.full(len(x), y), np.zeros(len(x), int)))
    assert np.allclose(total, 1, atol=1e-4)
    # a text's scores do not depend on its neighbours
    a, b = np.concatenate([[20], texts[1]]), np.concatenate([[20], texts[2]])
    both = model.log_prob(np.concatenate([a, b]), np.concatenate([[*texts[1], 21], [*texts[2], 21]]), np.repeat([0, 1], [len(a), len(b)]))
    alone = model.log_prob(a, np.array([*texts[1], 21]), np.zeros(len(a), int))
    assert np.allclose(both[: len(a)], alone, atol=1e-4)


def test_op8_held_out_ranking(spark, sf, documents):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op8_quality(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        assert r["held_out"] == (folded(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.9


def test_op8_odd_and_empty_tables(spark, odd_dir, empty_dir, odd_texts):
    rows = queries.op8_quality(spark, odd_dir).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in odd_texts)
    assert queries.op8_quality(spark, empty_dir).count() == 0


def test_neighbours_vote_as_brute_force_does():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["ab", "cd", "Ef", "9", "x!"], 12)) for _ in range(60)]
    space = rng.normal(size=(quality.WIDTH, 8)).astype(np.float32)
    voters = quality.Voters(np.ones(quality.WIDTH, np.float32), space, np.zeros((0, 8), np.float32), np.zeros(0), 0.4)
    assert voters.score(texts[:2]).tolist() == [0.4, 0.4]
    voters.vectors, voters.labels = voters.latent(texts[:40]), (np.arange(40) % 2).astype(float)
    for text, got in zip(texts[40:], voters.score(texts[40:]), strict=True):
        cos = (voters.vectors @ voters.latent([text])[0]).astype(float)
        near = np.argsort(-cos, kind="stable")[: quality.NEAREST]
        w = np.maximum(cos[near], 0) ** quality.POWER
        assert abs(got - (w * voters.labels[near]).sum() / w.sum()) < 1e-3


def test_subword_cache_survives_a_reset(monkeypatch):
    monkeypatch.setattr(lm, "WORDS_KEPT", 3)
    sub = lm.Subwords(queries.BYTE_BPE)
    model = attention.train(windows_of([np.array([1, 2, 3])]), sub.size, steps=2)
    texts = ["a b c d e f", "g h i j", ""]
    nothing = (texts, np.ones(3, bool), np.zeros(11, np.int64), np.zeros((2, 0), np.int64), 0, 0, sub, model)
    first, again = lm.score_slice(*nothing), lm.score_slice(*nothing)
    assert np.allclose(first[3], again[3]) and first[0].tolist() == [7, 5, 1]


def test_subwords_of_words_already_met_are_not_computed_again(monkeypatch):
    """250,000 different words are more than a worker kept before, when it read them all again; A-Z count as a-z."""
    sub, calls = lm.Subwords(queries.BYTE_BPE), []
    ids_of = sub.pieces.ids_of
    monkeypatch.setattr(sub.pieces, "ids_of", lambda letters: calls.append(1) or ids_of(letters))
    texts = [" ".join(f"w{i:x}{'é' * (i % 3)}" for i in range(at, at + 50_000)) for at in range(0, 250_000, 50_000)]
    first = [lm._ids([t, ""], sub) for t in texts]
    assert len(calls) == 250_000 and all(per[1] == 0 and per[0] == len(ids) for ids, per in first)
    again = [lm._ids([t.replace("w", "W"), ""], sub)[0] for t in texts]
    assert len(calls) == 250_000 and all(np.array_equal(a, ids) for a, (ids, _) in zip(again, first, strict=True))
    byte = Tokenizer.from_file(queries.BYTE_BPE)
    for word in ("w", "wéé", "abcdefghijklmnopqrstuvw", "abcdefghijklmnopqrstuvwx", "Donaudampfschifffahrtsgesellschaft"):
        assert lm._ids([word], sub)[0].tolist() == byte.encode(" " + word.lower(), add_special_tokens=False).ids


def test_planes_give_the_values_back():
    rng = np.random.default_rng(5)
    for kind, most in (("<u4", 1 << 32), ("<i8", 1 << 62), ("<u8", 1 << 63)):
        for n in (0, 1, 257):
            values = rng.integers(0, most, n).astype(kind)
            assert np.array_equal(lm.from_planes(lm.planes(values), kind), values)
