from __future__ import annotations

import collections
import hashlib
import itertools
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.llm import jaccard, warc
from lumora.llm.ann import BlockIndex, search
from lumora.llm.automaton import Lexicon, compile_lexicon
from lumora.llm.bpe import Tokenizer, build_lexicon, decode, encode
from lumora.llm.common import drop_ids, fold, row_key, thinned
from lumora.llm.components import components
from lumora.llm.decontaminate import find_leaks
from lumora.llm.grams import Grams
from lumora.llm.language import fit_language, predict_language
from lumora.llm.lattice import Lattice
from lumora.llm.lm import DISCOUNTS, Vocabulary, mixed, score_texts, token_mass, tokens
from lumora.llm.quality import _fit_risk, _objective, _roughness
from lumora.llm.quality import bound_prior, fit_quality, pu_risk, score_quality
from lumora.llm.queries import oracle_sql, queries, tokenizer_path
from lumora.llm.shingles import shingle_sets
from lumora.llm.toxicity import fit_toxicity, score_toxicity
from lumora.llm.urls import Markov, Rule, fit_urls, judge_urls

DOC = "doc_id bigint, text string, lang string, score double, _id string"
WORDS = "the of and to in is that for it with as was on are by this be at from or have an they which one you were all her she there would their we him been has when who will no more if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people mr how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()


def docs_of(spark, rows):
    """Documents with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, lang, 0.5, "x") for i, t, lang in rows], DOC)


def text(rnd, n, words=WORDS):
    return " ".join(rnd.choice(words) for _ in range(n))


ODD = [(9001, None, None), (9002, "", "en"), (9003, "   \n\t", "en"), (9004, "x", None), (9005, "the " * 30000, "en"), (None, "no id here at all", "en"), (9007, "1234 5678", "en")]


def empty(df):
    return df.where(F.lit(False))


# 1 toxicity
def test_toxicity(spark):
    rnd = random.Random(1)
    rows = [(i, text(rnd, 60) + (" vilescum grotwad " if i % 3 == 0 else " ") + text(rnd, 40), "en") for i in range(240)]
    docs = docs_of(spark, rows + ODD)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _, _ in rows] + [(1, 0), (3, 1), (9001, None), (None, 1), (77777, 1)], "doc_id bigint, toxic int")
    model = fit_toxicity(docs, labels, keep=fold("doc_id", 5) != 0, bits=16)
    got = {r["doc_id"]: r["score"] for r in score_toxicity(docs, model).collect()}
    assert len(got) == len(rows) + len(ODD) and all(0 <= s <= 1 for s in got.values())
    held = [i for i, _, _ in rows if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert held and all((got[i] >= 0.5) == (i % 3 == 0) for i in held)
    assert got[9001] == got[9002]
    assert max(r["score"] for r in score_toxicity(docs, fit_toxicity(docs, empty(labels), bits=16)).collect()) < 1e-6
    assert score_toxicity(empty(docs), model).count() == 0
    assert score_toxicity(docs, model, keep=tuple(docs.columns), score_col="_t").columns == [*docs.columns, "_t"]


def test_toxicity_against_brute_force(spark):
    """Ratios and objective of the fit, from sets of n-grams counted here."""
    rnd = random.Random(71)
    rows = [(i, text(rnd, rnd.randint(1, 30)) + (" scum" if i % 4 == 0 else ""), "en") for i in range(120)]
    docs, y = docs_of(spark, rows + rows[:40]), np.array([float(i % 4 == 0) for i, _, _ in rows])  # a third repeats
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _, _ in rows], "doc_id bigint, toxic int")
    grams = Grams((3, 4), 16)
    sets = [set(grams.ids(t).tolist()) for _, t, _ in rows]
    assert sets[0] == {int(h) for part in grams._buckets(rows[0][1]) for h in part}
    n1, n0 = y.sum(), len(y) - y.sum()
    c = {y_: collections.Counter(g for s, v in zip(sets, y, strict=True) if v == y_ for g in s) for y_ in (0.0, 1.0)}
    ratio = {g: np.log((c[1.0][g] + 1) / (n1 + 2)) - np.log((c[0.0][g] + 1) / (n0 + 2)) for g in c[0.0] | c[1.0]}
    ratio = {g: r for g, r in ratio.items() if abs(r) >= 0.25 and c[0.0][g] + c[1.0][g] >= 4}
    surety = {g: abs(r) / np.sqrt(1 / (c[0.0][g] + 1) + 1 / (c[1.0][g] + 1)) for g, r in ratio.items()}
    assert fit_toxicity(docs, labels, orders=(3, 4), bits=16).info["features"] == sum(x >= 2 for x in surety.values()) > 0
    model = fit_toxicity(docs, labels, orders=(3, 4), bits=16, least_surety=0.0)
    assert model.info["features"] == len(ratio) and model.info["rows"] == 120 and not set(np.flatnonzero(model.weights)) - set(ratio)
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)

    def loss(w, bias):
        z = np.array([bias + sum(w[g] * ratio[g] for g in s if g in ratio) for s in sets])
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * 3e-3 * sum(v * v for v in w.values())

    w = {g: model.weights[g] / ratio[g] for g in ratio}
    best = loss(w, model.bias)
    for g in rnd.sample(sorted(ratio), 30):  # no step makes it better
        for step in (0.05, -0.05):
            assert loss(w | {g: w[g] + step}, model.bias) > best - 1e-6
    bound = fit_toxicity(docs, labels, orders=(3, 4), bits=16, per_class=10)
    assert bound.info["rows"] == 20


def test_kept_columns_may_not_clash(spark):
    docs = docs_of(spark, ODD)
    model = fit_toxicity(docs, empty(spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")), bits=12)
    for run in (lambda: score_toxicity(docs, model, keep=("doc_id", "score")), lambda: predict_language(docs, fit_language(empty(docs), bits=10), keep=("score",)), lambda: score_quality(docs, fit_quality(empty(docs), empty(spark.createDataFrame([(1, 1)], "doc_id bigint, quality int"))), keep=("score",)),
                lambda: score_texts(docs, Vocabulary.load(tokenizer_path("piece_bpe_32k.model")), train=F.lit(True), keep=("score",))):
        with pytest.raises(ValueError):
            run()


def test_samples_are_bounded(spark):
    """Rows without an id, and rows that repeat, are sampled like others."""
    rows = [(None, f"text {i % 700}", "en") for i in range(3000)] + [(1, "one text", "en")] * 3000
    df = docs_of(spark, rows)
    got = thinned(df, row_key("doc_id", "text"), 50, df.count(), "text").count()
    assert 0 < got <= 1.3 * 50 + 100 + 40
    assert thinned(df, row_key("doc_id", "text"), 10**6, df.count(), "text").count() == 701


# 3 language
def test_kernel_against_brute_force(spark):
    """The score of a text is that of a kernel ridge regression on presence kernels."""
    rnd = random.Random(72)
    parts = {"aa": "kar tol min vesh".split(), "bb": "oui lune croix fleur".split()}
    rows = [(i, text(rnd, rnd.randint(1, 12), parts[k]), k) for i, k in enumerate(list(parts) * 15)]
    docs = docs_of(spark, rows)
    model = fit_language(docs, bits=15, landmarks_per_lang=99, orders=(1, 2))
    assert model.landmarks.shape[1] == len({t for _, t, _ in rows}) or model.landmarks.shape[1] == 30
    grams = {i: {t.lower()[j : j + n] for n in (1, 2) for j in range(len(t) - n + 1)} for i, t, _ in rows}

    def kernel(a, b):
        return len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b)))

    # every learned text is a landmark, so the regression is the exact one with an intercept
    ids = [i for i, _, _ in rows]
    k = np.array([[kernel(grams[a], grams[b]) for b in ids] for a in ids])
    y = np.array([1.0 if lang == "aa" else -1.0 for _, _, lang in rows])
    ones = np.ones((len(ids), 1))
    values, vectors = np.linalg.eigh(k + 1e-6 * np.eye(len(ids)))
    phi = np.hstack([k @ (vectors / np.sqrt(np.maximum(values, 1e-6))), ones])
    w = np.linalg.solve(phi.T @ phi + 1e-2 * np.eye(phi.shape[1]), phi.T @ y)
    want = phi @ w
    got = {r["doc_id"]: r for r in predict_language(docs, model).collect()}
    for i, f in zip(ids, want, strict=True):
        assert got[i]["lang_pred"] == ("aa" if f > 0 else "bb") and abs(got[i]["score"] - min(1.0, (abs(f) + 1) / 2)) < 0.02


def test_no_language_is_left_out(spark):
    names = [f"l{j:02d}" for j in range(70)]
    docs = docs_of(spark, [(i, " ".join([f"{k}word", f"more{k}", f"{k}{k}"] * 3) + f" {i}", k) for i, k in enumerate(names[:-1] * 6 + names[-1:] * 2)])
    model = fit_language(docs, bits=14, most_rows=20, most_landmarks=10)
    assert model.langs == names and model.landmarks.shape == (1 << 14, 140)
    assert all(r["lang_pred"] == r["lang"] for r in predict_language(docs, model, keep=("lang",)).collect())


def test_language(spark):
    rnd = random.Random(2)
    parts = {"aa": "kar tol min vesh".split(), "bb": "oui lune croix fleur".split(), "cc": "stra gelb wurz hof".split()}
    rows = [(i, text(rnd, 30, parts[k]), k) for i, k in enumerate(list(parts) * 40)]
    docs = docs_of(spark, rows + ODD)
    model = fit_language(docs.where("doc_id < 9000"), keep=fold("doc_id", 5) != 0, bits=12)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict_language(docs, model).collect()}
    assert all(got[i][0] == k for i, _, k in rows) and all(0 <= s <= 1 for _, s in got.values())
    assert got[9001] == got[9002] == got[9003] == got[9007] == ("und", 0.0) and got[9005][0] in parts
    none = fit_language(empty(docs), bits=12)
    assert {r["lang_pred"] for r in predict_language(docs, none).collect()} == {"und"}
    assert predict_language(empty(docs), model).count() == 0


def test_language_stage_rejects_the_unlearned(spark, tmp_path):
    import corpus_pipeline as P

    rnd = random.Random(51)
    kinds = {"en": WORDS, "xo": [w[::-1] + "o" for w in WORDS], "xu": ["u" + w[::-1] for w in WORDS], "xi": [w[1:] + "i" + w[:1] for w in WORDS]}
    rows = [(i, text(rnd, rnd.choice([1, 3, 10, 40, 40, 100, 400]), kinds[k]), k) for i, k in enumerate(list(kinds) * 150)]
    rows += [(i, f"{t} +1 (555) 010-9988 token = d94b244acde2e3b0aa8f051af1ec018ebaba3add ### 77", k) for i, (_, t, k) in enumerate(rows[:40], 1000)]
    junk = [
        "В начале было слово и все люди знали что зима придет скоро", "语言是人类最重要的交际工具人们利用它来进行交际交流思想", "Η γλώσσα είναι ένα σύστημα που χρησιμοποιούν οι άνθρωποι",
        "Bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar akıl ve vicdana sahiptirler", "a" * 300, "aaaaaa " * 50, " ".join("".join(rnd.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(60)),
    ]
    docs = docs_of(spark, rows + [(5000 + i, t, "en") for i, t in enumerate(junk)] + [(6000 + i, t, None) for i, t in enumerate(junk)])
    kept = {r["doc_id"] for r in P.language(spark, docs, str(tmp_path)).collect()}
    assert not {i for i in kept if i >= 5000}
    lost = {i: t[:60] for i, t, _ in rows if i not in kept}
    assert not lost


# 4 quality
def test_risk_and_prior_by_hand(spark):
    rng = np.random.default_rng(5)
    zp, zu = rng.normal(1, 1, 50), rng.normal(0, 1, 80)
    plus, minus = pu_risk(zp, np.logaddexp(0, zu).mean(), 0.4)
    assert np.isclose(plus, 0.4 * np.mean([np.log(1 + np.exp(-z)) for z in zp])) and np.isclose(minus, np.mean([np.log(1 + np.exp(z)) for z in zu]) - 0.4 * np.mean([np.log(1 + np.exp(z)) for z in zp]))
    # positives have bin 0 mostly, negatives bin 1; 70 % of the unlabelled are positives
    pos, unl = (np.arange(400) % 20 == 0).astype(int)[:, None], np.concatenate([np.arange(700) % 20 == 0, np.arange(300) % 20 > 0]).astype(int)[:, None]
    share = lambda x: np.array([1.0, (x[:, 0] == 0).mean()])
    assert abs(bound_prior(share(pos), share(unl), 400, 1000) - 0.7) < 0.05
    bins = lambda x: spark.createDataFrame([(bytearray(r.astype(np.uint8).tobytes()),) for r in x], "b binary").repartition(3)
    w = _fit_risk(bins(unl), pos, 2, 0.7, 1e-5)
    p1, u1 = pos.mean(), unl.mean()

    def risk(w):
        z = w[:2] + w[2]
        loss = lambda share, s: (1 - share) * np.logaddexp(0, s * z[0]) + share * np.logaddexp(0, s * z[1])
        return 0.7 * loss(p1, -1) + max(0.0, loss(u1, 1) - 0.7 * loss(p1, 1))

    for prior in (0.6, None):  # value, gradient and Hessian over several columns
        p3, u3 = rng.integers(0, 3, (40, 2)), rng.integers(0, 3, (70, 2))
        f = _objective(bins(u3), p3, 3, 0.1, prior)
        x = rng.normal(0, 1, 7)
        z = lambda rows, x: x[rows[:, 0]] + x[3 + rows[:, 1]] + x[6]
        plain = lambda x: np.logaddexp(0, z(u3, x)).mean() + (np.logaddexp(0, -z(p3, x)).mean() if prior is None else prior * (np.logaddexp(0, -z(p3, x)) - np.logaddexp(0, z(p3, x))).mean()) + 0.05 * x @ _roughness(2, 3) @ x  # noqa: B023, E731
        value, g, h = f(x)
        eye = np.eye(7) * 1e-4
        assert np.isclose(value, plain(x)) and np.allclose(g, [(plain(x + e) - plain(x - e)) / 2e-4 for e in eye], atol=1e-6)
        assert np.allclose(h, [[(plain(x + a + b) - plain(x + a - b) - plain(x - a + b) + plain(x - a - b)) / 4e-8 for a in eye] for b in eye], atol=1e-3)
    assert risk(w) <= min(risk(np.array([a, b, 0.0])) for a in np.linspace(-6, 6, 61) for b in np.linspace(-6, 6, 61)) + 0.02


def test_quality(spark):
    rnd = random.Random(3)
    good = [(i, ". ".join(text(rnd, 12).capitalize() for _ in range(6)) + ".", "en") for i in range(300)]
    junk = [(300 + i, (rnd.choice(WORDS).upper() + "!! ") * 40, "en") for i in range(60)]
    docs = docs_of(spark, good + junk + ODD)
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good if i % 2] + [(300, 0), (5, None), (None, 1)], "doc_id bigint, quality int")
    model = fit_quality(docs.where("doc_id < 9000"), labels, keep=fold("doc_id", 3) != 1)
    got = {r["doc_id"]: r["score"] for r in score_quality(docs, model).collect()}
    assert 0.6 < model.prior <= 0.98 and all(0 <= s <= 1 for s in got.values()) and len(got) == 360 + len(ODD)
    assert np.mean([got[i] >= 0.5 for i, _, _ in good]) > 0.95 and np.mean([got[i] < 0.5 for i, _, _ in junk]) > 0.9
    assert max(r["score"] for r in score_quality(docs, fit_quality(docs, empty(labels))).collect()) < 1e-9
    assert score_quality(empty(docs), model).count() == 0


# 2 nearest neighbours
def test_neighbours(spark):
    rnd = np.random.default_rng(4)
    centers = rnd.standard_normal((12, 16))
    x = centers[rnd.integers(0, 12, 900)] + 0.4 * rnd.standard_normal((900, 16))
    x[100:400] = x[100]  # a third are copies
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] * 16), (1080, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    y = np.array([r[1] for r in rows[:900]])
    hit = total = 0
    for kw in ({}, {"block_rows": 200, "query_rows": 10}):
        got: dict[int, list] = collections.defaultdict(list)
        for r in search(df, F.col("_id") % 20 == 0, k=10, **kw).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
        assert set(got) == set(range(0, 900, 20))
        for q, found in got.items():
            s = y @ y[q]
            s[q] = -np.inf
            best = np.lexsort((np.arange(900), -s))[:10]
            assert [r for _, _, r in found] == list(range(1, 11)) and all(abs(s[v] - sc) < 1e-9 for v, sc, _ in found)
            assert found == sorted(found, key=lambda z: (-z[1], z[0]))
            hit += len({v for v, _, _ in found} & set(best.tolist()))
            total += 10
    assert hit / total >= 0.9
    few = search(df.where("vec_id < 5"), F.col("_id") % 20 == 0, k=10).collect()
    assert len(few) == 4
    assert search(empty(df), F.col("_id") % 20 == 0).count() == 0


def test_neighbours_are_pruned():
    """Of uniform vectors, the hardest ones, a query verifies a part only, with the recall asked for."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index, ids, hits = BlockIndex(x, 1.0, 96, 7), np.arange(len(x)), 0
    for q in range(0, 400, 20):
        rows, dots = index.search(x[q], 20, np.array([q]), ids, width=3.6, threshold=86, start=0.7, factor=1.05)
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(rows.tolist()) & set(np.argsort(-s)[:20].tolist()))
        assert np.allclose(dots, s[rows]) and (np.diff(dots) <= 0).all()
    assert hits / 400 >= 0.9 and index.verified / (20 * len(x)) < 0.35


# 5 decontamination
def test_leaks_of_repeated_ids(spark):
    """An id's rows are searched each, whatever their order, and an item's id may have several texts; ids may be null."""
    rnd = random.Random(51)
    one, two = text(rnd, 20), text(rnd, 25)
    bench = spark.createDataFrame([(1, one, 0), (1, two, 0), (None, "some very short item", 0)], "item_id bigint, text string, _item int")
    rows = [(7, f"{text(rnd, 30)} {one}", "en"), (7, text(rnd, 50), "en"), (8, two, "en"), (None, f"x {one}", "en"), (None, text(rnd, 40), "en"), (9, "some very short item", "en")]
    for kw in ({}, {"broadcast_rows": 1}):
        for order in (rows, rows[::-1], rows * 2):
            assert sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in find_leaks(docs_of(spark, order), bench, **kw).collect()) == [(0, 1), (7, 1), (8, 1), (9, 0)]


def test_leaks(spark):
    rnd = random.Random(5)
    items = [(i, text(rnd, rnd.randint(15, 50))) for i in range(20)] + [(50, "three word item"), (51, None), (52, ""), (53, "...")]
    hit, rows = {}, []
    for i in range(120):
        base = text(rnd, 200).split()
        if i % 3 == 0:
            k, words = items[i % 20][0], items[i % 20][1].split()
            if i % 2:
                for p in range(3, len(words), 7):
                    words[p] = "changed"
            hit[i] = k
            base[50:50] = words if i % 4 else [w.upper() for w in words]
        rows.append((i, " ".join(base), "en"))
    rows += [(500, "a three word item here", "en")] + ODD
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for kw in ({}, {"broadcast_rows": 1}):
        got = {(r["doc_id"], r["item_id"]): r for r in find_leaks(docs_of(spark, rows), bench, **kw).collect()}
        assert set(got) == {*hit.items(), (500, 50)}
        assert all(r["similarity"] >= 0.8 and r["doc_start"] == 50 + r["item_start"] for (d, _), r in got.items() if d < 120)
    assert find_leaks(docs_of(spark, rows), empty(bench)).count() == 0 and find_leaks(empty(docs_of(spark, rows)), bench).count() == 0


def test_leaks_against_brute_force(spark):
    rnd = random.Random(50)
    items = [(i, [f"w{i}x{j}" for j in range(n)]) for i, n in enumerate([*range(1, 31)] * 3 + [50] * 20)]
    rows, want = [], set()
    for d in range(500):
        i, words = items[d % len(items)]
        n = len(words) if len(words) < 50 else rnd.randint(8, 20)
        at = rnd.randint(0, len(words) - n)
        part = words[at : at + n]
        for p in rnd.sample(range(n), min(n, max(0, n // 5 + rnd.choice([0, 0, 0, 1])))):
            part[p] = f"other{p}"
        rows.append((d, " ".join([*(["before"] * rnd.randint(0, 3)), *part, *(["after"] * rnd.randint(0, 3))]), "en"))
        same = [False] * at + [w == v for w, v in zip(words[at:], part, strict=False)] + [False] * (len(words) - at - n)
        ends = [j for j, x in enumerate(same) if x]
        runs = any(b - a >= 12 and 5 * sum(same[a : b + 1]) >= 4 * (b - a + 1) for a in ends for b in ends)
        if runs or (n == len(words) and 5 * sum(same) >= 4 * n):
            want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    for kw in ({}, {"broadcast_rows": 1}):
        got = find_leaks(docs_of(spark, rows), bench, **kw).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and all(5 * r["n_same"] >= 4 * r["n_words"] for r in got)


def test_seeds_hit_every_placement():
    from lumora.llm.decontaminate import MASKS, seed_masks, short_seeds

    def hit(n, changed, seeds):
        return any(all(m[p - at] == "0" for p in changed if at <= p < at + len(m)) for m, at in seeds)

    for masks, cases in ((MASKS, [(13, 2), (15, 3), (20, 4)]), (seed_masks(8, 0.75), [(8, 2), (12, 3)])):
        for n, k in cases:
            seeds = [(m, at) for m in masks for at in range(n - len(m) + 1)]
            assert all(hit(n, c, seeds) for c in itertools.combinations(range(n), k))
    for n in range(1, 13):
        assert all(hit(n, c, short_seeds(n, 0.8)) for c in itertools.combinations(range(n), n // 5))


# 6 byte-pair encoding
def test_automaton():
    rnd = random.Random(6)
    words = {"".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 7))).encode(): [rnd.randrange(99) for _ in range(rnd.randint(0, 3))] for _ in range(500)}
    lex = Lexicon(compile_lexicon(words))
    assert all(lex.get(w) == i for w, i in words.items()) and lex.get(b"zz") is None and lex.get(b"") is None
    suffixes = {w[k:] for w in words for k in range(len(w) + 1)}
    assert lex.n_states <= len({frozenset(s[len(p):] for s in words if s.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)}}) <= 4 * len(suffixes)
    assert Lexicon(compile_lexicon({})).get(b"a") is None


def test_bpe_against_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(tokenizer_path())
    rnd = random.Random(7)
    bits = ["a", "Z", "é", "'", "ñ", " ", "1", "٣", "½", "\u0301", "\x1c", "\t", "Σ", "İ", "ß", "ﬁ", "中", "😀", "!", "'s", "<|endoftext|>", "\u0085", "\xa0", "the ", "tion"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(400)] + [t for _, t, _ in ODD]
    docs = docs_of(spark, [(i, t, "en") for i, t in enumerate(texts)])
    tok = Tokenizer.load(tokenizer_path())
    for lexicon in (build_lexicon(docs, tok, least_count=2), None):
        got = {r["doc_id"]: r for r in encode(docs, tok, lexicon, outputs=("ids", "n_tokens", "ids_text", "decoded")).collect()}
        for i, t in enumerate(texts):
            e = lib.encode(t or "", add_special_tokens=False).ids
            assert got[i]["ids"] == e and got[i]["n_tokens"] == len(e) and got[i]["ids_text"] == " ".join(map(str, e)) and got[i]["decoded"] == lib.decode(e, skip_special_tokens=False)
    again = decode(spark.createDataFrame([([320, 321],), (None,), ([999999],)], "ids array<int>"), tok)
    assert [r["decoded"] for r in again.collect()] == [lib.decode([320, 321]), "", ""]
    assert encode(empty(docs), tok, None).count() == 0


# 7 language model
def test_lattice_sums_all_segmentations():
    pieces = ["", "▁", "a", "b", "ab", "▁a", "ba", "aba"]
    logp = np.log(np.full(len(pieces) + 256, 1.0 / (len(pieces) + 256)))
    lattice = Lattice(pieces + [""] * 256, logp, np.arange(len(pieces), len(pieces) + 256))

    def total(s):
        if not s:
            return 1.0
        return sum(np.exp(logp[0]) * total(s[len(p):]) for p in pieces[1:] if s.startswith(p)) + (np.exp(logp[0]) ** len(s[0].encode()) * total(s[1:]) if s[0] not in "▁ab" else 0)

    words = [b"a", b"abab", b"bbaab", "aéb".encode(), b"ab" * 50]
    got = lattice.log_prob(words)
    assert np.allclose(got[:4], [np.log(total("▁" + w.decode())) for w in words[:4]])
    e = lattice.expected(words, np.array([1, 2, 3, 1, 1]))
    assert np.isfinite(got[4]) and e[0] == 0 and e.sum() > 0
    short, long = lattice.log_prob([b"ab" * 20])[0], lattice._long(np.frombuffer(("▁" + "ab" * 20).encode("utf-32-le"), np.uint32))
    assert abs(short - long) < 1e-9


def test_token_probabilities_sum_to_one():
    """Over all words of a closed alphabet, with the mark of a word's start inside a word too."""
    pieces = ["", "▁", "a", "b", "ab", "▁a", "ba", "▁b"]
    p = np.array([0.2, 0.1, 0.06, 0.05, 0.04, 0.3, 0.05, 0.2])
    vocab = Vocabulary(pieces + [""] * 256, np.log(np.append(p, np.full(256, 1e-300))), np.arange(8, 264), 0)
    lattice = Lattice(vocab.pieces, vocab.logp, vocab.bytes_at)
    words = ["".join(w) for n in range(1, 13) for w in itertools.product("ab", repeat=n)]
    total = (np.exp(lattice.log_prob([w.encode() for w in words])).sum() + p[0]) / token_mass(vocab)
    assert 0.999 < total <= 1 + 1e-12
    inner = lattice.log_prob(["a▁b".encode()])[0]
    assert inner < -600  # bytes alone: no segmentation crosses into another word
    # the mixture with seen words
    c = np.array([5, 1, 3, 0])
    sub = np.log10([0.1, 0.2, 0.05, 0.3])
    got = 10 ** mixed(c, 9, 3, sub, 0.5)
    assert np.allclose(got, [(x - 0.5) / 9 * (x > 0) + 0.5 * 3 / 9 * y for x, y in zip(c, 10**sub, strict=True)])
    assert (mixed(c, 0, 0, sub, 0.5) == sub).all()


def test_lm_score_by_hand(spark):
    """``score`` from counts, the pieces' values and the fitted discount."""
    rnd = random.Random(81)
    rows = [(i, text(rnd, rnd.randint(0, 30), WORDS[:60]) + f" only{i}", "en") for i in range(80)]
    docs = docs_of(spark, rows)
    vocab = Vocabulary.load(tokenizer_path("piece_bpe_32k.model"))
    counts = collections.Counter(w for i, t, _ in rows if __import__("zlib").crc32(str(i).encode()) % 10 for w in [*tokens(t), b""])
    n, v = sum(counts.values()), len(counts)
    got = {}
    for frequent in (0, 20, 10000):
        for r in score_texts(docs, vocab, train=fold("doc_id", 10) != 0, frequent=frequent, discount=0.6).collect():
            got.setdefault(r["doc_id"], []).append(r)
    # tokens' lattice values, from documents of one word
    words = sorted({w for _, t, _ in rows for w in tokens(t)})
    single = {r["doc_id"]: r["lattice_score"] for r in score_texts(docs.unionByName(docs_of(spark, [(1000 + i, w.decode(), "x") for i, w in enumerate(words)])), vocab, train=(fold("doc_id", 10) != 0) & (F.col("doc_id") < 1000)).where("doc_id >= 1000").collect()}
    end = [r for r in score_texts(docs.unionByName(docs_of(spark, [(5000, "", "x")])), vocab, train=(fold("doc_id", 10) != 0) & (F.col("doc_id") < 1000)).where("doc_id = 5000").collect()][0]["lattice_score"]
    sub = {w: single[1000 + i] - end for i, w in enumerate(words)} | {b"": end}
    for i, t, _ in rows:
        want = sum(np.log10(max(counts[w] - 0.6, 0) / n + 0.6 * v / n * 10 ** sub[w]) for w in [*tokens(t), b""])
        assert all(abs(r["score"] - want) < 1e-6 * abs(want) for r in got[i]) and len(got[i]) == 3
    # without training texts the pieces alone score, however unlikely the word is
    long = docs_of(spark, [(1, "q" * 400, "en")])
    for frequent in (0, 10):
        r = score_texts(long, vocab, train=F.lit(False), frequent=frequent).first()
        assert r["score"] == r["lattice_score"] < -300 and r["base_score"] == 0


def test_lm_learns_from_all(spark):
    """Pieces by expectation-maximisation over all training words in every round, the discount with all training texts held back once."""
    rnd = random.Random(83)
    rows = [(i, text(rnd, rnd.randint(0, 30), WORDS[:60]) + f" only{i}", "en") for i in range(80)]
    docs = docs_of(spark, rows)
    vocab = Vocabulary.load(tokenizer_path("piece_bpe_32k.model"))
    fold_of = {r["doc_id"]: r["f"] for r in docs.select("doc_id", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(5)).alias("f")).collect()}
    learned = [(fold_of[i], w) for i, t, _ in rows if __import__("zlib").crc32(str(i).encode()) % 10 for w in [*tokens(t), b""]]
    counts, first, trained = collections.Counter(w for _, w in learned), np.exp(vocab.logp), vocab
    words = [w for w in counts if w]
    for _ in range(4):
        lattice = Lattice(trained.pieces, trained.logp, trained.bytes_at)
        total = lattice.expected(words, np.array([counts[w] for w in words]))
        total[vocab.end] += counts[b""]
        trained = Vocabulary(vocab.pieces, np.log((total + 1000.0 * first) / (total.sum() + 1000.0)), vocab.bytes_at, vocab.end)
    every = sorted({w for _, t, _ in rows for w in tokens(t)})
    sub = dict(zip(every, Lattice(trained.pieces, trained.logp, trained.bytes_at).log_prob(every), strict=True)) | {b"": trained.logp[vocab.end]}
    sub = {w: (x - np.log(token_mass(trained))) / np.log(10) for w, x in sub.items()}

    def value(c, n, v, w, x):
        return np.log10(max(c - x, 0) / n + x * v / n * 10 ** sub[w])

    def held_back(x):
        out = 0.0
        for f in range(5):
            rest = collections.Counter(w for k, w in learned if k != f)
            out += sum(value(rest[w], sum(rest.values()), len(rest), w, x) for k, w in learned if k == f)
        return out

    best = max(DISCOUNTS, key=held_back)
    want = {i: (sum(sub[w] for w in [*tokens(t), b""]), sum(value(counts[w], len(learned), len(counts), w, best) for w in [*tokens(t), b""])) for i, t, _ in rows}
    for frequent in (0, 20, 10000):
        for r in score_texts(docs, vocab, train=fold("doc_id", 10) != 0, frequent=frequent).collect():
            assert np.allclose((r["lattice_score"], r["score"]), want[r["doc_id"]], rtol=1e-9)


def test_lm_scores(spark):
    rnd = random.Random(8)
    rows = [(i, text(rnd, 40), "en") for i in range(100)] + ODD[:5] + ODD[6:] + [(3, "The SAME id again", "en")]
    docs = docs_of(spark, rows)
    vocab = Vocabulary.load(tokenizer_path("piece_bpe_32k.model"))
    for frequent in (50, 100000):
        got = score_texts(docs, vocab, train=fold("doc_id", 10) != 0, frequent=frequent).collect()
        assert len(got) == len(rows)
        counts = collections.Counter(w for i, t, _ in rows if __import__("zlib").crc32(str(i).encode()) % 10 for w in [*tokens(t), b""])
        n, v = sum(counts.values()), len(counts)
        by = collections.defaultdict(list)
        for r in got:
            by[r["doc_id"]].append(r)
        for i, t, _ in rows:
            w = [*tokens(t), b""]
            want = sum(np.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
            r = min(by[i], key=lambda r: abs(r["base_score"] - want))
            assert abs(r["base_score"] - want) < 1e-6 * abs(want) and r["n_tokens"] == len(w) and r["n_known"] == sum(counts[x] > 0 for x in w) and r["train_tokens"] == n and r["score"] < 0 and r["lattice_score"] < 0
    assert score_texts(empty(docs), vocab, train=fold("doc_id", 10) != 0).count() == 0


# 8 Jaccard join
def brute(rows, k, num, den):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, parent = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(up))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and den * len(a & b) >= num * len(a | b):
                p, q = find(ids[x]), find(ids[y])
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("small,narrow,block,k,num,den", [(16, 50_000, 4096, 4, 85, 100), (2, 61, 7, 4, 85, 100), (3, 1000, 4096, 5, 80, 100)])
def test_jaccard_against_brute_force(spark, monkeypatch, small, narrow, block, k, num, den):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "NARROW_ROWS", narrow)
    monkeypatch.setattr(jaccard, "_BLOCK_MEMBERS", block)
    rnd = random.Random(9)
    base = [text(rnd, 80).split() for _ in range(6)]
    rows = []
    for i in range(150):
        w = list(base[i % 6])
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS) + str(rnd.randrange(50))
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else "\n".join(w)))
    rows += [(200, "one two"), (201, "ONE two"), (202, "one two three"), (203, "é É"), (204, text(rnd, 5000)), (205, None), (206, ""), (207, " \t ")]
    df = spark.createDataFrame([(i, t, i, "x") for i, t in [*rows, (None, "no id")]], "doc_id bigint, text string, id bigint, h string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(df, k=k, num=num, den=den).collect()}
    assert got.pop(None)[1] is None
    assert got == brute(rows, k, num, den)


def test_jaccard_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "p q r s t u v"), (2, "P q r s t u v"), (0, "a b c d e f")], "doc_id bigint, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.link_documents(df).collect()} == {(0, 0), (1, 0), (2, 0)}
    assert jaccard.link_documents(empty(df)).count() == 0


def test_shingles_of_parts():
    for t in ("a b c d e", " lead  and\ttail \n", "", "x", "é ü ö ä ß", "w " * 70000):
        d = np.frombuffer(t.encode(), np.uint8)
        both = np.frombuffer((t + "zz yy").encode(), np.uint8)
        one = shingle_sets(d, np.array([0, len(d)]), 4)[0]
        two = shingle_sets(both, np.array([0, len(d), len(both)]), 4)[0]
        assert (one == two).all()
    long = np.frombuffer(b"q" * 3_000_000 + b" r", np.uint8)
    assert len(shingle_sets(long, np.array([0, len(long)]), 4)[0]) == 1


def test_words_that_a_polynomial_takes_for_one(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2**64 for any odd base."""
    bits = "a"
    while len(bits) < 4096:
        bits += bits.translate(str.maketrans("ab", "ba"))
    words = [(bits[:n], bits[:n].translate(str.maketrans("ab", "ba"))) for n in (1024, 2048, 4096)]
    a, b = (" ".join(["x", *[w[i] for w in words]]) for i in (0, 1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(spark.createDataFrame([(1, a), (2, b), (3, f"{a} {b}")], "doc_id bigint, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (5, 3)}


def test_jaccard_ids_with_several_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_BLOOM", (1 << 16, 1))  # always the join
    rnd = random.Random(91)
    a, b = (text(rnd, 60).split() for _ in range(2))
    rows = [(5, " ".join(a)), (5, " ".join(b)), (9, " ".join([*a[:30], "other", *a[31:]])), (2, " ".join([*b[:20], "else", *b[21:]])), (7, text(rnd, 60)), (5, None), (8, "")]
    for order in (rows, rows[::-1]):
        got = {(r["doc_id"], r["component_id"]) for r in jaccard.link_documents(spark.createDataFrame(order, "doc_id bigint, text string"), k=2, num=70).collect()}
        assert got == {(5, 2), (9, 2), (2, 2), (7, 7), (8, 8)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101)]
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}


# 9 WARC
def test_warc(spark, tmp_path):
    html = '<html lang="en"><head><title> A &amp; B </title><style>p{}</style></head><body><script>x("</p>")</script><p>One<br>two &lt;3</p><!-- no --><a href="/a">link</a></body></html>'
    pages = spark.createDataFrame([(1, "http://x.org/", html, 5), (2, None, None, 6), (3, "http://y.org/", "", 7), (3, "http://y.org/", "", 7)], "page_id bigint, url string, html string, block int")
    source = warc.responses(pages)
    got = warc.derive(source).collect()
    assert len(got) == 8
    by = {(r["page_id"], r["record_type"]): r for r in got}
    assert by[1, "conversion"]["block"] == "One\ntwo <3\nlink"
    assert by[1, "metadata"]["block"].startswith("title: A & B\r\nlanguage: en\r\n") and "outlink: /a\r\n" in by[1, "metadata"]["block"]
    ids = {r["page_id"]: r for r in source.collect()}
    for r in got:
        assert r["refers_to"] == ids[r["page_id"]]["record_id"] and r["source_digest"] == ids[r["page_id"]]["payload_digest"] and r["source_headers"].startswith("HTTP/1.1 200 OK")
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest() and r["content_length"] == len(r["block"].encode())
    warc.write_warc(warc.response_texts(source.where("page_id = 1")).coalesce(1), str(tmp_path / "w"))
    back = warc.read_responses(spark, str(tmp_path / "w")).collect()
    assert [(r["record_id"], r["target_uri"], r["payload"], r["http_headers"]) for r in back] == [(ids[1]["record_id"], "http://x.org/", html, ids[1]["http_headers"])]
    warc.write_warc(warc.derived_texts(warc.derive(source)), str(tmp_path / "d"), compression="gzip")
    assert warc.derive(empty(source)).count() == 0


def test_warc_reader_cuts_by_length(spark, tmp_path):
    """Payloads with empty lines, record headers, no UTF-8 and no digest, over splits of a file and in a compressed one."""
    def record(kind, uri, block, more=b""):
        return b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:" + uri + b">\r\nWARC-Target-URI: " + uri + b"\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n" + more + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nX: y"
    payloads = {b"http://a/%d" % i: p for i, p in enumerate([b"plain", b"", b"ends\r\n\r\n", b"a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\nb", b"\r\n\r\nx", b"caf\xe9", b"half\r\n", b"z" * 5000] * 6)}
    data = record(b"warcinfo", b"i", b"software: x\r\n") + b"".join(record(b"response", u, http + b"\r\n\r\n" + p, b"WARC-Payload-Digest: sha1:ABC\r\n" if u.endswith(b"0") else b"") for u, p in payloads.items())
    import gzip

    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(data)
    (tmp_path / "w" / "b.warc.gz").write_bytes(gzip.compress(data + b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\ncut off"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = warc.read_responses(spark, str(tmp_path / "w")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["target_uri"], r["payload"]) for r in got) == sorted([(u.decode(), p.decode("utf-8", "replace")) for u, p in payloads.items()] * 2)
    for r in got:
        p = payloads[r["target_uri"].encode()]
        assert r["payload_digest"] == ("sha1:ABC" if r["target_uri"].endswith("0") else "sha256:" + hashlib.sha256(p).hexdigest()) and r["http_headers"] == http.decode() and "WARC-Type: response" in r["warc_headers"]
    assert {r["source_digest"] for r in warc.derive(warc.read_responses(spark, str(tmp_path / "w")), keep=()).collect()} >= {"sha1:ABC"}


def test_warc_entities_and_links(spark):
    html = "<html lang='de'><a href='/s'>q</a><A HREF=/n>w</a><a class=x href=\"/d?a&#61;b\">v</a><p>a&#160;b&#x41;&#65; &#0; &#xD800; &amp;#65; &#zz;"
    got = {r["record_type"]: r["block"] for r in warc.derive(warc.responses(spark.createDataFrame([(1, "http://x/\r\nEvil: 1", html)], "page_id bigint, url string, html string"))).collect()}
    assert got["conversion"] == "qwv\na\u00a0bAA &#0; &#xD800; &#65; &#zz;"
    assert got["metadata"].split("\r\n")[-4:] == ["outlink: /s", "outlink: /n", "outlink: /d?a=b", ""] and "language: de" in got["metadata"]
    record = warc.response_texts(warc.responses(spark.createDataFrame([(1, "http://x/\r\nEvil: 1", html)], "page_id bigint, url string, html string"))).first()["value"]
    assert "WARC-Target-URI: http://x/%0D%0AEvil: 1\r\n" in record


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_warc_query_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM read_parquet('/root/testdata/sf0.001/pages.parquet')")
    rel = con.execute(oracle_sql()["op9_warc"])
    cols = [c[0] for c in rel.description]
    assert sorted(tuple(str(r[c]) for c in cols) for r in queries()["op9_warc"](spark, "/root/testdata/sf0.001").collect()) == sorted(tuple(map(str, r)) for r in rel.fetchall())


# 10 URLs
def test_markov_by_hand():
    """Witten-Bell interpolation, by its definition, on every context that is kept."""
    texts = ["abab", "abc", "ab", "b"]
    m = Markov(texts, 2, 2)
    padded = ["\x02\x02" + t + "\x03" for t in texts]

    def prob(ctx, ch):
        if ctx is None:
            return 1 / (len({c for t in padded for c in t[2:]}) + 1)
        after = [t[i] for t in padded for i in range(2, len(t)) if t[i - len(ctx) : i] == ctx]
        lower = prob(ctx[1:] if ctx else None, ch)
        if ctx and len(after) < 2:
            return lower
        return (after.count(ch) + len(set(after)) * lower) / (len(after) + len(set(after)))

    for ctx in ("\x02\x02", "\x02a", "ab", "ba", "bc", "zz"):
        for ch in "abc\x03q":
            assert abs(m.prob(ctx, ch) - prob(ctx, ch)) < 1e-12
    assert abs(sum(m.prob("ab", c) for c in "abc\x03q") - 1) < 1e-12


def test_urls(spark):
    rules = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("com", "/de/", "block")]
    rnd = random.Random(10)
    rows = [(i, f"https://{rnd.choice(['good', 'nice', 'fine'])}{i % 7}.org/read/{i}") for i in range(60)] + [(100 + i, f"http://spam{i % 5}.com/de/win-cash-{i}") for i in range(60)]
    odd = [(300, None), (301, ""), (302, "no scheme"), (303, "HTTP://WWW.Example.ORG/es/x?q=1#f"), (304, "http://notorg/x"), (305, "http://example.org"), (306, "a://b://c/d"), (307, "http://spam9.net/de/win-cash-77"), (308, "http://nice3.net/read/12"), (309, "http://x.com/de/" + "y" * 100000)]
    df = spark.createDataFrame([(i, u, "r", 1.0) for i, u in rows + odd], "page_id bigint, url string, rule string, score double")
    got = {r["page_id"]: r for r in judge_urls(df, rules, fit_urls(df, rules)).collect()}
    assert all(got[i]["verdict"] == "allow" for i in range(60)) and all(got[i]["verdict"] == "block" for i in range(100, 160))
    assert (got[300]["host"], got[300]["path"], got[300]["rule"], got[300]["verdict"]) == ("", "", None, "allow") and got[302]["host"] == ""
    assert (got[303]["host"], got[303]["path"], got[303]["rule"], got[303]["verdict"]) == ("www.example.org", "/es/x", "example.org/es/", "block")
    assert got[304]["rule"] is None and got[305]["rule"] is None and (got[306]["host"], got[306]["path"]) == ("b:", "//c/d")
    assert got[307]["verdict"] == "block" and got[308]["verdict"] == "allow" and got[309]["rule"] == "com/de/"
    assert {r["verdict"] for r in judge_urls(df, [], fit_urls(df, [])).collect()} == {"allow"}
    assert judge_urls(empty(df), rules, fit_urls(empty(df), rules)).count() == 0


def test_urls_learn_from_all(spark):
    """Scores and threshold by the definition, from all URLs that a rule judges: more of them than any sample took."""
    rnd = random.Random(11)
    rules = [Rule("org", "", "allow"), Rule("com", "", "block")]
    urls = [f"x://{''.join(rnd.choices('abcd', (5, 3, 2, 1), k=rnd.randint(1, 6)))}.org" for _ in range(150)] + [f"x://{''.join(rnd.choices('abcd', (1, 2, 3, 5), k=rnd.randint(1, 6)))}.com" for _ in range(5200)] + [f"x://{''.join(rnd.choices('abcde', k=4))}.net/é" for _ in range(40)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    model = fit_urls(pages, rules, order=2, frequent=50)
    parts = [u[4:] for u in urls]
    fold_of = {r["page_id"]: r["f"] for r in pages.select("page_id", F.pmod(F.xxhash64(F.substring("url", 5, 100), F.lit("")), F.lit(5)).alias("f")).collect()}

    def raw(t, a, b):
        s = "\x02\x02" + t + "\x03"
        return sum(np.log(a.prob(s[i - 2 : i], s[i]) / b.prob(s[i - 2 : i], s[i])) for i in range(2, len(s))) / (len(t) + 1)

    of = {c: [(fold_of[i], t) for i, t in enumerate(parts) if t.endswith(c)] for c in (".org", ".com")}
    scores = {c: [] for c in of}
    for f in range(5):
        a, b = (Markov([t for k, t in x if k != f], 2, 3) for x in of.values())
        for c, x in of.items():
            scores[c] += [raw(t, a, b) for k, t in x if k == f]
    a, b = (np.sort(x) for x in scores.values())
    points = np.unique(np.round(np.concatenate([a, b]), 7))
    good = lambda c: round((a >= c).mean() + (b < c).mean(), 9)
    best = max([0.0, *(points[1:] + points[:-1]) / 2], key=lambda c: (good(c), -abs(c), c))
    assert abs(model.threshold - best) < 1e-6
    whole = [Markov([t for _, t in x], 2, 3) for x in of.values()]
    for r in judge_urls(pages, rules, model, frequent=50).collect():
        assert abs(r["score"] - (raw(parts[r["page_id"]], *whole) - model.threshold)) < 1e-7


def test_drop_ids(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "doc_id bigint, t string")
    assert sorted(r["t"] for r in drop_ids(rows, spark.createDataFrame([(2,), (2,)], "doc_id bigint"), "doc_id").collect()) == ["a", "b"]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    rnd = random.Random(11)
    languages = {"aa": WORDS, "bb": [w[::-1] + "o" for w in WORDS]}
    bench = text(rnd, 30)
    rows = []
    for i in range(160):
        k = "aa" if i % 3 else "bb"
        t = text(rnd, 80, languages[k]) + (" vilescum grotwad vilescum" if i % 8 == 0 else "")
        rows.append((i, t, k, "s", len(t)))
    rows += [(200, rows[1][1], "aa", "s", 1), (201, rows[2][1] + " and", "aa", "s", 1), (202, text(rnd, 40) + " " + bench + " " + text(rnd, 40), "aa", "s", 1), (203, "12345", "aa", "s", 5), (204, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(160)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in P.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i in range(160) if i % 8}
    assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in got.values())
    assert [len(x) for x in P.STAGES] == [2] * 5


def test_long_items(spark):
    """An item of 20,000 words that stands in a document, with changed words, in time that doesn't grow with its square."""
    rnd = random.Random(77)
    words = [f"w{rnd.randrange(5000)}" for _ in range(20_000)]
    changed = [w if rnd.random() > 0.1 else "other" for w in words]
    docs = spark.createDataFrame([(1, "before it " + " ".join(changed)), (2, " ".join(words[500:900])), (3, "clean " * 50)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in find_leaks(docs, bench).collect()}
    same = [a == b for a, b in zip(words, changed, strict=True)]
    first, last = same.index(True), len(same) - 1 - same[::-1].index(True)
    assert set(got) == {1, 2} and got[2]["n_words"] == got[2]["n_same"] == 400
    assert (got[1]["doc_start"], got[1]["n_words"], got[1]["n_same"]) == (2 + first, last - first + 1, sum(same))


def test_urls_against_brute_force(spark):
    """Rules and verdicts of random URLs, judged one by one; names that clash are refused."""
    rnd = random.Random(31)
    rules = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]
    host = lambda: rnd.choice(["a.example.org", "EXAMPLE.org", "x.com", "y.net", "badexample.org", "z.co", "org", ""])
    urls = [f"{rnd.choice(['http', 'https', 'x'])}://{host()}{rnd.choice(['/es/', '/en/1', '/en/', '/fr/', '/de/', '', '?q=/es/', '#/de/'])}{rnd.choice(['', 'p', 'win-casino-77', 'notes'])}" for _ in range(300)] + [None, "", "no scheme", "a://b://c/de/"]
    pages = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(urls)], "page_id bigint, url string, _host string, h double")
    model = fit_urls(pages, rules)
    score = model.scorer()
    for r in judge_urls(pages, rules, model).collect():
        u = urls[r["page_id"]] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        h = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(h) :], maxsplit=1)[0]
        h = "".join(c.lower() if c.isascii() else c for c in h)
        fits = [x for x in rules if (h == x.host or h.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        assert (r["host"], r["path"], r["rule"]) == (h, path, best and best.name)
        assert r["verdict"] == (best.verdict if best else "allow" if score(h + path) >= 0 else "block")
    for name in ("host", "score"):
        with pytest.raises(ValueError):
            judge_urls(pages.withColumn(name, F.lit(1)), rules, model, keep=("page_id", name))
    assert judge_urls(pages.where("false"), rules, model).collect() == []


def test_package_imports():
    """The entry point passes over a package that can't be imported: here it has to be."""
    import __spark_entry__ as entry

    assert {"pipeline", "op1_toxicity", "op13_extraction"} <= set(entry.queries())


def test_stages_take_odd_tables(spark, tmp_path):
    """Columns named like those that stages add for a time, repeated and null rows, empty and very long texts, and empty tables."""
    import corpus_pipeline as P

    rnd = random.Random(12)
    rows = [(i, text(rnd, 60) + (" vilescum grotwad" if i % 6 == 0 else ""), "aa", "s", 1, 0.5, "x", "y", 1.0) for i in range(90)]
    rows += [rows[1], (None, text(rnd, 60), "aa", None, None, None, None, None, None), (300, None, "aa", "s", 1, 1.0, "x", "y", 1.0), (301, "", None, "s", 1, 1.0, "x", "y", 1.0), (302, text(rnd, 30000), "aa", "s", 1, 1.0, "x", "y", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _toxicity double, _lang_pred string, _lang_score string, _lang_fit double")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(90)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, text(rnd, 20)), (None, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in P.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and stage(spark, docs.where("false"), str(tmp_path)).collect() == []
        ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
        assert 2 in ids and 302 in ids and (None in ids) and ids.count(1) in (0, 2)
    assert len(P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()) == len(rows)


def test_warc_refuses_clashing_names(spark):
    source = warc.responses(spark.createDataFrame([(1, "http://a/", "<p>x</p>", 1)], "page_id bigint, url string, html string, block int"), keep=("page_id", "block"))
    with pytest.raises(ValueError):
        warc.derive(source, keep=("page_id", "block"))
