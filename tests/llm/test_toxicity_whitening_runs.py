"""Toxicity, whitening and periodic runs against brute force, on small fixtures that hold the awkward cases."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tideline.llm import grammar, periodic_runs, toxicity, whitening

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, clauses string, row long, v string, id long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5, "x", 1, "v", 7) for i, t in rows], DOCUMENTS)


# 11 -----------------------------------------------------------------------------------------------


def written(symbols):
    follows, writes = grammar.composed()
    state, out = 0, []
    for x in symbols:
        k = grammar.CLASSES.index(x)
        out.append(writes[state][k])
        state = follows[state][k]
    return [x for x in out if x]


@pytest.mark.parametrize(
    ("symbols", "want"),
    [
        ("ooI#", ["insult"]), ("YooI#", ["directed"]), ("IooY#", ["insult", "directed"]), ("Y#I", ["insult"]), ("SoI#", ["self"]), ("NoI#", ["negated"]),
        ("NoooI#", ["insult"]), ("NcI", ["insult"]), ("RoI#I", ["reported", "insult"]), ("QIQI", ["reported", "insult"]), ("QIPI", ["reported", "insult"]),
        ("SWTY#", ["threat"]), ("SWTooooY#", []), ("TY", []), ("TZ", ["threat"]), ("YWX#", ["threat"]), ("WYX", ["threat"]), ("YX#", []), ("SNWTY", ["negated"]), ("SNooWTY", ["threat"]),
        ("SWNTY", ["negated"]), ("QSWTYQ", ["reported"]), ("oo#Po", []), ("YWV#", ["threat"]), ("YWVo#", []), ("YV#", []), ("YNWooV#", ["threat"]), ("YWNVP", ["negated"]), ("oVoWY#", []),
    ],
)
def test_composed_transducers(symbols, want):
    assert written(symbols) == want


def test_composition_is_the_cascade_step_by_step():
    r = random.Random(5)
    follows, writes = grammar.composed()
    for _ in range(200):
        states, at = [s for _, s in grammar.CASCADE], 0
        for x in r.choices(grammar.CLASSES, k=30):
            k, y = grammar.CLASSES.index(x), x
            for i, (step, _) in enumerate(grammar.CASCADE):
                states[i], y = step(states[i], y)
            assert writes[at][k] == grammar.label(y)
            at = follows[at][k]


def test_clauses_of_a_text():
    model = toxicity.Grammar(toxicity.listed())
    text = 'Good day. You are an IDIOT!!! He is not stupid. "What a m0ron", she said.\nI will kill you; fine.'
    got = [(text[s:e], k) for s, e, k, _ in model.clauses(text)]
    assert got == [("You are an IDIOT", "directed"), ("He is not stupid", "negated"), ('"What a m0ron", she said', "reported"), ("I will kill you", "threat")]
    assert model.clauses("") == model.clauses("the weather is fine, said the man") == []
    scores = [model.score(t, model.clauses(t)) for t in ("A fine day.", "He is not an idiot.", "An idiot.", "You are an idiot.", "You are an idiot. I will kill you.")]
    assert scores == sorted(scores) and scores[1] < toxicity.BAR < scores[2]


def test_only_texts_without_labels_are_passed_over():
    model = toxicity.Grammar(toxicity.listed() | {"zwick-": 1.0, "b0b": 1.0})
    r = random.Random(3)
    parts = ["idiot", "1d10t", "IDI0TS", "stuuupid", "m'oron", "zwickel", "Zw1ckig", "zwi", "b0b", "bob", "die", "you", "will", "kill", "yourself", "not", "said", "die Sonne", "you'll", "fine", "day", "scümm", "tr@sh", "!m0ron", "1di0t!", "$cum", "a!diot", "m0r!on", "_scum_", "diiie", "d1e"]
    seen = 0
    for _ in range(3000):
        text = "".join(r.choice(parts) + r.choice([" ", ". ", ", ", "\n", "! ", "", '"', "  \n", "-"]) for _ in range(r.randrange(1, 7)))
        passed = not model.may_match(text)
        model.may_match = lambda t: True
        found = model.clauses(text)
        del model.may_match
        assert not (passed and found), (text, found)
        seen += bool(found)
    assert seen > 500 and not model.may_match("a fine day, die Sonne scheint, die") and not model.may_match("skilled scummy retort")
    assert [c[2] for c in model.clauses("I hope you die.")] == [c[2] for c in model.clauses("I hope you die")] == ["threat"]


def test_significance_is_the_likelihood_ratio(spark):
    rows = [(0, 3, 10, 20), (5, 0, 10, 20), (10, 20, 10, 20), (4, 4, 9, 11), (9, 0, 9, 11)]
    from pyspark.sql import functions as F

    for a, b, n, m in rows:
        table = np.array([[a, n - a], [b, m - b]], float)
        expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
        want = 2 * sum(x * np.log(x / e) for x, e in zip(table.ravel(), expected.ravel(), strict=True) if x)
        got = spark.createDataFrame([(a, b)], "a long, b long").select(toxicity.significance(F.col("a"), F.col("b"), n, m)).first()[0]
        assert got == pytest.approx(want, abs=1e-9)


def test_stems_that_begin_alike():
    got = toxicity.chosen([("abcd-", 9, 0), ("abcdef", 8, 0), ("abc-", 9, 1), ("abx", 5, 0), ("ab-", 9, 9), ("xyz", 5, 0), ("xyzw", 5, 0)])
    assert list(got) == ["abcd-", "abx", "xyz", "xyzw"]


@pytest.fixture(scope="module")
def insulting():
    """Texts of invented words; the toxic ones hold words of an invented stem, which no list has."""
    r = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(r.choices("abdeilmnorstu", k=r.randrange(3, 8))) for _ in range(r.randrange(20, 60))]
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(3):
                words[r.randrange(len(words))] = "zwick" + r.choice(["el", "er", "ig", "ung", "t"])
        rows.append((i, " ".join(words) + "."))
        labels.append((i, 1, int(toxic)))
    rows += [(None, "zwickel zwicker zwickig."), (700, None), (701, ""), (702, " \n "), (703, "zwickel, zwickig! " * 20_000), (703, "quiet words"), (704, "Zwickel's zwicker zwickung")]
    labels += [(None, 1, 1), (9999, 0, 1), (703, 1, None), (701, 1, 0), (701, 1, 1)]
    return rows, labels


def test_toxicity_learns_stems_and_scores_all_rows(spark, insulting):
    rows, labels = insulting
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.toxicity_scores(docs(spark, rows), marks).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "held_out", "score", "predicted"}
    truth = {i: t for i, _, t in labels[:600]}
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in out if r.doc_id in truth and r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r.score)
    base = by[700][0]
    assert by[700] == by[701] == by[702] and by[None][0] > 0.3 and by[704][0] > 0.3 and sorted(by[703])[0] == base and sorted(by[703])[1] > 0.3


def test_toxicity_without_labels_or_rows(spark):
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity_scores(docs(spark, [(1, "You are an idiot."), (2, "A fine day.")]), marks).collect()}
    assert out[1].predicted == 1 and out[2].predicted == 0
    assert toxicity.toxicity_scores(docs(spark, [(1, "a")]).limit(0), marks).count() == 0


def test_copies_count_once(spark):
    r = random.Random(2)
    base = [f"w{r.randrange(99999)}" for _ in range(80)]
    near = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(0, 80, 20)]
    others = [" ".join(f"w{r.randrange(99999)}" for _ in range(80)) for _ in range(5)]
    rows = spark.createDataFrame([(k, True, t) for k, t in enumerate([" ".join(base), *near, *others, "", None])], "row long, toxic boolean, text string")
    assert sorted(x.row for x in toxicity.first_copies(rows).collect()) == [0, 5, 6, 7, 8, 9, 10, 11]


# 12 -----------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, id int, v int, whitened string")


def brute_whitening(x):
    n, total = len(x), x.sum(axis=0)
    away = x - total / n
    values, axes = np.linalg.eigh(away.T @ away / n)
    order = np.argsort(-values)[:8]
    return total, away @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_against_brute_force(spark):
    r = np.random.default_rng(3)
    data = (r.normal(size=(400, 12)) * np.arange(1, 13)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(5, data[5].tolist()), (None, data[7].tolist())]
    odd = [(900, None), (901, [1.0] * 11 + [None]), (902, [1.0] * 11 + [float("nan")]), (903, [1.0] * 11 + [float("inf")]), (904, [1.0] * 5), (905, [])]
    got = whitening.whitened_components(vectors(spark, rows + odd).repartition(9)).collect()
    x = np.floor(1024 * np.array([v for _, v in rows], dtype=float)).astype(np.int64) + 100_000
    total, white, explained = brute_whitening(x)
    assert len(got) == 8 * len(rows) and {g.n for g in got} == {len(rows)}
    assert all(g.identity_error < 1e-9 and g.explained == pytest.approx(explained[g.component - 1], rel=1e-9) for g in got)
    by = {}
    for g in got:
        by.setdefault((g.vec_id, g.component), []).append(g)
    sign = {k: np.sign(by[0, k][0].whitened * white[0, k - 1]) for k in range(1, 9)}
    for k, (i, _) in enumerate(rows):
        for c in range(1, 9):
            assert all(g.whitened * sign[c] == pytest.approx(white[k, c - 1], abs=1e-9) for g in by[i, c])
            assert all(g.deviation == sum((len(x) * int(a) - int(t)) ** 2 for a, t in zip(x[k], total, strict=True)) for g in by[i, c])


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [None]), (2, [float("nan")])]])
def test_nothing_to_whiten(spark, rows):
    out = whitening.whitened_components(vectors(spark, rows))
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_fewer_directions_than_dimensions(spark):
    rows = [(i, [float(i), 2.0 * i, -1.0, float(i % 3)]) for i in range(40)]
    got = whitening.whitened_components(vectors(spark, rows)).collect()
    assert {g.component for g in got} == {1, 2} and all(g.identity_error < 1e-9 for g in got)
    assert sum({g.component: g.explained for g in got}.values()) == pytest.approx(1)


def test_chan_merging_is_the_moments_of_all():
    r = np.random.default_rng(1)
    x = r.integers(99_000, 101_000, (1000, 5))
    parts = [whitening.state(p) for p in np.split(x, [0, 3, 4, 400, 999])]
    while len(parts) > 1:
        r.shuffle(parts)
        parts = [whitening.merged(parts[0], parts[1]), *parts[2:]]
    n, total, scatter = parts[0]
    away = x - x.mean(axis=0)
    assert n == 1000 and list(total) == x.sum(axis=0).tolist() and np.allclose(scatter, away.T @ away, rtol=1e-12)


def test_numbers_that_do_not_fit(spark):
    with pytest.raises(Exception, match="too large for a whole number"):
        whitening.whitened_components(vectors(spark, [(1, [3e38, 1.0]), (2, [1.0, 2.0])])).collect()
    with pytest.raises(Exception, match="too large for a long"):
        whitening.whitened_components(vectors(spark, [(1, [3e9, 1.0]), (2, [1.0, 2.0])])).collect()


# 13 -----------------------------------------------------------------------------------------------


def brute_runs(w):
    n, out = len(w), set()
    for p in range(1, n // 3 + 1):
        i = 0
        while i < n - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if length >= max(24, 3 * p) and not any(all(w[x] == w[x + q] for x in range(i, i + length - q)) for q in range(1, p)):
                out.add((i, length, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(r):
    w = []
    for _ in range(r.randrange(7)):
        kind = r.randrange(3)
        if kind == 0:
            w += [f"w{r.randrange(2 + 3 * r.randrange(3))}" for _ in range(r.randrange(40))]
        elif kind == 1:
            block = [f"w{r.randrange(1 + r.randrange(4))}" for _ in range(1 + r.randrange(14))]
            w += (block * 60)[: r.randrange(80)]
        else:
            w += w[-r.randrange(1, 30) :] * r.randrange(4)
    return w[:300]


def test_runs_against_brute_force():
    r = random.Random(1)
    for _ in range(60):
        texts = [repetitive(r) for _ in range(r.randrange(1, 6))]
        numbers = {}
        arrays = [np.array([numbers.setdefault(w, len(numbers)) for w in t], dtype=np.int64) for t in texts]
        assert periodic_runs.runs(arrays) == [brute_runs(t) for t in texts]


def test_run_digests_against_brute_force(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, r.choice([" ", "\n", "\t \x0b"]).join(repetitive(r))) for i in range(150)]
    rows += [(None, "a b " * 20), (200, None), (200, ""), (201, " \r\n "), (10**12, "ä ö " * 30), (5, "x y z " * 30), (-3, "x y " * 25)]
    got = periodic_runs.run_digests(docs(spark, rows)).collect()
    want = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = brute_runs(w)
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        left = [x for k, x in enumerate(w) if not any(s + p <= k < s + n for s, n, p in found)]
        digests = ["".join(f"{s},{n},{p}\n" for s, n, p in found), " ".join(left)]
        want.append((i, len(found), *(best or [None] * 3), best and 1000 * best[1] // best[2], *(hashlib.sha256(x.encode()).hexdigest() for x in digests)))
    order = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert [t for _, t in periodic_runs.run_digests(docs(spark, rows)).dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert periodic_runs.run_digests(docs(spark, rows).limit(0)).count() == 0
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(150))


def test_a_long_text_is_taken_whole(spark):
    text = "one " + "a b c d e " * 100_000 + "end"
    out = periodic_runs.find(docs(spark, [(1, text)])).first()
    assert out.words == 500_002 and [tuple(x) for x in out.runs] == [(1, 500_000, 5)] and out.collapsed == "one a b c d e end"
