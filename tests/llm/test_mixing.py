import hashlib
import random
import re
from collections import defaultdict

import pytest

from vecspark.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, lang string, topic string"


def corpus():
    rng = random.Random(6)
    kinds = ["word " * 20, "a | b | c | ", "wow! " * 5, "1 22 333 ", "License and Copyright text "]
    rows = [(i, rng.choice(kinds) * rng.randint(1, 9), f"s{min(4, int(rng.expovariate(0.7)))}", rng.choice(["en", "en", "de", None]), "clash") for i in range(300)]
    return rows + [(None, "null id words", "s0", "en", "x"), (400, None, "s0", "en", "x"), (401, "", None, None, "x"), (7, "again", "s1", "de", "x"), (7, "again", "s1", "de", "x"), (402, "long text " * 50_000, "s2", "en", "x")]


def brute(rows, exponents=M.EXPONENTS, budget=M.BUDGET, rounds=M.ROUNDS, targets=None, own_topic=False):
    said = []
    for d, t, s, lang, given in rows:
        n = len(re.findall(M.WORD, t or ""))
        hits = [len(re.findall(p, t or "")) for _, p in M.TOPICS]
        top = max(hits)
        topic = M.TOPICS[hits.index(top)][0] if top and top * M.TOPIC_WORDS >= n else M.OTHER_TOPIC
        said.append((d, t, (s or "", lang or "", (given or "") if own_topic else topic), n))
    tokens = defaultdict(int)
    for _, _, c, n in said:
        if n:
            tokens[c] += n
    want = []
    for i, d in enumerate(M.DIMENSIONS):
        share = defaultdict(int)
        for c, n in tokens.items():
            share[c[i]] += n
        power = {k: targets[d].get(k, 0) if d in (targets or {}) else v ** exponents[d] for k, v in share.items()}
        want.append({k: v / sum(power.values()) * sum(tokens.values()) * budget for k, v in power.items()})
    w = {c: n * budget for c, n in tokens.items()}
    for _ in range(rounds):
        for i in range(3):
            now = defaultdict(float)
            for c, x in w.items():
                now[c[i]] += x
            w = {c: min(tokens[c], x * want[i][c[i]] / max(now[c[i]], 1e-300)) for c, x in w.items()}
    out = []
    for d, t, c, n in said:
        p = w[c] / tokens[c] if n else 1.0
        u = int(hashlib.md5(f"{M.SEED}:{d if d is not None else t or ''}".encode()).hexdigest()[:13], 16) / 2**52
        out.append((d, c[2], n, round(p, 9), u < p))
    return out, w, want


TARGETS = {"source": {"s0": 2, "s1": 1, "s2": 1, "absent": 5}, "topic": {"x": 0.5, "clash": 0.5}}


@pytest.mark.parametrize("given", [{}, {"targets": TARGETS, "topic_col": "topic", "budget": 0.3}])
def test_matches_brute_force(spark, given):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.doc_id, r.topic, r.n_tokens, round(r.probability, 9), r.sampled) for r in M.mix(df, **given).collect()]
    want, w, marginal = brute(rows, budget=given.get("budget", M.BUDGET), targets=given.get("targets"), own_topic="topic_col" in given)
    assert sorted(got, key=str) == sorted(want, key=str)
    left = M.mix(df, carry=True, **given)
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r[0]) for r in want if r[4])
    said = {(r.dimension, r.value): r for r in M.marginals(df, **given).collect()}
    assert len(said) == sum(map(len, marginal))
    for i, d in enumerate(M.DIMENSIONS):
        for v, n in marginal[i].items():
            assert said[d, v].target == pytest.approx(n) and said[d, v].expected == pytest.approx(sum(x for c, x in w.items() if c[i] == v))


def test_raking_meets_targets():
    import numpy as np

    rng = np.random.default_rng(1)
    cells = {d: rng.integers(0, 4, 200) for d in M.DIMENSIONS}
    tokens = rng.integers(1000, 2000, 200)
    shares = {d: M.target_shares(list("0123"), np.bincount(v, tokens), 0.8, None) for d, v in cells.items()} | {"lang": M.target_shares(list("0123"), np.ones(4), 1, {"0": 3, "1": 3, "2": 2, "3": 2})}
    for rounds in (30, 30_000):  # ends once the targets are met
        w = M.rake(cells, tokens, shares, 0.3, rounds, 1e-9)
        for d, v in cells.items():
            assert np.allclose(np.bincount(v, w), shares[d] * tokens.sum() * 0.3, rtol=1e-6)
    assert shares["lang"].tolist() == [0.3, 0.3, 0.2, 0.2]
    with pytest.raises(ValueError, match="target shares"):
        M.target_shares(["a"], np.ones(1), 1, {"b": 1})


def test_cells_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_CELLS", 3)
    with pytest.raises(ValueError, match="group the sources"):
        M.mix(spark.createDataFrame(corpus(), SCHEMA))


def test_clashing_names(spark):
    rows = [(i, "word " * (i + 1), "s", "en", i, 1, 2, 3, 4, 5) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, `a.b` long, __id long, __text long, __tokens long, __p long, topic long")
    out = M.mix(df, carry=True)
    assert out.columns == df.columns
    assert {tuple(r) for r in out.collect()} == {r for r, s in zip(rows, brute([(r[0], r[1], "s", "en", "") for r in rows])[0], strict=True) if s[4]}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert M.mix(df).count() == 0 == M.mix(df, carry=True).count()
