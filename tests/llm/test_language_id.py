import random
import unicodedata

import numpy as np
import pytest

from vecspark.llm import language_id as L


def direct(text, space):
    """A profile by binding letter vectors one trigram at a time; None without a letter."""
    s = []
    for ch in f" {text or ''} ".lower():
        k = ord(ch) if unicodedata.category(ch)[0] in "LM" else 0
        if k or not s or s[-1] != 0:
            s.append(k)
    if not any(s):
        return None
    v = {k: space.letters(np.array([k]))[0].astype(int) for k in set(s)}
    out = np.zeros(space.dimension, int)
    for a, b, c in zip(s, s[1:], s[2:], strict=False):
        out += np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]
    return out, max(0, len(s) - 2)


@pytest.mark.parametrize("table", [L.TABLE, 0])
def test_profiles_match_direct_binding(monkeypatch, table):
    monkeypatch.setattr(L, "TABLE", table)
    space = L.Space(256)
    texts = ["Hello, World!! Grüße", "ñandú  42 x", "a", "", "ab" * 30, "Привет мир", "日本語の文", "مرحبا e\u0301", "İI"]
    used, rows = space.counts(texts)
    got = rows @ space.vectors(used).astype(int)
    assert all((got[i] == (direct(t, space) or [0])[0]).all() for i, t in enumerate(texts))
    assert (np.diff(used) > 0).all() and abs((space.letters(np.arange(200)).astype(int).sum(axis=1))).max() < 80


@pytest.mark.parametrize("gathered", [L.GATHERED, 3])
def test_whole_query_matches_brute_force(spark, monkeypatch, gathered):
    monkeypatch.setattr(L, "GATHERED", gathered)
    space = L.Space(256)
    rng = random.Random(4)
    alphabets = {"en": "abcdefgh ", "de": "abcdefghäöü ", "ru": "абвгдежз ", "zh": "日本語文字漢 "}
    make = lambda lang: "".join(rng.choices(alphabets[lang], k=rng.randint(1, 60)))
    train = [(i, make(lang), lang) for i, lang in enumerate(list(alphabets) * 12)] + [(900, None, "en"), (901, "abc", None), (902, "", "de"), (903, "12 !", "ru")]
    train += [(904, "same text here", "l1"), (905, "same text here", "l0")]  # a tie of two languages
    sums = {}
    for _, t, lang in train:
        if t is not None and lang is not None:
            total = sums.setdefault(lang, np.zeros(256, object))
            p = direct(t, space)
            if p is None:
                continue
            n = {}
            for code, k in zip(*[x.tolist() for x in (space.counts([t])[0], space.counts([t])[1][0])], strict=True):
                n[code] = k * 1_000_000 // p[1]
            for code, k in n.items():
                total += space.vectors(np.array([code]))[0].astype(int) * k
    unit = {lang: v.astype(float) / max(1e-300, np.linalg.norm(v.astype(float))) for lang, v in sums.items()}
    held = [(i, make(lang), None) for i, lang in enumerate(list(alphabets) * 10)] + [(500, None, None), (501, "?! 3", None), (502, "same text here", None), (None, "абв", None), (0, "abc abc", None)]
    want = []
    for d, t, _ in held:
        p = direct(t, space)
        if p is None or not np.linalg.norm(p[0]):
            want.append((d, None, None, None))
            continue
        score = sorted(((round(float(p[0] @ unit[lang] / np.linalg.norm(p[0])), 5), lang) for lang in unit), key=lambda x: (-x[0], x[1]))
        want.append((d, score[0][1], score[0][0], score[0][0] - score[1][0]))
    columns = "doc_id long, text string, lang string"
    got = L.language_id(spark.createDataFrame(held, columns), L.prototypes(spark.createDataFrame(train, columns), dimension=256)).collect()
    order = lambda r: tuple(str(x) for x in r[:2]) + ((str(round(r[2], 3)),) if r[2] is not None else ())
    for g, w in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
        assert g[:2] == w[:2] and (w[2] is None and g[2] is None or abs(g[2] - w[2]) < 1e-4 and abs(g[3] - w[3]) < 1e-4)
    assert [r.lang_predicted for r in got if r.doc_id == 502] == ["l0"]


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 and n_chars >= 100")
    said = L.language_id(held, L.prototypes(train)).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert len(said) > 50 and np.mean([r.lang_predicted == r.lang for r in said]) >= 0.97


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "de"), (4, "", "en"), (5, "123 !!", None), (None, "the dog", None), (1, "the cat and the dog", "en"), (6, "der die das " * 100_000, None)]
    df = spark.createDataFrame([(a, b, c, "clash") for a, b, c in rows], "doc_id long, text string, lang string, cosine string")
    profiles = L.prototypes(df)
    assert profiles[0] == ["de", "en"]
    got = sorted(((r.doc_id, r.lang_predicted) for r in L.language_id(df, profiles).collect()), key=str)
    assert got == sorted([(1, "en"), (1, "en"), (2, "de"), (3, None), (4, None), (5, None), (6, "de"), (None, "en")], key=str)
    none = L.prototypes(df.where("lang = 'xx'"))
    assert none[0] == [] and all(r.lang_predicted is None and r.cosine is None for r in L.language_id(df, none).collect())
    one = L.prototypes(df.where("lang = 'en'"))
    assert all(r.margin is None for r in L.language_id(df, one).collect())
    assert L.language_id(df.limit(0), profiles).count() == 0
