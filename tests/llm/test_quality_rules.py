import math
import random
from collections import Counter

from vecspark.llm import quality_rules as Q


def js(p, q):
    out = 0.0
    for k in set(p) | set(q):
        a, b = p.get(k, 0), q.get(k, 0)
        m = (a + b) / 2
        out += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return math.sqrt(max(0, out / 2))


def kind(ch):
    import unicodedata

    c = unicodedata.category(ch)
    if c[0] == "Z" or ch in "\t\n\r\f\v":
        return "space"
    return {"Lu": "upper", "Lt": "upper", "Ll": "lower", "Lo": "letter", "Lm": "letter"}.get(c, c[0])


def brute(rows):
    words = {}
    for _, lang, t in rows:
        words.setdefault(lang or "", Counter()).update((t or "").lower().split())
    top = {k: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[: Q.COMMON_WORDS]] for k, c in words.items()}
    hists = []
    for _, lang, t in rows:
        known = top[lang or ""]
        hists.append((Counter(map(kind, t or "")), Counter(w if w in known else None for w in (t or "").lower().split())))
    refs = {}
    for (_, lang, _), pair in zip(rows, hists, strict=True):
        for i, h in enumerate(pair):
            ref = refs.setdefault((lang or "", i), Counter())
            for k, n in h.items():
                ref[k] += n * Q.SCALE // sum(h.values())
    out = []
    for (doc, lang, t), pair in zip(rows, hists, strict=True):
        d = []
        for i, h in enumerate(pair):
            ref = refs[lang or "", i]
            d.append(js({k: n / sum(h.values()) for k, n in h.items()}, {k: n / sum(ref.values()) for k, n in ref.items()}) if h else 0.0)
        n, size = sum(pair[1].values()), len(t or "")
        bad = size >= Q.MIN_CHARS and d[0] > Q.MAX_CHAR_DISTANCE + Q.CHAR_SLACK / math.sqrt(size)
        bad |= n >= Q.MIN_WORDS and d[1] > Q.MAX_WORD_DISTANCE + Q.WORD_SLACK / math.sqrt(n)
        out.append((doc, None if t is None else n, None if t is None else round(d[0], 9), None if t is None else round(d[1], 9), not bad))
    return out


def corpus():
    rng = random.Random(1)
    vocab = [f"w{i}é" for i in range(60)]
    rows = [(i, "en" if i % 2 else None, " ".join(rng.choices(vocab, [1 / (j + 1) for j in range(60)], k=rng.randint(5, 300)))) for i in range(60)]
    return rows + [(100, "en", "SHOUT!! " * 60), (101, None, "x | " * 80), (102, "en", None), (103, "en", ""), (104, "de", "allein"), (None, "en", "w1é " * 90), (5, "en", rows[5][2]), (5, "en", rows[5][2]), (105, "en", "w2é w3é " * 40_000), (106, "ja", "日本語 の 文、です。 ３ ①€\u0301\x01 ǅ " * 9)]


def key(r):
    return tuple(str(x) for x in r)


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, lang string, text string, keep int, n_words string")
    said = [(r.doc_id, r.n_words, None if r.js_chars is None else round(r.js_chars, 9), None if r.js_words is None else round(r.js_words, 9), r.keep) for r in Q.quality_rules(df).collect()]
    want = brute(rows)
    assert sorted(said, key=key) == sorted(want, key=key)
    assert {r[0] for r in want if not r[4]} >= {100, 101, 105}
    left = Q.quality_rules(df, carry=True)
    assert left.schema == df.schema
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r[0]) for r in want if r[4])


def test_clashing_names(spark):
    rows = [(1, "en", "a b " * 90, 1, 2, 3, 4), (2, "en", "|" * 400, 5, 6, 7, 8), (3, None, None, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, `a.b` long, __text long, __lang long, TEXT2 long").withColumnRenamed("TEXT2", "c`d")
    out = Q.quality_rules(df, carry=True)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert set(map(tuple, out.collect())) <= set(rows) and Q.quality_rules(df).count() == 3


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert Q.quality_rules(df).count() == 0 == Q.quality_rules(df, carry=True).count()
