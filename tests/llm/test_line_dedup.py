import random

from vecspark.llm import line_dedup as L

SCHEMA = "doc_id long, text string, n_removed int, other string"


def brute(rows):
    texts = sorted({(d is None, d or 0, t) for d, t in rows if t is not None})
    seen, gone = set(), {}
    for none, d, t in texts:
        lines = [x.strip(" ") for x in t.split("\n")]
        cover = gone.setdefault((none, d, t), set())
        for p in range(len(lines) - 2):
            key = tuple(lines[p : p + 3])
            if not any(key):
                continue
            if key in seen:
                cover |= {p, p + 1, p + 2}
            seen.add(key)
    out = []
    for d, t in rows:
        cover = gone.get((d is None, d or 0, t), set())
        out.append((d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cover), len(cover)))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(9)
    lines = [f"line {i} of text" for i in range(12)] + [""]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 14)))) for i in range(150)]
    rows += [(500, "a\nb\nc\nd"), (501, " b\nc \nd\nnew"), (None, "a\nb\nc"), (502, "\n\n\n\n\n\n"), (503, "\n\n\n\n"), (504, None), (505, ""), (506, "one"), (507, "p\nq\nr\np\nq\nr\np"), (508, "x\ny\nz\n" * 5000)]
    rows += [rows[3], rows[3]]
    df = spark.createDataFrame([(d, t, 7, "o") for d, t in rows], SCHEMA)
    out = L.line_dedup(df)
    assert sorted(out.columns) == sorted(df.columns)
    assert sorted([(r.doc_id, r.text, r.n_removed) for r in out.collect()], key=str) == sorted(brute(rows), key=str)
    assert L.line_dedup(df, removed_col=None).columns == df.columns


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", 1, 2, 3, 4, 5), (2, "a\nb\nc\nd", 1, 2, 3, 4, 5)], "doc_id long, text string, `a.b` long, __at long, __id long, h long, n long")
    out = L.line_dedup(df)
    assert out.columns == [*df.columns, "n_removed"]
    assert sorted(map(tuple, out.collect())) == [(1, "a\nb\nc", 1, 2, 3, 4, 5, 0), (2, "d", 1, 2, 3, 4, 5, 3)]


def test_empty(spark):
    assert L.line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
