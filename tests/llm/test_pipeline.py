"""The pipeline against a brute-force version of its stages, and its queries against SQL."""

import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline as P
from tests.llm import test_line_dedup, test_mixing, test_quality_rules, test_simhash
from vecspark.llm.queries import ORACLE_SQL, QUERIES, SPM_MODEL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = ["\n".join(" ".join(rng.choices(vocab, weights, k=25)) for _ in range(8)) for _ in range(60)]
    docs += [d.replace("a", "a", 1) for d in docs[:3]]  # exact copies
    for d in docs[5:15]:  # near copies, one word of each line changed so that no line is the same
        docs.append("\n".join(" ".join(["changed" if i == 3 else w for i, w in enumerate(x.split(" "))]) for x in d.split("\n")))
    docs.append("\n".join([*docs[20].split("\n")[:4], "a line of its own"]))
    docs += ["SHOUT!! " * 100, "", None]
    return [(i, t, rng.choice(["en", "de"]), f"s{rng.randint(0, 2)}", None if t is None else len(t)) for i, t in enumerate(docs)]


def test_stages_match_brute_force(spark, tmp_path):
    import sentencepiece

    rows = fixture()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in P.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "mixing to target weights", "SentencePiece encoding"]
    keep = {r[0] for r in test_quality_rules.brute([(d, lang, t) for d, t, lang, _, _ in rows]) if r[4]}
    left = [r for r in rows if r[0] in keep]
    assert len(left) == len(rows) - 1
    cleaned = {d: (t, n) for d, t, n in test_line_dedup.brute([(r[0], r[1]) for r in left])}
    left = [(d, cleaned[d][0], lang, s, n) for d, _, lang, s, n in left if cleaned[d][1] == 0 or cleaned[d][0].strip()]
    groups = test_simhash.brute([r[1] for r in left])
    left = [r for i, r in enumerate(left) if groups[i] == i]
    chosen = {r[0] for r in test_mixing.brute([(d, t, s, lang, "") for d, t, lang, s, _ in left])[0] if r[4]}
    left = [r for r in left if r[0] in chosen]
    library = sentencepiece.SentencePieceProcessor(model_file=SPM_MODEL)
    want = {d: None if t is None else library.encode(t) for d, t, *_ in left}
    got = {r.doc_id: r.ids for r in P.run(spark, str(tmp_path)).collect()}
    assert got == want and len(rows) * 0.4 < len(want) < len(rows) - 8


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_stages_take_clashing_columns(spark):
    text = "one two three four five six seven eight nine ten eleven twelve\nsecond line of it\nthird line of it"
    rows = [(i, text + (f"\nown {i}" if i else ""), "en", "s", 5, i, 2, 3, 4) for i in range(3)] + [(9, None, None, None, None, 1, 1, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA + ", `a.b` long, __removed long, removed long, h long")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert sorted(((r.doc_id, r.n_chars, r["a.b"], r.removed) for r in P.lines(spark, docs, "").collect()), key=str) == [(0, 5, 0, 3), (1, 5, 1, 3), (2, 5, 2, 3), (9, None, 1, 1)]
    assert P.encoding(spark, docs, "").count() == 4


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")

    def canonical(df):
        cols = sorted(df.columns)
        said = df[cols].map(lambda x: "null" if x is None or x != x else repr(round(float(x), 5) + 0.0) if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)) else str(x))
        return cols, sorted(map(tuple, said.to_numpy().tolist()))

    assert canonical(QUERIES[name](spark, sf_dir).toPandas()) == canonical(con.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_queries_run_over_whole_tables(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
