import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecspark.functions import codec, distance as D
from vecspark.sources import config, options


@pytest.fixture(scope="module")
def sql(spark):
    codec.register_codec(spark)
    codec.register_codec(spark)  # again, as every query does
    D.register_distances(spark)
    return lambda text: spark.sql(text).first()


@pytest.mark.parametrize(
    ("text", "want"),
    [("[]", []), ("[1,2,3]", [1, 2, 3]), ("{1 2}", [1, 2]), ("(4, 5 )", [4, 5]), ("6 7", [6, 7]), ("[1 2 ]", [1, 2]), ("[1,2,3", None), ("[x,1e3,-.5,2abc]", [0, 1000, -0.5, 2])],
)
def test_construct(sql, text, want):
    assert sql(f"SELECT vec_construct('{text}') AS v").v == want


def test_display_and_bytes(sql):
    r = sql("SELECT vec_display(vec_construct('[1.1,2.2,3.3]'), 7) a, vec_display(vec_construct('[]'), 0) b, vec_display_bytes(vec_to_bytes(array(1f, 2.5f)), 0) c, vec_display_bytes(X'00112233445566778899', 0) d, vec_display(CAST(NULL AS ARRAY<FLOAT>), 3) e, vec_display(array(1.23456789f), 3) f")
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("[1.1, 2.2, 3.3]", "[]", "[1, 2.5]", "<invalid vector>", None, "[1.23]")
    r = sql("SELECT vec_is_valid_bytes(vec_to_bytes(array(1f,2f,3f)), 3) a, vec_is_valid_bytes(vec_to_bytes(array(1f,2f,3f)), 2) b, vec_is_valid_bytes(CAST('not a vector' AS BINARY), 1) c, vec_is_valid_bytes(NULL, 1) d, vec_from_bytes(vec_to_bytes(array(1f,2f))) e, vec_display_bytes(vec_pack_bytes('[1, 255]'), 0) f")
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (True, False, False, False, [1.0, 2.0], "[1, 255]")
    r = sql("SELECT vec_is_valid(array(1f,2f,3f), 3) a, vec_is_valid(array(), 0) b, vec_is_valid(NULL, 3) c")
    assert (r.a, r.b, r.c) == (True, True, False)


def test_distances(sql):
    r = sql("SELECT vec_distance(array(1f,2f), array(1f,3f)) a, vec_distance(array(1f,2f), array(1f,3f), 'ip') b, vec_distance(array(1f,2f), array(2f,4f), 'Cosine') c, vec_distance(array(1f,0f,0f), array(-1f,0f,0f), 'COSINE') d, vec_distance(array(1f,2f,3f), array(4f,5f,6f), 'IP') e, vec_distance(array(1f,2f), array(1f,2f,3f), 'EUCLIDEAN') f, vec_distance(array(0f,0f), array(1f,2f), 'COSINE') g, vec_distance(NULL, array(1f)) h, vec_dot(array(1f,2f), array(1f,3f)) i")
    assert (r.a, r.b, round(r.c, 9), r.d, r.e, r.f, r.g, r.h, r.i) == (1, -6, 0, 2, -31, 0, 1, None, 7)
    for bad in ("vec_distance(array(1f), array(1f), 'INVALID')", "vec_distance_strict(array(1f,2f), array(1f), 'L2')", "vec_distance(array(1f), array(1f), NULL)"):
        with pytest.raises(Exception, match="unknown metric|different lengths"):
            sql(f"SELECT {bad}")


def test_quantize_and_hamming(spark, sql):
    r = sql("SELECT vec_quantize(transform(sequence(1, 130), i -> CAST(IF(i = 1 OR i = 64, 1, -1) AS FLOAT))) w, vec_hamming_distance(array(5L, -1L), array(3L, 0L)) h, vec_quantize(array(1f)) e")
    assert (r.w, r.h, r.e) == ([-(2**63) + 1, 0], 66, [])


numbers = st.floats(-100, 100, width=32)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(numbers, numbers), min_size=1, max_size=5))
def test_distance_properties(spark, pairs):
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    for m in ("L2", "IP", "COSINE"):
        ab, ba, to = df.select(D.distance(F.col("a"), F.col("b"), m), D.distance(F.col("b"), F.col("a"), m), D.distance_to(F.col("a"), b, m)).first()
        assert math.isclose(ab, ba, abs_tol=1e-6) and math.isclose(ab, to, rel_tol=1e-9, abs_tol=1e-6)
    assert df.select(D.distance(F.col("a"), F.col("a"))).first()[0] == 0


def test_options():
    o = options.ColumnOptions.of("VECTOR Column |type=hnsw, DIM=50,m=8,dist=Angular,ONLINE=y")
    assert (o.type, o.dim, o.m, o.dist, o.online, o.ef) == ("HNSW", 50, 8, "COSINE", True, 100)
    for bad in ("", "dim=1", "dim=4097", "dim=3,x", "dim=3,type=zzz", "dim=3," + "a=b," * 60, "dim=3,dist=zzz", "dim=3,=2"):
        with pytest.raises(options.OptionError):
            options.ColumnOptions.of(bad)
    assert options.search_options(None) == (10, 100) and options.search_options("5") == (5, 100) and options.search_options("nn=20000,ef_search=7") == (10000, 7) and options.search_options("nn=-1") == (10, 100)


def test_config(tmp_path):
    f = tmp_path / "engine.cnf"
    assert config.read_config(str(f)) == {}
    f.write_text("# settings\nindex_dir = /x # there\n\ncdc_enabled=N\nnonsense\n")
    f.chmod(0o644)
    with pytest.raises(PermissionError):
        config.read_config(str(f))
    f.chmod(0o600)
    assert config.read_config(str(f)) == {"index_dir": "/x", "cdc_enabled": "N"}
