import random
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from vecspark.llm import simhash as S


def features(text):
    """Distinct words, without the code under test; every character that isn't ASCII, Latin or a sign is unspaced here."""
    out = set()
    for word in (text or "").lower().split():
        for unspaced, chars in groupby(word, lambda c: "\u3040" <= c <= "\u9fff"):
            run = "".join(chars)
            if unspaced:
                out |= {run[i : i + 2] for i in range(max(1, len(run) - 1))}
            elif run.strip(S._EDGE):
                out.add(run.strip(S._EDGE))
    return out


def fingerprint(text):
    """A fingerprint as one number, bit by bit; None without features."""
    words = features(text)
    if not words:
        return None
    mask = (1 << 64) - 1

    def bits(word):
        base, out = xxhash.xxh3_64_intdigest(word.encode()), b""
        for k in range(1, S.BITS // 64 + 1):
            x = (base + 0x9E3779B97F4A7C15 * k) & mask
            x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
            x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
            out += (x ^ x >> 31).to_bytes(8, "little")
        return out

    each = [int.from_bytes(bits(w), "big") for w in words]
    return sum(1 << i for i in range(S.BITS) if 2 * sum(e >> i & 1 for e in each) > len(each))


def brute(texts):
    """Groups by comparing all fingerprints and chaining."""
    prints = [fingerprint(t) for t in texts]
    group = list(range(len(texts)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if None not in (prints[i], prints[j]) and (prints[i] ^ prints[j]).bit_count() <= S.MAX_DISTANCE:
                a, b = sorted((find(i), find(j)))
                group[b] = a
    return [find(i) for i in range(len(texts))]


def corpus(n=120):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(n)]
    for i in range(0, n, 3):
        w = texts[i].split()
        w[7] = "changed" + str(i)
        texts.append(" ".join(w))
    return texts + texts[:5]


def test_groups_match_brute_force(spark):
    texts = corpus()
    want = brute(texts)
    got = {r.doc_id: r for r in S.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].group_id for i in range(len(texts))] == want
    assert [got[i].kept for i in range(len(texts))] == [g == i for i, g in enumerate(want)]


def test_fingerprints_match_definition():
    texts = ["One, two (three) THREE?", "", None, " ... !!", "不要的词语。东西", "x 语 y", "\x00 a\x00", "ñandú Größe " * 40, "a b a b c"]
    prints, has = S.fingerprints(pa.array(texts, pa.string()))
    want = [fingerprint(t) for t in texts]
    assert has.tolist() == [w is not None for w in want]
    assert [int.from_bytes(prints[i].tobytes(), "big") for i in np.flatnonzero(has)] == [w for w in want if w is not None]


def test_short_words_and_numbers_tell_texts_apart(spark):
    long = "harbour railway mountain library machine gardener painting scholar thunder village winter journey"
    texts = [f"{long} in 2019 the man won 12 of 40 at sea", f"{long} by 1066 a dog ate 99 or 7 up top", long]
    rng = random.Random(3)
    chinese = "".join(chr(rng.randint(0x4E00, 0x5E00)) for _ in range(300))
    texts += [chinese, chinese[:100] + "你" + chinese[101:200] + "好" + chinese[201:], "".join(reversed(chinese))]
    got = {r.doc_id: r.group_id for r in S.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 5}


def sets(links):
    root = {}
    for a, b in links:
        for x in (a, b):
            root.setdefault(x, x)
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)

    def find(x):
        return x if root[x] == x else find(root[x])

    return {x: find(x) for x in root}


def test_blocks_chunks_and_large_sets_change_nothing(spark, monkeypatch):
    prints, _ = S.fingerprints(pa.array(corpus(60)))
    prints = np.unique(prints, axis=0)
    df = spark.createDataFrame([(bytearray(x),) for x in prints], "fp binary").cache()
    joined = lambda **k: sets((bytes(r.a), bytes(r.b)) for r in S.similar_links(df, **k).collect())
    want = joined()
    assert want and joined(block_rows=8) == want
    monkeypatch.setattr(S, "HOT_BLOCKS", 0.1)
    assert joined(block_rows=40) == want  # every block is split in chunks
    monkeypatch.setattr(S, "PART_ROWS", 8)
    seg = prints.view(">u4").astype(np.int64)
    for pairwise in (24, 0):
        monkeypatch.setattr(S, "PAIRWISE", pairwise)
        found = []
        for s in range(S.SEGMENTS):
            a, b = S.block_links(seg[:, s], np.ones(len(seg), bool), prints, 32, S.MAX_DISTANCE)
            found += [(prints[x].tobytes(), prints[y].tobytes()) for x, y in zip(a, b, strict=True)]
            assert all(x < y for x, y in found)
        assert sets(found) == want


@pytest.mark.parametrize("pairwise", [0, 24])
def test_links_of_one_key_match_brute_force(monkeypatch, pairwise):
    monkeypatch.setattr(S, "PAIRWISE", pairwise)
    prints, _ = S.fingerprints(pa.array(corpus(30)))
    prints = np.unique(prints, axis=0)
    low, own = np.zeros(len(prints), np.int64), np.ones(len(prints), bool)
    a, b = S.block_links(low, own, prints, 32, S.MAX_DISTANCE)
    w = prints.view(np.uint64)
    near = [(x, y) for x in range(len(w)) for y in range(x) if np.bitwise_count(w[x] ^ w[y]).sum() <= S.MAX_DISTANCE]
    assert near and sets(zip(a.tolist(), b.tolist(), strict=True)) == sets(near)


def far_pairs(n):
    """Pairs of texts within the threshold, of which no segment is within two bits."""
    rng, out = random.Random(11), []
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 9))) for _ in range(4000)]
    while len(out) < 2 * n:
        w = rng.sample(words, 120)
        pair = [" ".join(w), " ".join(w[:112] + rng.sample(words, 8))]
        a, b = S.fingerprints(pa.array(pair))[0]
        apart = np.bitwise_count(a.view(np.uint32) ^ b.view(np.uint32))
        if apart.sum() <= S.MAX_DISTANCE and apart.min() > 2:
            out += pair
    return out


def test_no_pair_within_the_threshold_is_left_out(spark):
    texts = far_pairs(4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in S.near_duplicate_groups(df).collect()}
    assert got == {i: i // 2 * 2 for i in range(8)} == dict(enumerate(brute(texts)))
    assert sorted(r.doc_id for r in S.drop_near_duplicates(df).collect()) == [0, 2, 4, 6]
    assert S.near_duplicate_groups(df, exact=False).where("kept").count() == 8


def test_all_links_match_brute_force_however_chunked(spark):
    prints = np.unique(S.fingerprints(pa.array(corpus(60) + far_pairs(3)))[0], axis=0)
    df = spark.createDataFrame([(bytearray(x),) for x in prints], "fp binary").cache()
    w = prints.view(np.uint64)
    near = [(prints[x].tobytes(), prints[y].tobytes()) for x in range(len(w)) for y in range(x) if np.bitwise_count(w[x] ^ w[y]).sum() <= S.MAX_DISTANCE]
    for rows in (None, 1000, 30, 7):
        links = S.all_links(df, chunk_rows=rows).collect()
        assert all(bytes(r.a) < bytes(r.b) for r in links)
        assert sets((bytes(r.a), bytes(r.b)) for r in links) == sets(near)
    assert S.all_links(df.limit(0)).count() == 0


@pytest.mark.parametrize("tiles", [(1024, 512, 8), (5, 3, 2), (1, 1, 1)])
@pytest.mark.parametrize("most", [0, 3, 92, 240, 511, 512])
def test_pair_links_match_brute_force(monkeypatch, tiles, most):
    for name, n in zip(("TILE_ROWS", "TILE_COLUMNS", "TILES"), tiles, strict=True):
        monkeypatch.setattr(S, name, n)
    monkeypatch.setattr(S, "JOIN_ROWS", tiles[0])
    rng = np.random.default_rng(most)
    bits = rng.integers(0, 2, (40, S.BITS), dtype=np.uint8)
    bits[0], bits[1] = 0, 1
    near = np.repeat(bits[:8], 5, axis=0) ^ (rng.random((40, S.BITS)) < rng.choice([0.002, 0.05, 0.1, 0.17], 40)[:, None])
    prints = np.unique(np.packbits(np.concatenate([bits, near]), axis=1), axis=0)
    w, every = prints.view(np.uint64), np.arange(len(prints))
    for left, right in ((every, every), (every[::2], every[1::2]), (every[:7], every[7:])):
        rights = set(right.tolist())
        want = [(x, y) for x in left.tolist() for y in rights if x != y and np.bitwise_count(w[x] ^ w[y]).sum() <= most]
        a, b = S.pair_links(prints, left, left if right is left else right, most)
        assert sets(zip(a.tolist(), b.tolist(), strict=True)) == sets(want)


def test_components(spark):
    e = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7)]
    df = spark.createDataFrame([(bytearray(a.to_bytes(4, "big")), bytearray(b.to_bytes(4, "big"))) for a, b in e], "a binary, b binary")
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in S.components(df).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}


def test_odd_rows(spark):
    long = "words of some length repeated many times over " * 3000
    rows = [(None, "alpha beta gamma delta", 1), (3, "alpha beta gamma delta", 2), (3, "alpha beta gamma delta", 3), (4, None, 4), (5, "", 5), (6, " ", 6), (6, " ", 6), (7, long, 7), (8, long + "x", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept long")
    got = sorted(((r.doc_id, r.group_id, r.kept) for r in S.near_duplicate_groups(df).collect()), key=str)
    assert got == sorted([(None, 3, False), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 7, True), (8, 7, False)], key=str)
    left = S.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 6, 7]


def test_clashing_names(spark):
    text = "alpha beta gamma delta epsilon"
    df = spark.createDataFrame([(1, text, 1, 2, 3, 4, 5), (2, text, 6, 7, 8, 9, 0), (2, text, 6, 7, 8, 9, 0)], "doc_id long, text string, `a.b` long, __id long, __h long, `c``d` long, ID2 long")
    out = S.drop_near_duplicates(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, text, 1, 2, 3, 4, 5)]
    assert S.near_duplicate_groups(df).count() == 2


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicate_groups(df).count() == 0
    assert S.drop_near_duplicates(df).count() == 0
