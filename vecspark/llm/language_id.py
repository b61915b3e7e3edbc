"""Operator 9: language identification with hyperdimensional profiles.

Every letter has a random vector of ones and minus ones. A trigram is bound by multiplying its letters'
vectors, each permuted (rotated) once for every letter that follows it; a text's profile bundles
(adds) its trigrams. Prototypes of languages bundle the trigrams of all labelled texts. A document
gets the language whose prototype has the greatest cosine with its profile.

Letters and marks of all scripts have vectors of their own, made from the seed and the code point; all
other characters are one symbol, and runs of them one character. So profiles and prototypes have a fixed
size, whatever scripts occur. A bundle is the product of trigram counts with the trigrams' vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.llm.arrow_text import slices, trimmed
from vecspark.plans.session import prepare

DIMENSION = 1024
GRAM = 3
SEED = 20240607
#: Texts that are profiled at once, and distinct trigrams that a task gathers before it bundles them.
BATCH = 128
GATHERED = 200_000
#: Cells of the table that trigrams of a batch are counted in; with more possible trigrams they are sorted.
TABLE = 1 << 22


def _symbols() -> np.ndarray:
    """For each code point itself if it is a letter or a mark, else 0."""
    return np.fromiter((c if category(chr(c))[0] in "LM" else 0 for c in range(0x110000)), np.int32, 0x110000)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Space:
    """Letter vectors and bound trigrams; the same in every process."""

    def __init__(self, dimension: int = DIMENSION, seed: int = SEED):
        if dimension % 64:
            raise ValueError("the dimension is a multiple of 64")
        self.dimension, self.seed = dimension, np.uint64(seed)
        self.symbol = _symbols()

    def letters(self, points: np.ndarray) -> np.ndarray:
        """A row of ones and minus ones for each code point."""
        base = _mix((points.astype(np.uint64) << np.uint64(32)) ^ self.seed)
        step = np.uint64(0x9E3779B97F4A7C15) * np.arange(1, self.dimension // 64 + 1, dtype=np.uint64)
        return (np.unpackbits(_mix(base[:, None] + step[None, :]).view(np.uint8), axis=1).astype(np.int8) << 1) - 1

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of trigrams, each given as three code points in 21 bits."""
        mask, out = np.int64((1 << 21) - 1), None
        for i in range(GRAM):
            points, at = np.unique(codes >> np.int64(21 * (GRAM - 1 - i)) & mask, return_inverse=True)
            rolled = np.roll(self.letters(points), GRAM - 1 - i, axis=1)[at]
            out = rolled if out is None else out * rolled
        return out

    def trigrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The trigrams of all texts, as numbers to the base of the symbols that occur; the text that each is of; those symbols."""
        lower = [f" {t} ".lower() for t in texts]
        size = np.fromiter(map(len, lower), np.int64, len(lower))
        s = self.symbol[np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)]
        doc = np.repeat(np.arange(len(lower), dtype=np.int32), size)
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0) | (doc[1:] != doc[:-1])
        s, doc = s[keep], doc[keep]
        there = np.zeros(0x110000, bool)
        there[s] = True
        points = np.flatnonzero(there)
        if len(s) < GRAM:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), points
        place = np.zeros(points[-1] + 1, np.int64)
        place[points] = np.arange(len(points))
        s = place[s]
        code = (s[:-2] * len(points) + s[1:-1]) * len(points) + s[2:]
        inside = doc[:-2] == doc[2:]
        return code[inside], doc[:-2][inside], points

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct trigrams of all texts in order, and for each text a row of their numbers."""
        code, doc, points = self.trigrams(texts)
        k = len(points)
        if k**GRAM <= TABLE:
            seen = np.bincount(code, minlength=k**GRAM) > 0
            used = np.flatnonzero(seen)
            at = (np.cumsum(seen, dtype=np.int64) - 1)[code] if len(code) else code
        else:
            used, at = np.unique(code, return_inverse=True)
        rows = np.bincount(doc * np.int64(len(used)) + at, minlength=len(texts) * len(used)).reshape(len(texts), -1) if len(used) else np.zeros((len(texts), 0), np.int64)
        return points[used // k**2] << 42 | points[used // k % k] << 21 | points[used % k] if len(used) else used, rows

    def bundle(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' vectors, each so many times."""
        out = np.zeros(self.dimension, np.int64)
        for a in range(0, len(codes), 4096):  # doubles hold these sums exactly: a task's texts weigh far less than 2 ** 53
            out += np.rint(n[a : a + 4096].astype(np.float64) @ self.vectors(codes[a : a + 4096]).astype(np.float64)).astype(np.int64)
        return out


_SPACES: dict[int, Space] = {}


def space(dimension: int) -> Space:
    if dimension not in _SPACES:
        _SPACES[dimension] = Space(dimension)
    return _SPACES[dimension]


def prototypes(df: DataFrame, text_col: str = "text", lang_col: str = "lang", dimension: int = DIMENSION) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes, from all texts with a language.

    Each text counts alike: its trigram numbers are scaled to a sum of 1,000,000, rounded down. Sums are
    of integers, so they don't depend on their order. What reaches the driver is ``dimension`` numbers
    for each language. Null languages and texts are left out; repeated rows count each.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = space(dimension)
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        total: dict[str, np.ndarray] = {}
        size = 0

        def gather(bound: int) -> int:
            left = 0
            for lang, parts in held.items():
                codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                n = np.zeros(len(codes), np.int64)
                np.add.at(n, at, np.concatenate([n for _, n in parts]))
                if len(codes) > bound:
                    total[lang] = total.get(lang, 0) + sp.bundle(codes, n)
                    parts[:] = []
                else:
                    parts[:] = [(codes, n)]
                    left += len(codes)
            for lang in [x for x, parts in held.items() if not parts]:
                del held[lang]
            return left

        for batch in batches:
            for part in slices(batch, "text"):
                langs = np.array(part.column("lang").to_pylist(), object)
                texts = part.column("text").to_pylist()
                for i in range(0, len(texts), BATCH):
                    used, rows = sp.counts(texts[i : i + BATCH])
                    share = rows * 1_000_000 // np.maximum(1, rows.sum(axis=1, keepdims=True))
                    for lang in set(langs[i : i + BATCH]):
                        h = share[langs[i : i + BATCH] == lang].sum(axis=0)
                        held.setdefault(lang, []).append((used[h > 0], h[h > 0]))
                        size += int((h > 0).sum())
                    if size > 4 * GATHERED:
                        size = gather(GATHERED)
        gather(-1)
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimension, pa.string()), pa.array(np.arange(dimension), pa.int32()), pa.array(v)], names=["lang", "at", "n"])

    labelled = df.select(df[lang_col].cast("string").alias("lang"), df[text_col].alias("text")).where("lang is not null and text is not null")
    sums = labelled.mapInArrow(lambda batches: trimmed(run(batches)), "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums["lang"].to_pylist()))
    out = np.zeros((len(langs), dimension))
    out[[langs.index(x) for x in sums["lang"].to_pylist()], sums["at"].to_numpy()] = sums["n"].to_numpy()
    return langs, out / np.maximum(1e-300, np.linalg.norm(out, axis=1, keepdims=True))


def language_id(df: DataFrame, profiles: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (``id_col``, ``lang_predicted``, ``cosine``, ``margin``), one for each row of ``df``.

    ``margin`` is the cosine's lead over the second language, null where there is one language only.
    Of equal cosines the first language by name wins. Texts without a letter, empty and null texts,
    and all texts where there is no prototype, have null in the three columns. Very long texts are
    profiled whole. Repeated rows are judged row by row; other columns are not read, whatever their
    names. An empty table gives an empty one.
    """
    prepare(df.sparkSession)
    langs, unit = profiles
    dimension = unit.shape[1]
    shared = df.sparkSession.sparkContext.broadcast(unit.astype(np.float32).T.copy())
    schema = T.StructType(
        [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("lang_predicted", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("margin", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, names = space(dimension), np.array(langs, object)
        for batch in batches:
            for part in slices(batch, "text"):
                for i in range(0, part.num_rows, BATCH):
                    piece = part.slice(i, BATCH)
                    used, rows = sp.counts(piece.column("text").fill_null("").to_pylist())
                    said = (rows[:, used > 0].sum(axis=1) > 0) & (len(names) > 0)
                    profile = rows.astype(np.float32) @ sp.vectors(used).astype(np.float32) if len(used) else np.zeros((len(rows), dimension), np.float32)
                    score = (profile @ shared.value).astype(np.float64) / np.maximum(1e-9, np.linalg.norm(profile, axis=1))[:, None]
                    if len(names):
                        best = score.argmax(axis=1)
                        top = score[np.arange(len(score)), best]
                        lead = top - np.partition(score, -2, axis=1)[:, -2] if len(names) > 1 else np.full(len(score), np.nan)
                        lang = names[best]
                    else:
                        top = lead = np.zeros(len(score))
                        lang = np.full(len(score), None)
                    no = ~said
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("id"), pa.array(lang, pa.string(), mask=no), pa.array(top, mask=no), pa.array(lead, mask=no | np.isnan(lead))], names=schema.names
                    )

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(lambda batches: trimmed(run(batches)), schema)
