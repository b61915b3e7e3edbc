"""Operator 3: quality rules by divergence from language references.

Each document has two histograms: of character classes, and of the language's common words with one
more bin for all other words. The reference of a language is the mean of the histograms of all its
documents, so that a long document or a long group of copies weighs no more than its number of rows.
A document is rejected where the Jensen-Shannon distance (base 2, square root, 0 to 1) of either
histogram exceeds its limit. A short text differs from any reference by chance; so each limit grows
with one over the square root of the number of characters or words, and texts below the minimum
lengths are not judged and stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.llm.arrow_text import slices, trimmed
from vecspark.plans.session import position, positional, prepare

#: Classes of characters by Unicode general categories: others (control and unassigned ones), upper-case and
#: title-case letters, lower-case letters, letters without case, marks, numbers, white space, punctuation, symbols.
CATEGORIES = ("", "Lu Lt", "Ll", "Lo Lm", "Mn Mc Me", "Nd Nl No", "Zs Zl Zp", "Pc Pd Ps Pe Pi Pf Po", "Sm Sc Sk So")
CLASSES = len(CATEGORIES)
#: Control characters that are white space here.
SPACES = "\t\n\r\f\v"
COMMON_WORDS = 24
MAX_CHAR_DISTANCE = 0.2
MAX_WORD_DISTANCE = 0.12
#: Added to the limits, over the square root of the number of characters or words.
CHAR_SLACK = 2.0
WORD_SLACK = 2.0
MIN_CHARS = 150
MIN_WORDS = 20
#: Fixed-point scale of histograms, so that sums don't depend on their order.
SCALE = 1_000_000
#: Bytes of text that are judged at once.
SLICE_BYTES = 1 << 19
#: Distinct words that a task gathers before it hands their counts on.
GATHERED = 200_000


def _class_table() -> np.ndarray:
    kinds = {c: i for i, cs in enumerate(CATEGORIES) for c in cs.split()}
    out = np.fromiter((kinds.get(category(chr(c)), 0) for c in range(0x110000)), np.uint8, 0x110000)
    out[[ord(c) for c in SPACES]] = 6
    return out


_TABLE: list[np.ndarray] = []


def char_classes(texts: list[str]) -> np.ndarray:
    """A row of ``CLASSES`` counts for each text."""
    if not _TABLE:
        _TABLE.append(_class_table())
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _TABLE[0][codes].astype(np.int64) + np.repeat(np.arange(len(texts)) * CLASSES, size)
    return np.bincount(kind, minlength=len(texts) * CLASSES).reshape(-1, CLASSES)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words of each text by white space, lower-cased: their numbers and all of them."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), r"[ \t\n\r\f\v]+")
    flat = lists.flatten()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(flat, "")
    keep = full.to_numpy(zero_copy_only=False)
    if keep.all():
        return size, flat
    row = np.repeat(np.arange(len(size)), size)[keep]
    return np.bincount(row, minlength=len(size)), flat.filter(full)


def _shares(counts: np.ndarray) -> np.ndarray:
    """Rows of counts as fixed-point shares, rounded down; rows without counts are zero."""
    return counts * SCALE // np.maximum(1, counts.sum(axis=1, keepdims=True))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of rows of counts or shares; 0 where a row has none."""
    total = p.sum(axis=1, keepdims=True)
    p = p / np.where(total == 0, 1, total)
    q = q / np.maximum(q.sum(axis=1, keepdims=True), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=1)
    return np.where(total[:, 0] == 0, 0.0, np.sqrt(np.maximum(0, (left + right) / 2)))


def _texts(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return df.select(df[id_col].alias("id"), F.coalesce(df[lang_col].cast("string"), F.lit("")).alias("lang"), df[text_col].alias("text"))


def common_words(df: DataFrame, id_col: str, text_col: str, lang_col: str, top: int = COMMON_WORDS) -> dict[str, list[str]]:
    """The ``top`` words of each language by their number in all texts; ties by the word's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Table]] = {}
        rows = 0

        def merged(lang: str) -> pa.Table:
            return pa.concat_tables(held[lang]).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def hand_on() -> Iterator[pa.RecordBatch]:
            for lang in held:
                t = merged(lang)
                yield from pa.table([pa.repeat(lang, len(t)), t["word"], t["n"]], names=["lang", "word", "n"]).to_batches(max_chunksize=50_000)
            held.clear()

        for batch in batches:
            for part in slices(batch.select(["lang", "text"]), "text", SLICE_BYTES):
                langs = part.column("lang")
                for lang in pc.unique(langs).to_pylist():
                    texts = part.column("text").filter(pc.equal(langs, lang)).fill_null("")
                    seen = _words(texts)[1].value_counts()
                    held.setdefault(lang, []).append(pa.table([seen.field(0), seen.field(1)], names=["word", "n"]))
                    rows += len(seen)
                if rows > GATHERED:
                    for lang in held:
                        held[lang] = [merged(lang)]
                    rows = sum(len(t[0]) for t in held.values())
                    if rows > GATHERED // 2:
                        yield from hand_on()
                        rows = 0
        yield from hand_on()

    counts = _texts(df, id_col, text_col, lang_col).mapInArrow(lambda batches: trimmed(run(batches)), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))), 1, top)
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= top)
    return {r.lang: [x.word for x in r.best] for r in ranked.groupBy("lang").agg(best.alias("best")).collect()}


def quality_rules(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    *,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    char_slack: float = CHAR_SLACK,
    word_slack: float = WORD_SLACK,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
    carry: bool = False,
) -> DataFrame:
    """Rows (``id_col``, ``n_words``, ``js_chars``, ``js_words``, ``keep``), one for each row of ``df``.

    The references come from all rows of ``df``; what reaches the driver is one small histogram for
    each language. A null language is a language of its own, the same as the empty one. Null, empty
    and short texts stay; null texts have null in the other columns. A text without words has
    ``js_words`` 0. Repeated rows and ids count and are judged row by row. An empty table gives an
    empty one. Very long texts are judged whole. Of common words that occur equally often the first by
    its bytes is taken. With ``carry`` the rows are those of ``df`` that stay, with all their columns,
    whatever the names of those.
    """
    prepare(df.sparkSession)
    words = common_words(df, id_col, text_col, lang_col)
    values = {lang: pa.array(w, pa.string()) for lang, w in words.items()}
    bins = CLASSES + COMMON_WORDS + 1

    def histograms(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[str]]:
        langs = part.column("lang")
        texts = part.column("text").cast(pa.string()).fill_null("")
        chars = char_classes(texts.to_pylist())
        common = np.zeros((part.num_rows, COMMON_WORDS + 1), np.int64)
        for lang in pc.unique(langs).to_pylist():
            rows = np.flatnonzero(pc.equal(langs, lang).to_numpy(zero_copy_only=False))
            size, flat = _words(texts.take(pa.array(rows)))
            at = pc.fill_null(pc.index_in(flat, values.get(lang, pa.array([], pa.string()))), COMMON_WORDS).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(rows)), size)
            common[rows] = np.bincount(doc * (COMMON_WORDS + 1) + at, minlength=len(rows) * (COMMON_WORDS + 1)).reshape(len(rows), -1)
        return chars, common, langs.to_pylist()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                chars, common, langs = histograms(part)
                both = np.hstack([_shares(chars), _shares(common)])
                names, at = np.unique(np.array(langs, object), return_inverse=True)
                for i, lang in enumerate(names):
                    total[lang] = total.get(lang, 0) + both[at == i].sum(axis=0)
        for lang, h in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * bins), pa.array(np.arange(bins), pa.int32()), pa.array(h, pa.int64())], names=["lang", "bin", "n"])

    source = _texts(df, id_col, text_col, lang_col)
    reference: dict[str, np.ndarray] = {}
    for r in source.mapInArrow(lambda batches: trimmed(sums(batches)), "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect():
        reference.setdefault(r.lang, np.zeros(bins))[r.bin] = r.n

    def judge(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        chars, common, langs = histograms(part)
        ref = np.array([reference[x] for x in langs]).reshape(-1, bins)
        a, b = js_distance(chars, ref[:, :CLASSES]), js_distance(common, ref[:, CLASSES:])
        n = common.sum(axis=1)
        size = chars.sum(axis=1)
        bad = (a > max_char_distance + char_slack / np.sqrt(np.maximum(1, size))) & (size >= min_chars)
        bad |= (b > max_word_distance + word_slack / np.sqrt(np.maximum(1, n))) & (n >= min_words)
        return n, a, b, ~bad

    if carry:
        rows, t, lang = positional(df), position(df, text_col), position(df, lang_col)
        columns = rows.columns

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", SLICE_BYTES):
                    said = judge(part.select(["lang", "text"]))[3]
                    yield part.select(columns).filter(pa.array(said))

        both = [F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(t).cast("string").alias("text")]
        return rows.select("*", *both).mapInArrow(lambda batches: trimmed(keep(batches)), rows.schema).toDF(*df.columns)

    schema = T.StructType(
        [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("js_chars", T.DoubleType()), T.StructField("js_words", T.DoubleType()), T.StructField("keep", T.BooleanType())]
    )

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                n, a, b, said = judge(part)
                gone = part.column("text").is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64(), mask=gone), pa.array(a, mask=gone), pa.array(b, mask=gone), pa.array(said)], names=schema.names)

    return source.mapInArrow(lambda batches: trimmed(tell(batches)), schema)
