"""Operator 2: SentencePiece encoding and decoding through the ``tokenizers`` library.

The model protobuf is parsed and rebuilt (normaliser, metaspace marker, scores or merges, byte
fallback; see :mod:`vecspark.llm.spm_model`). No piece crosses the start of a run of markers or a
line feed, so a worker encodes the distinct pre-tokens of a slice of documents in one multithreaded
batch and joins their ids document by document.

Parity with the SentencePiece library is verified for whole texts. Its normaliser runs over every raw
text, which must give what the rebuilt one gives, and it encodes every distinct pre-token; together that
is its encoding of the text, since no piece crosses pre-tokens. With models that have a character map,
squeeze spaces or have crossing pieces it encodes every raw text instead. The ids of each document are
decoded again and compared with its text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from hashlib import sha1

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vecspark.llm.arrow_text import slices, trimmed
from vecspark.llm.spm_model import UNDERLINE, SpmModel, distinct_pre_tokens

#: Pre-tokens whose ids a worker remembers; beyond them it forgets the rarer ones, which changes no result.
MAX_WORDS = 250_000
#: Pre-tokens that are joined by line feeds and encoded as one text, to spare the library's cost of a text.
JOINED = 128
#: Threads that a task encodes and decodes its batches with, or ``spark.task.cpus`` where that is more.
THREADS = 2


class Codec:
    """Encoder and decoder with the ids of recent pre-tokens kept between calls."""

    def __init__(self, raw: bytes, threads: int = THREADS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        self.threads = threads
        self.model = SpmModel.parse(raw)
        self.words = self.model.tokenizer(normalise=False)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.head = self.reference.encode("\n")
        line = self.words.encode("\n", add_special_tokens=False).ids
        #: The id of a line feed where it always stands alone, so that it can part joined pre-tokens.
        self.line = line[0] if self.model.separable and len(line) == 1 and line[0] != self.model.unk_id else None
        #: Whether the library checks pre-tokens; else it checks whole texts.
        self.by_words = self.model.separable and self.model.plain
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.flat = np.zeros(0, np.int32)
        self.length = np.zeros(1, np.int64)
        self.start = np.zeros(1, np.int64)
        self.parity = np.ones(1, bool)
        self.hits = np.zeros(1, np.int64)

    def _forget(self) -> None:
        """Keep only the pre-tokens met most often, half the limit at most."""
        keep = self.hits >= max(2, np.partition(self.hits, -MAX_WORDS // 2)[-MAX_WORDS // 2] + 1 if len(self.hits) > MAX_WORDS // 2 else 2)
        keep[0] = True
        names = [w for w, k in zip(self.index, keep.tolist(), strict=True) if k]
        self.flat = self.flat[np.repeat(keep, self.length)]
        self.length, self.parity, self.hits = self.length[keep], self.parity[keep], self.hits[keep]
        self.start = np.cumsum(self.length) - self.length
        self.index = {w: i for i, w in enumerate(names)}

    def _learn(self, new: list[str]) -> None:
        """Encode pre-tokens in one multithreaded batch, and check each against the library."""
        apart = [w for w in new if "\n" in w or self.line is None]
        together = [w for w in new if "\n" not in w] if self.line is not None else []
        flats, lengths, parity = [], [], []
        groups = [together[i : i + JOINED] for i in range(0, len(together), JOINED)]
        joined = ["\n".join(g) for g in groups]
        given = [e.ids for e in self.words.encode_batch_fast(joined, add_special_tokens=False)]
        for g, got, said in zip(groups, given, self._reference(joined), strict=True):
            ids = np.array(got, np.int32)
            gap = np.flatnonzero(ids == self.line)
            if len(gap) != len(g) - 1 or said is not None and got != said:
                apart += g
                continue
            lengths.append(np.diff(np.concatenate([[-1], gap, [len(ids)]])) - 1)
            flats.append(np.delete(ids, gap))
            parity.append(np.ones(len(g), bool))
            for w in g:
                self.index[w] = len(self.index)
        if apart:
            ids = [e.ids for e in self.words.encode_batch_fast(apart, add_special_tokens=False)]
            flats.append(np.array([i for x in ids for i in x], np.int32))
            lengths.append(np.array([len(x) for x in ids]))
            parity.append(np.array([said is None or said == x for x, said in zip(ids, self._reference(apart), strict=True)]))
            for w in apart:
                self.index[w] = len(self.index)
        self.flat = np.concatenate([self.flat, *flats])
        self.length = np.concatenate([self.length, *lengths]).astype(np.int64)
        self.parity = np.concatenate([self.parity, *parity])
        self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])
        self.start = np.cumsum(self.length) - self.length

    def _reference(self, new: list[str]) -> list[list[int] | None]:
        """Ids by the library for pre-tokens, encoded behind a line feed whose ids are taken off again, since it adds
        the dummy prefix to every text; None where whole texts are checked."""
        if not self.by_words:
            return [None] * len(new)
        return [ids[len(self.head) :] for ids in self.reference.encode(["\n" + w.replace(UNDERLINE, " ") for w in new], num_threads=self.threads)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in one array, the end of each text in it, and whether its pre-tokens have parity."""
        ends, at, words = distinct_pre_tokens(self.model, texts)
        if len(self.index) + len(words) > MAX_WORDS:
            self._forget()
        new = [w for w in words if w not in self.index]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))[at]
        self.hits += np.bincount(at, minlength=len(self.hits))
        length = self.length[at]
        stop = np.cumsum(length)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.flat[np.repeat(self.start[at] - (stop - length), length) + np.arange(total)] if total else np.zeros(0, np.int32)
        bad = np.concatenate([[0], np.cumsum(~self.parity[at])])[np.concatenate([[0], ends])]
        return ids, np.concatenate([[0], stop])[ends], np.diff(bad) == 0

    def check(self, texts: list[str], ids: list[list[int]]) -> tuple[list[bool], list[bool]]:
        """For each text whether the library normalises it alike, or gives these ids for it where it checks whole
        texts, and whether decoding gives it again."""
        if self.by_words:
            parity = [a == self.model.normalise(t) for t, a in zip(texts, self.reference.normalize(texts), strict=True)] if texts else []
        else:
            parity = [a == b for a, b in zip(ids, self.reference.encode(texts, num_threads=self.threads), strict=True)]
        return parity, [a == b for a, b in zip(texts, self.decode(ids), strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.words.decode_batch(ids, skip_special_tokens=True)


_CODECS: dict[tuple[bytes, int], Codec] = {}


def codec(raw: bytes, threads: int = THREADS) -> Codec:
    key = (sha1(raw).digest(), threads)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(raw, threads)
    return _CODECS[key]


def _threads(df: DataFrame) -> int:
    return max(THREADS, int(df.sparkSession.sparkContext.getConf().get("spark.task.cpus", "1")))


def spm_encode(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (``id_col``, ``ids``, ``n_tokens``, ``parity_ok``, ``roundtrip_ok``), one for each row of ``df``.

    ``ids`` are those of the whole text, however long, without special tokens. ``parity_ok`` tells that
    the SentencePiece library gives the same ids for the raw text (see the module), ``roundtrip_ok`` that decoding gives
    the text again: it doesn't where the model's normaliser changes the text, or where a text holds the
    marker itself. A null text has null in all columns but the id; an empty text has no ids, and both
    checks hold. Repeated rows and null ids are encoded row by row; other columns are not read, whatever
    their names. ``model`` is the content of the model file, whose size doesn't depend on the data. A
    task uses ``THREADS`` threads, or ``spark.task.cpus`` if that is more. An empty table gives an empty one.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    threads = _threads(df)
    schema = T.StructType(
        [
            T.StructField(id_col, df.schema[id_col].dataType),
            T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
            T.StructField("n_tokens", T.IntegerType()),
            T.StructField("parity_ok", T.BooleanType()),
            T.StructField("roundtrip_ok", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, threads)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                ids, ends, alike = c.encode(texts)
                gone = texts.is_null().to_numpy(zero_copy_only=False)
                starts = np.concatenate([[0], ends]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(ids, pa.int32()), mask=pa.array(gone))
                each = [ids[a:b].tolist() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                parity, whole = c.check(texts.fill_null("").to_pylist(), each)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), lists, pa.array(np.diff(starts), pa.int32(), mask=gone), pa.array(np.array(parity, bool) & alike, mask=gone), pa.array(np.array(whole, bool), mask=gone)],
                    names=schema.names,
                )

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(lambda batches: trimmed(run(batches)), schema)


def spm_decode(df: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (``id_col``, ``text``): the text that each array of ids stands for.

    A null array gives a null text, an empty one the empty text. Ids outside the vocabulary are an
    error of the data and raise.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    threads = _threads(df)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, threads)
        most = len(c.model.pieces)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                lists = part.column("ids").to_pylist()
                if any(i is None or not 0 <= i < most for x in lists if x for i in x):
                    raise ValueError("an id outside the vocabulary")
                out = c.decode([x or [] for x in lists])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([None if x is None else t for x, t in zip(lists, out, strict=True)], pa.string())], names=schema.names)

    return df.select(df[id_col].alias("id"), df[ids_col].alias("ids")).mapInArrow(lambda batches: trimmed(run(batches)), schema)
