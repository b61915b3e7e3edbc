"""Reading a SentencePiece model file and rebuilding it for the ``tokenizers`` library."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

UNDERLINE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: How far below the worst piece an unknown character scores, as in the SentencePiece library.
UNKNOWN_PENALTY = 10.0


@dataclass
class SpmModel:
    """The fields of a model protobuf that encoding and decoding need."""

    raw: bytes
    kind: int
    pieces: list[tuple[str, float, int]]
    byte_fallback: bool
    dummy_prefix: bool
    squeeze_spaces: bool
    charsmap: bytes
    unk_id: int = 0
    _index: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, raw: bytes) -> SpmModel:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(raw)
        pieces = [(p.piece, p.score, p.type) for p in m.pieces]
        unk = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        n = m.normalizer_spec
        return cls(raw, m.trainer_spec.model_type, pieces, m.trainer_spec.byte_fallback, n.add_dummy_prefix, n.remove_extra_whitespaces, n.precompiled_charsmap, unk)

    def unigram_scores(self) -> dict[str, float]:
        """Log-probabilities of the pieces that a text can match.

        A unigram model carries them. A BPE model carries merge ranks instead; they become
        log-probabilities by Zipf's law, -log(rank + 1) - log(sum of 1 / r), with ranks by
        falling score and then by id.
        """
        own = [(s, i, p) for i, (p, s, t) in enumerate(self.pieces) if t in (NORMAL, USER)]
        if self.kind == UNIGRAM:
            return {p: s for s, _, p in own}
        own.sort(key=lambda x: (-x[0], x[1]))
        total = math.log(sum(1 / r for r in range(1, len(own) + 1)))
        return {p: -math.log(r) - total for r, (_, _, p) in enumerate(own, 1)}

    def normalizer(self):
        """The rebuilt normaliser: character map, white space, dummy prefix and metaspace marker.

        Squeezing leaves out spaces in front and repeated ones, and markers at the end even where the
        text itself has them, as the SentencePiece library does.
        """
        from tokenizers import Regex, normalizers

        steps = []
        if self.charsmap:
            steps.append(normalizers.Precompiled(self.charsmap))
        if self.squeeze_spaces:
            steps += [normalizers.Replace(Regex(r"\A +"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(UNDERLINE))
        steps.append(normalizers.Replace(" ", UNDERLINE))
        if self.squeeze_spaces:
            steps.append(normalizers.Replace(Regex(UNDERLINE + r"+\z"), ""))
        return normalizers.Sequence(steps)

    def backend(self):
        """The model of the ``tokenizers`` library without normaliser, with byte fallback."""
        from tokenizers import models

        vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        unk = self.pieces[self.unk_id][0]
        if self.kind == UNIGRAM:
            return models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unk_id, byte_fallback=self.byte_fallback)
        own = {p: (s, i) for i, (p, s, t) in enumerate(self.pieces) if t in (NORMAL, USER)}
        merges = []
        for piece, (score, i) in own.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in own and right in own:
                    merges.append((-score, i, own[left][1], own[right][1], left, right))
        merges.sort()
        return models.BPE(vocab, [(m[4], m[5]) for m in merges], unk_token=unk, fuse_unk=True, byte_fallback=self.byte_fallback)

    def tokenizer(self, *, normalise: bool = True):
        """The rebuilt tokenizer; without ``normalise`` it takes pieces of already normalised text."""
        from tokenizers import Tokenizer, decoders

        t = Tokenizer(self.backend())
        if normalise:
            t.normalizer = self.normalizer()
        steps = [decoders.Metaspace(UNDERLINE, "never"), decoders.ByteFallback(), decoders.Fuse()]
        if self.dummy_prefix:
            steps.append(decoders.Strip(" ", 1, 0))
        t.decoder = decoders.Sequence(steps)
        return t

    @cached_property
    def plain(self) -> bool:
        """Whether normalising only prefixes the text and marks its spaces."""
        return not self.charsmap and not self.squeeze_spaces

    @cached_property
    def separable(self) -> bool:
        """Whether no piece holds a marker after another character, nor a line feed.

        Then no piece crosses the start of a run of markers or a line feed, and encoding the
        pre-tokens one by one gives the encoding of the text.
        """
        return not any(re.search(f"[^{UNDERLINE}]{UNDERLINE}|\n", p) for p, _, t in self.pieces if t in (NORMAL, USER))

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        if self.plain:
            return (UNDERLINE if self.dummy_prefix else "") + text.replace(" ", UNDERLINE)
        if "n" not in self._index:
            self._index["n"] = self.normalizer()
        return self._index["n"].normalize_str(text)


_RUNS = re.compile(f"{UNDERLINE}*[^{UNDERLINE}\n]+|{UNDERLINE}+|\n")


def pre_tokens(norm: str) -> list[str]:
    """Cut normalised text before each run of markers and around each line feed; joined, it is the text."""
    return _RUNS.findall(norm)


def distinct_pre_tokens(model: SpmModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The pre-tokens of all texts: the end of each text among them, their indexes, the distinct ones.

    An empty string may be among the distinct ones; it stands for nothing. Null texts have none.
    """
    texts = texts.cast(pa.string()).fill_null("")
    if not model.separable:
        norm = [model.normalise(t) for t in texts.to_pylist()]
        lists = pa.array([[t] for t in norm], pa.list_(pa.string()))
    elif not model.plain or pc.any(pc.match_substring(texts, "  ")).as_py() or pc.any(pc.match_substring(texts, UNDERLINE)).as_py() or pc.any(pc.starts_with(texts, " ")).as_py():
        rows = []
        for t in texts.to_pylist():
            norm = model.normalise(t)
            if UNDERLINE * 2 in norm:
                rows.append(pre_tokens(norm))
            else:
                rows.append(norm.replace("\n", " \n ").replace(UNDERLINE, " " + UNDERLINE).split(" ") if norm else [])
        lists = pa.array(rows, pa.list_(pa.string()))
    else:
        norm = pc.replace_substring(texts, " ", " " + UNDERLINE)
        norm = pc.replace_substring(norm, "\n", " \n ")
        if model.dummy_prefix:
            norm = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(UNDERLINE, norm, ""))
        lists = pc.split_pattern(norm, " ")
    found = lists.flatten().dictionary_encode()
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return ends.astype(np.int64), found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()
