"""Operator 6: token counts from batch encoding inside Arrow functions.

A SentencePiece piece never has a word start inside it, so a text may be cut
before every run of blanks without changing its pieces (checked against the
vocabulary when the model is loaded). Texts are cut there, the distinct cuts of
a batch are encoded together, and only lengths leave the function. Batches hold
a bounded number of bytes, whatever the texts' lengths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import python_ready

#: Text bytes that are cut and encoded together.
BATCH_BYTES = 4 << 20
#: Longest cut that is remembered, and how many are before the memory is emptied.
MEMO_CHARS, MEMO_CUTS = 48, 400_000

#: Characters of distinct cuts that are encoded as one string.
JOINED_CHARS = 2000

_BLANK = "▁"  # the model's own mark for a blank
_CUT = re.compile(" +[^ ]*")


def safe_to_cut(pieces: list[str]) -> bool:
    """No piece goes on past a blank, so cuts before blanks change nothing."""
    return not any(re.search(f"[^{_BLANK}]{_BLANK}", p) for p in pieces)


class CutCounter:
    """Counts tokens of texts through counts of their cuts."""

    def __init__(self, model_bytes: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
        self.cuttable = safe_to_cut([self.model.id_to_piece(i) for i in range(self.model.get_piece_size())])
        probe = self.model.encode(["a b", "b"], out_type=str, num_threads=1)
        self.cuttable &= probe[0] == [f"{_BLANK}a", f"{_BLANK}b"] and probe[1] == [f"{_BLANK}b"]
        self.starts_word = np.array([self.model.id_to_piece(i).startswith(_BLANK) for i in range(self.model.get_piece_size())])
        self.memo: dict[str, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.cuttable:
            return self.lengths(texts)
        memo, out = self.memo, []
        if len(memo) > MEMO_CUTS:
            memo.clear()
        # the model puts one blank before a text, which the leading blank of a cut stands for
        cuts = [_CUT.findall(" " + t.replace(_BLANK, " ")) if t else [] for t in texts]
        fresh = [*set().union(*cuts).difference(memo)]
        new = self._encode_cuts(fresh)
        memo.update(new)
        for cs in cuts:
            out.append(sum(map(memo.__getitem__, cs)))
        for c in fresh:
            if len(c) > MEMO_CHARS:
                del memo[c]
        return out

    def _encode_cuts(self, cuts: list[str]) -> dict[str, int]:
        """Tokens of each cut. Words are encoded side by side in longer strings,
        where a piece that starts with a blank starts the next word."""
        words = [c for c in cuts if len(c) > 1 and c[1] != " "]
        new: dict[str, int] = {}
        run, size = [], 0
        strings: list[str] = []
        for w in words:
            run.append(w)
            size += len(w)
            if size > JOINED_CHARS:
                strings.append("".join(run)[1:])
                run, size = [], 0
        if run:
            strings.append("".join(run)[1:])
        if words:
            ids = np.concatenate([np.array(x, np.int64) for x in self.model.encode(strings, num_threads=1)])
            starts = np.flatnonzero(self.starts_word[ids])
            if len(starts) != len(words):
                raise ValueError("the vocabulary cuts words in an unexpected place")
            new = dict(zip(words, np.diff(np.append(starts, len(ids))).tolist(), strict=True))
        rest = [c for c in cuts if len(c) == 1 or c[1] == " "]  # runs of blanks: each on its own
        new.update(zip(rest, self.lengths([c[1:] for c in rest]), strict=True))
        # a lone blank with nothing after it is a token when something stands before it
        if " " in new:
            new[" "] = len(self.model.encode("a ")) - len(self.model.encode("a"))
        return new


def _batches(texts: list[str], limit: int) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` characters; longer texts stand alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield texts[at:]


def count_tokens(docs: DataFrame, model_bytes: bytes, *, key: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``key, n_bytes, n_tokens`` for every row; no shuffle.

    Null and empty texts have no bytes and no tokens; repeated rows are counted
    each; extra columns are not read; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_bytes)  # one tokenizer file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = CutCounter(model.value)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            counts: list[int] = []
            for part in _batches(texts, batch_bytes):
                counts += counter.count(part)
            n_bytes = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64())], names=["k", "n_bytes", "n_tokens"])

    slim = python_ready(docs.select(F.col(key).alias("k"), F.col(text).alias("t")))
    kind = slim.schema["k"].dataType.simpleString()
    return slim.mapInArrow(run, f"k {kind}, n_bytes long, n_tokens long").withColumnRenamed("k", key)
