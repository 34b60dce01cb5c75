"""SentencePiece encoding and decoding through a distinct-chunk table.

When no piece of a model crosses a white-space marker (has a marker after
another character), the segmentation of a text is that of its chunks, each a
run of markers with the characters up to the next run. The same holds between
a letter and a punctuation mark that stand side by side in no piece, so marked
words are split from such marks too. Words repeat, so each distinct chunk is
segmented once for a table of chunks, and the ids are joined back by position.
A model with a piece that crosses markers, or one that changes texts before
encoding, is detected when it is loaded and encodes whole texts.

The chunk table lives in the Python worker and is bounded (two generations of
``TABLE_SIZE`` chunks: when the young one is full it becomes the old one), so
it serves all tasks of a worker while memory stays flat. A table over the
whole corpus would have to bring every word occurrence together with its ids
by a shuffle many times the size of the texts.

Defined edge results: NULL counts as empty and has no ids; repeated rows give
repeated results; an empty table gives an empty result; other columns are
ignored. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
import string
from array import array
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innlytics.llm.common import small_batches, text_bytes

MARKER = "▁"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
TABLE_SIZE = 400_000
LONG_CHUNK = 64
_LOADED: dict[str, ChunkTable] = {}


class ChunkTable:
    """Encodes texts with one model; keeps the segmentation of chunks."""

    def __init__(self, model_file: str):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        crossing = any(re.search(f"[^{MARKER}]{MARKER}", x) for x in pieces)
        glued = any("\n" in x and len(x) > 1 for x in pieces)
        probe = "\n a  bﬁ \t"
        unchanged = self.sp.decode(self.sp.encode(probe)) == probe
        self.by_chunk = unchanged and not crossing and not glued
        self.lead = len(self.sp.encode("\n"))  # what stands before a chunk in encode("\n" + chunk)
        both = re.compile(f"[{LETTERS}][^{LETTERS}]|[^{LETTERS}][{LETTERS}]")
        beside = {c for x in pieces for m in range(len(x) - 1) if both.fullmatch(x[m:m + 2]) for c in x[m:m + 2]}
        marks = "".join(re.escape(c) for c in string.punctuation + "\n" if c not in beside) or "\n"
        gap = f" {MARKER}"
        self.split = re.compile(  # letters up to a mark, marks up to a letter, or a whole marked word
            f"[{gap}]*[{LETTERS}]+(?=[{gap}{marks}]|$)|[{marks}]+(?=[{gap}{LETTERS}]|$)|[{gap}]+[^{gap}]*|[^{gap}]+"
        ).findall
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def _segment(self, chunks: list) -> dict:
        """The segmentation of chunks that the young table lacks; it is put
        there, unless a chunk is long."""
        out, fresh = {}, []
        for c in dict.fromkeys(chunks):
            hit = self.old.get(c)
            if hit is not None:
                out[c] = hit
            else:
                fresh.append(c)
        for c, ids in zip(fresh, self.sp.encode(["\n" + c for c in fresh], num_threads=1)):
            ids = ids[self.lead:]
            out[c] = (array("i", ids).tobytes(), ",".join(map(str, ids)))
        self.young.update((c, f) for c, f in out.items() if len(c) <= LONG_CHUNK)
        return out

    def encode(self, text: str) -> tuple[array, str]:
        """The ids, and the same in decimal, joined by commas."""
        ids = array("i")
        if not text:
            return ids, ""
        if not self.by_chunk:
            ids.extend(self.sp.encode(text))
            return ids, ",".join(map(str, ids))
        chunks = self.split(" " + text)  # the model's own leading marker
        if len(self.young) > TABLE_SIZE:
            self.old, self.young = self.young, {}
        found = list(map(self.young.get, chunks))
        if None in found:
            new = self._segment([c for c, f in zip(chunks, found) if f is None])
            found = [new[c] if f is None else f for c, f in zip(chunks, found)]
        ids.frombytes(b"".join(map(itemgetter(0), found)))
        return ids, ",".join(map(itemgetter(1), found))

    def decode(self, ids) -> str:
        return self.sp.decode(ids.tolist() if isinstance(ids, array) else list(ids))


def table(model_file: str) -> ChunkTable:
    if model_file not in _LOADED:
        _LOADED[model_file] = ChunkTable(model_file)
    return _LOADED[model_file]


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids (array of int) of each whole text."""
    small_batches(docs.sparkSession)

    def step(batches):
        t = table(model_file)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"],
                                "ids": [t.encode(b.decode("utf-8", "replace"))[0].tolist() for b in pdf["b"]]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("b")).mapInPandas(
        step, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text from (doc_id, ids)."""
    small_batches(encoded.sparkSession)

    def step(batches):
        t = table(model_file)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [t.decode(x) for x in pdf["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(step, "doc_id long, text string")


def round_trip(docs: DataFrame, model_file: str) -> DataFrame:
    """Encode, decode and digest in one pass: doc_id, n_tokens, ids_sha256,
    decoded_sha256."""
    small_batches(docs.sparkSession)

    def step(batches):
        t = table(model_file)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for pdf in batches:
            rows = []
            for b in pdf["b"]:
                ids, joined = t.encode(b.decode("utf-8", "replace"))
                rows.append((len(ids), sha(joined), sha(t.decode(ids))))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", pdf["doc_id"])
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("b")).mapInPandas(
        step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
