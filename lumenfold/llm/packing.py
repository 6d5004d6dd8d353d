"""Best-fit packing of token sequences, with a vector of capacities per sequence.

Documents become token ids plus an end id 0; only documents longer than a sequence are cut, into full pieces and a last
one. Pieces are dealt evenly into shards of about SHARD pieces. Inside a shard they are taken by falling length, and
each goes to the open sequence, among those that can hold it under every constraint (tokens, documents, attention cost
as the sum of squared lengths), that scores best: `residual`: the smallest weighted norm of what would be left;
`dot`: the largest weighted dot product of the piece's needs and the capacities still free. A piece that fits nowhere
opens a sequence. In the production setting capacities are as wide as as-few-sequences-as-can-be asks: 2048 documents and
a cost of 2048 * 2048 can never be exceeded within 2048 tokens. Documents and cost still decide which sequence a piece
joins, by their weights: of sequences with about as many tokens left, one that holds few long pieces is filled up before
one that holds many short ones.

Token ids come from a public vocabulary. The words of texts without odd characters (_ODD) are numbered per slice of
texts, distinct words are cut into parts, every distinct part is encoded once and its ids are put in place by number. This
gives the ids that encoding the whole text gives, because no token spans white space or parts there; any other text goes
to the tokenizer whole. A task remembers the ids of at most KNOWN parts and forgets them when it ends.

Defined results: a null text packs as an empty one (the end id alone); rows that repeat a doc_id are packed once each;
an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, numbered_words, release, released, staged, text_slices

SEQUENCE, MAX_DOCS = 2048, 2048
SHARD = 8192
#: Of tokens, documents and cost in the score.
WEIGHTS = (1.0, 0.25, 0.25)
VOCABULARY = "word_bpe_49k.json"
NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Fixed value: the splitting pattern of the vocabulary.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Fixed rule of byte-level vocabularies: a byte that Latin-1 prints stands for itself, the others for characters from 256 on.
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}
#: Parts whose ids a task remembers; beyond them it begins anew.
KNOWN = 400_000
#: Rows and bytes of texts that are encoded at once; what that took is given back before the next, as an executor's memory has to
#: hold two workers beside a grown heap.
ROWS, SLICE = 1024, 2 << 20
#: Beyond ASCII without control characters other than line ends and tabs, Latin-1 letters and a few marks that
#: normalization and lower-casing treat one character at a time; and special tokens.
_ODD = "[^\t\n\r\x20-\x7e¡-§©«¬°±¶·»¿-ÿŒœŸ–—‘’“”…€]|<\\|(?:start|end)oftext\\|>"


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Token ids of texts, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.begin, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, part: str) -> list[int]:
        return [t.id for t in self.model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(_BYTES))]

    def _numbers(self, parts: list[str]) -> np.ndarray:
        """Where begin and size hold each part."""
        if len(self.known) + len(parts) > KNOWN:
            self.forget()
        new = [p for p in parts if p not in self.known]
        ids = [self._ids(p) for p in new]
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(new))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), dtype="<u4", count=int(size.sum()))])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, parts), dtype=np.int64, count=len(parts))

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Per text, its ids."""
        odd = pc.match_substring_regex(texts, _ODD)
        words, number, ends = numbered_words(pc.utf8_lower(pc.if_else(odd, "", texts)))
        parts, part, part_ends = numbered_words(pc.replace_substring_regex(words, _PARTS, r"\0 "))
        at = self._numbers(parts.to_pylist())[part]
        of_words, after = gathered(self.flat, self.begin[at], self.size[at])
        word_end = after[part_ends]
        word_size = np.diff(word_end, prepend=0)
        ids, after = gathered(of_words, (word_end - word_size)[number], word_size[number])
        lo = 0
        for i, hi in enumerate(after[ends].tolist()):
            yield np.asarray(self.full.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype="<u4") if odd[i].as_py() else ids[lo:hi]
            lo = hi


def pieces(docs: DataFrame, length: int = SEQUENCE, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32. vocabulary: a file of the public tokenizers, which every
    worker finds in its own installation."""

    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = WordEncoder(tokenizer_path(vocabulary)), bytes(4)
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part, at = batch.slice(lo, ROWS), 0
                for texts in text_slices(part.column("text"), SLICE):
                    rows = []
                    for i, ids in enumerate(enc.encode(texts), at):
                        raw = ids.tobytes() + end
                        n = len(raw) // 4
                        rows += [(i, k, s, min(length, n - s), zlib.crc32(raw[4 * s : 4 * (s + length)])) for k, s in enumerate(range(0, n, length))]
                    at += len(texts)
                    row, *columns = zip(*rows, strict=True)
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=NAMES)
                    del rows, texts, ids, raw, row, columns
                    release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, SCHEMA)


def pack(lengths: np.ndarray, capacity=(SEQUENCE, MAX_DOCS, SEQUENCE * SEQUENCE), weights=WEIGHTS, score: str = "residual") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece. capacity: tokens, documents, attention cost of a bin."""
    n = len(lengths)
    cap, weight = np.asarray(capacity, dtype=np.float64), np.asarray(weights, dtype=np.float64)
    where, offset = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    need = np.stack([lengths, np.ones(n), lengths.astype(np.float64) ** 2], axis=1)
    if n and (need > cap).any():
        raise ValueError("a piece is larger than a sequence")
    least = need[order[-1]] if n else cap
    free, ids = np.empty((max(16, n), 3)), np.empty(max(16, n), dtype=np.int64)
    n_open = bins = 0
    for at, i in enumerate(order):
        v = need[i]
        best = -1
        if n_open:
            left = free[:n_open] - v
            fits = (left >= 0).all(axis=1)
            if fits.any():
                rows = np.flatnonzero(fits)
                if score == "dot":
                    best = rows[np.argmax(((free[rows] / cap) * (v / cap) * weight).sum(axis=1))]
                else:
                    best = rows[np.argmin((weight * (left[rows] / cap) ** 2).sum(axis=1))]
        if best < 0:
            best = n_open
            free[best], ids[best] = cap, bins
            n_open, bins = n_open + 1, bins + 1
        where[i], offset[i] = ids[best], cap[0] - free[best, 0]
        free[best] -= v
        if (free[best] < least).any():  # closed: not even the smallest piece fits
            n_open -= 1
            free[best], ids[best] = free[n_open], ids[n_open]
    return where, offset


def packed(docs: DataFrame, length: int = SEQUENCE, max_docs: int = MAX_DOCS, max_cost: int | None = None, weights=WEIGHTS, score: str = "residual", vocabulary: str = VOCABULARY, shard: int = SHARD) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    capacity = (length, max_docs, length * length if max_cost is None else max_cost)
    cut = staged(pieces(docs, length, vocabulary), "pack-pieces")
    shards = max(1, round(cut.count() / shard))
    # the row number in the staged table, not a key, deals the pieces out: no repeated id can fill a shard
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=False, kind="stable")
        where, offset = pack(pdf["length"].to_numpy(np.int64), capacity, weights, score)
        return pdf.assign(sequence_id=(pdf["shard"].to_numpy(np.int64) << 32) + where, offset=offset).drop(columns="shard")

    schema = SCHEMA.replace("doc_id long", "doc_id string") + ", sequence_id long, offset long"
    out = dealt.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("shard").applyInPandas(fill, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
