"""Training sequences of a fixed capacity from whole documents, packed by the configuration program of `configurations`."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from postsieve.llm.common import packed, stored, unpacked
from postsieve.llm.configurations import pack
from postsieve.llm.hashing import in_batches
from postsieve.llm.tokens import WORDS, byte_alphabet

NEW = ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")


class Encoder:
    """Ids of texts by a tokenizer file, without special tokens of its own, truncation or padding.

    A byte-level file whose merges make the ids in their order is the same as ranks, for which there is a faster library: the
    pair merged next is the one with the smallest id in both. Other files, and texts that hold the string of an added token, go
    to the file's own library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.ranks = self._ranks(json.load(f))

    def _ranks(self, spec: dict):
        """The encoder by ranks, or None if the file isn't proven to be the same."""
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if model["type"] != "BPE" or not plain or odd or spec.get("normalizer"):
            return None
        back = {c: bytes([b]) for b, c in byte_alphabet().items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [a + b for a, b in merges]
        vocabulary = {v: i for v, i in model["vocab"].items() if v not in self.added}
        if [vocabulary.get(v) for v in made] != list(range(256, 256 + len(made))) or len(vocabulary) != 256 + len(made):
            return None
        if sorted(vocabulary.get(c, -1) for c in back) != list(range(256)):
            return None
        import tiktoken

        ranks = {b"".join(back[c] for c in v): i for v, i in vocabulary.items()}
        return tiktoken.Encoding("file", pat_str=WORDS.pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        slow = [i for i, t in enumerate(texts) if self.ranks is None or any(a in t for a in self.added)]
        out: list[np.ndarray | None] = [None] * len(texts)
        for i, e in zip(slow, self.tokenizer.encode_batch([texts[i] for i in slow], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.uint32)
        return [self.ranks.encode_to_numpy(t) if o is None else o for t, o in zip(texts, out)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of `n` ids: full ones but for the first, so that a text's end stands whole."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def numbered(sizes: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Number of each entry among the equal ones, those counted in `seen` first; `seen` is brought up to date."""
    order = np.argsort(sizes, kind="stable")
    lined = sizes[order]
    first = np.searchsorted(lined, lined)
    out = np.empty(len(sizes), np.int64)
    out[order] = np.arange(len(sizes)) - first + seen[lined]
    seen += np.bincount(sizes, minlength=len(seen))
    return out


def cut_documents(rows: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """A row per piece of each text of `rows` (row, text), with piece, start, length and ids_crc32, and with part and number: the task
    that made it and its number among the task's pieces of that length. To be stored once: tasks that run again may number anew."""
    kinds = [("piece", T.IntegerType()), *((n, T.LongType()) for n in ("start", "length", "ids_crc32", "part", "number"))]
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), *(T.StructField(n, k) for n, k in kinds)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, part = encoder(tokenizer_path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in in_batches(texts):
                found = []
                for i, ids in enumerate(own.ids(texts[a:b]), a):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for piece, (start, size) in enumerate(cuts(len(ids), capacity)):
                        found.append((i, piece, start, size, zlib.crc32(ids[start : start + size])))
                owner, piece, start, size, crc = np.array(found, np.int64).T
                columns = [batch.column(0).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc)]
                columns += [pa.array(np.full(len(owner), part, np.int64)), pa.array(numbered(size, seen))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.select("row", "text").mapInArrow(cut, schema)


class Places:
    """Where the k-th piece of a length goes, by patterns of bins."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        slots, bins = [], 0
        for lengths, n in patterns:
            at = 0
            for length in lengths:
                slots.append((length, n, bins, at))
                at += length
            bins += n
        table = np.array(slots or [(0, 0, 0, 0)], np.int64)
        table = table[np.argsort(table[:, 0], kind="stable")]
        before = np.cumsum(table[:, 1]) - table[:, 1]
        self.lengths, self.bins, self.offsets = table[:, 0], table[:, 2], table[:, 3]
        # number of the first piece of a slot among all slots, and of the first one of each length
        self.first, self.of_length = before, {}
        for length, b in zip(table[:, 0].tolist(), before.tolist()):
            self.of_length.setdefault(length, b)

    def find(self, lengths: pd.Series, numbers: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        at = lengths.map(self.of_length).to_numpy(np.int64) + numbers.to_numpy(np.int64)
        slot = np.searchsorted(self.first, at, side="right") - 1
        return self.bins[slot] + at - self.first[slot], self.offsets[slot]


def pack_documents(
    docs: DataFrame, tokenizer_path: str, text: str = "text", capacity: int = 2048, end_id: int = 0
) -> DataFrame:
    """A row per piece of a document: the columns of `docs` without the text, with piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and `end_id`; NULL and empty texts are `end_id` alone. Only documents of more than `capacity` ids are cut,
    into pieces of that size after a first one with the rest. `ids_crc32` is the CRC-32 of a piece's ids as little-endian 32-bit
    numbers; sequences are numbered from 0, their pieces stand at `offset` without gaps. Rows that repeat are packed each. No documents
    give no rows. Columns of `docs` called like the new ones are replaced.

    Only the histogram of lengths (at most `capacity` rows) comes to the driver, and only its bin patterns go out, whose number depends
    on the capacity. The n-th piece of a length takes the n-th place for it: pieces are numbered within the task that cuts them, and
    tasks lined up per length by their counts, so that no length, however frequent, meets in one task.
    """
    rows = packed(docs, (*NEW, text), text=F.col(f"`{text}`"))
    pieces = stored(cut_documents(rows, tokenizer_path, capacity, end_id), "pieces")
    counts = stored(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(pack(histogram, capacity))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(lengths: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        sequence, offset = places.find(lengths, numbers)
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    lined = pieces.join(before, ["part", "length"]).withColumn("place", place("length", F.col("before") + F.col("number")))
    return unpacked(lined.select("row", "piece", "start", "length", "ids_crc32", "place.*"), *NEW)
