"""Vector best-fit packing of tokenised documents into sequences."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioflow.llm.shared import Workspace, prepare
from folioflow.llm.wordbpe import looked_up, usual

_encoders: dict = {}


class ChunkEncoder:
    """Token ids of a text, as little-endian bytes, put together from those of its chunks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.table: dict[str, bytes] = {}

    def _all(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, text: str) -> bytes:
        if not usual(text) or any(t in text for t in self.special):
            return self._all([text])[0]
        return b"".join(looked_up(self.table, text.lower().split(), self._all))


def _encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, vocabulary: str, longest: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's ids, cut only where longer than ``longest``.

    The ids leave no trace but their crc32, so what is shuffled later is a few
    numbers a piece and no text. A null text counts as empty and yields ``end_id`` alone.
    """
    prepare(docs.sparkSession)
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    step, end = 4 * longest, np.asarray([end_id], "<u4").tobytes()

    def cut(batches):
        encoder = _encoder(vocabulary)
        for batch in batches:
            rows, number, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.ids(text or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append(i)
                    number.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=[id_col, "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, max_tokens: int, max_docs: int, max_cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, by vector best-fit decreasing.

    A bin is a vector of residual tokens, documents and attention cost (the sum
    of squared lengths), each as a share of its capacity. Pieces go longest
    first to the bin, of those that hold them in every dimension, whose weighted
    residual norm is smallest afterwards; where none does, a bin is opened. A
    dimension's weight is the share of its capacity that the pieces ask for. Bins
    that can't take the shortest piece leave the search.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return bins, offsets
    order = np.argsort(-lengths, kind="stable")
    capacity = np.array([max_tokens, max_docs, max_cost], float)
    demand = np.stack([lengths.astype(float), np.ones(n), lengths.astype(float) ** 2], 1) / capacity
    weight = demand.mean(0) / demand.mean(0).sum()
    shortest = demand[order[-1]]
    left, label, used = np.empty((1024, 3)), np.empty(1024, np.int64), np.empty(1024, np.int64)
    opened = count = 0
    slack = 1e-9
    for i in order:
        d, length = demand[i], lengths[i]
        after = left[:opened] - d
        fits = (after > -slack).all(1)
        if fits.any():
            norm = np.where(fits, after**2 @ weight, np.inf)
            k = int(norm.argmin())
            left[k] = after[k]
        else:
            if opened == len(left):
                left, label, used = np.concatenate([left, left]), np.concatenate([label, label]), np.concatenate([used, used])
            k, opened = opened, opened + 1
            left[k], label[k], used[k] = 1 - d, count, 0
            count += 1
        bins[i], offsets[i] = label[k], used[k]
        used[k] += length
        if (left[k] < shortest - slack).any():
            opened -= 1
            left[k], label[k], used[k] = left[opened], label[opened], used[opened]
    return bins, offsets


def pack(cut: DataFrame, max_tokens: int = 4096, max_docs: int = 4096, max_cost: float | None = None, group_rows: int = 16_384, id_col: str = "doc_id") -> DataFrame:
    """The pieces with sequence_id and offset, no sequence over any of the three capacities.

    Pieces are dealt by a hash of id, piece and crc to groups of about
    ``group_rows``; each group is packed on its own, which leaves at most one
    half-empty sequence a group and no group that grows with the input. A piece
    that fills a sequence by itself needs no search. ``max_cost`` is by default the
    square of ``max_tokens``, which no sequence within ``max_tokens`` can pass.
    Pieces over ``max_tokens`` or ``max_cost`` raise an error.
    """
    spark, cost = cut.sparkSession, float(max_tokens**2 if max_cost is None else max_cost)
    prepare(spark)
    cut = Workspace(spark, "packing").keep(cut, "pieces")
    groups = max(1, -(-cut.count() // group_rows))
    schema = f"{id_col} {cut.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def fill(key, group):
        group = group.sort_by([("length", "descending"), ("ids_crc32", "ascending"), (id_col, "ascending"), ("piece", "ascending")])
        lengths = group.column("length").to_numpy()
        if len(lengths) and (lengths.max() > max_tokens or float(lengths.max()) ** 2 > cost):
            raise ValueError("a piece is over the capacity of an empty sequence")
        bins, offsets = best_fit(lengths, max_tokens, max_docs, cost)
        first = key[0].as_py() << 40
        return group.select([id_col, "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(bins + first, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    dealt = cut.withColumn("group", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(fill, schema)  # no hints: both arguments are Arrow's


def packed(docs: DataFrame, vocabulary: str, max_tokens: int = 4096, end_id: int = 1, max_docs: int = 4096, max_cost: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every document: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty; null and repeated ids are documents of their
    own; other columns are not read; an empty table gives an empty result.
    """
    return pack(pieces(docs, vocabulary, max_tokens, end_id, id_col, text_col), max_tokens, max_docs, max_cost, id_col=id_col)
