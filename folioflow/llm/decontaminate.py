"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioflow.llm.rolling import keys_at, plain_points, prefix_sums, spelt, window_keys
from folioflow.llm.shared import Workspace, fresh, prepare

_SEGMENT = 1 << 20


def plain(text: str) -> str:
    """Lower case, with one space for each run of anything but letters and digits."""
    return spelt(plain_points(text))


def budget(length: int, rate: float) -> int:
    """Edits allowed for an item of so many characters."""
    return int(length * rate)


def cut(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, end) of ``parts`` pieces of almost equal length."""
    marks = [length * k // parts for k in range(parts + 1)]
    return [*zip(marks, marks[1:])]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of ``pattern`` to any substring of ``text`` and where that ends; None if over ``most``.

    Myers' bit-parallel columns: one big integer holds the vertical differences
    of a whole column, so a character of the text costs a few integer operations.
    """
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = full, 0, m
    best, end = m, 0
    get = masks.get
    for at, c in enumerate(text, 1):
        eq = get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if distance < best:
            best, end = distance, at
    return (best, end) if best <= most else None


class Pieces:
    """The pieces of one length: their hashes, sorted, and where in which items each stands."""

    def __init__(self, found: dict[int, list[tuple[int, int]]]):
        self.keys = np.array(sorted(found), np.uint64)
        self.places = [found[k] for k in self.keys.tolist()]

    def hits(self, keys: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(place in ``keys``, (item, offset) of the piece) of the hashes that are a piece's."""
        own = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        same = np.flatnonzero(self.keys[own] == keys)
        for place, k in zip(same.tolist(), own[same].tolist()):
            yield place, self.places[k]


class Seeds:
    """Which hashes the beginnings, ``length`` long, of some pieces have: a table of their highest bits."""

    def __init__(self, length: int, keys: np.ndarray):
        self.length = length
        bits = max(12, min(24, (16 * len(keys)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[keys >> self.shift] = True

    def places(self, sums: np.ndarray, most: int) -> np.ndarray:
        """Where a piece may begin, of the first ``most`` places."""
        count = min(most, len(sums) - self.length)
        return np.flatnonzero(self.seen[window_keys(sums, self.length, count) >> self.shift]) if count > 0 else np.empty(0, np.int64)


class Matcher:
    """Finds the items of a block in texts, each within its own edit budget.

    A rolling hash over the text finds where the beginning of a piece may stand; there
    the hashes of each length that pieces have are looked up. Pieces of ``SEED``
    characters or more share one beginning length, the least that any of them has;
    shorter pieces, of short items only, are looked for by their whole length.
    """

    SEED = 8

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.items = [(i, p, budget(len(p), rate)) for i, text in items if (p := plain(text))]
        by_length: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        about = {(len(p), most + 1) for _, p, most in self.items}
        least = min((end - start for length, parts in about for start, end in cut(length, parts) if end - start >= self.SEED), default=0)
        begun: dict[int, set[int]] = defaultdict(set)
        for k, (_, p, most) in enumerate(self.items):
            sums = prefix_sums(np.frombuffer(p.encode("utf-32-le"), "<u4"))
            pieces = np.array(cut(len(p), most + 1))
            starts, lengths = pieces[:, 0], pieces[:, 1] - pieces[:, 0]
            keys = keys_at(sums, starts, lengths).tolist()
            for start, length, key in zip(starts.tolist(), lengths.tolist(), keys):
                by_length[length][key].append((k, start))
            for q in {least if n >= self.SEED else n for n in set(lengths.tolist())}:
                mine = starts[lengths >= self.SEED] if q >= self.SEED else starts[lengths == q]
                begun[q].update(keys_at(sums, mine, np.full(len(mine), q)).tolist())
        self.pieces = {length: Pieces(found) for length, found in by_length.items()}
        self.seeds = [(Seeds(q, np.array([*keys], np.uint64)), [n for n in self.pieces if (n >= self.SEED) == (q >= self.SEED) and (n == q or q >= self.SEED)]) for q, keys in begun.items()]

    def found(self, text: str) -> list[tuple[int, int]]:
        """(number of the item, least distance) of the items that the text holds."""
        if not self.items:
            return []
        points, starts = plain_points(text), defaultdict(list)
        longest = max(self.pieces)
        for low in range(0, len(points), _SEGMENT):
            part = points[low : low + _SEGMENT + longest - 1]
            sums = prefix_sums(part)
            for seeds, lengths in self.seeds:
                at = seeds.places(sums, _SEGMENT)
                for length in lengths if len(at) else ():
                    whole = at[at + length <= len(part)]
                    for n, places in self.pieces[length].hits(keys_at(sums, whole, length)):
                        for k, offset in places:
                            starts[k].append(low + int(whole[n]) - offset)
        out = []
        for k, guesses in starts.items():
            _, p, most = self.items[k]
            best = None
            for low, high in windows(sorted(guesses), len(p), most):
                hit = myers(p, spelt(points[max(0, low) : max(0, high)]), most)
                if hit and (best is None or hit[0] < best):
                    best = hit[0]
                if best == 0:
                    break
            if best is not None:
                out.append((k, best))
        return out


def windows(guesses: list[int], length: int, most: int) -> Iterator[tuple[int, int]]:
    """Joined stretches in which an occurrence that begins near a guess must lie."""
    low = high = None
    for g in guesses:
        if high is not None and g - most <= high:
            high = max(high, g + length + most)
            continue
        if high is not None:
            yield low, high
        low, high = g - most, g + length + most
    if high is not None:
        yield low, high


def blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about ``block_chars`` characters, one block at a time.

    Where one block is enough nothing is written; else the items are dealt evenly to
    blocks of a written table, and each is read when it is asked for.
    """
    told = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.col(text_col).isNotNull())
    chars = told.agg(F.sum(F.length("t"))).first()[0] or 0
    if chars <= block_chars:
        yield told.collect()
        return
    n = -(-5 * chars // (4 * block_chars))  # a quarter to spare, as items differ in length
    work = Workspace(items.sparkSession, "benchmark")
    dealt = work.keep(told.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")), "items")
    for block in range(n):
        yield dealt.where(F.col("block") == block).select("id", "t").collect()


def matches(docs: DataFrame, items: DataFrame, rate: float = 0.06, block_chars: int = 24_000_000, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per document and item that it holds: the two ids and the least edit distance.

    Texts are compared in lower case with one space for each run of other than
    letters and digits. An item of m characters is held if a part of the text is
    within ``int(rate * m)`` edits of it. It is cut into one piece more than that,
    so at least one piece stands unchanged in any such part: a pass over the whole
    text finds the pieces by their hashes, Myers' algorithm verifies around them, and
    no match is lost. The index of at most about ``block_chars`` characters of items is
    broadcast, after their sum was checked, and found by one map-only pass over the
    documents, whatever their skew; of more items, block follows block, and neither
    driver nor executors hold two.

    Null texts and items without letters or digits match nothing; repeated rows
    each give their own rows; other columns are not read; ids may be of any type;
    with an empty table on either side the result is empty.
    """
    spark = docs.sparkSession
    prepare(spark)
    kinds = docs.schema[doc_col].dataType, items.schema[item_col].dataType
    schema = f"`{doc_col}` {kinds[0].simpleString()}, `{item_col}` {kinds[1].simpleString()}, distance int"
    picked = docs.select(F.col(doc_col).alias("id"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    work, result, held = Workspace(spark, "decontaminate"), None, None
    for n, block in enumerate(blocks(items, item_col, text_col, block_chars)):
        if held is not None:  # the block before this one: write its rows, let its index go
            part = work.keep(part, f"block-{n}")
            held.unpersist()
            result = part if result is None else result.unionByName(part)
        held = spark.sparkContext.broadcast(Matcher(block, rate))
        part = picked.mapInArrow(_scan(held, to_arrow_type(kinds[1]), [doc_col, item_col, "distance"]), schema)
    return part if result is None else result.unionByName(part)


def _scan(block, kind: pa.DataType, names: list[str]):
    def scan(batches):
        matcher = block.value
        for batch in batches:
            rows, items, distances = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for k, distance in matcher.found(text):
                    rows.append(i)
                    items.append(matcher.items[k][0])
                    distances.append(distance)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(items, kind), pa.array(distances, pa.int32())], names=names)

    return scan


def clean_documents(docs: DataFrame, items: DataFrame, rate: float = 0.06, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns; rows with a null id or text stay if their text holds none."""
    (row,) = fresh(docs, "row_key")
    keyed = docs.withColumn(row, F.struct(F.col(doc_col).alias("id"), F.xxhash64(text_col).alias("h")))
    hits = matches(keyed, items, rate, doc_col=row, item_col=item_col, text_col=text_col).select(row).distinct()
    return keyed.join(hits, keyed[row].eqNullSafe(hits[row]), "left_anti").select(docs.columns)
