"""Near-duplicate classes by Order MinHash and banded alignment."""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.components import components
from folioflow.llm.rolling import UNBASE, mix, plain_table, power, prefix_sums
from folioflow.llm.shared import Workspace, fresh, join_counted, prepare

_SEGMENT = 1 << 20
#: Texts of at most so many shingles get keys of their own that miss no pair of them.
FEW = 14


def words(text: str) -> np.ndarray:
    """64-bit hashes of a text's words: lower-cased runs of letters and digits."""
    found, at = [], 0
    while at < len(text):
        end = min(len(text), at + _SEGMENT)
        while end < len(text) and text[end - 1].isalnum():
            end += 1
        points = plain_table()[np.frombuffer(f" {text[at:end]} ".encode("utf-32-le", "surrogatepass"), "<u4")]
        inside = points != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        first, last = edge[::2], edge[1::2]
        sums = prefix_sums(points)
        spelt = (sums[last] - sums[first]) * power(UNBASE, len(points))[first]
        found.append(mix(spelt + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shingles(text: str, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words in text order; a shorter text with words has one."""
    w = words(text)
    if not len(w):
        return w
    k = min(k, len(w))
    total = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        total = total * np.uint64(0xFF51AFD7ED558CCD) + w[j : len(w) - k + 1 + j]
    return mix(total + np.uint64(k))


def labelled(x: np.ndarray) -> np.ndarray:
    """Each shingle with its occurrence number worked in, so that copies differ."""
    ordered = np.sort(x)
    if not (ordered[1:] == ordered[:-1]).any():
        return mix(x)
    order = np.argsort(x, kind="stable")
    new = np.ones(len(x), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.arange(len(x))
    occurrence = np.empty(len(x), np.uint64)
    occurrence[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return mix(x + occurrence * np.uint64(0xC2B2AE3D27D4EB4F))


class Sketcher:
    """Order MinHash keys: ``bands`` of ``rows`` entries, each the ``picks`` least labelled shingles in text order."""

    def __init__(self, bands: int, rows: int, picks: int, seed: int = 11):
        random = np.random.default_rng(seed)
        self.bands, self.rows, self.picks = bands, rows, picks
        # 32 bits order the shingles of a text; equal values, rare and only near the least few of note, go by place
        self.flip = random.integers(0, 1 << 32, bands * rows, np.uint32)[:, None]
        self.spread = (random.integers(0, 1 << 31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]

    def _least(self, x: np.ndarray) -> np.ndarray:
        """Text places of the least values for each hash function, ascending by place."""
        n, picks = len(x), min(self.picks, len(x))
        if picks == n:
            return np.tile(np.arange(n), (len(self.flip), 1))
        short = (x >> np.uint64(32)).astype(np.uint32)
        if n <= 32:
            return np.sort(np.argpartition((short ^ self.flip) * self.spread, picks - 1, axis=1)[:, :picks], axis=1)
        out = np.empty((len(self.flip), picks), np.int64)
        below = np.uint32(min(1.0, (picks + 9) / n) * ((1 << 32) - 1))
        step = max(1, (1 << 18) // n)
        for at in range(0, len(out), step):
            values = (short ^ self.flip[at : at + step]) * self.spread[at : at + step]
            flat = np.flatnonzero(values <= below)
            row = flat // n
            order = np.argsort((row.astype(np.uint64) << np.uint64(32)) | values.reshape(-1)[flat], kind="stable")
            starts = np.searchsorted(row, np.arange(len(values) + 1))
            take = starts[:-1, None] + np.arange(picks)
            out[at : at + len(values)] = (flat[order] - n * row)[np.minimum(take, len(order) - 1)] if len(order) else 0
            for r in np.flatnonzero(np.diff(starts) < picks):
                out[at + r] = np.argpartition(values[r], picks - 1)[:picks]
        return np.sort(out, axis=1)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """One 64-bit key a band of a text's labelled shingles."""
        places = self._least(x)
        entry = np.zeros(len(places), np.uint64)
        for j in range(places.shape[1]):
            entry = mix(entry * np.uint64(3) + x[places[:, j]])
        entry = entry.reshape(self.bands, self.rows)
        key = np.arange(self.bands, dtype=np.uint64)
        for j in range(self.rows):
            key = mix(key * np.uint64(5) + entry[:, j])
        return key


def few_keys(x: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of a text with few labelled shingles: the whole set, and it without each choice of as many as may stay unmatched.

    Of n shingles at most (1 - similarity) n can be unmatched in a link, so two linked
    texts share the key of what they have in common.
    """
    total, out = x.sum(dtype=np.uint64), []
    for gone in range(int((1 - similarity) * len(x) + 1e-9) + 1):
        picks = np.array([*combinations(range(len(x)), gone)], int).reshape(comb(len(x), gone), gone)
        out.append(total - x[picks].sum(1, dtype=np.uint64))
    return mix(np.concatenate(out) + np.uint64(0xA0761D6478BD642F))


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the best alignment of two shingle sequences keeps ``similarity`` of their union in common.

    With c shingles matched in order, c / (|a| + |b| - c) must reach it. So at most
    a known number may stay unmatched, and an alignment that good never leaves a
    band of that width around the diagonal: the longest common subsequence is
    worked out inside the band only, a row of it in one big integer.
    """
    na, nb = len(a), len(b)
    if not na or not nb:
        return False
    need = int(np.ceil(similarity * (na + nb) / (1 + similarity) - 1e-9))
    if min(na, nb) < need:
        return False
    values, counts = np.unique(np.concatenate([np.unique(labelled(a)), np.unique(labelled(b))]), return_counts=True)
    if int((counts == 2).sum()) < need:
        return False
    n = min(na, nb)
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    left = n - head
    differ = np.flatnonzero(a[na - left :][::-1] != b[nb - left :][::-1]) if left else differ
    tail = int(differ[0]) if len(differ) and left else left
    a, b = a[head : na - tail], b[head : nb - tail]
    common = head + tail
    if common >= need or not len(a) or not len(b):
        return common >= need
    band = na + nb - 2 * need + 1
    return common + banded_lcs(a.tolist(), b.tolist(), band, need - common) >= need


def banded_lcs(a: list[int], b: list[int], band: int, need: int) -> int:
    """Length of the longest common subsequence over matches within ``band`` of the diagonal.

    Bit-parallel: a cleared bit of ``row`` says that the length grows at that place
    of ``a``. The window of ``a`` slides along with ``b``; places that leave it can't
    change any more and are counted. Ends early where ``need`` is out of reach.
    """
    where: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)
    low, high, total = 0, min(len(a), band + 1), 0
    row = (1 << high) - 1
    for j, x in enumerate(b):
        start, end = max(0, j - band), min(len(a), j + band + 1)
        if end > high:
            row |= ((1 << (end - high)) - 1) << (high - low)
            high = end
        if start > low:
            gone = start - low
            total += gone - (row & ((1 << gone) - 1)).bit_count()
            row >>= gone
            low = start
        if low >= high:
            break
        full = (1 << (high - low)) - 1
        mask = 0
        for i in where.get(x, ()):
            if low <= i < high:
                mask |= 1 << (i - low)
        if mask:
            both = row & mask
            row = ((row + both) | (row - both)) & full
        if not j & 63 and total + (high - low) - row.bit_count() + len(b) - 1 - j < need:
            return 0
    return total + (high - low) - row.bit_count()


def _sketch(docs: DataFrame, k: int, similarity: float, sketcher: Sketcher) -> DataFrame:
    """(id, h, sig, keys): the row's key, a 128-bit digest of its shingles and its keys."""

    def sketch(batches):
        for batch in batches:
            sigs, keys = [], []
            for text in batch.column(2).to_pylist():
                x = shingles(text or "", k)
                if len(x):
                    sigs.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                    own = labelled(x)
                    found = sketcher.keys(own)
                    if len(x) <= FEW:
                        found = np.concatenate([found, few_keys(own, similarity)])
                    keys.append(found.view(np.int64))
                else:  # no words: equal texts only
                    sigs.append(hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16, key=b"no words").digest())
                    keys.append(np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "h", "sig", "keys"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "h", "t").mapInArrow(sketch, f"id {kind}, h long, sig binary, keys array<long>")


class Links:
    """Joins the members of one bucket, or of one block of a large bucket, that align."""

    def __init__(self, k: int, similarity: float):
        self.k, self.similarity = k, similarity

    def pairs(self, sigs: list[bytes], texts: list[str], classes: list) -> list[tuple[int, int]]:
        """Links enough to join what alignments join; members of one class count as joined.

        How many labelled shingles two members share bounds what an alignment can
        keep. The counts of all members come from one matrix product over the
        shingles that at least two of them have; only pairs at or over the bound, and
        not joined yet, are aligned.
        """
        found, top = [], {c: c for c in range(len(sigs))}

        def root(i: int) -> int:
            while top[i] != i:
                top[i] = i = top[top[i]]
            return i

        first: dict = {}
        for i, c in enumerate(classes):
            top[root(i)] = root(first.setdefault(c, i))
        x = [shingles(t, self.k) for t in texts]
        if len(x) == 2:
            tries = [(0, 1)]
        else:
            sizes = np.array([len(v) for v in x])
            need = np.ceil(self.similarity * (sizes[:, None] + sizes) / (1 + self.similarity) - 1e-9)
            one, other = np.nonzero(np.triu(self._shared(x) >= need, 1))
            tries = zip(one.tolist(), other.tolist())
        for i, j in tries:
            if root(i) != root(j) and aligned(x[i], x[j], self.similarity):
                top[root(i)] = root(j)
                found.append((i, j))
        return found

    @staticmethod
    def _shared(x: list[np.ndarray]) -> np.ndarray:
        n = len(x)
        owner = np.repeat(np.arange(n), [len(v) for v in x])
        _, column, times = np.unique(np.concatenate([labelled(v) for v in x]), return_inverse=True, return_counts=True)
        often = np.flatnonzero(times > 1)
        place = np.full(len(times), -1)
        place[often] = np.arange(len(often))
        column = place[column]
        owner, column = owner[column >= 0], column[column >= 0]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        total = np.zeros((n, n), np.float32)
        width = max(64, (1 << 22) // max(n, 1))
        for low in range(0, len(often), width):
            a, b = np.searchsorted(column, [low, low + width])
            part = np.zeros((n, min(width, len(often) - low)), np.float32)
            part[owner[a:b], column[a:b] - low] = 1
            total += part @ part.T
        return total


def _joined(members: DataFrame, k: int, similarity: float) -> DataFrame:
    """(a, b) links inside each (key, block) of ``members``, which stand together in the partitions."""

    def link(batches):
        links = Links(k, similarity)
        group, rows = None, []

        def close():
            if len(rows) < 2:
                return None
            sigs, classes, texts = zip(*rows)
            return [(sigs[i], sigs[j]) for i, j in links.pairs(sigs, texts, classes)]

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], names=["a", "b"])

        for batch in batches:
            for key, block, v, c, t in zip(*(column.to_pylist() for column in batch.columns)):
                if (key, block) != group:
                    if found := close():
                        yield out(found)
                    group, rows = (key, block), []
                rows.append((v, c, t))
        if found := close():
            yield out(found)

    dealt = members.repartition("key", "block").sortWithinPartitions("key", "block", "v")
    return dealt.select("key", "block", "v", "c", "t").mapInArrow(link, "a binary, b binary")


def classes(docs: DataFrame, k: int = 5, similarity: float = 0.8, bands: int = 23, rows: int = 2, picks: int = 3, block_rows: int = 4096, block_chars: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, class_id, keep) for each row: h is xxhash64 of the text; keep marks one row key of each class.

    Two texts are linked where the best alignment of their ``k``-word shingle
    sequences keeps at least ``similarity`` of the union in common; classes are the
    connected components, and class_id is the least id in the class. Words are
    lower-cased runs of letters and digits. Texts with the same shingles are one
    vertex from the start, however many rows they have.

    Candidates share a band of Order MinHash entries; texts of at most 14 shingles also
    have keys that miss no link between them. A bucket is looked at in one
    task if it has at most about ``block_rows`` members and ``block_chars`` characters.
    A larger one is dealt to blocks, each with the bucket's most popular member, whose
    star joins most of them; where members of different blocks are still apart, pairs
    of blocks are looked at too. So every candidate link between classes is tested
    whatever the size of the bucket, no task grows with it, and no pairs are written
    but links. Buckets with the same members are looked at once.

    Null and empty texts, and others without words, are alike only if equal (null
    counts as empty). A null id is a value like any other. Rows that repeat both id
    and text share their row key. Extra columns are not read. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    work = Workspace(spark, "near-dedup")
    rows_in = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    sketch = work.keep(_sketch(rows_in, k, similarity, Sketcher(bands, rows, picks)), "sketch")
    vertices = sketch.groupBy("sig").agg(F.min(F.struct("id", "h")).alias("first"), F.first("keys").alias("keys"), F.count("*").alias("copies"))
    vertices = work.keep(vertices, "vertices")

    entries = vertices.select(F.explode("keys").alias("key"), F.col("sig").alias("v"))
    mark = F.xxhash64("v")
    shared = entries.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.sum(mark.bitwiseAND(F.lit((1 << 31) - 1))).alias("s")).where("n > 1")
    shared = work.keep(shared.groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key", "n", F.col("n").alias("members")), "shared")
    bucketed = work.keep(join_counted(entries, shared, ["key"]).withColumnRenamed("members", "n"), "buckets")
    wanted = bucketed.select(F.col("v").alias("sig")).distinct().join(vertices.select("sig", "first"), "sig").select("sig", F.col("first.id").alias("id"), F.col("first.h").alias("h"))
    r = rows_in.alias("r")
    matched = r.join(wanted.alias("w").hint("shuffle_hash"), (F.col("w.h") == F.col("r.h")) & F.col("w.id").eqNullSafe(F.col("r.id")))
    texts = work.keep(matched.groupBy("w.sig").agg(F.first("r.t").alias("t")).withColumnRenamed("sig", "v"), "texts")
    chars = texts.select("v", F.length("t").alias("chars"))

    weighed = bucketed.join(chars, "v").groupBy("key").agg(F.sum("chars").alias("chars"), F.count("*").alias("n"))
    large = weighed.select("key", F.ceil(F.greatest(F.col("n") / block_rows, F.col("chars") / block_chars)).cast("int").alias("blocks")).where("blocks > 1")
    large = work.keep(large, "large")
    split = not large.isEmpty()
    if split:
        placed = bucketed.join(large, "key", "left").withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("v"), F.col("blocks"))).otherwise(0).cast("int"))
        popular = bucketed.groupBy("v").agg(F.sum("n").alias("p"))
        centre = bucketed.join(large, "key").join(popular, "v").groupBy("key", "blocks").agg(F.max_by("v", F.struct("p", "v")).alias("v"))
        guests = centre.select("key", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        placed = placed.select("key", "v", "block").union(guests).distinct()
    else:
        placed = bucketed.select("key", "v", F.lit(0).alias("block"))
    edges = work.keep(_joined(placed.withColumn("c", F.col("v")).join(texts, "v"), k, similarity), "edges")
    roots = components(edges, work, "stars")
    if split:
        state = bucketed.join(large, "key").join(roots, "v", "left").withColumn("c", F.coalesce("root", "v"))
        apart = state.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
        state = state.join(apart, "key").withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
        state = state.select("key", "v", "c", "own", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("own <> other")
        state = state.select("key", "v", "c", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("block"))
        more = work.keep(_joined(state.join(texts, "v"), k, similarity), "more-edges")
        edges = edges.union(more)
        roots = components(edges, work, "more-stars")
    work.drop("texts", "buckets", "large")

    named = vertices.select("sig", "first", F.col("copies").alias("n")).join(roots.select(F.col("v").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    firsts = work.keep(named.groupBy("root").agg(F.min("first").alias("class_first"), F.count("*").alias("n")), "firsts")
    named = work.keep(join_counted(named, firsts, ["root"]).select("sig", "class_first", "n"), "named")
    out = join_counted(sketch.select("id", "h", "sig"), named, ["sig"])
    return out.select(F.col("id").alias(id_col), "h", F.col("class_first.id").alias("class_id"), F.struct("id", "h").eqNullSafe(F.col("class_first")).alias("keep"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without near copies: of each class the row with the least id (then least text hash).

    Of rows that repeat both id and text one stays. Nulls are ids like any other.
    """
    found = classes(docs, id_col=id_col, text_col=text_col, **options)
    own, other, copies, row = fresh(docs, "kept_id", "kept_h", "kept_copies", "row_h")
    kept = found.where("keep").groupBy(F.col(id_col).alias(own), F.col("h").alias(other)).agg(F.count("*").alias("n"))
    kept = Workspace(docs.sparkSession, "one-of-each").keep(kept.select(F.struct(own, other).alias(row), "n", F.col("n").alias(copies)), "kept")
    # a struct of a null id equals its like
    keyed = docs.withColumn(row, F.struct(F.col(id_col).alias(own), F.xxhash64(text_col).alias(other)))
    left = join_counted(keyed, kept, [row])
    if kept.where(F.col(copies) > 1).isEmpty():
        return left.select(docs.columns)
    once, more = left.where(F.col(copies) == 1), left.where(F.col(copies) > 1).dropDuplicates([row])
    return once.unionByName(more).select(docs.columns)
