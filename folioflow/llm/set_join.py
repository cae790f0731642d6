"""Documents joined by the Jaccard similarity of their word shingles, over parity sketches."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.components import components
from folioflow.llm.rolling import UNBASE, mix, power, prefix_sums
from folioflow.llm.shared import Workspace, join_counted, prepare

_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SEGMENT = 1 << 20
#: Up to so many rows of 8 bytes go by broadcast; more are shuffled.
SMALL = 500_000


def words(text: bytes) -> np.ndarray:
    """64-bit hashes of the runs of anything but blanks, A-Z as a-z, of a text in UTF-8."""
    found, at = [], 0
    while at < len(text):
        end = min(len(text), at + _SEGMENT)
        while end < len(text) and not _BLANK[text[end - 1]]:
            end += 1
        signs = np.frombuffer(text, np.uint8, end - at, at)
        inside = np.concatenate([[False], ~_BLANK[signs], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edge[::2], edge[1::2]
        sums = prefix_sums(_LOWER[signs])
        spelt = (sums[last] - sums[first]) * power(UNBASE, len(sums))[first]
        found.append(mix(spelt + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Hashes of the distinct runs of ``k`` words, ascending; fewer words are one run, none give an empty set."""
    w = words(text or b"")
    if not len(w):
        return w
    k = min(k, len(w))
    total = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        total = total * np.uint64(0xFF51AFD7ED558CCD) + w[j : len(w) - k + 1 + j]
    return np.unique(mix(total + np.uint64(k)))


class Sketcher:
    """Parity sketches of sets by size bands, for links of at least ``percent`` of the union in common.

    A shingle hashes to one block and one bit of it, and flips that bit. Shingles that two
    sets share flip the same bits of both, so the sketches differ in at most as many bits as
    there are shingles in one set only: Hamming distance bounds the symmetric difference
    from below. Of sizes a and b, linked sets have at most (100 - percent) (a + b) /
    (100 + percent) such shingles. A band of sizes cuts its sketches into more blocks than
    the most that can differ, so linked sets have equal blocks (pigeonholes).

    A block has 2 ** 64 bits in thought. It is held in two ways that XOR alike: as the XOR
    of 64-bit hashes of its odd bits, which tells whether blocks are equal, and folded
    to 16 bits, which still bounds the difference. Blocks without an odd bit are equal
    in many sets; there are some blocks to spare so that two linked sets have others in common,
    and sets with too many such blocks are found by these too.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(max(self.lows[-1] + 1, self.lows[-1] * 7 // 5))

    def most(self, a: int, b: int) -> int:
        """How many shingles linked sets of these sizes can have apart."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def blocks(self, band: int) -> int:
        """How many blocks a band's sketches have; 0 where only equal sets can be linked."""
        apart = self.most(self.lows[band + 1] - 1, self.lows[band + 1] - 1)
        return apart + 2 + (apart + 1) // 8 if apart else 0

    def bands(self, size: int) -> list[int]:
        """The band of a set's size, and those above in which it can have links."""
        own = int(np.searchsorted(self.lows, size, "right")) - 1
        return [b for b in range(own, min(own + 3, len(self.lows) - 1)) if (b == own or self.percent * self.lows[b] <= 100 * size) and self.blocks(b)]

    def sketch(self, x: np.ndarray, band: int) -> tuple[np.ndarray, bytes]:
        """The keys of a set's blocks, with the band in their low byte, and its folded sketch."""
        count = self.blocks(band)
        h = mix(x + np.uint64(0xA24BAED4963EE407))
        block = ((h >> np.uint64(32)) % np.uint64(count)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        held, start = np.unique(block[order], return_index=True)
        marks, folded = np.zeros(count, np.uint64), np.zeros(-(-count // 4) * 4, np.uint16)
        marks[held] = np.bitwise_xor.reduceat(mix(h + np.uint64(0x9FB21C651E98DF25))[order], start)
        folded[held] = np.bitwise_xor.reduceat((np.uint16(1) << (h & np.uint64(15)).astype(np.uint16))[order], start)
        empty = marks == 0
        kept = np.arange(count) if empty.sum() >= count - self.most(self.lows[band + 1] - 1, self.lows[band + 1] - 1) else np.flatnonzero(~empty)
        keys = mix(marks[kept] + mix(kept.astype(np.uint64) + (np.uint64(band + 1) << np.uint64(32))))
        return keys & np.uint64(0xFFFFFFFFFFFFFF00) | np.uint64(band), folded.tobytes()

    def linked(self, x: np.ndarray, y: np.ndarray) -> bool:
        """Whether two sets of distinct ascending values are linked."""
        if 100 * min(len(x), len(y)) < self.percent * max(len(x), len(y)):
            return False
        both = np.sort(np.concatenate([x, y]))
        common = int((both[1:] == both[:-1]).sum())
        return 100 * common >= self.percent * (len(both) - common)


def _sketched(rows: DataFrame, k: int, sketcher: Sketcher) -> DataFrame:
    """(id, h, h2, n, sig, keys, bands, bits): keys of the text, size and 128-bit digest of its set, null where it is empty, and its sketches."""

    def sketch(batches):
        for batch in batches:
            sizes, sigs, keys, bands, bits = [], [], [], [], []
            for text in batch.column(3).to_pylist():
                x = shingle_set(text, k)
                own = sketcher.bands(len(x)) if len(x) else []
                made = [sketcher.sketch(x, b) for b in own]
                sizes.append(len(x))
                sigs.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                keys.append(np.concatenate([m[0] for m in made]).view(np.int64) if made else np.empty(0, np.int64))
                bands.append(own)
                bits.append([m[1] for m in made])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int32())), pa.array(bits, pa.list_(pa.binary()))],
                names=["id", "h", "h2", "n", "sig", "keys", "bands", "bits"],
            )

    return rows.mapInArrow(sketch, f"id {rows.schema['id'].dataType.simpleString()}, h long, h2 long, n long, sig binary, keys array<long>, bands array<int>, bits array<binary>")


def _passing(pairs: DataFrame, held: DataFrame, test, work: Workspace, name: str, most: int = 512) -> DataFrame:
    """The (v, c) of ``pairs`` whose rows of ``held`` (v, then what ``test`` takes) pass; written.

    ``test(columns)`` turns a row's columns into what is kept of it, and returns it with a function of two of
    these. A centre with more than ``most`` partners is copied for each so many of
    them, so the task of a (c, part) holds one centre and streams its partners.
    """
    counts = work.keep(pairs.groupBy("c").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / most).cast("int")), f"{name}-counts")
    columns = held.columns[1:]
    guests = join_counted(pairs, counts, ["c"]).join(held, "v").select("c", F.pmod(F.xxhash64("v"), "parts").cast("int").alias("part"), "v", *columns)
    hosts = counts.join(held.withColumnRenamed("v", "c"), "c").select("c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("v"), *columns)
    load, passes = test

    def compare(batches):
        now, centre = None, None
        for batch in batches:
            out = []
            for c, part, v, *own in zip(*(column.to_pylist() for column in batch.columns)):
                if v is None:
                    now, centre = (c, part), load(*own)
                elif (c, part) == now and passes(centre, load(*own)):
                    out.append((v, c))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["v", "c"])

    dealt = guests.unionByName(hosts).repartition("c", "part").sortWithinPartitions("c", "part", F.col("v").asc_nulls_first())
    found = work.keep(dealt.mapInArrow(compare, "v long, c long"), name)
    work.drop(f"{name}-counts")
    return found


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(v, t): a text for each row (v, h, h2) of ``wanted``; copies of a text meet once a task before they are shuffled."""
    if wanted.count() <= SMALL:
        rows = rows.join(F.broadcast(wanted.select("h").distinct()), "h", "left_semi")
    return rows.groupBy("h", "h2").agg(F.first("t").alias("t")).join(wanted, ["h", "h2"]).select("v", "t")


def _near(sizes: np.ndarray, bits: list[bytes], roots: list, sides: list, sketcher: Sketcher):
    """For each member the places of later ones whose sketches allow a link and that are of another root (and side, if there are two)."""
    sketch = np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)
    number: dict = {}
    root = np.array([number.setdefault(r, len(number)) for r in roots])
    side, cross = np.array(sides), len(set(sides)) > 1
    for i in range(len(bits) - 1):
        later = root[i + 1 :] != root[i]
        if cross:
            later &= side[i + 1 :] != side[i]
        later &= 100 * np.minimum(sizes[i + 1 :], sizes[i]) >= sketcher.percent * np.maximum(sizes[i + 1 :], sizes[i])
        at = np.flatnonzero(later) + i + 1
        if len(at):
            apart = np.bitwise_count(sketch[at] ^ sketch[i]).sum(1, dtype=np.int64)
            yield i, at[(100 + sketcher.percent) * apart <= (100 - sketcher.percent) * (sizes[at] + sizes[i])]


def _grouped(dealt: DataFrame, schema: str, look) -> DataFrame:
    """``look(key, part, columns)`` of each (key, part) of ``dealt``, as rows of ``schema``."""

    def run(batches):
        now, held = None, []

        def close():
            return look(*now, [*zip(*held)]) if len(held) > 1 else []

        def out(found):
            return pa.RecordBatch.from_pylist([dict(zip(names, f)) for f in found], schema=kinds)

        kinds = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32()}[c.split()[1]]) for c in schema.split(", ")])
        names = kinds.names
        for batch in batches:
            for key, part, *own in zip(*(column.to_pylist() for column in batch.columns)):
                if (key, part) != now:
                    if found := close():
                        yield out(found)
                    now, held = (key, part), []
                held.append(own)
        if found := close():
            yield out(found)

    return dealt.repartition("key", "part").sortWithinPartitions("key", "part", "v").mapInArrow(run, schema)


def linked_sets(docs: DataFrame, k: int = 4, percent: int = 85, block_rows: int = 2048, block_shingles: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row: the size of its set and the least id that links reach.

    A set holds the distinct runs of ``k`` words of a text; words are what stands between
    blanks, with A-Z as a-z. A text of fewer words has them all as one run, and a text that is null
    or has no word has an empty set, which is linked with nothing. Two sets are linked where
    100 * intersection >= ``percent`` * union. Shingles are compared by 64-bit hashes.

    Rows of equal sets are one vertex from the start. Vertices that share a block of their
    parity sketches (``Sketcher``) are candidates, and no link is missed by that. Candidates are
    looked at in two steps. First every member of a block's bucket is held against the
    one that shares most with others: folded sketches decide which pairs need
    their texts, and the sets of these are compared. Then buckets whose other members
    are still in several components come to tasks with all members' folded sketches; only members
    with a partner that is near and apart come again with their texts. A bucket of more than
    ``block_rows`` members or ``block_shingles`` shingles is dealt to blocks, and each pair of
    blocks is a task. So no pairs are written but one for each member and centre, and links.

    Frequent keys, digests and components are broadcast by a bounded number of them, their rows stay
    where they are. A null id is larger than any other. Rows that repeat an id are documents
    of their own. Extra columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    work, sketcher = Workspace(spark, "set-join"), Sketcher(percent)
    texts_in = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.xxhash64(F.lit(7), F.col(text_col)).alias("h2"), F.col(text_col).cast("binary").alias("t"))
    rows = work.keep(_sketched(texts_in, k, sketcher), "rows")
    sets = rows.where("sig is not null").groupBy("sig").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("size"), F.first(F.struct("h", "h2", "keys", "bands", "bits")).alias("s"))
    vertices = work.keep(sets.select(F.monotonically_increasing_id().alias("v"), "sig", "least", "copies", "size", "s.*"), "vertices")

    entries = vertices.select(F.explode("keys").alias("key"), "v")
    shared = work.keep(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("members", F.col("n")), "shared")
    buckets = work.keep(join_counted(entries, shared, ["key"]), "buckets")
    popular = buckets.groupBy("v").agg(F.sum("members").alias("p"))
    centres = work.keep(buckets.join(popular, "v").groupBy("key").agg(F.max_by("v", F.struct("p", "v")).alias("c"), F.count("*").alias("n")), "centres")
    pairs = work.keep(join_counted(buckets, centres, ["key"]).where("v <> c").select("v", "c").distinct(), "pairs")
    work.drop("shared")

    def sketch_of(size, bands, bits):
        return size, dict(zip(bands, bits))

    def sketches_allow(one, other):
        a, b = one[0], other[0]
        band = next((b for b in one[1] if b in other[1]), None)
        if band is None or 100 * min(a, b) < percent * max(a, b):
            return False
        apart = np.bitwise_count(np.frombuffer(one[1][band], np.uint64) ^ np.frombuffer(other[1][band], np.uint64)).sum(dtype=np.int64)
        return int(apart) <= sketcher.most(a, b)

    close = _passing(pairs, vertices.select("v", "size", "bands", "bits"), (sketch_of, sketches_allow), work, "close")
    in_pairs = lambda df: df.select("v").union(df.select(F.col("c").alias("v"))).distinct()
    wanted = work.keep(in_pairs(close).join(vertices.select("v", "h", "h2"), "v"), "wanted")
    texts = work.keep(_texts(texts_in, wanted), "texts")
    edges = _passing(close, texts, (lambda t: shingle_set(t, k), sketcher.linked), work, "edges").select(F.col("v").alias("a"), F.col("c").alias("b"))
    roots = components(edges, work, "stars")
    work.drop("pairs", "close", "wanted", "texts")

    # buckets with members other than the centre that are in several components; those of the same members once
    mark = F.xxhash64("v")
    rest = join_counted(buckets.where("members > 2"), centres, ["key"]).where("v <> c").select("key", "v").join(roots, "v", "left")
    rest = work.keep(rest.join(vertices.select("v", "size"), "v").select("key", "v", "size", F.coalesce("root", "v").alias("root")), "rest")
    apart = rest.groupBy("key").agg(
        F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("root").alias("low"), F.max("root").alias("high"), F.bit_xor(mark).alias("x"), F.sum(mark.bitwiseAND(F.lit((1 << 31) - 1))).alias("s")
    ).where("low <> high")
    apart = apart.groupBy("n", "x", "s").agg(F.min("key").alias("key"), F.max("shingles").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("n") / block_rows, F.col("shingles") / block_shingles)).cast("int").alias("blocks")
    apart = work.keep(apart.select("key", "n", blocks), "apart")
    if not apart.isEmpty():
        more = _within(join_counted(rest, apart, ["key"]), vertices, texts_in, k, sketcher, work)
        roots = components(edges.union(more), work, "more-stars")
    work.drop("buckets", "centres", "rest", "apart")

    named = vertices.join(roots, "v", "left").select("sig", "least", "copies", F.coalesce("root", "v").alias("root"))
    firsts = work.keep(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "firsts")
    named = work.keep(join_counted(named, firsts, ["root"]).select("sig", "component_id", F.col("copies").alias("n")), "named")
    plain = rows.select("id", F.col("n").alias("n_shingles"), "sig")
    found = join_counted(plain.where("sig is not null"), named, ["sig"]).select("id", "n_shingles", "component_id")
    out = found.union(plain.where("sig is null").select("id", "n_shingles", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id")


def _within(members: DataFrame, vertices: DataFrame, texts_in: DataFrame, k: int, sketcher: Sketcher, work: Workspace) -> DataFrame:
    """(a, b) links between different roots inside the buckets of ``members`` (key, v, size, root, blocks); written."""
    own = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
    dealt = members.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.least("side", "other") * F.col("blocks") + F.greatest("side", "other")
    sketch = F.element_at("bits", F.array_position("bands", F.col("key").bitwiseAND(F.lit(255)).cast("int")).cast("int"))
    dealt = dealt.join(vertices.select("v", "bands", "bits"), "v").select("key", part.alias("part"), "v", "root", "size", "side", sketch.alias("bits"))

    def near(key, part, columns):
        v, root, size, side, bits = columns
        hit = set()
        for i, others in _near(np.array(size), bits, root, side, sketcher):
            if len(others):
                hit.add(i)
                hit.update(others.tolist())
        return [(key, part, v[i]) for i in sorted(hit)]

    met = work.keep(_grouped(dealt, "key long, part int, v long", near), "met")
    wanted = work.keep(met.select("v").distinct().join(vertices.select("v", "h", "h2"), "v"), "met-wanted")
    texts = work.keep(_texts(texts_in, wanted), "met-texts")

    def link(key, part, columns):
        v, root, size, side, bits, text = columns
        sets = [shingle_set(t, k) for t in text]
        top = {r: r for r in root}

        def upmost(r):
            while top[r] != r:
                top[r] = r = top[top[r]]
            return r

        found = []
        for i, others in _near(np.array(size), bits, root, side, sketcher):
            for j in others.tolist():
                one, other = upmost(root[i]), upmost(root[j])
                if one != other and sketcher.linked(sets[i], sets[j]):
                    top[one] = other
                    found.append((v[i], v[j]))
        return found

    again = dealt.join(met, ["key", "part", "v"]).join(texts, "v").select("key", "part", "v", "root", "size", "side", "bits", "t")
    links = work.keep(_grouped(again, "a long, b long", link), "met-links")
    work.drop("met-wanted", "met-texts")
    return links
