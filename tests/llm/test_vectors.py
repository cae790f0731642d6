"""Codes and clusters of vectors against plain versions in Python's whole numbers."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioflow.llm import centroids, vector_codes
from folioflow.llm.quantised import LIMIT
from folioflow.llm.queries import ORACLES, QUERIES
from tests.parity import compare, connection

SCHEMA = "vec_id long, embedding array<float>, label int, id int, v string, n int, code int, cluster int"


def rows_of(vectors, labels=None):
    return [(i, v, labels[k] if labels else k % 3, 7, "v", 1, 2, 3) for k, (i, v) in enumerate(vectors)]


def odd_vectors(d):
    random = np.random.default_rng(d)
    grid = [[float(x) for x in random.integers(-3, 4, d) / 256] for _ in range(60)]  # close together: many equal distances
    sound = [(k, v) for k, v in enumerate(grid)] + [(7, grid[9]), (7, grid[2]), (None, grid[3]), (-5, [-0.001] * d), *((1000 + k, grid[5]) for k in range(90))]
    broken = [(500, None), (501, [None, *grid[0][1:]]), (502, [math.nan, *grid[0][1:]]), (503, [math.inf, *grid[0][1:]]), (504, [-math.inf, *grid[0][1:]])]
    return sound, broken


def plain_nearest(x, centres):
    return min(((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centres)))


def floored(rows):
    return [sum(column) // len(rows) for column in zip(*rows)]


def plain_whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, plain_whole(v), label) for i, v, label in rows]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    d = len(kept[0][1]) // parts
    cut = lambda v: [v[p * d : p * d + d] for p in range(parts)]
    books = [[cut(r[1])[p] for r in first] for p in range(parts)]
    for n in range(rounds + 1):
        own = [[plain_nearest(x, books[p]) for p, x in enumerate(cut(r[1]))] for r in kept]
        for p in range(parts) if n < rounds else ():
            held = defaultdict(list)
            for r, o in zip(kept, own):
                held[o[p][1]].append(cut(r[1])[p])
            books[p] = [floored(held[e]) if held[e] else c for e, c in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    by_label = Counter()
    for r, o in zip(kept, own):
        by_label[r[2]] += sum(far for far, _ in o)
    return Counter((r[0], "".join(f"{e:02x}" for _, e in o), sum(far for far, _ in o), by_label[r[2]], sha) for r, o in zip(kept, own))


@pytest.mark.parametrize("entries, d", [(64, 16), (8, 32)])
def test_codes_are_those_of_a_plain_version(spark, entries, d):
    sound, broken = odd_vectors(d)
    labels = [None if k % 4 == 0 else k % 3 for k in range(len(sound) + len(broken))]
    rows = rows_of(sound + broken, labels)
    other_lengths = [(900, [0.1] * (d + 1), 1, 7, "v", 1, 2, 3), (901, [], 1, 7, "v", 1, 2, 3)]
    got = vector_codes.coded(spark.createDataFrame(rows + other_lengths, SCHEMA), parts=16, entries=entries)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == plain_codes([r[:3] for r in rows[: len(sound)]], 16, entries, 2)


def test_screening_loses_no_entry_whatever_the_size_of_components():
    random = np.random.default_rng(3)
    for top in (2, 300, 1 << 13, 1 << 20, LIMIT - 1):
        for d in (1, 4, 17):
            x, c = random.integers(-top, top + 1, (200, d)), random.integers(-top, top + 1, (40, d))
            c[7], c[30] = c[3], x[0] + 1 if top < LIMIT - 1 else c[3]
            c[31:] = x[1] + random.integers(0, 2, (9, d)) * (top < LIMIT - 1)  # entries that single precision can't tell apart
            own, far = vector_codes.screened(x, c)
            exact = ((x[:, None].astype(object) - c.astype(object)) ** 2).sum(2)
            assert own.tolist() == exact.argmin(1).tolist() and far.tolist() == exact.min(1).tolist()


def plain_clusters(rows, k, rounds):
    kept = [(i, plain_whole(v)) for i, v in rows]
    order = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centres = [r[1] for r in sorted(kept, key=order)[:k]]
    for n in range(rounds + 1):
        own = [plain_nearest(v, centres) for _, v in kept]
        if n < rounds:
            held = defaultdict(list)
            for (_, v), (_, c) in zip(kept, own):
                held[c].append(v)
            centres = [floored(held[c]) if held[c] else old for c, old in enumerate(centres)]
    inertia = Counter()
    for far, c in own:
        inertia[c] += far
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, c, far, inertia[c], sum(inertia.values()), sha[c]) for (i, _), (far, c) in zip(kept, own))


@pytest.mark.parametrize("k", [40, 5, 1000])
def test_clusters_are_those_of_a_plain_version(spark, k):
    sound, broken = odd_vectors(64)
    rows = rows_of(sound + broken) + [(900, [0.1] * 63, 1, 7, "v", 1, 2, 3), (901, [], 1, 7, "v", 1, 2, 3)]
    got = centroids.clusters(spark.createDataFrame(rows, SCHEMA), k=k)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, got.collect())) == plain_clusters(sound, k, 5)


def test_nearest_centres_are_exact_beyond_doubles():
    random = np.random.default_rng(8)
    x, c = random.integers(-LIMIT + 1, LIMIT, (50, 64)), random.integers(-LIMIT + 1, LIMIT, (9, 64))
    c[5] = x[3]
    own, far = centroids.nearest(x, c)
    exact = ((x[:, None].astype(object) - c.astype(object)) ** 2).sum(2)
    assert own.tolist() == exact.argmin(1).tolist() and far.tolist() == exact.min(1).tolist()


def test_no_vectors_and_components_out_of_range(spark):
    none = spark.createDataFrame([(1, None, 1, 7, "v", 1, 2, 3)], SCHEMA)
    for made in (vector_codes.coded, centroids.clusters):
        assert made(none).collect() == [] and made(none.limit(0)).collect() == []
        with pytest.raises(Exception, match="or more in size"):
            made(spark.createDataFrame(rows_of([(1, [1e30] * 64)]), SCHEMA)).collect()
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.coded(spark.createDataFrame(rows_of([(1, [0.5] * 10)]), SCHEMA))


@pytest.mark.parametrize("name", ["op2_warc", "op11_vector_codes", "op13_centroids"])
def test_queries_agree_with_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    compare(QUERIES[name](spark, sf), connection(sf), ORACLES[name])
