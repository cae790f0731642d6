"""The parity-sketch join against all pairs of plain sets."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from folioflow.llm import set_join
from folioflow.llm.queries import ORACLES, QUERIES
from tests.parity import compare, connection

SCHEMA = "doc_id long, text string, v int, key int, n int, sig string, component_id int, size int"


def plain_set(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain_join(rows, percent=85):
    sets = [plain_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                top[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows))


def edited(words, random, edits):
    words = list(words)
    for _ in range(edits):
        at = random.randrange(len(words))
        words[at : at + 1] = random.choice([[], ["new%d" % random.randrange(10**6)], [words[at], "more"]])
    return words


def texts(seed, bases=12, copies=12):
    r = random.Random(seed)
    vocabulary = [f"w{k}é" for k in range(300)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    out = []
    for b in range(bases):
        base = [r.choice(vocabulary) for _ in range(r.choice([5, 9, 12, 30, 80, 200, 700]))]
        if b % 3 == 0:
            base += passage
        for c in range(copies):
            out.append(" ".join(edited(base, r, r.randrange(1 + max(1, len(base) // 25)))))
            if c % 4 == 0:
                out.append("  " + out[-1].upper().replace("É", "é") + "\n")
    out += [None, "", " \t\n", "one", "ONE", "two words", "a b c d", "a b", "x " * 500, "x " * 800, "a b c d", "a b c d e"]
    return out


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"block_rows": 5}), (3, {"block_shingles": 500})])
def test_components_are_those_of_all_pairs(spark, seed, options):
    rows = [*enumerate(texts(seed))]
    random.Random(seed).shuffle(rows)
    rows += [rows[3], rows[3], (rows[4][0], rows[5][1]), (None, rows[6][1]), (None, "alone in the world here"), (None, None)]
    got = set_join.linked_sets(spark.createDataFrame([(d, t, 1, 2, 3, "s", 4, 5) for d, t in rows], SCHEMA), **options)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, got.collect())) == plain_join(rows)


def test_copies_apart_from_each_other_meet_in_their_base_and_chains_are_followed(spark):
    """A star whose leaves are linked only to its centre, in a bucket that they all share, and a chain of links."""
    r = random.Random(5)
    base = [f"b{k}" for k in range(200)]
    leaf = lambda k: [*base[: 4 * k % 170], *(f"leaf{k}-{j}" for j in range(12)), *base[4 * k % 170 :]]
    rows = [(k, " ".join(leaf(k))) for k in range(40)] + [(100, " ".join(base))]
    chain = [f"c{k}" for k in range(150)]
    for k in range(25):
        rows.append((200 + k, " ".join(chain)))
        chain = chain[8:] + [f"c{k}-{j}" for j in range(8)]
    r.shuffle(rows)
    want = plain_join(rows)
    for options in ({}, {"block_rows": 4}):
        got = Counter(map(tuple, set_join.linked_sets(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()))
        assert got == want
    assert {c for d, _, c in want if d < 150} == {0} and {c for d, _, c in want if d >= 200} == {200}


def test_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert set_join.linked_sets(none).collect() == []
    empty = spark.createDataFrame([(3, None), (4, "")], "doc_id long, text string")
    assert sorted(map(tuple, set_join.linked_sets(empty).collect())) == [(3, 0, 3), (4, 0, 4)]


def test_linked_sets_share_a_block_and_their_sketches_are_near():
    random_, sketcher = np.random.default_rng(2), set_join.Sketcher(85)
    for size in (6, 7, 8, 11, 12, 20, 45, 300, 3000):
        for _ in range(40):
            x = np.unique(random_.integers(0, 1 << 63, size).astype(np.uint64))
            for gone in range(size + 1):  # as many taken away, then as many of them replaced, as a link allows
                for new in (0, gone):
                    y = np.unique(np.concatenate([x[gone:], random_.integers(0, 1 << 63, new).astype(np.uint64)]))
                    if not len(y) or not sketcher.linked(x, y) or gone < 1:
                        continue
                    bands = set(sketcher.bands(len(x))) & set(sketcher.bands(len(y)))
                    shared = 0
                    for band in bands:
                        (keys, bits), (other_keys, other_bits) = sketcher.sketch(x, band), sketcher.sketch(y, band)
                        shared += len(np.intersect1d(keys, other_keys))
                        apart = int(np.bitwise_count(np.frombuffer(bits, np.uint64) ^ np.frombuffer(other_bits, np.uint64)).sum())
                        assert apart <= len(np.setxor1d(x, y)) <= sketcher.most(len(x), len(y))
                    assert shared
                if gone > 2 and gone > size * 0.16:
                    break


def test_words_of_long_texts_are_those_of_short_ones():
    text = ("Wörter " * 40 + "x" * 70 + "\n").encode()
    was, whole = set_join._SEGMENT, set_join.words(text * 9)
    try:
        set_join._SEGMENT = 50
        assert set_join.words(text * 9).tolist() == whole.tolist()
    finally:
        set_join._SEGMENT = was
    assert len(whole) == 9 * 41 and len(set(whole.tolist())) == 2


def test_set_join_agrees_with_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    compare(QUERIES["op12_set_join"](spark, sf), connection(sf), ORACLES["op12_set_join"])
