"""The kernels against brute force and libraries, without Spark."""

import random
import struct

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioflow.llm import decontaminate, language_id, near_dedup, neighbours, packing, quality, warc
from folioflow.llm.wordbpe import MergeCounter

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY, COUNTER, ENCODER = Tokenizer.from_file(PATH), MergeCounter(PATH), packing.ChunkEncoder(PATH)
ODD = ["", " ", "it's they'll we'RE X'S", "İstanbul ΣΑΣ ς ²½ 3rd １２", "éä́ ﬁ", "<|endoftext|>hello<|startoftext|> <|end", "a\x1cb\x85c d\xa0e", "日本語 ไทย हिन्दी", "👩‍👩‍👧 emoji!!! ñ", "_a_b__1a2", "﻿abc​def", "x" * 500]


@pytest.mark.parametrize("text", ODD)
def test_counts_and_ids_are_the_librarys(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert COUNTER.count(text) == len(ids)
    assert ENCODER.ids(text) == np.asarray(ids, "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F), max_size=60))
def test_counts_are_the_librarys_on_any_usual_text(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert COUNTER.count(text) == len(ids)
    assert ENCODER.ids(text) == np.asarray(ids, "<u4").tobytes()


def test_best_fit_keeps_every_capacity():
    random.seed(1)
    lengths = np.array([random.randint(1, 100) for _ in range(500)])
    for docs, cost in ((1000, 1e9), (3, 1e9), (1000, 6000.0)):
        bins, offsets = packing.best_fit(lengths, 100, docs, max(cost, 1e4))
        for n in set(bins):
            mine = lengths[bins == n]
            assert mine.sum() <= 100 and len(mine) <= docs and (mine.astype(float) ** 2).sum() <= max(cost, 1e4) + 1e-6
            at = np.argsort(offsets[bins == n])
            assert (np.concatenate([[0], mine[at].cumsum()[:-1]]) == offsets[bins == n][at]).all()
        if docs == 1000 and cost == 1e9:
            room = []
            for n in sorted(lengths, reverse=True):  # first fit decreasing
                k = next((k for k, r in enumerate(room) if r >= n), None)
                if k is None:
                    room.append(100 - n)
                else:
                    room[k] -= n
            assert len(set(bins)) <= len(room)


@pytest.mark.parametrize(("docs", "cost", "share"), [(3, 1e4, "docs"), (1000, 2600.0, "cost")])
def test_best_fit_where_documents_or_cost_bind(docs, cost, share):
    random.seed(2)
    lengths = np.array([random.randint(1, 20) if share == "docs" else random.randint(30, 50) for _ in range(500)])
    bins, _ = packing.best_fit(lengths, 100, docs, cost)
    tokens, count, squares = np.bincount(bins, lengths), np.bincount(bins), np.bincount(bins, lengths.astype(float) ** 2)
    assert tokens.max() <= 100 and count.max() <= docs and squares.max() <= cost + 1e-6
    assert count.max() == docs if share == "docs" else squares.max() > 0.9 * cost
    free = packing.best_fit(lengths, 100, 1000, 1e4)[0]
    assert bins.max() > free.max()


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_alignment_is_the_longest_common_subsequence():
    random.seed(3)
    for _ in range(400):
        a = [random.randint(0, random.choice([3, 1000])) for _ in range(random.randint(1, 40))]
        b = a[:]
        for _ in range(random.randint(0, 5)):
            i = random.randrange(len(b) + 1)
            if random.random() < 0.5:
                b.insert(i, random.randint(0, 1000))
            elif i < len(b) and len(b) > 1:
                del b[i]
        common = _lcs(a, b)
        want = common / (len(a) + len(b) - common) >= 0.8
        assert near_dedup.aligned(np.array(a, np.uint64), np.array(b, np.uint64), 0.8) == want


def test_links_join_what_all_alignments_join():
    random.seed(5)
    base = [f"w{random.randint(0, 10**6)}" for _ in range(120)]
    texts = []
    for _ in range(25):
        words = base[:]
        for i in random.sample(range(120), random.randint(0, 6)):
            words[i] = f"x{random.randint(0, 10**6)}"
        texts.append(" ".join(words))
    x = [near_dedup.shingles(t, 5) for t in texts]
    want = {(i, j) for i in range(25) for j in range(i) if near_dedup.aligned(x[i], x[j], 0.8)}
    found = near_dedup.Links(5, 0.8).pairs([b"%d" % i for i in range(25)], texts, list(range(25)))

    def parts(edges):
        top = list(range(25))

        def root(i):
            return i if top[i] == i else root(top[i])

        for i, j in edges:
            top[root(i)] = root(j)
        return [sorted(k for k in range(25) if root(k) == root(i)) for i in range(25)]

    assert parts(found) == parts(want)


def test_words_do_not_depend_on_segments(monkeypatch):
    text = " ".join(f"Word{i}!" for i in range(500))
    whole = near_dedup.words(text)
    monkeypatch.setattr(near_dedup, "_SEGMENT", 37)
    assert (near_dedup.words(text) == whole).all() and len(whole) == 500


def _substring_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_and_pigeonhole_lose_no_match():
    random.seed(7)
    for _ in range(150):
        p = "".join(random.choice("abc ") for _ in range(random.randint(5, 70))).strip() or "a"
        t = "".join(random.choice("abc ") for _ in range(60)) + p + "".join(random.choice("abc ") for _ in range(60))
        t = list(t)
        for _ in range(random.randint(0, 6)):
            t[random.randrange(len(t))] = random.choice("abcd")
        t = "".join(t)
        want = _substring_distance(decontaminate.plain(p), decontaminate.plain(t))
        hit = decontaminate.myers(decontaminate.plain(p), decontaminate.plain(t), 1000)
        assert hit[0] == want
        m = decontaminate.Matcher([(1, p)], 0.1)
        most = decontaminate.budget(len(decontaminate.plain(p)), 0.1)
        assert m.found(t) == ([(0, want)] if want <= most and decontaminate.plain(p) else [])


def test_archives_round_trip_and_broken_ones_are_refused():
    payloads = [b"", b"abc" * 50, bytes(range(256)) * 3, b"\r\n\r\nWARC/1.1\r\n"] * 5
    w = warc.Writer(payloads)
    for i, p in enumerate(payloads):
        w.add({"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{i}>", "WARC-Date": warc.DATE}, p)
    data = w.bytes()
    assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_MAGIC
    assert [r.block for r in warc.records(data)] == payloads
    for broken in (data[:-3], data + b"xx", data[:4] + b"\xff\xff\xff\x7f" + data[8:]):
        with pytest.raises(warc.ArchiveError):
            list(warc.records(broken))
    trailing = struct.pack("<II", 0x184D2A51, 3) + b"abc"
    assert len([*warc.records(data + trailing)]) == len(payloads)
    size = struct.unpack_from("<I", data, 4)[0]
    corrupt = data[:12] + bytes(size - 4) + data[8 + size :]
    for broken in (data + trailing[:-1], corrupt):
        with pytest.raises(warc.ArchiveError):
            list(warc.records(broken))
    good = warc.serialised({"WARC-Type": "a", "WARC-Record-ID": "b", "WARC-Date": "c"}, b"xyz")
    for bad in (good.replace(b"Length: 3", b"Length: 4"), good.replace(b"WARC-Type: a\r\n", b""), good.replace(b"WARC/1.1", b"WARC/9.9"), good[:-2], good.replace(b"WARC-Date: c", b"no header"), good.replace(b"WARC-Date: c", b"WARC-Date: \xff"), good.replace(b"Length: 3", "Length: ³".encode())):
        with pytest.raises(warc.ArchiveError):
            warc.parsed(bad)
    revisit = {"warc-profile": warc.REVISIT_PROFILE, "warc-refers-to": "<x>", "warc-type": "revisit", "warc-record-id": "<r>", "warc-payload-digest": "sha1:ABC", "x-payload-length": "7"}
    assert warc._told("p", warc.Record(revisit, b""))[5:7] == (7, "ABC")
    for name in ("warc-profile", "warc-refers-to", "warc-payload-digest", "x-payload-length"):
        with pytest.raises(warc.ArchiveError):
            warc._told("p", warc.Record({k: v for k, v in revisit.items() if k != name}, b""))
    assert warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_probe_visits_cells_by_rising_distance():
    rng = np.random.default_rng(2)
    index = neighbours.MultiIndex((rng.normal(size=(6, 2)), rng.normal(size=(5, 2))), np.ones((6, 5), int))
    q = rng.normal(size=4)
    order = index.probe(q, 30)
    d = [((q[:2] - index.halves[0][i]) ** 2).sum() + ((q[2:] - index.halves[1][j]) ** 2).sum() for i, j in order]
    assert len(set(order)) == 30 and d == sorted(d)


def test_models_with_no_or_one_class_are_constant():
    m = quality.fit(np.empty((0, 18)), np.empty(0))
    assert m.score(np.zeros((2, 18))).tolist() == [0.5, 0.5]
    assert 0.5 < quality.fit(np.zeros((9, 18)), np.ones(9)).score(np.zeros((1, 18)))[0] < 1
    empty = language_id.fit(np.empty((0, 2048), np.uint8), [])
    assert empty.scores(["abc", None, "12"])[0] == ["und", "und", "und"]


def test_pairs_of_features_are_learnt():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 18))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = quality.fit(x[:3000], y[:3000], rounds=60)
    assert (0, 1) in m.pairs
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_short_texts_share_a_key_wherever_they_link():
    random.seed(8)
    for _ in range(3000):
        a = [random.randint(1, 60) for _ in range(random.randint(1, 14))]
        b = a[:]
        for _ in range(random.randint(0, 3)):
            at = random.randrange(len(b))
            b[at : at + random.randint(0, 1)] = [random.randint(1, 60)] * random.randint(0, 1)
            b = b or [1]
        x, y = (np.array(v, np.uint64) for v in (a, b))
        if len(y) <= near_dedup.FEW and near_dedup.aligned(x, y, 0.8):
            keys = [set(near_dedup.few_keys(near_dedup.labelled(v), 0.8).tolist()) for v in (x, y)]
            assert keys[0] & keys[1]


def test_pieces_of_all_lengths_are_found():
    random.seed(12)
    letters = "abcdefghij"
    items = [(n, "".join(random.choice(letters) for _ in range(n))) for n in [1, 3, 7, 8, 9, 15, 16, 17, 18, 31, 33, 50, 70, 140, 400]]
    matcher = decontaminate.Matcher(items, 0.06)
    for k, (n, item) in enumerate(items):
        text = " ".join("".join(random.choice(letters) for _ in range(9)) for _ in range(30))
        held = list(item)
        for _ in range(decontaminate.budget(n, 0.06)):
            held[random.randrange(n)] = "z"
        found = dict(matcher.found(f"{text} {''.join(held)} {text}"))
        want = {j: d for j, (m, other) in enumerate(items) if (d := _substring_distance(other, f"{text} {''.join(held)} {text}")) <= decontaminate.budget(m, 0.06)}
        assert found == want and k in found
