"""Word-level byte-pair encoding shared by token counting and packing.

A vocabulary file of the ``tokenizers`` library whose pre-tokenizer never
crosses white space lets a text be handled as its white-space chunks: the
tokens of a text are those of its chunks in order. Both users keep a bounded
table from chunk to what they need of it, so that a frequent chunk is worked
out once per Python worker and not once per occurrence.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterable
from heapq import heapify, heappop, heappush

import numpy as np
import regex

#: Beyond Latin Extended-B texts take the slow path: normal forms, scripts, other white space.
_LAST_USUAL = 0x24F
#: So do these controls, which Python alone takes as white space.
_CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85")

#: Chunks that a worker's table holds before it starts afresh.
TABLE_ROWS = 1_000_000
#: Longer chunks are worked out each time.
LONGEST_KEPT = 64




def usual(text: str) -> bool:
    """Whether lower-casing and splitting by Python's strings match the library's."""
    if any(c in text for c in _CONTROLS):
        return False
    return text.isascii() or int(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").max()) <= _LAST_USUAL


def looked_up(table: dict, chunks: list[str], work_out: Callable[[list[str]], Iterable]) -> list:
    """The values of chunks in order; what ``table`` lacks is worked out, short chunks stay in it."""
    values = [*map(table.get, chunks)]
    if None in values:
        missing = [*{c for c, v in zip(chunks, values) if v is None}]
        found = dict(zip(missing, work_out(missing)))
        values = [found[c] if v is None else v for c, v in zip(chunks, values)]
        if len(table) + len(found) > TABLE_ROWS:
            table.clear()
        table.update((c, v) for c, v in found.items() if len(c) <= LONGEST_KEPT)
    return values


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b], spare = chr(spare), spare + 1
    return table


class MergeCounter:
    """Counts the tokens of a text without making any.

    Each pre-token is a doubly linked list of symbols and a heap of its adjacent
    pairs by (rank, place). The lowest-ranked pair that still stands is popped and
    merged until none is left; the count is the initial symbols minus the merges.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("byte_fallback") or model.get("dropout"):
            raise ValueError("only plain byte-pair models are counted")
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(a, b): r for r, (a, b) in enumerate(pairs)}
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        if kinds != ["NFC", "Replace", "Lowercase"] or len(splits) != 1:
            raise ValueError("a vocabulary of another kind")
        self.split = regex.compile(splits[0]["pattern"]["Regex"])
        self.alphabet = byte_alphabet()
        added = [t["content"] for t in spec["added_tokens"]]
        self.added = added
        self.special = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.table: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of one pre-token."""
        symbols = [self.alphabet[b] for b in word.encode("utf-8")]
        if not symbols:
            return 0
        symbols[-1] += self.suffix
        n, rank_of = len(symbols), self.ranks.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := rank_of(pair)) is not None]
        heapify(heap)
        merges = 0
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if j < 0 or rank_of((symbols[i], symbols[j])) != rank:
                continue  # one of the two has been merged since
            symbols[i] = merged = symbols[i] + symbols[j]
            symbols[j] = None
            merges += 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank_of((merged, symbols[k]))) is not None:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank_of((symbols[h], merged))) is not None:
                heappush(heap, (r, h))
        return n - merges

    def chunk(self, chunk: str) -> int:
        """Tokens of a lower-cased chunk without white space."""
        words, total = self.words, 0
        for word in self.split.findall(chunk):
            n = words.get(word)
            if n is None:
                n = self.word(word)
                if len(word) <= LONGEST_KEPT:
                    if len(words) >= TABLE_ROWS:
                        words.clear()
                    words[word] = n
            total += n
        return total

    def _usual(self, text: str) -> int:
        return sum(looked_up(self.table, text.lower().split(), lambda new: map(self.chunk, new)))

    def count(self, text: str) -> int:
        """Tokens of a text; an added token's string in it counts as one."""
        total = 0
        if self.special and any(t in text for t in self.added):
            total = len(self.special.findall(text))
            parts = self.special.split(text)
        else:
            parts = [text]
        for part in parts:
            if usual(part):
                total += self._usual(part)
            else:
                part = unicodedata.normalize("NFC", part)
                total += self.chunk("".join(c.lower() for c in part))
        return total
