"""Texts for reading aloud, for editing and for fonts with few signs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions import text as t

# What a sentence for reading is, and the longest piece that is spoken at once.
SPOKEN = r'[^.!?\n]+(?:[.!?]+["”’)]?|\n|$)'
PACKED = r"[^.!?]+[.!?]*"
LONGEST_SPOKEN, LONGEST_PACKED = 280, 400


def spoken_pieces(c: Column, longest: int = LONGEST_SPOKEN) -> Column:
    """F8: structs (start, end, text) of the sentences of a text, none over ``longest``.

    A longer sentence is cut at the last blank that leaves a piece within the bound,
    else at the bound; pieces without a letter, digit or ``_`` are left out.
    """
    found = F.regexp_extract_all(c, F.lit(SPOKEN), F.lit(0))
    # sentences leave out only signs that end others, so each is looked for behind the one before
    placed = F.aggregate(
        found,
        F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda a, s: F.struct(
            (_place(s, c, a["at"]) + F.length(s)).alias("at"),
            F.concat(a["out"], F.array(F.struct((_place(s, c, a["at"]) - 1).alias("start"), (_place(s, c, a["at"]) - 1 + F.length(s)).alias("end")))).alias("out"),
        ),
    )["out"]
    pieces = F.flatten(F.transform(placed, lambda s: _cut(c, s["start"], s["end"], longest)))
    told = F.transform(pieces, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), t.strip(t.collapse(F.substr(c, p["start"] + 1, p["end"] - p["start"]))).alias("text")))
    return F.filter(told, lambda p: p["text"].rlike("[A-Za-z0-9_]"))


def _place(part: Column, whole: Column, at: Column) -> Column:
    return F.call_function("locate", part, whole, at)


def _cut(c: Column, start: Column, end: Column, longest: int) -> Column:
    """Stretches of at most ``longest`` from start to end, cut at blanks where there are any."""
    steps = F.sequence(F.lit(0), end - start)  # enough, as every cut takes a sign at least
    state = F.struct(start.alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a: Column, _: Column) -> Column:
        # a cut stands at a blank up to one place beyond the bound; the text before it must not be empty
        window = F.substr(c, a["at"] + 1, F.lit(longest + 1))
        blank = F.length(window) - F.length(F.substring_index(window, " ", -1)) - 1
        to = F.when(end - a["at"] <= longest, end).otherwise(a["at"] + F.when(blank > 0, blank).otherwise(longest)).cast("int")
        return F.when(a["at"] >= end, a).otherwise(F.struct(to.alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].cast("int").alias("start"), to.alias("end")))).alias("out")))

    short = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
    return F.when(end - start <= longest, short).otherwise(F.aggregate(steps, state, step)["out"])


def packed_sentences(c: Column, longest: int = LONGEST_PACKED) -> Column:
    """sentences packed in order into chunks that a further one would take over ``longest``; each sentence ends in a blank."""
    found = F.filter(F.transform(F.regexp_extract_all(c, F.lit(PACKED), F.lit(0)), t.strip), lambda s: s != "")
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    full = lambda a, s: (a["now"] != "") & (F.length(a["now"]) + F.length(s) > longest)
    end = F.aggregate(
        found,
        state,
        lambda a, s: F.struct(
            F.when(full(a, s), F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"),
            F.concat(F.when(full(a, s), F.lit("")).otherwise(a["now"]), s, F.lit(" ")).alias("now"),
        ),
    )
    return F.when(end["now"] != "", F.concat(end["done"], F.array(end["now"]))).otherwise(end["done"])


def encodable(c: Column, signs: str = r"\x{20}-\x{7E}\x{A0}-\x{FF}") -> Column:
    """tabs as four blanks, other controls but line breaks gone, signs that a font lacks as ``?``."""
    clean = F.regexp_replace(F.replace(c, F.lit("\t"), F.lit("    ")), r"[\x00-\x09\x0B-\x1F]", "")
    return F.regexp_replace(clean, rf"[^{signs}\n]", "?")


def wrapped(c: Column, width: int) -> Column:
    """lines of at most ``width`` signs of one advance, filled greedily; a longer word is cut where it begins a line."""
    lines = lambda words: F.aggregate(
        words,
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now")),
        lambda a, w: _wrapped_word(a, w, width),
        lambda a: F.concat(a["done"], F.array(a["now"])),
    )
    return F.flatten(F.transform(F.split(c, "\n", -1), lambda p: F.when(p == "", F.array(F.lit(""))).otherwise(lines(F.split(p, " ", -1)))))


def _wrapped_word(a: Column, word: Column, width: int) -> Column:
    empty, size = a["now"] == "", F.length(word)
    fits = ~empty & (F.length(a["now"]) + 1 + size <= width)
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((size - 1) / width)).cast("int")), lambda n: F.substr(word, n * width + 1, F.lit(width)))
    last = F.size(chunks)
    cut = F.struct(F.concat(a["done"], F.slice(chunks, 1, last - 1)).alias("done"), F.element_at(chunks, last).alias("now"))
    joined = F.struct(a["done"].alias("done"), F.concat(a["now"], F.lit(" "), word).alias("now"))
    opened = F.struct(F.concat(a["done"], F.array(a["now"])).alias("done"), word.alias("now"))
    return F.when(fits, joined).when(empty & (size > width), cut).when(empty, F.struct(a["done"].alias("done"), word.alias("now"))).otherwise(opened)


def luminance(rgb: Column) -> Column:
    """Relative luminance of a colour number, 0 to 1."""
    def linear(shift: int) -> Column:
        v = F.shiftright(rgb, shift).bitwiseAND(F.lit(255)) / 255.0
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return linear(16) * 0.2126 + linear(8) * 0.7152 + linear(0) * 0.0722


def contrast(a: Column, b: Column) -> Column:
    """Ratio of the lighter to the darker of two luminances."""
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def readable(rgb: Column, background: Column, least: float = 3.0) -> Column:
    """the colour, moved towards white on dark grounds and black on light ones by fifths until its contrast is ``least``."""
    ground = luminance(background)
    towards = F.when(ground < 0.5, 255).otherwise(0)

    def moved(fifths: int) -> Column:
        parts = (F.shiftright(rgb, s).bitwiseAND(F.lit(255)) for s in (16, 8, 0))
        r, g, b = (F.floor(p + (towards - p) * (fifths / 5) + 0.5).cast("long") for p in parts)
        return r * 65536 + g * 256 + b

    tries = [rgb.cast("long"), *(moved(n) for n in range(1, 5))]
    return F.coalesce(*(F.when(contrast(luminance(x), ground) >= least, x) for x in tries), (towards * 65793).cast("long"))


def whole_hits(c: Column, query: str) -> Column:
    """Structs (start, end) of the places of a query that don't overlap, whatever the case."""
    gaps = F.split(F.lower(c), "\\Q" + query.lower() + "\\E", -1)
    size = len(query)
    ends = F.aggregate(
        F.slice(gaps, 1, F.size(gaps) - 1),
        F.array().cast("array<int>"),
        lambda a, g: F.concat(a, F.array((F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.length(g) + size).cast("int"))),
    )
    return F.transform(ends, lambda e: F.struct((e - size).alias("start"), e.alias("end")))
