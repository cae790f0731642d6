"""Language identification by string kernels, Nyström landmarks and kernel ridge regression; familiarity by counts over whole tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from folioflow.llm.shared import prepare

BITS = 14
ORDERS = 4
#: Steps of one in which familiarities are counted: the shares are logarithms, so there are some ten thousands of them.
STEPS = 4096
#: Languages of which a task holds the counts at once.
COUNTED = 256
_letters: list = []


def _letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """Buckets of the character 1- to 4-grams of a text's letters; empty without letters.

    Lower-cased; each run of other characters is one space, also at both ends.
    """
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letter_table()[np.minimum(points, 0x10FFFF)]
    if not letter.any():
        return np.empty(0, np.uint32)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    signs = np.where(letter, points, 32)[keep].astype(np.uint32)
    rolled, found = signs * np.uint32(0x9E3779B1), []
    for n in range(1, ORDERS + 1):
        if n > 1:
            if len(signs) < n:
                break
            rolled = (rolled[:-1] + signs[n - 1 :]) * np.uint32(0x9E3779B1)
        found.append(((rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
    return np.concatenate(found)


def presence(texts: list[str | None]) -> np.ndarray:
    """A row of 0 and 1 for each text: which buckets its n-grams fall in."""
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for i, text in enumerate(texts):
        if text:
            out[i, grams(text)] = 1
    return out


@dataclass
class Model:
    """Ridge weights folded back through the landmarks onto buckets."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    sharpness: float = 4.0

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its share of the soft maximum; und and 0 without letters."""
        shown = presence(texts)
        n = shown.sum(1)
        margin = (shown @ self.weights) / np.sqrt(np.maximum(n, 1))[:, None] + self.bias
        share = np.exp(self.sharpness * (margin - margin.max(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        return [self.languages[k] if m else "und" for k, m in zip(best, n)], np.where(n > 0, share.max(1), 0.0)


@dataclass
class Usual:
    """For each language how many texts it has, and the logarithms of the shares that show each bucket: of its texts, and for one that shows it, of its others."""

    languages: list[str]
    texts: np.ndarray
    shares: np.ndarray
    others: np.ndarray

    def familiarity(self, texts: list[str | None], counted: list[str] | None = None) -> np.ndarray:
        """How usual the buckets of each text are in the language where they are most so; -inf without letters or learnt languages.

        The mean, over the buckets that a text shows, of the logarithm of the share
        of a language's learnt texts that show them too. Unlike a margin it doesn't
        depend on what other languages there are. ``counted`` tells for texts that are
        among the learnt ones as what language each was counted: it is left out of the
        counts, and a language of no other text isn't learnt.
        """
        out = np.full(len(texts), -np.inf)
        if self.languages:
            for k in range(0, len(texts), 128):
                shown = presence(texts[k : k + 128])
                n, sums = shown.sum(1), shown @ self.shares
                if counted is not None:
                    lang = np.searchsorted(np.array(self.languages, object), np.array(counted[k : k + 128], object))
                    own = np.arange(len(shown)), lang
                    sums[own] = np.where(self.texts[lang] > 1, (shown @ self.others)[own], -np.inf)
                out[k : k + 128] = np.where(n > 0, sums.max(1) / np.maximum(n, 1), -np.inf)
        return out


def fit(bits: np.ndarray, languages: list[str], landmarks: int = 256, ridge: float = 1e-2) -> Model:
    """One-versus-rest kernel ridge regression in the Nyström space of the first rows of each language.

    ``bits`` has the presence rows packed, eight buckets a byte; they are unpacked in blocks.

    The kernel of two texts is the number of buckets that both show over the
    geometric mean of what each shows. The fitted function is linear in the
    presence row, so landmarks, whitening and ridge weights fold into one matrix
    and a batch is scored by a single product.
    """
    names = sorted(set(languages))
    if not names:
        return Model(["und"], np.zeros((1 << BITS, 1), np.float32), np.zeros(1))
    y = np.array([names.index(x) for x in languages])
    rank = np.zeros(len(y), int)
    for k in range(len(names)):
        rank[y == k] = np.arange((y == k).sum())
    chosen = np.argsort(rank, kind="stable")[:landmarks]

    def unit(packed: np.ndarray) -> np.ndarray:
        shown = np.unpackbits(packed, axis=1).astype(np.float32)
        return shown / np.sqrt(np.maximum(shown.sum(1, keepdims=True), 1))

    marks = unit(bits[chosen])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    used = values > 1e-6 * max(values.max(), 1e-12)
    whiten = vectors[:, used] / np.sqrt(values[used])
    phi = np.concatenate([(unit(bits[k : k + 512]) @ marks.T).astype(float) @ whiten for k in range(0, len(bits), 512)])
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    # every language weighs the same
    weight = np.array([len(y) / (len(names) * (y == k).sum()) for k in range(len(names))])[y][:, None]
    middle, goal = (weight * phi).sum(0) / weight.sum(), (weight * target).sum(0) / weight.sum()
    centred = phi - middle
    solved = np.linalg.solve(centred.T @ (weight * centred) + ridge * len(y) * np.eye(phi.shape[1]) / phi.shape[1], centred.T @ (weight * (target - goal)))
    return Model(names, (marks.T.astype(float) @ (whiten @ solved)).astype(np.float32), goal - middle @ solved)


def train(labelled: DataFrame, most_rows: int = 6000, landmarks: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most ``most_rows`` rows in all, the same number of each language, picked by a hash of id and text.

    What reaches the driver is a bit row of 2 KiB for each picked text, made from
    the whole text: about 12 MB at most. Every language is learnt from a row at least; only if there
    are more languages than rows may be picked, the most frequent ones are (of equals the first by
    name). Rows with a null language or text are left out; repeated rows and ids
    count each time; a null id is a value like any other.
    """
    spark = labelled.sparkSession
    prepare(spark)
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("t")).where("lang is not null and t is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_rows).collect()
    space = 1 << 30
    each = max(1, most_rows // max(1, len(sizes)))
    # half as many again as wanted, of which the least hashes are taken
    limits = spark.createDataFrame([(r["lang"], min(space, (3 * space * each // 2 + 30 * space) // r["n"])) for r in sizes], f"lang {rows.schema['lang'].dataType.simpleString()}, most long")
    mark = F.pmod(F.xxhash64("id", F.lit("language"), "t"), F.lit(space))
    picked = rows.join(F.broadcast(limits), "lang").withColumn("h", mark).where(F.col("h") < F.col("most")).select("id", "lang", "t", "h")

    def bits(batches):
        for batch in batches:
            shown = presence(batch.column(2).to_pylist())
            packed = np.packbits(shown.astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(3), pa.array([r.tobytes() for r in packed], pa.binary())], names=["lang", "h", "bits"])

    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "bits"))
    shown = picked.mapInArrow(bits, "lang string, h long, bits binary").withColumn("place", place).where(F.col("place") <= each)
    got = sorted(shown.collect(), key=lambda r: (r["h"], r["lang"], r["bits"]))
    packed = np.frombuffer(b"".join(r["bits"] for r in got), np.uint8).reshape(len(got), (1 << BITS) // 8)
    return fit(packed, [r["lang"] for r in got], landmarks)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added; a column of either name is replaced.

    A null text or one without letters is ``und`` with score 0; an empty table
    gives an empty result; nothing is shuffled.
    """
    prepare(docs.sparkSession)
    kept = docs.drop("lang_pred", "score")
    names = kept.columns
    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    at = names.index(text_col)

    def score(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            languages, shares = [], []
            for k in range(0, len(texts), 128):
                found, share = model.scores(texts[k : k + 128])
                languages += found
                shares.append(share)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages, pa.string()), pa.array(np.concatenate(shares) if shares else np.empty(0), pa.float64())], names=[*names, "lang_pred", "score"])

    return kept.mapInArrow(score, schema)


def usual(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Usual:
    """What is usual in each language, counted over all rows; those with a null language or text are left out.

    A task sends a count for each language and bucket that its rows show, so no more
    than these meet in the driver, whatever the number of rows.
    """
    prepare(labelled.sparkSession)
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t")).where("lang is not null and t is not null")

    def told(held):
        for lang, counts in held.items():
            places = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(places), pa.string()), pa.array(places, pa.int32()), pa.array(counts[places], pa.int64())], names=["lang", "place", "n"])

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for k in range(0, len(texts), 128):
                shown, of = presence(texts[k : k + 128]), langs[k : k + 128]
                for lang in sorted(set(of)):
                    counts = held.setdefault(lang, np.zeros((1 << BITS) + 1, np.int64))  # the last place counts texts
                    counts[:-1] += shown[of == lang].sum(0).astype(np.int64)
                    counts[-1] += (of == lang).sum()
            if len(held) > COUNTED:
                yield from told(held)
                held = {}
        yield from told(held)

    sums = rows.mapInArrow(count, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    langs, places, ns = (sums.column(c) for c in ("lang", "place", "n"))
    names = sorted(set(langs.to_pylist()))
    counts = np.zeros((1 << BITS, len(names)))
    at, place, n = np.searchsorted(np.array(names, object), np.array(langs.to_pylist(), object)), places.to_numpy(), ns.to_numpy()
    texts, bucket = np.zeros(len(names)), place < 1 << BITS
    texts[at[~bucket]] = n[~bucket]
    counts[place[bucket], at[bucket]] = n[bucket]
    return Usual(names, texts, *(np.log(x).astype(np.float32) for x in ((counts + 0.5) / (texts + 1), np.maximum(counts - 0.5, 0.5) / texts)))


def least_familiarity(labelled: DataFrame, model: Usual, lost: float, text_col: str = "text", lang_col: str = "lang", learnt: bool = False) -> float:
    """A familiarity that at most a share ``lost`` of the ``labelled`` texts with letters stay below.

    It lies under that quantile by a quarter of its distance from the median, as
    few texts put the quantile too high. All of them are scored and counted by
    steps of 1 / ``STEPS``, rounded down; without any, every text with letters passes.
    ``learnt`` says that ``model`` counts these very rows: each is scored by all the others.
    """
    prepare(labelled.sparkSession)
    shown = labelled.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and t is not null")

    def familiar(batches):
        for batch in batches:
            found = model.familiarity(batch.column(0).to_pylist(), batch.column(1).to_pylist() if learnt else None)
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(found[np.isfinite(found)] * STEPS).astype(np.int64), pa.int64())], names=["step"])

    counts = sorted((r["step"], r["n"]) for r in shown.mapInArrow(familiar, "step long").groupBy("step").agg(F.count("*").alias("n")).collect())
    if not counts:
        return -np.finfo(float).max
    steps, upto = np.array([s for s, _ in counts]), np.cumsum([n for _, n in counts])
    at = lambda place: float(steps[np.searchsorted(upto, place, side="right")]) / STEPS
    n = int(upto[-1])
    low, middle = at(int((n - 1) * lost)), (at((n - 1) // 2) + at(n // 2)) / 2
    return low - (middle - low) / 4


def recognised(docs: DataFrame, model: Usual, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a familiarity of ``least`` or more; nothing is shuffled."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.familiarity(batch.column(at).to_pylist()) >= least))

    return docs.mapInArrow(keep, docs.schema)
