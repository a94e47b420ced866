"""Language identification by string kernels (operator 2).

A text's features are the n-grams (1 to 4 characters) of its lower-cased words,
each word with a space on both sides: a blended spectrum. Only presence counts.
N-grams are hashed into 2**15 places, so a text is a bit row, and the kernel of
two texts is the number of places they share over the geometric mean of their
numbers of places.

Landmarks taken from the labelled rows give the Nyström map; ridge regression
on it, one language against the rest, is kernel ridge regression in the span of
the landmarks. Scoring is two matrix products for a batch of texts: bit rows by
landmarks, then kernel values by weights.

Learning takes a bounded sample (SAMPLE distinct texts of each language, those
with the smallest hash of their text), read whole; everything is predicted.

Defined results: a null text, or one without letters, is ``und`` with score 0;
with no labelled row to learn from, every text is; repeated rows get equal
results; of languages with equal scores the first in order is taken; an empty
table gives an empty table; other columns are ignored, whatever their names;
texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillion.llm.batches import array_steps, bound_batches, keyed_map, released

NGRAMS = 4
PLACES = 1 << 15
#: Distinct labelled texts of each language from which the classifier is learned, at most.
SAMPLE = 256
#: Those of them that become landmarks.
LANDMARKS = 32
RIDGE = 1e-3
#: Sharpness with which regression values turn into a score.
SHARPNESS = 6.0
#: Texts of one matrix product.
ROWS = 64
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def places_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n-grams of each word, and where each word's places end."""
    padded = [f" {w} " for w in words]
    size = np.array([len(p) for p in padded])
    points = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(points))  # characters of the word from here on
    found, owner = [], []
    word = np.repeat(np.arange(len(words)), size)
    h = np.zeros(len(points), np.uint64)
    for n in range(1, NGRAMS + 1):
        h = h[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
        ok = np.flatnonzero(left[: len(h)] >= n)
        if n == 1:
            ok = ok[points[ok] != 32]
        found.append(((h[ok] * _MIX) >> np.uint64(49)).astype(np.int32))
        owner.append(word[ok])
    place, who = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(who, kind="stable")
    return place[order], np.cumsum(np.bincount(who, minlength=len(words)))


def bit_rows(texts: list[str | None]) -> np.ndarray:
    """Presence (texts, PLACES) as 0 and 1; a row of zeros for a text without letters."""
    rows = np.zeros((len(texts), PLACES), np.uint8)
    each = [set(_WORD.findall((t or "").lower())) for t in texts]
    words = list(set().union(*each))
    if not words:
        return rows
    place, end = places_of(words)
    parts = np.split(place, end[:-1])
    at = dict(zip(words, parts, strict=True))
    for row, own in zip(rows, each, strict=True):
        if own:
            row[np.concatenate([at[w] for w in own])] = 1
    return rows


@dataclass(frozen=True)
class Classifier:
    languages: tuple[str, ...]
    landmarks: np.ndarray  # (m, PLACES) of 0 and 1, packed into bits
    weights: np.ndarray  # (m, languages), Nyström map and regression in one

    def unpacked(self) -> np.ndarray:
        return np.unpackbits(self.landmarks, axis=1).astype(np.float32)


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values (rows, landmarks); 0 for empty rows."""
    norm = np.sqrt(np.maximum(rows.sum(1, dtype=np.float32), 1)[:, None] * np.maximum(landmarks.sum(1), 1)[None, :])
    return (rows.astype(np.float32) @ landmarks.T) / norm


def learn(rows: np.ndarray, languages: list[str]) -> Classifier:
    """Nyström ridge regression, one against the rest, from bit rows and their languages."""
    names = tuple(sorted(set(languages)))
    label = np.array([names.index(x) for x in languages])
    picked = np.concatenate([np.flatnonzero(label == c)[:LANDMARKS] for c in range(len(names))])
    landmarks = rows[picked].astype(np.float32)
    value, vector = np.linalg.eigh(kernel(rows[picked], landmarks).astype(np.float64))
    good = value > 1e-6 * value[-1]
    to_map = vector[:, good] / np.sqrt(value[good])
    mapped = kernel(rows, landmarks).astype(np.float64) @ to_map
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    # Rows weigh so that languages count alike.
    weight = (1 / np.bincount(label, minlength=len(names)))[label][:, None]
    system = mapped.T @ (weight * mapped) + RIDGE * np.eye(mapped.shape[1])
    return Classifier(names, np.packbits(rows[picked], axis=1), (to_map @ np.linalg.solve(system, mapped.T @ (weight * target))).astype(np.float32))


def held_out(id_col: str) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Classifier | None:
    """Learns from rows with a label that are not held out."""
    labelled = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # Copies are one text: distinct texts are counted, not rows.
    hashed = labelled.withColumn("h", F.xxhash64("text"))
    sizes = {r.lang: r.n for r in hashed.groupBy("lang").agg(F.countDistinct("h").alias("n")).collect()}  # a row for each language
    if not sizes:
        return None
    # Candidates by hash of the text: enough of each language, and as few for any number of rows; copies are one.
    share = F.lit(1.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 4.0 * SAMPLE / n))).otherwise(share)
    candidates = hashed.where(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < share).dropDuplicates(["lang", "h"])
    bits = keyed_map(candidates, ["lang", "h"], "text", lambda t: {"bits": pa.array([b.tobytes() for b in np.packbits(_bits(t), axis=1)], pa.binary())}, [("bits", "binary")])
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    sample = bits.withColumn("r", rank).where(F.col("r") <= SAMPLE).orderBy("lang", "h").select("lang", "bits").collect()
    rows = np.unpackbits(np.array([np.frombuffer(r.bits, np.uint8) for r in sample]).reshape(-1, PLACES // 8), axis=1)
    lettered = rows.any(1)
    return learn(rows[lettered], [r.lang for r, k in zip(sample, lettered, strict=True) if k]) if lettered.any() else None


def _bits(texts: pa.Array) -> np.ndarray:
    return np.concatenate([bit_rows(texts.slice(i, ROWS).to_pylist()) for i in range(0, len(texts), ROWS)]) if len(texts) else np.zeros((0, PLACES), np.uint8)


def _scorer(model: Classifier | None):
    held: dict[str, np.ndarray] = {}

    def run(texts: pa.Array) -> dict[str, pa.Array]:
        names, scores = [], []
        if model is not None and not held:
            held["landmarks"] = model.unpacked()
        for i in range(0, len(texts), ROWS):
            rows = bit_rows(texts.slice(i, ROWS).to_pylist())
            if model is None:
                names += [UNKNOWN] * len(rows)
                scores += [0.0] * len(rows)
                continue
            value = kernel(rows, held["landmarks"]) @ model.weights
            e = np.exp(SHARPNESS * (value - value.max(1, keepdims=True)).astype(np.float64))
            share = e / e.sum(1, keepdims=True)
            best = value.argmax(1)
            for k, b, lettered in zip(range(len(rows)), best.tolist(), rows.any(1).tolist(), strict=True):
                names.append(model.languages[b] if lettered else UNKNOWN)
                scores.append(float(share[k, b]) if lettered else 0.0)
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}

    return run


def predict(docs: DataFrame, model: Classifier | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    return keyed_map(docs, [id_col], text_col, _scorer(model), [("lang_pred", "string"), ("score", "double")])


def keep_identified(docs: DataFrame, model: Classifier | None, least_score: float, text_col: str = "text") -> DataFrame:
    """Rows, with their own columns only, whose language is known with at least this score.

    Only the text goes to Python, and a boolean comes back: rows wait in the JVM.
    """
    score = _scorer(model)

    def of_batch(texts: pa.Array) -> pa.Array:
        found = []
        for part in array_steps(texts):
            judged = score(part)
            found.append(pc.and_(pc.not_equal(judged["lang_pred"], UNKNOWN), pc.greater_equal(judged["score"], least_score)))
        return pa.concat_arrays(found) if found else pa.array([], pa.bool_())

    of_task = released(lambda batches: map(of_batch, batches))

    @F.arrow_udf("boolean")
    def identified(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from of_task(batches)

    bound_batches(docs.sparkSession)
    return docs.where(identified(F.col(f"`{text_col}`")))
