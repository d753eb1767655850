"""Language identification by a string kernel.

The kernel of two texts counts the distinct character n-grams (lengths 1 to ``max_n``, the
blended spectrum) that both hold, divided by the geometric mean of their own counts.
N-grams are hashed into ``dims`` cells, so a text is a row of zeros and ones and a batch of
kernels is one matrix product.  Landmarks (Nyström) give every text ``m`` kernel values,
whitened by the landmarks' own kernel matrix; one-versus-rest kernel ridge regression on
these gives one score per language; a softmax over the scores is the confidence.

Training reads a bounded sample: for each language the ``per_language`` labelled rows whose
id hashes lowest, as packed bits (``dims / 8`` bytes a row), of which the first
``landmarks_per_language`` are landmarks.  Prediction reads whole texts only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.shared import ready

UNDETERMINED = "und"
#: A text this long is in a learned language or not; its score is held against the floor,
#: which is this share of the lowest score among the sample's rows of that length.
CONFIDENT_CHARS, FLOOR_SHARE = 200, 0.6
_LETTER = regex.compile(r"\p{L}")
#: Characters hashed at a time, so very long texts need no large arrays.
_STEP = 1 << 18


@dataclass(frozen=True)
class Kernel:
    max_n: int = 3
    dims: int = 1 << 13

    def present(self, text: str) -> np.ndarray:
        """Which cells the text's n-grams fill (white space runs count as one space)."""
        out = np.zeros(self.dims, bool)
        points = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le"), np.uint32)
        for at in range(0, len(points), _STEP):
            part = points[at:at + _STEP + self.max_n - 1].astype(np.uint64)
            code = np.zeros(len(part), np.uint64)
            for n in range(1, self.max_n + 1):
                if len(part) < n:
                    break
                code = code[:len(part) - n + 1] * np.uint64(0x100000001B3) + part[n - 1:] + np.uint64(n)
                mixed = (code ^ (code >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                out[mixed >> np.uint64(64 - (self.dims - 1).bit_length())] = True
        return out

    def matrix(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Normalised kernel values of two blocks of presence rows (float32)."""
        sizes = np.sqrt(np.outer(rows.sum(1), columns.sum(1)))
        return rows @ columns.T / np.maximum(sizes, 1)


@dataclass
class Classifier:
    kernel: Kernel
    languages: list[str]
    landmarks: np.ndarray  # presence rows, uint8
    weights: np.ndarray    # landmark kernels -> scores of the languages
    floor: float = 0.0     # scores below it are of texts in no learned language

    @classmethod
    def fit(cls, kernel: Kernel, rows: np.ndarray, labels: list[str], landmark: np.ndarray,
            ridge: float = 1e-2) -> Classifier:
        """``rows``: presence rows; ``landmark``: which of them are landmarks."""
        languages = sorted(set(labels))
        x = rows.astype(np.float32)
        marks = x[landmark]
        values, vectors = np.linalg.eigh(kernel.matrix(marks, marks).astype(np.float64))
        kept = values > 1e-6 * max(values.max(initial=0), 1e-12)
        whiten = vectors[:, kept] / np.sqrt(values[kept])
        z = kernel.matrix(x, marks) @ whiten
        target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
        # every language weighs the same, however many rows it has
        weight = 1.0 / np.array([labels.count(x) for x in labels], np.float64)[:, None]
        solved = np.linalg.solve(z.T @ (z * weight) + ridge * np.eye(z.shape[1]), z.T @ (target * weight))
        return cls(kernel, languages, rows[landmark].astype(np.uint8), whiten @ solved)

    def confidence(self, rows: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """A softmax over the languages' scores for each presence row (float32)."""
        each = 4.0 * (self.kernel.matrix(rows, marks) @ self.weights)
        each = np.exp(each - each.max(1, keepdims=True))
        return each / each.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text, by one matrix product for every 64 of them."""
        names, scores = [], []
        marks = self.landmarks.astype(np.float32)
        for at in range(0, len(texts), 64):
            some = texts[at:at + 64]
            asked = [i for i, t in enumerate(some) if self.languages and t and _LETTER.search(t)]
            name, score = [UNDETERMINED] * len(some), [0.0] * len(some)
            if asked:
                rows = np.array([self.kernel.present(some[i]) for i in asked], np.float32)
                for i, p in zip(asked, self.confidence(rows, marks)):
                    best = int(p.argmax())
                    name[i], score[i] = self.languages[best], float(p[best])
            names += name
            scores += score
        return names, scores


def train(df: DataFrame, id_col: str, text_col: str, lang_col: str, kernel: Kernel = Kernel(),
          per_language: int = 300, landmarks_per_language: int = 60, max_languages: int = 500) -> Classifier:
    """Fit on the rows of ``df`` with a label and a letter in their text.

    What the driver gets is bounded: ``per_language`` rows of ``dims / 8`` bytes for each
    language; more than ``max_languages`` labels are an error.  Without labelled rows every
    prediction is ``und``."""
    ready(df.sparkSession)
    rows = (df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"),
                      F.col(lang_col).cast("string").alias("lang")).where(r"lang is not null and text rlike '\\p{L}'"))
    n = rows.groupBy("lang").count().limit(max_languages + 1).count()
    if n > max_languages:
        raise ValueError(f"over {max_languages} labels")
    rows = rows.withColumn("order", F.xxhash64("id"))
    # ids are ranked without their texts, and Spark cuts each task's rows to the group limit
    # before it shuffles them; the texts of the few chosen ids are then read by a broadcast
    ranked = rows.select("lang", "order", "id").distinct().selectExpr(
        "*", "row_number() over (partition by lang order by order, id) as rank")
    chosen = ranked.where(F.col("rank") <= per_language).select("lang", "id", "rank")
    sample = (rows.join(F.broadcast(chosen), ["lang", "id"]).groupBy("lang", "rank")
              .agg(F.min("text").alias("text")))  # rows of one id: the first text

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            bits = [np.packbits(kernel.present(t)).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("rank"), pa.array(bits, pa.binary()),
                                              pa.array([len(t) >= CONFIDENT_CHARS for t in texts], pa.bool_())],
                                             names=["lang", "rank", "bits", "long"])

    got = sorted(sample.mapInArrow(packed, "lang string, rank int, bits binary, long boolean").collect(),
                 key=lambda r: (r.lang, r.rank))
    if not got:
        return Classifier(kernel, [], np.zeros((0, kernel.dims), np.uint8), np.zeros((0, 0)))
    present = np.array([np.unpackbits(np.frombuffer(r.bits, np.uint8)) for r in got])
    model = Classifier.fit(kernel, present, [r.lang for r in got],
                           np.array([r.rank <= landmarks_per_language for r in got]))
    long = present[[r.long for r in got]].astype(np.float32)
    if len(long):
        model.floor = FLOOR_SHARE * float(model.confidence(long, model.landmarks.astype(np.float32)).max(1).min())
    return model


def identify(df: DataFrame, text_col: str, model: Classifier, keep: dict[str, str]) -> DataFrame:
    """One row for each row of ``df``: the columns of ``keep`` (new name: column),
    ``lang_pred`` and ``score`` (0 to 1).

    Texts that are null or hold no letter get ``und`` and 0; repeated rows are judged alike;
    an empty table gives no rows; other columns take no part."""
    spark = df.sparkSession
    ready(spark)
    shipped = spark.sparkContext.broadcast(model)  # landmarks and weights: bounded by the parameters
    rows = df.select(*[F.col(c).alias(f"k_{n}") for n, c in keep.items()], F.col(text_col).alias("text"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = shipped.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(names, pa.string()),
                                              pa.array(scores, pa.float64())],
                                             names=[*b.schema.names[:-1], "lang_pred", "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    out = rows.mapInArrow(judged, ", ".join([*fields, "lang_pred string, score double"]))
    return out.select(*[F.col(f"k_{n}").alias(n) for n in keep], "lang_pred", "score")


def held_out(id_col: str) -> Column:
    """One row in four is never learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_identified(df: DataFrame, text_col: str, model: Classifier) -> DataFrame:
    """``df`` without the documents that have no language: no letter, no text, or a text of at
    least ``CONFIDENT_CHARS`` characters whose score is under the model's floor, so in no
    learned language.  Shorter texts show too little and stay.

    Only the text goes to Python and only the verdict comes back; rows stay with Spark.
    Repeated rows are judged alike, an empty table gives no rows, other columns take no part."""
    ready(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(model)  # landmarks and weights: bounded by the parameters

    def kept(texts: pa.Array) -> pa.Array:
        given = texts.to_pylist()
        names, scores = shipped.value.predict(given)
        return pa.array([n != UNDETERMINED and (s >= shipped.value.floor or len(t) < CONFIDENT_CHARS)
                         for t, n, s in zip(given, names, scores)], pa.bool_())

    return df.where(F.arrow_udf(kept, "boolean")(F.col(text_col)))
