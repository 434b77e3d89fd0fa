"""Language of a text by a string kernel.

A text is the set of its byte n-grams of two to four bytes, hashed to a fixed number of
bits; the kernel of two texts is the number of n-grams present in both over the geometric
mean of their numbers. Landmarks are a few labelled texts per language; the kernel with
them, whitened by the kernel among them (Nyström), gives features on which one ridge
regression per language is fitted against the rest. All of it folds into one matrix, so
texts are scored by one matrix product per batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashgrid.llm.texts import give_back, read

WIDTH_BITS = 14
WIDTH = 1 << WIDTH_BITS
SIZES = (2, 3, 4)
#: The sample that the model is fitted on: rows per language and in all. Of these, landmarks.
ROWS_PER_LANGUAGE, MAX_ROWS = 600, 8_000
LANDMARKS_PER_LANGUAGE, MAX_LANDMARKS = 40, 320
RIDGE = 1e-2
SHARPNESS = 6.0
UNKNOWN = "und"
BATCH = 64

_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def presence(text: str) -> np.ndarray:
    """Which hashed n-grams occur in a text; signs and digits count as blanks."""
    data = np.frombuffer(b" " + text.lower().encode().translate(_PLAIN) + b" ", np.uint8).astype(np.uint32)
    found = np.zeros(WIDTH, bool)
    code = data
    for size in range(2, max(SIZES) + 1):
        code = (code[:-1] << np.uint32(8)) | data[size - 1 :]
        if size in SIZES and len(code):
            mixed = (code + np.uint32(size)) * np.uint32(2654435761)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(2246822519)
            found[mixed >> np.uint32(32 - WIDTH_BITS)] = True
    return found


def kernel(present: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of texts with the landmarks, some texts at a time."""
    marks = _unit(landmarks).T
    return np.concatenate([_unit(present[a : a + BATCH]) @ marks for a in range(0, len(present), BATCH)])


def _unit(present: np.ndarray) -> np.ndarray:
    found = present.astype(np.float32)
    found /= np.sqrt(np.maximum(present.sum(axis=1), 1)).astype(np.float32)[:, None]
    return found


class Model:
    """One matrix from presence to one score per language.

    Kernel values with the landmarks are a product, and so are the regressions on them, so
    both fold into a matrix of a column per language; tasks need nothing else.
    """

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.languages = languages
        self.matrix = (_unit(landmarks).T @ weights).astype(np.float32)

    def scores(self, present: np.ndarray) -> np.ndarray:
        return present.astype(np.float32) @ self.matrix / np.sqrt(np.maximum(present.sum(axis=1), 1))[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score (0 to 1) and one-versus-rest value (about -1 to 1) of each text."""
        names, values, raw = [UNKNOWN] * len(texts), [0.0] * len(texts), [-1.0] * len(texts)
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        if known:
            one = self.scores(np.array([presence(texts[i]) for i in known])).astype(float)
            score = one * SHARPNESS
            share = np.exp(score - score.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            for i, best, row, own in zip(known, share.argmax(axis=1), share, one, strict=True):
                names[i], values[i], raw[i] = self.languages[best], float(row[best]), float(own[best])
        return names, values, raw


def fit(landmarks: np.ndarray, features: np.ndarray, labels: list[str]) -> Model:
    """Nyström features and ridge regressions; ``features`` are kernels with the landmarks."""
    languages = sorted(set(labels))
    count = np.maximum(landmarks.sum(axis=1), 1).astype(float)
    among = (landmarks.astype(np.float32) @ landmarks.T.astype(np.float32)) / np.sqrt(np.outer(count, count))
    values, vectors = np.linalg.eigh(among)
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    mapped = features @ whiten
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # Every language weighs the same, however many rows it has.
    weight = np.array([1.0 / labels.count(x) for x in labels])[:, None]
    gram = mapped.T @ (mapped * weight) + RIDGE * np.eye(mapped.shape[1])
    return Model(languages, landmarks, whiten @ np.linalg.solve(gram, mapped.T @ (target * weight)))


def train(rows: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from labelled rows; rows without text, label or id are left out.

    Fitted on the rows with the smallest hashes of their ids: at most ROWS_PER_LANGUAGE of
    a language and MAX_ROWS in all, of which LANDMARKS_PER_LANGUAGE and MAX_LANDMARKS are
    landmarks. Only these ids and, per row, one bit per n-gram come to the driver.
    """
    usable = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(doc_id).isNotNull())
    order = [F.xxhash64(doc_id), F.col(doc_id)]
    ranked = usable.select(doc_id, lang).withColumn("_rank", F.row_number().over(Window.partitionBy(lang).orderBy(*order)))
    chosen = ranked.where(F.col("_rank") <= ROWS_PER_LANGUAGE).orderBy("_rank", *order, lang).limit(MAX_ROWS).collect()
    if not chosen:
        return Model([], np.zeros((1, WIDTH), bool), np.zeros((1, 1)))
    sample = usable.where(F.col(doc_id).isin([r[0] for r in chosen])).select(doc_id, lang, text)

    def bits(batches):
        for batch in batches:
            packed = [np.packbits(presence(t)).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["id", "lang", "bits"])

    id_type = rows.schema[doc_id].dataType.simpleString()
    found = sample.mapInArrow(bits, f"id {id_type}, lang string, bits binary").dropDuplicates().collect()
    rank = {(r[0], r[1]): r[2] for r in chosen}
    found = sorted((r for r in found if (r[0], r[1]) in rank), key=lambda r: (rank[r[0], r[1]], r[1], r[2]))
    present = np.unpackbits(np.frombuffer(b"".join(r[2] for r in found), np.uint8)).reshape(len(found), WIDTH).view(bool)
    labels = [r[1] for r in found]
    marks = [i for i, r in enumerate(found) if rank[r[0], r[1]] <= LANDMARKS_PER_LANGUAGE][:MAX_LANDMARKS]
    landmarks = present[marks]
    model = fit(landmarks, kernel(present, landmarks), labels)
    del found, present, landmarks
    give_back()
    return model


def identify(
    docs: DataFrame, model: Model, text: str = "text", lang_name: str = "lang_pred", score_name: str = "score", raw_name: str | None = None
) -> DataFrame:
    """``docs`` with the predicted language and its score; the text is the only input.

    A text that is null or has no letter gets ``und`` and 0. ``raw_name`` adds the
    one-versus-rest value, which doesn't depend on the other languages (-1 for ``und``).
    """
    @F.arrow_udf("struct<lang:string,score:double,raw:double>")
    def predicted(texts: pa.Array) -> pa.Array:
        names, values, raw = [], [], []
        for first in range(0, len(texts), BATCH):
            some = model.predict(texts.slice(first, BATCH).to_pylist())
            names += some[0]
            values += some[1]
            raw += some[2]
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(values, pa.float64()), pa.array(raw, pa.float64())], ["lang", "score", "raw"]
        )

    kept = [F.col(f"`{c}`") for c in docs.columns]
    both = docs.select(F.struct(*kept).alias("_row"), predicted(F.col(text)).alias("_found"))
    found = [("lang", lang_name), ("score", score_name), *([("raw", raw_name)] if raw_name else [])]
    return both.select("_row.*", *[F.col(f"_found.{c}").alias(name) for c, name in found])


def least_raw(docs: DataFrame, quantile: float, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> float:
    """The one-versus-rest value that all but ``quantile`` of the labelled rows reach whose fold a model did not see.

    Rows without a letter, and in languages that only this fold has, are left out. Where
    the rows are too few to have that quantile, it is 0, where a language is as likely as not.
    """
    held = in_fold(doc_id, 5, 0)
    model = train(docs.where(~held), doc_id, text, lang)
    unseen = docs.where(held & F.col(lang).isin(model.languages)).select(F.col(text).alias("text"))
    found = identify(unseen, model, raw_name="raw").where(F.col("lang_pred") != UNKNOWN)
    row = found.agg(F.count("*").alias("n"), F.percentile_approx("raw", quantile, 100_000).alias("least")).first()
    return row.least if row.n * quantile >= 1 else 0.0


def in_fold(doc_id: str, folds: int, fold: int) -> Column:
    """Whether the checksum of the id as text leaves ``fold`` (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def op10_string_kernel(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir).withColumn("held_out", in_fold("doc_id", 5, 0))
    model = train(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
