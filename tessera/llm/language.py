"""Language identification by blended-spectrum string kernels, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.registry import query, table

#: Lengths of the n-grams, in code points of the lower-cased text.
GRAMS = (1, 2, 3)
#: Slots of the presence vector that n-grams are hashed to.
SLOTS = 1 << 15
#: Bound of the training sample, and of the landmarks among it; each language has one text of either at least.
TRAIN_ROWS, LANDMARKS = 2_000, 256
RIDGE = 1e-2
#: Steepness of the scores' normalisation to shares.
SHARPNESS = 8.0
#: Texts multiplied at a time.
BATCH = 64
UNKNOWN = "und"
_STEP = 1 << 16


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def presence(text: str) -> np.ndarray:
    """Which slots the n-grams of a whole text reach; long texts are read in overlapping steps."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    seen = np.zeros(SLOTS, bool)
    shift = np.uint64(64 - SLOTS.bit_length() + 1)
    for at in range(0, len(points), _STEP):
        some = points[at:at + _STEP + max(GRAMS) - 1]
        code = np.zeros(len(some), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            if len(some) < n:
                break
            code = code[:len(some) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + some[n - 1:] + np.uint64(n)
            if n in GRAMS:
                mixed = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                seen[(mixed >> shift).astype(np.int64)] = True
    return seen


@dataclass(frozen=True)
class LanguageModel:
    """One column of ``weights`` per language: landmark presence times the regression's coefficients."""

    languages: tuple[str, ...]
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Regression values of texts, as one matrix product.

        The kernel of a text with a landmark is their number of shared n-grams over the root of both counts. It is
        linear in the presence vectors, so ``kernel(texts, landmarks) @ coefficients`` is
        ``presence(texts) @ (landmarks.T @ coefficients)`` up to the texts' norms.
        """
        found = np.stack([presence(t) for t in texts]).astype(np.float32)
        norms = np.sqrt(np.maximum(1, found.sum(axis=1)))
        return found @ self.weights / norms[:, None]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        raw = SHARPNESS * self.scores(texts).astype(np.float64)
        shares = np.exp(raw - raw.max(axis=1, keepdims=True))
        shares /= shares.sum(axis=1, keepdims=True)
        best = shares.argmax(axis=1)
        return [self.languages[k] for k in best], shares[np.arange(len(best)), best].tolist()


def _hash_limit(rows: int, wanted: int) -> int:
    """Largest 64-bit hash of about ``wanted`` of ``rows`` different texts."""
    return 2**63 - 1 if rows <= wanted else -2**63 + wanted * 2**64 // rows


def training_sample(docs: DataFrame, max_rows: int = TRAIN_ROWS) -> list[tuple[str, bytes]]:
    """Language and packed presence of at most ``max_rows`` texts, spread evenly over all languages (one text each if
    there are more languages than that), by language and text hash.

    Texts are those of the smallest hashes within each language, copies once, so the sample depends on content only.
    The limit of the hashes follows from the different texts of a language, so copies take no places: each language has
    as many texts as it is due, or all that it has.
    What reaches the driver is bounded by ``max_rows`` times ``SLOTS`` bits.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")).select("lang", "text")
    different = usable.select("lang", F.xxhash64("text").alias("h")).distinct()
    counts = different.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return []
    each = max(1, max_rows // len(counts))
    limit = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(_hash_limit(r["n"], 4 * each + 64)))])[F.col("lang")]
    few = usable.withColumn("h", F.xxhash64("text")).where(F.col("h") <= limit)
    once = few.groupBy("lang", "h").agg(F.first("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("h")
    chosen = once.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each)

    def features(batches):
        for batch in batches:
            rows = [(lang, h, np.packbits(presence(t)).tobytes())
                    for lang, h, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.binary()))],
                                             names=["lang", "h", "bits"])

    found = chosen.select("lang", "h", "text").mapInArrow(features, "lang string, h long, bits binary").collect()
    return [(lang, bits) for lang, _, bits in sorted((r["lang"], r["h"], bytes(r["bits"])) for r in found)]


def fit(sample: list[tuple[str, bytes]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel | None:
    """One-versus-rest kernel ridge regression on Nyström landmarks, the first of each language in the order of the sample
    (which is that of text hashes, so neither short nor long texts are preferred); None without a sample."""
    if not sample:
        return None
    languages = tuple(sorted({lang for lang, _ in sample}))
    chosen = [x for lang in languages for x in [bits for own, bits in sample if own == lang][:max(1, landmarks // len(languages))]]

    def unit(packed: list[bytes]) -> np.ndarray:
        rows = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1), axis=1).astype(np.float32)
        return rows / np.sqrt(np.maximum(1, rows.sum(axis=1)))[:, None]

    marks = unit(chosen)
    kernel = np.concatenate([unit([bits for _, bits in sample[k:k + 256]]) @ marks.T for k in range(0, len(sample), 256)]).astype(np.float64)
    among = (marks @ marks.T).astype(np.float64)
    target = np.array([[float(lang == own) for own in languages] for lang, _ in sample])
    system = kernel.T @ kernel + ridge * len(sample) / len(chosen) * among + 1e-6 * np.eye(len(chosen))
    return LanguageModel(languages, (marks.T @ np.linalg.solve(system, kernel.T @ target).astype(np.float32)))


def learn(docs: DataFrame, max_rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS) -> LanguageModel | None:
    return fit(training_sample(docs, max_rows), landmarks)


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row of ``docs(doc_id, text)``, read where it lies.

    Texts that are null or have no letter are ``und`` with score 0, as are all texts where nothing could be learned.
    Repeated rows and rows without ``doc_id`` stay; equal texts get equal predictions. Very long texts are read whole, in
    steps. Other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            for at in range(0, batch.num_rows if shared.value else 0, BATCH):
                texts = batch.column(1)[at:at + BATCH].to_pylist()
                read = [k for k, t in enumerate(texts) if has_letter(t)]
                if read:
                    for k, name, score in zip(read, *shared.value.predict([texts[k] for k in read]), strict=True):
                        names[at + k], scores[at + k] = name, score
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    """A quarter of the documents, by the checksum of their ids; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def known_language(docs: DataFrame, least_score: float = 0.4) -> DataFrame:
    """``docs`` whose language is identified with at least ``least_score``, learned from the same documents' ``lang``
    without the held-out quarter. Null texts and texts without a letter go; if nothing can be learned, texts with a letter
    stay. Repeated rows are kept or go together. All columns are carried, whatever their names; an empty table stays
    empty."""
    model = learn(docs.where(~held_out()))
    columns = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            text = batch.column(columns.index("text"))
            for at in range(0, batch.num_rows, BATCH):
                texts = text[at:at + BATCH].to_pylist()
                read = [k for k, t in enumerate(texts) if has_letter(t)]
                if read:
                    scores = shared.value.predict([texts[k] for k in read])[1] if shared.value else [1.0] * len(read)
                    keep[[at + k for k in read]] = np.array(scores) >= least_score
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for every document; no SQL: tests check accuracy on the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    return identify(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")
