"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased and every run of non-letters becomes one space; bigrams and trigrams are hashed
into buckets. The matrix of log probabilities (languages x buckets, its size a parameter) goes to the
executors inside the task; texts are scored in numpy batches, each as the sum of its n-grams' columns.

Learning reads a bounded sample, the documents of smallest id hash: at most about `per_language` of each of the
`most_languages` most frequent languages. Counting and prediction read all rows, prediction whole texts.

Defined cases: a null or empty text, or one without a letter, is `und` with score 0; with nothing to learn from,
every text is `und`; ties go to the first language by code point; very long texts go in slices that lose no n-gram; rows
without an id count as id '' for what is held out; repeated rows each get a row; an empty table gives an empty result; further
columns are not read by the query and kept by the stage, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField, StructType

from quire.llm.common import crc_of_id, worker_task

#: Characters scored at once.
SLICE = 1 << 18
#: So many n-grams tell whether a text is in any learned language.
EVIDENCE = 20


def letters() -> np.ndarray:
    """For each code point of the basic plane, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def code_points(text: str, is_letter: np.ndarray) -> np.ndarray:
    """Lower-case code points; a run of others is one space, with a space at either end. Empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    keep = is_letter[np.minimum(points, 0xFFFF)]
    if len(high := np.flatnonzero(points > 0xFFFF)):
        keep[high] = [chr(c).isalpha() for c in points[high].tolist()]
    if not keep.any():
        return points[:0]
    points = np.where(keep, points, 32)
    space = ~keep
    points = points[np.concatenate(([True], ~(space[1:] & space[:-1])))]
    return np.concatenate(([32], points, [32])).astype(np.uint32)


def grams(points: np.ndarray, bits: int, again: bool = False) -> np.ndarray:
    """Buckets of all bigrams (but the first, if a slice before had it), then all trigrams; each kind has half of the buckets."""
    half = np.uint32(32 - (bits - 1))
    two = points[:-1] * np.uint32(0x9E3779B1) + points[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + points[2:] * np.uint32(0x27D4EB2F)
    two, three = (two ^ (two >> np.uint32(15))) * np.uint32(0x2C1B3C6D), (three ^ (three >> np.uint32(15))) * np.uint32(0x297A2D39)
    return np.concatenate((two[int(again) :] >> half, (three >> half) + np.uint32(1 << (bits - 1))))


def pieces(points: np.ndarray):
    """(slice, whether its first bigram was in the one before): slices share two points, so no trigram is lost."""
    at = 0
    while at < len(points) - 1:
        end = min(len(points), at + SLICE)
        yield points[at:end], at > 0
        if end == len(points):
            break
        at = end - 2


def learn(docs: DataFrame, bits: int = 16, per_language: int = 1500, smoothing: float = 0.5, most_languages: int = 256) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities as buckets x languages, the last row the prior)."""
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null").where(crc_of_id() % 5 != 0)
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    counts.sort(key=lambda r: r["lang"])
    if not counts:
        return [], np.zeros((1, 0), np.float32)
    languages = [r["lang"] for r in counts]
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_language / r["count"]))])
    chosen = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)
    sample = known.where(chosen).select("lang", "text").repartition("lang")
    schema = StructType([StructField("lang", StringType()), StructField("counts", BinaryType())])

    def count(batches):
        is_letter, found = letters(), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = found.setdefault(lang, np.zeros(1 << bits, np.int64))
                for part, again in pieces(code_points(text, is_letter)):
                    own += np.bincount(grams(part, bits, again), minlength=1 << bits)
        yield pa.RecordBatch.from_pydict({"lang": list(found), "counts": [x.tobytes() for x in found.values()]}, schema=pa.schema([("lang", pa.string()), ("counts", pa.binary())]))

    table = np.zeros((len(languages), 1 << bits))
    for r in sample.mapInArrow(worker_task(count), schema).toLocalIterator():
        table[languages.index(r["lang"])] += np.frombuffer(r["counts"], np.int64)
    # seen buckets only: what no sample has tells nothing apart
    table += smoothing * np.maximum(table.sum(0, keepdims=True) > 0, 1e-9)
    half = table.shape[1] // 2
    for side in (slice(0, half), slice(half, None)):
        table[:, side] /= np.maximum(table[:, side].sum(1, keepdims=True), 1e-300)
    unseen = table.max(0) <= 1e-9 / max(1, half)
    logs = np.log(np.maximum(table, 1e-12))
    logs[:, unseen] = 0
    prior = np.log([r["count"] for r in counts])
    return languages, np.vstack([logs.T, prior - prior.max()]).astype(np.float32)


def classify(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], certain: int = 64) -> DataFrame:
    """The columns keep as k0, k1, ..., then lang_pred, score (the posterior with evidence of at most `certain` n-grams'
    weight) and foreign (the share of n-grams that no learned text has)."""
    languages, logs = model
    bits = int(np.log2(len(logs) - 1)) if len(logs) > 1 else 0
    kept = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col("text"))
    at = keep.index("text") if "text" in keep else len(keep)
    kept = kept.drop("text") if "text" in keep else kept
    names = [f"k{i}" for i in range(len(keep))]
    schema = StructType([*kept.select(*names).schema, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("foreign", DoubleType())])
    matrix = np.ascontiguousarray(logs[:-1])
    prior = logs[-1]
    unseen = (matrix == 0).all(1)

    def run(batches):
        is_letter = letters()
        for batch in batches:
            langs, scores, foreign = [], [], []
            waiting: list[np.ndarray] = []
            bounds: list[int] = []
            sums = np.zeros((batch.num_rows, len(languages)))
            sizes, strange = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)

            def flush():
                if waiting:
                    starts = np.concatenate(([0], np.cumsum([len(x) for x in waiting])[:-1]))
                    found = np.concatenate(waiting)
                    np.add.at(sums, bounds, np.add.reduceat(matrix[found], starts, axis=0))
                    np.add.at(strange, bounds, np.add.reduceat(unseen[found], starts, dtype=np.int64))
                    waiting.clear()
                    bounds.clear()

            held = 0
            texts = batch.column(at)
            for i in range(batch.num_rows if languages else 0):
                text = texts[i].as_py()
                points = code_points(text, is_letter) if text else np.zeros(0, np.uint32)
                if not len(points):
                    continue
                for part, again in pieces(points):
                    found = grams(part, bits, again)
                    sizes[i] += len(found)
                    waiting.append(found)
                    bounds.append(i)
                    held += len(found)
                    if held > SLICE:
                        flush()
                        held = 0
            flush()
            for i in range(batch.num_rows):
                if not sizes[i]:
                    langs.append("und")
                    scores.append(0.0)
                    foreign.append(0.0)
                    continue
                best = int(np.argmax(sums[i] + prior))
                weighed = sums[i] * min(1.0, certain / sizes[i]) + prior
                weighed = np.exp(weighed - weighed.max())
                langs.append(languages[best])
                scores.append(float(weighed[best] / weighed.sum()))
                foreign.append(float(strange[i] / sizes[i]) if sizes[i] >= EVIDENCE else 0.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(names))], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(foreign, pa.float64())], names=[*names, "lang_pred", "score", "foreign"])

    return kept.mapInArrow(worker_task(run), schema)


def query(docs: DataFrame) -> DataFrame:
    found = classify(docs, learn(docs), ["doc_id"]).withColumnRenamed("k0", "doc_id")
    return found.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "lang_pred", "score")


def stage(docs: DataFrame, least: float = 0.0, most_foreign: float = 0.5) -> DataFrame:
    """docs without those of no language: no letter, a score under `least`, or mostly n-grams that no learned text has, as in
    other languages or random letters. Columns stay. A low score alone, as in a text of two languages, drops nothing by default."""
    found = classify(docs, learn(docs), docs.columns)
    good = found.where((F.col("lang_pred") != "und") & (F.col("score") >= least) & (F.col("foreign") <= most_foreign))
    return good.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
