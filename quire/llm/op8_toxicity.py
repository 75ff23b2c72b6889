"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character 3- to 5-grams (with word ends marked, hashed), so an
unseen misspelling shares most of them with the word it comes from. A window's vector is the mean over its
words; the softmax on top gives the window's probability. A text scores as its highest window of a few
neighbouring words, so a few words in a long text are not averaged away.

Training alternates, on a bounded sample of labelled documents (at most about `sample` documents and `most_chars`
characters, of smallest id hash; none alone has over an eighth of these): pick each text's highest window under the
present model (at first under each n-gram's log odds), then descend jointly on n-gram vectors and the softmax's weights
(Adagrad). With vectors and weights fixed the difference of the two classes' logits is linear in the n-grams, so executors
get one number an n-gram.

Defined cases: a null or empty text, or one without words, has score 0 and predicted 0; very long texts are scored whole; with no
labels of both kinds every score is 0; repeated rows and rows without an id each get a row, the latter are never learned from;
a document with several labels counts as toxic if any is; the first of equal windows is learned from; an empty table gives an
empty result; further columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quire.llm.common import crc_of_id, map_rows

BITS = 18
#: Stripped from either end of a word.
EDGES = "\"'`.,;:!?()[]{}<>|/\\-_*#%&$+=~"
#: Words a window has.
WINDOW = 2
#: Words known by their bare form at once; then forgotten.
KNOWN = 200_000


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, starts): hashed 3- to 5-grams of each <word>, the words one after another; each has at least one."""
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(points))
    found, owner = [], []
    with np.errstate(over="ignore"):
        h = points * np.uint32(0x9E3779B1)
        for n in (2, 3, 4, 5):
            last = np.zeros(len(points), np.uint32)
            last[: len(points) - n + 1] = points[n - 1 :]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + last * np.uint32(0xC2B2AE3D) + np.uint32(n)
            inside = at + n <= ends
            if n == 2:  # only a word of no letters has nothing longer
                inside &= np.repeat(sizes == 2, sizes)
            mixed = h[inside]
            mixed = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0x27D4EB2F)
            found.append(mixed >> np.uint32(32 - BITS))
            owner.append(word[inside])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order].astype(np.int64), np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(words)))))


class Words(dict):
    """The number of each bare word; a chunk between white space is looked up as it stands."""

    def __init__(self):
        self.bare: dict[str, int] = {}

    def __missing__(self, chunk: str) -> int:
        word = chunk.lower().strip(EDGES) or chunk
        self[chunk] = n = self.bare.setdefault(word, len(self.bare))
        return n


def windows(values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, start, end) of the windows; a text shorter than one has one."""
    starts = np.arange(0, max(1, len(values) - window // 2), window // 2)
    ends = np.minimum(starts + window, len(values))
    sums = np.concatenate(([0.0], np.cumsum(values)))
    return (sums[ends] - sums[starts]) / (ends - starts), starts, ends


def train(texts: list[str], toxic: np.ndarray, window: int = WINDOW, size: int = 8, rounds: int = 3, epochs: int = 15, seed: int = 1) -> tuple[np.ndarray, float]:
    """(difference of the two classes' logits for each n-gram's bucket, and of their biases).

    Vectors start along one direction, by each n-gram's log odds shrunk towards none where it is rare. Their steps are
    damped by the gradients of the common ones, so an n-gram that few texts have hardly moves."""
    known = Words()
    docs = [np.array([known[c] for c in t.split()], np.int64) for t in texts]
    keep = [i for i, d in enumerate(docs) if len(d)]
    docs, toxic = [docs[i] for i in keep], toxic[keep].astype(bool)
    if not len(docs) or toxic.all() or not toxic.any():
        return np.zeros(1 << BITS, np.float32), -1e9
    buckets, starts = subwords(list(known.bare))
    counts = np.diff(starts)

    def spread(words: np.ndarray) -> np.ndarray:
        """Where the n-grams of these words stand in buckets."""
        reach = counts[words]
        return np.repeat(starts[words] - np.cumsum(reach) + reach, reach) + np.arange(reach.sum())

    def word_means(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values[buckets], starts[:-1]) / counts

    seen = np.zeros((2, 1 << BITS))  # texts that have the n-gram, by label
    for d, label in zip(docs, toxic):
        seen[int(label), np.unique(buckets[spread(np.unique(d))])] += 1
    share = toxic.mean()
    odds = np.log((seen[1] + 2 * share) / share) - np.log((seen[0] + 2 * (1 - share)) / (1 - share))
    rng = np.random.default_rng(seed)
    weights = rng.choice((-1.0, 1.0), size) / np.sqrt(size)
    vectors = odds[:, None] * weights + rng.normal(0, 0.01, (1 << BITS, size))
    # the softmax: a column and a bias for each class
    softmax, bias = np.stack((-weights, weights), 1), np.array([1.0, -1.0])
    past_v, past_w, past_b = None, 1e-4, 1e-4
    marks = np.stack((~toxic, toxic), 1)
    score = word_means(vectors @ (softmax[:, 1] - softmax[:, 0]))
    for _ in range(rounds):
        bags = []
        for d in docs:
            means, a, b = windows(score[d], window)
            best = int(np.argmax(means))
            bags.append(d[a[best] : b[best]])
        words = np.concatenate(bags)
        sub = buckets[spread(words)]
        lengths = np.array([len(b) for b in bags])
        row = np.repeat(np.repeat(np.arange(len(bags)), lengths), counts[words])
        part = 1 / (np.repeat(counts[words], counts[words]) * lengths[row])
        used, inverse = np.unique(sub, return_inverse=True)
        row_starts = np.searchsorted(row, np.arange(len(bags)))
        balance = np.where(toxic, 0.5 / share, 0.5 / (1 - share)) / len(bags)
        for _ in range(epochs):
            means = np.add.reduceat(vectors[sub] * part[:, None], row_starts, axis=0)
            logits = np.clip(means @ softmax + bias, -30, 30)
            chances = np.exp(logits - logits.max(1, keepdims=True))
            error = (chances / chances.sum(1, keepdims=True) - marks) * balance[:, None]
            # the two classes' errors are opposite, so one sum an n-gram does for both
            slope = np.bincount(inverse, error[row, 1] * part, len(used))[:, None] * (softmax[:, 1] - softmax[:, 0])
            push, base = means.T @ error, error.sum(0)
            if past_v is None:
                past_v = np.full((1 << BITS, size), np.quantile(np.abs(slope).max(1), 0.999) ** 2)
            past_v[used] += slope**2
            vectors[used] -= 0.2 * slope / np.sqrt(past_v[used])
            past_w += (push**2).sum() / 2
            softmax -= 0.25 * push / np.sqrt(past_w)
            past_b += (base**2).sum() / 2
            bias -= 0.25 * base / np.sqrt(past_b)
        score = word_means(vectors @ (softmax[:, 1] - softmax[:, 0]))
    return (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def learn(docs: DataFrame, labels: DataFrame, sample: int = 6000, most_chars: int = 1 << 24) -> tuple[np.ndarray, float]:
    """Trains on a sample of the labelled documents whose id isn't held out, bounded in documents and in characters."""
    own = labels.where("toxic is not null and doc_id is not null").where(crc_of_id() % 3 != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = F.length("text")
    rows = docs.select("doc_id", "text").where("text is not null").where(size <= most_chars // 8)
    n, chars = rows.select("doc_id", size.alias("size")).join(own, "doc_id").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = min(1.0, sample / max(1, n), most_chars / max(1, chars))
    chosen = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 30)) < share * (1 << 30)
    # one id may have many rows: the sample's bound holds for those too
    drawn = rows.where(chosen).join(own.where(chosen), "doc_id").select("doc_id", "text", "toxic").limit(2 * sample)
    texts, marks = [], []
    for r in sorted(drawn.toLocalIterator(), key=lambda r: (r["doc_id"], r["text"])):
        texts.append(r["text"])
        marks.append(r["toxic"])
    return train(texts, np.array(marks, dtype=np.int64))


def score(docs: DataFrame, model: tuple[np.ndarray, float], window: int = WINDOW) -> DataFrame:
    """doc_id, score."""
    logits, bias = model
    schema = StructType([docs.select("doc_id").schema["doc_id"], StructField("score", DoubleType())])
    cache: dict = {}

    def run(ids, texts):
        known, values = cache.get("words"), cache.get("values")
        if known is None or len(known) > KNOWN:
            known, values = Words(), np.zeros(0, np.float32)
        split = [np.array([known[c] for c in t.split()], np.int64) if t else np.zeros(0, np.int64) for t in texts]
        if fresh := list(known.bare)[len(values) :]:
            buckets, starts = subwords(fresh)
            values = np.concatenate((values, np.add.reduceat(logits[buckets], starts[:-1]) / np.diff(starts)))
        cache["words"], cache["values"] = known, values
        scores = [float(1 / (1 + np.exp(-np.clip(windows(values[d].astype(np.float64), window)[0].max() + bias, -30, 30)))) if len(d) else 0.0 for d in split]
        return {"doc_id": ids, "score": scores}

    return map_rows(docs, ["doc_id", "text"], run, schema, size=512)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs, learn(docs, labels))
    return found.select("doc_id", (crc_of_id() % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
