"""Exact substring removal by distributed prefix doubling over sampled suffixes.

A byte goes if a 100-byte string that covers it also starts earlier. Prefix doubling ranks strings by a first few
bytes, then by rank pairs at growing offsets, until a rank is unique or the threshold is passed. Here

* names stand for ranks (64-bit mixes of the two halves' names), so doubling up to 64 bytes needs no shuffle;
* only strings that any 100-byte string must agree on are ranked by Spark: in each 100-byte window the leftmost
  smallest 50-byte name is its anchor. Equal windows have equal anchors at equal places, and about one position in
  26 is an anchor. The windows that share an anchor are a run of neighbours;
* Spark sorts (rank at 50, rank of the run's bytes, document, place). Unique ranks are done. Equal runs are copies from
  the second on. Where one rank has several different runs, the runs' first copies go to the next round, with their bytes;
* each round cuts the runs that came to it into cells, the same ones as seen from the anchor: the windows of a cell share
  88, 97, then 100 bytes, which are ranked by pairs of names at offsets 24, 33 and 36 and sorted again. So ranks grow from
  50 to 100 bytes, and a round has only what the one before left undecided. Past 100 bytes nothing more is asked.

Before each sort a slice of rows keeps the earliest of equal ranks only. The others are copies already; neighbours
are merged into one span that goes past the sort, so a hot string brings one row a slice. Rows of one rank are read as a
stream, never gathered.

Names are 64 bits wide and a run needs two of them to agree: 128 bits.

Defined cases: null text is empty; texts under 100 bytes lose nothing; very long texts go in slices; an empty table gives
an empty result; where doc_id repeats, is null or is no whole number, rows are numbered by doc_id, null before all others,
and rows of one doc_id are told apart and put in an arbitrary but fixed order; further columns are not read, whatever
their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, IntegralType, LongType, StringType, StructField, StructType

from quire.llm.common import parts
from quire.session import written

LEAST = 100
GRAM = 50
REACH = LEAST - GRAM + 1
#: Windows of a cell in each round after the first; the last round has single windows.
CELLS = (13, 4, 1)
#: Bytes ranked at once; longer texts go in slices that overlap by LEAST.
SLICE = 1 << 19

# more: of a run its anchor's place << 8 | its windows less one; of a copy that needs no sort -1 - its windows less one
RANKS = StructType([StructField("rank", LongType()), StructField("next", LongType()), StructField("uid", LongType()), StructField("at", IntegerType()), StructField("more", IntegerType())])
# more: of a copy (copy 1) its windows less one, of a run that is undecided (copy 0) as in RANKS
FOUND = StructType([StructField("uid", LongType()), StructField("at", IntegerType()), StructField("more", IntegerType()), StructField("copy", IntegerType())])
RUNS = StructType([StructField("uid", LongType()), StructField("at", IntegerType()), StructField("more", IntegerType()), StructField("anchor", IntegerType()), StructField("bytes", BinaryType())])
RANK_FIELDS = pa.schema([("rank", pa.int64()), ("next", pa.int64()), ("uid", pa.int64()), ("at", pa.int32()), ("more", pa.int32())])
FOUND_FIELDS = pa.schema([("uid", pa.int64()), ("at", pa.int32()), ("more", pa.int32()), ("copy", pa.int32())])


def pair(a: np.ndarray, b: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """The name of two neighbouring names, for the n-th step."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x += b
    x *= np.uint64(0xBF58476D1CE4E5B9) + np.uint64(2) * np.asarray(n, np.uint64)
    x ^= x >> np.uint64(32)
    return x


def doubled(data: np.ndarray, upto: int) -> dict[int, np.ndarray]:
    """Names of all strings of 32 and, if upto is 64, 64 bytes; index i is the string from i on."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    size, names = 1, {}
    while size < upto:
        h = pair(h[: len(h) - size], h[size:], size) if len(h) > size else h[:0]
        size *= 2
        if size >= 32:
            names[size] = h
    return names


def least(keys: np.ndarray, reach: int) -> np.ndarray:
    """Minimum of each reach neighbouring keys."""
    size = 1
    while 2 * size <= reach:
        keys = np.minimum(keys[: len(keys) - size], keys[size:])
        size *= 2
    rest = reach - size
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def slices(uids: list[int], texts: list[bytes]):
    """(bytes, uid of each window start, its place in its text, index of valid window starts): several texts, or a slice of a long one."""
    held, held_size = [], 0
    for uid, text in zip(uids, texts):
        if len(text) < LEAST:
            continue
        for start in range(0, len(text) - LEAST + 1, SLICE):
            part = text[start : start + SLICE + LEAST - 1]
            held.append((uid, start, part))
            held_size += len(part)
            if held_size >= SLICE:
                yield _slice(held)
                held, held_size = [], 0
    if held:
        yield _slice(held)


def _slice(parts):
    data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
    sizes = np.array([len(p) for _, _, p in parts])
    begins = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(parts)), sizes - LEAST + 1)
    valid = np.arange(len(own)) + np.repeat(np.arange(len(parts)) * (LEAST - 1), sizes - LEAST + 1)
    return data, np.array([u for u, _, _ in parts], np.int64), np.array([s for _, s, _ in parts], np.int64), begins, own, valid


def runs(data, uids, shifts, begins, own, valid):
    """Anchor runs: arrays of RANKS. A run is windows at .. at + more of a text."""
    names = doubled(data, 64)
    h32, h64 = names[32], names[64]
    gram = pair(h32[: len(h32) - 18], h32[18:], 50)
    smallest = least((gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64), REACH)
    anchor = (smallest[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(valid), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(valid)) - 1
    p0, p1, a = valid[first], valid[last], anchor[first]
    # the two 64-byte names and the anchor's 50 bytes cover the run's bytes
    shape = (a - p0) << 8 | (p1 - p0)
    rest = pair(pair(h64[p0], h64[p1 + 36], 64), shape.astype(np.uint64), 65)
    part = own[first]
    return gram[a].view(np.int64), rest.view(np.int64), uids[part], (shifts[part] + p0 - begins[part]).astype(np.int32), shape.astype(np.int32)


def cells(data, uid, base, at, more, wide: int):
    """The runs' cells of so many windows: arrays of RANKS. base is the place in data of a run's first byte."""
    h64 = doubled(data, 64)[64]
    ahead, least_ahead = more >> 8, (more >> 8) - (more & 255)
    first = least_ahead // wide
    n = ahead // wide - first + 1
    own = np.repeat(np.arange(len(n)), n)
    cell = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    # the anchor is `low` to `high` bytes after the start of a cell's windows, and from `here` to `there` in this run's
    low = cell * wide
    high = np.minimum(low + wide - 1, REACH - 1)
    here, there = np.maximum(low, least_ahead[own]), np.minimum(high, ahead[own])
    anchor = base[own] + ahead[own]
    size = LEAST - (high - low)
    rank = pair(h64[anchor - low], h64[anchor - low + size - 64], size)
    shape = there << 8 | (there - here)
    rest = pair(pair(h64[anchor - there], h64[anchor - here + 36], 64), shape.astype(np.uint64), 65)
    return rank.view(np.int64), rest.view(np.int64), uid[own], (at[own] + ahead[own] - there).astype(np.int32), shape.astype(np.int32)


def collapse(rank, rest, uid, at, more):
    """The earliest of equal ranks stay; the others, being copies, become spans, marked by more = -1 - windows less one."""
    order = np.lexsort((at, uid, rest, rank))
    same = np.zeros(len(order), bool)
    same[1:] = (rank[order][1:] == rank[order][:-1]) & (rest[order][1:] == rest[order][:-1])
    copy = np.zeros(len(order), bool)
    copy[order[same]] = True
    own, starts, last = uid[copy], at[copy], at[copy] + (more[copy] & 255)
    order = np.lexsort((starts, own))
    own, starts, last = own[order], starts[order], last[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != last[:-1] + 1)
    first = np.flatnonzero(new)
    ends = last[np.append(first[1:], len(own)) - 1] if len(own) else last
    zeros = np.zeros(len(first), np.int64)
    columns = [(rank[~copy], zeros), (rest[~copy], zeros), (uid[~copy], own[first]), (at[~copy], starts[first]), (more[~copy], starts[first] - ends - 1)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(x.dtype)) for c, x in zip(columns, (rank, rest, uid, at, more))], schema=RANK_FIELDS)


def _texts(column) -> list[bytes]:
    return [t.encode() if t else b"" for t in column.to_pylist()]


def first_ranks(docs: DataFrame) -> DataFrame:
    """RANKS of every run of every text."""

    def run(batches):
        for batch in batches:
            for part in parts(batch, 1024):
                for s in slices(part.column(0).to_pylist(), _texts(part.column(1))):
                    yield collapse(*runs(*s))

    return docs.select("uid", "text").mapInArrow(run, RANKS)


def sorted_ranks(ranks: DataFrame, several: bool) -> DataFrame:
    """FOUND: copy 1 for what also starts earlier, and, if several, copy 0 for the first of each rest where a rank has more than one."""
    key = F.when(F.col("more") < 0, F.xxhash64("uid", "at")).otherwise(F.col("rank"))  # marked copies go anywhere
    dealt = ranks.withColumn("deal", key).repartition(F.col("deal")).sortWithinPartitions("rank", "next", "uid", "at").drop("deal")

    def run(batches):
        last = None  # rank and rest of the row before
        waiting = None  # the last first row of a rest: its fields, and whether the rest before it has the same rank

        def batch_of(*parts):
            uid, at, more = (np.concatenate([p[i] for p in parts]) for i in range(3))
            copy = np.concatenate([np.full(len(p[0]), p[3], np.int32) for p in parts])
            return pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(at, pa.int32()), pa.array(more, pa.int32()), pa.array(copy)], schema=FOUND_FIELDS)

        for batch in batches:
            rank, rest, uid, at, more = (batch.column(i).to_numpy() for i in range(5))
            marked = more < 0
            out = [(uid[marked], at[marked], -1 - more[marked], 1)]
            rank, rest, uid, at, more = (x[~marked] for x in (rank, rest, uid, at, more))
            if len(rank):
                first = np.ones(len(rank), bool)
                first[1:] = (rank[1:] != rank[:-1]) | (rest[1:] != rest[:-1])
                first[0] = last != (rank[0], rest[0])
                last = rank[-1], rest[-1]
                out.append((uid[~first], at[~first], more[~first] & 255, 1))
                if several and first.any():
                    heads = [x[first] for x in (rank, uid, at, more)]
                    before = np.zeros(len(heads[0]), bool)
                    before[1:] = heads[0][1:] == heads[0][:-1]
                    if waiting is not None:
                        before[0] = heads[0][0] == waiting[0][0]
                        heads = [np.concatenate((w, h)) for w, h in zip(waiting[:4], heads)]
                        before = np.concatenate(([waiting[4]], before))
                    send = before[:-1] | before[1:]
                    out.append((*(h[:-1][send] for h in heads[1:]), 0))
                    waiting = (*(h[-1:] for h in heads), before[-1])
            if any(len(p[0]) for p in out):
                yield batch_of(*out)
        if waiting is not None and waiting[4]:
            yield batch_of((*waiting[1:4], 0))

    return dealt.mapInArrow(run, FOUND)


def _lists(found: DataFrame, *keys: str) -> DataFrame:
    """The keys, and own: at and more of each of their rows, by at."""
    return found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "more"))).alias("own"))


def run_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """RUNS: the wanted runs with the place of their anchor and their bytes, 150 at most."""
    rows = docs.select("uid", "text").join(_lists(wanted, "uid"), "uid")

    def run(batches):
        for batch in batches:
            for part in parts(batch, 64):
                for i, (uid, text) in enumerate(zip(part.column(0).to_pylist(), _texts(part.column(1)))):
                    struct = part.column(2)[i].values
                    at, more = struct.field(0).to_numpy(), struct.field(1).to_numpy()
                    spans = [text[a:b] for a, b in zip(at.tolist(), (at + (more & 255) + LEAST).tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), uid)), pa.array(at), pa.array(more), pa.array(at + (more >> 8)), pa.array(spans, pa.binary())], names=[f.name for f in RUNS])

    return rows.mapInArrow(run, RUNS)


def next_ranks(runs_: DataFrame, wanted: DataFrame | None, wide: int) -> DataFrame:
    """RANKS of the cells of so many windows of the runs, or of the wanted parts of the runs.

    A part has its run's document and anchor; a run that a slice of its text cut in two shares both, and takes what
    lies in it."""
    own = F.array(F.struct("at", "more"))
    if wanted is not None:
        parts_ = _lists(wanted.withColumn("anchor", F.col("at") + F.shiftright("more", 8)), "uid", "anchor")
        runs_, own = runs_.join(parts_, ["uid", "anchor"]), F.col("own")

    def run(batches):
        for batch in batches:
            for part in parts(batch, 4096):
                uid, at, more, lists = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_numpy(), part.column(4)
                spans = part.column(3).to_pylist()
                data = np.frombuffer(b"".join(spans), np.uint8)
                begins = np.cumsum([0, *map(len, spans)])[:-1]
                n = lists.value_lengths().to_numpy()
                of = np.repeat(np.arange(len(n)), n)
                inner = lists.flatten()
                a, m = inner.field(0).to_numpy(), inner.field(1).to_numpy()
                here = (a >= at[of]) & (a <= at[of] + (more[of] & 255))
                of, a, m = of[here], a[here], m[here].astype(np.int64)
                if len(of):
                    yield collapse(*cells(data, uid[of], begins[of] + a - at[of], a, m, wide))

    return runs_.select("uid", "at", "more", "bytes", own.alias("own")).mapInArrow(run, RANKS)


def numbered(docs: DataFrame) -> DataFrame:
    """uid, doc_id, text: uid is doc_id where that tells rows apart, else a number that rises with doc_id."""
    kept = docs.select("doc_id", "text")
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n"), F.count_if(F.col("doc_id").isNull())).first()
        if (ids[0] or 0) <= 1 and not ids[1]:
            return kept.select(F.col("doc_id").cast("long").alias("uid"), "doc_id", "text")
    tasks = max(1, docs.rdd.getNumPartitions())
    ordered = kept.repartitionByRange(tasks, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return written(ordered.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text"), "suffix-docs")


def copies(rows: DataFrame) -> DataFrame:
    """uid, at, more: windows at .. at + more of the text also start earlier. Overlaps are left."""
    found = written(sorted_ranks(first_ranks(rows), True), "suffix-found")
    done, open_ = [found.where("copy = 1")], found.where("copy = 0")
    runs_ = written(run_bytes(rows, open_), "suffix-runs")
    for i, wide in enumerate(CELLS):
        found = written(sorted_ranks(next_ranks(runs_, open_ if i else None, wide), wide > 1), f"suffix-{wide}")
        done.append(found.where("copy = 1"))
        open_ = found.where("copy = 0")
    return reduce(DataFrame.unionByName, done).drop("copy")


def cut(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """uid, doc_id, text, spans: maximal removed runs as little-endian pairs of 64-bit byte offsets; null if none."""
    schema = StructType([StructField("uid", LongType()), StructField("spans", BinaryType())])

    def merge(batches):
        for batch in batches:
            merged = []
            for i in range(batch.num_rows):
                struct = batch.column(1)[i].values
                a = struct.field(0).to_numpy().astype("<i8")
                b = np.maximum.accumulate(a + struct.field(1).to_numpy() + LEAST)
                new = np.ones(len(a), bool)
                new[1:] = a[1:] > b[:-1]
                first = np.flatnonzero(new)
                merged.append(np.stack((a[first], b[np.append(first[1:], len(a)) - 1]), 1).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(merged, pa.binary())], names=["uid", "spans"])

    return rows.join(_lists(gone, "uid").mapInArrow(merge, schema), "uid", "left")


def query(docs: DataFrame) -> DataFrame:
    rows = numbered(docs)
    spans = cut(rows, copies(rows)).select("doc_id", "text", "spans")
    own = docs.select("doc_id").schema["doc_id"]
    schema = StructType([own, *[StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")], StructField("kept_sha256", StringType())])

    def run(batches):
        for batch in batches:
            sizes, gone, counts, hashes = [], [], [], []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                data = text.encode() if text else b""
                raw = batch.column(2)[i].as_py()
                pairs = np.frombuffer(raw, "<i8").reshape(-1, 2).tolist() if raw else []
                sha, at = hashlib.sha256(), 0
                for a, b in pairs:
                    sha.update(data[at:a])
                    at = b
                sha.update(data[at:])
                sizes.append(len(data))
                gone.append(sum(b - a for a, b in pairs))
                counts.append(len(pairs))
                hashes.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (sizes, gone, counts)], pa.array(hashes)], names=[f.name for f in schema])

    return spans.mapInArrow(run, schema)
