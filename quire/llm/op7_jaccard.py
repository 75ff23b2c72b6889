"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles (64-bit names); texts with equal sets are one node from the start.
Sets are embedded as min-hash coordinates. In each run, a tree splits the nodes: at a tree node every
coordinate is chosen with probability 1 / (similarity * coordinates), the same ones for all sets there, and a set
goes on to the child of each chosen coordinate with its value. Similar sets share a path with a probability that
grows with their similarity. Runs are repeated until the target recall: pairs at the bound are drawn, walked down the
very trees that the join uses, and runs are added until hardly any pair (`miss`) shares no path.

The first two levels are walked where the set is read. Buckets are counted before rows are dealt: single ones go, and
buckets of at most SMALL are compared pair by pair on a sketch of two bits a coordinate, with a margin of four
standard errors. Larger ones are compared with their least member, the leader, and split further. Differences of
sketches obey the triangle inequality, so if the nearest member that isn't like the leader is `lo` apart from it, a
member that is like it and less than `lo` - bound apart can be like none of the others, and has no need to go on. A bucket
whose members are all in one candidate group is settled. A shared path of all levels is rarer than one of two, so sets
that do go on get more runs, until the target holds for them too. A bucket that isn't settled after `levels`
levels is joined whole.

That gives candidate groups (connected components, in DataFrames; a bucket sends a spanning forest of what it found).
Inside a group every pair is then compared by exact Jaccard similarity on whole sets, in blocks of bounded size that
are dealt out apart, so nothing the sketch or the leaders left out within a group is lost, and the number of links is
exact. Final classes are the components of the exact links.

Defined cases: null or wordless texts have no shingles and are classes of their own; texts of under five words have
one shingle, all their words; very long texts go in pieces; copies are links of similarity 1, however many; class_id is
the least doc_id of the class, rows of one doc_id count apart, and a row without an id that is like another takes the least
id there is in its class; a similarity equal to the bound counts; an empty table gives an empty result; further columns
are not read, whatever their names.
"""

from __future__ import annotations

import math
from functools import cache, reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from quire.llm.common import map_rows, parts, worker_task
from quire.llm.components import components
from quire.session import written

COORDINATES = 128
#: Bytes of text named at once.
PIECE = 1 << 20
#: Buckets of up to so many sets are compared pair by pair: at most 4096 comparisons of 32 bytes a row.
SMALL = 4096
#: Buckets of up to so many are compared all at once.
FEW = 32
#: A group's blocks have about so many sets, and about so many shingles.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
MIX1, MIX2, MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX2
    x = (x ^ (x >> np.uint64(27))) * MIX3
    return x ^ (x >> np.uint64(31))


def misses(similarity: float, level: int, pairs: int):
    """After each run, the share of pairs drawn at the bound that share no path of so many levels yet."""
    rng = np.random.default_rng(11)
    one = rng.integers(0, 1 << 32, (pairs, COORDINATES), dtype=np.uint32)
    two = np.where(rng.random(one.shape) < similarity, one, rng.integers(0, 1 << 32, one.shape, dtype=np.uint32))
    left = np.arange(pairs)
    for run in count():
        own, paths = left, np.full(len(left), roots_of(run, 1)[0])
        for _ in range(level):
            # only paths that both sets go down
            (row, path), (row2, path2) = (children(paths, x[own], similarity) for x in (one, two))
            both = np.isin(mixed(path) + row.astype(np.uint64), mixed(path2) + row2.astype(np.uint64))
            own, paths = own[row[both]], path[both]
        left = left[~np.isin(left, own)]
        yield len(left) / pairs


@cache
def runs_for(similarity: float, level: int = 2, miss: float = 0.0001, pairs: int = 20_000) -> int:
    """Runs until pairs at the bound that share no path of so many levels are at most this share."""
    return next(i for i, share in enumerate(misses(similarity, level, pairs), 1) if share <= miss)


def word_names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, name) of each word of some bytes."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    start, end = ~space, ~space
    start[1:] &= space[:-1]
    first = np.flatnonzero(start)
    if not len(first):
        return first, np.zeros(0, np.uint64)
    end[:-1] &= space[1:]
    length = np.flatnonzero(end) + 1 - first
    inside = np.flatnonzero(~space)
    place = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length)
    powers = np.full(int(length.max()) + 1, 0xD6E8FEB86659FD93, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    words = np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * powers[place], np.cumsum(length) - length)
    return first, mixed(words + length.astype(np.uint64) * MIX1)


def chained(words: np.ndarray, n: int) -> np.ndarray:
    """The name of each n neighbouring words."""
    names = words[: max(0, len(words) - n + 1)].copy()
    for k in range(1, n):
        names = mixed(names * MIX1 + words[k : k + len(names)])
    return names


def shingle_sets(texts: list[str | None], n: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle names of each text. Texts share one pass up to PIECE bytes; a longer one goes in pieces."""
    raw = [t.encode() if t else b"" for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(raw):
        end, held = at, 0
        while end < len(raw) and (end == at or held + len(raw[end]) < PIECE):
            held += len(raw[end]) + 1
            end += 1
        if held > PIECE + 1:
            out.append(_long_set(raw[at], n))
        else:
            first, words = word_names(np.frombuffer(b"\n".join(raw[at:end]) + b"\n", np.uint8))
            bounds = np.concatenate(([0], np.searchsorted(first, np.cumsum([len(r) + 1 for r in raw[at:end]]))))
            names = chained(words, n)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                out.append(np.unique(names[a : b - n + 1]) if b - a >= n else chained(words[a:b], b - a) + np.uint64(b - a) if b > a else words[:0])
        at = end
    return out


def _long_set(text: bytes, n: int) -> np.ndarray:
    """The set of one long text: pieces end between words and share n - 1 words."""
    found, before, at, total = [], np.zeros(0, np.uint64), 0, 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = np.concatenate((before, word_names(np.frombuffer(text[at:end], np.uint8))[1]))
        total += len(words) - len(before)
        found.append(np.unique(chained(words, n)))
        before, at = words[max(0, len(words) - n + 1) :], end
    if total < n:
        return chained(before, total) + np.uint64(total) if total else before
    return np.unique(np.concatenate(found))


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that name the set; empty for the empty set."""
    if not len(shingles):
        return b""
    one, two = mixed(shingles + MIX1).sum(dtype=np.uint64), mixed(shingles ^ MIX2).sum(dtype=np.uint64)
    return int(one).to_bytes(8, "big") + int(two).to_bytes(8, "big")


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least of each of COORDINATES 32-bit hash functions."""
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    best = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        h = x[at : at + 512, None] * a[None, :]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        best = np.minimum(best, h.min(0))
    return best


def sketch(values: np.ndarray) -> np.ndarray:
    """Two bits a coordinate, four coordinates a byte; values are rows of coordinates."""
    bits = ((values >> np.uint32(17)) & np.uint32(3)).astype(np.uint8).reshape(len(values), -1, 4)
    return bits[:, :, 0] | bits[:, :, 1] << 2 | bits[:, :, 2] << 4 | bits[:, :, 3] << 6


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many coordinates of sketches (rows of 64-bit words) differ; obeys the triangle inequality."""
    x = a ^ b
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(-1, dtype=np.int64)


def limit(similarity: float) -> int:
    """The most coordinates in which the sketches of a pair at the bound differ, within four standard errors."""
    p = similarity + (1 - similarity) / 4
    return int(COORDINATES * (1 - p + 4 * math.sqrt(p * (1 - p) / COORDINATES)))


def led_limit(similarity: float) -> int:
    """The same, for members of a large bucket and its leader."""
    return limit(similarity)


def roots_of(done: int, runs: int) -> np.ndarray:
    """The roots of the trees of so many runs after those done."""
    return mixed(np.arange(done + 1, done + runs + 1, dtype=np.uint64) * MIX3)


def children(paths: np.ndarray, values: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of every child of each row's tree node; values are the row's coordinates."""
    chosen = mixed(paths[:, None] ^ (np.arange(1, COORDINATES + 1, dtype=np.uint64) * MIX1)[None, :])
    row, at = np.nonzero(chosen < np.uint64(int((1 << 64) / (similarity * COORDINATES))))
    return row, mixed(chosen[row, at] + values[row, at].astype(np.uint64) * MIX2)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def read_sets(docs: DataFrame) -> DataFrame:
    """doc_id, node (the set's key), size (of the set), hashes (its coordinates) of each row of docs."""
    own = docs.select("doc_id").schema["doc_id"]
    schema = StructType([own, StructField("node", BinaryType()), StructField("size", LongType()), StructField("hashes", BinaryType())])

    def run(ids, texts):
        sets = shingle_sets(texts)
        return {own.name: ids, "node": [set_key(s) for s in sets], "size": [len(s) for s in sets], "hashes": [min_hashes(s).tobytes() if len(s) else None for s in sets]}

    return map_rows(docs, ["doc_id", "text"], run, schema)


PATHS = StructType([StructField("path", LongType()), StructField("node", BinaryType()), StructField("leader", BinaryType()), StructField("sketch", BinaryType())])


def first_paths(nodes: DataFrame, similarity: float, runs: int, done: int = 0) -> DataFrame:
    """Each node's paths of two levels in so many runs after those done. leader: the candidate group it is known to be in."""

    def run(batches):
        roots = roots_of(done, runs)
        for batch in batches:
            step = max(1, 5120 // runs)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                values = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
                n = len(values)
                own = np.tile(np.arange(n), runs)
                row, paths = children(np.repeat(roots, n), values[own], similarity)
                own = own[row]
                row, paths = children(paths, values[own], similarity)
                own = own[row]
                take = pa.array(own)
                marks = _binary(sketch(values))
                yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), part.column(0).take(take), part.column(2).take(take), marks.take(take)], names=[f.name for f in PATHS])

    return nodes.select("node", "hashes", "leader").mapInArrow(worker_task(run), PATHS)


def next_paths(rows: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The rows a level further down."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                values = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint32).reshape(-1, COORDINATES)
                row, paths = children(part.column(0).to_numpy().view(np.uint64), values, similarity)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), *(part.column(i).take(take) for i in (1, 2, 3))], names=[f.name for f in PATHS])

    return rows.join(nodes.select("node", "hashes"), "node").select("path", "node", "leader", "sketch", "hashes").mapInArrow(worker_task(run), PATHS)


EDGES = StructType([StructField("a", BinaryType()), StructField("b", BinaryType())])


def _edges(pairs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])


def forest(marks: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Pairs of rows that hold together whatever differs in at most so many coordinates: one pair less than a component's rows."""
    left, right, todo = [], [], np.arange(len(marks))
    while len(todo):
        stack, todo = [int(todo[0])], todo[1:]
        while stack and len(todo):
            i = stack.pop()
            near = unlike(marks[todo], marks[i]) <= most
            hit = todo[near].tolist()
            left += [i] * len(hit)
            right += hit
            stack += hit
            todo = todo[~near]
    return left, right


def small_edges(rows: DataFrame, similarity: float) -> DataFrame:
    """Edges that hold together the likely pairs of each bucket; rows are (path, node, sketch) of buckets of at most SMALL, dealt by path."""
    most, small, few = limit(similarity), SMALL, FEW

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            paths = table.column(0).to_numpy()
            last = int(np.searchsorted(paths, paths[-1]))  # the last bucket may go on in the next batch
            yield from found(table.slice(0, last))
            rest = table.slice(last)
        if rest is not None:
            yield from found(rest)

    def found(table):
        if not len(table):
            return
        table = table.combine_chunks()
        paths, nodes = table.column(0).to_numpy(), table.column(1).to_pylist()
        marks = np.frombuffer(b"".join(table.column(2).to_pylist()), np.uint64).reshape(len(paths), -1)
        starts = np.flatnonzero(np.concatenate(([True], paths[1:] != paths[:-1])))
        sizes = np.diff(np.append(starts, len(paths)))
        left, right = [], []
        for size in np.unique(sizes[(sizes > 1) & (sizes <= min(small, few))]).tolist():
            x, y = np.triu_indices(size, 1)
            of = starts[sizes == size]
            step = max(1, 200_000 // len(x))
            for k in range(0, len(of), step):
                a, b = (of[k : k + step, None] + x).reshape(-1), (of[k : k + step, None] + y).reshape(-1)
                good = unlike(marks[a], marks[b]) <= most
                left += a[good].tolist()
                right += b[good].tolist()
        for at, size in zip(starts[sizes > few].tolist(), sizes[sizes > few].tolist()):
            a, b = forest(marks[at : at + size], most)
            left += [at + i for i in a]
            right += [at + i for i in b]
        if pairs := {(min(nodes[i], nodes[j]), max(nodes[i], nodes[j])) for i, j in zip(left, right) if nodes[i] != nodes[j]}:
            yield _edges(pairs)

    return rows.repartition("path").sortWithinPartitions("path").select("path", "node", "sketch").mapInArrow(worker_task(run), EDGES)


LED = StructType([*PATHS, StructField("lead", BinaryType()), StructField("apart", LongType())])


def led(large: DataFrame) -> DataFrame:
    """Rows of large buckets with the bucket's least member, and in how many coordinates the sketches differ."""
    least = large.groupBy("path").agg(F.min(F.struct("node", "sketch")).alias("least"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                own, first = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (3, 5))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(unlike(own, first))], names=[f.name for f in LED])

    return large.join(least, "path").select("path", "node", "leader", "sketch", F.col("least.node").alias("lead"), F.col("least.sketch").alias("first")).mapInArrow(worker_task(run), LED)


def open_rows(found: DataFrame, most: int) -> DataFrame:
    """Rows that may be like a member of their bucket that isn't like the leader; none where all are like it."""
    others = found.where(F.col("apart") > most).groupBy("path").agg(F.min("apart").alias("lo"))
    return found.join(others, "path").where((F.col("apart") > most) | (F.col("apart") >= F.col("lo") - most)).select("path", "node", "leader", "sketch")


def candidate_groups(nodes: DataFrame, similarity: float, runs: int, levels: int = 8) -> DataFrame:
    """node, least: groups that hold together whatever may be similar; nodes alone are not in it.

    Groups are the components of what was found. They are formed once after the first buckets, where copies of one text
    meet, if large buckets are left, and once at the end. leader is a node's group then, and buckets of one group
    are settled. Nodes of the others get more runs, which join the walk at its first level."""
    rows, found, most = first_paths(nodes.withColumn("leader", F.col("node")), similarity, runs), [], led_limit(similarity)
    for turn, level in enumerate((2, *range(2, levels + 1))):
        rows = written(rows, f"paths-{level}")
        buckets = rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        if turn:
            mixed_ = rows.groupBy("path").agg(F.min("leader").alias("least"), F.max("leader").alias("most")).where("least != most")
            buckets = buckets.join(mixed_.select("path"), "path")
        live = written(rows.join(buckets, "path"), f"buckets-{level}")
        found.append(small_edges(live.where(F.col("n") <= SMALL), similarity))  # read once, by the components
        large = live.where(F.col("n") > SMALL).drop("n")
        if turn != 1 and large.isEmpty():
            break
        measured = written(led(large), f"led-{level}")
        spokes = measured.where("node != lead")
        if level == levels:
            found.append(spokes.select(F.col("lead").alias("a"), F.col("node").alias("b")))
            break
        found.append(spokes.where(F.col("apart") <= most).select(F.col("lead").alias("a"), F.col("node").alias("b")))
        going = open_rows(measured, most)
        if turn == 0:
            groups = written(components(reduce(DataFrame.unionByName, found)), "groups")
            found = [groups.select(F.col("node").alias("a"), F.col("least").alias("b"))]
            named = written(going.drop("leader").join(groups, "node", "left").withColumn("leader", F.coalesce("least", "node")).select("path", "node", "leader", "sketch"), "named")
            open_ = named.groupBy("path").agg(F.min("leader").alias("least"), F.max("leader").alias("most")).where("least != most").select("path")
            waiting = written(named.join(open_, "path"), "open")
            if waiting.isEmpty():
                break
            crowded = waiting.select("node", "leader").distinct().join(nodes.select("node", "hashes"), "node")
            rows = first_paths(crowded, similarity, max(1, runs_for(similarity, levels) - runs), runs)
        else:
            rows = next_paths(going.unionByName(waiting) if turn == 1 else going, nodes, similarity)
    return components(reduce(DataFrame.unionByName, found))


SETS = StructType([StructField("node", BinaryType()), StructField("shingles", BinaryType())])


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles of the wanted nodes; wanted has node and doc, one document that has the set."""

    def run(texts, nodes):
        found = [(n, s.tobytes()) for n, s in zip(nodes, shingle_sets(texts)) if set_key(s) == n]  # another row of this doc_id may differ
        return {"node": [n for n, _ in found], "shingles": [s for _, s in found]}

    # texts are sorted to their ids at any size, so the plan is the same for small and large tables
    rows = docs.select(F.col("doc_id").alias("doc"), "text").join(wanted.select(F.col("doc").alias("__doc"), "node").hint("merge"), F.col("doc").eqNullSafe(F.col("__doc")))
    return map_rows(rows, ["text", "node"], run, SETS).groupBy("node").agg(F.first("shingles").alias("shingles"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Shared shingles of each pair of left x right (or left x left), in float32 products over slices of columns."""
    both = left if right is None else left + right
    everything = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    order = np.argsort(everything, kind="stable")
    values, owner = everything[order], owner[order]
    new = np.concatenate(([True], values[1:] != values[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    if not len(column):
        return np.zeros((len(left), len(left if right is None else right)), np.float32)
    column = np.concatenate(([0], np.cumsum(column[1:] != column[:-1])))
    out = np.zeros((len(left), len(left if right is None else right)), np.float32)
    wide = min(max(1, 2_000_000 // len(both)), int(column[-1]) + 1)
    for at in range(0, int(column[-1]) + 1, wide):
        a, b = np.searchsorted(column, (at, at + wide))
        dense = np.zeros((len(both), wide), np.float32)
        dense[owner[a:b], column[a:b] - at] = 1
        out += dense[: len(left)] @ (dense[: len(left)] if right is None else dense[len(left) :]).T
    return out


LINKS = StructType([StructField("node", BinaryType()), StructField("links", LongType()), StructField("to", ArrayType(BinaryType()))])


def exact_links(groups: DataFrame, similarity: float) -> DataFrame:
    """node, links (documents it is similar to in this block pair), to (nodes that connect it).

    groups: group, node, size, copies, shingles. Each group is cut by a hash into blocks of about BLOCK nodes and
    BLOCK_SHINGLES shingles; every pair of blocks is one piece of work, and holds two blocks."""
    sizes = groups.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("whole"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("whole") / BLOCK_SHINGLES)).cast("int")
    dealt = groups.join(sizes, "group").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).select("group", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "node", "copies", "shingles")

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for part in parts(batch, 256):
                for row in zip(*(part.column(i).to_pylist() for i in range(7))):
                    if held and held[0][:3] != row[:3]:
                        yield from compare(held)
                        held = []
                    held.append(row)
        if held:
            yield from compare(held)

    def compare(rows):
        one, two = rows[0][1], rows[0][2]
        left = [r for r in rows if r[3] == one]
        right = left if one == two else [r for r in rows if r[3] == two]
        if not left or not right or (one == two and len(left) == 1):
            return
        sets = [[np.frombuffer(r[6], np.uint64) for r in side] for side in ((left,) if one == two else (left, right))]
        shared = overlaps(sets[0], None if one == two else sets[1])
        sizes = [np.array([len(s) for s in side]) for side in (sets if one != two else sets * 2)]
        whole = sizes[0][:, None] + sizes[1][None, :] - shared
        # a ratio of whole numbers, compared in double; equal counts as similar
        near = shared.astype(np.float64) >= similarity * whole - 1e-9
        if one == two:
            np.fill_diagonal(near, False)
        copies = [np.array([r[5] for r in side]) for side in (left, right)]
        nodes = [[r[4] for r in side] for side in (left, right)]
        found: dict[bytes, list] = {}
        for i, n in enumerate((near @ copies[1]).tolist()):
            if n:
                found[nodes[0][i]] = [n, [nodes[1][int(np.argmax(near[i]))]]]
        if one != two:
            for j, n in enumerate((copies[0] @ near).tolist()):
                if n:
                    found[nodes[1][j]] = [n, [nodes[0][int(np.argmax(near[:, j]))]]]
        # links beyond each node's first that join two parts of the block
        parent = {n: n for side in nodes for n in side}

        def root(n):
            while parent[n] != n:
                parent[n] = parent[parent[n]]
                n = parent[n]
            return n

        for n, (_, to) in found.items():
            parent[root(n)] = root(to[0])
        if len({root(n) for n in found}) > 1:
            for i, j in zip(*np.nonzero(near)):
                a, b = root(nodes[0][i]), root(nodes[1][j])
                if a != b:
                    parent[a] = b
                    found[nodes[0][i]][1].append(nodes[1][j])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.list_(pa.binary()))], names=["node", "links", "to"])

    return dealt.repartition("group", "one", "two").sortWithinPartitions("group", "one", "two").mapInArrow(worker_task(run), LINKS)


def join(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, class_id, n_links (other documents at least as similar), n_copies (documents with its set), node, class (null without shingles)."""
    keys = written(read_sets(docs), "jaccard-sets")
    nodes = written(keys.where("hashes is not null").groupBy("node").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("hashes").alias("hashes")), "jaccard-nodes")
    groups = candidate_groups(nodes, similarity, runs_for(similarity)).select("node", F.col("least").alias("group"))
    wanted = nodes.select("node", "doc", "copies", "size").join(groups, "node")
    sets = whole_sets(docs, wanted)
    links = written(exact_links(wanted.drop("doc").join(sets, "node").select("group", "node", "size", "copies", "shingles"), similarity), "jaccard-links")
    classes = components(links.select(F.col("node").alias("a"), F.explode("to").alias("b")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    small = nodes.select("node", "doc", "copies").join(classes, "node", "left").join(counted, "node", "left").withColumn("class", F.coalesce("least", "node"))
    least = small.groupBy("class").agg(F.min("doc").alias("class_id"))
    small = small.join(least, "class").select("node", "class", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    found = keys.select("doc_id", "node").join(small.withColumnRenamed("node", "its"), F.col("node") == F.col("its"), "left")
    return found.select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"), keys["node"], "class",
    )


def query(docs: DataFrame) -> DataFrame:
    return join(docs).drop("node", "class")


def with_nodes(docs: DataFrame) -> DataFrame:
    """docs as k0, k1, ... and node, the key of each row's own set."""
    names = docs.columns
    at = names.index("text")
    schema = StructType([*[StructField(f"k{i}", f.dataType) for i, f in enumerate(docs.schema)], StructField("node", BinaryType())])

    def run(batches):
        for batch in batches:
            for part in parts(batch, 256):
                keys = pa.array([set_key(s) for s in shingle_sets(part.column(at).to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, keys], names=[f.name for f in schema])

    return docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)]).mapInArrow(worker_task(run), schema)


def stage(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each class, of the least doc_id. Columns stay.

    An id of one row says what happens to it; rows that share an id, and rows without one, are told apart by their sets. A row
    without an id stays if no row of its class has one, and is then the only one of its class. Rows without words stay."""
    found = written(join(docs, similarity), "jaccard-found")
    gone = found.where("doc_id != class_id").select(F.col("doc_id").alias("__gone"))
    shared = written(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__gone")), "jaccard-shared")
    kept = docs.where("doc_id is not null").join(gone.unionByName(shared).distinct().hint("merge"), F.col("doc_id") == F.col("__gone"), "left_anti")
    at = f"k{docs.columns.index('doc_id')}"
    named = lambda rows: rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
    if not shared.isEmpty():
        least = found.where("doc_id = class_id").join(shared, F.col("doc_id") == F.col("__gone")).select(F.col("doc_id").alias("__doc"), F.col("node").alias("__node"), "class").distinct()
        rows = with_nodes(docs.join(shared.hint("merge"), F.col("doc_id") == F.col("__gone"), "left_semi"))
        rows = rows.join(least.hint("merge"), (F.col(at) == F.col("__doc")) & (F.col("node") == F.col("__node")))
        kept = kept.unionByName(named(rows.where("class is not null").dropDuplicates(["class"]).unionByName(rows.where("class is null"))))
    if not found.where("doc_id is null").isEmpty():
        rows = written(with_nodes(docs.where("doc_id is null")), "jaccard-nameless")
        alone = found.where("doc_id is null and class is not null and class_id is null").select(F.col("node").alias("__node"), "class").distinct()
        # equal sets first, where they lie
        one = rows.where(F.octet_length("node") > 0).dropDuplicates(["node"]).join(alone, F.col("node") == F.col("__node")).dropDuplicates(["class"])
        kept = kept.unionByName(named(one)).unionByName(named(rows.where(F.octet_length("node") == 0)))
    return kept
