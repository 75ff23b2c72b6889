"""Packing: best-fit decreasing with a segment tree over remaining capacity.

A document's ids, ended by id 1, are cut into full windows and a rest shorter than one. Pieces are dealt by a hash
into groups of bounded size; in each, from the longest piece down, a segment tree indexed by remaining capacity
finds the open window with the least room that still fits. Groups pack alone, so no task holds more than
one group, and the windows left open at the end of each are few beside the group.

Tokens: the vocabulary file's path is a parameter. White space separates all its tokens, so texts are split and
dictionary-encoded in Arrow, each distinct chunk between spaces and line ends is tokenised once in a while, and
ids are gathered in numpy.

Defined cases: a null or empty text is its end id alone; repeated rows, and rows without an id, are separate documents,
dealt out by a number of their own; pieces of equal length are taken by id and start; very long texts are tokenised in
parts; an empty table gives no sequences; strings of special tokens in a text are what the tokenizer makes of them; further
columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from quire.llm.common import kept, map_rows
from quire.session import written

WINDOW = 2048
END = 1
#: Chunks whose ids a worker remembers, from one packing task to the next; beyond, the half that most batches had stays.
KNOWN = 400_000
#: Marks that are taken off a chunk's end if a letter or digit stands before them: the tokenizer makes a word of their run.
MARKS = ".,;:!?"
#: What is one word to the tokenizer, and may be told from its neighbours by word ends.
PLAIN = "^[a-zà-öø-ÿ]+$"
BEFORE_MARKS = "[a-zA-Z0-9à-öø-ÿ]$"


class Numbered(dict):
    """Each new key gets the next number."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def word_ends(path: str) -> np.ndarray:
    """Which ids end a word; none where the vocabulary doesn't mark them."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix, words = model.get("end_of_word_suffix") or "", model["vocab"]
    ends = np.zeros(max(words.values()) + 1, bool)
    ends[[i for w, i in words.items() if suffix and w.endswith(suffix)]] = True
    return ends


#: Characters tokenised at once.
PART = 2 << 20


def plain_spaces(text: str | None) -> str:
    """Line ends as spaces. Latin-1 is lower-cased first, as the tokenizer does, so fewer chunks are distinct; strings like
    those of special tokens are left as they stand."""
    text = text or ""
    if "<|" not in text:
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
    return text.replace("\n", " ")


def parts_of(text: str) -> list[str]:
    """The text, cut at spaces after PART characters; a cut's space has no id."""
    found, at = [], 0
    while len(text) - at > PART and (end := text.find(" ", at + PART)) >= 0:
        found.append(text[at:end])
        at = end + 1
    return [*found, text[at:]]


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, so many as size says."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Ids:
    """Texts to ids. Each distinct chunk between spaces and line ends is given to the tokenizer once in a while.

    Plain chunks go joined by spaces, which costs half as much; ids that end a word tell where each chunk ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.ends, self.chunks = Tokenizer.from_file(path), word_ends(path), Numbered()
        self.flat, self.first, self.size, self.used = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def forget(self) -> None:
        stay = np.sort(np.argsort(-self.used, kind="stable")[: KNOWN // 2])
        keep = np.zeros(len(self.used), bool)
        keep[stay] = True
        self.chunks = Numbered(zip(compress(self.chunks, keep.tolist()), range(len(stay))))
        self.flat = self.flat[spread(self.first[stay], self.size[stay])]
        self.size, self.used = self.size[stay], self.used[stay] // 2
        self.first = np.cumsum(self.size, dtype=np.int32) - self.size

    def each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, how many each has)."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def plain(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for chunks that are one word each."""
        if not self.ends.any():
            return self.each(chunks)
        found = []
        for at in range(0, len(chunks), 2000):
            own = chunks[at : at + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(own), add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            found.append((ids, np.diff(stops, prepend=0)) if len(stops) == len(own) else self.each(own))  # else not as plain as they look
        return tuple(np.concatenate(x) for x in zip(*found))

    def learn(self) -> None:
        """Gives ids to the chunks that have a number but no ids yet."""
        fresh = list(islice(self.chunks, len(self.first), None))
        if not fresh:
            return
        simple = pc.match_substring_regex(pa.array(fresh, pa.large_string()), PLAIN).to_numpy(zero_copy_only=False)
        size, first, at = np.zeros(len(fresh), np.int32), np.zeros(len(fresh), np.int32), len(self.flat)
        for which, tokenise in ((np.flatnonzero(simple), self.plain), (np.flatnonzero(~simple), self.each)):
            if len(which):
                ids, size[which] = tokenise([fresh[i] for i in which.tolist()])
                first[which] = at + np.cumsum(size[which]) - size[which]
                self.flat = np.concatenate((self.flat, ids))
                at += len(ids)
        self.first, self.size = np.concatenate((self.first, first)), np.concatenate((self.size, size))
        self.used = np.concatenate((self.used, np.zeros(len(fresh), np.int32)))

    def numbers(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each chunk without its marks, and of its marks; -1 for none."""
        bare = pc.utf8_rtrim(chunks, characters=MARKS)
        cut = pc.and_(pc.not_equal(pc.binary_length(bare), pc.binary_length(chunks)), pc.match_substring_regex(bare, BEFORE_MARKS))
        stems, marks, at = pc.if_else(cut, bare, chunks), np.full(len(chunks), -1), np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        whole, short = (x.take(pa.array(at)).to_numpy(zero_copy_only=False).tolist() for x in (chunks, bare))
        tails = [w[len(b) :] for w, b in zip(whole, short)]
        marks[at] = np.fromiter(map(self.chunks.__getitem__, tails), np.int64, len(tails))
        return np.fromiter(map(self.chunks.__getitem__, stems.to_numpy(zero_copy_only=False)), np.int64, len(chunks)), marks

    def together(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts whose only white space between tokens is the space."""
        if len(self.chunks) > KNOWN:
            self.forget()
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        chunks = split.flatten().dictionary_encode()
        stems, marks = self.numbers(chunks.dictionary)
        self.learn()
        self.used[stems] += 1
        # the ids of each distinct chunk, then of all
        size = np.stack((self.size[stems], np.where(marks < 0, 0, self.size[marks])), 1)
        flat = self.flat[spread(np.stack((self.first[stems], self.first[marks]), 1).reshape(-1), size.reshape(-1))]
        size = size.sum(1)
        own = chunks.indices.to_numpy()
        ends = np.cumsum(size[own])
        ids = flat[spread((np.cumsum(size) - size)[own], size[own])]
        stops = np.concatenate(([0], ends))[split.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text and the end id."""
        out: list[np.ndarray] = []
        held, size = [], 0
        for text in map(plain_spaces, texts):
            if len(text) > PART:
                out += [*self.together(held), np.concatenate([self.together([p])[0] for p in parts_of(text)])]
                held, size = [], 0
                continue
            held.append(text)
            size += len(text)
            if size > PART:
                out += self.together(held)
                held, size = [], 0
        out += self.together(held)
        return [np.append(ids, np.uint32(END)).astype("<u4") for ids in out]


def ids_of(path: str) -> Ids:
    """The worker's own Ids of a vocabulary, kept from one packing task to the next."""
    return kept(("ids", path), lambda: Ids(path))


def cut(docs: DataFrame, path: str, keep_ids: bool = False, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if asked for, the ids of each piece."""
    own = docs.select("doc_id").schema["doc_id"]
    schema = StructType([own, *[StructField(n, LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")], *([StructField("ids", ArrayType(IntegerType()))] if keep_ids else [])])

    def run(doc_ids, texts):
        out = {f.name: [] for f in schema}
        for doc, ids in zip(doc_ids, ids_of(path)(texts)):
            for start in range(0, len(ids), window):
                piece = ids[start : start + window]
                out[own.name].append(doc)
                out["start"].append(start)
                out["length"].append(len(piece))
                out["ids_crc32"].append(zlib.crc32(piece.tobytes()))
                out["doc_tokens"].append(len(ids))
                if keep_ids:
                    out["ids"].append(piece.tolist())
        return out

    return map_rows(docs, ["doc_id", "text"], run, schema, size=8192, text_bytes=4 << 20, key=("ids", path))


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, given from the longest down.

    The tree's leaf r holds whether a window with room r is open; open[r] are those windows."""
    wide = 1 << window.bit_length()
    tree = bytearray(2 * wide)
    open_: list[list[int]] = [[] for _ in range(window + 1)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def mark(r: int, on: bool) -> None:
        node = r + wide
        tree[node] = on
        while node > 1:
            node >>= 1
            now = tree[2 * node] | tree[2 * node + 1]
            if tree[node] == now:
                return
            tree[node] = now

    made = 0
    for i, size in enumerate(lengths.tolist()):
        node = size + wide  # the leaf of the first room at or after size
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            node = node + 1 if node > 1 else 0
            while node and node < wide:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        if node:
            room = node - wide
            which = open_[room].pop()
            if not open_[room]:
                mark(room, False)
        else:
            room, which, made = window, made, made + 1
        sequence[i], offset[i] = which, window - room
        left = room - size
        if left:
            if not open_[left]:
                mark(left, True)
            open_[left].append(which)
    return sequence, offset


def pack(pieces: DataFrame, group_rows: int = 25_000, window: int = WINDOW) -> DataFrame:
    """pieces with sequence_id and offset. Groups hold about group_rows each: pieces is a written table, and the number of a
    row in it has a part in its hash, so repeated rows and rows without an id spread like others."""
    groups = max(1, -(-pieces.count() // group_rows))
    place = F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id())
    dealt = pieces.withColumn("__group", F.pmod(place, F.lit(groups)).cast("long"))
    schema = StructType([*pieces.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    names = [f.name for f in schema]

    def run(rows: pa.Table) -> pa.Table:
        group = rows.column("__group")[0].as_py()
        rows = rows.select(names[:-2])
        rows = rows.take(pc.sort_indices(rows, [("length", "descending"), *[(n, "ascending") for n in ("doc_id", "start", "ids_crc32")]]))
        sequence, offset = best_fit(rows.column("length").to_numpy(), window)
        return rows.append_column(names[-2], pa.array((group << 32) + sequence)).append_column(names[-1], pa.array(offset))

    return dealt.groupBy("__group").applyInArrow(run, schema)


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return pack(written(cut(docs, path), "pack-pieces"))
