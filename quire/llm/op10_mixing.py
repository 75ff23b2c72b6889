"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Every source's words form one line: its documents in the order of md5(seed:doc_id), a permutation. The mix takes the
first `quota` words of the line repeated, so a document is taken 0 to 3 times and at most one document a source
is cut. The quotas, as whole blocks of words (the last one of a source may be short), are then split exactly down a
binary tree; each node draws the left child's share of every source from the multivariate hypergeometric law, by
inversion around the mode, so a leaf (an output shard) is a sample without replacement of the mix. Leaves cut each line into
disjoint runs of permuted blocks; a document goes, whole, with the block that its first word is in. A shard's blocks are put
in the order of a hash, which needs no rows from elsewhere.

Only DataFrame and SQL functions run here. What one task orders: the documents of a block of tickets (about 4096; a ticket
that more documents share is split by row), a source's blocks (a row for each 4096 documents), a source's shards, and a shard.

Defined cases: a null or empty text has size 0 and is not taken; very long texts are counted whole and cut like others; a null
source is a source of its own, the last; repeated rows and rows without an id are separate documents, in an order that holds
for one reading of a table; ties of tickets go by id, then size; an empty table gives an empty mix; if no source has words
every target is 0; further columns are not read by the query and kept by the stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import WORD
from quire.session import written

#: A document is taken so many times at most.
MOST = 3
#: Blocks that a shard has.
BLOCKS = 1024


def sizes(docs: DataFrame, key: str, seed: str = "mix", rows_per_block: int = 4096) -> DataFrame:
    """key, doc_id, source, size, ticket (order in the source's line), block: a range of tickets, part: a share of the rows of one ticket."""
    blocks = max(1, docs.count() // rows_per_block)
    ticket = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.col(key).alias("key"), "doc_id", "source", size.alias("size"), ticket.alias("ticket"), F.monotonically_increasing_id().alias("row"))
    # ids that many rows share, null among them; as a rule there are none
    many = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where(F.col("rows") > rows_per_block)
    rows = rows.join(many.select(F.col("doc_id").alias("its"), "rows"), F.col("doc_id").eqNullSafe(F.col("its")), "left")
    part = F.coalesce(F.pmod(F.col("row"), F.ceil(F.col("rows") / rows_per_block)), F.lit(0)).cast("long")
    block = F.floor(F.conv(F.substring("ticket", 1, 8), 16, 10).cast("long") * blocks / F.lit(1 << 32)).cast("long")
    return rows.select("key", "doc_id", "source", "size", "ticket", block.alias("block"), part.alias("part"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, rank, weight, target, quota; one row a source.

    A source is full if its share would be above MOST times its size when the level rises from below: with
    sources by MOST * size / weight, the level of source i is reached at total
    sum(caps up to i) + level_i * sum(weights after i). All in integers, but for the last division."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    ranked = by_source.withColumn("rank", F.row_number().over(ordered).cast("long"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    cap = F.col("source_size") * MOST
    everything = Window.partitionBy(F.lit(0))
    filled = everything.orderBy(cap / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumns({"total": F.sum("source_size").over(everything), "caps": F.sum(cap).over(filled), "later": F.sum("weight").over(everything) - F.sum("weight").over(filled)})
    ranked = ranked.withColumn("full", F.col("caps") * F.col("weight") + cap * F.col("later") <= F.col("total") * F.col("weight"))
    ranked = ranked.withColumns({"left": F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), cap)).over(everything), F.lit(0)), "open": F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)})
    target = F.when(F.col("full"), cap.cast("double")).otherwise((F.col("left") * F.col("weight")).cast("double") / F.col("open"))
    return ranked.withColumn("target", target).withColumn("quota", F.least(F.floor(F.col("target") + F.lit(0.5)).cast("long"), cap)).select("source", "source_size", "rank", "weight", "target", "quota")


def _unit(*parts: Column) -> Column:
    """A uniform number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) + F.lit(0.5)) / F.lit(float(1 << 53))


def _drawn(colour: Column, drawn: Column, total: Column, *key: Column) -> Column:
    """How many of `drawn` balls out of `total` have a colour of `colour` balls: hypergeometric.

    The law's own quantile, walked with the ratio of neighbouring probabilities over all values within nine deviations
    of the mode (and sixteen more): what lies beyond is less than a double can add."""
    share = colour / F.greatest(total, F.lit(1))
    low, high = F.greatest(F.lit(0).cast("long"), drawn - (total - colour)), F.least(colour, drawn)
    spread = F.sqrt(F.greatest(drawn * share * (1 - share) * (total - drawn) / F.greatest(total - 1, F.lit(1)), F.lit(0.0)))
    mode = F.floor((drawn + 1).cast("double") * (colour + 1) / (total + 2)).cast("long")
    reach = F.ceil(9 * spread).cast("long") + 16
    first, last = F.greatest(low, F.least(high, mode - reach)), F.least(high, F.greatest(low, mode + reach))
    steps = F.sequence(first, last)
    ratio = lambda k: ((colour - k).cast("double") * (drawn - k)) / ((k + 1).cast("double") * (total - colour - drawn + k + 1))
    onward = lambda a, k: (a["p"] * F.when(k < last, ratio(k)).otherwise(F.lit(0.0))).alias("p")
    whole = F.aggregate(steps, F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum")), lambda a, k: F.struct(onward(a, k), (a["sum"] + a["p"]).alias("sum")), lambda a: a["sum"])
    want = _unit(*key) * whole
    # one past the last value whose cumulative weight is below what is wanted
    return F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), first.alias("k"), want.alias("want")),
        lambda a, k: F.struct(onward(a, k), (a["sum"] + a["p"]).alias("sum"), F.when(a["sum"] + a["p"] < a["want"], F.least(k + 1, last)).otherwise(a["k"]).alias("k"), a["want"].alias("want")),
        lambda a: a["k"],
    )


def split(goals: DataFrame, depth: int, seed: str = "mix") -> DataFrame:
    """rank, shard, low, high: the run of each source's blocks that each of 2 ** depth shards gets; goals: rank, blocks.

    Nodes are rows; a level turns each into two without a shuffle, later levels over many tasks."""
    level = goals.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "blocks"))), lambda x: x["blocks"]).alias("quotas")).where(F.size("quotas") > 0)
    level = level.select(F.lit(0).cast("long").alias("node"), "quotas")
    for k in range(depth):
        if k in (9, 14):
            level = level.repartition(F.col("node"))
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)
        level = level.withColumn("total", total)
        state = F.struct(F.floor(F.col("total") / 2).cast("long").alias("drawn"), F.col("total").alias("total"), F.array().cast("array<bigint>").alias("out"))

        def colour(a: Column, x: Column) -> Column:
            got = _drawn(x, a["drawn"], a["total"], F.lit(seed), F.lit(k), F.col("node"), F.size(a["out"]))  # noqa: B023
            return F.transform(F.array(got), lambda g: F.struct((a["drawn"] - g).alias("drawn"), (a["total"] - x).alias("total"), F.concat(a["out"], F.array(g)).alias("out")))[0]

        level = level.withColumn("left", F.aggregate("quotas", state, colour, lambda a: a["out"]))
        sides = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("quotas", "left", lambda q, x: q - x).alias("quotas")),
        )
        level = level.select(F.explode(sides).alias("side")).select("side.*")
    shares = level.select(F.col("node").alias("shard"), F.posexplode("quotas").alias("at", "share")).select((F.col("at") + 1).cast("long").alias("rank"), "shard", "share")
    line = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    return shares.withColumn("high", F.sum("share").over(line)).withColumn("low", F.col("high") - F.col("share")).where("share > 0").select("rank", "shard", "low", "high")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", words_per_shard: int = 4_000_000, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(documents, draws) of the mix.

    documents: key, doc_id, source, size, ticket, source_size, target, quota and start, the place in the source's line.
    draws: key, doc_id, ticket, shard, place (of the block in the shard), epoch, size, words: the first words of the document
    go to the shard, all but for a source's last. Sum(words) by source is the target rounded."""
    sized = written(sizes(docs, key, seed), "mix-sizes")
    goals = written(targets(sized, weights), "mix-targets")
    mixed = goals.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    depth = max(0, (int(mixed) // words_per_shard).bit_length())
    wide = max(1, words_per_shard // BLOCKS)
    blocks = sized.groupBy("source", "block", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    goal = goals.select(F.col("source").alias("its"), "source_size", "rank", "target", "quota")
    blocks = blocks.join(goal, F.col("source").eqNullSafe(F.col("its"))).drop("its").withColumnsRenamed({"source": "its", "block": "at", "part": "of"})
    inside = Window.partitionBy("source", "block", "part").orderBy("ticket", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(blocks, F.col("source").eqNullSafe(F.col("its")) & (F.col("block") == F.col("at")) & (F.col("part") == F.col("of")))
    documents = placed.select("key", "doc_id", "source", "size", "ticket", "rank", "source_size", "target", "quota", (F.col("before") + F.col("inside")).alias("start"))
    documents = written(documents, "mix-documents")

    shards = split(goals.select("rank", F.ceil(F.col("quota") / wide).cast("long").alias("blocks")), depth, seed)
    cell = F.greatest(F.lit(1), F.ceil(F.col("quota") / (wide << depth))).cast("long")
    runs = shards.join(goals.select("rank", "quota"), "rank").withColumn("cells", cell)
    runs = runs.select("rank", "shard", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / F.col("cells")), F.floor((F.col("high") - 1) / F.col("cells")))).alias("cell"))
    taken = documents.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))).alias("epoch"))
    taken = taken.withColumn("from", F.col("epoch") * F.col("source_size") + F.col("start")).withColumn("to", F.least(F.col("from") + F.col("size"), F.col("quota"))).where("from < to")
    taken = taken.withColumn("at", F.floor(F.col("from") / wide)).withColumn("cell", F.floor(F.col("at") / cell))
    place = F.md5(F.concat_ws(":", F.lit(seed), "shard", "rank", F.col("at").cast("string")).cast("binary"))
    pieces = taken.join(runs, ["rank", "cell"]).where("low <= at and at < high")
    draws = pieces.select("key", "doc_id", "ticket", "shard", place.alias("place"), "epoch", "size", (F.col("to") - F.col("from")).alias("words"), "rank", "start")
    return documents, draws


def query(docs: DataFrame) -> DataFrame:
    """One row a document: what the mix takes of it."""
    documents, draws = mix(docs)
    per = draws.groupBy("rank", "start").agg(F.sum("words").alias("got")).select(F.col("rank").alias("r"), F.col("start").alias("s"), "got")
    # a document with words has a place of its own in its line
    found = documents.join(per, (F.col("size") > 0) & (F.col("rank") == F.col("r")) & (F.col("start") == F.col("s")), "left")
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, words_per_shard: int = 4_000_000) -> DataFrame:
    """The mix as documents: a row for each time a document is taken, with docs' columns; a cut document keeps its words
    and the white space before them. A partition holds whole shards, each in its own order.

    Rows are known by doc_id where that tells them apart, else by a number that is written along with them."""
    names, key = docs.columns, "doc_id"
    many, missing = docs.groupBy("doc_id").agg(F.count("*").alias("k")).agg(F.max("k"), F.count_if(F.col("doc_id").isNull())).first()
    if (many or 0) > 1 or missing:
        key = max(names, key=len) + "_row"
        docs = written(docs.withColumn(key, F.monotonically_increasing_id()), "mix-rows")
    draws = mix(docs, words_per_shard=words_per_shard, key=key)[1]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{key}`").alias("id"))
    got = own.join(draws.select("key", "shard", "place", "ticket", "epoch", "size", "words").hint("merge"), F.col("id") == F.col("key"))
    got = got.repartition("shard").sortWithinPartitions("shard", "place", "ticket", "epoch", "key")
    words = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), "")
    new = {"text": cut, "n_chars": F.length(cut).cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None}
    whole = F.col("words") == F.col("size")
    return got.select(*[(F.when(whole, F.col("row").getField(c)).otherwise(new[c]) if c in new else F.col("row").getField(c)).alias(c) for c in names])
