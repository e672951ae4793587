"""Mixing sources to target weights by exact block quotas.

Each source's rows fall into numbered blocks by a keyed hash of their ids; because the key deals them at random, the numbers are
already a random order of the source's blocks. A target makes a quota of block draws: whole passes over all blocks and then a run of
blocks, the last of them to the word; the mix takes the text at that cut whole or leaves it out, so that every text stays as it came.
A splitting tree hands every source's quota down to the output shards: at each node the number of a source's blocks that go left is a
draw of the multivariate hypergeometric distribution, made block by block without replacement, so that the shards' quotas are exact
and the draws that they hold are disjoint runs. A document is taken once for each draw of its block that a shard of the tree holds.
Within a shard, rows are put in an order of their own hash.

Words are runs of anything but the six ASCII spaces. Null and empty texts have size 0 and are taken 0 times; very long texts are
counted and taken whole. A null source is a source, after all others. Rows that share an id share their block; each counts by itself,
and rows equal in id and text stand in any order at a cut. Columns of any name stay as they are. An empty table gives an empty plan.
The plan is a function of ids, texts, sources and seed: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import WORD, Scratch

#: Weights of the sources by code point, again from the start after the last.
WEIGHTS = (5, 2, 1)
#: No source, and so no row, is taken more often.
REPEATS = 3
#: A source of n words has the square root of n over this blocks: blocks and their words grow alike with the source.
SPREAD = 8
#: Draws of blocks that a shard holds, about.
SHARD_DRAWS = 64


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """row, all columns of the input, with doc_id, source, size, mark, the text's hash, and key, the id's."""
    n = F.regexp_count(F.col(text_col), F.lit(WORD))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(n, F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text_col).alias("mark"),
        F.xxhash64(F.lit(seed), id_col).alias("key"),
    )


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Adds weight and target to source, source_size.

    Sources whose share by weight exceeds ``repeats`` times their size stop there; the rest is shared anew. As the share for a
    unit of weight only rises, the sources that stop are the first ones in the order of limit by weight: the table, which has a row
    for each source, is ordered once.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(w) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(repeats) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = ranked.withColumns(
        {
            "left": F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "weights": F.sum("weight").over(rest),
            "place": F.row_number().over(order),
        }
    )
    ranked = ranked.withColumn("stops", F.col("cap") * F.col("weights") <= F.col("left") * F.col("weight"))
    level = F.min(F.when(~F.col("stops"), F.struct("place", "left", "weights"))).over(Window.partitionBy())
    ranked = ranked.withColumn("level", level)
    share = F.col("level.left") * F.col("weight") / F.col("level.weights")
    return ranked.select("source", "source_size", "weight", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def uniform(*of: Column | str | int) -> Column:
    """A number from 0 up to 1 that depends on the given values only."""
    cols = [F.lit(x) if isinstance(x, int) else (F.col(x) if isinstance(x, str) else x) for x in of]
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def left_draw(level: int, seed: int):
    """The step of an aggregate over a node's sources: how many of a source's blocks go left, given what is left to fill.

    Block after block goes left with the chance of the places that are left there among all: an exact hypergeometric draw.
    """

    def draw(a: Column, x: Column) -> Column:
        n, room, rest = x["blocks"], a["room"], a["rest"]
        each = F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>"))

        def block(k: Column, i: Column) -> Column:
            chance = uniform(F.lit(seed), F.lit(level), "shard", x["source"], i)
            return k + F.when(chance * (rest - i + 1) < room - k, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))

        k = F.aggregate(each, F.lit(0).cast("long"), block)
        # an array of one draw: the lambda's value is worked out once
        return F.transform(
            F.array(k), lambda got: F.struct((room - got).alias("room"), (rest - n).alias("rest"), F.concat(a["left"], F.array(got)).alias("left"))
        )[0]

    return draw


def splitting_tree(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """source, blocks -> source, shard, first, blocks: each source's run of block draws for each shard.

    shards is a power of two. A node's draw for a source follows the hypergeometric distribution of its blocks among the slots that
    go left, given what the sources before it took, so that sums are exact. The state is one row for each source and node.
    """
    assert shards & (shards - 1) == 0, "shards must be a power of two"
    nodes = quotas.select("source", F.lit(0).cast("long").alias("first"), F.col("blocks").cast("long").alias("blocks"), F.lit(0).alias("shard"))
    for level in range(shards.bit_length() - 1):
        all_rows = nodes.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("z"), "source", "first", "blocks"))).alias("q"), F.sum("blocks").alias("slots"))
        start = F.struct(
            F.floor((F.col("slots") + F.when(uniform(F.lit(seed), F.lit(level), "shard") < 0.5, F.lit(0)).otherwise(F.lit(1))) / 2).cast("long").alias("room"),
            F.col("slots").alias("rest"),
            F.array().cast("array<bigint>").alias("left"),
        )

        drawn = all_rows.withColumn("left", F.aggregate("q", start, left_draw(level, seed), lambda a: a["left"]))
        both = drawn.select("shard", F.explode(F.arrays_zip("q", "left")).alias("x")).select(
            F.col("x.q.source").alias("source"), F.col("x.q.first").alias("first"), F.col("x.q.blocks").alias("blocks"), F.col("x.left").alias("left"), "shard"
        )
        nodes = both.select(
            "source",
            F.explode(
                F.array(
                    F.struct((2 * F.col("shard")).cast("int").alias("shard"), F.col("first"), F.col("left").alias("blocks")),
                    F.struct((2 * F.col("shard") + 1).cast("int").alias("shard"), (F.col("first") + F.col("left")).alias("first"), (F.col("blocks") - F.col("left")).alias("blocks")),
                )
            ).alias("x"),
        ).select("source", "x.first", "x.blocks", "x.shard")
    return nodes


def with_source(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """With the source's row. Sources are few against rows, but not of a fixed number: Spark chooses how to join by the table's size."""
    s = by_source.withColumnRenamed("source", "s")
    return rows.join(s, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def planned(rows: DataFrame, keep: Scratch, shards: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """The sources (source, source_size, target, n_blocks, passes), their blocks with draws (pass, shard) and cut, and the number of shards.

    room is the words that a block gives in the last pass, null if it isn't in it.
    """
    by_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    cut = F.floor("target").cast("long")
    by_source = by_source.withColumns(
        {
            "n_blocks": F.greatest(F.lit(1), F.ceil(F.sqrt("source_size") / SPREAD)).cast("long"),
            "passes": F.when(F.col("source_size") > 0, F.floor(cut / F.col("source_size"))).otherwise(0).cast("long"),
        }
    ).withColumn("extra", cut - F.col("passes") * F.col("source_size"))
    by_source = keep(by_source, "sources")
    blocks = with_source(rows, by_source).groupBy("source", F.pmod("key", "n_blocks").alias("block")).agg(F.sum("size").alias("block_size"))
    blocks = with_source(blocks, by_source)
    run = Window.partitionBy("source").orderBy("block")
    blocks = blocks.withColumn("room", F.col("extra") - F.sum("block_size").over(run) + F.col("block_size"))
    blocks = blocks.withColumn("room", F.when(F.col("room") > 0, F.least("room", "block_size")))
    blocks = keep(blocks.select("source", "block", "block_size", "room", "passes", "n_blocks"), "blocks")
    most = F.max(F.when(F.col("room").isNotNull(), F.col("block") + 1))
    quotas = blocks.groupBy("source").agg((F.first("passes") * F.first("n_blocks") + F.coalesce(most, F.lit(0))).alias("blocks"))
    quotas = keep(quotas.filter("blocks > 0"), "quotas")
    if shards is None:
        total = quotas.agg(F.sum("blocks")).first()[0] or 1
        shards = 1 << max(0, (total // SHARD_DRAWS).bit_length() - 1)
    runs = splitting_tree(quotas, shards, seed).filter("blocks > 0")
    dealt = runs.select(F.col("source").alias("ds"), "shard", F.explode(F.sequence("first", F.col("first") + F.col("blocks") - 1)).alias("draw"))
    own = F.sequence(F.lit(0).cast("long"), F.col("passes") - F.when(F.col("room").isNull(), 1).otherwise(0))
    own = F.when((F.col("passes") > 0) | F.col("room").isNotNull(), own).otherwise(F.array().cast("array<bigint>"))
    wanted = blocks.select("source", "block", "n_blocks", F.explode(own).alias("pass"))
    wanted = wanted.select("source", "block", "pass", (F.col("pass") * F.col("n_blocks") + F.col("block")).alias("number"))
    held = wanted.join(dealt, F.col("source").eqNullSafe(F.col("ds")) & (F.col("number") == F.col("draw"))).groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("held"))
    held = held.select(F.col("source").alias("hs"), F.col("block").alias("hb"), "held")
    whole = blocks.join(held, F.col("source").eqNullSafe(F.col("hs")) & (F.col("block") == F.col("hb")), "left")
    whole = whole.select(F.col("source").alias("bs"), F.col("block").alias("bb"), "room", (F.col("room") < F.col("block_size")).alias("cut"), "held")
    whole = keep(whole, "plan")
    keep.drop(blocks, quotas)
    return by_source, whole, shards


def drawn(rows: DataFrame, sources: DataFrame, blocks: DataFrame, seed: int) -> DataFrame:
    """sizes() with source_size, target and draws: pass, words (all of the text's, or the target's rest at the cut), shard and place there."""
    placed = with_source(rows, sources).withColumn("block", F.pmod("key", "n_blocks"))
    placed = placed.join(blocks, F.col("source").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("bb")), "left").drop("bs", "bb")
    inside = placed.filter(~F.coalesce("cut", F.lit(False))).withColumn("part", F.when(F.col("room").isNotNull(), F.col("size")).otherwise(0).cast("long"))
    order = Window.partitionBy("source", "block").orderBy("key", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(order), F.lit(0))
    at_edge = placed.filter("cut").withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - before)).cast("long"))
    draws = F.transform(
        F.coalesce("held", F.array().cast("array<struct<pass:bigint,shard:int>>")),
        lambda x: F.struct(
            x["pass"].alias("pass"),
            F.when(x["pass"] < F.col("passes"), F.col("size")).otherwise(F.col("part")).alias("words"),
            x["shard"].alias("shard"),
            F.xxhash64(F.lit(seed + 1), x["pass"], "key", "mark").alias("place"),
        ),
    )
    return inside.unionByName(at_edge).withColumn("draws", F.filter(draws, lambda x: x["words"] > 0))


def mixed(docs: DataFrame, shards: int | None = None, seed: int = 0) -> DataFrame:
    """A row for each document with its draws from the tree's shards."""
    keep = Scratch(docs.sparkSession)
    rows = keep(sizes(docs, seed=seed).drop("row"), "sizes")
    sources, blocks, _ = planned(rows, keep, shards, seed)
    return drawn(rows, sources, blocks, seed).select("doc_id", "source", "size", "mark", "source_size", "target", "draws")


def whole_draws(draws: str = "draws", size: str = "size") -> Column:
    """Planned draws as whole texts: the one at a source's cut counts whole or not at all, whichever ends nearer the target."""
    taken = F.filter(draws, lambda x: 2 * x["words"] >= F.col(size))
    return F.transform(taken, lambda x: x.withField("words", F.col(size)))


def mixture(docs: DataFrame, shards: int | None = None, seed: int = 0) -> DataFrame:
    """The mix itself: a row for each draw with row, source, pass, words, shard and place; a partition is a shard, in the order of place."""
    keep = Scratch(docs.sparkSession)
    counted = keep(sizes(docs, seed=seed).drop("row"), "sizes")
    sources, blocks, n = planned(counted, keep, shards, seed)
    keep.drop(counted)
    taken = drawn(sizes(docs, seed=seed), sources, blocks, seed).select("row", "doc_id", "source", F.explode(whole_draws()).alias("d"))
    return taken.select("row", "doc_id", "source", "d.*").repartitionById(n, F.col("shard")).sortWithinPartitions("place", "pass")


def draws_of(docs: DataFrame, shards: int | None = None, seed: int = 0) -> DataFrame:
    """doc_id, source, pass, words, shard, place of each draw, shuffled within its shard."""
    return mixture(docs, shards, seed).drop("row")


def mixed_documents(docs: DataFrame, shards: int | None = None, seed: int = 0) -> DataFrame:
    """The documents of the mix, one row for each draw, with their columns, shard after shard and shuffled within; texts are whole."""
    return mixture(docs, shards, seed).select("row.*")
