"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetrail.llm.common import word_count

# Weights of the sources in code-point order, repeating; fixed values of the mix, as are the two ratios.
WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_REPEATS = 2
#: Rows of a source that are drawn together.
BLOCK_ROWS = 1024


def _let(value: Column, body) -> Column:
    """Name a value inside an expression, so that it is computed once."""
    return F.transform(F.array(value), body)[0]


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / float(1 << 52)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many marked ones are among ``drawn`` of ``total``: the inverse distribution at ``u``.

    Walks the probabilities by their ratio from eight standard deviations below the mean to eight
    above; what lies outside has a weight below 1e-13.
    """
    n, k, d = total.cast("double"), marked.cast("double"), drawn.cast("double")
    mean = F.when(n > 0, d * k / n).otherwise(0.0)
    reach = F.when(n > 1, 8 * F.sqrt(F.greatest(d * (k / n) * (1 - k / n) * (n - d) / (n - 1), F.lit(0.0)))).otherwise(0.0) + 2
    bounds = F.struct(
        n.alias("n"),
        k.alias("k"),
        d.alias("d"),
        u.alias("u"),
        F.greatest(F.lit(0.0), d + k - n, F.floor(mean - reach).cast("double")).cast("long").alias("lo"),
        F.least(k, d, F.ceil(mean + reach).cast("double")).cast("long").alias("hi"),
    )

    def draw(b: Column) -> Column:
        steps = F.when(b["hi"] > b["lo"], F.sequence(b["lo"], b["hi"] - 1)).otherwise(F.array().cast("array<bigint>"))

        def next_weight(w: Column, x: Column) -> Column:
            return w * (b["k"] - x) * (b["d"] - x) / ((x + 1) * (b["n"] - b["k"] - b["d"] + x + 1))

        def add(acc: Column, x: Column) -> Column:
            w = next_weight(acc["w"], x)
            return F.struct(w.alias("w"), (acc["sum"] + w).alias("sum"))

        mass = F.aggregate(steps, F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum")), add)["sum"]

        def seek(goal: Column) -> Column:
            def walk(acc: Column, x: Column) -> Column:
                w = next_weight(acc["w"], x)
                return F.struct(
                    w.alias("w"), (acc["sum"] + w).alias("sum"), F.when(acc["sum"] <= goal, x + 1).otherwise(acc["at"]).alias("at")
                )

            start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), b["lo"].alias("at"))
            return F.aggregate(steps, start, walk)["at"]

        return _let(mass * b["u"], seek)

    return _let(bounds, draw)


def splitting_tree(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """Blocks of each source per shard.

    ``quotas`` is one row with ``quotas``: an array of (source, n). Each level halves every node's
    blocks; what a source gives to the left half is drawn from the hypergeometric distribution given
    what the sources before it gave, so a node's draw is multivariate hypergeometric, all quotas
    are met exactly, and any two shards of one level differ by at most one block for each level.
    """
    if n_shards < 1 or n_shards & (n_shards - 1):
        raise ValueError("the number of shards must be a power of two")
    nodes = quotas.select(F.lit(0).alias("node"), "quotas")
    for level in range(n_shards.bit_length() - 1):
        left_total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q["n"])
        side = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("node")), F.lit(2))
        start = F.struct(
            left_total.alias("total"),
            F.floor((left_total + side) / 2).cast("long").alias("left"),
            F.array().cast("array<bigint>").alias("taken"),
        )

        def give(acc: Column, q: Column) -> Column:
            u = _uniform(F.lit(seed), F.col("level"), F.col("node"), F.coalesce(q["source"], F.lit("\x00")))
            x = F.least(hypergeometric(acc["total"], q["n"], acc["left"], u), acc["left"])
            return _let(
                x.cast("long"),
                lambda v: F.struct(
                    (acc["total"] - q["n"]).alias("total"), (acc["left"] - v).alias("left"), F.concat(acc["taken"], F.array(v)).alias("taken")
                ),
            )

        nodes = nodes.withColumn("level", F.lit(level)).withColumn("taken", F.aggregate("quotas", start, give)["taken"])
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.zip_with("quotas", "taken", lambda q, t: F.struct(q["source"].alias("source"), t.alias("n"))).alias("quotas")),
            F.struct(
                (F.col("node") * 2 + 1).alias("node"),
                F.zip_with("quotas", "taken", lambda q, t: F.struct(q["source"].alias("source"), (q["n"] - t).alias("n"))).alias("quotas"),
            ),
        )
        nodes = nodes.select(F.explode(halves).alias("half")).select("half.*")
    return nodes.select(F.col("node").alias("shard"), F.explode("quotas").alias("q")).select("shard", F.col("q.source").alias("source"), F.col("q.n").alias("n"))


def targets(sizes: DataFrame) -> DataFrame:
    """Target words per source: shares by weight, none above its cap, the excess reshared by weight.

    ``sizes`` has one row per source (``source``, ``words``, ``rows``). Filling sources in the order
    in which they reach their caps finds the level at which the shares add up.
    """
    # One row per source, not per document, is ordered in one task.
    named = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(w) for w in WEIGHTS])
    weighed = sizes.withColumn("weight", F.get(pattern, F.pmod(F.row_number().over(named) - 1, F.lit(len(WEIGHTS)))).cast("double")).withColumn(
        "cap", MOST_REPEATS * F.col("words").cast("double")
    )
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, later = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    goal = TOTAL_SHARE * F.sum("words").over(everything)
    level = (goal - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)
    levelled = weighed.withColumn("level", level).withColumn("nth", F.row_number().over(filling))
    # The first source in that order that stays below its cap, and so do all after it.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("nth", "level"))
    reached = F.min(fits).over(everything)["level"]
    return levelled.withColumn("target", F.least("cap", F.coalesce(reached, F.lit(float("inf"))) * F.col("weight"))).select(
        "source", "words", "rows", "target"
    )


def mix_sources(
    docs: DataFrame,
    n_shards: int = 16,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] = (),
) -> DataFrame:
    """What the mix takes of every row, and where each taken copy goes.

    A source is cut by hash into blocks of about 1024 rows. It gives all its blocks as often as its
    target fits, then blocks in permuted order until the target is met; the last of these gives
    rows in permuted order, the last row as many leading words as are missing. So a source's taken
    words equal its target rounded to a word. The drawn blocks are split among the shards
    by ``splitting_tree``; each shard takes the next blocks of every source's permuted list and
    orders rows by ``place``.

    Result: id, ``source``, ``size``, ``source_size``, ``target``, ``taken`` and ``draws``, an array
    of (shard, words, place), one for each time the row is taken, and the columns named in ``keep``
    under ``kept``, a struct, so their names cannot clash.

    Null texts have size 0. The null source is a source of its own, named last. Rows that are
    equal in id and text are one after another in the permuted order and each counted. A source
    without words gets target 0. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("__id"),
        F.col(source_col).alias("source"),
        word_count(text).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("__hash"),
        F.struct(*[F.col(c) for c in keep] or [F.lit(None).alias("nothing")]).alias("kept"),
    )
    narrow = base.select("source", "size", "__hash")
    goals = targets(narrow.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))).select(
        F.col("source").alias("g_source"),
        F.col("words").alias("source_size"),
        "target",
        F.ceil(F.col("rows") / BLOCK_ROWS).cast("long").alias("n_blocks"),
        F.floor(F.col("target") + 0.5).cast("long").alias("goal"),
    )
    same_source = F.col("source").eqNullSafe(F.col("g_source"))
    block = F.pmod(F.col("__hash"), F.col("n_blocks")).alias("block")

    blocks = (
        narrow.join(goals, same_source)
        .groupBy("source", block)
        .agg(F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("source_size", "target", "goal")])
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("goal") - F.col("passes") * F.col("source_size"))
        .withColumn("order", F.xxhash64(F.lit(seed), F.lit("order"), F.col("source"), F.col("block")))
    )
    permuted = Window.partitionBy("source").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("missing", F.greatest(F.col("rest") - F.coalesce(F.sum("words").over(permuted), F.lit(0)), F.lit(0))).withColumn(
        "tickets", F.col("passes") + F.when((F.col("missing") > 0) & (F.col("words") > 0), 1).otherwise(0)
    )
    quotas = (
        blocks.groupBy("source")
        .agg(F.sum("tickets").cast("long").alias("n"))
        .agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("quotas"))
    )
    leaves = splitting_tree(quotas, n_shards, seed)
    ends = (
        leaves.withColumn("end", F.sum("n").over(Window.partitionBy("source").orderBy("shard")))
        .groupBy("source")
        .agg(F.array_sort(F.collect_list("end")).alias("ends"))
        .withColumnRenamed("source", "e_source")
    )
    # Where the first, second, ... draw of a block stands in its source's permuted list of draws.
    ticket = Window.partitionBy("source").orderBy("t_order", "block", "copy")
    tickets = (
        # A sequence from 1 to 0 would count down.
        blocks.where("tickets > 0")
        .select("source", "block", F.explode(F.sequence(F.lit(1), F.col("tickets").cast("int"))).alias("copy"))
        .withColumn("t_order", F.xxhash64(F.lit(seed), F.lit("ticket"), F.col("source"), F.col("block"), F.col("copy")))
        .withColumn("at", F.row_number().over(ticket) - 1)
        .join(ends, F.col("source").eqNullSafe(F.col("e_source")))
        .select("source", "block", F.struct("copy", F.size(F.filter("ends", lambda e: e <= F.col("at"))).alias("shard")).alias("t"))
        .groupBy("source", "block")
        .agg(F.array_sort(F.collect_list("t")).alias("shards"))
        .select(F.col("source").alias("t_source"), F.col("block").alias("t_block"), "shards")
    )
    plan = blocks.join(tickets, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("block") == F.col("t_block")), "left").select(
        F.col("source").alias("p_source"), F.col("block").alias("p_block"), "source_size", "target", "passes", "missing", "shards"
    )
    rows = base.join(goals.select("g_source", "n_blocks"), same_source).withColumn("block", block)
    inside = Window.partitionBy("source", "block").orderBy("__hash", F.col("__id").asc_nulls_last())
    rows = rows.withColumn(
        "__before", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("__nth", F.row_number().over(inside))
    drawn = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("block") == F.col("p_block")))
    partial = F.least("size", F.greatest(F.col("missing") - F.col("__before"), F.lit(0)))
    drawn = drawn.withColumn("__partial", partial)
    copies = F.transform(
        F.coalesce("shards", F.array().cast("array<struct<copy:int,shard:int>>")),
        lambda t: F.struct(
            t["shard"].alias("shard"),
            F.when(t["copy"] <= F.col("passes"), F.col("size")).otherwise(F.col("__partial")).alias("words"),
            F.xxhash64(F.lit(seed), F.lit("place"), t["copy"], F.col("__hash"), F.col("__nth")).alias("place"),
        ),
    )
    return drawn.select(
        F.col("__id").alias(id_col),
        "source",
        "size",
        "source_size",
        "target",
        (F.col("passes") * F.col("size") + F.col("__partial")).alias("taken"),
        F.filter(copies, lambda c: c["words"] > 0).alias("draws"),
        "kept",
    )
