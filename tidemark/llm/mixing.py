"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sources are cut into blocks by a hash of the row, about BLOCKS of all words and rows together and one at
least a source. A source whose target is r times its words gives all its blocks floor(r) times and, in a
last pass, blocks in permuted order up to the rest. The block in which the rest ends gives its sub-blocks
in permuted order up to what is missing, and the sub-block in which that ends its rows, so a source
misses its target by half a row (or half a group of equal rows) at most, whatever other sources there are.

The block draws of all sources are dealt to the output shards by a splitting tree: a node over some
shards holds exact quotas; its left half gets a multivariate-hypergeometric draw of them, the right half
what is left. The tree runs over GROUPS groups of sources first, on the driver, then inside each group
over its sources, in a task, which is the same law. Each shard then takes the next blocks of every
source's permuted list, disjoint from the other shards', and a shard's rows are ordered by a hash.

Spark sums words, plans and writes the mixture; the plan is a table with a row for each block, joined by
source and block, and the driver sees sums of groups only. Sources of more than one block are at most
2 BLOCKS, so the table that tells a row its block is small. This holds up to some hundred million sources.

Defined cases: a null text has size 0; null is a source of its own, the last; repeated rows are drawn
alike; a source without words is drawn as often as its target of 0 words says, so not at all; an
empty table gives an empty mixture. Other columns, clashing names included, pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidemark.llm import wordhash as W
from tidemark.llm.storage import materialise

SHARDS, BLOCKS, MOST = 16, 1024, 3.0
#: Rows that a block holds at least on average, and sub-blocks of a block.
BLOCK_ROWS, SUB_BLOCKS = 32, 4096
#: Groups of sources whose quotas the driver splits.
GROUPS = 1024


@F.arrow_udf(T.LongType())
def word_count(texts: pa.Array) -> pa.Array:
    """Words of each text, runs of other characters than ASCII white space; 0 for null."""
    out = []
    for _, data, at in W.slices(texts):
        inside = W.NOT_WHITE[data]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        heads = at[:-1][at[:-1] < at[1:]]
        starts[heads] = inside[heads]
        out.append(W.per_text(starts, at))
    W.give_back()
    return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64())


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of all words by weight; a target stops at ``most`` times its size, the excess is shared again by weight among the others."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        whole = sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] / whole > most * sizes[i]]
        if not above:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        for i in above:
            out[i] = most * sizes[i]
            free.discard(i)
        left -= sum(out[i] for i in above)
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """A row of quotas for each shard; rows add up to ``quotas`` exactly."""
    if shards == 1:
        return quotas[None, :]
    half = shards // 2
    left = rng.multivariate_hypergeometric(quotas, int(quotas.sum()) * half // shards, method="marginals")
    return np.concatenate([split_quotas(left, half, rng), split_quotas(quotas - left, shards - half, rng)])


def deal_quotas(quotas: np.ndarray, totals: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """``quotas`` split so that row k adds up to ``totals[k]``: the tree below a node whose shards' totals are drawn."""
    if len(totals) == 1:
        return quotas[None, :]
    half = len(totals) // 2
    left = rng.multivariate_hypergeometric(quotas, int(totals[:half].sum()), method="marginals")
    return np.concatenate([deal_quotas(left, totals[:half], rng), deal_quotas(quotas - left, totals[half:], rng)])


def _narrow(docs: DataFrame, extra: list[F.Column]) -> DataFrame:
    return docs.select(F.col("source").alias("mix·source"), word_count("text").alias("mix·size"), F.xxhash64("doc_id", "text").alias("mix·hash"), *extra)


def _sub() -> F.Column:
    return F.pmod(F.xxhash64("mix·hash"), F.lit(SUB_BLOCKS)).cast("int")


def _in_order(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with mix·rank, their place from 0 in a total order: ranges are sorted apart, and a row a range tells how many rows stand before it."""
    dealt = materialise(rows.repartitionByRange(*order).withColumn("mix·part", F.spark_partition_id()), "mix-order")
    before = dealt.groupBy("mix·part").agg(F.count("*").alias("n")).withColumn("mix·before", F.sum("n").over(Window.orderBy("mix·part")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("mix·part").orderBy(*order)) - 1
    return dealt.join(F.broadcast(before), "mix·part").withColumn("mix·rank", place + F.col("mix·before")).drop("mix·part", "mix·before")


def _target_table(narrow: DataFrame) -> DataFrame:
    """(mix·name, mix·source_size, mix·blocks, mix·target) of each source: ``targets`` as a table. Each round is one sum over the sources."""
    sizes = narrow.groupBy(F.col("mix·source").alias("mix·name")).agg(F.sum("mix·size").alias("mix·source_size"), F.count("*").alias("n"))
    named = _in_order(sizes.where("`mix·name` IS NOT NULL"), "mix·name")
    last = sizes.where("`mix·name` IS NULL").withColumn("mix·rank", F.lit(named.count()))
    rows = materialise(named.unionByName(last).withColumn("w", 1.0 + F.col("mix·rank") % 3).drop("mix·rank"), "mix-sources")
    cap, share, stopped = MOST * F.col("mix·source_size"), 0.0, -1
    total, n = (x or 0 for x in rows.agg(F.sum("mix·source_size"), F.sum("n")).first())
    blocks = F.least(F.greatest(F.ceil(BLOCKS * F.col("mix·source_size") / max(1, total)), F.ceil(BLOCKS * F.col("n") / max(1, n))), F.floor(F.col("n") / BLOCK_ROWS))
    rows = rows.withColumn("mix·blocks", F.greatest(blocks, F.lit(1)).cast("int")).drop("n")
    while True:
        above = F.lit(share) * F.col("w") > cap
        got = rows.agg(F.count_if(above), F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("w")))).first()
        if got[0] == stopped or not got[2]:
            return rows.withColumn("mix·target", F.when(above, cap).otherwise(F.lit(share) * F.col("w"))).drop("w")
        stopped, share = got[0], (total - got[1]) / got[2]


def _placed(narrow: DataFrame, sources: DataFrame) -> DataFrame:
    """``narrow`` with mix·place, the block of each row. Only sources of several blocks are looked up, at most 2 BLOCKS."""
    several = F.broadcast(sources.where("`mix·blocks` > 1").select(F.col("mix·name").alias("mix·of"), F.col("mix·blocks").alias("mix·n")))
    rows = narrow.join(several, F.col("mix·source").eqNullSafe(F.col("mix·of")), "left")
    return rows.withColumn("mix·place", F.pmod("mix·hash", F.coalesce("mix·n", F.lit(1))).cast("int")).drop("mix·of", "mix·n")


def _before(order: str, key: str, cut_order: str, cut_key: str) -> F.Column:
    return (F.col(order) < F.col(cut_order)) | ((F.col(order) == F.col(cut_order)) & (F.col(key) < F.col(cut_key)))


def _ends(dealt: DataFrame, ending: DataFrame, seed: int) -> DataFrame:
    """(name, sub_order, sub, row_order, row_hash) of each source of ``ending`` (name, at, left): its block gives the sub-blocks before ``sub`` in the permuted order and, in that, the rows up to ``row_hash`` (null: none)."""
    of = lambda w, *by: Window.partitionBy(*by).orderBy(*w)
    rows = dealt.join(ending, F.col("mix·source").eqNullSafe(F.col("name")) & (F.col("mix·place") == F.col("at"))).select("name", "left", "mix·size", "mix·hash", _sub().alias("sub")).withColumn("sub_order", F.xxhash64(F.lit(seed + 1), "sub"))
    rows = materialise(rows, "mix-ends")
    subs = rows.groupBy("name", "left", "sub_order", "sub").agg(F.sum("mix·size").alias("n")).withColumn("upto", F.sum("n").over(of(("sub_order", "sub"), "name")))
    cut = subs.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("n") <= F.col("left"))).select(F.col("name").alias("cut_name"), "sub_order", "sub", (F.col("left") - F.col("upto") + F.col("n")).alias("still"))
    inner = rows.drop("sub_order").withColumnRenamed("sub", "own_sub").join(cut, F.col("name").eqNullSafe(F.col("cut_name")) & (F.col("own_sub") == F.col("sub")))
    inner = inner.groupBy("name", "sub_order", "sub", "still", "mix·hash").agg(F.sum("mix·size").alias("n")).withColumn("row_order", F.xxhash64(F.lit(seed + 3), "mix·hash"))
    inner = inner.withColumn("upto", F.sum("n").over(of(("row_order", "mix·hash"), "name")))
    # one row more if that comes nearer
    fits = (F.col("upto") <= F.col("still")) | ((F.col("upto") - F.col("n") <= F.col("still")) & (F.col("upto") - F.col("still") < F.col("still") - F.col("upto") + F.col("n")))
    found = inner.groupBy("name", "sub_order", "sub").agg(F.max(F.when(fits, F.struct("row_order", "mix·hash"))).alias("last"))
    return found.select("name", "sub_order", "sub", F.col("last.row_order").alias("row_order"), F.col("last.`mix·hash`").alias("row_hash"))


def _dealt(blocks: DataFrame, seed: int) -> DataFrame:
    """(name, at, shards): the shards of each block's draws, in order, by the tree over groups and over their sources."""
    group = F.pmod(F.xxhash64("mix·name"), F.lit(GROUPS)).cast("int")
    draws = materialise(blocks.where("draws > 0").groupBy("mix·name").agg(F.sum("draws").cast("long").alias("q")).withColumn("g", group), "mix-draws")
    sums = np.zeros(GROUPS, np.int64)
    for r in draws.groupBy("g").agg(F.sum("q").alias("q")).collect():  # at most GROUPS rows
        sums[r["g"]] = r["q"]
    totals = split_quotas(sums, SHARDS, np.random.default_rng([seed, 2]))

    def split(rows: pa.Table) -> pa.Table:
        g, rows = rows.column("g")[0].as_py(), rows.sort_by([("mix·name", "ascending")])
        quotas = deal_quotas(rows.column("q").to_numpy(), totals[:, g], np.random.default_rng([seed, 2, g]))
        return pa.table({"name": rows.column("mix·name"), "upto": pa.array(np.cumsum(quotas, axis=0).T.tolist(), pa.list_(pa.int64()))})

    quotas = draws.groupBy("g").applyInArrow(split, "name string, upto array<long>")
    each = blocks.where("draws > 0").select("mix·name", F.col("mix·at").alias("at"), F.explode(F.sequence(F.lit(1), F.col("draws"))).alias("i"))
    place = F.row_number().over(Window.partitionBy("mix·name").orderBy(F.xxhash64(F.lit(seed + 2), "mix·name", "at", "i"), "at", "i")) - 1
    each = each.withColumn("place", place).join(quotas, F.col("mix·name").eqNullSafe(F.col("name")))
    shard = F.size(F.filter("upto", lambda u: u <= F.col("place")))
    return each.select("name", "at", F.struct("i", shard.alias("s")).alias("d")).groupBy("name", "at").agg(F.transform(F.array_sort(F.collect_list("d")), lambda d: d["s"]).alias("s"))


def _plan(narrow: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(sources and their blocks), (for each block: source, size and target of the source, shards of its full draws, shard of its last draw and where that ends)."""
    sources = materialise(_target_table(narrow), "mix-targets")
    dealt = _placed(narrow, sources)
    blocks = dealt.groupBy(F.col("mix·source").alias("name"), F.col("mix·place").alias("mix·at")).agg(F.sum("mix·size").alias("n"))
    rows = blocks.join(sources, F.col("name").eqNullSafe(F.col("mix·name"))).drop("name")
    full = F.when(F.col("mix·source_size") > 0, F.floor(F.col("mix·target") / F.col("mix·source_size") + 1e-9)).otherwise(0)
    upto = F.sum("n").over(Window.partitionBy("mix·name").orderBy(F.xxhash64(F.lit(seed), "mix·name", "mix·at"), "mix·at"))
    rows = rows.withColumns({"full": full, "upto": upto}).withColumn("left", F.col("mix·target") - F.col("full") * F.col("mix·source_size") - (F.col("upto") - F.col("n")))
    ends = (F.col("left") >= 0.5) & (F.col("n") > F.col("left"))
    rows = rows.withColumns({"ends": ends, "draws": (F.col("full") + (F.col("left") >= 0.5).cast("int")).cast("int")})
    rows = materialise(rows, "mix-blocks")
    cuts = _ends(dealt, rows.where("ends").select(F.col("mix·name").alias("name"), F.col("mix·at").alias("at"), "left"), seed).withColumnRenamed("name", "cut_name")
    plan = rows.join(_dealt(rows, seed), F.col("mix·name").eqNullSafe(F.col("name")) & (F.col("mix·at") == F.col("at")), "left").drop("name", "at")
    plan = plan.join(cuts, F.col("mix·name").eqNullSafe(F.col("cut_name")) & F.col("ends"), "left")
    whole = F.coalesce(F.when(F.col("ends"), F.slice("s", F.lit(1), F.size("s") - 1)).otherwise(F.col("s")), F.array().cast("array<int>"))
    columns = [F.col(c).alias(f"mix·{c}") for c in ("sub_order", "sub", "row_order", "row_hash")]
    return sources, materialise(plan.select("mix·name", "mix·at", "mix·source_size", "mix·target", whole.alias("mix·shards"), F.when(F.col("ends"), F.element_at("s", -1)).alias("mix·last"), *columns), "mix-plan")


def draw(docs: DataFrame, keep: list[F.Column], seed: int = 11) -> DataFrame:
    """``keep`` of each row with mix·size, mix·source_size, mix·target and mix·draws, the output shard of each of its draws."""
    sources, plan = _plan(materialise(_narrow(docs, []), "mix-sizes"), seed)
    rows = _placed(_narrow(docs, keep), sources).join(plan, F.col("mix·source").eqNullSafe(F.col("mix·name")) & (F.col("mix·place") == F.col("mix·at")))
    rows = rows.withColumns({"mix·own_sub": _sub(), "mix·own_order": F.xxhash64(F.lit(seed + 3), "mix·hash")}).withColumn("mix·own_sub_order", F.xxhash64(F.lit(seed + 1), "mix·own_sub"))
    upto = _before("mix·own_order", "mix·hash", "mix·row_order", "mix·row_hash") | (F.col("mix·hash") == F.col("mix·row_hash"))
    is_taken = _before("mix·own_sub_order", "mix·own_sub", "mix·sub_order", "mix·sub") | ((F.col("mix·own_sub") == F.col("mix·sub")) & upto)
    more = F.when(is_taken & (F.col("mix·size") > 0), F.array("mix·last"))
    drawn = F.when(F.col("mix·size") > 0, F.col("mix·shards")).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("mix·draws", F.concat(drawn, F.coalesce(more, F.array().cast("array<int>"))))


def shares(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, size, source_size, target of its source, taken (its words in the mixture), draws (output shards)."""
    rows = draw(docs, [F.col("doc_id")])
    return rows.select("doc_id", F.col("mix·size").alias("size"), F.col("mix·source_size").alias("source_size"), F.col("mix·target").alias("target"), (F.col("mix·size") * F.size("mix·draws")).alias("taken"), F.col("mix·draws").alias("draws"))


def mixture(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The mixture: rows of ``docs`` as often as drawn, shard after shard, shuffled inside a shard."""
    rows = draw(docs, [F.struct("*").alias("mix·row")], seed)
    rows = rows.select("mix·row", "mix·hash", F.posexplode("mix·draws").alias("mix·draw", "mix·shard"))
    rows = rows.withColumn("mix·order", F.xxhash64(F.lit(seed), "mix·hash", "mix·draw"))
    return rows.repartitionByRange("mix·shard", "mix·order").sortWithinPartitions("mix·shard", "mix·order").select("mix·row.*")
