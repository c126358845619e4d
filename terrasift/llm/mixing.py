"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is cut into ``BLOCKS`` blocks by the leading bits of a seeded hash, which is a
random permutation of its documents. A source's quota is a number of block draws: whole
passes over all blocks, then the first blocks of one more pass. A binary tree deals the exact
quotas to the output shards: at each node the left half's share of every source is drawn from
the multivariate hypergeometric distribution, one conditional draw per source, and the right
half gets the rest. A shard's draws are a run of the source's permuted blocks, disjoint from
all other shards' runs, and rows are shuffled inside their shard only.

To come near the target in words, the last block is opened by the next bits of the hash, then
by rows. Then, ``FILLS`` times, the document whose size is nearest to what is still missing is
drawn, or, once the target is passed, the one nearest to the surplus is taken back.

The tables beside the documents have one row per source, or ``BLOCKS`` rows per source; the
number of sources is taken to fit one task, as in the ordered list of weights itself.

Defined cases: a null text has size 0; null is a source of its own, the last one; documents
of size 0 take 0 words; fully repeated rows share a fate; if no text has words, all targets
are 0; an empty table gives an empty result; other columns are ignored by ``quotas`` and
carried by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.llm.common import WORD, row_mark, stage, text_of

BLOCK_BITS = 10
BLOCKS = 1 << BLOCK_BITS
#: Output shards at least, a power of two, and words that a shard is to hold about.
SHARDS, SHARD_WORDS = 64, 20_000_000
WEIGHTS = (1, 2, 3)
MOST = 3  # passes over a source
SEED = 17
#: Documents that may be drawn or taken back to close the gap between the last block and the target.
FILLS = 6
#: Standard deviations of a draw that are walked; the rest weighs less than a rounding error.
SPREAD = 9.0


def words(text: str | Column = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def draw_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), row_mark())


def digit(key: Column, level: int) -> Column:
    """Block number at a level: 0 for the blocks, 1 for the blocks of a block."""
    return F.shiftrightunsigned(key, 64 - BLOCK_BITS * (level + 1)).bitwiseAND(F.lit(BLOCKS - 1)).cast("int")


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of the named columns."""
    condition = left[names[0]].eqNullSafe(right[names[0]])
    for name in names[1:]:
        condition &= left[name].eqNullSafe(right[name])
    return condition


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, key) of every row, written once."""
    return stage(docs.select("doc_id", "source", words().alias("size"), draw_key(seed).alias("key")), "mix-sizes")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, place, source_size, target): words per source, capped and reshared by weight.

    With targets ``min(most * size, level * weight)`` the level that shares all words is found
    over the sources in the order in which they reach their cap.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    capped = (
        totals.withColumn("place", place).withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    order = Window.orderBy("ratio", "place")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = capped.withColumn("level", level).withColumn(
        "level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(every)["level"]
    )
    return levelled.select(
        "source", "place", "source_size",
        F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.lit(0.0)).alias("target"),
    )


def _opened(groups: DataFrame, keys: list[str], block: str, rest: str) -> DataFrame:
    """Of each group's blocks ``(keys, block, size, rest)``, the one in which ``rest`` words end.

    Returns (keys, block, left): blocks before it are taken whole, ``left`` words come from it.
    """
    upto = Window.partitionBy(*keys).orderBy(block)
    return (
        groups.withColumn("_sum", F.sum("size").over(upto))
        .filter(F.col("_sum") > F.col(rest))
        .groupBy(*keys).agg(F.min(F.struct(block, (F.col(rest) - F.col("_sum") + F.col("size")).alias("left"))).alias("_b"))
        .select(*keys, F.col("_b")[block].alias(block), F.col("_b")["left"].alias("left"))
    )


def shards_for(sized: DataFrame) -> int:
    """Number of shards, doubled until a shard holds about ``SHARD_WORDS`` words."""
    words_in_all, shards = sized.agg(F.sum("size")).first()[0] or 0, SHARDS
    while shards * SHARD_WORDS < words_in_all:
        shards *= 2
    return shards


def quotas(sized: DataFrame, shards: int = SHARDS, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row per source: target, whole passes, where the last pass ends, and shard runs.

    ``runs[k]`` is the number of draws of this source in the shards up to k.
    """
    goal = stage(
        targets(sized, weights, most)
        .withColumn("passes", F.floor(F.try_divide("target", "source_size")).cast("int"))
        .fillna(0, ["passes"])
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")),
        "mix-targets",
    )
    partial = goal.filter(F.col("rest") > 0).select("source", "place", "rest")
    rows = sized.select("source", "size", "key", digit(F.col("key"), 0).alias("b0"), digit(F.col("key"), 1).alias("b1"))

    first = rows.groupBy("source", "b0").agg(F.sum("size").alias("size"))
    first = first.join(partial, same(first, partial, "source")).select("place", "b0", "size", "rest")
    open0 = _opened(first, ["place"], "b0", "rest")
    open0 = stage(partial.join(open0, "place").select("source", "place", F.col("b0").alias("at0"), "left"), "mix-opened")

    inside = rows.join(open0, same(rows, open0, "source") & (rows["b0"] == open0["at0"])).select("place", "b1", "size", "key", "left")
    open1 = _opened(
        inside.groupBy("place", "b1", "left").agg(F.sum("size").alias("size")).withColumnRenamed("left", "rest"),
        ["place"], "b1", "rest",
    ).select("place", F.col("b1").alias("at1"), F.col("left").alias("left1"))

    # Single rows of the opened block of a block, in hash order, while they fit.
    narrow = inside.join(open1, "place").filter(F.col("b1") == F.col("at1"))
    summed = narrow.withColumn("_sum", F.sum("size").over(Window.partitionBy("place").orderBy("key")))
    fits = summed.groupBy("place", "at1", "left1").agg(
        F.max(F.when(F.col("_sum") <= F.col("left1"), F.col("_sum"))).alias("used"),
        # Row keys share their leading bits here, so signed order is the order of the window.
        F.max(F.when(F.col("_sum") <= F.col("left1"), F.col("key"))).alias("last_key"),
    )
    edge = goal.join(open0.select("place", "at0"), "place", "left").join(fits, "place", "left").withColumn(
        "missing", F.col("left1") - F.coalesce("used", F.lit(0))
    )

    # Documents whose sizes come nearest to the words still missing or drawn too many, one a round.
    none = F.array().cast("array<bigint>")
    full = stage(edge.withColumns({"fill_keys": none, "back_keys": none}), "mix-edges")
    for _ in range(FILLS):
        wanted = full.filter("missing != 0").select("source", "place", "at0", "at1", "last_key", "missing", "fill_keys", "back_keys")
        drawn = in_last_pass()
        free = ~drawn & ~F.array_contains("back_keys", F.col("key"))
        others = rows.join(wanted, same(rows, wanted, "source")).filter(F.when(F.col("missing") > 0, free).otherwise(drawn))
        off = F.abs(F.col("size") - F.abs("missing"))
        step = others.filter(off < F.abs("missing")).groupBy("place").agg(F.min(F.struct(off.alias("off"), "size", "key")).alias("_f"))
        add, back = (F.col("_f").isNotNull() & (F.signum("missing") == sign) for sign in (1, -1))
        full = full.join(step, "place", "left").withColumns({
            "fill_keys": F.when(add, F.concat("fill_keys", F.array("_f.key"))).otherwise(F.col("fill_keys")),
            "back_keys": F.when(back, F.concat("back_keys", F.array("_f.key"))).otherwise(F.col("back_keys")),
            "missing": F.col("missing") - F.coalesce(F.signum("missing").cast("long") * F.col("_f.size"), F.lit(0)),
        }).drop("_f")
        full = stage(full, "mix-filled")
    full = stage(full.withColumn(
        "draws", F.col("passes") * BLOCKS + F.when(F.col("at0").isNull(), 0).otherwise(F.col("at0") + 1)
    ), "mix-quotas")
    # The split reads one short list per source and writes one per shard and source.
    return stage(full.join(runs(full, shards, seed), "place"), "mix-plan")


def in_last_pass() -> Column:
    """Whether a row with ``key, b0, b1`` is drawn once more than its source's whole passes."""
    inner = (F.col("b1") < F.col("at1")) | ((F.col("b1") == F.col("at1")) & (F.col("key") <= F.col("last_key")))
    drawn = (F.col("b0") < F.col("at0")) | ((F.col("b0") == F.col("at0")) & F.coalesce(inner, F.col("b1") < F.col("at1")))
    filled = F.coalesce(drawn, F.lit(False)) | F.coalesce(F.array_contains("fill_keys", F.col("key")), F.lit(False))
    return filled & ~F.coalesce(F.array_contains("back_keys", F.col("key")), F.lit(False))


def hypergeometric(uniform: Column, special: Column, everything: Column, drawn: Column) -> Column:
    """Number of special items among ``drawn`` of ``everything``, by inverting the distribution.

    The probabilities follow from their ratios, walked over the values within SPREAD
    deviations of the mean.
    """
    k_, n_, d_ = special.cast("double"), everything.cast("double"), drawn.cast("double")
    mean = d_ * k_ / F.greatest(n_, F.lit(1.0))
    deviation = F.sqrt(mean * (1 - k_ / F.greatest(n_, F.lit(1.0))) * (n_ - d_) / F.greatest(n_ - 1, F.lit(1.0)))
    reach = deviation * SPREAD + 6
    low = F.greatest(F.lit(0.0), d_ - (n_ - k_), F.floor(mean - reach).cast("double")).cast("long")
    high = F.least(k_, d_, F.ceil(mean + reach).cast("double")).cast("long")
    given = F.array(F.struct(
        k_.alias("k"), n_.alias("n"), d_.alias("d"), F.sequence(low, high).alias("values"), high.alias("high")
    ))

    def step(g: Column, x: Column) -> Column:
        return (g["k"] - x) * (g["d"] - x) / ((x + 1) * (g["n"] - g["k"] - g["d"] + x + 1))

    weighed = F.transform(given, lambda g: F.struct(g.alias("g"), F.aggregate(
        g["values"], F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s")),
        lambda a, x: F.struct((a["w"] * step(g, x)).alias("w"), (a["s"] + a["w"]).alias("s")),
        lambda a: a["s"] * uniform,
    ).alias("u")))
    return F.transform(weighed, lambda t: F.aggregate(
        t["g"]["values"], F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), low.alias("x")),
        lambda a, x: F.struct(
            (a["w"] * step(t["g"], x)).alias("w"), (a["s"] + a["w"]).alias("s"),
            F.when(a["s"] + a["w"] < t["u"], F.least(x + 1, t["g"]["high"])).otherwise(a["x"]).alias("x"),
        ),
        lambda a: a["x"],
    ))[0]


def runs(full: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(place, runs): the splitting tree from the vector of all draws down to the shards."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    root = full.agg(F.sort_array(F.collect_list(F.struct("place", "draws"))).alias("q")).select(
        F.lit(1).cast("long").alias("node"), F.transform("q", lambda x: x["draws"].cast("long")).alias("q")
    )
    nodes = root
    for _ in range(shards.bit_length() - 1):
        every = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        numbered = F.transform("q", lambda x, i: F.struct(x.alias("q"), i.alias("i")))
        start = F.struct(
            every.alias("n"), F.floor((every + 1) / 2).cast("long").alias("d"), F.array().cast("array<bigint>").alias("out")
        )

        def deal(acc: Column, item: Column) -> Column:
            hashed = F.xxhash64(F.lit(seed), F.col("node"), item["i"])
            uniform = F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53))
            taken = F.transform(
                F.array(hypergeometric(uniform, item["q"], acc["n"], acc["d"])), lambda x: F.struct(
                    (acc["n"] - item["q"]).alias("n"), (acc["d"] - x).alias("d"), F.concat(acc["out"], F.array(x)).alias("out")
                )
            )
            return taken[0]

        dealt = nodes.select("node", "q", F.explode(F.array(
            F.aggregate(numbered, start, deal, lambda a: a["out"])
        )).alias("left"))
        nodes = dealt.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", "left", lambda a, b: a - b).alias("q")),
        )).alias("c")).select("c.node", "c.q")
    leaves = stage(nodes.select((F.col("node") - shards).alias("shard"), F.posexplode("q").alias("place", "n")), "mix-leaves")
    upto = F.sum("n").over(Window.partitionBy("place").orderBy("shard"))
    return leaves.select("place", "shard", upto.alias("end")).groupBy("place").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("runs")
    )


def with_copies(rows: DataFrame, plan: DataFrame, most: int = MOST) -> DataFrame:
    """``rows(source, key, ...)`` with the source's target, ``copies`` and each copy's shard."""
    placed = rows.withColumns({"b0": digit(F.col("key"), 0), "b1": digit(F.col("key"), 1)})
    joined = placed.join(plan.withColumnRenamed("source", "_source"), placed["source"].eqNullSafe(F.col("_source")))
    copies = F.least(F.col("passes") + in_last_pass().cast("int"), F.lit(most))
    # A document drawn to fill the gap belongs to the source's last draw.
    number = F.transform(
        F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>")),
        lambda e: e * BLOCKS + F.when(e == F.col("passes"), F.least("b0", "at0")).otherwise(F.col("b0")),
    )
    shards = F.transform(number, lambda t: F.size(F.filter("runs", lambda end: end <= t)))
    return joined.withColumn("copies", copies).withColumn("shards", shards)


def amounts(docs: DataFrame, shards: int | None = None, seed: int = SEED, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, shards."""
    sized = sizes(docs, seed)
    return with_copies(sized, quotas(sized, shards or shards_for(sized), seed=seed, **how)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "shards"
    )


def mix(docs: DataFrame, shards: int | None = None, seed: int = SEED, **how) -> DataFrame:
    """The mixed documents, repeated as drawn, by shard and in random order inside a shard."""
    sized = sizes(docs, seed)
    shards = shards or shards_for(sized)
    plan = quotas(sized, shards=shards, seed=seed, **how)
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("_row"), "source", draw_key(seed).alias("key"))
    drawn = with_copies(rows, plan).select("_row", "key", F.posexplode("shards").alias("_pass", "_shard"))
    return (
        drawn.repartition(shards, "_shard")
        .sortWithinPartitions("_shard", F.xxhash64(F.lit(seed + 1), "key", "_pass"))
        .select(*[F.col("_row").getField(c).alias(c) for c in names])
    )
