"""Mixing sources to target weights by entropy balancing.

Documents get rates w that stay as close as they can to 1 in relative entropy,
sum of w log w - w, under one token constraint per source, sum of w * size =
target, and 0 <= w <= 2. The convex dual has one multiplier per source and the
solution is the exponential tilt w = min(2, exp(lambda_source * size)). Newton
iterations find the multipliers: each sums gradient and curvature over a
histogram of sizes per source (all that the tilt depends on), and is guarded by
a bracket, as the gradient is monotonous.

Rates are then rounded into copies. From a source's longest texts to its
shortest, the number of extra copies follows the running sum of what the rates
ask for; the words that are then missing or too many are made up by a few sizes
of each power of two, from the largest down. Which documents of a size take the
extra copies is decided by a hash of doc_id and text: those below a cut, which
is found in two steps (counts of hash ranges, then the hashes of one range), so
that no task ranks all documents of a size.

Defined cases: null texts have size 0; documents of size 0 are taken as often
as their rate 1 says (no words); a source without words has target 0; a null
source is a source, last in order; an empty table gives none. Rows that are
equal in doc_id and text share their copies: if the cut falls among them, as
many of them as are needed take one more, by their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, every, fresh, stored

#: Weights of sources in order, share of all words, cap.
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
CAP = 2
ROUNDS_PER_CHECK = 4
TOLERANCE = 1e-7
#: Sizes of each power of two that make up what rounding leaves.
MENDED = 8
#: Rows of a per-source or per-size table up to which it is broadcast.
MOST_BROADCAST = 200_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def few(df: DataFrame) -> DataFrame:
    """df, checkpointed; to be broadcast if it has few rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def targets(sources: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, cap: int = CAP) -> DataFrame:
    """sources (source, source_size) with target: what the weights give, at
    most cap * source_size, the excess shared by weight among the others.

    A source is at its cap when cap * size / weight is at most the level L
    with sum of min(cap * size, L * weight) = the total; sorted by that ratio,
    running sums tell L. One row per source is sorted."""
    rank = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(rank) - 1, F.lit(n)) + 1).cast("int"))
    rows = sources.withColumn("_w", F.when(F.col("source_size") > 0, weight).otherwise(F.lit(0)))
    limit = F.col("source_size") * cap
    whole = Window.partitionBy(F.lit(0))
    up = Window.partitionBy(F.lit(0)).orderBy("_ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    total = F.least(F.sum("source_size").over(whole) * F.lit(share_percent) / 100.0, F.sum(limit).over(whole).cast("double"))
    rows = rows.withColumn("_ratio", F.when(F.col("_w") > 0, limit / F.col("_w")).otherwise(F.lit(0.0))).withColumn("_total", total)
    rows = rows.withColumn("_left", F.col("_total") - F.coalesce(F.sum(limit).over(before), F.lit(0)))
    rows = rows.withColumn("_rest", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    level = F.when(F.col("_rest") > 0, F.col("_left") / F.col("_rest"))
    rows = rows.withColumn("_open", (F.col("_w") > 0) & (F.col("_ratio") > level)).withColumn("_level", level)
    place = (F.col("source").isNull().alias("_null"), F.col("source").cast("binary").alias("_name"))
    first = F.min(F.when(F.col("_open"), F.struct("_ratio", *place, "_level"))).over(whole)
    target = F.when(F.col("_w") == 0, F.lit(0.0)).when(F.col("_open"), F.col("_w") * first["_level"]).otherwise(limit.cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def multipliers(histogram: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """source with lambda and scale, so that the rates min(cap, exp(lambda *
    size / scale)) meet the source's target; Newton's iterations, each a
    distributed sum over the histogram, until every source is met or its
    bracket has no number left inside."""
    scale = histogram.groupBy("source").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("scale"), F.min("size").alias("least"))
    state = goals.filter("target > 0").join(scale, goals["source"].eqNullSafe(scale["source"])).select(
        goals["source"], "target", "source_size", "scale", F.lit(0.0).alias("lam"), F.lit(-745.0).alias("lo"), (F.log(F.lit(float(cap))) * F.col("scale") / F.col("least")).alias("hi"), F.lit(1.0).alias("off")
    )
    # at the cap itself all rates are the cap
    state = few(state.withColumn("lam", F.when(F.col("target") >= F.col("source_size") * cap, F.col("hi")).otherwise(F.col("lam"))))
    x = F.col("size") / F.col("scale")
    tilt = F.exp(F.least(F.col("lam") * x, F.lit(700.0)))
    while True:
        for _ in range(ROUNDS_PER_CHECK):
            h = histogram.withColumnRenamed("source", "_s")
            sums = h.join(state, F.col("_s").eqNullSafe(F.col("source"))).groupBy("source", "target", "source_size", "scale", "lam", "lo", "hi").agg(
                F.sum(F.col("n") * F.col("size") * F.least(tilt, F.lit(float(cap)))).alias("got"),
                F.sum(F.when(tilt < cap, F.col("n") * F.col("size") * x * tilt).otherwise(0.0)).alias("curve"),
            )
            over = F.col("got") - F.col("target")
            lo, hi = F.when(over < 0, F.col("lam")).otherwise(F.col("lo")), F.when(over >= 0, F.col("lam")).otherwise(F.col("hi"))
            step = F.col("lam") - F.when(F.col("curve") > 0, over / F.col("curve"))
            met = F.abs(over) <= F.col("target") * TOLERANCE
            half = (F.col("_lo") + F.col("_hi")) / 2
            state = sums.withColumns({"_lo": lo, "_hi": hi, "_step": step}).select(
                "source", "target", "source_size", "scale",
                F.when(met, F.col("lam")).when((F.col("_step") > F.col("_lo")) & (F.col("_step") < F.col("_hi")), F.col("_step")).otherwise(half).alias("lam"),
                F.col("_lo").alias("lo"), F.col("_hi").alias("hi"),
                F.when(met | (half <= F.col("_lo")) | (half >= F.col("_hi")), 0.0).otherwise(F.abs(over) / F.col("target")).alias("off"),
            )
        state = few(state)
        if state.filter(F.col("off") > TOLERANCE).isEmpty():
            return state.select("source", "scale", "lam", "target")


def extra_copies(rates: DataFrame, cap: int = CAP) -> DataFrame:
    """rates (source, target, size, n, rate) with least (copies that each
    document takes) and extra (how many of the n take one more).

    The running sum of extra copies, over sizes from the largest down, is that
    of the rates, rounded. What a source's words then miss is less than half its
    longest text; it is made up by the MENDED most frequent sizes of each power
    of two, from the largest down: at most 63 * MENDED sizes a source."""
    least = F.least(F.floor("rate"), F.lit(cap - 1)).cast("long")
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    rows = rates.withColumn("least", least).withColumn("_sum", F.sum(F.col("n") * (F.col("rate") - F.col("least"))).over(down))
    more = F.round("_sum") - F.round(F.coalesce(F.lag("_sum").over(down), F.lit(0.0)))
    rows = cut(rows.withColumn("extra", F.least(F.greatest(more.cast("long"), F.lit(0).cast("long")), F.col("n"))).select("source", "target", "size", "n", "least", "extra"))
    left = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * (F.col("n") * F.col("least") + F.col("extra")))).alias("left"))
    most = Window.partitionBy("source", "power").orderBy(F.desc("n"), "size")
    some = rows.withColumn("power", F.floor(F.log2("size"))).withColumn("_r", F.row_number().over(most)).filter(F.col("_r") <= MENDED)
    lists = some.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", (F.col("n") - F.col("extra")).alias("up"), F.col("extra").alias("down"))), asc=False).alias("sizes"))

    def step(state, p):
        room = F.when(state["left"] >= 0, p["up"]).otherwise(p["down"])
        m = F.least(room, F.round(F.abs(state["left"]) / p["size"]).cast("long")) * F.when(state["left"] >= 0, 1).otherwise(-1)
        return F.struct((state["left"] - m * p["size"]).alias("left"), F.concat(state["out"], F.array(F.struct(p["size"].alias("size"), m.alias("more")))).alias("out"))

    l2 = left.withColumnRenamed("source", "_s")
    start = F.struct(F.col("left").cast("double").alias("left"), F.array().cast("array<struct<size:bigint,more:bigint>>").alias("out"))
    mended = lists.join(l2, F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), F.explode(F.aggregate("sizes", start, step, lambda s: s["out"])).alias("x")).select("_s", F.col("x.size").alias("_z"), "x.more")
    joined = rows.join(mended, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")), "left")
    return joined.select("source", "size", "n", "least", (F.col("extra") + F.coalesce("more", F.lit(0))).alias("extra"))


def measured(docs: DataFrame) -> Column:
    """A row's source, size and hash."""
    return F.struct(F.col("source").cast("string").alias("source"), size_of(F.col("text").cast("string")).alias("size"), F.xxhash64("doc_id", "text").alias("hash"))


def plan(rows: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """rows: source, size, hash of all documents. Sources with source_size and
    target; and for each source and size: least, cut (hashes below it take one
    more, null: none), of (rows at the cut) and ties (how many of them do)."""
    same = lambda *names: [F.col(x).eqNullSafe(F.col(f"_{x}")) if x == "source" else F.col(x) == F.col(f"_{x}") for x in names]
    renamed = lambda df, *names: df.withColumnsRenamed({x: f"_{x}" for x in names})
    histogram = cut(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    goals = few(targets(histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share_percent, cap))
    filled = histogram.filter("size > 0")
    lam = renamed(multipliers(filled, goals, cap), "source")
    rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(700.0))))
    sizes = few(extra_copies(filled.join(lam, same("source")).select("source", "target", "size", "n", rate.alias("rate")), cap))
    # hash ranges, about as many as rows in one of them
    some = renamed(sizes.filter("extra > 0 and extra < n").select("source", "size", "extra", F.ceil(F.log2("n") / 2).cast("int").alias("bits")), "source", "size")
    part = F.when(F.col("bits") > 0, F.expr("shiftright(hash, 64 - bits)")).otherwise(F.lit(0).cast("long"))
    ranged = rows.join(some, same("source", "size")).select("source", "size", "extra", "hash", part.alias("part"))
    upto = F.sum("c").over(Window.partitionBy("source", "size").orderBy("part"))
    parts = ranged.groupBy("source", "size", "extra", "part").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", upto)
    edge = few(renamed(parts.filter("upto >= extra and upto - c < extra").select("source", "size", "part", (F.col("extra") - F.col("upto") + F.col("c")).alias("more")), "source", "size", "part"))
    near = ranged.join(edge, same("source", "size", "part")).groupBy("source", "size", "more", "hash").agg(F.count(F.lit(1)).alias("c"))
    near = near.withColumn("upto", F.sum("c").over(Window.partitionBy("source", "size").orderBy("hash")))
    at = near.filter("upto >= more and upto - c < more").select(F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("hash").alias("cut"), F.col("c").alias("of"), (F.col("more") - F.col("upto") + F.col("c")).alias("ties"))
    out = sizes.join(few(at), same("source", "size"), "left")
    return goals, few(out.select("source", "size", (F.col("least") + F.when(F.col("extra") == F.col("n"), 1).otherwise(0)).alias("least"), "cut", "of", "ties"))


def with_copies(rows: DataFrame, at: str, sizes: DataFrame, name: str) -> DataFrame:
    """rows with the column name, their copies; at: the column of measured()."""
    plans, salt, some, before, place = fresh(rows, name, "_plan", "_salt", "_some", "_before", "_place")[1:]
    own = sizes.select(F.struct("source", "size", "least", "cut", "of", "ties").alias(plans))
    hint = F.broadcast(own) if sizes.count() <= MOST_BROADCAST else own
    p, x = F.col(plans), F.col(at)
    joined = rows.join(hint, x["source"].eqNullSafe(p["source"]) & (x["size"] == p["size"]), "left")
    split = F.coalesce((p["ties"] < p["of"]) & (x["hash"] == p["cut"]), F.lit(False))
    least = F.coalesce(p["least"], F.lit(1).cast("long"))
    out = joined.filter(~split).withColumn(name, least + F.coalesce(x["hash"] <= p["cut"], F.lit(False)).cast("long")).drop(plans)
    if sizes.filter("ties < of").isEmpty():
        return out
    # equal rows at a cut: by their place in their part of the table
    tied = stored(joined.filter(split).withColumn(salt, F.spark_partition_id()), "ties")
    group = [F.col(f"{plans}.source"), F.col(f"{plans}.size")]
    counts = tied.groupBy(*(g.alias(f"_{i}") for i, g in enumerate(group)), F.col(salt).alias("_2")).agg(F.count(F.lit(1)).alias(some))
    counts = cut(counts.withColumn(before, F.sum(some).over(Window.partitionBy("_0", "_1").orderBy("_2")) - F.col(some)))
    share = lambda n: F.floor(p["ties"] * n / p["of"])
    met = tied.join(counts, group[0].eqNullSafe(F.col("_0")) & (group[1] == F.col("_1")) & (F.col(salt) == F.col("_2")))
    met = met.withColumn(place, F.row_number().over(Window.partitionBy("_0", "_1", "_2").orderBy(F.lit(0))))
    more = F.col(place) <= share(F.col(before) + F.col(some)) - share(F.col(before))
    return out.unionByName(met.withColumn(name, least + more.cast("long")).select(*every(rows), name))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies."""
    rows = stored(docs.select("doc_id", measured(docs).alias("at")), "sizes")
    goals, sizes = plan(rows.select("at.*"))
    goals = goals.withColumnRenamed("source", "_source")
    out = with_copies(rows, "at", sizes, "copies").select("doc_id", "at.source", "at.size", "copies").join(goals, F.col("source").eqNullSafe(F.col("_source")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame) -> DataFrame:
    """docs with every row as often as the mix takes it. The texts stay where
    they are unless the table of sizes is too large to be broadcast."""
    at, name = fresh(docs, "_at", "_copies")
    _, sizes = plan(stored(docs.select(measured(docs).alias("at")).select("at.*"), "sizes"))
    out = with_copies(docs.withColumn(at, measured(docs)), at, sizes, name)
    return out.filter(F.col(name) > 0).withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(name)))).select(*every(docs))
