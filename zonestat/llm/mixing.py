"""Mixing sources to target weights by entropy balancing, in DataFrame functions alone.

Of all document rates that give each source its target number of words, those are taken that lie
closest, in relative entropy, to one copy of every document, with at most CAP copies. The convex dual
has one multiplier for each source: a document's rate is min(CAP, exp(multiplier * size / mean size)).
Newton steps, kept inside a bracket, are Spark aggregations over the counts of documents by source and
size; each step's multipliers are written to the shared folder. Rates become whole copies: the
fractional copies of a source are summed from small documents to large and cut at whole numbers, a
few groups of equal sizes make up for what is left, and inside a group the copies are spread evenly.

Sources that are null are one source, last in order. Null texts have no words. A source whose target
is all that CAP allows has rate CAP. Documents without words take none. Rows that repeat an id are
documents of their own. Other columns are ignored; an empty table gives an empty result.

Groups of one source and size may be large: their documents are numbered in parts of PART, about.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

CAP = 2
WEIGHTS = (3, 1, 2)
SHARE = 1.5
#: Documents of one source and size that are numbered together.
PART = 8192
STEPS, TOLERANCE = 40, 1e-7
#: Groups of a source that make up, one after the other, for what rounding left.
MENDS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Targets of sources (key, source_size): weighted shares, above CAP times the size reshared by weight."""
    order = Window.orderBy(F.col("key") == "", "key")  # one row for each source
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    weighed = cut(sources.withColumn("weight", w.cast("double")))
    total, level, full = None, 0.0, F.lit(False)
    while True:  # a round for each set of sources that reach their cap
        got = weighed.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("source_size") * CAP)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("free"), F.count(F.when(full, 1)).alias("n")
        ).first()
        if got["n"] == total or not got["free"]:
            break
        total, level = got["n"], (share * (got["all"] or 0) - (got["held"] or 0)) / got["free"]
        full = F.col("weight") * F.lit(level) > F.col("source_size") * CAP
    return weighed.withColumn("target", F.when(full, F.col("source_size") * float(CAP)).otherwise(F.col("weight") * F.lit(level)))


def multipliers(hist: DataFrame, targets: DataFrame) -> DataFrame:
    """The dual's solution: (key, source_size, target, mean, lam, full) of each source."""
    mean = hist.groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    full = F.col("target") >= F.col("source_size") * (CAP * (1 - 1e-9))
    state = targets.join(mean, "key").select("key", "source_size", "target", "mean", full.alias("full"), F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    x = F.col("size") / F.greatest(F.col("mean"), F.lit(1e-9))
    state = cut(state)
    for _ in range(STEPS):
        tilt = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        free = tilt < CAP
        sums = (
            hist.join(state.where(~F.col("full")).select("key", "mean", "lam"), "key")
            .groupBy("key").agg(
                F.sum(F.col("n") * F.col("size") * F.least(tilt, F.lit(float(CAP)))).alias("taken"), F.sum(F.when(free, F.col("n") * F.col("size") * x * tilt).otherwise(0.0)).alias("slope"))
        )
        over = F.col("taken") - F.col("target")
        lo, hi = F.when(over < 0, F.col("lam")).otherwise(F.col("lo")), F.when(over > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - F.greatest(F.least(F.try_divide(over, F.col("slope")), F.lit(4.0)), F.lit(-4.0))
        inside = newton.isNotNull() & (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi")))
        middle = F.coalesce((F.col("lo") + F.col("hi")) / 2, F.col("lo") + F.abs("lo") + 1, F.col("hi") - F.abs("hi") - 1)
        done = F.abs(over) <= F.col("target") * TOLERANCE
        state = cut(
            state.join(sums, "key", "left").withColumns({"lo": lo, "hi": hi}).withColumn("off", F.when(~F.col("full"), F.abs(over) - F.col("target") * TOLERANCE))
            .withColumn("lam", F.when(F.col("full") | F.coalesce(done, F.lit(True)), F.col("lam")).when(inside, newton).otherwise(middle)).drop("taken", "slope", "off_")
        )
        if not state.where("off > 0").limit(1).count():
            break
        state = state.drop("off")
    return state.drop("off", "lo", "hi")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, rate, copies."""
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit(""))
    sized = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), words(F.col(text_col)).alias("size"))
    hist = cut(sized.groupBy("key", "size").agg(F.count("*").alias("n")))
    targets = source_targets(hist.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share)
    dual = multipliers(hist, targets)

    # whole copies by group of one source and size
    x = F.col("size") / F.greatest(F.col("mean"), F.lit(1e-9))
    rate = F.when(F.col("full"), F.lit(float(CAP))).otherwise(F.least(F.exp(F.least(F.col("lam") * x, F.lit(50.0))), F.lit(float(CAP))))
    million = 1_000_000
    units = F.round(F.col("rate") * million).cast("long")
    until = F.sum(F.col("n") * F.col("part")).over(Window.partitionBy("key").orderBy("size"))
    whole = lambda c: F.floor(c / F.lit(million))
    groups = (
        hist.join(dual, "key").withColumn("rate", rate).withColumn("base", F.floor(units / million)).withColumn("part", units - F.col("base") * million)
        .withColumn("until", until).withColumn("extra", (whole(F.col("until")) - whole(F.col("until") - F.col("n") * F.col("part"))))
    )
    taken = F.sum(F.col("size") * (F.col("n") * F.col("base") + F.col("extra"))).over(Window.partitionBy("key"))
    can = F.when(F.col("left") > 0, F.col("n") * (CAP - F.col("base")) - F.col("extra")).otherwise(F.col("n") * F.col("base") + F.col("extra"))
    change = F.when(F.col("size") > 0, F.least(can, F.round(F.abs("left") / F.col("size")))).otherwise(0).cast("long")
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.abs(F.abs("left") - F.col("change") * F.col("size")), "size")) == 1
    for _ in range(MENDS):
        groups = groups.withColumn("left", F.round(F.col("target") - taken)).withColumn("change", change).withColumn("best", best)
        groups = groups.withColumn("extra", F.col("extra") + F.when(F.col("best"), F.signum("left") * F.col("change")).otherwise(0).cast("long"))
    groups = cut(groups.select("key", "size", "n", "source_size", "target", "rate", "base", "extra", F.ceil(F.col("n") / PART).alias("parts")))

    # copies of documents: each has a number in its group
    rows = sized.join(groups, ["key", "size"]).withColumn("p", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.col("parts")).cast("int"))
    parts = rows.where("parts > 1").groupBy("key", "size", "p").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("key", "size").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("key", "size", "p", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.coalesce("before", F.lit(0)) + F.row_number().over(Window.partitionBy("key", "size", "p").orderBy("doc_id"))
    spread = F.floor(F.col("number") * F.col("extra") / F.col("n")) - F.floor((F.col("number") - 1) * F.col("extra") / F.col("n"))
    out = rows.join(parts, ["key", "size", "p"], "left").withColumn("number", number).withColumn("copies", F.col("base") + spread)
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double"), (F.col("copies") * F.col("size")).alias("taken"), "rate", F.col("copies").cast("int"))
