"""Mixing sources to target weights by a curriculum over training time.

Each source has a schedule: how its weight moves over training time t from 0 to 1, with mean 1 times its target share. The
schedule's integral is the source's cumulative demand for tokens; a document that ends at so many of its source's tokens is
due at the time at which that demand is reached. Sorting by that time gives the order of training.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import count_tokens
from tidemark.session import parallelism, scratch

#: Weight at the times given, linear between them; scaled so that the mean is 1.
RISING = [(0.0, 0.6), (0.5, 1.0), (1.0, 1.4)]
FALLING = [(0.0, 1.4), (0.5, 1.0), (1.0, 0.6)]


def segments(schedule: list[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """Linear pieces of a schedule scaled to mean 1: (start, weight there, slope, integral up to there)."""
    knots = sorted(schedule)
    if knots[0][0] != 0 or knots[-1][0] != 1 or any(w < 0 for _, w in knots):
        raise ValueError("a schedule runs from time 0 to 1 with weights of 0 or more")
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    if area <= 0:
        raise ValueError("a schedule needs some weight")
    out, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        if t1 > t0:
            out.append((t0, w0 / area, (w1 - w0) / area / (t1 - t0), total))
            total += (t1 - t0) * (w0 + w1) / 2 / area
    return out


def _segments_column(schedule: list[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w"), F.lit(s).alias("s"), F.lit(a).alias("a")) for t, w, s, a in segments(schedule)])


def due(share_done: Column, pieces: Column) -> Column:
    """The time at which a schedule's integral reaches ``share_done``: the piece is looked up and its quadratic solved."""
    piece = F.coalesce(F.try_element_at(F.filter(pieces, lambda p: p["a"] <= share_done), F.lit(-1)), pieces[0])
    rest = F.greatest(share_done - piece["a"], F.lit(0.0))
    root = F.sqrt(F.greatest(piece["w"] * piece["w"] + 2 * piece["s"] * rest, F.lit(0.0)))
    return F.least(piece["t"] + F.coalesce(F.try_divide(2 * rest, piece["w"] + root), F.lit(0.0)), F.lit(1.0))


def sized(documents: DataFrame, targets: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", path: str | None = None) -> DataFrame:
    """(doc, source, ``n_tokens``) of the documents of the mix's sources, written to the shared folder: the texts are
    encoded once and read by both passes after."""
    spark = documents.sparkSession
    wanted = documents.where(F.col(source).isNotNull()).join(targets.select(source).distinct(), source, "left_semi")
    counts = count_tokens(wanted, [doc, source], text, path)
    at = scratch(spark, "sizes")
    counts.write.parquet(at)
    return spark.read.parquet(at)


def demands(sizes: DataFrame, targets: DataFrame, source: str = "source", total_tokens: int | None = None) -> DataFrame:
    """One row per target source: tokens at hand, ``demand`` and the cap on repeats.

    Without ``total_tokens`` the mix is the largest for which no source that has any tokens, and may be used at all, falls short
    of its share within its cap; a source with a cap of 0 gives nothing and reaches a share of 0. With a larger total a source gives all it may and falls short. Target rows with a null source or
    share are ignored; a cap of null means once.
    """
    held = sizes.groupBy(source).agg(F.sum("n_tokens").alias("held"))
    rows = targets.where(F.col(source).isNotNull() & (F.col("target_share") > 0)).groupBy(source).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    known = rows.join(held, source, "left").select(source, "target_share", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"), F.coalesce("held", F.lit(0)).cast("double").alias("held"))
    able = F.when((F.col("held") > 0) & (F.col("max_repeats") > 0), F.col("held") * F.col("max_repeats") / F.col("target_share"))
    everywhere = Window.partitionBy(F.lit(0))  # one row a source
    total = F.lit(float(total_tokens)) if total_tokens else F.min(able).over(everywhere)
    return known.withColumn("_total", total).withColumn("demand", F.least(F.coalesce(F.col("_total") * F.col("target_share"), F.lit(0.0)), F.col("held") * F.col("max_repeats"))).drop("_total")


def mix(sizes: DataFrame, targets: DataFrame, doc: str = "doc_id", source: str = "source", total_tokens: int | None = None, schedules: dict[str, list[tuple[float, float]]] | None = None, seed: int = 0) -> DataFrame:
    """The mix in training order: (doc, source, ``copy``, ``n_tokens``, ``position`` from 0 to 1).

    A source's documents are laid end to end in the order of a seeded hash, as often as its demand needs: document and
    copy belong to the mix if their middle lies within the demand, so a source is off by half a document at most and no
    document is used more often than the cap. Running totals are made in two steps, over hash ranges and within one, so
    no task holds a source. Documents without tokens add nothing and are left out; ties and repeated rows are told apart
    by the document's id only. ``schedules`` gives a source's schedule; by default sources that may be repeated rise and
    the others fall.
    """
    spark = sizes.sparkSession
    ranges = 16 * parallelism(spark)
    want = demands(sizes, targets, source, total_tokens)
    some = sizes.where(F.col("n_tokens") > 0).withColumn("_hash", F.xxhash64(F.lit(seed), F.col(doc))).withColumn("_range", F.floor((F.col("_hash") / 2.0**64 + 0.5) * ranges).cast("int"))
    sums = some.groupBy(source, "_range").agg(F.sum("n_tokens").alias("_sum"))
    before = Window.partitionBy(source).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum").join(F.broadcast(want), source)  # one row a target source
    within = Window.partitionBy(source, "_range").orderBy("_hash", doc).rowsBetween(Window.unboundedPreceding, -1)
    placed = some.withColumn("_in", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(bases, [source, "_range"])
    middle = F.col("_base") + F.col("_in") + F.col("n_tokens") / 2
    uses = F.least(F.floor((F.col("demand") - middle) / F.col("held")) + 1, F.col("max_repeats").cast("bigint"))
    copies = placed.withColumn("_middle", middle).withColumn("_uses", uses).where(F.col("_uses") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_uses").cast("int"))))
    plan = F.when(F.col("max_repeats") > 1, _segments_column(RISING)).otherwise(_segments_column(FALLING))
    for name, schedule in (schedules or {}).items():
        plan = F.when(F.col(source) == name, _segments_column(schedule)).otherwise(plan)
    done = (F.col("_middle") + (F.col("copy") - 1) * F.col("held")) / F.col("demand")
    timed = copies.withColumn("_plan", plan).withColumn("position", due(done, F.col("_plan")))
    return timed.select(doc, source, "copy", "n_tokens", "position", "_hash").orderBy("position", "_hash", doc, "copy").drop("_hash")


def shares(mixed: DataFrame, targets: DataFrame, doc: str = "doc_id", source: str = "source") -> DataFrame:
    """What each target source contributes: tokens, documents, the most often one is used, target and actual share. A
    source without documents reaches a share of 0."""
    per_doc = mixed.groupBy(source, doc).agg(F.max("copy").alias("_c"), F.sum("n_tokens").alias("_t"))
    got = per_doc.groupBy(source).agg(F.sum("_t").alias("tokens"), F.count("*").alias("documents"), F.max("_c").alias("most_used"))
    every = Window.partitionBy(F.lit(0))  # one row a source
    rows = targets.where(F.col(source).isNotNull()).select(source, "target_share", "max_repeats").join(got, source, "left")
    tokens = F.coalesce("tokens", F.lit(0))
    return rows.select(source, "target_share", "max_repeats", tokens.alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_used", F.lit(0)).alias("most_used"), F.coalesce(F.try_divide(tokens, F.sum(tokens).over(every)), F.lit(0.0)).alias("actual_share"))
