"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 4).

Every document draws an exponential key ``-ln(u) / q`` (``u`` from a hash of
its id, ``q`` its quality weight); small keys come first, which is weighted
sampling without replacement.  A source takes complete epochs of all its
documents first; the rest of its target is filled in key order up to the
prefix sum of sizes that meets it, the last document in part.

No source is ever sorted as a whole: keys are cut into ``KEY_BUCKETS`` ranges,
sizes are summed per (source, range) with partial aggregation, and only the
one range per source in which the target is met is put in order.

Defined results: a null text has size 0; null sources form one source, the
last one; a null or non-positive quality counts as 1; a source without words
gets target 0; an empty table gives no rows; repeated rows are separate
documents with equal keys.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.llm.common import WORD, keeps_columns, text_of, written

KEY_BUCKETS = 4096


def uniform(id_column: str, seed: int) -> Column:
    """In (0, 1): 52 bits of md5 over seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sized: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``.

    The weighted shares of the total are cut at ``max_epochs`` times a
    source's size and the excess is shared anew by weight: the fixpoint is
    ``min(level * weight, cap)`` with one level for all, found from prefix
    sums over the sources in order of ``cap / weight``.  The windows run over
    one row per source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
    )
    capped = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    full_at = F.col("cap") / F.col("weight")
    by_level = Window.orderBy(full_at, F.col("source").asc_nulls_last())
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    levels = capped.select(
        "*",
        F.row_number().over(by_level).alias("place"),
        (
            (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
            / F.sum("weight").over(rest)
        ).alias("level"),
        full_at.alias("full_at"),
    )
    found = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("place", "level"))).over(every)["level"]
    return levels.select(
        "source", "source_size", F.least(F.col("cap").cast("double"), found * F.col("weight")).alias("target")
    )


def mix_sources(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: tuple[float, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: int = 0,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``size``, ``source_size``,
    ``target``, ``taken``, ``source``.  ``quality`` has one ``weight`` per
    ``doc_id``; documents without one count as 1."""
    sized = docs.select(
        F.col("doc_id"), F.col("source"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64("text").alias("text_hash"),
    )
    if quality is not None:
        sized = sized.join(quality.select("doc_id", F.col("weight").alias("q")), "doc_id", "left")
    else:
        sized = sized.withColumn("q", F.lit(1.0))
    q = F.when(F.col("q") > 0, F.col("q")).otherwise(F.lit(1.0))
    sized = sized.withColumn("key", -F.log(uniform("doc_id", seed)) / q).drop("q")
    sized = written(
        sized.withColumn("range", F.floor(F.lit(KEY_BUCKETS) * (F.lit(1.0) - F.exp(-F.col("key")))).cast("int")),
        "mix-sized",
    )

    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(sized, weights, max_epochs)
    budget = targets.select(
        "*",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(F.lit(0))
        .cast("long")
        .alias("epochs"),
    ).withColumn("left", F.floor("target") - F.col("epochs") * F.col("source_size"))
    in_order = Window.partitionBy("source").orderBy("range")
    cut = (
        ranges.withColumn("base", F.sum("range_size").over(in_order) - F.col("range_size"))
        .withColumnRenamed("source", "s")
        .join(budget, F.col("s").eqNullSafe(F.col("source")))
        .where((F.col("base") <= F.col("left")) & (F.col("left") < F.col("base") + F.col("range_size")))
        .select("s", F.col("range").alias("cut"), "base")
    )
    plan = written(
        budget.join(cut, F.col("s").eqNullSafe(F.col("source")), "left").select(
            F.col("source").alias("s"), "source_size", "target", "epochs", "left", "cut", "base"
        ),
        "mix-plan",
    )
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("s")))
    # no cut range: the target ends with a complete epoch
    settled = joined.where(F.col("cut").isNull() | (F.col("range") != F.col("cut"))).withColumn(
        "part", F.when(F.col("range") < F.col("cut"), F.col("size")).otherwise(F.lit(0).cast("long"))
    )
    by_key = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_cut = joined.where(F.col("range") == F.col("cut"))
    gap = F.col("left") - F.col("base") - F.coalesce(F.sum("size").over(by_key), F.lit(0))
    at_cut = at_cut.withColumn("part", F.greatest(F.lit(0), F.least(gap, F.col("size"))))
    return settled.unionByName(at_cut).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"),
        "source",
        "text_hash",
    )


def label_quality(labels: DataFrame, good: float = 2.0, bad: float = 0.5) -> DataFrame:
    """Quality weight per labelled document: ``good`` for label 1, ``bad`` for 0."""
    return (
        labels.where(F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.when(F.avg("quality") >= 0.5, F.lit(good)).otherwise(F.lit(bad)).alias("weight"))
    )


@keeps_columns
def mixed_documents(
    docs: DataFrame, quality: DataFrame | None = None, whole: bool = False, **options
) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document taken ``n``
    times its size appears ``n`` times.  With ``whole`` every row is an
    unchanged row of ``docs``: the one document per source that the target
    falls into stays or goes as a whole, whichever ends nearer the target.
    Without, it appears once more with its first words up to the target
    (``n_chars`` follows the text)."""
    taken = mix_sources(docs, quality, **options)
    if whole:
        nearest = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))) * F.col("size")
        taken = taken.where("size > 0").withColumn("taken", nearest)
    decided = (
        taken.where("taken > 0")
        .groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
        .agg(F.sum("taken").alias("__taken"), F.max("size").alias("__size"), F.count(F.lit(1)).alias("__rows"))
    )
    decided = written(decided, "mix-decided")
    keyed = docs.withColumn("__hash", F.xxhash64("text"))
    if not decided.where("__rows > 1").isEmpty():  # repeated rows: one stands for all
        keyed = keyed.dropDuplicates(["doc_id", "__hash"])
    same = keyed["doc_id"].eqNullSafe(F.col("__id")) & (keyed["__hash"] == decided["__hash"])
    full = F.floor(F.col("__taken") / F.col("__size")).cast("int")
    copies = F.ceil(F.col("__taken") / F.col("__size")).cast("int")
    rows = keyed.join(decided.withColumns({"__full": full, "__copies": copies}), same)
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    if whole:
        return rows.select(*docs.columns)
    in_part = F.col("__copy") > F.col("__full")
    left = (F.col("__taken") - F.col("__full") * F.col("__size")).cast("int")
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), left), " ")
    rows = rows.withColumn("text", F.when(in_part, head).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(in_part, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
