"""Article labelling and feature extraction.

The warehouse rule: keep buyable articles of one country, map each category
code to a list of product groups with LIKE patterns, unnest, collect the
distinct groups per article and join them to the article's image features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values (must equal the reference rule): product group labels in output
# order with the LIKE patterns that select them.  Matching is case sensitive,
# "%men%" also matches "women", and one code may yield two labels.
GROUP_RULES: list[tuple[str, list[str]]] = [
    ("men", ["%men%"]),
    ("ladies", ["%ladies%"]),
    ("boy_50_98", ["%boy50-98%", "%newborn50-98%"]),
    ("boy_92_140", ["%boy92-140%", "%boy92-170%"]),
    ("boy_134_170", ["%boy92-170%", "%boy134-170%"]),
    ("girl_50_98", ["%girl50-98%", "%newborn50-98%"]),
    ("girl_92_140", ["%girl92-140%", "%girl92-170%"]),
    ("girl_134_170", ["%girl92-170%", "%girl134-170%"]),
]

GROUPS = [label for label, _ in GROUP_RULES]


def rules_column(rules: list[tuple[str, list[str]]] = GROUP_RULES) -> Column:
    """The rules as one array of ``(label, patterns)``, to bind to a SQL text."""
    return F.array(*[
        F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, patterns)).alias("patterns"))
        for label, patterns in rules
    ])


def filter_buyable(
    articles: DataFrame, country: str = "GB", status: int = 1
) -> DataFrame:
    """Conjunctive filter; NULL in either column drops the row.

    Written as plain column comparisons so Catalyst pushes both predicates
    into the parquet scan.
    """
    return articles.filter((F.col("country_code") == country) & (F.col("buyable_status") == status))


def group_array(code: Column, rules: list[tuple[str, list[str]]] = GROUP_RULES) -> Column:
    """Array of every label whose patterns match ``code`` (rule order).

    ``when(NULL LIKE ...)`` takes the ``otherwise`` branch, so a NULL code gives
    an empty array.  Pure Catalyst; stays inside whole-stage codegen.
    """
    empty = F.array().cast("array<string>")
    parts = []
    for label, patterns in rules:
        cond = code.like(patterns[0])
        for p in patterns[1:]:
            cond = cond | code.like(p)
        parts.append(F.when(cond, F.array(F.lit(label))).otherwise(empty))
    return F.concat(*parts)


def label_groups(articles: DataFrame, code_col: str = "category_code") -> DataFrame:
    """P1 + P2: buyable articles with their candidate group list."""
    return filter_buyable(articles).select(
        "castor", group_array(F.col(code_col)).alias("potential_groups")
    )


def aggregate_groups(labelled: DataFrame) -> DataFrame:
    """A1: unnest (inner: empty lists vanish) and collect distinct groups per key.

    ``collect_set`` runs as partial + final hash aggregate; its buffer is
    bounded by the number of labels, so a hot castor cannot blow up a task.
    The set is sorted so the result is deterministic.
    """
    return (
        labelled.select("castor", F.explode("potential_groups").alias("group_name"))
        .groupBy("castor")
        .agg(F.array_sort(F.collect_set("group_name")).alias("groups"))
    )


#: Parts that the features of one castor are dealt into for the join.
JOIN_SALTS = 8


def extract_vectors(articles: DataFrame, features: DataFrame) -> DataFrame:
    """Features joined to the labelled articles on ``castor`` (inner).

    Articles without labels, NULL keys and unmatched features vanish;
    duplicate feature rows fan out.  Only articles that have features are
    labelled: a semi join on the distinct castors comes first, so what follows
    grows with the matches, whatever the number of articles.  The group side
    has one narrow row per castor, so a hot castor is hot on the feature side
    only.  Its rows are dealt over ``JOIN_SALTS`` and each group row is repeated
    once per salt; as both sides are then exchanged for the join alone (the
    groups would otherwise come straight from their aggregate), adaptive
    execution may cut a partition that is still skewed further.  When the group
    side proves small the join becomes a broadcast join.
    """
    featured = features.select("castor").distinct()
    groups = aggregate_groups(label_groups(articles.join(featured, "castor", "left_semi")))
    groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))))
    dealt = features.select("castor", "features", F.pmod(F.xxhash64("features"), F.lit(JOIN_SALTS)).cast("int").alias("_salt"))
    return dealt.join(groups, on=["castor", "_salt"], how="inner").drop("_salt")
