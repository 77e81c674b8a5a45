"""Standard names: look-up against a cache table, and what the cache lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow import schemas
from folioflow.functions.text import cache_key
from folioflow.prompts import EXAMPLES

#: Characters of a gram, and edits that a name may be away, as a share of its length.
GRAM, SHARE = 3, 0.2
#: Accented letters of Portuguese and the letters that they are read as.
ACCENTED, BARE = "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn"


def guide(spark: SparkSession) -> DataFrame:
    """The worked examples as a cache."""
    return spark.createDataFrame([(name.lower(), kind, standard) for name, kind, standard in EXAMPLES], schemas.NAME_CACHE)


def spelled(name: Column) -> Column:
    """A name for comparison: lower case without accents, runs of what is no letter or digit as one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(name), ACCENTED, BARE), r"[^\p{L}\p{N}]+", " "))


def nearest(names: DataFrame, known: DataFrame, share: float = SHARE, name_col: str = "exam_name_raw") -> DataFrame:
    """(name, cache_key, distance, exam_type, standardized_name): for distinct names the known one with the fewest edits, if ``share`` of the longer one allows them.

    Of known names equally near, the first by key. A name is compared as ``spelled``; an empty one has no neighbour. Two names
    within k edits share at least one of the 3k + 1 rarest grams of either, so that only names that meet in a rare gram are
    compared: a gram that all names have joins nothing. Gram counts and names stay distributed.
    """
    wanted = names.select(F.col(name_col).alias("name")).where(F.col("name").isNotNull()).distinct().withColumn("text", spelled(F.col("name"))).where("text <> ''")
    have = known.select("cache_key", "exam_type", "standardized_name", spelled(F.col("cache_key")).alias("text")).where("text <> ''")
    texts = wanted.select("text").distinct().withColumn("side", F.lit(0)).unionByName(have.select("text").distinct().withColumn("side", F.lit(1)))
    padded = F.concat(F.lit("\x02" * (GRAM - 1)), F.col("text"), F.lit("\x03" * (GRAM - 1)))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - GRAM + 1), lambda k: F.substring(padded, k, GRAM))
    each = texts.select("text", "side", F.explode(grams).alias("gram"))
    # A gram that a name has several times counts as so many grams.
    each = each.withColumn("time", F.row_number().over(Window.partitionBy("side", "text", "gram").orderBy("gram")))
    rare = each.groupBy("gram", "time").agg(F.count(F.lit(1)).alias("n"))
    # The other name may be longer than this one, by what it allows itself.
    edits = F.floor(F.length("text") * share / (1 - share))
    order = F.row_number().over(Window.partitionBy("side", "text").orderBy("n", "gram", "time"))
    prefix = each.join(rare, ["gram", "time"]).withColumn("place", order).where(F.col("place") <= GRAM * edits + 1)
    left, right = (prefix.where(F.col("side") == k).select("gram", "time", F.col("text").alias(c)) for k, c in enumerate(("a", "b")))
    pairs = left.join(right, ["gram", "time"]).select("a", "b").distinct()
    most = F.floor(F.greatest(F.length("a"), F.length("b")) * share).cast("int")
    near = pairs.where(F.abs(F.length("a") - F.length("b")) <= most).withColumn("distance", F.levenshtein("a", "b")).where((F.col("distance") >= 0) & (F.col("distance") <= most))
    found = near.join(have, near["b"] == have["text"]).groupBy("a").agg(F.min(F.struct("distance", "cache_key", "exam_type", "standardized_name")).alias("best"))
    return wanted.join(found, wanted["text"] == found["a"]).select(F.col("name").alias(name_col), "best.cache_key", "best.distance", "best.exam_type", "best.standardized_name")


def uncached(names: DataFrame, cache: DataFrame, name_col: str = "exam_name_raw") -> DataFrame:
    """Distinct names whose key the cache lacks."""
    wanted = names.select(name_col).where(F.col(name_col).isNotNull()).distinct().withColumn("cache_key", cache_key(F.col(name_col)))
    return wanted.join(cache, "cache_key", "left_anti").select(name_col)


def cached(names: DataFrame, cache: DataFrame, name_col: str = "exam_name_raw") -> DataFrame:
    """Distinct names whose key the cache has."""
    wanted = names.select(name_col).where(F.col(name_col).isNotNull()).distinct().withColumn("cache_key", cache_key(F.col(name_col)))
    return wanted.join(cache, "cache_key", "left_semi").select(name_col)


def look_up(names: DataFrame, cache: DataFrame, name_col: str = "exam_name_raw") -> DataFrame:
    """Distinct names with exam_type and standardized_name; a name that is not cached stands for itself, as ``other``."""
    wanted = names.select(name_col).where(F.col(name_col).isNotNull()).distinct().withColumn("cache_key", cache_key(F.col(name_col)))
    found = wanted.join(cache, "cache_key", "left")
    return found.select(name_col, F.coalesce("exam_type", F.lit("other")).alias("exam_type"), F.coalesce("standardized_name", name_col).alias("standardized_name"))


def attach(pages: DataFrame, mapping: DataFrame) -> DataFrame:
    """Pages with exam_type and exam_name_standardized of their raw name; null where the mapping lacks it."""
    renamed = mapping.select("exam_name_raw", "exam_type", F.col("standardized_name").alias("exam_name_standardized"))
    return pages.drop("exam_type", "exam_name_standardized").join(renamed, "exam_name_raw", "left")


def merge(cache: DataFrame, answers: DataFrame, name_col: str = "exam_name_raw") -> DataFrame:
    """The cache with new answers (name, exam_type, standardized_name). Names that share a key: the last in name order wins.

    Names without an answer are not in ``answers`` and stay uncached, so that a later run asks again.
    """
    fresh = answers.groupBy(cache_key(F.col(name_col)).alias("cache_key")).agg(
        F.max_by(F.struct(F.coalesce("exam_type", F.lit("other")).alias("exam_type"), F.coalesce("standardized_name", name_col).alias("standardized_name")), name_col).alias("v")
    )
    fresh = fresh.select("cache_key", "v.exam_type", "v.standardized_name")
    return cache.join(fresh, "cache_key", "left_anti").unionByName(fresh)
