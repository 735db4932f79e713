"""One-hot encoding of vocabularies of any size (P8, P9, P11): the vocabulary is a table, never a literal.

``fit_index`` numbers the categories of all columns in the order of the frozen manifest (numeric columns
first, then each column's categories in code-point order, rare ones collapsed); the numbers come from a
range partition and per-partition counts, so no vocabulary passes through the driver. ``encode`` joins
the index to the rows' (key, column, category) cells and folds each row's positions into a sparse
vector, of at most as many entries as there are columns. A category that a third of all rows share is
met by salts: the cells are dealt over ``SALTS`` keys and the few crowded entries repeated for each.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import sanitize_col, sanitize_name
from ..session import cut_lineage
from .features import OTHER, RARE_COLUMNS, RARE_THRESHOLD
from .joins import join_on
from .scalars import with_scalars

SALTS = 16
CROWDED = 0.01      # share of a column's rows from which on a category's cells are salted


def numbered(df: DataFrame, order: Sequence[str], out: str, start: int = 0) -> DataFrame:
    """Global numbers in the order of ``order``: range partition, a count each, a window within each."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    ranged = cut_lineage(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))                 # a row a partition
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    placed = join_on(ranged.withColumn("_at", at), sizes.select("_part", before.alias("_before")), ["_part"])
    return placed.withColumn(out, F.col("_before") + F.col("_at") - 1 + F.lit(start)).drop("_part", "_at", "_before")


def _cells(df: DataFrame, key: str, categorical: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(k).alias("ord"), F.col(f"`{c}`").cast("string").alias("category")) for k, c in enumerate(categorical)])
    return df.select(F.col(f"`{key}`").alias("row_key"), F.inline(cells)).where(F.col("category").isNotNull())


def fit_index(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], rare_columns: Iterable[str] = RARE_COLUMNS,
              threshold: float = RARE_THRESHOLD) -> DataFrame:
    """(ord, category, n, mapped, position, feature, crowded): one row a seen category, kept in a checkpoint.

    Rare categories share the position of ``other``. Duplicate feature names after sanitising are refused (P11).
    """
    categorical, rare = list(categorical), set(rare_columns)
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    counts = _cells(df.withColumn("_none", F.lit(0)), "_none", categorical).groupBy("ord", "category").agg(F.count(F.lit(1)).alias("n"))
    counts = with_scalars(counts, rows)
    is_rare = F.col("ord").isin([k for k, c in enumerate(categorical) if c in rare] or [-1]) & (F.col("n") < F.lit(float(threshold)) * F.col("rows"))
    mapped = counts.select("ord", "category", "n", F.when(is_rare, F.lit(OTHER)).otherwise(F.col("category")).alias("mapped"),
                           (F.col("n") >= F.lit(CROWDED) * F.col("rows")).alias("crowded"))
    mapped = cut_lineage(mapped)
    places = numbered(mapped.select("ord", "mapped").distinct(), ["ord", "mapped"], "position", len(numeric))
    named = F.element_at(F.array(*[F.lit(c) for c in categorical]), F.col("ord") + 1) if categorical else F.lit("")
    places = places.withColumn("feature", sanitize_col(F.concat_ws("_", named, "mapped")))
    index = cut_lineage(mapped.join(places, ["ord", "mapped"]))
    names = index.select("position", "feature").distinct().select("feature").union(
        df.sparkSession.createDataFrame([(sanitize_name(c),) for c in numeric], "feature string"))
    twice = [r[0] for r in names.groupBy("feature").count().where("count > 1").select("feature").limit(5).collect()]
    if twice:
        raise ValueError(f"several columns or categories would be named alike, for example {twice}")
    return index


def size_of(index: DataFrame, numeric: Sequence[str]) -> int:
    """Length of the encoded vectors."""
    last = index.agg(F.max("position")).first()[0]
    return len(numeric) if last is None else int(last) + 1


def encode(df: DataFrame, index: DataFrame, key: str, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """(key, indices, values) of every row, indices ascending: numeric columns (null or unreadable: 0), then one 1.0 for
    each column whose category the index holds. Null and unseen categories give no entry. ``key`` is unique."""
    salt = F.pmod(F.xxhash64("row_key"), F.lit(SALTS)).cast("int")
    spread = index.select("ord", "category", "position", F.explode(F.when(F.col("crowded"), F.sequence(F.lit(0), F.lit(SALTS - 1)))
                                                                   .otherwise(F.array(F.lit(-1)))).alias("salt"))
    # whether a cell's category is crowded is known where it is looked up: each cell asks under both keys
    asked = _cells(df, key, categorical).withColumn("salt", F.explode(F.array(F.lit(-1), salt)))
    found = asked.join(spread, ["ord", "category", "salt"]).groupBy("row_key").agg(F.array_sort(F.collect_list("position")).alias("found"))
    numbers = F.array(*[F.coalesce(F.col(f"`{c}`").try_cast("float"), F.lit(0.0).cast("float")).cast("double") for c in numeric])
    base = df.select(F.col(f"`{key}`").alias("row_key"), (numbers if numeric else F.array().cast("array<double>")).alias("numbers"))
    at = F.sequence(F.lit(0).cast("long"), F.lit(len(numeric) - 1).cast("long")) if numeric else F.array().cast("array<bigint>")
    held = F.coalesce("found", F.array().cast("array<bigint>"))
    return base.join(found, "row_key", "left").select(
        F.col("row_key").alias(key), F.concat(at, held).alias("indices"),
        F.concat(F.col("numbers"), F.transform(held, lambda _: F.lit(1.0))).alias("values"))


def as_vector(indices: Column, values: Column, size: int) -> Column:
    """The sparse vector for Spark ML (a Python step a row; everything before it is native)."""
    return F.udf(lambda i, v: Vectors.sparse(size, i, v), VectorUDT())(indices, values)
