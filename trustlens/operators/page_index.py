"""Deep pages: a table sorted into cells, and an index that tells how many rows come before each cell.

Cells are ranges of the sort key and the name, cut by sampling, so a very frequent key value fills several cells. Each is one folder of the stored table. The index
has one row per cell with the rank of its first row. A page reads the cells that its ranks fall into, usually one or two, whatever its number.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trustlens.operators.catalogue import SORT_COLUMNS

CELL_ROWS = 100_000
CELL = "page_cell"


def _order(sort_by: str, descending: bool) -> list:
    return [F.col(sort_by).desc_nulls_last() if descending else F.col(sort_by).asc_nulls_first(), F.col("username")]


def build_page_index(rows: DataFrame, home: str, sort_by: str = "score", descending: bool = True, cell_rows: int = CELL_ROWS) -> None:
    """Write the rows as cells below ``home``/cells and the index below ``home``/index."""
    spark, sort_by = rows.sparkSession, sort_by if sort_by in SORT_COLUMNS else "score"
    cells = max(1, -(-rows.count() // cell_rows))
    dealt = rows.repartitionByRange(cells, *_order(sort_by, descending)).withColumn(CELL, F.spark_partition_id())
    dealt.write.partitionBy(CELL).parquet(f"{home}/cells")
    counts = spark.read.schema(dealt.schema).parquet(f"{home}/cells").groupBy(CELL).agg(F.count(F.lit(1)).alias("rows"))
    line = W.orderBy(CELL).rowsBetween(W.unboundedPreceding, -1)  # one row per cell
    index = counts.select(CELL, "rows", F.coalesce(F.sum("rows").over(line), F.lit(0)).alias("start"))
    index.coalesce(1).write.parquet(f"{home}/index")
    spark.createDataFrame([(sort_by, descending, dealt.schema.json())], "sort_by string, descending boolean, columns string").coalesce(1).write.json(f"{home}/about")


def indexed_page(spark: SparkSession, home: str, page: int = 1, page_size: int = 30) -> DataFrame:
    """The page with ``total`` and ``has_more``; only the cells it lies in are read."""
    index, first = spark.read.parquet(f"{home}/index"), (page - 1) * page_size
    about = spark.read.schema("sort_by string, descending boolean, columns string").json(f"{home}/about").first()
    total = index.agg(F.sum("rows")).first()[0] or 0
    hit = index.where((F.col("start") < first + page_size) & (F.col("start") + F.col("rows") > first)).select(CELL, "start").collect()  # page_size rows at most
    rows = spark.read.schema(StructType.fromJson(json.loads(about["columns"]))).parquet(f"{home}/cells").where(F.col(CELL).isin([r[CELL] for r in hit])).drop(CELL)
    skipped = first - min((r["start"] for r in hit), default=first)
    page_rows = rows.orderBy(*_order(about["sort_by"], about["descending"])).offset(skipped).limit(page_size)
    return page_rows.withColumns({"total": F.lit(total).cast("bigint"), "has_more": F.lit(total > page * page_size)})
