"""Prompt building: page costs, token-bounded chunks, ordered renders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.text import display_name, exam_list_row, is_blank, token_estimate, transcription_row

#: Tokens kept for the running summary, and for what surrounds the pages in a prompt.
RUNNING_SUMMARY = 2000
PROMPT_FRAME = 200


def chunk_budget(max_input_tokens: int, system_prompt: str) -> int:
    return max_input_tokens - (len(system_prompt) // 4 + PROMPT_FRAME) - RUNNING_SUMMARY


def page_cost() -> Column:
    """Estimated tokens of a page's two rows, as the first of a prompt."""
    name = display_name(F.col("exam_name_standardized"), F.col("exam_name_raw"))
    kind, date = F.coalesce(F.col("exam_type"), F.lit("None")), F.col("exam_date")
    one = F.lit(1)
    return token_estimate(F.concat(exam_list_row(one, name, kind, date), transcription_row(one, name, F.col("page_number"), F.col("transcription"))))


def with_content(pages: DataFrame) -> DataFrame:
    return pages.where(~is_blank(F.col("transcription")))


def assign_chunks(pages: DataFrame, budget: int, cost: Column | None = None, keys: str = "doc_stem", order: str = "page_number") -> DataFrame:
    """keys, order, cost, chunk_idx from 0: a page joins the open chunk while the budget lasts.

    A page over the budget is a chunk of its own if no chunk is open, else it opens one, and the next page closes it. Pages
    stream through a task in order, and the fold holds the open chunk's number and cost alone, however long a document is; texts
    stay where they are. A page without a cost costs nothing.
    """
    cost = F.coalesce((page_cost() if cost is None else cost).cast("long"), F.lit(0).cast("long"))
    rows = pages.select(keys, F.col(order).cast("long").alias(order), cost.alias("cost")).repartition(keys).sortWithinPartitions(keys, order, "cost")
    schema = T.StructType([*rows.schema.fields, T.StructField("chunk_idx", T.IntegerType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chunk, used, filling = object(), 0, 0, False  # no key equals the first one
        for b in batches:
            found = []
            for key, cost in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if key != at:
                    at, chunk, used, filling = key, 0, 0, False
                if not filling and cost > budget:
                    found.append(chunk)
                    chunk += 1
                    continue
                if filling and used + cost > budget:
                    chunk, used = chunk + 1, 0
                used, filling = used + cost, True
                found.append(chunk)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int32())], names=schema.names)

    return rows.mapInArrow(fold, schema)


def render(pages: DataFrame, keys: list[str], row: Column, separator: str, name: str) -> DataFrame:
    """keys and the rows of a group in page order, joined; ``row`` may use ``i``, the place in the group."""
    from folioflow.operators.voting import numbered

    rows = numbered(pages, keys, ["page_number"]).select(*keys, "i", row.alias("row"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "row"))).alias("rows")).select(*keys, F.array_join(F.transform("rows", lambda r: r["row"]), separator).alias(name))


def exam_lists(pages: DataFrame, keys: list[str]) -> DataFrame:
    name = display_name(F.col("exam_name_standardized"), F.col("exam_name_raw"))
    return render(pages, keys, exam_list_row(F.col("i"), name, F.coalesce(F.col("exam_type"), F.lit("None")), F.col("exam_date")), "\n", "exam_list")


def transcriptions(pages: DataFrame, keys: list[str]) -> DataFrame:
    name = display_name(F.col("exam_name_standardized"), F.col("exam_name_raw"))
    return render(pages, keys, transcription_row(F.col("i"), name, F.col("page_number"), F.col("transcription")), "\n\n", "transcriptions")


def names_json(names: DataFrame, size: int = 50, name_col: str = "exam_name_raw") -> DataFrame:
    """(batch, names): the distinct names in order, ``size`` at a time, as JSON arrays; the last may be shorter.

    Names are sorted by range over all tasks. A name's number is its place among those of its task behind the names of the tasks
    before, of which only the counts, a number a task, reach the driver. Nulls are no names.
    """
    ordered = names.select(F.col(name_col).alias("name")).where(F.col("name").isNotNull()).distinct().repartitionByRange("name").sortWithinPartitions("name")
    # Kept, since the bounds of ranges are drawn anew with each plan: counts and places are of the same ranges.
    ordered = ordered.withColumn("task", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).persist()
    before, starts = 0, []
    for r in sorted(ordered.groupBy("task").count().collect()):
        starts.append((r["task"], before))
        before += r["count"]
    numbered = ordered.join(names.sparkSession.createDataFrame(starts, "task int, before long"), "task").withColumn("n", F.col("before") + F.col("place"))
    return numbered.groupBy(F.floor(F.col("n") / size).alias("batch")).agg(F.to_json(F.array_sort(F.collect_list("name"))).alias("names"))
