"""Carry-forward state over ordered lines, safe when one file holds most rows.

A plain window per file would put a whole file into one task. Here a file is
cut into chunks of lines: each chunk carries its own state, the last state of
every chunk is reduced to one row, and only these rows are scanned per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_LINES = 100_000
#: Metadata of a line number: the most that a file of this source has. A hint for the plan only, results never depend on it.
MOST = "most"


def short_files(df: DataFrame, order: str = "line_no", rows: int = CHUNK_LINES) -> bool:
    """Whether the source says that every file fits one chunk of lines."""
    return order in df.columns and df.schema[order].metadata.get(MOST, rows + 1) <= rows


def carry_forward(
    df: DataFrame, marks: dict[str, Column], key: str = "file_id", order: str = "line_no",
    chunk: int | Column = CHUNK_LINES, inclusive: bool = True, uses: Column | None = None,
) -> DataFrame:
    """Add one column per mark: its last non-null value up to each row.

    `chunk` is a number of lines, or a column that never falls along `order`.
    With inclusive=False the row itself is not counted. With `uses`, only rows
    that set a mark or meet it are dealt out and returned.

    Where the source says that its files are short (`short_files`), one window for each file does it all: no edges of chunks,
    no join, and no shuffle where the rows lie by file already. It is right for files of any length.
    """
    if isinstance(chunk, int) and short_files(df, order, chunk):
        return _carry_within(df, marks, key, order, inclusive, uses)
    part = F.floor(F.col(order) / chunk) if isinstance(chunk, int) else chunk
    marked = df.withColumn("_chunk", part).withColumns({f"_m_{n}": c for n, c in marks.items()})
    if uses is not None:
        setting = F.lit(False)
        for n in marks:
            setting = setting | F.col(f"_m_{n}").isNotNull()
        marked = marked.filter(F.coalesce(uses, F.lit(False)) | setting)
    inside = (
        Window.partitionBy(key, "_chunk").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    local = marked.withColumns({f"_l_{n}": F.last(f"_m_{n}", ignorenulls=True).over(inside) for n in marks})
    # a chunk's last row holds its last marks: tails come from the rows dealt out already, so the input is read once
    last = F.struct(*[(F.last(f"_m_{n}", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)) if not inclusive else F.col(f"_l_{n}")).alias(f"_t_{n}") for n in marks])
    tails = local.select(key, "_chunk", F.col(order).alias("_at"), last.alias("_last")).groupBy(key, "_chunk").agg(F.max_by("_last", "_at").alias("_last")).select(key, "_chunk", "_last.*")
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(key, "_chunk", *[
        F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_b_{n}") for n in marks
    ])
    out = local.join(carried, [key, "_chunk"], "left")
    return out.select(*df.columns, *[F.coalesce(f"_l_{n}", f"_b_{n}").alias(n) for n in marks])


def _carry_within(df: DataFrame, marks: dict[str, Column], key: str, order: str, inclusive: bool, uses: Column | None) -> DataFrame:
    """`carry_forward` with one window for each key."""
    marked = df.withColumns({f"_m_{n}": c for n, c in marks.items()})
    if uses is not None:
        setting = F.lit(False)
        for n in marks:
            setting = setting | F.col(f"_m_{n}").isNotNull()
        marked = marked.filter(F.coalesce(uses, F.lit(False)) | setting)
    inside = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return marked.select(*df.columns, *[F.last(f"_m_{n}", ignorenulls=True).over(inside).alias(n) for n in marks])


def running_count(
    df: DataFrame, flags: dict[str, Column], key: str = "file_id", order: str = "line_no",
    chunk: int | Column = CHUNK_LINES,
) -> DataFrame:
    """Add the number of true flags up to each row, by the same two levels."""
    part = F.floor(F.col(order) / chunk) if isinstance(chunk, int) else chunk
    marked = df.withColumn("_chunk", part).withColumns({f"_m_{n}": c.cast("long") for n, c in flags.items()})
    inside = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumns({f"_l_{n}": F.sum(f"_m_{n}").over(inside) for n in flags})
    tails = marked.groupBy(key, "_chunk").agg(*[F.sum(f"_m_{n}").alias(f"_t_{n}") for n in flags])
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(key, "_chunk", *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in flags
    ])
    out = local.join(carried, [key, "_chunk"], "left")
    return out.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_b_{n}")).alias(n) for n in flags])


def with_row_chunks(df: DataFrame, name: str, key: str, time: str, rows: int = CHUNK_LINES) -> DataFrame:
    """Add the number of a chunk of about `rows` rows of its key in order of time, for `carry_forward` and `running_count`.

    Rows are counted per second first, seconds are summed within their day, and days before it; so a key with most of all rows
    becomes as many tasks as it has chunks, however its rows lie in time. Rows of one second share a chunk.
    """
    second = F.date_trunc("second", F.col(time))
    counts = df.groupBy(key, second.alias("_second")).agg(F.count("*").alias("_n")).withColumn("_date", F.to_date("_second"))
    days = counts.groupBy(key, "_date").agg(F.sum("_n").alias("_d"))
    before = Window.partitionBy(key).orderBy("_date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(key, "_date", F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_days"))
    earlier = Window.partitionBy(key, "_date").orderBy("_second").rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    chunks = within.join(days, [key, "_date"]).select(key, "_second", F.floor((F.col("_days") + F.col("_before")) / rows).alias(name))
    return df.withColumn("_second", second).join(chunks, [key, "_second"], "left").select(*df.columns, F.coalesce(name, F.lit(0)).alias(name))


def last_wins(value: Column, order: str = "line_no") -> Column:
    """Aggregate: the value of the last line that has one."""
    return F.max_by(value, F.when(value.isNotNull(), F.col(order)))


def first_wins(value: Column, order: str = "line_no") -> Column:
    """Aggregate: the value of the first line that has one."""
    return F.min_by(value, F.when(value.isNotNull(), F.col(order)))
