"""Aggregations: repository statistics, baseline costs, session metrics, counters."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import scalars as S


#: Leading bits that tell apart the bins of the first histogram, and bins of a range that is refined.
LEADING, BINS = 11, 4096


def histogram(df: DataFrame, column: str) -> list[tuple]:
    """(low, high, least, most, count, sum) of bins of a whole-number column by its leading bits, in order; nulls are one bin at the end, without bounds.

    There are at most 55,296 bins, whatever the number of rows, and a bin of numbers below 2,048 holds one number.
    """
    v = F.col(column).cast("long")
    shift = F.greatest(F.lit(0), F.length(F.bin(v)) - LEADING)
    bins = df.select(v.alias("v"), shift.alias("s")).withColumn("top", F.call_function("shiftright", F.col("v"), F.col("s")))
    rows = bins.groupBy("s", "top").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("n"), F.sum("v").alias("sum")).collect()
    found = [(r.top << r.s, (r.top + 1 << r.s) - 1, r.least, r.most, r.n, r["sum"]) if r.top is not None else (None, None, None, None, r.n, 0) for r in rows]
    return sorted(found, key=lambda r: (r[0] is None, r[0]))


def ranked(df: DataFrame, column: str, first: list[tuple], ranks: set[int]) -> dict[int, int]:
    """The numbers at ``ranks`` (from 0) of a column, whose ``histogram`` is ``first``: bins that hold a rank are refined until each is one number."""
    v, found = F.col(column).cast("long"), {}
    open_: list[tuple] = [(r, 0, first) for r in ranks]  # rank, rows before the bins, bins (low, high, least, most, count, ...)
    while True:
        spans: dict[tuple, list] = {}
        for rank, before, bins in open_:
            for low, high, least, most, n, *_ in bins:
                if rank < before + n:
                    if least == most:
                        found[rank] = least
                    else:
                        spans.setdefault((least, most), []).append((rank, before))
                    break
                before += n
        if not spans:
            return found
        order = sorted(spans)
        widths = [-(-(b - a + 1) // BINS) for a, b in order]
        which = reduce(lambda c, i: c.when(v.between(*order[i]), i), range(1, len(order)), F.when(v.between(*order[0]), 0))
        at = F.array(*[F.lit(a) for a, _ in order])[F.col("i")], F.array(*[F.lit(w) for w in widths])[F.col("i")]
        bins = df.select(v.alias("v"), which.alias("i")).where("i IS NOT NULL").withColumn("b", F.floor((F.col("v") - at[0]) / at[1]))
        rows = bins.groupBy("i", "b").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("n")).collect()  # at most BINS for each rank
        inner: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: r.least):
            inner.setdefault(r.i, []).append((None, None, r.least, r.most, r.n))
        open_ = [(rank, before, inner[i]) for i, span in enumerate(order) for rank, before in spans[span]]


def interpolated(df: DataFrame, column: str, first: list[tuple], at: list[float]) -> list[float | None]:
    """Exact percentiles of a whole-number column, as ``percentile`` interpolates them, in memory that does not grow with the rows."""
    n = sum(r[4] for r in first if r[0] is not None)
    if not n:
        return [None] * len(at)
    places = [(n - 1) * p for p in at]
    found = ranked(df, column, [r for r in first if r[0] is not None], {r for p in places for r in (math.floor(p), math.ceil(p))})
    between = lambda p, a, b: float(a) if a == b else (math.ceil(p) - p) * a + (p - math.floor(p)) * b
    return [between(p, found[math.floor(p)], found[math.ceil(p)]) for p in places]


def percentiles(df: DataFrame, column: str, at: list[float]) -> list[float | None]:
    """``interpolated``; None for each if there is no number."""
    return interpolated(df, column, histogram(df, column), at)


def repo_stats(manifest: DataFrame, accuracy: int | None = None) -> DataFrame:
    """One row, all zero for an empty manifest. Percentiles interpolate; tokens are rounded up last.

    Percentiles are exact: their ranks are looked for in histograms of bounded size. With an ``accuracy`` they are
    approximated within 1 / accuracy of the ranks, in one pass.
    """
    at = [0.5, 0.75, 0.9]
    tokens = lambda i: S.file_tokens(F.coalesce(F.col("p")[i], F.lit(0.0)))
    if accuracy:
        p = F.percentile_approx("size", at, accuracy).cast("array<double>")
        rows = manifest.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"), p.alias("p"))
    else:
        bins = histogram(manifest, "size")
        one = (sum(r[4] for r in bins), sum(r[5] for r in bins), interpolated(manifest, "size", bins, at))
        rows = manifest.sparkSession.createDataFrame([one], "file_count long, total_bytes long, p array<double>")
    return rows.select(
        "file_count", "total_bytes", S.file_tokens(F.col("total_bytes")).alias("total_tokens"), tokens(0).alias("median_file_tokens"),
        tokens(1).alias("p75_file_tokens"), tokens(2).alias("p90_file_tokens"),
    )


def per_file_tokens(manifest: DataFrame) -> DataFrame:
    return manifest.select("file_path", S.file_tokens(F.col("size")).alias("tokens"))


def naive_tokens(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: the tokens of reading every distinct file of ``rows``; a file that is not in the manifest counts 0."""
    files = rows.select("file_path").distinct()
    return files.join(per_file_tokens(manifest), "file_path", "left").agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("naive_tokens"))


def naive_tokens_of_file(manifest: DataFrame, file_path: str) -> DataFrame:
    """One row: a file's tokens, else the median file's, else 0."""
    own = manifest.where(F.col("file_path") == file_path).agg(F.max(S.file_tokens(F.col("size"))).alias("own"))
    median = manifest.sparkSession.createDataFrame([(percentiles(manifest, "size", [0.5])[0],)], "m double").select(S.file_tokens(F.col("m")).alias("median"))
    return own.join(median, F.lit(True)).select(F.coalesce("own", "median", F.lit(0)).alias("naive_tokens"))


def tool_metrics(calls: DataFrame, *by: str) -> DataFrame:
    """Calls and token sums of each tool; savings are clamped at 0 over the tool's sums."""
    sums = calls.groupBy(*by, "tool").agg(F.count("*").alias("calls"), F.sum("naive_tokens").alias("naive_tokens"), F.sum("actual_tokens").alias("actual_tokens"))
    return sums.withColumn("tokens_saved", S.tokens_saved(F.col("naive_tokens"), F.col("actual_tokens")))


def session_totals(calls: DataFrame, *by: str) -> DataFrame:
    """Totals, percent saved (0 without baseline), and the running total that clamps each call."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    agg = calls.groupBy(*by).agg(
        F.count("*").alias("calls"), zero("naive_tokens").alias("total_naive"), zero("actual_tokens").alias("total_actual"),
        zero(S.tokens_saved(F.col("naive_tokens"), F.col("actual_tokens"))).alias("running_saved"),
    )
    saved = S.tokens_saved(F.col("total_naive"), F.col("total_actual"))
    percent = F.when(F.col("total_naive") > 0, F.round(saved.cast("double") / F.col("total_naive") * 100, 1)).otherwise(0.0)
    return agg.withColumn("total_saved", saved).withColumn("percent_saved", percent)


def saved_since(calls: DataFrame, session: str, order: str) -> DataFrame:
    """For each call, the savings since the session's previous call was reported, and so far."""
    saved = S.tokens_saved(F.col("naive_tokens"), F.col("actual_tokens"))
    w = Window.partitionBy(session).orderBy(order)
    return calls.withColumn("saved_so_far", F.sum(saved).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "delta", F.col("saved_so_far") - F.coalesce(F.lag("saved_so_far").over(w), F.lit(0))
    )


def worst_status(diagnostics: DataFrame) -> DataFrame:
    """The worst parse status of each file."""
    return diagnostics.groupBy("file_path").agg(F.max_by("parse_status", S.severity(F.col("parse_status"))).alias("parse_status"))


def partition_progress(files: DataFrame) -> DataFrame:
    """One row of maps by partition: files in all and files done (state done or failed), and the number failed."""
    by = files.groupBy("partition").agg(F.count("*").cast("int").alias("n"), F.count_if(F.col("state").isin("done", "failed")).cast("int").alias("d"), F.count_if(F.col("state") == "failed").alias("f"))
    pairs = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("partition", c))))
    return by.agg(pairs("n").alias("partition_files_total"), pairs("d").alias("partition_files_done"), F.coalesce(F.sum("f"), F.lit(0)).alias("files_failed"))


def last_errors(errors: DataFrame, order: str, most: int = 20) -> DataFrame:
    """One row: the newest messages, oldest of them first."""
    newest = errors.orderBy(F.col(order).desc()).limit(most)
    return newest.agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "message"))), lambda x: x["message"]).alias("errors"))


def metrics_markdown(tools: DataFrame, totals: DataFrame) -> DataFrame:
    """One row: the session's table as Markdown. Both inputs are small aggregates."""
    n = lambda c: F.format_number(F.col(c), 0)
    line = F.format_string("| %s | %d | %s |", "tool", "calls", n("tokens_saved"))
    body = tools.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tool", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    text = F.concat(
        F.lit("\n### Session Metrics\n\n| Tool | Calls | Tokens saved |\n| :--- | :---: | :--- |\n"), "body",
        F.lit("\n\n**Totals:**\n- Tokens without index: "), n("total_naive"), F.lit("\n- Actual tokens returned: "), n("total_actual"),
        F.lit("\n- Total tokens saved: "), n("total_saved"), F.lit("\n- Percent saved: "), F.format_string("%.1f%%", "percent_saved"),
    )
    return totals.join(body, F.lit(True)).select(text.alias("formatted"))


def census(symbols: DataFrame) -> DataFrame:
    """Extension: symbols by language and kind, with subtotals."""
    return symbols.rollup("language", "kind").agg(F.count("*").alias("n"))


def exists(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""
