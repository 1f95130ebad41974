"""The archive: compaction of old days into months, retention, and the history of picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.operators.dedup import month_first

RETENTION_DAYS = 90
HEADLINES = "year_month string, date date, category string, seq long, title string, gist string, source string, link string"


def expired(days: DataFrame, today: Column, keep: int = RETENTION_DAYS) -> DataFrame:
    """Rows of days (column date) before the retention."""
    return days.where(F.col("date") < F.date_sub(today, keep))


def new_headlines(snapshots: DataFrame, headlines: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Headlines of a month table after taking in snapshots (date, category, seq, title, summary, source, link); headlines: those of their months at least.

    Days (date) that are in already, by their headlines or by days, are not taken again, so a second run changes nothing; then the first of
    each normalised title within month and category stays.
    """
    known = headlines.select("date") if days is None else headlines.select("date").unionByName(days.select("date"))
    fresh = snapshots.withColumns({"year_month": F.date_format("date", "yyyy-MM"), "gist": F.substring(F.coalesce("summary", F.lit("")), 1, 80)})
    fresh = fresh.join(known.distinct(), "date", "left_anti").select(*headlines.columns)
    months = fresh.select("year_month").distinct()
    touched = headlines.join(months, "year_month", "left_semi").unionByName(fresh)
    return month_first(touched, ["year_month", "category"], ["date", "seq"])


def stock_history(picks: DataFrame, symbol: str, market: str, since: str) -> DataFrame:
    """Archived picks (year_month, date as text, market, symbol, ...) of a symbol from a day on; bad dates are left out.

    The month comes first, so a table partitioned by year_month is pruned.
    """
    day = F.expr("try_to_date(date, 'yyyy-MM-dd')")
    return picks.where(F.col("year_month") >= F.lit(since[:7])).where((F.col("symbol") == symbol) & (F.col("market") == market)).where(day >= F.lit(since).cast("date"))


def compact(spark, snapshots: DataFrame, archive: str, today: Column, keep: int = RETENTION_DAYS) -> list[str]:
    """Moves days before the retention into the month tables below archive, and returns these days.

    The month tables are written before anything may be deleted; a second run finds the days included and changes nothing.
    """
    from gazette.sinks.files import replace_partitions
    from gazette.sources.snapshots import articles, picks
    from gazette.staging import stage

    old = expired(snapshots, today, keep)
    days = [r["date"].isoformat() for r in old.select("date").distinct().orderBy("date").collect()]  # days, not articles
    if not days:
        return []
    # Only the months of these days are read: what other months hold costs nothing.
    months = F.col("year_month").isin(sorted({d[:7] for d in days}))
    there = included(spark, archive).where(months)
    merged = stage(new_headlines(articles(old), headlines(spark, archive).where(months), there), "archive-headlines")
    all_days = stage(there.unionByName(old.select(F.date_format("date", "yyyy-MM").alias("year_month"), "date")).distinct(), "archive-days")
    kept = _table(spark, f"{archive}/picks", "year_month string, date string, market string, horizon string, symbol string, name string, reason string, price_at_pick double").where(months)
    fresh = picks(old).join(kept.select("date").distinct(), "date", "left_anti")
    all_picks = stage(kept.join(fresh.select("year_month").distinct(), "year_month", "left_semi").unionByName(fresh), "archive-picks")
    replace_partitions(merged, f"{archive}/headlines", ["year_month"])
    replace_partitions(all_picks, f"{archive}/picks", ["year_month"])
    replace_partitions(all_days, f"{archive}/days", ["year_month"])  # last: a day is in when all of it is
    return days


def retire(spark, folder: str, archive: str, today: Column, keep: int = RETENTION_DAYS) -> list[str]:
    """Moves the snapshot files of days before the retention into the archive, and deletes a day's file once the archive holds the day. Returns the days.

    Files are deleted only after every one of these days can be read from the archive's list of days again.
    """
    from gazette.sinks.files import drop_files
    from gazette.sources.snapshots import read

    snapshots = read(spark, folder)
    days = compact(spark, snapshots, archive, today, keep)
    if days:
        there = included(spark, archive).where(F.col("year_month").isin(sorted({d[:7] for d in days})) & F.col("date").cast("string").isin(days))
        if there.count() < len(days):
            raise RuntimeError("days are not in the archive; no file was deleted")
        drop_files(snapshots, [f"{folder}/{d.replace('-', '/')}.json" for d in days])
    return days


def _table(spark, folder: str, schema: str) -> DataFrame:
    """The table in folder, empty if it is not there yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema)


def month_counts(headlines: DataFrame) -> DataFrame:
    """article_count of each month and category."""
    return headlines.groupBy("year_month", "category").agg(F.count(F.lit(1)).alias("article_count"))


def headlines(spark, archive: str) -> DataFrame:
    """All headlines of the month tables; empty if there are none yet."""
    return _table(spark, f"{archive}/headlines", HEADLINES)


def included(spark, archive: str) -> DataFrame:
    """year_month, date of all days that the archive has taken in, those without a headline of their own too."""
    return _table(spark, f"{archive}/days", "year_month string, date date")


def month_summary(spark, archive: str, year_month: str) -> DataFrame:
    """A month's headlines, pruned to its partition; empty if there are none."""
    return headlines(spark, archive).where(F.col("year_month") == year_month)


INDEX = "date string, categories array<struct<name:string,path:string>>"


def read_index(spark, path: str) -> DataFrame:
    """The archive index from its JSON file; empty if it is not there yet."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(INDEX).option("multiLine", True).json(path) if there else spark.createDataFrame([], INDEX)


def without_days(index: DataFrame, days: DataFrame) -> DataFrame:
    """The index without days that were removed."""
    return index.join(days.select(F.col("date").cast("string").alias("date")).distinct(), "date", "left_anti")
