"""The daily run as one plan: entries in, ranked articles, cards and pages out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions import dates, htmlx, text
from gazette.operators import dedup, joins, ranking
from gazette.plans import model

MAX_AGE_DAYS, LOOKBACK_DAYS, CAP = 3, 7, 20


def fresh(articles: DataFrame, now: Column) -> DataFrame:
    """Without routine bulletins and articles older than the limit; those with an approximate date stay."""
    young = F.col("date_is_approximate") | (F.col("published") >= now - F.expr(f"INTERVAL {MAX_AGE_DAYS} DAYS"))
    return articles.where(~text.is_bulletin(F.col("title")) & young)


def balanced(articles: DataFrame, history: DataFrame | None, now: Column) -> DataFrame:
    """Fresh and unseen articles, deduplicated, each region of a category round-robin over its sources. seq: the place in it."""
    keys = ["category", "region"]
    kept = fresh(articles, now)
    if history is not None:
        # Approximate or not, a link that was in one of the last days' editions is not news; blank links never match.
        kept = joins.unseen(kept, history, "canonical_link", LOOKBACK_DAYS, F.to_date(dates.local(now)))
    once = dedup.exact_longest(kept, keys, seq="article_seq")
    # Feeds give ten or fifteen entries, so a source's share of an edition is small.
    near = dedup.near_greedy(once, [*keys, "source"])
    return ranking.round_robin(near, keys, "source", "published", "kept_pos", CAP)


def with_bodies(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """articles with body, where the summary needs one and pages (link, html) has it; an approximate date becomes the page's if it states one."""
    wanted = articles.where((F.col("link") != "") & text.needs_body(F.col("summary"))).select("link").distinct()
    found = pages.join(wanted, "link", "left_semi").select("link", htmlx.body(F.col("html")).alias("body"), dates.page_published(F.col("html")).alias("_stated"))
    out = articles.join(found, "link", "left")
    exact = F.col("date_is_approximate") & F.col("_stated").isNotNull()
    return out.withColumns({"published": F.when(exact, F.col("_stated")).otherwise(F.col("published")), "date_is_approximate": F.col("date_is_approximate") & ~exact}).drop("_stated")


def edition(articles: DataFrame, history: DataFrame | None, pages: DataFrame | None, now: Column, call: model.Call | None = None) -> DataFrame:
    """The day's articles in their final form; order them by category, region, important and newest first."""
    own = balanced(articles, history, now)
    own = with_bodies(own, pages) if pages is not None else own.withColumn("body", F.lit(None).cast("string"))
    limits = {} if call is None else {"clock": model.new_clock(articles.sparkSession)}  # one clock for the whole run
    done = model.with_retry(own, model.summarized(own, call, **limits), call, **limits)
    return model.with_ai_tags(done)
