"""The steps that may ask a text model: each has a deterministic fallback, which is what runs unless a callable is given."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions import jsonx, numeric, text
from gazette.operators import joins, ranking
from gazette.staging import new_path, small_batches

#: Items of a request, by region: long answers need small requests. Candidates of each category; cards.
SIZES, EACH, CARDS = {"domestic": 8, "overseas": 3}, 6, 10
HEADLINE, BLURB = 40, 110
#: Seconds of a live run in which requests may begin (no run has them by default); seconds to wait when a service is busy and doesn't say how long, and at most.
BUDGET, BUSY, LONGEST = 900.0, (5.0, 15.0), 30
#: Asked with instructions and a listing. Raises Refused for an answer that is an error, other exceptions for a broken connection.
Call = Callable[[str, str], str | None]

RULES = "You are an editor of a Korean daily digest. Say only what the given texts say, in your own words, in plain Korean. Answer with JSON alone."
ARTICLE_FIELDS = {
    "id": "the number of the article in the list, an integer",
    "paraphrased_title": "its title, put in other words, in Korean",
    "summary_250": "a summary of at most 250 characters in Korean; a shorter one where the text gives no more",
    "detail_600": "a longer account of 600 to 800 characters in Korean: facts, background and course of events, not a translation",
    "is_important": "true if it is among today's most important ones of this category",
    "off_topic": "true only if it has nothing to do with this category",
    "exclude": "true for advertising, paid courses and claims without grounds",
}
CARD_FIELDS = {
    "id": "the number of the candidate in the list, an integer",
    "rank": "its place among the ten chosen, from 1",
    "card_headline": f"a headline of at most {HEADLINE} characters in Korean",
    "card_blurb": f"one sentence of at most {BLURB} characters in Korean",
}


class Refused(Exception):
    """A service's answer with an error status, and the Retry-After it sent."""

    def __init__(self, status: int, retry_after: str | None = None):
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after


def instructions(task: str, fields: dict[str, str]) -> str:
    """What a model is told before the listing."""
    return "\n".join([RULES, task, "Give a JSON array with one object for each, with these fields:", *[f"- {k}: {v}" for k, v in fields.items()]])


def pause(error: Exception, attempt: int) -> float | None:
    """Seconds until the next attempt; None if another one would not help: a refusal other than for being busy stays one."""
    if not isinstance(error, Refused) or error.status >= 500:
        return float(2**attempt)
    if error.status != 429:
        return None
    try:
        return float(max(1, min(int(float(error.retry_after)), LONGEST)))
    except (TypeError, ValueError, OverflowError):
        return BUSY[min(attempt, len(BUSY) - 1)]


def answer_to(call: Call, rules: str, prompt: str, retries: int, wait: Callable[[float], None] = time.sleep) -> str | None:
    """The answer, after as many attempts as make sense; null if there is none."""
    for attempt in range(retries + 1):
        try:
            return call(rules, prompt)
        except Exception as e:
            seconds = pause(e, attempt)
            if seconds is None or attempt == retries:
                return None
            wait(seconds)
    return None


class Clock:
    """When a run's first request began, as all its tasks see it: each notes its own start in a folder that they share, and the earliest counts."""

    def __init__(self, folder: str):
        self.folder, self.began = folder, None

    def late(self, budget: float) -> bool:
        """Whether the budget is used up; the call that starts the clock never is too late."""
        now = time.time_ns()
        if self.began is None:
            store, base = pyarrow.fs.FileSystem.from_uri(self.folder)
            store.create_dir(base)
            with store.open_output_stream(f"{base}/{now}-{uuid.uuid4().hex}") as out:
                out.write(b"")
            self.began = min(int(f.base_name.partition("-")[0]) for f in store.get_file_info(pyarrow.fs.FileSelector(base)))
        return now > self.began and now - self.began > budget * 1e9


def ask(requests: DataFrame, call: Call | None, budget: float | None = None, retries: int = 2, at_once: int = 3, clock: str | None = None, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """requests (keys, rules and prompt) with the raw answer. Without a callable every answer is null.

    At most at_once requests run at a time (see concurrency()). Without a budget (seconds) all are asked. With one, a clock (a folder) holds for a run: beyond it answers
    are null. A busy or broken service is tried again, a refusal not; one bad request never takes others with it. An answer
    without an object that can be read is asked for once more.
    """
    if call is None:
        return requests.withColumn("raw", F.lit(None).cast("string"))
    folder = None if budget is None else clock or new_clock(requests.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = (lambda: False) if budget is None else (lambda own=Clock(folder): own.late(budget))
        for b in batches:
            raw = []
            for rules, prompt in zip(b.column("rules"), b.column("prompt")):
                rules, prompt = rules.as_py(), prompt.as_py()
                answer = None if late() else answer_to(call, rules, prompt, retries, wait)
                if answer and not jsonx.readable(answer) and not late():
                    answer = answer_to(call, rules, prompt + "\n\nJSON only, without explanation.", 0, wait) or answer
                raw.append(answer)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.string())], [*b.schema.names, "raw"])

    # Prompts hold whole texts: few go to a worker at a time, however many there are.
    small_batches(requests.sparkSession)
    return requests.repartition(at_once).mapInArrow(run, requests.schema.simpleString()[7:-1].replace(":", " ") + ", raw string")


def new_clock(spark) -> str:
    """A folder for the clock of one run."""
    return new_path(spark, "clock")


def listing(line: Column) -> Column:
    """The numbered lines of a group in order."""
    return F.array_join(F.sort_array(F.collect_list(F.struct("id", line.alias("line"))))["line"], "\n")


def listing_line(body: Column | None = None) -> Column:
    """An article on one line: number, source and language, title, and its body or summary."""
    where = F.concat(F.lit("["), F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("language", F.lit("ko")), F.lit("] "))
    return F.concat(F.col("id").cast("string"), F.lit(". "), where, text.one_line(F.col("title")), F.lit(" — "), text.one_line(F.col("summary") if body is None else body))


def fallback(articles: DataFrame) -> DataFrame:
    """Rules in place of a model: cleaned summary without the title, importance by keywords; marked as failed."""
    clean = text.clean_html(F.col("summary"))
    out = articles.withColumn("summary", clean)
    out = out.withColumn("summary", text.strip_title_prefix(F.col("summary"), F.col("title")))
    return out.withColumns({"is_important": text.is_important(F.col("title"), F.col("summary")), "llm_failed": F.lit(True)})


def summarized(articles: DataFrame, call: Call | None = None, **limits) -> DataFrame:
    """articles with model summaries, or by rules where there is none; off-topic and excluded ones go.

    original_title and original_summary keep what was rewritten; detail_summary is the long version of overseas articles.
    limits: budget, retries, at_once and clock of ask().
    """
    size = F.when(F.col("region") == "overseas", SIZES["overseas"]).otherwise(SIZES["domestic"])
    numbered = ranking.chunks(articles, ["category", "region"], ["article_seq"], 1).drop("id").withColumn("_n", F.col("chunk"))
    numbered = numbered.withColumns({"chunk": F.floor(F.col("_n") / size), "id": (F.col("_n") % size + 1).cast("int")}).drop("_n")
    body = F.coalesce("body", "summary") if "body" in articles.columns else F.col("summary")
    if "language" not in numbered.columns:
        numbered = numbered.withColumn("language", F.lit("ko"))
    requests = numbered.groupBy("category", "region", "chunk").agg(listing(listing_line(body)).alias("prompt"))
    short = {k: v for k, v in ARTICLE_FIELDS.items() if k != "detail_600"}
    told = [F.concat(F.lit(before), F.col("category"), F.lit(after)) for before, after in (instructions("Category: \0.", x).split("\0") for x in (ARTICLE_FIELDS, short))]
    requests = requests.withColumn("rules", F.when(F.col("region") == "overseas", told[0]).otherwise(told[1]))
    answers = ask(requests, call, **limits).select("category", "region", "chunk", F.posexplode(jsonx.items(F.col("raw"))).alias("pos", "item"))
    fields = "id string, paraphrased_title string, summary_250 string, detail_600 string, is_important boolean, off_topic boolean, exclude boolean"
    parsed = answers.select("category", "region", "chunk", "pos", F.from_json("item", fields).alias("i")).select("category", "region", "chunk", "pos", jsonx.safe_int(F.col("i.id")).alias("id"), "i.paraphrased_title", "i.summary_250", "i.detail_600", F.col("i.is_important").alias("model_important"), "i.off_topic", "i.exclude")
    key = F.struct("category", "region", "chunk", "id")
    joined = joins.with_answers(numbered.withColumn("_k", key), parsed.withColumn("_k", key).drop("category", "region", "chunk", "id"), "_k").drop("_k", "chunk", "id")
    joined = joined.where(~F.coalesce("off_topic", F.lit(False)) & ~F.coalesce("exclude", F.lit(False)))
    title, summary = text.decoded(text.strip(F.col("paraphrased_title"))), text.decoded(text.strip(F.col("summary_250")))
    joined = joined.withColumns({"_t": F.coalesce(title, F.lit("")), "_s": F.coalesce(summary, F.lit(""))}).withColumn("_ok", (F.col("_t") != "") & (F.col("_s") != ""))
    ruled = fallback(joined.where("not _ok")).withColumns({"original_title": F.lit(None).cast("string"), "original_summary": F.lit(None).cast("string"), "detail_summary": F.lit(None).cast("string")})
    good = joined.where("_ok").withColumns({"original_title": F.col("title"), "original_summary": F.col("summary")}).withColumns({"title": F.col("_t"), "summary": F.col("_s"), "is_important": F.coalesce("model_important", F.lit(False)), "llm_failed": F.lit(False), "detail_summary": F.col("detail_600")})
    spare = ["_t", "_s", "_ok", "paraphrased_title", "summary_250", "detail_600", "model_important", "off_topic", "exclude"]
    return good.drop(*spare).unionByName(ruled.drop(*spare))


def with_retry(articles: DataFrame, done: DataFrame, call: Call | None, **limits) -> DataFrame:
    """done, with articles that fell back asked for once more; what the second answer excludes goes too."""
    if call is None:
        return done
    failed = done.where("llm_failed").select("article_seq")
    return done.where("not llm_failed").unionByName(summarized(articles.join(failed, "article_seq", "left_semi"), call, **limits))


def with_ai_tags(articles: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """is_ai, ai_subtype and its label of IT articles: from answers (article_seq, ai_subtype, pos), else by keywords."""
    it = F.col("category") == "it"
    if answers is None:
        out = articles.withColumns({"is_ai": it & text.is_ai_related(F.col("title"), F.col("summary")), "ai_subtype": F.lit(None).cast("string")})
    else:
        out = joins.with_answers(articles, answers.withColumn("_tag", F.lit(True)), "article_seq").withColumn("is_ai", it & F.col("_tag").isNotNull()).drop("_tag")
    return out.withColumn("ai_subtype_label", text.ai_label(F.col("ai_subtype")))


def _newest() -> list[Column]:
    return [F.col("is_important").desc(), F.col("published").desc(), F.col("article_seq")]


def top_cards(articles: DataFrame, categories: DataFrame, region: str, call: Call | None = None, **limits) -> DataFrame:
    """The ten cards of a region: by the model's choice of the candidates, else the most important and newest of them."""
    order = _newest()
    best = ranking.top_of_each(articles.where(F.col("region") == region), ["category"], order, EACH, "_each").join(F.broadcast(categories), "category")
    own = [text.trim_at_boundary(F.col("title"), HEADLINE).alias("card_headline"), text.trim_at_boundary(F.col("summary"), BLURB).alias("card_blurb")]
    fields = ["region", "category", "category_name", "link", "source", "detail_path", "detail_rel"]
    ranked = ranking.top_overall(best, ["category"], order, EACH, CARDS).select("rank", *fields, *own)
    if call is None:
        return ranked
    numbered = ranking.chunks(best, ["region"], ["category_seq", "_each"], 10**6)  # at most EACH of each category
    line = F.concat(F.col("id").cast("string"), F.lit(". ["), "category", F.lit("] "), text.one_line(F.col("title")), F.lit(" — "), F.substring(text.one_line(F.col("summary")), 1, 120))
    raw = ask(numbered.groupBy("region").agg(listing(line).alias("prompt")).withColumn("rules", F.lit(instructions("Choose the ten articles that matter most today.", CARD_FIELDS))), call, **limits)
    said = raw.select(F.posexplode(jsonx.items(F.col("raw"))).alias("pos", "item")).select("pos", F.from_json("item", "id string, rank string, card_headline string, card_blurb string").alias("i"))
    chosen = said.select("pos", jsonx.safe_int(F.col("i.id")).cast("long").alias("id"), jsonx.safe_int(F.col("i.rank")).alias("said_rank"), F.col("i.card_headline").alias("h"), F.col("i.card_blurb").alias("b"))
    found = joins.looked_up(chosen, numbered, CARDS, rank="said_rank")
    given = lambda c, mine: F.coalesce(F.nullif(text.decoded(text.strip(F.col(c))), F.lit("")), mine)
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.col("said_rank").asc_nulls_last(), "pos"))  # over ten rows
    cards = found.select(place.alias("rank"), *fields, given("h", own[0]).alias("card_headline"), given("b", own[1]).alias("card_blurb"))
    return ranked if cards.isEmpty() else cards


def with_reasons(picks: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """picks with the reason given for their id, else a sentence on their movement."""
    own = numeric.movement_sentence(F.col("change_pct"), numeric.round_half_up(F.col("volume_ratio")))
    if answers is None:
        return picks.withColumn("reason", own)
    return joins.with_answers(picks, answers).withColumn("reason", F.coalesce(F.nullif(F.trim("reason"), F.lit("")), own))


def probed(keys: DataFrame, probe: Callable[[str], int], at_once: int = 3) -> DataFrame:
    """key, status, usable of each different key (column key): what one small request with it was answered by; null if no answer came."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            status = []
            for key in f["key"]:
                try:
                    status.append(probe(key))
                except Exception as e:
                    status.append(e.status if isinstance(e, Refused) else None)
            yield pd.DataFrame({"key": f["key"], "status": pd.array(status, "Int32")})

    asked = keys.where("length(key) > 0").select("key").distinct().repartition(at_once).mapInPandas(run, "key string, status int")
    return asked.withColumn("usable", usable_status(F.col("status")))


def usable_status(status: Column) -> Column:
    """Whether a key that was answered by this status (null: timeout) can be used: refused and unknown ones cannot."""
    return ~F.coalesce(status.isin(400, 401, 403, 404), F.lit(False))


def concurrency(usable_keys: Column) -> Column:
    """Requests at a time: two for each usable key, from 3 to 16."""
    return numeric.clamp(usable_keys * 2, 3, 16).cast("int")
