"""The registered queries over the test tables, each with its SQL.

The tables are no news, so concepts are mapped by role: events are articles (type: category, user: source), documents are
articles by source whose title is their first sentence or line and whose summary is the rest, orders are dated items with a
priority, lineitem gives price series. "Now" is always the latest date of a table, never the clock: a scalar subquery.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazette.functions import dates, jsonx, numeric, pagekey, text, urls
from gazette.functions.htmlx import body
from gazette.operators import dedup, joins, metrics, ranking, series, similar
from gazette.sources import registry
from gazette.staging import new_path, stage
from gazette.streaming import refresh
from gazette.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events")


def _dated(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_orderpriority", "o_totalprice", "o_custkey")


#: DuckDB: white space of all scripts, as text.strip() drops it; a text's first sentence or line, and the rest behind it.
_SPACE = "[\\t-\\r \\x{85}\\p{Z}]"
_FIRST = "regexp_extract({}, '^[ \\t\\r\\n]*([^\\n.!?]*[.!?]?)', {})"
_TITLE = _FIRST.format("text", 1)
_REST = f"substr(text, length({_FIRST.format('text', 0)}) + 1)"


def _strip(sql: str) -> str:
    return f"regexp_replace({sql}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _decoded(sql: str) -> str:
    """DuckDB: the entities that the tables hold, as characters."""
    for entity, char in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"')):
        sql = f"replace({sql}, '{entity}', '{char}')"
    return f"regexp_replace({sql}, '&amp;?', '&', 'g')"


def _cleaned(sql: str) -> str:
    """DuckDB: text.clean_html()."""
    wrapper = "(?is)^\\s*<a[^>]*>.*?</a>\\s*(?:&nbsp;)+\\s*<font[^>]*>.*?</font>\\s*$"
    return _decoded(f"CASE WHEN regexp_matches({sql}, '{wrapper}') THEN '' ELSE regexp_replace({sql}, '<[^<]+?>', '', 'g') END")


def _without_title(summary: str, title: str) -> str:
    """DuckDB: text.strip_title_prefix()."""
    s, t = _strip(summary), _strip(title)
    rest = _strip(f"regexp_replace(substr({s}, length({t}) + 1), '^[ \\x{{A0}}–—:·-]+', '')")
    return f"CASE WHEN {summary} <> '' AND {t} <> '' AND starts_with({s}, {t}) THEN {rest} ELSE {summary} END"


def _latest(df: DataFrame, column: str):
    """The latest value of a column of df, as a scalar subquery."""
    return df.agg(F.max(column)).scalar()


def _titled(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """doc_id, title and summary of documents, and further columns of theirs."""
    t = F.col("text")
    return load(spark, d, "documents").select("doc_id", *columns, text.first_sentence(t).alias("title"), text.after_first_sentence(t).alias("summary"))


# --- filters and projections


@query("""WITH c AS (SELECT max(ts) - INTERVAL 3 DAY AS cutoff FROM events)
          SELECT event_id, ts, event_type FROM events, c WHERE ts >= cutoff OR event_type = 'view'""")
def stale_filter(spark, d):
    """Old events go, unless their date is approximate, as those of views are here."""
    from gazette.plans import daily

    e = _events(spark, d).withColumns({"title": F.col("event_type"), "published": F.col("ts"), "date_is_approximate": F.col("event_type") == "view"})
    return daily.fresh(e, _latest(_events(spark, d), "ts")).select("event_id", "ts", "event_type")


_BULLETIN = "CASE WHEN p_partkey % 7 = 0 THEN ' ' || (p_size % 12 + 1)::VARCHAR || '월 ' || (p_partkey % 28 + 1)::VARCHAR || '일 ' || (['부고', '인사', '궂긴 소식', '날씨'])[p_partkey % 4 + 1] || CASE WHEN p_partkey % 3 = 0 THEN ' 외' ELSE '' END ELSE p_name END"


@query(f"SELECT p_partkey, {_BULLETIN} AS title FROM part WHERE NOT regexp_matches({_BULLETIN}, '^\\s*[0-9]{{1,2}}월\\s*[0-9]{{1,2}}일\\s*(궂긴\\s*소식|인사|동정|부고|알림|일정)\\s*$')")
def wire_pattern_filter(spark, d):
    """Part names as titles, every seventh one a bulletin's or nearly so."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("부고", "인사", "궂긴 소식", "날씨")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    more = F.when(F.col("p_partkey") % 3 == 0, " 외").otherwise("")
    dated = F.concat(F.lit(" "), (F.col("p_size") % 12 + 1).cast("string"), F.lit("월 "), (F.col("p_partkey") % 28 + 1).cast("string"), F.lit("일 "), kind, more)
    title = F.when(F.col("p_partkey") % 7 == 0, dated).otherwise(F.col("p_name"))
    return load(spark, d, "part").select("p_partkey", title.alias("title")).where(~text.is_bulletin(F.col("title")))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN url ELSE '' END AS link FROM pages")
def url_scheme_guard(spark, d):
    return load(spark, d, "pages").select("page_id", urls.guarded(F.col("url")).alias("link"))


@query("""SELECT doc_id, length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) < 300 OR ends_with(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '...') OR ends_with(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '…') AS needs_body,
                 len(regexp_extract_all(text, '[.!?]|다\\s|음\\s|죠\\s')) / greatest(length(text) / 100.0::DOUBLE, 1.0::DOUBLE) AS prose FROM documents""")
def prose_score(spark, d):
    t = F.col("text")
    return load(spark, d, "documents").select("doc_id", text.needs_body(t).alias("needs_body"), text.prose_score(t).alias("prose"))


@query(f"""WITH t AS (SELECT doc_id, text, {_TITLE} AS title FROM documents)
           SELECT doc_id, left(text, 80) AS gist, {_without_title('text', 'title')} AS rest,
                  {_strip("regexp_replace(title || ' - ' || source, '[ \\t\\n\\x0B\\f\\r]+-[ \\t\\n\\x0B\\f\\r]+[^-]{1,30}$', '')")} AS title FROM t JOIN documents USING (doc_id, text)""")
def gist_projection(spark, d):
    """The archive's gist (a prefix, as the archive keeps it), the text without its title, and the title without its source."""
    one = load(spark, d, "documents").withColumn("title", text.first_sentence(F.col("text")))
    return one.select("doc_id", F.substring("text", 1, 80).alias("gist"), text.strip_title_prefix(F.col("text"), F.col("title")).alias("rest"), text.strip_suffix(F.concat_ws(" - ", "title", "source")).alias("title"))


# --- joins


@query("""WITH m AS (SELECT max(ts)::DATE AS day FROM events),
          recent AS (SELECT DISTINCT user_id || ':' || event_type AS k FROM events, m WHERE ts::DATE < day AND ts::DATE >= day - 7 AND value > 0)
          SELECT event_id, user_id || ':' || event_type AS k FROM events, m WHERE ts::DATE = day AND user_id || ':' || event_type NOT IN (SELECT k FROM recent)""")
def seen_last7_anti(spark, d):
    e = _events(spark, d).select("event_id", "value", F.concat_ws(":", "user_id", "event_type").alias("k"), F.to_date("ts").alias("date"))
    last = _latest(_events(spark, d).select(F.to_date("ts").alias("date")), "date")
    return joins.unseen(e.where(F.col("date") == last).select("event_id", "k"), e.where("value > 0"), "k", 7, last).select("event_id", "k")


@query(f"""SELECT d.doc_id, coalesce(l.quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN {_TITLE} ELSE coalesce(nullif(trim({_REST}), ''), {_TITLE}) END AS summary
          FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0""")
def left_join_fallback(spark, d):
    answers = load(spark, d, "labels").withColumn("pos", F.lit(0))
    one = joins.with_answers(_titled(spark, d), answers.withColumn("found", F.lit(True)), "doc_id", "pos").where(~(F.coalesce("toxic", F.lit(0)) == 1))
    given = F.nullif(F.trim("summary"), F.lit(""))
    return one.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.when(F.col("found").isNull(), F.col("title")).otherwise(F.coalesce(given, F.col("title"))).alias("summary"))


@query("""WITH c AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS id FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 48)),
          picks AS (SELECT l_orderkey % 60 - 5 AS id, min(l_linenumber) AS rank, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY 1)
          SELECT c.id, o_orderkey, rank::BIGINT AS rank FROM picks JOIN c USING (id) ORDER BY rank, pos LIMIT 10""")
def index_lookup_top10(spark, d):
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    best = load(spark, d, "orders").orderBy(*order).limit(48)
    best = best.withColumn("id", F.row_number().over(Window.orderBy(*order)).cast("long"))  # over 48 rows
    said = load(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 60 - 5).alias("id")).agg(F.min("l_linenumber").cast("long").alias("rank"), F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return joins.looked_up(said, best.select("id", "o_orderkey"), 10).select("id", "o_orderkey", "rank")


@query("""SELECT s_suppkey, n_name, r_name, CASE r_name WHEN 'ASIA' THEN 'domestic' WHEN 'EUROPE' THEN 'overseas' ELSE r_name END AS label
          FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def dim_lookup(spark, d):
    n = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    labels = F.create_map(F.lit("ASIA"), F.lit("domestic"), F.lit("EUROPE"), F.lit("overseas"))
    return load(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name", F.coalesce(F.element_at(labels, F.col("r_name")), F.col("r_name")).alias("label"))


@query("""WITH old AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, min(o_orderkey) AS first_key FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1),
          new AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, max(o_orderkey) AS first_key FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01' GROUP BY 1)
          SELECT * FROM old UNION ALL SELECT * FROM new WHERE day NOT IN (SELECT day FROM old)""")
def insert_if_absent(spark, d):
    o = _dated(spark, d)
    old = o.where("day < date'1998-01-01'").groupBy("day").agg(F.min("o_orderkey").alias("first_key"))
    new = o.where("day >= date'1997-06-01'").groupBy("day").agg(F.max("o_orderkey").alias("first_key"))
    return joins.insert_if_absent(old, new, "day").withColumn("day", F.col("day").cast("string"))


@query("""SELECT 'customer' AS side, c_custkey AS key, c_name AS name FROM customer
          UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier""")
def union_regions(spark, d):
    c = load(spark, d, "customer").select(F.lit("customer").alias("side"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return c.unionByName(load(spark, d, "supplier").select(F.lit("supplier").alias("side"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")))


# --- deduplication

@query(f"""WITH k AS (SELECT doc_id, source, {_REST} AS rest, regexp_replace(lower({_strip(_TITLE)}), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS k FROM documents)
           SELECT doc_id, source, min(doc_id) OVER (PARTITION BY source, k) AS pos FROM k
           QUALIFY row_number() OVER (PARTITION BY source, k ORDER BY length(rest) DESC, doc_id) = 1""")
def exact_dedup_longest(spark, d):
    return dedup.exact_longest(_titled(spark, d, "source"), ["source"], seq="doc_id").select("doc_id", "source", "pos")


_WORDS = "list_sort(list_distinct(regexp_extract_all(text, '[가-힣A-Za-z0-9]{2,}')))"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, source, length(text) AS len, {_WORDS} AS w, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
           p AS (SELECT a.source, a.doc_id AS a, b.doc_id AS b FROM d a JOIN d b ON a.source = b.source AND a.doc_id < b.doc_id
                 WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) >= 0.5 * len(list_distinct(list_concat(a.w, b.w)))),
           s AS (SELECT source, 0 AS i, []::BIGINT[] AS kept FROM d GROUP BY source
             UNION ALL
             SELECT s.source, s.i + 1, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.source = s.source AND p.b = d.doc_id AND list_contains(s.kept, p.a)) THEN s.kept ELSE list_append(s.kept, d.doc_id) END
             FROM s JOIN d ON s.source = d.source AND d.i = s.i + 1),
           k AS (SELECT source, unnest(kept) AS kept_pos FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY i DESC) = 1),
           m AS (SELECT source, kept_pos, kept_pos AS doc_id FROM k
                 UNION ALL SELECT p.source, min(a), b FROM p JOIN k ON k.source = p.source AND k.kept_pos = a WHERE b NOT IN (SELECT kept_pos FROM k) GROUP BY p.source, b)
           SELECT m.source, m.doc_id, kept_pos FROM m JOIN d USING (doc_id) QUALIFY row_number() OVER (PARTITION BY m.source, kept_pos ORDER BY len DESC, m.doc_id) = 1""")
def near_dup_greedy(spark, d):
    """By the words of whole texts, within each source."""
    docs = load(spark, d, "documents").select("doc_id", "source", "text")
    return dedup.near_greedy(docs, ["source"], "text", pos="doc_id", length=F.length("text")).select("source", "doc_id", "kept_pos")


@query(f"""WITH d AS (SELECT source, {_WORDS} AS w, min(doc_id) AS id FROM documents GROUP BY 1, 2 HAVING len(w) > 0),
           p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS jaccard FROM d a JOIN d b ON a.source = b.source AND a.id < b.id)
           SELECT a, b, jaccard FROM p WHERE jaccard >= 0.3""")
def jaccard_pairs(spark, d):
    """Different word sets of a source's whole texts that are alike; the first document stands for those with equal words."""
    docs = load(spark, d, "documents").select("doc_id", "source", text.tokens(F.col("text")).alias("w"))
    return similar.similar_pairs(similar.set_classes(docs, ["source"], "doc_id", "w"), ["source"], 0.3).select("a", "b", "jaccard")


@query(f"SELECT doc_id, len({_WORDS}) AS n, list_aggregate({_WORDS}, 'string_agg', ' ') AS words FROM documents")
def title_tokens(spark, d):
    w = text.tokens(F.col("text"))
    joined = F.array_join(F.array_sort(w), " ")
    return load(spark, d, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.when(joined != "", joined).alias("words"))


#: Links as sources give them: with other ways of writing the same parameters, and tracking ones in disguise.
_LINK = "url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || (['no=%EA%B0%80&q=a%20b', 'no=가&q=a+b', '%75tm_source=x&no=%EA%B0%80', 'a=%zz&b&=c*~', ''])[page_id % 5 + 1]"
_CANON = rf"""(WITH u AS (SELECT page_id, regexp_extract({_strip(_LINK)}, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$', ['scheme', 'host', 'path', 'query']) AS p FROM pages),
    q AS (SELECT page_id, p, list_filter(list_transform(list_filter(string_split(p.query, '&'), lambda x: x <> ''),
        lambda x: [url_decode(replace(regexp_extract(x, '^[^=]*'), '+', ' ')), url_decode(replace(regexp_extract(x, '(?s)=(.*)$', 1), '+', ' '))]),
        lambda x: lower(x[1]) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'igshid', 'ref', 'source', 'from', 'at_medium', 'at_campaign')) AS kept FROM u)
    SELECT page_id, CASE WHEN p.scheme <> '' THEN lower(p.scheme) || ':' ELSE '' END || CASE WHEN p.host <> '' THEN '//' || p.host ELSE '' END || regexp_replace(p.path, '/+$', '')
        || CASE WHEN len(kept) > 0 THEN '?' || list_aggregate(list_transform(kept, lambda x: replace(url_encode(x[1]), '%20', '+') || '=' || replace(url_encode(x[2]), '%20', '+')), 'string_agg', '&') ELSE '' END AS link FROM q)"""


def _links(spark: SparkSession, d: str) -> DataFrame:
    ways = F.array(*[F.lit(x) for x in ("no=%EA%B0%80&q=a%20b", "no=가&q=a+b", "%75tm_source=x&no=%EA%B0%80", "a=%zz&b&=c*~", "")])
    link = F.concat("url", F.when(F.col("url").contains("?"), "&").otherwise("?"), F.element_at(ways, (F.col("page_id") % 5 + 1).cast("int")))
    return load(spark, d, "pages").select("page_id", urls.canonical(link).alias("link"))


@query(f"SELECT page_id, link FROM {_CANON}")
def canonical_url(spark, d):
    return _links(spark, d)


@query(f"SELECT link, count(*) AS n, min(page_id) AS first_page FROM {_CANON} GROUP BY link")
def distinct_urls(spark, d):
    return _links(spark, d).groupBy("link").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


# --- rankings


@query("""WITH r AS (SELECT event_id, event_type, user_id, ts, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id) AS rn,
                     max(ts) OVER (PARTITION BY event_type, user_id) AS mx, min(event_id) OVER (PARTITION BY event_type, user_id) AS s0
                     FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 3 DAY FROM events))
          SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY event_type ORDER BY rn, mx DESC, s0) AS position FROM r
          QUALIFY position <= 20""")
def balanced_top20(spark, d):
    e = _events(spark, d)
    fresh = e.where(F.col("ts") >= _latest(e, "ts") - F.expr("INTERVAL 3 DAYS"))
    return ranking.round_robin(fresh, ["event_type"], "user_id", "ts", "event_id").select("event_type", "user_id", "event_id", F.col("position").cast("long"))


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY month ORDER BY important DESC, o_orderdate DESC, o_orderkey) AS place, important
          FROM (SELECT *, o_orderpriority IN ('1-URGENT', '2-HIGH') AS important, strftime(o_orderdate, '%Y-%m') AS month FROM orders)""")
def important_recent_order(spark, d):
    o = load(spark, d, "orders").withColumns({"important": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "month": dates.month_key(F.col("o_orderdate"))})
    order = [F.col("important").desc(), F.col("o_orderdate").desc(), F.col("o_orderkey")]
    return ranking.numbered(o.select("o_orderkey", "month", "important", "o_orderdate"), ["month"], order).select("o_orderkey", F.col("place").cast("long"), "important")


@query("""WITH b AS (SELECT *, o_orderpriority = '1-URGENT' AS important FROM orders),
          c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY important DESC, o_orderdate DESC, o_orderkey) <= 6)
          SELECT o_orderkey, row_number() OVER (ORDER BY important DESC, o_orderdate DESC, o_orderkey) AS rank FROM c QUALIFY rank <= 10""")
def top6_then_top10(spark, d):
    o = load(spark, d, "orders").withColumn("important", F.col("o_orderpriority") == "1-URGENT")
    order = [F.col("important").desc(), F.col("o_orderdate").desc(), F.col("o_orderkey")]
    return ranking.top_overall(o, ["o_orderpriority"], order, 6, 10).select("o_orderkey", F.col("rank").cast("long"))


@query("SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, ts DESC, event_id) AS rank FROM events QUALIFY rank <= 5")
def top5_preview(spark, d):
    order = [F.col("value").desc(), F.col("ts").desc(), F.col("event_id")]
    return ranking.top_of_each(_events(spark, d), ["event_type"], order, 5).select("event_type", "event_id", F.col("rank").cast("long"))


@query("""SELECT event_type, event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S +0000') AS published FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) <= 3""")
def top3_feed(spark, d):
    best = ranking.top_of_each(_events(spark, d), ["event_type"], [F.col("ts").desc(), F.col("event_id")], 3)
    return best.orderBy(F.col("ts").desc(), "event_id").select("event_type", "event_id", F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss '+0000'").alias("published"))


@query("""WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)
          SELECT doc_id, n // 8 AS chunk, n % 8 + 1 AS id FROM n""")
def chunk_assign(spark, d):
    return ranking.chunks(load(spark, d, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 8).select("doc_id", "chunk", "id")


@query(f"""WITH n AS (SELECT doc_id, source, lang, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)
          SELECT source, n // 8 AS chunk, md5(string_agg((n % 8 + 1)::VARCHAR || '. [' || source || '/' || lang || '] ' || trim(regexp_replace({_TITLE}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))
                     || ' — ' || trim(regexp_replace({_REST}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), chr(10) ORDER BY n)) AS listing_md5 FROM n GROUP BY 1, 2""")
def chunk_listing(spark, d):
    """The numbered lists that the model is asked about, of eight documents of a source each."""
    from gazette.plans import model

    docs = _titled(spark, d, "source", F.col("lang").alias("language"))
    numbered = ranking.chunks(docs, ["source"], ["doc_id"], 8)
    return numbered.groupBy("source", "chunk").agg(F.md5(model.listing(model.listing_line())).alias("listing_md5"))


# --- series

_PRICES = """p AS (SELECT p_brand AS symbol, l_shipdate::DATE AS date, sum(round(l_extendedprice * 100)::BIGINT) / count(*)::DOUBLE AS close, sum(l_quantity::BIGINT)::DOUBLE AS volume
             FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def _prices(spark: SparkSession, d: str) -> DataFrame:
    """A mean price and an amount for each brand and day; cents, so that sums are exact."""
    p = load(spark, d, "part").select("p_partkey", "p_brand")
    x = load(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy(F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("date")).agg(
        (F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.count(F.lit(1)).cast("double")).alias("close"), F.sum(F.col("l_quantity").cast("long")).cast("double").alias("volume")
    )


_ENTRIES = f"""WITH {_PRICES},
    n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS i FROM p),
    h AS (SELECT symbol, list(close ORDER BY i) FILTER (i <= 21) AS c, list(volume ORDER BY i) FILTER (i <= 21) AS v FROM n GROUP BY symbol HAVING count(*) >= 6),
    e AS (SELECT symbol, c[1] AS price, CASE WHEN c[2] <> 0 THEN (c[1] - c[2]) / c[2] * 100 END AS daily,
                 CASE WHEN c[least(6, len(c))] <> 0 THEN (c[1] - c[least(6, len(c))]) / c[least(6, len(c))] * 100 END AS weekly,
                 CASE WHEN c[least(21, len(c))] <> 0 THEN (c[1] - c[least(21, len(c))]) / c[least(21, len(c))] * 100 END AS monthly,
                 CASE WHEN list_sum(v[2:6]) <> 0 THEN v[1] / (list_sum(v[2:6]) / len(v[2:6])) END AS volume_ratio FROM h)"""
_R = "floor({} * 10000 + 0.5) / 10000"


@query(f"""WITH {_PRICES}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS i FROM p)
           SELECT symbol, date::VARCHAR AS date, floor(close) AS close, volume FROM n WHERE i <= 30""")
def price_pages(spark, d):
    """The newest prices of each brand as pages of ten rows, in files; scanned page by page up to three, and read from their tables."""
    from gazette.sinks import files
    from gazette.sources import market

    newest = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    p = _prices(spark, d).withColumn("n", F.row_number().over(newest) - 1).where("n < 40")  # a page more than is scanned
    row = F.concat(F.lit("<tr><td>"), F.date_format("date", "yyyy.MM.dd"), F.lit('</td><td class="num"><span>'), F.format_number(F.floor("close"), 0), F.lit("</span></td><td>-</td><td>"), F.format_number("volume", 0), F.lit("</td></tr>"))
    tables = p.groupBy("symbol", F.floor(F.col("n") / 10).alias("page")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("n", row.alias("r"))))["r"], "").alias("rows"))
    code = F.replace("symbol", F.lit("Brand#"), F.lit("b"))
    pages = tables.select(F.concat(code, F.lit("-"), (F.col("page") + 1).cast("string"), F.lit(".html")).alias("path"), F.concat(F.lit("<table><tr><th>date</th></tr>"), "rows", F.lit("</table>")).alias("content"))
    folder = new_path(spark, "price-pages")
    files.write_pages(pages, folder)
    scanned = market.scan(p.select(code.alias("symbol")).distinct(), folder + "/{symbol}-{page}.html", at_once=None)
    return market.price_rows(scanned).select(F.replace("symbol", F.lit("b"), F.lit("Brand#")).alias("symbol"), F.col("date").cast("string").alias("date"), "close", "volume")


@query(f"{_ENTRIES} SELECT symbol, {_R.format('daily')} AS daily, {_R.format('weekly')} AS weekly, {_R.format('monthly')} AS monthly FROM e")
def pct_change_clamped(spark, d):
    e = series.candidates(_prices(spark, d), ["symbol"])
    return e.select("symbol", *[numeric.round_half_up(F.col(f"{h}_change_pct"), 4).alias(h) for h in series.OFFSETS])


@query(f"{_ENTRIES} SELECT symbol, {_R.format('price')} AS price, {_R.format('volume_ratio')} AS volume_ratio FROM e")
def volume_ratio(spark, d):
    e = series.candidates(_prices(spark, d), ["symbol"])
    return e.select("symbol", numeric.round_half_up(F.col("price"), 4).alias("price"), numeric.round_half_up(F.col("volume_ratio"), 4).alias("volume_ratio"))


@query(f"""{_ENTRIES}, m AS (SELECT *, CASE WHEN symbol < 'Brand#3' THEN 'domestic' ELSE 'overseas' END AS market FROM e),
           u AS (SELECT market, symbol, 'daily' AS horizon, daily AS change_pct FROM m UNION ALL SELECT market, symbol, 'weekly', weekly FROM m UNION ALL SELECT market, symbol, 'monthly', monthly FROM m)
           SELECT market, horizon, symbol, row_number() OVER (PARTITION BY market, horizon ORDER BY change_pct DESC, symbol) AS rank FROM u WHERE change_pct IS NOT NULL QUALIFY rank <= 2""")
def horizon_picks_top2(spark, d):
    e = series.candidates(_prices(spark, d), ["symbol"]).withColumn("market", F.when(F.col("symbol") < "Brand#3", "domestic").otherwise("overseas"))
    return series.picks(e, ["market"], "symbol").select("market", "horizon", "symbol", F.col("rank").cast("long"))


_TOTALS = "t AS (SELECT o_orderpriority AS k, o_orderdate::DATE AS day, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE AS total FROM orders GROUP BY 1, 2)"


def _totals(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("k"), F.to_date("o_orderdate").alias("day")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double").alias("total"))


@query(f"""WITH {_TOTALS}, b AS (SELECT *, lag(total) OVER (PARTITION BY k ORDER BY day) AS prev FROM t)
           SELECT k, day::VARCHAR AS day, floor(CASE WHEN prev = 0 THEN 0.0 ELSE (total - prev) / prev * 100 END * 10000 + 0.5) / 10000 AS pct FROM b""")
def day_over_day(spark, d):
    return series.day_over_day(_totals(spark, d), ["k"], "day", "total").select("k", F.col("day").cast("string").alias("day"), numeric.round_half_up(F.col("pct"), 4).alias("pct"))


_LAST7 = f"""WITH {_TOTALS}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY day DESC) AS i FROM t),
             h AS (SELECT k, list(total ORDER BY day) AS history FROM n WHERE i <= 7 GROUP BY k HAVING count(*) >= 2)"""


@query(f"{_LAST7} SELECT k, len(history) AS n, history[1] AS oldest, history[-1] AS latest, list_min(history) AS low, list_max(history) AS high FROM h")
def last7_history(spark, d):
    h = series.latest_history(_totals(spark, d), ["k"], "day", "total")
    x = F.col("history")
    return h.select("k", F.size(x).cast("long").alias("n"), F.element_at(x, 1).alias("oldest"), F.element_at(x, -1).alias("latest"), F.array_min(x).alias("low"), F.array_max(x).alias("high"))


@query(f"""{_LAST7}, s AS (SELECT k, history AS v, list_min(history) AS lo, CASE WHEN list_max(history) = list_min(history) THEN 1.0 ELSE list_max(history) - list_min(history) END AS span FROM h)
           SELECT k, list_aggregate(list_transform(v, lambda x, i: printf('%.1f,%.1f', ((i - 1) * (84.0::DOUBLE / (len(v) - 1)))::DOUBLE, (25.0::DOUBLE - (x - lo) / span * 22.0::DOUBLE)::DOUBLE)), 'string_agg', ' ') AS points FROM s""")
def sparkline_points(spark, d):
    return series.latest_history(_totals(spark, d), ["k"], "day", "total").select("k", numeric.sparkline_points(F.col("history")).alias("points"))


@query(f"""WITH {_TOTALS}, b AS (SELECT *, lag(total) OVER (PARTITION BY k ORDER BY day) AS prev FROM t)
           SELECT k, CASE WHEN prev IS NULL THEN 'flat' WHEN total > prev THEN 'up' WHEN total < prev THEN 'down' ELSE 'flat' END AS dir, count(*) AS n FROM b GROUP BY ALL""")
def direction_label(spark, d):
    x = series.day_over_day(_totals(spark, d), ["k"], "day", "total")
    return x.groupBy("k", numeric.direction(F.col("pct")).alias("dir")).agg(F.count(F.lit(1)).alias("n"))


# --- archive


@query("""WITH k AS (SELECT o_orderpriority AS category, o_orderdate::DATE AS day, strftime(o_orderdate, '%Y-%m') AS year_month, 'title' || (o_custkey % 50)::VARCHAR AS title FROM orders
                     WHERE o_orderdate::DATE < (SELECT max(o_orderdate)::DATE - 90 FROM orders)),
          f AS (SELECT year_month, category, title, min(day) AS day FROM k GROUP BY ALL)
          SELECT year_month, category, count(*) AS article_count, count(DISTINCT day) AS days FROM f GROUP BY year_month, category""")
def month_compaction(spark, d):
    """Daily snapshots (of up to 256 orders a file) compacted into month tables, twice: the second run finds the days included and changes nothing."""
    from gazette.plans import archive
    from gazette.sources import snapshots

    o = _dated(spark, d)
    item = F.struct(F.concat(F.lit("Title "), (F.col("o_custkey") % 50).cast("string")).alias("title"), F.concat(F.lit("https://x/"), F.col("o_orderkey").cast("string")).alias("link"))
    entries = o.groupBy(F.col("day").alias("date"), F.expr("o_orderkey div 256").alias("file"), "o_orderpriority").agg(F.to_json(F.collect_list(item)).alias("entry"))
    files = entries.groupBy("date", "file").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "entry"))).alias("categories"))
    days = stage(files.select("date", "categories", F.lit(None).cast(f"map<string,map<string,array<{snapshots.PICK}>>>").alias("stock_picks")), "snapshots")
    folder = new_path(spark, "archive")
    for _ in range(2):
        archive.compact(spark, days, folder, F.lit(o.agg(F.max("day")).first()[0]))
    headlines = archive.headlines(spark, folder)
    counts = archive.month_counts(headlines)
    return counts.join(headlines.groupBy("year_month", "category").agg(F.count_distinct("date").alias("days")), ["year_month", "category"])


@query("""WITH m AS (SELECT max(o_orderdate)::DATE - 90 AS cutoff FROM orders)
          SELECT CASE WHEN o_orderdate::DATE < cutoff THEN 'compact' ELSE 'keep' END AS action, count(*) AS n, min(o_orderdate::DATE)::VARCHAR AS first_day, max(o_orderdate::DATE)::VARCHAR AS last_day FROM orders, m GROUP BY 1""")
def retention_split(spark, d):
    o = _dated(spark, d)
    action = F.when(F.col("day") < F.date_sub(_latest(o, "day"), 90), "compact").otherwise("keep")
    return o.groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"))


@query(f"""WITH {_PRICES} SELECT strftime(date, '%Y-%m-%d') AS date, symbol, floor(close * 100 + 0.5) / 100 AS price_at_pick FROM p
           WHERE symbol = 'Brand#13' AND date >= DATE '1997-03-15'""")
def stock_history_query(spark, d):
    from gazette.plans.archive import stock_history

    p = _prices(spark, d).select(dates.month_key(F.col("date")).alias("year_month"), F.date_format("date", "yyyy-MM-dd").alias("date"), F.lit("domestic").alias("market"), "symbol", numeric.round_half_up(F.col("close")).alias("price_at_pick"))
    return stock_history(p, "Brand#13", "domestic", "1997-03-15").select("date", "symbol", "price_at_pick")


# --- texts


@query("""SELECT page_id, regexp_replace(html, '<[^<]+?>', '', 'g') AS text FROM pages""")
def html_strip(spark, d):
    return load(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query(f"SELECT page_id, {_cleaned('html')} AS text FROM pages")
def html_clean(spark, d):
    return load(spark, d, "pages").select("page_id", text.clean_html(F.col("html")).alias("text"))


def _flat(sql: str) -> str:
    return f"trim(regexp_replace({sql}, '\\s+', ' ', 'g'))"


#: The test pages have one container, whose paragraphs follow each other; the SQL reads those, the engine any page.
_ARTICLE = "regexp_extract(html, '(?s)<article[^>]*>(.*?)(</article>|$)', 1)"
_PARAGRAPHS = _flat(_decoded("regexp_replace(regexp_replace(CASE WHEN contains(art, '<p') THEN substr(art, instr(art, '<p')) ELSE '' END, '<p[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')"))
_STATED = ", ".join(f"""nullif(regexp_extract(html, '{p.replace("'", "''")}', 1), '')""" for p in dates.PUBLISHED)


@query(f"""WITH a AS (SELECT page_id, html, {_ARTICLE} AS art FROM pages), t AS (SELECT *, {_PARAGRAPHS} AS paras, {_flat(_decoded("regexp_replace(art, '<[^>]*>', '', 'g')"))} AS whole FROM a),
           f AS (SELECT *, CASE WHEN length(paras) >= 400 THEN paras ELSE whole END AS text FROM t)
           SELECT page_id, left(CASE WHEN length(text) >= 400 AND 100 * len(regexp_extract_all(text, '[.!?]|다\\s|음\\s|죠\\s')) / greatest(length(text), 100)::DOUBLE >= 0.75 THEN text WHEN length(paras) >= 400 THEN paras END, 1500) AS body,
                  try_cast(trim(coalesce({_STATED})) AS TIMESTAMP) AS published FROM f""")
def body_extract(spark, d):
    return load(spark, d, "pages").select("page_id", body(F.col("html")).alias("body"), dates.page_published(F.col("html")).cast("timestamp_ntz").alias("published"))


_TRIMMED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH t AS (SELECT doc_id, {_TRIMMED.format('text')} AS t FROM documents), w AS (SELECT doc_id, t, left(t, 110) AS w FROM t),
           x AS (SELECT *, regexp_extract(w, '(?s)^(.*(?:[.!?]\\s|[다요]\\.$))', 1) AS s, regexp_extract(w, '(?s)^(.*) ', 1) AS b FROM w)
           SELECT doc_id, CASE WHEN length(t) <= 110 THEN t WHEN length(s) >= 55 THEN regexp_replace({_TRIMMED.format('s')}, '&[#a-zA-Z0-9]{{0,7}}$', '')
               ELSE regexp_replace(regexp_replace(CASE WHEN contains(w, ' ') AND length(b) >= 55 THEN b ELSE w END, '[ ,·-]+$', ''), '&[#a-zA-Z0-9]{{0,7}}$', '') || '…' END AS blurb FROM x""")
def trim_boundary(spark, d):
    return load(spark, d, "documents").select("doc_id", text.trim_at_boundary(F.col("text"), 110).alias("blurb"))


def _any_of(words: list[str], c: str) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w.lower()}')" for w in dict.fromkeys(words)) + ")"


@query(f"SELECT doc_id, {_any_of([w for x in text.IMPORTANT.values() for w in x], 'lower(text)')} AS important, {_any_of(text.AI_WORDS, 'lower(concat(chr(32), text, chr(32)))')} AS ai FROM documents")
def keyword_importance(spark, d):
    t = F.col("text")
    return load(spark, d, "documents").select("doc_id", text.is_important(F.lit(""), t).alias("important"), text.is_ai_related(F.lit(""), t).alias("ai"))


@query("""WITH h AS (SELECT doc_id, sha256('salt|' || doc_id::VARCHAR || '|page.html') AS h FROM documents),
          b AS (SELECT doc_id, list_transform(range(0, 10), lambda i: ('0x' || substr(h, (i * 2 + 1)::INT, 2))::INT % 62) AS b FROM h)
          SELECT doc_id, list_aggregate(list_transform(b, lambda x: substr('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', (x + 1)::INT, 1)), 'string_agg', '') AS token FROM b""")
def page_token(spark, d):
    return load(spark, d, "documents").select("doc_id", pagekey.page_token("salt", F.col("doc_id").cast("string"), F.lit("page.html")).alias("token"))


@query("""SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS message,
                 md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'), chr(39), '&#39;')) AS page FROM pages""")
def escape_text(spark, d):
    h = F.col("html")
    return load(spark, d, "pages").select("page_id", text.escape_message(h).alias("message"), F.md5(text.escape_html(h)).alias("page"))


@query("""SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS shown, ts - to_minutes(event_id % 15) AS approximate,
                 ['월', '화', '수', '목', '금', '토', '일'][isodow(ts + INTERVAL 9 HOUR)] AS weekday FROM events""")
def kst_format(spark, d):
    ts = F.col("ts").cast("timestamp")
    day = F.element_at(F.array(*[F.lit(w) for w in dates.WEEKDAYS]), F.weekday(dates.local(ts)) + 1)
    near = dates.choose_date(F.lit(None).cast("timestamp"), F.lit(None).cast("string"), ts, F.col("event_id") % 15)
    return _events(spark, d).select("event_id", dates.local_minute(ts).alias("shown"), near["published"].cast("timestamp_ntz").alias("approximate"), day.alias("weekday"))


# --- JSON


@query("SELECT event_id, ((props->>'$.k')::BIGINT)::INT AS k, 1 AS n FROM events UNION ALL SELECT event_id, NULL, 2 FROM events WHERE event_id % 4 > 0")
def json_props(spark, d):
    """The objects in a model's answer: alone, in prose, beside one whose field is no number, or in an array that is cut off."""
    props, other = F.col("props"), F.lit(', {"k": "none"}')
    ways = F.array(F.concat(F.lit("["), props, F.lit("]")), F.concat(F.lit("Here you are: ["), props, other, F.lit("] (two)")), F.concat(F.lit("["), props, other, F.lit("]")), F.concat(F.lit("["), props, other, F.lit(', {"k": 3')))
    raw = F.element_at(ways, (F.col("event_id") % 4 + 1).cast("int"))
    one = _events(spark, d).select("event_id", F.posexplode(jsonx.items(raw)).alias("n", "item"))
    return one.select("event_id", jsonx.safe_int(F.get_json_object("item", "$.k")).alias("k"), (F.col("n") + 1).alias("n"))


@query("""WITH o AS (SELECT event_type, event_id // 64 AS chunk, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY 1, 2)
          SELECT event_type, chunk, (len(ids) - 1)::BIGINT AS n, CASE WHEN len(ids) > 1 THEN ids[len(ids) - 1] END AS last_id FROM o""")
def json_truncated_salvage(spark, d):
    """Answers on up to 64 events each, cut off within the last object."""
    item = F.to_json(F.struct(F.col("event_id").alias("id"), F.lit('brace } "quote').alias("title")))
    one = _events(spark, d).groupBy("event_type", F.expr("event_id div 64").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("event_id", item.alias("j"))))["j"].alias("a"))
    cut = one.select("event_type", "chunk", F.concat(F.lit("["), F.array_join("a", ",")).alias("raw")).withColumn("raw", F.expr("left(raw, length(raw) - 3)"))
    found = cut.select("event_type", "chunk", F.coalesce(jsonx.items(F.col("raw")), F.array().cast("array<string>")).alias("a"))
    return found.select("event_type", "chunk", F.size("a").cast("long").alias("n"), F.get_json_object(F.try_element_at("a", F.lit(-1)), "$.id").cast("long").alias("last_id"))


@query("""SELECT o_orderpriority AS category, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1""")
def poly_flatten(spark, d):
    """Snapshots of two shapes, lists and objects of lists by region, of up to 256 orders each, flattened to the same articles."""
    o = _dated(spark, d).withColumns({"a": F.struct(F.col("o_orderkey").alias("id")), "file": F.expr("o_orderkey div 256")})
    lists = o.where("o_orderkey % 2 = 0").groupBy("file", F.col("o_orderpriority").alias("category")).agg(F.to_json(F.collect_list("a")).alias("entry"))
    by_region = o.where("o_orderkey % 2 = 1").groupBy("file", F.col("o_orderpriority").alias("category"), F.when(F.col("o_custkey") % 2 == 0, "domestic").otherwise("overseas").alias("region")).agg(F.collect_list("a").alias("l"))
    maps = by_region.groupBy("file", "category").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("region", "l")))).alias("entry"))
    flat = lists.unionByName(maps).select("category", F.explode(jsonx.flattened(F.col("entry"), "struct<id:bigint>")).alias("a"))
    return flat.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("a.id").alias("keys"))


@query("""SELECT r_name AS market, n_name AS horizon, s_suppkey AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def nested_explode(spark, d):
    """Picks nested by market and horizon, as a snapshot of up to 1,000 suppliers holds them, read back by the reader of snapshots."""
    from gazette.sources import snapshots

    n = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = load(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("file", F.expr("s_suppkey div 1000"))
    pick = F.struct(F.col("s_suppkey").cast("string").alias("symbol"))
    inner = s.groupBy("file", "r_name", "n_name").agg(F.collect_list(pick).alias("l"))
    nested = inner.groupBy("file", "r_name").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "l"))).alias("h")).groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", "h")))).alias("j"))
    read = nested.select(F.date_add(F.lit("2026-01-01").cast("date"), F.col("file").cast("int")).alias("date"), F.from_json("j", f"map<string,map<string,array<{snapshots.PICK}>>>").alias("stock_picks"))
    return snapshots.picks(read).select("market", "horizon", F.col("symbol").cast("long").alias("id"))


# --- counters and streams


@query("""SELECT source, count(*) AS total, count(*) FILTER (l.doc_id IS NULL) AS failed, count(*) FILTER (l.doc_id IS NULL) * 100 // count(*) AS pct,
                 CASE WHEN count(*) FILTER (l.doc_id IS NULL) = count(*) THEN 'all_failed' WHEN count(*) FILTER (l.doc_id IS NULL) * 100 // count(*) >= 10 THEN 'degraded' ELSE 'ok' END AS headline
          FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY source""")
def fallback_rate(spark, d):
    known = load(spark, d, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    return metrics.fallback_rate(load(spark, d, "documents").select("doc_id", "source").join(known, "doc_id", "left"), F.col("known").isNull(), ["source"])


@query("""SELECT event_type, count(*) FILTER (user_id % 2 = 0) AS domestic, count(*) FILTER (user_id % 2 = 1) AS overseas FROM events GROUP BY event_type""")
def region_pivot_counts(spark, d):
    e = _events(spark, d).withColumn("region", F.when(F.col("user_id") % 2 == 0, "domestic").otherwise("overseas"))
    return metrics.group_counts(e, "event_type", "region", ["domestic", "overseas"])


@query("""WITH c AS (SELECT max(ts) - INTERVAL 3 DAY AS cutoff FROM events)
          SELECT count(*) FILTER (ts < cutoff) AS stale, count(*) FILTER (value <= 0) AS empty, count(*) FILTER (event_type = 'view') AS views FROM events, c""")
def drop_counts(spark, d):
    e = _events(spark, d)
    cutoff = _latest(e, "ts") - F.expr("INTERVAL 3 DAYS")
    return metrics.drop_counts(e, {"stale": F.col("ts") < cutoff, "empty": F.col("value") <= 0, "views": F.col("event_type") == "view"})


@query("""SELECT event_type, start, value FROM (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) AS start, value,
              row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL 15 MINUTE, ts) ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def refresh_15m(spark, d):
    """The latest value of each quarter of an hour, by the function that the stream uses."""
    return refresh.latest_values(_events(spark, d), ["event_type"]).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "value")


def _in_rounds(spark: SparkSession, d: str, name: str, flow: Callable[[DataFrame], DataFrame], out: str, rounds: int = 3) -> DataFrame:
    """Events arrive in rounds, by time; after each the stream is started anew, runs to its end into a table, and stops."""
    from gazette.streaming import memory

    path = new_path(spark, name)
    events = _events(spark, d)
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    for k in range(rounds):
        events.where(_round_of(events, first, last, rounds) == k).write.mode("append").parquet(f"{path}/in")
        memory.run_to_end(flow(spark.readStream.schema(events.schema).parquet(f"{path}/in")), f"{path}/rows", f"{path}/state")
    return spark.read.schema(out).parquet(f"{path}/rows")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY coalesce(ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > INTERVAL 7 DAY, true)")
def stream_once(spark, d):
    """The events as a stream that is stopped and started again: a key passes if it was not there for seven days, whichever run saw it last."""
    from gazette.streaming import memory

    return _in_rounds(spark, d, "stream-once", lambda e: memory.unseen(e, ["user_id", "event_type"]).select("event_id", "user_id", "event_type"), "event_id bigint, user_id bigint, event_type string")


@query("""WITH RECURSIVE p AS (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY 1, 2
              UNION ALL SELECT p.user_id, p.event_type, (SELECT min(e.ts) FROM events e WHERE e.user_id = p.user_id AND e.event_type = p.event_type AND e.ts > p.ts + INTERVAL 7 DAY) FROM p WHERE p.ts IS NOT NULL)
          SELECT user_id, event_type, count(*) AS passed, max(ts)::VARCHAR AS latest FROM p WHERE ts IS NOT NULL GROUP BY 1, 2""")
def stream_published(spark, d):
    """The same with the memory of what was published: a key passes again seven days after it last passed, however often it was there meanwhile."""
    from gazette.streaming import memory

    passed = _in_rounds(spark, d, "stream-published", lambda e: memory.unseen(e, ["user_id", "event_type"], renew=False).select("user_id", "event_type", "ts"), "user_id bigint, event_type string, ts timestamp_ntz")
    return passed.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("passed"), F.max("ts").cast("string").alias("latest"))


@query("""WITH b AS (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) AS start, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2),
          s AS (SELECT event_type, unnest(generate_series(min(start), (SELECT max(ts) - INTERVAL 75 MINUTE FROM events), INTERVAL 15 MINUTE)) AS start FROM b GROUP BY 1)
          SELECT event_type, start, last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY start) AS value FROM s LEFT JOIN b USING (event_type, start)""")
def stream_last_known(spark, d):
    """The last known value of each quarter of an hour, gaps filled by the one before them, told by timers over several runs."""
    from gazette.streaming import memory

    told = _in_rounds(spark, d, "stream-last-known", lambda e: memory.last_known(e, "event_type"), "event_type string, start timestamp, value double")
    return told.withColumn("start", F.col("start").cast("timestamp_ntz"))


# --- formats


@query("""WITH b AS (SELECT event_type, event_id, value, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) <= 15)
          SELECT event_type, 'Item & <' || event_id::VARCHAR || '>' AS title, 'https://site.example/e?id=' || event_id::VARCHAR AS link, date_trunc('second', ts) AS published FROM b""")
def feed_roundtrip(spark, d):
    """Feeds of the newest items saved as XML files, and read again by Spark's XML reader; one more feed is broken and gives nothing. No Python worker takes part."""
    from gazette.sources import rss

    best = ranking.top_of_each(_events(spark, d), ["event_type"], [F.col("ts").desc(), F.col("event_id")], 15)
    xml = _feed_xml(best, "rank")
    broken = spark.createDataFrame([("broken", "<rss><channel><item>")], "event_type string, content string")
    folder = new_path(spark, "feeds")
    xml.unionByName(broken).write.partitionBy("event_type").text(folder)
    entries = rss.read_saved(spark, folder, 15).where("broken IS NULL")
    return entries.select("event_type", "title", "link", dates.parse_date(F.col("date")).cast("timestamp_ntz").alias("published"))


def _feed_xml(items: DataFrame, order: str) -> DataFrame:
    """event_type, content: an RSS document of each type's items (event_id, ts) in their order."""
    title = text.escape_html(F.concat(F.lit("Item & <"), F.col("event_id").cast("string"), F.lit(">")))
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>https://site.example/e?id="), F.col("event_id").cast("string"), F.lit("</link><pubDate>"), dates.rfc822(F.col("ts").cast("timestamp")), F.lit("</pubDate></item>"))
    listed = F.array_join(F.sort_array(F.collect_list(F.struct(order, item.alias("x"))))["x"], "")
    return items.groupBy("event_type").agg(F.concat(F.lit("<rss><channel>"), listed, F.lit("</channel></rss>")).alias("content"))


def _round_of(events: DataFrame, first, last, rounds: int) -> F.Column:
    """The round in which an event arrives, of as many equal spans of time."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((us(F.col("ts")) - us(F.lit(first))) * rounds / (us(F.lit(last)) - us(F.lit(first)) + 1))


@query("""WITH b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events), p AS (SELECT event_id, event_type, date_trunc('second', ts) AS s, ts, floor((epoch_us(ts) - epoch_us(lo)) * 3 / (epoch_us(hi) - epoch_us(lo) + 1.0)) AS round FROM events, b),
          shown AS (SELECT * FROM (SELECT k, event_type, event_id, s, row_number() OVER (PARTITION BY k, event_type ORDER BY ts DESC, event_id) AS n FROM p JOIN (SELECT unnest([0, 1, 2]) AS k) ON round <= k) WHERE n <= 12
                    UNION ALL SELECT 2, event_type, event_id, s, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM p) WHERE n <= 2),
          f AS (SELECT event_type, event_id, s, min(k) AS poll FROM shown GROUP BY 1, 2, 3), m AS (SELECT k, (SELECT max(s) FROM f WHERE poll < k) AS latest FROM (SELECT unnest([0, 1, 2]) AS k))
          SELECT event_type, event_id, poll::BIGINT AS poll, coalesce(s < latest - INTERVAL 3 DAY, false) AS late FROM f JOIN m ON k = poll""")
def feed_polls(spark, d):
    """Feeds that change between three polls, read as a stream which is stopped and started again: each entry once, late ones apart."""
    from gazette.sinks import files
    from gazette.sources import feed_stream

    folder = new_path(spark, "feed-polls")
    e = _events(spark, d).select("event_id", "event_type", "ts")
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    e = e.withColumn("round", _round_of(e, first, last, 3))
    oldest = ranking.top_of_each(e, ["event_type"], [F.col("ts"), F.col("event_id")], 2)
    for k in range(3):
        shown = ranking.top_of_each(e.where(F.col("round") <= k), ["event_type"], [F.col("ts").desc(), F.col("event_id")], 12)
        shown = shown if k < 2 else shown.unionByName(oldest).dropDuplicates(["event_id"])
        files.write_pages(_feed_xml(shown.withColumn("age", -F.unix_micros(F.col("ts").cast("timestamp"))), "age").withColumn("path", F.concat("event_type", F.lit(".xml"))), folder)
        if not k:
            names = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # five types
            feeds = spark.createDataFrame([(0, n, f"{folder}/{t}.xml", 50, t) for n, t in enumerate(names)], "source_seq int, feed_seq int, url string, entry_limit int, event_type string")
        entries = feed_stream.feed_stream(spark, feeds, f"{folder}/kept").withColumn("ts", dates.parse_date(F.col("date")))
        refresh.write_with_late(entries, f"{folder}/rows", f"{folder}/state").awaitTermination()
    rows = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows").join(feeds.select("feed_seq", "event_type"), "feed_seq")
    return rows.select("event_type", F.regexp_extract("link", "([0-9]+)$", 1).cast("long").alias("event_id"), F.col("batch").cast("long").alias("poll"), F.col("late").cast("boolean").alias("late"))


@query("SELECT event_id, date_trunc('second', ts) AS utc, date_trunc('second', ts) AS shifted, event_id % 5 = 0 AS approximate FROM events")
def parsed_dates(spark, d):
    e = _events(spark, d).withColumn("s", F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"))
    east = F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL 9 HOURS"), "dd MMM yyyy HH:mm:ss"), F.lit(" +0900"))
    raw = F.when(F.col("event_id") % 5 == 0, "not a date").otherwise(F.concat("s", F.lit(" GMT")))
    chosen = dates.choose_date(F.lit(None).cast("timestamp"), raw, F.date_trunc("second", F.col("ts").cast("timestamp")), F.lit(0))
    return e.select("event_id", chosen["published"].cast("timestamp_ntz").alias("utc"), dates.parse_date(east).cast("timestamp_ntz").alias("shifted"), chosen["is_approximate"].alias("approximate"))


@query("""SELECT o_orderkey, format('{:,}', (round(o_totalprice * 100)::BIGINT) // 100) AS shown, (round(o_totalprice * 100)::BIGINT // 100)::DOUBLE AS parsed,
                 CASE WHEN o_custkey % 50 < 1 THEN NULL ELSE least(greatest(o_custkey % 50, 1), 30)::INT END AS wait FROM orders""")
def number_formats(spark, d):
    whole = F.floor(F.round(F.col("o_totalprice") * 100).cast("long") / 100)
    shown = numeric.thousands(whole, 0)
    header = F.when(F.col("o_custkey") % 50 < 1, "soon").otherwise((F.col("o_custkey") % 50).cast("string"))
    return load(spark, d, "orders").select("o_orderkey", shown.alias("shown"), numeric.comma_number(shown).alias("parsed"), numeric.retry_after(header).alias("wait"))


@query("""SELECT page_id, regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/+$', '') AS base, 'https://site.example/x/' || regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '^/+', '') AS full_url FROM pages""")
def url_paths(spark, d):
    path = F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return load(spark, d, "pages").select("page_id", urls.base_path(F.col("url")).alias("base"), urls.joined(F.lit("https://site.example/x/"), path).alias("full_url"))


@query("""SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(p)), lambda p: p <> ''))::BIGINT AS paragraphs,
                 left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 18) AS line1 FROM documents""")
def paragraphs_and_lines(spark, d):
    return load(spark, d, "documents").select("doc_id", F.size(text.paragraphs(F.col("text"))).cast("long").alias("paragraphs"), F.coalesce(F.try_element_at(text.wrap(F.col("text"), 18, 3), F.lit(1)), F.lit("")).alias("line1"))


# --- the daily run over documents as articles

_ARTICLES = f"""a AS (SELECT doc_id AS article_seq, (['politics', 'economy', 'society', 'life', 'culture', 'it', 'science', 'world'])[doc_id % 8 + 1] AS category,
                     CASE WHEN lang = 'en' THEN 'overseas' ELSE 'domestic' END AS region, source, {_TITLE} AS title, {_REST} AS summary,
                     TIMESTAMP '2026-08-14 00:00:00' + to_minutes(doc_id) AS published FROM documents)"""


def _articles(spark: SparkSession, d: str) -> DataFrame:
    """Documents as articles, a minute apart; a thousandth part of them have neither link nor exact date."""
    names = F.array(*[F.lit(c) for c in "politics economy society life culture it science world".split()])
    link = F.when(F.col("doc_id") % 1000 == 999, "").otherwise(F.concat(F.lit("https://site.example/a?id="), F.col("doc_id").cast("string")))
    return _titled(spark, d, "source", "lang").select(
        F.col("doc_id").alias("article_seq"), F.element_at(names, (F.col("doc_id") % 8 + 1).cast("int")).alias("category"), F.when(F.col("lang") == "en", "overseas").otherwise("domestic").alias("region"), "source",
        F.col("lang").alias("language"), "title", "summary", link.alias("link"), link.alias("canonical_link"),
        F.timestamp_add("MINUTE", F.col("doc_id"), F.lit("2026-08-14 00:00:00").cast("timestamp")).alias("published"), (F.col("doc_id") % 1000 == 999).alias("date_is_approximate"),
    )


def _now(spark: SparkSession, d: str):
    """The time of the last article, from the ids alone."""
    last = load(spark, d, "documents").select(F.timestamp_add("MINUTE", F.col("doc_id"), F.lit("2026-08-14 00:00:00").cast("timestamp")).alias("t"))
    return _latest(last, "t")


_EDITION = f"""WITH RECURSIVE {_ARTICLES},
    fresh AS (SELECT * FROM a WHERE (article_seq % 1000 = 999 OR published >= (SELECT max(published) - INTERVAL 3 DAY FROM a))
              AND NOT regexp_matches(title, '^\\s*[0-9]{{1,2}}월\\s*[0-9]{{1,2}}일\\s*(궂긴\\s*소식|인사|동정|부고|알림|일정)\\s*$')),
    keyed AS (SELECT *, regexp_replace(lower({_strip('title')}), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS k FROM fresh),
    once AS (SELECT *, min(article_seq) OVER (PARTITION BY category, region, k) AS pos, length(summary) AS len, list_sort(list_distinct(regexp_extract_all(title, '[가-힣A-Za-z0-9]{{2,}}'))) AS w
             FROM keyed QUALIFY row_number() OVER (PARTITION BY category, region, k ORDER BY length(summary) DESC, article_seq) = 1),
    d AS (SELECT *, row_number() OVER (PARTITION BY category, region, source ORDER BY pos) AS i FROM once),
    p AS (SELECT a.category, a.region, a.source, a.pos AS a, b.pos AS b FROM d a JOIN d b ON (a.category, a.region, a.source) = (b.category, b.region, b.source) AND a.pos < b.pos
          WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) >= 0.5 * len(list_distinct(list_concat(a.w, b.w)))),
    s AS (SELECT category, region, source, 0 AS i, []::BIGINT[] AS kept FROM d GROUP BY ALL
          UNION ALL SELECT s.category, s.region, s.source, s.i + 1, CASE WHEN EXISTS (SELECT 1 FROM p WHERE (p.category, p.region, p.source) = (s.category, s.region, s.source) AND p.b = d.pos AND list_contains(s.kept, p.a))
              THEN s.kept ELSE list_append(s.kept, d.pos) END FROM s JOIN d ON (s.category, s.region, s.source) = (d.category, d.region, d.source) AND d.i = s.i + 1),
    k AS (SELECT category, region, source, unnest(kept) AS kept_pos FROM s QUALIFY row_number() OVER (PARTITION BY category, region, source ORDER BY i DESC) = 1),
    m AS (SELECT category, region, kept_pos, kept_pos AS pos FROM k
          UNION ALL SELECT p.category, p.region, min(a), b FROM p JOIN k ON (k.category, k.region, k.source, k.kept_pos) = (p.category, p.region, p.source, p.a)
              WHERE (p.category, p.region, b) NOT IN (SELECT (category, region, kept_pos) FROM k) GROUP BY p.category, p.region, p.source, b),
    near AS (SELECT once.*, kept_pos FROM m JOIN once USING (category, region, pos) QUALIFY row_number() OVER (PARTITION BY category, region, source, kept_pos ORDER BY len DESC, pos) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY category, region, source ORDER BY published DESC, kept_pos) AS r, max(published) OVER (PARTITION BY category, region, source) AS newest,
               min(kept_pos) OVER (PARTITION BY category, region, source) AS first FROM near),
    placed AS (SELECT *, row_number() OVER (PARTITION BY category, region ORDER BY r, newest DESC, first) AS position FROM ranked WHERE r <= 20 QUALIFY position <= 20),
    clean AS (SELECT * REPLACE ({_cleaned('summary')} AS summary) FROM placed),
    done AS (SELECT * REPLACE ({_without_title('summary', 'title')} AS summary) FROM clean),
    e AS (SELECT article_seq, category, region, position::INT AS position, {_any_of([w for x in text.IMPORTANT.values() for w in x], "lower(title || ' ' || summary)")} AS is_important,
           category = 'it' AND {_any_of(text.AI_WORDS, "lower(' ' || title || ' ' || summary || ' ')")} AS is_ai, true AS llm_failed, title, summary, source, published FROM done)"""


@query(f"{_EDITION} SELECT * EXCLUDE (source, published) FROM e")
def daily_edition(spark, d):
    """Filters, deduplication, balance and the rules in place of a model, over the articles of the last days."""
    from gazette.plans import daily

    a = _articles(spark, d)
    return daily.edition(a, None, None, _now(spark, d)).select("article_seq", "category", "region", "position", "is_important", "is_ai", "llm_failed", "title", "summary")


def _answers(rules: str, prompt: str) -> str:
    """In place of a model: rewrites articles 1 and from 5 on, leaves 2 out, gives 3 no summary and 4 no number; the answer is cut off behind the last of them."""
    import json

    ids = [int(line.partition(".")[0]) for line in prompt.split("\n")]
    items = [{"id": "four" if i == 4 else i, "paraphrased_title": f"item &amp; {i}", "summary_250": "" if i == 3 else "short", "is_important": i % 2 == 1, "exclude": i == 2} for i in ids]
    return "Here: " + json.dumps(items)[:-1] + ', {"id": 9'


def _again(rules: str, prompt: str) -> str:
    import json

    return json.dumps([{"id": int(line.partition(".")[0]), "paraphrased_title": "again", "summary_250": "later", "is_important": False} for line in prompt.split("\n")])


@query(f"""WITH {_ARTICLES}, n AS (SELECT *, (row_number() OVER (PARTITION BY category, region ORDER BY article_seq) - 1) % CASE region WHEN 'overseas' THEN 3 ELSE 8 END + 1 AS id FROM a)
           SELECT article_seq, CASE WHEN id IN (3, 4) THEN 'again' ELSE 'item & ' || id::VARCHAR END AS title, id NOT IN (3, 4) AND id % 2 = 1 AS is_important, false AS llm_failed, title AS original_title FROM n WHERE id <> 2""")
def model_summaries(spark, d):
    """All documents in requests of eight or three, answered by a function in place of a model; what fails is asked for once more."""
    from gazette.plans import model

    a = _articles(spark, d)
    limits = {"at_once": 8}  # and no budget: all are asked
    done = stage(model.summarized(a, _answers, **limits), "summaries")
    return model.with_retry(a, done, _again, **limits).select("article_seq", "title", "is_important", "llm_failed", "original_title")


def _snapshot_files(spark: SparkSession, d: str) -> DataFrame:
    """path, content: daily snapshots of the newest twenty events of each type, in both shapes."""
    e = _events(spark, d).withColumn("day", F.to_date("ts"))
    best = ranking.top_of_each(e, ["day", "event_type"], [F.col("ts").desc(), F.col("event_id")], 20)
    item = F.struct(F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("title"), F.concat(F.lit("https://x/e/?utm_source=q&id="), F.expr("event_id div 2").cast("string"), F.lit("#top")).alias("link"))
    lists = best.groupBy("day", "event_type").agg(F.collect_list(item).alias("l"))
    entry = F.when(F.col("event_type") < "m", F.to_json("l")).otherwise(F.to_json(F.struct(F.col("l").alias("domestic"))))
    cats = lists.select("day", F.concat(F.lit('"'), "event_type", F.lit('":'), entry).alias("c")).groupBy("day").agg(F.array_join(F.collect_list("c"), ",").alias("c"))
    return cats.select(F.concat(F.date_format("day", "yyyy/MM/dd"), F.lit(".json")).alias("path"), F.concat(F.lit('{"date":"'), F.col("day").cast("string"), F.lit('","categories":{'), "c", F.lit("}}")).alias("content"))


@query("""WITH e AS (SELECT event_id, event_type, ts::DATE AS day FROM events QUALIFY row_number() OVER (PARTITION BY ts::DATE, event_type ORDER BY ts DESC, event_id) <= 20), m AS (SELECT max(day) AS day FROM e)
          SELECT DISTINCT 'https://x/e?id=' || (event_id // 2)::VARCHAR AS canonical_link, e.day::VARCHAR AS date FROM e, m WHERE e.day < m.day AND e.day >= m.day - 7""")
def snapshot_links(spark, d):
    """Daily snapshot files of the newest twenty events of each type, in both shapes and beside files that are none; the links of the last seven days before the newest."""
    from gazette.sinks import files
    from gazette.sources import snapshots

    pages = _snapshot_files(spark, d)
    odd = spark.createDataFrame([("notes.json", "{}"), ("2024/01/99.json", '{"categories":{}}'), ("2024/01/readme.txt", "x"), ("2023/12/31.json", "{broken")], "path string, content string")
    folder = new_path(spark, "snapshot-tree")
    files.write_pages(pages.unionByName(odd), folder)
    last = _events(spark, d).agg(F.max(F.to_date("ts"))).first()[0]
    return snapshots.links_before(spark, folder, last).select("canonical_link", F.col("date").cast("string").alias("date"))


@query("""WITH e AS (SELECT event_id, event_type, ts::DATE AS day FROM events QUALIFY row_number() OVER (PARTITION BY ts::DATE, event_type ORDER BY ts DESC, event_id) <= 20),
          m AS (SELECT max(day) - 10 AS cut FROM e)
          SELECT day::VARCHAR AS day, event_type AS category, count(*) AS articles, day < any_value(cut) AS archived FROM e, m GROUP BY e.day, 2""")
def snapshot_retirement(spark, d):
    """Snapshot files of which those older than ten days are moved into the month tables and then deleted: articles by day, and where they are now."""
    from gazette.plans import archive
    from gazette.sinks import files
    from gazette.sources import snapshots

    folder = new_path(spark, "snapshot-tree")
    files.write_pages(_snapshot_files(spark, d), folder)
    last = _events(spark, d).agg(F.max(F.to_date("ts"))).first()[0]
    for _ in range(2):  # the second run finds nothing to move
        archive.retire(spark, folder, f"{folder}-archive", F.lit(last), keep=10)
    counts = lambda rows, archived: rows.groupBy("date", "category").agg(F.count(F.lit(1)).alias("articles")).select(F.col("date").cast("string").alias("day"), "category", "articles", F.lit(archived).alias("archived"))
    return counts(archive.headlines(spark, f"{folder}-archive"), True).unionByName(counts(snapshots.articles(snapshots.read(spark, folder)), False))


@query(f"""WITH {_ARTICLES}, i AS (SELECT *, {_any_of([w for x in text.IMPORTANT.values() for w in x], "lower(title || ' ' || summary)")} AS important FROM a),
           b AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY category ORDER BY important DESC, published DESC, article_seq) <= 3)
           SELECT row_number() OVER (ORDER BY published DESC, article_seq) AS place, category, title, summary, published FROM b""")
def feed_document(spark, d):
    """The day's RSS file, and its items as Spark reads them from the XML."""
    from gazette.sinks import render

    a = _articles(spark, d)
    page = render.feed_xml(a.withColumn("is_important", text.is_important(F.col("title"), F.col("summary"))), "https://site.example")
    body = F.regexp_extract("content", "(?s)(<channel>.*</channel>)", 1)
    items = page.select(F.posexplode(F.from_xml(body, "item array<struct<title:string,description:string,category:string,pubDate:string>>", {"ignoreSurroundingSpaces": "false"})["item"]).alias("n", "i"))
    return items.select((F.col("n") + 1).cast("long").alias("place"), "i.category", "i.title", F.col("i.description").alias("summary"), dates.parse_date(F.col("i.pubDate")).cast("timestamp_ntz").alias("published"))


def _blurb(column: str, limit: int) -> str:
    """DuckDB: text.trim_at_boundary()."""
    t, w = _strip(column), f"left({_strip(column)}, {limit})"
    s, b = f"regexp_extract({w}, '(?s)^(.*(?:[.!?]\\s|[다요]\\.$))', 1)", f"regexp_extract({w}, '(?s)^(.*) ', 1)"
    entity = "regexp_replace({}, '&[#a-zA-Z0-9]{{0,7}}$', '')"
    kept = f"CASE WHEN contains({w}, ' ') AND length({b}) >= {limit / 2} THEN {b} ELSE {w} END"
    return f"CASE WHEN length({t}) <= {limit} THEN {t} WHEN length({s}) >= {limit / 2} THEN {entity.format(_strip(s))} ELSE {entity.format(f"regexp_replace({kept}, '[ ,·-]+$', '')")} || '…' END"


@query(f"""WITH {_ARTICLES}, i AS (SELECT *, {_any_of([w for x in text.IMPORTANT.values() for w in x], "lower(title || ' ' || summary)")} AS is_important FROM a WHERE published >= (SELECT max(published) - INTERVAL 3 DAY FROM a)),
           c AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY region, category ORDER BY is_important DESC, published DESC, article_seq) <= 6)
           SELECT region, category, CASE WHEN article_seq % 1000 = 999 THEN '' ELSE 'https://site.example/a?id=' || article_seq::VARCHAR END AS link, {_blurb('title', 40)} AS card_headline, {_blurb('summary', 110)} AS card_blurb,
                  row_number() OVER (PARTITION BY region ORDER BY is_important DESC, published DESC, article_seq) AS rank FROM c QUALIFY rank <= 10""")
def top10_cards(spark, d):
    from gazette.plans import model

    fresh = _articles(spark, d).where(F.col("published") >= _now(spark, d) - F.expr("INTERVAL 3 DAYS"))
    fresh = fresh.withColumns({"is_important": text.is_important(F.col("title"), F.col("summary")), "detail_path": F.lit(""), "detail_rel": F.lit("")})
    cards = [model.top_cards(fresh, registry.categories(spark), r) for r in ("domestic", "overseas")]
    return cards[0].unionByName(cards[1]).select("region", "category", "link", "card_headline", "card_blurb", F.col("rank").cast("long"))


@query(f"""WITH {_ARTICLES} SELECT region, {_any_of(text.AI_WORDS, "lower(' ' || title || ' ' || summary || ' ')")} AS is_ai, count(*) AS n FROM a WHERE category = 'it' GROUP BY ALL""")
def ai_split(spark, d):
    from gazette.plans import model

    a = _articles(spark, d).where("category = 'it'")
    return model.with_ai_tags(a).groupBy("region", "is_ai").agg(F.count(F.lit(1)).alias("n"))


@query()
def home_and_pages(spark, d):
    """Paths and contents of the category pages, detail pages, home page and feed."""
    from gazette.plans import daily, model
    from gazette.sinks import render

    a = _articles(spark, d)
    e = stage(daily.edition(a, None, None, _now(spark, d)).withColumn("detail_summary", F.when(F.col("region") == "overseas", F.col("summary"))), "edition")
    e = render.with_detail_paths(e, "salt", "2026-08-14")
    cards = model.top_cards(e, registry.categories(spark), "domestic").unionByName(model.top_cards(e, registry.categories(spark), "overseas"))
    site = "https://site.example"
    pages = render.category_pages(e, "salt", "2026-08-14", site).drop("category")
    for more in (render.detail_pages(e, site), render.home_page(e, cards, "2026-08-14", site), render.feed_xml(e, site)):
        pages = pages.unionByName(more)
    return pages


@query(f"""{_EDITION}, shown AS (SELECT article_seq, CASE WHEN is_ai THEN 'ai' ELSE category END AS category, is_important, published FROM e)
           SELECT category, article_seq, row_number() OVER (PARTITION BY category ORDER BY is_important DESC, published DESC, article_seq) AS place FROM shown QUALIFY place <= CASE category WHEN 'ai' THEN 3 ELSE 5 END""")
def home_previews(spark, d):
    """What the home page shows of the edition."""
    from gazette.plans import daily
    from gazette.sinks import render

    return render.previews(daily.edition(_articles(spark, d), None, None, _now(spark, d))).select("category", "article_seq", F.col("place").cast("long"))


_CATEGORIES = "(VALUES " + ", ".join(f"({i}, '{c}', '{name}', '{icon}')" for i, (c, name, icon) in enumerate(registry.CATEGORIES)) + ") c(category_seq, category, category_name, icon)"
_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_TOKEN = "list_aggregate(list_transform(range(0, 10), lambda i: substr('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', (('0x' || substr(sha256('salt|2026-08-14|' || category || '.html'), (i * 2 + 1)::INT, 2))::INT % 62 + 1)::INT, 1)), 'string_agg', '')"


@query(f"""{_EDITION},
    best AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY region, category ORDER BY is_important DESC, published DESC, article_seq) <= 6),
    cards AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY is_important DESC, published DESC, article_seq) AS rank, {_blurb('title', 40)} AS headline,
                     CASE WHEN article_seq % 1000 = 999 THEN '' ELSE 'https://site.example/a?id=' || article_seq::VARCHAR END AS link FROM best QUALIFY rank <= 10),
    lines AS (SELECT region, rank, rank::VARCHAR || '. <b>' || {_ESCAPED.format('headline')} || '</b>' || chr(10) || category_name || ' · ' || {_ESCAPED.format('source')} || ' · <a href="' || {_ESCAPED.format('link')} || '">원문 보기</a>' AS line
              FROM cards JOIN {_CATEGORIES} USING (category)),
    blocks AS (SELECT region, '🔥 <b>오늘의 ' || CASE region WHEN 'domestic' THEN '국내' ELSE '해외' END || ' Top 10</b>' || chr(10) || string_agg(line, chr(10) ORDER BY rank) || chr(10) AS block FROM lines GROUP BY region),
    nav AS (SELECT string_agg('<a href="https://site.example/2026/08/14/' || category || '-' || {_TOKEN} || '.html">' || icon || ' ' || category_name || '</a>', ' · ' ORDER BY category_seq) AS nav
            FROM {_CATEGORIES} WHERE category IN (SELECT category FROM e))
    SELECT '<b>📰 오늘의 기사 (2026-08-14)</b>' || chr(10) || chr(10) || (SELECT string_agg(block, chr(10) ORDER BY region) FROM blocks) || chr(10) || '📂 <b>분야별 바로가기</b>' || chr(10) || nav
           || chr(10) || chr(10) || '🏠 <a href="https://site.example/index.html">홈</a>' AS message FROM nav""")
def lead_message(spark, d):
    from gazette.plans import daily, model
    from gazette.sinks import render

    a = _articles(spark, d)
    e = render.with_detail_paths(stage(daily.edition(a, None, None, _now(spark, d)).withColumn("detail_summary", F.lit(None).cast("string")), "edition"), "salt", "2026-08-14")
    c = registry.categories(spark)
    cards = model.top_cards(e, c, "domestic").unionByName(model.top_cards(e, c, "overseas"))
    return render.lead_message(cards, render.category_pages(e, "salt", "2026-08-14", "https://site.example"), c, "https://site.example", "2026-08-14")


@query(f"""{_LAST7} SELECT k AS name, CASE WHEN history[-2] = 0 THEN 'flat' WHEN history[-1] > history[-2] THEN 'up' WHEN history[-1] < history[-2] THEN 'down' ELSE 'flat' END AS dir,
           CASE WHEN history[-1] > history[-2] THEN '#ef4444' WHEN history[-1] < history[-2] THEN '#3b82f6' ELSE '#8890a3' END AS color, len(history)::BIGINT AS points FROM h""")
def market_indicators(spark, d):
    """Indicators as the intraday refresh shows them; the line's colour follows the shown movement."""
    i = series.indicators(_totals(spark, d), ["k"], "day", "total")
    color, points = F.regexp_extract("sparkline_svg", 'stroke="(#[0-9a-f]+)"', 1), F.regexp_extract("sparkline_svg", 'points="([^"]*)"', 1)
    return i.select(F.col("k").alias("name"), "dir", color.alias("color"), F.size(F.split(points, " ")).cast("long").alias("points"))


@query(f"""{_ENTRIES}, m AS (SELECT *, CASE WHEN symbol < 'Brand#3' THEN 'domestic' ELSE 'overseas' END AS market FROM e)
           SELECT market, symbol, count(*) OVER (PARTITION BY market) AS n FROM m""")
def stock_candidates(spark, d):
    e = series.candidates(_prices(spark, d), ["symbol"]).withColumn("market", F.when(F.col("symbol") < "Brand#3", "domestic").otherwise("overseas"))
    return e.select("market", "symbol", F.count(F.lit(1)).over(Window.partitionBy("market")).alias("n"))


@query(f"""{_ENTRIES}, m AS (SELECT *, CASE WHEN symbol < 'Brand#3' THEN 'domestic' ELSE 'overseas' END AS market FROM e),
           u AS (SELECT market, symbol, volume_ratio, 'daily' AS horizon, daily AS change_pct FROM m UNION ALL SELECT market, symbol, volume_ratio, 'weekly', weekly FROM m UNION ALL SELECT market, symbol, volume_ratio, 'monthly', monthly FROM m),
           r AS (SELECT *, row_number() OVER (PARTITION BY market, horizon ORDER BY change_pct DESC, symbol) AS rank FROM u WHERE change_pct IS NOT NULL QUALIFY rank <= 2)
           SELECT market, horizon, rank::INT AS rank, symbol, '최근 등락률 ' || printf('%+.1f%%', change_pct) || CASE WHEN volume_ratio IS NULL THEN '' ELSE ', 거래량 평균 대비 ' || (floor(volume_ratio * 100 + 0.5) / 100)::VARCHAR || '배' END
                  || ' 흐름을 보이고 있습니다.' AS reason FROM r""")
def stock_reasons(spark, d):
    from gazette.plans import model

    e = series.candidates(_prices(spark, d), ["symbol"]).withColumn("market", F.when(F.col("symbol") < "Brand#3", "domestic").otherwise("overseas"))
    return model.with_reasons(series.picks(e, ["market"], "symbol")).select("market", "horizon", "rank", "symbol", "reason")


@query("""WITH o AS (SELECT n_name AS category, n_nationkey AS category_seq, 'key' || n_regionkey::VARCHAR AS key FROM nation), g AS (SELECT * FROM o WHERE key IN ('key1', 'key3')),
          s AS (SELECT arg_min(key, category_seq) AS spare FROM g)
          SELECT category, CASE WHEN key IN ('key1', 'key3') THEN key ELSE spare END AS key FROM o, s""")
def key_reroute(spark, d):
    owners = load(spark, d, "nation").select(F.col("n_name").alias("category"), F.col("n_nationkey").alias("category_seq"), F.concat(F.lit("key"), F.col("n_regionkey").cast("string")).alias("key"))
    usable = load(spark, d, "region").where("r_regionkey in (1, 3)").select(F.concat(F.lit("key"), F.col("r_regionkey").cast("string")).alias("key"))
    return joins.reroute(owners, usable)


@query("""WITH s AS (SELECT (200 + (o_orderkey % 9) * 50)::INT AS status FROM orders)
          SELECT status, status NOT IN (400, 401, 403, 404) AS usable, count(*) AS n FROM s GROUP BY ALL""")
def key_status(spark, d):
    from gazette.plans import model

    s = load(spark, d, "orders").select((F.lit(200) + (F.col("o_orderkey") % 9) * 50).cast("int").alias("status"))
    return s.groupBy("status", model.usable_status(F.col("status")).alias("usable")).agg(F.count(F.lit(1)).alias("n"))


_FEED_VALUES = ", ".join(f"({i}, '{r[2]}')" for i, r in enumerate(registry.feed_rows()))


@query(f"""WITH f AS (SELECT * FROM (VALUES {_FEED_VALUES}) v(place, source_id)),
           e AS (SELECT event_id % {len(registry.feed_rows())} AS place, count(*) AS n, max(ts) AS newest FROM events GROUP BY 1)
           SELECT source_id, count(*) AS feeds, min(place) AS first_job, coalesce(sum(n), 0)::BIGINT AS entries, max(newest) AS newest FROM f LEFT JOIN e USING (place) GROUP BY source_id""")
def registry_feeds(spark, d):
    """Scan jobs of every source of the registry, in order, and what they brought: events are dealt out over the jobs as their entries."""
    place = F.row_number().over(Window.orderBy("source_seq", "feed_seq")) - 1  # some dozens of feeds
    jobs = registry.feeds(spark).withColumn("place", place.cast("long"))
    brought = _events(spark, d).groupBy((F.col("event_id") % len(registry.feed_rows())).alias("place")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("newest"))
    return jobs.join(brought, "place", "left").groupBy("source_id").agg(F.count(F.lit(1)).alias("feeds"), F.min("place").alias("first_job"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.max("newest").alias("newest"))


@query(f"""{_ENTRIES}, w AS (SELECT symbol, (row_number() OVER (ORDER BY symbol))::INT AS seq FROM (SELECT DISTINCT p_brand AS symbol FROM part)),
           m AS (SELECT e.*, seq, CASE WHEN seq <= 12 THEN 'domestic' ELSE 'overseas' END AS market FROM e JOIN w USING (symbol)),
           u AS (SELECT market, seq, symbol, 'daily' AS horizon, daily AS c FROM m UNION ALL SELECT market, seq, symbol, 'weekly', weekly FROM m UNION ALL SELECT market, seq, symbol, 'monthly', monthly FROM m)
           SELECT market, horizon, symbol, 'Name of ' || symbol AS name, row_number() OVER (PARTITION BY market, horizon ORDER BY c DESC, seq) AS rank FROM u WHERE c IS NOT NULL QUALIFY rank <= 2""")
def watch_list_picks(spark, d):
    from gazette.plans.stocks import market_picks

    symbols = load(spark, d, "part").select(F.col("p_brand").alias("symbol")).distinct()  # two dozen brands
    w = symbols.withColumn("seq", F.row_number().over(Window.orderBy("symbol"))).withColumns({"market": F.when(F.col("seq") <= 12, "domestic").otherwise("overseas"), "name": F.concat(F.lit("Name of "), "symbol")})
    return market_picks(_prices(spark, d), w).select("market", "horizon", "symbol", "name", F.col("rank").cast("long"))


@query("""WITH k AS (SELECT 'key' || n_regionkey::VARCHAR || repeat('x', n_regionkey) AS key, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS owners FROM nation GROUP BY 1)
          SELECT key, rpad(key, (SELECT max(length(key)) FROM k)::INT, ' ') || '  ' || owners AS line FROM k""")
def key_report(spark, d):
    n = load(spark, d, "nation")
    return metrics.key_report(n.select(F.col("n_name").alias("category"), F.concat(F.lit("key"), F.col("n_regionkey").cast("string"), F.expr("repeat('x', n_regionkey)")).alias("key")))


@query("""WITH i AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders), gone AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE o_orderdate::DATE < (SELECT max(o_orderdate)::DATE - 90 FROM orders))
          SELECT date, row_number() OVER (ORDER BY date DESC) AS place, date || '.html' AS path FROM i WHERE date NOT IN (SELECT date FROM gone)""")
def archive_index_cleanup(spark, d):
    """The archive's index file without the days that are past retention, read back in its order."""
    from gazette.plans import archive
    from gazette.sinks import render

    o = _dated(spark, d)
    index = o.select(F.col("day").cast("string").alias("date")).distinct().withColumn("categories", F.array(F.struct(F.lit("it").alias("name"), F.concat("date", F.lit(".html")).alias("path"))))
    page = render.archive_index(archive.without_days(index, archive.expired(o.select(F.col("day").alias("date")), _latest(o, "day"))))
    read = page.select(F.posexplode(F.from_json("content", f"array<struct<{archive.INDEX.replace(' ', ':', 1).replace(', categories ', ',categories:')}>>")).alias("n", "e"))
    return read.select("e.date", (F.col("n") + 1).cast("long").alias("place"), F.col("e.categories")[0]["path"].alias("path"))


@query("SELECT count(*) AS rows, count(*) FILTER (value <= 0) AS empty, count(*) FILTER (event_type = 'view') AS views FROM events")
def observed_counts(spark, d):
    """Counters gathered while the rows pass, by an Observation."""
    df, seen = metrics.observed(_events(spark, d).select("value", "event_type"), "events", {"empty": F.col("value") <= 0, "views": F.col("event_type") == "view"})
    df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(seen.get[k] for k in ("rows", "empty", "views"))], "rows long, empty long, views long")


from gazette.plans import catalog_services  # noqa: E402, F401  its queries register themselves here
