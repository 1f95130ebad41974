"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Fixed expressions find e-mail and IP addresses, card and telephone numbers; these base spans always stand and are the
seeds. The words beside seeds are lexical patterns. A graph of patterns and instances (identifier-like tokens)
is scored in ROUNDS rounds: a pattern's confidence is the mean score of the instances beside it; an instance's score is its
best accepted pattern's confidence, a seed's is 1. What a word stands beside elsewhere counts less: the scores must only make
up SPECIFIC of all the word's occurrences in the corpus, so that cues which also occur in prose hold, and words of prose
that happen to precede an address do not. Patterns that end with CONFIDENCE, SPECIFIC and SUPPORT discover the other instances beside
them as spans of kind "id". Sums are of whole millionths, so that results don't depend on the order of addition.

Instances are tokens of LENGTH characters or more with DIGITS digits or more; others are never discovered. Only (pattern,
instance) counts and counts of the patterns' words are shuffled, both summed before; texts never are.

The expressions are those of the definition, made possessive or anchored where this cannot change a match,
so that long runs of letters or digits take linear time.

Defined cases. Null or empty text: no spans. Null doc_id, repeated rows: each a row of its own. Texts in which
one kind has very many matches: prefix sums go by blocks. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import key_filter, mark_possible, text_of
from gazette.staging import stage

KINDS = ("email", "ip", "card", "phone", "id")
_LOCAL = "A-Za-z0-9._%+-"
# The expressions of the base kinds, with the sign that a text must hold for each.
BASE = {
    "email": (rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
#: Instances: tokens with digits. Their least length and number of digits.
TOKEN, LENGTH, DIGITS = r"(?<!\S)\S*[0-9]\S*", 5, 2
ROUNDS, SUPPORT, CONFIDENCE, SPECIFIC = 3, 3, 500_000, 200_000  # the last two of a million
#: Words beside instances whose hashes are broadcast at most (8 bytes each); more of them go by a filter of fixed size.
BROADCAST_ROWS = 500_000
_BLOCK = 32

SPAN = "array<struct<kind:int,start:bigint,end:bigint,value:string,left:string,right:string>>"


def _found(kind: int, m: str, g: str) -> Column:
    """Spans of the matches in column m with the texts between them in column g. Single-element arrays bind values once."""
    word = r"regexp_replace(lower({}), r'[^\p{{L}}\p{{N}}:#]+', '')"
    # From the end of the text between two matches back to the beginning of its last word, however far that is.
    left = word.format(r"regexp_extract(p.g[i], r'(?s)^.*(?<!\S)(\S+)\s*$', 1)")
    right = word.format(r"regexp_extract(p.g[i + 1], r'^\s*(\S+)', 1)")
    ends = f"B[cast(i div {_BLOCK} AS int)] + aggregate(slice(L, cast(i div {_BLOCK} AS int) * {_BLOCK} + 1, i % {_BLOCK} + 1), 0L, (a, y) -> a + y)"
    blocks = f"transform(sequence(0, cast((size(L) - 1) div {_BLOCK} AS int)), b -> aggregate(slice(L, b * {_BLOCK} + 1, {_BLOCK}), 0L, (a, x) -> a + x))"
    bases = f"aggregate({blocks}, array(0L), (acc, x) -> concat(acc, array(element_at(acc, -1) + x)))"
    return F.expr(
        f"CASE WHEN size({m}) > 0 THEN transform(array(struct({m} AS m, {g} AS g)), p -> "
        f"transform(array(transform(p.m, (x, i) -> cast(length(p.g[i]) + length(x) AS bigint))), L -> "
        f"transform(array({bases}), B -> transform(transform(p.m, (x, i) -> struct(x AS value, {ends} AS end, {left} AS left, {right} AS right)), "
        f"s -> struct({kind} AS kind, s.end - length(s.value) AS start, s.end AS end, s.value AS value, s.left AS left, s.right AS right)))[0])[0])[0] "
        f"ELSE cast(array() AS {SPAN}) END"
    )


_DIGITS = r"regexp_replace(s.value, r'[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": r"forall(split(s.value, r'\.'), x -> length(ltrim('0', x)) <= 3 AND cast(concat('0', right(ltrim('0', x), 3)) AS int) <= 255)",
    "card": f"exists(array({_DIGITS}), d -> length(d) BETWEEN 14 AND 19 AND aggregate(sequence(1, length(d)), 0, (a, i) -> a + "
    "CASE WHEN i % 2 = 1 THEN ascii(substring(d, -i, 1)) - 48 WHEN ascii(substring(d, -i, 1)) > 52 THEN 2 * ascii(substring(d, -i, 1)) - 105 "
    "ELSE 2 * ascii(substring(d, -i, 1)) - 96 END) % 10 = 0)",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
}


def spans(docs: DataFrame) -> DataFrame:
    """rid (a row's number), doc_id, base (valid spans of the base kinds in order), tokens (other instances)."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    none = F.array().cast("array<string>")
    for k, (pattern, sign) in enumerate([*BASE.values(), (TOKEN, "[0-9]")]):
        gate = F.col("text").contains(sign) if len(sign) == 1 else F.col("text").rlike(sign)
        out = out.withColumn(f"_m{k}", F.when(gate, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
        out = out.withColumn(f"_g{k}", F.when(F.size(f"_m{k}") > 0, F.split("text", pattern, -1)).otherwise(none))
    out = out.select("doc_id", *[_found(k, f"_m{k}", f"_g{k}").alias(f"_s{k}") for k in range(len(BASE) + 1)])
    valid = [f"filter(_s{k}, s -> {_VALID[kind]})" for k, kind in enumerate(BASE)]
    out = out.withColumn("base", F.expr(f"array_sort(concat({', '.join(valid)}), (a, b) -> CASE WHEN a.start <> b.start THEN cast(sign(a.start - b.start) AS int) ELSE a.kind - b.kind END)"))
    # Punctuation around a token does not belong to it.
    lead, bare = r"length(regexp_extract(s.value, r'^[\p{Punct}&&[^+@#]]*', 0))", r"regexp_replace(s.value, r'^[\p{Punct}&&[^+@#]]+|\p{Punct}+$', '')"
    trimmed = f"transform(_s{len(BASE)}, s -> struct(s.kind AS kind, s.start + {lead} AS start, s.start + {lead} + length({bare}) AS end, {bare} AS value, s.left AS left, s.right AS right))"
    # Base spans go by blocks in their order, so that a token looks into those blocks alone that reach over it.
    blocks = f"transform(sequence(0, cast((size(base) - 1) div {_BLOCK} AS int)), k -> struct(slice(base, k * {_BLOCK} + 1, {_BLOCK}) AS part, base[k * {_BLOCK}].start AS start, array_max(transform(slice(base, k * {_BLOCK} + 1, {_BLOCK}), b -> b.end)) AS end))"
    free = "NOT exists(K, k -> k.start < s.end AND s.start < k.end AND exists(k.part, b -> b.start < s.end AND s.start < b.end))"
    fit = f"length(s.value) >= {LENGTH} AND length({_DIGITS}) >= {DIGITS}"
    fitting = f"filter({trimmed}, s -> {fit})"
    out = out.withColumn("tokens", F.expr(f"CASE WHEN size(base) = 0 THEN {fitting} ELSE transform(array({blocks}), K -> filter({fitting}, s -> {free}))[0] END"))
    return out.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "base", "tokens")


def _beside(spans_: DataFrame, column: str, seed: int) -> DataFrame:
    """pattern, value, seed of each span's neighbours."""
    one = spans_.select("rid", F.explode(column).alias("s"))
    sides = F.expr("filter(array(concat('L ', s.left), concat('R ', s.right)), x -> length(x) > 2)")
    return one.select("rid", "s", F.explode(sides).alias("pattern"), F.lower("s.value").alias("value"), F.lit(seed).alias("seed"))


def word_counts(docs: DataFrame, words: DataFrame) -> DataFrame:
    """word, total over the whole corpus, of the given words; others are not shuffled."""
    plain = F.regexp_replace(F.lower(text_of()), r"[^\p{L}\p{N}:#\s]+", "")
    each = docs.select(F.explode(F.split(plain, r"\s+")).alias("word"))
    if words.count() <= BROADCAST_ROWS:
        # Hashes, so that the size is bound whatever the words' lengths; a word let through by another's hash is sorted out below.
        each = each.join(F.broadcast(words.select(F.xxhash64("word").alias("hash")).distinct()), F.xxhash64("word") == F.col("hash"), "left_semi")
    else:
        each = mark_possible(each, stage(key_filter(words, "word"), "pii-filter"), "word", "near").where("near").drop("near")
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("total")).join(words, "word", "left_semi")


def accepted_patterns(found: DataFrame, docs: DataFrame) -> DataFrame:
    """pattern, confidence (of a million) of the patterns that hold after the last round."""
    both = _beside(found, "base", 1).unionByName(_beside(found, "tokens", 0))
    edges = both.groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))
    edges = stage(edges, "pii-edges")
    # A pattern beside fewer than SUPPORT instances can never be accepted, whatever their scores.
    wide = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("values")).where(F.col("values") >= SUPPORT).select("pattern")
    edges = stage(edges.join(wide, "pattern", "left_semi"), "pii-wide")
    words = stage(edges.select(F.expr("substring(pattern, 3)").alias("word")).distinct(), "pii-words")
    totals = stage(word_counts(docs, words), "pii-totals")
    edges = stage(edges.join(totals, F.expr("substring(pattern, 3) = word")).drop("word"), "pii-graph")
    held = None
    for _ in range(ROUNDS):
        if held is None:
            scored = edges.select("pattern", "value", "n", "total", (F.col("seed") * 1_000_000).cast("long").alias("score"))
        else:
            best = edges.join(held, "pattern").groupBy("value").agg(F.max("confidence").alias("best"))
            scored = edges.join(best, "value", "left").select("pattern", "value", "n", "total", F.when(F.col("seed") == 1, 1_000_000).otherwise(F.coalesce("best", F.lit(0))).cast("long").alias("score"))
        confidence, specific = F.expr("sum(n * score) div sum(n)"), F.expr("sum(n * score) div max(greatest(total, n))")
        rated = scored.groupBy("pattern").agg(confidence.alias("confidence"), specific.alias("specific"), F.count_if(F.col("score") >= CONFIDENCE).alias("support"))
        held = stage(rated.where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE) & (F.col("specific") >= SPECIFIC)).select("pattern", "confidence"), "pii-patterns")
    return held


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (base and discovered): arrays of kind, start, end (code points, end exclusive), value; one row per input row."""
    found = stage(spans(docs), "pii-spans")
    held = accepted_patterns(found, docs)
    new = _beside(found, "tokens", 0).join(held, "pattern").select("rid", "s").distinct()
    new = new.groupBy("rid").agg(F.collect_list("s").alias("new"))
    out = found.drop("tokens").join(new, "rid", "left")
    order = "array_sort({}, (a, b) -> CASE WHEN a.start <> b.start THEN cast(sign(a.start - b.start) AS int) ELSE a.kind - b.kind END)"
    names = "element_at(array({}), s.kind + 1)".format(", ".join(f"'{k}'" for k in KINDS))
    named = f"transform({{}}, s -> struct({names} AS kind, s.start AS start, s.end AS end, s.value AS value))"
    return out.select("doc_id", F.expr(named.format("base")).alias("base"), F.expr(named.format(order.format(f"concat(base, coalesce(new, cast(array() AS {SPAN})))"))).alias("spans"))
