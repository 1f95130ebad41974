"""Benchmark decontamination by template canonicalisation, in DataFrame functions alone.

Words are lower-cased; numbers, names (capitalised words other than those of COMMON, wherever they stand) and units behind
numbers become typed placeholders. Windows of WINDOW canonical words of every document are joined by hash with those of the
benchmark. Windows count within one row and one alignment (a shift between the two texts), or within alignments less than
two windows apart, so that a text with an insertion is found and scattered phrases don't add up. Where an item has enough
windows at such a place, the slots under them are checked: an item's value must stand for one value in the document wherever
it occurs, and different names for different names. Every place counts; one that is consistent reports the item. Equal
slots make a copy, other consistent ones a re-parameterised question. An item's first word, if it is a name by its capital
alone, may also stand there in lower case. Items of which no window has LITERAL literal words are found by all their words, unchanged.

The benchmark's windows are broadcast if there are at most BROADCAST_ROWS of them (24 bytes each);
beyond that a fixed-size filter of their hashes goes before a shuffled join. Only texts of candidates are
read again, and shuffled.

Defined cases. Null or empty text: no windows, never reported. Null doc_id: cannot be reported, kept. Repeated doc_ids: each row is
searched by itself, and the document is reported if one of its rows is. Repeated item_ids: each text is searched, and the
item is reported if one of its texts is found; the counts are those of the fullest place. Null item_id: not searched.
Items of fewer than LEAST words: found where all their words stand unchanged, and reported as kind "short"; as ordinary prose has their
like, drop_contaminated() keeps such documents. Items without words: not searched. Empty tables: empty result. Other columns are ignored, or kept by drop_contaminated().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import key_filter, mark_possible, text_of
from gazette.llm.simhash import without
from gazette.staging import stage

WINDOW, LEAST = 8, 5
#: Windows of an item that must be found, or all of them if it has fewer; words of a window that must be no placeholders.
NEEDED, LITERAL = 6, 5
BROADCAST_ROWS = 1_000_000
#: Shifts of one text with an insertion lie in one stretch of this width; two rows of stretches overlap by half.
STRETCH = 2 * WINDOW
#: Places of a document and an item that are checked together.
PART = 4096
NAME = "\ue000"

# Words that count as units behind a number, and as numbers.
UNITS = (
    "mm cm m km mi mile miles inch inches ft foot feet yard yards mg g kg t ton tons tonnes lb lbs oz pound pounds ml l liter liters litre litres "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur percent degrees kmh mph w kw kwh v hz khz mhz ghz kb mb gb tb"
).split()
NUMBERS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million"
).split()


# Words of English, German, French and Spanish that are no names though they begin a sentence.
COMMON = (
    "the an if in on at of to is are was were do does did can could will would should how what when where which who whom whose why and or but for from with this that "
    "these those there it its he she they we you my your his her their find let given each every all some after before "
    "der die das den dem ein eine einen was wie wer wo wann warum welche welcher welches wenn und oder ist sind wird im am es er sie wir ihr "
    "le la les un une des du que qui quel quelle comment quand pourquoi si et ou est sont il elle nous vous dans sur pour "
    "el los las una unos unas como cuando donde cual cuales quien por para es son en se lo"
).split()


def words(text: Column) -> Column:
    """Words in lower case and numbers; capitalised words begin with a private-use mark."""
    marked = F.regexp_replace(F.translate(text, NAME, " "), r"(?<![\p{L}\p{M}])(\p{Lu}\p{Ll})", f"{NAME}$1")
    found = F.regexp_extract_all(F.lower(marked), F.lit(NAME + r"?[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*"), F.lit(0))
    plain = [NAME + w for w in dict.fromkeys([*COMMON, *NUMBERS, *UNITS])]
    return F.transform(found, lambda w: F.when(w.isin(plain), F.substring(w, 2, 1 << 30)).otherwise(w))


def _listed(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def canonical(raw: str) -> Column:
    """The words of array column raw with typed placeholders: # numbers, @ names, % units."""
    number = lambda w: f"({w} >= '0' AND {w} < ':' OR {w} IN {_listed(NUMBERS)})"
    return F.expr(
        f"transform({raw}, (w, i) -> CASE WHEN {number('w')} THEN '#' WHEN startswith(w, '{NAME}') THEN '@' "
        f"WHEN i > 0 AND w IN {_listed(UNITS)} AND {number(raw + '[i - 1]')} THEN '%' ELSE w END)"
    )


def _tokens(docs: DataFrame) -> DataFrame:
    """doc_id, print (of the text: together they name a row, as equal rows have equal places), raw, canon."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).where("doc_id is not null")
    return own.select("doc_id", F.xxhash64("text").alias("print"), words(F.col("text")).alias("raw")).withColumn("canon", canonical("raw"))


def _windows(tokens: DataFrame, column: str, sizes: list[int]) -> DataFrame:
    """doc_id, print, at (from 1), hash of the windows of the given sizes of an array column."""
    none = "cast(array() AS array<struct<at:int,hash:bigint>>)"
    each = [f"IF(size({column}) >= {n}, transform(sequence(1, size({column}) - {n - 1}), i -> struct(i AS at, xxhash64(slice({column}, i, {n})) AS hash)), {none})" for n in sizes]
    return tokens.select("doc_id", "print", F.expr(f"inline(concat({', '.join(each)}))"))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item (of an id and a text), item_id, raw, canon, width (of its windows) of the items that are searched."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).where("item_id is not null").distinct()
    items = own.select(F.xxhash64("item_id", "text").alias("item"), "item_id", words(F.col("text")).alias("raw")).withColumn("canon", canonical("raw"))
    return items.where("size(canon) > 0").withColumn("width", F.least(F.size("canon"), F.lit(WINDOW)))


def benchmark_windows(items: DataFrame) -> DataFrame:
    """item, own (from 1), hash: each item's different windows with enough literal words; short items are one window.

    A first window that begins with a name is given once more with that word in lower case."""
    slices = items.where(f"size(canon) >= {LEAST}").select("item", "raw", F.posexplode(F.expr("transform(sequence(1, size(canon) - width + 1), i -> slice(canon, i, width))")).alias("at", "part"))
    slices = slices.where(F.expr(f"size(filter(part, w -> w NOT IN ('#', '@', '%'))) >= least({LITERAL}, size(part))"))
    lower = slices.where("at = 0 and part[0] = '@'").withColumn("part", F.expr("concat(array(substring(raw[0], 2)), slice(part, 2, size(part)))"))
    return slices.unionByName(lower).groupBy("item", F.xxhash64("part").alias("hash")).agg((F.min("at") + 1).alias("own"))


def _joined(rows: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """Windows with the keys of equal hash. n keys are broadcast if they are few; else a filter of fixed size goes before a shuffled join."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), "hash")
    return mark_possible(rows, stage(key_filter(keys, "hash"), "bench-filter"), "hash", "near").where("near").drop("near").join(keys, "hash")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows (of the item, at the fullest place), item_windows, n_slots (checked there), kind (copy, reparameterised or short) of each document and item it holds."""
    items = stage(benchmark_items(benchmark), "bench-items")
    known = stage(benchmark_windows(items), "bench-windows")
    sizes = [r[0] for r in items.where(f"width BETWEEN {LEAST} AND {WINDOW - 1}").select("width").distinct().collect()]  # at most WINDOW - LEAST values
    hits = _joined(_windows(_tokens(docs), "canon", [WINDOW, *sorted(sizes)]), known, known.count())
    hits = hits.select("doc_id", "print", "item", "own", (F.col("at") - F.col("own")).alias("shift"))
    total = known.groupBy("item").agg(F.count_distinct("own").alias("item_windows"))
    # A place is one shift, or a stretch of shifts.
    half = STRETCH // 2
    places = F.expr(f"inline(array(struct(0 AS row, shift AS place), struct(1 AS row, cast(floor(shift / {STRETCH}) AS int) AS place), struct(2 AS row, cast(floor((shift + {half}) / {STRETCH}) AS int) AS place)))")
    found = hits.select("*", places).groupBy("doc_id", "print", "item", "row", "place").agg(F.collect_set(F.struct("own", "shift")).alias("hits"))
    found = found.withColumn("n_windows", F.expr("cast(size(array_distinct(hits.own)) AS bigint)")).join(total, "item")
    found = found.where(f"n_windows >= least({NEEDED}, item_windows) and (row = 0 or size(array_distinct(hits.shift)) > 1)")
    # A row holds the places of PART shifts, whatever the length of a text that repeats itself.
    part = F.expr(f"cast(floor(place * IF(row = 0, 1, {STRETCH}) / {PART}) AS int)").alias("part")
    found = found.groupBy("doc_id", "print", "item", "item_windows", part).agg(F.collect_list(F.struct("n_windows", "hits")).alias("places"))
    candidates = stage(found.drop("part"), "bench-candidates")
    bitmap = stage(key_filter(candidates.select("doc_id"), "doc_id"), "bench-docs")
    texts = mark_possible(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), bitmap, "doc_id", "near").where("near")
    own = items.select("item", "item_id", F.col("raw").alias("item_raw"), F.col("canon").alias("item_canon"), "width")
    out = _checked(candidates.join(_tokens(texts), ["doc_id", "print"]).join(own, "item"))
    rest = stage(items.join(total, "item", "left_anti").select("item", "item_id", _bare(), "canon"), "bench-rest")
    n = rest.count()
    if n:
        out = out.unionByName(_verbatim(docs, rest, n))
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", "n_slots", "item_windows")).alias("best"), F.bool_or("same").alias("same"), F.bool_and("short").alias("short")).select(
        "doc_id", "item_id", "best.n_windows", "best.item_windows", "best.n_slots", F.when(F.col("short"), "short").when(F.col("same"), "copy").otherwise("reparameterised").alias("kind")
    )


def _bare() -> Column:
    return F.expr(f"transform(raw, w -> replace(w, '{NAME}', ''))").alias("bare")


def _verbatim(docs: DataFrame, rest: DataFrame, n: int) -> DataFrame:
    """Places of the n items without any window of enough literal words, whose words must all stand in the document as they are."""
    first = rest.select("item", F.expr(f"slice(bare, 1, {WINDOW})").alias("part"))
    sizes = [r[0] for r in first.select(F.size("part")).distinct().collect()]  # at most WINDOW values
    tokens = _tokens(docs).select("doc_id", "print", _bare())
    hits = _joined(_windows(tokens, "bare", sorted(sizes)), first.select("item", F.xxhash64("part").alias("hash")), n)
    places = stage(hits.groupBy("doc_id", "print", "item").agg(F.collect_set("at").alias("places")), "bench-places")
    texts = tokens.join(places.select("doc_id", "print").distinct(), ["doc_id", "print"], "left_semi")
    pairs = places.join(texts, ["doc_id", "print"]).join(rest.withColumnRenamed("bare", "item_bare"), "item")
    pairs = pairs.where("exists(places, at -> slice(bare, at, size(item_bare)) = item_bare)")
    slots = F.expr("cast(size(filter(canon, w -> w IN ('#', '@', '%'))) AS bigint)")
    one = F.lit(1).cast("long")
    return pairs.select("doc_id", "item_id", one.alias("n_windows"), slots.alias("n_slots"), one.alias("item_windows"), F.lit(True).alias("same"), (F.size("canon") < LEAST).alias("short"))


def _checked(pairs: DataFrame) -> DataFrame:
    """The fullest of the places whose slots under the windows found there are consistent, and whether one of them has equal slots."""
    placed = "filter(sequence(h.own, h.own + width - 1), k -> item_canon[k - 1] IN ('#', '@', '%') AND canon[k + h.shift - 1] = item_canon[k - 1])"
    slot = "struct(k, item_canon[k - 1] AS kind, item_raw[k - 1] AS theirs, raw[k + h.shift - 1] AS ours)"
    slots = f"array_distinct(flatten(transform(p.hits, h -> transform({placed}, k -> {slot}))))"
    out = pairs.withColumn("judged", F.expr(f"transform(places, p -> struct(p.n_windows AS n_windows, {slots} AS slots))"))
    consistent = (
        "size(array_distinct(transform(j.slots, s -> struct(s.kind, s.theirs, s.ours)))) = size(array_distinct(transform(j.slots, s -> struct(s.kind, s.theirs)))) AND "
        "size(array_distinct(transform(filter(j.slots, s -> s.kind = '@'), s -> s.theirs))) = size(array_distinct(transform(filter(j.slots, s -> s.kind = '@'), s -> s.ours)))"
    )
    out = out.withColumn("judged", F.expr(f"filter(judged, j -> {consistent})")).where("size(judged) > 0")
    best = F.expr("array_max(transform(judged, j -> struct(j.n_windows AS n_windows, cast(size(array_distinct(j.slots.k)) AS bigint) AS n_slots)))")
    same = F.expr("exists(judged, j -> forall(j.slots, s -> s.theirs = s.ours))").alias("same")
    return out.withColumn("best", best).select("doc_id", "item_id", "best.n_windows", "best.n_slots", "item_windows", same, F.lit(False).alias("short"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item of the benchmark, all columns as they are; mere short items don't count."""
    gone = stage(contaminated(docs, benchmark).where("kind <> 'short'").select("doc_id").distinct(), "bench-gone")
    return without(docs, gone)
