"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.chat import format_conversations, read_back
from gazette.llm.decontam import COMMON, NUMBERS, UNITS, contaminated
from gazette.llm.exact_dedup import exact_duplicates
from gazette.llm.licenses import scan_licenses
from gazette.llm.middle import fill_in_middle, restored
from gazette.llm.pii import find_personal_data
from gazette.llm.passages import without_repeats
from gazette.llm.phrases import collocations
from gazette.llm.pieces import encode_documents
from gazette.llm.simhash import near_duplicates
from gazette.llm.token_counts import count_with_edits
from gazette.llm.toxicity import score_documents
from gazette.llm.warc import read_archives, write_pages
from gazette.tables import load


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file; GAZETTE_TOKENIZERS names another folder that all machines have."""
    folder = os.environ.get("GAZETTE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(load(spark, sf_dir, "documents"))
    base, own, starts = F.col("places.label"), F.col("detections.label"), F.col("places.start")
    sure = F.when(F.size("places") > 0, F.lit(0.75)).otherwise(F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.col("detections.score")), F.lit(0.0)), sure).alias("score"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(load(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.expr(f"transform({c}, s -> concat_ws(':', s.kind, s.start, s.end))"), ",")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_documents(load(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: Three edits of every document: an insertion, a deletion and a replacement, at a quarter, half and three quarters of its length.
EDITS = """array(
    named_struct('start', cast(length(text) div 4 AS bigint), 'end', cast(length(text) div 4 AS bigint), 'text', concat(' [note ', coalesce(doc_id, 0), '] ')),
    named_struct('start', cast(length(text) div 2 AS bigint), 'end', cast(length(text) div 2 + 12 AS bigint), 'text', ''),
    named_struct('start', cast(length(text) * 3 div 4 AS bigint), 'end', cast(length(text) * 3 div 4 + 5 AS bigint), 'text', 'REDACTED'))"""


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = count_with_edits(docs.withColumn("edits", F.expr(EDITS)), tokenizer("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", "n_tokens", "n_tokens_edited", "n_reencoded", F.sha2("text", 256).alias("edited_sha256"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, which would be one conversation with a real -1: its turns and that one's in their order."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.unionByName(probe)))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_pages(load(spark, sf_dir, "pages")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(load(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return found.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(load(spark, sf_dir, "documents"))
    back = restored(F.col("form"), F.col("output"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(load(spark, sf_dir, "documents"))


def _sql_words(table: str, key: str) -> str:
    """DuckDB: id (of a key and a text), key, raw and canon (words, and words with placeholders) of a table's different rows."""
    listed = lambda x: "(" + ", ".join(f"'{v}'" for v in x) + ")"
    number = lambda w: f"(({w} >= '0' AND {w} < ':') OR {w} IN {listed(NUMBERS)})"
    return f"""
        SELECT row_number() OVER () AS id, {key}, raw, list_transform(raw, lambda w, i: CASE WHEN {number('w')} THEN '#' WHEN starts_with(w, chr(57344)) THEN '@'
                   WHEN i > 1 AND w IN {listed(UNITS)} AND {number('raw[i - 1]')} THEN '%' ELSE w END) AS canon
        FROM (SELECT {key}, list_transform(regexp_extract_all(lower(regexp_replace(replace(text, chr(57344), ' '),
                  '(^|[^\\p{{L}}\\p{{M}}])(\\p{{Lu}}\\p{{Ll}})', '\\1' || chr(57344) || '\\2', 'g')),
                  chr(57344) || '?[\\p{{L}}\\p{{M}}]+|[0-9]+(?:[.,][0-9]+)*'),
                  lambda w: CASE WHEN starts_with(w, chr(57344)) AND w[2:] IN {listed(dict.fromkeys([*COMMON, *NUMBERS, *UNITS]))} THEN w[2:] ELSE w END) AS raw
              FROM (SELECT DISTINCT {key}, coalesce(text, '') AS text FROM {table} WHERE {key} IS NOT NULL))"""


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op1_licenses: its words and base phrases."""
    return op1_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2_pii: how many spans of each base kind there are."""
    return op2_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_pii": op2_pii,
    "op3_decontaminate": op3_decontaminate,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_token_counts": op5_token_counts,
    "op6_chat_format": op6_chat_format,
    "op7_simhash": op7_simhash,
    "op8_warc": op8_warc,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_collocations": op13_collocations,
    "license_places": license_places,
    "pii_counts": pii_counts,
}

ORACLE: dict[str, str] = {
    "license_places": r"""
        WITH p(phrase, label) AS (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')),
        w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        places AS (SELECT row, label, i - 1 AS place FROM (SELECT row, words, unnest(range(1, len(words) + 1)) AS i FROM w) JOIN p ON words[i : i + len(phrase) - 1] = phrase)
        SELECT any_value(doc_id) AS doc_id, any_value(len(words)) AS n_words, count(label) AS n_base, min(place) AS first_word, max(place) AS last_word,
               coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
        FROM w LEFT JOIN places USING (row) GROUP BY row""",
    "pii_counts": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS ip,
                  list_transform(regexp_extract_all(t, '[0-9](?:[ -]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card,
                  list_transform(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM d)
        SELECT doc_id, len(email) AS n_email,
               len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS INTEGER), 0) > 255)) = 0)) AS n_ip,
               len(list_filter(card, lambda x: length(x) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda i:
                   CASE WHEN i % 2 = 1 THEN substr(x, length(x) - i + 1, 1)::INT ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][substr(x, length(x) - i + 1, 1)::INT + 1] END)) % 10 = 0)) AS n_card,
               len(list_filter(phone, lambda x: length(x) BETWEEN 10 AND 15)) AS n_phone FROM m""",
    # Each word of an item is laid on each equal one of a document; a window stands where all its words do.
    "op3_decontaminate": f"""
        WITH d AS ({_sql_words('documents', 'doc_id')}),
        b AS (SELECT *, least(8, len(canon)) AS width FROM ({_sql_words('benchmark', 'item_id')}) WHERE len(canon) >= 1),
        cut AS (SELECT id AS item, width, unnest(range(1, len(canon) - width + 2)) AS k, canon FROM b WHERE len(canon) >= 5),
        windows AS (SELECT item, min(k) AS k FROM cut WHERE len(list_filter(canon[k : k + width - 1], lambda w: w NOT IN ('#', '@', '%'))) >= least(5, width)
                    GROUP BY item, canon[k : k + width - 1]),
        total AS (SELECT item, count(*) AS item_windows FROM windows GROUP BY item),
        theirs AS (SELECT id AS item, width, unnest(range(1, len(canon) + 1)) AS k, unnest(canon) AS word, unnest(raw) AS value FROM b WHERE id IN (SELECT item FROM total)),
        ours AS (SELECT id AS doc, unnest(range(1, len(canon) + 1)) AS pos, unnest(canon) AS word, unnest(raw) AS value FROM d),
        same AS (SELECT doc, item, width, pos - k AS shift, k, t.word, t.value AS theirs, o.value AS ours FROM ours o JOIN theirs t USING (word)
                 UNION ALL SELECT doc, item, width, pos - k, k, o.word, o.value, o.value FROM ours o JOIN theirs t ON k = 1 AND t.word = '@' AND o.word = t.value[2:]),
        stands AS (SELECT *, count(*) OVER (PARTITION BY doc, item, shift ORDER BY k RANGE BETWEEN CURRENT ROW AND (width - 1) FOLLOWING) = width AS whole FROM same),
        hits AS (SELECT s.* FROM stands s JOIN windows USING (item, k) WHERE whole),
        placed AS (SELECT *, 0 AS kind, shift AS place FROM hits UNION ALL SELECT *, 1, floor(shift / 16) FROM hits UNION ALL SELECT *, 2, floor((shift + 8) / 16) FROM hits),
        enough AS (SELECT doc, item, kind, place, count(DISTINCT k) AS n_windows, any_value(item_windows) AS item_windows FROM placed JOIN total USING (item)
                   GROUP BY ALL HAVING count(DISTINCT k) >= least(6, any_value(item_windows))),
        slots AS (SELECT DISTINCT p.doc, p.item, p.kind, p.place, s.k, s.word, s.theirs, s.ours FROM placed p JOIN enough e ON (p.doc, p.item, p.kind, p.place) = (e.doc, e.item, e.kind, e.place)
                  JOIN same s ON (s.doc, s.item, s.shift) = (p.doc, p.item, p.shift) AND s.k BETWEEN p.k AND p.k + p.width - 1 AND s.word IN ('#', '@', '%')),
        judged AS (SELECT e.*, count(DISTINCT k) AS n_slots, coalesce(bool_and(theirs = ours), true) AS equal FROM enough e LEFT JOIN slots USING (doc, item, kind, place)
                   GROUP BY ALL HAVING count(DISTINCT CASE WHEN k IS NOT NULL THEN [word, theirs, ours] END) = count(DISTINCT CASE WHEN k IS NOT NULL THEN [word, theirs] END)
                       AND count(DISTINCT theirs) FILTER (word = '@') = count(DISTINCT ours) FILTER (word = '@')),
        line AS (SELECT id, doc_id, ' ' || replace(array_to_string(raw, ' '), chr(57344), '') || ' ' AS t FROM d),
        bare AS (SELECT item_id, ' ' || replace(array_to_string(raw, ' '), chr(57344), '') || ' ' AS t, len(list_filter(canon, lambda w: w IN ('#', '@', '%'))) AS n_slots, len(canon) < 5 AS short
                 FROM b WHERE id NOT IN (SELECT item FROM total)),
        found AS (SELECT doc_id, item_id, n_windows, item_windows, n_slots, equal, false AS short FROM judged JOIN d ON d.id = doc JOIN b ON b.id = item
                  UNION ALL SELECT doc_id, item_id, 1, 1, n_slots, true, short FROM line JOIN bare ON contains(line.t, bare.t))
        SELECT doc_id, item_id, max(n_windows) AS n_windows, max(struct_pack(n := n_windows, s := n_slots, i := item_windows)).i AS item_windows,
               max(struct_pack(n := n_windows, s := n_slots, i := item_windows)).s AS n_slots, CASE WHEN bool_and(short) THEN 'short' WHEN bool_or(equal) THEN 'copy' ELSE 'reparameterised' END AS kind
        FROM found GROUP BY doc_id, item_id""",
    "op6_chat_format": r"""
        WITH rows_in AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        turns AS (
            SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS prev,
                   lead(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS next,
                   length(regexp_replace(text, '\\|<s>|</s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<\|answer\|>|<\|role\|>|<\|text\|>|<\|end\|>', '\0#', 'g'))
                   + CASE role WHEN 'system' THEN 8 + 11 WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 11 + 5
                     ELSE 8 + length(regexp_replace(role, '\\|<s>|</s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<\|answer\|>|<\|role\|>|<\|text\|>|<\|end\|>', '\0#', 'g')) + 8 + 7 END AS chars
            FROM rows_in)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS LAST, role, text)) AS loss_sha256,
               CAST(3 + sum(chars) AS BIGINT) AS formatted_chars,
               bool_and(CASE WHEN prev IS NULL THEN role IN ('system', 'user')
                             ELSE (prev, role) IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) END)
                   AND bool_and(next IS NOT NULL OR role = 'assistant') AS valid
        FROM turns GROUP BY conv_id""",
    "op8_warc": r"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
        FROM f""",
    "op9_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS s FROM documents)
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY s) AS keep_id,
               count(*) OVER (PARTITION BY s) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY s) AS kept,
               s AS text_sha256
        FROM n""",
    "op11_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS g FROM documents),
        h AS (SELECT doc_id, t, length(t) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(g, i, 8))::BIGINT) AS h FROM d),
        c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                     CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(t) AS restored_sha256 FROM p""",
    "op12_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
        x AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS m FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
        f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) > 1 AS later FROM x),
        p AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
        c AS (SELECT p.doc_id, p.i, p.word, max(s.i) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS last FROM p LEFT JOIN (SELECT * FROM f WHERE later) s ON s.doc_id = p.doc_id AND s.i = p.i),
        k AS (SELECT doc_id, count(*) FILTER (last IS NOT NULL AND last > i - 20) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (last IS NULL OR last <= i - 20) AS kept FROM c GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op13_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
        g AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) AS s(size)),
        f AS (SELECT lang, phrase, size, count(*) AS n, string_split(phrase, ' ') AS w FROM g GROUP BY ALL),
        total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
        c AS (SELECT * FROM f WHERE size > 1 AND n >= 30),
        cut AS (SELECT lang, phrase, n AS a, unnest(range(1, size)) AS k, w, size FROM c),
        parts AS (SELECT cut.*, x.n AS l, y.n AS r, ((2000000::HUGEINT * a) // (x.n + y.n))::BIGINT AS score
                  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.w[1 : k], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.w[k + 1 :], ' ')),
        worst AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inner_size AS (SELECT lang, n, w, size, unnest(range(2, size)) AS s FROM c),
        held AS (SELECT lang, phrase, max(n) AS n FROM (SELECT lang, n, unnest(list_transform(range(1, size - s + 2), lambda i: array_to_string(w[i : i + s - 1], ' '))) AS phrase FROM inner_size) GROUP BY 1, 2),
        kept AS (SELECT worst.* FROM worst LEFT JOIN held USING (lang, phrase) WHERE held.n IS NULL OR 100 * held.n < 80 * a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, total.n AS n, score
        FROM kept JOIN total USING (lang) QUALIFY rank <= 2000""",
}
