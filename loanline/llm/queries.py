"""Registered queries of the text operators over their whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanline.llm import (
    audit,
    chat,
    credentials,
    decontamination,
    language,
    lines,
    mixing,
    private,
    quality,
    simhash,
    spelling,
    tokens,
    toxicity,
)
from loanline.llm.text import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_summary(table(spark, sf_dir, "documents")).drop("shards")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_rules(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scan_secrets(table(spark, sf_dir, "documents"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # needed where tokens are counted alone

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = F.lit(f"{chat.CLOSE}{chat.OPEN}assistant ok")
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        both.alias("text"),
    )
    path = public_tokenizers.path("word_bpe_49k.json")
    read = chat.read_back(chat.format_chats(turns.unionByName(added), tokenizer=path))
    return read.withColumn("conv_id", F.col("conv_id").cast("long"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.find_private(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_language": op3_language,
    "op4_secrets": op4_secrets,
    "op5_tokens": op5_tokens,
    "op6_chat": op6_chat,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_simhash": op10_simhash,
    "op11_spelling": op11_spelling,
    "op12_filter_audit": op12_filter_audit,
    "op13_pii": op13_pii,
}

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH doc AS (SELECT doc_id, coalesce({_TERMS}, []) AS w FROM documents),
item AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
spans AS (SELECT item_id, w, least(13, len(w)) AS n FROM item WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM spans)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, i, places.n, item_id FROM places JOIN windows USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(n)) AS k FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"
QUALITY_BASE = rf"""
doc AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
spread AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM doc)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM spread) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(8)) AS k FROM again) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM doc),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup,
    count(*) FILTER (regexp_matches(l, '^[\x20\x09-\x0D]*[-*•|]')) AS n_list,
    count(*) FILTER (regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS n_cut
    FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counted AS (SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_list, 0) AS n_list, coalesce(n_cut, 0) AS n_cut,
    length(regexp_replace(text, '[^!?]+', '', 'g')) AS n_marks, length(regexp_replace(text, '\P{{L}}+', '', 'g')) AS n_letters,
    length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS n_upper,
    len([x for x in w if lower(x) IN ({", ".join(f"'{x}'" for x in dict.fromkeys(quality.STOP_WORDS))})]) AS n_stop
    FROM doc LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id))"""
QUALITY = f"""
WITH {QUALITY_BASE}, judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND coalesce(word_chars / n_words BETWEEN 2 AND 20 AND n_symbols / n_words <= 0.1 AND n_marks / n_words <= 0.5
        AND n_letters / word_chars >= 0.6 AND n_upper / greatest(n_letters, 1) <= 0.6 AND n_stop / n_words >= 0.01
        AND n_dup_lines / n_lines <= 0.3 AND n_list / n_lines <= 0.9 AND n_cut / n_lines <= 0.3, false) AS kept
FROM judged"""

# Chunks are compared by their lines themselves here; a document is one row.
LINE_DEDUP = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
every AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM split),
line AS (SELECT *, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS w FROM every),
placed AS (SELECT doc_id, l, i, w, CAST(sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS upto FROM line WHERE w > 0),
run AS (
    SELECT doc_id, list(l) OVER f AS k, min(i) OVER f AS low, max(i) OVER f AS high, sum(w) OVER f AS w FROM placed
    WINDOW f AS (PARTITION BY doc_id ORDER BY upto - w RANGE BETWEEN CURRENT ROW AND 50 FOLLOWING)
    UNION
    SELECT doc_id, list(l) OVER b AS k, min(i) OVER b AS low, max(i) OVER b AS high, sum(w) OVER b AS w FROM placed
    WINDOW b AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 50 PRECEDING AND CURRENT ROW)),
chunk AS (SELECT doc_id, k, low, high FROM run WHERE w > 50),
owner AS (SELECT k, min(doc_id) AS least FROM chunk GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(low, high + 1)) AS i FROM chunk JOIN owner USING (k) WHERE doc_id <> least),
rest AS (SELECT e.doc_id, count(*) - count(g.i) AS n, count(g.i) AS n_removed, count(*) AS n_lines,
    string_agg(CASE WHEN g.i IS NULL THEN l END, chr(10) ORDER BY e.i) AS text
    FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT doc_id, n_lines, n_removed, CASE WHEN n = 0 THEN '' ELSE text END AS text FROM rest
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL"""

# What a source's mix takes is a first part of its rows in the order of their keys, after whole passes.
MIXING = r"""
WITH doc AS (SELECT doc_id, source, len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])) AS size,
    concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', md5(coalesce(text, ''))) AS name FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM doc GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS weight FROM sums),
filled AS (SELECT *, 2.0::DOUBLE * source_size AS top,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level FROM weighed
    WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first_over AS (SELECT min_by(level, top / weight) AS level FROM filled WHERE top / weight > level),
wanted AS (SELECT source, source_size, CASE WHEN f.level IS NULL OR top / weight <= f.level THEN top ELSE f.level * weight END AS target
    FROM filled, first_over f),
planned AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS whole FROM wanted),
passed AS (SELECT *, CASE WHEN source_size > 0 THEN whole // source_size ELSE 0 END AS passes,
    CASE WHEN source_size > 0 THEN whole % source_size ELSE 0 END AS rest FROM planned),
keyed AS (SELECT doc_id, size, source_size, target, passes, rest, md5(concat('mix:', passes, ':', name)) AS key, p.source
    FROM doc JOIN passed p ON doc.source IS NOT DISTINCT FROM p.source),
placed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key ROWS UNBOUNDED PRECEDING) - size AS ahead FROM keyed)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
    CAST(passes * size + greatest(0, least(size, rest - ahead)) AS BIGINT) AS taken FROM placed"""

# crc32 bit by bit; near words by what is left when one code point goes.
SPELLING = rf"""
WITH RECURSIVE run AS (
    SELECT concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':') AS name, w, count(*) AS k
    FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) GROUP BY 1, 2),
bytes AS (SELECT w, k, flatten([CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END
    FOR c IN string_split(name || w, '')]) AS b FROM run),
hashed AS (SELECT w, k, xor(4294967295, list_reduce(list_prepend(4294967295, b),
    lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1))))) AS h FROM bytes),
spelled AS (SELECT CASE WHEN h % 199 = 0 THEN concat(left(w, CAST(h % length(w) AS BIGINT)), substring(w, CAST(h % length(w) AS BIGINT) + 2))
    ELSE w END AS word, k FROM hashed),
vocab AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spelled WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
less AS MATERIALIZED (SELECT word, n, i, concat(left(word, i - 1), substring(word, i + 1)) AS rest
    FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT less.word, vocab.word, vocab.n FROM less JOIN vocab ON less.rest = vocab.word
    UNION SELECT vocab.word, less.word, less.n FROM less JOIN vocab ON less.rest = vocab.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
    FROM vocab LEFT JOIN best USING (word)),
path AS (SELECT word, word AS root FROM formed
    UNION ALL SELECT path.word, form FROM path JOIN formed ON root = formed.word WHERE form IS NOT NULL)
SELECT formed.word, formed.form, root, formed.n, formed.n_near, formed.form_n
FROM formed JOIN path USING (word) JOIN formed AS last ON root = last.word WHERE last.form IS NULL"""

FILTER_AUDIT = rf"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, {_WORDS} AS w FROM documents),
least AS (SELECT text, min(doc_id) AS least FROM doc GROUP BY text),
marked AS (SELECT part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(least < doc_id, false)::INT AS bits,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
    FROM doc JOIN least USING (text)),
counted AS (SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM marked GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT concat(a.l, b.l, c.l, d.l, e.l) AS filter_order FROM letter a, letter b, letter c, letter d, letter e
    WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
step AS (SELECT filter_order, CAST(k AS INT) AS step, [(1 << (ascii(x) - 65)) FOR x IN string_split(filter_order, '')] AS every,
    every[k] AS bit, CAST(coalesce(list_sum(every[1:k - 1]), 0) AS INT) AS before FROM orders, range(1, 6) AS r(k)),
taken AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN bits & (bit | before) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN bits & bit > 0 AND bits & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN bits & bit > 0 AND bits & before > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN bits = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN bits & bit > 0 AND bits & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN bits & bit > 0 AND bits & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM counted, step GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM taken"""

ORACLE = {
    "op1_mixing": MIXING,
    "op2_quality": QUALITY,
    "op7_line_dedup": LINE_DEDUP,
    "op9_decontamination": DECONTAMINATION,
    "op11_spelling": SPELLING,
    "op12_filter_audit": FILTER_AUDIT,
}
