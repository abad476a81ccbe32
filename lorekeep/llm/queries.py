"""The operators' registered queries over the whole tables, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import (
    conversation_repair, decontaminate, filter_audit, html_extraction, importance, license_scan, line_dedup, lm_scoring, packing, quality_rules, simhash, token_counts,
    url_filters,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, vocabulary()).drop("text")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed_lines", F.length("text").cast("long").alias("n_chars_left"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.verdicts(quality_rules.recorded(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_digits", "fail_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every rule of every policy rejects alone, from one stored ledger."""
    ledger = quality_rules.recorded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = [quality_rules.ablations(ledger, policy) for policy in quality_rules.POLICIES]
    return reduce(DataFrame.unionByName, found)


#: The rules of the contract, as host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.rules_frame(spark, URL_RULES))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audits(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_quality_classifier, op3_token_counts, op4_line_dedup, op5_quality_rules, op6_lm_scoring, op7_simhash,
        op8_url_filters, op9_decontamination, op10_license_scan, op11_filter_audit, op12_html_extraction, op13_conversation_repair, quality_ablations,
    )
}

SQL = {
    "op9_decontamination": r"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
bw AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
items AS (SELECT item_id, least(13, len(w)) AS n, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM items),
sizes AS (SELECT DISTINCT n FROM wins),
pos AS (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n),
hits AS (SELECT DISTINCT rid, i, pos.n, item_id FROM pos JOIN wins ON wins.n = pos.n AND wins.win = array_to_string(w[i:i + pos.n - 1], ' ')),
marked AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
owners AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN marked USING (rid) LEFT JOIN owners USING (rid)
""",
    "op5_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM documents),
win AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
named AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM win),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM named) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines, CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS BIGINT) AS n_digits
  FROM d LEFT JOIN rep USING (rid)),
b AS (SELECT *, CAST(
  CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN n_words > 1000000 THEN 4 ELSE 0 END
  + CASE WHEN 2 * word_chars < 5 * n_words THEN 8 ELSE 0 END + CASE WHEN word_chars > 12 * n_words THEN 16 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 32 ELSE 0 END
  + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 64 ELSE 0 END + CASE WHEN 5 * n_digits > word_chars THEN 128 ELSE 0 END AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, n_digits, fail_bits FROM b
""",
    "op8_url_filters": r"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rule_host, rule_path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hit AS (SELECT rid, rule_host || rule_path AS rule, r.verdict, row_number() OVER (PARTITION BY rid ORDER BY length(rule_host || rule_path) DESC) AS nth
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM hit WHERE nth = 1) USING (rid)
""",
}
SQL["op11_filter_audit"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
f AS (SELECT part, doc_id, len(w) < 100 AS "A", 100 * len(list_distinct(w)) < 80 * len(w) AS "B",
  100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 10 * length(x) AS "C", regexp_matches(x, '[#$%&*|]') AS "D", coalesce(least < doc_id, false) AS "E",
  EXISTS (SELECT 1 FROM labels AS l WHERE l.doc_id = d.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels AS l WHERE l.doc_id = d.doc_id AND toxic = 1) AS toxic FROM d),
masks AS (SELECT part, concat(CASE WHEN "A" THEN 'A' ELSE '' END, CASE WHEN "B" THEN 'B' ELSE '' END, CASE WHEN "C" THEN 'C' ELSE '' END, CASE WHEN "D" THEN 'D' ELSE '' END,
  CASE WHEN "E" THEN 'E' ELSE '' END) AS fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS filter,
  sum(CASE WHEN contains(fails, substr(filter_order, step, 1)) AND translate(fails, substr(filter_order, 1, step - 1), '') = fails THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN contains(fails, substr(filter_order, step, 1)) AND translate(fails, substr(filter_order, 1, step - 1), '') = fails THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN contains(fails, substr(filter_order, step, 1)) AND translate(fails, substr(filter_order, 1, step - 1), '') = fails THEN toxic ELSE 0 END) AS toxic_lost,
  sum(CASE WHEN translate(fails, substr(filter_order, 1, step), '') = fails THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN contains(fails, substr(filter_order, step, 1)) THEN n ELSE 0 END) AS failing,
  sum(CASE WHEN fails = substr(filter_order, step, 1) THEN n ELSE 0 END) AS unique_fails
  FROM masks, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(failing - removed AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM s
"""


def more(edits: str, cost: int, letters: str) -> str:
    """Edits (a struct of cost c and audit a, or null) with more at their end."""
    return f"CASE WHEN {edits} IS NOT NULL THEN {{'c': {edits}.c + {cost}, 'a': {edits}.a || '{letters}'}} END"


#: A recursion over the rows of all conversations at once: p0 to p3 are the least (cost, audit) in each state, insertions made.
SQL["op13_conversation_repair"] = (
    r"""
WITH RECURSIVE r0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS name FROM conversations),
names AS (SELECT DISTINCT name FROM r0),
crc AS (SELECT name, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(name[i]) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS kind FROM names),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM r0 JOIN crc USING (name)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS ink FROM d),
f AS (SELECT *, left(role, 1) AS ini, CASE WHEN ink = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
m AS (SELECT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS k FROM (SELECT DISTINCT conv_id FROM conversations)),
e AS (SELECT m.k, f.* EXCLUDE (conv_id) FROM f JOIN m ON f.conv_id IS NOT DISTINCT FROM m.conv_id),
s AS (SELECT k, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY k),
"""
    + f"""walk AS (SELECT k, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': ''}} AS p0, NULL::STRUCT(c BIGINT, a VARCHAR) AS p1, {{'c': 2::BIGINT, 'a': 'I'}} AS p2, {{'c': 4::BIGINT, 'a': 'II'}} AS p3 FROM m
UNION ALL SELECT k, i, b0, b1, least(b2, {more('b0',2,'I')}, {more('b1',2,'I')}, {more('b3',2,'I')}), least(b3, {more('b2',2,'I')}, {more('b0',4,'II')}, {more('b1',4,'II')})
FROM (SELECT k, i, {more('p0',3,'D')} AS b0,
 least({more('p1',3,'D')}, CASE WHEN live AND ini = 's' THEN {{'c': p0.c + cut, 'a': p0.a || 'K'}} END) AS b1,
 least({more('p2',3,'D')}, CASE WHEN live AND ini = 'u' THEN {{'c': u.c + cut, 'a': u.a || 'K'}} END, CASE WHEN live THEN {{'c': u.c + 2 + cut, 'a': u.a || 'R'}} END) AS b2,
 least({more('p3',3,'D')}, CASE WHEN live AND ini = 'a' THEN {{'c': p2.c + cut, 'a': p2.a || 'K'}} END, CASE WHEN live THEN {{'c': p2.c + 2 + cut, 'a': p2.a || 'R'}} END) AS b3
 FROM (SELECT walk.k, e.i, p0, p1, p2, p3, least(p0, p1, p3) AS u, fault IN ('k', 't') AS live, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS cut, ini FROM walk JOIN e ON e.k = walk.k AND e.i = walk.i + 1))),
best AS (SELECT k, b.c AS cost, b.a AS audit FROM (SELECT walk.k, least(p0, p3) AS b FROM walk LEFT JOIN s USING (k) WHERE walk.i = coalesce(s.n, 0))),
edits AS (SELECT k, pos, audit[pos] AS edit, length(translate(left(audit, pos), 'I', '')) AS i, length(translate(left(audit, pos), 'D', '')) AS place, length(translate(audit, 'D', '')) % 2 AS odd
  FROM (SELECT k, audit, unnest(range(1, length(audit) + 1)) AS pos FROM best)),
said AS (SELECT edits.k, string_agg(concat(CASE WHEN edit = 'K' THEN role WHEN (place - 1 - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END, ':', CASE WHEN edit = 'I' THEN '' ELSE text END), chr(10) ORDER BY pos) AS repaired
  FROM edits LEFT JOIN e ON e.k = edits.k AND e.i = edits.i AND edit <> 'I' WHERE edit <> 'D' GROUP BY edits.k)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit,
  sha256(coalesce(repaired, '')) AS repaired_sha256 FROM m JOIN best USING (k) LEFT JOIN s USING (k) LEFT JOIN said USING (k)
"""
)
LEDGER = SQL["op5_quality_rules"].rpartition("SELECT doc_id")[0].rstrip()
SQL["quality_ablations"] = LEDGER + """,
p(policy, version, mask) AS (VALUES ('base', 1, 3), ('web', 1, 127), ('web', 2, 255), ('web', 3, 251)),
r(bit, rule) AS (VALUES (0, 'few_words'), (1, 'repeated_words'), (2, 'many_words'), (3, 'short_words'), (4, 'long_words'), (5, 'symbols'), (6, 'duplicate_lines'), (7, 'digits'))
SELECT policy, version, rule, count(*) AS n_rows, count(*) FILTER (WHERE (fail_bits >> bit) & 1 = 1) AS failed, count(*) FILTER (WHERE fail_bits & mask = 1 << bit) AS "only",
  count(*) FILTER (WHERE fail_bits & mask = 0) AS kept, count(*) FILTER (WHERE fail_bits & mask = 0 OR fail_bits & mask = 1 << bit) AS kept_without
FROM b, p, r GROUP BY policy, version, rule
"""
