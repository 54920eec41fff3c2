"""The queries opN_<name> of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import align, bpe, decontaminate, html_text, language, licenses, lines, minhash, quality, quotes, repair, substring, urls
from hushframe.llm.common import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    try:
        found = minhash.groups(scratch, table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, percent=85)
        return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).checkpoint()
    finally:
        scratch.drop()


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(documents.where(language.not_held_out()))
    told = language.predict(documents.select("doc_id", "text"), model)
    return told.select("doc_id", (~language.not_held_out()).alias("held_out"), "lang_pred", "score", "rejected")


def op4_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    try:
        return quotes.thread(scratch, table(spark, sf_dir, "conversations")).checkpoint()
    finally:
        scratch.drop()


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "policy_version")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files /source/language/doc_id; licence files are those most of whose lines are statements."""
    documents = table(spark, sf_dir, "documents")
    folder = [F.coalesce(c, F.lit("")) for c in ("source", "lang")]
    files = documents.select("doc_id", F.concat_ws("/", F.lit(""), *folder, F.col("doc_id").cast("string")).alias("path"), "text")
    told = licenses.scan(files, license_file=None)
    return told.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "path", "license", "score", "origin", "license_dir")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    try:
        return decontaminate.leaks(scratch, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).checkpoint()
    finally:
        scratch.drop()


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scratch = Scratch(spark)
    try:
        gone = lines.dropped_lines(scratch, documents).checkpoint()
    finally:
        scratch.drop()
    counted = documents.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)))
    told = lines.without_lines(counted, gone, count="n_dropped")
    return told.select("doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"), "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    try:
        cut = substring.cut(scratch, table(spark, sf_dir, "documents").select("doc_id", "text"))
        return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")).checkpoint()
    finally:
        scratch.drop()


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    try:
        rows = repair.damaged(table(spark, sf_dir, "conversations"))
        told, repaired = repair.repair(scratch, rows)
        return repair.summary(scratch, rows, told, repaired).withColumnRenamed("conv", "conv_id").checkpoint()
    finally:
        scratch.drop()


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    try:
        aligned = align.align(table(spark, sf_dir, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model"))
        digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
        aligned = scratch.keep(aligned.withColumn("groups_sha256", digest).drop("groups"))
        told = align.scored(scratch, aligned, carry=("n_a", "n_b", "n_groups", "groups_sha256"))
        return told.checkpoint()
    finally:
        scratch.drop()


#: The rules of the query, by what they decide.
URL_BLOCKS = ("example.com/en/", "net/es/", "net/fr/")
URL_ALLOWS = ("com/", "www.example.com/en/")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    try:
        return urls.judge(scratch, table(spark, sf_dir, "pages"), urls.rule_table(spark, URL_BLOCKS, URL_ALLOWS)).checkpoint()
    finally:
        scratch.drop()


def queries() -> dict[str, Query]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_html_text": op2_html_text,
        "op3_language_id": op3_language_id,
        "op4_chat_quotes": op4_chat_quotes,
        "op5_quality_rules": op5_quality_rules,
        "op6_license_scan": op6_license_scan,
        "op7_decontamination": op7_decontamination,
        "op8_line_dedup": op8_line_dedup,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_bpe": op10_bpe,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_token_alignment": op12_token_alignment,
        "op13_url_filter": op13_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": OP5_SQL, "op9_substring_dedup": OP9_SQL, "op11_conversation_repair": OP11_SQL, "op13_url_filter": OP13_SQL}


#: Words, measures and rules again, from plain regular expressions and windows.
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM d),
wins AS (
  SELECT doc_id, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1 AS twice
  FROM wins WHERE w3 IS NOT NULL),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM twice, (VALUES (0), (1), (2)) AS t(k) WHERE twice GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters,
         length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
         length(regexp_replace(text, '[^0-9]', '', 'g'))::BIGINT AS n_digits,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
    + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (100 * n_upper > 30 * n_letters)::BIGINT
    + 16 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 32 * (100 * n_digits > 40 * word_chars)::BIGINT
    + 64 * (word_chars > 25 * n_words)::BIGINT + 128 * (word_chars < 2 * n_words)::BIGINT
    + 256 * (n_lines < 2)::BIGINT AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 255) = 0 AS kept, fail_bits, 'v1' AS policy_version
FROM f
"""

#: Every window as a string of 35 words, counted; covered words from the nearest repeated window before.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
wins AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM wins) WHERE n > 1),
marked AS (
  SELECT words.doc_id, words.i, word,
         max(twice.i) OVER (PARTITION BY words.doc_id ORDER BY words.i ROWS UNBOUNDED PRECEDING) AS near
  FROM words LEFT JOIN twice ON words.doc_id = twice.doc_id AND words.i = twice.i)
SELECT d.doc_id, len(any_value(w))::BIGINT AS n_words,
       count(*) FILTER (WHERE marked.i - near <= 34)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY marked.i) FILTER (WHERE near IS NULL OR marked.i - near > 34), '')) AS kept_sha256
FROM d LEFT JOIN marked ON d.doc_id = marked.doc_id GROUP BY d.doc_id
"""


def _price(best: str, cost: str, edit: str) -> str:
    """SQL: a cost of nine digits and its audit, with one edit more."""
    return f"(lpad(({best}[1:9]::BIGINT + {cost})::VARCHAR, 9, '0') || {best}[10:] || '{edit}')"


def _op11_sql() -> str:
    """Row by row, the least cost and audit of each state; the repaired rows from the audit alone."""
    insert = [_price(f"b[{i}]", "2", "I") for i in range(1, 5)]
    twice = [_price(_price(f"b[{i}]", "2", "I"), "2", "I") for i in (1, 2)]
    inserted = f"[b[1], b[2], least(b[3], {insert[0]}, {insert[1]}, {insert[3]}), least(b[4], {insert[2]}, {twice[0]}, {twice[1]})]"
    gone = [_price(f"b[{i}]", "3", "D") for i in range(1, 5)]
    keep = lambda best, role: f"CASE WHEN e.fault < 2 AND e.initial = '{role}' THEN {_price(best, 'e.fault', 'K')} ELSE 'Z' END"
    other = lambda best: f"CASE WHEN e.fault < 2 THEN {_price(best, '2 + e.fault', 'R')} ELSE 'Z' END"
    before_user = "least(b[1], b[2], b[4])"
    edited = f"[{gone[0]}, least({gone[1]}, {keep('b[1]', 's')}), least({gone[2]}, {keep(before_user, 'u')}, {other(before_user)}), least({gone[3]}, {keep('b[3]', 'a')}, {other('b[3]')})]"
    return r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
kinds AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_transform(string_split(name, ''), lambda ch: ascii(ch)::BIGINT),
                         lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS kind
  FROM named, crc),
rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, (VALUES (1), (2)) AS c(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM rows),
faults AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open,
         left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS pair
  FROM placed),
steps AS (
  SELECT conv_id, i, initial, CASE WHEN blank OR again THEN 2 WHEN open THEN 1 ELSE 0 END AS fault FROM faults
  UNION ALL SELECT conv_id, i - 0.5, 'I', 9 FROM faults
  UNION ALL SELECT conv_id, max(i) + 0.5, 'I', 9 FROM faults GROUP BY conv_id),
best AS (
  SELECT conv_id, list_reduce(list({'initial': initial, 'fault': fault} ORDER BY i), lambda b, e: CASE WHEN e.fault = 9 THEN INSERTED ELSE EDITED END,
                              ['000000000', '500000000', '500000000', '500000000']) AS b
  FROM steps GROUP BY conv_id),
audits AS (SELECT conv_id, least(b[1], b[4]) AS told, least(b[1], b[4])[10:] AS audit FROM best),
letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(1, len(audit) + 1)) AS p FROM audits WHERE audit <> ''),
edits AS (SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i FROM letters),
stays AS (
  SELECT e.conv_id, e.edit, e.p, f.role, f.text, f.initial, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.p) - 1 AS q
  FROM edits AS e LEFT JOIN faults AS f ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.i = f.i AND e.edit <> 'I' WHERE e.edit <> 'D'),
roles AS (
  SELECT *, (q - max(CASE WHEN q = 0 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id)) % 2 AS odd FROM stays),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN odd = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS body
  FROM roles GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE blank) AS blank,
         count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE open AND NOT blank AND NOT again) AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(told[1:9]::BIGINT, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS d
LEFT JOIN counts AS c ON d.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN audits AS a ON d.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN repaired AS r ON d.conv_id IS NOT DISTINCT FROM r.conv_id
""".replace("INSERTED", inserted).replace("EDITED", edited)


OP11_SQL = _op11_sql()

#: Every rule against every url; of those that fit, the longest.
OP13_SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         row_number() OVER () AS n FROM pages),
rules(host, path, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT n, r.host || r.path AS rule, verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM p JOIN rules AS r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM fits WHERE k = 1) AS f ON p.n = f.n
"""
