"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import crc_mod, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.decontamination import with_contamination

    return with_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm import quality_rules as q

    ledger = q.stored_ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept_by = F.concat_ws(",", *(F.when(q.passes("rule_bits", p), F.lit(p)) for p in q.POLICIES))
    return ledger.select("*", (~q.passes("rule_bits", "base-1")).alias("base_failed"), q.passes("rule_bits", "strict-1").alias("kept"), F.lit("strict-1").alias("policy"), kept_by.alias("kept_by"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.language_id import learn, with_language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(crc_mod("doc_id", 4) != 2))
    out, c = with_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), F.col(f"{c}.lang").alias("lang_pred"), F.col(f"{c}.score").alias("score"), F.col(f"{c}.rejected").alias("rejected"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a directory for each source, language and thousand of ids."""
    from pairloom.llm.license_scan import licence_scan

    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.expr("CAST(doc_id DIV 1000 AS STRING)"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = table(spark, sf_dir, "documents").select(path.alias("path"), "text")
    return licence_scan(files).drop("text_hash")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Labelled rows that the toxicity model is fitted on at most, chosen by the hashes of their ids.
MAX_LABELLED_ROWS = 50_000


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str, max_rows: int = MAX_LABELLED_ROWS):
    """Learned from labelled rows outside the held-out third: all, or a sample of ``max_rows`` of them where there are more.

    The sample's ids and labels are at most ``max_rows`` small rows, so they are broadcast and no text is shuffled.
    """
    from pairloom.llm.toxicity import learn

    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), "toxic").where("toxic IS NOT NULL")
    labels = labels.where(crc_mod("label_id", 3) != 1)
    n = labels.count()
    if n > max_rows:  # a share that leaves room for chance; the limit only guards against ids that are repeated many times
        labels = labels.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 40)) < int(0.95 * max_rows / n * (1 << 40)))
    sample = labels.limit(max_rows)
    learned = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    return learn(learned, "text", "toxic")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.toxicity import with_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, score = with_toxicity(docs, toxicity_model(spark, docs, sf_dir))
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), F.col(score).alias("score"), (F.col(score) >= 0.7).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.mixing import mixed

    # the size is taken before the mixture, so that no text is shuffled for it
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    return mixed(docs).select("doc_id", "source", "n_bytes", "mix_block", "mix_start", "mix_slot")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.html_extraction import with_main_text

    out, text = with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col(text).alias("text"), F.length(text).cast("long").alias("n_chars"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pairloom.llm.token_counts import with_token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, c = with_token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", f"{c}.n_bytes", f"{c}.n_tokens", f"{c}.over_limit")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairloom.llm.warc import archive_round_trip

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return archive_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS win
       FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

OP2_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
g AS (SELECT doc_id, i, ws[i] || chr(32) || ws[i + 1] || chr(32) || ws[i + 2] AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n >= 2) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
    CAST(length(regexp_replace(text, '[^\p{L}\p{M}]', '', 'g')) AS BIGINT) AS n_letters,
    CAST(length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS BIGINT) AS n_upper
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (
  SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 4 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN n_letters > 0 AND 2 * n_upper > n_letters THEN 8 ELSE 0 END)
    + (CASE WHEN n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines THEN 16 ELSE 0 END) + (CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN word_chars > 20 * n_words THEN 64 ELSE 0 END) + (CASE WHEN 2 * n_letters < word_chars THEN 128 ELSE 0 END) AS BIGINT) AS rule_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_letters, n_upper, rule_bits,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, rule_bits = 0 AS kept, 'strict-1' AS policy,
  concat_ws(',', CASE WHEN rule_bits & 3 = 0 THEN 'base-1' END, CASE WHEN rule_bits & 31 = 0 THEN 'form-1' END, CASE WHEN rule_bits & 255 = 0 THEN 'strict-1' END) AS kept_by
FROM b
"""

OP10_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS hex FROM p),
g AS (SELECT hex AS ghex, min(page_id) AS first_id FROM h GROUP BY hex)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM h JOIN g ON hex = ghex
"""

def _op4_sql() -> str:
    """All vectors are worked out here from the templates' and the files' texts."""
    from pairloom.llm import license_scan as s

    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH notice(template, licence, body) AS (VALUES {", ".join(f"({k}, '{x}', '{t.replace(chr(39), chr(39) * 2)}')" for k, (x, t) in enumerate(s.TEMPLATES))}),
nt AS (SELECT template, licence, term, count(*) AS n FROM (SELECT template, licence, unnest(regexp_extract_all({fold.format("body")}, '{s.TERM}')) AS term FROM notice) GROUP BY ALL),
f AS (SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || CAST(doc_id // 1000 AS VARCHAR) AS place,
        CAST(doc_id AS VARCHAR) || '.txt' AS name, {fold.format("text")} AS body FROM documents),
held AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(body, '{s.TERM}')) AS term FROM f),
df AS (SELECT term, count(doc_id) AS n FROM (SELECT DISTINCT term FROM nt) LEFT JOIN held USING (term) GROUP BY term),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + n AS DOUBLE)) + 1 AS idf FROM df),
tw AS (SELECT template, licence, nt.term, nt.n * idf AS w FROM nt JOIN idf ON nt.term = idf.term),
tv AS (SELECT template, licence, term, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS part FROM tw),
bare AS (SELECT doc_id, string_split(body, chr(10)) AS ls, body FROM f WHERE body IS NOT NULL),
u AS (SELECT doc_id, 0 AS kind, unnest(regexp_split_to_array(body, '{s.UNIT_END}')) AS unit FROM bare
  UNION ALL SELECT doc_id, 1, unnest(regexp_split_to_array(body, '{s.BLOCK_END}')) FROM bare
  UNION ALL SELECT doc_id, 1, array_to_string(ls[i:i + 1], ' ') FROM (SELECT doc_id, ls, unnest(range(1, len(ls))) AS i FROM bare)
  UNION ALL SELECT doc_id, 1, array_to_string(ls[i:i + 2], ' ') FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM bare)
  UNION ALL SELECT doc_id, 2, body FROM bare),
t AS (SELECT unit, term, count(*) AS n FROM (SELECT unit, unnest(regexp_extract_all(unit, '{s.TERM}')) AS term FROM (SELECT DISTINCT unit FROM u)) GROUP BY unit, term),
w AS (SELECT unit, t.term, n * coalesce(idf, (SELECT avg(idf) FROM idf)) AS w FROM t LEFT JOIN idf ON t.term = idf.term),
norms AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM w GROUP BY unit),
dots AS (SELECT unit, template, licence, sum(w * part) AS dot FROM w JOIN tv ON w.term = tv.term GROUP BY unit, template, licence),
sc AS (SELECT dots.unit, licence, round(dot / norm, 6) AS score FROM dots JOIN norms ON dots.unit = norms.unit),
m AS (SELECT unit, licence, score FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, licence) AS r FROM sc WHERE score >= {s.THRESHOLD}) WHERE r = 1),
h AS (SELECT doc_id, kind, licence, score, len(regexp_extract_all(u.unit, '[^ 	-
]+')) AS words FROM u JOIN m ON u.unit = m.unit),
b AS (SELECT doc_id, licence AS own_licence, score AS own_score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) AS r FROM h) WHERE r = 1),
q AS (SELECT doc_id, sum(CASE WHEN kind = 0 THEN words ELSE 0 END) AS words, max(kind) AS widest FROM h GROUP BY doc_id),
o AS (SELECT b.doc_id, place, name, own_licence, own_score, widest = 2 OR 2 * words >= len(regexp_extract_all(body, '[^ 	-
]+')) AS is_licence_file
      FROM b JOIN q ON b.doc_id = q.doc_id JOIN f ON b.doc_id = f.doc_id),
d AS (SELECT place AS dir, own_licence AS dir_licence FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY own_score DESC, own_licence, place || '/' || name) AS r FROM o WHERE is_licence_file) WHERE r = 1)
SELECT f.place || '/' || f.name AS path, own_licence, own_score, coalesce(is_licence_file, false) AS is_licence_file,
  coalesce(own_licence, dir_licence) AS licence, CASE WHEN own_licence IS NULL THEN dir END AS inherited_from
FROM f LEFT JOIN o ON f.doc_id = o.doc_id LEFT JOIN d ON f.place = d.dir
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_rules": op2_quality_rules,
    "op3_language_id": op3_language_id,
    "op4_license_scan": op4_license_scan,
    "op5_ngram_join": op5_ngram_join,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_html_extraction": op8_html_extraction,
    "op9_token_counts": op9_token_counts,
    "op10_warc": op10_warc,
}

ORACLES: dict[str, str] = {"op1_decontamination": OP1_SQL, "op2_quality_rules": OP2_SQL, "op4_license_scan": _op4_sql(), "op10_warc": OP10_SQL}
