"""The registered query of each training-data operator, over whole tables, and its SQL where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm import chat_format, decontaminate, fill_middle, filter_audit, language_id, media, near_dup, ngram_lm, packing, storage, substring_dedup, token_frames, url_filter, warc_fixity

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
MIRROR_FAULT_EVERY = 97
SPECIAL_CONVERSATION = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.table(spark, sf_dir, "documents")
    manifest = token_frames.write_token_frames(docs, storage.new_dir(spark, "tokens"))
    return token_frames.read_token_frames(manifest)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(storage.table(spark, sf_dir, "documents"), storage.table(spark, sf_dir, "benchmark"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.stored_media(storage.table(spark, sf_dir, "documents"))
    return media.media_features(stored)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.cut_repeats(storage.table(spark, sf_dir, "documents")).drop("kept")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(language_id.held_out(F.col("doc_id")), F.lit(False)))
    model = language_id.fit(docs.where("not held_out"))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(storage.table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = storage.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(SPECIAL_CONVERSATION, turns.schema))
    return chat_format.audit_conversations(chat_format.formatted_table(turns))


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, let a mirror decay in the records of one page id of 97, and find those by the audit."""
    index, primary = warc_fixity.archive(storage.table(spark, sf_dir, "pages"))
    decayed = F.coalesce(F.pmod(F.col("page_id"), F.lit(MIRROR_FAULT_EVERY)) == 5, F.lit(False))
    mirror = warc_fixity.copy_with_faults(index, storage.new_dir(spark, "warc-mirror"), decayed)
    ours = warc_fixity.merkle_levels(warc_fixity.hash_records(index, primary), "primary")
    theirs = warc_fixity.merkle_levels(warc_fixity.hash_records(index, mirror), "mirror")
    return warc_fixity.audit(ours, theirs)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.match_urls(storage.table(spark, sf_dir, "pages"), rules)


def op10_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(storage.table(spark, sf_dir, "documents"))


def op11_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_texts(storage.table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(storage.table(spark, sf_dir, "documents"), storage.table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(storage.table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_frames": op1_token_frames,
    "op2_decontamination": op2_decontamination,
    "op3_media_columns": op3_media_columns,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_language_id": op5_language_id,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_chat_format": op7_chat_format,
    "op8_warc_fixity": op8_warc_fixity,
    "op9_url_filter": op9_url_filter,
    "op10_minhash_near_dup": op10_minhash_near_dup,
    "op11_ngram_lm": op11_ngram_lm,
    "op12_filter_audit": op12_filter_audit,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: Every order of the filters as rows of (filter_order, step, its bit, the bits before it).
_ORDERS = """
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        orders AS (
            SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
            WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
        steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders)"""

_CONTROLS = r"([\[<])(\\*/?(?:INST|OUT|SYS|ROLE:[^\[\]\n]*)\]|\\*/?s>|\\*/?SYS>>|\\*\|[a-z_]+\|>)"

ORACLE_SQL: dict[str, str] = {
    "op4_suffix_array_dedup": """
        WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
        grams AS (SELECT doc_id, k, b[k:k + 49] AS s FROM (SELECT doc_id, b, unnest(range(1, n - 48)) AS k FROM raw)),
        least AS (SELECT s, min(doc_id) AS m FROM grams GROUP BY s),
        hits AS (SELECT g.doc_id, g.k FROM grams g JOIN least l ON g.s = l.s WHERE g.doc_id > l.m),
        fresh AS (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 50 THEN 0 ELSE 1 END AS f FROM hits),
        numbered AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM fresh),
        runs AS (SELECT doc_id, min(k) AS a, max(k) + 49 AS z FROM numbered GROUP BY doc_id, run),
        gone AS (SELECT doc_id, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id),
        marks AS (SELECT doc_id, a, z FROM runs UNION ALL SELECT doc_id, n + 1, n + 1 FROM raw),
        pieces AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS p, a - 1 AS q FROM marks),
        kept AS (SELECT r.doc_id, string_agg(CASE WHEN q >= p THEN hex(r.b[p:q]) ELSE '' END, '' ORDER BY p) AS h FROM pieces JOIN raw r ON r.doc_id = pieces.doc_id GROUP BY r.doc_id)
        SELECT r.doc_id, r.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(h)) AS kept_sha256
        FROM raw r JOIN kept ON kept.doc_id = r.doc_id LEFT JOIN gone ON gone.doc_id = r.doc_id""",
    "op10_minhash_near_dup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM words WHERE len(w) > 0),
        shingles AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM places),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
        edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
        reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, e.y FROM reach r JOIN edges e ON r.other = e.x),
        least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d JOIN least ON id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id""",
    "op7_chat_format": rf"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        marked AS (
            SELECT *, regexp_replace(text, '{_CONTROLS}', '\1\\\2', 'g') AS stored,
                   CASE role WHEN 'user' THEN 4 WHEN 'assistant' THEN 3 WHEN 'system' THEN 3 ELSE 5 + length(role) END AS mark
            FROM turns)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(stored) + 2 * mark + 6) AS BIGINT) AS formatted_chars,
               CAST(sum(CASE WHEN stored <> text THEN 1 ELSE 0 END) AS BIGINT) AS escaped_turns
        FROM marked GROUP BY conv_id""",
    "op12_filter_audit": rf"""
        WITH {_ORDERS},
        texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        judged AS (
            SELECT doc_id, part,
                   CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                   || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END
                   || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
                   || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails FROM texts),
        labelled AS (SELECT part, fails, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS good, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS bad FROM judged LEFT JOIN labels ON labels.doc_id = judged.doc_id),
        counted AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM labelled GROUP BY part, fails),
        told AS (
            SELECT part, filter_order, step, fails, n, good, bad, contains(fails, filter_order[step]) AS fail,
                   length(translate(fails, filter_order[1:step - 1], '')) < length(fails) AS before FROM counted, steps),
        summed AS (
            SELECT part, filter_order, step, filter_order[step] AS f, CAST(sum(CASE WHEN fail OR before THEN 0 ELSE n END) AS BIGINT) AS kept,
                   CAST(sum(CASE WHEN fail AND NOT before THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN fail AND before THEN n ELSE 0 END) AS BIGINT) AS redundant,
                   CAST(sum(CASE WHEN fails = filter_order[step] THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
                   CAST(sum(CASE WHEN fail AND NOT before THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN fail AND NOT before THEN bad ELSE 0 END) AS BIGINT) AS toxic_lost
            FROM told GROUP BY part, filter_order, step)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM summed""",
    "op13_fill_in_middle": r"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        cut AS (
            SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
                   list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS d FROM texts),
        ranked AS (SELECT *, least(d[1] % (len(t) + 1), d[2] % (len(t) + 1)) AS a, greatest(d[1] % (len(t) + 1), d[2] % (len(t) + 1)) AS b FROM cut),
        parts AS (
            SELECT doc_id, text, CAST(len(t) AS BIGINT) AS n, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:], '') AS s,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM ranked)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
        FROM parts""",
    "op9_url_filter": """
        WITH cut AS (
            SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        judged AS (
            SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
                           WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
                           WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
                           WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged""",
}
