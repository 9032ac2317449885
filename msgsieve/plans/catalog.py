"""Every core query with its SQL twin: name -> (spark, folder) -> DataFrame, name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx, urls as ur
from ..operators import audit, dedup, eda, features, metrics, retrieval, similarity, splits
from ..operators.graph import connected_components
from ..session import materialize, spread, table
from ..sources import sinks
from ..streaming import stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "analyze_messages"


def query(sql: str | None = None):
    def add(f):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _c(spark, d):
    return table(spark, d, "combined")


def _scores(df: DataFrame) -> DataFrame:
    """A score that any engine can make: 24 bits of a hash, a little higher for scam rows."""
    h = F.conv(F.substring(F.md5(F.col("pos").cast("string")), 1, 4), 16, 10).cast("double") / 65536
    y = (F.col("label") == "scam").cast("int")
    return df.select("pos", "source", "label", "language", "split", "is_synthetic", y.alias("y"), F.round((F.floor(h * 50) / 50) + y * 0.2, 6).alias("score"))


SCORES = """scores AS (SELECT pos, source, label, language, split, is_synthetic, (label = 'scam')::INT AS y,
  round(floor(('0x' || substr(md5(pos::VARCHAR), 1, 4))::BIGINT::DOUBLE / 65536 * 50) / 50 + (label = 'scam')::INT * 0.2, 6) AS score FROM combined)"""
KEY = r"trim(regexp_replace(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), '\s+', ' ', 'g'))"


# ---------------------------------------------------------------- projections, filters, keys
@query("SELECT pos, CASE WHEN label = 'scam' THEN 1 ELSE 0 END::BIGINT AS y, substr(text, 1, 2000) AS model_text FROM combined")
def q_model_input(spark, d):
    return features.model_input(_c(spark, d)).select("pos", (F.col("label") == "scam").cast("long").alias("y"), "model_text")


@query("SELECT text, label, CASE WHEN label = 'scam' THEN 'unknown' ELSE 'none' END AS scam_type, 'en' AS language, 'demo' AS source, false AS is_synthetic, NULL::VARCHAR AS generator, 'unspecified' AS subtype FROM combined")
def q_make_messages(spark, d):
    return dedup.make_messages(_c(spark, d), "demo")


@query("""SELECT rule, count(*) AS rows, min(pos) AS first_key FROM (
  SELECT pos, 'blank_text' AS rule FROM combined WHERE text IS NULL OR trim(text) = '' UNION ALL SELECT pos, 'unknown_label' FROM combined WHERE label IS NULL OR label NOT IN ('scam', 'safe')
  UNION ALL SELECT pos, 'unknown_subtype' FROM combined WHERE subtype IS NULL OR subtype NOT IN ('unspecified', 'fraud', 'promo', 'service')
  UNION ALL SELECT pos, 'null_source' FROM combined WHERE source IS NULL UNION ALL SELECT pos, 'null_language' FROM combined WHERE language IS NULL) GROUP BY rule""")
def q_violations(spark, d):
    return dedup.violations(_c(spark, d))


@query("SELECT doc_id, trim(text, E' \\n\\t\\r') AS text FROM documents WHERE trim(text, E' \\n\\t\\r') <> '' AND length(trim(text, E' \\n\\t\\r')) <= 10000")
def q_length_filter(spark, d):
    return dedup.length_filter(table(spark, d, "documents").select("doc_id", "text"))


@query("SELECT pos, length(text_raw) AS chars FROM combined WHERE length(text_raw) <= 300")
def q_short_slice(spark, d):
    return _c(spark, d).where(F.length("text_raw") <= 300).select("pos", F.length("text_raw").cast("long").alias("chars"))


@query("SELECT pos, source FROM combined WHERE split = 'train' AND source <> 'hf_mail' UNION ALL SELECT pos, source FROM combined WHERE source = 'hf_mail' AND split = CASE WHEN is_synthetic THEN 'val' ELSE 'test' END")
def q_loso_frames(spark, d):
    train, held = features.leave_one_source_out(_c(spark, d), "hf_mail")
    return train.select("pos", "source").unionByName(held.select("pos", "source"))


@query("SELECT pos, substr(sha1(text), 1, 12) AS made FROM combined")
def q_make_id(spark, d):
    return _c(spark, d).select("pos", tx.make_id(F.col("text")).alias("made"))


@query(f"SELECT pos, {KEY} AS k FROM combined")
def q_dedup_key(spark, d):
    return _c(spark, d).select("pos", tx.dedup_key(F.col("text")).alias("k"))


@query("""SELECT pos, CASE WHEN contains(text, '<URL>') THEN 'link' WHEN length(text) <= 300 THEN 'short' WHEN source LIKE '%mail' AND length(text) > 1000 THEN 'long_mail' ELSE 'medium' END AS error_group FROM combined""")
def q_error_groups(spark, d):
    t = F.col("text")
    return _c(spark, d).select("pos", F.when(t.contains("<URL>"), "link").when(F.length(t) <= 300, "short").when(F.col("source").endswith("mail") & (F.length(t) > 1000), "long_mail").otherwise("medium").alias("error_group"))


# ---------------------------------------------------------------- text functions
@query()
def q_clean_and_mask(spark, d):
    c = spread(_c(spark, d).select("pos", "text_raw"))
    return c.select("pos", tx.preprocess_text(F.col("text_raw")).alias("masked"), tx.extract_urls(tx.clean_text(F.col("text_raw"))).alias("links"))


@query()
def q_normalize_text(spark, d):
    return spread(_c(spark, d).select("pos", "text_raw")).select("pos", tx.normalize_text(F.col("text_raw")).alias("normalized"), (tx.normalize_text(F.col("text_raw")) != F.col("text_raw")).alias("changed"))


@query("""SELECT coalesce(CASE WHEN regexp_matches(text, '^\\s*URL:\\s*https?://') AND contains(text, 'Date:') THEN 'web_crawl' END, CASE WHEN regexp_matches(text, '(?i)hourahead|schedule crawler') THEN 'pipeline_notice' END,
  CASE WHEN regexp_matches(text, '(?i)\\benron\\b|\\benronxgate\\b|\\bhpl\\b|/\\s*ect\\b|\\bect\\b|/\\s*hou\\s*/|\\bkaminski\\b|\\bvince j\\b') THEN 'internal_mail' END) AS reason, label, count(*) AS rows FROM combined GROUP BY ALL""")
def q_drop_reasons(spark, d):
    return _c(spark, d).groupBy(tx.drop_reason(F.col("text")).alias("reason"), "label").agg(F.count("*").alias("rows"))


@query()
def q_repair_latin1(spark, d):
    c = _c(spark, d).select("pos", "text_raw", tx.repair_latin1(F.col("text_raw")).alias("repaired"))
    return c.where("repaired <> text_raw").select("pos", "repaired")


@query()
def q_pii_kinds(spark, d):
    return _c(spark, d).select("pos", tx.pii_kinds(F.col("text_raw")).alias("kinds"), tx.placeholder_number(F.col("text_raw")).alias("placeholder"))


@query("SELECT phish_id, regexp_replace(CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://)', 1), '(?i)^http', 'hxxp') ELSE '' END, '$', '') || replace(regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?#]*', 0), '.', '[.]') || substr(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), length(regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?#]*', 0)) + 1) AS safe_url FROM blocklist")
def q_defang(spark, d):
    return table(spark, d, "blocklist").select("phish_id", tx.defang(F.col("url")).alias("safe_url"))


@query("SELECT pos, CASE WHEN length(text) <= 200 THEN text ELSE rtrim(substr(text, 1, 197)) || '...' END AS capped FROM combined")
def q_cap_length(spark, d):
    return _c(spark, d).select("pos", tx.cap_length(F.col("text"), 200).alias("capped"))


@query("SELECT event_id, round(1.0 / (1.0 + exp(-(value - 50) / 25)), 9) AS p FROM events")
def q_sigmoid(spark, d):
    return table(spark, d, "events").select("event_id", F.round(tx.sigmoid((F.col("value") - 50) / 25), 9).alias("p"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'peer' WHEN event_id % 3 = 1 THEN '10.0.0.' || (event_id % 7) ELSE '10.0.0.' || (event_id % 5) END AS client FROM events")
def q_client_key(spark, d):
    e = F.col("event_id")
    chain = F.when(e % 3 == 0, F.lit(None).cast("string")).when(e % 3 == 1, F.concat(F.lit("1.1.1.1 , 10.0.0."), (e % 7).cast("string"))).otherwise(F.concat(F.lit("10.0.0."), (e % 5).cast("string")))
    return table(spark, d, "events").select("event_id", tx.client_key(F.lit("peer"), chain, 1).alias("client"))


# ---------------------------------------------------------------- links
def _links(spark, d):
    return spread(_c(spark, d).select("pos", "urls")).select("pos", F.posexplode("urls").alias("n", "url"))


@query("""WITH l AS (SELECT pos, unnest(urls) AS url FROM combined) SELECT lower(regexp_replace(regexp_replace(regexp_extract(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?#]*', 0), '^.*@', ''), ':\\d*$', '')) AS host, count(*) AS rows FROM l GROUP BY 1""")
def q_hosts(spark, d):
    return ur.url_parts(_links(spark, d)).groupBy("host").agg(F.count("*").alias("rows"))


@query()
def q_score_urls(spark, d):
    return ur.score_urls(_links(spark, d), table(spark, d, "blocklist")).select("pos", "n", "url", F.round("score", 6).alias("score"), "band", "reasons")


@query("""WITH l AS (SELECT pos, unnest(urls) AS url FROM combined UNION ALL SELECT -phish_id, url || '/' FROM blocklist WHERE NOT contains(url, '?')), n AS (SELECT pos, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?#]*', 0)) || regexp_replace(regexp_extract(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?#]*([^?#]*)', 1), '/+$', '') AS k FROM l),
  b AS (SELECT DISTINCT lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?#]*', 0)) || regexp_replace(regexp_extract(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?#]*([^?#]*)', 1), '/+$', '') AS k FROM blocklist WHERE url IS NOT NULL)
  SELECT pos, count(*) AS listed FROM n SEMI JOIN b USING (k) GROUP BY pos""")
def q_blocklisted(spark, d):
    # The listed links themselves, written another way, show that the forms meet.
    listed = table(spark, d, "blocklist").where(~F.col("url").contains("?")).select((-F.col("phish_id")).alias("pos"), F.concat("url", F.lit("/")).alias("url"))
    l = _links(spark, d).select("pos", "url").unionByName(listed).withColumn("k", ur.normalized(F.col("url")))
    b = table(spark, d, "blocklist").where("url is not null").select(ur.normalized(F.col("url")).alias("k")).distinct()
    return l.join(b, "k", "left_semi").groupBy("pos").agg(F.count("*").alias("listed"))


@query()
def q_worst_band(spark, d):
    s = ur.score_urls(_links(spark, d)).groupBy("pos").agg(F.collect_list("band").alias("bands"))
    return _c(spark, d).select("pos").join(s, "pos", "left").select("pos", ur.worst_band(F.coalesce("bands", F.array().cast("array<string>"))).alias("worst"))


# ---------------------------------------------------------------- dedup, clusters, splits
@query(f"""WITH a AS (SELECT *, {KEY} AS k FROM combined), b AS (SELECT *, min(label) OVER (PARTITION BY k) <> max(label) OVER (PARTITION BY k) AS conflict, row_number() OVER (PARTITION BY k ORDER BY is_synthetic, pos) AS r FROM a)
  SELECT pos, label, source FROM b WHERE NOT conflict AND r = 1""")
def q_deduplicate(spark, d):
    return dedup.deduplicate(_c(spark, d)).select("pos", "label", "source")


@query(f"""WITH a AS (SELECT *, {KEY} AS k FROM combined), b AS (SELECT *, min(label) OVER (PARTITION BY k) <> max(label) OVER (PARTITION BY k) AS conflict, row_number() OVER (PARTITION BY k ORDER BY is_synthetic, pos) AS r FROM a)
  SELECT source, count(*) AS loaded, count(*) FILTER (conflict) AS conflict_rows, count(*) FILTER (NOT conflict AND r > 1) AS duplicates_removed, count(*) FILTER (NOT conflict AND r = 1) AS kept FROM b GROUP BY source""")
def q_dedup_report(spark, d):
    return dedup.dedup_report(_c(spark, d))


@query(f"""WITH d AS (SELECT split, is_synthetic, substr(sha1(text), 1, 12) AS id, {KEY} AS k FROM combined WHERE split IS NOT NULL)
  SELECT 'synthetic_in_test' AS "check", count(*) FILTER (split = 'test' AND is_synthetic) AS rows FROM d
  UNION ALL SELECT 'shared_ids', count(*) FROM (SELECT id FROM d GROUP BY id HAVING min(split) <> max(split)) UNION ALL SELECT 'shared_keys', count(*) FROM (SELECT k FROM d GROUP BY k HAVING min(split) <> max(split))""")
def q_integrity(spark, d):
    return dedup.integrity(_c(spark, d))


@query("SELECT pos, source, 0::BIGINT AS priority FROM combined WHERE NOT is_synthetic UNION ALL SELECT pos, source, 1 FROM combined WHERE is_synthetic")
def q_union_sources(spark, d):
    c = _c(spark, d)
    u = dedup.union_sources({"real": c.where("not is_synthetic"), "synthetic": c.where("is_synthetic")})
    return u.select("pos", "source", F.col("source_priority").cast("long").alias("priority"))


def _docs(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", "text")


_SIMILAR_SQL = r"""WITH t AS (SELECT doc_id AS doc, regexp_extract_all(regexp_replace(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), '\p{Nd}+', '0', 'g'), '[\p{L}\p{N}_][\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
  g AS (SELECT doc, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t), f AS (SELECT doc, term, count(*) AS tf FROM g GROUP BY ALL),
  d AS (SELECT term, ln((1 + (SELECT count(*) FROM t))::DOUBLE / (1 + count(*))) + 1 AS idf FROM f GROUP BY term), x AS (SELECT doc, term, (1 + ln(tf)) * idf AS x FROM f JOIN d USING (term)),
  v AS (SELECT doc, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc)) AS w FROM x)
  SELECT a.doc AS i, b.doc AS j, round(sum(a.w * b.w), 6) AS sim FROM v a JOIN v b ON a.term = b.term AND a.doc < b.doc GROUP BY ALL HAVING sum(a.w * b.w) >= 0.8 - 1e-12"""


@query(_SIMILAR_SQL)
def q_similar_pairs(spark, d):
    return similarity.similar_pairs(_docs(spark, d), "doc_id", "text", 0.8).select("i", "j", F.round("sim", 6).alias("sim"))


@query()
def q_trim_cross_split(spark, d):
    kept, _ = similarity.trim_cross_split(_c(spark, d).where("split is not null").select("pos", "text", "split"))
    return kept.groupBy("split").agg(F.count("*").alias("rows"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS a, user_id + 1000000 + (value::BIGINT % 40) AS b FROM events WHERE value IS NOT NULL), n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  r AS (SELECT a AS node, a AS root FROM n UNION SELECT n.b, r.root FROM r JOIN n ON r.node = n.a)
  SELECT node, min(root) AS component FROM r GROUP BY node""")
def q_connected_components(spark, d):
    e = table(spark, d, "events").where("value is not null").select(F.col("user_id").alias("a"), (F.col("user_id") + 1000000 + F.pmod(F.bround("value").cast("long"), F.lit(40))).alias("b"))
    return connected_components(e)


@query("SELECT pos, ((row_number() OVER (PARTITION BY label ORDER BY md5('folds:' || pos)) - 1) % 5)::BIGINT AS fold FROM combined")
def q_folds(spark, d):
    return splits.folds(_c(spark, d)).select("pos", F.col("fold").cast("long").alias("fold"))


@query("SELECT pos, source, label FROM (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY md5('sample:' || pos)) AS r FROM combined) WHERE r <= 15")
def q_sample_per_group(spark, d):
    return splits.sample_per_group(_c(spark, d), 15, ["source", "label"]).select("pos", "source", "label")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY label, language ORDER BY md5('robin:' || pos)) AS turn FROM combined WHERE language IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY turn, language) AS q FROM a) SELECT pos, label, language FROM b WHERE q <= 30""")
def q_round_robin_sample(spark, d):
    return splits.round_robin_sample(_c(spark, d).where("language is not null"), 60).select("pos", "label", "language")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY md5('review:' || row_id)) <= CASE WHEN action IN ('flip', 'remove') THEN 10 ELSE 10 END AS f FROM audit_decisions), b AS (SELECT *, row_number() OVER (ORDER BY f DESC, md5('review:' || row_id)) AS q FROM a) SELECT row_id, action FROM b WHERE q <= 30""")
def q_quota_sample(spark, d):
    return splits.quota_sample(table(spark, d, "audit_decisions"), "action", 30).select("row_id", "action")


# ---------------------------------------------------------------- statistics
@query("SELECT l.label, count(c.label) AS rows, count(c.label)::DOUBLE / (SELECT count(*) FROM combined) AS share FROM (VALUES ('safe'), ('scam')) l(label) LEFT JOIN combined c ON c.label = l.label GROUP BY l.label")
def q_class_counts(spark, d):
    return eda.class_counts(_c(spark, d))


@query("SELECT source, count(*) AS rows, count(*) FILTER (label = 'scam') AS scam_rows, avg(is_synthetic::INT::DOUBLE) AS synthetic_share, avg((label = 'scam')::INT::DOUBLE) AS scam_rate FROM combined GROUP BY source")
def q_scam_rate_by_source(spark, d):
    return eda.scam_rate_by_source(_c(spark, d))


@query("SELECT source, label, count(*) AS rows, round(quantile_cont(length(text_raw), 0.5), 1) AS median, round(avg(length(text_raw)), 1) AS mean, round(quantile_cont(length(text_raw), 0.95), 1) AS p95, max(length(text_raw)) AS max FROM combined GROUP BY ALL")
def q_length_stats(spark, d):
    return eda.length_stats(_c(spark, d))


@query("SELECT language, count(*) FILTER (label = 'safe') AS safe, count(*) FILTER (label = 'scam') AS scam, count(*) AS total FROM combined GROUP BY language")
def q_language_counts(spark, d):
    return eda.language_counts(_c(spark, d))


@query("SELECT label, avg(contains(text, '<URL>')::INT::DOUBLE) AS url_rate, avg(contains(text, '<OTP>')::INT::DOUBLE) AS otp_rate, avg(contains(text, '<PHONE>')::INT::DOUBLE) AS phone_rate FROM combined GROUP BY label")
def q_masked_token_rates(spark, d):
    return eda.masked_token_rates(_c(spark, d))


_STOPS = ", ".join(f"'{w}'" for w in eda.STOP_WORDS)


@query(f"""WITH w AS (SELECT label, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{{3,}}'))) AS word FROM combined), g AS (SELECT word, count(*) FILTER (label = 'scam') AS scam_df, count(*) FILTER (label = 'safe') AS safe_df FROM w WHERE word NOT IN ({_STOPS}) GROUP BY word),
  n AS (SELECT count(*) FILTER (label = 'scam') AS ns, count(*) FILTER (label = 'safe') AS nf FROM combined),
  o AS (SELECT word, scam_df, safe_df, round(ln((scam_df + 0.5::DOUBLE) / (ns - scam_df + 0.5::DOUBLE)) - ln((safe_df + 0.5::DOUBLE) / (nf - safe_df + 0.5::DOUBLE)), 9) AS log_odds FROM g, n WHERE scam_df + safe_df >= 5)
  (SELECT 'scam' AS side, word, log_odds, scam_df, safe_df FROM o ORDER BY log_odds DESC, word LIMIT 20) UNION ALL (SELECT 'safe', word, log_odds, scam_df, safe_df FROM o ORDER BY log_odds, word LIMIT 20)""")
def q_top_words(spark, d):
    return eda.top_words(_c(spark, d))


@query("""SELECT field, value, count(*) AS rows FROM (SELECT unnest(['source', 'label', 'language', 'scam_type', 'is_synthetic', 'generator']) AS field, unnest([source, label, language, scam_type, is_synthetic::VARCHAR, generator]) AS value FROM combined) GROUP BY ALL""")
def q_summary(spark, d):
    return eda.summary(_c(spark, d))


@query("SELECT split, count(*) AS rows, count(*) FILTER (label = 'scam') AS scam, count(*) FILTER (label = 'safe') AS safe, count(DISTINCT source) AS sources, count(*) FILTER (is_synthetic) AS synthetic FROM combined GROUP BY split")
def q_split_report(spark, d):
    return eda.split_report(_c(spark, d))


@query("SELECT max(c)::DOUBLE / sum(c)::DOUBLE AS majority_share FROM (SELECT count(*) AS c FROM combined GROUP BY source)")
def q_majority_share(spark, d):
    return eda.majority_share(_c(spark, d))


@query("""WITH h AS (SELECT source, label, least(floor(log10(greatest(length(text_raw), 1)::DOUBLE) / (5.0::DOUBLE / 35)), 34)::BIGINT AS bin FROM combined), g AS (SELECT source, label, bin, count(*) AS rows FROM h GROUP BY ALL)
  SELECT source, label, bin, rows, round(rows::DOUBLE / sum(rows) OVER (PARTITION BY source, label)::DOUBLE / (5.0::DOUBLE / 35), 9) AS density FROM g""")
def q_length_histogram(spark, d):
    return eda.length_histogram(_c(spark, d)).select("source", "label", F.col("bin").cast("long").alias("bin"), "rows", F.round("density", 9).alias("density"))


@query("""WITH b AS (SELECT batch_key, min_by({p: provider, m: model, l: label, n: len(messages)}, (created_at, batch_no)) AS x FROM synthetic_batches GROUP BY batch_key), g AS (SELECT x.p || '/' || x.m AS generator, x.l AS label, sum(x.n)::BIGINT AS messages FROM b GROUP BY ALL)
  SELECT generator, label, messages, round(messages::DOUBLE / sum(messages) OVER ()::DOUBLE, 9) AS share FROM g""")
def q_batch_progress(spark, d):
    return eda.batch_progress(table(spark, d, "synthetic_batches")).withColumn("share", F.round("share", 9))


# ---------------------------------------------------------------- metrics
_CONF = """count(*) AS n, count(*) FILTER (y = 1) AS n_scam, count(*) FILTER (y = 1 AND score >= 0.6) AS tp, count(*) FILTER (y = 0 AND score >= 0.6) AS fp, count(*) FILTER (y = 1 AND score < 0.6) AS fn, count(*) FILTER (y = 0 AND score < 0.6) AS tn"""
_PRF = """round(tp::DOUBLE / (tp + fp), 9) AS precision, round(tp::DOUBLE / n_scam, 9) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 9) AS f1"""


def _rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 9))
    return df


@query(f"WITH {SCORES}, c AS (SELECT {_CONF} FROM scores) SELECT n, n_scam, tp, fp, fn, tn, {_PRF} FROM c")
def q_confusion(spark, d):
    return _rounded(metrics.confusion(_scores(_c(spark, d)), 0.6), "precision", "recall", "f1")


_AUC = """auc AS (SELECT source, sum(p * (coalesce(below, 0) + (c - p) / 2.0::DOUBLE)) / (sum(p) * sum(c - p))::DOUBLE AS roc_auc FROM (SELECT *, sum(c - p) OVER (PARTITION BY source ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM s) GROUP BY source)"""
_AP = """ap AS (SELECT source, sum(p * tp::DOUBLE / flagged) / max(np)::DOUBLE AS average_precision FROM (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS flagged, sum(p) OVER (PARTITION BY source) AS np FROM s WINDOW w AS (PARTITION BY source ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY source)"""


@query(f"WITH {SCORES}, s AS (SELECT source, score, sum(y) AS p, count(*) AS c FROM scores GROUP BY ALL), {_AUC}, {_AP}, c AS (SELECT source, {_CONF} FROM scores GROUP BY source) SELECT source, n, n_scam, tp, fp, fn, tn, {_PRF}, round(roc_auc, 9) AS roc_auc, round(average_precision, 9) AS average_precision FROM c JOIN auc USING (source) JOIN ap USING (source)")
def q_group_metrics(spark, d):
    return _rounded(metrics.group_metrics(_scores(_c(spark, d)), "source", 0.6), "precision", "recall", "f1", "roc_auc", "average_precision")


_CURVE = f"""{SCORES}, s AS (SELECT score, sum(y) AS p, count(*) AS c FROM scores GROUP BY score), k AS (SELECT score, sum(p) OVER w AS tp, sum(c) OVER w AS flagged, sum(p) OVER () AS np, sum(c) OVER () AS n, lead(score) OVER (ORDER BY score DESC) AS low FROM s WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"WITH {_CURVE} SELECT score, tp::BIGINT AS tp, flagged::BIGINT AS flagged, round(tp::DOUBLE / flagged::DOUBLE, 9) AS precision, round(tp::DOUBLE / np::DOUBLE, 9) AS recall, low AS next_lower FROM k")
def q_pr_curve(spark, d):
    c = metrics.curve(_scores(_c(spark, d)))
    return _rounded(c.select("score", "tp", "flagged", "precision", "recall", "next_lower"), "precision", "recall")


@query(f"WITH {_CURVE} SELECT round(coalesce((score + low) / 2, score), 9) AS threshold, round(2.0::DOUBLE * tp::DOUBLE / (flagged + np)::DOUBLE, 9) AS f1 FROM k ORDER BY 2.0::DOUBLE * tp::DOUBLE / (flagged + np)::DOUBLE DESC, score DESC LIMIT 1")
def q_best_f1_threshold(spark, d):
    return _rounded(metrics.best_f1_threshold(_scores(_c(spark, d))), "threshold", "f1")


@query(f"""WITH {_CURVE}, t AS (SELECT * FROM (VALUES (0.9::DOUBLE), (0.95::DOUBLE), (0.97::DOUBLE)) v(target)), r AS (SELECT target, coalesce((score + low) / 2, score) AS threshold, tp::DOUBLE / flagged::DOUBLE AS precision, tp::DOUBLE / np::DOUBLE AS recall, flagged::DOUBLE / n::DOUBLE AS flag_rate, row_number() OVER (PARTITION BY target ORDER BY score DESC) AS q FROM k, t WHERE tp >= ceil(target * np::DOUBLE - 1e-9))
  SELECT target, round(threshold, 9) AS threshold, round(precision, 9) AS precision, round(recall, 9) AS recall, round(flag_rate, 9) AS flag_rate FROM r WHERE q = 1""")
def q_operating_points(spark, d):
    return _rounded(metrics.operating_points(_scores(_c(spark, d)), [0.9, 0.95, 0.97]), "threshold", "precision", "recall", "flag_rate")


@query(f"WITH {SCORES} SELECT source, count(*) AS rows, round(avg((score >= 0.7)::INT::DOUBLE), 9) AS flag_rate FROM scores GROUP BY ROLLUP(source)")
def q_flag_rates(spark, d):
    return _rounded(metrics.flag_rates(_scores(_c(spark, d)), 0.7), "flag_rate")


@query("WITH c AS (SELECT pos, count(*) OVER (PARTITION BY source, label) AS cell FROM combined) SELECT pos, round((SELECT count(*) FROM combined)::DOUBLE / ((SELECT count(*) FROM (SELECT DISTINCT source, label FROM combined)) * cell), 9) AS weight FROM c")
def q_cell_weights(spark, d):
    return _rounded(metrics.cell_weights(_c(spark, d)).select("pos", "weight"), "weight")


@query()
def q_bootstrap(spark, d):
    return metrics.bootstrap(_scores(_c(spark, d)), 0.6, 1_000)


@query()
def q_paired_bootstrap(spark, d):
    s = _scores(_c(spark, d)).withColumn("other", F.col("score") * 0.9)
    return metrics.paired_bootstrap(s, "score", "other", 0.6, 0.6, 1_000)


# ---------------------------------------------------------------- audit and feedback joins
@query("""WITH j AS (SELECT c.pos, c.label AS original_label, CASE WHEN NOT c.is_synthetic THEN 'real' ELSE coalesce(a.action, 'unreviewed') END AS action FROM combined c LEFT JOIN audit_decisions a ON c.is_synthetic AND a.row_id = substr(sha1(c.text_raw), 1, 12) AND a.action IN ('keep', 'flip', 'remove'))
  SELECT pos, original_label, action, CASE WHEN action = 'flip' THEN CASE WHEN original_label = 'scam' THEN 'safe' ELSE 'scam' END ELSE original_label END AS label FROM j WHERE action <> 'remove'""")
def q_apply_decisions(spark, d):
    return audit.apply_decisions(_c(spark, d), table(spark, d, "audit_decisions")).select("pos", "original_label", "action", "label")


@query("""WITH j AS (SELECT c.label, coalesce(a.action, 'unreviewed') AS action FROM combined c LEFT JOIN audit_decisions a ON a.row_id = substr(sha1(c.text_raw), 1, 12) WHERE c.is_synthetic)
  SELECT label, count(*) FILTER (action = 'keep') AS keep, count(*) FILTER (action = 'flip') AS flip, count(*) FILTER (action = 'remove') AS remove, count(*) FILTER (action = 'unreviewed') AS unreviewed FROM j GROUP BY label""")
def q_decision_summary(spark, d):
    return audit.decision_summary(_c(spark, d), table(spark, d, "audit_decisions"))


@query("""SELECT 'unknown_action' AS problem, count(*) FILTER (action IS NULL OR action NOT IN ('keep', 'flip', 'remove')) AS rows FROM audit_decisions
  UNION ALL SELECT 'unknown_id', count(*) FROM audit_decisions ANTI JOIN (SELECT substr(sha1(text_raw), 1, 12) AS row_id FROM combined WHERE is_synthetic) USING (row_id)
  UNION ALL SELECT 'duplicate_id', count(*) FROM (SELECT row_id FROM audit_decisions GROUP BY row_id HAVING count(*) > 1)""")
def q_decision_problems(spark, d):
    known = _c(spark, d).where("is_synthetic").select(audit.row_id(F.col("text_raw")).alias("row_id"))
    return audit.decision_problems(table(spark, d, "audit_decisions"), known)


@query("WITH o AS (SELECT row_id, 'remove' AS action FROM audit_decisions WHERE action = 'flip') SELECT row_id, coalesce(o.action, a.action) AS action FROM audit_decisions a LEFT JOIN o USING (row_id)")
def q_merge_overrides(spark, d):
    a = table(spark, d, "audit_decisions").select("row_id", "action")
    return audit.merge_overrides(a, a.where("action = 'flip'").withColumn("action", F.lit("remove")))


@query("WITH l AS (SELECT id FROM feedback WHERE id % 3 <> 0), r AS (SELECT id FROM feedback WHERE id % 4 <> 0) SELECT count(*) AS keys, count(*) FILTER (l.id IS NULL) AS only_right, count(*) FILTER (r.id IS NULL) AS only_left FROM l FULL JOIN r ON l.id = r.id")
def q_paired(spark, d):
    f = table(spark, d, "feedback")
    return audit.paired(f.where("id % 3 <> 0"), f.where("id % 4 <> 0"), "id")


@query("SELECT count(*) AS n, count(*) FILTER (f.user_verdict = g.predicted_verdict) AS agree, avg((f.user_verdict = g.predicted_verdict)::INT::DOUBLE) AS agreement FROM feedback f JOIN feedback g USING (id)")
def q_agreement(spark, d):
    f = table(spark, d, "feedback")
    return audit.agreement(f.select(F.col("id").alias("row_id"), "user_verdict"), f.select(F.col("id").alias("row_id"), "predicted_verdict"), "user_verdict", "predicted_verdict")


@query(r"""WITH m AS (SELECT batch_key, created_at, batch_no, unnest(messages) AS message, unnest(range(len(messages))) AS i FROM synthetic_batches), k AS (SELECT *, length(trim(coalesce(message, ''))) NOT BETWEEN 15 AND 700 AS bad, trim(regexp_replace(replace(replace(lower(coalesce(message, '')), 'ß', 'ss'), 'ς', 'σ'), '\s+', ' ', 'g')) AS k FROM m),
  r AS (SELECT *, row_number() OVER (PARTITION BY k, bad ORDER BY created_at, batch_no, batch_key, i) AS r FROM k) SELECT CASE WHEN bad THEN 'length' WHEN r > 1 THEN 'duplicate' END AS reason, count(*) AS rows FROM r GROUP BY 1""")
def q_load_batches(spark, d):
    return audit.load_batches(table(spark, d, "synthetic_batches")).groupBy("reason").agg(F.count("*").alias("rows"))


@query("SELECT batch_key, label FROM synthetic_batches ANTI JOIN (SELECT batch_key FROM synthetic_batches WHERE batch_no % 2 = 0) USING (batch_key)")
def q_pending(spark, d):
    b = table(spark, d, "synthetic_batches")
    return audit.pending(b, b.where("batch_no % 2 = 0")).select("batch_key", "label")


@query("SELECT id, prediction_id, user_verdict FROM (SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY created_at DESC, id DESC) AS r FROM feedback) WHERE r = 1")
def q_latest_feedback(spark, d):
    return audit.latest_feedback(table(spark, d, "feedback")).select("id", "prediction_id", "user_verdict")


@query("WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY created_at DESC, id DESC) AS r FROM feedback) WHERE r = 1) SELECT predicted_verdict, count(*) AS rows, round(avg((user_verdict = predicted_verdict)::INT::DOUBLE) * 100, 1) AS agree_pct FROM l GROUP BY predicted_verdict")
def q_feedback_agreement(spark, d):
    return audit.feedback_agreement(table(spark, d, "feedback"))


@query("SELECT k.id, k.name, k.category, count(f.id) AS rows FROM knowledge_base k LEFT JOIN feedback f ON f.matched_pattern = k.id GROUP BY ALL")
def q_pattern_lookup(spark, d):
    return audit.pattern_lookup(table(spark, d, "feedback"), table(spark, d, "knowledge_base"))


@query("SELECT p.event_id AS prediction, f.event_id AS feedback, p.user_id FROM events p JOIN events f ON p.user_id = f.user_id AND f.ts >= p.ts AND f.ts < p.ts + INTERVAL 24 HOURS WHERE p.event_type = 'view' AND f.event_type = 'click'")
def q_enrich_feedback(spark, d):
    e = table(spark, d, "events")
    return audit.enrich_feedback(e.where("event_type = 'view'"), e.where("event_type = 'click'"))


# ---------------------------------------------------------------- retrieval
@query("SELECT id, array_to_string(list_concat(list_concat([name], coalesce(typical_phrases, [])), [how_it_works]), E'\\n') AS document FROM knowledge_base")
def q_compose_documents(spark, d):
    return retrieval.compose_documents(table(spark, d, "knowledge_base"))


# ---------------------------------------------------------------- features and scoring
@query()
def q_top_weights(spark, d):
    c = features.model_input(_c(spark, d)).where("split = 'train'")
    vocabulary = materialize(features.fit_vocabulary(c), "vocabulary")
    return features.top_weights(features.fit_centroids(features.transform(c, vocabulary), c)).withColumn("weight", F.round("weight", 9))


# ---------------------------------------------------------------- sinks, packs, streams
@query("SELECT id, text, label, source, language, is_synthetic, subtype, split, length(text_raw) AS raw_chars FROM combined")
def q_pack(spark, d):
    return sinks.pack(_c(spark, d))


@query("""SELECT 'unknown_label' AS problem, count(*) FILTER (label NOT IN ('scam', 'safe')) AS rows FROM combined UNION ALL SELECT 'blank_text', count(*) FILTER (trim(coalesce(text, '')) = '') FROM combined
  UNION ALL SELECT 'text_in_two_splits', count(*) FROM (SELECT text FROM combined WHERE split IS NOT NULL GROUP BY text HAVING min(split) <> max(split))""")
def q_pack_problems(spark, d):
    return sinks.pack_problems(sinks.pack(_c(spark, d)))


@query("SELECT id, prediction_id, user_verdict FROM (SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY arrived_at DESC, (id % 2) DESC) AS r FROM feedback) WHERE r = 1")
def q_upsert(spark, d):
    f = table(spark, d, "feedback").select("id", "prediction_id", "user_verdict", "arrived_at")
    return sinks.upsert(f.where("id % 2 = 0"), f.where("id % 2 = 1"), "prediction_id", "arrived_at").select("id", "prediction_id", "user_verdict")


@query("SELECT l.event_id AS lookup, max_by(p.event_id, (p.ts, p.event_id)) AS prediction FROM events l JOIN events p ON l.user_id = p.user_id AND p.ts <= l.ts AND l.ts < p.ts + INTERVAL 24 HOURS WHERE l.event_type = 'click' AND p.event_type = 'view' GROUP BY l.event_id")
def q_cached_predictions(spark, d):
    e = table(spark, d, "events")
    return stateful.cached_predictions(e.where("event_type = 'view'"), e.where("event_type = 'click'"))


@query("SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def q_windowed_counts(spark, d):
    return stateful.windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total", 6))


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS brk FROM events), b AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS "end", count(*) AS n FROM b GROUP BY user_id, s""")
def q_sessions(spark, d):
    return stateful.sessions(table(spark, d, "events"))
