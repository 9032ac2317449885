"""Further core queries and their DuckDB twins: verdicts, levels, review, protocol, language checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import styles, text as tx, urls as ur
from ..operators import audit, eda, features, levels, metrics, protocol, retrieval, similarity, triage, verdict
from ..operators import splits as sp
from ..session import materialize, table
from ..sources import sinks
from ..streaming import stateful
from . import catalog, pipeline
from .catalog import FLAGSHIP, QUERIES, SCORES, _c, _links, _rounded, _scores, query

# Classes of characters as Java's word boundaries see them.
_W = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}"
_S = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


# ---------------------------------------------------------------- whole-table text functions
@query(rf"""SELECT pos, regexp_replace(regexp_replace(text_raw, '(^|[^{_W}])(199\p{{Nd}}|200\p{{Nd}}|2010)($|[^{_W}])', '\1<YEAR>\3', 'g'), '(^|[^{_W}])(199\p{{Nd}}|200\p{{Nd}}|2010)($|[^{_W}])', '\1<YEAR>\3', 'g') AS t FROM combined""")
def q_mask_years(spark, d):
    return _c(spark, d).select("pos", tx.mask_years(F.col("text_raw")).alias("t"))


@query(rf"""SELECT pos, regexp_replace(regexp_replace(text_raw, '(£|€|₹|\$)(\p{{Nd}})', '<CUR> \2', 'g'), '(?i)(^|[^{_W}])(?:rs\.?{_S}?|inr{_S}?)(\p{{Nd}})', '\1<CUR> \2', 'g') AS t FROM combined""")
def q_normalize_currency(spark, d):
    return _c(spark, d).select("pos", tx.normalize_currency(F.col("text_raw")).alias("t"))


def _tags(words: list[str], need: str = "2") -> str:
    """Language tags in SQL: letters and marks only, then counts per script block; ties to the script seen first."""
    blocks = tx.SCRIPT_BLOCKS.items()
    n = ", ".join(f"len(regexp_extract_all(marks, '[{b}]')) AS n_{t}, length(regexp_extract(marks, '^[^{b}]*', 0)) AS f_{t}" for t, b in blocks)
    rank = ", ".join(f"{{'n': -n_{t}, 'f': f_{t}, 't': '{t}'}}" for t, _ in blocks)
    known = ", ".join(f"'{w}'" for w in words)
    return f"""a AS (SELECT pos, text, regexp_replace(text, '[^\\p{{L}}\\p{{M}}]', '', 'g') AS marks, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), [{known}])) AS hits,
      len(regexp_extract_all(lower(text), '[a-z]+')) AS words, len(regexp_extract_all(text, '[A-Za-z]')) AS plain FROM combined), b AS (SELECT *, length(marks) AS letters, {n} FROM a), c AS (SELECT *, list_sort([{rank}])[1] AS best FROM b),
      tags AS (SELECT pos, CASE WHEN letters > 0 AND best.n < 0 AND -best.n::DOUBLE / letters >= 0.2 THEN best.t WHEN letters > 0 AND plain::DOUBLE / letters < 0.5 THEN 'other' WHEN hits >= {need} THEN 'hinglish_guess' ELSE 'en' END AS tag FROM c)"""


@query(f"WITH {_tags(tx.HINGLISH)} SELECT pos, tag FROM tags")
def q_detect_language(spark, d):
    return _c(spark, d).select("pos", tx.detect_language(F.col("text")).alias("tag"))


@query(f"""WITH {_tags(tx.HINGLISH_MORE, '2 + (words > 60)::INT')}, plain AS (SELECT * FROM tags) SELECT pos, CASE tag WHEN 'hi' THEN 'hi' WHEN 'hinglish_guess' THEN 'hinglish' ELSE 'en' END AS output_language FROM plain""")
def q_output_language(spark, d):
    return _c(spark, d).select("pos", tx.output_language(F.col("text")).alias("output_language"))


# Words of Marathi and Bengali in Latin letters that mark a mixed style.
_MARKERS = {"mr_en": ("hi", "aahe ahe tumhi tumchya tumcha kara karun mala tula kay kasa aata pahije aani nako".split()), "bn_en": ("bn", "ache achhe apnar apnake apni korun korte hobe ekhon jonno bhalo dorkar".split())}


@query(f"""WITH {_tags(tx.HINGLISH)}, x AS (SELECT t.pos, t.tag, c.text, l.language FROM tags t JOIN combined c USING (pos), (VALUES ('hi'), ('hinglish'), ('en'), ('mr_en'), ('bn_en'), ('xx')) l(language))
  SELECT pos, language, CASE language WHEN 'hi' THEN tag = 'hi' WHEN 'hinglish' THEN tag <> 'hi' WHEN 'en' THEN tag IN ('en', 'hinglish_guess')
    WHEN 'mr_en' THEN tag = 'hi' OR len(list_intersect(regexp_extract_all(lower(text), '[a-z]+'), [{", ".join(f"'{w}'" for w in _MARKERS["mr_en"][1])}])) > 0
    WHEN 'bn_en' THEN tag = 'bn' OR len(list_intersect(regexp_extract_all(lower(text), '[a-z]+'), [{", ".join(f"'{w}'" for w in _MARKERS["bn_en"][1])}])) > 0 ELSE true END AS matches FROM x""")
def q_language_matches(spark, d):
    asked = F.explode(F.array(*map(F.lit, ["hi", "hinglish", "en", "mr_en", "bn_en", "xx"])))
    return _c(spark, d).select("pos", "text", asked.alias("language")).select("pos", "language", styles.language_matches(F.col("text"), F.col("language"), _MARKERS).alias("matches"))


@query()
def q_spam_subtypes(spark, d):
    return _c(spark, d).where("label = 'scam'").groupBy("source", styles.spam_subtype(F.col("text_raw")).alias("subtype")).agg(F.count("*").alias("rows"))


# ---------------------------------------------------------------- verdicts
_SETTLED = f"""{SCORES}, bands AS (SELECT pos, ('0x' || substr(md5('band:' || pos), 1, 1))::BIGINT % 4 AS b FROM combined),
  settled AS (SELECT s.pos, CASE WHEN score >= 0.6 AND (score >= 0.8 OR b >= 2) THEN ['scam', 'high'] WHEN score >= 0.6 THEN ['scam', 'medium'] WHEN b = 3 THEN ['suspicious', 'high'] WHEN b = 2 THEN ['suspicious', 'medium'] ELSE ['safe', 'low'] END AS v FROM scores s JOIN bands USING (pos))"""


def _settled(spark, d):
    b = F.element_at(F.array(*map(F.lit, ["none", "low", "medium", "high"])), (F.conv(F.substring(F.md5(F.concat(F.lit("band:"), F.col("pos").cast("string"))), 1, 1), 16, 10).cast("int") % 4) + 1)
    s = _scores(_c(spark, d))
    return s.select("pos", verdict.verdict(F.col("score") >= 0.6, F.col("score"), b).alias("v")).select("pos", "v.verdict", "v.risk_level")


@query(f"WITH {_SETTLED} SELECT pos, v[1] AS verdict, v[2] AS risk_level FROM settled")
def q_verdicts(spark, d):
    return _settled(spark, d)


def _sentence_sql() -> str:
    out = "CASE"
    for lang, by in verdict.SENTENCES.items():
        for v, s in by.items():
            end = "।" if lang == "hi" else "."
            out += f" WHEN language = '{lang}' AND verdict = '{v}' THEN '{s}' || coalesce(' (' || name || '){end}', '{end}')"
    return out + " END"


_ADVICE_SQL = " ".join(f"WHEN '{v}' THEN [{', '.join(repr(a) for a in items)}]" for v, items in verdict.ADVICE.items())


@query(f"""WITH f AS (SELECT id, user_verdict AS verdict, CASE WHEN id % 3 = 0 THEN 'hi' WHEN id % 3 = 1 THEN 'hinglish' ELSE 'en' END AS language, matched_pattern AS pattern_id, CASE WHEN id % 2 = 0 THEN [input_type] ELSE [] END AS reasons FROM (SELECT * REPLACE (CASE WHEN user_verdict IN ('scam', 'safe', 'suspicious') THEN user_verdict ELSE 'suspicious' END AS user_verdict) FROM feedback)),
  j AS (SELECT f.*, k.name, k.red_flags, k.what_to_do FROM f LEFT JOIN knowledge_base k ON k.id = f.pattern_id)
  SELECT id, {_sentence_sql()} AS explanation, array_to_string(list_concat(reasons, coalesce(red_flags, [])), '|') AS red_flags, array_to_string(CASE WHEN coalesce(what_to_do, '') <> '' THEN [what_to_do] ELSE CASE verdict {_ADVICE_SQL} END END, '|') AS what_to_do, CASE WHEN name IS NOT NULL THEN pattern_id END AS matched_pattern FROM j""")
def q_explanations(spark, d):
    i = F.col("id")
    v = F.when(F.col("user_verdict").isin("scam", "safe", "suspicious"), F.col("user_verdict")).otherwise("suspicious")
    rows = table(spark, d, "feedback").select("id", v.alias("verdict"), F.when(i % 3 == 0, "hi").when(i % 3 == 1, "hinglish").otherwise("en").alias("language"), F.col("matched_pattern").alias("pattern_id"),
                                              F.when(i % 2 == 0, F.array("input_type")).otherwise(F.array().cast("array<string>")).alias("reasons"))
    e = verdict.explain(rows, table(spark, d, "knowledge_base"), "id")
    return e.select("id", "explanation", F.array_join("red_flags", "|").alias("red_flags"), F.array_join("what_to_do", "|").alias("what_to_do"), "matched_pattern")


@query()
def q_finalized_replies(spark, d):
    """Free-form replies (here the messages themselves) can change no verdict; their texts are masked and cut."""
    replies = _c(spark, d).select("pos", F.col("text_raw").alias("explanation"), F.array(F.col("text_raw")).alias("red_flags"), F.coalesce("urls", F.array().cast("array<string>")).alias("what_to_do"))
    return verdict.finalize(replies, _settled(spark, d).withColumn("matched_pattern", F.lit(None).cast("string")))


@query("SELECT event_type, CASE WHEN NOT coalesce(bool_or(c = 0 AND value >= 10), false) THEN 'unavailable' WHEN coalesce(bool_or(c = 1 AND value >= 10), false) AND coalesce(bool_or(c = 2 AND value >= 10), false) THEN 'ok' ELSE 'degraded' END AS status FROM (SELECT *, user_id % 3 AS c FROM events) GROUP BY event_type")
def q_readiness(spark, d):
    e = table(spark, d, "events").select("event_type", F.element_at(F.array(F.lit("classifier"), F.lit("rag"), F.lit("ocr")), (F.col("user_id") % 3 + 1).cast("int")).alias("component"), (F.col("value") >= 10).alias("ready"))
    out = None
    for kind in [r[0] for r in e.select("event_type").distinct().collect()]:
        row = verdict.readiness(e.where(F.col("event_type") == kind)).select(F.lit(kind).alias("event_type"), "status")
        out = row if out is None else out.unionByName(row)
    return out


# ---------------------------------------------------------------- levels
_LEGIT = "(source IN (SELECT source FROM combined WHERE subtype IN ('promo', 'service')) AND label = 'scam' AND subtype IN ('promo', 'service'))"


def _sources(spark, d) -> list[str]:
    """Corpora whose promotions were told apart; as many as corpora were merged."""
    return sorted(r[0] for r in _c(spark, d).where("subtype in ('promo', 'service')").select("source").distinct().collect())


@query(f"""WITH r AS (SELECT pos, CASE WHEN is_synthetic AND label = 'scam' THEN 'fraud' ELSE coalesce(subtype, 'unspecified') END AS subtype, source, label FROM combined WHERE split IS NOT NULL), b AS (SELECT *, coalesce({_LEGIT}, false) AS benchmark FROM r)
  SELECT pos, benchmark, false AS withheld, CASE WHEN benchmark THEN 'safe' ELSE label END AS label FROM b""")
def q_policy_relabel(spark, d):
    return levels.apply_policy(levels.reference_rows(_c(spark, d)), "A", _sources(spark, d)).select("pos", "benchmark", "withheld", "label")


@query(f"""WITH r AS (SELECT *, coalesce({_LEGIT} AND NOT is_synthetic, false) AS benchmark FROM combined WHERE split IS NOT NULL)
  SELECT split, count(*) FILTER (NOT benchmark) AS training, count(*) FILTER (NOT is_synthetic AND NOT benchmark) AS selection FROM r GROUP BY split""")
def q_policy_rows(spark, d):
    df = levels.apply_policy(levels.reference_rows(_c(spark, d)), "D", _sources(spark, d))
    a = levels.training_rows(df).groupBy("split").agg(F.count("*").alias("training"))
    return a.join(levels.selection_rows(df).groupBy("split").agg(F.count("*").alias("selection")), "split", "full").na.fill(0)


_L1 = """a AS (SELECT c.*, coalesce(d.action, 'unreviewed') AS action FROM combined c LEFT JOIN (SELECT * FROM audit_decisions WHERE action IN ('keep', 'flip', 'remove')) d ON c.is_synthetic AND d.row_id = substr(sha1(c.text_raw), 1, 12) WHERE c.split IS NOT NULL),
  l AS (SELECT split, source, CASE WHEN action = 'flip' THEN CASE label WHEN 'scam' THEN 'safe' ELSE 'scam' END ELSE label END AS label, is_synthetic,
    coalesce(label = 'scam' AND CASE WHEN action = 'flip' THEN 'unspecified' WHEN is_synthetic AND label = 'scam' THEN 'fraud' ELSE subtype END IN ('promo', 'service') AND source IN (SELECT source FROM combined WHERE subtype IN ('promo', 'service')), false) AS benchmark FROM a WHERE action <> 'remove')"""


@query(f"""WITH {_L1}, p AS (SELECT split, unnest(['rows', 'label', 'source', 'withheld', 'benchmark']) AS field, unnest(['all', label, source, 'false', benchmark::VARCHAR]) AS value FROM l) SELECT split, field, value, count(*) AS rows FROM p GROUP BY ALL""")
def q_level_audited(spark, d):
    df = levels.build_level("L1", levels.reference_rows(_c(spark, d)), None, table(spark, d, "audit_decisions"), _sources(spark, d))
    return levels.describe(df)


@query()
def q_level_normalized(spark, d):
    """The level with audited labels, policy D and normalised text; further rows are those without a split."""
    c = _c(spark, d)
    more = sp.stratified_split(sp.strata(c.where("split is null").drop("split").withColumn("original_label", F.col("label"))), real_only_test=False).drop("stratum")
    df = levels.build_level("L3", levels.reference_rows(c), more, table(spark, d, "audit_decisions"), _sources(spark, d))
    return df.groupBy("split", "label").agg(F.count("*").alias("rows"), F.count_if("withheld").alias("withheld"))


@query()
def q_new_source(spark, d):
    """Rows without a split as a further source beside those with one."""
    c = _c(spark, d)
    kept, counts = levels.new_source(c.where("split is null"), c.where("split is not null"))
    return counts


@query("""WITH g AS (SELECT source AS level, count(*) % 5 AS fingerprints, round(avg((label = 'scam')::INT::DOUBLE), 6) AS signal_share, row_number() OVER (ORDER BY source) AS place FROM combined GROUP BY source),
  r AS (SELECT *, place % 4 = 0 AS passed, place % 3 AS side FROM g), q AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY passed DESC, CASE WHEN passed THEN place ELSE fingerprints END, CASE WHEN passed THEN 0 ELSE -signal_share END, place) AS n, bool_or(passed) OVER (PARTITION BY side) AS criterion_met FROM r)
  SELECT side, level AS chosen, criterion_met FROM q WHERE n = 1""")
def q_choose_level(spark, d):
    from pyspark.sql import Window

    g = _c(spark, d).groupBy(F.col("source").alias("level")).agg((F.count("*") % 5).alias("fingerprints"), F.round(F.avg((F.col("label") == "scam").cast("int").cast("double")), 6).alias("signal_share"))
    g = g.withColumn("place", F.row_number().over(Window.orderBy("level")).cast("long")).withColumn("passed", F.col("place") % 4 == 0)
    out = None
    for side in range(3):
        row = levels.choose_level(g.where(F.col("place") % 3 == side)).select(F.lit(side).cast("long").alias("side"), "chosen", "criterion_met")
        out = row if out is None else out.unionByName(row)
    return out


@query("""SELECT 'loaded' AS step, count(*) AS rows FROM combined UNION ALL SELECT 'blank', count(*) FILTER (trim(coalesce(text, '')) = '') FROM combined
  UNION ALL SELECT 'conflict', coalesce(sum(c), 0)::BIGINT FROM (SELECT count(*) AS c FROM combined GROUP BY """ + catalog.KEY + """ HAVING min(label) <> max(label)) UNION ALL SELECT 'copies', coalesce(sum(c - 1), 0)::BIGINT FROM (SELECT count(*) AS c FROM combined GROUP BY """ + catalog.KEY + """ HAVING min(label) = max(label))
  UNION ALL SELECT 'kept', count(*) FROM (SELECT 1 FROM combined GROUP BY """ + catalog.KEY + " HAVING min(label) = max(label))")
def q_dedup_funnel(spark, d):
    """Rows lost per step: one aggregation by key, combined before the shuffle."""
    c = _c(spark, d)
    per = c.groupBy(tx.dedup_key(F.col("text"))).agg(F.count("*").alias("c"), (F.min("label") != F.max("label")).alias("x"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("b"))
    s = per.agg(F.sum("c").alias("l"), F.sum("b").alias("b"), F.sum(F.when(F.col("x"), F.col("c")).otherwise(0)).alias("x"), F.sum(F.when(~F.col("x"), F.col("c") - 1).otherwise(0)).alias("d"), F.count_if(~F.col("x")).alias("k"))
    return s.select(F.expr("stack(5, 'loaded', l, 'blank', b, 'conflict', x, 'copies', d, 'kept', k) as (step, rows)"))


# ---------------------------------------------------------------- review
@query()
def q_triage(spark, d):
    c = _c(spark, d).where("is_synthetic").select(audit.row_id(F.col("text_raw")).alias("row_id"), "text", "label").dropDuplicates(["row_id"])
    s = materialize(protocol.oof_scores(c, F.substring("text", 1, 2_000), key="row_id"), "oof")
    judged = table(spark, d, "audit_decisions").select("row_id", F.col("action").alias("verdict"), F.lit(1).alias("seq"))
    return triage.build_triage(c, triage.latest_judgements(judged), s, 50).groupBy("reasons").agg(F.count("*").alias("rows"))


@query("SELECT prediction_id AS row_id, max_by(user_verdict, (created_at, id)) AS judge FROM feedback GROUP BY prediction_id")
def q_latest_judgements(spark, d):
    f = table(spark, d, "feedback").select(F.col("prediction_id").alias("row_id"), F.col("user_verdict").alias("verdict"), F.struct("created_at", "id").alias("seq"))
    return triage.latest_judgements(f)


@query()
def q_annotation_problems(spark, d):
    c = _c(spark, d)
    rows = c.select("text", "label", "scam_type", "language", F.when(F.col("source").contains("mail"), "email").otherwise("sms").alias("channel"), F.col("source").alias("collected_from"), F.lit("").alias("notes"), (F.col("pos") + 2).alias("line"))
    return triage.annotation_problems(rows).groupBy("severity", "problem").agg(F.count("*").alias("rows"))


@query("""WITH d AS (SELECT row_id, action FROM audit_decisions), c AS (SELECT c.*, coalesce(d.action, 'unreviewed') AS action FROM combined c LEFT JOIN d ON d.row_id = substr(sha1(c.text_raw), 1, 12) WHERE c.is_synthetic)
  SELECT 'generator' AS field, generator AS value, label, count(*) AS rows FROM c GROUP BY ALL UNION ALL SELECT 'scam_type', scam_type, label, count(*) FROM c GROUP BY ALL UNION ALL SELECT 'action', action, label, count(*) FROM c GROUP BY ALL""")
def q_card_counts(spark, d):
    """What a dataset card states of the synthetic rows, counted in one pass."""
    c = _c(spark, d).where("is_synthetic").withColumn("row_id", audit.row_id(F.col("text_raw"))).join(table(spark, d, "audit_decisions").select("row_id", "action"), "row_id", "left")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in (("generator", F.col("generator")), ("scam_type", F.col("scam_type")), ("action", F.coalesce("action", F.lit("unreviewed"))))])
    return c.select("label", F.explode(pairs).alias("p")).groupBy("p.field", "p.value", "label").agg(F.count("*").alias("rows"))


@query("SELECT label, min(length(text)) AS least, round(quantile_cont(length(text), 0.5), 1) AS median, round(avg(length(text)), 1) AS mean, max(length(text)) AS most FROM combined WHERE is_synthetic GROUP BY label")
def q_card_lengths(spark, d):
    n = F.length("text")
    return _c(spark, d).where("is_synthetic").groupBy("label").agg(F.min(n).cast("long").alias("least"), F.round(F.percentile(n, 0.5), 1).alias("median"), F.round(F.avg(n), 1).alias("mean"), F.max(n).cast("long").alias("most"))


@query("""SELECT language, label, source, count(*) AS rows FROM combined GROUP BY GROUPING SETS ((language, label), (language, source), (source, label))""")
def q_cross_tabs(spark, d):
    c = _c(spark, d).select("language", "label", "source")
    sets = [("language", "label"), ("language", "source"), ("source", "label")]
    out = None
    for s in sets:
        row = c.groupBy(*s).agg(F.count("*").alias("rows")).select(*[F.col(x) if x in s else F.lit(None).cast("string").alias(x) for x in ("language", "label", "source")], "rows")
        out = row if out is None else out.unionByName(row)
    return out


# ---------------------------------------------------------------- protocol
@query(f"WITH {SCORES}, o AS (SELECT *, score * 0.9 AS score_out FROM scores) SELECT source, CASE WHEN label = 'safe' AND language = 'en' THEN 'promo_service' ELSE 'other' END AS \"group\", count(*) AS n, round(avg((score > 0.6)::INT::DOUBLE), 9) AS trained_on, round(avg((score_out > 0.6)::INT::DOUBLE), 9) AS held_out FROM o GROUP BY 1, 2")
def q_shortcut_check(spark, d):
    s = _scores(_c(spark, d)).withColumn("score_in", F.col("score")).withColumn("score_out", F.col("score") * 0.9).withColumn("benchmark", (F.col("label") == "safe") & (F.col("language") == "en"))
    return _rounded(protocol.shortcut_check(s, 0.6), "trained_on", "held_out")


@query(f"WITH {SCORES} SELECT count(*) AS n, round(avg(((score >= 0.6) = (score * 0.9 >= 0.6))::INT::DOUBLE), 9) AS agreement, round(max(abs(score - score * 0.9)), 9) AS max_difference FROM scores")
def q_variant_agreement(spark, d):
    s = _scores(_c(spark, d)).select("pos", "score")
    return _rounded(protocol.variant_agreement(s, s.withColumn("score", F.col("score") * 0.9), 0.6), "agreement", "max_difference")


@query(f"WITH {SCORES}, g AS (SELECT source AS variant, row_number() OVER (ORDER BY source) AS place, round(avg((score >= 0.8)::INT::DOUBLE), 9) AS top1, round(avg((score >= 0.6)::INT::DOUBLE), 9) AS top3 FROM scores GROUP BY source) SELECT variant FROM g ORDER BY (top1 + top3) / 2 DESC, place LIMIT 1")
def q_best_variant(spark, d):
    from pyspark.sql import Window

    g = _rounded(_scores(_c(spark, d)).groupBy(F.col("source").alias("variant")).agg(F.avg((F.col("score") >= 0.8).cast("double")).alias("top1"), F.avg((F.col("score") >= 0.6).cast("double")).alias("top3")), "top1", "top3")
    return protocol.best_variant(g.withColumn("place", F.row_number().over(Window.orderBy("variant"))))


@query(f"WITH {SCORES}, g AS (SELECT source, round(avg(score), 6) AS auc, round(max(score), 6) AS auc_in FROM scores GROUP BY source) SELECT source, auc, auc_in, auc < 0.75 OR auc_in - auc > 0.15 AS trigger FROM g")
def q_needs_mitigation(spark, d):
    g = _scores(_c(spark, d)).groupBy("source").agg(F.round(F.avg("score"), 6).alias("auc"), F.round(F.max("score"), 6).alias("auc_in"))
    return protocol.needs_mitigation(g)


# Batches per language, and topics, of a generation plan.
_PLAN = {"hinglish": 5, "hi": 2, "en": 2, "ta_en": 1, "te_en": 1, "bn_en": 1, "mr_en": 1}


@query(f"""WITH l(language, w) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in _PLAN.items())}), t AS (SELECT unnest([{", ".join(f"'{t}'" for t in triage.SCAM_TYPES)}]) AS topic),
  k AS (SELECT label, topic FROM t, (VALUES ('scam'), ('safe')) x(label) UNION ALL SELECT 'safe', 'everyday') SELECT label, topic, language, b AS batch_no FROM l, k, (SELECT unnest(range(5)) AS b) WHERE b < w""")
def q_generation_plan(spark, d):
    return protocol.generation_plan(spark, _PLAN, list(triage.SCAM_TYPES), "everyday").withColumn("batch_no", F.col("batch_no").cast("long"))


@query("""WITH t AS (SELECT label, source, (label = 'scam')::INT::DOUBLE AS y, floor(log10(greatest(length(text_raw), 1)::DOUBLE) * 10) AS bin, split FROM combined WHERE split IS NOT NULL), m AS (SELECT avg(y) AS r FROM t WHERE split = 'train'),
  s AS (SELECT 'source' AS baseline, source AS g, y, split FROM t UNION ALL SELECT 'length', bin::VARCHAR, y, split FROM t), k AS (SELECT baseline, g, avg(y) AS score FROM s WHERE split = 'train' GROUP BY ALL),
  v AS (SELECT s.baseline, s.y, coalesce(k.score, m.r) AS score FROM s LEFT JOIN k ON s.baseline = k.baseline AND s.g = k.g, m WHERE s.split <> 'train'), a AS (SELECT baseline, score, sum(y) AS p, count(*) AS c FROM v GROUP BY ALL),
  u AS (SELECT *, coalesce(sum(c - p) OVER (PARTITION BY baseline ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM a) SELECT baseline, round(sum(p * (below + (c - p) / 2)) / (sum(p) * sum(c - p)), 9) AS roc_auc FROM u GROUP BY baseline""")
def q_shortcut_baselines(spark, d):
    c = _c(spark, d)
    return _rounded(protocol.shortcut_baselines(c.where("split = 'train'"), c.where("split in ('val', 'test')")), "roc_auc")


def _model_text():
    return F.substring("text", 1, 2_000)


_LINEAR = r"""t AS (SELECT pos, label, split, is_synthetic, regexp_extract_all(lower(substr(text, 1, 2000)), '[\p{L}\p{N}_][\p{L}\p{N}_]+') AS w FROM combined), g AS (SELECT pos, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t),
  f AS (SELECT pos, term, count(*) AS tf FROM g GROUP BY ALL), tr AS (SELECT pos, label FROM t WHERE split = 'train'), i AS (SELECT term, ln((1 + (SELECT count(*) FROM tr))::DOUBLE / (1 + count(*))) + 1 AS idf FROM f JOIN tr USING (pos) GROUP BY term HAVING count(*) >= 2),
  x AS (SELECT pos, term, (1 + ln(tf)) * idf AS x FROM f JOIN i USING (term)), v AS (SELECT pos, term, x / sqrt(sum(x * x) OVER (PARTITION BY pos)) AS w FROM x),
  m AS (SELECT term, coalesce(sum(w) FILTER (label = 'scam'), 0) / (SELECT count(*) FROM tr WHERE label = 'scam') - coalesce(sum(w) FILTER (label = 'safe'), 0) / (SELECT count(*) FROM tr WHERE label = 'safe') AS weight FROM v JOIN tr USING (pos) GROUP BY term)"""


@query(f"WITH {_LINEAR} SELECT t.pos, round(coalesce(s.m, 0), 6) AS margin FROM t LEFT JOIN (SELECT pos, sum(w * weight) AS m FROM v JOIN m USING (term) GROUP BY pos) s USING (pos) WHERE t.split IN ('val', 'test')")
def q_linear_scores(spark, d):
    c = _c(spark, d)
    model = materialize(features.fit_linear(c.where("split = 'train'"), _model_text()), "model")
    rest = c.where("split in ('val', 'test')")
    return features.score_linear(rest, model, _model_text()).withColumn("margin", F.round("margin", 6))


@query()
def q_char_features(spark, d):
    c = features.model_input(_c(spark, d)).where("split = 'train'")
    return features.fit_vocabulary(c, "char", 3).agg(F.count("*").alias("terms"), F.round(F.sum("idf"), 3).alias("idf_sum"))


@query()
def q_predict_raw(spark, d):
    """Raw messages through the training-time preparation, the model and its threshold."""
    c = _c(spark, d)
    train, val = c.where("split = 'train'"), c.where("split = 'val' and not is_synthetic")
    _, model, threshold, _ = protocol.tune(train, val, _model_text(), ("word",))
    return features.predict(c, model, threshold).withColumn("margin", F.round("margin", 6)).withColumn("scam_probability", F.round("scam_probability", 6))


@query()
def q_protocol(spark, d):
    return _rounded(protocol.run_protocol(_c(spark, d), F.col("text")), "precision", "recall", "f1", "roc_auc")


@query()
def q_source_identifiability(spark, d):
    c = _c(spark, d)
    return _rounded(protocol.source_identifiability(c.where("split = 'train'"), c.where("split = 'val' and not is_synthetic"), _model_text()), "accuracy", "majority", "excess")


@query()
def q_preprocess(spark, d):
    """The whole job; rows without a split stand in for the evaluation-only holdout."""
    c = _c(spark, d)
    return pipeline.run_preprocessing(c.where("split is not null"), c.where("split is null").select("pos", "text"))[1]


@query()
def q_analyze_messages(spark, d):
    """One row per message: links scored, language tagged, margin and probability, verdict, risk and explanation."""
    c = _c(spark, d)
    links = ur.score_urls(_links(spark, d), table(spark, d, "blocklist")).groupBy("pos").agg(
        F.collect_list("band").alias("bands"), F.max("score").alias("worst_score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))
    _, model, threshold, _ = protocol.tune(c.where("split = 'train'"), c.where("split = 'val' and not is_synthetic"), _model_text(), ("word",))
    p = features.predict(c, model, threshold)
    j = c.select("pos", "source", tx.detect_language(F.col("text")).alias("tag"), tx.output_language(F.col("text")).alias("language")).join(links, "pos", "left").join(p, "pos", "left")
    worst = ur.worst_band(F.coalesce("bands", F.array().cast("array<string>")))
    j = j.withColumn("worst", worst).withColumn("v", verdict.verdict(F.col("is_scam"), F.col("scam_probability"), worst))
    j = j.select("pos", "source", "tag", "language", "worst", F.round("worst_score", 6).alias("worst_score"), F.round("margin", 6).alias("margin"), F.round("scam_probability", 6).alias("scam_probability"), "is_scam", "v.verdict", "v.risk_level", "reasons", F.lit(None).cast("string").alias("pattern_id"))
    e = verdict.explain(j, table(spark, d, "knowledge_base"))
    return e.select("pos", "source", "tag", "worst", "worst_score", "margin", "scam_probability", "is_scam", "verdict", "risk_level", "explanation", verdict.sanitize_list(F.col("red_flags")).alias("red_flags"), "what_to_do")


# ---------------------------------------------------------------- retrieval
_UNIT = "list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))"
_NEAR = f"""u AS (SELECT vec_id, label, {_UNIT} AS e FROM embeddings), s AS (SELECT q.vec_id, q.label, e.vec_id AS entry_id, e.label AS entry_label, round(list_dot_product(q.e, e.e), 9) AS similarity FROM u q, u e WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, entry_id) AS rank FROM s)"""


def _searched(spark, d):
    """Every embedding whose identifier is divisible by 100, against all embeddings."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return retrieval.nearest(e.where("vec_id % 100 = 0"), e.withColumnRenamed("vec_id", "entry_id"), apart=True)


@query(f"WITH {_NEAR} SELECT vec_id, rank, entry_id, round(similarity, 6) AS similarity, max(similarity) OVER (PARTITION BY vec_id) >= 0.49 AS confident FROM r WHERE rank <= 3")
def q_nearest(spark, d):
    return _searched(spark, d).select("vec_id", F.col("rank").cast("long").alias("rank"), "entry_id", F.round("similarity", 6).alias("similarity"), "confident")


_HITS = "m AS (SELECT vec_id, label AS origin, bool_or(rank = 1 AND entry_label = label) AS a, bool_or(entry_label = label) AS b FROM r WHERE rank <= 3 GROUP BY ALL)"


def _judged(spark, d):
    """The searched rows with the entries' labels in place of their identifiers: a hit is an entry of the query's label."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("entry_id"), F.col("label").alias("entry_label"))
    return _searched(spark, d).join(e, "entry_id").select("vec_id", "rank", "similarity", F.col("entry_label").alias("entry_id"))


@query(f"WITH {_NEAR}, {_HITS} SELECT origin, count(*) AS n, count(*) FILTER (a)::DOUBLE / count(*) AS top1, count(*) FILTER (b)::DOUBLE / count(*) AS top3 FROM m GROUP BY ROLLUP(origin)")
def q_hit_rates(spark, d):
    q = table(spark, d, "embeddings").where("vec_id % 100 = 0").select("vec_id", F.col("label").alias("origin"), F.col("label").alias("expected"))
    return retrieval.hit_rates_by(_judged(spark, d), q, "origin")


#: Candidates of the threshold of retrieval.
CANDIDATES = [round(0.25 + 0.02 * i, 2) for i in range(23)]
_SWEEP = f"""{_NEAR}, t AS (SELECT unnest([{", ".join(map(str, CANDIDATES))}])::DOUBLE AS threshold), f AS (SELECT similarity, entry_label = label AS correct FROM r WHERE rank = 1),
  g AS (SELECT threshold, avg((similarity >= threshold)::INT::DOUBLE) AS accept_rate, count(*) FILTER (similarity >= threshold AND correct)::DOUBLE / nullif(count(*) FILTER (similarity >= threshold), 0) AS precision FROM f, t GROUP BY threshold),
  w AS (SELECT threshold, accept_rate, precision, CASE WHEN precision IS NULL THEN accept_rate ELSE (accept_rate + precision) / 2 END AS score FROM g)"""


def _swept(spark, d):
    own = table(spark, d, "embeddings").select("vec_id", "label")
    first = _judged(spark, d).where("rank = 1").join(own, "vec_id").withColumn("correct", F.col("entry_id") == F.col("label"))
    return retrieval.threshold_sweep(first, CANDIDATES)


@query(f"WITH {_SWEEP} SELECT threshold, round(accept_rate, 9) AS accept_rate, round(precision, 9) AS precision, round(score, 9) AS score FROM w")
def q_threshold_sweep(spark, d):
    return _rounded(_swept(spark, d), "accept_rate", "precision", "score")


@query(f"WITH {_SWEEP} SELECT threshold, round(score, 9) AS score FROM w ORDER BY score DESC, threshold DESC LIMIT 1")
def q_best_threshold(spark, d):
    return _rounded(retrieval.best_threshold(_rounded(_swept(spark, d), "score")), "score")


@query("""WITH k AS (SELECT id, unnest(list_filter([CASE WHEN id IS NULL OR NOT regexp_matches(id, '^[a-z][a-z0-9_]*$') THEN 'bad_id' END, CASE WHEN trim(coalesce(name, '')) = '' THEN 'blank_name' END, CASE WHEN coalesce(len(typical_phrases), -1) <= 0 THEN 'no_phrases' END,
  CASE WHEN coalesce(len(red_flags), -1) <= 0 THEN 'no_flags' END], lambda x: x IS NOT NULL)) AS problem FROM (SELECT lower(replace(name, ' ', '-')) AS id, CASE WHEN length(name) % 3 = 0 THEN ' ' ELSE name END AS name, CASE WHEN length(name) % 2 = 0 THEN typical_phrases ELSE [] END AS typical_phrases, red_flags FROM knowledge_base))
  SELECT problem, count(*) AS rows FROM k GROUP BY problem UNION ALL SELECT 'duplicate_id', count(*) FROM (SELECT lower(replace(name, ' ', '-')) AS id FROM knowledge_base) GROUP BY id HAVING count(*) > 1""")
def q_kb_problems(spark, d):
    """The knowledge base with faults put in: identifiers made of names, some names and lists blank."""
    k, n = table(spark, d, "knowledge_base"), F.length("name")
    broken = k.select(F.lower(F.replace("name", F.lit(" "), F.lit("-"))).alias("id"), F.when(n % 3 == 0, " ").otherwise(F.col("name")).alias("name"),
                      F.when(n % 2 == 0, F.col("typical_phrases")).otherwise(F.array().cast("array<string>")).alias("typical_phrases"), "red_flags")
    return retrieval.kb_problems(broken)


# ---------------------------------------------------------------- twins of splits, orders and streams
@query(r"""WITH m AS (SELECT topic, created_at, batch_no, unnest(messages) AS m, unnest(range(len(messages))) AS i FROM synthetic_batches), k AS (SELECT *, trim(regexp_replace(replace(replace(lower(m), 'ß', 'ss'), 'ς', 'σ'), '\s+', ' ', 'g')) AS text_key, row_number() OVER (PARTITION BY trim(regexp_replace(replace(replace(lower(m), 'ß', 'ss'), 'ς', 'σ'), '\s+', ' ', 'g')) ORDER BY created_at, batch_no, i) AS r FROM m WHERE trim(m) <> '')
  SELECT text_key, topic FROM k WHERE r = 1""")
def q_first_topic(spark, d):
    return audit.first_topic(table(spark, d, "synthetic_batches"))


@query("SELECT event_id, event_type, value FROM events")
def q_log_lines(spark, d):
    """Events as JSON lines of the allowed fields, read back."""
    lines = sinks.log_lines(table(spark, d, "events"), ["event_id", "event_type", "value"])
    return lines.select(F.from_json("line", "event_id bigint, event_type string, value double").alias("o")).select("o.*")


_STRATA = """f AS (SELECT *, concat_ws('|', label, source) AS s1 FROM combined), n AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY s1) < 10 THEN concat_ws('|', label, 'other') ELSE s1 END AS s2 FROM f),
  z AS (SELECT label, s2, count(*) AS c FROM n GROUP BY ALL), top AS (SELECT label, max_by(s2, (c, s2)) AS t FROM z WHERE NOT ends_with(s2, '|other') GROUP BY label),
  st AS (SELECT n.*, CASE WHEN z.c < 2 THEN coalesce(top.t, n.label) ELSE n.s2 END AS stratum FROM n JOIN z USING (label, s2) LEFT JOIN top USING (label))"""


@query(f"WITH {_STRATA} SELECT stratum, count(*) AS rows FROM st GROUP BY stratum")
def q_strata(spark, d):
    return sp.strata(_c(spark, d)).groupBy("stratum").agg(F.count("*").alias("rows"))


@query(f"""WITH {_STRATA}, per AS (SELECT stratum, count(*) AS n, count(*) FILTER (NOT is_synthetic) AS real FROM st GROUP BY stratum), tot AS (SELECT sum(n)::DOUBLE AS a, sum(real)::DOUBLE AS r FROM per),
  q AS (SELECT stratum, round_even(0.15 * a, 0) AS want, round_even(0.15 * a, 0) * real / r AS ti, round_even(0.15 * a, 0) * n / a AS vi FROM per, tot),
  x AS (SELECT stratum, floor(ti) + (row_number() OVER (ORDER BY ti - floor(ti) DESC, stratum) <= want - sum(floor(ti)) OVER ())::INT AS tn, floor(vi) + (row_number() OVER (ORDER BY vi - floor(vi) DESC, stratum) <= want - sum(floor(vi)) OVER ())::INT AS vn FROM q),
  o AS (SELECT st.*, x.tn, x.vn, NOT is_synthetic AND row_number() OVER (PARTITION BY stratum, NOT is_synthetic ORDER BY md5('42:' || pos)) <= x.tn AS test FROM st JOIN x USING (stratum)),
  v AS (SELECT *, row_number() OVER (PARTITION BY stratum, test ORDER BY md5('42:' || pos)) AS r FROM o)
  SELECT pos, CASE WHEN test THEN 'test' WHEN r <= vn THEN 'val' ELSE 'train' END AS split, stratum FROM v""")
def q_stratified_split(spark, d):
    return sp.stratified_split(sp.strata(_c(spark, d).drop("split"))).select("pos", "split", "stratum")


@query("""WITH g AS (SELECT pos, length(text) AS n, floor(('0x' || substr(md5('batches:' || pos), 1, 8))::BIGINT / 4294967296.0 * (SELECT greatest(1, ceil(count(*) / 1600.0)) FROM combined))::BIGINT AS g FROM combined), r AS (SELECT *, (row_number() OVER (PARTITION BY g ORDER BY n, pos) - 1) // 32 AS b FROM g)
  SELECT g || '-' || b AS batch, count(*) AS rows, max(n) AS longest FROM r GROUP BY 1""")
def q_length_batches(spark, d):
    c = _c(spark, d).select("pos", F.length("text").alias("n"))
    return sp.length_batches(c, "n", 32).groupBy("batch").agg(F.count("*").alias("rows"), F.max("n").cast("long").alias("longest"))


@query("""WITH RECURSIVE e AS (SELECT event_id, event_type AS b, user_id AS c, epoch(ts)::DOUBLE AS t, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS k FROM events WHERE ts IS NOT NULL),
  r AS (SELECT event_id, b, c, k, true AS accepted, 0.0::DOUBLE AS retry_after, t AS t1, NULL::DOUBLE AS t2 FROM e WHERE k = 1
    UNION ALL SELECT n.event_id, n.b, n.c, n.k, NOT full_now, CASE WHEN full_now THEN round(f1 + 86400.0 - n.t, 6) ELSE 0.0 END, CASE WHEN full_now THEN f1 WHEN f1 IS NULL THEN n.t ELSE f1 END, CASE WHEN full_now THEN f2 WHEN f1 IS NULL THEN NULL ELSE n.t END
      FROM (SELECT e.*, CASE WHEN r.t1 > e.t - 86400.0 THEN r.t1 WHEN r.t2 > e.t - 86400.0 THEN r.t2 END AS f1, CASE WHEN r.t1 > e.t - 86400.0 AND r.t2 > e.t - 86400.0 THEN r.t2 END AS f2, coalesce(r.t1 > e.t - 86400.0 AND r.t2 > e.t - 86400.0, false) AS full_now FROM r JOIN e ON e.b = r.b AND e.c = r.c AND e.k = r.k + 1) n)
  SELECT event_id, accepted, retry_after FROM r""")
def q_rate_limit(spark, d):
    return stateful.rate_limit(table(spark, d, "events"), 2, 86_400.0)


# ---------------------------------------------------------------- near duplicates on the message table
_VEC = r"""t AS (SELECT pos AS doc, split, label, is_synthetic, regexp_extract_all(substr(regexp_replace(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), '\p{Nd}+', '0', 'g'), 1, 3000), '[\p{L}\p{N}_][\p{L}\p{N}_]+') AS w FROM combined),
  g AS (SELECT doc, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t), f AS MATERIALIZED (SELECT doc, term, count(*) AS tf FROM g GROUP BY ALL)"""


def _pairs_sql(part: str) -> str:
    """Pairs of cosine 0.9 or more among the documents of ``part`` (doc)."""
    return f"""p AS MATERIALIZED ({part}), d AS (SELECT term, ln((1 + (SELECT count(*) FROM p))::DOUBLE / (1 + count(*))) + 1 AS idf FROM f SEMI JOIN p USING (doc) GROUP BY term), x AS (SELECT doc, term, (1 + ln(tf)) * idf AS x FROM f SEMI JOIN p USING (doc) JOIN d USING (term)),
      v AS MATERIALIZED (SELECT doc, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc)) AS w FROM x), s AS MATERIALIZED (SELECT a.doc AS i, b.doc AS j, round(sum(a.w * b.w), 9) AS sim FROM v a JOIN v b ON a.term = b.term AND a.doc < b.doc GROUP BY ALL HAVING sum(a.w * b.w) >= 0.9 - 1e-12)"""


_CLUSTERS = f"""RECURSIVE {_VEC}, {_pairs_sql("SELECT doc FROM t")}, n AS (SELECT i AS a, j AS b FROM s UNION SELECT j, i FROM s), r AS (SELECT a AS node, a AS root FROM n UNION SELECT n.b, r.root FROM r JOIN n ON r.node = n.a), comp AS (SELECT node, min(root) AS c FROM r GROUP BY node),
  k AS (SELECT t.doc, coalesce(comp.c, t.doc) AS c, t.label, t.is_synthetic FROM t LEFT JOIN comp ON comp.node = t.doc), z AS (SELECT *, count(*) OVER (PARTITION BY c) AS size, min(label) OVER (PARTITION BY c) <> max(label) OVER (PARTITION BY c) AS mixed, row_number() OVER (PARTITION BY c ORDER BY is_synthetic, doc) AS copy FROM k)"""


@query(f"WITH {_CLUSTERS} SELECT doc AS pos, c AS cluster, size AS cluster_size, mixed AS mixed_labels, copy AS copy_no FROM z")
def q_near_duplicate_clusters(spark, d):
    c = _c(spark, d)
    pairs = materialize(similarity.similar_pairs(c, "pos", "text", 0.9, similarity.NEAR_CHARS), "pairs")
    return similarity.near_duplicate_clusters(c, pairs).select("pos", "cluster", "cluster_size", "mixed_labels", F.col("copy_no").cast("long").alias("copy_no"))


@query(f"""WITH {_CLUSTERS} SELECT count(*) AS rows, count(*) FILTER (size > 1 AND copy = 1) AS clusters, max(size) AS largest, count(*) FILTER (mixed) AS mixed_label_rows, count(*) FILTER (NOT mixed AND copy > 1) AS removed FROM z""")
def q_near_duplicate_report(spark, d):
    c = _c(spark, d)
    pairs = materialize(similarity.similar_pairs(c, "pos", "text", 0.9, similarity.NEAR_CHARS), "pairs")
    return similarity.near_duplicate_report(similarity.near_duplicate_clusters(c, pairs))


def _sensitivity_sql() -> str:
    out = []
    for t in (0.80, 0.90, 0.95):
        out.append(f"""SELECT {t}::DOUBLE AS threshold, (SELECT count(*) FROM pairs WHERE sim >= {t} - 1e-12) AS pairs, (WITH RECURSIVE n AS (SELECT i AS a, j AS b FROM pairs WHERE sim >= {t} - 1e-12 UNION SELECT j, i FROM pairs WHERE sim >= {t} - 1e-12), r AS (SELECT a AS node, a AS root FROM n UNION SELECT n.b, r.root FROM r JOIN n ON r.node = n.a),
          c AS (SELECT node, min(root) AS c FROM r GROUP BY node) SELECT count(*) - count(DISTINCT c) FROM c) AS removed""")
    return f"WITH pairs AS MATERIALIZED ({catalog._SIMILAR_SQL}) " + " UNION ALL ".join(out)


@query(_sensitivity_sql())
def q_sensitivity(spark, d):
    return similarity.sensitivity(materialize(similarity.similar_pairs(catalog._docs(spark, d), "doc_id", "text", 0.8), "pairs"))


def _audit_sql() -> str:
    out = []
    for held, ref in (("val", "train"), ("test", "train"), ("test", "val")):
        out.append(f"""SELECT * FROM (WITH {_pairs_sql(f"SELECT doc FROM t WHERE split IN ('{held}', '{ref}')")}, b AS (SELECT doc, max(sim) AS m FROM (SELECT i AS doc, j AS o, sim FROM s UNION ALL SELECT j, i, sim FROM s) y JOIN t USING (doc) JOIN (SELECT doc AS o, split AS other FROM t) u USING (o) WHERE t.split = '{held}' AND other = '{ref}' GROUP BY doc),
          k AS (SELECT DISTINCT {catalog.KEY} AS k FROM combined WHERE split = '{ref}'), h AS (SELECT c.pos, {catalog.KEY.replace("text", "c.text")} IN (SELECT k FROM k) AS exact, b.m FROM combined c LEFT JOIN b ON b.doc = c.pos WHERE c.split = '{held}')
          SELECT '{held}' AS held, '{ref}' AS reference, count(*) AS rows, count(*) FILTER (exact OR m IS NOT NULL) AS near_duplicates, round(max(m), 4) AS max_similarity FROM h)""")
    return f"WITH {_VEC} " + " UNION ALL ".join(out)


@query(_audit_sql())
def q_leakage_audit(spark, d):
    return similarity.leakage_audit(_c(spark, d).where("split is not null"), chars=similarity.NEAR_CHARS)


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_CATEGORIES = f"""t AS ({catalog.ORACLES["top_words"]}), k AS (SELECT side, CASE WHEN word IN ({_in(eda.FINGERPRINTS)}) THEN 'fingerprint' WHEN regexp_matches(word, '\\d|^(?:url|otp|phone|cur|year)$') THEN 'format' WHEN word IN ({_in(eda.SIGNALS)}) THEN 'signal' ELSE 'other' END AS kind FROM t),
  c AS (SELECT side, count(*) AS n, count(*) FILTER (kind = 'signal') AS signal, count(*) FILTER (kind = 'fingerprint') AS fingerprint, count(*) FILTER (kind = 'format') AS format, count(*) FILTER (kind = 'other') AS other FROM k GROUP BY side)"""


@query(f"WITH {_CATEGORIES} SELECT *, round(signal::DOUBLE / n, 9) AS signal_share FROM c")
def q_feature_categories(spark, d):
    return _rounded(eda.feature_categories(eda.top_words(_c(spark, d))), "signal_share")


@query(f"WITH {_CATEGORIES} SELECT sum(fingerprint) = 0 AND max(CASE WHEN side = 'scam' THEN signal::DOUBLE / n END) >= 0.1 AS passed FROM c")
def q_feature_audit(spark, d):
    return eda.passes_audit(eda.feature_categories(eda.top_words(_c(spark, d))), 0.1)


assert FLAGSHIP in QUERIES
