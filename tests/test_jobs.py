"""Verdicts, levels, review, protocol, the whole job, streams and screens against known answers and brute force."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgsieve.functions import replies, screens, styles
from msgsieve.operators import audit, features, heldout, levels, metrics, protocol, ranks, retrieval, similarity, splits, triage, verdict
from msgsieve.plans import pipeline
from msgsieve.sources import readers
from msgsieve.streaming import stateful

# Letters only: runs of digits count as one in near duplicates.
WORDS = [a + b + c for a in "bdfgklmn" for b in "aeiou" for c in "prstvxzwqy"]
MESSAGE = "pos long, text_raw string, text string, label string, scam_type string, language string, source string, is_synthetic boolean, generator string, subtype string, split string"


def messages(spark, n=160, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        scam = i % 3 == 0
        words = [rng.choice(WORDS) for _ in range(14)] + (["prize", "claim", "now"] if scam else ["meeting", "notes"])
        t = " ".join(words)
        rows.append((i, t, t, "scam" if scam else "safe", "none", "en", "ab"[i % 2], i % 5 == 0, None, "promo" if i % 6 == 0 else "unspecified", ["train", "train", "val", "test"][i % 4]))
    rows.append((n, rows[1][1].upper(), rows[1][1].upper(), "safe", "none", "en", "a", False, None, "unspecified", "val"))
    rows.append((n + 1, None, None, "safe", None, None, None, False, None, None, "train"))
    return spark.createDataFrame(rows, MESSAGE)


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("flag,p,band,want", [
    (True, 0.8, "none", ("scam", "high")), (True, 0.79, "low", ("scam", "medium")), (True, 0.5, "medium", ("scam", "high")), (True, 0.5, "high", ("scam", "high")), (False, 0.99, "high", ("suspicious", "high")),
    (False, 0.1, "medium", ("suspicious", "medium")), (False, 0.1, "low", ("safe", "low")), (None, None, None, ("safe", "low")), (True, None, None, ("scam", "medium"))])
def test_verdict(spark, flag, p, band, want):
    d = spark.createDataFrame([(flag, p, band)], "f boolean, p double, b string")
    assert tuple(d.select(verdict.verdict(F.col("f"), F.col("p"), F.col("b")).alias("v")).first()["v"]) == want


def test_explanations_and_finalizing(spark):
    kb = spark.createDataFrame([("k1", "Fake prize", ["asks for a fee"], "Ignore it.")], "id string, name string, red_flags array<string>, what_to_do string")
    rows = spark.createDataFrame([(1, "scam", "en", "k1", ["odd host"]), (2, "safe", "hi", "gone", None), (3, "suspicious", "xx", None, [])], "pos long, verdict string, language string, pattern_id string, reasons array<string>")
    got = {r["pos"]: r for r in verdict.explain(rows, kb).collect()}
    assert got[1]["red_flags"] == ["odd host", "asks for a fee"] and "Fake prize" in got[1]["explanation"] and got[1]["what_to_do"] == ["Ignore it."] and got[1]["matched_pattern"] == "k1"
    assert got[2]["matched_pattern"] is None and got[2]["red_flags"] == [] and got[2]["explanation"].endswith("।") and got[3]["explanation"].startswith("Parts")
    settled = spark.createDataFrame([(1, "scam", "high", "k1"), (2, "safe", "low", None)], "pos long, verdict string, risk_level string, matched_pattern string")
    r = spark.createDataFrame([(1, "call 9876543210 " + "x" * 3000, ["http://a.example/x"] * 9, None)], "pos long, explanation string, red_flags array<string>, what_to_do array<string>")
    f = {x["pos"]: x for x in verdict.finalize(r, settled).collect()}
    assert f[1]["verdict"] == "scam" and "9876543210" not in f[1]["explanation"] and len(f[1]["explanation"]) <= 1200 and f[1]["red_flags"] == ["<URL>"] * 6 and f[2]["explanation"] is None
    c = spark.createDataFrame([("classifier", True), ("rag", None), ("ocr", True)], "component string, ready boolean")
    assert verdict.readiness(c).first()["status"] == "degraded" and verdict.readiness(c.limit(0)).first()["status"] == "unavailable"


def test_replies(spark):
    good = {"verdict": "scam", "risk_level": "high", "red_flags": ["a"], "explanation": "b", "what_to_do": [], "matched_pattern": None}
    assert one(spark, "```json\n" + json.dumps(good) + "\n```", replies.parse_explanation)["red_flags"] == ["a"]
    for bad in ("no json", json.dumps(good | {"verdict": "odd"}), json.dumps({k: v for k, v in good.items() if k != "red_flags"}), json.dumps(good | {"red_flags": "x"}), None):
        assert one(spark, bad, replies.parse_explanation) is None


@pytest.mark.parametrize("text,kind", [("share your OTP at once", "fraud"), ("do not share OTP; your otp is 1", "service"), ("You won the KBC lottery", "fraud"), ("Big sale today", "promo"), ("UIDAI recommends updating  proof now", "service"), (None, None)])
def test_subtypes(spark, text, kind):
    assert one(spark, text, styles.spam_subtype) == kind


def test_secrets(spark, tmp_path):
    (tmp_path / "a.txt").write_text("key gsk_0123456789abcdef")
    (tmp_path / "b.txt").write_text("nothing")
    assert [r["path"].rsplit("/", 1)[1] for r in styles.scan_for_secrets(spark, str(tmp_path)).collect()] == ["a.txt"]


def test_policies_and_levels(spark):
    df = levels.reference_rows(messages(spark))
    a = {r["pos"]: r for r in levels.apply_policy(df, "A", ["a"]).collect()}
    d = levels.apply_policy(df, "D", ["a"])
    legit = [p for p, r in a.items() if r["benchmark"]]
    assert legit and all(a[p]["label"] == "safe" and a[p]["scam_type"] == "none" and a[p]["source"] == "a" for p in legit)
    assert {r["pos"] for r in d.where("withheld").collect()} == set(legit) and levels.training_rows(d).count() == df.count() - len(legit)
    with pytest.raises(ValueError):
        levels.apply_policy(df, "B", ["a"])
    decisions = df.where("is_synthetic").select(audit.row_id(F.col("text_raw")).alias("row_id"), F.lit("flip").alias("action"))
    flipped = levels.build_level("L1", df, None, decisions, ["a"])
    changed = {r["pos"]: (r["label"], r["subtype"]) for r in flipped.where("is_synthetic").collect()}
    assert all(v == (("safe", "unspecified") if p % 3 == 0 else ("scam", "fraud")) for p, v in changed.items())
    with pytest.raises(ValueError):
        levels.build_level("L2a", df, None, decisions, ["a"])
    got = {(r["split"], r["field"], r["value"]): r["rows"] for r in levels.describe(flipped).collect()}
    assert got["val", "rows", "all"] == flipped.where("split = 'val'").count()
    levels_run = spark.createDataFrame([(1, "L0", False, 3, 0.1), (2, "L1", False, 2, 0.2), (3, "L2a", False, 2, 0.4)], "place int, level string, passed boolean, fingerprints int, signal_share double")
    assert tuple(levels.choose_level(levels_run).first()) == ("L2a", False) and levels.choose_level(levels_run.limit(0)).count() == 0
    assert tuple(levels.choose_level(levels_run.withColumn("passed", F.col("place") >= 2)).first()) == ("L1", True)


def test_renormalize_keeps_no_leak(spark):
    df = levels.apply_policy(levels.reference_rows(messages(spark)), "D", ["a"])
    out = levels.renormalize(df)
    assert similarity.leakage_audit(out).agg(F.sum("near_duplicates")).first()[0] == 0 and out.where("split = 'train'").count() == 80
    assert out.where("pos = 160").count() == 0


def test_whole_job(spark, tmp_path):
    df = messages(spark).drop("urls")
    holdout = spark.createDataFrame([(9000, df.where("pos = 7").first()["text"] + " extra")], "pos long, text string")
    parts, report = pipeline.run_preprocessing(df, holdout)
    steps = {r["step"]: r["rows"] for r in report.collect()}
    assert steps["input"] == 162 and steps["cleaned"] == 161 and steps["exact"] == 160 and steps["holdout"] == steps["near"] - 1 and steps["trimmed"] == parts.count()
    assert parts.where("pos = 7").count() == 0 and parts.where("split = 'test' and is_synthetic").count() == 0
    pipeline.write_result(parts, report, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out/splits"))
    assert back.count() == parts.count() and any(json.loads(e["value"] if isinstance(e, dict) else e).get("step") == "trimmed" for e in pipeline.read_report(spark, str(tmp_path / "out")) if isinstance(e, str)) or pipeline.read_report(spark, str(tmp_path / "out"))
    empty, _ = pipeline.run_preprocessing(df.limit(0))
    assert empty.count() == 0


def test_triage(spark):
    rows = spark.createDataFrame([("a", "Urgent: call 9876543210 at once", "safe"), ("b", "hello", "scam"), ("c", "fine", "safe"), ("d", "plain", "safe"), ("e", "odd", "scam")], "row_id string, text string, label string")
    scores = spark.createDataFrame([("a", -1.0), ("b", -0.5), ("c", -1.0), ("d", -1.0), ("e", 2.0)], "row_id string, oof double")
    judged = triage.latest_judgements(spark.createDataFrame([("c", "safe", 1), ("c", "unsure", 2), ("e", "scam", 1)], "row_id string, verdict string, seq int"))
    got = {r["row_id"]: r["reasons"] for r in triage.build_triage(rows, judged, scores, 1).collect()}
    assert got["a"] == "rule" and got["b"] == "oof" and got["c"] == "judge" and sorted(got.values()) == ["control", "judge", "oof", "rule"]


def test_annotations(spark, tmp_path):
    head = "text,label,scam_type,language,channel,collected_from,notes\n"
    body = ["example text,scam,lottery,en,sms,example,", "You won the big lottery today,scam,lottery,en,sms,me,", "abc,Scam,what,en,fax,me,", ",safe,,en,sms,me,", "Lunch at noon tomorrow,safe,lottery,hi,sms,me,", "A fine prize waits for you,scam,other,en,email,me,"]
    (tmp_path / "a.csv").write_text(head + "\n".join(body) + "\n")
    rows = triage.with_lines(readers.read_strings_csv(spark, str(tmp_path / "a.csv")))
    assert sorted(r["line"] for r in rows.select("line").collect()) == list(range(2, 8))
    bad = triage.annotation_problems(rows)
    got = {(r["line"], r["severity"], r["problem"]) for r in bad.collect()}
    assert got == {(4, "error", "text too short"), (4, "error", "unknown scam_type"), (4, "error", "unknown channel"), (5, "error", "empty text"), (6, "error", "scam_type of a safe row"), (6, "warning", "hi but not Devanagari")}
    good = {r["line"]: r["scam_type"] for r in triage.valid_annotations(rows, bad).collect()}
    assert good == {3: "lottery", 7: "unknown"}
    ref = spark.createDataFrame([(1, "you won the big lottery today")], "pos long, text string")
    assert [r["line"] for r in triage.build_holdout(rows, ref).collect()] == [7]


def test_linear_model_against_numpy(spark):
    df = messages(spark).where("text is not null")
    rows = [(r["pos"], r["text"], r["label"]) for r in df.collect()]
    train = [r for r in rows if r[0] % 2 == 0]

    def grams(t):
        w = t.lower().split()
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    seen = {}
    for _, t, _ in train:
        for g in set(grams(t)):
            seen[g] = seen.get(g, 0) + 1
    names = sorted(g for g, c in seen.items() if c >= 2)
    at = {g: i for i, g in enumerate(names)}
    idf = np.array([np.log((1 + len(train)) / (1 + seen[g])) + 1 for g in names])

    def vec(t):
        v = np.zeros(len(names))
        for g in grams(t):
            if g in at:
                v[at[g]] += 1
        v = np.where(v > 0, 1 + np.log(np.maximum(v, 1)), 0) * idf
        n = np.linalg.norm(v)
        return v / n if n else v

    w = np.mean([vec(t) for _, t, y in train if y == "scam"], axis=0) - np.mean([vec(t) for _, t, y in train if y == "safe"], axis=0)
    model = features.fit_linear(df.where("pos % 2 = 0"), F.col("text"))
    got = {r["pos"]: r["margin"] for r in features.score_linear(df, model, F.col("text")).collect()}
    assert all(abs(got[p] - vec(t) @ w) < 1e-9 for p, t, _ in rows)
    p = {r["pos"]: r for r in features.predict(messages(spark), model, 0.1).collect()}
    assert p[161]["margin"] is None and p[161]["is_scam"] is None and p[0]["is_scam"] == (p[0]["margin"] >= 0.1)


def test_protocol(spark):
    df = messages(spark).where("text is not null")
    got = {(r["stage"], r["source"]): r for r in protocol.run_protocol(df, F.col("text")).collect()}
    assert got["test", None]["f1"] > 0.9 and {s for _, s in got} == {None, "a", "b"}
    oof = protocol.oof_scores(df, F.col("text"), 3)
    assert oof.count() == df.count() and oof.join(df, "pos").where("(oof > 0) = (label = 'scam')").count() > 0.9 * df.count()
    b = protocol.class_weights(df)
    s = b.groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert abs(s[0]["w"] - s[1]["w"]) < 1e-9
    assert 0 <= protocol.source_identifiability(df.where("split = 'train'"), df.where("split = 'val'"), F.col("text")).first()["accuracy"] <= 1


def test_running_sums_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["x", "y", None]), rng.choice([0, 1]), rng.choice([-1e6, -2.5, 0.0, 0.1, 0.10001, 3.0, 1e9])) for i in range(300)]
    d = spark.createDataFrame(rows, "pos long, g string, y int, score double")
    pos, neg = [s for *_, y, s in rows if y], [s for *_, y, s in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(metrics.roc_auc(d).first()["roc_auc"] - auc) < 1e-9
    c = metrics.curve(d, by=["g"]).collect()
    assert all(r["flagged"] == sum(1 for _, g, _, s in rows if g == r["g"] and s >= r["score"]) and r["positives"] == sum(y for _, g, y, _ in rows if g == r["g"]) for r in c)
    lower = {(r["g"], r["score"]): r["next_lower"] for r in c}
    assert all(v == max((s for _, g2, _, s in rows if g2 == g and s < k), default=None) for (g, k), v in lower.items())
    order = splits.hash_order("t")
    got = {r["pos"]: r["__rank"] for r in ranks.ranked(d, ["g"], order).collect()}
    h = {r["pos"]: r["o"] for r in d.select("pos", order.alias("o")).collect()}
    for g in ("x", "y", None):
        own = sorted((p for p, k, *_ in rows if k == g), key=h.get)
        assert [got[p] for p in own] == list(range(1, len(own) + 1))


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(230, 8))
    v[7] = v[3]
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 8)], "entry_id long, embedding array<double>").repartition(3)
    q = e.where("entry_id % 10 = 0").withColumnRenamed("entry_id", "vec_id")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for i in range(0, 230, 10):
        s = np.round(u @ u[i], 9)
        s[i] = -2
        want[i] = sorted(range(230), key=lambda j: (-s[j], j))[:3]
    for size in (1 << 20, 300):
        got = retrieval.nearest(q, e, block_bytes=size, apart=True).orderBy("vec_id", "rank").collect()
        assert {i: [r["entry_id"] for r in got if r["vec_id"] == i] for i in want} == want
    assert retrieval.nearest(q.limit(0), e).count() == 0 and retrieval.nearest(q, e.limit(0)).count() == 0


def test_collection_is_made_again_only_when_changed(spark, tmp_path):
    kb = spark.createDataFrame([("a", "A", ["p"], "h")], "id string, name string, typical_phrases array<string>, how_it_works string")
    make = lambda docs: docs.select("id", F.array(F.length("document").cast("double")).alias("embedding"))
    path = str(tmp_path / "kb")
    assert retrieval.refresh_collection(kb, make, path) and not retrieval.refresh_collection(kb, make, path)
    assert retrieval.refresh_collection(kb.withColumn("name", F.lit("B")), make, path)


def test_upsert_stream_keeps_all_versions_whole(spark, tmp_path):
    schema = "id long, at long, v string"
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    for n, rows in enumerate([[(1, 1, "a"), (2, 1, "b"), (3, 1, "c")], [(2, 5, "B"), (4, 1, "d")], [(1, 0, "old"), (5, 2, "e"), (2, 9, "BB")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        stateful.upsert_stream(stream, out, "id", "at", cp, once=True, buckets=4).awaitTermination()
    got = {r["id"]: r["v"] for r in stateful.read_upserted(spark, out, schema).collect()}
    assert got == {1: "a", 2: "BB", 3: "c", 4: "d", 5: "e"}
    assert stateful.read_upserted(spark, str(tmp_path / "none"), schema).count() == 0
    with pytest.raises(ValueError):
        stateful.analyze_stream(spark.range(1), lambda d: d)


def test_screens(spark):
    assert one(spark, "Pay now at\nHTTP:/|sbi-kyc . COM/pay  10:42 ✓✓\nDelivered\n\nToday\n\nok then 9:15 pm", screens.clean_screen_text) == "Pay now at http://sbi-kyc.com/pay\n\nok then"
    assert one(spark, "see https://a-b.com/l1 and l2", screens.repair_links) == "see https://a-b.com/l1 and l2"
    boxes = spark.createDataFrame([("i", 0.0, 10.0, "a", 0.9), ("i", 0.0, 20.0, "b", 0.5), ("i", 0.0, 9.0, " ", 0.9), ("j", 0.0, 1.0, "x", 0.1)], "image string, y0 double, y1 double, text string, conf double")
    got = {r["image"]: tuple(r)[1:] for r in screens.reading_stats(boxes).collect()}
    assert got["i"] == (3, 2, pytest.approx(0.7), 15.0) and got["j"] == (1, 0, None, None)


def test_topics_decide_types(spark):
    rows = spark.createDataFrame([(1, "Text A", "safe", "none", True), (2, "Text B", "safe", "none", True), (3, "Text C", "scam", "lottery", True)], "pos long, text_raw string, label string, scam_type string, is_synthetic boolean")
    decisions = rows.select(audit.row_id(F.col("text_raw")).alias("row_id"), F.lit("flip").alias("action"))
    topics = spark.createDataFrame([("text a", "lottery"), ("text b", "everyday")], "text_key string, topic string")
    got = {r["pos"]: (r["label"], r["scam_type"]) for r in audit.apply_decisions(rows, decisions, topics=topics, known=triage.SCAM_TYPES).collect()}
    assert got == {1: ("scam", "lottery"), 2: ("scam", "unknown"), 3: ("safe", "none")}


def test_readers_of_missing_and_broken_files(spark, tmp_path):
    assert readers.read_blocklist_csv(spark, str(tmp_path / "no.csv")).count() == 0 and readers.read_blocklist_text(spark, str(tmp_path / "no.txt")).count() == 0
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception):
        readers.read_blocklist_csv(spark, str(tmp_path / "bad.csv")).count()
    assert protocol.generation_plan(spark, {"en": 2}, ["t"], "e", 0).count() == 0 and protocol.generation_plan(spark, {"en": 2}, ["t"], "e", 1).count() == 6


def test_held_out_models_together(spark, monkeypatch):
    """Every margin equals that of a model fitted alone, whichever terms count as frequent, and a text is cut once a kind."""
    df = messages(spark).withColumn("source", F.when(F.col("pos") % 17 == 3, None).otherwise(F.col("source"))).withColumn("text", F.concat("text", F.lit(" 🙂 ÄÖ x "), F.col("pos") % 7))
    cuts = []
    real = features.term_counts
    monkeypatch.setattr(features, "term_counts", lambda *a, **k: cuts.append(1) or real(*a, **k))
    protocol.run_protocol(df.where("text is not null"), F.col("text")).collect()
    assert not cuts
    for kind in ("word", "char"):
        docs = heldout.documents(df.where("split is not null"), F.col("text"), kind, ["a", "b"])
        got = [{r["pos"]: (r["margin"], r["held_margin"]) for r in heldout.margins(docs, 2, share=share, least=least).collect()} for share, least in ((0.2, 10), (1.0, 1 << 30))]
        rest = df.where("split <> 'train'")
        assert set(got[0]) == set(got[1]) == {r["pos"] for r in rest.select("pos").collect()}
        for i, name in enumerate((None, "a", "b")):
            train = df.where("split = 'train'") if name is None else features.leave_one_source_out(df, name)[0]
            own = rest if name is None else rest.where(F.col("source") == name)
            want = features.score_linear(own, features.fit_linear(train, F.col("text"), kind=kind), F.col("text"), kind=kind).collect()
            assert want and all(abs(g[r["pos"]][i > 0] - r["margin"]) < 1e-9 for g in got for r in want)
