import pytest
from pyspark.sql import functions as F

from msgsieve.functions import replies, screens


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("line,noise", [("10:42 am", True), ("Today 9.15 pm ✓✓", True), ("Delivered", True), ("4G 87%", True), ("type a message", True), ("482913", False), ("Pay by 10:42 today please", False), ("", True)])
def test_noise(spark, line, noise):
    assert one(spark, line, screens.is_noise_line) is noise


def test_repairs(spark):
    assert one(spark, "Pay Rs I000 by Ipm, I am here bit.ly/l2", screens.repair_characters) == "Pay Rs 1000 by 1pm, I am here bit.ly/l2"
    assert one(spark, "कोड ४५२१ है|", screens.repair_characters) == "कोड 4521 है।"
    assert one(spark, "open http:lI sbi-x.tk now", screens.repair_links).startswith("open http://sbi-x.tk")
    assert one(spark, "ok thanks 10:42 ✓✓", screens.clean_line) == "ok thanks"
    assert one(spark, "kitten", lambda c: screens.character_error_rate(c, F.lit("sitting"))) == pytest.approx(3 / 7)


def test_lines(spark):
    rows = [("a", 0.0, 5.0, 0.0, 10.0, "left", 0.9), ("a", 6.0, 9.0, 2.0, 11.0, "right", 0.7), ("a", 0.0, 5.0, 14.0, 24.0, "next", 0.9), ("a", 0.0, 5.0, 60.0, 70.0, "far", 0.9), ("a", 0.0, 5.0, 90.0, 99.0, " ", 0.9), ("a", 0.0, 1.0, 90.0, 99.0, "low", 0.1)]
    got = screens.group_lines(spark.createDataFrame(rows, "image string, x0 double, x1 double, y0 double, y1 double, text string, conf double")).orderBy("line").collect()
    assert [(r["paragraph"], r["text"]) for r in got] == [(0, "left right"), (0, "next"), (1, "far")]


def test_replies(spark):
    assert one(spark, 'Sure:\n```json\n{"messages": ["a", {"text": " b "}, ""]}\n```', replies.parse_messages) == ["a", "b"]
    assert one(spark, '["x"]', replies.parse_messages) == ["x"] and one(spark, "none", replies.parse_messages) is None
    assert one(spark, '{"verdicts": [{"i": 0, "verdict": "Scam"}, {"i": 9, "verdict": "safe"}, {"i": 1, "verdict": "odd"}]}', lambda c: replies.parse_verdicts(c, 3)) == {0: "scam"}
    assert one(spark, "Hi {name}", lambda c: replies.fill_template(c, {"name": F.lit("A")})) == "Hi A"
