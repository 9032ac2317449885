import pytest
from pyspark.sql import functions as F

from msgsieve.functions import text as tx


def one(spark, value, f):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("raw,out", [("  hello \t\n  world  \r\n", "hello world"), ("a\x00b\x07c", "a b c"), ("é", "é"), ("x​y", "xy"), ("क‍ष", "क‍ष"), (None, None), ("", "")])
def test_clean(spark, raw, out):
    assert one(spark, raw, tx.clean_text) == out


@pytest.mark.parametrize("raw,out,links", [
    ("Open http://a.com/x.", "Open <URL>.", ["http://a.com/x"]), ("see bit.ly/x now", "see <URL> now", ["bit.ly/x"]), ("mail user@gmail.com", "mail user@gmail.com", []),
    ("Rs.500 to Mr.Sharma", "Rs.500 to Mr.Sharma", []), ("यहाँ http://a.in/x। देखें", "यहाँ <URL>। देखें", ["http://a.in/x"])])
def test_urls(spark, raw, out, links):
    assert one(spark, raw, tx.mask_urls) == out and one(spark, raw, tx.extract_urls) == links


@pytest.mark.parametrize("raw,out", [
    ("482915 is your OTP for login", "<OTP> is your OTP for login"), ("OTP is 4521", "OTP is <OTP>"), ("OTP 123", "OTP 123"), ("hotpot 1234", "hotpot 1234"), ("ओटीपी 123 456", "ओटीपी <OTP>")])
def test_otps(spark, raw, out):
    assert one(spark, raw, tx.mask_otps) == out


@pytest.mark.parametrize("number,masked", [("9876543210", True), ("+91 98765 43210", True), ("1800 123 4567", True), ("011-23456789", True), ("+44 7911 123456", True), ("5876543210", False), ("12345678901234", False)])
def test_phones(spark, number, masked):
    assert one(spark, f"Call {number} now", tx.mask_phones) == ("Call <PHONE> now" if masked else f"Call {number} now")


def test_order_of_masks(spark):
    assert one(spark, "http://pay.example.com/9876543210 or call 9876543210", tx.mask_text) == "<URL> or call <PHONE>"


@pytest.mark.parametrize("raw,out", [("21st May 2005", "21st May <YEAR>"), ("Rs.500 due", "<CUR> 500 due"), ("hello , how", "hello, how"), ("> quoted\n> more", "quoted\nmore"), ("-----Original Message----- hi", "hi")])
def test_normalize(spark, raw, out):
    assert one(spark, raw, tx.normalize_text) == out


@pytest.mark.parametrize("raw,tag", [("नमस्ते आप कैसे हैं", "hi"), ("வணக்கம்", "ta"), ("আপনি কেমন", "bn"), ("kya aap ghar pe hain", "hinglish_guess"), ("hello there", "en"), ("привет как дела", "other"), ("", "en"), (None, None)])
def test_language(spark, raw, tag):
    assert one(spark, raw, tx.detect_language) == tag


def test_mojibake_and_numbers(spark):
    assert one(spark, "cafÃ©", tx.repair_latin1) == "café"
    assert one(spark, "café", tx.repair_latin1) == "café"
    assert one(spark, "4111111111111111", tx.luhn_ok) and not one(spark, "4111111111111112", tx.luhn_ok)
    assert one(spark, "PAN ABCDE1234F card 4111 1111 1111 1111 a@b.in", tx.pii_kinds) == ["aadhaar", "pan", "email", "card"]
    assert one(spark, "call 9988776655", tx.placeholder_number) is True


def test_small_functions(spark):
    assert one(spark, "https://a.b.com/x.y", tx.defang) == "hxxps://a[.]b[.]com/x.y"
    assert one(spark, "x" * 300, lambda c: tx.cap_length(c, 20)) == "x" * 17 + "..."
    assert one(spark, "1.1.1.1, 2.2.2.2", lambda c: tx.client_key(F.lit("p"), c, 1)) == "2.2.2.2"
    assert one(spark, None, lambda c: tx.client_key(F.lit("p"), c, 1)) == "p"
    df = spark.createDataFrame([(["see https://a.example/", "path and", "re-", "read"],)], "l array<string>")
    assert df.select(tx.join_lines(F.col("l"))).first()[0] == "see https://a.example/path and re-read"
