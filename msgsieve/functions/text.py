"""Column functions on message texts: cleaning, masks, normalisation, keys, language and number checks."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Invisible characters that are dropped; the joiners ZWJ and ZWNJ are kept.
INVISIBLE = "﻿​‎‏⁠­"
# Top-level domains a bare address may end with.
TLDS = (
    "com|in|net|org|co|info|biz|xyz|top|club|online|site|link|live|app|shop|store|vip|cc|tk|ml|ga|cf|gq|ly|me|us|io|gov|edu|ru|cn|uk|page|help|support|click|work|cyou|icu"
)
# Patterns of links, one-time codes and phone numbers.
_URL_CHAR = r"""[^\s<>"'\)\]।]"""
URL = rf"""(?iU)(?:(?:https?://|ftp://|www\.){_URL_CHAR}+|(?<![@\w.-])(?:[a-z0-9-]+\.)+(?:{TLDS})(?![a-z0-9-])(?:/{_URL_CHAR}*)?)(?<![.,;:!?)\]}}>'"])"""
_OTP_WORD = (
    r"(?:(?<![a-z])(?:o\.?t\.?p|one[\s-]?time[\s-]?(?:password|pin|passcode|code)|verification[\s-]?(?:code|pin)|security[\s-]?code|authentication[\s-]?code"
    r"|login[\s-]?code|passcode)(?![a-z])|ओटीपी)"
)
_OTP_NUM = r"(?:(?<!\d)\d{4,8}(?!\d)|(?<!\d)\d{3}[ -]\d{3}(?!\d))"
_OTP_GAP = r"[^\d\n.!?]{0,20}?"
OTP_AFTER = rf"(?iU)({_OTP_WORD})({_OTP_GAP})({_OTP_NUM})"
OTP_BEFORE = rf"(?iU)({_OTP_NUM})({_OTP_GAP})({_OTP_WORD})"
PHONE = (
    r"(?U)(?<![\d\w])(?:(?:\+91[\s.-]?|91[\s.-]?|0)?(?:[6-9]\d{4}[\s.-]?\d{5}|[6-9]\d{2}[\s.-]?\d{3}[\s.-]?\d{4})"
    r"|1(?:800|860)[\s.-]?\d{2,4}[\s.-]?\d{3,4}|(?:\+91[\s.-]?\d{2,4}[\s-]|0\d{1,4}[\s-])\d{6,8}"
    r"|\+(?!91)\d{1,3}[\s-]?\(?\d{2,5}\)?(?:[\s-]?\d{2,5}){1,3})(?![\d\w])"
)
# Patterns of mail residue, years and currency.
QUOTE_START, QUOTE_WROTE, QUOTE_ALONE = r"(?m)^[ \t]*(?:>[ \t]*)+", r"(?i)(wrote\s*:)\s*>+", r"(?U)(?<=\s)>+(?=\s)"
BOILERPLATE = (
    r"(?iU)\bon\b[^\n>]{0,90}?\bwrote\s*:?",
    r"(?iU)(?:-\s?){2,}\s*original message\s*(?:-\s?){2,}",
    r"(?iU)(?:-\s?){3,}\s*forwarded by\b[^\n]{0,90}?\bon\s+\d{1,2}\s?/\s?\d{1,2}\s?/\s?\d{2,4}(?:\s+\d{1,2}\s?:\s?\d{2}(?:\s?[ap]m)?)?(?:\s*(?:-\s?){3,})?",
    r"(?iU)\bforwarded by\b[^\n]{0,90}?\bon\s+\d{1,2}\s?/\s?\d{1,2}\s?/\s?\d{2,4}(?:\s+\d{1,2}\s?:\s?\d{2}(?:\s?[ap]m)?)?",
    r"(?U)(?:-\s?){5,}",
)
YEARS = r"(?U)\b(?:199\d|200\d|2010)\b"
CURRENCY = r"(?iU)(?:£|€|₹|\$|\brs\.?\s?|\binr\s?)(?=\d)"
SPACED_PUNCT = r"[ \t]+([.,;:!?])(?=\s|$)"
WEB_CRAWL, PIPELINE_NOTICE = r"\A\s*URL:\s*https?://", r"(?i)hourahead|schedule crawler"
INTERNAL_MAIL = r"(?i)\benron\b|\benronxgate\b|\bhpl\b|/\s*ect\b|\bect\b|/\s*hou\s*/|\bkaminski\b|\bvince j\b"
# Blocks of Indic scripts and their tags.
SCRIPT_BLOCKS = {"hi": "ऀ-ॿ", "bn": "ঀ-৿", "pa": "਀-੿", "gu": "઀-૿", "or": "଀-୿", "ta": "஀-௿", "te": "ఀ-౿", "kn": "ಀ-೿", "ml": "ഀ-ൿ"}
# Words of Hindi in Latin letters, and more of them for the choice of an output language.
HINGLISH = (
    "hai hain tha thi hoga hogi honge raha rahi rahe rahega kya kyun kyu kaise kab kahan kaun kitna kitne aap aapka aapke aapki apna apni apka apke tum tumhara hum humara mera meri mere "
    "nahi nahin karo kro kijiye kijie kare karein kiya kiye karna karenge jayega jaayega jayegi gaya gayi gaye abhi turant jaldi aaj liye wala wale wali sath saath mein aur lekin magar "
    "isliye kyunki kyonki yeh woh isko usko unko bhi toh paisa paise rupaye rupay bhai dost kripya dhanyavaad shukriya milega milegi chalu"
).split()
HINGLISH_MORE = HINGLISH + (
    "ke ki ka ko hua hui baje milte milenge atka bharo karke batao chahiye sakte sakta wapas paas yahan wahan kuch sab bahut accha acha theek thik mujhe tujhe tera teri tere hamare unka "
    "unki uska uski raho dijiye bataiye bhejiye sirf zaroor jarur lagta yaar"
).split()


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC; Spark has no function for it."""
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def collapse(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    """NFC, invisible marks dropped, controls and white space to single blanks. Null stays null."""
    return collapse(F.regexp_replace(F.translate(nfc(c), INVISIBLE, ""), r"\p{Cc}", " "))


def mask_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, "<URL>")


def extract_urls(c: Column) -> Column:
    """The links in order, without punctuation after them."""
    return F.regexp_extract_all(c, F.lit(URL), F.lit(0))


def mask_otps(c: Column) -> Column:
    """4-8 digits, or three and three, next to a word for a one-time code, in either order."""
    return F.regexp_replace(F.regexp_replace(c, OTP_AFTER, "$1$2<OTP>"), OTP_BEFORE, "<OTP>$2$3")


def mask_phones(c: Column) -> Column:
    return F.regexp_replace(c, PHONE, "<PHONE>")


def mask_text(c: Column) -> Column:
    """Links, then codes, then phones."""
    return mask_phones(mask_otps(mask_urls(c)))


def preprocess_text(c: Column) -> Column:
    return mask_text(clean_text(c))


def strip_quote_markers(c: Column) -> Column:
    c = F.regexp_replace(c, QUOTE_START, "")
    return F.regexp_replace(F.regexp_replace(c, QUOTE_WROTE, "$1"), QUOTE_ALONE, "")


def strip_reply_boilerplate(c: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, " "), BOILERPLATE, c)


def mask_years(c: Column) -> Column:
    return F.regexp_replace(c, YEARS, "<YEAR>")


def normalize_currency(c: Column) -> Column:
    return F.regexp_replace(c, CURRENCY, "<CUR> ")


def fix_spacing(c: Column) -> Column:
    return F.regexp_replace(c, SPACED_PUNCT, "$1")


def normalize_text(c: Column, quotes=True, boilerplate=True, years=True, currency=True, spacing=True) -> Column:
    """The switched-on steps in their fixed order, then blanks are tidied."""
    steps = [(boilerplate, strip_reply_boilerplate), (quotes, strip_quote_markers), (years, mask_years), (currency, normalize_currency), (spacing, fix_spacing)]
    if not any(on for on, _ in steps):
        return c
    c = reduce(lambda t, s: s[1](t) if s[0] else t, steps, c)
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}", " "), r"(?U)^\s+|\s+$", "")


def drop_reason(c: Column, web_crawl=True, pipeline=True, internal=True) -> Column:
    """Why a row is no message: the first matching reason, else null."""
    tests = [
        (web_crawl, "web_crawl", c.rlike(WEB_CRAWL) & c.contains("Date:")),
        (pipeline, "pipeline_notice", c.rlike(PIPELINE_NOTICE)),
        (internal, "internal_mail", c.rlike(INTERNAL_MAIL)),
    ]
    return F.coalesce(*[F.when(t, F.lit(n)) for on, n, t in tests if on], F.lit(None).cast("string"))


def casefold(c: Column) -> Column:
    """Lower case with the two letters for which that is not enough here."""
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def dedup_key(c: Column) -> Column:
    return collapse(casefold(c))


def make_id(c: Column) -> Column:
    return F.substring(F.sha1(F.encode(c, "UTF-8")), 1, 12)


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def script_tag(c: Column, least_share: float = 0.2) -> Column:
    """Tag of the Indic script with the most letters if it has ``least_share`` of all; ties go to the script seen first."""
    letters = count_of(c, r"[\p{L}\p{M}]")
    found = F.array(*[
        F.struct(count_of(c, f"[{b}&&[\\p{{L}}\\p{{M}}]]").alias("n"), (-F.regexp_instr(c, F.lit(f"([{b}&&[\\p{{L}}\\p{{M}}]])"))).alias("first"), F.lit(t).alias("tag"))
        for t, b in SCRIPT_BLOCKS.items()
    ])
    best = F.array_max(F.filter(found, lambda s: s["n"] > 0))
    return F.when((letters > 0) & (best["n"] / letters >= least_share), best["tag"])


def hinglish_hits(c: Column, words: list[str]) -> Column:
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    return F.size(F.array_intersect(tokens, F.array(*map(F.lit, words))))


def detect_language(c: Column, words: list[str] = HINGLISH, long_words: int | None = None) -> Column:
    """A script tag, ``hinglish_guess``, ``other`` or ``en``; null for null."""
    letters = count_of(c, r"[\p{L}\p{M}]")
    need = F.lit(2)
    if long_words is not None:
        need = need + (count_of(F.lower(c), "[a-z]+") > long_words).cast("int")
    tag = F.when((letters > 0) & (count_of(c, "[A-Za-z]") / letters < 0.5), "other").when(hinglish_hits(c, words) >= need, "hinglish_guess").otherwise("en")
    return F.when(c.isNotNull(), F.coalesce(script_tag(c), tag))


def output_language(c: Column) -> Column:
    """en, hi or hinglish, with one marker word more for texts above 60 words."""
    t = detect_language(c, HINGLISH_MORE, 60)
    return F.when(t == "hi", "hi").when(t == "hinglish_guess", "hinglish").when(c.isNotNull(), "en")


def repair_latin1(c: Column, rounds: int = 2) -> Column:
    """Undoes UTF-8 read as Latin-1, once or twice; text that is no such case stays as it is."""
    for _ in range(rounds):
        c = _latin1_round(c)
    return c


def _latin1_round(c: Column) -> Column:
    fits = c.rlike(r"^[\x00-\xFF]*$") & c.rlike(r"[\x80-\xFF]")
    once = F.encode(F.when(fits, c), "ISO-8859-1").cast("string")
    return F.when(F.is_valid_utf8(once), once).otherwise(c)


def luhn_ok(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


# Patterns of identity, mail, card and account numbers.
AADHAAR = r"(?U)(?<!\d)[2-9]\d{3}[\s-]\d{4}[\s-]\d{4}(?!\d)|(?<!\d)(?!91)[2-9]\d{11}(?!\d)"
PAN, MAIL = r"(?U)\b[A-Z]{5}\d{4}[A-Z]\b", r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)*"
CARD = r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)"
ACCOUNT = r"(?iU)\b(?:a/c|acct|account)\b(?:\s*(?:no|number|num|#))?\.?[\s:.-]*\d{9,18}\b"
PLACEHOLDER_MOBILE, DOUBLED = r"(?<!\d)[6-9](?:[\s-]?\d){9}(?!\d)", r"(\d)\1(\d)\2(\d)\3"


def pii_kinds(c: Column) -> Column:
    """Names of the patterns found, in fixed order."""
    cards = F.regexp_extract_all(c, F.lit(CARD), F.lit(0))
    card = F.exists(cards, lambda x: luhn_ok(F.regexp_replace(x, r"[^0-9]", "")))
    tests = [("aadhaar", c.rlike(AADHAAR)), ("pan", c.rlike(PAN)), ("email", c.rlike(MAIL)), ("card", card), ("account_number", c.rlike(ACCOUNT))]
    return F.array_compact(F.array(*[F.when(t, n) for n, t in tests]))


def placeholder_number(c: Column) -> Column:
    """A mobile number of at most four different digits, or with three doubled pairs."""
    nums = F.transform(F.regexp_extract_all(c, F.lit(PLACEHOLDER_MOBILE), F.lit(0)), lambda x: F.regexp_replace(x, r"[^0-9]", ""))
    return F.exists(nums, lambda d: (F.size(F.array_distinct(F.split(d, ""))) <= 4) | d.rlike(DOUBLED))


def defang(url: Column) -> Column:
    """hxxp and [.] in the host, so that a link can't be followed."""
    scheme = F.regexp_replace(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)?", 0), "(?i)^http", "hxxp")
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.concat(scheme, F.replace(host, F.lit("."), F.lit("[.]")), F.substring(rest, F.length(host) + 1, F.length(rest)))


def cap_length(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, most - 3)), F.lit("...")))


def cap_list(items: Column, most: int = 6, length: int = 200) -> Column:
    return F.transform(F.slice(items, 1, most), lambda x: cap_length(x, length))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def client_key(peer: Column, forwarded: Column, hops: int) -> Column:
    """The address ``hops`` places from the end of a forwarded-for list, else the peer."""
    if hops <= 0:
        return peer
    parts = F.filter(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) >= hops, F.element_at(parts, -hops)).otherwise(peer)


# What screenshots hold besides the message.
CLOCK = r"(?i)^(?:[01]?\d|2[0-3])[:.][0-5]\d\s?(?:[ap]\.?m\.?)?$"


def strip_trailing_time(line: Column) -> Column:
    """A message bubble's clock and ticks at the end of a line."""
    return F.rtrim(F.regexp_replace(line, r"(?i)\s+(?:[01]?\d|2[0-3])[:.][0-5]\d\s?(?:[ap]\.?m\.?)?\s?[✓√vV/]{0,4}\s*$", ""))


def devanagari_digits(c: Column) -> Column:
    return F.translate(c, "०१२३४५६७८९", "0123456789")


def join_lines(lines: Column) -> Column:
    """Visual lines to a paragraph: wrapped links and trailing hyphens are glued, the rest gets a blank."""
    def step(acc, x):
        last = F.regexp_extract(acc, r"(\S*)$", 1)
        glue = (last.rlike(r"(?i)^(?:https?://|www\.)\S*[/\-_.=?&]$")) | last.rlike(r"\w-$")
        return F.when(acc == "", x).when(glue, F.concat(acc, x)).otherwise(F.concat_ws(" ", acc, x))

    return F.aggregate(lines, F.lit(""), step)
