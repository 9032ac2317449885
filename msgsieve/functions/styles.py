"""Subtypes of promotional messages, styles of a language, and texts that hold secrets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import collapse, casefold, detect_language

# Cues of fraud and of service notices in promotional messages.
FRAUD_CUES = (
    r"(?i)\b(crore|lottery|winning fund|kbc|kyc|aadhaar|aadhar|arrest|customs|share (?:your )?otp"
    r"|(?:account|sim|number)\s+(?:will be|has been|is going to be|is)\s+(?:blocked|suspended|frozen|disconnected|deactivated))\b"
)
SHARE_CODE = r"(?i)(?<!not )(?<!n't )\bshare (?:your |the )?otp\b"
SERVICE_CUES = r"(?i)\byour otp\b|\botp (?:for|is)\b|do not share|missed call|data quota|as on \d|to cancel a vas|sms stop to|credited to your (?:a/c|account)|debited"
# Prefixes of rows settled by hand.
SETTLED = {
    "dear , prize pool- 5,00,00,000": "promo", "dear employee, get rs. 250 cash": "promo", "uidai recommends updating proof": "service", "beware of fake calls claiming t": "service",
}
# Keys and tokens as services issue them.
SECRETS = r"gsk_[A-Za-z0-9]{10,}|hf_[A-Za-z0-9]{10,}|AIza[0-9A-Za-z_\-]{20,}|KGAT[_A-Za-z0-9]{10,}"


def spam_subtype(c: Column, settled: dict[str, str] = SETTLED) -> Column:
    """fraud, service or promo of a promotional message; settled prefixes first, then a demand for a code. Null stays null."""
    start = collapse(casefold(c))
    out = None
    for prefix, kind in settled.items():
        out = F.when(start.startswith(prefix), kind) if out is None else out.when(start.startswith(prefix), kind)
    service = c.rlike(SERVICE_CUES)
    rest = F.when(c.rlike(SHARE_CODE), "fraud").when(service, "service").when(c.rlike(FRAUD_CUES), "fraud").when(c.isNotNull(), "promo")
    return rest if out is None else out.otherwise(rest)


def language_matches(c: Column, language: Column, markers: dict[str, tuple[str, list[str]]] | None = None) -> Column:
    """Whether a text is in the script and style asked for.

    ``markers`` gives per mixed style its own script's tag and words that also satisfy it. Styles without a rule match.
    """
    tag = detect_language(c)
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    out = F.when(language == "hi", tag == "hi").when(language == "hinglish", tag != "hi").when(language == "en", tag.isin("en", "hinglish_guess"))
    for style, (script, known) in (markers or {}).items():
        out = out.when(language == style, (tag == script) | F.arrays_overlap(words, F.array(*map(F.lit, known))))
    return F.when(c.isNotNull(), out.otherwise(F.lit(True)))


def has_secret(c: Column) -> Column:
    return F.coalesce(c.rlike(SECRETS), F.lit(False))


def scan_for_secrets(spark, folder: str):
    """(path): files below a folder that hold something like a key."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder)
    return files.where(has_secret(F.col("value"))).select(F.col("_metadata.file_path").alias("path"))
