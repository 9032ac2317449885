"""Transparent scoring of links: parts, tokens, signals, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Word lists and weights of the signals.
SUSPICIOUS_TLDS = ["tk", "ml", "ga", "cf", "gq", "xyz", "top", "click", "work", "info", "club"]
SHORTENERS = ["bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "cutt.ly", "rb.gy", "tiny.cc", "shorturl.at", "rebrand.ly", "shorte.st"]
KEYWORDS = ["verify", "kyc", "update", "login", "secure", "account", "claim", "gift", "reward", "prize", "bonus", "refund", "blocked", "suspend", "urgent", "immediately"]
WEIGHTS = {
    "listed": 0.9, "ip": 0.35, "punycode": 0.35, "combosquat": 0.4, "brand_subdomain": 0.4, "lookalike": 0.4, "shortener": 0.2, "tld": 0.15, "subdomains": 0.15,
    "keyword": 0.1, "keyword_most": 0.3, "at": 0.3, "long": 0.1, "no_https": 0.1,
}
MAX_LENGTH, MAX_SUBDOMAINS, LOOKALIKE_DISTANCE, LOOKALIKE_LEAST = 75, 2, 2, 5
# Public suffixes of more than one label that the links here may end with.
LONG_SUFFIXES = ["co.in", "org.in", "net.in", "gov.in", "ac.in", "nic.in", "firm.in", "gen.in", "ind.in", "co.uk", "org.uk", "gov.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.za"]
# Brand names and their own domains; the first that matches wins.
BRANDS = [
    (["sbi"], ["sbi.co.in", "onlinesbi.sbi", "onlinesbi.com"]), (["hdfc", "hdfcbank"], ["hdfcbank.com"]), (["icici", "icicibank"], ["icicibank.com"]),
    (["axis", "axisbank"], ["axisbank.com"]), (["pnb", "pnbindia"], ["pnbindia.in", "netpnb.com"]), (["kotak"], ["kotak.com"]), (["bankofbaroda"], ["bankofbaroda.in"]),
    (["canara", "canarabank"], ["canarabank.com"]), (["unionbank", "unionbankofindia"], ["unionbankofindia.co.in"]), (["indianbank"], ["indianbank.in"]),
    (["idbi", "idbibank"], ["idbibank.in"]), (["yesbank"], ["yesbank.in"]), (["tatacapital"], ["tatacapital.com"]), (["paytm"], ["paytm.com"]), (["phonepe"], ["phonepe.com"]),
    (["googlepay"], ["pay.google.com"]), (["gpay"], ["pay.google.com"]), (["bhim"], ["bhimupi.org.in"]), (["mobikwik"], ["mobikwik.com"]), (["cred"], ["cred.club"]),
    (["razorpay"], ["razorpay.com"]), (["indiapost"], ["indiapost.gov.in"]), (["speedpost"], ["indiapost.gov.in"]), (["dhl"], ["dhl.com"]), (["fedex"], ["fedex.com"]),
    (["bluedart"], ["bluedart.com"]), (["delhivery"], ["delhivery.com"]), (["dtdc"], ["dtdc.in"]), (["ecomexpress"], ["ecomexpress.in"]), (["amazon"], ["amazon.in", "amazon.com"]),
    (["flipkart"], ["flipkart.com"]), (["meesho"], ["meesho.com"]), (["myntra"], ["myntra.com"]), (["snapdeal"], ["snapdeal.com"]), (["uidai"], ["uidai.gov.in"]),
    (["incometax"], ["incometax.gov.in"]), (["irctc"], ["irctc.co.in"]), (["microsoft"], ["microsoft.com", "live.com", "outlook.com"]), (["apple"], ["apple.com", "icloud.com"]),
    (["netflix"], ["netflix.com"]), (["whatsapp"], ["whatsapp.com"]), (["google"], ["google.com"]), (["facebook"], ["facebook.com"]), (["instagram"], ["instagram.com"]),
]


def _list(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds scheme, netloc, path, host, suffix, domain, subdomain; links without a scheme are read as if they had one."""
    u = F.trim(F.col(url))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    df = df.withColumn("scheme", F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))
    df = df.withColumn("netloc", F.regexp_extract(rest, r"^[^/?#]*", 0))
    df = df.withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))
    host = F.lower(F.regexp_replace(F.regexp_replace(F.col("netloc"), "^.*@", ""), r":\d*$", ""))
    df = df.withColumn("host", F.regexp_replace(host, r"^\[|\]$", ""))
    labels = F.split("host", r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    long = (F.size(labels) > 2) & two.isin(*LONG_SUFFIXES)
    n = F.when(long, 2).otherwise(1)
    named = F.size(labels) > n
    df = df.withColumn("suffix", F.when(named, F.when(long, two).otherwise(F.element_at(labels, -1))).otherwise(F.lit("")))
    df = df.withColumn("domain", F.when(named, F.element_at(labels, -(n + 1))).otherwise(F.col("host")))
    return df.withColumn("subdomain", F.when(named & (F.size(labels) > n + 1), F.array_join(F.slice(labels, F.lit(1), F.size(labels) - n - 1), ".")).otherwise(F.lit("")))


def tokens(c: Column, pattern: str) -> Column:
    return F.filter(F.split(F.lower(c), pattern), lambda t: t != "")


def ngrams(labels: Column) -> Column:
    """Labels and neighbouring labels run together."""
    pairs = F.zip_with(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0))), F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.concat(labels, F.when(F.size(labels) > 1, pairs).otherwise(F.array().cast("array<string>"))))


def first_brand(test) -> Column:
    """Longest name of the first brand for which ``test(names, domains)`` holds, else null."""
    return F.coalesce(*[F.when(test(n, d), F.lit(max(n, key=len))) for n, d in BRANDS])


def normalized(url: Column) -> Column:
    """Lower-case scheme and host, no trailing slash, no query: the form lists are compared in."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.concat(scheme, F.lit("://"), F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), "/+$", ""))


def is_ip(host: Column) -> Column:
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return host.rlike(rf"^{octet}(?:\.{octet}){{3}}$") | (host.contains(":") & host.rlike("^[0-9a-f:.]+$"))


def score_urls(df: DataFrame, listed: DataFrame | None = None, url: str = "url", source_name: str = "blocklist") -> DataFrame:
    """Adds score, reasons (in signal order), band and the parts of every link.

    ``listed`` holds known bad links in a column ``url``; it is joined on the
    normalised form and broadcast only if Spark finds it small. Null links get
    score 0 and no reasons.
    """
    df = url_parts(df, url).withColumn("__n", normalized(F.col(url)))
    if listed is not None:
        bad = listed.where("url is not null").select(normalized(F.col("url")).alias("__n")).distinct().withColumn("__listed", F.lit(True))
        df = df.join(bad, "__n", "left")
    else:
        df = df.withColumn("__listed", F.lit(None).cast("boolean"))
    df = df.withColumn("__ip", is_ip(F.col("host")))
    registered = F.when(F.col("suffix") != "", F.concat_ws(".", "domain", "suffix")).otherwise(F.col("domain"))
    named = ~F.col("__ip")
    grams = F.array_union(ngrams(tokens(F.col("subdomain"), r"[.\-_]+")), ngrams(tokens(F.col("domain"), r"[.\-_]+")))
    combo = first_brand(lambda n, d: ~registered.isin(*d) & F.arrays_overlap(grams, _list(n)))
    padded = F.concat(F.lit("."), F.lower("subdomain"), F.lit("."))
    sub = first_brand(lambda n, d: F.lit(False) if not d else _any([(registered != x) & padded.contains(f".{x}.") for x in d]) & (F.col("subdomain") != ""))
    look = first_brand(lambda n, d: _any([(F.col("domain") != x) & (F.levenshtein(F.col("domain"), F.lit(x)) <= LOOKALIKE_DISTANCE) for x in n if len(x) >= LOOKALIKE_LEAST]))
    inside = F.when(F.col("__ip"), F.lit("")).otherwise(F.concat_ws(" ", "subdomain", "domain"))
    words = F.array_sort(F.array_intersect(F.array_distinct(tokens(F.concat_ws(" ", inside, F.col("path")), "[^a-z0-9]+")), _list(KEYWORDS)))
    df = df.withColumn("__combo", F.when(named, combo)).withColumn("__sub", F.when(named, sub)).withColumn("__look", F.when(named, look)).withColumn("__words", words)
    deep = F.size(F.filter(F.split("subdomain", r"\."), lambda x: x != "")) > MAX_SUBDOMAINS

    def signal(on, weight, reason):
        w = F.lit(float(weight)) if not isinstance(weight, Column) else weight
        return F.when(on, F.struct(w.alias("w"), reason.alias("reason")))

    s = [
        signal(F.col("__listed"), WEIGHTS["listed"], F.lit(f"Listed in {source_name} as a known phishing URL")),
        signal(F.col("__ip"), WEIGHTS["ip"], F.format_string("URL uses a raw IP address (%s) instead of a domain name", "host")),
        signal(F.exists(F.split("host", r"\."), lambda x: x.startswith("xn--")), WEIGHTS["punycode"], F.lit("Domain uses punycode (xn--), a possible homoglyph/lookalike-character attack")),
        signal(F.col("__combo").isNotNull(), WEIGHTS["combosquat"], F.format_string('Domain embeds the brand name "%s" but is not %s\'s real domain', "__combo", "__combo")),
        signal(F.col("__sub").isNotNull(), WEIGHTS["brand_subdomain"], F.format_string('"%s"\'s real domain appears as a subdomain of a different site', "__sub")),
        signal(F.col("__look").isNotNull(), WEIGHTS["lookalike"], F.format_string('Domain "%s" closely resembles the brand "%s" (possible typo-squat)', "domain", "__look")),
        signal(named & registered.isin(*SHORTENERS), WEIGHTS["shortener"], F.format_string("Uses a URL shortener (%s); real destination is hidden", registered)),
        signal(named & F.element_at(F.split("suffix", r"\."), -1).isin(*SUSPICIOUS_TLDS), WEIGHTS["tld"], F.format_string("Uses a top-level domain often abused for phishing (.%s)", "suffix")),
        signal(named & deep, WEIGHTS["subdomains"], F.lit("URL has an unusually high number of subdomains")),
        signal(F.size("__words") > 0, F.least(F.lit(WEIGHTS["keyword_most"]), F.lit(WEIGHTS["keyword"]) * F.size("__words")), F.concat(F.lit("URL contains suspicious keyword(s): "), F.array_join("__words", ", "))),
        signal(F.col("netloc").contains("@"), WEIGHTS["at"], F.lit('URL contains "@", which can hide the real destination after a fake-looking address')),
        signal(F.length(url) > MAX_LENGTH, WEIGHTS["long"], F.format_string("Unusually long URL (%d characters)", F.length(url))),
        signal(F.col("scheme") != "https", WEIGHTS["no_https"], F.lit("Connection is not HTTPS")),
    ]
    df = df.withColumn("__s", F.array_compact(F.array(*s)))
    total = F.aggregate("__s", F.lit(0.0), lambda a, x: a + x["w"])
    df = df.withColumn("score", F.when(F.col(url).isNull(), 0.0).otherwise(F.least(F.lit(1.0), total)))
    df = df.withColumn("reasons", F.when(F.col(url).isNull(), F.array().cast("array<string>")).otherwise(F.transform("__s", lambda x: x["reason"])))
    return df.withColumn("band", risk_band(F.col("score"))).drop("__n", "__listed", "__ip", "__combo", "__sub", "__look", "__words", "__s")


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def risk_band(score: Column) -> Column:
    return F.when(score < 0.3, "low").when(score < 0.6, "medium").otherwise("high")


def worst_band(bands: Column) -> Column:
    """The most severe band of an array, ``none`` for no links."""
    rank = F.transform(bands, lambda b: F.when(b == "high", 3).when(b == "medium", 2).otherwise(1))
    return F.element_at(F.array(F.lit("none"), F.lit("low"), F.lit("medium"), F.lit("high")), F.coalesce(F.array_max(rank), F.lit(0)) + 1)


def brand_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, d) for i, (n, d) in enumerate(BRANDS)], "ord int, names array<string>, legit_domains array<string>")
