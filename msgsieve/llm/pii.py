"""Personal information in free text, found by anchor expansion (problem 5).

One Aho-Corasick pass over a text finds all anchors: at-signs and their
disguises, schemes and the slashes of links, captions of identities, house and
street words, titles, mail headers, phrases that present a person, and given
names. From every anchor a deterministic local parser walks to the value's bounds and
validates it. Only phone numbers and identity numbers without a caption have no sign of their own:
their anchors are runs of digits in the shapes that such numbers have. Values are reported
with a normal form per kind, and the text keeps everything else around typed placeholders.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

EMAIL, PHONE, ID, ADDRESS, PERSON = "email", "phone", "id_number", "address", "person"
PLACEHOLDER = {EMAIL: "<EMAIL>", PHONE: "<PHONE>", ID: "<ID_NUMBER>", ADDRESS: "<ADDRESS>", PERSON: "<PERSON>"}

# Given names common where these messages are written, in Latin letters.
_GIVEN = (
    "aarav aditi aditya ahmed aisha ajay akash alejandro alicia amit amita ana anand andrea andres anil anita anjali ankit antonio anu arjun arun asha ashok "
    "bina carlos carmen clara daniel david deepa deepak diego divya elena emma farah fatima fernando francisco gabriel gopal hari harish hugo imran irene isabel "
    "james javier jorge jose juan julia kavita kiran krishna lakshmi latha laura lucia luis madhu manoj manuel marcos maria marta meena meera miguel mohan mohini "
    "mukesh nadia neha nikhil nisha owen pablo pedro pooja pradeep prakash priya rafael rahul raj rajesh raju rakesh ramesh rani ravi rekha rohan rohit sandeep "
    "sanjay sara seema sergio shreya sofia sonia sunil sunita suresh teresa tobias usha vijay vikram vinod yusuf"
).split()
# The same kind of names in Indic scripts.
_GIVEN_INDIC = (
    "अनिल अजय अमित अनीता अर्जुन अरुण आशा इमरान कविता किरण गोपाल दिव्या दीपक नेहा पूजा प्रिया बीना मीरा मोहन मोहिनी यूसुफ राजेश रमेश राहुल रोहन लता विक्रम विजय संजय सुनील सुनीता हरीश फराह "
    "अनील संजय सुनिता मीरा অনিল অর্জুন কবিতা গোপাল দিব্যা নেহা পূজা মীরা মোহিনী রোহন লতা বিক্রম সঞ্জয় সুনীতা ইমরান হরিশ அனில் அர்ஜுன் கவிதா கோபால் திவ்யா நேஹா பூஜா மீரா மோகினி ரோகன் லதா விக்ரம் சஞ்சய் சுனிதா இம்ரான் ஹரிஷ்"
).split()
# Words that end the name of a firm, a place or an office; such a name is no person.
_NOT_LAST = set(
    "bank pay wallet mart retail telecom broadband insurance mutual finance credit power electric logistics courier cargo ltd limited inc corp llc group company "
    "nagar road street lane marg avenue ave colony residency cross temple sector plot salai team desk office branch manager lead officer keeper accounts "
    "the and from about will said wrote has have is was were ji ne se ko ka ki mein bol raha rahi hoon hai on at to for in with of an by or as it please dear sent date subject cc "
    "de la el los por para con sobre en y a del al su un una que es fecha enviado asunto baje".split()
)

# Captions of identity, tax, passport, card and account numbers.
_ID_CUES = (
    "aadhaar|aadhar|adhar|uidai|uid|identity|national id|id card|id proof|pan card|pan|passport|pasaporte|dni|nie|nif|tax id|tin|ssn|voter id|epic|driving license|driving licence"
    "|license|licence|documento|cuenta|tarjeta|debit card|credit card|atm card|card|a/c|acct|account|iban|ration card|khata|आधार|पैन|पासपोर्ट|खाता|কার্ড|আধার|ஆதார்"
).split("|")
_ID_CUE = "|".join(map(re.escape, _ID_CUES))
_ID_VALUE = re.compile(
    r"(?:\s*(?:number|numero|número|num|no|nr|id|#|नंबर|संख्या|সংখ্যা|எண்))?\s*[.:#!=-]*\s*(?:is\s+|hai\s+|es\s+)?"
    r"([A-Za-z]{0,5}\d[\dA-Za-z]*(?:[ -]\d[\dA-Za-z]*)*(?:[ -]?[A-Za-z](?![\w]))?)",
    re.I,
)
_PAN = re.compile(r"(?<![\w])[A-Za-z]{5}\d{4}[A-Za-z](?![\w])")
_GROUPED = re.compile(r"(?<![\w.,/+-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{4}\2\d{4})(?![\w]|[.,-]\d)")
_CARD = re.compile(r"(?<![\w.,/+-])(?:4\d{15}|5[1-5]\d{14})(?![\w]|[.,-]\d)")
_PASSPORT = re.compile(r"(?<![\w-])[A-Za-z]\d{7}(?![\w])")
_CODED = re.compile(r"(?:cn|nx|inv|ref|trk|utr|awb)", re.I)
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
_DNI = re.compile(r"(?<![\w])\d{8}-?[A-Za-z](?![\w])")
_SHAPES = (
    re.compile(r"[A-Z]{5}\d{4}[A-Z]"), re.compile(r"\d{12}"), re.compile(r"\d{13,19}"), re.compile(r"[A-Z]{1,2}\d{6,8}"), re.compile(r"\d{8}[A-Z]"),
    re.compile(r"[XYZ]\d{7}[A-Z]"), re.compile(r"\d{9,18}"), re.compile(r"[A-Z]{3}\d{7}"), re.compile(r"[A-Z]{2}\d{13}"), re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{10,30}"),
)
# Captions of numbers that are no one's identity.
_OTHER_NUMBER = re.compile(
    r"(?:order|invoice|ticket|reference|ref|utr|awb|trk|track(?:ing)?|cn|nx|inv|transaction|txn|booking|parcel|consignment|docket|complaint|request|otp|code|pin|gstin?|cin|batch|serial|model|pedido|factura|guia|guía|referencia|pnr)"
    r"(?:\s*(?:number|no|nr|id|code|#|num))?\s*[.:#-]*\s*$",
    re.I,
)

_LOCAL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*"
_DOMAIN = rf"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:(?:\.|\s?(?:\[dot\]|\(dot\)|\{{dot\}}| dot )\s?)[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"
# The at-sign and its disguises, and the schemes that lead to contact data.
_AT_SIGNS = ("@", "＠", "[at]", "(at)", "{at}", "<at>", "[arroba]", "(arroba)", "{arroba}", "%40", "&#64;")
_SPOKEN = (" at ", " arroba ")
_SCHEMES = ("http://", "https://", "www.")
_DIAL = ("wa.me/", "tel:", "callto:", "phone=")
_SPOKEN_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\s(?:dot|punto)\s[A-Za-z0-9-]+)+", re.I)

_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"'।]+|(?<![\w@.])(?:[a-z0-9-]+\.)+[a-z]{2,}/[^\s<>\"'।]*", re.I)
_DIALLED = re.compile(r"\+?\d{10,13}")
_PARAM = re.compile(r"[?&;]([\w.-]+)=([^&;#\s]+)")
# Names of link parameters that carry contact data.
_PHONE_PARAMS = {"tel", "phone", "mobile", "mob", "msisdn", "whatsapp", "cell", "contact", "ph", "number", "telefono", "movil"}


def _digits(s: str) -> str:
    return "".join(str(unicodedata.digit(c)) for c in s if c.isdigit())


def _mail_key(local: str, domain: str) -> str | None:
    d = re.sub(r"\s?(?:\[dot\]|\(dot\)|\{dot\})\s?|\s(?:dot|punto)\s", ".", domain, flags=re.I).strip(".-")
    local = local.strip(".-")
    if "." not in d or not local or len(d.rsplit(".", 1)[1]) < 2 or d.rsplit(".", 1)[1].isdigit():
        return None
    return f"{local}@{d}".lower()


_LOCAL_CHARS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN_START = re.compile(_DOMAIN, re.I)


def _local_before(text: str, end: int) -> str:
    """The longest local part of a mail address that ends here."""
    s = end
    while s and text[s - 1] in _LOCAL_CHARS:
        s -= 1
    while s < end and not text[s].isalnum():
        s += 1
    return text[s:end]


def find_emails(text: str, found: Anchors) -> list[tuple[int, int, str]]:
    out = []
    for s, e, sign in found[AT]:
        left, right = s, e
        spaced = left and text[left - 1].isspace()
        if spaced and sign not in ("%40", "&#64;"):
            left -= 1
        if right < len(text) and text[right].isspace() and (spaced or len(sign) > 1) and sign not in ("%40", "&#64;"):
            right += 1
        local, domain = _local_before(text, left), _DOMAIN_START.match(text, right)
        if not local or not domain:
            continue
        if sign == "%40":
            local = re.split(r"[=&?/%:]", local)[-1]
        key = _mail_key(local, domain.group())
        if key:
            out.append((left - len(local), domain.end(), key))
    for s, e, _ in found[SPOKEN]:
        local, domain = _local_before(text, s), _SPOKEN_DOMAIN.match(text, e)
        key = _mail_key(local, domain.group()) if local and domain else None
        if key:
            out.append((s - len(local), domain.end(), key))
    return out


def phone_key(raw: str) -> str | None:
    """The last ten digits of a number that can be dialled, else None."""
    if "(0)" in raw:
        raw = raw.replace("(0)", "")
    d = _digits(raw)
    if d.startswith(("1800", "1860", "1900")) and len(d) in (10, 11):
        return d[-10:]
    if len(d) < 10 or len(d) > 13:
        return None
    if len(d) == 12 and not d.startswith(("91", "44", "34", "00")):
        return None
    if len(d) == 13 and not d.startswith(("091", "0091"[:3], "440")):
        return None
    if len(d) == 11 and d[0] not in "01":
        return None
    return d[-10:]


_PHONE = re.compile(
    r"(?<![\w/=#-])(?<!\d[.,])(?:"
    r"\(\+\d{1,3}\)[\s.-]?\d{5}[\s.-]?\d{5}|\+\d{1,3}[\s.-]?\(0\)[\s.-]?\d{4}[\s.-]\d{3}[\s.-]\d{3}|\+1[\s.-]?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}"
    r"|\+44[\s.-]?\d{4}[\s.-]?\d{6}|\+\d{1,3}[\s.-]?\d{5}[\s.-]?\d{5}|\+\d{1,3}[\s.-]?\d{3}[\s.-]?\d{3}[\s.-]?\d{3,4}|\+\d{1,3}[\s.-]?\d{2}(?:[\s.-]?\d{2}){4}|\+\d{1,3}[\s.-]\d{2,4}[\s.-]\d{3,4}[\s.-]?\d{4}"
    r"|\(0\d{2,4}\)[\s.-]?\d{6,8}|\(\d{3}\)[\s.-]?\d{3}[\s.-]\d{4}|0\d{2}[\s.-]\d{4}[\s.-]\d{4}|0\d{2}[\s.-]\d{8}|0\d{3}[\s.-]\d{7}|0\d{3}[\s.-]\d{4}[\s.-]\d{3}|0\d{4}[\s.-]\d{6}|0[6-9]\d{9}"
    r"|1[89][06]0[\s.-]?\d{3}[\s.-]?\d{4}|1[89][06]0[\s.-]?\d{3}[\s.-]?\d{3}|1[89][06]0[\s.-]\d{6,7}"
    r"|\d{3}[.-]\d{3}[.-]\d{4}|[6-9]\d{3}\s\d{3}\s\d{3}|[6-9]\d{4}[\s.-]\d{5}|[6-9]\d(?:\s\d{2}){4}|91[6-9]\d{9}|[6-9]\d{9}"
    r")(?![\w])(?!-\d)"
)


def find_phones(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _PHONE.finditer(text):
        before = text[max(0, m.start() - 30) : m.start()]
        if _OTHER_NUMBER.search(before):
            continue
        if m.group()[0] not in "+(" and re.search(r"(?:₹|£|€|\$|\brs\.?|\binr)\s?$", before, re.I):
            continue
        if re.search(rf"(?<![\w])(?:{_ID_CUE})(?:\s*(?:number|numero|número|no|nr|id|#))?\s*[.:#!-]*\s*$", before, re.I) and not re.search(r"\bmobile|phone", before, re.I):
            continue
        key = phone_key(m.group())
        if key:
            out.append((m.start(), m.end(), key))
    return out


def find_ids(text: str, found: Anchors) -> list[tuple[int, int, str]]:
    out = []
    for s, e, _ in found[CUE]:
        m = _ID_VALUE.match(text, e) if not s or not _is_word(text[s - 1]) else None
        if not m:
            continue
        raw = m.group(1)
        if _CODED.match(raw) or _DATE.match(raw):
            continue
        key = re.sub(r"[^0-9A-Za-z]", "", raw).upper()
        while key and not any(p.fullmatch(key) for p in _SHAPES):
            cut = re.search(r"[ -][^ -]*$", raw)
            if not cut:
                key = ""
                break
            raw = raw[: cut.start()]
            key = re.sub(r"[^0-9A-Za-z]", "", raw).upper()
        if key and sum(c.isdigit() for c in key) >= 4:
            out.append((m.start(1), m.start(1) + len(raw), key))
    for p in (_PAN, _GROUPED, _DNI, _CARD, _PASSPORT):
        for m in p.finditer(text):
            if p is not _PAN and _OTHER_NUMBER.search(text[max(0, m.start() - 30) : m.start()]):
                continue
            out.append((m.start(), m.end(), re.sub(r"[^0-9A-Za-z]", "", m.group()).upper()))
    return out


_W = r"[^\W\d_][\w’'.-]*"
_PLACE = rf"{_W}(?: {_W}){{0,2}}"
_POST = r"(?:\s*[-–,]?\s*(\d{3} ?\d{3}|\d{5})(?![\d/-]))"
# Street words, by language.
_STREET = r"(?:street|st|road|rd|lane|ln|avenue|ave|av|boulevard|blvd|drive|marg|salai|gali|galli|chowk|bazaar|path|way|court|terrace)"
_HOUSE = r"(?:flat|plot|house|door|shop|villa|apartment|apt|unit|room|block|quarter|bungalow)\s*(?:no\b|number|num|#)?\s*[.:]?|h\s?\.?\s?no\s?\.?:?|d\.no\.?"
_NUM = r"\d{1,4}[A-Za-z]?(?:[-/]\d{1,4}[A-Za-z]?)*"
_ADDRESSES = (
    # flat 17B, X Residency, 11th Cross, Town 410 098; plot no. 14, Sector 28, X Nagar, Town-790097; h.no. 4-2-21/4, X Colony, Town - 754075; door no 170/8, X salai, Town 411 066
    re.compile(rf"(?<![\w])(?:{_HOUSE})\s*{_NUM}(?:\s?[,.]\s?(?:sector|block|phase|ward|floor)\s*(?:no\.?\s*)?\d+[A-Za-z]?)?(?:\s?,\s?(?:\d+(?:st|nd|rd|th) )?{_PLACE}){{1,4}}?(?:\s?,\s?\d+(?:st|nd|rd|th) {_W})?(?:\s?,\s?{_PLACE})??{_POST}", re.I),
    # 204 X Street, Town 283 085
    re.compile(rf"(?<![\w.,/-]){_NUM} {_PLACE}? ?\b{_STREET}\b\.?(?:\s?,\s?(?:opp|near|behind|beside|opposite)\.? {_PLACE})?(?:\s?,\s?(?:apt|flat|suite|unit|floor)\.? ?{_NUM})?(?:\s?,\s?{_PLACE})??{_POST}", re.I),
    # 70 X Marg, opp. Y Temple, Town; 3301 X Ave, Apt 58, Town
    re.compile(rf"(?<![\w.,/-]){_NUM} {_PLACE}? ?\b{_STREET}\b\.?(?:\s?,\s?(?:(?:opp|near|behind|beside|opposite)\.? {_PLACE}|(?:apt|flat|suite|unit|floor)\.? ?{_NUM})){{1,2}}\s?,\s?{_W}", re.I),
    re.compile(rf"(?<![\w.,/-]){_NUM} {_W}(?: {_W})? {_STREET}\b\.?\s?,\s?{_W}", re.I),
    # calle X 176, 5º D, 26008 Town; c/ X 63 bajo, 12549 Town
    re.compile(rf"(?<![\w])(?:calle|c/|avda\.?|avenida|paseo|plaza|pza\.?|camino|carrer)\s*{_W}(?: {_W}){{0,3}}\s?,?\s?{_NUM}(?:\s?,?\s?(?:\d{{1,2}}\s?[ºª°o]?\.?\s?[A-Za-z]?\b|bajo|ático|atico|izq\.?|dcha\.?|piso \d+))*\s?,\s?\d{{5}}\s{_W}", re.I),
    # Indic: flat word number, parts, town, with or without a postal code
    re.compile(rf"(?<![\w])(?:फ्लैट|फ्लॅट|मकान|घर|प्लॉट|दुकान|ফ্ল্যাট|বাড়ি|வீடு|பிளாட்)\s*(?:नं\.?|नंबर|क्र\.?|संख्या|নং|எண்)?\s*{_NUM}(?:\s?,\s?[^,\n\d।.]{{2,40}}){{1,4}}(?:[\s,-]*(?:\d{{3}} ?\d{{3}})(?!\d))?"),
    re.compile(rf"(?<![\w.,/-]){_NUM} [^\W\d_][^,\n\d।.]{{1,30}}(?:मार्ग|रोड|गली|सड़क|पथ|রোড|সড়ক|গলি|தெரு|சாலை)(?:\s?,\s?[^,\n\d।.]{{2,40}}){{1,3}}?(?:[\s,-]*(?:\d{{3}} ?\d{{3}})(?!\d)|(?=\s(?:पर|में|को|আ|தே)|[।.\n,]|$))"),
)


# Words before or inside the first part of an address, in lower case.
_HOUSES = ("flat", "plot", "house", "door", "shop", "villa", "apartment", "apt", "unit", "room", "block", "quarter", "bungalow", "h.no", "h no", "h. no", "h .no", "h . no", "hno", "d.no.")
_STREETS = (
    "street", "st", "road", "rd", "lane", "ln", "avenue", "ave", "av", "boulevard", "blvd", "drive", "marg", "salai", "gali", "galli", "chowk", "bazaar", "path", "way", "court", "terrace",
)
_CALLES = ("calle", "c/", "avda", "avenida", "paseo", "plaza", "pza", "camino", "carrer")
_INDIC_HOUSES = ("फ्लैट", "फ्लॅट", "मकान", "घर", "प्लॉट", "दुकान", "ফ্ল্যাট", "বাড়ি", "வீடு", "பிளாட்")
_INDIC_STREETS = ("मार्ग", "रोड", "गली", "सड़क", "पथ", "রোড", "সড়ক", "গলি", "தெரு", "சாலை")
_NUM_AT = re.compile(rf"(?<![\w.,/-]){_NUM} ")
_PART_END = re.compile(r"[,\n।.]")


def _house_numbers(text: str, s: int, words: int) -> list[int]:
    """Where a house number starts at most ``words`` words before a street word at ``s``."""
    at = s
    for _ in range(words + 1):
        cut = text.rfind(" ", 0, max(0, at - 1))
        if cut < 0:
            at = 0
            break
        at = cut + 1
    return [m.start() for m in _NUM_AT.finditer(text, at, s)]


def find_addresses(text: str, found: Anchors) -> list[tuple[int, int, str]]:
    starts: list[tuple[int, int]] = []
    for form, kind in ((0, HOUSE), (4, CALLE), (5, INDIC_HOUSE)):
        starts += [(form, s) for s, _, _ in found[kind]]
    for s, e, _ in found[STREET]:
        if (s and _is_word(text[s - 1])) or (e < len(text) and _is_word(text[e])):
            continue
        starts += [(form, n) for n in _house_numbers(text, s, 3) for form in (1, 2, 3)]
    for s, _, _ in found[INDIC_STREET]:
        part = max((m.end() for m in _PART_END.finditer(text, max(0, s - 40), s)), default=max(0, s - 40))
        starts += [(6, m.start()) for m in _NUM_AT.finditer(text, part, s)]
    out: list[tuple[int, int, str]] = []
    for form, at in sorted(set(starts)):
        m = _ADDRESSES[form].match(text, at)
        if not m:
            continue
        s, e = m.span()
        if any(s < b and a < e for a, b, _ in out):
            continue
        body = re.sub(r"(?<=\d)(?:st|nd|rd|th)\b", "", m.group(), flags=re.I)
        key = _digits(body.translate({0xBA: None, 0xAA: None}))
        if key:
            out.append((s, e, key))
    return out


_INDIC = r"[\u0900-\u0963\u0966-\u0dff]+"
_INITIAL = re.compile(rf"(?<![\w.@])([A-Z])\. ?([A-Z][A-Za-z’'-]{{2,}})(?![\w@])")
_INITIAL_LOW = re.compile(r"(?<![\w.@])([a-z])\. ?([a-z’'-]{3,})(?![\w@])")
# Phrases that present a person by an initial and a last name.
_INITIAL_BEFORE = re.compile(
    r"(?:(?:from|to|de|para|cc)\s*:\s*|\b(?:dear|hi|hello|hola|estimad[oa]|querid[oa]|priya|mr|mrs|ms|dr|shri|smt|sra?|prof)\.?\s+"
    r"|\b(?:signed by|spoke to|ask for|this is|main|soy|pregunte por|hablé con|reply to|kal|baje)\s+|\d\d:\d\d,?\s+|[+-]\d\d:\d\d\s+|(?:^|\n)[\s>|]*|,[ \t]*\n?\s*|(?:--|~~~|===+|___+|\* \* \*)\s*\n?\s*|प्रिय\s+|कल\s+|बजे\s+|मैं\s+)$",
    re.I,
)
_INITIAL_AFTER = re.compile(
    r"^(?:\s*$|\s*\n|\s*<|\s*,|\s+(?:wrote|said|will|from|about|at the|in|escribió|ne|ji|se|bol|ने|जी|से|बोल|sobre|en|de)\b|\s*:|\s+(?:sent|date|enviado|fecha|accounts|desk|store|field|planning|branch|sahayata|jefa|atención|m|t|ph|mob|tel|☎|mail|e|to|subject)\b)",
    re.I,
)


# Titles, header fields and phrases after which a person's name stands.
_TITLES = ("mr", "mrs", "ms", "dr", "prof", "shri", "smt", "sr", "sra")
_HEADS = ("from:", "to:", "cc:", "de:", "para:", "von:")
_PRESENTS = ("my name is ", "signed by ", "spoke to ", "ask for ", "mi nombre es ", "me llamo ", "pregunte por ", "hablé con ", "mera naam ", "mera naam hai ")
# Words that stand after a title, a header or such a phrase without being a name.
_NO_NAME = set(
    "customer client sir madam user member team friend friends all colleague colleagues parent student applicant candidate subscriber resident valued account sender receiver help support service services "
    "care billing sales security info admin office desk department manager president chairman minister officer director general undisclosed recipients my your our new good".split()
)
AT, SPOKEN, SCHEME, DIAL, SLASH, CUE, HOUSE, STREET, CALLE, INDIC_HOUSE, INDIC_STREET, TITLE, HEAD, PRESENT, NAME = range(15)
Anchors = list[list[tuple[int, int, str]]]
_ANCHORS = {
    AT: _AT_SIGNS, SPOKEN: _SPOKEN, SCHEME: _SCHEMES, DIAL: _DIAL, SLASH: ("/",), CUE: _ID_CUES, HOUSE: _HOUSES, STREET: _STREETS, CALLE: _CALLES, INDIC_HOUSE: _INDIC_HOUSES,
    INDIC_STREET: _INDIC_STREETS, TITLE: _TITLES, HEAD: _HEADS, PRESENT: _PRESENTS, NAME: (*_GIVEN, *_GIVEN_INDIC),
}


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    kinds: dict[str, list[int]] = {}
    for kind, words in _ANCHORS.items():
        for w in dict.fromkeys(words):
            kinds.setdefault(w, []).append(kind)
    auto = ahocorasick.Automaton()
    for w, k in kinds.items():
        auto.add_word(w, (w, tuple(k)))
    auto.make_automaton()
    return auto


def lower_same(text: str) -> str:
    """Lower case without a change of any position."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def find_anchors(text: str) -> Anchors:
    """Per kind the (start, end, word) of all anchors, from one pass of the automaton."""
    found: Anchors = [[] for _ in _ANCHORS]
    for end, (word, kinds) in _automaton().iter(lower_same(text)):
        for k in kinds:
            found[k].append((end + 1 - len(word), end + 1, word))
    return found


_TITLE = re.compile(r"(?:^|[^\w])(?:mr|mrs|ms|dr|sr|sra|prof|shri|smt)\.$")
_LAST = re.compile(rf"[ \t]+(?:([A-Za-z])\.?[ \t]+)?([^\W\d_]{{2,}}(?:[’'-][^\W\d_]+)*|{_INDIC})(?![\w@])")


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M"


_FULL = re.compile(r"\.?[ \t]+((?:[A-Z]\.?[ \t]+)?[A-Z][a-z’'-]{1,}(?:[ \t]+[A-Z]\.)?[ \t]+[A-Z][a-z’'-]{2,})(?![\w@])")
_HEAD_END = re.compile(r"\s*(?:<|&lt;)|\s*\n\s*[^\W\d_]+\s*:")


def _presented(text: str, found: Anchors) -> list[tuple[int, int, str]]:
    """Names of any kind after a title, in a header of a mail, or where a person is presented."""
    out = []
    for kind in (TITLE, HEAD, PRESENT):
        for s, e, word in found[kind]:
            if s and _is_word(text[s - 1]):
                continue
            m = _FULL.match(text, e - 1 if word.endswith(" ") else e)
            if not m or (kind == HEAD and not _HEAD_END.match(text, m.end())):
                continue
            parts = [p.strip(".").lower() for p in m.group(1).split()]
            nxt = re.match(r"[ \t]+([^\W\d_]+)", text[m.end() :])
            if {*parts} & (_NOT_LAST | _NO_NAME | _FIRM) or (nxt and nxt.group(1).lower() in _FIRM):
                continue
            out.append((m.start(1), m.end(1), " ".join(parts)))
    return out


def find_persons(text: str, found: Anchors) -> list[tuple[int, int, str]]:
    out = []
    low = lower_same(text)
    for s, e, _ in found[NAME]:
        if s and (_is_word(text[s - 1]) or text[s - 1] in "@+%=" or text[s - 1] == "." and not _TITLE.search(low, max(0, s - 6), s)):
            continue
        if e < len(text) and (_is_word(text[e]) or text[e] in "@._+-" and e + 1 < len(text) and _is_word(text[e + 1])):
            continue
        m = _LAST.match(text, e)
        if not m:
            continue
        last = m.group(2)
        if last.lower() in _NOT_LAST:
            continue
        first = text[s:e]
        if first.isascii():
            # The case of a name is one: Title Title, UPPER UPPER or lower lower.
            title = first[0].isupper() and first[1:].islower()
            if title and not last[0].isupper() and not (len(last) >= 6 and re.match(r"\s(?:said|wrote|ji|ne|se)\b|\s*<", text[m.end() :])):
                continue
            if first.isupper() and not last.isupper():
                continue
            if first.islower() and not (last.islower() and len(last) >= 5):
                continue
        nxt = re.match(r"[ \t]+([^\W\d_]+)", text[m.end() :])
        if nxt and nxt.group(1).lower() in _FIRM and nxt.group(1)[0].isupper() and first.isascii():
            continue
        parts = [first, m.group(1), last] if m.group(1) else [first, last]
        out.append((s, m.end(2), " ".join(parts).lower()))
    out += [f for f in _presented(text, found) if not any(a < f[1] and f[0] < b for a, b, _ in out)]
    for p in (_INITIAL, _INITIAL_LOW):
        for m in p.finditer(text):
            if m.group(2).lower() in _NOT_LAST or len(m.group(2)) < 4:
                continue
            if any(a < m.end() and m.start() < b for a, b, _ in out):
                continue
            if _INITIAL_BEFORE.search(text[max(0, m.start() - 24) : m.start()]) and _INITIAL_AFTER.match(text[m.end() : m.end() + 20]):
                out.append((m.start(), m.end(), f"{m.group(1)} {m.group(2)}".lower()))
    return out


_FIRM = set("bank pay wallet mart retail telecom broadband insurance mutual finance credit power electric logistics courier cargo ltd limited street road lane avenue marg nagar colony temple".split())


def link_spans(text: str, found: Anchors) -> list[tuple[int, int]]:
    """(start, end) of the links: from a scheme onward, or from a slash back to the start of its host."""
    starts = {s for s, _, _ in found[SCHEME]}
    for s, _, _ in found[SLASH]:
        at = s
        while at and (text[at - 1].isalnum() and text[at - 1].isascii() or text[at - 1] in ".-"):
            at -= 1
        if at < s:
            starts.add(at)
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        m = _URL.match(text, s) if not out or s >= out[-1][1] else None
        if m:
            out.append(m.span())
    return out


def find_in_links(text: str, found: Anchors, links: list[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, key) of contact data in the parameters and paths of links."""
    out = []
    for start, end in links:
        for m in _PARAM.finditer(text[start:end]):
            name, raw = m.group(1).lower(), m.group(2).rstrip(".,;:!?)")
            value = unquote(raw.replace("+", " ") if "%" not in raw else raw)
            s = start + m.start(2)
            mail = re.fullmatch(rf"({_LOCAL})@({_DOMAIN})", value)
            if mail and _mail_key(*mail.groups()):
                out.append((s, s + len(raw), EMAIL, _mail_key(*mail.groups())))
            elif name in _PHONE_PARAMS or re.fullmatch(r"\+?91[6-9]\d{9}", value):
                key = phone_key(value)
                if key:
                    out.append((s, s + len(raw), PHONE, key))
            elif name in {"pan", "aadhaar", "aadhar", "uid", "card", "acct", "account", "passport", "dni", "id_number", "nid"}:
                key = re.sub(r"[^0-9A-Za-z]", "", value).upper()
                if any(p.fullmatch(key) for p in _SHAPES):
                    out.append((s, s + len(raw), ID, key))
    for _, e, _ in found[DIAL]:
        m = _DIALLED.match(text, e)
        key = phone_key(m.group()) if m else None
        if key:
            out.append((m.start(), m.end(), PHONE, key))
    return out


_DIGIT = re.compile(r"\d")


def find_pii(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, key) in order, without overlaps; longer and surer kinds win."""
    if not text:
        return []
    signs = find_anchors(text)
    links = link_spans(text, signs)
    found = find_in_links(text, signs, links)
    found += [(s, e, EMAIL, k) for s, e, k in find_emails(text, signs)]
    if _DIGIT.search(text):
        found += [(s, e, ID, k) for s, e, k in find_ids(text, signs)]
        found += [(s, e, ADDRESS, k) for s, e, k in find_addresses(text, signs)]
        found += [(s, e, PHONE, k) for s, e, k in find_phones(text) if not any(a < e and s < b for a, b in links)]
    found += [(s, e, PERSON, k) for s, e, k in find_persons(text, signs) if not any(a < e and s < b for a, b in links)]
    rank = {EMAIL: 0, ID: 1, ADDRESS: 2, PHONE: 3, PERSON: 4}
    kept: list[tuple[int, int, str, str]] = []
    for f in sorted(found, key=lambda f: (rank[f[2]], f[0], -f[1])):
        if not any(f[0] < b and a < f[1] for a, b, _, _ in kept):
            kept.append(f)
    return sorted(kept)


def redact(text: str | None, found: list[tuple[int, int, str, str]] | None = None) -> str | None:
    """The text with a typed placeholder for every value; all else stays as it is."""
    if text is None:
        return None
    out, at = [], 0
    for s, e, kind, _ in found if found is not None else find_pii(text):
        out += [text[at:s], PLACEHOLDER[kind]]
        at = e
    return "".join(out) + text[at:]


def find_personal_data(df: DataFrame, ident: str = "pos", text: str = "text_raw") -> DataFrame:
    """(ident, pii_kind, pii_key, occurrences): one row per row of ``df``, kind and value.

    Null and empty texts hold nothing; whole texts are read, links included.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter = Counter()
            for n, t in enumerate(pdf["text"]):
                for _, _, k, key in find_pii(t):
                    seen[n, k, key] += 1
            ids = pdf["ident"].to_numpy()[np.array([k[0] for k in seen], dtype=np.int64)]
            yield pd.DataFrame({ident: ids, "pii_kind": pd.Series([k[1] for k in seen], dtype=object), "pii_key": pd.Series([k[2] for k in seen], dtype=object), "occurrences": np.array(list(seen.values()), dtype=np.int64)})

    kind = dict(df.dtypes)[ident]
    cols = df.select(F.col(ident).alias("ident"), F.col(text).alias("text"))
    return cols.mapInPandas(run, f"{ident} {kind}, pii_kind string, pii_key string, occurrences long")


def redact_messages(df: DataFrame, ident: str = "pos", texts: tuple[str, ...] = ("text", "text_raw"), links: str = "urls") -> DataFrame:
    """(ident, the text columns, links, replaced): placeholders of a type in place of values.

    Every other character stays. Null texts and null lists stay null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = {ident: pdf["ident"]}
            n = [0] * len(pdf)
            for c in texts:
                col = []
                for r, t in enumerate(pdf[c]):
                    f = find_pii(t)
                    n[r] += len(f)
                    col.append(redact(t, f))
                out[c] = col
            urls = []
            for r, us in enumerate(pdf[links]):
                if us is None:
                    urls.append(None)
                    continue
                new = [redact(u) if u is not None else None for u in us]
                n[r] += sum(a != b for a, b in zip(new, us))
                urls.append(new)
            out[links] = urls
            yield pd.DataFrame(out | {"replaced": n})

    kind = dict(df.dtypes)[ident]
    cols = df.select(F.col(ident).alias("ident"), *texts, links)
    return cols.mapInPandas(run, f"{ident} {kind}, {', '.join(f'{c} string' for c in texts)}, {links} array<string>, replaced long")
