"""The front end: one question to slots, on the driver. Its slots choose and parameterise plans."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from docloom.functions.script import devanagarize_text, romanize_text, seq_ratio_text
from docloom.functions.tokens import query_tokens
from docloom.operators.contents import SECTION_WORDS

#: Words of the recognisers.
ORDINALS = {
    1: ("first", "1st", "पहला", "पहली", "pahla", "pehla"), 2: ("second", "2nd", "दूसरा", "दूसरी", "dusra"), 3: ("third", "3rd", "तीसरा", "तीसरी", "tisra"), 4: ("fourth", "4th", "चौथा", "चौथी", "chautha"),
    5: ("fifth", "5th", "पाँचवाँ", "पांचवां", "panchva"), 6: ("sixth", "6th", "छठा", "छठी", "chhatha"), 7: ("seventh", "7th", "सातवाँ", "सातवां", "satva"), 8: ("eighth", "8th", "आठवाँ", "आठवां", "athva"),
    9: ("ninth", "9th", "नौवाँ", "नौवां", "nauva"), 10: ("tenth", "10th", "दसवाँ", "दसवां", "dasva"),
}
LAST = ("last", "final", "अंतिम", "आखिरी", "antim", "aakhiri")
EXPECTED = [
    ("PERCENTAGE", r"percent|%|प्रतिशत|pratishat"), ("PERSON", r"\bwho\b|whose|author|लेखक|किसने|कौन|kisne|kaun|lekhak"), ("DURATION", r"how long|duration|अवधि|कितने दिन|kitne din"),
    ("DATE", r"\bwhen\b|\bdate\b|कब|तिथि|दिनांक|\bkab\b"), ("MONETARY", r"amount|cost|price|rupees|राशि|रुपये|कितने रुपए"), ("DESCRIPTION", r"describe|explain|\bwhy\b|\bhow does\b|वर्णन|क्यों|कैसे"),
    ("COUNT", r"how many|number of|count|कितने|कितनी|संख्या|kitne|kitni"),
]
LANGUAGES = {"hindi": ("hindi", "हिंदी", "हिन्दी"), "english": ("english", "अंग्रेजी", "अंग्रेज़ी", "angrezi"), "bilingual": ("bilingual", "द्विभाषी")}
RELATIONS = {"reply_received": ("reply received", "replies received"), "reply_given": ("replied", "reply given", "उत्तर दिया", "answered"), "received": ("received", "प्राप्त"), "sent": ("sent", "भेजे"), "issued": ("issued", "जारी")}
AGGREGATIONS = {"AVERAGE": r"average|mean|औसत", "PERCENTAGE": r"percent|%|प्रतिशत", "TOTAL": r"total|कुल|योग", "SUM": r"\bsum\b|add up", "COUNT": r"how many|count|कितने|संख्या"}
#: Attributes that a question may ask for, and what joins an index question to the contents pages.
ATTRIBUTES = {"author": ("author", "writer", "लेखक"), "page": ("page", "पृष्ठ"), "title": ("title", "शीर्षक"), "date": ("date", "दिनांक", "तिथि"), "phone": ("phone", "telephone", "दूरभाष"), "email": ("email", "ईमेल"), "address": ("address", "पता"), "percentage": ("percentage", "percent", "प्रतिशत"), "number": ("number of", "count", "संख्या")}
CONTENTS_BAIT = "contents index अनुक्रमणिका विषय सूची"
ACTIONS = r"repl(?:y|ied|ies)|answered|respon(?:se|ded)|उत्तर|जवाब|uttar|jawab"
COMPARE = r"compar|versus|\bvs\b|difference|change|increase|decrease|तुलना|अंतर|वृद्धि|कमी|tulna"
STOP = frozenset("a an the of in on at to for is are was were what which who whom whose how many much give me show list tell about by from and or page article articles author written wrote write में के की का को है हैं से पर और ने किस किसने क्या कौन ka ke ki ko hai me se".split())
ALIASES = {"hindi": "हिंदी", "letter": "पत्र", "letters": "पत्र", "office": "कार्यालय", "region": "क्षेत्र", "training": "प्रशिक्षण", "meeting": "बैठक", "report": "रिपोर्ट", "magazine": "पत्रिका", "article": "लेख", "poem": "कविता", "total": "कुल"}


@dataclass(frozen=True)
class Analysis:
    """What a question asks."""

    query: str
    clean: str
    script: str
    intent: str
    mode: str
    tokens: tuple[str, ...]
    entities: tuple[str, ...] = ()
    variants: tuple[str, ...] = ()
    expected_type: str | None = None
    ordinal: int | str | None = None
    page: int | None = None
    section: str | None = None
    section_no: int | None = None
    clause: str | None = None
    regions: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    relation: str | None = None
    aggregation: str | None = None
    year: int | None = None
    periods: tuple[str, ...] = ()
    document_type: str | None = None
    comparing: bool = False
    counting: bool = False
    listing: bool = False
    target: str | None = None
    author: str | None = None
    topic: tuple[str, ...] = field(default_factory=tuple)
    attribute: str | None = None
    condition_languages: tuple[str, ...] = ()
    target_languages: tuple[str, ...] = ()
    auxiliary: tuple[str, ...] = ()


def clean(query: str) -> str:
    text = unicodedata.normalize("NFKC", query)
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s()%.ऀ-ॿ'-]", " ", text)).strip()


def script_of(text: str) -> str:
    hindi, latin = bool(re.search("[ऀ-ॿ]", text)), bool(re.search("[A-Za-z]", text))
    return "mixed_hinglish" if hindi and latin else "devanagari_hindi" if hindi else "latin_english_or_hinglish" if latin else "neutral"


def _has(text: str, words: tuple[str, ...]) -> bool:
    return any(re.search(rf"(?<![\wऀ-ॿ]){re.escape(w)}(?![\wऀ-ॿ])", text) for w in words)


def ordinal_of(text: str) -> int | str | None:
    """1 to 10, or "last"; a page number is no ordinal."""
    low = re.sub(r"(?:page|पृष्ठ|prishth)\s*(?:no\.?|number|संख्या)?\s*[0-9]+", " ", text.lower())
    if _has(low, LAST):
        return "last"
    return next((n for n, words in ORDINALS.items() if _has(low, words)), None) or next((int(m[1]) for m in [re.search(r"\b([0-9]{1,2})(?:st|nd|rd|th)\b", low)] if m), None)


def page_of(text: str) -> int | None:
    m = re.search(r"(?:page|पृष्ठ|prishth)\s*(?:no\.?|number|संख्या)?\s*([0-9]{1,3})", text.lower())
    return int(m[1]) if m else None


def section_of(text: str) -> str | None:
    """The section concept whose longest name occurs."""
    low = text.lower()
    names = sorted(((s, key) for key, words in SECTION_WORDS.items() for s in words), key=lambda x: -len(x[0]))
    return next((key for s, key in names if _has(low, (s,))), None)


def regions_of(text: str) -> tuple[str, ...]:
    """क, ख, ग of single regions and of enumerations such as `regions A, B and C`."""
    letters = {"a": "क", "b": "ख", "c": "ग", "क": "क", "ख": "ख", "ग": "ग"}
    low = text.lower()
    out: list[str] = []
    for m in re.finditer(r"(?:regions?|kshetra|क्षेत्र(?:ों)?)\s*((?:[‘'\"“(]?[abcकखग][’'\"”)]?\s*(?:,|and|और|एवं|व|&)?\s*)+)(?![\wऀ-ॿ])", low):
        out += re.findall("[abcकखग]", re.sub("and|और|एवं", " ", m[1]))
    for m in re.finditer(r"(?<![\wऀ-ॿ])[‘'\"“(]?([abcकखग])[’'\"”)]?\s*(?:region|kshetra|क्षेत्र)", low):
        out.append(m[1])
    return tuple(dict.fromkeys(letters[x] for x in out))


def entities_of(text: str) -> tuple[str, ...]:
    """Capitalised runs, acronyms, and Devanagari runs without stop words."""
    latin = re.findall(r"\b[A-Z]{2,}\b|\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*", text)
    hindi = [w for w in re.findall("[ऀ-ॿ]+", text) if w not in STOP]
    return tuple(dict.fromkeys(w for w in [*latin, *hindi] if w.lower() not in STOP))


def variants_of(text: str, terms: dict[str, str] | None = None) -> tuple[str, ...]:
    """The question, with known words in the other language, and transliterated where it isn't plain English."""
    low, table = text.lower(), ALIASES | (terms or {})
    other = re.sub(r"[\wऀ-ॿ]+", lambda m: table.get(m[0], m[0]), low)
    back = {v: k for k, v in table.items()}
    english = re.sub(r"[\wऀ-ॿ]+", lambda m: back.get(m[0], m[0]), low)
    out = [text, other, english]
    if script_of(text) == "devanagari_hindi":
        out.append(romanize_text(text))
    elif _has(low, ("hai", "ka", "ke", "ki", "kitne", "kya", "me")):
        out.append(devanagarize_text(low))
    return tuple(dict.fromkeys(v for v in out if v.strip()))


def expanded_queries(a: Analysis) -> list[tuple[str, float]]:
    """What a dense search asks, with scales: the question's variants at 1; auxiliary words of three or fewer at 0.7; for a contents question the words of contents pages too."""
    out = dict.fromkeys([*a.variants, a.query], 1.0)
    for x in a.auxiliary:
        out.setdefault(x, 0.7 if len(x.split()) <= 3 else 1.0)
    if a.mode == "INDEX_BASED":
        out.setdefault(f"{a.clean} {CONTENTS_BAIT}", 1.0)
    return list(out.items())


def languages_of(text: str) -> tuple[str, ...]:
    """Languages that a text names; a word of 8 letters or more may be misspelt (a ratio of 0.82)."""
    low = text.lower()
    words = [w for w in query_tokens(low) if len(w) >= 8]
    near = lambda names: any(seq_ratio_text(w, n) >= 0.82 for w in words for n in names if len(n) >= 7)
    return tuple(k for k, names in LANGUAGES.items() if _has(low, names) or near(names))


def languages_by_side(text: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(languages of the condition, of the target): before and after the word of the answer, as in `received in Hindi, replied in English`; all are the target's where there is none."""
    parts = re.split(ACTIONS, text.lower(), maxsplit=1)
    return (languages_of(parts[0]), languages_of(parts[1])) if len(parts) == 2 else ((), languages_of(text))


def _target(text: str) -> str | None:
    """The title that a question is about: quoted, or what is left at its edges."""
    quoted = re.search(r"[\"“‘']([^\"”’']{2,120})[\"”’']", text)
    if quoted:
        return quoted[1].strip()
    for pattern in (r"(?:author|page(?: number)?|writer)\s+of\s+(?:the\s+)?(?:article\s+|poem\s+|story\s+)?(.+)", r"who\s+(?:wrote|is the author of)\s+(?:the\s+)?(?:article\s+|poem\s+|story\s+)?(.+)", r"(?:on\s+)?which\s+page\s+is\s+(.+)", r"(.+?)\s+(?:के लेखक|किसने लिखा|किस पृष्ठ)", r"is there (?:an?\s+)?(?:article|poem|story)?\s*(?:titled|named|called)?\s*(.+)"):
        m = re.search(pattern, text, re.IGNORECASE)
        if m:
            return m[1].strip(" ?.।") or None
    return None


def _author(text: str) -> str | None:
    for pattern in (r"(?:written|authored|articles?|works?|poems?)\s+by\s+(.+)", r"(?:what|which)\b.*\bdid\s+(.+?)\s+write", r"(.+?)\s+(?:ने|द्वारा)\s+(?:क्या|कौन|कितने|लिखे|लिखा)"):
        m = re.search(pattern, text, re.IGNORECASE)
        if m:
            return m[1].strip(" ?.।") or None
    return None


def index_intent(text: str, page: int | None, ordinal: int | str | None, section: str | None, target: str | None, author: str | None) -> str:
    """ARTICLE_BY_PAGE, ordinals, author works, COUNT, PAGE_BY_TITLE, AUTHOR_BY_TITLE, EXISTS, ARTICLES_BY_SECTION, TOPIC_SEARCH or STRUCTURED_LOOKUP, in this order."""
    low = text.lower()
    if page is not None and not re.search(r"which page|किस पृष्ठ", low):
        return "ARTICLE_BY_PAGE"
    if ordinal is not None:
        return "LAST_ITEM" if ordinal == "last" else "FIRST_ITEM" if ordinal == 1 else "NTH_ITEM"
    if author:
        return "TITLE_BY_AUTHOR"
    if re.search(r"how many|count|number of|कितने|कितनी|संख्या", low):
        return "COUNT"
    if target and re.search(r"page|पृष्ठ", low):
        return "PAGE_BY_TITLE"
    if target and re.search(r"author|who|writer|लेखक|किसने", low):
        return "AUTHOR_BY_TITLE"
    if re.search(r"^is there|exists?\b|क्या .* है", low):
        return "EXISTS"
    if re.search(r"\babout\b|related to|के बारे|विषय", low):
        return "TOPIC_SEARCH"
    if section:
        return "ARTICLES_BY_SECTION"
    return "STRUCTURED_LOOKUP"


def analyze(query: str, mode: str | None = None, terms: dict[str, str] | None = None) -> Analysis:
    """All slots of a question. A requested mode is a preference for questions that name no mode."""
    text = clean(query)
    low = text.lower()
    page, ordinal, section = page_of(low), ordinal_of(low), section_of(low)
    author = _author(text)
    target = None if author else _target(query)
    toks = query_tokens(text)
    numbered = re.search(r"(?:section|अनुभाग|क्रम)\s*([0-9]+)\s*(?:\(\s*([0-9a-z]+)\s*\))?", low)
    periods = tuple(dict.fromkeys(".".join((d.zfill(2), m.zfill(2), y)) for d, m, y in re.findall(r"\b([0-9]{1,2})[./-]([0-9]{1,2})[./-]((?:19|20)[0-9]{2})\b", query)))
    years = re.findall(r"\b(?:19|20)[0-9]{2}\b", low)
    contents = bool(re.search(r"article|author|poem|story|title|page|magazine|contents|लेख|लेखक|कविता|कहानी|शीर्षक|पृष्ठ|पत्रिका", low))
    form = bool(re.search(r"office|address|phone|email|telephone|कार्यालय|पता|दूरभाष|ईमेल", low))
    metadata = bool(re.search(r"region|quarter|letters?|section [0-9]|क्षेत्र|पत्र|तिमाही", low))
    picked = "REPORT_METADATA" if metadata and not author else "FORM_BASED" if form else "INDEX_BASED" if contents else mode or "CONTENT_BASED"
    return Analysis(
        query, text, script_of(text), index_intent(low, page, ordinal, section, target, author), picked, tuple(toks), entities_of(text), variants_of(text, terms),
        next((kind for kind, words in EXPECTED if re.search(words, low)), None), ordinal, page, section, int(numbered[1]) if numbered else None, numbered[2] if numbered else None, regions_of(query),
        languages_of(low), next((k for k, words in RELATIONS.items() if _has(low, words)), None), next((k for k, words in AGGREGATIONS.items() if re.search(words, low)), None),
        int(years[0]) if years else None, periods + tuple(y for y in dict.fromkeys(years) if not any(y in p for p in periods)), "report" if re.search("report|रिपोर्ट", low) else "magazine" if re.search("magazine|पत्रिका", low) else None,
        bool(re.search(COMPARE, low)), bool(re.search(r"how many|count|number of|कितने|कितनी|संख्या", low)), bool(re.search(r"\blist\b|\bshow all\b|name the|सूची|कौन-कौन", low)), target, author,
        tuple(t for t in toks if t not in STOP and len(t) > 2), next((k for k, words in ATTRIBUTES.items() if _has(low, words)), None), *languages_by_side(low), tuple(dict.fromkeys([*entities_of(text), *((target,) if target else ())])),
    )
