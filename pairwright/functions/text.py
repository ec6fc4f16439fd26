
from __future__ import annotations

import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _decomposed() -> tuple[dict[str, str], dict[str, str]]:
    """What becomes of a character above ASCII by compatibility decomposition without combining marks (U+0300 to U+036F),
    if a letter or digit of ASCII is left or nothing at all: those that become one character or none, and all others, where
    what is neither letter nor digit is a space. The rest are separators."""
    short, long = {}, {}
    for code in (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)):
        c = chr(code)
        if c.lower() == c:
            left = re.sub("[^a-z0-9]+", " ", re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", c)))
            if left != " ":
                (short if len(left) < 2 else long)[c] = left
    return short, long


_SHORT, MANY = _decomposed()
#: For translate(): characters that have no place in PLAIN go.
ACCENTED, PLAIN = "".join(sorted(_SHORT, key=lambda c: (not _SHORT[c], c))), "".join(_SHORT[c] for c in sorted(_SHORT) if _SHORT[c])
ANY_OF_MANY = "[" + "".join(MANY) + "]"

# Words that say nothing about a product.
STOPWORDS = (
    "the a an and or for with without new used brand authentic original genuine free shipping fast delivery lot pack set box official licensed by from to of in on off"
).split()
LOW_VALUE_WORDS = (
    "the a an and or for with without your our their this that these those from to of in on at by as is are was were be been being it its "
    "item products product parts piece pieces set kit pack lot pair case cover compatible replacement fits fit for use used new old generic style type "
    "model no number number.part size color colours colors standard regular basic deluxe value usa us uk eu canada australia germany france japan china"
).split()

# Marketing phrases in the order in which they are taken out (on lower-cased text).
SPAM_PHRASES = (
    r"\bfast\s+(?:free\s+)?(?:and\s+)?(?:free\s+)?shipping\b",
    r"\bfree\s+(?:fast\s+)?shipping\b",
    r"\bfree\s+(?:shipping|returns?|delivery|gift|bonus)\b",
    r"\bsame\s+day\s+(?:shipping|dispatch|delivery)\b",
    r"\bfreight\s+free\b",
    r"\bfrees?\s*ship(?:ping)?\b",
    r"\b(?:fast|quick|express|expedited|priority|super\s*fast)\s+(?:shipping|delivery|dispatch|postage)\b",
    r"\b(?:ships?|shipped|dispatch(?:ed)?|sent)\s+(?:from|out)\s+(?:the\s+)?(?:usa?|us|uk|united\s+states|europe|germany|france|australia|canada)\b",
    r"\b(?:usa?|uk|eu)\s+seller\b",
    r"\b(?:fast|immediate|same\s*day)\s+(?:dispatch|handling|postage)\b",
    r"\bbrand\s+new\b",
    r"\bfactory\s+(?:sealed|new|fresh)\b",
    r"\bnew\s+(?:sealed|in\s+box|unopened)\b",
    r"\bsealed\s+(?:new|box|in\s+box)\b",
    r"\b(?:unopened|unused|unboxed|in\s+hand|in\s+stock|ready\s+to\s+ship|ships?\s+today|arrives?\s+before\s+(?:christmas|xmas)|in\s+time\s+for\s+(?:christmas|xmas))\b",
    r"\bbest\s+(?:seller|price|quality|deal|value|gift)\b",
    r"\btop\s+(?:quality|seller|rated)\b",
    r"\bhot\s+(?:sale|deal|gift|item)\b",
    r"\b(?:wow|omg)\b",
    r"\b(?:limited|special)\s+(?:time|edition\s+sale|offer|deal)\b",
    r"\b(?:great|perfect)\s+(?:gift|present)\b",
    r"\bgift\s+(?:idea|set|box|wrap(?:ping)?)\b",
    r"\b(?:christmas|xmas|birthday|holiday)\s+gift\b",
    r"\b(?:bonus|extra|free)\s+(?:gift|item|bundle)\b",
    r"\b(?:no\s+)?tax(?:es)?\b",
    r"\bcustomer\s+(?:service|support)\b",
    r"\bsatisfaction\s+guaranteed?\b",
    r"\bmoney\s*[- ]?back\s+guarantee\b",
    r"\breturn(?:s)?\s+accepted\b",
    r"\b(?:genuine|authentic|original|legit)\b",
    r"\b(?:sale|deal|offer|discount|cheapest|lowest\s+price)\b",
    r"\bmust\s+have\b",
    r"\btrending\b",
    r"\bhigh\s+quality\b",
    r"\bpremium\s+quality\b",
    r"\bindustry[\s-]*leading\b",
    r"\bleading[\s-]*edge\b",
    r"\bfast\s+&?\s*free\b",
)
CONDITION_NOISE = (
    r"\b(?:brand[ -]?new|new|newly|unopened|opened|unsealed|sealed|unused|used|pre[ -]?owned|refurb(?:ished)?|renewed|open[ -]?box|for\s+parts|not\s+working|damaged|defective)\b"
)
SPAM_WORDS = (
    r"\b(?:shipping|shipped|shipment|ship|ships|delivery|returns?|refunds?|seller|sale|deal|gift|bonus|free|fast|quick|expedited|priority|wow|hot|l\.a\.|new|genuine|authentic|original|musthave|trending|limited|edition|warranty|guarantee|guaranteed)\b"
)
SEPARATORS = r"\s*(?:[|·•●★☆✅✔⭐🔥🎁⚡→\x{FE0F}]+|\+\+|–|—)\s*"
AFTER_PHRASES = (
    SEPARATORS,
    r"\s+[-–—]\s+",
    r"^\s*[-–—|]+\s*",
    r"\s*[-–—|]+\s*$",
    r"\((?:[^()]*(?:shipping|gift|new|free|fast|sale)[^()]*)\)",
    r"\b\d{1,2}/\d{1,2}(?:/\d{2,4})?\b",
    CONDITION_NOISE,
    SPAM_WORDS,
)
ATTR_NOISE = (
    r"\b\d{1,4}\s*(?:gb|tb|mb|mm|cm|in|inch|inches|oz|ml|l|w|pk|pack|pcs?|pieces?|ct|count)\b",
    r"\b\d+(?:\.\d+)?\s*x\s*\d+(?:\.\d+)?\b",
)


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fold_key(c: Column) -> Column:
    """Lower case, compatibility forms spelt out, accents off, all but a-z and 0-9 to one space; null gives ''."""
    spelt = F.str_to_map(F.lit("|".join(f"{c}:{w}" for c, w in MANY.items())), F.lit(r"\|"), F.lit(":"))
    # ligatures, fractions and the like become several characters; few texts have any
    many = lambda t: F.array_join(F.transform(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)), lambda x: F.coalesce(F.try_element_at(spelt, x), x)), "")
    t = let(F.lower(text_or_empty(c)), lambda s: F.when(s.rlike(r"[^\x00-\x7f]"), let(F.translate(s, ACCENTED, PLAIN), lambda t: F.when(t.rlike(ANY_OF_MANY), many(t)).otherwise(t))).otherwise(s))
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def fold_lower(c: Column) -> Column:
    """Lower case with squeezed spaces."""
    return squeeze(F.lower(text_or_empty(c)))


def fold_variation(c: Column) -> Column:
    """Lower case, a-z, 0-9 and the point kept."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9.]+", " "))


def long_tokens(folded: Column) -> Column:
    """Distinct tokens of more than one character, in order."""
    return F.array_distinct(F.filter(F.split(folded, " "), lambda w: F.length(w) > 1))


def title_tokens(c: Column) -> Column:
    """T4: distinct title tokens without stopwords; accents are separators here."""
    plain = F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", " ")
    return F.array_except(long_tokens(plain), F.array(*[F.lit(w) for w in STOPWORDS]))


def strip_spam(c: Column, keep_case: bool = False) -> Column:
    """T5: marketing phrases, separators, dates, condition and filler words out, in this order. The result is in lower
    case, unless keep_case leaves the letters as they are."""
    t = text_or_empty(c) if keep_case else F.lower(text_or_empty(c))
    t = F.concat(F.lit(" "), F.replace(t, F.lit(" "), F.lit(" ")), F.lit(" "))
    for p in (*SPAM_PHRASES, *AFTER_PHRASES):
        t = F.regexp_replace(t, f"(?i){p}" if keep_case else p, " ")
    return squeeze(t)


def strip_attr_noise(c: Column) -> Column:
    """The folded title without measures and sizes."""
    t = fold_key(c)
    for p in ATTR_NOISE:
        t = F.regexp_replace(t, p, " ")
    return squeeze(t)


def clean_listing_title(c: Column) -> Column:
    """A captured title without what the page puts before it; unusable ones give ''."""
    t = squeeze(F.regexp_replace(text_or_empty(c), r"(?i)^\s*(?:new listing|opens in a new window or tab|sponsored)\s*:?\s*", ""))
    return F.when((F.length(t) < 4) | F.lower(t).contains("shop on ebay"), "").otherwise(t)


_JUNK = r"[\s\"'`|,;:\-–—]+"


def exact_title_query(c: Column) -> Column:
    """The title as a query: squeezed, junk off its ends, unbalanced brackets at the ends off, 250 characters at most."""
    t = squeeze(text_or_empty(c))
    t = F.regexp_replace(F.regexp_replace(t, f"^{_JUNK}", ""), f"{_JUNK}$", "")
    count = lambda s, ch: F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))
    brackets = ("()", "[]", "{}")

    def close(t, _):
        step = F.when(F.lit(False), t)
        for a, b in brackets:
            step = step.when(t.endswith(a) & (count(t, a) > count(t, b)), F.trim(F.substring(t, F.lit(1), F.length(t) - 1)))
        return step.otherwise(t)

    def opened(t, _):
        step = F.when(F.lit(False), t)
        for a, b in brackets:
            step = step.when(t.startswith(b) & (count(t, b) > count(t, a)), F.trim(F.substring(t, F.lit(2), F.length(t))))
        return step.otherwise(t)

    passes = F.sequence(F.lit(1), F.lit(4))
    t = F.aggregate(passes, F.aggregate(passes, t, close), opened)
    return F.trim(F.when(F.length(t) > 250, F.regexp_replace(F.substring(t, 1, 250), f"{_JUNK}$", "")).otherwise(t))


def token_score(token: Column, frequency: Column) -> Column:
    """Longer, rarer tokens with digits are worth more."""
    digit = F.when(token.rlike("[0-9]"), 0.25).otherwise(0.0)
    rare = F.lit(0.6) + F.lit(0.4) * (F.lit(1.0) / F.ln(F.lit(1.0) + F.coalesce(frequency, F.lit(1))))
    return (F.lit(0.5) + F.lit(0.5) * (F.least(F.length(token), F.lit(12)) / F.lit(12.0)) + digit) * rare


def core_type_words(cleaned: Column, drop: Column, most: int) -> Column:
    """The product's type words: the folded title without the words of `drop` (an array), low-value words and numbers."""
    words = F.filter(long_tokens(fold_key(cleaned)), lambda w: ~w.rlike("^[0-9]+$"))
    return F.slice(F.array_except(F.array_except(words, F.array(*[F.lit(w) for w in dict.fromkeys(LOW_VALUE_WORDS)])), drop), 1, most)
