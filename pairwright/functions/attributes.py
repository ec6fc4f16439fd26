"""Attributes of a listing read from its title (A1-A21), as Column functions. Patterns hold on lower-cased text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions.text import fold_key, fold_variation, let, text_or_empty

# Pack sizes, tried in order.
PACK_COUNT = r"(?:^|[^a-z0-9])(\d{1,3})\s*[-\s]?\s*(?:pack|pk|pcs|pieces?|ct|count|units?|bottles?|cans?|tubs?|bars?|rolls?|wipes?)\b"
PACK_OF = r"\bpack\s*(?:of\s*|x)?\s*(\d{1,3})\b"
SET_OF = r"\b(?:set|box)\s*(?:of\s*)?(\d{1,3})\b"
TIMES_BEFORE, TIMES_AFTER = r"\b(\d{1,3})\s*x\b", r"\bx\s*(\d{1,3})\b"
QUANTITY = (PACK_COUNT, PACK_OF, SET_OF, TIMES_BEFORE, TIMES_AFTER)
BUNDLE_QUANTITY = (PACK_OF, PACK_COUNT, SET_OF, TIMES_BEFORE, TIMES_AFTER)
MULTI_WORDS = r"\b(pair|twins?|duo|double|two|three|four|five|six|dozen|doz|bundle|combo|kit|variety)\b"
MULTI_MAP = {"pair": 2, "twin": 2, "twins": 2, "duo": 2, "double": 2, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "dozen": 12, "doz": 12}
SINGLE_WORDS = r"\b(singles?|one|1\s*pc)\b"
BUNDLE_HINT = r"\b(bundle|starter\s*kit|accessory\s*kit|combo|kit\b|set\b|essentials?\s*kit)\b"
PLUS_ITEM = r"(?:^|[\s(])([a-z][a-z'\-]{2,})\s*(?:\+\s*[a-z][a-z'\-]{2,}|&\s*[a-z][a-z'\-]{2,})"
GUARD_QUANTITY = (
    r"\bpack\s+of\s+(\d{1,4})\b",
    r"\b(\d{1,4})\s*-?\s*pack\b",
    r"\b(\d{1,4})\s*pk\b",
    r"\b(\d{1,4})\s*(?:count|ct)\b",
    r"\bset\s+of\s+(\d{1,4})\b",
    r"\b(\d{1,4})\s*(?:bottles|cans|tabs|tablets|capsules|pods|bars|rolls|wipes|pouches)\b",
)

# Colour words by bucket.
COLORS = {
    "black": ["black", "blk", "jet black", "onyx", "midnight black", "piano black", "obsidian"],
    "white": ["white", "wht", "snow", "pearl white", "cloud white"],
    "silver": ["silver", "slv", "metallic silver"],
    "gray": ["gray", "grey", "space gray", "spacegrey", "graphite", "charcoal", "slate"],
    "blue": ["blue", "blu", "navy", "navy blue", "royal blue", "cobalt", "ocean blue", "sky blue"],
    "red": ["red", "crimson", "scarlet", "cherry"],
    "green": ["green", "grn", "forest green", "mint", "olive"],
    "yellow": ["yellow", "gold yellow"],
    "orange": ["orange", "burnt orange"],
    "purple": ["purple", "violet", "lavender"],
    "pink": ["pink", "rose", "blush"],
    "brown": ["brown", "coffee", "espresso", "tan"],
    "beige": ["beige", "cream", "ivory", "sand"],
    "gold": ["gold", "golden"],
    "rose gold": ["rose gold", "rosegold"],
    "cyan": ["cyan", "teal", "aqua", "turquoise"],
    "magenta": ["magenta", "fuchsia"],
    "clear": ["clear", "transparent", "crystal"],
    "multi": ["multicolor", "multi color", "multi", "rainbow", "assorted"],
}

# Measures.
STORAGE = r"\b(\d{1,4}(?:\.\d+)?)\s*(tb|terabyte|gb|gig|gigabyte|mb)\b"
RAM = r"\b(\d{1,3})\s*gb\s*(?:ram|memory)\b"
DIMENSIONS = r"(\d{1,4}(?:\.\d+)?)\s*(?:\"|''|in(?:ch(?:es)?)?)?\s*[x*×by]\s*(\d{1,4}(?:\.\d+)?)\s*(?:\"|''|in(?:ch(?:es)?)?)?\s*(mm|cm|m|inches|inch|in|\")?"
MILLILITRES = r"\b(\d{1,4}(?:\.\d+)?)\s*(?:ml|milliliter|millilitre)s?\b"
LITRES_OR_OUNCES = r"\b(\d{1,3}(?:\.\d+)?)\s*(l\b|liter|litre|oz|ounce)"
SIZE = r"\b(xxs|xs|s|m|l|xl|xxl|xxxl|small|medium|large|x-large|xx-large|one size)\b"
SIZE_NAMES = {"x-large": "xl", "xx-large": "xxl", "small": "s", "medium": "m", "large": "l"}
CONDITION = r"\b(refurb(?:ished)?|renewed|pre-?owned|used(?:-|\s)?(?:good|like new|very good|acceptable)?|open[ -]box|for parts|not working|new(?: other)?|brand new)\b"
CONNECTIVITY = r"\b(wifi(?:\s*only)?|wi-fi|cellular|lte|5g|gps\s*\+\s*cellular|wlan)\b"
GENERATION = r"\b(?:series|gen(?:eration)?|mark|mk)\s*(\d{1,2}|[ivx]{1,4})\b"
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8, "IX": 9, "X": 10}

# Model numbers, for the pair matcher and for the one-to-many matcher.
MODEL_LABELLED = r"\b(?:mpn|model(?:\s*(?:no|number|#))?|part\s*(?:no|number|#)?)\s*[:#]?\s*([a-z0-9][a-z0-9\-_]{2,18})\b"
MODEL_PAIR = r"^[a-z]{0,4}\d{1,6}[a-z]{0,6}$|^[a-z]\d[a-z0-9]*$|^[a-z]{1,5}\d{1,5}[a-z]{1,6}$"
MODEL_PAIR_NOT = r"^(?:\d{3,}|[0-9]{1,2}(?:gb|tb|mb|w|v|hz?|mm|cm|in|ft|oz|ml|l|kg|lb|k|pk|pack|pcs?)?)$"
MODEL_BEST = r"^[a-z]{0,4}\d{1,6}[a-z]{0,3}(?:\d{0,3}[a-z]{0,3})?$|^[a-z]\d[a-z0-9]*$"
MODEL_BEST_NOT = r"^(?:\d{3,}(?:gb|tb|mb)|\d{3,}|\d{1,2}(?:gb|tb|mb|w|v|hz|mm|cm|in|ft|oz|ml|l|kg|lb|k|pk|pack|pcs?|ct|count))$"

# Brands, aliases.
BRANDS_PAIR = (
    "apple", "samsung", "logitech", "logitech g", "razer", "corsair", "anker", "hyperx", "steelseries", "jbl", "sony", "bose", "sennheiser", "audio-technica",
    "nintendo", "microsoft", "dell", "hp", "lenovo", "asus", "acer", "msi", "gigabyte", "evga", "msi", "sapphire", "xfx", "crucial", "samsung evo",
    "sandisk", "kingston", "wd", "seagate", "lacie", "stanley", "yeti", "hydro flask", "nike", "adidas", "puma", "new balance", "under armour", "vans", "converse",
    "lego", "hasbro", "funko", "dyson", "shark", "bissell", "roborock", "irobot", "keurig", "ninja", "kitchenaid", "cuisinart", "instant pot", "breville",
    "philips", "panasonic", "sharp", "tcl", "hisense", "vizio", "lg", "roku", "amd", "intel", "nvidia", "gskill", "noctua", "be quiet", "coolermaster", "cooler master",
    "tp-link", "netgear", "asrock", "biostar", "mattel", "fisher price", "little tykes", "cannon", "canon", "nikon", "gopro", "dji", "fitbit", "garmin", "withings",
    "oxo", "lodge", "all-clad", "calphalon", "pyrex", "corningware", "corelle",
)
BRANDS_BEST = (
    "apple", "samsung", "logitech", "logitech g", "razer", "corsair", "anker", "hyperx", "steelseries", "jbl", "sony", "bose", "sennheiser", "audio-technica",
    "nintendo", "microsoft", "dell", "hp", "lenovo", "asus", "acer", "msi", "gigabyte", "evga", "sapphire", "xfx", "crucial", "sandisk", "kingston",
    "wd", "western digital", "seagate", "lacie", "stanley", "yeti", "hydro flask", "nike", "adidas", "puma", "new balance", "under armour", "vans", "converse",
    "lego", "hasbro", "funko", "dyson", "shark", "bissell", "roborock", "irobot", "keurig", "ninja", "kitchenaid", "cuisinart", "instant pot", "breville",
    "philips", "panasonic", "sharp", "tcl", "hisense", "vizio", "lg", "roku", "amd", "intel", "nvidia", "gskill", "noctua", "be quiet", "coolermaster", "cooler master",
    "tp-link", "netgear", "asrock", "biostar", "mattel", "fisher price", "canon", "nikon", "gopro", "dji", "fitbit", "garmin",
    "oxo", "lodge", "all-clad", "calphalon", "pyrex", "corningware", "corelle", "brita", "cotopaxi", "jbl", "sonos", "polk", "yamaha", "pioneer",
)
ALIASES_PAIR = {"wd": "western digital", "be quiet": "be quiet!", "coolermaster": "cooler master"}
ALIASES_BEST = {"wd": "western digital", "be quiet": "be quiet!", "coolermaster": "cooler master", "logitech g": "logitech"}
UNBRANDED = ("unbranded", "generic", "oem", "aftermarket", "no brand", "nobrand")

# Category rules, the first hit wins. Matched on the folded title with a space at each end.
CATEGORIES = (
    ("mousepad", ("mouse pad", "mousepad", "mouse mat", "desk pad", "deskpad")),
    ("keyboard", ("keyboard", "keychron", "mechanical keyboard")),
    ("mouse", ("gaming mouse", "wireless mouse", "mouse retrac", " computer mouse", " bluetooth mouse")),
    ("ssd", ("ssd", "solid state", "m 2", "nvme", "sata iii")),
    ("hdd", ("hard drive", "hdd", "external hard")),
    ("ram", ("ddr4", "ddr5", "ddr3", "ram memory", "desktop memory")),
    ("flash", ("usb drive", "flash drive", "thumb drive", "micro sd", "sd card", "memory card")),
    ("phone", ("iphone", "galaxy s", "galaxy note", "pixel ", "smartphone", "unlocked cell")),
    ("tablet", ("ipad", "galaxy tab", "tablet")),
    ("laptop", ("laptop", "macbook", "thinkpad", "chromebook", "notebook")),
    ("monitor", ("monitor", "display 27", "display 32", "ultrawide")),
    ("headphones", ("headphones", "earbuds", "headset", "airpods", "galaxy buds")),
    ("watch", ("apple watch", "smartwatch", "smart watch", "galaxy watch")),
    ("shoes", ("shoes", "sneakers", "sneaker", "boots", "sandals", "loafers", "trainers", "running shoes")),
    ("tumbler", ("tumbler", "quencher", "water bottle", "flask", "mug", "travel mug")),
    ("console", ("playstation", "ps5", "ps4", "xbox series", "nintendo switch", "switch oled")),
    ("game", ("nintendo switch game", "ps5 game", "xbox game", "video game")),
    ("tv", (" smart tv", " 4k tv", "oled tv", " qled", " tv 55", " tv 65", " tv 75")),
    ("camera", ("camera", "lens ", "dslr", "mirrorless", "gopro")),
    ("router", ("router", "mesh wifi", "wifi 6", "wifi 7", "extender")),
    ("powerbank", ("power bank", "powerbank", "portable charger", "battery pack")),
    ("charger", ("charger", "charging cable", "usb c cable", "wall adapter", "gan charger")),
    ("keyboardcase", ("ipad case", "tablet case", "keyboard case")),
    ("toy", ("lego", "playset", "figure", "plush", "doll", "toy")),
    ("apparel", ("shirt", "t shirt", "hoodie", "jacket", "pants", "jeans", "dress", "hooded")),
)
#: What the reference cannot hit, as folding takes the character away: kept apart for strict mode.
STRICT_DEAD_KEYWORDS = ("m 2", "t shirt")

# Variation words of the guards.
GUARD_COLORS = "black white blue red green yellow orange purple pink brown gray grey silver gold beige tan teal navy maroon turquoise lavender clear multicolor matte glossy".split()
GUARD_SIZES = "xs l xl 2xl xxl 3xl xxxl small medium large xlarge petite tall twin full queen king californiaking".split()
GUARD_STYLES = "slim standard long short wide narrow compact mini pro max plus lite ultra classic premium deluxe elite folding foldable rechargeable wireless".split()
GUARD_CAPACITY = r"(\d+(?:\.\d+)?\s*(?:gb|tb|mb|oz|ml|lb|kg|count|ct))\b"


def lowered(c: Column) -> Column:
    return F.lower(text_or_empty(c))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def mapped(c: Column, values: dict) -> Column:
    """The value for c, null if there is none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), c)


def _first_number(t: Column, patterns: Sequence[str], most: int) -> Column:
    """The number that the first of the patterns finds with one from 1 to most."""
    each = F.array(*[found(t, p).cast("int") for p in patterns])
    return F.get(F.filter(each, lambda n: (n >= 1) & (n <= most)), F.lit(0))


def quantity(title: Column, bundle_first: bool = False) -> Column:
    """A1, and A2 with bundle_first ('pack of N' is tried first): pack size, or null."""
    t = lowered(title)
    words = let(found(t, MULTI_WORDS), lambda w: F.coalesce(mapped(w, MULTI_MAP), F.when(w.isNotNull(), F.lit(2))))
    return F.coalesce(_first_number(t, BUNDLE_QUANTITY if bundle_first else QUANTITY, 999), words, F.when(t.rlike(SINGLE_WORDS), F.lit(1)))


def is_bundle(title: Column) -> Column:
    """A4."""
    t = lowered(title)
    return t.rlike(BUNDLE_HINT) | t.rlike(PLUS_ITEM)


def guard_quantity(title: Column) -> Column:
    """A3: pack size on the buying side, 1 if the title has none."""
    return F.coalesce(_first_number(lowered(title), GUARD_QUANTITY, 9999), F.lit(1))


def color(title: Column) -> Column:
    """A5: bucket of the longest colour word."""
    t = lowered(title)
    words = sorted(((w, name) for name, ws in COLORS.items() for w in ws), key=lambda x: -len(x[0]))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for w, name in words:
        out = out.when(t.rlike(f"(?:^|[^a-z]){w}(?:$|[^a-z])"), F.lit(name))
    return out


def storage_gb(title: Column) -> Column:
    """A6."""
    t = lowered(title)
    v, unit = found(t, STORAGE).cast("double"), F.substring(F.regexp_extract(t, STORAGE, 2), 1, 1)
    return F.when(unit == "t", v * 1024).when(unit == "g", v).when(unit == "m", F.floor(v / 1024 * 100 + 0.5) / 100)


def ram_gb(title: Column) -> Column:
    """A7."""
    return found(lowered(title), RAM).cast("double")


def dimensions(title: Column, strict: bool = False) -> Column:
    """Struct of the smaller and the larger side in inches, to one digit; mm without a unit. strict reads metres as centimetres."""
    t = lowered(title)
    parts = F.struct(found(t, DIMENSIONS).cast("double").alias("w"), found(t, DIMENSIONS, 2).cast("double").alias("h"), F.regexp_extract(t, DIMENSIONS, 3).alias("unit"))

    def inches(p: Column) -> Column:
        unit = p["unit"]
        factor = F.when(unit.startswith("in") | (unit == '"'), 1.0).when(unit == "cm", 2.54).when(unit == "m", 2.54 if strict else 0.0254).otherwise(25.4)
        side = lambda x: F.floor(x / factor * 10 + 0.5) / 10
        return F.when((p["w"] > 0) & (p["h"] > 0), F.struct(side(F.least(p["w"], p["h"])).alias("w_in"), side(F.greatest(p["w"], p["h"])).alias("h_in")))

    return let(parts, inches)


def models(title: Column, best_of_n: bool = False) -> Column:
    """A9, and A10 with best_of_n: up to six model numbers, in capitals; a labelled one comes first."""
    t = lowered(title)
    shape, unlike, least = (MODEL_BEST, MODEL_BEST_NOT, 2) if best_of_n else (MODEL_PAIR, MODEL_PAIR_NOT, 3)
    bare = F.filter(
        F.split(fold_key(title), " "), lambda w: (F.length(w) >= least) & (F.length(w) <= 20) & w.rlike("[0-9]") & w.rlike("[a-z]") & ~w.rlike(unlike) & w.rlike(shape)
    )
    every = F.array_compact(F.concat(F.array(F.upper(found(t, MODEL_LABELLED))), F.transform(bare, F.upper)))
    return F.slice(F.array_distinct(every), 1, 6)


def brand(title: Column, best_of_n: bool = False) -> Column:
    """A11, and A12 with best_of_n (unbranded titles give null): the longest known brand, by its main name."""
    names, aliases = (BRANDS_BEST, ALIASES_BEST) if best_of_n else (BRANDS_PAIR, ALIASES_PAIR)
    keys = sorted({b.replace("-", " ") for b in names}, key=lambda b: (-len(b), b))
    # an alternation finds the leftmost brand; the longest one is wanted, so each length is tried in turn
    by_length: dict[int, list[str]] = {}
    for k in keys:
        by_length.setdefault(len(k), []).append(k)

    def of(padded: Column) -> Column:
        name = F.coalesce(*[found(padded, f" ({'|'.join(ks)}) ") for _, ks in sorted(by_length.items(), reverse=True)])
        name = let(name, lambda n: F.coalesce(mapped(n, aliases), n))
        return F.when(~F.trim(padded).rlike("|".join(UNBRANDED)), name) if best_of_n else name

    return let(F.concat(F.lit(" "), fold_key(title), F.lit(" ")), of)


def condition(title: Column) -> Column:
    """A13."""

    def name(w: Column) -> Column:
        kinds = F.when(w.rlike("^(?:refurb|renewed)"), "refurbished").when(w.rlike("open[ -]box"), "open-box").when(w.rlike("pre-?owned|^used|for parts|not working"), "used")
        return kinds.when(w.rlike("new"), "new").otherwise(w)

    return let(found(lowered(title), CONDITION), name)


def condition_of(field: Column, title: Column) -> Column:
    """A13 with a condition field, which beats the title."""
    return F.coalesce(condition(field), condition(title))


def connectivity(title: Column) -> Column:
    """A14."""
    word = F.regexp_replace(found(lowered(title), CONNECTIVITY), r"[\s-]", "")
    return let(word, lambda w: F.when(w.isin("wifi", "wifionly", "wlan"), "wifi").when(w.isNotNull(), "cellular"))


def generation(title: Column) -> Column:
    """Digits; Roman numerals I to X are read."""
    return let(F.upper(found(lowered(title), GENERATION)), lambda v: F.coalesce(mapped(v, {k: str(n) for k, n in ROMAN.items()}), v))


def size_name(title: Column) -> Column:
    """A16."""
    return let(found(lowered(title), SIZE), lambda w: F.coalesce(mapped(w, SIZE_NAMES), w))


def capacity_ml(title: Column) -> Column:
    """A17."""
    t = lowered(title)
    v, unit = found(t, LITRES_OR_OUNCES).cast("double"), F.regexp_extract(t, LITRES_OR_OUNCES, 2)
    return F.coalesce(found(t, MILLILITRES).cast("double"), F.when(unit == "oz", F.floor(v * 29.5735 + 0.5).cast("double")).when(v.isNotNull(), v * 1000))


def category(title: Column, strict: bool = False) -> Column:
    """A18. strict leaves out the keywords that the reference's folding makes unreachable."""

    def of(t: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for name, words in CATEGORIES:
            use = [w for w in words if not (strict and w in STRICT_DEAD_KEYWORDS)]
            hit = F.lit(False)
            for w in use:
                hit = hit | t.contains(w)
            out = out.when(hit, F.lit(name))
        return out.otherwise("general")

    return let(F.concat(F.lit(" "), fold_key(title), F.lit(" ")), of)


def variation_tokens(title: Column, *specifics: Column) -> Column:
    """Colour, size and style words and capacities of the title and of item specifics, in order."""

    def of(text: Column, spaced: bool) -> Column:
        t = fold_variation(text)
        words = F.filter(F.split(t, " "), lambda w: w.isin(GUARD_COLORS + GUARD_SIZES + GUARD_STYLES))
        figures = lambda s: F.transform(F.regexp_extract_all(s, F.lit(GUARD_CAPACITY), 1), lambda x: F.replace(x, F.lit(" ")))
        parts = [words, figures(F.replace(t, F.lit(" ")))]
        return F.concat(*parts, figures(t)) if spaced else F.concat(*parts)

    return F.array_distinct(F.concat(of(title, True), *[of(s, False) for s in specifics]))


def attributes(title: Column, condition_field: Column | None = None) -> Column:
    """All of a title's attributes as one struct."""
    return F.struct(
        brand(title).alias("brand"),
        models(title).alias("models"),
        quantity(title).alias("quantity"),
        color(title).alias("color"),
        storage_gb(title).alias("storage"),
        ram_gb(title).alias("ram"),
        dimensions(title).alias("dimensions"),
        capacity_ml(title).alias("capacity"),
        size_name(title).alias("size"),
        generation(title).alias("generation"),
        connectivity(title).alias("connectivity"),
        (condition(title) if condition_field is None else condition_of(condition_field, title)).alias("condition"),
        category(title).alias("category"),
        is_bundle(title).alias("is_bundle"),
    )
