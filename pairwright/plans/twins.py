"""DuckDB SQL for the column functions: the twins that the registered queries are held against."""

from __future__ import annotations

from pairwright.functions import attributes as A
from pairwright.functions import text as T


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(s: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({s}, {q(pattern)}, {group}), '')"


def rr(s: str, pattern: str, to: str = " ") -> str:
    return f"regexp_replace({s}, {q(pattern)}, {q(to)}, 'g')"


def rl(s: str, pattern: str) -> str:
    return f"regexp_matches({s}, {q(pattern)})"


def low(s: str) -> str:
    return f"lower(coalesce({s}, ''))"


def words(names) -> str:
    return "[" + ", ".join(q(w) for w in dict.fromkeys(names)) + "]"


def squeeze(s: str) -> str:
    return f"trim({rr(s, chr(92) + 's+')})"


def fold_key(s: str) -> str:
    t = f"translate({low(s)}, {q(T.ACCENTED)}, {q(T.PLAIN)})"
    spelt = "MAP {" + ", ".join(f"{q(c)}: {q(w)}" for c, w in T.MANY.items()) + "}"
    many = f"array_to_string(list_transform(string_split({t}, ''), lambda ch: coalesce({spelt}[ch], ch)), '')"
    return f"trim({rr(f'(case when {rl(t, T.ANY_OF_MANY)} then {many} else {t} end)', '[^a-z0-9]+')})"


def fold_variation(s: str) -> str:
    return f"trim({rr(low(s), '[^a-z0-9.]+')})"


def long_tokens(folded: str) -> str:
    return f"list_distinct(list_filter(string_split({folded}, ' '), lambda w: length(w) > 1))"


def title_tokens(s: str) -> str:
    return f"list_filter({long_tokens(rr(low(s), '[^a-z0-9]+'))}, lambda w: not list_contains({words(T.STOPWORDS)}, w))"


def strip_spam(s: str) -> str:
    t = f"(' ' || replace({low(s)}, chr(160), ' ') || ' ')"
    for p in (*T.SPAM_PHRASES, *T.AFTER_PHRASES):
        t = rr(t, p)
    return squeeze(t)


def strip_attr_noise(s: str) -> str:
    t = fold_key(s)
    for p in T.ATTR_NOISE:
        t = rr(t, p)
    return squeeze(t)


def shared(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def jaccard(a: str, b: str) -> str:
    return f"(case when len({a}) > 0 and len({b}) > 0 then {shared(a, b)} / (len({a}) + len({b}) - {shared(a, b)}) else 0 end)"


def blend(a: str, b: str) -> str:
    n = shared(a, b)
    return f"(case when len({a}) > 0 and len({b}) > 0 then least(1.0::double, 0.5::double * ({n} / (len({a}) + len({b}) - {n})) + 0.5::double * ({n} / least(len({a}), len({b})))) else 0 end)"


def numbers(s: str) -> str:
    return f"regexp_extract_all(coalesce({s}, ''), '(\\d{{3,}})', 1)"


def blend_with_numbers(a: str, b: str, na: str, nb: str) -> str:
    same = f"len(list_filter({na}, lambda d_: list_contains({nb}, d_)))"
    return f"(case when len({a}) > 0 and len({b}) > 0 and {same} > 0 then least(1.0::double, {blend(a, b)} + 0.08::double * {same}) else {blend(a, b)} end)"


def mapped(s: str, values: dict) -> str:
    lit = lambda v: q(v) if isinstance(v, str) else str(v)
    return f"(case {s} " + " ".join(f"when {q(k)} then {lit(v)}" for k, v in values.items()) + " end)"


def _number(s: str, patterns, most: int) -> list[str]:
    out = []
    for p in patterns:
        n = f"try_cast({rx(s, p)} as integer)"
        out.append(f"case when {n} between 1 and {most} then {n} end")
    return out


def quantity(s: str, bundle_first: bool = False) -> str:
    t = low(s)
    w = rx(t, A.MULTI_WORDS)
    parts = [*_number(t, A.BUNDLE_QUANTITY if bundle_first else A.QUANTITY, 999), mapped(w, A.MULTI_MAP), f"case when {w} is not null then 2 end", f"case when {rl(t, A.SINGLE_WORDS)} then 1 end"]
    return f"coalesce({', '.join(parts)})"


def guard_quantity(s: str) -> str:
    return f"coalesce({', '.join(_number(low(s), A.GUARD_QUANTITY, 9999))}, 1)"


def is_bundle(s: str) -> str:
    return f"({rl(low(s), A.BUNDLE_HINT)} or {rl(low(s), A.PLUS_ITEM)})"


def color(s: str) -> str:
    ws = sorted(((w, n) for n, each in A.COLORS.items() for w in each), key=lambda x: -len(x[0]))
    return "(case " + " ".join(f"when {rl(low(s), f'(?:^|[^a-z]){w}(?:$|[^a-z])')} then {q(n)}" for w, n in ws) + " end)"


def storage_gb(s: str) -> str:
    t = low(s)
    v = f"cast({rx(t, A.STORAGE)} as double)"
    return f"(case left({rx(t, A.STORAGE, 2)}, 1) when 't' then {v} * 1024 when 'g' then {v} when 'm' then floor({v} / 1024 * 100 + 0.5) / 100 end)"


def ram_gb(s: str) -> str:
    return f"cast({rx(low(s), A.RAM)} as double)"


def dimension(s: str, which: str) -> str:
    t = low(s)
    w, h, u = f"cast({rx(t, A.DIMENSIONS)} as double)", f"cast({rx(t, A.DIMENSIONS, 2)} as double)", rx(t, A.DIMENSIONS, 3)
    k = f"(case when {u} in ('in', 'inch', 'inches', '\"') then 1.0::double when {u} = 'cm' then 2.54::double when {u} = 'm' then 0.0254::double else 25.4::double end)"
    return f"(case when {w} > 0 and {h} > 0 then floor({which}({w}, {h}) / {k} * 10 + 0.5) / 10 end)"


def capacity_ml(s: str) -> str:
    t = low(s)
    v, u = f"cast({rx(t, A.LITRES_OR_OUNCES)} as double)", rx(t, A.LITRES_OR_OUNCES, 2)
    return f"coalesce(cast({rx(t, A.MILLILITRES)} as double), case when {u} = 'oz' then floor({v} * 29.5735::double + 0.5) when {v} is not null then {v} * 1000 end)"


def size_name(s: str) -> str:
    w = rx(low(s), A.SIZE)
    return f"coalesce({mapped(w, A.SIZE_NAMES)}, {w})"


def condition(s: str) -> str:
    w = rx(low(s), A.CONDITION)
    return f"(case when {rl(w, '^(?:refurb|renewed)')} then 'refurbished' when {rl(w, 'open[ -]box')} then 'open-box' when {rl(w, 'pre-?owned|^used|for parts|not working')} then 'used' when {rl(w, 'new')} then 'new' else {w} end)"


def connectivity(s: str) -> str:
    w = rr(rx(low(s), A.CONNECTIVITY), r"[\s-]", "")
    return f"(case when {w} in ('wifi', 'wifionly', 'wlan') then 'wifi' when {w} is not null then 'cellular' end)"


def generation(s: str) -> str:
    v = f"upper({rx(low(s), A.GENERATION)})"
    return f"coalesce({mapped(v, {k: str(n) for k, n in A.ROMAN.items()})}, {v})"


def category(s: str) -> str:
    t = f"(' ' || {fold_key(s)} || ' ')"
    return "(case " + " ".join("when " + " or ".join(f"contains({t}, {q(w)})" for w in ws) + f" then {q(n)}" for n, ws in A.CATEGORIES) + " else 'general' end)"


def brand(s: str, best_of_n: bool = False) -> str:
    names, aliases = (A.BRANDS_BEST, A.ALIASES_BEST) if best_of_n else (A.BRANDS_PAIR, A.ALIASES_PAIR)
    by: dict[int, list[str]] = {}
    for k in sorted({b.replace("-", " ") for b in names}):
        by.setdefault(len(k), []).append(k)
    t = f"(' ' || {fold_key(s)} || ' ')"
    name = "coalesce(" + ", ".join(rx(t, f" ({'|'.join(ks)}) ") for _, ks in sorted(by.items(), reverse=True)) + ")"
    name = f"coalesce({mapped(name, aliases)}, {name})"
    return f"(case when not {rl(fold_key(s), '|'.join(A.UNBRANDED))} then {name} end)" if best_of_n else name


def models(s: str, best_of_n: bool = False) -> str:
    shape, unlike, least = (A.MODEL_BEST, A.MODEL_BEST_NOT, 2) if best_of_n else (A.MODEL_PAIR, A.MODEL_PAIR_NOT, 3)
    keep = f"length(w) between {least} and 20 and {rl('w', '[0-9]')} and {rl('w', '[a-z]')} and not {rl('w', unlike)} and {rl('w', shape)}"
    return f"list_distinct(list_filter(list_concat([upper({rx(low(s), A.MODEL_LABELLED)})], list_transform(list_filter(string_split({fold_key(s)}, ' '), lambda w: {keep}), lambda w: upper(w))), lambda m: m is not null))"


def same_models(a: str, b: str) -> str:
    hit = f"len(list_filter({a}, lambda x: len(list_filter({b}, lambda y: x = y or (length(x) >= 4 and contains(y, x)) or (length(y) >= 4 and contains(x, y)))) > 0)) > 0"
    return f"(case when len({a}) > 0 and len({b}) > 0 then {hit} end)"


def variation_tokens(s: str) -> str:
    t = fold_variation(s)
    flat = f"replace({t}, ' ', '')"
    known = words(A.GUARD_COLORS + A.GUARD_SIZES + A.GUARD_STYLES)
    figures = lambda x: f"list_transform(regexp_extract_all({x}, {q(A.GUARD_CAPACITY)}, 1), lambda f: replace(f, ' ', ''))"
    return f"list_distinct(list_concat(list_filter(string_split({t}, ' '), lambda w: list_contains({known}, w)), list_concat({figures(flat)}, {figures(t)})))"


def joined(s: str) -> str:
    """A list as sorted text, as list_distinct keeps no order."""
    return f"array_to_string(list_sort({s}), ' ')"


def rounded(s: str, digits: int) -> str:
    k = 10**digits
    return f"(floor(({s}) * {k}.0::double + 0.5) / {k}.0::double)"


def number(s: str, pattern: str = r"(\d+(?:\.\d{1,2})?)") -> str:
    return f"cast({rx(s, pattern)} as double)"
