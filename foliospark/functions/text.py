"""Column expressions over texts: token estimates, language, scripts, flags of bad extraction, masks.

All are built-in expressions, so they stay in generated code.  Null text gives null unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: characters that count one and a half tokens, as Java escapes
WIDE = "[\\x{2E80}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{FE30}-\\x{FE4F}\\x{AC00}-\\x{D7AF}\\x{20000}-\\x{2FA1F}]"
LOADER_WIDE = "[\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}]"
#: white space of any alphabet, as Python's strip and split see it
SPACE = "[\\t-\\r\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
_WHITE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def of_class(text: Column, pattern: str) -> Column:
    """Characters of a class (a pattern that matches one character)."""
    return F.length(text) - F.length(without(text, pattern))


def without(text: Column, pattern: str) -> Column:
    """Without the characters of a class, which go run by run."""
    return F.regexp_replace(text, f"(?:{pattern})+" if not pattern.startswith("[") else f"{pattern}+", "")


def stripped(text: Column) -> Column:
    """Without white space, of any alphabet, at both ends."""
    return F.btrim(text, F.lit(_WHITE))


def _weighted(text: Column, wide: str) -> Column:
    # what isn't wide: all of an ASCII text
    n = F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise(F.length(without(text, wide)))
    return ((F.length(text) - n) * F.lit(1.5) + n * F.lit(0.25)).cast("int")


def estimate_tokens(text: Column) -> Column:
    """Tokens of a text: 1.5 a wide character, 0.25 any other, whole part, one at least."""
    return F.greatest(F.lit(1), _weighted(text, WIDE))


def loader_tokens(text: Column) -> Column:
    """The chunk loader's estimate: fewer wide ranges and no floor; empty is 0."""
    return F.when(F.length(text) == 0, 0).otherwise(_weighted(text, LOADER_WIDE))


_LETTERS = "".join(map(chr, range(0x41, 0x7B)))  # and what stands between capitals and small letters


def detect_language(text: Column, sample: int = 2000) -> Column:
    """ja, ko, zh, en or unknown, by shares of scripts among what isn't white space in the first ``sample`` characters."""

    def named(ink: Column) -> Column:
        share = lambda p: of_class(ink, p) / F.length(ink)
        return (
            F.when(ink.isNull(), None).when(F.length(ink) == 0, "unknown").when(share("[\\x{3040}-\\x{30FF}\\x{31F0}-\\x{31FF}]") > 0.05, "ja")
            .when(share("[\\x{AC00}-\\x{D7AF}]") > 0.05, "ko").when(share("[\\x{4E00}-\\x{9FFF}]") > 0.10, "zh")
            .when((F.length(ink) - F.length(F.translate(ink, _LETTERS, ""))) / F.length(ink) > 0.5, "en").otherwise("unknown")
        )

    return let(F.regexp_replace(F.substring(text, 1, sample), f"{SPACE}+", ""), named)


# --- scripts ---------------------------------------------------------------------------------------------------

#: bounds of code points by script; what is in none is Other, what all languages use is Common
SCRIPTS: dict[str, list[tuple[int, int]]] = {
    "Common": [(0, 0x40), (0x5B, 0x60), (0x7B, 0x7E), (0xA0, 0xBF), (0x2000, 0x20CF), (0x2100, 0x22FF), (0x2500, 0x257F), (0x25A0, 0x27BF), (0x3000, 0x303F), (0xFF00, 0xFFFF)],
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF)], "Cyrillic": [(0x400, 0x52F)], "Hebrew": [(0x590, 0x5FF)], "Arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "Devanagari": [(0x900, 0x97F)], "Bengali": [(0x980, 0x9FF)], "Gurmukhi": [(0xA00, 0xA7F)], "Gujarati": [(0xA80, 0xAFF)], "Oriya": [(0xB00, 0xB7F)],
    "Tamil": [(0xB80, 0xBFF)], "Telugu": [(0xC00, 0xC7F)], "Kannada": [(0xC80, 0xCFF)], "Malayalam": [(0xD00, 0xD7F)], "Sinhala": [(0xD80, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)], "Lao": [(0xE80, 0xEFF)], "Tibetan": [(0xF00, 0xFFF)], "Myanmar": [(0x1000, 0x109F)], "Khmer": [(0x1780, 0x17FF)],
    "Han": [(0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B81F)],
    "Hiragana": [(0x3040, 0x309F)], "Katakana": [(0x30A0, 0x30FF), (0x31F0, 0x31FF)], "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
}
EXPECTED = {"ja": ("Latin", "Han", "Hiragana", "Katakana"), "zh": ("Latin", "Han", "Hiragana", "Katakana"), "ko": ("Latin", "Han", "Hangul"), "en": ("Latin",)}


def script_class(names: Iterable[str], negate: bool = False) -> str:
    """A regular expression for one character of the scripts (or, negated, of none of them)."""
    return ("[^" if negate else "[") + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for n in names for a, b in SCRIPTS[n]) + "]"


def script_of(character: Column) -> Column:
    """The script of a text of one character."""
    return F.coalesce(*[F.when(character.rlike(f"^{script_class([n])}"), n) for n in SCRIPTS], F.lit("Other"))


def script_counts(text: Column) -> Column:
    """Characters by script, those without any left out, as a map; Other is what no script has.  What is common and
    Latin goes first, so that the other scripts are looked for in what little is left of most texts.  Each use of the
    result in one select works it out again: give it a name first."""
    some = lambda counts: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in counts.items()]), lambda x: x["value"] > 0))

    def all_of(common: Column, plain: Column, rest: Column) -> Column:
        two = {"Common": common, "Latin": F.length(plain) - F.length(rest)}
        more = {k: of_class(rest, script_class([k])) for k in SCRIPTS if k not in two}
        return F.when(F.length(rest) == 0, some(two)).otherwise(some({**two, **more, "Other": of_class(rest, script_class(SCRIPTS, True))}))

    plain, rest = (lambda t, k=k: without(t, script_class([k])) for k in ("Common", "Latin"))
    return let(text, lambda t: let(plain(t), lambda p: let(rest(p), lambda r: all_of(F.length(t) - F.length(p), p, r))))


def unexpected_ratio(text: Column, scripts: Iterable[str], counts: Column | None = None) -> Column:
    """Share of characters of other scripts; what is common to all languages never counts.  Empty texts have 0.  counts:
    the text's ``script_counts``, if there."""
    known = ["Common", *scripts]
    others = of_class(text, script_class(known, True)) if counts is None else F.length(text) - sum(F.coalesce(counts[k], F.lit(0)) for k in known)
    return F.when(F.length(text) > 0, others / F.length(text)).otherwise(F.when(text.isNotNull(), 0.0))


def unexpected_scripts(text: Column, language: Column, most: float = 0.05, least: int = 50, expected: dict[str, tuple[str, ...]] = EXPECTED) -> Column:
    """Whether more than ``most`` of a text of ``least`` characters or more is in scripts that its language doesn't
    use (of an unknown language: that none of the languages uses)."""
    every = sorted({s for names in expected.values() for s in names})
    ratio = F.coalesce(*[F.when(language == k, unexpected_ratio(text, v)) for k, v in expected.items()], unexpected_ratio(text, every))
    return (F.length(text) >= least) & (ratio > most)


# --- signs of bad extraction -----------------------------------------------------------------------------------

_CJK = script_class(["Hiragana"])[:-1] + "\\x{30A0}-\\x{30FF}\\x{4E00}-\\x{9FFF}]"


def garble_marks(text: Column) -> Column:
    return sum(((F.length(text) - F.length(F.replace(text, F.lit(m)))) / len(m)).cast("int") for m in ("glyph<", "glyph&lt;"))


def garbled(text: Column, least: int = 10) -> Column:
    """Whether marks of unmapped glyphs occur ``least`` times or more."""
    return garble_marks(text) >= least


def mixed_scripts(text: Column, most: int = 3) -> Column:
    """Whether more than ``most`` scraps of up to three Latin letters stand between CJK characters."""
    return F.regexp_count(text, F.lit(f"{_CJK}[A-Za-z]{{1,3}}{_CJK}")) > most


def nothing_added(text: Column) -> Column:
    """Whether a describer said that a page holds nothing more."""
    return F.lower(F.regexp_replace(stripped(text), "^[.。]+|[.。]+$", "")).isin("(no additional visual content)", "no additional visual content")


def table_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike("(?U)^[\\s\\x1C-\\x1F]*\\|")))


def plain_page(text: Column, pictures: Column, structured: Column, language: Column, least: int = 50, replaced_most: float = 0.05, table_least: int = 30, mixed_most: int = 8) -> Column:
    """Whether a page can go without a describer: no picture, no structured data, text enough, and no sign of bad
    extraction.  Any doubt means it can't."""
    t = stripped(text)
    replaced = (F.length(t) - F.length(F.replace(t, F.lit("�")))) / F.length(t)
    doubts = [
        text.contains("<!-- image -->"), F.coalesce(pictures, F.lit(0)) > 0, F.length(F.coalesce(structured, F.lit(""))) > 0, F.length(t) < least,
        garble_marks(text) > 0, t.rlike("&[lg]t;"), replaced > replaced_most, table_lines(t) >= table_least, mixed_scripts(t, mixed_most),
        unexpected_scripts(t, language),
    ]
    some = doubts[0]
    for d in doubts[1:]:
        some = some | F.coalesce(d, F.lit(False))
    return ~F.coalesce(some, F.lit(True))


# --- personal data ---------------------------------------------------------------------------------------------

_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_GROUP = "\\d{4}[\\s-]?"
#: rule, pattern and mask, in the order of their use; the cards must also pass Luhn's test
RULES: dict[str, tuple[str, str]] = {
    "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "[EMAIL]"),
    "url": ("(?U)https?://[A-Za-z0-9.-]+(?::\\d+)?(?:/\\S*)?", "[URL]"),
    "credit_card": (f"(?U)\\b{_GROUP * 3}\\d{{1,7}}\\b", "[CREDIT_CARD]"),
    "ipv4": (f"(?U)\\b(?:{_OCTET}\\.){{3}}{_OCTET}\\b", "[IP_ADDRESS]"),
    "phone_jp": ("(?U)\\b0\\d{1,4}[-\\s()]{1,2}\\d{1,4}[-\\s]\\d{3,4}\\b", "[PHONE]"),
}
_FULL_DIGITS = "".join(chr(0xFF10 + i) for i in range(10))


def luhn(number: Column) -> Column:
    """Luhn's test of thirteen digits or more; spaces and dashes between them don't count."""
    digits = F.translate(F.regexp_replace(number, "(?U)[\\s-]", ""), _FULL_DIGITS, "0123456789")
    return (F.length(digits) >= 13) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def _found(text: Column, rule: str) -> Column:
    return F.regexp_extract_all(text, F.lit(RULES[rule][0]), F.lit(0))


def _masked(text: Column, rule: str) -> Column:
    pattern, mask = RULES[rule]
    if rule != "credit_card":
        return F.regexp_replace(text, pattern, mask.replace("$", "\\$"))
    # match by match: what stands between the matches, and each match as it is or masked
    new = F.transform(_found(text, rule), lambda m: F.when(luhn(m), mask).otherwise(m))
    return F.array_join(F.zip_with(F.split(text, pattern), new, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")


def sanitized(text: Column, rules: Iterable[str] = tuple(RULES)) -> Column:
    """Text with e-mail addresses, URLs, cards, IPv4 addresses and Japanese phone numbers masked, in this order, each
    rule on what the rule before left."""
    for rule in rules:
        text = _masked(text, rule)
    return text


def pii_counts(text: Column, rules: Iterable[str] = tuple(RULES)) -> dict[str, Column]:
    """How often each rule masks, in the same order."""
    out = {}
    for rule in rules:
        found = _found(text, rule)
        out[rule] = F.size(F.filter(found, luhn) if rule == "credit_card" else found)
        text = _masked(text, rule)
    return out


def pii_table(df: DataFrame, text: str, rules: Iterable[str] = tuple(RULES)) -> DataFrame:
    """df with a column of counts for each rule and ``masked``: rule by rule, so that no text is masked twice."""
    kept = df.columns
    df = df.withColumn("masked", F.col(text))
    for rule in rules:
        found = _found(F.col("masked"), rule)
        df = df.withColumns({rule: F.size(F.filter(found, luhn) if rule == "credit_card" else found), "masked": _masked(F.col("masked"), rule)})
    return df.select(*kept, *rules, "masked")


# --- keywords --------------------------------------------------------------------------------------------------

STOP = ("group", "list", "slide")
_RUN = "[\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]{2,}"
_PARTICLES = ("^[のはをがにでとも]+", "に関する$", "について$", "における$", "および$")


def keywords_in(text: Column, latin_least: int = 3, run_least: int = 3, core_least: int = 2) -> Column:
    """Latin words, then CJK runs with their particles stripped (or whole, if that leaves too little)."""
    words = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= latin_least) & ~w.isin(*STOP))

    def core(run: Column) -> Column:
        for p in _PARTICLES:
            run = F.regexp_replace(run, p, "")
        return run

    runs = F.transform(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0)), lambda r: F.when((F.length(core(r)) >= core_least) & ~core(r).isin(*STOP), core(r)).when(F.length(r) >= run_least, r))
    return F.concat(words, F.array_compact(runs))
