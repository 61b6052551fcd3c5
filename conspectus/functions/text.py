"""Scalar text functions as Column expressions: normalisation, detection, counting, display."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Whitespace words; an empty text has none."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def normalise(c: Column) -> Column:
    return strip(F.lower(c))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(c), r"\s+", " "))


def _first_off(c: Column, fillers: list[str]) -> Column:
    """Fillers taken off the start one after another, each once, in the list's order."""
    for w in fillers:
        c = F.regexp_replace(c, rf"^{w}\s+", "")
    return c


def without(c: Column, phrases: list[str]) -> Column:
    """Fixed phrases taken out wherever they stand, in the list's order."""
    for p in phrases:
        c = F.replace(c, F.lit(p), F.lit(""))
    return c


def _words_off(c: Column, words_: list[str], tail: str = "") -> Column:
    """Whole words taken out; word bounds know all scripts."""
    for w in words_:
        c = F.regexp_replace(c, rf"(?U)\b{w}{tail or chr(92) + 'b'}", "")
    return c


def normalise_catalogue(c: Column, noise: list[str] | None = None) -> Column:
    """Lower-case, one space, leading fillers off one after another, noise phrases out, hyphens as spaces."""
    out = without(_first_off(collapse(c), L.FILLERS), L.NAME_NOISE if noise is None else noise)
    return strip(F.regexp_replace(F.replace(out, F.lit("-"), F.lit(" ")), r"\s+", " "))


def normalise_catalogue_ru(c: Column, noise: list[str] | None = None) -> Column:
    """Russian names: one letter for two, noise words out, no quotes, one form of two phrases."""
    out = _words_off(F.replace(collapse(c), F.lit("ё"), F.lit("е")), L.NAME_NOISE_RU if noise is None else noise)
    out = F.translate(out, "-\"'", " ")
    special = F.regexp_replace(F.regexp_replace(out, "соотношени[яе]ми?", "соотношение"), "неопределенносте[йи]", "неопределенности")
    out = F.when(F.contains(out, F.lit("соотношение")) | F.contains(out, F.lit("принцип")), special).otherwise(out)
    return strip(F.regexp_replace(out, r"\s+", " "))


def normalise_candidate(c: Column, language: Column) -> Column:
    out = collapse(c)
    return F.when(language == "ru", F.replace(out, F.lit("ё"), F.lit("е"))).otherwise(out)


def normalise_dedup(c: Column, language: str = "en") -> Column:
    """Names for comparison: fillers off the start, dangling pronouns off both ends, bare function words become empty."""
    out = _first_off(collapse(c), L.DEDUP_FILLERS.get(language, []))
    if language == "ru":
        dangling = "|".join(L.DANGLING_RU)
        out = F.regexp_replace(F.regexp_replace(out, rf"\s+({dangling})$", ""), rf"^({dangling})\s+", "")
    out = collapse(out)
    return F.when(out.isin(*L.BARE_WORDS.get(language, L.BARE_WORDS["en"])), "").otherwise(out)


def normalise_signature(c: Column, language: str = "en") -> Column:
    if language != "ru":
        return _first_off(collapse(c), L.SIGNATURE_FILLERS)
    out = _first_off(_words_off(collapse(c), L.NOISE_ANYWHERE_RU, r"\s+"), [w.replace(" ", r"\s+") for w in L.NOISE_AT_START_RU])
    return without(out, L.TRANSCRIPT_PHRASES_RU)


def normalise_russian(c: Column) -> Column:
    """The short form for segments: one letter for two, one space, none before a full stop or comma."""
    out = strip(F.regexp_replace(F.translate(c, "ёЁ", "еЕ"), r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(out, r"\s+\.", "."), r"\s+,", ",")


def normalise_transcript_ru(c: Column, anywhere: list[str] | None = None, at_start: list[str] | None = None, phrases: list[str] | None = None) -> Column:
    """The full form: punctuation, speaker tags and notes as in English, then noise words and phrases out."""
    out = strip(F.regexp_replace(F.translate(c, "ёЁ", "еЕ"), r"\s+", " "))
    out = F.regexp_replace(out, r"([\p{L}\p{N}_])\.([\p{L}\p{N}_])", "$1. $2")
    out = F.regexp_replace(F.regexp_replace(out, r"\[[\p{L}\p{N}_]+\]:", ""), r"\.{3,}", "...")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"\[.*?\]", ""), r"\s+,", ","), r"\s+\.", ".")
    out = _words_off(out, L.NOISE_ANYWHERE_RU if anywhere is None else anywhere, r"\s+")
    out = _first_off(out, [w.replace(" ", r"\s+") for w in (L.NOISE_AT_START_RU if at_start is None else at_start)])
    return strip(without(out, L.TRANSCRIPT_PHRASES_RU if phrases is None else phrases))


def normalise_transcript(c: Column) -> Column:
    """Spacing, speaker tags and bracketed notes; the order of the steps matters."""
    out = F.regexp_replace(c, r"\s+", " ")
    out = F.replace(out, F.lit(" i "), F.lit(" I "))
    out = F.regexp_replace(out, r"([\p{L}\p{N}_])\.([\p{L}\p{N}_])", "$1. $2")
    out = F.regexp_replace(out, r"\[[^\]]*\]:?", "")
    out = F.regexp_replace(out, r"\.{3,}", "...")
    return strip(F.regexp_replace(out, r"\s+([,.])", "$1"))


SCRIPTS = {"Latin": r"\p{IsLatin}", "Cyrillic": r"\p{IsCyrillic}", "Greek": r"\p{IsGreek}", "Arabic": r"\p{IsArabic}", "Hebrew": r"\p{IsHebrew}", "CJK": r"\p{IsHan}"}


def script(c: Column) -> Column:
    """The script that most letters are of; the first of SCRIPTS for a draw, Latin without any."""
    counts = {name: F.regexp_count(c, F.lit(rf"(?=\p{{L}}){p}")) for name, p in SCRIPTS.items()}
    most = F.greatest(*counts.values())
    out = F.when(F.coalesce(most, F.lit(0)) == 0, "Latin")
    for name, n in counts.items():
        out = out.when(n == most, name)
    return out


def declared_language(declared: Column, text: Column, supported: tuple[str, ...] = ("en", "ru")) -> Column:
    """The base of a declared code if it is supported, else the language of the text's script, else English."""
    base = F.lower(F.split_part(F.coalesce(declared, F.lit("")), F.lit("-"), F.lit(1)))
    return F.when(base.isin(*supported), base).when(script(text) == "Cyrillic", "ru").otherwise("en")


def language(c: Column) -> Column:
    head = F.substring(c, 1, 2000)
    latin, cyrillic = F.regexp_count(head, F.lit("[a-zA-Z]")), F.regexp_count(head, F.lit("[а-яА-ЯёЁ]"))
    return F.when((latin + cyrillic > 0) & (cyrillic > 0.5 * (latin + cyrillic)), "ru").otherwise("en")


def count_of(c: Column, part: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def keyword_domain(c: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """The domain whose keywords occur most often; the first of equals; unknown without any."""
    low = F.lower(c)
    sums = {d: sum((count_of(low, k) for k in ks), F.lit(0)) for d, ks in (keywords or L.DOMAIN_KEYWORDS["en"]).items()}
    most = F.greatest(*sums.values())
    out = F.when(most == 0, "unknown")
    for d, s in sums.items():
        out = out.when(s == most, d)
    return out


def metadata_domain(c: Column, keywords: dict[str, list[str]] | None = None, bonus: dict[str, str] | None = None) -> Column:
    """struct(domain, confidence): keywords present in a title and description; the first word of ``bonus`` there adds two.

    A draw gives the first domain with 0.5; else the confidence is the share of the best,
    raised by 0.2 up to 0.95 for a count of three or more.
    """
    low, keywords, bonus = F.lower(c), keywords or L.METADATA_KEYWORDS["en"], L.METADATA_BONUS if bonus is None else bonus
    has = lambda w: F.contains(low, F.lit(w))
    # a word counts for its own domain only, so each domain looks for its word alone
    counts = {d: sum((has(k).cast("int") for k in ks), F.lit(0)) + (F.when(has(bonus[d]), 2).otherwise(0) if d in bonus else F.lit(0)) for d, ks in keywords.items()}
    most, total = F.greatest(*counts.values()), sum(counts.values(), F.lit(0))
    best, ties = F.when(most == 0, "unknown"), sum(((n == most).cast("int") for n in counts.values()), F.lit(0))
    for d, n in counts.items():
        best = best.when(n == most, d)
    share = most / total
    confidence = F.when(most == 0, 0.0).when(ties > 1, 0.5).when(most >= 3, F.least(share + 0.2, F.lit(0.95))).otherwise(share)
    return F.struct(best.alias("domain"), confidence.alias("confidence"))


def domain_category(c: Column) -> Column:
    """The catalogue file of a domain."""
    known = F.create_map(*[F.lit(x) for pair in L.CATEGORY_OF_DOMAIN.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(c)), F.lit("interdisciplinary"))


def compatible_domains(a: Column, b: Column, groups: dict[str, str] | None = None) -> Column:
    """Equal, or one of them unknown, or both of one group."""
    known = F.create_map(*[F.lit(x) for pair in (groups or L.DOMAIN_GROUPS).items() for x in pair])
    unknown = a.isNull() | b.isNull() | (a == "unknown") | (b == "unknown")
    return F.coalesce(unknown | (a == b) | (F.try_element_at(known, a) == F.try_element_at(known, b)), F.lit(False))


def in_context(c: Column, terms: list[str] | None, least: Column | int = 1) -> Column:
    """Whether a text holds at least so many of a domain's terms; any text does for a domain without terms."""
    return F.lit(True) if not terms else markers_in(c, terms) >= least


def marked(c: Column, markers: list[str] | None = None) -> Column:
    """Whether any marker stands in the text, inside words too."""
    return c.rlike("(?i)" + "|".join(map(re.escape, markers or L.MARKERS)))


def pattern_words(c: Column) -> Column:
    """Lower-case words of letters, digits, underscores and hyphens with more than two characters."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_-]*[\p{L}\p{N}_][\p{L}\p{N}_-]*"), F.lit(0)), lambda w: F.length(w) > 2)


def pattern_match(pattern: Column, c: Column) -> Column:
    """The share of a pattern's terms that a text holds; 0 for no pattern."""
    low = F.lower(c)
    return F.when(F.size(pattern) == 0, 0.0).otherwise(F.size(F.filter(pattern, lambda t: F.contains(low, t))) / F.size(pattern))


def transliterate(c: Column, terms: dict[str, str] | None = None, letters: dict[str, str] | None = None) -> Column:
    """Russian to English: a known term, else the first one contained replaced, else letter by letter."""
    terms, letters = L.TERMS_RU if terms is None else terms, letters or L.LETTERS_RU
    low = F.lower(c)
    known = F.create_map(*[F.lit(x) for pair in terms.items() for x in pair]) if terms else None
    single = {a: b for a, b in letters.items() if len(b) == 1}
    single |= {a.upper(): b.upper() for a, b in single.items()}
    out = F.translate(c, "".join(single), "".join(single.values()))
    for a, b in letters.items():
        if len(b) != 1:
            out = F.replace(F.replace(out, F.lit(a), F.lit(b)), F.lit(a.upper()), F.lit(b.capitalize()))
    found = F.when(F.lit(False), c)
    for a, b in terms.items():
        found = found.when(F.contains(low, F.lit(a)), F.replace(low, F.lit(a), F.lit(b)))
    found = found.otherwise(out)
    return F.coalesce(F.try_element_at(known, low), found) if known is not None else found


def to_russian(c: Column, terms: dict[str, str] | None = None) -> Column:
    """English to Russian by terms alone; other texts stay as they are."""
    terms = {b: a for a, b in (L.TERMS_RU if terms is None else terms).items()}
    low = F.lower(c)
    found = F.when(F.lit(False), c)
    for a, b in sorted(terms.items(), key=lambda x: list(terms).index(x[0])):
        found = found.when(F.contains(low, F.lit(a)), F.replace(low, F.lit(a), F.lit(b)))
    known = F.create_map(*[F.lit(x) for pair in terms.items() for x in pair])
    return F.coalesce(F.try_element_at(known, low), found.otherwise(c))


def transliteration(c: Column, source: Column, target: Column) -> Column:
    """Dispatch by pair of languages; other pairs leave the text."""
    return F.when((source == "ru") & (target == "en"), transliterate(c)).when((source == "en") & (target == "ru"), to_russian(c)).otherwise(c)


def display_name(representations: Column) -> Column:
    """The first English text, else the first of the first language."""
    first = lambda texts: F.try_element_at(texts, F.lit(1))
    return F.coalesce(first(F.try_element_at(representations, F.lit("en"))), first(F.try_element_at(F.map_values(representations), F.lit(1))))


def theory_ratio(theory: Column, practice: Column) -> Column:
    """Share of theoretical indicators through a logistic curve; 0.5 without indicators."""
    r = theory / (theory + practice)
    curve = 1 / (1 + 2.5 * F.pow(F.lit(L.RATIO_BASE), -5 * (r - 0.5)))
    return F.when(theory + practice == 0, 0.5).otherwise(curve)


def ratio_class(r: Column) -> Column:
    return F.when(r > 0.7, "theoretical").when(r < 0.3, "practical").otherwise("mixed")


def indicator_ratio(c: Column, theory: list[str] | None = None, practice: list[str] | None = None) -> Column:
    """The ratio of a text from its theoretical and practical indicators."""
    low = F.lower(c)
    t, p = (sum((count_of(low, w) for w in ws), F.lit(0)).cast("double") for ws in (theory or L.THEORETICAL["en"], practice or L.PRACTICAL["en"]))
    return theory_ratio(t, p)


def educational_value_ru(c: Column) -> Column:
    return F.least(1 + F.size(words(c)) / 20, F.lit(4.0))


def markers_in(c: Column, markers: list[str]) -> Column:
    low = F.lower(c)
    return sum((F.contains(low, F.lit(m)).cast("int") for m in markers), F.lit(0))


def educational_value(c: Column, markers: list[str], key_terms: Column | None = None) -> Column:
    """0.8 for each marker, up to 2 for length, 0.5 for each key term."""
    value = 0.8 * markers_in(c, markers) + F.least(F.size(words(c)) / 20, F.lit(2.0))
    if key_terms is not None:
        low = F.lower(c)
        value = value + 0.5 * F.size(F.filter(key_terms, lambda t: F.contains(low, t)))
    return value


def timecode(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60).cast("long")
    shown = F.when(minutes < 10, F.concat(F.lit("0"), minutes.cast("string"))).otherwise(minutes.cast("string"))
    return F.concat(shown, F.lit(":"), F.lpad((F.floor(seconds) % 60).cast("string"), 2, "0"))


def shortened(c: Column, limit: int = 70) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def slug(c: Column) -> Column:
    """An identifier of a name; Cyrillic is transliterated first."""
    c = F.when(c.rlike("[а-яА-ЯёЁ]"), transliterate(c)).otherwise(c)
    return F.regexp_replace(F.replace(collapse(c), F.lit(" "), F.lit("_")), "[^a-z0-9_]", "")


def identity(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def duration_seconds(c: Column) -> Column:
    """Seconds of an ISO-8601 duration's hours, minutes and seconds."""
    part = lambda unit: F.coalesce(F.expr("try_cast(null as int)"), F.nullif(F.regexp_extract(c, rf"(\d+){unit}", 1), F.lit("")).cast("int"), F.lit(0))
    return part("H") * 3600 + part("M") * 60 + part("S")


def valid_candidate(c: Column, domain: Column, stopwords: list[str] | None = None) -> Column:
    """At least three characters, at most five words, not only digits or stopwords, and none of the set phrases."""
    stop = F.array(*[F.lit(w) for w in (stopwords or L.STOPWORDS["en"])])
    low, own = F.lower(c), words(c)
    real = F.size(F.filter(own, lambda w: ~F.array_contains(stop, F.lower(w)))) > 0
    return (F.length(c) >= 3) & ~c.rlike(r"^[0-9]+\z") & (F.size(own) <= 5) & real & ~low.isin(*L.GENERIC_PHRASES) & ~((domain == "mathematics") & low.isin(*L.MATH_PHRASES))


def valid_concept(c: Column, language: str = "en") -> Column:
    """A normalised name of at least three characters, one to five words and 30 % digits at most."""
    n = normalise_dedup(c, language)
    return (F.length(n) >= 3) & F.size(words(n)).between(1, 5) & (F.regexp_count(n, F.lit("[0-9]")) / F.greatest(F.length(n), F.lit(1)) <= 0.3)


#: Playlist forms, anywhere in an address.
PLAYLIST_FORMS = (r"(?:https?://)?(?:www\.)?youtube\.com/playlist\?list=([^&\s]+)", r"(?:https?://)?(?:www\.)?youtube\.com/watch\?v=[^&\s]+&list=([^&\s]+)")
#: Address forms whose first group is the item's id, tried in order from the address's start.
VIDEO_FORMS = (
    r"^(?:https?://)?(?:www\.)?youtube\.com/watch\?v=([^&\s]+)", r"^(?:https?://)?(?:www\.)?youtu\.be/([^\?\s]+)", r"^(?:https?://)?(?:www\.)?youtube\.com/embed/([^\?\s]+)",
    r"^(?:https?://)?(?:www\.)?youtube\.com/v/([^\?\s]+)", r"^(?:https?://)?(?:www\.)?youtube\.com/shorts/([^\?\s]+)",
)


def address_id(c: Column, forms: tuple[str, ...]) -> Column:
    """The id of the first form that an address has, or null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, f, 1), F.lit("")) for f in forms])
