"""Word forms: stems, variants and matching by form, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L


def stem(w: Column) -> Column:
    """Lower-case, one English ending off, then letters, digits and hyphens only."""
    low = F.lower(w)
    n = F.length(low)
    cut = (
        F.when((n > 3) & low.endswith("s") & ~low.endswith("ss"), F.substring(low, 1, n - 1))
        .when((n > 4) & low.endswith("ing"), F.substring(low, 1, n - 3))
        .when((n > 4) & low.endswith("ed"), F.substring(low, 1, n - 2))
        .otherwise(low)
    )
    return F.regexp_replace(cut, r"[^\p{L}\p{N}-]", "")


def significant(tokens: Column, stopwords: list[str] | None = None, keep: list[str] | None = None) -> Column:
    """Stems; those of the kept terms always, others unless they are stopwords, two characters or shorter, or numbers."""
    stop, held = (F.array(*[F.lit(s) for s in ws]) for ws in (stopwords or L.PATTERN_STOPWORDS, keep or L.PATTERN_TERMS))
    plain = lambda t: ~F.array_contains(stop, t) & (F.length(t) > 2) & ~t.rlike("^[0-9]+$")
    return F.filter(F.transform(tokens, stem), lambda t: (t != "") & (F.array_contains(held, t) | plain(t)))


def variants(c: Column) -> Column:
    """The text with and without an article, and with other endings of each longer word."""
    ws = F.split(c, " ")
    first = F.element_at(ws, 1)
    article = first.isin(*L.ARTICLES)
    rest = F.array_join(F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(1))), " ")
    indefinite = F.when(first.rlike("^[aeiou]"), F.lit("an ")).otherwise(F.lit("a "))
    phrase = F.when(F.size(ws) < 2, F.array()).when(article, F.array(rest)).otherwise(F.array(F.concat(F.lit("the "), c), F.concat(indefinite, c)))

    def forms(w: Column) -> Column:
        n = F.length(w)
        swap = lambda to: F.replace(c, w, to)
        plural = F.when(w.endswith("s") & (n > 4), F.array(swap(F.substring(w, 1, n - 1)))).when(~w.endswith("s"), F.array(swap(F.concat(w, F.lit("s"))))).otherwise(F.array())
        stemmed = F.substring(w, 1, n - 3)
        verb = (
            F.when(w.endswith("ing") & (n > 5), F.array(swap(stemmed), swap(F.concat(stemmed, F.lit("e")))))
            .when(w.endswith("ed") & (n > 4), F.array(swap(F.substring(w, 1, n - 2)), swap(F.substring(w, 1, n - 1)), swap(F.concat(F.substring(w, 1, n - 2), F.lit("e")))))
            .otherwise(F.array())
        )
        return F.when(n > 3, F.concat(plural, verb)).otherwise(F.array())

    return F.array_distinct(F.concat(F.array(c), phrase, F.flatten(F.transform(ws, forms))))


def _swapped(w: Column, endings: dict[str, list[str]], first_only: bool) -> Column:
    """Forms of a word with other endings; the endings' stem keeps three characters."""
    fits = lambda e: w.endswith(e) & (F.length(w) > len(e) + 2)
    forms = lambda e, to: F.array(*[F.concat(F.left(w, F.length(w) - len(e)), F.lit(t)) for t in to])
    if first_only:
        out = F.when(F.lit(False), F.array(w))
        for e, to in endings.items():
            out = out.when(fits(e), forms(e, to))
        return F.coalesce(out, F.array().cast("array<string>"))
    return F.concat(*[F.when(fits(e), forms(e, to)).otherwise(F.array().cast("array<string>")) for e, to in endings.items()])


def _last_changed(c: Column, ws: Column, forms: Column) -> Column:
    head = F.array_join(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), " ")
    return F.transform(forms, lambda f: F.when(F.size(ws) > 1, F.concat(head, F.lit(" "), f)).otherwise(f))


def kernel_variants(c: Column, language: str = "en") -> Column:
    """The text and its forms: other endings of the last word, in Russian of the first word of a phrase too."""
    ws, endings = F.split(c, " "), L.ENDINGS_KERNEL_RU if language == "ru" else L.ENDINGS_KERNEL_EN
    last = _last_changed(c, ws, _swapped(F.element_at(ws, -1), endings, False))
    out = F.concat(F.array(c), last)
    if language == "ru":
        rest = F.array_join(F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(1))), " ")
        first = F.transform(_swapped(F.element_at(ws, 1), endings, False), lambda f: F.concat(f, F.lit(" "), rest))
        out = F.concat(out, F.when(F.size(ws) > 1, first).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(out)


def word_forms_ru(w: Column, endings: dict[str, list[str]] | None = None) -> Column:
    """Other forms of a Russian word: of the first ending that fits; short and common words have none."""
    none = F.array().cast("array<string>")
    return F.when((F.length(w) <= 3) | w.isin(*L.SHORT_WORDS_RU), none).otherwise(_swapped(w, endings or L.ENDINGS_CATALOGUE_RU, True))


def variants_ru(c: Column) -> Column:
    """Forms of a Russian name in the catalogue: of the last word, of two words of either and of up to five pairs."""
    ws = F.split(c, " ")
    last = word_forms_ru(F.element_at(ws, -1))
    out = F.concat(F.array(c), _last_changed(c, ws, last))
    first = word_forms_ru(F.element_at(ws, 1))
    one = F.transform(first, lambda f: F.concat(f, F.lit(" "), F.element_at(ws, -1)))
    both = F.slice(F.flatten(F.transform(first, lambda f: F.transform(last, lambda g: F.concat(f, F.lit(" "), g)))), 1, 5)
    return F.array_distinct(F.when(F.size(ws) == 2, F.concat(out, one, both)).otherwise(out))


def matcher_variants_ru(c: Column, most_words: int = 3, most_forms: int = 5) -> Column:
    """The smaller rule set of matching: forms of the last word of a name of up to three words."""
    ws = F.split(c, " ")
    skip = (F.size(ws) > most_words) | (F.length(c) <= 3) | c.isin(*L.SHORT_WORDS_RU)
    forms = F.slice(word_forms_ru(F.element_at(ws, -1), L.ENDINGS_MATCHER_RU), 1, most_forms)
    return F.array_distinct(F.when(skip, F.array(c)).otherwise(F.concat(F.array(c), _last_changed(c, ws, forms))))


def catalogue_variants(c: Column, language: str = "en") -> Column:
    """All forms of a name in lower case, by language."""
    low = F.lower(c)
    return F.array_distinct(F.concat(F.array(c, low), variants_ru(low) if language == "ru" else variants(low)))


def form_match(a: Column, b: Column, language: str = "en") -> Column:
    """1 for equal texts, 0.95 for a shared form, 0.85 for phrases that differ in the ending of their last word, else 0."""
    x, y = F.lower(a), F.lower(b)
    xs, ys = F.split(x, " "), F.split(y, " ")
    head = lambda w: F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))
    u, v = F.element_at(xs, -1), F.element_at(ys, -1)
    stem_ = F.least(F.least(F.length(u), F.length(v)) - 2, F.lit(5))
    alike = (F.size(xs) == F.size(ys)) & (F.size(xs) > 1) & (head(xs) == head(ys)) & (stem_ > 2) & (F.left(u, stem_) == F.left(v, stem_))
    return F.when(x == y, 1.0).when(F.arrays_overlap(kernel_variants(x, language), kernel_variants(y, language)), 0.95).when(alike, 0.85).otherwise(0.0)
