"""Scalar functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import lexicon as L

#: White space as ``str.split`` knows it.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def words(text: Column) -> Column:
    """What white space separates."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != "")


def tokens(text: Column) -> Column:
    """Letter runs, with one inner apostrophe at most, and digit runs."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?iu){L.TOKEN}"), F.lit(0))


def squash(text: Column) -> Column:
    """Runs of rules, dashes and bars become one blank each."""
    for pattern in (r"[_=~•·]+", r"-{2,}", r"[|¦]+"):
        text = F.regexp_replace(text, pattern, " ")
    return text


def graphic(token: Column) -> Column:
    """Lower case, j as i and v as u; accents of Latin-1 go."""
    return F.translate(F.translate(F.lower(token), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"), "jv", "iu")


def enclitics_apart(found: Column) -> Column:
    """Tokens in graphic form with -que and -ue as tokens of their own."""
    stay = F.array(*map(F.lit, sorted(L.NO_ENCLITIC_SPLIT)))

    def parts(x: Column) -> Column:
        form, pattern = graphic(x), F.lit(r"^([a-zà-ÿ]{2,}?)(que|ue|ve)$")
        split = F.array(F.regexp_extract(form, r"^([a-zà-ÿ]{2,}?)(que|ue|ve)$", 1), F.regexp_extract(form, r"^([a-zà-ÿ]{2,}?)(que|ue|ve)$", 2))
        return F.when(F.array_contains(stay, F.lower(x)), F.array(F.lower(x))).when(F.regexp_like(form, pattern), split).otherwise(F.array(form))

    return F.flatten(F.transform(found, parts))


def is_roman(token: Column) -> Column:
    return F.regexp_like(F.translate(F.lower(token), "jv", "iu"), F.lit(L.ROMAN)) & (token != "")


def _any_end(x: Column, endings: tuple[str, ...]) -> Column:
    return F.regexp_like(x, F.lit(f"({'|'.join(endings)})$"))


def _any_begin(x: Column, beginnings: tuple[str, ...]) -> Column:
    return F.regexp_like(x, F.lit(f"^({'|'.join(beginnings)})"))


def _if(condition: Column, points: float) -> Column:
    return F.when(condition, points).otherwise(0.0)


def latin_shape(token: Column) -> Column:
    """How Latin a token looks."""
    x = graphic(token)
    known = F.array_contains(F.array(*map(F.lit, sorted(L.LATIN_FUNCTION_WORDS))), x)
    return _if(known, 3.0) + _if(_any_end(x, L.LATIN_SHAPE_ENDINGS), 0.8) + _if(_any_begin(x, L.LATIN_SHAPE_BEGINNINGS), 1.2) + _if(x.endswith("tur"), 1.0)


def vowels(token: Column) -> Column:
    return F.length(F.regexp_replace(token, "[^aeiouy]", ""))


def apparatus_like(token: Column) -> Column:
    """A siglum or reference of a critical apparatus."""
    x = graphic(token)
    known = F.array_contains(F.array(*map(F.lit, sorted(L.APPARATUS_TOKENS))), x)
    mute = (F.length(x) <= 4) & ~F.regexp_like(x, F.lit(r"^\d+$")) & (vowels(x) == 0)
    return known | mute | F.regexp_like(x, F.lit(L.APPARATUS))


def noise_token(token: Column) -> Column:
    """No word, number or numeral."""
    x = graphic(token)
    odd = (
        ((F.length(x) == 1) & ~x.isin("a", "e", "i", "o"))
        | (F.regexp_like(x, F.lit(r"\d")) & F.regexp_like(x, F.lit("[a-z]")))
        | apparatus_like(token)
        | ((F.length(x) >= 8) & (vowels(x) <= 1))
        | ((F.length(x) >= 6) & (vowels(x) == 0))
        | F.regexp_like(x, F.lit(r"(.)\1{3}"))
        | F.regexp_like(x, F.lit(L.CONSONANTS))
    )
    return (token == "") | (odd & ~F.regexp_like(token, F.lit(r"^\d+$")) & ~is_roman(token))


def strong_romance(token: Column) -> Column:
    low = F.lower(token)
    x = F.translate(low, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    word = F.array_contains(F.array(*map(F.lit, sorted(L.ROMANCE_FUNCTION_WORDS))), x) & (latin_shape(x) < 1.0)
    return low.contains("'") | word | _any_end(x, L.ROMANCE_STRONG_ENDINGS) | _any_begin(x, L.ROMANCE_STRONG_BEGINNINGS)


def romance_points(token: Column) -> Column:
    low = F.lower(token)
    x = F.translate(low, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return (
        F.when(_any_end(x, L.LATIN_SHAPE_ENDINGS), 0.0).when(low.contains("'"), 2.4).when(x.isin(*L.ROMANCE_ARTICLES), 2.0).when(strong_romance(token), 1.5).otherwise(0.0)
    )


def mode(latin: Column, romance: Column, noise: Column) -> Column:
    """A segment's language mode from its scores: the first rule that holds."""
    close = F.greatest(latin, romance) / F.greatest(F.lit(1.0), F.least(latin, romance)) <= 1.6
    return (
        F.when((noise >= 3.2) & ((noise >= latin * 0.5) | (latin < 4.0)), "ocr_noise")
        .when((latin >= 4.0) & (latin >= romance * 1.8) & (noise < latin * 0.6), "latin")
        .when((romance >= 4.0) & (romance >= latin * 1.8) & (noise < romance * 0.6), "romance")
        .when((F.least(latin, romance) >= 2.5) & close, "mixed")
        .when((latin > romance) & (latin >= 2.0), "latin")
        .when((romance > latin) & (romance >= 2.0), "romance")
        .when(noise >= 2.2, "ocr_noise")
        .otherwise("unknown")
    )


def without_stopwords(found: Column, stops: frozenset[str]) -> Column:
    """Repeats of other words stay."""
    table = F.array(*map(F.lit, sorted(stops)))
    return F.filter(found, lambda x: ~F.array_contains(table, x))


def keep_number(token: Column, noise: Column) -> Column:
    return F.regexp_like(token, F.lit(r"^\d+$")) & ((F.length(token) >= 3) | (noise < 1.5))


def healthy_stem(stem: Column, word: Column, least: int = 4, share: float = 0.5) -> Column:
    return (F.length(stem) >= least) & (F.length(stem) / F.greatest(F.length(word), F.lit(1)) >= share) & (vowels(stem) > 0) & ~F.regexp_like(stem, F.lit(L.CONSONANTS))


def snippet(text: Column, size: int = 220) -> Column:
    """The beginning, on one line."""
    return F.regexp_replace(F.replace(F.substring(text, 1, size), F.lit("\n"), F.lit(" ")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def doc_no(parent_id: Column) -> Column:
    return F.nullif(F.regexp_extract(parent_id, r"(?i)_doc(\d+)", 1), F.lit("")).try_cast("int")


def ngrams(found: Column, low: int = 1, high: int = 3) -> Column:
    """All runs of ``low`` to ``high`` tokens, joined by a blank."""

    def of(n: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(found) - n + 1), lambda i: F.array_join(F.slice(found, i, F.lit(n)), " "))
        return F.when(F.size(found) >= n, some).otherwise(F.array().cast("array<string>"))

    return F.concat(*(of(n) for n in range(low, high + 1)))


def clean_text(text: Column) -> Column:
    """Without ``[n]``, hyphens at line ends and runs of blanks."""
    x = F.regexp_replace(text, r"\[\d+\]", "")
    x = F.regexp_replace(x, r"(?U)(\w)-\s+(\w)", "$1$2")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def roman_value(numeral: Column) -> Column:
    """The number that a Roman numeral writes, by subtraction; null where a letter is none."""
    low = F.lower(numeral)
    table = F.create_map(*[F.lit(x) for k in zip("ivujxlcdm", (1, 5, 5, 1, 10, 50, 100, 500, 1000), strict=True) for x in k])
    values = F.transform(F.filter(F.split(F.reverse(low), ""), lambda c: c != ""), lambda c: F.element_at(table, c))
    total = F.aggregate(
        values,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top")),
        lambda acc, v: F.struct((acc["sum"] + F.when(v < acc["top"], -v).otherwise(v)).alias("sum"), F.greatest(acc["top"], v).alias("top")),
        lambda acc: acc["sum"],
    )
    return F.when(F.regexp_like(low, F.lit("^[ivujxlcdm]+$")), total)


def rgb(color: Column) -> Column:
    """#rgb or #rrggbb as three numbers; anything else is grey."""
    x = F.regexp_replace(F.trim(F.coalesce(color, F.lit(""))), "^#", "")
    x = F.when(F.length(x) == 3, F.regexp_replace(x, "(.)", "$1$1")).otherwise(x)
    parts = F.array(*(F.conv(F.substring(x, i, 2), 16, 10).cast("int") for i in (1, 3, 5)))
    return F.when(F.regexp_like(x, F.lit("^[0-9a-fA-F]{6}$")), parts).otherwise(F.array(F.lit(153), F.lit(153), F.lit(153)))


def thickness(weight: Column, low: Column, high: Column) -> Column:
    """An edge's width from its weight among all."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (weight - low) / (high - low)))
    return F.when(high <= low, 2.5).otherwise(1.5 + share * 5.0)
