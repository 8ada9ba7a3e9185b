"""Street-name expressions: core names, directionals, post-types, eras, themes.

All are Column expressions over strings; null is read as the empty string.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Leading directionals, post-types, and post-types by importance.
DIRECTIONALS = [
    "n", "s", "e", "w", "ne", "nw", "se", "sw",
    "north", "south", "east", "west", "northeast", "northwest", "southeast", "southwest",
]
SUFFIXES = [
    "st", "street", "rd", "road", "ln", "lane", "dr", "drive", "ave", "avenue", "av",
    "ct", "court", "pl", "place", "blvd", "boulevard", "cir", "circle", "way", "wy",
    "pkwy", "parkway", "ter", "terrace", "trl", "trail", "loop", "hwy", "highway",
    "bnd", "bend", "cv", "cove", "xing", "crossing", "run", "pt", "point", "pass",
    "sq", "square", "expy", "expressway", "aly", "alley", "row", "walk", "plz", "plaza",
    "mnr", "manor", "grn", "green", "gln", "glen", "vw", "view", "rdg", "ridge",
    "hts", "heights", "est", "estates", "cres", "crescent", "spur", "cutoff", "connector",
]
POST_RANK = [
    "highway", "hwy", "boulevard", "blvd", "parkway", "pkwy", "road", "rd", "avenue", "ave", "av", "street", "st",
    "way", "wy", "drive", "dr", "court", "ct", "place", "pl",
]
AXES = {"NS": ["n", "north", "s", "south"], "EW": ["e", "east", "w", "west"]}
ANALYSED_CLASSES = ["residential", "unclassified", "tertiary", "living_street"]
SEARCH_EXCLUDED_CLASSES = ["trunk"]

# Plat-type words that say nothing about a name.
PLAT_TYPE_WORDS = [
    "estates", "place", "court", "village", "sub", "addition", "acres", "condo", "tract", "tracts", "park", "manor",
    "villas", "commons", "cove", "ranch", "farms", "the", "at", "crossing", "hollow", "glenn", "glen", "shopping",
    "center", "business",
]

# Answers without a theme, and words without one.
NO_THEME = ["", "none", "unclear", "no theme", "n/a", "unknown"]
THEME_STOP = [
    "names", "name", "theme", "themed", "mixed", "generic", "weak", "related", "words", "terms", "compounds",
    "various", "no", "and", "or", "of", "the", "style", "possible", "possibly", "unrelated", "some", "other", "based",
]

# First year after an era, and the era's label.
ERAS = [(1940, "pre-1940"), (1970, "1940-1969"), (1990, "1970-1989"), (2010, "1990-2009"), (9999, "2010-")]
ERA_FLOOR, ERA_START, ERA_FULL = 0.15, 1915, 1965


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def bare(token: Column) -> Column:
    """Lower-case letters and digits of a token."""
    return F.regexp_replace(F.lower(_text(token)), "[^a-z0-9]", "")


def tokens(name: Column) -> Column:
    """Words of a name; the empty name has none."""
    squeezed = F.trim(F.regexp_replace(_text(name), "\\s+", " "))
    return F.filter(F.split(squeezed, " "), lambda t: t != "")


def _let(value: Column, then) -> Column:
    """``then(value)``, with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def parts(name: Column) -> Column:
    """struct(direction, core, post) with the original case."""
    leads = lambda t: (F.size(t) > 1) & bare(F.get(t, F.lit(0))).isin(DIRECTIONALS)
    trails = lambda t: (F.size(t) > 1) & bare(F.element_at(t, -1)).isin(SUFFIXES)
    headed = lambda t: F.struct(
        F.when(leads(t), F.get(t, F.lit(0))).otherwise(F.lit("")).alias("direction"),
        F.when(leads(t), F.slice(t, F.lit(2), F.size(t))).otherwise(t).alias("rest"),
    )
    ended = lambda h: F.struct(
        h["direction"].alias("direction"),
        F.array_join(F.when(trails(h["rest"]), F.slice(h["rest"], F.lit(1), F.size(h["rest"]) - 1)).otherwise(h["rest"]), " ").alias("core"),
        F.when(trails(h["rest"]), F.element_at(h["rest"], -1)).otherwise(F.lit("")).alias("post"),
    )
    return _let(_let(tokens(name), headed), ended)


def normalize(name: Column) -> Column:
    """The name without its leading directional and its trailing post-type."""
    return parts(name)["core"]


def spelled(core: Column) -> Column:
    """A core name in lower case, without punctuation; accents go, they are not folded."""
    words = F.lower(F.regexp_replace(core, "\\s*&\\s*", " and "))
    return F.trim(F.regexp_replace(F.regexp_replace(words, "[^a-z0-9 ]", ""), "\\s+", " "))


def key(name: Column) -> Column:
    """Comparison key of a street name."""
    return spelled(normalize(name))


def post_rank(post: Column) -> Column:
    """Importance of a post-type, 0 first; those not listed come last."""
    at = F.array_position(strings(POST_RANK), bare(post)).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.lit(len(POST_RANK)))


def axis_of(direction: Column) -> Column:
    """NS or EW by the directional, else empty."""
    d = bare(direction)
    return F.when(d.isin(AXES["NS"]), "NS").when(d.isin(AXES["EW"]), "EW").otherwise("")


def axis(name: Column) -> Column:
    return axis_of(parts(name)["direction"])


def analysed(classes: Column) -> Column:
    """Whether all road classes of a place are ones that a developer plausibly named."""
    return (F.size(classes) > 0) & (F.size(F.array_except(classes, strings(ANALYSED_CLASSES))) == 0)


def plain_words(text: Column) -> Column:
    """Letters-only words in lower case."""
    return F.filter(F.split(F.regexp_replace(F.lower(_text(text)), "[^a-z ]", " "), " +"), lambda w: w != "")


def distinctive(text: Column) -> Column:
    return F.filter(plain_words(text), lambda w: ~w.isin(PLAT_TYPE_WORDS))


def name_match(core: Column, plat: Column) -> Column:
    """Whether the plat's whole distinctive name is the street's."""
    a = distinctive(core)
    return (F.size(a) > 0) & (a == distinctive(plat))


def era_weight(year: Column) -> Column:
    """How much a plat of this year may suggest a theme: a ramp between the two era years."""
    ramp = F.lit(ERA_FLOOR) + (1 - ERA_FLOOR) * (year - ERA_START) / float(ERA_FULL - ERA_START)
    return (
        F.when(year.isNull() | (year == 0) | (year <= ERA_START), F.lit(ERA_FLOOR))
        .when(year >= ERA_FULL, F.lit(1.0))
        .otherwise(ramp)
    )


def era_of(year: Column) -> Column:
    chain = reduce(lambda c, e: c.when(year < e[0], e[1]), ERAS[1:], F.when(year < ERAS[0][0], ERAS[0][1]))
    return chain.otherwise("")


def round_half_even(x: Column, digits: int) -> Column:
    """Decimal rounding of the exact binary value, ties to even, as Python's ``round`` does it.

    ``round`` and ``bround`` of doubles work on the shortest decimal text; the exact
    value of a double differs from it, so 2.675 has to become 2.67.  The error of the
    scaled product is found exactly by splitting x into halves (digits up to 7).
    """
    x = x.cast("double")
    scale = 10.0**digits
    product = x * scale
    high = x * 134217729.0 - (x * 134217729.0 - x)
    error = (high * scale - product) + (x - high) * scale
    above_tie = (product - F.floor(product)) - 0.5 + error
    whole = F.when(above_tie > 0, F.floor(product) + 1).when(above_tie < 0, F.floor(product)).otherwise(F.rint(product))
    return whole.cast("double") / scale


def iso_year(text: Column) -> Column:
    """Year of an ISO date or of any text that starts with four digits; else null."""
    head = F.substring(_text(text), 1, 4)
    return F.when(head.rlike("^[0-9]{1,4}$"), head.cast("int"))


def date_of_ms(ms: Column) -> Column:
    """UTC date of epoch milliseconds."""
    return F.to_date(F.timestamp_millis(ms))


def natural_key(label: Column) -> Column:
    """Sort key that puts Phase 2 before Phase 10."""
    runs = F.regexp_extract_all(F.lower(_text(label)), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.transform(runs, lambda t: F.when(t.rlike("^[0-9]+$"), F.lpad(t, 18, "0")).otherwise(t))


def stem(word: Column) -> Column:
    """The first of these endings that leaves three letters or more is cut off."""
    out = word
    for ending in reversed(["ies", "ing", "ary", "es", "s"]):
        out = F.when(
            word.endswith(ending) & (F.length(word) - len(ending) >= 3), F.regexp_replace(word, f"{ending}$", "")
        ).otherwise(out)
    return out


def theme_words(theme: Column) -> Column:
    """Distinct stems of a theme's content words."""
    kept = F.filter(plain_words(theme), lambda w: ~w.isin(THEME_STOP) & (F.length(w) > 2))
    return F.array_distinct(F.transform(kept, stem))


def themed(theme: Column) -> Column:
    return ~F.lower(F.trim(_text(theme))).isin(NO_THEME)


def last_segment(iri: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(iri, "/", -1)


def digest(content: Column) -> Column:
    """First 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)
