"""Text columns: normal forms, hashes, scripts, languages, entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Script blocks, and the two thresholds of a dominant script.
SCRIPTS = {
    "devanagari": "ऀ-ॿ",
    "arabic": "؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿",
    "latin": "A-Za-zÀ-ɏ",
}
DOMINANT_SHARE = 0.85
MIXED_FLOOR = 20
LEAST_LANGUAGE_CHARS = 10

# Very common words that tell Latin-script languages apart.
COMMON_WORDS = {
    "de": ("der", "die", "und", "das", "ist", "nicht", "mit", "ein", "den", "von", "zu"),
    "en": ("the", "and", "of", "to", "is", "that", "for", "with", "was", "this", "it"),
    "es": ("el", "que", "los", "una", "por", "con", "para", "del", "las", "como", "y"),
    "fr": ("le", "les", "des", "et", "une", "dans", "pour", "est", "pas", "du", "que"),
}


def collapse(text: Column) -> Column:
    """Runs of white space (as Unicode sees it) to one space, ends trimmed; case kept."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_text(text: Column) -> Column:
    """Content identity: links dropped, white space collapsed, lower case; empty becomes null."""
    linkless = F.regexp_replace(text, r"(?U)https?://\S+|www\.\S+", " ")
    return F.nullif(F.lower(collapse(linkless)), F.lit(""))


def normalize_name(name: Column) -> Column:
    return F.lower(collapse(name))


def text_hash(normalized: Column) -> Column:
    return F.when(F.length(normalized) > 0, F.sha2(normalized, 256))


def media_hash(refs: Column) -> Column:
    """SHA-256 of the non-empty references in list order, joined by ``:``; null if there are none."""
    some = F.filter(refs, lambda r: r.isNotNull() & (r != ""))
    return F.when(F.size(some) > 0, F.sha2(F.array_join(some, ":"), 256))


def script(text: Column) -> Column:
    """Dominant script; ``mixed`` below the share or from the floor of other scripts' characters; null without any."""
    outside = {name: F.length(F.regexp_replace(text, f"[{block}]+", "")) for name, block in SCRIPTS.items()}
    counted = F.struct(*[(F.length(text) - n).alias(name) for name, n in outside.items()])

    def decide(n: Column) -> Column:
        total = n["devanagari"] + n["arabic"] + n["latin"]
        wins = lambda c: (c >= DOMINANT_SHARE * total) & (total - c < MIXED_FLOOR)
        return F.when(total > 0, F.when(wins(n["latin"]), "latin").when(wins(n["devanagari"]), "devanagari").when(wins(n["arabic"]), "arabic").otherwise("mixed"))

    # a lambda's argument is computed once, however often it is named
    return F.when(F.length(text) > 0, F.get(F.transform(F.array(counted), decide), F.lit(0)))


def language(text: Column, text_script: Column | None = None) -> Column:
    """Best-effort code by script and common words; null if short, mixed or undecided.

    A stand-in behind the rules that don't depend on the detector: swap it for a model by
    passing another Column function to :func:`loomgraph.operators.items.enrich`.
    """
    text_script = script(text) if text_script is None else text_script
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{L}]+")
    count = lambda common: F.size(F.filter(words, lambda w: w.isin(*common)))
    hits = {la: count(common) for la, common in COMMON_WORDS.items()}
    best = F.greatest(*hits.values())
    latin = F.when(best > 0, F.coalesce(*[F.when(n == best, F.lit(la)) for la, n in hits.items()]))
    urdu = F.regexp_count(text, F.lit("[ٹڈڑںھے]")) > 0
    guess = F.when(text_script == "latin", latin).when(text_script == "devanagari", "hi").when(text_script == "arabic", F.when(urdu, "ur").otherwise("ar"))
    return F.when((F.length(text) >= LEAST_LANGUAGE_CHARS) & (text_script != "mixed"), guess)


def entities(text: Column) -> Column:
    """urls, hashtags, mentions and handles of free text; an address's domain is no mention."""
    text = F.coalesce(text, F.lit(""))
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    mentions = every(r"(?<![\p{L}\p{N}_.])@[\p{L}\p{N}_.]+")
    return F.struct(
        every(r"(?U)https?://\S+").alias("urls"),
        every(r"#[\p{L}\p{N}_]+").alias("hashtags"),
        mentions.alias("mentions"),
        F.transform(mentions, lambda m: F.regexp_replace(m, "^@+", "")).alias("handles"),
        F.array().cast("array<string>").alias("named_entities"),
    )


def seconds_between(later: Column, earlier: Column) -> Column:
    """Fractional seconds."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double")))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))
