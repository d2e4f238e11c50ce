"""Placeholder detection and document structure as Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that show placeholder text, in the order in which they are tried.
TEXT_PATTERNS = (
    r"lorem\s+ipsum", r"dolor\s+sit\s+amet", r"placeholder", r"your\s+name\s+here", r"your\s+email", r"john\s+doe", r"jane\s+doe", r"example\.com", r"sample\s+text",
    r"coming\s+soon", r"enter\s+your", r"type\s+here", r"your\s+.*\s+here", r"insert\s+.*\s+here", r"add\s+your", r"write\s+your", r"\[your\s+", r"xxx+",
)
EMAIL_PATTERNS = (r"info@example\.com", r"name@example\.com", r"email@domain\.com", r"user@example\.", r"test@test\.", r"your@email\.", r"name@domain\.")
IMAGE_HOSTS = (
    "placeholder.com", "picsum.photos", "unsplash.com/random", "via.placeholder", "dummyimage.com", "placehold.it", "placekitten.com", "lorempixel.com", "fakeimg.pl", "placeholderimage",
)
IMAGE_NAMES = (r"image\d+\.\w+", r"photo\d+\.\w+", r"img[_-]?\d+", r"default\.\w+", r"sample\.\w+", r"placeholder", r"no[_-]?image", r"blank\.\w+", r"dummy")
URL_PARTS = ("example.com", "javascript:void", "javascript:;")

STATES = ("confirmed_placeholder", "confirmed_real", "needs_user_confirmation")


def spelled(pattern: str) -> str:
    """A pattern with its classes spelled out, which two regular-expression engines read alike."""
    return pattern.replace(r"\d", "[0-9]").replace(r"\w", "[a-zA-Z0-9_]")


def literal(pattern: str) -> str:
    """The longest plain word that every match of a pattern has."""
    return max(re.findall(r"[a-z]+", re.sub(r"\\[a-z]|\[[^\]]*\]\??", " ", pattern)), key=len)


def stripped(value: Column) -> Column:
    return F.btrim(value, F.lit(" \t\n\x0b\f\r"))


def rules(value: Column, v: Column, low: Column, kind: Column) -> list[tuple[Column, Column, float, str]]:
    """(condition, signal, confidence, state), in order; the first that holds decides. v is the stripped value and low
    the same in lower case.

    A list of patterns is looked for by their plain words first, then as one alternation: a text that has none of the
    words, as most, meets no regular expression."""
    fake, real, ask = STATES
    text = kind.isin("text", "textarea")
    any_of = lambda patterns: within(sorted({literal(p) for p in patterns})) & low.rlike("|".join(f"(?:{spelled(p)})" for p in patterns))
    first = lambda prefix, patterns: F.coalesce(*(F.when(low.rlike(spelled(p)), prefix + p) for p in patterns))
    has = lambda prefix, parts: F.coalesce(*(F.when(low.contains(p), prefix + p) for p in parts))
    within = lambda parts: F.coalesce(*(F.when(low.contains(p), True) for p in parts), F.lit(False))
    return [
        (value.isNull() | (v == ""), F.lit("empty_value"), 0.95, fake),
        (text & any_of(TEXT_PATTERNS), first("text_pattern:", TEXT_PATTERNS), 0.95, fake),
        (text & any_of(EMAIL_PATTERNS), first("email_pattern:", EMAIL_PATTERNS), 0.90, fake),
        (text & (F.length(v) <= 2), F.lit("suspiciously_short_text"), 0.70, ask),
        (text & (F.length(v) > 20), F.lit("substantial_text_no_patterns"), 0.80, real),
        ((kind == "image") & within(IMAGE_HOSTS), has("placeholder_image_host:", IMAGE_HOSTS), 0.95, fake),
        ((kind == "image") & any_of(IMAGE_NAMES), first("placeholder_image_filename:", IMAGE_NAMES), 0.85, fake),
        ((kind == "url") & within(URL_PARTS), has("url_pattern:", URL_PARTS), 0.90, fake),
        ((kind == "url") & (v == "#"), F.lit("hash_only_url"), 0.90, fake),
        (kind == "color", F.lit("color_value_assumed_real"), 0.80, real),
        (kind == "image", F.lit("image_inconclusive_no_vision_model"), 0.50, ask),
        (F.lit(True), F.lit("llm_unavailable_or_failed"), 0.50, ask),
    ]


def detect(value: Column, kind: Column) -> Column:
    """struct(state, confidence, signal) of a field's value. The stripped value and its lower case are the fields of a
    lambda's variable, so that they are made once for all rules."""

    def decide(x: Column) -> Column:
        chain = F
        for when, signal, confidence, state in rules(x["value"], x["v"], x["low"], x["kind"]):
            chain = chain.when(when, F.struct(F.lit(state).alias("state"), F.lit(confidence).alias("confidence"), signal.alias("signal")))
        return chain

    v = stripped(value)
    one = F.struct(value.alias("value"), v.alias("v"), F.lower(v).alias("low"), kind.alias("kind"))
    return F.get(F.transform(F.array(one), decide), F.lit(0))


def duck_detect(value: str, kind: str, output: str) -> str:
    """The same decisions as DuckDB text; output: state, confidence or signal."""
    from loomspan.plans.registry import sql_text as q

    v = rf"regexp_replace({value},'^\s+|\s+$','','g')"
    low = f"lower({v})"
    fake, real, ask = STATES
    pick = {"state": 0, "confidence": 1, "signal": 2}[output]
    text = f"{kind} in ('text','textarea')"
    lines = [(f"{value} is null or {v} = ''", fake, 0.95, "empty_value")]
    lines += [(f"{text} and regexp_matches({low},{q(p)})", fake, 0.95, "text_pattern:" + p) for p in TEXT_PATTERNS]
    lines += [(f"{text} and regexp_matches({low},{q(p)})", fake, 0.90, "email_pattern:" + p) for p in EMAIL_PATTERNS]
    lines += [(f"{text} and length({v}) <= 2", ask, 0.70, "suspiciously_short_text"), (f"{text} and length({v}) > 20", real, 0.80, "substantial_text_no_patterns")]
    lines += [(f"{kind} = 'image' and contains({low},{q(p)})", fake, 0.95, "placeholder_image_host:" + p) for p in IMAGE_HOSTS]
    lines += [(f"{kind} = 'image' and regexp_matches({low},{q(spelled(p))})", fake, 0.85, "placeholder_image_filename:" + p) for p in IMAGE_NAMES]
    lines += [(f"{kind} = 'url' and contains({low},{q(p)})", fake, 0.90, "url_pattern:" + p) for p in URL_PARTS]
    lines += [(f"{kind} = 'url' and {v} = '#'", fake, 0.90, "hash_only_url"), (f"{kind} = 'color'", real, 0.80, "color_value_assumed_real"), (f"{kind} = 'image'", ask, 0.50, "image_inconclusive_no_vision_model")]
    chain = "case " + " ".join(f"when {c} then {q(x[pick])}" for c, *x in lines) + " else " + q((ask, 0.50, "llm_unavailable_or_failed")[pick]) + " end"
    return f"({chain})::double" if output == "confidence" else chain
