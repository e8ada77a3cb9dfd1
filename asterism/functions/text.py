"""Text and record parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of affect (evaluation, potency, activity), in tenths, so that sums are exact. Fixed values.
LEXICON = {
    "capable": (5, 0, 0), "reliable": (5, 0, 0), "solid": (4, 2, 0), "robust": (5, 3, 0), "polished": (4, 0, 0), "excellent": (7, 0, 0),
    "strong": (5, 4, 0), "impressive": (6, 2, 0), "state-of-the-art": (7, 3, 0), "sota": (7, 3, 0), "leading": (5, 3, 0), "frontier": (6, 5, 0),
    "flagship": (5, 4, 0), "premium": (4, 2, 0), "weak": (-4, -3, 0), "poor": (-5, 0, 0), "brittle": (-4, -2, 0), "buggy": (-5, 0, 0),
    "limited": (-3, -2, 0), "experimental": (-2, 0, 2), "unstable": (-4, 0, 1), "outdated": (-4, -2, -2), "deprecated": (-5, -2, -2),
    "large": (0, 6, 0), "huge": (0, 8, 0), "massive": (0, 9, 0), "big": (0, 5, 0), "small": (0, -5, 0), "tiny": (0, -7, 0), "mini": (0, -6, 0),
    "compact": (1, -4, 2), "lightweight": (1, -5, 3), "efficient": (3, -2, 2), "heavy": (0, 6, -2), "heavyweight": (0, 7, -2), "powerful": (4, 6, 0),
    "dense": (0, 5, -1), "sparse": (0, -3, 1), "moe": (2, 4, 0), "fast": (2, 0, 6), "quick": (2, 0, 5), "instant": (2, 0, 7), "responsive": (3, 0, 5),
    "snappy": (2, 0, 6), "slow": (-2, 0, -6), "sluggish": (-3, 0, -6), "streaming": (1, 0, 4), "interactive": (2, 0, 5), "realtime": (2, 0, 7),
    "batch": (0, 1, -3), "offline": (0, 0, -4), "reasoning": (4, 4, 0), "instruct": (3, 0, 2), "chat": (2, 0, 3), "code": (3, 0, 0),
    "multimodal": (3, 3, 0), "vision": (2, 2, 0), "long-context": (3, 5, 0), "quantized": (0, -3, 2), "distilled": (1, -4, 3), "finetuned": (2, 0, 0),
    "specialized": (3, 0, 0), "general": (2, 2, 0), "generalist": (2, 3, 0),
}


def html_to_text(html: Column) -> Column:
    """Readable text: scripts, styles and page furniture go, block tags break lines, entities are decoded, blanks collapse."""
    out = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer)[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?i)</?(p|div|br|li|tr|h[1-6]|ul|ol|table|section|article)[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(out, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


#: Words of a text that say nothing about it. Fixed values.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might can shall for and but or nor not no so yet both either neither each every all any few more most other some such than too very just "
    "about above after again also at before between by down during from in into of on out over then there through to under up with that this these those i me my we our you your it its model models"
).split()


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits, underscores, dots and hyphens of two characters and more, without stop words."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"([a-z0-9_.-]+)"), 1), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def host(url: Column) -> Column:
    """The lower-case host of an address without port and leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1)), r"^www\.", "")


def allowed_host(url: Column, allowed: tuple[str, ...]) -> Column:
    """Whether the host is one of the allowed or a subdomain of one."""
    h = host(url)
    out = F.lit(False)
    for a in allowed:
        out = out | (h == a) | h.endswith("." + a)
    return out


def size_number(text: Column) -> Column:
    """Billions in strings like 7B, 350M or 12K; null without one."""
    number = F.regexp_extract(F.upper(text), r"([0-9]+(?:\.[0-9]+)?) ?([BMK])", 1).try_cast("double")
    unit = F.regexp_extract(F.upper(text), r"([0-9]+(?:\.[0-9]+)?) ?([BMK])", 2)
    return number * F.when(unit == "B", 1.0).when(unit == "M", 1e-3).when(unit == "K", 1e-6)


def popularity(likes: Column, downloads: Column) -> Column:
    """A log-scaled score of likes and downloads."""
    return 2 * F.log1p(likes.cast("double")) + 0.5 * F.log1p(downloads.cast("double"))


def _getter(axis: int):
    return lambda values: values[axis]


def epa(text: Column) -> list[Column]:
    """Evaluation, potency and activity from the lexicon over tokens that keep hyphens, sums clipped to -1..1; null without a known word."""
    table = F.create_map(*[x for w, v in LEXICON.items() for x in (F.lit(w), F.array(*map(F.lit, v)))])
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9-]+)"), 1), lambda w: w.isin(*LEXICON))
    hits = F.transform(words, lambda w: F.element_at(table, w))
    out = []
    for axis in range(3):
        total = F.aggregate(F.transform(hits, _getter(axis)), F.lit(0), lambda t, v: t + v)
        out.append(F.when(F.size(hits) > 0, F.greatest(F.lit(-10), F.least(F.lit(10), total)) / 10.0))
    return out


#: Headings of the six sections of a complete card: description, usage, training, evaluation, limitations, license.
SECTIONS = ("description|about|overview|introduction", "usage|how to use|getting started|quick start", "training|fine-?tuning|methodology", "evaluation|benchmark|results|performance", "limitation|bias|risk|ethical", "license|citation|acknowledgment")


def card_quality(text: Column) -> Column:
    """The share of the six sections that a card has a heading of; 0 without text."""
    found = sum((F.coalesce(text.rlike(rf"(?i)##?\s*(?:{names})"), F.lit(False)).cast("int") for names in SECTIONS), F.lit(0))
    return F.round(found / 6.0, 2)


def sample_key(seed: str, key: Column) -> Column:
    """A hash that orders rows reproducibly for sampling."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
