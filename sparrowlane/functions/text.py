"""Text functions of query analysis, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: they decide the results
STOPWORDS = ["the", "a", "an", "of", "to", "and", "or", "for", "in"]
NEGATIONS = ["no", "not", "without", "lack", "lacks", "never"]
CLAIM_CUES = ["increase", "increased", "decrease", "decreased", "risk", "treat", "treats", "used", "associated", "affect", "facilitates"]
CONJUNCTIONS = ["; ", " and ", " or ", " versus ", " compared to ", ", "]

#: Scripts as character classes of regular expressions.
SCRIPTS = {
    "cjk": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}",
    "kana": r"\x{3040}-\x{30FF}",
    "hangul": r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}",
    "cyrillic": r"\x{0400}-\x{04FF}",
    "arabic": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}",
    "devanagari": r"\x{0900}-\x{097F}",
    "thai": r"\x{0E00}-\x{0E7F}",
    "latin": r"A-Za-z\x{00C0}-\x{024F}",
}
#: All but Latin; none begins below U+0400, which is tried before the many ranges.
OTHER_SCRIPTS = r"[\x{0400}-\x{10FFFF}&&[" + "".join(v for k, v in SCRIPTS.items() if k != "latin") + "]]"


def words_in(c: Column, words: list[str]) -> Column:
    """How many elements of an array are among ``words``."""
    return F.size(F.filter(c, lambda t: t.isin(*words)))


def tokens(query: Column) -> Column:
    """Lower-case tokens of letters, digits, ``_``, ``+`` and ``-``."""
    return F.regexp_extract_all(F.lower(query), F.lit(r"([A-Za-z0-9_+-]+)"), F.lit(1))


def lexical_features(query: Column) -> dict[str, Column]:
    t = tokens(query)
    n = F.size(t)
    return {
        "token_count": n.cast("long"),
        "char_count": F.length(query).cast("long"),
        "stopword_ratio": F.when(n > 0, words_in(t, STOPWORDS) / n).otherwise(F.lit(0.0)),
        "numeric_token_count": F.size(F.filter(t, lambda x: x.rlike("[0-9]"))).cast("long"),
        "negation_count": words_in(t, NEGATIONS).cast("long"),
        "claim_cue_count": words_in(t, CLAIM_CUES).cast("long"),
    }


def applies(features: dict[str, Column], policy: str) -> Column:
    """Whether a reformulation policy applies to a query of these features."""
    n, stop = features["token_count"], features["stopword_ratio"]
    if policy in ("always", "never"):
        return F.lit(policy == "always")
    if policy == "selective_low_specificity":
        return (n > 0) & ((n <= 6) | (stop >= 0.35))
    if policy == "selective_high_specificity":
        return (n >= 8) & (stop <= 0.25)
    if policy == "selective_claim_cue":
        return (features["claim_cue_count"] > 0) | (features["negation_count"] > 0) | (features["numeric_token_count"] > 0)
    raise ValueError(f"unknown policy: {policy}")


def variants(query: Column, most: int = 3) -> Column:
    """Ordered distinct variants as array<struct<text, strategy>>: original, without stop words, first two keywords."""
    keywords = F.filter(tokens(query), lambda t: ~t.isin(*STOPWORDS))
    form = lambda text, strategy: F.struct(text.alias("text"), F.lit(strategy).alias("strategy"))
    original = F.trim(query)
    plain, focused = F.array_join(keywords, " "), F.array_join(F.slice(keywords, 1, 2), " ")
    out = F.array(
        form(original, "original"),
        F.when((F.size(keywords) > 0) & (F.lower(original) != plain), form(plain, "stopword_removed")),
        F.when((F.size(keywords) > 2) & (F.lower(original) != focused), form(focused, "focused_prefix")),
    )
    return F.slice(F.filter(out, lambda x: x.isNotNull()), 1, most)


def split_conjunction(query: Column) -> Column:
    """Both halves around the first place of the first conjunction (in fixed order) that leaves two, else the query."""
    out = F.array(query)
    low = F.lower(query)
    for word in reversed(CONJUNCTIONS):
        at = F.locate(word, low)
        left = F.trim(F.substring(query, F.lit(1), at - 1))
        right = F.trim(F.substring(query, at + len(word), F.length(query)))
        out = F.when((at > 0) & (left != "") & (right != ""), F.array(left, right)).otherwise(out)
    return out


def is_atomic(query: Column, least: int = 20) -> Column:
    low = F.lower(query)
    none = F.lit(True)
    for word in CONJUNCTIONS:
        none = none & (F.locate(word, low) == 0)
    return (F.length(query) < least) | none


def sanitized(query: Column, most: int = 2000) -> Column:
    """Control characters to spaces, white space squeezed, cut at ``most`` characters."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(query, r"[\x00-\x1F\x7F]", " "), r"\s+", " ")), 1, most)


def overlap(original: Column, part: Column) -> Column:
    """Share of the part's ``[a-z0-9]+`` tokens that the original has; 0 without tokens."""
    of = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+)"), F.lit(1))
    own, have = of(part), of(original)
    return F.when(F.size(own) > 0, F.size(F.filter(own, lambda t: F.array_contains(have, t))) / F.size(own)).otherwise(F.lit(0.0))


def script_counts(text: Column) -> dict[str, Column]:
    return {k: F.length(F.regexp_replace(text, f"[^{v}]+", "")) for k, v in SCRIPTS.items()}


def _language_of(n: dict[str, Column], default: str, least: float) -> Column:
    """struct<language, confidence> by the counts of each script, of which one at least is not 0."""
    letters = sum(n.values(), F.lit(0))
    share = lambda *names: sum((n[x] for x in names), F.lit(0)) / letters
    rules = [
        ("ja", (n["kana"] > 0) & (share("kana", "cjk") > 0.3), share("kana", "cjk")),
        ("ko", share("hangul") > 0.3, share("hangul")),
        ("zh", (share("cjk") > 0.3) & (n["kana"] == 0), share("cjk")),
        ("ru", share("cyrillic") > 0.3, share("cyrillic")),
        ("ar", share("arabic") > 0.3, share("arabic")),
        ("hi", share("devanagari") > 0.3, share("devanagari")),
        ("th", share("thai") > 0.3, share("thai")),
        ("en", share("latin") > 0.5, share("latin") * 0.6),
    ]
    language, confidence = F.lit(default), F.lit(0.0)
    for code, fits, sure in reversed(rules):
        language, confidence = F.when(fits, code).otherwise(language), F.when(fits, F.least(sure, F.lit(1.0))).otherwise(confidence)
    return F.struct(F.when(confidence < least, default).otherwise(language).alias("language"), confidence.alias("confidence"))


def language_and_confidence(text: Column, default: str = "en", least: float = 0.5) -> Column:
    """struct<language, confidence>: the dominant script in a fixed order; below ``least`` the default.

    A text with no script but Latin has a share of 1, so one look for the others is enough.  The rest are counted once for
    each script: the lambda holds the counts, which a column used in many places would work out at each of them.
    """
    latin_only = _language_of({k: F.lit(int(k == "latin")) for k in SCRIPTS}, default, least)
    counts = F.array(F.struct(*(c.alias(k) for k, c in script_counts(text).items())))
    counted = F.transform(counts, lambda n: _language_of({k: n[k] for k in SCRIPTS}, default, least))[0]
    none = F.struct(F.lit(default).alias("language"), F.lit(0.0).alias("confidence"))
    return F.when(text.rlike(OTHER_SCRIPTS), counted).when(text.rlike(f"[{SCRIPTS['latin']}]"), latin_only).otherwise(none)


def detected_language(text: Column, default: str = "en", least: float = 0.5) -> tuple[Column, Column]:
    """Both fields of :func:`language_and_confidence`; select that instead where both are wanted."""
    both = language_and_confidence(text, default, least)
    return both["language"], both["confidence"]


def log_snippet(text: Column) -> Column:
    """Line breaks to spaces, control characters dropped, white space squeezed."""
    breaks = F.regexp_replace(text, r"[\r\n]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(breaks, r"[\x00-\x08\x0B-\x1F\x7F-\x9F]", ""), r"\s+", " "))


def keyword_terms(text: Column, most: int = 5, default: str = "retrieval") -> Column:
    """First distinct alphanumeric terms of four characters or more."""
    raw = F.split(F.translate(F.lower(text), "-_", "  "), r"\s+")
    terms = F.filter(F.transform(raw, lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}]", "")), lambda t: F.length(t) >= 4)
    found = F.slice(F.array_distinct(terms), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def run_label(label: Column) -> Column:
    """Other characters to ``-``, squeezed, trimmed, 64 at most."""
    return F.substring(F.btrim(F.regexp_replace(label, r"[^A-Za-z0-9]+", "-"), F.lit("-")), 1, 64)


def list_items(text: Column) -> Column:
    """Items of a numbered or bulleted list, or the whole text."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    bare = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^[0-9]+[.)]\s*", ""), r"^[-*]\s*", "")))
    found = F.filter(bare, lambda x: x != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.trim(text)))


def keyword_embedding(text: Column, families: list[tuple[list[str], list[float]]], start: list[float]) -> Column:
    """A base vector plus one vector for each family of keywords that the text has (not normalised)."""
    from .vector import add

    words = F.split(F.translate(F.lower(text), "-", " "), r"\s+")
    out = F.array(*(F.lit(x) for x in start))
    for keys, vector in families:
        hit = F.arrays_overlap(words, F.array(*(F.lit(k) for k in keys)))
        out = F.when(hit, add(out, F.array(*(F.lit(x) for x in vector)))).otherwise(out)
    return out
