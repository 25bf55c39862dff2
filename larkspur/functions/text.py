"""Text kernel: folding, tokens, similarities, slugs, URLs, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that fold to one ASCII letter each, and those that fold to two.
ACCENTS = "àáâãäåāăąçćčďèéêëēėęěìíîïīįñńňòóôõöōőøùúûüūůűýÿžźżšśťřłđğ"
PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiiinnnoooooooouuuuuuuyyzzzsstrldg"
DOUBLE = {"ß": "ss", "æ": "ae", "œ": "oe"}


def unaccent(c) -> Column:
    """Lower-case, without the accents listed above."""
    out = F.translate(F.lower(c), ACCENTS, PLAIN)
    for a, b in DOUBLE.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fold(c) -> Column:
    """unaccent, other characters than letters a-z and digits to single blanks, trimmed."""
    return F.trim(F.regexp_replace(unaccent(c), "[^a-z0-9]+", " "))


def padded(c) -> Column:
    """Folded text between blanks: whole words are then substrings."""
    return F.concat(F.lit(" "), fold(c), F.lit(" "))


def has_word(folded, word: str) -> Column:
    return F.contains(folded, F.lit(f" {word} "))


def normalized_name(c, generic: list[str]) -> Column:
    """Folded text without generic words, unless fewer than 3 characters would stay."""
    words = F.array_join(F.filter(F.split(fold(c), " "), lambda w: ~w.isin(generic)), " ")
    return F.when(F.length(words) < 3, fold(c)).otherwise(words)


def ruled(c, rules: list[tuple[str, str]]) -> Column:
    """Ordered replacements over folded text, each on what the one before left."""
    out = fold(c)
    for pattern, to in rules:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(F.regexp_replace(out, " +", " "))


def numbered_bigrams(c) -> Column:
    """Two-letter substrings, each with the number of equal ones before it: an array without repeats, so that set functions count multisets."""
    own = bigrams(c)
    return F.transform(own, lambda g, i: F.concat(g, F.size(F.filter(F.slice(own, F.lit(1), i), lambda z: z == g)).cast("string")))


def dice_of(x, y) -> Column:
    """Dice coefficient of two columns of numbered bigrams."""
    total = F.size(x) + F.size(y)
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(x, y)) / total).otherwise(F.lit(0.0))


def bigrams(c) -> Column:
    """Two-letter substrings in order; none for shorter texts."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) >= 2, F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def word_overlap(a, b, least: int = 3) -> Column:
    """Common words over the larger set, of words with `least` letters or more."""
    x, y = (F.array_distinct(F.filter(F.split(fold(c), " "), lambda w: F.length(w) >= least)) for c in (a, b))
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most > 0, F.size(F.array_intersect(x, y)) / most).otherwise(F.lit(0.0))


def prefix_distance(text, word: str) -> Column:
    """Least edit distance of a word to the words of a folded text, each cut to the word's length."""
    n = len(word)
    return F.array_min(F.transform(F.split(text, " "), lambda w: F.levenshtein(F.left(w, F.lit(n)), F.lit(word))))


def slug(c, most: int) -> Column:
    """Folded words joined by hyphens, as many whole ones as fit in `most` characters; the first is cut if it must."""
    words = F.split(fold(c), " ")
    joined = F.aggregate(words, F.lit(""), lambda s, w: F.when(F.endswith(s, F.lit("-~")), s).when(s == "", F.left(w, F.lit(most))).when(F.length(s) + F.length(w) + 1 <= most, F.concat(s, F.lit("-"), w)).otherwise(F.concat(s, F.lit("-"), F.lit("~"))))
    return F.regexp_replace(joined, "-~.*$", "")


def host(c) -> Column:
    """Host of a URL, lower-case and without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"^[A-Za-z]+://([^/?#]+)", 1)), r"^www\.", "")


def url_key(c) -> Column:
    """A URL's identity: host and path, without scheme, www, query, fragment and a slash at the end."""
    path = F.regexp_replace(F.regexp_extract(c, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1), "/+$", "")
    return F.concat(host(c), path)


def quote_is_on(text, quote: str) -> Column:
    """Whether a quote stands in a text, case, accents, marks and spacing aside."""
    import unicodedata

    plain = "".join(ch for ch in unicodedata.normalize("NFD", quote.lower()) if not unicodedata.combining(ch))
    words = " ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in plain).split())
    return F.contains(fold(text), F.lit(words))


# Entities that are decoded by name.
ENTITIES = {"&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def decoded(c) -> Column:
    """Named entities to characters, twice, as doubly escaped text asks for."""
    out = F.col(c) if isinstance(c, str) else c
    for _ in range(2):
        for name, ch in ENTITIES.items():
            out = F.replace(out, F.lit(name), F.lit(ch))
    return out


def visible_text(html, most: int = 20_000) -> Column:
    """Text of a page without script, style, nav and footer, tags as blanks, white space collapsed, at most `most` characters."""
    out = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|noscript)\b.*?</\1>", " ")
    out = decoded(F.regexp_replace(out, "(?s)<[^>]*>", " "))
    return F.left(F.trim(F.regexp_replace(out, r"[\s\x{A0}]+", " ")), F.lit(most))
