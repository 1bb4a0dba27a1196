"""Text analysis as column expressions: tokens, grams, filters, stemming."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}]+"

#: The default English stop list of the standard analyzer.
STOPS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of",
    "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)

#: Section headings that hold no article text.
SECTION_BLACKLIST = ("see also", "references", "external links", "notes", "further reading")


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN), F.lit(0))


def stopped(terms, stops=STOPS) -> Column:
    """Terms that are no stop words; order and repeats stay."""
    words = F.array(*[F.lit(s) for s in stops])
    return F.filter(col(terms), lambda t: ~F.array_contains(words, t))


def possessive_stripped(terms) -> Column:
    return F.transform(col(terms), lambda t: F.regexp_replace(t, r"['’]s$", ""))


def analyzed(text, analyzer: str = "standard", stops=STOPS) -> Column:
    """The four analyzers: standard, standard_stopped, english, english_stopped."""
    terms = tokens(text)
    if analyzer == "standard":
        return stopped(terms, STOPS)
    if analyzer == "standard_stopped":
        return stopped(terms, stops)
    if analyzer == "english":
        return stems(stopped(possessive_stripped(terms), STOPS))
    if analyzer == "english_stopped":
        return stems(stopped(possessive_stripped(terms), stops))
    raise ValueError(f"no analyzer {analyzer}")


def query_text(text) -> Column:
    """A query without its id prefixes, percent escapes and slashes."""
    out = F.replace(F.replace(col(text), F.lit("enwiki:"), F.lit("")), F.lit("tqa:"), F.lit(""))
    return F.replace(F.replace(out, F.lit("%20"), F.lit(" ")), F.lit("/"), F.lit(" "))


def squeezed(text) -> Column:
    return F.regexp_replace(col(text), "[ ]+", " ")


def entity_name(text) -> Column:
    """The normal form of an entity's name."""
    out = F.replace(F.replace(col(text), F.lit("enwiki:"), F.lit("")), F.lit("%20"), F.lit("_"))
    return F.replace(out, F.lit(" "), F.lit("_"))


def section_tokens(query) -> Column:
    """Tokens of each part of a slash-separated query."""
    return F.transform(F.split(col(query), "/"), tokens)


def sentences(text) -> Column:
    return F.filter(F.transform(F.split(col(text), r"\."), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def word_ngrams(terms, n: int, sep: str = "") -> Column:
    """n adjacent terms, joined; none where there are fewer."""
    t = col(terms)
    return F.when(
        F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, F.lit(n)), sep))
    ).otherwise(F.array().cast("array<string>"))


def bigrams(terms, sep: str = "") -> Column:
    return word_ngrams(terms, 2, sep)


def windowed_index(terms, k: int = 8, sep: str = "") -> Column:
    """Each term with each of the next k, in both orders; windows at the end are partial."""
    t = col(terms)
    pairs = F.transform(
        t,
        lambda x, i: F.flatten(
            F.transform(F.slice(t, i + 2, F.lit(k)), lambda y: F.array(F.concat(x, F.lit(sep), y), F.concat(y, F.lit(sep), x)))
        ),
    )
    return F.when(F.size(t) >= 2, F.flatten(pairs)).otherwise(F.array().cast("array<string>"))


def windowed_query(terms, k: int = 8, sep: str = "") -> Column:
    """The first term of every whole window of k with each other one, in both orders."""
    t = col(terms)
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(t) - (k - 1)),
        lambda i: F.flatten(
            F.transform(
                F.slice(t, i + 1, F.lit(k - 1)),
                lambda y: F.array(F.concat(F.get(t, i - 1), F.lit(sep), y), F.concat(y, F.lit(sep), F.get(t, i - 1))),
            )
        ),
    )
    return F.when(F.size(t) >= k, F.flatten(pairs)).otherwise(F.array().cast("array<string>"))


def char_ngrams(terms, n: int) -> Column:
    """Runs of n characters of each term; shorter terms have none."""
    return F.flatten(
        F.transform(
            F.filter(col(terms), lambda t: F.length(t) >= n),
            lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substr(t, i, F.lit(n))),
        )
    )


def token_ball(terms, start, end, k: int) -> Column:
    """Terms start..end (0-based, end exclusive) with k before and k after."""
    t, s, e = col(terms), col(start), col(end)
    first = F.greatest(s - k, F.lit(0))
    return F.slice(t, (first + 1).cast("int"), (e + k - first).cast("int"))


def name_unigrams(name, least: int = 0) -> Column:
    """Terms of an underscore-joined name longer than least characters."""
    return F.filter(tokens(F.replace(col(name), F.lit("_"), F.lit(" "))), lambda t: F.length(t) > least)


def is_good_paragraph(text) -> Column:
    """Long enough and neither a list nor a definition."""
    t = col(text)
    return (F.length(t) > 100) & ~F.contains(t, F.lit(":")) & ~F.contains(t, F.lit("•"))


def is_listed_section(heading) -> Column:
    return ~F.lower(F.trim(col(heading))).isin(*SECTION_BLACKLIST)


# -- stemming ------------------------------------------------------------------


def _consonants(word: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(word):
        out.append(c not in "aeiou" and not (c == "y" and i > 0 and out[-1]))
    return out


def _measure(stem: str) -> int:
    c = _consonants(stem)
    return sum(1 for a, b in zip(c, c[1:]) if not a and b)


def _vowel(stem: str) -> bool:
    return not all(_consonants(stem))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonants(word)[-1]


def _cvc(word: str) -> bool:
    return len(word) > 2 and _consonants(word)[-3:] == [True, False, True] and word[-1] not in "wxy"


#: Suffix rules of the published stemming algorithm, steps 2 to 4.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The Porter stem (Porter 1980)."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and _vowel(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and _vowel(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            cut += "e"
        elif _double(cut) and cut[-1] not in "lsz":
            cut = cut[:-1]
        elif _measure(cut) == 1 and _cvc(cut):
            cut += "e"
        word = cut
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        found = max((r for r in rules if word.endswith(r[0])), key=lambda r: len(r[0]), default=None)
        if found and _measure(word[: -len(found[0])]) > 0:
            word = word[: -len(found[0])] + found[1]
    found4 = max((s for s in _STEP4 if word.endswith(s)), key=len, default=None)
    if found4:
        base = word[: -len(found4)]
        if _measure(base) > 1 and (found4 != "ion" or base[-1:] in ("s", "t")):
            word = base
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not _cvc(base):
            word = base
    if _measure(word) > 1 and _double(word) and word.endswith("l"):
        word = word[:-1]
    return word


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(terms: pd.Series) -> pd.Series:
    return terms.map(lambda ts: None if ts is None else [stem(t) for t in ts])


def stems(terms) -> Column:
    """Stems of each term; stem the vocabulary and join it where texts are many."""
    return _stems(col(terms))
