"""Text columns with Python string semantics, expressed as JVM-side Spark functions.

Java's ``\\w``, ``\\s`` and ``\\b`` are narrower than the Unicode-aware classes the question
records were built for, so the character classes are spelled out here once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as whitespace, for use inside a character class.
SPACE = (
    r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
)
# The same code points one by one, for functions that take a set of characters.
SPACES = "".join(chr(n) for n in range(0x3001) if re.match(f"[{SPACE}]", chr(n)))
# A class of so many ranges is slow to try, so each use is guarded by a short one: no printable ASCII
# character is looked up among the spaces, and no plain space among the other characters.
_PLAIN_SPACE = r"[\x09-\x0D\x1C-\x20]"
GAP = rf"(?:{_PLAIN_SPACE}|(?![\x21-\x7E])[{SPACE}])*+"
# One run of non-space characters.
TOKEN = rf"(?:[\x21-\x7E]+|(?!{_PLAIN_SPACE})[^{SPACE}])++"
WORD = r"[\p{L}\p{N}_]"
BOUNDARY_LEFT = rf"(?<!{WORD})"
BOUNDARY_RIGHT = rf"(?!{WORD})"

# Query words that never count as an evidence requirement.
STOPWORDS = (
    "a an and are as at be by did do does for from how in is it of on or the to "
    "was were what when where which who with"
).split()
NO_TERMS = "__no_terms__"

# Cherokee folds towards upper case; both ranges follow from the code charts.
_CHEROKEE_LOWER = "".join(map(chr, [*range(0xAB70, 0xABC0), *range(0x13F8, 0x13FE)]))
_CHEROKEE_UPPER = "".join(map(chr, range(0x13A0, 0x13F6)))


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body`` as often as needed.

    A column that a lambda refers to is otherwise evaluated again for every array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bounded(pattern: str) -> str:
    """The pattern as a whole word (or run of words).

    Where every alternative starts with a plain character, a look at that character comes
    before the costlier look back, so most positions of a text fail at once.
    """
    starts = {choice[0] for choice in pattern.split("|")}
    quick = f"(?=[{''.join(sorted(starts))}])" if all(c.isalnum() for c in starts) else ""
    return f"{quick}{BOUNDARY_LEFT}(?:{pattern}){BOUNDARY_RIGHT}"


def casefold(text: Column | str) -> Column:
    """Full Unicode case folding; Latin text takes the short path.

    Folding is lower(upper(x)) except where the round trip is not the identity on folded
    text: dotless i, capital and final sigma, sharp s and Cherokee. Private-use characters
    carry the first two through the round trip. Below U+0149, apart from the micro sign, only
    sharp s folds differently from lower case. Text without any character of several bytes needs
    neither, which its two lengths tell without a pattern.
    """
    text = col(text)
    upper = F.upper(F.translate(text, "ı", "\ue000"))
    lower = F.lower(F.translate(upper, "Σ", "\ue001"))
    folded = F.translate(
        F.replace(lower, F.lit("ß"), F.lit("ss")),
        "\ue000\ue001ς" + _CHEROKEE_LOWER,
        "ıσσ" + _CHEROKEE_UPPER,
    )
    latin = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).when(
        text.rlike(r"[^\x00-\xB4\xB6-\u0148]"), folded
    ).otherwise(latin)


def strip(text: Column | str) -> Column:
    return F.regexp_replace(col(text), f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(text: Column | str) -> Column:
    return ~col(text).rlike(f"[^{SPACE}]")


def word_count(text: Column | str) -> Column:
    return F.regexp_count(col(text), F.lit(TOKEN))


def terms(text: Column | str) -> Column:
    return F.regexp_extract_all(casefold(text), F.lit(f"({WORD}+)"), F.lit(1))


def query_terms(text: Column | str) -> Column:
    """Distinct query terms in code point order, the order scores are summed in."""
    return F.array_sort(F.array_distinct(terms(text)))


def requirements(text: Column | str) -> Column:
    """Distinct content terms of a question, or one placeholder when none is left."""
    stop = F.array(*[F.lit(word) for word in STOPWORDS])
    kept = F.array_sort(F.array_except(terms(text), stop))
    return F.when(F.size(kept) == 0, F.array(F.lit(NO_TERMS))).otherwise(kept)


def question_key(text: Column | str) -> Column:
    return F.array_join(terms(text), " ")


_URL = r"(?s)^(?:[hH][tT][tT][pP][sS]?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def canonical_url(url: Column | str) -> Column:
    """host + path + query of an http(s) address, or null.

    Scheme, user, port, fragment, a leading ``www.`` and trailing slashes do not identify a
    page; the query string does.
    """
    text = strip(url)
    authority = F.regexp_replace(F.regexp_extract(text, _URL, 1), "^.*@", "")
    host = casefold(F.regexp_extract(authority, r"^(?:\[([^\]]*)\]|([^:\[]*))", 0))
    host = F.regexp_replace(F.regexp_replace(host, r"^\[|\]$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(text, _URL, 2), "/+$", "")
    query = F.regexp_extract(text, _URL, 3)
    full = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(text.rlike(_URL) & ~authority.rlike(r"^(?::|\[\]|$)"), full)


def query_moment(query_time: Column | str) -> Column:
    """Naive question time; null when the text is not in the one accepted format."""
    return F.try_to_timestamp(col(query_time), F.lit("MM/dd/yyyy, HH:mm:ss 'PT'"))


def query_date(query_time: Column | str) -> Column:
    return F.to_date(query_moment(query_time))


def asked_date(query_time: Column | str) -> Column:
    """The question's date; a time that is not in the accepted format stops the query."""
    shown = F.concat(F.lit("question time is not readable: "), F.coalesce(col(query_time), F.lit("null")))
    return F.when(query_moment(query_time).isNull(), F.raise_error(shown).cast("date")).otherwise(
        query_date(query_time)
    )


def content_hash(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by a zero character."""
    return F.sha2(F.concat_ws("\0", *[col(p).cast("string") for p in parts]), 256)
