"""Column functions over text: cleaning, tokens, keyword tables, titles, addresses."""

from __future__ import annotations

import html
import re
from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words left out of headline tokens.
HEADLINE_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "in", "into", "is", "it",
    "its", "of", "on", "or", "over", "says", "say", "said", "than", "that", "the", "their", "this", "to", "under",
    "up", "was", "were", "will", "with", "after", "before", "during", "new", "more", "amid",
]

#: Words left out of listing titles.
TITLE_STOPWORDS = ["a", "an", "and", "at", "in", "n", "of", "on", "the", "to", "with"]

#: A query parameter that carries a credential.
SECRET_PARAMETER = r"(?i)([?&;](?:api[_-]?key|key|token|access[_-]?token|auth|password|secret|client[_-]?secret|signature|sig)=)[^&#\s'\"<>]+"
MASK = "[REDACTED]"


def strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def blank_to_null(c: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def headline_tokens(title: Column) -> Column:
    """Distinct lower-case tokens `[a-z0-9']+` of a headline: digits of any length, other words of three signs or more, without stopwords. Null title: none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0))
    kept = F.filter(words, lambda w: w.rlike("^[0-9]+$") | (F.length(w) > 2))
    return F.array_except(F.array_distinct(kept), strings(HEADLINE_STOPWORDS))


def number_tokens(tokens: Column) -> Column:
    """Tokens of digits that are no year of the 1900s or 2000s."""
    return F.filter(tokens, lambda t: t.rlike("^[0-9]+$") & ~t.rlike("^(19|20)..$"))


def column_key(title: Column) -> Column:
    """A headline without case, signs and plural s: what a recurring column shares with its next issue."""
    words = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.left(w, F.length(w) - 1)).otherwise(w)), " ")


def normal_title(title: Column) -> Column:
    """A listing title as its words with single blanks: lower case, signs to blanks, stopwords out; a title of stopwords alone keeps them."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))
    kept = F.rtrim(F.regexp_replace(words, rf"\b(?:{'|'.join(TITLE_STOPWORDS)})(?: |$)", ""))
    return F.coalesce(F.nullif(kept, F.lit("")), words)


def title_tokens(title: Column) -> Column:
    """The words of a normal title in order; none of an empty one."""
    normal = normal_title(title)
    return F.when(normal == "", F.array().cast("array<string>")).otherwise(F.split(normal, " "))


def canonical_key(title: Column, start: Column) -> Column:
    """32 hex digits of the SHA-256 of `normal title|UTC hour` (session time zone UTC)."""
    return key_of(normal_title(title), start)


def key_of(normal: Column, start: Column) -> Column:
    """canonical_key() of a title that is normal already."""
    return F.left(F.sha2(F.concat(normal, F.lit("|"), F.date_format(start, "yyyy-MM-dd'T'HH")), 256), F.lit(32))


def token_equal(a: Column, b: Column) -> Column:
    """Equal, or both of five signs or more and one edit apart."""
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= 5) & (F.levenshtein(a, b, 1) >= 0))


def tokens_match(a: Column, b: Column) -> Column:
    """The smaller token list (of two or more; the first where equally long) is contained in the larger: each token takes the first equal one left."""
    first = F.size(a) <= F.size(b)
    small, large = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)

    def take(left: Column, token: Column) -> Column:
        hit = F.array_position(F.transform(left, lambda o: token_equal(token, o)), True)
        rest = F.concat(F.slice(left, F.lit(1), F.greatest(hit.cast("int") - 1, F.lit(0))), F.slice(left, hit.cast("int") + 1, F.size(left)))
        return F.when(left.isNull() | (hit == 0), F.lit(None).cast("array<string>")).otherwise(rest)

    # a short token takes its equal only: without one the rest need not be looked at
    lost = F.exists(F.array_except(small, large), lambda w: F.length(w) < 5)
    return F.when((F.size(small) < 2) | lost, False).otherwise(F.reduce(small, large, take).isNotNull())


def keyword_keys(text: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """Keys of a keyword table, in its order, with a keyword inside the lower-case text padded with a blank at both ends."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    return F.array_compact(F.array(*[F.when(reduce(lambda x, y: x | y, [padded.contains(w) for w in words]), F.lit(key)) for key, words in table.items()]))


def truncate_sentences(text: Column, most: int) -> Column:
    """Cut after the last `. `, `! ` or `? ` (tried in this order) beyond the middle, else at the last blank with an ellipsis."""
    cut = F.left(text, F.lit(most))
    last = lambda sep: F.length(cut) - F.instr(F.reverse(cut), F.lit(sep[::-1])) - len(sep) + 1
    has = lambda sep: cut.contains(sep) & (last(sep) > most // 2)
    out = F.when(F.length(text) <= most, text)
    for sep in (". ", "! ", "? "):
        out = out.when(has(sep), F.substring(cut, F.lit(1), last(sep) + 1))
    at = F.when(cut.contains(" "), last(" ")).otherwise(-1)
    return out.otherwise(F.concat(F.rtrim(F.when(at > 0, F.substring(cut, F.lit(1), at)).otherwise(cut), F.lit(",;:")), F.lit("…")))


#: Scripts and styles, whose inside is text; comments, declarations, and tags with their quoted attributes; what is left open runs to the end.
_MARKUP = re.compile(r"""<(?P<raw>script|style)\b[^>]*>(?P<inside>.*?)(?:</(?P=raw)\s*>|$)|<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*(?:>|$)|(?P<bare><)""", re.DOTALL | re.IGNORECASE)


@F.pandas_udf(T.StringType())
def strip_html(text: pd.Series) -> pd.Series:
    """Plain text of an HTML fragment: markup, also where it was written by entities, gives way to a blank, entities of the text become signs, and white space is collapsed. A `<` that opens nothing stands alone. Null gives an empty text; a bare `&` stays as it is."""
    shown = text.fillna("").map(html.unescape).str.replace(_MARKUP, lambda m: f" {m['inside'] or m['bare'] or ''} ", regex=True)
    return shown.map(html.unescape).str.split().str.join(" ")


def join_parts(*parts: Column) -> Column:
    """Trimmed parts that are not blank, joined by `, `; null where there are none."""
    return F.nullif(F.concat_ws(", ", *[blank_to_null(p) for p in parts]), F.lit(""))


def clean_image(url: Column) -> Column:
    """An image URL, null where blank or where its last path part names stock art."""
    bare = blank_to_null(url)
    name = F.substring_index(F.regexp_replace(F.regexp_replace(bare, "[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""), "/", -1)
    return F.when(~name.rlike("(?i)generic|placeholder|default|stock"), bare)


def slug(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("event"))


def redact(text: Column, secrets: Sequence[str] = ()) -> Column:
    """Mask credentials: values of secret-looking query parameters, and the given secrets of eight signs or more, also percent-encoded, longest first."""
    out = F.regexp_replace(text, SECRET_PARAMETER, "$1" + MASK.replace("[", "\\[").replace("]", "\\]"))
    literal = {v for s in secrets if len(s) >= 8 for v in (s, quote(s, safe=""))}
    for value in sorted(literal, key=lambda v: (-len(v), v)):
        out = F.replace(out, F.lit(value), F.lit(MASK))
    return out
