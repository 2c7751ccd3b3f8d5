"""Column functions over text and hosts. Built-in expressions; Arrow UDFs only for text that is not ASCII."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The two kinds of unit (runs of letters, digits and underscores; runs of other signs), in a form that Java
# and RE2 read alike, white space of every kind, sentences, URLs.
UNIT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]+"
WORD = r"[\p{L}\p{N}_]+"
SENTENCE = r"[^.!?\n]+[.!?]?"
OUTER_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
SPACE_RUN = r"[\s\p{Z}]+"
URL = r"(?i)\b(?:https?://|www\.)\S+"
HOST = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:\\\s]*)"


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, OUTER_SPACE, "")


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


@F.pandas_udf(StringType())
def _nfkc_casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


@F.pandas_udf(StringType())
def _idna(host: pd.Series) -> pd.Series:
    def encode(h: str | None) -> str | None:
        try:
            return None if h is None else h.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    return host.map(encode)


def normalized(text: Column) -> Column:
    """NFKC, case folding, white space collapsed. ASCII text stays in the JVM; the UDF sees nulls for it."""
    other = _nfkc_casefold(F.when(~is_ascii(text), text))
    return F.when(is_ascii(text), F.trim(F.regexp_replace(F.lower(text), r"[\s\x1c-\x1f]+", " "))).otherwise(other)


def folded(text: Column) -> Column:
    """Lower case with the final sigma as any sigma: case folding for text in normal form."""
    return F.translate(F.lower(text), "ς", "σ")


def collapsed(text: Column) -> Column:
    """White space collapsed and trimmed, then case folded; no compatibility mapping."""
    return folded(stripped(F.regexp_replace(text, SPACE_RUN, " ")))


def normal_host(url: Column) -> Column:
    """Host of a URL: trimmed, lower case, end dots and one leading ``www.`` dropped, IDNA where needed; null for none, for
    hosts over 253 characters and for hosts without a dot."""
    raw = F.regexp_replace(F.regexp_extract(F.lower(stripped(url)), HOST, 1), r"\.+$", "")
    ascii_host = F.when(is_ascii(raw), raw).otherwise(_idna(F.when(~is_ascii(raw), raw)))
    host = F.regexp_replace(ascii_host, r"^www\.", "")
    return F.when((F.length(host) > 0) & (F.length(host) <= 253) & F.contains(host, F.lit(".")), host)


def site_of_host(host: Column) -> Column:
    return F.concat(F.lit("site_"), F.substring(F.sha2(host, 256), 1, 20))


def letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))


def ascii_letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^A-Za-z]+", ""))


def letter_ratio(text: Column) -> Column:
    """ASCII letters among letters, 0 without letters."""
    return F.coalesce(F.try_divide(ascii_letter_count(text).cast("double"), letter_count(text)), F.lit(0.0))


def units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def word_list(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), folded)


def sentence_list(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: stripped(s) != "")


def hash_rank_key(*parts: Column | str) -> Column:
    """sha256 of the parts joined by ``:``; the order of all hash-ranked choices."""
    return F.sha2(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts]), 256)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def leaks_source(text: Column, host: Column) -> Column:
    """A URL, or the record's own host, stands in the text."""
    return text.rlike(URL) | F.contains(normalized(text), F.lower(host))
