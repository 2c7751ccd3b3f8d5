"""One consistent form for texts that look alike (problem 2) and the comparison forms built on it.

``fold`` keeps what a reader sees (letters, accents, case, punctuation, layout) and removes what no reader sees:
width forms, ligatures, kinds of space, invisible characters, composed against combining accents, look-alike letters of
other scripts. The same tables give the DuckDB expression of :func:`fold_sql`; a test holds the two against each other.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import regex

# Letters of other scripts that look like a Latin letter, and that letter.
CYRILLIC_LOOKALIKES = "АВЕЅІЈКМНОРСТХаеѕіјорсухԁԛԝһ"
CYRILLIC_AS_LATIN = "ABESIJKMHOPCTXaesijopcyxdqwh"
GREEK_LOOKALIKES = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο"
GREEK_AS_LATIN = "ABEZHIKMNOPTYXo"
LOOKALIKES = dict(zip(CYRILLIC_LOOKALIKES + GREEK_LOOKALIKES, CYRILLIC_AS_LATIN + GREEK_AS_LATIN))

# Characters without ink, as regular-expression ranges. Joiners (200C, 200D) are treated apart, as they
# shape emoji and Indic or Arabic letters.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b\u200e\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff"
JOINERS = "\u200c\u200d"
SHAPED = "\u0600-\u08ff\u0900-\u109f\u1780-\u17ff"  # scripts whose letters joiners shape
PICTURES = "\u2190-\u21ff\u2300-\u27bf\u2b00-\u2bff\U0001f000-\U0001faff"
#: Compatibility characters that look like several (or the same) plain ones.
COMPAT_RANGES = ((0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2000, 0x200A), (0x2010, 0x2011), (0x2024, 0x2026), (0x202F, 0x202F), (0x203C, 0x203C), (0x2047, 0x2049), (0x205F, 0x205F), (0x2160, 0x217F), (0x3000, 0x3000), (0xFB00, 0xFB06), (0xFB13, 0xFB17))


@lru_cache(1)
def fold_table() -> dict[int, str]:
    """Code point to its plain form, built by rule from the Unicode database and the lists above."""
    table: dict[int, str] = {}
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or 0x20000 <= cp <= 0xDFFFF:
            continue
        ch = chr(cp)
        kind = unicodedata.decomposition(ch)
        if unicodedata.category(ch) == "Zs":
            table[cp] = " "
        elif kind.startswith(("<wide>", "<narrow>", "<square>", "<noBreak>")) or any(a <= cp <= b for a, b in COMPAT_RANGES) and kind.startswith("<compat>"):
            table[cp] = unicodedata.normalize("NFKC", ch)
        elif kind and kind[0] != "<" and (base := unicodedata.normalize("NFD", ch))[0] in LOOKALIKES:
            table[cp] = unicodedata.normalize("NFC", LOOKALIKES[base[0]] + base[1:])
    for ch, to in LOOKALIKES.items():
        table[ord(ch)] = to
    table[0x2010] = table[0x2011] = "-"
    return table


@lru_cache(1)
def _lower_table() -> dict[int, str]:
    """Look-alikes once more after case folding, so that a look-alike capital and its small letter meet."""
    out = {}
    for cp, to in fold_table().items():
        a, b = chr(cp).casefold(), to.casefold()
        if chr(cp) in LOOKALIKES or unicodedata.normalize("NFD", chr(cp))[0] in LOOKALIKES:
            if len(a) == 1 and a != b:
                out[ord(a)] = b
    return out


def lower_pairs() -> dict[str, str]:
    """The single characters of the table above, for SQL."""
    return {chr(k): v for k, v in _lower_table().items() if len(v) == 1}


_INVISIBLE = re.compile(f"[{INVISIBLE}]+")
_JOINERS = re.compile(f"(?<![{SHAPED}])(?<![{PICTURES}])[{JOINERS}]|(?<=[{PICTURES}])[{JOINERS}](?![{PICTURES}])")
_FOLDED = re.compile("[" + "".join(map(re.escape, map(chr, sorted(fold_table())))) + "]")


def fold(text: str) -> str:
    """The form under which texts that look the same are equal. ASCII text is its own form."""
    if text.isascii():
        return text
    try:  # Latin-1 text is composed already and has two characters to fold
        text.encode("latin-1")
        return text.replace("\u00a0", " ").replace("\u00ad", "")
    except UnicodeEncodeError:
        pass
    table = fold_table()
    text = _JOINERS.sub("", _INVISIBLE.sub("", text))
    text = unicodedata.normalize("NFC", text)
    changed = _FOLDED.sub(lambda m: table[ord(m[0])], text)
    return text if changed is text else unicodedata.normalize("NFC", changed)


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@lru_cache(1)
def fold_sql(column: str = "text") -> str:
    """The same form as one DuckDB expression over ``column``."""
    one = {chr(k): v for k, v in fold_table().items() if len(v) == 1}
    many = {chr(k): v for k, v in fold_table().items() if len(v) > 1}
    # invisible characters; joiners that hold emoji together or shape letters are parked on private characters meanwhile
    park = {"\u200c": "\ue0fc", "\u200d": "\ue0fd"}
    x = f"regexp_replace({column}, '[{INVISIBLE}]+', '', 'g')"
    for joiner, parked in park.items():
        for _ in range(2):  # runs of pictures overlap
            x = f"regexp_replace({x}, '([{PICTURES}]){joiner}([{PICTURES}])', '\\1{parked}\\2', 'g')"
        x = f"regexp_replace({x}, '([{SHAPED}]){joiner}', '\\1{parked}', 'g')"
    x = f"translate({x}, {_literal(''.join(park))}, '')"
    x = f"translate({x}, {_literal(''.join(park.values()))}, {_literal(''.join(park))})"
    x = f"CASE WHEN regexp_matches({column}, '[{INVISIBLE}{JOINERS}]') THEN {x} ELSE {column} END"
    x = f"translate(nfc_normalize({x}), {_literal(''.join(one))}, {_literal(''.join(one.values()))})"
    chain = "y"
    for a, b in many.items():
        chain = f"replace({chain}, {_literal(a)}, {_literal(b)})"
    pattern = "[" + "".join(many) + "]"
    return f"(SELECT nfc_normalize(CASE WHEN regexp_matches(y, {_literal(pattern)}) THEN {chain} ELSE y END) FROM (SELECT {x} AS y))"


_OTHER_SCRIPT = re.compile("[\u0370-\u052f\u1f00-\u1fff]")
_PLAIN_DROP = re.compile(r"[\W_]+")
_DROP = regex.compile(r"[^\p{L}\p{N}\p{M}]+")
_PLAIN_PUNCTUATION = re.compile(r"[^\w\s]+|_+")
_PUNCTUATION = regex.compile(r"[^\p{L}\p{N}\p{M}\s]+")
_LATIN_PUNCTUATION = bytes(c for c in range(256) if _PLAIN_PUNCTUATION.match(chr(c)))
_LATIN_DROP = bytes(c for c in range(256) if _PLAIN_DROP.match(chr(c)))
_NOT_PLAIN = re.compile("[^\\u0000-\\u02ff\\u2000-\\u206f]")


def caseless(text: str) -> str:
    """Folded text without letter case; look-alike capitals and small letters of other scripts meet as well."""
    text = fold(text).casefold()
    if text.isascii() or not _OTHER_SCRIPT.search(text):
        return text
    return unicodedata.normalize("NFC", text.translate(_lower_table()))


def letters(text: str) -> str:
    """Letters, digits and marks of already folded text, in order."""
    try:
        return text.encode("latin-1").translate(None, _LATIN_DROP).decode("latin-1")
    except UnicodeEncodeError:
        return (_DROP if _NOT_PLAIN.search(text) else _PLAIN_DROP).sub("", text)


def words(text: str) -> list[str]:
    """Words as they stand between white space, without punctuation, letter case and invisible differences."""
    text = caseless(text)
    try:
        return text.encode("latin-1").translate(None, _LATIN_PUNCTUATION).decode("latin-1").split()
    except UnicodeEncodeError:
        return (_PUNCTUATION if _NOT_PLAIN.search(text) else _PLAIN_PUNCTUATION).sub("", text).split()
