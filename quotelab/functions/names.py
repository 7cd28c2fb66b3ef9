"""Name keys for entity matching, as native string expressions."""
from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotelab.dims import lookup

# ---- fixed values: team aliases, generational suffixes, accent folding --------------------------
TEAM_ALIASES = {
    "oakland athletics": "athletics",
    "sacramento athletics": "athletics",
    "las vegas athletics": "athletics",
    "cleveland indians": "cleveland guardians",
    "tampa bay devil rays": "tampa bay rays",
    "florida marlins": "miami marlins",
    "st louis cardinals": "st. louis cardinals",
}
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")
# ---- end of fixed values -----------------------------------------------------------------------


def _decomposable(first: int, last: int) -> tuple[str, str]:
    """Lower-case letters of a range that decompose to a plain letter and marks, and those plain letters."""
    pairs = [(c, unicodedata.normalize("NFKD", c)) for c in map(chr, range(first, last + 1)) if c == c.lower()]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and "a" <= d[0] <= "z" and all(map(unicodedata.combining, d[1:]))]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


#: Latin-1, Latin Extended-A and -B, Latin Extended Additional.
_ACCENTED, _PLAIN = map("".join, zip(_decomposable(0xC0, 0x24F), _decomposable(0x1E00, 0x1EFF), strict=True))


def fold(name: Column) -> Column:
    """Lower case without accents. Decomposed input loses its combining marks as well."""
    return F.regexp_replace(F.translate(F.lower(name), _ACCENTED, _PLAIN), r"\p{Mn}", "")


def team_key(name: Column) -> Column:
    key = F.regexp_replace(F.trim(fold(F.coalesce(name, F.lit("")))), r"\s+", " ")
    return F.coalesce(lookup(TEAM_ALIASES, key), key)


def person_key(name: Column) -> Column:
    """Name without qualifiers, punctuation or generational suffixes."""
    s = fold(F.coalesce(name, F.lit("")))
    s = F.replace(F.replace(s, F.lit("&apos;"), F.lit("'")), F.lit("`"), F.lit("'"))
    s = F.regexp_replace(s, r"\([^)]*\)", " ")
    s = F.regexp_replace(s, r"[^a-z0-9'. ]+", " ")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    s = F.regexp_replace(s, rf"(?:(?:^|\s+)\.*(?:{'|'.join(SUFFIXES)})\.*)+$", "")
    return F.trim(F.replace(s, F.lit("."), F.lit("")))


def last_word(key: Column) -> Column:
    return F.element_at(F.split(key, " "), -1)


def initial_last(key: Column) -> Column:
    """First initial and last name of a key; one-word keys stay whole."""
    return F.when(F.instr(key, " ") > 0, F.concat(F.substring(key, 1, 1), F.lit(" "), last_word(key))).otherwise(key)
