"""Comparable forms of titles, author names, DOIs and years, as Spark SQL text."""

from __future__ import annotations

import unicodedata

#: Ligatures of several letters, which a table of single letters cannot take apart.
LIGATURES = {c: unicodedata.normalize("NFKD", c) for c in "ﬀﬁﬂﬃﬄ"}
DOI = r"(10\.[0-9]{4,9}/[^\s\x22<>]+)"


def _bare_letters() -> tuple[str, str]:
    """Letters of one base letter, by compatibility decomposition without marks, and that letter in lower case."""
    letters, bases = [], []
    for i in range(0x80, 0x10000):
        c = chr(i)
        if 0xD800 <= i < 0xE000 or not unicodedata.decomposition(c):
            continue
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if len(bare) == 1 and bare != c and bare not in "'\\":
            letters.append(c)
            bases.append(bare)
    return "".join(letters), "".join(bases)


LETTERS, BASES = _bare_letters()


def plain(x: str) -> str:
    """Lower case without marks; all but letters, digits and underscores as single blanks."""
    text = f"coalesce({x}, '')"
    for c, parts in LIGATURES.items():
        text = f"replace({text}, '{c}', '{parts}')"
    bare = rf"regexp_replace(translate({text}, '{LETTERS}', '{BASES}'), r'\p{{M}}+', '')"
    return rf"trim(regexp_replace(lower({bare}), r'[^\p{{L}}\p{{N}}_]+', ' '))"


def words(x: str) -> str:
    """Distinct words of the plain form."""
    return split_words(plain(x))


def split_words(form: str) -> str:
    """Distinct words of a text that is in the plain form."""
    return f"array_distinct(filter(split({form}, ' '), w -> w <> ''))"


AUTHORS_PART = r"(?i);|\band\b"


def _family(author: str) -> str:
    """The part of one author's text that is the family name: before the comma, else the last word."""
    return f"case when contains({author}, ',') then substring_index({author}, ',', 1) else regexp_extract({author}, r'(\\S+)$', 1) end"


def family_name(x: str) -> str:
    """Family name of the first author of a text: before the comma, else the last word; null if none."""
    return f"nullif({plain(_family(f"trim(split({x}, r'{AUTHORS_PART}')[0])"))}, '')"


def authors(x: str) -> str:
    """The authors of a text, trimmed, empty ones gone."""
    return f"filter(transform(split(coalesce({x}, ''), r'{AUTHORS_PART}'), a -> trim(a)), a -> a <> '')"


def family_names(x: str) -> str:
    """Distinct family names of all authors of a text."""
    return f"array_distinct(filter(transform({authors(x)}, a -> {plain(_family('a'))}), n -> n <> ''))"


def doi(x: str) -> str:
    """The bare lower-case DOI of a field or address, without closing punctuation and preprint version; null if empty."""
    text = f"regexp_replace(regexp_replace(lower(trim(coalesce({x}, ''))), r'^https?://(dx\\.)?doi\\.org/', ''), r'^doi:\\s*', '')"
    found = f"coalesce(nullif(regexp_extract({text}, r'{DOI}', 1), ''), {text})"
    bare = f"regexp_replace({found}, r'[.,;:)\\]}}>]+$', '')"
    return f"nullif(case when startswith({bare}, '10.1101/') then regexp_replace({bare}, r'v[0-9]+$', '') else {bare} end, '')"


def doi_in(x: str) -> str:
    """The DOI inside an address, else null."""
    return f"case when coalesce({x}, '') rlike r'{DOI}' then {doi(x)} end"


def year(x: str) -> str:
    """The first four digits of a text as a number; null if it has none."""
    return f"try_cast(substr(regexp_replace(coalesce({x}, ''), '[^0-9]', ''), 1, 4) as int)"
