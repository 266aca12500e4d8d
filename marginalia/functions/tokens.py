"""Tokens of retrieval: runs of ASCII letters and digits of the lower-case text, accents taken apart.

An accented Latin letter counts as its base letter followed by a break, as a decomposition would have it:
'café au' has the tokens cafe, au; 'évian' has e, vian. Everything is built-in expressions, so it stays
inside the engine.
"""

from __future__ import annotations

import unicodedata

from marginalia.functions.values import SPARK, Dialect


def _letters() -> tuple[str, str, str, str]:
    """Accented letters and their bases; compatibility forms of one character and what they stand for."""
    accented, bases, forms, plain = [], [], [], []
    for i in (*range(0xAA, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x20A0), *range(0xFF10, 0xFF5B)):
        c = chr(i)
        if c.lower() != c:
            continue
        parts = unicodedata.normalize("NFKD", c).lower()
        if len(parts) == 1 and parts != c and parts.isascii() and parts.isalnum():
            forms.append(c)
            plain.append(parts)
        elif len(parts) > 1 and parts[0].isascii() and parts[0].isalnum() and all(unicodedata.combining(x) for x in parts[1:]):
            accented.append(c)
            bases.append(parts[0])
    return "".join(accented), "".join(bases), "".join(forms), "".join(plain)


ACCENTED, BASES, FORMS, PLAIN = _letters()


#: Stand-ins of the base letters a to z while breaks are put behind them: one range, so the expression stays fast.
FIRST, LAST = chr(0xE061), chr(0xE07A)
STAND_INS = "".join(chr(0xE000 + ord(b)) for b in BASES)
ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def folded(x: str, d: Dialect = SPARK) -> str:
    """Lower-case text with accents taken apart."""
    group = "$1 " if d.name == "spark" else r"\1 "
    marked = f"translate(lower({x}), '{ACCENTED}{FORMS}', '{STAND_INS}{PLAIN}')"
    return f"translate({d.sub(marked, f'([{FIRST}-{LAST}])', group)}, '{''.join(chr(0xE000 + ord(c)) for c in ALPHABET)}', '{ALPHABET}')"


def tokens(x: str, d: Dialect = SPARK) -> str:
    """Array of the tokens of ``x`` in order; empty for null and for texts without any."""
    text = folded(f"coalesce({x}, '')", d)
    return f"regexp_extract_all({text}, {d.pattern('[a-z0-9]+')}, 0)" if d.name == "spark" else f"regexp_extract_all({text}, {d.pattern('[a-z0-9]+')})"


def token_text(x: str, d: Dialect = SPARK) -> str:
    """Tokens parted and enclosed by blanks, for whole-word containment."""
    inner = d.sub(folded(f"coalesce({x}, '')", d), "[^a-z0-9]+", " ")
    return f"concat(' ', trim({inner}), ' ')"
