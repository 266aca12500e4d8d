"""Scalar expressions over typed-in values, as SQL text for Spark or for the SQL they are checked against.

Every function takes SQL expressions and gives one back. A :class:`Dialect` spells the few functions that are
called differently; patterns use explicit classes and no look-around, so that both engines read them alike.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    name: str

    def pattern(self, p: str) -> str:
        text = p.replace("'", "\\x27")
        return f"r'{text}'" if self.name == "spark" else f"'{text}'"

    def has(self, x: str, p: str) -> str:
        return f"({x} rlike {self.pattern(p)})" if self.name == "spark" else f"regexp_matches({x}, {self.pattern(p)})"

    def sub(self, x: str, p: str, by: str = "") -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, '{by}'" + (")" if self.name == "spark" else ", 'g')")

    def part(self, x: str, p: str, group: int = 1) -> str:
        return f"regexp_extract({x}, {self.pattern(p)}, {group})"

    def count(self, x: str, p: str) -> str:
        return f"cast(size(regexp_extract_all({x}, {self.pattern(p)}, 0)) as bigint)" if self.name == "spark" else f"len(regexp_extract_all({x}, {self.pattern(p)}))"

    def words(self, x: str) -> str:
        """The words of an expression parted by single blanks; none of the empty text."""
        return f"filter(split({x}, ' '), w -> w <> '')" if self.name == "spark" else f"list_filter(string_split({x}, ' '), lambda w: w <> '')"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})" if self.name == "spark" else f"list_distinct({a})"

    def both(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})" if self.name == "spark" else f"list_intersect({a}, {b})"

    def size(self, a: str) -> str:
        return f"cast(size({a}) as bigint)" if self.name == "spark" else f"len({a})"

    def number(self, x: str) -> str:
        return f"try_cast({x} as double)"


SPARK, DUCK = Dialect("spark"), Dialect("duck")

# Vocabularies and the grammar of numbers.
BOOLEAN_TRUE, BOOLEAN_FALSE = ("true", "yes", "present", "positive"), ("false", "no", "absent", "negative")
NUMBER = r"[-+]?(?:[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
APPROX = r"^(?:~|≈|about(?:[^0-9a-z_]|$)|approx(?:\.|imately)?(?:[^0-9a-z_]|$))"
RANGE_SIGN = r"(?:to|-|–|—)"
WS = r"[ \t\n\r\f\x0b]+"
TITLE_TOKEN = r"[^0-9a-z]+"
DOI = r"(10\.[0-9]{4,9}/[^\s\x22<>]+)"


def tidy(x: str, d: Dialect = SPARK) -> str:
    """White space collapsed."""
    return f"trim({d.sub(x, WS, ' ')})"


def is_empty(x: str, d: Dialect = SPARK) -> str:
    return f"({x} is null or {tidy(x, d)} = '')"


def plain_text(x: str, d: Dialect = SPARK) -> str:
    """Lower case, all but ASCII letters and digits as single blanks; null if empty."""
    return f"case when not {is_empty(x, d)} then trim({d.sub(f'lower({tidy(x, d)})', TITLE_TOKEN, ' ')}) end"


def boolean_value(x: str, d: Dialect = SPARK) -> str:
    text = f"lower({tidy(x, d)})"
    listed = lambda v: ", ".join(f"'{i}'" for i in v)
    return f"case when {text} in ({listed((*BOOLEAN_TRUE, '1'))}) then true when {text} in ({listed((*BOOLEAN_FALSE, '0'))}) then false end"


def boolean_cue(x: str, d: Dialect = SPARK) -> str:
    words = "y|n|yes|no|true|false|present|absent|positive|negative|detected|undetected|reported|unreported|available|unavailable"
    return f"coalesce({d.has(f'lower({tidy(x, d)})', rf'(^[+-]$|\+/-|(^|[^0-9a-z_])({words})([^0-9a-z_]|$))')}, false)"


def is_approximate(x: str, d: Dialect = SPARK) -> str:
    return f"coalesce({d.has(f'lower({tidy(x, d)})', APPROX)}, false)"


def _bare(x: str, d: Dialect) -> str:
    """The text behind a word of approximation."""
    text = tidy(x, d)
    head = d.part(f"lower({text})", r"^(~|≈|approximately|approx\.|approx|about)")
    return f"trim(case when {is_approximate(x, d)} then substr({text}, length({head}) + 1) else {text} end)"


def is_interval(x: str, d: Dialect = SPARK) -> str:
    return f"coalesce({d.has(_bare(x, d), rf'^{NUMBER} *{RANGE_SIGN} *{NUMBER}$')}, false)"


def number_bounds(x: str, d: Dialect = SPARK) -> tuple[str, str]:
    """(lower, upper) of a number or an interval; null for all else."""
    bare = _bare(x, d)
    scalar = d.number(f"replace({d.part(bare, rf'^({NUMBER})$')}, ',', '')")
    left = d.number(f"replace({d.part(bare, rf'^({NUMBER}) *{RANGE_SIGN} *{NUMBER}$')}, ',', '')")
    right = d.number(f"replace({d.part(bare, rf'^{NUMBER} *{RANGE_SIGN} *({NUMBER})$')}, ',', '')")
    both = is_interval(x, d)
    return f"case when {both} then least({left}, {right}) else {scalar} end", f"case when {both} then greatest({left}, {right}) else {scalar} end"


def number_format(x: str, d: Dialect = SPARK) -> dict[str, str]:
    """Flags of the way a number is written."""
    t = f"coalesce({tidy(x, d)}, '')"
    ranged = d.has(t, rf"{NUMBER} *{RANGE_SIGN} *{NUMBER}")
    return {
        "numeric_tokens": d.count(t, NUMBER),
        "has_percent": d.has(t, "%"),
        "has_unit": d.has(t, rf"{NUMBER} *[A-Za-zµμ]+"),
        "has_inequality": d.has(t, "(<=|>=|<|>|≤|≥)"),
        "has_plus_minus": d.has(t, r"(±|\+/-)"),
        "range_like": ranged,
        "list_like": f"({d.count(t, NUMBER)} > 1 and {d.has(t, '[,;]')} and not {ranged})",
    }


def list_cue(x: str, d: Dialect = SPARK) -> str:
    plain = plain_text(x, d)
    return f"(coalesce({d.has(f'lower({tidy(x, d)})', r'([,;/|]|(^|[^0-9a-z_])and([^0-9a-z_]|$))')}, false) and coalesce({d.size(d.words(plain))}, 0) > 1)"


def doi_of(x: str, d: Dialect = SPARK) -> str:
    """The bare lower-case DOI inside a text or address, without closing punctuation; null if none."""
    found = d.part(f"lower(coalesce({x}, ''))", DOI)
    return f"nullif({d.sub(found, r'[.,;)\]]+$')}, '')"


def first_surname(x: str, d: Dialect = SPARK) -> str:
    """Family name of the first of several authors ('Family, Given' or 'Given Family'), in plain text; null if none."""
    first = tidy(d.part(f"coalesce({x}, '')", r"^([^;|\n&]*)"), d)
    last = d.part(d.sub(first, r" +(jr|Jr|sr|Sr|II|III|IV)\.?$"), r"([^ ]+)$")
    return f"nullif(case when {d.has(first, ',')} then trim({d.part(first, '^([^,]*)')}) else {last} end, '')"


def stable_id(prefix: str, *parts: str, length: int = 12, d: Dialect = SPARK) -> str:
    """``prefix_`` and the first digits of the SHA-256 of the parts joined by '::'."""
    joined = "concat_ws('::', " + ", ".join(f"cast({p} as {'string' if d.name == 'spark' else 'varchar'})" for p in parts) + ")"
    digest = f"sha2({joined}, 256)" if d.name == "spark" else f"sha256({joined})"
    return f"concat('{prefix}_', substr({digest}, 1, {length}))"


def round6(x: str) -> str:
    """Six places, by the same operations in every engine."""
    return f"floor(({x}) * 1000000 + 0.5) / 1000000"


def ratio(a: str, b: str) -> str:
    return f"case when {b} > 0 then {round6(f'cast({a} as double) / {b}')} end"
