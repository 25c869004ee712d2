"""Texts on their way out: to a terminal, one line, a YAML value, a LIKE pattern, a fixed width."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a terminal acts on, or that hide or reorder what is around them; the tab and the two joiners may stay.
ACTS = r"[\x{00}-\x{08}\x{0A}-\x{1F}\x{7F}-\x{9F}\x{061C}\x{200B}\x{200E}\x{200F}\x{2028}-\x{202E}\x{2060}-\x{2069}\x{FEFF}\x{E0000}-\x{E007F}]"
#: The same without the line feed.
ACTS_IN_LINES = ACTS.replace(r"\x{0A}", r"\x{0B}")
_BLANKS = r"[\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def terminal(text: Column) -> Column:
    """One line for a terminal: U+FFFD for each character that it could act on, line breaks among them."""
    return F.regexp_replace(text, ACTS, "�")


def terminal_lines(text: Column) -> Column:
    """As ``terminal``, but line feeds stay."""
    return F.regexp_replace(text, ACTS_IN_LINES, "�")


def quoted(text: Column) -> Column:
    """``terminal`` in double quotes, quotes and backslashes inside escaped."""
    return F.concat(F.lit('"'), F.regexp_replace(terminal(text), r'(["\\])', r"\\$1"), F.lit('"'))


def one_line(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{_BLANKS}+", " "))


def body_text(text: Column) -> Column:
    """Text of a record's body: other line breaks become line feeds (CR LF stays), control characters but the tab go, ends are trimmed."""
    broken = F.regexp_replace(text, r"\r(?!\n)|[\x{85}\x{2028}\x{2029}]", "\n")
    plain = F.regexp_replace(broken, r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{FEFF}]", "")
    return F.regexp_replace(plain, f"^{_BLANKS}+|{_BLANKS}+\\z", "")


def yaml_value(text: Column) -> Column:
    """In double quotes only if a colon, a quote or a line feed asks for it."""
    return F.when(text.rlike('[:"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(text)


def like_escaped(text: Column) -> Column:
    """Backslash, % and _ as plain characters of a LIKE pattern."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def cut(text: Column, n: int) -> Column:
    """At most ``n`` UTF-16 units, no pair of them split; null is empty."""
    units = F.encode(F.coalesce(text, F.lit("")), "UTF-16BE")
    whole = F.substring(units, 1, 2 * n)
    split = F.hex(F.substring(whole, 2 * n - 1, 1)).between("D8", "DB") if n else F.lit(False)
    return F.decode(F.when(split, F.substring(units, 1, 2 * n - 2)).otherwise(whole), "UTF-16BE")


def clip(text: Column, n: int) -> Column:
    """``cut`` with an ellipsis inside the ``n`` units where something is cut off."""
    long = F.octet_length(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE")) > 2 * n
    return F.when(long, F.concat(cut(text, max(n - 1, 0)), F.lit("…"))).otherwise(cut(text, n))
