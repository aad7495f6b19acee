"""Text expressions whose limits count UTF-8 bytes and whose white space is Unicode's."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool.functions.urls import SPACE

#: Terminal escapes: control sequences, operating system commands, two-character ones.
CSI, OSC, ESCAPE = "\x1b\\[[^@-~]*(?:[@-~]|$)", "\x1b\\][^\x07\x1b]*(?:\x07|\x1b\\\\|(?=\x1b)|$)", "(?s)\x1b.?"


#: The same white space as a set of characters.
WHITE = "".join(chr(c) for c in range(0x3001) if re.match(SPACE, chr(c)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def collapse_whitespace(text: Column) -> Column:
    return trim(F.regexp_replace(text, f"{SPACE}+", " "))


def sanitize_terminal(text: Column) -> Column:
    """Without terminal escapes and control characters other than line feeds and tabs; carriage returns become line feeds."""
    for pattern in (OSC, CSI, ESCAPE):
        text = F.regexp_replace(text, pattern, "")
    return F.regexp_replace(F.regexp_replace(text, "\r", "\n"), r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", "")


def sanitize_metadata(text: Column) -> Column:
    return collapse_whitespace(F.regexp_replace(sanitize_terminal(text), "�", ""))


def lines(text: Column) -> Column:
    """Lines without their ends; a last empty one is none."""
    parts = F.split(text, "\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


#: The first line that is text, from its first character that is no space.
_PARAGRAPH = r"(?:^|\n)[\t\x0b-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*+(?!#|!\[|\[|\||```|---)([^\n]+)"


def first_paragraph(markdown: Column) -> Column:
    """The first line that is text: no heading, image, link, table, fence or rule. The search ends with it."""
    return trim(F.regexp_extract(markdown, _PARAGRAPH, 1))


def truncated(text: str, most: int) -> str:
    """text if it has at most so many bytes; else cut between characters, back to a space in the second half, and an ellipsis."""
    data = text.encode()
    if len(data) <= most:
        return text
    cut = data[:most].decode(errors="ignore").encode()
    space = cut.rfind(b" ")
    if space > len(cut) // 2:
        cut = cut[:space]
    return cut.decode() + "…"


def truncate_summary(text: Column, most: int) -> Column:
    """The same as an expression, all of it inside the JVM."""

    def cut_off(t: Column) -> Column:
        head = F.substring(t, 1, most)
        fits = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(most)), lambda n: F.octet_length(F.substring(head, F.lit(1), n)) <= most))
        cut = F.when(F.octet_length(head) <= most, head).otherwise(F.substring(head, F.lit(1), fits))

        def at_space(c: Column) -> Column:
            before = F.substring(c, F.lit(1), F.length(c) - F.locate(" ", F.reverse(c)))  # what stands before the last space
            far = (F.locate(" ", c) > 0) & (F.octet_length(before) > F.floor(F.octet_length(c) / 2))
            return F.concat(F.when(far, before).otherwise(c), F.lit("\u2026"))

        return let(cut, at_space)

    return let(text, lambda t: F.when(F.octet_length(t) <= most, t).otherwise(cut_off(t)))


def description(stated: Column, markdown: Column, most: int = 150, least: int = 20) -> Column:
    """A page's own description, or its first paragraph if that is too short, or nothing."""
    chosen = let(first_paragraph(markdown), lambda first: F.when(F.octet_length(stated) >= least, stated).when(F.octet_length(first) >= least, first).otherwise(F.lit("")))
    return truncate_summary(chosen, most)


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attribute(text: Column) -> Column:
    return F.replace(escape_html(text), F.lit('"'), F.lit("&quot;"))


def sanitized(text: str) -> str:
    """sanitize_metadata for one string."""
    for pattern in (OSC, CSI, ESCAPE):
        text = re.sub(pattern, "", text)
    text = re.sub(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", "", text.replace("\r", "\n")).replace("�", "")
    return re.sub(f"^{SPACE}+|{SPACE}+$", "", re.sub(f"{SPACE}+", " ", text))
