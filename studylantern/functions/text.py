"""Text expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\{\{\s*([A-Za-z_][\w.]*)\s*\}\}")

# --- fixed values: whitespace and emphasis patterns --------------------------
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
BOLD = r"(?d)\*\*(.+?)\*\*"
ITALIC = r"(?d)(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)"


def strip(c: Column) -> Column:
    """Remove all leading and trailing white space (``trim`` removes blanks only)."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def first_truthy(*cols: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def flag_code(reason: Column) -> Column:
    """Code in front of the first colon; null when there is no colon."""
    return F.when(F.contains(reason, F.lit(":")), strip(F.substring_index(reason, ":", 1)))


def tokens(template: str) -> set[str]:
    """Names of the ``{{ name }}`` tokens of a template."""
    return set(_TOKEN.findall(template))


def fill(template: str, fields: dict[str, Column]) -> Column:
    """Replace the ``{{ name }}`` tokens of a constant template by columns.

    The template is cut once, on the driver; the result is a single ``concat``.
    An unknown token raises at plan time. A null field makes the result null.
    """
    unknown = tokens(template) - fields.keys()
    if unknown:
        raise ValueError(f"template uses unknown fields: {sorted(unknown)}")
    pieces = _TOKEN.split(template)
    # split() alternates literal text and captured token names
    parts = [F.lit(p) if i % 2 == 0 else fields[p].cast("string") for i, p in enumerate(pieces) if i % 2 or p]
    return F.concat(*parts) if parts else F.lit("")


def text_to_html(c: Column) -> Column:
    """Light markup to HTML paragraphs: bold, italics, blank-line separated blocks."""
    marked = F.regexp_replace(c, BOLD, "<strong>$1</strong>")
    marked = F.regexp_replace(marked, ITALIC, "<em>$1</em>")
    blocks = F.transform(F.split(marked, "\n\n"), strip)
    return F.array_join(
        F.transform(F.filter(blocks, lambda b: b != ""), lambda b: F.concat(F.lit("<p>"), b, F.lit("</p>"))), "\n"
    )


def digest_uuid(*cols: Column) -> Column:
    """UUID-shaped id from the MD5 of the parts, so that a re-run yields the same id."""
    h = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    return F.concat_ws("-", *[F.substring(h, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def stable_bucket(c: Column, n: Column) -> Column:
    """Deterministic bucket 0..n-1 of a text key."""
    return (F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long") % n).cast("int")
