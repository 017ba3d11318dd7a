"""Text expressions (X10/T1 cleanup, HTML extraction hook, letter-count
embedding). Regex classes are spelled so Java's regex and RE2 read them the
same way, which keeps the Spark form and the SQL oracle identical."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import _c

# The characters Python's str.isspace() accepts (str.strip set).
PY_WHITESPACE_CLASS = (r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                       r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# OCR replacements of the cleanup step, in order.
OCR_REPLACEMENTS = [("ﬁ", "fi"), ("ﬂ", "fl"), ("–", "-"), ("—", "-")]
# HTML entities decoded by the default extractor.
HTML_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
# Sentence delimiters of the chunker, in priority order.
SENTENCE_DELIMITERS = [". ", ".\n", "! ", "!\n", "? ", "?\n"]


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace.
    The match runs to the text's end and steps back to the last other
    character, so the whitespace within the text is not tried."""
    ws = PY_WHITESPACE_CLASS
    return F.regexp_extract(_c(c), rf"(?s)\A{ws}*+(.*[^{ws[1:]})", 1)


def clean_text(c) -> Column:
    """Collapse 3+ newlines to 2, runs of spaces to one, drop
    page-number lines, fix ligatures and long dashes, strip."""
    x = F.regexp_replace(_c(c), r"\n{3,}", "\n\n")
    x = F.regexp_replace(x, r" {2,}", " ")
    x = F.regexp_replace(x, r"\n\p{Nd}+\n", "\n")
    for a, b in OCR_REPLACEMENTS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return py_strip(x)


def html_to_text(c) -> Column:
    """Default extractor hook for HTML pages (S12): drop script, style and
    comments, turn block ends into newlines, drop tags, decode entities."""
    x = F.regexp_replace(_c(c), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
    x = F.regexp_replace(x, r"(?i)<br\s*/?>|</(p|div|h[1-6]|li|tr|article|section|title)>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for a, b in HTML_ENTITIES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def letter_counts(c, alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """T11 built-in embedder: per-letter counts of the lower-cased text as an
    array<float> (exact integers, so distances are exact in any engine).
    One ``length - length(replace)`` per letter: all JVM-side."""
    low = F.lower(_c(c))
    n = F.length(low)
    return F.array(*[(n - F.length(F.replace(low, F.lit(ch), F.lit("")))).cast("float") for ch in alphabet])
