"""Text lines of HTML and the host and path of URLs, as JVM expressions with SQL twins.

Comments, scripts and styles go; block tags end a line, other tags vanish; common
entities are decoded; white space is collapsed; empty lines are dropped.  What a page
leaves open (a comment, script, style or tag) ends with the page and goes whole.  For that
``END`` closes all of them behind the page, so that no pattern ever looks in vain for an
end and a page of any signs takes time in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that Java and RE2 read alike.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
BLOCK = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>"
TAG = r"<[^>]*>"
#: Ends whatever a page leaves open; gives no text itself.
END = "<!-- --></script></style>"
BLANKS = "[ \\t\\r\\f ]+"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"))
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def trimmed_lines(text: Column) -> Column:
    """The non-empty lines of ``text`` with white space collapsed; null for a null."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, BLANKS, " ")))
    return F.filter(lines, lambda x: x != "")


def html_lines(html: Column) -> Column:
    """The text lines of a page; null for a null."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.concat(html, F.lit(END)), HIDDEN, " "), BLOCK, "\n"), TAG, "")
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return trimmed_lines(text)


def host(url: Column) -> Column:
    """The lower-case host of an absolute URL, else null."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def path(url: Column) -> Column:
    """The path of an absolute URL without query and fragment."""
    return F.regexp_extract(url, PATH, 1)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_lines(html: str) -> str:
    """DuckDB for :func:`html_lines` of the expression ``html``."""
    text = f"regexp_replace(regexp_replace(regexp_replace({html} || {_quoted(END)}, {_quoted(HIDDEN)}, ' ', 'g'), {_quoted(BLOCK)}, chr(10), 'g'), {_quoted(TAG)}, '', 'g')"
    for name, sign in ENTITIES:
        text = f"replace({text}, {_quoted(name)}, {_quoted(sign)})"
    return f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(regexp_replace(x, {_quoted(BLANKS)}, ' ', 'g'))), lambda x: x <> '')"


def sql_host(url: str) -> str:
    """DuckDB for :func:`host`."""
    return f"nullif(lower(regexp_extract({url}, {_quoted(HOST)}, 1)), '')"
