"""Text expressions with Unicode white space and digits, all inside the JVM."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators U+001C to U+001F that Java leaves out.
SPACE = r"[\s\x1c-\x1f]"
#: The same characters, one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Where :func:`lines` cuts.
BREAK = r"[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"
APPENDIX = rf"(?U)^Appendix{SPACE}+([A-Z])\.{SPACE}+(\S.*)$"
NUMBERED = rf"(?U)^([A-Z](?:[.]\d+)*|(?:\d+[.])*\d+)[.]{SPACE}+(\S.*)$"
FIGURE = r"(?U)^Figure\s+\d+(-\d+)*\.\s+\S"
FOOTNOTE = r"(?U)^Footnote\s+\d+\s*[-—]\s*\S"
LINK = r"https?://\S+"
CALLOUT = r"^[A-Z][A-Z]+(-[A-Z0-9./]+)+(\s|$)"
PAGE_LABEL = r"(?Ui)((?:printed\s+)?page|front\s+matter)\s+(\d+|[a-z]+-\d+|[ivxlcdm]+)\s*$"
SENTENCE_GAP = r"(?U)(?<=[.!?])(\s+)"


def strip(text: Column) -> Column:
    """Without white space at both ends; the characters one by one, as a pattern is tried at every place of a text."""
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """Every run of white space one blank, none at the ends. Single blanks are no match, so most texts stay as they are."""
    return F.trim(F.regexp_replace(text, rf"(?U)[{SPACE[1:-1]}&&[^ ]]{SPACE}*| {SPACE}+", " "))


def folded(text: Column) -> Column:
    """Collapsed and lower case. Lower case stands for case folding: it leaves ß as it is."""
    return F.lower(collapse(text))


def lines(text: Column) -> Column:
    """The stripped, non-empty lines."""
    return F.filter(F.transform(F.split(text, r"\R|[\x1c-\x1e]"), strip), lambda x: x != "")


def heading_number(text: Column) -> Column:
    """The number of a heading line (digits or a letter, dotted), or null."""
    found = strip(text)
    return F.coalesce(F.nullif(F.regexp_extract(found, APPENDIX, 1), F.lit("")), F.nullif(F.regexp_extract(found, NUMBERED, 1), F.lit("")))


def heading_title(text: Column) -> Column:
    """The title of a heading line, or null."""
    found = strip(text)
    return F.coalesce(F.nullif(F.regexp_extract(found, APPENDIX, 2), F.lit("")), F.nullif(F.regexp_extract(found, NUMBERED, 2), F.lit("")))


def heading_level(number: Column) -> Column:
    """One more than the number has dots."""
    return (F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1).cast("int")


def block_type(text: Column, observed: Column) -> Column:
    """The kind of a block from its text and what its parser called it; the first rule that fits holds."""
    bare = strip(text)
    return (
        F.when(observed.isin("page_header", "page_footer"), observed)
        .when(heading_number(text).isNotNull(), "heading")
        .when(bare.rlike(FIGURE), "caption")
        .when(bare.rlike(FOOTNOTE), "footnote")
        .when(text.rlike(LINK), "url")
        .when(observed.isin("table", "figure", "caption", "footnote"), observed)
        .when(observed.isin("list", "list_item") | bare.startswith("•"), "list")
        .when(bare.rlike(CALLOUT), "callout")
        .otherwise("paragraph")
    )


def margin_text(text: Column) -> Column:
    """Margin text with a page label at its end replaced by a mark."""
    return F.regexp_replace(collapse(text), PAGE_LABEL, "<page-label>")


def page_label(text: Column) -> Column:
    """The page label at the end of margin text, or null."""
    return F.nullif(F.regexp_extract(collapse(text), PAGE_LABEL, 2), F.lit(""))


def first_sentence(text: Column) -> Column:
    """Up to the first sentence end, else all."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?Us)^(.*?[.!?])(?=\s|$)", 1), F.lit("")), text)


def caption_head(text: Column) -> Column:
    """What stands before the first dash between blanks."""
    return F.get(F.split(strip(text), r"(?U)\s+[-—]\s+", 2), F.lit(0))


def visible_link(text: Column, target: Column) -> Column:
    """The words of a block that show a link: the target if it is written out, else what follows the last colon, else all."""
    return F.when(F.contains(text, target), target).when(F.contains(text, F.lit(": ")), F.substring_index(text, ": ", -1)).otherwise(text)


def document_id(sha256: Column, asset_id: Column, run_id: Column) -> Column:
    """The id of a document in a run, from its hash, its asset and the run."""
    return F.concat(F.lit("pdf-"), F.substring(sha256, 1, 12), F.lit("-"), F.substring(asset_id, 5, 8), F.lit("-"), F.substring(run_id, 1, 8))


def is_date(text: Column) -> Column:
    """Whether a text is a real date of the form year-month-day."""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull()


def public_source(url: Column, retrieved_on: Column) -> Column:
    """Whether evidence names a public web address, without user or password and not of the own network, and a real date.

    Addresses in digits count as public unless they are of a range set apart.
    """
    host = F.lower(F.regexp_extract(url, r"^(?i:https?)://([^/?#@:]+)(?::\d+)?(?:[/?#].*)?$", 1))
    number = r"^(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2\d|3[01])|22[4-9]|2[3-5]\d)\."
    public = (host != "") & (host != "localhost") & ~host.endswith(".local") & ~(host.rlike(r"^\d+(?:\.\d+){3}$") & host.rlike(number))
    return F.coalesce(public & is_date(retrieved_on), F.lit(False))


def hex_of(name: str) -> str:
    """A short name for a folder, made of a longer one."""
    return hashlib.sha256(name.encode()).hexdigest()[:32]


def stable_id(*parts: Column) -> Column:
    """16 hexadecimal signs of the SHA-256 of the parts, a null being empty."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def inline_table(text: Column) -> Column:
    """Where a block of lines turns from a three-column table into prose: the number of table lines, or null.

    Cut places are tried from the last line backwards; rows of three begin at line 3.
    At most three prose lines follow, beginning in upper case and holding a sentence
    end, and no sentence ends in the first two cells of a row.  A text without a line
    break is not looked at any further.
    """
    rows = lines(text)
    end = r"[.!?](\s|$)"

    def fits(at: Column) -> Column:
        prose = F.array_join(F.slice(rows, at + 1, F.size(rows)), " ")
        cells = F.slice(F.transform(rows, lambda x, i: (i >= 3) & (i < at) & ((i % 3) < 2) & x.rlike(end)), 1, F.greatest(at, F.lit(1)))
        first = F.substring(prose, 1, 1)
        return (F.size(rows) - at <= 3) & first.rlike(r"(?U)^\p{Lu}") & prose.rlike(end) & ~F.exists(cells, lambda x: x)

    tried = F.filter(F.sequence(F.size(rows) - 1, F.lit(6), F.lit(-1)), lambda at: at % 3 == 0)
    return F.when(text.rlike(BREAK) & (F.size(rows) >= 7), F.get(F.filter(tried, fits), F.lit(0)))
