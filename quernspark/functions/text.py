"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The refusal text, the separators of the splitters, and the prompt's parts.
REFUSAL = "insufficient context"
BLANK = r"(?U)\s+"
TOKEN = r"\p{L}+|\p{N}+|[^\p{IsWhite_Space}\p{L}\p{N}]"
_GONE = ("script", "style", "nav", "header", "footer")
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"))


def _decoded(text: Column) -> Column:
    for name, value in _ENTITIES:  # &amp; last, so that nothing is decoded twice
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def known_references(html: Column) -> Column:
    """html for a parser that knows more references than _decoded does: every other & stands for itself (as in a cut "&amp")."""
    names = "|".join(name[1:-1] for name, _ in _ENTITIES)
    return F.regexp_replace(F.replace(html, F.lit("&nbsp;"), F.lit(" ")), f"&(?!(?:{names});)", "&amp;")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _body(html: Column) -> Column:
    """The <main> element if there is one, else the page; without comments and the parts that are not content."""
    main = F.regexp_extract(html, r"(?is)<main\b[^>]*>(.*)</main\s*>", 1)
    body = F.when(main == "", html).otherwise(main)
    body = F.regexp_replace(body, r"(?s)<!--.*?-->|<![^>]*>", "")
    for tag in _GONE:
        body = F.regexp_replace(body, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return body


def html_title(html: Column, default: Column) -> Column:
    title = _trimmed(_decoded(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)))
    return F.when(title == "", default).otherwise(title)


def html_text(html: Column) -> Column:
    """Tags become line ends; lines are trimmed, and empty ones dropped."""
    lines = F.split(_decoded(F.regexp_replace(_body(html), r"<[^>]*>", "\n")), "\n")
    return F.array_join(F.filter(F.transform(lines, _trimmed), lambda x: x != ""), "\n")


def html_flat(html: Column) -> Column:
    """Tags become blanks, so that sentences stay whole."""
    return _trimmed(F.regexp_replace(_decoded(F.regexp_replace(_body(html), r"<[^>]*>", " ")), BLANK, " "))


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def count_tokens(text: Column) -> Column:
    """A stand-in for a subword count: words, numbers and single marks."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def norm_blanks(text: Column) -> Column:
    return F.lower(_trimmed(F.regexp_replace(text, BLANK, " ")))


def is_refusal(answer: Column) -> Column:
    return F.coalesce(F.lower(_trimmed(answer)).startswith(REFUSAL), F.lit(False))


def context_block(chunks: Column) -> Column:
    """Of an array of structs with source and text, in rank order."""
    one = lambda c, i: F.concat(F.lit("[Passage "), (i + 1).cast("string"), F.lit(" | source: "), F.coalesce(c["source"], F.lit("unknown")), F.lit("]\n"), c["text"])
    return F.array_join(F.transform(chunks, one), "\n\n")


def prompt(system: str, context: Column, question: Column) -> Column:
    return F.concat(F.lit(system + "\n\nCONTEXT:\n"), context, F.lit("\n\nQUESTION: "), question, F.lit("\n\nANSWER:"))


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def percentile(value: Column, p: float) -> Column:
    return F.coalesce(F.percentile(value, F.lit(p)), F.lit(0.0))


def sources_set(sources: Column) -> Column:
    return F.array_sort(F.collect_set(F.coalesce(sources, F.lit("unknown"))))


def reference(answer: Column, passage: Column) -> Column:
    return _trimmed(F.concat_ws(" ", answer, passage))


def starts_mid_sentence(chunk: Column) -> Column:
    """After the header, i.e. after the first empty line, if there is one."""
    at = F.instr(chunk, "\n\n")
    body = F.when(at > 0, F.substr(chunk, at + F.lit(2))).otherwise(chunk)
    return F.regexp_replace(body, r"(?U)^\s+", "").rlike(r"^\p{IsLowercase}")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, BLANK), lambda x: x != ""))


def golds_shown(golds: Column, field: str) -> Column:
    """A field of all accepted golds as one text."""
    return F.array_join(F.transform(golds, lambda g: g[field]), " | ")


def metric_column(columns: list[str], name: str) -> str:
    found = [c for c in columns if name in c]
    if not found:
        raise KeyError(name)
    return found[0]
