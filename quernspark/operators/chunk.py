"""Chunking: one document, many chunks."""

from __future__ import annotations

import re
from collections import deque
from html.parser import HTMLParser

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Sizes in tokens, and separators from the best boundary to the worst.
SIZE, OVERLAP, LEAST, LEAST_SECTION = 512, 50, 100, 10
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", " ", "")
SENTENCE_SEPARATORS = (". ", "? ", "! ", "; ", ", ", " ", "")
BATCH_TOKENS = 25_000
_TOKEN = regex.compile(T.TOKEN.replace("IsWhite_Space", "White_Space"))


def n_tokens(text: str) -> int:
    """functions.text.count_tokens for Python workers."""
    return len(_TOKEN.findall(text))


def pieces(text: str, size: int, separators: tuple[str, ...], count=n_tokens) -> list[str]:
    """Pieces of at most size tokens whose concatenation is text; a separator opens the piece after it."""
    if count(text) <= size:
        return [text]
    sep, rest = next((s, separators[i + 1 :]) for i, s in enumerate(separators) if s == "" or s in text)
    parts = list(text) if sep == "" else [p for p in re.split(f"(?={re.escape(sep)})", text) if p]
    return parts if sep == "" else [x for p in parts for x in pieces(p, size, rest, count)]


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators=SEPARATORS, count=n_tokens) -> list[str]:
    """Merge pieces up to size; the next chunk begins with up to overlap tokens of the last one."""
    out, window, held = [], deque(), 0
    for piece in pieces(text, size, tuple(separators), count):
        n = count(piece)
        if window and held + n > size:
            out.append("".join(p for p, _ in window).strip())
            while window and (held > overlap or held + n > size):
                held -= window.popleft()[1]
        window.append((piece, n))
        held += n
    out.append("".join(p for p, _ in window).strip())
    return [c for c in out if c]


def chunk_documents(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, key: str = "source", text: str = "text", tokens=None) -> DataFrame:
    """(key, title if there, chunk_id, pos, text): numbered after chunks below least tokens are dropped.

    By the table function chunk_text; tokens is its hook for token counts.
    """
    from . import table_functions as tf

    split = tf.text_chunks(size, overlap, least, tokens or tf.stand_in)
    keep = [c for c in docs.columns if c not in (text, "pos", "chunk_id")]
    rows = docs.select(*keep, F.col(text).alias("__whole")).lateralJoin(split(F.col("__whole").outer())).drop("__whole")
    return rows.withColumn("chunk_id", F.concat_ws("::", F.col(key).cast("string"), F.col("pos").cast("string")))


class _Sections(HTMLParser):
    """Collects the text of sections by class, with headings and signatures, as a page is read."""

    KINDS = ("class-description", "constructor-summary", "method-summary", "detail")
    SKIP = ("script", "style", "nav", "header", "footer")
    VOID = ("br", "hr", "img", "input", "link", "meta", "col", "wbr", "area", "base", "source", "embed")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found, self.all, self.main, self.has_main = [], [], [], [], False

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        names = dict(attrs)
        classes = (names.get("class") or "").split()
        kind = next((k for k in self.KINDS if k in classes), None) if tag == "section" else None
        section = None
        if kind:
            section = {"kind": kind, "id": names.get("id") or "", "text": [], "heading": None, "signature": None}
            self.found.append(section)
        self.has_main |= tag == "main"
        self.open.append({"tag": tag, "section": section, "heading": None, "signature": None})
        inner = self._section()
        if inner and tag in ("h2", "h3", "h4") and inner["heading"] is None:
            self.open[-1]["heading"] = inner["heading"] = []
        if inner and tag == "div" and "member-signature" in classes and inner["signature"] is None:
            self.open[-1]["signature"] = inner["signature"] = []

    def handle_endtag(self, tag):
        if any(o["tag"] == tag for o in self.open):
            while self.open.pop()["tag"] != tag:
                pass

    def _section(self):
        return next((o["section"] for o in reversed(self.open) if o["section"]), None)

    def handle_data(self, data):
        tags = [o["tag"] for o in self.open]
        if any(t in self.SKIP for t in (tags[tags.index("main") :] if "main" in tags else tags)):
            return
        self.all.append(data)
        if "main" in tags:
            self.main.append(data)
        for o in self.open:
            for into in (o["section"]["text"] if o["section"] else None, o["heading"], o["signature"]):
                if into is not None:
                    into.append(data)


def _flat(parts) -> str:
    return " ".join(" ".join(parts or ()).split())


def page_sections(html: str, name: str) -> list[tuple[str, str, str, str]]:
    """(kind, member, header, body): class description, summaries, then members; else the whole page."""
    reader = _Sections()
    reader.feed(html)
    reader.close()
    out = []
    for kind in (("class-description",), ("constructor-summary", "method-summary"), ("detail",)):
        for s in (s for s in reader.found if s["kind"] in kind):
            member = _flat(s["heading"]) or s["id"] if s["kind"] == "detail" else ""
            if s["kind"] == "detail":
                signature = _flat(s["signature"])
                header, label = f"{name} - Member: {member}" + (f"\n{signature}" if signature else ""), "member"
            else:
                title = "Class description" if s["kind"] == "class-description" else s["kind"].replace("-", " ").title()
                header, label = f"{name} - {title}", s["kind"]
            out.append((label, member, header, _flat(s["text"])))
    out = [x for x in out if x[3]]
    return out or [("page", "", name, _flat(reader.main if reader.has_main else reader.all))]


def with_header(header: str, body: str, size: int = SIZE, least: int = LEAST_SECTION, count=n_tokens) -> list[str]:
    """The body under its header; only a body beyond the header's budget is split (at size)."""
    if not body.strip():
        return []
    fits = count(body) <= size - count(header) - 2
    made = [f"{header}\n\n{p}" for p in ([body] if fits else split_text(body, size, OVERLAP, SENTENCE_SEPARATORS, count))]
    return [m for m in made if count(m) >= least]


def chunk_sections(pages: DataFrame, key: str = "source", html: str = "html", tokens=None) -> DataFrame:
    """(key, title if there, chunk_id, pos, kind, member, text) of HTML pages, numbered by page. Markdown files (by name)
    are one section. By the table function chunk_page."""
    from . import table_functions as tf

    kept = [c for c in (key, "title") if c in pages.columns]
    named = pages.select(*kept, F.col(key).cast("string").alias("__name"), F.col(html).alias("__page"))
    rows = named.lateralJoin(tf.page_chunks(tokens=tokens or tf.stand_in)(F.col("__name").outer(), F.col("__page").outer()))
    return rows.select(*kept, F.concat_ws("::", F.col(key).cast("string"), F.col("pos").cast("string")).alias("chunk_id"), "pos", "kind", "member", "text")


def token_batches(chunks: DataFrame, budget: int = BATCH_TOKENS, text: str = "text", by: str = "source", order: str = "pos") -> DataFrame:
    """(by, order, n_tokens, batch) of chunks: batches of each source, filled greedily in order up to budget tokens.

    The table function goes through a source's rows in one pass, without their texts; join it by (by, order).
    """
    from .table_functions import filled

    slim = chunks.select(F.col(by).alias("part"), F.col(order).alias("at"), T.count_tokens(F.col(text)).cast("long").alias("n_tokens"))
    return filled(slim, budget).select(F.col("part").alias(by), F.col("at").alias(order), "n_tokens", "batch")


def chunk_stats(chunks: DataFrame, by: str) -> DataFrame:
    n = T.count_tokens(F.col("text"))
    return chunks.groupBy(by).agg(F.count("*").alias("chunks"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"))


def top_sources(chunks: DataFrame, n: int = 5) -> DataFrame:
    return chunks.groupBy("source").agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "source").limit(n)


def mid_sentence_ratio(chunks: DataFrame, by: str) -> DataFrame:
    return chunks.groupBy(by).agg(F.round(F.avg(T.starts_mid_sentence(F.col("text")).cast("int")), 6).alias("ratio"), F.count("*").alias("n"))


def window_chunks(docs: DataFrame, size: int = 200, overlap: int = 50, key: str = "doc_id") -> DataFrame:
    """Word windows by built-in functions alone: (key, pos, text)."""
    words = F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")
    step = size - overlap
    starts = lambda n: F.sequence(F.lit(0), F.greatest(F.ceil((n - overlap) / step).cast("int") - 1, F.lit(0)))
    rows = docs.select(key, words.alias("w")).where(F.size("w") > 0)
    rows = rows.select(key, "w", F.explode(starts(F.size("w"))).alias("pos"))
    return rows.select(key, "pos", F.array_join(F.slice("w", F.col("pos") * step + 1, F.lit(size)), " ").alias("text"))
