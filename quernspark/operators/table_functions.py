"""Chunking and batching as table functions, for SQL as for DataFrames.

    register(spark)
    SELECT d.doc_id, c.* FROM documents d, LATERAL chunk_text(d.text) c
    SELECT p.page_id, c.* FROM pages p, LATERAL chunk_page('name', p.html) c
    SELECT * FROM token_batches(TABLE(SELECT source AS part, doc_id AS at, n_tokens FROM t) PARTITION BY part ORDER BY (at), 25000)

A token count is a hook: a factory that makes a function of a text, once a worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk
from .models import once


def stand_in() -> Callable[[str], int]:
    return chunk.n_tokens


class FileTokens:
    """A factory of exact counts by a vocabulary file of byte pairs and their merges, as the tokenizers library reads it."""

    def __init__(self, path: str):
        self.path, self.__module__, self.__qualname__ = path, __name__, f"FileTokens:{path}"

    def __call__(self) -> Callable[[str], int]:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        return lambda text: len(made.encode(text, add_special_tokens=False).ids)


def text_chunks(size: int = chunk.SIZE, overlap: int = chunk.OVERLAP, least: int = chunk.LEAST, tokens: Callable = stand_in):
    """chunk_text(text): (pos, text) of each chunk of at least least tokens."""

    class ChunkText:
        def eval(self, text: str):
            count = once(tokens)
            kept = [c for c in chunk.split_text(text or "", size, overlap, count=count) if count(c) >= least]
            yield from enumerate(kept)

    return F.udtf(ChunkText, returnType="pos int, text string")


def page_chunks(size: int = chunk.SIZE, least: int = chunk.LEAST_SECTION, tokens: Callable = stand_in):
    """chunk_page(name, page): (pos, kind, member, text); a name that ends in .md is one section."""

    class ChunkPage:
        def eval(self, name: str, page: str):
            count = once(tokens)
            stem = name.rsplit(".", 1)[0] if name and name.endswith((".html", ".md")) else name or ""
            found = [("page", "", stem, (page or "").strip())] if (name or "").endswith(".md") else chunk.page_sections(page or "", stem)
            made = [(k, m, t) for k, m, header, body in found for t in chunk.with_header(header, body, size, least, count)]
            for pos, row in enumerate(made):
                yield (pos, *row)

    return F.udtf(ChunkPage, returnType="pos int, kind string, member string, text string")


class Fill:
    """Rows (part, at, n_tokens) of one part, in order: a batch is filled up to budget tokens and has one row at least.

    The running sum starts again at every batch; a row is handed on as it comes.
    """

    def __init__(self):
        self.number, self.held = 0, 0

    def eval(self, row, budget: int):
        n = row["n_tokens"] or 0
        if self.held and self.held + n > budget:
            self.number, self.held = self.number + 1, 0
        self.held += n
        yield row["part"], row["at"], n, self.number


def filled(rows: DataFrame, budget: int) -> DataFrame:
    """rows (part, at, n_tokens) with batch, numbered from 0 in each part; the same on every layout of the rows."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    fill = F.udtf(Fill, returnType=f"part {kinds['part']}, at {kinds['at']}, n_tokens long, batch int")
    return fill(rows.select("part", "at", "n_tokens").asTable().partitionBy("part").orderBy("at"), F.lit(budget))


def register(spark: SparkSession, tokens: Callable = stand_in) -> None:
    spark.udtf.register("chunk_text", text_chunks(tokens=tokens))
    spark.udtf.register("chunk_page", page_chunks(tokens=tokens))
    spark.udtf.register("token_batches", F.udtf(Fill, returnType="part string, at long, n_tokens long, batch int"))
