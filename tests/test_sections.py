"""An index of sections, the page parser against SQL, and chunks against a plain splitter."""

from quernspark import catalog
from quernspark.__main__ import main
from quernspark.operators import chunk
from quernspark.plans import ask

from test_table_functions import PAGE

SF = "/root/testdata/sf0.001"


def plain_pieces(text, size, separators):
    """Texts of at most size tokens, cut before the best separator that the text has."""
    if chunk.n_tokens(text) <= size or not separators:
        return [text]
    sep = separators[0]
    if sep == "":
        return list(text)
    if sep not in text:
        return plain_pieces(text, size, separators[1:])
    head, *rest = text.split(sep)
    return [p for part in [head, *(sep + r for r in rest)] if part for p in plain_pieces(part, size, separators[1:])]


def plain_split(text, size, overlap, separators):
    """Chunk by chunk: as many pieces as fit; the next one begins with the last pieces that fit into overlap and before the next piece."""
    parts = plain_pieces(text, size, separators)
    n = [chunk.n_tokens(p) for p in parts]
    out, begin, end = [], 0, 0
    while end < len(parts):
        while end < len(parts) and (end == begin or sum(n[begin : end + 1]) <= size):
            end += 1
        out.append("".join(parts[begin:end]).strip())
        if end < len(parts):
            while begin < end and (sum(n[begin:end]) > overlap or sum(n[begin : end + 1]) > size):
                begin += 1
    return [c for c in out if c]


def test_chunk_queries_against_a_plain_splitter(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: [c for c in plain_split(t or "", 512, 50, chunk.SEPARATORS) if chunk.n_tokens(c) >= 100] for i, t in docs.items()}
    got = catalog.QUERIES["chunk_documents"](spark, SF).collect()
    assert {(r.doc_id, r.pos, r.chunk_id, r.text) for r in got} == {(i, k, f"{i}::{k}", c) for i, cs in want.items() for k, c in enumerate(cs)} and len(got) == sum(map(len, want.values()))
    sizes = {i: [chunk.n_tokens(c) for c in cs] for i, cs in want.items() if cs}
    stats = catalog.QUERIES["chunk_stats"](spark, SF).collect()
    assert {(r.doc_id, r.chunks, r.least, r.most, r["mean"]) for r in stats} == {(i, len(x), min(x), max(x), round(sum(x) / len(x), 6)) for i, x in sizes.items()}
    assert max(map(len, want.values())) > 1


def test_section_query_against_a_plain_splitter(spark):
    """The given pages have no sections: each is one body under its name, split if it does not fit."""
    bodies = {r.page_id: " ".join(r.text.split()) for r in catalog.QUERIES["page_texts"](spark, SF).collect()}
    want = set()
    for i, body in bodies.items():
        whole = chunk.n_tokens(body) <= 512 - chunk.n_tokens(str(i)) - 2
        parts = [f"{i}\n\n{c}" for c in ([body] if whole else plain_split(body, 512, 50, chunk.SENTENCE_SEPARATORS)) if body]
        want |= {(str(i), f"{i}::{k}", "page", "", c) for k, c in enumerate(p for p in parts if chunk.n_tokens(p) >= 10)}
    got = catalog.QUERIES["section_chunks"](spark, SF).collect()
    assert {(str(r.source), r.chunk_id, r.kind, r.member, r.text) for r in got} == want and len(got) == len(want)


def test_index_of_sections_is_asked(spark, tmp_path):
    corpus, index = tmp_path / "corpus", str(tmp_path / "index")
    corpus.mkdir()
    (corpus / "stack.html").write_text(PAGE)
    (corpus / "notes.md").write_text("notes on queues that are long enough to be kept as a chunk of their own")
    assert main(["index", str(corpus), index, "--sections"]) == 0
    stored = ask.Index.load(spark, index)
    kinds = {(r.kind, r.member) for r in stored.chunks.collect()}
    assert {("class-description", ""), ("member", "push"), ("member", "pop"), ("page", "")} <= kinds
    made = ask.ask_one(stored, "adds one element to the very top", "sparse_only")
    assert made["chunks"][0]["text"].startswith("stack - Member: push")
