"""Phrase collocation mining by multikey three-way quicksort of suffix pointers.

A suffix is a word with the up to max_words - 1 words after it in its piece of text. Phrases are
suffixes cut off, so when the suffixes of a language are sorted word by word, equal phrases lie
together, and the size of such a part is the phrase's count.

1. Sketch. Every task counts its words and pairs of words by buckets of a hash; the buckets are summed
   piece by piece of their range and become one bit each: can a word or pair of this bucket be there
   min_count times? The bits are 1 to 32 MB whatever the size of the input (see sketch_bits).
2. Suffixes end before a pair that is too rare, so that most of the text goes no further. Equal ones of
   a task are one row with a number. A sketch that is too full for its input lets rare pairs through;
   that costs shuffling, never a count.
3. Routing. Suffixes go to partitions by language and leading words (the pair that they begin with), and
   single words by themselves, so a frequent leading word is spread over many partitions; of a frequent
   pair each task sends its different continuations only. What a task sends to a partition is one row:
   each leading pair once, with all that follows it, compressed.
4. In each partition the pointers are partitioned into less, equal and greater by the word at the current
   depth of a pivot, all open parts in one round. The size of an equal part is the count of its words;
   it goes on at the next word, as deep as max_words. Parts smaller than min_count are abandoned.
5. The counts of frequent phrases are a table; scores of cuts, containment and the first ones of each
   language are joins and windows over it, in whole numbers (decimals of 38 digits).

Defined cases: a null text has no word; a null language is "und"; equal scores go by count and phrase
(byte order); repeated rows count as often as they stand there; an empty table gives an empty result;
columns of the input may have any names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stash
from .spans import Spans, as_strings, gathered
from .words import BYTE, run_hashes, slices, stretch_hashes

MAX_WORDS, MIN_COUNT, MOST_SHARE, TOP = 3, 10, 50, 2000
BREAK = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
WORD = ~(BREAK | np.isin(np.arange(256), list(b" \t")))
PIECE, HELD, SLICE = 16, 800_000, 1 << 21  # bits of a bucket inside a piece; rows that a task holds; bytes of text at once
PACKED = "route int, langs array<string>, many array<int>, leads binary, ns binary"


class _Pieces(Spans):
    """Words within pieces, with their hashes; follows[i]: word i + 1 stands in the same piece as word i."""

    def __init__(self, texts: pa.Array, salt: np.ndarray):
        super().__init__(texts, WORD)
        breaks = np.cumsum(BREAK[self.data], dtype=np.int64)[self.starts]
        self.follows = (breaks[1:] == breaks[:-1]) & (self.text[1:] == self.text[:-1])
        self.plain = stretch_hashes(self.data, self.starts, self.ends, BYTE)
        self.salt = salt[self.text]
        self.single = _mixed(self.plain ^ self.salt)
        self.pair = _mixed(run_hashes(self.plain, 2) ^ self.salt[:-1])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _languages(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, salt, text); the salt is a hash of the language."""
    name = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    return docs.select(name.alias("lang"), F.xxhash64(name).alias("salt"), F.col(text).alias("text"))


def _salts(batch) -> np.ndarray:
    return batch["salt"].to_numpy().view(np.uint64)


def sketch_bits(docs: DataFrame, text: str) -> int:
    """23 to 28 bits: about one bucket a byte of all texts, at most 2 ** 28 (32 MB as a bitmap)."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return min(28, max(23, int(total).bit_length()))


def sketch(docs: DataFrame, bits: int, min_count: int = MIN_COUNT, text="text", lang="lang") -> np.ndarray:
    """Bitmap over buckets (the first bits of a hash) whose words and pairs are there min_count times or more."""

    def count(batches):
        parts, held = [], 0
        for batch in batches:
            for i, j in slices(batch["text"], SLICE):
                found = _Pieces(batch["text"].slice(i, j - i), _salts(batch)[i:j])
                parts += [found.single >> np.uint64(64 - bits), found.pair[found.follows] >> np.uint64(64 - bits)]
                held += len(parts[-1]) + len(parts[-2])
                if held > 2 * HELD:
                    yield from pieces(np.concatenate(parts))
                    parts, held = [], 0
        if held:
            yield from pieces(np.concatenate(parts))

    def pieces(buckets):
        at, n = np.unique(buckets, return_counts=True)
        piece, first = np.unique(at >> np.uint64(PIECE), return_index=True)
        low, n = (at & np.uint64((1 << PIECE) - 1)).astype("<u2"), np.minimum(n, min_count).astype("<u2")
        ends = [*first[1:].tolist(), len(at)]
        yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array([low[i:j].tobytes() for i, j in zip(first, ends)], pa.binary()), pa.array([n[i:j].tobytes() for i, j in zip(first, ends)], pa.binary())], ["piece", "at", "n"])

    def marks(batches):
        sums: dict[int, np.ndarray] = {}  # the pieces of this partition; 128 KB each, as many as the sketch has
        for batch in batches:
            for piece, at, n in zip(batch["piece"].to_pylist(), batch["at"], batch["n"]):
                own = sums.setdefault(piece, np.zeros(1 << PIECE, dtype=np.uint16))
                at = np.frombuffer(at.as_buffer(), dtype="<u2")
                own[at] = np.minimum(own[at] + np.frombuffer(n.as_buffer(), dtype="<u2"), min_count)
        for piece, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([np.packbits(own >= min_count, bitorder="little").tobytes()], pa.binary())], ["piece", "bits"])

    rows = _languages(docs, text, lang).mapInArrow(count, "piece int, at binary, n binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in rows.repartition(n, "piece").mapInArrow(marks, "piece int, bits binary").collect():  # 8 KB each, as many as the sketch has
        out[r["piece"] << PIECE - 3 : (r["piece"] + 1) << PIECE - 3] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _often(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - (len(bitmap) * 8 - 1).bit_length())
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def suffixes(docs: DataFrame, bitmap: np.ndarray, routes: int, max_words: int = MAX_WORDS, text="text", lang="lang") -> DataFrame:
    """Suffixes by route, as packed() writes them: leads are pairs, single words, or empty (n: all words of a
    language); rest is what follows a pair as far as all its pairs are frequent by the sketch. Equal ones of a task are one."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def cut(batches):
        parts, held = [], 0
        for batch in batches:
            for i, j in slices(batch["text"], SLICE):
                parts.append(merged([rows_of(batch.slice(i, j - i))]))
                held += len(parts[-1])
                if held > HELD:
                    parts = [merged(parts)]
                    held = len(parts[0])
                    if held > HELD // 2:
                        yield packed(parts[0], routes)
                        parts, held = [], 0
        if held:
            yield packed(merged(parts), routes)

    def merged(parts):
        table = pa.concat_tables(parts)
        _, first, at = np.unique(table["key"].to_numpy(), return_index=True, return_inverse=True)
        n = np.zeros(len(first), dtype=np.int64)
        np.add.at(n, at, table["n"].to_numpy())
        return table.take(pa.array(first)).set_column(table.column_names.index("n"), "n", pa.array(n))

    def rows_of(batch):
        found = _Pieces(batch["text"], _salts(batch))
        data, bounds = found.joined()
        words, bitmap = len(found.starts), shared.value
        run = np.zeros(words + 1, dtype=np.int64)  # pairs in a row, from word i on, that are frequent
        frequent = np.flatnonzero(found.follows & _often(found.pair, bitmap))
        for k in range(max_words - 1):
            run[frequent[run[frequent + 1] >= k]] = k + 1
        pairs, single = np.flatnonzero(run), np.flatnonzero(_often(found.single, bitmap))
        keys, lo, mid, hi = [_mixed(found.single[single] ^ np.uint64(1))], [bounds[single]], [bounds[single + 1] - 1], [bounds[single + 1] - 1]
        for k in range(1, max_words):
            at = pairs[run[pairs] == k]
            keys.append(_mixed(run_hashes(found.plain, k + 1)[at] ^ found.salt[at] ^ np.uint64(k + 1)))
            lo.append(bounds[at])
            mid.append(bounds[at + 2] - 1)
            hi.append(bounds[at + k + 1] - 1)
        owner = np.concatenate([single, *[pairs[run[pairs] == k] for k in range(1, max_words)]])
        keys, lo, mid, hi = (np.concatenate(x) for x in (keys, lo, mid, hi))
        _, first, n = np.unique(keys, return_index=True, return_counts=True)
        lo, mid, hi, text_of = lo[first], mid[first], hi[first], found.text[owner[first]]
        leads = np.concatenate([found.single[single] ^ np.uint64(1), *[found.pair[pairs[run[pairs] == k]] for k in range(1, max_words)]])[first]
        made = [pa.array(keys[first]), pa.array(leads), batch["lang"].take(pa.array(text_of)), as_strings(data, lo, mid).cast(pa.string()), as_strings(data, np.minimum(mid + 1, hi), hi).cast(pa.string()), pa.array(n.astype(np.int64))]
        told = pd.DataFrame({"lang": batch["lang"].to_pandas(), "n": np.diff(found.first)}).groupby("lang", as_index=False)["n"].sum()
        blank = [""] * len(told)
        salts = dict(zip(batch["lang"].to_pylist(), _salts(batch).tolist()))
        own = pa.array([salts[x] for x in told["lang"]], pa.uint64())
        all_ = [own, own, pa.array(told["lang"], pa.string()), pa.array(blank, pa.string()), pa.array(blank, pa.string()), pa.array(told["n"], pa.int64())]
        names = ["key", "lead_key", "lang", "lead", "rest", "n"]
        return pa.concat_tables([pa.table(made, names=names), pa.table(all_, names=names)])

    return _languages(docs, text, lang).mapInArrow(cut, PACKED)


def _texts(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of strings."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8), bounds


def packed(table: pa.Table, routes: int) -> pa.RecordBatch:
    """PACKED rows of (lead_key, lang, lead, rest, n), one a route that has any: lines of a lead and its rests with
    ; between them (neither ; nor a line end is part of a word), the number of each rest, and how many lines a language has."""
    key = table["lead_key"].to_numpy()
    route = ((key >> np.uint64(32)) * np.uint64(routes) >> np.uint64(32)).astype(np.int64)
    tongue = table["lang"].combine_chunks().dictionary_encode()
    code = tongue.indices.to_numpy()
    order = np.lexsort((key, code, route))
    key, route, code, n = key[order], route[order], code[order], table["n"].to_numpy()[order].astype("<u4")
    (lead, at1), (rest, at2) = _texts(table["lead"]), _texts(table["rest"])
    fresh = np.append(True, (key[1:] != key[:-1]) | (code[1:] != code[:-1]) | (route[1:] != route[:-1]))
    lo, sizes, gaps = (np.empty(2 * len(order), dtype=np.int64) for _ in range(3))
    lo[0::2], lo[1::2] = at1[order], at2[order] + len(lead)
    sizes[0::2], sizes[1::2] = np.where(fresh, at1[order + 1] - at1[order], 0), at2[order + 1] - at2[order]
    gaps[0::2], gaps[1::2] = fresh, 1
    ends = np.cumsum(sizes + gaps)
    out = np.full(ends[-1], ord(";"), dtype=np.uint8)
    inner = np.ones(len(out), dtype=bool)
    inner[ends[gaps > 0] - 1] = False
    out[inner] = gathered(np.concatenate([lead, rest]), lo, sizes)
    out[ends[1::2][np.append(fresh[1:], True)] - 1] = ord("\n")
    press, rows = zstandard.ZstdCompressor(), []
    cuts = np.append(np.flatnonzero(np.append(True, route[1:] != route[:-1])), len(route))
    names = tongue.dictionary.to_pylist()
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        spoken, many = np.unique(code[i:j][fresh[i:j]], return_counts=True)
        leads = out[ends[2 * i - 1] if i else 0 : ends[2 * j - 1]]
        rows.append((int(route[i]), [names[k] for k in spoken], many.tolist(), press.compress(leads.tobytes()), press.compress(n[i:j].tobytes())))
    kinds = (pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], ["route", "langs", "many", "leads", "ns"])


def unpacked(batches) -> tuple[pa.Array, pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """(language of each lead, leads, lead of each suffix, rests, n) of PACKED rows."""
    open_, langs, lines, ns = zstandard.ZstdDecompressor(), [], [], []
    for batch in batches:
        for r in batch.to_pylist():
            langs += [np.repeat(np.array(r["langs"], dtype=object), r["many"])]
            lines.append(open_.decompress(r["leads"]))
            ns.append(np.frombuffer(open_.decompress(r["ns"]), dtype="<u4"))
    data = np.frombuffer(b"".join(lines), dtype=np.uint8)
    ends = np.flatnonzero(data == ord("\n"))
    split = pc.split_pattern(as_strings(data, np.append(0, ends[:-1] + 1), ends), ";")
    flat, at = split.flatten(), split.offsets.to_numpy()
    first = np.zeros(len(flat), dtype=bool)
    first[at[:-1]] = True
    return pa.array(np.concatenate(langs), pa.string()), flat.take(pa.array(at[:-1])), np.repeat(np.arange(len(ends)), np.diff(at) - 1), flat.filter(pa.array(~first)), np.concatenate(ns).astype(np.int64)


def quicksort(codes: np.ndarray, n: np.ndarray, min_count: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of pointers to suffixes; codes[d] are the words at depth d (-1: none), n how
    often each suffix is there. Returns parts (a suffix, its depth, the count of its first depth words) of all
    prefixes that are there min_count times or more. Every round partitions all open parts by pivots of their own."""
    pointer, depth = np.arange(len(n)), np.zeros(len(n), dtype=np.int64)
    part = np.zeros(len(n), dtype=np.int64)
    rng, found = np.random.default_rng(5), []
    while len(pointer):
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        sizes = np.diff(np.append(starts, len(part)))
        pivots = starts + (rng.random(len(starts)) * sizes).astype(np.int64)
        word = codes[depth, pointer]
        side = np.sign(word - np.repeat(word[pivots], sizes)).astype(np.int64) + 1
        key = 3 * np.repeat(np.arange(len(starts)), sizes) + side
        order = np.argsort(key, kind="stable")
        pointer, depth, key = pointer[order], depth[order], key[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        counts = np.add.reduceat(n[pointer], starts)
        often, equal = counts >= min_count, key[starts] % 3 == 1
        hit = starts[often & equal]
        found.append((pointer[hit], depth[hit] + 1, counts[often & equal]))
        depth = depth + np.repeat(equal, sizes)  # equal parts go on at the next word
        go = np.repeat(often, sizes) & (depth < len(codes))
        go[go] = codes[depth[go], pointer[go]] >= 0
        pointer, depth, part = pointer[go], depth[go], key[go]
    return found


def frequent_phrases(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, text="text", lang="lang") -> DataFrame:
    """(lang, phrase, words, n): all words and phrases of at most max_words words that are there min_count times;
    words 0 has the number of all words of a language of at least as many."""
    bitmap = sketch(docs, sketch_bits(docs, text), min_count, text, lang)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = suffixes(docs, bitmap, n, max_words, text, lang).repartitionById(n, F.col("route"))

    def count(batches):
        langs, leads, lead, rests, n = unpacked(batches)
        at, depth, counts = (np.concatenate(x) for x in zip(*quicksort(coded(langs, leads, lead, rests), n, min_count)))
        for i in range(0, len(at), 100_000):
            own, deep = at[i : i + 100_000], depth[i : i + 100_000]
            told, first = (x.take(pa.array(lead[own])) for x in (langs, leads))
            after = rests.take(pa.array(own)).to_pylist()
            phrases = [" ".join([a, *b.split(" ")[: d - 1]]) if d > 1 else a for a, b, d in zip(first.to_pylist(), after, deep.tolist())]
            yield pa.RecordBatch.from_arrays([told, pa.array(phrases, pa.string()), pa.array([p.count(" ") + 1 if p else 0 for p in phrases], pa.int32()), pa.array(counts[i : i + 100_000])], ["lang", "phrase", "words", "n"])

    def coded(langs, leads, lead, rests):
        """Numbers of the leading words and of the words of rests, a row for each depth; -1 where a suffix has ended."""
        words = pc.split_pattern(rests, " ")
        begin, flat = words.offsets.to_numpy(), words.flatten().dictionary_encode().indices.to_numpy()
        long = np.where(pc.equal(rests, "").to_numpy(zero_copy_only=False), 0, np.diff(begin))
        out = np.full((max(1, max_words - 1), len(rests)), -1, dtype=np.int64)
        out[0] = pc.binary_join_element_wise(langs.cast(pa.large_string()), leads, pa.scalar("\0", pa.large_string())).dictionary_encode().indices.to_numpy()[lead]
        for d in range(1, max_words - 1):
            has = np.flatnonzero(long >= d)
            out[d, has] = flat[begin[has] + d - 1]
        return out

    def some(batches):  # a partition without rows has nothing to count
        first = next((b for b in batches if len(b)), None)
        if first is not None:
            yield from count(itertools.chain([first], batches))

    return routed.mapInArrow(some, "lang string, phrase string, words int, n long")


def _part(first: int, length) -> F.Column:
    return F.array_join(F.slice("w", first, length), " ")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, most_share: int = MOST_SHARE, top: int = TOP, text="text", lang="lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of 2 to max_words words by score.

    A phrase goes if a longer one that holds it has most_share per cent of its count or more.
    """
    table = stash(frequent_phrases(docs, max_words, min_count, text, lang), "phrases")
    candidates = table.where("words >= 2").select("lang", "phrase", F.split("phrase", " ").alias("w"), "words", F.col("n").alias("a"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(1, F.col("k")).alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    counts = table.where("words >= 1").select("lang", "phrase", "n")
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    whole = lambda x: F.col(x).cast("decimal(19,0)")
    above, below = F.lit(1_000_000).cast("decimal(7,0)") * whole("a") * whole("a"), whole("l") * whole("r")
    cuts = cuts.withColumn("score", F.call_function("div", above.cast("decimal(38,0)"), below.cast("decimal(38,0)")))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    spans = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda i: F.transform(F.sequence(F.lit(2), F.least(F.col("words") - 1, F.col("words") - i + 1)), lambda m: F.array_join(F.slice("w", i, m), " ")))
    holders = candidates.where("words >= 3").select("lang", F.explode(F.flatten(spans)).alias("phrase"), F.col("a").alias("held"))
    holders = holders.groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    kept = best.join(holders, ["lang", "phrase"], "left").where(F.col("held").isNull() | (100 * F.col("held") < most_share * F.col("a")))
    totals = table.where("words = 0").select("lang", F.col("n").alias("total"))
    kept = kept.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "b.l", "b.r", F.col("total").alias("n"), F.col("b.score").alias("score"))


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH p AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
q AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
w AS MATERIALIZED (SELECT id, lang, unnest(w) AS w1, unnest(range(len(w))) AS pos FROM q),
s AS MATERIALIZED (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY id ORDER BY pos)),
f AS MATERIALIZED (SELECT lang, w1 AS phrase, lang || chr(9) || w1 AS key, 1 AS words, '' AS w1, '' AS w2, '' AS w3, count(*) AS n FROM s GROUP BY lang, s.w1
  UNION ALL SELECT lang, w1 || ' ' || w2, lang || chr(9) || w1 || ' ' || w2, 2, w1, w2, '', count(*) FROM s WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 10
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, '', 3, w1, w2, w3, count(*) FROM s WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 10),
total AS (SELECT lang, sum(n) AS n FROM f WHERE words = 1 GROUP BY lang),
k AS MATERIALIZED (SELECT lang, phrase, n AS a, 1 AS k, lang || chr(9) || w1 AS first, lang || chr(9) || w2 AS rest FROM f WHERE words = 2
  UNION ALL SELECT lang, phrase, n, 1, lang || chr(9) || w1, lang || chr(9) || w2 || ' ' || w3 FROM f WHERE words = 3 UNION ALL SELECT lang, phrase, n, 2, lang || chr(9) || w1 || ' ' || w2, lang || chr(9) || w3 FROM f WHERE words = 3),
cut AS (SELECT k.lang, k.phrase, k.a, k.k, l.n AS l, r.n AS r, (1000000::HUGEINT * k.a * k.a) // (l.n::HUGEINT * r.n) AS score FROM k
  JOIN f l ON l.key = k.first JOIN f r ON r.key = k.rest),
best AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM cut) WHERE nth = 1),
held AS (SELECT lang, phrase, max(n) AS held FROM (SELECT lang, w1 || ' ' || w2 AS phrase, n FROM f WHERE words = 3 UNION ALL SELECT lang, w2 || ' ' || w3, n FROM f WHERE words = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN held USING (lang, phrase) WHERE held IS NULL OR 100 * held < 50 * best.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l::BIGINT AS l, r::BIGINT AS r, total.n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
