"""Each operator against a plain version on small tables, and on nulls, empties, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from quernspark.llm import imatch, langid, linededup, mixing, packing, sharding, simhash, urlfilter, vectordedup, warc
from quernspark.llm.shared import connected_components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t)) for i, t, s in rows], DOC)


ODD = [(1, None, None), (2, "", "b"), (3, " \n\t ", "b"), (4, "one", None), (4, "one", None), (5, "x " * 30_000, "a"), (None, "one", "a"), (6, "Ünï cödé \U0001f600 words", "é"), (7, "same text here", "a"), (8, "same text here", "a")]


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


# --- components

def test_components_of_long_chains(spark):
    rng = random.Random(1)
    names = list(range(300))
    rng.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(199)] + [(names[200 + i], names[200]) for i in range(50)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    chain, star = names[:200], [names[200 + i] for i in range(50)]
    assert all(got[x] == min(chain) for x in chain) and all(got[x] == min(star) for x in star)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 mixing

def plain_mix(rows, weights=(1, 2, 3), cap=3):
    size = {}
    for k, t, s in rows:
        size[s] = size.get(s, 0) + (len(BLANK.findall(t)) if t else 0)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(size.values()))
    while open_:  # reshare what is above, again and again
        share = left / sum(w[s] for s in open_)
        full = [s for s in open_ if share * w[s] > cap * size[s]]
        if not full:
            target |= {s: share * w[s] for s in open_}
            break
        for s in full:
            target[s] = float(cap * size[s])
            left -= target[s]
            open_.discard(s)
    return size, target


@pytest.mark.parametrize("case", ["odd", "real", "tiny"])
def test_mix(spark, real, case):
    rows = ODD if case == "odd" else [(1, "a", "x"), (2, "b " * 500, "y")] if case == "tiny" else [(r.doc_id, r.text, r.source) for r in real.collect()]
    slim, plan = mixing.plan_mix(documents(spark, rows))
    got = mixing.mix_plan_rows(slim, plan).collect()
    size, target = plain_mix(rows)
    assert len(got) == len(rows)
    taken, biggest = {}, {}
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and 0 <= r.repeats <= 3
        taken[r.source] = taken.get(r.source, 0) + r.size * r.repeats
        biggest[r.source] = max(biggest.get(r.source, 0), r.size)
    for s in taken:
        assert abs(taken[s] - target[s]) <= 2 * biggest[s] + 1e-6


def test_mix_budgets_are_nested_and_columns_stay(spark, real):
    docs = real.withColumnRenamed("n_chars", "size").withColumnRenamed("lang", "hash")
    small = mixing.mix_sources(docs, budget=0.3).groupBy("doc_id").count().collect()
    large = {r.doc_id: r["count"] for r in mixing.mix_sources(docs, budget=0.8).groupBy("doc_id").count().collect()}
    assert small and all(large.get(r.doc_id, 0) >= r["count"] for r in small)
    assert mixing.mix_sources(docs).columns == docs.columns
    assert mixing.mix_sources(documents(spark, [])).count() == 0


# --- 2 packing

def test_best_fill_is_best():
    rng = random.Random(3)
    for _ in range(100):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(6)}
        cap = max(max(counts), rng.randint(20, 80))
        got = packing.best_fill(dict(counts), cap)
        longest = max(counts)
        sums = {longest}
        for k, n in counts.items():
            for _ in range(n - (k == longest)):
                sums |= {s + k for s in sums}
        assert got[longest] >= 1 and all(n <= counts[k] for k, n in got.items())
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= cap)


def test_pack_round_trip(spark, real):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_vocabulary())
    rows = ODD + [(100, " two  blanks \n and tabs\t\tx \u00a0 y ", None), (101, " lead", None), (102, "trail \n", None), (103, "a <|endoftext|> b<|endoftext|>c <|endoftext|> <|endoftext|>", None)] + [(1000 + r.doc_id, r.text, None) for r in real.limit(60).collect()]
    docs = documents(spark, rows)
    got = packing.pack_documents(docs, packing.default_vocabulary()).collect()
    texts = {}
    for k, t, _ in rows:
        texts.setdefault(k, []).append(t or "")
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for k, ts in texts.items():
        ids = plain.encode(ts[0], add_special_tokens=False).ids + [1]
        pieces = sorted(by_doc[k], key=lambda r: r.start)
        if len(ts) == 1:
            assert [x for p in pieces for x in p.ids] == ids
            assert [p.start for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces])[:-1])
        assert all(p.doc_tokens == len(ids) for p in pieces) and sum(p.length for p in pieces) == len(ids) * len(ts)
    padding = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces])[:-1])
        n = sum(p.length for p in pieces)
        assert n <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding <= 0.01 * sum(p.length for p in got)
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in packing.pack_documents(docs, packing.default_vocabulary(), digest_only=True).collect()}
    assert all(digests[p.doc_id, p.start] == zlib.crc32(np.array(p.ids, dtype="<u4").tobytes()) for p in got if p.doc_id != 4)  # there twice
    assert packing.pack_documents(documents(spark, []), packing.default_vocabulary()).count() == 0


# --- 3 URL filters

def plain_rule(url, rules=urlfilter.RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r, _ in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    odd = [(9001, None), (9002, ""), (9003, "no scheme"), (9004, "HTTP://WWW.Example.NET/en/A?x=1#y"), (9005, "http://example.net"), (9006, "http://notexample.net/en/1"), (9007, "x://a.example.com/de/"), (9008, "http://É.org/fr/x://y"), (9009, "a://b?c=d/en/"), (9001, None), (None, "http://q.org/en/1")]
    docs = pages.unionByName(spark.createDataFrame(odd, "page_id long, url string"))
    rows = urlfilter.judge_urls(docs.withColumnRenamed("url", "host"), url="host").collect()
    urls = {r.page_id: r.url for r in docs.collect()}
    verdicts = dict(urlfilter.RULES)
    assert len(rows) == docs.count()
    for r in rows:
        host, path, rule = plain_rule(urls[r.key])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdicts[rule] if rule else r.verdict in ("allow", "block")
    assert urlfilter.judge_urls(docs.where("false")).count() == 0
    assert {r.verdict for r in urlfilter.judge_urls(docs, rules=(("net/", "block"),)).collect()} == {"block"}
    assert {r.verdict for r in urlfilter.judge_urls(docs, rules=()).collect()} == {"allow"}


def test_url_trees_learn(spark):
    """Labels that follow the URL's form are learnt from rules over some hosts and hold on others."""
    rng = random.Random(4)
    rows, truth = [], {}
    for i in range(1200):
        bad = rng.random() < 0.5
        host = f"{rng.choice(['one', 'two', 'new', 'old'])}{'bad' if bad else 'ok'}.test"
        path = "/" + "".join(rng.choice("0123456789" if bad else "abcdefgh") for _ in range(20 if bad else 8))
        rows.append((i, f"http://{host}{path}" + ("?a=1&b=2&c=3" if bad else "")))
        truth[i] = "block" if bad else "allow"
    rules = (("onebad.test/", "block"), ("twobad.test/", "block"), ("oneok.test/", "allow"), ("twook.test/", "allow"))
    got = urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).where("rule is null").collect()
    assert len(got) > 300 and sum(r.verdict == truth[r.key] for r in got) / len(got) > 0.95


# --- 4 language ID

def test_language_id_held_out(real):
    rows = langid.identify(real).select("row.doc_id", "row.lang", "held_out", "lang_pred", "score").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_language_mixture_and_odd_texts(spark, real):
    model = langid.train(real)
    by = {}
    for r in real.collect():
        by.setdefault(r.lang, []).append(r.text)
    a, b = sorted(by, key=lambda k: -len(by[k]))[:2]
    one, two = max(by[a], key=len)[:3000], max(by[b], key=len)[:1000]
    name, share = model.predict(one + " " + two)
    assert name == a and 0.55 < share < 0.95
    assert model.predict(one)[1] > 0.95
    for text in (None, "", "  ", "123 $$$ 456"):
        assert model.predict(text) == ("und", 0.0)
    docs = documents(spark, ODD)
    assert {r.lang_pred for r in langid.identify(docs).collect()} == {"und"}  # nothing labelled
    assert langid.keep_known_languages(real).columns == real.columns
    assert langid.identify(documents(spark, [])).count() == 0


# --- 5 SimHash

def plain_fingerprint(text, shingle=3):
    words = BLANK.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(items, linked):
    label = dict.fromkeys(items)
    for x in sorted(items):
        if label[x] is None:
            label[x], todo = x, [x]
            while todo:
                y = todo.pop()
                for z in items:
                    if label[z] is None and linked(y, z):
                        label[z] = x
                        todo.append(z)
    return label


def test_simhash(spark, real):
    base = [(r.doc_id, r.text, None) for r in real.limit(120).collect()]
    rows = base + [(500 + i, t, s) for i, (_, t, s) in enumerate(ODD)] + [(600 + i, t.replace(" the ", " a ", 1) + " end", None) for i, t, _ in base[:20]]
    got = {r.key: (int(r.fp.hex(), 16), r.component) for r in simhash.simhash_components(documents(spark, rows)).collect()}
    fps = {i: plain_fingerprint(t) for i, t, _ in rows}
    assert {i: f for i, (f, _) in got.items()} == fps
    assert {i: c for i, (_, c) in got.items()} == plain_components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert simhash.simhash_components(documents(spark, [])).count() == 0


def test_simhash_chains_tiles_and_more_blocks(spark):
    """Fingerprints at exactly 3 bits, in a crowded key, cut into small tiles; each plan of blocks is exact."""
    rng = random.Random(6)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:20]:
        for _ in range(8):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4]))))
    fps = sorted(fps)
    nodes = spark.createDataFrame([(bytearray(f.to_bytes(8, "big")), i) for i, f in enumerate(fps)], "fp binary, rep long")
    want = plain_components(list(range(len(fps))), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    for blocks, agree in ((4, 1), (5, 2), (6, 3)):
        keyed = simhash.key_rows(nodes, blocks, agree, 1, 1)
        got = {r.node: r.component for r in connected_components(simhash.near_links(keyed, 1, 3, tile=4)).collect()}
        assert {i: got.get(i, i) for i in want} == want
    assert simhash.plan_blocks(10, 3) == (4, 1) and simhash.plan_blocks(1 << 25, 3) == (5, 2)


def test_keep_one_of_each_finds_near_copies(spark, real):
    texts = [r.text for r in real.collect() if len(r.text.split()) > 150][:40]
    rows = []
    for i, t in enumerate(texts):
        words = t.split(" ")
        words[len(words) // 2] = "changed"
        rows += [(i, t, None), (100 + i, t, None), (200 + i, " ".join(words), None)]
    how = {"words": 3, "max_bits": 33, "blocks": 8, "agree": 2, "key_words": 2}
    docs = documents(spark, rows).withColumnRenamed("n_chars", "fp").withColumnRenamed("lang", "component")
    kept = simhash.keep_one_of_each(docs, **how)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and not any(100 <= i < 200 for i in ids) and sum(i >= 200 for i in ids) <= 2
    assert sum(i < 100 for i in ids) >= 36  # texts that are near copies of each other in the table itself may go


# --- 6 line dedup

def plain_repeats(rows, least=50):
    """{(id, text): words that lie in least words in a row of which an earlier place has a copy}, by direct comparison."""
    first, out = {}, {}
    for i, t in sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0)):
        words, met = t.encode().split(), set()
        for a in range(len(words) - least + 1):
            place = first.setdefault(b" ".join(words[a : a + least]), (i, t, a))
            if place != (i, t, a):
                met.update(range(a, a + least))
        out[i, t] = met
    return out


def test_line_dedup(spark, real):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 999))
    line = lambda n: " ".join(word() for _ in range(n))
    prose = lambda n: re.sub(r"((?:\S+ ){9}\S+) ", r"\1. ", line(n))
    shared = [line(n) for n in (60, 20, 20, 20, 5)]
    rows = [(r.doc_id, r.text) for r in real.collect()]
    rows += [(1000 + i, "\n".join([line(7), *shared, line(9)])) for i in range(5)]
    rows += [(1100 + i, "\n".join([line(3), shared[1], line(30)])) for i in range(9)]  # 20 words alone are no run
    rows += [(1200, "\n".join([shared[0], "x", shared[0], *shared[1:4], shared[0]])), (1201, "\n".join(["again " * 20] * 6)), (1202, None), (1203, ""), (1000, rows[0][1]), (None, line(60))]
    inside = {n: prose(n) if n % 2 else line(n) for n in (52, 61, 75, 90, 133, 200)}  # passages that begin and end inside lines
    for n, passage in inside.items():
        rows += [(2000 + 10 * n + i, f"{prose(rng.randint(5, 40))} {passage} {prose(rng.randint(5, 40))}\n{line(12)}") for i in range(4)]
    rows += [(5000 + i, f"{line(20)} {inside[61][: len(inside[61]) // 2]} {line(30)}") for i in range(3)]
    docs = documents(spark, [(i, t, None) for i, t in rows]).withColumnRenamed("lang", "runs").withColumnRenamed("source", "th")
    got = linededup.dedup_lines(docs).select("row.doc_id", "row.text", linededup.F.col("text").alias("new"), "removed").collect()
    assert len(got) == len(rows)
    repeats, left = plain_repeats(rows), {}
    for r in got:
        if r.text is None:
            assert r.new is None and not r.removed
            continue
        gone = {n for x in r.removed for n in range(x.lo, x.hi + 1)}
        assert gone <= repeats[r.doc_id, r.text]  # nothing but words of repeated runs
        assert r.new.split() == [w for n, w in enumerate(r.text.split()) if n not in gone]
        assert gone or r.new == r.text
        left[r.doc_id, r.new] = r.doc_id
        assert r.doc_id not in range(1100, 1109) and r.doc_id not in range(5000, 5003) or not gone
    assert sum(bool(r.removed) for r in got) > 25
    grams = {}
    for i, new in left:  # no document still has 50 words in a row of another one
        words = new.split()
        for a in range(len(words) - 49):
            assert grams.setdefault(" ".join(words[a : a + 50]), i) == i
    clean = linededup.without_repeated_lines(docs)
    assert clean.columns == docs.columns and clean.where("doc_id in (1202, 1203)").count() == 2
    assert linededup.dedup_lines(documents(spark, [])).count() == 0


def test_cut():
    text = "a b.\n c d \n\ne"
    assert linededup.cut(text, [2], [3]) == "a b.\n e" and linededup.cut(text, [2], [4]) == "a b."
    assert linededup.cut(text, [0, 3], [1, 3]) == "c e" and linededup.cut(text, [0], [4]) == ""


# --- 7 WARC

def test_warc_round_trip(spark):
    big = "<p>" + "payload é " * 30_000
    rows = [(1, "http://a/", "x" * 100), (2, "http://b/ü ?", "x" * 100), (3, None, "x" * 99), (4, "", "x" * 99), (5, "u", None), (6, "u", ""), (8, "u", big), (7, "v", big), (None, "w", big), (9, "q", "\r\n\r\nWARC/1.1\r\n\x00" * 20), (9, "q", "\r\n\r\nWARC/1.1\r\n\x00" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("url", "digest")
    got = warc.read_archives(warc.write_archives(pages, url="digest")).collect()
    assert len(got) == len(rows)
    html = {k: (h or "").encode() for k, _, h in rows}
    for r in got:
        body = html[r.key]
        assert r.payload_bytes == len(body) and r.payload_digest == hashlib.sha256(body).hexdigest()
        first = min((k for k in html if k is not None and html[k] == body), default=None)
        revisit = len(body) >= 100 and r.key != first
        assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))
        assert (r.payload is None) if revisit else bytes(r.payload) == body
    assert warc.read_archives(warc.write_archives(pages.where("false"), url="digest")).count() == 0


def test_warc_reader_finds_damage():
    import io

    record = warc.record_bytes(3, "u", b"hello", hashlib.sha256(b"hello").hexdigest(), None)
    assert [x for x in warc.members(io.BytesIO(warc.gzip_member(record) * 3), block=7)] == [record] * 3
    assert warc.read_record(record)["payload"] == b"hello"
    for bad in (record.replace(b"hello", b"jello"), record[:-1], record.replace(b"Content-Length: ", b"Content-Length: 1")):
        with pytest.raises(ValueError):
            warc.read_record(bad)
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(warc.gzip_member(record)[:-9])))


# --- 8 sharding

def test_sharding(spark, real):
    docs = real.unionByName(documents(spark, ODD + [(77, "copy", "a")] * 40))
    sized = docs.selectExpr("doc_id", "text as shard", "coalesce(octet_length(text), 0) + 1 as slot")
    got = sharding.shuffle_into_shards(sized, "doc_id", "slot", shards=5, bucket_bytes=20_000).selectExpr("row.doc_id", "row.slot as size", "shard", "slot", "grown_shard").collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 5)
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and set(by) == set(range(5))
    ids = {}
    for r in got:
        assert ids.setdefault(r.doc_id, r.shard) == r.shard
    ordered = [r.doc_id for r in sorted((r for r in got if r.shard == 0 and r.doc_id is not None), key=lambda r: r.slot)]
    assert ordered != sorted(ordered)
    path = sharding.write_shards(docs, shards=3)
    back = spark.read.parquet(path)
    assert back.count() == docs.count() and back.select("__shard").distinct().count() == 3
    assert sharding.shuffle_into_shards(sized.where("false"), "doc_id", "slot").count() == 0


# --- 9 I-Match

def plain_next(rows):
    keyed = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    return {k: (t or "", keyed[(i + 1) % len(keyed)][1] or "") for i, (k, t) in enumerate(keyed)}


@pytest.mark.parametrize("parts", ["1", "8", "61"])
def test_imatch(spark, real, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = [(r.doc_id, r.text) for r in real.collect()] + [(1000, None), (1001, ""), (1002, "\U0001f600é x"), (None, "the last one"), (2000, real.first().text)]
        got = imatch.fingerprint_with_next(documents(spark, [(i, t, None) for i, t in rows])).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    follow = plain_next(rows)
    assert len(got) == len(rows)
    for r in got:
        text, after = follow[r.doc_id]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert r.near_edited == 1.0 or edited != text
    same = {}
    for r in got:
        assert same.setdefault(follow[r.doc_id][0], r.fingerprint) == r.fingerprint
    long = [r for r in got if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in long) / len(long) > 0.8


def test_imatch_small_tables(spark):
    one = imatch.fingerprint_with_next(documents(spark, [(5, "abcdef", None)])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one[0].near_next == 1.0
    assert imatch.fingerprint_with_next(documents(spark, [])).count() == 0
    repeated = imatch.fingerprint_with_next(documents(spark, [(5, "ab", None), (5, "ab", None), (6, "cd", None)])).collect()
    assert len(repeated) == 3


def test_lexicon_counts_documents(spark):
    rows = [(i, "common " + ("pair " if i < 2 else "") + f"only{i}", None) for i in range(40)]
    lexicon = imatch.lexicon_bitmap(documents(spark, rows))
    inside = lambda w: bool(lexicon[(b := int(imatch.buckets(imatch.terms(w))[0])) >> 3] >> (b & 7) & 1)
    assert inside("pair") and not inside("common") and not inside("only7")


# --- 10 embeddings

def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:30] + rng.normal(size=(30, 16)) * 0.05, base[:5], np.repeat(base[7:8], 200, 0) + rng.normal(size=(200, 16)) * 0.03])
    label = [int(i) % 2 for i in range(len(x))]
    rows = [(i, [float(np.float32(c)) for c in v], label[i]) for i, v in enumerate(x)]
    n = len(rows)
    odd = [None, [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] * 16, [], [1.0]]
    rows += [(n + i, v, 0) for i, v in enumerate(odd)] + [(n + 90, rows[0][1], None), (0, *rows[0][1:]), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.key: (r.n_links, r.component) for r in vectordedup.near_vectors(df, tile=50).collect()}
    u = np.array([r[1] for r in rows[:n]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(link, False)
    want = plain_components(list(range(n)), lambda a, b: bool(link[a, b]))
    exact = sum(got[i] == (int(link[i].sum()), want[i]) for i in range(n))
    assert exact / n >= 0.97 and all(got[i][0] <= link[i].sum() for i in range(n))
    assert sum(got[i][0] for i in range(n)) >= 0.97 * link.sum()
    assert all(got[k] == (0, k) for k in range(n, n + len(odd))) and got[n + 90] == (0, n + 90) and got[None] == (0, None)
    assert len(got) == df.select("vec_id").distinct().count()
    assert vectordedup.near_vectors(df.where("false")).count() == 0


def test_multi_sequence_order():
    rng = np.random.default_rng(2)
    index = vectordedup.MultiIndex(rng.normal(size=(7, 3)), rng.normal(size=(5, 3)), 9)
    x = rng.normal(size=(20, 6))
    all_d = vectordedup.squared(x[:, :3], index.first)[:, :, None] + vectordedup.squared(x[:, 3:], index.second)[:, None, :]
    want = np.argsort(all_d.reshape(20, -1), 1, kind="stable")[:, :9]
    assert (index.cells(x) == want).all()
