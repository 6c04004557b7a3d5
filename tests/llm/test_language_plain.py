"""op4_langid against a plain version: trigrams by slices of strings, EM and penalised likelihood by loops over numbers."""

import math
import zlib
from collections import Counter

from quernspark.llm import langid, queries

SF = "/root/testdata/sf0.001"


def plain_trigrams(text):
    framed = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    return Counter(framed[i : i + 3] for i in range(len(framed) - 2) if framed[i + 1] != " ")


def em(tables, counts, names, rounds=200):
    share = {n: 1 / len(names) for n in names}
    total = sum(counts.values())
    for _ in range(rounds):
        new = dict.fromkeys(names, 0.0)
        for t, k in counts.items():
            parts = {n: share[n] * tables[n](t) for n in names}
            whole = sum(parts.values())
            for n in names:
                new[n] += k * parts[n] / whole / total
        moved = max(abs(new[n] - share[n]) for n in names)
        share = new
        if moved < 1e-3:
            break
    return share, sum(k * math.log(sum(share[n] * tables[n](t) for n in names)) for t, k in counts.items())


def plain_predict(tables, text):
    counts = plain_trigrams(text)
    if not counts:
        return "und", 0.0
    alone = {n: em({n: tables[n]}, counts, [n], 1)[1] for n in tables}
    best = max(sorted(alone), key=alone.get)
    chosen, like = {best: 1.0}, alone[best]
    full, _ = em(tables, counts, sorted(tables))
    ranked, price = sorted(sorted(full), key=full.get, reverse=True), 3.0 * math.log(sum(counts.values()) + 1)
    for k in range(2, len(ranked) + 1):
        share, more = em(tables, counts, sorted(ranked[:k]))
        if more - like <= price:
            break
        chosen, like = share, more
    return max(chosen.items(), key=lambda x: x[1])


def plain_tables(rows):
    """Probabilities of trigrams in each language; half a count for each of 65,536 buckets, as in the model."""
    sums = {}
    for text, lang in rows:
        sums.setdefault(lang, Counter()).update(plain_trigrams(text))
    return {n: (lambda t, c=c, whole=sum(c.values()) + langid.BUCKETS / 2: (c[t] + 0.5) / whole) for n, c in sums.items()}


def test_query_against_plain_mixtures(spark):
    """Trigrams that share a bucket make small differences, so shares may differ a little and near ties fall either way."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    tables = plain_tables([(r.text, r.lang) for r in docs if r.lang is not None and not held(r.doc_id)])
    got = {r.doc_id: r for r in queries.QUERIES["op4_langid"](spark, SF).collect()}
    want = {r.doc_id: plain_predict(tables, r.text) for r in docs}
    assert len(got) == len(want) and all(got[i].held_out == held(i) for i in want)
    assert all(got[i].lang_pred == name for i, (name, share) in want.items() if share > 0.6 or name == "und")
    assert sum(abs(got[i].score - share) < 0.02 for i, (_, share) in want.items()) >= 0.97 * len(want)


def test_proportions_of_mixed_texts(spark):
    """Halves of documents of two languages: model and plain version find both, with nearly the same shares."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and n_chars > 600")
    rows = docs.select("text", "lang").collect()
    tables, model = plain_tables([(r.text, r.lang) for r in rows]), langid.train(docs)
    by = {}
    for r in rows:
        by.setdefault(r.lang, []).append(r.text)
    names = sorted(by)
    assert len(names) > 1
    for a, b in zip(names, names[1:]):
        text = by[a][0][:600] + " " + by[b][0][:400]
        name, share = model.predict(text)
        plain, other = plain_predict(tables, text)
        assert name == plain == a and 0.5 < share < 0.75 and abs(share - other) < 0.03
