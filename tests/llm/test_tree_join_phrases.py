"""The Merkle manifest, the Jaccard join and phrase collocations against brute-force versions."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest

from rankweave.llm import merkle, ngram_join, phrases


def hexed(text):
    return sha256(text.encode()).hexdigest()


# ---- Merkle manifest


def leaf_of(row, more=0):
    out = ""
    for c in merkle.FIELDS:
        v = row[c]
        if c == "n_chars" and v is not None:
            v += more
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return hexed(out)


def parents(nodes, fanout):
    return [hexed("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]


def proof_of(nodes, i, fanout):
    """Siblings from the leaf up, and the last node."""
    out = []
    while len(nodes) > 1:
        at = i // fanout * fanout
        out += [h for k, h in enumerate(nodes[at : at + fanout], at) if k != i]
        nodes, i = parents(nodes, fanout), i // fanout
    return out, nodes[0]


def brute_manifest(rows, fanout):
    langs = {}
    for r in rows:
        langs.setdefault(r["lang"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0), leaf_of(r)))
    ordered = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    leaves = {x: [h for _, h in sorted(langs[x])] for x in langs}
    subroots = [proof_of(leaves[x], 0, fanout)[1] for x in ordered]
    out = []
    for x in ordered:
        higher, root = proof_of(subroots, ordered.index(x), fanout)
        for i, h in enumerate(leaves[x]):
            out.append((x, h, subroots[ordered.index(x)], root, hexed("".join(proof_of(leaves[x], i, fanout)[0] + higher))))
    return sorted(out, key=str)


DOC = "doc_id long, source string, lang string, n_chars long, text string"


def documents(n, seed, langs=("en", "de", "", "zz", None, "ß")):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(n) if rnd.random() < 0.95 else None, rnd.choice(["web", None, "книга"]), rnd.choice(langs), rnd.choice([None, 5, 1 << 40]), rnd.choice([None, "", "a:b", "ü" * 7, "x" * 5000])) for _ in range(n)]
    return rows + rows[:3]


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest_is_the_brute_force_one(spark, fanout):
    docs = spark.createDataFrame(documents(150, fanout), DOC).repartition(3)
    rows = docs.collect()
    got = merkle.manifest(docs, fanout)
    shown = sorted(((r["lang"], r["leaf"], r["subroot"], r["root"], hexed(bytes(r["proof"]).hex())) for r in got.collect()), key=str)
    assert shown == brute_manifest(rows, fanout)
    for r in merkle.checked(got, merkle.F.coalesce("tampered", "leaf"), fanout).collect():
        changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        assert (r["tampered"] is not None) == changed
        # a leaf without n_chars stays as it is
        assert (r["folded_root"] == r["root"]) == (not changed or r["tampered"] == r["leaf"])


def test_manifest_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(7, "s", None, 3, "abc", 1)], f"{DOC}, idx int")
    (row,) = merkle.checked(merkle.manifest(one), merkle.F.col("leaf")).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] == leaf_of(one.first()) and bytes(row["proof"]) == b""
    assert merkle.manifest(one.where("false")).count() == 0


def test_a_language_is_numbered_over_many_ranges(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'s' as source", "'en' as lang", "id as n_chars", "cast(id as string) as text")
    got = merkle.manifest(docs)
    assert [r["idx"] for r in got.orderBy("doc_id").collect()] == list(range(3000))
    assert got.select("root").distinct().count() == 1


# ---- Jaccard join


def gram_sets(texts, size):
    out = []
    for t in texts:
        words = [bytes(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))]
        out.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()})
    return out


def brute_components(ids, sets, s):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * s.denominator >= s.numerator * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, x in enumerate(ids):
        low[find(i)] = min(low.get(find(i), x), x)
    return {x: low[find(i)] for i, x in enumerate(ids)}


def group_texts(seed, groups=2, of=40, words=30, changes=4):
    """Groups of near copies of near copies, so that some are linked with few others, beside single texts that share a passage."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(4000)}"
    passage = [word() for _ in range(25)]
    out = []
    for _ in range(groups):
        some = [[word() for _ in range(words)]]
        for _ in range(of):
            t = list(rnd.choice(some[-6:] if rnd.random() < 0.3 else some))
            for _ in range(rnd.randrange(changes)):
                at = rnd.randrange(len(t))
                t[at : at + 1] = rnd.choice([[word()], [], [t[at], word()]])
            some.append(t)
        out += some
    out += [[word() for _ in range(4)] + passage + [word() for _ in range(rnd.randrange(6))] for _ in range(20)]
    rnd.shuffle(out)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize(("size", "s", "cell", "seed"), [(3, 0.9, 4, 1), (5, 0.8, 3, 3), (2, 0.8, 6, 5)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, size, s, cell, seed):
    monkeypatch.setattr(ngram_join, "CELL", cell)
    texts = group_texts(seed)
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    sets = gram_sets(texts, size)
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_join(docs, size, s).collect()}
    want = brute_components(ids, sets, Fraction(str(s)))
    assert got == {x: (len(sets[i]), want[x]) for i, x in enumerate(ids)}


def test_overlaps_by_blocks():
    rnd = np.random.default_rng(3)
    pool = np.sort(rnd.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2))
    a = [np.sort(rnd.choice(pool, rnd.integers(1, 60), replace=False)) for _ in range(200)]
    b = [np.sort(np.unique(np.concatenate([x[: rnd.integers(0, len(x) + 1)], rnd.choice(pool, rnd.integers(1, 5))]))) for x in a]
    for s in (Fraction(9, 10), Fraction(1, 2), Fraction(1, 7)):
        both = [len(np.intersect1d(x, y)) for x, y in zip(a, b, strict=True)]
        want = [k * s.denominator >= s.numerator * (len(x) + len(y) - k) for k, x, y in zip(both, a, b, strict=True)]
        assert ngram_join.overlaps(a, b, s).tolist() == want


def test_parities_never_differ_in_more_places_than_sets(n=200):
    rnd = np.random.default_rng(5)
    for _ in range(n):
        a, b = (np.unique(rnd.integers(0, 9000, rnd.integers(0, rnd.choice([300, 5000])), dtype=np.uint64)) for _ in range(2))
        assert ngram_join.least_apart(ngram_join.parities(a), ngram_join.parities(b)) <= len(np.setxor1d(a, b))
    assert ngram_join.least_apart(ngram_join.parities(np.arange(5000, dtype=np.uint64)), ngram_join.parities(np.arange(5000, 7000, dtype=np.uint64))) > 1000


def test_join_of_odd_rows(spark, odd_docs, no_docs):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_join(odd_docs).collect()), key=str)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    sets = gram_sets([t for _, t in rows], 3)
    want = brute_components([i for i, _ in rows if i is not None], [s for (i, _), s in zip(rows, sets, strict=True) if i is not None], Fraction(9, 10))
    assert got == sorted(((i, len(s), want[i] if i is not None else None) for (i, _), s in zip(rows, sets, strict=True)), key=str)
    assert ngram_join.jaccard_join(no_docs).count() == 0


def test_a_group_of_a_third_of_all_rows_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 8)
    seen = []
    allow = ngram_join.possible
    monkeypatch.setattr(ngram_join, "possible", lambda pairs, *a: seen.append(pairs.count()) or allow(pairs, *a))
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(80)]
    texts = [" ".join([*base[:at], f"own{k}", *base[at + 1 :]]) for k in range(300) for at in [rnd.randrange(80)]] + [" ".join(f"x{rnd.randrange(9000)}" for _ in range(50)) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = ngram_join.jaccard_join(docs).groupBy("component_id").count().where("count > 1").collect()
    # 44,850 pairs reach the similarity or nearly so
    assert [(r["component_id"], r["count"]) for r in got] == [(0, 300)] and seen[0] < 3000


# ---- phrases


def brute_phrases(rows, least, first):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    good = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in good.items():
        if any(100 * b >= 80 * a for (x, q), b in good.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -score) for lang, some in out.items() for i, (score, a, p, left, right) in enumerate(sorted(some)[:first], 1))


def phrase_rows(seed):
    rnd = random.Random(seed)
    names = ["new york", "Los Angeles", "a b c d", "the", "of", "Ünï x", "re:peat"]
    out = [(rnd.choice(["en", "de", None, ""]), "".join(rnd.choice(names) + rnd.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b", "\x1c"]) for _ in range(rnd.randrange(40)))) for _ in range(120)]
    return out + [("en", None), ("en", ""), (None, " \t"), ("en", "z " * 900 + "end")] + out[:30]


@pytest.mark.parametrize("size", [1, 3, 256])
def test_collocations_are_those_of_brute_force(spark, monkeypatch, size):
    rows = phrase_rows(size)
    monkeypatch.setattr(phrases, "WORDS_AT_ONCE", 700)
    monkeypatch.setattr(phrases, "PIECES_AT_ONCE", 50)
    plain = phrases.distinct_pieces
    monkeypatch.setattr(phrases, "distinct_pieces", lambda docs: plain(docs, size))
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, n int, words int").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(docs, 10, 25).collect())
    assert got == brute_phrases(rows, 10, 25) and any(r[0] == "und" for r in got)


def test_a_saturated_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_MOST", 6)
    rows = phrase_rows(9)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in phrases.collocations(docs, 10, 25).collect()) == brute_phrases(rows, 10, 25)


def test_scores_are_exact_beyond_64_bits(spark):
    big = (1 << 62) - 1
    counts = spark.createDataFrame([("x", "a", 1, big), ("x", "b", 1, big - 7), ("x", "a b", 2, big - 9)], "lang string, gram string, size int, n long")
    (row,) = phrases.with_scores(counts).collect()
    assert (row["score"], row["l"], row["r"]) == (2_000_000 * (big - 9) // (2 * big - 7), big, big - 7)


def test_buckets_are_counted_out_of_core(spark):
    grams = spark.range(400_000).selectExpr("'en' as lang", "concat('word', id % 150000, ' and some more letters') as gram", "1 as size", "id % 3 as n")
    got = phrases.frequent(grams, 4, memory_mb=32)
    want = grams.groupBy("lang", "gram", "size").agg(phrases.F.sum("n").alias("n")).where("n >= 4")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_collocations_of_an_empty_table(spark, no_docs):
    assert phrases.collocations(no_docs).count() == 0


def test_pieces_are_those_of_cuts_and_words():
    import re

    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choice("aZé\x1c\x85ü　  \t\t.,;:!?\n\x0b\x0c\r") for _ in range(40))
        want = [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\n-\r]", text.replace("Z", "z"))]
        assert [(w.decode(), n) for w, n in phrases.pieces_of(text)] == [(" ".join(w), len(w)) for w in want if w]
    assert not list(phrases.pieces_of(None))


def test_phrases_are_counted_as_they_come(spark, monkeypatch):
    """No table of all rows is made first: the rows of a bucket are read once, as a stream."""
    import duckdb

    seen = []

    class Watched:
        def __init__(self, db):
            self.db = db

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.db.close()

        def __getattr__(self, name):
            seen.append(name)
            return getattr(self.db, name)

    class Rows:
        def repartition(self, *_):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            batch = phrases.pa.RecordBatch.from_pydict({"lang": ["en"] * 5, "gram": ["a b", "c", "a b", "a b", "c"], "size": [2, 1, 2, 2, 1], "n": [20, 29, 5, 5, 0]}, phrases.GRAMS)
            return [r for b in run(iter([batch.slice(0, 2), batch.slice(2)])) for r in b.to_pylist()]

    connect = duckdb.connect
    monkeypatch.setattr(duckdb, "connect", lambda *a, **k: Watched(connect(*a, **k)))
    assert phrases.frequent(Rows(), 30) == [{"lang": "en", "gram": "a b", "size": 2, "n": 30}]
    assert "execute" not in seen
