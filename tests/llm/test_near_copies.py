"""Near copies by word shingles against all pairs compared."""

import random
import re
from fractions import Fraction

import pytest
from test_text_operators import rows_of

from rankweave.llm import components, ngram_join, simhash
from rankweave.llm.shared import ARROW_BYTES, BATCH_BYTES, likely, shared_folder, written


def slow_set(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").lower())
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def slow_near(rows, similarity=Fraction(4, 5)):
    """The component of each (id, text): all pairs compared."""
    sets, root = [slow_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (a == b or min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b)) and (x := find(i)) != (y := find(j)):
                root[max(x, y)] = min(x, y)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[find(i)] = min(doc_id, smallest.get(find(i), doc_id))
    return [smallest.get(find(i)) for i in range(len(rows))]


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        at = rnd.randrange(len(words))
        words[at : at + rnd.randrange(2)] = [f"e{rnd.random()}"] * rnd.randrange(2)
    return words


def random_docs(rnd):
    texts = []
    for _ in range(60):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([1, 4, 5, 8, 9, 10, 14, 15, 30, 60, 150, 400]))]
        texts += [base, *[edited(rnd, base, rnd.randrange(1 + len(base) // 25 + 1)) for _ in range(4)]]
    base = [f"h{i}" for i in range(120)]
    texts += [edited(rnd, base, rnd.randrange(5)) for _ in range(40)]
    texts += [[*base[:90], *[f"o{i}x{k}" for k in range(rnd.randrange(10, 60))]] for i in range(30)]  # a passage that many texts share
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, " "), (None, "w1 w2"), (902, texts and " ".join(texts[3]))]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [5, 6, 9, 20, 77, 300])
def test_sets_at_the_similarity_share_a_first_column(n):
    rnd = random.Random(n)
    np = ngram_join.np
    least = Fraction(4, 5)
    for _ in range(300):
        a = np.array([rnd.getrandbits(64) for _ in range(n)], np.uint64)
        gone = rnd.randrange(n // 5 + 1)
        more = 0
        while n - gone >= least * (n + more + 1):
            more += 1
        b = np.append(a[gone:], np.array([rnd.getrandbits(64) for _ in range(more)], np.uint64))
        assert ngram_join.overlaps([np.sort(a)], [np.sort(b)], least).all()
        common = np.sort(np.array([x for x in [*a.tolist(), *b.tolist()] if rnd.random() < 0.5], np.uint64))
        first = [set(ngram_join.in_order(np.sort(x), np.isin(np.sort(x), common), least)[0].tolist()) for x in (a, b)]
        assert first[0] & first[1]


def test_near_copies_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 4)
    rows = random_docs(random.Random(8))
    got = rows_of(ngram_join.placed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 0.8), "doc_id", "component_id")
    assert got == sorted(zip((i for i, _ in rows), slow_near(rows), strict=True), key=str)


def test_the_stage_drops_copies_with_changed_words(spark):
    import corpus_pipeline

    rnd = random.Random(5)
    base = [f"w{rnd.randrange(9000)}" for _ in range(200)]
    near = [f"new{i}" if i in (30, 70, 110, 150) else w for i, w in enumerate(base)]
    far = [w if i % 20 else "far" for i, w in enumerate(base)]
    docs = spark.createDataFrame([(i, " ".join(t), "en") for i, t in enumerate([base, near, far, near])], "doc_id long, text string, lang string")
    assert rows_of(corpus_pipeline.drop_near_copies(spark, docs, ""), "doc_id") == [(0,), (2,)]


@pytest.mark.parametrize("place", [simhash.placed, ngram_join.placed])
def test_a_copy_that_shares_an_id_with_a_kept_text_goes(spark, place):
    a, b, c = "one two three four", "quite another text here", "a third one of these"
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, c.upper()), (None, c)]
    kept = rows_of(simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), place), "doc_id", "text")
    assert len(kept) == 4 and {(1, a), (2, b), (None, c)} < set(kept)


def test_near_copies_by_grid_and_columns_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 4)
    monkeypatch.setattr(simhash, "CELL", 4)
    rows = random_docs(random.Random(9))[:150]
    got = rows_of(ngram_join.placed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 0.8, grid=True), "doc_id", "component_id")
    assert got == sorted(zip((i for i, _ in rows), slow_near(rows), strict=True), key=str)


def test_the_stage_takes_the_grid_of_fingerprints(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(ngram_join, "met", lambda filed, s: filed.select(ngram_join.F.col("key").alias("a"), ngram_join.F.lit(None).cast("long").alias("b")).limit(0))  # columns find nothing
    rnd = random.Random(6)
    base = [f"w{rnd.randrange(9000)}" for _ in range(3000)]
    texts = [base, [*base[:-1], "end"], [f"v{rnd.randrange(9000)}" for _ in range(3000)]]
    assert [bin(a ^ b).count("1") <= simhash.DISTANCE for a, b in [[ngram_join.fingerprint_of(ngram_join.shingles(" ".join(t), 5)) & (1 << 64) - 1 for t in some] for some in (texts[:2], texts[1:])]] == [True, False]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert rows_of(corpus_pipeline.drop_near_copies(spark, docs, ""), "doc_id") == [(0,), (2,)]


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_wanted_rows_and_few_others_are_likely(spark, n):
    rows = spark.range(40000).selectExpr("id", "xxhash64(id) as hash")
    wanted = rows.where(f"id % 10 = 3 and id < {10 * n}").select("hash")
    got = likely(rows, wanted, "hash")
    assert got.columns == rows.columns and got.join(wanted, "hash", "left_semi").count() == n and got.count() <= n + 40000 * 0.08


def test_tables_are_written_from_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield ngram_join.pa.RecordBatch.from_arrays([ngram_join.pa.array([batch.num_rows]), ngram_join.pa.array([batch.nbytes])], ["n", "bytes"])

    long_texts = spark.range(0, 150, 1, 1).selectExpr("repeat('x', 200000) as text")
    got = written(long_texts.mapInArrow(sizes, "n long, bytes long"), "batches").collect()
    assert sum(r["n"] for r in got) == 150 and max(r["bytes"] for r in got) < 2 * BATCH_BYTES
    assert spark.conf.get(ARROW_BYTES, None) is None


def test_long_lists_of_one_pivot_come_to_an_end(spark, monkeypatch):
    np = ngram_join.np
    rounds, starred = [], ngram_join.starred

    def counted(*args):
        rounds.append(1)
        assert len(rounds) < 5
        return starred(*args)

    monkeypatch.setattr(ngram_join, "CELL", 4)
    monkeypatch.setattr(ngram_join, "starred", counted)
    # every list has the large set 0; no column is in most sets
    sets = {0: range(40)} | {1 + 6 * i + k: [i, *range(1000 * (1 + 6 * i + k), 1000 * (1 + 6 * i + k) + 9)] for i in range(10) for k in range(6)}
    sets[2] = [*list(sets[1])[:-1], 9999]
    held = spark.createDataFrame([(k, bytearray(np.array(sorted(c), np.uint64).tobytes())) for k, c in sets.items()], "key long, own binary")
    lists = spark.createDataFrame([(1, k, len(c), 0.0, len(sets), 0) for k, c in sets.items()], "sig long, key long, n long, share double, rows long, pivot long")
    links, pairs = ngram_join.without_pairs(lists, held, Fraction(4, 5))
    found = {(min(r), max(r)) for df in links for r in df.collect()} | {(min(r), max(r)) for df in pairs for r in df.collect()}
    assert (1, 2) in found and len(rounds) > 1


@pytest.mark.parametrize("s", [Fraction(4, 5), Fraction(9, 10), Fraction(1, 3), Fraction(1)])
def test_sets_whose_sizes_allow_the_similarity_share_a_band_and_others_few(s):
    of = {n: set(ngram_join.bands(n, s)) for n in range(1, 700)}
    assert all(of[n] & of[m] for n in of for m in range(n, 700) if n >= s * m)
    assert not any(of[n] & of[m] for n in of for m in range(n, 700) if n < s**3 * m - 3)


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_components_in_rounds_and_in_one_step_are_the_same(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rnd = random.Random(3)
    pairs = [(rnd.randrange(-200, 200), rnd.randrange(-200, 200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1030)] + [(7000, 7000)]
    root = {x: x for p in pairs[:-1] for x in p if p[0] != p[1]}
    for _ in range(len(root)):
        for a, b in pairs[:-1]:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()} == root


def test_the_stage_leaves_no_tables_but_its_result(spark):
    import os

    import corpus_pipeline

    before = set(os.listdir(folder := shared_folder(spark).removeprefix("file:")))
    docs = spark.createDataFrame(random_docs(random.Random(4))[:40], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert [x.rpartition("-")[0] for x in set(os.listdir(folder)) - before] == ["kept"]
    assert 0 < kept.count() < 41


def test_lists_of_one_passage_are_one_group(spark):
    # every list lacks a set or two of the 40 of its passage; the hub 0 is in all lists and names them
    rows = [(10 * p + c, 7, k, 20, 0.0, 39, 0) for p in range(1, 6) for c in range(10) for k in [0, *range(100 * p, 100 * p + 40)] if k != 100 * p + 30 + c]
    lists = spark.createDataFrame(rows, "sig long, group long, key long, n long, share double, rows long, pivot long")
    of = spark.createDataFrame([(7, 201)], "pivot long, rows long")
    got = ngram_join.smaller_groups(lists, of).select("sig", "pivot", "key").collect()
    assert sorted((r.sig, r.key) for r in got) == sorted((r[0], r[2]) for r in rows)
    assert 5 <= len({r.pivot for r in got}) <= 25


def test_small_groups_of_large_sets_make_pairs_in_the_first_round(spark, monkeypatch):
    np, rounds, starred = ngram_join.np, [], ngram_join.starred
    monkeypatch.setattr(ngram_join, "CELL", 4)
    monkeypatch.setattr(ngram_join, "starred", lambda *args: rounds.append(1) or starred(*args))
    sets = {0: range(400)} | {1 + 6 * i + k: [i, *range(1000 * (1 + 6 * i + k), 1000 * (1 + 6 * i + k) + 99)] for i in range(10) for k in range(6)}
    sets[2] = [*list(sets[1])[:-1], 99999]
    held = spark.createDataFrame([(k, bytearray(np.array(sorted(c), np.uint64).tobytes())) for k, c in sets.items()], "key long, own binary")
    lists = spark.createDataFrame([(1, k, len(c), 0.0, len(sets), 0) for k, c in sets.items()], "sig long, key long, n long, share double, rows long, pivot long")
    links, pairs = ngram_join.without_pairs(lists, held, Fraction(4, 5))
    assert (1, 2) in {(min(r), max(r)) for df in [*links, *pairs] for r in df.collect()} and len(rounds) == 1


def test_sets_of_many_texts_are_those_of_each(spark):
    np, pa = ngram_join.np, ngram_join.pa
    rnd = random.Random(2)
    odd = [None, "", " \t", "a", "A b", "a b c d e", "a b c d e a b c d e", "x" * 9 + " " + "y" * 300 + " " + "y" * 301 + " " + "x" * 8, "a\0 a b", "a a\0 b", "\u00c9 \u00e9 \x1c z", "w " * 90000 + "x"]
    texts = [*odd, *(" ".join(rnd.choice(["a", "bb", "C", "c", "longword" * rnd.randrange(1, 50)]) for _ in range(rnd.randrange(40))) for _ in range(300))]
    for size, column in [(3, pa.array(texts)), (5, pa.array(["no part of it", *texts]).slice(1))]:
        got, slow = ngram_join.sets_of(column, size), [slow_set(t, size) for t in texts]
        assert [len(x) for x in got] == [len(x) for x in slow] and all((x[1:] > x[:-1]).all() for x in got)
        for i, j in [(rnd.randrange(len(texts)), rnd.randrange(len(texts))) for _ in range(2000)]:
            assert len(np.intersect1d(got[i], got[j])) == len(slow[i] & slow[j])
        flat, sizes = np.concatenate(got), np.array([len(x) for x in got])
        bits = [np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0) for x in got]
        assert simhash.fingerprints_of(flat, sizes).tolist() == [int(np.packbits(2 * b > len(x), bitorder="little").view("<i8")[0]) for b, x in zip(bits, got, strict=True)]


@pytest.mark.parametrize("dense", [2, 1 << 11])
def test_shared_columns_are_those_of_all_pairs(monkeypatch, dense):
    np = ngram_join.np
    monkeypatch.setattr(ngram_join, "DENSE", dense)
    rnd = random.Random(7)
    for m, span in [(1, 5), (2, 9), (50, 40), (120, 3000)]:
        sets = [np.array(sorted({rnd.randrange(10) if rnd.random() < 0.2 else rnd.randrange(span) for _ in range(rnd.randrange(1, 60))}), np.uint64) for _ in range(m)]
        got = ngram_join.shared_columns(sets)
        assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(m) for j in range(m) if i != j)


@pytest.mark.parametrize("members", [0, 1024])
def test_groups_of_long_lists_that_fit_a_task_need_no_rounds(spark, monkeypatch, members):
    rounds, starred = [], ngram_join.starred
    monkeypatch.setattr(ngram_join, "CELL", 4)
    monkeypatch.setattr(ngram_join, "MEMBERS", members)
    monkeypatch.setattr(ngram_join, "starred", lambda *args: rounds.append(1) or starred(*args))
    rnd = random.Random(11)
    base = [f"h{i}" for i in range(120)]
    texts = [edited(rnd, base, rnd.randrange(9)) for _ in range(60)] + [[*base[:90], *[f"o{i}x{k}" for k in range(rnd.randrange(10, 60))]] for i in range(30)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = rows_of(ngram_join.placed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 0.8), "doc_id", "component_id")
    assert got == sorted(zip((i for i, _ in rows), slow_near(rows), strict=True), key=str)
    assert bool(rounds) == (not members)


def test_columns_of_several_sets_are_counted(spark):
    rnd = random.Random(12)
    sets = [(i, [*range(0, 2000, 1 + i % 7), rnd.getrandbits(62)]) for i in range(300)]
    counts = {}
    for _, columns in sets:
        for c in columns:
            counts[c] = counts.get(c, 0) + 1
    got = ngram_join.columns_of_several(spark.createDataFrame(sets, "key long, least array<long>").repartition(7)).collect()
    assert {r.sig: r.rows for r in got} == {c: n for c, n in counts.items() if n > 1} and len(got) == len({r.sig for r in got})
    wanted = ngram_join.bitmap(spark.createDataFrame([(c - (1 << 63),) for c in range(0, 9000, 3)], "sig long"))
    place = ngram_join.np.arange(0, 9000, 3) % (8 * len(wanted))
    assert (wanted[place >> 3] >> (place & 7) & 1).all() and ngram_join.np.bitwise_count(wanted).sum() <= 3000
