"""Operators on documents against brute-force versions and exact round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rankweave.llm import bpe, components, packing, simhash, substrings, token_store, toxicity, transport_stream
from rankweave.llm.units import UnitMemo, library_memo

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PIECES = [" ", " ", "  ", "\n", "\n ", "a", "bc", "'s", "'", "1", "é", "́", " ", "　", ".", ",", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x85", "Σ", "İ", "👍", "​", "\t", "你好", "\r\n", "क़"]
odd_text = st.lists(st.sampled_from(PIECES), max_size=14).map("".join)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def text_of(rows):
    return {i: t or "" for i, t in rows}


# ---- units and BPE


@settings(max_examples=300, deadline=None)
@given(odd_text)
def test_units_give_the_librarys_ids(text):
    for path, joined in ((BYTES, True), (WORDS, False)):
        assert library_memo(path, joined).ids([text])[0].tolist() == library(path).encode(text, add_special_tokens=False).ids


_LIBRARY = {}


def library(path):
    return _LIBRARY.setdefault(path, Tokenizer.from_file(path))


def test_a_full_memo_forgets_without_changing_ids():
    memo = UnitMemo(library_memo(BYTES, True).encode, joined=True, full=20)
    rnd = random.Random(4)
    for _ in range(30):
        texts = [" ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 4) + rnd.choice(["", ",", ".", "!"]) for _ in range(9)) for _ in range(3)]
        assert [x.tolist() for x in memo.ids(texts)] == [library(BYTES).encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.one_of(odd_text, st.text(max_size=30)))
def test_segment_tree_bpe_is_the_librarys(text):
    own = bpe.coder(BYTES)
    ids = own.encode([text])[0]
    assert ids.tolist() == library(BYTES).encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == library(BYTES).decode(ids.tolist(), skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=12))
def test_decoding_any_ids(ids):
    assert bpe.coder(BYTES).decode(np.array(ids, np.int64)) == library(BYTES).decode(ids, skip_special_tokens=False)


def test_bpe_digests(odd_docs, no_docs):
    want = []
    for i, t in ((r.doc_id, r.text or "") for r in odd_docs.collect()):
        ids = library(BYTES).encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library(BYTES).decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows_of(bpe.digests(odd_docs, BYTES), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    assert bpe.digests(no_docs, BYTES).count() == 0 and bpe.encode_decode(odd_docs, BYTES).where("size(ids) = 0 and decoded = ''").count() == 3


# ---- token store


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
    assert (token_store.from_planes(token_store.to_planes(ids, kind), n, kind) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_store(spark, odd_docs, no_docs, tmp_path, kind, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_IDS", 5000)
    token_store.write_store(odd_docs, str(tmp_path / "s"), BYTES, kind)
    at, want = 0, []
    hashed = [(r.doc_id, r.hash, r.text) for r in odd_docs.selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS hash").collect()]
    for i, _, t in sorted(hashed, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:])):
        ids = [*library(BYTES).encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert rows_of(token_store.read_store(spark, str(tmp_path / "s"), kind), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)
    token_store.write_store(no_docs, str(tmp_path / "e"), BYTES, kind)
    assert token_store.read_store(spark, str(tmp_path / "e"), kind).count() == 0


# ---- packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 700), max_size=60))
def test_packing_places_every_token_once(sizes):
    seqs = list(packing.pack(enumerate(sizes), capacity=128, piece=32, windows=4, reserve=4))
    seen = {i: np.zeros(n, int) for i, n in enumerate(sizes)}
    for s in seqs:
        assert 0 < sum(p[2] for p in s) <= 128
        for key, start, length, _ in s:
            seen[key][start : start + length] += 1
    assert all((v == 1).all() for v in seen.values())


def test_windows_are_near_equal_and_rise_in_number():
    rnd = random.Random(1)
    sizes = [rnd.randrange(1, 500) for _ in range(300)]
    sums = [sum(sizes[i] for i in s) for s in packing.difference(sizes, 16)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 3
    assert len(packing.windows_of([60, 60, 60], 100, 2)) == 3


def test_pieces(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, WORDS).collect()
    assert packing.pack_documents(no_docs, WORDS).count() == 0
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    want = sum(len(library(WORDS).encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd_docs.collect())
    assert sum(r.length for r in rows) == want
    for r in odd_docs.where("doc_id = 4").collect():
        ids = np.array([*library(WORDS).encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        for p in (p for p in rows if p.doc_id == 4):
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())


# ---- transport streams


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 3071, 3072, 3073, 3072 * 4, 3072 * 4 + 1, 40_000])
def test_stream_round_trip(n):
    payload = transport_stream.payload_of("G" * n)
    s = transport_stream.parse_stream(transport_stream.to_stream(payload))
    assert s.payload == payload and (s.discontinuities, s.bad_tables, s.duplicates, s.lost_sync) == (0, 0, 0, 0)
    times = [u[0] for u in s.units]
    assert times == [90_000 + 3600 * k for k in range(len(times))] and [u[1] for u in s.units] == [k % 4 == 0 for k in range(len(times))]


def test_damaged_streams_are_noticed():
    data = transport_stream.to_stream(transport_stream.payload_of("x" * 20_000))
    lost = data[: 188 * 10] + data[188 * 11 :]
    assert transport_stream.parse_stream(lost).discontinuities == 1
    assert transport_stream.parse_stream(data[: 188 * 10] + data[188 * 9 :]).duplicates == 1
    broken = bytearray(data)
    broken[10] ^= 1
    assert transport_stream.parse_stream(bytes(broken)).bad_tables == 1
    assert transport_stream.parse_stream(b"junk" + data).lost_sync == 1
    assert transport_stream.parse_stream(b"").payload == b""


def test_no_damage_raises():
    data = transport_stream.to_stream(transport_stream.payload_of("x" * 9_000))
    rnd = random.Random(8)
    for _ in range(400):
        broken = bytearray(data)
        for _ in range(rnd.choice([1, 3, 40])):
            broken[rnd.randrange(len(broken))] ^= 1 << rnd.randrange(8)
        transport_stream.parse_stream(bytes(broken[rnd.randrange(300) : len(broken) - rnd.randrange(300)]))
    lost = transport_stream.parse_stream(data[: 188 * 10] + data[188 * 11 :])
    assert lost.bad_units == 1 and [u[3] for u in lost.units].count(False) == 1
    short = bytes([0x47, 0x41, 0, 0x30, 170]) + b"\0" * 170 + b"\0\0\1\xbd\0\0\x80\x80\5\x21\0\1\0"
    assert transport_stream.parse_stream(data[: 188 * 2] + short + data[188 * 2 :]).packets == len(data) // 188 + 1


def test_many_tiny_documents_and_texts_without_spaces(monkeypatch):
    monkeypatch.setattr("rankweave.llm.units.CHARS", 1 << 18)
    monkeypatch.setattr("rankweave.llm.units.ODD_CHARS", 1 << 17)
    began = __import__("time").monotonic()
    seqs = list(packing.pack((i, 1) for i in range(200_000)))
    assert sum(p[2] for s in seqs for p in s) == 200_000 and __import__("time").monotonic() - began < 30
    memo = UnitMemo(library_memo(BYTES, True).encode, joined=True)
    rnd = random.Random(9)
    for _ in range(12):
        texts = ["".join(rnd.choice("ab你好") for _ in range(2_000)) for _ in range(20)]
        got = memo.ids([f"{t} {t[::-1]}" for t in texts])
        assert memo.places.chars < (1 << 18) + 40_000 and memo.odd_chars < (1 << 17) + 80_000
    assert got[1].tolist() == library(BYTES).encode(f"{texts[1]} {texts[1][::-1]}", add_special_tokens=False).ids


def test_media_rows(odd_docs, no_docs):
    got = transport_stream.read_media(transport_stream.store_media(odd_docs)).collect()
    want = {}
    for r in odd_docs.collect():
        p = transport_stream.payload_of(r.text)
        want.setdefault((r.doc_id, hashlib.sha256(p).hexdigest()), (len((r.text or "").encode()), len(p), zlib.crc32(p[-16:])))
    assert len(got) == odd_docs.count() and all(want[r.doc_id, r.payload_sha256] == (r.n_bytes, r.payload_bytes, r.tail_crc32) for r in got)
    assert transport_stream.read_media(transport_stream.store_media(no_docs)).count() == 0


# ---- SimHash


def slow_print(text):
    import xxhash

    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and (a := find(i)) != (b := find(j)):
                root[max(a, b)] = min(a, b)
    smallest = {}
    for i, x in enumerate(ids):
        if x is not None:
            smallest[find(i)] = min(x, smallest.get(find(i), x))
    return [smallest.get(find(i)) for i in range(len(ids))]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB \n\té\x1c", max_size=30))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_print(text)


def test_components_of_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    prints = [slow_print(t) for _, t in rows]
    want = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, slow_components([i for i, _ in rows], prints), strict=True)), key=str)
    assert rows_of(simhash.near_duplicates(odd_docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({c for _, _, c in want if c is not None})


def test_texts_that_share_an_id_are_not_lost(spark):
    rows = [(1, "one two three four"), (1, "one two three four"), (1, "quite another text here"), (2, "one two three four"), (3, None)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(kept, "doc_id", "text") == sorted([rows[0], rows[2], rows[4]], key=str)


@pytest.mark.parametrize("cell", [2, 6, 48])
def test_dense_cells_lose_no_link(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    monkeypatch.setattr(simhash.compare, "__defaults__", (cell,))
    rnd = random.Random(cell)
    base = rnd.getrandbits(64)
    prints = [base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 5))) for _ in range(150)] + [rnd.getrandbits(64) for _ in range(50)]
    for _ in range(60):
        prints.append(prints[-1] ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64))
    docs = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "doc_id long, fp long")
    got = [r.component_id for r in simhash.near_duplicates(docs).orderBy("doc_id").collect()]
    assert got == slow_components(list(range(len(prints))), prints)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (900, 800)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 800: 800, 900: 800}


# ---- substrings


def slow_cut(rows):
    words = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()) for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - 49):
            if i is not None:
                key = tuple(w[s : s + 50])
                first[key] = min(i, first.get(key, i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = bytearray(len(w))
        for s in range(len(w) - 49):
            if i is not None and first[tuple(w[s : s + 50])] < i:
                gone[s : s + 50] = b"\1" * 50
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_random_passages(spark, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(45, 160))] for _ in range(8)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rnd.randrange(0, 4)):
            p = rnd.choice(passages)
            w += p[rnd.randrange(0, 30) : len(p) - rnd.randrange(0, 30)] if rnd.random() < 0.7 else [str(rnd.random())] * rnd.choice([1, 60])
            w += [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 0, 3, 30]))]
            w += ["same"] * rnd.choice([0, 0, 49, 50, 51, 200])
        rows.append((rnd.choice([i, i, i, 7]), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(substrings.digests(df), "doc_id", "n_words", "n_removed", "kept_sha256") == slow_cut(rows)


def test_repeats_of_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows_of(substrings.digests(odd_docs), "doc_id", "n_words", "n_removed", "kept_sha256") == slow_cut(rows)
    assert substrings.digests(no_docs).count() == 0
    cut = substrings.without_repeats(odd_docs)
    assert cut.columns == odd_docs.columns and cut.where("doc_id = 5").count() == 0 and cut.count() == odd_docs.count() - 2


# ---- toxicity


def test_toxicity_learns_and_keeps_the_held_out_out(spark, data):
    docs, labels = (spark.read.parquet(f"{data.replace('sf0.01', 'sf0.1')}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    held = toxicity.score_documents(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = held[held.toxic == 0].score.to_numpy(), held[held.toxic == 1].score.to_numpy()
    assert (bad[:, None] > good[None]).mean() > 0.95
    assert (bad >= 0.3).mean() > 0.85 and (good >= 0.3).mean() < 0.02
    held_ids = {r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert set(held.doc_id) == held_ids
    flipped = labels.withColumn("toxic", __import__("pyspark").sql.functions.expr("if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - toxic, toxic)"))
    again = toxicity.train(docs, flipped)
    assert (again.buckets == model.buckets).all() and np.allclose(again.weights, model.weights)


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 0), (6, None), (None, 1), (8, 0), (9, 1)], "doc_id long, toxic int")
    scored = toxicity.score_documents(odd_docs, toxicity.train(odd_docs, labels)).collect()
    assert len(scored) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored)
    nothing = toxicity.train(odd_docs, labels.where("false"))
    kept = toxicity.without_toxic(odd_docs, nothing)
    assert nothing.bias is None and kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert toxicity.score_documents(no_docs, nothing).count() == 0


def test_scores_do_not_depend_on_slices(monkeypatch):
    model = toxicity.Model(np.arange(0, 1 << 20, 7), np.ones(len(range(0, 1 << 20, 7)), np.float32), 0.1)
    texts = ["héllo wörld " * 9, "", "ab", None, "x" * 3000]
    whole = model.score(texts, model.dense())
    assert np.allclose(whole, [model.score([t], model.dense())[0] for t in texts])
    monkeypatch.setattr(toxicity, "SLICE", 50)
    assert np.allclose(whole, model.score(texts, model.dense()))
