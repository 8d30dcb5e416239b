"""Chat formatting, top-k search, HTML extraction and the pipeline."""

import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankweave.llm import chat, html_text, queries, topk

TURNS = st.lists(st.tuples(st.tuples(st.sampled_from(["system", "user", "assistant", "a<b>\\"]), st.text(alphabet="ab<>\\/turn \n", max_size=20)), st.integers(1, 40)), min_size=1, max_size=25)


@settings(max_examples=200, deadline=None)
@given(TURNS)
def test_windows_hold_every_turn_and_target_once(turns):
    back, targets = [], []
    for shown, n_repeated, n in chat.windows(turns, 60, 20):
        text, spans = chat.write_turns(shown, n_repeated)
        assert chat.read_turns(text) == shown
        if turns[0][0][0] == "system":
            assert shown[0] == turns[0][0]
        assert n <= 60 or len(shown) - n_repeated <= 1 + (shown[0][0] == "system")
        back += shown[n_repeated:]
        targets += [chat.unescaped(text[s["start"] : s["end"]]) for s in spans]
    assert back == [t for t, _ in turns]
    assert targets == [t[1] for t, _ in turns if t[0] == "assistant"]


def test_chat_rows(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 1, "user", None), (2, None, None, "x"), (None, 1, "assistant", "</turn>\\"), (3, 1, "user", "w " * 9000), (3, 2, "assistant", "y")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df, tokenizer)).collect()}
    turns = {}
    for c, t, r, x in sorted(rows, key=lambda r: tuple((v is not None, v or 0 if i < 2 else v or "") for i, v in enumerate(r))):
        turns.setdefault(c, []).append((r or "", x or ""))
    for c, own in turns.items():
        said = "".join(x for r, x in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert len(got) == len(turns) and chat.format_conversations(df.where("false"), tokenizer).count() == 0
    assert chat.format_conversations(df, tokenizer).where("conv_id = 3").count() == 2
    library = Tokenizer.from_file(tokenizer)
    sized = chat.with_token_counts(df.select("conv_id", "turn", "role", "text"), tokenizer).collect()
    assert len(sized) == len(rows) and all(r.n_tokens == len(library.encode(chat.write_turns([(r.role or "", r.text or "")], 0)[0], add_special_tokens=False).ids) for r in sized)
    code = spark.createDataFrame([(7, i, r, "if (a < b) { x = '\\n' << 3; } " * 20) for i, r in enumerate(["system", *["user", "assistant"] * 9])], "conv_id long, turn long, role string, text string")
    shown = chat.format_conversations(code, tokenizer).collect()
    assert len(shown) > 1 and all(r.n_tokens == len(library.encode(r.formatted, add_special_tokens=False).ids) <= chat.BUDGET and not r.over_budget for r in shown)


def test_topk_is_the_sql(spark, data):
    got = sorted(tuple(r) for r in topk.op5_topk(spark, data).collect())
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    assert got == sorted(duckdb.sql(queries.SQL["op5_topk"]).fetchall())


@pytest.mark.parametrize("copies", [0, 1500])
@pytest.mark.parametrize("scale", [3, 40, 100_000])
def test_topk_of_a_block(copies, scale):
    rng = np.random.default_rng(copies + scale)
    v = rng.integers(-scale, scale + 1, (2000, 16)).astype(np.int64)
    v[100 : 100 + copies] = v[99]
    block, asked = topk.build(np.arange(2000), v), np.arange(0, 2000, 97)
    for q, (ids, scores) in enumerate(topk.search(block, asked, v[asked], 20)[0]):
        s = v @ v[asked[q]]
        s[asked[q]] = -(1 << 60)
        best = np.lexsort((np.arange(2000), -s))[:20]
        assert (ids == best).all() and (scores == s[best]).all()


def test_topk_stops_early_and_floors_leave_out_only_what_is_below(data):
    held = duckdb.sql(f"SELECT embedding FROM '{data.replace('sf0.01', 'sf0.1')}/embeddings.parquet' ORDER BY vec_id").fetchall()
    v = np.floor(64 * np.array([x for x, in held])).astype(np.int64)
    block, asked = topk.build(np.arange(len(v)), v), np.arange(0, len(v), 20)
    found, share = topk.search(block, asked, v[asked], 20)
    assert share < 0.85
    floors = np.array([scores[9] for _, scores in found])
    above, share_above = topk.search(block, asked, v[asked], 20, floors)
    assert share_above <= share
    for (ids, scores), (some, least), floor in zip(found, above, floors, strict=True):
        assert some.tolist() == ids[scores >= floor].tolist() and least.tolist() == scores[scores >= floor].tolist()


def test_topk_over_several_blocks(spark, data, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 150)
    test_topk_is_the_sql(spark, data)


def test_topk_of_odd_rows(spark):
    rows = [(0, [1.0, 0.5]), (20, [1.0, None]), (40, None), (1, [float("nan"), 1.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [1.0]), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]), (60, []), (80, [-1.0, 0.25])]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "vec_id long, embedding array<float>, score int, vector string")
    fit = df.select("vec_id", topk.integer_vector(F.col("embedding")).alias("vector"))
    got = sorted(tuple(r) for r in topk.top_k(fit, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 2, 3072), (0, 2, 2, 3072), (0, 3, 80, -3584), (80, 1, 2, -1536), (80, 2, 2, -1536), (80, 3, 0, -3584)]
    assert topk.top_k(fit.where("false"), F.col("vec_id") % 20 == 0).count() == 0


# ---- HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>H</header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">C</div>
<article><header><h1>Head &amp; more</h1></header><p>One <b>two</b>&nbsp;three<br>four<p>Five<div class="share">S</div><aside>A</aside><form>F</form>
<script>var t="</p>";</script><ul><li>six<li>seven</ul></article><section id="comments">R</section><footer>&copy; F</footer></body></html>"""


def test_main_text():
    assert html_text.extract(PAGE) == "Head & more\n\nOne two three four\n\nFive\n\nsix\n\nseven"


@pytest.mark.parametrize("page", ["", None, "<", "<a", "<a href='x", "<!--", "<script>", "</", "a<b", '<p class="', "&am", "<" * 3000, "<div>" * 3000, "<table><td>a<td>b</table>", "<p>" * 3000])
def test_broken_pages_do_not_raise(page):
    html_text.extract(page)


def test_broken_pages_as_browsers_read_them():
    assert html_text.extract("<p>a<p>b<!-- c") == "a\n\nb"
    assert html_text.extract("<article><p>a &amp b") == "a & b"
    assert html_text.extract("<table><td>a<td>b</table>") == "a\n\nb"


def test_wrapper_of_a_host(spark):
    rnd = random.Random(1)

    def words(n):
        return " ".join(rnd.choice("abcdefghij") * rnd.randrange(2, 7) for _ in range(n))

    texts, rows = {}, []
    for i in range(14):
        parts = [words(4), *[words(20) for _ in range(rnd.randrange(1, 9))]]
        texts[i] = "\n\n".join(parts)
        body = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{p}" for p in parts[1:])
        rows.append((i, f"http://h.example/{i}", f"<html><body><div>Welcome here</div><div><span>Home</span>{body}<p>Read more on our pages</div><div>All rights kept</div></body></html>"))
    rows += [(50 + i, "http://copies.example/", "<body><p>alike in all</body>") for i in range(9)] + [(90, None, "<p>x"), (91, "http://h.example/", None), (None, "u", "<p>y")]
    df = spark.createDataFrame([(*r, "z", "t") for r in rows], "page_id long, url string, html string, text string, host string").repartition(3)
    got = {r.page_id: r for r in html_text.extract_pages(df).collect()}
    assert all(got[i].text == t and got[i].n_chars == len(t) for i, t in texts.items())
    assert all(got[50 + i].text == "alike in all" for i in range(9))
    assert (got[90].text, got[91].text, got[None].text) == ("x", "", "y")
    assert html_text.extract_pages(df.where("false")).count() == 0


def test_pages_of_the_table(spark, data):
    rows = html_text.op8_html(spark, data).collect()
    assert len(rows) == spark.read.parquet(f"{data}/pages.parquet").count() and all(r.n_chars == len(r.text) and "<p>" not in r.text for r in rows)


# ---- all queries, and the pipeline against brute force


def test_pipeline(spark, data):
    import corpus_pipeline
    from test_near_copies import slow_near
    from test_text_operators import slow_cut

    from rankweave.llm import toxicity

    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if not scores[r.doc_id])
    rows = [r for r, c in zip(rows, slow_near(rows), strict=True) if r[0] == c]
    left = {i: n - gone for i, n, gone, _ in slow_cut(rows)}
    pieces = corpus_pipeline.run(spark, data).collect()
    assert {p.doc_id for p in pieces} == {i for i, n in left.items() if n}
    for doc_id in {p.doc_id for p in pieces}:
        own = [p for p in pieces if p.doc_id == doc_id]
        assert sum(p.length for p in own) == own[0].doc_tokens
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, data)
        assert at.columns == docs.columns


def test_registered():
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES if q != "pipeline"}
