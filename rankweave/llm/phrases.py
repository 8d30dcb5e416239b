"""Phrase collocations: word sequences that occur together more often than their parts suggest.

Texts are cut into pieces at punctuation and line ends. Identical pieces become one row with a multiplicity, and all counting is done on these. Pieces of more
than ``PIECE`` words are cut into overlapping rows, each of which owns the phrases that begin in its first ``PIECE`` words; so a row is bounded and no
phrase is lost or counted twice.

Phrases are counted by size: words, then pairs of words that may all be frequent, then phrases of three and four words whose pairs may all be frequent
(a phrase is no more frequent than its parts). For this a filter of the frequent words or pairs is sent to the tasks: hash bits of a bounded size, which may
let others pass but never stop a frequent one, so all counts stay exact. Tasks add up the phrases of their pieces before they leave them; the sums go to hash buckets, and
each bucket is counted by duckdb with bounded memory, out of core where it needs to be, in a scratch folder that ends with the task. Phrases are
counted as strings with their language, not by hashes.

A candidate needs the counts of its parts, which lie in other buckets: every cut sends two requests to where the parts are, and the answers come back
to the candidate. Parts of very many candidates (a frequent word) are looked up by broadcast, so that no task gets all requests for one.

Null texts are empty; a null lang counts as ``und``. Empty texts and pieces have no words. Rows count as often as they are there, whatever their ids; further columns are
left out; an empty table gives no rows. Nothing is capped but the report itself.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.llm.shared import HOT_SHARE, idle, in_small_batches, looked_up, table, written

LONGEST = 4
LEAST = 30
FIRST = 2000
SCALE = 2_000_000
INSIDE = 80
#: Words of a piece that one row owns.
PIECE = 256
#: Words and distinct pieces that a task adds up before it hands them on.
WORDS_AT_ONCE = 1 << 20
PIECES_AT_ONCE = 1 << 16
#: A filter of frequent phrases has so many bits for each, and at most 2 ** this.
FILTER_BITS, FILTER_MOST = 16, 27
BUCKET_MB = 256
SALTS = 64
GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("size", pa.int32()), ("n", pa.int64())])

#: A-Z in lower case, all that cuts as a line end, tabs as spaces.
PLAIN = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 9 + b" ")


def pieces_of(text: str | None) -> Iterator[tuple[bytes, int]]:
    """Each piece of a text, its words joined by one space, and how many it has; pieces without words are left out."""
    for piece in (text or "").encode("utf-8").translate(PLAIN).split(b"\n"):
        if piece := piece.strip(b" "):
            if b"  " in piece:
                piece = b" ".join(piece.split())
            yield piece, piece.count(b" ") + 1


def distinct_pieces(docs: DataFrame, size: int = PIECE) -> DataFrame:
    """(lang, words, own, n): distinct pieces, how many of their first words they own, how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            langs, words, own = zip(*seen, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(own, pa.int32()), pa.array(seen.values(), pa.int64())], ["lang", "words", "own", "n"])
            seen.clear()
            return out

        for batch in in_small_batches(batches, 1):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece, n in pieces_of(text):
                    if n <= size:
                        seen[lang, piece, n] += 1
                    else:
                        words = piece.split()
                        for at in range(0, n, size):
                            seen[lang, b" ".join(words[at : at + size + LONGEST - 1]), min(size, n - at)] += 1
                    if len(seen) >= PIECES_AT_ONCE:
                        yield rows()
        if seen:
            yield rows()
        idle()

    made = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, "lang string, words string, own int, n long")
    return made.groupBy("lang", "words", "own").agg(F.sum("n").alias("n"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _word_hashes(words: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def _places(lang: np.ndarray, words: list[np.ndarray], bits: int) -> np.ndarray:
    """The places of one or more words of a language, as hashes, in a filter of 2 ** bits bits."""
    x = _mixed(lang)
    for word in words:
        x = _mixed(x ^ word) + np.uint64(1)
    return _mixed(x) & np.uint64((1 << bits) - 1)


@dataclass(frozen=True)
class Filter:
    """Hash bits of phrases of ``size`` words."""

    size: int
    bits: int
    held: np.ndarray

    def has(self, lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        at = _places(lang, words, self.bits)
        return self.held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1


def filter_of(counts: DataFrame, size: int) -> Filter:
    """Of phrases (lang, gram) of ``size`` words each; 16 MB at most."""
    bits = min(FILTER_MOST, max(16, (FILTER_BITS * counts.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = _word_hashes(pc.list_flatten(pc.split_pattern(batch.column(1), " ")))
                at = _places(_word_hashes(batch.column(0)), [words[k::size] for k in range(size)], bits)
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bit"])

    held = counts.select("lang", "gram").mapInArrow(run, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[held.column(0).to_numpy()] = held.column(1).to_numpy().view(np.uint64)
    return Filter(size, bits, out)


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys: where each stands first, and the sum of ``n`` over it."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return order[starts], np.add.reduceat(n[order], starts)


def phrase_counts(lang: pa.Array, words: pa.Array, own: np.ndarray, n: np.ndarray, sizes: tuple[int, ...], passes: Filter | None = None) -> Iterator[pa.RecordBatch]:
    """(lang, gram, size, n): the phrases of some pieces, added up. With ``passes``, those with a part of its size that isn't in this filter are left out."""
    lists = pc.split_pattern(words, " ")
    lengths = pc.list_value_length(lists).to_numpy()
    if not len(lengths):
        return
    flat, langs = pc.list_flatten(lists).dictionary_encode(), lang.dictionary_encode()
    codes, lang_codes = flat.indices.to_numpy().astype(np.int64), np.repeat(langs.indices.to_numpy().astype(np.int64), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left, owned, n = np.repeat(lengths, lengths) - place, place < np.repeat(own, lengths), np.repeat(n, lengths)
    if passes is not None:
        hashes, of_lang = _word_hashes(flat.dictionary), _word_hashes(langs.dictionary)
        fine = np.zeros(len(codes), bool)
        at = np.flatnonzero(left >= passes.size)
        fine[at] = passes.has(of_lang[lang_codes[at]], [hashes[codes[at + k]] for k in range(passes.size)])
    vocabulary = len(flat.dictionary)
    for size in sizes:
        at = np.flatnonzero(owned & (left >= size))
        if passes is not None:
            for k in range(size - passes.size + 1):
                at = at[fine[at + k]]
        if not len(at):
            continue
        # a number for the phrase at each place, equal for equal phrases; numbered anew where the next word would pass 63 bits
        same, most = lang_codes[at], len(langs.dictionary)
        for k in range(size):
            if most * vocabulary >= 1 << 62:
                same = np.unique(same, return_inverse=True)[1]
                most = len(at)
            same, most = same * vocabulary + codes[at + k], most * vocabulary
        firsts, sums = _added(same, n[at])
        at = at[firsts]
        parts = [flat.dictionary.take(pa.array(codes[at + k])) for k in range(size)]
        gram = parts[0] if size == 1 else pc.binary_join_element_wise(*parts, " ")
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang_codes[at])), gram, pa.array(np.full(len(at), size, np.int32)), pa.array(sums)], ["lang", "gram", "size", "n"])


def phrases(pieces: DataFrame, sizes: tuple[int, ...], passes: Filter | None = None) -> DataFrame:
    """(lang, gram, size, n): phrases of ``pieces``, added up by task as far as they fit."""
    shared = pieces.sparkSession.sparkContext.broadcast(passes) if passes is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        words = 0

        def rows() -> Iterator[pa.RecordBatch]:
            some = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            columns = [some.column(c).combine_chunks() for c in ("lang", "words", "own", "n")]
            yield from phrase_counts(columns[0], columns[1], columns[2].to_numpy(), columns[3].to_numpy(), sizes, shared.value if shared is not None else None)

        for batch in in_small_batches(batches, 1):
            held.append(batch)
            words += pc.sum(pc.add(batch.column(2), LONGEST)).as_py() or 0
            if words >= WORDS_AT_ONCE:
                yield from rows()
                words = 0
        if held:
            yield from rows()
        idle()

    return pieces.select("lang", "words", "own", "n").mapInArrow(run, "lang string, gram string, size int, n long")


def frequent(grams: DataFrame, least: int = LEAST, memory_mb: int = BUCKET_MB) -> DataFrame:
    """(lang, gram, size, n): the phrases that occur ``least`` times; each hash bucket is counted by duckdb, out of core beyond ``memory_mb``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # what doesn't fit is kept with the task, as Spark's own spills are: it goes when the task ends, and a lost executor's task starts anew
        with tempfile.TemporaryDirectory() as scratch, duckdb.connect(config={"memory_limit": f"{memory_mb}MB", "threads": 1, "temp_directory": f"{scratch}/spill", "preserve_insertion_order": False}) as db:
            db.register("arrived", pa.RecordBatchReader.from_batches(GRAMS, (pa.RecordBatch.from_arrays(batch.columns, schema=GRAMS) for batch in batches)))  # a stream, read once
            counted = db.sql(f"select lang, gram, any_value(size) as size, sum(n)::bigint as n from arrived group by lang, gram having sum(n) >= {least}")
            for batch in counted.to_arrow_reader(1 << 16):
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1).cast(pa.string()), batch.column(2), batch.column(3)], ["lang", "gram", "size", "n"])
        idle()

    return grams.repartition("lang", "gram").mapInArrow(run, "lang string, gram string, size int, n long")


def _exact(product: Column) -> Column:
    return product.cast("decimal(38,0)")


def with_scores(counts: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of all candidates among ``counts`` (lang, gram, size, n): the cut with the lowest score, the first of these."""
    candidates = counts.where("size > 1").select("lang", F.col("gram").alias("phrase"), "size", F.col("n").alias("a"))
    split = F.split("phrase", " ", -1)
    cut = candidates.select("lang", "phrase", "size", "a", split.alias("of"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    left = F.array_join(F.slice("of", F.lit(1), F.col("k")), " ")
    right = F.array_join(F.slice("of", F.col("k") + 1, F.col("size") - F.col("k")), " ")
    requests = cut.select("lang", "phrase", "size", "a", "k", F.explode(F.array(F.struct(left.alias("gram"), F.lit(True).alias("is_left")), F.struct(right.alias("gram"), F.lit(False).alias("is_left")))).alias("part")).select("lang", "part.gram", "part.is_left", "phrase", "size", "a", "k")
    requests = written(requests, "requests")
    asked = requests.groupBy("lang", "gram").agg(F.count("*").alias("asked"))
    values = counts.select("lang", "gram", F.col("n").alias("f")).join(asked, ["lang", "gram"])
    answers = looked_up(requests, values, ["lang", "gram"], max(1, requests.count() // HOT_SHARE), "asked")
    by_cut = answers.groupBy("lang", "phrase", "size", "a", "k").agg(F.max(F.when(F.col("is_left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("is_left"), F.col("f"))).alias("r"))
    # a is at most l and r, so a score fits; products may not
    score = F.expr(f"(cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = by_cut.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def outside_longer(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates whose words aren't part of a longer candidate that is nearly as frequent."""
    longer = counts.where("size > 2").select("lang", F.split("gram", " ", -1).alias("of"), "size", "n")
    spans = F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.col("size") - s + 1), lambda i: F.array_join(F.slice("of", i, s), " ")))
    inside = longer.select("lang", F.explode(F.flatten(spans)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = F.col("longer").isNull() | (_exact(F.col("longer")) * 100 < _exact(F.col("a")) * INSIDE)
    return candidates.join(inside, ["lang", "phrase"], "left").where(kept).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """The ``first`` collocations of each language: lang, rank, phrase, a, l, r, n, score."""
    pieces = written(distinct_pieces(docs), "pieces")
    totals = pieces.groupBy("lang").agg(F.sum(F.col("own").cast("long") * F.col("n")).alias("n"))
    words = written(frequent(phrases(pieces, (1,)), least), "frequent-words")
    pairs = written(frequent(phrases(pieces, (2,), filter_of(words, 1)), least), "frequent-pairs")
    longer = written(frequent(phrases(pieces, (3, 4), filter_of(pairs, 2)), least), "longer-phrases")
    counts = words.unionByName(pairs).unionByName(longer)
    kept = outside_longer(with_scores(counts), counts)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # the first of each part of a language, then the first of these
    part = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)
    ranked = best.drop("rank", "part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL = f"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_LETTERS}), '[.,;:!?\\x0A-\\x0D]')) as piece from documents
), worded as (
  select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces
), distinct_pieces as (select lang, w, count(*) as c from worded where len(w) > 0 group by all),
totals as (select lang, sum(len(w) * c)::bigint as n from distinct_pieces group by lang),
counts as (
  select lang, size, gram, sum(c)::hugeint as f from (
    select lang, c, size, array_to_string(w[i:i + size - 1], ' ') as gram from (
      select lang, c, w, size, unnest(range(1, len(w) - size + 2)) as i from distinct_pieces, (select unnest([1, 2, 3, 4]) as size) where size <= len(w)
    )
  ) group by all having sum(c) >= {LEAST}
), cuts as (
  select c.lang, c.gram, c.size, c.f as a, k, x.f as l, y.f as r, {SCALE} * c.f // (x.f + y.f) as score
  from (select *, string_split(gram, ' ') as w, unnest(range(1, size)) as k from counts where size > 1) c
  join counts x on x.lang = c.lang and x.size = k and x.gram = array_to_string(c.w[1:k], ' ')
  join counts y on y.lang = c.lang and y.size = c.size - k and y.gram = array_to_string(c.w[k + 1:], ' ')
), lowest as (select * from cuts qualify row_number() over (partition by lang, gram order by score, k) = 1),
inside as (
  select lang, part, max(f) as f from (
    select lang, f, array_to_string(w[i:i + s - 1], ' ') as part
    from (select lang, f, w, s, unnest(range(1, size - s + 2)) as i from (select *, string_split(gram, ' ') as w, unnest(range(2, size)) as s from counts where size > 2))
  ) group by all
), ranked as (
  select c.*, row_number() over (partition by c.lang order by score desc, a desc, c.gram) as rank from lowest c left join inside i on i.lang = c.lang and i.part = c.gram
  where i.f is null or 100 * i.f < {INSIDE} * c.a
)
select r.lang, rank, gram as phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ranked r join totals t on t.lang = r.lang where rank <= {FIRST}
"""
