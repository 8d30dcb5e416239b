"""Documents joined by the Jaccard similarity of their word n-grams, exactly, as a blocked product of the sparse matrix of documents by n-grams.

A text is the set of its word n-grams (64-bit hashes), a row of the matrix; equal sets are one row. What is asked for are the entries of the product of the
matrix with its transpose that reach a bound: of two rows of n and m n-grams that reach the similarity s, at least s / (1 + s) * (n + m) are shared, and the sizes differ
by a factor of s at most. So in any order of the columns two such rows share one of the first n - s * n + 1 of each: only these columns make candidates.
Of the candidates, those whose parities of column counts in groups of columns differ in more places than two such rows may differ in columns go at once. The rest is
multiplied out in blocks of columns: overlaps add up block by block, and a pair goes when what it has and what is left can't reach its bound.

The order of columns keeps lists short. Columns that many rows have among their least hashes come last, in an order that is the same for all rows. Rows that still meet in
long lists are ordered again by how many of these rows have a column, so that a row's own columns come first. The lists of columns that are common even then are split by
the sizes of sets: each set is filed in the band of its size and in the next one, which leaves together all whose sizes allow the similarity. Lists that are long after that hold rows
nearly all of whose columns are common: groups of near copies. There no pairs are made. Such rows are taken as their differences from a template p, the columns that most of some of the rows
have; D(x) is the size of a row's difference. With g(x) = D(x) - (1 - s) / (1 + s) * n(x), rows x and y reach the similarity if and only if g(x) + g(y) is at most twice what
their differences share, whatever p is. The row y of least g is linked with all x for which g(x) + g(y) <= 0; any two rows with g(x) + g(z) <= 0 are joined through it. All others
that reach the similarity share something in their differences: these are sparse, and are joined by the same rules (long lists get templates of their own; a template's
rows are always fewer than those of the one before, so this ends). So a group
costs as many rows as it has members, no link that decides a component is lost, and nothing is dropped or capped; whatever the order or the templates, components are the same.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. A text of fewer words than an n-gram is one n-gram; texts without words (null, empty) are the empty set.
Rows with a null doc_id take part, but are never the smallest id of a component; rows that repeat an id are told apart by their texts; further
columns are left out; an empty table gives no rows. Sets and n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.llm.components import components
from rankweave.llm.shared import BITMAP_BITS, BITMAP_KEYS, BITMAPS, HOT_SHARE, dropped, idle, in_small_batches, likely, looked_up, map_batches, table, written
from rankweave.llm.simhash import fingerprint_of, fingerprints_of, with_components  # noqa: F401
from rankweave.llm.simhash import links as grid_links

SIZE, SIMILARITY = 3, 0.9
#: Lists of at most so many rows make pairs.
CELL = 16
#: Groups that lists of a round name make pairs if they have at most so many rows, and no more pairs than an eighth of their columns: these needn't move then.
GROUP = 128
#: A group is multiplied out in one task if it has at most so many members, and members times columns; blocks of so many columns at a time. How often the columns of sets may move for that.
MEMBERS, PRODUCT, DENSE, MOVED = 1024, 1 << 28, 1 << 11, 8
#: At most so many columns are known to all tasks as common (32 MB); where more are, the most frequent ones.
COMMON = 1 << 22
#: Groups of columns of a short row's parities.
GROUPS = 512
#: Column blocks of the product.
BLOCKS = 8
#: A template comes from at most so many of its rows; which ones changes the path only. One copy of it meets so many rows.
SAMPLE = 9
SPREAD = 1024
#: Bytes of texts that are cut into words together, and of a word that is hashed by itself.
TEXTS, LONG = 1 << 18, 256
#: A-Z lower-cased, white space as spaces.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")
ELEMENTS = 1 << 21
FILED = "sig long, key long, n long, share double, common boolean"


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Well spread 64-bit hashes of 64-bit numbers."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_hashes(raw: bytes, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts that lie one after the other in ``raw``, and how many words lie before each of the places ``begins``, where a text begins or the last
    one ends. A word is taken eight bytes at a time, all words together."""
    import xxhash

    raw = raw.translate(LOWER) + b" " * 8
    word = np.frombuffer(raw, np.uint8) != 32
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[begins] = word[begins]
    last = word.copy()
    last[:-1] &= first[1:] | ~word[1:]
    at, lengths = np.flatnonzero(first), np.flatnonzero(last) + 1
    lengths -= at
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    out = mixed(mixed(lengths.astype(np.uint64), 5) ^ eight[at] & mask[np.minimum(lengths, 8)])
    more, k = np.flatnonzero((lengths > 8) & (lengths <= LONG)), 8
    while len(more):
        out[more] = mixed(out[more] ^ eight[at[more] + k] & mask[np.minimum(lengths[more] - k, 8)])
        k += 8
        more = more[lengths[more] > k]
    for i in np.flatnonzero(lengths > LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[at[i] : at[i] + lengths[i]])
    return out, np.searchsorted(at, begins)


def shingled(texts: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct n-grams of some texts as hashes, and how many each of them has, for a few texts at a time; those of a text are sorted."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + TEXTS, "right")) - 1)
        raw = texts.buffers()[2][int(ends[at]) : int(ends[to])].to_pybytes() if ends[to] > ends[at] else b""
        words, bounds = word_hashes(raw, ends[at : to + 1] - ends[at])
        at = to
        counts = np.diff(bounds)
        n = max(0, len(words) - size + 1)
        grams = np.zeros(n, np.uint64)
        for k in range(size):
            grams = mixed(grams ^ words[k : k + n])
        whole = (np.arange(len(words)) + size <= np.repeat(bounds[1:], counts))[:n]  # those that end within the text
        few = (counts > 0) & (counts < size)
        short = np.zeros(few.sum(), np.uint64)
        for k in range(size):
            short = mixed(short ^ np.where(counts[few] > k, words[np.minimum(bounds[:-1][few] + k, len(words) - 1)], np.uint64(0))) if len(short) else short
        sizes = np.where(few, 1, np.maximum(counts - size + 1, 0))
        of_few = np.repeat(few, sizes)
        out = np.empty(len(of_few), np.uint64)
        out[of_few], out[~of_few] = short, grams[whole]
        stops = np.cumsum(sizes)
        for a, b in zip((stops - sizes).tolist(), stops.tolist(), strict=True):
            out[a:b].sort()
        new = np.ones(len(out), bool)
        new[1:] = out[1:] != out[:-1]
        new[(stops - sizes)[sizes > 0]] = True
        seen = np.concatenate([[0], np.cumsum(new)])
        yield out[new], seen[stops] - seen[stops - sizes]


def sets_of(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct n-grams of each text as sorted hashes."""
    return [own for flat, sizes in shingled(texts, size) for own in np.split(flat, np.cumsum(sizes)[:-1])]


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The distinct n-grams of a text as sorted hashes."""
    return sets_of(pa.array([text], pa.string()), size)[0]


def sums(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sums of runs of so many numbers each."""
    out = np.zeros(len(sizes), x.dtype)
    if len(x):
        out[sizes > 0] = np.add.reduceat(x, (np.cumsum(sizes) - sizes)[sizes > 0])
    return out


def set_keys(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit names of sets of so many columns each, signed."""
    return mixed(sums(mixed(flat, 1), sizes) + sizes.astype(np.uint64), 2).view(np.int64)


def parities(own: np.ndarray) -> np.ndarray:
    """For each of some groups of columns whether a row has an odd number of them, as packed bits. Rows differ in as many columns as parities at least.
    Longer rows have more groups, always a power of 2."""
    groups = GROUPS << max(0, (len(own) - 1) // GROUPS).bit_length()
    odd = np.bincount((own % np.uint64(groups)).astype(np.int64), minlength=groups) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def least_apart(a: np.ndarray, b: np.ndarray) -> int:
    """How many columns two rows differ in at least, by their parities; groups of the longer one are folded."""
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        half = len(a) // 2
        a = a[:half] ^ a[half:]
    return int(np.bitwise_count(a ^ b).sum())


def firsts(n: int, s: Fraction) -> int:
    """How many columns of a row of ``n`` make candidates."""
    return n - -(-n * s.numerator // s.denominator) + 1 if n else 0


def kept(n: int, s: Fraction) -> int:
    """How many of its least hashes a row keeps, so that most rows need no more where some of them are common."""
    return min(n, firsts(n, s) * 3 // 2 + 4)


def in_order(own: np.ndarray, common: np.ndarray, s: Fraction) -> tuple[np.ndarray, int]:
    """The columns of a row that make candidates, those that are common (a mask) last; and how many aren't."""
    first = firsts(len(own), s)
    rare = own[~common][:first]
    return np.concatenate([rare, own[common][: first - len(rare)]]), len(rare)


def bands(n: int, s: Fraction) -> tuple[int, int]:
    """The two bands of sizes in which a set of ``n`` columns is filed: its own and the next. Sets whose sizes differ by a factor of s at most share one:
    a band ends below 1 / s times its first size, rounded up, so what is similar to its sets is in it, in the next or in the one before."""
    at, end = 0, 2
    while n >= end:
        at, end = at + 1, max(end + 1, -(-end * s.denominator // s.numerator))
    return at, at + 1


def in_bands(sigs: np.ndarray, rare: int, n: int, s: Fraction) -> np.ndarray:
    """The columns of a set of ``n``, the common ones, which come after ``rare`` others, once for each of its bands."""
    common = sigs[rare:]
    return np.concatenate([sigs[:rare], *(mixed(common, 16 + band) for band in bands(n, s))])


def overlaps(a: list[np.ndarray], b: list[np.ndarray], s: Fraction) -> np.ndarray:
    """Of pairs of sorted sets, which reach the similarity. Columns are taken in blocks of the hash range; overlaps add up, and a pair goes as soon as
    what is left of both can't bring it to its bound."""
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    need = -(-(n + m) * s.numerator // (s.numerator + s.denominator))
    got, live = np.zeros(len(a), np.int64), (np.minimum(n, m) * s.denominator >= np.maximum(n, m) * s.numerator) & (need > 0)
    edges = (np.arange(1, BLOCKS, dtype=np.uint64) << np.uint64(61)) if BLOCKS == 8 else np.linspace(0, 2.0**64, BLOCKS + 1)[1:-1].astype(np.uint64)
    cut_a, cut_b = ([np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]) for x in side] for side in (a, b))
    for k in range(BLOCKS):
        at = np.flatnonzero(live)
        if not len(at):
            break
        blocks = [a[i][cut_a[i][k] : cut_a[i][k + 1]] for i in at] + [b[i][cut_b[i][k] : cut_b[i][k + 1]] for i in at]
        pair = np.repeat(np.concatenate([at, at]), [len(x) for x in blocks])
        column = np.concatenate(blocks)
        order = np.lexsort((column, pair))
        pair, column = pair[order], column[order]
        both = (column[1:] == column[:-1]) & (pair[1:] == pair[:-1])
        got += np.bincount(pair[1:][both], minlength=len(a))
        left = np.array([min(len(a[i]) - cut_a[i][k + 1], len(b[i]) - cut_b[i][k + 1]) for i in at])
        live[at] = got[at] + left >= need[at]
    return live


def _batch(columns: dict[str, np.ndarray | list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _filed(sigs: np.ndarray, key: int, n: int, rare: int) -> pa.RecordBatch:
    """The rows under which a set is filed; ``share`` puts sets with few columns of their own first."""
    k = len(sigs)
    return _batch({"sig": sigs.view(np.int64), "key": np.full(k, key, np.int64), "n": np.full(k, n, np.int64), "share": np.full(k, rare / max(n, 1)), "common": np.arange(k) >= rare})


def columns_of_several(sets: DataFrame) -> DataFrame:
    """(sig, rows): the columns that several sets have among their least hashes, and how many. Each batch sends a column once, so a frequent one doesn't fill a task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, rows = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield _batch({"sig": sig, "rows": rows})
        idle()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, rows = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            sig, rows = np.concatenate([sig, batch.column(0).to_numpy()]), np.concatenate([rows, batch.column(1).to_numpy()])
            if len(sig):
                starts = np.concatenate([[0], np.flatnonzero(sig[1:] != sig[:-1]) + 1])
                sig, rows = sig[starts], np.add.reduceat(rows, starts)
                several = rows[:-1] > 1
                if several.any():
                    yield _batch({"sig": sig[:-1][several], "rows": rows[:-1][several]})
                sig, rows = sig[-1:], rows[-1:]  # the next batch may go on with it
        if len(sig) and rows[0] > 1:
            yield _batch({"sig": sig, "rows": rows})
        idle()

    return sets.select("least").mapInArrow(each, "sig long, rows long").repartition("sig").sortWithinPartitions("sig").mapInArrow(total, "sig long, rows long")


def _columns(batch: pa.RecordBatch, common: np.ndarray, s: Fraction) -> tuple[np.ndarray, ...]:
    """Of a batch of sets (key, n, least): their columns, which of them are common, how many of its columns that aren't a set has before each, the number of the set, and
    by set how many make candidates and how many aren't common."""
    n, sizes = batch.column(1).to_numpy(), batch.column(2).value_lengths().to_numpy()
    flat = batch.column(2).flatten().to_numpy().view(np.uint64)
    is_common = _among(flat, common)
    of = np.repeat(np.arange(len(n)), sizes)
    rare = sums((~is_common).astype(np.int64), sizes)
    before = np.cumsum(~is_common) - ~is_common - (np.cumsum(rare) - rare)[of]
    return flat, is_common, before, of, n - -(-n * s.numerator // s.denominator) + 1, rare


def short_of_columns(sets: DataFrame, common: np.ndarray, s: Fraction) -> DataFrame:
    """(key, whole): the sets (key, n, least) that file common columns, too; ``whole`` if the least hashes don't tell which."""
    shared = sets.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *_, first, rare = _columns(batch, shared.value, s)
            some = np.flatnonzero(rare < first)
            yield _batch({"key": batch.column(0).to_numpy()[some], "whole": (batch.column(2).value_lengths().to_numpy() < batch.column(1).to_numpy())[some]})
        idle()

    return sets.select("key", "n", "least").mapInArrow(run, "key long, whole boolean")


def filed_by_least(sets: DataFrame, common: np.ndarray, s: Fraction, wanted: np.ndarray) -> DataFrame:
    """(sig, key, n): the columns of sets (key, n, least) that make candidates, but for common ones, for sets whose least hashes don't do and for columns that aren't in the
    bitmap ``wanted``."""
    shared, bits = (sets.sparkSession.sparkContext.broadcast(x) for x in (common, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, is_common, before, of, first, rare = _columns(batch, shared.value, s)
            n = batch.column(1).to_numpy()
            does = (rare >= first) | (batch.column(2).value_lengths().to_numpy() == n)
            at = np.flatnonzero(~is_common & (before < first[of]) & does[of])
            place = flat[at] & np.uint64(8 * len(bits.value) - 1)
            at = at[(bits.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
            yield _batch({"sig": flat[at].view(np.int64), "key": batch.column(0).to_numpy()[of[at]], "n": n[of[at]]})
        idle()

    return sets.select("key", "n", "least").mapInArrow(run, "sig long, key long, n long")


def bitmap(sigs: DataFrame) -> np.ndarray:
    """The last bits of some hashes (sig) as a bitmap of 16 MB at most: about one in 16 of other hashes is in it, too, more where there are over 8 million."""
    n = min(BITMAPS, 1 << (sigs.count() // BITMAP_KEYS).bit_length())
    place = F.col("sig").bitwiseAND(F.lit(n * BITMAP_BITS - 1))
    rows = sigs.select(place.alias("place")).groupBy(F.floor(F.col("place") / BITMAP_BITS).alias("bitmap")).agg(F.bitmap_construct_agg(F.col("place") % BITMAP_BITS).alias("bits")).toArrow()
    out = np.zeros((n, BITMAP_BITS // 8), np.uint8)
    for at, bits in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
        out[at] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def _among(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted array ``among``."""
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def filed_whole(texts: DataFrame, common: np.ndarray, size: int, s: Fraction) -> DataFrame:
    """The rows under which the sets of whole texts (key, text) are filed, common columns last."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_small_batches(batches, 1):
            for key, own in zip(batch.column(0).to_pylist(), sets_of(batch.column(1), size), strict=True):
                sigs, rare = in_order(own, _among(own, shared.value), s)
                yield _filed(sigs, key, len(own), rare)
        idle()

    return texts.mapInArrow(run, FILED)


def filed_again(texts: DataFrame, size: int, s: Fraction) -> DataFrame:
    """Rows of the sets of some texts (key, text) by an order made for these sets: columns that at most ``CELL`` of them have come first. The others are filed by bands of sizes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_small_batches(batches, 1):
            key = batch.column(0).to_numpy()
            for flat, sizes in shingled(batch.column(1), size):
                yield _batch({"key": np.repeat(key[: len(sizes)], sizes), "shingle": flat.view(np.int64)})
                key = key[len(sizes) :]
        idle()

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_small_batches(batches, 1):
            for key, own, rare in zip(batch.column(0).to_pylist(), sets_of(batch.column(1), size), batch.column(2), strict=True):
                rare = np.sort(rare.values.to_numpy().view(np.uint64)) if rare.is_valid else np.zeros(0, np.uint64)
                sigs, k = in_order(own, ~_among(own, rare), s)
                yield _filed(in_bands(sigs, k, len(own), s), key, len(own), k)
        idle()

    of = texts.mapInArrow(each, "key long, shingle long")
    counts = of.groupBy("shingle").agg(F.count("*").alias("sets")).where(F.col("sets") <= CELL)
    rare = of.join(counts, "shingle").groupBy("key").agg(F.collect_list("shingle").alias("rare"))  # at most the columns of one set
    return texts.join(rare, "key", "left").select("key", "text", "rare").mapInArrow(file, FILED)


def met(filed: DataFrame, s: Fraction, most: int | None = None) -> DataFrame:
    """(a, b): pairs of sets that meet in a list and whose sizes allow the similarity; members of lists of more than ``most`` (``CELL``) sets, or of lists with a
    mark (a null key), come as (a, null). Rows (sig, key, n) come as a stream sorted by sig."""
    up, down, most = s.numerator, s.denominator, most or CELL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, held, large = None, [], False

        def done() -> list[tuple]:
            return [] if large else [(a, b) for (a, n), (b, m) in combinations(sorted(set(held)), 2) if a != b and min(n, m) * down >= max(n, m) * up]

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

        for batch in batches:
            at, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            marked = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            key = batch.column(1).fill_null(0).to_numpy()
            if not len(at):
                continue
            starts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
            sizes = np.diff(np.append(starts, len(at)))
            out: list[tuple] = []
            for k in np.unique(np.concatenate([[0, len(starts) - 1], np.flatnonzero(sizes > 1)])).tolist():
                own, some = int(at[starts[k]]), slice(starts[k], starts[k] + sizes[k])
                if own != sig:
                    out += done()
                    sig, held, large = own, [], False
                mark = marked[some]
                held += zip(key[some][~mark].tolist(), n[some][~mark].tolist(), strict=True)
                if len(held) > most or large or mark.any():
                    out += [(x, None) for x, _ in held]
                    held, large = [], True
            if out:
                yield rows(out)
        out = done()
        if out:
            yield rows(out)
        idle()

    return filed.select("sig", "key", "n").repartition("sig").sortWithinPartitions("sig", F.col("key").asc_nulls_first()).mapInArrow(run, "a long, b long")


def sized(filed: DataFrame) -> DataFrame:
    """``filed`` with how many rows each list has (rows) and its pivot, the set with the smallest share, which names the rows that get one template; lists of very many rows aren't gathered."""
    lists = filed.groupBy("sig").agg(F.count("*").alias("rows"), F.min(F.struct("share", "key")).alias("least")).select("sig", "rows", F.col("least.key").alias("pivot"))
    return looked_up(filed, lists.where("rows > 1"), ["sig"], max(1, filed.count() // HOT_SHARE), "rows")


def verified(pairs: DataFrame, held: DataFrame, s: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity; ``held``: (key, own binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_small_batches(batches, 2, 8 * ELEMENTS):
            left, right = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(i)] for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array(overlaps(left, right, s), pa.bool_()))
        idle()

    left, right = (held.select(F.col("key").alias(c), F.col("own").alias(f"own_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "own_a", "own_b").mapInArrow(run, "a long, b long")


def templates(rows: DataFrame, held: DataFrame) -> DataFrame:
    """(pivot, of): the columns that more than half of ``SAMPLE`` of a pivot's rows (pivot, key) have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, sets = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if sets:
                columns, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([pivot], pa.int64()), pa.array([columns[2 * n > len(sets)].tobytes()], pa.binary())], ["pivot", "of"])

        for batch in batches:
            for at, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != pivot:
                    yield from done()
                    pivot, sets = at, []
                sets.append(np.frombuffer(own, np.uint64))
        yield from done()
        idle()

    place = F.row_number().over(Window.partitionBy("pivot").orderBy(F.xxhash64("key", "pivot"), "key"))
    some = rows.select("pivot", "key").withColumn("place", place).where(F.col("place") <= SAMPLE)
    return some.join(held, "key").select("pivot", "own").repartition("pivot").sortWithinPartitions("pivot").mapInArrow(run, "pivot long, of binary")


def possible(pairs: DataFrame, sets: DataFrame, s: Fraction) -> DataFrame:
    """The pairs (a, b) whose sizes and parities, of sets (key, n, parity), allow the similarity."""
    up, down = s.numerator, s.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            apart = [least_apart(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) for x, y in zip(batch.column(4), batch.column(5), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(np.array(apart, np.int64) * (down + up) <= n * (down - up)))
        idle()

    left, right = (sets.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"parity_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "parity_a", "parity_b").mapInArrow(run, "a long, b long")


def differences(lists: DataFrame, held: DataFrame, s: Fraction) -> DataFrame:
    """(pivot, key, n, g, difference) of the rows (key, pivot, rows) of long lists: each set's difference from the template of its pivot, and g as whole
    numbers (times the denominator and numerator of s together). Templates of many rows are met in as many copies as that takes."""
    up, down = s.numerator, s.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_small_batches(batches, 2, 8 * ELEMENTS):
            own, of = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(i)] for i in (2, 3))
            apart = [np.setxor1d(x, p, assume_unique=True) for x, p in zip(own, of, strict=True)]
            yield _batch({
                "pivot": batch.column(0), "key": batch.column(1), "n": np.array([len(x) for x in own], np.int64),
                "g": np.array([(down + up) * len(d) - (down - up) * len(x) for d, x in zip(apart, own, strict=True)], np.int64), "difference": pa.array([d.tobytes() for d in apart], pa.binary()),
            })
        idle()

    rows = lists.groupBy("pivot", "key").agg(F.max("rows").alias("rows")).withColumn("copies", F.ceil(F.col("rows") / SPREAD))
    rows = written(rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.col("copies"))), "members")
    pivots = rows.groupBy("pivot").agg(F.max("copies").alias("copies")).join(templates(rows, held), "pivot")
    pivots = pivots.select("pivot", "of", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("salt"))
    met = rows.join(held, "key").join(pivots, ["pivot", "salt"])
    return met.select("pivot", "key", "own", "of").mapInArrow(run, "pivot long, key long, n long, g long, difference binary")


def by_difference(of: DataFrame, s: Fraction) -> DataFrame:
    """Rows (sig, group, key, n, share) of (pivot, key, n, g, low, apart, difference) by what sets don't have in common with their template. ``low`` is the least g of
    the pivot's rows, which ``group`` names; ``share`` is 0 for far sets, which no star holds, and only pairs with such a set are asked for.

    A pair must share at least half of the sum of its g, and no more than the smaller difference has. So there is a least number ``least`` of columns that a set
    shares with any partner, and the ``least - 1`` last columns of its difference in any order may be left out: others are shared, too. The most frequent
    columns come last; but where sets have less than half in common with their template (``apart``), their order is that of the hashes, as then few columns are left."""
    up, down = s.numerator, s.denominator
    whole = 2 * (down + up)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_small_batches(batches, 6, 8 * ELEMENTS):
            for pivot, key, n, g, low, mixture, raw in zip(*(batch.column(i).to_pylist() for i in range(6)), batch.column(6), strict=True):
                apart = np.frombuffer(raw.as_buffer(), np.uint64)
                far = g + low > 0
                partner = max(low if far else 1 - low, g - -(-2 * (down - up) * down * n // up))
                least = max(1, -(-(g + partner) // whole))
                if least <= len(apart):
                    if mixture:
                        apart, least = apart[: len(apart) - least + 1], 1
                    k = len(apart)
                    sigs = mixed(apart ^ mixed(np.array([pivot], np.int64).view(np.uint64), 3), 4)
                    yield _batch({"sig": sigs.view(np.int64), "group": np.full(k, pivot, np.int64), "key": np.full(k, key, np.int64), "n": np.full(k, n, np.int64), "share": np.full(k, 0.0 if far else 1.0), "least": np.full(k, least, np.int64)})
        idle()

    filed = written(of.select("pivot", "key", "n", "g", "low", "apart", "difference").mapInArrow(run, "sig long, group long, key long, n long, share double, least long"), "by-difference")
    place = F.row_number().over(Window.partitionBy("group", "key").orderBy(F.desc("rows"), "sig"))
    out = written(sized(filed).withColumn("place", place).where(F.col("place") >= F.col("least")).select("sig", "group", "key", "n", "share"), "rarest")
    dropped(filed)
    return out


def starred(lists: DataFrame, held: DataFrame, s: Fraction) -> DataFrame:
    """The differences of the rows (key, pivot, rows) of lists, each with the star of its pivot (the set of the least g, low), the greatest g (high), and whether
    the pivot's rows have less than half in common with their template (apart)."""
    of = written(differences(lists, held, s), "differences")
    stars = of.groupBy("pivot").agg(F.min(F.struct("g", "key")).alias("least"), F.max("g").alias("high"), (F.sum(F.octet_length("difference")) > 4 * F.sum("n")).alias("apart"), F.count("*").alias("rows"))
    stars = stars.select("pivot", F.col("least.g").alias("low"), F.col("least.key").alias("star"), "high", "apart", "rows")
    out = written(looked_up(of, stars, ["pivot"], max(1, of.count() // HOT_SHARE), "rows"), "stars")
    dropped(of)
    return out


def star_links(of: DataFrame) -> DataFrame:
    """(a, b): the rows of ``starred`` that reach the similarity with their star."""
    return of.where("g + low <= 0 and key <> star").select(F.col("key").alias("a"), F.col("star").alias("b"))


def near_by_grid(sets: DataFrame, whole_sets: Callable[[DataFrame, str], DataFrame], s: Fraction) -> DataFrame:
    """(a, b): links between sets (key, n, print) whose fingerprints the grid join of ``simhash`` puts into one component; each component is a group of near copies with
    a template, so every link reaches the similarity. What the grid misses is left to the join of columns."""
    of_sets = sets.select("key", "n", F.col("print").alias("fp"))
    prints = written(of_sets.groupBy("fp").agg(F.count("*").alias("rows")), "distinct-prints")
    roots = components(grid_links(prints.select("fp")))
    # a set whose fingerprint is near no other one is in no group
    shared = written(prints.join(roots, prints.fp == roots.node, "left").where("root is not null or rows > 1").select("fp", "rows", F.coalesce("root", "fp").alias("sig")), "shared-prints")
    some = written(likely(of_sets, shared, "fp"), "likely-prints")
    near = looked_up(some, shared, ["fp"], max(1, some.count() // HOT_SHARE), "rows")
    groups = written(sized(written(near.select("sig", "key", "n", F.lit(0.0).alias("share")), "near-prints")), "groups")
    return star_links(starred(groups, whole_sets(groups.select("key"), "sets-of-groups"), s))


def smaller_groups(lists: DataFrame, of: DataFrame) -> DataFrame:
    """The long ``lists`` (sig, group, key, n, share, rows, pivot) of differences ``of`` (pivot, rows, ...), with pivots that have fewer rows than the groups that they come from.

    A list never has all rows of its group, as columns that all of them have are in the template. But all lists that one pivot names can be the whole group again, with the
    same template and so the same lists, without end. Where they are more than three quarters of it, lists are named by two of their sets, those of the least and the greatest hash:
    lists of one passage hold nearly the same sets, so most of them get one name, and a set isn't in as many groups as it has columns. Where a name still gathers more than
    three quarters, each list gets a name of its own, the same one for lists of the same sets."""
    groups = of.groupBy("pivot").agg(F.max("rows").alias("most")).withColumnRenamed("pivot", "group")
    parents = lists.select("pivot", "group").distinct().join(groups, "group").groupBy("pivot").agg(F.max("most").alias("most"))
    together = lists.select("pivot", "key").distinct().groupBy("pivot").agg(F.count("*").alias("members"))
    whole = written(together.join(parents, "pivot").where(4 * F.col("members") > 3 * F.col("most")).select("pivot", "most"), "whole-groups")
    if whole.isEmpty():
        return lists
    mark, hot = F.xxhash64("key"), max(1, lists.count() // HOT_SHARE)
    own, two = F.xxhash64(F.bit_xor(mark), F.count("*")), F.xxhash64("pivot", F.min(mark), F.max(mark))
    names = lists.groupBy("sig", "pivot").agg(own.alias("own"), two.alias("two"), F.count("*").alias("of")).join(whole, "pivot", "left")
    names = written(names.withColumn("two", F.when(F.col("most").isNotNull(), F.col("two"))), "names-of-lists")
    tried = looked_up(lists.select("sig", "key"), names.where("two is not null").select("sig", "two", "most", "of"), ["sig"], hot, "of").select("two", "key", "most").distinct()
    still = tried.groupBy("two").agg(F.count("*").alias("members"), F.max("most").alias("most")).where("4 * members > 3 * most").select("two", F.lit(True).alias("still"))
    names = names.join(still, "two", "left").select("sig", F.when(F.col("still"), F.col("own")).otherwise(F.coalesce("two", "pivot")).alias("pivot"), "of")
    return looked_up(lists.drop("pivot"), names, ["sig"], hot, "of").drop("of")


def shared_columns(sets: list[np.ndarray]) -> np.ndarray:
    """How many columns each two of some sets share (their own sizes aren't counted). Columns that over an eighth of the sets have are a dense product, the others pairs."""
    m = len(sets)
    columns, of = np.concatenate(sets), np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(columns, kind="stable")
    columns, of = columns[order], of[order]
    starts = np.flatnonzero(np.concatenate([[True], columns[1:] != columns[:-1]]))
    sizes = np.diff(np.append(starts, len(columns)))
    column, size = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes, sizes)
    out, dense = np.zeros(m * m, np.int64), 8 * size > m
    place = np.cumsum(8 * sizes > m) - 1
    rows, at = of[dense], place[column[dense]]
    for low in range(0, len(at) and int(at[-1]) + 1, DENSE):
        some = slice(*np.searchsorted(at, [low, low + DENSE]))
        block = np.zeros((m, DENSE), np.float32)
        block[rows[some], at[some] - low] = 1
        out += (block @ block.T).astype(np.int64).reshape(-1)
    column, of = column[~dense & (size > 1)], of[~dense & (size > 1)]
    for step in range(1, m // 8 + 1):
        both = np.flatnonzero(column[step:] == column[:-step])
        if not len(both):
            break
        pairs = np.bincount(of[both] * m + of[both + step], minlength=m * m)
        out += pairs + pairs.reshape(m, m).T.reshape(-1)
    return out.reshape(m, m)


def multiplied(lists: DataFrame, held: DataFrame, s: Fraction) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that join what is similar in the groups of the long ``lists`` (sig, key, n, rows, pivot) whose product fits a task, and the lists of the other groups.
    The sets of such a group move to its task, so all of them together may have ``MOVED`` times the columns of the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, keys, sets = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if not sets:
                return
            n = np.array([len(x) for x in sets])
            near = shared_columns(sets) * (s.numerator + s.denominator) >= (n[:, None] + n) * s.numerator
            np.fill_diagonal(near, True)
            root, was = np.arange(len(n)), None
            while was is None or (root != was).any():
                root, was = np.minimum(root, np.where(near, root, len(n)).min(axis=1)), root
            linked = np.flatnonzero(root != np.arange(len(n)))
            if len(linked):
                yield _batch({"a": np.array(keys, np.int64)[linked], "b": np.array(keys, np.int64)[root[linked]]})

        for batch in batches:
            for of, key, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if of != pivot:
                    yield from done()
                    pivot, keys, sets = of, [], []
                keys.append(key)
                sets.append(np.frombuffer(own.as_buffer(), np.uint64))
        yield from done()
        idle()

    members = written(lists.groupBy("pivot", "key").agg(F.first("n").alias("n")), "members-of-lists")
    sizes = written(members.groupBy("pivot").agg(F.count("*").alias("members"), F.sum("n").alias("columns")), "groups-of-lists")
    fits = sizes.where((F.col("members") <= MEMBERS) & (F.col("columns") <= ELEMENTS // 4) & (F.col("columns") * F.col("members") <= PRODUCT)).select("pivot", "columns")
    moved, all_of = fits.agg(F.sum("columns")).first()[0] or 0, members.select("key", "n").distinct().agg(F.sum("n")).first()[0] or 0
    if not moved or moved > MOVED * all_of:
        return lists.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0), lists
    rows = members.join(fits.select("pivot"), "pivot", "left_semi").join(held, "key").select("pivot", "key", "own")
    found = written(rows.repartition("pivot").sortWithinPartitions("pivot").mapInArrow(run, "a long, b long"), "links-in-groups")
    return found, written(lists.join(fits.select("pivot"), "pivot", "left_anti"), "lists-of-others")


def without_pairs(lists: DataFrame, held: DataFrame, s: Fraction) -> tuple[list[DataFrame], list[DataFrame]]:
    """Links (a, b) and pairs (a, b) that are to be verified, of lists (sig, key, n, rows, pivot) that are too long for pairs."""
    links, pairs = [], []
    while not lists.isEmpty():
        of = starred(lists, held, s)
        links.append(written(star_links(of), "star-links"))
        # rows of a pivot that all hang on its star need nothing more
        rest = written(sized(by_difference(of.where("high + low > 0"), s)), "lists")
        # nor does a list whose sets all do
        rest = rest.join(rest.where("share = 0").select("sig").distinct(), "sig", "left_semi")
        pairs.append(written(met(rest.where(F.col("rows") <= CELL), s), "met-apart").where("b is not null"))
        named = written(smaller_groups(rest.where(F.col("rows") > CELL), of), "next-lists")
        dropped(of)
        members = written(named.groupBy("pivot", "key").agg(F.first("n").alias("n")), "members-of-groups")
        few = (F.col("members") <= GROUP) & (4 * F.col("members") * (F.col("members") - 1) <= F.col("columns"))
        sizes = written(members.groupBy("pivot").agg(F.count("*").alias("members"), F.sum("n").alias("columns")).select("pivot", few.alias("few")), "sizes-of-groups")
        small = members.join(sizes.where("few"), "pivot", "left_semi").select(F.col("pivot").alias("sig"), "key", "n")
        pairs.append(written(met(small, s, GROUP), "met-in-groups").where("b is not null"))
        lists = written(named.join(sizes.where("not few"), "pivot", "left_semi"), "lists-of-large")
    return links, pairs


def common_columns(several: DataFrame) -> np.ndarray:
    """The columns (sig, rows) that more than ``CELL`` sets have among their least hashes, sorted; if there are too many, those with more than a power of 2."""
    each = written(several.where(F.col("rows") > CELL).select("sig", F.floor(F.log2("rows")).alias("power")), "common")
    over, most = {r["power"]: r["n"] for r in each.groupBy("power").agg(F.count("*").alias("n")).collect()}, 0
    while sum(n for power, n in over.items() if power >= most) > COMMON:
        most += 1
    return np.sort(each.where(F.col("power") >= most).select("sig").toArrow().column(0).to_numpy().view(np.uint64))


def not_joined(lists: DataFrame, joined: DataFrame) -> DataFrame:
    """The ``lists`` of ``sized`` whose sets aren't all in one component of ``joined`` (node, root)."""
    roots = lists.join(joined, lists.key == joined.node, "left").select("sig", F.coalesce("root", "key").alias("root"))
    apart = roots.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("of")).where("low <> high").select("sig", "of")
    return looked_up(lists, apart, ["sig"], max(1, lists.count() // HOT_SHARE), "of").drop("of")


def links(sets: DataFrame, leasts: DataFrame, texts_of, size: int, s: Fraction, filed: Callable[[], None]) -> DataFrame:
    """(a, b): links between distinct sets (key, n, parity) that join all that similar pairs join; ``leasts`` (key, n, least) is read no more
    once ``filed`` has been called; ``texts_of`` gives (key, text) for some keys.
    Where sets have fingerprints (print), the grid join of these comes first, and columns join what it left apart: pairs and long lists of sets that it has joined are spared."""

    def work(batch: pa.RecordBatch) -> dict:
        return {"key": batch.column(0), "own": [x.tobytes() for x in sets_of(batch.column(1), size)]}

    def whole_sets(keys: DataFrame, name: str) -> DataFrame:
        return written(map_batches(texts_of(keys.distinct()), work, "key long, own binary", "text"), name)

    near, joined = None, None
    if "print" in sets.columns:
        near = written(near_by_grid(sets, whole_sets, s), "near")
        joined = components(near)
    several = written(columns_of_several(leasts), "columns-of-several")
    common = common_columns(several)
    odd = written(short_of_columns(leasts, common, s), "short-of-columns")
    whole = written(filed_whole(texts_of(odd.where("whole").select("key").distinct()), common, size, s), "filed-whole")
    # lists of these that are long are only marked, so that no list of rows that are met here is longer than the common ones' least
    long = whole.where("not common").groupBy("sig").agg(F.count("*").alias("rows")).where(F.col("rows") > CELL).select("sig")
    calm = whole.where("not common").join(long, "sig", "left_anti")
    marks = long.select("sig", F.lit(None).cast("long").alias("key"), F.lit(0).cast("long").alias("n"))
    # a column that no other set has among its least hashes needn't move, unless one of these has it
    wanted = bitmap(written(several.select("sig").union(whole.where("not common").select("sig").distinct()), "wanted-columns"))
    here = written(met(filed_by_least(leasts, common, s, wanted).union(calm.select("sig", "key", "n")).union(marks), s), "met")
    filed()
    many = reduce(DataFrame.union, [here.where("b is null").select(F.col("a").alias("key")), odd.where("not whole").select("key"), whole.where("common").select("key"), whole.join(long, "sig", "left_semi").select("key")])
    again = written(filed_again(written(texts_of(many.distinct()), "many-texts"), size, s), "filed-again")
    lists = written(sized(again.where("common")), "lists")
    if joined is not None:
        lists = written(not_joined(lists, joined), "lists-apart")
    small = again.where("not common").select("sig", "key", "n").union(lists.where(F.col("rows") <= CELL).select("sig", "key", "n"))
    there = written(met(small, s), "met-again")
    pairs = here.where("b is not null").union(there.where("b is not null"))
    large = written(lists.where(F.col("rows") > CELL), "long-lists")

    held = whole_sets(large.select("key"), "sets-of-lists")
    in_groups, large = multiplied(large, held, s)
    stars, more = without_pairs(large, held, s)
    pairs = reduce(DataFrame.union, [pairs, *more]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if joined is not None:
        root_a, root_b = (joined.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        pairs = pairs.join(root_a, "a", "left").join(root_b, "b", "left").where("root_a is null or root_b is null or root_a <> root_b").select("a", "b")
    pairs = written(possible(pairs, sets, s), "pairs")
    held = whole_sets(pairs.select(F.col("a").alias("key")).union(pairs.select("b")), "sets-of-pairs")
    return reduce(DataFrame.union, [verified(pairs, held, s), in_groups, *stars, *([near] if near is not None else [])])


def placed(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, grid: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, the name of its set (fp), a hash of its text (text_hash), the size of its set (n), the root and the component_id of
    its component. With ``grid`` sets get fingerprints, and the grid join of ``simhash`` comes before that of columns; components are the same."""
    s = Fraction(str(similarity))
    prints = ["print"] if grid else []

    def work(batch: pa.RecordBatch) -> dict:
        names, sizes, least, parity, prints_of = [], [], [], [], []
        for flat, n in shingled(batch.column(1), size):
            names.append(set_keys(flat, n))
            sizes.append(n)
            least.append(flat[np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) < np.repeat([kept(k, s) for k in n.tolist()], n)])
            parity += [parities(x).tobytes() for x in np.split(flat, np.cumsum(n)[:-1])]
            if grid:
                prints_of.append(fingerprints_of(flat, n))
        n = np.concatenate(sizes)
        return {
            "doc_id": batch.column(0), "fp": np.concatenate(names), "text_hash": batch.column(2), "n": n,
            "least": pa.ListArray.from_arrays(np.cumsum([0, *(kept(k, s) for k in n.tolist())]).astype(np.int32), np.concatenate(least).view(np.int64)), "parity": parity,
        } | ({"print": np.concatenate(prints_of)} if grid else {})

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    of_docs = written(map_batches(rows, work, "doc_id long, fp long, text_hash long, n long, least array<long>, parity binary" + ", print long" * grid, "text"), "set-names")
    one = F.min(F.struct("doc_id", "text_hash")).alias("one")
    # the least hashes are nearly all there is to a row: those of sets of one row don't move
    every = of_docs.groupBy("fp").agg(F.first("n").alias("n"), F.first("parity").alias("parity"), F.min("doc_id").alias("first_id"), F.count("*").alias("rows"), one, *(F.first(c).alias(c) for c in prints))
    sets = written(every, "sets")
    names = written(of_docs.select("doc_id", "fp", "text_hash", "n"), "names")
    filled, twice = of_docs.where("n > 0").select("fp", "n", "least"), written(sets.where("rows > 1 and n > 0").select("fp"), "sets-of-several")
    copies = written(likely(filled, twice, "fp").dropDuplicates(["fp"]), "leasts-of-several")
    leasts = likely(filled, twice, "fp", "left_anti").unionByName(copies).select(F.col("fp").alias("key"), "n", "least")

    def texts_of(keys: DataFrame) -> DataFrame:
        """(key, text) of one row of each set."""
        # a table of its own, as it is read twice
        wanted = written(sets.select(F.col("fp").alias("key"), F.coalesce("one.doc_id", F.lit(-1)).alias("id"), "one.text_hash").join(keys, "key", "left_semi"), "wanted")
        found = likely(rows, wanted, "text_hash").withColumn("id", F.coalesce("doc_id", F.lit(-1))).join(wanted, ["id", "text_hash"])
        return found.groupBy("key").agg(F.first("text").alias("text"))

    roots = components(links(sets.select(F.col("fp").alias("key"), "n", "parity", *prints).where("n > 0"), leasts, texts_of, size, s, lambda: dropped(of_docs, copies)))
    return with_components(names, sets.select("fp", "first_id", "rows"), roots)


def jaccard_join(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest id that links lead to). Texts without words are linked with nothing."""
    own: Column = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return placed(docs, size, similarity).select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and components of all documents."""
    return jaccard_join(table(spark, sf_dir, "documents"))


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL = f"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\\x20\\x09-\\x0D]+') as w from documents
), grams as (
  select distinct doc_id, array_to_string(w[i:i + {SIZE - 1}], ' ') as gram
  from (select doc_id, w, unnest(range(1, greatest(len(w) - {SIZE - 1}, 1) + 1)) as i from words where len(w) > 0)
), sizes as (select doc_id, count(*) as n from grams group by doc_id),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as n_both from grams a join grams b on a.gram = b.gram and a.doc_id < b.doc_id group by all
), pairs as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * n_both >= 90 * (x.n + y.n - n_both)
), links as (select a, b from pairs union all select b, a from pairs),
reach(node, other) as (select a, b from links union select r.node, l.b from reach r join links l on l.a = r.other)
select w.doc_id, coalesce(s.n, 0)::bigint as n_shingles, least(w.doc_id, coalesce(r.low, w.doc_id)) as component_id
from words w left join sizes s on s.doc_id = w.doc_id left join (select node, min(other) as low from reach group by node) r on r.node = w.doc_id
"""
