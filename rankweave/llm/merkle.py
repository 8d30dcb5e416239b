"""A Merkle manifest of a dataset: a tree of hashes for each language, a tree over their roots, and for each row the proof that leads to the root.

Rows become leaves; within a language they are numbered by doc_id (rows without an id first, equal ids by leaf hash; rows that are equal in all hashed
columns have equal leaves, so their order doesn't matter). A level is made of the one below it: the index divided by the fanout names the parent,
and the sorted array of a run's children is hashed into it. Languages of one node are finished. Their subroots, ordered by language (null
first, by bytes), are numbered and hashed in the same way up to the root. Every level is a table in the shared folder.

Proofs grow from the root down: each level is joined with the proofs of its nodes, and each child gets its siblings before its parent's proof. So a level
costs as many rows as it has nodes, and rows hold 32 bytes a sibling. On which side of a node siblings stand follows from its index.

Nothing is gathered by language: numbers are counts of range partitions plus places within them, so a language of any size is spread over tasks. Null fields
are hashed as ``-``. An empty table gives no rows; further columns are left out of the leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.llm.shared import table, written

FANOUT = 2
#: What a leaf hashes, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 7
CUT = 6


def field(value: Column) -> Column:
    """A value with its length before it, so that no two rows give the same input."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with idx, the place of each in its group (grp) by ``order``, and m, the size of the group: ranges are counted, and places within a range
    are added to the counts of the ranges before it. No task gets a whole group."""
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("grp", *order, "tie").withColumn("part", F.spark_partition_id())
    placed = written(ranged, "ranged")
    counts = placed.groupBy("grp", "part").agg(F.count("*").alias("n"))
    by_part = Window.partitionBy("grp").orderBy("part")
    offsets = counts.select("grp", "part", (F.sum("n").over(by_part) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("grp")).alias("m"))
    own = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order, "tie")) - 1
    return placed.withColumn("own", own).join(offsets, ["grp", "part"]).withColumn("idx", F.col("own") + F.col("before")).drop("own", "before", "part", "tie")


def levels(nodes: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels above ``nodes`` (grp, idx, m, h), the lowest first: (grp, idx, m, h, kids), where ``kids`` are the hashes of the node's children in
    order and ``m`` is how many nodes the level has of that group. A group ends at the level where it has one node."""
    out, below = [], nodes.select("grp", "idx", "m", "h")
    most = nodes.agg(F.max("m")).first()[0] or 0
    while most > 1:
        parent = F.expr(f"idx div {fanout}").alias("up")
        runs = below.where("m > 1").groupBy("grp", parent, "m").agg(F.sort_array(F.collect_list(F.struct("idx", "h"))).alias("run"))
        made = runs.select("grp", F.col("up").alias("idx"), F.expr(f"(m + {fanout - 1}) div {fanout}").alias("m"), F.col("run.h").alias("kids"))
        below = written(made.withColumn("h", F.sha2(F.array_join("kids", "").cast("binary"), 256)), f"level-{len(out) + 1}")
        out.append(below)
        most = -(-most // fanout)
    return out


def tops(nodes: DataFrame, above: list[DataFrame]) -> DataFrame:
    """(grp, h): the last node of each group."""
    out = nodes.where("m = 1").select("grp", "h")
    for level in above:
        out = out.unionByName(level.where("m = 1").select("grp", "h"))
    return out


def proofs(nodes: DataFrame, above: list[DataFrame], start: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``nodes`` with the columns of ``start`` (grp, proof, ...) of their group, where before ``proof`` stand the siblings of each level from the node up."""
    rest = [c for c in start.columns if c not in ("grp", "proof")]
    known = None
    for k, level in enumerate(reversed(above)):
        at = level.where("m = 1").join(start, "grp")
        if known is not None:
            at = at.select("grp", "idx", "kids", "proof", *rest).unionByName(level.where("m > 1").join(known, ["grp", "idx"]).select("grp", "idx", "kids", "proof", *rest))
        each = at.select("grp", "idx", "kids", "proof", *rest, F.posexplode("kids").alias("pos", "kid"))
        others = F.array_join(F.expr(f"concat(slice(kids, 1, pos), slice(kids, pos + 2, {fanout}))"), "")
        known = each.select("grp", (F.col("idx") * fanout + F.col("pos")).alias("idx"), F.concat(F.unhex(others), "proof").alias("proof"), *rest)
        if (k + 1) % CUT == 0 and k + 1 < len(above):
            known = written(known, "proofs")
    alone = nodes.where("m = 1").join(start, "grp")
    return alone if known is None else alone.unionByName(nodes.where("m > 1").join(known, ["grp", "idx"]).select(*alone.columns))


def folded(h: Column, proof: Column, at: Column, idx: Column, m: Column, fanout: int = FANOUT) -> Column:
    """(h, at, ...): the hash that a node (hash, place, how many) and the siblings from byte ``at`` of its proof lead to, and the byte after these."""
    zero = F.struct(h.alias("h"), at.cast("int").alias("at"), idx.cast("long").alias("idx"), m.cast("long").alias("m"))

    def step(s: Column, _: Column) -> Column:
        pos = F.pmod(s["idx"], F.lit(fanout)).cast("int")
        run = F.least(F.lit(fanout).cast("long"), s["m"] - (s["idx"] - pos)).cast("int")
        before = F.lower(F.hex(F.substring(proof, s["at"], 32 * pos)))
        after = F.lower(F.hex(F.substring(proof, s["at"] + 32 * pos, 32 * (run - 1 - pos))))
        up = F.struct(F.sha2(F.concat(before, s["h"], after).cast("binary"), 256).alias("h"), (s["at"] + 32 * (run - 1)).cast("int").alias("at"), ((s["idx"] - pos) / fanout).cast("long").alias("idx"), F.ceil(s["m"] / fanout).cast("long").alias("m"))
        return F.when(s["m"] > 1, up).otherwise(s)

    # as many steps as a group of this size has levels, and some to spare
    steps = F.sequence(F.lit(0), F.ceil(F.log2(m.cast("double")) / F.log2(F.lit(float(fanout)))).cast("int") + 1)
    return F.aggregate(steps, zero, step)


def manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Per row of ``docs``: doc_id, lang, leaf, tampered (its leaf if n_chars were one more), idx and m (place in its language, size of that), subroot,
    lang_idx and lang_m (place of the language, how many there are), root, proof (32 bytes a sibling, from the leaf to the root)."""
    values = [F.col(c) for c in FIELDS]
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(TAMPERED)) == 0
    lang = F.col("lang").cast("string")
    leaves = docs.select(
        "doc_id", lang.alias("lang"), F.coalesce(F.concat(F.lit("="), lang), F.lit("")).alias("grp"), leaf_hash(values).alias("h"), F.when(tampered, leaf_hash(changed)).alias("tampered"),
    )
    leaves = written(numbered(leaves, ["doc_id", "h"]), "leaves")
    above = levels(leaves, fanout)
    # the roots of the languages are the leaves of one more tree
    subroots = tops(leaves, above).select(F.lit("").alias("grp"), F.col("grp").alias("of"), "h")
    subroots = written(numbered(subroots, ["of"]), "subroots")
    higher = levels(subroots, fanout)
    root = tops(subroots, higher).select("grp", F.col("h").alias("root"), F.lit(b"").alias("proof"))
    start = proofs(subroots, higher, root, fanout).select(F.col("of").alias("grp"), "proof", F.col("h").alias("subroot"), F.col("idx").alias("lang_idx"), F.col("m").alias("lang_m"), "root")
    return proofs(leaves, above, written(start, "starts"), fanout).select("doc_id", "lang", F.col("h").alias("leaf"), "tampered", "idx", "m", "subroot", "lang_idx", "lang_m", "root", "proof")


def checked(rows: DataFrame, leaf: Column, fanout: int = FANOUT) -> DataFrame:
    """Rows of a manifest with folded_root, the root that ``leaf`` and the proof lead to."""
    first = folded(leaf, F.col("proof"), F.lit(1), F.col("idx"), F.col("m"), fanout)
    held = rows.withColumn("to_subroot", first)
    last = folded(F.col("to_subroot.h"), F.col("proof"), F.col("to_subroot.at"), F.col("lang_idx"), F.col("lang_m"), fanout)
    return held.withColumn("folded_root", last["h"]).drop("to_subroot")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, and whether each proof holds where some leaves are tampered with."""
    rows = checked(manifest(table(spark, sf_dir, "documents")), F.coalesce("tampered", "leaf"))
    proof = F.sha2(F.lower(F.hex("proof")).cast("binary"), 256)
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_field(c: str) -> str:
    return f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"


def _sql_leaf(changed: bool) -> str:
    return "sha256(" + " || ".join(_sql_field("(n_chars + 1)" if changed and c == "n_chars" else c) for c in FIELDS) + ")"


#: The polynomial is that of CRC-32; languages and leaves are numbered by windows, levels and proofs come from recursive queries.
SQL = f"""
with recursive crc_table as (
  select k, list_reduce(list_prepend(k, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from (select unnest(range(256)) as k)
), crcs as (select list(v order by k) as t from crc_table),
leaves as (
  select doc_id, coalesce('=' || lang, '') as grp, {_sql_leaf(False)} as leaf,
    case when xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint) % {TAMPERED} = 0
      then {_sql_leaf(True)} else {_sql_leaf(False)} end as used
  from documents, crcs
), numbered as (
  select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by grp) as m from leaves
), low(grp, lvl, idx, m, h, kids) as (
  select grp, 0, idx, m, leaf, []::varchar[] from numbered
  union all
  select grp, lvl + 1, idx // 2, (m + 1) // 2, sha256(string_agg(h, '' order by idx)), list(h order by idx) from low where m > 1 group by grp, lvl, idx // 2, (m + 1) // 2
), subroots as (
  select grp as lang, h as subroot, row_number() over (order by grp) - 1 as idx, count(*) over () as m from low where m = 1
), high(lvl, idx, m, h, kids) as (
  select 0, idx, m, subroot, []::varchar[] from subroots
  union all
  select lvl + 1, idx // 2, (m + 1) // 2, sha256(string_agg(h, '' order by idx)), list(h order by idx) from high where m > 1 group by lvl, idx // 2, (m + 1) // 2
), climb(grp, i, lvl, idx, m, used, proof) as (
  select grp, idx, 0, idx, m, used, '' from numbered
  union all
  select c.grp, c.i, c.lvl + 1, c.idx // 2, n.m, sha256(array_to_string(list_concat(kids[1:c.idx % 2], [c.used], kids[c.idx % 2 + 2:]), '')),
    c.proof || array_to_string(list_concat(kids[1:c.idx % 2], kids[c.idx % 2 + 2:]), '')
  from climb c join low n on n.grp = c.grp and n.lvl = c.lvl + 1 and n.idx = c.idx // 2 where c.m > 1
), rise(grp, i, lvl, idx, m, used, proof) as (
  select c.grp, c.i, 0, s.idx, s.m, c.used, c.proof from climb c join subroots s on s.lang = c.grp where c.m = 1
  union all
  select c.grp, c.i, c.lvl + 1, c.idx // 2, n.m, sha256(array_to_string(list_concat(kids[1:c.idx % 2], [c.used], kids[c.idx % 2 + 2:]), '')),
    c.proof || array_to_string(list_concat(kids[1:c.idx % 2], kids[c.idx % 2 + 2:]), '')
  from rise c join high n on n.lvl = c.lvl + 1 and n.idx = c.idx // 2 where c.m > 1
)
select n.doc_id, n.leaf, s.subroot, r.h as root, sha256(e.proof) as proof_sha256, e.used as folded_root, e.used = r.h as verified
from numbered n join subroots s on s.lang = n.grp join rise e on e.grp = n.grp and e.i = n.idx and e.m = 1, (select h from high where m = 1) r
"""
