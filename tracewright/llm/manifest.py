"""Merkle manifest of a dataset with one witness per row, built by streaming aligned append.

A tree of arity 8 is appended to from the left. An appender keeps, per level, the open run of completed nodes. A leaf starts
with an empty witness; whenever the run around one of its ancestors is completed, that run's other nodes extend it. Blocks
are aligned to 8^LEVELS leaves, so the root of a block is a node of the whole tree. Blocks are appended to independently,
one small group each, and their roots are appended in turn to the next round's blocks, until one node is left per tree.
Witnesses then grow downwards: a block's leaves take their block's witness behind their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import ordered_parts
from tracewright.session import cut_lineage

ARITY, LEVELS = 8, 3
#: Siblings at one level: hex digests joined, those before and those behind the path's own node.
WITNESS = "array<struct<before:string,behind:string>>"
WITNESS_TYPE = pa.list_(pa.struct([("before", pa.string()), ("behind", pa.string())]))


def digest(joined: str) -> str:
    return hashlib.sha256(joined.encode("ascii")).hexdigest()


class Appender:
    """Nodes appended from the left, with the open run of every level and the witnesses of all nodes so far."""

    def __init__(self, levels: int, arity: int = ARITY):
        self.levels, self.arity = levels, arity
        self.runs: list[list[tuple[str, range]]] = [[] for _ in range(levels + 1)]
        self.witnesses: list[list[tuple[str, str]]] = []

    def append(self, node: str) -> None:
        self.witnesses.append([])
        self._join(0, node, range(len(self.witnesses) - 1, len(self.witnesses)))

    def _join(self, level: int, node: str, members: range) -> None:
        self.runs[level].append((node, members))
        if level < self.levels and len(self.runs[level]) == self.arity:
            self._complete(level)

    def _complete(self, level: int) -> None:
        """Hash a run to its parent and hand its siblings to the open witnesses below each of its nodes."""
        run, self.runs[level] = self.runs[level], []
        nodes = [n for n, _ in run]
        for i, (_, members) in enumerate(run):
            siblings = ("".join(nodes[:i]), "".join(nodes[i + 1 :]))
            for leaf in members:
                self.witnesses[leaf].append(siblings)
        self._join(level + 1, digest("".join(nodes)), range(run[0][1].start, run[-1][1].stop))

    def close(self) -> str:
        """The root, after the last runs of all levels, which may be short."""
        for level in range(self.levels):
            if self.runs[level]:
                self._complete(level)
        return self.runs[self.levels][0][0]


def height(leaves: int, arity: int = ARITY) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // arity), levels + 1
    return levels


def numbered(df: DataFrame, tree: str, *order: str) -> DataFrame:
    """Adds `pos`, the place of a row in its tree from 0 on, and `total`, the rows of its tree.

    Places come from one count per (task, tree) of range-partitioned rows; `order` must tell rows of a tree apart, so that
    rows of one tree, id and content are spread over tasks too.
    """
    parts = ordered_parts(df, F.col(tree), *[F.col(c) for c in order])
    counts = parts.groupBy("_part", tree).agg(F.count("*").alias("_n"))
    line = Window.partitionBy(tree).orderBy("_part")
    counts = counts.select("_part", tree, (F.sum("_n").over(line) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(tree)).alias("total"))
    inside = Window.partitionBy("_part", tree).orderBy(*order)
    return parts.withColumn("_at", F.row_number().over(inside) - 1).join(counts, ["_part", tree]).withColumn("pos", F.col("_before") + F.col("_at")).drop("_part", "_before", "_at")


def block_of(levels: int) -> Column:
    return F.expr(f"pos div {ARITY**levels}")


def block_appender(batches: list[pa.Table], levels: int) -> tuple[Appender, str, int]:
    """Appender over one block's rows in order of place, its root, and the nodes of its tree in this round."""
    rows = sorted(zip(batches["pos"].to_pylist(), batches["node"].to_pylist()))
    total = batches["total"][0].as_py()
    appender = Appender(min(levels, height(total)))
    for _, node in rows:
        appender.append(node)
    return appender, appender.close(), total


def block_roots(nodes: DataFrame, tree: str, levels: int = LEVELS) -> DataFrame:
    """One node per block, the next round's nodes: (tree, pos, node, total)."""
    kind = nodes.schema[tree].dataType.simpleString()

    def work(group: pa.Table) -> pa.Table:
        _, root, total = block_appender(group, levels)
        place = group["pos"][0].as_py() // ARITY**levels
        return pa.table({tree: group[tree][:1], "pos": [place], "node": [root], "total": [-(-total // ARITY**levels)]})

    return nodes.select(tree, "pos", "node", "total", block_of(levels).alias("_block")).groupBy(tree, "_block").applyInArrow(work, f"{tree} {kind}, pos long, node string, total long")


def extended(nodes: DataFrame, above: DataFrame, tree: str, levels: int = LEVELS) -> DataFrame:
    """`nodes` with their witnesses: those of their own block, extended by the witness of the block's root.

    `above` has (tree, pos, witness, and columns that all nodes below take over) of the round above.
    """
    handed = [f for f in above.schema.fields if f.name not in (tree, "pos", "node", "total", "witness")]
    fields = [f for f in nodes.schema.fields] + handed
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", witness {WITNESS}"

    def work(group: pa.Table, over: pa.Table) -> pa.Table:
        order = group.sort_by("pos")
        appender, _, _ = block_appender(order, levels)
        rest = [(w["before"], w["behind"]) for w in over["witness"][0].as_py()]
        made = [[{"before": a, "behind": b} for a, b in own + rest] for own in appender.witnesses]
        out = order.drop_columns(["_block"])
        for f in handed:
            out = out.append_column(f.name, pa.array([over[f.name][0].as_py()] * out.num_rows, over.schema.field(f.name).type))
        return out.append_column("witness", pa.array(made, WITNESS_TYPE))

    left = nodes.withColumn("_block", block_of(levels)).groupBy(tree, "_block")
    right = above.select(F.col(tree), F.col("pos").alias("_block"), "witness", *[f.name for f in handed]).groupBy(tree, "_block")
    return left.cogroup(right).applyInArrow(work, schema)


def completed(nodes: DataFrame, tree: str, levels: int = LEVELS) -> list[DataFrame]:
    """Rounds of nodes: the given numbered ones (tree, pos, node, total, any more), then block roots, to one node per tree.

    The rounds go on while any tree has more than one node: their number follows from the largest tree. Each round's nodes
    are written once; a round has 8^levels times fewer rows than the one before.
    """
    rounds, size = [nodes], nodes.agg(F.max("total")).first()[0] or 0
    while size > 1:
        rounds.append(cut_lineage(block_roots(rounds[-1], tree, levels)))
        size = -(-size // ARITY**levels)
    return rounds


def witnessed(rounds: list[DataFrame], top: DataFrame, tree: str, levels: int = LEVELS) -> DataFrame:
    """The first round's nodes with `witness`, from (tree, witness, any more) of the trees' roots in what lies above them."""
    above = rounds[-1].join(top, tree)
    for below in rounds[-2::-1]:
        above = extended(below, above, tree, levels)
    return above


def row_leaf(columns: list[Column]) -> Column:
    """SHA-256 over the values of a row, each `-` if null, else its UTF-8 byte count, a colon and the value."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.encode(F.concat(*[one(c.cast("string")) for c in columns]), "UTF-8"), 256)


def folded(leaf: Column, witness: Column) -> Column:
    """Root that a leaf and its witness give."""
    return F.aggregate(witness, leaf, lambda node, w: F.sha2(F.encode(F.concat(w["before"], node, w["behind"]), "UTF-8"), 256))


def siblings(witness: Column) -> Column:
    """All sibling digests of a witness, level by level, left to right."""
    return F.concat_ws("", F.transform(witness, lambda w: F.concat(w["before"], w["behind"])))


def manifest(leaves: DataFrame, tree: str, *order: str, levels: int = LEVELS) -> DataFrame:
    """`leaves` (any columns, with `node`, their digest) with pos, total, subroot, root and witness up to the root.

    One tree per value of `tree`, leaves by `order` (nulls first); equal rows keep the order of the written copy. Subroots
    are the leaves of one more tree, ordered by `tree`, null first. A null is a value of `tree` like any other. No rows give none.
    """
    # Written once: digests are taken a single time, and the row number breaks ties alike in every pass.
    name = F.concat(F.when(F.col(tree).isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(F.col(tree).cast("string"), F.lit("")))
    slim = cut_lineage(leaves.withColumns({"_row": F.monotonically_increasing_id(), "_tree": name}))
    rounds = completed(numbered(slim, "_tree", *order, "_row"), "_tree", levels)
    subroots = rounds[-1].select(F.lit(0).alias("_all"), F.col("_tree").alias("_member"), F.col("node"))
    tops = completed(numbered(subroots, "_all", "_member"), "_all", levels)
    root = tops[-1].select("_all", F.col("node").alias("root"), F.array().cast(WITNESS).alias("witness"))
    over = witnessed(tops, root, "_all", levels)
    over = over.select(F.col("_member").alias("_tree"), F.col("node").alias("subroot"), "root", "witness")
    # One row per tree, small beside its leaves; the leaves meet it block by block, not in a join of their own.
    return witnessed(rounds, cut_lineage(over), "_tree", levels).drop("_tree", "_row")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tamper_audit(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Manifest of the documents per language, and what each row's witness says of its tampered copy.

    Rows whose id's crc32 is divisible by 3 are tampered with: A-Z of the text is lower-cased. Rows without id come first in
    their language, by leaf, and are not tampered with. Rows that repeat an id are ordered by leaf; equal rows have a leaf each.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    leaf = row_leaf([F.col(c) for c in columns])
    changed = row_leaf([F.col(c) for c in columns[:-1]] + [lower_ascii(F.col("text"))])
    chosen = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    leaves = docs.select("doc_id", "lang", leaf.alias("node"), F.when(chosen, changed).alias("tampered"))
    rows = manifest(leaves, "lang", "doc_id", "node", levels=levels)
    out = rows.withColumns({"proof_sha256": F.sha2(F.encode(siblings(F.col("witness")), "UTF-8"), 256), "folded_root": folded(F.coalesce("tampered", "node"), F.col("witness"))})
    return out.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


CHECK_SQL = r"""
with recursive rows as (
  select *, doc_id::varchar as id,
    case when text is null then '-' else strlen(text) || ':' || text end as said,
    case when text is null then '-' else strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') end as low,
    concat(case when doc_id is null then '-' else strlen(doc_id::varchar) || ':' || doc_id end, case when source is null then '-' else strlen(source) || ':' || source end,
      case when lang is null then '-' else strlen(lang) || ':' || lang end, case when n_chars is null then '-' else strlen(n_chars::varchar) || ':' || n_chars end) as head
  from documents),
sums as (select *, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(id) + 1), lambda i: ascii(id[i])::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda d, j: xor(d >> 1, 3988292384 * (d & 1))))) as crc from rows),
leaves as (select doc_id, coalesce('1' || lang, '0') as tree, sha256(head || said) as leaf, case when crc % 3 = 0 then sha256(head || low) else sha256(head || said) end as shown from sums),
placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as total from leaves),
low(tree, level, total, pos, node) as (
  select tree, 0, total, pos, leaf from placed union all
  select tree, level + 1, (total + 7) // 8, pos // 8, sha256(string_agg(node, '' order by pos)) from low where total > 1 group by tree, level, total, pos // 8),
subroots as (select tree, node as subroot, row_number() over (order by encode(tree)) - 1 as pos, count(*) over () as total from low where total = 1),
high(level, total, pos, node) as (
  select 0, total, pos, subroot from subroots union all
  select level + 1, (total + 7) // 8, pos // 8, sha256(string_agg(node, '' order by pos)) from high where total > 1 group by level, total, pos // 8),
steps as (
  select tree, false as top, level, total, pos, coalesce(string_agg(node, '') over before, '') as before, coalesce(string_agg(node, '') over behind, '') as behind from low
  window before as (partition by tree, level, pos // 8 order by pos rows between unbounded preceding and 1 preceding), behind as (partition by tree, level, pos // 8 order by pos rows between 1 following and unbounded following)
  union all
  select '', true, level, total, pos, coalesce(string_agg(node, '') over before, ''), coalesce(string_agg(node, '') over behind, '') from high
  window before as (partition by level, pos // 8 order by pos rows between unbounded preceding and 1 preceding), behind as (partition by level, pos // 8 order by pos rows between 1 following and unbounded following)),
walk(doc_id, leaf, tree, top, level, pos, total, proof, node) as (
  select doc_id, leaf, tree, false, 0, pos, total, '', shown from placed union all
  select w.doc_id, w.leaf, w.tree, w.total = 1 or w.top, case when w.total = 1 and not w.top then 0 else w.level + 1 end,
    case when w.total = 1 and not w.top then r.pos else w.pos // 8 end, case when w.total = 1 and not w.top then r.total else (w.total + 7) // 8 end,
    case when w.total = 1 then w.proof else w.proof || s.before || s.behind end, case when w.total = 1 then w.node else sha256(s.before || w.node || s.behind) end
  from walk w join subroots r on w.tree = r.tree join steps s on s.top = w.top and s.level = w.level and s.pos = w.pos and s.tree = case when w.top then '' else w.tree end
  where w.total > 1 or not w.top)
select doc_id, leaf, subroot, h.node as root, sha256(proof) as proof_sha256, w.node as folded_root, w.node = h.node as verified
from walk w join subroots using (tree), (select node from high where total = 1) h where w.top and w.total = 1
"""
