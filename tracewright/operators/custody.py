"""Run logs as data: hash chains, leaves, Merkle roots, proofs and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.hashing import canonical_json, node_hash, sha256_hex
from tracewright.operators.joins import leaf_diff, trace
from tracewright.functions.values import value_match
from tracewright.operators.ordered import dense_index, null_safe_join
from tracewright.session import cut_lineage

# Lines of one log handled by one task.
CHAIN_BLOCK = 100_000
# Fixed value: root of a log without leaves.
EMPTY_ROOT = "0" * 64


def chain_state(audit: DataFrame, keys=("case_id",), order: str = "line_no", line: str = "line") -> DataFrame:
    """Adds to each line its position, and the digest of the line before it; lines without a number come last."""
    key = list(keys)
    rows = audit.where(F.col(line) != "").withColumn("__b", F.floor(F.col(order) / CHAIN_BLOCK)).withColumn("line_hash", sha256_hex(F.col(line)))
    inside = Window.partitionBy(*key, "__b").orderBy(order, line)
    edges = rows.groupBy(*key, "__b").agg(F.count(F.lit(1)).alias("__n"), F.max_by(line, F.struct(order, line)).alias("__line")).withColumn("__last", sha256_hex(F.col("__line")))
    before = Window.partitionBy(*key).orderBy(F.col("__b").asc_nulls_last())
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(*key, "__b", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"), F.lag("__last").over(before).alias("__carry"))
    placed = rows.withColumn("__rn", F.row_number().over(inside)).withColumn("__prev", F.lag("line_hash").over(inside))
    out = null_safe_join(placed, carried, [*key, "__b"])
    prev = F.coalesce("__prev", "__carry", F.lit(""))
    return out.select(*audit.columns, "line_hash", (F.col("__rn") + F.col("__off") - 1).cast("long").alias("position"), prev.alias("expected_prev"))


def chain_breaks(state: DataFrame, declared_seq: Column, declared_prev: Column, canonical: Column) -> DataFrame:
    """Reason per line, null where the line is in order."""
    reason = (
        F.when(canonical.isNull(), "not_json")
        .when(declared_seq.isNull() | (declared_seq != F.col("position")), "sequence")
        .when(declared_prev.isNull() | (declared_prev != F.col("expected_prev")), "prev_hash")
        .when(canonical != F.col("line"), "not_canonical")
    )
    return state.withColumn("reason", reason)


def first_breaks(checked: DataFrame, keys=("case_id",)) -> DataFrame:
    """One row per log: records, whether the chain holds, and where and why it first breaks."""
    bad = F.col("reason").isNotNull()
    at = F.when(bad, F.col("position"))
    return checked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"),
        F.min(at).alias("break_at"),
        F.min_by("reason", at).alias("reason"),
        F.max_by("line_hash", "position").alias("final_hash"),
    ).withColumn("chain_ok", F.col("break_at").isNull())


def verify_chain(audit: DataFrame, keys=("case_id",), order: str = "line_no") -> DataFrame:
    """Check position, previous digest and canonical form of every line of every log."""
    state = chain_state(audit, keys, order)
    seq = F.get_json_object("line", "$.seq").try_cast("long")
    prev = F.get_json_object("line", "$.prev_hash")
    return first_breaks(chain_breaks(state, seq, prev, canonical_json(F.col("line"))), keys)


def leaves(audit: DataFrame, keys=("case_id",)) -> DataFrame:
    """Sealed records in order: outputs by their digest, approvals by the digest of their line."""
    digest = F.lower(F.regexp_replace(F.coalesce("output_hash", F.lit("")), "^sha256:", ""))
    line = sha256_hex(F.col("line"))
    output = F.col("kind") == "tool_call_output"
    rows = audit.where(F.col("kind").isin("tool_call_output", "finding_approved")).select(
        *keys, "seq",
        F.when(output, "tool_call_output").otherwise("finding").alias("kind"),
        F.when(output & digest.rlike("^[0-9a-f]{64}$"), digest).otherwise(line).alias("digest_hex"),
        F.when(output, F.col("tool_call_id")).otherwise(F.col("finding_id")).alias("record_id"),
    )
    return dense_index(rows, list(keys), ["seq"], F.floor(F.col("seq") / CHAIN_BLOCK), "leaf_idx")


def _halve(nodes: Column) -> Column:
    """Parents of a list of nodes; a lone last node is paired with itself."""
    pairs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / 2).cast("int") - 1)
    return F.transform(pairs, lambda i: node_hash(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.get(nodes, 2 * i))))


def _blocks(nodes: DataFrame, key, bits: int) -> DataFrame:
    """Aligned runs of 2^bits nodes, each gathered in order; a run never holds more than that."""
    packed = F.transform(F.array_sort(F.collect_list(F.struct("idx", "h"))), lambda n: n["h"])
    return nodes.groupBy(*key, F.shiftright("idx", bits).alias("block")).agg(packed.alias("nodes"), F.first("n").alias("n"), F.first("leaf_count").alias("leaf_count"))


def _fold(nodes: Column, alone: Column, bits: int) -> Column:
    steps = F.sequence(F.lit(1), F.lit(bits))
    return F.aggregate(steps, nodes, lambda acc, _: F.when(alone & (F.size(acc) == 1), acc).otherwise(_halve(acc)))


def _levels(nodes: Column, alone: Column, bits: int) -> Column:
    """All levels of a block's tree: the nodes, their parents, and so on for `bits` steps, or up to the one node of a tree that is `alone`."""
    steps = F.sequence(F.lit(1), F.lit(bits))

    def add(acc: Column, _step: Column) -> Column:
        top = F.element_at(acc, -1)
        return F.when(alone & (F.size(top) == 1), acc).otherwise(F.array_append(acc, _halve(top)))

    return F.aggregate(steps, F.array(nodes), add)


def _steps_up(levels: Column, at: Column) -> Column:
    """(siblings, sides) from place `at` of the lowest level to the highest; a lone last node is its own sibling."""

    def step(level: Column, number: Column) -> Column:
        i = F.call_function("shiftright", at, number)
        right = i % 2 == 1
        mate = F.coalesce(F.get(level, F.when(right, i - 1).otherwise(i + 1)), F.get(level, i))
        return F.struct(mate.alias("siblings"), right.alias("sides"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step)


def _level_zero(leaf_rows: DataFrame, key) -> DataFrame:
    sizes = leaf_rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return leaf_rows.select(*key, F.col("leaf_idx").alias("idx"), F.lower("digest_hex").alias("h")).join(sizes.withColumn("leaf_count", F.col("n")), list(key))


def _climbed(blocks: DataFrame, key, bits: int) -> DataFrame:
    """The next round's nodes: one for each block of this one."""
    alone = F.col("n") <= (1 << bits)
    return blocks.select(*key, F.col("block").alias("idx"), F.get(_fold(F.col("nodes"), alone, bits), F.lit(0)).alias("h"), F.ceil(F.col("n") / (1 << bits)).cast("long").alias("n"), "leaf_count")


def merkle_root(leaf_rows: DataFrame, keys=("case_id",), bits: int = 12, rounds: int = 3) -> DataFrame:
    """Root and leaf count per key, in rounds that fold 2^bits nodes to one, until one node of each key is left.

    `rounds` are folded before what is left is looked at, so three of 12 bits, 2^36 leaves of one log, need one look. Rounds beyond
    a key's root leave it as it is. Every look stores the nodes left, which are few by then.
    """
    key = list(keys)
    nodes = _level_zero(leaf_rows, key)
    while True:
        for _ in range(rounds):
            nodes = _climbed(_blocks(nodes, key, bits), key, bits)
        nodes = cut_lineage(nodes)
        if nodes.where("n > 1").isEmpty():
            break
    return nodes.select(*key, F.col("h").alias("merkle_root"), "leaf_count")


def inclusion_proofs(leaf_rows: DataFrame, chosen: DataFrame, keys=("case_id",), bits: int = 6) -> DataFrame:
    """Sibling digests and sides from each chosen leaf up to the root; only blocks on its way are read.

    The blocks of every round are stored, so a round reads what the last one left, and rounds go on while any key has several nodes.
    A chosen leaf that doesn't exist has no row.
    """
    key = list(keys)
    width = 1 << bits
    nodes = _level_zero(leaf_rows, key)
    paths = chosen.select(*key, "leaf_idx").join(leaf_rows.select(*key, "leaf_idx", F.lower("digest_hex").alias("leaf_hash")), [*key, "leaf_idx"])
    paths = paths.withColumns({"at": F.col("leaf_idx"), "siblings": F.array().cast("array<string>"), "sides": F.array().cast("array<boolean>")})
    alone = F.col("n") <= width

    while True:
        blocks = cut_lineage(_blocks(nodes, key, bits))
        # Every node of a block is hashed once; the leaves below only pick their siblings.
        levels = blocks.select(*key, "block", _levels(F.col("nodes"), alone, bits).alias("levels"))
        moved = paths.withColumn("block", F.shiftright("at", bits)).join(levels, [*key, "block"])
        moved = moved.withColumn("steps", _steps_up(F.col("levels"), (F.col("at") % width).cast("int")))
        joined = [F.concat(c, F.col(f"steps.{c}")).alias(c) for c in ("siblings", "sides")]
        paths = moved.select(*key, "leaf_idx", "leaf_hash", F.col("block").alias("at"), *joined)
        nodes = _climbed(blocks, key, bits)
        if blocks.where(~alone).isEmpty():
            break
    return paths.drop("at").join(nodes.select(*key, F.col("h").alias("root")), key)


def check_proofs(proofs: DataFrame) -> DataFrame:
    """Rebuild each root from its leaf and siblings."""
    steps = F.arrays_zip("siblings", "sides")
    rebuilt = F.aggregate(steps, F.col("leaf_hash"), lambda h, s: F.when(s["sides"], node_hash(s["siblings"], h)).otherwise(node_hash(h, s["siblings"])))
    return proofs.withColumn("proof_ok", rebuilt == F.col("root"))


def compare_manifest(manifest: DataFrame, declared: DataFrame, chain: DataFrame, derived: DataFrame, keys=("case_id",), slices: DataFrame | None = None) -> DataFrame:
    """One row per sealed case: chain, count, final digest, leaves, root and signature presence.

    Manifest columns: merkle_root_hex, leaf_count, audit_log_record_count, audit_log_final_hash, signature_present.
    Declared and derived leaves are rows with leaf_idx, seq, kind, digest_hex, record_id, so a long list is never one value.
    Given the rows of `recheck_slices`, the first failing slice of a case is told too; it doesn't count in `overall`.
    """
    key = list(keys)
    differing = leaf_diff(declared, derived, keys).groupBy(*key).agg(F.count(F.lit(1)).alias("leaf_differences"))
    rebuilt = merkle_root(declared, keys).withColumnRenamed("leaf_count", "declared_leaves")
    out = manifest.join(chain, key, "left").join(differing, key, "left").join(rebuilt, key, "left")
    out = out.withColumns({
        "chain_ok": F.coalesce("chain_ok", F.lit(False)),
        "count_ok": F.coalesce(F.col("records") == F.col("audit_log_record_count"), F.lit(False)),
        "final_ok": F.coalesce(F.col("final_hash") == F.col("audit_log_final_hash"), F.lit(False)),
        "leaves_ok": F.coalesce("leaf_differences", F.lit(0)) == 0,
        "root_ok": F.coalesce("merkle_root", F.lit(EMPTY_ROOT)) == F.col("merkle_root_hex"),
        "leaf_count_ok": F.coalesce("declared_leaves", F.lit(0)) == F.col("leaf_count"),
    })
    flags = ("chain_ok", "count_ok", "final_ok", "leaves_ok", "root_ok", "leaf_count_ok", "signature_present")
    every = F.lit(True)
    for flag in flags:
        every = every & F.col(flag)
    told = []
    if slices is not None:
        failing = slices.where("slice_reason IS NOT NULL").groupBy(*key).agg(F.min_by(F.struct("subject", "slice_reason"), F.struct("seq", "subject", "slice_reason")).alias("__slice"))
        out = out.join(failing, key, "left")
        told = [F.col("__slice").isNull().alias("entailment_ok"), F.col("__slice.subject").alias("entailment_subject"), F.col("__slice.slice_reason").alias("entailment_reason")]
    return out.select(*key, *flags, every.alias("overall"), "break_at", "reason", *told)


def declared_leaves(manifest: DataFrame, keys=("case_id",)) -> DataFrame:
    """Leaf rows of manifests that carry their list as an array, as the sealed files do."""
    return manifest.select(*keys, F.posexplode("leaves").alias("leaf_idx", "leaf")).select(*keys, F.col("leaf_idx").cast("long"), "leaf.*")


def verify_manifest(manifest: DataFrame, audit: DataFrame, keys=("case_id",), order: str = "line_no") -> DataFrame:
    """compare_manifest against the chain and leaves read from the log's own lines."""
    fields = {"kind": "$.kind", "seq": "$.seq", "output_hash": "$.payload.output_hash", "tool_call_id": "$.payload.tool_call_id", "finding_id": "$.payload.finding_id"}
    read = audit.select(*keys, "line", *[F.get_json_object("line", p).alias(c) for c, p in fields.items()]).withColumn("seq", F.col("seq").try_cast("long"))
    return compare_manifest(manifest.drop("leaves"), declared_leaves(manifest, keys), verify_chain(audit, keys, order), leaves(read, keys), keys, recheck_slices(audit, keys))


def _sealed_leaf(match: Column) -> Column:
    """The value sealed in a matched entry as a leaf: its text and kind."""
    actual = F.try_variant_get(match, "$.actual", "variant")
    told = F.schema_of_variant(actual)
    kind = (
        F.when(told == "STRING", "str").when(told == "BOOLEAN", "bool").when(told == "VOID", "null")
        .when(told.startswith("OBJECT"), "object").when(told.startswith("ARRAY"), "list")
        .when(told.rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\(\d+,0\))$"), "int").otherwise("float")
    )
    text = F.coalesce(F.try_variant_get(match, "$.actual", "string"), F.lit(""))
    # Leaves name truth values with a capital.
    return F.struct(kind.alias("kind"), F.when(told == "BOOLEAN", F.initcap(text)).otherwise(text).alias("text"))


def _entry_fault(match: Column) -> Column:
    """Why a matched entry of a slice no longer holds; null where it does."""
    text = lambda name, default: F.coalesce(F.try_variant_get(match, f"$.{name}", "string"), F.lit(default))
    path, expected, mode, leaf = text("path", "?"), text("expected", ""), text("match", "exact"), _sealed_leaf(match)
    wanted = F.try_variant_get(F.try_parse_json(expected), "$", "map<string,variant>")
    held = F.forall(F.map_values(wanted), lambda v: F.contains(F.lower(leaf["text"]), F.lower(F.trim(F.try_variant_get(v, "$", "string")))))
    return (
        F.when(~F.schema_of_variant(match).startswith("OBJECT"), "malformed matched entry")
        .when((mode == "record") & F.try_parse_json(expected).isNull(), F.concat(F.lit("expected is not JSON at "), path))
        .when((mode == "record") & ~F.coalesce(held, F.lit(False)), F.concat(F.lit("record no longer holds at "), path))
        .when((mode != "record") & ~value_match(expected, leaf, mode), F.concat(F.lit("value no longer holds at "), path))
    )


def recheck_slices(audit: DataFrame, keys=("case_id",), line: str = "line") -> DataFrame:
    """Sealed entailment slices of replay records: (keys, seq, subject, matched, slice_reason), the reason null where all hold.

    Values sealed in the log are matched again with what their finding asserted; no output is read. The reason is that of the
    first entry that fails. A slice that is no object fails, one that says it passed but lists failures too; replay records
    without a slice, and lines that aren't JSON, have no row. All of it happens row by row, without a shuffle.
    """
    record = F.try_parse_json(F.col(line))
    at = lambda path, kind: F.try_variant_get(F.col("__r"), path, kind)
    rows = audit.where(F.contains(line, F.lit("replay"))).select(*keys, record.alias("__r")).where(at("$.kind", "string") == "replay")
    rows = rows.withColumn("__s", at("$.payload.replay_artifact.entailment", "variant"))
    rows = rows.where(F.col("__s").isNotNull() & (F.schema_of_variant("__s") != "VOID")).withColumns({
        "seq": at("$.seq", "long"),
        "__m": F.coalesce(F.try_variant_get(F.col("__s"), "$.matched", "array<variant>"), F.array().cast("array<variant>")),
        "__passed": F.coalesce(F.try_variant_get(F.col("__s"), "$.passed", "boolean"), F.lit(False)),
        "__failures": F.coalesce(F.size(F.try_variant_get(F.col("__s"), "$.failures", "array<variant>")), F.lit(0)),
    })
    faults = F.filter(F.transform("__m", _entry_fault), lambda r: r.isNotNull())
    reason = (
        F.when(~F.schema_of_variant("__s").startswith("OBJECT"), "slice is not an object")
        .otherwise(F.coalesce(F.get(faults, F.lit(0)), F.when(F.col("__passed") & (F.col("__failures") > 0), "marked passed but lists failures")))
    )
    some = lambda path: F.nullif(at(path, "string"), F.lit(""))
    subject = F.coalesce(some("$.payload.finding_id"), some("$.payload.replay_artifact.tool_call_id"), F.concat(F.lit("seq-"), F.col("seq")))
    return rows.select(*keys, "seq", subject.alias("subject"), F.size("__m").cast("long").alias("matched"), reason.alias("slice_reason"))


def trace_to_leaves(findings: DataFrame, audit: DataFrame, sealed: DataFrame, roots: DataFrame, keys=("case_id",), bits: int = 6) -> DataFrame:
    """`trace` carried on to the sealed Merkle leaves of call and finding, and from there to the sealed root.

    `sealed` has the manifest's leaves (leaf_idx, seq, kind, digest_hex, record_id), `roots` its merkle_root_hex per key. Per finding,
    for its call and for itself: is there a leaf, does the leaf's digest equal that of the log's own record at its place, and does
    a proof from the log's digest lead to the sealed root? Of several leaves the first by index stands. `traced_to_leaf` asks
    for both leaves besides citation, start, output and approval; `proved` for all of `trace` and both proofs too.
    """
    key = list(keys)
    own = leaves(audit, keys).groupBy(*key, "seq", "kind", "record_id").agg(F.min("digest_hex").alias("own_hex"))
    entries = sealed.where("record_id <> ''").select(*key, "seq", "kind", "record_id", "leaf_idx")
    first = entries.groupBy(*key, "kind", "record_id").agg(F.min_by(F.struct("leaf_idx", "seq"), F.struct("leaf_idx", "seq")).alias("__f"))
    first = first.select(*key, "kind", "record_id", F.col("__f.leaf_idx").alias("leaf_idx"), F.col("__f.seq").alias("seq"))
    outcome = findings.select(*key, F.lit("tool_call_output").alias("kind"), F.col("tool_call_id").alias("record_id")).union(
        findings.select(*key, F.lit("finding").alias("kind"), F.col("finding_id").alias("record_id"))
    ).distinct()
    asked = cut_lineage(outcome.join(first, [*key, "kind", "record_id"]))
    proofs = inclusion_proofs(sealed, asked.select(*key, "leaf_idx").distinct(), keys, bits)
    known = asked.join(own, [*key, "seq", "kind", "record_id"], "left").join(proofs, [*key, "leaf_idx"], "left").join(roots.select(*key, "merkle_root_hex"), key, "left")
    # The proof starts from the log's digest, so a leaf changed together with its root fails as well.
    shown = check_proofs(known.withColumn("sealed_hash", F.col("leaf_hash")).withColumn("leaf_hash", F.lower("own_hex")).withColumn("root", F.lower("merkle_root_hex")))
    shown = shown.select(*key, "kind", "record_id", "leaf_idx", F.coalesce(F.col("sealed_hash") == F.col("leaf_hash"), F.lit(False)).alias("leaf_ok"), F.coalesce("proof_ok", F.lit(False)).alias("proof_ok"))
    out = trace(findings, audit, keys)
    for kind, name, column in (("tool_call_output", "call", "tool_call_id"), ("finding", "finding", "finding_id")):
        side = shown.where(F.col("kind") == kind).select(*key, F.col("record_id").alias(column), F.col("leaf_idx").alias(f"{name}_leaf_idx"), F.col("leaf_ok").alias(f"{name}_leaf_ok"), F.col("proof_ok").alias(f"{name}_proof_ok"))
        out = out.join(side, [*key, column], "left").withColumn(f"{name}_has_leaf", F.col(f"{name}_leaf_idx").isNotNull())
        out = out.withColumns({f"{name}_{flag}": F.coalesce(f"{name}_{flag}", F.lit(False)) for flag in ("leaf_ok", "proof_ok")})
    reached = F.col("has_citation") & F.col("has_start") & F.col("has_output") & F.col("is_approved") & F.col("call_has_leaf") & F.col("finding_has_leaf")
    proved = F.col("traced") & reached & F.col("call_leaf_ok") & F.col("call_proof_ok") & F.col("finding_leaf_ok") & F.col("finding_proof_ok")
    return out.withColumns({"traced_to_leaf": reached, "proved": proved})


def unresolved_leaves(sealed: DataFrame, audit: DataFrame, keys=("case_id",)) -> DataFrame:
    """Sealed leaves whose record_id is no call with an output and no finding of the log."""
    key = list(keys)
    calls = audit.where("kind = 'tool_call_output' AND tool_call_id <> ''").select(*key, F.col("tool_call_id").alias("record_id"))
    found = audit.where("finding_id <> ''").select(*key, F.col("finding_id").alias("record_id"))
    return sealed.where("record_id <> ''").join(calls.union(found), [*key, "record_id"], "left_anti")


def committed_traces(lines: DataFrame, summaries: DataFrame, order: str = "line_no") -> DataFrame:
    """Published excerpts of logs against their summaries: (file, format, records, break_at, reason, ok), one row per file.

    Lines: file, line_no, line. A file whose first record carries prev_hash is `chained`: sequence without gaps from any start,
    canonical lines, each line's prev_hash that of the line before, and the file's digest. Any other is `flat`: sequence
    from 0, record count, the spot-checked output's tool and digest, and the digest of every case_open output. Summaries: file,
    file_sha256 (of the file as it is), excerpt_sha256, record_count, tool_output_seq, tool_name, tool_output_sha256, evidence_sha256,
    null where not stated. Files without summary or without records fail. The reason is the first one, `break_at` its line.
    """
    got = lambda path: F.get_json_object("line", path)
    state = chain_state(lines, ("file",), order).withColumns({
        "__seq": got("$.seq").try_cast("long"), "__prev": got("$.prev_hash"), "__canonical": canonical_json(F.col("line")),
        "__tool": got("$.tool"), "__kind": got("$.kind"), "__hash": got("$.output_hash"),
    })
    firsts = state.where("position = 0").select("file", F.col("__seq").alias("__from"), F.col("__prev").isNotNull().alias("__chained"))
    rows = state.join(firsts, "file").join(summaries.select("file", "tool_output_seq", "evidence_sha256"), "file", "left")
    chained = F.col("__chained")
    fault = (
        F.when(F.col("__canonical").isNull(), "not_json")
        .when(F.coalesce(F.col("__seq") != F.col("position") + F.when(chained, F.col("__from")).otherwise(F.lit(0)), F.lit(True)), "sequence")
        .when(chained & (F.col("__canonical") != F.col("line")), "not_canonical")
        .when(chained & (F.col("position") > 0) & ~F.coalesce(F.col("__prev") == F.col("expected_prev"), F.lit(False)), "prev_hash")
    )
    spot = ~chained & (F.col("__seq") == F.col("tool_output_seq"))
    opened = ~chained & (F.col("__tool") == "case_open") & (F.col("__kind") == "tool_call_output") & F.col("evidence_sha256").isNotNull()
    per = rows.withColumn("__fault", fault).groupBy("file").agg(
        F.first("__chained").alias("__chained"), F.count(F.lit(1)).alias("records"),
        F.min(F.when(F.col("__fault").isNotNull(), F.struct("position", "__fault"))).alias("__broken"),
        F.max(F.when(spot, F.struct(F.coalesce("__tool", F.lit("")).alias("tool"), F.coalesce("__hash", F.lit("")).alias("digest")))).alias("__spot"),
        F.count_if(opened & ~F.coalesce(F.col("__hash") == F.col("evidence_sha256"), F.lit(False))).alias("__evidence"),
    )
    per = per.join(summaries.withColumn("__stated", F.lit(True)), "file", "full")
    differs = lambda found, stated: ~F.coalesce(F.col(found) == F.col(stated), F.lit(False))
    chained_end = F.when(F.col("excerpt_sha256").isNull(), "no_anchor").when(differs("file_sha256", "excerpt_sha256"), "file_digest")
    flat_end = (
        F.when(F.col("record_count").isNotNull() & differs("records", "record_count"), "record_count")
        .when(F.col("tool_output_seq").isNull(), "no_spot_check")
        .when(F.col("__spot").isNull(), "spot_missing")
        .when((F.coalesce("tool_name", F.lit("")) != "") & differs("__spot.tool", "tool_name"), "spot_tool")
        .when(F.col("tool_output_sha256").isNull(), "no_spot_digest")
        .when(differs("__spot.digest", "tool_output_sha256"), "spot_digest")
        .when(F.col("__evidence") > 0, "evidence_digest")
    )
    reason = (
        F.when(F.col("__stated").isNull(), "no_summary").when(F.col("records").isNull(), "no_records")
        .when(F.col("__broken").isNotNull(), F.col("__broken.__fault")).when(F.col("__chained"), chained_end).otherwise(flat_end)
    )
    out = per.withColumn("reason", reason)
    broken = F.when(F.col("reason") == F.col("__broken.__fault"), F.col("__broken.position"))
    return out.select("file", F.when(F.col("__chained"), "chained").when(~F.col("__chained"), "flat").alias("format"), F.coalesce("records", F.lit(0)).alias("records"), broken.alias("break_at"), "reason", F.col("reason").isNull().alias("ok"))


def verify_traces(lines: DataFrame) -> DataFrame:
    """verify_chain over many files at once, keyed by file."""
    return verify_chain(lines, keys=("file",))
