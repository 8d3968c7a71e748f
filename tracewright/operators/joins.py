"""Joins between evidence tables, findings and run logs.

Every join has an equality key. Where a rule compares pairs, the pairs are counted from group totals, or found
through a token index. Where the pairs are the result (`contradiction_partners` of chosen findings, `run_entries_in_files`), large
groups meet in blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import labels, text
from tracewright.functions.indicators import extract_cves
from tracewright.functions.paths import base_name, slashed
from tracewright.operators.ordered import DAY_US, asof_before, first_within, null_safe_join
from tracewright.operators.setops import view_counts
from tracewright.session import broadcast_if_small, cut_lineage

# Eligibility of a finding for an expected one.
MATCH_COVERAGE = 0.5
MATCH_MIN_SHARED = 3
# Fixed value: two descriptions of one artifact disagree below this overlap.
DISAGREE_BELOW = 0.30
# Token sets of one side that meet the other side in one part of a frequent token.
HOT_SETS = 4096
# Rows of either side that meet in one block of a group with many pairs.
BLOCK_ROWS = 2000


def blocked_join(left: DataFrame, right: DataFrame, keys, rows: int = BLOCK_ROWS) -> DataFrame:
    """Inner join on equal keys whose result may be far larger than its sides; the rows are those of a plain join.

    A group of more than rows * rows pairs is cut into blocks of about `rows` rows of each side, and every block is dealt out like a key
    of its own. So few or frequent keys are not the work of few tasks, and a row is copied once per block it meets, not once per pair.
    """
    key, spark = list(keys), left.sparkSession
    sizes = lambda side, name: side.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    large = sizes(left, "__l").join(sizes(right, "__r"), key).where(F.col("__l") * F.col("__r") > rows * rows)
    cuts = large.select(*key, *[F.ceil(F.col(c) / rows).cast("int").alias(c) for c in ("__l", "__r")])
    cuts = broadcast_if_small(cut_lineage(cuts))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        plain = [c for c, t in side.dtypes if not t.startswith(("array", "map", "struct", "variant"))]
        cut = side.join(cuts, key, "left").na.fill(1, ["__l", "__r"])
        cut = cut.withColumn("__at" + own, F.pmod(F.xxhash64(*plain), F.col(own)).cast("int")).withColumn("__at" + other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return cut.drop("__l", "__r").repartition(parts, *key, "__at__l", "__at__r")

    return dealt(left, "__l", "__r").join(dealt(right, "__r", "__l"), [*key, "__at__l", "__at__r"]).drop("__at__l", "__at__r")


def view_diff(listed: DataFrame, scanned: DataFrame, keys=("host", "pid", "image_name")) -> DataFrame:
    """Processes whose presence or count differs between two views; scan-only rows are hidden candidates."""
    both = view_counts(listed, scanned, list(keys)).where("in_a <> in_b")
    side = F.when(F.col("in_a") == 0, "scan_only").when(F.col("in_b") == 0, "list_only").otherwise("count_differs")
    return both.withColumn("difference", side)


def process_parents(created: DataFrame, keys=("host",), us: str = "us") -> DataFrame:
    """Each creation event with the latest earlier creation of its parent pid on the host."""
    children = created.withColumn("pid_key", F.col("parent_pid"))
    parents = created.select(*keys, F.col("new_pid").alias("pid_key"), us, "process_name", "record_id")
    return asof_before(children, parents, [*keys, "pid_key"], us, ["process_name", "record_id"], DAY_US, prefix="parent_").drop("pid_key")


def run_entries_in_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Run-count entries whose exact path is in the file table of the same host and volume.

    A deleted file counts only if it was last changed after the program's last run. A path of many entries and files, as where few
    programs run on a host, is met in blocks.
    """
    left = entries.withColumn("volume", F.upper(F.substring("program_path", 1, 1))).withColumn("path_key", slashed(F.substring_index("program_path", ":", -1)))
    right = files.select("host", "volume", F.concat(F.lit("/"), slashed(F.regexp_replace("full_path", "^/+", ""))).alias("path_key"), "is_allocated", "si_modified", "record_number")
    # Of deleted files, those without a time of change count for no run.
    right = right.where(F.coalesce("is_allocated", F.lit(False)) | F.col("si_modified").isNotNull())
    hit = blocked_join(left, right, ["host", "volume", "path_key"])
    alive = F.col("is_allocated") | F.coalesce(F.col("si_modified") >= F.col("last_run_us"), F.lit(False))
    return hit.where(alive).drop("path_key")


def run_entries_in_prefetch(entries: DataFrame, prefetch: DataFrame) -> DataFrame:
    """Run-count entries with a prefetch record of the same executable name on the host, run at least once."""
    runs = prefetch.where("run_count > 0").groupBy("host", F.lower("executable_name").alias("exe")).agg(F.max("run_count").alias("run_count"))
    return entries.withColumn("exe", base_name(F.col("program_path"))).join(runs, ["host", "exe"])


ARCHIVE_NAMES = r"(?i)\.(zip|rar|7z|tar|gz|tgz|cab)$"
SERVICING_NAMES = r"(?i)^(windows\d.*-kb\d+.*|wsusscan.*|[0-9a-f]{8}\.gz)$|^(?i)wsusscan"
DOCUMENT_NAMES = r"(?i)\.(docx?|xlsx?|pptx?|pdf|csv|txt|rtf|jpe?g|png|zip|rar|7z|msi|ps1)$"
SCRATCH_NAMES = r"(?i)^(~\$.*|__psscriptpolicytest.*|config\.msi|(?=[0-9]*[a-f])[0-9a-f]+\.(msi|tmp))$"

# Journal bits for creation, deletion and both rename halves.
CREATED, DELETED, OLD_NAME, NEW_NAME = 0x100, 0x200, 0x1000, 0x2000


def _has(bits: int) -> Column:
    return F.col("reason_mask").bitwiseAND(bits) != 0


def renamed_from(journal: DataFrame, keys=("host",)) -> DataFrame:
    """New name with the old name recorded for the same file entry at the same time."""
    cols = [*keys, "mft_entry", "us"]
    old = journal.where(_has(OLD_NAME)).groupBy(*cols).agg(F.min_by("filename", "usn").alias("renamed_from"))
    return journal.where(_has(NEW_NAME)).join(old, cols, "left")


def staged_archives(journal: DataFrame, gap_us: int = DAY_US, keys=("host",)) -> DataFrame:
    """User archives created, then deleted within the gap: the first deletion after each creation."""
    mine = F.col("filename").rlike(ARCHIVE_NAMES) & ~F.col("filename").rlike(SERVICING_NAMES)
    rows = journal.where(mine)
    made = rows.where(_has(CREATED | NEW_NAME)).select(*keys, "filename", "us", "usn", "mft_entry")
    gone = rows.where(_has(DELETED)).select(*keys, "filename", "us", F.col("usn").alias("delete_usn"))
    found = first_within(made, gone, [*keys, "filename"], "us", ["delete_usn"], gap_us, prefix="deleted_")
    return found.where("deleted_us IS NOT NULL").withColumnRenamed("deleted_delete_usn", "delete_usn")


def post_staging_deletions(journal: DataFrame, staged: DataFrame, window_us: int = 3_600_000_000, keys=("host",)) -> DataFrame:
    """Document deletions within the window after the latest archive creation on the host."""
    name = F.col("filename")
    docs = journal.where(_has(DELETED) & name.rlike(DOCUMENT_NAMES) & ~name.rlike(SCRATCH_NAMES) & ~name.rlike(ARCHIVE_NAMES))
    starts = staged.select(*keys, "us", F.col("filename").alias("archive"), F.col("us").alias("staged_us"))
    near = asof_before(docs.select(*keys, "filename", "us", "usn"), starts, list(keys), "us", ["archive", "staged_us"], DAY_US, prefix="")
    return near.where(F.col("us") - F.col("staged_us") <= window_us)


def finding_classes(findings: DataFrame, calls: DataFrame, keys=("case_id",)) -> DataFrame:
    """Distinct artifact classes behind each finding: its own call and those it derives from."""
    own = F.coalesce(F.col("derived_from"), F.array().cast("array<string>"))
    ids = findings.select(*keys, "finding_id", F.explode(F.array_distinct(F.array_append(own, F.col("tool_call_id")))).alias("tool_call_id"))
    classed = ids.where("tool_call_id <> ''").join(calls.select(*keys, "tool_call_id", "artifact_class"), [*keys, "tool_call_id"])
    # The class list is short and fixed, so the set stays small.
    sets = classed.groupBy(*keys, "finding_id").agg(F.array_sort(F.collect_set("artifact_class")).alias("classes"))
    out = findings.join(sets, [*keys, "finding_id"], "left").withColumn("classes", F.coalesce("classes", F.array().cast("array<string>")))
    return out.withColumn("class_count", F.size("classes"))


def trace(findings: DataFrame, audit: DataFrame, keys=("case_id",)) -> DataFrame:
    """Each finding's way through the log: call start, call output with a digest, approval, in order."""
    kind, call = F.col("kind"), F.col("tool_call_id")
    per_call = audit.where(kind.isin("tool_call_start", "tool_call_output") & (call != "")).groupBy(*keys, "tool_call_id").agg(
        F.min(F.when(kind == "tool_call_start", F.col("seq"))).alias("start_seq"),
        F.min(F.when(kind == "tool_call_output", F.col("seq"))).alias("output_seq"),
        F.max(F.when(kind == "tool_call_output", F.nullif("output_hash", F.lit("")))).alias("digest"),
    )
    approved = audit.where(kind == "finding_approved").groupBy(*keys, "finding_id").agg(F.min("seq").alias("approved_seq"))
    out = findings.join(per_call, [*keys, "tool_call_id"], "left").join(approved, [*keys, "finding_id"], "left")
    hops = {
        "has_citation": F.coalesce(call, F.lit("")) != "",
        "has_start": F.col("start_seq").isNotNull(),
        "has_output": F.col("output_seq").isNotNull(),
        "has_digest": F.col("digest").isNotNull(),
        "is_approved": F.col("approved_seq").isNotNull(),
    }
    out = out.withColumns(hops)
    whole = reduce(lambda a, b: a & b, [F.col(h) for h in hops])
    return out.withColumn("traced", whole & F.coalesce(F.col("output_seq") < F.col("approved_seq"), F.lit(False)))


def uncited(audit: DataFrame, keys=("case_id",)) -> DataFrame:
    """Approved findings whose call has no output earlier in the log."""
    made = audit.where("kind = 'tool_call_output' AND tool_call_id <> ''").groupBy(*keys, "tool_call_id").agg(F.min("seq").alias("first_output"))
    approved = audit.where("kind = 'finding_approved'").join(made, [*keys, "tool_call_id"], "left")
    return approved.where(F.col("first_output").isNull() | (F.col("first_output") >= F.col("seq"))).select(*keys, "finding_id", "seq", "tool_call_id")


def link_timeline(events: DataFrame, findings: DataFrame, keys=("case_id",)) -> DataFrame:
    """Timeline events with the findings of their call: how many, and the strongest tier."""
    per = findings.where("tool_call_id <> ''").groupBy(*keys, "tool_call_id").agg(
        F.count_distinct("finding_id").alias("linked_findings"),
        F.max(labels.confidence_rank(F.col("confidence"))).alias("best_rank"),
        F.min("finding_id").alias("first_finding_id"),
    )
    out = events.join(per, [*keys, "tool_call_id"], "left").withColumn("linked_findings", F.coalesce("linked_findings", F.lit(0)))
    tier = F.when(F.col("best_rank") == 2, "CONFIRMED").when(F.col("best_rank") == 1, "INFERRED").when(F.col("best_rank") == 0, "HYPOTHESIS")
    role = F.when(F.col("linked_findings") > 0, "finding_support").otherwise(F.col("significance"))
    return out.withColumn("confidence", tier).withColumn("significance", role).drop("best_rank")


def _signed(findings: DataFrame) -> DataFrame:
    rank = labels.confidence_rank(F.col("confidence"))
    return findings.withColumn("__rank", rank).withColumn("__tech", F.coalesce(F.nullif("mitre_technique", F.lit("")), F.lit(None)))


def candidate_claims(sets: DataFrame, keys, least: float, hot: int = HOT_SETS) -> DataFrame:
    """Pairs (sig_a, sig_b) of token sets within a key that may overlap by `least`, from counts alone; no such pair is missing.

    `sets` has a row per distinct token set: `__sig`, `__tokens`, and the sides it is on, `__a` and `__b`. Tokens are put in
    one order, rarest in the key first, and sets meet on the tokens of their prefixes. A meeting counts only if the sizes
    allow the overlap and enough tokens follow on both sides. Per pair the meetings are then counted: all common tokens up to
    the last one are among them, so with the rest that may follow they bound the overlap. A token of more than `hot` sets
    is cut into parts of about that many sets of one side, each of which meets the other side whole.
    """
    slack = 1e-6
    each = sets.select(*keys, "__sig", "__a", "__b", F.size("__tokens").alias("__n"), F.explode("__tokens").alias("t"))
    counts = each.groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("df"))
    rare = Window.partitionBy(*keys, "__sig").orderBy("df", "t")
    placed = each.join(counts, [*keys, "t"]).withColumn("__pos", F.row_number().over(rare))
    prefix = placed.where(F.col("__pos") <= F.col("__n") - F.ceil(F.col("__n") * least - slack).cast("int") + 1)
    part_count = F.ceil(F.col("df") / hot).cast("int")
    left = prefix.where("__a").select(*keys, "t", F.pmod(F.xxhash64("__sig"), part_count).cast("int").alias("part"), F.col("__sig").alias("sig_a"), F.col("__n").alias("n_a"), F.col("__pos").alias("pos_a"))
    right = prefix.where("__b").select(*keys, "t", F.explode(F.sequence(F.lit(0), part_count - 1)).alias("part"), F.col("__sig").alias("sig_b"), F.col("__n").alias("n_b"), F.col("__pos").alias("pos_b"))
    need = F.ceil((F.col("n_a") + F.col("n_b")) * (least / (1 + least)) - slack)
    after = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    sized = (F.col("n_a") >= F.col("n_b") * least - slack) & (F.col("n_b") >= F.col("n_a") * least - slack)
    met = left.join(right, [*keys, "t", "part"]).where(sized & (after + 1 >= need))
    # Positions of both sides grow together, so the last meeting has the fewest tokens after it.
    pairs = met.groupBy(*keys, "sig_a", "sig_b").agg(F.count(F.lit(1)).alias("shared"), F.min(after).alias("rest"), F.first(need).alias("need"))
    return pairs.where("shared + rest >= need").select(*keys, "sig_a", "sig_b")


def similar_claims(rows: DataFrame, keys, in_a: Column, in_b: Column, least: float = DISAGREE_BELOW) -> DataFrame:
    """Pairs of distinct token sets within a key whose overlap is at least `least`; exact.

    Rows carry `__sig` (digest of the token set) and `__tokens`. Copies collapse to one set first; sets are fetched and
    compared for the candidate pairs only.
    """
    sets = rows.groupBy(*keys, "__sig").agg(F.first("__tokens").alias("__tokens"), F.bool_or(in_a).alias("__a"), F.bool_or(in_b).alias("__b"))
    cand = candidate_claims(sets, keys, least)
    cand = cand.join(sets.select(*keys, F.col("__sig").alias("sig_a"), F.col("__tokens").alias("tokens_a")), [*keys, "sig_a"])
    cand = cand.join(sets.select(*keys, F.col("__sig").alias("sig_b"), F.col("__tokens").alias("tokens_b")), [*keys, "sig_b"])
    near = cand.where(text.jaccard(F.col("tokens_a"), F.col("tokens_b")) >= least).select(*keys, "sig_a", "sig_b")
    # Two empty descriptions agree, but share no token to meet on.
    blank = sets.where((F.size("__tokens") == 0) & F.col("__a") & F.col("__b")).select(*keys, F.col("__sig").alias("sig_a"), F.col("__sig").alias("sig_b"))
    return near.unionByName(blank)


def contradictions(findings: DataFrame, keys=("case_id",)) -> DataFrame:
    """Per pool-A finding: how many pool-B findings contradict it, by the first rule that holds.

    1 opposite tiers on one call; 2 different techniques for one artifact and call; 3 one artifact described with
    little token overlap. Each count comes from group totals; only sufficiently similar description pairs, which
    rule 3 must exclude, are looked up, over distinct token sets.
    """
    rows = _signed(findings).withColumn("__tokens", F.array_sort(text.word_tokens(F.col("description"))))
    rows = rows.withColumn("__sig", F.md5(F.array_join("__tokens", " ")))
    # Texts are tokenised once; the totals below read this table from storage.
    rows = cut_lineage(rows.select(*keys, "finding_id", "pool_origin", "tool_call_id", "artifact_path", "__rank", "__tech", "__sig", "__tokens"))
    a_rows = rows.where("coalesce(pool_origin, 'A') = 'A'")
    a = a_rows.drop("__tokens")
    b = rows.where("coalesce(pool_origin, 'B') = 'B'")
    key = list(keys)
    call_key, path_key = [*key, "tool_call_id"], [*key, "artifact_path"]
    cited = F.coalesce("tool_call_id", F.lit("")) != ""
    placed = F.coalesce("artifact_path", F.lit("")) != ""
    ranks = (0, 1, 2)

    def total(side: DataFrame, cols, name: str) -> DataFrame:
        return side.groupBy(*cols).agg(F.count(F.lit(1)).alias(name))

    def by_rank(test: Column, letter: str) -> list:
        return [F.count_if(test & (F.col("__rank") == r)).alias(f"{letter}{r}") for r in ranks]

    def pick(test, letter: str) -> Column:
        return reduce(lambda x, y: x + y, [F.when(test(r), F.col(f"{letter}{r}")).otherwise(0) for r in ranks])

    opposite = lambda r: (F.abs(F.col("__rank") - r) == 2)
    near = lambda r: (F.abs(F.col("__rank") - r) < 2)
    named = F.col("__tech").isNotNull()
    here = [*call_key, "artifact_path"]
    b_cited = b.where(cited)
    # Pool-B totals per tier: on the call (c), on the call and artifact (n, and t with a technique), of one technique (s).
    a = a.join(b_cited.groupBy(*call_key).agg(*by_rank(F.lit(True), "c")), call_key, "left")
    # Two findings without an artifact are about one artifact, as two nulls compare equal in rule 2.
    a = null_safe_join(a, b_cited.groupBy(*here).agg(*by_rank(F.lit(True), "n"), *by_rank(named, "t")), here, "left")
    a = null_safe_join(a, b_cited.where(named).groupBy(*here, "__tech").agg(*by_rank(F.lit(True), "s")), [*here, "__tech"], "left")
    a = a.na.fill(0, [f"{x}{r}" for x in "cnts" for r in ranks])
    a = a.withColumns({
        "r1": F.when(cited, pick(opposite, "c")).otherwise(0),
        "r1_here": F.when(cited, pick(opposite, "n")).otherwise(0),
        "r2": F.when(cited & named, pick(near, "t") - pick(near, "s")).otherwise(0),
    })
    # Rule 3: everything else on the artifact, minus similar descriptions that rules 1 and 2 leave alone.
    a = a.join(total(b.where(placed), path_key, "b_here"), path_key, "left").na.fill(0, ["b_here"])
    alike = similar_claims(rows.where(placed), path_key, F.coalesce("pool_origin", F.lit("A")) == "A", F.coalesce("pool_origin", F.lit("B")) == "B")
    shape = [*path_key, "__sig", "tool_call_id", "__rank", "__tech"]
    a_shapes = total(a_rows.where(placed), shape, "__na").drop("__na").withColumnsRenamed({"__sig": "sig_a", "tool_call_id": "call_a", "__rank": "rank_a", "__tech": "tech_a"})
    b_shapes = total(b.where(placed), shape, "__nb").withColumnsRenamed({"__sig": "sig_b", "tool_call_id": "call_b", "__rank": "rank_b", "__tech": "tech_b"})
    both = alike.join(a_shapes, [*path_key, "sig_a"]).join(b_shapes, [*path_key, "sig_b"])
    one_call = F.coalesce((F.col("call_a") == F.col("call_b")) & (F.col("call_a") != ""), F.lit(False))
    ruled = one_call & ((F.abs(F.col("rank_a") - F.col("rank_b")) >= 2) | F.coalesce(F.col("tech_a") != F.col("tech_b"), F.lit(False)))
    calm = both.where(~ruled).groupBy(*path_key, "sig_a", "call_a", "rank_a", "tech_a").agg(F.sum("__nb").alias("calm"))
    same = (
        (F.col("x.sig_a") == F.col("y.__sig")) & F.col("x.call_a").eqNullSafe(F.col("y.tool_call_id"))
        & (F.col("x.rank_a") == F.col("y.__rank")) & F.col("x.tech_a").eqNullSafe(F.col("y.__tech"))
    )
    for k in path_key:
        same = same & (F.col("x." + k) == F.col("y." + k))
    out = a.alias("y").join(calm.alias("x"), same, "left").select("y.*", F.coalesce("x.calm", F.lit(0)).alias("calm"))
    r3 = F.when(placed, F.col("b_here") - F.col("r1_here") - F.col("r2") - F.col("calm")).otherwise(0)
    return out.select(*key, "finding_id", F.col("r1").cast("long").alias("opposite_tier"), F.col("r2").cast("long").alias("other_technique"), r3.cast("long").alias("low_overlap"))


def contradiction_partners(findings: DataFrame, chosen: DataFrame, keys=("case_id",)) -> DataFrame:
    """The contradicting pairs of a chosen set of pool-A findings, with the reason; for looking into single findings.

    Pairs meet on a call, or else on an artifact, in blocks, and are judged where they meet, so no text is moved per pair. Token sets
    are held against each other by their bits, and token by token only where the bits leave the overlap open. A pair of ids gives one
    row, by the last rule of them: only pairs of an id that several findings of a pool share are collected for that.
    """
    key = list(keys)
    ids = [*key, "finding_id"]
    words = [f"__w{i}" for i in range(text.BIT_WORDS)]
    # What few pairs look at is one column: a pair's other columns are read before it is judged.
    rest = F.struct("tool_call_id", "artifact_path", "__rank", "__tech", "__tokens").alias("__rest")
    cols = ["finding_id", "__call_hash", "__rest", "__size", "__spare", *words, "__several"]
    rows = _signed(findings)
    in_a, in_b = F.coalesce("pool_origin", F.lit("A")) == "A", F.coalesce("pool_origin", F.lit("B")) == "B"
    shared = cut_lineage(rows.groupBy(*ids).agg((F.count_if(in_a) > 1).alias("__a"), (F.count_if(in_b) > 1).alias("__b")).where("__a OR __b"))
    alone = shared.isEmpty()

    def side(of: DataFrame, letter: str) -> DataFrame:
        told = of.withColumn("__several", F.lit(False)) if alone else null_safe_join(of, shared.select(*ids, F.col(f"__{letter}").alias("__several")), ids, "left").na.fill(False, ["__several"])
        told = told.withColumn("__tokens", text.word_tokens(F.col("description"))).withColumns(dict(zip(words, text.token_bits(F.col("__tokens")), strict=True)))
        set_bits = reduce(lambda x, y: x + y, [F.bit_count(w) for w in words])
        told = told.withColumns({"__size": F.size("__tokens"), "__spare": F.coalesce(F.size("__tokens") - set_bits, F.lit(0)), "__call_hash": F.xxhash64("tool_call_id"), "__rest": rest})
        # Each finding is met on its call and on its artifact; texts are tokenised before.
        places = F.array(F.struct(F.lit(True).alias("call"), F.col("tool_call_id").alias("k")), F.struct(F.lit(False).alias("call"), F.col("artifact_path").alias("k")))
        placed = told.withColumn("__m", F.explode(places)).where("__m.k <> ''")
        return placed.select(*key, F.col("__m.call").alias("__call"), F.col("__m.k").alias("__k"), *[F.col(c).alias(f"{letter}_{c}") for c in cols])

    a = side(rows.where(in_a).join(chosen.select(*ids).distinct(), ids, "left_semi"), "a")
    b = side(rows.where(in_b), "b")
    a_of, b_of = F.col("a___rest"), F.col("b___rest")
    one_call = F.coalesce((a_of["tool_call_id"] == b_of["tool_call_id"]) & (a_of["tool_call_id"] != ""), F.lit(False))
    same_call = (F.col("a___call_hash") == F.col("b___call_hash")) & one_call
    same_path = F.coalesce(a_of["artifact_path"] == b_of["artifact_path"], F.lit(False))
    opposite = same_call & (F.abs(a_of["__rank"] - b_of["__rank"]) >= 2)
    other = same_call & a_of["artifact_path"].eqNullSafe(b_of["artifact_path"]) & (a_of["__tech"] != b_of["__tech"])
    bits = lambda letter: {"bits": [F.col(f"{letter}_{w}") for w in words], "size": F.col(f"{letter}___size"), "spare": F.col(f"{letter}___spare")}
    few = text.bits_below(bits("a"), bits("b"), DISAGREE_BELOW) | text.jaccard_below(a_of["__tokens"], b_of["__tokens"], DISAGREE_BELOW)
    low = same_path & (a_of["artifact_path"] != "") & few

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        # The overlap is judged by the filter only: what passes it by neither of the first rules passes it by the last.
        told = F.when(F.col("__call"), opposite | other | low).otherwise(~same_call & few)
        pairs = blocked_join(left, right, [*key, "__call", "__k"]).where(told)
        reason = F.when(opposite, "opposite_tier").when(other, "other_technique").otherwise("low_overlap")
        return pairs.select(*key, F.col("a_finding_id").alias("finding_id"), F.col("b_finding_id").alias("partner_id"), reason.alias("reason"))

    if alone:
        return met(a, b)
    lone_a = a.where("NOT a___several")
    several = met(a.where("a___several"), b).unionByName(met(lone_a, b.where("b___several")))
    order = F.array_position(F.array(F.lit("opposite_tier"), F.lit("other_technique"), F.lit("low_overlap")), F.col("reason"))
    return met(lone_a, b.where("NOT b___several")).unionByName(several.groupBy(*ids, "partner_id").agg(F.max_by("reason", order).alias("reason")))


def eligible(expected: DataFrame, run: DataFrame, keys=("case_id",)) -> DataFrame:
    """Expected × run pairs of a case with enough shared tokens, by an equality join on the token.

    Tokens of one finding leave one task, so the pair counts are combined before they shuffle: at most one row
    per finding and expected item, and an answer key has few items. A key index small enough is broadcast, so the
    exploded tokens of the findings are not shuffled at all.
    """
    key = list(keys)
    exp = expected.select(*key, "expected_id", text.tokens(F.col("description"), F.col("artifact_hint")).alias("__t")).where(F.size("__t") >= MATCH_MIN_SHARED)
    got = run.select(*key, "finding_id", text.tokens(F.col("description"), F.col("artifact_path")).alias("__t"))
    e_index = exp.select(*key, "expected_id", F.size("__t").alias("__n"), F.explode("__t").alias("t"))
    r_index = got.select(*key, "finding_id", F.explode("__t").alias("t"))
    counted = r_index.join(broadcast_if_small(e_index), [*key, "t"]).groupBy(*key, "expected_id", "finding_id", "__n").agg(F.count(F.lit(1)).alias("shared"))
    out = counted.withColumn("coverage", F.col("shared") / F.col("__n")).drop("__n")
    return out.where((F.col("shared") >= MATCH_MIN_SHARED) & (F.col("coverage") >= MATCH_COVERAGE))


def merge_timeline(provisional: DataFrame, authoritative: DataFrame, keys=("case_id", "tool_call_id")) -> DataFrame:
    """Authoritative rows, plus provisional rows whose call has none."""
    kept = provisional.join(authoritative.select(*keys).distinct(), list(keys), "left_anti")
    return authoritative.unionByName(kept, allowMissingColumns=True)


def enrich(iocs: DataFrame, feeds: DataFrame, keys=("kind", "value")) -> DataFrame:
    """Observables with their reputation: found anywhere, sources calling it malicious, providers that know it."""
    per = feeds.groupBy(*keys).agg(
        F.bool_or("found").alias("found"),
        F.count_if("malicious").alias("malicious_sources"),
        F.count_distinct(F.when(F.col("found"), F.col("provider"))).alias("providers"),
    )
    out = iocs.join(per, list(keys), "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return out.na.fill(0, ["malicious_sources", "providers"])


def ground_techniques(techniques: DataFrame, kb: DataFrame) -> DataFrame:
    """Techniques with their knowledge-base entry, matched without regard to case."""
    known = broadcast_if_small(kb).select(F.upper("technique_id").alias("technique_id"), F.lit(True).alias("found"), "current_id", "name")
    out = techniques.withColumn("technique_id", F.upper("technique_id")).join(known, "technique_id", "left")
    return out.withColumn("found", F.coalesce("found", F.lit(False))).withColumn("id_match", F.coalesce(F.col("current_id") == F.col("technique_id"), F.lit(False)))


def ground_cves(findings: DataFrame, nvd: DataFrame, keys=("case_id",)) -> DataFrame:
    """Vulnerability ids mentioned in findings, with severity when the table knows them."""
    named = findings.select(*keys, "finding_id", F.explode(extract_cves(F.col("description"))).alias("cve_id"))
    per = named.groupBy(*keys, "cve_id").agg(F.count_distinct("finding_id").alias("findings"))
    out = per.join(broadcast_if_small(nvd).select("cve_id", "severity", F.lit(True).alias("found")), "cve_id", "left")
    return out.withColumn("status", F.when(F.col("found"), "supported").otherwise("unsupported")).drop("found")


def leaf_diff(declared: DataFrame, derived: DataFrame, keys=("case_id",)) -> DataFrame:
    """Leaves that differ between two lists, position by position."""
    fields = ("seq", "kind", "digest_hex", "record_id")
    a = declared.select(*keys, "leaf_idx", F.struct(*fields).alias("declared"))
    b = derived.select(*keys, "leaf_idx", F.struct(*fields).alias("derived"))
    out = a.join(b, [*keys, "leaf_idx"], "full_outer")
    return out.where(~F.col("declared").eqNullSafe(F.col("derived")))


def replay_agreement(recomputed: DataFrame, recorded: DataFrame, keys=("case_id",)) -> DataFrame:
    """Share of recorded decisions that a recomputation reproduces."""
    both = recomputed.select(*keys, "finding_id", F.col("action").alias("now")).join(recorded.select(*keys, "finding_id", "action"), [*keys, "finding_id"])
    same = F.when(F.col("now") == F.col("action"), 1.0).otherwise(0.0)
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("compared"), F.sum(same).cast("long").alias("matches"), F.bround(F.avg(same), 4).alias("agreement"))


def attach_prior(findings: DataFrame, hits: DataFrame, keys=("case_id", "finding_id")) -> DataFrame:
    """Hits from earlier cases as context on a finding; recall already bounds the hits of one finding."""
    per = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("prior_case_id").alias("case_id"), "ts", "confidence"))).alias("prior_observations"))
    out = findings.join(per, list(keys), "left")
    empty = F.array().cast("array<struct<case_id:string,ts:bigint,confidence:double>>")
    return out.withColumn("prior_observations", F.coalesce("prior_observations", empty))


# Artifact class pairs that carry a claim.
CLASS_PAIRS = (
    ("execution", "prefetch", "evtx"),
    ("execution", "prefetch", "amcache"),
    ("execution", "edr", "memory"),
    ("service_persistence", "registry", "evtx"),
    ("task_persistence", "registry", "evtx"),
    ("injection", "memory", "yara"),
    ("deletion", "usnjrnl", "mft"),
)


def corroborated(claims: DataFrame, claim: str = "claim", classes: str = "classes") -> DataFrame:
    """Claims with the two artifact classes their kind requires; the rule list is fixed, so it is an expression."""
    tests = [(F.col(claim) == c) & F.array_contains(classes, x) & F.array_contains(classes, y) for c, x, y in CLASS_PAIRS]
    return claims.withColumn("corroborated", F.coalesce(reduce(lambda p, q: p | q, tests), F.lit(False)))


def regions_with_matches(regions: DataFrame, matches: DataFrame, keys=("host", "pid"), block: int = 1 << 28) -> DataFrame:
    """Pattern matches inside memory regions of the same process: one row per region with start <= offset < end.

    A region is entered in every block of addresses that it touches, so a match meets only the regions of its block.
    """
    last = F.floor((F.col("vad_end") - 1) / F.lit(block))
    entered = regions.where("vad_start < vad_end").select(*keys, "vad_start", "vad_end", F.explode(F.sequence(F.floor(F.col("vad_start") / F.lit(block)), last)).alias("__b"))
    met = matches.select(*keys, "offset", "rule_name").withColumn("__b", F.floor(F.col("offset") / F.lit(block)))
    hit = met.join(entered, [*keys, "__b"]).where("vad_start <= offset AND offset < vad_end")
    return hit.select(*keys, "offset", "rule_name", "vad_start", "vad_end")



def revisions(before: DataFrame, after: DataFrame, keys=("case_id", "finding_id")) -> DataFrame:
    """Findings whose tier changed and that name the call which changed it."""
    new = after.where("coalesce(tool_call_id, '') <> ''").select(*keys, F.col("confidence").alias("to_tier"), F.col("tool_call_id").alias("trigger_tool_call_id"))
    both = before.select(*keys, F.col("confidence").alias("from_tier")).join(new, list(keys))
    return both.where("from_tier <> to_tier")


# Our choice of signature profiles: pattern, label, technique, vulnerability, note.
SIGNATURES = (
    (r"(?i)spoolfool|print spooler", "print spooler abuse", "T1068", "CVE-2022-21999", "check spool directories"),
    (r"(?i)eternalblue|ms17-010", "SMB remote code execution", "T1210", "CVE-2017-0144", "check patch level"),
    (r"(?i)log4shell|jndi:", "logging library lookup", "T1190", "CVE-2021-44228", "check outbound lookups"),
    (r"(?i)mimikatz|sekurlsa", "credential dumping tool", "T1003.001", None, "reset credentials"),
    (r"(?i)encodedcommand", "encoded script", "T1059.001", None, "decode and review"),
    (r"(?i)amcache", "program catalogue entry", "T1204", None, "not proof of a run"),
)


def apply_signatures(findings: DataFrame, column: str = "description", signatures=SIGNATURES) -> DataFrame:
    """First profile whose pattern is in the text; none leaves nulls."""
    hit = F.coalesce(*[
        F.when(F.col(column).rlike(p), F.struct(F.lit(l).alias("signature"), F.lit(t).cast("string").alias("signature_technique"), F.lit(c).cast("string").alias("cve_id"), F.lit(n).cast("string").alias("analyst_note")))
        for p, l, t, c, n in signatures
    ])
    return findings.withColumn("__s", hit).select(*findings.columns, *[F.col("__s")[f].alias(f) for f in ("signature", "signature_technique", "cve_id", "analyst_note")])


DEFAULT_ACTION = "Look at the finding with a second analyst"


def derive_actions(grounded: DataFrame, actions: DataFrame, default: str = DEFAULT_ACTION) -> DataFrame:
    """Recommended step per judged technique; 'act' only for supported claims on a SUSPICIOUS case.

    `actions` (technique_id, action) is the caller's own table. An entry of the technique itself comes before one of its
    parent technique; with neither the default holds. Of several entries for one technique the first by text is taken.
    """
    tid = F.upper("technique_id")
    steps = actions.where("technique_id IS NOT NULL").groupBy(F.upper("technique_id").alias("__t")).agg(F.min("action").alias("__step"))
    own = steps.select(F.col("__t").alias("__own_id"), F.col("__step").alias("__own"))
    parent = steps.select(F.col("__t").alias("__parent_id"), F.col("__step").alias("__parent"))
    known = grounded.join(own, tid == F.col("__own_id"), "left").join(parent, F.substring_index(tid, ".", 1) == F.col("__parent_id"), "left")
    step = F.coalesce("__own", "__parent", F.lit(default))
    act = (F.col("status") == "supported") & (F.upper("outcome") == "SUSPICIOUS") & ~F.col("possible_hallucination")
    action = (
        F.when(F.col("possible_hallucination"), F.concat(F.lit("Re-check finding for "), tid))
        .when(act, step)
        .when(F.col("status") == "supported", F.concat(F.lit("Corroborate the lead for "), tid))
        .otherwise(F.concat(F.lit("Review the unsupported claim for "), tid))
    )
    return known.select("case_id", tid.alias("technique_id"), action.alias("action"), F.when(act, "act").otherwise("review").alias("route"))


def reply_to_spoof(mail: DataFrame, keys=("case_id",)) -> DataFrame:
    """Spreadsheets sent to an address that an earlier message of the same subject displayed but did not come from."""
    subject = F.lower(F.trim(F.regexp_replace("subject", r"(?i)^\s*((re|fwd?):\s*)+", "")))
    shown = F.lower(F.trim("from_display"))
    spoof = mail.where(shown.contains("@") & (shown != F.lower(F.trim("from_address"))))
    lures = spoof.groupBy(*keys, shown.alias("address"), subject.alias("topic")).agg(F.min("us").alias("lure_us"), F.count_distinct("from_address").alias("actual_senders"), F.min("from_address").alias("first_sender"))
    sheet = F.lower("attachment").rlike(r"\.(xlsx?|xlsm|csv|ods)$")
    sent = mail.where(sheet).withColumn("address", F.lower(F.trim("to_address"))).withColumn("topic", subject)
    return sent.join(lures, [*keys, "address", "topic"]).where("us > lure_us").select(*keys, "msg_id", "attachment", F.col("address").alias("displayed"), "actual_senders", "first_sender")
