"""Document fingerprints: a Merkle tree over paragraphs and sections, built with column functions only.

A paragraph is a line and a leaf of the tree. A section is a run of paragraphs that ends after one whose hash ends in
one of the digits `BORDERS` (so an edit moves no later border); its hash covers theirs, and the root covers the sections.
Equal roots mean equal texts; where roots differ, the hashes that two trees do not share locate the edit. How alike two
trees are is told from the paragraphs' clauses, as many texts have one paragraph only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import ordered_parts

BORDERS = ("0", "4", "8", "c")
CLAUSE = "(?:[^ .!?,;:|\n]* ){0,7}[^ .!?,;:|\n]*(?:[ .!?,;:|\n]|$)"


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def clauses(text: Column) -> Column:
    """32-bit hashes of the clauses, in order: up to eight words that end at a punctuation sign or a line end."""
    return F.transform(F.filter(F.regexp_extract_all(text, F.lit(CLAUSE), F.lit(0)), lambda c: c != ""), lambda c: F.hash(c))


def paragraphs(text: Column) -> Column:
    return F.transform(lines(text), lambda p: F.sha2(F.encode(p, "UTF-8"), 256))


def sections(hashes: Column) -> Column:
    """Hashes of the sections: the paragraphs' hashes joined, cut behind each that ends a section."""
    ends = F.concat_ws("", F.transform(hashes, lambda h: F.concat(h, F.when(F.right(h, F.lit(1)).isin(*BORDERS), F.lit("|")).otherwise(F.lit("")))))
    return F.transform(F.filter(F.split(ends, r"\|"), lambda s: s != ""), lambda s: F.sha2(s, 256))


def root(section_hashes: Column) -> Column:
    return F.sha2(F.concat_ws("", section_hashes), 256)


def likeness(a: Column, b: Column) -> Column:
    """Shared distinct clauses over all distinct clauses of two texts; 1 for equal texts."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / every)


def trees(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds clause, paragraph and section hashes and the root `fingerprint` to every row; a null text is empty."""
    out = docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumns({"clauses": clauses(F.col("_t")), "paragraph_hashes": paragraphs(F.col("_t"))})
    out = out.withColumn("section_hashes", sections(F.col("paragraph_hashes")))
    return out.withColumn("fingerprint", root(F.col("section_hashes"))).drop("_t")


def differing(a: DataFrame, b: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, equal, sections and paragraphs of each side that the other lacks) of two versions' `trees`."""
    cols = ["fingerprint", "section_hashes", "paragraph_hashes"]
    both = a.select(id_col, *[F.col(c).alias(f"a_{c}") for c in cols]).join(b.select(id_col, *[F.col(c).alias(f"b_{c}") for c in cols]), id_col)
    lacking = lambda x, y: F.filter(F.transform(F.col(x), lambda h, i: F.when(~F.array_contains(F.col(y), h), i)), lambda i: i.isNotNull())
    return both.select(
        id_col, (F.col("a_fingerprint") == F.col("b_fingerprint")).alias("equal"),
        *[lacking(f"{x}_{c}_hashes", f"{y}_{c}_hashes").alias(f"{x}_{c}s") for c in ("section", "paragraph") for x, y in (("a", "b"), ("b", "a"))],
    )


KEY = ["none", "key", "th"]


def followers(docs: DataFrame) -> DataFrame:
    """Per distinct (none, key, th): its length, the next one in descending order (after the last: the first), and the one before."""
    order = [F.col("none"), F.col("key").desc(), F.col("th")]
    parts = ordered_parts(docs.select(*KEY, "n").distinct(), *order)
    inside = Window.partitionBy("_part").orderBy(*order)
    me = F.struct(*KEY, "n")
    near = parts.withColumns({"_before": F.lag(me).over(inside), "_after": F.lead(me).over(inside)})
    # Part borders: the first and last row of each part, one row per part.
    ranked = F.struct("none", (-F.col("key")).alias("rank"), "th", "n", "key")
    edge = parts.groupBy("_part").agg(F.min(ranked).alias("a"), F.max(ranked).alias("b"))
    flat = lambda c: F.struct(*[F.col(f"{c}.{k}") for k in (*KEY, "n")])
    line = Window.orderBy("_part")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = edge.select("_part", F.coalesce(F.lag(flat("b")).over(line), F.last(flat("b")).over(whole)).alias("_in"), F.coalesce(F.lead(flat("a")).over(line), F.first(flat("a")).over(whole)).alias("_out"))
    return near.join(F.broadcast(edge), "_part").select(*KEY, F.coalesce("_before", "_in").alias("before"), F.coalesce("_after", "_out").alias("after"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edit: the last third of its code points replaced by the next document's first ones.

    Next is the one with the next smaller id (ids are numbers); after the last comes the first. Equal rows count as one
    document in that order and share their result; other rows of one id follow in the order of a text hash. Rows without
    id come last. A null text is empty. A lone document is its own next. An empty table gives no rows. The texts are
    moved once, by id (both sides of the second join read that one exchange, as they use the same columns); of the next
    document only the part that the edit takes in, and its clause hashes, are moved again.
    """
    base = docs.select(F.col(id_col).isNull().alias("none"), F.coalesce(F.col(id_col), F.lit(0)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumns({"th": F.xxhash64("text"), "n": F.char_length("text").cast("long")})
    own = trees(base.join(followers(base).select(*KEY, "before"), KEY))
    given = own.select(
        *[F.col(f"before.{k}").alias(k) for k in KEY], F.col("fingerprint").alias("next_fingerprint"), F.col("clauses").alias("next_clauses"), F.col("n").alias("next_n_chars"),
        F.substring("text", F.lit(1), F.floor(F.col("before.n") / 3).cast("int")).alias("taken"),
    ).dropDuplicates(KEY)
    both = own.join(given, KEY)
    kept = (F.col("n") - F.floor(F.col("n") / 3)).cast("int")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), kept), "taken"))
    out = both.withColumns({
        "edited_sha256": F.sha2(F.encode("edited", "UTF-8"), 256),
        "edited_fingerprint": root(sections(paragraphs(F.col("edited")))),
        "near_edited": likeness(F.col("clauses"), clauses(F.col("edited"))),
        "near_next": likeness(F.col("clauses"), F.col("next_clauses")),
    })
    return out.select(F.when(~F.col("none"), F.col("key")).alias(id_col), F.col("n").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_n_chars")
