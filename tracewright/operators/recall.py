"""Case memory: remembering confirmed findings, recalling them by phrase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.stems import stemmed
from tracewright.session import cut_lineage

# Ranking constants and decay span in days.
K1 = 1.2
B = 0.75
DECAY_DAYS = 90.0


def remember(findings: DataFrame, now_us: Column) -> DataFrame:
    """Memory rows of confirmed findings, with a digest of the text."""
    return findings.where("confidence = 'CONFIRMED'").select(
        "case_id",
        F.lit("finding_summary").alias("kind"),
        F.coalesce(F.nullif("mitre_technique", F.lit("")), F.col("finding_id")).alias("key"),
        F.col("description").alias("value"),
        F.concat(F.lit("sha256:"), F.sha2("description", 256)).alias("sha256"),
        now_us.alias("us"),
    )


def memory_meta(memory: DataFrame) -> DataFrame:
    """First and last time each case was remembered."""
    return memory.groupBy("case_id").agg(F.min("us").alias("first_seen_us"), F.max("us").alias("last_updated_us"), F.count(F.lit(1)).alias("memories"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _pairs(words: Column) -> Column:
    """Each word with the one after it; null at the last word, so places stay those of the words."""
    return F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda w, after: F.concat(w, F.lit(" "), after))


def _phrase_starts(doc: DataFrame, ask: DataFrame) -> DataFrame:
    """(query_id, memory_id, f): how often each phrase occurs, from an index of the places of neighbouring words.

    A phrase of several words is its pairs of neighbours, one of a single word that word. Only places of pairs and words that some phrase
    has are kept, written once. A phrase starts its search from its pair with the fewest places, counted over all memories; each
    other pair has to lie at its own distance from there. No text is moved, and places are met at (memory, place), never as one group.
    """
    alone = F.size("__q") == 1
    terms = F.when(alone, F.col("__q")).otherwise(F.filter(_pairs(F.col("__q")), lambda t: t.isNotNull()))
    asked = ask.select("query_id", F.size(terms).alias("__n"), F.posexplode(terms).alias("off", "t"))
    vocabulary = asked.select("t").distinct()
    at = lambda terms: F.transform(terms, lambda t, i: F.struct(i.alias("pos"), t.alias("t")))
    spread_out = doc.select("memory_id", F.explode(F.concat(at(F.col("__w")), at(_pairs(F.col("__w"))))).alias("x")).select("memory_id", "x.pos", "x.t")
    places = cut_lineage(spread_out.join(vocabulary, "t", "left_semi"))
    counted = asked.join(places.groupBy("t").agg(F.count(F.lit(1)).alias("places")), "t")
    rarest = counted.groupBy("query_id", "__n").agg(F.min(F.struct("places", "off", "t")).alias("a"), F.count(F.lit(1)).alias("known")).where("known = __n")
    starts = rarest.select("query_id", "__n", F.col("a.t").alias("t"), F.col("a.off").alias("__off")).join(places, "t")
    starts = starts.select("query_id", "memory_id", "__n", "__off", (F.col("pos") - F.col("__off")).alias("start")).where("start >= 0")
    others = starts.join(asked.select("query_id", "off", "t"), "query_id").where("off <> __off").select("query_id", "memory_id", "__n", "start", "t", (F.col("start") + F.col("off")).alias("pos"))
    whole = others.join(places, ["memory_id", "pos", "t"]).groupBy("query_id", "memory_id", "__n", "start").agg(F.count(F.lit(1)).alias("met")).where("met = __n - 1")
    found = whole.select("query_id", "memory_id", "start").union(starts.where("__n = 1").select("query_id", "memory_id", "start"))
    return found.groupBy("query_id", "memory_id").agg(F.count(F.lit(1)).cast("double").alias("f"))


def recall(memory: DataFrame, queries: DataFrame, now_us: Column, k: int = 10, stems: bool = False) -> DataFrame:
    """The k best memories per query phrase, by BM25 of the phrase, then re-ranked with recency decay.

    With `stems`, words are met by their stem. If the queries have a column `kind`, a query with a kind is answered from memories of that kind;
    how rare its phrase is, is still counted over all. Overlapping occurrences of a phrase count each. Phrases without a word find nothing.
    Relevance is 1 / (1 + score), which falls as the score rises; kept as the rule this reproduces has it.
    """
    words = lambda text: stemmed(_words(text)) if stems else _words(text)
    doc = memory.select("memory_id", "kind", "us", words(F.concat_ws(" ", "kind", "key", "value")).alias("__w"))
    ask = queries.withColumn("__q", words(F.col("phrase"))).where(F.size("__q") > 0)
    doc = doc.withColumn("__len", F.size("__w"))
    slim = _phrase_starts(doc, ask).join(doc.select("memory_id", "kind", "us", "__len"), "memory_id")
    # Few rows, read twice below: once to count the hits of a phrase, once to score them.
    hits = cut_lineage(slim)
    found = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("nq"))
    stats = doc.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("__len").alias("avg")).alias("s")).scalar()
    rows = hits.join(found, "query_id").withColumn("stats", stats).withColumn("n", F.col("stats.n")).withColumn("avg", F.col("stats.avg"))
    idf = F.greatest(F.log((F.col("n") - F.col("nq") + 0.5) / (F.col("nq") + 0.5)), F.lit(1e-6))
    score = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("__len") / F.col("avg")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id")
    if "kind" in queries.columns:
        rows = rows.join(ask.select("query_id", F.col("kind").alias("__kind")), "query_id").where("__kind IS NULL OR kind = __kind")
    top = rows.withColumn("score", score).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    days = F.greatest(F.lit(0.0), (now_us - F.col("us")) / F.lit(86_400_000_000.0))
    confidence = F.exp(-days / DECAY_DAYS) / (1 + F.col("score"))
    best_rows = top.select("query_id", "memory_id", "score", confidence.alias("confidence"))
    return best_rows.join(memory.select("memory_id", "case_id", "kind", "key", "value", "us"), "memory_id")
