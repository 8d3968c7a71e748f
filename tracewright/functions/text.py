"""Text columns: tokens, overlap measures, decoding, neutralising."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without discriminating power in finding texts.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "into",
    "is", "it", "its", "of", "on", "or", "that", "the", "to", "via", "with", "within", "shows",
    "show", "indicates", "indicating", "evidence", "artifact", "artifacts", "file", "files",
    "entry", "entries", "consistent", "suspicious", "recent", "recently",
)

# Longs that a token set's bits fill.
BIT_WORDS = 8

# Chat control tokens and the marker id each one gets.
CONTROL_TOKENS = (
    ("im_start", "<|im_start|>"),
    ("im_end", "<|im_end|>"),
    ("im_sep", "<|im_sep|>"),
    ("eot_id", "<|eot_id|>"),
    ("start_header_id", "<|start_header_id|>"),
    ("end_header_id", "<|end_header_id|>"),
    ("endoftext", "<|endoftext|>"),
    ("inst_open", "[inst]"),
    ("inst_close", "[/inst]"),
    ("sys_open", "<<sys>>"),
    ("sys_close", "<</sys>>"),
)

# Code points dropped before token replacement.
INVISIBLE_CLASS = r"[\u202A-\u202E\u2066-\u2069\u200B-\u200F\u2060\uFEFF]"


def _quoted(token: str) -> str:
    return "(?i)\\Q" + token + "\\E"


def tokens(*parts: Column) -> Column:
    """Distinct lower-case alphanumeric tokens, stop words and short ones removed."""
    # A run of three or more characters is a whole token longer than two; array_except also removes repeats.
    found = F.regexp_extract_all(F.lower(F.concat_ws(" ", *parts)), F.lit("([a-z0-9]{3,})"), F.lit(1))
    return F.array_except(found, F.array(*[F.lit(w) for w in STOP_WORDS]))


def word_tokens(text: Column) -> Column:
    """Distinct lower-case tokens of letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token arrays; two empty arrays agree fully."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_bits(tokens: Column, words: int = BIT_WORDS) -> list[Column]:
    """A token array as `words` longs in which each token sets the bit of its hash."""
    at = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(64 * words)))
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def word(i: int) -> Column:
        own = F.transform(F.filter(at, lambda h: F.shiftright(h, 6) == i), lambda h: F.call_function("shiftleft", one, (h % 64).cast("int")))
        return F.coalesce(F.aggregate(own, none, lambda x, y: x.bitwiseOR(y)), none)

    return [word(i) for i in range(words)]


def jaccard_below(a: Column, b: Column, limit: float) -> Column:
    """jaccard(a, b) < limit for arrays of distinct tokens; both sizes are compared as whole numbers, so the overlap is made once."""
    return _few_shared(F.size(F.array_intersect(a, b)), F.size(a), F.size(b), limit)


def bits_below(a: dict, b: dict, limit: float) -> Column:
    """True only if jaccard(a, b) < limit, told from {'bits': token_bits, 'size': tokens, 'spare': tokens less bits set} of both.

    Common tokens set common bits, and a token beyond those is one of the spare ones of its side: a bound that is never too low.
    """
    common = reduce(lambda x, y: x + y, [F.bit_count(x.bitwiseAND(y)).cast("double") for x, y in zip(a["bits"], b["bits"], strict=True)])
    return _few_shared(common + F.least(a["spare"], b["spare"]), a["size"], b["size"], limit)


def _few_shared(shared: Column, size_a: Column, size_b: Column, limit: float) -> Column:
    # shared / (size_a + size_b - shared) < p / q without a division; two empty arrays agree fully. Doubles hold these numbers whole.
    p, q = Fraction(str(limit)).as_integer_ratio()
    sizes = size_a.cast("double") + size_b.cast("double")
    return F.when(sizes == 0, F.lit(1.0 < limit)).otherwise(shared * F.lit(float(p + q)) < sizes * F.lit(float(p)))


def coverage(expected: Column, candidate: Column) -> Column:
    """Share of the expected tokens present in the candidate; 0 when either is empty."""
    shared = F.size(F.array_intersect(expected, candidate))
    empty = (F.size(expected) == 0) | (F.size(candidate) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(shared / F.size(expected))


def _unescape(text: Column) -> Column:
    # A percent sign without two hex digits stays literal.
    repaired = F.regexp_replace(text, "%(?![0-9a-fA-F]{2})", "%25")
    return F.url_decode(repaired)


def percent_decode2(text: Column) -> Column:
    """Plus to space, two rounds of lenient percent decoding, lower case; stays in the JVM."""
    once = F.lower(_unescape(text))
    return F.lower(_unescape(F.replace(once, F.lit("+"), F.lit("%2B"))))


def clip_bytes(text: Column, limit: int, suffix: str = "") -> Column:
    """First characters whose UTF-8 form fits in `limit` bytes, plus `suffix` when something was cut."""
    data = F.encode(text, "UTF-8")

    def inner(position: int) -> Column:
        # Bytes 80 to BF continue a character.
        return F.hex(F.substring(data, position, 1)).between("80", "BF")

    size = (
        F.when(~inner(limit + 1), limit)
        .when(~inner(limit), limit - 1)
        .when(~inner(limit - 1), limit - 2)
        .otherwise(limit - 3)
    )
    head = F.decode(F.substr(data, F.lit(1), size), "UTF-8")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(head, F.lit(suffix)))


def cookie_pairs(header: Column, max_name: int | None = 64, max_value: int | None = 256) -> Column:
    """Cookie header to an array of (name, value, truncated); without limits whole, as comparing and ranking need them."""

    def one(pair: Column) -> Column:
        pair = F.trim(pair)
        at = F.instr(pair, "=")
        name = F.when(at > 0, F.trim(F.substr(pair, F.lit(1), at - 1))).otherwise(pair)
        value = F.when(at > 0, F.trim(F.substr(pair, at + 1, F.length(pair)))).otherwise(F.lit(""))
        return F.struct(
            (name if max_name is None else clip_bytes(name, max_name)).alias("name"),
            (value if max_value is None else clip_bytes(value, max_value)).alias("value"),
            (F.lit(False) if max_value is None else F.octet_length(value) > max_value).alias("truncated"),
        )

    return F.filter(F.transform(F.split(header, ";"), one), lambda c: c["name"] != "")


def neutralize(text: Column) -> Column:
    """Drop invisible code points, then replace chat control tokens with inert markers."""
    out = F.regexp_replace(text, INVISIBLE_CLASS, "")
    for name, token in CONTROL_TOKENS:
        out = F.regexp_replace(out, _quoted(token), f"[neutralized:{name}]")
    return out


def neutralize_counts(text: Column) -> Column:
    """Map of pattern id to hits; ids without hits are left out."""
    clean = F.regexp_replace(text, INVISIBLE_CLASS, "")
    pairs = [F.struct(F.lit("invisible_unicode").alias("k"), F.regexp_count(text, F.lit(INVISIBLE_CLASS)).alias("n"))]
    for name, token in CONTROL_TOKENS:
        pairs.append(F.struct(F.lit(name).alias("k"), F.regexp_count(clean, F.lit(_quoted(token))).alias("n")))
    hit = F.filter(F.array(*pairs), lambda p: p["n"] > 0)
    return F.map_from_entries(F.transform(hit, lambda p: F.struct(p["k"], p["n"])))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def contains_any(text: Column, needles) -> Column:
    """True where any literal needle occurs in the text."""
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(text, F.lit(needle))
    return hit


def enforce_prefix(text: Column, confidence: Column) -> Column:
    """HYPOTHESIS texts start with 'hypothesis: '; others stay as they are."""
    body = F.regexp_replace(text, r"^\s+", "")
    bare = (confidence == "HYPOTHESIS") & ~F.lower(body).startswith("hypothesis:")
    return F.when(bare, F.concat(F.lit("hypothesis: "), body)).otherwise(text)
