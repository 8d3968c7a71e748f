"""Asserted values: reading leaves out of JSON output and matching them."""

from __future__ import annotations

from functools import lru_cache, reduce

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.text import let

# Shapes of high-specificity tokens.
HASH_SHAPE = r"^[0-9a-fA-F]{32}$|^[0-9a-fA-F]{40}$|^[0-9a-fA-F]{64}$"
IPV4_SHAPE = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"
FILE_NAME_SHAPE = r"^[^\\/]+\.[A-Za-z0-9][A-Za-z0-9_-]{0,7}$"

LEAF = T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])


def is_ipv6(token: Column) -> Column:
    """IPv6 address text: eight groups, one '::' for the missing ones, a zone suffix or an embedded IPv4 tail."""
    bare = F.lower(F.substring_index(token, "%", 1))
    tail = r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"
    plain = F.regexp_replace(bare, "(?<=:)" + tail, "0:0")
    sides = F.split(plain, "::")
    groups = F.aggregate(sides, F.lit(0), lambda n, side: n + F.when(side == "", 0).otherwise(F.size(F.split(side, ":"))))
    shaped = F.forall(sides, lambda side: (side == "") | side.rlike("^[0-9a-f]{1,4}(:[0-9a-f]{1,4})*$"))
    counted = F.when(F.size(sides) == 1, groups == 8).when(F.size(sides) == 2, groups <= 7).otherwise(False)
    return F.coalesce(F.contains(token, F.lit(":")) & shaped & counted, F.lit(False))


def is_identity(expected: Column, mode: Column) -> Column:
    """Hash or IP address: a wrong value has no near-miss reading."""
    token = F.trim(expected)
    shaped = token.rlike(HASH_SHAPE) | token.rlike(IPV4_SHAPE) | is_ipv6(token)
    return ~mode.isin("iso_ts", "record", "int") & shaped


def anchor_class(expected: Column, mode: Column) -> Column:
    """'hard' for hashes, addresses, bare file names and integers; else 'corroborating'."""
    token = F.trim(expected)
    return (
        F.when(mode.isin("iso_ts", "record"), "corroborating")
        .when(mode == "int", "hard")
        .when(is_identity(expected, mode) | token.rlike(FILE_NAME_SHAPE), "hard")
        .otherwise("corroborating")
    )


def ioc_kind(token: Column) -> Column:
    bare = F.trim(token)
    return (
        F.when(bare.rlike("^https?://"), "urls")
        .when(bare.rlike(HASH_SHAPE), "hashes")
        .when(bare.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ips")
        .otherwise("domains")
    )


def _leaf(value) -> dict:
    if isinstance(value, dict):
        return {"kind": "object", "text": json.dumps(value)}
    kind = {bool: "bool", int: "int", float: "float", str: "str", list: "list"}.get(type(value), "null")
    return {"kind": kind, "text": "" if value is None else str(value)}


def path_steps(path: str) -> tuple | None:
    """Steps of a dotted path: names, list places and None for every item; null for a malformed path."""
    steps: list = []
    for part in path.split("."):
        if not re.fullmatch(r"[^\[\].]+(?:\[(?:\*|\d+)\])*", part):
            return None
        name, *places = re.findall(r"[^\[\]]+", part)
        steps += [name, *(None if p == "*" else int(p) for p in places)]
    return tuple(steps)


END = ()


@lru_cache(maxsize=256)
def path_trie(paths: tuple) -> dict:
    """Paths by their steps, built once for documents that are asked for the same: a node maps a step to a node, END to the places of the paths that end there."""
    trie: dict = {}
    for i, path in enumerate(paths):
        steps, node = path_steps(path), trie
        if steps is not None:
            for step in steps:
                node = node.setdefault(step, {})
            node.setdefault(END, []).append(i)
    return trie


def trie_leaves(parsed, paths: list[str]) -> list[list[dict]]:
    """Leaves of every path, from one walk over the document: paths with one beginning go down it together."""
    out: list[list[dict]] = [[] for _ in paths]
    stack = [(path_trie(tuple(paths)), [parsed])]
    while stack:
        node, level = stack.pop()
        for step, below in node.items():
            if step == END:
                found = [_leaf(v) for v in level]
                for i in below:
                    out[i] = found
            elif isinstance(step, str):
                stack.append((below, [x[step] for x in level if isinstance(x, dict) and step in x]))
            elif step is None:
                stack.append((below, [item for x in level if isinstance(x, list) for item in x]))
            else:
                stack.append((below, [x[step] for x in level if isinstance(x, list) and step < len(x)]))
    return out


@F.arrow_udf(T.ArrayType(T.ArrayType(LEAF)))
def json_leaves(docs: pa.Array, paths: pa.Array) -> pa.Array:
    """One leaf array per path; the document is parsed and walked once for all of its paths."""
    kinds, texts, path_ends, doc_ends = [], [], [0], [0]
    for doc, wanted in zip(docs.to_pylist(), paths.to_pylist()):
        try:
            parsed = json.loads(doc) if doc else {}
        except ValueError:
            parsed = {}
        for found in trie_leaves(parsed, wanted or []):
            kinds.extend(leaf["kind"] for leaf in found)
            texts.extend(leaf["text"] for leaf in found)
            path_ends.append(len(kinds))
        doc_ends.append(len(path_ends) - 1)
    leaves = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(texts, pa.string())], ["kind", "text"])
    return pa.ListArray.from_arrays(pa.array(doc_ends, pa.int32()), pa.ListArray.from_arrays(pa.array(path_ends, pa.int32()), leaves))


def to_int(text: Column) -> Column:
    """Text as a whole number: decimal, or 0x, 0o and 0b digits, signed, single underscores between digits; else null.

    Decimal numbers have no leading zeros. Beyond 38 decimal or 64 binary digits' worth the result is null.
    """
    shape = r"^[+-]?(0x(_?[0-9a-f])+|0o(_?[0-7])+|0b(_?[01])+|0(_?0)*|[1-9](_?[0-9])*)$"

    def based(bare: Column) -> Column:
        def cut(digits: Column) -> Column:
            return reduce(
                lambda out, b: F.when(bare.startswith(b[0]) & (F.length(digits) <= b[2]), F.conv(digits, b[1], 10).try_cast("decimal(20,0)")).otherwise(out),
                [("0x", 16, 16), ("0o", 8, 21), ("0b", 2, 64)],
                F.lit(None).cast("decimal(20,0)"),
            )

        marked = let(F.regexp_replace(F.substr(bare, F.lit(3)), "^0+(?=.)", ""), cut)
        return F.when(bare.rlike("^[0-9]+$"), bare.try_cast("decimal(37,0)")).otherwise(marked)

    def read(low: Column) -> Column:
        sign = F.when(low.startswith("-"), F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")
        signed = F.when(low.rlike(shape), (sign * let(F.regexp_replace(low, "[+_-]", ""), based)).cast("decimal(38,0)"))
        # Plain decimals, the most of them, need no more.
        return F.when(low.rlike("^-?[1-9][0-9]{0,17}$"), low.try_cast("decimal(38,0)")).otherwise(signed)

    return let(F.lower(F.trim(text)), read)


def _instant(text: Column) -> Column:
    shaped = F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(shaped, F.regexp_replace(F.trim(text), r"(\.\d{6})\d+", "$1").try_cast("timestamp"))


def _record_holds(expected: Column, record: Column) -> Column:
    def held(wanted: Column) -> Column:
        some = lambda have: F.forall(F.map_entries(wanted), lambda e: F.coalesce(F.contains(F.lower(have[e["key"]]), F.lower(F.trim(e["value"]))), F.lit(False)))
        return (F.size(wanted) > 0) & let(F.from_json(record, "map<string,string>"), some)

    return let(F.from_json(expected, "map<string,string>"), held)


def value_match(expected: Column, leaf: Column, mode: Column) -> Column:
    """Does one leaf satisfy an expectation under exact, contains, int, iso_ts or record."""
    text, kind = leaf["text"], leaf["kind"]
    hit = (
        F.when(mode == "record", (kind == "object") & _record_holds(expected, text))
        .when(mode == "int", kind.isin("int", "str") & (to_int(expected) == to_int(text)))
        .when(mode == "iso_ts", (kind == "str") & (_instant(expected) == _instant(text)))
        .when(mode == "contains", F.contains(F.lower(text), F.lower(F.trim(expected))))
        .otherwise(F.trim(text) == F.trim(expected))
    )
    return F.coalesce(hit, F.lit(False))
