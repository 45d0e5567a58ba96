"""Benchmark decontamination with one Aho-Corasick automaton over word windows.

Text is normalised to words: A-Z lower-cased, words are runs of ASCII letters,
digits and everything beyond ASCII. The automaton's alphabet is the vocabulary of
the test items; a pattern is a window of consecutive item words (a shorter item is
one window). Each document is scanned once; hits map back to offsets in the text.

The items' text is what travels to the executors, so its size is checked: beyond
BLOCK_BYTES the items are dealt into blocks by hash, each with its own automaton.
The blocks scan one after the other, and each row carries its hits so far, so that
a row is never grouped with another.

Null text, on either side, has no words. Items with a null id take no part;
repeated items count once. Null and repeated document ids give a result a row;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.common import Scratch, chunks, keep, texts

WINDOW = 10
BLOCK_BYTES = 16 << 20

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


class Scanner:
    def __init__(self, items: list[tuple[str, str]], width: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            for k in range(max(1, len(ids) - width + 1) if ids else 0):
                owners.setdefault(tuple(ids[k : k + width]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, ids in owners.items():
            self.automaton.add_word(window, (len(window), frozenset(ids)))
        self.empty = not owners
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, the hit words as merged [first, end) ranges, the items found."""
        found = words(text)
        if self.empty or not found:
            return len(found), [], set()
        get = self.vocabulary.get
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        for end, (width, owners) in self.automaton.iter(tuple([get(w, 0) for w in found])):
            first = end - width + 1
            items |= owners
            while ranges and ranges[-1][1] >= first:  # ends never go back
                first = min(first, ranges.pop()[0])
            ranges.append((first, end + 1))
        return len(found), ranges, items


def spans_of(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets in the text of ranges of words."""
    if not ranges:
        return []
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_TABLE))]
    return [(len(raw[: at[a][0]].decode(errors="ignore")), len(raw[: at[b - 1][1]].decode(errors="ignore"))) for a, b in ranges]


_PAIRS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
_ARROW_PAIRS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_ITEMS = T.ArrayType(T.StringType())


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _pairs(rows: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in r] for r in rows], _ARROW_PAIRS)


def _scan_block(source: DataFrame, items: list[tuple[str, str]], width: int, last: bool) -> DataFrame:
    """source: row, text and, after another block, ranges and items. Adds this block's hits to each row; the last block gives n_words and spans instead of the text."""
    name = uuid.uuid4().hex
    again = "ranges" in source.columns

    def run(batches):
        scanner = keep(f"scanner {name}", lambda: Scanner(items, width))
        for part in chunks(batches, "text"):
            whole = texts(part.column("text"))
            before = zip(part.column("ranges").to_pylist(), part.column("items").to_pylist()) if again else [([], [])] * len(whole)
            counts, ranges, found = [], [], []
            for text, (old, names) in zip(whole, before):
                n, hits, got = scanner.scan(text)
                counts.append(n)
                ranges.append(merged([(x["a"], x["b"]) for x in old] + hits) if old else hits)
                found.append(sorted(got.union(names)))
            hit = [_pairs(ranges), pa.array(found, pa.list_(pa.string()))]
            if last:
                spans = _pairs([spans_of(t, r) for t, r in zip(whole, ranges)])
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(counts, pa.int64()), hit[0], spans, hit[1]], ["row", "n_words", "ranges", "spans", "items"])
            else:
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), *hit], ["row", "text", "ranges", "items"])

    fields = [source.schema["row"]]
    fields += [T.StructField("n_words", T.LongType()), T.StructField("ranges", _PAIRS), T.StructField("spans", _PAIRS)] if last else [T.StructField("text", T.StringType()), T.StructField("ranges", _PAIRS)]
    return source.mapInArrow(run, T.StructType([*fields, T.StructField("items", _ITEMS)]))


def _scanned(docs: DataFrame, benchmark: DataFrame, keep: list[str], width: int, block_bytes: int) -> DataFrame:
    """(row, n_words, ranges, spans, items): row is a struct of the kept columns, so that their names can't clash."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    scratch = Scratch(docs.sparkSession)
    now = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text").alias("text"))
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        before, now = now, _scan_block(now, sorted({(r.item, r.text) for r in mine}), width, b == blocks - 1)
        if b < blocks - 1:
            now = scratch.write(now)
            scratch.drop(before)
    return now


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of docs: doc_id, n_words, ranges of hit words, their spans in the text, the items found."""
    return _scanned(docs, benchmark, ["doc_id"], width, block_bytes).select("row.doc_id", "n_words", "ranges", "spans", "items")


def digest(found: DataFrame) -> DataFrame:
    """One row of counts for each document."""
    hits = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda acc, x: acc + x["b"] - x["a"])
    return found.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (hits > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs without a hit, with their own columns: no join, no regrouping."""
    return _scanned(docs, benchmark, docs.columns, width, block_bytes).where(F.size("ranges") == 0).select("row.*")


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
