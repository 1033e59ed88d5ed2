"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lower-cased. A document and a benchmark item are a candidate pair when they share
a seed: ``min_match`` words in a row. On a candidate pair the longest run of words that both have and that no tile
covers yet is found again and again (Karp-Rabin hashes of windows, longest first) and becomes a tile on both sides,
until no run of ``min_match`` words is left. The share of the item's words under tiles is its coverage; it does not
depend on the order of the passages, so reordered passages count in full. A pair is a leak at ``threshold``.

The benchmark goes out in blocks of a fixed number of words, one pass over the documents per block, one after the other, so what is
broadcast has a fixed bound however large the benchmark is. With several blocks each pass writes what it finds by digest of the text, and its
broadcast is destroyed before the next.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.memory import small_batches, tidied
from tillwatch.session import Workspace

MIN_MATCH = 5
THRESHOLD = 0.6
BLOCK_WORDS = 2_000_000
SEEN_PIECES = 500_000

WORD = re.compile(r"[^\W_]+")
BASE = 0x9E3779B97F4A7C15
LEAKS = "array<struct<item_id:bigint,coverage:double,n_tiles:int,covered:int,words:int>>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def windows(codes: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash of each window of ``length`` words, modulo 2^64."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, base = np.zeros(n, np.uint64), np.uint64(BASE)
    power = length
    # hash(window) = sum of code * base^(length-1-i), built by doubling: O(log length) passes
    pieces, span, whole = [], 1, codes.astype(np.uint64)
    while power:
        if power & 1:
            pieces.append((span, whole))
        power >>= 1
        if power:
            scale = np.uint64(pow(BASE, span, 1 << 64))
            whole = whole[: len(whole) - span] * scale + whole[span:]
            span *= 2
    at = 0
    for span, hashed in reversed(pieces):
        scale = np.uint64(pow(BASE, span, 1 << 64))
        out = out * scale + hashed[at : at + n]
        at += span
    return out


def free_windows(covered: np.ndarray, length: int) -> np.ndarray:
    """Whether no word of a window is covered."""
    total = np.concatenate(([0], np.cumsum(covered)))
    return total[length:] == total[:-length]


def longest_matches(item: np.ndarray, text: np.ndarray, item_used: np.ndarray, text_used: np.ndarray, low: int, high: int) -> tuple[int, list[int], dict]:
    """The length of the longest uncovered run both have, from low to high, its places in the item, in order, and for each the places in the text; (0, [], {}) if none."""

    def at(length: int):
        a, b = windows(item, length), windows(text, length)
        if not len(a) or not len(b):
            return None
        i, j = np.flatnonzero(free_windows(item_used, length)), np.flatnonzero(free_windows(text_used, length))
        j = j[np.isin(b[j], a[i])]
        return (i[np.isin(a[i], b[j])], j, a, b) if len(j) else None

    found, length = at(low), low
    if found is None:
        return 0, [], {}
    while low < high:  # a run of some length holds runs of all shorter lengths
        middle = (low + high + 1) // 2
        more = at(middle)
        if more is None:
            high = middle - 1
        else:
            low, found, length = middle, more, middle
    i, j, a, b = found
    places: dict[int, list[int]] = {}
    for y in j.tolist():
        places.setdefault(int(b[y]), []).append(y)
    return length, i.tolist(), {x: places[int(a[x])] for x in i.tolist()}


def tile(item: np.ndarray, text: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, length) of the tiles, longest first; ties by place in the item, then in the text."""
    item_used, text_used = np.zeros(len(item), np.int64), np.zeros(len(text), np.int64)
    tiles, high = [], min(len(item), len(text))
    while high >= min_match:
        length, starts, places = longest_matches(item, text, item_used, text_used, min_match, high)
        if not starts:
            break
        passed: dict[int, int] = {}  # of each list of places, those that are covered: a covered place stays covered
        for x in starts:
            if item_used[x : x + length].any():
                continue
            ys = places[x]
            at = passed.get(id(ys), 0)
            while at < len(ys) and text_used[ys[at] : ys[at] + length].any():
                at += 1
            passed[id(ys)] = at
            while at < len(ys) and (text_used[ys[at] : ys[at] + length].any() or not np.array_equal(item[x : x + length], text[ys[at] : ys[at] + length])):
                at += 1  # places of equal hash hold equal words, but for collisions
            if at < len(ys):
                item_used[x : x + length] = text_used[ys[at] : ys[at] + length] = 1
                tiles.append((x, ys[at], length))
        high = length if tiles and tiles[-1][2] == length else length - 1
    return tiles


def index(items: Sequence[tuple[int, str | None]], min_match: int) -> dict:
    """Codes of the vocabulary (distinct, numbered), items as codes, and the seeds' hashes with the items they come from.

    An item of fewer than ``min_match`` words has one seed, all its words. Items without words have none.
    """
    numbers: dict[str, int] = {}
    rows, by_length = [], {}
    for item_id, text in items:
        words = words_of(text)
        if words:
            codes = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], dtype=np.int64)
            length = min(min_match, len(codes))
            for h in np.unique(windows(codes, length)).tolist():
                by_length.setdefault(length, {}).setdefault(h, []).append(len(rows))
            rows.append((item_id, codes))
    seeds = {n: (np.array(sorted(found), dtype=np.uint64), found) for n, found in by_length.items()}
    return {"numbers": numbers, "rows": rows, "seeds": seeds, "seen": {}, "lists": []}


def codes_of(text: str | None, ready: dict) -> np.ndarray:
    """The number of each word, 0 for words that no item has.

    No word holds white space, so the text is cut there first, and pieces seen before are looked up: a piece of one word
    as its number, a piece of none or several as a negative number that names its list.
    """
    seen, lists = ready["seen"], ready["lists"]
    pieces = text.lower().split() if text else []
    found = list(map(seen.get, pieces))
    if None in found:
        numbers = ready["numbers"]
        if len(seen) + len(pieces) > SEEN_PIECES:
            seen.clear()
            lists.clear()
        for piece in pieces:
            if piece not in seen:
                codes = [numbers.get(w, 0) for w in WORD.findall(piece)]
                if len(codes) == 1:
                    seen[piece] = codes[0]
                else:
                    lists.append(codes)
                    seen[piece] = -len(lists)
        found = list(map(seen.get, pieces))
    codes = np.array(found, dtype=np.int64)
    if len(codes) and codes.min() < 0:
        codes = np.array([c for x in found for c in ((x,) if x >= 0 else lists[-x - 1])], dtype=np.int64)
    return codes


def near(places: np.ndarray, size: int, width: int) -> np.ndarray:
    """Positions within seeds that start at ``places``, ascending."""
    mark = np.zeros(size + 1, np.int64)
    np.add.at(mark, places, 1)
    np.add.at(mark, np.minimum(places + width, size), -1)
    return np.flatnonzero(np.cumsum(mark[:-1]) > 0)


def leaks_of(text: str | None, ready: dict, min_match: int, threshold: float) -> list[dict]:
    """Items of which the text covers the threshold, by item order."""
    codes = codes_of(text, ready)
    at: dict[int, list[np.ndarray]] = {}
    for length, (hashes, owners) in ready["seeds"].items():
        if len(codes) < length:
            continue
        known = np.flatnonzero(free_windows(codes == 0, length))
        if not len(known):
            continue  # nowhere are that many words of items in a row
        hashed = windows(codes, length)[known]
        hit = hashes[np.minimum(np.searchsorted(hashes, hashed), len(hashes) - 1)] == hashed
        for h, place in zip(hashed[hit].tolist(), known[hit].tolist(), strict=True):
            for row in owners[h]:
                at.setdefault(row, []).append(place)
    out = []
    for row in sorted(at):
        item_id, item = ready["rows"][row]
        width = min(min_match, len(item))
        keep = near(np.array(sorted(at[row])), len(codes), width)
        # words between seeds can be in no tile: one word that matches nothing stands for each gap
        gaps = np.flatnonzero(np.diff(keep) > 1) + 1
        part = np.insert(codes[keep], gaps, 0)
        tiles = tile(item, part, width)
        covered = sum(n for _, _, n in tiles)
        if covered >= threshold * len(item):
            out.append({"item_id": item_id, "coverage": covered / len(item), "n_tiles": len(tiles), "covered": covered, "words": len(item)})
    return out


def block_count(benchmark: DataFrame, block_words: int) -> int:
    """The number of blocks of about ``block_words`` words, by size of text."""
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 8
    return max(1, -(-int(benchmark.agg(F.sum(size)).first()[0] or 0) // (block_words * 6)))


def block(benchmark: DataFrame, number: int, count: int) -> list[tuple[int, str | None]]:
    """One of ``count`` blocks of the benchmark, by hash; an item larger than a block makes its block larger."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == number)
    return [(r.item_id, r.text) for r in rows.orderBy("item_id", "text").collect()]


def with_leaks(documents: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "leaks", min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with a column of their leaks: item, coverage, number of tiles, words under tiles, words of the item.

    Null and empty texts and items have no leaks. An item of fewer than ``min_match`` words leaks when its whole sequence
    occurs. Repeated documents and items each count. An empty benchmark gives empty lists. A column named ``out`` is
    replaced; other columns are kept as they are.
    """
    spark = documents.sparkSession
    small_batches(spark)
    whole, sizes = F.col(text).cast("string"), block_count(benchmark, block_words)
    if sizes == 1:
        shared = spark.sparkContext.broadcast(index(block(benchmark, 0, 1), min_match))
        return documents.withColumn(out, _leaks_column(shared, min_match, threshold)(whole))
    workspace, parts = Workspace(spark), []
    for number in range(sizes):
        shared = spark.sparkContext.broadcast(index(block(benchmark, number, sizes), min_match))
        found = documents.select(F.sha2(whole, 256).alias("_digest"), _leaks_column(shared, min_match, threshold)(whole).alias("_found"))
        parts.append(workspace.stage(found.filter(F.size("_found") > 0).dropDuplicates(["_digest"]), f"block-{number}"))
        shared.destroy()
    leaking = parts[0]
    for part in parts[1:]:
        leaking = leaking.unionByName(part)
    leaking = leaking.groupBy("_digest").agg(F.flatten(F.collect_list("_found")).alias("_found"))  # of a text that leaks, at most a row from each block
    rows = documents.select(F.struct("*").alias("_row"), F.sha2(whole, 256).alias("_digest")).join(leaking, "_digest", "left")
    found = F.coalesce("_found", F.array().cast(LEAKS))
    return rows.select(*[F.col("_row")[c].alias(c) for c in documents.columns if c != out], found.alias(out))


def _leaks_column(shared, min_match: int, threshold: float):
    @F.pandas_udf(LEAKS)
    def leaks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in tidied(texts):
            yield pd.Series([leaks_of(t, shared.value, min_match, threshold) for t in batch], dtype=object)

    return leaks


def leaks(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document and benchmark item it leaks: doc_id, item_id, coverage, n_tiles, covered, words."""
    found = with_leaks(documents.select("doc_id", "text"), benchmark, **options)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
