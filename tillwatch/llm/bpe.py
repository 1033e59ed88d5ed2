"""Byte-pair encoding and decoding by a deterministic automaton made from the merges.

The automaton reads tokens. It starts with one state in which every byte symbol may follow every other, and each merge
u + v -> w, in order of rank, adds a gadget: after u, v may no longer follow; w may be read wherever u may; and after w
may follow what may follow v. (For u = v the state after w is the one before the change, and w may not follow u either.)
A sequence of tokens is accepted if and only if it is the encoding of its text, and exactly one sequence is accepted
for each text. A state is known by the last token read, so the automaton's table is a relation on pairs of tokens:
``follows``. A gadget copies rows and columns of that relation; instead of storing the copies, the table keeps for each token
its gadget (parts and rank), and an entry is worked out from the entries it was copied from when first needed.

A word is encoded by transitions over this table: of the tokens that start at the place reached, the longest that may follow
the last one leads on; where none may, the automaton goes back one token and takes the next shorter one. Each place can be
reached in one way only, so a place that was left is not tried again, and the work grows with the length of the word.
No word holds white space, so texts are cut there first; pieces seen before are looked up. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwatch.llm.memory import small_batches, tidied

CACHED_WORDS = 250_000  # twice: the pieces met last, and those met before them
CACHED_PAIRS = 300_000
SEPARATORS = re.compile("[\x1c-\x1f]")

# Where the tokenizers library's Unicode tables differ from those of this Python and of regex; found by comparing all code points.
# Letters and digits of regex that the library takes for neither.
NO_LETTERS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E "
    "2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
)
NO_DIGITS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
# Marks that its normalization takes for base characters, so that nothing is composed or reordered across them.
NO_MARKS = (
    "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF "
    "10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 11938 1193D-1193E 11943 119E0 11A34 11A47 11A99 "
    "11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF "
)
# Upper-case letters (first, last) that only the library lower-cases, and how far away their lower-case letters are.
MORE_CAPITALS = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
]


def any_of(ranges: str) -> str:
    """A pattern's class of the code points in ranges of hexadecimal numbers."""
    return "[" + "".join("-".join(f"\\U{int(c, 16):08X}" for c in r.split("-")) for r in ranges.split()) + "]"


OTHER = re.compile(any_of(f"{NO_LETTERS} {NO_DIGITS}"))
BETWEEN = re.compile(f"({any_of(NO_MARKS)})")
CAPITAL = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b, _ in MORE_CAPITALS) + "]")
LOWER = {c: c + by for a, b, by in MORE_CAPITALS for c in range(a, b + 1)}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints, else the next from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


def load(path: str) -> dict:
    """The tables of a tokenizer file with BPE merges, a word-end suffix, and special tokens, as plain data."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return compile_merges(vocab, merges, suffix, split, special)


def compile_merges(vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str, split: str, special: dict[str, int]) -> dict:
    """Gadgets and spellings. ``gadget``: token -> (left, right, rank); ``joined``: pair -> rank; ``final``: letters -> id of the token that they end a word with;
    ``begins``: letters that a token begins with -> ids of the inner tokens that these letters begin with, longest first; ``sizes``: id -> number of letters."""
    gadget, joined, inner, final, sizes, dead = {}, {}, {}, {}, {}, set()
    tables = {"gadget": gadget, "joined": joined, "pairs": {}}
    for rank, (left, right) in enumerate(merges):
        u, v, w = vocab[left], vocab[right], vocab[left + right]
        if u in dead or v in dead or parted(tables, u, v) < rank:
            dead.add(w)  # an earlier merge always parts the two: there is no path for the gadget
        else:
            gadget[w], joined[(u, v)] = (u, v, rank), rank
            tables["pairs"].pop(u << 20 | v, None)
    for token, number in vocab.items():
        ends = bool(suffix) and token.endswith(suffix) and token != suffix
        letters = token[: -len(suffix)] if ends else token
        if number not in gadget and (len(letters) != 1 or number in dead):
            continue  # neither a byte nor made by a merge: never produced
        (final if ends else inner)[letters], sizes[number] = number, len(letters)
    begins: dict[str, tuple[int, ...]] = {"": ()}
    for letters in (*inner, *final):
        for n in range(1, len(letters) + 1):
            if (first := letters[:n]) not in begins:
                begins[first] = ((inner[first],) if first in inner else ()) + begins[first[:-1]]
    labels = [""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, number in [*vocab.items(), *special.items()]:
        labels[number] = token
    final = final if suffix else inner
    return {"gadget": gadget, "joined": joined, "begins": begins, "sizes": sizes, "final": final, "labels": labels, "gapless": "" not in labels, "suffix": suffix, "split": split, "special": special, "letters": byte_letters(), "pairs": {}, "words": {}, "before": {}, "pattern": None}


NEVER = 1 << 60


def parted(tables: dict, x: int, y: int) -> int:
    """The rank from which on y may no longer follow x; NEVER if it always may.

    Of the two, the token made later took the entry from its parts: x from its right part, y from its left one.
    """
    pairs = tables["pairs"]
    if (known := pairs.get(x << 20 | y)) is not None:
        return known
    gadget, joined = tables["gadget"], tables["joined"]
    todo = [(x, y)]
    while todo:  # the entry, the entry it was copied from, and so on
        a, b = todo[-1]
        ga, gb = gadget.get(a), gadget.get(b)
        ra, rb = ga[2] if ga else -1, gb[2] if gb else -1
        source, copied = None, -1
        if ra > rb:
            source, copied = (ga[1], b), ra
        elif rb > ra or rb >= 0:
            source, copied = (a, gb[0]), rb
        was = pairs.get(source[0] << 20 | source[1]) if source else None
        if source and was is None:
            todo.append(source)
            continue
        when = joined.get((a, b), NEVER)
        if source:
            # a row is copied before its own merge takes effect, a column after it
            if was < copied or (was == copied and ra <= rb):
                when = copied
        if len(pairs) > CACHED_PAIRS + 1000:
            pairs.clear()
            todo = [(x, y)]
            continue
        pairs[a << 20 | b] = when
        todo.pop()
    return when


def encode_word(tables: dict, word: str) -> tuple[int, ...]:
    """Tokens of one pre-split word."""
    letters, pairs, final, begins, sizes = tables["letters"], tables["pairs"], tables["final"], tables["begins"], tables["sizes"]
    text = word if word.isascii() and word.isprintable() and " " not in word else "".join([letters[b] for b in word.encode("utf-8")])
    whole = final.get(text)
    if whole is not None:
        return (whole,)
    end = len(text)
    out, left = [], None  # tokens so far, and places from which no path leads on
    at, token, most = 0, -1, end  # most: where the next token may end at the latest
    while at < end:
        here, to = begins.get(text[at : at + 3]), at + 4
        if here is None:
            here = begins.get(text[at : at + 2]) or begins.get(text[at], ())
        else:
            while to <= end and (more := begins.get(text[at:to])) is not None:
                here, to = more, to + 1
            if to > end and most == end and (found := final.get(text[at:])) is not None:
                when = NEVER if token < 0 else pairs.get(token << 20 | found)
                if (parted(tables, token, found) if when is None else when) == NEVER:
                    out.append(found)
                    break
        if most == end:
            most -= 1
        for found in here:
            to = at + sizes[found]
            if to > most or (left and to in left):
                continue
            when = NEVER if token < 0 else pairs.get(token << 20 | found)
            if (parted(tables, token, found) if when is None else when) == NEVER:
                out.append(found)
                at, token, most = to, found, end
                break
        else:  # back by one token, then a shorter one
            if not out:
                break
            left = left or set()
            left.add(at)
            most = at - 1
            at -= sizes[out.pop()]
            token = out[-1] if out else -1
    return tuple(out)


def normalized(text: str) -> str:
    """NFC and lower case letter by letter, as the library has them; white space is left to the caller."""
    if not text.isascii():
        if BETWEEN.search(text):
            text = "".join([unicodedata.normalize("NFC", part) for part in BETWEEN.split(text)])
        else:
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower() would write a final sigma
            text = text.replace("Σ", "σ")
        if CAPITAL.search(text):
            text = text.translate(LOWER)
    return text.lower()


def split_words(pattern, chunk: str) -> list[str]:
    """The pre-split words of a chunk. What only regex takes for a letter or digit stands in as an unassigned code point."""
    if not chunk.isascii() and OTHER.search(chunk):
        return [chunk[m.start() : m.end()] for m in pattern.finditer(OTHER.sub("\uffff", chunk))]
    return pattern.findall(chunk)


def encode_chunk(tables: dict, chunk: str) -> bytes:
    """Tokens of a normalized text without white space, packed, kept for the next time."""
    words, before, pattern = tables["words"], tables["before"], tables["pattern"]
    out = words.get(chunk) or before.get(chunk)
    if out is None:
        if pattern is None:
            pattern = tables["pattern"] = regex.compile(tables["split"])
        found = split_words(pattern, chunk)
        if len(found) == 1:
            out = packed(encode_word(tables, found[0]))
        else:
            out = b"".join([words.get(word) or before.get(word) or packed(encode_word(tables, word)) for word in found])
    if len(chunk) <= 64:
        if len(words) >= CACHED_WORDS:
            before.clear()
            before.update(words)
            words.clear()
        words[chunk] = out
    return out


def packed(ids: Sequence[int]) -> bytes:
    return array("i", ids).tobytes()


def encode_text(tables: dict, text: str | None) -> np.ndarray:
    """Ids of a text; special tokens in it are themselves. A null text has none."""
    if not text:
        return np.zeros(0, np.int32)
    special, known = tables["special"], tables["words"].get
    pieces = regex.split("(" + "|".join(map(regex.escape, special)) + ")", text) if special and any(s in text for s in special) else [text]
    out: list[bytes] = []
    for piece in pieces:
        if piece in special:
            out.append(packed([special[piece]]))
            continue
        plain = normalized(piece)
        # str.split takes U+001C to U+001F for white space, the split pattern does not
        chunks = regex.split(r"\s+", plain) if SEPARATORS.search(plain) else plain.split()
        found = list(map(known, chunks))
        if None in found:
            found = [encode_chunk(tables, chunk) if ids is None else ids for chunk, ids in zip(chunks, found, strict=True)]
        out += found
    return np.frombuffer(b"".join(out), np.int32)


def decode_ids(tables: dict, ids) -> str:
    """The labels of the ids, with a space between; ids outside the vocabulary have none."""
    labels, ids = tables["labels"], np.asarray(ids, dtype=np.int64)
    if len(ids) and (not tables["gapless"] or ids.min() < 0 or ids.max() >= len(labels)):
        return " ".join([labels[i] for i in ids.tolist() if 0 <= i < len(labels) and labels[i]])
    return " ".join(map(labels.__getitem__, ids.tolist()))


DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


class Bpe:
    """Encoder and decoder of a tokenizer file, as functions on DataFrame columns. The file is read on the driver."""

    def __init__(self, spark, path: str):
        small_batches(spark)
        shared = spark.sparkContext.broadcast(load(path))

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in tidied(texts):
                yield pd.Series([encode_text(shared.value, t) for t in batch], dtype=object)

        @F.pandas_udf(T.StringType())
        def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in ids:
                yield pd.Series([None if x is None else decode_ids(shared.value, x) for x in batch], dtype=object)

        @F.pandas_udf(DIGESTS)
        def round_trip(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in tidied(texts):
                yield pd.DataFrame([digests(shared.value, t) for t in batch], columns=DIGESTS.names)

        self.encode, self.decode, self.round_trip = encode, decode, round_trip


def digests(tables: dict, text: str | None) -> tuple[int, str, str]:
    """Number of tokens, SHA-256 of the ids as little-endian unsigned 32-bit integers, SHA-256 of the decoded text."""
    ids = encode_text(tables, text)
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode_ids(tables, ids).encode("utf-8")).hexdigest()


def encoded(documents: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The documents with the ids of their whole texts as ``ids``. Null and empty texts have no ids; other columns are kept."""
    return documents.withColumn(ids, Bpe(documents.sparkSession, path).encode(F.col(text).cast("string")))


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, number of tokens, digest of the ids, digest of the decoded text. Repeated rows are encoded alike; an empty table gives no rows."""
    both = Bpe(documents.sparkSession, path).round_trip(F.col("text").cast("string"))
    return documents.select("doc_id", both.alias("_both")).select("doc_id", "_both.*")
