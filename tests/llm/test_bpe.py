from __future__ import annotations

import hashlib
import random

import pytest

from tests.llm.conftest import LONG
from tillwatch.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
PIECES = [
    "a", "b", "aaa", "e", "th", "the", " ", "  ", "\n", "É", "ß", "Σ", "ΑΣ", "İ", "1", "12", "½", "٣", "'s", "'LL", "!!", "<|endoftext|>", "<|startoftext|>", "<|endof", "漢字", "😀",
    "\u200d", "é", "e\u0301", "\xa0", "\x1c", "\x85", "ǅ", "ﬁ", "_", "-", "xx", "ab", "ing", "ll", "%%%", "\u0300", "\ufeff", "\x00",
]


@pytest.fixture(scope="module")
def library():
    made = tokenizers.Tokenizer.from_file(PATH)
    made.no_truncation()
    made.no_padding()
    return made


def test_encodes_and_decodes_as_the_library(library):
    rng, tables = random.Random(1), bpe.load(PATH)
    texts = ["", "a" * 50, "ha" * 300, "!" * 1000, LONG[:20_000]]
    texts += ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for letters in ("abcdefghijklmnopqrstuvwxyz", "aeth") for _ in range(700)]
    for text, expected in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = bpe.encode_text(tables, text).tolist()
        assert ids == expected.ids, text
        assert bpe.decode_ids(tables, ids) == library.decode(ids, skip_special_tokens=False)


def test_small_automata_equal_merging_by_rank():
    for seed in range(200):
        rng = random.Random(seed)
        vocab, merges = {c: i for i, c in enumerate("ab")}, []
        for _ in range(rng.randint(1, 8)):
            pair = rng.choice(list(vocab)), rng.choice(list(vocab))
            if "".join(pair) not in vocab:
                vocab["".join(pair)] = len(vocab)
                merges.append(pair)
        tables = bpe.compile_merges(vocab, merges, "", r"\w+", {})
        for _ in range(30):
            word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 14)))
            parts = list(word)
            for left, right in merges:
                i = 0
                while i < len(parts) - 1:
                    if parts[i] == left and parts[i + 1] == right:
                        parts[i : i + 2] = [left + right]
                    i += 1
            assert list(bpe.encode_word(tables, word)) == [vocab[p] for p in parts], (merges, word)


def test_full_caches_change_nothing(monkeypatch):
    tables = bpe.load(PATH)
    expected = bpe.encode_text(tables, LONG[:5000]).tolist()
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 5)
    assert bpe.encode_text(bpe.load(PATH), LONG[:5000]).tolist() == expected


def test_documents(documents, library):
    rows = [(1, "Hello  wörld"), (2, None), (3, ""), (None, "x<|endoftext|>"), (1, "Hello  wörld"), (4, LONG)]
    table = documents(rows)
    got = bpe.round_trip(table, PATH).collect()
    for row, (i, text) in zip(got, rows, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert tuple(row) == (i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    coded = bpe.encoded(table, PATH)
    decode = bpe.Bpe(table.sparkSession, PATH).decode
    assert coded.select(decode("ids")).first()[0] == library.decode(library.encode("Hello  wörld", add_special_tokens=False).ids)
    assert bpe.round_trip(table.limit(0), PATH).collect() == [] and set(table.columns) < set(coded.columns)


def test_every_code_point_splits_and_lowers_as_in_the_library(library):
    tables = bpe.load(PATH)
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    for start in range(0, len(points), 4000):
        texts = [t for c in points[start : start + 4000] for t in (c, f"a{c}b", f"e{c}́ 9{c}̖")]
        wrong = [t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if bpe.encode_text(tables, t).tolist() != e.ids]
        assert wrong == []


def test_random_unicode(library):
    rng, tables = random.Random(9), bpe.load(PATH)
    for _ in range(5000):
        points = [rng.choice([rng.randint(32, 126), rng.randint(1, 0x2FFF), rng.randint(0x300, 0x36F), rng.randint(1, 0x10FFFF)]) for _ in range(rng.randint(1, 14))]
        text = "".join(chr(c) for c in points if not 0xD800 <= c <= 0xDFFF)
        assert bpe.encode_text(tables, text).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_words_are_read_from_few_places_only():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

    tables, rng = bpe.load(PATH), random.Random(4)
    words = ["".join(rng.choice(["th", "in", "er", "an", "tion", "ing", "ou", "ble"]) for _ in range(6)) for _ in range(300)]
    tokens = sum(len(bpe.encode_word(tables, word)) for word in words)
    tables["pairs"] = Counted(tables["pairs"])
    for word in words:
        bpe.encode_word(tables, word)
    assert tables["pairs"].asked < 2 * tokens
