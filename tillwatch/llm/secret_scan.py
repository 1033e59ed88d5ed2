"""Secrets in texts: fixed patterns, and a linear-chain conditional random field with tags begin, inside, outside.

Tokens are pieces between white space without surrounding quotes and punctuation. The field scores a token by its shape,
by the shape of the tokens beside it, by whether it begins a line, and by features of the file (does it look like code, is it a single
line), and Viterbi picks the best tags of each paragraph, the lines up to an empty one; so a secret may go on over lines. Every token is scored; the scores of a token's text are kept and looked up. Where no
tags of the neighbours can make up for what a token loses by not being outside, the best path passes through the outside tag, and
the runs of other tokens are decoded each for itself: the same path, found by looking at few tokens. The field is trained on
paragraphs written by rule (below), labelled token by token. They have no secrets of several plain words with spaces between them.

Spans found by the fixed patterns stay as they are; the field adds spans that overlap none of them, as kind ``tagged``.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwatch.llm import crf

# The patterns, in the order of kinds, and the least length of what they find.
KEYWORDS = ("password", "passwd", "secret", "token", "api")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "tagged")

OUT, BEGIN, INSIDE = 0, 1, 2
LINE_HEAD = "line head"
FEATURES = 1 << 14
KNOWN = 700_000  # texts of tokens whose scores are kept
LONG = 100  # longer ones are scored each time
PIECE = re.compile(r"\S+")
EDGES = "\"'`,;()[]{}<>"
LETTERS = re.compile(r"[^\W\d_]+")
HARD = re.compile(r"[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{3,}")
HEAD = re.compile(r"[a-z]{2,5}(?=[_-])")
HEXLIKE = re.compile(r"[0-9a-fA-F-]+")
# characters that shape_of does not tell apart, but for what letter_shape, HEXLIKE and the number of different ones say
ALIKE = {ord(c): k for k, chars in (("a", "abcdefghijklmnopqrstuvwxyz"), ("A", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("0", "0123456789"), ("é", "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ")) for c in chars}

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, leftmost and not overlapping per kind, by kind and start."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def core(piece: str) -> tuple[int, int]:
    """Where a piece begins and ends without quotes, brackets and closing punctuation."""
    bare = piece.rstrip(EDGES + ".!?:")
    return len(bare) - len(bare.lstrip(EDGES)), len(bare)


def may_be_secret(token: str) -> bool:
    """Whether there is anything to tag: a piece of quotes and punctuation only has no token."""
    return token != ""


def letter_shape(token: str) -> tuple[int, str]:
    """The longest run of consonants, and the letters before a first mark."""
    head = HEAD.match(token)
    return min(max(map(len, HARD.findall(token)), default=0), 7), head[0] if head else ""


def shape_of(token: str) -> list[str]:
    """Names of a token's features."""
    if not token:
        return ["empty"]
    digits, lower, upper = (sum(f(c) for c in token) for f in (str.isdigit, str.islower, str.isupper))
    other = len(token) - digits - lower - upper
    runs = len(re.findall(r"[0-9]+|[a-z]+|[A-Z]+|[^0-9a-zA-Z]+", token))
    kinds = "".join(k for k, n in (("d", digits), ("l", lower), ("u", upper), ("o", other)) if n)
    short = re.sub(r"(.)\1+", r"\1", re.sub(r"[^0-9a-zA-Z]", "-", re.sub(r"[0-9]", "0", re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", token)))))[:10]
    values = min(len(set(token)) * 4 // len(token), 3)
    names = [f"kinds {kinds}", f"length {min(len(token) // 8, 6)}", f"runs {min(runs, 12)}", f"runs {min(runs * 4 // len(token), 3)} {kinds}", f"shape {short}", f"values {values}"]
    hard, head = letter_shape(token)
    lone = min(len(re.findall(r"(?<=[A-Z])[a-z](?=[A-Z])|(?<=[a-z])[A-Z](?=[A-Z][a-z])", token)), 3)
    names += [f"consonants {hard}", f"consonants {hard} {kinds}", f"lone {lone}", f"head {head}"]
    if re.fullmatch(r"[0-9.,:/+() -]+", token):
        names.append("number")
    if re.fullmatch(r"[0-9a-fA-F]+", token):
        names.append("hex")
    if re.fullmatch(r"[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", token):
        names.append("uuid")
    names += [f"has {mark}" for mark in ("://", "@", "/", "=", ":", "_", "-", ".") if mark in token]
    return names


def word_shape(token: str) -> list[str]:
    """Names of features a token has for its neighbours: its letters and its last mark."""
    letters = "".join(LETTERS.findall(token)).lower()
    return [f"word {letters}", f"last {token[-1:] if token[-1:] in '=:>\"' else ''}", "number" if token[:1].isdigit() else "other"]


def file_features(text: str) -> list[str]:
    return [name for name, yes in (("file code", "{" in text or ";" in text), ("file assigns", "=" in text), ("file one line", "\n" not in text.strip())) if yes]


def numbers(names: list[str]) -> list[int]:
    return [zlib.crc32(x.encode()) % FEATURES for x in names]


def labelled_lines(count: int = 8000, seed: int = 7) -> list[list[tuple[str, int]]]:
    """Lines to learn from, as (token, tag), written by rule with a fixed seed; a token that is a line break starts a new line."""
    rng = random.Random(seed)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    syllable = lambda: rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiou") + rng.choice(["", "", "n", "r", "s"])

    def word() -> str:
        if rng.random() < 0.5:
            return "".join(rng.choice("the an on ing tion er re st ou ent sch lich keit que eau ment ción os ra é ä ü".split()) for _ in range(rng.randint(1, 7)))
        return rng.choice(["a", "of", "to", "is", "and", "was", "for", "with", *("".join(syllable() for _ in range(rng.randint(1, 5))) for _ in range(8))])

    cap = lambda: word().capitalize()

    def part() -> str:
        return rng.choice(["get", "set", "user", "name", "list", "on", "to", "by", "id", *("".join(syllable() for _ in range(rng.randint(1, 3))) for _ in range(6))])

    def prose(n: int) -> list[tuple[str, int]]:
        return [((x.capitalize() if rng.random() < (0.2 if k else 0.6) else x.upper() if rng.random() < 0.04 else x) + (rng.choice(["***", "%%%", "###", "!!", "$$$"]) if rng.random() < 0.03 else ""), 0) for k, x in enumerate(word() for _ in range(n))]

    named = lambda: rng.choice(["password", "pwd", "pass", "passwd", "credentials", "passphrase", "secret"])
    sign = lambda: rng.choice([[], [("=", 0)], [(":", 0)], [("is", 0)]])

    def letters_of(n: int, letters: str = low + up) -> str:
        made = [*some(letters, n - 2), rng.choice(low), rng.choice(up)]
        rng.shuffle(made)
        return "".join(made)

    def mixed(n: int, letters: str = low + up + dig) -> str:
        made = list(some(letters, n))
        made[rng.randrange(n)] = rng.choice(dig)
        return "".join(made)

    BREAK = ("\n", 0)

    def block(n: int, letters: str) -> list[tuple[str, int]]:
        """A key in lines of equal width, the last one shorter."""
        width = rng.choice([48, 64, 64, 70, 76])
        lines = [(mixed(width, letters), 2) for _ in range(n)] + [(mixed(rng.randint(8, width), letters) + rng.choice(["", "=", "=="]), 2)]
        lines[0] = (lines[0][0], 1)
        return [x for line in lines for x in (BREAK, line)]

    def fence(what: str, name: str) -> list[tuple[str, int]]:
        tokens = f"-----{what} {name}-----".split()
        return [(t, 0) for t in tokens]

    def pem() -> list[tuple[str, int]]:
        name = rng.choice(["PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "PGP PRIVATE KEY BLOCK"])
        return [BREAK, *fence("BEGIN", name), *block(rng.randint(0, 20), low + up + dig + "+/"), BREAK, *fence("END", name), BREAK]

    def settings() -> list[tuple[str, int]]:
        """Some lines of a file of settings, secret or not."""
        out = [BREAK]
        for _ in range(rng.randint(2, 5)):
            name, mark = rng.choice(["key", "access_key", "auth", "client_secret", "private_key", "db_password"]), rng.choice(["=", ":"])
            plain_name = rng.choice(["host", "port", "user", "path", "name", "debug", "level", "region"])
            out += [(name, 0), (mark, 0), (mixed(rng.randint(20, 48), low + up + dig + "+/"), 1)] if rng.random() < 0.5 else [(plain_name, 0), (mark, 0), (rng.choice([word(), some(dig, 4), "/" + word() + "/" + word()]), 0)]
            out.append(BREAK)
        return out

    def call() -> str:
        """The first piece of a call, as white space cuts it."""
        name = rng.choice([part() + part().capitalize(), part() + part().capitalize() + part().capitalize(), part() + "." + part(), part() + "_" + part(), part()])
        return name + "(" + rng.choice(["", ")", part(), part() + ",", part() + ")", part() + ");", f'"{word()}"', part() + "." + part() + ")"])

    def code() -> list[tuple[str, int]]:
        out = [BREAK]
        for _ in range(rng.randint(1, 4)):
            out += rng.choice([[("return", 0), (call(), 0)], [(part(), 0), ("=", 0), (call(), 0)], [("def", 0), (call(), 0)], [("if", 0), (call(), 0), ("{", 0)], [(call(), 0), (part() + ")", 0)], [("import", 0), (part() + "." + part(), 0)]]) + [BREAK]
        return out

    secrets = [
        pem,
        pem,
        lambda: [(rng.choice(["key", "private_key", "secret_key", "signing_key"]), 0), (":", 0), *rng.choice([[("|", 0)], []]), *block(rng.randint(0, 6), low + up + dig + "+/"), BREAK],
        lambda: [x for _ in range(rng.randint(2, 4)) for x in ((rng.choice(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + mixed(rng.randint(20, 40)), 1), BREAK)],
        settings,
        lambda: [("ghp_" + mixed(36), 1)],
        lambda: [(rng.choice(["sk_live_", "sk-", "xoxb-", "glpat-", "pk_"]) + mixed(rng.randint(20, 40)), 1)],
        lambda: [("Authorization:", 0), ("Bearer", 0), (mixed(rng.randint(24, 60)), 1)],
        lambda: [(rng.choice(["password", "pwd", "pass", "credentials", "passphrase"]), 0), (rng.choice(["=", ":", "is"]), 0), (mixed(rng.randint(10, 20)), 1)],
        lambda: [(rng.choice(["key", "access_key", "auth", "client_secret", "private_key"]), 0), (rng.choice(["=", ":"]), 0), (mixed(rng.randint(20, 48), low + up + dig + "+/"), 1)],
        lambda: [("eyJ" + mixed(30) + "." + mixed(60) + "." + mixed(40), 1)],
        lambda: [("-----KEY", 0), (mixed(64, low + up + dig + "+/"), 1), (mixed(64, low + up + dig + "+/"), 2), (mixed(32, low + up + dig + "+/"), 2), ("-----END", 0)],
        lambda: [(rng.choice(["ghp_", "sk_live_", "sk-", "xoxb-", "glpat-", "pk_"]) + mixed(rng.randint(20, 40), rng.choice([low, up]) + dig), 1)],
        # without digits, or short
        lambda: [*rng.choice([[("Authorization:", 0), ("Bearer", 0)], [("Bearer", 0)]]), (letters_of(rng.randint(16, 60)), 1)],
        lambda: [(named(), 0), *sign(), (letters_of(rng.randint(8, 24)), 1)],
        lambda: [(named(), 0), *sign(), (letters_of(rng.randint(4, 9)) + rng.choice("-_+/#$&") + letters_of(rng.randint(3, 9)), 1)],
        lambda: [(named(), 0), *sign(), (mixed(rng.randint(5, 7), low + up + dig + "#$&"), 1)],
        lambda: [(named(), 0), *rng.choice([[("=", 0)], [(":", 0)], []]), ("-".join(part() for _ in range(rng.randint(3, 6))), 1)],
        lambda: [(rng.choice(["key", "access_key", "auth", "client_secret", "private_key"]), 0), (rng.choice(["=", ":"]), 0), (letters_of(rng.randint(20, 48), low + up + "+/"), 1)],
        lambda: [("-----KEY", 0), *((rng.choice([letters_of, mixed])(n, low + up + "+/"), 2 if k else 1) for k, n in enumerate([64, 64, rng.randint(10, 60)])), ("-----END", 0)],
    ]
    plain = [
        code,
        code,
        lambda: [(call(), 0), (part() + rng.choice([")", ");", ","]), 0)],
        lambda: [x for _ in range(rng.randint(1, 3)) for x in (BREAK, *prose(rng.randint(1, 9)))],
        lambda: [(some(dig, rng.randint(8, 19)), 0)],
        lambda: [(".".join(str(rng.randint(0, 255)) for _ in range(4)), 0)],
        lambda: [("+1", 0), (f"({some(dig, 3)})", 0), (f"555-{some(dig, 4)}", 0)],
        lambda: [(f"{word()}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", 0)],
        lambda: [(f"https://{word()}.example.org/{rng.randint(1, 999)}/{word()}?page={rng.randint(1, 9)}", 0)],
        lambda: [("-".join([some("abcdef" + dig, 8), *(some("abcdef" + dig, 4) for _ in range(3)), some("abcdef" + dig, 12)]), 0)],
        lambda: [(f"20{some(dig, 2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", 0)],
        lambda: [(f"{word()}{rng.randint(1, 9)}{word()}", 0)],
        lambda: [(f"v{rng.randint(0, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 30)}-beta{rng.randint(1, 9)}", 0)],
        lambda: [(word() + rng.choice(["%%%", "###", "$$$", "***", "&&&"]), 0)],
        lambda: [(f"{some(dig, 3)}{rng.choice(['%%%', '###', '&&&'])}", 0), (some(dig, 16) + rng.choice(["%%%", "###", "$$$"]), 0)],
        lambda: [("".join(part().capitalize() for _ in range(rng.randint(2, 4))), 0)],
        lambda: [(word() + cap(), 0), (rng.choice(["=", "(", "{", ":"]), 0), ("".join([part(), part().capitalize(), part().capitalize()]) + rng.choice(["", "()", ";"]), 0)],
        lambda: [(rng.choice("-_/.|").join(word() for _ in range(rng.randint(2, 5))), 0)],
        lambda: [("/" + "/".join(word() for _ in range(rng.randint(2, 5))) + rng.choice(["", ".py", ".txt"]), 0)],
        lambda: [(f"https://{word()}.example.org/{word()}/{word()}", 0), (f"{word()}.{word()}@{word()}.example.com", 0)],
        lambda: [(word().upper(), 0), (word().upper() + rng.choice(["!!", "***", "_" + word().upper()]), 0)],
        lambda: [(rng.choice(["|", "-", "===", "-----", "--", "*", "#", "//", "&&", "->"]), 0), (cap(), 0), (rng.choice(["|", "+", "="]), 0), (word(), 0)],
        lambda: [(f"<{word()}>{word()}</{word()}>", 0), (f"{word()}'{rng.choice(['s', 't', 're'])}", 0), (f"{word()}...{word()}", 0)],
        lambda: [(rng.choice([named(), named().capitalize()]), 0), *prose(rng.randint(1, 4))],
        lambda: prose(rng.randint(1, 12)),
        lambda: [(word(), 0), *((cap(), 0) for _ in range(rng.randint(1, 4)))],
        lambda: [(rng.choice(["Bearer", "key", "token", "auth", "api", "key"]), 0), *rng.choice([[], [("is", 0)]]), (word(), 0), (word(), 0)],
        lambda: [(word(), 0), (rng.choice(["=", ":"]), 0), (rng.choice([word, cap])(), 0)],
        lambda: [("".join(chr(rng.randint(a, a + 200)) for _ in range(rng.randint(1, 30))), 0) for a in [rng.choice([0x4E00, 0x3B1, 0xAC00])]],
        lambda: [("".join(rng.choice("абвгдежзиклмнопрст") for _ in range(rng.randint(1, 14))), 0), ("".join(rng.choice("αβγδεζηικλμνοπ") for _ in range(rng.randint(1, 12))), 0)],
        lambda: [(str(rng.randint(0, 2030)), 0), (rng.choice([f"{rng.randint(0, 99)}%", f"${rng.randint(1, 999)}", f"{rng.randint(1, 23)}:{rng.randint(10, 59)}", f"{rng.randint(1, 9)}th"]), 0)],
    ]
    lines = []
    for number in range(count):
        middle = rng.choice(secrets if number % 3 == 0 else plain)()
        lines.append([*prose(rng.randint(0, 6)), *middle, *prose(rng.randint(0, 6))])
    return lines


def paragraphs(lines: list[list[tuple[str, int]]], seed: int = 8) -> list[list[list[tuple[str, int]]]]:
    """The lines put together as paragraphs of one to some lines, each a list of (token, tag)."""
    rng, out = random.Random(seed), []
    for number, sample in enumerate(lines):
        new = [[]]
        for token, tag in sample:
            if token == "\n":
                new.append([])
            else:
                new[-1].append((token, tag))
        if number and rng.random() < 0.5:
            out[-1] += new
        else:
            out.append(new)
    return [[line for line in p if line] for p in out if any(p)]


def fit() -> dict:
    """Weights of the field: by shape of the token, by the tokens before and after, between tags, and of the line and file (trained as part of the token)."""
    tokens, tags, first = [], [], []
    for number, paragraph in enumerate(paragraphs(labelled_lines())):
        first.append(len(tokens))
        file = ("file code",) if number % 4 == 0 else ("file assigns",) if number % 4 == 1 else ()
        if len(paragraph) == 1 and number % 4 in (1, 2):
            file += ("file one line",)
        for line in paragraph:
            tokens += [(t[slice(*core(t))], (*file, LINE_HEAD) if k == 0 else file) for k, (t, _) in enumerate(line)]
            tags += [tag for _, tag in line]
    types = {t: k for k, t in enumerate(dict.fromkeys(tokens))}
    # own features and neighbour features share a table; they differ by name
    features = [numbers([*shape_of(t), *place, *word_shape(t)]) for t, place in types] + [numbers(["nothing"])]
    banned = np.zeros((len(tokens), 3), dtype=bool)
    for i, (t, _) in enumerate(tokens):
        banned[i, 1:] = not may_be_secret(t)
    model = crf.train(features, np.array([types[t] for t in tokens]), np.array(tags), np.array(first), 3, FEATURES, offsets=(0, -1, 1), banned=banned, epochs=80, l2=1e-5)
    model["start"][INSIDE] = model["between"][OUT, INSIDE] = -1e4  # a secret begins before it goes on
    return model


class Scores(dict):
    """Numbers of pieces of text, and by number what a piece's token adds to the scores: its own (3), those of the next token (3), those of the one before (3)."""

    def __init__(self, model: dict):
        own, before, after = model["weights"]
        self.weights = np.concatenate([own, before, after], axis=1)
        between, start = model["between"], model["start"]
        self.between, self.start = between, start
        self.nothing, self.head = (self.weights[numbers([name])].sum(axis=0) for name in ("nothing", LINE_HEAD))
        # least gains of a token's turning from BEGIN or INSIDE to OUT, by what is on its left, and on its right if that stays; see sure_outside
        tags = [BEGIN, INSIDE]
        self.left = np.array([(between[:, OUT] - between[:, b]).min() for b in tags])
        self.first = start[OUT] - start[tags]
        self.right = np.array([min(between[OUT, q] - between[b, q] for q in (OUT, BEGIN)) for b in tags])
        self.turn = np.array([between[OUT, BEGIN] - between[b, INSIDE] for b in tags]) + min(0.0, (between[BEGIN] - between[INSIDE]).min())
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.shapes, self.shape_rows, self.shape_table, self.count = {}, [], np.zeros((0, 9)), 0
        self.rows, self.empty, self.new = np.zeros((1024, 9)), np.zeros(1024, dtype=bool), []

    def __missing__(self, piece: str) -> int:
        token = piece[slice(*core(piece))]
        key = (token.translate(ALIKE), min(len(set(token)) * 4 // max(len(token), 1), 3), HEXLIKE.fullmatch(token) is not None, letter_shape(token))
        shape = self.shapes.get(key)
        if shape is None:
            shape = len(self.shape_table) + len(self.shape_rows)
            self.shape_rows.append(self.weights[numbers(shape_of(token))].sum(axis=0))
            if len(piece) <= LONG:
                self.shapes[key] = shape
        number = self.count + len(self.new)
        self.new.append((shape, *numbers(word_shape(token)), token == ""))
        if len(piece) <= LONG:
            self[piece] = number
        return number

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores by number, and whether the token is empty."""
        if self.new:
            new, upto = np.array(self.new, dtype=np.int64), self.count + len(self.new)
            if upto > len(self.rows):
                more = max(upto, 2 * len(self.rows)) - len(self.rows)
                self.rows, self.empty = np.concatenate([self.rows, np.zeros((more, 9))]), np.concatenate([self.empty, np.zeros(more, dtype=bool)])
            if self.shape_rows:
                self.shape_table, self.shape_rows = np.concatenate([self.shape_table, self.shape_rows]), []
            self.rows[self.count : upto] = self.shape_table[new[:, 0]] + self.weights[new[:, 1:4]].sum(axis=1)
            self.empty[self.count : upto] = new[:, 4]
            self.count, self.new = upto, []
        return self.rows, self.empty

    def sure_outside(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which tokens the best path leaves outside, whatever the tags beside them.

        In any path with another tag there, that tag is turned to OUT, and an INSIDE after it to BEGIN; if that always gains, no best path has it.
        """
        turned = np.append(scores[1:, BEGIN] - scores[1:, INSIDE], 0.0)
        right = np.minimum(self.right, self.turn + turned[:, None])
        last = np.append(first[1:], True)
        right[last] = 0.0
        left = np.where(first[:, None], self.first, self.left)
        return (scores[:, :1] - scores[:, 1:] + left + right).min(axis=1) > 1e-6


def tagged_spans(text: str, model: dict, known: Scores | None = None) -> list[tuple[str, int, int]]:
    """Spans that the field tags, in order; tokens of a secret that goes on, also over lines, are one span. ``known`` keeps scores from text to text."""
    known = Scores(model) if known is None else known
    if known.count > KNOWN:
        known.reset()
    lines = text.split("\n")
    pieces = [line.split() for line in lines]
    counts = np.array([len(p) for p in pieces])
    ids = np.array([known[p] for line in pieces for p in line], dtype=np.int64)
    if not len(ids):
        return []
    heads, full = np.cumsum(counts) - counts, counts > 0
    # a paragraph begins with the first line that has tokens, and with one after a line without
    first = np.zeros(len(ids), dtype=bool)
    first[heads[full & ~np.append(False, full[:-1])]] = True
    last = np.append(first[1:], True)
    rows, empty = known.table()
    rows, empty = rows[ids] + known.weights[numbers(file_features(text))].sum(axis=0), empty[ids]
    rows[heads[full]] += known.head
    # beyond the ends of a paragraph there is no token
    scores = rows[:, :3] + known.nothing[3:6] * first[:, None] + known.nothing[6:] * last[:, None]
    scores[1:] += rows[:-1, 3:6] * ~first[1:, None]
    scores[:-1] += rows[1:, 6:] * ~first[1:, None]
    scores[empty, 1:] = -1e9
    open_ = np.flatnonzero(~known.sure_outside(scores, first))
    if not len(open_):
        return []
    fresh = np.append(True, (np.diff(open_) > 1) | first[open_[1:]])
    begins = np.flatnonzero(fresh)
    sizes = np.diff(np.append(begins, len(open_)))
    starts = np.where(first[open_[begins], None], known.start, known.between[OUT])
    ends = np.where(last[open_[begins + sizes - 1], None], 0.0, known.between[:, OUT])
    tags = np.zeros(len(open_), dtype=np.int64)
    one = sizes == 1
    tags[begins[one]] = (starts[one] + scores[open_[begins[one]]] + ends[one]).argmax(axis=1)
    for k in np.flatnonzero(~one):
        at = slice(begins[k], begins[k] + sizes[k])
        tags[at] = crf.viterbi(scores[open_[at]], known.between, starts[k], ends[k])
    wanted = np.flatnonzero(tags != OUT)
    if not len(wanted):
        return []
    out, offsets, at_line, places = [], np.cumsum([0, *(len(x) + 1 for x in lines)]), -1, []
    of = np.searchsorted(heads, open_[wanted], "right") - 1
    for k, n in zip(wanted.tolist(), of.tolist(), strict=True):
        if n != at_line:
            at_line, places = n, [m.start() for m in PIECE.finditer(lines[n])]
        i = int(open_[k] - heads[n])
        a, b = core(pieces[n][i])
        a, b = int(offsets[n]) + places[i] + a, int(offsets[n]) + places[i] + b
        if tags[k] == BEGIN:
            out.append(("tagged", a, b))
        elif out:
            out[-1] = ("tagged", out[-1][1], b)
    return out


KEPT: dict[str, Scores] = {}


def kept_scores(name: str, model: dict) -> Scores:
    """The scores that this process keeps from task to task, of the model used last."""
    if name not in KEPT:
        KEPT.clear()
        KEPT[name] = Scores(model)
    return KEPT[name]


def spans_of(text: str | None, model: dict, known: Scores | None = None) -> list[dict]:
    """All spans of a text by kind, then start: those of the patterns, then tagged ones that overlap none of them."""
    if not text:
        return []
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    starts, reach = np.array([s for s, _ in taken]), np.maximum.accumulate([e for _, e in taken]) if taken else []
    more = []
    for kind, s, e in tagged_spans(text, model, known):
        at = int(np.searchsorted(starts, e)) - 1 if taken else -1  # spans that start before this one ends
        if at < 0 or reach[at] <= s:
            more.append((kind, s, e))
    return [{"kind": k, "start": s, "end": e} for k, s, e in base + more]


def with_secrets(documents: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """The documents with ``out``: kind, start and end (code points, end exclusive) of their secrets, by kind, then start.

    Null and empty texts have none. Spans of different patterns may overlap. Other columns are kept; repeated rows are scanned alike.
    """
    model = fit()
    name = hashlib.sha256(b"".join(x.tobytes() for x in (model["between"], model["start"], *model["weights"]))).hexdigest()
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SPANS)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = kept_scores(name, shared.value)
        for batch in texts:
            yield pd.Series([spans_of(t, shared.value, known) for t in batch], dtype=object)

    return documents.withColumn(out, scan(F.col(text).cast("string")))


def secrets(documents: DataFrame) -> DataFrame:
    """Per document: numbers of spans of each pattern, a digest of the patterns' spans by start, then kind, and all spans in that order."""
    found = with_secrets(documents.select("doc_id", "text")).drop("text")
    order = lambda x: F.struct(x["start"], F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("k"), x["end"], x["kind"])
    named = lambda spans: F.array_join(F.transform(F.array_sort(F.transform(spans, order)), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("secrets", lambda x: x["kind"] != "tagged")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(named(base), 256).alias("base_sha256"), named(F.col("secrets")).alias("spans"))
