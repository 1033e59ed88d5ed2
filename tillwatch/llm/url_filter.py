"""URL filter: explicit rules, and logistic regression on hashed character n-grams of host and path for the rest.

The regression is fitted on a small labelled table of invented URLs when the filter is made (written by rule with a fixed seed; full-batch
gradient descent, so the same everywhere). None is taken from the tables to be judged.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the labelled table is made of. Words of spam, ordinary words, some of which spam uses too, and the parts around them.
SPAM = (
    "pills viagra cialis meds pharmacy casino poker slots jackpot betting bets roulette lottery porn xxx adult sexy escort cams replica knockoff "
    "warez crack keygen torrent phish malware spyware spam clickfarm linkfarm seo-links backlinks payday loans doubler giveaway prize claim weightloss"
).split()
LURES = "cheap free buy discount bonus win best online hot fast easy money cash real super mega top 24 4u now deal".split()
SUBJECTS = (
    "news weather library museum university school college garden recipes history science music sport city council travel health photo book code forum "
    "shop bank post map art film theatre hotel train airport hospital market farm bakery bike river mountain ocean planet solar energy green open free "
    "best online easy money windows cash-machine deals winter prizewinner wine sussex link click speed data cloud mobile games chess research physics math language dictionary "
    "jobs home kitchen fashion family pets law tax insurance realty auto motor space bird flower tea coffee road bridge tower radio video stream paper press"
).split()
SECTIONS = (
    "about contact wiki docs guide article story blog news products item questions users search research papers events people missions courses watch "
    "albums results topic help faq download releases issues tree archive tags category gallery store cart world politics business culture opinion dp"
).split()
ENDINGS = "com org net edu gov io de fr es it nl co.uk org.uk jp info dev ch eu example.com example.org example.net".split()
LANGUAGES = "en de fr es".split()


def labelled_urls(blocked: int = 1000, allowed: int = 1500, seed: int = 5) -> tuple[list[str], list[str]]:
    """The labelled table: invented URLs, blocked and allowed. Hosts and paths are made alike but for the words of spam in one of the two."""
    rng = random.Random(seed)
    pick = rng.choice
    letters = lambda low, high: "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(low, high)))
    spoken = lambda: "".join(pick("bcdfghjklmnprstvwz") + pick("aeiou") + pick(["", "", "n", "r", "s", "l", "th"]) for _ in range(rng.randint(1, 4)))
    joint = lambda: pick(["", "", "-"])

    def plain_name() -> str:
        return pick([
            lambda: pick(SUBJECTS), lambda: pick(SUBJECTS) + joint() + pick(SUBJECTS), lambda: spoken(), lambda: spoken(), lambda: spoken() + pick(SUBJECTS), lambda: letters(2, 4),
            lambda: "".join(pick("th er re an in on st nd ti es ble tion ing ed ea or".split()) for _ in range(rng.randint(2, 4))), lambda: letters(4, 9), lambda: pick(SUBJECTS) + str(rng.randint(1, 365)),
        ])()

    def spam_name() -> str:
        word = pick(SPAM)
        return pick([word + joint() + pick(SPAM), pick(LURES) + joint() + word, word + joint() + pick(LURES), pick(LURES) + joint() + word + joint() + pick(LURES), word + joint() + spoken(), "spam-" + pick(["farm", "links", word])])

    def plain_path() -> str:
        number, word = str(rng.randint(1, 9999)), lambda: pick([pick(SUBJECTS), spoken(), pick(SECTIONS)])
        return pick([
            lambda: "", lambda: "", lambda: "/", lambda: f"/{pick(LANGUAGES)}/{number}", lambda: f"/{pick(LANGUAGES)}/{number}{pick(['/', '.html'])}", lambda: f"/{word()}", lambda: f"/{pick(SECTIONS)}/{word()}",
            lambda: f"/20{rng.randint(10, 30)}/0{rng.randint(1, 9)}/{word()}-{word()}", lambda: f"/{pick(SECTIONS)}/{number}/{word()}-{word()}-{word()}", lambda: f"/{letters(1, 2)}/{letters(1, 2)}",
            lambda: f"/{pick(SECTIONS)}/{letters(1, 1).upper()}{rng.randint(0, 99):02}{letters(1, 4).upper()}", lambda: f"/{word()}/{word()}/{word()}{pick(['', '.html', '.php', '/'])}", lambda: f"/{word().capitalize()}_{word()}", lambda: f"/index.{pick(['html', 'php'])}",
        ])()

    def spam_path() -> str:
        return pick([f"/{spam_name()}", f"/{pick(SPAM)}/{pick(LURES)}", f"/{pick(SECTIONS)}/{spam_name()}", f"/{pick(LURES)}-{pick(SPAM)}-{pick(LURES)}.html"])

    def url(name: str, path: str) -> str:
        return f"{pick(['http', 'https'])}://{pick(['', '', 'www.', 'www.', 'm.', 'blog.', 'docs.', 'en.', 'shop.', 'news.'])}{name}.{pick(ENDINGS)}{path}{pick(['', '', '', '?page=2', '#top', '?utm_source=feed'])}"

    bad = [url(spam_name(), plain_path()) if rng.random() < 0.75 else url(spam_name() if rng.random() < 0.5 else plain_name(), spam_path()) for _ in range(blocked)]
    return bad, [url(plain_name(), plain_path()) for _ in range(allowed)]


#: (host, path, verdict)
Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (letters A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, pattern, 2)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), else null. Of equally long rules that fit, one that blocks wins."""
    found = F.lit(None)
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "block")):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(host: str, path: str, sizes: Sequence[int], n_features: int) -> np.ndarray:
    """Hashed character n-grams of host and path, each with marked ends, with repeats."""
    found = []
    for name, part in (("h", host), ("p", path)):
        marked = f"^{part}$"
        found += [zlib.crc32(f"{name}{marked[i : i + n]}".encode()) % n_features for n in sizes for i in range(len(marked) - n + 1)]
    return np.array(found, dtype=np.int64)


def plain_host_and_path(url: str) -> tuple[str, str]:
    rest = url.split("://", 1)[1].split("?", 1)[0].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path


def fit(
    blocked: Sequence[str] | None = None,
    allowed: Sequence[str] | None = None,
    sizes: Sequence[int] = (3, 4, 5),
    n_features: int = 1 << 17,
    steps: int = 600,
    rate: float = 30.0,
    l2: float = 1e-5,
) -> dict:
    """Weights and bias of the regression; without a table, of the labelled one. Each URL's n-gram counts are scaled to length 1."""
    if blocked is None or allowed is None:
        blocked, allowed = labelled_urls()
    urls = [*blocked, *allowed]
    y = np.array([1.0] * len(blocked) + [0.0] * len(allowed))
    parts = [np.unique(grams(*plain_host_and_path(url), sizes, n_features), return_counts=True) for url in urls]
    row = np.repeat(np.arange(len(urls)), [len(at) for at, _ in parts])
    at = np.concatenate([at for at, _ in parts])
    value = np.concatenate([counts / np.sqrt((counts**2).sum()) for _, counts in parts])
    w, b = np.zeros(n_features), 0.0
    for _ in range(steps):
        error = (1 / (1 + np.exp(-(np.bincount(row, w[at] * value, len(urls)) + b))) - y) / len(urls)
        w -= rate * (np.bincount(at, error[row] * value, n_features) + l2 * w)
        b -= rate * 0.1 * error.sum()
    return {"w": w, "b": b, "sizes": tuple(sizes), "n": n_features}


def probability(model: dict, host: str, path: str) -> float:
    """Probability that a URL is to be blocked. A URL without host is judged by the bias alone and is not blocked."""
    if not host:
        return 0.0
    at = grams(host, path, model["sizes"], model["n"])
    found, counts = np.unique(at, return_counts=True)
    norm = np.sqrt((counts**2).sum()) or 1.0
    return float(1 / (1 + np.exp(-(model["w"][found] @ counts / norm + model["b"]))))


def judge(pages: DataFrame, rules: Sequence[Rule], threshold: float = 0.5, url: str = "url") -> DataFrame:
    """Host, path, rule and verdict of every page, with the probability ``p_block`` of the regression.

    The rule decides where one fits, else the regression. Null URLs and URLs without ``://`` have empty host and path, no rule,
    and are allowed. Repeated rows are judged alike; an empty table gives no rows. Only page_id and the URL are read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fit())

    @F.pandas_udf("double")
    def blocked(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = shared.value
        for host, path in parts:
            yield pd.Series([probability(model, h, p) for h, p in zip(host, path, strict=True)], dtype="float64")

    host, path = host_and_path(F.col(url))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("p_block", blocked("host", "path"))
    learned = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", learned).alias("verdict"), "p_block")
