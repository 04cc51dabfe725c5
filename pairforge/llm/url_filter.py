"""URL filter: listed rules first, and a logistic regression on hashed character n-grams of host
and path for the rest, trained when the operator is built from a small labelled table."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules (verdict, host, path) travel inside tasks, so their number is bounded.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MOST_RULES = 100_000

#: The labelled table, of invented hosts: 1 is a page to block.
LABELLED = (
    ("http://pills-for-less.example.com/en/12", 1),
    ("https://www.buy-pills-now.example.net/de/7.html", 1),
    ("http://discount-pharmacy.example.com/shop?id=3", 1),
    ("https://blog.viagra-store.example.net/fr/99", 1),
    ("http://lucky-casino.example.com/en/5/", 1),
    ("https://m.best-casino.example.net/es/31", 1),
    ("http://www.poker-jackpot.example.com/slots/1", 1),
    ("http://bets-and-odds.example.net/en/8.html", 1),
    ("https://sport-bets-online.example.com/fr/4", 1),
    ("https://www.bet-win-cash.example.com/de/16", 1),
    ("http://spam-mailer.example.com/en/44", 1),
    ("https://m.link-farm-spam.example.net/es/2", 1),
    ("http://ads-banner.example.net/en/1?page=2", 1),
    ("https://click.ads-server.example.com/track/77", 1),
    ("http://www.ad-tracker.example.com/fr/3", 1),
    ("https://adult-videos.example.com/en/6", 1),
    ("http://xxx-adult-cams.example.net/de/10", 1),
    ("http://www.hot-adult.example.com/en/21", 1),
    ("https://get-rich-quick.example.net/en/2", 1),
    ("http://free-money-win.example.com/es/9", 1),
    ("https://cheap-loans-fast.example.com/fr/1", 1),
    ("http://replica-watches-cheap.example.net/en/3", 1),
    ("http://news.example.com/en/12", 0),
    ("https://www.library.example.net/de/7.html", 0),
    ("http://city-museum.example.com/en/3", 0),
    ("https://blog.thegarden.example.net/fr/99", 0),
    ("http://www.weather.example.com/en/5/", 0),
    ("https://m.research.example.net/es/31", 0),
    ("http://university.example.com/fr/1?page=2", 0),
    ("https://free-software.example.net/en/8.html", 0),
    ("https://www.open-data.example.com/fr/4", 0),
    ("https://docs.science.example.com/de/16#top", 0),
    ("http://the-history-blog.example.net/en/44", 0),
    ("https://m.cooking.example.net/es/2?utm_source=feed", 0),
    ("http://station-times.example.net/en/1?page=2&ref=x", 0),
    ("https://blog.theatre-notes.example.com/fr/77", 0),
    ("http://www.weather-station.example.net/fr/3", 0),
    ("https://m.handcraft.example.com/en/6", 0),
    ("http://other-languages.example.com/de/10", 0),
    ("https://hearing-and-health.example.net/en/21.html", 0),
    ("https://www.hospital.example.net/en/2", 0),
    ("http://school-district.example.com/es/9", 0),
    ("https://m.maps.example.com/fr/1", 0),
    ("http://blog.music.example.net/en/3", 0),
)

_SLOTS = 1 << 14
_SIZES = (3, 4, 5)


def slots(text: str, side: str) -> list[int]:
    """Slots of the character n-grams of one side of a URL, each once."""
    text = f"^{text}$"
    return sorted({crc32(f"{side}{text[i : i + n]}".encode()) % _SLOTS for n in _SIZES for i in range(len(text) - n + 1)})


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path in Python, for the labelled table; ``host_of`` and ``path_of`` for tables."""
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = rest[: min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])]
    path = rest[len(host) :]
    path = path[: min([len(path), *(path.find(c) for c in "?#" if c in path)])]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_after(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


class Model:
    """Weights of the regression; a URL's log-odds are a mean over each side's n-grams."""

    def __init__(self, table: Iterable[tuple[str, int]] = LABELLED, steps: int = 400, decay: float = 1e-4, rate: float = 30.0):
        table = list(table)
        x = np.zeros((len(table), _SLOTS))
        for row, (url, _) in zip(x, table, strict=True):
            for text, side in zip(split_url(url), "hp", strict=True):
                own = slots(text, side)
                row[own] += 1 / np.sqrt(len(own)) if own else 0
        y = np.array([label for _, label in table], dtype=float)
        used = np.flatnonzero(x.any(axis=0))
        x = x[:, used]
        w, self.bias = np.zeros(len(used)), 0.0
        for _ in range(steps):
            error = y - 1 / (1 + np.exp(-(x @ w + self.bias)))
            w += rate * (x.T @ error / len(y) - decay * w)
            self.bias += error.mean()
        self.weights = np.zeros(_SLOTS)
        self.weights[used] = w

    def part(self, text: str, side: str) -> float:
        own = slots(text, side)
        return float(self.weights[own].sum() / np.sqrt(len(own))) if own else 0.0

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Probability of a page to block. A host met often is read once a batch."""
        by_host = {h: self.part(h, "h") for h in set(hosts)}
        odds = np.array([by_host[h] + self.part(p, "p") for h, p in zip(hosts, paths, strict=True)]) + self.bias
        return 1 / (1 + np.exp(-odds))


@cache
def trained() -> Model:
    return Model()


def _rule_of(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str | None, str | None]:
    """The longest rule that fits, and its verdict."""
    best = (0, None, None)
    while host:
        for start, verdict in rules.get(host, ()):
            if path.startswith(start) and len(host) + len(start) > best[0]:
                best = (len(host) + len(start), host + start, verdict)
        host = host.partition(".")[2]
    return best[1], best[2]


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, model: Model | None = None, threshold: float = 0.5) -> DataFrame:
    """Per row of ``pages`` (page_id, url): ``host``, ``path``, ``rule``, ``verdict`` and
    ``block_score`` of the regression.

    A rule (verdict, host, path) fits its host and all subdomains when the URL's path starts
    with its path; the longest wins and decides. Without a rule the regression does, at
    ``threshold``. A null URL, or one without ``://``, has an empty host and path and is judged
    by the regression alone. One narrow pass; repeated rows each get their verdict."""
    listed: dict[str, list[tuple[str, str]]] = {}
    n = 0
    for verdict, host, path in rules:
        listed.setdefault(host, []).append((path, verdict))
        n += 1
    if n > MOST_RULES:
        raise ValueError(f"{n} rules; at most {MOST_RULES} travel inside tasks")
    model = model or trained()

    @F.arrow_udf("struct<rule:string,verdict:string,block_score:double>")
    def decided(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        hosts, paths = hosts.to_pylist(), paths.to_pylist()
        scores = model.scores(hosts, paths)
        found = [_rule_of(h, p, listed) for h, p in zip(hosts, paths, strict=True)]
        verdicts = [v or ("block" if s >= threshold else "allow") for (_, v), s in zip(found, scores, strict=True)]
        return pa.StructArray.from_arrays(
            [pa.array([r for r, _ in found], pa.string()), pa.array(verdicts, pa.string()), pa.array(scores)],
            ["rule", "verdict", "block_score"],
        )

    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parts.withColumn("d", decided("host", "path")).select("page_id", "host", "path", "d.*")
