"""Verdicts on page addresses: rules first, then words of host and path.

Names in hosts are often several words run together (``cheappills``).  A unigram model
splits each run of letters into the likeliest words (Viterbi); multinomial naive Bayes
then weighs all words of host and path.

The unigrams are counted over the visible text of all pages.  The classes are learned
from all hosts of the table: a host with a word of ``SPAM_WORDS`` is an example of
``block``, any other one of ``allow``, and each host counts a word once, so that no host
outweighs the others by its number of pages.  The model that reaches the tasks holds the
``WORDS`` commonest words and the ``TOKENS`` commonest host and path words, whatever the
size of the table; all counts behind it cover all rows.

A NULL address, or one without ``://``, has an empty host and path, fits no rule and is
allowed.  Repeated rows and rows without ``page_id`` are judged like any other, one row
out for each row in; other columns than ``page_id``, ``url`` and ``html`` are not read.
Long addresses are read whole, in time proportional to their length.  Words that tie
for a place in the model are taken in byte order; splits that tie prefer the longer
last word.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from factfade.session import materialize

WORDS = 50_000
TOKENS = 50_000
LONGEST_WORD = 24
#: Weight of the background distribution in a class, in words, and the parts of it that
#: fall to the spam words in either class: they count where no host has taught them.
SMOOTHING = 20.0
SPAM_IN_BLOCK = 0.2
SPAM_IN_ALLOW = 0.002
#: A spam word or host word counts as at least this share of all words, seen or not.
LISTED_SHARE = 1e-5
NUMBER = "#"
_KEPT_SPLITS = 65_536

ALLOW, BLOCK = "allow", "block"

#: Fixed values: (verdict, host, path from its first slash).
RULES = (
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
)

#: Words that mark unwanted hosts.
SPAM_WORDS = (
    "ads", "adult", "adserver", "bet", "bets", "betting", "bingo", "bonus", "bride", "brides",
    "cam", "cams", "casino", "casinos", "cheap", "cialis", "clickbait", "coupon", "coupons",
    "crack", "cracked", "dating", "diet", "doorway", "download", "erotic", "escort", "escorts",
    "farm", "fake", "free", "gambling", "hack", "hacks", "hookup", "jackpot", "keygen", "linkfarm",
    "loan", "loans", "lottery", "malware", "milf", "nude", "nudes", "payday", "phish", "phishing",
    "pills", "poker", "popup", "porn", "porno", "pornography", "promo", "replica", "roulette",
    "scam", "sex", "sexy", "slots", "spam", "spyware", "steroids", "sweepstakes", "torrent",
    "torrents", "track", "tracker", "tracking", "viagra", "warez", "webcam", "win", "xxx",
)

#: Plain words that names of hosts are often made of.
HOST_WORDS = (
    "academy", "app", "art", "auto", "bank", "best", "blog", "book", "books", "business", "car",
    "center", "city", "cloud", "club", "college", "company", "daily", "data", "design", "dev",
    "digital", "doctor", "express", "family", "fashion", "film", "forum", "game", "games",
    "garden", "global", "green", "group", "guide", "health", "help", "home", "hotel", "house",
    "info", "journal", "kids", "lab", "land", "law", "learn", "library", "life", "line", "live",
    "local", "market", "media", "mobile", "music", "network", "news", "now", "office", "online",
    "park", "photo", "point", "press", "pro", "review", "reviews", "school", "science", "search",
    "server", "service", "services", "shop", "site", "smart", "social", "software", "sport",
    "sports", "star", "state", "store", "studio", "summer", "tech", "the", "time", "times",
    "today", "top", "town", "travel", "university", "video", "water", "weather", "web", "wiki",
    "winter", "women", "work", "world",
)


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(verdict, rule) of the longest rule that fits; NULL if none does."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, suffix, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == suffix) | host.endswith(f".{suffix}")) & path.startswith(prefix)
        this = F.struct(F.lit(verdict).alias("verdict"), F.lit(suffix + prefix).alias("rule"))
        found = F.when(fits, this).otherwise(found)
    return found


def count_words(texts: Column, rows: DataFrame) -> DataFrame:
    """(word, n) over all texts without their markup, in lower case."""
    plain = F.regexp_replace(F.coalesce(texts, F.lit("")), r"<[^>]*>", " ")
    return (
        rows.select(F.explode(F.split(F.lower(plain), r"[^\p{L}]+")).alias("word"))
        .filter((F.col("word") != "") & (F.length("word") <= LONGEST_WORD))
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    )


_TOP_PARTS = 64


def _commonest(rows: DataFrame, n: str, word: str, most: int) -> list[Row]:
    """The ``most`` rows with the highest ``n``.

    Ranked on the executors, in parts by word first; ``most`` rows reach the driver.
    """
    best = [F.desc(n), F.asc(word)]
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(word), F.lit(_TOP_PARTS)))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*best)))
    kept = ranked.filter(F.col("_rank") <= most).drop("_part", "_rank")
    return materialize(kept.orderBy(*best).limit(most), "url-top").collect()


_CHUNK = re.compile(r"[^\W\d_]+|\d+")


@dataclass
class Splitter:
    """The likeliest words of a run of letters, under a unigram model."""

    counts: dict[str, int]
    total: int
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def fit(cls, words: DataFrame, most: int = WORDS) -> "Splitter":
        words = materialize(words, "url-words")
        total = words.agg(F.sum("n")).first()[0] or 0
        top = _commonest(words, "n", "word", most)
        counts = {r["word"]: r["n"] for r in top}
        for word in SPAM_WORDS + HOST_WORDS:
            counts[word] = max(counts.get(word, 0), math.ceil(LISTED_SHARE * total), 1)
        return cls(counts, max(total, sum(counts.values())))

    def __post_init__(self):
        base = math.log(max(self.total, 1))
        self.cost = {w: base - math.log(n) for w, n in self.counts.items()}
        self.longest = max([1, *map(len, self.counts)])
        #: An unknown word has a tenth of the chance for each further letter.
        self.strange = [base + (k - 1) * math.log(10) for k in range(LONGEST_WORD + 1)]

    def __getstate__(self):
        return {"counts": self.counts, "total": self.total, "known": {}}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def split(self, run: str) -> tuple[str, ...]:
        """The words of ``run``; together they are ``run`` again."""
        words = self.known.get(run)
        if words is None:
            words = self._viterbi(run)
            if len(self.known) >= _KEPT_SPLITS:
                self.known.clear()
            if len(run) <= 4 * LONGEST_WORD:
                self.known[run] = words
        return words

    def _viterbi(self, run: str) -> tuple[str, ...]:
        cost, strange = self.cost, self.strange
        best = [0.0]
        last = [0]
        for end in range(1, len(run) + 1):
            low, at = math.inf, end - 1
            for start in range(max(0, end - LONGEST_WORD), end):
                here = best[start] + cost.get(run[start:end], strange[end - start])
                if here < low:
                    low, at = here, start
            best.append(low)
            last.append(at)
        words, end = [], len(run)
        while end:
            words.append(run[last[end] : end])
            end = last[end]
        return tuple(reversed(words))

    def tokens(self, text: str) -> list[str]:
        """Words of a host or path; a number is one token whatever its digits."""
        out: list[str] = []
        for chunk in _CHUNK.findall(text.lower()):
            if chunk[0].isdigit():
                out.append(NUMBER)
            else:
                out += self.split(chunk)
        return out


def host_tokens(pages: DataFrame, splitter: Splitter) -> DataFrame:
    """(host, token, blocked), once each: tokens of a host and of all its paths."""
    spam = frozenset(SPAM_WORDS)

    @F.pandas_udf("struct<tokens:array<string>,blocked:boolean>")
    def words_of(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        rows = []
        for host, path in zip(hosts, paths, strict=True):
            own = splitter.tokens(host)
            rows.append((sorted({*own, *splitter.tokens(path)}), not spam.isdisjoint(own)))
        return pd.DataFrame(rows, columns=["tokens", "blocked"])

    return (
        pages.filter(F.col("host") != "").select("host", "path").distinct()
        .withColumn("found", words_of("host", "path"))
        .select("host", "found.blocked", F.explode("found.tokens").alias("token"))
        .distinct()
    )


@dataclass
class Bayes:
    """Multinomial naive Bayes: log-odds of ``block`` per token, and of the classes."""

    weights: dict[str, float]
    prior: float

    @classmethod
    def fit(cls, tokens: DataFrame, most: int = TOKENS) -> "Bayes":
        """From (host, token, blocked), each once."""
        tokens = materialize(tokens, "url-tokens")
        bad, good = F.sum(F.col("blocked").cast("long")), F.sum((~F.col("blocked")).cast("long"))
        hosts = tokens.groupBy("host").agg(F.max("blocked").alias("blocked"))
        n_bad, n_good = hosts.agg(bad, good).first()
        counted = materialize(
            tokens.groupBy("token").agg(bad.alias("bad"), good.alias("good")), "url-counts"
        )
        all_bad, all_good = counted.agg(F.sum("bad"), F.sum("good")).first()
        top = _commonest(counted.withColumn("n", F.col("bad") + F.col("good")), "n", "token", most)
        seen = {r["token"]: (r["bad"], r["good"]) for r in top}
        return cls(
            {
                token: cls.weight(token, *seen.get(token, (0, 0)), all_bad or 0, all_good or 0)
                for token in {*seen, *SPAM_WORDS}
            },
            math.log(((n_bad or 0) + 1) / ((n_good or 0) + 1)),
        )

    @staticmethod
    def weight(token: str, in_bad: int, in_good: int, all_bad: int, all_good: int) -> float:
        """Log of P(token | block) over P(token | allow), both smoothed by the background."""
        share = (in_bad + in_good) / max(all_bad + all_good, 1)
        listed = (token in SPAM_WORDS) / len(SPAM_WORDS)
        logs = []
        for own, every, part in ((in_bad, all_bad, SPAM_IN_BLOCK), (in_good, all_good, SPAM_IN_ALLOW)):
            background = SMOOTHING * ((1 - part) * share + part * listed)
            logs.append(math.log((own + background) / (every + SMOOTHING)))
        return logs[0] - logs[1]

    def log_odds(self, tokens: Sequence[str]) -> float:
        """Tokens that no host taught say nothing."""
        return self.prior + sum(self.weights.get(t, 0.0) for t in tokens)


@dataclass
class UrlModel:
    splitter: Splitter
    bayes: Bayes

    @classmethod
    def fit(cls, pages: DataFrame, words: DataFrame) -> "UrlModel":
        """From (host, path) of all pages and the unigram counts (word, n)."""
        splitter = Splitter.fit(words)
        return cls(splitter, Bayes.fit(host_tokens(pages, splitter)))

    def spam_score(self, host: Column, path: Column) -> Column:
        """Log-odds that an address is unwanted; 0 and above means ``block``."""
        splitter, bayes = self.splitter, self.bayes

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for hosts, paths in batches:
                yield pd.Series(
                    [
                        bayes.log_odds(splitter.tokens(h) + splitter.tokens(p))
                        for h, p in zip(hosts, paths, strict=True)
                    ],
                    dtype="float64",
                )

        return score(host, path)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page.

    ``score`` is the log-odds of the words, also where a rule decides.
    """
    rows = pages.select("page_id", "url", "html").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    model = UrlModel.fit(rows, count_words(F.col("html"), pages.select("html")))
    found = fitting_rule(F.col("host"), F.col("path"), rules)
    scored = rows.withColumn("score", model.spam_score(F.col("host"), F.col("path")))
    own = F.when((F.col("host") != "") & (F.col("score") >= 0), BLOCK).otherwise(ALLOW)
    return scored.withColumn("found", found).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", own).alias("verdict"), "score",
    )
