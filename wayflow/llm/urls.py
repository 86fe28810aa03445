"""URL filter: allow and block rules, and a logistic regression on hashed character n-grams for the rest.

The model is trained on a small labelled table of URLs (``LABELLED`` or the caller's). Its features are the hashed n-grams of
host and path, kept apart; leading ``www.`` and the like and digits say nothing of a site and are folded.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the model like any other.
A rule is ``host/path prefix``; it fits its host and all subdomains; the longest that fits wins. Repeated rows are each judged. Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import Batches, map_batches

# The rules of the registered query, (verdict, rule).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

# Words that are common in the names of unwanted and of ordinary sites, from general knowledge of the web.
UNWANTED = """casino poker roulette jackpot slots blackjack baccarat betting bookmaker wager gamble lottery sweepstakes viagra cialis levitra pharmacy pills
    steroids porn xxx nude naked erotic hentai escort webcam adult hookup sexdating fetish milf warez keygen cracked serials torrent
    malware trojan ransomware phishing spyware botnet exploit hacked carding spam scam clickbait popunder popup banner adserver adclick adnetwork tracker tracking
    pixel affiliate payday loan credit replica rolex handbags weightloss slimming miracle botox enlargement giveaway freebies prize winner
    bonus promo cheapest discount doorway linkfarm backlinks followers proxies""".split()
ORDINARY = """library museum university college school institute hospital council parliament ministry court police station airport harbour railway
    bridge river mountain forest garden meadow village market kitchen bakery restaurant hotel theatre cinema orchestra opera gallery
    archive journal gazette herald tribune newspaper magazine encyclopedia dictionary atlas weather climate ocean geology botany zoology biology
    chemistry physics mathematics statistics astronomy telescope engineering robotics electronics computing software compiler database network kernel
    browser editor manual documentation tutorial forum community foundation society union federation church cathedral heritage history archaeology
    philosophy literature poetry novel translation language grammar teacher student classroom lecture scholarship laboratory research
    science medicine nursing dentist clinic surgery nutrition recipes cooking cycling running football tennis hockey chess sailing
    climbing hiking camping fishing photography painting sculpture pottery knitting carpentry architecture furniture building insurance banking
    accounting law justice election democracy government embassy travel tourism transport traffic highway energy solar water recycling
    wildlife birds horses dogs farming agriculture vineyard brewery coffee flowers children family parents toys music guitar piano radio
    television podcast calendar maps postal telephone satellite aviation space""".split()
_TLDS = "com org net edu gov info io de fr es uk it nl pl se ch eu ca".split()
_BESIDE = "best my the new top online world city north daily open first 24 7 2020 pro".split()
_PATHS = ("", "/", "/index.html", "/about", "/2019/05/12/summer", "/item-12", "/a/b.php", "/docs/guide/chapter3.html", "/~user/notes.txt", "/products/list", "/contact/", "/img/logo.png")


def labelled_table() -> tuple[tuple[str, int], ...]:
    """The small labelled table of urls: each word alone, beside a neutral word, and beside a word of its list or an ordinary one, under
    domains and paths that both kinds share; and unwanted words in the path of an ordinary host.
    """
    out = []
    for y, words in ((1, UNWANTED), (0, ORDINARY)):
        for k, word in enumerate(words):
            other, far, beside = words[(7 * k + 3) % len(words)], ORDINARY[(11 * k + 5) % len(ORDINARY)], _BESIDE[k % len(_BESIDE)]
            names = (word, f"{beside}-{word}" if k % 2 else f"{word}{beside}", f"{word}-{other}" if k % 3 else f"{word}{other}", f"{far}-{word}" if k % 2 else f"{word}.{far}")
            for j, name in enumerate(names):
                sub = ("", "www.", "", "m.", "blog.")[(k + j) % 5]
                out.append((f"https://{sub}{name}.{_TLDS[(5 * k + j) % len(_TLDS)]}{_PATHS[(k + 3 * j) % len(_PATHS)]}", y))
            path = f"/{beside}/{word}-{other}.html" if k % 2 else f"/{word}/{beside}"
            out.append((f"http://{far}.{_TLDS[k % len(_TLDS)]}{path}", y))
    return tuple(out)


LABELLED = labelled_table()

FEATURES, SIZES = 1 << 16, (3, 4, 5)
_FOLD = re.compile(r"^(www|m|blog)\.")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _features(host: str, path: str) -> np.ndarray:
    out = set()
    for kind, text in (("h", _FOLD.sub("", host)), ("p", re.sub(r"\d+", "0", path))):
        padded = f"^{text}$"
        for n in SIZES:
            for i in range(len(padded) - n + 1):
                out.add(zlib.crc32(f"{kind}{padded[i : i + n]}".encode()) % FEATURES)
    return np.fromiter(out, np.int64, len(out))


def _split(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.lower(), re.match(r"[^?#]*", rest[len(host) :])[0]


@functools.cache
def learn(labelled: tuple[tuple[str, int], ...] = LABELLED, rounds: int = 1500, step: float = 100.0, decay: float = 1e-5, share: float = 0.2) -> np.ndarray:
    """Weights (the intercept last) by gradient steps on the small table, kept for the next call.

    The table holds either kind as often as its author listed it; ``share`` is that of blocked urls to reckon with, and sets the intercept.
    """
    rows = [_features(*_split(u)) for u, _ in labelled]
    sizes = np.array([len(r) for r in rows])
    at, row = np.concatenate([np.zeros(0, np.int64), *rows]), np.repeat(np.arange(len(rows)), sizes)
    scale = 1 / np.sqrt(np.maximum(sizes, 1))
    y = np.array([k for _, k in labelled], float)
    w, b = np.zeros(FEATURES), 0.0
    for _ in range(rounds):
        z = np.bincount(row, w[at], len(rows)) * scale + b
        e = 1 / (1 + np.exp(-z)) - y
        w -= step * (np.bincount(at, (e * scale)[row], FEATURES) / len(y) + decay * w)
        b -= e.mean()
    here = np.clip(y.mean(), 0.01, 0.99)
    return np.append(w, b + np.log(share / (1 - share)) - np.log(here / (1 - here)))


def judge(pages: DataFrame, weights: np.ndarray, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, score (of the model, 0 to 1), verdict (the rule's, else block where score >= 0.5)."""
    host, path = parts(F.col(url_col))
    cut = pages.select(id_col, host.alias("host"), path.alias("path"))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            scores = []
            for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                f = _features(h, p)
                z = weights[f].sum() / np.sqrt(max(1, len(f))) + weights[-1]
                scores.append(float(1 / (1 + np.exp(-z))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    scored = map_batches(cut, run, T.StructType([*cut.schema.fields, T.StructField("score", T.DoubleType())]))
    ruled = scored.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    for said, rule in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(said)).otherwise(verdict)
    return ruled.withColumn("verdict", verdict).select(id_col, "host", "path", "rule", "verdict", "score")
