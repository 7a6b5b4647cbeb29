"""URL filters: gradient-boosted trees on lexical features, trained from labelled URLs.

Features of a URL: its length and those of host, path and query; path depth; host labels; digit ratio
and the longest run of digits; hyphens and digits of the host and its longest label; letters' share; entropy of its
characters; parameters; percent signs; whether it is https, has a fragment, a port, user info or an IP host;
length of the top-level domain; and suffix statistics: of the public suffix and of the registered domain, how
often labelled URLs have it (share of them) and the log-odds of the bad ones among these, smoothed. What a site's own
labelled URLs add is left out of the statistics that they are trained with. No feature looks at words of a list, so URLs are judged from hosts that
no label names.

Labels come from a table (url, bad): at most ``MAX_LABELLED`` distinct URLs of each class, in the order of a hash, train the trees
(logistic loss, histogram splits). Without one, the seeded fixture of ``url_labels`` is used, which
holds none of the scored URLs. Scoring is one pass over all rows, without a join or a shuffle.

Defined results: a null or empty URL has score 1 and isn't kept; whatever can't be parsed has empty
parts; URLs of any length are scored whole; repeated URLs get equal scores; a score of ``CUT`` isn't kept; null labels are left
out, of several labels of a URL the highest counts; other columns don't matter, whatever their names; with labels of one
class only the score is that class; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import settle
from . import words
from .url_labels import labelled_urls

MAX_LABELLED, TREES, DEPTH, RATE, BINS, CUT = 20_000, 60, 3, 0.2, 32, 0.5
FEATURES = [
    "length", "host", "path", "query", "depth", "labels", "digit_ratio", "digit_run", "hyphens", "letters", "entropy", "params", "percents", "https", "fragment", "port", "ip", "tld",
    "host_digits", "longest_label", "user", "suffix_share", "suffix_odds", "domain_share", "domain_odds",
]
#: Public suffixes of two labels; all others are the last label.
TWO_LABELS = {f"{a}.{b}" for a in ("co", "com", "org", "net", "ac", "gov", "edu") for b in ("uk", "au", "nz", "za", "jp", "kr", "in", "br", "mx", "tr", "cn", "tw", "sg", "hk", "il", "ar", "id", "th")}
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def host_of(url: Column) -> Column:
    """Lower-cased host, empty if there is none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(rest)


def suffix_of(host: str) -> tuple[str, str]:
    """Public suffix and registered domain of a host."""
    parts = host.split(".")
    n = 2 if ".".join(parts[-2:]) in TWO_LABELS else 1
    return ".".join(parts[-n:]), ".".join(parts[-n - 1 :])


def _site(host: str) -> str:
    """A host without the label of a service before it."""
    first, _, rest = host.partition(".")
    return rest if first in ("www", "m", "mobile", "blog", "shop") and "." in rest else host


def suffix_table(hosts: Sequence, bad: np.ndarray) -> dict:
    """Counts (URLs, bad ones) of suffixes and domains of labelled URLs."""
    table: dict = {"all": np.array([len(hosts), int(np.sum(bad))])}
    for h, y in zip(hosts, bad):
        for kind, name in zip("sd", suffix_of(h or "")):
            table.setdefault((kind, name), np.zeros(2, np.int64))
            table[kind, name] += (1, int(y))
    return table


def suffix_stats(hosts: Sequence, table: dict, bad: np.ndarray | None = None) -> np.ndarray:
    """Share and log-odds of suffix and domain. ``bad``: labels of these URLs, that are in the table; what it has from
    the URLs of the same site is left out then, as for a site that no label names."""
    (n, total), own = table["all"], {}
    for h, y in zip(hosts, bad if bad is not None else ()):
        own.setdefault(_site(h), np.zeros(2, np.int64))
        own[_site(h)] += (1, int(y))
    rate, out = (total + 1) / (n + 2), np.zeros((len(hosts), 4))
    for k, h in enumerate(hosts):
        for c, key in enumerate(zip("sd", suffix_of(h or ""))):
            u, b = np.array(table.get(key, (0, 0))) - own.get(_site(h or ""), 0)
            p = (b + 4 * rate) / (u + 4)
            out[k, 2 * c : 2 * c + 2] = u / max(1, n), np.log(p / (1 - p)) - np.log(rate / (1 - rate))
    return out


def _count(data: np.ndarray, owner: np.ndarray, mask: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner[mask], minlength=n).astype(np.float64)


def features(urls: Sequence, hosts: Sequence, stats: np.ndarray) -> np.ndarray:
    """Feature matrix of some URLs; ``stats`` has the suffix statistics."""
    raw = [(u or "").encode("utf-8", "replace") for u in urls]
    n, size = len(raw), np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    owner = np.repeat(np.arange(n), size)
    at = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)

    def first(mask: np.ndarray, default: np.ndarray) -> np.ndarray:
        out = default.copy()
        hit = np.flatnonzero(mask)[::-1]
        out[owner[hit]] = at[hit]
        return out

    host = np.array([len((h or "").encode()) for h in hosts], np.int64)
    fragment = first(data == 35, size)
    head = at < fragment[owner] if n else np.zeros(0, bool)
    query = np.minimum(first((data == 63) & head, fragment), fragment)
    colon = first((data == 58) & head, np.full(n, -3))
    rest = head & (at > colon[owner] + 2) if n else head
    start = np.where(host > 0, np.minimum(first(rest & ((data == 47) | (data == 63)), fragment), fragment), 0)  # after user info, host and port
    in_host = (at < start[owner]) & (at > colon[owner]) if n else head
    in_path = (at >= start[owner]) & (at < query[owner]) if n else head
    in_query = (at > query[owner]) & head if n else head
    digit = _DIGIT[data]
    run = np.zeros(n)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (digit.view(np.int8)), [0]))))
    if len(edges):
        np.maximum.at(run, owner[edges[0::2]], edges[1::2] - edges[0::2])
    hist = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256) if len(data) else np.zeros((n, 256))
    share = hist / np.maximum(size, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    text_hosts = [h or "" for h in hosts]
    cols = [
        size, host, query - np.minimum(start, query), fragment - query, _count(data, owner, in_path & (data == 47), n), _count(data, owner, in_host & (data == 46), n) + (host > 0),
        _count(data, owner, digit, n) / np.maximum(size, 1), run, _count(data, owner, in_host & (data == 45), n), _count(data, owner, _ALPHA[data], n) / np.maximum(size, 1), entropy,
        _count(data, owner, in_query & (data == 61), n), _count(data, owner, data == 37, n), np.array([r[:8].lower() == b"https://" for r in raw]), fragment < size,
        np.array([b":" in r.split(b"//", 1)[-1].split(b"/", 1)[0] for r in raw]), np.array([h.replace(".", "").isdigit() for h in text_hosts]), np.array([len(h.rsplit(".", 1)[-1]) for h in text_hosts]),
        np.array([sum(c.isdigit() for c in h) for h in text_hosts]), np.array([max(map(len, h.split("."))) for h in text_hosts]), np.bincount(owner[in_host & (data == 64)], minlength=n) > 0,
    ]
    return np.column_stack([*(np.asarray(c, np.float64) for c in cols), np.asarray(stats, np.float64).reshape(n, 4)])


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> dict:
    """Boosted trees for logistic loss: each is ``2^depth - 1`` (feature, cut) pairs and leaf values."""
    y = np.asarray(y, np.float64)
    if not len(y) or y.min() == y.max():
        return {"base": -20.0 if not len(y) or y.max() == 0 else 20.0, "trees": []}
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    code = np.column_stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T)])
    base = float(np.log(y.mean() / (1 - y.mean())))
    f, out = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node, splits = np.zeros(len(y), np.int64), []
        for d in range(depth):
            width = 1 << d
            gain = np.full(width, 0.0)
            pick = [(0, np.inf)] * width
            code_at = np.zeros((width, 2), np.int64)
            for c in range(x.shape[1]):
                bins = len(cuts[c]) + 1
                if bins < 2:
                    continue
                key = node * bins + code[:, c]
                sg = np.bincount(key, g, minlength=width * bins).reshape(width, bins)
                sh = np.bincount(key, h, minlength=width * bins).reshape(width, bins)
                lg, lh = np.cumsum(sg, 1)[:, :-1], np.cumsum(sh, 1)[:, :-1]
                tg, th = sg.sum(1)[:, None], sh.sum(1)[:, None]
                score = lg**2 / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - tg**2 / (th + 1)
                best = score.argmax(1)
                for k in range(width):
                    if score[k, best[k]] > gain[k] + 1e-9:
                        gain[k], pick[k], code_at[k] = score[k, best[k]], (c, float(cuts[c][best[k]])), (c, best[k])
            right = (gain[node] > 0) & (code[np.arange(len(y)), code_at[node, 0]] > code_at[node, 1])
            splits.append(pick)
            node = 2 * node + right
        leaf = np.bincount(node, g, minlength=1 << depth) / (np.bincount(node, h, minlength=1 << depth) + 1) * rate
        f += leaf[node]
        out.append((splits, leaf))
    return {"base": base, "trees": out}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of being bad."""
    f = np.full(len(x), model["base"])
    for splits, leaf in model["trees"]:
        node = np.zeros(len(x), np.int64)
        for level in splits:
            c = np.array([s[0] for s in level])[node]
            node = 2 * node + (x[np.arange(len(x)), c] > np.array([s[1] for s in level])[node])
        f += leaf[node]
    return 1 / (1 + np.exp(-f))


def model_of(labels: Sequence[tuple]) -> dict:
    """The trees and the suffix table of labelled URLs: (url, host, bad)."""
    hosts, y = [r[1] for r in labels], np.array([r[2] for r in labels], np.int64)
    table = suffix_table(hosts, y)
    return {"suffix": table, **train(features([r[0] for r in labels], hosts, suffix_stats(hosts, table, y)), y)}


def scores_of(urls: Sequence, hosts: Sequence, model: dict) -> np.ndarray:
    """Probability of being bad, to 6 digits; 1 for null and empty URLs."""
    p = np.round(predict(model, features(urls, hosts, suffix_stats(hosts, model["suffix"]))), 6)
    p[[not u for u in urls]] = 1.0
    return p


def learned(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict:
    """The model of a table of labelled URLs."""
    own = settle(labels, ["url", "bad"]).filter("bad in (0, 1) and url <> ''").groupBy("url").agg(F.max("bad").alias("bad")).select("url", host_of(F.col("url")).alias("host"), "bad")
    return model_of([tuple(r) for c in (0, 1) for r in own.filter(F.col("bad") == c).orderBy(F.xxhash64("url"), "url").limit(max_labelled).collect()])


def scored(pages: DataFrame, labels: DataFrame | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(page_id, url, score, keep) for each page; ``labels``: (url, bad 0/1), else the fixture."""
    spark = pages.sparkSession
    pages = settle(pages, ["page_id", "url"]).select("page_id", "url")
    labels = spark.createDataFrame(labelled_urls(), "url string, bad int") if labels is None else labels
    shared = spark.sparkContext.broadcast(learned(labels, max_labelled))

    def run(batches):
        for b in (x for whole in batches for x in words.slices(whole, 4096)):
            p = scores_of(b.column(1).to_pylist(), b.column(2).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array(p < CUT)], names=["page_id", "url", "score", "keep"])

    return pages.select("page_id", "url", host_of(F.col("url")).alias("host")).mapInArrow(run, "page_id long, url string, score double, keep boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision for every page's URL."""
    return scored(spark.read.parquet(f"{sf_dir}/pages.parquet"))
