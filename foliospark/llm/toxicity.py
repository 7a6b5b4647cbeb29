"""Toxicity: subsequence-kernel support vector machine with Nyström landmarks.

A text is cut into sentences and these into units. A unit is a word; words with no white space
between them ("id*ot") and runs of single letters ("i d i o t") are joined into one unit. The
kernel of two units is the gap-weighted subsequence kernel of ``LENGTH`` letters, normalised:
letters may be skipped at a price of ``DECAY`` each, up to a span of ``SPAN`` letters. The kernel
of two sentences is the sum over their distinct units (a word repeated in a line counts once). It is approximated through landmark units
(Nyström), on which a squared-hinge support vector machine is trained on labelled sentences.
As the kernel has explicit features (one for each letter subsequence), the trained machine
is one table of weights by subsequence, and a sentence's margin is a sum of look-ups.

Units of up to ``SHORT`` letters are worked off in batches of one length; the subsequences of longer ones (base64,
minified code, sequences without blanks) are summed up block by block of positions, in time linear in the letters and
in bounded memory. Units of less than ``LENGTH`` letters have no subsequence of that length, so no features.

A document's score is the sum of its sentences' margins above an offset, less a rate for each word
(long texts meet look-alikes by chance); offset, rate and threshold are fitted on the labelled documents,
each scored by a machine that hasn't seen it (best F1 at the shares that the labels have).

Labels are of documents, and a sentence takes the label of its document. Sentences of clean ones are negative; in toxic ones those with a
unit or beginning of a unit tied to toxic documents are positive at first, then those that the machine itself picks.

The machine is fitted in one task on a sample that ``max_labelled`` (documents of each class) and ``max_clean``
(sentences of the clean ones) bound, both taken in the order of a hash; the driver sees the finished table only.
Landmarks are the units or beginnings of units that are tied to toxic documents (``MIN_Z`` standard errors of the
log-odds, in ``MIN_COUNT`` sentences) and then the most frequent other ones, each one unlike those before it.

Defined results: null and empty texts score 0 and are clean; very long texts and very long units are
scored whole; rows are scored one by one, so repeated rows get equal scores and nulls elsewhere don't matter; ties at
the threshold are toxic; other columns pass unchanged, whatever their names, in documents and in labels; null labels
and labels other than 0 and 1 are left out, of several labels of a document the highest counts; an empty table
gives no rows; without labels of both classes nothing is toxic.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import settle
from . import words

LENGTH, DECAY, SPAN, LANDMARKS, MAX_LABELLED, MAX_CLEAN = 4, 0.7, 8, 128, 1500, 12000
MIN_Z, MIN_COUNT = 3.0, 4
SHORT, POSITIONS, BLOCK = 64, 1 << 14, 1 << 20
U = np.uint64
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True
_LETTER = np.arange(256, dtype=np.int64) % 6 + 26
_LETTER[97:123] = np.arange(26)
for _d, _l in zip(b"0134578", b"oieastb"):
    _LETTER[_d] = _l - 97


def units(texts: list) -> dict:
    """Units of all texts: hash, first and last byte, sentence and text of each; words by text."""
    h, starts, ends, first, joined = words.scan(texts)
    n = len(h)
    doc = words.doc_of(first)
    if not n:
        e = np.zeros(0, np.int64)
        return {"h": h, "from": e, "to": e, "sent": e, "sent_doc": e, "n": np.diff(first), "bytes": joined, "words": (h, starts, ends, e, e)}
    data = np.frombuffer(joined, np.uint8)
    ws, end = np.cumsum(_WS[data], dtype=np.int32), np.cumsum(_END[data], dtype=np.int32)
    a, b = ends[:-1], starts[1:]
    gap_ws, gap_end = ws[b - 1] - ws[a - 1], end[b - 1] - end[a - 1]
    chars = ends - starts - np.maximum(0, (data[starts] >= 0xC0).astype(np.int64) + (data[starts] >= 0xE0))
    single = chars == 1
    glued = (doc[1:] == doc[:-1]) & ((gap_ws == 0) | (single[1:] & single[:-1] & (b - a == 1)))
    head = np.flatnonzero(np.concatenate(([True], ~glued)))
    last = np.concatenate((head[1:], [n])) - 1
    run = np.repeat(np.arange(len(head)), last - head + 1)
    place = (np.arange(n) - head[run]).astype(np.uint64)
    mixed = np.where(place == 0, h, words.mix(h + place * words._GOLD))
    uh = np.add.reduceat(mixed, head)
    cut = np.concatenate(([True], (doc[1:] != doc[:-1]) | ((gap_end > 0) & (gap_ws > 0))))
    sent = (np.cumsum(cut) - 1)[head]
    _, once = np.unique(words.mix(uh + sent.astype(np.uint64) * words._GOLD), return_index=True)
    once.sort()
    head, last, uh, sent = head[once], last[once], uh[once], sent[once]
    return {"h": uh, "sent": sent, "sent_doc": doc[np.flatnonzero(cut)], "n": np.diff(first), "bytes": joined, "words": (h, starts, ends, head, last + 1)}


def spellings(u: dict, at: np.ndarray) -> list[bytes]:
    """The letters of the units at these places."""
    _, starts, ends, head, stop = u["words"]
    j = u["bytes"]
    return [b"".join(j[starts[w] : ends[w]] for w in range(head[k], stop[k])) for k in at.tolist()]


_OFFSETS = np.array([(0, *c) for c in itertools.combinations(range(1, SPAN), LENGTH - 1)])
_WEIGHTS = DECAY ** (_OFFSETS[:, -1] + 1.0)


@lru_cache(SHORT + 1)
def _places(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index tuples of the subsequences of a unit of ``size`` letters, ``SHORT`` at most, and their weights."""
    p = (np.arange(size)[:, None, None] + _OFFSETS).reshape(-1, LENGTH)
    fits = p[:, -1] < size
    return p[fits], np.tile(_WEIGHTS, size)[fits]


def _letters(spelling: bytes) -> np.ndarray:
    """Letter numbers: a-z, look-alike digits as letters, other characters in six groups."""
    if spelling.isascii():
        return _LETTER[np.frombuffer(spelling, np.uint8)]
    cp = np.frombuffer(spelling.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return np.where(cp < 128, _LETTER[np.minimum(cp, 127)], cp % 6 + 26)


def features(letters: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the short units, by length: indices of the units, subsequence codes (units x places) and weights
    that are divided by the unit's norm."""
    by: dict[int, list] = {}
    for k, x in enumerate(letters):
        if LENGTH <= len(x) <= SHORT:
            by.setdefault(len(x), []).append((k, x))
    for size, got in by.items():
        p, weight = _places(size)
        for lo in range(0, len(got), step := max(1, 500_000 // len(p))):
            part = got[lo : lo + step]
            x = np.stack([g[1] for g in part])
            code = x[:, p[:, 0]]
            for c in range(1, LENGTH):
                code = code * 32 + x[:, p[:, c]]
            order = np.argsort(code, axis=1, kind="stable")
            ranked = np.take_along_axis(code, order, 1)
            new = np.ones(ranked.shape, bool)
            new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
            sums = np.add.reduceat(weight[order].ravel(), np.flatnonzero(new.ravel()))
            norm = np.bincount(np.nonzero(new)[0], sums * sums, minlength=len(part))
            yield np.array([g[0] for g in part]), code, weight / np.sqrt(norm)[:, None]


def summed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct subsequence codes of one unit of any length, and its features of norm 1."""
    whole = None
    codes, sums = np.zeros(0, np.int64), np.zeros(0)
    for lo in range(0, max(0, len(x) - LENGTH + 1), POSITIONS):
        i = np.arange(lo, min(lo + POSITIONS, len(x)))
        code, weight = [], []
        for at, w in zip(_OFFSETS, _WEIGHTS):
            j = i[: max(0, len(x) - at[-1] - lo)]
            c = x[j]
            for o in at[1:]:
                c = c * 32 + x[j + o]
            code.append(c)
            weight.append(np.full(len(j), w))
        code, weight = np.concatenate(code), np.concatenate(weight)
        if len(x) <= POSITIONS:
            codes, at = np.unique(code, return_inverse=True)
            sums = np.bincount(at, weight)
        else:
            whole = np.zeros(32**LENGTH) if whole is None else whole
            whole += np.bincount(code, weight, minlength=len(whole))
    if whole is not None:
        codes = np.flatnonzero(whole)
        sums = whole[codes]
    return codes, sums / np.sqrt((sums * sums).sum()) if len(sums) else sums


def _long(letters: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Indices, codes and features of the units that are not short."""
    for k, x in enumerate(letters):
        if len(x) > SHORT:
            yield k, *summed(x)


def score_units(spelled: list[bytes], table: np.ndarray) -> np.ndarray:
    out, letters = np.zeros(len(spelled)), [_letters(s) for s in spelled]
    for at, code, weight in features(letters):
        out[at] = (table[code] * weight).sum(1)
    for k, codes, values in _long(letters):
        out[k] = table[codes] @ values
    return out


_cache: dict[int, list] = {}


def _scores(u: dict, model: dict) -> np.ndarray:
    """Score of each unit; a worker remembers those of the units it has met."""
    if model["id"] not in _cache:
        _cache.clear()
    known = _cache.setdefault(model["id"], [np.zeros(0, np.uint64), np.zeros(0)])
    distinct, at, inverse = np.unique(u["h"], return_index=True, return_inverse=True)
    where = np.searchsorted(known[0], distinct)
    there = where < len(known[0])
    there[there] = known[0][where[there]] == distinct[there]
    out = np.zeros(len(distinct))
    out[there] = known[1][where[there]]
    missing = np.flatnonzero(~there)
    if len(missing):
        out[missing] = score_units(spellings(u, at[missing]), model["table"])
        if len(known[0]) > 1_000_000:
            known[:] = [distinct, out]
        else:
            known[:] = [np.insert(known[0], where[missing], distinct[missing]), np.insert(known[1], where[missing], out[missing])]
    return out[inverse]


def _doc_scores(u: dict, margins: np.ndarray, rate: float) -> np.ndarray:
    total = np.bincount(u["sent_doc"], np.maximum(margins, 0), minlength=len(u["n"]))
    return total - rate * u["n"]


def score_texts(texts: list, model: dict) -> np.ndarray:
    """Scores of texts; toxic from the model's threshold on."""
    out = []
    for (block,) in _cut(texts):
        u = units(block)
        if len(u["h"]):
            margins = np.bincount(u["sent"], _scores(u, model), minlength=len(u["sent_doc"])) + model["bias"]
            out.append(_doc_scores(u, margins, model["rate"]))
        else:
            out.append(np.zeros(len(block)))
    return np.concatenate(out) if out else np.zeros(0)


def _cut(texts: list) -> Iterator[tuple[list]]:
    lo, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= BLOCK:
            yield (texts[lo : k + 1],)
            lo, size = k + 1, 0
    if lo < len(texts):
        yield (texts[lo:],)


def _svm(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Squared-hinge machine by Newton steps in the primal; the last weight is the bias."""
    x = np.hstack((x, np.ones((len(x), 1), x.dtype)))
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[-1] = 1e-6
    for _ in range(30):
        active = y * (x @ w) < 1
        xa = x[active] * np.sqrt(c[active, None]).astype(x.dtype)
        new = np.linalg.solve((xa.T @ xa).astype(np.float64) + np.diag(reg), xa.T.astype(np.float64) @ (y[active] * np.sqrt(c[active])))
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _fit(u: dict, docs: int, toxic: np.ndarray, landmarks: int, max_clean: int) -> tuple[np.ndarray, float] | None:
    """Table and bias of the machine for the units of ``docs`` texts, or None without both classes."""
    if not toxic.any() or toxic.all() or not len(u["h"]):
        return None
    distinct, at, inverse = np.unique(u["h"], return_index=True, return_inverse=True)
    n_sent, s_toxic = len(u["sent_doc"]), toxic[u["sent_doc"]]
    edges = np.flatnonzero(np.diff(u["sent"], prepend=-1))
    same = np.add.reduceat(words.mix(u["h"] + U(1)), edges)
    order = np.lexsort((s_toxic[u["sent"][edges]], same))
    fresh = np.zeros(n_sent, bool)  # of equal sentences one counts, a clean one if there is any: documents have copies
    fresh[u["sent"][edges][order[np.concatenate(([True], np.diff(same[order]) != 0))]]] = True
    spelled = spellings(u, at)
    cuts = (None, 5, 6, 7)
    of = np.zeros((len(spelled), len(cuts)), U)
    for k, x in enumerate(spelled):
        x = x.decode("utf-8", "replace")
        for c, size in enumerate(cuts):
            if size is None or len(x) > size:
                of[k, c] = xxhash.xxh3_64_intdigest(x[:size]) | 1
    stems, source, flat_of = np.unique(of.ravel(), return_index=True, return_inverse=True)
    flat_of = flat_of.reshape(of.shape)[inverse]
    has = of[inverse] > 0
    del of

    def stem(k: int) -> str:
        return spelled[source[k] // len(cuts)].decode("utf-8", "replace")[: cuts[source[k] % len(cuts)]]

    a, b = np.zeros(len(stems), np.int64), np.zeros(len(stems), np.int64)
    for c in range(len(cuts)):
        use = has[:, c] & fresh[u["sent"]]
        pair = np.unique(flat_of[use, c] * n_sent + u["sent"][use])
        own, is_toxic = pair // n_sent, s_toxic[pair % n_sent]
        a += np.bincount(own[is_toxic], minlength=len(stems))
        b += np.bincount(own[~is_toxic], minlength=len(stems))
    na, nb = (fresh & s_toxic).sum(), (fresh & ~s_toxic).sum()
    odds = np.log((a + 0.5) / (na + 1)) - np.log((b + 0.5) / (nb + 1))
    z = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    chosen: list[tuple[np.ndarray, np.ndarray]] = []
    meets: dict[int, list] = {}

    def take(order: np.ndarray, most: int) -> None:
        for k in order.tolist():
            if len(chosen) >= most:
                return
            codes, values = summed(_letters(stem(k).encode()))
            near = np.zeros(len(chosen) + 1)
            for c, v in zip(codes.tolist(), values.tolist()):
                for row, x in meets.get(c, ()):
                    near[row] += v * x
            if len(codes) and near.max() < 0.8:
                for c, v in zip(codes.tolist(), values.tolist()):
                    meets.setdefault(c, []).append((len(chosen), v))
                chosen.append((codes, values))

    z[stems == 0] = 0
    strong = np.flatnonzero((z > MIN_Z) & (a >= MIN_COUNT))
    take(strong[np.lexsort((stems[strong], -z[strong]))], landmarks * 3 // 4)
    common = np.flatnonzero((z < 0.5) & (stems > 0))
    take(common[np.lexsort((stems[common], -b[common]))], landmarks)
    if not chosen:
        return None
    codes = np.unique(np.concatenate([c for c, _ in chosen]))
    basis = np.zeros((len(chosen), len(codes) + 1))
    for row, (c, v) in enumerate(chosen):
        basis[row, np.searchsorted(codes, c) + 1] = v
    place_of = np.zeros(32**LENGTH, np.int32)
    place_of[codes] = np.arange(1, len(codes) + 1)
    value, vector = np.linalg.eigh(basis @ basis.T)
    keep = value > 1e-8
    whiten = vector[:, keep] / np.sqrt(value[keep])
    flat = np.ascontiguousarray((whiten.T @ basis).T.astype(np.float32))
    clean = np.flatnonzero(fresh & ~s_toxic)
    kept = np.sort(np.concatenate((np.flatnonzero(fresh & s_toxic), clean[np.argsort(words.mix(clean.astype(np.uint64)))[:max_clean]])))
    place = np.full(n_sent, -1)
    place[kept] = np.arange(len(kept))
    inside = np.flatnonzero(place[u["sent"]] >= 0)
    need, needed = np.unique(inverse[inside], return_inverse=True)
    mapped = np.zeros((len(need), flat.shape[1]), np.float32)
    letters = [_letters(spelled[k]) for k in need.tolist()]
    for got, code, weight in features(letters):
        step = max(1, 60_000 // code.shape[1])
        for lo in range(0, len(got), step):
            mapped[got[lo : lo + step]] = np.einsum("upd,up->ud", flat[place_of[code[lo : lo + step]]], weight[lo : lo + step].astype(np.float32), optimize=True)
    for k, own, values in _long(letters):
        hit = place_of[own] > 0
        mapped[k] = values[hit].astype(np.float32) @ flat[place_of[own[hit]]]
    del letters
    sums = np.zeros((len(kept), mapped.shape[1]), np.float32)
    edges = np.flatnonzero(np.diff(u["sent"][inside], prepend=-1))
    where = place[u["sent"][inside][edges]]
    for lo in range(0, len(edges), 2000):
        a, b = edges[lo], edges[lo + 2000] if lo + 2000 < len(edges) else len(needed)
        sums[where[lo : lo + 2000]] = np.add.reduceat(mapped[needed[a:b]], edges[lo : lo + 2000] - a, axis=0)
    k_toxic, k_doc = s_toxic[kept], u["sent_doc"][kept]
    hot = np.zeros(len(stems), bool)
    hot[strong] = True
    tied = (hot[flat_of] & has).any(1)
    del flat_of, has
    positive = k_toxic & (np.bincount(u["sent"], tied, minlength=n_sent)[kept] > 0)
    w = None
    for _ in range(3):
        if not positive.any():
            return None
        use = positive | ~k_toxic
        w = _svm(sums[use], np.where(positive[use], 1.0, -1.0))
        margin = sums @ w[:-1] + w[-1]
        best = np.full(docs, -np.inf)
        np.maximum.at(best, k_doc, margin)
        positive = k_toxic & ((margin > 0) | ((margin == best[k_doc]) & (margin > -0.5)))
    table = (flat.astype(np.float64) @ w[:-1]).astype(np.float32)[place_of]
    return table, float(w[-1])


def _families(texts: list, toxic: np.ndarray) -> np.ndarray:
    """One text of each family of copies: texts of one label of whose sentences two least hashes are equal."""
    u = units(texts)
    if not len(u["h"]):
        return np.arange(len(texts))
    edges = np.flatnonzero(np.diff(u["sent"], prepend=-1))
    same, owner, key = np.add.reduceat(words.mix(u["h"] + U(1)), edges), u["sent_doc"][u["sent"][edges]], toxic.astype(U)
    for k in (1, 2):
        least = np.full(len(texts), 2**64 - 1, U)
        np.minimum.at(least, owner, words.mix(same * U(2 * k + 1) + U(k)))
        key = words.mix(key ^ least)
    bare = np.bincount(owner, minlength=len(texts)) == 0
    key[bare] = words.mix(np.flatnonzero(bare).astype(U))
    return np.sort(np.unique(key, return_index=True)[1])


def _margins(u: dict, table: np.ndarray, bias: float) -> np.ndarray:
    """Margin of each sentence."""
    _, at, inverse = np.unique(u["h"], return_index=True, return_inverse=True)
    return np.bincount(u["sent"], score_units(spellings(u, at), table)[inverse], minlength=len(u["sent_doc"])) + bias


def _cutoff(sent_doc: np.ndarray, margin: np.ndarray, n: np.ndarray, toxic: np.ndarray, clean_weight: float) -> tuple[float, float, float]:
    """Offset, rate and threshold of the best F1 over documents; the threshold is infinite if none helps."""
    best, found = -1.0, (0.0, 0.0, np.inf)
    for offset in (0.0, 0.5, 1.0, 1.5, 2.0):
        total = np.bincount(sent_doc, np.maximum(margin - offset, 0), minlength=len(n))
        chance = total[~toxic].sum() / max(1, n[~toxic].sum())
        for rate in chance * np.array([0, 0.5, 1, 2, 4]):
            s = total - rate * n
            order = np.argsort(-s, kind="stable")
            hit = np.cumsum(toxic[order])
            f = 2 * hit / (hit + clean_weight * np.cumsum(~toxic[order]) + toxic.sum())
            ends = np.flatnonzero(np.append(s[order][:-1] != s[order][1:], True) & (s[order] > 0))
            if len(ends):
                k = ends[np.argmax(f[ends])]
                below = max(s[order[k + 1]], 0.0) if k + 1 < len(s) else 0.0
                if f[k] > best:
                    best, found = f[k], (offset, rate, (s[order[k]] + below) / 2)
    return found


#: The model without labels of both classes: no text is toxic.
_NOTHING = {"id": 0, "table": np.zeros(32**LENGTH, np.float32), "bias": -1.0, "rate": 0.0, "threshold": np.inf}


def train(texts: list, toxic: np.ndarray, landmarks: int = LANDMARKS, max_clean: int = MAX_CLEAN, clean_weight: float = 1.0) -> dict:
    """Fit on texts and their 0/1 labels. ``clean_weight``: clean documents for each one in the sample, over
    toxic ones for each one. The machine is fitted on all texts; offset, rate and threshold on margins that
    machines of one half give to the other half. Of copies one is used."""
    toxic = np.asarray(toxic).astype(bool)
    one = _families(texts, toxic)
    texts, toxic = [texts[k] for k in one], toxic[one]
    fitted = _fit(units(texts), len(texts), toxic, landmarks, max_clean)
    if fitted is None:
        return dict(_NOTHING)
    half = np.zeros(len(texts), bool)
    for c in (True, False):
        half[np.flatnonzero(toxic == c)[::2]] = True
    docs, margins, sizes = [], [], np.zeros(len(texts), np.int64)
    for side in (half, ~half):
        inside, outside = np.flatnonzero(side), np.flatnonzero(~side)
        part = _fit(units([texts[k] for k in inside]), len(inside), toxic[inside], landmarks, max_clean // 2) or fitted
        u = units([texts[k] for k in outside])
        sizes[outside] = u["n"]
        if len(u["h"]):
            docs.append(outside[u["sent_doc"]])
            margins.append(_margins(u, *part))
    if not docs:
        docs, margins = [np.zeros(0, np.int64)], [np.zeros(0)]
    offset, rate, threshold = _cutoff(np.concatenate(docs), np.concatenate(margins), sizes, toxic, clean_weight)
    table, bias = fitted
    name = int(np.frombuffer(table.tobytes(), np.uint32).astype(np.uint64).dot(np.arange(1, len(table) + 1, dtype=np.uint64)))
    return {"id": name, "table": table, "bias": bias - offset, "rate": float(rate), "threshold": float(threshold)}


_MODEL = "id long, table binary, bias double, rate double, threshold double"


def trained(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_clean: int = MAX_CLEAN, landmarks: int = LANDMARKS) -> dict:
    """The model of ``train``, fitted in one task on at most ``max_labelled`` documents of each class."""
    own = settle(labels, ["doc_id", "toxic"]).select("doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = dict(own.groupBy("toxic").count().collect())
    over = [size.get(c, 0) / max(1, min(max_labelled, size.get(c, 0))) for c in (0, 1)]
    clean_weight = over[0] / max(over[1], 1.0)
    of = [own.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled) for c in (0, 1)]
    got = settle(docs, ["doc_id", "text"]).select("doc_id", "text").join(F.broadcast(of[0].unionByName(of[1])), "doc_id")  # at most 2 x max_labelled ids
    got = got.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        m = train([x if isinstance(x, str) else None for x in rows["text"]], rows["toxic"].to_numpy(), landmarks, max_clean, clean_weight)
        words.give_back()
        return pd.DataFrame({"id": [m["id"] % (1 << 63)], "table": [m["table"].tobytes()], "bias": [m["bias"]], "rate": [m["rate"]], "threshold": [float(m["threshold"])]})

    row = got.groupBy(F.lit(0).alias("one")).applyInPandas(fit, _MODEL).first()
    return row.asDict() | {"table": np.frombuffer(row["table"], np.float32)} if row else dict(_NOTHING)


def classify(docs: DataFrame, model: dict, toxic: bool) -> DataFrame:
    """The toxic or the clean rows of ``docs``, as they are."""
    at = docs.columns.index("text")
    bc = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = bc.value
        for whole in batches:
            for b in words.slices(whole):
                s = score_texts(b.column(at).to_pylist(), m)
                yield b.filter(pa.array((s >= m["threshold"]) == toxic))
        words.give_back()

    return docs.mapInArrow(run, docs.schema)


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of the toxic documents."""
    bc = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = bc.value
        for b in (x for whole in batches for x in words.slices(whole)):
            s = score_texts(b.column(1).to_pylist(), m)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"]).filter(pa.array(s >= m["threshold"]))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents: doc_id, score."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = settle(docs, ["doc_id", "text"])
    return scores(docs, trained(docs, labels))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the toxic ones."""
    settled = settle(docs, ["doc_id", "text"])
    model = trained(settled, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(settled, model, toxic=False).toDF(*docs.columns)
