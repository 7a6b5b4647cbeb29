"""Labelled URLs to train URL filters on where no table of them is given: a seeded fixture.

``labelled_urls`` draws hosts and paths of both classes from the word lists and shapes below. Both classes use
the same sub-domains, platforms and many of the same paths and suffixes, and good hosts have hyphens and digits too, only
less often. None of its URLs is taken from the tables that are scored.
"""

from __future__ import annotations

import random

BAD_WORDS = "casino poker slot jackpot bonus bet prize lotto loan credit cash debt pills pharma diet slim cheap replica outlet deal promo coupon click track popup banner traffic seo rank farm spam cam dating hot escort adult crypto token airdrop invest profit crack keygen torrent stream unlock".split()
GOOD_WORDS = "library garden river museum school bakery orchard theatre village archive weather science history kitchen travel market harbour mountain forest music railway council hospital university journal gallery studio workshop cycling chess robot bridge letters atlas almanac observatory gazette herald parish".split()
SYLLABLES = "ba ke lin mo nu pra sto vi zen dor fal gim re ta the or in tion st wh".split()
PLATFORMS = ["example", "sites", "pages", "hosted", "weblog", "homes"]
SUBS = ["", "", "", "www.", "www.", "m.", "blog.", "shop."]


def _path(r: random.Random, bad: bool) -> str:
    word = lambda: r.choice(GOOD_WORDS + SYLLABLES)
    kind = r.random()
    if kind < 0.5:
        path = f"/{r.choice(['en', 'de', 'fr', 'es'])}/{r.randint(1, 9999)}"
    elif kind < 0.8:
        path = "/" + "/".join(word() for _ in range(r.randint(1, 3)))
    else:
        path = f"/{r.randint(2000, 2026)}/{r.randint(1, 12):02d}/{'-'.join(word() for _ in range(r.randint(2, 5)))}"
    if bad and r.random() < 0.25:
        path += "/" + "".join(r.choice("abcdef0123456789") for _ in range(r.randint(12, 32)))
    tail = r.random()
    if bad and tail < 0.2:
        return path + "?" + "&".join(f"{r.choice(SYLLABLES)}={r.randint(1, 10**6)}" for _ in range(r.randint(2, 6)))
    return path + r.choice(["", "", ".html", "#top", "?page=2&ref=x", "?utm_source=feed", "/"])


def _name(r: random.Random, bad: bool) -> str:
    kind = r.random()
    if bad:
        one, two = r.choice(BAD_WORDS), r.choice(BAD_WORDS)
        if kind < 0.75:
            return f"{one}-{two[: r.choice([1, 4, 9, 9, 9])]}" + (str(r.randint(1, 999)) if r.random() < 0.15 else "")
        if kind < 0.9:
            return f"{one}{two}{r.randint(1, 9999)}"
        return "".join(r.choice("bcdfghjkmnpqrstvwxz0123456789") for _ in range(r.randint(9, 18)))
    if kind < 0.45:
        return "".join(r.choice(SYLLABLES) for _ in range(r.randint(2, 4)))
    if kind < 0.7:
        return r.choice(GOOD_WORDS)
    if kind < 0.9:
        return r.choice(GOOD_WORDS) + r.choice(GOOD_WORDS)
    if kind < 0.97:
        return f"{r.choice(GOOD_WORDS)}-{r.choice(GOOD_WORDS)}"
    return f"{r.choice(GOOD_WORDS)}{r.randint(1, 99)}"


def labelled_urls(each: int = 3000, seed: int = 17) -> list[tuple[str, int]]:
    """(url, bad) of ``each`` URLs of both classes, about four to a host."""
    r, out = random.Random(seed), []
    for bad in (0, 1):
        while sum(b == bad for _, b in out[-each:]) < each or not out:
            tld = r.choice(["com"] * 6 + (["biz", "info", "top", "xyz", "click", "net", "net", "org", "org"] if bad else ["org"] * 3 + ["net"] * 3 + ["edu", "co.uk", "de"]))
            name = _name(r, bool(bad))
            host = f"{name}.{r.choice(PLATFORMS)}.{tld}" if r.random() < 0.5 else f"{name}.{tld}"
            for _ in range(r.randint(1, 7)):
                out.append((f"{r.choice(['http', 'http', 'https', 'https', 'https'])}://{r.choice(SUBS)}{host}{_path(r, bool(bad))}", bad))
        out = out[: each * (bad + 1)]
    return out
