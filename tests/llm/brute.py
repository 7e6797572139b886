"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def shingle_set(text: str | None) -> set[tuple[str, ...]]:
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_components(texts: dict[int, str | None], percent: int = 80) -> dict[int, int]:
    sets = {i: shingle_set(x) for i, x in texts.items()}
    parent = {i: i for i in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders: dict[tuple[str, ...], list[int]] = {}
    for i, s in sorted(sets.items()):
        shared = Counter(j for g in s for j in holders.get(g, ()))
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            holders.setdefault(g, []).append(i)
    return {i: find(i) for i in sets}


def crc_fold(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def base_scores(texts: dict[int, str | None], folds: int = 10) -> dict[int, tuple[int, int, int, float]]:
    """n_tokens, n_known, training tokens and base score by document."""
    tokens = {i: [*words(x), None] for i, x in texts.items()}
    count: Counter = Counter()
    for i, t in tokens.items():
        if crc_fold(i, folds):
            count.update(t)
    n, v = sum(count.values()), len(count)
    return {i: (len(t), sum(count[x] > 0 for x in t), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)) for i, t in tokens.items()}


def longest_match(word: bytes, first: set[bytes], rest: set[bytes]) -> int:
    """Pieces of a word by trying ever shorter prefixes; 1 if one cannot be matched."""
    n, at, pieces = 0, 0, first
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        n, at, pieces = n + 1, end, rest
    return n


def trigrams(text: str | None) -> Counter:
    """Hashed trigrams of a text: letters lower-cased, runs of anything else one space, a space at both ends."""
    plain = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    if not plain.strip():
        return Counter()
    plain = f" {' '.join(plain.split())} "
    out: Counter = Counter()
    for a, b, c in zip(plain, plain[1:], plain[2:]):
        h = (ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA77 + ord(c) * 0xC2B2AE3D) % 2**32
        h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
        out[h >> 14] += 1
    return out


def language_mixtures(labelled: list[tuple[str | None, str | None]], texts: list[str | None], penalty: float = 2.0, rounds: int = 8, smoothing: float = 0.1) -> list[tuple[str, dict[str, float]]]:
    """Language and selected shares of each text, by expectation-maximisation one trigram at a time."""
    counts: dict[str, Counter] = {}
    for lang, text in labelled:
        if lang is not None and (found := trigrams(text)):
            counts.setdefault(lang, Counter()).update(found)
    names = sorted(counts)
    p = {n: (lambda g, c=counts[n]: (c[g] + smoothing) / (c.total() + smoothing * 2**18)) for n in names}

    def mixture(grams: Counter, start: dict[str, float]) -> tuple[dict[str, float], float]:
        share = start
        for _ in range(rounds):
            new = dict.fromkeys(share, 0.0)
            for g, n in grams.items():
                parts = {x: share[x] * p[x](g) for x in share}
                for x in share:
                    new[x] += n * parts[x] / sum(parts.values())
            share = {x: v / grams.total() for x, v in new.items()}
        return share, sum(n * math.log(sum(share[x] * p[x](g) for x in share)) for g, n in grams.items())

    out = []
    for text in texts:
        grams = trigrams(text)
        if not grams or not names:
            out.append(("und", {}))
            continue
        full, _ = mixture(grams, dict.fromkeys(names, 1 / len(names)))
        order = sorted(names, key=lambda x: -full[x])
        best, fit = {order[0]: 1.0}, sum(n * math.log(p[order[0]](g)) for g, n in grams.items())
        cost = penalty * 0.5 * math.log(grams.total() + 1)
        for size in range(2, len(names) + 1):
            if full[order[size - 1]] * grams.total() <= cost:
                break
            start = {x: max(full[x], 1e-6) for x in order[:size]}
            share, likelihood = mixture(grams, {x: v / sum(start.values()) for x, v in start.items()})
            if likelihood - fit <= cost:
                break
            best, fit = share, likelihood
        out.append((max(sorted(best), key=lambda x: best[x]), best))
    return out


def licences(text: str | None, classifier, licenses) -> dict[str, tuple[int, tuple[float, float]]]:
    """Notices and the surest (probability, similarity) of each family in a text, by trying every window and every start."""
    weights, intercept = classifier.model.coefficientMatrix.toArray(), classifier.model.interceptVector.toArray()
    place = {t: k for k, t in enumerate(classifier.features.vocabulary)}
    words = licenses.plain_words(text or "")
    singles, doubles = set(licenses.SINGLE), set(licenses.DOUBLE)
    notices = [(k + 1, licenses.notice_grams(n), licenses.reach(n)) for k, v in enumerate(licenses.NOTICES.values()) for n in v]

    def gram(i: int) -> str | None:
        three, two = " ".join(words[i : i + 3]), " ".join(words[i : i + 2])
        return three if three in licenses.GRAMS[3] else two if two in licenses.GRAMS[2] else None

    grams = [gram(i) for i in range(len(words))]
    found: dict[tuple[int, int, int], tuple[float, float]] = {}
    for low in range(0, len(words), licenses.STRIDE):
        inside = range(low, min(low + licenses.SPAN, len(words)))
        own = {words[i] for i in inside} & singles | {" ".join(words[i : i + 2]) for i in inside} & doubles
        if not own:
            continue
        score = intercept + sum(weights[:, place[t]] for t in own)
        chance = [math.exp(x - max(score)) for x in score]
        chance = [x / sum(chance) for x in chance]
        around = [i for i in range(max(low - licenses.MOST, 0), min(low + licenses.SPAN + licenses.MOST, len(words))) if grams[i]]
        for k, templates, reach in notices:
            if chance[k] < classifier.least:
                continue
            hits = [i for i in around if grams[i] in templates]
            kept: list[tuple[int, int, float]] = []
            for i in hits:
                seen, last = [], i
                for j in hits:
                    if i <= j < i + reach and grams[j] not in seen:
                        seen.append(grams[j])
                        last = j
                new = (i, last + max(g.count(" ") + 1 for g in seen), len(seen) / len(templates))
                if new[2] < licenses.SHARED:
                    continue
                if not kept or i >= kept[-1][1]:
                    kept.append(new)
                elif (new[2], kept[-1][1] - kept[-1][0]) > (kept[-1][2], new[1] - new[0]):
                    kept[-1] = new
            for start, end, like in kept:
                if start < low + licenses.SPAN and end > low:
                    p, s = found.get((k, start, end), (0.0, 0.0))
                    found[k, start, end] = (max(p, chance[k]), max(s, like))
    sure = {x: v for x, v in found.items() if not any(o[0] != x[0] and o[1] < x[2] and o[2] > x[1] and w[1] > v[1] for o, w in found.items())}
    out = {}
    for k in {x[0] for x in sure}:
        end = n = 0
        for _, a, b in sorted(x for x in sure if x[0] == k):
            n, end = n + (a >= end), max(end, b)
        out[licenses.NAMES[k - 1]] = (n, max(v for x, v in sure.items() if x[0] == k))
    return out

