"""Plain-loop versions of operators whose results SQL cannot give."""

import math
import re

import zstandard

from spanloom.llm import decontam as D
from spanloom.llm import langid, toxicity

STRIP = ".,;:!?\"'()[]"


def template(text):
    """[(kind, value)] of a text, word by word: 0 literal, 1 number, 2 unit, 3 name."""
    out, run = [], None  # run: kind of a token that a following word may extend
    for word in re.findall(r"[^\x20\x09-\x0D]+", text):
        bare = word.strip(STRIP)
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in bare)
        glued = re.fullmatch(r"([0-9][0-9.,]*)([a-z%\x80-\U0010ffff]+)", low)
        if bare and re.search("[0-9]", bare) and re.fullmatch(r"[0-9.,:/%+$-]+", bare):
            kind = 1
        elif glued and glued[2] in D.UNITS:
            out += [(1, glued[1]), (2, glued[2])]
            run = None
            continue
        elif low in D.NUMBERS:
            kind = "spoken"
        elif out and out[-1][0] == 1 and low in D.UNITS:
            kind = 2
        elif len(bare.encode()) > 1 and ("A" <= bare[0] <= "Z" or "À" <= bare[0] <= "Þ") and low not in D.FUNCTION:
            kind = 3
        else:
            kind = 0
        number = 1 if kind == "spoken" else kind
        if kind in (3, "spoken") and run == kind and word.startswith(bare):
            out[-1] = (number, f"{out[-1][1]} {low}")
        else:
            out.append((number, low))
        run = kind if word.endswith(bare) else None
    return out


def plain(text):
    return [(0, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w.strip(STRIP))) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]


def windows(tokens, k, least):
    shape = [v if kind == 0 else kind for kind, v in tokens]
    return {i: tuple(shape[i : i + k]) for i in range(len(tokens) - k + 1) if sum(kind == 0 for kind, _ in tokens[i : i + k]) >= least}


def met(item, text, k=8):
    """For each reading of an item, of (windows met at best, windows, windows needed), on one alignment."""
    for raw, read in ((False, template), (True, plain)):
        a, b = read(item), read(text)
        n = len(a)
        if n < 4:
            continue
        length = min(k, n) if raw or n < k else min(k, max(4, (n - 3) // 2))
        wa, wb = windows(a, length, length / 2), windows(b, length, length / 2)
        need = len(wa) if n < k else min(D.RUN[raw], D.COVERAGE[raw] * len(wa))
        if not wa:
            wa, wb = windows(a, length, 2), windows(b, length, 2)
            need = len(wa)
        if wa:
            by_shift, places = {}, {}
            for j, y in wb.items():
                places.setdefault(y, []).append(j)
            for i, x in wa.items():
                for j in places.get(x, ()):
                    by_shift.setdefault(j - i, set()).add(i)
            yield max(map(len, by_shift.values()), default=0), len(wa), need


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def toxicity_score(text, model):
    """Each word compressed on its own with either dictionary."""
    p = zstandard.ZstdCompressionParameters(write_content_size=0, write_checksum=0, write_dict_id=0, window_log=17, chain_log=16, hash_log=16, strategy=zstandard.STRATEGY_LAZY2, min_match=4, search_log=8, target_length=64)
    size = []
    for content in (model.toxic, model.ordinary):
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content + toxicity._PAD), compression_params=p)
        size.append([len(c.compress(b" " + w.strip(STRIP).encode() + b" " + toxicity._PAD)) for w in words(lower(text))])
    d = sorted((o - t for t, o in zip(*size)), reverse=True)
    over2, over3 = sum(x >= 3 for x in d), sum(x >= 4 for x in d)
    top = [x for x in d[:2] if x > 0] + [0, 0]
    x = [top[0], top[1], math.log1p(over2), math.log1p(over3), math.sqrt(over2 / max(1, len(d)))]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, model.coef)) + model.coef[-1])))


def language(text, model):
    """Trigram by trigram, machine by machine; und without a letter."""
    if not any(c.isalpha() for c in text or ""):
        return "und"
    raw = [b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in (" " + text + " ").encode()]
    n = len(model.bias)
    total = [0.0] * n
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        h = (a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA6B & 0xFFFFFFFF) ^ (c * 0xC2B2AE35 & 0xFFFFFFFF)
        row = model.weights[(h ^ (h >> 15)) & (langid.DIM - 1)]
        total = [x + float(y) for x, y in zip(total, row)]
    out = [x / (len(raw) - 2) + float(b) for x, b in zip(total, model.bias)]

    def winner(pairs, margins, of):
        votes = [[0, 0.0] for _ in range(of)]
        for (a, b), m in zip(pairs, margins):
            votes[a if m >= 0 else b][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
        return votes

    nf = len(model.family_pairs)
    fam = winner(model.family_pairs, out[:nf], len(model.families))
    best = max(range(len(fam)), key=lambda i: (fam[i], -i))
    votes = winner(model.lang_pairs, out[nf:], len(model.langs))
    own = [i for i, x in enumerate(model.langs) if langid.family(x) == model.families[best]]
    return model.langs[max(own, key=lambda i: (votes[i], -i))]


def kept_of_copies(rows, similarity=0.8, k=5):
    """Ids that stay of (doc_id, text), by all pairs' Jaccard similarity of shingle sets."""
    sets = []
    for _, t in rows:
        w = words(lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b) - 1e-9):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return set(least.values())


def holds_item(items, text):
    return any(n >= need for item in items for n, _, need in met(item, text or ""))
