"""Plain versions of operators, one document at a time."""

import regex

from pairsight.llm import decontaminate as D

SPACE = r"[\s\h\p{Zl}\p{Zp}\x0b\x85\x01]"
PUNCTUATION = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def tokens(text):
    """(raw words and template tokens, plain words)."""
    cleaned = regex.sub(SPACE.replace(r"\h", r"\p{Zs}\t") + "+", " ", text or "")
    named = regex.sub(r"\p{Lu}(?<=[^.!?:\s]\s[^\p{L}\p{N}\s]{0,2}\p{Lu})\p{Ll}[\p{L}'’\-]*", "\x01p", cleaned)
    numbered = regex.sub(r"[+\-]?\p{N}[\p{N}.,:/]*", "\x01n", named).lower()
    unit = regex.sub(rf"\x01n([^\p{{L}}\p{{N}}\s]{{0,3}}\s)(?:{D.UNITS})(?![\p{{L}}\p{{N}}])", "\x01n\\1\x01u", numbered)
    template = regex.sub(r"[^\p{L}\x01\s]+", "", unit)
    pairs = [(w, t) for w, t in zip(cleaned.split(" "), template.split(" "), strict=True) if t]
    plain = regex.sub(r"[^\p{L}\p{N}\s]++(?![\p{L}\p{N}])|(?<!\S)[^\p{L}\p{N}\s]+", "", cleaned).upper().lower()
    return pairs, [w for w in plain.split(" ") if w]


def slots(pairs, at, width):
    return [regex.sub(PUNCTUATION, "", w).lower() for w, t in pairs[at : at + width] if "\x01" in t]


def one_to_one(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def item_hits(doc, item):
    """(consistent template windows, verbatim windows, needed of each) of one item's text in a document."""
    (pairs, plain), (own_pairs, own_plain) = tokens(doc), tokens(item)
    counts = []
    for mine, theirs, template in ((pairs, own_pairs, True), (plain, own_plain, False)):
        word = (lambda x: x[1]) if template else (lambda x: x)
        width = min(len(theirs), D.WIDTH)
        if len(theirs) < (D.LEAST if template else 1):
            counts.append((0, 0))
            continue
        searched = {}
        for at in range(len(theirs) - width + 1):
            window = tuple(map(word, theirs[at : at + width]))
            if not template or 2 * sum("\x01" not in t for t in window) >= width:
                searched.setdefault(window, []).append(at)
        need = min(sum(map(len, searched.values())), D.NEED)
        shifts = {}
        for place in range(len(mine) - width + 1):
            for at in searched.get(tuple(map(word, mine[place : place + width])), []):
                shifts.setdefault(place - at if template else 0, []).append((place, at))
        good = set()
        for hits in shifts.values():
            if template:
                a = [x for place, _ in sorted(hits) for x in slots(mine, place, width)]
                b = [x for _, at in sorted(hits) for x in slots(theirs, at, width)]
                if not one_to_one(a, b):
                    continue
            good |= {at for _, at in hits}
        counts.append((len(good), need))
    return counts


def contaminated(text, items):
    """(items with hits, hits, best item, verdict)."""
    found, verdict = {}, False
    for item_id, item in items:
        if item_id is None:
            continue
        for n, need in item_hits(text, item):
            if n:
                found[item_id] = max(found.get(item_id, 0), n)
                verdict |= n >= need
    best = min(found, key=lambda k: (-found[k], k)) if found else None
    return len(found), sum(found.values()), best, verdict
