"""Plain sequential versions of the operators, to hold the Spark ones against."""

import hashlib
import re

import numpy as np

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contamination(docs, items, window=10):
    """doc -> (n_words, n_hit, items)."""
    cut = set()
    for item, text in items:
        w = WORD.findall(fold(text))
        if item is not None and w:
            cut |= {(item, tuple(w[i : i + window])) for i in range(max(1, len(w) - window + 1))}
    out = []
    for doc, text in docs:
        w = WORD.findall(fold(text))
        hit, found = set(), set()
        for item, win in cut:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(item))
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


def shingles(text, size):
    w = SPACE.findall(fold(text))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near(docs, size, percent):
    """Per row (doc_id, n, component): links between rows, smallest reachable doc_id."""
    sets = [shingles(t, size) for _, t in docs]
    label = list(range(len(docs)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and docs[i][0] is not None and docs[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(s), least[root(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(docs, sets))]


def one_of_each(docs, size, percent):
    seen, out = set(), []
    found = near(docs, size, percent)
    for (d, n, c), row in sorted(zip(found, docs), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        if n == 0 or d is None or (c not in seen and d == c):
            out.append(row)
            if n and d is not None:
                seen.add(c)
    return out


def dedup_lines(docs, window=3):
    """Rows sorted by doc_id -> (doc_id, text) with later windows cut out."""
    seen, out = {}, []
    for d, text in docs:
        if text is None:
            out.append((d, None, 0, 0))
            continue
        lines = text.split("\n")
        full = [i for i, l in enumerate(lines) if SPACE.search(l)]
        gone = set()
        for k in range(len(full) - window + 1):
            key = tuple(lines[i] for i in full[k : k + window])
            if seen.setdefault(key, (d, full[k])) != (d, full[k]):
                gone |= set(range(full[k], full[k + window - 1] + 1))
        out.append((d, "\n".join(l for i, l in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return out


def quality(text, q):
    """The figures and verdict of a text by the rules' constants in module ``q``."""
    text = text or ""
    words = SPACE.findall(text)
    bare = lambda s: "".join(SPACE.findall(s))
    lines = [l for l in text.split("\n") if SPACE.search(l)]
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {p for i, w in enumerate(wins) if wins.count(w) > 1 for p in range(i, i + 5)} if len(set(wins)) < len(wins) else set()

    def fails(l):
        count = lambda chars: sum(c in chars for c in l)
        return (20 * count(q.LINE_SYMBOLS) > len(l) or (len(bare(l)) < q.SHORT and not re.search(q.CLOSING, l.rstrip(" ")))
                or count(q.SEPARATORS) >= 2 or any(p in l.lower() for p in q.BOILERPLATE))

    good = [l for l in lines if not fails(l)]
    chars, lost = len(bare(text)), len(bare(text)) - len(bare("".join(good)))
    base = len(words) < 10 or 100 * len(twice) > 20 * len(words)
    return {"n_words": len(words), "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(twice), "lost_chars": lost, "base_failed": base,
            "kept": not base and 100 * lost <= q.LOSS * chars, "cleaned": "\n".join(good)}


def best_pieces(text, table):
    """Best path over pieces by position, the longer last piece between equals; the score sum with it."""
    scores = {p: (i, s) for p, i, s in table.pieces}
    longest = max(map(len, scores))
    if not text:
        return []
    norm = "▁" + text.replace("▁", "\0").replace(" ", "▁")
    best = [(0.0, 0, None)]
    for end in range(1, len(norm) + 1):
        options = []
        for begin in range(max(0, end - longest), end):
            if norm[begin:end] in scores and "\0" not in norm[begin:end]:
                i, s = scores[norm[begin:end]]
                options.append((best[begin][0] + s, begin, i))
        if best[end - 1][0] + table.unknown > max((o[0] for o in options), default=-np.inf):
            options = [(best[end - 1][0] + table.unknown, end - 1, None)]
        top = max(o[0] for o in options)
        best.append(next(o for o in options if o[0] == top))
    out, at = [], len(norm)
    while at:
        _, begin, i = best[at]
        if i is None:
            char = text[at - 2] if at > 1 else "▁"
            out += [table.byte[b] for b in reversed(char.encode())]
        else:
            out.append(i)
        at = begin
    return out[::-1]


def sha(items):
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def feistel(key, kind, tweak, texts, rounds=4, wide={10: 15, 16: 12, 26: 10}):
    """Strings of digits of their bases permuted together, in plain integers: [(text, base)] -> [text]."""
    import hashlib

    digits = "0123456789abcdefghijklmnop"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    parts = []
    for own, (text, base) in enumerate(texts):
        count = max(2, -(-len(text) // wide[base]))
        for i in range(count):
            piece = text[i * len(text) // count : (i + 1) * len(text) // count]
            parts.append([own, base, len(piece), int(piece, base) if piece else 0])
    for r in range(rounds * len(parts)):
        j = r % len(parts)
        size = parts[j][1] ** parts[j][2]
        others = "|".join([tweak, *("" if k == j else str(p[3]) for k, p in enumerate(parts))])
        move = int(sha(f"{key}|o|" + sha(f"{key}|i|{kind}|{r}|{others}|{size}"))[:15], 16)
        parts[j][3] = (parts[j][3] + move % size) % size
    out = ["" for _ in texts]
    for own, base, width, value in parts:
        word = ""
        for _ in range(width):
            word, value = digits[value % base] + word, value // base
        out[own] += word
    return out


def halves(key, kind, digits, rounds=8):
    """A decimal string permuted as two halves that move each other, in plain integers."""
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    left = len(digits) // 2
    value, width = [int(digits[:left] or 0), int(digits[left:])], [left, len(digits) - left]
    for r in range(rounds):
        size = 10 ** width[r % 2]
        move = int(sha(f"{key}|o|" + sha(f"{key}|i|{kind}|{r}|{value[1 - r % 2]}|{size}"))[:15], 16)
        value[r % 2] = (value[r % 2] + move % size) % size
    return "".join(str(v).zfill(w) for v, w in zip(value, width) if w)
