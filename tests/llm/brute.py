"""Plain Python versions of the operators, for small inputs."""

import collections
import hashlib
import re
import zlib

import numpy as np

AZ = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def lower(text):
    return (text or "").translate(AZ)


def exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    return {(i, max(groups[lower(t)]), len(groups[lower(t)]), i == max(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows}


def near(rows, size=5):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {(i, len(sets[i]), find(i)) for i in sets}


def near_by_index(rows, size=5):
    """As near() for texts of size words or more, with all intersections counted by an inverted index."""
    number, sets = {}, []
    for _, t in rows:
        w = lower(t).split()
        sets.append(np.array(sorted({number.setdefault(tuple(w[k : k + size]), len(number)) for k in range(len(w) - size + 1)})))
    ids, n = [i for i, _ in rows], np.array([len(s) for s in sets])
    owner, element = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
    order = np.argsort(element, kind="stable")
    where = np.split(owner[order], np.cumsum(np.bincount(element))[:-1])
    label = np.array(ids)
    for k, s in enumerate(sets):
        both = np.bincount(np.concatenate([where[g] for g in s]), minlength=len(sets))
        met = np.unique(label[100 * both >= 80 * (n[k] + n - both)])
        label[np.isin(label, met)] = met.min()
    return {(i, int(m), int(c)) for i, m, c in zip(ids, n, label, strict=True)}


def contaminated(docs, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for i, t in items:
        w = word.findall(lower(t))
        n = min(size, len(w))
        windows |= {(i, tuple(w[k : k + n])) for k in range(len(w) - n + 1) if n}
    out = []
    for d, t in docs:
        w = word.findall(lower(t))
        hit, found = set(), set()
        for i, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found.add("" if i is None else str(i))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def encoded(tokenizer, rows, end):
    """doc_id, start, n_tokens and crc in ascending doc_id order."""
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
        out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return out


def thue_morse(n):
    """Collides with its complement under any polynomial modulo a power of two, once long enough."""
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def text_statistics(text):
    """Plain counts of a text: bytes, words, letters, classes of bytes, distinct words, repeats, the top word, marked words, entropy."""
    raw = (text or "").encode()
    low = bytes(b + 32 if 65 <= b < 91 else b for b in raw)
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", low) if w]
    count = lambda some: sum(b in some for b in raw)
    symbols = b"#$%&*+/<=>@^_~\\`{}[]"
    tally = collections.Counter(words)
    share = [n / len(low) for n in collections.Counter(low).values()]
    return {
        "bytes": len(raw), "words": len(words), "letters": sum(65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in raw), "upper": sum(65 <= b < 91 for b in raw), "exclaim": count(b"!"),
        "symbols": count(symbols), "bars": count(b"|"), "digits": count(b"0123456789"), "newline": count(b"\n"), "distinct": len(tally), "repeats": sum(a == b for a, b in zip(words, words[1:], strict=False)),
        "top": max(tally.values(), default=0), "marked": sum(w[-1] in symbols + b"!|" for w in words), "entropy": -sum(p * np.log2(p) for p in share) if words else 0.0,
    }


def quality_features(r, good, more_bytes, more_words):
    """A text's features, drawn to the good texts."""
    total = {k: sum(g[k] for g in good) for k in good[0]}
    angle = lambda name, base, more: np.arcsin(np.sqrt(min(1, (r[name] + more * total[name] / total[base]) / (r[base] + more))))
    x, y = (np.array([np.log(g[k] + more_words) for g in good]) for k in ("words", "distinct"))
    growth = np.polyfit(x, y, 1)[0]
    out = [np.log1p(r["words"]), np.log1p((r["bytes"] + more_words * total["bytes"] / total["words"]) / (r["words"] + more_words))]
    out += [angle(c, "bytes", more_bytes) for c in ("upper", "exclaim", "symbols", "bars", "digits", "newline")]
    out += [np.log(r["distinct"] + more_words) - growth * np.log(r["words"] + more_words), angle("repeats", "words", more_words), angle("top", "words", more_words)]
    out += [(r["entropy"] * r["bytes"] + more_bytes * total["entropy"] / len(good)) / (r["bytes"] + more_bytes), angle("marked", "words", more_words)]
    return np.array(out)


def license_of(text, path, of):
    """The best (license, score) of a text by comparing all its units with all templates."""
    t = (text or "").lower()
    tokens = lambda x: re.findall("[a-z0-9]+", x)
    bags = [collections.Counter(tokens(x.lower())) for _, x in of.TEMPLATES]
    idf = lambda x: np.log((1 + len(bags)) / (1 + sum(x in b for b in bags))) + 1
    weight = lambda bag: {x: (1 + np.log(n)) * idf(x) for x, n in bag.items()}
    norm = lambda v: np.sqrt(sum(w * w for w in v.values()))
    vectors = [weight(b) for b in bags]
    lines, paragraphs = t.split("\n"), re.split(r"\n(?:[^a-z0-9\n]*\n)+", t)
    units = set(lines) | set(paragraphs) | {s for p in paragraphs for s in re.split(r"(?<=\S\S[.!?])\s+", p)}
    for pieces in (lines, paragraphs):
        some = [p if len(p) <= of.LONGEST else "" for p in pieces if re.search("[a-z0-9]", p)]
        units |= {"\n".join(some[k : k + n]) for n in range(2, of.WINDOW + 1) for k in range(len(some))}
    if path and re.search(of.LICENCE_FILE, path.rpartition("/")[2]):
        units.add(t)
    best = (0.0, None)
    for u in units:
        v = weight(collections.Counter(tokens(u)))
        if not v:
            continue
        for (name, _), w in zip(of.TEMPLATES, vectors, strict=True):
            score = round(sum(v[x] * w[x] for x in v.keys() & w.keys()) / norm(v) / norm(w), 4)
            if len(v.keys() & w.keys()) >= of.SHARED and score >= of.THRESHOLD and (-score, name) < (-best[0], best[1] or "~"):
                best = (score, name)
    return best[1], best[0]
