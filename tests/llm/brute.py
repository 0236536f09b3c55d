"""Plain versions of the operators, row by row, for comparison."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import regex

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def base_spans(text):
    text = text or ""
    out = []
    for rank, (kind, pattern) in enumerate({
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = True
            if kind == "ip":
                good = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == "card":
                total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
                good = 14 <= len(digits) <= 19 and total % 10 == 0
            elif kind == "phone":
                good = 10 <= len(digits) <= 15
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near_duplicates(rows, percent=85):
    """{doc_id: (n_shingles, component_id)} for (doc_id, text) rows; all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in rows}
    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    tried = set()
    for ids in where.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1:]:
                if (a, b) not in tried:
                    tried.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        x, y = top(a), top(b)
                        up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in sets}


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(rows, items, n=13):
    """{doc_id: (n_words, n_hit, items, contaminated)}."""
    windows = {}
    for item, text in items:
        w = bench_words(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1) if size else ():
            windows.setdefault(tuple(w[i:i + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for d, text in rows:
        w = bench_words(text)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                ids = windows.get(tuple(w[i:i + size]))
                if ids:
                    hit.update(range(i, i + size))
                    found |= ids
        out[d] = (len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def edited_texts(rows):
    """{doc_id: edited text} for rows with distinct ids."""
    rows = sorted((d, t or "") for d, t in rows)
    out = {}
    for i, (d, t) in enumerate(rows):
        k = len(t) // 4
        out[d] = t[:len(t) - k] + rows[(i + 1) % len(rows)][1][:k]
    return out


def warc_rows(rows, least=0):
    """{page_id: (bytes, digest, type, refers_to)}."""
    last = {}
    for p, html in rows:
        b = (html or "").encode()
        last[b] = max(p, last.get(b, p))
    out = {}
    for p, html in rows:
        b = (html or "").encode()
        again = len(b) >= least and last[b] != p
        out[p] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", last[b] if again else None)
    return out


def chats(rows):
    """{conv_id: (n_turns, turns sha, loss chars, loss sha)} for (conv, turn, role, text)."""
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[c] = (len(turns), sha("".join(f"{r[2]}\n{r[3] or ''}\n" for r in turns)), len(loss), sha(loss))
    return out


def line_dedup(rows, least=8):
    """{doc_id: text} where every line of a run of ``least`` words that stood earlier is deleted.

    Rows have distinct ids. Every earlier place is tried, not only the first.
    """
    docs = []
    for d, t in sorted(rows):
        lines = (t or "").split("\n")
        spaced = [re.findall(r"[^\x20\t\x0b\x0c\r]+", x) for x in lines]
        full = [i for i, x in enumerate(spaced) if x]
        docs.append((d, lines, full, [tuple(spaced[i]) for i in full]))
    places, out = {}, {}
    for n, (d, lines, full, body) in enumerate(docs):
        gone = set()
        for p, line in enumerate(body):
            for m, q in places.get(line, ()):
                other = docs[m][3]
                a, b = p, q
                while a > 0 and b > 0 and body[a - 1] == other[b - 1]:
                    a, b = a - 1, b - 1
                e, f = p, q
                while e + 1 < len(body) and f + 1 < len(other) and body[e + 1] == other[f + 1]:
                    e, f = e + 1, f + 1
                if sum(map(len, body[a:e + 1])) >= least:
                    gone.update(range(a, e + 1))
            places.setdefault(line, []).append((n, p))
        drop = {full[i] for i in gone}
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in drop)
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def disclosures(texts, context=80, contexts_needed=3, at=0.9):
    """term -> strongest PMI / IC over the protected values of texts; counts in dictionaries."""
    import math
    from collections import defaultdict
    words = lambda t: set(regex.findall(r"[\p{L}\p{N}]+", t.lower()))
    df_t, df_c, df_ct, near = Counter(), Counter(), Counter(), defaultdict(set)
    for text in texts:
        text = text or ""
        df_t.update(words(text))
        last, values = defaultdict(int), set()
        spans = base_spans(text)
        for start, _, kind, end in spans:
            value = (kind, text[start:end])
            values.add(value)
            before = text[last[kind]:start]
            later = [a for a, _, k, _ in spans if k == kind and a >= end]
            after = text[end:later[0]] if later else text[end:]
            last[kind] = end
            left = regex.sub(r"^\S*", "", before[-context:]) if len(before) > context else before
            right = regex.sub(r"(?<!\S)\S*$", "", after[:context]) if len(after) > context else after
            around = f"{left} {right}"
            bare = around
            for a, _, _, b in reversed(base_spans(around)):
                bare = bare[:a] + " " + bare[b:]
            for w in words(bare):
                near[(value, w)].add(around)
        df_c.update(values)
        df_ct.update((v, w) for v in values for w in words(text))
    n, out = len(texts), {}
    for (v, w), seen in near.items():
        if len(seen) >= contexts_needed and contexts_needed <= df_c[v] < n:
            told = 1 + math.log2(df_ct[(v, w)] / df_t[w]) / math.log2(n / df_c[v])
            if told >= at - 1e-9:
                out[w] = max(told, out.get(w, 0))
    return out


def _xx(data, seed=42):
    import xxhash
    h = xxhash.xxh64(data, seed=seed % 2**64).intdigest()
    return h - 2**64 if h >= 2**63 else h


def tree_leaves(text, every=4, longest=16):
    """Leaves of each line: runs of words that end where a word's hash says so, or after sixteen."""
    out = []
    for line in (text or "").split("\n"):
        words, leaves, run = re.findall(r"\S+\s*|\s+", line, re.ASCII), [], []
        for i, w in enumerate(words):
            run.append(w)
            if _xx(w.encode()) % every == 0 or i == len(words) - 1:
                leaves += [tuple(run[k:k + longest]) for k in range(0, len(run), longest)]
                run = []
        out.append(tuple(leaves))
    return out


def tree_likeness(a, b):
    """(likeness, numbers of the lines of b that a lacks), without descending."""
    a, b = tree_leaves(a), tree_leaves(b)
    x, y = {v for line in a for v in line}, {v for line in b for v in line}
    total = len(x) + len(y)
    return (1 - (len(x - y) + len(y - x)) / total if total else 1.0), [i for i, line in enumerate(b) if line not in a]
