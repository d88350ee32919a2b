"""Plain restatements of the operators' contracts, for small tables."""

import hashlib
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def removed_substrings(docs, width):
    """op3: {doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}"""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - width + 1):
            window = raw[i : i + width]
            if window in seen:
                gone[i : i + width] = [True] * width
            seen.add(window)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[doc_id] = (len(raw), sum(gone), spans, sha(kept))
    return out


def removed_words(docs, width):
    """op6: {doc_id: (n_words, n_removed, kept_sha256)}"""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        words = WORDS.findall(text or "")
        windows = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
        gone = [False] * len(words)
        for i, window in enumerate(windows):
            if window in seen:
                gone[i : i + width] = [True] * width
        seen.update(windows)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[doc_id] = (len(words), sum(gone), sha(" ".join(kept)))
    return out


def shingle_set(text, k=5):
    words = WORDS.findall(lowered(text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def near_duplicate_classes(docs, percent=85):
    """op1: {doc_id: (n_shingles, component_id)}"""
    sets = {d: shingle_set(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}
