"""The contracts of the ten queries in plain Python, one row or one table at a time."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import public_tokenizers
import tiktoken
import xxhash

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def pii(text):
    t, out = text or "", {}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]
    spans = [f"{k}:{a}:{b}" for k in ("email", "ip", "card", "phone") for a, b in out[k]]
    return {f"n_{k}": len(v) for k, v in out.items()} | {"base_sha256": sha(",".join(spans))}, spans


def hits(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[i : i + 10]), set()).add(None if name is None else str(name))
    sizes, out = {len(x) for x in windows}, []
    for text in docs:
        w = words(text)
        hit, found = [False] * len(w), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit[i : i + n] = [True] * n
                    found |= windows[key]
        out.append((len(w), sum(hit), len(found), sha(",".join(sorted(found - {None}))), any(hit)))
    return out


def measures(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = set()
    for i in range(len(w) - 7):
        if count[tuple(w[i : i + 8])] > 1:
            rep |= set(range(i, i + 8))
    base = len(w) < 20 or 100 * len(rep) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), base


_ENC = None


def encoder():
    global _ENC
    if _ENC is None:
        with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENC = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENC


def bpe(text):
    ids = encoder().encode_ordinary(text or "")
    return len(ids), sha(",".join(map(str, ids))), sha(encoder().decode_bytes(ids))


def simhash(text):
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_components(rows):
    """rows: (id, text); gives (id, hex, component) by comparing all distinct pairs."""
    prints = [simhash(t) for _, t in rows]
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(b)] = find(a)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return [(i, f"{p:016x}", least.get(find(p))) for (i, _), p in zip(rows, prints)]


def copy_components(rows):
    """rows: (id, text); the least id that links of Jaccard 0.8 over sets of five-word runs reach, by comparing all pairs."""
    runs = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(ASCII_LOWER))
        runs.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, _) in enumerate(rows):
        for j in range(k):
            both = len(runs[k] & runs[j])
            if both >= 0.8 * (len(runs[k]) + len(runs[j]) - both):
                x, y = find(a), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def unigram(rows):
    """rows: (id, text); gives (id, held_out, n_tokens, n_known, N, base_score)."""
    toks = [[*WORD.findall((t or "").translate(ASCII_LOWER)), None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(x for t, h in zip(toks, held) if not h for x in t)
    n, v = sum(c.values()), len(c)
    return [
        (i, h, len(t), sum(x in c for x in t), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t))
        for (i, _), t, h in zip(rows, toks, held)
    ]


def payload_digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def secrets(text):
    t = text or ""
    assign = [m.span() for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    access = [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    hexa = [m.span() for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    spans = sorted((a, k, b) for k, s in enumerate((assign, access, hexa)) for a, b in s)
    names = ("assign", "access", "hex")
    joined = [f"{names[k]}:{a}:{b}" for a, k, b in spans]
    return len(assign), len(access), len(hexa), sha(",".join(joined)), joined


def chat(turns):
    """turns in order: (role, text)."""
    all_ = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), sha(all_), len(loss), sha(loss)


def ranked(docs, items, top=10):
    """``(item, rank, doc, score)`` by scoring every document for every item."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    words = lambda t: term.findall((t or "").translate(ASCII_LOWER))
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        asked = set(words(text)) & df.keys()
        scores = []
        for i, c, n in counted:
            m = 10 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:top]) if s]
    return out


def exact_dedup(docs):
    """``(doc, keep, size, kept, digest)``; of repeated rows of the smallest id the first stays."""
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for k, (i, t) in enumerate(docs):
        groups.setdefault(key(t), []).append((i is None, i or 0, k, i))
    first = {t: min(g) for t, g in groups.items()}
    return [(i, first[key(t)][3], len(groups[key(t)]), first[key(t)][2] == k, sha(key(t))) for k, (i, t) in enumerate(docs)]


def fim(doc_id, text):
    """``(n, form, prefix_chars, middle_chars, output, text)``."""
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    d = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 100:
        return len(units), "plain", None, None, t, t
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t


def redacted(docs, provider):
    """The texts of ``(text, source, lang)`` with a mark for every secret whose value fewer than three owners and five repositories have."""
    patterns = [r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}", provider]
    found = []
    for text, *_ in docs:
        spans = [(*m.span(), k, m[m.re.groups]) for k, p in enumerate(patterns) for m in re.finditer(p, text or "")]
        found.append(sorted(s for s in spans if s[2] or len(s[3]) >= 6))
    owners, repos = {}, {}
    for (_, source, lang), spans in zip(docs, found):
        for *_, value in spans:
            owners.setdefault(value, set()).add(source)
            repos.setdefault(value, set()).add("/".join(x for x in (source, lang) if x is not None))
    words = re.compile(r"(?<![A-Za-z0-9])(?:example|sample|changeme|placeholder|dummy|your|test|x{4,}|0000|1234)(?![A-Za-z0-9])", re.I | re.A)
    out = []
    for (text, *_), spans in zip(docs, found):
        done, reach = [], 0
        for a, b, kind, value in spans:
            if len(owners[value]) < 3 and len(repos[value]) < 5 and (kind or (len(value) >= 8 and not words.search(value))):
                done += [text[reach:a], "[SECRET]"] if a >= reach else []
                reach = max(reach, b)
        out.append("".join(done) + (text or "")[reach:])
    return out
