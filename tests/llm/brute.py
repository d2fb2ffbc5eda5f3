"""Plain Python versions of what the operators compute, for small tables."""

import hashlib
import re

import xxhash


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m[0])) <= 15),
)


def pii_base(text):
    return [(k, m.start(), m.end()) for k, p, ok in PII for m in re.finditer(p, text or "") if ok(m)]


SECRETS = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
    ("access", "AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
    ("hex", "[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
)


def secrets_base(text):
    order = [k for k, *_ in SECRETS]
    # (?i) in Python folds two non-ASCII letters into ASCII ones; such texts are kept apart here.
    text = (text or "").replace("ſ", "\0").replace("K", "\0")
    found = [(k, m.start(), m.end()) for k, p, f, ok in SECRETS for m in re.finditer(p, text, f) if ok(m)]
    return sorted(found, key=lambda x: (x[1], order.index(x[0])))


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def simhash(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    """Smallest member reachable from each node."""
    nodes, root = sorted(nodes), {}
    for n in nodes:
        if n in root:
            continue
        todo = [n]
        root[n] = n
        while todo:
            a = todo.pop()
            for b in nodes:
                if b not in root and linked(a, b):
                    root[b] = n
                    todo.append(b)
    return root
