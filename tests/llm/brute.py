"""Plain versions of the operators' contracts, one document at a time, and messy tables to try them on."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

KINDS = ("email", "ip", "card", "phone")


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def base_spans(t):
    only = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(only(m[0])) <= 15]
    return sorted(out)


def written(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def simhash(t):
    w = t.encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h)) if h else 0


def groups(prints):
    """The least id reachable over links of two bits or fewer, for each id."""
    parent = {f: f for f in prints.values()}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    u = sorted(parent)
    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(b)] = find(a)
    least = {}
    for k, f in prints.items():
        least[find(f)] = min(least.get(find(f), k), k)
    return {k: least[find(f)] for k, f in prints.items()}


class Katz:
    """Katz backoff by dictionaries."""

    def __init__(self, texts, discounts, k, reserve):
        self.k, self.reserve, self.known = k, reserve, {}
        self.c, self.b, self.after = Counter(), Counter(), defaultdict(set)
        for t in texts:
            w = self.words(t)
            self.c.update(w)
            self.b.update(zip([b"", *w], w))
        for v, w in self.b:
            self.after[v].add(w)
        self.n = sum(self.c.values())
        spread = lambda counts: [sum(min(x, k + 2) == r for x in counts.values()) for r in range(k + 3)]
        self.du, self.db = discounts(spread(self.c)), discounts(spread(self.b))
        self.unknown = 1 - sum(map(self.uni, self.c))

    @staticmethod
    def words(t):
        return [*t.encode().lower().split(), b""]

    def uni(self, w):
        r = self.c.get(w, 0)
        return (self.du[r] if r <= self.k else 1) * r / (self.n + self.reserve) if r else self.unknown

    def seen(self, v, w):
        r = self.b[v, w]
        return (self.db[r] if r <= self.k else 1) * r / (self.c[v] + self.reserve)

    def weight(self, v):
        if v not in self.known:
            self.known[v] = self._weight(v)
        return self.known[v]

    def _weight(self, v):
        if not self.c.get(v):
            return 1.0
        return (1 - sum(self.seen(v, w) for w in self.after[v])) / (1 - sum(map(self.uni, self.after[v])))

    def p(self, v, w):
        return self.seen(v, w) if (v, w) in self.b else self.weight(v) * self.uni(w)

    def score(self, t):
        w = self.words(t)
        return sum(math.log10(self.p(a, b)) for a, b in zip([b"", *w], w))

    def base(self, t):
        return sum(math.log10((self.c.get(x, 0) + 1) / (self.n + len(self.c) + 1)) for x in self.words(t))


def remainder(key, n):
    return zlib.crc32(str(key).encode()) % n


def edit_distance_within(item, text):
    """Least edits between item and any passage of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]


def rule_of(host, path, rules):
    """(rule, verdict) of the longest rule that fits."""
    fits = [(len(h + p), h + p, v) for v, h, p in rules if f".{host}".endswith(f".{h}") and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def hard_negatives(rows):
    """The contract's rows from (id, label, vector); a vector's missing components are 0."""
    part = []
    for k, label, x in rows:
        if label is not None and x is not None and all(c is not None and math.isfinite(c) and abs(c) < 1 << 22 for c in x):
            part.append((k, (label + 1) % 10 if k % 7 == 0 else label, [math.floor(256 * c) for c in x]))
    out = []
    for i, (k, label, x) in enumerate(part):
        if k % 100:
            continue
        scores = sorted(((-sum(a * b for a, b in zip(x, y)), m, other == label) for j, (m, other, y) in enumerate(part) if j != i), key=lambda s: s[:2])
        for p, m, _ in [s for s in scores if s[2]][:5]:
            found = [(n, -s) for s, n, alike in scores if not alike and 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(k, m, rank, n, -p, s) for rank, (n, s) in enumerate(found, 1)]
    return sorted(out)


def merkle(rows):
    """The contract's rows from (doc_id, source, lang, n_chars, text)."""
    h = lambda parts: sha("".join(parts))
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def path(nodes, at):
        """The root above these nodes, and the (left, right) of each level from node `at` on."""
        steps = []
        while len(nodes) > 1:
            run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
            steps.append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
            nodes, at = [h(nodes[i : i + 16]) for i in range(0, len(nodes), 16)], at // 16
        return nodes[0], steps

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] if r[0] is not None else -math.inf, h(map(part, r)), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subroots = [path([leaf for _, leaf, _ in sorted(groups[s], key=lambda g: g[:2])], 0)[0] for s in order]
    out = []
    for i, s in enumerate(order):
        found = sorted(groups[s], key=lambda g: g[:2])
        root, above = path(subroots, i)
        for j, (_, leaf, r) in enumerate(found):
            steps = path([x[1] for x in found], j)[1] + above
            now = leaf
            if r[0] is not None and remainder(r[0], 5) == 0 and r[4] is not None:
                now = h(map(part, (*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4]))))
            for a, b in steps:
                now = h((a, now, b))
            out.append((r[0], leaf, subroots[i], root, h(a + b for a, b in steps), now, now == root))
    return sorted(out, key=str)


LONG_WORD = "xq7" * 9000
MESSY_URLS = [
    (9001, None), (9002, ""), (9003, "no scheme example.net/de/"), (9004, "http://EXAMPLE.Net/en/1"), (9005, "http://example.net/EN/1"), (9006, "https://net/x"), (9007, "https://anet/x"),
    (9008, "http://a.org/fr/?q=http://b.net/"), (9009, "http://x.example.com/de/5#a?b/c"), (9010, "http://x.net"), (9011, "http://x.net?a=/"), (9012, "http://x.net:80/a"), (9013, "://net/"),
    (9014, "http://u@x.net/#/en/"), (9015, "http://ex\u00c4mple.NET/d\u00e9/\n?x"), (9016, "http://x.org/" + "a-1/" * 20000 + "?b=" + "c&d=" * 5000), (9016, "http://x.org/"), (None, "http://y.net/"),
    (9017, "ftp://www.example.net/en/a.b/c.tar.gz"), (9018, "http:///fr/"), (9019, "http://org./fr/"),
]
_V = [0.5, -0.25, 0.125, 0.3]
MESSY_VECTORS = [
    (7000, 1, _V), (7000, 1, _V), (7000, 2, _V), (7100, 1, [0.5]), (7101, 1, []), (7200, 3, []), (7102, None, _V), (7103, 1, None), (7104, 1, [float("nan"), 1.0]), (7105, 1, [float("inf")]),
    (7106, 1, [None, 1.0]), (7300, 4, [-1.0] * 8), (7301, 2, [0.25, -0.125]), (7302, 2, [0.25, -0.125]), (7303, 2, [0.25, -0.125]), (7400, 10, [0.7] * 4), (7401, 10, [0.7] * 4), (-100, 1, _V),
    (7402, 9, [3e38] * 2), (7500, 5, [0.1] * 70),
]
MESSY = [
    (900001, None), (900002, ""), (900003, " \t\n\x0b\x0c\r "), (900004, "a"), (900005, "two words"), (900006, "same same same same same same"), (900007, "same same same same same same"),
    (900008, LONG_WORD), (900009, "1.2.3.4@example.com 0.0.0.0 1.2.3.4.5.6.7.8 999.1.1.1 a@b.c x@y a@b@c.d.e 4111 1111 1111 1111 4111-1111-1111-1112 +1 (609) 555-7932 +12 " + "9" * 40),
    (900010, "Straße ÉCOLE naïve ﬁ ①②  x y　z é İstanbul ΑΣ 日本語 テスト \U0001f600 <|endoftext|> don't I'LL"), (900011, "<|startoftext|><|endoftext|>"),
    (900012, "\x00nul \x1f\x1c sep \x85 nel"), (900013, "i d i o t s.t.u.p.i.d m0r0n"), (900014, "RIFF\x10\x00\x00\x00WAVE BM \x89PNG GIF89a %PDF- PK\x03\x04"), (900015, "привет мир это русский текст"),
    (None, "a row without an id"), (900016, "1234567890123 " * 3000),
]
