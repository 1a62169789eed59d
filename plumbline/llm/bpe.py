"""BPE encoding and decoding: merges picked by a segment tree over the ranks of adjacent pairs.

The leaves hold the rank of the pair that starts at each symbol, the root the least (rank, position), which is
the leftmost lowest-rank merge. A merge rewrites at most three leaves and their paths, so a pre-token of n symbols
costs O(n log n). Many short pre-tokens are done together, one tree per row of a matrix.

Cases: null is the empty text, and the empty text has no ids and decodes to the empty text; very long runs of one
class use the scalar tree; equal ranks go left to right; an empty table gives an empty result; every document gets
a row, repeated rows too; only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Rank of a leaf whose pair cannot merge; with WIDE leaves, a node's value stays below 2**31.
NONE = np.int32(1 << 24)
#: Entries of the younger half of a worker's chunk cache; at the bound it becomes the older half.
CACHE = 250_000
#: Pre-tokens of more symbols than this use the scalar tree.
WIDE = 64
_ASCII_SPACE = re.compile(r"[ \t\n\v\f\r]+")
#: Chunks of these characters are split here; all others by the library's own normalizer and pre-tokenizer.
_PLAIN = re.compile(r"[!-~¡-¬®-ÖØ-öø-ɏ]*\Z")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼-¾]|[^a-z0-9ªµºß-öø-ɏ²³¹¼-¾]+")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return [table[b] for b in range(256)]


class Bpe:
    """A byte-level BPE vocabulary with word ends, and its merges as a sorted pair table."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # the longest first, as one may begin another; without special tokens the pattern matches nowhere
        self.special_split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.special_start = commonprefix(list(self.special))
        self.suffix = model["end_of_word_suffix"] or ""
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = np.array([""] * size, dtype=object)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int32)
        self.last = np.array([vocab[s + self.suffix] for s in symbols], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.by_rank = made.astype(np.int32)
        self.lookup = dict(zip(keys.tolist(), range(len(keys))))
        self._fill(keys)
        self.library = Tokenizer.from_file(path)
        self.caches: dict[str, tuple[dict, dict]] = {}

    # ------------------------------------------------------------------ merging
    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.log)).astype(np.int64)

    def _fill(self, keys: np.ndarray) -> None:
        """Hash table of the pairs' ranks with linear probing; probes is the longest way to a pair."""
        self.log = max(10, int(len(keys)).bit_length() + 2)
        self.table_key = np.full((1 << self.log) + 64, -1, dtype=np.int64)
        self.table_rank = np.full(len(self.table_key), NONE, dtype=np.int32)
        self.probes = 1
        for rank, (slot, key) in enumerate(zip(self._slot(keys).tolist(), keys.tolist())):
            at = slot
            while self.table_key[at] >= 0:
                at += 1
            self.table_key[at], self.table_rank[at] = key, rank
            self.probes = max(self.probes, at - slot + 1)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; a negative symbol is no symbol."""
        key = a.astype(np.int64) << 20 | b
        key[(a < 0) | (b < 0)] = -2
        slot = self._slot(key)
        found = self.table_key[slot]
        rank = np.where(found == key, self.table_rank[slot], NONE)
        open_ = np.nonzero((found != key) & (found >= 0))
        for _ in range(1, self.probes):
            if not open_[0].size:
                break
            slot[open_] += 1
            found = self.table_key[slot[open_]]
            hit = found == key[open_]
            rank[tuple(o[hit] for o in open_)] = self.table_rank[slot[open_][hit]]
            open_ = tuple(o[~hit & (found >= 0)] for o in open_)
        return rank

    def merge_one(self, ids: list[int]) -> list[int]:
        """Merge the symbols of one pre-token with one segment tree."""
        n, leaves = len(ids), 1
        while leaves < n:
            leaves *= 2
        none, find, ids = int(NONE), self.lookup.get, list(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            tree[leaves + i] = find(ids[i] << 20 | ids[i + 1], none)
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, rank: int) -> None:
            i += leaves
            tree[i] = rank
            while i > 1:
                i //= 2
                least = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == least:
                    break
                tree[i] = least

        while tree[1] != none:
            rank, i = tree[1], 1
            while i < leaves:
                i = 2 * i if tree[2 * i] == rank else 2 * i + 1
            i -= leaves
            j = right[i]
            ids[i], ids[j], right[i] = int(self.by_rank[rank]), -1, right[j]
            put(j, none)
            if right[i] < n:
                left[right[i]] = i
                put(i, find(ids[i] << 20 | ids[right[i]], none))
            else:
                put(i, none)
            if left[i] >= 0:
                put(left[i], find(ids[left[i]] << 20 | ids[i], none))
        return [x for x in ids if x >= 0]

    def _merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """Merge many pre-tokens of at most WIDE symbols: ids is rows x leaves, padded with -1. In place."""
        rows, leaves = ids.shape
        col = np.arange(leaves, dtype=np.int32)
        left = np.broadcast_to(col - 1, ids.shape).copy()
        right = np.broadcast_to(col + 1, ids.shape).copy()
        # a node holds rank * leaves + position, so that its minimum is leftmost among equal ranks
        tree = np.full((rows, 2 * leaves), NONE * leaves, dtype=np.int32)
        if leaves > 1:
            tree[:, leaves:-1] = self._ranks(ids[:, :-1], ids[:, 1:]) * leaves + col[:-1]
        width = leaves // 2
        while width:
            tree[:, width : 2 * width] = np.minimum(tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2])
            width //= 2
        live = np.nonzero(tree[:, 1] < NONE * leaves)[0]

        def put(r: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
            i = i + leaves
            tree[r, i] = value
            while i.size and i[0] > 1:
                i = i >> 1
                tree[r, i] = np.minimum(tree[r, 2 * i], tree[r, 2 * i + 1])

        while live.size:
            root = tree[live, 1]
            rank, i = root // leaves, root % leaves
            j = right[live, i]
            merged = self.by_rank[rank]
            after = right[live, j]
            ids[live, i], ids[live, j], right[live, i] = merged, -1, after
            put(live, j, np.full(live.size, NONE * leaves, dtype=np.int32))
            inside = after < leaves
            after_id = np.where(inside, ids[live, np.minimum(after, leaves - 1)], -1)
            left[live[inside], after[inside]] = i[inside]
            put(live, i, self._ranks(merged, after_id) * leaves + i)
            before = left[live, i]
            has = before >= 0
            if has.any():
                r, b = live[has], before[has]
                put(r, b, self._ranks(ids[r, b], merged[has]) * leaves + b)
            live = live[tree[live, 1] < NONE * leaves]
        return ids

    def merge_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the pre-tokens, given as bytes, end to end, and where each one's begin, with the end."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        sizes = np.zeros(len(words) + 1, dtype=np.int64)
        pieces: list[tuple[np.ndarray, np.ndarray]] = []
        for k in np.nonzero(lengths > WIDE)[0]:
            raw = np.frombuffer(words[k], dtype=np.uint8)
            ids = np.array(self.merge_one([*self.inner[raw[:-1]].tolist(), int(self.last[raw[-1]])]), dtype=np.int32)
            sizes[k + 1] = len(ids)
            pieces.append((np.array([k]), ids))
        width = np.where((lengths > 0) & (lengths <= WIDE), 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64), 0)
        for leaves in np.unique(width[width > 0]):
            at = np.nonzero(width == leaves)[0]
            own = lengths[at]
            ids = np.full((len(at), leaves), -1, dtype=np.int32)
            raw = np.frombuffer(b"".join([words[k] for k in at.tolist()]), dtype=np.uint8)
            ids[np.arange(leaves) < own[:, None]] = self.inner[raw]
            ids[np.arange(len(at)), own - 1] = self.last[raw[np.cumsum(own) - 1]]
            self._merge_rows(ids)
            kept = ids >= 0
            sizes[at + 1] = kept.sum(axis=1)
            pieces.append((at, ids[kept]))
        starts = np.cumsum(sizes)
        out = np.empty(starts[-1], dtype=np.int32)
        for at, ids in pieces:
            n = sizes[at + 1]
            out[np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(len(ids))] = ids
        return out, starts

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each pre-token, given as bytes."""
        ids, starts = self.merge_flat(words)
        flat, cuts = ids.tolist(), starts.tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    # ------------------------------------------------------------------ chunks
    def _pieces(self, chunk: str) -> list[str | bytes]:
        """Pre-tokens of a chunk without white space, as bytes; special tokens stay text."""
        found: list[str | bytes] = []
        start = 0
        for m in [*self.special_split.finditer(chunk), None] if self.special_start in chunk else [None]:
            part = chunk[start : m.start() if m else len(chunk)]
            if part and _PLAIN.match(part):
                low = part.lower()
                if low.isascii() or unicodedata.is_normalized("NFC", low):
                    found += [p.encode() for p in _SPLIT.findall(low)]
                else:
                    found += self._by_library(part)
            elif part:
                found += self._by_library(part)
            if m:
                found.append(m[0])
                start = m.end()
        return found

    def _by_library(self, part: str) -> list[bytes]:
        back = _from_symbols()
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return [bytes(back[c] for c in piece) for piece, _ in split]

    def _chunk_pieces(self, chunks: list[str]) -> list[list[str | bytes]]:
        return [[c.lower().encode()] if c.isascii() and c.isalpha() else self._pieces(c) for c in chunks]

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk; a chunk is text between ASCII white space."""
        pieces = self._chunk_pieces(chunks)
        distinct = list({p for c in pieces for p in c if isinstance(p, bytes)})
        known: dict[str | bytes, list[int]] = {**dict(zip(distinct, self.merge(distinct))), **{s: [i] for s, i in self.special.items()}}
        return [known[c[0]] if len(c) == 1 else [i for p in c for i in known[p]] for c in pieces]

    def encode_packed(self, chunks: list[str], kind: np.dtype) -> list[bytes]:
        """The same as packed numbers."""
        pieces = self._chunk_pieces(chunks)
        distinct = list({p for c in pieces for p in c if isinstance(p, bytes)})
        ids, starts = self.merge_flat(distinct)
        raw, cuts = ids.astype(kind).tobytes(), (starts * kind.itemsize).tolist()
        known: dict[str | bytes, bytes] = {**{p: raw[a:b] for p, a, b in zip(distinct, cuts, cuts[1:])}, **{s: np.array([i], kind).tobytes() for s, i in self.special.items()}}
        return [known[c[0]] if len(c) == 1 else b"".join([known[p] for p in c]) for c in pieces]

    def encode(self, text: str) -> list[int]:
        return [i for c in self.encode_chunks([c for c in _ASCII_SPACE.split(text) if c]) for i in c]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by a space, as a vocabulary without a decoder decodes them."""
        return " ".join(self.tokens[ids].tolist()) if len(ids) else ""


_BACK: dict[str, int] = {}


def _from_symbols() -> dict[str, int]:
    if not _BACK:
        _BACK.update({s: b for b, s in enumerate(_byte_symbols())})
    return _BACK


def load(path: str) -> Bpe:
    """The vocabulary, read once in each Python worker."""
    return common.worker_state(("bpe", path), lambda: Bpe(path))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunk_lists(texts: list[str]) -> list[list[str]]:
    """Each text's chunks between ASCII white space."""
    out = []
    for t in texts:
        for c in "\n\t\r\v\f":
            if c in t:
                t = t.replace(c, " ")
        out.append([c for c in t.split(" ") if c] if "  " in t or t[:1] == " " or t[-1:] == " " else t.split(" ") if t else [])
    return out


def values_of(codec: Bpe, what: str, lists: list[list[str]], compute, bound: int = CACHE) -> list[list]:
    """What compute gives for each chunk, through the worker's cache; a chunk is looked up once if it is there. At the
    bound the younger half of the cache becomes the older one, from which chunks come back when they are met again."""
    young, old = codec.caches.setdefault(what, ({}, {}))
    if len(young) > bound:
        young, old = codec.caches[what] = {}, young
    found = [list(map(young.get, chunks)) for chunks in lists]
    holes = [i for i, values in enumerate(found) if None in values]
    new = []
    for c in {c for i in holes for c, v in zip(lists[i], found[i]) if v is None}:
        value = old.get(c)
        if value is None:
            new.append(c)
        else:
            young[c] = value
    for start in range(0, len(new), 20_000):
        part = new[start : start + 20_000]
        young.update(zip(part, compute(part)))
    for i in holes:
        found[i] = [young[c] if v is None else v for c, v in zip(lists[i], found[i])]
    return found


def groups(items: list[str], size: int = 1 << 21):
    """Index ranges of consecutive texts of about size characters."""
    start = total = 0
    for i, t in enumerate(items):
        if total and total + len(t) > size:
            yield start, i
            start, total = i, 0
        total += len(t)
    if items:
        yield start, len(items)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode every text: id, n_tokens, ids_sha256, decoded_sha256; keep_ids adds the ids themselves."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        bpe = load(path)

        def compute(chunks):
            for ids in bpe.encode_chunks(chunks):
                yield len(ids), " ".join(map(str, ids)).encode(), bpe.decode(ids).encode()

        for batch in batches:
            text = common.texts(batch, text_col)
            rows: list[tuple] = []
            for a, b in groups(text):
                for parts in values_of(bpe, "digest", chunk_lists(text[a:b]), compute):
                    parts = [p for p in parts if p[0]]  # some characters have no id
                    ids = b" ".join([p[1] for p in parts])
                    rows.append((sum([p[0] for p in parts]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(b" ".join([p[2] for p in parts])).hexdigest(), ids.decode() if keep_ids else None))
            columns = [batch.column(id_col), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array([[int(x) for x in r[3].split()] for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(common.documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
