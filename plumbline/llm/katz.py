"""Language-model scoring by Katz backoff over words: Good-Turing discounted counts, exactly normalised backoff weights.

P(w | v) = d(r) r / (C(v) + RESERVE) for a bigram seen r times after v, and a(v) P(w) otherwise, with
a(v) = (1 - sum of the seen) / (1 - sum of P over the seen). P(w) = d(r) r / (N + RESERVE) for a word seen r times; what
is left is the probability of any unknown word. Discounts d follow Good-Turing up to K counts; RESERVE keeps every
weight positive, and both levels sum to one exactly. A document is preceded by an end mark and closed by one.

Counts travel as packed blobs, not as a row for each token:
1. each task tokenises its documents into blocks of about BLOCK characters, writes a block to the shared folder and
   deals its distinct words by hash; a partition of the unigram table sums their training counts and answers each block;
2. each block deals its distinct bigrams with their places by the context's hash, frequent contexts over several
   partitions; a partition of the bigram table sums counts, scores all places and keeps, for unseen bigrams, what the
   context's weight needs. The places of a bigram that a block holds more than PLACES times stay with the block, which
   gets the bigram's value back: no partition holds all places of a frequent bigram;
3. discounts and the weights of split contexts (at most one for each partition) are broadcast, and each block's
   documents are summed up.
Every step is linear in the tokens, blobs are bounded by the block, partitions grow in number with the input, and a
task that is run again writes under a new name, so that only names in finished results count.

Cases: null and empty texts have one token, the end; very long texts make a block of their own; repeated rows are scored
and counted each; without training rows every word is unknown with probability 1; an empty table gives an empty
result; rows without an id are held out, and marked so; only the id and text columns are read, so further columns cannot
clash. Words are told apart exactly; within
one context, bigrams are told apart by 48 bits of the second word's hash.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters of a block, and tokens that a partition of the bigram table gets on average.
BLOCK = 14_000_000
PARTITION_TOKENS = 2_500_000
#: Counts up to K are discounted.
K = 5
RESERVE = 0.01
#: A context is split if it has more than this many average partitions' tokens.
SPLIT = 0.25
#: Places of a bigram in one block above which they stay in the block, and only the bigram's value comes back.
PLACES = 64


def pack(*parts) -> bytes:
    """Arrays (bytes of equal weight together) and other values as one compressed blob."""
    out = []
    for a in parts:
        if isinstance(a, np.ndarray):
            a = np.ascontiguousarray(a)
            out.append((a.dtype.str, a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""))
        else:
            out.append((None, a))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(out, 5))


def unpack(blob: bytes) -> list:
    out = []
    for kind, a in pickle.loads(zstandard.ZstdDecompressor().decompress(blob)):
        if kind is None:
            out.append(a)
        else:
            kind = np.dtype(kind)
            out.append(np.ascontiguousarray(np.frombuffer(a, np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind))
    return out


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing discounts of counts 1 to K from the numbers n[r] of items seen r times, kept inside (0, 1)."""
    d = np.full(K + 1, 1.0)
    common_ = (K + 1) * n[K + 1] / n[1] if n[1] else 0.0
    for r in range(1, K + 1):
        better = (r + 1) * n[r + 1] / n[r] / r if n[r] else 1.0
        d[r] = (better - common_) / (1 - common_) if common_ < 1 else 1.0
    return np.clip(d, 0.02, 0.99)


class Unigrams:
    """Word probabilities from counts."""

    def __init__(self, total: int, distinct: int, n: list[int]):
        self.total, self.distinct, self.d = total, distinct, discounts(n)
        kept = total - sum(r * n[r] * (1 - self.d[r]) for r in range(1, K + 1))
        self.unknown = 1.0 - kept / (total + RESERVE)

    def p(self, count: np.ndarray) -> np.ndarray:
        low = self.d[np.minimum(count, K)]
        return np.where(count == 0, self.unknown, np.where(count > K, 1.0, low) * count / (self.total + RESERVE))


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], dtype=np.uint64)


def _batch(names: list[str], kinds: list, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


_ROW = (["part", "block", "blob"], [pa.int32(), pa.string(), pa.binary()])
_SCHEMA = "part int, block string, blob binary"


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(*_ROW, [list(c) for c in zip(*rows)] if rows else [[], [], []])])


def deal_words(docs: DataFrame, train: Column, folder: str, parts: int, id_col: str, text_col: str) -> DataFrame:
    """Step 1: writes blocks and returns each block's distinct words for each partition of the unigram table."""

    def run(batches):
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def finish(ids, lists, flags):
            index: dict[bytes, int] = {b"": 0}
            at = [index.setdefault(w, len(index)) for words in lists for w in (*words, b"")]
            tokens, sizes, flag = np.array(at, np.uint32), np.array([len(x) + 1 for x in lists], np.uint32), np.array(flags, np.uint8)
            words = list(index)
            n = np.bincount(tokens[np.repeat(flag, sizes) == 1], minlength=len(words)).astype(np.uint32)
            name = uuid.uuid4().hex
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(pack(tokens, sizes, flag, ids, b" ".join(words)))
            part = (hashes(words) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cuts = np.concatenate([[0], np.nonzero(np.diff(part[order]))[0] + 1, [len(order)]])
            rows = [(int(part[order[a]]), name, pack(b" ".join([words[i] for i in order[a:b]]), n[order[a:b]])) for a, b in zip(cuts, cuts[1:])]
            return _batch(*_ROW, [list(c) for c in zip(*rows)])

        ids, lists, flags, size = [], [], [], 0
        for batch in batches:
            for key, text, flag in zip(batch.column(id_col).to_pylist(), common.texts(batch, text_col), batch.column("train").to_pylist()):
                if ids and size + len(text) > BLOCK or len(ids) >= 60_000:
                    yield finish(ids, lists, flags)
                    ids, lists, flags, size = [], [], [], 0
                ids.append(key)
                lists.append(words_of(text))
                flags.append(bool(flag))
                size += len(text)
        if ids:
            yield finish(ids, lists, flags)

    return docs.select(id_col, text_col, train.alias("train")).mapInArrow(run, _SCHEMA)


def count_words(table: pa.Table) -> pa.Table:
    """One partition of the unigram table: sums counts, answers each block, and adds a row of totals (block '')."""
    total: dict[bytes, int] = {}
    asked = []
    for part, block, blob in zip(*(table.column(c).to_pylist() for c in _ROW[0])):
        words, n = unpack(blob)
        words = words.split(b" ")
        for w, k in zip(words, n.tolist()):
            total[w] = total.get(w, 0) + k
        asked.append((part, block, words))
    get = total.__getitem__
    rows = [(part, block, pack(np.array([get(w) for w in words], np.uint32))) for part, block, words in asked]
    count = np.array(list(total.values()), dtype=np.int64)
    rows.append((asked[0][0], "", pack(int(count.sum()), int((count > 0).sum()), np.bincount(np.minimum(count, K + 2), minlength=K + 3).tolist())))
    return _table(rows)


def deal_bigrams(folder: str, parts1: int, parts2: int, unigrams: Unigrams):
    """Step 2, for one block: its bigrams with contexts, counts and places, for each partition of the bigram table."""
    average = max(1.0, unigrams.total / parts2)

    def run(table: pa.Table) -> pa.Table:
        store, base = pafs.FileSystem.from_uri(folder)
        name = table.column("block")[0].as_py()
        with store.open_input_stream(f"{base}/{name}") as source:
            tokens, sizes, flag, ids, words = unpack(source.read())
        h = hashes(words.split(b" "))
        order = np.argsort((h % np.uint64(parts1)).astype(np.int32), kind="stable")
        answers = sorted(zip(table.column("part").to_pylist(), table.column("blob").to_pylist()))
        c = np.empty(len(h), np.uint32)
        c[order] = np.concatenate([unpack(b)[0] for _, b in answers])
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        known = np.add.reduceat((c > 0)[tokens].astype(np.int64), starts)
        base_sum = np.add.reduceat(np.log10(c + 1.0)[tokens], starts)
        rows, frequent = [], []

        width = np.int64(len(h))
        key = np.concatenate([[0], tokens[:-1]]).astype(np.int64) * width + tokens
        doc = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
        at = np.argsort(key, kind="stable")
        key, doc = key[at], doc[at]
        first = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1])
        n_train = np.add.reduceat(flag[doc].astype(np.uint32), first).astype(np.uint32)
        places = np.diff(np.append(first, len(key)))
        context, word = key[first] // width, key[first] % width
        del key, at
        low = h & np.uint64((1 << 48) - 1)
        share = c[context] / average
        ways = np.where(share > SPLIT, np.ceil(share / SPLIT), 1).astype(np.uint64)
        part = ((h[context] % np.uint64(parts2) + low[word] % np.minimum(ways, np.uint64(parts2))) % np.uint64(parts2)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        cuts = np.concatenate([[0], np.nonzero(np.diff(part[order]))[0] + 1, [len(order)]])
        for a, b in zip(cuts, cuts[1:]):
            own = order[a:b]
            of = context[own]
            new = np.concatenate([[0], np.nonzero(np.diff(of))[0] + 1])
            held = np.where(places[own] > PLACES, 0, places[own])
            frequent.append(own[held == 0])
            spot = np.repeat(first[own] - np.cumsum(held) + held, held) + np.arange(held.sum())
            split = (ways[own[new]] > 1).astype(np.uint8)
            second = low[word[own]]
            rows.append((int(part[own[0]]), name, pack(
                "bigrams", h[of[new]], c[of[new]], split, np.diff(np.append(new, len(of))).astype(np.uint32), (second & np.uint64(0xFFFFFFFF)).astype(np.uint32),
                (second >> np.uint64(32)).astype(np.uint16), c[word[own]], n_train[own], held.astype(np.uint32), doc[spot])))
        own = np.concatenate(frequent)
        held = places[own]
        spot = np.repeat(first[own] - np.cumsum(held) + held, held) + np.arange(held.sum())
        pair, times = np.unique(np.repeat(np.arange(len(own), dtype=np.int64), held) << 16 | doc[spot], return_counts=True)
        meta = pack("meta", ids, sizes, flag, known, base_sum, (pair >> 16).astype(np.uint32), (pair & 0xFFFF).astype(np.uint16), times.astype(np.uint32))
        rows.append((int(xxhash.xxh3_64_intdigest(name) % parts2), name, meta))
        return _table(rows)

    return run


def count_bigrams(unigrams: Unigrams):
    """One partition of the bigram table: sums counts and scores all places; a row of totals has block ''."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        rows, held = [], []
        for block, blob in zip(table.column("block").to_pylist(), table.column("blob").to_pylist()):
            parts = unpack(blob)
            if parts[0] == "meta":
                rows.append((part, block, blob))
            else:
                held.append((block, parts[1:]))
        if not held:
            return _table(rows)
        context = np.concatenate([np.repeat(p[0], p[3]) for _, p in held])
        size = np.concatenate([np.repeat(p[1], p[3]) for _, p in held]).astype(np.int64)
        split = np.concatenate([np.repeat(p[2], p[3]) for _, p in held])
        second = np.concatenate([p[4].astype(np.uint64) | p[5].astype(np.uint64) << np.uint64(32) for _, p in held])
        word = np.concatenate([p[6] for _, p in held]).astype(np.int64)
        n_train = np.concatenate([p[7] for _, p in held]).astype(np.int64)
        order = np.lexsort((second, context))
        context_, second_ = context[order], second[order]
        new = np.concatenate([[True], (context_[1:] != context_[:-1]) | (second_[1:] != second_[:-1])])
        first = np.nonzero(new)[0]
        sums = np.add.reduceat(n_train[order], first)
        count = np.empty(len(order), np.int64)
        count[order] = sums[np.cumsum(new) - 1]
        del second, second_, n_train
        # contexts: totals over their distinct bigrams
        p_word = unigrams.p(word)
        start = np.concatenate([[True], context_[1:] != context_[:-1]])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(start) - 1
        n_contexts = int(start.sum())
        item = which[order[first]]
        seen = sums > 0
        stats = np.stack(
            [np.bincount(item, np.where(sums > K, sums, 0), n_contexts), *(np.bincount(item, sums == r, n_contexts) for r in range(1, K + 1)), np.bincount(item, np.where(seen, p_word[order[first]], 0.0), n_contexts)], axis=1
        )
        c_size, c_hash, c_split = size[order][start], context_[start], split[order][start]
        del context, context_, order
        value = np.where(count > 0, np.log10(np.maximum(count, 1)) - np.log10(size + RESERVE), np.log10(p_word))
        backs = (count == 0) & (size > 0)
        a = 0
        for block, p in held:
            b = a + len(p[6])
            times, doc = p[8], p[9]
            docs, at = np.unique(doc, return_inverse=True)
            total = np.bincount(at, np.repeat(value[a:b], times))
            rank = np.repeat(np.where(count[a:b] > K, 0, count[a:b]), times)
            ranks = np.bincount(at * (K + 1) + rank, minlength=len(docs) * (K + 1)).reshape(-1, K + 1)[:, 1:].astype(np.uint32)
            back = np.repeat(backs[a:b], times)
            stay = times == 0
            stay_rank, stay_back = np.where(count[a:b] > K, 0, count[a:b])[stay].astype(np.uint8), backs[a:b][stay]
            own, record = np.unique(np.concatenate([np.repeat(which[a:b], times)[back], which[a:b][stay][stay_back]]), return_inverse=True)
            rows.append((part, block, pack(
                "sums", docs, total, ranks.reshape(-1), doc[back], record.astype(np.uint32), np.where(c_split[own], c_hash[own], 0).astype(np.uint64), c_size[own], stats[own].T.reshape(-1),
                value[a:b][stay], stay_rank, stay_back.astype(np.uint8))))
            a = b
        whole = np.bincount(np.minimum(sums, K + 2), minlength=K + 3).tolist()
        apart = np.nonzero(c_split)[0]
        rows.append((part, "", pack(whole, {int(c_hash[i]): (int(c_size[i]), stats[i].tolist()) for i in apart})))
        return _table(rows)

    return run


def weights(size: np.ndarray, stats: np.ndarray, d: np.ndarray) -> np.ndarray:
    """log10 of the backoff weights of contexts, from rows of (sum of counts over K, numbers seen 1 to K, sum of P)."""
    kept = (stats[:, 0] + stats[:, 1 : K + 1] @ (np.arange(1, K + 1) * d[1:])) / (size + RESERVE)
    return np.log10((1 - kept) / (1 - stats[:, K + 1]))


def finish(d: np.ndarray, split: dict[int, float], total: int, distinct: int, id_col: str, id_type: pa.DataType):
    """Step 3, for one block: its documents' sums."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(b) for _, b in sorted(zip(table.column("part").to_pylist(), table.column("blob").to_pylist()))]
        _, ids, sizes, flag, known, base_sum, pair, pair_doc, pair_times = next(p for p in parts if p[0] == "meta")
        score, came_back, lost = np.zeros(len(sizes)), [], np.append(0.0, np.log10(d[1:]))
        for p in parts:
            if p[0] == "sums":
                _, docs, own, ranks, back, record, hashed, size, stats, stay, stay_rank, stay_back = p
                score[docs] += own + ranks.reshape(-1, K) @ np.log10(d[1:])
                stay = stay + lost[stay_rank]
                if len(record):
                    weight = weights(size, stats.reshape(K + 2, -1).T, d)
                    for i in np.nonzero(hashed)[0]:
                        weight[i] = split[int(hashed[i])]
                    np.add.at(score, back, weight[record[: len(back)]])
                    stay[stay_back == 1] += weight[record[len(back) :]]
                came_back.append(stay)
        if len(pair):
            np.add.at(score, pair_doc, pair_times * np.concatenate(came_back)[pair])
        n = sizes.astype(np.int64)
        base = base_sum - n * np.log10(total + distinct + 1.0)
        columns = [pa.array(ids, id_type), pa.array(flag == 0), pa.array(n), pa.array(known), pa.array(np.full(len(n), total, np.int64)), pa.array(base), pa.array(score)]
        return pa.Table.from_arrays(columns, [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def katz_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: id, held_out, n_tokens, n_known, train_tokens, base_score, score; learnt from the rows where train holds."""
    spark = docs.sparkSession
    common.small_batches(spark)
    folder = common.shared_dir(spark, "katz-blocks")
    parts1 = max(8, docs.rdd.getNumPartitions())
    dealt = deal_words(docs, train, folder, parts1, id_col, text_col)
    counted = common.materialize(dealt.repartitionById(parts1, "part").groupBy("part").applyInArrow(count_words, _SCHEMA), "katz-words", "uncompressed")
    total, distinct, n, size = 0, 0, np.zeros(K + 3, dtype=np.int64), 0
    for r in counted.filter("block = ''").select("blob").collect():  # a row of totals for each partition
        t, v, by_count = unpack(r["blob"])
        total, distinct, n = total + t, distinct + v, n + np.array(by_count)
    unigrams = Unigrams(total, distinct, n.tolist())
    parts2 = max(8, -(-total // PARTITION_TOKENS))

    answers = counted.filter("block <> ''").repartition(parts1, "block").groupBy("block")
    bigrams = answers.applyInArrow(deal_bigrams(folder, parts1, parts2, unigrams), _SCHEMA)
    scored = common.materialize(bigrams.repartitionById(parts2, "part").groupBy("part").applyInArrow(count_bigrams(unigrams), _SCHEMA), "katz-bigrams", "uncompressed")
    n, split = np.zeros(K + 3, dtype=np.int64), {}
    for r in scored.filter("block = ''").select("blob").collect():  # totals, and the few contexts that were split
        whole, apart = unpack(r["blob"])
        n += np.array(whole)
        for k, (size, stats) in apart.items():
            split[k] = (size, np.array(stats) + split[k][1]) if k in split else (size, np.array(stats))
    d = discounts(n.tolist())
    final = {k: float(weights(np.array([size]), stats[None, :], d)[0]) for k, (size, stats) in split.items()}
    kind = docs.schema[id_col].dataType.simpleString()
    ids = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    schema = f"{id_col} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return scored.filter("block <> ''").repartition(parts1, "block").groupBy("block").applyInArrow(finish(d, final, total, distinct, id_col, ids), schema)


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(common.documents(spark, sf_dir), common.remainder("doc_id", 7) != 2)
