"""Token counts: a broadcast table of frequent pre-token lengths, and worker caches for the rest.

A text's count is the sum of its pre-tokens' lengths in tokens. Pass one keeps, in each task, a Misra-Gries summary of
at most SUMMARY pre-tokens and emits only those; their sum over tasks ranks the frequent ones, of which at most TABLE
are encoded and broadcast (its size is bounded by that parameter). Pass two counts in place: the first tier is the
broadcast table, the second a bounded cache in each worker, filled by encoding the misses. No pre-token of the corpus
is shuffled; only the bounded summaries are.

Cases: null has 0 bytes and 0 tokens, as the empty text; very long texts are summed in one go, very long pre-tokens
are encoded whole but not cached; ties of frequency are broken by the pre-token itself and never change a count;
repeated rows and an empty table need no care; only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import groups, vocabulary

#: Pre-tokens that a task's summary keeps.
SUMMARY = 8192
#: Entries of the broadcast table at most.
TABLE = 65_536
#: Entries of a worker's cache; at the bound it starts anew.
CACHE = 400_000
#: Longer pre-tokens are not cached, nor put in the table.
LONG = 64
#: The byte-level pre-tokenizer's pattern for texts of Latin letters; other texts are split by the library.
_LATIN = re.compile(r"[\x00-~\xa0-ɏ]*\Z")
_SPLIT = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+| ?[0-9²³¹¼-¾]+| ?[^\sA-Za-z0-9ªµºÀ-ÖØ-öø-ɏ²³¹¼-¾]+|\s+(?!\S)|\s+"
)
#: White space to Python, but not to the pattern.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


class Counts:
    """A byte-level vocabulary's pre-tokens and their lengths."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.cache: dict[str, int] = {}
        # the longest first, as one may begin another
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pre_tokens(self, text: str) -> list[str]:
        if self.special_split and any(s in text for s in self.special):
            return [p for part in self.special_split.split(text) if part for p in ([part] if part in self.special else self._split(part))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if _LATIN.match(text) and not _ODD_SPACE.search(text):
            return _SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def lengths(self, pre_tokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(pre_tokens, add_special_tokens=False)]


def load(path: str) -> Counts:
    return common.worker_state(("counts", path), lambda: Counts(path))


def shrink(counts: Counter, size: int) -> Counter:
    """A Misra-Gries step: subtract the (size+1)-th largest count from all and keep what is positive."""
    if len(counts) <= size:
        return counts
    cut = sorted(counts.values(), reverse=True)[size]
    return Counter({k: v - cut for k, v in counts.items() if v > cut})


def frequent(docs: DataFrame, path: str, text_col: str = "text", summary: int = SUMMARY, table: int = TABLE) -> dict[str, int]:
    """The most frequent pre-tokens and their lengths, at most `table` of them, from summaries of all texts."""

    def run(batches):
        vocabulary_, kept = load(path), Counter()
        for batch in batches:
            for t in common.texts(batch, text_col):
                kept.update(vocabulary_.pre_tokens(t))
                if len(kept) > 64 * summary:
                    kept = shrink(kept, summary)
        kept = {k: v for k, v in shrink(kept, summary).items() if len(k) <= LONG}
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], ["pre_token", "n"])

    rows = docs.select(text_col).mapInArrow(run, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))
    top = [r.pre_token for r in rows.orderBy(F.desc("n"), "pre_token").limit(table).collect()]
    return dict(zip(top, load(path).lengths(top)))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", table: dict[str, int] | None = None, limit: int = 512) -> DataFrame:
    """Per text: id, n_bytes, n_tokens, over_limit. `table` is the first tier; by default it is built from docs."""
    common.small_batches(docs.sparkSession)
    first = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, text_col) if table is None else table)

    def run(batches):
        vocabulary_, tier1 = load(path), first.value
        tier2 = vocabulary_.cache
        for batch in batches:
            text = common.texts(batch, text_col)
            totals: list[int] = []
            for a, b in groups(text):
                lists = [vocabulary_.pre_tokens(t) for t in text[a:b]]
                if len(tier2) > CACHE:
                    tier2.clear()
                misses = {p for pre in lists for p in pre if p not in tier1 and p not in tier2}
                new = list(misses)
                found = dict(zip(new, vocabulary_.lengths(new)))
                tier2.update((k, v) for k, v in found.items() if len(k) <= LONG)
                extra = {k: v for k, v in found.items() if len(k) > LONG}
                for pre in lists:
                    totals.append(sum([tier1.get(p) or tier2.get(p) or extra[p] for p in pre]))
            n_bytes = [len(t.encode()) for t in text]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(n_bytes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
