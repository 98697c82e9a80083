"""Token counts without ids: pieces are counted once per distinct pre-token, joined to frequencies and summed.

No piece of the vocabulary holds a space marker after another character, so a text can be cut before each run of spaces and
the pre-tokens counted on their own. A first pass gathers the distinct pre-tokens and how often they occur. The most frequent,
a bounded number, are counted once by the library, and this table is sent to every worker, where each document's frequencies
are joined to it. A pre-token that occurs once is counted where it stands, which is once too; so are those between, whose few
occurrences would cost more as shuffled rows than their counting, and those too long to be kept.
A vocabulary that breaks the rule of spaces, and any .json tokenizer, is counted text by text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.llm.common import bounded_batches, cut, map_texts, text_of

#: Bytes of the longest pre-token that is kept in the table.
LONGEST = 64
#: Pre-tokens that are sent to every worker at most: with LONGEST this bounds the table there, about 100 MB.
HEAD = 500_000
#: Distinct pre-tokens that the first pass gathers before it hands them on, at most LONGEST bytes each.
GATHERED = 600_000
#: Texts whose other pre-tokens are counted together.
ROWS = 2048
_SPACES = " ▁"
_PRE_TOKEN = re.compile(f"[{_SPACES}]*[^{_SPACES}]+(?:[{_SPACES}]+\\Z)?|[{_SPACES}]+")
_workers: dict[str, _Library] = {}


class _Library:
    """The tokenizer's own library; `cuts` tells whether a text may be cut before spaces."""

    def __init__(self, path: str) -> None:
        self.cuts = False
        if path.endswith(".model"):
            import sentencepiece

            lib = sentencepiece.SentencePieceProcessor(model_file=path)
            self.cuts = not any(re.search("[^▁]▁", lib.id_to_piece(i)) for i in range(lib.get_piece_size()))
            self.lengths: Callable[[list[str]], list[int]] = lambda texts: [len(x) for x in lib.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            lib = Tokenizer.from_file(path)
            lib.no_padding()
            lib.no_truncation()
            self.lengths = lambda texts: [len(x) for x in lib.encode_batch_fast(texts, add_special_tokens=False)]


def _library(path: str) -> _Library:
    if path not in _workers:
        _workers[path] = _Library(path)
    return _workers[path]


def pre_tokens(text: str) -> list[str]:
    """The text cut before each run of spaces, without the first of them: that is the marker which the library puts before a text."""
    if not text:
        return []
    if "  " not in text and "▁" not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [w[1:] for w in _PRE_TOKEN.findall(" " + text)]


def _kept(word: str) -> bool:
    return len(word) <= LONGEST // 4 or len(word.encode()) <= LONGEST


def pre_token_frequencies(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows (word, freq): the distinct pre-tokens of at most LONGEST bytes that occur twice or more, over all texts."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = [(w, n) for w, n in seen.items() if _kept(w)]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["word", "freq"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(pre_tokens(t))
                if len(seen) > GATHERED:
                    yield out()
        yield out()

    bounded_batches(df.sparkSession)
    each = df.select(text_of(f"`{text}`").alias("t")).mapInArrow(gather, "word string, freq long")
    return each.groupBy("word").agg(F.sum("freq").alias("freq")).where("freq > 1")


def pre_token_table(df: DataFrame, model: str, text: str = "text", most: int = HEAD) -> DataFrame:
    """Rows (word, freq, tokens): the most frequent pre-tokens, at most `most`, each counted once by the library.

    How frequent they have to be follows from the number of words of each frequency (of large ones in powers of two), so
    nothing is sorted.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _library(model).lengths(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], names=["word", "freq", "tokens"])

    known = cut(pre_token_frequencies(df, text))
    at_least = F.when(F.col("freq") < 64, F.col("freq")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("freq"))).cast("long"))
    least, total = 1 << 62, 0
    for r in sorted(known.groupBy(at_least.alias("f")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["f"]):  # at most 128 rows
        if total + r["n"] > most:
            break
        total, least = total + r["n"], r["f"]
    return known.where(at_least >= least).mapInArrow(measure, "word string, freq long, tokens long")


def count_tokens(df: DataFrame, model: str, text: str = "text", out: str = "n_tokens", keep: list[str] | None = None, head: int = HEAD) -> DataFrame:
    """Add `out`, the number of tokens that the library for `model` (.model or .json) gives for the whole text.

    Null and empty texts have no tokens; no begin, end or added special tokens; an existing column named `out` is
    replaced; an empty table gives an empty table; repeated rows are counted each. head: rows of the table at most;
    whatever it is, the counts are the same.
    """
    if not _library(model).cuts:
        return map_texts(df, text, [(out, T.LongType())], lambda texts: [_library(model).lengths(texts)], keep)
    table = pre_token_table(df, model, text, head).toArrow()  # at most `head` rows
    shared = df.sparkSession.sparkContext.broadcast(dict(zip(table["word"].to_pylist(), table["tokens"].to_pylist(), strict=True)))

    def count(texts: list[str]) -> list[list]:
        known, bags, rest = shared.value, [Counter(pre_tokens(t)) for t in texts], {}
        for bag in bags:
            for w in bag:
                if w not in known:
                    rest[w] = 0
        words = list(rest)
        rest.update(zip(words, _library(model).lengths(words), strict=True))
        return [[sum([(known[w] if w in known else rest[w]) * n for w, n in bag.items()]) for bag in bags]]

    return map_texts(df, text, [(out, T.LongType())], count, keep, ROWS)


def document_token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_tokens and over_limit; null texts have no bytes. Other columns are not read."""
    sized = docs.select("doc_id", "text", F.octet_length(text_of("text")).cast("long").alias("n_bytes"))
    return count_tokens(sized, model, keep=["doc_id", "n_bytes"]).withColumn("over_limit", F.col("n_tokens") > limit)
