"""Benchmark decontamination by winnowing.

A text keeps the smallest hash of the k-grams in each window of `span` words, so two texts that share `span` words in a row
share a kept hash. Documents whose kept hashes meet those of the benchmark are candidates; around each shared k-gram the
windows of `span` words that hold it are compared word by word. Items of fewer than `span` words are compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import NON_WORD_CLASS, cut, text_of, whole_row

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows (benchmark windows or keys of documents, at most a few hundred bytes each) up to which they are sent to every
#: executor; beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, NON_WORD_CLASS, -1), "")


def n_words(text: Column) -> Column:
    """How many words a text has, whatever the case of its letters."""
    return F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def folded(text: Column) -> Column:
    """Lower case of all letters at a fraction of the cost of `ascii_lower`: texts alike in that are alike in this too.

    Lower case writes sigma by what stands around it, beyond the word's end; it is one letter here.
    """
    return F.replace(F.lower(text), F.lit("\u03c2"), F.lit("\u03c3"))


def _key() -> Column:
    return F.struct("doc_id", F.md5(text_of("text")))


def _beside(df: DataFrame, new: str, old: str, gap: int, size: Column, join) -> DataFrame:
    """new[i] = join(old[i], old[i + gap]) for the first `size` places."""
    n = F.greatest(size, F.lit(0))
    return df.withColumn(new, F.zip_with(F.slice(old, F.lit(1), n), F.slice(old, F.lit(gap + 1), n), join)).drop(old)


def _k_grams(df: DataFrame, k: int) -> DataFrame:
    """Column grams: a hash for each run of k words in column `words` (k a power of two), by doubling."""
    df, gap = df.withColumn("grams", F.transform("words", lambda w: F.xxhash64(w))), 1
    while gap < k:
        df = _beside(df, "__grams", "grams", gap, F.size("grams") - gap, lambda x, y: F.xxhash64(x, y)).withColumnRenamed("__grams", "grams")
        gap *= 2
    return df


def _winnow(df: DataFrame, k: int, span: int) -> DataFrame:
    """Column kept: the distinct smallest k-gram hashes of all windows of `span` words.

    Read it with explode_outer: for explode Spark infers a filter on the array, and pushing that filter down writes the
    chain of steps out into one expression that doubles with each step.
    """
    df, reach, need = _k_grams(df, k), 1, span - k + 1
    while reach < need:
        step = min(reach, need - reach)
        df = _beside(df, "__grams", "grams", step, F.size("grams") - step, lambda x, y: F.least(x, y)).withColumnRenamed("__grams", "grams")
        reach += step
    return df.withColumn("kept", F.array_distinct("grams")).drop("grams")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def windows(benchmark: DataFrame, span: int) -> DataFrame:
    """Rows (n, window, items): each distinct window of the benchmark, its words joined by a space, and its item ids.

    Items without words have none; a null item_id marks words but is not listed; equal items keep their ids.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(ascii_lower(text_of("text"))).alias("words")).where(F.size("words") > 0)
    n = F.least(F.lit(span), F.size("words"))
    at = items.select("item_id", n.alias("n"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - n + 1)).alias("p"))
    each = at.select("n", F.array_join(F.slice("words", F.col("p"), F.col("n")), " ").alias("window"), "item_id")
    return each.groupBy("n", "window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def _hash_runs(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Rows (key, p, n, gram): a hash of each run of n words, for each of the lengths, each made from that of one word less."""
    df = df.withColumn("single", F.transform("exact", lambda w: F.xxhash64(w))).withColumn("grams", F.col("single"))
    out, parts = [], df
    for n in range(1, max(lengths) + 1):
        if n > 1:
            size = F.greatest(F.size("single") - (n - 1), F.lit(0))
            longer = F.zip_with(F.slice("grams", F.lit(1), size), F.slice("single", F.lit(n), size), lambda x, y: F.xxhash64(x, y))
            parts = parts.withColumn("__grams", longer).drop("grams").withColumnRenamed("__grams", "grams")
        if n in lengths:
            out.append(parts.select("key", F.lit(n).alias("n"), F.posexplode_outer("grams").alias("p", "gram")))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole.where("gram is not null")


def _short_hits(docs: DataFrame, known: DataFrame, lengths: list[int], size: int) -> DataFrame:
    """Rows (key, p, n): word places where a run's hash is that of a whole short item. Words are compared later."""
    items = known.where(F.col("n").isin(*lengths)).select("n", F.split("window", " ").alias("exact"), F.col("window").alias("key"))
    marks = _small(_hash_runs(items, lengths).where("p = 0 and n = size(split(key, ' '))").select("n", "gram").distinct(), size)
    texts = docs.select(_key().alias("key"), words(ascii_lower(text_of("text"))).alias("exact"))
    return _hash_runs(texts, lengths).join(marks, ["n", "gram"], "left_semi").select("key", "p", "n")


def spans(docs: DataFrame, benchmark: DataFrame, span: int = 13, k: int = 8) -> DataFrame:
    """Rows (key, spans, items) of documents in which a benchmark window occurs; key is (doc_id, md5 of the text).

    spans: sorted (start, end) word places of each occurrence, end exclusive; items: sorted ids of the items they are from.
    Only hashes and word places travel to be joined; words are fetched for the places that are left and compared one by one.
    """
    known = cut(windows(benchmark, span))
    size = known.count()
    short = sorted(r[0] for r in known.where(F.col("n") < span).select("n").distinct().collect())  # at most span - 1
    full = known.where(F.col("n") == span)
    marks = _small(_winnow(full.select(F.split(folded(F.col("window")), " ").alias("words")), k, span).select(F.explode_outer("kept").alias("gram")).distinct(), size)
    texts = docs.select("doc_id", "text")
    kept = _winnow(texts.select(_key().alias("key"), words(folded(text_of("text"))).alias("words")), k, span)
    met = cut(kept.select("key", F.explode_outer("kept").alias("gram")).join(marks, "gram", "left_semi").select("key").distinct())
    near = texts.withColumn("key", _key()).join(_small(met, met.count()), "key", "left_semi")
    grams = _k_grams(near.select("key", words(folded(text_of("text"))).alias("words")), k)
    hits = grams.select("key", F.size("words").alias("size"), F.posexplode_outer("grams").alias("at", "gram")).join(marks, "gram", "left_semi")
    first, last = F.greatest(F.col("at") - (span - k), F.lit(0)), F.least(F.col("at"), F.col("size") - span)
    around = hits.where(last >= first).select("key", F.explode(F.sequence(first, last)).alias("p"), F.lit(span).alias("n"))
    if short:
        around = around.unionByName(_short_hits(texts, known, short, size))
    # The places of a document are at most as many as its words, for each length.
    places = cut(around.groupBy("key").agg(F.collect_set(F.struct("p", "n")).alias("places")))
    exact = texts.withColumn("key", _key()).join(_small(places, places.count()), "key").select("key", words(ascii_lower(text_of("text"))).alias("exact"), "places")
    each = exact.select("key", "exact", F.explode("places").alias("at"))
    found = each.select("key", F.col("at.p").alias("p"), F.col("at.n").alias("n"), F.array_join(F.slice("exact", F.col("at.p") + 1, F.col("at.n")), " ").alias("window"))
    hit = found.join(_small(known, size), ["n", "window"]).select("key", F.struct(F.col("p").alias("start"), (F.col("p") + F.col("n")).alias("end")).alias("span"), "items")
    out = hit.groupBy("key").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.collect_set("items").alias("sets"))
    return out.select("key", "spans", F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items"))


def covered(spans: Column) -> Column:
    """How many places the sorted spans cover."""

    def add(state: Column, s: Column) -> Column:
        more = F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], state["upto"]))
        return F.struct(F.greatest(state["upto"], s["end"]).alias("upto"), (state["n"] + more).alias("n"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")), add)["n"].cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 13) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (a twentieth of its words hit).

    Null texts have no words; repeated rows are judged each; without items nothing is hit; an empty table stays empty; other
    columns are not read.
    """
    hits = spans(docs, benchmark, span)
    counted = docs.select("doc_id", _key().alias("key"), n_words(text_of("text")).alias("n_words"))
    joined = counted.join(hits, "key", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    out = joined.select(
        "doc_id",
        "n_words",
        F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, span: int = 13) -> DataFrame:
    """The documents, all columns, without those that are contaminated."""
    hits = spans(docs, benchmark, span)
    hits = cut(hits.select("key", covered(F.col("spans")).alias("n_hit")))
    near = docs.select("doc_id", "text").withColumn("key", _key()).join(_small(hits, hits.count()), "key").select("key", "n_hit", n_words(text_of("text")).alias("n_words"))
    bad = cut(near.where(F.col("n_hit") * 20 >= F.col("n_words")).select(F.col("key").alias("__key")).distinct())
    return docs.select(whole_row(docs), _key().alias("__key")).join(_small(bad, bad.count()), "__key", "left_anti").select("row.*")
