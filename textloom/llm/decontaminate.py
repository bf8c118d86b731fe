"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is cut into windows of ``WINDOW`` consecutive words; an item
with fewer words, but not none, is one window.  Windows and documents are read
as shingles of five words (fewer where a window is shorter).  As a window must
be contained whole, its prefix is one shingle: the one that is rarest in the
documents.  A document's shingles meet the windows' prefix shingles, offsets
are held against the document's bounds, and the words of the whole window are
compared.

One pass over the texts keeps the places where a shingle of the benchmark
occurs, with the words around them; everything else works on those.  The
benchmark's shingles go into that pass as a set if there are at most
``SET_SHINGLES`` of them; otherwise a bitmap of bounded size thins the
documents' shingles, and the rest go through a join.  Items that share a window
are a set with a number; only sets found together are spelled out, once each.

Null and empty texts have no words.  Items without id take no part.  Rows that
repeat id and text get the same result each.  Texts are read whole, however
long; columns beside those named here are not read, whatever their names.  An
empty table gives an empty result, and an empty benchmark finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, key_filter, may_hold, salted_join, text_key, words

WINDOW, SHINGLE = 10, 5
#: Most shingles of the benchmark that travel as a set within the plan (a megabyte).
SET_SHINGLES = 100_000


def _shingles(tokens: str, size: int) -> Column:
    """Hashes of the shingles at each place of a column of words."""
    at = F.slice(F.col(tokens), F.lit(1), F.greatest(F.size(tokens) - size + 1, F.lit(0)))
    return F.transform(at, lambda x, i: F.xxhash64(F.lit(size), x, *[F.get(F.col(tokens), i + k) for k in range(1, size)]))


def benchmark_windows(items: DataFrame) -> DataFrame:
    """Distinct windows: window (words), size of its shingles, the items that hold it, and a key of that set of items."""
    w = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0)))
    cut = w.withColumn("start", F.explode(starts)).select("item_id", F.slice("w", F.col("start") + 1, F.lit(WINDOW)).alias("window"))
    held = cut.groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return held.withColumn("size", F.least(F.size("window"), F.lit(SHINGLE))).withColumn("set", F.sha2(F.to_json("items"), 256))


def _window_shingles(windows: DataFrame) -> DataFrame:
    """A row for each window and place in it: the shingle's hash ``h`` and ``offset``."""
    parts = [windows.where(F.col("size") == s).select("window", "set", "size", F.posexplode(_shingles("window", s)).alias("offset", "h")) for s in range(1, SHINGLE + 1)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _places(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """Each document's id, text key, number of words, and the places where a shingle of the benchmark occurs."""
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), words(F.col("text")).alias("w"))
    sizes = [r["size"] for r in shingles.select("size").distinct().collect()]
    known = shingles.select("h").distinct()
    few = [r["h"] for r in known.limit(SET_SHINGLES + 1).collect()]

    def place(size: int, h: Column, i: Column) -> Column:
        first = F.greatest(i - (WINDOW - 1), F.lit(0))
        return F.struct(i.alias("at"), h.alias("h"), F.lit(size).alias("size"), first.alias("first"), F.slice(F.col("w"), first + 1, i - first + WINDOW).alias("around"))

    if len(few) <= SET_SHINGLES:

        def known_places(size: int) -> Column:
            return F.array_compact(F.transform(_shingles("w", size), lambda h, i: F.when(h.isin(few), place(size, h, i))))

        found = [known_places(s) for s in sizes]
        return rows.select("doc_id", "key", F.size("w").alias("n_words"), (F.concat(*found) if found else F.array().cast("array<struct<at:int,h:bigint,size:int,first:int,around:array<string>>>")).alias("places"))
    bitmap = key_filter(known, "h")
    # shingles alone go through the join; the words around those that are known are cut from the text afterwards
    hits = None
    for s in sizes:
        each = may_hold(rows.select("doc_id", "key", F.posexplode(_shingles("w", s)).alias("at", "h")), bitmap, "may", F.col("h")).where("may")
        each = each.join(known, "h", "left_semi").select("doc_id", "key", F.struct("at", "h", F.lit(s).alias("size")).alias("hit"))
        hits = each if hits is None else hits.unionByName(each)
    hits = hits.groupBy(F.col("doc_id").alias("hit_doc"), F.col("key").alias("hit_key")).agg(F.collect_set("hit").alias("hits"))
    met = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("key") == F.col("hit_key")), "left").select("doc_id", "key", "w", "hits")

    def found_at(p: Column) -> Column:
        first = F.greatest(p["at"] - (WINDOW - 1), F.lit(0))
        return F.struct(p["at"].alias("at"), p["h"].alias("h"), p["size"].alias("size"), first.alias("first"), F.slice(F.col("w"), first + 1, p["at"] - first + WINDOW).alias("around"))

    return met.select("doc_id", "key", F.size("w").alias("n_words"), F.coalesce(F.transform("hits", found_at), F.array()).alias("places"))


def occurrences(docs: DataFrame, windows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, key, n_words), and where windows occur in them (doc_id, key, start, stop, set)."""
    shingles = _window_shingles(windows)
    kept = scratch.table(_places(docs, shingles))
    places = kept.where(F.size("places") > 0).select("doc_id", "key", "n_words", F.explode("places").alias("p")).select("doc_id", "key", "n_words", "p.*")
    rarity = scratch.table(places.groupBy("h", "size").agg(F.count("*").alias("n")))
    # a window with a shingle that no document holds occurs nowhere
    ranked = shingles.join(rarity, ["h", "size"], "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset", "size")).alias("prefix"), F.first("set").alias("set"))
    prefixes = ranked.where("prefix.n > 0").select("prefix.h", "prefix.size", "prefix.offset", "prefix.n", "window", "set")
    start = F.col("at") - F.col("offset")
    length = F.size("window")
    # a passage that a large part of the documents share is dealt into salts
    met = salted_join(places, prefixes, ["h", "size"], ["doc_id", "key", "at"], counts=rarity).withColumn("start", start).where((F.col("start") >= 0) & (F.col("start") + length <= F.col("n_words")))
    met = met.where(F.slice("around", F.col("start") - F.col("first") + 1, length) == F.col("window"))
    return kept, met.select("doc_id", "key", "start", (F.col("start") + length).alias("stop"), "set")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: its words, those within a window's occurrence, and the items found."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    windows = scratch.table(benchmark_windows(items))
    kept, found = occurrences(docs, windows, scratch)
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("spans", zero, lambda s, x: F.struct((s["n"] + F.greatest(x["stop"] - F.greatest(x["start"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], x["stop"]).alias("end")), lambda s: s["n"])
    of_doc = found.groupBy(F.col("doc_id").alias("__doc"), F.col("key").alias("__key")).agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"), F.sort_array(F.collect_set("set")).alias("sets"))
    hit = scratch.table(of_doc.select("__doc", "__key", covered.alias("n_hit"), "sets", F.sha2(F.array_join("sets", ","), 256).alias("together")))
    # documents in which the same sets are found have the same items: these are put together once
    together = hit.groupBy("together").agg(F.first("sets").alias("sets"), F.count("*").alias("n"))
    members = together.select("together", "n", F.explode("sets").alias("set")).join(windows.select("set", "items").dropDuplicates(["set"]), "set").select("together", "n", F.explode("items").alias("item"))
    listed = members.groupBy("together").agg(F.first("n").alias("n"), F.sort_array(F.collect_set("item")).alias("items"))
    spelled = scratch.table(listed.select("together", "n", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")))
    met = salted_join(hit.select("__doc", "__key", "n_hit", "together"), spelled, ["together"], ["__doc", "__key"])
    rows = kept.select("doc_id", "key", "n_words")
    return rows.join(met, rows["doc_id"].eqNullSafe(met["__doc"]) & (rows["key"] == met["__key"]), "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def contaminated_keys(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A written table of the contaminated documents' ids and text keys."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    _, found = occurrences(docs, scratch.table(benchmark_windows(items)), scratch)
    return scratch.table(found.select("doc_id", "key").distinct())
