"""Line dedup: repeated runs of lines, found through a suffix array over line ids.

Each non-blank line of each document is a symbol; a document's end is a break.
Prefix doubling ranks all suffixes: at level k a suffix's rank stands for its
first 2**k lines, and the ranks of the pairs (suffix, suffix 2**k lines on)
in sorted order are those of level k + 1.  A suffix whose rank is its own
alone has no further repeat and leaves.  Suffixes of equal rank form an
interval of that common prefix length.

For each place the shortest run from there with ``MIN_WORDS`` words is looked
up in those intervals.  If an earlier place (by document id, text key, line)
starts with the same run, this one is a later copy.  Where a copy's
predecessor does not continue the same copy, a maximal run starts; its length
is the longest common prefix with the first occurrence, summed up from the
levels.  Those lines are deleted; first occurrences stay.

The texts themselves are shuffled only for documents that may hold a copy: a
bitmap of bounded size tells most others apart, which go straight through.

Rows that repeat id and text are one document and get one result.  Null ids
come last.  Null texts stay null; blank lines stay, but a text of which every
non-blank line goes becomes empty.  Shorter repeats than ``MIN_WORDS`` words
(counted between spaces) are left alone.  Long texts are cut into lines like
others.  Columns named n_lines or n_deleted are replaced; any other names may
occur.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import HOT_SHARE, SALTS, Scratch, is_empty, key_filter, may_hold, packed, salted_join, text_key

#: Words that a repeated run must have.
MIN_WORDS = 8
#: Levels that are joined in one plan while runs are lengthened.
LEVELS_AT_ONCE = 3
_LAST = (1 << 63) - 1
_PLACE = ["doc", "key", "pos"]
_SOURCE = ["src_doc", "src_key", "src_pos"]


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each non-blank line: doc, key, pos, hashes, and the lines that ``min_words`` words take from here."""
    split = docs.where(F.col("text").isNotNull()).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), text_key(F.col("text")).alias("key"), F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("lines")
    )
    counted = split.withColumn("sizes", F.transform("lines", lambda x: F.size(F.split(F.trim(x), " +"))))
    nothing = F.struct(F.lit(0).alias("n"), F.lit(0).alias("lines"))

    def taken(i: Column) -> Column:
        part = F.slice(F.col("sizes"), i + 1, F.lit(min_words))
        step = lambda s, x: F.when(s["n"] >= min_words, s).otherwise(F.struct((s["n"] + x).alias("n"), (s["lines"] + 1).alias("lines")))
        return F.aggregate(part, nothing, step, lambda s: F.when(s["n"] >= min_words, s["lines"]))

    rows = counted.select("doc", "key", F.posexplode(F.transform("lines", lambda x, i: F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b"), taken(i).alias("need")))).alias("pos", "line"))
    return rows.select("doc", "key", "pos", "line.a", "line.b", "line.need")


def _ranked(rows: DataFrame, by: list[str], scratch: Scratch) -> DataFrame:
    """Replaces the columns ``by`` by ``rank``, their place in sorted order; values that occur once go."""
    repeated = rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
    ranks = scratch.table(repeated.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()))
    return salted_join(rows, ranks, by, _PLACE).drop(*by)


def suffix_levels(docs: DataFrame, min_words: int, scratch: Scratch) -> list[DataFrame]:
    """Ranks of the repeated suffixes by their first 1, 2, 4, ... lines."""
    lines = scratch.table(_lines(docs, min_words))
    # rows that repeat a document give its lines again, which are one place each
    levels = [scratch.table(_ranked(lines, ["a", "b"], scratch).distinct())]
    while True:
        reach = 1 << (len(levels) - 1)
        ahead = Window.partitionBy("doc", "key").orderBy("pos").rangeBetween(reach, reach)
        pairs = levels[-1].withColumnRenamed("rank", "r").withColumn("s", F.max("r").over(ahead)).where(F.col("s").isNotNull())
        level = scratch.table(_ranked(pairs, ["r", "s"], scratch))
        if is_empty(level):
            return levels
        levels.append(level)


def _at(level: DataFrame, name: str) -> DataFrame:
    return level.select(F.col("doc").alias("at_doc"), F.col("key").alias("at_key"), F.col("pos").alias("at_pos"), F.col("rank").alias(name))


def _joined(rows: DataFrame, level: DataFrame, doc: str, key: str, pos: Column, name: str, how: str) -> DataFrame:
    """Adds the rank at another place."""
    right = _at(level, name)
    left = rows.withColumn("__pos", pos)
    return left.join(right, (left[doc] == right["at_doc"]) & (left[key] == right["at_key"]) & (left["__pos"] == right["at_pos"]), how).drop("at_doc", "at_key", "at_pos", "__pos")


def _joined_at_source(runs: DataFrame, level: DataFrame, hot: DataFrame) -> DataFrame:
    """Adds the rank ``theirs`` at a run's source.  Places of the few documents ``hot`` are there once for each salt."""
    side = _at(level, "theirs").withColumn("at_salt", F.lit(0).cast("long"))
    copies = side.drop("at_salt").join(F.broadcast(hot), (F.col("at_doc") == F.col("hot_doc")) & (F.col("at_key") == F.col("hot_key"))).drop("hot_doc", "hot_key")
    side = side.unionByName(copies.withColumn("at_salt", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(SALTS).cast("long")))))
    left = runs.withColumn("__pos", F.col("src_pos") + F.col("lines"))
    met = left.join(side, (left["src_doc"] == side["at_doc"]) & (left["src_key"] == side["at_key"]) & (left["__pos"] == side["at_pos"]) & (left["salt"] == side["at_salt"]), "left")
    return met.drop("at_doc", "at_key", "at_pos", "at_salt", "__pos")


def _first_runs(levels: list[DataFrame], min_words: int, scratch: Scratch) -> DataFrame:
    """Places of runs of ``min_words`` words that are later copies, and where each run stands first."""
    keyed = None
    for k, level in enumerate(levels):
        size = 1 << k
        if size > min_words:
            break
        wanted = level.where((F.col("need") >= size) & (F.col("need") < 2 * size))
        part = _joined(wanted, level, "doc", "key", F.col("pos") + F.col("need") - size, "tail", "inner")
        keyed = part if keyed is None else keyed.unionByName(part)
    # rank and tail fix the run, for a run's words fix how many lines it takes
    run = ["need", "rank", "tail"]
    keyed = scratch.table(keyed)
    place = F.struct(*_PLACE)
    firsts = scratch.table(keyed.groupBy(*run).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    later = salted_join(keyed, firsts, run, _PLACE).where(place != F.col("first"))
    return later.select(*_PLACE, "need", F.col("first.doc").alias("src_doc"), F.col("first.key").alias("src_key"), F.col("first.pos").alias("src_pos"))


def copied_runs(docs: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """Maximal runs that are later copies: doc, key, pos, lines."""
    levels = suffix_levels(docs, min_words, scratch)
    later = _first_runs(levels, min_words, scratch)
    before = Window.partitionBy("doc", "key").orderBy("pos").rangeBetween(-1, -1)
    previous = F.max(F.struct(*_SOURCE)).over(before)
    continues = (previous["src_doc"] == F.col("src_doc")) & (previous["src_key"] == F.col("src_key")) & (previous["src_pos"] + 1 == F.col("src_pos"))
    runs = scratch.table(later.withColumn("continues", F.coalesce(continues, F.lit(False))).where(~F.col("continues")).drop("continues").withColumn("lines", F.col("need")))
    # at most 1 / HOT_SHARE documents can be the source of more than that share of the runs
    hot = runs.groupBy(F.col("src_doc").alias("hot_doc"), F.col("src_key").alias("hot_key")).count().where(F.col("count") > runs.count() * HOT_SHARE).drop("count")
    hot = scratch.table(hot)
    salt = F.when(F.col("hot_doc").isNotNull(), F.pmod(F.xxhash64(*_PLACE), F.lit(SALTS)) + 1).otherwise(0)
    runs = runs.join(F.broadcast(hot), (F.col("src_doc") == F.col("hot_doc")) & (F.col("src_key") == F.col("hot_key")), "left").withColumn("salt", salt).drop("hot_doc", "hot_key")
    for k in reversed(range(len(levels))):
        runs = _joined(runs, levels[k], "doc", "key", F.col("pos") + F.col("lines"), "own", "left")
        runs = _joined_at_source(runs, levels[k], hot)
        more = F.when(F.col("own") == F.col("theirs"), 1 << k).otherwise(0)
        runs = runs.withColumn("lines", F.col("lines") + more).drop("own", "theirs")
        # a plan of few levels: the driver keeps a description of the whole plan for each of its stages
        if k and k % LEVELS_AT_ONCE == 0:
            runs = scratch.table(runs)
    return runs.select(*_PLACE, "lines")


def _cuts(runs: DataFrame) -> DataFrame:
    """For each document the runs in order, as ``skip`` lines that stay and ``drop`` lines that go; runs may overlap or repeat."""
    before = Window.partitionBy("doc", "key").orderBy("pos", "lines").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("pos") + F.col("lines")
    parts = runs.select(*_PLACE, stop.alias("stop"), F.coalesce(F.max(stop).over(before), F.lit(0)).alias("done")).where("stop > done")
    skip, drop = F.greatest(F.col("pos") - F.col("done"), F.lit(0)), F.col("stop") - F.greatest("pos", "done")
    part = F.struct("pos", skip.cast("int").alias("skip"), drop.cast("int").alias("drop"))
    return parts.groupBy("doc", "key").agg(F.sort_array(F.collect_list(part)).alias("cuts"))


def _without(text: Column, cuts: Column) -> tuple[Column, Column]:
    """A text without the lines that ``cuts`` drops of its non-blank ones, and how many lines these are."""
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    filled = F.filter(numbered, lambda z: F.trim(z["line"]) != "")
    blank = F.filter(numbered, lambda z: F.trim(z["line"]) == "")
    stays = F.flatten(F.transform(cuts, lambda c: F.concat(F.array_repeat(F.lit(True), c["skip"]), F.array_repeat(F.lit(False), c["drop"]))))
    marked = F.zip_with(filled, stays, lambda z, stay: F.struct(z["at"].alias("at"), z["line"].alias("line"), F.coalesce(stay, F.lit(True)).alias("stay")))
    kept = F.transform(F.filter(marked, lambda z: z["stay"]), lambda z: F.struct(z["at"].alias("at"), z["line"].alias("line")))
    rest = F.array_join(F.transform(F.sort_array(F.concat(kept, blank)), lambda z: z["line"]), "\n")
    return F.when(F.size(kept) > 0, rest).otherwise(""), F.size(filled) - F.size(kept)


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with later copies deleted from ``text``; adds ``n_lines`` and ``n_deleted``, in place of columns of these names."""
    with Scratch(docs.sparkSession, "line-dedup-work") as work:
        runs = copied_runs(docs, min_words, work)
        cuts = Scratch(docs.sparkSession, "line-dedup").table(_cuts(runs))
    row_text = F.col("row.text")
    own = packed(docs.drop("n_lines", "n_deleted")).select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(_LAST)).alias("doc"), text_key(row_text).alias("key"))
    own = may_hold(own, key_filter(cuts, "doc", "key"), "may", F.col("doc"), F.col("key")).withColumn("may", F.col("may") & row_text.isNotNull())
    met = own.where("may").drop("may").join(cuts.hint("merge"), ["doc", "key"], "left").select("row", "cuts")
    through = own.where("NOT may").select("row", F.lit(None).cast(cuts.schema["cuts"].dataType).alias("cuts"))

    def shaped(rows: DataFrame, text: Column, deleted: Column) -> DataFrame:
        filled = F.filter(F.split(row_text, "\n"), lambda x: F.trim(x) != "")
        made = rows.select("row", text.alias("text"), F.coalesce(F.size(filled), F.lit(0)).cast("long").alias("n_lines"), deleted.cast("long").alias("n_deleted"))
        columns = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_deleted")]
        return made.select(*columns, "n_lines", "n_deleted")

    text, deleted = _without(row_text, F.col("cuts"))
    cut = F.col("cuts").isNotNull()
    return shaped(met, F.when(cut, text).otherwise(row_text), F.when(cut, deleted).otherwise(0)).unionByName(shaped(through, row_text, F.lit(0)))
