"""Queries of operators that are joins and windows over rows: token search, spans, decoding by rows, n-best, drawn tokens, crossed windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import splitters as S
from textloom.functions.chars import WHITE_SPACE
from textloom.operators import encodings as E
from textloom.operators.decode_rows import decoded_rows
from textloom.operators.models import Bpe, Unigram, nbest_rows, sampled_tokens
from textloom.operators.spans import pieces_with_spans, token_ranges
from textloom.operators.token_search import found_tokens
from textloom.sources.tables import Checkpoints

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = sql
        return query

    return keep


_SPACE = "".join(f"\\x{{{ord(c):X}}}" for c in WHITE_SPACE)

# -- added tokens as a table

#: How many words of the documents are added tokens, and of how many characters.
ADDED, SHORTEST, LONGEST = 100_000, 4, 12
_ADDED_WORDS = f"""SELECT word, n FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^{_SPACE}]+')) AS word FROM documents) GROUP BY word) WHERE length(word) BETWEEN {SHORTEST} AND {LONGEST} ORDER BY n DESC, word LIMIT {ADDED}"""


@_add("added_tokens_search", f"""
WITH tokens AS (SELECT word AS content, id, id % 4 = 0 AS single_word, id % 7 = 0 AS lstrip, id % 11 = 0 AS rstrip FROM (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS id FROM ({_ADDED_WORDS}))),
texts AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
places AS (SELECT doc_id, text, unnest(range(0, length(text))) AS start FROM texts),
sized AS (SELECT doc_id, text, start, unnest(range({SHORTEST}, {LONGEST + 1})) AS size FROM places),
met AS (SELECT s.doc_id, s.text, s.start, s.start + s.size AS stop, t.* FROM sized s JOIN tokens t ON substr(s.text, s.start + 1, s.size) = t.content AND s.size = length(t.content)),
longest AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY doc_id, start ORDER BY stop DESC) = 1),
facts AS (SELECT doc_id, {{'start': start, 'stop': stop, 'id': id,
    'bad': single_word AND (start > 0 AND regexp_matches(substr(text, start, 1), '[\\p{{L}}\\p{{N}}_]') OR regexp_matches(substr(text, stop + 1, 1), '^[\\p{{L}}\\p{{N}}_]')),
    'before': CASE WHEN lstrip AND start > 0 THEN length(regexp_extract(substr(text, greatest(start - 63, 1), least(start, 64)), '[{_SPACE}]*$')) ELSE 0 END,
    'after': CASE WHEN rstrip THEN length(regexp_extract(substr(text, stop + 1, 64), '^[{_SPACE}]*')) ELSE 0 END,
    'behind': 0, 'past': 0, 'out': []::STRUCT(start BIGINT, stop BIGINT, id BIGINT)[]}} AS x FROM longest),
listed AS (SELECT doc_id, list_prepend({{'start': -1, 'stop': -1, 'id': -1, 'bad': true, 'before': 0, 'after': 0, 'behind': 0, 'past': 0, 'out': []}}, list(x ORDER BY x.start)) AS l FROM facts GROUP BY doc_id),
folded AS (SELECT doc_id, list_reduce(l, lambda a, x: {{'start': x.start, 'stop': x.stop, 'id': x.id, 'bad': x.bad, 'before': x.before, 'after': x.after,
    'behind': CASE WHEN x.start < a.past OR x.bad OR x.start < a.behind THEN a.behind ELSE x.stop + x.after END, 'past': CASE WHEN x.start < a.past THEN a.past ELSE x.stop END,
    'out': CASE WHEN x.start < a.past OR x.bad OR x.start < a.behind THEN a.out ELSE a.out || [{{'start': greatest(a.behind, x.start - x.before), 'stop': x.stop + x.after, 'id': x.id}}] END}}).out AS found FROM listed)
SELECT doc_id, CAST(f.start AS BIGINT) AS start, CAST(f.stop AS BIGINT) AS stop, CAST(f.id AS BIGINT) AS id FROM (SELECT doc_id, unnest(found) AS f FROM folded)""")
def added_tokens_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' 100,000 most frequent words of 4 to 12 characters as added tokens, and all their places."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select(F.explode(S.WhitespaceSplit().column(F.col("text"))).alias("word")).where(F.length("word").between(SHORTEST, LONGEST)).groupBy("word").count()
    top = words.orderBy(F.desc("count"), "word").limit(ADDED)
    tokens = top.select((F.row_number().over(Window.orderBy(F.desc("count"), "word")) - 1).cast("long").alias("id"), F.col("word").alias("content"))
    for name, n in (("single_word", 4), ("lstrip", 7), ("rstrip", 11)):
        tokens = tokens.withColumn(name, F.col("id") % n == 0)
    found = found_tokens(docs, Checkpoints(spark).table(tokens), ["doc_id"])
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "id")


# -- spans of sentences and of words

_SENTENCES, _WORDS = r"(?s)[^.!?]*[.!?]+|[^.!?]+", rf"(?s)[{WHITE_SPACE}]+|[^{WHITE_SPACE}]+"


def _spans_sql(pattern: str) -> str:
    return f"SELECT doc_id, row_number() OVER w - 1 AS pos, piece, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(length(piece)) OVER w AS stop FROM (SELECT doc_id, unnest(p) AS piece, unnest(range(0, len(p))) AS place FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS p FROM documents)) WINDOW w AS (PARTITION BY doc_id ORDER BY place)"


@_add("sentence_tokens", f"""
WITH sentences AS ({_spans_sql("[^.!?]*[.!?]+|[^.!?]+")}), words AS (SELECT * FROM ({_spans_sql(f"[{_SPACE}]+|[^{_SPACE}]+")}) WHERE regexp_matches(piece, '[^{_SPACE}]'))
SELECT s.doc_id, s.pos AS span, min(w.pos) AS first_token, max(w.pos) AS last_token FROM sentences s JOIN words w ON s.doc_id = w.doc_id AND w.start < s.stop AND s.start < w.stop GROUP BY ALL""")
def sentence_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tokens (places among words and gaps) each sentence of each document meets."""
    docs = _table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    tokens = pieces_with_spans(docs, ["doc_id"], "text", _WORDS, kept=rf"[^{WHITE_SPACE}]")
    sentences = pieces_with_spans(docs, ["doc_id"], "text", _SENTENCES).withColumnRenamed("pos", "span")
    made = token_ranges(tokens, sentences, ["doc_id"])
    return made.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("span", "first_token", "last_token")])


# -- decoding by rows

_BYTE_TOKENS = "CASE WHEN octet_length(encode(c)) = 1 THEN [c] ELSE list_transform(range(0, octet_length(encode(c))), lambda k: '<0x' || substr(hex(encode(c)), 2 * k + 1, 2) || '>') END"


@_add("decode_by_rows", f"""
WITH chars AS (SELECT doc_id, unnest(p) AS c, unnest(range(0, len(p))) AS place FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS p FROM documents)),
tokens AS (SELECT doc_id, pos, token FROM (SELECT doc_id, 8 * place + unnest(range(0, len(t))) AS pos, unnest(t) AS token FROM (SELECT doc_id, place, {_BYTE_TOKENS} AS t FROM chars)) WHERE length(token) = 1 OR pos % 5 <> 0),
numbered AS (SELECT *, length(token) > 1 AS b, row_number() OVER w AS r, sum(CASE WHEN length(token) > 1 THEN 1 ELSE 0 END) OVER w AS s FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
grouped AS (SELECT doc_id, min(pos) AS pos, any_value(b) AS b, count(*)::INT AS n, any_value(token) AS token, string_agg(substr(token, 4, 2), '' ORDER BY pos) AS h FROM numbered GROUP BY doc_id, CASE WHEN b THEN r - s ELSE -r END),
runs AS (SELECT doc_id, pos, CASE WHEN b THEN coalesce(try(decode(unhex(h))), repeat(chr(65533), n)) ELSE token END AS token FROM grouped)
SELECT doc_id, md5(string_agg(token, '' ORDER BY pos)) AS hash FROM runs GROUP BY doc_id""")
def decode_by_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ids of characters, or of bytes beyond ASCII of which some are missing, decoded by joins and windows."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "")).alias("at", "c")).where("c != ''")
    hexed = F.hex(F.encode("c", "UTF-8"))
    parts = F.transform(F.sequence(F.lit(0), (F.length(hexed) / 2 - 1).cast("int")), lambda k: F.concat(F.lit("<0x"), F.substring(hexed, 2 * k + 1, F.lit(2)), F.lit(">")))
    split = docs.select("doc_id", "at", F.posexplode(F.when(F.octet_length("c") == 1, F.array("c")).otherwise(parts)).alias("k", "token"))
    tokens = split.select("doc_id", (8 * F.col("at") + F.col("k")).alias("pos"), "token").where((F.length("token") == 1) | (F.col("pos") % 5 != 0))
    cuts = Checkpoints(spark)
    vocabulary = cuts.table(tokens.select("token").distinct().withColumn("id", F.monotonically_increasing_id()))
    ids = tokens.join(F.broadcast(vocabulary), "token").select("doc_id", "pos", "id")
    return decoded_rows(ids, vocabulary, ["doc_id"]).select("doc_id", F.md5("text").alias("hash"))


# -- n best segmentations

#: A small unigram vocabulary: scores are log probabilities, in eighths, so that their sums are exact.
_PIECES = (("<unk>", 0.0), ("a", -4.0), ("e", -4.125), ("h", -4.25), ("n", -4.375), ("t", -4.5), ("r", -4.625), ("th", -3.0), ("an", -3.125), ("the", -2.5), ("he", -3.75), ("en", -3.625), ("er", -3.25), ("re", -3.375))
_BEST = 3


@_add("unigram_nbest", f"""
WITH RECURSIVE words AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(text, '[^{_SPACE}]+')) AS word FROM conversations)),
pieces AS (SELECT unnest([{', '.join(f"'{p}'" for p, _ in _PIECES[1:])}]) AS piece, unnest([{', '.join(f'{s}::DOUBLE' for _, s in _PIECES[1:])}]) AS s),
walk(word, place, score, path) AS (
  SELECT word, 0, 0::DOUBLE, []::VARCHAR[] FROM words
  UNION ALL
  SELECT word, place, score, path FROM (SELECT w.word, w.place + length(e.piece) AS place, w.score + e.s AS score, w.path || [e.piece] AS path,
      row_number() OVER (PARTITION BY w.word, w.place + length(e.piece), w.place ORDER BY w.score + e.s DESC, w.path || [e.piece]) AS r
    FROM walk w JOIN LATERAL (
      SELECT piece, s FROM pieces WHERE w.place < length(w.word) AND substr(w.word, w.place + 1, length(piece)) = piece
      UNION ALL SELECT substr(w.word, w.place + 1, 1), {min(s for _, s in _PIECES) - 10}::DOUBLE WHERE w.place < length(w.word) AND substr(w.word, w.place + 1, 1) NOT IN (SELECT piece FROM pieces)) e ON true))
SELECT word, rank, round(score, 6) AS score, pieces FROM (SELECT word, row_number() OVER (PARTITION BY word ORDER BY score DESC, path) AS rank, score, array_to_string(path, ' ') AS pieces FROM walk WHERE place = length(word)) WHERE rank <= {_BEST}""")
def unigram_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best segmentations of each distinct word of the conversations."""
    words = _table(spark, sf_dir, "conversations").select(F.explode(S.WhitespaceSplit().column(F.col("text"))).alias("word")).distinct()
    best = nbest_rows(Unigram(_PIECES, 0), _BEST)
    made = words.lateralJoin(best(F.col("word").outer()))
    return made.select("word", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), F.array_join("pieces", " ").alias("pieces"))


# -- drawn tokens

_MERGES = (("t", "h"), ("i", "n"), ("e", "r"), ("th", "e"), ("in", "g"), ("o", "n"), ("a", "n"), ("an", "d"), ("r", "e"), ("o", "u"))


@_add("bpe_dropout_draws")
def bpe_dropout_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the conversations' words where each merge is left out with a chance of one in three; the same in each run."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", S.WhitespaceSplit().column(F.col("text")).alias("words"))
    chars = sorted({c for w in [*"abcdefghijklmnopqrstuvwxyz"] for c in w} | {c for a, b in _MERGES for c in a + b})
    vocab = {t: i for i, t in enumerate(dict.fromkeys(["<unk>", *chars, *(a + b for a, b in _MERGES)]))}
    return sampled_tokens(turns, Bpe(vocab, _MERGES, dropout=1 / 3, unk_token="<unk>"), ["conv_id", "turn"], "words", seed=7)


@_add("unigram_draws")
def unigram_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentations of the conversations' words, drawn by their likelihood; the same in each run."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", S.WhitespaceSplit().column(F.col("text")).alias("words"))
    return sampled_tokens(turns, Unigram(_PIECES, 0, alpha=0.5), ["conv_id", "turn"], "words", seed=7)


# -- crossed windows

_FIRST, _SECOND = (6, 2), (5, 0)


def _window_lists(words: str, size: int, stride: int) -> str:
    n = f"len({words})"
    return f"list_transform(list_filter(range(0, greatest({n}, 1), {size - stride}), lambda i: i = 0 OR i + {stride} < {n}), lambda i: {words}[i + 1:i + {size}])"


@_add("encoding_merge_windows", f"""
WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '[^{_SPACE}]+') AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn),
l AS (SELECT conv_id, turn, {_window_lists("x", *_FIRST)} AS a, {_window_lists("y", *_SECOND)} AS b FROM p),
m AS (SELECT conv_id, turn, [a[1] || b[1]] || flatten(list_transform(a[2:], lambda v: list_transform(b, lambda u: v || u))) || list_transform(b[2:], lambda u: a[1] || u) AS parts FROM l)
SELECT conv_id, turn, CAST(k AS BIGINT) AS "window", array_to_string(part, ' ') AS tokens FROM (SELECT conv_id, turn, unnest(range(0, len(parts))) AS k, unnest(parts) AS part FROM m)""")
def encoding_merge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two successive turns, merged: the kept parts, then all windows crossed."""

    def windows(name: str, size: int, stride: int) -> DataFrame:
        words = S.WhitespaceSplit().column(F.col("text"))
        tokens = F.transform(words, lambda w: F.struct(F.length(w).cast("long").alias("id"), w.alias("value"), F.lit(0).alias("start"), F.length(w).alias("end")))
        return _table(spark, sf_dir, "conversations").select("conv_id", "turn", E.truncate(E.from_tokens(tokens), size, stride).alias(name))

    a, b = windows("a", *_FIRST), windows("b", *_SECOND).withColumn("turn", F.col("turn") - 1)
    met = a.join(b, ["conv_id", "turn"]).withColumn("m", E.merge_overflowing([F.col("a"), F.col("b")]))
    parts = F.concat(F.array("m.tokens"), F.transform("m.overflowing", lambda e: e["tokens"]))
    return met.select("conv_id", "turn", F.posexplode(parts).alias("window", "tokens")).select("conv_id", "turn", F.col("window").cast("long").alias("window"), F.array_join("tokens", " ").alias("tokens"))
