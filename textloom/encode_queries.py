"""More queries: added tokens, processors, lookups in encodings, models on words they do not know, files and callers' own parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import normalizers as N
from textloom.functions import splitters as S
from textloom.functions.aligned import char_slice
from textloom.functions.chars import WHITE_SPACE, byte_alphabet
from textloom.operators import decoders as D
from textloom.operators import encodings as E
from textloom.operators.added_tokens import AddedToken
from textloom.operators.models import Bpe, WordLevel, token_totals
from textloom.operators.processors import BertProcessor, ByteLevelProcessor, ProcessorSequence, RobertaProcessor, TemplateProcessor
from textloom.operators.trainers import WordLevelTrainer, word_counts
from textloom.plans import presets
from textloom.plans.pipeline import Padding, TextPipeline, Truncation
from textloom.plans.training import train_from_files
from textloom.sources.tables import Checkpoints, text_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name: str, sql: str) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = query, sql
        return query

    return keep


_SPACE = "".join(f"\\x{{{ord(c):X}}}" for c in WHITE_SPACE)
_WORDS = f"regexp_extract_all(text, '[^{_SPACE}]+')"
_TURNS = f"(SELECT conv_id, turn, text, {_WORDS} AS w FROM conversations)"
_UNKNOWN = WordLevel({"<unk>": 0})


def _encoded(spark: SparkSession, sf_dir: str, pipe: TextPipeline, **how) -> DataFrame:
    """The turns of conversations with their encodings."""
    return pipe.encode(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), **how).withColumnRenamed("encoding", "e")


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns with an encoding of their words: the ids are the words' lengths."""
    words = S.WhitespaceSplit().column(F.col("text"))
    tokens = F.transform(words, lambda w: F.struct(F.length(w).cast("long").alias("id"), w.alias("value"), F.lit(0).alias("start"), F.length(w).alias("end")))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", E.from_tokens(tokens).alias("e"))


def _sum(values: str) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)


# -- added tokens


def _added(tokens: list[AddedToken], normalizer: N.Normalizer | None = None) -> Query:
    """How often each added token occurs, how many characters it covers, and how many other words there are."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pipe = TextPipeline(_UNKNOWN, normalizer, S.WhitespaceSplit()).with_added_tokens(tokens)
        made = pipe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"))
        rows = E.token_rows(made, "encoding", ["doc_id"])
        return rows.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))

    return query


def _added_sql(found: str, rest: str, label: str) -> str:
    """Tokens as ``found`` lists them, and the words of ``rest``; all by their count and characters."""
    return f"""SELECT token, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM (
      SELECT {label} AS token, length(t) AS chars FROM (SELECT unnest({found}) AS t FROM documents)
      UNION ALL SELECT '<unk>', length(t) FROM (SELECT unnest(regexp_extract_all({rest}, '[^{_SPACE}]+')) AS t FROM documents)) GROUP BY token"""


_plain = [AddedToken("ing", normalized=False), AddedToken("the", normalized=False)]
QUERIES["added_tokens"] = _added(_plain)
ORACLE_SQL["added_tokens"] = _added_sql("regexp_extract_all(text, 'ing|the')", "regexp_replace(text, 'ing|the', ' ', 'g')", "t")
QUERIES["added_tokens_longest"] = _added([AddedToken("e", normalized=False), AddedToken("es", normalized=False), AddedToken("est", normalized=False)])
ORACLE_SQL["added_tokens_longest"] = _added_sql("regexp_extract_all(text, 'est|es|e')", "regexp_replace(text, 'est|es|e', ' ', 'g')", "t")
QUERIES["added_tokens_stripping"] = _added([AddedToken("qu", lstrip=True, rstrip=True, normalized=False)])
ORACLE_SQL["added_tokens_stripping"] = _added_sql(f"regexp_extract_all(text, '[{_SPACE}]*qu[{_SPACE}]*')", "regexp_replace(text, 'qu', ' ', 'g')", "'qu'")
# every character between words is doubled, so that neighbours do not share it
_apart = r"regexp_replace(' ' || text || ' ', '([^\p{L}\p{N}_])', '\1\1', 'g')"
QUERIES["added_tokens_single_word"] = _added([AddedToken("de", single_word=True, normalized=False)])
ORACLE_SQL["added_tokens_single_word"] = f"""WITH marked AS (SELECT regexp_replace({_apart}, '([^\\p{{L}}\\p{{N}}_])de([^\\p{{L}}\\p{{N}}_])', '\\1' || chr(1) || '\\2', 'g') AS m FROM documents),
  back AS (SELECT regexp_replace(m, '([^\\p{{L}}\\p{{N}}_' || chr(1) || '])[^\\p{{L}}\\p{{N}}_' || chr(1) || ']', '\\1', 'g') AS m FROM marked)
  SELECT token, CAST(sum(n) AS BIGINT) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM (
    SELECT 'de' AS token, len(regexp_extract_all(m, chr(1))) AS n, 2 * len(regexp_extract_all(m, chr(1))) AS chars FROM back
    UNION ALL SELECT '<unk>', len(w), list_sum(list_transform(w, lambda x: length(x))) FROM (SELECT regexp_extract_all(m, '[^{_SPACE}' || chr(1) || ']+') AS w FROM back)) GROUP BY token"""
QUERIES["added_tokens_normalized"] = _added([AddedToken("THE")], N.Lowercase())
ORACLE_SQL["added_tokens_normalized"] = _added_sql("regexp_extract_all(lower(text), 'the')", "regexp_replace(lower(text), 'the', ' ', 'g')", "'THE'")


def _byte_pipe() -> TextPipeline:
    """Single bytes, and 'the' as a special token."""
    return presets.byte_level_bpe(Bpe({c: i for i, c in enumerate(byte_alphabet())}, ())).with_special_tokens(["the"])


def _bytes_back(pipe: Callable[[], TextPipeline], skip: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = pipe().encode_ids(_table(spark, sf_dir, "documents").select("doc_id", "text"))
        made = pipe().decode(docs, "ids", "decoded", skip_special_tokens=skip)
        return made.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.md5("decoded").alias("hash"))

    return query


_IDS = "CAST(octet_length(encode(replace(text, 'the', ''))) + (length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT)"
QUERIES["decode_without_special_tokens"] = _bytes_back(_byte_pipe, True)
ORACLE_SQL["decode_without_special_tokens"] = f"SELECT doc_id, {_IDS} AS n_ids, md5(replace(text, 'the', '')) AS hash FROM documents"
QUERIES["decode_with_special_tokens"] = _bytes_back(_byte_pipe, False)
ORACLE_SQL["decode_with_special_tokens"] = f"SELECT doc_id, {_IDS} AS n_ids, md5(text) AS hash FROM documents"
QUERIES["decode_normalized_added_tokens"] = _bytes_back(lambda: presets.byte_level_bpe(Bpe({c: i for i, c in enumerate(byte_alphabet())}, ())).with_(normalizer=N.Lowercase()).with_added_tokens([AddedToken("THE")]), True)
ORACLE_SQL["decode_normalized_added_tokens"] = f"SELECT doc_id, {_IDS.replace('text', 'lower(text)')} AS n_ids, md5(lower(text)) AS hash FROM documents"
QUERIES["pipeline_json"] = _bytes_back(lambda: TextPipeline.from_json(_byte_pipe().to_json()), True)
ORACLE_SQL["pipeline_json"] = ORACLE_SQL["decode_without_special_tokens"]

# -- processors, truncation and padding in pipelines


@_add("processor_sequence", f"SELECT conv_id, turn, CAST(len(w) + 2 AS BIGINT) AS n, CAST(203 + coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS id_sum FROM {_TURNS}")
def processor_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ProcessorSequence((ByteLevelProcessor(), TemplateProcessor(E.bert_template()))).apply(F.col("e"))
    return _lengths(spark, sf_dir).select("conv_id", "turn", made.alias("t")).select("conv_id", "turn", F.size("t.ids").cast("long").alias("n"), _sum("t.ids").alias("id_sum"))


@_add("processor_byte_level", f"SELECT conv_id, turn, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) + CASE WHEN len(w) > 0 THEN 1 ELSE 0 END AS BIGINT) AS covered FROM {_TURNS}")
def processor_byte_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What offsets of tokens with a leading space cover once they are trimmed; the first keeps its space."""
    words = S.WhitespaceSplit().column(F.col("text"))
    tokens = F.transform(words, lambda w, i: F.struct(i.cast("long").alias("id"), F.concat(F.lit(chr(0x120)), w).alias("value"), (i * 1000).alias("start"), (i * 1000 + F.length(w) + 1).alias("end")))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", ByteLevelProcessor().apply(E.from_tokens(tokens)).alias("e"))
    return rows.select("conv_id", "turn", F.aggregate("e.offsets", F.lit(0).cast("long"), lambda s, o: s + o["end"] - o["start"]).alias("covered"))


@_add("encode_special_tokens", f"SELECT conv_id, turn, CAST(len(w) + 2 AS BIGINT) AS n, CAST(203 AS BIGINT) AS id_sum, CAST(2 AS BIGINT) AS specials, CAST(len(w) - 1 AS BIGINT) AS last_word FROM {_TURNS} WHERE len(w) > 0")
def encode_special_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _encoded(spark, sf_dir, TextPipeline(_UNKNOWN, splitter=S.WhitespaceSplit(), processor=BertProcessor()))
    rows = made.select("conv_id", "turn", F.size("e.ids").cast("long").alias("n"), _sum("e.ids").alias("id_sum"), _sum("e.special_tokens_mask").alias("specials"), F.array_max("e.word_ids").cast("long").alias("last_word"))
    return rows.where("last_word IS NOT NULL")


_WINDOWS = "CASE WHEN n <= 14 THEN 1 ELSE 1 + CAST(ceil((n - 14) / 10.0) AS BIGINT) END"


@_add("encode_truncated_and_padded", f"SELECT conv_id, turn, CAST({_WINDOWS} AS BIGINT) AS windows, CAST(least(n, 14) + 2 AS BIGINT) AS attended, CAST(20 AS BIGINT) AS length FROM (SELECT conv_id, turn, len(w) AS n FROM {_TURNS})")
def encode_truncated_and_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 16 with special tokens, overlapping by 4, padded to 20."""
    pipe = TextPipeline(_UNKNOWN, splitter=S.WhitespaceSplit(), processor=RobertaProcessor(trim_offsets=False), truncation=Truncation(16, 4), padding=Padding(20, pad_id=7))
    made = _encoded(spark, sf_dir, pipe)
    return made.select("conv_id", "turn", (F.size("e.overflowing") + 1).cast("long").alias("windows"), _sum("e.attention_mask").alias("attended"), F.size("e.ids").cast("long").alias("length"))


def _early(direction: str) -> Query:
    """What is left of a text cut to 12 tokens, where no more words are tokenized than that takes."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pipe = TextPipeline(_UNKNOWN, splitter=S.WhitespaceSplit(), truncation=Truncation(12, direction=direction))
        made = _encoded(spark, sf_dir, pipe, overflow=False).where(F.size("e.ids") > 0)
        first, last = F.col("e.offsets")[0], F.element_at("e.offsets", -1)
        return made.select("conv_id", "turn", F.size("e.ids").cast("long").alias("kept"), F.size("e.overflowing").cast("long").alias("windows"), F.substring(F.col("text"), first["start"] + 1, first["end"] - first["start"]).alias("first"), F.substring(F.col("text"), last["start"] + 1, last["end"] - last["start"]).alias("last"), F.element_at(E.words(F.col("e")), -1).cast("long").alias("word"))

    return query


for _direction, _ends in (("right", ("w[1]", "w[least(len(w), 12)]")), ("left", ("w[greatest(len(w) - 11, 1)]", "w[-1]"))):
    QUERIES[f"encode_early_exit_{_direction}"] = _early(_direction)
    ORACLE_SQL[f"encode_early_exit_{_direction}"] = f"SELECT conv_id, turn, CAST(least(len(w), 12) AS BIGINT) AS kept, CAST(0 AS BIGINT) AS windows, {_ends[0]} AS first, {_ends[1]} AS last, CAST(least(len(w), 12) - 1 AS BIGINT) AS word FROM {_TURNS} WHERE len(w) > 0"


def _pair_cut(strategy: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(S.WhitespaceSplit().column(F.col("text"))).alias("n1"))
        b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("n1").alias("n2"))
        # the cut one must have more tokens than are to go
        long = F.col("n1" if strategy == "only_first" else "n2") > F.col("n1") + F.col("n2") - 60
        x, y = E.pair_lengths(F.col("n1"), F.col("n2"), 60, strategy)
        return a.join(b, ["conv_id", "turn"]).where(long).select("conv_id", "turn", x.cast("long").alias("kept1"), y.cast("long").alias("kept2"))

    return query


for _strategy, _cut, _other in (("only_first", "n1", "n2"), ("only_second", "n2", "n1")):
    QUERIES[f"truncate_{_strategy}"] = _pair_cut(_strategy)
    _kept = {_cut: f"least({_cut}, 60 - {_other})", _other: _other}
    ORACLE_SQL[f"truncate_{_strategy}"] = f"WITH t AS (SELECT conv_id, turn, len(w) AS n FROM {_TURNS}) SELECT conv_id, turn, CAST({_kept['n1']} AS BIGINT) AS kept1, CAST({_kept['n2']} AS BIGINT) AS kept2 FROM (SELECT a.conv_id, a.turn, a.n AS n1, b.n AS n2 FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn) WHERE {_other} < 60"


@_add("truncate_to_nothing", f"SELECT conv_id, turn, CAST(0 AS BIGINT) AS kept, CAST(len(w) AS BIGINT) AS cut FROM {_TURNS} WHERE len(w) > 0")
def truncate_to_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _lengths(spark, sf_dir).where(F.size("e.ids") > 0).select("conv_id", "turn", E.truncate(F.col("e"), 0).alias("t"))
    return made.select("conv_id", "turn", F.size("t.ids").cast("long").alias("kept"), F.size(F.col("t.overflowing")[0]["ids"]).cast("long").alias("cut"))


@_add("pad_left", f"SELECT conv_id, turn, CASE WHEN len(w) < 64 THEN '[PAD]' ELSE w[1] END AS first, coalesce(w[-1], '[PAD]') AS last, CAST(greatest(len(w), 64) AS BIGINT) AS length FROM {_TURNS}")
def pad_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lengths(spark, sf_dir).withColumn("e", E.with_overflow(F.col("e")))
    made = E.pad_table(rows, "e", length=64, direction="left")
    return made.select("conv_id", "turn", F.col("e.tokens")[0].alias("first"), F.element_at("e.tokens", -1).alias("last"), F.size("e.ids").cast("long").alias("length"))


# -- lookups


@_add("encoding_word_lookups", f"SELECT conv_id, turn, w[4] AS word, CAST(3 AS BIGINT) AS first, CAST(4 AS BIGINT) AS stop FROM {_TURNS} WHERE len(w) > 3")
def encoding_word_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and characters of the fourth word."""
    made = _encoded(spark, sf_dir, TextPipeline(_UNKNOWN, splitter=S.WhitespaceSplit()))
    chars, tokens = E.word_to_chars(F.col("e"), 3), E.word_to_tokens(F.col("e"), 3)
    rows = made.select("conv_id", "turn", "text", chars.alias("c"), tokens.alias("t")).where("t IS NOT NULL")
    return rows.select("conv_id", "turn", F.substring(F.col("text"), F.col("c.start") + 1, F.col("c.end") - F.col("c.start")).alias("word"), F.col("t.start").cast("long").alias("first"), F.col("t.end").cast("long").alias("stop"))


@_add("encoding_token_lookups", f"SELECT conv_id, turn, w[3] AS source, CAST(2 AS BIGINT) AS word, CAST(0 AS BIGINT) AS sequence FROM {_TURNS} WHERE len(w) > 2")
def encoding_token_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _encoded(spark, sf_dir, TextPipeline(_UNKNOWN, splitter=S.WhitespaceSplit())).where(F.size("e.ids") > 2)
    rows = made.select("conv_id", "turn", "text", E.token_to_chars(F.col("e"), 2).alias("c"), E.token_to_word(F.col("e"), 2).cast("long").alias("word"), E.token_to_sequence(F.col("e"), 2).cast("long").alias("sequence"))
    return rows.select("conv_id", "turn", F.substring(F.col("text"), F.col("c.start") + 1, F.col("c.end") - F.col("c.start")).alias("source"), "word", "sequence")


@_add("encoding_merge", f"SELECT conv_id, turn, CAST(2 * len(w) AS BIGINT) AS n, CAST(2 * length(w[-1]) AS BIGINT) AS last_end FROM {_TURNS} WHERE len(w) > 0")
def encoding_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lengths(spark, sf_dir).where(F.size("e.ids") > 0).select("conv_id", "turn", E.merge([F.col("e"), F.col("e")]).alias("m"))
    return rows.select("conv_id", "turn", F.size("m.ids").cast("long").alias("n"), F.element_at("m.offsets", -1)["end"].cast("long").alias("last_end"))


@_add("encoding_sequences", f"SELECT conv_id, turn, CAST(2 AS BIGINT) AS sequences, CAST(len(w) AS BIGINT) AS seconds FROM {_TURNS} WHERE len(w) > 0")
def encoding_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lengths(spark, sf_dir).where(F.size("e.ids") > 0).select("conv_id", "turn", E.bert_template().apply(F.col("e"), F.col("e")).alias("p"))
    return rows.select("conv_id", "turn", E.n_sequences(F.col("p")).cast("long").alias("sequences"), F.size(F.filter("p.sequence_ids", lambda s: s == 1)).cast("long").alias("seconds"))


@_add("encode_byte_offsets", f"SELECT conv_id, turn, CAST(octet_length(encode(regexp_replace(text, '[{_SPACE}]+$', ''))) AS BIGINT) AS last_byte FROM {_TURNS} WHERE len(w) > 0")
def encode_byte_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _encoded(spark, sf_dir, TextPipeline(_UNKNOWN, splitter=S.WhitespaceSplit()), offset_type="byte").where(F.size("e.ids") > 0)
    return made.select("conv_id", "turn", F.element_at("e.offsets", -1)["end"].cast("long").alias("last_byte"))


_ACCENTS = N.NormalizerSequence((N.UnicodeForm("NFD"), N.StripAccents(), N.Lowercase(), N.Strip()))


@_add("encode_offsets_of_normalized", f"SELECT doc_id, CAST(unnest(range(0, len(w))) AS BIGINT) AS pos, unnest(w) AS source FROM (SELECT doc_id, {_WORDS} AS w FROM documents)")
def encode_offsets_of_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets into the original of words without accents: what they cover are the words as they were."""
    made = TextPipeline(_UNKNOWN, _ACCENTS, S.WhitespaceSplit()).encode(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = made.select("doc_id", F.posexplode(E.covered(F.col("text"), F.col("encoding"))).alias("pos", "source"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "source")


@_add("encode_offsets_of_stripped", f"SELECT conv_id, turn, CAST(length(text) - length(regexp_replace(text, '^[{_SPACE}]+', '')) AS BIGINT) AS first, CAST(length(regexp_replace(text, '[{_SPACE}]+$', '')) AS BIGINT) AS stop FROM {_TURNS} WHERE len(w) > 0")
def encode_offsets_of_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _encoded(spark, sf_dir, TextPipeline(_UNKNOWN, N.Strip())).where(F.size("e.ids") > 0)
    return made.select("conv_id", "turn", F.col("e.offsets")[0]["start"].cast("long").alias("first"), F.col("e.offsets")[0]["end"].cast("long").alias("stop"))


@_add("char_slices", "SELECT conv_id, turn, CASE WHEN length(text) > 5 THEN substr(text, length(text) - 4, 3) ELSE substr(text, 1, greatest(length(text) - 2, 0)) END AS tail, substr(text, 3, greatest(length(text) - 3, 0)) AS inner FROM conversations")
def char_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices whose ends may count from the text's end."""
    turns = _table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", char_slice(F.col("text"), -5, -2).alias("tail"), char_slice(F.col("text"), 2, -1).alias("inner"))


# -- models on characters that they do not know

_LETTERS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
_SPLIT = f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^{_SPACE}]+')) AS word FROM documents) GROUP BY word"


def _tokens(model: Bpe) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        counts = word_counts(_table(spark, sf_dir, "documents"), "text", S.WhitespaceSplit())
        return token_totals(counts, model).groupBy("token").agg(F.sum("n").alias("n"))

    return query


def _tokens_sql(listed: str) -> str:
    return f"SELECT token, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest({listed}) AS token, n FROM ({_SPLIT})) GROUP BY token"


_hex = "list_transform(regexp_extract_all(hex(encode(c)), '..'), lambda h: '<0x' || h || '>')"
QUERIES["bpe_byte_fallback"] = _tokens(Bpe(_LETTERS | {f"<0x{b:02X}>": 26 + b for b in range(256)}, (), byte_fallback=True))
ORACLE_SQL["bpe_byte_fallback"] = _tokens_sql(f"flatten(list_transform(regexp_extract_all(word, '(?s).'), lambda c: CASE WHEN regexp_matches(c, '[a-z]') THEN [c] ELSE {_hex} END))")
QUERIES["bpe_unknown"] = _tokens(Bpe(_LETTERS | {"<unk>": 26}, (), unk_token="<unk>"))
ORACLE_SQL["bpe_unknown"] = _tokens_sql("list_transform(regexp_extract_all(word, '(?s).'), lambda c: CASE WHEN regexp_matches(c, '[a-z]') THEN c ELSE '<unk>' END)")
QUERIES["bpe_fused_unknown"] = _tokens(Bpe(_LETTERS | {"<unk>": 26}, (), unk_token="<unk>", fuse_unk=True))
ORACLE_SQL["bpe_fused_unknown"] = _tokens_sql("list_transform(regexp_extract_all(word, '[a-z]|[^a-z]+'), lambda c: CASE WHEN regexp_matches(c, '[a-z]') THEN c ELSE '<unk>' END)")
QUERIES["bpe_dropped_unknown"] = _tokens(Bpe(_LETTERS, ()))
ORACLE_SQL["bpe_dropped_unknown"] = _tokens_sql("regexp_extract_all(word, '[a-z]')")
QUERIES["bpe_whole_words"] = _tokens(Bpe(_LETTERS | {"the": 26, "de": 27}, (), ignore_merges=True))
ORACLE_SQL["bpe_whole_words"] = _tokens_sql("CASE WHEN word IN ('the', 'de') THEN [word] ELSE regexp_extract_all(word, '[a-z]') END")

# -- files and callers' own parts


def _written_lines(spark: SparkSession, sf_dir: str) -> str:
    """The documents' texts as text files in the shared folder."""
    files = Checkpoints(spark)
    _table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("value")).write.text(files.root)
    return files.root


@_add("text_lines", "SELECT line || chr(10) AS text, count(*) AS n FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) GROUP BY ALL")
def lines_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(spark, _written_lines(spark, sf_dir)).groupBy("text").agg(F.count("*").alias("n"))


@_add("train_from_files", f"SELECT word AS token, row_number() OVER (ORDER BY n DESC, word) AS id FROM ({_SPLIT} ORDER BY n DESC, word LIMIT 499) UNION ALL SELECT '<unk>', 0")
def vocabulary_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipe = train_from_files(spark, TextPipeline(WordLevel({}), splitter=S.WhitespaceSplit()), WordLevelTrainer(500, special_tokens=("<unk>",)), _written_lines(spark, sf_dir))
    return pipe.model.vocab_table(spark)


@_add("vocab_with_added_tokens", f"""SELECT '<unk>' AS token, 0::INT AS id UNION ALL SELECT '[X]', 50
UNION ALL (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word)::INT FROM (SELECT unnest({_WORDS}) AS word FROM documents) GROUP BY word ORDER BY count(*) DESC, word LIMIT 49)""")
def vocab_with_added_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' vocabulary of 50 with added tokens; one that the model knows is there once."""
    words = word_counts(_table(spark, sf_dir, "documents"), "text", S.WhitespaceSplit())
    model = WordLevelTrainer(50, special_tokens=("<unk>",)).train(words)
    pipe = TextPipeline(model).with_added_tokens([model.id_to_token(1), "[X]"])
    return spark.createDataFrame(sorted(pipe.vocab().items(), key=lambda x: x[1]), "token string, id int")


_PRINTABLE = "b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b >= 174"


@_add("byte_level_alphabet", f"""
WITH alphabet AS (SELECT b, chr(CASE WHEN {_PRINTABLE} THEN b ELSE 255 + CAST(row_number() OVER (PARTITION BY NOT ({_PRINTABLE}) ORDER BY b) AS INT) END) AS char FROM (SELECT CAST(unnest(range(0, 256)) AS INT) AS b)),
bytes AS (SELECT ('0x' || unnest(regexp_extract_all(hex(encode(text)), '..')))::INT AS b FROM documents)
SELECT b::BIGINT AS byte, char, count(*) AS n FROM bytes JOIN alphabet USING (b) GROUP BY ALL""")
def byte_level_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of the documents, the characters that stand for them, and how often they occur."""
    alphabet = spark.createDataFrame(list(enumerate(byte_alphabet())), "byte long, char string")
    pairs = _table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.hex(F.encode("text", "UTF-8")), F.lit(".."), F.lit(0))).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    return pairs.select(F.conv("pair", 16, 10).cast("long").alias("byte"), "n").join(F.broadcast(alphabet), "byte").select("byte", "char", "n")


@_add("custom_parts", "SELECT conv_id, turn, text || '!' AS marked, list_filter(string_split(text, 'e'), lambda x: x <> '') AS pieces, reverse(text) AS turned FROM conversations")
def custom_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's normalizer, splitter and decoder."""

    def at_e(part):
        at, out = 0, []
        for i, c in enumerate(part.text):
            if c == "e":
                out.append(part.slice(at, i))
                at = i + 1
        return [*out, part.slice(at, len(part.text))]

    turns, text = _table(spark, sf_dir, "conversations"), F.col("text")
    turned = D.CustomDecoder(lambda tokens: [t[::-1] for t in tokens[::-1]]).decode(F.array(text))
    return turns.select("conv_id", "turn", N.CustomNormalizer(lambda t: t.append("!")).column(text).alias("marked"), S.CustomSplitter(at_e).column(text).alias("pieces"), turned.alias("turned"))


@_add("norm_by_name", "SELECT doc_id, md5(nfc_normalize(text)) AS hash FROM documents")
def norm_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(N.normalizer_from_name("nfc").column(F.col("text"))).alias("hash"))
