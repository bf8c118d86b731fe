"""Codec, rollups, toxicity, reputation, language ID, sharding and neighbours."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import bpe_codec, language_id, neighbours, queries, sharding, token_rollups, toxicity, url_reputation

from textloom.llm.common import Scratch

SF = "/root/testdata/sf0.001"
RANKS = bpe_codec.default_ranks()


# -- codec


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab '\n.é中😀1", max_size=400), st.integers(1, 3))
def test_tree_of_halves_equals_one_pass(text, depth):
    parts = 1 << depth
    cuts = [len(text) * k // parts for k in range(parts + 1)]
    pieces = [text[a:b] for a, b in zip(cuts, cuts[1:])]
    joined = bpe_codec.join_tree(RANKS, [(p.encode(), bpe_codec.encode_text(RANKS, p)) for p in pieces], window=2)
    assert joined.tolist() == bpe_codec.encode_text(RANKS, text).tolist()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, " " * 4000 + "x", "don't " * 700, "<|endoftext|>" * 200, "中文" * 2000, "the quick brown fox " * 300, "'" * 999 + "re" + "!" * 999])
def test_long_runs_equal_one_pass(text):
    for parts in (2, 8):
        cuts = [len(text) * k // parts for k in range(parts + 1)]
        pieces = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        joined = bpe_codec.join_tree(RANKS, [(p.encode(), bpe_codec.encode_text(RANKS, p)) for p in pieces])
        assert joined.tolist() == bpe_codec.encode_text(RANKS, text).tolist()


def test_encode_and_decode_tables(spark):
    long = " ".join(f"word{i % 97} über" for i in range(900))
    rows = [(1, "Hello  world", "x"), (2, None, "y"), (3, "", "z"), (4, long, "l"), (4, long, "l"), (None, long, "n"), (5, "a<|endoftext|>b", None), (6, "x" * 3000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string").withColumn("token_ids", F.lit("old"))
    made = bpe_codec.decode(bpe_codec.encode(docs, long_chars=512)).collect()
    at_once = bpe_codec.encode(docs, long_chars=512, decoded_col="decoded")
    assert sorted(map(repr, at_once.collect())) == sorted(map(repr, made))
    assert len(made) == len(rows)
    for r in made:
        assert r.decoded == (r.text or "") and r.token_ids == bpe_codec.encode_text(RANKS, r.text or "").tolist()
    digest = {r.doc_id: r for r in bpe_codec.digests(docs.where("doc_id <> 4")).collect()}
    assert digest[2].n_tokens == 0 and digest[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert digest[1].decoded_sha256 == hashlib.sha256(b"Hello  world").hexdigest()
    assert bpe_codec.digests(docs.limit(0)).count() == 0


#: Made once with the library that reads the vocabulary file itself: of all texts' ids and decoded texts, and of the first 700 texts' ids.
CODEC_HASHES = ("63dbd790b87ecf29afab5105ee02955c42d2a318edc05cf59c9f378040f5d0f5", "20b2744d3dd292f2e2a31fb4129571bbe2d0d8eba5d5b2752460831ec76d7da4")


def codec_texts():
    rng = random.Random(11)
    parts = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "\t", "don't", "'ll", "é", "e\u0301", "中文", "😀", "\u00a0", "word", "Über", "1234", "!!", "\u200b", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(700)]
    return [*texts, " " * 40_000, "a" * 70_000, "<|endoftext|>" * 4000, "ab cd " * 20_000, *pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text.fillna("")]


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_codec_equals_stored_hashes(spark):
    docs = spark.createDataFrame(list(enumerate(codec_texts())), "doc_id long, text string").repartition(4)
    found = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.digests(docs).collect())
    ids = sorted((r.doc_id, list(r.token_ids)) for r in bpe_codec.encode(docs.where("doc_id < 700"), long_chars=64).collect())
    assert (digest(repr(found)), digest(repr(ids))) == CODEC_HASHES


def test_encode_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "ab " * 300, 5, "k", "p"), (2, "x", 6, "l", "q")], "doc_id long, text string, ids int, key string, piece string").withColumn("row", F.lit(1)).withColumn("part", F.lit(2))
    made = bpe_codec.encode(docs, long_chars=64)
    assert made.columns == [*docs.columns, "token_ids"] and sorted((r.doc_id, r.ids, r.key, r.row) for r in made.collect()) == [(1, 5, "k", 1), (2, 6, "l", 1)]


# -- rollups


def test_ledger_is_idempotent(spark, tmp_path):
    ledger = token_rollups.TokenLedger(spark, f"file://{tmp_path}/ledger")
    change = lambda *rows: spark.createDataFrame(list(rows), "op string, source string, lang string, tokenizer string, tokens long, old_tokens long")
    first = change(("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, "en", "v1", 7, None), ("insert", "b", None, "v1", None, None))
    ledger.commit("b1", first)
    ledger.commit("b1", first)
    ledger.commit("b2", change(("delete", "a", "en", "v1", 5, None), ("revise", None, "en", "v1", 9, 7), ("delete", "b", None, "v1", None, None)))
    ledger.commit("b3", change(("insert", "z", "z", "z", 1, None)))
    ledger.commit("b3", change(("insert", "z", "z", "z", 1, None)).limit(0))
    with pytest.raises(ValueError):
        ledger.commit("../b4", first)
    found = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in ledger.totals().collect()}
    assert found == {("a", "en", "v1"): (1, 10), (None, "en", "v1"): (1, 9)}
    # an attempt that broke off, or that no writer finished yet, does not count, and does not hide what was committed
    for broken in ("b1/attempt=000009", "b9/attempt=000001"):
        (tmp_path / "ledger" / f"batch_id={broken}").mkdir(parents=True)
    assert {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in ledger.totals().collect()} == found
    ledger.commit("b1", first)
    ledger.commit("b1", first)
    assert {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in ledger.totals().collect()} == found
    assert len(list((tmp_path / "ledger" / "batch_id=b1").iterdir())) <= 3
    assert token_rollups.TokenLedger(spark, f"file://{tmp_path}/none").totals().collect() == []
    folded = ledger.compact(f"file://{tmp_path}/folded", "c1")
    assert {(r.source, r.tokens) for r in folded.totals().collect()} == {("a", 10), (None, 9)}


def test_rollup_query_equals_direct_counts(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    found = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in queries.op3_token_rollups(spark, SF).collect()}
    for name, path in token_rollups.default_versions().items():
        sizes = docs.text.map(lambda t: len(bpe_codec.encode_text(path, t)))
        for key, n in sizes.groupby([docs.source, docs.lang]):
            assert found[(*key, name)] == (len(n), int(n.sum()))


def test_rollups_of_odd_documents(spark):
    rows = [(1, "some text", "a", None), (2, None, "a", "en"), (3, "", None, "en"), (None, "more", None, None), (1, "some text", "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("tokens", F.lit(99))
    found = {(r.source, r.lang, r.tokenizer): r.docs for r in token_rollups.maintained_totals(docs).collect()}
    assert {k[:2] for k in found} == {("a", None), (None, None)} and set(found.values()) == {2, 1}
    assert token_rollups.maintained_totals(docs.limit(0)).count() == 0
    long = docs.limit(1).withColumn("text", F.repeat(F.lit("word and word "), 30_000)).withColumn("batch_id", F.lit("b")).withColumn("op", F.lit("delete"))
    assert all(r.docs == 1 and r.tokens > 60_000 for r in token_rollups.maintained_totals(long).collect())


# -- toxicity


def test_grammar_scores_clauses():
    model = toxicity.ToxicityModel({"idiot": 4.0}, {"scum": 3.0}, np.array([0.0] * 6))
    score = lambda text: sum(model.clauses(text)[0])
    assert score("what a lovely day") == 0 and score("") == 0 and score(None) == 0
    assert score("you are an idiot") == score("an idiot like you") > score("an idiot") > score("not an idiot") > 0
    assert score("they said an idiot came") < score("an idiot came") * toxicity.AIM
    assert score("kill the lights") == 0 < score("I will kill you") == score("kill you") == score("beat them all") == score("you i will kill")
    assert 0 < score("do not kill them") < score("kill them")
    assert score("scumbags") > 0
    assert len(model.clauses("idiot! idiot. fine")[0]) == 2
    # a quotation that a speech verb opens is weakened to its end, beyond clauses, and what follows is not
    quoted = model.clauses('he said "an idiot. an idiot" then. an idiot')[0]
    assert quoted == pytest.approx([4.0 * 0.7 * toxicity.AIM, 4.0 * 0.7, 4.0])
    assert model.clauses('an "idiot"')[0] == [4.0]


def test_composed_machine_equals_its_parts_in_turn():
    rng = random.Random(5)
    parts = [toxicity.negated(), toxicity.reported(), toxicity.aimed(), toxicity.weighed()]
    _, machine = toxicity.grammar()
    for _ in range(400):
        tags = [rng.choice(toxicity.TAGS) for _ in range(rng.randint(0, 25))]
        turn, weights = tags, [1.0] * len(tags)
        for part in parts:
            out = part.run(turn)[0]
            turn, weights = [tag for tag, _ in out], [w * v for w, (_, v) in zip(weights, out)]
        made = machine.run(tags)[0]
        assert [t for t, _ in made] == turn and [w for _, w in made] == pytest.approx(weights)


def test_toxicity_sample_is_bounded(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text").unionByName(spark.range(20_000).selectExpr("id + 5000 AS doc_id", "'one and the same' AS text"))
    labels = docs.selectExpr("doc_id", "1 AS toxic")
    with Scratch(spark, "test") as scratch:
        assert 50 < toxicity.training_sample(docs, labels, scratch, 500).count() <= 700


@pytest.mark.parametrize("rate", [1.0, 1e-3, 1e-9, 1e-12])
def test_hash_limits_do_not_reach_zero(rate):
    limit = language_id.hash_limit(rate)
    assert -(1 << 63) < limit < 1 << 63 and abs((limit + (1 << 63)) / (1 << 64) - rate) < 1e-3 * rate


def test_toxicity_of_long_texts_and_clashing_columns(spark):
    model = toxicity.ToxicityModel({"idiot": 4.0}, {}, np.array([-1.0, 1.0, 0.0, 0.0, 0.0, 0.0]))
    docs = spark.createDataFrame([(1, "fine words " * 100_000 + "you idiot", "x", 1), (1, "fine", "y", 2)], "doc_id long, text string, score string, held_out int")
    rows = toxicity.score(docs, model).collect()
    assert sorted((r.score > 0.5, r.held_out) for r in rows) == [(False, 2), (True, 1)]


def test_toxicity_on_held_out_rows(spark):
    made = queries.op4_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.1/labels.parquet")
    held = made[made.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.toxic).mean() > 0.97
    toxic = held[held.toxic == 1]
    assert toxic.predicted.mean() > 0.85
    assert made.score.between(0, 1).all() and (made.predicted == (made.score >= 0.5)).all()
    assert (made.held_out == made.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "hi"), (1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.judge_documents(docs, labels).collect()
    assert len(rows) == 4 and all(r.score == 0 for r in rows)
    assert toxicity.judge_documents(docs.limit(0), labels).count() == 0


# -- reputation


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/7?x#y", "a://b://c/d", "https://a.net/de/9", "https://example.net/de/88", "http://x.org/es/", "http://example.com/en/8", "http://notexample.com", "ftp://h?q", "http://h#f", "http://aexample.com/en/7"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(3, urls[3]), (None, None)], "page_id long, url string").withColumn("bad", F.lit("clash"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = url_reputation.verdicts(pages, labels).collect()
    assert len(rows) == len(urls) + 2
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert by[3] == ("example.com", "/en/7", "example.com/en/7", "allow")
    assert by[0] == by[1] == by[2] == ("", "", None, "allow")
    assert by[4] == ("b:", "//c/d", None, "allow")
    assert by[5][2:] == ("net/de/", "block") and by[6][2:] == ("example.net/de/8", "block") and by[7][2:] == ("org/es/", "block") and by[8][2:] == ("com/en/", "block")
    assert by[9][:2] == ("notexample.com", "") and by[10][:2] == ("h", "") and by[11][:2] == ("h", "") and by[12][2] == "com/en/"
    assert url_reputation.verdicts(pages.limit(0), labels).count() == 0


def test_every_rule_has_the_word_of_its_contract(spark, tmp_path):
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    hosts = {"com/en/": "a.com/en/1", "example.com/en/7": "www.example.com/en/70", "net/de/": "a.net/de/9", "example.net/de/8": "example.net/de/8", "org/es/": "org/es/"}
    pd.DataFrame({"page_id": range(5), "url": [f"https://{hosts[r]}" for r in rules]}).to_parquet(tmp_path / "pages.parquet")
    pd.DataFrame({"doc_id": [1], "quality": [1], "toxic": [0]}).to_parquet(tmp_path / "labels.parquet")
    made = queries.op7_url_reputation(spark, str(tmp_path)).collect()
    assert {r.rule: r.verdict for r in made} == rules
    with duckdb.connect() as db:
        for t in ("pages", "labels"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        assert dict(db.sql(f"SELECT rule, verdict FROM ({queries.ORACLE_SQL['op7_url_reputation']})").fetchall()) == rules


def test_reputation_shrinks_towards_the_domain(spark):
    rows = [("bad.example.com", 1)] * 60 + [("good.example.com", 0)] * 60 + [("new.example.com", None)] + [("one.other.org", 1)] + [(f"h{i}.other.org", 0) for i in range(50)]
    given = spark.createDataFrame(rows, "host string, bad int").withColumn("times", F.lit(1))
    with Scratch(spark, "test") as scratch:
        found = {r.host: r for r in url_reputation.host_posteriors(given, scratch).collect()}
    assert found["bad.example.com"].share_above > url_reputation.CERTAINTY and found["good.example.com"].bad_rate < url_reputation.LIMIT
    assert found["good.example.com"].bad_rate < found["new.example.com"].bad_rate < found["bad.example.com"].bad_rate
    assert found["one.other.org"].share_above < url_reputation.CERTAINTY
    m = found["bad.example.com"]
    assert m.n == 60 and m.labelled == 60 and m.bad == 60 and 0 < m.bad_rate < 1


def test_beta_shares_equal_numeric_integrals(spark):
    cases = [(a, b) for a in (0.3, 1.0, 2.5, 40.0, 900.0, 4000.0) for b in (0.4, 1.0, 7.0, 130.0, 2700.0, 12_500.0)]
    rows = spark.createDataFrame(cases, "a double, b double").select("a", "b", url_reputation.share_above(F.col("a"), F.col("b")).alias("p")).collect()
    for r in rows:
        # y = x ** a takes away the pole that the density has at 0 for a < 1, and the other end is integrated as the rest
        def below(a, b, x):
            power = min(a, 1.0)
            y = (np.arange(400_000) + 0.5) / 400_000 * x**power
            t = y ** (1 / power)
            f = np.exp((a - power) * np.log(t) + (b - 1) * np.log1p(-t) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / power
            return float(f.sum() * x**power / 400_000)

        low = r.a / (r.a + r.b) > 0.25
        if max(r.a, r.b) < 500:
            true = 1 - below(r.a, r.b, 0.25) if low else below(r.b, r.a, 0.75)
            assert abs(r.p - true) < 1e-4, (r, true)
        else:
            assert (r.p > 0.5) == low or abs(r.p - 0.5) < 0.1


def test_beta_shares_of_large_hosts_equal_integrals_at_every_size(spark):
    cases = []
    for n in (500.0, 5_000.0, 19_990.0, 20_010.0, 40_000.0, 1e6, 1e8):
        for deviations in (-4.0, -1.0, 0.0, 1.0, 1.6, 1.66, 1.73, 4.0):
            a = n * (0.25 + deviations * math.sqrt(0.25 * 0.75 / n))
            cases.append((a, n - a))
    rows = spark.createDataFrame(cases, "a double, b double").select("a", "b", url_reputation.share_above(F.col("a"), F.col("b")).alias("p")).collect()
    for r in rows:
        mean, n = r.a / (r.a + r.b), r.a + r.b
        sd = math.sqrt(mean * (1 - mean) / n)

        def mass(low, high, a=r.a, b=r.b, mean=mean):
            t = low + (np.arange(100_000) + 0.5) / 100_000 * (high - low)
            top = a * math.log(mean) + b * math.log1p(-mean)
            return float(np.exp((a - 1) * np.log(t) + (b - 1) * np.log1p(-t) - top).sum() * (high - low))

        low, high = max(1e-12, min(mean - 12 * sd, 0.25 - sd)), min(1 - 1e-12, max(mean + 12 * sd, 0.25 + sd))
        above, below = mass(0.25, high), mass(low, 0.25)
        assert abs(r.p - above / (above + below)) < 2e-5, (r, above / (above + below))


def test_verdicts_of_large_hosts_equal_the_sql(spark, tmp_path):
    hosts, doc, pages, outcomes = [], 0, [], []
    for n in (300, 19_990, 20_010, 40_000):
        for k, deviations in enumerate((1.5, 1.64, 1.66, 1.7, 1.8)):
            bad = round(n * 0.25 + deviations * math.sqrt(n * 0.25 * 0.75))
            hosts.append(f"h{k}.site{n}.info")
            pages.append(pd.DataFrame({"page_id": range(doc, doc + n), "url": [f"http://{hosts[-1]}/x/{i}" for i in range(doc, doc + n)]}))
            outcomes.append(pd.DataFrame({"doc_id": range(doc, doc + n), "quality": [0] * bad + [1] * (n - bad), "toxic": 0}))
            doc += n
    none = pd.DataFrame({"page_id": [-1, -2, -3, -3], "url": [None, "no url", "http://h0.site300.info/" + "y" * 100_000, "http://h0.site300.info/" + "y" * 100_000]})
    pd.concat([*pages, none]).to_parquet(tmp_path / "pages.parquet")
    pd.concat(outcomes).to_parquet(tmp_path / "labels.parquet")
    with duckdb.connect() as db:
        for t in ("pages", "labels"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        want = db.sql(f"SELECT host, verdict, count(*) FROM ({queries.ORACLE_SQL['op7_url_reputation']}) GROUP BY ALL").fetchall()
    made = queries.op7_url_reputation(spark, str(tmp_path)).groupBy("host", "verdict").count()
    assert sorted(map(tuple, made.collect())) == sorted(want)
    assert {v for h, v, _ in want if ".site" in h} == {"allow", "block"} and sum(n for _, _, n in want) == doc + 4


def test_registered_domains(spark):
    cases = {"a.b.example.com": "example.com", "x.example.co.uk": "example.co.uk", "u@h.example.org:80": "example.org", "10.0.0.1:8080": "10.0.0.1", "localhost": "localhost", "": "", "co.uk": "co.uk"}
    host = F.col("host")
    rows = spark.createDataFrame([(h,) for h in cases], "host string").select(host, url_reputation.registered_domain(host).alias("domain")).collect()
    assert {r.host: r.domain for r in rows} == cases
    suffixes = spark.createDataFrame([("example.com",), ("example.co.uk",), ("10.0.0.1",), ("localhost",)], "d string").select(url_reputation.suffix_of(F.col("d")).alias("s")).collect()
    assert [r.s for r in suffixes] == ["com", "co.uk", "", ""]


# -- language


def test_language_on_held_out_rows(spark):
    made = queries.op8_language_id(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/documents.parquet"), on="doc_id")
    held = made[made.held_out]
    assert len(held) and (held.lang_pred == held.lang).mean() > 0.98
    assert (made.held_out == made.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()


def test_language_of_odd_texts(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("die katze und der hund", "de")] * 8)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !?", "fr"), (None, "le chien", None), (103, "the cat and the dog " * 20_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (100, 101, 102))
    assert found[103].lang_pred == "en" and not found[None].held_out
    assert language_id.identify(docs.limit(0)).count() == 0
    assert {r.doc_id for r in language_id.accepted(docs).where("doc_id > 99").collect()} == {103}
    clashing = docs.withColumn("score", F.lit("s")).withColumn("language", F.lit("l")).withColumn("label", F.lit("x"))
    assert language_id.accepted(clashing).columns == clashing.columns
    model = language_id.fit(docs)
    made = language_id.predict(clashing, model, F.col("text"))
    assert made.columns == ["doc_id", "text", "lang", "language", "label", "lang_pred", "score"] and made.count() == len(rows)


def test_texts_in_no_learned_language_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    foreign = ["Всё смешалось в доме Облонских, и жена узнала, что муж был в связи с бывшею в их доме гувернанткой.", "Zażółć gęślą jaźń i pójdź po chleb do sklepu, bo jutro będzie święto i wszystko będzie zamknięte.", "我今天去了北京的商店买了很多东西然后回家吃饭睡觉看电视非常高兴" * 3]
    rows = spark.createDataFrame([(-i - 1, t, None) for i, t in enumerate(foreign)], docs.schema)
    kept = {r.doc_id for r in language_id.accepted(docs.unionByName(rows)).select("doc_id").collect()}
    clean = {r.doc_id for r in docs.where("text RLIKE '[A-Za-z]{3}'").select("doc_id").collect()}
    assert not kept & {-1, -2, -3} and clean <= kept


def test_more_languages_than_have_weights_of_their_own(spark):
    letters = [chr(0x4E00 + 7 * k) for k in range(600)]
    rows = [(3 * k + n, f"{a}{a} {a} {a}{a}{a}"[: 4 + n], f"l{k}") for k, a in enumerate(letters) for n in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert len(model.languages) == 600 and model.weights.size <= language_id.MOST_WEIGHTS < 600 * language_id.FEATURES
    found = [model.predict(f"{a} {a}{a}")[0] == f"l{k}" for k, a in enumerate(letters)]
    assert sum(found) > 0.95 * len(found)
    assert [language_id.width_for(n) for n in (0, 1, 512, 513, 1 << 24, 1 << 30)] == [1 << 15, 1 << 15, 1 << 15, 1 << 14, 1, 1]


def test_shared_weights_add_up():
    found, x = np.array([0, 1, 5, 32767]), np.array([1.0, 2.0, 4.0, 8.0])
    slots, sums = language_id.shared_weights(found, x, language_id.FEATURES // 4)
    assert slots.tolist() == [0, 1, 8191] and sums.tolist() == [3.0, 4.0, 8.0]
    assert language_id.shared_weights(found, x, language_id.FEATURES)[1] is x


def test_ftrl_equals_a_plain_version():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(60):
        found = np.sort(rng.choice(50, rng.integers(2, 8), replace=False))
        rows.append((found, rng.random(len(found)), int(rng.integers(0, 3))))
    z, n = {}, {}

    def weight(c, f):
        a, b = z.get((c, f), 0.0), n.get((c, f), 0.0)
        return 0.0 if abs(a) <= language_id.L1 else (math.copysign(language_id.L1, a) - a) / ((language_id.BETA + math.sqrt(b)) / language_id.ALPHA + language_id.L2)

    order = np.random.default_rng(7)
    for _ in range(language_id.EPOCHS):
        for k in order.permutation(len(rows)):
            found, x, label = rows[k]
            w = {(c, f): weight(c, f) for c in range(3) for f in found}
            logit = [sum(w[c, f] * v for f, v in zip(found, x)) for c in range(3)]
            total = sum(math.exp(v) for v in logit)
            for c in range(3):
                error = math.exp(logit[c]) / total - (c == label)
                for f, v in zip(found, x):
                    g, old = error * v, n.get((c, f), 0.0)
                    n[c, f] = old + g * g
                    z[c, f] = z.get((c, f), 0.0) + g - (math.sqrt(n[c, f]) - math.sqrt(old)) / language_id.ALPHA * w[c, f]
    made = language_id.fit_ftrl(rows, 3)
    assert np.allclose([[made[c, f] for f in range(50)] for c in range(3)], [[weight(c, f) for f in range(50)] for c in range(3)])


def test_language_sample_takes_a_repeated_text_once(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog", "en") for i in range(20_000)] + [(20_000 + i, f"le chien numero {i % 7} dort", "fr") for i in range(300)], "doc_id long, text string, lang string")
    model = language_id.fit(docs, sample_rows=200)
    assert model.languages == ("en", "fr") and model.predict("le chien dort")[0] == "fr" and model.predict("the dog")[0] == "en"


def test_temperature_makes_probabilities_honest():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 2, 4000)
    logits = np.where(np.eye(2)[labels] > 0, 4.0, 0.0)
    wrong = rng.random(4000) < 0.25
    logits[wrong] = logits[wrong][:, ::-1]
    t = language_id.fit_temperature(logits, labels)
    assert abs(1 / (1 + math.exp(-4 / t)) - 0.75) < 0.03


# -- sharding


def check_places(rows, shards=8):
    sizes = pd.Series([r.shard for r in rows]).value_counts().reindex(range(shards), fill_value=0)
    assert sizes.max() - sizes.min() <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


@pytest.mark.parametrize("bucket", [200, 1 << 20])
def test_shards_are_even_and_gapless(spark, bucket):
    rng = random.Random(2)
    rows = [(i, "t" * rng.randint(0, 40), 1) for i in range(301)] + [(7, "same", 2)] * 500 + [(None, None, 3)] * 3 + [(9, "y" * 5000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(5).withColumn("bucket", F.col("slot")).withColumn("__bucket", F.col("slot")).withColumn("order", F.col("slot")).withColumn("row", F.lit("r"))
    made = sharding.external_shuffle(docs, bucket_bytes=bucket)
    assert made.columns == ["doc_id", "text", "bucket", "__bucket", "order", "row", "shard", "slot"]
    made = made.collect()
    assert all(r.bucket == r["__bucket"] == r.order for r in made) and {r.bucket for r in made} == {1, 2, 3, 4}
    assert sorted((str(r.doc_id), str(r.text)) for r in made) == sorted((str(i), str(t)) for i, t, _ in rows)
    check_places(made)


def test_sharding_query_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "é"), (2, None), (3, "")], "doc_id long, text string")
    found = {r.doc_id: r for r in sharding.places(docs).collect()}
    assert found[1]["size"] == 3 and found[2]["size"] == 1 and found[1].text_crc32 == zlib.crc32("é".encode()) and found[1].law == "rows" and found[1].grown_shard is None
    check_places(list(found.values()))
    assert sharding.places(docs.limit(0)).count() == 0


def test_sharding_of_the_documents(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    made = queries.op9_sharding(spark, SF).toPandas().merge(docs, on="doc_id")
    assert len(made) == len(docs) and (made.law == "rows").all() and made.grown_shard.isna().all()
    raw = made.text.fillna("").map(str.encode)
    assert (made["size"] == raw.map(len) + 1).all() and (made.text_crc32 == raw.map(zlib.crc32)).all()
    check_places(list(made.itertuples()))
    # neighbours of the table are dealt all over
    assert made.sort_values("doc_id").shard.diff().abs().mean() > 1.5


def test_fisher_yates_is_uniform():
    seen = pd.Series([tuple(sharding.fisher_yates(3, [k])) for k in range(6000)]).value_counts()
    assert len(seen) == 6 and seen.between(850, 1150).all()


def test_shards_are_written_in_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "doc_id long, text string")
    sharding.write_shards(sharding.external_shuffle(docs), f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards").collect()
    check_places(back)


# -- neighbours


def exact(vectors, k):
    usable = {i: np.array(v) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    out = []
    for q in sorted(i for i in usable if i % 50 == 0):
        cos = {i: float(np.dot(usable[q], v) / np.linalg.norm(usable[q]) / np.linalg.norm(v)) for i, v in usable.items() if i != q}
        out += [(q, r, i) for r, i in enumerate(sorted(cos, key=lambda i: (-round(cos[i], 12), i))[:k], 1)]
    return out


def test_neighbours_of_few_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.standard_normal(8).tolist()) for i in range(120)]
    vectors += [(150, None), (200, [0.0] * 8), (201, [math.nan] + [1.0] * 7), (202, [math.inf] + [1.0] * 7), (203, [None] + [1.0] * 7), (None, [1.0] * 8), (250, vectors[3][1]), (251, vectors[3][1])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1))
    found = neighbours.search(table).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == exact(vectors, 5)
    assert neighbours.search(table.limit(0)).count() == 0
    assert [(r.query_id, r.vec_id) for r in neighbours.search(table.where("vec_id IN (0, 1)")).collect()] == [(0, 1)]


def test_neighbours_of_tiny_and_huge_vectors(spark):
    rng = np.random.default_rng(14)
    sizes = [1e-300, 1e-200, 1.0, 1e200, 1e300]
    vectors = [(i, rng.standard_normal(8) * sizes[i % 5]) for i in range(200)] + [(200, np.array([1e200, 1e-200] * 4)), (201, np.full(8, 5e-324))]
    unit = {i: v / np.abs(v).max() for i, v in vectors}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    expected = {}
    for q in range(0, 201, 50):
        cosines = {i: float(unit[q] @ v) for i, v in unit.items() if i != q}
        for r, i in enumerate(sorted(cosines, key=lambda i: (-cosines[i], i))[:5], 1):
            expected[q, r] = i, cosines[i]
    found = neighbours.search(spark.createDataFrame([(i, v.tolist()) for i, v in vectors], "vec_id long, embedding array<double>")).collect()
    assert {(r.query_id, r["rank"]): r.vec_id for r in found} == {k: i for k, (i, _) in expected.items()}
    assert all(abs(r.score - expected[r.query_id, r["rank"]][1]) < 1e-12 for r in found)


def test_repeated_rows_are_one_neighbour(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, rng.standard_normal(8)) for i in range(120)]
    # the nearest of 0 is repeated more than k times, as it is and with other vectors; a query has two vectors
    vectors += [(121, vectors[0][1] + 0.001)] * 8 + [(121, vectors[0][1] + 0.001 * n) for n in range(2, 10)] + [(50, rng.standard_normal(8))]
    best = {}
    for q, a in vectors:
        for i, b in vectors:
            if q % 50 == 0 and i != q:
                best[q, i] = max(best.get((q, i), -1), float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)))
    expected = [(q, r, i) for q in (0, 50, 100) for r, i in enumerate(sorted((i for p, i in best if p == q), key=lambda i: -best[q, i])[:5], 1)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in vectors], "vec_id long, embedding array<double>")
    found = neighbours.search(table).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == expected
    # where only the repeats of one id are near, the other rows are ranked as well
    code = neighbours.BinaryCode(np.zeros(8), np.eye(8), 0.0)
    ids, rows = np.array([1] * 9 + [2, 3]), np.vstack([np.ones((9, 8)), -np.ones((2, 8))])
    assert neighbours.Block(code, ids, rows).search(3, np.array([0]), np.ones((1, 8)))[1].tolist() == [1, 2, 3]


def test_recall_of_neighbours(spark):
    data = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet")
    true = set(exact(list(zip(data.vec_id, data.embedding)), 5))
    found = queries.op10_neighbours(spark, "/root/testdata/sf0.1").collect()
    pairs = {(q, i) for q, _, i in true}
    assert len({(r.query_id, r.vec_id) for r in found} & pairs) / len(pairs) >= 0.95


def test_looking_up_finds_every_code_within_the_radius():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 256, (3000, 4), dtype=np.uint8)
    codes = np.pad(codes, ((0, 0), (0, 4)))[:, :8]
    queries = codes[:40] ^ np.packbits(rng.random((40, 64)) < 0.04, axis=1)
    tables = neighbours.substring_tables(codes)
    found = {(int(q), int(v)) for bits in range(neighbours.REACH + 1) for q, v in zip(*neighbours.look_up(tables, queries, bits))}
    apart = neighbours.hamming(queries, codes)
    within = set(zip(*(x.tolist() for x in np.nonzero(apart <= len(tables) * (neighbours.REACH + 1) - 1))))
    assert within <= found and len(within) > 40
    parts, asked = codes.view(np.uint16), queries.view(np.uint16)
    near = np.bitwise_count(asked[:, None, :] ^ parts[None, :, :]).min(axis=2) <= neighbours.REACH
    assert found == set(zip(*(x.tolist() for x in np.nonzero(near))))


def test_near_neighbours_are_looked_up_and_few_are_ranked():
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((400, 64))
    vectors = np.repeat(centres, 20, axis=0) + 0.05 * rng.standard_normal((8000, 64))
    code = neighbours.fit(vectors[::4])
    block = neighbours.Block(code, np.arange(8000), vectors)
    asked = np.arange(0, 8000, 50)
    q, v, _ = block.search(5, asked, vectors[asked])
    near = exact_of(vectors, asked)
    assert len({*zip(q.tolist(), v.tolist())} & near) / len(near) > 0.9
    assert block.ranked < 0.02 * len(asked) * 8000


def exact_of(vectors, asked, k=5):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit[asked] @ unit.T
    near[np.arange(len(asked)), asked] = -2
    return {(int(q), int(v)) for q, row in zip(asked, np.argsort(-near, axis=1)[:, :k]) for v in row}


def test_rows_to_fit_take_six_bytes_a_feature():
    idf, rng = np.linspace(1, 9, language_id.FEATURES), np.random.default_rng(2)
    for width in (language_id.FEATURES, language_id.FEATURES // 8):
        rows = language_id.Sample(idf, width)
        texts = [language_id.ngram_counts("".join(rng.choice(list("abc é\u4e2d"), 400))) for _ in range(5)]
        for k, grams in enumerate(texts):
            rows.add(grams, k)
        assert sum(a.nbytes + b.nbytes for a, b, _ in rows.rows) == 6 * sum(len(g[0]) for g in texts)
        for (found, x, label), (k, grams) in zip(rows, enumerate(texts), strict=True):
            a, b = language_id.shared_weights(*language_id.weighted(grams, idf), width)
            assert label == k and (found == a).all() and (x == b).all()


def test_language_learns_from_all_rows(spark):
    # each text has a letter of its own, so a text that is left out is not known
    texts = [(i, f"{chr(0x4E00 + 11 * i)}{chr(0x4E00 + 11 * i)} {chr(0x4E00 + 11 * i)}", "odd" if i % 2 else "even") for i in range(240)] + [(1000 + i, f"rare {'abcd'[i]}", "rare") for i in range(4)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(3)
    model = language_id.fit(docs, sample_rows=24)
    # a fifth is held back
    assert sum(model.predict(t)[0] == lang for _, t, lang in texts) > 0.8 * len(texts)
    assert model.predict("rare a")[0] == "rare"


def test_parts_of_languages():
    assert language_id.parts_of({"a": 5, "b": 7}, 100) == (1, {"a": 1, "b": 1})
    assert language_id.parts_of({"a": 900, "b": 90, "c": 10, "d": 1}, 96) == (11, {"a": 11, "b": 11, "c": 3, "d": 1})
