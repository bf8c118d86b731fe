"""The operators' queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bpe_codec, decontaminate, fill_in_middle, language_id, license_rules, license_scan, line_dedup, near_dedup, neighbours, sharding, token_rollups, toxicity, url_reputation, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(_table(spark, sf_dir, "documents"))


def op3_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollups.maintained_totals(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.verdicts(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.places(_table(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_of_rows(_table(spark, sf_dir, "embeddings"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_near_dedup, op2_bpe_codec, op3_token_rollups, op4_toxicity, op5_line_dedup, op6_decontaminate, op7_url_reputation, op8_language_id, op9_sharding, op10_neighbours,
        op11_whitening, op12_license_scan, op13_fill_in_middle,
    )
}


def _reputation_sql() -> str:
    """Rules and posteriors of op7; the beta share is the same continued fraction, folded over a list."""
    upper, rules = url_reputation.UPPER, sorted(url_reputation.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in rules)
    levels = "|".join(url_reputation.SECOND_LEVEL)
    ip = r"regexp_matches({}, '^[0-9]+(\.[0-9]+){{3}}$')"
    label = "[^.]*"

    def strength(table: str) -> str:
        return f"""(SELECT CASE WHEN count(*) = 0 THEN 10.0 ELSE 1 / least(greatest((sum(l * pow(bad / l - mean, 2)) - sum(mean * (1 - mean)))
            / greatest(sum(l * mean * (1 - mean)) - sum(mean * (1 - mean)), 1e-9), 1e-3), 0.5) - 1 END FROM (SELECT *, labelled::DOUBLE AS l FROM {table} WHERE labelled > 0))"""

    def below(a: str, b: str, x: str) -> str:
        m = "floor(j / 2)"
        even = f"{m} * ({b} - {m}) * {x} / (({a} + 2 * {m} - 1) * ({a} + 2 * {m}))"
        odd = f"-({a} + {m}) * ({a} + {b} + {m}) * {x} / (({a} + 2 * {m}) * ({a} + 2 * {m} + 1))"
        fold = f"list_reduce(list_transform(range({url_reputation.TERMS} + {url_reputation.TERMS_BY_ROOT} * ceil(sqrt({a} + {b}))::BIGINT, 0, -1), lambda q: q::DOUBLE), lambda v, j: 1 + CASE WHEN j % 2 = 0 THEN {even} ELSE {odd} END / v, 1.0::DOUBLE)"
        return f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - {x})) / {a} / {fold}"

    x = url_reputation.LIMIT
    return rf"""WITH parsed AS (
      SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{upper.lower()}') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    known AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    outcomes AS (SELECT host, bad FROM (SELECT host, try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\.[0-9A-Za-z_]+)?/?$', 1), '') AS BIGINT) AS doc FROM parsed) LEFT JOIN known ON doc = doc_id),
    counted AS (SELECT host, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM outcomes GROUP BY host),
    named AS (SELECT *, CASE WHEN {ip.format("name")} THEN name WHEN regexp_matches(name, '(^|\.)({levels})\.[a-z][a-z]$') THEN regexp_extract(name, '({label}\.)?({label}\.)?{label}$')
        ELSE regexp_extract(name, '({label}\.)?{label}$') END AS domain FROM counted),
    hosts AS (SELECT *, CASE WHEN {ip.format("domain")} THEN '' ELSE regexp_replace(domain, '^{label}\.?', '') END AS suffix FROM named),
    domains0 AS (SELECT suffix, domain, sum(labelled) AS labelled, sum(bad) AS bad FROM hosts GROUP BY ALL),
    suffixes0 AS (SELECT suffix, sum(labelled) AS labelled, sum(bad) AS bad FROM domains0 GROUP BY ALL),
    suffixes1 AS (SELECT *, (SELECT (sum(bad) + {url_reputation.PRIOR_BAD})::DOUBLE / (sum(labelled) + {url_reputation.PRIOR_PAGES}) FROM suffixes0) AS mean FROM suffixes0),
    suffixes AS (SELECT suffix, (bad + s * mean) / (labelled + s) AS shrunk FROM suffixes1, (SELECT {strength("suffixes1")} AS s)),
    domains1 AS (SELECT d.*, s.shrunk AS mean FROM domains0 d JOIN suffixes s USING (suffix)),
    domains AS (SELECT domain, (bad + s * mean) / (labelled + s) AS shrunk FROM domains1, (SELECT {strength("domains1")} AS s)),
    hosts1 AS (SELECT h.*, d.shrunk AS mean FROM hosts h JOIN domains d USING (domain)),
    posteriors AS (SELECT host, (bad + s * mean) AS a, labelled + s - (bad + s * mean) AS b FROM hosts1, (SELECT {strength("hosts1")} AS s)),
    judged AS (SELECT host, CASE WHEN (CASE WHEN {x} < (a + 1) / (a + b + 2) THEN 1 - {below("a", "b", str(x))} ELSE {below("b", "a", f"(1 - {x})")} END) >= {url_reputation.CERTAINTY} THEN 'block' ELSE 'allow' END AS by_method FROM posteriors)
    SELECT page_id, host, path, CASE {rule} END AS rule, coalesce(CASE {verdict} END, by_method) AS verdict FROM parsed JOIN judged USING (host)"""


def _licenses_sql() -> str:
    """Spaced words, all rules' matches with their word numbers, and the same fold from left to right."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = lambda made: ", ".join(f"({r.order}, {quoted(r.label)}, {r.weight}::DOUBLE, {quoted(r.gate)}, {quoted(r.regex)})" for r in made)
    base = [license_rules.Rule(k, label, 1.0, "", license_rules.regex_of(phrase)) for k, (phrase, label) in enumerate(license_rules.BASE)]
    upper = url_reputation.UPPER
    n_words = lambda x: f"((length({x}) - length(replace({x}, ' ', ''))) // 2)"

    def spans(table: str) -> str:
        return f"""(SELECT r, ord, label, weight, {n_words("before")} AS start, {n_words("before || hit")} AS stop FROM (
            SELECT r, ord, label, weight, found[k] AS hit, coalesce(array_to_string(gaps[1:k], ''), '') || coalesce(array_to_string(found[1:k - 1], ''), '') AS before FROM (
            SELECT *, unnest(range(1, len(found) + 1)) AS k FROM (
            SELECT r, ord, label, weight, string_split_regex(spaced, regex) AS gaps, regexp_extract_all(spaced, regex) AS found FROM texts JOIN {table} ON contains(spaced, gate)))))"""

    return rf"""WITH texts AS (SELECT row_number() OVER () AS r, doc_id, ' ' || trim(regexp_replace(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\x00-/:-@\[-`{{-\x7f]+', '  ', 'g'), ' ') || ' ' AS spaced FROM documents),
    base(ord, label, weight, gate, regex) AS (VALUES {rows(base)}),
    rules(ord, label, weight, gate, regex) AS (VALUES {rows(license_rules.rules())}),
    places AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(label) AS base FROM {spans("base")} GROUP BY r),
    sorted AS (SELECT r, list([{{'start': start, 'stop': stop, 'ord': ord, 'label': label, 'weight': weight}}] ORDER BY start, -stop, ord) AS l FROM {spans("rules")} GROUP BY r),
    kept AS (SELECT r, list_reduce(l, lambda a, x: CASE WHEN x[1].stop <= a[-1].stop THEN a WHEN x[1].start >= a[-1].stop THEN a || x WHEN x[1].ord < a[-1].ord THEN a[:-2] || x ELSE a END) AS l FROM sorted)
    SELECT doc_id, CASE WHEN spaced = '  ' THEN 0 ELSE {n_words("spaced")} END::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
        array_to_string(list_sort(list_distinct(coalesce(base, []))), ',') AS base_labels,
        array_to_string(list_sort(list_distinct(coalesce(base, []) || coalesce(list_transform(l, lambda x: x.label), []))), ',') AS labels,
        1 - list_reduce(list_prepend(1::DOUBLE, coalesce(list_transform(l, lambda x: 1 - x.weight), [])), lambda a, b: a * b) AS score, coalesce(len(l), 0)::BIGINT AS n_detections
    FROM texts LEFT JOIN places USING (r) LEFT JOIN kept USING (r)"""


def _fill_in_middle_sql() -> str:
    draw = lambda k: f"('0x' || substr(digest, {8 * k + 1}, 8))::BIGINT"
    joined = lambda units: f"coalesce(array_to_string({units}, ''), '')"
    return rf"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, sha256('{fill_in_middle.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
    drawn AS (SELECT *, len(units) AS n, {draw(0)} % (len(units) + 1) AS a, {draw(1)} % (len(units) + 1) AS b,
        CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR {draw(2)} % 100 >= {fill_in_middle.FIM_PERCENT} THEN 'plain' WHEN {draw(3)} % 100 < {fill_in_middle.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM texts),
    cut AS (SELECT *, {joined("units[1:least(a, b)]")} AS p, {joined("units[least(a, b) + 1:greatest(a, b)]")} AS m, {joined("units[greatest(a, b) + 1:]")} AS s FROM drawn)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(p || m || s) AS restored_sha256 FROM cut"""


#: Whitening has no SQL (eigenvectors); tests hold it against a plain eigendecomposition.
ORACLE_SQL: dict[str, str] = {"op7_url_reputation": _reputation_sql(), "op12_license_scan": _licenses_sql(), "op13_fill_in_middle": _fill_in_middle_sql()}
