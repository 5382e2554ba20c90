"""DuckDB SQL of the core queries, written apart from the Spark plans; only the fixed signal patterns and venue lists are shared with them."""

from __future__ import annotations

from ..functions import signals
from ..operators import corpus

WHITE = r"\s\x1c-\x1f\x{85}\p{Z}"
FULL = lambda c: f"coalesce(regexp_matches({c}, '[^{WHITE}]'), false)"
STRIP = lambda c: f"regexp_replace({c}, '^[{WHITE}]+|[{WHITE}]+$', '', 'g')"
CLEAN = lambda c: f"regexp_replace(upper({STRIP(c)}), '^LABEL\\.', '')"

# The dialect has no lookbehind: a guarded phrase is put out of the way before the search.
GUARDS = {
    r"(?<!existing )(?<!a existing )(?<!standard )(?<!a standard )(?<!current )(?<!a current )(?<!popular )(?<!a popular )(?<!the standard )": "(?i)(existing|standard|current|popular) benchmark",
    r"(?<!native language )": "(?i)native language NLI",
    r"(?<!native )": "(?i)native language",
}


def _hit(pattern: str) -> str:
    text = "t"
    for guard, phrase in GUARDS.items():
        if pattern.startswith(guard):
            pattern, text = pattern[len(guard) :], f"regexp_replace(t, '{phrase}', '#', 'g')"
    p = signals.java(pattern)[len(signals.FLAGS) :].replace("'", "''")
    return f"CASE WHEN regexp_matches({text}, '(?i){p}') THEN 1 ELSE 0 END"


def _scored(papers: str = f"SELECT id, title || ' ' || abstract AS t FROM anthology_enriched WHERE {FULL('title')} AND {FULL('abstract')}", key: str = "id") -> str:
    cats = ",\n".join(f"({' + '.join(map(_hit, p))})::int AS {c}" for c, p in signals.SIGNALS.items())
    return f"""
p AS ({papers}),
s AS (SELECT {key}, {cats}, ({_hit(signals.METHOD)})::int AS introduces_method FROM p),
u AS (SELECT *, introduces + evaluates_on + benchmark_vocab AS sb, classif_explicit + classif_tasks + known_classif_benchmarks AS sc FROM s),
v AS (SELECT * EXCLUDE (sb, sc), (sb + CASE WHEN sb >= 1 THEN benchmark_weak ELSE 0 END)::int AS benchmark_total, (sc + CASE WHEN sc >= 1 THEN classif_weak ELSE 0 END)::int AS classif_total FROM u),
scored AS (SELECT *, CASE WHEN introduces >= 1 AND introduces_method < 1 AND classif_total >= 1 THEN 'A'
  WHEN known_classif_benchmarks >= 1 OR introduces >= 1 OR (classif_total >= 1 AND benchmark_vocab >= 1) THEN 'B' ELSE 'C' END AS bucket FROM v)"""


def _list(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


KIND = "CASE " + " ".join(f"WHEN x IN ({_list(n)}) THEN '{k}'" for k, n in corpus.CATEGORIES.items()) + " END"
CATEGORY = f"coalesce(list_filter(list_transform(venues, lambda x: {KIND}), lambda k: k IS NOT NULL)[1], 'unknown')"
KEPT = f"year BETWEEN 2013 AND 2026 AND list_has_any(venues, [{_list(corpus.KEPT)}])"

LATEST = """latest AS (SELECT bibkey, bucket, year FROM (SELECT *, row_number() OVER (PARTITION BY bibkey ORDER BY scored_at DESC NULLS LAST, bucket DESC NULLS LAST, year DESC NULLS LAST) AS rn
  FROM anthology_enriched_with_bucket WHERE bibkey IS NOT NULL) WHERE rn = 1)"""


def _stratified(name: str, source: str, quotas: dict[str, int], seed: int) -> str:
    """CTE ``name``: year by year in proportion, then the first rows in year order."""
    values = ", ".join(f"('{b}', {n})" for b, n in quotas.items())
    return f"""
{name}_q(bucket, q) AS (VALUES {values}),
{name}_r AS (SELECT r.*, count(*) OVER (PARTITION BY r.bucket, year) AS g, count(*) OVER (PARTITION BY r.bucket) AS b, q,
    row_number() OVER (PARTITION BY r.bucket, year ORDER BY md5('{seed}:' || bibkey), bibkey) AS rn FROM {source} r JOIN {name}_q USING (bucket)),
{name}_t AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY year, rn) AS place FROM {name}_r
    WHERE year IS NOT NULL AND rn <= greatest(1, round_even(least(q, b) * g / b, 0))),
{name} AS (SELECT bibkey, bucket, year FROM {name}_t WHERE place <= least(q, b))"""


def _fraction(name: str, source: str, part: str, seed: int) -> str:
    return f"""
{name} AS (SELECT bibkey, bucket, year FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('{seed}:' || bibkey), bibkey) AS rn, count(*) OVER (PARTITION BY bucket) AS n FROM {source})
    WHERE rn <= round_even(n * {part}::double, 0))"""


ABC, GOLD, POOL, SECOND = {"A": 400, "B": 400, "C": 300}, {"A": 70, "B": 70, "C": 70}, {"A": 500, "B": 400, "C": 300}, {"A": 100, "B": 100, "C": 0}
SAMPLE = f"WITH {LATEST}, {_stratified('s', 'latest', ABC, 42)}"

LABELLED = "rows AS (SELECT row_id, label FROM train UNION ALL SELECT row_id, label FROM val UNION ALL SELECT row_id, label FROM test), l AS (SELECT * FROM rows WHERE label IS NOT NULL)"
SPLIT = f"""WITH {LABELLED},
n AS (SELECT count(*) AS n, ceil((1.0::double - 0.70::double) * count(*)) AS held FROM l),
m AS (SELECT n, held, ceil((1.0::double - 0.15::double / (1.0::double - 0.70::double)) * held) AS test FROM n),
c AS (SELECT label, count(*) AS c FROM l GROUP BY label),
h1 AS (SELECT label, c, floor(c * held / n) AS f, row_number() OVER (ORDER BY floor(c * held / n) - c * held / n, cast(label AS varchar)) AS k FROM c, m),
h AS (SELECT label, f + CASE WHEN k <= (SELECT held FROM m) - (SELECT sum(f) FROM h1) THEN 1 ELSE 0 END AS held FROM h1),
t1 AS (SELECT label, h.held, floor(h.held * test / m.held) AS f, row_number() OVER (ORDER BY floor(h.held * test / m.held) - h.held * test / m.held, cast(label AS varchar)) AS k FROM h, m),
t AS (SELECT label, held, f + CASE WHEN k <= (SELECT test FROM m) - (SELECT sum(f) FROM t1) THEN 1 ELSE 0 END AS test FROM t1),
r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id), row_id) AS rn FROM l),
split AS (SELECT row_id, label, CASE WHEN rn <= test THEN 'test' WHEN rn <= held THEN 'val' ELSE 'train' END AS split FROM r JOIN t USING (label))"""

ANSWERS = """answers AS (SELECT rec_id::varchar AS key, rec_id % 29 <> 0 AND rec_id % 31 <> 0 AND rec_id % 37 <> 0 AND rec_id % 41 <> 0 AND label IN ('POSITIVE', 'NEGATIVE', 'UNSURE') AND reasoning IS NOT NULL AND justification IS NOT NULL AS valid, *
    FROM paper_taxonomy), parsed AS (SELECT * REPLACE (coalesce(valid, false) AS valid) FROM answers)"""
PARSED = f"WITH {ANSWERS} SELECT key, valid, " + ", ".join(f"CASE WHEN valid THEN {c} END AS {c}" for c in ("label", "reasoning", "justification", "task_type", "input_type", "domain", "is_multitask", "languages", "benchmark_names")) + " FROM parsed"

# What request lines say besides the message: the schema of an answer, in either form.
FIELDS = (
    ("reasoning", "string"), ("label", "label"), ("justification", "string"), ("benchmark_names", "array"), ("task_type", "string"), ("input_type", "string"), ("label_type", "string"),
    ("domain", "string"), ("languages", "array"), ("data_source", "string"), ("benchmark_novelty", "string"), ("is_multitask", "boolean"),
)
MUST = '"required":["reasoning","label","justification"]'
KINDS = {"string": '{"type":"string"}', "boolean": '{"type":"boolean"}', "array": '{"type":"array","items":{"type":"string"}}', "label": '{"$ref":"#/$defs/Label"}'}
UPPER = {"string": '"type":"STRING"', "boolean": '"type":"BOOLEAN"', "array": '"type":"ARRAY","items":{"type":"STRING"}', "label": '"type":"STRING","enum":["POSITIVE","NEGATIVE","UNSURE"]'}
JSON_SCHEMA = (
    '{"$defs":{"Label":{"type":"string","enum":["POSITIVE","NEGATIVE","UNSURE"]}},"type":"object","properties":{'
    + ",".join(f'"{n}":{KINDS[k]}' if i < 3 else f'"{n}":{{"anyOf":[{KINDS[k]},{{"type":"null"}}],"default":null}}' for i, (n, k) in enumerate(FIELDS)) + "}," + MUST + "}"
)
TYPED_SCHEMA = '{"type":"OBJECT","properties":{' + ",".join(f'"{n}":{{{UPPER[k]}' + ("}" if i < 3 else ',"nullable":true}') for i, (n, k) in enumerate(FIELDS)) + "}," + MUST + "}"
PROMPT = "Decide whether the paper introduces a new benchmark for text classification."
MESSAGE = "'Title: ' || coalesce(title, '') || chr(10) || 'Abstract: ' || coalesce(abstract, '')"
KEYWORDS = lambda t: f"""CASE WHEN {' OR '.join(f"contains(lower({t}), '{a} {b}')" for a in ('new', 'novel') for b in ('dataset', 'corpus', 'benchmark'))} THEN 'POSITIVE'"""

THREE = f"""three AS (SELECT bibkey, {', '.join(f"{CLEAN(c)} AS {c}" for c in ('google_label', 'deepseek_label', 'mistral_label'))} FROM (SELECT *, row_number() OVER
    (PARTITION BY bibkey ORDER BY merged_at DESC NULLS LAST, google_label DESC NULLS LAST, deepseek_label DESC NULLS LAST, mistral_label DESC NULLS LAST) AS rn FROM results_merged WHERE bibkey IS NOT NULL) WHERE rn = 1)"""
VOTE = """CASE WHEN google_label = deepseek_label OR google_label = mistral_label THEN google_label WHEN deepseek_label = mistral_label THEN deepseek_label ELSE google_label END"""
OTHER = "CASE WHEN google_label <> w THEN 'Google' WHEN deepseek_label <> w THEN 'DeepSeek' WHEN mistral_label <> w THEN 'Mistral' END"


def _kappa(a: str, b: str) -> str:
    both = f"(SELECT {a} AS a, {b} AS b FROM three WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    return f"""SELECT '{a}/{b}' AS pair, n, round(po, 6) AS observed, round(pe, 6) AS expected, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM (
  SELECT n, po, rc / (n::double * n) AS pe FROM (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0::double ELSE 0 END) AS po FROM {both}),
    (SELECT sum(x.n::double * y.n) AS rc FROM (SELECT a AS l, count(*) AS n FROM {both} GROUP BY 1) x JOIN (SELECT b AS l, count(*) AS n FROM {both} GROUP BY 1) y USING (l)))"""


def _provider(name: str) -> str:
    return f"""{name} AS (SELECT bibkey, label AS {name}_label, task_type AS {name}_task_type FROM (SELECT *, row_number() OVER (PARTITION BY bibkey ORDER BY received_at DESC NULLS LAST, label DESC NULLS LAST, task_type DESC NULLS LAST) AS rn
    FROM paper_taxonomy WHERE provider = '{name}' AND bibkey IS NOT NULL) WHERE rn = 1)"""


_TEST = f"SELECT row_id, bibkey, label, upper({STRIP('bucket')}) AS stratum, title || ' ' || abstract AS t FROM test WHERE label IS NOT NULL AND {FULL('title')} AND {FULL('abstract')}"
PREDICTED = f"""{_scored(_TEST, 'row_id, bibkey, label, stratum')},
x AS (SELECT row_id, bibkey, label, stratum AS bucket, 0.75::double AS l0, 0.8::double * introduces + 0.4::double * classif_total + 0.3::double * benchmark_vocab - 0.6::double * introduces_method AS l1 FROM scored),
predicted AS (SELECT row_id, bibkey, label, bucket, (l1 > l0)::int AS predicted, 1 / (1 + exp(-abs(l1 - l0))) AS confidence, 1 / (1 + exp(l0 - l1)) AS prob_positive FROM x)"""
UNION_LABELS = f"""a AS (SELECT bibkey, CASE {CLEAN('claude_label')} WHEN 'POSITIVE' THEN 1 WHEN 'NEGATIVE' THEN 0 END AS label, 0 AS part FROM merged UNION ALL SELECT bibkey, label, 1 FROM test),
            r AS (SELECT *, row_number() OVER (PARTITION BY bibkey ORDER BY part, label NULLS FIRST) AS rn FROM a)"""
METRICS = """count(*) AS n, count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) FILTER (label <> 1 AND predicted = 1) AS fp, count(*) FILTER (label = 1 AND predicted <> 1) AS fn,
  round(avg(CASE WHEN label = predicted THEN 1.0::double ELSE 0 END), 6) AS accuracy,
  round(coalesce(count(*) FILTER (label = 1 AND predicted = 1)::double / nullif(count(*) FILTER (predicted = 1), 0), 0), 6) AS precision,
  round(coalesce(count(*) FILTER (label = 1 AND predicted = 1)::double / nullif(count(*) FILTER (label = 1), 0), 0), 6) AS recall,
  round(coalesce(2.0::double * count(*) FILTER (label = 1 AND predicted = 1) / nullif(count(*) FILTER (label = 1) + count(*) FILTER (predicted = 1), 0), 0), 6) AS f1"""
WEIGHTS = lambda t: f"w AS (SELECT label, count(*) AS n, 0.5::double * sum(count(*)) OVER () / (count(*) OVER () * count(*)) + 0.5::double AS weight FROM {t} WHERE label IS NOT NULL GROUP BY label)"
ROWS3 = lambda c: " UNION ALL ".join(f"SELECT {c}, '{t}' AS split FROM {t}" for t in ("train", "val", "test"))


def statements() -> dict[str, str]:
    return {
        "catalog_projection": "SELECT id, bibkey, title, abstract, year::int AS year, authors[1] AS first_author, array_to_string(authors, '; ') AS authors, array_to_string(venues, '; ') AS venues, doi, url, language FROM anthology_enriched",
        "catalog_authors": "SELECT id, array_to_string(authors, '; ') AS authors FROM anthology_enriched",
        "last_segments": "SELECT id, string_split(url, '/')[-1] AS segment FROM anthology_enriched",
        "run_names": "SELECT rec_id, provider || '_test_' || strftime(received_at, '%Y%m%d_%H%M') AS run FROM paper_taxonomy",
        "random_cap": "SELECT bibkey FROM (SELECT DISTINCT bibkey FROM anthology_enriched WHERE year >= 2025 AND bibkey IS NOT NULL) ORDER BY md5('42:' || bibkey), bibkey LIMIT 300",
        "head_rows": "SELECT row_id, bibkey, title FROM train ORDER BY row_id LIMIT 5",
        "enumerated_rows": "SELECT row_id, bibkey, row_number() OVER (ORDER BY row_id) - 1 AS idx FROM train",
        "signal_scores": f"WITH {_scored()} SELECT * FROM scored",
        "bucket_counts": f"WITH {_scored()} SELECT bucket, count(*) AS n FROM scored GROUP BY bucket",
        "corpus_clean": f"SELECT id, bibkey, year, {CATEGORY} AS venue_type FROM anthology_enriched WHERE {KEPT}",
        "corpus_clean_with_abstract": f"SELECT id, abstract FROM anthology_enriched WHERE {KEPT} AND {FULL('abstract')}",
        "venue_type_counts": f"SELECT {CATEGORY} AS venue_type, count(*) AS n FROM anthology_enriched WHERE {KEPT} GROUP BY 1",
        "enrich_left_join": "SELECT p.id, p.bibkey, coalesce(p.abstract, d.text) AS abstract, d.n_chars AS numcitedby FROM anthology_enriched p LEFT JOIN (SELECT * FROM documents WHERE section = 'abstract') d ON p.bibkey = d.bibkey",
        "bucket_year_counts": "SELECT bucket, year, count(*) AS n FROM anthology_enriched_with_bucket WHERE bucket IS NOT NULL GROUP BY ALL",
        "stratified_sample": f"{SAMPLE} SELECT * FROM s",
        "sample_year_profile": f"{SAMPLE} SELECT bucket, year, count(*) AS n FROM s GROUP BY ALL",
        "val_split": f"{SAMPLE}, {_fraction('v', 's', '0.15', 42)} SELECT bibkey, s.bucket, CASE WHEN v.bibkey IS NULL THEN 'train' ELSE 'val' END AS split FROM s LEFT JOIN v USING (bibkey)",
        "gold_and_pool": f"""WITH {LATEST}, {_stratified('g', 'latest', GOLD, 42)}, rest AS (SELECT * FROM latest WHERE bibkey NOT IN (SELECT bibkey FROM g)),
            {_stratified('p', 'rest', POOL, 43)}, {_fraction('v', 'p', '0.15', 43)}
            SELECT bibkey, bucket, 'gold' AS split FROM g UNION ALL SELECT bibkey, p.bucket, CASE WHEN v.bibkey IS NULL THEN 'train' ELSE 'val' END FROM p LEFT JOIN v USING (bibkey)""",
        "second_round_pool": f"""WITH {LATEST}, rest AS (SELECT * FROM latest l WHERE NOT EXISTS (SELECT 1 FROM results_merged r WHERE r.bibkey = l.bibkey) AND NOT EXISTS (SELECT 1 FROM merged m WHERE m.bibkey = l.bibkey)),
            {_stratified('s', 'rest', SECOND, 42)} SELECT * FROM s""",
        "split_70_15_15": f"{SPLIT} SELECT * FROM split",
        "split_70_15_15_sizes": f"{SPLIT} SELECT split, label, count(*) AS n FROM split GROUP BY ALL",
        "label_parse": PARSED,
        "label_parse_google": PARSED,
        "label_parse_claude": PARSED,
        "label_parse_errors": f"WITH {ANSWERS} SELECT provider, n, n_errors FROM (SELECT count(*) AS n, count(*) FILTER (NOT valid) AS n_errors FROM parsed), (VALUES ('mistral'), ('google'), ('claude')) v(provider)",
        "label_merge_left": f"WITH {ANSWERS} SELECT key AS bibkey, provider, CASE WHEN valid THEN label END AS mistral_label, CASE WHEN valid THEN task_type END AS mistral_task_type, CASE WHEN valid THEN domain END AS mistral_domain FROM parsed",
        "request_lines": f"""SELECT provider, row_id::varchar AS name, {MESSAGE} AS content, '{PROMPT}' AS prompt, CASE WHEN provider <> 'google' THEN 'model-1' END AS model,
            CASE WHEN provider = 'google' THEN '{TYPED_SCHEMA}' ELSE '{JSON_SCHEMA}' END AS schema, CASE WHEN provider = 'claude' THEN '1024' ELSE '0.0' END AS number
            FROM train, (VALUES ('mistral'), ('google'), ('claude')) v(provider) WHERE row_id IS NOT NULL""",
        "bounded_labels": f"""SELECT row_id, CASE WHEN length(coalesce(title, '')) % 5 >= 3 THEN 'UNSURE' ELSE {KEYWORDS("coalesce(title, '') || ' ' || coalesce(abstract, '')")} WHEN {FULL('abstract')} THEN 'NEGATIVE' ELSE 'UNSURE' END END AS stub_label,
            CASE WHEN length(coalesce(title, '')) % 5 >= 3 THEN 'API Error' ELSE 'keywords' END AS stub_justification FROM val""",
        "batch_labels": f"""WITH m AS (SELECT row_id::varchar AS row_id, {MESSAGE} AS m FROM train) SELECT row_id, CASE WHEN length(m) % 7 <> 0 THEN {KEYWORDS("m")} ELSE 'UNSURE' END END AS google_label,
            CASE WHEN length(m) % 7 <> 0 THEN 'keywords' END AS google_justification FROM m""",
        "kappa_pairs": f"WITH {THREE} " + " UNION ALL ".join(_kappa(a, b) for a, b in (("google_label", "deepseek_label"), ("google_label", "mistral_label"), ("deepseek_label", "mistral_label"))),
        "confusion_long": f"WITH {THREE} SELECT google_label, mistral_label, count(*) AS n FROM three WHERE google_label IS NOT NULL AND mistral_label IS NOT NULL GROUP BY ALL",
        "confusion_matrix": f"""WITH {THREE}, l(google_label) AS (VALUES ('NEGATIVE'), ('POSITIVE'), ('UNSURE'))
            SELECT google_label, {', '.join(f"count(*) FILTER (mistral_label = '{x}') AS {x}" for x in ('NEGATIVE', 'POSITIVE', 'UNSURE'))} FROM l LEFT JOIN three USING (google_label) GROUP BY google_label""",
        "crosstab_margins": f"""WITH {THREE} SELECT CASE WHEN grouping(google_label) = 1 THEN 'All' ELSE google_label END AS google_label, CASE WHEN grouping(deepseek_label) = 1 THEN 'All' ELSE deepseek_label END AS deepseek_label, count(*) AS n
            FROM three t WHERE google_label IS NOT NULL AND deepseek_label IS NOT NULL GROUP BY CUBE (t.google_label, t.deepseek_label)""",
        "disagreements": f"WITH {THREE} SELECT bibkey, google_label, deepseek_label FROM three WHERE google_label IS DISTINCT FROM deepseek_label",
        "disagreement_rate": f"WITH {THREE} SELECT round(avg(CASE WHEN google_label <> deepseek_label THEN 1.0::double ELSE 0 END), 6) AS rate FROM three WHERE google_label IS NOT NULL AND deepseek_label IS NOT NULL",
        "majority_vote": f"WITH {THREE}, v AS (SELECT *, {VOTE} AS w FROM three WHERE google_label IS NOT NULL AND deepseek_label IS NOT NULL AND mistral_label IS NOT NULL) SELECT bibkey, w AS majority_label, {OTHER} AS dissenter FROM v",
        "taxonomy_merge": f"""WITH {_provider('google')}, {_provider('deepseek')}, {_provider('mistral')}, t AS (SELECT * FROM google JOIN deepseek USING (bibkey) JOIN mistral USING (bibkey)
            WHERE google_label IS NOT NULL AND deepseek_label IS NOT NULL AND mistral_label IS NOT NULL), v AS (SELECT *, {VOTE} AS w FROM t) SELECT * EXCLUDE (w), w AS majority_label, {OTHER} AS dissenter FROM v""",
        "positives_semi": f"WITH {_provider('google')} SELECT id, bibkey, year FROM anthology_enriched p WHERE year >= 2025 AND EXISTS (SELECT 1 FROM google g WHERE g.bibkey = p.bibkey AND google_label = 'POSITIVE')",
        "ready_split": f"""WITH m AS (SELECT bibkey, {CLEAN('claude_label')} AS l FROM (SELECT *, row_number() OVER (PARTITION BY bibkey ORDER BY labelled_at DESC NULLS LAST, claude_label DESC NULLS LAST) AS rn FROM merged WHERE bibkey IS NOT NULL) WHERE rn = 1),
            p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bibkey ORDER BY loaded_at DESC NULLS LAST, title DESC NULLS LAST, abstract DESC NULLS LAST) AS rn FROM anthology_enriched WHERE bibkey IS NOT NULL) WHERE rn = 1)
            SELECT bibkey, title, abstract, CASE l WHEN 'POSITIVE' THEN 1 ELSE 0 END AS label FROM m JOIN p USING (bibkey) WHERE l IN ('POSITIVE', 'NEGATIVE') AND {FULL('title')} AND {FULL('abstract')}""",
        "label_union_dedup": f"WITH {UNION_LABELS} SELECT bibkey, label::int AS label, CASE label WHEN 1 THEN 'POSITIVE' WHEN 0 THEN 'NEGATIVE' END AS label_name FROM r WHERE rn = 1",
        "predictions_with_labels": f"""WITH {PREDICTED}, {LATEST}, {UNION_LABELS} SELECT row_id, bibkey, predicted, latest.year, latest.bucket, CASE r.label WHEN 1 THEN 'POSITIVE' WHEN 0 THEN 'NEGATIVE' END AS llm_label
            FROM predicted JOIN latest USING (bibkey) JOIN r USING (bibkey) WHERE rn = 1""",
        "label_domain": f"WITH {THREE} SELECT string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT google_label AS label FROM three UNION SELECT mistral_label FROM three) WHERE label IS NOT NULL",
        "split_summary_total": f"""WITH r AS ({ROWS3('bucket')}), c AS (SELECT bucket, {', '.join(f"count(*) FILTER (split = '{t}') AS {t}" for t in ('train', 'val', 'test'))} FROM r WHERE bucket IS NOT NULL GROUP BY bucket)
            SELECT * FROM c UNION ALL SELECT 'Total', sum(train)::bigint, sum(val)::bigint, sum(test)::bigint FROM c""",
        "split_key_union": f"WITH r AS ({ROWS3('bibkey')}) SELECT count(*) AS n_rows, count(DISTINCT bibkey) AS n_keys FROM r",
        "split_overlap_check": "SELECT split, count(*) AS n FROM (SELECT bibkey, 'val' AS split FROM val UNION ALL SELECT bibkey, 'test' FROM test) WHERE bibkey IN (SELECT bibkey FROM train WHERE bibkey IS NOT NULL) GROUP BY split",
        "predictions_softmax": f"WITH {PREDICTED} SELECT row_id, bibkey, label, bucket, predicted, round(confidence, 6) AS confidence, round(prob_positive, 6) AS prob_positive FROM predicted",
        "uncertain_predictions": f"WITH {PREDICTED} SELECT row_id, predicted, round(confidence, 6) AS confidence FROM predicted WHERE confidence < 0.7",
        "metrics_overall": f"WITH {PREDICTED} SELECT {METRICS} FROM predicted",
        "metrics_by_bucket": f"WITH {PREDICTED} SELECT bucket, {METRICS} FROM predicted WHERE bucket IS NOT NULL GROUP BY bucket",
        "confusion_by_bucket": f"WITH {PREDICTED} SELECT bucket, label, predicted, count(*) AS n FROM predicted GROUP BY ALL",
        "best_bucket": f"WITH {PREDICTED}, m AS (SELECT bucket, {METRICS} FROM predicted WHERE bucket IS NOT NULL GROUP BY bucket) SELECT bucket, f1 FROM m ORDER BY f1 DESC, bucket LIMIT 1",
        "class_weights": f"WITH {WEIGHTS('train')} SELECT label, n, round(weight, 6) AS weight FROM w",
        "weighted_loss": f"WITH {PREDICTED}, {WEIGHTS('predicted')} SELECT round(sum(-weight * ln(CASE WHEN label = 1 THEN prob_positive ELSE 1 - prob_positive END)) / sum(weight), 4) AS loss FROM predicted JOIN w USING (label)",
    }
