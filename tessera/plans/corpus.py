"""The queries of the core library, each over its whole tables. Their SQL is in ``sql.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import last_segment, strip
from ..operators import agreement, annotators, corpus, labels, learning, packed, predictions, sampling
from ..session import materialize
from ..sources.settings import Settings, Sweep
from ..sources.tables import read_table
from ..streaming import labelling
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
ABC = {"A": 400, "B": 400, "C": 300}
GOLD = {"A": 70, "B": 70, "C": 70}
POOL = {"A": 500, "B": 400, "C": 300}
SECOND = {"A": 100, "B": 100, "C": 0}
TASK = labels.register("taxonomy", labels.Task("Decide whether the paper introduces a new benchmark for text classification."))


def _r6(c: Column | str) -> Column:
    return F.round(c, 6)


def _papers(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return read_table(spark, d, "anthology_enriched", *columns)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return corpus.score(corpus.with_text(_papers(spark, d, "id", "title", "abstract"), "title", "abstract"))


def _bucketed(spark: SparkSession, d: str) -> DataFrame:
    return sampling.keep_latest(read_table(spark, d, "anthology_enriched_with_bucket", "bibkey", "scored_at", "bucket", "year"), "bibkey", "scored_at").select("bibkey", "bucket", "year")


def _clean_label(c: str) -> Column:
    return F.regexp_replace(F.upper(strip(c)), r"^LABEL\.", "").alias(c)


def _three(spark: SparkSession, d: str) -> DataFrame:
    names = ["google_label", "deepseek_label", "mistral_label"]
    rows = read_table(spark, d, "results_merged", "bibkey", "merged_at", *names)
    return sampling.keep_latest(rows, "bibkey", "merged_at").select("bibkey", *map(_clean_label, names))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.split_packed(read_table(spark, d, "paper_taxonomy"), "rec_id", {"benchmark_names": "name", "languages": "code"})


def catalog_projection(spark: SparkSession, d: str) -> DataFrame:
    p = corpus.project(_papers(spark, d))
    joined = lambda c: F.array_join(c, "; ").alias(c)
    return p.select("id", "bibkey", "title", "abstract", F.col("year").cast("int").alias("year"), F.get("authors", F.lit(0)).alias("first_author"), joined("authors"), joined("venues"), "doi", "url", "language")


def catalog_authors(spark: SparkSession, d: str) -> DataFrame:
    """From records that hold each author as an object with the parts of the name, as catalogues land."""
    person = lambda a: F.struct(F.struct(F.nullif(F.regexp_extract(a, r"^(.*) [^ ]*$", 1), F.lit("")).alias("first"), F.substring_index(a, " ", -1).alias("last")).alias("name"))
    landed = _papers(spark, d, "id", "authors").withColumn("authors", F.transform("authors", person))
    return corpus.project(landed).select("id", F.array_join("authors", "; ").alias("authors"))


def last_segments(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d, "id", "url").select("id", last_segment("url").alias("segment"))


def run_names(spark: SparkSession, d: str) -> DataFrame:
    """The name of a run that began when an answer was received."""
    rows = read_table(spark, d, "paper_taxonomy", "rec_id", "provider", "received_at")
    return rows.select("rec_id", F.concat(last_segment("provider"), F.lit("_test_"), F.date_format("received_at", "yyyyMMdd_HHmm")).alias("run"))


def random_cap(spark: SparkSession, d: str) -> DataFrame:
    keys = _papers(spark, d, "bibkey", "year").filter("year >= 2025 and bibkey is not null").select("bibkey").distinct()
    return sampling.cap(keys, "bibkey", 300, 42)


def head_rows(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "train", "row_id", "bibkey", "title").orderBy("row_id").limit(5)


def enumerated_rows(spark: SparkSession, d: str) -> DataFrame:
    return sampling.enumerated(read_table(spark, d, "train", "row_id", "bibkey"), "row_id")


def signal_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).drop("title", "abstract")


def bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).groupBy("bucket").agg(F.count("*").alias("n"))


def corpus_clean(spark: SparkSession, d: str) -> DataFrame:
    return corpus.clean(_papers(spark, d, "id", "bibkey", "year", "venues")).select("id", "bibkey", "year", "venue_type")


def corpus_clean_with_abstract(spark: SparkSession, d: str) -> DataFrame:
    return corpus.with_text(corpus.clean(_papers(spark, d, "id", "year", "venues", "abstract")), "abstract").select("id", "abstract")


def venue_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.clean(_papers(spark, d, "year", "venues")).groupBy("venue_type").agg(F.count("*").alias("n"))


def enrich_left_join(spark: SparkSession, d: str) -> DataFrame:
    second = read_table(spark, d, "documents").filter("section = 'abstract'").select(F.col("bibkey").alias("acl_id"), F.col("text").alias("abstract"), F.col("n_chars").alias("numcitedby"))
    return corpus.enrich(_papers(spark, d, "id", "bibkey", "abstract", "numcitedby"), second, "bibkey", "acl_id", ["numcitedby"]).select("id", "bibkey", "abstract", "numcitedby")


def bucket_year_counts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "anthology_enriched_with_bucket", "bucket", "year").filter("bucket is not null").groupBy("bucket", "year").agg(F.count("*").alias("n")).orderBy("bucket", "year")


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified(_bucketed(spark, d), "bibkey", ABC, 42)


def sample_year_profile(spark: SparkSession, d: str) -> DataFrame:
    return stratified_sample(spark, d).groupBy("bucket", "year").agg(F.count("*").alias("n"))


def val_split(spark: SparkSession, d: str) -> DataFrame:
    s = stratified_sample(spark, d)
    val = sampling.fraction(s, "bibkey", 0.15, 42)
    return val.withColumn("split", F.lit("val")).unionByName(sampling.without(s, val, "bibkey").withColumn("split", F.lit("train"))).select("bibkey", "bucket", "split")


def gold_and_pool(spark: SparkSession, d: str) -> DataFrame:
    return sampling.gold_and_pool(_bucketed(spark, d), "bibkey", GOLD, POOL).select("bibkey", "bucket", "split")


def second_round_pool(spark: SparkSession, d: str) -> DataFrame:
    done = read_table(spark, d, "results_merged", "bibkey").unionByName(read_table(spark, d, "merged", "bibkey")).distinct()
    return sampling.stratified(sampling.without(_bucketed(spark, d), done, "bibkey"), "bibkey", SECOND, 42)


def _labelled_rows(spark: SparkSession, d: str) -> DataFrame:
    parts = [read_table(spark, d, t, "row_id", "label") for t in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("label is not null")


def split_70_15_15(spark: SparkSession, d: str) -> DataFrame:
    return sampling.three_way(_labelled_rows(spark, d), "row_id", "label").select("row_id", "label", "split")


def split_70_15_15_sizes(spark: SparkSession, d: str) -> DataFrame:
    return split_70_15_15(spark, d).groupBy("split", "label").agg(F.count("*").alias("n"))


def _answers(spark: SparkSession, d: str, provider: str = "mistral") -> DataFrame:
    """Landed response lines: each row's answer as the JSON a provider returns, a few of them broken as transfers break them, a few errors."""
    rows = read_table(spark, d, "paper_taxonomy")
    array = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).alias(c)
    label = F.when(F.col("rec_id") % 37 == 0, "MAYBE").otherwise(F.col("label")).alias("label")
    reasoning = F.when(F.col("rec_id") % 41 != 0, F.col("reasoning")).alias("reasoning")
    plain = ["justification", "task_type", "input_type", "label_type", "domain", "data_source", "benchmark_novelty", "is_multitask"]
    payload = F.to_json(F.struct(reasoning, label, array("benchmark_names"), array("languages"), *plain), {"ignoreNullFields": "false"})
    key, failed = F.col("rec_id").cast("string"), F.col("rec_id") % 29 == 0
    error = F.when(failed, F.struct(F.lit(429).alias("code"))).alias("error")
    cut = F.when(F.col("rec_id") % 31 == 0, F.substring(payload, 1, 20)).otherwise(payload)
    if provider == "mistral":
        message = F.struct(F.struct(cut.alias("content")).alias("message"))
        line = F.to_json(F.struct(key.alias("custom_id"), F.struct(F.struct(F.array(message).alias("choices")).alias("body")).alias("response"), error))
    elif provider == "google":
        content = F.struct(F.struct(F.array(F.struct(cut.alias("text"))).alias("parts")).alias("content"))
        line = F.to_json(F.struct(key.alias("key"), F.struct(F.array(content).alias("candidates")).alias("response"), error))
    else:
        result = F.when(failed | (F.col("rec_id") % 31 == 0), '{"type": "errored", "error": {"type": "expired"}}').otherwise(F.concat(F.lit('{"type": "succeeded", "message": {"content": [{"input": '), payload, F.lit("}]}}")))
        line = F.concat(F.lit('{"custom_id": "'), key, F.lit('", "result": '), result, F.lit("}"))
    return rows.select(line.alias("value"))


def _parsed(spark: SparkSession, d: str, provider: str) -> DataFrame:
    p = labels.parse(_answers(spark, d, provider), provider)
    return p.select("key", "valid", "label", "reasoning", "justification", "task_type", "input_type", "domain", "is_multitask", F.get("languages", F.lit(0)).alias("languages"), F.get("benchmark_names", F.lit(0)).alias("benchmark_names"))


def label_parse(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, "mistral")


def label_parse_google(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, "google")


def label_parse_claude(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, "claude")


def label_parse_errors(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for p in labels.PROVIDERS:
        one = labels.parse(_answers(spark, d, p), p).agg(F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("n_errors")).select(F.lit(p).alias("provider"), "n", "n_errors")
        out = one if out is None else out.unionByName(one)
    return out


def label_merge_left(spark: SparkSession, d: str) -> DataFrame:
    base = read_table(spark, d, "paper_taxonomy", "rec_id", "provider").select(F.col("rec_id").cast("string").alias("bibkey"), "provider")
    return labels.merge(base, labels.parse(_answers(spark, d), "mistral"), "mistral", columns=["label", "task_type", "domain"])


def request_lines(spark: SparkSession, d: str) -> DataFrame:
    """What the lines of the three providers say, from one scan."""
    at = {
        "mistral": ("$.custom_id", "$.body.messages[1].content", "$.body.messages[0].content", "$.body.model", "$.body.response_format.json_schema.schema", "$.body.temperature"),
        "google": ("$.key", "$.request.contents[0].parts[0].text", "$.request.systemInstruction.parts[0].text", None, "$.request.generationConfig.responseSchema", "$.request.generationConfig.temperature"),
        "claude": ("$.custom_id", "$.params.messages[0].content", "$.params.system[0].text", "$.params.model", "$.params.tools[0].input_schema", "$.params.max_tokens"),
    }
    rows = read_table(spark, d, "train", "row_id", "title", "abstract").filter("row_id is not null")
    lines = rows.select(F.inline(F.array(*(F.struct(F.lit(p).alias("provider"), labels.request_line(p, TASK, "model-1", "row_id").alias("line")) for p in at))))
    get = lambda i: F.coalesce(*(F.when((F.col("provider") == p), F.get_json_object("line", paths[i])) for p, paths in at.items() if paths[i]))
    return lines.select("provider", *(get(i).alias(c) for i, c in enumerate(("name", "content", "prompt", "model", "schema", "number"))))


def bounded_labels(spark: SparkSession, d: str) -> DataFrame:
    """Rows labelled one by one by an annotator that fails at times: tried thrice, then UNSURE."""
    rows = read_table(spark, d, "val", "row_id", "title", "abstract")
    return annotators.label_rows(rows, "stub", TASK, annotators.unsteady(5)).select("row_id", "stub_label", "stub_justification")


def batch_labels(spark: SparkSession, d: str) -> DataFrame:
    """A batch that is submitted, polled, and fetched; the service fails for some messages."""
    ask = annotators.keywords()

    def reply(message: str) -> dict:
        if len(message) % 7 == 0:
            raise ConnectionError("quota")
        return ask("", message, "")

    rows = read_table(spark, d, "train", "row_id", "title", "abstract").withColumn("row_id", F.col("row_id").cast("string"))
    service = annotators.FolderService(spark, annotators.answers("google", reply))
    job = annotators.submit(rows, "google", TASK, "model-1", service, "row_id")
    annotators.wait(service, job, seconds=0)
    return annotators.fetch(rows, "google", service, job, TASK, "row_id").select("row_id", "google_label", "google_justification")


def kappa_pairs(spark: SparkSession, d: str) -> DataFrame:
    names = ["google_label", "deepseek_label", "mistral_label"]
    t = materialize(_three(spark, d).groupBy(*names).agg(F.count("*").alias("w")), "votes")  # one row per combination of labels
    out = None
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            k = agreement.kappa(t, a, b, "w").select(F.lit(f"{a}/{b}").alias("pair"), "n", *(_r6(c).alias(c) for c in ("observed", "expected", "kappa")))
            out = k if out is None else out.unionByName(k)
    return out


def confusion_long(spark: SparkSession, d: str) -> DataFrame:
    return agreement.confusion(_three(spark, d).dropna(subset=["google_label", "mistral_label"]), "google_label", "mistral_label")


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return agreement.confusion_matrix(_three(spark, d), "google_label", "mistral_label", sorted(labels.LABELS))


def crosstab_margins(spark: SparkSession, d: str) -> DataFrame:
    return agreement.crosstab(_three(spark, d), "google_label", "deepseek_label")


def disagreements(spark: SparkSession, d: str) -> DataFrame:
    return agreement.disagreements(_three(spark, d), "google_label", "deepseek_label").select("bibkey", "google_label", "deepseek_label")


def disagreement_rate(spark: SparkSession, d: str) -> DataFrame:
    t = _three(spark, d).dropna(subset=["google_label", "deepseek_label"])
    return t.agg(_r6(F.avg((F.col("google_label") != F.col("deepseek_label")).cast("double"))).alias("rate"))


def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    t = _three(spark, d).dropna()
    win, other = agreement.majority({"Google": F.col("google_label"), "DeepSeek": F.col("deepseek_label"), "Mistral": F.col("mistral_label")})
    return t.select("bibkey", win.alias("majority_label"), other.alias("dissenter"))


def _provider(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = read_table(spark, d, "paper_taxonomy", "bibkey", "received_at", "provider", "label", "task_type").filter(F.col("provider") == name).drop("provider")
    return labels.prefixed(sampling.keep_latest(rows, "bibkey", "received_at").drop("received_at"), name)


def taxonomy_merge(spark: SparkSession, d: str) -> DataFrame:
    """The latest answer of each of three providers side by side, in one pass: a join on the key without a join."""
    names = ("google", "deepseek", "mistral")
    rows = read_table(spark, d, "paper_taxonomy", "bibkey", "received_at", "provider", "label", "task_type").filter(F.col("provider").isin(*names) & F.col("bibkey").isNotNull())
    last = lambda p: F.max(F.when(F.col("provider") == p, F.struct("received_at", "label", "task_type"))).alias(p)
    t = rows.groupBy("bibkey").agg(*map(last, names)).select("bibkey", *(F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in names for c in ("label", "task_type"))).dropna(subset=[f"{p}_label" for p in names])
    win, other = agreement.majority({"Google": F.col("google_label"), "DeepSeek": F.col("deepseek_label"), "Mistral": F.col("mistral_label")})
    return t.withColumn("majority_label", win).withColumn("dissenter", other)


def positives_semi(spark: SparkSession, d: str) -> DataFrame:
    positive = _provider(spark, d, "google").filter("google_label = 'POSITIVE'").select("bibkey")
    return _papers(spark, d, "id", "bibkey", "year").filter("year >= 2025").join(positive, "bibkey", "left_semi").select("id", "bibkey", "year")


def ready_split(spark: SparkSession, d: str) -> DataFrame:
    votes = sampling.keep_latest(read_table(spark, d, "merged", "bibkey", "labelled_at", "claude_label"), "bibkey", "labelled_at").select("bibkey", _clean_label("claude_label"))
    texts = sampling.keep_latest(_papers(spark, d, "bibkey", "loaded_at", "title", "abstract"), "bibkey", "loaded_at").drop("loaded_at")
    return labels.ready(votes.join(texts, "bibkey"), "claude_label")


def label_union_dedup(spark: SparkSession, d: str) -> DataFrame:
    first = read_table(spark, d, "merged", "bibkey", "claude_label").select("bibkey", labels.to_binary(_clean_label("claude_label")).alias("label"))
    out = labels.first_per_key([first, read_table(spark, d, "test", "bibkey", "label")])
    name = F.when(F.col("label") == 1, "POSITIVE").when(F.col("label") == 0, "NEGATIVE")
    return out.select("bibkey", "label", name.alias("label_name"))


def split_summary_total(spark: SparkSession, d: str) -> DataFrame:
    names = ("train", "val", "test")
    rows = None
    for n in names:
        part = read_table(spark, d, n, "bucket").withColumn("split", F.lit(n))
        rows = part if rows is None else rows.unionByName(part)
    counts = rows.filter("bucket is not null").groupBy("bucket").agg(*(F.count_if(F.col("split") == n).alias(n) for n in names))
    return agreement.with_total(counts, "bucket")


def split_key_union(spark: SparkSession, d: str) -> DataFrame:
    rows = None
    for n in ("train", "val", "test"):
        part = read_table(spark, d, n, "bibkey")
        rows = part if rows is None else rows.unionByName(part)
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct("bibkey").alias("n_keys"))


def split_overlap_check(spark: SparkSession, d: str) -> DataFrame:
    train = read_table(spark, d, "train", "bibkey").distinct()
    rows = read_table(spark, d, "val", "bibkey").withColumn("split", F.lit("val")).unionByName(read_table(spark, d, "test", "bibkey").withColumn("split", F.lit("test")))
    return rows.join(train, "bibkey", "left_semi").groupBy("split").agg(F.count("*").alias("n"))


def _logits(spark: SparkSession, d: str) -> DataFrame:
    """Labelled papers of the test split with logits that a rule gives them from their signals, so that any engine can follow."""
    rows = corpus.with_text(read_table(spark, d, "test", "row_id", "bibkey", "title", "abstract", "label", "bucket"), "title", "abstract").filter("label is not null")
    scored = corpus.score(rows.withColumn("stratum", F.upper(strip("bucket"))).drop("bucket"))
    positive = F.lit(0.8) * F.col("introduces") + F.lit(0.4) * F.col("classif_total") + F.lit(0.3) * F.col("benchmark_vocab") - F.lit(0.6) * F.col("introduces_method")
    return scored.select("row_id", "bibkey", "label", F.col("stratum").alias("bucket"), F.lit(0.75).alias("l0"), positive.alias("l1"))


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    return predictions.predict(_logits(spark, d), ["l0", "l1"], ["row_id", "bibkey", "label", "bucket"])


def predictions_softmax(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(spark, d).select("row_id", "bibkey", "label", "bucket", "predicted", _r6("confidence").alias("confidence"), _r6("prob_positive").alias("prob_positive"))


def uncertain_predictions(spark: SparkSession, d: str) -> DataFrame:
    return predictions.uncertain(_predicted(spark, d), key="row_id").select("row_id", "predicted", _r6("confidence").alias("confidence"))


def _rounded_metrics(df: DataFrame) -> DataFrame:
    return df.select(*(_r6(c).alias(c) if c in ("accuracy", "precision", "recall", "f1") else F.col(c) for c in df.columns))


def metrics_overall(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_metrics(predictions.metrics(_predicted(spark, d)))


def metrics_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_metrics(predictions.metrics(_predicted(spark, d).filter("bucket is not null"), ["bucket"]))


def confusion_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    return agreement.confusion(_predicted(spark, d), "label", "predicted", ["bucket"])


def best_bucket(spark: SparkSession, d: str) -> DataFrame:
    return predictions.best_of(metrics_by_bucket(spark, d), "bucket", "f1").select("bucket", "f1")


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    w = predictions.class_weights(read_table(spark, d, "train", "label"))
    return w.select("label", "n", _r6("weight").alias("weight"))


def weighted_loss(spark: SparkSession, d: str) -> DataFrame:
    p = _predicted(spark, d)
    return predictions.weighted_cross_entropy(p, predictions.class_weights(p)).select(F.round("loss", 4).alias("loss"))


def predictions_with_labels(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with what the catalogue says of their papers and with the labels that people and annotators gave."""
    given = label_union_dedup(spark, d).select("bibkey", F.when(F.col("label_name").isin("NEGATIVE", "POSITIVE"), F.col("label_name")).alias("llm_label"))
    rows = _predicted(spark, d).select("row_id", "bibkey", "predicted").join(_bucketed(spark, d), "bibkey")
    return rows.join(given, "bibkey").select("row_id", "bibkey", "predicted", "year", "bucket", "llm_label")


def label_domain(spark: SparkSession, d: str) -> DataFrame:
    """The distinct labels of two annotators, sorted, as a confusion matrix takes its axes from the data."""
    t = _three(spark, d)
    seen = t.select(F.explode(F.array("google_label", "mistral_label")).alias("label")).filter("label is not null")
    return seen.agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


def _classifier(spark: SparkSession, d: str) -> learning.LinearClassifier:
    columns = ("row_id", "title", "abstract", "label")
    model = learning.LinearClassifier()
    model.train(read_table(spark, d, "train", *columns), read_table(spark, d, "val", *columns))
    return model


def classifier_predictions(spark: SparkSession, d: str) -> DataFrame:
    return _classifier(spark, d).predict(read_table(spark, d, "test", "row_id", "title", "abstract", "label"), ["row_id", "label"])


def classifier_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Of the trained classifier on the test split, per bucket."""
    rows = read_table(spark, d, "test").withColumn("bucket", F.upper(strip("bucket")))
    return predictions.metrics(_classifier(spark, d).test(rows)[1].filter("bucket is not null"), ["bucket"])


def classifier_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The log of a short search: a row per run with its settings and F1 on the validation split."""
    space = {"weight_decay": {"values": [0.01, 0.03, 0.1]}, "class_weight_smoothing": {"distribution": "uniform", "min": 0.0, "max": 1.0}}
    columns = ("row_id", "title", "abstract", "label")
    _, log = learning.sweep(read_table(spark, d, "train", *columns), read_table(spark, d, "val", *columns), Sweep(3, "val_f1", True, space), Settings(num_train_epochs=4))
    return spark.createDataFrame([(i, float(v["weight_decay"]), float(v["class_weight_smoothing"]), float(f)) for i, (v, f) in enumerate(log)], "run int, weight_decay double, class_weight_smoothing double, val_f1 double")


def incremental_labels(spark: SparkSession, d: str) -> DataFrame:
    return labelling.run(spark, f"{d}/train.parquet", labelling.annotator("keywords", TASK))


NAMES = [
    p2_found, catalog_projection, catalog_authors, last_segments, run_names, random_cap, head_rows, enumerated_rows, signal_scores, bucket_counts, corpus_clean, corpus_clean_with_abstract, venue_type_counts, enrich_left_join, bucket_year_counts, stratified_sample,
    sample_year_profile, val_split, gold_and_pool, second_round_pool, split_70_15_15, split_70_15_15_sizes, label_parse, label_parse_google, label_parse_claude, label_parse_errors, label_merge_left, request_lines, kappa_pairs,
    confusion_long, confusion_matrix, crosstab_margins, disagreements, disagreement_rate, majority_vote, taxonomy_merge, positives_semi, ready_split, label_union_dedup, split_summary_total,
    split_key_union, split_overlap_check, predictions_softmax, uncertain_predictions, metrics_overall, metrics_by_bucket, confusion_by_bucket, best_bucket, class_weights, weighted_loss,
    predictions_with_labels, label_domain, bounded_labels, batch_labels, classifier_predictions, classifier_metrics, classifier_sweep, incremental_labels,
]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in NAMES}


def oracle_sql() -> dict[str, str]:
    return sql.statements()
