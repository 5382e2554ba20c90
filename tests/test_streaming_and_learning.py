import pytest

from tessera.operators import annotators, labels, learning
from tessera.sources import settings, tables
from tessera.streaming import labelling

TASK = labels.Task("p")


def rows(spark, a, b):
    return spark.createDataFrame([(i, f"t{i}", None if i % 5 == 0 else ("a new dataset" if i % 2 else "a method")) for i in range(a, b)], "row_id long, title string, abstract string")


def test_labelling_resumes_without_repeats(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows(spark, 0, 10).write.parquet(source)
    assert labelling.run(spark, source, labelling.annotator('keywords', TASK), target).count() == 10
    rows(spark, 10, 14).write.mode("append").parquet(source)
    got = labelling.run(spark, source, labelling.annotator('keywords', TASK), target)
    assert sorted(r["row_id"] for r in got.collect()) == list(range(14))
    assert {r["label"] for r in got.collect()} == {"POSITIVE", "NEGATIVE", "UNSURE"}
    assert labelling.run(spark, source, labelling.annotator('keywords', TASK), target).count() == 14


def test_classifier_learns(spark):
    df = spark.createDataFrame([(i, "good data" if i % 2 else "bad method", None, i % 2 if i < 90 else None) for i in range(100)], "row_id long, title string, abstract string, label int")
    model = learning.LinearClassifier()
    model.train(df)
    got = model.predict(df, ["row_id"]).collect()
    assert all(r["predicted"] == r["row_id"] % 2 and r["confidence"] >= 0.5 for r in got)


def test_sinks(spark, tmp_path):
    df, path = rows(spark, 0, 3), str(tmp_path / "t")
    assert tables.write_table(df, path) and not tables.write_table(df, path, force=False)
    assert tables.predictions_path("/a/b/papers.parquet") == "/a/b/papers_predictions.parquet"
    tables.write_json_lines(df.selectExpr("to_json(struct(*)) AS j"), "j", str(tmp_path / "j"))
    assert tables.read_json_lines(spark, str(tmp_path / "j")).count() == 3


def test_jobs_from_tables_to_tables(spark, tmp_path):
    from tessera.plans import jobs
    from tessera.sources.settings import Settings, Sweep

    config = tmp_path / "c.yaml"
    config.write_text('project: x\nmodel:\n  # comment\n  num_train_epochs: 5\n  unknown: 1\n  output_dir: "m"  # quoted\nother:\n  seed: 7\n')
    settings = Settings.read(str(config)).override(output_dir=str(tmp_path / "model"), num_train_epochs=None, nothing=3, features=256)
    assert (settings.num_train_epochs, settings.seed, settings.features) == (5, 42, 256)
    for name in ("train", "val", "test"):
        labelled = spark.createDataFrame([(f"k{i}", "good data" if i % 2 else "bad method", f"a{i % 3}", i % 2, "AB"[i % 3 > 1]) for i in range(60)], "bibkey string, title string, abstract string, label int, bucket string")
        labelled.write.parquet(str(tmp_path / f"{name}.parquet"))
    jobs.train(spark, str(tmp_path), settings, full=True)
    jobs.test(spark, str(tmp_path), settings, str(tmp_path / "out"))
    read = lambda n: spark.read.parquet(str(tmp_path / "out" / f"{n}.parquet"))
    assert read("metrics").first()["accuracy"] == 1.0 and read("metrics_by_bucket").count() == 2 and read("confusion").count() == 2
    out = jobs.infer(spark, str(tmp_path / "test.parquet"), settings)
    assert out.endswith("test_predictions.parquet") and spark.read.parquet(out).count() == 60
    what = tmp_path / "s.yaml"
    what.write_text("method: bayes\nrun_cap: 2\nmetric:\n  name: best_val_f1\n  goal: maximize\nparameters:\n  weight_decay:\n    values: [0.01, 0.1]\n  learning_rate:\n    distribution: log_uniform_values\n    min: 1.0e-5\n    max: 5.0e-5\ncommand:\n  - ${env}\n  - python\n")
    assert jobs.sweep(spark, str(tmp_path), settings, Sweep.read(str(what))).best_metric == 1.0
    log = spark.read.parquet(f"{settings.output_dir}-log")
    assert {"val_f1", "test_f1", "best_val_f1"} - {r["metric"] for r in log.collect()} == {"val_f1"} and log.filter("metric = 'best_val_f1'").count() == 2
    jobs.train(spark, str(tmp_path), settings)
    assert spark.read.parquet(f"{settings.output_dir}-log").filter("metric = 'val_f1'").count() == 3  # the first epoch is the best, two more are tried
    assert jobs.land(spark, str(tmp_path / "test.parquet"), str(tmp_path / "landed.parquet")) and not jobs.land(spark, str(tmp_path / "test.parquet"), str(tmp_path / "landed.parquet"))


def test_penalty_and_patience_count(spark):
    from tessera.sources.settings import Settings

    df = spark.createDataFrame([(i, f"good data {i % 7}" if i % 3 else f"bad method {i % 5}", "x", i % 2) for i in range(80)], "row_id long, title string, abstract string, label int")
    of = lambda **s: learning.LinearClassifier(Settings(features=256, **s))
    weak, strong = of(weight_decay=0.0), of(weight_decay=10.0)
    weak.train(df)
    strong.train(df)
    size = lambda m: float(sum(abs(m.model.stages[-1].coefficients.toArray())))
    assert size(strong) < 0.2 * size(weak)
    stopped = of(early_stopping_patience=1, num_train_epochs=9)
    stopped.train(df, df)
    assert len(stopped.log) < 9 and stopped.best_metric == max(f for _, f in stopped.log)
    with pytest.raises(RuntimeError):
        of().predict(df, ["row_id"])
    assert learning.renamed(["a.gamma", "b.beta", "c"]) == {"a.gamma": "a.weight", "b.beta": "b.bias", "c": "c"}


def test_searches_and_names():
    from datetime import datetime

    text = "a: 1\nb:\n  c: [1, 2.5, x]\n  d:\n    e: true\n  f: 'q'  # r\ng:\n- x\n- 2\n"
    assert settings.parse_yaml(text) == {"a": 1, "b": {"c": [1, 2.5, "x"], "d": {"e": True}, "f": "q"}, "g": ["x", 2]}
    assert settings.parse_yaml("") == {}
    space = settings.Sweep(20, "f1", True, {"x": {"min": 1, "max": 2}, "y": {"values": [1, 2]}, "z": {"distribution": "log_uniform_values", "min": 1e-5, "max": 1e-3}})
    draws = space.draws(1)
    assert len(draws) == 20 and draws == space.draws(1) and all(1 <= d["x"] <= 2 and d["y"] in (1, 2) and 1e-5 <= d["z"] <= 1e-3 for d in draws)
    assert settings.run_name("org/model", "test", datetime(2024, 1, 2, 3, 4)) == "model_test_20240102_0304" and settings.run_name("m", "", datetime(2024, 1, 2)) == "m_20240102_0000"


def test_labelling_bounded_with_retries(spark):
    df = spark.createDataFrame([(i, "x" * i, "a new dataset" if i % 2 else None) for i in range(10)], "row_id long, title string, abstract string")
    got = {r["row_id"]: (r["stub_label"], r["stub_justification"]) for r in annotators.labelled_in_order(df, "stub", TASK, "row_id", make=annotators.unsteady(5)).collect()}
    assert list(got) == list(range(10))
    for i, (label, why) in got.items():
        assert (label, why) == (("UNSURE", "API Error") if i % 5 >= 3 else ("POSITIVE" if i % 2 else "UNSURE", "keywords"))
    assert annotators.label_rows(df.limit(0), "keywords", TASK).count() == 0


def test_batches_must_be_done(spark, monkeypatch):
    def ask(message):
        if "bad" in message:
            raise ValueError("refused")
        return {"reasoning": "r", "label": "POSITIVE", "justification": "j"}

    df = spark.createDataFrame([("a", "t", "x"), ("b", "bad", None), (None, "t", "x")], "bibkey string, title string, abstract string")
    for provider in ("mistral", "google", "claude"):
        service = annotators.FolderService(spark, annotators.answers(provider, ask), polls=2)
        job = annotators.submit(df, provider, TASK, "m", service)
        with pytest.raises(RuntimeError):
            annotators.fetch(df, provider, service, job, TASK)
        annotators.wait(service, job, seconds=0)
        got = {r["bibkey"]: r[f"{provider}_label"] for r in annotators.fetch(df, provider, service, job, TASK).collect()}
        assert got == {"a": "POSITIVE", "b": None, None: None}
    with pytest.raises(RuntimeError):
        annotators.wait(service, "no such job", seconds=0)
    with pytest.raises(TimeoutError):
        annotators.wait(service, annotators.submit(df, "claude", TASK, "m", service), seconds=0, polls=1)


def test_providers_and_secrets(monkeypatch):
    with pytest.raises(ValueError):
        annotators.client("nobody")
    annotators.register(annotators.Provider("closed", "m", "TESSERA_TEST_SECRET", lambda key: lambda *_: {"label": key}))
    with pytest.raises(RuntimeError):
        annotators.client("closed")
    monkeypatch.setenv("TESSERA_TEST_SECRET", "s")
    assert annotators.client("closed")("", "", "") == {"label": "s"} and annotators.client("keywords")("", "a novel corpus", "")["label"] == "POSITIVE"
