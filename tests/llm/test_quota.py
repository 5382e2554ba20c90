import pytest

from tessera.llm import quota


def cells(n):
    return [("A", 2020, 0.5, 3), ("B", 2020, 0.3, 3), ("C", 2021, 0.2, n)]


def papers(spark, counts, extra=()):
    rows = [(f"{b}{y}-{i}", b, y, 1) for (b, y), n in counts.items() for i in range(n)]
    return spark.createDataFrame([*rows, *extra], "bibkey string, bucket string, year int, t int")


def targets(spark, rows):
    return spark.createDataFrame(rows, "bucket string, year int, target_share double, min_rows int")


@pytest.mark.parametrize("bin_rows", [20_000, 10])
def test_shares_floors_and_report(spark, monkeypatch, bin_rows):
    monkeypatch.setattr(quota, "BIN_ROWS", bin_rows)
    df = papers(spark, {("A", 2020): 900, ("B", 2020): 80, ("C", 2021): 20, ("D", 2020): 500})
    chosen, report = quota.sample(df, "bibkey", ["bucket", "year"], targets(spark, cells(30)), latest="t")
    got = {r["bucket"]: r for r in report.collect()}
    assert chosen.count() == chosen.select("bibkey").distinct().count() == sum(r["selected"] for r in got.values())
    assert got["A"]["selected"] in (100, 101) and got["B"]["selected"] in (59, 60, 61) and not got["A"]["short"] and not got["B"]["short"]
    assert got["C"]["selected"] == 20 and got["C"]["short"]


def test_floor_is_repaired(spark):
    df = papers(spark, {("A", 2020): 995, ("B", 2020): 0, ("C", 2021): 5})
    chosen, report = quota.sample(df, "bibkey", ["bucket", "year"], targets(spark, [("A", 2020, 0.999, 0), ("C", 2021, 0.001, 4)]))
    got = {r["bucket"]: (r["selected"], r["short"]) for r in report.collect()}
    assert got["C"] == (4, False) and abs(got["A"][0] - 200) <= 1
    assert chosen.filter("bucket = 'C'").count() == 4


def test_repeats_nulls_and_foreign_cells(spark):
    extra = [("x", None, 2020, 1), (None, "A", 2020, 1), ("y", "A", None, 1), ("z", "A", 1999, 1), ("A2020-0", "A", 2020, 2), ("A2020-0", "A", 2020, 2)]
    df = papers(spark, {("A", 2020): 50}, extra)
    chosen, report = quota.sample(df, "bibkey", ["bucket", "year"], targets(spark, [("A", 2020, 1.0, None), ("B", 2020, None, 1)]), latest="t")
    got = {r["bucket"]: r for r in report.collect()}
    assert got["A"]["available"] == 50 and got["A"]["selected"] == 10 and got["B"]["short"] and got["B"]["available"] == 0


def test_empty(spark):
    chosen, report = quota.sample(papers(spark, {}), "bibkey", ["bucket", "year"], targets(spark, cells(3)))
    assert chosen.count() == 0 and [r["short"] for r in report.collect()] == [True] * 3
    chosen, report = quota.sample(papers(spark, {("A", 2020): 5}), "bibkey", ["bucket", "year"], targets(spark, []))
    assert chosen.count() == 0 and report.count() == 0


def test_same_sample_for_any_partitioning(spark):
    df = papers(spark, {("A", 2020): 300, ("B", 2020): 100})
    one, two = (sorted(map(tuple, quota.sample(df.repartition(n), "bibkey", ["bucket", "year"], targets(spark, cells(0)))[0].collect())) for n in (1, 5))
    assert one == two and one


def test_crossings_equal_a_plain_reading(spark, monkeypatch):
    """One list of all papers, in order of category and hash, a running sum of inclusion probabilities, and its crossings; then the floors."""
    monkeypatch.setattr(quota, "BIN_ROWS", 25)
    wanted = [("A", 2020, 0.45, 3), ("A", 2021, 0.3, 0), ("B", 2020, 0.2, 0), ("B", 2021, 0.01, 4), ("C", 2020, 0.04, 9)]
    df = papers(spark, {("A", 2020): 311, ("A", 2021): 157, ("B", 2020): 60, ("B", 2021): 20, ("C", 2020): 7, ("D", 2020): 50})
    chosen, report = quota.sample(df, "bibkey", ["bucket", "year"], targets(spark, wanted))
    order = {(r["bucket"], r["year"], r["bibkey"]): r["u"] for r in df.select("bibkey", "bucket", "year", quota._uniform(42, "bibkey").alias("u")).collect()}
    pool = {c: sorted((u, k) for (*x, k), u in order.items() if tuple(x) == c) for c in [(b, y) for b, y, _, _ in wanted]}
    size, total, want, rows = 0.2 * sum(map(len, pool.values())), 0.0, set(), {}
    for b, y, share, floor in sorted(wanted):
        own, quotum = pool[b, y], min(share * size, len(pool[b, y]))
        hit = [i for i in range(len(own)) if (lambda x: int((x(i + 1) - quota._start(42)) // 1) > int((x(i) - quota._start(42)) // 1))(lambda r: total + quotum * (r / len(own)))]  # noqa: B023
        rest = [i for i in range(len(own)) if i not in set(hit)]
        hit += rest[: max(0, min(floor, len(own)) - len(hit))]
        total += quotum
        want |= {own[i][1] for i in hit}
        rows[b, y] = (len(own), len(hit), len(own) < share * size or len(own) < floor)
    assert {r["bibkey"] for r in chosen.collect()} == want
    assert {(r["bucket"], r["year"]): (r["available"], r["selected"], r["short"]) for r in report.collect()} == rows
