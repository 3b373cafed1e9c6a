import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as tx
from spindrift.functions.expressions import translate
from spindrift.operators import chaos, simulation, validation
from spindrift.plans.compiler import Project


def shares(weights, events, minimum):
    n = len(weights)
    floor = min(minimum, events // n)
    rest = events - floor * n
    x = [w * (rest / sum(weights)) for w in weights]
    count = [floor + int(v) for v in x]
    for i in sorted(range(n), key=lambda i: (-(x[i] - int(x[i])), i))[: events - sum(count)]:
        count[i] += 1
    return count


@pytest.mark.parametrize("few", [10_000, 3])
def test_allocation_of_ties_without_sorting_them(spark, monkeypatch, few):
    """All fractions are equal under uniform shares: the cut is found by histograms."""
    monkeypatch.setattr(simulation, "_FEW", few)
    for how, n, events in (("uniform", 701, 1000), ("zipf", 90, 1234), ("uniform", 5, 3), ("zipf", 40, 0)):
        got = simulation.allocate(spark.range(n).withColumnRenamed("id", "i"), "i", n, events, how, 1.5, 1).orderBy("i").collect()
        want = shares([1.0 if how == "uniform" else 1 / (i + 1) for i in range(n)], events, 1)
        assert [r["count"] for r in got] == want
        assert [r.start for r in got] == [sum(want[:i]) for i in range(n)]


def test_events_of_a_hot_subject_and_of_ranges(spark, monkeypatch):
    monkeypatch.setattr(simulation, "EVENTS_OF_ROW", 7)
    a = simulation.allocate(spark.range(6).withColumnRenamed("id", "i"), "i", 6, 500, "zipf")
    every = sorted(tuple(r) for r in simulation.events_of(a, "i").collect())
    assert [e[0] for e in every] == list(range(500))
    for lo, hi in ((0, 500), (13, 250), (499, 500), (40, 40)):
        assert sorted(tuple(r) for r in simulation.events_of(a, "i", lo, hi).collect()) == every[lo:hi]


def test_repeats_with_ties_nulls_and_a_hot_value(spark):
    rows = [(i, "hot") for i in range(50)] + [(50 + i, None) for i in range(20)] + [(70, "a"), (70, "a"), (71, "a"), (72, "b")]
    df = spark.createDataFrame(rows, "k long, v string").repartition(5)
    got = sorted((r.k, r.v or "", r.again) for r in validation.with_repeats(df, ["v"], "k", "again").collect())
    assert sum(g[2] for g in got) == 49 + 2
    assert [g for g in got if g[1] == "a"] == [(70, "a", False), (70, "a", True), (71, "a", True)]
    assert not any(g[2] for g in got if g[1] in ("", "b"))
    assert validation.with_repeats(df.limit(0), ["v"], "k", "again").collect() == []


def test_report_of_an_allocation(spark):
    a = simulation.allocate(spark.range(100).withColumnRenamed("id", "i"), "i", 100, 10_000, "zipf")
    want = sorted(shares([1 / (i + 1) for i in range(100)], 10_000, 0))
    r = simulation.allocation_report(a, 100).first()
    assert (r.mean, r.max, r.min, r.top_decile) == (100.0, want[-1], want[0], sum(want[-10:]) / 10_000)


def test_timeline_values():
    """Growth reaches its factor at the last bucket, a spike holds its last day, a holiday is silent unless weighed."""
    t = simulation.Timeline({"start": "2026-01-01", "end": "2026-01-11", "growth": 2.0})
    assert t.weights[0] == 1.0 and t.weights[-1] == 2.0
    t = simulation.Timeline({"start": "2026-01-01", "end": "2026-01-11", "spikes": [{"start": "2026-01-03", "end": "2026-01-04", "multiplier": 3}, {"start": "2026-01-08"}]})
    assert [t.weights[24 * d] for d in range(10)] == [1, 1, 3, 3, 1, 1, 1, 2, 1, 1] and t.weights[24 * 3 + 23] == 3
    t = simulation.Timeline({"start": "2026-01-01", "end": "2026-01-11", "holidays": ["2026-01-02"]})
    assert t.weights[24:48].sum() == 0 and t.seconds_at(t.cumulative[24]) <= 86400
    assert simulation.Timeline({"start": "2026-01-01", "end": "2026-01-11", "holidays": ["2026-01-02"], "holiday_weight": 0.25}).weights[30] == 0.25
    silent = simulation.Timeline({"start": "2026-01-01", "end": "2026-01-02", "holidays": ["2026-01-01"]})
    assert silent.weights.sum() == 24
    long = simulation.Timeline({"start": "2020-01-01", "end": "2026-01-01", "shape": "office"})
    assert long.bucket == 86400 and abs(long.weights[0] - 10.22 * 1.05) < 1e-9  # a Wednesday's 24 hours
    with pytest.raises(ValueError):
        simulation.Timeline({"start": "2026-01-02", "end": "2026-01-01"})


def test_temporal_damage(spark):
    df = spark.range(3000).select("id", F.lit(dt.date(2026, 3, 4)).alias("d"), F.lit(dt.datetime(2026, 3, 4, 5, 6, 7)).cast("timestamp_ntz").alias("t"), F.lit("2026-03-04").alias("s"))
    typed = chaos.damage(df, "e", "id", 1, {"temporal_anomalies": 1.0}).collect()
    share = lambda f: sum(map(f, typed)) / sum("d" in r._chaos for r in typed)
    assert 0.34 < share(lambda r: r.d is not None and r.d > dt.date(2027, 1, 1)) < 0.46
    assert 0.24 < share(lambda r: r.d is not None and r.d < dt.date(2020, 1, 1)) < 0.36
    assert 0.24 < share(lambda r: r.d is None) < 0.36
    assert {r.s for r in typed} == {"2026-03-04", "2026/03/04"}
    text = chaos.damage(df, "e", "id", 1, {"temporal_anomalies": 1.0}, as_text=True)
    assert text.columns == [*df.columns, "_chaos"]
    forms = {re.sub(r"\d", "0", r.t) for r in text.collect()}
    assert forms == {"0000-00-00T00:00:00", "00/00/0000", "00-00-0000", "00000000", "00 Mar 0000", "Wed Mar 00 00:00:00 0000"}


def test_edge_cases_by_category_and_range():
    assert chaos.cases("integer", {}, None, {"min": 18, "max": 90}) == [18, 19, 90, 89]
    assert chaos.cases("integer", {"min": 5}) == [5, 6] and chaos.cases("integer", {"max": 5}) == [5, 4, 0, -1]
    assert "" in chaos.cases("string") and "" not in chaos.cases("string", {"min_length": 2}) and "aa" in chaos.cases("string", {"min_length": 2})
    assert {len(v) for v in chaos.cases("string", {"max_length": 7}, ["boundary_length"])} == {0, 7}
    assert all(len(v) <= 7 for v in chaos.cases("string", {"max_length": 7}))
    assert chaos.cases("enum", {"enum": ["a", "b", "c"]}) == ["a", "c"]
    assert len(chaos.cases("geo_point")) == 5 and len(chaos.cases("duration")) == 2 and len(chaos.cases("time")) == 8
    assert chaos.cases("string", {}, ["emoji"]) == chaos.TEXTS["emoji"]
    with pytest.raises(ValueError):
        chaos.cases("string", {}, ["nope"])
    assert len(chaos.CATEGORIES) == 9


def test_edge_cases_of_every_type_in_a_frame(spark):
    fields = {n: {"type": n} for n in ("geo_point", "duration", "email", "phone", "date", "datetime", "time", "integer", "float", "text")}
    p = Project({"edge_cases": {"fraction": 1.0}, "entities": {"t": {"count": 300, "fields": fields}}}, spark)
    rows = p.frame("t").collect()
    assert len(rows) == 300 and any(r.duration == dt.timedelta(days=36_500) for r in rows) and any(r.geo_point and r.geo_point.lat == 90 for r in rows)
    only = Project({"edge_cases": {"fraction": 1.0, "categories": ["emoji"], "fields": ["text"]}, "entities": {"t": {"count": 20, "fields": fields}}}, spark)
    assert {r.text for r in only.frame("t").collect()} <= set(chaos.TEXTS["emoji"])


def test_whole_powers_and_titles(spark):
    df = spark.createDataFrame([(3, "élan vital o'neil"), (-2, "ab1c")], "x long, s string")
    got = df.select(translate("x ** 39", df.schema, "p").alias("p"), translate("x ** 0", df.schema, "p").alias("one"), tx.title(F.col("s")).alias("t")).collect()
    assert [(r.p, r.one, r.t) for r in got] == [(3**39, 1, "Élan Vital O'Neil"), ((-2) ** 39, 1, "Ab1C")]


def test_report_of_scenarios(spark):
    p = Project({"project": {"seed": 2}, "entities": {"u": {"count": 20}, "e": {"count": 400, "simulation": {"subject": "u"}, "fields": {"n": {"type": "integer", "generator": "sequence"}}}}, "scenarios": {"s": {"affects_fraction": 0.5, "window": [0.2, 0.8], "phases": ["a", "b"]}}}, spark)
    rows = p.scenario_report("e").collect()
    assert {(r.scenario, r.phase) for r in rows} == {("s", "a"), ("s", "b")} and all(0 < r.subjects <= 20 and r.records >= r.subjects for r in rows)
