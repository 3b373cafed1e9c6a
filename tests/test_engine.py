import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from spindrift.functions import expressions as ex
from spindrift.functions import text as tx
from spindrift.functions import transforms as tf
from spindrift.functions import types as ty
from spindrift.operators import chaos, patches, simulation, validation
from spindrift.plans.compiler import Project
from spindrift.plans.graph import CycleError, layers
from spindrift.plans.lint import lint
from spindrift.plans.spec import ProjectSpec, SpecError
from spindrift.plans.worlds import World, WorldConflict
from spindrift.queries import PROJECT
from spindrift.sources import files


@pytest.fixture(scope="module")
def project(spark):
    return Project(PROJECT, spark)


# ---------------------------------------------------------------- expressions
@pytest.mark.parametrize("source,want", [
    ("7 // -2", -4), ("-7 % 3", 2), ("7 / 2", 3.5), ("2 ** 10", 1024), ("round(2.5)", 2), ("'a' + 'b'", "ab"), ("'ab' * 2", "abab"), ("null == null", True), ("'a' == 1", False), ("1 if '' else 2", 2),
    ("0 or 5", 5), ("3 and 4", 4), ("not ''", True), ("'b' in 'abc'", True), ("3 in [1, 2]", False), ("1 < 2 < 3", True), ("substr('hello', 1, 3)", "el"), ("substr('hello', -2)", "lo"), ("substr('hello', 1, 0)", "ello"),
    ("title(\"o'brien-smith\")", "O'Brien-Smith"), ("concat('a', null, true)", "aNoneTrue"), ("max(1, 5, 3)", 5), ("min([4, 2])", 2), ("sum([1, 2, 3])", 6), ("len([1, 2])", 2), ("iif(1 > 2, 'a', 'b')", "b"), ("slug('A b--C!')", "a-b-c"), ("int('7')", 7), ("bool(0)", False),
])
def test_expressions_mean_what_python_means(spark, source, want):
    df = spark.range(1)
    assert df.select(ex.translate(source, df.schema).alias("x")).first().x == want


@pytest.mark.parametrize("source", ["__import__('os')", "id.__class__", "open('x')", "lambda: 1", "[x for x in [1]]", "lower(x='a')", "nothing + 1", "'a' + 1", "id._x", "a.b.c", "1; 2"])
def test_what_is_not_allowed(spark, source):
    with pytest.raises(ex.ExpressionError):
        ex.translate(source, spark.range(1).schema)


# ---------------------------------------------------------------- transforms and patches
def test_transforms(spark):
    df = spark.createDataFrame([("  Héllo Wörld ",), (None,)], "s string")
    run = lambda p: [r[0] for r in df.select(tf.apply(F.col("s"), df.schema["s"].dataType, p.split("|"))[0]).collect()]
    assert run("strip|upper|truncate:5") == ["HÉLLO", None]
    assert run("trim|mask:3") == ["********rld", None]
    assert run("compress|decompress") == ["  Héllo Wörld ", None]
    assert run("encode:url")[0] == "%20%20H%C3%A9llo%20W%C3%B6rld%20"
    assert run("encode:json")[0] == '"  Héllo Wörld "'
    assert run("normalize") == ["Héllo Wörld", None]
    for bad in ("nope", "hash:3", "truncate:-1", "encode:rot13"):
        with pytest.raises(tf.TransformError):
            run(bad)


def test_patch_rules(spark):
    with pytest.raises(patches.PatchError):
        patches.Rule.of({"drop": True, "keep": True, "where": "a"})
    with pytest.raises(patches.PatchError):
        patches.Rule.of({"where": "a"})
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "n long, s string")
    out = patches.apply(df, [{"where": "n > 1", "set": {"n": "n * 10", "s": "str(n)"}}, {"where": "s == 'c'", "drop": True}])
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (20, "20")]


def test_types(spark):
    cases = {"boolean": [("yes", True), ("maybe", None)], "integer": [("7.0", 7), ("7.5", None)], "uuid": [("{12345678123456781234567812345678}", "12345678-1234-5678-1234-567812345678"), ("x", None)], "cidr": [("10.0.0.77/24", "10.0.0.0/24")], "time": [("08:30", "08:30:00"), ("25:00", None)]}
    for name, pairs in cases.items():
        for raw, want in pairs:
            got = spark.createDataFrame([(raw,)], "v string").select(ty.coerce(F.col("v"), name).alias("x")).first().x
            assert got == want, (name, raw)
    good = {"email": "a@b.co", "hostname": "a-b.example", "mac_address": "00:11:22:33:44:55", "uri": "https://x", "ip_address": "::1", "duration": "P1DT2H", "json": '{"a":1}'}
    for name, v in good.items():
        row = spark.createDataFrame([(v, "\0 bad")], "a string, b string").select(ty.check(F.col("a"), name).alias("a"), ty.check(F.col("b"), name).alias("b")).first()
        assert row.a and not row.b, name
    assert len(ty.TYPES) == 28


# ---------------------------------------------------------------- projects
def test_records_do_not_depend_on_partitions_or_ranges(project):
    whole = {r._index: r for r in project.frame("employee", partitions=7).collect()}
    again = {r._index: r for r in project.frame("employee", partitions=1).collect()}
    part = {r._index: r for r in project.frame("employee", 40, 11).collect()}
    assert whole == again and part == {i: whole[i] for i in range(40, 51)}


def test_references_need_no_join(project):
    plan = project.frame("employee")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert project.integrity("employee").first().broken == 0


def test_histories(project):
    rows = project.frame("login", hidden=True).toPandas().sort_values(["_subject", "_ordinal"])
    assert len(rows) == 5000 and set(rows._index) == set(range(5000))
    assert rows.groupby("_subject")["at"].apply(lambda x: x.is_monotonic_increasing).all()
    assert rows.groupby("_subject").size().min() >= 1
    shares = rows.groupby("_subject").size().sort_values(ascending=False)
    assert abs(shares.head(50).sum() / 5000 - 0.1 ** (1 / 1.8)) < 0.06
    hit = rows[rows.incident == "attack"]
    assert 0 < len(hit) < 1000 and (hit.result == "failure").mean() > 0.75


def test_clamped_state_and_long_fold_agree(spark):
    df = spark.createDataFrame([(s, k, float((k * 37 + s) % 300 - 140)) for s in range(5) for k in range(60)], "s long, k long, x double")
    short = {(r.s, r.k): r["state.b"] for r in simulation.fold(df, "s", "k", {"b": {"initial": 100, "update": "b + x", "min": 0, "precision": 2}}).collect()}
    long = {(r.s, r.k): r.b for r in simulation.fold_long(df, "s", "k", "b", 100.0, "x", 0, None, 2).collect()}
    assert short == long and min(short.values()) == 0


def test_allocation_is_exact(spark):
    for how in ("uniform", "zipf", "skewed"):
        a = simulation.allocate(spark.range(97).withColumnRenamed("id", "i"), "i", 97, 1003, how, 1.7, 3).orderBy("i").collect()
        assert sum(r["count"] for r in a) == 1003 and min(r["count"] for r in a) >= 3
        assert [r.start for r in a] == [sum(x["count"] for x in a[:i]) for i in range(97)]


def test_damage_is_logged_and_excused(spark):
    p = Project({**PROJECT, "chaos": {"preset": "hostile_qa"}}, spark)
    df = p.records("employee")
    clean = {r._index: r for r in p.frame("employee").collect()}
    n_damaged = 0
    for r in df.collect():
        for c in ("first_name", "email", "age", "company"):
            if r[c] != clean[r._index][c]:
                n_damaged += 1
                assert c in r._chaos
        assert r.employee_id == clean[r._index].employee_id
    assert n_damaged > 50 and df.count() > 500
    stats = p.quality("employee").first()
    assert stats.n_structural == 0 and stats.n_uniqueness == 0
    assert set(chaos.PRESETS["messy"]) == set(chaos.KINDS)


def test_edge_cases_are_legal(spark):
    p = Project({"project": {"seed": 1}, "edge_cases": 0.5, "entities": {"t": {"count": 400, "fields": {"id": {"type": "integer", "generator": "sequence", "primary_key": True}, "n": {"type": "integer", "generator": "random", "min": 5, "max": 9}, "s": {"type": "string", "generator": "random", "max_length": 20}}}}}, spark)
    assert p.quality("t").first().validity == 1.0
    assert p.frame("t").where("s = ''").count() > 0


def test_specification_errors(spark):
    base = {"entities": {"a": {"fields": {"x": {"generator": "expression", "expression": "y + 1"}, "y": {"generator": "expression", "expression": "x + 1"}}}}}
    with pytest.raises(CycleError, match="x -> y|y -> x"):
        Project(base, spark)
    for bad in ({"nope": 1}, {"entities": {"a": {"fields": {"x": {"type": "nope"}}}}}, {"entities": {"a": {"simulation": {"subject": "b"}}}}):
        with pytest.raises(SpecError):
            Project(ProjectSpec.of(bad), spark)
    assert layers(["c", "a", "b"], {"c": {"a", "b"}, "b": {"a"}}) == [["a"], ["b"], ["c"]]


def test_lint_recipes_worlds(spark, tmp_path):
    p = Project({"entities": {"user": {"count": 10, "recipes": ["name", "email"], "fields": {"code": {"type": "string", "unique": True, "generator": {"type": "pattern", "pattern": "{0}"}, "null_probability": 0.7}}}, "empty": {"count": 0}}}, spark)
    rules = {f.rule for f in lint(p)}
    assert {"empty-entity", "mostly-null"} <= rules
    assert list(p.entities["user"].fields) == ["first_name", "last_name", "email", "code"]
    w = World.of(p, "w")
    w.save(str(tmp_path / "w.json"))
    World.load(str(tmp_path / "w.json")).check(p)
    with pytest.raises(WorldConflict):
        World("w", 99).check(p)


# ---------------------------------------------------------------- sinks
def test_every_format_round_trips(spark, tmp_path, project):
    df = project.frame("employee", 0, 30).drop("_index")
    for fmt in ("parquet", "jsonl", "json", "csv"):
        to = str(tmp_path / f"x.{fmt}")
        files.write(df, to, fmt)
        back = files.read(spark, to, fmt)
        assert sorted(str(r.email) for r in back.collect()) == sorted(r.email for r in df.collect()), fmt
    files.write(df, str(tmp_path / "x.db"), "sqlite", table="employee", primary_key="employee_id")
    db = sqlite3.connect(str(tmp_path / "x.db"))
    assert db.execute("select count(*), min(employee_id) from employee").fetchall() == [(30, 1000)]
    files.write(df, str(tmp_path / "x.sql"), "sql", table="employee")
    script = [line for f in os.listdir(tmp_path / "x.sql") if f.startswith("part") for line in open(tmp_path / "x.sql" / f)]
    other = sqlite3.connect(":memory:")
    for line in sorted(script, key=lambda s: not s.startswith("CREATE")):
        other.execute(line)
    assert other.execute("select count(*) from employee").fetchall() == [(30,)]


def test_partitions_and_ranges(spark, tmp_path):
    df = spark.createDataFrame([(1, "a/b"), (2, None)], "n long, p string")
    files.write(df, str(tmp_path / "p"), "jsonl", ["p"])
    assert sorted(x for x in os.listdir(tmp_path / "p") if "=" in x) == ["__p_p=__null__", "__p_p=a_b"]
    assert files.write_range(df, str(tmp_path / "r"), 0, 10) and not files.write_range(df, str(tmp_path / "r"), 0, 10)


def test_file_transform(spark, tmp_path):
    source = tmp_path / "in.jsonl"
    source.write_text("\n".join(json.dumps({"name": f"n{i}", "x": i}) for i in range(10)))
    stats = files.transform_file(spark, str(source), str(tmp_path / "out.jsonl"), [{"where": "x > 5", "set": {"name": "upper"}}, {"where": "x == 0", "drop": True}])
    assert [(r["seen"], r["hit"]) for r in stats["rules"]] == [(10, 4), (10, 1)]
    got = {r.x: r.name for r in spark.read.json(str(tmp_path / "out.jsonl")).collect()}
    assert got == {i: f"N{i}" if i > 5 else f"n{i}" for i in range(1, 10)}
    with pytest.raises(FileExistsError):
        files.transform_file(spark, str(source), str(tmp_path / "out.jsonl"), [{"where": "x > 5", "drop": True}])


def test_privacy(spark):
    texts = ["card 4111 1111 1111 1111", "ssn 123-45-6789", "ssn 900-45-6789", "mail a@real.com", "mail a@example.com", "8.8.8.8", "192.0.2.7", "call 212-555-2368", "call 212-555-0123"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(n for n, f in validation.PRIVACY.items() if r[n]) for r in df.select(*[f(F.col("t")).alias(n) for n, f in validation.PRIVACY.items()]).collect()]
    assert got == [("card",), ("ssn",), (), ("domain",), (), ("ip",), (), ("phone",), ()]


def test_zero_pad_keeps_long_and_negative_numbers(spark):
    df = spark.createDataFrame([(5,), (12345,), (-5,)], "n long")
    assert [r.x for r in df.select(tx.zero_pad(F.col("n"), 4).alias("x")).collect()] == ["0005", "12345", "-005"]
