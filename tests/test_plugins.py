import pytest
from pyspark.sql import functions as F

from spindrift import plugins
from spindrift.operators.validation import Check
from spindrift.plans.compiler import Project
from spindrift.plans.spec import SpecError
from spindrift.sources import files


class Whole:
    manifest = {"name": "whole", "version": "1.2", "provides": {"generators": ["packet"], "validators": ["even"], "transforms": ["twice"], "outputs": ["lines"], "language_models": ["echo"], "images": "plain", "speech": ["still"], "scenarios": ["rush"]}}

    def register(self, host):
        host.generator("packet", lambda o, c: F.concat(F.lit(o.get("prefix", "p")), c.draws.below(10).cast("string")))
        host.validator("even", lambda df, o: [Check("n", "constraint", "odd", F.col("n") % 2 != 0)])
        host.transform("twice", lambda x, t, arg: F.concat(x.cast("string"), x.cast("string")))
        host.output("lines", lambda df, path, mode, options: df.selectExpr("to_json(struct(*)) AS value").write.mode(mode).text(path))
        host.language_model("echo", lambda prompt, context, seed, most: F.concat(F.lit("echo "), prompt))
        host.image("plain", lambda seed, w, h: F.encode(F.lit("x"), "UTF-8"))
        host.speech("still", lambda text, rate: F.encode(F.lit("y"), "UTF-8"))
        host.scenario("rush", {"window": [0.0, 1.0], "effects": {"n": 4}})


class Drifted:
    manifest = {"name": "drifted", "provides": {"generators": ["promised"], "transforms": ["hash"]}}

    def register(self, host):
        assert not host.generator("secret", lambda o, c: F.lit(1))
        assert not host.transform("hash", lambda x, t, a: x)


class Broken:
    manifest = {"name": "broken"}

    def register(self, host):
        raise OSError("down")


def test_every_category(spark, tmp_path):
    (m,) = plugins.load([Whole])
    try:
        assert m.ok and len(m.registered) == 8 and m.version == "1.2"
        p = Project({"entities": {"u": {"count": 3}, "e": {"count": 12, "simulation": {"subject": "u"}, "fields": {
            "n": {"type": "integer", "generator": "sequence"}, "p": {"type": "string", "generator": {"type": "packet", "prefix": "q"}, "transform": "twice"},
            "t": {"type": "text", "generator": {"type": "llm", "provider": "echo", "prompt": "hi"}}, "i": {"generator": {"type": "image", "provider": "plain"}}, "s": {"generator": {"type": "tts", "provider": "still"}}}}},
            "scenarios": {"hour": {"use": "rush", "applies_to": "e"}}, "quality": {"validators": ["even"]}}, spark)
        rows = p.validated("e").collect()
        assert {r.n for r in rows} == {4} and {r.t for r in rows} == {"echo hi"} and all(r.p[0] == "q" and r.p[:2] == r.p[2:] for r in rows)
        assert not any(i.message == "odd" for r in rows for i in r._issues)
        files.write(p.frame("e").select("n"), str(tmp_path / "out"), "lines")
        assert spark.read.text(str(tmp_path / "out")).count() == 12
    finally:
        plugins.unload(m)
    with pytest.raises(SpecError, match="even"):
        Project({"entities": {"e": {"count": 1, "fields": {"n": {"type": "integer"}}}}, "quality": {"validators": ["even"]}}, spark).validated("e")


def test_manifests_are_contracts():
    drifted, broken, nameless = plugins.load([Drifted, Broken, type("N", (), {"manifest": {}})])
    assert len(drifted.refused) == 2 and drifted.missing == ["generators: promised"] and not drifted.registered
    assert broken.error == "OSError: down" and "name" in nameless.error
    with pytest.raises(plugins.PluginError):
        plugins.Manifest.of({"name": "x", "provides": {"toys": ["a"]}})
    assert len(plugins.CATEGORIES) == 8 and plugins.load() == []


def test_quality_report(spark):
    p = Project({"project": {"seed": 3}, "entities": {
        "a": {"count": 40, "fields": {"id": {"type": "integer", "generator": "sequence", "primary_key": True}}},
        "b": {"count": 2000, "fields": {"id": {"type": "integer", "generator": "sequence", "primary_key": True}, "a": {"generator": {"type": "reference", "entity": "a"}}, "k": {"type": "enum", "generator": {"type": "weighted", "choices": {"x": 3, "y": 1}}},
              "n": {"type": "integer", "generator": {"type": "expression", "expression": "id % 100"}, "unique": True, "constraints": {"max": 49}}, "t": {"type": "text", "generator": "llm"}}}}}, spark)
    r = p.quality_report("b").first()
    assert (r.records, r.schema_validity, r.referential_integrity, r.llm_parse_success) == (2000, 1.0, 1.0, 1.0)
    assert r.constraint_validity == 0.5 and r.uniqueness == pytest.approx(0.05) and 0.95 < r.distribution_match <= 1
