import pytest

from spindrift.plans.compiler import Project
from spindrift.plans.recipes import CATALOGUE, Library, RecipeError, expand
from spindrift.plans.spec import ProjectSpec, load

NAMES = sorted("name person username email address employee customer hostname ip mac os browser device software_version sku currency price product transaction invoice status priority timestamp comment ticket cvss_score cve_identifier alert_severity hash_value logon_event network_event".split())


def own(**recipes):
    return Library.of(recipes)


def expanded(entity, **recipes):
    return expand({"recipes": recipes, "entities": {"thing": entity}})["entities"]["thing"]


def test_catalogue():
    assert sorted(CATALOGUE) == NAMES
    assert set(Library.of().groups()) == {"identity", "computing", "security", "commerce", "operational"}
    assert all(r.description and r.group != "custom" for r in CATALOGUE.values())


@pytest.mark.parametrize("name", NAMES)
def test_every_recipe_compiles_generates_and_is_valid(spark, name):
    p = Project({"project": {"name": name, "seed": 4242}, "timeline": {"start": "2026-01-01", "end": "2026-06-30"}, "entities": {"thing": {"count": 30, "recipes": [name]}}}, spark)
    rows = p.validated("thing").drop("_index").collect()
    assert len(rows) == 30
    assert set(rows[0].asDict()) - {"_issues"} == set(Library.of().resolve(name))
    assert not [i for r in rows for i in r._issues if i.severity == "error"]


def test_fields_keep_their_place_and_layers_merge():
    u = {"generator": "uuid"}
    assert list(expanded({"recipes": ["two"]}, two={"fields": {"a": u, "b": u}})["fields"]) == ["a", "b"]
    e = expanded({"recipes": "three", "fields": {"b": {"template": "y"}, "z": u}}, three={"fields": {"a": u, "b": {"generator": "template", "template": "x"}, "c": u}})
    assert list(e["fields"]) == ["a", "b", "c", "z"] and "recipes" not in e
    assert e["fields"]["b"] == {"generator": "template", "template": "y", "recipe": "three"} and "recipe" not in e["fields"]["z"]
    e = expanded({"recipes": ["t"], "fields": {"b": {"generator": "llm"}}}, t={"fields": {"b": {"type": "text", "generator": "template", "template": "x"}}})
    assert e["fields"]["b"] == {"type": "text", "generator": "llm", "recipe": "t"}
    e = expanded({"recipes": ["first", "second"]}, first={"fields": {"a": u}}, second={"fields": {"a": {"generator": "sequence"}, "b": u}})
    assert e["fields"]["a"]["generator"] == "sequence" and list(e["fields"]) == ["a", "b"]
    assert expanded({"recipes": ["h"]}, h={"fields": {"parent": {"generator": "reference", "entity": "$self"}}})["fields"]["parent"]["entity"] == "thing"
    nested = own(inner={"fields": {"a": u}}, outer={"includes": ["inner"], "fields": {"a": {"unique": True}}}).resolve("outer")
    assert nested == {"a": {"generator": "uuid", "unique": True, "recipe": "outer"}}
    untouched = {"entities": {"thing": {"count": 1, "fields": {}}}}
    assert expand(untouched) is untouched


def test_faults_and_folders(tmp_path):
    with pytest.raises(RecipeError, match="one -> two -> one"):
        own(one={"includes": ["two"]}, two={"includes": ["one"]}).resolve("one")
    for bad in ({"recipes": ["nope"]}, {"recipes": {"a": 1}}):
        with pytest.raises(RecipeError):
            expanded(bad)
    with pytest.raises(RecipeError):
        own(empty={})
    (tmp_path / "recipes").mkdir()
    (tmp_path / "recipes" / "local.yaml").write_text("badge:\n  fields:\n    badge: {type: string, generator: uuid}\nname:\n  fields:\n    nick: {type: string, generator: uuid}\n")
    (tmp_path / "recipes" / "single.yaml").write_text("fields:\n  lone: {type: integer, generator: sequence}\n")
    (tmp_path / "p.yaml").write_text("entities:\n  a: {count: 2, recipes: [badge, name, single]}\n")
    assert list(load(str(tmp_path / "p.yaml")).entities["a"].fields) == ["badge", "nick", "lone"]
    assert ProjectSpec.of({"entities": {"a": {"recipes": ["sku"]}}}).entities["a"].primary_key == "sku"
