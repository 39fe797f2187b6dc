import pytest
from helpers import graph, rows

from braidgraph.functions.predicates import Where, is_
from braidgraph.operators import conformance, entities, hierarchy, overlay, relations, reports
from braidgraph.operators.entities import EntityFilter, HasAttribute, HasRelation, Hop, OrderBy
from braidgraph.operators.overlay import Field
from braidgraph.operators.relations import RelationFilter

PEOPLE = [(p, "name", "root", p.title()) for p in ("alice", "bob", "charlie")]
KNOWS = [
    ("abc", "alice", "bob", "knows", "0", "root"),
    ("dev", "alice", "charlie", "knows", "1", "root"),
]


@pytest.fixture(scope="module")
def people(spark):
    types = [(f"t-{p}", p, "person", "types", "0", "root") for p, *_ in PEOPLE]
    return graph(spark, PEOPLE, KNOWS + types)


def test_filter_by_name(people):
    where = EntityFilter(attributes=[HasAttribute("name", is_("Alice"))])
    assert rows(entities.find(people, where, limit=1).select("id")) == [("alice",)]


def test_id_filter_applies_to_entities(people):
    assert rows(entities.find(people, EntityFilter(id=is_("bob"))).select("id")) == [("bob",)]


def test_not_types_keeps_entities_without_relations(people):
    found = entities.find(people, EntityFilter(not_types=["person"]), limit=None)
    assert rows(found.select("id")) == [("person",)]


def test_relations_in_index_order_with_targets(people):
    where = RelationFilter(relation_type=is_("knows"), from_=EntityFilter(id=is_("alice")))
    found = relations.find(people, where)
    assert [r["id"] for r in found.collect()] == ["abc", "dev"]
    assert rows(relations.targets(people, found).select("id")) == [("bob",), ("charlie",)]
    nodes = relations.with_nodes(people, found).select("id", "to_created_at_block")
    assert rows(nodes) == [("abc", "0"), ("dev", "0")]


def test_relations_without_attributes_are_kept(spark):
    tables = graph(spark, [*PEOPLE, ("abc", "bar", "root", "42")], KNOWS)
    found = relations.with_attribute_lists(tables, relations.find(tables))
    listed = {r["id"]: [tuple(a) for a in r["attributes"]] for r in found.collect()}
    assert listed == {"abc": [("bar", "42", "TEXT")], "dev": []}


def test_hops_in_both_directions(people):
    alice = EntityFilter(id=is_("alice"), hops=[Hop(is_("knows"))])
    assert rows(entities.matching(people, alice)) == [("bob",), ("charlie",)]
    back = EntityFilter(
        attributes=[HasAttribute("name", is_("Bob"))], hops=[Hop(is_("knows"), inbound=True)]
    )
    assert rows(entities.matching(people, back)) == [("alice",)]


def test_order_and_page(people):
    found = entities.find(people, order_by=OrderBy("name", descending=True), limit=1, skip=1)
    assert [r["id"] for r in found.collect()] == ["bob"]
    with pytest.raises(ValueError):
        reports.entity_page(people, first=1001)
    with pytest.raises(ValueError):
        entities.find(people, skip=1)


def test_hydrated_lists(people):
    found = entities.hydrate_page(people, entities.find(people, EntityFilter(id=is_("alice"))))
    row = found.first()
    assert row["types"] == ["person"] and row["attributes"][0]["value"] == "Alice"


def test_relation_filter_on_entity(people):
    where = EntityFilter(relations=[HasRelation(is_("knows"), to_id=is_("charlie"))])
    assert rows(entities.find(people, where).select("id")) == [("alice",)]


def test_typed_view_and_errors(spark):
    tables = graph(spark, [
        ("p1", "name", "s", "Ann"), ("p1", "age", "s", "42"), ("p1", "nick", "s", "A"),
        ("p2", "name", "s", "Bo"), ("p2", "age", "s", "old"), ("p3", "name", "s", "Cy"),
        ("p3", "age", "s", "7"),
    ])
    fields = {"name": Field("name"), "nickname": Field("nick", required=False),
              "age": Field("age", "BIGINT")}
    valid, errors = overlay.split_errors(overlay.to_wide(tables.triples, fields), fields)
    assert sorted(tuple(r) for r in valid.collect()) == [
        ("p1", "Ann", "A", 42), ("p3", "Cy", None, 7)
    ]
    assert [r["entity"] for r in errors.collect()] == ["p2"]


def space_graph(spark, voc):
    """Quebec below Francophonie below root, a diamond beside it, and a cycle."""
    pairs = [("quebec", "franco"), ("franco", "root"), ("d", "l"), ("d", "r"), ("l", "top"),
             ("r", "top"), ("x", "y"), ("y", "x")]
    edges = [(f"{c}>{p}", c, p, "parent_space", "0", voc.indexer_space) for c, p in pairs]
    names = [("school", "name", "root", "School"), ("school", "name", "franco", "Ecole"),
             ("town", "name", "quebec", "Ville"), ("town", "name", "root", "Town")]
    return graph(spark, names, edges)


def test_closure_of_diamonds_and_cycles(spark, voc):
    tables = space_graph(spark, voc)
    found = {(r["root"], r["space_id"]): r["depth"] for r in hierarchy.parent_spaces(tables).collect()}
    assert found[("quebec", "root")] == 2
    assert found[("d", "top")] == 2 and sum(k[0] == "d" for k in found) == 4
    assert found[("x", "y")] == 1 and found[("x", "x")] == 0
    one = hierarchy.parent_spaces(tables, max_depth=1)
    assert one.agg({"depth": "max"}).first()[0] == 1
    below = {(r["root"], r["space_id"]) for r in hierarchy.subspaces(tables).collect()}
    assert below == {(b, a) for a, b in found}


def test_nearest_values(spark, voc):
    tables = space_graph(spark, voc)
    parents = hierarchy.parent_spaces(tables)
    keys = spark.createDataFrame(
        [("quebec", "school", "name"), ("root", "school", "name"), ("root", "town", "name"),
         ("franco", "town", "name"), ("alone", "town", "name")],
        "space_id string, entity string, attribute string",
    )
    down = hierarchy.nearest_down(tables, keys, parents)
    assert {(r["space_id"], r["entity"]): r["value"] for r in down.collect()} == {
        ("quebec", "school"): "Ecole", ("root", "school"): "School", ("root", "town"): "Town",
        ("franco", "town"): "Town",
    }
    up = hierarchy.nearest_up(tables, keys, parents)
    assert {(r["space_id"], r["entity"]): r["value"] for r in up.collect()} == {
        ("root", "school"): "School", ("root", "town"): "Town", ("franco", "town"): "Ville",
    }


def test_inherited_down_by_default_attributes(spark, voc):
    tables = space_graph(spark, voc)
    parents = hierarchy.parent_spaces(tables)
    keys = spark.createDataFrame([("quebec", "school", "name"), ("quebec", "school", "other")],
                                 "space_id string, entity string, attribute string")
    directions = hierarchy.aggregation_directions(tables, keys, parents)
    assert {r["attribute"]: r["direction"] for r in directions.collect()} == {
        "name": "Down", "other": None
    }
    found = hierarchy.inherited_triples(tables, keys, parents)
    assert rows(found.select("entity", "value")) == [("school", "Ecole")]
    strict = hierarchy.inherited_triples(tables, keys, parents, strict=True)
    assert strict.count() == 0


def test_references_and_codes(spark):
    table = spark.createDataFrame(
        [("a", "x", "s", "graph://b"), ("a", "y", "s", "graph://"), ("a", "z", "s", "text")],
        "entity string, attribute string, space_id string, value string",
    )
    edges = conformance.references(table)
    assert sorted(map(str, (r["target"] for r in edges.collect()))) == ["None", "b"]
    known, unknown = conformance.conform(
        spark.createDataFrame([(2,), (3,), (9,)], "code int"), "code", {2: "ACCEPT", 3: "REJECT"}, "v"
    )
    assert rows(known) == [(2, "ACCEPT"), (3, "REJECT")] and rows(unknown) == [(9,)]


def test_numeric_filter_skips_text(spark):
    tables = graph(spark, [("a", "n", "s", "9"), ("b", "n", "s", "10"), ("c", "n", "s", "x")])
    found = entities.find(
        tables, EntityFilter(attributes=[HasAttribute("n", Where(gte="9", numeric=True))])
    )
    assert rows(found.select("id")) == [("a",), ("b",)]
