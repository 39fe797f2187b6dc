import pytest
from helpers import intervals, log, random_log, relation_log, replay, rows

from braidgraph.functions.predicates import snapshot
from braidgraph.operators import history, writes
from braidgraph.operators.writes import Block

SET, DELETE = "SET_TRIPLE", "DELETE_TRIPLE"


def values(df):
    return rows(df.select("entity", "attribute", "value"))


def test_versions_of_one_triple(spark):
    ops = log(spark, [(0, 0, 0, "s", SET, "abc", "name", "Alice"),
                      (1, 0, 0, "s", SET, "abc", "name", "NotAlice")])
    derived = history.derive_triples(ops)
    first = "0000000000000000:00000000"
    assert values(derived.filter(snapshot())) == [("abc", "name", "NotAlice")]
    assert values(derived.filter(snapshot(first))) == [("abc", "name", "Alice")]


def test_update_without_versioning(spark):
    ops = log(spark, [(0, 0, 0, "s", SET, "abc", "name", "Alice"),
                      (0, 0, 1, "s", SET, "abc", "name", "NotAlice")])
    derived = history.derive_triples(ops, versioning=False)
    assert values(derived.filter(snapshot())) == [("abc", "name", "NotAlice")]
    assert values(derived.filter(snapshot("0"))) == [("abc", "name", "NotAlice")]


def test_delete_keeps_the_past(spark):
    ops = log(spark, [(0, 0, 0, "s", SET, "abc", "name", "Alice"),
                      (1, 0, 0, "s", DELETE, "abc", "name", None)])
    derived = history.derive_triples(ops)
    assert values(derived.filter(snapshot())) == []
    assert values(derived.filter(snapshot("0000000000000000:00000000"))) == [("abc", "name", "Alice")]


def test_unversioned_set_after_delete_reopens(spark):
    ops = log(spark, [(0, 0, 0, "s", SET, "abc", "name", "Alice"),
                      (1, 0, 0, "s", DELETE, "abc", "name", None),
                      (2, 0, 0, "s", SET, "abc", "name", "Again")])
    derived = history.derive_triples(ops, versioning=False)
    assert values(derived.filter(snapshot())) == [("abc", "name", "Again")]


def test_set_and_delete_in_one_edit_leaves_nothing(spark):
    # Deletes follow sets within an edit, wherever they stand in it.
    ops = log(spark, [(0, 0, 0, "s", DELETE, "abc", "name", None),
                      (0, 0, 1, "s", SET, "abc", "name", "Alice")])
    assert intervals(history.derive_triples(ops)) == []


def test_spaces_are_independent(spark):
    ops = log(spark, [(0, 0, 0, "s", SET, "abc", "name", "Alice"),
                      (1, 0, 0, "t", SET, "abc", "name", "Bob")])
    assert values(history.derive_triples(ops).filter(snapshot())) == [
        ("abc", "name", "Alice"), ("abc", "name", "Bob")
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("slice_blocks", [10**9, 7])
def test_intervals_equal_replay(spark, seed, slice_blocks):
    operations = random_log(seed, 300)
    derived = history.derive_triples(log(spark, operations), slice_blocks=slice_blocks)
    assert intervals(derived) == replay(operations)


@pytest.mark.parametrize("slice_blocks", [10**9, 7])
def test_unversioned_intervals_equal_replay(spark, slice_blocks):
    operations = random_log(7, 300)
    derived = history.derive_triples(log(spark, operations), False, slice_blocks)
    assert intervals(derived) == replay(operations, versioning=False)


def test_snapshot_equals_replay_of_prefix(spark):
    operations = random_log(11, 200)
    derived = history.derive_triples(log(spark, operations)).cache()
    for block in (5, 20, 39):
        version = f"{block:016d}:00000002"
        prefix = [o for o in operations if o[0] <= block]
        current = sorted(
            (e, a, v) for e, a, _, v, _, closed in replay(prefix) if closed is None
        )
        assert values(derived.filter(snapshot(version))) == current


def test_undo_equals_replay_of_prefix(spark):
    operations = random_log(12, 200)
    kept = history.undo_after(log(spark, operations), 15)
    expected = replay([o for o in operations if o[0] <= 15])
    assert intervals(history.derive_triples(kept)) == expected


def test_versions_past_ten_thousand_edits_of_a_block(spark):
    ops = log(spark, [(0, 9_999, 0, "s", SET, "abc", "name", "before"),
                      (0, 10_000, 0, "s", SET, "abc", "name", "after")])
    derived = history.derive_triples(ops)
    as_of = f"{0:016d}:{9_999:08d}"
    assert values(derived.filter(snapshot(as_of))) == [("abc", "name", "before")]
    assert values(derived.filter(snapshot())) == [("abc", "name", "after")]


def test_intervals_do_not_overlap(spark):
    derived = intervals(history.derive_triples(log(spark, random_log(13, 300)), slice_blocks=3))
    by_key = {}
    for entity, attribute, space, _, began, closed in derived:
        by_key.setdefault((entity, attribute, space), []).append((began, closed))
    for spans in by_key.values():
        spans.sort()
        assert sum(closed is None for _, closed in spans) <= 1
        for (_, closed), (began, _) in zip(spans, spans[1:]):
            assert closed is not None and closed <= began


def test_entities_created_and_updated(spark):
    ops = log(spark, [(3, 0, 0, "s", SET, "abc", "name", "Alice"),
                      (5, 0, 0, "s", DELETE, "abc", "name", None),
                      (1, 0, 0, "s", DELETE, "gone", "name", None)])
    found = history.derive_entities(ops).select("id", "created_at_block", "updated_at_block")
    assert rows(found) == [("abc", "3", "5")]


def test_relations_need_both_ends(spark):
    people = log(spark, [(0, 0, i, "s", SET, p, "name", p) for i, p in enumerate(("a", "b"))])
    late = log(spark, [(9, 0, 0, "s", SET, "c", "name", "c")])
    edges = relation_log(spark, [
        (1, 0, 0, "s", "CREATE_RELATION", "ab", "a", "b", "knows", "0"),
        (1, 0, 1, "s", "CREATE_RELATION", "ac", "a", "c", "knows", "1"),
        (1, 0, 2, "s", "CREATE_RELATION", "az", "a", "z", "knows", "2"),
    ])
    ops = people.unionByName(late).unionByName(edges)
    assert rows(history.derive_relations(ops).select("id")) == [("ab",)]
    dropped = history.relation_creations(ops).filter("NOT accepted")
    assert rows(dropped.select("relation.id")) == [("ac",), ("az",)]


def test_later_relation_supersedes_and_delete_closes(spark):
    people = log(spark, [(0, 0, i, "s", SET, p, "name", p) for i, p in enumerate("abc")])
    edges = relation_log(spark, [
        (1, 0, 0, "s", "CREATE_RELATION", "r", "a", "b", "knows", "0"),
        (2, 0, 0, "s", "CREATE_RELATION", "r", "a", "c", "knows", "0"),
        (3, 0, 0, "s", "DELETE_RELATION", "r", None, None, None, None),
    ])
    derived = history.derive_relations(people.unionByName(edges))
    spans = rows(derived.select("to_id", "min_version", "max_version"))
    assert [s[0] for s in spans] == ["b", "c"]
    assert all(s[2] is not None for s in spans)


def test_member_and_editor_of_one_space_are_both_kept(spark):
    people = log(spark, [(0, 0, i, "s", SET, p, "name", p) for i, p in enumerate("ab")])
    edges = relation_log(spark, [
        (1, 0, 0, "s", "CREATE_RELATION", "m", "a", "b", "member", "0"),
        (1, 0, 1, "s", "CREATE_RELATION", "e", "a", "b", "editor", "0"),
    ])
    assert history.derive_relations(people.unionByName(edges)).count() == 2


def test_writes_build_entities_with_types(spark, voc):
    table = spark.createDataFrame(
        [("abc", "hello", 123, ["foo_type"]), ("def", None, 5, [])],
        "entity string, foo string, bar long, types array<string>",
    )
    columns = {"foo": ("foo", "TEXT"), "bar": ("bar", "NUMBER")}
    ops = writes.insert_entities(table, columns, Block(1), "root", voc)
    assert values(history.derive_triples(ops)) == [
        ("abc", "bar", "123"), ("abc", "foo", "hello"), ("def", "bar", "5")
    ]
    types = spark.createDataFrame([("foo_type",)], "id string")
    edges = history.derive_relations(ops, existing=types)
    assert rows(edges.select("from_id", "to_id", "relation_type")) == [("abc", "foo_type", "types")]


def test_partial_new_version_of_attributes(spark, voc):
    first = spark.createDataFrame([("abc", "hello", 123)], "entity string, foo string, bar long")
    second = spark.createDataFrame([("abc", 456)], "entity string, bar long")
    ops = writes.set_attributes(
        first, {"foo": ("foo", "TEXT"), "bar": ("bar", "NUMBER")}, Block(0), space_id="root"
    ).unionByName(
        writes.set_attributes(second, {"bar": ("bar", "NUMBER")}, Block(1), space_id="root")
    )
    derived = history.derive_triples(ops)
    assert values(derived.filter(snapshot())) == [("abc", "bar", "456"), ("abc", "foo", "hello")]
    assert values(derived.filter(snapshot("0000000000000000:00000000"))) == [
        ("abc", "bar", "123"), ("abc", "foo", "hello")
    ]


def test_relation_with_attributes_and_deletes(spark, voc):
    people = log(spark, [(0, 0, i, "s", SET, p, "name", p) for i, p in enumerate("ab")])
    edge = spark.createDataFrame(
        [("rel", "knows", "a", "b", "0", 42)],
        "id string, type string, from_entity string, to_entity string, index string, bar long",
    )
    ops = people.unionByName(
        writes.insert_relations(edge, {"bar": ("bar", "NUMBER")}, Block(1), "s")
    )
    assert ("rel", "bar", "42") in values(history.derive_triples(ops))
    gone = ops.unionByName(writes.delete_relations(edge, Block(2), "s"))
    assert history.derive_relations(gone).filter(snapshot()).count() == 0
    all_a = spark.createDataFrame([("a", "s")], "entity string, space_id string")
    deletes = writes.delete_entities(all_a, history.derive_triples(ops), Block(3))
    left = history.derive_triples(ops.unionByName(deletes)).filter(snapshot())
    assert ("a", "name", "a") not in values(left) and ("b", "name", "b") in values(left)
