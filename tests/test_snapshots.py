import pytest
from helpers import log, random_log

from braidgraph.functions.predicates import snapshot
from braidgraph.operators import history, snapshots
from braidgraph.operators.snapshots import COLUMNS, Snapshots


def as_rows(df):
    return sorted((tuple(row) for row in df.select(*COLUMNS).collect()), key=repr)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = random_log(31, 300)
    store = Snapshots(str(tmp_path_factory.mktemp("snapshots")))
    ops = log(spark, rows).coalesce(2).cache()
    snapshots.build(store, ops, every=6)
    return rows, ops, store


@pytest.mark.parametrize("block,edit", [(0, 0), (5, 9), (6, 0), (6, 1), (17, 1), (18, 0), (38, 2), (39, 9)])
def test_versions_equal_the_derived_history(spark, built, block, edit):
    _, ops, store = built
    version = f"{block:016d}:{edit:08d}"
    expected = history.derive_triples(ops).filter(snapshot(version))
    assert as_rows(snapshots.triples_at(spark, store, version)) == as_rows(expected)


def test_a_read_opens_few_files(spark, built):
    _, _, store = built
    read = snapshots.triples_at(spark, store, f"{20:016d}:{1:08d}").inputFiles()
    assert 4 * len(read) < len(snapshots.files_of(store, spark))


def test_extension_equals_a_store_built_at_once(spark, built, tmp_path):
    rows, ops, _ = built
    store = Snapshots(str(tmp_path))
    snapshots.extend(store, ops, 11)
    # The new blocks alone are enough.
    snapshots.extend(store, log(spark, [row for row in rows if row[0] > 11]), 39)
    version = f"{39:016d}:{9:08d}"
    expected = history.derive_triples(ops).filter(snapshot(version))
    assert as_rows(snapshots.triples_at(spark, store, version)) == as_rows(expected)
    with pytest.raises(ValueError):
        snapshots.extend(store, ops, 39)
    with pytest.raises(ValueError):
        snapshots.triples_at(spark, store, f"{40:016d}:{0:08d}")


def test_an_empty_log_makes_no_store(spark, tmp_path):
    store = Snapshots(str(tmp_path))
    snapshots.build(store, log(spark, random_log(1, 1)).filter("false"), every=5)
    assert store.marks(spark) == []
