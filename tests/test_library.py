import pytest

from millrace.change.store import Store
from millrace.lang.errors import QueryError
from millrace.operators.grouping import Entity
from millrace.plans.engine import Engine
from millrace.plans.library import Library


def test_library(spark, tmp_path):
    engine = Engine(spark, {"t": spark.createDataFrame([(1, "a", 5), (1, "a", 6), (2, "b", 7)], "k int, n string, c int")})
    (tmp_path / "by_key.sql").write_text("SELECT k, n FROM t WHERE @k IS NULL OR k = @k")
    (tmp_path / "piped.pipe").write_text("t |> filter(c > @least) |> select(k, n, c)")
    (tmp_path / "bad.pipe").write_text("t |> select(nope)")
    (tmp_path / "gone.sql").write_text("DELETE FROM t")
    (tmp_path / "note.txt").write_text("x")
    library = Library(engine, str(tmp_path))
    assert list(library) == ["bad", "by_key", "gone", "piped"]
    assert library["by_key"].parameters == ["k"] and library["by_key"]().count() == 3 and library["by_key"](k=2).count() == 1
    assert library["piped"].schema().simpleString() == "struct<k:int,n:string,c:int>" and library["gone"].kind == "delete"
    got = library["piped"].nested(Entity("p", ("k",), ("k", "n")), Entity("cs", ("c",), ("c",)), least=4)
    assert sorted((r.k, [x.c for x in r.cs]) for r in got.collect()) == [(1, [5, 6]), (2, [7])]
    assert list(library.validate()) == ["bad"]
    with pytest.raises(QueryError):
        library["by_key"](x=1)
    with pytest.raises(QueryError):
        library["gone"].schema()


@pytest.mark.parametrize("durable", [False, True])
def test_store(spark, tmp_path, durable):
    folder = str(tmp_path / "state") if durable else None
    store = Store(spark, folder)
    origin = store.origin()
    assert store.origin() == origin
    session = store.session()
    session.pulled = 7
    store.save(session)
    assert (store.session().origin, store.session().pulled, store.session().pushed) == (origin, 7, 0)
    store.put("_sync_clients", [("a", 1, "t", "c"), ("b", 2, "t", "c")])
    store.put("_sync_clients", [("a", 5, "u", "c")])
    assert sorted(tuple(r)[:2] for r in store.get("_sync_clients").collect()) == [("a", 5), ("b", 2)]
    assert store.delete("_sync_clients", origin_id="b") == 1 and store.delete("_sync_clients", origin_id="b") == 0
    store.put("_sync_subscriptions", [("s1", "a", "table", "t", None, "x", "2020"), ("s2", "a", "table", "t", None, "x", None)])
    assert store.expire("2025") == 1 and [r.subscription_id for r in store.get("_sync_subscriptions").collect()] == ["s2"]
    if durable:
        assert Store(spark, folder).origin() == origin
