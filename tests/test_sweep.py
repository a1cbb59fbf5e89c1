from pyspark.sql import functions as F

from skarn.operators.ingest import children, window_tree
from skarn.plans import queries_sweep
from skarn.sources.store import Store


def what(s):
    found = {tuple(r) for r in s.store.read("found").collect()}
    state = {r.query_slug: (r.pending_windows, sorted(r.completed_windows), sorted(map(tuple, r.failed_windows)), r.pages_fetched, r.truncated) for r in s.store.read("state").collect()}
    return found, state


class Died(Exception):
    pass


def test_a_sweep_that_dies_anywhere_ends_as_one_that_does_not(spark, sf, monkeypatch):
    broken = "window = '1995-04-01..1995-06-30'"
    whole = queries_sweep.opened(spark, sf, 40, broken)
    assert whole.run("a", lambda: "t") == "complete"
    want = what(whole)
    assert any(v[2] == [("1995-04-01..1995-06-30", "502")] for v in want[1].values()) and all(v[0] == [] for v in want[1].values())
    runs = {(r.outcome, r.ended_at): r for r in whole.store.read("runs").collect()}
    assert set(runs) == {("complete", "t")}
    # every third write of the store fails, before or after it has committed
    s, put, calls = queries_sweep.opened(spark, sf, 40, broken), Store.put, []

    def dying(self, name, *x):
        calls.append(name)
        if len(calls) % 5 == 0:
            raise Died
        out = put(self, name, *x)
        if len(calls) % 5 == 3:
            raise Died
        return out

    outcomes = []
    for k in range(60):
        monkeypatch.setattr(Store, "put", dying)
        try:
            outcomes.append(s.run(f"r{k}", lambda: "t"))
        except Died:
            outcomes.append("died")
        monkeypatch.undo()
        if not s.store.read("state").where(F.size("pending_windows") > 0).count():
            break
    assert "died" in outcomes and what(s) == want


def test_an_interrupted_sweep_goes_on(spark, sf):
    s = queries_sweep.opened(spark, sf, 60)
    rounds = iter([False, True])
    assert s.run("a", lambda: "t", lambda: next(rounds)) == "interrupted"
    assert {r.outcome for r in s.store.read("runs").collect()} == {"interrupted"} and any(v[0] for v in what(s)[1].values())
    s.begin(spark.createDataFrame([("F", ["never"])], "query_slug string, windows array<string>"))
    assert s.run("b", lambda: "u") == "complete" and len(what(s)[0]) == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_the_window_tree_is_the_driver_s(spark):
    span = "2019-01-01..2020-12-31"
    want, level = {(span, 0)}, [span]
    for k in range(1, 5):
        level = [c for w in level for c in children(w)]
        want |= {(w, k) for w in level}
    got = window_tree(spark.createDataFrame([(span,), (None,)], "window string")).where("window IS NOT NULL").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
