"""What jobs read and shuffle as the tables grow, and the results of the paths that save it."""

from collections import defaultdict

from pyspark.sql import functions as F

from ledgerflow.operators import alerts
from ledgerflow.plans import job_queries
from ledgerflow.sources import files

from conftest import SF_SMALL

ROWS = [(t, s, r) for s, r, steps in [("A", "X", [1, 1, 2, 25, 26, 60, 85]), ("A", "Y", [2, None, 84]), (None, "X", [5, 5, 29]), ("B", None, [7, 31, 32])] for t in steps]


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_velocity_counts_rows_once(spark):
    df = spark.createDataFrame(ROWS, "time_step int, sender_id string, receiver_id string")
    out = alerts.with_velocity(df)
    assert _plan(out)[0].count("HashAggregate") == 2  # one partial and one final count in a task's memory
    timed = [r for r in ROWS if r[0] is not None]
    for r in out.where("time_step is not null").collect():
        assert r.sender_velocity == sum(1 for t, s, _ in timed if s == r.sender_id and r.time_step - 24 <= t <= r.time_step)


def test_velocity_and_first_payment_in_seven_narrow_shuffles(spark):
    df = spark.createDataFrame(ROWS, "time_step int, sender_id string, receiver_id string")
    out = alerts.with_velocity_and_first(df)
    assert _plan(out)[1].count("Exchange") <= 8
    first = defaultdict(lambda: 10**9)
    for t, s, r in ROWS:
        first[s, r] = min(first[s, r], 10**9 if t is None else t)
    got = out.collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.first_to_receiver == (r.time_step is not None and r.time_step == first[r.sender_id, r.receiver_id])
        if r.time_step is not None:
            n = sum(1 for t, s, _ in ROWS if s == r.sender_id and t is not None and r.time_step - 24 <= t <= r.time_step)
            assert (r.sender_velocity, r.velocity_check) == (n, n >= 3)


def test_ratio_is_read_before_the_rows_are_shuffled(spark):
    df = spark.createDataFrame(
        [(1, "A", "X", 5.0, 0.9, 0.8, False, False), (1, "A", "Y", 6.0, 0.4, 0.8, False, False), (1, "B", "Y", 7.0, float("nan"), 0.8, True, False)],
        "time_step int, sender_id string, receiver_id string, amount double, balance_change_ratio double, risk_score double, unusual_amount boolean, high_value_transaction boolean")
    out = alerts.generate_alerts(df)
    assert sorted((r.amount, r.alert_type) for r in out.collect()) == [(5.0, "unusual_pattern"), (7.0, "suspicious_amount")]
    exchanged = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("Join ")[0].splitlines() if "Generate" in line or "Project" in line]
    assert not any("balance_change_ratio" in line for line in exchanged)


def test_loads_read_stored_rows(spark, monkeypatch):
    plans = []

    def seen(rows, path, load_id):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return kept(rows, path, load_id)

    kept = files._replace_load
    monkeypatch.setattr(files, "_replace_load", seen)
    for query, loads in ((job_queries.loaded_twice, 6), (job_queries.inserted_twice, 4)):
        plans.clear()
        assert query(spark, SF_SMALL).agg(F.sum("rows")).first()[0] > 0
        # no load joins the tables or scores its rows anew
        assert len(plans) == loads and not any("Join" in p or "orderpriority" in p or "power" in p.lower() for p in plans)


def test_only_columns_of_other_types_are_checked(spark):
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL("a int, b string, c decimal(3,2), d long")
    df = spark.createDataFrame([(1, "x", 1.5), (2, None, 12.5), (None, "y", None)], "a int, b string, c double")
    good, rejected = files.conform(df, schema)
    assert sorted((r.a or 0, r.b or "", r.c and float(r.c), r.d) for r in good.collect()) == [(0, "y", None, None), (1, "x", 1.5, None)]
    assert [(r.a, r.b, r.c, [tuple(x) for x in r.rejected]) for r in rejected.collect()] == [(2, None, 12.5, [("c", "12.5")])]
    assert files._fitted(df, schema)._jdf.queryExecution().analyzed().toString().count("try_cast") <= 2  # of c: value and check
    whole, none = files.conform(df.drop("c"), T.StructType.fromDDL("a int, b string"))
    assert whole.count() == 3 and none.count() == 0
