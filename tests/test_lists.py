from marktlens.operators import ranking
from marktlens.plans import lists



def held(spark):
    pairs = spark.createDataFrame([(11, 1, 1, 5), (12, 1, 2, 5), (13, 1, 3, None), (21, 2, 1, None), (22, 2, 2, 1), (31, 3, 9, 1)], "id long, task_id long, cb_id long, rate int")
    contacts = spark.createDataFrame([(c, 1) for c in range(5)] + [(4, 2), (5, 2), (None, 2), (5, 3), (6, 3), (7, None)], "contact_id long, cb_id long")
    return pairs, contacts


def test_best_pairs_meet_their_contacts_where_their_task_is(spark, monkeypatch):
    monkeypatch.setattr(ranking, "MOST", 2)
    pairs, contacts = held(spark)
    df = ranking.best_pair(pairs, contacts).select("task_id", "contact_id", "cb_id", "rate", "id")
    best = {}
    for r in pairs.join(contacts, "cb_id").collect():
        best.setdefault((r.task_id, r.contact_id), []).append((r.rate is None, r.rate, r.id, r.cb_id))
    want = {key: min(rows, key=lambda x: (x[0], x[1] or 0, x[2])) for key, rows in best.items()}
    assert {(r.task_id, r.contact_id): (r.rate is None, r.rate, r.id, r.cb_id) for r in df.collect()} == want and df.count() == len(want) == 15
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    made = next(i for i, line in enumerate(plan) if "explode(_contacts" in line)
    assert not [line for line in plan[:made] if "Exchange" in line]


def test_lists_are_rebuilt_in_one_join(spark):
    old = spark.createDataFrame([(1, 1, 7, 1, 50), (1, 2, 7, 1, None), (1, 3, 7, 1, None), (1, 4, 7, 1, 9), (None, 1, 7, 1, None), (None, 2, 7, 1, 3)], "task_id long, contact_id long, cb_id long, rate_cb int, rate int")
    new = spark.createDataFrame([(1, 1, 7, 1), (1, 2, 8, 1), (1, 5, 7, None)], "task_id long, contact_id long, cb_id long, rate_cb int")
    df = lists.rebuild(old, new, "2020-01-01")
    assert sorted(map(tuple, df.collect()), key=repr) == sorted([(1, 1, 7, 1, 50, "keep"), (1, 2, 8, 1, None, "update"), (1, 4, 7, 1, 9, "keep"), (1, 5, 7, None, None, "insert"), (None, 2, 7, 1, 3, "keep")], key=repr)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
