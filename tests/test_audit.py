import json

from pyspark.sql import functions as F

from epistola.operators import audit, journal, policy


def lines(n=5):
    ops = [{"op": "add", "hash": f"h{i}", "bucket": "2024/01", "account": "k", "folder": "INBOX", "subject": f'a "self":"x" {i}\n'} for i in range(n)]
    return journal.append(None, ops, "2024-01-01T00:00:00+00:00")


def frame(spark, all_lines, segment="s1"):
    return spark.createDataFrame([(segment, i + 1, x) for i, x in enumerate(all_lines)], "segment string, line_no long, line string")


def problems(df):
    return sorted((r["problem"], r["known"]) for r in journal.verify(df).collect())


def test_chain(spark):
    good = lines()
    assert problems(frame(spark, good)) == []
    edited = [good[0].replace("h0", "hX"), *good[1:]]
    assert problems(frame(spark, edited)) == [("self", False)]
    entry = json.loads(good[1]) | {"hash": "hX"}
    entry["self"] = journal.entry_hash(entry)
    assert problems(frame(spark, [good[0], journal.canonical(entry), *good[2:]])) == [("prev", False)]
    assert problems(frame(spark, [*good[:2], *good[3:]])) == [("prev", False)]
    assert problems(frame(spark, [*good, '{"torn'])) == []
    assert problems(frame(spark, [*good[:2], '{"torn', *good[2:]]))[0][0] in ("prev", "seq", "unreadable")


def test_known_break(spark):
    good = lines()
    rest = good[3:]
    note = journal.append(json.loads(rest[-1]), [{"op": "kette", "place": "s1", "number": 4}], "2024-01-02T00:00:00+00:00")
    assert problems(frame(spark, [*good[:2], *rest, *note])) == [("prev", True)]


def test_segments(spark):
    good = lines(6)
    both = frame(spark, good[:3], "s1").union(frame(spark, good[3:], "s2"))
    assert problems(both) == []
    assert problems(frame(spark, good[:2], "s1").union(frame(spark, good[3:], "s2"))) == [("prev", False)]


def test_fold_and_store(spark):
    ops = [{"op": "add", "hash": "a", "bucket": "b", "account": "k", "folder": "A"}, {"op": "delete", "hash": "a"}, {"op": "add", "hash": "a", "bucket": "b", "account": "k", "folder": "B"}, {"op": "add", "hash": "c", "bucket": "b", "account": "k", "folder": "B"}, {"op": "note", "kind": "ordner_umbenannt", "account": "k", "old": "B", "new": "C"}]
    e = journal.parsed(frame(spark, journal.append(None, ops, "t")))
    assert sorted(r["hash"] for r in journal.live(e).collect()) == ["a", "c"]
    assert sorted((r["hash"], r["folder"]) for r in journal.locations(e).collect()) == [("a", "C"), ("c", "C")]
    store = spark.createDataFrame([("a",), ("z",)], "hash string")
    states = {r["hash"]: r["state"] for r in audit.store_against_journal(store, journal.live(e)).collect()}
    assert states == {"a": "there", "c": "missing", "z": "unexpected"}


def test_reconcile(spark):
    server = spark.createDataFrame([("k", "A", 1), ("k", "A", 2), ("k", "B", 1)], "account string, folder string, uid long")
    held = spark.createDataFrame([("k", "A", 1), ("k", "A", 2)], "account string, folder string, uid long")
    found = audit.reconcile(server, held)
    assert {r["folder"]: r["verdict"] for r in found.collect()} == {"A": "all present", "B": "missing"}
    assert audit.overall(found).first()["verdict"] == "missing"
    assert audit.overall(found.where("false")).first()["verdict"] == "nothing that old"


def test_policy(spark):
    rows = spark.createDataFrame([("buchungsbeleg", 2015), ("buchungsbeleg", 2016), ("privat", 1990), ("handelsbrief", None)], "category string, year int")
    p = policy.Policy()
    locked = [r["l"] for r in rows.select(p.is_locked(F.col("category"), F.col("year"), 2024).alias("l")).collect()]
    assert locked == [False, True, False, True]
    assert p.due(rows, 2024).count() == 1 and policy.Policy(supervised=True).due(rows, 2024).count() == 0
    assert policy.Policy("CH").table()["handelsbrief"] == 10


def test_rules(spark):
    rules = [policy.Rule("von", "*@bank.example", "privat", False), policy.Rule("ordner", "Rechnungen/*", "buchungsbeleg"), policy.Rule("von", "*@BANK.example", "handelsbrief")]
    rows = spark.createDataFrame([("Rechnungen/2024", "x@bank.example"), ("A", "x@bank.example"), ("A", "")], "folder string, sender string")
    assert [r["c"] for r in rows.select(policy.classify(rules, F.col("folder"), F.col("sender"), F.lit("")).alias("c")).collect()] == ["buchungsbeleg", "handelsbrief", None]
