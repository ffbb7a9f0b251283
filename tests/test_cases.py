"""Fixed cases of small rules, with the answers that are right."""

from spindrift.functions import identity
from spindrift.functions import text as T
from spindrift.operators import lookup, migrate
from spindrift.plans import stages
from pyspark.sql import functions as F


def test_payloads_as_values(spark):
    cases = [
        ('{"a":1,"b":2}', '{"b":2,"a":1.0}', True), ('{"a":1}', '{"a":true}', False), ('{"a":[1,2]}', '{"a":[2,1]}', False), (None, None, True), (None, "{}", False), ('{"a":{"x":null}}', '{ "a" : {"x" : null} }', True),
        ('{"a":null}', "{}", False), ('"1"', "1", False), ("no json", "no json", True), ("no json", "no  json", False), ('{"a":"é"}', '{"a":"\\u00e9"}', True), ('{"n":1.50}', '{"n":1.5}', True),
    ]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "key int, a string, b string")
    assert [r.same for r in rows.select("key", migrate.same_payload("a", "b").alias("same")).orderBy("key").collect()] == [c[2] for c in cases]


def test_addresses_and_replies(spark):
    cases = [("see https://h/x?key=1 now", '"What is it?"\nmore', "see https://h/x?… now", "What is it?"), ("http://a.b/c", "  plain  ", "http://a.b/c", "plain"), ("", "“quoted”", "", "quoted"), ("x?y", "one\n\ntwo", "x?y", "one")]
    got = spark.createDataFrame([c[:2] for c in cases], "url string, reply string").select(T.masked_url("url"), T.cleaned_reply("reply")).collect()
    assert sorted(map(tuple, got)) == sorted(c[2:] for c in cases)


def test_spaces(spark):
    cases = [("OpenAI", " text-embedding-3-small ", 1536, None, None, None, True), ("hash", "64", 64, None, None, "|", True), ("ollama", "nomic-embed-text", 768, "v1.5", "search", 'a"b', False)]
    rows = spark.createDataFrame(cases, "provider string, model string, dimensions int, version string, task string, prefix string, normalized boolean")
    assert {r.tag for r in rows.select(identity.tag().alias("tag")).collect()} == {identity.fingerprint(*c)["tag"] for c in cases}


def test_history(spark):
    rows = spark.createDataFrame(
        [("s", "a", "n1", "apply", 1), ("s", "a", "n1", "cutover", 3), ("s", "a", "n1", "rollback", 3), ("s", "a", "n2", "apply", 9), ("s", "b", "n1", "apply", 4), ("t", "a", "n1", "cleanup", 2), ("t", "a", "n1", None, None)],
        "store string, alias string, new string, event string, at int",
    )
    assert {(r.event, r.at) for r in lookup.history(rows, "s", "a", "n1").collect()} == {("apply", 1), ("cutover", 3), ("rollback", 3)}
    assert {tuple(r) for r in lookup.latest(rows, "store", "alias").collect()} == {("s", "a", "apply", 9), ("s", "b", "apply", 4), ("t", "a", "cleanup", 2)}
    keys = spark.createDataFrame([("pk", ["a", "b"]), ("i", ["c"]), ("none", [])], "index string, columns array<string>")
    assert {tuple(r) for r in lookup.key_columns(keys).collect()} == {("pk", "a", 1), ("pk", "b", 2), ("i", "c", 1)}


def test_stages(spark):
    cases = [
        (False, False, None, False, False, "not_started"), (True, False, 5, True, False, "filling"), (True, False, 0, True, False, "ready"), (True, False, 0, False, False, "filling"), (False, True, None, True, False, "cut_over"),
        (True, True, 1, True, False, "conflict"), (False, False, None, False, True, "cleaned_up"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n boolean, o boolean, m int, ix boolean, c boolean, want string")
    assert rows.where(stages.stage(F.col("n"), F.col("o"), F.col("m"), F.col("ix"), F.col("c")) != F.col("want")).count() == 0
    alias = spark.createDataFrame([(True, True, "cut_over"), (True, False, "cut_over"), (False, True, "applied"), (False, False, "not_applied")], "p boolean, n boolean, want string")
    assert alias.where(stages.alias_stage(F.col("p"), F.col("n")) != F.col("want")).count() == 0
