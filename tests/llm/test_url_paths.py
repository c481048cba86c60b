"""Path rules as intervals below their host, and fixity audits of records known by hash."""

import random

from pyspark.sql import functions as F

from outlay.llm import fixity, queries, urlrules

RULES = "host string, path string, verdict string"


def longest(host, path, rules):
    fits = [(len(a) + len(b), len(a), a + b, v) for (a, b), v in rules.items() if (host == a or host.endswith("." + a)) and path.startswith(b)]
    return max(fits)[2:] if fits else (None, "allow")


def test_nested_paths_of_nested_hosts_equal_brute_force(spark):
    rnd = random.Random(11)
    piece = lambda: "".join("/" + rnd.choice(["a", "b", "ab", ""]) for _ in range(rnd.randint(0, 5)))
    host = lambda: ".".join(rnd.choice("xy") for _ in range(rnd.randint(1, 4)))
    rules = {(host(), piece()): rnd.choice(["block", "allow"]) for _ in range(150)}
    pages = [(i, host(), piece() or "/") for i in range(600)]
    # One url makes a third of all rows.
    pages += [(i, "x.y", "/a/b/ab") for i in range(600, 900)]
    df = spark.createDataFrame([(i, f"http://{h}{p}") for i, h, p in pages], "page_id int, url string")
    rule = spark.createDataFrame([(*k, v) for k, v in rules.items()], RULES)
    for ranges in (1, 3, 40):
        got = {r.page_id: (r.rule, r.verdict) for r in urlrules.judge(df, rule, ranges=ranges).collect()}
        assert got == {i: longest(h, p, rules) for i, h, p in pages}


def test_many_path_rules_of_one_site_leave_only_nested_ones_on_a_row(spark):
    rules = spark.range(20_000).select(F.lit("big.org").alias("site"), F.concat(F.lit("/p"), F.col("id"), F.lit("/")).alias("key"), F.lit("block").alias("verdict"))
    keys = spark.range(0, 20_000, 7).select(F.lit("big.org").alias("site"), F.concat(F.lit("/p"), F.col("id"), F.lit("/x")).alias("key"))
    got = urlrules.swept(keys, rules, 16).select(F.size("open").alias("n"), (F.element_at("open", -1)["key"] == F.regexp_extract("key", "^/p[0-9]+/", 0)).alias("right"))
    assert got.groupBy("n", "right").count().collect() == [(1, True, keys.count())]


def test_very_long_paths(spark):
    path = "/" + "ab" * 30_000
    df = spark.createDataFrame([(i, f"http://h.org{path}{i}?q") for i in range(30)], "page_id int, url string")
    rule = spark.createDataFrame([("org", path[:n], "block") for n in (1, 100, 50_000)] + [("h.org", "/b", "allow")], RULES)
    assert {r.rule for r in urlrules.judge(df, rule, ranges=8).collect()} == {"org" + path[:50_000]}


def test_ranges_need_no_python(spark):
    keys = spark.createDataFrame([("", f"k{i}.") for i in range(50)], "site string, key string")
    rules = spark.createDataFrame([("", "k1.", "block")], "site string, key string, verdict string")
    text = urlrules.swept(keys, rules, 8)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in text and "NestedLoop" not in text and "Cartesian" not in text


def test_audit_of_hashes_equals_the_one_of_payloads(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", None if i % 9 == 0 else "x" * i) for i in range(600)], "page_id int, url string, html string")
    rows = fixity.with_offsets(fixity.warc_payloads(pages).withColumn("size", fixity.size_of(F.col("payload"))))
    assert rows.select("file", "offset", "page_id", fixity.hash_of(F.col("payload")).alias("hash")).exceptAll(fixity.warc_records(pages)).count() == 0
    damaged = rows.withColumn("payload", F.when(F.col("page_id") % 50 == 1, F.lit("no").cast("binary")).otherwise(F.col("payload")))
    by_payload = fixity.audit(rows, damaged)
    by_hash = fixity.audit(fixity.warc_records(pages), damaged.select("file", "offset", fixity.hash_of(F.col("payload")).alias("hash")))
    assert sorted(map(tuple, by_payload.collect())) == sorted(map(tuple, by_hash.collect())) and by_hash.count() == 12


def test_payloads_are_not_shuffled(spark):
    pages = queries.read(spark, "/root/testdata/sf0.001", "pages")
    text = fixity.warc_records(pages)._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in text.splitlines() if "Exchange" in x]
    assert exchanges and "Window" in text
    above = text[: text.index("Exchange")]
    assert "payload" not in above and "html" not in above
