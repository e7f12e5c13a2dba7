"""URL filtering by a sort-merge range join of canonical keys with rule intervals.

A URL's key is its host with the labels in reverse, then its path:
https://www.example.com/a/b becomes com.example.www./a/b. A rule for a domain
or for the start of a path is a prefix of keys, which is an interval in their
order. URLs are range-partitioned by key; a rule goes to the partitions its
interval overlaps; and each partition is swept in order with a stack of the
rules that are open. Rules nest, so the top of the stack is the most specific
rule for a URL, and it decides.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import Scratch, partitions, ship

#: What `op1_url_filter` applies: (domain or domain/path, action).
RULES: list[tuple[str, str]] = [
    ("spam-farm.example.org", "block"),
    ("cheap-pills.example.com", "block"),
    ("casino-win.example.com", "block"),
    ("cheap-pills.example.com/en/", "review"),
    ("m.casino-win.example.com", "review"),
    ("m.casino-win.example.com/de/", "block"),
    ("example.com", "allow"),
    ("example.net", "allow"),
    ("blog.tionsh.example.com/fr/", "review"),
    ("blog.tionsh.example.com/fr/7", "block"),
    ("tionble.example.org", "allow"),
    ("tionble.example.org/es/", "review"),
]


def url_key(url: Column) -> Column:
    """The canonical key: scheme, user, port and fragment go, the host is lower case; null where there is no host."""
    host = F.rtrim(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)), F.lit("."))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    rooted = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."), rooted))


def rule_prefix(rule: Column) -> Column:
    """The prefix of keys that a rule `domain` or `domain/path` stands for."""
    host = F.rtrim(F.lower(F.substring_index(rule, "/", 1)), F.lit("."))
    path = F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)")
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."), path))


def rules_table(spark: SparkSession, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "rule string, action string")


def _sweep(batches):
    """Rows (pid, key, kind, id, rule, action) in order of pid, key, kind; kind 0 opens a rule, 1 is a URL."""
    stack: list[tuple[str, str, str]] = []
    pid = None
    for b in batches:
        keys, kinds, pids = b.column("key").to_pylist(), b.column("kind").to_pylist(), b.column("pid").to_pylist()
        rules, actions = b.column("rule"), b.column("action")
        picked, depth, n = [None] * len(keys), [0] * len(keys), len(keys)
        opens = [i for i, k in enumerate(kinds) if k == 0 or (i and pids[i] != pids[i - 1])] + [n]
        at = 0
        for stop in opens:
            while at < stop:  # URLs between two rules
                if pids[at] != pid:
                    stack, pid = [], pids[at]
                while stack and not keys[at].startswith(stack[-1][0]):
                    stack.pop()
                if not stack:
                    at = stop
                    break
                end = bisect.bisect_left(keys, True, at, stop, key=lambda k, prefix=stack[-1][0]: not k.startswith(prefix))
                picked[at:end] = [stack[-1]] * (end - at)
                depth[at:end] = [len(stack)] * (end - at)
                at = end
            if stop < n and kinds[stop] == 0:
                if pids[stop] != pid:
                    stack, pid = [], pids[stop]
                while stack and not keys[stop].startswith(stack[-1][0]):
                    stack.pop()
                stack.append((keys[stop], rules[stop].as_py(), actions[stop].as_py()))
                at = stop + 1
        url = [i for i, k in enumerate(kinds) if k]
        yield pa.RecordBatch.from_arrays(
            [b.column("id").take(pa.array(url, pa.int64())), pa.array([keys[i] for i in url], pa.string()), pa.array([picked[i][1] if picked[i] else None for i in url], pa.string()), pa.array([picked[i][2] if picked[i] else "none" for i in url], pa.string()), pa.array([depth[i] for i in url], pa.int32())],
            names=["page_id", "key", "rule", "action", "n_rules"],
        )


_OUT = "page_id long, key string, rule string, action string, n_rules int"


def url_filter(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, key, rule, action, n_rules) for every row of pages (page_id, url); rules has rule and action.

    rule is the most specific rule that covers the URL and n_rules how many
    do; without one, rule is null and action "none". A URL without scheme or
    host, and a null one, has a null key and no rule. Of rules with one and
    the same prefix, one counts: a block before any other, then the first by
    action, then by rule. Rules that are null, or have no host or action, cover
    nothing. Rows with null or repeated ids are judged each for itself; other
    columns may have any name. Empty tables are allowed on either side.
    """
    spark = pages.sparkSession
    ship(spark)
    scratch, parts = Scratch(spark), partitions(spark)
    urls = pages.select(F.col("page_id").cast("long").alias("id"), url_key(F.col("url").cast("string")).alias("key"))
    placed = scratch.save(urls.where("key is not null").repartitionByRange(parts, "key", "id").withColumn("pid", F.spark_partition_id()))
    bounds = placed.groupBy("pid").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    prefixes = rules.select(F.col("rule").cast("string").alias("rule"), F.col("action").cast("string").alias("action")).withColumn("key", rule_prefix(F.col("rule"))).where("key is not null and action is not null")
    one = prefixes.groupBy("key").agg(F.min(F.struct((F.col("action") != "block").alias("o"), "action", "rule")).alias("r")).select("key", "r.rule", "r.action")
    there = one.join(F.broadcast(bounds), (F.col("key") <= F.col("hi")) & ((F.col("key") >= F.col("lo")) | F.startswith("lo", "key")))  # bounds: a row per partition
    events = placed.selectExpr("pid", "key", "1 kind", "id", "cast(null as string) rule", "cast(null as string) action").union(there.selectExpr("pid", "key", "0 kind", "cast(null as long) id", "rule", "action"))
    swept = events.repartitionById(parts, "pid").sortWithinPartitions("pid", "key", "kind").mapInArrow(_sweep, _OUT)
    return swept.union(urls.where("key is null").selectExpr("id page_id", "key", "cast(null as string) rule", "'none' action", "0 n_rules"))


def oracle_sql(rules: list[tuple[str, str]] | None = None) -> str:
    """The same, of a table pages, for DuckDB."""
    values = ", ".join(f"('{r}', '{a}')" for r, a in (RULES if rules is None else rules))
    return rf"""
with given(rule, action) as (values {values}),
prefixes as (
  select list_aggregate(list_reverse(string_split(rtrim(lower(split_part(rule, '/', 1)), '.'), '.')), 'string_agg', '.') || '.' || substr(rule, length(split_part(rule, '/', 1)) + 1) as prefix, rule, action
  from given),
rules as (select prefix, arg_min(rule, case when action = 'block' then '0' else '1' end || action || rule) as rule, arg_min(action, case when action = 'block' then '0' else '1' end || action || rule) as action from prefixes group by prefix),
parsed as (
  select page_id, rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '.') as host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) as path from pages),
keys as (
  select page_id, case when host <> '' then list_aggregate(list_reverse(string_split(host, '.')), 'string_agg', '.') || '.' || case when starts_with(path, '/') then path else '/' || path end end as key from parsed)
select k.page_id, k.key, arg_max(r.rule, length(r.prefix)) as rule, coalesce(arg_max(r.action, length(r.prefix)), 'none') as action, cast(count(r.rule) as int) as n_rules
from (select *, row_number() over () as row_no from keys) k left join rules r on starts_with(k.key, r.prefix) group by k.row_no, k.page_id, k.key
"""
