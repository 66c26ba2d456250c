"""URL rules by sort-merge range joins, in DataFrame functions alone.

A host is spelled by its labels in reverse, each followed by a separator below every other byte of a key
(``www.example.net`` becomes ``net|example|www|``), so a rule's host and all its subdomains are one interval of
keys.  With its path behind it, a rule is an interval of (host, path) keys in the same way.  Intervals of either kind
nest or are disjoint, so they open and close in key order like brackets.  Two sorted sweeps judge the pages:

1. Over host keys: each page gets the stack of rule hosts that it lies in, at most one for each of its labels.
2. Over (rule host, path) keys: a page stands there once for each host of its stack, and takes the innermost rule that is
   open, which is the longest of that host.  A closing rule leaves its enclosing one, so no list of rules is kept.

Of a page's hosts the one with the longest rule wins.  Each sweep runs apart for each group (top label, or rule host) and
slice: a group's rules are repeated in each of its slices, and the number of slices follows that group's pages, so a
host with a third of all pages is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm import storage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEP = "\x01"
MIN_SLICE_ROWS = 1_000
NO_RULE = "allow"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host lower-cased in A-Z, after the first ``://``; both empty where that or the url is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def host_key(host: Column) -> Column:
    """Reversed labels, each with a separator; a page's host inside a rule's has the rule's key as a prefix.

    A U+0001 or U+0002 of a label is spelled U+0002 and a letter, so a separator never stands inside a label.
    """
    safe = F.replace(F.replace(host, F.lit("\x02"), F.lit("\x02b")), F.lit(SEP), F.lit("\x02a"))
    return F.concat(F.concat_ws(SEP, F.reverse(F.split(safe, r"\."))), F.lit(SEP))


def _prefixes(key: Column) -> Column:
    """The keys of a host key's host and of all hosts above it."""
    labels = F.split(key, SEP)
    return F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.concat_ws(SEP, F.slice(labels, 1, n)), F.lit(SEP)))


def _start(key: Column) -> Column:
    return F.encode(key, "UTF-8")


def _end(key: Column) -> Column:
    """Above all keys that begin with ``key``, and below all others above it: no UTF-8 text holds the byte FF."""
    return F.concat(F.encode(key, "UTF-8"), F.lit(bytearray(b"\xff")))


def _swept(events: DataFrame, points: DataFrame, group: str, value: str) -> DataFrame:
    """``points`` (group, at, ...) with ``value`` of the last of ``events`` (group, at, value) at or before them.

    Points of a group without events fall out.  A group has as many slices as its points ask for, at ``MIN_SLICE_ROWS`` and
    four for each of its events at least.
    """
    load = events.groupBy(group).agg(F.count("*").alias("events")).join(points.groupBy(group).agg(F.count("*").alias("n")), group)
    slices = load.select(group, F.greatest(F.lit(1), F.ceil(F.col("n") / F.greatest(F.lit(MIN_SLICE_ROWS), 4 * F.col("events")))).cast("int").alias("slices"))
    # Written, so that Spark knows its size, and broadcasts it only if that is small; points are then dealt by slice, not by group.
    slices = storage.materialize(slices, "slices")
    opened = events.join(slices, group).select(group, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "at", F.lit(0).alias("kind"), value)
    dealt = points.join(slices, group).withColumns({"slice": F.pmod(F.xxhash64("row"), F.col("slices")).cast("int"), "kind": F.lit(1)}).drop("slices")
    order = Window.partitionBy(group, "slice").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = opened.unionByName(dealt, allowMissingColumns=True).repartition(group, "slice")
    return both.withColumn(value, F.last(value, ignorenulls=True).over(order)).where("kind = 1").drop("slice", "kind", "at")


def _host_events(keyed: DataFrame) -> DataFrame:
    """The opening and closing of each rule host, with the stack of rule hosts that are open after it."""
    hosts = keyed.select("key").distinct()
    above = hosts.select("key", F.explode(_prefixes(F.col("key"))).alias("above")).join(hosts.select(F.col("key").alias("above")), "above")
    stacks = above.groupBy("key").agg(F.collect_list("above").alias("stack"))
    closed = F.filter("stack", lambda k: k != F.col("key"))
    both = stacks.select("key", _start(F.col("key")).alias("at"), "stack").unionByName(stacks.select("key", _end(F.col("key")).alias("at"), closed.alias("stack")))
    return both.select(F.split("key", SEP)[0].alias("top"), "at", "stack")


def _path_events(keyed: DataFrame) -> DataFrame:
    """The opening and closing of each rule in its host's paths, with the rule that is innermost after it.

    One sweep in order of the paths counts how many rules are open.  Intervals of prefixes nest, so the rule around one
    that opens at depth d is the last one before it that opened at depth d - 1.
    """
    rules = keyed.groupBy("key", "path").agg(F.min(F.struct("action", "rule")).alias("rule"))
    named = rules.select("key", "path", F.struct(F.length("rule.rule").alias("n"), F.col("rule.rule").alias("rule"), F.col("rule.action").alias("action")).alias("judged"))
    marks = named.select("key", F.explode(F.array(F.struct(_start(F.col("path")).alias("at"), F.lit(1).alias("step"), "path", "judged"), F.struct(_end(F.col("path")).alias("at"), F.lit(-1).alias("step"), "path", "judged"))).alias("m")).select("key", "m.*")
    depth = F.sum("step").over(Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    opened = marks.withColumn("depth", depth).where("step = 1")
    # Each opening is seen at its own depth, and asks at the depth above it.
    levels = opened.select("key", "at", "path", "judged", F.explode(F.array(F.struct(F.col("depth").alias("level"), F.lit(0).alias("asks")), F.struct((F.col("depth") - 1).alias("level"), F.lit(1).alias("asks")))).alias("l")).select("key", "at", "path", "judged", "l.*")
    around = F.last(F.when(F.col("asks") == 0, F.col("judged")), ignorenulls=True).over(Window.partitionBy("key", "level").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    outer = levels.withColumn("outer", around).where("asks = 1")
    nothing = F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"))
    both = F.array(F.struct("at", "judged"), F.struct(_end(F.col("path")).alias("at"), F.coalesce("outer", nothing).alias("judged")))
    return outer.select("key", F.explode(both).alias("e")).select("key", "e.at", "e.judged")


def match_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge each page's url: page_id, host, path, rule, verdict.

    ``rules`` has host, path and action.  A rule fits its host and all subdomains where the url's path starts with the
    rule's; the longest host and path win, and equal rules resolve by action order.  No rule fits: rule null, verdict
    ``allow``.  A null url, or one without ``://``, has an empty host and path and fits no rule; repeated rows and null
    ids stay; an empty table of pages gives no row, one of rules leaves every page allowed; other columns are not read.
    Hosts and paths may hold any characters; a rule with a null host, path or action is none.
    """
    host, path = url_parts(storage.col(url_col))
    # Rows are numbered once, and written, so a task that runs again doesn't number them anew.
    numbered = pages.select(F.monotonically_increasing_id().alias("row"), storage.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = storage.materialize(numbered, "urls")
    whole = rules.select("host", "path", "action").where("host is not null and path is not null and action is not null")
    keyed = whole.select(host_key(F.translate(F.col("host"), UPPER, UPPER.lower())).alias("key"), "path", "action", F.concat("host", "path").alias("rule")).distinct()
    points = urls.select("row", "path", host_key(F.col("host")).alias("host_key"))
    points = points.select("row", "path", F.split("host_key", SEP)[0].alias("top"), _start(F.col("host_key")).alias("at"))
    inside = _swept(_host_events(keyed), points, "top", "stack").select("row", F.explode("stack").alias("key"), _start(F.col("path")).alias("at"))
    hits = _swept(_path_events(keyed), inside, "key", "judged").where("judged.rule is not null")
    # The longest rule of a page's hosts; equally long ones are one rule spelled in different ways, and go by their order.
    best = hits.groupBy("row").agg(F.max_by("judged", F.struct(F.col("judged.n").alias("n"), F.length("key").alias("k"))).alias("best"))
    judged = urls.join(best, "row", "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(NO_RULE)).alias("verdict"))
