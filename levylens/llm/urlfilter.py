"""URL rules by a sort-merge range join.

A rule (host, path) fits its host and all subdomains when the URL's path starts with the rule's.
The canonical key of a host level is its labels in reverse order followed by the path, so a rule is
the interval of all keys that start with its own key. A URL has one key per level of its host (for
a.b.org: those of org, b.org and a.b.org), and rules of one level are nested or disjoint.

URL keys and the ends of the intervals are sorted together. The sweep carries a stack: a rule's
start puts it on top of the rules that contain it, its end takes it off again, so a URL key sees
the nested rules active at its place, the longest on top. A URL then takes the longest rule over
its levels. Sweeps run side by side over shares of the rows dealt by a hash of the URL, each with
all interval ends, so that a host with most of the rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
_ENDS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, HOST, 1), *_ENDS), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    """Bytes that sort levels and then paths; 0x00 and 0x01 keep labels and path apart."""
    host = F.array_join(labels, "\x01")
    return F.encode(F.concat(host, F.lit("\x01\x00"), path), "UTF-8")


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def interval_ends(rules: DataFrame) -> DataFrame:
    """(key, kind, stack): at each start (kind 0) the rules that contain the rule, itself on top;
    at each end (kind 2) the rest of them."""
    own = rules.select("host", "path", "action").filter("host is not null and path is not null")
    own = own.withColumn("host", F.translate("host", *_ENDS)).filter("action is not null")
    own = own.groupBy("host", "path").agg(F.max("action").alias("action"))
    spans = F.sequence(F.lit(0), F.length("path"))
    above = own.select(
        F.col("host"), F.col("path").alias("inner"), F.explode(spans).alias("n")
    ).select("host", "inner", F.substring("inner", F.lit(1), F.col("n")).alias("path"))
    entry = F.struct(
        F.length("path").alias("n"), F.concat("host", "path").alias("rule"), F.col("action")
    )
    stacks = above.join(own, ["host", "path"]).groupBy("host", "inner")
    stacks = stacks.agg(F.sort_array(F.collect_list(entry), asc=False).alias("stack"))
    key = _key(_reversed(F.col("host")), F.col("inner"))
    rest = F.slice("stack", F.lit(2), F.size("stack"))
    ends = F.array(
        F.struct(key.alias("key"), F.lit(0).alias("kind"), F.col("stack").alias("stack")),
        F.struct(
            F.concat(key, F.lit(bytearray([255]))).alias("key"),
            F.lit(2).alias("kind"),
            rest.alias("stack"),
        ),
    )
    return stacks.select(F.inline(ends))


def judged(
    pages: DataFrame,
    rules: DataFrame,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
    shares: int | None = None,
) -> DataFrame:
    """(id, url, host, path, rule, verdict), one row per row of `pages`.

    `rules` has host, path and action (allow or block). The longest rule that fits decides: by the
    length of host and path together, then of the host. Where host and path are listed with both
    actions, block counts. Rules with a null take no part. Without a fitting rule `rule` is null
    and the verdict is `default`. A null URL and one without :// have empty host and path and fit
    no rule. Repeated rows stay. Other columns of `pages` are not read. `shares` is the number of
    sweeps, by default four for each shuffle partition; the rules are sent to each.
    """
    spark = pages.sparkSession
    shares = shares or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"))
    urls = urls.withColumn("share", F.pmod(F.xxhash64("id", "url"), F.lit(shares)).cast("int"))
    labels = _reversed(host_of(F.col("url")))
    levels = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda n: _key(F.slice(labels, F.lit(1), n), path_of(F.col("url"))),
    )
    keys = urls.select("share", "id", "url", F.posexplode(levels).alias("level", "key"))
    keys = keys.withColumn("kind", F.lit(1))
    ends = interval_ends(rules).withColumn(
        "share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    )
    swept = keys.unionByName(ends, allowMissingColumns=True)
    here = Window.partitionBy("share").orderBy("key", "kind")
    here = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = swept.withColumn("active", F.last("stack", ignorenulls=True).over(here))
    found = F.try_element_at("active", F.lit(1))
    best = F.struct(
        F.length(found["rule"]).alias("n"), F.col("level"), found["rule"].alias("rule"),
        found["action"].alias("action"),
    )
    out = swept.filter("kind = 1").groupBy("share", "id", "url")
    out = out.agg(
        F.max(F.when(found.isNotNull(), best)).alias("best"),
        F.count_if(F.col("level") == 0).alias("copies"),
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(
        F.col("id").alias(id_col),
        F.col("url").alias(url_col),
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
