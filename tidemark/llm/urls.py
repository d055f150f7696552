"""URL filters as a temporal list join, in DataFrame operations only.

Filter lists change over time. Each dated entry (domain, list, action `add` or `remove`, date) becomes a
validity interval: from its own date to the date of the next entry for the same domain and list. A capture
is judged by the entries that were active when it was fetched, for its host and every parent domain; the
longest matching domain wins, then an `allow` list over others, then the list's name.

The list side has one row per domain (all its intervals in an array), so a host with a third of all captures
meets one row; captures of one host are dealt out by SALTS numbers, each of which has a copy of that row. The
list is broadcast only if Spark's own size check allows it.

Null or malformed URLs have a null host and are kept, as are captures without a fetch time; hosts are
compared in lower case, without port, user and trailing dot. An empty list keeps everything. Entries with a
null domain, list, action or date are ignored; repeated entries count once; of several entries for the same
domain, list and date `remove` wins. Columns of captures
pass through, but one named like a result column gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import fresh


#: Shares into which each host's captures are dealt.
SALTS = 16


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL, or null."""
    raw = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.regexp_replace(F.lower(raw), r"\.+$", "")
    return F.when(host != "", host)


def domains_of(host: Column) -> Column:
    """The host and all its parent domains, down to the last label, longest first."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """domain, list, valid_from and valid_to (null: open) of dated entries (domain, list, action, date)."""
    known = entries.select(F.lower("domain").alias("domain"), F.col("list").alias("list"), F.lower("action").alias("action"), F.col("date").cast("date").alias("date")).dropna()
    days = known.groupBy("domain", "list", "date").agg(F.max("action").alias("action"))  # remove sorts after add
    w = Window.partitionBy("domain", "list").orderBy("date")
    return days.withColumn("valid_to", F.lead("date").over(w)).filter(F.col("action") == "add").select("domain", "list", F.col("date").alias("valid_from"), "valid_to")


def by_domain(entries: DataFrame) -> DataFrame:
    """domain and the sorted array of its intervals."""
    return intervals(entries).groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("list", "valid_from", "valid_to"))).alias("spans"))


def host_spans(hosts: DataFrame, entries: DataFrame) -> DataFrame:
    """One row for each distinct host that any entry ever named: its candidate spans (rank 0: the host itself)."""
    cand = hosts.select("host").filter(F.col("host").isNotNull()).distinct().select("host", F.posexplode(domains_of(F.col("host"))).alias("rank", "domain"))
    flat = F.transform("spans", lambda s: F.struct(F.col("rank").alias("rank"), F.col("domain").alias("domain"), s["list"].alias("list"), s.valid_from.alias("valid_from"), s.valid_to.alias("valid_to")))
    found = cand.join(by_domain(entries), "domain").withColumn("flat", flat)
    return found.groupBy("host").agg(F.flatten(F.collect_list("flat")).alias("spans"))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """The captures with host, matched_domain, matched_list (both null: no active entry) and blocked.

    Entries meet the distinct hosts first, so that captures take part in one equi-join on the host; the as-of
    choice is then made within the row, from the spans of that host.
    """
    _h, _s, _b, _n = fresh(captures, "_host", "_spans", "_best", "_salt")
    rows = captures.withColumn(_h, host_of(F.col(url))).withColumn(_n, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    spans = host_spans(rows.select(F.col(_h).alias("host")), entries)
    spans = spans.select(F.col("host").alias(_h), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(_n), F.col("spans").alias(_s))
    day = F.col(fetched).cast("date")
    active = F.filter(_s, lambda s: (s.valid_from <= day) & (s.valid_to.isNull() | (day < s.valid_to)))
    ranked = F.transform(active, lambda s: F.struct(s["rank"].alias("rank"), (s["list"] != "allow").alias("other"), s["list"].alias("list"), s["domain"].alias("domain")))
    # captures without a host have nothing to be joined with, and would all meet on one key
    joined = rows.filter(F.col(_h).isNotNull()).join(spans, [_h, _n], "left")
    out = joined.unionByName(rows.filter(F.col(_h).isNull()), allowMissingColumns=True).withColumn(_b, F.array_min(ranked))
    listed = F.col(_b)["list"]
    made = {"host": F.col(_h), "matched_domain": F.col(_b)["domain"], "matched_list": listed, "blocked": F.coalesce(listed != "allow", F.lit(False))}
    return out.select(*[F.col(f"`{c}`") for c in captures.columns if c not in made], *[v.alias(k) for k, v in made.items()])
