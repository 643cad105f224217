"""URL filters: host and path rules, and a path-template tree.

Rules name a host and a path; a rule fits its host and all subdomains where the
path starts with the rule's, and the longest that fits gives the verdict.

Other pages get the verdict of their template.  Every host has a tree of path
segments, whose numbers and long hexadecimal strings are classes from the start.
Level by level, segments that are variable (a node has more than
``MANY_CHILDREN`` and the segment less than ``RARE_SHARE`` of its pages) become
a wildcard; so a node has 21 branches at most.  Then branches merge whose smoothed
shares of bad labels, (bad + PRIOR_WEIGHT * PRIOR_BAD) / (bad + good + PRIOR_WEIGHT), no
test of two shares tells apart: nearest first, clusters by their pooled counts, and
never branches that differ themselves.  A branch without labels counts as the prior
says, which keeps it apart from one with many bad ones.  What remains of each path is a template; its purity is its smoothed share of bad
labels, and a template of purity ``REJECT`` or more is blocked.  Labels are the
pages for which a rule decides: block counts as bad, allow as good.

In templates ``?n`` and ``?x`` stand for numbers and hexadecimal strings, ``?*`` for
variable segments and ``?1``, ``?2`` ... for merged branches; no segment of a path
holds a question mark.

The tree is built from distinct (host, class path) rows with counts, which are
aggregated before the shuffle, so a hot host is a set of small counts; parents
meet children in equi-joins, which Spark can split; pages find their template by
a broadcast only where the table of class paths has ``BROADCAST_ROWS`` rows and
``BROADCAST_BYTES`` bytes or fewer, and by an equi-join beyond.  Segments are
whole and paths of any depth.  Segments that all paths of a node share join the
template at once, as does the rest of a path that is alone, so rounds are as many as
the partings on a path.

Rules up to ``MAX_RULES`` are one expression; more are a table that distinct hosts
and paths meet by the host's suffixes.

Edge cases: a null url, or one without ``://``, has an empty host and path and so
the template of those; empty segments are left out; ids may be null or repeat; an
empty table gives no rows; an id column that is named as a result raises an error.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

MANY_CHILDREN = 16
RARE_SHARE = 0.05
#: 95th percentile of chi-square with one degree of freedom.
ALIKE = 3.841
PRIOR_WEIGHT = 4.0
PRIOR_BAD = 0.1
REJECT = 0.5
MAX_RULES = 500
BROADCAST_ROWS = 50_000
#: Bytes of hosts, class paths and templates that a broadcast holds at most.
BROADCAST_BYTES = 16 << 20


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    none = F.lit("")
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), none), F.coalesce(path, none)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def with_rules(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` (host, path and others) with rule and ruled."""
    if len(rules) <= MAX_RULES:
        rule, ruled = longest_rule(F.col("host"), F.col("path"), rules)
        return rows.withColumns({"rule": rule, "ruled": ruled})
    table = rows.sparkSession.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in rules], "at string, start string, rule string, ruled string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = rows.select("host", "path").distinct().withColumn("at", F.explode(suffixes)).join(table, "at").filter(F.col("path").startswith(F.col("start")))
    best = asked.groupBy("host", "path").agg(F.max_by(F.struct("rule", "ruled"), F.struct(F.length("rule"), F.col("rule"))).alias("best"))
    return rows.join(best.select("host", "path", "best.*"), ["host", "path"], "left")


def class_path(path: Column) -> Column:
    """Segments with numbers and hexadecimal strings as classes, joined by /."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    classed = F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"(?i)\b(?=[0-9a-f-]*\d)[0-9a-f-]{8,}\b", "?x"), r"\d+", "?n"))
    return F.array_join(classed, "/")


def apart(bad0: float, n0: float, bad1: float, n1: float) -> float:
    """How far two shares of bad labels differ, as chi-square with one degree of
    freedom.  Without labels a branch counts as its prior says, for it is not known
    to be like one with many bad ones; with some, only these count."""
    bad0, n0 = (bad0, n0) if n0 else (PRIOR_WEIGHT * PRIOR_BAD, PRIOR_WEIGHT)
    bad1, n1 = (bad1, n1) if n1 else (PRIOR_WEIGHT * PRIOR_BAD, PRIOR_WEIGHT)
    both = (bad0 + bad1) / (n0 + n1)
    spread = both * (1 - both) * (1 / n0 + 1 / n1)
    return (bad0 / n0 - bad1 / n1) ** 2 / spread if spread > 0 else 0.0


def merge_branches(bad: list[int], good: list[int]) -> list[int]:
    """A cluster number, from 1, for each branch of a node.

    Branches are clusters of their own first, in order of share; the two neighbours that are
    least far apart merge, again and again, as long as a test of their pooled shares and one of each pair of
    their branches stay below ``ALIKE``.  So no chain of neighbours joins branches
    that differ.  Numbers follow shares, then places.
    """
    share = [(b + PRIOR_WEIGHT * PRIOR_BAD) / (b + g + PRIOR_WEIGHT) for b, g in zip(bad, good)]
    order = sorted(range(len(bad)), key=lambda i: (share[i], i))
    n = [b + g for b, g in zip(bad, good)]
    clusters = [[i] for i in order]

    def distance(x: list[int], y: list[int]) -> float:
        pooled = apart(sum(bad[i] for i in x), sum(n[i] for i in x), sum(bad[i] for i in y), sum(n[i] for i in y))
        return max(pooled, *[apart(bad[i], n[i], bad[j], n[j]) for i in x for j in y])

    while len(clusters) > 1:
        # Only clusters that are next to each other by share merge.
        gaps = [distance(x, y) for x, y in zip(clusters, clusters[1:])]
        at = gaps.index(min(gaps))
        if gaps[at] > ALIKE:
            break
        clusters[at : at + 2] = [clusters[at] + clusters[at + 1]]
    out = [0] * len(bad)
    for k, c in enumerate(clusters, 1):
        for i in c:
            out[i] = k
    return out


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes (host, template, branches) as rows (host, template, name, name2)."""
    for b in batches:
        hosts, tops, names, ends = [], [], [], []
        for host, top, branches in zip(*(c.to_pylist() for c in b.columns)):
            number = merge_branches([x["bad"] for x in branches], [x["good"] for x in branches])
            hosts += [host] * len(branches)
            tops += [top] * len(branches)
            names += [x["name"] for x in branches]
            ends += [f"?{k}" if number.count(k) > 1 else x["name"] for k, x in zip(number, branches)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (hosts, tops, names, ends)], names=["host", "template", "name", "name2"])


def templates(paths: DataFrame) -> DataFrame:
    """``paths`` (host, classes, n, bad, good) with template and purity.

    A round takes every node past the segments that all of its paths share, and past
    the next one, where they part; rounds are as many as a path has partings.
    """
    left = F.filter(F.split("classes", "/"), lambda s: s != "")
    tree = written(paths.withColumns({"template": F.lit(""), "left": left}), "url-level")
    done = []
    while True:
        done.append(tree.filter(F.size("left") == 0).drop("left"))
        tree = tree.filter(F.size("left") > 0)
        if tree.isEmpty():
            break
        # What the first and the last of a node's paths share, all of them share.
        ends = tree.groupBy("host", "template").agg(F.min("left").alias("lo"), F.max("left").alias("hi"))
        same = F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b))
        ends = ends.select("host", "template", F.coalesce(F.array_position(same, F.lit(False)).cast("int") - 1, F.lit(-1)).alias("k"), F.size("lo").alias("most"))
        ends = ends.select("host", "template", F.when(F.col("k") < 0, F.col("most")).otherwise(F.col("k")).alias("k"))
        tree = tree.join(ends, ["host", "template"])
        shared = F.when(F.col("k") > 0, F.concat_ws("/", "template", F.array_join(F.slice("left", F.lit(1), F.col("k")), "/"))).otherwise(F.col("template"))
        tree = tree.withColumns({"template": shared, "left": F.slice("left", F.col("k") + 1, F.size("left"))}).drop("k")
        done.append(tree.filter(F.size("left") == 0).drop("left"))
        tree = written(tree.filter(F.size("left") > 0).withColumn("seg", F.get("left", F.lit(0))), "url-level")
        child = tree.groupBy("host", "template", "seg").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")])
        count = child.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("kinds"))
        rare = (F.col("kinds") > MANY_CHILDREN) & (F.col("n") < RARE_SHARE * F.col("all_n"))
        named = child.join(count, ["host", "template"]).withColumn("name", F.when(rare, "?*").otherwise(F.col("seg")))
        branch = named.groupBy("host", "template", "name").agg(*[F.sum(c).alias(c) for c in ("bad", "good")])
        # A node has 21 branches at most.
        nodes = branch.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("name", "bad", "good"))).alias("branches"))
        merged = nodes.mapInArrow(_merged, "host string, template string, name string, name2 string")
        # A node's branch name follows from its segment: segment -> name -> name2.
        step = named.select("host", "template", "seg", "name").join(merged, ["host", "template", "name"]).drop("name")
        met = tree.join(step, ["host", "template", "seg"])
        met = met.withColumn("template", F.concat_ws("/", "template", "name2"))
        tree = written(met.withColumn("left", F.slice("left", F.lit(2), F.size("left"))).drop("seg", "name2"), "url-level")
    tree = written(reduce(DataFrame.unionByName, done), "url-templates")
    pure = tree.groupBy("host", "template").agg(F.sum("bad").alias("b"), F.sum("good").alias("g"))
    purity = (F.col("b") + PRIOR_WEIGHT * PRIOR_BAD) / (F.col("b") + F.col("g") + PRIOR_WEIGHT)
    return tree.join(pure.select("host", "template", purity.alias("purity")), ["host", "template"]).select("host", "classes", "template", "purity")


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity."""
    if id_col in ("host", "path", "rule", "verdict", "template", "purity", "ruled", "classes"):
        raise ValueError(f"the id column {id_col!r} has the name of a result")
    host, path = host_and_path(F.col(url_col))
    rows = with_rules(pages.select(F.col(id_col), host.alias("host"), path.alias("path")), rules)
    rows = rows.select(id_col, "host", "path", "rule", "ruled", class_path(F.col("path")).alias("classes"))
    counts = rows.groupBy("host", "classes").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "block").alias("bad"), F.count_if(F.col("ruled") == "allow").alias("good")
    )
    counts = written(counts, "url-paths")
    found = templates(counts)
    # A template has one character more than its class path at most.
    held = counts.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("host") + 2 * F.octet_length("classes") + 1).alias("bytes")).first()
    if held["rows"] <= BROADCAST_ROWS and (held["bytes"] or 0) <= BROADCAST_BYTES:
        found = F.broadcast(found)
    judged = rows.join(found, ["host", "classes"], "left")
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return judged.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
