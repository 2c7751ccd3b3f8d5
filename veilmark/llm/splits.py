"""Problem 7: splits that keep related records together.

Relations become components by iterated DataFrame joins (least label through shared keys, with shortcuts). The assignment
is a component swap search: from a hashed assignment, whole components are moved or exchanged to bring sizes and labels
of the splits to the given proportions. Annealing chains run in parallel over blocks of a bounded number of components,
every component in one; the best chain of each block is kept. Where a manifest has several blocks, its largest components
are searched once more against what all the others weigh. The search gives every site its component, the lists it was
given in and its new list; where the given lists of a component differ, they break it.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilmark.llm.common import records
from veilmark.session import checkpointed, table

LISTS = ("target_member_site_ids", "target_nonmember_site_ids", "shadow_auxiliary_site_ids", "public_candidate_site_ids")
# What stands for "no owner" or "no contact", in letters and digits without case.
NOBODY = (
    "", "none", "null", "nil", "na", "nan", "unknown", "ctunknown", "unnamed", "anonymous", "private", "privacy", "hidden", "undisclosed", "redacted",
    "redactedforprivacy", "redactedforgdpr", "dataredacted", "gdprmasked", "gdprredacted", "whoisprivacy", "whoisguard", "privacyprotected", "privacyservice",
    "domainprivacy", "domainsbyproxy", "contactprivacy", "privateregistration", "registrationprivate", "notavailable", "notapplicable", "notdisclosed",
    "notprovided", "nodata", "tbd", "ctnone", "ctna", "ctprivate", "ctredacted",
)
CHAINS, STEPS_PER_COMPONENT = 4, 40
#: Components of a block of the search (about), and sites of a component that meet in one task.
BLOCK_COMPONENTS, BLOCK_SITES = 2000, 1000


def plain_name(column: str) -> Column:
    """Letters and digits without case, or null when the value names nobody. However a name is written, its words,
    the legal form among them, make it; names with other words are other names."""
    plain = F.regexp_replace(F.lower(F.col(column)), r"[^\p{L}\p{N}]+", "")
    return F.when(~plain.isin(*NOBODY) & ~F.lower(F.col(column)).rlike(r"redacted|privacy|whois"), plain)


def domain(column: str) -> Column:
    """The last two labels of a host, without case, port, white space and end dot; null for fewer than two labels."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.col(column))), r"^[a-z][a-z0-9+.-]*://|[/?#].*$", ""), r":\d*$|\.+$", "")
    return F.regexp_extract(host, r"([^.\s]+\.[^.\s]+)$", 1)


def relations(sites: DataFrame) -> DataFrame:
    """(site_id, key): what a site is related through, only keys that more than one site has."""
    keys = F.array(F.concat(F.lit("o:"), plain_name("owner_name")), F.concat(F.lit("c:"), plain_name("contact_id")), F.when(domain("host") != "", F.concat(F.lit("h:"), domain("host"))))
    all_keys = sites.where("site_id IS NOT NULL").select("site_id", F.explode(keys).alias("key")).where("key IS NOT NULL").distinct()
    shared = all_keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return all_keys.join(shared, "key")


def components(memberships: DataFrame) -> DataFrame:
    """(site_id, component) for all sites that share a key with another; the component is its least site.

    memberships: site_id, key. Each round takes the least label over a key (pre-aggregated, so a key of a third of all
    sites is no hot group), then over a site's keys, then the label's own label; rounds grow with the logarithm of the
    longest chain. Only the number of changed labels comes to the driver.
    """
    memberships = checkpointed(memberships)
    labels = memberships.select("site_id", F.col("site_id").alias("component")).distinct()
    while True:
        of_key = memberships.join(labels, "site_id").groupBy("key").agg(F.min("component").alias("least"))
        of_site = memberships.join(of_key, "key").groupBy("site_id").agg(F.min("least").alias("least"))
        shortcut = of_site.select(F.col("site_id").alias("least"), F.col("least").alias("further"))
        new = checkpointed(
            labels.join(of_site, "site_id").join(shortcut, "least", "left").select("site_id", F.col("component").alias("old"), F.least("least", F.coalesce("further", "least"), "component").alias("component"))
        )
        labels = new.drop("old")
        if new.where("old <> component").isEmpty():
            return labels


def roles(manifests: DataFrame) -> DataFrame:
    """(manifest_id, list, site_id), distinct and without nulls."""
    lists = F.explode(F.array(*[F.struct(F.lit(n).alias("list"), F.col(n).alias("ids")) for n in LISTS])).alias("x")
    return manifests.where("manifest_id IS NOT NULL").select("manifest_id", lists).select("manifest_id", "x.list", F.explode("x.ids").alias("site_id")).where("site_id IS NOT NULL").distinct()


def anneal(sizes: list[int], labels: list[int], proportions: list[float], base: list[tuple[int, int]], start: list[int], seed: int) -> tuple[float, list[int]]:
    """One annealing chain over whole components; returns the least deviation and its assignment."""
    rng = random.Random(seed)
    k, n = len(proportions), len(sizes)
    size = [b[0] for b in base]
    label = [b[1] for b in base]
    for c, s in enumerate(start):
        size[s] += sizes[c]
        label[s] += labels[c]
    all_size, all_label = max(1, sum(size)), max(1, sum(label))

    def part(s: int) -> float:
        return abs(size[s] / all_size - proportions[s]) + 0.5 * abs(label[s] / all_label - proportions[s])

    def put(c: int, s: int, sign: int) -> None:
        size[s] += sign * sizes[c]
        label[s] += sign * labels[c]

    now = list(start)
    cost = sum(map(part, range(k)))
    best, kept = cost, list(now)
    steps = STEPS_PER_COMPONENT * n if n and k > 1 else 0
    for step in range(steps):
        heat = 0.2 * (1 - step / steps) ** 2 + 1e-9
        a = rng.randrange(n)
        b = rng.randrange(n) if rng.random() < 0.5 else -1
        sa = now[a]
        sb = now[b] if b >= 0 else rng.randrange(k)
        if sa == sb:
            continue
        before = part(sa) + part(sb)
        put(a, sa, -1), put(a, sb, 1)
        if b >= 0:
            put(b, sb, -1), put(b, sa, 1)
        change = part(sa) + part(sb) - before
        if change <= 0 or rng.random() < math.exp(-change / heat):
            cost += change
            now[a] = sb
            if b >= 0:
                now[b] = sa
            if cost < best - 1e-12:
                best, kept = cost, list(now)
        else:
            put(a, sb, -1), put(a, sa, 1)
            if b >= 0:
                put(b, sa, -1), put(b, sb, 1)
    return best, kept


def _chains(blocks: DataFrame) -> DataFrame:
    """(manifest_id, component, place) of the best chain of each block.

    blocks: manifest_id, block, shares, parts (components with their places), base (what stays: place, n, labels; or null).
    """
    chains = blocks.select("*", F.explode(F.sequence(F.lit(1), F.lit(CHAINS))).alias("seed")).repartition("manifest_id", "block", "seed")

    def run(batches):
        import pandas as pd

        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                parts = sorted(r.parts, key=lambda c: c["component"])
                base = [(0, 0)] * len(r.shares)
                for b in r.base if r.base is not None else ():
                    base[b["place"]] = (b["n"], b["labels"])
                cost, kept = anneal([c["n"] for c in parts], [c["labels"] for c in parts], [s["share"] for s in r.shares], base, [c["place"] for c in parts], r.seed)
                out.append((r.manifest_id, r.block, r.seed, cost, [{"component": c["component"], "place": s} for c, s in zip(parts, kept)]))
            yield pd.DataFrame(out, columns=["manifest_id", "block", "seed", "deviation", "found"])

    found = chains.mapInPandas(run, "manifest_id bigint, block int, seed int, deviation double, found array<struct<component: string, place: int>>")
    best = found.groupBy("manifest_id", "block").agg(F.min_by("found", F.struct("deviation", "seed")).alias("found"))
    return best.select("manifest_id", F.inline("found"))


def assigned(members: DataFrame, related: DataFrame, proportions: DataFrame) -> DataFrame:
    """members with ``component``, ``list`` and the manifest's ``deviation``: every member in one list, related members in
    the same one.

    members: manifest_id, site_id, label (0 or 1), more columns; related: site_id, component; proportions: manifest_id,
    list, share. Deviation: sum over lists of |share of members - proportion| + half of the same for the labels. A
    manifest without proportions gets no rows, as does an empty table.
    """
    rows = members.join(related, "site_id", "left").withColumn("component", F.coalesce("component", "site_id"))
    groups = rows.groupBy("manifest_id", "component").agg(F.count("*").alias("n"), F.sum("label").alias("labels"))
    totals = groups.groupBy("manifest_id").agg(F.ceil(F.count("*") / BLOCK_COMPONENTS).cast("int").alias("blocks"))
    shares = proportions.groupBy("manifest_id").agg(F.sort_array(F.collect_list(F.struct("list", "share"))).alias("shares"))  # a few lists
    unit = F.pmod(F.xxhash64("manifest_id", "component"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    cumulative = F.transform("shares", lambda x, i: F.aggregate(F.slice("shares", 1, i + 1), F.lit(0.0), lambda s, y: s + y["share"]))
    groups = checkpointed(
        groups.join(totals.join(shares, "manifest_id"), "manifest_id")
        .withColumn("place", F.least(F.size(F.filter(cumulative, lambda c: c <= unit)), F.size("shares") - 1))
        .withColumn("block", F.pmod(F.xxhash64("component", F.lit("block")), "blocks").cast("int"))
    )
    part = F.struct("component", "n", "labels", "place")
    in_blocks = groups.groupBy("manifest_id", "block").agg(F.first("shares").alias("shares"), F.collect_list(part).alias("parts")).withColumn("base", F.lit(None).cast("array<struct<place: int, n: bigint, labels: bigint>>"))
    placed = checkpointed(groups.drop("place").join(_chains(in_blocks), ["manifest_id", "component"]))
    # the largest components of manifests of several blocks, against the others where they are now
    largest = Window.partitionBy("manifest_id").orderBy(F.desc("n"), "component")
    many = placed.where("blocks > 1").withColumn("rank", F.row_number().over(largest))
    top = many.where(F.col("rank") <= BLOCK_COMPONENTS).drop("rank")
    rest = placed.where("blocks > 1").join(top.select("manifest_id", "component"), ["manifest_id", "component"], "left_anti").groupBy("manifest_id", "place").agg(F.sum("n").alias("n"), F.sum("labels").alias("labels"))
    base = rest.groupBy("manifest_id").agg(F.collect_list(F.struct("place", "n", "labels")).alias("base"))
    again = top.groupBy("manifest_id").agg(F.first("shares").alias("shares"), F.collect_list(part).alias("parts")).join(base, "manifest_id", "left").withColumn("block", F.lit(0))
    moved = _chains(again).withColumnRenamed("place", "moved")
    final = placed.join(moved, ["manifest_id", "component"], "left").select("manifest_id", "component", "n", "labels", "shares", F.coalesce("moved", "place").alias("place"))
    final = checkpointed(final.withColumn("list", F.expr("shares[place].list")))
    sums = final.groupBy("manifest_id", "list").agg(F.sum("n").alias("n"), F.sum("labels").alias("labels"))
    whole = sums.groupBy("manifest_id").agg(F.sum("n").alias("all_n"), F.greatest(F.sum("labels"), F.lit(1)).alias("all_labels"))
    parts = proportions.join(whole, "manifest_id").join(sums, ["manifest_id", "list"], "left").fillna({"n": 0, "labels": 0})
    off = F.abs(F.col("n") / F.col("all_n") - F.col("share")) + 0.5 * F.abs(F.col("labels") / F.col("all_labels") - F.col("share"))
    deviation = parts.groupBy("manifest_id").agg(F.sum(off).alias("deviation"))
    return rows.join(final.select("manifest_id", "component", "list").join(deviation, "manifest_id"), ["manifest_id", "component"])


def searched(manifests: DataFrame, sites: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(manifest_id, site_id, given, component, list, deviation): every site of a manifest's four lists with the lists it
    was given in, its component and its new list, in the sizes given.

    labels: site_id, label (0 or 1); the share of label 1 is held even too. Null ids are left out, repeated rows are one.
    """
    given = checkpointed(roles(manifests))
    members = given.groupBy("manifest_id", "site_id").agg(F.sort_array(F.collect_list("list")).alias("given"))  # at most four
    members = members.join(labels, "site_id", "left").fillna({"label": 0}) if labels is not None else members.withColumn("label", F.lit(0))
    sizes = given.groupBy("manifest_id", "list").agg(F.count("*").alias("n"))
    whole = given.groupBy("manifest_id").agg(F.count("*").alias("all"))
    proportions = sizes.join(whole, "manifest_id").select("manifest_id", "list", (F.col("n") / F.col("all")).alias("share"))
    return assigned(members, components(relations(sites)), proportions).select("manifest_id", "site_id", "given", "component", "list", "deviation")


def broken(manifests: DataFrame, sites: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(manifest_id, site_a, site_b): related sites in different given lists, from the search. A site in two lists itself
    is no pair. The sites of a large component meet in blocks, so no task holds it whole."""
    found = checkpointed(searched(manifests, sites, labels))
    sizes = found.groupBy("manifest_id", "component").agg(F.count("*").alias("n"), F.min("given").alias("g0"), F.max("given").alias("g1"), F.max(F.size("given")).alias("lists"))
    sizes = sizes.where("n > 1 AND (g0 <> g1 OR lists > 1)").select("manifest_id", "component", F.ceil(F.col("n") / BLOCK_SITES).cast("int").alias("blocks"))
    placed = found.join(sizes, ["manifest_id", "component"])
    block = F.pmod(F.xxhash64("site_id"), "blocks").cast("int")
    a = placed.select("manifest_id", "component", F.col("given").alias("ga"), F.col("site_id").alias("site_a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    b = placed.select("manifest_id", "component", F.col("given").alias("gb"), F.col("site_id").alias("site_b"), block.alias("block"))
    apart = (F.size("ga") > 1) | (F.size("gb") > 1) | (F.col("ga") != F.col("gb"))
    return a.join(b, ["manifest_id", "component", "block"]).where((F.col("site_a") < F.col("site_b")) & apart).select("manifest_id", "site_a", "site_b")


def _large_sites(spark: SparkSession, folder: str) -> DataFrame:
    """(site_id, label): whether a site has at least 10 records."""
    return records(spark, folder, "site_id").where("site_id IS NOT NULL").distinct().groupBy("site_id").agg((F.count("*") >= 10).cast("int").alias("label"))


def broken_lists(spark: SparkSession, folder: str) -> DataFrame:
    """p7_found: related sites in different lists of a manifest."""
    return broken(table(spark, folder, "manifests"), table(spark, folder, "sites"), _large_sites(spark, folder))


def assignment(spark: SparkSession, folder: str) -> DataFrame:
    """p7_assignment: the four lists of every manifest anew, in the sizes given, with related sites together. The label
    held even is whether a site has at least 10 records."""
    return searched(table(spark, folder, "manifests"), table(spark, folder, "sites"), _large_sites(spark, folder)).select("manifest_id", "site_id", "list", "deviation")
