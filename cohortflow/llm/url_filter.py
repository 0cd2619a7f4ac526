"""URL rules, and a verdict from the link graph for hosts that no rule judges.

Pages that a rule allows or blocks are the seeds. Trust starts from the allowed pages' hosts and follows links; distrust starts from the blocked pages' hosts and
goes against links, to those who link there. Both are personalised PageRanks of hosts, run side by side in Spark. A host whose distrust is above
its trust by the threshold is blocked. Edges are hyperlinks between hosts, weighted by linking pages, and, as subdomains share an owner, an edge each way
between a host and its parent domain.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, steady_session

#: Fixed values: (host, path, verdict). A rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DAMPING = 0.85
ROUNDS = 30
ROUNDS_A_TABLE = 5
KIN = 1.0  # weight of an edge between a host and its parent domain; a page that links counts 1
THRESHOLD = 0.5  # share of distrust in trust and distrust above which a host is blocked
EDGES_A_SALT = 100_000
URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
#: Comments and scripts are taken whole, so that links in them don't count.
LINK = r"""(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<a\s[^<>]*?\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def linked_hosts(html: Column) -> Column:
    """The different hosts that the anchors of a page name."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LINK), F.lit(1))
    return F.array_distinct(F.transform(F.filter(found, lambda h: h != ""), lambda h: F.translate(h, UPPER, LOWER)))


def suffixes(host: Column) -> Column:
    """The host and all domains above it, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, fitting: the rules that fit each host, longest first (a block before an allow of the same length)."""
    known = rules.select("rule_host", F.struct((-F.length(F.concat("rule_host", "rule_path"))).alias("length"), (F.col("verdict") == "allow").alias("allow"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_path").alias("path")).alias("fit"))
    named = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("rule_host"))
    return named.join(known, "rule_host").groupBy("host").agg(F.array_sort(F.collect_list("fit")).alias("fitting"))


def with_rule(pages: DataFrame, fitting: DataFrame) -> DataFrame:
    """pages (host, path) with rule and ruled: the longest rule that fits, and its verdict; null where none does."""
    first = F.get(F.filter("fitting", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    joined = pages.join(fitting, "host", "left").withColumn("first", first)
    return joined.withColumns({"rule": F.col("first.rule"), "ruled": F.when(F.col("first.allow"), "allow").when(~F.col("first.allow"), "block")}).drop("fitting", "first")


def host_edges(linked: DataFrame, hosts: DataFrame, kin: float = KIN) -> DataFrame:
    """src, dst, weight: links between different hosts by linking pages, and both ways between a host and its parent of two labels or more."""
    links = linked.select(F.col("host").alias("src"), F.explode("links").alias("dst")).where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    named = hosts.unionByName(links.select(F.col("dst").alias("host"))).where(~F.col("host").rlike(r"^[0-9.:]*$")).distinct()
    chain = named.select(suffixes(F.col("host")).alias("s")).where("size(s) > 2")
    kinship = chain.select(F.explode(F.expr("transform(sequence(1, size(s) - 2), i -> struct(s[i - 1] as low, s[i] as high))")).alias("e")).select("e.low", "e.high").distinct()
    up, down = kinship.select(F.col("low").alias("src"), F.col("high").alias("dst")), kinship.select(F.col("high").alias("src"), F.col("low").alias("dst"))
    return links.unionByName(up.unionByName(down).withColumn("weight", F.lit(float(kin)))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust: personalised PageRanks from seeds (host, trust, distrust), each scaled to the sum of its seeds.

    Trust follows edges, distrust goes against them. Rank that a host without edges can't pass on goes back to the seeds, which is what scaling at the
    end does. Edges and nodes stay dealt by the host that they leave, so a round shuffles ranks' sums only; if a hub has more than EDGES_A_SALT
    edges, they are dealt in parts of as many, and ranks go to all parts of their host. Every ROUNDS_A_TABLE rounds ranks are written.

    edges and seeds come from a steady session (and scratch reads in it), in which a table of rounds is one job: where plans are replanned as they
    run, each exchange of each round is a job with threads, plans and broadcasts of its own, which add up on the driver.
    """
    both = lambda kind, a, b: edges.select(F.lit(kind).alias("kind"), F.col(a).alias("host"), F.col(b).alias("to"), "weight")
    flows = both("trust", "src", "dst").unionByName(both("distrust", "dst", "src"))
    out = scratch.keep(flows.groupBy("kind", "host").agg(F.sum("weight").alias("out"), F.ceil(F.count(F.lit(1)) / EDGES_A_SALT).cast("int").alias("salts")), "out")
    keys = ["kind", "host", "salt"] if (out.agg(F.max("salts")).first()[0] or 1) > 1 else ["kind", "host"]
    flows = flows.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("weight") / F.col("out")).alias("share"), F.pmod(F.xxhash64("to"), "salts").cast("int").alias("salt"))
    flows = flows.repartition(*keys).sortWithinPartitions(*keys).persist(StorageLevel.MEMORY_AND_DISK)
    given = seeds.select("host", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("double").alias("seed")) for k in ("trust", "distrust")])).alias("s")).select("s.kind", "host", "s.seed")
    met = flows.select("kind", F.col("host")).unionByName(flows.select("kind", F.col("to").alias("host"))).distinct()
    nodes = given.unionByName(met.withColumn("seed", F.lit(0.0))).groupBy("kind", "host").agg(F.sum("seed").alias("seed"))
    nodes = nodes.join(out.select("kind", "host", "salts"), ["kind", "host"], "left").na.fill(1, ["salts"]).repartition("kind", "host").persist(StorageLevel.MEMORY_AND_DISK)
    ranks = nodes.select("kind", "host", "salts", F.col("seed").alias("rank"))
    kept = nodes.select("kind", "host", F.lit(0.0).alias("given"), "seed", "salts")
    for done in range(1, rounds + 1):
        leaving = ranks.where("rank > 0").select("kind", "host", *([F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")] if "salt" in keys else []), "rank")
        passed = flows.join(leaving, keys).select("kind", F.col("to").alias("host"), (F.col("rank") * F.col("share")).alias("given"), F.lit(0.0).alias("seed"), F.lit(1).alias("salts"))
        ranks = passed.unionByName(kept).groupBy("kind", "host").agg(F.max("salts").alias("salts"), ((1 - damping) * F.sum("seed") + damping * F.sum("given")).alias("rank"))
        if done % ROUNDS_A_TABLE == 0 or done == rounds:
            ranks = scratch.keep(ranks, "ranks")
    flows.unpersist()
    nodes.unpersist()
    scale = given.groupBy("kind").agg(F.sum("seed").alias("seeds")).join(ranks.groupBy("kind").agg(F.sum("rank").alias("ranks")), "kind")
    scaled = ranks.join(F.broadcast(scale), "kind").select("kind", "host", F.when(F.col("ranks") > 0, F.col("rank") * F.col("seeds") / F.col("ranks")).otherwise(0.0).alias("rank"))  # two rows
    return scaled.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, kin: float = KIN, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), and the host's trust and distrust, for each row of pages (page_id, url, html).

    rules: tuples as RULES, or a DataFrame (rule_host, rule_path, verdict), which may be large. The longest rule that fits a url gives the verdict, a block
    before an allow of the same length; without one the host is blocked if its distrust is over ``threshold`` of its trust and distrust together, and
    allowed otherwise, also if neither reaches it. Seeds are the pages that rules judge, so trust and distrust are shares of those pages.

    A null url or one without ``://`` has an empty host and path, which no rule fits and no link reaches; null html has no links; repeated rows count
    and come back each; an empty table gives no rows; other columns are not read. Texts are read once; what is written is hosts, paths and named
    hosts. A page of a frequent host meets its host by a join that Spark broadcasts or splits; all else is aggregated by host before it is shuffled.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "urls")
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([*rules], "rule_host string, rule_path string, verdict string")
    url = F.col("url").cast("string")
    read = scratch.keep(pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), linked_hosts(F.col("html").cast("string")).alias("links")), "read")
    hosts = scratch.keep(read.where("host <> ''").select("host").distinct(), "hosts")
    fitting = scratch.keep(rules_of_hosts(hosts, rules), "fitting")
    ruled = with_rule(read.drop("links"), fitting)
    seeds = ruled.where("ruled is not null").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("trust"), F.count_if(F.col("ruled") == "block").alias("distrust"))
    loop = Scratch(steady_session(spark), "ranks")
    ranks = scratch.keep(propagate(loop.keep(host_edges(read, hosts, kin), "edges"), loop.keep(seeds, "seeds"), loop, damping, rounds), "found")
    judged = ruled.join(ranks, "host", "left").na.fill(0.0, ["trust", "distrust"])
    bad = F.round("distrust", 6) * (1 - threshold) > F.round("trust", 6) * threshold  # rounded, so that the order of sums never decides
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")


def sql(rules=RULES, threshold: float = THRESHOLD, kin: float = KIN, damping: float = DAMPING, rounds: int = ROUNDS) -> str:
    """The same as DuckDB SQL, a table a round."""
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    url = URL.replace("'", "''")
    ranked = "r0 AS MATERIALIZED (SELECT kind, host, seed AS rank FROM nodes)"
    for i in range(1, rounds + 1):
        ranked += f""",
        r{i} AS MATERIALIZED (SELECT n.kind, n.host, {1 - damping!r}::DOUBLE * n.seed + {damping!r}::DOUBLE * coalesce(g.given, 0) AS rank
            FROM nodes n LEFT JOIN (SELECT f.kind, f.dst AS host, sum(r.rank * f.share) AS given FROM flows f JOIN r{i - 1} r ON r.kind = f.kind AND r.host = f.src GROUP BY ALL) g USING (kind, host))"""
    return rf"""
        WITH rules (rule_host, rule_path, verdict) AS (VALUES {listed}),
        read AS (SELECT row_number() OVER () AS row, page_id, translate(regexp_extract(coalesce(url, ''), '{url}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{url}', 2) AS path,
            list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(html, ''), '{LINK.replace("'", "''")}', 1), lambda h: translate(h, '{UPPER}', '{LOWER}')), lambda h: h <> '')) AS links FROM pages),
        ruled AS (SELECT row, page_id, host, path, arg_max(rule, (length(rule), verdict)) AS rule, arg_max(verdict, (length(rule), verdict)) AS ruled
            FROM read LEFT JOIN (SELECT *, rule_host || rule_path AS rule FROM rules) u ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL),
        links AS (SELECT host AS src, unnest(links) AS dst FROM read),
        linked AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM links WHERE src <> '' AND src <> dst GROUP BY ALL),
        named AS (SELECT DISTINCT string_split(host, '.') AS s FROM (SELECT host FROM read UNION SELECT dst FROM linked) WHERE NOT regexp_full_match(host, '[0-9.:]*')),
        kinship AS (SELECT DISTINCT array_to_string(s[i:], '.') AS low, array_to_string(s[i + 1:], '.') AS high FROM (SELECT s, unnest(range(1, len(s) - 1)) AS i FROM named WHERE len(s) > 2)),
        edges AS (SELECT src, dst, sum(weight) AS weight FROM (FROM linked UNION ALL SELECT low, high, {kin!r}::DOUBLE FROM kinship UNION ALL SELECT high, low, {kin!r}::DOUBLE FROM kinship) GROUP BY ALL),
        both_ways AS (SELECT 'trust' AS kind, src, dst, weight FROM edges UNION ALL SELECT 'distrust', dst, src, weight FROM edges),
        flows AS MATERIALIZED (SELECT kind, src, dst, weight / sum(weight) OVER (PARTITION BY kind, src) AS share FROM both_ways),
        nodes AS MATERIALIZED (SELECT kind, host, sum(seed) AS seed FROM (
            SELECT 'trust' AS kind, host, count(*) FILTER (ruled = 'allow')::DOUBLE AS seed FROM ruled WHERE ruled IS NOT NULL GROUP BY ALL UNION ALL SELECT 'distrust', host, count(*) FILTER (ruled = 'block') FROM ruled WHERE ruled IS NOT NULL GROUP BY ALL
            UNION ALL SELECT DISTINCT kind, src, 0 FROM flows UNION ALL SELECT DISTINCT kind, dst, 0 FROM flows) GROUP BY ALL),
        {ranked},
        scaled AS (SELECT kind, host, rank * (SELECT sum(seed) FROM nodes n WHERE n.kind = r.kind) / nullif((SELECT sum(rank) FROM r{rounds} x WHERE x.kind = r.kind), 0) AS rank FROM r{rounds} r),
        ranks AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS distrust FROM scaled GROUP BY host)
        SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN round(coalesce(distrust, 0), 6) * {1 - threshold!r} > round(coalesce(trust, 0), 6) * {threshold!r} THEN 'block' ELSE 'allow' END) AS verdict FROM ruled LEFT JOIN ranks USING (host)
    """
