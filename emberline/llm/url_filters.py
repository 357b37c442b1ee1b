"""URL verdicts: explicit host and path rules first, link-graph propagation for the rest, in built-in functions only.

Seeds come from the rules. A host's trust seed is the share of its pages that a rule allows, its distrust seed the share
that a rule blocks. Over host edges (links between different hosts, weighted by how many of the source's linking pages
have them):

* trust flows along links: t = (1 - d) * seed + d * sum of t(source) * weight / weight out of source;
* distrust flows against links (who links to a blocked host is suspect): the same over reversed edges.

Both are personalised PageRank without a total of 1, so scores don't depend on how many hosts there are: a host without
links and a seed of 1 scores 1 - d. A host is blocked if its distrust is at least `threshold` * (1 - d), what a host with
that share of blocked pages has of its own, and above its trust; otherwise it is allowed.

Rounds go on until no score changes by more than TOLERANCE, and fail if MOST_ROUNDS don't get there; what is then still
missing from a score is at most d / (1 - d) times that, some 6e-8, far below the threshold of 0.075.

A link from a page counts once for each page and target host. Hubs don't gather in one task: edges are added up before
the shuffle, inflow is a partial sum, and joins of hosts with their edges or pages are dealt out for the join alone, so
that adaptive execution can split them. Scores are written to the shared folder every few rounds.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is allowed; a null html
has no links; repeated page rows are judged each; of equally long rules the last one given counts; a host whose trust and distrust are equal is allowed; hosts that are only linked to take part in propagation;
an empty table gives an empty result; other columns, whatever their names, are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import observed
from .common import anew_text, stored

#: (host, path prefix, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DAMPING = 0.85
TOLERANCE, MOST_ROUNDS = 1e-8, 400
THRESHOLD = 0.5
CHECKPOINT_EVERY = 4
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?[a-z][a-z0-9+.-]*://([^/?#"'\s>]*)"""


def lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, prefix, what in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == F.lit(name)) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        rule, verdict = F.when(fits, F.lit(name + prefix)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, weight): how many pages of the source host link to the target host; no loops."""
    targets = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(HREF), F.lit(1)))
    links = pages.filter(F.col("html").isNotNull()).select(host_of(F.col("url")).alias("source"), F.explode(F.array_distinct(F.transform(targets, lower_ascii))).alias("target"))
    return links.filter((F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target"))).groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(host, score) at convergence. seeds: (host, seed) with each host once; edges: (source, target, weight)."""
    out = edges.groupBy("source").agg(F.sum("weight").alias("_total")).select(anew_text("source").alias("_source"), "_total")
    shares = stored(edges.join(out, F.col("source") == F.col("_source")).select("source", "target", (F.col("weight") / F.col("_total")).alias("share")), "shares")
    base = (1 - damping) * F.col("seed")
    state = seeds.select("host", base.alias("base"), base.alias("score"), F.lit(None).cast("double").alias("change"))
    if shares.isEmpty():
        return state.select("host", "score")
    for k in range(1, most_rounds + 1):
        senders = state.select(anew_text("host").alias("_host"), "score")
        inflow = shares.join(senders, F.col("source") == F.col("_host")).groupBy(F.col("target").alias("_target")).agg((F.sum(F.col("score") * F.col("share")) * damping).alias("inflow"))
        score = F.col("base") + F.coalesce(F.col("inflow"), F.lit(0.0))
        state = state.join(inflow, F.col("host") == F.col("_target"), "left").select("host", "base", score.alias("score"), F.abs(score - F.col("score")).alias("change"))
        if k % CHECKPOINT_EVERY == 0:
            state, (change,) = observed(state, "scores", F.max("change"))
            if change is None or change <= tolerance:
                return state.select("host", "score")
    raise RuntimeError(f"scores did not settle in {most_rounds} rounds")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """Every page with host, path, rule, verdict, and its host's trust and distrust."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "_ruled": verdict})
    edges = stored(host_edges(pages), "edges")
    share = lambda what: F.avg(F.when(F.col("_ruled") == what, 1.0).otherwise(0.0))
    own = judged.groupBy("host").agg(share("allow").alias("trust_seed"), share("block").alias("distrust_seed"))
    linked = edges.select(F.col("target").alias("host")).distinct().join(own, "host", "left_anti").select("host", F.lit(0.0).alias("trust_seed"), F.lit(0.0).alias("distrust_seed"))
    hosts = stored(own.unionByName(linked), "hosts")
    trust = propagate(hosts.select("host", F.col("trust_seed").alias("seed")), edges, damping).withColumnRenamed("score", "trust")
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight")
    distrust = propagate(hosts.select("host", F.col("distrust_seed").alias("seed")), back, damping).withColumnRenamed("score", "distrust")
    blocked = (F.round("distrust", 9) >= F.round(F.lit(threshold * (1 - damping)), 9)) & (F.round("distrust", 9) > F.round("trust", 9))
    verdicts = trust.join(distrust, "host").select(
        "host", F.when(blocked & (F.col("host") != ""), "block").otherwise("allow").alias("_spread"), F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust")
    )
    # read back: a small one is broadcast, and else a host with most pages is a skewed side that is split
    return judged.join(stored(verdicts, "verdicts"), "host").select("page_id", "host", "path", "rule", F.coalesce("_ruled", "_spread").alias("verdict"), "trust", "distrust")


def oracle(rules: list[tuple[str, str, str]] = RULES, damping: float = DAMPING, rounds: int = 150, threshold: float = THRESHOLD) -> str:
    """The same rows in DuckDB SQL, a materialised table expression for each of so many rounds that no digit shows the rest."""
    ordered = sorted(reversed(rules), key=lambda r: -(len(r[0]) + len(r[1])))
    fits = lambda n, p: f"((host = '{n}' or ends_with(host, '.{n}')) and starts_with(path, '{p}'))"
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    case = lambda i: "case " + " ".join(f"when {fits(n, p)} then '{(n + p, v)[i]}'" for n, p, v in ordered) + " end"
    href = HREF.replace("'", "''")
    ctes = [
        f"""p as materialized (select page_id, html, {lower("coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '')")} as host,
            coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages)""",
        f"j as materialized (select page_id, host, path, {case(0)} as rule, {case(1)} as ruled from p)",
        f"""l as (select page_id, row_number() over () as r, host as source, regexp_extract_all(coalesce(html, ''), '{href}', 1) as found from p)""",
        f"""u as (select distinct r, source, {lower("t")} as target from (select r, source, unnest(found) as t from l))""",
        "e as materialized (select source, target, count(*) as weight from u where source <> '' and target <> '' and source <> target group by all)",
        """h as materialized (select host, avg(case when ruled = 'allow' then 1.0 else 0.0 end) as ts, avg(case when ruled = 'block' then 1.0 else 0.0 end) as ds from j group by host
            union all select distinct target, 0.0, 0.0 from e where target not in (select host from j))""",
    ]
    for name, seed, a, b in (("t", "ts", "source", "target"), ("d", "ds", "target", "source")):
        ctes.append(f"{name}s as materialized (select {a} as a, {b} as b, weight / sum(weight) over (partition by {a}) as share from e)")
        ctes.append(f"{name}0 as materialized (select host, {1 - damping!r} * {seed} as score, {1 - damping!r} * {seed} as base from h)")
        for k in range(1, rounds + 1):
            ctes.append(f"""{name}{k} as materialized (select z.host, z.base + {damping!r} * coalesce(i.inflow, 0) as score, z.base from {name}{k - 1} z
                left join (select b as host, sum(score * share) as inflow from {name}s join {name}{k - 1} on host = a group by b) i on z.host = i.host)""")
    return f"""with {", ".join(ctes)} select j.page_id, j.host, j.path, j.rule, coalesce(j.ruled,
        case when j.host <> '' and round(d.score, 9) >= round({threshold * (1 - damping)!r}, 9) and round(d.score, 9) > round(t.score, 9) then 'block' else 'allow' end) as verdict,
        round(t.score, 6) as trust, round(d.score, 6) as distrust
        from j join t{rounds} t on t.host = j.host join d{rounds} d on d.host = j.host"""
