"""URL filters: host rules, and trust and distrust spread over the link graph between hosts.

All of it is DataFrame work. Personalised PageRank spreads trust from hosts whose pages the
rules allow, along links; distrust from hosts whose pages they block, against them. A seed keeps its restart share, and
the mass of hosts without links to go on goes back to the seeds. A host is blocked when its distrust is above its trust
by more than its threshold: a share of the larger of the two and, where rules block some of the host's own pages, the
weight that its pages without a rule would have as a seed. So a rule on a path judges the rest of a host only
where it fits more pages than are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, shielded, without

#: Fixed rules: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING = 0.85
#: Scores are final when a round changes none by more than this share of it; what later rounds add is under six times that.
TOLERANCE = 1e-3
#: Distrust may exceed trust by this share of the larger of the two before a host is blocked.
MARGIN = 0.1
#: A host whose distrust is under this share of the mean over all hosts, what it would have if distrust were spread evenly, is not blocked for it.
FLOOR = 0.1
#: Rounds in the SQL, more than the given tables need.
SQL_ROUNDS = 40
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The target of a link with a host in it.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^/"'\s?#>]+)"""
OWN = ["host", "path", "rule", "verdict"]


def host_of(url: str) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: str) -> Column:
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.col(url).substr(at + 3, F.length(url))).otherwise("")


def by_length(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))


def _first_rule(rules: list[tuple[str, str, str]], value) -> Column:
    out = F.lit(None).cast("string")
    for rule in reversed(by_length(rules)):
        _, host, path = rule
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def judged_by_rules(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and the rule's verdict ``_said``; the longest fitting rule wins."""
    x = without(pages, OWN).withColumn("host", host_of("url")).withColumn("path", path_of("url"))
    return x.withColumn("rule", _first_rule(rules, lambda r: r[1] + r[2])).withColumn("_said", _first_rule(rules, lambda r: r[0]))


def host_links(pages: DataFrame) -> DataFrame:
    """``(src, dst, n)``: links between different hosts, counted before they are shuffled."""
    to = F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    x = pages.where("host <> ''").select(F.col("host").alias("src"), to.alias("to"))
    x = x.select("src", F.translate(F.regexp_extract("to", "//(.*)$", 1), UPPER, LOWER).alias("dst"))
    return x.where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def host_scores(judged: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """``(host, trust, distrust, own)``: both personalised PageRanks of each host, and the weight of its unjudged pages as a seed (0 unless rules block some of its pages).

    A seed's weight is the share of the host's pages that the rules judge so. Rounds go on until no score changes by more than
    ``tolerance`` of the larger of the host's two. A score that links have not reached yet changes by all of itself.
    """
    counts = [F.count_if(F.col("_said") == "allow").alias("good"), F.count_if(F.col("_said") == "block").alias("bad"), F.count("*").alias("n")]
    seeds = judged.where("host <> ''").groupBy("host").agg(*counts)
    seeds = saved(seeds.select("host", (F.col("good") / F.col("n")).alias("st"), (F.col("bad") / F.col("n")).alias("sd")), "url-seeds")
    links = saved(host_links(judged), "url-links")
    out = links.groupBy("src").agg(F.sum("n").alias("all_out"))
    into = links.groupBy("dst").agg(F.sum("n").alias("all_in"))
    share = links.join(out, "src").join(into, "dst")
    share = saved(share.select("src", "dst", (F.col("n") / F.col("all_out")).alias("fwd"), (F.col("n") / F.col("all_in")).alias("back")), "url-shares")
    # a host without links on either side is a seed that gets all its mass back
    unjudged = F.when(F.col("sd") > 0, 1 - F.col("st") - F.col("sd")).otherwise(0.0)
    if share.isEmpty():
        return seeds.select("host", F.col("st").alias("trust"), F.col("sd").alias("distrust"), unjudged.alias("own"))
    ends = share.groupBy(F.col("src").alias("host")).agg(F.lit(False).alias("no_out")).join(share.groupBy(F.col("dst").alias("host")).agg(F.lit(False).alias("no_in")), "host", "full_outer")
    seeds = saved(ends.join(seeds, "host", "full_outer").na.fill(0.0, ["st", "sd"]).na.fill(True, ["no_out", "no_in"]), "url-seeds")
    all_t, all_d = seeds.agg(F.sum("st"), F.sum("sd")).first()
    state = seeds.select("host", F.col("st").alias("t"), F.col("sd").alias("d"))
    lost = seeds.agg(F.sum(F.when(F.col("no_out"), F.col("st"))), F.sum(F.when(F.col("no_in"), F.col("sd")))).first()
    while True:
        back = [(1 - damping) + damping * (x or 0.0) / y if y else 0.0 for x, y in zip(lost, (all_t, all_d), strict=True)]
        t = share.join(state.select(F.col("host").alias("src"), "t"), "src").select(F.col("dst").alias("host"), (F.col("t") * F.col("fwd") * damping).alias("t"), F.lit(0.0).alias("d"))
        d = share.join(state.select(F.col("host").alias("dst"), "d"), "dst").select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("d") * F.col("back") * damping).alias("d"))
        got = t.unionByName(d).groupBy("host").agg(F.sum("t").alias("got_t"), F.sum("d").alias("got_d"))
        old = state.select("host", F.col("t").alias("old_t"), F.col("d").alias("old_d"))
        new = seeds.join(got, "host", "left").join(old, "host").na.fill(0.0, ["got_t", "got_d"])
        new = new.select("host", "no_out", "no_in", (F.col("st") * back[0] + F.col("got_t")).alias("t"), (F.col("sd") * back[1] + F.col("got_d")).alias("d"), "old_t", "old_d", (unjudged * back[1]).alias("own"))
        before, state = state, saved(new, "url-state")
        change = F.greatest(F.abs(F.col("t") - F.col("old_t")), F.abs(F.col("d") - F.col("old_d"))) > tolerance * F.greatest("t", "d")
        *lost, moving = state.agg(F.sum(F.when(F.col("no_out"), F.col("t"))), F.sum(F.when(F.col("no_in"), F.col("d"))), F.count_if(change)).first()
        if "old_t" in before.columns:
            discard(before)
        if not moving:
            return state.select("host", F.col("t").alias("trust"), F.col("d").alias("distrust"), "own")


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, tolerance: float = TOLERANCE, margin: float = MARGIN, keep: list[str] | None = None) -> DataFrame:
    """Judge the url of every row of ``pages(url, html, ...)``.

    Adds ``host``, ``path``, ``rule`` and ``verdict`` to the columns ``keep`` (default: all).
    A url that no rule fits gets its host's verdict: block if the host's distrust exceeds its trust by
    more than ``margin`` of the larger and its ``own`` weight (:func:`host_scores`), and is no mere trace (``FLOOR``), else allow. Scores are spread until they stand still.

    Nulls: a url that is null or has no ``://`` has an empty host and path, no rule, and is
    allowed; a null html has no links. Repeated rows are judged alike, and their links count each. An
    empty table gives an empty result. Input columns named like a result are replaced. Pages of any length are read whole.
    """
    keep = [c for c in (pages.columns if keep is None else keep) if c.lower() not in OWN]
    x, back = shielded(pages, ["url", "html"], keep)
    judged = judged_by_rules(x, rules)
    scores = host_scores(judged, tolerance)
    # equal up to the last bits is not above
    floor = FLOOR * (scores.agg(F.avg("distrust")).first()[0] or 0.0)
    bad = scores.where(F.col("distrust") >= floor).where(F.col("distrust") - F.col("trust") > margin * F.greatest("distrust", "trust") + F.col("own") + 1e-12).select(F.col("host").alias("_bad"))
    x = judged.join(bad, F.col("host") == F.col("_bad"), "left")
    verdict = F.coalesce("_said", F.when(F.col("_bad").isNotNull(), "block").otherwise("allow"))
    return x.select(*back, "host", "path", "rule", verdict.alias("verdict"))


def _oracle() -> str:
    fit = lambda r: f"((host = '{r[1]}' or ends_with(host, '.{r[1]}')) and starts_with(path, '{r[2]}'))"
    case = lambda value: "case " + " ".join(f"when {fit(r)} then '{value(r)}'" for r in by_length(RULES)) + " end"
    rest = "case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end"
    low = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    rx = LINK.replace("'", "''")
    d = DAMPING
    state = ["s0 as (select host, st as t, sd as d, 0.0::double as kd from seeds)"]
    for i in range(1, SQL_ROUNDS + 1):
        state.append(f"""k{i} as (select {1 - d} + {d} * coalesce(sum(t) filter (no_out), 0) / nullif(sum(st), 0) as kt, {1 - d} + {d} * coalesce(sum(d) filter (no_in), 0) / nullif(sum(sd), 0) as kd from s{i - 1} join seeds using (host)),
g{i} as (select host, sum(t) as t, sum(d) as d from (select dst as host, t * fwd * {d} as t, 0.0::double as d from share join s{i - 1} on src = host union all select src, 0.0, d * back * {d} from share join s{i - 1} on dst = host) group by host),
s{i} as materialized (select seeds.host, st * coalesce(kt, 0) + coalesce(g{i}.t, 0) as t, sd * coalesce(kd, 0) + coalesce(g{i}.d, 0) as d, coalesce(kd, 0) as kd from seeds cross join k{i} left join g{i} on seeds.host = g{i}.host)""")
    return f"""
with r as (select page_id, url, html, {rest} as rest from pages),
hp as (select page_id, html, {low("regexp_extract(rest, '^([^/?#]*)', 1)")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
j as (select *, {case(lambda r: r[1] + r[2])} as rule, {case(lambda r: r[0])} as said from hp),
l0 as (select host as src, unnest(regexp_extract_all(html, '{rx}', 1)) as to_ from j where host <> ''),
l1 as (select src, {low("regexp_extract(to_, '//(.*)$', 1)")} as dst from l0),
links as (select src, dst, count(*) as n from l1 where src <> dst and dst <> '' group by all),
share as (select src, dst, n / sum(n) over (partition by src) as fwd, n / sum(n) over (partition by dst) as back from links),
seeds as materialized (select host, coalesce(st, 0)::double as st, coalesce(sd, 0)::double as sd, host not in (select src from share) as no_out, host not in (select dst from share) as no_in from (select src as host from share union select dst from share union select host from j where host <> '') left join
 (select host, count(*) filter (said = 'allow') / count(*) as st, count(*) filter (said = 'block') / count(*) as sd from j where host <> '' group by host) using (host)),
{", ".join(state)},
bad as (select host from s{SQL_ROUNDS} s join seeds using (host) where s.d >= {FLOOR} * (select avg(d) from s{SQL_ROUNDS}) and s.d - s.t > {MARGIN} * greatest(s.d, s.t) + case when sd > 0 then (1 - st - sd) * kd else 0 end + 1e-12)
select page_id, j.host, path, rule, coalesce(said, case when bad.host is not null then 'block' else 'allow' end) as verdict from j left join bad on j.host = bad.host
"""


ORACLE_SQL = _oracle()
