"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a regular expression and the literal tokens that any url it matches must contain. Each rule is filed
under that one of its tokens which the fewest urls contain, or under each of its `either`. The index is a hash table: an array of slots, each
with the rules filed under the tokens that hash there. A url's tokens fetch the rules from their slots, and
only those run their expression. Beside them stand host rules (host, path, verdict), of which the longest that
fits wins and overrides the patterns.

Everything is a DataFrame expression within one pass over the urls: no join and no shuffle, whatever host has the most
rows. The index is one constant of the plan, as long as the rule list, whose length the caller sets. The one job before it counts the rules' own
literal tokens, joined to a broadcast of these (its result is as long as the rule list).

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is allowed. Repeated
rows and repeated ids each get their own row. Other columns of the input are left out, unless named in keep.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """pattern: for both Java and RE2. tokens: lower-case runs of [a-z0-9], all of them in every url that matches. either: tokens of which
    every such url has one at least; they take the place of tokens in the index."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    either: tuple[str, ...] = ()


HOST_RULES = (
    HostRule("org", "/", "allow"),
    HostRule("example.org", "/es/", "block"),
    HostRule("example.org", "/en/1", "block"),
    HostRule("com", "/fr/", "allow"),
    HostRule("com", "/de/", "block"),
)

PATTERN_RULES = (
    PatternRule("spam-farm", r"://([a-z0-9-]+\.)*spam-farm\.", ("spam", "farm")),
    PatternRule("pills", r"://([a-z0-9-]+\.)*cheap-pills\.", ("cheap", "pills")),
    PatternRule("casino", r"://([a-z0-9-]+\.)*casino-win\.", ("casino", "win")),
    PatternRule("trackers", r"://([a-z0-9-]+\.)*ads-track\.", ("ads", "track")),
    PatternRule("bets", r"://([a-z0-9-]+\.)*free-bets\.", ("free", "bets")),
    PatternRule("adult", r"://([a-z0-9-]+\.)*adult-x\.", ("adult", "x")),
    PatternRule("archives", r"\.(zip|rar|exe)([?#]|$)", (), ("zip", "rar", "exe")),
    PatternRule("login", r"/login(\.php)?([/?#]|$)", ("login",)),
    PatternRule("cart", r"/cart([/?#]|$)", ("cart",)),
)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ://, up to /, ? or # and from there up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def url_tokens(url: Column) -> Column:
    """The distinct runs of [a-z0-9] in the url, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(lower_ascii(F.coalesce(url, F.lit(""))), F.lit(r"[a-z0-9]+"), 0))


def host_rule(host: Column, path: Column, rules: tuple[HostRule, ...]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _strings(spark: SparkSession, values: list[str]) -> DataFrame:
    """t: the values, as a constant of the plan."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(values)), "array<string>")).alias("t"))


def index_rules(urls: DataFrame, rules: tuple[PatternRule, ...], url_col: str = "url") -> dict[str, list[PatternRule]]:
    """The rules by the one of their tokens that the fewest urls contain (ties: the smaller string).

    Only the rules' own tokens are counted, so what comes to the driver is as long as the rules are.
    """
    known = sorted({t for r in rules if not r.either for t in r.tokens})
    counts: dict[str, int] = {}
    if known:
        own = _strings(urls.sparkSession, known)
        held = urls.select(F.explode(url_tokens(F.col(url_col))).alias("t")).join(F.broadcast(own), "t")
        counts = {t: n for t, n in held.groupBy("t").count().collect()}
    index: dict[str, list[PatternRule]] = {}
    for r in rules:
        for t in r.either or (min(r.tokens, key=lambda t: (counts.get(t, 0), t)),):
            index.setdefault(t, []).append(r)
    return index


def slot_table(spark: SparkSession, index: dict[str, list[PatternRule]]) -> tuple[Column, int]:
    """The index as a constant array of slots, each an array of (token, name, pattern); and how many slots there are."""
    slots = 1 << max(0, (2 * len(index) - 1).bit_length())
    placed: list[list[dict]] = [[] for _ in range(slots)]
    tokens = _strings(spark, list(index))
    for t, k in tokens.select("t", slot_of(F.col("t"), slots)).collect():  # the rules' tokens
        placed[k] += [{"token": t, "name": r.name, "pattern": r.pattern} for r in index[t]]
    return F.from_json(F.lit(json.dumps(placed)), "array<array<struct<token:string,name:string,pattern:string>>>"), slots


def slot_of(token: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(slots)).cast("int")


def filter_urls(
    pages: DataFrame,
    host_rules: tuple[HostRule, ...] = HOST_RULES,
    pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES,
    url_col: str = "url",
    keep: tuple[str, ...] = ("page_id",),
) -> DataFrame:
    """keep, host, path, rule, verdict, and patterns: the names of the pattern rules that match."""
    for r in pattern_rules:
        re.compile(r.pattern)
        if not r.tokens and not r.either:
            raise ValueError(f"rule {r.name} has no literal token")
    index = index_rules(pages, pattern_rules, url_col)
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = split_url(url)
    base = pages.select(*keep, url.alias("_url"), host.alias("host"), path.alias("path"), url_tokens(url).alias("_tokens"))
    base = base.withColumn("_base", host_rule(F.col("host"), F.col("path"), host_rules))
    matched = F.array().cast("array<string>")
    if index:
        table, slots = slot_table(pages.sparkSession, index)
        fetched = F.flatten(F.transform("_tokens", lambda t: F.filter(F.get(table, slot_of(t, slots)), lambda r: r["token"] == t)))
        base = base.withColumn("_fetched", fetched).withColumn("_lower", F.when(F.size("_fetched") > 0, lower_ascii(F.col("_url"))))
        hits = F.filter("_fetched", lambda r: F.regexp_like(F.col("_lower"), r["pattern"]))
        matched = F.array_sort(F.array_distinct(F.transform(hits, lambda r: r["name"])))
    base = base.withColumn("patterns", matched)
    own = F.when(F.size("patterns") > 0, "block").otherwise("allow")
    return base.select(*keep, "host", "path", F.col("_base.rule").alias("rule"), F.coalesce(F.col("_base.verdict"), own).alias("verdict"), F.array_join("patterns", ",").alias("patterns"))


def oracle_sql(host_rules: tuple[HostRule, ...] = HOST_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES) -> str:
    """The same for DuckDB, every pattern run on every url, without any index."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    fits = sorted(host_rules, key=lambda r: (-len(r.name), r.name))
    case = lambda f: "case " + " ".join(f"when (host = {q(r.host)} or ends_with(host, {q('.' + r.host)})) and starts_with(path, {q(r.path)}) then {q(f(r))}" for r in fits) + " end"
    lower = f"translate(coalesce(url, ''), '{UPPER}', '{LOWER}')"
    hit = lambda r: f"case when regexp_matches({lower}, {q(r.pattern)}) then {q(r.name)} end"
    hits = ", ".join(hit(r) for r in pattern_rules)
    return f"""
with cut as (
  select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id, url, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from cut
), found as (
  select *, {case(lambda r: r.name)} as rule, {case(lambda r: r.verdict)} as said,
         list_sort(list_filter([{hits}], lambda x: x is not null)) as hits from parts
)
select page_id, host, path, rule, coalesce(said, case when len(hits) > 0 then 'block' else 'allow' end) as verdict,
       array_to_string(hits, ',') as patterns
from found
"""
