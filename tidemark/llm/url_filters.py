"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over host + path, with the literal tokens that any match must contain as whole tokens.
The index maps each rule's rarest token, by how many URLs of the table hold it, to the rule. A URL's tokens fetch its
candidate rules and only those run their expressions. With up to MAX_INLINE rules the index is a literal map inside the
projection: no join, no shuffle, no Python; beyond that the distinct URLs join the rule table on the token.

Rank decides among matching rules: site rules (host and path prefix) before patterns, longer before shorter. Site rules
see the path as it is; patterns, and the tokens of both, see it with A-Z lower-cased. No other letter changes case: a
Kelvin sign is no k.

Defined cases: a null URL, or one without ``://``, has empty host and path and matches no rule, so it gets the default
verdict; a very long URL is judged whole, its expressions run in linear time; equal rows are judged alike and each returned; an empty table gives an empty result; columns of the table
other than the URL don't matter and pass through unless they have a name that the operator adds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Above so many rules the literal map gives way to a join.
MAX_INLINE = 2000
TOKEN_BREAK = "[^a-z0-9]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    name: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    site: bool


def site_rule(action: str, where: str) -> Rule:
    """Host and path prefix, like ``example.com/en/``: fits the host and its subdomains. The path ends with a slash."""
    host, slash, rest = where.partition("/")
    literal = "".join(c if c.isalnum() else "\\" + c for c in host.lower() + slash + rest)
    return Rule(where, action, rf"^(?:[^/]*\.)?{literal}", tuple(t for t in re.split(TOKEN_BREAK, (host + slash + rest).lower()) if t), True)


def token_rule(action: str, *tokens: str) -> Rule:
    """These tokens one after another, parted by ``.``, ``-`` or ``_``, as whole tokens of the host."""
    return Rule("-".join(tokens), action, rf"^(?:[^/]*[^a-z0-9/])?{'[._-]'.join(tokens)}(?![a-z0-9])", tokens, False)


def path_rule(action: str, *tokens: str) -> Rule:
    """These tokens one after another, parted by anything but letters and digits, as whole tokens of the path."""
    return Rule("/" + "-".join(tokens), action, rf"(?s)^[^/]*/(?:.*[^a-z0-9])?{'[^a-z0-9]+'.join(tokens)}(?![a-z0-9])", tokens, False)


#: The site rules that a query states, and words and phrases of hosts and paths that spam, gambling,
#: pharmacy, adult, ad and piracy pages use; the words of a phrase are harmless alone.
SITE_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
HOST_WORDS = ["spam", "casino", "pills", "bets", "adult", "ads", "porn", "xxx", "warez", "phish"]
HOST_PHRASES = [("click", "track"), ("win", "prize"), ("cheap", "meds"), ("payday", "loans"), ("fake", "login")]
PATH_PHRASES = [("online", "casino"), ("buy", "pills"), ("free", "porn"), ("sports", "bets"), ("crack", "serial"), ("work", "from", "home", "cash")]


def default_rules() -> list[Rule]:
    phrases = [token_rule("block", *t) for t in HOST_PHRASES] + [path_rule("block", *t) for t in PATH_PHRASES]
    return [site_rule(*r) for r in SITE_RULES] + [token_rule("block", w) for w in HOST_WORDS] + phrases


def ranked(rules: list[Rule]) -> list[Rule]:
    """Site rules first, then the longer; equal lengths by name."""
    return sorted(rules, key=lambda r: (not r.site, -len(r.name), r.name))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _lowered(subject: Column) -> Column:
    return F.translate(subject, _UPPER, _LOWER)


def _tokens(subject: Column) -> Column:
    return F.array_distinct(F.split(_lowered(subject), TOKEN_BREAK))


def token_frequencies(pages: DataFrame, url: str, rules: list[Rule]) -> dict[str, int]:
    """In how many URLs each literal token of the rules stands: at most one row for each such token reaches the driver."""
    wanted = sorted({t for r in rules for t in r.tokens})
    subject = F.concat(host_of(F.col(url)), path_of(F.col(url)))
    found = F.array_intersect(_tokens(subject), F.array(*[F.lit(t) for t in wanted]))
    return {r["t"]: r["count"] for r in pages.select(F.explode(found).alias("t")).groupBy("t").count().collect()}


def index_of(rules: list[Rule], frequency: dict[str, int]) -> dict[str, list[int]]:
    """Rarest token -> ranks of the rules indexed there; a rule without tokens is a candidate everywhere (token '')."""
    index: dict[str, list[int]] = {}
    for rank, r in enumerate(rules):
        key = min(r.tokens, key=lambda t: (frequency.get(t, 0), t), default="")
        index.setdefault(key, []).append(rank)
    return index


def judge(pages: DataFrame, rules: list[Rule] | None = None, url: str = "url", default: str = "allow", max_inline: int = MAX_INLINE) -> DataFrame:
    """pages and host, path, rule (the deciding site rule, else null), pattern (the deciding pattern, else null), verdict."""
    rules = ranked(default_rules() if rules is None else rules)
    added = ("host", "path", "rule", "pattern", "verdict")
    pages = pages.drop(*[c for c in pages.columns if c.lower() in added and c != url])
    index = index_of(rules, token_frequencies(pages, url, rules)) if rules else {}
    located = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    best = _best_inline if len(rules) <= max_inline else _best_joined
    return best(located, rules, index, url, default)


def _outcome(rank: Column, rules: list[Rule], default: str) -> dict[str, Column]:
    site = F.array(*[F.lit(r.name if r.site else None).cast("string") for r in rules])
    pattern = F.array(*[F.lit(None if r.site else r.name).cast("string") for r in rules])
    action = F.array(*[F.lit(r.action) for r in rules])
    return {"rule": F.get(site, rank), "pattern": F.get(pattern, rank), "verdict": F.coalesce(F.get(action, rank), F.lit(default))}


def _best_inline(pages: DataFrame, rules: list[Rule], index: dict, url: str, default: str) -> DataFrame:
    if not rules:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "pattern": F.lit(None).cast("string"), "verdict": F.lit(default)})
    subject = F.concat("host", "path")
    lookup = F.create_map(*[x for t, ranks in sorted(index.items()) for x in (F.lit(t), F.array(*[F.lit(k) for k in ranks]))])
    keys = F.array(*[F.lit(t) for t in sorted(index)])
    found = F.array_intersect(F.array_append(_tokens(subject), F.lit("")), keys)
    candidates = F.flatten(F.transform(found, lambda t: F.element_at(lookup, t)))
    regexes = F.array(*[F.lit(r.regex) for r in rules])
    sites, low = sum(r.site for r in rules), _lowered(subject)
    rank = F.array_min(F.filter(candidates, lambda k: F.rlike(F.when(k < sites, subject).otherwise(low), F.get(regexes, k))))
    return pages.withColumn("_rank", rank).withColumns(_outcome(F.col("_rank"), rules, default)).drop("_rank")


def _best_joined(pages: DataFrame, rules: list[Rule], index: dict, url: str, default: str) -> DataFrame:
    """The same through a join of distinct URLs' tokens with the rule table; the planner sizes the rule side itself."""
    spark = pages.sparkSession
    rows = [(t, k, rules[k].regex, rules[k].name if rules[k].site else None, None if rules[k].site else rules[k].name, rules[k].action) for t, ranks in index.items() for k in ranks]
    table = spark.createDataFrame(rows, "token string, rank int, regex string, rule string, pattern string, verdict string")
    subject = F.concat("host", "path")
    asked = pages.select("host", "path").distinct().withColumn("token", F.explode(F.array_append(_tokens(subject), F.lit(""))))
    seen = F.when(F.col("rule").isNotNull(), subject).otherwise(_lowered(subject))
    hits = asked.join(table, "token").where(F.rlike(seen, F.col("regex")))
    best = hits.groupBy("host", "path").agg(F.min_by(F.struct("rule", "pattern", "verdict"), "rank").alias("_best"))
    joined = pages.join(best, ["host", "path"], "left")
    out = joined.withColumns({k: F.col("_best")[k] for k in ("rule", "pattern")} | {"verdict": F.coalesce(F.col("_best")["verdict"], F.lit(default))})
    return out.select(*pages.columns, "rule", "pattern", "verdict")
