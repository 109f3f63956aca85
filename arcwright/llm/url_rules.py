"""URL filters: pattern rules found through their rarest literal token.

A rule is a pattern over a url without its scheme (its host in lower case).  In a pattern
``*`` is any text, ``^`` a separator or the end, ``|`` at an end anchors it there, and
``||`` at the start stands for the start of the host or of any of its labels.  Each rule
is filed under the one of its literal tokens that the urls hold least often.  A url looks up
its own tokens, and only the rules filed under them run their regular expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwright.functions.durable import settle

#: Rules that go to all tasks at once, as an index of bounded size; longer lists take several passes.
RULES_A_PASS = 50_000
_TOKEN = re.compile(r"[A-Za-z0-9]+")
_SEPARATOR = r"(?:[^A-Za-z0-9_.%-]|\Z)"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    pattern: str
    name: str | None = None  # told in the column rule; None: a rule of the method's own

    def regex(self) -> str:
        p, out = self.pattern, ""
        if p.startswith("||"):
            out, p = r"\A(?:[^/?#]*\.)?", p[2:]
        elif p.startswith("|"):
            out, p = r"\A", p[1:]
        end, p = (r"\Z", p[:-1]) if p.endswith("|") else ("", p)
        for piece in re.split(r"([*^])", p):
            out += {"*": r"[\s\S]*", "^": _SEPARATOR}.get(piece, re.escape(piece))
        return out + end

    def tokens(self) -> list[str]:
        """Literal tokens that every matching url holds as whole tokens.

        A token counts if what stands at each of its sides in the pattern is a character
        that no token holds, or an anchor; beside ``*`` or an open end it may go on.
        """
        closed = self.pattern.startswith("|"), self.pattern.endswith("|")
        body = self.pattern.strip("|")
        found = []
        for m in _TOKEN.finditer(body):
            left = body[m.start() - 1] if m.start() else ("|" if closed[0] else "*")
            right = body[m.end()] if m.end() < len(body) else ("|" if closed[1] else "*")
            if left != "*" and right != "*":
                found.append(m.group().lower())
        return found


def host_rule(verdict: str, name: str) -> Rule:
    """``host/path``: the host and all its subdomains, where the path starts with the rule's."""
    host, slash, path = name.partition("/")
    if not slash or re.search(r"[?#*^|]", name) or host != host.lower():
        raise ValueError(f"no host rule: {name}")
    return Rule(verdict, f"||{name}", name)


HOST_RULES = [host_rule("block", "net/"), host_rule("allow", "example.net/en/"), host_rule("block", "example.com/de/"), host_rule("allow", "org/fr/")]

#: The method's own patterns, which judge urls that no host rule fits: advertising, tracking, link farms.
METHOD_RULES = [
    Rule("block", "||ads.*"),
    Rule("block", "||adserver.*"),
    Rule("block", "||tracker.*"),
    Rule("block", "/ads/"),
    Rule("block", "/banner/"),
    Rule("block", "/popup^"),
    Rule("block", "/redirect?url=*"),
    Rule("block", "||spam-*"),
    Rule("block", "-pills.*"),
    Rule("block", "*casino*"),
    Rule("allow", "/robots.txt|"),
]


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z in lower case), path, and the whole after ``://`` with that host; empty without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    plain = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    host = F.translate(plain, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tail = F.substr(rest, F.length(plain) + 1)
    return host, F.regexp_extract(tail, r"\A[^?#]*", 0), F.concat(host, tail)


def rarest_tokens(urls: DataFrame, rules: Sequence[Rule]) -> list[str | None]:
    """The token that each rule is filed under: of its literal tokens that of fewest urls in ``urls(whole)``.

    Only tokens of rules are counted, by Spark over all urls; ties go to the longer, then to
    the lesser token.  A rule without such a token gets None and is tried on every url.
    """
    names = sorted({t for r in rules for t in r.tokens()})
    counts: dict[str, int] = {}
    for a in range(0, len(names), RULES_A_PASS):
        some = urls.sparkSession.createDataFrame([(t,) for t in names[a : a + RULES_A_PASS]], "token string")
        held = urls.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("whole", F.lit(_TOKEN.pattern), F.lit(0)), F.lower))).alias("token"))
        counted = held.join(F.broadcast(some), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
        counts |= {r["token"]: r["n"] for r in counted.collect()}
    return [min(r.tokens(), key=lambda t: (counts.get(t, 0), -len(t), t), default=None) for r in rules]


class RuleIndex:
    """Rules under their tokens; patterns are compiled where they first run."""

    def __init__(self, rules: Sequence[Rule], filed: Sequence[str | None]):
        self.rules = list(rules)
        self.order = [(-len(r.pattern), r.pattern, r.verdict) for r in rules]
        self.under: dict[str | None, list[int]] = {}
        for i, t in enumerate(filed):
            self.under.setdefault(t, []).append(i)
        self.compiled: dict[int, re.Pattern] = {}

    def candidates(self, whole: str) -> list[int]:
        found = list(self.under.get(None, ()))
        for t in {t.lower() for t in _TOKEN.findall(whole)}:
            found += self.under.get(t, ())
        return found

    def matches(self, i: int, whole: str) -> bool:
        if i not in self.compiled:
            self.compiled[i] = re.compile(self.rules[i].regex())
        return self.compiled[i].search(whole) is not None

    def best(self, whole: str) -> list[Rule]:
        """The longest matching host rule and the longest matching rule of the method."""
        out = {}
        for i in sorted(self.candidates(whole), key=self.order.__getitem__):
            own = self.rules[i].name is None
            if own not in out and self.matches(i, whole):
                out[own] = self.rules[i]
        return list(out.values())


def _judge(index):
    """Best rules so far, carried along: the longer one stands, then the lesser pattern, then allow."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules: RuleIndex = index.value
        told = ["rule", "by_rule", "pattern", "by_pattern"]
        for batch in batches:
            out = []
            for whole, rule, by_rule, pattern, by_pattern in zip(*(batch.column(c).to_pylist() for c in ("whole", *told)), strict=True):
                for r in rules.best(whole):
                    if r.name is not None:
                        if rule is None or (-len(r.name), r.name, r.verdict) < (-len(rule), rule, by_rule):
                            rule, by_rule = r.name, r.verdict
                    elif pattern is None or (-len(r.pattern), r.pattern, r.verdict) < (-len(pattern), pattern, by_pattern):
                        pattern, by_pattern = r.pattern, r.verdict
                out.append((rule, by_rule, pattern, by_pattern))
            new = zip(*out, strict=True) if out else ((),) * 4
            kept = {c: batch.column(c) for c in batch.schema.names if c not in told}
            yield pa.record_batch(kept | {c: pa.array(v, pa.string()) for c, v in zip(told, new, strict=True)})

    return work


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = tuple(HOST_RULES + METHOD_RULES)) -> DataFrame:
    """A verdict for every url of ``pages(page_id, url)``: page_id, host, path, rule, pattern, verdict.

    ``rule`` is the longest host rule that fits, and its verdict holds.  Where none fits, the
    longest of the method's patterns that matches decides (``pattern``), and a url that matches
    none is allowed.  Equally long ones: the lesser by code points, then allow before block.
    Null urls and urls without ``://`` have an empty host and path, fit no host rule and are
    judged as empty texts.  Repeated rows and null ids are judged row by row; other columns
    are ignored; an empty table gives no rows.  Urls need not meet, so none is shuffled.
    """
    spark = pages.sparkSession
    host, path, whole = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), whole.alias("whole"))
    filed = rarest_tokens(rows, rules)
    none = F.lit(None).cast("string")
    rows = rows.select("*", none.alias("rule"), none.alias("by_rule"), none.alias("pattern"), none.alias("by_pattern"))
    schema = rows.schema
    for a in range(0, len(rules), RULES_A_PASS):
        index = spark.sparkContext.broadcast(RuleIndex(rules[a : a + RULES_A_PASS], filed[a : a + RULES_A_PASS]))
        rows = rows.mapInArrow(_judge(index), schema)
        if len(rules) > RULES_A_PASS:
            rows = settle(rows, "judged")
            index.unpersist()
    return rows.select("page_id", "host", "path", "rule", "pattern", F.coalesce("by_rule", "by_pattern", F.lit("allow")).alias("verdict"))


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _method_sql(s: str) -> str:
    """The method's patterns for the comparing engine, longest first."""
    order = sorted(METHOD_RULES, key=lambda r: (-len(r.pattern), r.pattern, r.verdict))
    cases = " ".join(f"when regexp_matches({s}, '{r.regex()}') then '{r.verdict}'" for r in order).replace(r"\Z", r"\z")
    return f"case {cases} else 'allow' end"


OP13_SQL = rf"""
with u as (
  select row_number() over () as rid, page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), h as (
  select rid, page_id, rest, translate(regexp_extract(rest, '\A[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host from u
), p as (
  select rid, page_id, host, substr(rest, length(host) + 1) as tail, regexp_extract(substr(rest, length(host) + 1), '\A[^?#]*') as path from h
), rules(verdict, rhost, rpath) as (
  values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fit as (
  select p.*, r.verdict, rhost || rpath as rule, row_number() over (partition by rid order by length(rhost || rpath) desc nulls last, rhost || rpath) as place
  from p left join rules r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
)
select page_id, host, path, rule, coalesce(verdict, {_method_sql("host || tail")}) as verdict from fit where place = 1
"""
