"""Host and registered-domain extraction as plain Spark expressions.

The registered domain is the label in front of the longest matching public suffix.
Suffix rules are grouped by their number of labels and looked up with ``IN``, which Spark
turns into a hash-set probe, so a URL is parsed in one projection: no shuffle, no join and
no Python, whether the rule list has a hundred entries or the full ten thousand.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprov.operators.ordering import broadcast_if_small

# Common public suffixes of two or more labels, wildcard rules and exceptions.
# A single-label suffix (com, org, de, ...) needs no entry: see SuffixRules.default_rule.
COMMON_SUFFIXES = """
ac.at co.at gv.at or.at
com.ar edu.ar gob.ar gov.ar net.ar org.ar
asn.au com.au edu.au gov.au id.au net.au org.au
com.br edu.br gov.br net.br org.br
ac.cn com.cn edu.cn gov.cn net.cn org.cn
com.co edu.co gov.co net.co org.co
com.eg edu.eg gov.eg
com.hk edu.hk gov.hk net.hk org.hk
ac.id co.id go.id or.id sch.id web.id
ac.il co.il gov.il net.il org.il
ac.in co.in edu.in gov.in net.in org.in res.in
ac.ir co.ir gov.ir
ac.jp ad.jp co.jp ed.jp go.jp gr.jp lg.jp ne.jp or.jp
ac.ke co.ke go.ke or.ke
ac.kr co.kr go.kr ne.kr or.kr re.kr
com.mx edu.mx gob.mx net.mx org.mx
com.my edu.my gov.my net.my org.my
com.ng edu.ng gov.ng org.ng
ac.nz co.nz geek.nz govt.nz net.nz org.nz school.nz
com.pe edu.pe gob.pe
com.ph edu.ph gov.ph
com.pk edu.pk gov.pk
com.pl edu.pl gov.pl net.pl org.pl
com.pt edu.pt gov.pt
com.ro org.ro
co.rs ac.rs edu.rs
com.ru org.ru
com.sa edu.sa gov.sa
com.sg edu.sg gov.sg net.sg org.sg
ac.th co.th go.th in.th or.th
com.tr edu.tr gov.tr org.tr
com.tw edu.tw gov.tw net.tw org.tw
com.ua edu.ua gov.ua kiev.ua net.ua org.ua
ac.uk co.uk gov.uk ltd.uk me.uk net.uk nhs.uk org.uk plc.uk police.uk
com.uy edu.uy
com.ve edu.ve
com.vn edu.vn gov.vn
ac.za co.za gov.za org.za
*.bd *.ck !www.ck *.er *.fj *.kh *.mm *.np
"""

_LABELS = re.compile(r"^[^\s'.\\/]+(\.[^\s'.\\/]+)*$")
_IPV4 = r"^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\\.|$)){4}$"

# Scheme and user info are optional; a bracketed IPv6 host is kept whole.
_SCHEME = r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"
_HOST = rf"^(?:{_SCHEME})?+(?:[^/?#]*@)?+(\[[^\]/?#]*\]|[^/?#:]+)"


@dataclass(frozen=True)
class SuffixRules:
    """Public-suffix rules, as sets of suffixes.

    ``default_rule`` treats the last label of any host as a suffix, so top-level domains
    need not be listed. Set it to False with a full list, which then decides alone.
    """

    plain: frozenset = field(default_factory=frozenset)
    wildcard: frozenset = field(default_factory=frozenset)
    exception: frozenset = field(default_factory=frozenset)
    default_rule: bool = True

    @classmethod
    def from_rules(cls, rules, default_rule: bool = True) -> SuffixRules:
        groups = {"plain": set(), "wildcard": set(), "exception": set()}
        for rule in rules:
            kind, name = "plain", rule.strip().lower()
            if name.startswith("*."):
                kind, name = "wildcard", name[2:]
            elif name.startswith("!"):
                kind, name = "exception", name[1:]
            if not _LABELS.match(name):
                raise ValueError(f"not a suffix rule: {rule!r}")
            groups[kind].add(name)
            if not name.isascii():
                groups[kind].add(name.encode("idna").decode("ascii"))
        return cls(*(frozenset(g) for g in groups.values()), default_rule=default_rule)

    @classmethod
    def common(cls) -> SuffixRules:
        return cls.from_rules(COMMON_SUFFIXES.split())

    @classmethod
    def from_file(
        cls,
        spark: SparkSession,
        path: str,
        private: bool = False,
        default_rule: bool = True,
    ) -> SuffixRules:
        """Read a list in the public-suffix file format (comments start with ``//``)."""
        text = spark.read.text(path, wholetext=True)
        lines = [ln.strip() for row in text.collect() for ln in row.value.splitlines()]
        if not private:
            mark = next((i for i, ln in enumerate(lines) if "BEGIN PRIVATE DOMAINS" in ln), None)
            lines = lines[:mark]
        rules = [ln.split()[0] for ln in lines if ln and not ln.startswith("//")]
        return cls.from_rules(rules, default_rule=default_rule)

    @classmethod
    def from_table(cls, rules: DataFrame, column: str = "rule", default_rule: bool = True,
                   most: int = 100_000) -> SuffixRules:
        """Rules from a column of a table. A table of more than ``most`` is for ``domains_by_join``."""
        rows = rules.select(column).where(F.col(column).isNotNull()).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} suffix rules: join them with domains_by_join")
        return cls.from_rules([r[0] for r in rows], default_rule=default_rule)

    def by_depth(self, kind: str) -> dict[int, list[str]]:
        out = defaultdict(list)
        for name in sorted(getattr(self, kind)):
            out[name.count(".") + 1].append(name)
        return dict(out)


def _named(rules: SuffixRules | None) -> SuffixRules:
    if rules is None:
        raise ValueError("say which suffixes count: SuffixRules.from_file, from_table, from_rules or common()")
    return rules


def _clean_host(host: str, keep_case: bool) -> str:
    host = f"trim({host})" if keep_case else f"lower(trim({host}))"
    return f"nullif(trim(TRAILING '.' FROM {host}), '')"


def url_host_sql(url: str, keep_case: bool = False) -> str:
    """SQL text for the host of the URL expression ``url``; NULL when there is none."""
    return _clean_host(f"regexp_extract(trim({url}), r'{_HOST}', 1)", keep_case)


def _authority_sql(url: str) -> str:
    """What ``url_host_sql`` reads before host and port, by plain cuts of a URL column."""
    rest = (
        f"CASE WHEN startswith({url}, 'https://') THEN substr({url}, 9) "
        f"WHEN startswith({url}, 'http://') THEN substr({url}, 8) "
        f"ELSE regexp_replace(trim({url}), r'^{_SCHEME}', '') END"
    )
    for mark in "/?#":
        rest = f"substring_index({rest}, '{mark}', 1)"
    return f"substring_index({rest}, '@', -1)"


def _authority_host(authority: str, keep_case: bool) -> str:
    a = authority
    host = (
        f"CASE WHEN startswith({a}, '[') AND contains({a}, ']') "
        f"THEN substring_index({a}, ']', 1) || ']' ELSE substring_index({a}, ':', 1) END"
    )
    return _clean_host(host, keep_case)


def _in(value: str, names: list[str]) -> str:
    return f"{value} IN ({', '.join(repr(n) for n in names)})"


def _suffix_branches(tail_of, rules: SuffixRules, fold: bool) -> list[tuple[str, int]]:
    """(condition, labels in the suffix), in order of precedence."""
    plain, wild, exc = (rules.by_depth(k) for k in ("plain", "wildcard", "exception"))

    def tail(n: int) -> str:
        return f"lower({tail_of(n)})" if fold else tail_of(n)

    branches = [(_in(tail(n), exc[n]), n - 1) for n in sorted(exc, reverse=True)]
    deepest = max([*plain, *(n + 1 for n in wild), 0])
    for n in range(deepest, 0, -1):
        options = []
        if n in plain:
            options.append(_in(tail(n), plain[n]))
        if n - 1 in wild:
            options.append(f"({_in(tail(n - 1), wild[n - 1])} AND {tail(n)} <> {tail(n - 1)})")
        if options:
            branches.append((" OR ".join(options), n))
    return branches


def _last_labels(h: str, n: int) -> str:
    return f"substring_index({h}, '.', -{n})"


def _domain_case(h: str, rules: SuffixRules | None, strict_parity: bool, tail=None) -> str:
    """Domain of the host named ``h``; ``tail(n)`` is the SQL for its last n labels.

    Both are repeated, so they should be columns or variables.
    """
    rules = _named(rules)
    tail = tail or (lambda n: _last_labels(h, n))
    # Only a last label that begins with a digit is worth the full test for an IPv4 address.
    is_ip = (
        f"(startswith({h}, '[') OR "
        f"({tail(1)} >= '0' AND {tail(1)} < ':' AND {h} RLIKE '{_IPV4}'))"
    )
    cases = []
    if strict_parity:
        cases.append(f"WHEN {h} IS NULL THEN '.' WHEN {is_ip} THEN {h} || '.'")
        for cond, n in _suffix_branches(tail, rules, fold=True):
            cases.append(
                f"WHEN {cond} THEN if({tail(n + 1)} = {tail(n)}, '.' || {h}, {tail(n + 1)})"
            )
        last = f"{tail(1)} || '.'"
        if rules.default_rule:
            last = f"if({tail(2)} = {tail(1)}, {last}, {tail(2)})"
        cases.append(f"ELSE {last}")
    else:
        cases.append(f"WHEN {is_ip} THEN NULL")
        for cond, n in _suffix_branches(tail, rules, fold=False):
            cases.append(f"WHEN {cond} THEN nullif({tail(n + 1)}, {tail(n)})")
        cases.append(f"ELSE nullif({tail(2)}, {tail(1)})" if rules.default_rule else "ELSE NULL")
    return f"CASE {' '.join(cases)} END"


def domain_sql(host: str, rules: SuffixRules | None = None, strict_parity: bool = False) -> str:
    """SQL text for the registered domain of the host expression ``host``.

    By default an IP address, a single label, and a host that is itself a suffix give NULL.
    ``strict_parity`` instead joins the two parts with a dot whatever they are, so that
    ``localhost`` gives ``localhost.`` and a missing host gives ``.``; letter case is kept.

    The host is bound to a lambda variable, so that its expression appears only once.
    """
    return f"transform(array({host}), h -> {_domain_case('h', rules, strict_parity)})[0]"


def bind(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns that later steps may use many times but that are worked out once.

    A one-element generator stays inside whole-stage codegen, and the optimizer does not
    copy its expressions into filters and projections above it.
    """
    cells = F.struct(*[v.alias(f"_bound_{k}") for k, v in values.items()])
    bound = df.select("*", F.inline(F.array(cells))).drop(*values)
    return bound.withColumnsRenamed({f"_bound_{k}": k for k in values})


def _bound_domain(df: DataFrame, host: str, domain: str, rules: SuffixRules | None,
                  strict_parity: bool) -> DataFrame:
    """Domain of a host column, with the host's tails bound first."""
    rules = _named(rules)
    depths = [n for k in ("plain", "wildcard", "exception") for n in rules.by_depth(k)]
    tails = {f"_tail{n}": F.expr(_last_labels(f"`{host}`", n))
             for n in range(1, max([*depths, 1]) + 3)}
    case = _domain_case(f"`{host}`", rules, strict_parity, lambda n: f"_tail{n}")
    return bind(df, **tails).withColumn(domain, F.expr(case)).drop(*tails)


def with_host(df: DataFrame, url: str = "url", strict_parity: bool = False,
              host: str = "host") -> DataFrame:
    """Add the host column to a table of URLs (see ``url_host_sql``).

    The host is cut out in two bound steps, at half the cost of the one regular expression
    that ``url_host_sql`` needs.
    """
    cut = bind(df, _authority=F.expr(_authority_sql(f"`{url}`")))
    return bind(cut, **{host: F.expr(_authority_host("_authority", strict_parity))}).drop("_authority")


def with_domain(
    df: DataFrame,
    url: str = "url",
    rules: SuffixRules | None = None,
    strict_parity: bool = False,
    host: str = "host",
    domain: str = "domain",
) -> DataFrame:
    """Add host and registered-domain columns to a table of URLs (see ``domain_sql``).

    ``rules`` must be given: which suffixes count decides what a domain is.
    """
    found = with_host(df, url, strict_parity, host)
    return _bound_domain(found, host, domain, rules, strict_parity)


def host_to_domain(df: DataFrame, host: str, domain: str = "domain",
                   rules: SuffixRules | None = None) -> DataFrame:
    """Add the registered domain of an existing host column."""
    folded = bind(df, _host=F.lower(F.col(host)))
    return _bound_domain(folded, "_host", domain, rules, False).drop("_host")


def domains_by_join(df: DataFrame, host: str, rules: DataFrame, column: str = "rule",
                    domain: str = "domain", default_rule: bool = True) -> DataFrame:
    """Add the registered domain of a host column by a join with a table of suffix rules.

    Gives what ``with_domain`` gives with these rules, for a list of any length. Each distinct
    host meets the rules with each of its ends, as many as the longest rule has labels, and its
    longest match counts, or its exception. The rules are broadcast after a check of their
    size; else the ends are shuffled to them.
    """
    rule = F.lower(F.trim(F.col(f"`{column}`")))
    wild, exception = F.startswith(rule, F.lit("*.")), F.startswith(rule, F.lit("!"))
    key = F.when(wild, F.substr(rule, F.lit(3))).when(exception, F.substr(rule, F.lit(2))).otherwise(rule)
    entries = rules.where(rule != "").select(
        key.alias("key"), exception.alias("exception"), wild.alias("wild"),
        (F.size(F.split(key, r"\.")) + F.when(wild, 1).when(exception, -1).otherwise(0)).alias("suffix")).distinct()
    deepest = entries.agg(F.max(F.size(F.split("key", r"\.")))).first()[0] or 0
    hosts = df.select(F.lower(F.col(f"`{host}`")).alias("h")).where("h is not null").distinct()
    hosts = hosts.withColumn("labels", F.size(F.split("h", r"\.")))
    ends = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("labels", F.lit(deepest)))),
        lambda n: F.array_join(F.slice(F.split("h", r"\."), -n, n), "."))
    met = hosts.select("h", "labels", F.explode(ends).alias("key")).join(broadcast_if_small(entries), "key")
    met = met.where(~F.col("wild") | (F.col("labels") >= F.col("suffix")))
    best = met.groupBy("h").agg(F.max(F.struct("exception", "suffix"))["suffix"].alias("suffix"))
    n = F.coalesce("suffix", F.lit(1 if default_rule else None).cast("int"))
    parts = F.split("h", r"\.")
    found = F.when(F.size(parts) > n, F.array_join(F.slice(parts, -(n + 1), n + 1), "."))
    is_ip = F.startswith("h", F.lit("[")) | F.expr(f"h RLIKE '{_IPV4}'")
    known = hosts.join(best, "h", "left").select("h", F.when(~is_ip, found).alias(domain))
    return df.drop(domain).join(known, F.lower(F.col(f"`{host}`")) == F.col("h"), "left").drop("h")


def register_domain_functions(
    spark: SparkSession, rules: SuffixRules | None = None, strict_parity: bool = False
) -> None:
    """Make ``url_host(url)`` and ``extract_domain(url)`` callable from SQL.

    They are SQL functions, so the optimizer inlines them; a NULL URL gives NULL. What is used
    many times is an argument of an inner function, so it is worked out once, by plain cuts.
    """
    rules = _named(rules)
    depths = [n for k in ("plain", "wildcard", "exception") for n in rules.by_depth(k)]
    tails = range(1, max([*depths, 1]) + 3)

    def function(name: str, parameters: list[str], body: str) -> None:
        listed = ", ".join(f"{p} STRING" for p in parameters)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({listed}) RETURNS STRING RETURN {body}")

    function("_authority_host", ["authority"], _authority_host("authority", strict_parity))
    function("url_host", ["url"], f"_authority_host({_authority_sql('url')})")
    case = _domain_case("host", rules, strict_parity, lambda n: f"tail{n}")
    function("_tails_domain", ["host", *[f"tail{n}" for n in tails]], case)
    function("host_domain", ["host"], f"_tails_domain(host, {', '.join(_last_labels('host', n) for n in tails)})")
    function("extract_domain", ["url"], "CASE WHEN url IS NOT NULL THEN host_domain(url_host(url)) END")
