"""Operator 3, URL rules with redirect equivalence.

A rule (host and path prefix) fits its host and all subdomains; the longest wins.
URLs that redirect or point by a canonical link to one another, or that differ
only in scheme, fragment, trailing slash or tracking parameters, form a class:
connected components over those edges. A URL that no rule fits takes its class's
decision: allow where any member is explicitly allowed, else block where any is
blocked, else allow. Link targets are decoded and resolved against the page's URL
or its base element; those of schemes without :// (mailto:) link nothing. Rules
are asked about every URL of a class, whether a row has it or only a link or a
redirect.

Defined cases: a null URL or one without :// has an empty host and path, fits no
rule, is in no class and is allowed; rules of equal length prefer allow; repeated
rows and ids are judged each on its own; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save
from .components import connected_components

#: Rules up to this number go into the plan as literals; more are joined by host suffix.
MAX_LITERAL_RULES = 500
TRACKING = r"(^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&#]*"


def _lower(column):
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def _after_scheme(url):
    return F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url):
    return F.coalesce(_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url):
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url):
    """What URLs of one class by form have in common; null without a host."""
    query = F.regexp_replace(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), TRACKING, "$1")
    query = F.regexp_replace(F.regexp_replace(query, "&&+", "&"), "^&|&$", "")
    base = F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""))
    return F.when(host_of(url) != "", F.when(query != "", F.concat(base, F.lit("?"), query)).otherwise(base))


def _targets(html):
    """Canonical links and refresh targets in a page's mark-up."""
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical"))
    refresh = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh"))
    a = F.transform(links, lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    b = F.transform(refresh, lambda t: F.regexp_extract(t, r"(?i)url\s*=\s*[\"']?([^\"'\s>]+)", 1))
    return F.when(html.rlike(r"(?i)canonical|http-equiv"), F.transform(F.filter(F.concat(a, b), lambda t: t != ""), _decoded)).otherwise(F.array().cast("array<string>"))


def _let(value, use):
    """use(value) with the value computed once, so that nested uses do not multiply the plan."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _decoded(text):
    """Text of an attribute with its character references decoded: numbers and the five of XML."""
    out = F.regexp_replace(text, r"(?i)&(?:amp|#0*38|#x0*26);", "\u0001")  # an ampersand that comes from a reference begins no other
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
        out = F.regexp_replace(out, f"(?i)&{name};", sign)
    number = lambda r: F.when(F.lower(r).startswith("x"), F.lower(r.substr(2, 9))).otherwise(F.hex(r.cast("int")))
    sign = lambda r: F.decode(F.unhex(F.lpad(number(r), 8, "0")), "UTF-32")
    codes = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(r"&#([0-9]{1,6}|[xX]0{0,3}[0-9a-fA-F]{1,5});"), F.lit(1)))
    out = _let(out, lambda t: F.aggregate(codes(t), t, lambda x, r: F.replace(x, F.concat(F.lit("&#"), r, F.lit(";")), sign(r))))
    return F.replace(out, F.lit("\u0001"), F.lit("&"))


def _base(html):
    """The target of the first base element; empty without one."""
    tag = F.regexp_extract(html, r"(?is)<base\b[^>]*\bhref\s*=[^>]*>", 0)
    return F.regexp_extract(tag, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)


def _without_dots(path):
    """A path from the root with its . and .. steps taken."""
    steps = F.aggregate(
        F.split(path, "/", -1),
        F.array().cast("array<string>"),
        lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).when(s == ".", kept).otherwise(F.array_append(kept, s)),
    )
    return F.concat(F.lit("/"), F.regexp_replace(F.array_join(steps, "/"), "^/", ""))


def _resolve(target, url):
    """A target seen from a URL; null where it has a scheme without ://."""
    return _let(target, lambda t: _let(url, lambda u: _resolved(t, u)))


def _resolved(target, url):
    host, path = host_of(url), path_of(url)
    rest, tail = F.regexp_extract(target, "^[^?#]*", 0), F.regexp_extract(target, "^[^?#]*(.*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, "^.*/", 0))
    root = F.concat(F.lit("http://"), host)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(target.startswith("/"), F.concat(root, _without_dots(rest), tail))
        .when(target.startswith("?"), F.concat(root, path, tail))
        .when(target.startswith("#") | (target == ""), url)
        .otherwise(F.concat(root, _without_dots(F.concat(folder, rest)), tail))
    )


def with_rules(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds rule and rule_verdict to rows with id, host and path. rules: (verdict, host/path)."""
    split = [(v, r, r.partition("/")[0], "/" + r.partition("/")[2]) for v, r in rules]
    order = lambda r: (-len(r[1]), r[0] != "allow", r[1])
    if len(rules) <= MAX_LITERAL_RULES:
        rule = verdict = None
        for v, r, host, path in sorted(split, key=order):
            fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
            rule = F.when(fits, r) if rule is None else rule.when(fits, r)
            verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
        null = F.lit(None).cast("string")
        return pages.withColumn("rule", null if rule is None else rule).withColumn("rule_verdict", null if verdict is None else verdict)
    known = pages.sparkSession.createDataFrame(sorted(split, key=order), "rule_verdict string, rule string, rule_host string, rule_path string")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = pages.select("host").distinct().select("host", F.explode(suffixes).alias("rule_host"))
    fitting = hosts.join(known, "rule_host").groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.length("rule")).alias("n"), (F.col("rule_verdict") != "allow").alias("b"), "rule", "rule_path", "rule_verdict"))).alias("fitting"))
    chosen = F.expr("filter(fitting, r -> startswith(path, r.rule_path))[0]")
    out = pages.join(fitting, "host", "left").withColumn("_r", F.when(F.expr("exists(fitting, r -> startswith(path, r.rule_path))"), chosen))
    return out.withColumn("rule", F.col("_r.rule")).withColumn("rule_verdict", F.col("_r.rule_verdict")).drop("_r", "fitting")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """id, host, path, rule, verdict of every row; edges: further redirects (from_url, to_url)."""
    url = F.col(f"`{url_col}`")
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit("")) if html_col else F.lit("")
    targets = _targets(html) if html_col else F.array().cast("array<string>")
    aims = F.when(F.size(targets) > 0, F.struct(url.alias("url"), _decoded(_base(html)).alias("base")))
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"), address(url).alias("address"), targets.alias("targets"), aims.alias("aims"))
    rows = save(with_rules(rows, rules), "judged-urls")
    aimed = rows.where("size(targets) > 0 and address is not null").select("address", F.coalesce(_resolve(F.col("aims.base"), F.col("aims.url")), "aims.url").alias("base"), F.explode("targets").alias("to"))
    aimed = aimed.select("address", _resolve(F.col("to"), F.col("base")).alias("to"))
    links, ends = aimed.select(F.col("address").alias("a"), address(F.col("to")).alias("b")), aimed.select("to")
    if edges is not None:
        links = links.union(edges.select(address(F.col("from_url")), address(F.col("to_url"))))
        ends = ends.union(edges.select("from_url")).union(edges.select("to_url"))
    links = links.where("a is not null and b is not null")
    classes = connected_components(links)
    # URLs that only a link names have their own decision by the rules, as rows do
    to = F.col("to")
    named = with_rules(ends.select(host_of(to).alias("host"), path_of(to).alias("path"), address(to).alias("address")), rules)
    decisions = rows.select("address", "rule_verdict").union(named.select("address", "rule_verdict"))
    said = decisions.where("address is not null and rule_verdict is not null").groupBy("address").agg(F.max((F.col("rule_verdict") == "allow")).alias("allowed"), F.max((F.col("rule_verdict") == "block")).alias("blocked"))
    of_class = said.join(classes, said.address == classes.node, "left").groupBy(F.coalesce("component", "address").alias("class")).agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
    decided = of_class.where("blocked and not allowed").select("class")
    # back to addresses: members of the classes with edges, whose large classes an inner join lets Spark split, and what the class is named after
    members = classes.join(decided, classes.component == decided["class"]).select(F.col("node").alias("blocked_address"))
    blocked = members.union(decided).distinct()
    open_rows = rows.where("rule_verdict is null").join(blocked, F.col("address") == F.col("blocked_address"), "left")
    verdict = F.when(F.col("blocked_address").isNotNull(), "block").otherwise("allow")
    found = open_rows.select("_id", "host", "path", "rule", verdict.alias("verdict"))
    ruled = rows.where("rule_verdict is not null").select("_id", "host", "path", "rule", F.col("rule_verdict").alias("verdict"))
    return ruled.union(found).withColumnRenamed("_id", id_col)
