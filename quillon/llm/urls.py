"""URLs allowed or blocked: by the longest rule that fits, else by gradient-boosted trees on lexical features.

Features are whole numbers made from the text alone: lengths of URL and host, depth of the path, hyphens and digits of
the host, digits and entropy, parameters, and statistics of the host's suffix (how many labelled URLs with it are
blocked).  Trees are trained from labelled URLs; where a caller has none, ``made_urls`` makes some by rule.  All of it is
DataFrame and SQL functions: rules, features, histograms and trees are expressions that Spark compiles.

Defined cases: a null URL and one without ``://`` have empty host and path, fit no rule and are judged by the method
from what text they have; ids are whole numbers and may be null or repeat, each row being judged by itself; texts
of any length are read whole; an empty table gives no rows; further columns are ignored; labelled URLs of one verdict
alone give a model that always says so.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.errors import DataError
from quillon.llm import boosting
from quillon.llm.common import durable, passing

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most rules that are compiled into one expression.
RULES = 1000
#: A suffix has statistics of its own from this share of the labelled URLs on: at most its inverse have.
SUFFIX_SHARE = 1e-3
FEATURES = ["length", "host_length", "depth", "digit_ratio", "host_digits", "hyphens", "entropy", "host_entropy", "params", "suffix_rate", "suffix_share"]


def _text(url: Column) -> Column:
    return F.coalesce(url.cast("string"), F.lit(""))


def host_of(url: Column) -> Column:
    """Behind the first ``://`` up to a slash, question mark, hash or the end, A to Z in lower case."""
    rest = F.coalesce(F.get(F.split(_text(url), "://", 2), F.lit(1)), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.coalesce(F.get(F.split(_text(url), "://", 2), F.lit(1)), F.lit(""))
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits; of equally long ones that with the longer host, then the lesser text."""
    if len(rules) > RULES:
        raise DataError(f"{len(rules)} rules; {RULES} are the most")
    cases = []
    for verdict, rule in sorted(set(rules), key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0]), r[1], r[0])):
        own, slash, below = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + below)
        cases.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*cases) if cases else F.lit(None).cast("struct<rule:string,verdict:string>")


# --- features ------------------------------------------------------------------------------------


def entropy(text: Column) -> Column:
    """Hundredths of bits a character: equal characters lie together once sorted, and their runs are added up."""
    chars = F.sort_array(F.filter(F.split(text, ""), lambda c: c != ""))
    start = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0.0).alias("sum"))

    def whole(run):
        return F.when(run > 1, run * F.log2(run.cast("double"))).otherwise(0.0)

    def step(s, c):
        same = c == s["last"]
        return F.struct(c.alias("last"), F.when(same, s["run"] + 1).otherwise(F.lit(1).cast("long")).alias("run"), F.when(same, s["sum"]).otherwise(s["sum"] + whole(s["run"])).alias("sum"))

    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    bits = F.aggregate(chars, start, step, lambda s: s["sum"] + whole(s["run"]))
    return F.round(100 * (F.log2(n) - bits / n)).cast("long")


def _suffixes(host: Column) -> list[Column]:
    """The host's last two labels and its last one."""
    return [F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)]


@dataclass(frozen=True)
class Suffixes:
    """(suffix, blocked in a thousand, thousandths of all) of suffixes that are seen often enough, and the whole's rate."""

    known: tuple[tuple[str, int, int], ...]
    rate: int

    def columns(self, host: Column) -> list[Column]:
        if not self.known:
            return [F.lit(self.rate), F.lit(0)]
        tables = [F.create_map(*[x for row in self.known for x in (F.lit(row[0]), F.lit(row[i]))]) for i in (1, 2)]
        return [F.coalesce(*[F.try_element_at(t, s) for s in _suffixes(host)], F.lit(other)) for t, other in zip(tables, (self.rate, 0))]


def learned_suffixes(labelled: DataFrame, url: str, blocked: str) -> Suffixes:
    rows = labelled.select(F.col(blocked).cast("long").alias("y"), host_of(F.col(url)).alias("host"))
    total = rows.agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("y")).first()
    if not total["n"]:
        return Suffixes((), 500)
    rate = 1000 * total["y"] // total["n"]
    seen = rows.select("y", F.explode(F.array_distinct(F.array(*_suffixes(F.col("host"))))).alias("suffix")).groupBy("suffix").agg(F.count("y").alias("n"), F.sum("y").alias("y"))
    often = seen.where((F.col("n") >= SUFFIX_SHARE * total["n"]) & (F.col("suffix") != "")).collect()
    # Twenty URLs of the common rate are added to each, so that few don't decide.
    return Suffixes(tuple(sorted((r["suffix"], (1000 * r["y"] + 20 * rate) // (r["n"] + 20), 1000 * r["n"] // total["n"]) for r in often)), rate)


def with_features(rows: DataFrame, url: str, suffixes: Suffixes, *kept) -> DataFrame:
    """The kept columns, host, path and FEATURES."""
    # Behind generators, so that what many features use is made once.
    parts = rows.select(*kept, F.explode(F.array(F.struct(_text(F.col(url)).alias("text"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")))).alias("_p"))
    text, host, path = (F.col(f"_p.{c}") for c in ("text", "host", "path"))
    query = F.regexp_extract(text, r"^[^?#]*\?([^#]*)", 1)
    rate, share = suffixes.columns(host)

    def without(column, letters):
        return F.length(column) - F.length(F.translate(column, letters, ""))

    made = {
        "length": F.length(text),
        "host_length": F.length(host),
        "depth": without(path, "/"),
        "digit_ratio": F.floor(1000 * without(text, "0123456789") / F.greatest(F.length(text), F.lit(1))),
        "host_digits": without(host, "0123456789"),
        "hyphens": without(host, "-"),
        "entropy": entropy(text),
        "host_entropy": entropy(host),
        "params": F.when(query == "", 0).otherwise(1 + without(query, "&")),
        "suffix_rate": rate,
        "suffix_share": share,
    }
    each = F.struct(*[made[f].cast("long").alias(f) for f in FEATURES])
    return parts.select(*[c for c in parts.columns if c != "_p"], host.alias("host"), path.alias("path"), F.explode(F.array(each)).alias("_f")).select(*[c for c in parts.columns if c != "_p"], "host", "path", "_f.*")


# --- training and judging ------------------------------------------------------------------------


@dataclass(frozen=True)
class UrlModel:
    suffixes: Suffixes
    trees: boosting.Model


def train(labelled: DataFrame, url: str = "url", blocked: str = "blocked", trees: int = 12) -> UrlModel:
    """A model from labelled URLs; ``blocked`` is 1 or true for those to block, rows without a label are left out."""
    with passing(labelled.sparkSession):
        rows = durable(labelled.select(F.col(url).alias("url"), F.col(blocked).cast("int").alias("blocked")).where("blocked IS NOT NULL"), "labelled_urls")
        suffixes = learned_suffixes(rows, "url", "blocked")
        return UrlModel(suffixes, boosting.fit(with_features(rows, "url", suffixes, "blocked"), FEATURES, "blocked", trees))


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: UrlModel, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score (the method's, of blocking) for each row."""
    found = with_features(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("_url")), "_url", model.suffixes, "page_id")
    ruled = found.select("page_id", "host", "path", fitting(F.col("host"), F.col("path"), rules).alias("_r"), F.round(model.trees.probability(), 6).alias("score"))
    verdict = F.coalesce(F.col("_r.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "score")
