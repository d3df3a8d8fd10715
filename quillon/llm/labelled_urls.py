"""Labelled URLs made by rule, for want of a table that has any: a URL's number decides all of it.

URLs to allow have hosts of one made-up word, now and then of two, below common subdomains and suffixes.  URLs to block have
hosts of two or three trade words with hyphens, of random letters and digits, or of numbers.  Half of them have the paths and
parameters of the others, so that hosts alone have to tell them; the rest have long random paths or many parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: URLs that a model learns from where none are given.
LABELLED = 8000
SYLLABLES = "ba be bo ca ce co da de do fa fe fo ga ge gi la le li ma me mi na ne no pa pe po ra re ri sa se so ta te ti va ve vi thal stra brin mund kell torn wick land ford ster".split()
TRADE = "best buy cash cheap click credit deal diet dating easy fast free game gold hot huge jackpot loan lucky mega money offer online pharma pill play poker porn prize promo replica sale sexy slot spam super top track traffic viagra vip watch win xxx ads bet bets casino adult farm bonus".split()
SUBDOMAINS = ["", "", "", "www.", "www.", "blog.", "m.", "news.", "en."]
SUFFIXES = ["com", "com", "com", "org", "net", "de", "fr", "es", "info", "co.uk", "example.com", "example.org", "example.net"]
SECTIONS = ["en", "de", "fr", "es", "news", "wiki", "article", "p", "blog", "2021", "item", "docs"]


def _number(salt: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(n)).cast("int")


def _one(salt: str, choices: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in choices]), _number(salt, len(choices)) + 1)


def _word(salt: str) -> Column:
    parts = [_one(f"{salt}{i}", SYLLABLES) for i in range(3)]
    return F.concat(parts[0], parts[1], F.when(_number(f"{salt}n", 2) == 0, parts[2]).otherwise(""))


def _random(salt: str, least: int, most: int) -> Column:
    return F.substr(F.md5(F.concat(F.col("id").cast("string"), F.lit(salt))), F.lit(1), F.lit(least) + _number(f"{salt}l", most - least + 1))


def made_urls(spark: SparkSession, n: int = LABELLED, first: int = 0) -> DataFrame:
    """id, url, blocked: ``n`` URLs with the numbers from ``first`` on, the odd ones to block."""
    rows = spark.range(first, first + n, 1, 4)
    word = _word("w")
    kept_host = F.when(_number("two", 16) == 0, F.concat(word, F.lit("-"), _word("v"))).when(_number("digit", 20) == 0, F.concat(word, _number("d", 99).cast("string"))).otherwise(word)
    trade = [_one(f"t{i}", TRADE) for i in range(3)]
    bad_host = (
        F.when(_number("kind", 10) < 5, F.concat_ws("-", trade[0], trade[1]))
        .when(_number("kind", 10) < 7, F.concat_ws("-", *trade))
        .when(_number("kind", 10) < 8, F.concat(F.concat_ws("-", trade[0], trade[1]), _number("bd", 999).cast("string")))
        .otherwise(_random("h", 8, 24))
    )
    numbers = F.concat_ws(".", *[(_number(f"ip{i}", 223) + 1).cast("string") for i in range(4)])
    slug = F.concat_ws("-", _word("s1"), _word("s2"), _word("s3"))
    section = _one("sec", SECTIONS)
    plain_path = (
        F.when(_number("path", 8) < 3, F.concat(F.lit("/"), section, F.lit("/"), _number("no", 1000).cast("string")))
        .when(_number("path", 8) == 3, F.concat(F.lit("/"), section, F.lit("/"), _number("no", 1000).cast("string"), F.lit(".html")))
        .when(_number("path", 8) == 4, F.concat(F.lit("/"), section, F.lit("/"), _number("no", 1000).cast("string"), F.lit("/")))
        .when(_number("path", 8) == 5, F.concat(F.lit("/"), section, F.lit("/"), slug))
        .when(_number("path", 8) == 6, F.concat(F.lit("/"), _word("p1"), F.lit("/"), _word("p2"), F.lit("/"), slug, F.lit(".html")))
        .otherwise(F.lit("/"))
    )
    plain_query = (
        F.when(_number("q", 8) == 0, F.concat(F.lit("?page="), _number("pg", 30).cast("string"), F.lit("&ref=x")))
        .when(_number("q", 8) == 1, F.lit("?utm_source=feed"))
        .when(_number("q", 8) == 2, F.lit("#top"))
        .when(_number("q", 8) == 3, F.concat(F.lit("?id="), _number("qi", 99999).cast("string")))
        .otherwise("")
    )
    odd_path = F.concat(F.lit("/"), _random("o1", 8, 32), F.when(_number("deep", 2) == 0, F.concat(F.lit("/"), _random("o2", 4, 20), F.lit("/"), _random("o3", 4, 20))).otherwise(""))
    odd_query = F.concat(F.lit("?"), *[F.concat(F.lit(f"&{k}="), _random(k, 4, 24)) for k in ("sid", "aff", "cid", "sub", "r")])
    blocked = F.pmod("id", F.lit(2)) == 1
    plain = ~blocked | (_number("hidden", 2) == 0)
    scheme = F.when(_number("scheme", 3) == 0, "http://").otherwise("https://")
    host = F.when(blocked, F.when(_number("ip", 16) == 0, numbers).otherwise(F.concat(_one("sub", SUBDOMAINS), bad_host, F.lit("."), _one("suffix", SUFFIXES)))).otherwise(F.concat(_one("sub", SUBDOMAINS), kept_host, F.lit("."), _one("suffix", SUFFIXES)))
    rest = F.when(plain, F.concat(plain_path, plain_query)).otherwise(F.concat(odd_path, odd_query))
    return rows.select("id", F.concat(scheme, host, rest).alias("url"), blocked.cast("int").alias("blocked"))
