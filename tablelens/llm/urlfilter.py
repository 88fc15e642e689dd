"""URL filters: pattern rules indexed by their rarest literal token (DataFrame operations only).

Every rule is a regular expression plus the literal tokens (runs of a-z and 0-9) that any
URL it fits must hold as whole tokens. The corpus tells how many URLs hold each token; a
rule is filed under its rarest one. A URL's tokens then fetch candidate rules by an
equi-join, and only those candidates run their regular expression. Rules without a literal
token are filed under the empty token, which every URL holds.

Order of decision: host/path rules (longest first, a tie by text), then pattern rules
(block before allow, then the longest), else ``default``.

Defined results: a null URL or one without ``://`` has empty host and path and fits no
host rule; input columns named like a result are replaced; pattern rules still see the text after lower-casing A-Z (null: none); repeated
rows each keep their verdict; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import col, query, stable, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Beyond this many rules the rule index is shuffled, not broadcast (a rule is under 1 KB).
BROADCAST_RULES = 20_000

#: ``(action, host and path prefix)`` as the contract gives them.
HOST_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
              ("allow", "com/fr/"), ("block", "com/de/")]


def host_words(action: str, *words: str) -> tuple[str, str, tuple[str, ...]]:
    """``(action, pattern, literal tokens)`` of a rule over the lower-cased URL: the host holds ``words``, joined by
    hyphens, as whole labels or parts of labels. Pattern and tokens come from the same words, so that no
    match lacks a token that the rule may be filed under."""
    if not words or not all(re.fullmatch("[a-z0-9]+", w) for w in words):
        raise ValueError(f"words of a-z and 0-9 wanted: {words}")
    return action, r"^[a-z]+://([^/?#]*[.-])?" + "-".join(words) + r"([.-][^/?#]*)?([/?#]|$)", tuple(dict.fromkeys(words))


#: Words of a host name that unwanted sites carry.
PATTERN_RULES = [host_words("block", *w) for w in (("casino",), ("pills",), ("adult", "x"), ("free", "bets"), ("ads", "track"),
                                                   ("spam", "farm"))]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.when(has, host).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def host_rule(action: str, rule: str) -> tuple[str, str, str, tuple[str, ...], int]:
    """A host/path rule as a pattern over ``host + path``: the host itself or any subdomain,
    and a path that starts with the rule's."""
    host, slash, path = rule.partition("/")
    pattern = r"(?s)^([^/]*\.)?" + re.escape(host.lower()) + re.escape(slash + path)
    # The path's last token may go on in the URL ("en/1" fits "en/12"), so it is no whole token.
    closed = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.lower())
    tokens = tuple(dict.fromkeys(re.findall(r"[a-z0-9]+", host.lower()) + closed))
    return action, rule, pattern, tokens, 0


def rule_table(spark: SparkSession, host_rules, pattern_rules) -> DataFrame:
    rows = [host_rule(*r) for r in host_rules]
    rows += [(a, p, p, tuple(t), 1) for a, p, t in pattern_rules]
    schema = "action string, rule string, pattern string, tokens array<string>, kind int"
    return spark.createDataFrame([(*r[:3], list(r[3]), r[4]) for r in rows], schema)


def judge_urls(df: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES, url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """``df`` with ``url_host, url_path, url_rule, url_verdict`` added (in place of input columns of these names,
    whatever their case); see the module text."""
    spark = df.sparkSession
    urls = df.select(col(url_col).cast("string").alias("u")).where("u IS NOT NULL").distinct()
    host, path = host_path(F.col("u"))
    low = F.translate("u", UPPER, LOWER)
    # host + path for host rules, the whole lower-cased URL for pattern rules
    seen = urls.select("u", F.concat(host, path).alias("site"), low.alias("low"), F.array_union(
        F.array(F.lit("")), F.expr(f"regexp_extract_all(translate(u, '{UPPER}', '{LOWER}'), '[a-z0-9]+', 0)"))
        .alias("tokens"))
    hits = seen.select("u", "site", "low", F.explode("tokens").alias("token"))

    rules = rule_table(spark, host_rules, pattern_rules)
    n_rules = len(host_rules) + len(pattern_rules)
    small = n_rules <= BROADCAST_RULES
    hint = F.broadcast if small else (lambda x: x)
    words = rules.select(F.explode("tokens").alias("token")).distinct()
    rarity = hits.join(hint(words), "token").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    # One row per rule: its rarest token (no URL at all: rarest; ties by the token itself).
    filed = (rules.withColumn("rid", F.xxhash64("kind", "rule", "action"))
             .select("*", F.explode_outer("tokens").alias("token"))
             .join(rarity, "token", "left")
             .groupBy("rid", "action", "rule", "pattern", "kind")
             .agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"),
                                 F.coalesce("token", F.lit("")).alias("token"))).alias("rarest"))
             .select("action", "rule", "pattern", "kind", F.col("rarest.token").alias("token")))
    filed = stable(filed)          # as many rows as rules; written so that the rarity pass runs once
    fits = (hits.join(hint(filed), "token")
            .where(F.expr("CASE WHEN kind = 0 THEN site RLIKE pattern ELSE low RLIKE pattern END")))
    best = fits.groupBy("u").agg(F.max(F.struct(
        (-F.col("kind")).alias("k"),
        F.when(F.col("kind") == 0, F.length("rule")).otherwise((F.col("action") == "block").cast("int")).alias("w"),
        F.length("rule").alias("n"), "rule", "action")).alias("best"))
    added = ("url_host", "url_path", "url_rule", "url_verdict")
    keep = [col(c) for c in df.columns if c.lower() not in added]
    rows = df.select(F.struct(*keep, F.lit(0).alias("rows__")).alias("row"), col(url_col).cast("string").alias("key"))
    h, p = host_path(F.col("key"))
    return (rows.join(best, F.col("key") == F.col("u"), "left")
            .select("row.*", h.alias("url_host"), p.alias("url_path"),
                    F.when(F.col("best.k") == 0, F.col("best.rule")).alias("url_rule"),
                    F.coalesce("best.action", F.lit(default)).alias("url_verdict")).drop("rows__"))


def _sql(host_rules, pattern_rules) -> str:
    ordered = sorted(host_rules, key=lambda r: (len(r[1]), r[1]), reverse=True)
    fit, act = [], []
    for action, rule in ordered:
        h, s, p = rule.partition("/")
        cond = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{s}{p}')"
        fit.append(f"WHEN {cond} THEN '{rule}'")
        act.append(f"WHEN rule = '{rule}' THEN '{action}'")
    pat = " OR ".join(f"regexp_matches(low, '{p}')" for a, p, _ in pattern_rules if a == "block")
    return f"""
WITH a AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS after FROM pages),
b AS (
  SELECT page_id, low, translate(regexp_extract(after, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(after, '^[^/?#]*(/[^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE {' '.join(fit)} ELSE NULL END AS rule FROM b)
SELECT page_id, host, path, rule,
       CASE {' '.join(act)} WHEN {pat} THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""


OP9_SQL = _sql(HOST_RULES, PATTERN_RULES)


@query("op9_url_filters", OP9_SQL)
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select(
        "page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"),
        F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))
