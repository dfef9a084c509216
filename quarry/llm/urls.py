"""URL filters: host rules plus a weighted vocabulary matched by Aho-Corasick.

Cases: a null url or one without ``://`` has empty host and path, fits no rule
and is allowed unless its own characters hold rejected terms (a null url holds
none).  Ties between rules go to the longer ``host + path``, then to the rule
listed first.  Repeated rows each get their own result; extra columns of the
input pass unread.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from quarry.llm.common import prepare

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (action, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: One whole-term hit rejects.
STRICT_TERMS = ("adult-x", "camgirls", "hentai", "malware", "phishing", "porn", "spam-farm", "warez", "xxx")
#: ``SOFT_LIMIT`` different whole-term hits reject.
SOFT_TERMS = ("adult", "bet", "bets", "bonus", "casino", "cheap", "escort", "farm", "free", "jackpot", "lottery",
              "pills", "poker", "sex", "slots", "spam", "viagra", "win")
SOFT_LIMIT = 2


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``: the host is what lies between the first
    ``://`` and the next ``/``, ``?`` or ``#``, with A-Z lower-cased; the path
    runs from there to ``?``, ``#`` or the end."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return df.withColumns({"host": F.translate(raw, UPPER, LOWER), "path": path})


def rule_columns(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule text, its action) of the longest rule that fits, else nulls."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer ones override
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, action = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(act)).otherwise(action)
    return text, action


def term_counter(strict: Sequence[str], soft: Sequence[str]):
    """A scalar UDF url -> (n_strict, n_soft): whole-term hits of strict terms
    and number of different soft terms.  A hit counts when neither neighbour
    is an ASCII letter or digit."""
    schema = T.StructType([T.StructField("n_strict", T.IntegerType()), T.StructField("n_soft", T.IntegerType())])

    @F.pandas_udf(schema)
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        terms = ahocorasick.Automaton()
        for kind, words in (("soft", soft), ("strict", strict)):
            for w in words:
                terms.add_word(w, (kind, w))
        if len(terms):
            terms.make_automaton()
        edge = set("abcdefghijklmnopqrstuvwxyz0123456789")

        def one(url: str | None) -> tuple[int, int]:
            if not url or not len(terms):
                return 0, 0
            s, n, seen = url.lower(), 0, set()
            for end, (kind, w) in terms.iter(s):
                a, b = end - len(w), end + 1
                if (a >= 0 and s[a] in edge) or (b < len(s) and s[b] in edge):
                    continue
                if kind == "strict":
                    n += 1
                else:
                    seen.add(w)
            return n, len(seen)

        for urls in batches:
            yield pd.DataFrame([one(u) for u in urls], columns=["n_strict", "n_soft"])

    return count


def judge_urls(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
               strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS,
               soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """Adds host, path, rule, verdict, n_strict, n_soft to every row of ``pages``."""
    prepare(pages.sparkSession)
    rule, action = rule_columns(rules, F.col("host"), F.col("path"))
    hits = term_counter(strict, soft)
    rejected = (F.col("__hits.n_strict") > 0) | (F.col("__hits.n_soft") >= soft_limit)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "n_strict", "n_soft")]
    return (with_host_path(pages.select(*(F.col(f"`{c}`") for c in kept)), url)
            .withColumn("__hits", hits(F.col(url)))
            .select(*(F.col(f"`{c}`") for c in kept), "host", "path", rule.alias("rule"),
                    F.coalesce(action, F.when(rejected, "block").otherwise("allow")).alias("verdict"),
                    F.col("__hits.n_strict").alias("n_strict"), F.col("__hits.n_soft").alias("n_soft")))


def oracle(rules=RULES, strict=STRICT_TERMS, soft=SOFT_TERMS, soft_limit: int = SOFT_LIMIT) -> str:
    """DuckDB twin over ``pages``."""
    def hit(w: str) -> str:
        return f"regexp_matches(u, '(^|[^a-z0-9]){w}($|[^a-z0-9])')"

    fits = [(h + p, a, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))")
            for a, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for t, _, c in fits) + " END"
    action = "CASE " + " ".join(f"WHEN {c} THEN '{a}'" for _, a, c in fits) + " END"
    # strict hits are counted per term and place; no term overlaps itself
    n_strict = " + ".join(
        f"len(regexp_extract_all(replace(u, '{w}', '{w}{w}'), '(^|[^a-z0-9]){w}{w}($|[^a-z0-9])'))" for w in strict)
    n_soft = " + ".join(f"CAST({hit(w)} AS INT)" for w in soft)
    return f"""
WITH a AS (SELECT page_id, lower(coalesce(url, '')) AS u,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, u, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, u, translate(raw, '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, CAST({n_strict} AS INT) AS n_strict, CAST({n_soft} AS INT) AS n_soft FROM c)
SELECT page_id, host, path, {rule} AS rule,
       coalesce({action}, CASE WHEN n_strict > 0 OR n_soft >= {soft_limit} THEN 'block' ELSE 'allow' END) AS verdict,
       n_strict, n_soft
FROM d"""
