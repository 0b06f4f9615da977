"""URL filters: rules on host and path, and a character language-model ratio for what no rule fits.

Two variable-order Markov models of characters, with Witten-Bell smoothing, are counted over all URLs that a rule
accepts or rejects. A URL's score is the mean, over all its characters from the scheme to the fragment, of the accepted
model's log-probability less the rejected one's; it is compared with a threshold calibrated on labelled URLs that were
left out of the counts. Counting, smoothing and scoring are grouped sums and joins over distinct n-grams; nothing grows
on the driver. N-grams that nearly all URLs hold are spread over SALTS keys when URLs and ratios are joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.llm._shared import even_join, settle, text_of

ORDER, ALPHABET = 3, 256
#: Of labelled URLs one in so many is left out of the counts, for calibration; bins of the score's histogram.
CALIBRATION, BIN = 5, 0.02
SALTS = 16


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def _grams(urls: DataFrame) -> DataFrame:
    """urls: t and others. A row for each character of t and its end: the gram that ends there."""
    padded = F.concat(F.lit("\x02" * ORDER), "t", F.lit("\x03"))
    return urls.withColumn("g", F.explode(F.transform(F.sequence(F.lit(1), F.length("t") + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))))


def _smoothed(wanted: DataFrame, counts: DataFrame, n: str) -> DataFrame:
    """wanted: distinct g. g and p: the probability of g's last character after the others, by the counts in column n."""
    counts = counts.where(F.col(n) > 0)
    last = F.substring("g", ORDER + 1, 1)
    total = counts.agg(F.sum(n).alias("all"))
    of_c = counts.groupBy(last.alias("c")).agg(F.sum(n).alias("nc"))
    out = wanted.withColumn("c", last).join(of_c, "c", "left").crossJoin(F.broadcast(total))  # one row
    out = out.select("g", "c", ((F.coalesce("nc", F.lit(0)) + 1) / (F.coalesce("all", F.lit(0)) + ALPHABET)).alias("p"))
    for k in range(1, ORDER + 1):
        context = F.substring("g", ORDER + 1 - k, k)
        pairs = counts.groupBy(context.alias("x"), last.alias("c")).agg(F.sum(n).alias("nxc"))
        contexts = pairs.groupBy("x").agg(F.sum("nxc").alias("nx"), F.count("*").alias("kinds"))
        out = out.withColumn("x", context).join(pairs, ["x", "c"], "left").join(contexts, "x", "left")
        p = F.when(F.col("nx").isNull(), F.col("p")).otherwise((F.coalesce("nxc", F.lit(0)) + F.col("kinds") * F.col("p")) / (F.col("nx") + F.col("kinds")))
        out = out.select("g", "c", p.alias("p"))
    return out.select("g", "p")


def judge(pages: DataFrame, rules=RULES, id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row.

    Null URLs and those without "://" have empty host and path. Null counts as the empty text; every URL is scored whole,
    however long it is. Where labelled URLs of one kind are missing, the method allows. Repeated rows come out repeated;
    extra columns take no part; an empty table gives no rows.
    """
    spark = pages.sparkSession
    address = text_of(url)
    base = pages.select(F.col(id).cast("long").alias("page_id"), address.alias("t"))
    host, path = host_of(F.col("t")), path_of(F.col("t"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number of its own, as a URL becomes a row for each character
    urls = base.groupBy("t").agg(F.count("*").alias("w")).select("t", "w", host.alias("host"), path.alias("path")).withColumn("known", verdict)
    urls = settle(urls.select("t", "w", "known").repartition(tasks, "t"), "urls")
    fold = F.pmod(F.xxhash64("t"), F.lit(CALIBRATION))
    counted = urls.where(F.col("known").isNotNull() & (fold > 0))
    counts = settle(_grams(counted).groupBy("g").agg(F.sum(F.when(F.col("known") == "allow", F.col("w")).otherwise(0)).alias("good"), F.sum(F.when(F.col("known") == "block", F.col("w")).otherwise(0)).alias("bad")), "url-grams")
    wanted = settle(_grams(urls.select("t")).select("g").distinct(), "url-wanted")
    ratio = _smoothed(wanted, counts, "good").join(_smoothed(wanted, counts, "bad").withColumnRenamed("p", "q"), "g").select("g", F.round(F.log(F.col("p") / F.col("q")), 9).cast("decimal(20,9)").alias("r"))
    ratio = settle(ratio.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "url-ratios")
    rows = _grams(urls).withColumn("salt", F.pmod(F.xxhash64("t", F.lit(1)), F.lit(SALTS)).cast("int"))
    scored = rows.join(ratio, ["g", "salt"]).groupBy("t", "known", "w").agg((F.sum("r").cast("double") / F.count("*")).alias("score"))
    scored = settle(scored, "url-scores")
    held = scored.where(F.col("known").isNotNull() & (fold == 0))
    bins = held.groupBy(F.floor(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), "score")) / BIN).alias("bin"), "known").agg(F.sum("w").alias("n")).collect()
    limit = threshold([(r["bin"], r["known"], r["n"]) for r in bins])
    method = F.when(F.col("score") >= limit, "allow").otherwise("block")
    judged = even_join(base, scored.select("t", "w", "score"), "t", "page_id", "w").select("page_id", "score", host.alias("host"), path.alias("path"))
    return judged.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "score")


def threshold(bins: list[tuple[int, str, int]]) -> float:
    """The lower edge of the bin from which allowing errs least, each kind weighing the same; of ties the one nearest 0, where
    both models find a URL equally likely."""
    total = {k: sum(n for _, known, n in bins if known == k) for k in ("allow", "block")}
    if not total["allow"] or not total["block"]:
        return float("-inf")
    found = []
    for edge in range(min(b for b, _, _ in bins), max(b for b, _, _ in bins) + 2):
        wrong = sum(n / total[k] for b, k, n in bins if (b >= edge) == (k == "block"))
        found.append((wrong, edge))
    least = min(w for w, _ in found)
    ties = [e for w, e in found if w <= least + 1e-12]
    return min(ties, key=lambda e: (abs(e), e)) * BIN
