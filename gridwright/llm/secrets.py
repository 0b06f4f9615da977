"""Secret scans: candidate strings by one regular expression, false positives removed by a random forest.

Everything over the documents is DataFrame functions: extraction, features, and the forest itself, which is written out
as one CASE expression for each tree. The forest is trained on the driver from labelled findings, a bounded table
(`labelled`, or by default findings made up by rule). A candidate is a run of at least 12 of A-Z a-z 0-9 + / _ . ~ -
with a digit or a known prefix, or any run of them behind = or :, with a quote or up to two blanks between. Features: its length, shares of character classes and their transitions, variety, dictionary coverage,
path shape, known prefixes, and the words before it.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridwright.llm._shared import fresh, text_of

#: Characters kept of what stands before a candidate.
NEAR = 80
#: Labelled findings taken at most (those with the smallest hash); trees, their depth, rows in a leaf at least.
FIT_ROWS, TREES, DEPTH, LEAF = 6000, 24, 7, 4
MASK = "[SECRET]"

#: Words that stand before secrets, and before harmless strings; prefixes that providers give to keys.
SECRET_WORDS = "password passwd pwd secret token api_key apikey api-key access_key accesskey private_key auth_key client_secret bearer credential credentials"
HARMLESS_WORDS = "commit sha sha1 sha256 md5 checksum digest uuid guid phone tel fax card visa isbn doi order invoice version build ticket etag revision ip host server"
PREFIXES = "AKIA ASIA ghp_ gho_ ghs_ glpat- sk_live_ sk_test_ xoxb- xoxp- AIza SG. npm_ pypi-"
_RUN = "[A-Za-z0-9+/_.~-]"
_TIED = r"(?:(?<=[=:])|(?<=[=:][\s\"'])|(?<=[=:]\s[\s\"']))"
CANDIDATE = rf"(?<!{_RUN})(?:(?:(?=[A-Za-z+/_.~-]*+[0-9])|(?=(?:{'|'.join(x.replace('.', '[.]') for x in PREFIXES.split())}))){_RUN}{{12,}}+|{_TIED}{_RUN}++)={{0,2}}"
DICTIONARY = (
    "about access account admin after alpha amazon android apache april archive article asset august author backup banner basic beta block blog book branch browser build cache category "
    "center change check class client cloud code color com commit common company config connect content copy core country css data date december default delete design dev device digest docs "
    "document domain down download edit email error event example export feature february feed file filter first folder font forum friday front gallery game github google group guide head help "
    "history home host html http https icon image import index info input install item january java javascript job july june key large lib license light linux list local log login main make "
    "manager map march master media member menu message meta mobile model module monday month music name network new news next node note november number object october office old online open "
    "option order output package page paper part path phone photo php picture plan plugin point post press price print private product profile project public python query read release report "
    "request research review root rule sample saturday save script search second section security september server service session set setting shop show simple site size small source spec "
    "sport start state static status store style sunday support system table tag target team template test text theme third thursday time title tmp tools top topic tuesday type update upload "
    "user users util value var version video view web wednesday week windows wiki word work world www year"
)


def _any(words: str) -> str:
    return "|".join(x.replace(".", r"\.") for x in sorted(words.split(), key=lambda w: (-len(w), w)))


def _share(value: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{kept}]", "")) / F.length(value)


def features(value: Column, before: Column) -> dict[str, Column]:
    """Feature name -> double, of a candidate and what stands before it."""
    runs = value
    for kept, mark in (("[0-9]+", "0"), ("[a-z]+", "a"), ("[A-Z]+", "A"), (r"[^0aA]+", "_")):
        runs = F.regexp_replace(runs, kept, mark)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    found = {
        "length": F.length(value),
        "digits": _share(value, "0-9"),
        "lower": _share(value, "a-z"),
        "upper": _share(value, "A-Z"),
        "transitions": (F.length(runs) - 1) / F.length(value),
        "variety": F.size(F.array_distinct(F.split(value, ""))) / F.least(F.length(value), F.lit(64)),
        "hex": flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(value), _any(DICTIONARY), "")) / F.length(value),
        "slashes": F.length(F.regexp_replace(value, "[^/]", "")),
        "dots": F.length(F.regexp_replace(value, "[^.]", "")),
        "dashes": F.length(F.regexp_replace(value, "[^-]", "")),
        "file": flag(value.rlike(r"\.[a-z]{2,5}$")),
        "prefix": flag(value.rlike(f"^(?:{_any(PREFIXES)})")),
        "named": flag(before.rlike(rf"(?i)(?:{_any(SECRET_WORDS)})[\"']?\s*(?:[:=]|is)\s*[\"']?$")),
        "secret_near": flag(before.rlike(rf"(?i)(?<![a-z])(?:{_any(SECRET_WORDS)})(?![a-z])")),
        "harmless_near": flag(before.rlike(rf"(?i)(?<![a-z])(?:{_any(HARMLESS_WORDS)})[\"']?\s*[:=#]?\s*[\"']?$")),
        "url": flag(before.rlike(r"(?:https?|ftp):/{0,2}$|@$")),
    }
    return {k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in found.items()}


def made_up(n: int = 4000, seed: int = 7) -> list[dict]:
    """Labelled findings by rule: keys and passwords of common forms; numbers, hashes, addresses, paths and names."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choices(chars, k=k))
    digits, hexes, upper, alnum = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words, syllables = DICTIONARY.split(), "the an er ing on re ha ti en ou st ed nd to or ea le chen ung ment ion de la".split()
    text = lambda: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(0, 6)))
    rows = []
    for _ in range(n):
        near, kind = text(), rng.randrange(24)
        name = rng.choice(SECRET_WORDS.split())
        name = rng.choice([name, name.upper(), name.title(), "db_" + name, "my " + name])
        tie = rng.choice(["=", ": ", " = ", "='", '="', ' = "', '": "', ":"])
        if kind < 2:
            value, label = rng.choice(["AKIA", "ASIA"]) + pick(upper, 16), 1
        elif kind < 3:
            value, label = rng.choice(PREFIXES.split()[2:]) + pick(alnum, rng.randint(20, 40)), 1
        elif kind < 6:
            value, near, label = pick(hexes, rng.choice([12, 16, 18, 20, 24, 32, 40, 64])), near + " " + name + tie, 1
        elif kind < 8:
            value, near, label = pick(alnum + "+/_-", rng.randint(12, 48)), near + " " + name + tie, 1
        elif kind < 9:
            value, label = pick(alnum + "+/", rng.randint(36, 64)), 1
        elif kind < 12:
            value, label = rng.choice(["4", "5", "3", ""]) + pick(digits, rng.choice([11, 12, 13, 15, 15, 15, 18])), 0
        elif kind < 13:
            value, label = ".".join(str(rng.randint(10, 255)) for _ in range(4)), 0
        elif kind < 14:
            value, near, label = pick(hexes, rng.choice([32, 40, 64])), near + " " + rng.choice(["commit", "sha1", "md5:", "sha256:", "checksum ", "etag"]) + " ", 0
        elif kind < 15:
            h = pick(hexes, 32)
            value, label = "-".join([h[:8], h[8:12], h[12:16], h[16:20], h[20:]]), 0
        elif kind < 17:
            value, label = "/".join(rng.choice([rng.choice(words), "".join(rng.choices(syllables, k=2)), str(rng.randint(1, 9999))]) for _ in range(rng.randint(3, 6))) + rng.choice(["", ".html", ".png", f"_{rng.randint(1, 99)}.txt"]), 0
            near = near + rng.choice([" ", " http:/", " https://"])
        elif kind < 18:
            value, label = f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}", 0
            value += rng.choice(["", f"-{rng.choice(words)}"])
        elif kind < 19:
            value, label = rng.choice("-_.").join([rng.choice(words + syllables) for _ in range(rng.randint(2, 4))] + [str(rng.randint(1, 99999))]), 0
        elif kind < 21:  # letters only, or short
            near, label = near + " " + name + tie, 1
            value = rng.choice([
                lambda: "".join(rng.choice(syllables + words).title() for _ in range(rng.randint(2, 4))),
                lambda: pick(alnum[:52], rng.randint(6, 40)),
                lambda: pick(alnum, rng.randint(5, 11)),
                lambda: "".join(rng.choices(syllables, k=rng.randint(3, 6))),
                lambda: rng.choice(words + syllables) + str(rng.randint(1, 9999)),
            ])()
        elif kind < 22:
            value, label = rng.choice(PREFIXES.split()) + pick(alnum[:52], rng.randint(16, 40)), 1
        elif kind < 23:  # what a secret's name is followed by in prose and in forms
            value, near, label = rng.choice([*words, *words, "a", "the", "is", "none", "null", "true", "false", "string", "required", "hidden", "/", "-"]), near + " " + name + tie, 0
        elif rng.random() < 0.5:
            value, label = rng.choice([rng.choice(words), "".join(rng.choices(syllables, k=rng.randint(1, 5))), pick(digits, rng.randint(1, 8)), rng.choice(words).title() + rng.choice(words).title()]), 0
            near = near + " " + rng.choice(words + syllables) + tie
        else:
            value, label = "".join(rng.choices(syllables, k=rng.randint(5, 9))) + str(rng.randint(1, 99)), 0
        rows.append({"value": value, "before": near[-NEAR:], "label": label})
    return rows


def labelled_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """The rows as a DataFrame: one JSON literal, parsed by Spark."""
    kind = "array<struct<value:string,before:string,label:int>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), kind)).alias("r")).select("r.*")


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH):
    """A tree: a share of secrets, or (feature, threshold, at most, above)."""
    share = float((y.sum() + 0.1) / (len(y) + 0.2))
    if depth == 0 or len(y) < 2 * LEAF or y.min() == y.max():
        return share
    best = (1e-9, None)
    impurity = len(y) * y.mean() * (1 - y.mean())
    for f in rng.permutation(x.shape[1])[: max(2, int(x.shape[1] ** 0.5) + 1)]:
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        cut = (v[1:] > v[:-1]) & (n >= LEAF) & (len(y) - n >= LEAF)
        left, right = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(y) - n)
        gain = np.where(cut, impurity - n * left * (1 - left) - (len(y) - n) * right * (1 - right), -1)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], (int(f), float((v[k] + v[k + 1]) / 2)))
    if best[1] is None:
        return share
    f, t = best[1]
    low = x[:, f] <= t
    return (f, t, grow(x[low], y[low], rng, depth - 1), grow(x[~low], y[~low], rng, depth - 1))


def fit(spark: SparkSession, labelled: DataFrame | None = None, rows: int = FIT_ROWS) -> list:
    """The forest's trees. labelled: value, before, label (0 or 1); rows with nulls don't count."""
    table = labelled if labelled is not None else labelled_table(spark, made_up())
    table = table.where("value <> '' and label is not null").withColumn("before", text_of("before")).orderBy(F.xxhash64("value", "before"), "value", "before", "label").limit(rows)
    got = table.select(F.array(*features(F.col("value"), F.col("before")).values()).alias("x"), F.col("label").cast("int").alias("y")).collect()
    if not got:
        return [0.0]
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got])
    rng, forest = np.random.default_rng(1), []
    for _ in range(TREES):
        drawn = rng.integers(0, len(y), len(y))
        forest.append(grow(x[drawn], y[drawn], rng))
    return forest


def _tree(node, values: list[Column]) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    f, t, low, high = node
    return F.when(values[f] <= t, _tree(low, values)).otherwise(_tree(high, values))


def forest_score(forest: list, value: Column, before: Column) -> Column:
    """The mean of the trees as one expression. The features are computed once, as an array."""
    own = F.array(*features(value, before).values())
    mean = lambda x: sum((_tree(t, [x[i] for i in range(len(features(value, before)))]) for t in forest[1:]), _tree(forest[0], [x[i] for i in range(len(features(value, before)))])) / len(forest)
    return F.element_at(F.transform(F.array(own), mean), 1)


def _split(text: Column) -> tuple[Column, Column]:
    """Candidates of a text, and what stands before, between and after them."""
    some = text.rlike(f"[0-9=:]|{_any(PREFIXES)}")
    return F.when(some, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")), F.when(some, F.split(text, CANDIDATE, -1)).otherwise(F.array(text))


def scan(df: DataFrame, forest: list, text: str = "text", least: float = 0.5) -> DataFrame:
    """df's other columns and start (long, from 0), value, before, score of every finding with this score or more.

    Null and empty texts have none; texts are read whole, however long they are. Repeated rows give their findings each;
    an empty df gives none. Columns of df named like these four raise ValueError, all others are kept as they are.
    """
    clash = {"start", "value", "before", "score"} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    others = [c for c in df.columns if c != text]
    v, g, row, i, c = fresh(df, "_v", "_g", "_row", "_i", "_c")
    values, gaps = _split(text_of(text))
    pieces = df.select(*others, F.monotonically_increasing_id().alias(row), values.alias(v), gaps.alias(g)).where(F.size(v) > 0)
    of = F.transform(v, lambda x, k: F.struct(x.alias("value"), F.length(F.col(g)[k]).alias("gap"), F.right(F.col(g)[k], F.lit(NEAR)).alias("before")))
    found = pieces.select(*others, F.posexplode(of).alias(i, c), row)
    so_far = Window.partitionBy(row).orderBy(i).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.col(c)["gap"] + F.length(F.col(c)["value"])).over(so_far) - F.length(F.col(c)["value"])
    rows = found.select(*others, start.cast("long").alias("start"), F.col(c)["value"].alias("value"), F.col(c)["before"].alias("before"))
    return rows.withColumn("score", forest_score(forest, F.col("value"), F.col("before"))).where(F.col("score") >= least)


def redact(df: DataFrame, forest: list, text: str = "text", least: float = 0.5, mask: str = MASK) -> DataFrame:
    """df with mask in the place of every finding with this score or more.

    Null texts stay null and empty ones empty; texts are read whole, however long they are. No row is lost or added, and
    all other columns stay as they are; an empty df stays empty.
    """
    v, g = fresh(df, "_v", "_g")
    values, gaps = _split(F.col(text))
    kept = F.zip_with(v, F.slice(g, 1, F.size(v)), lambda x, gap: F.concat(gap, F.when(forest_score(forest, x, F.right(gap, F.lit(NEAR))) >= least, F.lit(mask)).otherwise(x)))
    done = F.when(F.size(v) > 0, F.concat(F.array_join(kept, ""), F.element_at(g, -1))).otherwise(F.col(text))
    return df.withColumn(v, values).withColumn(g, gaps).withColumn(text, done).select(df.columns)
