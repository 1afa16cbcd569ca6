"""URL filters: host/path rules first, else logistic regression on hashed n-grams.

The features of a URL are the character n-grams of its host and of its path, each
hashed into ``dims`` buckets (host and path n-grams are salted apart), as
frequencies over a unit-length vector. The model is trained from a small labelled
table by full-batch gradient descent written as SQL higher-order functions; at most
``MAX_LABELLED`` rows are taken, so the one-row training query stays small whatever the
corpus. Scoring is an expression on each row: no join, no shuffle, no Python.

The default table (:func:`labelled_urls`) is made by a rule from two lists of topic words:
a URL is to be blocked if a blocked topic stands in its host or in its path, else allowed.
Hosts are one or two topic words or syllables without a meaning, under several domains;
paths are topics, dates, numbers or nothing. It holds none of the hosts that the tables
here have. :func:`held_out_figures` says what the model gets right on hosts it hasn't seen.

Defined results: a null URL or one without ``://`` has empty host and path, fits no
rule and has no n-gram, so the model's bias judges it (allow by default); an empty
table gives an empty result; rows are judged one by one, so ties, repeats and very
long URLs need no care. Only the named columns are read.
"""

from __future__ import annotations

import random
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path); the production rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: Rows of a labelled table at most: training holds them in one row.
MAX_LABELLED = 10_000
#: Topics to block, and topics to keep.
BLOCKED = "casino poker slots roulette jackpot betting bookie wager viagra cialis pills diet steroid xxx porn nude sexy escort camgirl hookup warez torrent crack keygen phishing malware spam clickbait popup adserver adclick tracker affiliate lottery payday loans replica giveaway miracle adult bets cheap free bonus prize".split()
ALLOWED = "library museum university school science physics chemistry biology history geography weather garden cooking recipe bakery travel hiking railway airport harbor hospital nursing medicine law court council city village county news journal gazette tribune radio music theatre cinema art gallery poetry novel book sports football tennis cycling chess software compiler database network robot energy solar climate forest river ocean market bank letters research open local daily green north".split()
_DOMAINS = ["{}.com", "www.{}.com", "{}.org", "www.{}.net", "blog.{}.info", "m.{}.co.uk", "{}.de", "{}.fr", "shop.{}.io", "{}.example.org", "www.{}.example.com", "news.{}.example.net"]
_PLAIN = ["", "/", "/index.html", "/{n}", "/p/{n}.html", "/en/{n}", "/fr/{n}/", "/20{m}/0{d}/{n}", "/id-{n}", "/page/{d}", "/de/{n}.html", "/es/post/{n}"]
_TOPICAL = ["/{w}", "/{w}/{v}", "/{w}-{v}/{n}.html", "/20{m}/{w}/{v}", "/tag/{w}", "/en/{w}/{n}", "/{v}/{w}.html", "/articles/{w}-{n}"]


def labelled_urls(size: int = 2400, seed: int = 17) -> list[tuple[str, int]]:
    """(url, 1 to block) by the rule above, half of each label."""
    r = random.Random(seed)

    def syllables() -> str:
        return "".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiou") + r.choice(["", "n", "r", "s", "l", "t", "th"]) for _ in range(r.randint(2, 3)))

    def host(words: list[str] | None) -> str:
        name = syllables() if words is None else r.choice(words) if r.random() < 0.4 else r.choice(["{}-{}", "{}{}"]).format(r.choice(words), r.choice([r.choice(words), syllables()]))
        return r.choice(_DOMAINS).format(name)

    def path(words: list[str] | None) -> str:
        form = r.choice(_PLAIN if words is None else _TOPICAL)
        return form.format(w=r.choice(words or [""]), v=r.choice(words or [""]), n=r.randrange(1000), m=r.randint(10, 25), d=r.randint(1, 9))

    # blocked: the topic is in the host, in the path, or in both; allowed: in neither
    block = [(BLOCKED, None), (BLOCKED, BLOCKED), (None, BLOCKED), (ALLOWED, BLOCKED), (BLOCKED, ALLOWED)]
    allow = [(None, None), (ALLOWED, None), (ALLOWED, ALLOWED), (None, ALLOWED), (None, None)]
    out = []
    for k in range(size // 2):
        for label, kinds in ((1, block), (0, allow)):
            h, p = kinds[k % 5]
            out.append((f"http{'s' * (r.random() < 0.7)}://{host(h)}{path(p)}", label))
    return out


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path, by the first ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def _grams(text: Column, n: int, salt: int, dims: int) -> Column:
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    count = F.length(marked) - (n - 1)
    each = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    grams = F.transform(each, lambda i: F.pmod(F.xxhash64(F.substr(marked, i, F.lit(n)), F.lit(salt)), F.lit(dims)).cast("int"))
    return F.when(F.length(text) > 0, grams).otherwise(F.array().cast("array<int>"))


def features(host: Column, path: Column, n: int, dims: int) -> Column:
    """Buckets of the n-grams of host and path, one entry for each occurrence."""
    return F.concat(_grams(host, n, 1, dims), _grams(path, n, 2, dims))


def logit(buckets: Column, weights: Column, bias: Column) -> Column:
    """The mean weight of the buckets, times the square root of their number, and the bias."""
    total = F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + F.element_at(weights, b + 1))
    return F.when(F.size(buckets) > 0, total / F.sqrt(F.size(buckets).cast("double"))).otherwise(0.0) + bias


def train(spark: SparkSession, labelled=None, n: int = 3, dims: int = 4096, steps: int = 150, rate: float = 2.0, momentum: float = 0.95, decay: float = 1e-5) -> tuple[list[float], float]:
    """Weights and bias after ``steps`` of gradient descent with momentum over the labelled table, in one SQL row."""
    labelled = labelled_urls() if labelled is None else labelled
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"a labelled table of more than {MAX_LABELLED} rows")
    rows = spark.createDataFrame(labelled, "url string, label int")
    host, path = parse(F.col("url"))
    sparse = rows.select("label", features(host, path, n, dims).alias("b"))
    # the transposed matrix: for each bucket, its examples and entries
    examples = sparse.select((F.row_number().over(_in_order()) - 1).alias("k"), "label", "b")
    count = examples.count()  # the labelled table's size
    entries = examples.select("k", F.explode("b").alias("bucket"), (F.lit(1.0) / F.sqrt(F.size("b").cast("double"))).alias("v"))
    sides = entries.groupBy("bucket", "k").agg(F.sum("v").alias("v")).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("column"))
    columns = spark.range(dims).select(F.col("id").cast("int").alias("bucket")).join(sides, "bucket", "left").agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "column"))), lambda x: F.coalesce(x["column"], F.array().cast("array<struct<k:int,v:double>>"))).alias("columns"))
    rows_ = examples.agg(F.sort_array(F.collect_list(F.struct("k", "label", "b"))).alias("rows"))
    one = columns.unionByName(rows_, allowMissingColumns=True).agg(F.first("columns", True).alias("columns"), F.first("rows", True).alias("rows"))
    # the last weight is the bias; push is the way of the last step
    zeros = F.array_repeat(F.lit(0.0), dims + 1)
    state = F.struct(zeros.alias("w"), zeros.alias("push"), F.array_repeat(F.lit(0.0), count).alias("error"))

    def errors(acc):
        return F.transform(F.col("rows"), lambda r: F.lit(1.0) / (1.0 + F.exp(-logit(r["b"], acc["w"], acc["w"][dims]))) - r["label"])

    def step(acc, _):
        gradient = F.concat(
            F.transform(F.col("columns"), lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["v"] * F.element_at(acc["error"], x["k"] + 1))),
            F.array(F.aggregate(acc["error"], F.lit(0.0), lambda a, e: a + e)),
        )
        push = F.zip_with(acc["push"], gradient, lambda p, g: momentum * p - rate / count * g)
        return F.transform(F.array(push), lambda p: F.struct(F.zip_with(acc["w"], p, lambda w, x: w * (1 - rate * decay) + x).alias("w"), p.alias("push"), acc["error"].alias("error")))[0]

    def turn(acc, i):
        seen = F.struct(acc["w"].alias("w"), acc["push"].alias("push"), errors(acc).alias("error"))
        # an array of one, so that the errors are computed once a step
        return F.transform(F.array(seen), lambda s: step(s, i))[0]

    model = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, turn)["w"].alias("w")).first()["w"]
    return list(model[:dims]), float(model[dims])


def _in_order():
    from pyspark.sql import Window

    return Window.orderBy("label", F.xxhash64("b"), F.size("b"))  # over the small labelled table only


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest fitting rule as struct<length, rule, verdict>; null if none fits."""
    fits = [
        F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, n: int = 3, dims: int = 4096, threshold: float = 0.5, labelled=None) -> DataFrame:
    """Returns id, host, path, rule, verdict, score (the model's probability of blocking): a row per row of ``pages``."""
    weights, bias = train(pages.sparkSession, labelled, n, dims)
    literal = F.from_json(F.lit("[" + ",".join(map(repr, weights)) + "]"), "array<double>")  # folded to one constant
    host, path = parse(F.col(url_col))
    seen = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    seen = seen.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("b", features(F.col("host"), F.col("path"), n, dims))
    score = F.lit(1.0) / (1.0 + F.exp(-logit(F.col("b"), literal, F.lit(bias))))
    return seen.withColumn("score", F.when(F.size("b") > 0, score).otherwise(0.0)).select(
        "id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score"
    )


def held_out_figures(spark: SparkSession, labelled=None, folds: int = 5, **options) -> dict[str, float]:
    """Precision, recall and accuracy of blocking on the hosts of one fold (by CRC-32), learnt from the other hosts."""
    labelled = labelled_urls() if labelled is None else labelled
    fold = lambda url: zlib.crc32(url.partition("://")[2].split("/")[0].encode()) % folds
    test = [(k, url, y) for k, (url, y) in enumerate(labelled) if fold(url) == 0]
    pages = spark.createDataFrame(test, "page_id int, url string, label int")
    seen = judge(pages, rules=[], labelled=[x for x in labelled if fold(x[0]) != 0], **options).join(pages.select(F.col("page_id").alias("id"), "label"), "id")
    hit, said, true, right, n = seen.select((F.col("verdict") == "block").cast("int").alias("b"), "label").agg(F.sum(F.expr("b * label")), F.sum("b"), F.sum("label"), F.sum((F.col("b") == F.col("label")).cast("int")), F.count("b")).first()
    return {"precision": hit / max(1, said), "recall": hit / max(1, true), "accuracy": right / max(1, n), "rows": n}
