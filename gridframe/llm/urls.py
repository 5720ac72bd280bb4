"""URL filters: host and path rules, then logistic regression, in DataFrame
expressions only.

Rules name a host (with all its subdomains) and a path prefix; the longest rule
that fits decides. Other urls are judged by a logistic regression on hashed
character n-grams of host and path. It is trained by gradient descent, each
step one aggregation over a small table of labelled urls; the weights then go
into the plan as an array, so judging is an expression of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1024
GRAMS = (3, 4)
STEPS = 20
RATE = 20.0
DECAY = 0.002
#: weight of an allowed url against a blocked one: what the table does not know is allowed
ALLOW_WEIGHT = 2.0

#: host and path prefix, verdict
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

# The labelled urls: invented hosts, and paths as such sites use them.
ALLOWED = """
news.cityherald.example/world/2021/05/economy-report  www.dailyjournal.example/politics/article-4411
en.openencyclopedia.example/wiki/Photosynthesis  docs.pylibrary.example/en/latest/tutorial.html
www.stateuniversity.example/research/biology/publications  library.oldcollege.example/catalog/item/2231
blog.gardeningnotes.example/2019/04/growing-tomatoes  www.museumofart.example/exhibitions/current
www.healthinstitute.example/topics/nutrition/guide  weather.nationalservice.example/forecast/today
www.cookingathome.example/recipes/vegetable-soup  forum.woodworkers.example/thread/8812-oak-table
science.magazine.example/articles/deep-sea-vents  www.parliament.example/debates/2020/education-bill
www.historyarchive.example/letters/1843/collection  developer.toolkit.example/reference/functions
courses.teaching.example/mathematics/lecture-3  www.cityguide.example/museums/opening-hours
books.reading.example/reviews/novel-of-the-year  www.birdwatchers.example/species/blackbird
help.texteditor.example/manual/shortcuts  www.regionalpress.example/sports/football/results
www.translators.example/blog/grammar-notes  journal.medicine.example/volume12/issue3/abstract
""".split()
BLOCKED = """
www.casino-royal-bonus.example/slots/free-spins  bet365win.example/poker/jackpot?aff=12
cheap-pills-online.example/viagra/order-now  www.xxx-hot-cams.example/live/sex/girls
free-porn-tube.example/video/12345  www.adult-dating-now.example/join/hookup
best-crypto-profit.example/invest/double-your-money  win-iphone-prize.example/claim/lucky-winner
download-crack-keygen.example/warez/serial  torrent-pirate-movies.example/download/full-hd
fast-loan-approval.example/payday/apply-now  replica-watches-sale.example/rolex/cheap
www.escort-service.example/girls/price  buy-followers-cheap.example/order/likes
seo-backlinks-shop.example/buy/links  click-track-ads.example/redirect?campaign=99
popunder-ads-network.example/banner/click  weight-loss-miracle.example/diet-pills/discount
make-money-fast.example/work-from-home/offer  casino-bonus-code.example/roulette/deposit
online-pharmacy-rx.example/cialis/buy  sexy-webcam-chat.example/free/adult
spin-and-win-slots.example/casino/play  nude-pics-leak.example/gallery/xxx
""".split()


def with_host_and_path(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract("_gf_rest", r"^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return df.withColumn("_gf_rest", rest).withColumn("_gf_host", host).withColumn(
        "path", F.regexp_extract(F.substring("_gf_rest", F.length("_gf_host") + 1, F.length("_gf_rest")), r"^([^?#]*)", 1)).withColumn(
        "host", F.translate("_gf_host", upper, lower)).drop("_gf_rest", "_gf_host")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null. Rules that only
    share a length cannot both fit."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = rule.index("/")
        name, prefix = rule[:at], rule[at:]
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(prefix))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(text: Column, kind: str, buckets: int) -> Column:
    """Bucket numbers of the n-grams of ``^text$``, tagged with their kind."""
    def of(chars: Column, n: int) -> Column:
        last = F.size(chars) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.pmod(
            F.xxhash64(F.concat(F.lit(f"{kind}{n}:"), *[F.get(chars, i + k) for k in range(n)])), F.lit(buckets)).cast("int"))).otherwise(
            F.array().cast("array<int>"))

    # the characters are bound once, not split anew for every n-gram
    chars = F.array(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""))
    return F.get(F.transform(chars, lambda c: F.concat(*[of(c, n) for n in GRAMS])), 0)


def features(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds _gf_grams, the hashed n-grams of host and path."""
    return df.withColumn("_gf_grams", F.concat(_grams(F.col("host"), "h", buckets), _grams(F.col("path"), "p", buckets)))


def margin(grams: Column, weights: Column, intercept: float) -> Column:
    """Weighted sum of the n-grams over the root of their number, and the intercept."""
    total = F.aggregate(grams, F.lit(0.0), lambda acc, g: acc + F.get(weights, g))
    return total / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double")) + F.lit(float(intercept))


def _array(values: list[float]) -> Column:
    """A constant array (folded once by the optimizer)."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = [(f"https://{u}", 0.0) for u in ALLOWED] + [(f"https://{u}", 1.0) for u in BLOCKED]
    return spark.createDataFrame(rows, "url string, label double")


def train(labelled: DataFrame, *, buckets: int = BUCKETS, steps: int = STEPS) -> list[float]:
    """Weights, the last one the intercept, by gradient descent on the logistic loss
    of (url, label 0 or 1); label 1 is block. The table is small, so each step is
    one task. Without rows all weights are 0 but the intercept, which allows."""
    rows = features(with_host_and_path(labelled.where(F.col("label").isNotNull())), buckets).select(
        "label", "_gf_grams", F.sqrt(F.greatest(F.size("_gf_grams"), F.lit(1)).cast("double")).alias("root")).coalesce(1).cache()
    count = rows.count()
    weights, intercept = [0.0] * buckets, -1.0
    for _ in range(steps if count else 0):
        chance = 1 / (1 + F.exp(-margin(F.col("_gf_grams"), _array(weights), intercept)))
        error = (chance - F.col("label")) * F.when(F.col("label") == 0, ALLOW_WEIGHT).otherwise(1.0)
        slopes = rows.select(error.alias("e"), "root", "_gf_grams").select(
            "e", F.explode(F.concat(F.transform("_gf_grams", lambda g: F.struct(g.alias("g"), (1 / F.col("root")).alias("w"))),
                                    F.array(F.struct(F.lit(buckets).alias("g"), F.lit(1.0).alias("w"))))).alias("x")).groupBy("x.g").agg(
            F.sum(F.col("e") * F.col("x.w")).alias("s"))
        for r in slopes.collect():  # at most one row per bucket
            if r["g"] == buckets:
                intercept -= 0.1 * RATE * r["s"] / count
            else:
                weights[r["g"]] -= RATE * (r["s"] / count + DECAY * weights[r["g"]])
    rows.unpersist()
    return [round(w, 9) for w in [*weights, intercept]]


def judge(urls: DataFrame, weights: list[float], *, url_col: str = "url", rules: list[tuple[str, str]] | None = None,
          keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) and host, path, rule, verdict, score of every
    row; a kept column of one of these names is replaced. ``score`` is the
    regression's probability of block, ``verdict`` the rule's or else block from
    0.5 on.

    * null or empty urls and those without ``://``: empty host and path, no rule;
    * ties between rules: only one of a length can fit; a score of 0.5 blocks;
    * very long urls: every n-gram counts; rows are independent, so repeated rows
      get equal results and an empty table gives none.
    """
    new = ["host", "path", "rule", "verdict", "score"]
    keep = [c for c in (urls.columns if keep is None else keep) if c not in new]
    rows = urls.select(*[F.col(f"`{c}`") for c in keep], F.col(url_col).alias("_gf_url"))
    rows = features(with_host_and_path(rows, "_gf_url"), len(weights) - 1)
    score = F.round(1 / (1 + F.exp(-margin(F.col("_gf_grams"), _array(weights[:-1]), weights[-1]))), 6)
    rows = rows.withColumn("score", score).withColumn("_gf_rule", rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules))
    return rows.select(*[F.col(f"`{c}`") for c in keep], "host", "path", F.col("_gf_rule.rule").alias("rule"), F.coalesce(
        "_gf_rule.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
