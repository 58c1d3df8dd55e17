"""Ranking places, names for addresses, and the search ladder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import travel


def rank_places(reach: DataFrame, guides: DataFrame, near_home: DataFrame) -> DataFrame:
    """guide, place, minutes, score: the reached places that have a guide, one for each guide.

    reach has place, legs, fastest; guides place, guide, appeal, is_city, halts. Places of the
    own town and under half an hour are no trip."""
    rows = reach.filter("fastest >= 30").join(near_home, "place", "left_anti").join(guides, "place")
    score = F.log1p("appeal") + 0.35 * F.log1p(F.col("legs")) + F.when(F.col("is_city"), 0.4).otherwise(0.0)
    rows = rows.withColumn("score", score)
    pref = F.col("score") + F.when(F.col("is_city"), 1.0).otherwise(0.0) + F.col("halts") * 1e-6
    order = Window.partitionBy("guide").orderBy(pref.desc(), "place")
    best = rows.withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    return best.select("guide", "place", F.col("fastest").alias("minutes"), "score")


def slugs(places: DataFrame) -> DataFrame:
    """id, slug: cities first, then the busiest; who comes second to a slug gets its id behind it."""
    base = tx.slug(F.col("name"))
    rows = places.withColumn("base", F.when(base == "", F.lower("id")).otherwise(base))
    order = Window.partitionBy("base").orderBy(F.col("is_city").desc(), F.col("halts").desc(), "id")
    nth = F.row_number().over(order)
    return rows.select("id", F.when(nth == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.lower("id"))).alias("slug"))


def search_ladder(names: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """id, name, score: the first rule that a name meets, lifted by its trains. names has folded
    name, code, halts."""
    q = query.strip().lower()
    n = F.col("name")
    rule = (
        F.when(F.col("code") == q, 5.0)
        .when(n == q, 4.6)
        .when(F.startswith(n, F.lit(q)), 4.0)
        .when(F.exists(F.split(n, "[^a-z0-9]+"), lambda w: F.startswith(w, F.lit(q))), 3.0)
        .when(F.contains(n, F.lit(q)), 2.0)
    )
    hits = names.withColumn("rule", rule).filter("rule is not null")
    hits = hits.withColumn("score", F.col("rule") + 0.3 * F.log10(1 + F.col("halts")))
    return hits.orderBy(F.col("score").desc(), "id").limit(limit).select("id", "name", "score")


def search_forgiving(names: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """id, name, score, slip: names by the first rule they meet; where fewer than three are at 3.3 or
    more, names within the slips that the query's length forgives are taken in as well, at
    2.4 less half of each slip."""
    q = query.strip().lower()
    n, lift = F.col("name"), travel.search_lift(F.col("halts"), F.lit(False))
    rule = (
        F.when(F.col("code") == q, 5.0)
        .when(n == q, 4.6)
        .when(F.startswith(n, F.lit(q)), 4.0)
        .when(F.exists(F.split(n, "[^a-z0-9]+"), lambda w: F.startswith(w, F.lit(q))), 3.0)
        .when(F.contains(n, F.lit(q)), 2.0)
    )
    rows = names.withColumn("rule", rule).withColumn("slip", F.when(F.col("rule").isNull(), tx.slips(q, n, tx.forgive(len(q)))))
    rows = rows.filter("rule is not null or slip is not null").withColumn("score", F.coalesce("rule", 2.4 - 0.5 * F.col("slip")) + lift)
    # one row that says whether enough reads as typed
    enough = rows.agg((F.count(F.when(F.col("rule").isNotNull() & (F.col("score") >= 3.3), 1)) >= 3).alias("enough"))
    rows = rows.join(F.broadcast(enough), F.lit(True)).filter("rule is not null or not enough")
    return rows.orderBy(F.col("score").desc(), "id").limit(limit).select("id", "name", "score", F.coalesce("slip", F.lit(0.0)).alias("slip"))


def fuzzy(names: DataFrame, query: str) -> DataFrame:
    """id, name, slips: names within as many slips as the query's length forgives. Only names with
    the same first letter and a length that can match reach the comparison."""
    q = query.strip().lower()
    most = tx.forgive(len(q))
    block = names.filter(F.startswith(F.col("name"), F.lit(q[:1])) & (F.length("name") >= len(q) - most))
    return block.withColumn("slips", tx.slips(q, F.col("name"), most)).filter("slips is not null")


def train_search(trains: DataFrame, query: str, limit: int = 3) -> DataFrame:
    """By the beginning of the number (three to five digits), or by name, word starts first."""
    q = query.strip().lower()
    if q.isdigit() and 3 <= len(q) <= 5:
        return trains.filter(F.startswith(F.col("no"), F.lit(q))).orderBy("no").limit(2 * limit).select("no", "name")
    at = F.instr(F.col("name"), q)
    word = (at == 1) | F.substr(F.col("name"), at - 1, F.lit(1)).isin(" ", "(", "-", "–")
    hits = trains.filter(at > 0).withColumn("score", F.when(word, 2).otherwise(0) + F.when(F.col("premium"), 1).otherwise(0))
    return hits.orderBy(F.col("score").desc(), "no").limit(limit).select("no", "name")
