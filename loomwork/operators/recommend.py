"""Recommenders over long tables.  Reference ties are unstable; here each order ends in the title or id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.joins import cosine_pairs


def popularity(movies: DataFrame, ratings: DataFrame, genre: str, min_reviews: int, n: int) -> DataFrame:
    """(serial, title, avg_rating, reviews) of the best rated titles of a genre with enough reviews."""
    kept = movies.where(F.array_contains("genres_list", genre)).join(ratings, "movieId")
    per = kept.groupBy("title").agg(F.bround(F.avg("rating"), 6).alias("avg_rating"), F.count("*").alias("reviews")).where(F.col("reviews") >= min_reviews)
    top = per.orderBy(F.desc("avg_rating"), F.desc("reviews"), "title").limit(n)
    return top.select(F.row_number().over(Window.orderBy(F.desc("avg_rating"), F.desc("reviews"), "title")).alias("serial"), "title", "avg_rating", "reviews")


def similar_items(movies: DataFrame, title: str, n: int) -> DataFrame:
    """(serial, movieId, title, cosine) of the movies nearest in genre counts; the asked movie itself is left out by id."""
    cells = movies.select("movieId", F.explode("genres_list").alias("g")).withColumn("one", F.lit(1.0))
    probe = movies.where(F.col("title") == title).orderBy("movieId").limit(1).select(F.col("movieId").alias("a"))
    pairs = cosine_pairs(cells, "movieId", "g", "one", probe).select(F.col("b").alias("movieId"), F.round("cosine", 9).alias("cosine"))
    top = pairs.join(movies.select("movieId", "title"), "movieId").orderBy(F.desc("cosine"), "movieId").limit(n)
    return top.select(F.row_number().over(Window.orderBy(F.desc("cosine"), "movieId")).alias("serial"), "movieId", "title", "cosine")


def neighbours(ratings: DataFrame, user: int, k: int) -> DataFrame:
    """(userId, cosine) of the ``k`` most similar users, the user included, on zero-filled ratings."""
    probe = ratings.where(F.col("userId") == user).select(F.col("userId").alias("a")).distinct()
    pairs = cosine_pairs(ratings, "userId", "movieId", "rating", probe)
    own = probe.select(F.col("a").alias("userId"), F.lit(1.0).alias("cosine"))
    return own.unionByName(pairs.select(F.col("b").alias("userId"), F.round("cosine", 9).alias("cosine"))).orderBy(F.desc("cosine"), "userId").limit(k)


def user_neighbours(ratings: DataFrame, movies: DataFrame, user: int, n: int, k: int) -> DataFrame:
    """(serial, movieId, title) of the ``n`` items with the highest mean over ``k`` users, zeros included, in table order; seen items are not left out."""
    near = neighbours(ratings, user, k).select("userId")
    mean = ratings.join(near, "userId", "left_semi").groupBy("movieId").agg((F.sum("rating") / k).alias("score"))
    best = mean.orderBy(F.desc(F.round("score", 9)), "movieId").limit(n)
    return movies.join(best, "movieId", "left_semi").select(F.row_number().over(Window.orderBy("movieId")).alias("serial"), "movieId", "title")
