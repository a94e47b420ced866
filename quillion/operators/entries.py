"""Ranking and choosing encyclopedia entries for terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillion.functions import html
from quillion.functions.text import normalize_term

#: The score that wins alone, the lead that it needs, results kept for each query, candidates kept for a model.
CLEAR_SCORE, CLEAR_LEAD, RESULTS, CANDIDATES = 90, 15, 5, 3


def keyed_queries(terms: DataFrame, key: str) -> DataFrame:
    """(key, queries): a term's and its aliases' keys, each once, in order."""
    each = terms.select(key, F.posexplode(F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("nth", "spelling"))
    each = each.withColumn("q", normalize_term(F.col("spelling"))).where("q <> ''")
    return each.groupBy(key).agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("nth", "q"))), lambda x: x["q"])).alias("queries"))


def score(title: Column, url: Column, snippet: Column, queries: Column) -> Column:
    """Best rung that any query reaches; all arguments are normalised."""

    def of(q: Column) -> Column:
        rungs = [
            (title == q, 120), (F.startswith(title, F.concat(q, F.lit(" "))) | F.endswith(title, F.concat(F.lit(" "), q)), 100), (F.contains(title, q), 90),
            ((url == q) | F.contains(url, F.regexp_replace(q, r"\s+", "-")), 88), (html.contains_all_words(title, q), 78), (html.contains_all_words(url, q), 72), (html.contains_all_words(snippet, q), 62),
        ]
        out = F.when(*[rungs[0][0], F.lit(rungs[0][1])])
        for holds, points in rungs[1:]:
            out = out.when(holds, F.lit(points))
        return out.otherwise(F.lit(0))

    return F.coalesce(F.array_max(F.transform(queries, of)), F.lit(0))


def rank(candidates: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """Candidates (key, title, url, snippet) of every term, scored and ranked: by score, then by title."""
    made = candidates.withColumns({"t": normalize_term(F.col("title")), "s": normalize_term(F.col("snippet")), "u": normalize_term(html.url_slug(F.col("url")))})
    both = made.join(keyed_queries(terms, key), key)
    both = both.withColumns({"score": score(F.col("t"), F.col("u"), F.col("s"), F.col("queries")), "exact": F.array_contains("queries", F.col("t"))})
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.lower("title"), "title", "url"))
    return both.withColumn("rank", place).drop("t", "s", "u", "queries")


def pick(ranked: DataFrame, key: str) -> DataFrame:
    """(key, title, url, score, picked): the best candidate, picked if its title is exact or its score is clear and well ahead."""
    second = F.lead("score").over(Window.partitionBy(key).orderBy("rank"))
    best = ranked.withColumn("second", second).where("rank = 1")
    clear = (F.col("score") >= CLEAR_SCORE) & (F.col("second").isNull() | (F.col("score") - F.col("second") >= CLEAR_LEAD))
    return best.select(key, "title", "url", "score", (F.col("exact") | clear).alias("picked"))


def first_answered(results: DataFrame, key: str) -> DataFrame:
    """Of the results of a term's queries (key, query_nth, nth): the first query that has any, and its first five."""
    first = F.min("query_nth").over(Window.partitionBy(key))
    place = F.row_number().over(Window.partitionBy(key).orderBy("nth"))
    return results.withColumn("first", first).where("query_nth = first").withColumn("place", place).where(F.col("place") <= RESULTS).drop("first", "place")


def targets(entries: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Requested entries whose status is not settled yet."""
    return entries.join(wanted.select(key), key, "left_semi").where(~F.coalesce("status", F.lit("")).isin("matched", "not_found"))


def resolve(choices: DataFrame, candidates: DataFrame, key: str, host: str = html.ENTRY_HOST) -> DataFrame:
    """A model's choice (key, chosen_url, chosen_title) as a candidate: by URL, else by title, else made up if it is an entry's URL."""
    c = choices.withColumns({"u": html.entry_url(F.col("chosen_url"), host), "t": normalize_term(F.col("chosen_title"))})
    pool = candidates.select(key, "title", "url", normalize_term(F.col("title")).alias("nt"))
    by_url = pool.groupBy(F.col(key), F.col("url").alias("u")).agg(F.first("url").alias("url"), F.min("title").alias("title_u"))
    by_title = pool.groupBy(F.col(key), F.col("nt").alias("t")).agg(F.min_by("url", "title").alias("url_t"), F.min("title").alias("title_t"))
    out = c.join(by_url, [key, "u"], "left").join(by_title, [key, "t"], "left")
    made = F.when(F.col("u") != "", F.col("u"))
    return out.select(key, F.coalesce("url", "url_t", made).alias("url"), F.when(F.col("url").isNotNull(), F.col("title_u")).when(F.col("url_t").isNotNull(), F.col("title_t")).when(made.isNotNull(), F.col("chosen_title")).alias("title"))


def run_summary(entries: DataFrame) -> DataFrame:
    """Counts of a run: matched, not found, failed, skipped."""
    return entries.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("matched", "not_found", "failed")], F.count_if(~F.coalesce("status", F.lit("")).isin("matched", "not_found", "failed")).alias("skipped"))
