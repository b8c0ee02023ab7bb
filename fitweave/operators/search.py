"""A table of keyword searches answered at once.

Meaning as in ``dashboard.keyword_search``: a job is found if its folded text contains every term of the
search as a substring.  The text is indexed by its substrings of one to three characters.  Of the lists
that a search asks for the shortest are intersected, and what is left is verified on the text, so the work
of a search follows its rarest part and not the number of jobs.  Searches for the same terms, in any order, are
one until their hits are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitweave.functions import text as T
from fitweave.operators.dashboard import search_text
from fitweave.operators.skew import balanced_join, sized_join
from fitweave.session import materialize

GRAM = 3
LISTS = 2


def search_terms(terms: Column) -> Column:
    """Folded terms of a search; none for an empty or missing one."""
    folded = T.without_accents(F.lower(F.coalesce(terms, F.lit(""))))
    return F.array_distinct(F.filter(F.split(folded, r"(?U)\s+"), lambda t: t != ""))


def _substrings(value: Column, length: int) -> Column:
    places = F.sequence(F.lit(1), F.length(value) - (length - 1))
    cut = F.transform(places, lambda at: F.substring(value, at, F.lit(length)))
    return F.when(F.length(value) >= length, cut).otherwise(T.empty_words())


def text_grams(value: Column) -> Column:
    """All distinct substrings of one to three characters, and the empty one, which every text has."""
    return F.array_distinct(F.concat(F.array(F.lit("")), *[_substrings(value, n) for n in range(1, GRAM + 1)]))


def asked_grams(terms: Column) -> Column:
    """Index entries that every hit of a search must have; the empty entry stands for a search without terms."""
    pieces = F.transform(terms, lambda t: F.when(F.length(t) < GRAM, F.array(t)).otherwise(_substrings(t, GRAM)))
    return F.when(F.size(terms) > 0, F.array_distinct(F.flatten(pieces))).otherwise(F.array(F.lit("")))


def search_many(jobs: DataFrame, searches: DataFrame, columns: list[str] | None = None, *, lists: int = LISTS) -> DataFrame:
    """search_id and job_id of every hit.

    ``jobs``: job_id and the searched columns.  ``searches``: search_id (unique) and terms.  A search without
    terms finds every job, as it does on the dashboard.  Lists of entries that no search asks for are not
    written; a list that holds most jobs is sliced, and so are the searches that share it.
    """
    texts = jobs.select("job_id", search_text(columns).alias("_text"))
    members = materialize(
        searches.select(F.col("search_id").alias("_member"), F.array_sort(search_terms(F.col("terms"))).alias("_terms")), "searches"
    )
    groups = members.groupBy("_terms").agg(F.min("_member").alias("search_id"))
    asked = materialize(groups.withColumn("_grams", asked_grams(F.col("_terms"))), "distinct-searches")
    needs = asked.select("search_id", F.explode("_grams").alias("_gram"))
    # distinct entries: at most the cube of the letters in use, and joined by size
    wanted = materialize(needs.select("_gram").distinct(), "search-grams")
    entries = texts.select("job_id", F.explode(text_grams(F.col("_text"))).alias("_gram"))
    postings = materialize(sized_join(entries, wanted, ["_gram"], ["job_id"]), "search-postings")
    lengths = materialize(postings.groupBy("_gram").agg(F.count(F.lit(1)).alias("_length")), "search-lengths")
    # a search has as many entries as its own text has characters
    rarest = (
        sized_join(needs, lengths, ["_gram"], ["search_id"], how="left").groupBy("search_id")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("_length", F.lit(0)).alias("_length"), "_gram"))).alias("_ranked"))
        .select("search_id", F.slice("_ranked", 1, lists).alias("_ranked"))
    )
    chosen = rarest.where(F.col("_ranked")[0]["_length"] > 0).select(
        "search_id", F.size("_ranked").alias("_lists"), F.explode("_ranked._gram").alias("_gram")
    )
    met = balanced_join(postings, chosen, ["_gram"], ["job_id"], spread_right_by=["search_id"])
    candidates = met.groupBy("search_id", "job_id").agg(F.count(F.lit(1)).alias("_met"), F.first("_lists").alias("_lists"))
    candidates = candidates.where(F.col("_met") == F.col("_lists")).select("search_id", "job_id")
    candidates = materialize(candidates, "search-candidates")
    with_text = balanced_join(candidates, texts, ["job_id"], ["search_id"])
    with_terms = balanced_join(
        with_text, asked.select("search_id", "_terms"), ["search_id"], ["job_id"], counted=candidates.select("search_id")
    )
    found = with_terms.where(F.forall("_terms", lambda t: F.col("_text").contains(t))).select("search_id", "job_id")
    if members.count() == asked.count():
        return found
    # only here do hits come for every search, and what follows decides whether they are written
    same = materialize(members.join(asked.select("_terms", "search_id"), "_terms").select("search_id", "_member"), "same-searches")
    hits = sized_join(found, same, ["search_id"], ["job_id"], counted=candidates.select("search_id"), spread_right_by=["_member"])
    return hits.select(F.col("_member").alias("search_id"), "job_id")
