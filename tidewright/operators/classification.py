"""Suggesting concepts for articles from the words of their titles, categories and links.

Articles and concept terms meet by an equi join on single words, after articles
were reduced to their different words; nothing compares an article with all
concepts. Counts are combined before the shuffle, and the best concept of each
branch comes from a maximum, not from a sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.functions.scores import logistic

#: Most points that words alone can give, and what a title, a category and a link word count.
MOST, TITLE, CATEGORY, LINK = 95, 18, 7, 2
#: A place without a title word of the concept gets at most so much.
PLACE_MOST = 22


def page_kind(categories: Column, kinds: dict[str, tuple[str, ...]], unknown: str) -> Column:
    """The kind with the most categories that contain one of its keys; the first named wins ties."""
    holds = lambda keys: lambda c: reduce(lambda a, b: a | b, [c.contains(x) for x in keys])
    count = {k: F.size(F.filter(categories, holds(keys))) for k, keys in kinds.items()}
    most = F.greatest(*count.values()) if len(count) > 1 else next(iter(count.values()))
    return F.when(F.coalesce(most, F.lit(0)) == 0, unknown).otherwise(F.coalesce(*[F.when(n == most, k) for k, n in count.items()]))


def classified(articles: DataFrame, terms: DataFrame, *, item: str, kinds: dict[str, tuple[str, ...]], noise: tuple[str, ...] = (), place: str = "PLACE", unknown: str = "UNKNOWN", entities: DataFrame | None = None, pattern: str = "[a-z]+") -> DataFrame:
    """(item, kind, branch, concept, score, reason): the best concept of each branch that an article has a sign of.

    ``articles`` has the columns item, title, categories, links (arrays) and, with ``entities``,
    qid; ``terms`` is (branch, concept, term), ``entities`` (branch, concept, qid). A concept needs a
    title word, a category word, two link words or the article's own entity. Ties go to the
    greater concept id. Categories that begin with a ``noise`` word don't count.
    """
    clean = F.transform(F.coalesce("categories", F.array().cast("array<string>")), lambda c: T.squeezed(c))
    if noise:
        clean = F.filter(clean, lambda c: ~reduce(lambda a, b: a | b, [c.startswith(x) for x in noise]))
    base = articles.withColumn("_cats", clean).withColumn("kind", page_kind(F.col("_cats"), kinds, unknown))
    words = {"tm": T.tokens("title", pattern=pattern), "cm": T.tokens(F.array_join("_cats", " "), pattern=pattern), "lm": T.tokens(F.array_join(F.coalesce("links", F.array().cast("array<string>")), " "), pattern=pattern)}
    mark = lambda n: lambda x: F.struct(F.lit(n).alias("of"), x.alias("term"))
    marked = F.concat(*[F.transform(w, mark(n)) for n, w in words.items()])
    met = base.select(item, F.explode(marked).alias("w")).select(item, "w.of", "w.term").join(terms.select("branch", "concept", "term").distinct(), "term")
    parts = [met.select(item, "branch", "concept", *[(F.col("of") == n).cast("int").alias(n) for n in words], F.lit(0).alias("linked"))]
    if entities is not None:
        own = base.filter("qid is not null").select(item, "qid").join(entities.select("branch", "concept", "qid").distinct(), "qid")
        parts.append(own.select(item, "branch", "concept", *[F.lit(0).alias(n) for n in words], F.lit(1).alias("linked")))
    counts = reduce(DataFrame.unionByName, parts).groupBy(item, "branch", "concept").agg(*[F.sum(n).alias(n) for n in words], F.max("linked").alias("linked"))
    tm, cm, lm, linked = (F.col(c) for c in ("tm", "cm", "lm", "linked"))
    signs = counts.filter((tm > 0) | (cm > 0) | (lm >= 2) | (linked > 0)).join(base.select(item, "kind"), item)
    score = F.least(F.lit(MOST), TITLE * tm + CATEGORY * F.least(F.lit(5), cm) + LINK * F.least(F.lit(4), lm) + F.when((tm > 0) & (cm > 0), 7).otherwise(0) + 75 * linked)
    score = F.when((F.col("kind") == place) & (tm == 0) & (linked == 0), F.least(score, F.lit(PLACE_MOST))).otherwise(score)
    best = signs.withColumn("score", score.cast("int")).groupBy(item, "kind", "branch").agg(F.max(F.struct("score", "concept", "tm", "cm", "lm", "linked")).alias("m"))
    reason = F.concat_ws(";", *[F.concat(F.lit(f"{label}="), F.col(f"m.{n}")) for label, n in (("title_words", "tm"), ("category_words", "cm"), ("link_words", "lm"), ("entity", "linked"))])
    return best.select(item, "kind", "branch", "m.concept", "m.score", reason.alias("reason"))


def reclassified(profiles: DataFrame, suggestions: DataFrame, terms: DataFrame, signature: str, *, item: str, **how) -> DataFrame:
    """Suggestions after the terms changed to ``signature``: those of profiles that were classified under
    another one are made anew from the stored titles, categories and links; the others stay.

    ``profiles`` has the columns of articles and ``signature``. A profile without stored categories
    and links can't be classified again; that is an error.
    """
    stale = profiles.filter(~F.col("signature").eqNullSafe(F.lit(signature)))
    broken = stale.filter(F.col("categories").isNull() | F.col("links").isNull()).select(item).limit(5).collect()
    if broken:
        raise ValueError(f"profiles without stored categories and links: {[r[0] for r in broken]}")
    kept = suggestions.join(stale.select(item), item, "left_anti")
    return kept.unionByName(classified(stale, terms, item=item, **how))


# Title words of abstract subjects, and of the subject itself.
ABSTRACT = ("virtue", "wisdom", "reason", "rights", "violence", "multiculturalism", "legislation", "bias", "demography", "justice", "globalization", "decentralization", "language", "religion", "philosophy", "law")
SUBSTANTIVE = ("desegregation", "education", "educational", "school", "schools", "college", "colleges", "university", "universities", "schooling", "pedagogy", "teaching", "instruction", "bilingual", "curriculum", "teacher", "teachers")


def planning_features(*, links: Column, sources: Column, categories: Column, subcategories: Column, seeds: Column, title: Column, labels: Column, category_titles: Column, source_titles: Column, article_text: Column, scope_note: Column, educational: tuple[str, ...], places: tuple[str, ...] = (), stop: tuple[str, ...] = (), pattern: str = "[a-z]+") -> dict[str, Column]:
    """The 17 features of the planning model, each from 0 to 1.

    ``sources`` holds the titles of linking articles, ``category_titles`` those of categories,
    ``source_titles`` those of all evidence (arrays); ``places`` are patterns of place categories.
    """
    words = lambda c: T.tokens(c, pattern=pattern)
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")
    concept = F.array_except(words(labels), F.array(*map(F.lit, stop)).cast("array<string>"))
    name, cats, from_ = words(title), words(joined(category_titles)), words(joined(source_titles))
    share = lambda c, most: F.least(F.coalesce(c, F.lit(0)), F.lit(most)) / most
    overlap = lambda c: F.size(F.array_intersect(concept, c)) / F.greatest(F.lit(1), F.size(concept))
    holds = lambda c, known: F.arrays_overlap(c, F.array(*map(F.lit, known))).cast("double")
    there = lambda c: (F.length(F.trim(F.coalesce(c, F.lit("")))) > 0).cast("double")
    place = F.exists(F.coalesce(category_titles, F.array().cast("array<string>")), lambda c: reduce(lambda a, b: a | b, [T.squeezed(c).rlike(p) for p in places], F.lit(False)))
    return {
        "direct_links": share(links, 5),
        "direct_sources": share(F.size(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>")))), 4),
        "category_links": share(categories, 5),
        "subcategory_links": share(subcategories, 4),
        "seeds": share(seeds, 5),
        "title_concept_overlap": overlap(name),
        "category_concept_overlap": overlap(cats),
        "source_concept_overlap": overlap(from_),
        "title_educational": holds(name, educational),
        "category_educational": holds(cats, educational),
        "source_educational": holds(from_, educational),
        "generic_geography": place.cast("double"),
        "article_is_abstract": holds(name, ABSTRACT),
        "title_substantive": holds(name, SUBSTANTIVE),
        "text_available": there(article_text),
        "text_concept": F.coalesce(F.arrays_overlap(concept, words(article_text)), F.lit(False)).cast("double"),
        "scope_note": there(scope_note),
    }


def planned(df: DataFrame, features: dict[str, Column], weights: dict[str, float], intercept: float, name: str = "p") -> DataFrame:
    """``df`` with the features and the logistic model's probability."""
    return df.withColumns(features).withColumn(name, logistic({k: F.col(k) for k in features}, weights, intercept))
