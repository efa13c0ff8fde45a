"""Scores and tiers as column expressions.

Fixed values: the weights, caps and thresholds of each formula, and the names of signals,
reasons and tiers below are the catalogue's own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions import text as T


def _capped(most: int, each: int, n: Column) -> Column:
    return F.least(F.lit(most), each * n)


def discovery_priority(seeds: Column, links: Column, shared: Column, subs: Column, overlap: Column) -> Column:
    """Evidence from linked discovery: base 40, each kind capped, 90 at most, then up to 15 for title words."""
    evidence = 40 + _capped(20, 6, F.greatest(F.lit(0), seeds - 1)) + _capped(12, 4, links) + _capped(12, 6, shared) + _capped(8, 4, subs)
    return F.least(F.lit(90), evidence) + _capped(15, 5, overlap)


def planning_score(links: Column, shared: Column, subs: Column, seeds: Column, title_words: Column, concept_words: Column) -> Column:
    """Planning score 0 to 100 from link, category and title evidence, with penalties."""
    overlap = T.shared_words(title_words, concept_words)
    general = (F.size(title_words) > 0) & (F.size(F.array_except(title_words, F.array(*map(F.lit, T.GENERAL_WORDS)))) == 0)
    raw = 3 + _capped(37, 13, links) + _capped(18, 4, seeds) + _capped(8, 2, shared) + F.least(F.lit(5), subs) + _capped(26, 13, overlap)
    raw = raw - F.when(general & (overlap == 0), 24).otherwise(0) - F.when((links == 0) & (overlap == 0), 12).otherwise(0) - F.when((subs > 0) & (links == 0), 3).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), raw))


def blended(score: Column, profile: Column, same_concept: Column, broad: Column) -> Column:
    """Four fifths of a score (20 at least for broad matches) and one of a profile, 5 more for the same concept."""
    own = F.when(broad, F.greatest(score, F.lit(20))).otherwise(score)
    mixed = F.least(F.lit(100), F.bround(own * 0.8 + profile * 0.2 + F.when(same_concept, 5).otherwise(0)).cast("int"))
    return F.when(profile.isNull(), own).otherwise(mixed)


def lexical_ladder(name: Column, label: Column, stop: tuple[str, ...] = ()) -> Column:
    """struct(score, reason): how a name matches a label, from equal titles down to shared words."""
    n, l = T.squeezed(name), T.squeezed(label)
    words, has = T.tokens(label, least=2, stop=stop), T.tokens(F.translate(name, "_", " "), least=2, stop=stop)
    shared, size = T.shared_words(words, has), F.size(words)
    part = F.least(F.lit(60), 20 + F.floor(40 * shared / size)).cast("int")
    rungs = [
        (n == l, F.lit(100), "EXACT_TITLE"),
        (n.startswith(F.concat(l, F.lit(" "))) | n.endswith(F.concat(F.lit(" "), l)), F.lit(88), "TITLE_PHRASE"),
        (n.contains(l), F.lit(79), "PHRASE"),
        ((size > 0) & (shared == size), F.lit(68), "ALL_TOKENS"),
        (shared > 0, part, "TOKEN_OVERLAP"),
    ]
    score = F.coalesce(*[F.when(test, value) for test, value, _ in rungs], F.lit(0))
    reason = F.coalesce(*[F.when(test, name) for test, _, name in rungs], F.lit("NO_SIGNAL"))
    return F.struct(score.alias("score"), reason.alias("reason"))


def category_confidence(depth: Column, reviewed: Column) -> Column:
    """Confidence of a category route: less with depth, more when reviewed, 20 at least."""
    return F.greatest(F.lit(20), F.when(reviewed, 78).otherwise(64) - 8 * depth)


def title_boost(title: Column, known: Column) -> Column:
    """Known words of a title at 6 each with topical boosts, 35 at most."""
    t = F.lower(title)
    boost = F.when(t.contains("education"), 9).otherwise(0) + F.when(t.contains("school"), 4).otherwise(0) + F.when(t.contains("policy") | t.contains("curriculum"), 5).otherwise(0)
    return F.least(F.lit(35), 6 * known + boost)


def crawl_score(depth: Column, title_part: Column, source_score: Column, redirect: Column) -> Column:
    """Score of a page reached over a link, to three decimals, less for redirects."""
    return F.bround(70 - 22 * depth + title_part + F.least(F.lit(10.0), F.log1p(source_score.cast("double"))), 3) - F.when(redirect, 9).otherwise(0)


def logistic(features: dict[str, Column], weights: dict[str, float], intercept: float = 0.0, clamp: float = 30.0) -> Column:
    """A logistic model of named features; the sum is clamped before the exponential."""
    total = F.lit(float(intercept))
    for name, column in features.items():
        total = total + column.cast("double") * float(weights.get(name, 0.0))
    total = F.greatest(F.lit(-clamp), F.least(F.lit(clamp), total))
    return 1.0 / (1.0 + F.exp(-total))


def review_triage(anchors_seen: Column, anchors_total: Column, families: Column, many_lexemes: Column, many_pos: Column, nfc_variants: Column, glosses: Column, sense_ids: Column, cut: Column) -> Column:
    """struct(signals, tier, priority): in what order lexical candidates are reviewed."""
    missing = anchors_seen != anchors_total
    thin = families < 2
    signals = F.array_compact(
        F.array(
            F.when(missing, "missing_or_invalid_sample_anchors"),
            F.when(many_lexemes, "multiple_external_lexemes_same_graphy"),
            F.when(many_pos, "heterogeneous_pos_labels_require_mapping"),
            F.when(nfc_variants > 1, "distinct_NFC_spellings_collapsed_by_search_key"),
            F.when(cut, "evidence_fields_truncated"),
            F.when(glosses > 1, "multiple_glosses_require_sense_disambiguation"),
            F.when((glosses == 0) & (sense_ids == 0), "no_gloss_or_external_sense_id"),
            F.when(thin, "source_family_evidence_incomplete"),
        )
    )
    rungs = [
        (missing | thin, "source_evidence_incomplete"),
        (many_lexemes | (nfc_variants > 1), "possible_lexeme_or_normalization_ambiguity"),
        (many_pos, "pos_mapping_review"),
        ((glosses > 0) & (sense_ids > 0), "sense_comparison_queue"),
        ((glosses > 0) | (sense_ids > 0), "limited_sense_evidence"),
        (F.lit(True), "lemma_morphology_only"),
    ]
    tier = F.coalesce(*[F.when(test, name) for test, name in rungs])
    priority = F.coalesce(*[F.when(test, i + 1) for i, (test, _) in enumerate(rungs)])
    return F.struct(signals.alias("signals"), tier.alias("tier"), priority.alias("priority"))


def first_error(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that fails (its test is false or null), or null."""
    return F.coalesce(*[F.when(~F.coalesce(test, F.lit(False)), name) for name, test in rules])
