"""Scores, intents and tests over text; every word list is a parameter."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from dossier.functions.rules import contains_any, count_matching, first_reason, ladder, weight_sum
from dossier.functions.text import norm_ws, strip


def n_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def sentence_score(s: Column, metric_hint: str, keywords: list[str], noise: str) -> Column:
    """Metric hint 3, year 4 or 2, number 3 or 1, keyword 2 each, noise -5."""
    low = F.lower(s)
    years = n_matches(s, r"\b20\d{2}\b")
    nums = n_matches(s, r"\d+(?:\.\d+)?")
    return (F.when(low.rlike(metric_hint), 3).otherwise(0)
            + F.when(years >= 2, 4).when(years == 1, 2).otherwise(0)
            + F.when(nums >= 2, 3).when(nums == 1, 1).otherwise(0)
            + 2 * count_matching(low, keywords)
            - F.when(low.rlike(noise), 5).otherwise(0))


def best_sentences(sents: Column, score, n: int = 2) -> Column:
    """n best of an array of sentences by ``score(sentence)``, earlier first on ties."""
    rated = F.transform(sents, lambda s, i: F.struct((-score(s)).alias("neg"), i.alias("pos"), s.alias("s")))
    return F.slice(F.array_sort(rated), 1, n)


def clean_disclosure(c: Column, drops: list[str], noise_words: list[str], max_len: int = 400) -> Column:
    """Chrome patterns removed; a long rest shrinks to its first sentence without noise words."""
    t = F.coalesce(c, F.lit(""))
    for d in drops:
        t = F.regexp_replace(t, d, " ")
    t = norm_ws(t)
    sents = F.split(t, r"(?<=[.!?])\s+")
    good = F.filter(sents, lambda s: (F.length(s) >= 24) & ~contains_any(F.lower(s), noise_words))
    return F.when(F.length(t) <= max_len, t).otherwise(F.coalesce(F.get(good, F.lit(0)), t))


def specificity(question: Column, answer: Column, generic: list[str]) -> Column:
    """Numbers and names in the answer, less generic wording in the question."""
    return (F.least(n_matches(answer, r"\d+(?:\.\d+)?"), F.lit(4)) * 1.0
            + F.least(n_matches(answer, r"[A-Z][a-z]{3,}"), F.lit(4)) * 0.5
            + F.when(F.length(answer).between(40, 400), 1.5).otherwise(0.0)
            - 1.0 * count_matching(F.lower(question), generic))


def cleanliness(c: Column) -> Column:
    """1.0 less shares of symbols and pipe residue, not below 0."""
    n = F.greatest(F.length(c), F.lit(1))
    return F.greatest(F.lit(0.0), 1.0 - n_matches(c, r"[^a-zA-Z0-9_\s.,;:!?'-]") / n * 5.0 - n_matches(c, r"\|") / n * 10.0)


def headcount_intent(q: Column, guard: str, strong: str, soft: str) -> Column:
    return ~q.rlike(guard) & (q.rlike(strong) | q.rlike(soft))


def metric_intent(q: Column, percent: str, count: str, bypass: Column | None = None, noise: str = r"(?!)",
                  max_terms: int = 6, min_len: int = 4) -> Column:
    """struct(kind, terms): percentage, count or null, with at most six topic words."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(q, noise, " ")), F.lit(r"([a-z가-힣]{%d,})" % min_len), F.lit(1))
    kind = F.when(q.rlike(percent), "percentage").when(q.rlike(count), "count")
    if bypass is not None:
        kind = F.when(~bypass, kind)
    return F.struct(kind.alias("kind"), F.slice(F.array_distinct(words), 1, max_terms).alias("terms"))


def anchor_passes(text: Column, kind: Column, terms: Column, percent_re: str = r"\d+(?:[.,]\d+)?\s*%",
                  count_re: str = r"\d+(?:[.,]\d+)?\s*(?:people|units|cases|items)") -> Column:
    """A number of the asked kind and one of the topic words are in the text."""
    num = F.when(kind == "percentage", text.rlike(percent_re)).otherwise(text.rlike(count_re))
    return num & ((F.size(terms) == 0) | F.exists(terms, lambda t: F.lower(text).contains(t)))


def entity_mismatch(text: Column, body: Column, display: Column, terms: Column, has_number: Column) -> Column:
    """Topic and number are there, the company is not."""
    hit = F.exists(terms, lambda t: F.lower(text).contains(t))
    return (display != "") & ~body.contains(display) & (F.size(terms) > 0) & hit & has_number


def path_tier(path: Column, tiers: list[tuple[str, str]], default: str = "other") -> Column:
    return ladder([(path.contains(k), v) for k, v in tiers], default)


def source_rank(path: Column, ranks: list[tuple[str, int]], floor: int = 10) -> Column:
    """Highest trust rank of the keywords in the path."""
    low = F.lower(path)
    return F.greatest(F.lit(floor), *[F.when(low.contains(k), F.lit(v)).otherwise(F.lit(floor)) for k, v in ranks], F.lit(floor))


def evidence_type(metric: Column, tags: Column, section: Column) -> Column:
    low = F.lower(F.concat_ws(" ", tags, section))
    return F.when(metric.isNotNull(), "metric").when(low.contains("policy"), "policy").when(
        low.contains("strategy"), "strategy").when(low.contains("risk"), "risk").otherwise("text")


def confidence_level(score: Column, high: float, medium: float) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def confidence_points(has_record: Column, has_metric: Column, score: Column, direct: Column) -> Column:
    pts = (has_record.cast("int") + has_metric.cast("int") * 2 + direct.cast("int")
           + F.when(score >= 0.6, 2).when(score >= 0.3, 1).otherwise(0))
    return F.when(pts >= 4, "high").when(pts >= 2, "medium").otherwise("low")


def toc_heavy(c: Column, min_hits: int = 5) -> Column:
    return n_matches(c, r"\.{4,}|(?:\s\d{1,3}\s*\n)") >= min_hits


def navigation_heavy(c: Column, words: list[str], min_hits: int = 3) -> Column:
    return count_matching(F.lower(c), words) >= min_hits


def listing_heavy(c: Column, per_chars: int = 60) -> Column:
    return (F.length(c) > 0) & (n_matches(c, r"[|•]") * per_chars > F.length(c))


def date_only(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"[\d\s./:-]+", "")) == ""


def truncated(c: Column) -> Column:
    t = strip(c)
    return (F.length(t) > 0) & ~t.rlike(r"[.!?\"')\]]$")


def passage_reason(c: Column, nav: list[str], finance: str, contact: str, substance: str, min_len: int = 80) -> Column:
    """First reason to leave a passage out, null when it stays."""
    low = F.lower(c)
    return first_reason([
        (F.length(c) < min_len, "too_short"),
        (navigation_heavy(c, nav), "navigation"),
        (listing_heavy(c), "listing"),
        (low.rlike(finance) & ~low.rlike(substance), "finance_only"),
        (low.rlike(contact) & ~low.rlike(substance), "contact_only"),
        (~low.rlike(substance), "no_substance")])


def noise_substance(c: Column, noise: list[tuple[str, float]], substance: list[tuple[str, float]]) -> tuple[Column, Column, Column]:
    """(noise score, substance score, substance share)."""
    n, s = weight_sum(c, noise), weight_sum(c, substance)
    return n, s, F.when(n + s == 0, F.lit(0.0)).otherwise(s / (n + s))


def prefilter_decision(noise: Column, substance: Column, ratio: Column, length: Column, min_len: int = 80,
                       drop_noise: float = 6.0, keep_ratio: float = 0.6, min_substance: float = 2.0) -> Column:
    """struct(decision, rule): the first rule that fits."""
    r = lambda d, k: F.struct(F.lit(d).alias("decision"), F.lit(k).alias("rule"))
    return ladder([
        (length < min_len, r("drop", "R1_short")),
        ((noise >= drop_noise) & (substance < min_substance), r("drop", "R2_noise")),
        (substance == 0, r("drop", "R3_no_substance")),
        ((ratio >= keep_ratio) & (substance >= min_substance), r("keep", "R4_substance")),
        (ratio >= keep_ratio, r("conditional", "R5_thin")),
        (noise >= drop_noise, r("conditional", "R6_noisy"))], r("conditional", "R7_mixed"))


def empty_list_page(c: Column, zero: str = r"\b0\s*(?:items|results)\b", none: str = r"no results|no data",
                    cell: str = r"<td[^>]*>\s*(?:&nbsp;)?\s*</td>", min_cells: int = 8) -> Column:
    low = F.lower(c)
    return low.rlike(zero) | low.rlike(none) | (n_matches(low, cell) >= min_cells)
