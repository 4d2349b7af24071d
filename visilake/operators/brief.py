"""Content briefs: what the top of a query shows, what it lacks and what follows from it.

One wide aggregation of at most ``top`` documents per snapshot feeds patterns, gaps and
recommendations; gaps and recommendations are codes with their numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import lists as L
from . import serp as S

SNAPSHOT = ("snapshot_id", "query", "region")


def _re(pattern: str) -> str:
    return f"(?iuU){pattern}"


def brief_facts(docs: DataFrame, as_of, top: int = 10, patterns=L.TITLE_PATTERNS, cases: str = L.CASE_WORDS, price: str = L.PRICE_INTENT) -> DataFrame:
    """Counts over the first ``top`` sites of each snapshot."""
    title = F.coalesce("title", F.lit(""))
    low = F.lower(title)
    text = F.lower(F.concat(title, F.lit(" "), F.coalesce("passage", F.lit(""))))
    modified = K.parse_modtime("modtime")
    pages = S.top_sites(docs.where("error IS NULL"), top).select(
        *SNAPSHOT, F.unix_micros(modified).alias("modified"),
        title.rlike(r"(?U)\d").alias("digits"), text.rlike(_re(cases)).alias("case"), text.rlike(f"(?uU){price}").alias("priced"),
        K.is_portal("domain").alias("portal"), (F.col("url_depth") == 0).alias("home"),
        (F.col("title_hlwords") >= K.query_words("query")).alias("exact"),
        *[low.rlike(_re(p)).alias(f"p{i}") for i, (_, p) in enumerate(patterns)],
    )
    facts = pages.groupBy(*SNAPSHOT).agg(
        F.count(F.lit(1)).alias("pages"),
        *[F.count_if(c).alias(c) for c in ("digits", "case", "priced", "portal", "home", "exact")],
        F.count("modified").alias("dated"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY modified)").cast("bigint").alias("modified"),
        *[F.count_if(f"p{i}").alias(f"p{i}") for i in range(len(patterns))],
    )
    days = F.floor((F.unix_micros(K.moment(as_of)) - F.col("modified")) / F.lit(86_400_000_000))
    labels = F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"p{i}").alias("pages")) for i, (label, _) in enumerate(patterns)])
    return facts.select(
        *SNAPSHOT, "pages", "digits", "case", "priced", "portal", "home", "exact", "dated",
        F.timestamp_micros("modified").alias("median_modified"), (days / 365.25).alias("median_age"),
        F.filter(labels, lambda x: x["pages"] > 0).alias("labels"),
    )


def title_patterns(facts: DataFrame) -> DataFrame:
    """Title constructions of a snapshot met on enough pages, most frequent first."""
    return facts.select(*SNAPSHOT, F.col("pages").alias("of"), F.inline("labels")).where(F.col("pages") >= L.MIN_PATTERN_PAGES)


def related_queries(expansions: DataFrame, limit: int = L.RELATED_LIMIT) -> DataFrame:
    """Refinements before associations, by demand, each phrase once: (query, rank, phrase, freq, kind)."""
    kind = F.when(F.col("kind") == "top", 0).otherwise(1)
    rows = expansions.withColumn("phrase", F.trim("phrase")).where((F.col("phrase") != "") & (F.lower("phrase") != K.squeezed("query")))
    once = rows.groupBy("query", F.lower("phrase").alias("_k")).agg(
        F.min(F.struct(kind.alias("o"), (-F.col("freq")).alias("f"), "place", "phrase", "freq", "kind")).alias("e")
    )
    order = W.partitionBy("query").orderBy("e.o", "e.f", "e.place", "_k")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query", "rank", "e.phrase", "e.freq", "e.kind")


def related_facts(related: DataFrame, price: str = L.PRICE_INTENT, questions: str = L.QUESTION_WORDS) -> DataFrame:
    """One bounded row per query: its related phrases and the price phrase asked first."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "phrase", "freq", "kind"))).alias("related")
    rows = related.groupBy("query").agg(listed)
    asked = F.filter("related", lambda r: r["phrase"].rlike(f"(?uU){price}"))
    refined = F.filter("related", lambda r: r["kind"] == "top")
    return rows.select(
        "query", "related", F.get(asked, F.lit(0))["phrase"].alias("price_asked"),
        F.transform(F.slice(refined, 1, 3), lambda r: r["phrase"]).alias("candidates"),
        F.transform(F.slice(F.filter(refined, lambda r: r["phrase"].rlike(f"(?uU){questions}")), 1, 4), lambda r: r["phrase"]).alias("questions"),
    )


def _gap(when: Column, code: str, number: Column) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), number.cast("double").alias("number"), F.col("pages").alias("of")))


def _label_count(labels) -> Column:
    hits = F.transform(F.filter("labels", lambda x: x["label"].isin(*labels)), lambda x: x["pages"])
    return F.coalesce(F.array_max(hits), F.lit(0))


def content_gaps(facts: DataFrame, related: DataFrame | None = None, commercial_labels=L.COMMERCIAL_LABELS) -> DataFrame:
    """Observed gaps of each snapshot, every one with the number it rests on."""
    rows = facts if related is None else facts.join(related, "query", "left")
    if related is None:
        rows = rows.withColumn("price_asked", F.lit(None).cast("string"))
    n = F.col("pages")
    commercial = _label_count(commercial_labels)
    gaps = F.array_compact(
        F.array(
            _gap(F.col("digits") == 0, "no_digits", F.col("digits")),
            _gap((F.col("dated") >= 3) & (F.col("median_age") >= L.STALE_YEARS), "stale", F.round("median_age", 1)),
            _gap(F.col("case") == 0, "no_cases", F.col("case")),
            _gap((F.col("portal") > 0) & (F.col("portal") * 2 >= n), "portals", F.col("portal")),
            _gap(F.col("home") * 2 > n, "homepages", F.col("home")),
            _gap((commercial > 0) & (commercial * 2 >= n), "commercial", commercial),
            _gap(F.col("exact") * 3 <= n, "no_exact_title", F.col("exact")),
            _gap(F.col("price_asked").isNotNull() & (F.col("priced") == 0), "price_unanswered", F.col("priced")),
        )
    )
    healthy = F.array(F.struct(F.lit("healthy").alias("code"), F.lit(None).cast("double").alias("number"), n.alias("of")))
    return rows.withColumn("gaps", F.when(F.size(gaps) > 0, gaps).otherwise(healthy))


def format_choice(format_labels=L.FORMAT_LABELS) -> Column:
    """The repeated format with most pages; the later label in the alphabet wins a tie."""
    repeated = F.filter("labels", lambda x: x["label"].isin(*format_labels) & (x["pages"] >= L.MIN_PATTERN_PAGES))
    return F.array_max(F.transform(repeated, lambda x: F.struct(x["pages"].alias("pages"), x["label"].alias("label"))))


def recommendations(gaps: DataFrame, scores: DataFrame, frequencies: DataFrame, format_labels=L.FORMAT_LABELS) -> DataFrame:
    """Advice codes in their order.

    ``gaps`` from :func:`content_gaps` with related facts; ``scores``: snapshot_id, score,
    band, our_position; ``frequencies``: query, freq (NULL = not measured).
    """
    rows = gaps.join(scores.select("snapshot_id", "score", "band", "our_position"), "snapshot_id", "left").join(
        frequencies.select("query", "freq"), "query", "left"
    )
    choice = format_choice(format_labels)
    both = F.col("score").isNotNull() & F.col("freq").isNotNull()
    decision = (
        F.when(both & (F.col("band") == L.BAND_LOW), "take").when(both & (F.col("band") == L.BAND_HIGH), "enter_by_refinements")
        .when(both, "plan_with_refinements").when(F.col("freq").isNull(), "no_frequency")
    )
    by_gap = {
        "no_digits": "put_number_in_title", "stale": "give_fresh_data", "no_cases": "build_on_own_case", "portals": "aim_at_refinements",
        "homepages": "answer_closer_than_homepage", "commercial": "answer_not_sell", "no_exact_title": "exact_h1", "price_unanswered": "give_prices",
    }
    pairs = F.create_map(*[F.lit(x) for p in by_gap.items() for x in p])
    from_gaps = F.array_compact(F.transform("gaps", lambda g: F.try_element_at(pairs, g["code"])))
    advice = F.array_compact(
        F.concat(
            F.array(
                F.when(F.coalesce("our_position", F.lit(0)) > 0, F.lit("update_own_page")),
                F.when(choice.isNotNull(), F.lit("take_format")).otherwise(F.lit("no_settled_format")),
            ),
            from_gaps,
            F.array(
                decision,
                F.when(F.col("freq") < L.LOW_FREQ, F.lit("low_demand")),
                F.when(F.size(F.coalesce("questions", F.array().cast("array<string>"))) > 0, F.lit("headings_from_refinements")),
            ),
        )
    )
    return rows.withColumn("format", choice["label"]).withColumn("advice", advice)


def build_briefs(
    docs: DataFrame, snapshots: DataFrame, expansions: DataFrame, frequencies: DataFrame, as_of, top: int = 10, our_domain: str | None = None,
    patterns=L.TITLE_PATTERNS, commercial_labels=L.COMMERCIAL_LABELS, format_labels=L.FORMAT_LABELS, cases: str = L.CASE_WORDS, price: str = L.PRICE_INTENT,
) -> DataFrame:
    """One brief per snapshot: score, top pages, related phrases, patterns, gaps and advice."""
    related = related_facts(related_queries(expansions), price)
    facts = content_gaps(brief_facts(docs, as_of, top, patterns, cases, price), related, commercial_labels)
    scores = S.competition_score(docs, as_of, top, our_domain=our_domain)
    told = recommendations(facts, scores, frequencies, format_labels)
    pages = S.top_sites(docs.where("error IS NULL"), top).groupBy("snapshot_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "url", K.bare_domain("domain").alias("domain"), "title"))).alias("top_pages")
    )
    base = snapshots.select("snapshot_id", "query", "region", F.col("fetched_at").alias("generated_at"), "error")
    return base.join(told.drop("query", "region"), "snapshot_id", "left").join(pages, "snapshot_id", "left").withColumn("band", F.coalesce("band", F.lit(L.BAND_NONE)))
