"""Keyword pool and semantic core: judging phrases, folding word forms, verdicts.

Reasons are codes. Dictionaries are parameters (:class:`Niche` and regular expressions),
small by nature, and become literals of the plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import lists as L
from ..functions import words as WD

#: Reasons by which the niche dictionary alone decided; only these are judged again.
DICTIONARY_REASONS = (
    "outside_niche", "niche_service", "object_without_service", "foreign_name", "vendor",
    "brand_ambiguous", "brand_qualified", "setup_of_broad_seed",
)


@dataclass(frozen=True)
class Niche:
    """Stems of a project's services and objects; half a dictionary counts as none."""

    services: tuple[str, ...] = ()
    objects: tuple[str, ...] = ()
    brand_qualifiers: tuple[str, ...] = ()
    domain: str | None = None
    vendor: str | None = None
    foreign_name: str | None = None
    client_marks: str | None = None
    other_meaning: tuple[str, ...] = ()
    specialist_domains: tuple[str, ...] = ()
    specialist_domains_niche: tuple[str, ...] = ()
    defined: bool = field(init=False, default=False)

    def __post_init__(self):
        whole = bool(self.services and self.objects)
        object.__setattr__(self, "defined", whole)
        if not whole:
            object.__setattr__(self, "services", ())
            object.__setattr__(self, "objects", ())

    @property
    def qualifiers(self) -> tuple[str, ...]:
        labels = (self.domain or "").lower().removeprefix("https://").removeprefix("http://").removeprefix("www.").split("/")[0].split(".")
        own = (labels[-2],) if self.defined and len(labels) >= 2 and len(labels[-2]) >= 3 else ()
        return tuple(dict.fromkeys(self.brand_qualifiers + self.objects + own))


def _reason(accepted: bool, code: str) -> Column:
    return F.struct(F.lit(accepted).alias("accepted"), F.lit(code).alias("reason"))


def _found(phrase: Column, pattern: str | None) -> Column:
    return F.lit(False) if pattern is None else phrase.rlike(f"(?iu){pattern}")


@dataclass(frozen=True)
class Hits:
    """What a niche's dictionary finds: in the phrase, and an object in its seed (None: no objects are known)."""

    service: Column
    thing: Column
    seed_thing: Column | None
    defined: bool


def literal_hits(phrase: Column, seed: Column | None, niche: Niche) -> Hits:
    """Hits of a dictionary that is small enough to stand in the plan; see ``terms`` for tables."""
    seed_thing = WD.has_prefix(seed, niche.objects) if niche.objects and seed is not None else None
    return Hits(WD.has_prefix(phrase, niche.services), WD.has_prefix(phrase, niche.objects), seed_thing, niche.defined)


def niche_decision(phrase, niche: Niche, hits: Hits | None = None) -> Column:
    """Is it our topic, by the words of the phrase alone."""
    phrase = K._c(phrase)
    hits = hits or literal_hits(phrase, None, niche)
    refusal = _final_refusal(phrase, niche, hits)
    return (
        F.when(refusal.isNotNull(), refusal)
        .when(hits.service, _reason(True, "niche_service"))
        .when(hits.thing, _reason(False, "object_without_service"))
        .otherwise(_reason(False, "outside_niche" if hits.defined else "dictionary_undefined"))
    )


def _final_refusal(phrase: Column, niche: Niche, hits: Hits) -> Column:
    """Refusals that hold for refinements and associations alike."""
    foreign = F.lit(False) if niche.foreign_name is None else F.trim(phrase).rlike(f"(?iu)^(?:{niche.foreign_name})")
    return F.when(foreign & ~hits.service, _reason(False, "foreign_name")).when(_found(phrase, niche.vendor) & ~hits.thing, _reason(False, "vendor"))


def judge_candidate(phrase, freq, kind, seed, niche: Niche, min_freq: int = L.POOL_MIN_FREQ, tracked: Column | None = None, hits: Hits | None = None) -> Column:
    """Accept or refuse a suggested phrase; the order of the rules is the rule."""
    phrase, freq, kind, seed = map(K._c, (phrase, freq, kind, seed))
    tracked = F.lit(False) if tracked is None else tracked
    hits = hits or literal_hits(phrase, seed, niche)
    broad = F.lit(False) if hits.seed_thing is None else ~hits.seed_thing  # the seed names no object of the niche
    refusal = _final_refusal(phrase, niche, hits)
    return (
        F.when(tracked, _reason(False, "tracked"))
        .when(K.squeezed(phrase) == K.squeezed(seed), _reason(False, "is_seed"))
        .when(freq < min_freq, _reason(False, "below_min_freq"))
        .when(phrase.rlike(L.NOISE), _reason(False, "noise"))
        .when(refusal.isNotNull(), refusal)
        .when((kind == "top") & broad & ~hits.thing & phrase.rlike(L.SETUP), _reason(False, "setup_of_broad_seed"))
        .when(kind == "top", _reason(True, "refinement"))
        .otherwise(niche_decision(phrase, niche, hits))
    )


def _kind_order() -> Column:
    return F.when(F.col("kind") == "top", 0).otherwise(1)


def suggest_pool(expansions: DataFrame, niche: Niche, tracked: DataFrame | None = None, min_freq: int = L.POOL_MIN_FREQ, limit: int = L.POOL_PER_SEED) -> DataFrame:
    """Candidates per seed: the first ``limit`` accepted ones, and every refused one with its reason.

    ``expansions``: seed, kind, place, phrase, freq.
    """
    rows = expansions
    known = None
    if tracked is not None:
        rows = rows.join(tracked.select(F.col("query").alias("phrase"), F.lit(True).alias("_t")).distinct(), "phrase", "left")
        known = F.coalesce("_t", F.lit(False))
    judged = rows.withColumn("_j", judge_candidate("phrase", "freq", "kind", "seed", niche, min_freq, known)).select(
        "seed", "kind", "place", "phrase", "freq", "_j.accepted", "_j.reason"
    )
    order = W.partitionBy("seed").orderBy(_kind_order(), F.desc("freq"), "place", "phrase")
    accepted = judged.where("accepted").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return accepted.unionByName(judged.where("NOT accepted").withColumn("rank", F.lit(None).cast("int")))


def classify_phrase(phrase, brand_terms, niche: Niche) -> Column:
    """Brand by name, target by service and object together, else adjacent."""
    return (
        F.when(WD.brand_match(phrase, brand_terms), L.BRAND)
        .when(WD.has_prefix(phrase, niche.services) & WD.has_prefix(phrase, niche.objects), L.TARGET)
        .otherwise(L.ADJACENT)
    )


def brand_qualified(phrase, niche: Niche) -> Column:
    return WD.has_prefix(phrase, niche.qualifiers)


def collect_core(
    seeds: DataFrame, expansions: DataFrame, brand_terms, niche: Niche,
    known: DataFrame | None = None, min_freq: int = 0, quota: int = L.SEED_QUOTA,
) -> DataFrame:
    """Candidates of the core: the first seed that brings a phrase owns it.

    ``seeds``: seed, ord, is_brand, freq; ``expansions``: seed, kind, place, phrase, freq.
    The quota per seed marks the overflow as dropped instead of losing it. Which rows fit
    is told by one bound per seed, taken from a ranking that keeps ``quota`` rows per seed
    before it shuffles.
    """
    own = seeds.select(
        F.col("seed").alias("phrase"), "ord", "seed", "is_brand", "freq", F.lit("seed").alias("source"), F.lit(0).alias("o1"),
        F.lit(0).alias("o2"), F.lit(0).cast("bigint").alias("o3"), F.lit("top").alias("expansion"),
    )
    if known is not None:
        own = own.join(known.select("phrase", F.col("freq").alias("_k")), "phrase", "left").withColumn("freq", F.coalesce("freq", "_k")).drop("_k")
    grown = expansions.join(seeds.select("seed", "ord", "is_brand"), "seed").select(
        F.trim("phrase").alias("phrase"), "ord", "seed", "is_brand", F.col("freq").cast("bigint").alias("freq"), F.lit("expansion").alias("source"),
        (F.lit(1) + _kind_order()).alias("o1"), F.col("place").alias("o2"), (-F.coalesce("freq", F.lit(0))).cast("bigint").alias("o3"), F.col("kind").alias("expansion"),
    ).where("phrase <> ''")
    order = F.struct("ord", "o1", "o3", "o2")
    columns = ("seed", "is_brand", "freq", "source", "expansion")
    firsts = own.withColumn("freq", F.col("freq").cast("bigint")).unionByName(grown).groupBy("phrase").agg(
        F.min(F.struct(order.alias("order"), *columns)).alias("e")
    ).select("phrase", "e.*")
    named = WD.brand_match("phrase", brand_terms)
    as_brand = F.col("is_brand") | named
    judged = F.when(
        as_brand, F.when(brand_qualified("phrase", niche), _reason(True, "brand_qualified")).otherwise(_reason(False, "brand_ambiguous"))
    ).otherwise(judge_candidate("phrase", "freq", "expansion", "seed", niche, min_freq))
    is_seed = F.col("source") == "seed"
    entries = firsts.withColumn("_j", F.when(is_seed, _reason(True, "seed")).otherwise(judged)).withColumn(
        "kind",
        F.when(is_seed & F.col("is_brand"), L.BRAND).when(is_seed, classify_phrase("phrase", brand_terms, niche))
        .when(as_brand, L.BRAND).otherwise(classify_phrase("phrase", brand_terms, niche)),
    )
    ranked = entries.where(~is_seed & F.col("_j.accepted")).withColumn("_n", F.row_number().over(W.partitionBy("seed").orderBy("order", "phrase")))
    bounds = ranked.where(F.col("_n") <= quota).groupBy("seed").agg(F.max(F.struct("order", "phrase")).alias("bound"), F.max("_n").alias("taken"))
    flagged = entries.join(bounds, "seed", "left")
    over = ~is_seed & F.col("_j.accepted") & (F.col("taken") >= quota) & (F.struct("order", "phrase") > F.col("bound"))
    none = F.lit(None)
    return flagged.select(
        "phrase", "seed", "source", "kind", "freq",
        F.when(F.col("_j.accepted") & ~F.coalesce(over, F.lit(False)), L.EDGE).otherwise(L.DROP).alias("verdict"),
        F.col("_j.reason").alias("reason"),
        F.coalesce(over, F.lit(False)).alias("over_quota"),
        none.cast("boolean").alias("commercial"), none.cast("double").alias("competition"), none.cast("int").alias("our_position"),
        F.array().cast("array<string>").alias("top_domains"),
    )


def _verdict_rank(column="verdict") -> Column:
    return F.when(F.col(column) == L.CORE, 0).when(F.col(column) == L.EDGE, 1).when(F.col(column) == L.DROP, 2).otherwise(9)


def form_key(phrase="phrase") -> Column:
    key = WD.stem_key(phrase)
    return F.when(key != "", key).otherwise(F.lower(K._c(phrase)))


def dedup_forms(core: DataFrame, preferred: Column | None = None) -> DataFrame:
    """Fold word forms of one phrase into one row.

    Forms with one measured frequency collapse into a canonical phrase that takes the
    strongest verdict of the group, the twins are dropped with a pointer to it. Forms whose
    frequencies differ all stay and share ``form_key``. A group travels as one aggregate
    row that is joined back.
    """
    preferred = (F.col("source") == "seed") if preferred is None else preferred
    evidence = ("verdict", "reason", "competition", "our_position", "top_domains", "commercial")
    rows = core.withColumn("form_key", form_key())
    groups = rows.groupBy("form_key").agg(
        F.count(F.lit(1)).alias("forms"),
        F.min("freq").alias("_lo"), F.max("freq").alias("_hi"),
        WD.pick_canonical("phrase", preferred).alias("keeper"),
        F.min_by(F.struct(*evidence), F.struct(_verdict_rank(), "phrase")).alias("best"),
    )
    joined = rows.join(groups, "form_key")
    apart = F.col("_lo").isNotNull() & (F.col("_lo") != F.col("_hi"))
    several = F.col("forms") > 1
    folded = several & ~apart
    keeper = folded & (F.col("phrase") == F.col("keeper"))
    stronger = keeper & (_verdict_rank("best.verdict") < _verdict_rank())
    twin = folded & ~keeper
    state = F.when(twin, "form_of").when(keeper, "collapsed").when(several, "differing_forms").otherwise("single")
    moved = {c: F.when(stronger, F.col(f"best.{c}")).otherwise(F.col(c)) for c in evidence}
    moved["verdict"] = F.when(twin, L.DROP).otherwise(moved["verdict"])
    moved["reason"] = F.when(twin, "form_of").otherwise(moved["reason"])
    out = joined.select(*[c for c in core.columns if c not in evidence], "form_key", "forms", state.alias("form_state"),
                        F.when(folded, F.col("keeper")).alias("keeper"), *[moved[c].alias(c) for c in evidence])
    return out


def known_frequencies(snapshot: DataFrame, measured: DataFrame, core: DataFrame) -> DataFrame:
    """Frequencies already paid for: snapshot, then newest measurement, then the stored core."""
    none = F.lit(None).cast("timestamp")
    parts = snapshot.select(F.col("seed").alias("phrase"), "freq", F.lit(0).alias("p"), none.alias("at")).where("phrase <> ''")
    parts = parts.unionByName(measured.where("error IS NULL AND freq IS NOT NULL").select("phrase", "freq", F.lit(1).alias("p"), F.col("fetched_at").alias("at")))
    parts = parts.unionByName(core.where("freq IS NOT NULL").select("phrase", "freq", F.lit(2).alias("p"), none.alias("at")))
    return parts.groupBy("phrase").agg(F.max_by("freq", F.struct("p", "at", "freq")).alias("freq"))


def _kind_rank() -> Column:
    return F.when(F.col("kind") == L.BRAND, 0).when(F.col("kind") == L.TARGET, 1).when(F.col("kind") == L.ADJACENT, 2).otherwise(9)


def check_queue(core: DataFrame, limit: int = L.CHECK_LIMIT) -> DataFrame:
    """What to check in the results first."""
    freq = F.coalesce("freq", F.lit(0))
    return core.where(F.col("verdict") != L.DROP).orderBy(
        F.when(F.col("source") == "seed", 0).otherwise(1), _kind_rank(), F.when(freq > 0, 0).otherwise(1), F.desc(freq), "phrase"
    ).limit(limit)


def newest_results(docs: DataFrame) -> DataFrame:
    """Documents of each phrase's newest snapshot, whatever its region."""
    newest = docs.groupBy("phrase").agg(F.max_by("snapshot_id", F.struct("fetched_at", "snapshot_id")).alias("snapshot_id"))
    return docs.join(newest, ["phrase", "snapshot_id"], "left_semi")


def result_text() -> Column:
    """Title and passage of a result."""
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("passage", F.lit("")))


def domain_profile(docs: DataFrame, niche: Niche, top: int = 10) -> DataFrame:
    """Who stands in the top of a phrase: specialists, teachers, another meaning, clients.

    ``docs``: phrase, niche_only (brand phrases count niche objects only), plus document
    columns; of a phrase's snapshots (snapshot_id, fetched_at) the newest counts and gives at most ``top`` rows.
    """
    sites = newest_results(docs).where(~F.col("is_wizard") & (F.col("organic_position") <= top))
    domain, text = K.bare_domain("domain"), result_text()

    def marked(marks) -> Column:
        hit = F.lit(False)
        for mark in marks:
            hit = hit | F.contains(domain, F.lit(mark))
        return hit

    if niche.defined:
        wide, narrow = WD.has_prefix(text, niche.services + niche.objects), WD.has_prefix(text, niche.objects)
    else:
        wide, narrow = text.rlike(L.COMMERCIAL), F.lit(False)
    specialist = F.when(F.col("niche_only"), narrow | marked(niche.specialist_domains_niche)).otherwise(wide | marked(niche.specialist_domains))
    other = F.lit(False)
    for mark in niche.other_meaning:
        other = other | F.contains(F.lower(text), F.lit(mark.lower()))
    return profile_counts(sites, specialist, other, niche)


def profile_counts(sites: DataFrame, specialist: Column, other: Column, niche: Niche) -> DataFrame:
    """Counts per phrase of the results that are specialists, teachers, another meaning, clients."""
    domain, title = K.bare_domain("domain"), F.coalesce("title", F.lit(""))
    educational = F.lit(False)
    for name in L.EDUCATIONAL_DOMAINS:
        educational = educational | (domain == name) | F.endswith(domain, F.lit("." + name))
    educational = educational | domain.rlike(L.EDUCATIONAL_SUBDOMAIN) | title.rlike(L.EDUCATIONAL_TITLE)
    return sites.groupBy("phrase").agg(
        F.count(F.lit(1)).alias("docs"),
        F.count_if(specialist).alias("specialized"), F.count_if(educational).alias("educational"),
        F.count_if(other).alias("other_meaning"), F.count_if(_found(result_text(), niche.client_marks)).alias("clients"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", domain.alias("domain")))), lambda d: d["domain"]).alias("top_domains"),
    )


def core_verdict(core: DataFrame, profile: DataFrame, scores: DataFrame, niche: Niche) -> DataFrame:
    """Verdicts from the results. ``scores``: phrase, competition, our_position, error."""
    base = core.drop("commercial", "competition", "our_position", "top_domains").withColumnsRenamed({"verdict": "_v", "reason": "_r", "kind": "_k"})
    rows = base.join(profile, "phrase", "left").join(scores, "phrase", "left")
    has_docs = F.col("error").isNull() & (F.coalesce("docs", F.lit(0)) > 0)
    navigational = F.col("phrase").rlike(L.NAVIGATIONAL)
    client_heavy = F.col("clients") * 2 >= F.col("docs")
    commercial = (F.col("specialized") > F.col("educational")) & ~client_heavy & ~navigational
    brand, target = F.col("_k") == L.BRAND, F.col("_k") == L.TARGET
    ranks = F.coalesce("our_position", F.lit(0)) > 0

    def out(kind, verdict, reason):
        kind = F.col("_k") if kind is None else F.lit(kind)
        return F.struct(kind.alias("kind"), F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason"))

    judged = (
        F.when(brand & ranks, out(None, L.CORE, "we_rank"))
        .when(brand & brand_qualified("phrase", niche), out(None, L.CORE, "brand_qualified"))
        .when(brand, out(None, L.EDGE, "brand_ambiguous"))
        .when(target & commercial, out(None, L.CORE, "commercial_top"))
        .when(target & navigational, out(None, L.EDGE, "navigational"))
        .when(target & client_heavy, out(None, L.EDGE, "client_top"))
        .when(target, out(L.ADJACENT, L.EDGE, "educational_top"))
        .when(commercial, out(None, L.EDGE, "adjacent_commercial"))
        .otherwise(out(None, L.EDGE, "adjacent_educational"))
    )
    kept = F.struct(
        F.col("_k").alias("kind"), F.col("_v").alias("verdict"),
        F.when(F.col("error").isNotNull(), "results_failed").when(F.col("docs").isNull(), "no_usable_documents").otherwise(F.col("_r")).alias("reason"),
    )
    verdict = F.when(has_docs, judged).otherwise(kept)
    measured = ("competition", "our_position")
    rest = [c for c in base.columns if c not in ("_v", "_r", "_k")]
    return rows.withColumn("_o", verdict).select(
        *rest, "_o.kind", "_o.verdict", "_o.reason",
        F.when(has_docs, commercial).alias("commercial"),
        *[F.when(has_docs, F.col(c)).alias(c) for c in measured],
        F.when(has_docs, F.col("top_domains")).alias("top_domains"),
        "docs", "specialized", "educational", "other_meaning", "clients",
    )


def summarize_core(core: DataFrame) -> DataFrame:
    """Kinds by verdict, with totals."""
    counts = {"total": F.lit(True), "core": F.col("verdict") == L.CORE, "edge": F.col("verdict") == L.EDGE, "dropped": F.col("verdict") == L.DROP}
    by_kind = core.groupBy("kind").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    total = by_kind.groupBy().agg(*[F.sum(n).alias(n) for n in counts]).select(F.lit("all").alias("kind"), *counts)
    return by_kind.unionByName(total)


def rejudge_core(core: DataFrame, brand_terms, niche: Niche) -> DataFrame:
    """Types and dictionary-made verdicts under a new dictionary, row by row.

    A verdict that rests on collected results is a measurement and stays; if its type
    changes, the row is flagged for review. A brand type given by origin gives way only to
    a full hit in the project's own dictionary.
    """
    phrase = F.col("phrase")
    by_words = classify_phrase("phrase", brand_terms, niche)
    by_origin = (F.col("kind") == L.BRAND) & ~WD.brand_match("phrase", brand_terms)
    overrides = F.lit(niche.defined) & (by_words == L.TARGET)
    new_kind = F.when(by_origin & ~overrides, L.BRAND).otherwise(by_words)
    seen = (F.size(F.coalesce("top_domains", F.array().cast("array<string>"))) > 0) | F.col("our_position").isNotNull() | F.col("competition").isNotNull()
    over_quota = F.col("over_quota") if "over_quota" in core.columns else F.lit(False)
    by_dictionary = F.col("reason").isin(*DICTIONARY_REASONS) & ~F.coalesce(over_quota, F.lit(False))
    rows = core.withColumns({"new_kind": new_kind, "_seen": seen}).withColumn("_d", niche_decision("phrase", niche))
    setup_stands = (F.col("reason") == "setup_of_broad_seed") & ~WD.has_prefix(phrase, niche.objects)

    def out(verdict, reason):
        return F.struct(verdict.alias("verdict"), reason.alias("reason"))

    keep = out(F.col("verdict"), F.col("reason"))
    judged = (
        F.when(F.col("_seen") | ~F.coalesce(by_dictionary, F.lit(False)), keep)
        .when((F.col("new_kind") == L.BRAND) & brand_qualified("phrase", niche), out(F.lit(L.EDGE), F.lit("brand_qualified")))
        .when(F.col("new_kind") == L.BRAND, out(F.lit(L.DROP), F.lit("brand_ambiguous")))
        .when(setup_stands, keep)
        .otherwise(out(F.when(F.col("_d.accepted"), L.EDGE).otherwise(L.DROP), F.col("_d.reason")))
    )
    rows = rows.withColumn("_j", judged)
    kind_changed = ~F.col("kind").eqNullSafe(F.col("new_kind"))
    return rows.select(
        *core.columns, "new_kind", F.col("_j.verdict").alias("new_verdict"), F.col("_j.reason").alias("new_reason"),
        kind_changed.alias("kind_changed"),
        (~F.col("verdict").eqNullSafe(F.col("_j.verdict"))).alias("verdict_changed"),
        (kind_changed & (F.col("kind") == L.BRAND)).alias("brand_lost"),
        (kind_changed & F.col("_seen")).alias("needs_review"),
    )


def rejudge_report(rejudged: DataFrame) -> DataFrame:
    """Rows per type and verdict before and after, with the change counts."""
    return rejudged.groupBy("kind", "verdict", "new_kind", "new_verdict").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("kind_changed").alias("kind_changed"), F.count_if("verdict_changed").alias("verdict_changed"),
        F.count_if("brand_lost").alias("brand_lost"), F.count_if("needs_review").alias("needs_review"),
    )


def apply_rejudge(rejudged: DataFrame) -> DataFrame:
    """The core with the new types and verdicts in place."""
    changed = {"kind": "new_kind", "verdict": "new_verdict", "reason": "new_reason"}
    extra = ("new_kind", "new_verdict", "new_reason", "kind_changed", "verdict_changed", "brand_lost", "needs_review")
    return rejudged.select(*[F.col(changed.get(c, c)).alias(c) for c in rejudged.columns if c not in extra])


def relabel_core(core: DataFrame, brand_terms, niche: Niche) -> DataFrame:
    """Rows whose type moves between target and adjacent under the current rules."""
    now = classify_phrase("phrase", brand_terms, niche)
    return core.where(F.col("kind") != L.BRAND).withColumn("new_kind", now).where((F.col("new_kind") != L.BRAND) & (F.col("kind") != F.col("new_kind")))


def coverage_guard(core: DataFrame) -> DataFrame:
    """May the core be saved: not if fewer than half of its rows have a frequency."""
    counts = core.groupBy().agg(F.count(F.lit(1)).alias("rows"), F.count("freq").alias("measured"))
    return counts.withColumn("save_allowed", (F.col("rows") == 0) | (F.col("measured") / F.nullif(F.col("rows"), F.lit(0)) >= 0.5))


def is_junk(query, niche: Niche) -> Column:
    query = K._c(query)
    return query.rlike(L.NOISE) | _found(query, niche.vendor)


def sync_pool(
    latest: DataFrame, tracked: DataFrame, core: DataFrame, article_targets: DataFrame, niche: Niche,
    min_shows: int = L.SYNC_MIN_SHOWS, limit: int = L.SYNC_LIMIT,
) -> DataFrame:
    """Keep, add or retire tracked phrases by what the engine really shows.

    ``latest``: host_id, query, shows, clicks of the latest window; ``tracked``: host_id,
    query; ``core`` (host_id, phrase, verdict) and ``article_targets`` (host_id, query, url)
    protect a phrase from retirement. ``limit`` bounds additions: a shown phrase of a lower
    rank that is not tracked yet is skipped as over the limit, with its real shows; one that
    is tracked stays.
    """
    fit = latest.where((F.coalesce("shows", F.lit(0)) >= min_shows) & ~is_junk("query", niche))
    best = F.struct(-F.coalesce("shows", F.lit(0)), "query")
    wanted = fit.groupBy("host_id", K.squeezed("query").alias("key")).agg(F.min_by(F.struct("query", "shows", "clicks"), best).alias("w"))
    have = tracked.groupBy("host_id", K.squeezed("query").alias("key")).agg(F.max("query").alias("original"))
    targets = article_targets.groupBy("host_id", K.squeezed("query").alias("key")).agg(F.min("url").alias("page"))
    goals = core.where(F.col("verdict") == L.CORE).select("host_id", K.squeezed("phrase").alias("key"), F.lit(True).alias("goal")).distinct()
    # only the host's first ``limit`` phrases are ranked, before they meet the rest
    order = W.partitionBy("host_id").orderBy(F.desc("w.shows"), "w.query")
    within = wanted.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).select("host_id", "key", F.lit(True).alias("within"))
    rows = (
        wanted.join(within, ["host_id", "key"], "left").join(have, ["host_id", "key"], "full_outer")
        .join(targets, ["host_id", "key"], "left").join(goals, ["host_id", "key"], "left")
    )
    shown, known, over = F.col("w").isNotNull(), F.col("original").isNotNull(), F.col("within").isNull()
    protected = F.col("page").isNotNull() | F.col("goal")
    action = F.when(shown & known, "keep").when(shown & over, "skip").when(shown, "add").when(protected, "keep").otherwise("retire")
    reason = (
        F.when(shown & known, "shown_and_tracked").when(shown & over, "over_limit").when(shown, "shown_not_tracked")
        .when(F.col("page").isNotNull(), "article_target").when(F.col("goal"), "core_goal").otherwise("no_shows")
    )
    return rows.select(
        "host_id", F.coalesce("w.query", "original").alias("query"),
        F.coalesce("w.shows", F.lit(0)).alias("shows"), F.coalesce("w.clicks", F.lit(0)).alias("clicks"),
        action.alias("action"), reason.alias("reason"), F.when(action == "keep", F.when(~shown, F.col("page"))).alias("page"),
    )


def sync_dropped(latest: DataFrame, niche: Niche, min_shows: int = L.SYNC_MIN_SHOWS, limit: int = L.SYNC_LIMIT) -> DataFrame:
    """How many queries of a host each bucket left out."""
    enough = F.coalesce("shows", F.lit(0)) >= min_shows
    junk = is_junk("query", niche)
    counts = latest.groupBy("host_id").agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(~enough).alias("below_shows"), F.count_if(enough & junk).alias("junk"),
        F.count_if(enough & ~junk).alias("fit"),
    )
    return counts.select("host_id", "queries", "below_shows", "junk", F.greatest(F.col("fit") - limit, F.lit(0)).alias("over_limit"))
