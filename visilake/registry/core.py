"""Keyword pool and core over the part and order tables, with an English dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import lists as L
from ..functions import words as WD
from ..operators import core as C
from ..operators import serp as S
from ..operators import terms as T

#: part names are "<adjective> <thing>": things are services, adjectives are objects
NICHE = C.Niche(services=("gear", "ring", "widget"), objects=("red", "blue", "large"), domain="steel.example", vendor="plate", foreign_name="old\\s")
BRANDS = ("hot bolt", "cold")


def _expansions(spark, sf):
    """Orders' first words as seeds, part phrases as their expansions."""
    p = B.table(spark, sf, "part")
    key = F.col("p_partkey")
    return p.select(
        F.lower("p_brand").alias("seed"),
        F.when(key % 3 > 0, "top").otherwise("association").alias("kind"),
        key.alias("place"),
        F.when(key % 50 == 0, F.lower("p_brand")).otherwise(F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit(" "), (key % 97).cast("string"))).alias("phrase"),
        (F.col("p_size") * 4).cast("bigint").alias("freq"),
    )


EXPANSIONS = """
expansions AS (
  SELECT lower(p_brand) AS seed, CASE WHEN p_partkey % 3 > 0 THEN 'top' ELSE 'association' END AS kind, p_partkey AS place,
         CASE WHEN p_partkey % 50 = 0 THEN lower(p_brand) ELSE p_name || ' ' || lower(p_type) || ' ' || (p_partkey % 97) END AS phrase,
         CAST(p_size * 4 AS BIGINT) AS freq
  FROM part
)"""
_PRE = "regexp_matches(lower(phrase), '\\b({})')"
_SERVICE = _PRE.format("gear|ring|widget")
_OBJECT = _PRE.format("red|blue|large")
_QUALIFIED = _PRE.format("red|blue|large|steel")
_BRAND = "regexp_matches(regexp_replace(lower(phrase), '[^0-9a-z]+', '', 'g'), 'hotbolt|cold')"
_NICHE = f"""CASE WHEN regexp_matches(trim(phrase), '^old\\s') AND NOT service THEN 'foreign_name'
  WHEN regexp_matches(phrase, 'plate') AND NOT thing THEN 'vendor' WHEN service THEN 'niche_service' WHEN thing THEN 'object_without_service' ELSE 'outside_niche' END"""
_KIND = f"CASE WHEN {_BRAND} THEN 'brand' WHEN service AND thing THEN 'target' ELSE 'adjacent' END"


def _judged(min_freq):
    return f"""CASE WHEN phrase = seed THEN 'is_seed' WHEN freq < {min_freq} THEN 'below_min_freq'
  WHEN regexp_matches(trim(phrase), '^old\\s') AND NOT service THEN 'foreign_name' WHEN regexp_matches(phrase, 'plate') AND NOT thing THEN 'vendor'
  WHEN kind = 'top' THEN 'refinement' ELSE {_NICHE} END"""


JUDGED = EXPANSIONS + f""",
hit AS (SELECT *, {_SERVICE} AS service, {_OBJECT} AS thing FROM expansions),
judged AS (SELECT *, {_judged(30)} AS reason FROM hit),
verdicts AS (SELECT *, reason IN ('refinement', 'niche_service') AS accepted FROM judged)"""


def judge_candidates(spark, sf):
    rows = _expansions(spark, sf)
    return rows.withColumn("j", C.judge_candidate("phrase", "freq", "kind", "seed", NICHE)).select("seed", "kind", "place", "phrase", "freq", "j.accepted", "j.reason")


def suggest_pool(spark, sf):
    return C.suggest_pool(_expansions(spark, sf), NICHE, limit=20)


def classify_phrase(spark, sf):
    return _expansions(spark, sf).select("place", "phrase", C.classify_phrase("phrase", BRANDS, NICHE).alias("kind"))


def _dictionary(spark, sf):
    """Terms as a table: per brand and type a brand's spelling, the last thing and the first adjective."""
    p = B.table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.min("p_name").alias("first"), F.max("p_name").alias("last"), F.max("p_partkey").alias("key"))
    brand = F.concat(F.substring("last", -1, 1), F.lit("-"), "p_type", F.lit(" "), (F.col("key") % 97).cast("string"))
    return p.select(F.inline(F.array(
        F.struct(F.lit(L.BRAND).alias("mark"), brand.alias("term")),
        F.struct(F.lit(T.SERVICE).alias("mark"), F.substring(F.substring_index("last", " ", -1), 1, 4).alias("term")),
        F.struct(F.lit(T.OBJECT).alias("mark"), F.substring("first", 1, 3).alias("term")),
        F.struct(F.lit("rival").alias("mark"), F.lower("p_type").alias("term")),
    )))


DICTIONARY = EXPANSIONS + """,
drawn AS (SELECT p_type, min(p_name) AS first, max(p_name) AS last, max(p_partkey) AS key FROM part GROUP BY p_brand, p_type),
terms AS (
  SELECT 'brand' AS mark, lower(last[-1:] || p_type || (key % 97)) AS term FROM drawn UNION SELECT 'service', string_split(last, ' ')[-1][1:4] FROM drawn
  UNION SELECT 'object', first[1:3] FROM drawn UNION SELECT 'rival', lower(p_type) FROM drawn
),
phrases AS (SELECT DISTINCT phrase, seed FROM expansions),
said AS (SELECT DISTINCT phrase AS text FROM phrases UNION SELECT DISTINCT seed FROM phrases),
spoken AS (SELECT text, unnest(regexp_extract_all(lower(text), '[0-9a-z_]+')) AS word FROM said),
hits AS (
  SELECT text, mark, term FROM spoken JOIN terms ON mark <> 'brand' AND starts_with(word, term)
  UNION SELECT text, mark, term FROM said JOIN terms ON mark = 'brand' AND contains(regexp_replace(lower(text), '[^0-9a-z]+', '', 'g'), term)
),
marks AS (SELECT text, bool_or(mark = 'brand') AS named, bool_or(mark = 'service') AS service, bool_or(mark = 'object') AS thing FROM hits GROUP BY text),
known AS (
  SELECT e.*, coalesce(m.named, false) AS named, coalesce(m.service, false) AS service, coalesce(m.thing, false) AS thing
  FROM expansions e LEFT JOIN marks m ON m.text = e.phrase
)"""


def classify_by_terms(spark, sf):
    return T.classify_phrases(_expansions(spark, sf).select("place", "phrase"), _dictionary(spark, sf))


def judge_by_terms(spark, sf):
    rows = T.judge_candidates(_expansions(spark, sf), _dictionary(spark, sf), C.Niche(vendor="plate", foreign_name="old\\s"))
    return rows.select("seed", "kind", "place", "phrase", "freq", "accepted", "reason")


def term_hits(spark, sf):
    """How many phrases each term of the dictionary stands in."""
    said = _expansions(spark, sf).select("phrase").distinct()
    terms = _dictionary(spark, sf)
    brands = T.brand_terms(terms.where(F.col("mark") == L.BRAND))
    hits = T.word_prefixes(said, terms.where(F.col("mark") != L.BRAND)).unionByName(T.contained(said, brands, within=WD.alnum_key("phrase")))
    return hits.groupBy("mark", "term").agg(F.count(F.lit(1)).alias("phrases"))


def _seeds(spark, sf):
    """Brand codes in order; the first two are brand seeds."""
    p = B.table(spark, sf, "part").groupBy(F.lower("p_brand").alias("seed")).agg(F.min("p_partkey").alias("ord"), F.count(F.lit(1)).alias("freq"))
    return p.select("seed", "ord", F.col("seed").isin("brand#2", "brand#17").alias("is_brand"), "freq")


def _collected(spark, sf):
    return C.collect_core(_seeds(spark, sf), _expansions(spark, sf), BRANDS, NICHE, quota=15)


COLLECTED = EXPANSIONS + f""",
seeds AS (SELECT lower(p_brand) AS seed, min(p_partkey) AS ord, lower(p_brand) IN ('brand#2', 'brand#17') AS is_brand, count(*) AS freq FROM part GROUP BY lower(p_brand)),
candidates AS (
  SELECT seed AS phrase, seed, ord, is_brand, freq, 'seed' AS source, 0 AS o1, 0 AS o2, 0 AS o3, 'top' AS expansion FROM seeds
  UNION ALL
  SELECT e.phrase, e.seed, s.ord, s.is_brand, e.freq, 'expansion', CASE WHEN e.kind = 'top' THEN 1 ELSE 2 END, -e.freq, e.place, e.kind
  FROM expansions e JOIN seeds s USING (seed)
),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY ord, o1, o2, o3, seed) AS rn FROM candidates) WHERE rn = 1
),
marked AS (SELECT *, expansion AS kind, {_SERVICE} AS service, {_OBJECT} AS thing, {_QUALIFIED} AS qualified, {_BRAND} AS named FROM firsts),
reasoned AS (
  SELECT *, CASE WHEN source = 'seed' THEN 'seed' WHEN is_brand OR named THEN CASE WHEN qualified THEN 'brand_qualified' ELSE 'brand_ambiguous' END
     ELSE {_judged(0)} END AS reason,
     CASE WHEN source = 'seed' AND is_brand THEN 'brand' WHEN source <> 'seed' AND (is_brand OR named) THEN 'brand' ELSE {_KIND} END AS type
  FROM marked
),
ranked AS (
  SELECT *, reason IN ('seed', 'brand_qualified', 'refinement', 'niche_service') AS accepted,
         row_number() OVER (PARTITION BY seed, source <> 'seed' AND reason IN ('brand_qualified', 'refinement', 'niche_service') ORDER BY ord, o1, o2, o3, phrase) AS n
  FROM reasoned
),
collected AS (
  SELECT phrase, seed, source, type AS kind, CAST(freq AS BIGINT) AS freq, accepted AND source <> 'seed' AND n > 15 AS over_quota,
         CASE WHEN accepted AND NOT (source <> 'seed' AND n > 15) THEN 'периферия' ELSE 'отбросить' END AS verdict, reason
  FROM ranked
)"""
_SHOW = ("phrase", "seed", "source", "kind", "freq", "verdict", "reason", "over_quota")


def collect_core(spark, sf):
    return _collected(spark, sf).select(*_SHOW)


def _forms(spark, sf):
    """Phrases in several word orders; some with one demand, some with two."""
    p = B.table(spark, sf, "part")
    key = F.col("p_partkey")
    straight = F.concat("p_name", F.lit(" "), F.lower("p_type"))
    turned = F.concat(F.lower("p_type"), F.lit(" "), "p_name")
    rows = p.groupBy(F.when(key % 2 == 0, straight).otherwise(turned).alias("phrase"), "p_brand").agg(
        F.min("p_size").alias("m"), F.min("p_partkey").alias("k"), F.min("p_retailprice").alias("price")
    )
    return rows.groupBy("phrase").agg(F.min("k").alias("k"), F.min("m").alias("m"), F.min("price").alias("price")).select(
        F.concat("phrase", F.lit(" "), (F.length("phrase") % 3).cast("string")).alias("phrase"),
        F.when(F.col("m") > 1, F.length("phrase") * 10).cast("bigint").alias("freq"),
        F.when(F.col("k") % 5 == 0, "seed").otherwise("expansion").alias("source"),
        F.when(F.col("k") % 3 == 0, L.CORE).when(F.col("k") % 3 == 1, L.EDGE).otherwise(L.DROP).alias("verdict"),
        F.concat(F.lit("r"), F.col("k").cast("string")).alias("reason"),
        F.col("price").alias("competition"), F.col("k").cast("int").alias("our_position"),
        F.array("phrase").alias("top_domains"), (F.col("k") % 2 == 0).alias("commercial"),
    )


FORMS = """
raw_forms AS (
  SELECT phrase, min(k) AS k, min(m) AS m, min(price) AS price FROM (
    SELECT CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ' || lower(p_type) ELSE lower(p_type) || ' ' || p_name END AS phrase, p_brand,
           min(p_size) AS m, min(p_partkey) AS k, min(p_retailprice) AS price FROM part GROUP BY ALL) GROUP BY phrase
),
forms AS (
  SELECT phrase || ' ' || (length(phrase) % 3) AS phrase, CASE WHEN m > 1 THEN length(phrase) * 10 END AS freq,
         CASE WHEN k % 5 = 0 THEN 'seed' ELSE 'expansion' END AS source,
         CASE WHEN k % 3 = 0 THEN 'ядро' WHEN k % 3 = 1 THEN 'периферия' ELSE 'отбросить' END AS verdict,
         'r' || k AS reason, price AS competition, CAST(k AS INTEGER) AS our_position
  FROM raw_forms
),
keyed AS (SELECT *, list_aggregate(list_sort(regexp_extract_all(lower(phrase), '[0-9a-z]+(-[0-9a-z]+)*')), 'string_agg', ' ') AS form_key,
                 CASE verdict WHEN 'ядро' THEN 0 WHEN 'периферия' THEN 1 ELSE 2 END AS vr FROM forms),
form_groups AS (
  SELECT form_key, count(*) AS forms, min(freq) AS lo, max(freq) AS hi,
         first(phrase ORDER BY source <> 'seed', length(phrase), phrase) AS keeper,
         first(verdict ORDER BY vr, phrase) AS bv, first(reason ORDER BY vr, phrase) AS br, first(competition ORDER BY vr, phrase) AS bc, min(vr) AS bvr
  FROM keyed GROUP BY form_key
)"""


def stem_dedup(spark, sf):
    return C.dedup_forms(_forms(spark, sf)).select("phrase", "freq", "source", "form_key", "forms", "form_state", "keeper", "verdict", "reason", "competition")


def known_frequencies(spark, sf):
    """Small parts are seeds, the large ones core phrases; snapshots are dealt over all parts."""
    parts = B.table(spark, sf, "part").select("p_partkey", "p_size", F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 200).cast("string")).alias("phrase"))
    snap = parts.where("p_size <= 25").groupBy(F.col("phrase").alias("seed")).agg(F.count(F.lit(1)).alias("freq"))
    dealt = max(1, parts.count())
    measured = B.snapshots(spark, sf).join(parts, F.pmod("snapshot_id", F.lit(dealt)) == F.pmod("p_partkey", F.lit(dealt))).select(
        "phrase", F.col("snapshot_id").alias("freq"), "fetched_at", "error"
    )
    core = parts.where("p_size > 25").groupBy("phrase").agg(F.max(F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey"))).alias("freq"))
    return C.known_frequencies(snap, measured, core)


def check_queue(spark, sf):
    return C.check_queue(_collected(spark, sf), 60).select(*_SHOW)


def summarize_core(spark, sf):
    return C.summarize_core(_collected(spark, sf))


def coverage_guard(spark, sf):
    return C.coverage_guard(_collected(spark, sf))


NEW_NICHE = C.Niche(services=("anvil", "bolt"), objects=("small", "red"), domain="steel.example")


def rejudge_core(spark, sf):
    rows = C.rejudge_core(_collected(spark, sf), BRANDS, NEW_NICHE)
    return rows.select(*_SHOW, "new_kind", "new_verdict", "new_reason", "kind_changed", "verdict_changed", "brand_lost", "needs_review")


def rejudge_report(spark, sf):
    return C.rejudge_report(C.rejudge_core(_collected(spark, sf), BRANDS, NEW_NICHE))


def apply_rejudge(spark, sf):
    return C.apply_rejudge(C.rejudge_core(_collected(spark, sf), BRANDS, NEW_NICHE)).select(*_SHOW)


def relabel_core(spark, sf):
    return C.relabel_core(_collected(spark, sf), BRANDS, NEW_NICHE).select("phrase", "kind", "new_kind", "freq")


_NEW = {
    "service": _PRE.format("anvil|bolt"), "thing": _PRE.format("small|red"),
    "qualified": _PRE.format("small|red|steel"),
}
REJUDGED = COLLECTED + f""",
renamed AS (SELECT *, {_NEW['service']} AS service, {_NEW['thing']} AS thing, {_NEW['qualified']} AS qualified, {_BRAND} AS named FROM collected),
retyped AS (SELECT *, CASE WHEN kind = 'brand' AND NOT named AND NOT (service AND thing) THEN 'brand' WHEN named THEN 'brand' WHEN service AND thing THEN 'target' ELSE 'adjacent' END AS new_kind,
   reason IN ('outside_niche', 'niche_service', 'object_without_service', 'foreign_name', 'vendor', 'brand_ambiguous', 'brand_qualified') AND NOT over_quota AS ruled FROM renamed),
rejudged AS (
  SELECT *, CASE WHEN NOT ruled THEN verdict WHEN new_kind = 'brand' THEN CASE WHEN qualified THEN 'периферия' ELSE 'отбросить' END WHEN service THEN 'периферия' ELSE 'отбросить' END AS new_verdict,
         CASE WHEN NOT ruled THEN reason WHEN new_kind = 'brand' THEN CASE WHEN qualified THEN 'brand_qualified' ELSE 'brand_ambiguous' END
              WHEN service THEN 'niche_service' WHEN thing THEN 'object_without_service' ELSE 'outside_niche' END AS new_reason
  FROM retyped
)"""


def _profiled(spark, sf, newest_only=True):
    rows = B.docs(spark, sf, "nation").where("error IS NULL")
    if newest_only:
        newest = rows.groupBy("query").agg(F.max_by("snapshot_id", F.struct("fetched_at", "snapshot_id")).alias("snapshot_id"))
        rows = rows.join(newest, ["query", "snapshot_id"], "left_semi")
    return rows.select(F.col("query").alias("phrase"), (F.col("region") == 0).alias("niche_only"), "snapshot_id", "fetched_at", "position", "organic_position", "is_wizard", "domain", "title", F.lit(None).cast("string").alias("passage"))


PROFILE_NICHE = C.Niche(services=("gear", "ring"), objects=("red", "blue"), client_marks="PROMO", other_meaning=("anvil",), specialist_domains=("nation-3",))
NEWEST = B.docs_cte("nation") + """,
newest AS (SELECT query, last(snapshot_id ORDER BY fetched_at, snapshot_id) AS snapshot_id FROM docs WHERE error IS NULL GROUP BY query),
tops AS (SELECT d.* FROM docs d JOIN newest n ON n.query = d.query AND n.snapshot_id = d.snapshot_id WHERE NOT is_wizard AND organic_position <= 10),
profile AS (
  SELECT query AS phrase, count(*) AS docs,
    count(*) FILTER (CASE WHEN region = 0 THEN regexp_matches(title, '\\b(red|blue)') ELSE regexp_matches(title, '\\b(gear|ring|red|blue)') OR contains(domain, 'nation-3') END) AS specialized,
    0 AS educational, count(*) FILTER (contains(lower(title), 'anvil')) AS other_meaning, count(*) FILTER (regexp_matches(lower(title), 'promo')) AS clients,
    string_agg(domain, ',' ORDER BY position) AS top_domains
  FROM tops GROUP BY query
)"""


def domain_profile(spark, sf):
    return C.domain_profile(_profiled(spark, sf, newest_only=False), PROFILE_NICHE).withColumn("top_domains", F.array_join("top_domains", ","))


def core_verdict(spark, sf):
    docs = _profiled(spark, sf)
    profile = C.domain_profile(docs, PROFILE_NICHE)
    snaps = B.snapshots(spark, sf).groupBy(F.col("query").alias("phrase"), "region").agg(F.count(F.lit(1)).cast("bigint").alias("freq"))
    kind = F.when(F.col("region") == 0, L.BRAND).when(F.col("region") < 3, L.TARGET).otherwise(L.ADJACENT)
    core = snaps.select("phrase", kind.alias("kind"), "freq", F.lit(L.EDGE).alias("verdict"), F.lit("seed").alias("reason"), *[F.lit(None).cast(t).alias(c) for c, t in (("commercial", "boolean"), ("competition", "double"), ("our_position", "int"), ("top_domains", "array<string>"))])
    ours = docs.where(~F.col("is_wizard") & (F.col("domain") == "nation-7.example")).groupBy("phrase").agg(F.min("organic_position").alias("our_position"))
    scores = docs.select("phrase").distinct().join(ours, "phrase", "left").select("phrase", F.lit(None).cast("double").alias("competition"), "our_position", F.lit(None).cast("string").alias("error"))
    return C.core_verdict(core, profile, scores, PROFILE_NICHE).select("phrase", "freq", "kind", "verdict", "reason", "commercial", "our_position")


SYNC_NICHE = C.Niche(vendor="query 1\\d$")


def _tracked(spark, sf):
    e = B.owner_events(spark, sf).groupBy("host_id", "k").agg(F.count(F.lit(1)).alias("n"))
    return e.where((F.col("k") + F.col("n")) % 3 == 0).select("host_id", F.concat(F.lit(" Query "), F.col("k").cast("string")).alias("query"))


def sync_pool(spark, sf):
    from ..sinks import warehouse as WH

    latest = WH.latest_window(B.search_queries(spark, sf), ["host_id"])
    tracked = _tracked(spark, sf)
    core = tracked.select("host_id", F.col("query").alias("phrase"), F.when(F.length("query") == 8, L.CORE).otherwise(L.EDGE).alias("verdict"))
    # articles of the last queries target them, the others' topics nobody tracks
    pages = B.owner_events(spark, sf).select("host_id", F.concat(F.when(F.col("k") >= 80, F.lit("query ")).otherwise(F.lit("topic ")), F.col("k").cast("string")).alias("query"), F.concat(F.lit("/page-"), F.col("k").cast("string")).alias("url")).distinct()
    return C.sync_pool(latest, tracked, core, pages, SYNC_NICHE, min_shows=1, limit=25)


def sync_dropped(spark, sf):
    from ..sinks import warehouse as WH

    return C.sync_dropped(WH.latest_window(B.search_queries(spark, sf), ["host_id"]), SYNC_NICHE, min_shows=1, limit=25)


SYNC = B.SEARCH_QUERIES + """,
best AS (
  SELECT host_id, date_from, date_to FROM (
    SELECT host_id, date_from, date_to, row_number() OVER (PARTITION BY host_id ORDER BY date_to DESC, max(fetched_at) DESC, date_from) AS rn
    FROM search_queries GROUP BY host_id, date_from, date_to) WHERE rn = 1
),
latest AS (SELECT s.* FROM search_queries s JOIN best USING (host_id, date_from, date_to)),
taken AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY shows DESC, query) AS n FROM latest WHERE shows >= 1 AND NOT regexp_matches(query, 'query 1\\d$'))),
tracked AS (SELECT host_id, ' Query ' || k AS query, 'query ' || k AS key FROM (SELECT host_id, k, count(*) AS n FROM owner_events GROUP BY ALL) WHERE (k + n) % 3 = 0),
pages AS (SELECT DISTINCT host_id, CASE WHEN k >= 80 THEN 'query ' ELSE 'topic ' END || k AS key, '/page-' || k AS page FROM owner_events),
synced AS (
  SELECT coalesce(w.host_id, t.host_id) AS host_id, coalesce(w.query, t.query) AS query, coalesce(w.shows, 0) AS shows, coalesce(w.clicks, 0) AS clicks,
    w.query IS NOT NULL AS shown, t.query IS NOT NULL AS known, coalesce(w.n > 25, false) AS beyond, coalesce(w.query, t.key) AS key
  FROM taken w FULL JOIN tracked t ON t.host_id = w.host_id AND t.key = w.query
)"""

_T = ", ".join(_SHOW)
QUERIES = {
    "judge_candidate": (judge_candidates, f"WITH {JUDGED} SELECT seed, kind, place, phrase, freq, accepted, reason FROM verdicts"),
    "suggest_pool": (suggest_pool, f"WITH {JUDGED}, r AS (SELECT *, row_number() OVER (PARTITION BY seed, accepted ORDER BY kind <> 'top', freq DESC, place, phrase) AS n FROM verdicts) SELECT seed, kind, place, phrase, freq, accepted, reason, CASE WHEN accepted THEN CAST(n AS INTEGER) END AS rank FROM r WHERE NOT accepted OR n <= 20"),
    "classify_phrase": (classify_phrase, f"WITH {JUDGED} SELECT place, phrase, {_KIND} AS kind FROM verdicts"),
    "classify_by_terms": (classify_by_terms, f"WITH {DICTIONARY} SELECT place, phrase, CASE WHEN named THEN 'brand' WHEN service AND thing THEN 'target' ELSE 'adjacent' END AS kind FROM known"),
    "judge_by_terms": (judge_by_terms, f"WITH {DICTIONARY}, judged AS (SELECT *, {_judged(30)} AS reason FROM known) SELECT seed, kind, place, phrase, freq, reason IN ('refinement', 'niche_service') AS accepted, reason FROM judged"),
    "term_hits": (term_hits, f"WITH {DICTIONARY} SELECT mark, term, count(*) AS phrases FROM hits WHERE text IN (SELECT phrase FROM expansions) GROUP BY mark, term"),
    "collect_core": (collect_core, f"WITH {COLLECTED} SELECT {_T} FROM collected"),
    "stem_dedup": (stem_dedup, f"WITH {FORMS} SELECT phrase, freq, source, k.form_key, forms, CASE WHEN forms = 1 THEN 'single' WHEN lo <> hi THEN 'differing_forms' WHEN phrase = keeper THEN 'collapsed' ELSE 'form_of' END AS form_state, CASE WHEN forms > 1 AND lo IS NOT DISTINCT FROM hi THEN keeper END AS keeper, CASE WHEN forms = 1 OR lo <> hi THEN verdict WHEN phrase <> keeper THEN 'отбросить' WHEN bvr < vr THEN bv ELSE verdict END AS verdict, CASE WHEN forms = 1 OR lo <> hi THEN reason WHEN phrase <> keeper THEN 'form_of' WHEN bvr < vr THEN br ELSE reason END AS reason, CASE WHEN forms > 1 AND lo IS NOT DISTINCT FROM hi AND phrase = keeper AND bvr < vr THEN bc ELSE competition END AS competition FROM keyed k JOIN form_groups g ON g.form_key = k.form_key"),
    "known_frequencies": (known_frequencies, f"WITH {B.SNAPSHOTS}, named AS (SELECT p_partkey, p_size, p_name || ' ' || (p_partkey % 200) AS phrase, count(*) OVER () AS n FROM part), parts AS (SELECT phrase, count(*) AS freq, 0 AS p, NULL::TIMESTAMP AS seen FROM named WHERE p_size <= 25 GROUP BY phrase UNION ALL SELECT phrase, snapshot_id, 1, fetched_at FROM snapshots JOIN named ON snapshot_id % n = p_partkey % n WHERE error IS NULL UNION ALL SELECT phrase, max(p_partkey) FILTER (p_partkey % 2 = 0), 2, NULL FROM named WHERE p_size > 25 GROUP BY phrase HAVING max(p_partkey) FILTER (p_partkey % 2 = 0) IS NOT NULL) SELECT phrase, first(freq ORDER BY p DESC, seen DESC NULLS LAST, freq DESC) AS freq FROM parts GROUP BY phrase"),
    "check_queue": (check_queue, f"WITH {COLLECTED} SELECT {_T} FROM collected WHERE verdict <> 'отбросить' ORDER BY source <> 'seed', CASE kind WHEN 'brand' THEN 0 WHEN 'target' THEN 1 ELSE 2 END, coalesce(freq, 0) <= 0, coalesce(freq, 0) DESC, phrase LIMIT 60"),
    "summarize_core": (summarize_core, f"WITH {COLLECTED} SELECT CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS kind, count(*) AS total, count(*) FILTER (verdict = 'ядро') AS core, count(*) FILTER (verdict = 'периферия') AS edge, count(*) FILTER (verdict = 'отбросить') AS dropped FROM collected GROUP BY ROLLUP (kind)"),
    "coverage_guard": (coverage_guard, f"WITH {COLLECTED} SELECT count(*) AS rows, count(freq) AS measured, count(freq) * 2 >= count(*) AS save_allowed FROM collected"),
    "rejudge_core": (rejudge_core, f"WITH {REJUDGED} SELECT {_T}, new_kind, new_verdict, new_reason, kind <> new_kind AS kind_changed, verdict <> new_verdict AS verdict_changed, kind <> new_kind AND kind = 'brand' AS brand_lost, false AS needs_review FROM rejudged"),
    "rejudge_report": (rejudge_report, f"WITH {REJUDGED} SELECT kind, verdict, new_kind, new_verdict, count(*) AS rows, count(*) FILTER (kind <> new_kind) AS kind_changed, count(*) FILTER (verdict <> new_verdict) AS verdict_changed, count(*) FILTER (kind <> new_kind AND kind = 'brand') AS brand_lost, 0 AS needs_review FROM rejudged GROUP BY ALL"),
    "apply_rejudge": (apply_rejudge, f"WITH {REJUDGED} SELECT phrase, seed, source, new_kind AS kind, freq, new_verdict AS verdict, new_reason AS reason, over_quota FROM rejudged"),
    "relabel_core": (relabel_core, f"WITH {REJUDGED} SELECT phrase, kind, CASE WHEN service AND thing THEN 'target' ELSE 'adjacent' END AS new_kind, freq FROM rejudged WHERE kind <> 'brand' AND NOT named AND kind <> CASE WHEN service AND thing THEN 'target' ELSE 'adjacent' END"),
    "domain_profile": (domain_profile, f"WITH {NEWEST} SELECT * FROM profile"),
    "core_verdict": (core_verdict, f"WITH {NEWEST}, ours AS (SELECT query AS phrase, min(organic_position) AS our_position FROM tops WHERE domain = 'nation-7.example' GROUP BY query), c AS (SELECT s.query AS phrase, s.region, s.freq, p.docs, p.specialized > p.educational AND p.clients * 2 < p.docs AS commercial, p.clients * 2 >= p.docs AS client_heavy, o.our_position FROM (SELECT query, region, count(*) AS freq FROM snapshots GROUP BY ALL) s LEFT JOIN profile p ON p.phrase = s.query LEFT JOIN ours o ON o.phrase = s.query) SELECT phrase, freq, CASE WHEN region = 0 THEN 'brand' WHEN region < 3 AND (docs IS NULL OR commercial OR client_heavy) THEN 'target' ELSE 'adjacent' END AS kind, CASE WHEN docs IS NULL THEN 'периферия' WHEN region = 0 AND our_position > 0 THEN 'ядро' WHEN region BETWEEN 1 AND 2 AND commercial THEN 'ядро' ELSE 'периферия' END AS verdict, CASE WHEN docs IS NULL THEN 'no_usable_documents' WHEN region = 0 THEN CASE WHEN our_position > 0 THEN 'we_rank' ELSE 'brand_ambiguous' END WHEN region < 3 THEN CASE WHEN commercial THEN 'commercial_top' WHEN client_heavy THEN 'client_top' ELSE 'educational_top' END WHEN commercial THEN 'adjacent_commercial' ELSE 'adjacent_educational' END AS reason, commercial, our_position FROM c"),
    "sync_pool": (sync_pool, f"WITH {SYNC} SELECT s.host_id, s.query, shows, clicks, CASE WHEN shown AND known THEN 'keep' WHEN shown AND beyond THEN 'skip' WHEN shown THEN 'add' WHEN page IS NOT NULL OR length(s.query) = 8 THEN 'keep' ELSE 'retire' END AS action, CASE WHEN shown AND known THEN 'shown_and_tracked' WHEN shown AND beyond THEN 'over_limit' WHEN shown THEN 'shown_not_tracked' WHEN page IS NOT NULL THEN 'article_target' WHEN length(s.query) = 8 THEN 'core_goal' ELSE 'no_shows' END AS reason, CASE WHEN NOT shown THEN page END AS page FROM synced s LEFT JOIN pages p ON p.host_id = s.host_id AND p.key = s.key"),
    "sync_dropped": (sync_dropped, f"WITH {SYNC} SELECT host_id, count(*) AS queries, count(*) FILTER (shows < 1) AS below_shows, count(*) FILTER (shows >= 1 AND regexp_matches(query, 'query 1\\d$')) AS junk, greatest(count(*) FILTER (shows >= 1 AND NOT regexp_matches(query, 'query 1\\d$')) - 25, 0) AS over_limit FROM latest GROUP BY host_id"),
}
