"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Patterns propose candidates. Every candidate's hash is counted over the whole corpus by distinct
owner and repository (here ``source`` and the different text): a value that ``MAX_OWNERS`` or fewer
owners and ``MAX_REPOSITORIES`` or fewer repositories hold and that looks random is *live*; a value
many owners or many texts of one owner hold is a widely copied example. Copies of a text count once.
Live values add a span of kind ``live`` over the secret itself; the patterns' own spans stay.

A value looks random if it has half the different signs that a random value of its length and alphabet
is expected to have (at most ``MIN_SIGNS`` are asked for). One that lacks a digit or a letter must also
not count on (1234..., abcd...) nor be made of words (most letter pairs common in English, German,
French or Spanish).

Places are code points, ends exclusive. A kind's matches are found by splitting the text at
them: lengths of the parts before, summed, are the places. Hot values (one key in a third of the
documents) are pre-aggregated by (hash, owner) and (hash, repository) before they meet.

Null text counts as empty, with no spans; a null owner counts as one owner of its own. Equal rows
get equal answers, rows of one id with different texts are kept apart, other columns stay untouched.
Very long texts are scanned whole. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import stored, whole_text

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: kind, pattern, group of the secret; a shorter match of access or hex never hides a longer one,
#: as both take the longest run, so their least lengths stand in the pattern
KINDS = (
    ("assign", ASSIGN, 2),
    ("access", "AKIA[A-Z0-9]{14,}", 0),
    ("hex", "[0-9a-f]{16,}", 0),
    ("hub", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0),
    ("chat", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END", 0),
)
BASE = ("assign", "access", "hex")
LIVE = "live"
ORDER = {kind: i for i, kind in enumerate((*BASE, LIVE))}
MIN_ASSIGNED = 12
MAX_OWNERS = 2
MAX_REPOSITORIES = 10
MIN_SIGNS = 8
#: a value's alphabet (the first that fits) and its size; any other has letters and digits of all kinds
ALPHABETS = (("^[0-9]+$", 10), ("^([0-9a-f]+|[0-9A-F]+)$", 16), ("^([a-z]+|[A-Z]+)$", 26))
ALL_SIGNS = 62
#: shares of neighbours, in tenths, from which a value counts on or is made of words
COUNTING, WORDY = 7, 6
#: letter pairs; random letters hold one in some 18 % of pairs, words in 80 % and more
PAIRS = (
    "th he in er an re nd on en at ou ed ha to or it is hi es ng st ar se le te al ti ve me ea nt de ne co ro li ri ra io ic as si ce et ch ll be ma om "
    "ur el ta la ho ec us ie ei di un ge sc au da em ss no pe mo tr pr so il ac ai am ca ad ee lo ol op ot ow pa po qu rd rs rt sa sh sp su ts ul ut wa wi wo ig gh"
).split()


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """(kind, gaps, values): the code points before each match since the last one, and the matches."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    return F.when(F.regexp_like(text, F.lit(pattern)), F.struct(F.lit(kind).alias("kind"), gaps.alias("gaps"), values.alias("values")))


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """(doc_id, row_key, owner, text_key, kind, start, end, secret, secret_start): each row's matches once.

    ``row_key`` hashes id and text: with the id it names a row, equal rows share it. ``text_key`` hashes the text.
    """
    whole = whole_text(text)
    found = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), whole).alias("row_key"), F.col(owner).cast("string").alias("owner"), F.xxhash64(whole).alias("text_key"),
        F.array_compact(F.array(*[_matches(whole, kind, pattern) for kind, pattern, _ in KINDS])).alias("found"),
    ).where(F.size("found") > 0)
    once = found.groupBy("doc_id", "row_key").agg(F.min_by("owner", "owner").alias("owner"), F.any_value("text_key").alias("text_key"), F.any_value("found").alias("found"))
    each = once.select("doc_id", "row_key", "owner", "text_key", F.explode("found").alias("f"))
    each = each.select("doc_id", "row_key", "owner", "text_key", F.col("f.kind").alias("kind"), F.posexplode(F.arrays_zip(F.slice("f.gaps", 1, F.size("f.values")).alias("gap"), F.col("f.values").alias("value"))).alias("i", "m"))
    upto = W.partitionBy("doc_id", "row_key", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    size = F.char_length("m.value")
    placed = each.withColumn("end", F.sum(F.col("m.gap") + size).over(upto)).select(
        "doc_id", "row_key", "owner", "text_key", "kind", (F.col("end") - size).alias("start"), "end", F.col("m.value").alias("value")
    )
    secret = F.when(F.col("kind") == "assign", F.regexp_extract("value", ASSIGN, 2)).otherwise(F.col("value"))
    return placed.withColumn("secret", secret).where((F.col("kind") != "assign") | (F.length("secret") >= MIN_ASSIGNED)).select(
        "doc_id", "row_key", "owner", "text_key", "kind", "start", "end", "secret", (F.col("end") - F.char_length("secret")).alias("secret_start")
    )


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories) of every candidate value over the corpus."""
    holder = F.explode(F.array(F.struct(F.lit(True).alias("owns"), F.col("owner").alias("name")), F.struct(F.lit(False).alias("owns"), F.col("text_key").cast("string").alias("name"))))
    holders = found.select("hash", holder.alias("holder")).select("hash", "holder.owns", "holder.name").distinct()
    return holders.groupBy("hash").agg(F.count_if("owns").alias("owners"), F.count_if(~F.col("owns")).alias("repositories"))


def looks_random(secret: Column) -> Column:
    """Whether a value of two or more signs looks random."""
    size = F.char_length(secret)
    alphabet = F.lit(ALL_SIGNS)
    for pattern, n in reversed(ALPHABETS):
        alphabet = F.when(secret.rlike(pattern), n).otherwise(alphabet)
    expected = alphabet * (1 - F.pow(1 - 1 / alphabet, size))
    signs = F.size(F.array_distinct(F.split(secret, "")))
    pairs = F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substr(secret, i, F.lit(2)))
    counting = F.size(F.filter(pairs, lambda p: F.abs(F.ascii(F.substr(p, F.lit(2))) - F.ascii(p)) <= 1))
    letters = F.filter(F.transform(pairs, F.lower), lambda p: p.rlike("^[a-z]{2}$"))
    words = F.size(F.filter(letters, lambda p: p.isin(PAIRS)))
    chance = (10 * counting < COUNTING * (size - 1)) & ((F.size(letters) == 0) | (10 * words < WORDY * F.size(letters)))
    return (signs >= F.least(F.lit(MIN_SIGNS), F.ceil(expected / 2))) & (secret.rlike("[0-9]") & secret.rlike("[A-Za-z]") | chance)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per candidate: place, hash, owners, repositories and whether it is live."""
    found = stored(candidates(docs, doc_id, text, owner).withColumn("hash", F.sha2("secret", 256)), "candidates")
    live = looks_random(F.col("secret")) & (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    return found.join(ownership(found), "hash").withColumn("live", live)


def spans(judged: DataFrame) -> DataFrame:
    """(doc_id, row_key, spans): the base spans and the live ones, by start, then kind."""
    shown = F.array(
        F.when(F.col("kind").isin(*BASE), F.struct("start", F.lit(0).alias("o"), "kind", "end")),
        F.when(F.col("live"), F.struct(F.col("secret_start").alias("start"), F.lit(0).alias("o"), F.lit(LIVE).alias("kind"), "end")),
    )
    rows = judged.select("doc_id", "row_key", F.explode(F.array_compact(shown)).alias("s")).select("doc_id", "row_key", "s.start", "s.kind", "s.end")
    place = F.create_map(*[F.lit(x) for pair in ORDER.items() for x in pair])
    # a value may be live under two patterns: one span; a row has no more spans than text
    spanned = rows.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_set(F.struct("start", place[F.col("kind")].alias("o"), "end", "kind"))).alias("spans"))
    return spanned


def secret_rows(docs: DataFrame) -> DataFrame:
    """Per document the counts of the base kinds, the digest of the base spans, and all spans."""
    found = spans(scan(docs)).withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", F.xxhash64(F.col("doc_id"), whole_text()).alias("_key"))
    both = rows.join(found, (F.col("_key") == F.col("row_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    every = F.coalesce("spans", F.expr("array()").cast(found.schema["spans"].dataType))
    base = F.filter(every, lambda s: s["kind"].isin(*BASE))
    text = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(every, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return both.select("doc_id", *[count(k) for k in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(every).alias("spans"))
