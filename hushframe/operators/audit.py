"""Audit events: their canonical text, hash chain, verification and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.hashes import hmac_sha256

EVENT = (
    "event_id string, timestamp string, decision string, reason_codes array<string>, entity_counts map<string,int>, risk_level string, risk_score int, "
    "recipient_class string, purpose string, policy_profile string, policy_version string, transformations array<string>, verification string, "
    "prev_hash string, event_hash string, dictionary_loaded boolean, dictionary_entries int, grant_id string, grant_issuer string"
)
#: Fields that older records may lack; they count towards a hash only where they are stored.
OPTIONAL = ("dictionary_loaded", "dictionary_entries", "grant_id", "grant_issuer")


def entity_counts(facts: Column) -> Column:
    """map<type,int> of the facts of one payload."""
    types = F.transform(facts, lambda f: f["type"])
    return F.map_from_entries(F.transform(F.array_distinct(types), lambda t: F.struct(t, F.size(F.filter(types, lambda x: x == t)))))


def events(df: DataFrame, event_id: str | Column, timestamp: str | Column, recipient: str = "EXTERNAL_APPROVED", purpose: str = "EXTERNAL_AI_ASSISTANCE") -> DataFrame:
    """Audit events of the rows of sanitize(): metadata only, no value of any payload."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    version = F.col("decision.policy_version")
    status = F.when(F.col("verification").isNotNull(), F.when(F.col("verification.passed"), "PASS").otherwise("FAIL")).when(F.col("decision.verdict") == "ALLOW", "N/A (ALLOW)").otherwise("N/A")
    ops = F.array_distinct(F.transform(F.coalesce("decision.plan", F.array().cast("array<struct<op:string,target:string>>")), lambda o: o["op"]))
    return df.select(
        col(event_id).cast("string").alias("event_id"), col(timestamp).cast("string").alias("timestamp"), F.col("decision.verdict").alias("decision"), F.col("decision.reason_codes").alias("reason_codes"),
        entity_counts(F.col("facts")).alias("entity_counts"), F.col("decision.risk_level").alias("risk_level"), F.col("decision.risk_score").alias("risk_score"), F.lit(recipient).alias("recipient_class"), F.lit(purpose).alias("purpose"),
        F.split_part(version, F.lit("/"), F.lit(1)).alias("policy_profile"), version.alias("policy_version"), ops.alias("transformations"), status.alias("verification"),
        F.lit(False).alias("dictionary_loaded"), F.lit(0).alias("dictionary_entries"), F.lit("").alias("grant_id"), F.lit("").alias("grant_issuer"),
    )


def _json_text(x: Column) -> Column:
    """A JSON string literal: quotes, backslashes and control characters escaped, others as they are."""
    return F.regexp_extract(F.to_json(F.struct(x.alias("a"))), r'(?s)^\{"a":(.*)\}$', 1)


def _stored_fields() -> list[tuple[str, Column]]:
    """(name, its JSON pair or null where the record lacks it) of the stored fields but event_hash, by name."""
    texts = ("decision", "event_id", "policy_profile", "policy_version", "prev_hash", "purpose", "recipient_class", "risk_level", "timestamp", "verification", "grant_id", "grant_issuer")
    value: dict[str, Column] = {n: _json_text(F.coalesce(F.col(n), F.lit(""))) for n in texts}
    listed = lambda n: F.concat(F.lit("["), F.array_join(F.transform(F.col(n), _json_text), ", "), F.lit("]"))
    value |= {n: listed(n) for n in ("reason_codes", "transformations")}
    pairs = F.array_sort(F.map_entries("entity_counts"))
    value["entity_counts"] = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(_json_text(e["key"]), F.lit(": "), e["value"].cast("string"))), ", "), F.lit("}"))
    value |= {n: F.col(n).cast("string") for n in ("risk_score", "dictionary_entries", "dictionary_loaded")}
    return [(n, F.when(F.col(n).isNotNull() if n in OPTIONAL else F.lit(True), F.concat(F.lit(f'"{n}": '), value[n]))) for n in sorted(value)]


def _pairs(parts: list[Column]) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), ", ")


def canonical_event() -> Column:
    """The stored fields but event_hash as JSON text with sorted keys and ', ' and ': ' between."""
    return F.concat(F.lit("{"), _pairs([c for _, c in _stored_fields()]), F.lit("}"))


def around_link() -> tuple[Column, Column]:
    """The canonical text before and behind the value of prev_hash, which only the record before tells."""
    fields = _stored_fields()
    before, behind = ([c for n, c in fields if side(n)] for side in (lambda n: n < "prev_hash", lambda n: n > "prev_hash"))
    return F.concat(F.lit("{"), _pairs(before), F.lit(', "prev_hash": "')), F.concat(F.lit('", '), _pairs(behind), F.lit("}"))


def event_hash(key: bytes | None = None) -> Column:
    text = canonical_event()
    return hmac_sha256(text, key) if key else F.sha2(text, 256)


def in_ranges(df: DataFrame, order: str) -> DataFrame:
    """``df`` with __range, the number of its range of the numeric column ``order``; as many ranges of about one size as shuffle partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.approxQuantile(order, [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    return df.withColumn("__range", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(order) > c)) if cuts else F.lit(0))


def verify_chain(log: DataFrame, seq: str = "seq", key: bytes | None = None) -> DataFrame:
    """(seq, problem) of records whose hash or link is wrong; problem is null for sound ones.

    Records without a hash are outside the chain.  A link is the hash of the last
    record before that has one: within a range of seq from one sorted pass, across
    ranges from a table with one row for each, so no task sees the whole log.
    """
    chained = log.where("event_hash is not null and event_hash <> ''").withColumn("__own", event_hash(key))
    slim = in_ranges(chained.select(seq, "prev_hash", "event_hash", "__own"), seq)
    slim = slim.withColumn("__before", F.lag("event_hash").over(Window.partitionBy("__range").orderBy(seq)))
    ends = slim.groupBy("__range").agg(F.max_by("event_hash", seq).alias("__last"))
    carried = ends.select("__range", F.lag("__last", 1, "").over(Window.orderBy("__range")).alias("__carried"))
    slim = slim.join(F.broadcast(carried), "__range").withColumn("__before", F.coalesce("__before", "__carried"))
    problem = F.when(F.col("__own") != F.col("event_hash"), "hash").when(F.coalesce("prev_hash", F.lit("")) != F.col("__before"), "link")
    return slim.select(seq, problem.alias("problem"))


def chain_head(log: DataFrame, seq: str = "seq") -> DataFrame:
    """(seq, event_hash) of the last record that has a hash: what the next one is linked to; no row for a log without one."""
    hashed = log.where("event_hash is not null and event_hash <> ''")
    return hashed.agg(F.max(seq).alias(seq), F.max_by("event_hash", seq).alias("event_hash")).where(F.col(seq).isNotNull())


def chain_report(log: DataFrame, seq: str = "seq", key: bytes | None = None) -> DataFrame:
    """(total, chained, unchained, failures) of a log."""
    sound = verify_chain(log, seq, key).agg(F.count("*").alias("chained"), F.count("problem").alias("failures"))
    total = log.agg(F.count("*").alias("total"))
    return total.crossJoin(sound).select("total", "chained", (F.col("total") - F.col("chained")).alias("unchained"), "failures")


def summary(log: DataFrame) -> DataFrame:
    """(section, name, n): counts by decision, risk, recipient, purpose, verification, reason, transformation and entity type.

    One pass: each event becomes its (section, name, weight) rows, summed before the shuffle.
    """
    one = lambda section, name: F.array(F.struct(F.lit(section).alias("section"), F.col(name).alias("name"), F.lit(1).cast("long").alias("n")))
    many = lambda section, name: F.transform(F.col(name), lambda x: F.struct(F.lit(section).alias("section"), x.alias("name"), F.lit(1).cast("long").alias("n")))
    entities = F.transform(F.map_entries("entity_counts"), lambda e: F.struct(F.lit("entity").alias("section"), e["key"].alias("name"), e["value"].cast("long").alias("n")))
    rows = F.concat(one("decision", "decision"), one("risk", "risk_level"), one("recipient", "recipient_class"), one("purpose", "purpose"), one("verification", "verification"), many("reason", "reason_codes"), many("transformation", "transformations"), entities)
    return log.select(F.explode(rows).alias("r")).select("r.*").groupBy("section", "name").agg(F.sum("n").alias("n"))


def top(counts: DataFrame, n: int = 12) -> DataFrame:
    """The n largest names of each section, the rest folded into one row.

    Of equally frequent names those come first that were seen first, if ``counts`` has a
    column ``first`` that tells; else by name.
    """
    ties = ["first", "name"] if "first" in counts.columns else ["name"]
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), *ties))
    name = F.when(F.col("rank") <= n, F.col("name")).otherwise("(other)")
    return counts.withColumn("rank", rank).select("section", name.alias("name"), "n").groupBy("section", "name").agg(F.sum("n").alias("n"))
