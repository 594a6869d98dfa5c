"""Queries over the llm operators, with production parameters, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.functions.geo import haversine_m, possible_position
from tidelane.llm.asof import nearest_in_time
from tidelane.llm.components import connected_components
from tidelane.llm.leakage import leaks, paraphrases
from tidelane.llm.mixing import mixture, shares, token_counts
from tidelane.llm.quantiles import percentiles, summaries
from tidelane.llm.spans import shared_spans
from tidelane.llm.survivors import claims_of, judged_values, newest_filled
from tidelane.llm.topn import top_n
from tidelane.runtime import hot_keys, read_table, salted_join, written

INFRA = "infrastructure_repeat_cat_6m_v20220805"


def infra_pairs(spark: SparkSession, d: str, most_m: float = 50.0) -> DataFrame:
    """(a, b): pairs of known, different detections at most most_m apart; a null distance is taken from the positions."""
    pairs = read_table(spark, d, "composite_pair_match").select(F.trim("detect_id_a").alias("a"), F.trim("detect_id_b").alias("b"), "distance_m").where("a <> b and (distance_m is null or distance_m <= %r)" % most_m)
    at = F.when(possible_position(F.col("detect_lat"), F.col("detect_lon"), 360.0), F.struct(F.col("detect_lat").alias("lat"), F.col("detect_lon").alias("lon")))
    known = read_table(spark, d, INFRA).where("detect_id is not null").groupBy(F.trim("detect_id").alias("id")).agg(F.max(at).alias("p"))
    hot = hot_keys(pairs.select(F.explode(F.array("a", "b")).alias("k")), ["k"])
    both = salted_join(pairs, known.toDF("a", "pa"), ["a"], F.col("b"), hot=hot and hot.toDF("a", "__salts"))
    both = salted_join(both, known.toDF("b", "pb"), ["b"], F.col("a"), hot=hot and hot.toDF("b", "__salts"))
    far = haversine_m(F.col("pa.lat"), F.col("pa.lon"), F.col("pb.lat"), F.col("pb.lon"))
    return both.where(F.coalesce("distance_m", far) <= most_m).select("a", "b")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(infra_pairs(spark, d), "a", "b").select(F.col("vertex").alias("detect_id"), F.col("component").alias("group_id"))


#: Codes for "not available".
NO_SPEED, NO_COURSE = 102.3, 360.0


def _extrapolation_columns() -> tuple[dict[str, Column], dict[str, Column]]:
    """(keys, fields): ssvid, scene_id and source without blanks and letter case; what counts as filled."""

    def filled(name: str) -> Column:
        c = F.col(name)
        known = ~F.isnan(c)
        if name.startswith("speed"):
            known &= c < NO_SPEED
        if name.startswith("course"):
            known &= c < NO_COURSE
        return F.when(known, c)

    keys = {"ssvid": F.nullif(F.trim("ssvid"), F.lit("")), "scene_id": F.nullif(F.upper(F.trim("scene_id")), F.lit("")), "source": F.nullif(F.upper(F.trim("source")), F.lit(""))}
    return keys, {f: filled(f) for f in ("delta_minutes1", "speed1", "course1", "delta_minutes2", "speed2", "course2")}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The rule asks for the newest filled value, so nothing is estimated; p4_trusted is what the model decides."""
    keys, fields = _extrapolation_columns()
    newest = newest_filled(read_table(spark, d, "detect_foot_ext_doppler"), keys, "ext_id", "loaded_at", fields)
    return newest.select(*keys, F.col("field").alias("field_name"), F.col("row_id").alias("ext_id"))


def p4_trusted(spark: SparkSession, d: str) -> DataFrame:
    """For each ssvid and scene_id, every value judged true on the evidence of the sources that claim or deny it; a witness is a source's rows of one lateness class."""
    keys, fields = _extrapolation_columns()
    del keys["source"]
    late = F.log2(1 + F.greatest(F.lit(0.0), (F.unix_micros("loaded_at") - F.unix_micros("extrap_timestamp")) / 3.6e9))
    witness = F.concat_ws("/", F.upper(F.trim("source")), F.coalesce(F.least(F.floor(late), F.lit(10)).cast("string"), F.lit("-")))
    claims, groups = claims_of(read_table(spark, d, "detect_foot_ext_doppler"), keys, "ext_id", "loaded_at", witness, fields)
    values, _ = judged_values(claims)
    return values.where("p >= 0.5").join(groups, "gid").select("ssvid", "scene_id", F.col("field").alias("field_name"), "value", F.col("row_id").alias("ext_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n(read_table(spark, d, "score_mult"), "scene_id", ["detect_id", "ssvid"], "score", 5, keep=True).select("scene_id", "ssvid", "detect_id")


def _detections(spark: SparkSession, d: str) -> DataFrame:
    """(left_id, entity, t): the latest version of each detection, if that has an ssvid."""
    rows = read_table(spark, d, "detect_scene_match").where("detect_id is not null")
    at = F.struct("loaded_at", F.unix_micros("detect_timestamp").alias("t"), F.nullif(F.trim("ssvid"), F.lit("")).alias("entity"))
    return rows.groupBy(F.col("detect_id").alias("left_id")).agg(F.max(at).alias("v")).select("left_id", "v.entity", "v.t")


def _extrapolations(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "detect_foot_ext_doppler").select(F.col("ext_id").alias("right_id"), F.nullif(F.trim("ssvid"), F.lit("")).alias("entity"), F.unix_micros("extrap_timestamp").alias("t"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest_in_time(_detections(spark, d), _extrapolations(spark, d), 600.0).select(F.col("left_id").alias("detect_id"), F.col("right_id").alias("ext_id"))


def _measures(spark: SparkSession, d: str) -> DataFrame:
    """(midpoint, iso3, metric, v), each id once, in its latest version; values out of range left out."""
    rows = read_table(spark, d, INFRA).where("id is not null")
    latest = rows.groupBy("id").agg(F.max(F.struct("loaded_at", "midpoint", F.get("iso_ter1", F.lit(0)).alias("first"), "length_m", "presence")).alias("r")).select("r.*")
    iso3 = F.coalesce(F.nullif(F.trim("first"), F.lit("")), F.lit("None"))
    both = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.when(F.col(m).between(a, b), F.col(m)).alias("v")) for m, a, b in (("length_m", 1.0, 600.0), ("presence", 0.0, 1.0))]))
    return latest.where("midpoint is not null").select(F.date_format("midpoint", "yyyy-MM-dd").alias("midpoint"), iso3.alias("iso3"), both).where("v is not null")


def p7_percentiles(spark: SparkSession, d: str) -> DataFrame:
    groups = ["midpoint", "iso3", "metric"]
    return percentiles(summaries(_measures(spark, d), groups, "v"), groups, [0.1, 0.5, 0.9, 0.99]).toDF(*groups, "n", "p10", "p50", "p90", "p99")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    big = p7_percentiles(spark, d).where("n >= 20")
    return big.where("(metric = 'length_m' and p50 >= 120) or (metric = 'presence' and p90 < 0.7)").select("midpoint", "iso3", "metric")


def _texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), read_table(spark, d, "eval_items").select(F.col("item_id").alias("item"), "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(*_texts(spark, d)).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """For each item that leaks: in how many documents, and its longest stretch in words."""
    return leaks(*_texts(spark, d)).groupBy(F.col("item").alias("item_id")).agg(F.count(F.lit(1)).alias("docs"), F.max("words").alias("longest"))


def p8_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    return paraphrases(*_texts(spark, d)).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "common", "answers")


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _tokens(spark: SparkSession, d: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return written(token_counts(read_table(spark, d, "documents"), "doc_id", "source", "text", vocabulary), "tokens")[0]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Read off the drawn mixture: what every document gives as often as it may, and that is short of the target."""
    return shares(*_mixed(spark, d)).where("short").select("source")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixture(_tokens(spark, d), read_table(spark, d, "mix_targets"), weight=F.log1p("tokens"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0].select(F.col("id").alias("doc_id"), "source", "tokens", "copies")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(*_mixed(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    found = shared_spans(read_table(spark, d, "documents"), "doc_id", "text")
    return found.select("doc_id", F.col("start").cast("bigint").alias("span_start"), F.col("end").cast("bigint").alias("span_end"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document also stands elsewhere; documents without a shared stretch have zero."""
    found = shared_spans(read_table(spark, d, "documents"), "doc_id", "text")
    per = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("end") - F.col("start")).cast("bigint").alias("shared_chars"))
    docs = read_table(spark, d, "documents").where("doc_id is not null").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("chars"))
    out = docs.join(per, "doc_id", "left").fillna(0, ["spans", "shared_chars"])
    return out.withColumn("share", F.round(F.coalesce(F.try_divide("shared_chars", "chars"), F.lit(0.0)), 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p4_found, p4_trusted, p5_found, p6_found, p7_found, p7_percentiles, p8_found, p8_items, p8_paraphrases, p9_found, p9_mixture, p9_shares, p10_found, p10_shares)}

_FIELDS = {"delta_minutes1": "", "speed1": "and speed1 < 102.3", "course1": "and course1 < 360", "delta_minutes2": "", "speed2": "and speed2 < 102.3", "course2": "and course2 < 360"}

SQL: dict[str, str] = {
    "p2_found": """
with recursive known as (
  select trim(detect_id) as id, max(case when abs(detect_lat) <= 90 and detect_lon between -180 and 360 then {'lat': detect_lat, 'lon': detect_lon} end) as p
  from infrastructure_repeat_cat_6m_v20220805 where detect_id is not null group by 1),
pairs as (
  select x.id as a, y.id as b from composite_pair_match m join known x on x.id = trim(m.detect_id_a) join known y on y.id = trim(m.detect_id_b)
  where x.id <> y.id and coalesce(m.distance_m, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(y.p.lat - x.p.lat) / 2), 2)
    + cos(radians(x.p.lat)) * cos(radians(y.p.lat)) * pow(sin(radians(y.p.lon - x.p.lon) / 2), 2))))) <= 50),
links as (select a, b from pairs union select b, a from pairs),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select a as detect_id, least(a, min(b)) as group_id from reach group by a
""",
    "p4_found": "with r as (select ext_id, loaded_at, nullif(trim(ssvid), '') as ssvid, nullif(upper(trim(scene_id)), '') as scene_id, nullif(upper(trim(source)), '') as source, "
    + ", ".join(_FIELDS)
    + """ from detect_foot_ext_doppler where ext_id is not null),
g as (select *, count(*) over (partition by ssvid, scene_id, source) as n from r where ssvid is not null and scene_id is not null and source is not null),
f as ("""
    + " union all ".join(f"select ssvid, scene_id, source, '{f}' as field_name, ext_id, loaded_at from g where n > 1 and {f} is not null and not isnan({f}) {more}" for f, more in _FIELDS.items())
    + """)
select ssvid, scene_id, source, field_name, ext_id from (
  select *, row_number() over (partition by ssvid, scene_id, source, field_name order by loaded_at desc nulls last, ext_id) as k from f) where k = 1""",
    "p5_found": """
with b as (select scene_id, ssvid, detect_id, max(score) as s from score_mult
  where scene_id is not null and ssvid is not null and detect_id is not null and score is not null and not isnan(score) group by 1, 2, 3)
select scene_id, ssvid, detect_id from (select *, row_number() over (partition by scene_id order by s desc, detect_id, ssvid) as k from b) where k <= 5
""",
    "p6_found": """
with l as (select detect_id, t, entity from (
    select detect_id, epoch_us(detect_timestamp) as t, nullif(trim(ssvid), '') as entity,
           row_number() over (partition by detect_id order by loaded_at desc nulls last, detect_timestamp desc nulls last, nullif(trim(ssvid), '') desc nulls last) as k
    from detect_scene_match where detect_id is not null) where k = 1 and entity is not null and t is not null),
r as (select ext_id, epoch_us(extrap_timestamp) as t, nullif(trim(ssvid), '') as entity from detect_foot_ext_doppler where ext_id is not null and extrap_timestamp is not null)
select detect_id, ext_id from (
  select l.detect_id, r.ext_id, row_number() over (partition by l.detect_id order by abs(l.t - r.t), r.ext_id) as k
  from l join r on l.entity = r.entity and r.t between l.t - 600000000 and l.t + 600000000) where k = 1
""",
    "p7_found": """
with r as (select * from (
    select *, row_number() over (partition by id order by loaded_at desc nulls last, midpoint desc nulls last, iso_ter1[1] desc nulls last, length_m desc nulls last, presence desc nulls last) as k
    from infrastructure_repeat_cat_6m_v20220805 where id is not null) where k = 1 and midpoint is not null),
v as (
  select strftime(midpoint, '%Y-%m-%d') as midpoint, coalesce(nullif(trim(iso_ter1[1]), ''), 'None') as iso3, 'length_m' as metric, length_m as x from r where length_m between 1 and 600
  union all
  select strftime(midpoint, '%Y-%m-%d'), coalesce(nullif(trim(iso_ter1[1]), ''), 'None'), 'presence', presence from r where presence between 0 and 1)
select midpoint, iso3, metric from v where not isnan(x) group by 1, 2, 3
having count(*) >= 20 and ((metric = 'length_m' and quantile_cont(x, 0.5) >= 120) or (metric = 'presence' and quantile_cont(x, 0.9) < 0.7))
""",
}
